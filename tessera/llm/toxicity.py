"""Toxicity: a classifier chain over linear models."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, release, text_of, tidy

#: At most so many labelled rows, chosen by a hash of the id, fit the chain.
TRAIN_ROWS = 12_000
#: So many words and stems with the strongest evidence are features.
FEATURES = 160
#: A feature word is in at least so many rows of the sample, however large that is: a rare language's words count too.
SUPPORT = 6
FOLDS = 5
#: The cut-off is the one of best F1 on out-of-fold probabilities within these bounds.
CUTS = (0.4, 0.6)
#: Where labels name no categories, the toxic rows are split into so many by the words that they share: toxic_1 around the word of strongest
#: evidence, toxic_2 around the strongest word that rarely comes with the first, and so on.
CATEGORIES = 2
#: A word is another category's seed if it shares less than this part of its rows (or the seed's, if fewer) with each seed.
APART = 0.5
WORD = re.compile(r"[^\W\d_]+")
#: Besides words, features are stems: the first STEM letters of longer words, with "at least k different words of this stem" as one
#: feature for each k up to STEM_COUNTS; languages inflect their insults.
STEM, STEM_COUNTS = 5, 3


def text_features(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    stems = Counter(w[:STEM] for w in words if len(w) > STEM)
    return words | {f"{s}*{k}" for s, n in stems.items() for k in range(1, min(n, STEM_COUNTS) + 1)}


@dataclass
class Chain:
    """Categories in order; each has weights over (bias, words and stems, log of distinct words, earlier categories' probabilities)."""

    categories: list[str]
    words: list[str]
    weights: list[np.ndarray]
    threshold: float

    def features(self, found: list, sizes: list) -> np.ndarray:
        """found: the features of each text, at least those the model knows; sizes: their numbers before any were left out."""
        at = {w: i for i, w in enumerate(self.words)}
        x = np.zeros((len(found), len(at) + 2), np.float64)
        x[:, 0] = 1
        for r, f in enumerate(found):
            x[r, [at[w] + 1 for w in at.keys() & f]] = 1
        x[:, -1] = np.log1p(sizes) / 10
        return x

    def probabilities(self, texts, at_once: int = 128) -> np.ndarray:
        """at_once: texts whose words are held at the same time."""
        parts = [self._probabilities(texts[i : i + at_once]) for i in range(0, len(texts), at_once)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.weights)))

    def _probabilities(self, texts) -> np.ndarray:
        found = [text_features(t) for t in texts]
        x = self.features(found, [len(f) for f in found])
        wordless = x[:, -1] == 0
        for w in self.weights:
            x = np.column_stack([x, np.where(wordless, 0, _sigmoid(x @ w))])
        return x[:, -len(self.weights) :]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, rounds: int = 12) -> np.ndarray:
    """Newton's method for ridge-penalised logistic regression; the bias is column 0 and almost free."""
    penalty = np.full(x.shape[1], l2)
    penalty[0] = 1e-6
    w = np.zeros(x.shape[1])
    p = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    w[0] = np.log(p / (1 - p))
    for _ in range(rounds):
        q = _sigmoid(x @ w)
        step = np.linalg.solve((x * (q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - q) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return w


def split_categories(found: list[set], toxic: np.ndarray, evidence: list[str], n: int = CATEGORIES) -> dict[str, np.ndarray]:
    """evidence: features of toxic rows, strongest first. A category's label is 1 for toxic rows with one of its features: those that come with
    its seed more often than with the others'. Without another seed, the categories that are left have no rows."""
    at = {w: {i for i, f in enumerate(found) if toxic[i] and w in f} for w in evidence}
    seeds: list[str] = []
    for w in evidence:
        if len(seeds) < n and at[w] and all(len(at[w] & at[s]) < APART * min(len(at[w]), len(at[s])) for s in seeds):
            seeds.append(w)
    rows: list[set] = [set() for _ in range(n)]
    for w in evidence:
        if seeds:
            rows[max(range(len(seeds)), key=lambda k: (len(at[w] & at[seeds[k]]) / len(at[w] | at[seeds[k]]) if at[w] else 0, -k))] |= at[w]
    return {f"toxic_{k + 1}": np.array([i in r for i in range(len(found))], float) for k, r in enumerate(rows)}


def strongest(counts: pd.DataFrame, n: int, toxic: int, features: int) -> pd.DataFrame:
    """counts: word, a (toxic rows with it), n (rows with it). The features whose rows differ most from the share of toxic ones, with z, strongest
    first."""
    share = toxic / max(n, 1)
    seen = counts[counts.n >= SUPPORT]
    z = (seen.a - seen.n * share) / np.sqrt(seen.n * (share * (1 - share)) + 1e-9)
    return seen.assign(z=z, size=-z.abs()).sort_values(["size", "word"]).head(features)


def fit_chain(found: list[set], sizes, fold: np.ndarray, labels: dict[str, np.ndarray], words: list[str], words_of_fold: list[list[str]] | None = None) -> Chain:
    """labels: a 0/1 vector for each category, in chain order. Later categories train on earlier ones' out-of-fold probabilities, so that
    they see inputs as uncertain as at scoring time; the stored weights of each are then fitted on all rows. words_of_fold: the features
    chosen without each fold's rows; out-of-fold models know no others.
    """
    model = Chain(list(labels), words, [], 0.5)
    x = model.features(found, sizes)
    inner = [x if words_of_fold is None else Chain([], w, [], 0.5).features(found, sizes) for w in words_of_fold or [words] * (int(fold.max(initial=0)) + 1)]
    before, oof = np.zeros((len(x), 0)), np.zeros(len(x))
    for y in labels.values():
        oof = np.zeros(len(x))
        for f, own in enumerate(inner):
            hold, own = fold == f, np.column_stack([own, before])
            if hold.any():
                oof[hold] = _sigmoid(own[hold] @ fit_logistic(own[~hold], y[~hold]))
        model.weights.append(fit_logistic(np.column_stack([x, before]), y))
        before = np.column_stack([before, oof])
    y = list(labels.values())[-1] if labels else np.zeros(0)
    grid = np.linspace(*CUTS, 41)
    f1 = [2 * (y * (oof >= t)).sum() / max(1e-9, y.sum() + (oof >= t).sum()) for t in grid]
    model.threshold = float(np.median(grid[np.array(f1) >= max(f1) - 1e-9])) if len(y) and max(f1) > 0 else 0.5
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", categories: tuple[str, ...] = (), limit: int = TRAIN_ROWS, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit the chain on at most limit labelled rows (the smallest hashes of the id): the categories, then label.

    categories: columns of labels with 0 or 1, in chain order. Where there are none, the toxic rows are split by the words that they
    share. Features are those whose document frequencies differ most between toxic and other rows of the sample; for out-of-fold
    models, of the rows outside the fold. Counts come from Spark; the driver gets those of the words with the strongest evidence.
    """
    bound_batches(docs.sparkSession)
    own = [*categories, label]
    rated = labels.select(F.col(id_col).alias("_id"), *(F.col(c).cast("int").alias(f"y{k}") for k, c in enumerate(own)))
    rated = rated.dropna(subset=["_id", f"y{len(own) - 1}"]).groupBy("_id").agg(*(F.coalesce(F.max(f"y{k}"), F.lit(0)).alias(f"y{k}") for k in range(len(own))))
    chosen = rated.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    ids = chosen.sparkSession.createDataFrame(chosen.toPandas(), "_id long, " + ", ".join(f"y{k} int" for k in range(len(own))))  # limit rows of a few numbers
    sample = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("text")).join(F.broadcast(ids), "_id").dropDuplicates(["_id"])
    y = F.col(f"y{len(own) - 1}")
    fold = F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int").alias("fold")
    sample = sample.select("_id", *(f"y{k}" for k in range(len(own))), fold, _found("text").alias("found")).persist()
    try:
        sizes = sample.groupBy("fold").agg(F.count("*").alias("n"), F.sum(y).alias("a")).toPandas().set_index("fold").reindex(range(FOLDS), fill_value=0)
        words = sample.select("fold", y.alias("y"), F.explode("found").alias("word"))
        seen = words.groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("a")).filter(F.col("n") >= SUPPORT)
        n, toxic = int(sizes.n.sum()), int(sizes.a.sum())
        share = toxic / max(n, 1)
        z = F.abs(F.col("a") - F.col("n") * share) / F.sqrt(F.col("n") * F.lit(share * (1 - share) + 1e-9))
        counts = seen.orderBy(z.desc(), "word").limit(features * (FOLDS + 1)).toPandas()
        # by fold, only of these
        each = words.filter(F.col("word").isin(counts.word.tolist() or [""])).groupBy("word", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("a")).toPandas()
        of = {(w, f): (k, t) for w, f, k, t in zip(each.word, each.fold, each.n, each.a)}
        for f in range(FOLDS):
            counts[f"n{f}"], counts[f"a{f}"] = ([of.get((w, f), (0, 0))[j] for w in counts.word] for j in (0, 1))
        best = strongest(counts, n, toxic, features)
        of_fold = [strongest(pd.DataFrame({"word": counts.word, "n": counts.n - counts[f"n{f}"], "a": counts.a - counts[f"a{f}"]}), n - int(sizes.n[f]), toxic - int(sizes.a[f]), features).word.tolist() for f in range(FOLDS)]
        # only the chosen features of each text are needed on the driver
        wanted = sorted({*best.word, *(w for ws in of_fold for w in ws)})
        kept = F.filter("found", lambda w: w.isin(wanted or [""]))
        rows = sample.orderBy("_id").select(kept.alias("found"), F.size("found").alias("size"), "fold", *(f"y{k}" for k in range(len(own)))).toPandas()
    finally:
        sample.unpersist()
        tidy(docs.sparkSession)
    found = [set(f) for f in rows["found"]]
    named = {c: rows[f"y{k}"].to_numpy(float) for k, c in enumerate(own)}
    if not categories:
        named = {**split_categories(found, named[label], best.word[best.z > 0].tolist()), **named}
    return fit_chain(found, rows["size"].tolist(), rows["fold"].to_numpy(), named, best.word.tolist(), of_fold)


def _found(column: str) -> Column:
    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        out = texts.map(lambda t: sorted(text_features(t)))
        release()
        return out

    return found(column)


def _scorer(model: Chain):
    schema = ", ".join(f"{c} double" for c in model.categories)

    @F.pandas_udf(schema)
    def score(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame(model.probabilities(texts.tolist()), columns=model.categories)
        release()
        return found

    return score


def chain_scores(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, a probability for each category in chain order, rejected (the last one reaches the threshold).

    Whole texts are read, and every row is judged by itself: no shuffle. Texts without words, null and empty ones among them, get 0 throughout. Null
    ids, repeated rows and ties pass through; other columns are ignored; an empty table gives no rows, and a model fitted on no labels
    rejects nothing.
    """
    scored = docs.select(F.col(id_col).alias("doc_id"), _scorer(model)(text_of(text_col)).alias("p"))
    return scored.select("doc_id", "p.*").withColumn("rejected", F.col(model.categories[-1]) >= model.threshold)


def is_toxic(model: Chain, text_col: str = "text") -> Column:
    return _scorer(model)(text_of(text_col))[model.categories[-1]] >= model.threshold
