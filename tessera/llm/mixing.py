"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise, release, text_of

#: Cells (combinations of source, language and topic that occur) up to this number are raked on the driver, 100 bytes each; more are raked
#: by Spark, with the same arithmetic.
DRIVER_CELLS = 200_000
DIMS = ("source", "lang", "topic")
#: How far present proportions are kept: target = (tokens ** POWER) normalised.
POWER = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: Raking ends once no marginal is further from its target than this part of the budget, or after so many rounds.
TOLERANCE, ROUNDS = 1e-4, 200
#: Tokens to sample, as a share of all.
BUDGET = 0.6
SALT = "mix-1"
#: Topics are clusters of texts by the words they use more than others of their language: words fall by hash into WIDTH counts, and TOPICS centres
#: are fitted in STEPS passes over all texts' counts. The centres start from at most STARTERS texts. Languages fall into LANG_BINS by hash.
TOPICS, WIDTH, STEPS, STARTERS, LANG_BINS = 8, 64, 6, 2000, 256
NO_TOPIC = "none"


class _Bin(dict):
    def __missing__(self, word: bytes) -> int:
        b = self[word] = xxhash.xxh64_intdigest(word) % WIDTH
        return b


def word_profile(text: str, bins: _Bin | None = None) -> tuple[int, np.ndarray]:
    """Words of the text (runs of other than ASCII white space; A-Z count as a-z), and the square roots of their counts by bin, of length 127, as
    whole numbers."""
    bins = _Bin() if bins is None else bins
    words = text.encode("utf-8").lower().split()
    v = np.sqrt(np.bincount([bins[w] for w in words], minlength=WIDTH)) if words else np.zeros(WIDTH)
    return len(words), np.rint(v * (127 / max(1e-9, np.sqrt((v * v).sum())))).astype(np.int8)


def _profile_udf():
    @F.pandas_udf("tokens long, profile binary")
    def profile(texts: pd.Series) -> pd.DataFrame:
        bins = _Bin()
        both = [word_profile(t, bins) for t in texts]
        out = pd.DataFrame({"tokens": [n for n, _ in both], "profile": [v.tobytes() for _, v in both]})
        del bins
        release()
        return out

    return profile


def _vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int8).reshape(-1, WIDTH).astype(np.int64)


def _lang_bins(langs) -> np.ndarray:
    known: dict[str, int] = {}
    return np.array([known[x] if x in known else known.setdefault(x, xxhash.xxh64_intdigest(x) % LANG_BINS) for x in langs], np.int64)


@dataclass(frozen=True)
class Topics:
    """means: of each bin of languages; centres: of topics, both in whole numbers."""

    means: np.ndarray
    centres: np.ndarray

    def rest(self, vectors: np.ndarray, langs) -> np.ndarray:
        """What sets texts apart from their language."""
        return vectors * FINE - self.means[_lang_bins(langs)]

    def of(self, vectors: np.ndarray, langs) -> np.ndarray:
        """The number of the centre that the text's rest goes with most, the first of equals; -1 for texts without words."""
        if not len(self.centres) or not len(vectors):
            return np.full(len(vectors), -1)
        return np.where(vectors.any(1), (self.rest(vectors, langs) @ self.centres.T).argmax(1), -1)

    def names(self, vectors: np.ndarray, langs) -> np.ndarray:
        return np.array([NO_TOPIC if k < 0 else f"topic_{k}" for k in self.of(vectors, langs)], object)


#: Means have so many steps between whole numbers of a profile.
FINE = 64


def _centred(sums: np.ndarray) -> np.ndarray:
    """Whole numbers again, so that sums have no order."""
    return np.rint(sums * (4096 / np.maximum(np.sqrt((sums.astype(float) ** 2).sum(1, keepdims=True)), 1e-9))).astype(np.int64)


def _summed(profiles: DataFrame, rows: int, of) -> tuple[np.ndarray, np.ndarray]:
    """of(vectors, langs) -> (row, vector) of each text. Sums of the vectors and numbers of texts by row, added up in partitions first: the driver gets rows *
    (WIDTH + 1) numbers at most, and as whole numbers they don't depend on order."""

    def partial(batches):
        sums = np.zeros((rows, WIDTH + 1), np.int64)
        for b in batches:
            k, v = of(_vectors(b["profile"]), b["__mix_lang"])
            np.add.at(sums[:, :WIDTH], k[k >= 0], v[k >= 0])
            sums[:, WIDTH] += np.bincount(k[k >= 0], minlength=rows)
        c, d = np.nonzero(sums)
        yield pd.DataFrame({"c": c, "d": d, "s": sums[c, d]})

    out = np.zeros((rows, WIDTH + 1), np.int64)
    for c, d, s in profiles.select("profile", "__mix_lang").mapInPandas(partial, "c long, d long, s long").groupBy("c", "d").agg(F.sum("s")).collect():
        out[c, d] = s
    return out[:, :WIDTH], out[:, WIDTH]


def fit_topics(profiles: DataFrame, topics: int = TOPICS, steps: int = STEPS) -> Topics:
    """profiles: profile and __mix_lang of each text. The starters are the texts of smallest hash, and of those the centres lie far apart; each step sums all
    texts by their centre."""
    sums, n = _summed(profiles, LANG_BINS, lambda v, langs: (np.where(v.any(1), _lang_bins(langs), -1), v))
    means = np.rint(sums * FINE / np.maximum(n, 1)[:, None]).astype(np.int64)
    model = Topics(means, np.zeros((0, WIDTH), np.int64))
    h = F.xxhash64("profile", "__mix_lang")
    starters = profiles.select("profile", "__mix_lang").distinct().orderBy(h, "profile", "__mix_lang").limit(STARTERS).toPandas()
    unit = _vectors(starters["profile"])
    unit = _centred(model.rest(unit, starters["__mix_lang"])[unit.any(1)])
    if not len(unit):
        return model
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(topics, len(unit)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    model = Topics(means, unit[chosen])
    for _ in range(steps):
        sums, _ = _summed(profiles, len(chosen), lambda v, langs, model=model: (model.of(v, langs), model.rest(v, langs)))
        model = Topics(means, np.where(sums.any(1, keepdims=True), _centred(sums), model.centres))
    return model


def tempered(tokens: Mapping[str, float], power: float) -> dict[str, float]:
    raised = {k: v**power for k, v in tokens.items()}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def reachable(goal: np.ndarray, held: np.ndarray, want: float) -> np.ndarray:
    """Tokens of each value nearest to its goal that can be sampled without taking any twice: the goals times one factor, but no more than there are, so that
    all are want."""
    goal = np.where(held > 0, goal, 0.0)
    order = np.argsort(np.divide(held, goal, out=np.full(len(goal), np.inf), where=goal > 0), kind="stable")
    full = 0.0
    for i, k in enumerate(order):
        rest = goal[order[i:]].sum()
        factor = (want - full) / rest if rest > 0 else 0.0
        if factor * goal[k] <= held[k]:
            return np.minimum(held, np.maximum(factor, 0.0) * goal)
        full += held[k]
    return held.astype(float)


def _goals(held: pd.Series, dim: str, targets: Mapping[str, Mapping[str, float]] | None, budget: float) -> np.ndarray:
    """held: tokens of each value. The targets in tokens; a value without a target keeps one of 0."""
    tokens = held.to_numpy(float)
    goal = np.array([targets[dim].get(v, 0.0) for v in held.index], float) if targets and dim in targets else tokens ** POWER[dim]
    return reachable(goal, tokens, budget * tokens.sum())


def rake(cells: pd.DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> np.ndarray:
    """Expected tokens of each cell: start at budget of what it has, then scale to each target marginal in turn, no cell beyond what it has, until all
    marginals agree with their targets."""
    tokens = cells["tokens"].to_numpy(float)
    w, total = tokens * budget, max(tokens.sum() * budget, 1e-300)
    codes, goals = [], []
    for d in DIMS:
        held = cells.groupby(d, sort=True)["tokens"].sum()
        codes.append(held.index.get_indexer(cells[d]))
        goals.append(_goals(held, d, targets, budget))
    for _ in range(rounds):
        for code, goal in zip(codes, goals):
            now = np.bincount(code, weights=w, minlength=len(goal))
            w = np.minimum(tokens, w * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[code])
        if all(np.abs(np.bincount(c, weights=w, minlength=len(g)) - g).max(initial=0) <= TOLERANCE * total for c, g in zip(codes, goals)):
            break
    return w


def rake_by_spark(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """The same on a table of cells of any size, with w: each step joins the cells with one marginal's factors. A marginal has a row for each value;
    its goals are found on the driver, as are the factors, up to DRIVER_CELLS values."""
    spark = cells.sparkSession
    total = max((cells.agg(F.sum("tokens")).first()[0] or 0) * budget, 1e-300)
    cells = cells.withColumn("w", F.col("tokens") * F.lit(float(budget)))
    goals = {}
    for d in DIMS:
        held = cells.groupBy(d).agg(F.sum("tokens").alias("tokens")).orderBy(d).toPandas().set_index(d)["tokens"]
        rows = pd.DataFrame({"_v": held.index, "goal": _goals(held, d, targets, budget)})
        goals[d] = materialise(spark.createDataFrame(rows, "_v string, goal double"))
    for _ in range(rounds):
        worst = 0.0
        for d in DIMS:
            now = cells.groupBy(F.col(d).alias("_v")).agg(F.sum("w").alias("now")).join(goals[d], "_v")
            factor = now.select("_v", F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("f"))
            cells = cells.join(factor, F.col(d) == F.col("_v")).withColumn("w", F.least(F.col("tokens").cast("double"), F.col("w") * F.col("f"))).drop("_v", "f")
        cells = materialise(cells)
        for d in DIMS:
            gap = cells.groupBy(F.col(d).alias("_v")).agg(F.sum("w").alias("now")).join(goals[d], "_v").agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0]
            worst = max(worst, gap or 0.0)
        if worst <= TOLERANCE * total:
            break
    return cells


def _keys(source_col: str, lang_col: str) -> dict[str, Column]:
    return {"__mix_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "__mix_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit(""))}


def _fit(profiles: DataFrame, targets, budget: float, rounds: int, topics: int) -> tuple[Topics, DataFrame]:
    """profiles: __mix_source, __mix_lang, tokens, profile. Topics, and the cells with weight and probability."""
    model = fit_topics(profiles, topics)
    cells = profiles.groupBy(F.col("__mix_source").alias("source"), F.col("__mix_lang").alias("lang"), _topic_udf(model)("profile", "__mix_lang").alias("topic")).agg(F.sum("tokens").alias("tokens"))
    cells = materialise(cells)
    if cells.count() <= DRIVER_CELLS:
        local = cells.orderBy(*DIMS).toPandas()
        local["w"] = rake(local, targets, budget, rounds)
        raked = profiles.sparkSession.createDataFrame(local, "source string, lang string, topic string, tokens long, w double")
        hint = F.broadcast
    else:
        raked, hint = rake_by_spark(cells, targets, budget, rounds), (lambda df: df)
    total = max(raked.agg(F.sum("w")).first()[0] or 0.0, 1e-300)
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("w") / F.col("tokens"))).otherwise(0.0)
    return model, hint(raked.select(*(F.col(d).alias(f"__mix_{d}") for d in DIMS), (F.col("w") / total).alias("__mix_weight"), F.round(p, 9).alias("__mix_probability")))


def _drawn(rows: DataFrame, cells: DataFrame, id_col: str) -> DataFrame:
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SALT}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return rows.join(cells, [f"__mix_{d}" for d in DIMS]).withColumn("__mix_selected", draw < F.col("__mix_probability"))


def _topic_udf(model: Topics):
    @F.pandas_udf("string")
    def topic(column: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series(model.names(_vectors(column), langs))

    return topic.asNondeterministic()  # it is not; but the filter for nulls that the join with cells infers would work it out a second time


def _text_topic_udf(model: Topics):
    @F.pandas_udf("string")
    def topic(texts: pd.Series, langs: pd.Series) -> pd.Series:
        bins = _Bin()
        vectors = np.array([word_profile(t, bins)[1] for t in texts], np.int64).reshape(-1, WIDTH)
        del bins
        release()
        return pd.Series(model.names(vectors, langs))

    return topic.asNondeterministic()  # as above: texts are read once


def sampled(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, rounds: int = ROUNDS, topics: int = TOPICS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, source, lang, topic, tokens, weight, probability and selected, all but the first prefixed with __mix_.

    Token counts are raked to source, language and topic marginals (targets, else tempered present ones; no value is asked for more
    than it has), and each document is selected with its cell's probability: the md5 of salt and id, read as a number in [0, 1), is
    below it. The choice depends on nothing but the id and the probability, so it is the same in every run and partitioning, and rows
    that repeat an id stay together. Texts are read once; their word profiles (64 bytes) stay in the shared folder and serve topics, cells
    and choice.

    Null source or language is a value of its own, "". Null and empty texts have no tokens, the topic "none" and probability 0. A null id
    counts as the id "". The join is on the cells, broadcast up to DRIVER_CELLS of them. Other columns are ignored. An empty table
    gives no rows.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(n) for n, c in _keys(source_col, lang_col).items()), _profile_udf()(text_of(text_col)).alias("x"))
    rows = materialise(rows.select("doc_id", "__mix_source", "__mix_lang", "x.tokens", "x.profile"))
    model, cells = _fit(rows, targets, budget, rounds, topics)
    keyed = rows.select("doc_id", "__mix_source", "__mix_lang", _topic_udf(model)("profile", "__mix_lang").alias("__mix_topic"), F.col("tokens").alias("__mix_tokens"))
    return _drawn(keyed, cells, "doc_id")


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, rounds: int = ROUNDS, topics: int = TOPICS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The documents that sampled() selects, with the columns of docs alone, whatever their names. Texts are read a second time instead of being
    written with their profiles or joined to them. Nulls, empty texts and repeated rows as there; an empty table gives no rows."""
    bound_batches(docs.sparkSession)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("__mix_id"), *(c.alias(n) for n, c in _keys(source_col, lang_col).items()))
    rows = docs.select(*(c.alias(n) for n, c in _keys(source_col, lang_col).items()), _profile_udf()(text_of(text_col)).alias("x")).select("__mix_source", "__mix_lang", "x.tokens", "x.profile")
    model, cells = _fit(materialise(rows), targets, budget, rounds, topics)
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    keyed = packed.withColumn("__mix_topic", _text_topic_udf(model)(text, "__mix_lang"))
    return _drawn(keyed, cells, "__mix_id").filter("__mix_selected").select("row.*")
