"""Quality classifier: random Fourier features, ridge regression from partition sums, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

#: Statistics of a whole text; none knows its label, language, source or id.
STATS = "log_words word_length letters upper digits symbols hashes pipes bangs lines distinct repeats longest_run twin_lines short_words stops".split()
FOURIER = 160
FOLDS = 4
#: Sums of partitions that one task of a round adds up, and a fold's sums that reach the driver; 250 kB each at most.
BRANCH = 32
RIDGE = 1.0
SEED = 20_240_501


def statistics(text: str) -> list[float]:
    """STATS of one text; an empty one gives zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    raw = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=8)
    size = max(1, int(raw[1:].sum()))
    same = list(map(eq, words, words[1:]))
    run = best = 0
    if any(same):
        for s in same:
            run = run + 1 if s else 0
            best = max(best, run)
    lines = text.split("\n")
    return [
        np.log1p(n), min(size / n, 30) / 10, (raw[1] + raw[2]) / size, raw[2] / size, raw[3] / size, (raw[4] + raw[5] + raw[6]) / size,
        min(3.0, raw[4] / n), min(3.0, raw[5] / n), min(3.0, raw[6] / n), min(1.0, len(lines) / n), len(set(words)) / n, sum(same) / n,
        np.log1p(best), 1 - len(set(lines)) / len(lines), sum(len(w) < 4 for w in words) / n, min(2.0, raw[7] / n),
    ]


def _classes() -> np.ndarray:
    """Byte -> 0 white space, 1 small letter or part of one, 2 capital, 3 digit, 4 of #$%&*, 5 bar, 6 exclamation mark, 7 other."""
    out = np.full(256, 7, np.uint8)
    for chars, k in (("#$%&*", 4), ("|", 5), ("!", 6), ("0123456789", 3), (" \t\n\r\v\f", 0)):
        out[[ord(c) for c in chars]] = k
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("a") : ord("z") + 1] = 1
    out[128:] = 1
    return out


_CLASS = _classes()


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Bias, standardised statistics, and cosines whose inner products approximate a Gaussian kernel."""
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(z)), z, np.sqrt(2 / len(self.phase)) * np.cos(z @ self.freq + self.phase)])

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        return np.interp(raw, *self.knots)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by x; returns knots (centre of each pool, its mean)."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], top)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats binary of float32) for every row; one pass over the texts."""

    def stats(batches):
        for b in batches:
            rows = [np.array(statistics(t), np.float32).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(rows, pa.binary())], names=["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(stats, "doc_id long, stats binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, len(STATS)).astype(np.float64)


def _sums(parts) -> np.ndarray:
    return np.sum([np.frombuffer(p) for p in parts], axis=0)


def _tree_sum(rated: DataFrame, of, branch: int = BRANCH) -> dict[int, np.ndarray]:
    """of(stats, y) -> vector. Sum it by fold: once in each partition, then in rounds that make one of at most `branch` sums each, until `branch` rows
    of a fold are left, which the driver adds up."""

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for fold, g in b.groupby("fold"):
                v = of(_matrix(g["stats"]), g["y"].to_numpy(float))
                sums[fold] = sums[fold] + v if fold in sums else v
        if sums:
            yield pd.DataFrame({"fold": list(sums), "part": TaskContext.get().partitionId(), "v": [v.tobytes() for v in sums.values()]})

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": g["fold"].iloc[:1], "part": g["part"].iloc[:1] // branch, "v": [_sums(g["v"]).tobytes()]})

    parts = materialise(rated.mapInPandas(partial, "fold int, part long, v binary"))
    last = parts.agg(F.max("part")).first()[0] or 0
    while last >= branch:
        parts = materialise(parts.groupBy("fold", F.floor(F.col("part") / branch)).applyInPandas(merge, "fold int, part long, v binary"))
        last //= branch
    out: dict[int, list[bytes]] = {}
    for r in parts.orderBy("fold", "part").collect():
        out.setdefault(r["fold"], []).append(bytes(r["v"]))
    return {k: _sums(v) for k, v in out.items()}


def fit(rated: DataFrame, fourier: int = FOURIER, ridge: float = RIDGE) -> Model:
    """rated: stats, y (0/1), fold. All rated rows count; nothing of them but sums reaches the driver.

    Ridge weights come from the summed normal equations. Leaving out one fold's sums gives weights for that fold's out-of-fold scores;
    those, in bins of a thousandth, are what isotonic regression calibrates on.
    """
    width = len(STATS)
    moments = _tree_sum(rated, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    total = sum(moments.values()) if moments else np.zeros(1 + 2 * width)
    n = max(total[0], 1)
    mean = total[1 : 1 + width] / n
    scale = np.sqrt(np.maximum(total[1 + width :] / n - mean**2, 1e-6))
    rng = np.random.default_rng(SEED)
    model = Model(mean, scale, rng.normal(0, 1 / np.sqrt(width), (width, fourier)), rng.uniform(0, 2 * np.pi, fourier))
    d = 1 + width + fourier

    def equations(stats, y):
        x = model.features(stats)
        return np.concatenate([(x.T @ x).ravel(), x.T @ y])

    sums = _tree_sum(rated, equations)
    whole = sum(sums.values()) if sums else np.zeros(d * d + d)
    solve = lambda v: np.linalg.solve(v[: d * d].reshape(d, d) + ridge * np.eye(d), v[d * d :])
    model.weights = solve(whole)
    held = {f: solve(whole - v) for f, v in sums.items()}

    def out_of_fold(batches):
        for b in batches:
            for fold, g in b.groupby("fold"):
                raw = model.features(_matrix(g["stats"])) @ held[fold]
                yield pd.DataFrame({"bin": np.round(np.clip(raw, -1, 2) * 1000).astype(int), "y": g["y"].to_numpy(float)})

    bins = rated.mapInPandas(out_of_fold, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    if len(bins):
        prior = float((bins.y * bins.n).sum() / bins.n.sum())
        # a pool's mean is drawn towards the prior by one observation, which keeps scores inside (0, 1)
        x, y = isotonic(bins.bin.to_numpy() / 1000, ((bins.y * bins.n + 0.02 * prior) / (bins.n + 0.02)).to_numpy(), bins.n.to_numpy(float))
        model.knots = (x, np.clip(y, 0.001, 0.999))
    else:
        model.knots = (np.array([0.0]), np.array([0.5]))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, cut: float = 0.3, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= cut).

    Labels are learned only from rows whose crc32(doc_id as text) mod folds is not fold; held_out marks the others. Texts are read
    whole and once; their statistics are kept in the shared folder and serve both training and scoring.

    Null and empty texts have zero statistics and get the score those give. A document with several labels counts with each; null labels
    do not count. A null id is scored, and held_out is false. Without any label every score is 0.5. Repeated rows give repeated
    rows; other columns are ignored; an empty table gives no rows.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    stats = materialise(document_stats(docs, id_col, text_col).withColumn("held_out", F.coalesce(remainder == fold, F.lit(False))))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).dropna()
    rated = stats.filter(~F.col("held_out")).join(known, "doc_id").select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    model = fit(materialise(rated))

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(column)))

    scored = stats.select("doc_id", "held_out", score("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
