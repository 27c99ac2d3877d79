"""Exact deduplication: a tree merge of sorted digest runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

KEY = ("digest", "check", "size")
#: Entries of a run that one row holds, about; 100 bytes each.
BLOCK = 8192


def _bits(rows: float, block: int) -> int:
    """So many leading bits of a digest cut a run of so many rows into blocks."""
    return max(0, math.ceil(math.log2(max(1.0, rows / block))))


def _range(digest: Column, bits: int) -> Column:
    return F.shiftright(F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long"), 56 - bits)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(entries: Column, keep: str) -> Column:
    """Sorted entries with neighbours of one key made one: the kept id is the smallest or largest, n the sum."""
    best = {"smallest": F.array_min, "largest": F.array_max}[keep]

    def one(group: Column) -> Column:
        head = F.get(group, F.lit(0))
        ids, n = best(F.transform(group, lambda x: x["keep_id"])), F.aggregate(group, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
        return F.struct(*(head[k].alias(k) for k in KEY), ids.alias("keep_id"), n.alias("n"))

    def run(e: Column) -> Column:
        differ = lambda i: ~F.struct(*(F.get(e, i)[k] for k in KEY)).eqNullSafe(F.struct(*(F.get(e, i - 1)[k] for k in KEY)))
        starts = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | differ(i))
        return _let(starts, lambda at: F.transform(at, lambda s, k: one(F.slice(e, s + 1, F.coalesce(F.get(at, k + 1), F.size(e)) - s))))

    return _let(entries, run)


def exact_dedup(docs: DataFrame, keep: str = "smallest", fan_in: int = 8, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are dealt evenly to fan_in ** levels runs, as many as shuffle partitions at least. A run is its rows' digests, sorted, each with the
    id to keep and a count; it is stored in blocks, rows with an array for each range of digests. In round k, the runs whose number is a
    multiple of fan_in ** (k + 1) take in those of the fan_in - 1 next multiples of fan_in ** k: a binomial tree, of order fan_in. The
    blocks of one range meet in one row, are merged, one kept id stays for each digest, and the block is cut anew as the run has grown,
    so that blocks have about the same size at every level. The merge sorts the blocks laid end to end; the JVM's sort of objects finds
    the sorted runs in them and merges those. No digest has more than fan_in entries in a merge, so a text that fills a third of the
    table is never in one place. A digest counts as verified when SHA-256, a second 64-bit hash and the length all agree.

    The last run holds the verdicts. They go to the leaves, where a digest has an entry in each run at most, and from there to the rows, by run
    and digest, so that a frequent text's rows stay spread.

    keep: "smallest" or "largest" id stays. Null text is the empty text, and empty texts are equal. Rows that repeat both id and text
    count in group_size, and are all marked alike. A null id never stays unless its text has no other. An empty table gives no rows;
    other columns are ignored. Only DataFrame functions run here.
    """
    spark = docs.sparkSession
    best = {"smallest": F.min, "largest": F.max}[keep]
    levels, want = 1, int(spark.conf.get("spark.sql.shuffle.partitions"))
    while fan_in**levels < want:
        levels += 1
    text = text_of(text_col)
    # written once, so the number that deals a row to its run stays
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(fan_in**levels)).alias("run"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.xxhash64(text).alias("check"),
            F.octet_length(text).alias("size"),
        )
    )
    total = rows.count()
    bits = [_bits(total / fan_in ** (levels - k), block) for k in range(levels + 1)]
    entry = F.struct(*KEY, "keep_id", "n")
    leaves = rows.groupBy("run", *KEY).agg(best("doc_id").alias("keep_id"), F.count("*").alias("n")).withColumn("range", _range(F.col("digest"), bits[0]))
    first = materialise(leaves.groupBy("run", "range").agg(F.sort_array(F.collect_list(entry)).alias("entries")))
    runs = first
    for k in range(levels):
        met = runs.groupBy(F.floor(F.col("run") / fan_in).alias("run"), "range").agg(F.flatten(F.collect_list("entries")).alias("entries"))
        merged = met.select("run", "range", collapse(F.sort_array("entries"), keep).alias("entries"))
        finer = bits[k + 1] - bits[k]
        if finer:
            here = F.transform(F.sequence(F.lit(0), F.lit(2**finer - 1)), lambda j: F.struct(
                (F.col("range") * 2**finer + j).alias("range"),
                F.filter("entries", lambda x: _range(x["digest"], bits[k + 1]) == F.col("range") * 2**finer + j).alias("entries"),  # noqa: B023
            ))
            merged = merged.select("run", F.explode(here).alias("b")).select("run", "b.range", "b.entries").filter(F.size("entries") > 0)
        runs = materialise(merged)
    verdict = runs.select(F.explode("entries").alias("e")).select(*(F.col(f"e.{k}").alias(k) for k in KEY), "e.keep_id", "e.n")
    own = first.select("run", F.explode("entries").alias("e")).select("run", *(F.col(f"e.{k}").alias(k) for k in KEY)).join(verdict, list(KEY))
    return rows.join(own, ["run", *KEY]).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
