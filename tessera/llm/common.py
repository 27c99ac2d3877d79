"""What several of the training-data operators share: scratch tables, token blocks, key exchange."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes in one block of documents; one Python task holds one block at a time.
BLOCK_BYTES = 8_000_000
#: Up to so many blocks, each exchanges a row with every range of keys; beyond, only with the ranges that it has keys in.
FULL_EXCHANGE = 2048
#: Bytes of rows that the JVM hands to a Python worker at once, at most (one row more, where a row is larger).
BATCH_BYTES = 2_000_000
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset, a local master gets a local one; a cluster has to
    name one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = _local_folder()
    return f"{top.rstrip('/')}/tessera/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors, and gives Spark its real size."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES. The JVM keeps the largest buffers it ever needed, outside its heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if not now or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def sliced(table: pa.Table) -> pa.Table:
    """The same rows in record batches of about BATCH_BYTES; a Python worker sends them to the JVM one by one."""
    return pa.Table.from_batches(table.to_batches(max_chunksize=max(1, table.num_rows * BATCH_BYTES // max(1, table.nbytes))), table.schema)


def text_of(col="text"):
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_of(text_col)).cast("long"))).first()[0] or 0


def in_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, text, block) dealt over blocks by a hash of the id, and the number of blocks; groups of copies spread evenly."""
    bound_batches(docs.sparkSession)
    n = max(1, math.ceil(text_bytes(docs, text_col) / block_bytes))
    key = F.xxhash64(F.col(id_col), F.substring(text_of(text_col), 1, 64), F.length(text_of(text_col)))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.pmod(key, F.lit(n)).cast("long").alias("block")), n


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(texts, extra=()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes other than ASCII white space, A-Z lower-cased) of all texts, and each text's offset.

    extra: hashes put after the words of every text.
    """
    table, parts, sizes = _WordHash(), [], []
    extra = np.array(extra, dtype=np.uint64)
    for text in texts:
        words = text.encode("utf-8").lower().split()  # bytes.lower and bytes.split know ASCII only
        parts.append(np.fromiter(map(table.__getitem__, words), np.uint64, len(words)))
        if len(extra):
            parts.append(extra)
        sizes.append(len(words) + len(extra))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, vectorised."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chain(*parts: np.ndarray) -> np.ndarray:
    """One hash of several columns of hashes; their order counts."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + p)
    return out


def planes(a: np.ndarray) -> bytes:
    """Bytes of the integers, plane by plane: leading zeros lie together, so that Spark's own compression removes them."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, len(b) // width).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, np.uint64), dtype=np.uint64)


def release() -> None:
    """Give memory that a block has used back to the machine; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in 4 bytes each, or 8 where one needs them; the first byte tells."""
    dtype = np.uint32 if not len(counts) or counts.max() <= 0xFFFFFFFF else np.uint64
    return bytes([np.dtype(dtype).itemsize]) + planes(counts.astype(dtype))


def unpack_counts(b: bytes) -> np.ndarray:
    return unplanes(b[1:], {4: np.uint32, 8: np.uint64}[b[0]])


KEYS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("counts", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64()), ("once", pa.int64())])
_TYPES = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_TYPES[f.type]}" for f in schema)


def key_rows(block: int, kinds: list[tuple[np.ndarray, np.ndarray]], bits: int, empty: bool = True) -> pa.Table:
    """One row for each bucket and kind: the block's sorted distinct keys with their counts; a bucket is a range of keys.

    empty: also for buckets where the block has no key.
    """
    rows = []
    for kind, (keys, counts) in enumerate(kinds):
        of = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
        buckets = np.arange(2**bits, dtype=np.uint64) if empty else np.unique(of)
        starts, ends = (np.searchsorted(of, buckets, side) for side in ("left", "right"))
        for b, i, j in zip(buckets.tolist(), starts, ends):
            rows.append((block, b, kind, pack_sorted(keys[i:j]), pack_counts(counts[i:j])))
    return sliced(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(KEYS), KEYS)], schema=KEYS))


def _merge(table: pa.Table) -> pa.Table:
    """All blocks' rows of one bucket and kind: sum the counts by key, and answer each block for its own keys."""
    keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
    counts = [unpack_counts(x) for x in table["counts"].to_pylist()]
    all_keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate(counts), minlength=len(all_keys)).astype(np.int64)
    stats = (int(sums.sum()), int((sums > 0).sum()), int((sums == 1).sum()))
    ends = np.cumsum([len(k) for k in keys])
    out = [pack_counts(sums[at[e - len(k) : e]]) for k, e in zip(keys, ends)]
    n = len(keys)
    return sliced(pa.Table.from_arrays([table["block"].combine_chunks(), table["bucket"].combine_chunks(), table["kind"].combine_chunks(), pa.array(out, pa.binary()), *(pa.array([x] * n, pa.int64()) for x in stats)], schema=ANSWERS))


def bucket_bits(blocks: int) -> int:
    """Twice as many buckets as blocks, so that a bucket's keys take no more room however large the input is."""
    return min(30, max(0, math.ceil(math.log2(blocks)) + 1))


def sent_keys(block: int, kinds: list[tuple[np.ndarray, np.ndarray]], n_blocks: int, full: int = FULL_EXCHANGE) -> pa.Table:
    """What a block of n_blocks sends to count_keys, with the same full: its kinds of (sorted distinct keys, counts)."""
    return key_rows(block, kinds, bucket_bits(n_blocks), n_blocks <= full)


def count_keys(sent: DataFrame, n_blocks: int, full: int = FULL_EXCHANGE) -> tuple[DataFrame, dict | None]:
    """sent: all blocks' rows from sent_keys. Returns, for each block, the counts of its keys over all blocks: (block, bucket, kind,
    counts), with the kind's sums in that bucket: total, distinct, once.

    Keys travel once, packed by block and range; a key's holders are merged in the task of its range, so that a frequent key costs
    one entry a block, however many rows have it.

    Up to full blocks, each block has a row in each bucket and adds the sums up by itself; the second value is None. Beyond, where that
    would be a square of blocks, it has rows only where it has keys, and the second value holds the sums over all buckets:
    kind -> (total, distinct, once).
    """
    answers = sent.groupBy("bucket", "kind").applyInArrow(_merge, ddl(ANSWERS))
    if n_blocks <= full:
        return answers, None
    answers = materialise(answers)
    stats = ("total", "distinct", "once")
    ranges = answers.groupBy("kind", "bucket").agg(*(F.first(c).alias(c) for c in stats))
    sums = ranges.groupBy("kind").agg(*(F.sum(c).alias(c) for c in stats)).collect()  # a row for each kind
    return answers, {r["kind"]: tuple(r[c] for c in stats) for r in sums}


def answers_by_kind(table: pa.Table, kinds: int, sums: dict | None = None) -> list[tuple[np.ndarray, int, int, int]]:
    """For each kind: counts in the order of the block's keys, and total, distinct, once over all buckets (sums, where given)."""
    found: list[list] = [[] for _ in range(kinds)]
    for r in sorted(table.select(["kind", "bucket", "counts", "total", "distinct", "once"]).to_pylist(), key=lambda r: (r["kind"], r["bucket"])):
        found[r["kind"]].append(r)
    out = []
    for kind, rs in enumerate(found):
        counts = np.concatenate([unpack_counts(r["counts"]) for r in rs]) if rs else np.empty(0, np.uint32)
        stats = tuple(sum(r[c] for r in rs) for c in ("total", "distinct", "once")) if sums is None else sums.get(kind, (0, 0, 0))
        out.append((counts, *stats))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node reachable.

    Each round points every node at its smallest neighbour, jumps pointers, and contracts the edges; all of it is aggregates with
    partial sums and equi-joins, which AQE splits where a node has very many edges.
    """
    e = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    mapping = materialise(nodes.withColumn("component", F.col("node")))
    e = e.filter("a <> b")
    while not e.isEmpty():
        up = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        up = materialise(up)
        hop = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
        for _ in range(2):
            up = up.join(hop, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        up = materialise(up)
        of = lambda c: up.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        mapping = materialise(mapping.join(of("component"), "component", "left").select("node", F.coalesce("component_to", "component").alias("component")))
        e = e.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y"))
        e = materialise(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct())
    return mapping
