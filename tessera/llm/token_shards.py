"""Token-ID output in training order: keyed Feistel slots and fixed-stride shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, materialise, mix, release, text_of
from .tokenizer import END_OF_TEXT, VOCABULARY, encoder, read_vocabulary

SEQUENCE = 512
SHARD_SLOTS = 256
#: Documents whose ids a task holds at once.
AT_ONCE = 256
ROUNDS = 6
#: A range of shards, which becomes one file, has about so many bytes at most, where that takes more ranges than shuffle partitions.
RANGE_BYTES = 256_000_000
#: A record's head; the ids follow, padded with the end-of-text id.
HEAD = np.dtype([("doc_id", "<i8"), ("sequence", "<i4"), ("tokens", "<i4")])


def record_type(sequence: int = SEQUENCE) -> np.dtype:
    return np.dtype([*((n, HEAD[n]) for n in HEAD.names), ("ids", "<u2", (sequence,))])


class Feistel:
    """A keyed permutation of range(n): a balanced Feistel network on the next even number of bits, walked until it falls below n."""

    def __init__(self, n: int, key: str):
        self.n, self.half = n, np.uint64(max(1, -(-max(1, n - 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(ROUNDS)]

    def _walk(self, x: np.ndarray, once) -> np.ndarray:
        x = once(x.astype(np.uint64))
        while (out := x >= self.n).any():
            x[out] = once(x[out])
        return x.astype(np.int64)

    def _forward(self, x):
        left, right = x >> self.half, x & self.mask
        for k in self.keys:
            left, right = right, left ^ (mix(right + k) & self.mask)
        return (left << self.half) | right

    def _backward(self, x):
        left, right = x >> self.half, x & self.mask
        for k in reversed(self.keys):
            left, right = right ^ (mix(left + k) & self.mask), left
        return (left << self.half) | right

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(np.asarray(index), self._forward)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(np.asarray(slot), self._backward)


def sequences(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, place, doc_id, sequence, tokens, ids) of all documents: each whole text and an end-of-text id, cut every `sequence` ids.

    place counts the rows of a part, so that (part, place) becomes a global index once the parts' sizes are known.
    """
    words = read_vocabulary(vocabulary)
    cut = sequence * 2
    schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("sequence", pa.int32()), ("tokens", pa.int32()), ("ids", pa.binary())])

    def encode(batches):
        encode_one, part, place = encoder(words).encode_ordinary, TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in (whole.slice(i, AT_ONCE) for i in range(0, whole.num_rows, AT_ONCE)):
                ids, seqs, pieces = [], [], []
                for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                    raw = np.array([*encode_one(t), END_OF_TEXT], "<u2").tobytes()
                    for s, at in enumerate(range(0, len(raw), cut)):
                        ids.append(i), seqs.append(s), pieces.append(raw[at : at + cut])
                n = len(ids)
                cols = ([part] * n, range(place, place + n), ids, seqs, [len(p) // 2 for p in pieces], pieces)
                place += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
            release()
        del encode_one
        release()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(encode, "part int, place long, doc_id long, sequence int, tokens int, ids binary")


def shards(docs: DataFrame, key: str = "epoch-0", sequence: int = SEQUENCE, shard_slots: int = SHARD_SLOTS, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard: shard, first_slot, slots, stride (bytes), tokens, checksum (SHA-256), payload.

    payload is `slots` records of `stride` bytes: doc_id int64, sequence int32, tokens int32, then the ids as uint16, padded with the
    end-of-text id. Global slot s is record s % shard_slots of shard s // shard_slots, so a reader resumes from a slot number alone. A slot
    is the keyed Feistel permutation of the sequence's index; another key gives another order from the same tokens.

    Texts are tokenised once, into the shared folder; a lost executor repeats its tasks without changing what others wrote. Then one shuffle
    brings each range of slots to the partition of its number; slots are uniform, so ranges are even whatever the sources' sizes. A
    partition packs its shards in order, one at a time, and is written as one file: files in the order of their names hold the slots in
    theirs, and a reader skips files by the bounds of shard in them. A sequence's index is its place among the rows that the tokenising
    tasks wrote, so another cut of the input into files gives another, equally random, order.

    Null and empty texts are one sequence of the end-of-text id. A null id is written as -1. Repeated rows are sequences of their own.
    An empty table gives no shard; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = materialise(sequences(docs, sequence, vocabulary, id_col, text_col))
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a task
    order = sorted(sizes)
    total = sum(sizes.values())
    base = np.zeros(max(order, default=0) + 1, np.int64)
    base[order] = np.concatenate([[0], np.cumsum([sizes[p] for p in order])[:-1]]) if order else 0
    permutation = Feistel(total, key)
    record = record_type(sequence)

    @F.pandas_udf("long")
    def slot(part: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(permutation.slot(base[part.to_numpy()] + place.to_numpy()))

    def packed(table: pa.Table) -> pa.RecordBatch:
        out = np.zeros(table.num_rows, record)
        out["doc_id"] = table["doc_id"].fill_null(-1).to_numpy()
        out["sequence"], out["tokens"] = table["sequence"].to_numpy(), table["tokens"].to_numpy()
        out["ids"] = END_OF_TEXT
        for r, b in enumerate(table["ids"].to_pylist()):
            out["ids"][r, : len(b) // 2] = np.frombuffer(b, "<u2")
        payload, first = out.tobytes(), table["slot"][0].as_py()
        one = {"shard": first // shard_slots, "first_slot": first, "slots": len(out), "stride": record.itemsize, "tokens": int(out["tokens"].sum()), "checksum": hashlib.sha256(payload).hexdigest(), "payload": payload}
        return pa.RecordBatch.from_pydict({k: [v] for k, v in one.items()})

    def pack(batches):
        """Rows come in the order of their slots; a shard leaves as soon as the next one begins."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            shard = b["slot"].to_numpy() // shard_slots
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                if held and z > a and held[0]["slot"][0].as_py() // shard_slots != shard[a]:
                    yield packed(pa.Table.from_batches(held))
                    held = []
                if z > a:
                    held.append(b.slice(a, z - a))
        if held:
            yield packed(pa.Table.from_batches(held))
        release()

    shards_ = -(-total // shard_slots)
    parts = max(1, min(shards_, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * record.itemsize // RANGE_BYTES)))
    placed = rows.select(slot("part", "place").alias("slot"), "doc_id", "sequence", "tokens", "ids")
    ranges = F.floor(F.floor(F.col("slot") / shard_slots) * parts / max(1, shards_)).cast("int")
    placed = placed.withColumn("range", ranges).repartitionById(parts, F.col("range")).drop("range").sortWithinPartitions("slot")
    return placed.mapInArrow(pack, "shard long, first_slot long, slots long, stride long, tokens long, checksum string, payload binary")


def read_slots(spark: SparkSession, path: str, first: int, count: int, shard_slots: int = SHARD_SLOTS, sequence: int = SEQUENCE):
    """Records of slots first .. first + count - 1 from a table written from shards(); only files whose
    bounds of shard meet them are read."""
    record = record_type(sequence)
    wanted = spark.read.parquet(path).filter(F.col("shard").between(first // shard_slots, (first + count - 1) // shard_slots)).select("first_slot", "payload").orderBy("first_slot")
    for r in wanted.toLocalIterator():
        records = np.frombuffer(r["payload"], record)
        yield from records[max(0, first - r["first_slot"]) : max(0, first + count - r["first_slot"])]
