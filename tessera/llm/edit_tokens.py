"""Token counts that follow edits: a segment tree over each document's pre-token segments."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokenizer import VOCABULARY, encoder, read_vocabulary

#: Characters after which a segment ends at the next safe place.
SEGMENT = 400
#: A place that no pre-token spans: between a letter or digit and a space before a letter.
SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W\d_])")


def cut(text: str, size: int = SEGMENT) -> list[str]:
    """The text in segments whose token counts add up to the text's; each begins at a safe place."""
    out, at = [], 0
    while at < len(text):
        m = SAFE.search(text, at + size)
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out or [""]


class SegmentTree:
    """Segments of one text as leaves; inner nodes hold the sums of characters and tokens below."""

    def __init__(self, segments: list[str], counts: list[int], count):
        self.count, self.encoded = count, 0
        self.segments = list(segments)
        self.n = max(1, len(self.segments))
        self.chars = [0] * self.n + [len(s) for s in self.segments]
        self.tokens = [0] * self.n + list(counts)
        for i in range(self.n - 1, 0, -1):
            self._sum(i)

    @classmethod
    def of(cls, text: str, count) -> SegmentTree:
        segments = cut(text)
        return cls(segments, [count(s) for s in segments], count)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def total(self) -> int:
        return sum(self.tokens[self.n :]) if self.n == 1 else self.tokens[1]

    def length(self) -> int:
        return self.chars[self.n] if self.n == 1 else self.chars[1]

    def before(self, leaf: int) -> int:
        """Characters in front of a leaf, from the sums on its path."""
        left, right, out = self.n, self.n + leaf, 0
        while left < right:
            if left & 1:
                out += self.chars[left]
                left += 1
            if right & 1:
                right -= 1
                out += self.chars[right]
            left, right = left >> 1, right >> 1
        return out

    def leaf_at(self, at: int) -> int:
        """The first leaf whose end is at or behind a character position."""
        low, high = 0, len(self.segments) - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.before(mid + 1) >= at else (mid + 1, high)
        return low

    def _put(self, leaf: int, text: str) -> None:
        self.segments[leaf] = text
        i = self.n + leaf
        self.chars[i], self.tokens[i] = len(text), self.count(text) if text else 0
        self.encoded += bool(text)
        while i > 1:
            i >>= 1
            self._sum(i) if i else None

    def edit(self, at: int, drop: int, insert: str) -> None:
        """Replace drop characters at a position by insert. Positions beyond the end are taken as the end.

        Leaves that the edit touches and one more on either side, for pre-tokens that now cross their borders, are joined, cut anew and
        encoded again; every other leaf keeps its count. Pieces beyond the leaves at hand stay joined in the last of them, and leaves
        left over are empty, so that only sums on their paths change; once a leaf is far too long the tree is rebuilt from known counts.
        """
        length = self.length()
        at = min(max(at, 0), length)
        drop = min(max(drop, 0), length - at)
        first = max(0, self.leaf_at(at) - 1)
        last = min(len(self.segments) - 1, self.leaf_at(at + drop) + 1)
        while first and not self.segments[first]:
            first -= 1
        while last < len(self.segments) - 1 and not self.segments[last]:
            last += 1
        start = self.before(first)
        region = "".join(self.segments[first : last + 1])
        region = region[: at - start] + insert + region[at - start + drop :]
        pieces, room = cut(region), last - first + 1
        if len(pieces) > room + 8:
            counts = [self.count(p) for p in pieces]
            self.encoded += len(pieces)
            known = self.tokens[self.n :]
            encoded = self.encoded
            self.__init__([*self.segments[:first], *pieces, *self.segments[last + 1 :]], [*known[:first], *counts, *known[last + 1 :]], self.count)
            self.encoded = encoded
            return
        pieces = [*pieces[: room - 1], "".join(pieces[room - 1 :])] if len(pieces) > room else pieces + [""] * (room - len(pieces))
        for k, p in enumerate(pieces):
            if p != self.segments[first + k]:
                self._put(first + k, p)

    def text(self) -> str:
        return "".join(self.segments)


TREES = "text string, lengths array<int>, counts array<int>"


def build_trees(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, text, lengths and counts (characters and tokens of each leaf), and the columns in keep.

    The inner sums follow from the leaves in one pass without encoding, so leaves are what is stored.
    """
    words = read_vocabulary(vocabulary)

    def build(batches):
        encode = encoder(words).encode_ordinary
        for b in batches:
            leaves = [cut(t) for t in b["text"].to_pylist()]
            lengths = pa.array([[len(s) for s in x] for x in leaves], pa.list_(pa.int32()))
            counts = pa.array([[len(encode(s)) for s in x] for x in leaves], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lengths, counts], names=[*b.schema.names, "lengths", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(build, f"{fields}, lengths array<int>, counts array<int>")


def apply_edits(trees: DataFrame, edits_col: str = "edits", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of trees: doc_id, text, lengths, counts after the edits, and tokens_before, tokens_after, segments (leaves before),
    reencoded (leaves encoded again).

    edits: array of (at, drop, insert), applied in order, each position in the text as the edits before left it. Counts equal those
    of encoding the edited text as a whole, because leaves meet at places that no pre-token spans. Null edits, null members and null
    inserts change nothing or insert nothing. Null and empty texts have one empty leaf. Repeated rows and null ids are rows like others.
    """
    words = read_vocabulary(vocabulary)

    def change(batches):
        encode = encoder(words).encode_ordinary
        count = lambda s: len(encode(s))
        for b in batches:
            out = []
            for text, lengths, counts, edits in zip(*(b[c].to_pylist() for c in ("text", "lengths", "counts", edits_col))):
                at, segments = 0, []
                for n in lengths:
                    segments.append(text[at : at + n])
                    at += n
                tree = SegmentTree(segments, counts, count)
                for e in edits or ():
                    if e is not None and e["at"] is not None:
                        tree.edit(e["at"], e["drop"] or 0, e["insert"] or "")
                out.append((tree.text(), [len(s) for s in tree.segments], tree.tokens[tree.n :], sum(counts), tree.total(), len(lengths), tree.encoded))
            ints = pa.list_(pa.int32())
            types = (pa.string(), ints, ints, *[pa.int64()] * 4)
            cols = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "text", "lengths", "counts", "tokens_before", "tokens_after", "segments", "reencoded"])

    rows = trees.select("doc_id", "text", "lengths", "counts", edits_col)
    return rows.mapInArrow(change, f"doc_id long, {TREES}, tokens_before long, tokens_after long, segments long, reencoded long")


def scripted_edits(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Three edits of each document, placed by its id: a replaced word, an inserted phrase across a border, a deletion."""
    n = F.length(text_of(text_col))
    place = lambda salt: F.when(n > 0, F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), n)).otherwise(0).cast("int")
    edit = lambda salt, drop, insert: F.struct(place(salt).alias("at"), F.lit(drop).alias("drop"), F.lit(insert).alias("insert"))
    return F.array(edit(1, 5, "edited"), edit(2, 0, " a phrase of 7 new words, don't split it "), edit(3, 9, ""))
