"""Language-model scoring with a weighted backoff automaton."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FULL_EXCHANGE, KEYS, answers_by_kind, chain, count_keys, ddl, in_blocks, materialise, pack_sorted, planes, release, sent_keys, tidy, unpack_sorted, unplanes, word_hashes

END, START = 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def held_out_of(doc_ids, folds: int, fold: int) -> np.ndarray:
    """Whether crc32 of the id as text leaves the remainder fold. A null id is never held out."""
    return np.array([i is not None and zlib.crc32(str(i).encode()) % folds == fold for i in doc_ids], bool)


#: A pair is a state, and the trigrams that begin with it are counted, if it occurs so often in training.
SUPPORT = 4
#: Tokens of a text that the traversal takes in a row; longer texts go in slices, side by side.
SLICE = 256


#: A block as one row: its texts' ids, its sorted distinct words (START among them), its tokens as numbers of words, and where texts begin.
PACKED = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("words", pa.binary()), ("ids", pa.binary()), ("at", pa.binary())])


def pack_block(table: pa.Table) -> pa.Table:
    flat, at = word_hashes(table["text"].to_pylist(), [END])
    words, ids = np.unique(np.concatenate([flat, np.array([START], np.uint64)]), return_inverse=True)
    one = (table["block"][0].as_py(), table["doc_id"].to_pylist(), pack_sorted(words), planes(ids[:-1].astype(np.uint32)), planes(at))
    return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(one, PACKED)], schema=PACKED)


class Block:
    """One row of PACKED, with pairs of neighbours as before * width + word, sorted and distinct."""

    def __init__(self, row: dict, folds: int, fold: int):
        self.number, self.doc_ids = row["block"], row["doc_ids"]
        self.words, self.at = unpack_sorted(row["words"]), unplanes(row["at"], np.int64)
        self.ids = unplanes(row["ids"], np.uint32).astype(np.int64)
        self.held_out = held_out_of(self.doc_ids, folds, fold)
        self.train = np.repeat(~self.held_out, np.diff(self.at))
        self.width, self.start = len(self.words), int(np.searchsorted(self.words, np.uint64(START)))
        before = np.concatenate([[self.start], self.ids[:-1]]).astype(np.int64)
        before[self.at[:-1]] = self.start
        self.pairs, self.pair_ids = np.unique(before * self.width + self.ids, return_inverse=True)
        self.hashes = chain(self.words[self.pairs // self.width], self.words[self.pairs % self.width])
        self.order = np.argsort(self.hashes, kind="stable")
        self.plain = np.flatnonzero(np.arange(self.width) != self.start)

    def first(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Kinds of the first exchange: words, pairs, and the texts begun."""
        counts = np.bincount(self.ids, weights=self.train, minlength=self.width).astype(np.int64)
        pair_counts = np.bincount(self.pair_ids, weights=self.train, minlength=len(self.pairs)).astype(np.int64)
        return [(self.words[self.plain], counts[self.plain]), (self.hashes[self.order], pair_counts[self.order]), (np.array([START], np.uint64), np.array([(~self.held_out).sum()], np.int64))]

    def learn(self, answers: pa.Table, sums: dict | None) -> None:
        """Corpus counts of the first exchange, and the trigrams that are worth counting: pair * width + word, sorted and distinct."""
        (counts, self.total, self.distinct, self.once), (pair_counts, _, self.distinct_pairs, _), (begun, *_) = answers_by_kind(answers, 3, sums)
        self.counts = np.zeros(self.width, np.int64)
        self.counts[self.plain] = counts.astype(np.int64)
        self.context = self.counts.copy()
        self.context[self.start] = begun.astype(np.int64).sum()
        self.pair_counts = np.empty(len(self.pairs), np.int64)
        self.pair_counts[self.order] = pair_counts
        inner = np.ones(len(self.ids), bool)
        inner[self.at[:-1]] = False  # a text's first token has no pair before it
        self.places = np.flatnonzero(inner[1:] & (self.pair_counts >= SUPPORT)[self.pair_ids[:-1]]) + 1
        self.triples, self.triple_ids = np.unique(self.pair_ids[self.places - 1] * self.width + self.ids[self.places], return_inverse=True)
        pair = self.pairs[self.triples // self.width]
        self.triple_hashes = chain(self.words[pair // self.width], self.words[pair % self.width], self.words[self.triples % self.width])
        self.triple_order = np.argsort(self.triple_hashes, kind="stable")

    def second(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The kind of the second exchange: trigrams."""
        counts = np.bincount(self.triple_ids, weights=self.train[self.places], minlength=len(self.triples)).astype(np.int64)
        return [(self.triple_hashes[self.triple_order], counts[self.triple_order])]

    def learn_more(self, answers: pa.Table, sums: dict | None) -> None:
        ((counts, _, self.distinct_triples, _),) = answers_by_kind(answers, 1, sums)
        self.triple_counts = np.empty(len(self.triples), np.int64)
        self.triple_counts[self.triple_order] = counts


class Automaton:
    """The backoff automaton over the n-grams of one block of documents.

    States are contexts: the empty one (0), each known word w (1 + w), and each pair seen SUPPORT times. A state's arc for a word
    carries the log10 probability of a seen n-gram, and leads to the longest context that the text now ends in. Where a state has no arc
    for a word, its failure arc leads, with the log10 backoff weight, to the context without its first word: from a pair to a word, from a
    word to the empty context, which has an arc for every word. Smoothing adds kappa observations of the shorter context's distribution
    to each context: P(w | h) = (c(h w) + kappa P(w | shorter h)) / (c(h) + kappa), where kappa of an order is the number of different
    n-grams counted over that of different (n-1)-grams, 1 at least. The probability of a word never seen in
    training, as one class, is the share of training tokens that occur once.
    """

    def __init__(self, b: Block):
        width = b.width
        unseen = min(max(b.once, 1) / max(b.total, 1), 0.5) if b.total else 1.0
        p = np.where(b.counts > 0, (1 - unseen) * b.counts / max(b.total, 1), unseen)
        two, three = max(1.0, b.distinct_pairs / (b.distinct + 1)), max(1.0, b.distinct_triples / max(1, b.distinct_pairs))
        of_pair = np.full(len(b.pairs), -1, np.int64)
        known = np.flatnonzero(b.pair_counts >= SUPPORT)
        of_pair[known] = 1 + width + np.arange(len(known))
        of_word = np.where(b.context > 0, 1 + np.arange(width), 0)
        h, w = b.pairs // width, b.pairs % width
        smooth = (b.pair_counts + two * p[w]) / (b.context[h] + two)  # a context never seen has p[w]
        self.fail = np.log10(np.concatenate([[1.0], two / (b.context + two), three / (b.pair_counts[known] + three)]))
        self.shorter = np.concatenate([[0], np.zeros(width, np.int64), of_word[w[known]]])
        end = np.where(of_pair >= 0, of_pair, of_word[w])  # where a text that ends in the pair is
        seen = (b.pair_counts > 0) & (b.context[h] > 0)
        head, last = b.triples // width, b.triples % width
        kept = b.triple_counts > 0
        head, last, counts = head[kept], last[kept], b.triple_counts[kept]
        tail = np.searchsorted(b.pairs, w[head] * width + last)  # the trigram's second pair, which the block has too
        arcs = np.concatenate([(1 + h[seen]) * width + w[seen], of_pair[head] * width + last])
        weight = np.log10(np.concatenate([smooth[seen], (counts + three * smooth[tail]) / (b.pair_counts[head] + three)]))
        to = np.concatenate([end[seen], end[tail]])
        order = np.argsort(arcs, kind="stable")
        self.arcs, self.weight, self.to = np.append(arcs[order], np.iinfo(np.int64).max), np.append(weight[order], 0.0), np.append(to[order], 0)
        self.width, self.root, self.word, self.start = width, np.log10(p), of_word, int(of_word[b.start])
        self.after = end[b.pair_ids]

    def scores(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One left-to-right traversal of all texts in step: each carries its state and adds up log-probabilities. The last two words give the
        state, so a long text's slices begin in theirs and walk side by side."""
        begin = np.concatenate([np.arange(a, z, SLICE) for a, z in zip(at[:-1], at[1:])]) if len(at) > 1 else np.empty(0, np.int64)
        first = np.isin(begin, at[:-1])
        length = np.diff(np.append(begin, len(ids)))
        order = np.argsort(-length, kind="stable")
        sorted_at, length = begin[order], length[order]
        state = np.where(first, self.start, self.after[begin - 1])[order]
        acc = np.zeros(len(order))
        alive = len(order)
        for t in range(int(length[0]) if len(length) else 0):
            while length[alive - 1] <= t:
                alive -= 1
            w = ids[sorted_at[:alive] + t]
            open_ = np.arange(alive)
            while len(open_):
                s = state[open_]
                empty = s == 0
                done = open_[empty]
                acc[done] += self.root[w[done]]
                state[done] = self.word[w[done]]
                open_, s = open_[~empty], s[~empty]
                key = s * self.width + w[open_]
                k = np.searchsorted(self.arcs, key)
                hit = self.arcs[k] == key
                on = open_[hit]
                acc[on] += self.weight[k[hit]]
                state[on] = self.to[k[hit]]
                open_, s = open_[~hit], s[~hit]
                acc[open_] += self.fail[s]
                state[open_] = self.shorter[s]
        out = np.empty(len(order))
        out[order] = acc
        return np.add.reduceat(out, np.flatnonzero(first)) if len(out) else out


def _score(b: Block) -> pa.Table:
    known = np.append(0, np.cumsum(b.counts[b.ids] > 0))
    base = np.log10((b.counts[b.ids] + 1) / (b.total + 1 * (b.distinct + 1)))
    sums = np.add.reduceat(base, b.at[:-1])  # every text has its end, so no slice is empty
    cols = (b.doc_ids, b.held_out, np.diff(b.at), known[b.at[1:]] - known[b.at[:-1]], [b.total] * len(b.doc_ids), sums, Automaton(b).scores(b.ids, b.at))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCORES)], schema=SCORES)


def automaton_scores(docs: DataFrame, folds: int = 7, fold: int = 2, full: int = FULL_EXCHANGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the whole text).

    Tokens are words (A-Z lower-cased, runs without ASCII white space) and one end. Training counts come from all documents whose
    crc32(doc_id as text) mod folds is not fold. Texts are read once, into blocks of word numbers. Blocks exchange packed word and
    bigram hashes by range and get back the corpus counts of just the n-grams they hold; then the same with the trigrams whose
    first two words occur together SUPPORT times or more. From these each block builds its part of the automaton and traverses its texts. So the model
    grows with the corpus, and no task or driver holds all of it. Hashes have 64 bits.

    Null or empty text: the end alone. Null id: counted in training, kept as null. Repeated rows give repeated rows and count twice. With
    no training document, every token is unseen and costs nothing. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts, n_blocks = in_blocks(docs, id_col, text_col)

    def packed(table: pa.Table) -> pa.Table:
        row = pack_block(table)
        release()
        return row

    blocks = materialise(texts.groupBy("block").applyInArrow(packed, "block long, doc_ids array<long>, words binary, ids binary, at binary"))
    del texts

    def first(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from sent_keys(row["block"], Block(row, folds, fold).first(), n_blocks, full).to_batches()
                release()

    one, sums = count_keys(blocks.mapInArrow(first, ddl(KEYS)), n_blocks, full)
    one = materialise(one)
    tidy(spark)  # the texts' and first keys' shuffle files

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left.to_pylist()[0], folds, fold)
        b.learn(right, sums)
        rows = sent_keys(b.number, b.second(), n_blocks, full)
        del b
        release()
        return rows

    two, more = count_keys(blocks.groupBy("block").cogroup(one.groupBy("block")).applyInArrow(second, ddl(KEYS)), n_blocks, full)
    two = materialise(two)
    tidy(spark)
    both = one.withColumn("phase", F.lit(1)).unionByName(two.withColumn("phase", F.lit(2)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left.to_pylist()[0], folds, fold)
        b.learn(right.filter(pc.equal(right["phase"], 1)), sums)
        b.learn_more(right.filter(pc.equal(right["phase"], 2)), more)
        rows = _score(b)
        del b
        release()
        return rows

    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(score, ddl(SCORES))
