"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FULL_EXCHANGE, KEYS, answers_by_kind, chain, components, count_keys, ddl, in_blocks, materialise, mix, planes, release, sent_keys, sliced, unplanes, word_hashes

#: Prefixes grow by up to so many tokens beyond the plain prefix filter's.
MOST_EXTRA = 16
#: Documents of one candidate group that a task compares at once; larger groups are cut into pairs of such chunks.
CHUNK = 600
#: A shingle held by more documents of a group than this counts through a matrix product instead of listed pairs.
DENSE = 24

SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("extra", pa.int32()), ("prefix", pa.binary()), ("shared", pa.binary())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(texts, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, shingle hash) of each text's distinct shingles, sorted by both, and each text's offset.

    A text of fewer words than width is one shingle: the whole sequence. A text without words has none.
    """
    words, at = word_hashes(texts)
    n = np.diff(at)
    runs = chain(*(words[i : len(words) - width + 1 + i] for i in range(width))) if len(words) >= width else np.empty(0, np.uint64)
    out = []
    for i, (a, k) in enumerate(zip(at[:-1], n)):
        if k >= width:
            out.append(np.unique(runs[a : a + k - width + 1]))
        elif k:
            out.append(chain(*(words[a + j : a + j + 1] for j in range(k))))
        else:
            out.append(np.empty(0, np.uint64))
    sizes = np.array([len(x) for x in out], np.int64)
    return np.repeat(np.arange(len(out)), sizes), np.concatenate(out) if out else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def prefix_length(n: int, percent: int, extra: int) -> int:
    """How many of n ordered tokens to look at so that two sets with the wanted similarity share at least extra of those looked at."""
    least = -(-percent * n // 100)  # a partner shares at least this many
    return min(n, n - least + extra)


def choose_extra(freq: np.ndarray, n: int, percent: int) -> int:
    """The number of shared prefix tokens to ask for: the one with the least estimated cost.

    freq: documents for each token, rarest first. A prefix of length p meets S(p) = sum of (freq - 1) postings; at most S(p) / extra
    partners can match extra times, and each of those costs a verification of about n tokens.
    """
    postings = np.cumsum(freq[: prefix_length(n, percent, MOST_EXTRA)].astype(np.float64) - 1)
    least = -(-percent * n // 100)
    most = max(1, min(MOST_EXTRA, least))
    extra = np.arange(1, most + 1)
    s = postings[np.minimum(len(postings), n - least + extra) - 1]
    return int(extra[np.argmin(s + s / extra * n)])


def _sketch(table: pa.Table, answers: pa.Table, width: int, percent: int) -> pa.Table:
    """For each document of a block: set size, signature of the set, adaptive prefix, and the shingles that other documents have too."""
    doc_ids = table["doc_id"].to_pylist()
    doc, hashes, at = shingle_hashes(table["text"].to_pylist(), width)
    freq = np.empty(0, np.uint32)
    if len(hashes):
        _, back = np.unique(hashes, return_inverse=True)
        freq = answers_by_kind(answers, 1)[0][0][back]
    mixed = mix(hashes + np.uint64(0x51ED2701))
    ends = np.concatenate([[np.uint64(0)], np.cumsum(hashes, dtype=np.uint64)]), np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    sig_a, sig_b = ((e[at[1:]] - e[at[:-1]]).view(np.int64) for e in ends)
    extra, prefix, shared = [], [], []
    for a, b in zip(at[:-1], at[1:]):
        n = int(b - a)
        f, h = freq[a:b], hashes[a:b]
        held = h[f > 1]
        if 100 * len(held) < percent * n or not n:  # too few of its shingles occur anywhere else
            extra.append(0), prefix.append(b""), shared.append(b"")
            continue
        order = np.lexsort((h, f))
        k = choose_extra(f[order], n, percent)
        first = order[: prefix_length(n, percent, k)]
        extra.append(k)
        prefix.append(planes(h[first[f[first] > 1]]))
        shared.append(planes(held))
    n = np.diff(at)
    cols = (doc_ids, n, sig_a, sig_b, extra, prefix, shared)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SETS)], schema=SETS)


def overlaps(sets: list[np.ndarray], dense: int = DENSE) -> np.ndarray:
    """Matrix of intersection sizes of the sets."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    if not len(who):
        return out
    tokens, idx, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(idx, kind="stable")
    who, idx = who[order], idx[order]
    start = np.concatenate([[0], np.cumsum(counts)])
    wide = np.flatnonzero(counts > dense)
    for c in range(0, len(wide), 2048):
        cols = wide[c : c + 2048]
        x = np.zeros((m, len(cols)), np.float32)
        for j, t in enumerate(cols):
            x[who[start[t] : start[t + 1]], j] = 1
        out += x @ x.T
    flat = out.reshape(-1)
    for k in range(2, dense + 1):
        of = np.flatnonzero(counts == k)
        for c in range(0, len(of), max(1, 2_000_000 // (k * k))):
            g = who[start[of[c : c + max(1, 2_000_000 // (k * k))], None] + np.arange(k)]
            pairs = (g[:, :, None] * m + g[:, None, :]).reshape(-1)
            flat += np.bincount(pairs, minlength=m * m) if len(pairs) > m * m // 8 else 0
            if len(pairs) <= m * m // 8:
                np.add.at(flat, pairs, 1)
    return out


def _verify(table: pa.Table, percent: int, bits_of=unplanes) -> pa.Table:
    """Links among one tile's documents, as a star for each connected group of them."""
    table = table.sort_by("doc_id")
    ids = np.array(table["doc_id"].to_pylist(), np.int64)
    n = np.array(table["n_shingles"].to_pylist(), np.int64)
    extra = np.array(table["extra"].to_pylist(), np.float32)
    matches = overlaps([unplanes(x, np.uint64) for x in table["prefix"].to_pylist()])
    may = (matches >= np.minimum.outer(extra, extra)) & (np.minimum.outer(n, n) * 100 >= percent * np.maximum.outer(n, n))
    np.fill_diagonal(may, False)
    rows = np.flatnonzero(may.any(1))
    if not len(rows):
        return pa.Table.from_pylist([], schema=LINKS)
    shared = table["shared"].to_pylist()
    common = overlaps([unplanes(shared[i], np.uint64) for i in rows])
    m = n[rows]
    link = may[np.ix_(rows, rows)] & (100 * common >= percent * (m[:, None] + m[None, :] - common))
    label = np.arange(len(rows))
    while True:  # the smallest label spreads along links
        new = np.minimum(label, np.where(link, label[None, :], len(rows)).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = np.flatnonzero(label != np.arange(len(rows)))
    return pa.Table.from_arrays([pa.array(ids[rows[label[tied]]], pa.int64()), pa.array(ids[rows[tied]], pa.int64())], schema=LINKS)


def _links(members: DataFrame, payload: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Edges (a, b) that connect all linked members of each candidate group (leader, doc_id); payload: the documents' sets.

    A group is cut by hash into chunks. First each chunk is compared in itself and with the leader. What that connects to the leader is
    one component already, so pairs within it are not looked at again: only the strays, the members outside it, then meet each other
    and the rest, chunk by chunk. A large group of near copies thus costs its size, not the square.
    """

    def verify(table: pa.Table) -> pa.Table:
        rows = _verify(table, percent)
        if table.nbytes > 1_000_000:  # small ones are many
            release()
        return rows

    def compare(tiles: DataFrame, *tile: str) -> DataFrame:
        return materialise(tiles.join(payload, "doc_id").groupBy("leader", *tile).applyInArrow(verify, ddl(LINKS)))

    def part(count, start=F.lit(0)):
        return (start + F.pmod(F.xxhash64("doc_id", "leader"), count)).cast("int")

    def parts(count):
        return F.ceil(count / F.lit(chunk)).cast("int")

    sizes = members.groupBy("leader").agg(parts(F.count("*")).alias("k"))
    placed = members.join(sizes, "leader").select("leader", "doc_id", "k", part(F.col("k")).alias("i"))
    to_all = sizes.filter("k > 1").select("leader", F.col("leader").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    near = compare(placed.select("leader", "doc_id", "i").union(to_all).distinct(), "i")

    wide = materialise(placed.filter("k > 1").select("leader", "doc_id"))
    if wide.isEmpty():
        return near
    of = components(near)
    own = wide.join(of.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("leader", "doc_id", F.coalesce("component", "doc_id").alias("own"))
    head = wide.select("leader").distinct().join(of.withColumnRenamed("node", "leader"), "leader", "left").select("leader", F.coalesce("component", "leader").alias("head"))
    split = materialise(own.join(head, "leader").select("leader", "doc_id", (F.col("own") != F.col("head")).alias("stray")))
    counts = split.groupBy("leader").agg(parts(F.count_if("stray")).alias("s"), parts(F.count_if(~F.col("stray"))).alias("r"))
    split = split.join(counts.filter("s > 0"), "leader").withColumn("mine", F.when(F.col("stray"), part(F.col("s"))).otherwise(part(F.col("r"), F.col("s"))))
    # chunks of strays come first; a stray meets every chunk, another member those of strays
    met = F.when(F.col("stray"), F.sequence(F.lit(0), F.col("s") + F.col("r") - 1)).otherwise(F.sequence(F.lit(0), F.col("s") - 1))
    tiles = split.withColumn("other", F.explode(met)).select("leader", "doc_id", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    return near.union(compare(tiles, "i", "j"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, chunk: int = CHUNK, full: int = FULL_EXCHANGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), exemplar.

    Documents link when 100 * |A & B| >= percent * |A | B| over their distinct shingles of width words (A-Z lower-cased, words are runs
    without ASCII white space). A text with fewer words is one shingle; one without words, or null, has no set and no link.

    1. Blocks of documents exchange packed shingle hashes by range, which gives every shingle's exact document frequency.
    2. Shingles are ordered rarest first. Each document takes the prefix that any partner must hit, lengthened by the number of extra
       tokens of least estimated cost; so many shared prefix tokens are then asked of a partner. Tokens that nobody else has are
       dropped, and with them most documents.
    3. Equal sets fall together (exemplar: the smallest id of the same set); one of each goes on.
    4. A prefix token's holders form a candidate group named by their smallest id; groups of the same name are one. A group of more
       than chunk documents is cut by hash into chunks, which meet the leader first; then only the documents that this leaves outside
       the leader's component meet the other chunks, each pair of chunks in a task of its own.
    5. A task counts shared prefix tokens, keeps pairs with at least the smaller of the two required counts, verifies those on whole
       sets, and returns one edge for each document tied to an earlier one: no pair of a group of copies is listed.
    6. Components of the edges.

    Hashes have 64 bits. Repeated rows give repeated rows; a null id is one more id that cannot be linked to. An empty table gives no rows.
    """
    blocks, n_blocks = in_blocks(docs, id_col, text_col)

    def keys(table: pa.Table) -> pa.Table:
        kinds = [np.unique(shingle_hashes(table["text"].to_pylist(), width)[1], return_counts=True)]
        rows = sent_keys(table["block"][0].as_py(), kinds, n_blocks, full)
        del kinds
        release()
        return rows

    frequencies, _ = count_keys(blocks.groupBy("block").applyInArrow(keys, ddl(KEYS)), n_blocks, full)

    def sketch(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sliced(_sketch(left, right, width, percent))
        release()
        return rows

    sets = materialise(blocks.groupBy("block").cogroup(frequencies.groupBy("block")).applyInArrow(sketch, ddl(SETS)))

    same = ["n_shingles", "sig_a", "sig_b"]
    classes = materialise(sets.filter("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("exemplar"), F.max("extra").alias("extra")))
    chosen = classes.filter("extra > 0").select(F.col("exemplar").alias("doc_id"))
    payload = sets.filter("extra > 0").join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id"])

    def tokens(batches):
        for b in batches:
            ids, held = b["doc_id"].to_numpy(zero_copy_only=False), [unplanes(x, np.int64) for x in b["prefix"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held) if held else np.empty(0, np.int64)), pa.array(np.repeat(ids, [len(x) for x in held]))], names=["token", "doc_id"])

    held = materialise(payload.select("doc_id", "prefix").mapInArrow(tokens, "token long, doc_id long"))
    groups = held.groupBy("token").agg(F.min("doc_id").alias("leader"), F.count("*").alias("holders")).filter("holders > 1").select("token", "leader")
    members = materialise(held.join(groups, "token").select("leader", "doc_id").distinct())
    linked = components(_links(members, payload.select("doc_id", "n_shingles", "extra", "prefix", "shared"), percent, chunk))

    classes = classes.join(linked.withColumnRenamed("node", "exemplar"), "exemplar", "left").select(*same, "exemplar", F.coalesce("component", "exemplar").alias("component"))
    out = sets.select("doc_id", *same).join(classes, same, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("exemplar", "doc_id").alias("exemplar"))
