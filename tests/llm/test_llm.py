"""Each operator against brute force, a round trip or held-out labels, and on the awkward inputs its docstring defines."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, edit_tokens, exact_dedup, jaccard_join, mixing, ngram_lm, quality, queries, sql, surrogates, token_shards, toxicity
from tessera.llm.common import components, pack_counts, unpack_counts
from tessera.llm.tokenizer import END_OF_TEXT, encoder, read_vocabulary

DDL = "doc_id long, text string, lang string, source string, tokens string, gone_id long"
LONG = "word soup " * 30_000
AWKWARD = [(1, None, None, "s", "x", 1), (2, "", "en", None, "x", 1), (3, " \n\t", "en", "s", "x", 1), (4, "same text here now", "en", "s", None, 1), (5, "same text here now", "en", "s", "x", 1), (5, "same text here now", "en", "s", "x", 1), (None, "a null id has words", "en", "s", "x", 1), (7, LONG, "en", "s", "x", 1), (8, "Ünïcödé 😀 text", "de", "s", "x", 1)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DDL)


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


OPERATORS = {
    "mixing": lambda d, lab, b: mixing.mixed(d),
    "toxicity": lambda d, lab, b: toxicity.chain_scores(d, toxicity.train(d, lab)),
    "edits": lambda d, lab, b: edit_tokens.apply_edits(edit_tokens.build_trees(d.withColumn("edits", edit_tokens.scripted_edits()), keep=("edits",))),
    "quality": lambda d, lab, b: quality.quality_scores(d, lab),
    "surrogates": lambda d, lab, b: surrogates.with_surrogates(d),
    "lm": lambda d, lab, b: ngram_lm.automaton_scores(d),
    "shards": lambda d, lab, b: token_shards.shards(d),
    "jaccard": lambda d, lab, b: jaccard_join.jaccard_components(d),
    "exact": lambda d, lab, b: exact_dedup.exact_dedup(d),
    "decontam": lambda d, lab, b: decontam.decontaminate(d, b),
}
ONE_TO_ONE = {"toxicity", "edits", "quality", "surrogates", "lm", "jaccard", "exact"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty_tables(spark, awkward, labels, name):
    bench = spark.createDataFrame([(1, "a benchmark question about 5 km"), (2, None), (None, "x")], "item_id long, text string")
    got = OPERATORS[name](awkward, labels, bench).collect()
    if name in ONE_TO_ONE or name == "decontam":
        assert len(got) == len(AWKWARD)
    empty = awkward.limit(0)
    assert OPERATORS[name](empty, labels.limit(0), bench.limit(0)).count() == 0


@pytest.mark.parametrize("name", sql.ORACLE)
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(sql.ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    norm = lambda f: sorted(map(tuple, f[cols].astype(str).to_numpy().tolist()))
    assert norm(got) == norm(want)


def test_raking_alike_on_driver_and_cluster(docs, monkeypatch):
    here = {r[0]: r[1] for r in mixing.sampled(docs, rounds=2).select("doc_id", "__mix_probability").collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    there = {r[0]: r[1] for r in mixing.sampled(docs, rounds=2).select("doc_id", "__mix_probability").collect()}
    assert all(abs(here[i] - there[i]) < 1e-8 for i in here)


def test_mixing_by_plain_loops(spark):
    """Topics, marginals, probabilities and draws of every document, cell by cell."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in mixing.sampled(docs).collect()}
    texts = {r.doc_id: r for r in docs.collect()}
    profiles = {i: mixing.word_profile(r.text or "")[1].astype(float) for i, r in texts.items()}
    worded = [i for i in rows if profiles[i].any()]
    means = {x: np.mean([profiles[i] for i in worded if rows[i]["__mix_lang"] == x], 0) for x in {r["__mix_lang"] for r in rows.values()}}
    groups = {}
    for i in worded:
        assert rows[i]["__mix_tokens"] == len((texts[i].text or "").encode().split())
        groups.setdefault(rows[i]["__mix_topic"], []).append(profiles[i] - means[rows[i]["__mix_lang"]])
    assert len(groups) > 3 and mixing.NO_TOPIC not in groups
    centres = {t: np.sum(g, 0) / np.linalg.norm(np.sum(g, 0)) for t, g in groups.items()}
    nearest = [max(centres, key=lambda t: float((profiles[i] - means[rows[i]["__mix_lang"]]) @ centres[t])) == rows[i]["__mix_topic"] for i in worded]
    assert sum(nearest) > 0.9 * len(nearest)  # all but those that one more step would move
    total = sum(r["__mix_tokens"] for r in rows.values())
    for dim, power in mixing.POWER.items():
        held, got = Counter(), Counter()
        for r in rows.values():
            held[r[f"__mix_{dim}"]] += r["__mix_tokens"]
            got[r[f"__mix_{dim}"]] += r["__mix_tokens"] * r["__mix_probability"]
        goal, full = {k: v**power for k, v in held.items()}, set()
        while True:  # whoever is asked for more than he has gives all
            factor = (0.6 * total - sum(held[k] for k in full)) / sum(goal[k] for k in goal if k not in full)
            over = {k for k in goal if k not in full and factor * goal[k] > held[k]}
            if not over:
                break
            full |= over
        for k in goal:
            assert abs(got[k] - (held[k] if k in full else factor * goal[k])) < 0.002 * total
    for i, r in rows.items():
        assert r["__mix_selected"] == (int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:8], 16) / 2**32 < r["__mix_probability"])
    assert {r.doc_id for r in mixing.mixed(docs).collect()} == {i for i, r in rows.items() if r["__mix_selected"]}


def test_mixing_keeps_columns_of_any_name(spark):
    d = spark.createDataFrame([(i, f"some words {i}", "s", "en", 7, 8, 9) for i in range(40)], "doc_id long, text string, source string, lang string, __mix_weight int, __mix_topic int, row int")
    got = mixing.mixed(d, budget=1.0)
    assert got.columns == d.columns and sorted(got.collect()) == sorted(d.collect())


def test_toxicity_on_other_labels(spark):
    rows = [(i, f"plain words number {'abcdefgh'[i % 8]} here" + (" you idiot and moron" if i % 4 == 0 else "")) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400, 3)], "doc_id long, toxic int")
    got = {r.doc_id: r.rejected for r in toxicity.chain_scores(d, toxicity.train(d, lab)).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(400))


def test_toxicity_of_a_rare_language(spark):
    def text(i):
        if i % 128 < 2:  # few of the toxic rows
            return f"palabras sencillas {'abcdefgh'[i % 7]} aqui" + (" eres un tonto y bobo" if i % 4 == 0 else "")
        return f"plain words number {'abcdefgh'[i % 8]} here" + (" you idiot and moron" if i % 4 == 0 else "")

    d = spark.createDataFrame([(i, text(i)) for i in range(2048)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1600)], "doc_id long, toxic int")
    got = {r.doc_id: r.rejected for r in toxicity.chain_scores(d, toxicity.train(d, lab)).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(1600, 2048))


def test_edited_counts_equal_a_new_count(docs):
    encode = encoder(read_vocabulary()).encode_ordinary
    for r in OPERATORS["edits"](docs, None, None).collect():
        assert r.tokens_after == len(encode(r.text)) == sum(r.counts)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    lab = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.quality_scores(spark.read.parquet(f"{d}/documents.parquet"), lab).join(lab, "doc_id").filter("held_out").toPandas()
    assert len(got) > 40 and ((got.predicted == got.quality).mean() > 0.95)


def test_surrogates_keep_type_distinctness_and_coreference(spark):
    t = 'Mr. John Smith, jo.81@mail7.example.com, +1 (017) 555-7713, 97.51.17.173, 4111 1111 1111 1111. Mrs. Anna Smith and Mr. Smith: JO.81@mail7.example.com, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    out, counts = surrogates.rewrite(t, "k", {})
    assert counts == {"name": 4 + 1, "email": 2, "phone": 1, "ip": 1, "card": 1, "secret": 1}
    assert not any(x in out for x in ("Smith", "jo.81", "017) 555", "97.51.17.173", "4111 1111", "04dbebab"))
    surname = out.split()[2].rstrip(",")
    assert out.count(surname) == 3 and out.split()[1] not in out.split("Mrs. ")[1].split()[0]
    card = surrogates.surrogate("card", "4111111111111111", "k")
    assert surrogates._luhn(card) and card[0] == "4" and card != "4111111111111111"
    known = spark.createDataFrame([("name", f"latin:m:x{i}") for i in range(3000)], "kind string, entity string")
    attempts = {r.entity: r.attempt for r in surrogates.resolve(known).collect()}
    names = {surrogates.surrogate("name", f"latin:m:x{i}", surrogates.KEY, attempts.get(f"latin:m:x{i}", 0)) for i in range(3000)}
    assert attempts and len(names) == 3000


def test_surrogates_replace_all_mentions_of_a_name():
    out, counts = surrogates.rewrite("Dr. Anna Weber called. Weber said that Anna Weber is ill. WEBER!", "k", {})
    _, anna, weber, *_ = out.replace(".", "").split()
    assert out == f"Dr. {anna} {weber} called. {weber} said that {anna} {weber} is ill. {weber.upper()}!" and counts == {"name": 6}
    assert not {"Anna", "Weber"} & {anna, weber}
    for text, gone in (("Mr. J. Smith left", "J. Smith"), ("Mr John Fitzgerald Kennedy", "John Fitzgerald Kennedy"), ("Herr Otto von der Heide kam", "Otto Heide")):
        out, _ = surrogates.rewrite(text, "k", {})
        assert out != text and not set(gone.split()) & set(out.split())


def test_surrogates_of_phones_in_pairs_and_ipv6():
    for t in ("01 23 45 67 89", "+33 1 23 45 67 89", "030 12 34 56 78"):
        out, counts = surrogates.rewrite(f"call {t}, or", "k", {})
        assert counts == {"phone": 1} and t not in out and len(out) == len(t) + 9
    for t in ("2001:db8::8a2e:370:7334", "fe80:0:0:0:1:2:3:4"):
        out, counts = surrogates.rewrite(f"at {t} now", "k", {})
        assert counts == {"ip": 1} and t not in out
    for t in ("01.02.2024", "at 01.02.2024 10:30", "12:30:45", "std::vector", "0.123"):
        assert surrogates.rewrite(t, "k", {}) == (t, {})


@pytest.mark.parametrize("full", [2048, 0])
def test_lm_scores_by_brute_force(spark, docs, full, monkeypatch):
    more = [(9000 + i, "the old train left the station . the old train came back " * 3 + f"x{i % 3}") for i in range(12)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame([*more, (9100, ""), (9101, None)], "doc_id long, text string"))
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in d.collect()}
    train = [["<s>", *v] for i, v in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    uni, bi = Counter(w for v in train for w in v[1:]), Counter(p for v in train for p in zip(v, v[1:]))
    tri = Counter(t for v in train for t in zip(v, v[1:], v[2:]) if bi[t[:2]] >= ngram_lm.SUPPORT)
    heads = {p: c if c >= ngram_lm.SUPPORT else 0 for p, c in bi.items()}
    n, v1 = sum(uni.values()), len(uni)
    context = Counter(uni) + Counter({"<s>": len(train)})
    two, three = max(1.0, len(bi) / (v1 + 1)), max(1.0, len(tri) / len(bi))
    unseen = min(max(sum(c == 1 for c in uni.values()), 1) / n, 0.5)
    p1 = lambda w: (1 - unseen) * uni[w] / n if uni[w] else unseen
    p2 = lambda h, w: (bi[h, w] + two * p1(w)) / (context[h] + two)
    p3 = lambda g, h, w: (tri[g, h, w] + three * p2(h, w)) / (heads.get((g, h), 0) + three)
    seen = 0
    monkeypatch.setattr(ngram_lm, "SLICE", 50)
    blocks = ngram_lm.in_blocks(d, block_bytes=60_000)
    monkeypatch.setattr(ngram_lm, "in_blocks", lambda *_: blocks)
    for r in ngram_lm.automaton_scores(d, full=full).collect():
        v = ["<s>", *texts[r.doc_id]]
        want = math.log10(p2(*v[:2])) + sum(math.log10(p3(*t)) for t in zip(v, v[1:], v[2:]))
        base = sum(math.log10((uni[w] + 1) / (n + v1 + 1)) for w in v[1:])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(v) - 1, sum(uni[w] > 0 for w in v[1:]), n)
        assert math.isclose(r.score, want, rel_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9)
        seen += 1
    assert seen == len(texts) and len(tri) > 20


def test_shards_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    token_shards.shards(docs, shard_slots=16, sequence=64).write.parquet(path)
    total = spark.read.parquet(path).agg(F.sum("slots")).first()[0]
    encode = encoder(read_vocabulary()).encode_ordinary
    parts = {}
    for x in token_shards.read_slots(spark, path, 0, total, 16, 64):
        parts.setdefault(int(x["doc_id"]), {})[int(x["sequence"])] = x["ids"][: x["tokens"]].tolist()
    for r in docs.collect():
        assert sum((parts[r.doc_id][k] for k in sorted(parts[r.doc_id])), []) == [*encode(r.text), END_OF_TEXT]
    files = spark.read.parquet(path).select("shard", F.input_file_name().alias("f")).groupBy("f").agg(F.min("shard").alias("a"), F.max("shard").alias("z")).orderBy("f").collect()
    assert len(files) > 1 and all(x.z < y.a for x, y in zip(files, files[1:]))  # files follow one another, so bounds skip all but those wanted
    some = [int(x["doc_id"]) for x in token_shards.read_slots(spark, path, 30, 7, 16, 64)]
    assert some == [int(x["doc_id"]) for x in token_shards.read_slots(spark, path, 0, total, 16, 64)][30:37]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 1025])
def test_feistel_is_a_permutation(n):
    f = token_shards.Feistel(n, "key")
    assert sorted(f.slot(np.arange(n))) == list(range(n)) and (f.index(f.slot(np.arange(n))) == np.arange(n)).all()


@pytest.mark.parametrize("chunk, full", [(2, 2048), (7, 0), (600, 2048)])
def test_jaccard_by_brute_force(spark, docs, chunk, full):
    base = "one two three four five six seven eight nine ten".split() * 1 + [f"w{i}" for i in range(60)]
    near = [(10_000 + i, " ".join(base[:j] + [f"edit{i}"] + base[j + 1 :])) for i, j in enumerate(range(0, 70, 3))]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    sets = {}
    for r in d.collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for r in jaccard_join.jaccard_components(d, 4, 85, chunk=chunk, full=full).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))


def test_large_counts_travel_whole():
    for a in ([], [1, 2], [1, 2**40]):
        assert unpack_counts(pack_counts(np.array(a, np.int64))).tolist() == a


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_exact_dedup_smallest(spark, awkward):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(awkward).collect()}
    assert (got[2].keep_id, got[2].group_size) == (1, 2) and got[5].keep_id == 4 and got[5].group_size == 3
    assert got[2].text_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("keep, fan_in, block", [("smallest", 2, 4), ("largest", 8, 8192), ("smallest", 3, 1), ("largest", 2, 30)])
def test_exact_dedup_by_brute_force(spark, keep, fan_in, block):
    rows = [(i if i % 17 else None, f"text {i * i % 37}" if i % 3 else "hot") for i in range(400)] + [(None, "alone"), (None, "alone")]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    best = {"smallest": min, "largest": max}[keep]
    kept = {t: best((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((str(i), str(kept[t]), len(groups[t]), i == kept[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep, fan_in, block).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_dedup_merges_runs_without_hashing_digests(spark, docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[digest" not in plan and "Python" not in plan and "Arrow" not in plan


def test_decontamination_catches_changed_slots_but_not_mixed_ones(spark):
    item = "A train leaves the old station at 60 km and Anna waits there for 60 minutes before going home again"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "Before. " + item + " After."), (2, item.replace("60", "75").replace("Anna", "Berta")), (3, item.replace("60 km", "75 km")), (4, "Nothing of that kind is to be found in here at all, is it?")]
    got = {r.doc_id: r.reparameterised for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got.get(1) is False and got.get(2) is True and 4 not in got


def test_decontamination_of_items_without_an_ordinary_window(spark):
    items = ["What is 12 + 35 - 4 * 7 + 18?", "Compute 3 x 17 + 42 / 6 - 5 for x = 9", "Who wrote Hamlet?", "小明有三个苹果,他又买了五个梨,请问他现在一共有多少个水果?", "7, 7, 8, 1, 2, 3"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"Some words before. {t} And some words after." for t in items]  # 0 to 4
    texts += ["What is 13 + 36 - 5 * 8 + 19?", "What is 12 + 35 - 4 * 7 of it", "Compute 3 x 17 + 42 / 6 - 5 for y = 9", "Who wrote Faust?", "小明有三个苹果。", "7, 8, 9, 1, 2, 3"]
    got = {r.doc_id: (r.item_id, r.reparameterised) for r in decontam.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    assert got == {**{i: (i, False) for i in range(5)}, 5: (0, True)}


def test_decontamination_whatever_the_case_and_the_word_before(spark):
    items = ["How many legs does a healthy spider have?", "The train from Berlin to Paris leaves at 9 and carries Anna and Otto home"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"She asked the class {items[0]}", items[0].upper(), items[0].title(), items[1].lower(), items[1].upper(), items[1], f"that day {items[1]}"]
    texts += ["THE TRAIN FROM BERLIN TO PARIS LEAVES AT 7 AND CARRIES ANNA AND OTTO HOME", "the Train from Rome to Lyon leaves at 9 and carries Emma and Karl home"]
    texts += ["She asked the class How many legs does a table have", "The train from Berlin to Paris leaves at 9"]
    got = {r.doc_id: (r.item_id, r.reparameterised) for r in decontam.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    assert got == {0: (0, False), 1: (0, False), 2: (0, False), 3: (1, False), 4: (1, False), 5: (1, False), 6: (1, False), 7: (1, True), 8: (1, True)}


def linked(texts, width, percent):
    """Smallest id of each text's group, from all pairs of sets."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_pipeline_by_plain_loops(spark, sf, docs, labels):
    """Each stage's documents, worked out text by text from the stage before, and the shards' tokens from the last."""
    import corpus_pipeline

    shards = corpus_pipeline.run(spark, sf).collect()
    kept, texts = docs, {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    def after(name, df):
        out = stages[name](spark, df, sf)
        assert out.columns == docs.columns
        return out, {r.doc_id: r.text for r in out.collect()}

    model = toxicity.train(docs, labels)
    want = {}
    for i, t in texts.items():  # the chain, one weight at a time
        f, before = toxicity.text_features(t), []
        for w in model.weights:
            z = w[0] + sum(x for word, x in zip(model.words, w[1:]) if word in f) + w[len(model.words) + 1] * math.log1p(len(f)) / 10 + sum(a * b for a, b in zip(w[len(model.words) + 2 :], before))
            before.append(1 / (1 + math.exp(-z)) if f else 0.0)
        if before[-1] < model.threshold:
            want[i] = t
    kept, texts = after("toxicity", kept)
    assert texts == want
    root = linked(texts, 5, 80)
    want = {i: t for i, t in texts.items() if root[i] == i}
    kept, texts = after("near_duplicates", kept)
    assert texts == want
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    windows = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    items = [windows(words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = {i: windows(words(t)) for i, t in texts.items()}
    want = {i: t for i, t in texts.items() if not any(len(w & found[i]) >= 0.8 * len(w) for w in items)}
    kept, texts = after("decontamination", kept)
    assert texts == want and len(want) < len(found)
    chosen = {r.doc_id for r in mixing.sampled(kept).collect() if int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32 < r["__mix_probability"]}
    kept, texts = after("mixing", kept)
    assert set(texts) == chosen
    encode, parts = encoder(read_vocabulary()).encode_ordinary, {}
    for r in shards:
        for x in np.frombuffer(r.payload, token_shards.record_type()):
            parts.setdefault(int(x["doc_id"]), {})[int(x["sequence"])] = x["ids"][: x["tokens"]].tolist()
    assert {i: sum((p[k] for k in sorted(p)), []) for i, p in parts.items()} == {i: [*encode(t or ""), END_OF_TEXT] for i, t in texts.items()}


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_awkward_rows(spark, awkward, sf, empty):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    d = awkward.limit(0) if empty else awkward.withColumn("row", F.lit(1)).withColumn("bad_id", F.lit(2))
    for name in ("toxicity", "near_duplicates", "decontamination", "mixing"):
        out = stages[name](spark, d, sf)
        assert out.columns == d.columns
        got = sorted((str(r.doc_id), str(r.text)[:20]) for r in out.collect())
        rows = sorted((str(i), str(t)[:20]) for i, t, *_ in ([] if empty else AWKWARD))
        if name in ("toxicity", "decontamination"):
            assert got == rows
        elif name == "near_duplicates":
            assert got == [r for r in rows if r[0] != "5"]  # 4 has the same text
        else:
            assert set(got) <= {r for r in rows if r[1].strip() and r[1] != "None"}
    assert stages["token_ids"](spark, d, sf).agg(F.sum("slots")).first()[0] == (None if empty else len(AWKWARD) + got_extra(awkward))


def got_extra(df):
    """Sequences beyond the first of the long text."""
    encode = encoder(read_vocabulary()).encode_ordinary
    return sum((len(encode(r.text or "")) + 1 - 1) // token_shards.SEQUENCE for r in df.collect())


@pytest.mark.parametrize("n, stride", [(1, 5), (37, 5), (256, 16)])
def test_slots_by_a_scalar_model(spark, tmp_path, n, stride):
    """Slot by slot: a Feistel network over whole numbers, walked until it falls below n."""
    d = spark.createDataFrame([(i, f"text number {i}") for i in range(n)], "doc_id long, text string").coalesce(1)
    f = token_shards.Feistel(n, "k")
    half, keys = int(f.half), [int(k) for k in f.keys]

    def scramble(h):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = ((h ^ h >> 33) * m) % 2**64
        return h ^ h >> 33

    def slot(x):
        while True:
            left, right = x >> half, x % 2**half
            for k in keys:
                left, right = right, left ^ scramble((right + k) % 2**64) % 2**half
            x = left << half | right
            if x < n:
                return x

    path = str(tmp_path / "s")
    token_shards.shards(d, key="k", shard_slots=stride).write.parquet(path)
    got = [int(x["doc_id"]) for x in token_shards.read_slots(spark, path, 0, n, stride)]
    want = [None] * n
    for r in token_shards.sequences(d).collect():
        want[slot(r.place)] = r.doc_id
    assert got == want


def test_chain_by_plain_loops():
    """Out-of-fold inputs, one category after the other, with gradient descent in place of Newton's steps; and scoring word by word."""
    rng = np.random.default_rng(3)
    words = ["aa", "bb", "cc", "dd"]
    found = [{w for w in words if rng.random() < 0.4} for _ in range(120)]
    first = np.array([float("aa" in f) if rng.random() < 0.9 else 0.0 for f in found])
    last = np.array([float("aa" in f or "bb" in f) if rng.random() < 0.9 else 1.0 for f in found])
    fold, sizes = np.arange(120) % 3, [len(f) for f in found]
    chain = toxicity.fit_chain(found, sizes, fold, {"one": first, "two": last}, words)

    def vector(f, before):
        return [1.0, *(float(w in f) for w in words), math.log1p(len(f)) / 10, *before]

    def slope(x, y, w):
        """Largest part of the gradient of the penalised likelihood: none at the optimum."""
        g = [0.0] * len(w)
        for v, t in zip(x, y):
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(v, w))))
            for j, a in enumerate(v):
                g[j] += (t - p) * a
        return max(abs(g[j] - (1e-6 if j == 0 else 0.05) * w[j]) for j in range(len(w)))

    plain = [vector(f, []) for f in found]
    oof = [0.0] * 120
    for k in range(3):
        w = toxicity.fit_logistic(np.array([v for v, g in zip(plain, fold) if g != k]), first[fold != k])
        assert slope([v for v, g in zip(plain, fold) if g != k], first[fold != k], w) < 1e-2
        for i in np.flatnonzero(fold == k):
            oof[i] = 1 / (1 + math.exp(-sum(a * b for a, b in zip(plain[i], w))))
    assert slope(plain, first, chain.weights[0]) < 1e-2
    assert slope([vector(f, [o]) for f, o in zip(found, oof)], last, chain.weights[1]) < 1e-2
    p = chain.probabilities(["aa cc", "bb", "", "dd zz zz"])
    for text, got in zip(["aa cc", "bb", "", "dd zz zz"], p):
        f = set(text.split())
        one = 1 / (1 + math.exp(-sum(a * b for a, b in zip(vector(f, []), chain.weights[0])))) if f else 0.0
        two = 1 / (1 + math.exp(-sum(a * b for a, b in zip(vector(f, [one]), chain.weights[1])))) if f else 0.0
        assert np.allclose(got, [one, two])


def test_categories_from_shared_words():
    found = [{"aa", "ab"}, {"aa"}, {"ab", "aa"}, {"bb"}, {"bb", "bc"}, {"bc"}, {"aa"}, set()]
    got = toxicity.split_categories(found, np.array([1, 1, 1, 1, 1, 1, 0, 0.0]), ["aa", "bb", "ab", "bc"])
    assert got["toxic_1"].tolist() == [1, 1, 1, 0, 0, 0, 0, 0] and got["toxic_2"].tolist() == [0, 0, 0, 1, 1, 1, 0, 0]
    none = toxicity.split_categories([set()], np.zeros(1), [])
    assert [v.tolist() for v in none.values()] == [[0.0], [0.0]]


def test_quality_sums_in_rounds_alike(spark):
    rows = [(np.arange(16, dtype=np.float32).tobytes(), float(i % 2), i % 3) for i in range(200)]
    rated = spark.createDataFrame(rows, "stats binary, y double, fold int").repartition(37)
    of = lambda x, y: np.array([len(x), y.sum(), x.sum()])
    for branch in (2, 5, 64):
        got = quality._tree_sum(rated, of, branch)
        want = {f: of(np.tile(np.arange(16.0), (sum(r[2] == f for r in rows), 1)), np.array([r[1] for r in rows if r[2] == f])) for f in range(3)}
        assert {f: v.tolist() for f, v in got.items()} == {f: v.tolist() for f, v in want.items()}


def test_quality_by_normal_equations(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    fold = np.arange(300) % 4
    model = quality.fit(spark.createDataFrame([(r.tobytes(), float(v), int(f)) for r, v, f in zip(x, y, fold)], "stats binary, y double, fold int"), fourier=40)
    x = x.astype(float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0))
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    a = np.column_stack([np.ones(300), z, np.sqrt(2 / 40) * np.cos(z @ model.freq + model.phase)])
    assert np.allclose(model.weights, np.linalg.lstsq(np.vstack([a, np.eye(a.shape[1])]), np.append(y, np.zeros(a.shape[1])), rcond=None)[0], atol=1e-6)
    knots, scores = model.knots, model.score(x)
    assert (np.diff(knots[1]) > 0).all() and ((scores > 0.5) == (y > 0.5)).mean() > 0.8


def test_surrogates_of_values_without_choice(spark):
    odd = [("secret", "________________"), ("secret", "--------"), ("secret", "========"), ("ssn", "000-00-0000"), *(("phone", str(i)) for i in range(10)), ("email", "a@b.co")]
    attempts = {(r.kind, r.entity): r.attempt for r in surrogates.resolve(spark.createDataFrame(odd, "kind string, entity string")).collect()}
    got = [(k, surrogates.surrogate(k, e, surrogates.KEY, attempts.get((k, e), 0))) for k, e in odd]
    assert len(set(got)) == len(odd) and not set(got) & set(odd)
    text = "Password: ________________ and then api_key: ========"
    out = surrogates.with_surrogates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out.kinds == "secret=2" and "________________" not in out.text and "========" not in out.text


def test_surrogates_keep_account_numbers_valid():
    for t in ("DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"):
        out, counts = surrogates.rewrite(f"to {t}, please", "k", {})
        number = out[3:-8].replace(" ", "")
        assert counts == {"iban": 1} and t not in out and len(out) == len(t) + 11 and number[:2] == t[:2]
        assert int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def test_surrogates_of_scripts_without_capitals():
    for t, name in (("מר דוד כהן הלך הביתה. כהן חזר", "כהן"), ("السيد محمد علي وصل", "محمد"), ("王小明先生来了。王小明走了", "王小明")):
        out, counts = surrogates.rewrite(t, "k", {})
        assert counts["name"] >= 2 and name not in out


def test_decontamination_compares_slots_across_shifts(spark):
    item = "A train leaves the old station at 60 km and then Anna waits there for 60 minutes before she goes home again"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    half = item.replace("60 km", "75 km").replace("60 minutes", "33 minutes")
    rows = [(1, half), (2, half.replace("there for", "there quietly for")), (3, item.replace("60", "75").replace("there for", "there quietly for")), (4, f"{item} And {item.replace('60', '99')}")]
    got = {r.doc_id: r.reparameterised for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, containment=0.75).collect()}
    assert set(got) == {3, 4} and got[3] is True
