"""Literal cases of the rules that are easy to get wrong."""

import hashlib
import json
import random
import re
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions import digests
from tessera.operators import emissions, golden, merges, scan, segments, service, spans, tokens
from tessera.plans import detect, registry
from tessera.sources import files
from tessera.streaming import analyze as streams


def found(spark, column):
    return [tuple(x) for x in spark.range(1).select(column.alias("x")).first().x]


def plain_pieces(text):
    """The rules read character by character."""
    white, parts, at = re.compile(r"\s"), [], 0
    for m in re.finditer("(?:(?<=[.!?…。！？])[\"'»”’)\\]]*\\s+|\n[ \\t]*\n)", text):
        parts.append((at, m.start()))
        at = m.end()
    out = []
    for s, e in [*parts, (at, len(text))]:
        s, e = s + len(text[s:e]) - len(text[s:e].lstrip()), s + len(text[s:e].rstrip())
        if s >= e:
            continue
        if out and e - s < segments.SHORT:
            out[-1] = (out[-1][0], e)
            continue
        while s < e:
            stop = e
            if e - s > segments.LONG:
                stop = text.rfind(" ", s + segments.SHORT, s + segments.LONG)
                stop = s + segments.LONG if stop < 0 else stop
            out.append((s, stop))
            s = stop
            while s < e and white.match(text[s]):
                s += 1
    return out


def test_pieces_by_plain_loop(spark):
    rnd = random.Random(3)
    lists = [["word ", "x", ". ", '." ', "\n\n", "longer text here ", "y" * 50], ["ab  ", "z" * 700, " ", "! ", "é"], ["😀", "。 ", "\n \n", "w " * 400]]
    texts = ["", " \n\n ", ". ", '"Hi." Then', *("".join(rnd.choice(options) for _ in range(rnd.randrange(60))) for options in lists for _ in range(60))]
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "doc_id long, text string, next string")
    got = {}
    for r in segments.piece_rows(df).orderBy("doc_id", "piece_no").collect():
        assert texts[r.doc_id][r.start : r.end] == r.text and texts[r.doc_id][r.end : r.end + 1] == r.next
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_pieces(t)


def test_pieces_of_ids_far_apart(spark):
    ids = [0, 2**40, 5, 2**40 + 5, -1, -(2**62), 2**62]
    docs = spark.createDataFrame([(i, f"One sentence of document {i} that is long enough. And another one of the same length here.") for i in ids], "doc_id long, text string")
    words = segments.lifted(tokens.word_tokens(segments.as_texts(segments.piece_rows(tokens.scrubbed(docs))))).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in words} == set(ids) and all(texts[r.doc_id][r.start : r.end] == r.word for r in words)


def test_parsed_source_is_whole(spark):
    name = "org/" + "r" * 20_000
    kind, repo, revision = service.parse_source(F.lit(f"hf://{name}@tag"))
    assert tuple(spark.range(1).select(kind, repo, revision).first()) == ("hub", name, "tag")


def test_cuda_without_cuda_is_an_error(spark):
    df = spark.createDataFrame([("cuda", ["CPUExecutionProvider"])], "setting string, available array<string>")
    with pytest.raises(Exception, match="CUDAExecutionProvider"):
        df.select(service.providers(F.col("setting"), F.col("available"))).collect()


def test_proclitics_take_hebrew_marks_only(spark):
    def starts(text, start):
        x = F.struct(F.lit(start).cast("long").alias("start"), F.lit(len(text)).cast("long").alias("end"), F.lit("CITY").alias("head"), F.lit(text[start:]).alias("surface"), F.lit(False).alias("joined"))
        return found(spark, merges.complete_proclitics(F.lit(text), F.array(x)))[0][0]

    assert starts("ובירושלים", 2) == 0 and starts("xבירושלים", 2) == 2 and starts("וְבירושלים", 3) == 0
    assert starts("ו\u0301בירושלים", 3) == 2  # another script's mark ends the word; the rest is a word of its own


def test_files_that_differ_from_the_manifest(spark):
    folder = files.scratch(spark)
    files.put(spark, f"{folder}/a.onnx", "weights")
    entries = spark.createDataFrame([("a.onnx", "00")], "file string, sha256 string")
    with pytest.raises(Exception, match="differs"):
        files.verified(spark, folder, entries).collect()


def test_iob2_inside_after_outside_opens(spark):
    rows = [(1, 0, "PERSON", 0, 0, 2, "I", "common"), (1, 0, "PERSON", 1, 3, 3, "O", None), (1, 0, "PERSON", 2, 3, 5, "I", "rare"), (1, 0, "PERSON", 3, 6, 8, "O", None), (1, 0, "PERSON", 4, 9, 11, "I", "rare"), (1, 0, "PERSON", 5, 12, 14, "B", "rare")]
    df = spark.createDataFrame(rows, "doc_id long, window_no int, head string, tok int, start int, end int, prefix string, tier string")
    df = df.withColumn("logits", F.lit(0))
    got = spans.islands(spans.inside(spans.numbered(df))).orderBy("tok").select("tok", "span_no").collect()
    assert [tuple(r) for r in got] == [(0, 1), (2, 1), (4, 2), (5, 3)]


def test_suppression_is_greedy_not_transitive(spark):
    rows = [(1, "PERSON", 0, 0, 5, 0.9), (1, "PERSON", 0, 4, 8, 0.8), (1, "PERSON", 0, 7, 9, 0.7), (1, "CITY", 0, 0, 9, 0.1), (1, "PERSON", 1, 0, 5, 0.9)]
    df = spark.createDataFrame(rows, "doc_id long, head string, window_no int, start int, end int, confidence double")
    assert sorted((r.head, r.start, r.window_no) for r in spans.suppress(df).collect()) == [("CITY", 0, 0), ("PERSON", 0, 0), ("PERSON", 7, 0)]


def test_floor_rescues_the_best_inner_label(spark):
    df = spark.createDataFrame([("A", [1.0, 0.9, 0.9, 0.0, 0.0, 0.0, 0.0])], "head string, logits array<double>")
    assert emissions.decode(df).first().label_id == 0
    r = emissions.decode(df, floor=0.5).first()
    assert (r.label_id, r.rescued) == (1, True)


def test_union_grows_while_walking(spark):
    ddl = "doc_id long, start long, end long, head string, confidence double"
    base = spark.createDataFrame([(1, 0, 4, "ORG", 0.9)], ddl)
    extra = spark.createDataFrame([(1, 3, 6, "CITY", 0.99), (1, 5, 8, "CITY", 0.99), (1, 7, 9, "ORG", 0.99), (1, 20, 22, "ORG", 0.5)], ddl)
    assert sorted(r.start for r in segments.unite(base, extra).collect()) == [0, 5]


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20).select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))
    seen = []
    q = streams.analyze_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), lambda df, i: seen.append(df.count()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    from tessera.plans import detect

    assert sum(seen) == detect.analyze(spark.read.parquet(str(tmp_path / "in"))).count()


def test_softmax_zero_temperature_counts_as_one(spark):
    r = spark.range(1).select(emissions.softmax(F.array(F.lit(8.0), *[F.lit(0.0)] * 6), 0.0).alias("p")).first()
    assert abs(r.p[0] - 0.9979913) < 1e-6


def test_envelope_holds_each_entity_in_order(spark, sf):
    want = {}
    for r in registry.flagship(spark, sf).collect():
        want.setdefault(r.doc_id, []).append((r.start_index, r.end_index, r.text, r.type, r.confidence))
    got = {r.doc_id: json.loads(r.envelope)["entities"] for r in registry.queries()["sink_envelope"](spark, sf).collect()}
    assert {k: [(e["start_index"], e["end_index"], e["text"], e["type"], e["confidence"]) for e in v] for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_union_by_brute_force(spark):
    rnd = random.Random(5)
    row = lambda i: (i % 40, (s := rnd.randrange(60)), s + rnd.randrange(1, 9), rnd.choice(["ORG", "CITY"]), rnd.choice([0.5, 0.95, 0.99]))
    ddl = "doc_id long, start long, end long, head string, confidence double"
    base, extra = [row(i) for i in range(120)], [row(i) for i in range(400)]
    want = list(base)
    for x in sorted(extra, key=lambda x: (x[0], x[1], x[2], x[3], x[4])):
        if x[4] >= 0.95 and not any(y[0] == x[0] and y[1] < x[2] and y[2] > x[1] for y in want):
            want.append(x)
    got = segments.unite(spark.createDataFrame(base, ddl), spark.createDataFrame(extra, ddl)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)


def test_ranks_of_awkward_logs(spark):
    rows = [(1, v) for v in [-3.0, 0.0, 0.0, 1e9, 2.5, 2.5, 2.5, -1e-9]] + [(2, None), (3, 7.0), (None, 1.0), (None, 2.0)] + [(4, float(i % 97)) for i in range(1000)]
    df = spark.createDataFrame(rows, "model int, ms double")
    for serve in (True, False):
        got = {r.model: r for r in service.nearest_ranks(df, (0.0, 0.5, 0.95, 1.0), serve, buckets=8).collect()}
        assert len(got) == 5 and (got[2].n, got[2].p50) == (0, None)
        for m in (1, 3, None, 4):
            v = sorted(x for k, x in rows if k == m)
            for q in (0.0, 0.5, 0.95, 1.0):
                i = round(q * (len(v) - 1)) if serve else min(len(v) - 1, int(q * len(v)))
                assert got[m][f"p{round(q * 100)}"] == v[i]


def test_rolling_across_chunks(spark):
    start = datetime(2024, 1, 1, 0, 50)
    at = [0, 299, 300, 301, 600, 600, 700, 899, 1000, 5000]
    df = spark.createDataFrame([(i, start + timedelta(seconds=s), 1, 1.0) for i, s in enumerate(at)], "event_id long, ts timestamp, model int, ms double")
    got = {r.event_id: r.n_recent for r in service.rolling(df, 300, 300).collect()}
    assert got == {i: sum(s - 300 <= x <= s for x in at) for i, s in enumerate(at)}


def test_idle_periods_across_chunks(spark):
    start = datetime(2024, 1, 1, 0, 50)
    at = [0, 10, 69, 130, 190, 249, 250, 1000, 1059, 1119]
    df = spark.createDataFrame([(start + timedelta(seconds=s), m) for s in at for m in (1, 2)] * 2, "ts timestamp, model int")
    for chunk in (60, 100, 3600):
        got = sorted((r.model, r.requests, (r.loaded - start).seconds, (r.last_used - start).seconds) for r in service.idle_periods(df, 60, chunk).collect())
        assert got == sorted((m, *x) for m in (1, 2) for x in ((6, 0, 69), (2, 130, 130), (6, 190, 250), (4, 1000, 1059), (2, 1119, 1119)))


def test_clusters_keep_chains_together(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 4, 8), (1, 7, 9), (1, 9, 12), (1, 10, 11), (2, 0, 1)], "doc_id long, start long, end long")
    got = {(r.doc_id, r.start): r.cluster for r in spans.clusters(df, "doc_id").collect()}
    assert got == {(1, 0): 1, (1, 4): 1, (1, 7): 1, (1, 9): 2, (1, 10): 2, (2, 0): 1}


def _plan(docs, threshold, segment, emitter=detect.HASH, **options):
    return spans.projected(spans.merge_names(detect.entities(docs, threshold=threshold, segment=segment, emitter=emitter, **options)), emitter.space)


@pytest.mark.parametrize("threshold, segment, emitter, options", [
    (0.6, "none", detect.HASH, {"floor": 0.6}), (0.8, "sentence", detect.HASH, {}), (0.8, "auto", detect.HASH, {}), (0.5, "auto", emissions.emit_constant(40), {}),
    (0.5, "none", emissions.emit_hash(64, bias=4.0, temperatures={"PERSON": 2.0, "CITY": 0}), {"floor": 0.5}),
])
def test_scan_finds_what_the_plan_finds(spark, sf, threshold, segment, emitter, options):
    """In one pass, whose plan has no window, join or aggregate; on odd texts too, and with fewer words kept than there are."""
    odd = [None, "", " \n ", "a", "x" * 5000, 'Dr. Who?   Yes." No! ' * 300, "\x0b\x1c b\x85c 😀" * 80, "word " * 3000 + "\n\n", "。！".join(["語" * 40] * 200)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 4 = 0").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-i - 1, x) for i, x in enumerate(odd)], "doc_id long, text string"))
    got = detect.analyze(docs, threshold, segment=segment, emitter=emitter, **options)
    assert not re.search("Window|Join|Aggregate", got._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(str, got.collect())) == sorted(map(str, _plan(docs, threshold, segment, emitter, **options).collect()))


def test_scan_in_small_slices_and_tables(monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(1, 700))) for _ in range(12)]
    monkeypatch.setattr(scan, "_TABLES", {})
    whole = scan._Scan(detect.HASH, 0.5, ("origin", "name_part"))
    one = whole.entities(texts, [""] * 12, "none", 0.5, False, False)
    monkeypatch.setattr(scan, "WORDS", 50)
    monkeypatch.setattr(scan, "_TABLES", {})
    small = scan._Scan(detect.HASH, 0.5, ("origin", "name_part"))
    each = [small.entities([x], [""], "none", 0.5, False, False) for x in texts]
    key = lambda r, doc: list(zip(doc, r["from"] - r["text"], r["to"] - r["text"], r["head_idx"], r["confidence"], r["origin"], r["name_part"]))
    assert sorted(key(one, one["doc"])) == sorted(x for i, r in enumerate(each) for x in key(r, r["doc"] + i))
    assert len(small.table.ids) < len(whole.table.ids)


def test_pieces_of_a_scan_by_plain_loop():
    rnd = random.Random(4)
    options = ["word ", "x", ". ", '." ', "\n\n", "longer text here ", "y" * 50, "z" * 700, "! ", "é", "😀", "。 ", "w " * 400]
    for _ in range(400):
        text = "".join(rnd.choice(options) for _ in range(rnd.randrange(40)))
        assert scan.pieces(text) == plain_pieces(text)


def test_digests_of_many_texts():
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab1é語😀") for _ in range(rnd.randrange(40))).encode() for _ in range(500)]
    got = digests.first_bytes([b"PERSON:", b"ORG:"], texts, b":3")
    assert all(bytes(got[i, k]) == hashlib.md5(p + x + b":3").digest()[:8] for i, x in enumerate(texts) for k, p in enumerate((b"PERSON:", b"ORG:")))


def test_differences_count_repeated_rows(spark):
    """Two reads and one aggregation, where three set operations read both sides six times."""
    want = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (3, "c")], "k int, t string")
    got = spark.createDataFrame([(1, "a"), (2, None), (4, "d"), (4, "d")], "k int, t string")
    df = golden.differences(want, got, "k", "t")
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("missing", 1, "a")] * 2 + [("both", 1, "a"), ("both", 2, None), ("missing", 3, "c")] + [("unexpected", 4, "d")] * 2, key=str)
    assert sorted(map(tuple, golden.differences(want, got, "k", "t", once=True).collect()), key=str) == sorted([("both", 1, "a"), ("both", 2, None), ("missing", 3, "c"), ("unexpected", 4, "d")], key=str)


def test_first_failures_have_unknown_tiers_last(spark, monkeypatch):
    row = "doc_id long, start_index long, end_index long, text string, type string, tier string, confidence double"
    want = spark.createDataFrame([(i, 0, 1, "a", "CITY", "major", 0.9) for i in range(11)], row)
    got = spark.createDataFrame([(i, 0, 1, "a", "CITY", None, 0.9) for i in range(11)], row)
    monkeypatch.setattr(registry, "_golden", lambda *_: (want, got))
    found = registry.queries()["limit_failures"](spark, "").collect()
    assert [(r.doc_id, r.tier) for r in found] == [(i, t) for i in range(10) for t in ("major", None)]


@pytest.mark.parametrize("name", ["join_label_dim", "anti_overlap_any", "union_auto", "merge_persons", "except_guard", "except_golden"])
def test_texts_are_read_once_for_each_scan(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == (2 if name.startswith("except") else 1) and "Window" not in plan


@pytest.mark.parametrize("want, got, emitter", [
    ({}, {"threshold": 0.75, "floor": 0.75}, detect.HASH), ({"threshold": 0.5, "floor": 0.4}, {"threshold": 0.4}, detect.HASH), ({}, {"floor": 0.7}, emissions.emit_constant(40)),
    ({"floor": 0.6}, {"threshold": 0.5, "floor": 0.5}, emissions.emit_hash(64, bias=4.0, temperatures={"PERSON": 2.0, "CITY": 0})),
])
@pytest.mark.parametrize("repeated", [False, True])
def test_comparison_in_one_pass_is_that_of_the_join(spark, sf, want, got, emitter, repeated):
    """Unknown ids match nothing; rows that share an id are compared as one, and only they are joined."""
    odd = ["x" * 5000, 'Dr. Who?   Yes." No! ' * 300, "\x0b\x1c b\x85c 😀" * 80, "word " * 3000 + "\n\n", "。！".join(["語" * 40] * 200), None, ""]
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 8 = 0").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([*((-i - 1, x) for i, x in enumerate(odd)), *((None, odd[i]) for i in (1, 1, 3))], "doc_id long, text string"))
    if repeated:
        docs = docs.union(docs.filter("doc_id % 16 = 0")).union(docs.filter("doc_id % 16 = 0").withColumn("text", F.substring("text", 1, 300)))
    df = detect.compared(docs, want, got, registry._changed, emitter)
    assert ("Join" in df._jdf.queryExecution().optimizedPlan().toString()) == repeated
    found = detect.analyze(docs, emitter=emitter, **got)
    confidence, tier = registry._changed(found["confidence"], found["tier"])
    expected = golden.compare(detect.analyze(docs, emitter=emitter, **want), found.withColumns({"confidence": confidence, "tier": tier}))
    rows = sorted(map(str, df.collect()))
    assert df.columns == expected.columns and rows == sorted(map(str, expected.collect()))
    assert all(any(f"kind='{k}'" in r for r in rows) for k in ("missing", "unexpected", "drift", "equal"))


def test_comparison_where_heads_share_a_type(spark, sf):
    """Two heads may then have an entity at one place, so pairs would not do."""
    space = replace(detect.HASH.space, api=[(h, None, "THING") for h in detect.HASH.space.heads])
    emitter = replace(emissions.emit_hash(bias=4.0), space=space)
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 16 = 0")
    rows = [sorted(map(str, x.collect())) for x in (detect.compared(docs, {}, {}, lambda *x: x, emitter), golden.compare(detect.analyze(docs, emitter=emitter), detect.analyze(docs, emitter=emitter)))]
    assert rows[0] == rows[1] and rows[0]


def test_golden_comparison_reads_texts_once(spark, sf):
    plan = registry.queries()["join_golden"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and not re.search("Join|Aggregate|Window", plan)
