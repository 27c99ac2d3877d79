"""A tiny model file through the pipeline, against plain loops."""

import json
import random
import re

import numpy as np
import pytest

from tessera.functions import labels
from tessera.plans import detect
from tessera.sources import files, onnx

HEBREW, MARKS, GERESH = "אבגדהולמנש", "ְַ", "'׳״"
STOPS = set('.,;:!?()[]{}"«»')


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(no, value):
    if isinstance(value, int):
        return _varint(no << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(no << 3 | 2) + _varint(len(value)) + value


def _value(name, kind, rank):
    shape = b"".join(_field(1, _field(2, f"{name}{i}")) for i in range(rank))
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def gather_model(tables):
    """An ONNX graph whose output `name` is a row of tables[name] for each input id."""
    graph = b"".join(_field(1, _field(1, f"{n}_table") + _field(1, "input_ids") + _field(2, n) + _field(4, "Gather")) for n in tables) + _field(2, "g")
    for n, t in tables.items():
        dims = b"".join(_field(1, d) for d in t.shape)
        graph += _field(5, dims + _field(2, 1) + _field(8, f"{n}_table") + _field(9, t.astype("<f4").tobytes()))
    graph += _field(11, _value("input_ids", 7, 2)) + _field(11, _value("attention_mask", 7, 2)) + b"".join(_field(12, _value(n, 1, 3)) for n in tables)
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


@pytest.fixture(scope="module")
def bundle(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    chars = sorted(set(HEBREW + MARKS + GERESH + "abcxyz .-,"))
    words = ["[UNK]", "[CLS]", "[SEP]", *chars, *("##" + c for c in chars)]
    vocabulary = {w: i for i, w in enumerate(words)}
    coder = Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=1000))
    coder.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    coder.post_processor = processors.TemplateProcessing("[CLS] $A [SEP]", None, [("[CLS]", 1), ("[SEP]", 2)])
    rng = np.random.default_rng(5)
    space = labels.DEFAULT
    tables = {f"logits_{h.lower()}": rng.normal(0, 3, (len(words), 7)) + [2, 0, 2, 0, 0, 0, 0] for h in space.heads}
    for t in tables.values():  # a joint is outside, as a model that stumbles over it has it
        t[[vocabulary[p + c] for p in ("", "##") for c in GERESH + "-"]] = [9, 0, 0, 0, 0, 0, 0]
    tables |= {f"attr_logits_{a}": rng.normal(0, 1, (len(words), len(c))) for a, (_, c) in space.attributes.items()}
    tables = {n: t.astype(np.float32) for n, t in tables.items()}
    folder = files.scratch(spark) + "/tiny"
    files.put(spark, f"{folder}/config.json", json.dumps({"spans": {"heads": list(space.heads), "max_length": 96, "labels_file": "own.yaml", "decoder": {"proclitic_completion": "he", "recall_floor": 0.6, "serve_threshold": 0.5}}}))
    files.put(spark, f"{folder}/calibration.json", json.dumps({"PERSON": 1.5, "CITY": 0}))
    files.put(spark, f"{folder}/own.yaml", labels.DEFAULT_TEXT)
    files.put(spark, f"{folder}/tokenizer/tokenizer.json", coder.to_str())
    files.put(spark, f"{folder}/quant/model-fp32.onnx", gather_model(tables))
    return onnx.read_bundle(spark, folder, "spans"), coder, tables


def loop(text, bundle, coder, tables, floor, inword, proclitics):
    """Entities of one text as rules read, window by window."""
    space, found = bundle.space, []
    coder.enable_truncation(bundle.window, stride=bundle.stride)
    first = coder.encode(text)
    for number, enc in enumerate([first, *first.overflowing]):
        tokens = [(i, s, e) for i, (s, e) in zip(enc.ids, enc.offsets) if s < e]
        spans = []
        for hi, (head, (_, names)) in enumerate(space.heads.items()):
            run = None
            for i, s, e in tokens:
                z = tables[f"logits_{head.lower()}"][i].astype(float) / bundle.temperatures[head]
                p = np.exp(z - z.max())
                p /= p.sum()
                k, conf, rescued = int(p.argmax()), float(p.max()), False
                if floor is not None and k == 0 and 1 - p[0] >= floor:
                    k, conf, rescued = 1 + int(p[1:].argmax()), float(1 - p[0]), True
                if k == 0:
                    run = None
                elif names[k].startswith("B") or run is None:
                    run = {"s": s, "e": e, "head": head, "hi": hi, "tier": names[k].split("-")[2].lower(), "c": [conf], "floor": rescued}
                    spans.append(run)
                else:
                    run["e"], run["c"], run["floor"] = e, [*run["c"], conf], run["floor"] or rescued
        for x in spans:
            x["c"] = round(sum(x["c"]) / len(x["c"]), 6)
        spans.sort(key=lambda x: (x["s"], x["e"], x["hi"]))
        he = lambda c: "א" <= c <= "ת"
        rules = [lambda g, w, x, y: set(g) <= set("'׳״’") and set(w) & set("'׳״’") and not re.search(r"\s", w) and (he(text[x["e"] - 1]) or he(text[y["s"]]))]
        if inword:
            rules.append(lambda g, w, x, y: len(g) <= inword and not set(g) & STOPS and not re.search(r"\s", w))
        for rule in rules:
            kept = []
            for y in spans:
                x = kept[-1] if kept else None
                if x and x["head"] == y["head"] and y["s"] >= x["e"] and rule(text[x["e"] : y["s"]], text[x["s"] : y["e"]], x, y):
                    x |= {"e": y["e"], "c": round((x["c"] + y["c"]) / 2, 6), "floor": x["floor"] or y["floor"]}
                else:
                    kept.append(y)
            spans = kept
        if proclitics:
            ends = {}
            for x in spans:
                at = x["s"]
                if at and he(text[at]) and he(text[at - 1]):
                    begin = at
                    while begin and (he(text[begin - 1]) or text[begin - 1] in MARKS):
                        begin -= 1
                    lead = "".join(c for c in text[begin:at] if c not in MARKS)
                    if re.fullmatch("(ו|ש|כש)?(ב|ל|מ|כ)?(ה)?", lead) and lead and not (begin and text[begin - 1].isalpha()) and begin >= ends.get(x["head"], 0):
                        x["s"] = begin
                ends[x["head"]] = max(ends.get(x["head"], 0), x["e"])
        for x in spans:
            ids = [i for i, s, e in tokens if s < x["e"] and e > x["s"]]
            for a, (heads, classes) in space.attributes.items():
                x[a] = classes[int(np.mean(tables[f"attr_logits_{a}"][ids].astype(float), axis=0).argmax())] if x["head"] in heads else None
        found += [x | {"w": number} for x in sorted(spans, key=lambda x: (x["s"], x["e"], x["hi"]))]
    kept = []
    for x in sorted(found, key=lambda x: (-x["c"], x["w"], x["s"], x["e"])):
        if not any(y["head"] == x["head"] and y["s"] < x["e"] and y["e"] > x["s"] for y in kept):
            kept.append(x)
    return {(x["s"], x["e"], x["head"], text[x["s"] : x["e"]], x["tier"], "floor" if x["floor"] else "argmax", x["origin"], x["gender_expression"], x["name_part"]): x["c"] for x in kept}


@pytest.mark.parametrize("inword, proclitics, floor", [(0, True, 0.6), (1, False, None)])
def test_model_by_plain_loop(spark, bundle, inword, proclitics, floor):
    settings, coder, tables = bundle
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice(HEBREW if rnd.random() < 0.9 else MARKS + GERESH + "-") for _ in range(rnd.randrange(1, 6))) if rnd.random() < 0.7 else "".join(rnd.choice("abcxyz-.,") for _ in range(rnd.randrange(1, 5)))
    texts = ["", "   ", *(" ".join(word() for _ in range(rnd.randrange(1, 120))) for _ in range(40)), "abc xyz a-b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in detect.entities(docs, emitter=onnx.emitter(spark, settings), floor=floor, inword=inword, proclitics=proclitics).collect():
        got.setdefault(r.doc_id, {})[(r.start, r.end, r.head, r.surface, r.tier, r.evidence, r.origin, r.gender, r.name_part)] = r.confidence
    grown = 0
    for i, t in enumerate(texts):
        want = loop(t, settings, coder, tables, floor, inword, proclitics)
        assert set(got.get(i, {})) == set(want)
        assert all(abs(got[i][k] - c) < 2e-6 for k, c in want.items())
        grown += len(want)
    assert grown > 500


def test_bundle_settings_and_pieces(spark, bundle):
    settings, *_ = bundle
    assert (settings.window, settings.stride, settings.temperatures, settings.floor, settings.proclitics, settings.threshold) == (96, 32, {"PERSON": 1.5, "CITY": 1.0, "STREET": 1.0, "ORG": 1.0}, 0.6, True, 0.5)
    text = "אבג דהו. " * 200
    found = detect.analyze(spark.createDataFrame([(1, text)], "doc_id long, text string"), 0.5, segment="auto", emitter=onnx.emitter(spark, settings)).collect()
    assert found and all(text[r.start_index : r.end_index] == r.text for r in found)
    with pytest.raises(ValueError):
        onnx.read_bundle(spark, settings.folder, "other")


def test_labels_from_yaml():
    text = labels.DEFAULT_TEXT.replace("'NO'", "NO")
    assert "False" in labels.parse(text).attributes["origin"][1]  # stays text, whatever YAML makes of it
    with pytest.raises(ValueError):
        labels.parse(labels.DEFAULT_TEXT.replace("labels: [O, B-CITY", "labels: [B-CITY"))


def test_model_is_loaded_once_in_a_process():
    loads = []
    assert onnx.activate("test", lambda: loads.append(1) or loads) is onnx.activate("test", lambda: loads.append(2) or loads) and loads == [1]


def test_no_scratch_folder_on_a_cluster():
    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = {}, type("Context", (), {"master": master})

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            files.scratch(Session(master))
    assert files.scratch(Session("local[4]")).startswith("/")
