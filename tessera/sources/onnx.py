"""A real token classifier as an emission source: onnxruntime inside Arrow batches, one session per Python worker."""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import emissions
from . import files

#: Windows of one text that a model call takes at most.
CALL = 16


@dataclass(frozen=True)
class Bundle:
    """A model folder's settings: config.json's block, calibration.json's temperatures and the label file that it names."""

    folder: str
    heads: list[str]
    window: int
    stride: int
    space: labels.LabelSpace
    temperatures: dict[str, float]
    floor: float | None
    proclitics: bool
    threshold: float


def read_bundle(spark: SparkSession, path: str, block: str, window: int | None = None) -> Bundle:
    """block: the key in config.json that holds the heads; a bundle without it is an error, as is a labels file outside the folder. A
    temperature of 0 or none counts as 1; the window is the caller's, else the bundle's, else 512."""
    meta = json.loads(files.read(spark, f"{path}/config.json")).get(block)
    if not meta:
        raise ValueError(f"config.json has no block {block}")
    name = meta.get("labels_file", "labels-v2.0.yaml")
    if name in ("", ".") or any(x in name for x in ("/", "\\", "..")):
        raise ValueError(f"not a plain file name: {name!r}")
    calibration = f"{path}/calibration.json"
    heat = json.loads(files.read(spark, calibration)) if files.exists(spark, calibration) else {}
    size, decoder = int(window or meta.get("max_length") or 512), meta.get("decoder") or {}
    threshold = decoder.get("serve_threshold")
    numeric = isinstance(threshold, (int, float)) and not isinstance(threshold, bool)
    proclitics = str(decoder.get("proclitic_completion") or "").strip().lower()
    if proclitics not in ("he", "", "off", "none", "no", "0", "false"):
        raise ValueError(f"unknown completion: {proclitics!r}")
    floor = decoder.get("recall_floor")
    return Bundle(
        path, list(meta["heads"]), size, max(32, size // 8), labels.parse(files.read(spark, f"{path}/{name}").decode()), {h: float(heat.get(h, 1.0)) or 1.0 for h in meta["heads"]},
        None if floor is None else float(floor), proclitics == "he", float(threshold) if numeric else 0.7,
    )


def activate(name: str, load: Callable):
    """What load() gives, loaded once in this Python process, however many tasks ask for it. Workers run one task at a time, so nothing is shared
    between threads."""
    held = sys.modules.setdefault("_tessera_loaded", types.ModuleType("_tessera_loaded")).__dict__.setdefault("by_name", {})
    if name not in held:
        held[name] = load()
    return held[name]


def emitter(spark: SparkSession, bundle: Bundle, onnx: str = "quant/model-fp32.onnx", providers: tuple[str, ...] = ("CPUExecutionProvider",)) -> emissions.Emitter:
    """The bundle's model as an emission source. Its folder goes to every executor once (addFile), so folders' names tell models apart.

    A text's windows overlap by stride tokens. Its special tokens have start = end. logits_<head> are outputs with a logit for each label,
    attr_logits_<attribute> with one for each class; a missing one leaves the attribute without classes.
    """
    spark.sparkContext.addFile(bundle.folder, recursive=True)
    folder = bundle.folder.rstrip("/").rsplit("/", 1)[-1]
    heads, window, stride = bundle.heads, bundle.window, bundle.stride
    head_idx = {h: list(bundle.space.heads).index(h) for h in heads}
    attributes = list(bundle.space.attributes)
    sizes = [len(c) for _, c in bundle.space.attributes.values()]
    starts = dict(zip(attributes, np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()))
    width = sum(sizes)
    kinds = {"first_window": pa.int32(), "last_window": pa.int32(), "tok": pa.int32(), "seq": pa.int32(), "start": pa.int64(), "end": pa.int64(), "piece": pa.string(), "after": pa.string(), "head": pa.string(), "head_idx": pa.int32(), "logits": pa.list_(pa.float64()), "pooled": pa.list_(pa.float64())}

    def load():
        import onnxruntime as ort
        from tokenizers import Tokenizer

        at = SparkFiles.get(folder)
        options = ort.SessionOptions()
        options.intra_op_num_threads = 1
        coder = Tokenizer.from_file(f"{at}/tokenizer/tokenizer.json")
        coder.enable_truncation(window, stride=stride)
        coder.no_padding()
        return ort.InferenceSession(f"{at}/{onnx}", options, providers=list(providers)), coder

    def rows_of(text: str, after_text: str, session, coder, names: list[str]):
        first = coder.encode(text)
        cuts = [first, *first.overflowing]
        for k in range(0, len(cuts), CALL):
            part = cuts[k : k + CALL]
            longest = max(len(p.ids) for p in part)
            ids, mask = np.zeros((len(part), longest), np.int64), np.zeros((len(part), longest), np.int64)
            for r, p in enumerate(part):
                ids[r, : len(p.ids)], mask[r, : len(p.ids)] = p.ids, 1
            out = dict(zip(names, session.run(None, {"input_ids": ids, "attention_mask": mask})))
            for r, p in enumerate(part):
                before, seq = None, 0
                for t, (s, e) in enumerate(p.offsets):
                    piece = text[s if before is None else min(before, s) : e] if e > s else ""
                    after = text[e : e + 1] or after_text
                    pooled = np.concatenate([out[f"attr_logits_{a}"][r, t] if f"attr_logits_{a}" in out else np.full(n, np.nan) for a, n in zip(attributes, sizes)]).astype(float).tolist()
                    for h in heads:
                        yield k + r, k + r, t, seq, s, e, piece, after, h, head_idx[h], out[f"logits_{h.lower()}"][r, t].astype(float).tolist(), pooled
                    if e > s:
                        before, seq = e, seq + 1

    def score(texts: DataFrame) -> DataFrame:
        def run(batches):
            session, coder = activate(f"{folder}/{onnx}/{window}", load)
            names = [o.name for o in session.get_outputs()]
            for b in batches:
                for i, text, after in zip(b["doc_id"], b["text"].to_pylist(), b["next"].to_pylist()):
                    cols = list(zip(*rows_of(text or "", after or "", session, coder, names)))
                    if cols:
                        n = len(cols[0])
                        yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * n, i.type), *(pa.array(c, k) for c, k in zip(cols, kinds.values()))], names=["doc_id", *kinds])

        doc = texts.schema["doc_id"].dataType.simpleString()
        ddl = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string"}
        return texts.select("doc_id", "text", "next").mapInArrow(run, f"doc_id {doc}, " + ", ".join(f"{c} {ddl.get(k, 'array<double>')}" for c, k in kinds.items()))

    def base(rows: DataFrame) -> DataFrame:
        return rows.select(*(c for c in rows.columns if c != "pooled"), *(F.col("pooled")[i].alias(f"b{i}") for i in range(width)))

    def classes(name: str, averaged: list[Column]) -> list[Column]:
        return [F.when(~F.isnan(c), c) for c in averaged[starts[name] : starts[name] + len(bundle.space.attributes[name][1])]]

    return emissions.Emitter(score, base, width, classes, bundle.space, True, bundle.temperatures)
