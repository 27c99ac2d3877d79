"""Where scores come from, and what turns them into labels.

An Emitter's rows are a token each and head: doc_id, first_window, last_window, tok, seq, start, end, piece, after, head, head_idx, logits
(one for each label) and whatever its attributes need. seq numbers the tokens without the special ones (start = end), so two tokens
are neighbours if their seq are. piece is the text from the end of the token before to the token's end, after the character behind it.

emit_constant and emit_hash are test stimuli, not detectors: hash scores are the bytes of md5(head:word:place). sources.onnx has a
model's.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digests, labels
from . import tokens

#: Added to the score of O, so that most tokens are outside; and what a byte is divided by.
OUTSIDE_BIAS, SCALE = 12.0, 16.0
#: A word's score depends on its place in the decoded text modulo this, so that a sentence by itself scores otherwise than in its document.
PLACES = 4
ATTRIBUTE_BYTES = 7


@dataclass(frozen=True)
class Words:
    """The same scores for operators.scan, where they depend on a word and its place modulo PLACES alone. score: (words, place) -> an array by word, head and
    label; base: words -> an array by word of what spans average. key: equal for equal scores."""

    key: tuple
    score: Callable[[list[bytes], int], np.ndarray]
    base: Callable[[list[bytes]], np.ndarray]
    window: int


@dataclass(frozen=True)
class Emitter:
    """score: texts (doc_id, text, next) -> rows as above. base: adds the columns b0, b1, ... that a span averages over its tokens.
    classes: (attribute, averaged columns) -> a score for each class. subword: tokens may be parts of words, so repairs inside words
    have something to repair; it needs the texts again. words: see Words; without them everything goes through score.
    """

    score: Callable[[DataFrame], DataFrame]
    base: Callable[[DataFrame], DataFrame]
    width: int
    classes: Callable[[str, list[Column]], list[Column]]
    space: labels.LabelSpace = labels.DEFAULT
    subword: bool = False
    temperatures: Mapping[str, float] | None = None
    words: Words | None = None


def _number(text: Column) -> Column:
    """The first 7 bytes of the text's md5 as one number."""
    return F.conv(F.substring(F.md5(text), 1, 14), 16, 10).cast("long")


def _byte(number: Column, i: int) -> Column:
    return F.shiftright(number, 48 - 8 * i).bitwiseAND(255).cast("double")


def _words(texts: DataFrame, window: int) -> DataFrame:
    """Word tokens with their windows, a row for each head."""
    heads = F.array(*(F.struct(F.lit(h).alias("head"), F.lit(i).alias("head_idx")) for i, h in enumerate(labels.DEFAULT.heads)))
    rows = tokens.with_window_range(tokens.word_tokens(texts), window).withColumn("seq", F.col("tok"))
    return rows.withColumn("h", F.explode(heads)).select("*", "h.head", "h.head_idx").drop("h")


def _hash_base(rows: DataFrame) -> DataFrame:
    n = _number(F.concat(F.lit("attr:"), "word"))
    return rows.withColumn("_n", n).select("*", *(_byte(F.col("_n"), i).alias(f"b{i}") for i in range(ATTRIBUTE_BYTES))).drop("_n")


def _word_base(words: list[bytes]) -> np.ndarray:
    return digests.first_bytes([b"attr:"], words, b"")[:, 0, :ATTRIBUTE_BYTES].astype(float)


#: Where an attribute's classes begin among the bytes.
ATTRIBUTE_OFFSETS = {"origin": 0, "gender_expression": 3, "name_part": 7}


def _hash_classes(name: str, averaged: list[Column]) -> list[Column]:
    """A class's score is one of a few bytes plus a constant, so their means are all that has to be pooled."""
    n = len(labels.DEFAULT.attributes[name][1])
    return [averaged[(c + ATTRIBUTE_OFFSETS[name]) % ATTRIBUTE_BYTES] / 32.0 + c / 64.0 for c in range(n)]


def emit_hash(window: int = tokens.WINDOW, bias: float = OUTSIDE_BIAS, temperatures: Mapping[str, float] | None = None) -> Emitter:
    def score(texts: DataFrame) -> DataFrame:
        rows = _words(texts, window)
        place = (F.col("tok") % PLACES).cast("string")
        rows = rows.withColumn("digest", _number(F.concat_ws(":", "head", "word", place)))
        logits = F.array(*(_byte(F.col("digest"), i) / SCALE + (bias if i == 0 else 0.0) for i in range(7)))
        return rows.withColumn("logits", logits).drop("digest")

    def of_words(words: list[bytes], place: int) -> np.ndarray:
        logits = digests.first_bytes([f"{h}:".encode() for h in labels.DEFAULT.heads], words, f":{place}".encode())[:, :, :7] / SCALE
        logits[:, :, 0] += bias
        return logits

    return Emitter(score, _hash_base, ATTRIBUTE_BYTES, _hash_classes, temperatures=temperatures, words=Words(("hash", bias, window), of_words, _word_base, window))


def emit_constant(window: int = tokens.WINDOW) -> Emitter:
    """Every word scores 8 for its hot label and 0 else: B-PERSON-COMMON for PERSON, O for other heads."""

    def score(texts: DataFrame) -> DataFrame:
        hot = F.when(F.col("head") == "PERSON", 1).otherwise(0)
        return _words(texts, window).withColumn("logits", F.array(*(F.when(hot == i, 8.0).otherwise(0.0) for i in range(7))))

    def of_words(words: list[bytes], place: int) -> np.ndarray:
        logits = np.zeros((len(words), len(labels.DEFAULT.heads), 7))
        for h, head in enumerate(labels.DEFAULT.heads):
            logits[:, h, int(head == "PERSON")] = 8.0
        return logits

    return Emitter(score, _hash_base, ATTRIBUTE_BYTES, _hash_classes, words=Words(("constant", window), of_words, _word_base, window))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Stable softmax of logits / temperature; a temperature of 0 or null counts as 1."""
    t = F.lit(temperature) if not isinstance(temperature, Column) else temperature
    t = F.when(t.isNull() | (t == 0), 1.0).otherwise(t)
    e = F.transform(logits, lambda x: F.exp(x / t - F.array_max(logits) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def decode(rows: DataFrame, floor: float | None = None, temperatures: Mapping[str, float] | None = None, labels_of_head: int = 7) -> DataFrame:
    """label_id, confidence, rescued from the logits. With a floor, an O whose 1 - P(O) reaches it becomes the best other label.

    temperatures: by head; none and 0 count as 1. The best label's probability is 1 / sum(exp((l - max) / t)), so plain arithmetic on
    the array's items is enough and stays in generated code.
    """
    scaled = {h: t for h, t in (temperatures or {}).items() if t and t != 1.0}
    t = reduce(lambda out, ht: F.when(F.col("head") == ht[0], float(ht[1])).otherwise(out), scaled.items(), F.lit(1.0))
    rows = rows.withColumns({"top": F.array_max("logits"), "inner": F.array_max(F.slice("logits", 2, labels_of_head - 1))})
    part = lambda i: F.exp((F.col("logits")[i] - F.col("top")) / t) if scaled else F.exp(F.col("logits")[i] - F.col("top"))
    rows = rows.withColumn("total", sum((part(i) for i in range(1, labels_of_head)), part(0)))
    best, conf, rescued = F.array_position("logits", F.col("top")) - 1, 1.0 / F.col("total"), F.lit(False)
    if floor is not None:
        inside = 1 - part(0) / F.col("total")
        rescued = (best == 0) & (inside >= floor)
        best, conf = F.when(rescued, F.array_position(F.slice("logits", 2, labels_of_head - 1), F.col("inner"))).otherwise(best), F.when(rescued, inside).otherwise(conf)
    return rows.select("*", best.cast("int").alias("label_id"), conf.alias("confidence"), rescued.alias("rescued")).drop("logits", "top", "inner", "total")
