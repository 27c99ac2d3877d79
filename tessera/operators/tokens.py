"""Tokens and windows. Every frame is keyed by doc_id and dealt by it once; later windows and groups reuse that.

doc_id may be of any type: pieces of documents have a struct there, which says where they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import WS, scrub, trim_left

WINDOW = 128


def overlap(window: int = WINDOW) -> int:
    return max(32, window // 8)


def step(window: int = WINDOW) -> int:
    return window - 2 - overlap(window)


def scrubbed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next): next is the character behind the text, none for whole documents."""
    return docs.select("doc_id", scrub(F.coalesce("text", F.lit(""))).alias("text"), F.lit("").alias("next"))


def word_tokens(texts: DataFrame) -> DataFrame:
    """(doc_id, tok, start, end, word, piece, after) of every word, in code points; piece: the word with the white space before it,
    after: the first character behind it."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(parts, "doc_id")  # a fixed number: texts are small beside what grows from them
    pieces = dealt.select("doc_id", "next", F.posexplode(F.regexp_extract_all("text", F.lit(f"[{WS}]*[^{WS}]+"), F.lit(0))).alias("tok", "piece"))
    w = Window.partitionBy("doc_id").orderBy("tok")
    after = F.coalesce(F.substring(F.lead("piece").over(w), 1, 1), "next")
    rows = pieces.select("doc_id", "tok", "piece", F.sum(F.length("piece")).over(w).alias("end"), after.alias("after"), trim_left(F.col("piece")).alias("word"))
    return rows.withColumn("start", F.col("end") - F.length("word"))


def window_count(content: Column, window: int = WINDOW) -> Column:
    """Windows that cover so many content tokens, with two special tokens in each."""
    room = window - 2
    return F.when(content <= room, 1).otherwise(1 + F.ceil((content - room) / F.lit(step(window)))).cast("long")


def with_window_range(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """first_window and last_window of each token: window k holds tokens k * step .. k * step + window - 3."""
    room, s = window - 2, step(window)
    n = F.count("*").over(Window.partitionBy("doc_id"))
    first = F.greatest(F.lit(0), F.floor((F.col("tok") - room) / F.lit(s)) + 1).cast("int")
    last = F.least(F.floor(F.col("tok") / F.lit(s)), window_count(n, window) - 1).cast("int")
    return tokens.withColumns({"first_window": first, "last_window": last})


def in_windows(ranged: DataFrame) -> DataFrame:
    """A row for each window that holds the token."""
    return ranged.withColumn("window_no", F.explode(F.sequence("first_window", "last_window"))).drop("first_window", "last_window")
