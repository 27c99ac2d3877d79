"""Sentence-sized pieces of long texts, and the union of whole-text and sentence-wise entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import WS, trim_left, trim_right
from . import spans

#: Pieces shorter than SHORT join the one before; runs longer than LONG are cut; texts longer than AUTO get a sentence
#: pass, whose entities need SURE confidence.
SHORT, LONG, AUTO, SURE = 24, 600, 1200, 0.95
TERMINATORS, CLOSERS = ".!?…。！？", "\"'»”’)\\]"
#: A terminator, closers and white space, or a blank line. The terminator belongs to the piece before it.
BOUNDARY = rf"[{TERMINATORS}][{CLOSERS}]*[{WS}]+|\n[ \t]*\n"
#: The next part of a run, and the white space to skip behind it: while more than LONG is left, up to the last space in reach that leaves
#: SHORT, or LONG characters where there is none; then the rest.
PART = rf"(?s)((?=.{{{LONG + 1}}})(?:.{{{SHORT},{LONG - 1}}}(?= )|.{{{LONG}}})|.{{1,{LONG}}})[{WS}]*"


def sentence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(BOUNDARY)).cast("long") + 1


def sentence_rows(texts: DataFrame) -> DataFrame:
    """(doc_id, i, at, raw, next, start, end) of every stretch between boundaries: raw is its text with the boundary behind it and begins at `at`; start and end are those
    of the sentence without white space, equal if nothing is left."""
    both = F.arrays_zip(F.split("text", BOUNDARY, -1).alias("body"), F.regexp_extract_all("text", F.lit(BOUNDARY), F.lit(0)).alias("gap"))
    rows = texts.select("doc_id", F.posexplode(both).alias("i", "x")).select("doc_id", "i", F.col("x.body").alias("body"), F.coalesce("x.gap", F.lit("")).alias("gap"))
    rows = rows.withColumns({"raw": F.concat("body", "gap"), "own": F.concat("body", F.regexp_extract("gap", f"^[{TERMINATORS}]", 0))})
    rows = rows.withColumn("at", F.sum(F.length("raw")).over(Window.partitionBy("doc_id").orderBy("i")) - F.length("raw"))
    left = trim_left(F.col("own"))
    rows = rows.withColumn("start", F.col("at") + F.length("own") - F.length(left))
    return rows.select("doc_id", "i", "at", "raw", "start", (F.col("start") + F.length(trim_right(left))).alias("end"))


def island_rows(texts: DataFrame) -> DataFrame:
    """(doc_id, island, raw, at, start, end, tail): a sentence of at least SHORT, or the text's first, from start to end, and the shorter ones behind
    it up to tail; raw is the text of all from `at` on."""
    w = Window.partitionBy("doc_id").orderBy("i")
    rows = sentence_rows(texts).withColumn("some", F.col("start") < F.col("end"))
    heads = F.col("some") & ((F.col("end") - F.col("start") >= SHORT) | (F.sum(F.col("some").cast("int")).over(w) == 1))
    rows = rows.withColumn("heads", heads).withColumn("island", F.sum(F.col("heads").cast("int")).over(w)).filter("island > 0")
    item = F.array_sort(F.collect_list(F.struct("i", "raw")))
    one = rows.groupBy("doc_id", "island").agg(
        F.array_join(F.transform(item, lambda x: x["raw"]), "").alias("raw"), F.min("at").alias("at"), F.max(F.when(F.col("some"), F.col("end"))).alias("tail"),
        *(F.max(F.when(F.col("heads"), F.col(c))).alias(c) for c in ("start", "end")),
    )
    return one


def piece_rows(texts: DataFrame) -> DataFrame:
    """(doc_id, piece_no, start, end, text, next) of every piece; next: the character behind it.

    The head of an island is cut into parts of at most LONG, and the last part reaches to the island's end, however long that gets. Texts
    without other than white space have no piece.
    """
    one = island_rows(texts).withColumn("head", F.expr("substr(raw, cast(start - at as int) + 1, cast(end - start as int))"))
    parts = F.arrays_zip(F.regexp_extract_all("head", F.lit(PART), F.lit(1)).alias("part"), F.regexp_extract_all("head", F.lit(PART), F.lit(0)).alias("all"))
    one = one.withColumn("parts", parts).withColumn("n", F.size("parts")).select("*", F.posexplode("parts").alias("k", "p"))
    before = F.aggregate(F.slice("parts", 1, F.col("k")), F.lit(0), lambda acc, x: acc + F.length(x["all"]))
    one = one.withColumn("begin", F.col("start") + before)
    one = one.withColumn("stop", F.when(F.col("k") == F.col("n") - 1, F.col("tail")).otherwise(F.col("begin") + F.length("p.part")))
    cut = "substr(raw, cast(begin - at as int) + 1, cast(stop - begin as int))", "substr(raw, cast(stop - at as int) + 1, 1)"
    one = one.select("doc_id", F.col("begin").alias("start"), F.col("stop").alias("end"), F.expr(cut[0]).alias("text"), F.expr(cut[1]).alias("next"))
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    return one.select("doc_id", no.cast("long").alias("piece_no"), "start", "end", "text", "next")


def as_texts(pieces: DataFrame) -> DataFrame:
    """The pieces as texts of their own; doc_id becomes (doc_id, piece_no, start), so what is found in a piece knows where it stands."""
    return pieces.select(F.struct("doc_id", "piece_no", "start").alias("doc_id"), "text", "next")


def lifted(found: DataFrame) -> DataFrame:
    """What was found in pieces, in their documents' offsets, with piece_no."""
    shifted = {c: F.col(c) + F.col("doc_id.start") for c in ("start", "end")}
    return found.withColumns({**shifted, "piece_no": F.col("doc_id.piece_no"), "doc_id": F.col("doc_id.doc_id")})


def unite(base: DataFrame, extra: DataFrame) -> DataFrame:
    """base entities (extra false), and those of extra (extra true) that are sure and overlap none accepted so far, whatever its type.

    Both have doc_id, start, end, head, head_idx, confidence and the same other columns. The accepted set grows while extra is walked in order
    of (start, end, head), so this is a fold; only a cluster of overlapping entities is folded.
    """
    fields = [*(c for c in base.columns if c != "doc_id"), "extra"]
    both = base.withColumn("extra", F.lit(False)).unionByName(extra.filter(F.col("confidence") >= SURE).withColumn("extra", F.lit(True)))
    item = F.struct(F.col("start").alias("k1"), F.col("end").alias("k2"), F.col("head").alias("k3"), F.col("confidence").alias("k4"), *fields)
    lists = spans.clusters(both, "doc_id").groupBy("doc_id", "cluster").agg(*(F.array_sort(F.collect_list(F.when(F.col("extra") == e, item))).alias(name) for e, name in ((False, "own"), (True, "more"))))
    fold = F.aggregate("more", F.col("own"), lambda acc, x: F.when(spans.clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return lists.select("doc_id", F.explode(F.when(F.size("more") == 0, F.col("own")).otherwise(fold)).alias("x")).select("doc_id", *(f"x.{c}" for c in fields))
