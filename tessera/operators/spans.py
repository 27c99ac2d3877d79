"""From labels to entities: constrained IOB2 decoding, attributes, overlap suppression, name merging, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels
from ..functions.text import trim_left, trim_right
from .emissions import Emitter

THRESHOLD = 0.7


def with_labels(decoded: DataFrame, space: labels.LabelSpace = labels.DEFAULT) -> DataFrame:
    """prefix and tier of the label id; ids without a label are O. One table, head after head, is looked up by place.

    They come out of a generator of one row, which keeps the optimiser from putting a filter on prefix or rescued before the scores and working them out
    once for each time the filter names them.
    """
    width = max(len(names) for _, names in space.heads.values())
    prefixes, tiers = [["O"] * width for _ in space.heads], [[None] * width for _ in space.heads]
    for _, h, i, _, prefix, tier in space.label_rows():
        prefixes[h][i], tiers[h][i] = prefix, tier
    place = F.when(F.col("label_id") < width, F.col("head_idx") * width + F.col("label_id")).otherwise(-1)
    of = lambda table: F.get(F.array(*(F.lit(x).cast("string") for row in table for x in row)), place)
    out = F.struct(F.coalesce(of(prefixes), F.lit("O")).alias("prefix"), of(tiers).alias("tier"), "rescued")
    return decoded.select(*(c for c in decoded.columns if c != "rescued"), F.inline(F.array(out)))


def numbered(rows: DataFrame) -> DataFrame:
    """seq for rows from a source that doesn't number its tokens without the special ones."""
    w = Window.partitionBy("doc_id", "head").orderBy("tok")
    return rows.withColumn("seq", F.sum((F.col("start") != F.col("end")).cast("int")).over(w))


def inside(labelled: DataFrame) -> DataFrame:
    """Tokens with a label other than O. Special tokens (start = end) don't count, not even as neighbours: seq leaves them out."""
    return labelled.filter("prefix <> 'O' AND start <> end")


def islands(tokens: DataFrame) -> DataFrame:
    """tokens: from inside(), in windows. Numbered by span.

    A span opens at B, or at I after O or at the start; it runs on through I, whatever that label's tier. The tokens left out are O, so
    a gap in seq is an O between.
    """
    w = Window.partitionBy("doc_id", "window_no", "head").orderBy("seq")
    before = F.lag("seq").over(w)
    rows = tokens.withColumn("opens", (F.col("prefix") == "B") | before.isNull() | (before != F.col("seq") - 1))
    return rows.withColumn("span_no", F.sum(F.col("opens").cast("long")).over(w))


def averages(emitter: Emitter) -> list[Column]:
    return [F.avg(f"b{i}").alias(f"b{i}") for i in range(emitter.width)]


def spans(tokens: DataFrame, emitter: Emitter) -> DataFrame:
    """tokens: from inside(), in windows. One row per span: first and last token, surface and offsets without white space at either end, tier of the
    opening token, mean confidence, evidence, and b0, b1, ...: the means that attributes come from.

    The surface is put together from the tokens' own pieces, so the texts are not needed again.
    """
    by_tok = lambda c: F.struct("tok", c)
    g = islands(emitter.base(tokens)).groupBy("doc_id", "window_no", "head", "head_idx", "span_no").agg(
        F.min("tok").alias("first_tok"), F.max("tok").alias("last_tok"), F.min(by_tok("start"))["start"].alias("first_start"), F.max(by_tok("end"))["end"].alias("last_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok", "piece"))), lambda x: x["piece"]), "").alias("joined"), F.max(by_tok("after"))["after"].alias("after"),
        F.min(by_tok("tier"))["tier"].alias("tier"), F.round(F.avg("confidence"), 6).alias("confidence"), F.when(F.bool_or("rescued"), "floor").otherwise("argmax").alias("evidence"), *averages(emitter),
    )
    # the first piece may begin before its token; white space inside the first and last token is no part of an entity
    g = g.withColumn("raw", F.right("joined", (F.col("last_end") - F.col("first_start")).cast("int"))).withColumn("left", trim_left(F.col("raw")))
    g = g.withColumns({"surface": trim_right(F.col("left")), "start": F.col("last_end") - F.length("left")})
    g = g.withColumns({"end": F.col("start") + F.length("surface"), "after": F.when(F.length("left") > F.length("surface"), F.substring(F.expr("substr(left, length(surface) + 1)"), 1, 1)).otherwise(F.col("after"))})
    return g.filter("surface <> ''").drop("joined", "raw", "left", "first_start", "last_end")


def attributes(entities: DataFrame, emitter: Emitter) -> DataFrame:
    """origin, gender and name_part: the class of the highest mean score over the span's tokens, the first of equals, where the attribute applies."""

    def pick(name: str) -> Column:
        if name not in emitter.space.attributes:
            return F.lit(None).cast("string")
        heads, names = emitter.space.attributes[name]
        scores = F.array(*emitter.classes(name, [F.col(f"b{i}") for i in range(emitter.width)]))
        best = F.get(F.array(*map(F.lit, names)), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
        return F.when(F.col("head").isin(heads), best)

    out = entities.withColumns({"origin": pick("origin"), "gender": pick("gender_expression"), "name_part": pick("name_part")})
    return out.drop(*(f"b{i}" for i in range(emitter.width)))


def overlapping(found: DataFrame, tokens: DataFrame, *more: str) -> DataFrame:
    """Each entity's doc_id, window_no, head, start, end with each token of its window (and head, so each token comes once) that shares a character with it: tok and the
    columns in more. The window is the key; the range is a condition on top."""
    t = tokens.filter("start <> end").select("doc_id", "window_no", "head", F.col("start").alias("tok_start"), F.col("end").alias("tok_end"), "tok", *more)
    both = found.select("doc_id", "window_no", "head", "start", "end").join(t, ["doc_id", "window_no", "head"])
    return both.filter("tok_start < end AND tok_end > start").drop("tok_start", "tok_end")


def clusters(entities: DataFrame, *key: str) -> DataFrame:
    """entities with cluster: those of one key that overlap each other, directly or through others, have one number."""
    w = Window.partitionBy(*key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return entities.withColumn("_new", (reach.isNull() | (reach <= F.col("start"))).cast("int")).withColumn("cluster", F.sum("_new").over(w)).drop("_new")


def clash(kept: Column, x: Column) -> Column:
    return F.exists(kept, lambda a: (a["start"] < x["end"]) & (a["end"] > x["start"]))


def suppress(entities: DataFrame) -> DataFrame:
    """Of overlapping entities of one head in one document, the more confident stays; greedily, so that a dropped one drops none.

    Only a cluster of overlapping entities is folded, so a long document costs its length.
    """
    fields = [c for c in entities.columns if c not in ("doc_id", "head")]
    item = F.struct((-F.col("confidence")).alias("k"), F.col("window_no").alias("kw"), F.col("start").alias("ks"), F.col("end").alias("ke"), *fields)
    lists = clusters(entities, "doc_id", "head").groupBy("doc_id", "head", "cluster").agg(F.array_sort(F.collect_list(item)).alias("all"))
    fold = F.aggregate(F.slice("all", 2, 1 << 30), F.slice("all", 1, 1), lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    keep = F.when(F.size("all") == 1, F.col("all")).otherwise(fold)
    return lists.select("doc_id", "head", F.explode(keep).alias("x")).select("doc_id", "head", *(f"x.{c}" for c in fields))


def confident(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return entities.filter(F.col("confidence") >= threshold)


def merge_names(entities: DataFrame) -> DataFrame:
    """Neighbouring PERSON entities, one given and one family name with exactly one space between, become one full name.

    In a run of linked neighbours the first and second merge, the third and fourth, and so on. Any entity in between breaks the link.
    The merged one has the smaller confidence, the first's tier and origin, the given part's gender, and floor evidence if either has.
    """
    order = [F.col("start"), F.col("end"), F.col("head_idx"), F.col("first_tok")]
    w = Window.partitionBy("doc_id").orderBy(*order)
    fields = ["head", "start", "end", "tier", "confidence", "evidence", "origin", "gender", "name_part", "surface", "after", "head_idx", "first_tok"]
    rows = entities.select("doc_id", *fields)
    rows = rows.withColumn("next", F.lead(F.struct(*fields)).over(w))
    part, other = F.coalesce("name_part", F.lit("full")), F.coalesce("next.name_part", F.lit("full"))
    linked = (
        (F.col("head") == "PERSON") & (F.col("next.head") == "PERSON") & (F.col("next.start") - F.col("end") == 1)
        & (F.col("after") == " ") & (((part == "given") & (other == "family")) | ((part == "family") & (other == "given")))
    )
    rows = rows.withColumn("linked", F.coalesce(linked, F.lit(False)))
    # a run ends at an entity that is not linked to the next; its members count from the run's start
    run = F.sum(F.when(F.lag("linked", 1, False).over(w), 0).otherwise(1)).over(w)
    rows = rows.withColumn("run", run).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy(*order)))
    head = (F.col("nth") % 2 == 1) & F.col("linked")
    second = (F.col("nth") % 2 == 0)
    gender = F.when(part == "given", F.col("gender")).otherwise(F.col("next.gender"))
    merged = {
        "surface": F.when(head, F.concat_ws(" ", "surface", "next.surface")).otherwise(F.col("surface")),
        "end": F.when(head, F.col("next.end")).otherwise(F.col("end")), "confidence": F.when(head, F.least("confidence", "next.confidence")).otherwise(F.col("confidence")),
        "evidence": F.when(head & (F.col("next.evidence") == "floor"), "floor").otherwise(F.col("evidence")),
        "gender": F.when(head, F.coalesce(F.when(gender != "", gender), "gender")).otherwise(F.col("gender")), "name_part": F.when(head, "full").otherwise(F.col("name_part")),
    }
    rows = rows.filter(~second).withColumns(merged)
    return rows.select("doc_id", *fields)


def api_type(head: Column, name_part: Column, space: labels.LabelSpace = labels.DEFAULT) -> Column:
    out = F.lit(None).cast("string")
    for h, part, kind in space.api:
        out = F.when((head == h) & (F.lit(True) if part is None else F.coalesce(name_part, F.lit("full")) == part), kind).otherwise(out)
    return out


def region(origin: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.REGIONS.items() for x in kv)), F.coalesce(origin, F.lit(""))), F.lit("GLOBAL"))


def city_size(kind: Column, tier: Column) -> Column:
    sizes = F.create_map(*(F.lit(x) for kv in labels.SIZES.items() for x in kv))
    return F.when(kind == "CITY", F.coalesce(F.try_element_at(sizes, F.coalesce(tier, F.lit(""))), F.lit("medium")))


def projected(entities: DataFrame, space: labels.LabelSpace = labels.DEFAULT) -> DataFrame:
    """The public form of an entity."""
    kind = api_type(F.col("head"), F.col("name_part"), space)
    return entities.select(
        "doc_id", F.col("surface").alias("text"), kind.alias("type"), F.col("start").cast("long").alias("start_index"), F.col("end").cast("long").alias("end_index"), "tier", "origin", "gender", "name_part",
        F.lit("bert").alias("source"), F.round("confidence", 4).alias("confidence"), region(F.col("origin")).alias("region"), "evidence", city_size(kind, F.col("tier")).alias("size"),
    )
