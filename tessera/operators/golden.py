"""Predictions against expected ones, and the self-test's verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidences may differ by so much.
TOLERANCE = 1e-3
KEY = ("doc_id", "start_index", "end_index", "text", "type", "tier")


def compare(want: DataFrame, got: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """KEY, kind, delta of every entity of either: missing, unexpected, drift (confidences further apart than tolerance) or equal. An unknown tier
    equals an unknown tier."""
    g = got.select(*(F.col(k).alias(f"g_{k}") for k in KEY), F.col("confidence").alias("g_confidence"), F.lit(True).alias("g_there"))
    w = want.select(*KEY, "confidence", F.lit(True).alias("w_there"))
    same = F.lit(True)
    for k in KEY:
        same = same & (F.col(k).eqNullSafe(F.col(f"g_{k}")) if k == "tier" else F.col(k) == F.col(f"g_{k}"))
    both = w.join(g, same, "full")
    delta = F.abs(F.col("confidence") - F.col("g_confidence"))
    kind = F.when(F.col("g_there").isNull(), "missing").when(F.col("w_there").isNull(), "unexpected").when(delta > tolerance, "drift").otherwise("equal")
    return both.select(*(F.coalesce(k, f"g_{k}").alias(k) for k in KEY), kind.alias("kind"), delta.alias("delta"))


def compare_pairs(pairs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """As compare, of rows that hold both sides: KEY, confidence, g_tier, g_confidence, with the confidence null where a side lacks the entity. Different
    tiers are two entities; an unknown doc_id or type equals nothing."""
    delta = F.abs(F.col("confidence") - F.col("g_confidence"))
    same = delta.isNotNull() & F.col("tier").eqNullSafe(F.col("g_tier")) & F.col("doc_id").isNotNull() & F.col("type").isNotNull()
    row = lambda tier, kind, delta: F.struct(F.col(tier).alias("tier"), kind.alias("kind"), delta.alias("delta"))
    missing, unexpected = (row(tier, F.lit(kind), F.lit(None).cast("double")) for tier, kind in (("tier", "missing"), ("g_tier", "unexpected")))
    rows = F.when(same, F.array(row("tier", F.when(delta > tolerance, "drift").otherwise("equal"), delta))).when(F.col("g_confidence").isNull(), F.array(missing))
    rows = rows.when(F.col("confidence").isNull(), F.array(unexpected)).otherwise(F.array(missing, unexpected))
    return pairs.select(*(k for k in KEY if k != "tier"), F.inline(rows))


def differences(want: DataFrame, got: DataFrame, *columns: str, once: bool = False) -> DataFrame:
    """side, columns: rows of want alone (missing), of got alone (unexpected) and of both, as often as EXCEPT ALL and INTERSECT ALL have them; or, with
    once, as EXCEPT and INTERSECT. Both are read once and meet in one aggregation."""
    rows = want.select(*columns, F.lit(1).alias("_w"), F.lit(0).alias("_g")).union(got.select(*columns, F.lit(0), F.lit(1)))
    total = (lambda c: F.max(c)) if once else (lambda c: F.sum(c))
    w, g = F.col("_w").cast("int"), F.col("_g").cast("int")
    sides = F.concat(F.array_repeat(F.lit("missing"), w if once else w - g), F.array_repeat(F.lit("unexpected"), g if once else g - w), F.array_repeat(F.lit("both"), F.least(w, g)))
    if once:
        sides = F.when((w > 0) & (g > 0), F.array(F.lit("both"))).otherwise(sides)
    return rows.groupBy(*columns).agg(total("_w").alias("_w"), total("_g").alias("_g")).select(F.explode(sides).alias("side"), *columns)


def lenient_failures(want: DataFrame, got: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, kind) of what fails even for models that need not agree: offsets that don't cut out the entity's text, and texts with expected
    entities but no found one."""
    lists = got.groupBy("doc_id").agg(F.collect_list(F.struct("start_index", "end_index", "text")).alias("all"))  # so that a text is joined once
    wrong = F.filter("all", lambda x: F.substring(F.col("body"), (x["start_index"] + 1).cast("int"), (x["end_index"] - x["start_index"]).cast("int")) != x["text"])
    bad = lists.join(texts.select("doc_id", F.col("text").alias("body")), "doc_id").select("doc_id", F.explode(wrong))
    none = want.select("doc_id").distinct().join(got.select("doc_id").distinct(), "doc_id", "left_anti")
    return bad.select("doc_id", F.lit("offsets").alias("kind")).unionByName(none.select("doc_id", F.lit("none found").alias("kind")))


def verdict(mode: Column, has_golden: Column, precision: Column, strict_failures: Column, lenient: Column) -> Column:
    """off, not_run (no mode yet), skipped (no golden file), passed or failed. fp32 models must agree, others only be sound."""
    failures = F.when(precision == "fp32", strict_failures).otherwise(lenient)
    return F.when(mode.isNull(), "not_run").when(mode == "off", "off").when(~has_golden, "skipped").when(failures > 0, "failed").otherwise("passed")
