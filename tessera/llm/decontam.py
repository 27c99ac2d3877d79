"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

#: Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mile miles meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ton tons ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "w kw mw v a hz khz mhz ghz kb mb gb tb c f k celsius fahrenheit percent dollar dollars euro euros cent cents usd eur mph kmh"
)
#: Scripts written without spaces; their characters are words by themselves.
SPACELESS = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
WORD = rf"[[\p{{L}}\p{{N}}]&&[^{SPACELESS}]]"
NUMBER = rf"(?<!{WORD})[$€£]?\p{{Nd}}+(?:[.,:/]\p{{Nd}}+)*%?"
NAME = r"(?<=[\p{L}\p{N},;]\s)\p{Lu}\p{Ll}+"
TOKEN = rf"§p{WORD}+|§[nu]\S+|{WORD}++|[[\p{{L}}\p{{N}}]&&[{SPACELESS}]]"
#: Benchmark windows up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def template_tokens(text: Column) -> Column:
    """Lower-cased words; numbers, units after numbers and capitalised names inside sentences are marked §n, §u, §p before their value."""
    marked = F.translate(text, "§", " ")
    marked = F.regexp_replace(marked, NAME, "§p$0")
    marked = F.regexp_replace(marked, NUMBER, " §n$0 ")
    marked = F.regexp_replace(marked, rf"(?i)(§n\S+\s+)({'|'.join(UNITS.split())})(?![\p{{L}}\p{{N}}])", "$1§u$2 ")
    return F.regexp_extract_all(F.lower(marked), F.lit(TOKEN), F.lit(0))


def _hashed(df: DataFrame) -> DataFrame:
    """df and, of its template words, h: their hashes, one for each kind of placeholder; plain: the same with names as ordinary words; names: where
    names are."""
    word = lambda t: F.when(t.startswith("§"), F.xxhash64(F.substring(t, 1, 2))).otherwise(F.xxhash64(t))
    names = F.array_compact(F.transform("tokens", lambda t, i: F.when(t.startswith("§p"), i)))
    df = df.withColumns({"h": F.transform("tokens", word), "names": names})
    plain = F.transform("tokens", lambda t: F.when(t.startswith("§p"), F.xxhash64(F.substring(t, 3, 1 << 30))).otherwise(word(t)))
    return df.withColumn("plain", F.when(F.size("names") > 0, plain))


def _windows(df: DataFrame, key: str, widths: list[int]) -> DataFrame:
    """df: from _hashed. (key, at, hash, slots, kept) of every window of each width, and once more with names as ordinary words if it has any.

    slots: the values that its placeholders stand for; kept: names read as ordinary words; null for none.
    """
    marks = [F.xxhash64(F.lit(m)) for m in ("§n", "§u", "§p")]

    def of_width(width: int) -> list[Column]:
        def read(i: Column, hashes: str, slots: Column, kept: Column) -> Column:
            words = [F.get(hashes, i + k) for k in range(width)]
            return F.struct(i.alias("at"), F.xxhash64(*words).alias("hash"), slots.alias("slots"), kept.alias("kept"))

        def template(i: Column) -> Column:
            words = [F.get("h", i + k) for k in range(width)]
            marked = words[0].isin(marks)
            for w in words[1:]:
                marked = marked | w.isin(marks)
            return read(i, "h", F.when(marked, F.filter(F.slice("tokens", i + 1, width), lambda t: t.startswith("§"))), F.lit(None).cast("array<string>"))

        def literal(i: Column) -> Column:
            words = F.slice("tokens", i + 1, width)
            return read(i, "plain", F.filter(words, lambda t: t.startswith("§n") | t.startswith("§u")), F.filter(words, lambda t: t.startswith("§p")))

        last = F.size("h") - width
        near = F.transform("names", lambda p: F.sequence(F.greatest(F.lit(0), p - (width - 1)), F.least(p, last)))
        return [
            F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)), template),
            F.transform(F.when((last >= 0) & (F.size("names") > 0), F.array_distinct(F.flatten(near))), literal),
        ]

    every = F.flatten(F.array_compact(F.array(*(w for width in widths for w in of_width(width)))))
    return df.select(key, F.explode(every).alias("w")).select(key, "w.*")


def _benchmark_windows(bench: DataFrame, width: int, literals: int) -> tuple[DataFrame, list[int]]:
    """(item_id, way, item_at, hash, item_slots, item_kept, equal) of the windows that tell an item, and the widths below width among them.

    way 0: distinct windows with at least literals ordinary words, each also with its names as ordinary words, and with the first word as
    a name where it is capitalised: a hit of any of these readings covers the window. way 1, for texts with names: the windows that have
    as many ordinary words when names count as such. Other ways, for texts without a window of way 0: windows side by side over the
    whole text, the last one moved back to its end, or one window of all its words if those are fewer than width. equal: too few ordinary
    words (none, or fewer than literals in a short text) to tell it with other values.
    """
    # after a word, a capitalised first word is a name
    texts = bench.select("item_id", template_tokens(text_of("item_text")).alias("tokens"), template_tokens(F.concat(F.lit("x "), text_of("item_text"))).alias("inside"))
    texts = texts.filter(F.size("tokens") > 0)
    words = F.size(F.filter("tokens", lambda t: ~t.startswith("§")))
    equal = words < F.when(F.size("tokens") < width, F.lit(literals)).otherwise(1)
    item = F.struct("item_id", F.xxhash64("tokens").alias("text"), F.size("tokens").alias("n"), equal.alias("equal"))
    texts = texts.select(item.alias("item"), "tokens", F.slice("inside", 2, 1 << 30).alias("inside"))
    both = texts.select(F.struct("item.*", F.lit(True).alias("main")).alias("item"), "tokens")
    both = materialise(both.unionByName(texts.filter("tokens <> inside").select(F.struct("item.*", F.lit(False).alias("main")).alias("item"), F.col("inside").alias("tokens"))))
    short = [r["n"] for r in both.select("item.n").filter(F.col("n") < width).distinct().orderBy("n").collect()]
    every = _windows(_hashed(both), "item", [width])
    for m in short:
        every = every.unionByName(_windows(_hashed(both.filter(F.col("item.n") == m)), "item", [m]))
    every = every.select("item.*", "at", "hash", (F.col("item.main") & F.col("kept").isNull()).alias("plainly"), *(F.coalesce(c, F.array().cast("array<string>")).alias(f"item_{c}") for c in ("slots", "kept")))
    every = materialise(every.groupBy("item_id", "text", "n", "equal", "at", "hash").agg(F.max("plainly").alias("plainly"), F.max("item_slots").alias("item_slots"), F.max("item_kept").alias("item_kept")))
    named = F.exists("item_slots", lambda t: t.startswith("§p"))
    usual = every.filter((F.col("n") >= width) & (F.size("item_slots") <= width - literals))
    first = lambda df: df.groupBy("item_id", "hash").agg(F.min(F.struct("at", "text")).alias("w")).select("item_id", "w.*").distinct()
    place, text = ["item_id", "at", "text"], ["item_id", "text"]
    by_windows = usual.join(first(usual.filter("plainly")), place)
    by_words = usual.join(every.filter(F.col("plainly") & named).select(text).distinct(), text, "left_semi").filter(~named)
    by_words = by_words.join(first(by_words), place)
    whole = every.join(usual.filter("plainly").select(text).distinct(), text, "left_anti").filter((F.col("at") % width == 0) | (F.col("at") == F.col("n") - width))
    ways = ((by_windows, F.lit(0), F.lit(False)), (by_words, F.lit(1), F.lit(False)), (whole, F.col("text"), F.col("equal")))
    parts = [df.select("item_id", way.cast("long").alias("way"), F.col("at").alias("item_at"), "hash", "item_slots", "item_kept", e.alias("equal")) for df, way, e in ways]
    return materialise(parts[0].unionByName(parts[1]).unionByName(parts[2]).coalesce(16)), short  # small beside the documents


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, containment: float = 0.8, literals: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each contaminated document: doc_id, item_id (the best covered item), containment, reparameterised.

    Numbers, units and names become typed placeholders; every window of width template words of a document is looked up among the
    benchmark's windows. Windows lined up by the same shift form one occurrence, and it counts only if its slots are consistent: one
    benchmark value always stands for the same value in the document. The longest occurrence is taken, and others, as words put in or
    left out shift them, as far as their slots agree with it and among each other. A document is contaminated by an item when these
    cover at least containment of the item's distinct windows. reparameterised: some slot's value differs from the benchmark's.

    Whether a capitalised word is a name depends on its case and on the word before, which a copy need not keep. So windows are looked up with
    names as placeholders and as ordinary words, and an item's first word is read in both ways. Items with names are also measured by
    the windows that have names as ordinary words, and the larger coverage counts.

    Windows with fewer than literals ordinary words are left out on the benchmark's side. An item with no other window is matched whole:
    one consistent occurrence must hold all its template words, and so must it for an item of fewer words than width. Whole items without an
    ordinary word, and short ones with fewer than literals of them, must have the benchmark's values. Characters of scripts without
    spaces count as words. Items without letters and digits, and empty or null texts, have no match. Ties go to the smallest item_id.
    Repeated ids give one row. Empty tables give no rows; other columns are ignored. Benchmark windows are broadcast up to BROADCAST_ROWS
    rows and joined by shuffle beyond.
    """
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item_text")).filter("item_id is not null").dropDuplicates()
    windows, short = _benchmark_windows(bench, width, literals)
    sizes = windows.groupBy("item_id", "way").agg(F.count_distinct("item_at").alias("wanted"), F.max("equal").alias("equal"))
    hint = F.broadcast if windows.count() <= BROADCAST_ROWS else (lambda df: df)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("doc_text"))
    tokens = _hashed(ids.select("doc_id", template_tokens(text_of("doc_text")).alias("tokens")))
    hits = _windows(tokens, "doc_id", [width, *short]).drop("kept").join(hint(windows.drop("equal")), "hash")
    kept = F.transform("item_kept", lambda t: F.struct(t.alias("item_slots"), t.alias("slots")))
    pairs = F.concat(F.arrays_zip("item_slots", F.coalesce("slots", F.array().cast("array<string>")).alias("slots")), kept)
    runs = hits.groupBy("doc_id", "item_id", "way", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set("item_at").alias("covered"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    steady = lambda pairs: F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["item_slots"])))
    runs = runs.filter(steady(F.col("pairs"))).join(hint(sizes), ["item_id", "way"])
    changed = lambda pairs: F.exists(pairs, lambda p: p["item_slots"] != p["slots"])
    runs = runs.filter(F.col("way").isin(0, 1) | ((F.size("covered") == F.col("wanted")) & ~(F.col("equal") & changed(F.col("pairs")))))
    # the longest occurrence first; another joins it only if its slots agree with all before, so shifted parts can't mix parameters
    one = F.struct((-F.size("covered")).alias("k"), "shift", "covered", "pairs")
    both = runs.groupBy("doc_id", "item_id", "way", "wanted").agg(F.sort_array(F.collect_list(one)).alias("runs"))
    both = both.filter(F.size(F.array_distinct(F.flatten("runs.covered"))) >= containment * F.col("wanted"))

    def join(acc: Column, x: Column) -> Column:
        pairs = F.array_distinct(F.concat(acc["pairs"], x["pairs"]))
        more = F.struct(F.array_distinct(F.concat(acc["covered"], x["covered"])).alias("covered"), pairs.alias("pairs"))
        return F.when(steady(pairs), more).otherwise(acc)

    first = F.get("runs", F.lit(0))
    whole = F.aggregate(F.slice("runs", 2, 1 << 30), F.struct(first["covered"].alias("covered"), first["pairs"].alias("pairs")), join)
    found = both.select("doc_id", "item_id", "way", "wanted", F.when(F.size("runs") == 1, F.struct(first["covered"].alias("covered"), first["pairs"].alias("pairs"))).otherwise(whole).alias("w"))
    found = found.select("doc_id", "item_id", "way", "wanted", F.size("w.covered").alias("matched"), changed(F.col("w.pairs")).alias("reparameterised"))
    found = found.withColumn("containment", F.col("matched") / F.col("wanted")).filter(F.col("containment") >= containment)
    best = F.max_by(F.struct("item_id", "containment", "reparameterised"), F.struct("containment", -F.col("item_id"), -F.col("way")))
    return found.groupBy("doc_id").agg(best.alias("best")).select("doc_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, with all their columns, that no benchmark item contaminates. Rows that share an id are judged together, as one document;
    null ids are one such id. Ids are taken as whole numbers; others raise."""
    bad = materialise(contaminated(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("bad_id")))
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["bad_id"]), "left_anti")
