"""Requests, models and metrics as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def request_texts(requests: DataFrame) -> DataFrame:
    """(request_id, pos, text): texts wins over text."""
    return requests.select("request_id", F.posexplode(F.coalesce("texts", F.array("text"))).alias("pos", "text"))


def request_status(models: list[str], max_texts: int, max_chars: int) -> Column:
    """400 without text, 413 with too many or too long ones, 400 for an unknown model, else 200; the first that holds."""
    texts = F.coalesce("texts", F.when(F.col("text").isNotNull(), F.array("text")))
    return (
        F.when(texts.isNull(), 400).when(F.size(texts) > max_texts, 413).when(F.exists(texts, lambda t: F.length(t) > max_chars), 413)
        .when(F.col("model").isNotNull() & ~F.col("model").isin(models), 400).otherwise(200)
    )


def model_specs(specs: DataFrame) -> DataFrame:
    """(config, pos, name, source) of "name=source,..." strings; empty chunks are skipped, valid says whether both parts are there."""
    rows = specs.select("config", F.posexplode(F.split("raw", ",")).alias("pos", "chunk")).withColumn("chunk", F.trim("chunk")).filter("chunk <> ''")
    name, source = F.trim(F.substring_index("chunk", "=", 1)), F.trim(F.expr("substr(chunk, instr(chunk, '=') + 1)"))
    return rows.select("config", "pos", name.alias("name"), source.alias("source"), (F.contains("chunk", F.lit("=")) & (name != "") & (source != "")).alias("valid"))


def parse_source(source: Column) -> tuple[Column, Column, Column]:
    """(kind, repo, revision): hf://org/repo[@revision], the revision main by default, or a path."""
    hub = source.startswith("hf://")
    rest = F.substr(source, F.lit(6))
    return F.when(hub, "hub").otherwise("path"), F.when(hub, F.split_part(rest, F.lit("@"), F.lit(1))).otherwise(source), F.when(hub, F.coalesce(F.nullif(F.split_part(rest, F.lit("@"), F.lit(2)), F.lit("")), F.lit("main")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def version_key(name: Column) -> Column:
    found = F.transform(F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(-1)))


def newest_name(names: list[str]) -> str:
    """The same choice on a list: the highest version, the earlier of equals."""
    return max(names, key=lambda n: [int(x) for x in re.findall(r"\d+", n)] or [-1])


def newest(specs: DataFrame) -> DataFrame:
    """The model of the highest version in each config; the earlier of equals."""
    w = Window.partitionBy("config").orderBy(version_key(F.col("name")).desc(), "pos")
    return specs.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def claimed_precision(path: Column) -> Column:
    """What a file name of the fixed form model-<precision>.onnx claims."""
    claim = F.regexp_extract(path, r"model-(fp32|q8|q4)\.onnx$", 1)
    return F.when(claim == "q4", "int4").when(claim != "", claim)


def manifest_precision(format_: Column) -> Column:
    f = F.lower(format_)
    return F.when(f.rlike("int4|q4"), "int4").when(f.rlike("int8|q8"), "q8").when(f.rlike("fp32|float32"), "fp32")


def precision_warning(precision: Column, cuda: Column) -> Column:
    q8 = F.concat(F.lit("int8 weights: for evaluation, not production"), F.when(cuda, "; most of the graph runs on the CPU").otherwise(""))
    return F.when(precision == "q8", q8).when(precision == "int4", "int4 weights: experimental, not for production")


def providers(setting: Column, available: Column) -> Column:
    """The execution providers for cpu, cuda or auto. cuda without CUDA is an error: an explicit wish doesn't degrade."""
    cuda = F.array_contains(available, "CUDAExecutionProvider")
    both = F.lit("CUDAExecutionProvider,CPUExecutionProvider")
    none = F.raise_error(F.lit("cuda was asked for, but there is no CUDAExecutionProvider")).cast("string")
    return F.when(setting == "cpu", "CPUExecutionProvider").when(cuda, both).when(setting == "cuda", none).otherwise("CPUExecutionProvider")


def authorized(header: Column, key: str | None) -> Column:
    """Whether a request may pass: any, without a key; else one whose header is "Bearer " and the key. Digests of both are compared, so time doesn't
    tell how much is right."""
    if key is None:
        return F.lit(True)
    return F.coalesce(F.sha2(header, 256) == F.sha2(F.lit(f"Bearer {key}"), 256), F.lit(False))


def gate(log: DataFrame) -> DataFrame:
    """event_id, model, begin_us, end_us of requests that a model serves one at a time, first come first served: each begins when it has come and the
    one before has ended.

    With the work summed up, a request ends at the largest arrival minus the work before it, plus the work up to itself; so it is two running
    window functions. One model's requests are one sorted sequence; it spills, but does not spread.
    """
    w = Window.partitionBy("model").orderBy("_t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.select("event_id", "model", F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"), F.greatest(F.lit(0), F.floor(F.coalesce("ms", F.lit(0.0)) * 1000)).cast("long").alias("_d"))
    rows = rows.withColumn("_work", F.sum("_d").over(w)).withColumn("end_us", F.max(F.col("_t") - (F.col("_work") - F.col("_d"))).over(w) + F.col("_work"))
    return rows.select("event_id", "model", (F.col("end_us") - F.col("_d")).alias("begin_us"), "end_us")


def plain_file_name(name: Column) -> Column:
    return ~(F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")) | F.contains(name, F.lit("..")) | (name == ""))


def scanned_precision(content: Column) -> Column:
    quantised = ("DynamicQuantizeLinear", "MatMulInteger", "QLinearMatMul")
    any_q8 = F.contains(content, F.lit(quantised[0])) | F.contains(content, F.lit(quantised[1])) | F.contains(content, F.lit(quantised[2]))
    return F.when(F.contains(content, F.lit("MatMulNBits")), "int4").when(any_q8, "q8").otherwise("fp32")


def more_conservative(a: Column, b: Column) -> Column:
    rank = lambda c: F.when(c == "int4", 0).when(c == "q8", 1).otherwise(2)
    return F.when(rank(a) <= rank(b), F.coalesce(a, F.lit("fp32"))).otherwise(F.coalesce(b, F.lit("fp32")))


def request_log(events: DataFrame) -> DataFrame:
    """events as a request log: value is the duration in ms, type error a failure, the user the model."""
    return events.select("event_id", "ts", F.col("user_id").alias("model"), F.col("value").alias("ms"), (F.col("event_type") == "error").alias("failed"))


def nearest_ranks(log: DataFrame, quantiles: tuple[float, ...], serve: bool, buckets: int = 4096) -> DataFrame:
    """(model, n, low, high, p<quantile>...): for each quantile the sorted list's item at round(q * (n - 1)), half to even (serve), or
    at min(n - 1, floor(q * n)). Exact, and no task holds a model's list, as one model may have most rows.

    Equal values are counted first. A histogram on a logarithmic scale tells which bucket holds a rank, and only the values of that
    bucket are ranked. Null durations don't count; a model without any has nulls.
    """
    counts = log.groupBy("model", "ms").agg(F.count("ms").alias("c"))
    n = F.sum("c")
    models = counts.groupBy("model").agg(n.alias("n"), F.min("ms").alias("low"), F.max("ms").alias("high"))
    scale = lambda c: F.signum(c) * F.log1p(F.abs(c))
    lo, hi = scale(F.col("low")), scale(F.col("high"))
    bucket = F.when(hi > lo, F.least(F.floor((scale(F.col("ms")) - lo) / (hi - lo) * buckets), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")
    placed = counts.filter("c > 0").join(models.select(F.col("model").alias("m"), "low", "high"), F.col("model").eqNullSafe(F.col("m"))).select("model", "ms", "c", bucket.alias("bucket"))

    def at(q: float) -> Column:
        last = F.col("n") - 1
        return (F.bround(F.lit(q) * last, 0) if serve else F.least(last, F.floor(F.lit(q) * F.col("n")))).cast("long")

    wanted = models.filter("n > 0").select(F.col("model").alias("m"), F.posexplode(F.array(*map(at, quantiles))).alias("k", "rank"))
    filled = placed.groupBy("model", "bucket").agg(n.alias("c"))
    filled = filled.withColumn("before", F.sum("c").over(Window.partitionBy("model").orderBy("bucket")) - F.col("c"))
    hit = filled.join(wanted, F.col("model").eqNullSafe(F.col("m"))).filter("rank >= before AND rank < before + c").select("m", F.col("bucket").alias("b"), "k", (F.col("rank") - F.col("before")).alias("rest"))
    ranked = placed.join(hit, F.col("model").eqNullSafe(F.col("m")) & (F.col("bucket") == F.col("b")))
    ranked = ranked.withColumn("upto", F.sum("c").over(Window.partitionBy("model", "k").orderBy("ms"))).filter("rest < upto AND rest >= upto - c")
    names = [f"p{round(q * 100)}" for q in quantiles]
    found = ranked.groupBy(F.col("model").alias("m")).agg(*(F.max(F.when(F.col("k") == k, F.col("ms"))).alias(name) for k, name in enumerate(names)))
    return models.join(found, F.col("model").eqNullSafe(F.col("m")), "left").select("model", "n", "low", "high", *names)


def rolling(log: DataFrame, seconds: int = 300, chunk: int = 3600) -> DataFrame:
    """Per model and request: requests and mean latency over the last seconds, both ends included.

    A model's log is cut into chunks of time, so that no task sorts all of one model; the last seconds of a chunk are copied to the next.
    """
    chunk = max(chunk, seconds) * 1_000_000
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    own, late = F.floor(t / chunk), F.pmod(t, F.lit(chunk)) >= chunk - seconds * 1_000_000
    copies = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    rows = log.withColumn("__t", t).select("*", F.posexplode(copies).alias("__copy", "__chunk"))
    w = Window.partitionBy("model", "__chunk").orderBy("__t").rangeBetween(-seconds * 1_000_000, 0)
    counted = rows.withColumns({"n_recent": F.count("*").over(w), "ms_recent": F.round(F.avg("ms").over(w), 3)})
    return counted.filter("__copy = 0").drop("__t", "__copy", "__chunk")


def idle_periods(log: DataFrame, ttl_seconds: int, chunk: int = 3600) -> DataFrame:
    """Residency of each model: it unloads once it has been idle for ttl. One row per stretch of requests closer than ttl: requests, loaded,
    last_used.

    A model's log is cut into chunks of time that are searched for gaps by themselves, so one task never sorts all of one model. What remains
    of a chunk is a row per stretch; neighbouring chunks' stretches are then joined where they are closer than ttl.
    """
    size = max(chunk, ttl_seconds) * 1_000_000
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = F.lit(ttl_seconds * 1_000_000)

    def stretches(rows: DataFrame, first: str, last: str, *key: str) -> DataFrame:
        w = Window.partitionBy(*key).orderBy(first, last)
        opens = F.coalesce(F.col(first) - F.lag(last).over(w) >= gap, F.lit(True)).cast("long")
        return rows.withColumn("_open", opens).withColumn("_k", F.sum("_open").over(w))

    own = log.select("model", "ts", t.alias("_t"), F.floor(t / size).alias("_chunk"))
    small = stretches(own, "_t", "_t", "model", "_chunk").groupBy("model", "_chunk", "_k").agg(F.count("*").alias("requests"), F.min("ts").alias("loaded"), F.max("ts").alias("last_used"), F.min("_t").alias("_a"), F.max("_t").alias("_z"))
    joined = stretches(small.drop("_k"), "_a", "_z", "model").groupBy("model", "_k").agg(F.sum("requests").alias("requests"), F.min("loaded").alias("loaded"), F.max("last_used").alias("last_used"))
    return joined.drop("_k")


def throughput(log: DataFrame, tokens_per_request: Column) -> DataFrame:
    """model, per_s (requests a second over the log's span), tokens_per_s (mean tokens times requests over the span) and local_tokens_per_s (tokens
    over the mean time of a request). Models with one request have no span."""
    g = log.withColumns({"_us": F.unix_micros(F.col("ts").cast("timestamp")), "_n": tokens_per_request}).groupBy("model")
    g = g.agg(F.count("*").alias("n"), ((F.max("_us") - F.min("_us")) / 1e6).alias("span"), F.avg("_n").alias("mean"), F.avg("ms").alias("ms"))
    return g.filter("n > 1 AND span > 0").select("model", (F.col("n") / F.col("span")).alias("per_s"), (F.col("mean") * F.col("n") / F.col("span")).alias("tokens_per_s"), (F.col("mean") / (F.col("ms") / 1000)).alias("local_tokens_per_s"))


def totals(log: DataFrame) -> DataFrame:
    """model, requests, failures and active: requests still under way at the log's last moment, from start (ts) and duration (ms); null durations are
    still under way."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    last = log.groupBy("model").agg(F.max("ts").alias("_last"))
    rows = log.join(last.withColumnRenamed("model", "_m"), F.col("model").eqNullSafe(F.col("_m")))
    busy = F.col("ms").isNull() | (start + F.col("ms") * 1000 > F.unix_micros(F.col("_last").cast("timestamp")))
    return rows.groupBy("model").agg(F.count("*").alias("requests"), F.count_if("failed").alias("failures"), F.count_if(busy).alias("active"))
