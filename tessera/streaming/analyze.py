"""The same operators on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import detect


def analyze_stream(requests: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available: bool = False, **options) -> StreamingQuery:
    """requests: streaming (doc_id, text). Each micro-batch goes through the batch pipeline and to sink(entities, batch_id).

    available: stop once all that is there has been worked off. A batch may come again after a failure, so sinks go by its id.
    """
    writer = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: sink(detect.analyze(df, **options), i))
    return (writer.trigger(availableNow=True) if available else writer).start()


def latency_stream(log: DataFrame, late: str = "10 minutes", width: str = "300 seconds", slide: str = "60 seconds") -> DataFrame:
    """Requests, failures and mean latency per model in sliding windows; rows later than the watermark are dropped, so state is bounded."""
    w = F.window("ts", width, slide)
    return log.withWatermark("ts", late).groupBy("model", w.alias("w")).agg(F.count("*").alias("requests"), F.count_if("failed").alias("failures"), F.avg("ms").alias("ms"))


def residency_stream(log: DataFrame, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Idle unloading on a stream: a session per model closes once nothing came for ttl."""
    gap = F.session_window("ts", f"{ttl_seconds - 1} seconds 999999 microseconds")
    return log.withWatermark("ts", late).groupBy("model", gap.alias("w")).agg(F.count("*").alias("requests"), F.max("ts").alias("last_used"))
