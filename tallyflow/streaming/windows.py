"""The sliding windows on a stream.

A stream has no last record and no global first one: the origin t0 is given,
and a window is final when the watermark passes its end.  Two stateful
aggregations are chained: counts by (window, key), then totals by window.
Records later than the watermark are left out, where the batch engine counts
them by their own time; windows without records appear
only in ``detector.window_batches``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys


def _timed(stream: DataFrame, t0: int, W: float, delta: float, delay: str) -> tuple[DataFrame, Column]:
    # windows are closed on the right: one microsecond less makes them Spark's
    rows = stream.where(F.col("ts_us") > t0).withColumn("ets", F.timestamp_micros(F.col("ts_us") - 1)).withWatermark("ets", delay)
    start = t0 % int(delta * 1e6)
    return rows, F.window("ets", f"{int(W * 1e6)} microseconds", f"{int(delta * 1e6)} microseconds", f"{start} microseconds")


def frequencies(stream: DataFrame, t0: int, key: str = "src", weight: str = "pkts", W: float = 60.0, delta: float = 10.0, delay: str = "0 seconds") -> DataFrame:
    """(win, key, f) of whole windows, streaming."""
    rows, window = _timed(stream, t0, W, delta, delay)
    out = rows.groupBy(window.alias("w"), keys.key(key).alias("key")).agg(F.sum(keys.weight(weight)).alias("f"))
    first = t0 + int(W * 1e6)
    return out.withColumn("win", F.expr(f"(unix_micros(w.end) - {first}) div {int(delta * 1e6)}")).where(F.expr(f"unix_micros(w.end) >= {first}"))


def windows(stream: DataFrame, t0: int, **options) -> DataFrame:
    """(win, N, distinct) of whole windows that are not empty, streaming; ``detector.window_batches`` adds flags and the empty ones."""
    out = frequencies(stream, t0, **options).groupBy("w").agg(F.min("win").alias("win"), F.sum("f").alias("N"), F.count("*").alias("distinct"))
    return out.select("win", "N", "distinct")


def topk_batches(stream: DataFrame, t0: int, sink, k: int = 20, **options):
    """A streaming query that hands the top k of every final window to ``sink(df, batch_id)``."""
    from pyspark.sql import Window

    def each(df, batch):
        rank = F.row_number().over(Window.partitionBy("win").orderBy(F.desc("f"), "key"))
        sink(df.select("win", "key", "f", rank.alias("rank")).where(F.col("rank") <= k), batch)

    return frequencies(stream, t0, **options).writeStream.outputMode("append").foreachBatch(each)
