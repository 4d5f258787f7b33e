"""The sketch detector and the dense exact windows on a stream.

Spark aggregates panes (or windows) with a watermark, so what a batch hands on
is final: a row a pane with the d cells that the watched key falls into, or a
row a window.  Those few rows go through the ring of the last m panes, which
``foreachBatch`` keeps below ``state_path``, one small table a batch: a batch
that is run again after a failure starts from the same ring.  Panes and windows
that no record fell into count as zero, so every window up to the last is there,
empty ones included, once the watermark has passed a later record.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators.sketch import Sketch
from ..operators.windows import threshold
from . import windows as exact

ESTIMATE = "win long, tau_us long, t_rel_s double, key string, N long, threshold long, estimate_f long, estimate_hh int, estimate_delta long"


def tumbling(stream: DataFrame, t0: int, pane: float, delay: str, *aggregates) -> DataFrame:
    """(q, aggregates...) of each pane (t0 + (q - 1) pane, t0 + q pane], streaming."""
    step = int(pane * 1e6)
    # closed on the right: one microsecond less makes the panes Spark's
    rows = stream.where(F.col("ts_us") > t0).withColumn("ets", F.timestamp_micros(F.col("ts_us") - 1)).withWatermark("ets", delay)
    window = F.window("ets", f"{step} microseconds", f"{step} microseconds", f"{t0 % step} microseconds")
    made = rows.groupBy(window.alias("w")).agg(*aggregates)
    return made.select(F.expr(f"(unix_micros(w.end) - {t0}) div {step}").alias("q"), *[c for c in made.columns if c != "w"])


class Kept:
    """Numbers that a batch leaves for the next, in a table named after the batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        found = self.files.listStatus(self.where) if self.files.exists(self.where) else []
        return sorted(int(s.getPath().getName()) for s in found if s.getPath().getName().isdigit())

    def load(self, batch: int) -> list[int] | None:
        before = [b for b in self._batches() if b < batch]
        return list(self.spark.read.parquet(f"{self.path}/{before[-1]}").first()["numbers"]) if before else None

    def save(self, batch: int, numbers: list[int]) -> None:
        self.spark.createDataFrame([(numbers,)], "numbers array<long>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{batch}")
        for old in [b for b in self._batches() if b < batch][:-1]:
            self.files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}"), True)


def median(values: list[int], d: int) -> int:
    values, h = sorted(values), d // 2
    return values[h] if d % 2 else int((values[h - 1] + values[h]) / 2)


def advance(held: list[list[int]], last: int, rows: list[tuple], m: int, judge) -> tuple[list[list[int]], int, list[tuple]]:
    """The ring of m + 1 panes after the panes ``rows`` (q, values...), and what ``judge`` says of each window that this completes."""
    out = []
    for q, *values in sorted(rows):
        while last < q:
            last += 1
            held = [*held[1:], values if last == q else [0] * len(values)]
            if last >= m:
                out.append(judge(last, held))
    return held, last, out


def detect_batches(stream: DataFrame, t0: int, ip: str | int, sketch: Sketch, sink, state_path: str, key: str = "src", pane: float = 10.0, m: int = 6, phi: float = 0.01, delay: str = "0 seconds"):
    """A streaming query that hands the batch detector's rows, up to estimate_delta, to ``sink(df, batch)``; t0 is the first record's time."""
    target, d, step = keys.parse_ipv4(ip, key), sketch.d, int(pane * 1e6)
    k, probe = keys.key(key), F.lit(target).cast("long")
    name = ".".join(str(target >> s & 255) for s in (24, 16, 8, 0))
    cells = [F.sum(F.when(sketch.bucket(k, r) == sketch.bucket(probe, r), sketch.sign(k, r) * sketch.sign(probe, r)).otherwise(0)).alias(f"c{r}") for r in range(d)]

    def judge(q: int, held: list[list[int]]) -> tuple:
        win, tau = q - m, t0 + q * step
        whole = [sum(p[r] for p in held[1:]) for r in range(d + 1)]
        change = [held[-1][r] - held[0][r] for r in range(1, d + 1)] if win else [0] * d
        limit = max(1, math.ceil(phi * float(whole[0])))
        f = max(0, min(whole[1:]) if sketch.kind == "cms" else median(whole[1:], d))
        return win, tau, round((tau - t0) / 1e6, 6), name, whole[0], limit, f, int(f >= limit), median(change, d)

    def each(df: DataFrame, batch: int) -> None:
        kept = Kept(df.sparkSession, state_path)
        last, *flat = kept.load(batch) or [0] * (1 + (m + 1) * (d + 1))
        held = [flat[i * (d + 1) : (i + 1) * (d + 1)] for i in range(m + 1)]
        held, last, out = advance(held, last, [tuple(r) for r in df.collect()], m, judge)  # a row a pane
        sink(df.sparkSession.createDataFrame(out, ESTIMATE), batch)
        kept.save(batch, [last, *[x for p in held for x in p]])

    return tumbling(stream, t0, pane, delay, F.count("*").alias("n"), *cells).writeStream.outputMode("append").foreachBatch(each)


def window_batches(stream: DataFrame, t0: int, sink, state_path: str, W: float = 60.0, delta: float = 10.0, phi: float = 0.01, **options):
    """A streaming query that hands every exact window, empty ones too, to ``sink(df, batch)``: the columns of the batch windows."""
    first, step = t0 + int(W * 1e6), int(delta * 1e6)
    by = exact.frequencies(stream, t0, W=W, delta=delta, **options).groupBy("w", "win", "f").agg(F.count("*").alias("keys"))
    found = by.groupBy("w").agg(F.min("win").alias("win"), F.sum(F.col("f") * F.col("keys")).alias("N"), F.sum("keys").alias("distinct"), F.collect_list(F.struct("f", "keys")).alias("by_f"))

    def each(df: DataFrame, batch: int) -> None:
        spark, kept = df.sparkSession, Kept(df.sparkSession, state_path)
        last = (kept.load(batch) or [-1])[0]
        limit = threshold(F.col("N"), phi)
        heavy = F.aggregate(F.filter("by_f", lambda x: x["f"] >= limit), F.lit(0).cast("long"), lambda a, x: a + x["keys"])
        rows = df.where(F.col("win") > last).select("win", "N", "distinct", limit.alias("threshold"), heavy.alias("n_hh"))
        top = max((r["win"] for r in rows.select("win").collect()), default=last)  # a row a window
        spine = spark.range(last + 1, top + 1).select(F.col("id").alias("win"), (F.lit(first) + F.col("id") * step).alias("tau_us"))
        zero = {c: F.coalesce(c, F.lit(z)).cast("long") for c, z in (("N", 0), ("distinct", 0), ("threshold", 1), ("n_hh", 0))}
        sink(spine.join(rows, "win", "left").withColumns(zero).select("win", "tau_us", "N", "distinct", "threshold", "n_hh"), batch)
        kept.save(batch, [top])

    return found.writeStream.outputMode("append").foreachBatch(each)
