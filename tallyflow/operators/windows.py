"""Exact sliding windows (tau - W, tau] over a trace, by panes.

Windows start at the first record's time t0: window j ends at t0 + W + j*delta
and holds the records after t0 + j*delta up to its end; the record times at t0
itself are in none.  Records are pre-aggregated by (pane, key), panes of
gcd(W, delta); each pane row then goes to the windows that hold it, so a hot
key shuffles one row a pane and window.  Empty windows are there with N = 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys


def threshold(n: Column, phi: float) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(float(phi)) * n.cast("double")).cast("long"))


def arrival_order(df: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Each record's time becomes the latest time up to it in file order.

    Two steps: running maxima within blocks of record numbers, and the maxima
    of the blocks before, which are few rows.
    """
    df = df.withColumn("blk", F.floor(F.col("rec_no") / block))
    top = df.groupBy("blk").agg(F.max("ts_us").alias("top"))
    before = top.select(F.col("blk").alias("b"), F.max("top").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    run = F.max("ts_us").over(Window.partitionBy("blk").orderBy("rec_no"))
    return df.withColumn("ts_us", run).join(before, F.col("blk") == F.col("b")).withColumn("ts_us", F.greatest("ts_us", "before")).drop("blk", "b", "before")


class Windows:
    """The window grid of one trace, and the relations on it."""

    def __init__(self, df: DataFrame, key: str = "src", weight: str = "pkts", W: float = 60.0, delta: float = 10.0, phi: float = 0.01, max_windows: int | None = None, order: str = "event_time"):
        width, step = int(W * 1e6), int(delta * 1e6)
        if width <= 0 or step <= 0:
            raise ValueError("W and delta must be positive")
        if not 0 < phi <= 1:
            raise ValueError("phi must be in (0, 1]")
        first = df.agg(F.min_by("ts_us", "rec_no").alias("t0"), F.max_by("ts_us", "rec_no").alias("tend")).first()
        self.spark, self.kind, self.phi, self.step, self.width = df.sparkSession, key, phi, step, width
        self.t0, self.tend = first["t0"], first["tend"]
        span = -1 if self.t0 is None else self.tend - self.t0
        self.last = (span - width) // step if span >= width else -1
        if max_windows is not None:
            self.last = min(self.last, max(max_windows, 1) - 1)
        self.t0 = self.t0 or 0
        self.df = arrival_order(df) if order == "arrival" else df
        self.pane = math.gcd(width, step)
        self.m, self.s = width // self.pane, step // self.pane
        self.weight = keys.weight(weight)

    def panes(self, *group: Column, only: Column | None = None) -> DataFrame:
        """(q, group..., c): weight by pane, for records after t0."""
        rows = self.df.where(F.col("ts_us") > self.t0)
        rows = rows if only is None else rows.where(only)
        q = F.expr(f"(ts_us - {self.t0} + {self.pane - 1}) div {self.pane}")
        return rows.groupBy(q.alias("q"), *group).agg(F.sum(self.weight).alias("c"))

    def to_windows(self, panes: DataFrame) -> DataFrame:
        """A row for each window that holds a pane."""
        low = F.expr(f"greatest(0L, (q - {self.m} + {self.s - 1}) div {self.s})")
        high = F.expr(f"least((q - 1) div {self.s}, {self.last}L)")
        rows = panes.withColumns({"lo": low, "hi": high}).where("lo <= hi")
        return rows.withColumn("win", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi", "q")

    def frequencies(self, only: Column | None = None) -> DataFrame:
        """(win, key, f) of the keys that occur."""
        return self.to_windows(self.panes(keys.key(self.kind).alias("key"), only=only)).groupBy("win", "key").agg(F.sum("c").alias("f")).where("f > 0")

    def spine(self) -> DataFrame:
        return self.spark.range(self.last + 1).select(F.col("id").alias("win"), (F.lit(self.t0 + self.width) + F.col("id") * self.step).alias("tau_us"))

    def totals(self) -> DataFrame:
        """(win, tau_us, N, threshold), every window."""
        n = self.to_windows(self.panes()).groupBy("win").agg(F.sum("c").alias("N"))
        return self.spine().join(n, "win", "left").withColumn("N", F.coalesce("N", F.lit(0)).cast("long")).withColumn("threshold", threshold(F.col("N"), self.phi))

    def windows(self) -> DataFrame:
        """win, tau_us, N, distinct, threshold, n_hh."""
        # one pass: a window has few different frequencies, and its total is their sum
        by = self.frequencies().groupBy("win", "f").agg(F.count("*").alias("keys"))
        by = by.withColumn("N", F.sum(F.col("f") * F.col("keys")).over(Window.partitionBy("win")))
        heavy = F.col("f") >= threshold(F.col("N"), self.phi)
        per = by.groupBy("win").agg(F.max("N").alias("N"), F.sum("keys").alias("distinct"), F.sum(F.when(heavy, F.col("keys")).otherwise(0)).alias("n_hh"))
        out = self.spine().join(per, "win", "left")
        zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("N", "distinct", "n_hh")}
        return out.withColumns(zero).select("win", "tau_us", "N", "distinct", threshold(F.col("N"), self.phi).alias("threshold"), "n_hh")

    def topk(self, k: int = 20) -> DataFrame:
        """win, tau_us, rank, key, count, is_hh; equal counts by ascending key."""
        if k < 1:
            raise ValueError("k must be at least 1")
        rank = F.row_number().over(Window.partitionBy("win").orderBy(F.desc("f"), "key"))
        best = self.frequencies().withColumn("rank", rank).where(F.col("rank") <= k)
        return best.join(self.totals(), "win").select("win", "tau_us", "rank", keys.render(F.col("key"), self.kind).alias("key"), F.col("f").alias("count"), (F.col("f") >= F.col("threshold")).cast("int").alias("is_hh"))

    def query(self, addresses: list[str | int]) -> DataFrame:
        """Every window for every address: frequency, flag, and change from the window before (null for the first)."""
        wanted = [keys.parse_ipv4(a, self.kind) for a in addresses]
        f = self.frequencies(only=keys.key(self.kind).isin(wanted))
        grid = self.totals().withColumn("key", F.explode(F.array(*[F.lit(k).cast("long") for k in wanted])))
        out = grid.join(f, ["win", "key"], "left").withColumn("exact_f", F.coalesce("f", F.lit(0)).cast("long"))
        out = out.withColumn("exact_delta", F.col("exact_f") - F.lag("exact_f").over(Window.partitionBy("key").orderBy("win")))
        return out.select("win", "tau_us", F.round((F.col("tau_us") - self.t0) / F.lit(1e6), 6).alias("t_rel_s"), keys.render(F.col("key"), self.kind).alias("key"), "N", "threshold", "exact_f", (F.col("exact_f") >= F.col("threshold")).cast("int").alias("exact_hh"), "exact_delta")

    def summary(self) -> DataFrame:
        """One row: windows evaluated, mean and most distinct keys."""
        return self.windows().agg(F.count("*").alias("windows"), F.round(F.avg("distinct"), 6).alias("mean_distinct"), F.max("distinct").alias("max_distinct"))
