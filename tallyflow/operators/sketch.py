"""Count-Min and Count-Sketch as relations (pane, row, bucket) -> cnt; both are linear, so merging and subtracting are sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.murmur import murmur_column
from .windows import Windows, arrival_order


@dataclass(frozen=True)
class Sketch:
    """kind "cms" or "cs", depth, width and seeds; sketches combine only if all are equal."""

    kind: str = "cms"
    d: int = 5
    w: int = 1024
    seed: int = 42
    sign_seed: int | None = None

    def __post_init__(self):
        if self.kind not in ("cms", "cs") or self.d < 1 or self.w < 1:
            raise ValueError("a sketch is cms or cs, with depth and width of 1 or more")

    def bucket(self, key: Column, row: int) -> Column:
        return murmur_column(key, self.seed + row) % self.w

    def sign(self, key: Column, row: int) -> Column:
        if self.kind == "cms":
            return F.lit(1).cast("long")
        seed = self.seed + 10007 if self.sign_seed is None else self.sign_seed
        return F.when(murmur_column(key, seed + row).bitwiseAND(F.lit(1)) == 1, F.lit(-1).cast("long")).otherwise(F.lit(1).cast("long"))

    def cells(self, key: Column) -> Column:
        """Array of (row, bucket, sign) of a key."""
        return F.array(*[F.struct(F.lit(r).alias("row"), self.bucket(key, r).alias("bucket"), self.sign(key, r).alias("sign")) for r in range(self.d)])

    @property
    def bytes(self) -> int:
        return self.d * self.w * 4

    def estimate(self, values: str) -> Column:
        """From the sorted array of the rows' values: the least of a Count-Min, else the median (even depth: the mean cut towards zero)."""
        return F.get(values, F.lit(0)) if self.kind == "cms" else self.median(values)

    def median(self, values: str) -> Column:
        h = self.d // 2
        return F.get(values, F.lit(h)) if self.d % 2 else F.expr(f"({values}[{h - 1}] + {values}[{h}]) div 2")


def build(counts: DataFrame, sketch: Sketch, key: str = "key", count: str = "c", by: tuple[str, ...] = ()) -> DataFrame:
    """The sketch of pre-aggregated counts, one for each value of ``by``."""
    rows = counts.select(*by, F.col(count).alias("c"), F.explode(sketch.cells(F.col(key))).alias("x"))
    return rows.groupBy(*by, F.col("x.row").alias("row"), F.col("x.bucket").alias("bucket")).agg(F.sum(F.col("c") * F.col("x.sign")).alias("cnt"))


def _same(a: Sketch, b: Sketch) -> None:
    if a != b:
        raise ValueError("sketches with different parameters cannot be combined")


def merge(x: DataFrame, y: DataFrame, a: Sketch, b: Sketch) -> DataFrame:
    _same(a, b)
    names = [c for c in x.columns if c != "cnt"]
    return x.unionByName(y).groupBy(*names).agg(F.sum("cnt").alias("cnt"))


def subtract(x: DataFrame, y: DataFrame, a: Sketch, b: Sketch) -> DataFrame:
    return merge(x, y.withColumn("cnt", -F.col("cnt")), a, b)


def point(table: DataFrame, probes: DataFrame, sketch: Sketch, key: str = "key", median: bool = False) -> DataFrame:
    """(key, estimate) for each probe; a missing cell is 0."""
    rows = probes.select(F.col(key).alias("key"), F.explode(sketch.cells(F.col(key))).alias("x")).select("key", "x.row", "x.bucket", "x.sign")
    cells = rows.join(table, ["row", "bucket"], "left").groupBy("key").agg(F.sort_array(F.collect_list(F.col("sign") * F.coalesce("cnt", F.lit(0)))).alias("v"))
    return cells.select("key", (sketch.median("v") if median else sketch.estimate("v")).alias("estimate"))


def _grid(df: DataFrame, key: str, pane: float, m: int, phi: float, order: str) -> Windows:
    """The detector's windows.  In arrival order a record at or before t0 is left out, and a later time closes windows even if the last record is earlier."""
    g = Windows(df, key, "pkts", pane * m, pane, phi, order="event_time")
    if order == "arrival":
        g.df = arrival_order(df.where(F.col("ts_us") > g.t0))
        top = g.df.agg(F.max("ts_us")).first()[0]
        if top is not None:
            g.last = max(g.last, -((g.t0 + g.width - top) // g.step) - 1)
    elif order != "event_time":
        raise ValueError(f"unknown order {order!r}")
    return g


def _estimates(g: Windows, sketches: list[Sketch], target: int, key: str, m: int) -> DataFrame:
    """(sk, win, estimate_f, estimate_delta) of one key for each sketch (by its index), in one pass over the trace."""
    k, probe = F.col("key"), F.lit(target).cast("long")
    cells = F.filter(
        F.array(*[
            F.struct(F.lit(i).alias("sk"), F.lit(r).alias("row"), (s.bucket(k, r) == s.bucket(probe, r)).alias("hit"), (s.sign(k, r) * s.sign(probe, r)).alias("sign"))
            for i, s in enumerate(sketches) for r in range(s.d)
        ]),
        lambda x: x["hit"],
    )
    per = g.panes(keys.key(key).alias("key")).select("q", "c", F.explode(cells).alias("x"))
    per = per.groupBy("q", F.col("x.sk").alias("sk"), F.col("x.row").alias("row")).agg(F.sum(F.col("c") * F.col("x.sign")).alias("cnt"))
    freq = g.to_windows(per).groupBy("win", "sk", "row").agg(F.sum("cnt").alias("f"))
    enters = F.struct((F.col("q") - m).alias("win"), F.col("cnt").alias("c"))
    leaves = F.struct(F.col("q").alias("win"), (-F.col("cnt")).alias("c"))
    moves = per.withColumn("y", F.explode(F.array(enters, leaves))).select(F.col("y.win").alias("win"), "sk", "row", F.col("y.c").alias("c"))
    delta = moves.where((F.col("win") >= 1) & (F.col("win") <= g.last)).groupBy("win", "sk", "row").agg(F.sum("c").alias("dlt"))
    rows = F.array(*[F.struct(F.lit(i).alias("sk"), F.lit(r).alias("row")) for i, s in enumerate(sketches) for r in range(s.d)])
    grid = g.spine().select("win", F.explode(rows).alias("x")).select("win", "x.sk", "x.row")
    v = grid.join(freq, ["win", "sk", "row"], "left").join(delta, ["win", "sk", "row"], "left").groupBy("win", "sk")
    v = v.agg(*[F.sort_array(F.collect_list(F.coalesce(c, F.lit(0)))).alias(n) for c, n in (("f", "fs"), ("dlt", "ds"))])  # d values
    of = lambda made: F.coalesce(*[F.when(F.col("sk") == i, made(s)) for i, s in enumerate(sketches)])
    return v.select("sk", "win", F.greatest(F.lit(0), of(lambda s: s.estimate("fs"))).cast("long").alias("estimate_f"), of(lambda s: s.median("ds")).cast("long").alias("estimate_delta"))


def _reference(exact: DataFrame) -> DataFrame:
    """One row a window and key of an exact query; fails on two."""
    once = exact.groupBy("win", "key").agg(F.count("*").alias("n"), *[F.first(c).alias(a) for c, a in (("tau_us", "x_tau"), ("N", "x_n"), ("exact_f", "exact_f"), ("exact_hh", "exact_hh"), ("exact_delta", "exact_delta"))])
    twice = F.raise_error(F.lit("the exact query has a window twice")).cast("long")
    return once.select("win", "key", F.when(F.col("n") > 1, twice).otherwise(F.col("x_tau")).alias("x_tau"), "x_n", "exact_f", "exact_hh", F.coalesce("exact_delta", F.lit(0)).alias("exact_delta"))


def detect_all(df: DataFrame, ip: str | int, sketches: list[Sketch], key: str = "src", pane: float = 10.0, m: int = 6, phi: float = 0.01, exact: DataFrame | None = None, order: str = "event_time") -> DataFrame:
    """``detect`` for several sketches in one pass; ``sk`` is the sketch's index."""
    g = _grid(df, key, pane, m, phi, order)
    target = keys.parse_ipv4(ip, key)
    out = g.totals().join(_estimates(g, sketches, target, key, m), "win")
    out = out.withColumns({"key": keys.render(F.lit(target).cast("long"), key), "t_rel_s": F.round((F.col("tau_us") - g.t0) / F.lit(1e6), 6), "estimate_hh": (F.col("estimate_f") >= F.col("threshold")).cast("int")})
    if exact is None:
        exact = df.sparkSession.range(0).selectExpr("id win", "'' key", "id tau_us", "id N", "id exact_f", "0 exact_hh", "id exact_delta")
    out = out.join(_reference(exact), ["win", "key"], "left")
    miss = lambda c, t: F.coalesce(c.cast(t), F.lit(-1).cast(t))
    gap = F.abs(F.col("exact_f") - F.col("estimate_f"))
    relative = F.when(F.col("exact_f").isNull(), -1.0).when(F.col("exact_f") > 0, gap / F.col("exact_f")).otherwise(0.0)
    return out.select(
        "sk", "win", "tau_us", "t_rel_s", "key", "N", "threshold", "estimate_f", "estimate_hh", "estimate_delta",
        miss(F.col("x_tau") == F.col("tau_us"), "int").alias("matches_exact_window"), miss(F.col("x_n") == F.col("N"), "int").alias("matches_exact_n"),
        miss(F.col("exact_f"), "long").alias("exact_f"), miss(F.col("exact_hh"), "int").alias("exact_hh"), miss(F.col("exact_hh") == F.col("estimate_hh"), "int").alias("matches_exact_hh"),
        miss(F.col("exact_delta"), "long").alias("exact_delta"), miss(gap, "long").alias("abs_err"), F.round(relative, 6).alias("rel_err"),
    )


def detect(df: DataFrame, ip: str | int, sketch: Sketch, key: str = "src", pane: float = 10.0, m: int = 6, phi: float = 0.01, exact: DataFrame | None = None, order: str = "event_time") -> DataFrame:
    """Per window: N, threshold, estimated frequency of one key, flag and signed change; beside ``exact`` (a point query) if given.

    Only the d cells of the key can matter, so counts are filtered to keys
    that collide with it before they are aggregated; the numbers are those of
    the whole sketch.  A pane adds to the change of the window it enters and
    takes from that of the window it leaves.  The first window's change is 0.
    ``order`` "arrival" counts a late record when it comes, not by its time.
    """
    return detect_all(df, ip, [sketch], key, pane, m, phi, exact, order).drop("sk")
