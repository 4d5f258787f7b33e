"""Scoring of detector output (``sketch.detect`` beside an exact query) around an attack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sketch import Sketch


def context(start_us: int, end_us: int) -> Column:
    return F.col("tau_us").between(start_us - 60_000_000, end_us + 61_000_000)


def evaluation_set(start_us: int, end_us: int, width_us: int = 60_000_000) -> Column:
    """Windows that meet the attack and hold the key."""
    return (F.col("tau_us") > start_us) & (F.col("tau_us") - width_us < end_us) & (F.col("exact_f") > 0)


def metrics(est: DataFrame, start_us: int, end_us: int, sketch: Sketch, width_us: int = 60_000_000, m: int = 6) -> DataFrame:
    """One row: memory, mean relative error over the evaluation set, disagreements, error of the change, first detections and latency.

    Fails if no window is in the evaluation set, and if windows or totals are not those of the exact query.
    """
    j, near = evaluation_set(start_us, end_us, width_us), context(start_us, end_us)
    first = lambda flag: F.min(F.when(F.col(flag) == 1, F.struct("win", "tau_us")))
    extremes = [f(F.when(near, F.col(c))).alias(f"{n}_{c}") for n, f in (("max", F.max), ("min", F.min)) for c in ("estimate_delta", "exact_delta")]
    a = est.agg(
        F.avg(F.when(j, F.col("rel_err"))).alias("mre"), F.count_if(F.col("matches_exact_hh") == 0).alias("hh_disagreements"),
        F.avg(F.when(near, F.abs(F.col("estimate_delta") - F.col("exact_delta")))).alias("mae"), first("exact_hh").alias("fe"), first("estimate_hh").alias("fs"), *extremes,
        F.coalesce(F.bool_and((F.col("matches_exact_window") == 1) & (F.col("matches_exact_n") == 1)), F.lit(True)).alias("aligned"),
    )
    status = F.when(F.col("fs").isNull(), "not detected").when(F.col("fe").isNull(), None).when(F.col("fs.win") == F.col("fe.win"), "same window").when(F.col("fs.win") < F.col("fe.win"), "early false positive").otherwise("delay")
    fails = lambda why, t: F.raise_error(F.lit(why)).cast(t)
    mre = F.when(F.col("mre").isNull(), fails("no window holds the key during the attack", "double")).otherwise(F.col("mre"))
    aligned = F.when(~F.col("aligned"), fails("windows or totals are not those of the exact query", "boolean")).otherwise(F.lit(True))
    return a.select(
        F.lit(sketch.kind).alias("sketch"), F.lit(sketch.w).alias("width"), F.lit(memory_kb(sketch, m)).alias("memory_kb"), F.round(100 * mre, 6).alias("mre_pct"), "hh_disagreements",
        F.round("mae", 6).alias("delta_mae"), F.col("fs.win").alias("first_win"), F.round((F.col("fs.tau_us") - start_us) / 1e6, 6).alias("latency_s"), status.alias("status"),
        "max_estimate_delta", "min_estimate_delta", "max_exact_delta", "min_exact_delta", aligned.alias("aligned"),
    )


def memory_kb(sketch: Sketch, m: int = 6) -> float:
    """Counters of the ring of panes, the aggregate and the change, and the packet ring."""
    return round((((m + 2) * sketch.d * sketch.w * 4) + m * 8) / 1024, 6)


def clean_metrics(est: DataFrame, scenario: str, sketch: Sketch) -> DataFrame:
    """One row for a trace without attack; fails if windows, totals or flags disagree with the exact ones."""
    a = est.where("rel_err >= 0").agg(F.avg("abs_err").alias("mae"), F.avg("rel_err").alias("mre"), F.coalesce(F.bool_and((F.col("matches_exact_window") == 1) & (F.col("matches_exact_n") == 1) & (F.col("matches_exact_hh") == 1)), F.lit(True)).alias("ok"))
    checked = F.when(F.col("ok"), F.col("mae")).otherwise(F.raise_error(F.lit("the detector disagrees with the exact windows")).cast("double"))
    return a.select(F.lit(scenario).alias("scenario"), F.lit(sketch.kind).alias("sketch"), F.lit(sketch.w).alias("width"), F.lit(memory_kb(sketch)).alias("memory_kb"), F.round(checked, 6).alias("mean_abs_err"), F.round(100 * F.col("mre"), 6).alias("mre_pct"))


def markdown(df: DataFrame) -> str:
    """A pipe table of a summary (a few rows)."""
    rows = df.collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"
