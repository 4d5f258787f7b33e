"""Streams against the batch engine: a trace in several files, then a last record that closes every window."""

import pytest

from tallyflow.operators import sketch
from tallyflow.operators.sketch import Sketch
from tallyflow.operators.windows import Windows
from tallyflow.plans import catalog
from tallyflow.schema import TRACE
from tallyflow.streaming import detector, windows

HOUR = 3600.0


@pytest.fixture(scope="module")
def fed(spark, sf_dir, tmp_path_factory):
    """The trace, without a day in the middle, in four files by time; a fifth holds one far later record."""
    path = str(tmp_path_factory.mktemp("fed") / "t")
    whole = catalog.from_events(spark, sf_dir)
    g = Windows(whole)
    start = g.t0 + int(9 * 24 * HOUR * 1e6)
    t = whole.where((whole.ts_us < start) | (whole.ts_us > start + int(40 * HOUR * 1e6))).cache()
    rows = t.orderBy("rec_no").collect()
    for k in range(4):
        spark.createDataFrame(rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4], TRACE).coalesce(1).write.mode("append").parquet(path)
    late = (10**6, rows[-1]["ts_us"] + int(300 * HOUR * 1e6), 1, 1, 0, 0, 1, 6, 0)
    spark.createDataFrame([late], TRACE).coalesce(1).write.mode("append").parquet(path)
    return t, g.t0, path


def follow(spark, path):
    return spark.readStream.schema(TRACE).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def finish(writer, tmp_path):
    q = writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    assert q.awaitTermination(300) and q.exception() is None


def test_windows(spark, fed, tmp_path):
    t, t0, path = fed
    out = windows.windows(follow(spark, path), t0, key="dst", W=24 * HOUR, delta=4 * HOUR)
    finish(out.writeStream.outputMode("append").format("memory").queryName("stream_windows"), tmp_path)
    got = {r["win"]: (r["N"], r["distinct"]) for r in spark.table("stream_windows").collect()}
    want = {r["win"]: (r["N"], r["distinct"]) for r in Windows(t, "dst", W=24 * HOUR, delta=4 * HOUR).windows().collect() if r["N"]}
    assert want.items() <= got.items()


def test_dense_windows(spark, fed, tmp_path):
    t, t0, path = fed
    got = []
    finish(detector.window_batches(follow(spark, path), t0, lambda df, batch: got.extend(df.collect()), str(tmp_path / "state"), key="dst", W=24 * HOUR, delta=4 * HOUR), tmp_path)
    want = sorted(map(tuple, Windows(t, "dst", W=24 * HOUR, delta=4 * HOUR).windows().collect()))
    got = sorted(map(tuple, got))
    assert got[: len(want)] == want and [r[0] for r in got] == list(range(len(got))) and any(r[2] == 0 for r in want)


@pytest.mark.parametrize("kind", ["cms", "cs"])
def test_detector(spark, fed, tmp_path, kind):
    t, t0, path = fed
    sk, got = Sketch(kind, 5, 16), []
    finish(detector.detect_batches(follow(spark, path), t0, catalog.IPS[0], sk, lambda df, batch: got.extend(df.collect()), str(tmp_path / "state"), "dst", HOUR), tmp_path)
    want = [tuple(r)[:9] for r in sketch.detect(t, catalog.IPS[0], sk, "dst", pane=HOUR).orderBy("win").collect()]
    got = sorted(map(tuple, got))
    assert got[: len(want)] == want and any(r[4] == 0 for r in want) and any(r[8] for r in want)


def test_ring_is_taken_up_again(spark, tmp_path):
    kept = detector.Kept(spark, str(tmp_path / "ring"))
    assert kept.load(0) is None
    for batch in range(4):
        kept.save(batch, [batch, 7])
    assert kept.load(4) == [3, 7] and kept.load(3) == [2, 7] and len(kept._batches()) == 2


def test_topk(spark, fed, tmp_path):
    t, t0, path = fed
    got = []
    finish(windows.topk_batches(follow(spark, path), t0, lambda df, batch: got.extend(df.collect()), 3, key="dst", W=24 * HOUR, delta=24 * HOUR), tmp_path)
    best = Windows(t, "dst", W=24 * HOUR, delta=24 * HOUR).topk(3).collect()
    assert {(r["win"], r["rank"], r["count"]) for r in best} <= {(r["win"], r["rank"], r["f"]) for r in got}


def test_tumbling(spark, fed, tmp_path):
    from pyspark.sql import functions as F

    t, t0, path = fed
    out = detector.tumbling(follow(spark, path), t0, HOUR, "0 seconds", F.count("*").alias("n"))
    finish(out.writeStream.outputMode("append").format("memory").queryName("stream_panes"), tmp_path)
    got = {r["q"]: r["n"] for r in spark.table("stream_panes").collect()}
    step = int(HOUR * 1e6)
    want = {r["q"]: r["n"] for r in t.where(t.ts_us > t0).groupBy(F.expr(f"(ts_us - {t0} + {step - 1}) div {step}").alias("q")).agg(F.count("*").alias("n")).collect()}
    assert want.items() <= got.items()
