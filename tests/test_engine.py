"""The trace engine against DuckDB, brute force and round trips."""

import glob
import os
import random

import duckdb
import pytest

from tallyflow.functions import keys, murmur
from tallyflow.operators import inject, sketch, stats
from tallyflow.operators.sketch import Sketch
from tallyflow.operators.windows import Windows
from tallyflow.plans import catalog
from tallyflow.schema import TRACE


def plain(v):
    return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf_dir, name):
    db = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    r = db.execute(catalog.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)
    assert sorted((tuple(plain(x[c]) for c in cols) for x in got.collect()), key=str) == want


def trace(spark, rows):
    """rows: (ts_us, src, len)"""
    return spark.createDataFrame([(i, t, s, 1, 0, 0, n, 6, 0) for i, (t, s, n) in enumerate(rows)], TRACE)


def brute(rows, w, d, weight):
    t0, tend = rows[0][0], rows[-1][0]
    out = []
    j = 0
    while t0 + w + j * d <= tend:
        tau = t0 + w + j * d
        f = {}
        for t, s, n in rows:
            if tau - w < t <= tau and t > t0:
                f[s] = f.get(s, 0) + (n if weight == "bytes" else 1)
        f = {k: v for k, v in f.items() if v}
        total = sum(f.values())
        thr = max(1, -int(-0.3 * total // 1))
        out.append((j, tau, total, len(f), thr, sum(v >= thr for v in f.values())))
        j += 1
    return out


CASES = {
    "t0_only": [(5, 1, 9)] * 3,
    "boundary": [(0, 1, 1), (1, 1, 1), (0 + 10, 2, 1), (11, 3, 1), (20, 4, 5), (21, 5, 2), (30, 1, 1)],
    "exact_end": [(0, 1, 1), (4, 2, 1), (20, 3, 1)],
    "short": [(0, 1, 1), (19, 2, 1)],
    "gap": [(0, 1, 1), (3, 1, 1), (200, 2, 1)],
    "weights": [(0, 1, 65535), (2, 1, 65535), (5, 2, 0), (25, 3, 7), (60, 3, 7)],
}


@pytest.mark.parametrize("case", sorted(CASES))
@pytest.mark.parametrize("w,d", [(20, 10), (20, 7), (10, 25)])
def test_windows_by_brute_force(spark, case, w, d):
    for weight in ("pkts", "bytes"):
        g = Windows(trace(spark, CASES[case]), "src", weight, w / 1e6, d / 1e6, 0.3)
        assert sorted(map(tuple, g.windows().collect())) == brute(CASES[case], w, d, weight)


def test_arrival_order(spark):
    rng = random.Random(4)
    rows = [(i * 3 + rng.randrange(-20, 20) + 100, rng.randrange(5), 1) for i in range(120)]
    top, run = 0, []
    for t, s, n in rows:
        top = max(top, t)
        run.append((top, s, n))
    g = Windows(trace(spark, rows), "src", "pkts", 20e-6, 10e-6, 0.3, order="arrival")
    last = rows[-1][0]
    want = [r for r in brute([*run[:-1], run[-1]], 20, 10, "pkts") if r[1] <= last]
    assert sorted(map(tuple, g.windows().collect())) == want


def test_bad_parameters(spark):
    t = trace(spark, CASES["gap"])
    for o in ({"W": 0}, {"delta": 0}, {"phi": 0}, {"phi": 1.5}):
        with pytest.raises(ValueError):
            Windows(t, **o)
    with pytest.raises(ValueError):
        Windows(t).topk(0)
    with pytest.raises(ValueError):
        keys.parse_ipv4("1.2.3.4", "5tuple")
    with pytest.raises(ValueError):
        sketch.merge(None, None, Sketch(), Sketch(d=4))


def test_murmur(spark):
    rng = random.Random(1)
    values = [0, 1, 2**31 - 1, 2**31, 2**32 - 1] + [rng.randrange(2**32) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "k long")
    for seed in (0, 42, 10049, 2**32 - 1):
        got = df.select(murmur.murmur_column(df.k, seed)).collect()
        assert [r[0] for r in got] == [murmur.murmur3(v, seed) for v in values]


def test_count_min_never_underestimates(spark, sf_dir):
    t = catalog.from_events(spark, sf_dir)
    f = stats.frequencies(t, "dst").withColumnRenamed("f", "c")
    s = Sketch("cms", 4, 32)
    est = sketch.point(sketch.build(f, s), f.select("key"), s).join(f, "key")
    assert est.where("estimate < c").count() == 0 and est.count() == f.count()


def test_even_depth_median_is_cut_towards_zero(spark):
    s = Sketch("cs", 2, 8)
    assert [spark.createDataFrame([(v,)], "v array<long>").select(s.median("v")).first()[0] for v in ([-5, 2], [1, 2], [-1, 4])] == [-1, 1, 1]


def test_injection(spark, sf_dir):
    base = catalog.from_events(spark, sf_dir)
    t0 = inject.check_interval(base, 60, 10)
    a = inject.ddos(spark, "10.0.0.1", t0, pps=200, duration=10, sources=50)
    assert a.count() == 2000 and a.select("src").distinct().count() == 50 and a.where("flags & 16 = 0").count() == 0
    merged = inject.merge(base, a).collect()
    assert [r["rec_no"] for r in sorted(merged, key=lambda r: r["rec_no"])] == list(range(len(merged))) and len(merged) == base.count() + 2000
    times = [r["ts_us"] for r in sorted(merged, key=lambda r: r["rec_no"])]
    assert times == sorted(times)
    facts = inject.ddos_facts(keys.parse_ipv4("10.0.0.1"), None, 50, "198.18.0.0/16", 80, 42)
    told = inject.ground_truth(base, a, 60, 10, 200, 42, facts, "base", "out").first()
    assert told["paquetes_por_segundo_reales"] == [200] * 10 and told["ventana_ataque_us"][0] == t0 and told["registros_salida"] == len(merged)
    assert told["ataque"]["victima"] == "10.0.0.1" and len(set(told["ataque"]["fuentes_ejemplo"])) == 20 and told["ataque"]["victima_rango_previo"] is None
    assert told["ventana_ataque_rel_s"] == [60.0, 70.0] and told["fraccion_sintetica"] == round(2000 / len(merged), 6)
    with pytest.raises(ValueError):
        inject.check_interval(base, -1, 5)


def test_merge_of_equal_times(spark):
    """A day's records share one time: they are still dealt to all ranges."""
    t = spark.range(2000).selectExpr("id rec_no", "0L ts_us", "id src", "1L dst", "0 sport", "0 dport", "1 len", "6 proto", "0 flags")
    a = spark.range(500).selectExpr("id rec_no", "0L ts_us", "-id src", "1L dst", "0 sport", "0 dport", "1 len", "6 proto", "16 flags")
    got = inject.merge(t, a).orderBy("rec_no").collect()
    assert [r["rec_no"] for r in got] == list(range(2500))
    assert [r["src"] for r in got] == [*range(2000), *[-i for i in range(500)]]


def test_detector_in_arrival_order(spark):
    """Against a ring that takes records as they come."""
    rng = random.Random(5)
    rows = [(i * 4 + rng.randrange(-30, 30) + 200, rng.randrange(30), 1) for i in range(300)]
    rows += [(150, 3, 1), (1500, 2, 1), (900, 2, 1)]
    t0, step, m, panes, now = rows[0][0], 40, 3, {}, 1
    for t, s, _ in rows[1:]:
        if t > t0:
            now = max(now, -(-(t - t0) // step))
            panes.setdefault(now, []).append(s)
    top, last = max(t for t, _, _ in rows), rows[-1][0]
    want = {}
    q = m
    while t0 + q * step < top or t0 + q * step <= last:
        held = [s for k in range(q - m + 1, q + 1) for s in panes.get(k, [])]
        want[q - m] = (len(held), held.count(2))
        q += 1
    wide = Sketch("cms", 5, 4096)
    got = sketch.detect(trace(spark, rows), 2, wide, "src", pane=step / 1e6, m=m, order="arrival").collect()
    assert {r["win"]: (r["N"], r["estimate_f"]) for r in got} == want
    with pytest.raises(ValueError):
        sketch.detect(trace(spark, rows), 2, wide, order="backwards")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
