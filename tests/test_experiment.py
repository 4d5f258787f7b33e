"""Preparing attacks, the matrix of sketches, summaries, and the checks that must fail."""

import pytest

from tallyflow import cli
from tallyflow.operators import evaluate, experiment, inject, sketch, stats
from tallyflow.operators.sketch import Sketch
from tallyflow.operators.windows import Windows
from tallyflow.plans import catalog
from tallyflow.sources import tables, trace24

HOUR = 3600.0


@pytest.fixture(scope="module")
def prepared(spark, sf_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("attacks"))
    base = f"{out}/base"
    catalog.from_events(spark, sf_dir).write.parquet(base)
    told = cli.run(spark, ["prepare", base, "--out", out, "--seed", "7", "--start", "864000", "--duration", "7200", "--ddos-pps", "0.1", "--scan-pps", "0.05", "--sources", "40", "--dst-count", "90", "--victim-rank", "60"])
    return out, base, told


def test_prepare(spark, prepared):
    out, base, told = prepared
    assert told["semilla"] == 7 and told["scan"] == "198.18.0.7"
    manifest = spark.read.json(f"{out}/ips_ataques").first()
    assert manifest.asDict() == told
    truth = tables.read_ground_truth(spark, f"{out}/gt_ddos").first()
    assert truth["ataque"]["tipo"] == "ddos" and truth["ataque"]["victima"] == told["ddos"] and truth["ataque"]["victima_rango_previo"] == 60
    assert truth["paquetes_inyectados"] == 720 and sum(truth["paquetes_por_segundo_reales"]) == 720 and truth["bytes_inyectados"] == 720 * 64
    rows = spark.read.parquet(f"{out}/trazas/traza_ddos")
    assert rows.count() == truth["registros_salida"] == spark.read.parquet(base).count() + 720
    assert rows.where("flags & 16 <> 0").agg({"ts_us": "max"}).first()[0] == truth["ventana_ataque_us"][1]
    scan = tables.read_ground_truth(spark, f"{out}/gt_scan").first()["ataque"].asDict(True)
    assert scan == {"tipo": "scan", "atacante": "198.18.0.7", "prefijo_destino": "198.18.0.0/16", "n_destinos": 90, "puerto": 80, "clave_esperada": {"por_origen": "198.18.0.7"}}


def test_experiment(spark, prepared, tmp_path):
    out, base, _ = prepared
    said = str(tmp_path / "said")
    found = cli.run(spark, ["experiment", out, "--widths", "64", "4096", "--pane", "3600", "--clean", base, "--clean-ip", "10.0.0.3", "--out", said])
    rows = found.collect()
    assert len(rows) == 8 and found.columns == ["Ataque", "Sketch", "Width", "Memoria (KB)", "MRE (%)", "Desacuerdos HH", "MAE Δf (contexto)", "Win Detectada", "Latencia (s)", "Estado Deteccion", "Max Inc Δf", "Max Dec Δf", "Max Inc Δ exacto", "Max Dec Δ exacto"]
    assert {(r["Ataque"], r["Sketch"]) for r in rows} == {(a, s) for a in ("SCAN", "DDOS") for s in ("CMS", "CountSketch")}
    wide = [r for r in rows if r["Width"] == 4096]
    assert all(r["Estado Deteccion"] in experiment.STATES.values() and r["Desacuerdos HH"] == 0 and r["Memoria (KB)"] == 640.05 for r in wide)
    text = "\n".join(r[0] for r in spark.read.text(f"{said}/tabla_resumen_md").collect())
    assert text.count("| CMS |") == 6 and "Validación" in text
    assert spark.read.option("header", True).csv(f"{said}/tabla_limpia").count() == 4
    assert spark.read.option("header", True).csv(f"{said}/tabla_resumen").count() == 8


def test_matrix_is_the_single_runs(spark, sf_dir):
    t = catalog.from_events(spark, sf_dir)
    t0 = Windows(t).t0
    start, end = t0 + catalog.START, t0 + catalog.END
    exact = Windows(t, "dst", W=6 * HOUR, delta=HOUR).query([catalog.IPS[0]])
    for s, row in zip(experiment.sketches((32,)), experiment.matrix([experiment.Attack("A", t, catalog.IPS[0], "dst", start, end)], experiment.sketches((32,)), HOUR).collect(), strict=True):
        alone = evaluate.metrics(sketch.detect(t, catalog.IPS[0], s, "dst", HOUR, exact=exact), start, end, s, int(6 * HOUR * 1e6)).first()
        assert row.asDict() == {"attack": "A"} | alone.asDict()


def test_checks_fail(spark, sf_dir):
    t = catalog.from_events(spark, sf_dir)
    t0, s = Windows(t).t0, Sketch("cms", 5, 64)
    exact = Windows(t, "dst", W=6 * HOUR, delta=HOUR).query([catalog.IPS[0]])
    score = lambda x, a=catalog.START, b=catalog.END: evaluate.metrics(sketch.detect(t, catalog.IPS[0], s, "dst", HOUR, exact=x), t0 + a, t0 + b, s, int(6 * HOUR * 1e6)).collect()
    assert len(score(exact)) == 1
    with pytest.raises(Exception, match="no window holds the key"):
        score(exact, 10**15, 10**15 + 1)
    with pytest.raises(Exception, match="a window twice"):
        score(exact.unionByName(exact.limit(1)))
    with pytest.raises(Exception, match="not those of the exact query"):
        score(exact.withColumn("N", exact.N + 1))
    with pytest.raises(Exception, match="disagrees with the exact windows"):
        evaluate.clean_metrics(sketch.detect(t, catalog.IPS[0], Sketch("cms", 1, 2), "dst", HOUR, exact=exact), "x", s).collect()
    with pytest.raises(ValueError, match="empty"):
        inject.resolve_victim(t.where("false"))
    with pytest.raises(ValueError, match="does not lie"):
        inject.check_interval(t, 0, 10**9)


def test_profile_of_a_receiver(spark):
    rows = [(0, 0, 5, 9, 0, 0, 10, 6, 1), (1, 3, 5, 9, 0, 0, 20, 6, 3)]
    from tallyflow.schema import TRACE

    t = spark.createDataFrame(rows, TRACE)
    only = stats.profile(t, 9).first()
    assert (only["sent"], only["recv"], only["recv_bytes"], only["span_s"], only["share"]) == (0, 2, 30, None, None)
    assert stats.profile(t, 77).first()["recv"] == 0
    assert stats.profile(t, 5).first()["dsts"] == 1


def test_command_line(spark, prepared, tmp_path, capsys):
    out, base, told = prepared
    grid = ["-W", "86400", "--delta", "14400"]
    for argv in (["stats", base], ["rank", base], ["profile", base], ["windows", base, *grid], ["topk", base, *grid, "--k", "2"], ["query", base, *grid, "--ip", "10.0.0.3"], ["detect", base, "--ip", "10.0.0.3", "--order", "arrival"]):
        path = str(tmp_path / argv[0])
        cli.run(spark, [*argv, "--out", path])
        assert spark.read.option("header", True).csv(path).count() > 0, argv
    path = str(tmp_path / "d.bin")
    cli.run(spark, ["scan", base, "--start", "86400", "--pps", "2", "--out", path])
    assert trace24.read(spark, path).count() == spark.read.parquet(base).count() + 60
    exact = cli.run(spark, ["query", path, "--ip", "198.18.0.7", "--out", str(tmp_path / "exact")])
    found = cli.run(spark, ["detect", path, "--ip", "198.18.0.7", "--exact", str(tmp_path / "exact")])
    assert found.where("exact_f >= 0").count() == exact.count() and "matches_exact_n" in capsys.readouterr().out
