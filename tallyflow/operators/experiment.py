"""Preparing attacked traces, and the matrix of sketches over them.

Names of documents and tables are those that users of such files know
(FIXTURES.md, sections 8 to 10).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import parse_ipv4
from ..sources import tables
from . import evaluate, inject, sketch
from .sketch import Sketch
from .windows import Windows

WIDTHS, DEPTH, SEED = (256, 1024, 4096), 5, 42
STATES = {"same window": "Misma ventana", "early false positive": "Falso Positivo temprano", "delay": "Retardo", "not detected": "No detectado"}


@dataclass(frozen=True)
class Attack:
    """A trace with an attack: the address to watch, the key it is watched by, and when the attack began and ended."""

    name: str
    trace: DataFrame
    ip: str | int
    key: str
    start_us: int
    end_us: int


def sketches(widths: Iterable[int] = WIDTHS, d: int = DEPTH, seed: int = SEED) -> list[Sketch]:
    return [Sketch(kind, d, w, seed) for kind in ("cms", "cs") for w in widths]


def _scored(trace: DataFrame, ip: str | int, key: str, sks: list[Sketch], pane: float, m: int, phi: float) -> list[DataFrame]:
    """The estimates of each sketch beside the exact query of the trace."""
    exact = Windows(trace, key, W=pane * m, delta=pane, phi=phi).query([ip])
    every = sketch.detect_all(trace, ip, sks, key, pane, m, phi, exact)
    return [every.where(F.col("sk") == i) for i in range(len(sks))]


def matrix(attacks: list[Attack], sks: list[Sketch] | None = None, pane: float = 10.0, m: int = 6, phi: float = 0.01) -> DataFrame:
    """The rows of ``evaluate.metrics`` for every attack and sketch, with the attack's name."""
    sks = sketches() if sks is None else sks
    rows = []
    for a in attacks:
        for s, est in zip(sks, _scored(a.trace, a.ip, a.key, sks, pane, m, phi), strict=True):
            rows.append(evaluate.metrics(est, a.start_us, a.end_us, s, int(pane * m * 1e6), m).select(F.lit(a.name).alias("attack"), "*"))
    return reduce(DataFrame.unionByName, rows)


def clean(trace: DataFrame, ip: str | int, scenario: str = "Traza limpia (src)", key: str = "src", sks: list[Sketch] | None = None, pane: float = 10.0, m: int = 6, phi: float = 0.01) -> DataFrame:
    """The rows of ``evaluate.clean_metrics`` for every sketch; fails where a sketch decides otherwise than the exact windows."""
    sks = sketches() if sks is None else sks
    rows = [evaluate.clean_metrics(est, scenario, s) for s, est in zip(sks, _scored(trace, ip, key, sks, pane, m, phi), strict=True)]
    return reduce(DataFrame.unionByName, rows)


def _sketch_name():
    return F.when(F.col("sketch") == "cms", "CMS").otherwise("CountSketch").alias("Sketch")


def attack_table(found: DataFrame) -> DataFrame:
    """The summary of ``matrix`` under its published names and roundings."""
    state = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in STATES.items()])
    return found.select(
        F.col("attack").alias("Ataque"), _sketch_name(), F.col("width").alias("Width"), F.round("memory_kb", 2).alias("Memoria (KB)"), F.round("mre_pct", 4).alias("MRE (%)"),
        F.col("hh_disagreements").alias("Desacuerdos HH"), F.round("delta_mae", 2).alias("MAE Δf (contexto)"), F.col("first_win").alias("Win Detectada"), F.col("latency_s").alias("Latencia (s)"),
        state.alias("Estado Deteccion"), F.col("max_estimate_delta").alias("Max Inc Δf"), F.col("min_estimate_delta").alias("Max Dec Δf"),
        F.col("max_exact_delta").alias("Max Inc Δ exacto"), F.col("min_exact_delta").alias("Max Dec Δ exacto"),
    )


def clean_table(found: DataFrame) -> DataFrame:
    """The summary of ``clean`` under its published names and roundings."""
    return found.select(
        F.col("scenario").alias("Escenario"), _sketch_name(), F.col("width").alias("Width"), F.round("memory_kb", 2).alias("Memoria (KB)"),
        F.round("mean_abs_err", 2).alias("Error Absoluto Medio"), F.round("mre_pct", 4).alias("MRE (%)"),
    )


def report(attacks: DataFrame, validation: DataFrame | None = None) -> str:
    """Both summaries as Markdown (a row for each attack and sketch)."""
    out = "# Tabla Resumen de Experimentos\n\n## 1. Detección de Ataques (DDoS y Scan)\n\n" + evaluate.markdown(attacks)
    return out if validation is None else out + "\n## 2. Validación en Traza Limpia Sin Ataques\n\n" + evaluate.markdown(validation)


def prepare(base: DataFrame, out_dir: str, seed: int, start: float = 300.0, duration: float = 30.0, ddos_pps: float = 50_000, scan_pps: float = 8_000, sources: int = 4000, targets: int = 60_000, attacker: str = "198.18.0.7", victim_rank: int = 1000, prefix: str = "198.18.0.0/16", port: int = 80) -> dict:
    """Write both attacked traces (Parquet), their ground truths and the manifest below ``out_dir``; the manifest."""
    spark = base.sparkSession
    t0 = inject.check_interval(base, start, duration)
    victim = inject.resolve_victim(base, victim_rank)
    made = {
        "ddos": (inject.ddos(spark, victim, t0, ddos_pps, duration, sources, prefix, port, seed=seed), ddos_pps, inject.ddos_facts(victim, victim_rank, sources, prefix, port, seed)),
        "scan": (inject.scan(spark, t0, attacker, scan_pps, duration, targets, prefix, port, seed=seed), scan_pps, inject.scan_facts(attacker, targets, prefix, port)),
    }
    told = {}
    for name, (packets, pps, facts) in made.items():
        where = f"{out_dir}/trazas/traza_{name}"
        inject.merge(base, packets).write.mode("overwrite").parquet(where)
        truth = inject.ground_truth(base, packets, start, duration, pps, seed, facts, out_path=where)
        tables.write_json(truth, f"{out_dir}/gt_{name}")
        told[name] = truth.select("ataque").first()["ataque"]
    manifest = {"semilla": seed, "scan": told["scan"]["atacante"], "ddos": told["ddos"]["victima"]}
    rows = spark.createDataFrame([tuple(manifest.values())], "semilla long, scan string, ddos string")
    tables.write_json(rows, f"{out_dir}/ips_ataques")
    return manifest


def load_attacks(spark, out_dir: str) -> list[Attack]:
    """The attacks that ``prepare`` wrote: the scan is watched by its source, the flood by its destination."""
    out = []
    for name, key, field in (("scan", "src", "atacante"), ("ddos", "dst", "victima")):
        truth = tables.read_ground_truth(spark, f"{out_dir}/gt_{name}").first()
        begin, end = truth["ventana_ataque_us"]
        out.append(Attack(name.upper(), tables.read_trace(spark, f"{out_dir}/trazas/traza_{name}"), parse_ipv4(truth["ataque"][field]), key, begin, end))
    return out
