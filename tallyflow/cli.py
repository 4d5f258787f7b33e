"""``python -m tallyflow.cli``: the engine's modes on Parquet, trace24 or PCAP traces."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .functions.keys import KINDS, parse_ipv4
from .operators import experiment, inject, sketch, stats
from .operators.windows import Windows
from .sources import pcap, tables, trace24


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    if path.endswith((".pcap", ".pcap.gz")):
        return pcap.read(spark, path, **options)
    return trace24.read(spark, path) if path.endswith(".bin") else tables.read_trace(spark, path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyflow")
    sub = p.add_subparsers(dest="mode", required=True)

    def mode(name: str, *more: tuple):
        m = sub.add_parser(name)
        m.add_argument("trace")
        m.add_argument("--out", help="CSV folder; printed if absent")
        for flag, kw in more:
            m.add_argument(flag, **kw)

    key, weight = ("--key", {"default": "src", "choices": KINDS}), ("--weight", {"default": "pkts", "choices": ("pkts", "bytes")})
    grid = (key, weight, ("-W", {"type": float, "default": 60.0}), ("--delta", {"type": float, "default": 10.0}), ("--phi", {"type": float, "default": 0.01}), ("--max-windows", {"type": int}))
    mode("stats", key, weight)
    mode("rank", key, weight)
    mode("profile", ("--ip", {"default": "auto"}))
    mode("windows", *grid)
    mode("topk", *grid, ("--k", {"type": int, "default": 20}))
    mode("query", *grid, ("--ip", {"action": "append", "required": True}))
    mode("detect", ("--ip", {"required": True}), ("--key", {"default": "src", "choices": ("src", "dst")}), ("--sketch", {"default": "cms", "choices": ("cms", "cs")}), ("-d", {"type": int, "default": 5}), ("-w", {"type": int, "default": 1024}), ("--seed", {"type": int, "default": 42}), ("--exact", {}), ("--order", {"default": "event_time", "choices": ("event_time", "arrival")}))
    capture = (("--dlt", {"type": int}), ("--ipv6", {"default": "skip", "choices": ("skip", "hash")}), ("--limit", {"type": int}))
    mode("convert", *capture)
    mode("status", *capture)
    prepare = (("--seed", {"type": int, "required": True}), ("--start", {"type": float, "default": 300.0}), ("--duration", {"type": float, "default": 30.0}), ("--attacker", {"default": "198.18.0.7"}))
    mode("prepare", *prepare, ("--ddos-pps", {"type": float, "default": 50_000}), ("--scan-pps", {"type": float, "default": 8_000}), ("--sources", {"type": int, "default": 4000}), ("--dst-count", {"type": int, "default": 60_000}), ("--victim-rank", {"type": int, "default": 1000}))
    mode("experiment", ("--clean", {"help": "a trace without attack"}), ("--clean-ip", {}), ("--widths", {"type": int, "nargs": "+", "default": list(experiment.WIDTHS)}), ("--pane", {"type": float, "default": 10.0}))
    attack = (("--start", {"type": float, "default": 60.0}), ("--duration", {"type": float, "default": 30.0}), ("--pkt-size", {"type": int, "default": 64}), ("--seed", {"type": int, "default": 42}), ("--victim-port", {"type": int, "default": 80}))
    mode("ddos", *attack, ("--pps", {"type": float, "default": 50_000}), ("--victim", {"default": "auto"}), ("--victim-rank", {"type": int, "default": 1000}), ("--sources", {"type": int, "default": 4000}), ("--src-prefix", {"default": "198.18.0.0/16"}))
    mode("scan", *attack, ("--pps", {"type": float, "default": 8_000}), ("--attacker", {"default": "198.18.0.7"}), ("--dst-count", {"type": int, "default": 60_000}), ("--dst-prefix", {"default": "198.18.0.0/16"}))
    return p


def experiments(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The attacks that ``prepare`` wrote to the folder ``a.trace``, scored; with ``--out`` both summaries as CSV and one Markdown file."""
    sks = experiment.sketches(a.widths)
    found = experiment.attack_table(experiment.matrix(experiment.load_attacks(spark, a.trace), sks, a.pane))
    validated = None
    if a.clean:
        validated = experiment.clean_table(experiment.clean(load(spark, a.clean), a.clean_ip, sks=sks, pane=a.pane))
    if a.out:
        tables.write_csv(found, f"{a.out}/tabla_resumen")
        if validated is not None:
            tables.write_csv(validated, f"{a.out}/tabla_limpia")
        text = spark.createDataFrame([(experiment.report(found, validated),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{a.out}/tabla_resumen_md")
    else:
        print(experiment.report(found, validated))
    return found


def run(spark: SparkSession, argv: list[str]) -> DataFrame | dict:
    a = parser().parse_args(argv)
    if a.mode == "experiment":
        return experiments(spark, a)
    if a.mode == "status":
        out = pcap.status(spark, a.trace, a.dlt, a.ipv6, a.limit)
        out.show(truncate=False)
        return out
    df = load(spark, a.trace, **({"dlt": a.dlt, "ipv6": a.ipv6, "limit": a.limit} if a.mode == "convert" else {}))
    if a.mode == "prepare":
        told = experiment.prepare(df, a.out or ".", a.seed, a.start, a.duration, a.ddos_pps, a.scan_pps, a.sources, a.dst_count, a.attacker, a.victim_rank)
        print(told)
        return told
    if a.mode in ("windows", "topk", "query"):
        g = Windows(df, a.key, a.weight, a.W, a.delta, a.phi, a.max_windows)
        out = g.windows() if a.mode == "windows" else g.topk(a.k) if a.mode == "topk" else g.query(a.ip)
    elif a.mode == "stats":
        out = stats.stats(df, a.key, a.weight)
    elif a.mode == "rank":
        out = stats.rank_curve(df, a.key, a.weight)
    elif a.mode == "profile":
        out = stats.profile(df, stats.top_sender(df) if a.ip == "auto" else parse_ipv4(a.ip))
    elif a.mode == "detect":
        exact = tables.read_query_csv(spark, a.exact) if a.exact else None
        out = sketch.detect(df, a.ip, sketch.Sketch(a.sketch, a.d, a.w, a.seed), a.key, exact=exact, order=a.order)
    elif a.mode == "convert":
        out = df
    else:
        t0 = inject.check_interval(df, a.start, a.duration)
        if a.mode == "ddos":
            victim = inject.resolve_victim(df, a.victim_rank) if a.victim == "auto" else a.victim
            rows = inject.ddos(spark, victim, t0, a.pps, a.duration, a.sources, a.src_prefix, a.victim_port, a.pkt_size, a.seed)
        else:
            rows = inject.scan(spark, t0, a.attacker, a.pps, a.duration, a.dst_count, a.dst_prefix, a.victim_port, a.pkt_size, a.seed)
        out = inject.merge(df, rows)
    if a.out and a.mode in ("convert", "ddos", "scan"):
        if a.out.endswith(".bin"):  # a folder of files in the 24-byte format
            trace24.write(out, a.out, overwrite=True)
        else:
            out.write.mode("overwrite").parquet(a.out)
    elif a.out:
        tables.write_csv(out, a.out)
    else:
        out.show(100, truncate=False)
    return out


if __name__ == "__main__":
    import sys

    run(SparkSession.builder.appName("tallyflow").getOrCreate(), sys.argv[1:])
