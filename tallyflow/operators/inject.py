"""Synthetic floods and scans, merged into a trace by time.

Draws come from Spark's hash of (seed, packet, purpose), so a run is the same
on any number of executors.  With ``jitter`` off the times are a plain grid.
"""

from __future__ import annotations

import ipaddress
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions.keys import ipv4, parse_ipv4
from ..schema import SYN, SYNTHETIC, TCP, TRACE
from .stats import frequencies


def _draw(seed: int, purpose: int, low: int, high: int) -> Column:
    return (F.lit(low) + F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(purpose)), F.lit(high - low))).cast("long")


def timeline(spark: SparkSession, t0: int, pps: float, duration: float, seed: int, jitter: bool = True) -> DataFrame:
    """(id, ts_us): round(pps * duration) packets, each within its own step."""
    n = round(pps * duration)
    if n <= 0:
        raise ValueError("no packets: pps * duration is below one")
    step = 1e6 / pps
    within = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(0)), F.lit(1 << 30)) / float(1 << 30) if jitter else F.lit(0.0)
    return spark.range(n).select("id", (F.lit(t0) + ((F.col("id") + within) * step).cast("long")).alias("ts_us"))


def spread(index: Column, count: int, prefix: str, seed: int) -> Column:
    """The index-th of ``count`` distinct addresses of a prefix: an affine permutation of its space."""
    net = ipaddress.IPv4Network(prefix, strict=False)
    space = net.num_addresses
    if count > space:
        raise ValueError(f"{count} addresses do not fit in {prefix}")
    a = (0x9E3779B1 * (2 * seed + 1)) % space | 1
    while math.gcd(a, space) != 1:
        a += 2
    return F.lit(int(net.network_address)) + F.pmod(index * F.lit(a % space) + F.lit(seed), F.lit(space))


def ddos(spark: SparkSession, victim: str | int, t0: int, pps: float = 50_000, duration: float = 30, sources: int = 4000, prefix: str = "198.18.0.0/16", port: int = 80, size: int = 64, seed: int = 42, jitter: bool = True) -> DataFrame:
    """Many sources, one victim, SYN packets."""
    rows = timeline(spark, t0, pps, duration, seed, jitter)
    spread(F.col("id"), sources, prefix, seed)
    return _packets(rows, spread(_draw(seed, 1, 0, sources), sources, prefix, seed), F.lit(parse_ipv4(victim)), _draw(seed, 2, 1024, 65535), port, size)


def scan(spark: SparkSession, t0: int, attacker: str | int = "198.18.0.7", pps: float = 8_000, duration: float = 30, targets: int = 60_000, prefix: str = "198.18.0.0/16", port: int = 80, size: int = 64, seed: int = 42, jitter: bool = True) -> DataFrame:
    """One attacker, many targets."""
    rows = timeline(spark, t0, pps, duration, seed, jitter)
    return _packets(rows, F.lit(parse_ipv4(attacker)), spread(_draw(seed, 1, 0, targets), targets, prefix, seed), _draw(seed, 2, 40_000, 60_000), port, size)


def _packets(rows: DataFrame, src: Column, dst: Column, sport: Column, port: int, size: int) -> DataFrame:
    return rows.select(F.col("id").alias("rec_no"), "ts_us", src.cast("long").alias("src"), dst.cast("long").alias("dst"), sport.cast("int").alias("sport"), F.lit(port).alias("dport"), F.lit(size).alias("len"), F.lit(TCP).alias("proto"), F.lit(SYN | SYNTHETIC).alias("flags"))


def check_interval(base: DataFrame, start: float, duration: float) -> int:
    """The attack's start in microseconds; it must lie within the base trace."""
    row = base.agg(F.min_by("ts_us", "rec_no"), F.max_by("ts_us", "rec_no")).first()
    if row[0] is None or start < 0 or start + duration > (row[1] - row[0]) / 1e6:
        raise ValueError("the attack does not lie within the trace")
    return row[0] + int(start * 1e6)


def resolve_victim(base: DataFrame, rank: int = 1000, sample: int = 2_000_000) -> int:
    """The destination of that zero-based rank (or the last) among the first records; equal counts by ascending address."""
    f = frequencies(base.where(F.col("rec_no") < sample), "dst")
    n = f.count()
    if not n:
        raise ValueError("the trace is empty")
    return f.orderBy(F.desc("f"), "key").offset(min(rank, n - 1)).first()["key"]


def merge(base: DataFrame, attack: DataFrame) -> DataFrame:
    """Both in the order of time, base first at equal times, numbered anew.

    Rows are dealt to sampled ranges of (time, side, number), so neither a
    flood nor a time that many records share fills one task, and are sorted and
    numbered within theirs.  That is written; then each range begins at the
    count of those before it, one number a range.
    """
    rows = base.select(*TRACE.names).withColumn("late", F.lit(0)).unionByName(attack.select(*TRACE.names).withColumn("late", F.lit(1)))
    order = ("ts_us", "late", "rec_no")
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    part = F.shiftright("id", 33)
    placed = shared.materialize(placed.withColumns({"range": part, "place": F.col("id") - F.shiftleft(part, 33)}).drop("id", "late"), "merged")
    sizes = placed.groupBy(F.col("range").alias("r")).agg(F.count("*").alias("n"))
    ahead = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("r", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), F.col("range") == F.col("r")).select((F.col("before") + F.col("place")).alias("rec_no"), *TRACE.names[1:])


def per_second(attack: DataFrame, t0: int, duration: float) -> DataFrame:
    """(sec, n) for every second of the attack, zeros included."""
    by = attack.groupBy(F.expr(f"(ts_us - {t0}) div 1000000").alias("sec")).agg(F.count("*").alias("n"))
    return attack.sparkSession.range(math.ceil(duration)).select(F.col("id").alias("sec")).join(by, "sec", "outer").select("sec", F.coalesce("n", F.lit(0)).alias("n"))


def ddos_facts(victim: int, victim_rank: int | None, sources: int, prefix: str, port: int, seed: int) -> Column:
    """The part of the ground truth on a flood; the first 20 source addresses are listed."""
    dotted = str(ipaddress.IPv4Address(victim))
    examples = F.array(*[ipv4(spread(F.lit(i), sources, prefix, seed)) for i in range(min(20, sources))])
    expected = F.struct(F.lit(dotted).alias("por_destino"), F.lit("no concentrado; use /16 o el destino").alias("por_prefijo_origen_24"))
    return F.struct(
        F.lit("ddos").alias("tipo"), F.lit(dotted).alias("victima"), F.lit(victim_rank).cast("long").alias("victima_rango_previo"), F.lit(port).cast("long").alias("puerto_victima"),
        F.lit(prefix).alias("prefijo_origen"), F.lit(sources).cast("long").alias("n_fuentes"), examples.alias("fuentes_ejemplo"), expected.alias("clave_esperada"),
    )


def scan_facts(attacker: str, targets: int, prefix: str, port: int) -> Column:
    """The part of the ground truth on a scan."""
    return F.struct(
        F.lit("scan").alias("tipo"), F.lit(attacker).alias("atacante"), F.lit(prefix).alias("prefijo_destino"), F.lit(targets).cast("long").alias("n_destinos"),
        F.lit(port).cast("long").alias("puerto"), F.struct(F.lit(attacker).alias("por_origen")).alias("clave_esperada"),
    )


def ground_truth(base: DataFrame, attack: DataFrame, start: float, duration: float, pps: float, seed: int, facts: Column, base_path: str = "", out_path: str = "") -> DataFrame:
    """One row, the document on an injection (its names are fixed); ``start`` counts in seconds from the first record."""
    t0 = check_interval(base, start, duration)
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731  each side is one row
    a = one(attack.agg(F.count("*").alias("packets"), F.coalesce(F.sum(F.col("len").cast("long")), F.lit(0)).alias("bytes"), F.max("ts_us").alias("last")))
    b = one(base.agg(F.count("*").alias("base_records")))
    seconds = F.transform(F.sort_array(F.collect_list(F.struct("sec", "n"))), lambda x: x["n"])
    s = one(per_second(attack, t0, duration).agg(seconds.alias("per_second")))
    total = F.col("base_records") + F.col("packets")
    return a.join(b, "one").join(s, "one").select(
        F.lit(base_path).alias("traza_base"), F.lit(out_path).alias("traza_salida"), F.lit(seed).cast("long").alias("semilla"),
        F.array(F.lit(t0).cast("long"), F.col("last")).alias("ventana_ataque_us"), F.array(F.lit(float(start)), F.lit(float(start + duration))).alias("ventana_ataque_rel_s"),
        F.col("packets").alias("paquetes_inyectados"), F.col("bytes").alias("bytes_inyectados"), F.lit(float(pps)).alias("pps_nominal"), F.col("per_second").alias("paquetes_por_segundo_reales"),
        F.col("base_records").alias("registros_base"), total.alias("registros_salida"), F.round(F.col("packets") / total, 6).alias("fraccion_sintetica"),
        F.lit("bit 4 de flags (0x10) en cada paquete inyectado").alias("marca"), facts.alias("ataque"),
    )
