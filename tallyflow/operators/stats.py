"""Whole-trace frequencies, statistics, rank curves and sender profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..schema import ACK, SYN, SYNTHETIC, TCP, UDP


def frequencies(df: DataFrame, key: str = "src", weight: str = "pkts") -> DataFrame:
    return df.groupBy(keys.key(key).alias("key")).agg(F.sum(keys.weight(weight)).alias("f"))


def _by_value(f: DataFrame) -> DataFrame:
    """(f, n, upto): how many keys have a frequency, and the ranks up to there; as many rows as there are frequencies."""
    return f.groupBy("f").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("f"))))


def stats(df: DataFrame, key: str = "src", weight: str = "pkts") -> DataFrame:
    """One row: records, bytes, synthetic records, duration, rates, distinct keys, singletons, mass of the first 10 and 100, the largest key."""
    whole = df.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.col("len").cast("long")), F.lit(0)).alias("bytes"), F.count_if(F.col("flags").bitwiseAND(SYNTHETIC) != 0).alias("synthetic"), ((F.max_by("ts_us", "rec_no") - F.min_by("ts_us", "rec_no")) / 1e6).alias("seconds"))
    f = frequencies(df, key, weight)
    ranks = _by_value(f)
    share = [F.sum(F.greatest(F.lit(0), F.least("n", F.lit(k) - F.col("upto") + F.col("n"))) * F.col("f")).alias(f"top{k}") for k in (10, 100)]
    keyed = ranks.agg(F.sum("n").alias("distinct"), F.coalesce(F.sum(F.when(F.col("f") == 1, F.col("n"))), F.lit(0)).alias("singletons"), F.sum(F.col("f") * F.col("n")).alias("total"), *share)
    best = f.agg(F.max(F.col("f")).alias("top_f"), F.min_by("key", F.struct((-F.col("f")).alias("f"), F.col("key").alias("k"))).alias("top"))
    one = lambda d: d.withColumn("one", F.lit(1))  # noqa: E731  each side is one row
    out = one(whole).join(one(keyed), "one").join(one(best), "one")
    rate = lambda c: F.round(F.when(F.col("seconds") > 0, F.col(c) / F.col("seconds")), 6)
    return out.select("records", "bytes", "synthetic", F.round("seconds", 6).alias("seconds"), rate("records").alias("pkts_per_s"), F.round(F.when(F.col("seconds") > 0, F.col("bytes") * 8 / F.col("seconds") / 1e9), 12).alias("gbps"), "distinct", "singletons", F.round(100 * F.col("singletons") / F.col("distinct"), 6).alias("singleton_pct"), F.round(F.col("top10") / F.col("total"), 6).alias("top10_mass"), F.round(F.col("top100") / F.col("total"), 6).alias("top100_mass"), keys.render(F.col("top"), key).alias("top_key"), "top_f")


def rank_list(n: int) -> list[int]:
    """Ranks kept by the logarithmic thinning: zero-based i at or after the next mark, which then moves by 2 %; always the last."""
    out, mark = [], 0
    while mark < n:
        out.append(mark)
        mark = int(1.02 * mark) + 1
    if n and out[-1] != n - 1:
        out.append(n - 1)
    return [i + 1 for i in out]


def rank_curve(df: DataFrame, key: str = "src", weight: str = "pkts") -> DataFrame:
    """(rank, freq) at the thinned ranks; ranks are counted over frequencies, not over sorted keys."""
    ranks = _by_value(frequencies(df, key, weight))
    n = ranks.agg(F.sum("n")).first()[0] or 0
    marks = F.array(*[F.lit(r).cast("long") for r in rank_list(n)]) if n else F.array().cast("array<long>")
    return ranks.select(F.explode(F.filter(marks, lambda r: (r <= F.col("upto")) & (r > F.col("upto") - F.col("n")))).alias("rank"), F.col("f").alias("freq"))


def top_sender(df: DataFrame) -> int | None:
    row = frequencies(df).orderBy(F.desc("f"), "key").first()
    return row["key"] if row else None


def profile(df: DataFrame, sender: int) -> DataFrame:
    """One row on an address as sender; with no packet sent only ``recv`` and ``sent`` are set."""
    sent, recv = F.col("src") == sender, F.col("dst") == sender
    syn = (F.col("proto") == TCP) & (F.col("flags").bitwiseAND(SYN) != 0) & (F.col("flags").bitwiseAND(ACK) == 0)
    whole = df.agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    a = df.where(sent | recv).agg(
        F.count_if(sent).alias("sent"), F.count_if(recv).alias("recv"), F.sum(F.when(sent, F.col("len").cast("long"))).alias("sent_bytes"), F.sum(F.when(recv, F.col("len").cast("long"))).alias("recv_bytes"),
        F.min(F.when(sent, F.col("len"))).alias("len_min"), F.max(F.when(sent, F.col("len"))).alias("len_max"), F.avg(F.when(sent, F.col("len"))).alias("len_avg"),
        F.min(F.when(sent, F.col("ts_us"))).alias("first"), F.max(F.when(sent, F.col("ts_us"))).alias("last"),
        F.count_if(sent & (F.col("proto") == TCP)).alias("tcp"), F.count_if(sent & syn).alias("syn_only"),
        F.count_distinct(F.when(sent, F.col("dst"))).alias("dsts"), F.count_distinct(F.when(sent, F.col("dst").bitwiseAND(F.lit(0xFFFFFF00)))).alias("dst24s"),
    )
    a = a.withColumn("one", F.lit(1)).join(whole, "one")  # one row each
    some = F.col("sent") > 0
    span = (F.col("last") - F.col("first")) / 1e6
    return a.select("sent", "recv", "sent_bytes", "recv_bytes", "len_min", "len_max", F.round("len_avg", 6).alias("len_avg"), F.when(some, F.round(span, 6)).alias("span_s"), F.when(some, F.round(F.when(span > 0, F.col("sent") / span).otherwise(0.0), 6)).alias("mean_rate"), F.when(some, F.round(F.col("sent") / F.col("n"), 6)).alias("share"), F.when(some, ((F.col("recv") == 0) | (F.col("sent") > 20 * F.col("recv"))).cast("int")).alias("unidirectional"), F.when(some, F.col("tcp")).alias("tcp"), F.when(some, F.col("syn_only")).alias("syn_only"), F.when(some, (F.col("syn_only") > F.expr("tcp div 2")).cast("int")).alias("syn_flag"), F.when(some, F.col("dsts")).alias("dsts"), F.when(some, F.col("dst24s")).alias("dst24s"))


def profile_protocols(df: DataFrame, sender: int) -> DataFrame:
    by = df.where(F.col("src") == sender).groupBy(F.when(F.col("proto") == 1, "ICMP").when(F.col("proto") == 6, "TCP").when(F.col("proto") == 17, "UDP").otherwise("other").alias("protocol")).agg(F.count("*").alias("n"))
    return by.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


def profile_ports(df: DataFrame, sender: int, k: int = 5) -> DataFrame:
    """The k most frequent destination ports of TCP and UDP; equal counts by descending port; per cent of all sent."""
    sent = df.where(F.col("src") == sender)
    total = sent.count()
    by = sent.where(F.col("proto").isin(TCP, UDP)).groupBy(F.col("dport").alias("port")).agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), F.desc("port")).limit(k).withColumn("pct", F.round(100 * F.col("n") / F.lit(total or 1), 6))


def profile_rate(df: DataFrame, sender: int) -> DataFrame:
    """One row: seconds, mean and coefficient of variation of the rate per second (seconds without packets count 0), if over two seconds."""
    sent = df.where(F.col("src") == sender)
    first = sent.agg(F.min_by("ts_us", "rec_no")).first()[0]
    by = sent.groupBy(F.expr(f"(ts_us - {first or 0}) div 1000000").alias("sec")).agg(F.count("*").cast("double").alias("n"))
    a = by.agg((F.max("sec") + 1).alias("seconds"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"))  # the others add nothing to the sums
    mean = F.col("s") / F.col("seconds")
    cv = F.sqrt(F.greatest(F.col("ss") / F.col("seconds") - mean * mean, F.lit(0.0))) / mean
    return a.where("seconds > 2").select("seconds", F.round(mean, 6).alias("mean_rate"), F.round(cv, 6).alias("cv"), (cv < 0.3).cast("int").alias("constant"))
