"""Traces from general tables, and files of derived relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import QUERY, TRACE

EPOCH = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = lambda **k: F.expr("case event_type " + " ".join(f"when '{a}' then {b}" for a, b in k.items() if a != "rest") + f" else {k['rest']} end")
    v = F.floor("value")
    proto = kind(error=1, signup=17, rest=6)
    return e.select(F.col("event_id").alias("rec_no"), F.expr(EPOCH.format("ts")).alias("ts_us"), (F.lit(167772160) + F.col("user_id")).alias("src"), (F.lit(3232235520) + v).alias("dst"), F.when(proto == 1, 0).otherwise((1024 + F.col("event_id") % 60000).cast("int")).alias("sport"), F.when(proto == 1, 0).otherwise(kind(view=80, click=443, purchase=8443, signup=22, rest=53)).cast("int").alias("dport"), (40 + v).cast("int").alias("len"), proto.cast("int").alias("proto"), kind(view=1, click=3, purchase=2, rest=0).cast("int").alias("flags"))


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day granularity, so many records share a time; numbered by day and key."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ts = F.expr(EPOCH.format("l_shipdate"))
    zero = F.lit(0)
    return t.select((F.expr("unix_date(cast(l_shipdate as date))") * F.lit(10_000_000_000) + F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rec_no"), ts.alias("ts_us"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), zero.alias("sport"), zero.alias("dport"), F.col("l_quantity").cast("int").alias("len"), F.lit(6).alias("proto"), zero.alias("flags"))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE).parquet(path)


def read_query_csv(spark: SparkSession, path: str) -> DataFrame:
    """An exact query file; its header must be that of the relation."""
    return spark.read.schema(QUERY).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("nullValue", "").mode("overwrite").csv(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
