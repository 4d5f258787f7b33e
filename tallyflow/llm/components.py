"""Connected components of a link table, by contraction; links and labels never leave the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange


#: links that one task takes in at once (16 bytes each); more are contracted first
ONE_TASK = 250_000


def _roots(batches):
    """(node, to): the smallest node of each node's component, for a bounded number of links."""
    held = [x for x in batches if x.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    names, code = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
    a, b = code[: t.num_rows], code[t.num_rows :]
    label = np.arange(len(names))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], ["node", "to"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node.

    Up to ``one_task`` links are solved in one task on an executor; as long as
    there are more, rounds of contraction make them fewer.

    In each round a node steps to its neighbour of the lowest hash (or stays,
    if its own is lower), and the links are rewritten to where their ends
    went.  As the hash changes with the round, chains shrink by a constant
    factor whatever their order.  Hubs are pre-aggregated before shuffling and
    looked up with ``exchange.lookup``.  Links with a null end are left out.
    """
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    live = exchange.materialize(live.distinct(), "links")
    live_table = live
    steps: list[DataFrame] = []
    while live.count() > one_task:
        turn = F.lit(len(steps))
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", turn).alias("h"), F.col("b").alias("to"))).alias("m"))
        step = near.select(F.col("a").alias("node"), F.when(F.struct(F.xxhash64("a", turn), F.col("a")) < F.col("m"), F.col("a")).otherwise(F.col("m.to")).alias("to"))
        step = exchange.materialize(step, "step")
        steps.append(step)
        for end in ("a", "b"):
            moved = exchange.lookup(live, step, {"key": F.bitwise_not(end)}, {"key": F.bitwise_not("node")}, "inner")
            live = moved.select(F.col("to").alias(end), "b" if end == "a" else "a")
        past, live = live_table, exchange.materialize(live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        live_table = live
        exchange.discard(past)
    if not exchange.is_empty(live):
        steps.append(exchange.materialize(live.coalesce(1).mapInArrow(_roots, "node long, to long"), "step"))
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("a").alias("component"))
    at = steps[0]
    for step in steps[1:]:
        on = exchange.lookup(at, step.select(F.col("node").alias("from"), F.col("to").alias("next")), {"key": F.bitwise_not("to")}, {"key": F.bitwise_not("from")})
        at = on.select("node", F.coalesce("next", "to").alias("to"))
    at = exchange.materialize(at, "roots")
    exchange.discard(live, *steps)
    least = at.groupBy("to").agg(F.min("node").alias("component"))
    return exchange.lookup(at, least.withColumnRenamed("to", "root"), {"key": F.bitwise_not("to")}, {"key": F.bitwise_not("root")}, "inner").select("node", "component")
