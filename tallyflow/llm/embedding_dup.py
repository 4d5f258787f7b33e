"""Embedding near-dedup with Euclidean p-stable hashing (operator 9).

Vectors are normalised; cosine c is then a distance of sqrt(2 - 2c).  A table
hashes a vector to the integer parts of ``k`` random projections (Gaussian,
width ``WIDTH`` times the distance at the threshold); its key is the whole of
them.  ``k`` grows with the logarithm of the number of vectors, so chance
collisions stay in proportion, and the number of tables is what a pair just at
the threshold needs to be missed with probability 1 - ``RECALL`` at most; closer
pairs are missed less.  Every pair that
shares a bucket is checked by its exact cosine in double precision.

Equal vectors are collapsed first.  Buckets of one vector go before any vector
is moved.  A bucket of more than ``CHUNK`` members is dealt to tasks by pairs
of chunks, so no task holds a large bucket and no pair is left out.  A task
counts a pair only in the first table that both share, and returns counts and
a spanning forest of its links, not the pairs.

Edge cases: null, empty and zero vectors and those with null or non-finite
components link with nothing; so do vectors of different lengths.  Repeated
rows are separate vectors, also where their ids are equal.  A null vec_id
counts as the largest.  A cosine of just the threshold is a link.  Further
columns are ignored, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, exchange

COSINE = 0.95
WIDTH = 8.0  # of a cell, in distances at the threshold: fewest tables between 4 and 16
RECALL = 1 - 6e-6
MOST_TABLES = 256
CHUNK = 512
SEED = 20_240_917


def collision(ratio: float) -> float:
    """Chance that two points share one projection's cell, if a cell is ``ratio`` times their distance wide."""
    tail = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def parameters(n: int, cosine: float = COSINE) -> tuple[int, int, float]:
    """(projections a key, tables, cell width) for ``n`` vectors."""
    distance = math.sqrt(2 - 2 * cosine)
    near, far = collision(WIDTH), collision(WIDTH * distance / math.sqrt(2))
    k = max(6, math.ceil(math.log(max(n, 2)) / -math.log(far)) + 1)
    while True:
        tables = math.ceil(math.log(1 - RECALL) / math.log(1 - near**k))
        if tables <= MOST_TABLES or k == 1:
            return k, tables, WIDTH * distance
        k -= 1


class Tables:
    """The hash tables for vectors of one dimension; the same wherever they are made."""

    def __init__(self, dim: int, k: int, tables: int, width: float):
        draw = np.random.Generator(np.random.PCG64([SEED, dim]))
        self.k, self.n, self.width = k, tables, width
        self.lines = draw.standard_normal((dim, tables * k))
        self.shift = draw.uniform(0, width, tables * k)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """64-bit keys, one column a table."""
        out = np.empty((len(unit), self.n), np.uint64)
        with np.errstate(over="ignore"):
            for a in range(0, len(unit), 2048):
                cell = np.floor((unit[a : a + 2048] @ self.lines + self.shift) / self.width).astype(np.int64).view(np.uint64).reshape(-1, self.n, self.k)
                h = np.broadcast_to(np.arange(1, self.n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), cell.shape[:2]) + np.uint64(unit.shape[1])
                for j in range(self.k):
                    h = (h ^ cell[:, :, j]) * np.uint64(0xBF58476D1CE4E5B9)
                    h = h ^ (h >> np.uint64(29))
                out[a : a + 2048] = h
        return out


def _units(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Dimension to (row indices, normalised vectors in double precision)."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    begin = np.cumsum(sizes) - sizes
    out = {}
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        v = flat[begin[at][:, None] + np.arange(dim)]
        out[int(dim)] = at, v / np.linalg.norm(v, axis=1, keepdims=True)
    return out


def _pairs_of(bucket: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Index pairs (i < j) of rows, sorted by bucket, that share a bucket and whose one may stand left, the other right."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(first, len(bucket)))
    rank = np.arange(len(bucket)) - np.repeat(first, size)
    after = np.repeat(size, size) - rank - 1
    at = 0
    while at < len(bucket):  # about a million pairs at a time
        stop = int(np.searchsorted(np.cumsum(after[at:]), 1 << 20)) + at + 1
        n = after[at:stop]
        i = np.repeat(np.arange(at, min(stop, len(bucket))), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        ok = (left[i] & right[j]) | (right[i] & left[j])
        yield i[ok], j[ok]
        at = stop


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per row of ``vectors``: ``id``, ``n_links``, ``component_id``, ``kept``."""
    spark = exchange.ship(vectors.sparkSession)
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(exchange.quoted(id_col).cast("long").alias("id"), exchange.quoted(vector_col).cast(kind).alias("v"))
    biggest = F.lit(float("inf"))
    sound = F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < biggest)), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0.0), F.lit(False))
    rows = exchange.materialize(rows.withColumn("ok", sound), "vectors")
    good = rows.where("ok")
    unit = exchange.materialize(good.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()), "distinct")
    k, tables, width = parameters(unit.count(), cosine)
    made: dict[int, Tables] = {}

    def hashed(v: pa.Array) -> np.ndarray:
        keys = np.zeros((len(v), tables), np.uint64)
        for dim, (at, u) in _units(v).items():
            if dim not in made:
                made[dim] = Tables(dim, k, tables, width)
            keys[at] = made[dim].keys(u)
        return keys

    def spread(b: dict[str, pa.Array]) -> dict[str, pa.Array]:
        keys = hashed(b["v"]).view(np.int64)
        return {"keys": pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * tables, pa.int32()), pa.array(keys.reshape(-1)))}

    placed = exchange.materialize(exchange.annotate(unit, ["rep"], {"v": F.col("v")}, spread, {"keys": "array<long>"}).select("rep", F.posexplode("keys").alias("tab", "bucket")), "placed")
    buckets = placed.groupBy("tab", "bucket").agg(F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("b"), F.col("tab").alias("t"), "n")
    full = exchange.lookup(placed, buckets, {"key": F.bitwise_not("bucket"), "key2": F.bitwise_not("tab")}, {"key": F.bitwise_not("b"), "key2": F.bitwise_not("t")}, "inner")
    full = full.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("rep", "tab", "bucket", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    full = exchange.materialize(full, "members")
    exchange.discard(placed)
    parts = max(2 * exchange.shuffle_width(spark), full.count() // 40_000)
    moved = full.join(unit.select("rep", "v", "copies").hint("merge"), "rep").repartition(parts, "tab", "bucket", "low", "high")

    def link(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        rep, tab, bucket, own, low, high, copies = (t.column(c).to_numpy() for c in ("rep", "tab", "bucket", "own", "low", "high", "copies"))
        order = np.lexsort((rep, high, low, bucket, tab))
        v = t.column("v").combine_chunks()
        rep, tab, bucket, own, low, high = (x[order] for x in (rep, tab, bucket, own, low, high))
        new = np.ones(len(rep), dtype=bool)
        new[1:] = (tab[1:] != tab[:-1]) | (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        group = np.cumsum(new)
        units = {dim: (at, u) for dim, (at, u) in _units(v).items()}
        dim_of, place = np.zeros(len(rep), int), np.zeros(len(rep), int)
        for dim, (at, _) in units.items():
            dim_of[at], place[at] = dim, np.arange(len(at))
        dim_of, place = dim_of[order], place[order]
        # keys are made anew for the vectors that have links here, each once
        _, some, which = np.unique(rep, return_index=True, return_inverse=True)
        keys, made_here = np.zeros((len(some), tables), np.uint64), np.zeros(len(some), dtype=bool)

        def first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            a, b = which[x], which[y]
            new = np.unique(np.concatenate([a, b]))
            new = new[~made_here[new]]
            if len(new):
                keys[new], made_here[new] = hashed(v.take(pa.array(order[some[new]]))), True
            return np.argmax(keys[a] == keys[b], axis=1)

        heads, tails = [], []
        for i, j in _pairs_of(group, own == low, own == high):
            for a in range(0, len(i), 1 << 15):
                x, y = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
                for dim, (_, u) in units.items():
                    s = (dim_of[x] == dim) & (dim_of[y] == dim)
                    p, q = x[s], y[s]
                    near = np.einsum("ij,ij->i", u[place[p]], u[place[q]]) >= cosine
                    p, q = p[near], q[near]
                    if len(p):  # only in the first table that both share
                        first = first_shared(p, q) == tab[p]
                        heads.append(p[first])
                        tails.append(q[first])
        if not heads:
            return
        a, b = np.concatenate(heads), np.concatenate(tails)
        many = copies[order]
        names, code = np.unique(rep[np.concatenate([a, b])], return_inverse=True)
        links = np.bincount(code, weights=many[np.concatenate([b, a])], minlength=len(names)).astype(np.int64)
        a, b = code[: len(a)], code[len(a) :]
        label = np.arange(len(names))
        while len(a):
            before = label.copy()
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            label = label[label]
            if (label == before).all():
                break
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(names[label], pa.int64()), pa.array(links, pa.int64())], ["rep", "root", "links"])

    found = exchange.materialize(moved.mapInArrow(link, "rep long, root long, links long"), "found")
    classes = components.connected_components(found.where("rep <> root"), "rep", "root")
    classes = exchange.lookup(unit.select("rep", "least"), classes, {"key": F.bitwise_not("rep")}, {"key": F.bitwise_not("node")}).select("rep", "least", F.coalesce("component", "rep").alias("class"))
    classes = exchange.materialize(classes, "classes")
    named = exchange.lookup(classes, classes.groupBy("class").agg(F.min("least").alias("component_id")).withColumnRenamed("class", "c"), {"key": F.bitwise_not("class")}, {"key": F.bitwise_not("c")}, "inner").select("rep", "component_id")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    facts = unit.join(named, "rep").join(counted, "rep", "left").select(F.col("v").alias("w"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = exchange.lookup(rows, facts, {"key": F.reverse("v")}, {"key": F.reverse("w")})
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), component.isNull()).alias("kept"))
