"""Queries against their DuckDB SQL: on the tables, and on small tables with planted pairs, nulls and repeated rows."""

import collections
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyflow.llm import oracles, queries


def rounded(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def same(spark, name, sf_dir, tables):
    got = queries.QUERIES[name](spark, str(sf_dir))
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(oracles.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [tuple(rounded(r[c]) for c in columns) for r in got.collect()]
    at = [want.columns.index(c) for c in columns]
    assert collections.Counter(rows) == collections.Counter(tuple(r[i] for i in at) for r in want.fetchall())
    return rows


@pytest.mark.parametrize("name", ["op8_near_dup", "op9_embedding_dup"])
def test_tables(spark, sf_dir, name):
    same(spark, name, sf_dir, ("documents", "embeddings"))


def test_op8_planted(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**5)}"
    texts = [None, "", " \n", "one two", "one  two", "one two three four", "a a a a a a a a", "a " * 30]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(20, 120))]
        base += base[:8] * rng.randrange(3)
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += rng.sample(texts, 10)
    ids = [*range(len(texts) - 3), 5, 5, None]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "rep": ["x"] * len(ids)}), tmp_path / "documents.parquet")
    rows = same(spark, "op8_near_dup", tmp_path, ["documents"])
    assert sum(not r[2] for r in rows) > 20


def test_op9_planted(spark, tmp_path):
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v)
    vectors = []
    for _ in range(40):
        c = unit(rng.standard_normal(48))
        for _ in range(rng.integers(1, 9)):
            vectors.append((unit(c + unit(rng.standard_normal(48)) * rng.uniform(0, 0.45)) * rng.uniform(0.1, 9)).astype(np.float32).tolist())
    vectors += vectors[:6] + [None, [], [0.0] * 48, [1.0, None], [math.nan] * 48, [math.inf] + [0.0] * 47, [3.0, 4.0], [6.0, 8.0]]
    ids = [*range(len(vectors) - 2), 3, None]
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "rep": [1] * len(ids)}), tmp_path / "embeddings.parquet")
    rows = same(spark, "op9_embedding_dup", tmp_path, ["embeddings"])
    assert sum(r[2] > 0 for r in rows) > 60
