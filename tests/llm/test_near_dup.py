"""Row identity, split buckets and awkward tables of operator 8, against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tallyflow.llm import near_dup


def shingles(text):
    w = text.split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def similar(x, y):
    if max(x.values()) == max(y.values()) == 1:
        both = len(x.keys() & y.keys())
        return both / (len(x) + len(y) - both)
    return sum(1 / sum(max(x[j] / x[k], y[j] / y[k]) for j in x.keys() | y.keys()) for k in x.keys() & y.keys())


def classes(texts):
    """The class of each text (by its number), comparing all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and sets[i].keys() & sets[j].keys() and similar(sets[i], sets[j]) >= near_dup.SIMILARITY:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def text(rng, n=80):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_equal_ids_of_different_texts(spark):
    rng = random.Random(1)
    a, b = text(rng), text(rng)
    near = lambda w: " ".join([*w[:40], "changed", *w[41:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (3, near(b)), (4, " ".join(a)), (None, " ".join(a)), (None, None), (None, ""), (5, ""), (5, "")]
    got = collections.Counter(map(tuple, near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    assert got == {(1, 1, True): 2, (2, 1, False): 1, (3, 1, False): 2, (4, 1, False): 1, (None, 1, False): 1, (None, None, True): 2, (5, 5, True): 2}


def test_only_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f")] * 4, "doc_id long, text string")
    assert sorted(r["kept"] for r in near_dup.near_duplicates(docs).collect()) == [False, False, False, True]


def test_one_of_each_keeps_columns(spark):
    docs = spark.createDataFrame([("x", 1, "a b c d e f", 2.5), ("x", 1, "a b c d e f", 2.5), ("y", 2, "a b c d e f", None), (None, 3, None, 1.0)], "rep string, doc_id int, text string, bands double")
    docs = docs.select("rep", "doc_id", "text", "bands", F.struct(F.lit(1).alias("odd name"), F.lit("q").alias("a:b")).alias("row"), F.lit(7).alias("__gone"), F.lit("z").alias("dot.ted"))
    got = near_dup.one_of_each(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    assert sorted((r["doc_id"], r["rep"], r["bands"], r["row"]["odd name"], r["__gone"], r["dot.ted"]) for r in got.collect()) == [(1, "x", 2.5, 1, 7, "z"), (3, None, 1.0, 1, 7, "z")]


@pytest.mark.parametrize("chunk", [16, near_dup.CHUNK])
def test_buckets_of_many_classes(spark, chunk):
    """Hundreds of texts a step or two from each other near the threshold: their buckets hold many classes."""
    rng = random.Random(7)
    texts = []
    for family in range(6):
        base = text(rng, 120)
        for _ in range(70):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 6))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["id"]: r["class_id"] for r in near_dup.near_duplicates(docs, chunk=chunk).collect()}
    want = classes(texts)
    least = {}
    for i, c in enumerate(want):
        least.setdefault(c, i)
    assert len(set(want)) > 20 and got == {i: least[c] for i, c in enumerate(want)}
