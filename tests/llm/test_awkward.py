"""Every operator and stage on tables with clashing and odd columns, nulls, repeated rows, and on empty ones."""

import collections

import pytest
from pyspark.sql import functions as F

from tallyflow.llm import chat, decontaminate, embedding_dup, langid, license_scan, near_dup, packing, queries, substring_dedup, tokens, warc

TEXT = "the quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing their morning songs "
ROWS = [(1, TEXT, "en"), (1, TEXT, "en"), (2, TEXT + "again", "en"), (3, None, "en"), (4, "", None), (None, "der schnelle braune fuchs springt heute wieder ueber den faulen hund am alten fluss entlang des weges", "de"), (5, "Licensed under CC BY-NC 4.0. der hund und die katze schlafen", "de"), (6, "!!!", None)]
NAMES = ("id", "rest", "row", "k0", "o0", "__gone", "__mask", "keeps", "block", "bands", "lang_pred", "n_words", "sequence_id", "offset", "matches", "dot.ted", "back`tick")


def odd(df):
    """With columns whose names the operators use inside, and types of all kinds."""
    kinds = [F.lit(1), F.lit("x"), F.array(F.lit(1.5)), F.create_map(F.lit("a"), F.lit(2)), F.struct(F.lit(1).alias("odd name"), F.lit("q").alias("a:b"), F.lit(None).cast("int").alias("`c`")), F.lit(None).cast("date"), F.lit(b"z"), F.current_timestamp(), F.lit("1.25").cast("decimal(9,3)")]
    return df.select("*", *[kinds[i % len(kinds)].alias(n) for i, n in enumerate(NAMES) if n not in df.columns])


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return odd(plain).repartition(3).cache()


def benchmark(spark):
    return odd(spark.createDataFrame([(9, "one two three four"), (9, None), (None, "small birds sing their morning songs")], "item_id long, text string"))


def operators(spark):
    b = benchmark(spark)
    return {
        "op1": lambda d: substring_dedup.substring_dedup(d), "op1 texts": lambda d: substring_dedup.without_repeats(d), "op2": lambda d: license_scan.license_scan(d), "op4": lambda d: decontaminate.decontaminate(d, b),
        "op4 chunks": lambda d: decontaminate.decontaminate(d, b, keep=["doc_id", "__mask"], chunk_bytes=10), "op4 clean": lambda d: decontaminate.keep_clean(d, b, chunk_bytes=10), "op6": lambda d: langid.language_id(d),
        "op7": lambda d: tokens.token_counts(d, keep=["doc_id", "row", "rest"]), "op8": lambda d: near_dup.near_duplicates(d), "op8 rows": lambda d: near_dup.one_of_each(d), "op10": lambda d: packing.pack(d),
    }


@pytest.mark.parametrize("name", ["op1", "op1 texts", "op2", "op4", "op4 chunks", "op4 clean", "op6", "op7", "op8", "op8 rows", "op10"])
def test_operators(spark, docs, name):
    run = operators(spark)[name]
    got = run(docs).collect()
    assert run(docs.where("false")).count() == 0
    whole = name not in ("op1 texts", "op4 clean", "op8 rows")
    assert len(got) == len(ROWS) or not whole
    if name == "op4 chunks":
        assert {r["__mask"] for r in got} == {r["__mask"] for r in docs.select("__mask").collect()} and sum(r["contaminated"] for r in got) == 3
    if name in ("op1 texts", "op4 clean", "op8 rows"):
        assert run(docs).schema.simpleString() == docs.schema.simpleString()
        assert {str(r["dot.ted"]) for r in got} == {str(r["dot.ted"]) for r in docs.collect()}
    if name == "op6":
        assert {r["lang_pred"] for r in got if r["text"] in (None, "", "!!!")} == {"und"} and got[0]["row"] is not None


def test_other_tables(spark):
    talks = odd(spark.createDataFrame([(1, 0, "user", "a<b"), (1, 1, "assistant", None), (1, 2, "assistant", "c\\\\d"), (None, None, None, None)] * 2, "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: r for r in chat.read_back(chat.formatted(talks)).collect()}
    assert back[1]["loss_text"] == "c\\\\d" * 2 and len(back[1]["turns"]) == 6 and len(back[None]["turns"]) == 2
    vectors = odd(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [2.0, 0.0]), (None, None), (4, [0.0])], "vec_id long, embedding array<double>"))
    got = collections.Counter(map(tuple, embedding_dup.embedding_duplicates(vectors).collect()))
    assert got == {(1, 2, 1, True): 2, (None, 2, 1, False): 1, (None, 0, None, True): 1, (4, 0, 4, True): 1}
    pages = odd(spark.createDataFrame([(1, "u", None), (1, "u", "x" * 1000), (1, "u", "x" * 1000), (0, None, "x" * 1000)], "page_id long, url string, html string"))
    rows = warc.with_revisits(pages).collect()
    assert sorted((r["page_id"], r["refers_to"]) for r in rows if r["refers_to"] is not None) == [(0, 1)] and len(rows) == 4


def test_mask_that_does_not_fit(spark):
    out = chat.formatted(spark.createDataFrame([(1, 0, "assistant", "abc")], "conv_id long, turn long, role string, text string"))
    with pytest.raises(Exception, match="does not fit"):
        chat.read_back(out.withColumn("loss_runs", F.array(F.lit(5), F.lit(3), F.lit(8), F.lit(0)))).collect()


def test_long_conversation(spark):
    """One conversation with most of the rows."""
    rows = spark.range(30_000).selectExpr("if(id % 10 = 0, id, 7L) conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('<', repeat('ab ', 20), id) text")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(rows)).selectExpr("conv_id", "size(turns) n", "loss_text").collect()}
    assert got[7]["n"] == 27_000 and got[7]["loss_text"] == "".join(f"<{'ab ' * 20}{i}" for i in range(30_000) if i % 2 and i % 10)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_empty_tables(spark, tmp_path, name):
    schemas = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id long, text string", "embeddings": "vec_id long, embedding array<float>",
        "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn int, role string, text string", "labels": "doc_id long, quality int, toxic int",
    }
    for t, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{t}.parquet"))
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert [r["conv_id"] for r in got] == ([-7] if name == "op5_chat" else [])


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.drop("back`tick").write.parquet(str(tmp_path / "documents.parquet"))
    benchmark(spark).drop("back`tick").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = d.schema.simpleString()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path)).cache()
        kept[name] = d.count()
        if name != "packing":
            assert d.schema.simpleString() == names
            assert stage(spark, d.where("false"), str(tmp_path)).count() == 0
    assert kept["language"] == 5 and kept["near_duplicates"] == kept["repeats"] == 3 and kept["contamination"] == 2
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, run.drop("sequence_id", "offset").collect())) == sorted(map(str, d.drop("sequence_id", "offset").collect()))
