"""What is sent to workers: kept columns once, batches in slices."""

import pyarrow as pa
import pytest

from tallyflow.llm import exchange, langid, near_dup


@pytest.fixture
def docs(spark):
    rows = [(i, None if i == 3 else chr(97 + i % 7) * (1 << 20), (i, str(i))) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, rest struct<a: int, b: string>").coalesce(1)


def sent(df) -> str:
    return next(x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "MapInArrow" in x)


def test_a_kept_column_is_sent_once(spark, docs):
    kept = langid.keep_identified(docs, {"en": b" the ", "de": b" der "})
    assert "k2#" in sent(kept) and "i0#" not in sent(kept)
    named = exchange.annotate(docs, ["doc_id"], {"text": "text"}, near_dup._weigh, {"keys": "binary", "weights": "binary"})
    assert "i0#" in sent(named)


def test_batches_are_taken_in_slices(docs):
    def held(b):
        return {"held": pa.array([b["text"].nbytes] * len(b["text"]), pa.int64())}

    got = exchange.annotate(docs, docs.columns, {"text": "text"}, held, {"held": "long"}).collect()
    assert max(r["held"] for r in got) < 2 * exchange.SLICE
    assert [tuple(r)[:-1] for r in got] == [tuple(r) for r in docs.collect()]


def test_slices_hold_all_rows():
    b = pa.RecordBatch.from_pydict({"x": pa.array([None, "a" * 100, "", "b" * 1000, "c"])})
    for most in (1, 50, 300, 10**6):
        assert pa.Table.from_batches(exchange.slices(b, most)).equals(pa.Table.from_batches([b]))
    assert not list(exchange.slices(b.slice(0, 0)))
