"""Word hashes on strings that collide under sums of powers, and key ranges."""

import numpy as np
import pyarrow as pa
import pytest

from tallyflow.llm import decontaminate, near_dup, substring_dedup, words


def twins():
    """A Thue-Morse string and its complement: equal under any polynomial hash modulo a power of two."""
    flip = str.maketrans("ab", "ba")
    t = "ab"
    for _ in range(9):
        t += t.translate(flip)
    return t, t.translate(flip)


def test_hashes_tell_words_apart():
    data, off = words.text_buffers(pa.array([" ".join([*twins(), "y" * 5000, "y" * 4999 + "z", "ab", "ab\0", "ab\0\0", "abcdefgh", "abcdefgh\0"]), " ".join(twins())]))
    w = words.find_words(data, off, words.WHITESPACE)
    spelled = [w.data[a:z].tobytes() for a, z in zip(w.start, w.end, strict=True)]
    for which in (0, 1):
        h = w.hashes(which).tolist()
        assert len(set(h)) == len(set(spelled)) == 9 and h[9:] == h[:2]
    assert not set(w.hashes(0).tolist()) & set(w.hashes(1).tolist())


def test_hash_does_not_depend_on_the_surroundings():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abé \t"), rng.integers(0, 60))) for _ in range(200)]
    whole = words.find_words(*words.text_buffers(pa.array(texts)), words.WHITESPACE)
    h, at = whole.hashes(), 0
    for t in texts:
        one = words.find_words(*words.text_buffers(pa.array([t])), words.WHITESPACE).hashes()
        assert one.tolist() == h[at : at + len(one)].tolist()
        at += len(one)


@pytest.mark.parametrize("ranges", [1, 2, 3, 211, 1 << 22])
def test_key_ranges(ranges):
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2))
    parts, edges = substring_dedup._runs(keys, ranges)
    assert edges[0] == 0 and edges[-1] == len(keys) and len(set(parts.tolist())) == len(parts) and parts.max() < ranges
    assert (substring_dedup._part(keys, ranges) == substring_dedup._part(keys | np.uint64(1), ranges)).all()


def test_op1_keeps_words_that_differ_in_the_middle(spark):
    a, b = twins()
    rows = [(i, " ".join(f"v{k}" if k != 6 else x for k in range(13))) for i, x in ((1, a), (2, b), (3, a))]
    got = {r["id"]: r["n_removed"] for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_op4_hits_no_other_word(spark):
    a, b = twins()
    text = lambda x: " ".join(f"v{k}" if k != 4 else x for k in range(10))
    docs = spark.createDataFrame([(1, text(a)), (2, text(b))], "doc_id long, text string")
    got = decontaminate.decontaminate(docs, spark.createDataFrame([(7, text(b))], "item_id long, text string")).collect()
    assert {r["doc_id"]: r["n_hit"] for r in got} == {1: 0, 2: 10}


def test_op8_keeps_texts_of_other_words(spark):
    a, b = twins()
    rows = [(1, " ".join([a, b] * 20)), (2, " ".join([b, a, b] * 20)), (3, " ".join([a] * 5)), (4, " ".join([b] * 5)), (5, " ".join([a] * 5))]
    got = {r["id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}
