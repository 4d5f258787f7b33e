"""Language ID by compression (operator 6).

For each language a zstandard raw-content dictionary is made of a bounded
sample of labelled rows: those with the smallest hashes of id and text,
``SAMPLE_DOCS`` a language at most, with their whole texts.  Equal rows count
once, so null or repeated ids neither crowd the sample nor lift its bound.  The
dictionary holds the sample's words, the most frequent ones last, where
references to them are shortest, and at most ``DICTIONARY_BYTES``; words are
counted by the executors, and the driver gets no more than can fit.  All of a
text is encoded with every dictionary, in blocks of ``BLOCK_BYTES`` that each
start from the dictionary; the language of the smallest sum of sizes wins.  The
score is the margin ``1 - smallest / second``.  A text is rejected if it has no
letter, or if the margin is below ``MARGIN``.

A dictionary saves a nearly constant number of bytes each time it is used: over
a text encoded at once the margin would fall as one over its length, and clean
long texts would be rejected.  With blocks savings and sizes both grow with
their number, so the margin of a long text is that of its blocks.

The coder takes the first match of four bytes or more that it finds; searching
longer compresses every language better and tells them apart less.  Texts are
compared by their letters: lower-cased, all other ASCII one space.

Edge cases: a null text, an empty one or one without a letter is ``und`` with
score 0; so is everything if no row is labelled.  With one learned language
all else is that, with score 1.  Ties go to the alphabetically first language
with score 0.  Labels, sources and ids are no inputs of a prediction.  Repeated
rows are predicted row by row.  Further columns stay as they are, whatever their
names and types; one with the name of a result is replaced by it.  An empty
table teaches nothing and gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange

SAMPLE_DOCS = 96
DICTIONARY_BYTES = 8 << 10
BLOCK_BYTES = 2 << 10  # as long as an ordinary text, so longer ones have margins like it
MARGIN = 0.001
CODER = {"strategy": zstandard.STRATEGY_GREEDY, "min_match": 4, "window_log": 18, "hash_log": 16, "chain_log": 16, "search_log": 4, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
UNDETERMINED = "und"

_letter = regex.compile(r"\p{L}")
_letters = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_letters).split())


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train: Column) -> dict[str, bytes]:
    """Language to dictionary content, from the labelled rows for which ``train`` holds."""
    exchange.ship(docs.sparkSession)
    rows = docs.where(train & exchange.quoted(lang_col).isNotNull() & exchange.quoted(text_col).isNotNull())
    rows = rows.select(exchange.quoted(lang_col).alias("lang"), F.xxhash64(exchange.quoted(id_col).cast("string"), exchange.quoted(text_col)).alias("h"), exchange.quoted(text_col).alias("text"))

    def least(batches):
        """The smallest distinct hashes a language of one task."""
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang in b.column(0).unique():
                h = b.column(1).filter(pc.equal(b.column(0), lang)).to_numpy()
                held[lang.as_py()] = np.unique(np.append(held.get(lang.as_py(), h[:0]), h))[:SAMPLE_DOCS]
        for lang, h in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h, pa.int64())], ["lang", "h"])

    first = rows.select("lang", "h").mapInArrow(least, "lang string, h long").distinct()
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= SAMPLE_DOCS)
    last: dict[str, int] = {r["lang"]: r["last"] for r in first.groupBy("lang").agg(F.max("h").alias("last")).collect()}
    if not last:
        return {}
    below = F.create_map(*[F.lit(x) for kv in last.items() for x in kv])
    sample = rows.where(F.col("h") <= below[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def spell(batches):
        """The words of each text with their numbers; a longer one than the dictionary is no help."""
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n = Counter(w for w in plain(text.as_py()).split() if len(w) < DICTIONARY_BYTES - 1)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["lang", "word", "n"])

    spelled = sample.select("lang", "text").mapInArrow(spell, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    spelled = spelled.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= DICTIONARY_BYTES // 2)
    seen: dict[str, Counter] = {lang: Counter() for lang in last}
    for r in spelled.collect():
        seen[r["lang"]][bytes(r["word"])] = r["n"]
    return {lang: dictionary(count) for lang, count in sorted(seen.items())}


def dictionary(count: Counter) -> bytes:
    """The most frequent words that fit, the most frequent last."""
    words, size = [], 1
    for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0])):
        size += len(w) + 1
        if size > DICTIONARY_BYTES:
            break
        words.append(w)
    return b" " + b" ".join(reversed(words)) + b" "


def identify(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", keep: list[str] | None = None, margin: float = MARGIN) -> DataFrame:
    """The ``keep`` columns of each row with ``lang_pred``, ``score`` and ``rejected``."""
    exchange.ship(docs.sparkSession)
    out = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    return exchange.annotate(docs, docs.columns if keep is None else keep, {"text": text_col}, predictor(model, margin), out)


def keep_identified(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows that are not rejected, unchanged."""
    exchange.ship(docs.sparkSession)
    predict = predictor(model, margin)
    return exchange.kept_rows(docs, {"text": text_col}, lambda b: pc.invert(predict(b)["rejected"]))


def predictor(model: dict[str, bytes], margin: float):
    ready: list[zstandard.ZstdCompressor] = []

    def run(b: dict[str, pa.Array]) -> dict[str, pa.Array]:
        if not ready:
            for content in model.values():
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=zstandard.ZstdCompressionParameters(**CODER))
                ready.append(zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(**CODER), dict_data=d))
        names = list(model)
        pred, score, rejected = [], [], []
        for t in b["text"].to_pylist():
            if not names or t is None or not _letter.search(t):
                pred.append(UNDETERMINED)
                score.append(0.0)
                rejected.append(True)
                continue
            p = plain(t)
            blocks = [p[a : a + BLOCK_BYTES] for a in range(0, len(p), BLOCK_BYTES)]
            sizes = [sum(len(c.compress(x)) for x in blocks) for c in ready]
            best = min(sizes)
            rest = sorted(sizes)[1:] or [best * 10**9]
            m = max(0.0, 1.0 - best / rest[0])
            pred.append(names[sizes.index(best)])
            score.append(m)
            rejected.append(m < margin)
        return {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 1 modulo 3 (a null id is not held out)."""
    return F.coalesce(F.crc32(exchange.quoted(id_col).cast("string")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Learn from the rows that are not held out and predict all rows."""
    return identify(docs, learn(docs, id_col, text_col, lang_col, ~held_out(id_col)), text_col, keep)
