"""Substring dedup with difference-cover anchors (operator 1).

A window is ``WINDOW`` consecutive words.  A word goes if a window that covers
it also starts in a document with a smaller id.  Not every window is hashed:
anchors of seven words are hashed only where the word's place modulo 7 is in
the difference cover {0, 1, 3}.  Every difference modulo 7 is a difference of
two members, so two equal windows of 13 words always contain an equal anchor
that is at a cover place in both (7 places are tried, and 7 - 1 + 7 = 13).
Only windows that hold an anchor known from a second document are then
extended to the whole window and compared.

Documents are dealt to blocks by their id and text.  A block sends each distinct key
once, packed by key range, whatever its number of copies, so a hot passage
costs one key a block; the range's task answers with one bit a key.

1. block -> range: distinct anchors;  answer: in a second document?
2. block -> range: distinct windows around such anchors, 128-bit hashes, with
   the block's smallest id;  answer: is there a smaller id elsewhere?
3. block: mark the words, cut them out.

Windows are compared by two independent 64-bit hashes, not byte by byte.

Edge cases: a null or empty text has no words and stays as it is.  Rows with
equal ids count as one document and take nothing from each other; so do rows
without an id, which count as larger than any other.  Extra columns are
ignored by ``substring_dedup`` and kept by ``without_repeats``, whatever their
names and types.  An empty table gives no rows.  A text is held by one task
with some 30 bytes a word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import exchange, words

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
LARGEST_ID = (1 << 63) - 1

_PACKET = "part int, block int, keys binary"
_ANSWER = "block int, part int, step int, bits binary"


class _Block:
    """One block's documents: their words, anchors and windows, in pieces of bounded size."""

    def __init__(self, table: pa.Table, ranges: int):
        self.ranges = ranges
        self.ids = table.column("id").to_numpy()
        data, offsets = words.text_buffers(table.column("text"))
        self.parts = [words.find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words.WHITESPACE) for a, b in words.pieces(offsets)]
        self.base = [a for a, _ in words.pieces(offsets)]
        self.hashes = [w.hashes() for w in self.parts]

    def anchors(self) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
        """Places and keys of anchors by piece; the distinct keys, and which of them two documents here have."""
        at, keys, ids = [], [], []
        cover = np.zeros(PERIOD, dtype=bool)
        cover[list(COVER)] = True
        for w, h, base in zip(self.parts, self.hashes, self.base, strict=True):
            count = np.diff(w.first)
            # a word that can begin an anchor: at a cover place, in a document with a window, and with six words to come
            place = np.arange(len(w.start)) - np.repeat(w.first[:-1], count)
            p = np.flatnonzero(cover[place % PERIOD] & (place <= np.repeat(np.where(count >= WINDOW, count - ANCHOR, -1), count)))
            at.append(p)
            keys.append(words.window_hashes(h, ANCHOR, at=p) & ~np.uint64(1))
            ids.append(self.ids[w.doc[p] + base])
        distinct, low, high = _spread(np.concatenate(keys or [np.zeros(0, np.uint64)]), np.concatenate(ids or [np.zeros(0, np.int64)]))
        return at, keys, distinct, low != high

    def windows(self, bits: dict[int, bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, first hash, second hash) by piece of the windows around anchors that other documents have."""
        at, keys, distinct, _ = self.anchors()
        known = distinct[_unpack(bits, distinct, self.ranges)]
        out = []
        for w, h, p, k in zip(self.parts, self.hashes, at, keys, strict=True):
            p = p[_member(k, known)]
            # windows that hold such an anchor begin at it or up to six words before it
            q = np.unique((p[:, None] - np.arange(PERIOD)).reshape(-1))
            q = q[(q >= 0) & (q + WINDOW <= len(w.start))]
            q = q[w.doc[q] == w.doc[q + WINDOW - 1]]
            near = np.flatnonzero(_covered(q, len(w.start)))
            other = np.zeros(len(w.start), np.uint64)
            other[near] = w.hashes(1, near)
            out.append((q, words.window_hashes(h, WINDOW, at=q), words.window_hashes(other, WINDOW, 1, at=q)))
        return out

    def candidates(self, found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct windows, sorted: both hashes and the smallest id here."""
        h1, h2 = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.uint64)]) for i in (1, 2))
        ids = np.concatenate([self.ids[w.doc[f[0]] + b] for w, b, f in zip(self.parts, self.base, found, strict=True)] or [np.zeros(0, np.int64)])
        order = np.lexsort((ids, h2, h1))
        h1, h2, ids = h1[order], h2[order], ids[order]
        first = np.ones(len(h1), dtype=bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        return h1[first], h2[first], ids[first]


def _spread(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return keys, ids, ids
    return keys[at], np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)


def _covered(at: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words a window that starts ``at`` covers."""
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + WINDOW, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def _member(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), dtype=bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _part(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key; ranges are of an even width, as the last bit of an anchor is a mark."""
    return np.minimum(keys // np.uint64(((1 << 64) - 1) // ranges & ~1), np.uint64(ranges - 1)).astype(np.int64)


def _runs(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that sorted keys are in, and where those of each begin (with the end)."""
    part = _part(keys, ranges)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    return part[first], np.append(first, len(keys))


def _unpack(bits: dict[int, bytes], keys: np.ndarray, ranges: int) -> np.ndarray:
    """The answers to sorted keys, put together again from those of the ranges."""
    out = np.zeros(len(keys), dtype=bool)
    parts, edges = _runs(keys, ranges)
    for part, a, b in zip(parts.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if part in bits:
            out[a:b] = np.unpackbits(np.frombuffer(bits[part], np.uint8), count=b - a).astype(bool)
    return out


def _packets(block: int, ranges: int, columns: list[np.ndarray]) -> pa.Table:
    parts, edges = _runs(columns[0], ranges)
    rows = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"part": pa.array(parts, pa.int32()), "block": pa.array(np.full(len(parts), block), pa.int32()), "keys": pa.array(rows, pa.binary())})


def _answers(table: pa.Table, part: int, step: int, bits: list[np.ndarray]) -> pa.Table:
    n = len(bits)
    keep = [i for i in range(n) if bits[i].any()]
    return pa.table({
        "block": table.column("block").combine_chunks().take(pa.array(keep, pa.int64())),
        "part": pa.array([part] * len(keep), pa.int32()),
        "step": pa.array([step] * len(keep), pa.int32()),
        "bits": pa.array([np.packbits(bits[i]).tobytes() for i in keep], pa.binary()),
    })


def _split(flat: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(sizes)[:-1])


def _bits(answers: pa.Table, step: int) -> dict[int, bytes]:
    return {p: b for p, s, b in zip(*(answers.column(c).to_pylist() for c in ("part", "step", "bits")), strict=True) if s == step}


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with the repeats cut out of their texts (and ``chars_col`` counted anew); a row that lost all its words goes."""
    names = docs.columns
    rest = F.struct(*[exchange.quoted(c).alias(f"c{i}") for i, c in enumerate(names) if c != text_col])
    cut = _dedup(docs, id_col, text_col, True, rest).where("n_words = 0 or n_removed < n_words")
    back = {c: F.col(f"rest.c{i}") for i, c in enumerate(names) if c != text_col} | {text_col: F.col("kept_text")}
    if chars_col in names:
        back[chars_col] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema[chars_col].dataType)).otherwise(back[chars_col])
    return cut.select(*[back[c].alias(c) for c in names])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: ``id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by one space).

    ``with_text`` adds ``kept_text``: the text without the removed words and
    the white space after them, null for a null text, and itself if nothing
    was removed.
    """
    return _dedup(docs, id_col, text_col, with_text, None)


def _dedup(docs: DataFrame, id_col: str, text_col: str, with_text: bool, rest: Column | None) -> DataFrame:
    spark, passes = exchange.ship(docs.sparkSession), rest is not None
    total = exchange.text_bytes(docs, text_col)
    blocks, ranges = exchange.block_count(spark, total), exchange.block_count(spark, total, 16 << 20)
    number, text = exchange.quoted(id_col), exchange.quoted(text_col)
    columns = [F.coalesce(number.cast("long"), F.lit(LARGEST_ID)).alias("id"), number.isNull().alias("no_id"), text.alias("text")]
    rows = docs.select(*columns, *([rest.alias("rest")] if passes else []))
    # by id and text, so that different rows without an id, or with the same one, do not all meet
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))

    def send_anchors(key, table):
        _, _, distinct, twice = _Block(table, ranges).anchors()
        return _packets(key[0].as_py(), ranges, [distinct | twice.astype(np.uint64)])

    def judge_anchors(key, table):
        sent = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("keys").combine_chunks()]
        keys, count = np.unique(np.concatenate([k & ~np.uint64(1) for k in sent]), return_counts=True)
        twice = np.concatenate([k[(k & np.uint64(1)) > 0] for k in sent]) & ~np.uint64(1)
        known = np.union1d(keys[count > 1], twice)
        return _answers(table, key[0].as_py(), 1, [_member(k & ~np.uint64(1), known) for k in sent])

    def send_windows(key, table, answers):
        if not table.num_rows or not answers.num_rows:
            return _packets(0, ranges, [np.zeros(0, np.uint64)])
        b = _Block(table, ranges)
        return _packets(key[0].as_py(), ranges, list(b.candidates(b.windows(_bits(answers, 1)))))

    def judge_windows(key, table):
        sent = [np.frombuffer(b.as_buffer(), np.uint64).reshape(3, -1) for b in table.column("keys").combine_chunks()]
        h1, h2, ids = (np.concatenate([s[i] for s in sent]) for i in range(3))
        ids = ids.view(np.int64)
        order = np.lexsort((ids, h2, h1))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        least = ids[order][np.flatnonzero(first)][np.cumsum(first) - 1]
        smaller = np.empty(len(order), dtype=bool)
        smaller[order] = least < ids[order]
        return _answers(table, key[0].as_py(), 2, _split(smaller, [s.shape[1] for s in sent]))

    def cut(key, table, answers):
        b = _Block(table, ranges)
        found = b.windows(_bits(answers, 1)) if answers.num_rows else None
        if found:
            h1, h2, low = b.candidates(found)
            smaller = _unpack(_bits(answers, 2), h1, ranges)
        n_words, n_removed, digests, texts = [], [], [], []
        raw = table.column("text").combine_chunks()
        for i, w in enumerate(b.parts):
            gone = np.zeros(len(w.start), dtype=bool)
            if found and len(found[i][0]):
                q, k1, k2 = found[i]
                at = _find(h1, h2, k1, k2)
                gone = _covered(q[smaller[at] | (low[at] < b.ids[w.doc[q] + b.base[i]])], len(w.start))
            lost = np.concatenate([[0], np.cumsum(gone)])
            per = np.diff(w.first)
            n_words += per.tolist()
            n_removed += (lost[w.first[1:]] - lost[w.first[:-1]]).tolist()
            whole = w.data.tobytes()
            for d in range(len(per)):
                a, z = w.first[d], w.first[d + 1]
                keep = np.flatnonzero(~gone[a:z]) + a
                if len(keep) == z - a and z > a:
                    # bytes.split() has the same separators as the word class
                    kept = b" ".join(whole[w.start[a] : w.end[z - 1]].split())
                else:
                    kept = _joined(whole, w, keep)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(raw[len(texts)].as_py() if len(keep) == z - a else _without(whole, w, a, z, gone).decode("utf-8", "replace"))
        out = {"id": pa.array([None if x else int(i) for i, x in zip(b.ids, table.column("no_id").to_pylist(), strict=True)], pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}) | ({"rest": table.column("rest")} if passes else {}))

    a1 = rows.groupBy("block").applyInArrow(send_anchors, _PACKET).groupBy("part").applyInArrow(judge_anchors, _ANSWER)
    a2 = rows.groupBy("block").cogroup(a1.groupBy("block")).applyInArrow(send_windows, _PACKET).groupBy("part").applyInArrow(judge_windows, _ANSWER)
    schema = StructType.fromDDL("id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    if passes:
        schema = schema.add("rest", rows.schema["rest"].dataType)
    return rows.groupBy("block").cogroup(a1.unionByName(a2).groupBy("block")).applyInArrow(cut, schema)


def _joined(whole: bytes, w: words.Words, keep: np.ndarray) -> bytes:
    return b" ".join([whole[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)])


def _without(whole: bytes, w: words.Words, a: int, z: int, gone: np.ndarray) -> bytes:
    """The words a..z that stay, each with the white space after it."""
    end = np.append(w.start[a + 1 : z], w.end[z - 1])
    keep = np.flatnonzero(~gone[a:z])
    return b"".join([whole[s:e] for s, e in zip(w.start[a:z][keep].tolist(), end[keep].tolist(), strict=True)]).rstrip()


def _find(h1: np.ndarray, h2: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Where each pair (k1, k2) is among the sorted distinct pairs (h1, h2)."""
    at = np.searchsorted(h1, k1)
    while True:
        off = (h2[at] != k2) & (h1[at] == k1)
        if not off.any():
            return at
        at[off] += 1
