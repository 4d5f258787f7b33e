"""Benchmark decontamination with suffix arrays of the training text (operator 4).

Training text is cut into shards of a bounded size.  Each shard gets a suffix
array over its words, and every suffix of every test item is looked up in it
by binary search; runs of matches on a diagonal are joined to the longest
verbatim matches, with their places.  Words are lower-cased (A-Z) and hold
only digits, ASCII letters and non-ASCII characters.

A suffix can only match as far as its words occur in the benchmark at all, so
the array leaves out suffixes that meet a foreign word before the shortest
window ends; nothing that could match is lost.

The benchmark is streamed in chunks of ``CHUNK_BYTES`` of text at most.  Each
chunk goes to the tasks with the code of one narrow pass over the documents;
after ``CHUNKS_AT_ONCE`` of them the documents are written, so driver and plan
hold that many chunks whatever the benchmark's size.  There is no shuffle.

Edge cases: null and empty texts and items have no words and match nothing.
Items of fewer than ten words are one window.  Items with equal ids count
once; a null item id hits words but is not listed.  Each row of ``docs`` is
judged on its own, so null, equal and repeated ids change nothing.  Further
columns may have any names; a kept one with the name of a result is replaced
by it.  An empty table gives no rows, an empty benchmark hits nothing.  A long
text is one shard, held by one task with some 100 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, words

WINDOW = 10
CHUNK_BYTES = 8 << 20
CHUNKS_AT_ONCE = 8
SHARD_BYTES = 2 << 20

REPORT = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}
MATCH = "array<struct<item_id:string,item_start:int,doc_start:int,n_words:int>>"


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Places of all suffixes of an integer sequence in lexical order, by prefix doubling."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    width = 1
    order = np.argsort(rank, kind="stable")
    while n and rank.max() < n - 1:
        ahead = np.full(n, -1, dtype=np.int64)
        ahead[: n - width] = rank[width:] if width < n else ahead[:0]
        key = rank * (n + 1) + ahead + 1
        order = np.argsort(key, kind="stable")
        step = np.zeros(n, dtype=np.int64)
        step[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(step)
        width *= 2
    return order


@dataclass
class TestItems:
    """A chunk of the benchmark, ready for lookups; built once in each worker."""

    ids: list[str | None]
    vocab: np.ndarray  # sorted hashes
    spell: list[bytes]  # the word of each
    item: np.ndarray  # of each query suffix
    at: np.ndarray  # its first word's place in the item
    length: np.ndarray  # words that must match
    keys: np.ndarray  # their codes, three bytes a word
    shortest: int

    @staticmethod
    def of(rows: list[tuple[str | None, str | None]]) -> TestItems:
        data, offsets = words.text_buffers(pa.array([t for _, t in rows], pa.string()))
        w = words.find_words(data, offsets, words.NON_ALNUM, fold=True)
        vocab, first, code = np.unique(w.hashes(), return_index=True, return_inverse=True)
        spell = [w.data[w.start[i] : w.end[i]].tobytes() for i in first]
        bytes3 = codes(code)
        item, at, length, keys = [], [], [], []
        for d in range(len(rows)):
            a, z = int(w.first[d]), int(w.first[d + 1])
            m = min(WINDOW, z - a)
            for s in range(a, z - m + 1) if m else ():
                item.append(d)
                at.append(s - a)
                length.append(m)
                keys.append(bytes3[s : s + m].tobytes())
        return TestItems([i for i, _ in rows], vocab, spell, np.array(item, int), np.array(at, int), np.array(length, int), np.array(keys, f"S{3 * WINDOW}"), min(length, default=WINDOW))


def codes(code: np.ndarray) -> np.ndarray:
    """Three bytes for each word code, none of them zero, in the order of the codes."""
    return np.stack([code // (255 * 255) % 255, code // 255 % 255, code % 255], axis=1).astype(np.uint8) + np.uint8(1)


def find(items: TestItems, w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """(word index, query index) of every place of the shard where a test suffix's window stands."""
    none = np.zeros(0, int), np.zeros(0, int)
    if not len(items.vocab) or not len(items.keys) or not len(w.start):
        return none
    h = w.hashes()
    code = np.minimum(np.searchsorted(items.vocab, h), len(items.vocab) - 1)
    known = items.vocab[code] == h
    n = len(h)
    last = np.ones(n, dtype=bool)  # a run ends before a foreign word and at its text's end
    last[:-1] = (w.doc[1:] != w.doc[:-1]) | ~known[1:]
    ends = np.flatnonzero(last)
    run_end = ends[np.searchsorted(ends, np.arange(n))]
    starts = np.flatnonzero(known & np.concatenate([[True], last[:-1] | ~known[:-1]]))
    long = run_end[starts] - starts + 1 >= items.shortest
    starts, stops = starts[long], run_end[starts[long]] + 1
    if not len(starts):
        return none
    # the runs one after the other, each closed by a sign of its own
    sizes = stops - starts + 1
    place = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    close = np.cumsum(sizes) - 1
    seq = code[np.minimum(place, n - 1)].astype(np.int64) + len(starts)
    seq[close] = np.arange(len(starts))
    order = suffix_array(seq)
    order = order[len(starts) :]  # those that begin with a sign stand first
    left = np.repeat(close, sizes)[order] - order  # words before the run closes
    order = order[left >= items.shortest]
    three = codes(seq - len(starts))
    three[close] = 0
    three = np.concatenate([three, np.zeros((WINDOW, 3), np.uint8)])
    prefix = np.lib.stride_tricks.sliding_window_view(three.reshape(-1), 3 * WINDOW)[::3][order]
    # after a run's end nothing counts
    left = np.repeat(close, sizes)[order] - order
    prefix = np.where(np.arange(3 * WINDOW) < 3 * left[:, None], prefix, 0).astype(np.uint8)
    table = np.ascontiguousarray(prefix).view(f"S{3 * WINDOW}").reshape(-1)
    low = np.searchsorted(table, items.keys, side="left")
    top = np.array([k + b"\xff" * (3 * WINDOW - len(k)) for k in items.keys.tolist()], f"S{3 * WINDOW}")
    high = np.searchsorted(table, top, side="right")
    count = np.maximum(high - low, 0)
    query = np.repeat(np.arange(len(count)), count)
    if not len(query):
        return none
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = place[order[low[query] + within]]
    # equal hashes are compared letter by letter
    same = np.zeros(n, dtype=bool)
    for i in np.unique((at[:, None] + np.arange(WINDOW)).clip(max=n - 1)):
        same[i] = known[i] and w.data[w.start[i] : w.end[i]].tobytes() == items.spell[code[i]]
    wrong = np.concatenate([[0], np.cumsum(~same)])
    right = wrong[at + items.length[query]] == wrong[at]
    return at[right], query[right]


def _longest(items: TestItems, w: words.Words, at: np.ndarray, query: np.ndarray) -> list[list[dict]]:
    """The longest verbatim matches of each text: windows that follow on one diagonal become one."""
    found: list[list[dict]] = [[] for _ in range(len(w.first) - 1)]
    item, s, m = items.item[query], items.at[query], items.length[query]
    order = np.lexsort((at, at - s, item, w.doc[at]))
    run = None
    for i in order.tolist():
        d, here = int(w.doc[at[i]]), int(at[i] - w.first[w.doc[at[i]]])
        if run and run["key"] == (d, item[i], at[i] - s[i]) and here <= run["doc_start"] + run["n_words"]:
            run["n_words"] = here + int(m[i]) - run["doc_start"]
            continue
        run = {"key": (d, item[i], at[i] - s[i]), "item_id": items.ids[item[i]], "item_start": int(s[i]), "doc_start": here, "n_words": int(m[i])}
        found[d].append(run)
    return [[{k: v for k, v in r.items() if k != "key"} for r in f] for f in found]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of ``docs``: the ``keep`` columns (the id if none are named), the columns of ``REPORT`` and ``matches``.

    ``matches`` lists the longest verbatim matches: the item, the first word in
    the item and in the document, and the length in words.
    """
    exchange.ship(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    # what one chunk's pass tells the next, under names that no column has
    mark, given = "__", docs.columns
    while any(c.startswith(mark) for c in given):
        mark += "_"
    state = {"mask": "binary", "items": "array<string>", "matches": MATCH}
    past = None
    for k, (chunk, final) in enumerate(chunks_of(benchmark, item_id_col, item_text_col, chunk_bytes)):
        if k and k % CHUNKS_AT_ONCE == 0:
            docs = exchange.materialize(docs, "contamination")
            exchange.discard(*([] if past is None else [past]))
            past = docs
        inputs = {"text": text_col} | ({c: f"{mark}{c}" for c in state} if k else {})
        out = REPORT | {"matches": MATCH} if final else {f"{mark}{c}": t for c, t in state.items()}
        look = _pass(chunk, final)
        docs = exchange.annotate(docs, keep if final else given, inputs, look if final else lambda b, look=look: {f"{mark}{c}": x for c, x in look(b).items()}, out)
    return docs


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows that no window of the benchmark hits, unchanged."""
    exchange.ship(docs.sparkSession)
    past = None
    for k, (chunk, _) in enumerate(chunks_of(benchmark, item_id_col, item_text_col, chunk_bytes)):
        if k and k % CHUNKS_AT_ONCE == 0:
            docs = exchange.materialize(docs, "contamination")
            exchange.discard(*([] if past is None else [past]))
            past = docs
        look = _pass(chunk, True)
        docs = exchange.kept_rows(docs, {"text": text_col}, lambda b, look=look: pc.invert(look(b)["contaminated"]))
    return docs


def chunks_of(benchmark: DataFrame, item_id_col: str, item_text_col: str, chunk_bytes: int) -> Iterator[tuple[list[tuple], bool]]:
    """The test items in chunks of bounded text (an item larger than that stands alone), and whether one is the last; one at least."""
    chunk: list[tuple] = []
    held = 0
    for i, t in benchmark.select(exchange.quoted(item_id_col).cast("string"), exchange.quoted(item_text_col)).toLocalIterator():
        size = len((t or "").encode("utf-8", "surrogatepass"))
        if chunk and held + size > chunk_bytes:
            yield chunk, False
            chunk, held = [], 0
        chunk.append((i, t))
        held += size
    yield chunk, True


def _pass(chunk: list[tuple], final: bool):
    ready: list[TestItems] = []

    def run(b: dict[str, pa.Array]) -> dict[str, pa.Array]:
        if not ready:
            ready.append(TestItems.of(chunk))
        items = ready[0]
        data, offsets = words.text_buffers(b["text"])
        masks, named, matches, lengths = [], [], [], []
        for lo, hi in words.pieces(offsets, SHARD_BYTES):
            w = words.find_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words.NON_ALNUM, fold=True)
            at, query = find(items, w)
            edge = np.zeros(len(w.start) + 1, dtype=np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + items.length[query], -1)
            hit = np.cumsum(edge[:-1]) > 0
            names: dict[int, set] = {}
            for d, i in set(zip(w.doc[at].tolist(), items.item[query].tolist(), strict=True)):
                if items.ids[i] is not None:
                    names.setdefault(d, set()).add(items.ids[i])
            found = _longest(items, w, at, query)
            for d in range(hi - lo):
                masks.append(hit[w.first[d] : w.first[d + 1]])
                named.append(names.get(d, set()))
                matches.append(found[d])
            lengths += np.diff(w.first).tolist()
        if "mask" in b:
            for i, (m, n, x) in enumerate(zip(b["mask"].to_pylist(), b["items"].to_pylist(), b["matches"].to_pylist(), strict=True)):
                masks[i] = masks[i] | np.unpackbits(np.frombuffer(m, np.uint8), count=lengths[i]).astype(bool)
                named[i] = named[i] | set(n)
                matches[i] = x + matches[i]
        kind = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())]))
        if not final:
            return {"mask": pa.array([np.packbits(m).tobytes() for m in masks], pa.binary()), "items": pa.array([sorted(n) for n in named], pa.list_(pa.string())), "matches": pa.array(matches, kind)}
        n_hit = [int(m.sum()) for m in masks]
        return {
            "n_words": pa.array(lengths, pa.int64()),
            "n_hit": pa.array(n_hit, pa.int64()),
            "n_items": pa.array([len(n) for n in named], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(sorted(n)).encode()).hexdigest() for n in named], pa.string()),
            "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_()),
            "matches": pa.array(matches, kind),
        }

    return run
