"""MinHash near-dedup with ProbMinHash (operator 8).

A document is its five-word shingles with their numbers as weights.  Each
shingle is a Poisson process whose rate is its weight; its arrivals go to
random registers, and a register keeps the shingle that came first.  Arrivals
later than the latest register of the document cannot win, so most processes
end at once.  Two documents agree in a register with the probability
Jaccard similarity of their weighted shingles, which is the plain Jaccard
similarity where no shingle is repeated.

``BANDS`` bands of ``ROWS`` registers propose pairs; a pair at 0.8 is missed
with probability (1 - 0.8**6)**40 < 6e-6.  Each proposed pair is verified by
the exact similarity.

Equal documents are collapsed first.  Within a bucket the members are compared
with one centre, not with each other: with the member whose buckets hold the
most documents together, which is the original rather than one of its copies.
Where that leaves a bucket in several classes, its members outside the largest
class are compared by finer signatures with all members of other classes, in
tasks that hold pairs of chunks of a bucket; pairs that agree in ``COARSE`` of
the first ``GLANCE`` registers and in ``SCREEN`` of all ``FINE`` (at 0.8 fewer
agree with probability 6e-6 each) are verified too.  So every pair of members
is in one class, or was compared and is no link, and a bucket of copies costs
its size.

Rows get numbers when they are signed and written; these, not the ids, tell
documents apart from then on.

Edge cases: null and empty texts, and those of white space, have no shingles
and are classes of their own, kept.  A text of fewer than five words is one
shingle.  Rows with equal ids are documents like others: of different texts
they may be in different classes, of equal texts one row is kept.  A null id
counts as larger than any other; a class of null ids only has a null class id,
and one row of it is kept.  Extra columns may have any names and types.  An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, exchange, words

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 6, 40
FINE, SCREEN = 1024, 0.745
GLANCE, COARSE = 256, 0.69
CHUNK = 1024
PIECE = 2 << 20


def weighted_shingles(w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, weight), sorted by both, each shingle of a text once."""
    doc, h = words.shingles(w, SHINGLE)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(first)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Signatures, one row a document: the element that came first to each register (0 if there is none)."""
    first = np.full(n_docs * registers, np.inf)
    winner = np.zeros(n_docs * registers, np.uint64)
    latest = np.full(n_docs, np.inf)
    time = np.zeros(len(doc))
    weight = weight.astype(float)
    arrival = 0
    while len(doc):
        arrival += 1
        draw = words.mix(element, arrival * 0x9E3779B97F4A7C15)
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        alive = time < latest[doc]
        doc, element, weight, time, draw = doc[alive], element[alive], weight[alive], time[alive], draw[alive]
        register = ((words.mix(draw) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64) + doc * registers
        np.minimum.at(first, register, time)
        won = first[register] == time
        winner[register[won]] = element[won]
        touched = np.flatnonzero(np.bincount(doc, minlength=n_docs)) if len(doc) else doc
        latest[touched] = first.reshape(n_docs, registers)[touched].max(axis=1)
        alive = time < latest[doc]
        doc, element, weight, time = doc[alive], element[alive], weight[alive], time[alive]
    return winner.reshape(n_docs, registers)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.zeros((len(signatures), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        for r in range(ROWS):
            keys = words.mix(keys * np.uint64(0x9FB21C651E98DF25) + signatures[:, r::ROWS], r + 1)
    return keys


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact similarity of two weighted sets (sorted keys): sum over shared x of 1 / sum over y of max(a(y)/a(x), b(y)/b(x))."""
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    if (x == x[0]).all() and (y == x[0]).all() and wa.max() == wa.min() and wb.max() == wb.min():
        return len(common) / (len(a) + len(b) - len(common))
    only_a, only_b = float(wa.sum() - x.sum()), float(wb.sum() - y.sum())
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    low = np.searchsorted(ratio, ratio, side="left")
    below_b = np.concatenate([[0.0], np.cumsum(y)])[low] + only_b
    above_a = only_a + x.sum() - np.concatenate([[0.0], np.cumsum(x)])[low]
    return float((1.0 / (above_a / x + below_b / y)).sum())


def _runs(column: pa.Array):
    data, offsets = words.text_buffers(column)
    for lo, hi in words.pieces(offsets, PIECE):
        w = words.find_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words.WHITESPACE)
        yield hi - lo, *weighted_shingles(w)


def _sign(b: dict[str, pa.Array]) -> dict[str, pa.Array]:
    same: list[np.ndarray] = []
    bands: list = []
    for n, doc, h, weight in _runs(b["text"]):
        with np.errstate(over="ignore"):
            sums = []
            for salt in (11, 12):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(h, salt) * weight.astype(np.uint64), dtype=np.uint64)])
                edge = np.searchsorted(doc, np.arange(n + 1))
                sums.append(total[edge[1:]] - total[edge[:-1]])
        same.append(np.stack(sums).view(np.int64))
        has = np.diff(edge) > 0
        keys = band_keys(prob_minhash(doc, h, weight, n, ROWS * BANDS)).view(np.int64)
        bands += [k if x else None for k, x in zip(keys, has.tolist(), strict=True)]
    both = np.concatenate(same, axis=1) if same else np.zeros((2, 0), np.int64)
    return {"t1": pa.array(both[0]), "t2": pa.array(both[1]), "bands": pa.array(bands, pa.list_(pa.int64()))}


def _weigh(b: dict[str, pa.Array]) -> dict[str, pa.Array]:
    keys, weights = [], []
    for n, doc, h, weight in _runs(b["text"]):
        edge = np.searchsorted(doc, np.arange(n + 1))
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            keys.append(h[a:z].tobytes())
            weights.append(weight[a:z].astype(np.uint32).tobytes() if (weight[a:z] > 1).any() else b"")
    return {"keys": pa.array(keys, pa.binary()), "weights": pa.array(weights, pa.binary())}


def _resign(b: dict[str, pa.Array]) -> dict[str, pa.Array]:
    """One byte of each register of the fine signature, and the buckets, from the stored shingles."""
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in b["keys"]]
    weights = [np.frombuffer(x.as_buffer(), np.uint32) if len(x.as_buffer()) else np.ones(len(k)) for x, k in zip(b["weights"], keys, strict=True)]
    sizes = np.array([len(k) for k in keys], dtype=np.int64)
    signs, buckets = [], []
    for lo, hi in words.pieces(np.concatenate([[0], np.cumsum(sizes + FINE)]), PIECE >> 3):
        doc = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        weighted = np.concatenate(keys[lo:hi]), np.concatenate(weights[lo:hi])
        signs += [x.tobytes() for x in words.mix(prob_minhash(doc, *weighted, hi - lo, FINE)).astype(np.uint8)]
        buckets += [x.tobytes() for x in band_keys(prob_minhash(doc, *weighted, hi - lo, ROWS * BANDS))]
    return {"sign": pa.array(signs, pa.binary()), "bands": pa.array(buckets, pa.binary())}


def _screen(batches):
    """Pairs of different classes in one bucket whose signatures agree far enough; a pair comes from the first bucket that it shares.

    That bucket is compared as well: it holds two classes, and is not a bucket of these two alone, whose pair is tested.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    bucket, rep, klass, largest, own, low, high = (t.column(c).to_numpy() for c in ("bucket", "rep", "class", "largest", "own", "low", "high"))
    signs = np.frombuffer(b"".join(t.column("sign").to_pylist()), np.uint8).reshape(len(rep), FINE)
    bands = np.frombuffer(b"".join(t.column("bands").to_pylist()), np.int64).reshape(len(rep), -1)
    order = np.lexsort((rep, high, low, bucket))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(bucket[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
    edges = np.append(np.flatnonzero(new), len(order))
    glance = np.ascontiguousarray(signs[:, :GLANCE])
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        group = order[a:z]
        heads, tails = [], []
        crossed = low[group[0]] != high[group[0]]
        for i in group[~largest[group]]:
            others = group[(klass[group] != klass[i]) & ((own[group] != own[i]) if crossed else (largest[group] | (rep[group] > rep[i])))]
            near = others[np.count_nonzero(glance[others] == glance[i], axis=1) >= COARSE * GLANCE]
            near = near[np.count_nonzero(signs[near] == signs[i], axis=1) >= SCREEN * FINE]
            if len(near):
                near = near[bands[i][(bands[near] == bands[i]).argmax(axis=1)] == bucket[i]]
            heads.append(np.minimum(rep[near], rep[i]))
            tails.append(np.maximum(rep[near], rep[i]))
        if heads and sum(map(len, heads)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), pa.array(np.concatenate(tails))], ["a", "b"])


def _comparer(similarity: float):
    def compare(pairs, texts):
        held = {}
        for i, k, w in zip(texts.column("id").to_pylist(), texts.column("keys").to_pylist(), texts.column("weights").to_pylist(), strict=True):
            held[i] = np.frombuffer(k, np.uint64), np.frombuffer(w, np.uint32) if w else np.ones(len(k) // 8)
        found = [(a, b) for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True) if probability_jaccard(*held[a], *held[b]) >= similarity]
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return compare


def _signed(docs: DataFrame, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """Each row with a number, its text, the ``rest`` columns as a struct, the text's 128-bit content hash and its bands."""
    rows = docs.select(
        exchange.quoted(id_col).cast("long").alias("id"),
        exchange.quoted(text_col).cast("string").alias("text"),
        F.struct(F.lit(0).alias("none"), *[exchange.quoted(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("rest"),
    ).withColumn("row", F.monotonically_increasing_id())
    made = exchange.annotate(rows, ["row", "id", "text", "rest"], {"text": "text"}, _sign, {"t1": "long", "t2": "long", "bands": "array<long>"})
    return exchange.materialize(made, "signed")


def _bucket_members(texts: DataFrame) -> DataFrame:
    """(bucket, rep, n, centre) of all buckets with more than one distinct text."""
    spread = texts.select("rep", F.explode("bands").alias("bucket"))
    counts = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("b"), "n")
    shared = exchange.lookup(spread, counts, {"key": F.bitwise_not("bucket")}, {"key": F.bitwise_not("b")}, "inner")
    shared = exchange.materialize(shared.select("bucket", "rep", "n"), "shared")
    reach = shared.groupBy("rep").agg(F.sum("n").alias("reach")).withColumnRenamed("rep", "r")
    ranked = shared.join(reach.hint("merge"), F.col("rep") == F.col("r")).drop("r")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("reach", (-F.col("rep")).alias("rep"))).alias("m"))
    hubs = hubs.select(F.col("bucket").alias("b"), (-F.col("m.rep")).alias("centre"))
    members = exchange.lookup(shared, hubs, {"key": F.bitwise_not("bucket")}, {"key": F.bitwise_not("b")}, "inner")
    members = exchange.materialize(members.select("bucket", "rep", "n", "centre"), "members")
    exchange.discard(shared)
    return members


def _verified(pairs: DataFrame, shingled: DataFrame, similarity: float) -> DataFrame:
    """The pairs that are similar; documents meet by pairs of blocks, so one with many partners is not sent for each."""
    blocks = F.lit(max(1, -(-pairs.count() // 2048)))
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("a"), blocks).alias("ba"), F.pmod(F.xxhash64("b"), blocks).alias("bb"))
    wants = pairs.select(F.col("a").alias("want"), "ba", "bb").unionByName(pairs.select(F.col("b").alias("want"), "ba", "bb")).distinct()
    sent = exchange.lookup(wants, shingled, {"key": F.bitwise_not("want")}, {"key": F.bitwise_not("id")}, "inner")
    sent = sent.select(F.col("ba").alias("xa"), F.col("bb").alias("xb"), "id", "keys", "weights")
    return pairs.groupBy("ba", "bb").cogroup(sent.groupBy("xa", "xb")).applyInArrow(_comparer(similarity), "a long, b long")


def _split_buckets(members: DataFrame, classes: DataFrame, chunk: int) -> DataFrame:
    """Members of buckets that are still in several classes, once for each pair of chunks that they take part in."""
    known = exchange.lookup(members.where("n > 2").select("bucket", "rep"), classes, {"key": F.bitwise_not("rep")}, {"key": F.bitwise_not("node")})
    known = exchange.materialize(known.select("bucket", "rep", F.coalesce("component", "rep").alias("class")), "known")
    sizes = known.groupBy("bucket", "class").agg(F.count("*").alias("size"))
    split = sizes.groupBy("bucket").agg(F.count("*").alias("classes"), F.sum("size").alias("all"), F.max(F.struct("size", "class")).alias("m"))
    split = split.where("classes > 1").select(F.col("bucket").alias("b"), F.col("m.class").alias("main"), F.ceil(F.col("all") / chunk).cast("int").alias("chunks"))
    dealt = exchange.lookup(known, split, {"key": F.bitwise_not("bucket")}, {"key": F.bitwise_not("b")}, "inner")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("bucket", "rep", "class", (F.col("class") == F.col("main")).alias("largest"), "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    dealt = exchange.materialize(dealt, "open")
    exchange.discard(known)
    return dealt


def _screened(dealt: DataFrame, shingled: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs of split buckets that the finer signatures let through and that were not tested yet."""
    signs = shingled.join(dealt.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi")
    signs = exchange.annotate(signs, ["id"], {c: F.col(c) for c in ("keys", "weights")}, _resign, {"sign": "binary", "bands": "binary"})
    parts = max(2 * exchange.shuffle_width(dealt.sparkSession), dealt.count() // 20_000)
    held = exchange.lookup(dealt, signs.withColumnRenamed("id", "signed_id"), {"key": F.bitwise_not("rep")}, {"key": F.bitwise_not("signed_id")}, "inner").drop("signed_id")
    pairs = held.repartition(parts, "bucket", "low", "high").mapInArrow(_screen, "a long, b long").distinct()
    return pairs.join(tested, ["a", "b"], "left_anti")


def _classified(signed: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """(row, id, class_id, kept) of all signed rows, written."""
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")
    texts = signed.where("bands is not null").groupBy("t1", "t2").agg(best, F.first("bands").alias("bands"))
    texts = exchange.materialize(texts.select("t1", "t2", F.col("best.no_id").alias("no_id"), F.col("best.id").alias("id"), F.col("best.row").alias("rep"), "bands"), "texts")
    members = _bucket_members(texts)
    wanted = members.select(F.col("rep").alias("row")).distinct()
    shingled = signed.select("row", "text").join(wanted, "row", "left_semi").withColumnRenamed("row", "id")
    shingled = exchange.materialize(exchange.annotate(shingled, ["id"], {"text": "text"}, _weigh, {"keys": "binary", "weights": "binary"}), "shingled")

    tested = members.where("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    tested = exchange.materialize(tested, "pairs")
    links = exchange.materialize(_verified(tested, shingled, similarity), "verified")
    classes = exchange.materialize(components.connected_components(links), "classes")
    dealt = _split_buckets(members, classes, chunk)
    more = exchange.materialize(_screened(dealt, shingled, tested), "pairs")
    new = exchange.materialize(_verified(more, shingled, similarity), "verified")
    exchange.discard(members, tested, dealt, more, shingled)
    if not exchange.is_empty(new):
        past, classes = classes, exchange.materialize(components.connected_components(links.unionByName(new)), "classes")
        exchange.discard(past)
    exchange.discard(links, new)

    # the first row of each class, for its texts, for all rows
    linked = classes.join(texts.select("rep", "no_id", "id").hint("merge"), F.col("node") == F.col("rep"))
    firsts = linked.groupBy("component").agg(F.min(F.struct("no_id", "id", "rep")).alias("w"))
    firsts = firsts.select(F.col("component").alias("c"), F.col("w.id").alias("class_id"), F.col("w.rep").alias("first"))
    told = exchange.lookup(linked.select("node", "component"), firsts, {"key": F.bitwise_not("component")}, {"key": F.bitwise_not("c")}, "inner").select("node", "class_id", "first")
    named = exchange.lookup(texts.select("t1", "t2", "id", "rep"), told, {"key": F.bitwise_not("rep")}, {"key": F.bitwise_not("node")})
    alone = F.col("first").isNull()
    named = named.select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("first", "rep").alias("first"))
    # rows without shingles get keys that no text has and that do not meet
    has = F.col("bands").isNotNull()
    rows = signed.select("row", "id", F.when(has, F.bitwise_not("t1")).otherwise(F.xxhash64("row")).alias("x1"), F.when(has, F.bitwise_not("t2")).alias("x2"))
    out = exchange.lookup(rows, named, {"k1": F.col("x1"), "k2": F.col("x2")}, {"k1": F.bitwise_not("u1"), "k2": F.bitwise_not("u2")})
    out = out.select("row", "id", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce(F.col("first") == F.col("row"), F.lit(True)).alias("kept"))
    out = exchange.materialize(out, "result")
    exchange.discard(texts, classes)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``docs``: ``id``, ``class_id`` (the smallest id of its class), ``kept`` (true for one row a class, of that id)."""
    exchange.ship(docs.sparkSession)
    signed = _signed(docs, id_col, text_col, [])
    out = _classified(signed, similarity, chunk)
    exchange.discard(signed)
    return out.drop("row")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged: one of each class."""
    exchange.ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    signed = _signed(docs, id_col, text_col, rest)
    gone = _classified(signed, similarity, CHUNK).where("not kept").select("row")
    back = {text_col: F.col("text")} | {c: F.col(f"rest.c{i}") for i, c in enumerate(rest)}
    kept = signed.join(gone.hint("merge"), "row", "left_anti").select(*[back[c].alias(c) for c in docs.columns])
    # written, so that the larger table of all rows with their bands does not outlive the call
    kept = exchange.materialize(kept, "kept")
    exchange.discard(signed)
    return kept
