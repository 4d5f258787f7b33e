"""Best-fit packing by bin completion (operator 10).

Documents become token ids and an end token; longer ones than a sequence are
cut so that only the first piece is shorter.  Pieces of one length are alike,
so the packing is made on the histogram of lengths, which has ``CAPACITY``
entries whatever the corpus: a plan is a list of fillings, each with a number
of repeats.  The driver sees the histogram and nothing else.

``plan`` is bin completion by branch and bound: take the largest length left,
go through all undominated fillings around it, least waste first, repeat one
as often as the counts allow and then less often, and give up a branch whose
waste cannot beat the incumbent.  The first incumbent is best-fit decreasing.
The search ends when the incumbent meets the lower bound, when all is tried
(the plan is then optimal), or after ``NODES`` fillings and branches looked at
with the best plan so far, the one limit it has; ``lower_bound`` tells how far that plan can be from
the best.

Pieces then get their places without a sort and without meeting in one task.
The token pass writes them in chunks, each with its counts by length; running
sums over chunks give the rank at which a chunk's pieces of a length begin,
these few numbers travel with the chunk, and a rank is looked up in the plan.

Edge cases: a null text is empty; an empty document is its end token alone.
Null, equal and repeated ids are packed as often as they occur.  Equal lengths
are placed in any order.  Columns besides the id and the text are ignored and
may have any names.  An empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange, tokens

CAPACITY = 1024
END_ID = 2
NODES = 20_000
#: pieces of one chunk, and of one task that places chunks (about 30 bytes a piece)
CHUNK, PLACED = 8_192, 200_000

Plan = list[tuple[tuple[int, ...], int]]


def fillings(counts: dict[int, int], room: int, budget: list[int]) -> Iterator[tuple[int, ...]]:
    """All undominated ways to fill ``room`` from the lengths counted, least waste first, large pieces first.

    For each waste in turn the exact sums are enumerated; ``reach[i]`` has bit
    s if lengths from the i-th on can sum to s, so no path ends in vain.
    ``budget`` loses one for each filling looked at, and ends the search at 0.
    """
    left = sorted((x for x, c in counts.items() if c > 0 and x <= room), reverse=True)
    mask = (1 << (room + 1)) - 1
    reach = [1] * (len(left) + 1)
    for i in range(len(left) - 1, -1, -1):
        bits = reach[i + 1]
        for _ in range(min(counts[left[i]], room // left[i])):
            more = bits | (reach[i + 1] | bits) << left[i] & mask
            if more == bits:
                break
            bits = more
        reach[i] = bits

    def exact(i: int, room: int) -> Iterator[tuple[int, ...]]:
        if not room:
            yield ()
            return
        for j in range(i, len(left)):
            if not reach[j] >> room & 1:
                return  # later lengths reach no more than these
            x = left[j]
            for n in range(min(counts[x], room // x), 0, -1):
                if reach[j + 1] >> (room - n * x) & 1:
                    for rest in exact(j + 1, room - n * x):
                        yield (x,) * n + rest

    for waste in range(room + 1):
        if reach[0] >> (room - waste) & 1:
            for filling in exact(0, room - waste):
                if budget[0] <= 0:
                    return
                budget[0] -= 1
                if not dominated(filling, counts, left, waste):
                    yield filling


def dominated(filling: tuple[int, ...], counts: dict[int, int], left: list[int], waste: int) -> bool:
    """Whether a spare length fits into the waste, alone or in the place of a smaller piece or of several pieces.

    Any dominating filling has such a single exchange, so the test is complete.
    """
    one = many = 0
    for y in filling:
        many |= one << y | many << y
        one |= 1 << y
    spare = 0
    for x in left:
        if counts[x] > filling.count(x):
            spare |= 1 << x
    return any(spare & (many << d | ((one | 1) << d if d else 0)) for d in range(waste + 1))


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on a histogram: bins with the same filling move together."""
    groups: dict[int, list[list]] = {}  # room left -> [filling, number]
    for x in sorted(counts, reverse=True):
        c = counts[x]
        while c:
            rooms = [r for r in groups if r >= x and groups[r]]
            if rooms:
                r = min(rooms)
                filling, number = groups[r].pop()
            else:
                r, filling, number = capacity, (), c
            fit = r // x
            use = min(number, -(-c // fit))
            full = min(use, c // fit)
            if number > use and r < capacity:
                groups.setdefault(r, []).append([filling, number - use])
            if full:
                groups.setdefault(r - fit * x, []).append([filling + (x,) * fit, full])
                c -= full * fit
            if use > full and c:
                groups.setdefault(r - c * x, []).append([filling + (x,) * c, 1])
                c = 0
    return [(f, n) for g in groups.values() for f, n in g]


def bins(plan: Plan) -> int:
    return sum(n for _, n in plan)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: by total length, and by pieces that leave no room for those of a size k or more."""
    total = sum(x * c for x, c in counts.items())
    best = -(-total // capacity)
    for k in [x for x in counts if 2 * x <= capacity]:
        alone = sum(c for x, c in counts.items() if x > capacity - k)
        halves = [(x, c) for x, c in counts.items() if capacity - k >= x and 2 * x > capacity]
        small = sum(x * c for x, c in counts.items() if k <= x and 2 * x <= capacity)
        room = sum((capacity - x) * c for x, c in halves)
        best = max(best, alone + sum(c for _, c in halves) + max(0, -(-(small - room) // capacity)))
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Fillings with numbers that place every piece, in as few bins as the search finds."""
    state = {x: c for x, c in counts.items() if c > 0}
    if not state:
        return []
    total = sum(x * c for x, c in state.items())
    incumbent, goal = best_fit(state, capacity), lower_bound(state, capacity)
    fewest, waste, budget = bins(incumbent), 0, [nodes]
    path: Plan = []

    def allowed() -> int:
        """The waste that a better plan may have."""
        return (fewest - 1) * capacity - total

    def ways(last: tuple[int, ...], before: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Fillings around the largest length with their repeats; one that ``last`` already chose to end is not begun again."""
        x = max(state)
        others = dict(state)
        others[x] -= 1
        for rest in fillings(others, capacity - x, budget):
            filling = (x, *rest)
            if before + capacity - sum(filling) > allowed():
                return  # those to come waste no less
            if filling != last:
                for n in range(min(state[y] // filling.count(y) for y in set(filling)), 0, -1):
                    yield filling, n

    def move(filling: tuple[int, ...], n: int) -> int:
        """Take ``n`` fillings out of the state (put them back if negative); the waste that this makes."""
        for y in set(filling):
            state[y] = state.get(y, 0) - n * filling.count(y)
            if not state[y]:
                del state[y]
        return n * (capacity - sum(filling))

    # depth first without recursion: a frame is the ways still to try from one state
    stack = [ways((), 0)]
    while stack and fewest > goal and budget[0] > 0:
        way = next(stack[-1], None)
        if way is None:
            stack.pop()
            if path:
                filling, n = path.pop()
                waste += move(filling, -n)
            continue
        budget[0] -= 1
        waste += move(*way)
        path.append(way)
        if waste > allowed():
            stack.append(iter(()))
        elif not state:
            incumbent, fewest = list(path), bins(path)
            stack.append(iter(()))
        else:
            stack.append(ways(way[0], waste))
    return incumbent


def places(packing: Plan) -> dict[str, np.ndarray]:
    """The plan as intervals of ranks by length: ranks from ``low`` on go ``per`` to a bin, from bin ``bin`` and offset ``at`` on."""
    rows, given, first = [], {}, 0
    for filling, n in packing:
        at = 0
        for x in sorted(set(filling), reverse=True):
            per = filling.count(x)
            rows.append((x, given.get(x, 0), per, first, at))
            given[x] = given.get(x, 0) + per * n
            at += per * x
        first += n
    rows.sort()
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(("length", "low", "per", "bin", "at"))}


_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PACKED = "chunk long, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>, counts array<struct<length:long,n:long>>"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(bpe: tokens.ByteBpe, doc_id: int | None, text: str | None, capacity: int, end_id: int) -> list[tuple]:
    """The pieces of one document: doc_id, piece, start, length, ids_crc32."""
    raw = (bpe.ids(text).tobytes() if text else b"") + np.array([end_id], "<u4").tobytes()
    n = len(raw) // 4
    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
    return [(doc_id, k, a, z - a, zlib.crc32(raw[4 * a : 4 * z])) for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False))]


def packed_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int, size: int) -> DataFrame:
    """Chunks of ``size`` pieces with their counts by length; ``chunk`` is the task and a number in it."""

    def packed(chunk: int, rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)]
        length, n = np.unique(columns[3].to_numpy(), return_counts=True)
        counts = pa.StructArray.from_arrays([pa.array(length), pa.array(n)], ["length", "n"])
        pieces = pa.StructArray.from_arrays(columns, [f.name for f in _PIECE])
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pieces, counts)]
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *lists], ["chunk", "pieces", "counts"])

    def run(batches):
        bpe = tokens.load(tokenizer)
        chunk, held = TaskContext.get().partitionId() << 32, []
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held += cut(bpe, i, t.as_py(), capacity, end_id)
                while len(held) >= size:
                    yield packed(chunk, held[:size])
                    chunk, held = chunk + 1, held[size:]
        if held:
            yield packed(chunk, held)

    return docs.select(exchange.quoted(id_col).cast("long").alias("doc_id"), exchange.quoted(text_col).alias("text")).mapInArrow(run, _PACKED)


def _ranked(t: pa.Table) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
    """The pieces of a task's chunks, their lengths, and the rank of each among all pieces of its length."""
    base = t.filter(t.column("pieces").is_null())
    t = t.filter(t.column("pieces").is_valid()).combine_chunks()
    lists = t.column("pieces").combine_chunks()
    pieces = lists.flatten()
    length = pieces.field("length").to_numpy()
    chunks, code = np.unique(np.concatenate([t.column("chunk").to_numpy(), base.column("chunk").to_numpy()]), return_inverse=True)
    width = int(max(length.max(initial=0), base.column("length").to_numpy().max(initial=0))) + 1
    own = np.repeat(code[: t.num_rows], lists.value_lengths().to_numpy()) * width + length
    known = code[t.num_rows :] * width + base.column("length").to_numpy()
    order = np.argsort(known)
    known, begin = known[order], base.column("base").to_numpy()[order]
    order = np.argsort(own, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(own[order]) != 0)[: len(own)])
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return pieces, length, rank + begin[np.searchsorted(known, own)]


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, nodes: int = NODES, chunk: int = CHUNK) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = exchange.ship(docs.sparkSession)
    chunks = exchange.materialize(packed_pieces(docs, tokenizer or tokens.default_path(), id_col, text_col, capacity, end_id, chunk), "pieces")
    counts = chunks.select("chunk", F.inline("counts"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(histogram, capacity, nodes))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    parts = exchange.block_count(spark, sum(histogram.values()), PLACED, PLACED // 8)
    dealt = chunks.select("chunk", "pieces", F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("base"))
    dealt = dealt.unionByName(base.withColumn("pieces", F.lit(None).cast(chunks.schema["pieces"].dataType))).repartition(parts, "chunk")

    def place(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        pieces, length, rank = _ranked(pa.Table.from_batches(held))
        at = np.searchsorted(table["length"] << 48 | table["low"], length << 48 | rank, side="right") - 1
        off = rank - table["low"][at]
        sequence, offset = table["bin"][at] + off // table["per"][at], table["at"][at] + off % table["per"][at] * length
        names = [f.name for f in _PIECE]
        out = pa.RecordBatch.from_arrays([*map(pieces.field, names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])
        for a in range(0, out.num_rows, 1 << 16):
            yield out.slice(a, 1 << 16)

    return dealt.mapInArrow(place, _PLACED)
