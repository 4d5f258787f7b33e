"""Moving keys between executors: sizes, shared tables, and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import ship  # noqa: F401
from ..shared import discard, materialize, scratch, shared_dir  # noqa: F401

#: bytes of a batch that are worked on at a time
SLICE = 8 << 20


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(quoted(text_col)))).first()[0] or 0


def block_count(spark: SparkSession, total: int, each: int = 8 << 20, least: int = 1 << 20) -> int:
    """How many parts ``total`` bytes are dealt to: about ``each`` bytes a part, or fewer so that every core has some, but not under ``least``.

    Parts exchange packets with each other, so parts of little text would make packets of few keys.
    """
    return max(1, -(-total // each), min(2 * shuffle_width(spark), -(-total // least)))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def lookup(rows: DataFrame, table: DataFrame, on: dict[str, Column], table_on: dict[str, Column], how: str = "left") -> DataFrame:
    """Join where a key may hold a third of ``rows``.

    ``on`` and ``table_on`` give equal new names to the key expressions of
    both sides.  As the names are computed after any aggregation that made
    ``table``, both sides get an exchange of their own, so adaptive execution
    can split the hot partitions of ``rows`` and repeat only the few rows of
    ``table`` that they need.  ``table`` must have one row a key.
    """
    left = rows.withColumns(on)
    right = table.withColumns(table_on).select(*table_on, *[c for c in table.columns if c not in rows.columns])
    return left.join(right.hint("merge"), list(on), how).drop(*on)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def slices(b: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of some ``most`` bytes."""
    step = max(1, b.num_rows * most // max(1, b.nbytes))
    for a in range(0, b.num_rows, step):
        yield b.slice(a, step)


def annotate(df: DataFrame, keep: list[str], inputs: dict[str, str | Column], fn: Callable, out: dict[str, str]) -> DataFrame:
    """``keep`` columns of each row and what ``fn`` makes of its ``inputs``, in one narrow pass.

    An input is an expression or the name of a column; one that is kept as
    well travels once.  ``fn`` gets a dict of Arrow arrays, of a slice of the
    batch, and returns one array for each entry of ``out`` (name to SQL type);
    so beside the batch sent, worker and executor hold answers of a slice only.
    Kept columns travel under positional names, so theirs cannot clash with the
    new ones; at the end a new column replaces a kept one of its name.
    """
    names = list(out)
    place = {a: keep.index(e) for a, e in inputs.items() if isinstance(e, str) and e in keep}
    sent = {a: quoted(e) if isinstance(e, str) else e for a, e in inputs.items() if a not in place}
    df = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], *[e.alias(f"i{i}") for i, e in enumerate(sent.values())])
    schema = StructType([StructField(f"k{i}", df.schema[f"k{i}"].dataType) for i in range(len(keep))] + StructType.fromDDL(", ".join(f"o{i} {t}" for i, t in enumerate(out.values()))).fields)
    n = len(keep)
    place |= {a: n + i for i, a in enumerate(sent)}

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            made = fn({a: b.column(i) for a, i in place.items()})
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *[made[x] for x in names]], [*[f"k{i}" for i in range(n)], *[f"o{i}" for i in range(len(names))]])

    got = df.mapInArrow(run, schema)
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep) if c not in out], *[F.col(f"o{i}").alias(c) for i, c in enumerate(names)])


def kept_rows(df: DataFrame, inputs: dict[str, str | Column], keeps: Callable) -> DataFrame:
    """The rows of ``df``, with all their columns, for which ``keeps`` (of Arrow arrays) says true."""
    flag = "keeps"
    while flag in df.columns:
        flag += "_"
    got = annotate(df, df.columns, inputs, lambda b: {flag: keeps(b)}, {flag: "boolean"})
    return got.where(F.col(flag)).drop(flag)
