"""The 24-byte record format: little-endian u64 time, u32 src, u32 dst, u16 sport, u16 dport, u16 len, u8 proto, u8 flags.

A trace is a file, or a folder of files that follow each other by name.  It is
read in ranges of records and written by the tasks, a file each; both on paths
that the driver and all executors have mounted.  A path with a scheme of its
own (``hdfs://`` and the like) is read by Spark, record by record.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..schema import TRACE

RECORD = np.dtype([("ts_us", "<u8"), ("src", "<u4"), ("dst", "<u4"), ("sport", "<u2"), ("dport", "<u2"), ("len", "<u2"), ("proto", "u1"), ("flags", "u1")])
WIDE = {"ts_us": pa.int64(), "src": pa.int64(), "dst": pa.int64(), **dict.fromkeys(("sport", "dport", "len", "proto", "flags"), pa.int32())}


def parts_of(path: str) -> list[str]:
    """The files of a trace in order."""
    path = path.removeprefix("file://")
    return sorted(glob.glob(os.path.join(path, "*.bin"))) if os.path.isdir(path) else [path]


def rows_of(raw: np.ndarray, first: int) -> pa.RecordBatch:
    columns = [pa.array(np.arange(len(raw)) + first)] + [pa.array(raw[c].astype(np.int64)).cast(t) for c, t in WIDE.items()]
    return pa.RecordBatch.from_arrays(columns, TRACE.names)


class Range(InputPartition):
    def __init__(self, path: str, first: int, count: int, number: int):
        self.path, self.first, self.count, self.number = path, first, count, number


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.strict = options["path"], str(options.get("strict", "true")).lower() == "true"
        self.records = int(options.get("recordsPerPartition", 4_000_000))

    def partitions(self):
        out, before = [], 0
        for path in parts_of(self.path):
            size = os.path.getsize(path)
            if size % RECORD.itemsize and self.strict:
                raise ValueError(f"{path}: {size} bytes are no whole number of {RECORD.itemsize}-byte records")
            n = size // RECORD.itemsize
            out += [Range(path, a, min(self.records, n - a), before + a) for a in range(0, n, self.records)]
            before += n
        return out or [Range("", 0, 0, 0)]

    def read(self, part):
        if not part.count:
            return
        with open(part.path, "rb") as f:
            f.seek(part.first * RECORD.itemsize)
            for a in range(0, part.count, 1 << 16):
                yield rows_of(np.frombuffer(f.read(min(1 << 16, part.count - a) * RECORD.itemsize), RECORD), part.number + a)


class Done(WriterCommitMessage):
    def __init__(self, part: int, name: str):
        self.part, self.name = part, name


class Writer(DataSourceArrowWriter):
    """Each task writes a hidden file; the driver's commit gives it its place, and an abort removes it."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.removeprefix("file://"), overwrite, uuid.uuid4().hex

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        task = TaskContext.get()
        name = f".{self.run}-{task.partitionId()}-{task.taskAttemptId()}"
        with open(os.path.join(self.path, name), "wb") as f:
            for b in iterator:
                raw = np.empty(b.num_rows, RECORD)
                for c in RECORD.names:
                    raw[c] = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                f.write(raw.tobytes())
        return Done(task.partitionId(), name)

    def commit(self, messages):
        os.makedirs(self.path, exist_ok=True)
        old = parts_of(self.path)
        if old and not self.overwrite:
            self._remove_hidden()
            raise FileExistsError(f"{self.path} holds a trace; overwrite it or choose another path")
        for f in old:
            os.remove(f)
        for m in messages:
            if m is not None:
                os.replace(os.path.join(self.path, m.name), os.path.join(self.path, f"part-{m.part:06d}.bin"))
        self._remove_hidden()

    def abort(self, messages):
        self._remove_hidden()

    def _remove_hidden(self):
        for f in glob.glob(os.path.join(self.path, f".{self.run}-*")):
            os.remove(f)


class Trace24(DataSource):
    """``spark.read.format("trace24").load(path)`` with option ``strict``; ``df.write.format("trace24").save(path)``."""

    @classmethod
    def name(cls):
        return "trace24"

    def schema(self):
        return TRACE

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], overwrite)


def _registered(spark: SparkSession) -> SparkSession:
    from ..session import ship

    ship(spark).dataSource.register(Trace24)
    return spark


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    if "://" in path and not path.startswith("file://"):
        return _read_by_spark(spark, path, strict)
    return _registered(spark).read.format("trace24").option("strict", str(strict).lower()).load(path)


def _read_by_spark(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    """Records from any file system that Spark knows, numbered by counts of the partitions before.

    A file that ends inside a record fails, also if not ``strict``: Spark cuts files at whole records.
    """
    from ..session import ship

    sc = ship(spark).sparkContext
    jvm = sc._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(sc._jsc.hadoopConfiguration())
    for status in files.globStatus(where) or []:
        if status.isFile() and status.getLen() % RECORD.itemsize:
            raise ValueError(f"{path}: {status.getLen()} bytes are no whole number of {RECORD.itemsize}-byte records")
    records = sc._jsc.sc().binaryRecords(path, RECORD.itemsize, sc._jsc.hadoopConfiguration())
    made = spark._jsparkSession.createDataset(records, jvm.org.apache.spark.sql.Encoders.BINARY())
    raw = DataFrame(made.toDF(), spark).withColumn("id", F.monotonically_increasing_id())

    def run(batches):
        for b in batches:
            if b.num_rows:
                data = np.frombuffer(b"".join(b.column(0).to_pylist()), RECORD)
                out = rows_of(data, 0)
                yield pa.RecordBatch.from_arrays([b.column(1), *out.columns[1:]], TRACE.names)

    got = raw.mapInArrow(run, TRACE)
    sizes = raw.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count("*").alias("n")).collect()  # one row a partition
    before, total = {}, 0
    for r in sorted(sizes):
        before[r["part"]], total = total, total + r["n"]
    if not before:
        return got
    base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    part = F.shiftright("rec_no", 33)
    return got.withColumn("rec_no", base[part] + F.col("rec_no") - F.shiftleft(part, 33))


def write(df: DataFrame, path: str, overwrite: bool = False) -> int:
    """Write a folder of files in record order, one a task; the number of records."""
    spark = _registered(df.sparkSession)
    ordered = df.select(*TRACE.names).orderBy("rec_no")
    ordered.write.format("trace24").mode("overwrite" if overwrite else "append").save(path)
    return sum(os.path.getsize(f) for f in parts_of(path)) // RECORD.itemsize


def join_parts(path: str, target: str) -> None:
    """One file of a folder's files, byte after byte."""
    with open(target, "wb") as out:
        for f in parts_of(path):
            with open(f, "rb") as part:
                shutil.copyfileobj(part, out, 1 << 20)
