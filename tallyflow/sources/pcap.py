"""Classic PCAP files to traces and back.

A capture has no marks to split at, so a file is one partition; it is read as
a stream (``.gz`` too) in pieces of ``PIECE`` bytes, and the headers of a
piece's frames are taken apart together.  Files on a mounted path are opened
by the tasks; a path with a scheme of its own is read by Spark, whose limit is
2 GB a file.

Records of one file are numbered in file order; those of the file of index f,
in the order of names, begin at f * 2**40.  A frame cut off at the end ends the file; so does a
frame length above ``LARGEST``, which marks the file as damaged.  What was read
before is kept in both cases.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import ACK, FIN, IPV6, RST, SYN, TCP, TRACE, UDP

#: link types, formats and families (fixed values of the published formats)
ETHERNET, RAW_A, RAW_B, NULL, SLL = 1, 101, 12, 0, 113
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
PCAPNG = b"\x0a\x0d\x0d\x0a"
VLAN = (0x8100, 0x88A8, 0x9100)
IPV4_TYPE, IPV6_TYPE = 0x0800, 0x86DD
NULL_FAMILIES = {2: IPV4_TYPE, 24: IPV6_TYPE, 28: IPV6_TYPE, 30: IPV6_TYPE}
LARGEST = 1 << 24
PIECE = 4 << 20
FILE_SHIFT = 40
COUNTS = ("frames", "records", "ipv4", "ipv6", "non_ip", "truncated", "vlan", "fragments", "tcp", "udp", "icmp", "other", "out_of_order", "bytes", "damaged")
STATUS = ", ".join(f"{c} long" for c in (*COUNTS, "first_us", "last_us"))
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 5)


def fold_ipv6(address: bytes) -> int:
    """FNV-1a, 32 bits."""
    h = 0x811C9DC5
    for b in address:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


class Frames:
    """Frames of one piece: their bytes with some spare ones behind, where each begins and how long it is."""

    def __init__(self, data: bytes, start: list[int], held: list[int]):
        self.data = np.frombuffer(data + bytes(64), np.uint8)
        self.start, self.held = np.array(start, np.int64), np.array(held, np.int64)

    def number(self, at: np.ndarray, size: int, which: np.ndarray) -> np.ndarray:
        """Big-endian numbers at offsets of frames; offsets past the end of the piece give junk that no one uses."""
        place = np.minimum(self.start[which] + at, len(self.data) - size)
        out = np.zeros(len(place), np.int64)
        for k in range(size):
            out = out << 8 | self.data[place + k]
        return out

    def network(self, link: int, seen: Counter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Frames that hold IP: their indices, where it begins, and its ethertype."""
        every = np.arange(len(self.start))
        if link in (RAW_A, RAW_B):
            every = every[self.held >= 1]
            version = self.number(np.zeros(len(every), np.int64), 1, every) >> 4
            kind = np.where(version == 4, IPV4_TYPE, np.where(version == 6, IPV6_TYPE, 0))
            at = np.zeros(len(every), np.int64)
        elif link == NULL:
            every = every[self.held >= 4]
            family = self.number(np.zeros(len(every), np.int64), 4, every)
            family = family >> 24 | family >> 8 & 0xFF00 | (family & 0xFF00) << 8 | (family & 0xFF) << 24
            kind = np.zeros(len(every), np.int64)
            for f, k in NULL_FAMILIES.items():
                kind[family == f] = k
            at = np.full(len(every), 4)
        elif link in (ETHERNET, SLL):
            size = 14 if link == ETHERNET else 16
            every = every[self.held >= size]
            at = np.full(len(every), size)
            kind = self.number(at - 2, 2, every)
            for _ in range(4 if link == ETHERNET else 0):
                tagged = np.isin(kind, VLAN)
                whole = tagged & (self.held[every] >= at + 4)
                kind[tagged & ~whole] = 0
                kind[whole] = self.number(at[whole] + 2, 2, every[whole])
                at[whole] += 4
                seen["vlan"] += int(whole.sum())
        else:
            return every[:0], every[:0], every[:0]
        ip = (kind == IPV4_TYPE) | (kind == IPV6_TYPE)
        return every[ip], at[ip], kind[ip]

    def records(self, link: int, ipv6: str, seen: Counter) -> tuple[np.ndarray, ...]:
        """Index, src, dst, sport, dport, proto and flags of the frames that become records, in order."""
        f, at, kind = self.network(link, seen)
        seen["non_ip"] += len(self.start) - len(f)
        room = self.held[f] - at
        four = kind == IPV4_TYPE
        header = np.where(four, (self.number(at, 1, f) & 15) * 4, 40)
        seen["ipv6"] += int((~four).sum())
        whole = np.where(four, (room >= 20) & (header >= 20) & (room >= header), room >= 40)
        wanted = four | (ipv6 == "hash")
        seen["truncated"] += int((wanted & ~whole).sum())
        ok = wanted & whole
        f, at, room, four, header = f[ok], at[ok], room[ok], four[ok], header[ok]
        seen["ipv4"] += int(four.sum())
        proto = self.number(at + np.where(four, 9, 6), 1, f)
        src, dst = self.number(at + 12, 4, f), self.number(at + 16, 4, f)
        flags = np.where(four, 0, IPV6)
        for side, offset in ((src, 8), (dst, 24)):
            h = np.full(int((~four).sum()), 0x811C9DC5, np.int64)
            for k in range(16):
                h = (h ^ self.number(at[~four] + offset + k, 1, f[~four])) * 0x01000193 & 0xFFFFFFFF
            side[~four] = h
        later = four & (self.number(at + 6, 2, f) & 0x1FFF != 0)
        seen["fragments"] += int(later.sum())
        for name, p in (("tcp", TCP), ("udp", UDP), ("icmp", 1)):
            seen[name] += int((~later & (proto == p)).sum())
        seen["other"] += int((~later & ~np.isin(proto, (TCP, UDP, 1))).sum())
        ports = ~later & np.isin(proto, (TCP, UDP)) & (room >= header + 4)
        sport = np.where(ports, self.number(at + header, 2, f), 0)
        dport = np.where(ports, self.number(at + header + 2, 2, f), 0)
        bits = np.where(ports & (proto == TCP) & (room >= header + 14), self.number(at + header + 13, 1, f), 0)
        for mark, bit in ((SYN, 1), (ACK, 4), (FIN, 0), (RST, 2)):
            flags = flags | mark * (bits >> bit & 1)
        return f, src, dst, sport, dport, proto, flags


def decode(stream: io.RawIOBase, seen: Counter, dlt: int | None = None, ipv6: str = "skip", limit: int | None = None, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches of trace rows, numbered from ``first``; ``seen`` counts what became of the frames."""
    head = stream.read(24)
    if head[:4] == PCAPNG:
        raise ValueError("this is pcapng; convert it to classic pcap first")
    if head[:4] not in MAGICS or len(head) < 24:
        raise ValueError("no pcap file: unknown magic number")
    order, per_us = MAGICS[head[:4]]
    link = struct.unpack_from(order + "I", head, 20)[0] if dlt is None else dlt
    header = struct.Struct(order + "IIII")
    rest, more, before = b"", True, 0
    while more:
        got = stream.read(PIECE)
        more, data, at = bool(got), rest + got, 0
        start, held, times, wire = [], [], [], []
        while len(data) - at >= 16 and (limit is None or seen["frames"] + len(start) < limit):
            sec, frac, size, full = header.unpack_from(data, at)
            if size > LARGEST:
                seen["damaged"], more = 1, False
                break
            if at + 16 + size > len(data):
                break
            start.append(at + 16)
            held.append(size)
            times.append(sec * 1_000_000 + frac // per_us)
            wire.append(min(full, 65535))
            at += 16 + size
        rest = data[at:]
        more = more and (limit is None or seen["frames"] + len(start) < limit)
        if not start:
            continue
        ts, length = np.array(times, np.int64), np.array(wire, np.int64)
        seen.setdefault("first_us", times[0])
        seen["last_us"] = times[-1]
        seen["out_of_order"] += int((np.diff(ts, prepend=before) < 0).sum())
        before = times[-1]
        seen["frames"] += len(start)
        f, src, dst, sport, dport, proto, flags = Frames(data, start, held).records(link, ipv6, seen)
        number = first + seen["records"] + np.arange(len(f))
        seen["records"] += len(f)
        seen["bytes"] += int(length[f].sum())
        columns = (number, ts[f], src, dst, sport, dport, length[f], proto, flags)
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, KINDS, strict=True)], TRACE.names)


def _counted(stream: io.RawIOBase, options: dict) -> pa.RecordBatch:
    seen: Counter = Counter()
    for _ in decode(stream, seen, **options):
        pass
    return pa.RecordBatch.from_arrays([pa.array([seen[c] if c in seen or c in COUNTS else None], pa.int64()) for c in (*COUNTS, "first_us", "last_us")], [*COUNTS, "first_us", "last_us"])


def _opened(name: str, raw: io.RawIOBase) -> io.RawIOBase:
    return gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw


class File(InputPartition):
    def __init__(self, path: str, index: int):
        self.path, self.index = path, index


class Reader(DataSourceReader):
    def __init__(self, options, what: str):
        self.path, self.what = options["path"], what
        number = lambda k: int(options[k]) if options.get(k) else None
        self.options = {"dlt": number("dlt"), "ipv6": options.get("ipv6", "skip"), "limit": number("limit")}

    def partitions(self):
        path = self.path.removeprefix("file://")
        files = sorted(glob.glob(os.path.join(path, "*.pcap*"))) if os.path.isdir(path) else sorted(glob.glob(path)) or [path]
        return [File(f, i) for i, f in enumerate(files)]

    def read(self, part):
        with open(part.path, "rb") as f:
            if self.what == "status":
                yield _counted(_opened(part.path, f), self.options)
            else:
                yield from decode(_opened(part.path, f), Counter(), first=part.index << FILE_SHIFT, **self.options)


class Pcap(DataSource):
    """``spark.read.format("pcap").load(path)``: a file, a folder or a pattern that all executors have mounted; options dlt, ipv6, limit."""

    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return STATUS if self.options.get("what") == "status" else TRACE

    def reader(self, schema):
        return Reader(self.options, self.options.get("what", "trace"))


def _load(spark: SparkSession, path: str, what: str, options: dict) -> DataFrame:
    from ..session import ship

    ship(spark)
    if "://" not in path or path.startswith("file://"):
        spark.dataSource.register(Pcap)
        return spark.read.format("pcap").options(what=what, **{k: str(v) for k, v in options.items() if v is not None}).load(path)
    files = spark.read.format("binaryFile").load(path)
    index = {r["path"]: i for i, r in enumerate(files.select("path").orderBy("path").collect())}  # one entry a file

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                stream = _opened(name, pa.BufferReader(content.as_buffer()))
                if what == "status":
                    yield _counted(stream, options)
                else:
                    yield from decode(stream, Counter(), first=index[name] << FILE_SHIFT, **options)

    return files.select("path", "content").mapInArrow(run, STATUS if what == "status" else TRACE)


def read(spark: SparkSession, path: str, dlt: int | None = None, ipv6: str = "skip", limit: int | None = None) -> DataFrame:
    """The trace of the capture files at ``path``; ``limit`` frames a file."""
    return _load(spark, path, "trace", {"dlt": dlt, "ipv6": ipv6, "limit": limit})


def status(spark: SparkSession, path: str, dlt: int | None = None, ipv6: str = "skip", limit: int | None = None) -> DataFrame:
    """One row: what became of the frames, frames earlier than the one before, bytes of the records, times and rates, damaged files."""
    each = _load(spark, path, "status", {"dlt": dlt, "ipv6": ipv6, "limit": limit})
    total = each.agg(*[F.sum(c).alias(c) for c in COUNTS], F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    seconds = F.greatest(F.col("last_us") - F.col("first_us"), F.lit(0)) / 1e6
    rate = lambda c, digits: F.round(F.when(seconds > 0, c / seconds).otherwise(0.0), digits)
    return total.select("*", F.round(seconds, 6).alias("seconds"), rate(F.col("records"), 6).alias("pkts_per_s"), rate(F.col("bytes") * 8 / 1e9, 12).alias("gbps"))


def encode(b: pa.RecordBatch) -> bytes:
    """Little-endian microsecond packets of IPv4 trace rows: Ethernet, 20 bytes of IPv4, 20 of TCP or 8 of any other protocol."""
    out = []
    for _, ts, src, dst, sport, dport, length, proto, flags in zip(*(c.to_pylist() for c in b.columns), strict=True):
        bits = 2 * bool(flags & SYN) | 16 * bool(flags & ACK) | bool(flags & FIN) | 4 * bool(flags & RST)
        l4 = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, bits, 0, 0, 0) if proto == TCP else struct.pack(">HHHH", sport, dport, 8, 0)
        frame = bytes(12) + struct.pack(">HBBHHHBBHII", IPV4_TYPE, 0x45, 0, 20 + len(l4), 0, 0, 64, proto, 0, src, dst) + l4
        out.append(struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, len(frame), length) + frame)
    return b"".join(out)


def write(df: DataFrame, path: str) -> None:
    """A capture of IPv4 trace rows in record order, encoded by the tasks and streamed through the driver to one local file."""
    from ..session import ship

    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(b)], pa.binary())], ["packets"])

    with open(path, "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, ETHERNET))
        for r in df.select(*TRACE.names).orderBy("rec_no").mapInArrow(run, "packets binary").toLocalIterator(prefetchPartitions=True):
            f.write(r["packets"])
