"""Files: the 24-byte format, captures of every link type, CSV and JSON."""

import gzip
import io
import struct
from collections import Counter

import pytest

from tallyflow.operators.windows import Windows
from tallyflow.plans import catalog
from tallyflow.schema import TRACE
from tallyflow.sources import pcap, tables, trace24

ROWS = [(i, 10**15 + i, 0xC6120007, 0xFFFFFFFF, 65535, 80, 65535, 17, 255 * (i % 2)) for i in range(5000)]


def test_trace24_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.bin")
    df = spark.createDataFrame(ROWS[::-1], TRACE).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trace24.write(df, path) == 5000 and len(trace24.parts_of(path)) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, trace24.read(spark, path).collect())) == ROWS
    with pytest.raises(Exception, match="overwrite"):
        trace24.write(df, path)
    assert sorted(p.name for p in (tmp_path / "a.bin").iterdir()) == [f"part-{k:06d}.bin" for k in range(len(trace24.parts_of(path)))]
    assert trace24.write(df.limit(10), path, overwrite=True) == 10


def test_trace24_single_file(spark, tmp_path):
    folder, path = str(tmp_path / "a.bin"), str(tmp_path / "one.bin")
    trace24.write(spark.createDataFrame(ROWS, TRACE), folder)
    trace24.join_parts(folder, path)
    raw = open(path, "rb").read()
    assert len(raw) == 24 * 5000 and raw[:24] == struct.pack("<QIIHHHBB", 10**15, 0xC6120007, 0xFFFFFFFF, 65535, 80, 65535, 17, 0)
    assert sorted(map(tuple, trace24.read(spark, path).collect())) == ROWS
    assert sorted(map(tuple, trace24._read_by_spark(spark, f"file://{path}", True).collect())) == ROWS
    with open(path, "ab") as f:
        f.write(b"xyz")
    with pytest.raises(Exception, match="whole number"):
        trace24.read(spark, path).count()
    with pytest.raises(ValueError, match="whole number"):
        trace24._read_by_spark(spark, f"file://{path}", True)
    assert trace24.read(spark, path, strict=False).count() == 5000
    open(path, "wb").close()
    assert trace24.read(spark, path).count() == 0


def ip(proto=6, l4=None, frag=0, ihl=5):
    l4 = struct.pack(">HHIIBBHHH", 1234, 80, 0, 0, 0x50, 0x12, 0, 0, 0) if l4 is None else l4
    return struct.pack(">BBHHHBBHII", 0x40 | ihl, 0, 0, 0, frag, 64, proto, 0, 0xC6120007, 0x0A000001) + b"\0" * 4 * max(0, ihl - 5) + l4


def ip6(proto=6, cut=None):
    return (struct.pack(">IHBB", 0x60000000, 20, proto, 64) + bytes(range(32)) + struct.pack(">HHIIBBHHH", 5, 6, 0, 0, 0x50, 0x02, 0, 0, 0))[:cut]


def ether(packet, kind=0x0800, vlan=0, tag=0x8100):
    return b"\0" * 12 + b"".join(struct.pack(">HH", tag, 1) for _ in range(vlan)) + struct.pack(">H", kind) + packet


def capture(frames, magic=b"\xd4\xc3\xb2\xa1", link=1, times=None, wire=70000, tail=b""):
    order, per = pcap.MAGICS[magic]
    head = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, link)
    return head + b"".join(struct.pack(order + "IIII", times[i] if times else 100 + i, 7 * per, len(f), wire) + f for i, f in enumerate(frames)) + tail


def decoded(raw, **options):
    seen = Counter()
    rows = [tuple(r.values()) for b in pcap.decode(io.BytesIO(raw), seen, **options) for r in b.to_pylist()]
    return rows, seen


@pytest.mark.parametrize("magic", sorted(pcap.MAGICS))
def test_pcap(spark, tmp_path, magic):
    frames = [ether(ip()), ether(ip(), vlan=2), ether(ip(17, struct.pack(">HHHH", 53, 99, 8, 0))), ether(ip(frag=5)), ether(ip(ihl=4)), ether(ip(l4=b"\x04\xd2\x00\x50"))]
    frames += [ether(ip6(), 0x86DD), ether(ip(), 0x0806), ether(ip(1))]
    path = str(tmp_path / "a.pcap.gz")
    with gzip.open(path, "wb") as f:
        f.write(capture(frames, magic, tail=b"\1\2\3"))
    got = [tuple(r) for r in pcap.read(spark, path).orderBy("rec_no").collect()]
    assert got[0] == (0, 100_000_007, 0xC6120007, 0x0A000001, 1234, 80, 65535, 6, 3) and len(got) == 6
    assert got[2][4:6] == (53, 99) and got[3][4:6] == (0, 0) and got[4][8] == 0 and got[4][4] == 1234
    assert pcap.read(spark, path, ipv6="hash").count() == 7
    assert pcap.read(spark, path, limit=2).count() == 2
    s = pcap.status(spark, path).first()
    assert (s["frames"], s["vlan"], s["truncated"], s["ipv6"], s["ipv4"], s["non_ip"], s["fragments"], s["records"]) == (9, 2, 1, 1, 6, 1, 1, 6)
    assert (s["bytes"], s["first_us"], s["last_us"], s["seconds"], s["pkts_per_s"], s["damaged"]) == (6 * 65535, 100_000_007, 108_000_007, 8.0, 0.75, 0)


def test_pcap_link_types():
    v4, v6 = ip(), ip6()
    null = lambda family, p: struct.pack("<I", family) + p
    sll = lambda kind, p: b"\0" * 14 + struct.pack(">H", kind) + p
    for link, frames, records, folded, non_ip in (
        (101, [v4, v6, b"", b"\x20abc"], 1, 2, 2),
        (12, [v4], 1, 1, 0),
        (0, [null(2, v4), null(24, v6), null(28, v6), null(30, v6), null(7, v4), b"\2"], 1, 4, 2),
        (113, [sll(0x0800, v4), sll(0x86DD, v6), sll(0x8100, b"\0\1\x08\0" + v4), b"\0" * 9], 1, 2, 2),
        (1, [ether(v4, vlan=4, tag=0x88A8), ether(v4, vlan=5), ether(v4)[:13], ether(b"", 0x8100)], 1, 1, 3),
        (99, [v4], 0, 0, 1),
    ):
        rows, seen = decoded(capture(frames, link=link))
        assert (len(rows), seen["non_ip"]) == (records, non_ip), link
        assert all(r[2:] == (0xC6120007, 0x0A000001, 1234, 80, 65535, 6, 3) for r in rows)
        rows, seen = decoded(capture(frames, link=link), ipv6="hash")
        assert len(rows) == folded
        for r in rows:
            if r[8] & 32:
                assert r[2:] == (pcap.fold_ipv6(bytes(range(16))), pcap.fold_ipv6(bytes(range(16, 32))), 5, 6, 65535, 6, 33)
    assert len(decoded(capture([v4], link=1), dlt=101)[0]) == 1


def test_pcap_short_headers():
    rows, seen = decoded(capture([ether(ip()[:19]), ether(b""), ether(ip(ihl=6)[:22]), ether(ip6(cut=39), 0x86DD), ether(ip(l4=b"abc")), ether(ip(l4=b"abcdefghijklm"))]), ipv6="hash")
    assert seen["truncated"] == 4 and [r[4:6] for r in rows] == [(0, 0), (0x6162, 0x6364)] and seen["ipv6"] == 1
    assert decoded(capture([ether(ip6(cut=39), 0x86DD)]))[1]["truncated"] == 0


def test_pcap_damage_and_order(monkeypatch):
    frames = [ether(ip())] * 5
    bad = capture(frames, times=[5, 9, 3, 4, 4], tail=struct.pack("<IIII", 1, 1, (1 << 24) + 1, 1) + b"x" * 99)
    for piece in (pcap.PIECE, 61):
        monkeypatch.setattr(pcap, "PIECE", piece)
        rows, seen = decoded(bad)
        assert [r[0] for r in rows] == [0, 1, 2, 3, 4] and seen["damaged"] == 1 and seen["out_of_order"] == 1 and seen["frames"] == 5
        rows, seen = decoded(capture(frames)[:-1])
        assert len(rows) == 4 and seen["damaged"] == 0
        assert len(decoded(capture(frames), limit=3)[0]) == 3
    for raw in (pcap.PCAPNG + bytes(30), b"abcd" + bytes(30), b"", capture([])[:20]):
        with pytest.raises(ValueError):
            decoded(raw)
    assert decoded(capture([]))[0] == []


def test_pcap_folder(spark, tmp_path):
    for name, n in (("b.pcap", 2), ("a.pcap", 3)):
        (tmp_path / name).write_bytes(capture([ether(ip())] * n))
    for path in (str(tmp_path), f"{tmp_path}/*.pcap"):
        got = sorted(r["rec_no"] for r in pcap.read(spark, path).collect())
        assert got == [0, 1, 2, 1 << 40, (1 << 40) + 1]
    assert pcap.status(spark, str(tmp_path)).first()["records"] == 5


def test_csv_and_json(spark, sf_dir, tmp_path):
    g = Windows(catalog.from_events(spark, sf_dir), "dst", W=86400.0, delta=14400.0)
    made = {"windows": g.windows(), "topk": g.topk(3), "query": g.query([catalog.IPS[0]])}
    for name, df in made.items():
        path = str(tmp_path / name)
        tables.write_csv(df, path)
        back = spark.read.option("header", True).schema(df.schema).csv(path)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect())) if name != "query" else True
    query = tables.read_query_csv(spark, str(tmp_path / "query"))
    assert sorted(map(str, query.collect())) == sorted(map(str, made["query"].collect())) and query.where("exact_delta is null").count() == 1
    with pytest.raises(Exception):
        tables.read_query_csv(spark, str(tmp_path / "topk")).collect()
    tables.write_json(spark.createDataFrame([(1, None)], "a long, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":1,"b":null}'
