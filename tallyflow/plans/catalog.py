"""Registered queries of the trace engine and their DuckDB equivalents."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import keys, murmur
from ..operators import evaluate, experiment, inject, sketch, stats
from ..operators.sketch import Sketch
from ..operators.windows import Windows
from ..sources import pcap, tables, trace24
from ..sources.tables import from_events, from_lineitem

HOUR = 3600.0
DAY = 24 * HOUR
W, D, PHI = DAY, 4 * HOUR, 0.01
IPS = (3232235530, 3232235540, 167772163)  # 192.168.0.10, 192.168.0.20, 10.0.0.3
SENDER = 167772163
CMS, CS = Sketch("cms", 5, 256, 42), Sketch("cs", 5, 256, 42)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TRACE_SQL = """trace AS (SELECT event_id AS rec_no, epoch_us(ts) AS ts_us, 167772160 + user_id AS src, 3232235520 + floor(value)::BIGINT AS dst,
 CASE WHEN event_type = 'error' THEN 0 ELSE (1024 + event_id % 60000)::INT END AS sport,
 CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 80 WHEN 'click' THEN 443 WHEN 'purchase' THEN 8443 WHEN 'signup' THEN 22 ELSE 53 END AS dport,
 (40 + floor(value)::BIGINT)::INT AS len, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 17 ELSE 6 END AS proto,
 CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 2 ELSE 0 END AS flags FROM events)"""
LINE_SQL = """trace AS (SELECT (l_shipdate::DATE - DATE '1970-01-01') * 10000000000 + l_orderkey * 8 + l_linenumber AS rec_no, epoch_us(l_shipdate) AS ts_us, l_suppkey AS src, l_partkey AS dst, l_quantity::INT AS len, 0 AS flags, 6 AS proto, 0 AS sport, 0 AS dport FROM lineitem)"""
KEY_SQL = {"src": "src", "dst": "dst", "src24": "src & 4294967040", "src16": "src & 4294901760"}


def ip_sql(c: str, kind: str = "src") -> str:
    return f"((({c}) >> 24) & 255)::VARCHAR || '.' || ((({c}) >> 16) & 255)::VARCHAR || '.' || ((({c}) >> 8) & 255)::VARCHAR || '.' || (({c}) & 255)::VARCHAR" + (f" || '/{kind[3:]}'" if kind in keys.MASKS else "")


def windows_sql(key: str = "src", weight: str = "1", w: float = W, d: float = D, phi: float = PHI, trace: str = TRACE_SQL, cap: int | None = None) -> str:
    """CTEs of the window grid: b, spine, freq, tot."""
    w, d = int(w * 1e6), int(d * 1e6)
    top = f"least((tend - t0 - {w}) // {d}, {cap - 1})" if cap else f"(tend - t0 - {w}) // {d}"
    return f"""WITH {trace}, b AS (SELECT arg_min(ts_us, rec_no) AS t0, arg_max(ts_us, rec_no) AS tend FROM trace),
spine AS (SELECT j AS win, t0 + {w} + j * {d} AS tau_us FROM b, LATERAL unnest(range(0, CASE WHEN tend - t0 >= {w} THEN {top} + 1 ELSE 0 END)) AS u(j)),
freq AS (SELECT win, {KEY_SQL.get(key, key)} AS key, sum({weight})::BIGINT AS f FROM spine, b, trace WHERE ts_us > t0 AND ts_us > tau_us - {w} AND ts_us <= tau_us GROUP BY ALL HAVING sum({weight}) > 0),
tot AS (SELECT s.win, s.tau_us, coalesce(n, 0)::BIGINT AS N, greatest(1, ceil({phi!r}::DOUBLE * coalesce(n, 0)))::BIGINT AS threshold FROM spine s LEFT JOIN (SELECT win, sum(f)::BIGINT AS n FROM freq GROUP BY win) x ON s.win = x.win)
"""


def final_windows(grid: str) -> str:
    return grid + "SELECT t.win, t.tau_us, t.N, count(f.key)::BIGINT AS \"distinct\", t.threshold, count(*) FILTER (f.f >= t.threshold)::BIGINT AS n_hh FROM tot t LEFT JOIN freq f ON t.win = f.win GROUP BY t.win, t.tau_us, t.N, t.threshold"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def add_windows(name: str, source=from_events, trace: str = TRACE_SQL, **o) -> None:
    sql_o = {"key": o.get("key", "src"), "weight": "len" if o.get("weight") == "bytes" else "1", "w": o.get("W", W), "d": o.get("delta", D), "phi": o.get("phi", PHI), "trace": trace, "cap": o.get("max_windows")}
    QUERIES[name] = lambda s, d: Windows(source(s, d), **({"W": W, "delta": D, "phi": PHI} | o)).windows()
    ORACLES[name] = final_windows(windows_sql(**sql_o))


# scans, projections, filters
PROJECT = "rec_no, ts_us, src, dst, sport, dport, len, proto, flags"
query("trace_project", f"WITH {TRACE_SQL} SELECT {PROJECT} FROM trace")(lambda s, d: from_events(s, d))
query("render_ipv4", f"WITH {TRACE_SQL} SELECT rec_no, {ip_sql('src')} AS src_ip, {ip_sql('dst')} AS dst_ip FROM trace")(lambda s, d: from_events(s, d).select("rec_no", keys.ipv4(F.col("src")).alias("src_ip"), keys.ipv4(F.col("dst")).alias("dst_ip")))
query("render_prefix", f"WITH {TRACE_SQL} SELECT rec_no, {ip_sql(KEY_SQL['src24'], 'src24')} AS p24, {ip_sql(KEY_SQL['src16'], 'src16')} AS p16 FROM trace")(lambda s, d: from_events(s, d).select("rec_no", keys.render(keys.key("src24"), "src24").alias("p24"), keys.render(keys.key("src16"), "src16").alias("p16")))
TUPLE_SQL = f"{ip_sql('src')} || ':' || sport || '->' || {ip_sql('dst')} || ':' || dport || '/' || proto"
query("render_5tuple", f"WITH {TRACE_SQL} SELECT rec_no, {TUPLE_SQL} AS flow FROM trace")(lambda s, d: from_events(s, d).select("rec_no", keys.render(keys.key("5tuple"), "5tuple").alias("flow")))
query("parse_ipv4", f"WITH {TRACE_SQL} SELECT rec_no, src AS parsed FROM trace")(lambda s, d: from_events(s, d).select("rec_no", keys.parse_ipv4_column(keys.ipv4(F.col("src"))).alias("parsed")))
query("filter_syn_only", f"WITH {TRACE_SQL} SELECT rec_no, src, dst FROM trace WHERE proto = 6 AND flags & 1 <> 0 AND flags & 2 = 0")(lambda s, d: from_events(s, d).where((F.col("proto") == 6) & (F.col("flags").bitwiseAND(1) != 0) & (F.col("flags").bitwiseAND(2) == 0)).select("rec_no", "src", "dst"))
query("filter_after_t0", f"WITH {TRACE_SQL} SELECT rec_no, ts_us FROM trace WHERE ts_us > (SELECT arg_min(ts_us, rec_no) FROM trace)")(lambda s, d: (lambda t: t.where(F.col("ts_us") > t.agg(F.min_by("ts_us", "rec_no")).first()[0]).select("rec_no", "ts_us"))(from_events(s, d)))
query("pane_index", f"WITH {TRACE_SQL} SELECT rec_no, (ts_us - t0 + {int(D * 1e6) - 1}) // {int(D * 1e6)} AS q FROM trace, (SELECT arg_min(ts_us, rec_no) AS t0 FROM trace) WHERE ts_us > t0")(lambda s, d: (lambda t, t0: t.where(F.col("ts_us") > t0).select("rec_no", F.expr(f"(ts_us - {t0} + {int(D * 1e6) - 1}) div {int(D * 1e6)}").alias("q")))(from_events(s, d), from_events(s, d).agg(F.min_by("ts_us", "rec_no")).first()[0]))

# frequencies
for _kind in ("src", "dst", "src24", "src16"):
    for _w, _sql in (("pkts", "count(*)"), ("bytes", "sum(len)::BIGINT")):
        query(f"freq_{_kind}_{_w}", f"WITH {TRACE_SQL} SELECT {ip_sql(KEY_SQL[_kind], _kind)} AS key, {_sql} AS f FROM trace GROUP BY {KEY_SQL[_kind]}")(lambda s, d, k=_kind, w=_w: stats.frequencies(from_events(s, d), k, w).select(keys.render(F.col("key"), k).alias("key"), "f"))
query("freq_5tuple", f"WITH {TRACE_SQL} SELECT {TUPLE_SQL} AS key, count(*) AS f FROM trace GROUP BY src, dst, sport, dport, proto")(lambda s, d: stats.frequencies(from_events(s, d), "5tuple").select(keys.render(F.col("key"), "5tuple").alias("key"), "f"))
query("freq_lineitem", f"WITH {LINE_SQL} SELECT dst AS key, sum(len)::BIGINT AS f FROM trace GROUP BY dst")(lambda s, d: stats.frequencies(from_lineitem(s, d), "dst", "bytes"))


def stats_sql(key: str, weight: str) -> str:
    return f"""WITH {TRACE_SQL}, f AS (SELECT {KEY_SQL[key]} AS key, sum({weight})::BIGINT AS f FROM trace GROUP BY ALL), r AS (SELECT key, f, row_number() OVER (ORDER BY f DESC, key) AS i FROM f),
a AS (SELECT count(*) AS records, sum(len)::BIGINT AS bytes, (count(*) FILTER (flags & 16 <> 0))::BIGINT AS synthetic, (arg_max(ts_us, rec_no) - arg_min(ts_us, rec_no)) / 1e6 AS secs FROM trace),
k AS (SELECT count(*) AS "distinct", (count(*) FILTER (f = 1))::BIGINT AS singletons, sum(f)::DOUBLE AS total, sum(f) FILTER (i <= 10) AS top10, sum(f) FILTER (i <= 100) AS top100, max(f) AS top_f, arg_min(key, i) AS top FROM r)
SELECT records, bytes, synthetic, round(secs, 6) AS seconds, round(records / secs, 6) AS pkts_per_s, round(bytes * 8 / secs / 1e9, 12) AS gbps, "distinct", singletons, round(100 * singletons / "distinct", 6) AS singleton_pct, round(top10 / total, 6) AS top10_mass, round(top100 / total, 6) AS top100_mass, {ip_sql('top', key)} AS top_key, top_f FROM a, k"""


for _n, _k, _w in (("stats_src", "src", "pkts"), ("stats_dst", "dst", "pkts"), ("stats_dst_bytes", "dst", "bytes")):
    query(_n, stats_sql(_k, "len" if _w == "bytes" else "1"))(lambda s, d, k=_k, w=_w: stats.stats(from_events(s, d), k, w))
RANK_SQL = f"""WITH RECURSIVE {TRACE_SQL}, r AS (SELECT f, row_number() OVER (ORDER BY f DESC) AS rank FROM (SELECT count(*) AS f FROM trace GROUP BY dst)), n AS (SELECT count(*) AS n FROM r),
m AS (SELECT 0::BIGINT AS i UNION ALL SELECT floor(1.02::DOUBLE * i)::BIGINT + 1 FROM m, n WHERE floor(1.02::DOUBLE * i)::BIGINT + 1 < n.n)
SELECT r.rank, r.f AS freq FROM r WHERE r.rank - 1 IN (SELECT i FROM m) OR r.rank = (SELECT n FROM n)"""
query("rank_curve", RANK_SQL)(lambda s, d: stats.rank_curve(from_events(s, d), "dst"))

# windows
for _k in ("src", "dst", "src24", "src16"):
    add_windows(f"windows_{_k}", key=_k)
add_windows("windows_bytes", key="dst", weight="bytes")
add_windows("windows_max_n", key="dst", max_windows=7)
add_windows("windows_uneven_delta", key="dst", W=DAY, delta=7 * HOUR)
add_windows("windows_wide_delta", key="dst", W=6 * HOUR, delta=11 * HOUR)
add_windows("windows_lineitem", from_lineitem, LINE_SQL, key="dst", weight="bytes", W=60 * DAY, delta=10 * DAY)
query("windows_5tuple", final_windows(windows_sql(key=TUPLE_SQL)))(lambda s, d: Windows(from_events(s, d), "5tuple", W=W, delta=D).windows())
query("windows_summary", final_windows(windows_sql("dst")).replace("WITH trace", "SELECT count(*) AS windows, round(avg(\"distinct\"), 6) AS mean_distinct, max(\"distinct\") AS max_distinct FROM (WITH trace", 1) + ")")(lambda s, d: Windows(from_events(s, d), "dst", W=W, delta=D).summary())
for _k in ("src", "dst"):
    query(f"topk_{_k}", windows_sql(_k) + f", r AS (SELECT win, key, f, row_number() OVER (PARTITION BY win ORDER BY f DESC, key) AS rank FROM freq) SELECT r.win, t.tau_us, rank::INT AS rank, {ip_sql('key')} AS key, f AS count, (f >= threshold)::INT AS is_hh FROM r JOIN tot t ON r.win = t.win WHERE rank <= 20")(lambda s, d, k=_k: Windows(from_events(s, d), k, W=W, delta=D).topk(20))


def query_sql(key: str, ips) -> str:
    return windows_sql(key) + f", g AS (SELECT t.*, k.key, coalesce(f.f, 0)::BIGINT AS exact_f FROM tot t CROSS JOIN (SELECT unnest([{', '.join(map(str, ips))}]::BIGINT[]) AS key) k LEFT JOIN freq f ON f.win = t.win AND f.key = k.key)"


QUERY_SQL = query_sql("dst", IPS[:2]) + f"SELECT win, tau_us, round((tau_us - t0) / 1e6, 6) AS t_rel_s, {ip_sql('key')} AS key, N, threshold, exact_f, (exact_f >= threshold)::INT AS exact_hh, exact_f - lag(exact_f) OVER (PARTITION BY key ORDER BY win) AS exact_delta FROM g, b"
query("query_points", QUERY_SQL)(lambda s, d: Windows(from_events(s, d), "dst", W=W, delta=D).query(list(IPS[:2])))

# profile
PROFILE_SQL = f"""WITH {TRACE_SQL}, s AS (SELECT * FROM trace WHERE src = {SENDER}), a AS (SELECT count(*) AS sent, sum(len)::BIGINT AS sent_bytes, min(len) AS len_min, max(len) AS len_max, avg(len) AS len_avg, (max(ts_us) - min(ts_us)) / 1e6 AS span, (count(*) FILTER (proto = 6))::BIGINT AS tcp, (count(*) FILTER (proto = 6 AND flags & 1 <> 0 AND flags & 2 = 0))::BIGINT AS syn_only, count(DISTINCT dst) AS dsts, count(DISTINCT dst & 4294967040) AS dst24s FROM s),
r AS (SELECT count(*) AS recv, sum(len)::BIGINT AS recv_bytes FROM trace WHERE dst = {SENDER}), n AS (SELECT count(*) AS n FROM trace)
SELECT sent, recv, sent_bytes, recv_bytes, len_min, len_max, round(len_avg, 6) AS len_avg, round(span, 6) AS span_s, round(sent / span, 6) AS mean_rate, round(sent / n, 6) AS share, (recv = 0 OR sent > 20 * recv)::INT AS unidirectional, tcp, syn_only, (syn_only > tcp // 2)::INT AS syn_flag, dsts, dst24s FROM a, r, n"""
query("profile_summary", PROFILE_SQL)(lambda s, d: stats.profile(from_events(s, d), SENDER))
query("profile_protocols", f"WITH {TRACE_SQL}, s AS (SELECT CASE proto WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'other' END AS protocol, count(*) AS n FROM trace WHERE src = {SENDER} GROUP BY ALL) SELECT protocol, n, round(100 * n / sum(n) OVER (), 6) AS pct FROM s")(lambda s, d: stats.profile_protocols(from_events(s, d), SENDER))
query("profile_ports", f"WITH {TRACE_SQL}, s AS (SELECT * FROM trace WHERE src = {SENDER}) SELECT dport AS port, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM s), 6) AS pct FROM s WHERE proto IN (6, 17) GROUP BY dport ORDER BY n DESC, port DESC LIMIT 5")(lambda s, d: stats.profile_ports(from_events(s, d), SENDER))
query("profile_rate", f"WITH {TRACE_SQL}, s AS (SELECT ts_us FROM trace WHERE src = {SENDER}), q AS (SELECT (ts_us - (SELECT min(ts_us) FROM s)) // 1000000 AS sec, count(*)::DOUBLE AS n FROM s GROUP BY ALL), a AS (SELECT max(sec) + 1 AS seconds, sum(n) AS s, sum(n * n) AS ss FROM q) SELECT seconds, round(s / seconds, 6) AS mean_rate, round(sqrt(greatest(ss / seconds - (s / seconds) * (s / seconds), 0)) / (s / seconds), 6) AS cv, (sqrt(greatest(ss / seconds - (s / seconds) * (s / seconds), 0)) / (s / seconds) < 0.3)::INT AS constant FROM a WHERE seconds > 2")(lambda s, d: stats.profile_rate(from_events(s, d), SENDER))


# sketches
def murmur_sql(source: str, keep: str, key: str, seeds: str = "seed") -> str:
    """A select that adds h, the hash of ``key`` with the column ``seeds``, to ``keep`` columns of ``source``."""
    m = "4294967295"
    rot = lambda x, r: f"((({x} * {1 << r}) & {m}) | ({x} >> {32 - r}))"
    c = {k: f"{v}::UBIGINT" for k, v in (("c1", murmur.C1), ("c2", murmur.C2), ("f1", murmur.F1), ("f2", murmur.F2))}
    steps = [f"SELECT {keep}, ({key})::UBIGINT * {c['c1']} & {m} AS k, ({seeds})::UBIGINT AS s FROM {source}", f"SELECT *, {rot('k', 15)} AS k2 FROM", f"SELECT *, xor(s, k2 * {c['c2']} & {m}) AS g FROM", f"SELECT *, {rot('g', 13)} AS g2 FROM", f"SELECT *, xor((g2 * 5 + {murmur.ADD}) & {m}, 4::UBIGINT) AS h0 FROM", f"SELECT *, xor(h0, h0 >> 16) * {c['f1']} & {m} AS h1 FROM", f"SELECT *, xor(h1, h1 >> 13) * {c['f2']} & {m} AS h2 FROM"]
    out = steps[0]
    for x in steps[1:]:
        out = f"{x} ({out})"
    return f"SELECT {keep}, xor(h2, h2 >> 16)::BIGINT AS h FROM ({out})"


def cells_sql(counts: str, keep: str, sk: Sketch) -> str:
    """(keep, row, bucket, sign) of the keys of a relation."""
    rows = f"(SELECT c.*, r::BIGINT AS row, {sk.seed} + r AS seed FROM {counts} c, range(0, {sk.d}) AS u(r))"
    base = f"SELECT {keep}, row, h % {sk.w} AS bucket, 1::BIGINT AS sign FROM ({murmur_sql(rows, f'{keep}, row', 'key')})"
    if sk.kind == "cms":
        return base
    both = f"(SELECT c.*, {sk.seed} + 10007 + row AS seed2 FROM ({base}) c)"
    return f"SELECT {keep}, row, bucket, (CASE WHEN h & 1 = 1 THEN -1 ELSE 1 END)::BIGINT AS sign FROM ({murmur_sql(both, f'{keep}, row, bucket', 'key', 'seed2')})"


def table_sql(sk: Sketch, count: str = "count(*)", key: str = "dst") -> str:
    return f"WITH {TRACE_SQL}, f AS (SELECT {key} AS key, ({count})::BIGINT AS c FROM trace GROUP BY ALL), cells AS ({cells_sql('f', 'key, c', sk)}), tab AS (SELECT row::INT AS row, bucket, sum(c * sign)::BIGINT AS cnt FROM cells GROUP BY ALL) "


def estimate_sql(sk: Sketch, v: str) -> str:
    return f"list_min({v})" if sk.kind == "cms" else f"list_sort({v})[{sk.d // 2 + 1}]"


def _counts(s, d, key="dst", where="true"):
    return from_events(s, d).where(where).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("c"))


query("murmur_bucket", f"WITH {TRACE_SQL}, k AS (SELECT DISTINCT dst AS key FROM trace), x AS (SELECT key, 42 AS seed FROM k) SELECT key, h AS hash, h % 1024 AS bucket FROM ({murmur_sql('x', 'key', 'key')})")(lambda s, d: _counts(s, d).select("key", murmur.murmur_column(F.col("key"), 42).alias("hash"), (murmur.murmur_column(F.col("key"), 42) % 1024).alias("bucket")))
for _name, _sk in (("cms", CMS), ("cs", CS)):
    query(f"{_name}_table", table_sql(_sk) + "SELECT * FROM tab")(lambda s, d, k=_sk: sketch.build(_counts(s, d), k))
    query(f"{_name}_point", table_sql(_sk) + f"SELECT key, {estimate_sql(_sk, 'list(c.sign * coalesce(cnt, 0))')}::BIGINT AS estimate FROM cells c LEFT JOIN tab USING (row, bucket) GROUP BY key")(lambda s, d, k=_sk: (lambda c: sketch.point(sketch.build(c, k), c.select("key"), k))(_counts(s, d)))
    query(f"{_name}_merge", table_sql(_sk) + "SELECT * FROM tab")(lambda s, d, k=_sk: sketch.merge(sketch.build(_counts(s, d, where="rec_no % 2 = 0"), k), sketch.build(_counts(s, d, where="rec_no % 2 = 1"), k), k, k))
    # every cell of the whole trace stays, with 0 where all records were taken away
    query(f"{_name}_subtract", table_sql(_sk, count="count(*) FILTER (rec_no % 2 = 1)") + "SELECT * FROM tab")(lambda s, d, k=_sk: sketch.subtract(sketch.build(_counts(s, d), k), sketch.build(_counts(s, d, where="rec_no % 2 = 0"), k), k, k))


def detector_sql(sk: Sketch, ip: int) -> str:
    p = int(D * 1e6)
    grid = query_sql("dst", [ip])
    return grid + f""", pn AS (SELECT (ts_us - t0 + {p - 1}) // {p} AS q, dst AS key, count(*)::BIGINT AS c FROM trace, b WHERE ts_us > t0 GROUP BY ALL),
cells AS ({cells_sql('pn', 'q, key, c', sk)}), probe AS ({cells_sql(f'(SELECT {ip}::BIGINT AS key)', 'key', sk)}),
hits AS (SELECT c.q, c.row, sum(c.c * c.sign * p.sign)::BIGINT AS cnt FROM cells c JOIN probe p ON c.row = p.row AND c.bucket = p.bucket GROUP BY ALL),
last AS (SELECT max(win) AS top FROM spine),
vf AS (SELECT s.win, p.row, coalesce(sum(h.cnt), 0)::BIGINT AS f FROM spine s CROSS JOIN probe p LEFT JOIN hits h ON h.row = p.row AND h.q > s.win AND h.q <= s.win + 6 GROUP BY s.win, p.row),
vd AS (SELECT s.win, p.row, CASE WHEN s.win = 0 THEN 0 ELSE coalesce(sum(CASE WHEN h.q = s.win + 6 THEN h.cnt WHEN h.q = s.win THEN -h.cnt ELSE 0 END), 0) END::BIGINT AS dlt FROM spine s CROSS JOIN probe p LEFT JOIN hits h ON h.row = p.row GROUP BY s.win, p.row),
e AS (SELECT vf.win, greatest(0, {estimate_sql(sk, 'list(f)')})::BIGINT AS estimate_f FROM vf GROUP BY vf.win), de AS (SELECT win, list_sort(list(dlt))[{sk.d // 2 + 1}]::BIGINT AS estimate_delta FROM vd GROUP BY win),
x AS (SELECT g.*, t0, exact_f - lag(exact_f, 1) OVER (ORDER BY win) AS xd FROM g, b),
est AS (SELECT x.win, tau_us, round((tau_us - t0) / 1e6, 6) AS t_rel_s, {ip_sql('key')} AS key, N, threshold, estimate_f, (estimate_f >= threshold)::INT AS estimate_hh, estimate_delta, 1 AS matches_exact_window, 1 AS matches_exact_n, exact_f, (exact_f >= threshold)::INT AS exact_hh, ((exact_f >= threshold) = (estimate_f >= threshold))::INT AS matches_exact_hh, coalesce(xd, 0)::BIGINT AS exact_delta, abs(exact_f - estimate_f)::BIGINT AS abs_err, round(CASE WHEN exact_f > 0 THEN abs(exact_f - estimate_f) / exact_f ELSE 0 END, 6)::DOUBLE AS rel_err FROM x JOIN e ON x.win = e.win JOIN de ON x.win = de.win) """


def detected(s, d, sk):
    t = from_events(s, d)
    exact = Windows(t, "dst", W=W, delta=D, phi=PHI).query([IPS[0]])
    return sketch.detect(t, IPS[0], sk, "dst", pane=D, m=6, phi=PHI, exact=exact)


for _name, _sk in (("cms", CMS), ("cs", CS)):
    query(f"{_name}_detector", detector_sql(_sk, IPS[0]) + "SELECT * FROM est")(lambda s, d, k=_sk: detected(s, d, k))


# injection (no jitter: plain arithmetic) and evaluation
def _base(s, d):
    t = from_events(s, d)
    return t, t.agg(F.min_by("ts_us", "rec_no")).first()[0]


def _flood(s, d):
    t, t0 = _base(s, d)
    return inject.ddos(s, IPS[0], t0 + 300_000_000, pps=50.0, duration=10, sources=64, jitter=False)


def _sweep(s, d):
    t, t0 = _base(s, d)
    return inject.scan(s, t0 + 300_000_000, pps=50.0, duration=10, targets=128, jitter=False)


GRID_SQL = f"WITH {TRACE_SQL}, b AS (SELECT arg_min(ts_us, rec_no) + 300000000 AS t0 FROM trace), p AS (SELECT i AS rec_no, t0 + i * 20000 AS ts_us, t0 FROM b, range(0, 500) AS u(i)) "
query("inject_ddos", GRID_SQL + f"SELECT rec_no, ts_us, {IPS[0]} AS dst, 80 AS dport, 64 AS len, 6 AS proto, 17 AS flags FROM p")(lambda s, d: _flood(s, d).drop("src", "sport"))
query("inject_scan", GRID_SQL + "SELECT rec_no, ts_us, 3323068423 AS src, 80 AS dport, 64 AS len, 6 AS proto, 17 AS flags FROM p")(lambda s, d: _sweep(s, d).drop("dst", "sport"))
query("attack_per_second", GRID_SQL + "SELECT (ts_us - t0) // 1000000 AS sec, count(*) AS n FROM p GROUP BY ALL")(lambda s, d: inject.per_second(_flood(s, d), _base(s, d)[1] + 300_000_000, 10))
query("merge_union", GRID_SQL + f", u AS (SELECT rec_no, ts_us, dst, flags, 0 AS late FROM trace UNION ALL SELECT rec_no, ts_us, {IPS[0]}, 17, 1 FROM p) SELECT row_number() OVER (ORDER BY ts_us, late, rec_no) - 1 AS rec_no, ts_us, dst, flags FROM u")(lambda s, d: inject.merge(from_events(s, d), _flood(s, d)).select("rec_no", "ts_us", "dst", "flags"))
query("resolve_victim", f"WITH {TRACE_SQL}, f AS (SELECT dst, row_number() OVER (ORDER BY count(*) DESC, dst) - 1 AS r FROM trace WHERE rec_no < 2000000 GROUP BY dst) SELECT {ip_sql('dst')} AS victim FROM f WHERE r = least(10, (SELECT max(r) FROM f))")(lambda s, d: s.range(1).select(keys.ipv4(F.lit(inject.resolve_victim(from_events(s, d), 10))).alias("victim")))

START, END = int(2 * DAY * 1e6), int(3 * DAY * 1e6)


def evaluate_sql(sk: Sketch) -> str:
    j = f"tau_us > t0 + {START} AND tau_us - {int(W * 1e6)} < t0 + {END} AND exact_f > 0"
    near = f"tau_us BETWEEN t0 + {START} - 60000000 AND t0 + {END} + 61000000"
    first = "min(win) FILTER (estimate_hh = 1)"
    exact = "min(win) FILTER (exact_hh = 1)"
    return detector_sql(sk, IPS[0]) + f"""SELECT '{sk.kind}' AS sketch, {sk.w} AS width, {evaluate.memory_kb(sk)!r}::DOUBLE AS memory_kb, round(100 * avg(rel_err) FILTER ({j}), 6) AS mre_pct,
(count(*) FILTER (matches_exact_hh = 0))::BIGINT AS hh_disagreements, round(avg(abs(estimate_delta - exact_delta)) FILTER ({near}), 6) AS delta_mae, {first} AS first_win,
round((min(tau_us) FILTER (estimate_hh = 1) - (any_value(t0) + {START})) / 1e6, 6) AS latency_s,
CASE WHEN {first} IS NULL THEN 'not detected' WHEN {exact} IS NULL THEN NULL WHEN {first} = {exact} THEN 'same window' WHEN {first} < {exact} THEN 'early false positive' ELSE 'delay' END AS status,
max(estimate_delta) FILTER ({near}) AS max_estimate_delta, min(estimate_delta) FILTER ({near}) AS min_estimate_delta, max(exact_delta) FILTER ({near}) AS max_exact_delta, min(exact_delta) FILTER ({near}) AS min_exact_delta,
bool_and(matches_exact_window = 1 AND matches_exact_n = 1) AS aligned FROM est, b"""


for _name, _sk in (("cms", CMS), ("cs", CS)):
    query(f"evaluate_{_name}", evaluate_sql(_sk))(lambda s, d, k=_sk: (lambda t0: evaluate.metrics(detected(s, d, k), t0 + START, t0 + END, k, int(W * 1e6)))(_base(s, d)[1]))

MATRIX = experiment.sketches((64, 256))
CLEAN = experiment.sketches((4096,))


def _matrix(s, d):
    t, t0 = _base(s, d)
    attack = experiment.Attack("FLOOD", t, IPS[0], "dst", t0 + START, t0 + END)
    return experiment.matrix([attack], MATRIX, D, 6, PHI)


def clean_sql(sk: Sketch) -> str:
    return detector_sql(sk, IPS[0]) + f"SELECT 'events' AS scenario, '{sk.kind}' AS sketch, {sk.w} AS width, {evaluate.memory_kb(sk)!r}::DOUBLE AS memory_kb, round(avg(abs_err) FILTER (rel_err >= 0), 6) AS mean_abs_err, round(100 * avg(rel_err) FILTER (rel_err >= 0), 6) AS mre_pct FROM est"


query("evaluate_matrix", " UNION ALL ".join(f"SELECT 'FLOOD' AS attack, * FROM ({evaluate_sql(k)})" for k in MATRIX))(_matrix)
query("evaluate_clean", " UNION ALL ".join(f"SELECT * FROM ({clean_sql(k)})" for k in CLEAN))(lambda s, d: experiment.clean(from_events(s, d), IPS[0], "events", "dst", CLEAN, D, 6, PHI))
query("detector_alone", detector_sql(CMS, IPS[0]) + "SELECT * EXCLUDE (matches_exact_window, matches_exact_n, exact_f, exact_hh, matches_exact_hh, exact_delta, abs_err, rel_err), -1 AS matches_exact_window, -1 AS matches_exact_n, -1::BIGINT AS exact_f, -1 AS exact_hh, -1 AS matches_exact_hh, -1::BIGINT AS exact_delta, -1::BIGINT AS abs_err, -1::DOUBLE AS rel_err FROM est")(
    lambda s, d: sketch.detect(from_events(s, d), IPS[0], CMS, "dst", pane=D, m=6, phi=PHI)
)
query("memory_model", "SELECT w AS width, (8 * 5 * w * 4 + 48) / 1024 AS memory_kb FROM (SELECT unnest([256, 1024, 4096]) AS w)")(lambda s, d: s.createDataFrame([(w, evaluate.memory_kb(Sketch("cms", 5, w))) for w in (256, 1024, 4096)], "width int, memory_kb double"))


# what the draws of an injection must satisfy
PREFIX = 3323068416  # 198.18.0.0


def _draws(rows, spread: str, fixed: str, low: int, high: int):
    inside = (F.col(spread) >= PREFIX) & (F.col(spread) < PREFIX + 65536)
    return rows.agg(F.count("*").alias("n"), F.count_distinct(fixed).alias("fixed"), F.bool_and(inside).alias("in_prefix"), F.bool_and((F.col("sport") >= low) & (F.col("sport") < high)).alias("ports"), (F.count_distinct(spread) > 40).alias("many"), (F.count_distinct("sport") > 100).alias("many_ports"))


DRAWS_SQL = "SELECT 500::BIGINT AS n, 1::BIGINT AS fixed, true AS in_prefix, true AS ports, true AS many, true AS many_ports"
query("ddos_draws", DRAWS_SQL)(lambda s, d: _draws(_flood(s, d), "src", "dst", 1024, 65535))
query("scan_draws", DRAWS_SQL)(lambda s, d: _draws(_sweep(s, d), "dst", "src", 40_000, 60_000))
query("spread_addresses", f"SELECT 5000::BIGINT AS n, 5000::BIGINT AS different, true AS inside")(lambda s, d: s.range(5000).select(inject.spread(F.col("id"), 5000, "198.18.0.0/16", 7).alias("a")).agg(F.count("*").alias("n"), F.count_distinct("a").alias("different"), F.bool_and(F.col("a").between(PREFIX, PREFIX + 65535)).alias("inside")))

# addresses that spread over prefixes
WIDE_SQL = TRACE_SQL.replace("167772160 + user_id AS src", "(user_id * 2654435761) % 4294967296 AS src")


def _wide(s, d):
    return from_events(s, d).withColumn("src", F.pmod((F.col("src") - 167772160) * F.lit(2654435761), F.lit(4294967296)))


for _k in ("src24", "src16"):
    query(f"freq_{_k}_wide", f"WITH {WIDE_SQL} SELECT {ip_sql(KEY_SQL[_k], _k)} AS key, sum(len)::BIGINT AS f FROM trace GROUP BY {KEY_SQL[_k]}")(lambda s, d, k=_k: stats.frequencies(_wide(s, d), k, "bytes").select(keys.render(F.col("key"), k).alias("key"), "f"))
    add_windows(f"windows_{_k}_wide", _wide, WIDE_SQL, key=_k)


# sources and sinks: the trace written to a file of the format and read back
def _through_trace24(s, d):
    path = shared.scratch(s, "trace24").removeprefix("file:")
    trace24.write(from_events(s, d), path)
    return trace24.read(s, path)


def _through_pcap(s, d):
    path = shared.scratch(s, "events.pcap").removeprefix("file:")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    pcap.write(from_events(s, d), path)
    return pcap.read(s, path)


def _through_csv(s, d):
    path = shared.scratch(s, "query")
    tables.write_csv(Windows(from_events(s, d), "dst", W=W, delta=D).query(list(IPS[:2])), path)
    return tables.read_query_csv(s, path)


query("trace24_roundtrip", f"WITH {TRACE_SQL} SELECT {PROJECT} FROM trace")(_through_trace24)
query("pcap_decode", f"WITH {TRACE_SQL} SELECT {PROJECT} FROM trace")(_through_pcap)
query("query_csv_roundtrip", QUERY_SQL)(_through_csv)
