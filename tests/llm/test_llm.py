"""The ten operators and the pipeline against brute force, round trips and held-out labels."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyflow.llm import chat, components, decontaminate, embedding_dup, langid, license_scan, near_dup, packing, queries, substring_dedup, tokens, warc, words

WS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k0 string, `odd.name` string"


def text_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.2 else f"v{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def tricky():
    """Copies, near copies, shared passages, nulls, empties, repeats of one row, a long text."""
    rng = random.Random(3)
    passage = text_of(rng, 60, 10**6)
    rows = [(0, passage + " tail\n\tend"), (1, "lead " + passage), (2, None), (3, ""), (4, " \n\t "), (5, "one two"), (6, "one two"), (None, passage)]
    base = text_of(rng, 120, 10**6)
    for i in range(7, 27):
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    rows += [(i, text_of(rng, rng.randrange(1, 90), 12)) for i in range(27, 47)]
    rows += [(47, text_of(rng, 30000, 10**6) + " " + passage), (48, "a b c d e f g h i j k l m n " * 30), (48, "a b c d e f g h i j k l m n " * 30), (49, "\x1cA B <|endoftext|> x\x00y"), (50, "!!! 123")]
    return [(i, t, "en", "src", len(t or ""), "clash", "x") for i, t in rows]


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def repeats(rows):
    """Contract of operator 1, by brute force."""
    top = 1 << 63
    first = {}
    for i, t, *_ in rows:
        w = WS.findall(t or "")
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, top), top if i is None else i)
    out = []
    for i, t, *_ in rows:
        w = WS.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < (top if i is None else i):
                gone[p : p + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_difference_cover_has_every_difference():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


def test_words_match_their_pattern():
    rng = random.Random(1)
    texts = ["", None, "é", "a", " a ", "\x1c", "a b c"] + ["".join(rng.choice("aZé \t\n\x0b9-ß漢") for _ in range(rng.randrange(40))) for _ in range(300)]
    import pyarrow as pa

    data, off = words.text_buffers(pa.array(texts, pa.string()))
    for table, pattern, fold in ((words.WHITESPACE, WS, False), (words.NON_ALNUM, ALNUM, True)):
        w = words.find_words(data, off, table, fold)
        got = [[w.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        assert got == [pattern.findall((t or "").translate(lower) if fold else t or "") for t in texts]


def test_op1(spark, tricky):
    got = substring_dedup.substring_dedup(documents(spark, tricky)).collect()
    assert sorted(map(tuple, got), key=str) == repeats(tricky)


def test_op1_on_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op1_substring_dedup(spark, sf_dir).collect()), key=str) == repeats(rows)


def test_op1_texts(spark, tricky):
    got = {r["doc_id"]: r for r in substring_dedup.without_repeats(documents(spark, tricky)).collect()}
    assert list(got[0].asDict()) == [c.split()[0].strip("`") for c in DOCS.split(", ")]
    assert got[0]["text"] == tricky[0][1] and got[1]["text"] == "lead" and got[1]["n_chars"] == 4
    assert None not in got and got[2]["text"] is None and got[3]["text"] == "" and got[0]["k0"] == "clash"


def test_op2(spark):
    t = license_scan.TEMPLATES
    rng = random.Random(5)
    noise = lambda n: text_of(rng, n)
    rows = [(i, f"{noise(rng.randrange(40))}\n{t[k]}\n{noise(rng.randrange(40))}") for i, k in enumerate(sorted(t))]
    rows += [(50, None), (51, ""), (52, "license"), (53, "released under"), (54, noise(200) + " licensed permission"), (None, t["MIT"]), (55, t["MIT"].upper() + t["CC-BY-NC-4.0"]), (0, "twice " + t["MIT"]), (0, "plain"), (0, "plain")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, license_id string, w string")
    got = license_scan.license_scan(docs).collect()
    assert len(got) == len(rows)
    assert sorted(r["license_ids"] for r in got if r["doc_id"] == 0) == ["", "", min(t), "MIT"]
    shown = license_scan.license_matches(docs).where("doc_id = 55").collect()
    assert shown[0].asDict().keys() == {"doc_id", "text", "w", "license_id", "window_start", "containment"} and {r["license_id"] for r in shown} == {"MIT", "CC-BY-NC-4.0"}
    said = collections.defaultdict(list)
    for r in got:
        said[r["doc_id"]].append(r["license_ids"])
    for i, k in enumerate(sorted(t)):
        assert any(k in x.split(",") for x in said[i]), (k, said[i])
    assert said[55] == ["CC-BY-NC-4.0,MIT"] and said[None] == ["MIT"] and all(said[i] == [""] for i in (50, 51, 52, 53, 54))


def test_op2_bands_guarantee():
    assert all(license_scan.miss_probability(license_scan.least_jaccard(n)) < 1e-5 for n in range(5, 400))


def test_op2_against_containment(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {}
    for r in rows:
        w, found = license_scan.words_of(r["text"] or ""), set()
        for k, text in license_scan.TEMPLATES.items():
            q = license_scan.words_of(text)
            n, s = len(q), license_scan.stride(len(q))
            need = {tuple(q[i : i + 5]) for i in range(max(1, n - 4))}
            for a in range(0, len(w), s):
                win = w[a : a + n + s - 1]
                if len({tuple(win[i : i + 5]) for i in range(max(1, len(win) - 4))} & need) >= 0.8 * len(need) - 1e-9:
                    found.add(k)
        want[r["doc_id"]] = ",".join(sorted(found))
    assert {r["doc_id"]: r["license_ids"] for r in queries.op2_license_scan(spark, sf_dir).collect()} == want


def test_op3(spark, sf_dir, tmp_path):
    big, small = "x" * 990 + "é" * 10, "s" * 10
    rows = [(1, "http://a/ b\r\n", big), (7, None, big), (3, "u", big), (4, "u", small), (5, "u", small), (6, "u", None), (None, "u", big), (8, "u", "unique" * 300)]
    raw, out, index = (str(tmp_path / x) for x in ("raw", "out", "index"))
    warc.write_archives(warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)), raw)
    warc.normalise(spark, raw, out)
    warc.write_index(spark, out, index)
    got = {r["page_id"]: r for r in warc.read_records(spark, out, index).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        revisit = html == big and i != 7
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None)
        assert revisit or bytes(got[i]["payload"]) == payload
    assert got[1]["url"] == "http://a/%20b%0D%0A" and got[7]["url"] is None
    import gzip

    whole = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("out/*.warc.gz"))
    assert whole.count(b"WARC/1.1\r\n") == len(rows)
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r["page_id"]: r["payload_bytes"] for r in queries.op3_warc(spark, sf_dir).collect()} == {k: len((v or "").encode()) for k, v in pages.items()}


def test_op3_finds_damage(spark, tmp_path):
    rows = [(1, "u", "p" * 2000), (2, "u", "p" * 2000), (3, "v", "q" * 50)]
    raw, out, index = (str(tmp_path / x) for x in ("raw", "out", "index"))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int").coalesce(1)
    warc.write_archives(warc.with_revisits(docs), raw)
    warc.normalise(spark, raw, out)
    warc.write_index(spark, out, index)
    got = {r["page_id"]: r for r in warc.resolved(warc.read_records(spark, out, index)).collect()}
    assert got[1]["payload_bytes"] == got[2]["payload_bytes"] == 2000 and got[1]["refers_to"] == 2
    assert {r["page_id"] for r in warc.scan_records(spark, out).collect()} == {1, 2, 3}
    alone = warc.read_records(spark, out, index).where("page_id <> 2")
    with pytest.raises(Exception, match="names a response that is not there"):
        warc.resolved(alone).collect()
    good = warc.record(9, None, b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc._decoded([good]).to_pylist()[0]["payload"] == b"abc"
    with pytest.raises(ValueError, match="not the one"):
        warc._decoded([good.replace(b"abc", b"abd")])


def test_op3_empty(spark, tmp_path):
    raw, out, index = (str(tmp_path / x) for x in ("raw", "out", "index"))
    warc.write_archives(warc.with_revisits(spark.createDataFrame([], "page_id long, url string, html string")), raw)
    warc.normalise(spark, raw, out)
    warc.write_index(spark, out, index)
    assert warc.read_records(spark, out, index).count() == 0


def hits(docs, items):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wins = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(lower))
        for p in range(max(1, len(w) - 9)) if w else ():
            wins[tuple(w[p : p + 10])].add(i)
    lengths = {len(k) for k in wins}
    out = []
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(lower))
        hit, ids = [False] * len(w), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit[p : p + n] = [True] * n
                    ids |= wins[tuple(w[p : p + n])]
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((i, len(w), sum(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [decontaminate.CHUNK_BYTES, 150])
def test_op4(spark, tricky, chunk):
    rng = random.Random(9)
    items = [(10, None), (2, ""), (33, tricky[0][1][40:300].upper()), (4, "Two"), (5, "one two"), (5, "v1 v2"), (None, "one-two"), (6, text_of(rng, 14, 6)), (7, text_of(rng, 30, 12))]
    items += [(8, " ".join(tricky[47 - 0][1].split()[20000:20040])), (9, "a b c d e f g h i j k l m n a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(documents(spark, tricky), bench, chunk_bytes=chunk).drop("matches").collect()
    assert sorted(map(tuple, got), key=str) == hits([r[:2] for r in tricky], items)
    clean = decontaminate.keep_clean(documents(spark, tricky), bench, chunk_bytes=chunk)
    assert clean.columns == [c.split()[0].strip("`") for c in DOCS.split(", ")]
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(r["doc_id"]) for r in got if not r["contaminated"])


def test_op4_longest_matches(spark):
    got = decontaminate.decontaminate(spark.createDataFrame([(1, "x a b c d e f g h i j k l y")], "doc_id long, text string"), spark.createDataFrame([(9, "q a b c d e f g h i j k l m")], "item_id long, text string")).first()
    assert [tuple(m) for m in got["matches"]] == [("9", 1, 1, 12)]


def test_op4_on_tables(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op4_decontaminate(spark, sf_dir).collect()), key=str) == hits(docs, items)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 300):
        s = rng.integers(0, 3, n)
        assert decontaminate.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_op5(spark):
    rows = [(1, 2, "assistant", "b\\l<x>\\"), (1, 1, "user", "</turn>\n<turn assistant>hi"), (1, 3, "assistant", None), (1, 3, "assistant", "Z"), (1, None, None, "n"), (2, 0, "a>b", ""), (None, 0, "assistant", "ü"), (3, 0, "assistant", "1"), (3, 1, "user", "2"), (3, 2, "assistant", "3")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in {r[0] for r in rows}:
        want = [(r or "", t or "") for _, n, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        assert [tuple(t) for t in got[conv]["turns"]] == want
        assert got[conv]["loss_text"] == "".join(t for r, t in want if r == "assistant")
    assert got[1]["formatted"].count("<turn ") == 3 and got[1]["formatted"].count("<more ") == 2


def test_op5_empty(spark):
    assert chat.read_back(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_op6(spark):
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op6_language_id(spark, d).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in got) <= 0.01 * len(got)


def test_op6_margin_of_long_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    model = langid.learn(docs, "doc_id", "text", "lang", ~langid.held_out())
    parts = collections.defaultdict(list)
    for r in docs.where(langid.held_out()).orderBy("doc_id").select("lang", "text").collect():
        parts[r["lang"]].append(r["text"])
    long = {lang: (" ".join(p) * (1 + 4_000_000 // sum(map(len, p))))[:4_000_000] for lang, p in parts.items()}
    rows = spark.createDataFrame([(lang, t[:n]) for lang, t in long.items() for n in (2_000, 50_000, 4_000_000)], "lang string, text string")
    got = langid.identify(rows, model, keep=["lang", "text"]).select("lang", "lang_pred", "rejected", "score", F.length("text").alias("n")).collect()
    assert len(got) == 3 * len(long) >= 12 and all(r["lang_pred"] == r["lang"] and not r["rejected"] for r in got)
    margin = {(r["lang"], r["n"]): r["score"] for r in got}
    assert all(0.75 < margin[lang, n] / margin[lang, 4_000_000] < 1.33 for lang in long for n in (2_000, 50_000))
    assert langid.keep_identified(rows, model).count() == len(got)
    even = "".join(x[a : a + 2000] for a in range(0, 1_000_000, 2000) for x in (long["en"], long["fr"]))
    assert min(margin.values()) > 4 * langid.identify(spark.createDataFrame([(even,)], "text string"), model).first()["score"]


def test_op6_against_the_library(spark, sf_dir):
    """All sizes anew, a compressor for each text and block, and all sampled words counted here."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "text")).collect()
    got = {r["doc_id"]: r for r in queries.op6_language_id(spark, sf_dir).collect()}
    spell = lambda t: re.sub(rb"[\x00-\x60\x7B-\x7F]+", b" ", t.lower().encode()).split()
    model = {}
    for lang in sorted({r["lang"] for r in rows if r["lang"]}):
        own = sorted((r["h"], r["text"]) for r in rows if r["lang"] == lang and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1)
        count = collections.Counter(w for _, t in sorted(set(own))[: langid.SAMPLE_DOCS] for w in spell(t))
        words_, size = [], 1
        for w in sorted(count, key=lambda w: (-count[w], w)):
            size += len(w) + 1
            if size > langid.DICTIONARY_BYTES:
                break
            words_.insert(0, w)
        model[lang] = b" " + b" ".join(words_) + b" "
    for r in rows:
        t = r["text"] or ""
        if not re.search(r"[^\W\d_]", t):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        whole, sizes = b" ".join(spell(t)), {}
        for lang, content in model.items():
            blocks = [whole[a : a + langid.BLOCK_BYTES] for a in range(0, len(whole), langid.BLOCK_BYTES)]
            coder = lambda: zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(**langid.CODER), dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))  # noqa: B023, E731
            sizes[lang] = sum(len(coder().compress(b)) for b in blocks)
        best, second = sorted(sizes.values())[:2]
        assert got[r["doc_id"]]["lang_pred"] == min(sizes, key=lambda k: (sizes[k], k)), r["doc_id"]
        assert abs(got[r["doc_id"]]["score"] - (1 - best / second)) < 0.02


def test_op6_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "dictionary", lambda count: seen.append(count) or b" x ")
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(None, f"null{word(i)}", "aa") for i in range(1000)] + [(7, f"same{word(i)}", "bb") for i in range(1000)] + [(i, f"own{word(i)}", "cc") for i in range(1000)]
    rows += [(None, "copies", "dd")] * 1000 + [(i, f"few{word(i)}", "dd") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    assert list(langid.learn(docs, "doc_id", "text", "lang", F.lit(True))) == ["aa", "bb", "cc", "dd"]
    assert [sum(c.values()) for c in seen] == [langid.SAMPLE_DOCS] * 3 + [10]


def test_op6_edges(spark, tricky):
    got = langid.language_id(documents(spark, tricky), keep=["doc_id"]).collect()
    said = {r["doc_id"]: r["lang_pred"] for r in got}
    assert said[2] == said[3] == said[50] == "und" and said[5] == "en" and len(got) == len(tricky)
    nothing = langid.language_id(documents(spark, tricky).withColumn("lang", F.lit(None).cast("string")), keep=["doc_id"])
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_op7(spark, tricky, library):
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in tricky), key=str)
    assert sorted(map(tuple, tokens.token_counts(documents(spark, tricky)).collect()), key=str) == want


def test_op7_on_tables(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op7_token_counts(spark, sf_dir).collect()} == {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) for r in rows}


def test_op7_whole_tokens(library):
    bpe = tokens.load(tokens.default_path())
    rng = random.Random(2)
    for s in rng.sample(sorted(bpe.whole), 300):
        assert library.encode(s, add_special_tokens=False).ids == [bpe.whole[s]] or s in bpe.special


def similar(a, b):
    x, y = (collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a, b))
    total = 0.0
    for k in x.keys() & y.keys():
        total += 1 / sum(max(x[j] / x[k], y[j] / y[k]) for j in x.keys() | y.keys())
    return total


def classes(rows):
    parent = {i: i for i, t in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    held = [(i, WS.findall(t)) for i, t in rows if t and WS.findall(t)]
    at = collections.defaultdict(set)
    for i, w in held:
        for p in range(max(1, len(w) - 4)):
            at[tuple(w[p : p + 5])].add(i)
    text = dict(held)
    for a, b in {(a, b) for s in at.values() for a in s for b in s if a < b}:
        if root(a) != root(b) and similar(text[a], text[b]) >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i, _ in rows}


def test_op8(spark, tricky):
    got = near_dup.near_duplicates(documents(spark, tricky)).collect()
    assert len(got) == len(tricky)
    want = classes([r[:2] for r in tricky if r[0] is not None])
    assert {r["id"]: r["class_id"] for r in got if r["id"] is not None} == want
    assert all(r["class_id"] == r["id"] for r in got if r["kept"])
    assert collections.Counter(r["class_id"] for r in got if r["kept"]) == collections.Counter(set(want.values()))


def test_op8_on_tables(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r["doc_id"]: r["class_id"] for r in queries.op8_near_dup(spark, sf_dir).collect()} == classes(rows)


def test_op8_signatures_estimate():
    rng = np.random.default_rng(4)
    k = 4000
    ea = np.arange(60, dtype=np.uint64) * np.uint64(7919) + np.uint64(1)
    eb = np.concatenate([ea[:40], ea[:20] + np.uint64(10**9)])
    wa, wb = rng.integers(1, 5, 60), rng.integers(1, 5, 60)
    sig = near_dup.prob_minhash(np.repeat([0, 1], 60), words.mix(np.concatenate([ea, eb])), np.concatenate([wa, wb]), 2, k)
    oa, ob = np.argsort(words.mix(ea)), np.argsort(words.mix(eb))
    exact = near_dup.probability_jaccard(words.mix(ea)[oa], wa[oa], words.mix(eb)[ob], wb[ob])
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03
    x = dict(zip(ea.tolist(), wa.tolist()))
    y = dict(zip(eb.tolist(), wb.tolist()))
    slow = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
    assert abs(exact - slow) < 1e-9


@pytest.mark.parametrize("one_task", [0, 40, components.ONE_TASK])
def test_components(spark, one_task):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(200, 260)] + [(500, 500 + i) for i in range(1, 80)] + [(rng.randrange(120), rng.randrange(120)) for _ in range(60)] + [(7, 7), (3, None)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    parent = {}
    for a, b in edges:
        if b is None or a == b:
            continue
        ra, rb = parent.setdefault(a, {a}), parent.setdefault(b, {b})
        if ra is not rb:
            ra |= rb
            for x in rb:
                parent[x] = ra
    assert got == {n: min(s) for n, s in parent.items()}


def test_op9(spark):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(64)
        for _ in range(rng.integers(1, 40)):
            rows.append((len(rows), (centre + rng.standard_normal(64) * rng.uniform(0, 0.2)).astype(np.float32).tolist()))
    big = (rng.standard_normal(64)).astype(np.float32)
    rows += [(len(rows) + i, (big * (1 + i)).tolist() if i % 2 else big.tolist()) for i in range(700)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 64), (n + 3, [1.0, None]), (n + 4, [float("nan")] * 64), (n + 5, [3.0, 4.0]), (n + 6, [6.0, 8.0]), (n + 7, [float("inf"), 1.0])]
    got = {r["id"]: r for r in embedding_dup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()}
    v = np.array([r[1] for r in rows[:n]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.95
    want = near.sum(1) - 1
    links = sum(got[i]["n_links"] for i in range(n))
    assert want.sum() >= links >= 0.99 * want.sum() and all(got[i]["n_links"] <= want[i] for i in range(n))
    label = np.arange(n)
    for _ in range(n):
        new = np.array([label[near[i]].min() for i in range(n)])
        if (new == label).all():
            break
        label = new
    assert np.mean([got[i]["component_id"] == label[i] for i in range(n)]) > 0.99
    assert all(got[n + i]["n_links"] == 0 and got[n + i]["kept"] for i in (0, 1, 2, 3, 4, 7))
    assert got[n + 5]["n_links"] == got[n + 6]["n_links"] == 1 and got[n + 6]["component_id"] == n + 5


def test_op9_finds_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(11)
    u, w = rng.standard_normal((2, 2000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (u * w).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    c = embedding_dup.COSINE + 1e-9
    v = np.concatenate([u, c * u + np.sqrt(1 - c * c) * w])
    assert (v @ v.T >= embedding_dup.COSINE).sum() == 2 * len(v)  # each with itself and its partner
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["id"]: r for r in embedding_dup.embedding_duplicates(rows).collect()}
    assert sum(r["n_links"] for r in got.values()) == len(v)
    assert all(got[i]["component_id"] == got[i + 2000]["component_id"] == i for i in range(2000))


def check_packing(rows, docs, library, capacity=1024):
    bins, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for held in bins.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= capacity
    want = collections.Counter()
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        raw = np.array(ids, "<u4").tobytes()
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        want.update((i, k, a, z - a, zlib.crc32(raw[4 * a : 4 * z])) for k, (a, z) in enumerate(zip(cuts, cuts[1:])))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    return len(bins), packing.lower_bound(collections.Counter(r["length"] for r in rows), capacity)


def test_op10(spark, tricky, library):
    used, bound = check_packing(packing.pack(documents(spark, tricky)).collect(), [r[:2] for r in tricky], library)
    assert used == bound
    assert packing.pack(documents(spark, tricky).where("false")).count() == 0


def test_op10_on_tables(spark, sf_dir, library):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    used, bound = check_packing(queries.op10_packing(spark, sf_dir).collect(), docs, library)
    assert used <= bound + 1


def test_op10_plan_is_optimal_on_small_cases():
    def fewest(sizes, capacity):
        best = [len(sizes)]

        def go(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(sizes):
                best[0] = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + sizes[k] <= capacity:
                    bins[i] += sizes[k]
                    go(k + 1, bins)
                    bins[i] -= sizes[k]
            bins.append(sizes[k])
            go(k + 1, bins)
            bins.pop()

        go(0, [])
        return best[0]

    rng = random.Random(12)
    for _ in range(60):
        sizes = sorted((rng.randrange(15, 70) for _ in range(rng.randrange(1, 11))), reverse=True)
        counts = collections.Counter(sizes)
        plan = packing.plan(counts, 100)
        assert collections.Counter(x for f, n in plan for x in f for _ in range(n)) == counts
        assert packing.bins(plan) == fewest(sizes, 100), sizes


def test_pipeline_stages(spark, sf_dir, library):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    names = [n for n, _ in p.STAGES]
    assert names == ["language", "near_duplicates", "repeats", "contamination", "packing"]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in p.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, sf_dir).cache()
        after = [tuple(r) for r in out.collect()]
        ids = {r[0] for r in after}
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            assert len(ids) >= 0.98 * len(before)
        elif name == "near_duplicates":
            assert ids == set(classes([r[:2] for r in before]).values())
        elif name == "repeats":
            want = {r[0]: r for r in repeats(before)}
            assert ids == {i for i, r in want.items() if not r[1] or r[2] < r[1]}
            assert all(hashlib.sha256(" ".join(WS.findall(r[1])).encode()).hexdigest() == want[r[0]][3] for r in after)
        elif name == "contamination":
            assert ids == {r[0] for r in hits([r[:2] for r in before], bench) if not r[5]}
        else:
            check_packing(out.collect(), [r[:2] for r in before], library)
        docs = out


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert substring_dedup.substring_dedup(none).count() == 0
    assert license_scan.license_scan(none).count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert langid.language_id(none).count() == 0
    assert tokens.token_counts(none).count() == 0
    assert near_dup.near_duplicates(none).count() == 0
    assert embedding_dup.embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
