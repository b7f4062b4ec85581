"""WARC archives, fill-in-middle and hard negatives against brute force, with every odd case."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeworks.llm import base, fim, negatives, queries, warc

PAGES = "page_id long, url string, html string, Page_bytes int"


def pages():
    """Null and empty pages, small copies, large copies, ids that repeat or are null, urls that break lines."""
    rnd = random.Random(3)
    long = lambda: "".join(rnd.choice("abc \r\n<>é😀") for _ in range(1500))
    big, other = long(), "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 60
    rows = [(1, "http://a", None), (2, None, ""), (3, "http://a/\r\nX: y z", "small"), (4, "", "small"), (5, "http://b", big), (9, "http://b", big), (7, "http://b", big)]
    rows += [(11, "http://c", other), (10, "http://d", other), (None, "http://e", other), (12, "u", "x" * 999), (13, "u", "x" * 999), (14, "u", "x" * 1000), (15, "u", "x" * 1000)]
    rows += [(20, "v", long()), (20, "v", long()), (21, "w", big[:700] * 2), (21, "w", big[:700] * 2), (None, "n", "lone" * 400), (None, "n", "lone" * 400), (30, "z", "y" * 3_000_000)]
    return [(*r, 0) for r in rows]


def brute_pages(rows):
    first = collections.defaultdict(list)
    for key, _, html, _ in rows:
        first[html or ""].append(key)
    out = []
    for key, _, html, _ in rows:
        data = (html or "").encode()
        known = [k for k in first[html or ""] if k is not None]
        refers = max(known) if len(data) >= 1000 and known and max(known) != key else None
        out.append((key, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return collections.Counter(out)


@pytest.fixture
def small_files(monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)


def test_archives_round_trip(spark, tmp_path, small_files):
    base.prepare(spark)
    spark.createDataFrame(pages(), PAGES).repartition(3).write.parquet(str(tmp_path / "in/pages.parquet"))
    got = queries.op11_warc(spark, str(tmp_path / "in"))
    assert got.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert collections.Counter(tuple(r)[:5] for r in got.collect()) == brute_pages(pages())


@pytest.mark.parametrize("compressed", [True, False])
def test_archives_hold_whole_pages(spark, tmp_path, small_files, compressed):
    base.prepare(spark)
    made = warc.write(spark.createDataFrame(pages(), PAGES), f"file:{tmp_path}/out", compressed=compressed)
    assert made.count() > 3 and made.agg(F.sum("records")).first()[0] == len(pages())
    rows = warc.read(made)
    assert warc.gaps(rows).isEmpty()
    text = F.col("payload").cast("string")
    back = collections.Counter((r[0], r[1]) for r in warc.resolved(rows).select(warc.page_id(F.col("record_id")), text).collect())
    assert back == collections.Counter(("" if k is None else str(k), html or "") for k, _, html, _ in pages())
    uris = {r["uri"] for r in rows.filter("type <> 'warcinfo'").collect()}
    assert None in uris and "" in uris and "http://a/%0D%0AX:%20y%20z" in uris
    listed = warc.read(warc.files(spark, f"{tmp_path}/out"))
    assert listed.filter("type = 'response'").count() == rows.filter("type = 'response'").count()


def test_archives_of_an_empty_table(spark, tmp_path):
    base.prepare(spark)
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "in/pages.parquet"))
    assert queries.op11_warc(spark, str(tmp_path / "in")).collect() == []


class Held:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def scanned(data):
    return list(warc.scan(warc.Source(Held(bytes(data)), len(data))))


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("harm", ["flip", "lose", "junk", "cut", "zeros"])
def test_salvage_recovers_all_but_the_damaged(monkeypatch, compressed, harm):
    """Rows cover all bytes, and every whole record is there; a damaged one may be if what changed was zero before or no check covers it."""
    monkeypatch.setattr(warc, "WINDOW", 97)
    monkeypatch.setattr(warc, "SIP", 31)
    rnd, pack = random.Random(len(harm)), warc._compressed if compressed else bytes
    for _ in range(60):
        parts = [pack(warc.page_record(str(k), "u", bytes(rnd.choice(b"ab\r\n WARC/1.0\x1f\x8b\x08") for _ in range(rnd.randrange(900))), "7" if k % 3 == 0 else None)) for k in range(7)]
        ends = np.cumsum([0, *map(len, parts)]).tolist()
        data, hit = bytearray(b"".join(parts)), rnd.randrange(7)
        at = rnd.randrange(ends[hit], ends[hit + 1])
        whole = set(range(7)) - {hit}
        if harm == "flip":
            data[at] ^= rnd.randrange(1, 256)
        elif harm == "lose":
            del data[at : at + 1]
        elif harm == "zeros":
            data[at : ends[hit + 1]] = bytes(ends[hit + 1] - at)
        elif harm == "junk":
            data[ends[hit] : ends[hit]] = b"\x1f\x8b\x08junk WARC/1.0\r\nContent-Length: 5\r\n\r\n" * 2
            whole.add(hit)
        else:
            del data[at:]
            whole = set(range(hit))
        rows = scanned(data)
        assert [r["start"] for r in rows] == [0, *(r["stop"] for r in rows[:-1])][: len(rows)] and (not rows or rows[-1]["stop"] == len(data))
        # a changed byte of an uncompressed head may change its id, which no check covers
        names = (re.match(r"<urn:page:(\d)>$", r["record_id"] or "") for r in rows if not r.get("reason"))
        found = {int(m[1]) for m in names if m}
        assert whole <= found and (harm in ("flip", "lose", "zeros") or found == whole)


def test_salvage_within_a_member_and_without_any_record():
    three = [warc.page_record(str(k), None, b"p" * 50, None) for k in range(3)]
    broken = three[0] + three[1].replace(b"ppp", b"pqp", 1) + three[2]
    rows = scanned(warc._compressed(broken))
    assert [(r.get("record_id"), r.get("reason")) for r in rows] == [("<urn:page:0>", None), (None, "block digest"), ("<urn:page:2>", None)]
    assert len({(r["start"], r["stop"]) for r in rows}) == 1 and rows[1]["inner_start"] == len(three[0])
    assert [(r["start"], r["stop"], r["reason"]) for r in scanned(b"nothing here")] == [(0, 12, "no version line")]
    assert scanned(b"") == []


def test_salvage_reads_foreign_digests_and_heads():
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    good = warc.record_bytes("response", "x", block, {"Content-Type": "application/http", "WARC-Payload-Digest": f"sha1:{hashlib.sha1(b'body').hexdigest()}"})
    (row,) = scanned(good)
    assert row["payload"] == b"body" and row["payload_digest"] == hashlib.sha1(b"body").hexdigest()
    other = warc.record_bytes("resource", "y", b"body", {"WARC-Payload-Digest": "md5:unknown"})
    (row,) = scanned(other)
    assert row["payload"] == b"body" and row["type"] == "resource"
    assert scanned(other.replace(b"Content-Length: 4", b"Content-Length: -4"))[0]["reason"] == "no length"
    assert scanned(other.replace(b"md5:unknown", b"sha1:" + b"A" * 32))[0]["reason"] == "payload digest"


UNITS = {"lines": r"[^\n]*\n|[^\n]+", "characters": r"[\s\S]", "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "tokens": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"}
TEXTS = [None, "", "\n", "a", "a\n", "a\nb", "\n\n", "x\r\ny\n😀é\nz", "<P>a\n", "q<S>", "<M>", "a 😀b  c", "😀😀😀", "<\nS>\n<M\n>", "ends in <\n<P\n", "line\n" * 2000, "tail   \x0b x\n"]


def brute_cut(key, text, unit, seed, rate, spm):
    text = text or ""
    u = re.findall(UNITS[unit], text)
    d = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return len(u), "spm" if h[3] % 100 < spm else "psm", p, m, f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "rate", "spm"), [("lines", 100, 50), ("characters", 100, 0), ("words", 50, 100), ("tokens", 0, 50)])
def test_fill_in_middle(spark, unit, rate, spm):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "a\nb\nc", "x"), (3, "a", "x"), (3, "other\ntext", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Output string")
    got = fim.transform(docs, unit, 7, rate, spm).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = collections.Counter((k, *brute_cut(k, t, unit, 7, rate, spm), t or "") for k, t, _ in rows)
    assert collections.Counter((r["doc_id"], r["n"], r["form"], r["prefix"], r["middle"], r["output"], r["back"]) for r in got) == want


def test_fill_in_middle_query(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = set()
    for k, t in enumerate(TEXTS):
        n, form, p, m, out = brute_cut(k, t, "lines", 7, 100, 50)
        want.add((k, n, form, None if p is None else len(p), None if m is None else len(m), digest(out), digest(t or "")))
    assert {tuple(r) for r in queries.op12_fill_in_middle(spark, str(tmp_path)).collect()} == want
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def vectors(n=400, labels=4):
    """Ties, copies, repeated ids, rows that take no part, short and empty vectors, and great components."""
    rnd = np.random.default_rng(4)
    x = np.round(rnd.normal(0.3, 1, (n, 9)), 1).tolist()
    rows = [(k, x[k % 300], int(rnd.integers(labels))) for k in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(500, None, 1), (501, [1.0] * 9, None), (502, [nan] * 9, 1), (503, [1.0, inf], 1), (504, [1.0, None], 1), (None, [1.0] * 9, 1), (505, [2.0, 1.0], 1), (506, [], 0), (507, [], 2)]
    return rows + [(3, [1.0] * 9, 1), (100, x[5], 0), (508, [1e30] + [0.0] * 8, 1), (510, [1e30] + [0.0] * 8, 0), (509, [-1e300] + [1.0] * 8, 2)]


def brute_negatives(rows, step, n_pos, n_neg, low, high):
    most = negatives.isqrt(negatives.MOST // 9)
    valid = []
    for key, x, label in rows:
        if None in (key, x, label) or any(c is None or not np.isfinite(c) for c in x):
            continue
        bound = negatives.isqrt(negatives.MOST // max(1, len(x)))
        v = [int(min(max(np.floor(256 * float(c)), -bound), bound)) for c in x] + [0] * (9 - len(x))
        valid.append((key, label, v))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    raw = lambda v, x: np.array(v[: len(x)], "<i8").tobytes()
    anchors = {}
    for (key, label, v), x in zip(valid, [x for k, x, l in rows if None not in (k, x, l) and all(c is not None and np.isfinite(c) for c in x)]):
        if key % step == 0:
            anchors[key] = min(anchors.get(key, (label, raw(v, x), v)), (label, raw(v, x), v))
    assert most > 0
    out = []
    for a, (label, _, v) in anchors.items():
        scored = [(dot(v, w), k, same == label) for k, same, w in valid if k != a]
        for p, pid, _ in sorted((s for s in scored if s[2]), key=lambda s: (-s[0], s[1]))[:n_pos]:
            fits = sorted((s for s in scored if not s[2] and low * p <= 100 * s[0] <= high * p), key=lambda s: (-s[0], s[1]))[:n_neg]
            out += [(a, pid, r, nid, p, score) for r, (score, nid, _) in enumerate(fits, 1)]
    return collections.Counter(out)


@pytest.mark.parametrize(("anchors", "rows", "chunk", "cell"), [(3, 7, 2, 2), (64, 512, 32, 8), (5, 16, 9, 1)])
def test_hard_negatives(spark, monkeypatch, anchors, rows, chunk, cell):
    base.prepare(spark)
    for name, value in (("ANCHORS", anchors), ("ROWS", rows), ("CHUNK", chunk), ("CELL", cell)):
        monkeypatch.setattr(negatives, name, value)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int").withColumn("Score", F.lit(1)).repartition(3)
    got = negatives.mine(df, F.col("id") % 10 == 0, F.col("label"), 5, 10)
    assert collections.Counter(map(tuple, got.collect())) == brute_negatives(vectors(), 10, 5, 10, 30, 90)


def test_hard_negatives_without_rows_or_with_one_label(spark):
    base.prepare(spark)
    kinds = "vec_id long, embedding array<float>, label int"
    mine = lambda rows: negatives.mine(spark.createDataFrame(rows, kinds), F.col("id") % 2 == 0, F.col("label")).collect()
    assert mine([]) == [] and mine([(1, None, 1)]) == [] and mine([(2, [], 1), (4, [], 1)]) == []
    assert mine([(k, [1.0, 2.0], 1) for k in range(9)]) == []
    assert len(mine([(k, [1.0, 2.0], k) for k in range(9)])) == 0
    assert {tuple(r) for r in mine([(0, [4.0], 1), (1, [4.0], 1), (3, [2.0], 2), (5, [2.0], 2), (7, [4.0], 2)])} == {(0, 1, 1, 3, 1 << 20, 1 << 19), (0, 1, 2, 5, 1 << 20, 1 << 19)}
