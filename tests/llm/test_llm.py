"""Corpus operators against brute force, on small fixtures with every odd case."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slopeworks.llm import base, bpe, htmltext, langid, linededup, packing, quality, queries, sharding, simjoin, tokencount, topk

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    """Odd texts: null, empty, blanks, copies, near copies, repeated lines, symbols, other scripts, and a very long one."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8)))
    plain = [" ".join(word() for _ in range(rnd.randrange(1, 120))) for _ in range(30)]
    near = []
    for t in plain[:8]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w).upper())
    shared = "this line is held by many documents"
    lines = [f"{plain[k]}\n  {shared.upper()} \n\n{shared}\nshort" for k in range(6)]
    odd = [None, "", " ", "\n\n", "one", "A b\tc", "don't  you'll 12 34,5 !! <|endoftext|> x", "ΣΑΣ é ß 漢字 😀 é", "x\x1cy  z\x85 ", "a\r\nb  c ", "$$$ ### %%%", "word " * 40]
    return plain + near + plain[:5] + lines + odd + [" ".join(plain * 40)]


@pytest.fixture(scope="module")
def docs(spark):
    base.prepare(spark)
    rows = [(k, t, ("en", "de")[k % 2], "s", len(t or "")) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    base.prepare(spark)
    return spark.createDataFrame([], DOCS)


def test_quality_measures(docs):
    got = {r["doc_id"]: r for r in quality.ledger(docs).collect()}
    for k, t in enumerate(texts()):
        w = WORD.findall(t or "")
        runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered)), k
        assert (r["n_symbols"], r["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines))), k


def test_quality_policies_and_ablations(docs):
    rows = quality.apply_policy(quality.ledger(docs))
    kept = {r["doc_id"] for r in rows.filter("kept").collect()}
    assert kept == {r["doc_id"] for r in quality.filter_documents(docs).collect()}
    for r in quality.ablations(rows).collect():
        without = quality.POLICIES["v1"] & ~quality.BIT[r["rule"]]
        assert r["n_kept_without"] == rows.filter(F.col("failed_bits").bitwiseAND(F.lit(without)) == 0).count()


def test_sharding_balances_bytes_and_keeps_groups(docs):
    rows = sharding.assign(docs).collect()
    text = dict(enumerate(texts()))
    assert len(rows) == len(text) and all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in rows)
    where = collections.defaultdict(set)
    for r in rows:
        where[text[r["doc_id"]] or ""].add(r["shard"])
    assert all(len(x) == 1 for x in where.values())
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_differencing_is_tight():
    rnd = random.Random(2)
    items = [(k, rnd.randrange(1, 5000)) for k in range(2000)]
    sums = collections.Counter()
    for name, shard in sharding.difference(items, 8).items():
        sums[shard] += items[name][1]
    assert max(sums.values()) - min(sums.values()) <= 2 and sharding.difference([], 8) == {}


def brute_lines(rows):
    keyed = [(d, [(x, x.strip(" \t\n\v\f\r").translate(FOLD)) for x in (t or "").split("\n")]) for d, t in rows]
    holders = collections.defaultdict(set)
    for d, lines in keyed:
        for _, k in lines:
            if len(k) >= 10:
                holders[k].add(d)
    out = {}
    for d, lines in keyed:
        kept = [x for x, k in lines if not (len(holders.get(k, ())) > 1 and min(holders[k]) != d)]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize(("hot", "parts"), [(2000, "4"), (1, "1"), (1, "4")])
def test_line_dedup(spark, docs, monkeypatch, hot, parts):
    """With HOT and partitions at 1 no hash is hot and all are streamed; by default, frequent ones are settled by the broadcast."""
    monkeypatch.setattr(linededup, "HOT", hot)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"] or "") for r in linededup.kept_texts(docs).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute_lines(enumerate(texts()))


def test_line_dedup_keeps_clashing_columns(docs):
    odd = docs.withColumn("n_lines", F.lit("mine")).withColumn("line_key", F.lit(1)).withColumn("POS", F.lit(2))
    out = linededup.kept_texts(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and out.filter("n_lines = 'mine'").count() == docs.count()


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_components(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in simjoin.components(docs).collect()}
    assert got == brute_components(enumerate(texts()))
    kept = sorted(r["doc_id"] for r in simjoin.first_of_each(docs).collect())
    assert kept == sorted({c for _, c in got.values()})


def test_components_of_a_chain_that_no_hub_holds(spark):
    """Texts that drift: each links to the next ones only, and many share the same subsets."""
    rnd = random.Random(4)
    words = [str(rnd.randrange(10**6)) for _ in range(400)]
    rows = [(k, " ".join(words[k * 5 : k * 5 + 200])) for k in range(30)] + [(100 + k, " ".join(words[:195] + [str(k)] * 5)) for k in range(20)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in simjoin.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("size", [3, 20, 33, 60, 140, 520])
def test_no_link_is_missed_by_signatures(size):
    rnd, linked = random.Random(size), 0
    for _ in range(40):
        words = [rnd.randrange(10**6) for _ in range(size)]
        variants = [" ".join(str(x) for x in words if rnd.random() > rnd.choice([0, 0.01, 0.03])) for _ in range(5)]
        key, first = simjoin.sets_of(pa.array(variants))
        one = simjoin.digests(key, first)[0]
        hashes, row, probe = simjoin.signatures(key, first)
        a, b, runs = simjoin.candidates_of(one[row], hashes, probe)
        found = {frozenset(x) for x in zip(a.tolist(), b.tolist())} | {frozenset(x) for m in runs for x in itertools.combinations(m.tolist(), 2)}
        for i, j in itertools.combinations(range(5), 2):
            x, y = key[first[i] : first[i + 1]], key[first[j] : first[j + 1]]
            if one[i] != one[j] and len(x) and simjoin.linked(x, y):
                linked += 1
                assert frozenset((int(one[i]), int(one[j]))) in found and simjoin.may_link(simjoin.sketch(x), len(x), simjoin.sketch(y), len(y))
    assert linked or size < 33


def test_language_profiles(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents")
    rows = queries.op2_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert rows.filter("lang_pred = lang").count() >= 0.95 * rows.count() > 0


def test_language_of_odd_texts(docs, empty):
    profiles = langid.learn(docs, F.lit(True))
    got = {r["doc_id"]: r for r in langid.predict(docs, profiles).collect()}
    for k, t in enumerate(texts()):
        assert (got[k]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= got[k]["lang_score"] <= 1
    assert {r["lang_pred"] for r in langid.predict(docs, langid.learn(empty, F.lit(True))).collect()} == {"und"}


def test_rare_scripts_keep_their_letters_apart(spark):
    latin = "".join(chr(c) for c in range(0x100, 0x180))
    scripts = {"ar": "ابتثجحخدذرزس", "el": "αβγδεζηθικλμ", "he": "אבגדהוזחטיכל", "ka": "აბგდევზთიკლმ"}
    words = lambda x, k: " ".join(x[(k + j) % len(x)] + x[(k + 2 * j) % len(x)] for j in range(20))
    rows = [(k, words(latin, k) + f" {latin}" * 9, "la") for k in range(20)]
    rows += [(100 * n + k, words(x, k), lang) for n, (lang, x) in enumerate(scripts.items(), 1) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == r["lang"] for r in langid.predict(docs, langid.learn(docs, F.lit(True))).collect())


def test_packing_is_whole(docs):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {k: ref.encode(t or "", add_special_tokens=False).ids + [0] for k, t in enumerate(texts())}
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), group=16).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for k, ids in want.items():
        pieces = sorted(by_doc[k], key=lambda r: r["start"])
        assert [i for r in pieces for i in np.frombuffer(r["ids"], "<u4").tolist()] == ids and all(r["doc_tokens"] == len(ids) for r in pieces)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_word_bpe_round_trip(docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    ref = Tokenizer.from_file(path)
    rows = bpe.encode(docs, path, bpe.build_lexicon(docs, path)).collect()
    for r in rows:
        ids = ref.encode(texts()[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == ref.decode(ids, skip_special_tokens=False)


def test_lexicon_is_minimal_and_numbers_words(tmp_path):
    words = sorted({"".join(x) for n in range(1, 5) for x in itertools.product("abc", repeat=n)})
    parts = bpe.compile_lexicon([(w.encode(), [k]) for k, w in enumerate(words)])
    bpe.write_lexicon(parts, str(tmp_path / "x"))
    lexicon = bpe.Lexicon(str(tmp_path / "x"))
    assert lexicon.numbers([w.encode() for w in words] + [b"", b"abcd", b"aaaaa"]).tolist() == [*range(len(words)), -1, -1, -1]
    assert len(parts["final"]) == 5  # one state for each number of letters left


def test_token_counts_are_those_of_a_unigram_model(docs):
    from tokenizers import Tokenizer, models

    scores = tokencount.piece_scores(P.path("piece_bpe_32k.model"))
    ref = Tokenizer(models.Unigram([("<unk>", 0.0)] + [(f"<0x{b:02X}>", -100.0) for b in range(256)] + list(scores.items()), 0, True))
    known = {}
    for r in tokencount.token_counts(docs, P.path("piece_bpe_32k.model")).collect():
        words = WORD.findall(texts()[r["doc_id"]] or "")
        for w in set(words) - known.keys():
            known[w] = len(ref.encode("▁" + w).ids)
        assert (r["n_tokens"], r["n_pretokens"]) == (sum(known[w] for w in words), len(words))


def test_top_k(spark):
    rnd = np.random.Generator(np.random.PCG64(5))
    rows = [(k, [float(x) for x in rnd.normal(size=8) * (1 + k % 3)]) for k in range(300)]
    rows += [(300, None), (400, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8), (600, [float("inf")] * 8), (700, rows[0][1]), (701, rows[0][1]), (800, [0.0] * 8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 100 == 0).collect()
    vectors = {k: np.floor(1024 * np.array(v, np.float32).astype(float)) for k, v in rows if v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (k for k in vectors if k % 100 == 0):
        ranked = sorted((-int(vectors[q] @ vectors[k]), k) for k in vectors if k != q)[:10]
        want |= {(q, n + 1, k, -s) for n, (s, k) in enumerate(ranked)}
    assert {tuple(r) for r in got} == want


def test_top_k_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few, F.col("id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.top_k(few.limit(0), F.col("id") % 100 == 0).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site &amp; menu</header><nav><ul><li>Home<li>News</ul></nav>
<article><h1>A&nbsp;title</h1><p>One <b>bo</b>ld<br>line &lt;x&gt;<div class="ad-box">Buy</div><p>Two<aside>See also</aside></article>
<section id="comments"><article>Nice</article></section><form>Mail <input></form><div class="cookie-notice">We</div><footer>&copy; us</footer>"""


def test_marked_html():
    assert htmltext.main_text(htmltext.lines_of(PAGE), []) == "A title One bold line <x> Two"
    assert htmltext.main_text(htmltext.lines_of(""), []) == "" and htmltext.lines_of("<p>a<p title='x>b") != []


def test_differencing_deletes_what_near_pages_share(spark):
    page = lambda body: f"<div>Top bar</div><div>{body}</div><div>All rights reserved</div>"
    rows = [(1, "http://a.b/x/1", page("First story here")), (2, "http://a.b/x/2", page("Second story there")), (3, "http://c.d/1", "<p>Alone</p>"), (4, None, None), (5, "http://a.b/x/1", page("First story here"))]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "First story here", 2: "Second story there", 3: "Alone", 4: "", 5: "First story here"}


def test_differencing_decides_outside_of_articles(spark):
    page = lambda k: f"<div>Top bar</div><div>Story {k}, told at some length here</div><article>Teaser</article><div>All rights reserved</div>"
    pages = spark.createDataFrame([(k, f"http://a.b/x/{k}", page(k)) for k in (1, 2)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in htmltext.extract(pages).collect()} == {k: f"Story {k}, told at some length here Teaser" for k in (1, 2)}


def html_texts(spark, rows):
    return {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copies_at_adjacent_urls_do_not_hide_the_template(spark):
    page = lambda body: f"<div>Top bar of the site</div><div>{body}</div><div>All rights reserved</div>"
    story = "A story that was syndicated far and wide, long enough to be most of the page by far, and told to its end. " * 3
    copies = [(k, f"http://a.b/x/{100 + k}", page(story)) for k in range(12)]
    near = [(k, f"http://a.b/x/{100 + k}", page(f"{story}</div><div>{k}")) for k in range(20, 40)]
    got = html_texts(spark, [*copies, *near, (50, "http://a.b/x/099", page("Before")), (51, "http://a.b/x/190", page("After"))])
    assert got == {k: story.strip() for k in range(12)} | {k: f"{story}{k}" for k in range(20, 40)} | {50: "Before", 51: "After"}


def test_short_articles_lose_a_long_template(spark):
    page = lambda k: f"<div>{'The same words on each page of this site. ' * 5}</div><div>News {k}</div><div>All rights reserved</div>"
    assert html_texts(spark, [(k, f"http://a.b/x/{k}", page(k)) for k in range(30)]) == {k: f"News {k}" for k in range(30)}


def test_results_do_not_change_with_partitions(spark):
    rnd = random.Random(5)
    body = lambda: "".join(f"<p>{rnd.choice('abcd') * rnd.randrange(1, 30)}</p>" for _ in range(rnd.randrange(6)))
    rows = [(k, f"http://{rnd.choice('ab')}.c/{rnd.randrange(99)}", f"<p>Top of site</p>{body()}") for k in range(700)]
    found = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(html_texts(spark, rows))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and len(found[0]) == 700


def test_common_subsequence_is_longest():
    rnd = random.Random(9)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert len(htmltext.common(a, b)) == table[-1][-1]


def test_empty_tables(empty, spark):
    path = P.path("word_bpe_49k.json")
    assert quality.ledger(empty).count() == quality.filter_documents(empty).count() == sharding.assign(empty).count() == 0
    assert linededup.kept_texts(empty).count() == simjoin.components(empty).count() == simjoin.first_of_each(empty).count() == 0
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == bpe.encode(empty, path, bpe.build_lexicon(empty, path)).count() == 0
    assert tokencount.token_counts(empty, P.path("piece_bpe_32k.model")).count() == 0
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "a line that is shared\nx"), (1, "a line that is shared\ny"), (1, "a line that is shared\ny"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_dropped"], r["text"]) for r in linededup.kept_texts(docs).collect())
    assert got == {(None, 1, "x"): 1, (1, 0, "a line that is shared\ny"): 2, (None, 0, None): 1}
    assert sorted(str(r["component_id"]) for r in simjoin.components(docs).collect()) == ["1", "1", "None", "None"]
    assert sharding.assign(docs).count() == quality.ledger(docs).count() == 4


def test_documents_without_any_label_are_kept(spark):
    rows = [(1, "words of some language"), (2, "12 34 !"), (3, None), (4, "漢字")]
    unlabelled = spark.createDataFrame([(k, t, None, "s", 1) for k, t in rows], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, unlabelled, "").collect()) == [1, 4]


def test_line_dedup_sql(spark, sf_dir):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op3_line_dedup(spark, sf_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()}
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
        want = {r[0]: r[1:] for r in con.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({queries.ORACLE['op3_line_dedup']})").fetchall()}
    assert got == want


def test_pipeline_is_its_stages_by_brute_force(spark, docs, sf_dir):
    """Each stage on what the last one kept: the language told, no rule failed, lines deduplicated, one of each component, all packed."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "line_dedup", "near_duplicates", "packing"]
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in rows.collect()}
        out = stage(spark, rows, sf_dir)
        assert out.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language_id":
            assert after == {k: t for k, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "line_dedup":
            assert after == {k: x[2] for k, x in brute_lines(before.items()).items()}
        elif name == "near_duplicates":
            assert set(after) == {c for _, c in brute_components(before.items()).values()} and all(before[k] == t for k, t in after.items())
        rows = spark.createDataFrame(out.collect(), docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir)
    assert pieces.select("doc_id").distinct().count() == rows.count()


def test_registered_digests(spark, sf_dir):
    r = queries.op9_bpe(spark, sf_dir).orderBy("doc_id").first()
    text = base.table(spark, sf_dir, "documents").filter(F.col("doc_id") == r["doc_id"]).first()["text"]
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids
    assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
