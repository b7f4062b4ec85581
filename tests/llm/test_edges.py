"""Corpus operators on their edges: hot groups, odd characters, null and repeated ids, clashing names, and brute force where SQL cannot say it."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, P, brute_components, texts

import corpus_pipeline
from slopeworks.llm import base, bpe, htmltext, langid, packing, quality, queries, simjoin, tokencount, topk


@pytest.fixture(scope="module")
def docs(spark):
    base.prepare(spark)
    return spark.createDataFrame([(k, t, ("en", "de")[k % 2], "s", len(t or "")) for k, t in enumerate(texts())], DOCS).repartition(3).cache()


# --- similarity join


@pytest.mark.parametrize(("broadcast", "hot", "gathered"), [(1_000_000, 10_000, 2_000_000), (-1, 10_000, 2_000_000), (1_000_000, 3, 300), (1_000_000, 6, 2_000_000)])
def test_hot_lists_in_chunks_lose_no_link(spark, monkeypatch, broadcast, hot, gathered):
    """Near copies of one text, some linked and some below the threshold, in lists of many chunks, with and without broadcasts, and held back by tasks."""
    monkeypatch.setattr(simjoin, "CHUNK", 16)
    monkeypatch.setattr(simjoin, "HOT", hot)
    monkeypatch.setattr(simjoin, "GATHERED", gathered)
    monkeypatch.setattr(simjoin, "BROADCAST", broadcast)
    rnd = random.Random(8)
    words = [str(rnd.randrange(10**6)) for _ in range(150)]
    rows = []
    for k in range(120):
        w = list(words)
        for _ in range(rnd.choice([1, 2, 5, 9])):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in simjoin.components(docs).collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) > 2


def test_a_subset_of_very_many_sets_stays_out_of_its_bucket(spark):
    """200,000 sets with one subset: one of each task's goes to the bucket, and a list of mostly one component has as many parts as chunks."""
    rnd = np.random.Generator(np.random.PCG64(1))
    hashes = np.concatenate((np.full(200_000, 77, np.uint64), rnd.integers(0, 2**63, 50_000, dtype=np.uint64)))
    nick, probe = rnd.integers(0, 2**62, len(hashes)), np.zeros(len(hashes), bool)
    probe[5] = True
    go, stands, lists = simjoin._held_back(hashes, nick, probe, simjoin.HOT)
    assert go.sum() == 50_001 and stands.sum() == 1 and probe[stands].all() and [(h, len(m)) for h, m in lists] == [(77, len(set(nick[:200_000].tolist())))]
    rows = spark.range(200_000).selectExpr("1L as run", "id as nick", "if(id % 40000 = 7, id, 0L) as root")
    parts = simjoin._open_parts(rows)
    sizes = parts.groupBy("part").count().collect()
    assert len(sizes) <= 51 and max(r["count"] for r in sizes) < 2 * simjoin.CHUNK and parts.count() < 201_000
    assert simjoin._open_parts(rows.withColumn("root", F.lit(0).cast("long"))).count() == 0


def test_open_parts_bring_all_pairs_of_different_components_together(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "CHUNK", 3)
    rnd = random.Random(2)
    rows = [(run, k + 100 * run, rnd.choice([0, 0, 0, 1, 2, k]) + 100 * run) for run in range(5) for k in range(20)] + [(9, 900 + k, 900) for k in range(7)]
    got = collections.defaultdict(list)
    for r in simjoin._open_parts(spark.createDataFrame(rows, "run long, nick long, root long")).collect():
        got[r["run"], r["part"]].append(r["nick"])
    met = {(min(a, b), max(a, b)) for found in got.values() for a, b in itertools.combinations(found, 2)}
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[2] != b[2]}
    assert want <= met and not any(run == 9 for run, _ in got)


def test_sets_of_few_segments_meet_in_their_neighbourhoods(monkeypatch):
    """With so few segments that no set fills more than it may differ in, subsets less one shingle find what subsets do not."""
    monkeypatch.setattr(simjoin, "SEGMENTS", np.where(simjoin.SEGMENTS > 0, np.maximum(1, simjoin.TOPS // 6), 0).astype(np.uint64))
    rnd, linked = np.random.Generator(np.random.PCG64(3)), 0
    for size in (40, 60, 100, 200):
        for _ in range(30):
            whole = rnd.integers(0, 2**64, size, dtype=np.uint64)
            sets = [np.unique(np.concatenate((whole[rnd.random(size) > 0.06], rnd.integers(0, 2**64, int(size * 0.05), dtype=np.uint64)))) for _ in range(6)]
            key, first = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets])))
            hashes, row, probe = simjoin.signatures(key, first)
            a, b, runs = simjoin.candidates_of(row.astype(np.int64), hashes, probe)
            found = set(zip(a.tolist(), b.tolist())) | {p for m in runs for p in itertools.combinations(m.tolist(), 2)}
            for i, j in itertools.combinations(range(6), 2):
                if simjoin.linked(sets[i], sets[j]):
                    linked += 1
                    assert (i, j) in found
    assert linked > 100


# --- word-level BPE


def library_and_coder():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    return Tokenizer.from_file(path), bpe.Coder(path, None)


def differing(ref, coder, found):
    ids, decoded = coder.of(found)
    want = ref.encode_batch(found, add_special_tokens=False)
    return [t for t, w, i, d in zip(found, want, ids, decoded) if np.frombuffer(i, "<i4").tolist() != w.ids or d != ref.decode(w.ids, skip_special_tokens=False)]


def test_every_code_point_is_split_as_the_library_does():
    ref, coder = library_and_coder()
    points = [k for k in (*range(0x32400), *range(0xE0000, 0xE0200), *range(0x110000 - 256, 0x110000)) if not 0xD800 <= k < 0xE000]
    for at in range(0, len(points), 20_000):
        assert differing(ref, coder, [f"a{chr(k)}B {chr(k)}" for k in points[at : at + 20_000]]) == []


def test_fuzzed_texts_have_the_library_ids():
    ref, coder = library_and_coder()
    rnd = random.Random(1)
    odd = "՘֋࢏౜ᲉꟋ\U00010d50İΣ\x1c\x1f\x85\xa0 ​́̈가\xdfﬁ\U0001f600‍٠　aeEO's'LL 12 \t\n<|endoftext|>.,!"
    assert differing(ref, coder, ["".join(rnd.choice(odd) for _ in range(rnd.randrange(1, 30))) for _ in range(10_000)]) == []


# --- language ID


def brute_profile(all_texts):
    counts, letters = collections.Counter(), collections.Counter(c for t in all_texts for c in folded(t) if c.isalpha())
    order = {c: k for k, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], ord(x[0]))), 2)}
    for t in all_texts:
        counts += grams(t)
    return order, counts


def folded(text):
    return "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c for c in text)


def grams(text):
    found = collections.Counter()
    for word in "".join(c if c.isalpha() else " " for c in folded(text)).split():
        found.update(word)
        marked = f" {word} "
        found.update(marked[k : k + 2] for k in range(len(marked) - 1))
        found.update(marked[k : k + 3] for k in range(len(marked) - 2))
    return found


def test_language_is_the_least_out_of_place(spark):
    """Against dictionaries of strings: profiles, ranks and distances, on texts whose words come from each language's own letters."""
    rnd = random.Random(6)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "αβγδεζηθ"}
    text = lambda lang: " ".join("".join(rnd.choice(alphabets[lang]) for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 60)))
    rows = [(k, text(lang), lang) for k, lang in enumerate(list(alphabets) * 12)] + [(100, "Abc ABC 12", None), (101, "zzz qqq", None), (102, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn(docs, F.lit(True))
    order, _ = brute_profile([t for _, t, lang in rows if lang])
    code = lambda g: tuple(1 if c == " " else order.get(c, len(order) + 2) for c in g)
    number = lambda g: sum(x << 21 * k for k, x in enumerate(reversed(code(g))))
    ranked = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))][: langid.RANKS]
    known = {lang: {g: k for k, g in enumerate(ranked(sum((grams(t) for _, t, x in rows if x == lang), collections.Counter())))} for lang in alphabets}
    for r in langid.predict(docs, profiles).collect():
        mine = ranked(grams(r["text"]))
        distance = {lang: sum(abs(places[g] - k) if g in places else langid.RANKS for k, g in enumerate(mine)) for lang, places in known.items()}
        best = min(distance, key=lambda x: (distance[x], x)) if mine else "und"
        assert r["lang_pred"] == best and abs(r["lang_score"] - (1 - distance[best] / (langid.RANKS * len(mine)) if mine else 0)) < 1e-12, r["doc_id"]


def test_two_languages_of_many_letters_are_told_apart(spark):
    rnd = random.Random(7)
    alphabets = {"x": [chr(0x4E00 + k) for k in range(400)], "y": [chr(0x7000 + k) for k in range(400)]}
    rows = [(k, " ".join("".join(rnd.choice(alphabets["xy"[k % 2]]) for _ in range(4)) for _ in range(60)), "xy"[k % 2]) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn(docs.filter("doc_id < 40"), F.lit(True))
    assert all(r["lang_pred"] == r["lang"] for r in langid.predict(docs.filter("doc_id >= 40"), profiles).collect())


def test_a_sample_is_bounded_and_of_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 20)
    labelled = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("lang"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labelled = labelled.unionByName(labelled.filter("id = 7").withColumn("text", F.lit("a copy of the id")))
    got = collections.Counter(r["lang"] for r in langid._sample(labelled).collect())
    assert got == {"rare": 20, "often": 20}
    want = {r["text"] for r in labelled.filter("lang = 'rare'").orderBy(F.xxhash64("id"), "id").limit(20).collect()}
    assert {r["text"] for r in langid._sample(labelled).filter("lang = 'rare'").collect()} == want


# --- HTML


def test_pages_by_brute_force(spark, sf_dir):
    """The registered query against a straightforward pairing of each host's distinct pages, and what differencing decides there."""
    pages = [tuple(r) for r in base.table(spark, sf_dir, "pages").select("page_id", "url", "html").collect()]
    hosts = collections.defaultdict(dict)
    for key, url, html in pages:
        host, _, path = (url or "").split("://", 1)[-1].partition("/")
        lines = tuple(x.text for x in htmltext.lines_of(html or ""))
        path = "/" + path.split("?")[0].split("#")[0]
        hosts[host.lower()][lines] = min(hosts[host.lower()].get(lines, (path, key)), (path, key))
    want = {}
    for key, url, html in pages:
        mine = htmltext.lines_of(html or "")
        own = tuple(x.text for x in mine)
        of_host = hosts[(url or "").split("://", 1)[-1].partition("/")[0].lower()]
        order = [x for x, _ in sorted(((x, at) for x, at in of_host.items() if x), key=lambda z: z[1])]
        at = order.index(own) if own else 0
        near = sorted((k for k in range(max(0, at - htmltext.REACH), min(len(order), at + htmltext.REACH + 1)) if k != at), key=lambda k: (abs(k - at), k))
        _, shared = htmltext.shared_lines(list(own), [len(t) for t in own], [list(order[k]) for k in near])
        if sum(len(own[k]) for k in shared) <= htmltext.COPY * sum(map(len, own)):  # others look farther
            kept, *counts = htmltext.kept_lines(mine, shared)
            want[key] = (" ".join(own[k] for k in kept), *counts)
    got = {r["page_id"]: (r["text"], r["n_shared"], r["n_both"], r["n_vetoed"], r["n_marked"]) for r in queries.op5_html_text(spark, sf_dir).collect()}
    assert len(got) == len(pages) and {k: got[k] for k in want} == want and len(want) > len(pages) / 2
    assert sum(x[2] for x in got.values()) > 0
    # a text changes by differencing where n_shared says so, and nowhere else
    alone = {key: " ".join(x.text for x in htmltext.lines_of(html or "") if not x.aside) for key, _, html in pages}
    assert all((got[k][0] != text) == (got[k][1] > 0) for k, text in alone.items())


def test_credit_goes_to_what_changes_a_page(spark):
    """Lines that nothing marks go by differencing alone; those that markup deletes as well are counted apart."""
    page = lambda k: f"<div>Top of the site</div><p>Story {k}, told at some length</p><footer>All rights reserved</footer><article>Shared words</article><nav>Menu {k}</nav>"
    rows = htmltext.extract(spark.createDataFrame([(k, f"http://a.b/{k}", page(k)) for k in range(3)], "page_id long, url string, html string")).collect()
    assert {(r["n_shared"], r["n_both"], r["n_vetoed"], r["n_marked"]) for r in rows} == {(1, 1, 1, 1)}
    assert {r["text"] for r in rows} == {f"Story {k}, told at some length Shared words" for k in range(3)}


# --- top-k


def test_scores_beyond_64_bits_are_the_nearest_that_fit(spark):
    rows = [(0, [3e38, 1.0]), (1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [1e12, 1e12]), (100, [1.0, 0.0])]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0).collect()}
    far = int(topk.FAR)
    assert got[0, 1] == 2**63 - 1 and got[0, 2] == -(2**63) and got[100, 3] == 1024 * 1024 * 10**12 and got[0, 100] == 2**63 - 1 and far < 2**63


def test_ids_that_are_no_numbers_take_no_part(spark):
    rows = spark.createDataFrame([("0", [1.0]), ("x", [9.0]), ("7", [2.0]), (None, [3.0])], "vec_id string, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(rows, F.col("id") % 100 == 0).collect()] == [(0, 1, 7, 1024 * 2048)]


def test_repeated_ids_share_the_work(spark, monkeypatch):
    """A third of all rows has one id; blocks and parts stay small, and the result is that of all rows."""
    monkeypatch.setattr(topk, "ANNULUS", 64)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rnd = np.random.Generator(np.random.PCG64(9))
    rows = [(100 if k % 3 == 0 else k, [float(x) for x in rnd.normal(size=4)]) for k in range(600)]
    vectors = [(k, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for k, v in rows]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") == 200).collect()
    query = next(v for k, v in vectors if k == 200)
    want = sorted((-int(query @ v), k) for k, v in vectors if k != 200)[:10]
    assert sorted((-r["score"], r["vec_id"]) for r in got) == want


def test_bounds_rule_out_far_clusters():
    rnd = np.random.Generator(np.random.PCG64(2))
    centres = rnd.normal(size=(40, 16)) * 4000
    x = np.rint(centres[np.arange(4000) % 40] + rnd.normal(size=(4000, 16)) * 20).astype(np.int64)
    index = topk.Index(x, len(x), float((x.astype(float) ** 2).sum(axis=1).max()))
    cell, own = index.cells(x)
    index.direct([(c, own[cell == c].min(), own[cell == c].max(), int((cell == c).sum())) for c in np.unique(cell)])
    scores = topk.products(x[:40], x)
    floor = np.sort(scores, axis=1)[:, -10]
    _, most = index.bounds(x[:40])
    searched = most >= floor[:, None]
    assert searched.mean() < 0.5
    for q in range(40):
        assert set(cell[scores[q] >= floor[q]]) <= set(index.cell[searched[q]])


# --- packing


def test_padding_is_below_a_sequence_for_each_group(docs):
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), group=1000).collect()
    used = collections.Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert 0 <= 1024 * len(used) - sum(used.values()) < 1024 * docs.rdd.getNumPartitions()


def test_sequences_are_balanced_by_cost():
    """Closer in cost than where documents go to the first sequence with room."""
    rnd = random.Random(4)
    lengths = [rnd.choice([rnd.randrange(1, 60), rnd.randrange(200, 700)]) for _ in range(400)]
    price = lambda n: packing.LINEAR * n + packing.QUADRATIC * n * n
    cost, used, first = collections.Counter(), collections.Counter(), []
    for _, _, size, seq, _ in packing.balance(lengths):
        cost[seq] += price(size)
        used[seq] += size
    for n in sorted(lengths, reverse=True):
        at = next((k for k, x in enumerate(first) if x[0] + n <= 1024), None)
        if at is None:
            at = len(first)
            first.append([0, 0.0])
        first[at][0] += n
        first[at][1] += price(n)
    spread = lambda x: np.std(x) / np.mean(x)
    assert spread([c for s, c in cost.items() if used[s] == 1024]) < spread([c for n, c in first if n > 900])
    assert sum(used.values()) == sum(lengths) and max(used.values()) <= 1024


# --- null and repeated ids, clashing names


ODD = [(None, "words of a text here"), (1, "words of a text here"), (1, "words of a text here"), (1, None), (None, None)]


def test_null_and_repeated_ids_keep_their_rows(spark):
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in ODD], DOCS)
    path = P.path("word_bpe_49k.json")
    count = lambda df: collections.Counter(r["doc_id"] for r in df.collect())
    want = {None: 2, 1: 3}
    assert count(langid.predict(docs, langid.learn(docs, F.lit(True)))) == want
    assert count(bpe.encode(docs, path, bpe.build_lexicon(docs, path))) == want
    assert count(tokencount.token_counts(docs, P.path("piece_bpe_32k.model"))) == want
    assert count(packing.pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")).filter("start = 0")) == want
    pages = spark.createDataFrame([(k, "http://a.b/c", t) for k, t in ODD], "page_id long, url string, html string")
    assert collections.Counter(r["page_id"] for r in htmltext.extract(pages).collect()) == want
    vectors = spark.createDataFrame([(None, [1.0]), (0, [1.0]), (0, [1.0]), (5, [2.0]), (5, [2.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in topk.top_k(vectors, F.col("id") % 100 == 0).collect()] == [(0, 5), (0, 5)]


def test_clashing_names_stay_as_they_are(spark, docs):
    names = ("lang_pred", "LANG_SCORE", "kept", "failed_bits", "kept_key", "kept_text", "id", "n", "one", "two", "n_shingles", "component_id", "line_key", "n_lines", "N_WORDS")
    odd = docs.withColumns({n: F.lit(f"mine {n}") for n in names})
    for stage in (langid_stage, quality.filter_documents, simjoin.first_of_each, *(lambda d, f=f: f(spark, d, "") for _, f in corpus_pipeline.STAGES[:-1])):
        out = stage(odd)
        assert out.columns[: len(odd.columns)] == odd.columns
        assert out.count() == out.filter(" and ".join(f"`{n}` = 'mine {n}'" for n in names)).count() > 0


def langid_stage(docs):
    return langid.predict(docs, langid.learn(docs, F.lit(True)))


def test_stages_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_a_label_column_that_holds_no_languages_is_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = lambda n: spark.createDataFrame([(k, "some words", f"l{k % n}") for k in range(20)], "doc_id long, text string, lang string")
    assert len(langid.learn(rows(3), F.lit(True)).langs) == 3
    with pytest.raises(ValueError, match="more than 3 labels"):
        langid.learn(rows(4), F.lit(True))
