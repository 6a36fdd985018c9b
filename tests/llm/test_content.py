"""Language, extraction, reputation, leaks and the pipeline on small fixtures."""

from __future__ import annotations

import math
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import decontam, html_extract, langid, oracles, queries, url_filter
from tests.llm.test_duplicates import jaccard_groups

SF = "/root/testdata/sf0.001"


def brute_phrases(text, sample):
    n = 0
    for i in range(0, len(text), langid.BLOCK):
        block, j = text[i : i + langid.BLOCK], 0
        while j < len(block):
            k = 1
            while j + k <= len(block) and any(block[j : j + k] in part for part in sample.split("\n")):
                k += 1
            n, j = n + 1, j + max(1, k - 1)
    return n


def test_phrases_match_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        sample = {x: "".join(rng.choice("abc \n") for _ in range(rng.randrange(1, 60))).strip() or "a" for x in "xyz"}
        own = langid.Parser(sample)
        sparse = langid.Parser(sample)
        sparse.tables = [langid.DoubleArray(langid.suffix_automaton(sample[x], {c: i + 2 for i, c in enumerate(sorted(set("".join(sample.values())) - {"\n"}))}), sparse.width) for x in "xyz"]
        texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 2500))) for _ in range(3)]
        got = own.bits(texts) / own.weights
        assert (own.bits(texts) == sparse.bits(texts)).all()
        for i, text in enumerate(texts):
            for j, lang in enumerate(own.languages):
                assert round(got[i, j]) == brute_phrases(text, sample[lang])


def test_whole_prediction_matches_brute_force(spark):
    rng = random.Random(12)
    texts = {"en": "the cat sat on the mat and the dog ran to a house", "de": "der hund und die katze sind im haus auf der matte", "fr": "le chat et le chien dans la maison sur un tapis"}
    rows = [(i, " ".join(rng.choice(t.split()) for _ in range(rng.randrange(1, 60))) + rng.choice(["", " 12", "!"]), x) for i in range(120) for x, t in [rng.choice(list(texts.items()))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    sample = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    learned = {(x, t) for i, t, x in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    for lang, part in sample.items():
        assert set(part.strip("\n").split("\n")) <= {langid.letters_of(t) for x, t in learned if x == lang}
    for doc_id, text, _ in rows:
        bits = {x: brute_phrases(langid.letters_of(text), s) * math.log2(len(s) + 1) for x, s in sample.items()}
        least = min(bits.values())
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
        assert got[doc_id].lang_pred == min(x for x, b in bits.items() if b <= least + 1e-9)
        assert abs(got[doc_id].score - 1 / sum(math.exp(-langid.SHARP * (b / least - 1)) for b in bits.values())) < 1e-9


def test_letters_and_marks():
    assert [langid.letters_of(t) for t in ("½ ²", "Ⅷ", "①②", "\u0301 1", "x²y", None)] == ["", "", "", "", "x y", ""]
    assert langid.letters_of("हिन्दी भाषा") == "हिन्दी भाषा" and langid.letters_of("Äö_1b 中文。") == "äö b 中文"


def test_large_alphabets_stay_small():
    rng = random.Random(2)
    own = langid.Parser({x: "".join(chr(a + rng.randrange(3000)) for _ in range(40_000)) for x, a in (("x", 0x4E00), ("y", 0xAC00))})
    assert all(isinstance(t, langid.DoubleArray) for t in own.tables)
    assert sum(v.nbytes for t in own.tables for v in (t.base, t.owner, t.to, t.start)) < 50 << 20


def test_a_long_labelled_text_is_cut(spark):
    docs = spark.createDataFrame([(1, "ab cd " * 100_000, "en"), (2, "ef", "de"), (3, None, "en")], "doc_id long, text string, lang string")
    assert {x: len(t) for x, t in langid.fit(docs, chars=1000).items()} == {"en": 1000, "de": 3}


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = langid.identify(docs.select("doc_id", "text", "lang", F.lit("x").alias("score"))).join(docs.select("doc_id", "lang"), "doc_id")
    row = made.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert row.n > 200 and row.a > 0.97


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "123 !?", "en"), (3, "the cat sat on the mat and the dog", "en"), (4, "der hund und die katze sind im haus", None), (None, "the cat", "en"), (6, "the the the", "en"), (7, "der die das und", "de"), (8, "der hund und das haus", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows) and got[1].lang_pred == got[2].lang_pred == "und" and got[1].score == 0
    assert {r.lang_pred for r in got.values()} <= {"und", "en", "de"} and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.identify(docs.where("false")).count() == 0


ARTICLE = "A first sentence, which is of some length. And a second one, with commas, follows it. " * 4
PAGES = [
    (f"<html><head><title>T</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><main><h1>Head &amp; line</h1><p>{ARTICLE}<p>Second &eacute; <b>bold</b>,\n text.<br>More.</main>"
     f"<section class='comments'><p>{ARTICLE}</p></section><aside><p>{ARTICLE}</p></aside><form><p>Sign up, please.</p></form><footer>&copy; 2024</footer></body></html>",
     f"Head & line\n{ARTICLE.strip()}\nSecond é bold, text. More."),
    (f"<div id=cookie-notice><p>We use cookies, yes.</p></div><div class='post'><h2>Title</h2><p>{ARTICLE}</p><script>var x = '<p>no</p>';</script><!-- <p>no</p> --><ul><li>point one, said so.</li></ul></div><div class='ad'>{ARTICLE}</div>",
     f"Title\n{ARTICLE.strip()}\npoint one, said so."),
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain text only", "plain text only"), ("<p>open <b>tags", "open tags"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def test_extract_table(spark):
    rows = [(i, f"u{i}", h, 1) for i, (h, _) in enumerate(PAGES)] + [(None, None, None, None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert {r.page_id: (r.text, r.n_chars) for r in got} == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)} | {None: ("", 0)}


def test_extraction_over_a_whole_table(spark):
    """The pages' articles are documents: all their lines come back, under the heading."""
    number = F.regexp_extract("url", "/([0-9]+)(?:[./?#]|$)", 1).cast("long")
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("doc_id", number)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text").alias("original"))
    got = html_extract.extract(pages).join(pages.select("page_id", "doc_id"), "page_id").join(docs, "doc_id").collect()
    assert got
    for row in got:
        lines = [" ".join(x.split()) for x in row.original.split("\n")]
        assert row.text.split("\n")[1:] == [x for x in lines if x]


URLS = [
    (1, "https://WWW.Example.com/en/1?x=1", "www.example.com", "/en/1", "www.example.com/en/", "allow"), (2, "http://a.example.com/en/#f", "a.example.com", "/en/", "example.com/en/", "block"),
    (3, "https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), (4, "ftp://x.net/es/a", "x.net", "/es/a", "net/es/", "block"), (5, "https://net/fr/", "net", "/fr/", "net/fr/", "block"),
    (6, "https://x.net", "x.net", "", None, "allow"), (7, None, "", "", None, "allow"), (8, "no scheme", "", "", None, "allow"), (9, "https://bad.org?q=/en/", "bad.org", "", None, "block"),
    (None, "https://bad.org/1", "bad.org", "/1", None, "block"),
]


def test_rules_and_reputation(spark):
    many = [(100 + i, "https://bad.org/p", 1000 + i) for i in range(40)] + [(200 + i, f"https://good{i % 5}.org/p", 2000 + i) for i in range(100)]
    rows = [(p, u, None) for p, u, *_ in URLS] + many
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, outcome_key long, host string")
    outcomes = spark.createDataFrame([(k, k < 2000) for _, _, k in many] + [(None, True), (1000, None)], "outcome_key long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, outcomes, queries.RULES).collect()}
    assert len(got) == len(rows)
    for page_id, _, *expected in URLS:
        assert got[page_id] == tuple(expected)
    assert got[200][3] == "allow"
    assert url_filter.judge(pages.where("false"), outcomes, queries.RULES).count() == 0


def test_reputation_shrinks(spark):
    hosts = spark.createDataFrame([("a.x.com", 1.0, 1.0), ("b.x.com", 200.0, 2.0), ("c.y.com", 100.0, 90.0), ("new.y.com", 0.0, 0.0), ("d.co.uk", 5.0, 1.0)], "host string, n double, bad double")
    got = {r.host: r for r in url_filter.host_reputation(hosts).collect()}
    assert got["a.x.com"].mean < 1 and not got["a.x.com"].blocked and got["c.y.com"].blocked
    assert got["b.x.com"].mean < got["new.y.com"].mean


def test_shares_below_by_integration():
    """The posterior's share below a point against the midpoint rule over its density."""
    at = (np.arange(4_000_000) + 0.5) / 4_000_000
    for a, b in ((1.5, 2.5), (3.0, 40.0), (90.0, 12.0), (600.0, 580.0), (2.0, 2000.0)):
        density = np.exp((a - 1) * np.log(at) + (b - 1) * np.log1p(-at) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b))
        for x in (0.1, 0.5, 0.85):
            assert url_filter._below(np.array([a]), np.array([b]), x)[0] == pytest.approx(density[at < x].mean() * (at < x).mean() if (at < x).any() else 0, abs=1e-6)
    assert np.isfinite(url_filter._below(np.array([4e6, 1e-3]), np.array([4.001e6, 1e3]), 0.5)).all()


def test_hosts_with_ports_users_and_addresses(spark):
    cases = [
        ("a.b.gov.uk", "b.gov.uk", "gov.uk"), ("a.b.org:8080", "b.org", "org"), ("me:pw@x.com.cn:1", "x.com.cn", "com.cn"), ("10.0.0.1:80", "10.0.0.1", "10.0.0.1"),
        ("[::1]", "[::1]", "[::1]"), ("", "", ""), ("local", "local", "local"), ("co.uk", "co.uk", "co.uk"),
    ]
    hosts = spark.createDataFrame([(h,) for h, *_ in cases], "host string")
    got = {r.host: (r.domain, r.suffix) for r in hosts.select("host", url_filter.domain_of(F.col("host")).alias("domain"), url_filter.suffix_of(F.col("host")).alias("suffix")).collect()}
    assert got == {h: tuple(rest) for h, *rest in cases}
    own = hosts.limit(0).select(url_filter.domain_of(F.col("host"), ["b.c"]))
    assert own.count() == 0


def test_url_sql_agrees(spark):
    duck = duckdb.connect()
    for name in ("pages", "labels"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    theirs = duck.execute(f"SELECT page_id, host, path, rule, verdict FROM ({oracles.URL_FILTER}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in queries.op9_url_filter(spark, SF).orderBy("page_id").collect()] == theirs


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(-1, 5, rng.integers(1, 40)).astype(np.int32), rng.integers(-1, 5, rng.integers(1, 60)).astype(np.int32)
        a = np.abs(a)
        assert decontam.common_length(a, b) == brute_lcs(a.tolist(), b.tolist())


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 8))) for _ in range(3000)] + ["the", "of", "and"] * 400
    items = [(i, prose(rng, n, words)) for i, n in enumerate((15, 25, 40, 59, 90))] + [(5, None), (None, "x y z"), (6, "")]
    docs, expected = [], set()
    for i in range(300):
        text = prose(rng, rng.randrange(20, 400), words)
        if i % 10 == 0:
            k = i // 10 % 5
            part = items[k][1].split()
            if i % 20:
                part[rng.randrange(len(part))] = "changed"
            parts = text.split()
            at = rng.randrange(len(parts))
            text = " ".join([*parts[:at], *part, *parts[at:]]).capitalize()
            expected.add((i, k))
        docs.append((i, text, 0.5))
    docs += [(1000, None, 0.1), (1001, "", 0.1), (None, "short", 0.1), (1002, items[0][1] + " " + prose(rng, 70_000, words) + " " + items[2][1], 0.1)]
    expected |= {(1002, 0), (1002, 2)}
    frame = spark.createDataFrame(docs, "doc_id long, text string, cosine double").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(frame, bench).collect()} == expected
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(frame, bench, block_items=2).collect()} == expected
    assert decontam.find_leaks(frame.where("false"), bench).count() == 0 and decontam.find_leaks(frame, bench.where("false")).count() == 0


def test_copies_far_from_their_item_in_the_latent_space_are_found(spark):
    rng = random.Random(8)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3000").orderBy("doc_id").collect()]
    items = {r.item_id: r.text for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()}
    docs, expected = [], set()
    for k, item in items.items():
        words = item.split()
        for share in (1, 0.8, 0.65):
            answer = len(words) - max(3, len(words) // 4) if share < 0.8 else len(words)  # a paraphrase keeps its answer
            away = set(rng.sample(range(answer), int((1 - share) * len(words) + 1e-9)))
            part = [f"zz{i}" if i in away else w for i, w in enumerate(words)]
            parts = rng.choice(texts).split()
            at = rng.randrange(len(parts) + 1)
            expected.add((len(docs), k))
            docs.append((len(docs), " ".join([*parts[:at], *part, *parts[at:]])))
    frame = spark.createDataFrame(docs + [(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    got, whole = ({(r.doc_id, r.item_id) for r in decontam.find_leaks(frame, bench, **how).collect()} for how in ({}, {"cosine": None}))
    assert len(expected) == 3 * len(items)
    assert sorted(expected - whole) == []  # the scan of all words against all items loses none
    verbatim = {e for e in expected if e[0] % 3 == 0}
    assert got <= whole and len(got) >= 0.98 * len(whole) and len(verbatim & got) >= 0.99 * len(verbatim)


def test_singular_vectors_match_a_full_decomposition(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.6, 64) if x < 40)) for i in range(200)]
    items = decontam.Items.of([(0, " ".join(f"w{i}" for i in range(1, 40)), None)])
    coded = decontam.code_texts(spark.createDataFrame(rows, "doc_id long, text string"), items.vocabulary)
    idf = decontam.inverse_frequencies(coded, items)
    vectors, scale = decontam.singular_vectors(coded, idf, rank=5)
    matrix = np.zeros((200, len(idf)))
    for row in coded.collect():
        np.add.at(matrix[row.doc_id], np.frombuffer(row.codes, "<i4"), 1)
    _, exact, basis = np.linalg.svd(matrix * idf, full_matrices=False)
    assert np.allclose(scale, exact[:5], rtol=1e-3)
    assert np.allclose(np.abs((vectors.T @ basis[:5].T).diagonal()), 1, atol=1e-2)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90_001, "12345 !!", "en", "s", 8), (90_002, None, None, None, None)], docs.schema)
    now = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, SF)
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), docs.schema)
        ids = {r.doc_id for r in now.collect()}
        assert ids <= {r.doc_id for r in before.collect()}
        if name == "language":
            assert not ids & {90_001, 90_002} and len(ids) > 190
        if name == "near duplicates":
            exact = jaccard_groups({r.doc_id: r.text for r in before.collect()})
            assert {exact[d] for d in ids} == set(exact.values()) and len(ids) <= 1.01 * len(set(exact.values()))
    made = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert made.where("not exact").count() == 0 and made.count() == now.count() > 100


def test_pipeline_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "Some words of a text.", None), (2, "12 !!", None), (3, None, None), (4, "Noch ein Text.", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()) == [1, 4]


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


LAYOUTS = [
    ("<body class='page with-sidebar'><div class='wrap has-menu'><article class='post sidebar-right'><header class='entry-header'><h1>Head</h1></header><p>{0}</p></article><div id='sidebar'><p>{0}</p></div></div></body>", "Head\n{1}"),
    ("<main class='content no-footer'><p>{0}</p><table><tr><td>cell one</td><td>cell two</td></tr></table><blockquote>quoted words.</blockquote></main><div class='newsletter-signup'><p>{0}</p></div>", "{1}\ncell one\ncell two\nquoted words."),
    ("<div class='article'><p>{0}</p><div class='related-posts'><p>{0}</p></div><div id='disqus_thread'>{0}</div></div><div role='navigation'>{0}</div>", "{1}"),
]


@pytest.mark.parametrize(("html", "text"), LAYOUTS)
def test_layout_words_do_not_hide_the_article(html, text):
    assert html_extract.main_text(html.format(ARTICLE)) == text.format("", ARTICLE.strip())


def test_smoothing_matches_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        tree = html_extract.PathTree()
        for i in range(rng.randrange(1, 40)):
            tree.child(rng.randrange(i + 1), "div", str(i), 1.0)
        above = lambda p: [p] if p == 0 else [p, *above(tree.parent[p])]
        steps = lambda p, q: len(set(above(p)) ^ set(above(q)))
        values = [rng.random() for _ in tree.parent]
        got = tree.smoothed(values, 0.3)
        for p, s in enumerate(got):
            assert np.isclose(s, sum(v * 0.3 ** steps(p, q) for q, v in enumerate(values)))


INSIDE = [
    ("<p class='ad-hoc'>An ad-hoc rule</p>", "An ad-hoc rule"), ("<div class='widget-table'>cells</div>", "cells"), ("<math><mi>x</mi></math>", "x"), ("<fieldset>set apart</fieldset>", "set apart"),
    ("<ul><li><a href='/a'>one link</a></li><li><a href='/b'>two link</a></li></ul>", None), ("<div class='ad-slot'><p>Buy it, now. Buy it!</p></div>", None), ("<div class='post-footer'>Filed under: this, that.</div>", None),
    ("<div><div><ul><li>deep point</li></ul></div></div>", "deep point"), ("<h2><a href='/c'>Linked heading</a></h2>", "Linked heading"), ("<p>with <span class='share'>Share it</span> a gap</p>", "with a gap"),
]


@pytest.mark.parametrize(("html", "text"), INSIDE)
def test_the_ratio_decides_inside_the_article(html, text):
    got = html_extract.main_text(f"<body><nav><a href='/'>Home</a></nav><article><p>{ARTICLE}</p>{html}<p>{ARTICLE}</p></article></body>")
    assert got.split("\n") == [x for x in (ARTICLE.strip(), text, ARTICLE.strip()) if x]


@pytest.mark.parametrize("html", ["<div>text, a.", "<p class='{0}'>Some text, a.", "<div></span>text <b class=ad>x", "<td><li>text</p>"])
def test_time_grows_in_proportion(html):
    """Deep nesting and very many paths; the square of the pages' ratio would be 64."""
    page = lambda n: "".join(html.replace("{0}", "".join(chr(97 + i // 26**k % 26) for k in range(4))) for i in range(n))
    seconds = []
    for n in (2500, 20_000):
        began = time.process_time()
        assert html_extract.main_text(page(n))
        seconds.append(time.process_time() - began)
    assert seconds[1] < 24 * seconds[0]


def test_pages_of_boilerplate_only_are_empty():
    assert html_extract.main_text(f"<div class='ad'>{ARTICLE}</div><nav>{ARTICLE}</nav>") == ""


COMMENT_BODY = "".join(f"<div class=c><span class=author>Reader {i}</span> <time>1 May</time><p>I think, as a reader, that this is so, and that much more could be said, number {i}.</p></div>" for i in range(3))
STORY = "".join(f"<p>Paragraph {i} of the story, which goes on for a while, tells what happened, and says why it did.</p>" for i in range(6))


@pytest.mark.parametrize("name", ["responses", "thread-reply", "feedback", "user-posts", "opinions"])
def test_comments_by_their_form(name):
    page = f"<html><body><article><h1>Title of it</h1><p class=byline>By <span class=author>A. Writer</span> <time>2 May</time></p>{STORY}<section class='{name}'>{COMMENT_BODY}</section></article></body></html>"
    text = html_extract.main_text(page)
    assert "Reader" not in text and "I think" not in text
    assert text.count("Paragraph") == 6 and "Title of it" in text


@pytest.mark.parametrize("name", ["form", "share nav", "sidebar", "newsletter", "banner"])
def test_a_content_element_is_kept_whatever_its_name(name):
    assert html_extract.main_text(f"<body><nav>Home</nav><article class='{name}'>{STORY}</article></body>").count("Paragraph") == 6


def test_comments_in_articles_of_their_own():
    text = html_extract.main_text(f"<body><article>{STORY}</article>" + "".join(f"<article class=comment><p>Thanks, good story, number {i}.</p></article>" for i in range(3)) + "</body>")
    assert text.count("Paragraph") == 6 and "Thanks" not in text


def test_a_page_of_signed_sections_is_kept():
    sections = "".join(f"<section><h2>Part {i}</h2><time>3 May</time><p>Paragraph {i} of the story, which goes on for a while, and says why.</p></section>" for i in range(4))
    assert html_extract.main_text(f"<body><article>{sections}</article></body>").count("Paragraph") == 4


def test_open_named_inline_elements_take_linear_time():
    began = time.perf_counter()
    html_extract.main_text("<span class=ad>" * 20_000 + "<hr>x" * 20_000)
    assert time.perf_counter() - began < 3


def test_an_answer_may_be_a_number(spark):
    words = " ".join(f"word{i}" for i in range(30))
    items = spark.createDataFrame([(1, words, 17)], "item_id long, text string, answer int")
    docs = spark.createDataFrame([(5, f"before {words} 17 behind"), (6, "other words")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontam.find_leaks(docs, items).collect()] == [5]
