"""Line frequency, toxicity, language and page text."""

import random

import numpy as np
import pyarrow as pa
import pytest

from paylens.llm import html_text, language, queries
from paylens.llm.hashing import blocks
from paylens.llm.html_text import common_subsequence, extract, page_lines, shared_lines
from paylens.llm.language import address_parts, declared_language, fit_text, identify
from paylens.llm.line_frequency import quality_rules
from paylens.llm.toxicity import Chain, fit_chain, predict
from pyspark.sql import functions as F
from tests.llm.helpers import clashing, documents, odd_rows, prose, words
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert differences(queries.queries()[name](spark, FOLDER), connect(FOLDER), queries.oracle_sql()[name]) == []


def brute_counts(text):
    w = words(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts_on_odd_texts(spark):
    texts = [r[1] for r in odd_rows() if len(r[1] or "") < 5000]
    texts += ["a b c d e f g h " * 3, "x\nx\n \nx # $ <é>", " ".join("abcdefgh" * 2) + " z " + " ".join("abcdefgh")]
    docs = documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: tuple(r)[1:] for r in quality_rules(clashing(docs, "_txt", "n_words", "kept", "_ROW")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_lines_in_many_documents_of_a_host_go(spark):
    rows = [(i, f"{prose(i, 30)}\nShare this page with number {i}\n" + "Common menu line here " * 30, "host") for i in range(30)]
    rows += [(100 + i, prose(7, 40), "host") for i in range(50)]  # copies are one document
    rows += [(200, prose(8, 40) + "\nShare this page with number 7", "other"), (201, None, None)]
    got = {r["doc_id"]: r for r in quality_rules(documents(spark, rows), max_repeat_percent=100).collect()}
    assert got[3]["n_removed_words"] == 6 + 120 and not got[3]["kept"] and got[3]["clean_text"] == prose(3, 30)
    assert got[120]["kept"] and got[200]["kept"] and got[200]["n_removed_words"] == 0
    assert got[201]["base_failed"] and got[201]["clean_text"] is None
    assert quality_rules(documents(spark, [])).count() == 0


def test_a_large_host_is_not_exempt(spark):
    """A line of 26 of 2,700 documents is below the share; it goes once it is in more than `line_many`."""
    rows = [(i, f"{prose(i, 30)}\nRead our terms" if i < 26 else prose(i, 4), "host") for i in range(2700)]
    for many, gone in ((1000, 0), (26, 0), (25, 3)):
        got = quality_rules(documents(spark, rows), line_many=many).where("doc_id < 26").select("n_removed_words").distinct().collect()
        assert [r[0] for r in got] == [gone]


def labelled(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        toxic, low = i % 5 == 0, i % 7 == 0
        text = prose(i, 40, 300) + (" you utter scumbag" if toxic and i % 2 else " Scum, all of you" if toxic else "") + (" click here now" if low else "")
        rows.append((i, text))
        labels.append((i, int(not low), int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_finds_held_out_toxic_documents(spark):
    docs, labels = labelled(spark)
    chain = fit_chain(docs, labels.where("doc_id < 300"))
    assert chain.models[0].earlier.shape == (0,) and chain.models[1].earlier.shape == (1,)
    held = predict(docs.where("doc_id >= 300"), chain).collect()
    assert {r["doc_id"] for r in held if r["is_toxic"]} == {i for i in range(300, 400) if i % 5 == 0}
    assert {r["doc_id"] for r in held if r["is_low_quality"]} == {i for i in range(300, 400) if i % 7 == 0}


def test_chain_on_odd_rows_and_labels(spark):
    docs, labels = labelled(spark, 100)
    odd = clashing(documents(spark, odd_rows()), "p_toxic", "y", "h")
    nulls = spark.createDataFrame([(None, 1, 1), (3, None, 0), (99999, 1, 1)], labels.schema)
    chain = fit_chain(docs, labels.union(nulls))
    out = predict(odd, chain)
    assert out.count() == len(odd_rows()) and "h" in out.columns
    for part in (labels.limit(0), labels.where("toxic = 0")):
        none = predict(odd, fit_chain(docs, part))
        assert none.where("is_toxic").count() == 0
    assert predict(documents(spark, []), chain).count() == 0


def test_language_from_each_evidence(spark):
    syllables = {"aa": ["bar", "dor", "gan"], "bb": ["öst", "üll", "ström"]}
    make = lambda lang, seed: " ".join("".join(random.Random(seed * 99 + i).choices(syllables[lang], k=2)) for i in range(30))
    rows = [(i, make(lang, i)) for i in range(60) for lang in syllables]
    docs = documents(spark, rows).withColumn("lang", F.when(F.col("text").rlike("[öü]"), "bb").otherwise("aa"))
    languages, logs = fit_text(docs)
    assert languages == ["aa", "bb"]
    cases = [(i, "h1", "d", "aa", "aa", make("aa", 200 + i)) for i in range(30)] + [(100 + i, "h2", "d", "bb", "bb", make("bb", 300 + i)) for i in range(30)]
    cases += [(500, "h1", "d", None, None, None), (501, "h2", "d", None, None, ""), (502, None, None, "bb", None, "?"), (503, "h9", "d", "zz", "bb", None)]
    cases += [(504, "h1", "d", "aa", None, make("bb", 400)), (504, "h1", "d", "aa", None, make("bb", 400))]
    frame = spark.createDataFrame(cases, "id long, host string, domain string, declared string, hint string, body string").withColumn("confidence", F.lit("x"))
    got = identify(frame, languages, logs).collect()
    by = {r["id"]: r for r in got}
    assert len(got) == len(cases) and all(by[i]["lang"] == "aa" and by[100 + i]["lang"] == "bb" for i in range(30))
    assert by[500]["lang"] == "aa" and by[501]["lang"] == "bb" and by[502]["lang"] == "bb" and by[503]["lang"] == "bb"
    assert by[504]["lang"] == "bb" and by[500]["text_lang"] is None and by[500]["confidence"] < by[0]["confidence"]
    assert identify(frame.limit(0), languages, logs).count() == 0
    assert identify(frame, [], np.zeros((0, 1))).where("lang IS NULL").count() == len(cases)


def test_language_keeps_columns_of_any_name(spark):
    docs = documents(spark, [(i, prose(i, 30)) for i in range(20)])
    languages, logs = fit_text(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")))
    frame = spark.createDataFrame([(1, "h", "d", "aa", None, prose(1, 30)), (2, None, None, None, None, None)], "id long, host string, domain string, declared string, hint string, body string")
    plain = {r["id"]: (r["lang"], r["confidence"]) for r in identify(frame, languages, logs).collect()}
    odd = ["_decl", "_hint", "_text", "_n", "_h", "_d", "_p", "_like", "_says", "_post", "_max", "_ld", "_lhv", "_host", "_domain", "c0", "n0", "d1", "g0"]
    for i, name in enumerate(odd):
        frame = frame.withColumn(name, F.lit(i))
    got = identify(frame, languages, logs).collect()
    assert {r["id"]: (r["lang"], r["confidence"]) for r in got} == plain
    assert all(r[name] == i for r in got for i, name in enumerate(odd))


def test_language_model_of_odd_tables(spark, monkeypatch):
    """No rows, one very long text, more labels than the model takes, and a rare one among frequent ones."""
    assert fit_text(documents(spark, []))[0] == []
    rows = [(i, f"common words number {i}") for i in range(300)] + [(900, "rare öäü ßß"), (901, prose(3, 60_000))]
    docs = documents(spark, rows).withColumn("lang", F.expr("CASE doc_id WHEN 900 THEN 'rare' WHEN 901 THEN 'long' ELSE 'main' END"))
    languages, logs = fit_text(docs, sample=30)
    assert languages == ["long", "main", "rare"] and all(np.abs(row).max() > 0 for row in logs)
    frame = docs.selectExpr("doc_id AS id", "'h' AS host", "'d' AS domain", "'none' AS declared", "CAST(NULL AS STRING) AS hint", "text AS body")
    by = {r["id"]: r["text_lang"] for r in identify(frame, languages, logs).collect()}
    assert by[900] == "rare" and by[901] == "long"
    monkeypatch.setattr(language, "LANGUAGES", 2)
    assert fit_text(docs)[0] == ["long", "main"]


def test_address_and_declaration(spark):
    frame = spark.createDataFrame(
        [("https://www.Shop.example.de:80/fr/x?y", "<!doctype html><HTML class=a lang='de-AT'>"), ("http://u@blog.example.fr", "<html xml:lang=en>"), ("nope", None), (None, "<p lang=fr>")],
        "url string, html string",
    )
    host, domain, hint = address_parts(F.col("url"))
    got = [tuple(r) for r in frame.select(host, domain, hint, declared_language(F.col("html"))).collect()]
    assert got[0] == ("www.shop.example.de", "example.de", "fr", "de")
    assert got[1] == ("blog.example.fr", "example.fr", "fr", "en")
    assert got[2][0] is None and got[2][2:] == (None, None) and got[3][0] is None and got[3][3] is None


def test_page_lines():
    assert page_lines('<body><nav><a>m</a></nav><p>x <b>y</b><br>z&amp;&eacute;<script>"</p>"</script></p><p class=ad>s<p>keep</body>') == (["m", "x y z&é", "s", "keep"], [0, 1, 0, 1])
    assert page_lines('<article><header><h1>T</h1></header><p>a <span class="share">x</span> b</p><article class="comment">no</article><p>end</article><p>out') == (
        ["T", "a b", "no", "end", "out"], [2, 2, 0, 2, 0])
    assert page_lines("") == ([], []) and page_lines("a < b <c") == (["a < b <c"], [1]) and page_lines("t<!-- open <p>x") == (["t"], [1])


@pytest.mark.parametrize("frame", ['<form id="aspnetForm">', '<div class="site has-sidebar">', '<div id="content-sidebar-wrap">', '<div class="widget">', '<div hidden>'])
def test_frames_of_a_page_are_not_skipped(frame):
    end = "</form>" if "form" in frame else "</div>"
    text = "One long line of the article itself, longer than all the others of it"
    assert page_lines(f"<body>{frame}<nav>menu</nav><main><h1>T</h1><p>{text}</p></main><div class=ad>ad</div>{end}</body>") == (["menu", "T", text, "ad"], [0, 2, 2, 0])
    assert page_lines(f"<body>{frame}<nav>menu</nav><p>{text}</p>{end}</body>") == (["menu", text], [0, 1])


def test_names_inside_an_article():
    inner = '<h2 class="section-header">a</h2><h2 id="related-work">b</h2><div class="share-prices">c</div><p class="notice">d</p><p>e</p>'
    assert page_lines(f"<article>{inner}<div class='share cookie_text'>f</div></article>") == (list("abcdef"), [2] * 5 + [0])
    assert page_lines("<main><p>x y z</p></main><aside><article>teaser</article></aside>") == (["x y z", "teaser"], [2, 0])


@pytest.mark.parametrize("name", ["user-comments", "post-comments", "comments-section", "commentlist", "disqus_thread", "top_banner", "userComments"])
def test_compound_names_of_asides(name):
    page = f"<article><p>Text.</p><div class='x {name}'><p>I agree!</p></div><section class='has-sidebar'>More.</section></article>"
    lines, kinds = page_lines(page)
    assert [x for x, k in zip(lines, kinds) if k] == ["Text.", "More."]


def test_common_subsequence_is_longest():
    draw = random.Random(3)
    for _ in range(200):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        hit = common_subsequence(np.array(a), np.array(b))
        assert hit.sum() == best[-1][-1]
        rest = iter(b)
        assert all(any(x == y for y in rest) for x, h in zip(a, hit) if h)


def test_lines_shared_with_the_nearest_page_go(spark):
    page = lambda i: f"<div>Menu of the site</div><p>{prose(i, 12)}</p><p>{prose(i + 50, 12)}</p><div>About us and more</div>"
    rows = [(i, f"http://h.example/en/{i:03d}.html", page(i)) for i in range(20)]
    rows += [(100, "http://h.example/en/005.html", page(5)), (101, None, page(1)), (102, "http://lone.example/", page(2)), (103, "http://h.example/z", None), (104, "x", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for pages in (frame, clashing(frame.withColumnRenamed("page_id", "doc_id"), "_host", "n_shared").withColumnRenamed("doc_id", "page_id")):
        got = {r["page_id"]: r for r in extract(pages).collect()}
        assert len(got) == len(rows)
        for i in (0, 5, 19, 100):
            assert got[i]["text"] == f"{prose(i % 95, 12)}\n{prose(i % 95 + 50, 12)}", i
        assert got[101]["text"].startswith("Menu") and got[102]["text"].startswith("Menu") and got[103]["text"] == got[104]["text"] == ""
    assert extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 256])
def test_large_hosts_are_compared_like_small_ones(spark, monkeypatch, block):
    """Slug paths, pages that differ in the query only, and pages at the borders of ranges and of blocks of borders."""
    monkeypatch.setattr(html_text, "BLOCK", block)
    page = lambda i: f"<div>Menu of the site</div><p>{prose(i, 12)}</p><div>About us and more</div>"
    rows = [(i, f"http://slug.example/2024/05/{prose(i, 2).replace(' ', '-')}", page(i)) for i in range(300)]
    rows += [(1000 + i, f"http://query.example/index.php?id={i}", page(1000 + i)) for i in range(5000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["page_id"]: r for r in extract(frame).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(got) == len(rows) and all(got[i]["text"] == prose(i, 12) and got[i]["n_shared"] == 2 for i, _, _ in rows)


def test_long_menus_and_runs_of_copies(spark):
    menu, foot = "".join(f"<div>{prose(900 + i, 9)}</div>" for i in range(20)), f"<div>{prose(990, 60)}</div>"
    rows = [(i, f"http://short.example/a/{i:03d}", f"{menu}<p>{prose(i, 6)}</p>{foot}") for i in range(9)]
    rows += [(100 + i, f"http://copies.example/a/{i:03d}", f"{menu}<p>{prose(max(i, 5) if i < 9 else 5 + i % 3, 60)}</p>{foot}") for i in range(20)]
    # copies but for a line, between other pages
    rows += [(200 + i, f"http://near.example/a/{i:03d}", f"<p>Menu of the site</p><p>read {i} times</p><p>{prose(50 + i // 2, 60)}</p>") for i in range(10)]
    got = {r["page_id"]: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(9):
        assert got[i]["text"] == prose(i, 6) and got[i]["n_shared"] == 21
    for i in range(20):
        assert got[100 + i]["text"] == prose(max(i, 5) if i < 9 else 5 + i % 3, 60), i
    for i in range(1, 9):
        assert got[200 + i]["text"] == f"read {i} times\n{prose(50 + i // 2, 60)}", i


def test_comparison_and_markup():
    """1 menu, 2 aside of its own, 3 notice and 4 to 7 text inside the article; only deleted lines count."""
    own, kind, size = np.arange(1, 8), np.array([0, 0, 2, 2, 2, 2, 2]), np.array([1, 1, 20, 50, 50, 50, 50])
    hit = lambda *beside: np.flatnonzero(shared_lines(own, kind, size, [np.array(b) for b in beside])).tolist()
    assert hit([1, 3, 9], [1, 3, 8]) == [0, 2] and hit([1, 3, 9], [1, 8]) == [0] and hit([1, 3, 9]) == [0]
    # versions of the article on both sides are not taken for boilerplate, a copy is passed over
    assert hit([1, 3, 4, 5, 8], [1, 3, 4, 5, 9]) == [0] and hit([1, 2, 3, 4, 5, 6], [1, 3]) == [0] and hit() == []


def test_blocks_cover_all_rows():
    column = pa.array([b"ab", None, b"", b"x" * 50, b"c"], type=pa.binary())
    for step in (1, 3, 1000):
        parts = [(row, bytes(data[a:b])) for row, data, at in blocks(column.slice(1), step) for a, b in zip(at[:-1], at[1:])]
        assert [p for _, p in parts] == [b"", b"", b"x" * 50, b"c"]
    assert isinstance(Chain([], [], []), Chain)
