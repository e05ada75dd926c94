import html as references
import math
import random
import re
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from agentlens.llm import markup, neighbours, page_text, url_filter
from agentlens.llm.common import table

# ---- urls


def test_urls_by_rules(spark):
    urls = ["https://www.Example.COM/en/7?x", "http://example.com/en/", "https://a.net/de/", "https://b.example.net/de/88#x", "http://net", "x.org/es/", None, "://ORG/es/", "ftp://com?/en/", "http://xcom/en/1", "http://a.com/EN/", "http://u@b.com:80/en/", "http://a\n.org/es/q\nr"]
    rows = [(i, u, "old", 0) for i, u in enumerate(urls)] + [(1, urls[1], "old", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, rule string, n int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()}
    assert got[0] == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1] == ("example.com", "/en/", "com/en/", "block")
    assert got[2] == ("a.net", "/de/", "net/de/", "allow")
    assert got[3] == ("b.example.net", "/de/88", "example.net/de/8", "block")
    assert got[4] == ("net", "", None, "allow") and got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7] == ("org", "/es/", "org/es/", "block") and got[8] == ("com", "", None, "allow") and got[9][2] is None and got[10][2] is None
    assert got[11] == ("u@b.com:80", "/en/", None, "allow") and got[12][2:] == ("org/es/", "block")
    assert url_filter.judge_urls(df).count() == len(rows) and url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = sorted(con.sql(url_filter.SQL["op6_url_filter"]).fetchall(), key=str)
    assert sorted(map(tuple, url_filter.op6_url_filter(spark, "/root/testdata/sf0.001").collect()), key=str) == want


# ---- neighbours


def brute(ids, rows, asked, k):
    norms = np.sqrt((rows * rows).sum(axis=1))
    out = {}
    for i, q in asked:
        s = (rows * q).sum(axis=1) / (norms * np.sqrt((q * q).sum()))
        keep = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(s[j])) for j in keep]
    return out


def test_recall_and_scores(spark):
    a = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchnumpy()
    ids, rows = a["vec_id"], np.stack(a["embedding"]).astype(float)
    want = brute(ids, rows, [(int(i), rows[n]) for n, i in enumerate(ids) if i % 50 == 0], 5)
    got = {}
    for r in neighbours.op3_neighbours(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in w}) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9
    exact = dict(zip(ids.tolist(), rows))
    for q, found in got.items():
        assert sorted(found) == [1, 2, 3, 4, 5]
        for v, s in found.values():
            assert math.isclose(s, exact[q] @ exact[v] / np.linalg.norm(exact[q]) / np.linalg.norm(exact[v]), abs_tol=1e-12)


def test_ties_nulls_and_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [1.0, inf], 1), (8, [1.0, None], 1), (50, [1.0, 1.0], 1), (9, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (100, None, 1), (2, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest_neighbours(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 3), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 3)]
    assert neighbours.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = neighbours.nearest_neighbours(df, df.filter("vec_id = 150")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4]


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- c --><div class="ad">Buy</div>
<div id="cookie-notice">We use cookies</div><aside>Side</aside><article><h1>Head &amp; tail</h1><p><b>One
 two.<br><p>Three &lt;x&gt; <a href=#>four</a>&nbsp;five</p><form>Name <input></form><section class="comments"><p>Nice!</p></section><ul><li>six<li>seven</ul></article><footer>&copy; me</footer></body></html>"""


def test_article_text(spark):
    rows = [(1, "http://h/a", PAGE, "x"), (2, "http://h/b", None, "x"), (3, None, "", "x"), (4, "http://h/c", "plain &am &amp text", "x"), (5, "http://h/d", "<p>cut <b", "x"), (1, "http://h/a", PAGE, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in page_text.extracted(df).collect()}
    want = "Head & tail\n\nOne two.\n\nThree <x> four five\n\nsix\n\nseven"
    assert got[1] == (want, len(want)) and got[2] == ("", 0) and got[3] == ("", 0) and got[4][0] == "plain &am & text" and got[5][0] == "cut"
    assert page_text.extracted(df).count() == len(rows) and page_text.extracted(df.limit(0)).count() == 0


def test_style_tree_drops_what_a_site_repeats(spark):
    page = "<body><div class=top>Welcome to our site</div><div class=body><p>Text {0} of page {0}</p></div><div class=x1>All rights kept</div></body>"
    df = spark.createDataFrame([(i, f"http://a.org/{i}", page.format(i)) for i in range(12)] + [(99, "http://b.org/1", page.format(99))], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.extracted(df).collect()}
    assert all(got[i] == f"Text {i} of page {i}" for i in range(12))
    assert got[99] == "Welcome to our site\n\nText 99 of page 99\n\nAll rights kept"  # one page tells nothing of its site
    tree = {r["branch"]: r["importance"] for r in page_text.style_tree(page_text.node_counts(df.withColumn("_host", url_filter.url_host(F.col("url"))))).filter("_host = 'a.org'").collect()}
    assert math.isclose(min(tree.values()), 0, abs_tol=1e-12) and max(tree.values()) == 1


def plain_tree(pages):
    """The tree of (host, html) pages in dictionaries: branch -> (n_pages, presentation, content)."""
    bodies, styles, texts = {}, {}, {}
    for host, html in pages:
        page = markup.parsed(html)
        at = {}
        for b in page.blocks:
            at.setdefault((host, b.path), []).append(b)
        inside = ["\n".join(b.text for b in bs) for bs in at.values() if bs[0].content and not bs[0].outside]
        body = max(inside, key=lambda t: (len(t), t)) if inside else tuple(b.text for b in page.blocks if not b.outside)
        for key, bs in at.items():
            bodies.setdefault(key, set()).add(body)
            styles.setdefault(key, {}).setdefault(tuple(page.styles[key[1]]), set()).add(body)
            for b in bs:
                texts.setdefault(key, {}).setdefault(b.text, set()).add(body)
    out = {}
    for key, all_bodies in bodies.items():
        n, ks, kt = len(all_bodies), [len(x) for x in styles[key].values()], [len(x) for x in texts[key].values()]
        total = sum(ks)
        entropy = -sum(k / total * math.log(k / total) for k in ks) / math.log(total) if total > 1 else 1.0
        out[key] = (n, entropy, sum(1 - math.log(k) / math.log(n) for k in kt) / len(kt) if n > 1 else 1.0)
    return out


def test_tree_equals_dictionaries(spark):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(rng.randint(1, 3)))
    part = lambda: rng.choice([f"<p>{line()}</p>", f"<ul><li>{line()}<li>{line()}</ul>", f"<div class='box'><b>{line()}</b></div>", f"<div class='related'><p>{line()}</p></div>"])
    pages = [(f"h{i % 3}.org", f"<html><body><div class=top>{rng.choice(['x', 'x', line()])}</div><article>{''.join(part() for _ in range(rng.randint(1, 4)))}</article></body></html>") for i in range(90)]
    df = spark.createDataFrame(pages, "_host string, html string").repartition(5)
    got = {(r["_host"], r["branch"]): (r["n_pages"], r["presentation"], r["content"], r["importance"]) for r in page_text.style_tree(page_text.node_counts(df)).collect()}
    want = plain_tree(pages)
    assert set(got) == set(want) and len(got) > 12
    for key, (n, presentation, content) in want.items():
        assert got[key][0] == n
        assert np.allclose(got[key][1:], (presentation, content, 1 - (1 - presentation) * (1 - content)))


def test_the_tree_decides(spark, monkeypatch):
    """With the same pages and no least importance, boilerplate stays: it is the tree that removes it, in articles and around them."""
    page = "<html><body><div class=x1>Welcome, reader</div><article><div class=x2>Tell all your friends</div><p>{0}</p><p>{1}</p></article><div class=x3>Built with care</div></body></html>"
    df = spark.createDataFrame([(i, f"http://a.org/{i}", page.format(f"First words of page {i}", f"and others, {i * i}")) for i in range(20)], "page_id bigint, url string, html string")
    texts = lambda: {r["page_id"]: r["text"] for r in page_text.extracted(df).collect()}
    assert texts() == {i: f"First words of page {i}\n\nand others, {i * i}" for i in range(20)}
    monkeypatch.setattr(page_text, "LEAST_IMPORTANCE", -1.0)
    assert all("Tell all your friends" in t for t in texts().values())


def test_articles_on_test_pages_are_whole(spark):
    """Whole contract text: every block of the article element, in order, and nothing else."""
    for r in page_text.op9_page_text(spark, "/root/testdata/sf0.001").join(table(spark, "/root/testdata/sf0.001", "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(references.unescape(re.sub(r"<(?!br)[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_words_tell_menus_without_their_names(spark):
    """What the tree alone leaves of the test pages, without names of elements and without a look at articles.

    On the hosts whose menus, adverts and footers have shown most of their words, that is the article, whole.
    """
    pages = table(spark, "/root/testdata/sf0.1", "pages").withColumn("_host", url_filter.url_host(F.col("url")))
    low = {(r["_host"], r["branch"]) for r in page_text.low_branches(page_text.style_tree(page_text.node_counts(pages))).collect()}
    whole = 0
    for r in pages.select("_host", "html").collect():
        blocks = markup.parsed(r["html"]).blocks
        left = [b for b in blocks if (r["_host"], b.path) not in low]
        article = [b for b in blocks if b.content and not b.outside]
        assert [b for b in left if b.content] == article  # nothing of it is lost on any host
        whole += left == article
    assert whole >= 320  # of 2500


def test_words_and_a_body_of_few_words(spark):
    """A menu of a fixed vocabulary goes; a body whose words repeat as well is still the body, and so are an article's headings."""
    rng = random.Random(3)
    menu = lambda: " ".join(rng.sample(["start", "news", "sport", "music", "books", "about", "help", "shop"], 4))
    page = "<body><div class=x1>{0}</div><div class=x2><p>item {1} of the list costs {2} and no more than that</p></div></body>"
    rows = [(i, f"http://a.org/{i}", page.format(menu(), i, i * 7)) for i in range(60)]
    paper = "<body><div class=x1>{0}</div><article><h2>{1}</h2><p>{2}</p></article></body>"
    words = lambda i: " ".join(f"w{i * 9 + k}" for k in range(9))
    rows += [(i, f"http://b.org/{i}", paper.format(menu(), rng.choice(["Results", "Methods", "Related work"]) + " " + rng.choice(["here", "there"]), words(i))) for i in range(100, 160)]
    got = {r["page_id"]: r["text"] for r in page_text.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"item {i} of the list costs {i * 7} and no more than that" for i in range(60))
    assert all(got[i].endswith("here\n\n" + words(i)) for i in range(100, 160))


def test_importance_by_words_equals_dictionaries(spark):
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice(["ab", "CD", "cd", "ef", "gh", "x1"]) for _ in range(rng.randint(1, 4)))
    pages = [f"<body><div class=top>{line()}{rng.choice(['', '<hr>'])}</div><article><p>{i} {line()}</p></article><div class=x>{line()}</div></body>" for i in range(40)]
    df = spark.createDataFrame([("h.org", page) for page in pages * 2], "_host string, html string")  # copies count once
    got = {r["branch"]: r for r in page_text.style_tree(page_text.node_counts(df)).collect()}
    words, sizes, pages_of = {}, {}, {}
    for i, page in enumerate(pages):
        for b in markup.parsed(page).blocks:
            pages_of.setdefault(b.path, set()).add(i)
            sizes[b.path] = sizes.get(b.path, 0) + len(b.text)
            for w in b.text.lower().split() if not b.content else ():
                words.setdefault(b.path, {}).setdefault(w, set()).add(i)
    assert {b: r["size"] for b, r in got.items()} == sizes and len(words) == 2
    for b, r in got.items():
        if b not in words:
            assert r["by_words"] is None
        else:
            content = sum(1 - math.log(len(k)) / math.log(len(pages_of[b])) for k in words[b].values()) / len(words[b])
            assert math.isclose(r["by_words"], 1 - (1 - r["presentation"]) * (1 - content))


def test_copied_articles_stay(spark):
    page = "<html><body><article><p>The same article</p></article></body></html>"
    df = spark.createDataFrame([(i, f"http://a.org/{i}", page) for i in range(12)], "page_id bigint, url string, html string")
    assert {r["text"] for r in page_text.extracted(df).collect()} == {"The same article"}


def test_style_tree_reaches_into_articles(spark):
    """Boilerplate without a telling class inside the article goes, of copied articles too; their bodies stay."""
    page = "<html><body><main><div class=x1>Tell your friends</div><article><p>{}</p></article></main></body></html>"
    bodies = [f"Body {i} of an article with words of its own" for i in range(10)] + ["The article that was copied again and again"] * 20
    df = spark.createDataFrame([(i, f"http://a.org/{i}", page.format(b)) for i, b in enumerate(bodies)], "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in page_text.extracted(df).collect()} == dict(enumerate(bodies))


def test_body_beside_a_teaser_stays(spark):
    page = "<html><body><article class=card><p>Read this too</p></article><div class=x2><p>{}</p></div></body></html>"
    bodies = [f"Body {i}, which is much longer than the teaser beside it" for i in range(10)]
    df = spark.createDataFrame([(i, f"http://a.org/{i}", page.format(b)) for i, b in enumerate(bodies)], "page_id bigint, url string, html string")
    assert all(bodies[r["page_id"]] in r["text"] for r in page_text.extracted(df).collect())


def test_names_of_elements():
    text = lambda page: "|".join(b.text for b in page_text.kept_blocks(markup.parsed(page)))
    assert text('<div class="layout with-sidebar"><article><p>in</p></article><div class="siteHeader">out</div></div>') == "in"
    assert text('<article><p>in</p><article class="comment"><p>out</p></article><div id="related-posts">out</div></article>') == "in"
    assert text('<main><p>a <span>b</span> c</p><div role="navigation">out</div><div class="adventure">in</div></main>') == "a b c|in"
    for name in ("post-with-comments", "search-results", "related-work", "form-factor"):
        assert text(f'<article><div class="{name}"><p>the body of it</p></div><div class="cookie-notice">out</div></article>') == "the body of it"


def test_odd_markup():
    text = lambda page: "|".join(b.text for b in markup.parsed(page).blocks)
    assert text("<p class=x' >hello</p>") == "hello" and text('<b title="never closed>bold</b> and <p>more') == "bold and|more"
    assert text("foo<wbr>bar <p>a<img src=x alt='>'>b<br>c") == "foobar|ab c" and text("1 < 2 <3 &lt;4") == "1 < 2 <3 <4"
    assert text("<p a = '>' b=\"<\">x<!-- > --><![CDATA[ <y> ]]></p><script>'</p>'</script >z") == "x <y>|z"
    for odd in ('<a href="x ', "<a ", "<", "<!--", "</", "<p>", "<b></i>", "<div class='a", "<script>"):
        began = time.time()
        markup.parsed(odd * (400_000 // len(odd)))
        assert time.time() - began < 20


def test_references_end_at_tags():
    texts = lambda h: [b.text for b in markup.parsed(h).blocks]
    assert texts("<p>a &<b>lt;</b> b &lt;b&gt; &amp;lt; 1 < 2 &amp;</p>") == ["a &lt; b <b> &lt; 1 < 2 &"]
