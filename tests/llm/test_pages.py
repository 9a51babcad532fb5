import random
import time

import pytest

from metergrid.llm.common import Scratch
from metergrid.llm.pages import common_lines, extract, page_lines, partners
from metergrid.llm.queries import op2_pages

PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style><script>if (a < b) "x</p>"</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li>Home<li>More</ul></nav>
<article><h1>Tom &amp; J&#233;rôme</h1><p>First
  <b>bold</b>&nbsp;text<br>after<p>Second &lt;p&gt;</p><ul><li>one<li>two</ul><div class="share-buttons">Share</div></article>
<aside>side</aside><div id="comments"><p>reader</p></div><form><input value="x">mail</form><footer>end</footer></body></html>"""


def _texts(spark, rows, extra=()):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", *extra)
    return {(r["page_id"], r["url"]): r["text"] for r in extract(df).collect()}


def test_article_without_chrome(spark):
    got = _texts(spark, [(1, "https://a.example/x", PAGE)], ["url AS key", "html AS lines", "html AS text", "page_id AS partner"])
    assert got == {(1, "https://a.example/x"): "Tom & Jérôme\n\nFirst bold text after\n\nSecond <p>\n\none\n\ntwo"}


def test_lines_shared_with_the_nearest_page_go(spark):
    page = lambda text: f"<html><body><div>Site name</div><div>{text}</div><div>All rights</div></body></html>"
    rows = [
        (1, "https://a.example/b/1", page("alpha")), (2, "https://a.example/b/2", page("beta")), (3, "https://b.example/b/2", page("gamma")), (4, "https://a.example/b/2", page("beta")),
        (5, None, page("delta")), (6, "https://a.example/b/9", None), (7, "https://a.example/b/8", ""), (None, "https://a.example/b/3", page("eta")), (8, "nourl", page("x")),
        (9, "https://c.example/1", page("one")), (9, "https://c.example/2", page("two")),
    ]
    got = _texts(spark, rows)
    whole = lambda text: f"Site name\n\n{text}\n\nAll rights"
    assert got[1, "https://a.example/b/1"] == "alpha" and got[3, "https://b.example/b/2"] == whole("gamma")
    assert got[2, "https://a.example/b/2"] == "beta"
    assert got[4, "https://a.example/b/2"] == "beta"  # a copy has the partner of its first
    assert got[5, None] == whole("delta") and got[8, "nourl"] == whole("x") and got[None, "https://a.example/b/3"] == whole("eta")
    assert got[6, "https://a.example/b/9"] == got[7, "https://a.example/b/8"] == "" and got[9, "https://c.example/1"] == whole("one")
    assert len(got) == len(rows)


def test_partner_is_the_neighbour_with_the_longer_common_path(spark):
    rows = [(1, "a", "/x/1"), (2, "a", "/x/2"), (3, "a", "/y/z/1"), (4, "a", "/y/z/2"), (5, "b", "/x/1")]
    got = {r["key"]: r["partner"] for r in partners(spark.createDataFrame(rows, "key long, host string, path string"), Scratch(spark)).collect()}
    assert got == {1: 2, 2: 1, 3: 4, 4: 3}


def test_common_lines_equal_plain_dynamic_programming(monkeypatch):
    from metergrid.llm import pages

    rng = random.Random(9)
    for cells in (1 << 20, 12):
        monkeypatch.setattr(pages, "CELLS", cells)
        for _ in range(60):
            a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            marks = common_lines(a, b)
            kept = [x for x, m in zip(a, marks, strict=True) if m]
            it = iter(b)
            assert len(kept) == table[-1][-1] and all(x in it for x in kept)


def test_broken_html_and_long_pages():
    assert page_lines("<p>a<p>b</div>c<script>never") == [("a", 0), ("b", 0), ("c", 0)]
    assert page_lines("a < b<!-- c -->d <!doctype x> e<p class='f>g</p>h") == [("a < bd e", 0), ("g", 0), ("h", 0)]
    assert page_lines("a<b") == [("a<b", 0)] and page_lines("x<p title='1>2'>y") == [("x", 0), ("y", 0)]
    assert page_lines("plain &amp; text") == [("plain & text", 0)]
    assert len(page_lines("<article>" + "<p>line</p>" * 30_000)) == 30_000


@pytest.mark.parametrize("piece", ["<a ", '<p "', "<p '\"", "<b>", "<b></i>", "<p><b></p></i>", "<!--", "<!", "</a", "<script>", "<p class=\"x", "&#1", "<div><p></span>"])
def test_malformed_pages_take_time_in_proportion(piece):
    page = "<article>begin</article>" + piece * (2_000_000 // len(piece)) + " >"
    start = time.process_time()
    lines = page_lines(page)
    assert lines[0] == ("begin", 1) and time.process_time() - start < 12


def test_empty_table_and_lines_deleted(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    page = lambda text: f"<div>Site name</div><div>{text}</div>"
    df = spark.createDataFrame([(1, "https://a.example/b/1", page("x")), (2, "https://a.example/b/2", page("y"))], "page_id long, url string, html string")
    assert {(r["text"], r["n_lost"]) for r in extract(df).collect()} == {("x", 1), ("y", 1)}


def test_query_covers_every_page(spark, sf_dir):
    got = op2_pages(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and all(r["n_chars"] == len(r["text"]) for r in got)


def test_lines_that_a_site_repeats_inside_articles_go(spark):
    page = lambda *lines: "<html><body><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article></body></html>"
    body = lambda i: [f"article {i} begins here", f"and {i} goes on with words of its own"]
    rows = [(i, f"https://a.example/news/{i}", page("Read it in our app", *body(i), *(["quoted by two"] if i in (1, 2) else []))) for i in range(1, 9)]
    rows += [(10 + i, f"https://a.example/copies/{i}", page("a long article in three versions", "with most of its lines", f"but version {i}")) for i in range(3)]
    rows += [(20, "https://b.example/news/1", page("Read it in our app", *body(20)))]
    got = {i: text.split("\n\n") for (i, _), text in _texts(spark, rows).items()}
    for i in range(1, 9):
        assert got[i] == body(i) + (["quoted by two"] if i in (1, 2) else [])
    assert all(got[10 + i] == ["a long article in three versions", "with most of its lines", f"but version {i}"] for i in range(3))
    assert got[20] == ["Read it in our app", *body(20)]


def test_words_of_class_and_id_do_not_lose_an_article():
    kept = lambda page: [text for text, _ in page_lines(page)]
    assert kept("<div class='layout with-sidebar'><article>a</article></div>") == ["a"]
    assert kept("<div class='sidebar-left'><div>x</div><main>a</main><nav>y</nav></div>") == ["a"]
    assert kept("<div class='hasSidebar no-comments'>a</div>") == ["a"]
    assert kept("<article><div class='entry-header'><h1>t</h1></div><p class='notice'>n</p><section id='legal'>l</section><p>a</p></article>") == ["t", "n", "l", "a"]
    assert kept("<article><p>a</p><div class='ad'>x</div><div class='share'>x</div><div class='post-comments'>x</div></article>") == ["a"]
    assert kept("<div class='header'>x</div><div id='comments'><article>x</article></div><nav><article>x</article></nav><p>a</p>") == ["a"]
    assert page_lines("<article><div class='post-header'>t</div><p class='notice'>n</p></article>") == [("t", 1), ("n", 0)]


def test_names_that_belong_to_the_text_keep_it():
    kept = lambda page: [text for text, _ in page_lines(page)]
    assert kept('<article><p>a</p><h2 id="related-work">Related work</h2><p id="share-of-votes">c</p><p class="ad-hoc">d</p></article>') == ["a", "Related work", "c", "d"]
    assert kept('<main><h2 id="comments-on-the-law">h</h2><div class="widget-design">w</div><section id="search">s</section><h3 id="comments">k</h3><p class="ad">p</p></main>') == ["h", "w", "s", "k", "p"]
    assert kept('<article><p>a</p><div class="ad-slot">x</div><div class="shareButtons">x</div><section id="comments">x</section><ul class="related-posts related">x</ul></article>') == ["a"]


def test_long_pages_with_other_lines_take_seconds(monkeypatch):
    import numpy as np

    from metergrid.llm import pages

    rng = np.random.default_rng(3)
    for pool in (10**9, 300, 2):
        a, b = (rng.integers(0, pool, 60_000).astype(np.int64) for _ in range(2))
        if pool == 10**9:
            b = rng.permutation(a)
        start = time.process_time()
        marks = common_lines([str(x) for x in a], [str(x) for x in b])
        assert time.process_time() - start < 40 and sum(marks) == pages._lengths(a, b)[-1]


def brute(rows):
    """The rule of extract() by plain comparison; rows: (id, url, html), ids unique."""
    import re

    parts = {}
    for i, url, page in rows:
        m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)[^/?#]*([^?#]*)", url or "")
        parts[i] = (m[1].lower() if m else "", m[2] if m else "", page_lines(page or ""))
    keys = {}
    for i, (host, path, lines) in parts.items():
        if host:
            keys.setdefault((host, tuple(t for t, _ in lines)), []).append((path, i))
    first = sorted((host, *min(at)) for (host, _), at in keys.items())
    lcs = lambda a, b: common_lines(a, b)  # noqa: E731  checked against dynamic programming above
    shared = lambda p, q: next((k for k, (x, y) in enumerate(zip(p.split("/"), q.split("/"))) if x != y), min(len(p.split("/")), len(q.split("/"))))
    marks, count, pages_of = {}, {}, {}
    for k, (host, path, i) in enumerate(first):
        pages_of[host] = pages_of.get(host, 0) + 1
        near = [first[j] for j in (k - 1, k + 1) if 0 <= j < len(first) and first[j][0] == host]
        if not near:
            continue
        other = max(near, key=lambda n: shared(path, n[1]))
        lines = parts[i][2]
        gone = lcs([t for t, _ in lines], [t for t, _ in parts[other[2]][2]])
        body = sum(len(t.encode()) for (t, z) in lines if z == 1)
        copy = 2 * sum(len(t.encode()) for (t, z), g in zip(lines, gone) if g and z == 1) >= body
        marks[i] = [] if all(gone) else [n for n, ((t, z), g) in enumerate(zip(lines, gone)) if g and not (copy and z == 1)]
        for t in {lines[n][0] for n in marks[i] if lines[n][1] == 1}:
            count[host, t] = count.get((host, t), 0) + 1
    out = {}
    for (host, texts), at in keys.items():
        i = min(at)[1]
        lines = parts[i][2]
        lost = {n for n in marks.get(i, ()) if lines[n][1] != 1 or (count[host, lines[n][0]] >= 3 and 2 * count[host, lines[n][0]] >= pages_of[host])}
        for _, j in at:
            out[j] = "\n\n".join(t for n, t in enumerate(texts) if n not in lost)
    return {i: out.get(i, "\n\n".join(t for t, _ in lines)) for i, (_, _, lines) in parts.items()}


def test_query_against_plain_comparison(spark, sf_dir):
    given = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rng = random.Random(6)
    for k in range(120):
        chrome = [f"<div>{x}</div>" for x in ("Site name", f"menu {k % 5}", "rights") if rng.random() < 0.8]
        body = "".join(f"<p>{rng.choice(['common line', f'own line {k} {n}', f'line {rng.randint(0, 6)}'])}</p>" for n in range(rng.randint(0, 6)))
        given.append((10_000 + k, f"https://h{k % 7}.example/{rng.choice('abc')}/{rng.choice('xy')}/{k}", f"<body>{chrome[0] if chrome else ''}<article>{body}</article>{''.join(chrome[1:])}</body>"))
    df = spark.createDataFrame(given, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract(df).collect()} == brute(given)


def test_no_line_of_an_article_is_lost(spark, sf_dir):
    import html as markup
    import re

    found = {r["page_id"]: r["text"] for r in op2_pages(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = "".join(re.findall(r"(?s)<article>(.*?)</article>", r["html"] or ""))
        words = re.sub(r"\s+", " ", markup.unescape(re.sub(r"<[^>]*>", " ", inner))).split()
        assert re.sub(r"\s+", " ", found[r["page_id"]]).split() == words
