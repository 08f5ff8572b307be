import html
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revguard.llm import decontam_tiling as d
from revguard.llm import html_extract as h
from revguard.llm import url_filter as u
from revguard.llm.queries import QUERIES, URL_RULES
from tests.conftest import SF0001
from tests.llm.helpers import groups_by_brute_force, no_docs, odd_docs, odd_rows, PROSE


# --- greedy string tiling ------------------------------------------------------------------------

def slow_tiles(a, b, k):
    """The textbook loop: mark the longest common run of unmarked words, until none of k words is left."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while (i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n]
                       and free_b[j + n]):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return out
        out.append(best)
        free_a[i: i + n] = [False] * n
        free_b[j: j + n] = [False] * n


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=24), st.text("abc", max_size=16))
def test_tiles_are_the_textbooks(a, b):
    k = 3
    pairs = [(i, j) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i: i + k] == b[j: j + k]]
    if not pairs:
        assert slow_tiles(a, b, k) == []
        return
    got = d.tiles(*(np.array(x) for x in zip(*pairs)), k)
    assert got[0][2] == slow_tiles(a, b, k)[0][0]  # the longest match; ties may be tiled in another order
    assert [n for _, _, n in got] == sorted((n for _, _, n in got), reverse=True)
    for x, size in ((0, len(a)), (1, len(b))):
        marked = [t[x] + i for t in got for i in range(t[2])]
        assert len(marked) == len(set(marked)) and all(m < size for m in marked)
    assert all(a[i: i + n] == b[j: j + n] for i, j, n in got)
    free_a, free_b = list(a), list(b)
    for i, j, n in got:
        free_a[i: i + n], free_b[j: j + n] = ["<"] * n, [">"] * n
    left = "".join(free_a), "".join(free_b)  # nothing of k letters is left unmarked in both
    assert not any(left[0][i: i + k] in left[1] for i in range(len(a) - k + 1))


def test_whole_passages_are_found_and_clean_documents_left(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").collect()
    items = {r.item_id: d.words(r.text) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op9_decontam_tiling"](spark, SF0001).collect()}
    for r in docs:
        w = d.words(r.text)
        runs = {tuple(w[i: i + d.MIN_MATCH]) for i in range(len(w))}
        for i, item in items.items():
            grams = [tuple(item[j: j + d.MIN_MATCH]) in runs for j in range(len(item) - d.MIN_MATCH + 1)]
            covered = {j + x for j, hit in enumerate(grams) if hit for x in range(d.MIN_MATCH)}
            # tiles cover at most the words of shared runs; a passage that is there whole is covered whole
            assert ((r.doc_id, i) in got) <= (len(covered) >= d.MIN_COVERAGE * len(item))
            assert ((r.doc_id, i) in got) >= (" ".join(item) in " ".join(w))
    assert got and all(r.covered_words <= r.item_words for r in got.values())


def test_reordered_shuffled_and_broadcast_agree(spark):
    rng = random.Random(2)
    item = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    parts = [item[i: i + 10] for i in range(0, 60, 10)]
    rng.shuffle(parts)
    filler = lambda n: [f"z{rng.randint(0, 999)}" for _ in range(n)]
    mixed = filler(50) + [w for p in parts for w in p + filler(3)]
    texts = [(1, " ".join(mixed).upper()), (2, " ".join(filler(300))), (3, " ".join(item[:20] + filler(40))),
             (4, ", ".join(item) + "!"), (None, " ".join(item)), (4, ", ".join(item) + "!"), (5, None), (6, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, ""), (9, None), (10, "too short"), (None, "x " * 30)],
                                  "item_id long, text string")
    small = d.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in small} == {(1, 7), (4, 7), (None, 7)} and len(small) == 3
    assert sorted(map(str, small)) == sorted(map(str, d.contaminated(docs, bench, broadcast_seeds=0).collect()))
    assert sorted(str(r.doc_id) for r in d.clean_rows(docs, bench).collect()) == ["2", "3", "5", "6"]


def test_tiling_odd_and_empty(spark):
    docs = odd_docs(spark)
    bench = spark.createDataFrame([(1, PROSE[:120]), (2, None)], "item_id long, text string")
    clean = d.clean_rows(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(PROSE[:120] not in (r[1] or "") for r in odd_rows())
    assert d.contaminated(no_docs(spark), bench).collect() == []
    assert d.clean_rows(docs, bench.limit(0)).count() == len(odd_rows())


# --- main text -----------------------------------------------------------------------------------

def test_articles_of_the_pages_table(spark):
    got = {r.page_id: r for r in QUERIES["op1_html_extract"](spark, SF0001).collect()}
    for r in spark.read.parquet(f"{SF0001}/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(p.replace("<b>", "").replace("</b>", "").replace("<br>", " ")).split())
                 for p in re.split(r"</?(?:p|h1)>", article)]
        text = " ".join(p for p in parts if p)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="ad-free">
<header class="site-header"><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class="cookie-banner">We use</div>
<main><article class="post"><header><h1>Head &eacute;&#233;&#x41;</h1></header><p>One <b>two</b>three<br>four&nbsp;five
 <a href="x>y">six</a></p><!-- <p>no</p> --><script>var a="</article>";</script><div class="ad slot">buy</div>
<aside>side</aside><p>Tail &lt;b&gt; &amp;amp; &copy<ul><li>a<li>b</ul><form><input><button>Go</button></form>
<pre>x
  y</pre><section id="comments"><p>first!</p></section><footer>by</footer></article></main>
<div role="navigation">more</div><footer>end</footer></body></html>"""


def test_structure():
    assert h.main_text(PAGE, "h", [])[0] == "Head ééA One twothree four five six Tail <b> &amp; © a b x y"
    assert h.main_text("<article>a<nav>n</article>b", "h", [])[0] == "a"
    assert h.main_text("<article>a &am", "h", [])[0] == "a &am"
    assert h.main_text("<p>x < y <3 a <b", "h", [])[0] == "x < y <3 a <b"
    for empty in (None, "", "<html></html>", "<nav>x</nav>", "<!-- x", "<script>x", "<"):
        assert h.main_text(empty, "h", [])[0] in ("", "<")


def test_repeats_of_a_host_without_articles(spark):
    top, bottom = "Alpha beta gamma delta epsilon zeta eta", "Copyright one two three four five six seven"
    page = "<body><div id=top>%s</div><div><p>Unique %s text here and %s more words follow</p></div><p>%s</p></body>"
    rows = [(i, f"http://h{i // 4}.com/{i}", page % (top, w, w, bottom)) for i, w in enumerate("abcd")]
    rows += [(10, "http://other.com/x", page % (top, "z", "z", bottom)), rows[0], (None, None, None), (11, None, ""),
             (12, "http://h0.com/12", rows[1][2])]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, t string, did long")
    got = {r.page_id: r for r in h.extracted(frame).collect()}
    assert h.extracted(frame).count() == len(rows)
    assert got[0].text == "Unique a text here and a more words follow"      # its chrome is on other pages of the host
    assert got[10].text == f"{top} Unique z text here and z more words follow {bottom}"  # alone on its host
    assert got[1].text == got[12].text == f"{top} Unique b text here and b more words follow {bottom}"  # copies
    assert got[None].text == got[11].text == "" and got[11].n_chars == 0
    assert h.extracted(frame.limit(0)).collect() == []


@pytest.mark.parametrize("open_, close", [("<main>", "</main>"), ('<div role="main">', "</div>"), ("<div role=main>", "</div>")])
def test_main_only_narrows(spark, open_, close):
    notice, letter = "Alpha beta gamma delta epsilon zeta eta", "Write us your mail address for news today"
    page = (f"<body><p>outside %s alone</p>{open_}<div>{notice}</div><p>Body %s has words that only it has</p>"
            f"<div>{letter}</div>{close}</body>")
    rows = [(i, f"http://h.com/{i}", page % (w, w)) for i, w in enumerate("abc")]
    rows.append((9, "http://h.com/9", f"<main><p>{notice}</p><article><p>Own</p></article></main><article>no</article>"))
    got = {r.page_id: r.text for r in h.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Body {w} has words that only it has" for i, w in enumerate("abc")}, 9: "Own"}


BODY = "<p>The body has <b>ma</b>ny words of its own</p>"
ASIDE = '<div class="sidebar">Side words</div><div class="ad">Buy</div><nav>Home</nav>'


@pytest.mark.parametrize("page", [
    f'<form id="aspnetForm">{ASIDE}<div>{BODY}</div></form>', f'<form id="aspnetForm"><article>{BODY}</article>{ASIDE}</form>',
    f'<div class="content-sidebar-wrap"><main><article>{BODY}</article></main>{ASIDE}</div>',
    f'<div class="layout has-sidebar"><article>{BODY}</article>{ASIDE}</div><footer>end</footer>',
    f'<div class="no-sidebar"><div class="sidebar">Side</div><main>{BODY}</main></div>',
    f'<div id="page-header-fixed"><div>{BODY}</div></div>{ASIDE}',
    f'<article class="has-sidebar">{BODY}</article>{ASIDE}',
    f'<article>{BODY}</article><div class="related"><article class="card">More</article></div>',
    f'<article>{BODY}</article><section id="comments"><p>{"Readers write more than the author. " * 9}</p></section>'])
def test_wrappers_are_no_chrome(page):
    assert h.main_text(f"<html><body>{page}</body></html>", "h", [])[0] == "The body has many words of its own"


def test_a_teaser_article_does_not_decide():
    page = f'<div>{BODY}{BODY}</div><article class="card"><p>Read on</p></article>'
    assert h.main_text(page, "h", [])[0] == "The body has many words of its own " * 2 + "Read on"


# --- URLs ----------------------------------------------------------------------------------------

def slow_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host):])[0]


def slow_rule(url, rules):
    host, path = slow_parts(url)
    fits = [(len(x + y), a == "allow", a, x + y) for a, x, y in rules
            if (host == x or host.endswith("." + x)) and path.startswith(y)]
    return max(fits)[2:] if fits else (None, None)


URLS = ["HTTP://WWW.Example.COM/en/x?q#f", "https://example.com/en/", "https://example.com/en", "http://a.net/es/1",
        "http://net/fr/", "ftp://x.org", "no scheme", "", None, "http://Ünï.net/fr/é?x=1", "a://b://com/", "://net/es/",
        "http://notexample.com/en/1", "http://u:p@example.com:80/en/", "http://x.org/a?utm_source=1&b=2#z"]


@pytest.mark.parametrize("inline", [1000, 0])
def test_rules(spark, monkeypatch, inline):
    monkeypatch.setattr(u, "MAX_INLINE_RULES", inline)
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(URLS)], "i long, url string")
    got = u.with_rule(frame, spark.createDataFrame(URL_RULES, u.RULE_TYPE)).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert (r.host, r.path) == slow_parts(r.url) and (r.action, r.rule) == slow_rule(r.url, URL_RULES)


@pytest.mark.parametrize("inline", [1000, 0])
def test_equal_rules_allow(spark, monkeypatch, inline):
    monkeypatch.setattr(u, "MAX_INLINE_RULES", inline)
    rules = [("block", "a.org", "/x/"), ("allow", "a.org", "/x/"), ("block", "a.org", "/x/long"), ("allow", "org", "/")]
    frame = spark.createDataFrame([("http://a.org/x/1",), ("http://a.org/x/long/2",), ("http://b.org/",)], "url string")
    got = {r.url: (r.action, r.rule) for r in u.with_rule(frame, spark.createDataFrame(rules, u.RULE_TYPE)).collect()}
    assert got == {"http://a.org/x/1": ("allow", "a.org/x/"), "http://a.org/x/long/2": ("block", "a.org/x/long"),
                   "http://b.org/": ("allow", "org/")}


def test_block_decisions_reach_aliases(spark):
    canon = '<html><head><link href="%s" rel="canonical"></head></html>'
    pages = [(1, "http://bad.org/x", ""), (2, "http://mirror.org/y", canon % "http://bad.org/x"),
             (3, "http://third.org/z", '<meta http-equiv="refresh" content="0; url=http://mirror.org/y#a">'),
             (4, "https://third.org/z/?utm_medium=q", None), (5, "http://free.org/", '<meta property="og:url" content="/ok">'),
             (6, "http://free.org/ok", ""), (7, "http://both.org/p", canon % "http://bad.org/x2"),
             (8, "http://both.org/q", canon % "http://both.org/p"), (9, "http://good.org/r", canon % "http://both.org/p"),
             (10, None, None), (11, "nothing", ""), (12, "http://hop.org/1", ""), (1, "http://bad.org/x", ""),
             (None, "http://gone.org/", canon % "//bad.org/x?ref=1")]
    rules = spark.createDataFrame([("block", "bad.org", "/x"), ("allow", "good.org", "/")], u.RULE_TYPE)
    moved = spark.createDataFrame([("http://hop.org/1", "http://hop.org/2", 1), ("http://hop.org/2", "http://bad.org/x", 2),
                                   (None, "http://a.b/", 3)], "source string, target string, host long")
    frame = spark.createDataFrame([(*p, "clash", "n") for p in pages], "page_id long, url string, html string, host string, node string")
    rows = u.judged(frame, rules, moved).collect()
    got = {r.page_id: (r.verdict, r.via) for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == ("block", "rule") and got[9] == ("allow", "rule")
    assert all(got[i] == ("block", "alias") for i in (2, 3, 4, 12, None))
    assert all(got[i] == ("allow", "default") for i in (5, 6, 10, 11))
    assert got[7] == got[8] == ("allow", "alias")  # blocked and allowed aliases: the allowed one decides
    assert u.judged(frame.limit(0), rules).collect() == []
    assert {r.verdict for r in u.judged(frame, rules.limit(0)).collect()} == {"allow"}


def test_url_query(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF0001}/pages.parquet").collect()}
    rows = QUERIES["op6_url_filter"](spark, SF0001).collect()
    assert len(rows) == len(pages)
    for r in rows:
        action, rule = slow_rule(pages[r.page_id], URL_RULES)
        assert (r.host, r.path) == slow_parts(pages[r.page_id]) and r.rule == rule
        assert r.verdict == action if action else r.verdict in ("allow", "block")
    assert groups_by_brute_force([], []) == {}
