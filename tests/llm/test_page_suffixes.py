"""The suffix array of op1: matches over all text of a host's pages, against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from revguard.llm import html_extract as h

SCHEMA = "page_id long, url string, html string"


def slow(rows):
    """(page_id, url, text, n_repeated_words) of every row, by comparing all windows of words."""
    pages = {(i, u, x or "") for i, u, x in rows}
    having, found = collections.defaultdict(set), {}
    for page in pages:
        zones, has_article = h.blocks(page[2])
        host = re.match(r"(?:.*?://([^/?#]*))?", page[1] or "")[1]
        words = [w for _, text in zones for w in text.split()]
        found[page] = zones, has_article, [(host, *words[k: k + 6]) for k in range(len(words) - 5)], len(words)
        for window in found[page][2]:
            having[window].add(page)
    out = {}
    for page, (zones, has_article, windows, n) in found.items():
        cover = [False] * n
        for k, window in enumerate(windows):
            if len(having[window]) > 1:
                cover[k: k + 6] = [True] * 6
        kept, own, at = [], [], 0
        for zone, text in zones:
            words = text.split()
            marks = "".join("01"[c] for c in cover[at: at + len(words)])
            at += len(words)
            if zone == h.DROPPED or has_article and zone != h.ARTICLE:
                continue
            own.append(text)
            if not has_article and "0" in marks:
                left = re.sub("1{12,}", lambda m: " " * len(m[0]), marks)
                kept.append(" ".join(w for w, c in zip(words, left) if c != " "))
        out[page] = " ".join(kept or own), sum(cover)
    return collections.Counter((i, u, *out[i, u, x or ""]) for i, u, x in rows)


def some_rows():
    rnd = random.Random(7)
    pool = [" ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.choice([5, 8, 30, 90, 300]))) for _ in range(20)]

    def passage():
        kind, words = rnd.random(), rnd.choice(pool).split()
        if kind < .4:
            return " ".join(words)
        if kind < .7:
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(50)}"
            return " ".join(words[rnd.randrange(4):])
        return " ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 60)))

    rows = []
    for i in range(150):
        body = "".join(f"<p>{passage()}</p>" for _ in range(rnd.randint(0, 6)))
        page = (f"<nav>Home and more of this site here</nav><div>{body}</div>" if i % 3
                else f"<article>{body}</article><div>{rnd.choice(pool)}</div>")
        rows.append((i if i % 17 else None, f"http://h{rnd.choice([0, 0, 0, 1, 2])}.com/{i}", page))
    rows += rows[:20] + rows[5:8] + [(None, None, None), (400, None, ""), (401, None, pool[3])]
    return rows + [(500, "http://h0.com/", "x y z " * 3000), (501, "http://h0.com/q", "x y z " * 200),
                   (502, "http://h9.com/", "alone here " * 3000)]


@pytest.mark.parametrize("parts", [1, 7])
def test_matches_by_brute_force(spark, parts):
    rows = some_rows()
    got = h.extracted(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    assert collections.Counter((r.page_id, r.url, r.text, r.n_repeated_words) for r in got) == slow(rows)
    assert all(r.n_chars == len(r.text) for r in got)


def test_articles_are_in_the_array(spark):
    shared = " ".join(f"s{k}" for k in range(40))
    rows = [(1, "http://a.com/1", f"<article><p>one {shared} two</p></article>"),
            (2, "http://a.com/2", f"<article><p>three {shared} four</p></article>"),
            (3, "http://a.com/3", f"<div><p>five {shared} six seven</p></div>"),
            (4, "http://b.com/3", f"<div><p>five {shared} six seven</p></div>")]
    got = {r.page_id: (r.text, r.n_repeated_words) for r in h.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (f"one {shared} two", 40), 2: (f"three {shared} four", 40),  # an article stays as it is
                   3: ("five six seven", 40),                                      # unique runs of the block
                   4: (f"five {shared} six seven", 0)}                             # alone on its host


@pytest.mark.parametrize("seed", range(20))
def test_common_prefixes_across_buckets(seed):
    rnd = random.Random(seed)
    rows = []
    for page in range(rnd.randint(1, 5)):
        words = [rnd.choice("ab") for _ in range(rnd.randint(1, 30))]
        rows += [(rnd.choice([1, 1, 1, 2]), " ".join(words[k: k + 8]) + " ", page % 2, k, page, 0, 0) for k in range(len(words))]
    rows.sort()
    cuts = sorted(rnd.randrange(len(rows) + 1) for _ in range(rnd.randint(0, 6)))
    buckets = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)]) if a < b]

    def page_of(row):
        return row[2], row[4]

    edges = []
    for k, own in enumerate(buckets):
        batch = h.pa.RecordBatch.from_arrays([h.pa.array([0]), h.pa.array([h._packed(h._suffix_batch(own))])], names=["a", "b"])
        result = list(h._sorted_bucket(iter([batch])))[0].to_pylist()
        edges.append((k, h._rows(next(r["edge"] for r in result if r["edge"]))))
    beside = h._beside(edges)
    for k, own in enumerate(buckets):
        inner = h._with_common(own)
        for row, common in zip(own, inner):
            best = max([common, *(h._likeness(row, x) for x in beside[k] if page_of(x) != page_of(row))])
            assert best == max([0, *(h._likeness(row, x) for x in rows if page_of(x) != page_of(row))])


@pytest.mark.parametrize("bits", [1, 9, 40, 63])
def test_coded_numbers(bits):
    rnd = np.random.default_rng(bits)
    for n in (1, 2, 300, 10_000):
        x = np.unique(rnd.integers(0, 1 << bits, n, dtype=np.uint64))
        assert (h.decoded(h.coded(x, bits)) == x).all()
