"""Phrase collocations, version sketches and vector codes against brute force, with every awkward row."""
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from revguard.llm import collocations as co
from revguard.llm import vector_codes as vc
from revguard.llm import version_sketch as vs
from revguard.llm.queries import QUERIES
from tests.conftest import SF0001
from tests.llm.helpers import DOCS, PROSE, no_docs, odd_docs, odd_rows

# --- phrases -------------------------------------------------------------------------------------


def slow_phrases(rows, min_count=10, max_words=3, share=50, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f.update((lang, *w[i: i + k]) for i in range(len(w) - k + 1))
    many = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    longer = collections.Counter()
    for p, a in many.items():
        for m in range(2, len(p) - 1):
            for s in range(1, len(p) - m + 1):
                longer[(p[0], *p[s: s + m])] = max(longer[(p[0], *p[s: s + m])], a)
    found = collections.defaultdict(list)
    for p, a in many.items():
        if 100 * longer[p] < share * a:
            score, k = min((10 ** 6 * a * a // (f[p[:1 + k]] * f[(p[0], *p[1 + k:])]), k) for k in range(1, len(p) - 1))
            found[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[:1 + k]], f[(p[0], *p[1 + k:])]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0])
                  for lang, v in found.items() for i, x in enumerate(sorted(v)[:top]))


def phrases(frame, **kw):
    return sorted(tuple(r) for r in co.collocations(frame, **kw).collect())


def test_phrases_query(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op11_collocations"](spark, SF0001).collect()) == slow_phrases(rows)


def test_phrases_odd_and_empty(spark):
    assert phrases(odd_docs(spark)) == slow_phrases([(r[2], r[1]) for r in odd_rows()])
    assert phrases(no_docs(spark)) == []
    texts = [(None, "A b a b a b\tA b\n a b; a b a b a b a b a b"), ("x", "é\x1cy z " * 12), ("x", None), ("x", " . , "), ("x", "a b " * 20),
             ("x", "A B. " * 9)]
    frame = spark.createDataFrame(texts, "lang string, text string")
    assert phrases(frame) == slow_phrases(texts)
    assert phrases(frame, top=2) == slow_phrases(texts, top=2)


@pytest.mark.parametrize("min_count, max_words, chunk", [(1, 2, 50), (3, 4, 200), (10, 3, 1000), (400, 3, 300)])
def test_phrases_over_many_chunks_and_shards(spark, monkeypatch, min_count, max_words, chunk):
    """Small chunks and groups: shards of unequal shares, local supports from one up, several ranges of keys."""
    monkeypatch.setattr(co, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(co, "GROUP_ENTRIES", 700)
    rng = random.Random(min_count)
    words = ["w%d" % int(rng.paretovariate(.9)) for _ in range(40)] + ["the"]
    rows = [(rng.choice(["a", "a", "a", "b", None]), " ".join(rng.choice(words) + rng.choice(["", "", "", "."])
                                                             for _ in range(rng.randint(0, 60)))) for _ in range(200)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert phrases(frame, min_count=min_count, max_words=max_words) == slow_phrases(rows, min_count, max_words)


def test_counts_are_exact_in_wide_numbers(spark):
    """Products of counts past 64 bits."""
    big = 3_000_000_000
    f = spark.createDataFrame([("x", 1, "a", big + 1), ("x", 1, "b", big + 2), ("x", 2, "a b", big)],
                              "lang string, words int, phrase string, f long")
    got = co.scored(f).collect()
    assert [(r.a, r.l, r.r, r.score) for r in got] == [(big, big + 1, big + 2, 10 ** 6 * big * big // ((big + 1) * (big + 2)))]


# --- sketches ------------------------------------------------------------------------------------

def bag(text):
    return set(collections.Counter(re.findall(r"[^.!?\n]{1,256}[.!?\n]*|[.!?\n]+", text or "")).items())


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.


def slow_versions(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        e = t[:len(t) - k] + after[:k]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), alike(bag(t), bag(e)), alike(bag(t), bag(after))))
    return out


def shown(rows):
    return sorted([(r.doc_id, r.n_chars, r.edited_sha256, pytest.approx(r.near_edited), pytest.approx(r.near_next)) for r in rows],
                  key=lambda r: r[:3])


def test_sketch_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    got = QUERIES["op12_version_sketch"](spark, SF0001).collect()
    assert shown(got) == sorted(slow_versions(rows), key=lambda r: r[:3])
    prints = collections.defaultdict(set)
    for r, (_, t) in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows)):
        prints[t or ""].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({p for v in prints.values() for p in v}) == len(prints)


def test_sketch_odd_lone_and_empty(spark):
    rows = [r for r in odd_rows() if r[0] is not None]  # the order of rows without doc_id is by digest
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    got = vs.fingerprinted(frame).collect()
    want = slow_versions([r[:2] for r in rows])
    assert sorted((r.doc_id, r.n_chars) for r in got) == sorted(r[:2] for r in want)
    mine = {(r[0], r[2]): r for r in want}
    same = [r for r in got if (r.doc_id, r.edited_sha256) in mine]
    assert len(same) == len(got)
    for r in same:
        assert (r.near_edited, r.near_next) == pytest.approx(mine[r.doc_id, r.edited_sha256][3:])
    assert vs.fingerprinted(odd_docs(spark)).count() == len(odd_rows())
    assert vs.fingerprinted(no_docs(spark)).collect() == []
    lone = vs.fingerprinted(spark.createDataFrame([(5, PROSE)], "doc_id long, text string")).first()
    k = len(PROSE) // 4
    assert lone.near_next == 1. and lone.edited_sha256 == hashlib.sha256((PROSE[:-k] + PROSE[:k]).encode()).hexdigest()


def test_peeling_recovers_digests_and_retries(spark, monkeypatch):
    """The differing digests on both sides, also where the first sketch is far too small."""
    rng = random.Random(2)
    pairs, want = [], {}
    for p in range(60):
        common = [rng.getrandbits(59) for _ in range(rng.choice([0, 3, 200]))]
        left, right = ([rng.getrandbits(59) for _ in range(rng.choice([0, 1, 2, 40, 300]))] for _ in range(2))
        pairs.append((p, common + left, right + common))
        want[p] = (len(common) + len(left), len(common) + len(right), sorted(left), sorted(right))
    frame = spark.createDataFrame(pairs, "pair long, left array<long>, right array<long>")
    got = {r["pair"]: r for r in vs.differences(frame).collect()}
    assert {p: (r.n_left, r.n_right, sorted(r.only_left), sorted(r.only_right)) for p, r in got.items()} == want
    assert {p: (r.n_only_left, r.n_only_right) for p, r in got.items()} == {p: (len(w[2]), len(w[3])) for p, w in want.items()}
    monkeypatch.setattr(vs, "TURNS", 4)  # too few turns for large differences: these are sketched again, larger
    again = vs.differences(frame, with_digests=False).collect()
    assert {r["pair"]: (r.n_only_left, r.n_only_right) for r in again} == {p: (len(w[2]), len(w[3])) for p, w in want.items()}
    assert max(r.attempts for r in again) > 1


# --- vector codes --------------------------------------------------------------------------------

def slow_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    rows = [(i, [int(np.floor(scale * float(x))) for x in v], label) for i, v, label in rows]
    if not rows:
        return []
    d = len(rows[0][1]) // parts
    cut = [[v[p * d: (p + 1) * d] for p in range(parts)] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda j: (rows[j][0] is None, rows[j][0] or 0, rows[j][1]))
    first = list({rows[j][0]: j for j in reversed(order)}.values())[::-1][:entries]
    books = [[list(cut[j][p]) for j in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for c in cut:
                own[nearest(p, c[p])[1]].append(c[p])
            for k, xs in own.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    error = [sum(x for x, _ in g) for g in got]
    per_label = collections.Counter()
    for (_, _, label), e in zip(rows, error):
        per_label[label] += e
    return [(i, "".join("%02x" % k for _, k in g), e, per_label[label], digest)
            for (i, _, label), g, e in zip(rows, got, error)]


SCHEMA = "vec_id long, embedding array<float>, label int, row long, pos int, codes string"


def codes(frame):
    return sorted((tuple(r) for r in vc.coded(frame).collect()), key=repr)


def test_codes_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF0001}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_vector_codes"](spark, SF0001).collect()), key=repr)
    assert got == sorted(slow_codes(rows), key=repr)


@pytest.mark.parametrize("n, copies", [(0, 0), (1, 0), (9, 3), (60, 40)])
def test_codes_odd(spark, n, copies):
    """Nulls and non-finite parts, other lengths, repeated rows and ids, copies, null labels, huge values."""
    rng = np.random.default_rng(n)
    good = [(i, [float(x) for x in rng.normal(0, .1, 16).astype(np.float32)], i % 3 or None) for i in range(n)]
    if n == 9:
        good.append((100, [1e4] * 8 + [-3e5] * 8, 7))   # beyond what 64-bit distances bear in a block of small values
    good += [(1000 + i, good[0][1], 1) for i in range(copies)] + good[:1] + [(None, g[1], None) for g in good[1:2]]
    bad = [(-1, None, 1), (-2, [0.] * 15 + [None], 1), (-3, [float("nan")] + [0.] * 15, 2), (-4, [float("inf")] * 16, 3), (-5, [], 3),
           (-6, [0.] * 9, 3)]
    frame = spark.createDataFrame([r + (1, 2, "x") for r in good + bad], SCHEMA).repartition(3)
    assert codes(frame) == sorted(slow_codes([r for r in good]), key=repr)


def test_shortlist_keeps_every_nearest_entry():
    rng = np.random.default_rng(0)
    for _ in range(200):
        rows, book = rng.integers(-50, 50, (20, 3)) // rng.integers(1, 30), rng.integers(-50, 50, (9, 3))
        d = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
        chosen = vc.shortlist(rows.min(axis=0), rows.max(axis=0), book)
        assert set(d.argmin(axis=1)) <= set(chosen.tolist())
        assert vc.nearest(rows, book, chosen)[0].tolist() == d.argmin(axis=1).tolist()


def test_hilbert_neighbours():
    """The curve goes through every point once, one step at a time."""
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side, indexing="ij"), axis=-1).reshape(-1, 3)
    at = vc.hilbert_index(points, 3)
    assert sorted(at.tolist()) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


# --- rows that must not be taken for others --------------------------------------------------------

def test_rows_without_id_and_equal_short_hash(spark, monkeypatch):
    """Texts whose 32-bit hash agrees keep their own bytes."""
    from revguard.llm import suffix_dedup
    a, b = "".join(random.Random(1).choices("abcdefgh", k=256)), "".join(random.Random(2).choices("abcdefgh", k=256))
    frame = spark.createDataFrame([(None, a), (None, b), (1, a), (7, b[:100]), (7, a[::-1])], "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup.F, "hash", lambda *c: F.lit(0))
    got = sorted((r.n_bytes, len(r.kept)) for r in suffix_dedup.without_repeats(frame).collect())
    assert got == [(100, 100), (256, 0), (256, 0), (256, 256), (256, 256)]


def test_near_duplicates_with_a_shared_id(spark):
    from revguard.llm import simhash
    other = " ".join(random.Random(3).choices("the quick brown fox jumps over lazy dogs by night".split(), k=60))
    rows = [(1, PROSE), (1, other), (2, PROSE), (2, "entirely different words in this one text"), (3, other), (3, other)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted([(1, PROSE), (1, other), (2, "entirely different words in this one text")])


def test_items_without_id_and_with_one_id(spark):
    from revguard.llm import decontam_tiling
    one = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    two = "river stone mountain cloud forest meadow valley summit ridge canyon"
    items = spark.createDataFrame([(None, one), (4, two), (4, one[::-1])], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {one} it is"), (2, f"here {two} there"), (3, "nothing of the kind at all")],
                                 "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.coverage) for r in decontam_tiling.contaminated(docs, items).collect()))
    assert got == [(1, None, 1.), (2, 4, 1.)]
    assert [r.doc_id for r in decontam_tiling.clean_rows(docs, items).collect()] == [3]


def test_rollup_replay_without_changes_and_late_batch(spark, tmp_path):
    from revguard.llm import token_rollup as tr
    change = lambda n: spark.createDataFrame([("s", "en", "t", None, n)],
                                             "source string, lang string, tokenizer string, before long, after long")
    store = str(tmp_path / "store")
    tr.commit(change(5), store, 1)
    tr.commit(change(5).where("false"), store, 1)
    assert tr.totals(spark, store).collect() == []
    tr.commit(change(7), store, 2)
    tr.compact(spark, store, 2)
    with pytest.raises(ValueError, match="late"):
        tr.commit(change(5), store, 1)
    tr.commit(change(1), store, 3)
    assert [r.n_tokens for r in tr.totals(spark, store).collect()] == [8]
