import hashlib
import random

import numpy as np
import pytest
import xxhash

from revguard.llm import simhash, suffix_dedup
from revguard.llm.graph import components
from revguard.llm.queries import QUERIES
from tests.conftest import SF0001
from tests.llm.helpers import (groups_by_brute_force, no_docs, odd_docs, odd_rows, removed_by_brute_force, words)


def slow_fingerprint(text, k=3):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i: i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_pairs(fps, distance=3):
    f = np.array(sorted(fps), np.uint64)
    return {(int(f[i]), int(f[j])) for i in range(len(f))
            for j in i + 1 + np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1:]) <= distance)}


def expected_components(rows):
    """Per row (doc_id, text): its fingerprint and the smallest doc_id reachable."""
    fp = [slow_fingerprint(t) for _, t in rows]
    root = groups_by_brute_force(near_pairs(set(fp)), set(fp))
    smallest = {}
    for (d, _), f in zip(rows, fp):
        if d is not None:
            smallest[root[f]] = min(d, smallest.get(root[f], d))
    return [(d, f, smallest.get(root[f])) for (d, _), f in zip(rows, fp)]


def test_fingerprints_bit_by_bit():
    texts = ["", None, "a", "A b", "a b c", "The cat sat on the mat", "É x\x1cy z", "x " * 100, "one two three four " * 9]
    assert [int(x) for x in simhash.fingerprints_of(texts)] == [slow_fingerprint(t) for t in texts]


def test_components_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    got = {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in QUERIES["op10_simhash"](spark, SF0001).collect()}
    assert got == set(expected_components(rows))


def test_components_odd_and_empty(spark):
    rows = [r[:2] for r in odd_rows()]
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.clustered(odd_docs(spark)).collect()]
    assert sorted(got, key=repr) == sorted(expected_components(rows), key=repr)
    assert simhash.clustered(no_docs(spark)).collect() == []


@pytest.mark.parametrize("dense", [1024, 3, 0])
def test_links_of_a_crowd(spark, dense):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(250)}
    fps |= {rng.getrandbits(64) for _ in range(50)}
    frame = spark.createDataFrame([(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in fps], "fp long")
    found = simhash.links(frame, dense=dense).collect()
    assert {tuple(sorted((r.u % 2**64, r.v % 2**64))) for r in found} == near_pairs(fps)
    assert all(r.distance == (r.u % 2**64 ^ r.v % 2**64).bit_count() for r in found)


def test_keep_one(spark):
    docs = odd_docs(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    expected = {c for d, _, c in expected_components([r[:2] for r in odd_rows()]) if c is not None}
    assert sorted(x for x in ids if x is not None) == sorted(expected) and ids.count(None) == 2
    assert simhash.keep_one(no_docs(spark)).count() == 0


def test_graph_shapes(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 150)]
    loose = [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    pairs = chain + star + loose
    rng.shuffle(pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == groups_by_brute_force(pairs, nodes)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


# --- repeated byte strings -----------------------------------------------------------------------

def digest(rows):
    return sorted((r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows)


def test_suffix_query(spark):
    rows = spark.read.parquet(f"{SF0001}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op4_suffix_dedup"](spark, SF0001).collect()}
    expected = removed_by_brute_force([r.text for r in rows])
    assert got == {r.doc_id: e for r, e in zip(rows, expected)}
    assert sum(e[1] for e in expected) > 0


def test_suffix_overlaps_periods_and_odd_rows(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcd é") for _ in range(400)) for _ in range(6)]
    texts = ["a" * 700, "ab" * 300, "x" * 199, "x" * 200, None, "", "x" * 200, base[0] * 3]
    for _ in range(60):
        s = ""
        for _ in range(rng.randint(1, 5)):
            b, i = rng.choice(base), rng.randint(0, 200)
            s += b[i: i + rng.randint(100, 320)]
            if rng.random() < .4:
                s += "".join(rng.choice("abcd é") for _ in range(rng.randint(0, 30)))
        texts.append(s)
    rows = [(None if i == 9 else 19 if i == 20 else i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(suffix_dedup.without_repeats(frame).collect()) == sorted(removed_by_brute_force(texts))


def test_suffix_odd_and_empty(spark):
    got = digest(suffix_dedup.without_repeats(odd_docs(spark)).collect())
    assert got == sorted(removed_by_brute_force([r[1] for r in odd_rows()]))
    assert suffix_dedup.without_repeats(no_docs(spark)).collect() == []


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 256)
    rng = random.Random(9)
    a = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    texts = [a, "zz" + a[500:1700] + "yy", a[2000:2300].encode().decode(), "q" * 2000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = list(suffix_dedup.runs([t.encode() for t in texts]))
    assert sum(int(n.sum()) for _, _, _, _, n, _, _ in rows) == sum(max(0, len(t) - 199) for t in texts)
    assert digest(suffix_dedup.without_repeats(frame).collect()) == sorted(removed_by_brute_force(texts))


def test_multikey_order():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 4, 500), rng.integers(0, 3, 500), rng.integers(0, 50, 500)]
    order = suffix_dedup.multikey_order(keys)
    assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*keys))


def test_splitters_know_a_long_periodic_text(spark):
    """One text of dashes has most of the rows, each of the same token: most splitters are in it."""
    texts = ["".join(random.Random(i).choices("abcdefgh ", k=202)) for i in range(6000)]
    rows = [(i, 1, t) for i, t in enumerate(texts)] + [(10 ** 6, 1, "-" * 150_000)]
    source = spark.createDataFrame(rows, "did long, th int, text string")
    found = suffix_dedup._splitters(source, suffix_dedup._run_rows(200, 32), 64)
    hot = next(suffix_dedup.runs([b"-" * 300]))[6].view(np.int64)[0]
    assert len(found) == 63 and sum(t == hot for t, _, _, _ in found) >= 50
