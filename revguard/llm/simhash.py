"""Operator 10: SimHash near duplicates by multi-index hashing.

A document's 64-bit fingerprint has a bit set where over half of its word
shingles' hashes have it.  Fingerprints link when at most ``max_distance`` bits
differ.  Equal fingerprints are one node, so copies, however many, cost nothing
further.  The fingerprint is cut into segments; with d bits over m segments, two
linked fingerprints are within d // m bits in some segment.  One side is tabled
by its segment values, the other asks for the small Hamming ball around its own
(a one-bit neighbour is asked for from the side where the bit is 0, so each pair
is met once), and the complete distance is verified inside the join.  A segment
value that more than ``dense`` fingerprints share is looked up by a second
segment as well, so that no group is compared with itself in full.  Components
of the links come from ``graph.components``.

Defined cases: no words (null, empty or blank text) gives fingerprint 0, linked
like any other; fewer words than the shingle length are one shingle; repeated
rows get one result each; a row without doc_id gets its fingerprint's component,
whose id is null if none of its rows has one; an empty table gives an empty
result; other columns are ignored (``keep_one`` returns them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revguard.llm.common import cut_lineage, pick
from revguard.llm.graph import components

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
SEGMENTS = 2
DENSE = 1024
BATCH_SHINGLES = 1 << 18


def fingerprints_of(texts: list[str | None], shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Unsigned 64-bit fingerprints of texts."""
    import xxhash
    digest, k = xxhash.xxh64_intdigest, shingle_words
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    ends: list[int] = []
    rows: list[int] = []

    def flush():
        if rows:
            h = np.array(hashes, np.uint64)
            starts = np.array([0, *ends[:-1]])
            n = np.array(ends) - starts
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            set_ = np.add.reduceat(bits, starts, axis=0, dtype=np.uint32)
            major = (2 * set_.astype(np.int64) > n[:, None]).astype(np.uint8)
            out[rows] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
        hashes.clear(), ends.clear(), rows.clear()

    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()  # bytes: ASCII white space and A-Z only
        if not words:
            continue
        if len(words) < k:
            hashes.append(digest(b" ".join(words), SEED))
        else:
            hashes.extend([digest(b" ".join(s), SEED) for s in zip(*(words[j:] for j in range(k)))])
        ends.append(len(hashes))
        rows.append(i)
        if len(hashes) >= BATCH_SHINGLES:
            flush()
    flush()
    return out


def with_fingerprint(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, th (a digest of the text), fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(2).to_pylist(), shingle_words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))],
                                             names=["doc_id", "th", "fp"])

    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), _digest(F.col("text")).alias("th"), "text")
    return source.mapInArrow(run, "doc_id long, th long, fp long")


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def _segments(fp: Column, segments: int) -> list[tuple[int, Column]]:
    """(number of the segment, its value) for each segment of a fingerprint."""
    bits = 64 // segments
    mask = F.lit((1 << bits) - 1).cast("long")
    return [(s, F.shiftrightunsigned(fp, s * bits).bitwiseAND(mask)) for s in range(segments)]


def _ball(value: Column, bits: int, radius: int, both_ways: bool = False) -> Column:
    """(key, flipped) of the value and, with radius 1, of the value with one bit set that was 0 (or any one turned)."""
    own = F.array(F.struct(value.alias("key"), F.lit(0).alias("flipped")))
    if radius == 0:
        return own
    at = F.sequence(F.lit(0), F.lit(bits - 1))
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    if not both_ways:
        at = F.filter(at, lambda b: bit(b).bitwiseAND(value) == 0)
    return F.concat(own, F.transform(at, lambda b: F.struct(
        bit(b).bitwiseXOR(value).alias("key"), F.lit(1).alias("flipped"))))


def _labelled(ball: Column, label: str, number: int, key: str) -> Column:
    """A ball's entries as structs (label, key, flipped) that carry ``number``."""
    return F.transform(ball, lambda x: F.struct(
        F.lit(number).alias(label), x["key"].alias(key), x["flipped"].alias("flipped")))


def _asked(fp: Column, segments: int, radius: int) -> Column:
    """(seg, key, flipped) of everything a fingerprint asks the tables for."""
    return F.concat(*[_labelled(_ball(value, 64 // segments, radius), "seg", s, "key")
                      for s, value in _segments(fp, segments)])


def _tabled(fp: Column, segments: int) -> Column:
    return F.array(*[F.struct(F.lit(s).alias("seg"), value.alias("key")) for s, value in _segments(fp, segments)])


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS, dense: int = DENSE) -> DataFrame:
    """(u, v, distance) for every pair of different fingerprints of ``fps`` (fp, each once) within ``max_distance``.

    A pair that is met in several segments comes once for each.
    """
    radius = max_distance // segments
    if radius > 1 or 64 % (2 * segments) or segments < 2:
        raise ValueError("max_distance must be under twice the number of segments, which must be 2 or more")
    fp = F.col("fp")
    table = fps.select(fp.alias("v"), F.explode(_tabled(fp, segments)).alias("t")).select("v", "t.seg", "t.key")
    asks = fps.select(fp.alias("u"), F.explode(_asked(fp, segments, radius)).alias("a")).select(
        "u", "a.seg", "a.key", "a.flipped")
    distance = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    # an unflipped key is met from both sides; a flipped one from the side that has the 0 bit
    once = (F.col("flipped") == 1) | (F.col("u") < F.col("v"))
    heavy = cut_lineage(table.groupBy("seg", "key").count().where(F.col("count") > dense).select("seg", "key"))
    if heavy.isEmpty():
        found = asks.join(table, ["seg", "key"]).where((distance <= max_distance) & once)
        return found.select("u", "v", distance.alias("distance"))
    light = (asks.join(heavy, ["seg", "key"], "left_anti").join(table, ["seg", "key"])
             .where((distance <= max_distance) & once).select("u", "v", distance.alias("distance")))
    # Shared by many: the other segments hold at most max_distance bits too, so one of their halves holds few.
    halves = 2 * (segments - 1)
    near, half = max_distance // halves, 32 // segments
    if near > 1:
        raise ValueError("max_distance is too large for the second look-up")

    def by_half(frame: DataFrame, name: str, radius_: int) -> DataFrame:
        rows = []
        for s, base in [(s, s * 64 // segments + h * half) for s in range(segments) for h in range(2)]:
            value = F.shiftrightunsigned(F.col(name), base).bitwiseAND(F.lit((1 << half) - 1).cast("long"))
            own = _labelled(_ball(value, half, radius_, both_ways=True), "base", base, "sub")
            rows.append(F.when(F.col("seg") != s, own).otherwise(
                F.array().cast("array<struct<base:int,sub:bigint,flipped:int>>")))
        out = frame.join(heavy, ["seg", "key"], "left_semi").withColumn("x", F.explode(F.concat(*rows)))
        return out.select(*frame.columns, "x.base", "x.sub")

    met = (by_half(asks, "u", near).join(by_half(table, "v", 0), ["seg", "key", "base", "sub"])
           .where((distance <= max_distance) & once).select("u", "v", distance.alias("distance")))
    return light.unionByName(met)


def clustered(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE,
              segments: int = SEGMENTS, dense: int = DENSE) -> DataFrame:
    """doc_id, th (a digest of the text), fp, root (the component's smallest fingerprint), component_id (the smallest doc_id
    reachable over links) of every row."""
    rows = cut_lineage(with_fingerprint(docs, shingle_words))
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps.select("fp"), max_distance, segments, dense).select("u", "v"))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = cut_lineage(named)
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(ids, "root"), "fp").select("doc_id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: the one of its smallest doc_id, once if the row is repeated.

    Of several texts that share that doc_id, the one with the smallest digest stays; texts of one doc_id in different
    components are judged each.  Rows without doc_id stay.
    """
    found = cut_lineage(clustered(docs, shingle_words, max_distance))
    texts = found.where("doc_id = component_id").groupBy("doc_id", "root", "th").agg(F.count("*").alias("n"))
    ids = texts.groupBy("doc_id", "root").agg(F.min(F.struct("th", "n")).alias("t")).select(
        F.col("doc_id").alias("__kept_id"), F.col("t.th").alias("__kept_text"), F.col("t.n").alias("__kept_rows"))
    same = (docs["doc_id"] == F.col("__kept_id")) & (_digest(docs["text"]) == F.col("__kept_text"))
    kept = docs.join(ids.hint("shuffle_hash"), same, "left")
    once = kept.where("__kept_rows = 1 or doc_id is null").select(*docs.columns)
    again = kept.where("__kept_rows > 1").dropDuplicates(["doc_id", "__kept_text"]).select(*docs.columns)
    return once.unionByName(again)
