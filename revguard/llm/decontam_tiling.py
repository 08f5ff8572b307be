"""Operator 9: benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased.  Every run of ``MIN_MATCH``
words of a document whose Karp-Rabin hash, and then whose words, a benchmark
item has too is a seed: (document, item, place in each).  Seeds that follow each
other in both make a match; per document and item the longest match that
overlaps no marked word is marked again and again until none of ``MIN_MATCH``
words is left, and the share of the item's words under tiles is its coverage.  A
passage that was cut up and reordered still covers the item.  A document is
contaminated by an item at coverage ``MIN_COVERAGE`` or more.

The item seeds go to the tasks if they are at most ``BROADCAST_SEEDS`` (counted
first); a larger benchmark is joined to all document seeds by shuffle.  Tiling
is grouped by document and item, so one item that very many documents quote is
spread like any other.

Defined cases: a null or empty text has no words; items under ``MIN_MATCH``
words have no seeds and match nothing; items without item_id, and several of one
item_id, are tiled by their texts; a null doc_id stays null; rows that are
alike in doc_id and text give one result; an empty documents or benchmark table
gives an empty result; other columns are ignored (``clean_rows`` returns them).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revguard.llm.common import cut_lineage, pick

MIN_MATCH = 5
MIN_COVERAGE = 0.5
BROADCAST_SEEDS = 2_000_000
CHUNK_CHARS = 1 << 21
WORD = re.compile(r"[^\W_]+")
MULTIPLIER = 0xD1342543DE82EF95
SEED_COLUMNS = "did long, null_id boolean, th long, at int, seed long, gram string"


# --- words and seeds -----------------------------------------------------------------------------

def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def seeds(texts: list[str | None], k: int = MIN_MATCH) -> Iterator[tuple]:
    """(word lists, text number, place, rolling hash) of every run of ``k`` words.

    Texts are split into words about CHUNK_CHARS characters at a time; the text numbers count within the word lists
    and begin at the fifth value.
    """
    import xxhash
    digest, first = xxhash.xxh3_64_intdigest, 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (size < CHUNK_CHARS or last == first):
            size += len(texts[last] or "")
            last += 1
        split = [words(t) for t in texts[first:last]]
        n = np.array([len(t) for t in split])
        own = np.fromiter((digest(w) for t in split for w in t), np.uint64, int(n.sum()))
        if len(own) >= k:
            rolled = own[: len(own) - k + 1].copy()
            for j in range(1, k):
                rolled = rolled * np.uint64(MULTIPLIER) + own[j: len(own) - k + 1 + j]
            text = np.repeat(np.arange(len(n)), n)
            whole = np.flatnonzero(text[: len(rolled)] == text[k - 1:])
            starts = np.cumsum(n) - n
            yield split, text[whole], whole - starts[text[whole]], rolled[whole], first
        first = last


def item_seeds(benchmark: DataFrame, k: int = MIN_MATCH) -> DataFrame:
    """seed, gram, item_id, item_key, item_words, item_at of every run of ``k`` words of every item.

    ``item_key`` is a digest of the item's text, so that items without item_id, or with the same, are told apart.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every_id, every_key = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for items, text, at, seed, first in seeds(batch.column(2).to_pylist(), k):
                ids, keys = every_id[first:], every_key[first:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed.view(np.int64)),
                     pa.array([" ".join(items[t][a: a + k]) for t, a in zip(text, at)], pa.string()),
                     pa.array([ids[t] for t in text], pa.int64()), pa.array([keys[t] for t in text], pa.int64()),
                     pa.array([len(items[t]) for t in text], pa.int32()), pa.array(at.astype(np.int32))],
                    names=["seed", "gram", "item_id", "item_key", "item_words", "item_at"])
    source = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("long"), F.xxhash64("text").alias("key"), "text")
    return source.mapInArrow(run, "seed long, gram string, item_id long, item_key long, item_words int, item_at int")


def _document_seeds(wanted: np.ndarray | None, k: int):
    """Tasks that list document seeds: all, or those with a hash in the sorted ``wanted``."""
    if wanted is not None:
        bits = 20
        maybe = np.zeros(1 << bits, bool)
        maybe[wanted >> np.uint64(64 - bits)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, null_id, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for texts, text, at, seed, first in seeds(batch.column(3).to_pylist(), k):
                if wanted is not None:
                    near = np.flatnonzero(maybe[seed >> np.uint64(64 - bits)])
                    found = np.searchsorted(wanted, seed[near])
                    near = near[wanted[np.minimum(found, len(wanted) - 1)] == seed[near]]
                    text, at, seed = text[near], at[near], seed[near]
                row = first + text
                yield pa.RecordBatch.from_arrays(
                    [pa.array(did[row]), pa.array(null_id[row]), pa.array(th[row]),
                     pa.array(at.astype(np.int32)), pa.array(seed.view(np.int64)),
                     pa.array([" ".join(texts[t][a: a + k]) for t, a in zip(text, at)], pa.string())],
                    names=["did", "null_id", "th", "at", "seed", "gram"])
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    own = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return own.select(F.coalesce("doc_id", F.lit(0)).alias("did"), F.col("doc_id").isNull().alias("null_id"),
                      F.xxhash64("text").alias("th"), "text")


def shared_seeds(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH,
                 broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Every seed that a document shares with an item, with its place in both."""
    items = cut_lineage(item_seeds(benchmark, k))
    small = items.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    wanted = None
    if small:
        found = items.select("seed").distinct().toPandas()["seed"]  # at most broadcast_seeds numbers
        wanted = np.sort(found.to_numpy(np.int64).view(np.uint64))
        if not len(wanted):
            wanted = np.zeros(1, np.uint64)
    listed = _keyed(docs).mapInArrow(_document_seeds(wanted, k), SEED_COLUMNS)
    return listed.join(F.broadcast(items) if small else items, ["seed", "gram"]).drop("seed", "gram")


# --- tiling --------------------------------------------------------------------------------------

def tiles(doc_at: np.ndarray, item_at: np.ndarray, k: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in the document, place in the item, words) of each tile, longest first."""
    order = np.lexsort((item_at, doc_at - item_at))
    d, i = doc_at[order].astype(np.int64), item_at[order].astype(np.int64)
    new = np.concatenate([[True], (np.diff(d - i) != 0) | (np.diff(i) != 1)])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(d))) + k - 1
    queue = [(-int(n), int(d[b]), int(i[b])) for b, n in zip(begin, size)]
    heapq.heapify(queue)
    doc_marked: set[int] = set()
    item_marked: set[int] = set()
    out = []
    while queue:
        n, a, b = heapq.heappop(queue)
        free = [j for j in range(-n) if a + j not in doc_marked and b + j not in item_marked]
        if len(free) == -n:
            out.append((a, b, -n))
            doc_marked.update(range(a, a - n))
            item_marked.update(range(b, b - n))
            continue
        # what earlier tiles leave of the match, where it is still long enough
        start = 0
        for j in range(1, len(free) + 1):
            if j == len(free) or free[j] != free[j - 1] + 1:
                if j - start >= k:
                    heapq.heappush(queue, (start - j, a + free[start], b + free[start]))
                start = j
    return out


def tiled(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Coverage of every item that shares a seed with a document: doc_id, th (a key of the text), item_id, item_words,
    covered_words, n_tiles, longest_tile, coverage."""
    def run(table: pa.Table) -> pa.Table:
        pairs = np.unique(np.stack([table.column(x).to_numpy() for x in ("at", "item_at")]), axis=1)
        found = tiles(pairs[0], pairs[1], k)
        covered = sum(n for _, _, n in found)
        words_ = table.column("item_words")[0].as_py()
        key = [table.column(x)[0].as_py() for x in ("did", "null_id", "th", "item_id")]  # and item_key
        return pa.table({
            "doc_id": pa.array([None if key[1] else key[0]], pa.int64()), "th": pa.array([key[2]], pa.int64()),
            "item_id": pa.array([key[3]], pa.int64()), "item_words": pa.array([words_], pa.int64()),
            "covered_words": pa.array([covered], pa.int64()), "n_tiles": pa.array([len(found)], pa.int64()),
            "longest_tile": pa.array([max(n for _, _, n in found)], pa.int64()),
            "coverage": pa.array([covered / words_], pa.float64())})

    return (shared_seeds(docs, benchmark, k, broadcast_seeds).groupBy("did", "null_id", "th", "item_id", "item_key")
            .applyInArrow(run, "doc_id long, th long, item_id long, item_words long, covered_words long, "
                               "n_tiles long, longest_tile long, coverage double"))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, k: int = MIN_MATCH,
                 broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """The rows of ``tiled`` at ``min_coverage`` or more."""
    return tiled(docs, benchmark, k, broadcast_seeds).where(F.col("coverage") >= min_coverage)


def clean_rows(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    bad = cut_lineage(contaminated(docs, benchmark, min_coverage).select(
        F.col("doc_id").alias("__bad_id"), F.col("th").alias("__bad_th")).distinct()).hint("shuffle_hash")
    same = docs["doc_id"].eqNullSafe(F.col("__bad_id")) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__bad_th"))
    return docs.join(bad, same, "left_anti")
