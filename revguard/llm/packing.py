"""Operator 3: packing by shortest-pack-first over the length histogram.

Every document is encoded and cut into pieces of the sequence length and one
rest.  Only the histogram of piece lengths (at most one entry per length)
reaches the driver, where ``pack_histogram`` places lengths longest first, each
into the packs with the most space left, keeping a count per packing pattern
instead of single packs.  A pattern that occurs c times with k pieces of a
length takes k runs of c ranks of that length, so a piece finds its sequence
from its rank among the pieces of its length.

Ranks need no global order: the pieces are checkpointed, counted per partition
and length, and numbered inside each partition; a length that a third of all
pieces share is spread over as many partitions as hold them.

Defined cases: a null or empty text is one piece that holds only the end id;
repeated rows are packed once each; a null doc_id stays null; an empty table
gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revguard.llm.common import cut_lineage, pick
from revguard.llm.tokens import END_ID, TextEncoder

SEQUENCE_LENGTH = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_path: str, sequence_length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Each document's ids and the end id, cut every ``sequence_length`` ids: one row per piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(tokenizer_path)
        for batch in batches:
            ids, before = encoder.encode(batch.column(1))
            doc, start, length, crc, total = [], [], [], [], []
            for d, a, b in zip(batch.column(0).to_pylist(), before[:-1].tolist(), before[1:].tolist()):
                own = np.append(ids[a:b], END_ID).astype("<u4")
                for s in range(0, len(own), sequence_length):
                    part = own[s: s + sequence_length]
                    doc.append(d)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    source = pick(docs, "doc_id", "text")
    return source.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def pack_histogram(counts: dict[int, int], sequence_length: int = SEQUENCE_LENGTH) -> list[tuple[list[int], int]]:
    """Packing patterns (piece lengths, how many packs have it) for a histogram length -> count.

    Lengths go longest first; each goes to the pattern with the most space left
    that holds it, which splits when fewer pieces are left than it has packs.
    Where nothing holds the length, new packs open with as many pieces as fit.
    """
    by_space: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []
    full: list[tuple[list[int], int]] = []

    def put(pattern: tuple[int, ...], n: int, space: int) -> None:
        if space == 0:
            full.append((list(pattern), n))
            return
        if not by_space.get(space):
            heapq.heappush(spaces, -space)
        by_space.setdefault(space, []).append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while spaces and not by_space.get(-spaces[0]):
                heapq.heappop(spaces)
            most = -spaces[0] if spaces else 0
            if most < length:
                fits = sequence_length // length
                if left >= fits:
                    put((length,) * fits, left // fits, sequence_length - fits * length)
                    left %= fits
                else:
                    put((length,) * left, 1, sequence_length - left * length)
                    left = 0
                continue
            pattern, n = by_space[most].pop()
            take = min(n, left)
            if n > take:
                put(pattern, n - take, most)
            put(pattern + (length,), take, most - length)
            left -= take
    return full + [(list(p), n) for some in by_space.values() for p, n in some]


def slots(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For every length, runs of ranks: rank first .. first + n go to sequences from ``sequence`` on at ``offset``."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in sorted(patterns, key=lambda p: (p[0], p[1]), reverse=True):
        offset = 0
        for length in pattern:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + n
            offset += length
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def ranked(parts: DataFrame) -> DataFrame:
    """Adds ``rank``: 0, 1, 2 ... among the rows of one length.  ``parts`` must be materialised."""
    placed = parts.withColumn("pid", F.spark_partition_id())
    before = (placed.groupBy("length", "pid").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(
                  Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)))
              .select("length", "pid", F.coalesce("before", F.lit(0)).alias("before")))
    inside = F.row_number().over(Window.partitionBy("length", "pid").orderBy("doc_id", "start", "ids_crc32"))
    return (placed.withColumn("inside", inside).join(before, ["length", "pid"])
            .withColumn("rank", F.col("before") + F.col("inside") - 1).drop("pid", "before", "inside"))


def pack(docs: DataFrame, tokenizer_path: str, sequence_length: int = SEQUENCE_LENGTH) -> DataFrame:
    """All documents packed: one row per piece with its sequence and its offset in it."""
    parts = cut_lineage(pieces(docs, tokenizer_path, sequence_length))
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # one row per length
    runs = slots(pack_histogram(counts, sequence_length))
    n_lengths = sequence_length + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # runs are sorted by length, then first rank: find the last run that begins at or before a piece's rank
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            if not len(length):
                continue
            bounds = np.searchsorted(runs["length"], np.arange(n_lengths + 1))
            run = np.empty(len(length), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                lo, hi = bounds[value], bounds[value + 1]
                run[at] = lo + np.searchsorted(runs["first"][lo:hi], rank[at], side="right") - 1
            sequence = runs["sequence"][run] + rank - runs["first"][run]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(runs["offset"][run])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return (ranked(parts).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
            .mapInArrow(place, PIECES + ", sequence_id long, offset long"))
