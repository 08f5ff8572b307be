"""Product codes of vectors by exact integer k-means over Hilbert-sorted blocks with boxes.

Every component x becomes the integer floor(scale * x) and every vector is cut into equal consecutive parts, each
position with a codebook of its own.  The parts of a position are laid out once along a Hilbert curve (one range
exchange) and cut into flat blocks of ``BLOCK`` rows that store the least and largest value and the sum of each
component.  A round compares boxes with codebook entries first: an entry whose least distance to the box exceeds the
smallest of all largest distances cannot be nearest to any row, nor tie, and leaves the block's shortlist.  A block with
one entry left adds its stored sums; otherwise a small integer kernel measures the rows against the shortlist.  All
distances, sums and means are exact: 64-bit integers where the block's and the codebook's values allow it, Python's
integers elsewhere.

A round sends one sum per position, entry and component and task; the driver holds the codebooks (parts x entries x
part length) and nothing that grows with the rows.  Equal vectors lie next to each other on the curve but are split by
row number, so no task gets a crowd of copies.

Defined cases: rows whose vector is null or holds null or non-finite components are left out, as are vectors whose length
is not the commonest one that the number of parts divides (the longest, if several are equally common).  A codebook
starts with the parts of the smallest vec_ids, each id once (of several vectors of one id the smallest, a null id last);
fewer ids give fewer entries.  Repeated rows are coded one by one.  Sums beyond 64 bits give null as error.  An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revguard.llm.common import bounded_broadcast, shuffle_width, spread_join, written

#: Rows of a block.
BLOCK = 256
#: Rows from which the curve's bins are read; they only shape the blocks, never a result.
LAYOUT_ROWS = 1024
#: Bits of a curve position.
CURVE_BITS = 56
#: Values up to this size keep every distance of up to 4096 components within 64 bits.
SMALL = 1 << 24
#: A sum is sent as high * LIMB + low.
LIMB = 1 << 90
#: Label totals of at most so many labels are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 100_000

Codebooks = list[list[list[int]]]


class Compressed(NamedTuple):
    rows: DataFrame       # row, vec_id, label, codes (entry per part), error
    codebooks: Codebooks  # by part, entry and component


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Position of each point (one row each, coordinates of ``bits`` bits) along the Hilbert curve.

    Skilling's transform: coordinates are untangled from the highest bit down, Gray-decoded, and their bits interleaved.
    """
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(dims):
            is_set = (x[i] & q) != 0
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(is_set, q - 1, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | x[i] >> b & 1
    return out


def _blobs(values: np.ndarray) -> pa.Array:
    """One binary value per row: two or four bytes a component, eight (doubles, exact integers) beyond ``SMALL``."""
    most = np.abs(values).max() if values.size else 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most <= SMALL else "<f8"
    raw = np.ascontiguousarray(values.astype(kind))
    step = raw.shape[1] * raw.itemsize
    ends = np.arange(0, step * len(raw) + 1, step, dtype=np.int32) if len(raw) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes())])


def _ints(blob: bytes, dims: int, rows: int) -> np.ndarray:
    """``rows`` x ``dims`` integers of a blob; Python's integers where they are kept as doubles."""
    kind = {2: "<i2", 4: "<i4", 8: "<f8"}[len(blob) // (dims * rows)]
    raw = np.frombuffer(blob, kind).reshape(rows, dims)
    if kind != "<f8":
        return raw.astype(np.int64)
    return np.array([[int(v) for v in r] for r in raw.tolist()], dtype=object)


def _entries(book: list[list[int]]) -> np.ndarray:
    """A codebook as an array; Python's integers where 64 bits might not do."""
    small = all(abs(v) <= SMALL for e in book for v in e)
    return np.array(book, dtype=np.int64 if small else object)


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Indexes, ascending, of the entries that can be nearest to a row of the box."""
    below, above = low - entries, entries - high
    outside = np.maximum(np.maximum(below, above), 0)
    across = np.maximum(np.abs(below), np.abs(above))
    least, most = (outside * outside).sum(axis=1), (across * across).sum(axis=1)
    return np.flatnonzero(np.asarray(least <= most.min(), dtype=bool))


def nearest(rows: np.ndarray, entries: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen entry nearest to each row (the lowest of several) and its squared distance."""
    off = rows[:, None, :] - entries[chosen][None, :, :]
    d = (off * off).sum(axis=2)
    at = d.argmin(axis=1)
    return chosen[at], d[np.arange(len(rows)), at]


def _layout(base: DataFrame, dims: int, parts: int) -> tuple[list[np.ndarray], int]:
    """Bin edges of each component and the bits of a coordinate, read from a bounded number of rows."""
    rows = base.orderBy(F.xxhash64("row"), "row").limit(LAYOUT_ROWS).select("embedding").collect()
    # the sample tells no more bins apart than it has rows, and short parts would make 2 ** 28 of them
    bits = max(1, min(CURVE_BITS // (dims // parts), LAYOUT_ROWS.bit_length() - 1))
    sample = np.array([r[0] for r in rows], np.float64)
    steps = np.arange(1, 1 << bits) / (1 << bits)
    return [np.quantile(sample[:, i], steps) for i in range(dims)], bits


def _parts(dims: int, parts: int, scale: float, edges: list[np.ndarray], bits: int) -> Callable:
    size = dims // parts
    led = min(size, CURVE_BITS // bits)  # a longer part is laid out by its first components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            values = np.floor(raw * scale)
            for p in range(parts):
                bins = np.stack([np.searchsorted(edges[p * size + i], raw[:, p * size + i], "right")
                                 for i in range(led)], axis=1) if len(raw) else np.zeros((0, led), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(raw), p, np.int32)), pa.array(hilbert_index(bins, bits)), batch.column(0),
                     _blobs(values[:, p * size: (p + 1) * size])], names=["pos", "curve", "row", "part"])
    return run


def _cut_blocks(size: int) -> Callable:
    """Sorted rows to blocks of one position each."""
    def block(pos: int, rows: list[int], blobs: list[bytes]) -> dict:
        widest = max(map(len, blobs))
        if min(map(len, blobs)) != widest:
            kind = {2: "<i2", 4: "<i4", 8: "<f8"}
            blobs = [np.frombuffer(b, kind[len(b) // size]).astype(kind[widest // size]).tobytes() for b in blobs]
        parts = b"".join(blobs)
        values = _ints(parts, size, len(rows))
        box = {k: [str(v) for v in f.tolist()] for k, f in
               (("low", values.min(axis=0)), ("high", values.max(axis=0)), ("sums", values.sum(axis=0)))}
        return {"pos": pos, "rows": rows, "parts": parts, **box}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, rows, blobs = -1, [], []
        for batch in batches:
            out = []
            for p, r, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if rows and (p != pos or len(rows) == BLOCK):
                    out.append(block(pos, rows, blobs))
                    rows, blobs = [], []
                pos = p
                rows.append(r)
                blobs.append(b)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=BLOCK_SCHEMA)
        if rows:
            yield pa.RecordBatch.from_pylist([block(pos, rows, blobs)], schema=BLOCK_SCHEMA)
    return run


BLOCK_SCHEMA = pa.schema([("pos", pa.int32()), ("rows", pa.list_(pa.int64())), ("parts", pa.binary()),
                          *((k, pa.list_(pa.string())) for k in ("low", "high", "sums"))])
BLOCK_TYPE = "pos int, rows array<long>, parts binary, low array<string>, high array<string>, sums array<string>"


def _box(texts: list[str], dtype) -> np.ndarray:
    values = [int(t) for t in texts]
    return np.array(values, dtype=dtype if all(abs(v) <= SMALL for v in values) else object)


def _round(books: Codebooks, size: int) -> Callable:
    """Counts and sums of the rows that each entry is nearest to, added up over a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [_entries(b) for b in books]
        counts: dict[tuple[int, int], int] = {}
        sums: dict[tuple[int, int], np.ndarray] = {}

        def add(pos: int, entry: int, n: int, values: list[int]) -> None:
            key = pos, entry
            counts[key] = counts.get(key, 0) + n
            sums[key] = np.array(values, dtype=object) + sums.get(key, 0)

        for batch in batches:
            pos_, n_, parts_, low_, high_, sums_ = (c.to_pylist() for c in batch.columns)
            for pos, n, parts, low, high, total in zip(pos_, n_, parts_, low_, high_, sums_):
                book = entries[pos]
                chosen = shortlist(_box(low, np.int64), _box(high, np.int64), book)
                if len(chosen) == 1:
                    add(pos, int(chosen[0]), n, [int(t) for t in total])
                    continue
                rows = _ints(parts, size, n)
                at, _ = nearest(rows, book, chosen)
                for e in np.unique(at).tolist():
                    own = rows[at == e]
                    add(pos, e, len(own), own.sum(axis=0).tolist())
        keys = [(p, e, i) for p, e in sums for i in range(size)]
        split = [divmod(int(sums[p, e][i]), LIMB) for p, e, i in keys]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[j] for k in keys], pa.int32()) for j in range(3)),
             pa.array([counts[k[:2]] for k in keys], pa.int64()),
             *(pa.array([str(s[j]) for s in split], pa.string()) for j in range(2))],
            names=["pos", "entry", "i", "n", "high", "low"])
    return run


def _assign(books: Codebooks, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [_entries(b) for b in books]
        for batch in batches:
            pos_, rows_, parts_, low_, high_ = (c.to_pylist() for c in batch.columns)
            for pos, ids, parts, low, high in zip(pos_, rows_, parts_, low_, high_):
                chosen = shortlist(_box(low, np.int64), _box(high, np.int64), entries[pos])
                at, d = nearest(_ints(parts, size, len(ids)), entries[pos], chosen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.full(len(ids), pos, np.int32)), pa.array(at.astype(np.int32)),
                     pa.array([x if x < 1 << 63 else None for x in d.tolist()], pa.int64())],
                    names=["row", "pos", "entry", "distance"])
    return run


def _next_books(books: Codebooks, blocks: DataFrame, size: int) -> Codebooks:
    part = blocks.select("pos", F.size("rows").alias("n"), "parts", "low", "high", "sums")
    sums = (part.mapInArrow(_round(books, size), "pos int, entry int, i int, n long, high string, low string")
            .groupBy("pos", "entry", "i").agg(F.sum("n").alias("n"), *(
                F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))))
    new = [[list(e) for e in b] for b in books]
    for r in sums.collect():  # one row per component of the codebooks
        new[r["pos"]][r["entry"]][r["i"]] = (int(r["high"]) * LIMB + int(r["low"])) // r["n"]
    return new


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Compressed | None:
    """Codes and codebooks of (vec_id, embedding, label); None where no vector is left."""
    spark = vectors.sparkSession
    v = vectors["embedding"]
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = written(vectors.where(v.isNotNull() & ~bad).select(
        F.monotonically_increasing_id().alias("row"), vectors["vec_id"], vectors["label"], v.alias("embedding")), "vectors")
    length = F.size("embedding")
    commonest = (base.where((length > 0) & (length % parts == 0)).groupBy(length.alias("dims")).count()
                 .orderBy(F.desc("count"), F.desc("dims")).first())
    if commonest is None:
        return None
    dims = commonest["dims"]
    size = dims // parts
    base = base.where(length == dims)

    ids = [r[0] for r in base.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    given = [i for i in ids if i is not None]
    mine = F.col("vec_id").isin(given) if None not in ids else F.col("vec_id").isin(given) | F.col("vec_id").isNull()
    first = base.where(mine).groupBy("vec_id").agg(F.min("embedding").alias("v")).orderBy(F.asc_nulls_last("vec_id"))
    starts = np.floor(np.array([r["v"] for r in first.collect()], np.float64) * scale)  # at most ``entries`` rows
    books = [[[int(x) for x in s[p * size: (p + 1) * size]] for s in starts] for p in range(parts)]

    edges, bits = _layout(base, dims, parts)
    blocks = written(
        base.select("row", "embedding").mapInArrow(_parts(dims, parts, scale, edges, bits), "pos int, curve long, row long, part binary")
        .repartitionByRange(shuffle_width(spark), "pos", "curve", "row").sortWithinPartitions("pos", "curve", "row")
        .select("pos", "row", "part").mapInArrow(_cut_blocks(size), BLOCK_TYPE), "blocks")
    for _ in range(rounds):
        books = _next_books(books, blocks, size)
    assigned = blocks.select("pos", "rows", "parts", "low", "high").mapInArrow(
        _assign(books, size), "row long, pos int, entry int, distance long")
    each = assigned.groupBy("row").agg(
        *(F.max(F.when(F.col("pos") == p, F.col("entry"))).alias(f"e{p}") for p in range(parts)),
        F.when(F.count("distance") == parts, F.try_sum("distance")).alias("error"))
    rows = base.select("row", "vec_id", "label").join(each, "row").select(
        "row", "vec_id", "label", F.array(*(f"e{p}" for p in range(parts))).alias("codes"), "error")
    return Compressed(rows, books)


def codebooks_digest(books: Codebooks) -> str:
    """SHA-256 of all components as decimal integers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``, the errors summed over equal labels (nulls together; null beyond 64 bits)."""
    keyed = written(rows.withColumn("label_key", F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("n"))),
                    "codes")
    sums = written(keyed.groupBy("label_key").agg(
        F.count("*").alias("n"),
        F.when(F.count("*") == F.count("error"), F.try_sum("error")).alias("label_error")), "label-errors")
    table = bounded_broadcast(sums, BROADCAST_LABELS)
    joined = keyed.join(table, "label_key") if table is not sums else spread_join(keyed, sums, "label_key", "n")
    return joined.drop("label_key", "n")


def label_schema(vectors: DataFrame) -> str:
    return f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"


def coded(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code (two hex digits per part), error, label_error, codebooks_sha256 of every kept vector."""
    found = compress(vectors, **options)
    if found is None:
        return vectors.sparkSession.createDataFrame([], label_schema(vectors))
    code = F.array_join(F.transform("codes", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    return with_label_error(found.rows).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks_digest(found.codebooks)).alias("codebooks_sha256"))
