"""Operator 4: removal of repeated byte strings through a range-partitioned, sparse suffix array.

A byte goes if a string of ``width`` bytes that covers it starts anywhere else,
in the same document or another; strings never cross documents and are judged on
the input.

Sorting every suffix of a corpus would ship ``width`` bytes for each input byte.
Suffixes are therefore sorted by leading tokens that get longer, and only the
suffixes that still tie go on, as in multikey quicksort:

1. The leading token of a window (a suffix cut at ``width`` bytes) is the
   leftmost of its ``anchor``-byte strings with the least hash.  Equal windows
   have equal tokens at equal places.  Windows that follow each other and share
   the token's occurrence make one run, the unit of the first level.
2. Runs of one token that differ are cut into blocks of ``BLOCKS[0]`` windows,
   aligned at the token; a block's token is the core all its windows contain.
3. Blocks of one core that differ are cut into smaller ones, down to windows.

Each level is one suffix sort (``tied``): rows (token, content) are
range-partitioned at splitters from a sample of the rows, with the place as the
last key so that no token, however frequent, fills a bucket; each bucket sorts
locally, key by key within ties, and compares neighbours; groups that reach
across bucket boundaries are settled from two rows per bucket.  Rows whose
content another row has are repeated; rows whose token nobody shares are not;
rows that share the token but not the content, and one row of each content
beside them, go on.  Tokens and contents are 64-bit fingerprints each, compared
together.  The sample only balances buckets; every suffix is sorted.

Defined cases: a null text is empty; texts under ``width`` bytes keep all; a row
without doc_id takes part like any other; repeated rows repeat each other in
full; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revguard.llm.common import pick, shuffle_width, written

WIDTH = 200
ANCHOR = 32
BLOCKS = (32, 8, 1)
CHUNK = 1 << 18  # window starts that are hashed at once
TASK_ROWS = 4000  # of a task in the sample
SAMPLE_ROWS = 500_000
ROW = "t long, c long, did long, th int, lo int, n int, home int"
POSITION_BITS = 24
MASK64 = (1 << 64) - 1
MULTIPLIER = 0xD6E8FEB86659FD93


# --- hashing -------------------------------------------------------------------------------------

@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(MULTIPLIER, n, 1 << 64))


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Polynomial hashes of all strings of 1, 2, 4 ... bytes of a buffer, and of any length at chosen places."""

    def __init__(self, data: np.ndarray, longest: int):
        self.by_length = {1: _byte_values()[data]}
        length = 1
        while 2 * length <= longest and 2 * length <= len(data):
            h = self.by_length[length]
            self.by_length[2 * length] = h[:-length] * _power(length) + h[length:]
            length *= 2

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        out, done = np.zeros(len(places), np.uint64), 0
        for size in sorted(self.by_length, reverse=True):
            while length - done >= size:
                out = out * _power(size) + self.by_length[size][places + done]
                done += size
        return out


def _joined(texts: list[bytes], width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about CHUNK bytes: (bytes, text number of each piece, its first byte in the text, its end here).

    A longer text is cut into pieces that overlap by ``width`` - 1 bytes, so each window lies in one piece.
    """
    out, own, size = [], [], 0

    def close():
        if own:
            ends = np.cumsum([len(p) for _, _, p in own])
            out.append((np.frombuffer(b"".join(p for _, _, p in own), np.uint8), np.array([i for i, _, _ in own]),
                        np.array([s for _, s, _ in own]), ends))

    for i, text in enumerate(texts):
        for s in range(0, max(1, len(text) - width + 1), CHUNK):
            piece = text[s: s + CHUNK + width - 1]
            if len(piece) < width:
                continue
            if size + len(piece) > 2 * CHUNK:
                close()
                own, size = [], 0
            own.append((i, s, piece))
            size += len(piece)
    close()
    return out


def runs(texts: list[bytes], width: int = WIDTH, anchor: int = ANCHOR) -> Iterator[tuple]:
    """(hashes, text number, place in the text, place in the buffer, windows, distance to the token, token) arrays."""
    for data, owner, begins, ends in _joined(texts, width):
        hashes = Hashes(data, width)
        grams = len(data) - anchor + 1
        token = _mix(hashes.at(np.arange(grams), anchor))
        place = np.arange(grams, dtype=np.uint64)
        least = (token & np.uint64(MASK64 ^ ((1 << POSITION_BITS) - 1))) | place
        span, reach = width - anchor + 1, 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: len(least) - (span - reach)], least[span - reach:])
        starts = np.concatenate([[0], ends[:-1]])
        piece = np.repeat(np.arange(len(ends)), ends - starts)[: len(least)]
        valid = np.arange(len(least)) + width <= ends[piece]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (piece[1:] != piece[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(least)))
        keep = valid[first]
        first, n = first[keep], n[keep]
        at = (least[first] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
        p = piece[first]
        yield hashes, owner[p], first - starts[p] + begins[p], first, n, at - first, token[at]


def _content(hashes: Hashes, first: np.ndarray, n: np.ndarray, ahead: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of a run of windows: its first and last window (which cover it), its length and its alignment."""
    a, b = hashes.at(first, width), hashes.at(first + n - 1, width)
    return _mix(_mix(a) * np.uint64(0x9E3779B97F4A7C15) ^ _mix(b, 0x5851F42D4C957F2D)
                ^ (n.astype(np.uint64) << np.uint64(32)) ^ ahead.astype(np.uint64))


def row_batch(cols: list[list[np.ndarray]]) -> pa.RecordBatch:
    types = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, np.int32)
    arrays = []
    for col, kind in zip(cols, types):
        x = np.concatenate(col) if col else np.zeros(0, kind)
        arrays.append(pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(kind)))
    return pa.RecordBatch.from_arrays(arrays, names=["t", "c", "did", "th", "lo", "n", "home"])


# --- the three kinds of rows ---------------------------------------------------------------------

def _run_rows(width: int, anchor: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for hashes, owner, lo, first, n, ahead, token in runs(texts, width, anchor):
                yield row_batch([[token], [_content(hashes, first, n, ahead, width)], [did[owner]], [th[owner]], [lo],
                              [n], [lo]])
    return rows


def _block_rows(width: int, anchor: int, block: int):
    """Fragments (one run each) and the places to look at -> their blocks, aligned at the token."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            wanted = batch.column(4).to_pylist()
            for hashes, owner, lo, first, n, ahead, token in runs(batch.column(3).to_pylist(), width, anchor):
                # the wanted part of each run (a fragment holds one run, or more where its text was cut)
                at, size, src = [], [], []
                for k, (o, a, m) in enumerate(zip(owner.tolist(), lo.tolist(), n.tolist())):
                    for w in wanted[o]:
                        begin = max(w["lo"] - int(home[o]), a)
                        end = min(w["lo"] - int(home[o]) + w["n"], a + m)
                        if begin < end:
                            at.append(begin - a)
                            size.append(end - begin)
                            src.append(k)
                if not at:
                    continue
                at, size, src = (np.array(x) for x in (at, size, src))
                start, token_at = first[src] + at, (first + ahead)[src]
                # a window's distance to the token falls by one from window to window
                far_end, near_end = token_at - start, token_at - start - size + 1
                top, low = far_end // block, near_end // block
                pieces = top - low + 1
                of = np.repeat(np.arange(len(at)), pieces)
                number = top[of] - (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                far = np.minimum(far_end[of], number * block + block - 1)
                near = np.maximum(near_end[of], number * block)
                # the core: from the block's last window start to its first window's end
                core = hashes.at(token_at[of] - number * block, width - block + 1)
                run = src[of]
                t = _mix(_mix(core) ^ _mix(token[run] ^ number.astype(np.uint64)) * np.uint64(3))
                begin, count = token_at[of] - far, far - near + 1
                doc = owner[run]
                place = home[doc] + lo[run] + begin - first[run]
                yield row_batch([[t], [_content(hashes, begin, count, far, width)], [did[doc]], [th[doc]], [place],
                              [count], [home[doc]]])
    return rows


# --- one level of the suffix sort ----------------------------------------------------------------

def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several keys: sort by the first, then each run of ties by the next, and so on."""
    order = np.argsort(keys[0], kind="stable")
    group = np.zeros(len(order), np.int64)
    for previous, key in zip(keys, keys[1:]):
        value = previous[order]
        group = np.cumsum(np.concatenate([[0], (value[1:] != value[:-1]) | (group[1:] != group[:-1])]))
        ties = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(ties):
            break
        order[ties] = order[ties][np.lexsort((key[order[ties]], group[ties]))]
    return order


def _bucket(batches: Iterator[pa.RecordBatch], once_a_row: bool) -> Iterator[pa.RecordBatch]:
    """Sorts one bucket and keeps its rows that share their token, and those of its first and last token.

    ``once_a_row``: a content that only one row of the input has, however often, is not repeated.
    """
    own = [b for b in batches if b.num_rows]
    if not own:
        return
    table = pa.Table.from_batches(own)
    col = {name: table.column(name).to_numpy() for name in table.column_names}
    order = multikey_order([col["t"], col["c"], col["did"], col["th"] if once_a_row else col["lo"]])
    t, c = col["t"][order], col["c"][order]
    new_t = np.concatenate([[True], t[1:] != t[:-1]])
    new_c = new_t | np.concatenate([[True], c[1:] != c[:-1]])
    token, content = np.cumsum(new_t) - 1, np.cumsum(new_c) - 1
    if once_a_row:
        did, th = col["did"][order], col["th"][order]
        other = new_c | np.concatenate([[True], (did[1:] != did[:-1]) | (th[1:] != th[:-1])])
        repeated = np.bincount(content[other])[content] > 1
    else:
        repeated = np.bincount(content)[content] > 1
    shared = np.bincount(token[new_c])[token] > 1
    edge = (token == 0) | (token == token[-1])
    keep = np.flatnonzero(repeated | shared | edge)
    # only a group that may reach over a boundary needs its token and content again
    for name in ("t", "c"):
        at = table.column_names.index(name)
        table = table.set_column(at, name, pa.array(np.where(edge, col[name][order], 0)[np.argsort(order)]))
    rows = table.take(pa.array(order[keep]))
    for name, x in (("repeated", repeated), ("shared", shared), ("first", new_c), ("edge", edge)):
        rows = rows.append_column(name, pa.array(x[keep]))
    yield from rows.combine_chunks().to_batches(max_chunksize=50_000)


def _sampled(make_rows):
    """The keys of a task's rows whose hash has at least ``rate`` leading zeros (``zeros``), TASK_ROWS at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rate, seen = None, 0, 0
        for batch in make_rows(batches):
            did, th, lo = (batch.column(i).to_numpy().astype(np.int64).view(np.uint64) for i in (2, 3, 4))
            # the number in the task tells repeated rows apart
            number = np.arange(seen, seen + len(did), dtype=np.uint64)
            seen += len(did)
            h = _mix(_mix(_mix(_mix(did) ^ th) ^ lo) ^ number)
            zeros = np.clip(np.floor(64 - np.log2(h.astype(np.float64) + 1)), 0, 63).astype(np.int32)
            new = pa.table({"t": batch.column(0), "c": batch.column(1), "did": batch.column(2), "lo": batch.column(4),
                            "zeros": pa.array(zeros)}).filter(pa.array(zeros >= rate))
            kept = new if kept is None else pa.concat_tables([kept, new])
            while kept.num_rows > TASK_ROWS:
                rate += 1
                kept = kept.filter(pa.array(kept.column("zeros").to_numpy() >= rate))
            kept = kept.combine_chunks()
        if kept is not None and kept.num_rows:
            yield from kept.append_column("rate", pa.array(np.full(kept.num_rows, rate, np.int32))).to_batches()
    return run


def _splitters(source: DataFrame, make_rows, buckets: int) -> list[tuple[int, int, int, int]]:
    """Keys that cut a sample of the rows of ``source`` into equal parts.

    Each row is in it with the same chance, so that a long text has its share.  The chance is a power of two that suits
    the task with most rows and leaves about SAMPLE_ROWS keys at most for the driver.
    """
    some = written(source.mapInArrow(_sampled(make_rows), "t long, c long, did long, lo int, zeros int, rate int"), "sample")
    found = sorted(some.groupBy("zeros").agg(F.count("*").alias("n"), F.max("rate").alias("rate")).collect())
    if not found:
        return []
    rate = max(r["rate"] for r in found)
    while sum(r["n"] for r in found if r["zeros"] >= rate) > SAMPLE_ROWS:
        rate += 1
    keys = sorted(tuple(r) for r in some.where(F.col("zeros") >= rate).select("t", "c", "did", "lo").collect())
    return [keys[len(keys) * k // buckets] for k in range(1, buckets)] if keys else []


def _bucket_of(batch: pa.RecordBatch, splitters: list[tuple[int, int, int, int]]) -> np.ndarray:
    """How many splitters are at or below each row's key."""
    t = batch.column(0).to_numpy()
    tokens = np.array([s[0] for s in splitters], np.int64)
    out = np.searchsorted(tokens, t, side="left")
    ties = np.flatnonzero(np.searchsorted(tokens, t, side="right") > out)
    if len(ties):
        keys = zip(*(batch.column(i).take(pa.array(ties)).to_pylist() for i in (0, 1, 2, 4)))
        out[ties] = [bisect.bisect_right(splitters, k) for k in keys]
    return out.astype(np.int32)


def tied(source: DataFrame, make_rows, once_a_row: bool = False) -> DataFrame:
    """One level: the rows that ``make_rows`` makes of batches of ``source`` (did, th ...), those of them that are
    ``repeated`` (another row has token and content) or go ``further`` (to be refined).

    With ``once_a_row`` the other row must come from another input row; ``lo`` must then be the same wherever an input
    row is repeated, so that equal keys meet in one bucket.
    """
    buckets = shuffle_width(source.sparkSession)
    splitters = _splitters(source, make_rows, buckets)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in make_rows(batches):
            yield batch.append_column("bucket", pa.array(_bucket_of(batch, splitters)))

    sorted_rows = (source.mapInArrow(dealt, ROW + ", bucket int").repartitionById(buckets, F.col("bucket"))
                   .drop("bucket")
                   .mapInArrow(lambda batches: _bucket(batches, once_a_row), ROW + ", repeated boolean, shared boolean, first boolean, edge boolean")
                   .withColumn("bucket", F.spark_partition_id()))
    kept = written(sorted_rows, "suffixes")
    # two tokens a bucket: what a group that reaches over a boundary has on each side
    edges = (kept.where("edge").groupBy("t", "bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
             .orderBy("t", "bucket").collect())
    across_shared, across_repeated = set(), set()
    for a, b in zip(edges, edges[1:]):
        if a["t"] == b["t"]:
            if a["hi"] == b["lo"]:
                across_repeated.add((a["t"], a["hi"]))
            if a["lo"] != b["hi"]:
                across_shared.add(a["t"])
    spans: dict[int, set] = {}
    for e in edges:
        spans.setdefault(e["t"], set()).update((e["lo"], e["hi"]))
    across_shared |= {t for t, found in spans.items() if len(found) > 1}
    shared_t = np.array(sorted(across_shared), np.int64)
    repeated_tc = sorted(across_repeated)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, c, repeated, shared, first, edge = (
                batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False)
                for x in ("t", "c", "repeated", "shared", "first", "edge"))
            repeated, shared = repeated.copy(), shared | (edge & np.isin(t, shared_t))
            at = np.flatnonzero(edge & np.isin(t, np.array([x for x, _ in repeated_tc], np.int64)))
            if len(at):
                found = set(repeated_tc)
                repeated[at] |= np.fromiter(((x, y) in found for x, y in zip(t[at].tolist(), c[at].tolist())), bool,
                                            len(at))
            further = shared & (~repeated | first)
            keep = repeated | further
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(2, 7)), pa.array(repeated), pa.array(further)],
                names=["did", "th", "lo", "n", "home", "repeated", "further"])
            yield out.filter(pa.array(keep))

    return kept.mapInArrow(settle, "did long, th int, lo int, n int, home int, repeated boolean, further boolean")


# --- the operator --------------------------------------------------------------------------------

def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a row's key (did, th): 96 bits of two digests of both, which repeated rows share.

    Among 10^12 different rows, two share a key with a probability below 10^-5.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text.alias("text"))
    no_id = F.col("doc_id").isNull()
    return source.select("doc_id", F.xxhash64("text", "doc_id", no_id).alias("did"), F.hash("text", no_id).alias("th"), "text")


def _compressed(keyed: DataFrame) -> DataFrame:
    """The texts, compressed for the shuffle: did, th, doc_id, z."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            z = pa.array([squeeze(x.encode()) for x in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], z], names=["did", "th", "doc_id", "z"])
    return keyed.select("did", "th", "doc_id", "text").mapInArrow(run, "did long, th int, doc_id long, z binary")


def _by_doc(rows: DataFrame, value: Column) -> DataFrame:
    return rows.groupBy("did", "th").agg(F.collect_list(value).alias("places")).hint("shuffle_hash")


def _fragments(keyed: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """The bytes of the runs in ``places``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for did, th, z, found in zip(*(c.to_pylist() for c in batch.columns)):
                text = expand(z)
                for p in found:
                    for col, x in zip(out, (did, th, p["lo"], text[p["lo"]: p["lo"] + p["n"] + width - 1])):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.binary())], names=["did", "th", "home", "bytes"])
    wanted = _by_doc(places.select("did", "th", "lo", "n").distinct(), F.struct("lo", "n"))
    joined = _compressed(keyed).join(wanted, ["did", "th"]).select("did", "th", "z", "places")
    return joined.mapInArrow(cut, "did long, th int, home int, bytes binary")


def repeated_spans(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR,
                   blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """did, th, lo, hi: bytes lo .. hi of the row with that key that repeated strings cover (they may overlap)."""
    keyed = _keyed(docs)
    level = tied(keyed.select("did", "th", "text"), _run_rows(width, anchor))
    fragments = written(_fragments(keyed, level.where("further"), width), "fragments")

    def covered(rows: DataFrame) -> DataFrame:
        return rows.where("repeated").select("did", "th", "lo", (F.col("lo") + F.col("n") + (width - 1)).alias("hi"))

    found = covered(level)
    for block in blocks:
        wanted = (level.where("further").groupBy("did", "th", "home")
                  .agg(F.collect_set(F.struct("lo", "n")).alias("wanted")))
        source = written(fragments.join(wanted, ["did", "th", "home"]).select("did", "th", "home", "bytes", "wanted"),
                         "fragments")
        level = tied(source, _block_rows(width, anchor, block))
        found = found.unionByName(covered(level))
    return found.groupBy("did", "th", "lo").agg(F.max("hi").alias("hi"))


def without_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR,
                    blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs as start, end) and kept (the bytes left) of every row."""
    spans = written(repeated_spans(docs, width, anchor, blocks), "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids, size, gone, kept = [], [], [], []
            for doc_id, z, found in zip(*(c.to_pylist() for c in batch.columns)):
                text = expand(z)
                merged: list[list[int]] = []
                for lo, hi in sorted((p["lo"], p["hi"]) for p in found or ()):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                at, parts = 0, []
                for lo, hi in merged:
                    parts.append(text[at:lo])
                    at = hi
                parts.append(text[at:])
                ids.append(doc_id)
                size.append(len(text))
                gone.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = _compressed(_keyed(docs)).join(_by_doc(spans, F.struct("lo", "hi")), ["did", "th"], "left")
    return joined.select("doc_id", "z", "places").mapInArrow(
        remove, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
