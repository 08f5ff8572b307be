"""Phrases and their cohesion by SON partitioning.

Texts are read once into chunks of one language: a chunk's distinct words and its words as numbers, with breaks between
pieces.  Chunks are dealt to shards, and a shard that holds a share w of a language's words mines every phrase that it
has at least ceil(w * min_count) times: a phrase that stays below this in every shard is below min_count in all, so the
union of the shards' phrases misses none.  A second pass counts every phrase of the union exactly in all chunks.

With k shards per min_count // 2 the local support is about two, so that phrases seen once in a shard, most of all
phrases, are never spelt out.  A shard is larger than a task: its chunks send, by ranges of a 64-bit key, blocks of five
key bytes and a count per distinct phrase, and a key's chunks meet in one group per language and range.  Two phrases with
one key can only add a candidate.  What comes back to a chunk is one bit per phrase that it sent, so neither candidates
nor a vocabulary are broadcast.  The number of ranges grows with the words, and a chunk sends each phrase once, so very
common words and copies of texts do not fill a group.

Defined cases: null texts are empty, a null language is ``und``; a text of any length is read whole (one that exceeds
``CHUNK_WORDS`` is a chunk of its own); repeated rows count each time; ties go by phrase in UTF-8 byte order; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revguard.llm.common import bounded_broadcast, pick, written

#: Words of a chunk, but for a longer text.
CHUNK_WORDS = 500_000
#: Distinct phrases of chunks, expected, that meet in one group.
GROUP_ENTRIES = 3_000_000
#: Bytes of text that are split into words at a time.
SLICE_BYTES = 8 << 20
#: Languages whose totals may be broadcast; with more, they are joined by shuffle.
BROADCAST_LANGS = 50_000
#: Parts that the last ranking of a language is dealt to first.
RANK_SALTS = 64
#: Bytes of a key beside its range.
KEY_BYTES = 5

#: Letters as they count: A-Z in lower case, what ends a piece as a line feed, a tab as a space; UTF-8 keeps these bytes to them.
SPACE, END = 0x20, 0x0A
BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")

CHUNK_TYPE = "chunk long, lang string, n long, vocabulary array<string>, codes binary"


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts in order, and the number of the piece that each is in."""
    raw = np.frombuffer(b"\n".join(pc.fill_null(texts.cast(pa.binary()), b"").to_pylist()).translate(BYTES), np.uint8)
    inside = (raw != SPACE) & (raw != END)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(raw[inside]))
    return words, np.searchsorted(np.flatnonzero(raw == END), first)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE_BYTES``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        base = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield at, stop
        at = stop


def _chunk(chunk: int, lang: str, tokens: list[tuple[pa.Array, np.ndarray]]) -> dict:
    coded = pa.concat_arrays([words for words, _ in tokens]).dictionary_encode()
    codes = coded.indices.to_numpy().astype("<i4")
    piece = np.concatenate([p + i * (1 << 40) for i, (_, p) in enumerate(tokens)])
    ends = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    return {"chunk": chunk, "lang": lang, "n": len(codes), "vocabulary": coded.dictionary.cast(pa.string()),
            "codes": np.insert(codes, ends, -1).tobytes()}


def chunks_of(docs: DataFrame) -> DataFrame:
    """The texts as a written table of chunks."""
    schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("n", pa.int64()),
                        ("vocabulary", pa.list_(pa.string())), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 32, 0
        held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        size: dict[str, int] = {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal done
            done += 1
            size.pop(lang)
            c = _chunk(first + done - 1, lang, held.pop(lang))
            words = pa.ListArray.from_arrays(pa.array([0, len(c["vocabulary"])], pa.int32()), c["vocabulary"])
            return pa.RecordBatch.from_arrays([pa.array([c["chunk"]], pa.int64()), pa.array([lang], pa.string()),
                                               pa.array([c["n"]], pa.int64()), words, pa.array([c["codes"]], pa.binary())],
                                              schema=schema)

        for batch in batches:
            langs, texts = batch.column(0), batch.column(1)
            for lang in pc.unique(langs).to_pylist():
                own = texts.filter(pc.equal(langs, lang))
                for a, b in _slices(own):
                    words = _tokens(own.slice(a, b - a))
                    n = len(words[0])
                    if size.get(lang) and size[lang] + n > CHUNK_WORDS:
                        yield close(lang)
                    if n:
                        held.setdefault(lang, []).append(words)
                        size[lang] = size.get(lang, 0) + n
            while sum(size.values()) > 2 * CHUNK_WORDS:  # many languages in one task
                yield close(max(size, key=size.get))
        for lang in list(held):
            yield close(lang)

    rows = pick(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return written(rows.mapInArrow(run, CHUNK_TYPE), "chunks")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def phrases_of(codes: np.ndarray, max_words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to ``max_words``: the distinct phrases of a chunk (a row of word numbers each) and their counts."""
    out = []
    whole, ids = codes >= 0, codes.astype(np.int64)
    width = int(codes.max()) + 1 if len(codes) else 1  # a chunk's vocabulary: every number occurs
    out.append((np.arange(width)[:, None] if whole.any() else np.zeros((0, 1), np.int64),
                np.bincount(ids[whole], minlength=width if whole.any() else 0)))
    rank = ids  # of the phrase that starts at a place, among those of its length; -1 for none
    for k in range(2, max_words + 1):
        stop = max(len(codes) - k + 1, 0)
        at = np.flatnonzero((rank[:stop] >= 0) & whole[k - 1:]) if stop else np.zeros(0, np.int64)
        key = rank[at] * width + ids[at + k - 1]
        order = np.argsort(key)
        found = key[order]
        new = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
        n = np.diff(np.append(new, len(found)))
        first = at[order[new]]
        out.append((np.stack([ids[first + j] for j in range(k)], axis=1), n))
        rank = np.full(len(codes), -1, np.int64)
        rank[at[order]] = np.repeat(np.arange(len(n)), n)
    return out


def _keyed(vocabulary: pa.Array, codes: np.ndarray, max_words: int, ranges: int) -> tuple:
    """Phrases of a chunk with their range, key and count, and the order by range and key."""
    hashed = pd.util.hash_array(vocabulary.to_numpy(zero_copy_only=False)) if len(vocabulary) else np.zeros(0, np.uint64)
    levels = phrases_of(codes, max_words)
    keys, counts = [], []
    for words, n in levels:
        h = np.full(len(words), words.shape[1], np.uint64)
        for j in range(words.shape[1]):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + hashed[words[:, j]])
        keys.append(h)
        counts.append(n)
    key, count = np.concatenate(keys), np.concatenate(counts)
    part = (key >> np.uint64(8 * KEY_BYTES)) % np.uint64(ranges)
    key = key & np.uint64((1 << 8 * KEY_BYTES) - 1)
    # places of equal keys are in no order, but in the same one each time
    return levels, part.astype(np.int64), key, count, np.argsort(part << np.uint64(8 * KEY_BYTES) | key, kind="stable")


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list]:
    """One chunk at a time: plain values, its vocabulary as an array and its codes."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
        for i in range(batch.num_rows):
            row = [c[i] for c in columns]
            yield [x.values if n == "vocabulary" else np.frombuffer(x.as_buffer(), "<i4") if n == "codes" else x.as_py()
                   for n, x in zip(names, row)]


def _pack_keys(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def _unpack_keys(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // KEY_BYTES, 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, KEY_BYTES)
    return wide.view("<u8").ravel().astype(np.uint64)


def _count_kind(min_count: int) -> str:
    return "<u1" if min_count < 1 << 8 else "<u4" if min_count < 1 << 32 else "<u8"


def _send(max_words: int, min_count: int):
    """Chunks to blocks of keys and counts; counts beyond ``min_count`` decide nothing and are cut to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, lang, ranges, shard, need, words, codes in _rows(
                batches, ["chunk", "lang", "ranges", "shard", "need", "vocabulary", "codes"]):
            _, part, key, count, order = _keyed(words, codes, max_words, ranges)
            part, key = part[order], key[order]
            count = np.minimum(count[order], min_count).astype(_count_kind(min_count))
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(cut[1:], len(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cut), pa.string()), pa.array(part[cut].astype(np.int32)),
                 pa.array(np.full(len(cut), chunk, np.int64)), pa.array(np.full(len(cut), shard, np.int32)),
                 pa.array([need] * len(cut), pa.list_(pa.int64())),
                 pa.array([_pack_keys(key[a:b]) for a, b in zip(cut, ends)], pa.binary()),
                 pa.array([count[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())],
                names=["lang", "part", "chunk", "shard", "need", "keys", "counts"])
    return run


def _mine(min_count: int):
    """One language and range: every shard's phrases of at least its local support, their union, and for each block the
    bits of its phrases that are in the union."""
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("bits", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        chunk, part, shard = (group[c].to_numpy() for c in ("chunk", "part", "shard"))
        need = group["need"][0].as_py()
        blocks = [_unpack_keys(b) for b in group["keys"].to_pylist()]
        counts = [np.frombuffer(b, _count_kind(min_count)) for b in group["counts"].to_pylist()]
        union = []
        for s in np.unique(shard).tolist():
            own = np.flatnonzero(shard == s)
            key = np.concatenate([blocks[i] for i in own])
            order = np.argsort(key, kind="stable")
            key, n = key[order], np.concatenate([counts[i] for i in own])[order].astype(np.int64)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            union.append(key[first][np.add.reduceat(n, first) >= need[s]])
        union = np.unique(np.concatenate(union))
        bits = []
        for b in blocks:
            at = np.minimum(np.searchsorted(union, b), max(len(union) - 1, 0))
            bits.append(np.packbits(union[at] == b if len(union) else np.zeros(len(b), bool)).tobytes())
        return pa.Table.from_arrays([pa.array(chunk), pa.array(part), pa.array(bits, pa.binary())], schema=schema)
    return run


def _spell(max_words: int):
    """Chunks with the bits of all their ranges to their candidates as text, with exact counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ranges, words, codes, back in _rows(batches, ["lang", "ranges", "vocabulary", "codes", "back"]):
            levels, part, _, _, order = _keyed(words, codes, max_words, ranges)
            size = np.bincount(part, minlength=ranges)
            bits = {b["part"]: b["bits"] for b in back}
            wanted = np.zeros(len(part), bool)
            if len(part):
                wanted[order] = np.concatenate([
                    np.unpackbits(np.frombuffer(bits[p], np.uint8), count=int(size[p])).astype(bool)
                    for p in np.flatnonzero(size).tolist()])
            at = 0
            for rows, n in levels:
                mine = wanted[at: at + len(n)]
                at += len(n)
                if mine.any():
                    cols = [words.take(pa.array(c)) for c in rows[mine].T]
                    text = cols[0] if len(cols) == 1 else pc.binary_join_element_wise(*cols, " ")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(text), pa.string()), pa.array(np.full(len(text), rows.shape[1], np.int32)),
                         text, pa.array(n[mine].astype(np.int64))], names=["lang", "words", "phrase", "n"])
    return run


def frequent_phrases(docs: DataFrame, min_count: int = 10, max_words: int = 3, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of every phrase of up to ``max_words`` words that a language has ``min_count`` times or
    more, and (lang, n) with its words in all."""
    spark = docs.sparkSession
    shards = shards or max(1, min_count // 2)
    chunks = chunks_of(docs)
    shard = F.pmod(F.xxhash64("chunk"), F.lit(shards)).cast("int")
    by_shard = chunks.select("lang", "n", shard.alias("shard"))
    totals = written(by_shard.groupBy("lang").agg(
        F.sum("n").alias("n"), *(F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in range(shards))),
        "word-totals")
    local = [F.greatest(F.lit(1), F.ceil(F.col(f"n{s}").cast("decimal(38,0)") * min_count / F.greatest("n", F.lit(1))).cast("long"))
             for s in range(shards)]
    per_lang = totals.select("lang", F.array(*local).alias("need"), F.ceil(
        (F.col("n") * max_words + 1) / GROUP_ENTRIES).cast("int").alias("ranges"))
    known = chunks.join(bounded_broadcast(per_lang, BROADCAST_LANGS), "lang").withColumn("shard", shard)
    sent = known.select("chunk", "lang", "ranges", "shard", "need", "vocabulary", "codes").mapInArrow(
        _send(max_words, min_count), "lang string, part int, chunk long, shard int, need array<long>, keys binary, counts binary")
    back = (sent.groupBy("lang", "part").applyInArrow(_mine(min_count), "chunk long, part int, bits binary")
            .groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias("back")))  # a bit per phrase of the chunk
    spelt = known.join(back, "chunk").select("lang", "ranges", "vocabulary", "codes", "back").mapInArrow(
        _spell(max_words), "lang string, words int, phrase string, n long")
    counted = spelt.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    return written(counted, "phrases"), totals.select("lang", "n")


def _parts(phrase, words, max_words: int):
    """Every cut of a phrase: after its first k words, first part, rest."""
    w = F.split(phrase, " ")
    return F.transform(F.sequence(F.lit(1), words - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(w, F.lit(1), k), " ").alias("head"),
        F.array_join(F.slice(w, k + 1, words), " ").alias("rest")))


def scored(phrases: DataFrame, max_words: int = 3, keep_share: int = 50) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of the phrases of two words or more that no longer phrase explains.

    A phrase goes if a longer one around it has at least ``keep_share`` per cent of its occurrences, whether that one
    stays or not.
    """
    f = phrases.select("lang", "phrase", "f")
    many = phrases.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    cuts = many.select("*", F.explode(_parts(F.col("phrase"), F.col("words"), max_words)).alias("cut")).select(
        "lang", "words", "phrase", "a", "cut.*")
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    big = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    # up to 10^38: counts up to 10^15; ``div`` of whole decimals is exact
    cuts = cuts.select("lang", "words", "phrase", "a", "k", "l", "r", (F.lit(1_000_000).cast("decimal(7,0)") * (
        big["a"] * big["a"]).cast("decimal(31,0)")).alias("top"), (big["l"] * big["r"]).cast("decimal(38,0)").alias("below"))
    cuts = cuts.withColumn("score", F.expr("top div below"))
    best = cuts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1),
        lambda s: F.array_join(F.slice(F.split("phrase", " "), s, m), " "))))
    around = (many.where("words > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    left = best.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(22,0)") * 100 < F.col("a").cast("decimal(22,0)") * keep_share))
    return left.select("lang", "words", "phrase", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, min_count: int = 10, max_words: int = 3, keep_share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases by score, count and phrase."""
    phrases, totals = frequent_phrases(docs, min_count, max_words)
    rows = scored(phrases, max_words, keep_share)
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = F.row_number()
    few = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)))
    few = few.withColumn("rank", rank.over(Window.partitionBy("lang", "salt").orderBy(*by))).where(F.col("rank") <= top)
    few = few.withColumn("rank", rank.over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    return few.join(bounded_broadcast(totals, BROADCAST_LANGS), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
