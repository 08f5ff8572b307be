"""Operator 5: token-id files with frequency-ranked ids in byte-aligned variable-length codes.

Format.  A store is a folder with two Parquet tables.  ``vocabulary`` maps a
rank (0 = most frequent id of this corpus) to the tokenizer's id.  ``blocks``
holds runs of whole documents in ascending doc_id order; a block's ids are
ranks of one to four bytes each (``data``), and apart from them ``controls``
holds two bits per rank that say how many bytes it has, four ranks to a byte.
Decoding looks the four lengths of a control byte up in a table, adds them up to
byte offsets and gathers the bytes, all with numpy.

Job.  Range-partition the texts by doc_id, encode them once with a running count
inside each partition, write that; count ids (one entry per vocabulary entry,
the only thing collected); rank; write the blocks.  Documents of one doc_id are
told apart by a hash of their text and a row number, so that a doc_id which a
third of all rows share still spreads over partitions.

Defined cases: a null or empty text is a document of the end id alone; a null
doc_id comes first and stays null; repeated rows are stored once each; an empty
table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revguard.llm.common import pick, shuffle_width
from revguard.llm.tokens import END_ID, TextEncoder

BLOCK_IDS = 1 << 16
# Bytes of each of the four ranks that a control byte speaks of, and the bits a rank of so many bytes has.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(controls, data) of an array of ranks."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    c = codes.reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes(), data.tobytes()


def decode_ranks(controls: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of (controls, data)."""
    size = LENGTHS[np.frombuffer(controls, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    word = raw[at] | raw[at + 1] << np.uint32(8) | raw[at + 2] << np.uint32(16) | raw[at + 3] << np.uint32(24)
    return word & MASKS[size]


def _narrow(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit (marked by a leading 2), else four (a leading 4)."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if blob[0] == 2 else "<u4", offset=1).astype(np.uint32)


def write_store(docs: DataFrame, folder: str, tokenizer_path: str) -> None:
    """Encodes every document and writes the store to ``folder`` (a path all executors share)."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, done = TextEncoder(tokenizer_path), 0
        for batch in batches:
            ids, before = encoder.encode(batch.column(1))
            n = np.diff(before) + 1
            ends = done + np.cumsum(n)
            blobs = [_narrow(np.append(ids[a:b], END_ID)) for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(blobs, pa.binary()),
                 pa.array(ends - n, pa.int64())], names=["doc_id", "n_tokens", "ids", "local_start"])
            done = int(ends[-1]) if len(ends) else done

    # texts move before they are encoded: a range exchange runs what is below it twice, to sample and to deal out
    (pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("digest"),
                                         F.monotonically_increasing_id().alias("row"))
     .repartitionByRange(shuffle_width(spark), "doc_id", "digest", "row")
     .sortWithinPartitions("doc_id", "digest", "row").select("doc_id", "text")
     .mapInArrow(encode, "doc_id long, n_tokens long, ids binary, local_start long")
     .withColumn("shard", F.spark_partition_id())
     .write.option("compression", "zstd").parquet(f"{folder}/ordered"))
    ordered = spark.read.parquet(f"{folder}/ordered")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                got = np.bincount(_wide(blob))
                if len(got) > len(seen):
                    seen = np.concatenate([seen, np.zeros(len(got) - len(seen), np.int64)])
                seen[: len(got)] += got
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seen[ids])], names=["id", "n"])

    totals = ordered.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted = sorted(((r["n"], -r["id"]) for r in totals.collect()), reverse=True)  # at most the vocabulary
    by_rank = np.array([-i for _, i in counted], np.int64)
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    (spark.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank)], "rank long, id long").coalesce(1)
     .write.parquet(f"{folder}/vocabulary"))

    before = (ordered.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per shard
              .select("shard", F.coalesce(F.sum("n").over(
                  Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start")))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
            out, own, size = [], [], 0
            for row in rows:
                if own and (size >= BLOCK_IDS or own[0][4] != row[4]):  # a task may read several shards
                    out.append(own)
                    own, size = [], 0
                own.append(row)
                size += row[1]
            if own:
                out.append(own)
            packed = [encode_ranks(rank_of[np.concatenate([_wide(r[2]) for r in b])]) for b in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array([[r[0] for r in b] for b in out], pa.list_(pa.int64())),
                 pa.array([[r[1] for r in b] for b in out], pa.list_(pa.int64())),
                 pa.array([[r[3] for r in b] for b in out], pa.list_(pa.int64())),
                 pa.array([b[0][4] for b in out], pa.int32()),
                 pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())],
                names=["doc_ids", "lengths", "local_starts", "shard", "controls", "data"])

    (ordered.select("doc_id", "n_tokens", "ids", "local_start", "shard")
     .mapInArrow(blocks, "doc_ids array<long>, lengths array<long>, local_starts array<long>, shard int, "
                         "controls binary, data binary")
     .write.option("compression", "none").parquet(f"{folder}/blocks"))
    before.coalesce(1).write.parquet(f"{folder}/shards")


def read_store(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array) of every document of a store."""
    rows = spark.read.parquet(f"{folder}/vocabulary").collect()  # at most the vocabulary
    by_rank = np.zeros(len(rows), np.uint32)
    by_rank[[r["rank"] for r in rows]] = [r["id"] for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            ids_out = []
            for doc_ids, lengths, starts, shard, controls, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids = by_rank[decode_ranks(controls, data, sum(lengths))].astype("<u4")
                at = 0
                for d, n, s in zip(doc_ids, lengths, starts):
                    for col, v in zip(cols, (d, s, shard, n, zlib.crc32(ids[at: at + n].tobytes()))):
                        col.append(v)
                    if with_ids:
                        ids_out.append(ids[at: at + n])
                    at += n
            arrays = [pa.array(c, t) for c, t in
                      zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
            names = ["doc_id", "local_start", "shard", "n_tokens", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, local_start long, shard int, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    docs = (spark.read.parquet(f"{folder}/blocks")
            .select("doc_ids", "lengths", "local_starts", "shard", "controls", "data").mapInArrow(run, schema))
    shards = spark.read.parquet(f"{folder}/shards")
    out = docs.join(shards, "shard").withColumn("start", F.col("shard_start") + F.col("local_start"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
