import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revguard.llm import packing, token_store
from revguard.llm.common import new_folder
from revguard.llm.tokens import END_ID, TextEncoder, word_tokenizer_path
from tests.conftest import SF0001
from tests.llm.helpers import no_docs, odd_docs, odd_rows

import public_tokenizers

PATH = word_tokenizer_path()


@pytest.fixture(scope="module")
def whole():
    """The library's own ids of a whole text."""
    tokenizer = TextEncoder(PATH).tokenizer
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40) | st.text(
    "abcXYZéÉßñ '’.,!?<|>0129²½sStTlLrRvVeEmMdD\t\n\xa0", max_size=60), max_size=6))
def test_memoised_ids_are_the_librarys(texts):
    encoder = TextEncoder(PATH, memo_pieces=8, chunk_chars=16)
    for _ in range(2):  # the second time from the memo
        ids, before = encoder.encode(pa.array(texts, pa.string()))
        for k, t in enumerate(texts):
            assert list(ids[before[k]: before[k + 1]]) == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_other_tokenizers_encode_texts_whole():
    encoder = TextEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Hello  world\n", None, "", "é  x"]
    ids, before = encoder.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert list(ids[before[k]: before[k + 1]]) == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_histogram_packs_hold_every_piece_once(counts):
    patterns = packing.pack_histogram(counts, 64)
    held = Counter()
    for lengths, n in patterns:
        assert sum(lengths) <= 64 and n > 0
        for x in lengths:
            held[x] += n
    assert held == Counter(counts)
    runs = packing.slots(patterns)
    for x in counts:  # the runs of a length begin at 0 and follow each other
        own = runs["first"][runs["length"] == x]
        assert own[0] == 0 and (np.diff(own) > 0).all()


def check_packed(rows, texts, whole, sequence_length):
    """``texts``: (doc_id, text) rows; every id lies in one piece, sequences are gapless and not too long."""
    expected = Counter()
    for d, t in texts:
        ids = np.array([*whole(t), END_ID], "<u4")
        for s in range(0, len(ids), sequence_length):
            part = ids[s: s + sequence_length]
            expected[d, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= sequence_length
    return sum(r.length for r in rows) / (len(sequences) * sequence_length) if sequences else 1.0


def test_pack_documents(spark, whole):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert check_packed(packing.pack(docs, PATH).collect(), texts, whole, 2048) > 0.97
    check_packed(packing.pack(docs, PATH, 128).collect(), texts, whole, 128)


def test_pack_odd_and_empty(spark, whole):
    rows = packing.pack(odd_docs(spark), PATH).collect()
    check_packed(rows, [r[:2] for r in odd_rows()], whole, 2048)
    assert packing.pack(no_docs(spark), PATH).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=60))
def test_codes_round_trip(ranks):
    controls, data = token_store.encode_ranks(np.array(ranks, np.uint32))
    assert len(controls) == -(-len(ranks) // 4)
    assert token_store.decode_ranks(controls, data, len(ranks)).tolist() == ranks


def stored(spark, docs):
    folder = new_folder(spark, "test-store")
    token_store.write_store(docs, folder, PATH)
    return folder, sorted(token_store.read_store(spark, folder).collect(), key=lambda r: r.start)


def check_store(rows, texts, whole):
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == END_ID
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert ids == sorted(ids) and all(r.doc_id is not None for r in rows[len(rows) - len(ids):])
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((d, (*whole(t), END_ID)) for d, t in texts)


def test_store_round_trip(spark, whole):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    folder, rows = stored(spark, docs)
    check_store(rows, [(r.doc_id, r.text) for r in docs.collect()], whole)
    counts = Counter(i for r in rows for i in r.ids)
    by_rank = [r.id for r in spark.read.parquet(f"{folder}/vocabulary").orderBy("rank").collect()]
    assert [counts[i] for i in by_rank] == sorted(counts.values(), reverse=True)


def test_store_odd_and_empty(spark, whole):
    check_store(stored(spark, odd_docs(spark))[1], [r[:2] for r in odd_rows()], whole)
    assert stored(spark, no_docs(spark))[1] == []
