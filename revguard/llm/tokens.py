"""Token ids of whole texts, batch by batch, with a public tokenizer file.

``TextEncoder`` runs inside tasks.  A tokenizer that lower-cases, cuts a text
into pre-tokens without white space and turns each into ids by itself gives a
text the ids of its pre-tokens one after the other, so every distinct pre-token
is encoded by the library once and looked up afterwards.  The memo is bounded
and refilled, which never changes a result.  Words with characters beyond plain
Latin, and tokenizers of any other kind, go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa

END_ID = 1

# Plain Latin: in it, lower-casing is Python's, nothing composes under NFC, and \s matches white space alone.
LATIN = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x180)]]
PLAIN_WORD = re.compile("[!-~¡-ſ]+")
PLAIN_TEXT = re.compile("[!-~¡-ſ\\x20\\x09-\\x0D]*")
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def word_tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def word_pattern(path: str) -> str | None:
    """The file's pre-token pattern if its tokenizer lower-cases, keeps only matches of one pattern that hold no
    white space and turns their bytes to letters before BPE; None for any other kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split, rest = pre[0], pre[1:]
    steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    if (steps == ["NFC", "Replace", "Lowercase"] and spec["normalizer"]["normalizers"][1].get("content") == " "
            and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")
            and [(r.get("type"), r.get("add_prefix_space"), r.get("use_regex")) for r in rest]
            == [("ByteLevel", False, False)] and spec.get("model", {}).get("type") == "BPE"
            and not spec.get("post_processor")):
        return split["pattern"]["Regex"]
    return None


def latin_pattern(pattern: str) -> re.Pattern:
    """The pre-token pattern for plain Latin text: its letter and number classes spelled out for that range."""
    def those(kind):
        return "".join(re.escape(c) for c in LATIN if unicodedata.category(c)[0] == kind)
    return re.compile(pattern.replace(r"\p{L}", those("L")).replace(r"\p{N}", those("N")))


def byte_letters() -> list[str]:
    """The letter that byte-level BPE shows for each byte: printable Latin-1 as itself, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(0x100 + others.index(b)) for b in range(256)]


class _Codes(dict):
    """Piece -> small integer, in order of first sight; new pieces are queued."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece):
        code = len(self)
        self[piece] = code
        self.fresh.append(piece)
        return code


class TextEncoder:
    """``encode(column)`` -> (all ids of the column one after the other, ids before each text).

    ``memo_pieces`` bounds the memo (about 250 bytes each); when it is full, the less used half goes.
    """

    def __init__(self, path: str, memo_pieces: int = 500_000, chunk_chars: int = 1 << 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.memo_pieces, self.chunk_chars = memo_pieces, chunk_chars
        found = word_pattern(path)
        self.by_piece = found is not None
        self.find = latin_pattern(found).findall if found else None
        self.byte_letters = byte_letters()
        self._reset([], np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _reset(self, pieces, lengths, pool):
        self.codes = _Codes()
        for p in pieces:
            self.codes[p] = len(self.codes)
        self.lengths, self.pool = lengths, pool
        self.starts = np.cumsum(lengths) - lengths
        self.used = np.zeros(len(pieces), np.int64)

    def _shrink(self):
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.memo_pieces // 2])
        pieces, lengths = list(self.codes), self.lengths[keep]
        self._reset([pieces[i] for i in keep], lengths, self.pool[spans(self.starts[keep], lengths)])

    def _ids(self, piece: str) -> list[int]:
        if piece[0] == "\0":  # a whole word
            return self.tokenizer.encode(piece[1:], add_special_tokens=False).ids
        shown = piece if piece.isascii() else "".join([self.byte_letters[b] for b in piece.encode()])
        return [t.id for t in self.tokenizer.model.tokenize(shown)]

    def _learn(self):
        fresh, self.codes.fresh = self.codes.fresh, []
        got = [self._ids(p) for p in fresh]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum()))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, flat])
        self.used = np.concatenate([self.used, np.zeros(len(got), np.int64)])

    def _pieces(self, text: str) -> list[str]:
        if "<|" not in text and PLAIN_TEXT.fullmatch(text):
            return self.find(text.lower())
        out: list[str] = []
        for w in WORD.findall(text):
            if "<|" not in w and PLAIN_WORD.fullmatch(w):
                out += self.find(w.lower())
            else:
                out.append("\0" + w)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = [t or "" for t in column.to_pylist()]
        if not self.by_piece:
            got = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            counts = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter(chain.from_iterable(got), np.uint32, int(counts.sum()))
            return flat, np.concatenate([[0], np.cumsum(counts)])
        parts, counts, first = [], np.zeros(len(texts), np.int64), 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (size < self.chunk_chars or last == first):
                size += len(texts[last])
                last += 1
            flat, counts[first:last] = self._encode_pieces(texts[first:last])
            parts.append(flat)
            first = last
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return flat, np.concatenate([[0], np.cumsum(counts)])

    def _encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > self.memo_pieces:
            self._shrink()
        look, coded = self.codes.__getitem__, []
        n_pieces = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            pieces = self._pieces(text)
            n_pieces[k] = len(pieces)
            coded.append(np.fromiter(map(look, pieces), np.int64, len(pieces)))
        codes = np.concatenate(coded)
        if self.codes.fresh:
            self._learn()
        self.used += np.bincount(codes, minlength=len(self.used))
        lengths = self.lengths[codes]
        flat = self.pool[spans(self.starts[codes], lengths)]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(n_pieces)
        return flat, before[ends] - before[ends - n_pieces]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start .. start + length of every span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)
