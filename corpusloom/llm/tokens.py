"""Token ids of texts under a public byte-level BPE vocabulary.

The ids of a piece (a match of the vocabulary's splitting pattern) are found by dynamic programming over its prefixes:
for each prefix there is exactly one token with which its encoding ends. The candidates are the tokens that are a suffix
of the prefix, read off a suffix automaton over the vocabulary; the right one is the first, from the longest, that is
compatible with the last token of the prefix before it, that is, no merge of higher priority crosses their border.
Back-pointers from the end give the ids. Pieces repeat, so ids of short pieces are remembered, in a bounded table.

Cases: null and empty texts have no ids (an empty list). Texts of any length are taken whole; strings of special tokens
are ordinary text; lone surrogates, which UTF-8 has no bytes for, become U+FFFD.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary files are; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Remembered pieces, and the longest remembered piece in characters.
MEMO, MEMO_PIECE = 400_000, 64


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Exact encoder of one vocabulary. memo: bytes of the int32 ids by piece."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        vocab = model["vocab"]
        # The merge that makes a token, its rank (order of the merges), and the token of a pair.
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        raw = lambda s: "".join(chr(letters[c]) for c in s)
        for c in letters:
            self.automaton.add_word(raw(c), (1, vocab[c]))
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            t = vocab[a + b]
            if t not in self.rank:
                self.rank[t], self.parts[t] = k, (vocab[a], vocab[b])
                self.automaton.add_word(raw(a + b), (len(a) + len(b), t))
            self.pair[vocab[a], vocab[b]] = k
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.memo, self.spaced = _Memo(self), _Spaced(self)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the texts of two tokens, side by side, are encoded as just these two.

        Undo the merges inside both, latest first. A merge across the border would have come before the
        undone ones if its rank is lower than all of them; then the two tokens would not have arisen.
        """
        known = self.fits.get(left << 32 | right)
        if known is not None:
            return known
        a, b = left, right
        undone_a = undone_b = 1 << 60  # ranks of the merges last undone
        pair, rank, good = self.pair, self.rank, True
        while True:
            across = pair.get((a, b))
            if across is not None and across < undone_a and across <= undone_b:  # of equal merges the leftmost comes first
                good = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra > rb:
                undone_a, a = ra, self.parts[a][1]
            elif rb >= 0:
                undone_b, b = rb, self.parts[b][0]
            else:
                break
        if len(self.fits) > MEMO:
            self.fits.clear()
        self.fits[left << 32 | right] = good
        return good

    def _joined(self, a: int, b: int) -> bool:
        """Whether two tokens side by side end as their merge: the first merge across their border is their own."""
        own = self.pair[a, b]
        undone_a = undone_b = 1 << 60
        while True:
            across = self.pair.get((a, b))
            if across is not None and across != own and across < undone_a and across <= undone_b:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra > rb:
                undone_a, a = ra, self.parts[a][1]
            elif rb >= 0:
                undone_b, b = rb, self.parts[b][0]
            else:
                return True

    def piece(self, text: str) -> list[int]:
        """Ids of one piece."""
        try:
            data = text.encode()
        except UnicodeEncodeError:
            data = LONE.sub("\ufffd", text).encode()
        n = len(data)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        fits = self.fits
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):  # for each end the longest first
            end += 1
            if size[end]:
                continue
            start = end - length
            if start:
                before = last[start]
                good = fits.get(before << 32 | token)
                if good is None:
                    good = self.compatible(before, token)
            else:
                good = self._whole(token)
            if good:
                last[end], size[end] = token, length
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def _whole(self, token: int) -> bool:
        """Whether the text of a token is encoded as the token: its two parts have to be whole and, alone, compatible."""
        known = self.whole.get(token)
        if known is None:
            p = self.parts.get(token)
            known = self.whole[token] = p is None or self._whole(p[0]) and self._whole(p[1]) and self._joined(*p)
        return known

    def ids(self, text: str) -> bytes:
        """The int32 ids of a text, as bytes.

        A piece always begins at a blank that a sign other than white space follows, so the text is first cut there;
        the parts are looked up, and only unknown ones are split by the pattern.
        """
        if AMBIGUOUS(text):
            parts = BEFORE_WORD.split(text)
        else:
            parts = text.split(" ")
        first = b"".join(map(self.memo.__getitem__, self.split(parts[0])))
        return first + b"".join(map(self.spaced.__getitem__, parts[1:]))


#: A blank before white space or the end; where there is none, cutting at each blank is right.
AMBIGUOUS = regex.compile(r" (?=\s|$)").search
BEFORE_WORD = regex.compile(r" (?=\S)")
LONE = regex.compile(r"[\ud800-\udfff]")


class _Memo(dict):
    """Ids of pieces, as bytes."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoder.piece(piece), np.int32).tobytes()
        if len(piece) <= MEMO_PIECE:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


class _Spaced(dict):
    """Ids of parts of a text, each with the blank before it, as bytes."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, part: str) -> bytes:
        e = self.encoder
        ids = b"".join(map(e.memo.__getitem__, e.split(" " + part)))
        if len(part) <= MEMO_PIECE and "\n" not in part:
            if len(self) >= MEMO:
                self.clear()
            self[part] = ids
        return ids


@lru_cache(2)
def encoder(path: str = VOCABULARY) -> Encoder:
    """The encoder of a file, one a process."""
    return Encoder(path)


def encode(df: DataFrame, text: str = "text", keys: list[str] | None = None, path: str = VOCABULARY, counts: bool = False) -> DataFrame:
    """The columns keys with ids array<int>, never null, of the whole text; with counts, tokens bigint instead."""
    keys = keys or ["doc_id"]
    kind = T.StructField("tokens", T.LongType(), False) if counts else T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)
    schema = T.StructType([*(df.schema[k] for k in keys), kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path).ids
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                got = [ids(x) if x else b"" for x in part.column(len(keys)).to_pylist()]
                sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
                if counts:
                    out = pa.array(sizes)
                else:
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    out = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], out], names=[*keys, kind.name])

    return df.select(*keys, text).mapInArrow(run, schema)
