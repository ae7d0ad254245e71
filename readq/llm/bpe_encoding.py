"""Encoding of the whole corpus with a public byte-level BPE tokenizer (problem 8).

A text is cut into pieces by the tokenizer's pattern; merges never cross a piece. A worker encodes each piece once and looks
it up when it comes again. A piece is encoded by dynamic programming over its byte prefixes: for every prefix the one last token of its encoding is stored. A token t that ends a
prefix is that token if the merges leave the pair (last token of the rest, t) as it is; exactly one t passes. Following the
stored tokens from the end backwards gives the encoding, in time linear in the piece's length for any input.

Because every prefix is stored, an appended text only adds entries, and an edited one is encoded again from the edit on.

Defined results: null and empty texts have no ids, that is, an empty list. Special tokens are never produced; their strings in
a text are ordinary text. Lone surrogates cannot occur in Parquet strings. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readq.llm.memo import Memo

TOKENIZER_DIR = "/opt/tokenizers"
#: How the tokenizer's publisher cuts texts into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: So many pairs of tokens are remembered by a worker before it starts anew; a bound on its memory, not on the texts.
PAIRS = 1_600_000
#: A larger vocabulary file is refused, as it is broadcast.
MAX_BYTES = 64 << 20


def read_vocabulary(path: str) -> bytes:
    """The content of a vocabulary file, read by the driver; the workers get it with the job."""
    file = Path(path)
    if file.suffix != ".tiktoken" or not file.is_file():
        raise ValueError(f"no byte-level vocabulary at {path}")
    if file.stat().st_size > MAX_BYTES:
        raise ValueError(f"the vocabulary at {path} has more than {MAX_BYTES} bytes")
    return file.read_bytes()


def load_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes with their ids; the id is also the order of merging."""
    return {base64.b64decode(t): int(n) for t, n in (line.split() for line in content.splitlines() if line)}


class PrefixEncoder:
    """The encoding of pieces by the last token of each of their prefixes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {n: t for t, n in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        # Each token's beginnings, so that the search for tokens ending at a byte stops where none can be longer.
        self.ends: set[bytes] = {t[i:] for t in ranks for i in range(len(t))}

    def _merge(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a byte is its own."""
        if token not in self.parts:
            text = self.tokens[token]
            self.parts[token] = (token, token) if len(text) == 1 else self._last_merge(text, token)
        return self.parts[token]

    def _last_merge(self, text: bytes, rank: int) -> tuple[int, int]:
        """Merge the bytes in rank order, using only merges ranked before the token itself: two parts are left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if self.ranks.get(parts[best] + parts[best + 1], 1 << 60) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) != 2:
            return -1, -1  # no chain of merges makes this token, so it never comes up
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _stays(self, left: int, right: int) -> bool:
        """Whether the tokens stay side by side. Their merges are undone from the latest to the earliest; if at some time the
        two tokens at the border have a merge that comes before all merges undone so far, it would have joined them."""
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, limit, stays = left, right, 1 << 60, True
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < limit and self._merge(joined) == (a, b):
                stays = False
                break
            (a1, a2), (b1, b2) = self._merge(a), self._merge(b)
            if a2 != a and (a > b or b1 == b):
                limit, a = a, a2
            elif b1 != b:
                limit, b = b + 1, b1  # of equal merges the one further left comes first
            else:
                break
        if len(self.fits) > PAIRS:
            self.fits.clear()
        self.fits[left, right] = stays
        return stays

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of each prefix. known: the entries of a prefix that is unchanged; only the rest is computed."""
        last = list(known or [])
        ranks, ends, stays = self.ranks, self.ends, self._stays
        for end in range(len(last) + 1, len(piece) + 1):
            found, start = -1, end
            while start > 0:
                start -= 1
                text = piece[start:end]
                if text not in ends:
                    break
                token = ranks.get(text)
                if token is not None and self._merge(token)[0] >= 0 and (start == 0 or stays(last[start - 1], token)):
                    found = token
                    break
            last.append(found)
        return last

    def read_back(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end > 0:
            token = last[end - 1]
            out.append(token)
            end -= len(self.tokens[token])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None and self._merge(whole)[0] >= 0 else self.read_back(self.last_tokens(piece))


class TextEncoder:
    """Texts to ids; pieces that were met before are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.encoder, self.split, self.seen = PrefixEncoder(ranks), regex.compile(pattern).findall, Memo()

    def pieces(self, text: str) -> list[list[int]]:
        seen, out = self.seen, []
        for piece in self.split(text):
            ids = seen.get(piece)
            if ids is None:
                seen[piece] = ids = self.encoder.encode_piece(piece.encode("utf-8"))
            out.append(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        return [n for ids in self.pieces(text) for n in ids] if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.pieces(text))) if text else 0


_encoders: dict[str, TextEncoder] = {}


def encoder(content: bytes) -> TextEncoder:
    """One encoder for each worker process and vocabulary."""
    name = hashlib.md5(content).hexdigest()
    if name not in _encoders:
        _encoders[name] = TextEncoder(load_ranks(content))
    return _encoders[name]


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    return f"{folder}/{name}.tiktoken"


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids ARRAY<INT>) of every row."""
    content = df.sparkSession.sparkContext.broadcast(read_vocabulary(path or vocabulary()))
    kind = dict(df.dtypes)[id_col]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(content.value)
        for batch in batches:
            values, ends = [], [0]
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                values.append(np.array(ids, dtype=np.int32))
                ends.append(ends[-1] + len(ids))
            flat = pa.array(np.concatenate(values) if values else np.array([], dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id_col, "ids"])

    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(encode, f"`{id_col}` {kind}, ids ARRAY<INT>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, size INT) of every row: the number of ids."""
    content = df.sparkSession.sparkContext.broadcast(read_vocabulary(path or vocabulary()))
    kind = dict(df.dtypes)[id_col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(content.value)
        for batch in batches:
            sizes = pa.array([own.count(t) for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], [id_col, "size"])

    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(count, f"`{id_col}` {kind}, size INT")
