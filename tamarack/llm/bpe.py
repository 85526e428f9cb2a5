"""Byte-level BPE encoding of a corpus in a public vocabulary.

Each piece of the pre-tokenising pattern starts as its bytes, symbols of a doubly linked list. A
priority queue holds the merge rank of every neighbouring pair; the lowest rank, leftmost first,
is merged, and entries whose symbols have changed since are skipped when they come up. A piece of
n bytes takes O(n log n), so a text without blanks is no trap. Decoding concatenates the
vocabulary's strings.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tamarack.plans.scale import ship_code, spread

#: Where the rank file is; a parameter of everything below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's pre-tokenising pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded pieces that a worker remembers, and the longest of them.
KEPT_PIECES, KEPT_LENGTH = 100_000, 200


class Encoder:
    """Encoder and decoder of one vocabulary, given as the contents of its rank file."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; of null and empty texts, none. Strings that look like special tokens are plain text."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = self._merge(piece.encode())
                if len(piece) <= KEPT_LENGTH:
                    if len(known) >= KEPT_PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", errors="replace")

    def _merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        # symbol i covers piece[i:after[i]]; gone symbols have after 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, end = heapq.heappop(queue)
            j = after[i]
            if not j or j == n or after[j] != end:
                continue  # stale: one of the two has been merged since
            after[i], after[j] = end, 0
            if end < n:
                before[end] = i
                if (rank := ranks.get(piece[i : after[end]])) is not None:
                    heapq.heappush(queue, (rank, i, after[end]))
            if (h := before[i]) >= 0 and (rank := ranks.get(piece[h:end])) is not None:
                heapq.heappush(queue, (rank, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(ranks: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = hash(ranks)
    if key not in _encoders:
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def _share(df: DataFrame, vocabulary: str):
    """The rank file (below 1 MB) for all workers."""
    ship_code(df.sparkSession)
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _ids(texts: pa.Array, encoder: Encoder) -> tuple[np.ndarray, list[int]]:
    ends, flat = [0], []
    for text in texts.to_pylist():
        flat += encoder.encode(text)
        ends.append(len(flat))
    return np.array(ends, dtype=np.int32), flat


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, ids)`` for every row; null and empty texts have an empty list."""
    shared = _share(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for b in batches:
            ends, flat = _ids(b.column(1), encoder)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["key", "ids"])

    rows = spread(df.select(df[f"`{key}`"].alias("key"), df[f"`{text}`"].alias("text")))
    schema = T.StructType([rows.schema["key"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def count_tokens(df: DataFrame, keys: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(*keys, n_tokens)`` for every row."""
    shared = _share(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for b in batches:
            counts = [len(encoder.encode(t)) for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(counts, pa.int64())], names=[*keys, "n_tokens"])

    rows = spread(df.select(*[df[f"`{k}`"] for k in keys], df[f"`{text}`"].alias("_text")))
    return rows.mapInArrow(run, T.StructType([*[rows.schema[k] for k in keys], T.StructField("n_tokens", T.LongType())]))


def decode_corpus(df: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, text)`` for every row; null ids decode to null."""
    shared = _share(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for b in batches:
            texts = [None if i is None else encoder.decode(i) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    rows = df.select(df[f"`{key}`"].alias("key"), df[f"`{ids}`"].alias("ids"))
    return rows.mapInArrow(run, T.StructType([rows.schema["key"], T.StructField("text", T.StringType())])).withColumnRenamed("key", key)
