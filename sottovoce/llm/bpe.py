"""Byte-level BPE encoding and decoding by a rank queue.

A pre-token's bytes form a linked list. Every pair that has a merge rank waits in that rank's bucket by its left
position; a two-level bitmap tells the lowest rank that waits (find-first-set), and entries whose pair has changed since
are skipped when they come up. A pre-token of n bytes takes O(n log n) steps, however long it is. Pre-tokens that recur
are remembered, up to a bound.

Defined cases: null counts as empty; an empty text has no ids and decodes to no bytes; text that looks like a special
token is ordinary text; bytes without a rank raise an error, as then the ranks are no byte-level vocabulary; columns that
bear a result's name come back as kept_<name>, further columns untouched."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.llm.common import clear_of, prepare, table

#: Remembered pre-tokens in a task's process (and as many of the time before), and the longest that is remembered (in characters).
REMEMBERED, LONGEST_REMEMBERED = 500_000, 48


def parse_ranks(file: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file.splitlines() if line)}


_BIT = [1 << k for k in range(256)]
_COUNT = list(range(-1, 4096))


def merge_piece(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """The ids of one pre-token.

    The queue: `buckets` holds, by rank, the left positions of the pairs that wait, smallest first; `words` and `top`
    are the bitmap of the ranks in use, 256 to a word."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    before = _COUNT[: n + 2] if n < 4000 else list(range(-1, n + 1))
    after = _COUNT[2 : n + 4] if n < 4000 else list(range(1, n + 3))
    rank_at = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # of the pair that starts there; -1: none
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    for i, rank in enumerate(rank_at):
        if rank >= 0:
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                high = rank >> 8
                words[high] = words.get(high, 0) | _BIT[rank & 255]
                top |= 1 << high
    rank_at += (-1, -1)
    while top:
        high = (top & -top).bit_length() - 1
        word = words[high]
        rank = high << 8 | (word & -word).bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket) if len(bucket) > 1 else bucket.pop()
        if not bucket:
            del buckets[rank]
            word &= word - 1
            words[high] = word
            if not word:
                top &= top - 1
        if rank_at[i] != rank:
            continue  # stale: this pair has changed
        j = after[i]
        k = after[j]
        after[i], before[k], rank_at[j] = k, i, -1
        left = before[i]
        rank_at[i] = -1
        if k < n and (end := after[k]) - i <= longest and (rank := get(piece[i:end])) is not None:
            rank_at[i] = rank
            if rank in buckets:
                heappush(buckets[rank], i)
            else:
                buckets[rank] = [i]
                high = rank >> 8
                words[high] = words.get(high, 0) | _BIT[rank & 255]
                top |= 1 << high
        if left >= 0:
            rank_at[left] = -1
            if k - left <= longest and (rank := get(piece[left:k])) is not None:
                rank_at[left] = rank
                if rank in buckets:
                    heappush(buckets[rank], left)
                else:
                    buckets[rank] = [left]
                    high = rank >> 8
                    words[high] = words.get(high, 0) | _BIT[rank & 255]
                    top |= 1 << high
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Encoder(dict):
    """Remembers the ids (little-endian, 32 bits each) of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.longest, self.earlier = ranks, max(map(len, ranks)), {}
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def __missing__(self, piece: str) -> bytes:
        ids = self.earlier.get(piece)
        if ids is None:
            found = merge_piece(piece.encode(), self.ranks, self.longest)
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.earlier = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text))) if text else b""

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())) if ids else b""


#: One encoder in a process, by the digest of its ranks and pattern.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(file: bytes, pattern: str) -> Encoder:
    name = hashlib.sha256(file + pattern.encode()).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(parse_ranks(file), pattern)
    return _ENCODERS[name]


class Tokenizer:
    """Columns of ids and of decoded bytes, by the ranks of a file and the pattern that splits text before the merges. The file is read once, by the driver, and broadcast; its size is the vocabulary's."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str) -> None:
        prepare(spark)
        with open(ranks_path, "rb") as f:
            file = spark.sparkContext.broadcast(f.read())

        @F.pandas_udf("binary")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from sottovoce.llm import bpe

            for texts in batches:
                yield texts.map(bpe._encoder(file.value, pattern).encode)

        @F.pandas_udf("binary")
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from sottovoce.llm import bpe

            for ids in batches:
                yield ids.map(bpe._encoder(file.value, pattern).decode)

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        """The ids as little-endian unsigned 32-bit integers, joined."""
        return self._encode(F.coalesce(text, F.lit("")))

    def decode(self, ids: Column) -> Column:
        """The bytes that ids (as encode gives them) stand for."""
        return self._decode(ids)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of each text (see Tokenizer.encode) and n_tokens."""
    tokenizer = Tokenizer(docs.sparkSession, ranks_path, pattern)
    clear, of = clear_of(docs, ids_col, "n_tokens")
    coded = clear.withColumn(ids_col, tokenizer.encode(of(text_col)))
    return coded.withColumn("n_tokens", (F.octet_length(ids_col) / 4).cast("long"))


def decode(coded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """coded with the bytes of its ids; cast them to string for text."""
    clear, of = clear_of(coded, bytes_col)
    return clear.withColumn(bytes_col, Tokenizer(coded.sparkSession, ranks_path, pattern).decode(of(ids_col)))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    how = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *how)
    both = decode(coded.select("doc_id", "n_tokens", "ids"), *how)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
