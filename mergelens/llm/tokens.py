"""Problem 7: encoding with a public byte-level BPE vocabulary.

Texts are split by the vocabulary's public pattern; each distinct piece of an Arrow
batch is encoded once. Pieces are bucketed by length into padded numpy matrices, a
row for each piece, and in each round every row merges its leftmost pair of minimum
rank, with hashed pair lookup, until no row can merge. Pieces beyond the matrix width
merge all their disjoint pairs of minimum rank in a round, which gives the same ids.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelens.session import ship

#: Folder of the public vocabulary files; they are read there and never copied.
VOCABULARIES = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Widest row of a matrix, in bytes; longer pieces are merged one by one.
WIDTH = 64
NONE = np.int64(2**31 - 1)


class Encoder:
    """Byte-level BPE over one rank file."""

    def __init__(self, path: str) -> None:
        import regex

        self.split = regex.compile(PATTERN)
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.size = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self._hash(np.fromiter(pairs, dtype=np.int64, count=len(pairs)), np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs)))
        self.known: dict[str, np.ndarray] = {}

    def _hash(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open-addressed table; probes are vectorised over all keys at once."""
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, NONE, dtype=np.int64)
        left, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            free = self.keys[slot[left]] < 0
            placed = left[free]
            _, first = np.unique(slot[placed], return_index=True)
            placed = placed[first]
            self.keys[slot[placed]], self.ranks[slot[placed]] = keys[placed], ranks[placed]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, ``NONE`` where there is none (or either side is negative)."""
        shape, keys = left.shape, (left * self.size + right).ravel()
        out = np.full(keys.shape, NONE, dtype=np.int64)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[open_])
        for _ in range(self.probes):
            at = self.keys[slot]
            hit = at == keys[open_]
            out[open_[hit]] = self.ranks[slot[hit]]
            on = ~hit & (at >= 0)
            open_, slot = open_[on], (slot[on] + 1) & ((1 << self.bits) - 1)
            if not len(open_):
                break
        return out.reshape(shape)

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of one length bucket."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        ids = np.full((len(pieces), width), -1, dtype=np.int64)
        inside = np.arange(width) < lengths[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(pieces)
        rows = np.arange(len(pieces))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(pieces), 0), NONE)
        while True:
            if ids.shape[1] > 1:
                best = ranks.argmin(axis=1)
                low = ranks[np.arange(len(rows)), best]
            else:
                best, low = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), NONE)
            done = low == NONE
            if done.any():
                for at in np.flatnonzero(done):
                    out[rows[at]] = ids[at][: lengths[at]]
                go = ~done
                rows, ids, ranks, lengths, best, low = rows[go], ids[go], ranks[go], lengths[go], best[go], low[go]
            if not len(rows):
                return out
            row = np.arange(len(rows))
            ids[row, best] = low
            # compaction: what is right of the merged pair moves left by one
            column = np.arange(ids.shape[1] - 1)
            source = column + (column > best[:, None])
            merged = np.take_along_axis(ids, source, axis=1)
            merged[column >= (lengths - 1)[:, None]] = -1
            ids, lengths = merged, lengths - 1
            wide = int(lengths.max())
            ids = ids[:, :wide]
            if wide > 1:
                source = np.arange(ids.shape[1] - 1)
                source = source + (source > best[:, None])
                ranks = np.take_along_axis(ranks, np.minimum(source, ranks.shape[1] - 1), axis=1)
                for step in (-1, 0):  # only the two pairs beside the merged token are new
                    at = best + step
                    ok = (at >= 0) & (at < ids.shape[1] - 1)
                    ranks[row[ok], at[ok]] = self.pair_ranks(ids[row[ok], at[ok]], ids[row[ok], at[ok] + 1])
                ranks[np.arange(ids.shape[1] - 1) >= (lengths - 1)[:, None]] = NONE

    def _long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece of any length: a round merges all disjoint pairs of minimum rank."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        while len(ids) > 1:
            ranks = self.pair_ranks(ids[:-1], ids[1:])
            low = ranks.min()
            if low == NONE:
                break
            at = np.flatnonzero(ranks == low)
            run = np.cumsum(np.concatenate([[0], (np.diff(at) != 1).astype(np.int64)]))
            first = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
            at = at[(np.arange(len(at)) - first[run]) % 2 == 0]  # of touching pairs every other one, from the left
            ids[at] = low
            ids = np.delete(ids, at + 1)
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) > WIDTH:
                out[i] = self._long(piece)
            elif piece:
                buckets.setdefault(int(len(piece) - 1).bit_length(), []).append(i)
        for own in buckets.values():
            for start in range(0, len(own), 8192):
                part = own[start : start + 8192]
                for i, ids in zip(part, self._matrix([pieces[j] for j in part])):
                    out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; empty and null ones have none."""
        split = [self.split.findall(t) if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in self.known})
        if len(self.known) + len(new) > 200_000:  # the memory of pieces is bounded
            self.known.clear()
            new = list({w for words in split for w in words})
        self.known.update(zip(new, self.encode_pieces([w.encode("utf-8", "surrogatepass") for w in new])))
        empty = np.empty(0, dtype=np.int64)
        return [np.concatenate([self.known[w] for w in words]) if words else empty for words in split]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path(folder: str | None = None, name: str = VOCABULARY) -> str:
    return os.path.join(folder or VOCABULARIES, name)


def send_vocabulary(path: str | None = None) -> str:
    """Gives the vocabulary file, which only the driver need have, to all executors; its name there."""
    spark = SparkSession.active()
    ship(spark)
    where = path or vocabulary_path()
    spark.sparkContext.addFile(where)
    return os.path.basename(where)


def encode_column(text: Column, path: str | None = None) -> Column:
    """Token ids of ``text`` as ``array<int>``; an empty list for empty and null texts."""
    name = send_vocabulary(path)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoder(SparkFiles.get(name))
        for texts in batches:
            yield pd.Series([x.astype(np.int32) for x in coder.encode(texts.tolist())], dtype=object)

    return ids(text)


def count_column(text: Column, path: str | None = None) -> Column:
    """Number of tokens of ``text`` as bigint; 0 for empty and null texts."""
    name = send_vocabulary(path)

    @F.pandas_udf(T.LongType())
    def n(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoder(SparkFiles.get(name))
        for texts in batches:
            yield pd.Series([len(x) for x in coder.encode(texts.tolist())], dtype="int64")

    return n(text)


def encode_corpus(df: DataFrame, text: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with the token ids of ``text``; what looks like a special token is text.

    Rows are kept as they are, repeated ones too; ``into`` is replaced if it exists;
    an empty table stays empty.
    """
    return df.withColumn(into, encode_column(F.col(text), path))
