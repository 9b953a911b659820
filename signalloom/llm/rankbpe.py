"""Byte-level BPE by ranks, encoded and decoded: a two-tier lookup of pre-tokens.

The first tier is a minimal perfect hash of the vocabulary: a pre-token that is an entry as a whole has its id at once,
whatever the merges would make of it. Each key has a slot of its own among as many slots as there are keys (hash and
displace: keys fall into buckets, and each bucket has the first displacement with which all its keys find free slots;
buckets of one key name a slot outright). The second tier encodes the others: their bytes form a linked list, a heap holds
the pairs of neighbours that are an entry when joined, and the pair of the lowest rank, the leftmost of equals, is joined
until none is left. A pair that has changed since it was pushed is skipped when it comes up, so a pre-token of n bytes
takes n log n steps, however long it is.

The vocabulary file has a line an entry, base64 of its bytes and its rank, which is its id; its path is a parameter.
Workers remember the ids of a bounded number of pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm import bpe
from signalloom.llm.common import by_size, only, small_batches
from signalloom.llm.pieces import PieceIds

#: Fixed value: the pattern of which ``bpe.PATTERN`` and ``bpe.PLAIN_WORDS`` make the same split.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_WORDS = 400_000
BATCH_CHARS = 1 << 20
BUCKET_KEYS = 4
TRIES_AT_ONCE = 256


class MinimalPerfectHash:
    """For each of n distinct keys a slot of its own below n; any other key gets some slot too."""

    def __init__(self, keys: Sequence[bytes]):
        self.n, self.buckets, self.seed = len(keys), max(1, len(keys) // BUCKET_KEYS), 0
        while not self._build(keys):
            self.seed += 1

    def _hash(self, keys: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        digest, seed = xxhash.xxh3_128_digest, self.seed
        both = np.frombuffer(b"".join([digest(k, seed) for k in keys]), "<u8").reshape(-1, 2)
        return (both[:, 0] % np.uint64(self.buckets)).astype(np.int64), both[:, 1]

    def _slots(self, h: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        x = (h ^ (displacement.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(16)) % np.uint64(self.n)).astype(np.int64)

    def _build(self, keys: Sequence[bytes]) -> bool:
        self.displacement = np.zeros(self.buckets, np.int64)
        if not self.n:
            return True
        bucket, h = self._hash(keys)
        if len(np.unique(h)) < self.n:
            return False
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        start = np.cumsum(size) - size
        free = np.ones(self.n, bool)
        for b in np.argsort(-size, kind="stable").tolist():
            if size[b] < 2:
                break
            own = h[order[start[b] : start[b] + size[b]]]
            for first in range(0, 64 * self.n, TRIES_AT_ONCE):
                tried = np.arange(first, first + TRIES_AT_ONCE)
                slots = np.sort(self._slots(own[None], tried[:, None]), axis=1)
                good = free[slots].all(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1)
                if good.any():
                    nth = int(good.argmax())
                    self.displacement[b] = first + nth
                    free[slots[nth]] = False
                    break
            else:
                return False
        alone = np.flatnonzero(size == 1)
        self.displacement[alone] = -1 - np.flatnonzero(free)[: len(alone)]
        return True

    def slots(self, keys: Sequence[bytes]) -> np.ndarray:
        if not self.n or not len(keys):
            return np.zeros(len(keys), np.int64)
        bucket, h = self._hash(keys)
        d = self.displacement[bucket]
        return np.where(d < 0, -1 - d, self._slots(h, np.maximum(d, 0)))


class RankBPE:
    """Encoder and decoder of one vocabulary of ranks; ids and ranks are the same."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as file:
            lines = [x.split() for x in file if x.strip()]
        ids = {base64.b64decode(token): int(rank) for token, rank in lines}
        if any(bytes([b]) not in ids for b in range(256)):
            raise ValueError("not a byte-level vocabulary: it lacks a byte")
        tokens = list(ids)
        self.size = max(ids.values()) + 1
        self.text = [b""] * self.size
        for token, i in ids.items():
            self.text[i] = token
        self.whole = MinimalPerfectHash(tokens)
        self.held, self.held_id = [b""] * len(tokens), [0] * len(tokens)
        for token, slot in zip(tokens, self.whole.slots(tokens).tolist(), strict=True):
            self.held[slot], self.held_id[slot] = token, ids[token]
        self.byte = [ids[bytes([b])] for b in range(256)]
        halves = ((ids.get(t[:cut]), ids.get(t[cut:]), i) for t, i in ids.items() for cut in range(1, len(t)))
        self.joined = {a * self.size + b: i for a, b, i in halves if a is not None and b is not None}
        self.words = bpe.PLAIN_WORDS, regex.compile(bpe.PATTERN).findall
        if pattern != PATTERN:
            own = regex.compile(pattern)
            self.words = (lambda text: [m.group() for m in own.finditer(text)],) * 2
        self.pieces = PieceIds(CACHED_WORDS)

    def find(self, pieces: Sequence[bytes]) -> list[int]:
        """The ids of pieces that are entries, -1 for others: the first tier."""
        held, held_id = self.held, self.held_id
        return [held_id[s] if held[s] == p else -1 for p, s in zip(pieces, self.whole.slots(pieces).tolist(), strict=True)]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece by its merges: the second tier."""
        size, joined, byte, n = self.size, self.joined.get, self.byte, len(piece)
        ids = [byte[b] for b in piece]
        made = [joined(a * size + b) for a, b in zip(ids, ids[1:])]  # of each part and its right neighbour
        heap = [i << 40 | at for at, i in enumerate(made) if i is not None]
        heapify(heap)
        made.append(None)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            best = heappop(heap)
            at = best & (1 << 40) - 1
            i = best >> 40
            if made[at] != i:
                continue
            gone = right[at]
            after = right[at] = right[gone]
            ids[at], ids[gone], made[gone] = i, None, None
            if after < n:
                left[after] = at
                new = made[at] = joined(i * size + ids[after])
                if new is not None:
                    heappush(heap, new << 40 | at)
            else:
                made[at] = None
            before = left[at]
            if before >= 0:
                new = made[before] = joined(ids[before] * size + i)
                if new is not None:
                    heappush(heap, new << 40 | before)
        return [i for i in ids if i is not None]

    def _learn(self, words: list[str]) -> list[Sequence[int]]:
        said = [w.encode() for w in words]
        return [(i,) if i >= 0 else self.merge(w) for w, i in zip(said, self.find(said), strict=True)]

    def encode_batch(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """ids of whole texts; null is empty."""
        plain, any_ = self.words
        return self.pieces.gather([plain(t) if bpe.PLAIN(t) else any_(t) for t in (t or "" for t in texts)], self._learn)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.text.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str = PATTERN) -> RankBPE:
    """One encoder for each worker process."""
    return RankBPE(path, pattern)


def _rows(docs: DataFrame, schema: str, row: Callable[[RankBPE, np.ndarray], tuple], path: str, pattern: str) -> DataFrame:
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    @F.pandas_udf(f"struct<{schema}>")
    def of(texts: pd.Series) -> pd.DataFrame:
        coder = load(path, pattern)
        found = [row(coder, ids) for part in by_size(texts, BATCH_CHARS) for ids in coder.encode_batch(part)]
        return pd.DataFrame(found, columns=names)

    return only(docs, "doc_id", "text").select("doc_id", of("text").alias("code")).select("doc_id", "code.*")


def encode(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, token_ids array<int>, n_tokens) of every row of docs(doc_id, text), without special tokens.

    Null and empty texts have no tokens. Null and repeated doc_ids are kept as they are; an empty table gives an empty
    result; other columns are ignored. A very long word, even a text without any space, is one pre-token.
    """
    return _rows(docs, "token_ids array<int>, n_tokens long", lambda _, ids: (ids.view("<i4"), len(ids)), path, pattern)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded binary) of every row of coded(doc_id, token_ids): the bytes of the ids, null for null."""

    @F.pandas_udf("binary")
    def of(ids: pd.Series) -> pd.Series:
        coder = load(path)
        return pd.Series([None if x is None else coder.decode(x) for x in ids], dtype=object)

    return only(coded, "doc_id", "token_ids").select("doc_id", of("token_ids").alias("decoded"))


def digests(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): of the ids as little-endian unsigned 32-bit integers, and of the bytes
    decoded from them. Rows are treated as by encode; ids never leave the workers."""

    def row(coder: RankBPE, ids: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()

    return _rows(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", row, path, pattern)
