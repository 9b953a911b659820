"""BPE encoding and decoding by traversal of a trie of words.

BPE never changes its mind about a prefix: cutting the last token off the encoding of a prefix leaves the encoding of
a shorter prefix. So an encoding is known from one state for each prefix, its last token: the one vocabulary entry
that ends the prefix and may follow the last token of what stands before it. The distinct words of a batch form a
trie; walking it depth first passes the states down, and a prefix that many words share is computed once. Words in
byte order are the trie in depth-first order: the node where two neighbours part is their common prefix, and the
states on the way to it stay on the stack.

Two tokens may stand side by side if no merge reaches across them. A merge across joins a piece on the right edge of
the left token with a piece on the left edge of the right one, at a moment when both are whole and neither has been
merged further; the edges' pieces and the ranks at which they are made decide it.

The vocabulary file is that of the tokenizers library, byte-level BPE; its path is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import by_size, only, small_batches
from signalloom.llm.pieces import PieceIds

#: The characters that count as white space, and the pattern by which byte-level BPE splits text.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"""
#: Texts of printable characters up to U+024F, whose letters and numbers are these, and the same split of them; letters come
#: first, as the most frequent of alternatives that begin differently.
PLAIN = re.compile("[\t\n\r -~¡-ɏ]*").fullmatch
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
PLAIN_WORDS = re.compile(
    rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
).findall
FOREVER = 1 << 60
CACHED_WORDS = 400_000
CACHED_PAIRS = 250_000
BATCH_CHARS = 1 << 20


def byte_names() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: a byte that prints is itself, the rest follow from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["normalizer"] is not None or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a byte-level BPE without normalisation and prefix space")
        names, model = byte_names(), spec["model"]
        vocab = {bytes(names[c] for c in token): i for token, i in model["vocab"].items()}
        self.vocab, self.longest = vocab, max(map(len, vocab))
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words = regex.compile(PATTERN).findall
        size = max([*vocab.values(), *special.values()]) + 1
        self.text = [b""] * size
        for token, i in [*vocab.items(), *((s.encode(), i) for s, i in special.items())]:
            self.text[i] = token
        self.rank: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (vocab[bytes(names[c] for c in x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[left, right] = rank
            halves.setdefault(vocab[self.text[left] + self.text[right]], (left, right, rank))
        self.halves = halves
        self.fits: dict[int, bool] = {}
        self.pieces = PieceIds(CACHED_WORDS, {s: (i,) for s, i in special.items()})

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces on an edge of a token, from the whole token inwards, each with the rank at which it is merged away."""
        halves, out, away = self.halves, [(token, FOREVER)], FOREVER
        while token in halves:
            away = halves[token][2]
            token = halves[token][side]
            out.append((token, away))
        return out

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as they are when they stand side by side."""
        rank, edge = self.rank.get, self._edge(right, 0)
        for a, a_gone in self._edge(left, 1):
            for b, b_gone in edge:
                merge = rank((a, b))
                # at equal ranks the leftmost merge is first: inside the left token before this, this before the right
                if merge is not None and merge < a_gone and merge <= b_gone:
                    return False
        return True

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """The encodings of words, by a depth-first walk of their trie."""
        find, fits, longest = self.vocab.get, self.fits, self.longest
        out: dict[bytes, tuple[int, ...]] = {}
        before, last = b"", [-1]  # last[d]: the last token of the prefix of d bytes
        for word in sorted(set(words)):
            most = min(len(before), len(word))
            shared = 0
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(end - 1, max(end - longest, 0) - 1, -1):
                    token = find(word[start:end])
                    if token is None:
                        continue
                    left = last[start]
                    if left < 0:
                        break
                    pair = left << 20 | token
                    good = fits.get(pair)
                    if good is None:
                        good = fits[pair] = self.may_follow(left, token)
                    if good:
                        break
                last.append(token)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= len(self.text[last[at]])
            out[word] = tuple(reversed(ids))
            before = word
        if len(fits) > CACHED_PAIRS:
            fits.clear()
        return out

    def _learn(self, words: list[str]) -> list[tuple[int, ...]]:
        """The encodings of new words, all in one trie."""
        said = [w.encode() for w in words]
        coded = self.encode_words(said)
        return [coded[w] for w in said]

    def _split(self, text: str) -> list[str]:
        return PLAIN_WORDS(text) if PLAIN(text) else self.words(text)

    def encode_batch(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """ids of whole texts; null is empty, and the strings of special tokens are those tokens."""
        split = []
        for text in texts:
            parts = self.split_special.split(text or "") if self.split_special else [text or ""]
            split.append(self._split(parts[0]) if len(parts) == 1 else [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self._split(p))])
        return self.pieces.gather(split, self._learn)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> TrieBPE:
    """One encoder for each task of a worker process."""
    return TrieBPE(path)


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Adds to each row of docs(doc_id, text): token_ids (unless with_ids is off), n_tokens, ids_sha256,
    decoded_sha256; returns these with doc_id.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the text decoded from them.
    Null and empty texts have no tokens. Null and repeated doc_ids are kept as they are; an empty table gives an empty
    result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    ids_type = "token_ids array<int>, " if with_ids else ""
    schema = f"struct<{ids_type}n_tokens long, ids_sha256 string, decoded_sha256 string>"

    def coded(texts: pd.Series) -> pd.DataFrame:
        bpe, rows = load(path), []
        for part in by_size(texts, BATCH_CHARS):
            for ids in bpe.encode_batch(part):
                said = hashlib.sha256(bpe.decode(ids).encode()).hexdigest()
                row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), said)
                rows.append(((ids.view("<i4"), *row)) if with_ids else row)
        names = [*(["token_ids"] if with_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]
        return pd.DataFrame(rows, columns=names)

    @F.pandas_udf(schema)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            yield from map(coded, batches)
        finally:  # a worker outlives its tasks, and what it has kept would stay beside the work of later stages
            load.cache_clear()

    return only(docs, "doc_id", "text").select("doc_id", of("text").alias("code")).select("doc_id", "code.*")
