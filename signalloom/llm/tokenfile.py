"""Token ids in Parquet: list columns in ascending doc_id order, for selective reads.

Files are range-partitioned and sorted by doc_id, so row-group and page statistics of doc_id and n_tokens let a reader
skip what it does not want, and reading metadata never touches the ids. Ids are stored with a dictionary while that
is small and with delta encoding beyond it (format version 2); row groups and pages have set sizes and page indexes.

A tokenizer of the known kind splits normalised text into pieces and encodes each on its own. Workers split plain texts
(printable characters up to U+017F, which the normalisation only lower-cases) themselves, a batch at once in Arrow, and look each
distinct word of a batch up once among those whose ids they keep; new words' pieces go to the library's BPE model, and all other
texts, or those for another kind of tokenizer, to the whole library.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalloom.llm import wordhash
from signalloom.llm.bpe import LETTERS, NUMBERS, byte_names
from signalloom.llm.common import materialize, only, shuffle_partitions, small_batches
from signalloom.llm.pieces import PieceIds

CACHED_WORDS, CACHED_PIECES = 600_000, 300_000
BATCH_BYTES = 4 << 20
#: Texts of printable characters up to U+017F, but for the letter whose lower case is two characters.
PLAIN = r"\A[\t\n\r -~¡-įı-ſ]*\z"
FILE_BYTES = 128 << 20
BLOCK_ROWS = 8192

#: The normalisation and the split of the known kind of tokenizer, as its file states them.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The same split of plain texts; letters come first, as the most frequent of alternatives that begin differently.
PIECES = re.compile(rf"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+").findall


class PieceTokenizer:
    """A tokenizer of the library, with the ids of pieces kept where it is of the known kind."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.known = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and spec["model"]["type"] == "BPE"
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.names = {b: c for c, b in byte_names().items()}
        self.model = self.tokenizer.model
        self.words, self.pieces = PieceIds(CACHED_WORDS), {}

    def _ids(self, piece: str) -> tuple[int, ...]:
        said = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.names)
        return tuple([t.id for t in self.model.tokenize(said)])

    def _learn(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of new words, piece by piece; pieces that other words have too are encoded once."""
        gc.disable()  # very many objects, none of which is part of a cycle
        try:
            if len(self.pieces) > CACHED_PIECES:
                self.pieces = {}
            known, ids, out = self.pieces, self._ids, []
            for word in words:
                found = ()
                for piece in PIECES(word):
                    own = known.get(piece)
                    if own is None:
                        own = known[piece] = ids(piece)
                    found += own
                out.append(found)
            return out
        finally:
            gc.enable()

    def _plain(self, texts: pa.Array) -> np.ndarray:
        plain = pc.match_substring_regex(texts, PLAIN)
        for special in self.special:
            plain = pc.and_not(plain, pc.match_substring(texts, special))
        return plain.to_numpy(zero_copy_only=False).astype(bool) & self.known

    def encode_batch(self, texts: Iterable[str | None] | pa.Array, end: int) -> list[np.ndarray]:
        """The ids of each text, null being empty, ended by end."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        plain = self._plain(texts)
        words, bounds = wordhash.split(pc.utf8_lower(texts.filter(pa.array(plain))))
        coded = words.dictionary_encode()
        place = self.words.find(coded.dictionary.to_pylist(), self._learn)
        ids, count = self.words.ids_at(place[coded.indices.to_numpy()])
        cuts = np.concatenate([[0], np.cumsum(count)])[bounds]
        mine = iter(np.split(np.insert(ids, cuts[1:], np.uint32(end)), cuts[1:-1] + np.arange(1, len(cuts) - 1)))
        others = self.tokenizer.encode_batch_fast(texts.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)
        theirs = (np.append(np.array(x.ids, "<u4"), np.uint32(end)) for x in others)
        return [next(mine if p else theirs) for p in plain]


@lru_cache(maxsize=2)
def load(path: str) -> PieceTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core already
    return PieceTokenizer(path)


def encode_tokens(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, token_ids, n_tokens) of whole texts, each ended by end_id; a null text is empty."""

    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        for batch in batches:
            for a, b in wordhash.slices(batch.column(1), BATCH_BYTES):
                found = tokenizer.encode_batch(batch.column(1).slice(a, b - a), end_id)
                n = np.array([len(x) for x in found], np.int64)
                ids = pa.array(np.concatenate(found).view("<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(n)], ["doc_id", "token_ids", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return only(docs, "doc_id", "text").mapInArrow(of, f"doc_id {kind}, token_ids array<int>, n_tokens long")


def in_ranges(docs: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """docs(doc_id, text) dealt by ranges of doc_id and sorted, nulls first, with about so many bytes of text in each.

    The texts are dealt before they are encoded: finding the ranges reads all rows once more, and would encode them
    twice. Rows that share a doc_id follow each other by the hash of their text; a range may end among them, so a doc_id
    of very many rows, null included, is spread over as many tasks as it needs.
    """
    docs = only(docs, "doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), -(-total // file_bytes))
    order = [F.col("doc_id").asc_nulls_first(), "__tie", "__row"]
    docs = docs.withColumns({"__tie": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    return docs.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("__tie", "__row")


def write_tokens(
    tokens: DataFrame,
    path: str,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    dictionary_bytes: int = 1 << 20,
) -> None:
    """Write (doc_id, token_ids, n_tokens) of documents that in_ranges has dealt and sorted, a file for each range."""
    options = {
        "parquet.writer.version": "v2",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.enable.dictionary": "true",
        "parquet.dictionary.page.size": dictionary_bytes,
        "compression": "zstd",
    }
    tokens.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, and token_ids on demand.

    start counts the ids of all documents before it in the files, which are in ascending doc_id order. Files and blocks of
    ``BLOCK_ROWS`` documents are summed first, then each block counts on from its sum; no task sees all rows. An empty
    table has no rows.
    """

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("token_ids")
            ids = np.ascontiguousarray(lists.flatten().to_numpy(), "<i4").view(np.uint8)
            ends = 4 * np.cumsum(pc.list_value_length(lists).to_numpy())
            found = [zlib.crc32(ids[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []
            yield batch.drop_columns(["token_ids"]).append_column("ids_crc32", pa.array(found, pa.int64()))

    files = spark.read.schema("doc_id long, token_ids array<int>, n_tokens long").parquet(path)
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")]
    rows = files.select("doc_id", "n_tokens", "token_ids", *place)
    rows = rows.mapInArrow(crc, "doc_id long, n_tokens long, file string, at long, ids_crc32 long")
    rows = rows.withColumn("block", F.floor(F.col("at") / BLOCK_ROWS))
    rows = materialize(rows.withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("int")), "tokens")

    def before(df: DataFrame, window) -> DataFrame:
        total = F.sum("n_tokens").over(window.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
        return df.withColumn("before", total)

    blocks = rows.groupBy("part", "file", "block").agg(F.sum("n_tokens").alias("n_tokens"))
    totals = blocks.groupBy("part", "file").agg(F.sum("n_tokens").alias("n_tokens"))
    base = before(totals, Window.orderBy("part", "file"))  # a row a file
    base = base.select("file", F.col("before").alias("base"))
    blocks = before(blocks, Window.partitionBy("file").orderBy("block")).select("file", "block", F.col("before").alias("so_far"))
    blocks = blocks.join(base, "file").select("file", "block", (F.col("base") + F.col("so_far")).alias("base"))
    placed = before(rows, Window.partitionBy("file", "block").orderBy("at")).join(blocks, ["file", "block"])
    out = placed.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file", "at")
    if not with_ids:
        return out.drop("file", "at")
    return out.join(files.select("token_ids", *place), ["file", "at"]).drop("file", "at")
