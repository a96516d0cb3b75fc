"""Blocks of documents as coded words, written once so that later passes need not split the texts again."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeveil.llm.common import block_ids, dump, ids_of, load, row_batch, rows_in, words_of, written

SCHEMA = "block long, docs binary, words binary"


@dataclass
class WordBlock:
    ids: np.ndarray  # of the documents
    counts: np.ndarray  # words of each
    codes: np.ndarray  # of all words, into `words`
    words: list[str]

    @classmethod
    def of(cls, table: pa.Table, lower: bool) -> WordBlock:
        codes, words, counts = words_of(table["text"].combine_chunks(), lower)
        return cls(ids_of(table["doc_id"].combine_chunks()), counts, codes, words)

    def packed(self) -> tuple[bytes, bytes]:
        # words hold no blanks, so one blank parts them
        return dump(self.ids, self.counts.astype(np.int32), self.codes), zstandard.ZstdCompressor(level=1).compress(" ".join(self.words).encode())

    @classmethod
    def unpacked(cls, docs: bytes, words: bytes) -> WordBlock:
        ids, counts, codes = load(docs)
        text = zstandard.ZstdDecompressor().decompress(words).decode()
        return cls(ids, counts.astype(np.int64), codes, text.split(" ") if text else [])

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.counts)

    @property
    def row(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def word_blocks(docs: DataFrame, *, lower: bool, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("words", pa.binary())])
        for block, table in zip(block_ids(), rows_in(batches, "text"), strict=False):
            coded, words = WordBlock.of(table, lower).packed()
            yield row_batch(schema, block=[block], docs=[coded], words=[words])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return written(rows.mapInArrow(gather, SCHEMA), "word_blocks")
