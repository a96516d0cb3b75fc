"""Line deduplication by sharded minimal perfect hashes.

Documents are gathered into blocks; a block sends each distinct line key once, with the number of its documents
that hold it and the greatest id among them, to the key's shard. A shard builds a minimal perfect hash over its
distinct keys and adds the counts into the arrays that it indexes. For each block it takes the keys that are to go and
ships a perfect hash over them with compact arrays of fingerprints and greatest holders; the block's documents probe
these arrays with all their lines. No line is joined with another, and a line that a third of all documents holds
costs its shard one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeveil.llm.common import BLANKS, block_ids, bucket_of, buckets_of, by_bucket, cut, dump, hashed, ids_of, ipc_to_rows, load, one_by_one, row_batch, rows_in, rows_to_ipc, written
from gradeveil.llm.perfect_hash import LineCounts, ShippedLines

BLOCKS = "block long, rows binary, sent binary"
SENT = "bucket int, block long, sent binary"
ANSWERS = "block long, bucket int, answer binary"


def line_keys(texts: pa.Array, min_chars: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All lines (null text: one empty line), each text's number of lines, and for the lines whose key has
    min_chars code points or more their positions and the keys' hashes."""
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines, counts = split.flatten(), np.diff(np.asarray(split.offsets).astype(np.int64))
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=BLANKS))
    long = np.flatnonzero(np.asarray(pc.greater_equal(pc.utf8_length(keys), min_chars)))
    coded = keys.take(pa.array(long)).dictionary_encode()
    hashes = hashed(coded.dictionary.to_pylist(), len(coded.dictionary))
    return lines, counts, long, hashes[np.asarray(coded.indices)] if len(long) else np.zeros(0, np.uint64)


def _held(table: pa.Table, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a block, the number of its documents with each, and the greatest of their ids."""
    ids = ids_of(table["__id"].combine_chunks())
    _, counts, at, keys = line_keys(table["__text"].combine_chunks(), min_chars)
    row = np.repeat(np.arange(len(counts)), counts)[at]
    order = np.lexsort((row, keys))
    keys, row = keys[order], row[order]
    new_key = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    new = new_key | np.append(True, row[1:] != row[:-1])[: len(keys)]
    begins = np.flatnonzero(new_key)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(new.astype(np.int64), begins), np.maximum.reduceat(ids[row], begins)


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns docs, all columns kept, with lines dropped from `text`, and n_lines (before) and n_dropped, long.

    A line's key is the line stripped of blanks at both ends, A-Z lower-cased. Keys of min_chars code points or
    more that min_docs documents hold lose all their lines but those in the documents with the greatest id among
    the holders. Null or empty texts have one empty line and come back as empty text; long ones are read whole. Each
    row counts as a document, repeated ones too; rows that share the greatest id all keep the line; a null id is less
    than any other. No rows give no rows. Own columns named n_lines or n_dropped are replaced. Keys are compared by a
    64-bit hash."""
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest if c != text)).alias("__rest"), F.col(f"`{doc_id}`").cast("long").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("rows", pa.binary()), ("sent", pa.binary())])
        for block, table in zip(block_ids(), rows_in(batches, "__text"), strict=False):
            yield row_batch(schema, block=[block], rows=[rows_to_ipc(table)], sent=[dump(*_held(table, min_chars))])

    blocks = written(rows.mapInArrow(gather, BLOCKS), "blocks")
    n = buckets_of(blocks)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("sent", pa.binary())])
        for r in one_by_one(batches):
            arrays = load(r["sent"])
            edges = cut(arrays[0], n)
            full = np.flatnonzero(np.diff(edges))
            yield row_batch(schema, bucket=full.astype(np.int32), block=np.full(len(full), r["block"]), sent=[dump(*(a[edges[b] : edges[b + 1]] for a in arrays)) for b in full])

    def shard(table: pa.Table) -> pa.Table:
        sent = [load(x) for x in table["sent"].to_pylist()]
        counts = LineCounts(np.unique(np.concatenate([keys for keys, _, _ in sent])))
        for arrays in sent:
            counts.add(*arrays)
        answers = []
        for keys, _, _ in sent:
            at = counts.slots(keys)
            drop = counts.counts[at] >= min_docs
            answers.append(dump(*ShippedLines.of(keys[drop], counts.last[at[drop]], keys[~drop]).arrays()) if drop.any() else None)
        out = pa.table({"block": table["block"], "bucket": table["bucket"], "answer": pa.array(answers, pa.binary())})
        return out.filter(pc.is_valid(out["answer"]))

    sent = blocks.select("block", "sent").mapInArrow(send, SENT)
    answers = by_bucket(sent, n).applyInArrow(shard, ANSWERS)
    answered = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))
    fields = rows.schema

    def drop(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in one_by_one(batches):
            table = ipc_to_rows(r["rows"])
            ids = ids_of(table["__id"].combine_chunks())
            lines, counts, at, keys = line_keys(table["__text"].combine_chunks(), min_chars)
            row = np.repeat(np.arange(len(counts)), counts)
            stay = np.ones(len(lines), bool)
            bucket = bucket_of(keys, n)
            by = np.argsort(bucket, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(bucket, minlength=n)))
            for x in r["answers"] or []:
                some = by[ends[x["bucket"]] : ends[x["bucket"] + 1]]
                goes, last = ShippedLines.of_arrays(*load(x["answer"])).probe(keys[some])
                stay[at[some]] = ~(goes & (last != ids[row[at[some]]]))
            kept = np.bincount(row[stay], minlength=len(counts))
            ends = np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), lines.filter(pa.array(stay))), "\n")
            out = table.drop_columns(["__id"]).set_column(table.column_names.index("__text") - 1, "__text", joined)
            out = out.append_column("n_lines", pa.array(counts)).append_column("n_dropped", pa.array(counts - kept))
            yield from out.select(["__rest", "__text", "n_lines", "n_dropped"]).combine_chunks().to_batches(max_chunksize=10_000)

    from pyspark.sql.types import LongType, StructType

    schema = StructType([fields["__rest"], fields["__text"]]).add("n_lines", LongType()).add("n_dropped", LongType())
    out = blocks.select("block", "rows").join(answered, "block", "left").select("rows", "answers").mapInArrow(drop, schema)
    return out.select(*(F.col("__text").alias(c) if c == text else F.col(f"__rest.`{c}`").alias(c) for c in rest), "n_lines", "n_dropped")
