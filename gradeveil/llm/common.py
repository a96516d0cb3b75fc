"""What the operators of this subpackage share: the shared folder, written tables, packed arrays, and the
exchange of sorted 64-bit keys between blocks of documents and hash buckets.

An operator that has to know something about a key over the whole corpus (how many documents hold a line,
how often a word occurs) does not shuffle one row per occurrence. Documents are gathered into *blocks* of a
bounded number of bytes; each block reduces its keys to distinct ones, cuts the sorted keys into ranges (the
buckets) and sends one packed message per bucket. A bucket sees each key once per block, however hot it is,
and answers each block with one packed message.
"""

from __future__ import annotations

import contextlib
import json
import math
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from gradeveil.functions import shared
from gradeveil.functions.shared import discard as discard

#: Bytes of text in one block; a single longer document makes a block of its own.
BLOCK_BYTES = 4 << 20
#: The word separators of all contracts here: space, and U+0009 to U+000D.
BLANKS = " \t\n\v\f\r"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
NULL_ID = np.iinfo(np.int64).min


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can read, until the program ends."""
    folder = shared.working_folder(spark)
    if _recorded is not None:
        _recorded.append(folder)
    return folder


def free_prefix(columns: Iterable[str], prefix: str = "__") -> str:
    """A beginning of column names that none of these has, whatever the letter case."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


_recorded: list[str] | None = None


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The shared folders that are made in its body, for discard()."""
    global _recorded
    before, _recorded = _recorded, []
    try:
        yield _recorded
    finally:
        _recorded = before


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder, parted by a column if one is named, and reads it back: cuts the lineage, survives
    lost executors. While it writes, Arrow batches are short, since a row may be a whole text or block."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    rows = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, min(int(rows), 500) if int(rows) > 0 else 500)
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, rows)
    return spark.read.schema(df.schema).parquet(path)


def buckets_of(blocks: DataFrame) -> int:
    """Hash buckets for the keys of a written table of blocks: as many as shuffle partitions, and more with the input,
    so that one bucket holds the keys of 512 MB of text at most, and grows with the square root of the input before."""
    megabytes = blocks.count() * BLOCK_BYTES / (1 << 20)
    partitions = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, partitions, math.ceil(math.sqrt(megabytes)), math.ceil(megabytes / 512))


def by_bucket(messages: DataFrame, n: int) -> GroupedData:
    """Messages grouped by bucket, each of the n buckets in a task of its own: Spark deals by hash, so every bucket gets a
    number that hashes to a task which no other bucket has."""
    number = F.col("id").cast("int")
    numbers = messages.sparkSession.range(32 * n).select(F.pmod(F.hash(number), F.lit(n)).alias("bucket"), number.alias("number"))
    # n rows
    tasks = F.broadcast(numbers.groupBy("bucket").agg(F.min("number").alias("number")))
    dealt = messages.join(tasks, "bucket", "left").withColumn("number", F.coalesce("number", "bucket"))
    return dealt.repartition(n, "number").groupBy("number", "bucket")


def dump(*arrays: np.ndarray) -> bytes:
    """Packs numpy arrays into one zstandard frame. All first bytes of an array's elements stand together, then
    all second ones, and so on: the high bytes of codes and of sorted hashes then take next to no room."""
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    raw = b"".join([len(head).to_bytes(4, "little"), head, *(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def load(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in json.loads(raw[4:at]):
        dtype = np.dtype(kind)
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += n * dtype.itemsize
    return out


def tree_sum(parts: DataFrame, fan: int = 256, levels: int = 3) -> DataFrame:
    """parts: slice int, part long, counts binary (arrays by dump). Returns slice and counts, the sums over all parts.
    Every level adds up `fan` parts, so that a task holds one sum and reads `fan` messages of a slice, however many
    parts there are (up to fan**levels)."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for blob in table["counts"]:
            arrays = load(blob.as_py())
            total = arrays if total is None else [a + b for a, b in zip(total, arrays, strict=True)]
        return pa.table({"slice": table["slice"].slice(0, 1), "part": pa.array([table["part"][0].as_py() // fan], pa.int64()), "counts": pa.array([dump(*total)], pa.binary())})

    for level in range(levels):
        by = F.floor(F.col("part") / fan) if level + 1 < levels else F.lit(0)
        parts = parts.groupBy("slice", by.alias("by")).applyInArrow(add, "slice int, part long, counts binary")
    return parts.select("slice", "counts")


def _edges(n: int) -> np.ndarray:
    return np.array([min((b << 64) // n, 2**64 - 1) for b in range(1, n)], np.uint64)


def cut(keys: np.ndarray, n: int) -> np.ndarray:
    """Where the buckets 0..n-1 begin and end in ascending unsigned 64-bit keys."""
    return np.concatenate([[0], np.searchsorted(keys, _edges(n)), [len(keys)]]).astype(np.int64)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each key, in any order."""
    return np.searchsorted(_edges(n), keys, "right")


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads polynomial hashes over all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed(strings: Iterable[str | bytes], n: int, seed: int = 0) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as h

    return np.fromiter((h(s, seed) for s in strings), np.uint64, n)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive elements of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(out)


def ids_of(column: pa.Array) -> np.ndarray:
    """64-bit ids; a null id becomes the least value."""
    return np.asarray(pc.fill_null(column.cast(pa.int64()), NULL_ID))


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of each text (null: none): codes into the distinct words, those words,
    and each text's number of words."""
    if lower:
        texts = pc.ascii_lower(texts)
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, ends = split.flatten(), np.asarray(split.offsets).astype(np.int64)
    coded = flat.dictionary_encode()
    codes, words = np.asarray(coded.indices), coded.dictionary.to_pylist()
    counts = np.diff(ends)
    if "" in words:  # blanks at the ends of a text
        empty = words.index("")
        full = codes != empty
        counts = np.diff(np.concatenate([[0], np.cumsum(full)])[ends])
        codes = codes[full]
        codes = codes - (codes > empty)
        del words[empty]
    return codes.astype(np.uint32), words, counts


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ..., of every (start, length) after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def rows_in(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Regroups batches into tables with at most `limit` bytes of text (one row at least)."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        ends, begin, base = np.cumsum(sizes), 0, 0
        while begin < batch.num_rows:
            end = max(int(np.searchsorted(ends, base + limit - size, "right")), begin + (not held))
            if end > begin:
                held.append(batch.slice(begin, end - begin))
                size += int(ends[end - 1] - base)
                begin, base = end, int(ends[end - 1])
            if begin < batch.num_rows or size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    release_memory()


def block_ids() -> Iterator[int]:
    """Ids for the blocks that this task makes. They are only used once written."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 32
    return iter(range(base, base + (1 << 32)))


def row_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def rows_to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def ipc_to_rows(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def one_by_one(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches as dictionaries; binary values as bytes."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
    release_memory()


def release_memory() -> None:
    """Gives what a task has freed back to the machine: its worker lives on, beside those of other tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def one_blas_thread() -> None:
    """Spark runs one task a core; matrix products in further threads would only take other tasks' time. Does nothing
    where numpy's library is another or can't be found."""
    import ctypes

    maps = Path("/proc/self/maps")
    for path in {line.split()[-1] for line in maps.read_text().splitlines() if "openblas" in line} if maps.exists() else ():
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def pieces_for(total: float, each: float) -> int:
    return max(1, math.ceil(total / each))
