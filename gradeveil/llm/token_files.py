"""Token-id files: independent zstandard frames, a trailing seek table, a checksum for each frame.

Layout of one shard (all integers little-endian):

* data frames: ids of consecutive documents as 16- or 32-bit unsigned integers, about FRAME_IDS ids each and
  cut between documents only, so that a reader decompresses just the frames that hold what it asks for;
* a skippable frame (magic 0x184D2A50) with the zstandard-compressed document index: id width, then per
  document its id, its number of ids and its frame;
* the seek table, a skippable frame (magic 0x184D2A5E) in the public seekable format: per data frame its
  compressed size, its decompressed size and the low 32 bits of XXH64 of its content; then the number of
  frames, a descriptor byte (0x80: checksums) and the magic 0x8F92EAB1.

Any zstandard reader can decompress a shard as a whole. Shards hold ascending, disjoint ranges of doc_id.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from gradeveil.llm.common import dump, id_array, ids_of, load, row_batch, rows_in, shared_folder, written
from gradeveil.llm.encoding import WordEncoder, default_vocabulary, with_end

FRAME_IDS = 16_384
INDEX_MAGIC, SEEK_MAGIC, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1

WRITTEN = "shard int, path string, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, frame int"


def file_system(path: str):
    """The file system of a folder of Spark's, and its path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class ShardWriter:
    def __init__(self, stream, width: int):
        self.stream, self.dtype = stream, np.dtype(f"<u{width}")
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=False)
        self.held: list[np.ndarray] = []
        self.size, self.seek = 0, []
        self.docs: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.frames: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        ends = np.cumsum(counts)
        frames, begin, base = np.empty(len(counts), np.uint32), 0, 0
        while begin < len(counts):
            # a frame takes documents until it has FRAME_IDS ids; the last one may overshoot
            end = min(int(np.searchsorted(ends, base + FRAME_IDS - self.size, "left")) + 1, len(counts))
            frames[begin:end] = len(self.seek)
            self.held.append(ids[base : ends[end - 1]])
            self.size += int(ends[end - 1] - base)
            begin, base = end, int(ends[end - 1])
            if self.size >= FRAME_IDS:
                self.flush()
        self.docs.append(doc_ids)
        self.lengths.append(counts)
        self.frames.append(frames)

    def flush(self) -> None:
        if self.held:
            raw = np.concatenate(self.held).astype(self.dtype).tobytes()
            packed = self.pack.compress(raw)
            self.stream.write(packed)
            self.seek.append((len(packed), len(raw), xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> tuple[int, int]:
        self.flush()
        none = np.zeros(0, np.int64)
        docs, lengths = (np.concatenate([none, *x]).astype(np.int64) for x in (self.docs, self.lengths))
        index = dump(np.array([self.dtype.itemsize]), docs, lengths, np.concatenate([none, *self.frames]).astype(np.uint32))
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEK_FOOTER)
        self.stream.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        return len(docs), int(lengths.sum())


class ShardReader:
    """Reads documents of one shard; only frames that hold them are read and decompressed."""

    def __init__(self, path: str):
        system, where = file_system(path)
        self.file = system.open_input_file(where)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_FOOTER or flags != 0x80:
            raise ValueError(f"{path}: no seek table")
        at = size - 9 - 12 * n
        seek = np.frombuffer(self.file.read_at(12 * n, at), "<u4").reshape(n, 3).astype(np.int64)
        if struct.unpack("<II", self.file.read_at(8, at - 8)) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError(f"{path}: damaged seek table")
        self.sizes, self.raw, self.sums = seek.T
        self.begins = np.cumsum(self.sizes) - self.sizes
        index_at = int(self.sizes.sum())
        magic, length = struct.unpack("<II", self.file.read_at(8, index_at))
        if magic != INDEX_MAGIC:
            raise ValueError(f"{path}: no document index")
        width, self.docs, self.lengths, self.frames = load(self.file.read_at(length, index_at + 8))
        self.dtype = np.dtype(f"<u{int(width[0])}")
        self.starts = np.cumsum(self.lengths) - self.lengths

    def frame(self, k: int) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(self.sizes[k]), int(self.begins[k])), max_output_size=int(self.raw[k]))
        if len(raw) != self.raw[k] or xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, self.dtype)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        """(position of the document, its ids), in the shard's order."""
        for k in range(len(self.sizes)):
            ids, at = self.frame(k), 0
            first, last = np.searchsorted(self.frames, [k, k + 1])
            for d in range(first, last):
                yield d, ids[at : at + self.lengths[d]]
                at += self.lengths[d]

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document with this id."""
        out = []
        for d in np.flatnonzero(self.docs == doc_id):
            first = np.searchsorted(self.frames, self.frames[d])
            at = int(self.lengths[first:d].sum())
            out.append(self.frame(int(self.frames[d]))[at : at + self.lengths[d]])
        return out


def write_token_files(docs: DataFrame, folder: str | None = None, *, vocabulary: str | None = None, end: int = 2, width: int = 2, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Encodes whole texts and writes them as shards in ascending order of doc_id; one row per shard. Without a folder
    of one's own the shards are working files that end with the program.

    Null and empty texts are their end id only, long ones are encoded whole; null ids come first; rows with one id,
    repeats too, follow each other in the order of their texts, and may go on in the next shard; no rows give no
    documents. Other columns are ignored, whatever their names. width: bytes of an id; an id that does not fit is an
    error. A shard's name has the number of its task's attempt; the returned rows name those that count, and what
    repeated tasks have left besides is deleted."""
    spark = docs.sparkSession
    folder, vocabulary, run = folder or shared_folder(spark) + "/ids", vocabulary or default_vocabulary(), uuid.uuid4().hex[:12]

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encoder = TaskContext.get(), WordEncoder.of_worker(vocabulary)
        system, where = file_system(folder)
        system.create_dir(where, recursive=True)
        name = f"shard-{task.partitionId():06d}-{run}-{task.taskAttemptId()}.ids.zst"
        with system.open_output_stream(f"{where}/{name}", compression=None) as stream:
            writer = ShardWriter(stream, width)
            for table in rows_in(batches, "text"):
                ids, counts = with_end(*encoder.encode(table["text"].combine_chunks()), end)
                if len(ids) and int(ids.max()) >> 8 * width:
                    raise ValueError(f"token id {int(ids.max())} does not fit {width} bytes")
                writer.add(ids_of(table["doc_id"].combine_chunks()), ids, counts)
            n, tokens = writer.close()
        yield row_batch(pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]), shard=[task.partitionId()], path=[f"{folder}/{name}"], n_docs=[n], n_tokens=[tokens])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    # the texts' beginnings part the rows of one id, or of none, without whole texts among the sampled bounds
    first = F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32).asc_nulls_first()
    ranged = rows.repartitionByRange(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), *first)
    made = written(ranged.sortWithinPartitions(first[0], F.col("text").asc_nulls_first()).mapInArrow(write, WRITTEN), "shards")
    _sweep(folder, run, made)
    return made


def _sweep(folder: str, run: str, made: DataFrame) -> None:
    """Deletes the run's files that are no shard."""
    from pyarrow import fs

    system, where = file_system(folder)
    names = {r.path.rsplit("/", 1)[1] for r in made.select("path").toLocalIterator()}
    for info in system.get_file_info(fs.FileSelector(where, allow_not_found=True)):
        if f"-{run}-" in info.base_name and info.base_name not in names:
            system.delete_file(info.path)


def read_token_files(shards: DataFrame) -> DataFrame:
    """Reads shards back: per document its place among all ids, its number of ids and their CRC-32 as 32-bit
    integers. `shards` is what write_token_files returned; only its row per shard comes to the driver."""
    spark = shards.sparkSession
    rows, start, n = [], 0, 0
    for r in sorted(shards.collect(), key=lambda r: r.shard):
        rows.append((r.shard, r.path, start))
        start += r.n_tokens
        n += 1

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "n_tokens", "ids_crc32")), ("shard", pa.int32()), ("frame", pa.int32())])
        for batch in batches:
            for shard, path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = ShardReader(path)
                sums = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in reader), np.int64)
                if len(sums) != len(reader.docs):
                    raise ValueError(f"{path}: {len(sums)} documents of {len(reader.docs)}")
                yield row_batch(schema, doc_id=id_array(reader.docs), start=reader.starts + base, n_tokens=reader.lengths, ids_crc32=sums, shard=np.full(len(sums), shard, np.int32), frame=reader.frames.astype(np.int32))

    listed = spark.createDataFrame(rows, "shard int, path string, base long").repartition(max(1, n), "shard")
    return listed.mapInArrow(read, READ)
