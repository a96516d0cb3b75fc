"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Pieces are dealt into blocks of a bounded number of pieces by a hash. For each block several islands evolve packings,
which begin as best fit in random orders: crossover injects whole well-filled bins of one parent into another, bins
that then hold a document twice are dissolved, and the displaced documents go back by best fit, longest first. After
each epoch an island sends its elite to the next island of its block. An island stops where it reaches the lower bound
(all tokens over the capacity, rounded up), which no packing can beat; one that has not reached it after an epoch also
takes in best fit by falling length. The best packing of each block is kept, but for its badly filled bins: their
documents are dealt again over fewer blocks, level by level, until one block is left or a level saves no sequence.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeveil.llm.common import dump, id_array, ids_of, load, pieces_for, row_batch, rows_in, written
from gradeveil.llm.encoding import WordEncoder, default_vocabulary, with_end

COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
STATE = "block long, island int, lengths binary, packings binary"
PLACED = f"{PIECES}, key long, block long, bin int, offset long, fill long"


class Packer:
    """Evolves packings of one block. A packing gives each document (longest first) its bin."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity = lengths, capacity
        self.random = np.random.default_rng(seed)
        self.bound = -(-int(lengths.sum()) // capacity)

    def best_fit(self, items: Iterable[int], into: np.ndarray, fills: dict[int, int]) -> None:
        """Puts items, one after another, into the fullest bin that has room, else into a new one."""
        lengths, capacity = self.lengths, self.capacity
        room = sorted((capacity - f, b) for b, f in fills.items())
        free = max(fills, default=-1) + 1
        for i in items:
            size = int(lengths[i])
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, b = room.pop(at)
            else:
                left, b, free = capacity, free, free + 1
            into[i] = b
            if left > size:
                insort(room, (left - size, b))

    def first(self) -> np.ndarray:
        """Best fit in a random order."""
        return self._packed(self.random.permutation(len(self.lengths)))

    def falling(self) -> np.ndarray:
        """Best fit by falling length."""
        return self._packed(np.arange(len(self.lengths)))

    def _packed(self, order: np.ndarray) -> np.ndarray:
        out = np.full(len(self.lengths), -1, np.int32)
        self.best_fit(order.tolist(), out, {})
        return out

    def fills(self, packing: np.ndarray) -> np.ndarray:
        return np.bincount(packing, self.lengths).astype(np.int64)

    def fitness(self, packing: np.ndarray) -> tuple[int, float]:
        """Fewer bins first, then bins as unevenly filled as can be."""
        fills = self.fills(packing)
        fills = fills[fills > 0]
        return -len(fills), float(np.square(fills / self.capacity).sum())

    def cross(self, mother: np.ndarray, father: np.ndarray) -> np.ndarray:
        """Injects well-filled bins of father into mother."""
        fills = self.fills(father)
        good = fills >= np.median(fills[fills > 0])
        good &= self.random.random(len(good)) < 0.5
        injected = good[father]
        hit = np.zeros(int(mother.max()) + 1, bool)
        hit[mother[injected]] = True
        child = mother.copy()
        child[injected] = father[injected] + len(hit)
        return self._repair(child, ~injected & hit[mother])

    def mutate(self, packing: np.ndarray) -> np.ndarray:
        """Dissolves the worst-filled bins and some others."""
        fills = self.fills(packing)
        full = np.flatnonzero(fills)
        worst = full[np.argsort(fills[full])[: max(2, len(full) // 50)]]
        some = self.random.choice(full, max(1, len(full) // 50))
        gone = np.zeros(len(fills), bool)
        gone[worst] = gone[some] = True
        return self._repair(packing.copy(), gone[packing])

    def _repair(self, packing: np.ndarray, displaced: np.ndarray) -> np.ndarray:
        rest = ~displaced
        fills = np.bincount(packing[rest], self.lengths[rest]).astype(np.int64) if rest.any() else np.zeros(0, np.int64)
        self.best_fit(np.flatnonzero(displaced).tolist(), packing, {int(b): int(fills[b]) for b in np.flatnonzero(fills)})
        return np.unique(packing, return_inverse=True)[1].astype(np.int32)

    def evolve(self, population: list[np.ndarray], size: int, generations: int) -> list[np.ndarray]:
        """The population, best first, after some generations. Stops early once a packing is provably best."""
        if not population:
            population = [self.first() for _ in range(size)]
        ranked = sorted(((self.fitness(p), k, p) for k, p in enumerate(population)), reverse=True)[:size]
        tag = len(population)
        for _ in range(generations):
            if -ranked[0][0][0] <= self.bound:
                break
            a, b = (min(self.random.integers(0, len(ranked), 2)) for _ in range(2))
            child = self.cross(ranked[a][2], ranked[b][2]) if a != b else self.mutate(ranked[a][2])
            tag += 1
            ranked = sorted([*ranked, (self.fitness(child), tag, child)], reverse=True)[:size]
        return [p for _, _, p in ranked]


def _packings(blob: bytes | None) -> list[np.ndarray]:
    return load(blob) if blob else []


def pack_pieces(pieces: DataFrame, *, capacity: int = 4096, block_pieces: int = 4096, islands: int = 2, epochs: int = 3, generations: int = 40, population: int = 6, elite: int = 2, refill: float = 0.995) -> DataFrame:
    """Packs rows of doc_id, piece, start, length (1 to capacity) and ids_crc32 into sequences of at most
    `capacity`: adds sequence_id and offset, both long. Bins filled below `refill` go on to the next level, as long as
    fewer could hold their pieces and the last level saved some. Rows may repeat and ids may be null: pieces are dealt
    by their place in the table, so packings depend on it."""
    # written, so that a piece keeps its key
    left, done, level, before = written(pieces.select(*COLUMNS).withColumn("key", F.monotonically_increasing_id()), "pieces"), [], 0, None
    while True:
        blocks = pieces_for(left.count(), block_pieces)
        dealt = left.withColumn("block", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(blocks)).cast("long"))
        placed = written(_pack_level(dealt, blocks, capacity, islands, epochs, generations, population, elite, level), f"level{level}")
        weak = F.col("fill") < refill * capacity
        opens = F.col("offset") == 0
        bins, weak_bins, weak_tokens = placed.agg(F.count_if(opens), F.count_if(opens & weak), F.coalesce(F.sum(F.when(weak, F.col("length"))), F.lit(0))).first()
        last = blocks == 1 or weak_bins <= pieces_for(weak_tokens, capacity) or (before is not None and bins >= before)
        stay = placed if last else placed.where(~weak)
        done.append(stay.withColumn("sequence_id", F.lit(level << 56) + F.col("block") * F.lit(1 << 20) + F.col("bin")))
        if last:
            break
        left, level, before = placed.where(weak).select(*COLUMNS, "key"), level + 1, weak_bins
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*COLUMNS, "sequence_id", "offset")


def _pack_level(dealt: DataFrame, blocks: int, capacity: int, islands: int, epochs: int, generations: int, population: int, elite: int, level: int) -> DataFrame:
    order = [("length", "descending"), ("key", "ascending")]
    # blocks are little data but much work: no coalescing
    tasks = min(blocks * islands, 4 * int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()), ("packings", pa.binary())])

    def begin(table: pa.Table) -> pa.Table:
        lengths = np.sort(np.asarray(table["length"].combine_chunks()))[::-1]
        block = table["block"][0].as_py()
        return pa.Table.from_batches([row_batch(schema, block=[block] * islands, island=list(range(islands)), lengths=[dump(lengths)] * islands, packings=[None] * islands)])

    def epoch(number: int):
        def run(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            block, island = rows[0]["block"], rows[0]["island"]
            (lengths,) = next(load(r["lengths"]) for r in rows if r["lengths"])
            packer = Packer(lengths, capacity, zlib.crc32(f"{level} {number} {block} {island}".encode()))
            # own packings first, then the migrants
            kept = [p for r in sorted(rows, key=lambda r: r["lengths"] is None) for p in _packings(r["packings"])]
            if kept and -max(map(packer.fitness, kept))[0] > packer.bound:
                kept.append(packer.falling())
            best = packer.evolve(kept, population, generations)
            last = number + 1 == epochs
            sent = [(island, dump(lengths), dump(*best[: 1 if last else population]))]
            if not last and islands > 1:
                sent.append(((island + 1) % islands, None, dump(*best[:elite])))
            return pa.Table.from_batches([row_batch(schema, block=[block] * len(sent), island=[s[0] for s in sent], lengths=[s[1] for s in sent], packings=[s[2] for s in sent])])

        return run

    state = dealt.select("block", "length").groupBy("block").applyInArrow(begin, STATE)
    for number in range(epochs):
        state = state.repartition(tasks, "block", "island").groupBy("block", "island").applyInArrow(epoch(number), STATE)

    def place(items: pa.Table, states: pa.Table) -> pa.Table:
        items = items.sort_by(order)
        lengths = np.asarray(items["length"].combine_chunks())
        packer = Packer(lengths, capacity, 0)
        best = max((_packings(b)[0] for b in states["packings"].to_pylist()), key=packer.fitness)
        by = np.argsort(best, kind="stable")
        bins, sizes = best[by], lengths[by]
        ends = np.cumsum(sizes)
        first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
        runs = np.diff(np.append(first, len(bins)))
        offsets = ends - sizes - np.repeat((ends - sizes)[first], runs)
        items = items.take(pa.array(by)).select([*COLUMNS, "key", "block"])
        return items.append_column("bin", pa.array(bins.astype(np.int32))).append_column("offset", pa.array(offsets)).append_column("fill", pa.array(np.repeat(np.add.reduceat(sizes, first), runs)))

    return dealt.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(place, PLACED)


def cut_pieces(docs: DataFrame, *, vocabulary: str | None = None, end: int = 1, capacity: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The token ids of every whole text, cut into pieces of at most `capacity` ids: doc_id, piece, start, length
    and the CRC-32 of the ids as 32-bit integers. A null text is empty: one piece with the end id."""
    vocabulary = vocabulary or default_vocabulary()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32"))])
        encoder = WordEncoder.of_worker(vocabulary)
        for table in rows_in(batches, "text"):
            ids, counts = with_end(*encoder.encode(table["text"].combine_chunks()), end)
            pieces = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(counts[doc] - start, capacity)
            ends, raw = np.cumsum(length), memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
            yield row_batch(schema, doc_id=id_array(ids_of(table["doc_id"].combine_chunks())[doc]), piece=piece.astype(np.int32), start=start, length=length, ids_crc32=sums)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(encode, PIECES)


def pack_documents(docs: DataFrame, *, vocabulary: str | None = None, end: int = 1, capacity: int = 4096, doc_id: str = "doc_id", text: str = "text", **evolution) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` token ids; one row per piece.

    Only documents longer than a sequence are cut, long texts whole. Null or empty texts take one id, null ids stay
    null, rows that repeat are packed each on their own, other columns are ignored, whatever their names, no rows give
    no rows. Which pieces share a sequence depends on the order of the rows. evolution: parameters of pack_pieces."""
    return pack_pieces(cut_pieces(docs, vocabulary=vocabulary, end=end, capacity=capacity, doc_id=doc_id, text=text), capacity=capacity, **evolution)
