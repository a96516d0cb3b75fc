"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are one class. Several independent trees branch the classes: at
each node two minwise functions are chosen by the node's own hash, and a class descends along the values that it
takes under them; two sets of similarity 0.8 stay together in one tree with a probability of 0.94 at any depth, so
that four trees lose a pair in 60 000, and trees and sketches together one in 48 000 at most. Nodes of one class end, small nodes are compared exhaustively by their
sketches, larger ones branch on. What passes the sketches is confirmed on full sets.

To stay linear in groups of thousands of near copies, every node first proposes only a maximum spanning forest of
its sketch similarities (large nodes by random parts). The confirmed links give preliminary components, and the
exhaustive comparison then only has to look at pairs that are in different components. Nodes that are still large
on the last level compare the classes outside their largest component with all others on full sets, in tiles: a part
of the node against a part of those classes, so that a task holds two parts of TILE sets each, however large the node.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeveil.llm.common import hashed, id_array, ids_of, mix, rolling, row_batch, rows_in, words_of, written
from gradeveil.llm.components import connected_components

FUNCTIONS = 64
#: Bytes of text that are turned into sets at a time.
PART_BYTES = 2 << 20
LEVELS = 4
#: Functions that a level may choose from; no level chooses another's.
POOL = FUNCTIONS // LEVELS
#: Classes in a node that is compared exhaustively, and in a part of a larger node.
SMALL = 128
#: Classes on either side of a tile of a large node.
TILE = 1024
#: Pairs of a small node that are confirmed one by one; beyond, its members are compared in one task.
MANY_PAIRS = 64
#: Sketches of pairs at the threshold 0.8 agree by this less at most, in 36 of 64 places, but for 1 pair in 236 000.
SLACK = 0.25

SIGNATURES = "doc_id long, text_hash long, n long, h1 long, h2 long, sketch binary"
MEMBER = "node long, k long, sketch binary"
FOUND = "a long, b long, node long, sketch binary"
MULTIPLIERS = (mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)).astype(np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as ascending hashes, one text after another, and their numbers. A text
    of fewer words is one shingle; one without words has none."""
    codes, words, counts = words_of(texts, lower=True)
    h = hashed(words, len(words))[codes] if len(codes) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    grams = rolling(h, size)
    inside = row[: len(grams)] == row[size - 1 :] if len(grams) else np.zeros(0, bool)
    shingles, rows = [grams[inside]], [row[: len(grams)][inside]]
    starts = np.cumsum(counts) - counts
    for n in range(1, size):  # whole texts of n words
        short = np.flatnonzero(counts == n)
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for j in range(n):
                whole = whole * np.uint64(0x9E3779B97F4A7C15) + h[starts[short] + j]
            shingles.append(mix(whole + np.uint64(n)))
            rows.append(short)
    g, r = np.concatenate(shingles), np.concatenate(rows)
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    new = np.append(True, (g[1:] != g[:-1]) | (r[1:] != r[:-1]))[: len(g)]
    return g[new], np.bincount(r[new], minlength=len(counts))


def _set_keys(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 for empty ones."""
    out = []
    full = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[full]
    for seed in (0x2545F4914F6CDD1D, 0x632BE59BD9B4E019):
        h = np.zeros(len(sizes), np.uint64)
        if full.any():
            h[full] = np.add.reduceat(mix(shingles ^ np.uint64(seed)), starts)
        out.append(h.view(np.int64))
    return out[0], out[1]


def _sketches(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """16 bits of the shingle that is least under each function."""
    out = np.zeros((len(sizes), FUNCTIONS), np.uint16)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for j, m in enumerate(MULTIPLIERS):
            out[full, j] = (mix(np.minimum.reduceat(shingles * m, starts)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))


def signatures(docs: DataFrame, shingle: int, doc_id: str, text: str) -> DataFrame:
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_hash", "n", "h1", "h2")] + [("sketch", pa.binary())])

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rows_in(batches, "text", PART_BYTES):
            shingles, sizes = shingle_sets(table["text"].combine_chunks(), shingle)
            h1, h2 = _set_keys(shingles, sizes)
            sketches = [s.tobytes() for s in _sketches(shingles, sizes)]
            yield row_batch(schema, doc_id=id_array(ids_of(table["doc_id"].combine_chunks())), text_hash=table["text_hash"].combine_chunks(), n=sizes, h1=h1, h2=h2, sketch=sketches)

    return _texts(docs, doc_id, text).mapInArrow(sign, SIGNATURES)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), FUNCTIONS)


def _branch(level: int, trees: int):
    """Each class goes to two children, chosen by the node's hash; on level 0 it enters every tree."""
    schema = pa.schema([("node", pa.int64()), ("k", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k, sketch = batch.column("k"), batch.column("sketch")
            values = _matrix(sketch)
            row = np.arange(len(values))
            if level == 0:
                starts = [(np.full(len(row), t + 1, np.uint64), np.full(len(row), 2 * t % POOL), np.full(len(row), (2 * t + 1) % POOL)) for t in range(trees)]
            else:
                node = np.asarray(batch.column("node")).view(np.uint64)
                h = mix(node ^ np.uint64(0xC2B2AE3D27D4EB4F))
                first = (h % np.uint64(POOL)).astype(np.int64)
                other = (first + 1 + ((h >> np.uint64(32)) % np.uint64(POOL - 1)).astype(np.int64)) % POOL
                starts = [(node, first, other)]
            for node, *chosen in starts:
                for j in chosen:
                    at = level * POOL + j
                    child = mix(mix(node) + at.astype(np.uint64) * np.uint64(0x1000003) + values[row, at].astype(np.uint64) * np.uint64(0x100000001B3))
                    yield row_batch(schema, node=child.view(np.int64), k=k, sketch=sketch)

    return run


def _groups(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal values in the columns `by`, of a sorted stream."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(c)) for c in by]
        change = np.zeros(batch.num_rows - 1, bool)
        for x in keys:
            change |= x[1:] != x[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(x[begin] for x in keys)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shares of equal functions, for all rows of a against all of b."""
    out = np.empty((len(a), len(b)), np.float32)
    for k in range(0, len(a), 64):
        out[k : k + 64] = (a[k : k + 64, None, :] == b[None, :, :]).mean(2, dtype=np.float32)
    return out


def _spanning(similar: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A maximum spanning forest of the pairs with at least this similarity (Prim)."""
    n = len(similar)
    best, parent, left, out = np.full(n, -1.0, np.float32), np.zeros(n, np.int64), np.ones(n, bool), []
    for _ in range(n):
        v = int(np.argmax(np.where(left, best, -2.0)))
        left[v] = False
        if best[v] >= least:
            out.append((int(parent[v]), v))
        closer = left & (similar[v] > best)
        best[closer], parent[closer] = similar[v][closer], v
    return out


def _propose(least: float):
    """Spanning pairs of each part of a node, and the members of small nodes that are like some other."""
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "node")] + [("sketch", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, node, sketch = [], [], [], []
        for group in _groups(batches, ["node", "part"]):
            if group.num_rows > 1:
                k, small = np.asarray(group.column("k")), group.column("n")[0].as_py() <= SMALL
                values = _matrix(group.column("sketch"))
                similar = _similar(values, values)
                pairs = _spanning(similar, least)
                for x, y in pairs:
                    a.append(min(k[x], k[y]))
                    b.append(max(k[x], k[y]))
                    node.append(None)
                    sketch.append(None)
                if small and pairs:
                    np.fill_diagonal(similar, 0)
                    for x in np.flatnonzero(similar.max(1) >= least):
                        a.append(k[x])
                        b.append(None)
                        node.append(group.column("node")[0].as_py())
                        sketch.append(values[x].tobytes())
            if len(a) > 20_000:
                yield row_batch(schema, a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()), node=pa.array(node, pa.int64()), sketch=sketch)
                a, b, node, sketch = [], [], [], []
        if a:
            yield row_batch(schema, a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()), node=pa.array(node, pa.int64()), sketch=sketch)

    return run


def _across(least: float):
    """The similar pairs of a small node that are in different components. Of a node with many of them the members, to
    be compared on full sets with the large nodes' ones."""
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "node")] + [("sketch", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["node"]):
            c = np.asarray(group.column("component"))
            if len(c) > 1 and (c != c[0]).any():
                k, values = np.asarray(group.column("k")), _matrix(group.column("sketch"))
                similar = _similar(values, values)
                open_ = np.triu((similar >= least) & (c[:, None] != c[None, :]))
                x, y = np.nonzero(open_)
                none = pa.nulls(len(x), pa.int64())
                if len(x) > MANY_PAIRS:
                    yield row_batch(schema, a=k, b=pa.nulls(len(k), pa.int64()), node=group.column("node"), sketch=group.column("sketch"))
                elif len(x):
                    yield row_batch(schema, a=np.minimum(k[x], k[y]), b=np.maximum(k[x], k[y]), node=none, sketch=pa.nulls(len(x), pa.binary()))

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)
            yes = [_linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in sets]
            yield row_batch(schema, a=batch.column("a"), b=batch.column("b")).filter(pa.array(yes, pa.bool_()))

    return run


def _across_large(percent: int):
    """Links between classes outside a large node's largest component and its other classes, tile by tile."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["node", "part", "tile"]):
            k, c = np.asarray(group.column("k")), np.asarray(group.column("component"))
            sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
            values = _matrix(group.column("sketch"))
            home, outside = (np.flatnonzero(np.asarray(group.column(x).to_pylist(), bool)) for x in ("home", "outside"))
            found: dict[tuple[int, int], tuple[int, int]] = {}
            joined = {int(x): int(x) for x in c}

            def root(x: int, joined: dict[int, int] = joined) -> int:
                while joined[x] != x:
                    joined[x] = joined[joined[x]]
                    x = joined[x]
                return x

            for x in outside:
                near = _similar(values[x : x + 1], values[home])[0]
                for y in home[np.argsort(-near, kind="stable")][: int((near >= percent / 100 - SLACK).sum())]:
                    p, q = root(int(c[x])), root(int(c[y]))
                    if p != q and _linked(sets[x], sets[y], percent):
                        joined[max(p, q)] = min(p, q)
                        found[int(min(k[x], k[y])), int(max(k[x], k[y]))] = (p, q)
            if found:
                yield row_batch(schema, a=[a for a, _ in found], b=[b for _, b in found])

    return run


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, trees: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns doc_id, n_shingles, component_id (the smallest id reachable over links), kept (doc_id is the
    component_id) and text_hash (xxhash64 of the text), one row for each row of docs.

    Words are lower-cased (A-Z); a document's set holds its distinct shingles of `shingle` words, or all its words
    as one if they are fewer; without words (null or empty text) it is empty and linked with nothing; long texts are
    read whole. Sets are linked if 100 * intersection >= percent * union. Rows that share an id are rows of their own, each kept if the id is its
    component's; rows with a null id are never kept unless alone: they link others, but give no component id, and
    a component without any id has component_id null. No rows give no rows. Other columns are ignored, whatever their
    names."""
    least = percent / 100 - SLACK
    signed = written(signatures(docs, shingle, doc_id, text), "signatures")
    key = F.xxhash64("h1", "h2").alias("k")
    classes = written(signed.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.min("sketch").alias("sketch")).select(key, "doc_id", "sketch"), "classes")

    found: list[DataFrame] = []
    rows = classes.select("k", "sketch")
    for level in range(LEVELS):
        branched = rows.mapInArrow(_branch(level, trees), MEMBER)
        # written, so that the join deals both sides anew and the adaptive planner can split a hot node
        sizes = written(branched.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"sizes{level}")
        members = branched.join(sizes, "node")
        part = F.pmod(F.xxhash64("k", "node"), F.ceil(F.col("n") / SMALL)).alias("part")
        members = written(members.select("node", "k", "sketch", "n", F.when(F.col("n") > SMALL, part).otherwise(F.lit(0)).alias("part")), f"members{level}")
        proposed = members.repartition(F.col("node"), F.col("part")).sortWithinPartitions("node", "part", "k").mapInArrow(_propose(least), FOUND)
        found.append(written(proposed, f"found{level}"))
        rows = members.where(F.col("n") > SMALL).select("node", "k", "sketch")
        if rows.isEmpty():
            break
    proposals = found[0]
    for f in found[1:]:
        proposals = proposals.unionByName(f)
    pairs = written(proposals.where("b is not null").select("a", "b").distinct(), "pairs")
    leaves = proposals.where("b is null").select("node", F.col("a").alias("k"), "sketch")

    wanted = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).unionByName(leaves.select("k")).unionByName(rows.select("k")).distinct()
    sets = written(_sets(docs, classes.join(wanted, "k"), shingle, doc_id, text), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("k").alias("a"), F.col("set").alias("set_a"))
        b = sets.select(F.col("k").alias("b"), F.col("set").alias("set_b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long")

    links = written(confirmed(pairs), "links")
    first = connected_components(links)

    def with_component(rows: DataFrame) -> DataFrame:
        return rows.join(first.withColumnRenamed("vertex", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))

    mixed = with_component(leaves).select("node", "k", "sketch", "component").repartition(F.col("node")).sortWithinPartitions("node", "k").mapInArrow(_across(least), FOUND)
    across = written(mixed, "across")
    more = written(confirmed(across.where("b is not null").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")), "more_links")
    large = with_component(rows.unionByName(across.where("b is null").select("node", F.col("a").alias("k"), "sketch")))
    by_component = large.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    nodes = by_component.groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"))
    # written, as the node sizes are
    outsiders = F.col("n") - F.col("most.n")
    mixed = written(nodes.where(outsiders > 0).select("node", F.ceil(F.col("n") / TILE).alias("parts"), F.ceil(outsiders / TILE).alias("tiles"), F.col("most.component").alias("most")), "mixed")
    dealt = large.join(mixed, "node").withColumn("outside", F.col("component") != F.col("most")).withColumn("own", F.pmod(F.xxhash64("k", "node"), F.col("parts"))).withColumn("in", F.pmod(F.xxhash64("node", "k"), F.col("tiles")))
    # every class is at home in its part, against all tiles; those outside are in their tile, against all parts
    places = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    here = dealt.withColumn("part", F.col("own")).withColumn("tile", F.explode(places(F.col("tiles")))).withColumn("home", F.lit(True)).withColumn("outside", F.col("outside") & (F.col("tile") == F.col("in")))
    away = dealt.where("outside").withColumn("tile", F.col("in")).withColumn("part", F.explode(places(F.col("parts")))).where("part <> own").withColumn("home", F.lit(False))
    columns = ("node", "part", "tile", "k", "sketch", "component", "home", "outside")
    spread = here.select(*columns).unionByName(away.select(*columns)).join(sets, "k")
    rest = written(spread.repartition(F.col("node"), F.col("part"), F.col("tile")).sortWithinPartitions("node", "part", "tile", "k").mapInArrow(_across_large(percent), "a long, b long"), "rest_links")

    last = connected_components(links.unionByName(more).unionByName(rest))
    joined = classes.join(last.withColumnRenamed("vertex", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    names = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = joined.join(names, "component").select("k", "component_id")
    # the adaptive planner splits the class that a third of all documents may be
    out = signed.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, key).alias("k")).join(named, "k", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """docs, all columns kept, with one row of each group of near duplicates: that with the smallest id. Of rows with
    one id and one text, one stays. parameters: of near_duplicates."""
    kept = near_duplicates(docs, doc_id=doc_id, text=text, **parameters).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    rows = docs.withColumn("__h", F.xxhash64(F.col(f"`{text}`").cast("string"))).withColumn("__i", F.col(f"`{doc_id}`").cast("long"))
    one = rows.join(kept, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left_semi")
    return one.dropDuplicates(["__i", "__h"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def _sets(docs: DataFrame, classes: DataFrame, shingle: int, doc_id: str, text: str) -> DataFrame:
    """The full sets of some classes, from their documents' texts: k and set (ascending 64-bit integers)."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("set", pa.binary())])

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rows_in(batches, "text", PART_BYTES):
            shingles, sizes = shingle_sets(table["text"].combine_chunks(), shingle)
            h1, h2 = _set_keys(shingles, sizes)
            ends = np.cumsum(sizes)
            for k in range(0, len(sizes), 1000):
                part = slice(k, k + 1000)
                yield row_batch(schema, h1=h1[part], h2=h2[part], set=[shingles[e - n : e].tobytes() for e, n in zip(ends[part], sizes[part], strict=True)])

    texts = _texts(docs, doc_id, text).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(classes.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")).distinct(), "doc_id").select("text")
    sets = texts.mapInArrow(collect, "h1 long, h2 long, set binary").withColumn("k", F.xxhash64("h1", "h2"))
    return sets.join(classes.select("k"), "k", "left_semi").groupBy("k").agg(F.min("set").alias("set"))
