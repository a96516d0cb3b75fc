"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of the target text (labelled good and not toxic) and one of all raw
text, give each document the log of its importance weight, log p_target(text) / p_raw(text); Gumbel noise from the
document's own hash is added, and the top k are the sample. N-grams are words and pairs of word shapes (with a mark
for a repeated word); each counts once in a text.

Raw counts come from all documents and are scaled to the size of the target, so both models have the same smoothing
and the same total. A document's own counts are left out of both models when it is scored: otherwise its rare words
would say that it is raw text, and whether it happens to be labelled would decide. Log ratios are shrunk towards 0 by
z**2 / (z**2 + shrink**2), where z is the score of a bucket's target count against what its labelled documents lead to
expect: ratios that the labels bear out stay, those of passages without labels and of chance fade.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeveil.llm.common import dump, hashed, id_array, ids_of, load, mix, row_batch, rows_in, tree_sum, words_of, written

BITS = 20
BUCKETS = 1 << BITS
#: Rows in which a task sends its counts.
SLICES = 64
SCORED = "doc_id long, n_words long, log_weight double, noise double"
ODD = np.uint64(0x9E3779B97F4A7C15)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of the distinct n-grams of each text, the text of each, the number of words of each text and a hash
    of its words."""
    codes, words, counts = words_of(texts)
    n = len(words)
    raw = pa.array(words, pa.string())
    core = hashed(pc.utf8_lower(pc.replace_substring_regex(raw, r"^[^\pL\pN]+|[^\pL\pN]+$", "")).to_pylist(), n)
    shape = raw
    for pattern, mark in ((r"\p{Lu}+", "X"), (r"\p{Ll}+", "x"), (r"\p{Lo}+", "o"), (r"[0-9]+", "9"), (r"^(.{6}).*$", r"\1")):
        shape = pc.replace_substring_regex(shape, pattern, mark)
    shape = hashed(shape.to_pylist(), n, 1)
    row = np.repeat(np.arange(len(counts)), counts)
    w, s = (core[codes], shape[codes]) if n else (np.zeros(0, np.uint64),) * 2
    pair = row[1:] == row[:-1]
    same = (w[1:] == w[:-1]).astype(np.uint64)
    all_ = [mix(w), mix(s[:-1] * ODD + s[1:] + same * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7))[pair]]
    whole = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        place = np.arange(len(w), dtype=np.uint64) * ODD
        starts = (np.cumsum(counts) - counts)[full]
        whole[full] = np.add.reduceat(mix(w + place - np.repeat(place[starts], counts[full])), starts)
    # each n-gram counts once in a text, or one text that repeats a word a thousand times would speak for all
    feature, of = np.concatenate(all_), np.concatenate([row, row[1:][pair]])
    _, once = np.unique(feature + (of.astype(np.uint64) + np.uint64(1)) * ODD, return_index=True)
    return (feature[once] >> np.uint64(64 - BITS)).astype(np.int64), of[once], counts, whole


def log_ratios(target: np.ndarray, labelled: np.ndarray, raw: np.ndarray, scale: float, share: float, smoothing: float, shrink: float) -> np.ndarray:
    """log p_target / p_raw of buckets with these counts. scale: of raw counts to the target's size; share: of target
    documents among the labelled ones."""
    ratio = np.log((target + smoothing) / (raw * scale + smoothing))
    z2 = np.square(target - labelled * share) / (labelled * share * (1 - share) + 1e-9)
    return ratio * (z2 / (z2 + shrink * shrink))


def _counted(texts: DataFrame, labelled) -> np.ndarray:
    """N-gram counts of the target documents, of the labelled ones and of all: each task's are one row a slice, added
    up by a tree."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = np.zeros((3, BUCKETS), np.int64)
        for table in rows_in(batches, "text"):
            buckets, row, _, _ = features(table["text"].combine_chunks())
            ids = ids_of(table["doc_id"].combine_chunks())
            for total, members in zip(sums, labelled.value, strict=False):
                total += np.bincount(buckets[np.isin(ids, members)[row]], minlength=BUCKETS)
            sums[2] += np.bincount(buckets, minlength=BUCKETS)
        if sums[2].any():
            part = TaskContext.get().partitionId()
            schema = pa.schema([("slice", pa.int32()), ("part", pa.int64()), ("counts", pa.binary())])
            yield row_batch(schema, slice=range(SLICES), part=[part] * SLICES, counts=[dump(*x) for x in np.moveaxis(sums.reshape(3, SLICES, -1), 1, 0)])

    out = np.zeros((3, SLICES, BUCKETS // SLICES), np.float32)
    for r in tree_sum(texts.mapInArrow(count, "slice int, part long, counts binary")).collect():
        out[:, r.slice] = load(r.counts)
    return out.reshape(3, BUCKETS)


def _threshold(scored: DataFrame, k: int) -> tuple[float, int] | None:
    """The k-th greatest (key, doc_id), found by histograms that narrow; None if k is 0."""
    if k <= 0:
        return None
    low, high, n = scored.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
    if n <= k:
        return (float("-inf"), 0)
    inside, above = scored, 0
    while True:
        n = inside.count()
        if n <= 20_000 or low >= high:
            last = inside.orderBy(F.desc("key"), F.asc("doc_id")).limit(k - above).agg(F.min(F.struct("key", (-F.col("doc_id")).alias("d")))).first()[0]
            return last["key"], -last["d"]
        width = (high - low) / 4096
        slot = F.least(F.floor((F.col("key") - low) / width), F.lit(4095)).cast("int")
        seen = above
        for r in inside.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("slot")).collect():
            if seen + r.n >= k:
                above, low, high = seen, r.low, r.high
                break
            seen += r.n
        inside = scored.where(F.col("key").between(low, high))


def _labelled(labels: DataFrame, max_labelled: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending ids of the target documents and of all labelled ones. Of more than max_labelled, those below a hash
    that lets about as many through."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    is_good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    each = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(is_good).alias("good"))
    n = each.count()
    if n > max_labelled:
        each = each.where(F.xxhash64("doc_id") < F.lit(round((max_labelled / n * 2 - 1) * 2**63)))
    rows = each.collect()
    return tuple(np.sort(np.array([r.doc_id for r in rows if r.good or not only], np.int64)) for only in (True, False))


def resample(docs: DataFrame, labels: DataFrame, *, share: float | None = None, smoothing: float = 2.0, shrink: float = 5.0, temperature: float = 0.5, max_labelled: int = 200_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns doc_id, n_words, log_weight, key (log_weight / temperature plus Gumbel noise) and kept, one row for
    each row of docs: kept are the k documents with the greatest keys, ties by smaller id. k is `share` of all
    documents, by default the share of target documents among the labelled ones.

    Target documents are those labelled quality 1 and toxic 0; a document with several labels must have them in all.

    Labels with nulls are not used, and about max_labelled of them at most; without labels every weight is 0 (log)
    and all documents are kept. Null or empty texts weigh 0, long ones are read whole. A null id stays null and comes
    last among ties. Rows that repeat an id and a text have equal keys; where k falls between them, the last id's
    rows stay all. No rows give no rows. Other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    good, all_ = _labelled(labels, max_labelled)
    labelled = spark.sparkContext.broadcast((good, all_))
    part = len(good) / max(len(all_), 1)
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    # three arrays of 2**BITS numbers, however large the corpus is
    models = spark.sparkContext.broadcast(_counted(texts, labelled))
    scale = float(models.value[0].sum(dtype=np.float64) / max(models.value[2].sum(dtype=np.float64), 1))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_weight", pa.float64()), ("noise", pa.float64())])
        for table in rows_in(batches, "text"):
            buckets, row, counts, whole = features(table["text"].combine_chunks())
            ids = ids_of(table["doc_id"].combine_chunks())
            own = [np.isin(ids, members).astype(np.float64)[row] for members in labelled.value] + [1.0]
            others = [np.maximum(m[buckets] - o, 0.0) for m, o in zip(models.value, own, strict=True)]
            ratio = log_ratios(*others, scale, part, smoothing, shrink) if len(labelled.value[1]) else np.zeros(len(buckets))
            sums = np.bincount(row, ratio, minlength=len(counts))
            uniform = ((mix(mix(ids.view(np.uint64)) + whole) >> np.uint64(12)).astype(np.float64) + 0.5) / 2**52
            yield row_batch(schema, doc_id=id_array(ids), n_words=counts, log_weight=sums, noise=-np.log(-np.log(uniform)))

    keyed = texts.mapInArrow(score, SCORED).withColumn("key", F.col("log_weight") / temperature + F.col("noise")).drop("noise")
    scored = written(keyed, "scored")
    if share is None:
        share = part if len(all_) else 1.0
    at = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    last = _threshold(scored.select("key", at.alias("doc_id")), round(share * scored.count()))
    if last is None:
        return scored.withColumn("kept", F.lit(False))
    return scored.withColumn("kept", (F.col("key") > last[0]) | ((F.col("key") == last[0]) & (at <= last[1])))
