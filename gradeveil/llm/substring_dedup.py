"""Removal of long passages that an earlier document has, by matching statistics against suffix automata.

A window is `window` consecutive words of one document. Its anchor is its `gram`-word run with the least hash, so
two equal windows have equal anchors. First each block of documents tells the buckets which anchors it has, and
learns which of them another document has too. Only the segments around shared anchors go on: runs of windows with one
anchor, less than twice `window` words long, each distinct one once per block with the least id of its documents.
Where an anchor is very common, every window is a segment of its own, with itself as anchor, so that a hot anchor is
dealt over all buckets. In a bucket the distinct segments form reference shards of bounded size that hold whole
anchors. A suffix automaton is built for each shard, by ascending least id; the shard's segments are streamed through
it, and the matching statistics give each window the least id of a document that holds it. The answers go back once
per block, where the covered words are removed.

The automata are routed with the segments that need them, not broadcast to every task: all repeated passages of
a corpus grow with it, and a broadcast would not be bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeveil.llm.automaton import SuffixAutomaton
from gradeveil.llm.common import NULL_ID, buckets_of, by_bucket, cut, dump, hashed, id_array, load, mix, one_by_one, ragged, rolling, row_batch
from gradeveil.llm.word_blocks import WordBlock, word_blocks

MESSAGE = "bucket int, block long, sent binary"
ANSWER = "block long, bucket int, answer binary"
CLEANED = "doc_id long, n_words long, n_removed long, kept string"
NEVER = np.iinfo(np.int64).max
#: Words in the segments of one reference shard: what one automaton holds (7 MB; larger ones are slower, as they leave the
#: cache).
SHARD_WORDS = 20_000
#: Runs of windows with one anchor beyond which each window is its own anchor.
HOT_RUNS = 5_000


class Runs:
    """The windows of a block, as runs of consecutive windows of one document with the same anchor."""

    def __init__(self, block: WordBlock, window: int, gram: int):
        self.hashes = hashed(block.words, len(block.words))[block.codes] if len(block.codes) else np.zeros(0, np.uint64)
        grams = rolling(self.hashes, gram)
        wide = window - gram + 1
        n = len(grams) - wide + 1
        none = np.zeros(0, np.int64)
        self.start = self.size = self.doc = none
        self.anchor = np.zeros(0, np.uint64)
        if n <= 0:
            return
        best, at = grams[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, wide):  # leftmost least hash of the window's grams
            less = grams[j : j + n] < best
            best[less] = grams[j : j + n][less]
            at[less] = j
        at += np.arange(n)
        row = block.row
        inside = row[:n] == row[window - 1 :]
        begins = inside.copy()
        begins[1:] &= ~(inside[:-1] & (at[1:] == at[:-1]))
        self.start = np.flatnonzero(begins)
        if not len(self.start):
            return
        run_of = np.cumsum(begins) - 1
        self.size = np.bincount(run_of[inside], minlength=len(self.start))  # windows
        # least hashes are small numbers: mixed, so that they fill all buckets alike
        self.anchor, self.doc = mix(best[self.start]), row[self.start]

    def take(self, which: np.ndarray) -> None:
        self.start, self.size, self.doc, self.anchor = self.start[which], self.size[which], self.doc[which], self.anchor[which]

    def split(self, hot: np.ndarray, window: int) -> None:
        """Makes every window of the hot runs a run of its own, with its own hash as anchor."""
        start, size = self.start[hot], self.size[hot]
        windows = ragged(start, size)
        own = np.zeros(len(windows), np.uint64)
        for j in range(window):
            own = own * np.uint64(0x9E3779B97F4A7C15) + self.hashes[windows + j]
        doc = np.repeat(self.doc[hot], size)
        self.take(~hot)
        self.start, self.size = np.append(self.start, windows), np.append(self.size, np.ones(len(windows), np.int64))
        self.doc, self.anchor = np.append(self.doc, doc), np.append(self.anchor, mix(own))


def _anchors(block: WordBlock, runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors of a block, whether two of its ids have them, and their numbers of runs. Documents without id
    don't count."""
    known = block.ids[runs.doc] != NULL_ID
    anchor, ids = runs.anchor[known], block.ids[runs.doc[known]]
    order = np.argsort(anchor, kind="stable")
    anchor, ids = anchor[order], ids[order]
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)])
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint32)
    runs_of = np.diff(np.append(first, len(anchor))).astype(np.uint32)
    return anchor[first], np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first), runs_of


def _segments(block: WordBlock, runs: Runs, window: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct segments of a block by anchor: anchor, content hash, least id, number of windows and words
    (32-bit hashes, one after another); and the segment of each run."""
    size = runs.size + window - 1
    words = runs.hashes[ragged(runs.start, size)]
    power = np.cumprod(np.full(int(size.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
    begins = np.cumsum(size) - size
    content = np.add.reduceat(words * power[place], begins) if len(begins) else np.zeros(0, np.uint64)
    content ^= size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    ids = block.ids[runs.doc]
    order = np.lexsort((ids, content, runs.anchor))
    a, c = runs.anchor[order], content[order]
    new = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))[: len(a)]
    segment = np.empty(len(a), np.int64)
    segment[order] = np.cumsum(new) - 1
    first = order[new]
    tokens = words[ragged(begins[first], size[first])].astype(np.uint32)
    return [runs.anchor[first], content[first], ids[first], runs.size[first].astype(np.uint16), tokens], segment


def _least_holders(sent: list[list[np.ndarray]], window: int, shard_words: int) -> list[np.ndarray]:
    """For each block's segments, window by window: the least id of a document that holds the window."""
    anchor, content, ids, size, tokens = (np.concatenate(x) for x in zip(*sent, strict=True))
    words = size.astype(np.int64) + window - 1
    token_at = np.cumsum(words) - words
    order = np.lexsort((ids, content, anchor))
    a, c = anchor[order], content[order]
    new = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))[: len(a)]
    first = order[new]  # of each distinct segment, the one with the least id
    distinct = np.empty(len(order), np.int64)
    distinct[order] = np.cumsum(new) - 1
    windows = size[first].astype(np.int64)
    out_at = np.cumsum(windows) - windows
    least = np.full(int(windows.sum()), NEVER)
    # an anchor's segments are in one shard, so that no other has to be asked
    opens = np.append(True, anchor[first][1:] != anchor[first][:-1])[: len(first)]
    before = np.cumsum(words[first]) - words[first]
    shard_of = (before[opens] // shard_words)[np.cumsum(opens) - 1]
    begins = np.flatnonzero(np.append(True, shard_of[1:] != shard_of[:-1])[: len(first)])
    for begin, end in zip(begins, np.append(begins[1:], len(first)), strict=True):
        members = begin + np.argsort(ids[first[begin:end]], kind="stable")
        lists = [tokens[token_at[first[m]] : token_at[first[m]] + words[first[m]]].tolist() for m in members]
        automaton = SuffixAutomaton()
        for m, segment in zip(members, lists, strict=True):
            automaton.add(segment, int(ids[first[m]]))
        for m, segment in zip(members, lists, strict=True):
            least[out_at[m] : out_at[m] + windows[m]] = automaton.matches(segment, window)
    ends = np.cumsum([len(x[0]) for x in sent])
    return [least[ragged(out_at[d], windows[d])] for d in (distinct[e - len(x[0]) : e] for e, x in zip(ends, sent, strict=True))]


def remove_repeats(docs: DataFrame, *, window: int = 13, gram: int = 6, shard_words: int = SHARD_WORDS, hot_runs: int = HOT_RUNS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns doc_id, n_words, n_removed and kept (the kept words joined by one space).

    A word goes if a window of `window` words covers it whose words also stand, in this order, in a document with
    a smaller id. Null or empty texts have no words, long ones are read whole. Documents with a null id come back
    unchanged and are no reference for others; rows that share an id are no reference for each other. No rows give no
    rows. Other columns are ignored, whatever their names. Words are compared by 64-bit hashes, windows by `window`
    32-bit hashes in a row. The result does not depend on shard_words and hot_runs."""
    if not 0 < gram <= window < 60_000:
        raise ValueError("gram must be from 1 to window, and window below 60000")
    blocks = word_blocks(docs, lower=False, doc_id=doc_id, text=text)
    n = buckets_of(blocks)
    message = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("sent", pa.binary())])

    def send_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in one_by_one(batches):
            block = WordBlock.unpacked(r["docs"], r["words"])
            arrays = _anchors(block, Runs(block, window, gram))
            edges = cut(arrays[0], n)
            full = np.flatnonzero(np.diff(edges))
            yield row_batch(message, bucket=full.astype(np.int32), block=np.full(len(full), r["block"]), sent=[dump(*(x[edges[b] : edges[b + 1]] for x in arrays)) for b in full])

    def shared_anchors(table: pa.Table) -> pa.Table:
        sent = [load(x) for x in table["sent"].to_pylist()]
        keys, back, counts = np.unique(np.concatenate([k for k, _, _ in sent]), return_inverse=True, return_counts=True)
        shared = counts > 1
        shared[back[np.concatenate([m for _, m, _ in sent])]] = True
        hot = np.bincount(back, np.concatenate([r for _, _, r in sent])) > hot_runs
        at, answers = 0, []
        for k, _, _ in sent:
            own = back[at : at + len(k)]
            part = shared[own]
            answers.append(dump(k[part], hot[own[part]]) if part.any() else None)
            at += len(k)
        return pa.table({"block": table["block"], "bucket": table["bucket"], "answer": pa.array(answers, pa.binary())}).filter(pa.array([x is not None for x in answers], pa.bool_()))

    def by_block(answers: DataFrame) -> DataFrame:
        return answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))

    shared = by_bucket(blocks.mapInArrow(send_anchors, MESSAGE), n).applyInArrow(shared_anchors, ANSWER)

    def shared_runs(block: WordBlock, answers: list[dict]) -> Runs:
        """The runs of a block whose anchor another document has too."""
        runs = Runs(block, window, gram)
        keys, hot = (np.concatenate(x) for x in zip(*(load(x["answer"]) for x in answers), strict=True))
        at = np.minimum(np.searchsorted(keys, runs.anchor), len(keys) - 1)
        known = np.flatnonzero((block.ids[runs.doc] != NULL_ID) & (keys[at] == runs.anchor))
        runs.take(known)
        runs.split(hot[at[known]], window)
        return runs

    def send_segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in one_by_one(batches):
            if not r["shared"]:
                continue
            block = WordBlock.unpacked(r["docs"], r["words"])
            (anchor, content, ids, size, tokens), _ = _segments(block, shared_runs(block, r["shared"]), window)
            token_ends = np.append(0, np.cumsum(size.astype(np.int64) + window - 1))
            edges = cut(anchor, n)
            full = np.flatnonzero(np.diff(edges))
            sent = [dump(*(x[edges[b] : edges[b + 1]] for x in (anchor, content, ids, size)), tokens[token_ends[edges[b]] : token_ends[edges[b + 1]]]) for b in full]
            yield row_batch(message, bucket=full.astype(np.int32), block=np.full(len(full), r["block"]), sent=sent)

    def stream(table: pa.Table) -> pa.Table:
        least = _least_holders([load(x) for x in table["sent"].to_pylist()], window, shard_words)
        return pa.table({"block": table["block"], "bucket": table["bucket"], "answer": pa.array([dump(x) for x in least], pa.binary())})

    # the blocks are dealt by their number once: both joins read the same exchange, and the last pass finds the
    # segments again instead of reading them back
    told = blocks.join(by_block(shared).withColumnRenamed("answers", "shared"), "block", "left")
    answers = by_bucket(told.mapInArrow(send_segments, MESSAGE), n).applyInArrow(stream, ANSWER)

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        for r in one_by_one(batches):
            block = WordBlock.unpacked(r["docs"], r["words"])
            gone = np.zeros(len(block.codes) + 1, np.int32)
            if r["answers"]:
                runs = shared_runs(block, r["shared"])
                (_, _, _, windows, _), segment = _segments(block, runs, window)
                ends = np.cumsum(windows.astype(np.int64))
                least = np.concatenate([load(x["answer"])[0] for x in r["answers"]])
                covered = least[ragged((ends - windows)[segment], runs.size)] < np.repeat(block.ids[runs.doc], runs.size)
                begins = ragged(runs.start, runs.size)[covered]
                gone += np.bincount(begins, minlength=len(gone)).astype(np.int32)
                gone -= np.bincount(begins + window, minlength=len(gone)).astype(np.int32)
            stay = np.cumsum(gone[:-1]) == 0
            ends = np.append(0, np.cumsum(stay))[np.append(0, block.ends)]
            words = np.array(block.words, object)[block.codes[stay]].tolist()
            for k in range(0, len(block.ids), 1000):
                part = slice(k, k + 1000)
                kept = [" ".join(words[a:b]) for a, b in zip(ends[:-1][part], ends[1:][part], strict=True)]
                yield row_batch(schema, doc_id=id_array(block.ids[part]), n_words=block.counts[part], n_removed=block.counts[part] - np.diff(ends)[part], kept=kept)

    joined = told.join(by_block(answers), "block", "left")
    return joined.select("docs", "words", "shared", "answers").mapInArrow(remove, CLEANED)
