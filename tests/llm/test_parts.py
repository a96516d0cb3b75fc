"""The parts that several operators use."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeveil.llm.automaton import SuffixAutomaton
from gradeveil.llm.common import bucket_of, by_bucket, cut, dump, load, mix, rows_in, words_of
from gradeveil.llm.components import connected_components
from gradeveil.llm.encoding import WordEncoder, default_vocabulary
from gradeveil.llm.language_model import _log_softmax
from gradeveil.llm.perfect_hash import LineCounts, PerfectHash, ShippedLines

from . import brute

SYMBOLS = st.text(alphabet=st.sampled_from("aB é.,'s1#\t\n\x0b\x1c ßÀ漢́"), max_size=40)


@given(st.lists(st.one_of(st.none(), SYMBOLS), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words(texts):
    codes, words, counts = words_of(pa.array(texts, pa.string()))
    got, at = [], 0
    for n in counts:
        got.append([words[c] for c in codes[at : at + n]])
        at += n
    assert got == [brute.words(t) for t in texts]


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(default_vocabulary())


@given(texts=st.lists(st.one_of(st.none(), SYMBOLS), max_size=6))
@settings(max_examples=100, deadline=None)
def test_encoder_equals_whole_texts(encoder, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    for text, n, end in zip(texts, counts, ends, strict=True):
        assert ids[end - n : end].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_other_vocabularies_encode_whole_texts():
    import public_tokenizers

    encoder = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not encoder.by_word
    ids, counts = encoder.encode(pa.array(["Two words", None, " x"]))
    assert ids[: counts[0]].tolist() == encoder.tokenizer.encode("Two words").ids and counts[1] == 0


def test_packed_arrays():
    arrays = [np.zeros(0, np.int64), np.arange(7, dtype=np.uint32), np.array([True, False]), np.array([-1, 2**62]), np.array([0.5])]
    for a, b in zip(arrays, load(dump(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.integers(1, 9))
@settings(deadline=None)
def test_cut(keys, n):
    keys = np.sort(np.array(keys, np.uint64))
    edges = cut(keys, n)
    assert edges[0] == 0 and edges[-1] == len(keys)
    for b in range(n):
        assert all(int(k) * n >> 64 == b or int(k) == (b << 64) // n for k in keys[edges[b] : edges[b + 1]])


def test_rows_in_keeps_all_rows_in_order():
    texts = ["x" * k for k in (0, 5, 50, 3, 3, 200, 0)] + [None, "y"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    tables = list(rows_in([batch.slice(0, 4), batch.slice(4)], "text", 10))
    assert sum((t["text"].to_pylist() for t in tables), []) == texts
    assert all(t.num_rows == 1 or sum(len(x or "") for x in t["text"].to_pylist()) <= 10 for t in tables)


def test_perfect_hash():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
        slots = PerfectHash(keys)(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))
    counts = LineCounts(keys)
    foreign = np.random.default_rng(9).integers(0, 2**64, 1000, dtype=np.uint64)
    assert (counts.slots(foreign) == -1).all()


def test_automaton_finds_least_labels():
    pick = random.Random(1)
    for _ in range(400):
        k, a = pick.randint(1, 4), pick.randint(1, 4)
        texts = [[pick.randint(0, a) for _ in range(pick.randint(0, 12))] for _ in range(pick.randint(0, 6))]
        automaton = SuffixAutomaton()
        for label, t in enumerate(texts):
            automaton.add(t, label)
        query = [pick.randint(0, a + 1) for _ in range(12)]
        runs = [query[i : i + k] for i in range(len(query) - k + 1)]
        assert automaton.matches(query, k) == [next((m for m, t in enumerate(texts) if any(t[j : j + k] == r for j in range(len(t)))), None) for r in runs]


def test_components(spark):
    pick = random.Random(2)
    edges = [(pick.randint(0, 80), pick.randint(0, 80)) for _ in range(60)] + [(200 + k, 201 + k) for k in range(30)] + [(5, 5)]
    up = {v: v for e in edges for v in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in up if root(v) != v}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [1, 7, 5000])
def test_shipped_lines(n):
    """Every key that was built in is found with its holder, no other key of the block is, and arrays survive the way."""
    keys = mix(np.arange(1, 3 * n + 1, dtype=np.uint64))
    inside, others = keys[:n], keys[n:]
    shipped = ShippedLines.of(inside, np.arange(n) * 10, others)
    again = ShippedLines.of_arrays(*load(dump(*shipped.arrays())))
    assert again.fingerprints.dtype == np.uint16
    for x in (shipped, again):
        found, last = x.probe(keys)
        assert found.tolist() == [True] * n + [False] * 2 * n
        assert last[:n].tolist() == list(range(0, 10 * n, 10))


def test_buckets_agree():
    keys = np.sort(mix(np.arange(1000, dtype=np.uint64)))
    for n in (1, 3, 64):
        edges = cut(keys, n)
        assert bucket_of(keys, n).tolist() == np.repeat(np.arange(n), np.diff(edges)).tolist()


@pytest.mark.parametrize("scale,shift", [(1, 0), (40, 0), (3, -200), (3, 200)])
def test_log_softmax(scale, shift):
    """Also where scores are so low or high that they can't be raised to a power as they are."""
    random_ = np.random.default_rng(0)
    scores = (random_.normal(0, scale, (50, 7)) + shift).astype(np.float32)
    at = random_.integers(0, 7, 50)
    wide = scores.astype(float)
    most = wide.max(1)
    expected = wide[np.arange(50), at] - most - np.log(np.exp(wide - most[:, None]).sum(1))
    assert _log_softmax(scores, at) == pytest.approx(expected, abs=1e-4)


@pytest.mark.parametrize("n", [1, 4, 37])
def test_every_bucket_has_a_task_of_its_own(spark, n):
    messages = spark.range(3 * n).select((F.col("id") % n).cast("int").alias("bucket"), F.col("id").alias("block"))

    def where(table):
        from pyspark import TaskContext

        return pa.table({"bucket": table["bucket"][:1], "task": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([len(table)], pa.int32())})

    rows = by_bucket(messages, n).applyInArrow(where, "bucket int, task int, n int").collect()
    assert len({r.task for r in rows}) == n and sorted(r.bucket for r in rows) == list(range(n)) and {r.n for r in rows} == {3}
