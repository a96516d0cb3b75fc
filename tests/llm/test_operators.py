"""Each operator against a plain version, on rows with every odd case, and on no rows."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradeveil.llm import chat, common, decontamination, importance, language_model, line_dedup, near_dedup, packing, quality_rules, substring_dedup, token_files
from gradeveil.llm.encoding import default_vocabulary

from . import brute


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(default_vocabulary())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(docs, data, ids_of, tmp_path):
    shards = token_files.write_token_files(docs, f"file://{tmp_path}/ids", shards=3)
    got = token_files.read_token_files(shards).orderBy("start").collect()
    expected, start = [], 0
    for i, text, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = ids_of(text) + [2]
        expected.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected

    at = {r.doc_id: r.shard for r in got}
    reader = token_files.ShardReader(next(r.path for r in shards.collect() if r.shard == at[1004]))
    assert [x.tolist() for x in reader.get(1004)] == [ids_of("once") + [2]] * 2


def test_damaged_token_file(spark, docs, tmp_path):
    path = token_files.write_token_files(docs, f"file://{tmp_path}/ids", shards=1).first().path[7:]
    raw = bytearray(open(path, "rb").read())
    raw[40] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception):  # noqa: B017 zstandard's own error or the checksum's
        list(token_files.ShardReader(path))


def test_token_files_of_one_id(spark, ids_of, tmp_path):
    """Rows of one id, or of none, lie in several shards; odd column names; ids that do not fit."""
    rows = [(None if k % 2 else 7, f"word{k:03d} text") for k in range(60)]
    docs = spark.createDataFrame(rows, "`doc.id` long, `the text` string").repartition(3)
    shards = token_files.write_token_files(docs, f"file://{tmp_path}/ids", shards=6, doc_id="doc.id", text="the text")
    assert shards.count() > 3
    got = token_files.read_token_files(shards).orderBy("start").collect()
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[1]))
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(ids_of(t)) + 1, crc(ids_of(t) + [2])) for i, t in expected]
    with pytest.raises(Exception, match="does not fit"):
        token_files.write_token_files(docs, f"file://{tmp_path}/narrow", width=1, doc_id="doc.id", text="the text")


def test_no_token_files(no_docs):
    assert token_files.read_token_files(token_files.write_token_files(no_docs)).count() == 0


@pytest.mark.parametrize("capacity,block", [(64, 16), (4096, 4096)])
def test_packing(docs, data, ids_of, capacity, block):
    rows = packing.pack_documents(docs, capacity=capacity, block_pieces=block).collect()
    expected = Counter()
    for i, text, *_ in data:
        ids = ids_of(text) + [1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            expected[i, piece, start, len(part), crc(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    bound = math.ceil(sum(r.length for r in rows) / capacity)
    assert len(sequences) <= bound * 1.03 + 1


def triplets(n=40, capacity=1000, seed=3):
    """Lengths of which three at a time fill a sequence, for which best fit by falling length needs more."""
    pick = random.Random(seed)
    out = []
    for _ in range(n):
        a = pick.randint(380, 489)
        b = pick.randint(250, capacity - a - 250)
        out += [a, b, capacity - a - b]
    return out


def test_evolution_needs_fewer_sequences_than_best_fit():
    lengths = np.sort(np.array(triplets()))[::-1]
    packer = packing.Packer(lengths, 1000, 1)
    best_fit, best = packer.falling(), packer.evolve([], 20, 3000)[0]
    assert packer.bound <= -packer.fitness(best)[0] < -packer.fitness(best_fit)[0]
    assert packer.fills(best).max() <= 1000 and packer.fills(best).sum() == lengths.sum()


def test_crossover_injects_whole_bins_and_keeps_every_piece():
    lengths = np.sort(np.random.default_rng(5).integers(100, 3000, 400))[::-1]
    packer = packing.Packer(lengths, 4096, 1)
    mother, father = packer.first(), packer.first()
    child = packer.cross(mother, father)
    assert len(child) == len(lengths) and packer.fills(child).max() <= 4096 and packer.fills(child).sum() == lengths.sum()
    bins = lambda p: {frozenset(np.flatnonzero(p == b).tolist()) for b in np.unique(p)}
    assert len(bins(child) & bins(father)) > len(bins(mother) & bins(father))


def test_packing_through_islands(spark):
    """The table's result comes from crossover: better than any packing that it begins with, and than best fit."""
    rows = [(i, 0, 0, n, 0) for i, n in enumerate(triplets())]
    pieces = spark.createDataFrame(rows, packing.PIECES).repartition(3)
    lengths = np.sort(np.array([r[3] for r in rows]))[::-1]
    best_fit = -packing.Packer(lengths, 1000, 1).fitness(packing.Packer(lengths, 1000, 1).falling())[0]
    got = packing.pack_pieces(pieces, capacity=1000, islands=3, epochs=3, generations=800, population=20)
    assert got.select("sequence_id").distinct().count() < best_fit


def test_packing_of_pieces_without_ids(spark):
    """Null ids and repeated rows are spread over the blocks; pieces that fill no pair end after one more level."""
    same = spark.createDataFrame([(None, 0, 0, 10, 7)] * 300, packing.PIECES)
    got = packing.pack_pieces(same, capacity=100, block_pieces=20)
    assert got.count() == 300 and got.select("sequence_id").distinct().count() == 30
    large = spark.createDataFrame([(i, 0, 0, 60, 7) for i in range(100)], packing.PIECES)
    assert packing.pack_pieces(large, capacity=100, block_pieces=10).select("sequence_id").distinct().count() == 100


def test_no_packing(no_docs):
    assert packing.pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("min_chars,min_docs", [(40, 5), (3, 2)])
def test_line_dedup(docs, data, min_chars, min_docs):
    rows = line_dedup.dedup_lines(docs, min_chars=min_chars, min_docs=min_docs)
    assert rows.columns == ["doc_id", "text", "source", "block", "n", "n_lines", "n_dropped"]
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped, r.n) for r in rows.collect())
    expected = brute.lines_kept([(i, t) for i, t, *_ in data], min_chars, min_docs)
    assert got == Counter((*e, d[4]) for e, d in zip(expected, data, strict=True))


def test_no_line_dedup(no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0


@pytest.mark.parametrize("shard_words,hot_runs", [(30, 5000), (200_000, 5000), (200_000, 0), (500, 3)])
def test_substring_dedup(docs, data, shard_words, hot_runs):
    got = substring_dedup.remove_repeats(docs, shard_words=shard_words, hot_runs=hot_runs)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == Counter(brute.repeats_removed([(i, t) for i, t, *_ in data]))


def test_substring_dedup_of_interwoven_passages(spark):
    pick = random.Random(4)
    passages = [[f"p{k}" if pick.random() < 0.8 else f"q{k % 3}" for k in range(pick.randint(10, 40))] for _ in range(6)]
    data = []
    for i in range(60):
        text = []
        for _ in range(pick.randint(1, 4)):
            p = pick.choice(passages)
            a = pick.randint(0, len(p) - 5)
            text += p[a : a + pick.randint(5, 30)] + [pick.choice("xyz")] * pick.randint(0, 2)
        data.append((i // 2 if i % 9 == 0 else 100 - i, " ".join(text)))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    for hot_runs in (5000, 10):
        got = substring_dedup.remove_repeats(docs, hot_runs=hot_runs)
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == Counter(brute.repeats_removed(data))


def test_wide_windows(spark):
    """Windows of more words than a byte counts."""
    text = [f"w{k}" for k in range(700)]
    data = [(1, " ".join(text)), (2, " ".join(["x", *text[100:600], "y"])), (3, " ".join(["z", *text[100:330]]))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), window=300, gram=10)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == Counter(brute.repeats_removed(data, 300))


def test_no_substring_dedup(no_docs):
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def near_rows(seed=6):
    pick = random.Random(seed)
    data = []
    for g in range(12):
        base = [f"g{g}w{pick.randint(0, 400)}" for _ in range(pick.choice([1, 3, 12, 60, 150]))]
        for _ in range(pick.choice([1, 2, 5, 40])):
            text = list(base)
            for _ in range(pick.randint(0, max(1, len(text) // 12))):
                text[pick.randrange(len(text))] = f"new{pick.randint(0, 10**6)}"
            data.append((pick.randint(0, 10**6), " ".join(text) if pick.random() < 0.5 else "\n".join(text).upper()))
    return data


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(spark, data, shingle):
    both = near_rows() + [(i, t) for i, t, *_ in data]
    got = near_dedup.near_duplicates(spark.createDataFrame(both, "doc_id long, text string").repartition(5), shingle=shingle)
    expected = brute.components(both, shingle)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == Counter((i, n, c, i == c) for (i, _), (n, c) in zip(both, expected, strict=True))


@pytest.mark.parametrize("tile", [1024, 40])
def test_near_duplicates_below_the_threshold(spark, monkeypatch, tile):
    """A family of which no two are linked but for a few pairs stays apart, also when it is cut into many tiles."""
    monkeypatch.setattr(near_dedup, "TILE", tile)
    pick = random.Random(11)
    base = [f"w{k}" for k in range(200)]
    data = []
    for i in range(300):
        text = list(base)
        for k in pick.sample(range(200), 14):
            text[k] = f"x{i}y{k}"
        data.append((i, " ".join(text)))
    for i in range(0, 40, 4):  # near copies of some
        data.append((1000 + i, data[i][1].replace("w100", "other")))
    got = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), shingle=2)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: c for (i, _), (_, c) in zip(data, brute.components(data, 2), strict=True)}


def test_near_duplicates_in_a_large_group(spark):
    """More near copies of one text than a small node holds, some of them only linked through others."""
    pick = random.Random(8)
    base = [f"w{k}" for k in range(80)]
    data = []
    for i in range(420):
        text = list(base)
        for _ in range(pick.choice([1, 2, 3, 4, 5])):
            text[pick.randrange(80)] = f"x{pick.randint(0, 9999)}"
        data.append((i, " ".join(text)))
    got = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), shingle=2)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: c for (i, _), (_, c) in zip(data, brute.components(data, 2), strict=True)}


def test_large_nodes_compare_across_components():
    import pyarrow as pa

    pick = random.Random(9)
    sets = []
    for _ in range(40):
        s = set(range(100))
        for _ in range(pick.randint(5, 18)):
            s.discard(pick.randrange(100))
            s.add(pick.randint(1000, 9999))
        sets.append(np.array(sorted(s), np.uint64))
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    sketches = [s.tobytes() for s in near_dedup._sketches(flat, sizes)]
    rows = pa.RecordBatch.from_pydict({"node": [1] * 40, "part": [0] * 40, "tile": [0] * 40, "k": list(range(40)), "sketch": sketches, "component": list(range(40)), "home": [True] * 40, "outside": [True] * 40, "set": [s.tobytes() for s in sets]})
    links = [(a, b) for batch in near_dedup._across_large(80)([rows]) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    up = list(range(40))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        assert near_dedup._linked(sets[a], sets[b], 80)
        up[root(a)] = root(b)
    for a in range(40):
        for b in range(a):
            assert root(a) == root(b) or not near_dedup._linked(sets[a], sets[b], 80)


def test_drop_near_duplicates(docs, data, no_docs):
    got = near_dedup.drop_near_duplicates(docs, shingle=5)
    assert got.columns == docs.columns
    kept = [d for d, (_, c) in zip(data, brute.components([(i, t) for i, t, *_ in data], 5), strict=True) if d[0] == c]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter({(d[0], d[1]) for d in kept})
    assert near_dedup.drop_near_duplicates(no_docs).count() == 0


def test_quality_rules(docs, data):
    rows = quality_rules.apply_rules(docs, min_words=30).collect()
    counts = {}
    for i, text, *_ in data:
        counts[i, text] = brute.rule_counts(text)
    assert len(rows) == len(data)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts[r.doc_id, r.text]
        assert r.base_failed == (r.n_words < 30 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_host_verdicts(spark):
    hosts = {"bad": (400, 395), "good": (400, 20), "small": (2, 2), "mid": (300, 120), None: (50, 10)}
    data = [(h, k < f) for h, (n, f) in hosts.items() for k in range(n)]
    got = {r.host: r for r in quality_rules.host_verdicts(spark.createDataFrame(data, "source string, base_failed boolean")).collect()}
    assert {h for h, r in got.items() if r.rejected} == {"bad"}
    assert got["small"].rate < 0.9 < got["bad"].rate  # two failures of two are shrunk towards all hosts
    n, f = sum(x for x, _ in hosts.values()), sum(x for _, x in hosts.values())
    mean = f / n
    spread = sum(n * (f / n) ** 2 for n, f in hosts.values()) / n - mean**2 - mean * (1 - mean) * len(hosts) / n
    strength = min(max(mean * (1 - mean) / spread - 1, 1), n / len(hosts))
    assert got["mid"].rate == pytest.approx((120 + mean * strength) / (300 + strength))


def test_rejected_hosts_by_salted_join(spark, monkeypatch):
    data = [(i, "w" if i % 2 else "fine word " + " ".join(f"w{k}" for k in range(60)), "all bad" if i % 2 else "fine") for i in range(200)]
    data += [(1000, data[0][1], "all bad")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    monkeypatch.setattr(quality_rules, "BROADCAST_HOSTS", 1)
    salted = {(r.doc_id, r.kept, r.base_failed) for r in quality_rules.apply_rules(docs).collect()}
    monkeypatch.undo()
    assert salted == {(r.doc_id, r.kept, r.base_failed) for r in quality_rules.apply_rules(docs).collect()}
    assert (1000, False, False) in salted and (0, True, False) in salted


def test_no_quality_rules(no_docs):
    assert quality_rules.apply_rules(no_docs).count() == 0


def test_lm_counts(docs, data):
    got = language_model.score_documents(docs).collect()
    tokens = lambda t: [brute.lower(w) for w in brute.words(t)] + [None]
    c = Counter(w for i, t, *_ in data if not brute.held_out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    expected = {}
    for i, t, *_ in data:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        expected[i, len(tokens(t)), round(base, 6)] = (brute.held_out(i), sum(c[w] > 0 for w in tokens(t)))
    assert len(got) == len(data)
    for r in got:
        assert r.train_tokens == n
        assert expected[r.doc_id, r.n_tokens, round(r.base_score, 6)] == (r.held_out, r.n_known)
        assert r.score < 0 and math.isfinite(r.score)


def test_lm_is_normalised_and_learns(spark):
    pick = random.Random(1)
    pairs = {w: pick.sample([f"w{k}" for k in range(30)], 3) for w in (f"w{k}" for k in range(30))}
    data = []
    for i in range(300):
        text = ["w0"]
        for _ in range(60):
            text.append(pick.choice(pairs[text[-1]]))
        data.append((i, " ".join(text)))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    base, score, n = language_model.score_documents(docs).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert (score - base) / n > 0.1  # log10 a token


def test_lm_is_normalised():
    """Over all words of training and one unknown word for each class and the end, probabilities sum to 1."""
    random_ = np.random.default_rng(1)
    words = [f"word{k}{x}" for k in range(700) for x in ("ing", "ed", "e")]
    keys, counts = common.hashed(words, len(words)), random_.integers(1, 200, len(words))
    shared = language_model.shared_class(words).astype(np.int64)
    types, tokens = (np.bincount(shared, x, minlength=language_model.CLASSES).astype(np.int64) for x in (None, counts))
    often = counts >= 100
    vocabulary = language_model.Vocabulary.of(keys[often], counts[often], shared[often], types, tokens, 50)
    model = language_model.LogBilinear(language_model.LogBilinear.start(vocabulary, 8), 8, vocabulary)
    model.parts[4][:] = random_.normal(0, 1, model.parts[4].shape)
    classes, symbols, items = vocabulary.place(keys, shared)
    assert (items >= 0).sum() == len(words) - language_model.TOP and len(set(symbols[often])) == often.sum()
    assert vocabulary.class_tokens.sum() == counts.sum() + 50 and vocabulary.item_tokens.sum() == vocabulary.class_tokens[language_model.TOP : -1].sum()
    rare = (classes >= language_model.TOP) & (symbols == classes)
    assert (rare == ~often).all()
    inside = np.where(rare, (counts + 0.5) / (vocabulary.rare_tokens[classes] + 0.5 * (vocabulary.rare_types[classes] + 1)), 1.0)
    context = np.full(len(words), symbols[5]), np.full(len(words), language_model.BEGIN)
    total = (np.exp(model.log_probabilities(*context, classes, items)) * inside).sum()
    unknown = np.arange(language_model.TOP, language_model.TOP + language_model.SHARED)
    share = 0.5 / (vocabulary.rare_tokens[unknown] + 0.5 * (vocabulary.rare_types[unknown] + 1))
    two = context[0][: len(unknown)], context[1][: len(unknown)]
    total += (np.exp(model.log_probabilities(*two, unknown, vocabulary.first_item[unknown])) * share).sum()
    one = context[0][:1], context[1][:1]
    total += np.exp(model.log_probabilities(*one, np.array([language_model.END]), np.array([-1])))[0]
    assert total == pytest.approx(1, abs=1e-4)


def test_lm_gains_with_the_corpus(spark):
    """Held out, the model beats unigrams, and by more on the larger table: its words with vectors grow with the input."""
    gain = {}
    for sf in ("0.001", "0.01"):
        docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
        base, score, n = language_model.score_documents(docs).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
        gain[sf] = (score - base) / n
    assert 0.05 < gain["0.001"] < gain["0.01"] - 0.1


def test_no_lm(no_docs):
    assert language_model.score_documents(no_docs).count() == 0


QUESTION = "Anna walks from the old mill to the river with 12 baskets and then gives 5 of them to Peter before the evening bell rings twice over the town."


def test_decontamination(spark, docs, no_docs):
    other = QUESTION.replace("Anna", "Maria").replace("Peter", "Oskar").replace("12", "340").replace("5 ", "61 ")
    mixed = "Each of 7 men has 7 goats and 9 sheep on the small green hill by the sea"
    bench = [(1, QUESTION), (2, "short item"), (3, mixed), (4, None), (None, "no id here"), (5, "")]
    texts = {
        10: f"Some words before. {QUESTION} And some after.",
        11: f"Some words before, {other} and some after.",
        12: "Anna walks from the old mill to the river and nothing else happens in this text at all.",
        13: mixed.replace("has 7", "has 8"),  # 7 would stand for 7 and 8
        14: mixed.replace("7", "8"),
        15: QUESTION.upper(),
        16: "a Short, Item!",
        17: None,
        19: f"Before {QUESTION.lower()} after",
        18: "",
    }
    rows = spark.createDataFrame([(i, t, [0]) for i, t in texts.items()], "doc_id long, text string, item_ids array<int>")
    bench = spark.createDataFrame(bench, "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontamination.find_leaks(rows, bench).collect()}
    assert got == {10: [1], 11: [1], 12: [], 13: [], 14: [3], 15: [1], 16: [2], 17: [], 18: [], 19: [1]}
    leaks = decontamination.find_leaks(docs, bench)
    assert leaks.columns == [*docs.columns, "item_ids", "cover", "contaminated"] and leaks.where("contaminated").count() == 0
    assert leaks.count() == docs.count()
    assert decontamination.find_leaks(no_docs, bench).count() == 0
    assert decontamination.find_leaks(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_of_parts(spark):
    """Thirteen tokens of a long item are a leak, seven of them are not."""
    item = [f"token{k}" for k in range(60)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame([(n, "before " + " ".join(item[20 : 20 + n]) + " after") for n in (7, 12, 13, 40)], "doc_id long, text string")
    assert {r.doc_id for r in decontamination.find_leaks(docs, bench).where("contaminated").collect()} == {13, 40}


def test_decontamination_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(k, f"item number{k} " + " ".join(f"b{k}w{j}" for j in range(30))) for k in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "before " + " ".join(f"b{k}w{j}" for j in range(30)) + f" b{k + 1}w3 after") for k in range(20)], "doc_id long, text string")
    whole = {(r.doc_id, tuple(r.item_ids)) for r in decontamination.find_leaks(docs, bench).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 100)
    assert {(r.doc_id, tuple(r.item_ids)) for r in decontamination.find_leaks(docs, bench).collect()} == whole == {(k, (k,)) for k in range(20)}


def test_importance(spark, docs, no_docs):
    pick = random.Random(2)
    clean = [f"word{k}" for k in range(400)]
    data, labels = [], []
    for i in range(900):
        words = [pick.choice(clean) for _ in range(pick.randint(5, 80))]
        bad = i % 5 == 0
        if bad:
            words[pick.randrange(len(words))] = pick.choice(["awful", "horrid"])
        data.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 1, int(bad)))
    labels_ = list(labels)
    labels += [(None, 1, 1), (5000, None, 0)]
    rows = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = importance.resample(rows, labels)
    got = scored.collect()
    good, known = {i for i, q, t in labels_ if q and not t and i < 900}, {i for i, *_ in labels_ if i < 900}
    assert len(got) == 900
    expected = dict(zip((i for i, _ in data), brute.log_weights(data, good, known), strict=True))
    for r in got:
        assert r.log_weight == pytest.approx(expected[r.doc_id], abs=1e-5)
    k = round(len(good) / len(known) * 900)
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in sorted(got, key=lambda r: (-r.key, r.doc_id))[:k]}
    noise = np.array([r.key - r.log_weight / 0.5 for r in got])
    assert noise.mean() == pytest.approx(0.5772, abs=0.15) and noise.std() == pytest.approx(1.2825, abs=0.15)  # Gumbel's
    by_weight = {r.doc_id for r in sorted(got, key=lambda r: -r.log_weight)[:450]}
    half = {r.doc_id for r in importance.resample(rows, labels, share=0.5).where("kept").collect()}
    assert 20 < len(by_weight - half) < 200  # a sample, not a cut
    assert sum(r.kept for r in got if r.doc_id % 5 == 0) <= 20 and sum(not r.kept for r in got if r.doc_id % 5) <= 40
    for share, n in ((0.5, 450), (0.0, 0), (1.0, 900)):
        assert importance.resample(rows, labels, share=share).where("kept").count() == n
    assert importance.resample(docs, labels.limit(0)).where("kept").count() == docs.count()
    assert importance.resample(no_docs, labels).count() == 0


def test_importance_of_odd_rows(spark, docs, data):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = importance.resample(docs, labels).collect()
    good = {i for i in range(40) if i % 3} - {1}
    expected = Counter((i, round(w, 4)) for (i, *_), w in zip(data, brute.log_weights([(i, t) for i, t, *_ in data], good, set(range(40))), strict=True))
    assert Counter((r.doc_id, round(r.log_weight, 4)) for r in got) == expected
    assert {r.log_weight for r in got if r.doc_id in (1000, 1001, 1002)} == {0.0}
    some = importance.resample(docs, labels, max_labelled=10)
    assert some.count() == len(data)


def test_tree_sum(spark):
    """Sums over more parts than one level adds up, in several slices."""
    rows = [(s, p, common.dump(np.array([p, s], np.int64), np.array([1], np.int64))) for s in range(3) for p in range(50)]
    parts = spark.createDataFrame(rows, "slice int, part long, counts binary").repartition(5)
    got = {r.slice: [x.tolist() for x in common.load(r.counts)] for r in common.tree_sum(parts, fan=4).collect()}
    assert got == {s: [[sum(range(50)), 50 * s], [50]] for s in range(3)}


def test_top_k_threshold(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), (F.floor(F.sqrt("id") * 3) / 7).alias("key"))
    ordered = sorted(((r.key, r.doc_id) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    for k in (1, 17, 15_000, 29_999):
        assert importance._threshold(rows, k) == ordered[k - 1]
    assert importance._threshold(rows, 0) is None


def conversations(n=150, seed=1):
    pick = random.Random(seed)
    out = []
    for c in range(n):
        roles = (["system"] if pick.random() < 0.3 else []) + ["user", "assistant"] * pick.randint(1, 4)
        for t, role in enumerate(roles):
            size = {"system": 15, "user": 20, "assistant": 110}[role]
            text = "\n".join(" ".join("word" for _ in range(pick.randint(size // 2, size))) + "." for _ in range(3 if role == "assistant" else 1))
            out.append((c, t, role, text))
    return out


def accuracy(turns, parsed):
    truth = turns.select("conv_id", "turn", F.col("role").alias("truth"))
    joined = truth.join(parsed.where("part = 0"), ["conv_id", "turn"], "left")
    return joined.agg(F.avg(F.coalesce((F.col("role") == F.col("truth")).cast("int"), F.lit(0)))).first()[0]


def test_chat_roles(spark):
    turns = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    model = chat.fit(turns)
    assert accuracy(turns, chat.format_chats(turns, model=model)) == 1.0
    masked = turns.withColumn("role", F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(2)) == 0, F.col("role")))
    assert accuracy(turns, chat.format_chats(masked, model=model)) > 0.97
    assert accuracy(turns, chat.format_chats(turns, speaker=None, model=model)) > 0.9


def test_chat_in_chunks(spark):
    """The result does not depend on how conversations are cut, nor do turns that cross chunks."""
    rows = [(9, k, None, text) for k, (_, _, _, text) in enumerate(conversations(40))]
    rows += [(None, None, None, f"null {k}\nUser: hello") for k in range(7)] + [(8, 0, None, f"line {k}" if k % 5 else f"Assistant: turn {k}") for k in range(30)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    model = chat.fit(spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string"))
    model.goes_on = 0.3  # so that turns go on over many rows
    whole, parts, single = (Counter(chat.format_chats(turns, model=model, chunk_rows=n).collect()) for n in (10**6, 16, 1))
    assert whole == parts == single
    assert sum("\n" in r.text and r.conv_id == 9 for r in whole) > 10


def test_chat_path_is_the_best():
    """Viterbi against all paths."""
    model = chat.Model()
    texts = ["User: hello\nthere", "fine, thanks.", "Bot: and\nwhat else?"]
    chunk = chat.Chunk([None, "assistant", None], texts, model)
    states = chunk.decode(model.begin, np.zeros(chat.STATES))

    def score(path):
        return sum(model.move[a, b] + e[b] for a, b, e in zip((chat.BEGIN, *path), path, chunk.emissions, strict=False))

    best = max(itertools.product(range(chat.BEGIN), repeat=len(chunk.lines)), key=score)
    assert tuple(states) == best
    total = chunk.matrix()[chat.BEGIN].max()
    assert total == pytest.approx(score(best))
    # cut in two, with the best scores in between
    first, second = chat.Chunk([None], texts[:1], model), chat.Chunk(["assistant", None], texts[1:], model)
    before = first.matrix()[chat.BEGIN]
    assert (*first.decode(model.begin, second.matrix().max(1)), *second.decode(before, np.zeros(chat.STATES))) == best


def test_chat_roles_from_text_alone(spark):
    """Held-out accuracy on the standard table: fitted to two thirds of the conversations, measured on the others."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    fitted = chat.fit(turns.where("conv_id % 3 > 0"))
    rest = turns.where("conv_id % 3 = 0")
    assert accuracy(rest, chat.format_chats(rest, speaker=None, model=fitted)) > 0.93


def test_chat_fit_of_odd_rows(spark, no_docs):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 2, "someone", "y"), (None, None, "assistant", "Is this?\nyes."), (2, 0, "USER ", "z"), (2, 0, "USER ", "z")]
    model = chat.fit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert np.isfinite(model.length).all() and np.isfinite(model.end).all()
    empty = no_docs.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("text").alias("role"), "text")
    assert (chat.fit(empty).move == chat.Model().move).all()


def test_chat_raw_transcript(spark, no_docs):
    raw = "System: be kind\nUser: hello\nhow are you?\nAssistant: fine\nHuman: ok"
    rows = [(1, 0, raw), (2, 0, None), (2, 1, ""), (None, None, "x"), (3, 0, "twice"), (3, 0, "twice")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = chat.format_chats(turns, speaker=None).orderBy("conv_id", "turn", "part").collect()
    assert [(r.role, r.text) for r in got if r.conv_id == 1] == [("system", "be kind"), ("user", "hello\nhow are you?"), ("assistant", "fine"), ("user", "ok")]
    assert all(r.rendered == f"<|im_start|>{r.role}\n{r.text}<|im_end|>" for r in got)
    assert {r.conv_id for r in got} == {None, 1, 2, 3}
    empty = no_docs.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), "text")
    assert chat.format_chats(empty, speaker=None).count() == 0


def test_decontamination_of_numbers(spark):
    """Copies of items that are mostly numbers and units are found by their values, other numbers are no copy."""
    items = {1: "Compute 12 + 34 - 5 * 6", 2: " ".join(str(k * k) for k in range(30)), 3: "Convert 5 km 300 m 20 cm 7 mm to 12 miles 3 feet", 4: "2 4 8 16"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    texts = {k: f"Before {t} after" for k, t in items.items()}
    texts |= {10: "Compute 13 + 34 - 5 * 6", 20: " ".join(str(k * k + 1) for k in range(30)), 21: "so " + " ".join(str(k * k) for k in range(14)), 40: "2 4 8"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: [4], 10: [], 20: [], 21: [2], 40: []}


def test_decontamination_of_edited_copies(spark):
    """One changed value does not hide the rest of a copy; too little beside it is no leak."""
    words = [f"token{k}" for k in range(60)]
    words[10] = words[40] = "7"
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    edited = [*words[:40], "8", *words[41:]]
    other = ["9" if w == "7" else w for w in edited]  # 7 stands for 9 and 8
    docs = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(other)), (3, " ".join(edited[34:52])), (4, " ".join([*words[5:16], *edited[36:46]]))], "doc_id long, text string")
    got = {r.doc_id: (r.item_ids, r.cover) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {1: ([1], 59 / 60), 2: ([1], 59 / 60), 3: ([1], 18 / 60), 4: ([], 0.0)}


def test_near_duplicates_with_unlike_sketches(spark):
    """Pairs at the threshold of which only 36 and 38 of 64 sketch values are equal."""
    words = lambda n, begin: " ".join(f"p{n}w{k}" for k in range(begin, begin + 90))
    data = [(2 * i + j, words(n, 10 * j)) for i, n in enumerate((52, 5308, 8001)) for j in (0, 1)]
    got = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), shingle=1)
    assert {r.doc_id: r.component_id for r in got.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


@pytest.mark.parametrize("max_hits", [10**6, 5])
def test_decontamination_against_brute_force(spark, monkeypatch, max_hits):
    """Random items and documents of few words, names, numbers and units, with many shared templates."""
    monkeypatch.setattr(decontamination, "MAX_HITS", max_hits)
    pick = random.Random(12)
    frames = [[pick.choice(["the", "man", "walks", "#", "@", "%", "over", "river", "and", "counts"]) for _ in range(pick.randint(5, 30))] for _ in range(6)]
    values = {"#": ["3", "17", "seven", "4.5"], "@": ["Anna", "Peter", "Ravi"], "%": ["km", "hours", "5kg"]}

    def filled(frame):
        return [pick.choice(values[w]) if w in values else w for w in frame]

    items = [(k, " ".join(filled(pick.choice(frames)))) for k in range(12)] + [(None, "no id"), (50, ""), (51, None)]
    texts = []
    for _ in range(60):
        frame = filled(pick.choice(frames))
        begin = pick.randint(0, 4)
        middle = frame[begin : len(frame) - pick.randint(0, 4)]
        if pick.random() < 0.4 and middle:
            middle[pick.randrange(len(middle))] = pick.choice(["other", "9", "Zoe"])
        texts.append(" ".join([*filled(pick.choice(frames))[:3], *middle, *(w.upper() if pick.random() < 0.1 else w for w in filled(pick.choice(frames))[:5])]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.item_ids for r in decontamination.find_leaks(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    units = set(decontamination.UNITS.to_pylist())
    expected = {i: brute.leaked(t, [x for x in items if x[1]], units) for i, t in enumerate(texts)}
    assert got == expected and 10 < sum(map(bool, expected.values())) < 60


def test_clashing_columns(spark):
    """Own columns with names that the operators use stay or are replaced, as the docstrings say."""
    row = (1, "one two three " * 30, "h", "a", "b", "c", [9], 3)
    names = ["doc_id", "text", "source", "__words", "__lines", "__hashes", "item_ids", "N_Words"]
    docs = spark.createDataFrame([row], names)
    out = quality_rules.apply_rules(docs)
    assert [c for c in out.columns if c in names] == names[:7] and out.first()["__words"] == "a"
    bench = spark.createDataFrame([(1, "one two three one two three one two three one two three")], "item_id long, text string")
    leak = decontamination.find_leaks(docs, bench).first()
    assert leak.item_ids == [1] and leak["__lines"] == "b" and leak.text == row[1]
    assert line_dedup.dedup_lines(docs).first()["__words"] == "a"
    assert near_dedup.drop_near_duplicates(docs).first()["__hashes"] == "c"


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_recall(spark, shingle):
    """No link between different texts of the standard table is lost, against an exact set join."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    places, links = brute.exact_components([brute.shingles(t, shingle) for _, t in rows])
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, shingle=shingle).collect()}
    assert links > 0 and got == {i: rows[p][0] for (i, _), p in zip(rows, places, strict=True)}
