"""Language-model scores: a log-bilinear model, trained in numpy by noise-contrastive estimation.

Every word of the training text is counted, over blocks and buckets of word hashes. The model is factored in two
levels. The most frequent words and the end of a text are classes of their own; all other words share classes by the
hash of their last letters. Within a shared class every word that training has often enough is an item of its own, and
all rare ones are one item, in which a word has its smoothed share. The two words before a token, each with a vector of
its own if it is frequent, give the class and then the item by log-bilinear scores, both normalised by batched matrix
products. So a token's probabilities sum to 1, with one unknown word for each class.

The number of words with vectors grows with the corpus: those with min_count tokens and a share of min_share of all
tokens, which are 1 / min_share at most, so that the parameters, which every task holds, are bounded.

Training visits every training token once: in each of a few rounds the tasks start from the current parameters, run
stochastic gradient steps over their blocks of that round, and their parameters are averaged by tokens, by a tree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeveil.llm.common import NULL_ID, buckets_of, by_bucket, cut, dump, hashed, id_array, load, mix, one_blas_thread, one_by_one, row_batch, tree_sum, written
from gradeveil.llm.word_blocks import WordBlock, word_blocks

#: Words with a class of their own, classes of other words; then come the end and, in contexts only, the begin.
TOP, SHARED = 63, 192
CLASSES = TOP + SHARED + 1
END, BEGIN = CLASSES - 1, CLASSES
SUFFIX = 3
#: Tokens whose scores are normalised at a time: few enough for a core's cache.
CHUNK = 512
#: Rows in which a task sends its parameters.
SLICES = 64
MESSAGE = "bucket int, block long, sent binary"
ANSWER = "block long, bucket int, answer binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Block numbers of a bucket's summaries: sums over classes, and its frequent words.
SUMS, FREQUENT = -1, -2


def held_out(ids: np.ndarray) -> np.ndarray:
    """Whether crc32 of the id as text leaves 1 when divided by 5. A null id is training text."""
    return np.fromiter((i != NULL_ID and zlib.crc32(str(i).encode()) % 5 == 1 for i in ids.tolist()), bool, len(ids))


def shared_class(words: list[str]) -> np.ndarray:
    """The class of each word that has none of its own."""
    crc = zlib.crc32
    return np.fromiter((TOP + crc(w.rstrip(".,")[-SUFFIX:].encode()) % SHARED for w in words), np.uint16, len(words))


@dataclass
class Vocabulary:
    """The words that have vectors, and where they stand. Symbols are what contexts hold: the classes (a shared one for
    its rare words), the begin, then one for each frequent word of a shared class. Items part the shared classes: by
    class, its rare words and then its frequent ones."""

    keys: np.ndarray  # hashes of the frequent words, ascending
    classes: np.ndarray  # of each
    symbols: np.ndarray
    items: np.ndarray  # -1 for words with a class of their own
    item_class: np.ndarray  # ascending
    item_tokens: np.ndarray
    class_tokens: np.ndarray
    rare_tokens: np.ndarray  # of each class
    rare_types: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, shared: np.ndarray, types: np.ndarray, tokens: np.ndarray, end_count: int) -> Vocabulary:
        """keys, counts, shared: of the frequent words, in any order; types, tokens: of all words by shared class."""
        order = np.argsort(keys)
        keys, counts, shared = keys[order], counts[order], shared[order].astype(np.int64)
        own = np.sort(np.lexsort((keys, -counts))[:TOP])
        classes, items = shared.copy(), np.full(len(keys), -1, np.int64)
        classes[own] = np.arange(len(own))
        rest = np.setdiff1d(np.arange(len(keys)), own)
        rare_tokens, rare_types = tokens.astype(np.int64).copy(), types.astype(np.int64).copy()
        np.subtract.at(rare_tokens, shared, counts)
        np.subtract.at(rare_types, shared, 1)
        item_class = np.concatenate([np.arange(TOP, TOP + SHARED), classes[rest]])
        by = np.argsort(item_class, kind="stable")  # the rare words of a class first
        item_tokens = np.concatenate([rare_tokens[TOP : TOP + SHARED], counts[rest]])[by]
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        items[rest] = place[SHARED:]
        symbols = classes.copy()
        symbols[rest] = CLASSES + 1 + np.arange(len(rest))
        class_tokens = np.bincount(classes, counts, minlength=CLASSES).astype(np.int64)
        class_tokens[TOP : TOP + SHARED] += rare_tokens[TOP : TOP + SHARED]
        class_tokens[END] = end_count
        return cls(keys, classes, symbols, items, item_class[by], item_tokens, class_tokens, rare_tokens, rare_types)

    @property
    def n_symbols(self) -> int:
        return CLASSES + 1 + len(self.item_class) - SHARED

    @property
    def first_item(self) -> np.ndarray:
        """Where each class's items begin, and where the last ones end."""
        return np.searchsorted(self.item_class, np.arange(CLASSES + 1))

    def place(self, keys: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, symbol and item (-1: none) of words with these hashes and shared classes."""
        classes = shared.astype(np.int64)
        symbols, items = classes.copy(), self.first_item[classes]
        if len(self.keys) and len(keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            classes[known], symbols[known], items[known] = self.classes[at[known]], self.symbols[at[known]], self.items[at[known]]
        return classes, symbols, items


def _added(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of `at`, and the sums of their rows."""
    order = np.argsort(at)
    ordered = at[order]
    begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[begins], np.add.reduceat(rows[order], begins, axis=0)


class LogBilinear:
    """score(class | previous two) = (a1 * in[s1] + a2 * in[s2]) . out[class] + bias[class], and likewise for items."""

    def __init__(self, parameters: np.ndarray, size: int, words: Vocabulary):
        self.size, self.words, at = size, words, 0
        self.parts = []
        n = len(words.item_class)
        for shape in ((words.n_symbols, size), (CLASSES, size), (2, size), (CLASSES,), (n, size), (n,)):
            count = int(np.prod(shape))
            self.parts.append(parameters[at : at + count].reshape(shape).astype(np.float32))
            at += count
        self.inputs, self.outputs, self.mix, self.bias, self.item_outputs, self.item_bias = self.parts
        self.squares = [np.full(p.shape, 1.0, np.float32) for p in self.parts]
        self.first_item = words.first_item

    @classmethod
    def start(cls, words: Vocabulary, size: int, seed: int = 1) -> np.ndarray:
        """Parameters of a model that knows frequencies and nothing else."""
        random = np.random.default_rng(seed)
        share = (words.class_tokens + 0.5) / (words.class_tokens.sum() + 0.5 * CLASSES)
        inputs = random.normal(0, 0.1, (words.n_symbols, size))
        # a frequent word begins where its class stands
        inputs[CLASSES + 1 :] = inputs[words.item_class[np.append(False, words.item_class[1:] == words.item_class[:-1])]]
        items = np.log((words.item_tokens + 0.5) / (words.class_tokens[words.item_class] + 0.5))
        n = len(words.item_class)
        return np.concatenate([inputs.ravel(), random.normal(0, 0.1, CLASSES * size), np.ones(2 * size), np.log(share), np.zeros(n * size), items])

    def parameters(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float64)

    def context(self, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
        return self.inputs[s1] * self.mix[0] + self.inputs[s2] * self.mix[1]

    def _step(self, part: int, gradient: np.ndarray, rate: float, rows: np.ndarray | None = None) -> None:
        """One Adagrad step on a part of the parameters, or on some of its rows."""
        at = slice(None) if rows is None else rows
        gradient = gradient.astype(np.float32)
        self.squares[part][at] += gradient * gradient
        self.parts[part][at] += rate * gradient / np.sqrt(self.squares[part][at])

    def train(self, s1: np.ndarray, s2: np.ndarray, target: np.ndarray, item: np.ndarray, rate: float, batch: int, samples: int, item_samples: int, seed: int) -> None:
        """One pass of noise-contrastive estimation with Adagrad. target: classes; item: the item of each token, -1 if
        its class is one word. A batch shares its noise classes, so all their scores are one matrix product; noise
        items come from the token's own class. Noise is drawn by frequency."""
        random, words, size = np.random.default_rng(seed), self.words, self.size
        order = random.permutation(len(target))
        noise = (words.class_tokens + 0.5) * (words.class_tokens > 0) + 1e-6
        noise /= noise.sum()
        cumulated = np.cumsum(noise)
        expected = np.log(samples * noise).astype(np.float32)
        item_weight = words.item_tokens + 0.5
        item_sums = np.concatenate([[0.0], np.cumsum(item_weight)])
        low, high = item_sums[self.first_item[:-1]], item_sums[self.first_item[1:]]
        in_class = item_weight / (high - low)[words.item_class]
        item_expected = np.log(item_samples * in_class).astype(np.float32)
        columns = np.arange(size)

        def scattered(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
            flat = (at[:, None].astype(np.int64) * size + columns).ravel()
            return np.bincount(flat, rows.ravel(), minlength=CLASSES * size).reshape(CLASSES, size)

        def up_of(score: np.ndarray) -> np.ndarray:
            return 1 / (1 + np.exp(np.clip(score, -30, 30)))

        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            p, q, w, i = s1[some], s2[some], target[some], item[some]
            e = np.minimum(np.searchsorted(cumulated, random.random(samples) * cumulated[-1]), CLASSES - 1)
            in1, in2 = self.inputs[p], self.inputs[q]
            h = in1 * self.mix[0] + in2 * self.mix[1]
            out = self.outputs[w]
            up = up_of(np.einsum("ij,ij->i", h, out) + self.bias[w] - expected[w])  # raise the class that was seen
            down = up_of(-(h @ self.outputs[e].T + self.bias[e] - expected[e]))  # and lower the noise
            to_h = up[:, None] * out - down @ self.outputs[e]
            g_out = scattered(w, up[:, None] * h) - scattered(e, down.T @ h)
            g_bias = np.bincount(w, up, minlength=CLASSES) - np.bincount(e, down.sum(0), minlength=CLASSES)
            parted = np.flatnonzero(i >= 0)
            if len(parted):
                c, hi = w[parted], h[parted]
                drawn = low[c][:, None] + random.random((len(parted), item_samples)) * (high - low)[c][:, None]
                j = np.clip(np.searchsorted(item_sums, drawn.ravel(), "right") - 1, np.repeat(self.first_item[c], item_samples), np.repeat(self.first_item[c + 1] - 1, item_samples))
                at = np.concatenate([i[parted], j])
                rows = np.concatenate([np.arange(len(parted)), np.repeat(np.arange(len(parted)), item_samples)])
                vectors, h_rows = self.item_outputs[at], hi[rows]
                sign = np.where(np.arange(len(at)) < len(parted), 1.0, -1.0).astype(np.float32)
                pull = sign * up_of(sign * (np.einsum("ij,ij->i", h_rows, vectors) + self.item_bias[at] - item_expected[at]))
                pulled = pull[:, None] * vectors
                to_h[parted] += pulled[: len(parted)] + np.einsum("ijk->ik", pulled[len(parted) :].reshape(len(parted), item_samples, size))
                some_items, gradient = _added(np.concatenate([pull[:, None] * h_rows, pull[:, None]], 1), at)
                self._step(4, gradient[:, :-1], rate, some_items)
                self._step(5, gradient[:, -1], rate, some_items)
            g_mix = np.stack([np.einsum("ij,ij->j", to_h, x) for x in (in1, in2)]) / np.sqrt(len(some))
            symbols, g_in = _added(np.concatenate([to_h * self.mix[0], to_h * self.mix[1]]), np.concatenate([p, q]))
            self._step(0, g_in, rate, symbols)
            for part, g in ((1, g_out), (2, g_mix), (3, g_bias)):
                self._step(part, g, rate)

    def log_probabilities(self, s1: np.ndarray, s2: np.ndarray, target: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Natural logs, normalised over all classes and over the items of the token's class."""
        out = np.empty(len(target))
        # a last column of ones takes the biases into the matrix product
        half = np.full((len(self.inputs), 1), 0.5, np.float32)
        inputs = [np.hstack([self.inputs * m, half]) for m in self.mix]
        outputs = np.vstack([self.outputs.T, self.bias])
        contexts = np.empty((len(target), self.size + 1), np.float32)
        for k in range(0, len(target), CHUNK):
            part = slice(k, k + CHUNK)
            contexts[part] = inputs[0][s1[part]] + inputs[1][s2[part]]
            out[part] = _log_softmax(contexts[part] @ outputs, target[part])
        parted = np.flatnonzero(item >= 0)
        parted = parted[np.argsort(target[parted], kind="stable")]
        ends = np.searchsorted(target[parted], np.arange(CLASSES + 1))
        for c in range(TOP, TOP + SHARED):
            first, last = self.first_item[c], self.first_item[c + 1]
            if last - first < 2:  # only rare words
                continue
            vectors = np.vstack([self.item_outputs[first:last].T, self.item_bias[first:last]])
            for k in range(ends[c], ends[c + 1], CHUNK):
                some = parted[k : min(k + CHUNK, ends[c + 1])]
                out[some] += _log_softmax(contexts[some] @ vectors, item[some] - first)
        return out


def _log_softmax(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The normalised log of one score in each row. Rows are only shifted by their greatest score where they need it."""
    own = scores[np.arange(len(scores)), at]
    most = np.float32(0) if scores.max(initial=0) < 60 else scores.max(1)
    for _ in range(2):
        sums = np.exp(scores - most[:, None] if most.ndim else scores) @ np.ones(scores.shape[1], np.float32)
        if most.ndim or (sums > 1e-30).all():
            break
        most = scores.max(1)  # all of a row's scores are very low
    return own - most - np.log(sums)


def _sequence(counts: np.ndarray, codes: np.ndarray, classes: np.ndarray, symbols: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all texts with their ends: the symbols of the two tokens before each, its class and item, and its text."""
    ends = np.cumsum(counts)
    target = np.insert(classes[codes].astype(np.int64), ends, END)
    symbol = np.insert(symbols[codes].astype(np.int64), ends, END)
    item = np.insert(items[codes].astype(np.int64), ends, -1)
    row = np.repeat(np.arange(len(counts)), counts + 1)
    s1, s2 = np.full(len(target), BEGIN), np.full(len(target), BEGIN)
    same = row[1:] == row[:-1]
    s1[1:][same] = symbol[:-1][same]
    same = row[2:] == row[:-2]
    s2[2:][same] = symbol[:-2][same]
    return s1, s2, target, item, row


def score_documents(docs: DataFrame, *, size: int = 16, rounds: int = 3, rate: float = 0.15, batch: int = 2048, samples: int = 64, item_samples: int = 2, min_count: int = 30, min_share: float = 5e-6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores every text by a model of those whose id is not held out; one row per row of docs.

    Tokens are lower-cased (A-Z) words and one end. base_score: log10 of the smoothed unigram probability; score: log10
    of the model's; n_known: tokens that training has; train_tokens: all tokens of training. Null or empty texts are
    their end alone, long ones are read whole; a null id stays null and is training text; repeated rows count each;
    without rows there are none. Other columns are ignored, whatever their names. Words are counted by 64-bit hashes.
    min_count, min_share: tokens, and share of all tokens, from which a word has vectors of its own."""
    spark = docs.sparkSession
    blocks = word_blocks(docs, lower=True, doc_id=doc_id, text=text)
    n = buckets_of(blocks)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("sent", pa.binary())])
        for r in one_by_one(batches):
            block = WordBlock.unpacked(r["docs"], r["words"])
            keys = hashed(block.words, len(block.words))
            train = ~held_out(block.ids)
            counts = np.bincount(block.codes[train[block.row]], minlength=len(keys)).astype(np.uint32)
            order = np.argsort(keys)
            keys, counts, classes = keys[order], counts[order], shared_class(block.words)[order]
            edges = cut(keys, n)
            full = np.flatnonzero(np.diff(edges))
            yield row_batch(schema, bucket=full.astype(np.int32), block=np.full(len(full), r["block"]), sent=[dump(*(x[edges[b] : edges[b + 1]] for x in (keys, counts, classes))) for b in full])

    def count(table: pa.Table) -> pa.Table:
        sent = [load(x) for x in table["sent"].to_pylist()]
        keys, first, back = np.unique(np.concatenate([s[0] for s in sent]), return_index=True, return_inverse=True)
        total = np.bincount(back, np.concatenate([s[1] for s in sent]), minlength=len(keys)).astype(np.int64)
        classes = np.concatenate([s[2] for s in sent])[first]
        answers, at = [], 0
        for s in sent:
            answers.append(dump(total[back[at : at + len(s[0])]]))
            at += len(s[0])
        often = total >= min_count
        answers.append(dump(np.bincount(classes[total > 0], minlength=CLASSES), np.bincount(classes, total, minlength=CLASSES).astype(np.int64)))
        answers.append(dump(keys[often], total[often], classes[often]))
        blocks, buckets = table["block"].to_pylist(), table["bucket"].to_pylist()
        return pa.table({"block": pa.array([*blocks, SUMS, FREQUENT], pa.int64()), "bucket": pa.array([*buckets, buckets[0], buckets[0]], pa.int32()), "answer": pa.array(answers, pa.binary())})

    answers = written(by_bucket(blocks.mapInArrow(send, MESSAGE), n).applyInArrow(count, ANSWER), "counts")
    words, train_tokens, n_types, end_count = _vocabulary(answers, blocks, min_share)
    shared = spark.sparkContext.broadcast(words)
    by_block = answers.where("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("coded", pa.binary())])
        words = shared.value
        for r in one_by_one(batches):
            block = WordBlock.unpacked(r["docs"], r["words"])
            keys = hashed(block.words, len(block.words))
            known = np.empty(len(keys), np.int64)
            parts = [load(x["answer"])[0] for x in r["answers"] or []]
            known[np.argsort(keys)] = np.concatenate(parts) if parts else []
            classes, symbols, items = words.place(keys, shared_class(block.words))
            rare = symbols == classes
            rare &= classes >= TOP
            inside = np.where(rare, np.log((known + 0.5) / (words.rare_tokens[classes] + 0.5 * (words.rare_types[classes] + 1))), 0.0)
            yield row_batch(schema, block=[r["block"]], coded=[dump(block.ids, block.counts.astype(np.int32), block.codes, classes.astype(np.uint16), symbols.astype(np.int32), items.astype(np.int32), known, inside)])

    joined = blocks.join(by_block, "block", "left").select("block", "docs", "words", "answers")
    # blocks are numbered within tasks: their hashes deal them into rounds
    coded = written(joined.mapInArrow(code, "block long, coded binary").withColumn("round", F.pmod(F.xxhash64("block"), F.lit(rounds)).cast("int")), "coded", by="round")
    parameters = LogBilinear.start(words, size)
    for r in range(rounds):
        parameters = _round(coded.where(F.col("round") == r), parameters, shared, size, rate / (1 + r), batch, samples, item_samples)
    model = spark.sparkContext.broadcast(parameters.astype(np.float32))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])
        one_blas_thread()
        lbl = LogBilinear(model.value, size, shared.value)
        for r in one_by_one(batches):
            ids, counts, codes, classes, symbols, items, known, inside = load(r["coded"])
            counts = counts.astype(np.int64)
            *tokens, row = _sequence(counts, codes, classes, symbols, items)
            logs = np.bincount(row, lbl.log_probabilities(*tokens), minlength=len(ids))
            word_row = np.repeat(np.arange(len(ids)), counts)
            logs += np.bincount(word_row, inside[codes], minlength=len(ids))
            all_ = train_tokens + 0.5 * (n_types + 1)
            unigram = np.log10((known + 0.5) / all_)
            based = np.bincount(word_row, unigram[codes], minlength=len(ids)) + np.log10((end_count + 0.5) / all_)
            n_known = np.bincount(word_row, (known > 0)[codes], minlength=len(ids)).astype(np.int64) + (end_count > 0)
            yield row_batch(schema, doc_id=id_array(ids), held_out=held_out(ids), n_tokens=counts + 1, n_known=n_known, train_tokens=np.full(len(ids), train_tokens), base_score=based, score=logs / np.log(10))

    return coded.select("coded").mapInArrow(score, SCORES)


def _vocabulary(answers: DataFrame, blocks: DataFrame, min_share: float) -> tuple[Vocabulary, int, int, int]:
    """The words with vectors; the tokens and types of all training text, with its ends, and its number of texts. Sums
    over buckets are added up by a tree; of the buckets' frequent words those above min_share come to the driver, which
    are 1 / min_share at most."""

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(int((~held_out(load(r["docs"])[0])).sum()) for r in one_by_one(batches))
        yield row_batch(pa.schema([("n", pa.int64())]), n=[total])

    end_count = blocks.select("docs").mapInArrow(ends, "n long").agg(F.sum("n")).first()[0] or 0
    types, tokens = np.zeros((2, CLASSES), np.int64)
    parts = answers.where(F.col("block") == SUMS).select(F.lit(0).alias("slice"), F.col("bucket").cast("long").alias("part"), F.col("answer").alias("counts"))
    for r in tree_sum(parts).collect():
        types, tokens = load(r.counts)
    train_tokens = int(tokens.sum()) + end_count
    least = min_share * train_tokens

    def often(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("class", pa.int32())])
        for r in one_by_one(batches):
            keys, counts, classes = load(r["answer"])
            some = counts >= least
            yield row_batch(schema, **{"key": keys[some].view(np.int64), "n": counts[some], "class": classes[some].astype(np.int32)})

    rows = answers.where(F.col("block") == FREQUENT).select("answer").mapInArrow(often, "key long, n long, class int").toArrow()
    words = Vocabulary.of(np.asarray(rows["key"]).view(np.uint64), np.asarray(rows["n"]), np.asarray(rows["class"]), types, tokens, end_count)
    return words, train_tokens, int(types.sum()) + (end_count > 0), end_count


def _round(blocks: DataFrame, parameters: np.ndarray, words, size: int, rate: float, batch: int, samples: int, item_samples: int) -> np.ndarray:
    """The parameters after one pass over these blocks: a task goes on from block to block."""
    shared = blocks.sparkSession.sparkContext.broadcast(parameters.astype(np.float32))
    width = -(-len(parameters) // SLICES)

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one_blas_thread()
        model, n = None, 0
        for r in one_by_one(batches):
            ids, counts, codes, classes, symbols, items, _, _ = load(r["coded"])
            *tokens, row = _sequence(counts.astype(np.int64), codes, classes, symbols, items)
            learn = ~held_out(ids)[row]
            if learn.any():
                model = model or LogBilinear(shared.value, size, words.value)
                model.train(*(t[learn] for t in tokens), rate, batch, samples, item_samples, int(mix(np.array([r["block"]], np.uint64))[0] >> np.uint64(1)))
                n += int(learn.sum())
        if model:
            moved, part = (model.parameters() - shared.value) * n, TaskContext.get().partitionId()
            schema = pa.schema([("slice", pa.int32()), ("part", pa.int64()), ("counts", pa.binary())])
            yield row_batch(schema, slice=range(SLICES), part=[part] * SLICES, counts=[dump(moved[k * width : (k + 1) * width], np.array([n])) for k in range(SLICES)])

    out = parameters.copy()
    for r in tree_sum(blocks.select("block", "coded").mapInArrow(train, "slice int, part long, counts binary")).collect():
        moved, n = load(r.counts)
        out[r.slice * width : (r.slice + 1) * width] += moved / n[0]
    return out
