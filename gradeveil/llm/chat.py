"""Chat transcripts: a hidden Markov model recovers the speaker of every line, then turns are rendered.

Rows are messages in order, or raw pieces of a transcript: each line of their texts is an observation. The hidden
state is a role and whether the line opens a turn or goes on with it. Observed are the speaker marker (a prefix such as
"User:" or "### Assistant:" in the line itself, or the row's speaker label on its first line where a column with
labels is given), whether the line opens a row, its length, and its last character. The features' distributions are
fitted to all labelled rows over smoothed defaults; Viterbi finds the most probable states of a whole conversation.

Rows are sorted by ranges, so that a conversation may lie in several tasks, and gathered into chunks of bounded size.
In max-plus algebra a chunk is a matrix, so a conversation that spans many chunks is decoded exactly without ever being
in one task's memory: passes over the chunks' matrices, forward and backward, give the best scores into and out of each
chunk, every chunk is decoded between them, and a turn that crosses chunks is put together again.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeveil.llm.common import block_ids, one_by_one, row_batch, written

ROLES = ("system", "user", "assistant")
#: Labels and prefixes that name a role.
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions", "developer"),
    "user": ("user", "human", "q", "question", "customer", "client", "prompter", "me"),
    "assistant": ("assistant", "bot", "ai", "a", "answer", "agent", "model", "gpt", "support"),
}
ROLE_OF = {label: role for role, labels in MARKERS.items() for label in labels}
PREFIX = re.compile(r"^[\s>#*\[\(<|]*(%s)[\]\)>|*]*\s*(?::|\]|\)|>|\|>)\s*" % "|".join(sorted(ROLE_OF, key=len, reverse=True)), re.IGNORECASE)
#: States 0-2 open a turn of that role, 3-5 go on with it; 6 is before the first line.
STATES = 2 * len(ROLES) + 1
BEGIN = STATES - 1
LENGTHS = (1, 40, 120, 300, 800)
ENDS = "?!.:,"
#: Rows and characters of text in a chunk; a row that is longer makes one of its own.
CHUNK_ROWS = 512
CHUNK_CHARS = 1 << 20
CHUNKS = "conv long, chunk long, turns array<long>, labels array<string>, texts array<string>"
PIECES = "conv_id long, chunk long, number int, goes_on boolean, border boolean, turn long, part int, role string, text string"
LOW = -1e18


class Model:
    def __init__(self, roles: Counter | None = None, follows: Counter | None = None, first: Counter | None = None, lengths: Counter | None = None, ends: Counter | None = None, lines: Counter | None = None):
        """Counts of labelled data; without any, mild defaults remain."""
        none: Counter = Counter()
        roles, follows, first, lengths, ends, lines = (x or none for x in (roles, follows, first, lengths, ends, lines))
        default = {("system", "user"): 8, ("user", "assistant"): 9, ("assistant", "user"): 9, ("user", "user"): 1, ("assistant", "assistant"): 0.5, ("system", "assistant"): 1}
        log = np.log
        nexts = np.array([[follows[a, b] + default.get((a, b), 0.1) for b in ROLES] for a in ROLES])
        nexts = log(nexts / nexts.sum(1, keepdims=True))
        starts = np.array([first[r] + s for r, s in zip(ROLES, (2, 4, 0.5), strict=True)], float)
        # a turn goes on with probability stay from line to line
        stay = np.array([max(0.05, min(0.95, 1 - roles[r] / lines[r])) if lines[r] else 0.5 for r in ROLES])
        self.move = np.full((STATES, STATES), LOW)
        for a in range(BEGIN):
            role = a % 3
            self.move[a, :3] = log(1 - stay[role]) + nexts[role]
            self.move[a, 3 + role] = log(stay[role])
        self.move[BEGIN, :3] = log(starts / starts.sum())
        # how often a row goes on with the turn before: 1 in 50; but where rows have labels, they are turns of their own
        self.goes_on = 1 / (sum(roles.values()) + 50)
        self.begin = np.where(np.arange(STATES) == BEGIN, 0.0, LOW)
        self.length = np.array([[lengths[r, k] + 2 for k in range(len(LENGTHS) + 1)] for r in ROLES], float)
        self.length = log(self.length / self.length.sum(1, keepdims=True))
        self.end = np.array([[ends[r, k] + 2 for k in range(len(ENDS) + 1)] for r in ROLES], float)
        self.end = log(self.end / self.end.sum(1, keepdims=True))

    def emission(self, line: str, opens_row: bool, marker: int) -> np.ndarray:
        """Log-probabilities of one line in each state. marker: a role's number, or -1."""
        out = np.zeros(STATES)
        length, end = _length(line), _end(line)
        out[BEGIN] = LOW
        out[:3] = out[3:BEGIN] = self.length[:, length] + self.end[:, end]
        # lines inside rows open turns without a marker in 1 of 500
        out[:3] += math.log(1 - self.goes_on if opens_row else (0.9 if marker >= 0 else 0.002))
        out[3:BEGIN] += math.log(self.goes_on if opens_row else (0.1 if marker >= 0 else 0.998))
        if marker >= 0:  # a marker names the wrong role in 1 of 100 cases
            wrong = np.full(3, math.log(0.005))
            wrong[marker] = math.log(0.99)
            out[:3] += wrong
            out[3:BEGIN] += math.log(0.01)
        return out


def _length(line: str) -> int:
    return sum(len(line) >= n for n in LENGTHS)


def _end(line: str) -> int:
    """The place of the line's last character in ENDS; behind it, for any other and for blank lines."""
    at = ENDS.find(line.rstrip()[-1:]) if line.strip() else -1
    return at if at >= 0 else len(ENDS)


def marker_of(label: str | None, line: str, opens_row: bool) -> tuple[int, str]:
    """The role's number that the line's marker names (-1: none), and the line without its prefix."""
    found = PREFIX.match(line)
    if found:
        return ROLES.index(ROLE_OF[found[1].lower()]), line[found.end() :]
    role = ROLE_OF.get((label or "").strip().lower()) if opens_row else None
    return (ROLES.index(role) if role else -1), line


class Chunk:
    """The lines of consecutive rows of a conversation."""

    def __init__(self, labels: list[str | None], texts: list[str | None], model: Model):
        self.lines: list[tuple[int, str, str, int]] = []  # row, line, line without prefix, marker
        emissions = []
        for k, (label, text) in enumerate(zip(labels, texts, strict=True)):
            for j, line in enumerate((text or "").split("\n")):
                marker, rest = marker_of(label, line, j == 0)
                self.lines.append((k, line, rest, marker))
                emissions.append(model.emission(rest, j == 0, marker))
        self.emissions, self.move = np.array(emissions), model.move

    def matrix(self) -> np.ndarray:
        """Best scores from the state before the chunk (rows) to its last state."""
        out = np.zeros((STATES, STATES)) + np.where(np.eye(STATES, dtype=bool), 0, LOW)
        for e in self.emissions:
            out = (out[:, :, None] + self.move[None]).max(1) + e
        return out

    def decode(self, before: np.ndarray, after: np.ndarray) -> list[int]:
        """States, given the best scores into the chunk and out of it."""
        scores = (before[:, None] + self.move).max(0) + self.emissions[0]
        back = []
        for e in self.emissions[1:]:
            step = scores[:, None] + self.move
            back.append(step.argmax(0))
            scores = step.max(0) + e
        states = [int((scores + after).argmax())]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return states[::-1]


def _chunks(turns: DataFrame, conv_id: str, turn: str, text: str, speaker: str | None, chunk_rows: int) -> DataFrame:
    """The rows in order, CHUNK_ROWS or CHUNK_CHARS at most to a chunk; chunks are numbered in order."""
    label = F.col(f"`{speaker}`").cast("string") if speaker else F.lit(None).cast("string")
    rows = turns.select(F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), label.alias("label"), F.col(f"`{text}`").cast("string").alias("text"))
    order = [F.col("conv"), F.col("turn"), F.col("label"), F.xxhash64("text")]
    schema = pa.schema([("conv", pa.int64()), ("chunk", pa.int64()), ("turns", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block_ids()
        held: list[tuple] = []
        conv, chars = None, 0

        def chunk() -> pa.RecordBatch:
            turns, labels, texts = ([list(c)] for c in zip(*held, strict=True))
            return row_batch(schema, conv=[conv], chunk=[next(numbers)], turns=turns, labels=labels, texts=texts)

        for batch in batches:
            for c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                size = len(row[2] or "")
                if held and (c != conv or len(held) >= chunk_rows or chars + size > CHUNK_CHARS):
                    yield chunk()
                    held, chars = [], 0
                conv = c
                held.append(tuple(row))
                chars += size
        if held:
            yield chunk()

    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(gather, CHUNKS), "chunks")


def fit(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", text: str = "text", speaker: str = "role") -> Model:
    """Fits the model to all rows whose label names a role; rows with a null or unknown label part the sequence of
    roles. Counted on the executors. Null texts are one empty line; rows that repeat count each; rows with a null
    conv_id are one conversation; without labels or rows the defaults remain. Of a conversation over several chunks
    the steps from chunk to chunk are not counted."""
    chunks = _chunks(turns, conv_id, turn, text, speaker, CHUNK_ROWS)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for labels, texts in zip(batch.column("labels").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                last = None
                for k, (label, text) in enumerate(zip(labels, texts, strict=True)):
                    role = ROLE_OF.get((label or "").strip().lower())
                    if role:
                        seen["roles", role, ""] += 1
                        if k == 0:
                            seen["first", role, ""] += 1
                        elif last:
                            seen["follows", last, role] += 1
                        for line in (text or "").split("\n"):
                            seen["lines", role, ""] += 1
                            seen["lengths", role, str(_length(line))] += 1
                            seen["ends", role, str(_end(line))] += 1
                    last = role
        if seen:
            kinds, first, second = zip(*seen, strict=True)
            yield row_batch(pa.schema([("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]), kind=kinds, a=first, b=second, n=list(seen.values()))

    counts: dict[str, Counter] = {k: Counter() for k in ("roles", "follows", "first", "lengths", "ends", "lines")}
    for r in chunks.select("labels", "texts").mapInArrow(count, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        key = r.a if r.b == "" else (r.a, int(r.b) if r.kind in ("lengths", "ends") else r.b)
        counts[r.kind][key] = r.n
    return Model(**counts)


def _swept(matrices: DataFrame, start: np.ndarray, forward: bool) -> DataFrame:
    """conv, chunk and the best scores into each chunk (forward) or out of it, of matrices that stream in order."""
    name = "before" if forward else "after"
    order = [F.col("conv"), F.col("chunk") if forward else F.desc("chunk")]
    schema = pa.schema([("conv", pa.int64()), ("chunk", pa.int64()), (name, pa.list_(pa.float64()))])

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, scores = (), start
        for batch in batches:
            out = []
            for conv, m in zip(batch.column("conv").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                if (conv,) != last:
                    last, scores = (conv,), start
                out.append(scores.tolist())
                m = np.array(m).reshape(STATES, STATES)
                scores = (scores[:, None] + m).max(0) if forward else (m + scores[None]).max(1)
            if out:
                yield row_batch(schema, conv=batch.column("conv"), chunk=batch.column("chunk"), **{name: out})

    return matrices.repartition("conv").sortWithinPartitions(*order).mapInArrow(sweep, f"conv long, chunk long, {name} array<double>")


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", text: str = "text", speaker: str | None = "role", model: Model | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Returns one row per recovered turn: conv_id, turn (of the row that it opens in), part (its number there, from
    0), role, text and rendered (as ChatML). The result does not depend on chunk_rows.

    speaker: a column with labels, which count as markers and may be null, unknown or wrong; None: text alone. Rows
    are ordered by turn, label and a hash of the text; null turns come first, rows with a null conv_id are one
    conversation, rows that repeat are lines of their own. Null or empty texts are one empty line, long ones are read
    whole. Lines that go on with the turn of an earlier row join its text. No rows give no rows. Other columns are
    ignored, whatever their names."""
    spark = turns.sparkSession
    shared = spark.sparkContext.broadcast(model or Model())
    chunks = _chunks(turns, conv_id, turn, text, speaker, chunk_rows)
    long = chunks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv").alias("c"))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", pa.int64()), ("chunk", pa.int64()), ("matrix", pa.list_(pa.float64()))])
        for r in one_by_one(batches):
            matrix = Chunk(r["labels"], r["texts"], shared.value).matrix()
            yield row_batch(schema, conv=[r["conv"]], chunk=[r["chunk"]], matrix=[matrix.ravel().tolist()])

    parts = chunks.join(long, F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    matrices = written(parts.mapInArrow(measure, "conv long, chunk long, matrix array<double>"), "matrices")
    before, after = _swept(matrices, shared.value.begin, True), _swept(matrices, np.zeros(STATES), False).drop("conv")
    edges = written(before.join(after, "chunk").drop("conv"), "edges")

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("number", pa.int32()), ("goes_on", pa.bool_()), ("border", pa.bool_()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("text", pa.string())])
        model = shared.value
        for r in one_by_one(batches):
            chunk, alone = Chunk(r["labels"], r["texts"], model), r["before"] is None
            states = chunk.decode(model.begin if alone else np.array(r["before"]), np.zeros(STATES) if alone else np.array(r["after"]))
            part, at, open_ = 0, -1, []
            for state, (k, line, rest, marker) in zip(states, chunk.lines, strict=True):
                line = rest if state == marker else line
                if state < 3:
                    part = part + 1 if k == at else 0
                    at = k
                    open_.append((r["turns"][k], part, ROLES[state], [line], False))
                elif not open_:
                    open_.append((None, 0, ROLES[state - 3], [line], True))
                else:
                    open_[-1][3].append(line)
            turns, numbers, roles, lines, goes_on = zip(*open_, strict=True)
            n = len(open_)
            border = [not alone and (k == n - 1 or goes_on[k]) for k in range(n)]
            yield row_batch(schema, conv_id=[r["conv"]] * n, chunk=[r["chunk"]] * n, number=range(n), goes_on=goes_on, border=border, turn=turns, part=numbers, role=roles, text=["\n".join(x) for x in lines])

    pieces = chunks.join(edges, "chunk", "left").select("conv", "chunk", "turns", "labels", "texts", "before", "after").mapInArrow(parse, PIECES)
    if not edges.isEmpty():
        # a chunk's last turn and the lines that go on with it in the next chunks are one
        pieces = written(pieces, "pieces")
        running = Window.partitionBy("conv_id").orderBy("chunk", "number")
        crossing = pieces.where("border").withColumn("opening", F.sum((~F.col("goes_on")).cast("int")).over(running.rowsBetween(Window.unboundedPreceding, 0)))
        listed = F.sort_array(F.collect_list(F.struct("chunk", "number", "turn", "part", "role", "text")))
        whole = crossing.groupBy("conv_id", "opening").agg(listed.alias("p")).select("conv_id", *(F.col("p")[0][c].alias(c) for c in ("turn", "part", "role")), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
        pieces = pieces.where("not border").select("conv_id", "turn", "part", "role", "text").unionByName(whole)
    body = pieces.select("conv_id", "turn", "part", "role", F.btrim("text", F.lit("\n")).alias("text"))
    return body.withColumn("rendered", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>")))
