"""Benchmark decontamination by template canonicalisation.

Texts become templates: words lose their case and outer punctuation; numbers, names (title case inside a
sentence) and units become typed placeholders, whose values are kept as slots. Windows of template tokens of the
documents are looked up by hash in those of the benchmark. Hits on one diagonal (same item, same shift) are one
alignment; it counts if its slots are consistent: an item's value stands for one value of the document wherever it
occurs. So a question with other numbers and names is caught, and two texts that merely share a pattern are not.
Places that break the consistency are left out, and the windows without them are judged alone.
Windows are looked up with names spelled out too, so that a copy in other letter case is found, and windows dense in
numbers and units by their values, so that word for word copies of sums, tables and series are found.

The benchmark is a query set: its index goes to every task in blocks of at most BLOCK_WORDS words, one after
another, however many there are. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeveil.llm.common import hashed, pieces_for, ragged, rolling, rows_in, words_of

#: Words of the benchmark whose index one task holds at a time (about 40 bytes each).
BLOCK_WORDS = 1_000_000
#: Bytes of text that are turned into templates at a time.
PART_BYTES = 2 << 20
#: Windows shared by texts and items that are laid out at a time.
MAX_HITS = 1_000_000
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: How windows are looked up: with all placeholders, with names as words, and with all values.
TYPED, PLAIN, EXACT = 0, 1, 2
NUMBER_WORDS = pa.array("two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice double triple dozen".split())
UNITS = pa.array(
    "mm cm km mg kg lb lbs oz ml kb mb gb hz khz mhz kw kwh mph kph inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros rupee rupees yen percent degree degrees".split()
)


class Templates:
    """Template tokens of texts: their hashes, kinds and values, and the text of each."""

    def __init__(self, texts: pa.Array):
        codes, words, counts = words_of(texts)
        raw = pa.array(words, pa.string())
        core = pc.replace_substring_regex(raw, r"^[^\pL\pN]+|[^\pL\pN]+$", "")
        lower = pc.utf8_lower(core)
        number = pc.or_(pc.match_substring_regex(core, r"^[0-9][0-9.,:/%-]*$"), pc.is_in(lower, NUMBER_WORDS))
        unit = pc.or_(pc.is_in(lower, UNITS), pc.match_substring_regex(core, r"^[0-9][0-9.,]*\pL{1,3}$"))
        kind = np.where(np.asarray(number), NUMBER, np.where(np.asarray(unit), UNIT, LITERAL)).astype(np.int8) if len(words) else np.zeros(0, np.int8)
        title = np.asarray(pc.match_substring_regex(core, r"^\p{Lu}\p{Ll}+$")) if len(words) else np.zeros(0, bool)
        ends = np.asarray(pc.match_substring_regex(raw, r"[.!?:][^\pL\pN]*$")) if len(words) else np.zeros(0, bool)
        value = hashed(lower.to_pylist(), len(words))
        empty = np.asarray(pc.equal(core, "")) if len(words) else np.zeros(0, bool)
        row = np.repeat(np.arange(len(counts)), counts)
        begins = np.ones(len(codes), bool)  # of a sentence
        begins[1:] = ends[codes[:-1]] | (row[1:] != row[:-1])
        stay = ~empty[codes]
        codes, begins = codes[stay], begins[stay]
        self.row = row[stay]
        self.kind = np.where((kind[codes] == LITERAL) & title[codes] & ~begins, NAME, kind[codes])
        self.value = value[codes]
        # a token's template with names as placeholders, and with names spelled out
        self.typed = np.where(self.kind == LITERAL, self.value, self.kind.astype(np.uint64))
        self.plain = np.where((self.kind == LITERAL) | (self.kind == NAME), self.value, self.kind.astype(np.uint64))
        self.counts = np.bincount(self.row, minlength=len(counts))
        self.starts = np.cumsum(self.counts) - self.counts

    def windows(self, size: int, mode: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of `size` tokens of one text. TYPED and PLAIN: those of which at least half
        of the tokens are literal; TYPED only with names, as placeholders, PLAIN with names as words, so that the case
        of a copy is no matter. EXACT: all that are no PLAIN ones, having too many numbers and units, by their values."""
        hashes = rolling((self.typed, self.plain, self.value)[mode], size)
        if not len(hashes):
            return np.zeros(0, np.int64), hashes
        named = np.append(0, np.cumsum(self.kind == NAME))
        other = np.append(0, np.cumsum((self.kind == NUMBER) | (self.kind == UNIT)))
        slots, names = other[size:] - other[:-size], named[size:] - named[:-size]
        good = self.row[: len(hashes)] == self.row[size - 1 :]
        good &= ((names > 0) & (2 * (slots + names) <= size), 2 * slots <= size, 2 * slots > size)[mode]
        at = np.flatnonzero(good)
        return at, hashes[at]


class Index:
    """Windows of one block of the benchmark. Items of fewer tokens than `window` are one window of their own."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.tokens = Templates(pa.array([t for _, t in items], pa.string()))
        self.tables = {}
        sizes = {window, *(int(n) for n in np.unique(self.tokens.counts) if 0 < n < window)}
        for size in sorted(sizes):
            for mode in (TYPED, PLAIN, EXACT):
                at, hashes = self.tokens.windows(size, mode)
                if size < window:  # whole items of this size
                    whole = self.tokens.counts[self.tokens.row[at]] == size
                    at, hashes = at[whole], hashes[whole]
                order = np.argsort(hashes, kind="stable")
                if len(at):
                    self.tables[size, mode] = (hashes[order], at[order])

    def hits(self, texts: Templates) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position in the texts, position in the items, size) of each window that is in both, in parts of whole texts
        with MAX_HITS at most (or one text): a template that very many items share takes time, but no more memory."""
        found = [np.zeros((4, 0), np.int64)]
        tables = list(self.tables.items())
        for number, ((size, mode), (hashes, _)) in enumerate(tables):
            at, h = texts.windows(size, mode)
            first = np.searchsorted(hashes, h, "left")
            n = np.searchsorted(hashes, h, "right") - first
            hit = np.flatnonzero(n)
            found.append(np.stack([np.full(len(hit), number), at[hit], first[hit], n[hit]]))
        number, at, first, n = np.concatenate(found, axis=1)
        order = np.argsort(texts.row[at], kind="stable")
        number, at, first, n = number[order], at[order], first[order], n[order]
        row = texts.row[at]
        begins = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
        sums = np.add.reduceat(n, begins) if len(begins) else begins
        part = (np.cumsum(sums) - sums) // MAX_HITS
        edges = [*begins[np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])], len(row)]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            out = [np.zeros((3, 0), np.int64)]
            for k, ((size, _), (_, places)) in enumerate(tables):
                some = begin + np.flatnonzero(number[begin:end] == k)
                item = places[ragged(first[some], n[some])]
                out.append(np.stack([np.repeat(at[some], n[some]), item, np.full(len(item), size)]))
            yield tuple(np.concatenate(out, axis=1))

    def leaks(self, texts: Templates, min_cover: float, min_tokens: int) -> dict[int, dict[int, float]]:
        """Per text: the items of which consistent alignments cover at least min_cover or min_tokens tokens, and how
        much."""
        out: dict[int, dict[int, float]] = {}
        for hits in self.hits(texts):
            self._judge(texts, hits, min_cover, min_tokens, out)
        return out

    def _judge(self, texts: Templates, hits: tuple[np.ndarray, ...], min_cover: float, min_tokens: int, out: dict[int, dict[int, float]]) -> None:
        at, item_at, size = hits
        own = self.tokens
        order = np.lexsort((at, at - item_at, own.row[item_at], texts.row[at]))
        at, item_at, size = at[order], item_at[order], size[order]
        doc, item, shift = texts.row[at], own.row[item_at], at - item_at
        new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]))[: len(at)]
        begins = np.flatnonzero(new)
        for begin, end in zip(begins, np.append(begins[1:], len(at)), strict=False):
            places = np.unique(ragged(item_at[begin:end], size[begin:end]))
            cover = len(places) / own.counts[item[begin]]
            if cover < min_cover and len(places) < min_tokens:
                continue
            slots = places[own.kind[places] != LITERAL]
            theirs = texts.value[slots + shift[begin]]
            pairs, where, pair, n = np.unique(np.stack([own.value[slots], theirs]), axis=1, return_index=True, return_inverse=True, return_counts=True)
            if len(np.unique(pairs[0])) < pairs.shape[1]:  # one value of the item stands for two of the document
                # what is left where all values are equal, or where each has its most frequent partner (of equals itself, then the first)
                order = np.lexsort((where, pairs[0] != pairs[1], -n, pairs[0]))
                main = np.zeros(len(n), bool)
                main[order[np.append(True, pairs[0][order][1:] != pairs[0][order][:-1])]] = True
                odd = (slots[own.value[slots] != theirs], slots[~main[pair.ravel()]])
                places = max((_without(item_at[begin:end], size[begin:end], o) for o in odd), key=len)
                if len(places) < min_tokens:
                    continue
                cover = len(places) / own.counts[item[begin]]
            of_doc = out.setdefault(int(doc[begin]), {})
            key = int(self.ids[item[begin]])
            of_doc[key] = max(of_doc.get(key, 0.0), cover)


def _without(at: np.ndarray, size: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The places of the windows that hold none of the odd ones (ascending)."""
    clean = np.searchsorted(odd, at) == np.searchsorted(odd, at + size)
    return np.unique(ragged(at[clean], size[clean]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = 8, min_cover: float = 0.5, min_tokens: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, all columns kept, with item_ids (array of long, ascending: the benchmark items that the text has),
    cover (double: the largest share of such an item's tokens) and contaminated (boolean).

    An item counts if one consistent alignment covers at least min_cover of its tokens, or min_tokens of them, in
    windows of `window` tokens, at least half of them literal or all with equal values; of an inconsistent alignment
    the windows without the odd values must cover min_tokens. A shorter item must occur as a whole, though it be one
    number. Null or empty texts and items without words have and give no leak, long texts are read whole; items with a
    null id are skipped, those with one id are one item; repeated rows are judged alike, there are no ties to break; no
    rows give no rows, no items no leaks. Own columns with the names of the added ones are replaced."""
    bench = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("i is not null and t is not null").distinct()
    total = bench.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    blocks = pieces_for(total, BLOCK_WORDS)
    rest = [c for c in docs.columns if c.lower() not in ("item_ids", "cover", "contaminated")]
    # a text that is a string already travels once
    held = [c for c in rest if c != text or dict(docs.dtypes)[c] != "string"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in held), F.lit(0).alias("__none")).alias("__row"), F.col(f"`{text}`").cast("string").alias("__text"), F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("cover"))
    for block in range(blocks):
        items = sorted((r.i, r.t) for r in bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect())
        shared = docs.sparkSession.sparkContext.broadcast(items)
        rows = rows.mapInArrow(_scan(shared, window, min_cover, min_tokens), rows.schema)
    added = {"item_ids": F.array_sort(F.array_distinct("item_ids")), "cover": F.col("cover"), "contaminated": F.size("item_ids") > 0}
    return rows.select(*(F.col(f"__row.`{c}`").alias(c) if c in held else F.col("__text").alias(c) for c in rest), *(v.alias(c) for c, v in added.items()))


def _scan(shared, window: int, min_cover: float, min_tokens: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for table in rows_in(batches, "__text", PART_BYTES):
            index = index or Index(shared.value, window)
            leaks = index.leaks(Templates(table["__text"].combine_chunks()), min_cover, min_tokens)
            items, cover = table["item_ids"].to_pylist(), table["cover"].to_pylist()
            for row, found in leaks.items():
                items[row] = items[row] + list(found)
                cover[row] = max(cover[row], *found.values())
            table = table.set_column(2, table.schema.field("item_ids"), pa.array(items, table.schema.field("item_ids").type))
            table = table.set_column(3, table.schema.field("cover"), pa.array(cover, pa.float64()))
            yield from table.combine_chunks().to_batches(max_chunksize=10_000)

    return run
