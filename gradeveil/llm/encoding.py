"""Token ids of whole texts by a public vocabulary.

The vocabulary's normaliser and pre-tokenizer never join what ASCII blanks separate, lower-case all letters and
part a word from full stops and commas behind it. So a text's ids are the ids of its lower-cased, parted words one
after another: each batch encodes the distinct words that are not in the worker's table yet, and numpy gathers
the rest. A vocabulary of another kind encodes whole texts.
"""

from __future__ import annotations

import json
import os
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gradeveil.llm.common import ragged, words_of

#: Words in the younger half of a worker's table; when it is full it becomes the older half, and that is dropped.
TABLE_WORDS = 300_000
#: Full stops and commas between an (ASCII or Latin-1) letter or digit and a blank or the end.
PARTED = r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([.,]+)([\x20\x09-\x0D]|$)"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    _of_worker: dict[str, WordEncoder] = {}

    @classmethod
    def of_worker(cls, path: str) -> WordEncoder:
        """The encoder of this Python worker, which goes on from task to task."""
        if path not in cls._of_worker:
            cls._of_worker[path] = cls(path)
        return cls._of_worker[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        described = json.loads(self.tokenizer.to_str())
        first = (described["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.by_word = "Lowercase" in json.dumps(described["normalizer"]) and first.get("behavior") == "Removed" and first.get("invert") is True
        # a word's ids as bytes, which take a third of the room of a tuple
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _look_up(self, words: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        new = []
        for w in words:
            if w not in young:
                if (ids := old.get(w)) is not None:
                    young[w] = ids
                else:
                    new.append(w)
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            young.update(zip(part, [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)], strict=True))
        out = [young[w] for w in words]
        if len(young) > TABLE_WORDS:
            self.old, self.young = young, {}
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and each text's number of ids. A null text has none."""
        if not self.by_word:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum())), counts
        codes, words, counts = words_of(pc.replace_substring_regex(pc.ascii_lower(texts), PARTED, r"\1 \2\3"))
        lists = self._look_up(words)
        flat = np.frombuffer(b"".join(lists), self.code)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // flat.itemsize
        starts = np.cumsum(sizes) - sizes
        per_word = sizes[codes]
        ids = flat[ragged(starts[codes], per_word)].astype(np.uint32)
        edges = np.concatenate([[0], np.cumsum(per_word)])
        ends = np.cumsum(counts)
        return ids, edges[ends] - edges[ends - counts]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends the id `end` to every text."""
    ends = np.cumsum(counts)
    out = np.full(len(ids) + len(counts), end, np.uint32)
    out[ragged(ends - counts + np.arange(len(counts)), counts)] = ids
    return out, counts + 1
