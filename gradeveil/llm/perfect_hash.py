"""A minimal perfect hash over distinct 64-bit keys: levels of bit arrays, each holding the keys that no other
key of that level hits, and a rank over all set bits. About 4 bits a key; built and probed with numpy."""

from __future__ import annotations

import numpy as np

from gradeveil.llm.common import mix

LEVELS = 24


class PerfectHash:
    def __init__(self, keys: np.ndarray, gamma: float = 2.0):
        """keys: distinct, unsigned 64-bit."""
        self.levels: list[np.ndarray] = []
        self.offsets: list[int] = []
        self.n = 0
        left = keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(gamma * len(left)))
            at = self._place(left, level, size)
            hits = np.bincount(at, minlength=size)
            self.levels.append(np.concatenate([[0], np.cumsum(hits == 1)]).astype(np.int32))
            self.offsets.append(self.n)
            self.n += int(self.levels[-1][-1])
            left = left[hits[at] != 1]
        #: keys that collided on every level: hardly ever any
        self.rest = {int(k): self.n + i for i, k in enumerate(left)}
        self.n += len(self.rest)

    def arrays(self) -> list[np.ndarray]:
        """The levels' sizes and bits, and the rest."""
        bits = [np.packbits(np.diff(ranks) == 1) for ranks in self.levels]
        return [np.array([len(r) - 1 for r in self.levels], np.int32), np.concatenate([np.zeros(0, np.uint8), *bits]), np.array(list(self.rest), np.uint64)]

    @classmethod
    def of_arrays(cls, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray) -> PerfectHash:
        out, at = cls(np.zeros(0, np.uint64)), 0
        for size in sizes.tolist():
            ones = np.unpackbits(bits[at : at + -(-size // 8)], count=size)
            out.levels.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.int32))
            out.offsets.append(out.n)
            out.n += int(out.levels[-1][-1])
            at += -(-size // 8)
        out.rest = {int(k): out.n + i for i, k in enumerate(rest)}
        out.n += len(out.rest)
        return out

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return ((mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot from 0 to n-1. A key that was not built in gets any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (ranks, offset) in enumerate(zip(self.levels, self.offsets, strict=True)):
            at = self._place(keys[open_], level, len(ranks) - 1)
            found = ranks[at + 1] > ranks[at]
            out[open_[found]] = offset + ranks[at[found]]
            open_ = open_[~found]
            if not len(open_):
                return out
        for i in open_:
            out[i] = self.rest.get(int(keys[i]), -1)
        return out


class LineCounts:
    """Counts and greatest holder of each distinct key in arrays that a perfect hash indexes; a fingerprint in
    each slot turns away foreign keys."""

    def __init__(self, distinct: np.ndarray):
        self.slot_of = PerfectHash(distinct)
        self.fingerprints = np.zeros(self.slot_of.n, np.uint32)
        self.fingerprints[self.slot_of(distinct)] = self._fingerprint(distinct)
        self.counts = np.zeros(self.slot_of.n, np.int64)
        self.last = np.full(self.slot_of.n, np.iinfo(np.int64).min)

    @staticmethod
    def _fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(16)).astype(np.uint32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that were not built in (but for one foreign key in 2**32)."""
        at = self.slot_of(keys)
        return np.where((at >= 0) & (self.fingerprints[at] == self._fingerprint(keys)), at, -1)

    def add(self, keys: np.ndarray, counts: np.ndarray, last: np.ndarray) -> None:
        """keys: distinct within one call."""
        at = self.slots(keys)
        self.counts[at] += counts
        self.last[at] = np.maximum(self.last[at], last)


class ShippedLines:
    """What a shard tells one block: a perfect hash over the block's keys that are to go, with a 16-bit fingerprint
    and the greatest holder in each slot. The shard has seen all keys that the block can ask for, so it takes a seed
    under which the fingerprints turn away every other one."""

    def __init__(self, slot_of: PerfectHash, seed: int, fingerprints: np.ndarray, last: np.ndarray):
        self.slot_of, self.seed, self.fingerprints, self.last = slot_of, seed, fingerprints, last

    @staticmethod
    def _fingerprint(keys: np.ndarray, seed: int) -> np.ndarray:
        return (mix(keys ^ np.uint64((seed + 1) * 0xA0761D6478BD642F % 2**64)) >> np.uint64(24)).astype(np.uint16)

    @classmethod
    def of(cls, keys: np.ndarray, last: np.ndarray, others: np.ndarray) -> ShippedLines:
        """keys, others: distinct, and no key among the others."""
        slot_of = PerfectHash(keys)
        at = slot_of(keys)
        ordered = np.empty(slot_of.n, np.int64)
        ordered[at] = last
        seed = 0
        while True:
            fingerprints = np.empty(slot_of.n, np.uint16)
            fingerprints[at] = cls._fingerprint(keys, seed)
            out = cls(slot_of, seed, fingerprints, ordered)
            if not out.probe(others)[0].any():
                return out
            seed += 1

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is one of those built in, and its greatest holder (of others: any number)."""
        at = self.slot_of(keys)
        return (at >= 0) & (self.fingerprints[at] == self._fingerprint(keys, self.seed)), self.last[at]

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.seed]), self.fingerprints, self.last, *self.slot_of.arrays()]

    @classmethod
    def of_arrays(cls, seed: np.ndarray, fingerprints: np.ndarray, last: np.ndarray, *slot_of: np.ndarray) -> ShippedLines:
        return cls(PerfectHash.of_arrays(*slot_of), int(seed[0]), fingerprints, last)
