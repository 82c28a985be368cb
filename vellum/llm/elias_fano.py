"""Elias-Fano sequences and a two-level n-gram trie over them, in memory-mapped files.

A monotone sequence keeps the low bits of each value packed and the high bits as gaps in a bit vector, with the
number of ones and zeros before each of its 64-bit words; a value or a gap is selected by bisecting those and then
the word, so nothing is expanded when a sequence is opened. The
trie has the contexts' fingerprints (level one, a sequence), the position of each context's
first successor (pointers, a sequence) and the successors (level two): the fingerprint of a successor behind
the number of its context, which makes the whole level one sequence. Beside each level lie its values:
counts, and smoothed probabilities quantised to 16 bits.

The file is in the worker's own temporary folder: it lives within one task, is unlinked as soon as it is mapped, and
a lost executor's tasks build it again.

Defined results: an empty sequence has no values, and its successor of anything is 0.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Bits of a successor's fingerprint.
CHILD_BITS = 40
#: Steps of the quantiser for each doubling, and the exponent of its least value.
STEPS, LEAST = 900, -40


def quantise(x: np.ndarray) -> np.ndarray:
    """16-bit codes of positive values, rounded down on a logarithmic scale; 0 stands for 0."""
    code = np.floor((np.log2(np.maximum(x, 2.0**LEAST)) - LEAST) * STEPS).astype(np.int64) + 1
    return np.where(x > 0, np.minimum(code, 65535), 0).astype(np.uint16)


def value_of(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, np.exp2((code.astype(np.float64) - 1) / STEPS + LEAST), 0.0)


class Mapped:
    """Arrays in one file that is mapped and at once unlinked: nothing stays on the worker's disk."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        fd, path = tempfile.mkstemp(prefix="trie-")
        try:
            places, at = {}, 0
            with os.fdopen(fd, "wb") as f:
                for name, a in arrays.items():
                    raw = np.ascontiguousarray(a).tobytes()
                    places[name] = (at, a.dtype, a.shape)
                    f.write(raw + b"\0" * (-len(raw) % 8))
                    at += len(raw) + -len(raw) % 8
                f.write(b"\0" * 8)
            self.raw = np.memmap(path, dtype=np.uint8, mode="r")
        finally:
            os.unlink(path)
        self.arrays = {
            name: self.raw[p : p + int(np.prod(shape)) * dtype.itemsize].view(dtype).reshape(shape) for name, (p, dtype, shape) in places.items()
        }

    def __getitem__(self, name: str) -> np.ndarray:
        return self.arrays[name]


def encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """The parts of a monotone uint64 sequence."""
    n = len(values)
    top = int(values[-1]) if n else 0
    width = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
    low = values & np.uint64((1 << width) - 1)
    bits = np.zeros(n * width, dtype=np.uint8)
    for b in range(width):
        bits[b::width] = (low >> np.uint64(b)) & np.uint64(1)
    high = (values >> np.uint64(width)).astype(np.int64)
    last = int(high[-1]) if n else 0
    upper = np.zeros(-(-(last + n + 2) // 64) * 64, dtype=np.uint8)
    upper[high + np.arange(n)] = 1
    words = np.packbits(upper, bitorder="little").view("<u8")
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1].astype(np.uint32)
    zeros = (64 * np.arange(len(words), dtype=np.int64) - ones).astype(np.uint32)
    low_bytes = np.concatenate([np.packbits(bits, bitorder="little"), np.zeros(8, dtype=np.uint8)])
    return {
        f"{name}.low": low_bytes, f"{name}.up": words, f"{name}.ones": ones, f"{name}.zeros": zeros,
        f"{name}.meta": np.array([n, width, last], dtype=np.int64),
    }


def nth_one(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the bit with this rank (from 0) among the ones of each 64-bit word, by halving."""
    word, rank, place = word.astype(np.uint64), rank.astype(np.int64), np.zeros(len(word), dtype=np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << width) - 1)
        have = np.bitwise_count(low).astype(np.int64)
        beyond = rank >= have
        word = np.where(beyond, word >> np.uint64(width), low)
        rank = rank - np.where(beyond, have, 0)
        place += np.where(beyond, width, 0)
    return place


class EliasFano:
    def __init__(self, parts: Mapped, name: str) -> None:
        self.n, self.width, self.last = (int(x) for x in parts[f"{name}.meta"])
        self.low, self.up, self.ones, self.zeros = (parts[f"{name}.{x}"] for x in ("low", "up", "ones", "zeros"))

    def selected(self, rank: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """The place in the upper bits of the one (or zero) of each rank; before: how many come ahead of each word."""
        at = np.searchsorted(before, rank.astype(before.dtype), side="right") - 1
        word = self.up[at]
        return 64 * at + nth_one(~word if flip else word, rank - before[at].astype(np.int64))

    def below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part: what precedes the gap before it."""
        out = np.full(len(high), self.n, dtype=np.int64)
        out[high <= 0] = 0
        some = np.flatnonzero((high > 0) & (high <= self.last + 1))
        if len(some):
            rank = high[some] - 1
            out[some] = self.selected(rank, self.zeros, True) - rank
        return out

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), dtype=np.uint64)
        bit = at.astype(np.int64) * self.width
        words = np.ndarray((len(self.low) - 7,), dtype="<u8", buffer=self.low, strides=(1,))
        return (words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, dtype=np.int64)
        if not len(at):
            return np.zeros(0, dtype=np.uint64)
        high = self.selected(at, self.ones, False) - at
        return (high.astype(np.uint64) << np.uint64(self.width)) | self.lows(at)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The position of the first value >= x (n if none): the gaps give the stretch of equal high parts, its low parts are bisected."""
        high = (x >> np.uint64(self.width)).astype(np.int64)
        low = x & np.uint64((1 << self.width) - 1) if self.width else np.zeros(len(x), dtype=np.uint64)
        lo, hi = self.below(high), self.below(high + 1)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            less = self.lows(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]


class Trie:
    """contexts: sorted fingerprints; first: where each one's successors begin; children: their keys; codes: their probabilities."""

    def __init__(self, contexts: np.ndarray, first: np.ndarray, children: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> None:
        parts = encode(contexts, "context") | encode(first.astype(np.uint64), "pointer") | encode(children, "child")
        self.parts = Mapped(parts | {"codes": codes, "counts": counts})
        self.context, self.pointer, self.child = (EliasFano(self.parts, name) for name in ("context", "pointer", "child"))

    def find(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each context or 0, whether it is there)."""
        at = self.context.successor(contexts)
        safe = np.minimum(at, max(self.context.n - 1, 0))
        there = (at < self.context.n) & (self.context.get(safe) == contexts) if self.context.n else np.zeros(len(contexts), dtype=bool)
        return np.where(there, safe, 0), there

    def code(self, number: np.ndarray, there: np.ndarray, child: np.ndarray) -> np.ndarray:
        """The codes of successors, searched from their context's pointer on."""
        out = np.zeros(len(child), dtype=np.uint16)
        if not self.child.n:
            return out
        key = (number.astype(np.uint64) << np.uint64(CHILD_BITS)) | child
        at = self.child.successor(key)
        end = self.pointer.get(np.minimum(number + 1, self.pointer.n - 1)).astype(np.int64)
        inside = there & (at >= self.pointer.get(number).astype(np.int64)) & (at < end)
        safe = np.where(inside, at, 0)
        hit = inside & (self.child.get(safe) == key)
        out[hit] = self.parts["codes"][safe[hit]]
        return out
