"""Vectorised tokens: positions and 64-bit fingerprints of every token of a batch of texts at once, in numpy.

A text's bytes are summed as a polynomial modulo 2**64 with an odd, so invertible, base; a token's
fingerprint is the difference of two prefix sums, shifted back to position 0 and mixed. There is no
Python work per token.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

#: Byte classes: 0 white space (blank, 9 to 13), 1 letters and bytes over 127, 2 digits, 3 the rest.
CLASSES = np.full(256, 3, dtype=np.uint8)
CLASSES[[32, 9, 10, 11, 12, 13]] = 0
CLASSES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASSES[48:58] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are summed in one go: the tables of powers and all temporaries of a stretch stay in cache.
STRETCH = 1 << 16

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those of a stretch are kept, longer ones (of a longer token) are not."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, STRETCH), base, dtype=np.uint64)
        factors[0] = 1
        have = np.cumprod(factors)
        if n <= STRETCH:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads fingerprints over all 64 bits; one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@dataclass
class Tokens:
    """Tokens of texts laid end to end: fingerprint, text number and byte range in data; bounds[i] is text i's first token."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    mark: np.ndarray
    bounds: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def tokens(texts: list[str | None], by_class: bool = False) -> Tokens:
    """White-space separated tokens, A-Z lower-cased; by_class also divides words, digits and other signs."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    classes = CLASSES[data]
    if not by_class:
        classes = (classes > 0).view(np.uint8)
    edge = np.flatnonzero(np.diff(classes, prepend=0, append=0))
    # every edge opens a run; those of white space are dropped
    start, end = edge[:-1], edge[1:]
    if len(edge):
        real = classes[start] > 0
        start, end = start[real], end[real]
    mark = np.empty(len(start), dtype=np.uint64)
    first = 0
    while first < len(start):  # a stretch of whole tokens at a time
        last = max(first + 1, int(np.searchsorted(end, start[first] + STRETCH, side="right")))
        at = start[first]
        n = int(end[last - 1] - at)
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((LOWER[data[at : at + n]].astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
        mark[first:last] = mix((sums[end[first:last] - at] - sums[start[first:last] - at]) * powers(INVERSE, n)[start[first:last] - at])
        first = last
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)])
    return Tokens(data, start, end, mark, np.searchsorted(start, begins))


def blocks(texts: list, size: int = 1 << 19) -> list[tuple[int, int]]:
    """Ranges of texts of about size characters; a longer text is a range of its own."""
    out, begin, held = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > size:
            out.append((begin, i))
            begin, held = i, 0
        held += n + 1
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out
