"""Vectorised hashing of words and word shingles, for use inside tasks.

Texts are UTF-8 encoded into one byte buffer per batch and hashed with numpy only, so the cost per
word is a few array passes and no Python object is made for it. White space is the ASCII set
``[\\x20\\x09-\\x0D]``; letters A-Z are lowered on request.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Text bytes hashed at once; one longer text makes a batch of its own and is hashed in pieces. A dozen arrays of eight
#: bytes for each are alive meanwhile, and a reused worker keeps the memory of its largest batch.
BATCH_BYTES = 1 << 18

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_A = np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_BLANKS = (9, 10, 11, 12, 13, 32)
_SPACE[list(_BLANKS)] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1); as many as a batch needs are kept between calls."""
    have = _powers.get(int(base))
    if have is None or n > len(have):
        seed = np.full(max(n, min(2 * n, 2 * BATCH_BYTES)), base, np.uint64)
        seed[0] = 1
        have = np.cumprod(seed, dtype=np.uint64)
        if n <= 2 * BATCH_BYTES:
            _powers[int(base)] = have
    return have[:n]


@dataclass
class Words:
    """The words of a batch of texts, in order: hash, text number, and the first word of each text."""

    hashes: np.ndarray
    text: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1


def batches(texts: list, limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts (None: empty) as UTF-8, with the number of the first; about limit bytes each."""
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if held and size + len(b) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield start, held


def pieces(part: bytes, limit: int = BATCH_BYTES) -> Iterator[bytes]:
    """part cut at blanks into pieces of at most limit bytes; a longer word stays whole."""
    start = 0
    while len(part) - start > limit:
        cut = max(part.rfind(bytes([b]), start + 1, start + limit) for b in _BLANKS)
        if cut < 0:
            cut = min((i for i in (part.find(bytes([b]), start + limit) for b in _BLANKS) if i >= 0), default=len(part))
        yield part[start:cut]
        start = cut
    yield part[start:]


def spans(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, where words start and end in them, and where each text starts (one more at the end)."""
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    word = ~_SPACE[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    return data, edge[0::2], edge[1::2], at


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes of data[start:end]."""
    terms = (_FOLDED if fold else _TABLE)[data]
    terms *= _power(_P, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    raw = (total[ends] - total[starts]) * _power(_P_INV, len(data) + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _A)


def words(parts: list[bytes], fold: bool = True) -> Words:
    if len(parts) == 1 and len(parts[0]) > BATCH_BYTES:
        found = []
        for piece in pieces(parts[0]):
            data, starts, ends, _ = spans([piece])
            found.append(span_hashes(data, starts, ends, fold))
        hashes = np.concatenate(found)
        return Words(hashes, np.zeros(len(hashes), np.int64), np.array([0, len(hashes)]))
    data, starts, ends, at = spans(parts)
    text = np.searchsorted(at, starts, "right") - 1
    first = np.searchsorted(text, np.arange(len(parts) + 1))
    return Words(span_hashes(data, starts, ends, fold), text, first)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and their bounds by text.

    A text of fewer words (one at least) has its whole sequence as its only shingle.
    """
    h = w.hashes
    count = np.diff(w.first)
    run = max(len(h) - n + 1, 0)
    acc = np.zeros(run, np.uint64)
    factor = np.uint64(1)
    for j in range(n):
        acc += h[j : j + run] * factor
        factor = np.uint64((int(factor) * int(_A)) & 0xFFFFFFFFFFFFFFFF)
    whole = w.text[:run] == w.text[n - 1 : n - 1 + run]
    made = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    first = np.zeros(len(w) + 1, np.int64)
    np.cumsum(made, out=first[1:])
    out = np.empty(first[-1], np.uint64)
    short = np.flatnonzero((count > 0) & (count < n))
    fill = np.ones(len(out), bool)
    fill[first[short]] = False
    out[fill] = mix(acc[whole])
    for i in short:
        own = h[w.first[i] : w.first[i + 1]]
        value = 0
        for x in own.tolist():
            value = ((value ^ x) * int(_A) + len(own)) & 0xFFFFFFFFFFFFFFFF
        out[first[i]] = mix(np.array([value], np.uint64))[0]
    return out, first


def shingle_sets(texts: list, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, its distinct shingle hashes in ascending order) for all texts."""
    for start, parts in batches(texts):
        values, first = shingles(words(parts), n)
        for i in range(len(parts)):
            yield start + i, np.unique(values[first[i] : first[i + 1]])
