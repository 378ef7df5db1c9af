"""Ids of texts by their words: a worker's memory of words, looked up in arrays.

A text is cut into units that a tokenizer encodes apart. Units repeat, so each is encoded once and remembered by a
64-bit hash; the ids of a text are gathered from those of its units without a Python object a word. Among a million
units two coincide with a chance of 1e-7.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import hashing

#: Units that a tokenizer is given as one text.
JOINED = 2_000


def gathered(pool: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pool[b : b + n] for each b and n, joined, and where each begins (one more at the end)."""
    upto = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=upto[1:])
    return pool[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])], upto


class WordIds:
    """encode: ids of each of some texts; width: bytes of text that each id stands for; most: units remembered, beyond which the memory starts afresh."""

    def __init__(self, encode: Callable[[list[str]], list], width: np.ndarray, most: int):
        self._encode, self.width, self.most = encode, width, most
        self.forget()

    def forget(self) -> None:
        self.keys, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def plain(self, units: list[bytes]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self._encode([u.decode("utf-8", "replace") for u in units])] if units else []

    def _ids(self, units: list[bytes], joinable: np.ndarray) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Numbers of units, in the order of what follows: their counts of ids, and their ids.

        Joinable ones are encoded many at a time and parted by the bytes that their ids stand for.
        """
        order, counts, flat, rest = [], [], [], np.flatnonzero(~joinable).tolist()
        joined = np.flatnonzero(joinable).tolist()
        for some in (joined[i : i + JOINED] for i in range(0, len(joined), JOINED)):
            own = [units[i] for i in some]
            ids = self.plain([b"".join(own)])[0]
            bytes_to, ends = np.cumsum(self.width[ids]), np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            at = np.minimum(np.searchsorted(bytes_to, ends), len(ids) - 1)
            if at[-1] + 1 == len(ids) and (bytes_to[at] == ends).all():
                order += some
                counts.append(np.diff(at, prepend=-1))
                flat.append(ids)
            else:
                rest += some
        alone = self.plain([units[i] for i in rest])
        return order + rest, [*counts, np.fromiter(map(len, alone), np.int64, len(alone))], flat + alone

    def _learn(self, keys: np.ndarray, units: list[bytes], joinable: np.ndarray) -> None:
        """Remember units by their keys, which ascend and are new; they are put in their places, one array after another."""
        order, counts, ids = self._ids(units, joinable)
        count, flat = np.concatenate(counts), np.concatenate(ids)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(self.used // 2, len(flat)) + (1 << 16), np.uint32)])
        begin = self.used + np.cumsum(count) - count
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        order, at = np.argsort(order), np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.begin = np.insert(self.begin, at, begin[order])
        self.count = np.insert(self.count, at, count[order])

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of keys stands among the known units, and whether it does."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def encode(self, data: np.ndarray, starts: np.ndarray, joinable: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of data, whose units begin at starts, and where those of each text begin (one more at the end); at: where texts begin, each with a unit."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        ends = np.append(starts[1:], len(data))
        keys, first, place = np.unique(hashing.span_hashes(data, starts, ends, False), return_index=True, return_inverse=True)
        known, found = self._known(keys)
        if not found.all():
            if len(self.keys) + int((~found).sum()) > self.most:
                self.forget()
                found[:] = False
            new = first[~found]
            raw = data.tobytes()
            self._learn(keys[~found], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], joinable[new])
            known, _ = self._known(keys)
        ids, upto = gathered(self.pool, self.begin[known][place], self.count[known][place])
        return ids, upto[np.searchsorted(starts, at)]
