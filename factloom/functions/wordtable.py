"""Words of a large dictionary found in texts by their hashes: some 30 bytes a word, whatever its length.

A word is known by 128 bits: two sums of its signs, each sign mixed and weighted by a power of an odd number, modulo 2^64. Sums over a
text's beginnings give those of any of its parts in one step. A bit table of fixed size says which beginnings may go on to a word
and which may be one; it only saves work, as what it lets through is looked up by all of its bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

from factloom.functions.automaton import ranges, signs

#: Places of the bit table, as a power of two; each has a bit for a word's beginning and one for a word.
TABLE_BITS = 27
#: Odd numbers whose powers weight signs, and what is added to signs before they are mixed.
_BASES, _SALTS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F), (0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Sums:
    """Hashes of all parts of a sequence of signs."""

    def __init__(self, text: np.ndarray, which: int):
        weighted = _mixed(text.astype(np.uint64) + np.uint64(_SALTS[which])) * _powers(_BASES[which], len(text))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])
        self.back = _powers(pow(_BASES[which], -1, 1 << 64), len(text) + 1)

    def of(self, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[begin + length] - self.sums[begin]) * self.back[begin]


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).view(np.int64)


class WordTable:
    """Finds every occurrence of every word. lengths: those that words have. chunks: the words and their gains, each word once."""

    def __init__(self, lengths: Iterable[int], chunks: Iterable[tuple[Sequence[str], np.ndarray]]):
        self.lengths = sorted(lengths)
        self.bits = np.zeros(1 << TABLE_BITS - 2, np.uint8)
        self.alone: list[int] = []  # signs that are words
        first, second, gains = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0)]
        for words, gain in chunks:
            size = np.array([len(w) for w in words], np.int64)
            text, begin = signs("".join(words)), np.cumsum(size) - size
            sums = _Sums(text, 0)
            self.alone += text[begin[size == 1]].tolist()
            first.append(sums.of(begin, size))
            second.append(_Sums(text, 1).of(begin, size))
            gains.append(gain)
            flags = np.zeros(1 << TABLE_BITS, np.uint8)
            for n in self.lengths:
                flags[_slot(sums.of(begin[size >= n], n))] = 1
            flags[_slot(first[-1])] = 3  # a word is a beginning too
            for k in range(4):
                self.bits |= flags[k::4] << 2 * k
        self.first, self.second, self.gain = (np.concatenate(x) for x in (first, second, gains))
        order = np.argsort(self.first)
        self.first, self.second, self.gain = self.first[order], self.second[order], self.gain[order]
        # Where keys with equal beginnings start.
        self.shift = np.uint64(64 - min(max(len(order).bit_length(), 1), 26))
        self.at = np.searchsorted(self.first, np.arange(1 << 64 - int(self.shift), dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, size, gain) of every word within the runs (start in the text, length), by falling size; end is behind the last sign."""
        room = np.zeros(len(text), np.int64)
        begin = ranges(start, length)
        room[begin] = np.repeat(start + length, length) - begin
        sums = _Sums(text, 0)
        found = []
        for n in self.lengths:
            begin = begin[: np.searchsorted(begin, len(text) - n, side="right")]
            if not len(begin):
                break
            key = sums.of(begin, n)
            slot = _slot(key)
            bits = self.bits[slot >> 2] >> ((slot & 3) << 1).astype(np.uint8)
            on = np.flatnonzero(bits & 1)
            begin = begin[on]
            may = np.flatnonzero(bits[on] & 2)
            may = may[room[begin[may]] >= n]
            found.append((begin[may], np.full(len(may), n), key[on[may]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        begin, size, key = (np.concatenate(x) for x in zip(*found[::-1], strict=True))
        row = self._rows(key, _Sums(text, 1).of(begin, size))
        known = row >= 0
        return (begin + size)[known], size[known], self.gain[row[known]]

    def _rows(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The words' rows, -1 where there is no such word."""
        out, at = np.full(len(first), -1), self.at[(first >> self.shift).astype(np.int64)].astype(np.int64)
        still = np.flatnonzero(at < len(self.first))
        while len(still):
            key, here = self.first[at[still]], at[still]
            same = (key == first[still]) & (self.second[here] == second[still])
            out[still[same]] = here[same]
            still = still[~same & (key <= first[still])]
            at[still] += 1
            still = still[at[still] < len(self.first)]
        return out
