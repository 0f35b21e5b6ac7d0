"""Many terms found in texts in one pass: an Aho-Corasick automaton in packed arrays, and best paths over what it finds.

A node stands for a beginning of a term. Its arrays hold the edges (sorted keys of node and sign), for each node the node
of its longest proper end that is a beginning too, the term that ends at it, and the next shorter such term. A slice of
texts is read in lanes of equal length side by side, each starting early enough to know what a term needs, so that
numpy takes one step for all lanes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Numbers of a table of all steps (node by sign), where an automaton is small enough for one; else steps are looked up among the edges.
TABLE_CELLS = 1 << 25
#: A sign that no text has; it stands between texts.
_BETWEEN = 0x1FFFFF
_SIGN_BITS = 21
LANE = 512
#: Terms in a row of a divider's tables.
WIDTH = 16


def signs(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., start[1], ...: ``length`` numbers each."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(int(length.sum()))


class Automaton:
    """Finds every occurrence of every term; terms are numbered as given, empty and repeated ones are not allowed."""

    def __init__(self, terms: Sequence[str]):
        self.length = np.array([len(t) for t in terms], np.int64)
        self.longest = int(self.length.max(initial=0))
        text, begin = signs("".join(terms)), np.cumsum(self.length) - self.length
        self.keys, self.target = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.back, self.term = np.zeros(1, np.int64), np.full(1, -1, np.int64)
        at = np.zeros(len(terms), np.int64)  # the node that each term has reached
        levels = []
        for depth in range(self.longest):
            on = np.flatnonzero(self.length > depth)
            keys, which = np.unique((at[on] << _SIGN_BITS) | text[begin[on] + depth], return_inverse=True)
            first = len(self.back)
            at[on] = first + which
            # A node's back is found from its parent's, over edges of smaller depth only.
            back = self.step(self.back[keys >> _SIGN_BITS], keys & (1 << _SIGN_BITS) - 1) if depth else np.zeros(len(keys), np.int64)
            term = np.full(len(keys), -1, np.int64)
            ends = on[self.length[on] == depth + 1]
            term[at[ends] - first] = ends
            self.back, self.term = np.concatenate([self.back, back]), np.concatenate([self.term, term])
            levels.append((first, first + len(keys)))
            # Nodes are numbered in the order of their keys, level by level, so keys stay sorted.
            self.keys, self.target = np.concatenate([self.keys, keys]), np.concatenate([self.target, first + np.arange(len(keys))])
        self.shorter = np.zeros(len(self.back), np.int64)  # the nearest node over back links with a term, or 0
        self.ends = (self.term >= 0).astype(np.int64)  # terms that end at a node, shorter ones included
        for first, last in levels:
            back = self.back[first:last]
            self.shorter[first:last] = np.where(self.term[back] >= 0, back, self.shorter[back])
            self.ends[first:last] += self.ends[self.shorter[first:last]]
        self.alphabet = np.unique(text)
        self.alone = text[begin[self.length == 1]].tolist()  # signs that are terms
        self.table = None
        width = len(self.alphabet) + 1  # the last column is any other sign
        if len(self.back) * width <= TABLE_CELLS:
            self.table = np.zeros((len(self.back), width), np.int32)
            parent, column = self.keys >> _SIGN_BITS, np.searchsorted(self.alphabet, self.keys & (1 << _SIGN_BITS) - 1)
            for first, last in [(0, 1), *levels]:  # a node steps as its back does, but for its own edges
                if first:
                    self.table[first:last] = self.table[self.back[first:last]]
                own = slice(*np.searchsorted(parent, (first, last)))
                self.table[parent[own], column[own]] = self.target[own]

    def step(self, node: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """The nodes after one more sign."""
        out = np.zeros(len(node), np.int64)
        still = np.arange(len(node))
        while len(still) and len(self.keys):
            key = (node[still] << _SIGN_BITS) | sign[still]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            out[still[found]] = self.target[at[found]]
            still = still[~found & (node[still] > 0)]
            node = node.copy()
            node[still] = self.back[node[still]]
        return out

    def nodes(self, text: np.ndarray) -> np.ndarray:
        """The node after each sign of a sequence."""
        if not self.longest or not len(text):
            return np.zeros(len(text), np.int32)
        before = self.longest - 1
        lanes = -(-len(text) // LANE)
        padded = np.full(before + lanes * LANE, _BETWEEN, np.int64)
        padded[before : before + len(text)] = text
        if self.table is not None:
            column = np.minimum(np.searchsorted(self.alphabet, padded), len(self.alphabet) - 1)
            padded = np.where(self.alphabet[column] == padded, column, len(self.alphabet))
        start = np.arange(lanes) * LANE
        node = np.zeros(lanes, np.int64)
        nodes = np.zeros((lanes, LANE), np.int32)  # where each sign leads, in the text's order
        for i in range(before + LANE):
            sign = padded[start + i]
            node = self.step(node, sign) if self.table is None else self.table[node, sign]
            if i >= before:
                nodes[:, i - before] = node
        return nodes.ravel()[: len(text)]

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, term) of every occurrence in a sequence of signs, by rising end, longer terms first; end is behind the last sign."""
        none = np.zeros(0, np.int64)
        if not self.longest or not len(text):
            return none, none
        nodes = self.nodes(text)
        at = np.flatnonzero(self.ends[nodes])
        node = nodes[at].astype(np.int64)
        node = np.where(self.term[node] >= 0, node, self.shorter[node])
        n = self.ends[node]
        end, term = np.repeat(at + 1, n), np.empty(int(n.sum()), np.int64)
        place = np.cumsum(n) - n
        while len(node):  # each place's terms, longest first
            term[place] = self.term[node]
            node = self.shorter[node]
            place, node = place[node > 0] + 1, node[node > 0]
        return end, term

    def find_in(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, end within it, term) of every occurrence in each text."""
        each = [signs(t or "") for t in texts]
        long = np.array([len(t) + 1 for t in each], np.int64)
        begin = np.cumsum(long) - long
        end, term = self.find(np.concatenate([np.append(t, _BETWEEN) for t in each]) if each else np.zeros(0, np.int64))
        text = np.searchsorted(begin, end - 1, side="right") - 1
        return text, end - begin[text], term


def best_paths(length: np.ndarray, run: np.ndarray, end: np.ndarray, size: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the best path through each run of signs: (run, end of the word within it), in order.

    length: of each run. run, end, size, gain: the words that can be taken, ordered by run, end and falling size, with their end within the run,
    their length and what each adds to a path. Every place must be reachable. Of paths with equal gains the one whose last word is longest
    wins, and so on from the end.
    """
    begin = np.cumsum(length + 1) - length - 1
    best = np.full(int((length + 1).sum()), -np.inf)
    best[begin] = 0.0
    taken = np.zeros(len(best), np.int64)
    most = int(length.max(initial=0))
    order = np.argsort(end.astype(np.uint16) if most < 1 << 16 else end, kind="stable")
    run, end, size, gain = run[order], end[order], size[order], gain[order]
    cut = np.searchsorted(end, np.arange(1, most + 2))
    places = begin[run] + end
    for i, j in zip(cut, cut[1:], strict=False):  # all words that end at the same place of their runs
        if i == j:
            continue
        place = places[i:j]
        reached = best[place - size[i:j]] + gain[i:j]
        new = np.append(True, place[1:] != place[:-1])
        first = np.flatnonzero(new)
        top = np.maximum.reduceat(reached, first)
        # The first of each place's words that reach the most.
        good = np.flatnonzero(reached == np.repeat(top, np.diff(np.append(first, j - i))))
        winner = good[np.searchsorted(good, first)]
        best[place[first]] = top
        taken[place[first]] = size[i:j][winner]
    return _walked(begin, length, taken)


def _walked(begin: np.ndarray, length: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each run by the size of the best word at each place: all runs walk back from their ends at the same time."""
    last, on = np.zeros(len(taken), bool), np.flatnonzero(length > 0)
    at = begin[on] + length[on]
    while len(on):
        last[at] = True
        at = at - taken[at]
        more = at > begin[on]
        on, at = on[more], at[more]
    found = np.flatnonzero(last)
    run = np.searchsorted(begin, found, side="right") - 1
    return run, found - begin[run]


class _Listed:
    """Words given by their places, ordered by their ends within runs."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray, np.ndarray], start: np.ndarray, begin: np.ndarray, steps: int):
        end, size, gain = words
        run = np.searchsorted(start, end - 1, side="right") - 1
        step, place = end - 1 - start[run], begin[run] + end - start[run]
        both = step * (int(place.max()) + 1) + place
        order = np.argsort(both, kind="stable")
        self.place, self.size, self.gain = place[order], size[order], gain[order]
        both = both[order]
        self.group = np.flatnonzero(np.append(True, both[1:] != both[:-1]))  # where a place's words begin
        self.many = np.diff(np.append(self.group, len(both)))
        self.cut = np.searchsorted(step[order], np.arange(steps + 1)).tolist()
        self.group_cut = np.searchsorted(self.group, self.cut).tolist()

    def take(self, best: np.ndarray, taken: np.ndarray, step: int) -> None:
        """Take the words that end at a step of their runs where they make a path better, or as good by a longer word."""
        i, j = self.cut[step], self.cut[step + 1]
        if i == j:
            return
        groups = slice(self.group_cut[step], self.group_cut[step + 1])
        first = self.group[groups] - i
        reached = best[self.place[i:j] - self.size[i:j]] + self.gain[i:j]
        top = np.maximum.reduceat(reached, first)
        good = np.flatnonzero(reached == np.repeat(top, self.many[groups]))
        winner = i + good[np.searchsorted(good, first)]  # the longest of each place's best
        here, size = self.place[winner], self.size[winner]
        better = (top > best[here]) | ((top == best[here]) & (size > taken[here]))
        best[here[better]], taken[here[better]] = top[better], size[better]


class Divider:
    """Divides runs of signs into an automaton's terms by best paths, without listing all terms that stand in them.

    gain: what each term adds to a path; a sign that is no term may stand alone for ``least``. A term's row in the tables holds it and the
    shorter ones that end as it does, longest first, ``WIDTH`` at most; the others stand in the row of the first of them.
    """

    def __init__(self, own: Automaton, gain: np.ndarray, least: float):
        n = len(own.length)
        alone, none = n, n + 1  # rows behind the terms': a sign that is no term, and nothing
        self.own = own
        first = own.term[np.where(own.term >= 0, np.arange(len(own.term)), own.shorter)]
        self.first = np.where(first >= 0, first, alone).astype(np.int32)  # the row of what ends at a node
        size, gains = np.append(own.length, [1, 1]), np.append(gain, [least, -np.inf])
        after, ending = np.full(n + 2, none), np.flatnonzero(own.term >= 0)
        shorter, term = own.term[own.shorter[ending]], own.term[ending]
        after[term] = np.where(shorter >= 0, shorter, np.where(own.length[term] > 1, alone, none))
        rows = [np.arange(n + 2)]
        while len(rows) <= WIDTH and (rows[-1] != none).any():
            rows.append(after[rows[-1]])
        self.size, self.gain, self.after = np.stack([size[r] for r in rows[:-1]], 1).astype(np.int32), np.stack([gains[r] for r in rows[:-1]], 1), rows[-1]
        self.deep = bool((self.after != none).any())
        self.none = none

    def paths(self, text: np.ndarray, start: np.ndarray, length: np.ndarray, more: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The words of the best path through each run (its start in the text, its length): (run, end of the word within it), in order.

        No term reaches out of a run. Of paths with equal gains the one whose last word is longest wins, and so on from the end.
        more: (end in the text, size, gain) of further words within the runs, by falling size.
        """
        inside = np.zeros(len(text) + 1, np.int8)
        inside[start] = 1
        inside[start + length] -= 1
        row = self.first[self.own.nodes(np.where(np.cumsum(inside[:-1]) > 0, text, _BETWEEN))]
        begin = np.cumsum(length + 1) - length - 1
        best = np.zeros(int((length + 1).sum()))
        taken = np.zeros(len(best), np.int32)
        # Longest runs first, so that those which still go on are always the first ones.
        order = np.argsort(-length, kind="stable")
        sign, place, every = start[order], begin[order] + 1, np.arange(len(order))
        on = np.searchsorted(-length[order], -np.arange(1, int(length.max(initial=0)) + 1), side="right")
        others = _Listed(more, start, begin, len(on)) if more is not None and len(more[0]) else None
        for i, k in enumerate(on.tolist()):
            here, rows = place[:k] + i, row[sign[:k] + i]
            size = self.size.take(rows, 0)
            reached = best.take(here[:, None] - size)
            reached += self.gain.take(rows, 0)
            most = reached.argmax(1)
            best[here], taken[here] = reached[every[:k], most], size[every[:k], most]
            if self.deep:
                self._others(best, taken, here, self.after[rows])
            if others:
                others.take(best, taken, i)
        return _walked(begin, length, taken)

    def _others(self, best: np.ndarray, taken: np.ndarray, here: np.ndarray, rows: np.ndarray) -> None:
        """The same for what stands in further rows."""
        while len(more := np.flatnonzero(rows != self.none)):
            here, rows = here[more], rows[more]
            size = self.size[rows]
            reached = best[here[:, None] - size] + self.gain[rows]
            most = reached.argmax(1)[:, None]
            top, size = np.take_along_axis(reached, most, 1)[:, 0], np.take_along_axis(size, most, 1)[:, 0]
            better = top > best[here]
            best[here[better]], taken[here[better]] = top[better], size[better]
            rows = self.after[rows]
