"""A growing leaf: its class counts, and the decision to split, to stop or to wait."""

from __future__ import annotations

import math
import pickle

import numpy as np

from .histograms import ClassHistogram


def impurity(counts: np.ndarray, gini: bool) -> np.ndarray:
    """Along the last axis; rows without counts give 0."""
    total = counts.sum(-1, keepdims=True)
    p = counts / np.maximum(total, 1)
    return (total[..., 0] > 0) - (p * p).sum(-1) if gini else -(p * np.log2(np.where(p > 0, p, 1))).sum(-1)


def cut_indexes(n: np.ndarray, gini: bool) -> np.ndarray:
    """The index of each cut below bin 1, 2, ... of class counts by bin; entropy has the length of naming a cut added."""
    below = n.cumsum(0)
    b, rest, total = below[:-1], below[-1] - below[:-1], below[-1].sum()
    n_b = b.sum(1)
    index = (n_b * impurity(b, gini) + (total - n_b) * impurity(rest, gini)) / total
    return index + math.log2(len(b)) / total if not gini and len(b) > 1 else index


def vote(counts: np.ndarray, up: int, laplace: float) -> int:
    """The class with most rows, the parent's (``up``) raised by ``laplace``; ties to the lower one; the parent's or -1 without rows."""
    if not counts.any():
        return up
    n = counts.astype(float).copy()
    if up >= 0:
        n[up] += laplace
    return int(n.argmax())


def promise(y: np.ndarray, before: float, total: float, up_error: float) -> float:
    """How much a leaf may still gain: its share of all rows times its error, which ten rows of its parent's error are added to."""
    n = float(y.sum())
    return (n + before) / max(1.0, total) * (n - float(y.max(initial=0)) + 10 * up_error) / (10 + n)


class Leaf:
    """Counts of the rows so far, in whole chunks; the rows of a chunk that is not yet full wait as they came.

    Attributes that a wait finds worse than the best by more than the bound are switched off, and so are such cuts of the others.
    """

    def __init__(self, numeric: list[str], words: list[str], classes: int, bins: int):
        self.y, self.classes = np.zeros(classes), classes
        self.numeric = {a: ClassHistogram(classes, bins) for a in numeric}
        self.words: dict[str, dict[str, np.ndarray]] = {a: {} for a in words}
        self.active = len(numeric) + len(words)  # of the path, whatever is switched off here
        self.tail: tuple[dict[str, np.ndarray], np.ndarray] | None = None

    @property
    def n(self) -> int:
        return int(self.y.sum())

    def dumps(self) -> bytes:
        return pickle.dumps(self, protocol=5)

    @staticmethod
    def loads(b: bytes) -> Leaf:
        return pickle.loads(b)

    def add(self, cols: dict[str, np.ndarray], y: np.ndarray) -> None:
        self.y += np.bincount(y, minlength=self.classes)
        for a, h in self.numeric.items():
            h.add(cols[a].astype(float), y)
        for a, t in self.words.items():
            there = np.array([x is not None and x == x for x in cols[a]], bool)  # null has no child
            v, code = np.unique(cols[a][there].astype(str), return_inverse=True)
            n = np.zeros((len(v), self.classes))
            np.add.at(n, (code, y[there]), 1)
            for k, row in zip(v.tolist(), n, strict=True):
                t[k] = t[k] + row if k in t else row

    def merge(self, other: Leaf) -> None:
        """Takes another replica's counts in, but for attributes that are switched off here."""
        self.y = self.y + other.y
        for a, h in self.numeric.items():
            if a in other.numeric:
                h.absorb(other.numeric[a])
        for a, t in self.words.items():
            for k, n in other.words.get(a, {}).items():
                t[k] = t[k] + n if k in t else n

    def shares(self, attr: str, threshold: float | None) -> tuple[list[float], list[str]]:
        """The share of rows that each child of a split would have had, and a text attribute's values."""
        if threshold is not None:
            left = self.numeric[attr].below(threshold).sum() / max(1.0, self.numeric[attr].rows)
            return [left, 1 - left], []
        seen = sorted(self.words[attr])
        return [self.words[attr][v].sum() / self.n for v in seen], seen

    def decide(self, c) -> tuple[str, str | None, float | None]:
        """(split | leaf | wait, attribute, threshold or None for a text attribute); a wait switches off what lost."""
        found, index, cuts = [], {}, {}
        for a, h in self.numeric.items():
            if len(h.lo) > 1:
                cuts[a] = cut_indexes(h.n, c.gini)
                index[a] = float(cuts[a].min())
                found += [(float(cuts[a][k]), a, float(h.lo[k + 1])) for k in np.argsort(cuts[a], kind="stable")[:2]]
        for a, t in self.words.items():
            if len(t) > 1:
                n = np.stack(list(t.values()))
                index[a] = float((n.sum(1) * impurity(n, c.gini)).sum() / n.sum())
                found.append((index[a], a, None))
        if not found:
            return "wait", None, None
        two = sorted(found, key=lambda f: (f[0], f[1], f[2] is not None, f[2] or 0.0))[:2]
        whole = float(impurity(self.y, c.gini))
        r = 1.0 if c.gini else math.log2(max(2, self.classes))
        bound = math.sqrt(r * r * math.log(max(1, self.active) / c.delta) / (2 * self.n))
        first, attr, threshold = two[0]
        second = two[1][0] if len(two) > 1 else whole
        if first - whole > bound or (whole - first < bound < c.pre_prune):
            return "leaf", attr, threshold
        if second - first > bound or (bound < c.tie and whole - first > c.pre_prune):
            return "split", attr, threshold
        if c.prune:
            ahead = {f[1] for f in two}
            for a, i in index.items():
                if i > first + bound and a not in ahead:
                    self.numeric.pop(a, None)
                    self.words.pop(a, None)
                elif a in cuts:
                    self.numeric[a].keep_cuts(cuts[a] <= first + bound)
        return "wait", attr, threshold

    def learn(self, cols: dict[str, np.ndarray], y: np.ndarray, c) -> tuple[str, str | None, float | None, int]:
        """Adds rows in order and decides after every chunk while classes are mixed; with the number of rows used. After a split or stop the rest is not added."""
        if self.tail is not None:
            cols = {a: np.concatenate([self.tail[0][a], v]) for a, v in cols.items()}
            y = np.concatenate([self.tail[1], y])
        waiting = 0 if self.tail is None else len(self.tail[1])
        done = 0
        for t in range(c.chunk, len(y) + 1, c.chunk):
            self.add({a: v[done:t] for a, v in cols.items()}, y[done:t])
            done = t
            if (self.y > 0).sum() > 1:
                what, a, threshold = self.decide(c)
                if what != "wait":
                    self.tail = None
                    return what, a, threshold, t - waiting
        self.tail = ({a: v[done:] for a, v in cols.items()}, y[done:])
        return "wait", None, None, len(y) - waiting

    def all_y(self) -> np.ndarray:
        """Class counts with the waiting rows."""
        return self.y if self.tail is None else self.y + np.bincount(self.tail[1], minlength=self.classes)
