"""Class counts of a numeric attribute in a bounded number of bins, which rows are added to and histograms merged into."""

from __future__ import annotations

import numpy as np


class ClassHistogram:
    """Disjoint bins [lo, hi] in order, with a count for each class.

    A value outside all bins becomes a bin of its own. Beyond ``most`` bins they shrink to about half as many: neighbours
    whose rows begin in the same one of most / 2 equal shares of all rows become one, but none joins the one before it that is
    heavier than a share: light bins go, heavy values stay on their own. As long as rows are only added, the rows below any bin's ``lo`` are exactly those of the bins before it: shrinking leaves fewer cuts
    to choose from, never wrong counts. Merging lays overlapping bins side by side by their ``lo``, and ``error`` is how
    many rows at most lie on the wrong side of any cut since then: it is 0 where nothing overlaps, as before any shrinking,
    and a merge adds the rows of the bins that reach over a cut, one of each histogram. Null and NaN are left out.
    """

    __slots__ = ("lo", "hi", "n", "most", "error")

    def __init__(self, classes: int, most: int = 1000):
        self.lo, self.hi, self.n, self.most, self.error = np.zeros(0), np.zeros(0), np.zeros((0, classes)), most, 0.0

    @property
    def rows(self) -> float:
        return float(self.n.sum())

    def add(self, values: np.ndarray, cls: np.ndarray) -> None:
        ok = ~np.isnan(values)
        v, code = np.unique(values[ok], return_inverse=True)
        if not len(v):
            return
        n = np.zeros((len(v), self.n.shape[1]))
        np.add.at(n, (code, cls[ok]), 1)
        at = np.searchsorted(self.lo, v, "right") - 1
        inside = (at >= 0) & (v <= self.hi[at]) if len(self.lo) else np.zeros(len(v), bool)
        np.add.at(self.n, at[inside], n[inside])
        if not inside.all():
            new = ~inside
            where = at[new] + 1
            self.lo, self.hi, self.n = np.insert(self.lo, where, v[new]), np.insert(self.hi, where, v[new]), np.insert(self.n, where, n[new], 0)
        self._shrink()

    def absorb(self, other: ClassHistogram) -> None:
        """Like ``merge``, but bins that lie within one of this histogram's stay closed in it."""
        at = np.searchsorted(self.lo, other.lo, "right") - 1
        inside = (at >= 0) & (other.hi <= self.hi[at]) if len(self.lo) else np.zeros(len(other.lo), bool)
        np.add.at(self.n, at[inside], other.n[inside])
        rest = ClassHistogram(self.n.shape[1], self.most)
        rest.lo, rest.hi, rest.n, rest.error = other.lo[~inside], other.hi[~inside], other.n[~inside], other.error
        self.merge(rest)

    def merge(self, *others: ClassHistogram) -> None:
        """Takes the others' rows in, best all at once: before a cut, at most one bin of each reaches beyond it. Errors add up."""
        every = (self, *others)
        lo, hi, n = (np.concatenate([getattr(h, x) for h in every]) for x in ("lo", "hi", "n"))
        order = np.lexsort((hi, lo))
        lo, hi, n = lo[order], hi[order], n[order]
        self.error = sum(h.error for h in every)
        if len(lo):
            first = np.flatnonzero(np.diff(lo, prepend=np.nan) != 0)  # equal beginnings are one bin
            cut_after = np.searchsorted(lo[first], lo, "right")  # the first cut beyond each bin's beginning
            reach = np.searchsorted(lo[first], hi, "right")  # its rows may belong beyond the cuts up to here
            over, w, d = reach > cut_after, n.sum(1), np.zeros(len(first) + 1)
            np.add.at(d, cut_after[over], w[over])
            np.add.at(d, reach[over], -w[over])
            self.error += float(np.cumsum(d[:-1]).max())
            lo, hi, n = lo[first], np.maximum.reduceat(hi, first), np.add.reduceat(n, first, 0)
            hi[:-1] = np.maximum(lo[:-1], np.minimum(hi[:-1], np.nextafter(lo[1:], -np.inf)))
        self.lo, self.hi, self.n = lo, hi, n
        self._shrink()

    def _shrink(self) -> None:
        if len(self.lo) <= self.most:
            return
        w = self.n.sum(1)
        each = w.sum() / (self.most // 2)
        share = np.floor((np.cumsum(w) - w) / each)
        self._join(np.flatnonzero((np.diff(share, prepend=-1) > 0) | (w > each)))

    def _join(self, first: np.ndarray) -> None:
        """Bins from one number of ``first`` up to the next become one."""
        ends = np.append(first[1:], len(self.lo)) - 1
        self.lo, self.hi, self.n = self.lo[first], self.hi[ends], np.add.reduceat(self.n, first, 0)

    def keep_cuts(self, good: np.ndarray) -> None:
        """Cuts (below bin 1, 2, ...) that are not good go: their bins join the one before, and values between won't open them again."""
        if len(good) and not good.all():
            self._join(np.concatenate([[0], np.flatnonzero(good) + 1]))

    def below(self, value: float) -> np.ndarray:
        """Rows of each class below a value, a bin's share by linear interpolation."""
        k = int(np.searchsorted(self.lo, value, "left"))
        out = self.n[:k].sum(0)
        if k and self.hi[k - 1] >= value and self.hi[k - 1] > self.lo[k - 1]:
            out = out - self.n[k - 1] * (self.hi[k - 1] - value) / (self.hi[k - 1] - self.lo[k - 1])
        return out
