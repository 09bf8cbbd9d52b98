"""Ranking of very many classes whose scores are lines: value(c) = a_c + S b_c, plus something for a few of them.

A bag of mass S scores every class that shares no tag with it on such a line. What a bag needs of these classes are
the best few at its S and the sum of exp(value) over all; neither takes a look at each class:

* Masses are cut into cells. A line that is among the ``KEPT`` best somewhere in a cell is at one of the cell's ends at
  least as high as the ``KEPT``-th best of the lines' lower ends there; so each cell has a short list of lines, found once.
* With h = S - (middle of the cell), the sum is exp(m + h b0) * sum_j M_j h^j / j!, where the moments M_j of the slopes
  around b0 are found once a cell; cells are so narrow that ``TERMS`` terms are exact in doubles.

A bag then costs its own classes and a short list. Where that does not do (a cover set longer than the list, a bag whose
own classes take nearly all of the sum away) the bag's scores of all classes are looked at, in its task.
"""

from __future__ import annotations

import math

import numpy as np

KEPT, TERMS = 128, 14
#: Cells that a task remembers.
CELLS = 4096


class Lines:
    """Classes in order of their labels, with intercepts ``a`` and slopes ``b``."""

    def __init__(self, labels: np.ndarray, a: np.ndarray, b: np.ndarray, decimals: int):
        order = np.argsort(labels, kind="stable")
        self.labels, self.a, self.b, self.decimals = labels[order], a[order], b[order], decimals
        low, high = (float(b.min()), float(b.max())) if len(b) else (0.0, 0.0)
        # |h (b - b0)| stays below 1/4
        self.b0, self.step = (low + high) / 2, 1.0 / max(high - low, 1e-9)
        self.cells: dict[int, tuple] = {}

    def cell(self, number: int) -> tuple[np.ndarray, float | None, float, np.ndarray]:
        """(places of the short list, bound of all others, scale, moments) of a cell; values are less h b0, and the bound
        is None if the list holds all."""
        found = self.cells.get(number)
        if found is None:
            middle = number * self.step
            mid, half = self.a + middle * self.b, self.step / 2 * np.abs(self.b - self.b0)
            high, low, bound = mid + half, mid - half, None
            if len(mid) > KEPT:
                # lines that may tie with the last one after rounding are on the list too
                bound = np.partition(low, len(low) - KEPT)[len(low) - KEPT] - 4 * 10.0**-self.decimals
                short = np.flatnonzero(high >= bound)
            else:
                short = np.arange(len(mid))
            scale = float(mid.max())
            w, x = np.exp(mid - scale), self.b - self.b0
            moments = np.empty(TERMS)
            for j in range(TERMS):
                moments[j] = w.sum() / math.factorial(j)
                w = w * x
            if len(self.cells) >= CELLS:
                self.cells.clear()
            found = self.cells[number] = (short, bound if len(short) < len(mid) else None, scale, moments)
        return found

    def ranked(self, mass: float, own: np.ndarray, more: np.ndarray, count: int | None, cover: float) -> tuple[np.ndarray, ...]:
        """(label, probability, score, rank, before) of a bag's kept classes: the best ``count``, or the cover set.

        ``own`` are places of classes in order, ``more`` what is added to their lines.
        """
        number = round(mass / self.step)
        short, bound, scale, moments = self.cell(number)
        h = mass - number * self.step
        every = float(np.polyval(moments[::-1], h))  # times exp(scale + h b0)
        at = own.searchsorted(short)
        known = own.take(np.minimum(at, len(own) - 1)) == short if len(own) else np.zeros(len(short), bool)
        other = short[~known]
        mine = self.a[own] + mass * self.b[own]
        places = np.concatenate([own, other])
        score = np.concatenate([mine + more, self.a[other] + mass * self.b[other]])
        base = scale + h * self.b0
        rest = every - np.exp(mine - base).sum()
        if bound is None:
            total_of = lambda best: np.exp(score - best).sum()
        elif rest < 1e-6 * every:
            return self.looked_at(mass, own, more, count, cover)
        else:
            total_of = lambda best: np.exp(score[: len(own)] - best).sum() + rest * math.exp(min(base - best, 700.0))
        best = score.max()
        behind = np.round(score - best, self.decimals)
        order = np.lexsort((places, -behind))
        p = np.exp(score[order] - best) / total_of(best)
        before = np.cumsum(p) - p
        keep = np.arange(len(p)) < count if count is not None else np.round(before, 9) < cover
        n = len(p) if keep.all() else int(np.argmin(keep))
        if bound is not None:
            # a class that isn't listed lies below the bound
            sure = int((score > bound + h * self.b0 + 2 * 10.0**-self.decimals).sum())
            if n > sure or keep.all():
                return self.looked_at(mass, own, more, count, cover)
        order = order[:n]
        return self.labels[places[order]], p[:n], score[order], np.arange(1, n + 1), before[:n]

    def looked_at(self, mass: float, own: np.ndarray, more: np.ndarray, count: int | None, cover: float) -> tuple[np.ndarray, ...]:
        """The same from the scores of all classes."""
        score = self.a + mass * self.b
        score[own] += more
        best = score.max()
        order = np.argsort(-np.round(score - best, self.decimals), kind="stable")
        p = np.exp(score[order] - best)
        p /= p.sum()
        before = np.cumsum(p) - p
        keep = np.arange(len(p)) < count if count is not None else np.round(before, 9) < cover
        n = len(p) if keep.all() else int(np.argmin(keep))
        return self.labels[order[:n]], p[:n], score[order[:n]], np.arange(1, n + 1), before[:n]
