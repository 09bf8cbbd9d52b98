"""Periodic runs of words: a suffix tree with smaller-half leaf lists finds branching tandem repeats.

The texts of a batch form one word sequence; each text ends with a mark of its own, and words count as equal within
their text only, so one tree serves all texts of the batch. Suffixes are sorted by prefix doubling, of which every
round refines only the groups that are still tied; the ranks of the rounds also give common prefixes, forwards and
backwards, by descending powers of two. The inner nodes of the suffix tree are the intervals of the sorted suffixes
with a common prefix of length D. For every node, the leaves of all children but the largest are visited: a leaf i
has a tandem repeat of two times D words if i + D (or i - D) is a leaf of the node too; it is branching if the word
behind it does not go on. Each leaf is visited at most log2(words) times. A branching repeat is the rightmost of its
run: rotating it to the left as far as the words agree gives the maximal run. Multiples of a period lead to the same
interval, of which the smallest period is kept.

A run is a stretch of words with smallest period q, at least max(``least``, 2 q) words long, that no neighbouring
word extends. A text is one task's work (its runs may span all of it); batches are bounded by words and bytes.

Edge cases: a null text has no words; it and the empty text have no runs and an empty collapsed text. Repeated rows
and ids get the same result. Empty tables give empty results. Other columns pass through; those named like a new one
(n_words, runs, collapsed) are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import sized, with_arrow
from .lm import words_of

#: Shortest run in words; bytes of text in a batch.
LEAST, BLOCK = 12, 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _ranks(codes: np.ndarray) -> list[np.ndarray]:
    """For each round k, ranks of all suffixes by their first 2 ** k words; in the last all differ."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    fresh = np.concatenate([[True], codes[order][1:] != codes[order][:-1]])
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = start
    out, k = [rank], 1
    while True:
        # places of the sorted suffixes that share their rank with a neighbour
        tied = ~fresh | np.concatenate([~fresh[1:], [False]])
        at = np.flatnonzero(tied)
        if not len(at):
            return out
        own = order[at]
        group = rank[own].astype(np.int64)
        key = (group << 32) | rank[own + k]
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[at] = own
        fresh[at] = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        # groups stay where they are: the place of a group's first suffix is its rank
        rank[own] = np.maximum.accumulate(np.where(fresh[at], at, 0))
        out.append(rank)
        k *= 2


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """Lengths of the words that agree from a and b on (``back``: before them)."""
    a, b, n = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        if back:
            low = np.minimum(a, b) >= step
            same = low & (ranks[k][np.where(low, a - step, 0)] == ranks[k][np.where(low, b - step, 0)])
            move = np.where(same, -step, 0)
        else:
            same = ranks[k][a] == ranks[k][b]
            move = np.where(same, step, 0)
        a, b, n = a + move, b + move, n + np.abs(move)
    return n


def _intervals(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``at``: the last place before it, and the first behind it, with a smaller value."""
    own, zeros = lcp[at], np.flatnonzero(lcp == 0)
    longest = int(np.diff(np.concatenate([zeros, [len(lcp)]])).max())
    table = [lcp]
    while 2 << len(table) - 1 <= longest:
        half, prev = 1 << len(table) - 1, table[-1]
        table.append(np.minimum(prev[:-half], prev[half:]) if len(prev) > half else prev[:0])
    after, before = at + 1, at - 1
    for k in range(len(table) - 1, -1, -1):
        low, size = table[k], 1 << k
        for_, there = after, after < len(low)
        ok = there & (low[np.where(there, for_, 0)] >= own) if len(low) else np.zeros(len(at), bool)
        after = np.where(ok, after + size, after)
        first = before - size + 1
        there = (first >= 0) & (first < len(low))
        ok = there & (low[np.where(there, first, 0)] >= own) if len(low) else np.zeros(len(at), bool)
        before = np.where(ok, before - size, before)
    return before, after


def _small_leaves(left: np.ndarray, right: np.ndarray, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place of a leaf, node's first and last place, depth) for leaves of all children but each node's largest.

    ``at``: places where two children of the node ``left``..``right`` - 1 meet.
    """
    by = np.lexsort((at, right, left))
    left, right, at, depth = left[by], right[by], at[by], depth[by]
    first = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    last = np.concatenate([first[1:], [True]])
    # a child begins at every meeting place, and one at the node's left end
    begin = np.concatenate([at, left[first]])
    end = np.concatenate([np.where(last, right, np.concatenate([at[1:], [0]])), at[first]])
    node = np.cumsum(first) - 1
    node = np.concatenate([node, node[first]])
    l, r, d = left[first][node], right[first][node], depth[first][node]
    size = end - begin
    largest = np.lexsort((-size, node))
    keep = np.ones(len(size), bool)
    keep[largest[np.concatenate([[True], node[largest][1:] != node[largest][:-1]])]] = False
    begin, size, l, r, d = begin[keep], size[keep], l[keep], r[keep], d[keep]
    skip = np.repeat(np.cumsum(size) - size, size)
    places = np.repeat(begin, size) + np.arange(int(size.sum())) - skip
    return places, np.repeat(l, size), np.repeat(r, size) - 1, np.repeat(d, size)


def runs_of(codes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the maximal runs, by start then period; each text of the sequence ends with a code
    that occurs nowhere else, and no other code is in two texts."""
    none = np.zeros(0, np.int64)
    n = len(codes)
    if n < least:
        return none, none, none
    ranks = _ranks(codes)
    place = ranks[-1].astype(np.int64)
    suffixes = np.empty(n, np.int64)
    suffixes[place] = np.arange(n)
    near = np.flatnonzero(ranks[0][suffixes[1:]] == ranks[0][suffixes[:-1]]) + 1
    if not len(near):
        return none, none, none
    lcp = np.zeros(n, np.int64)
    lcp[near] = _common(ranks, suffixes[near - 1], suffixes[near])
    left, right = _intervals(lcp, near)
    leaf, l, r, d = _small_leaves(left, right, near, lcp[near])
    i = suffixes[leaf]
    found = []
    for s in (i, i - d):
        # the other half of the repeat, at s + d or at s, is a leaf of the node; what follows breaks the period
        other = s + d if s is i else s
        ok = (other >= 0) & (other < n)
        p = place[np.where(ok, other, 0)]
        ok &= (p >= l) & (p <= r)
        ok = np.flatnonzero(ok)
        s, q = s[ok], d[ok]
        branching = codes[s + q] != codes[np.minimum(s + 2 * q, n - 1)]
        found.append((s[branching], q[branching]))
    s, q = (np.concatenate(x) for x in zip(*found, strict=True))
    more = _common(ranks, s, s + q, back=True)
    start, end = s - more, s + 2 * q
    long = end - start >= least
    start, end, q = start[long], end[long], q[long]
    by = np.lexsort((q, end, start))
    start, end, q = start[by], end[by], q[by]
    one = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(start)]
    start, end, q = start[one], end[one], q[one]
    by = np.lexsort((q, start))
    return start[by], (end - start)[by], q[by]


def _coded(words: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes with a mark behind each text, number of the text of each code)."""
    found = words.dictionary_encode()
    kinds, docs = len(found.dictionary), np.arange(len(size))
    doc = np.repeat(docs, size)
    own = doc * (kinds + 1) + found.indices.to_numpy().astype(np.int64)
    ends = np.cumsum(size)
    return np.insert(own, ends, docs * (kinds + 1) + kinds), np.insert(doc, ends, docs)


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period, in order) and collapsed: the words joined by one space but for
    those that a run has beyond its first period."""

    def made(words: pa.Array, size: np.ndarray) -> dict:
        codes, doc = _coded(words, size)
        start, length, period = runs_of(codes, least)
        owner = doc[start] if len(start) else start
        begins = np.cumsum(size + 1) - size - 1
        gone = np.bincount(start + period, minlength=len(codes) + 1) - np.bincount(start + length, minlength=len(codes) + 1)
        marks = begins + size
        kept = np.delete(np.cumsum(gone)[: len(codes)] == 0, marks)
        left = np.cumsum(np.concatenate([[0], kept]))[np.concatenate([[0], np.cumsum(size)])]
        rest = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(kept)))
        runs = pa.StructArray.from_arrays([pa.array(start - begins[owner]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
        offsets = np.searchsorted(owner, np.arange(len(size) + 1))
        return {"n_words": pa.array(size.astype(np.int64)), "runs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), "collapsed": pc.binary_join(rest, b" ").cast(pa.string())}

    def run(batches):
        for table in sized(batches, text_col, BLOCK):
            table = table.combine_chunks()
            for batch in table.to_batches():
                yield batch, made(*words_of(batch.column(text_col), lower=False))

    return with_arrow(docs, run, "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
