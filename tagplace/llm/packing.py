"""Best-fit packing of tokenised documents into sequences of fixed length, by bin completion.

Pieces that have equal lengths are interchangeable, so a packing is a list of fillings (a multiset of lengths
that fits one sequence) with multiplicities, found from the histogram of lengths: at most ``capacity`` numbers,
however many documents there are. Only that histogram reaches the driver. Pieces are dealt to the fillings by
their rank among those of their length; ranks come from counts per task, so no task sees all pieces of a length.

Search: the largest length left must go somewhere; the undominated fillings around it are enumerated, the least
waste first, each used as often as the histogram allows, and a branch is cut when its waste, with the lower
bound for the rest, can't beat the incumbent. Incumbents start from best fit. ``max_nodes`` bounds the search.

Edge cases: a null text is empty and gives a piece of one end id. Null doc_ids stay null. Repeated rows are
packed like any others. An empty table gives an empty result. Further input columns are ignored. Only documents
of more than ``capacity`` ids are cut; their first piece takes what is left over.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, written
from .tokens import default_tokenizer, encoded

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and cut: a row per piece, with its task and its number among that task's pieces of equal length."""
    tokenizer = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows, ids, counts in encoded(tokenizer, batches, "text", end_id):
            cuts = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), cuts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            first = (counts - 1) % capacity + 1  # only the first piece may be shorter
            start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            size = np.where(piece > 0, capacity, first[doc])
            at = np.cumsum(size) - size
            # number among the task's pieces of this length
            order = np.argsort(size, kind="stable")
            own = size[order]
            nth = np.zeros(len(size), np.int64)
            nth[order] = np.arange(len(own)) - np.searchsorted(own, own) + seen[own]
            seen += np.bincount(size, minlength=capacity + 1)
            raw = memoryview(ids.view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
            columns = [rows.column("doc_id").combine_chunks().take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(size), part), pa.int32()), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def _fillings(left: Counter, largest: int, capacity: int, most: int) -> list[tuple[int, ...]]:
    """Undominated fillings around ``largest``, the least waste first; at most ``most`` are looked at."""
    lengths = sorted((x for x in left if left[x] > 0), reverse=True)
    found: list[tuple[int, tuple[int, ...]]] = []
    looked = 0

    def grow(i: int, room: int, own: list[int]) -> None:
        nonlocal looked
        while i < len(lengths) and lengths[i] > room:
            i += 1
        if i == len(lengths) or looked >= most:
            found.append((room, tuple(own)))
            looked += 1
            return
        first = True
        for j in range(i, len(lengths)):
            x = lengths[j]
            if not first and (looked >= most or x * 2 <= lengths[i] and room >= lengths[i]):
                break  # shorter ones alone are dominated by the longest that fits
            if own.count(x) + (x == largest) < left[x]:
                first = False
                own.append(x)
                grow(j, room - x, own)
                own.pop()
                if found and found[-1][0] == 0 and len(found) >= 8:
                    return
        if first:
            found.append((room, tuple(own)))
            looked += 1

    grow(0, capacity - largest, [])
    best = sorted(set(found), key=lambda f: (f[0], len(f[1]), tuple(-x for x in f[1])))
    kept: list[tuple[int, tuple[int, ...]]] = []
    for room, own in best:
        if not any(_dominates(other, own) for _, other in kept):
            kept.append((room, own))
        if len(kept) >= 6:
            break
    return [own for _, own in kept]


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the lengths of b can be put into those of a (each a holds a part of b)."""
    room = sorted(a, reverse=True)

    def put(i: int) -> bool:
        if i == len(b):
            return True
        tried = set()
        for j, r in enumerate(room):
            if r >= b[i] and r not in tried:
                tried.add(r)
                room[j] -= b[i]
                if put(i + 1):
                    return True
                room[j] += b[i]
        return False

    return len(b) <= 6 and put(0)


def _times(left: Counter, filling: tuple[int, ...]) -> int:
    return min(left[x] // n for x, n in Counter(filling).items())


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings by best fit: around the largest length, always the longest that still fits."""
    left, out = Counter({x: n for x, n in hist.items() if n > 0}), []
    while left:
        own, room = [max(left)], capacity - max(left)
        spare = left.copy()
        spare[own[0]] -= 1
        while fits := [x for x, n in spare.items() if n > 0 and x <= room]:
            own.append(max(fits))
            spare[own[-1]] -= 1
            room -= own[-1]
        times = _times(left, tuple(own))
        out.append((tuple(own), times))
        for x, n in Counter(own).items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """No packing takes fewer: total length, and lengths that exclude each other (Martello and Toth's L2)."""
    total, best = sum(x * n for x, n in hist.items()), 0
    for k in range(0, capacity // 2 + 1):
        big = sum(n for x, n in hist.items() if x > capacity - k)
        half = [(x, n) for x, n in hist.items() if capacity / 2 < x <= capacity - k]
        small = sum(x * n for x, n in hist.items() if k <= x <= capacity / 2)
        room = sum((capacity - x) * n for x, n in half)
        best = max(best, big + sum(n for _, n in half) + max(0, -(-(small - room) // capacity)))
    return max(best, -(-total // capacity))


def complete_bins(hist: dict[int, int], capacity: int, max_nodes: int = 3000, most: int = 120) -> list[tuple[tuple[int, ...], int]]:
    """Fillings with multiplicities that pack the histogram: branch and bound, incumbents from best fit."""
    hist = {x: n for x, n in hist.items() if n > 0}
    best = best_fit(hist, capacity)
    bound, cost = lower_bound(hist, capacity), sum(n for _, n in best)
    total, nodes = sum(x * n for x, n in hist.items()), 0
    stack = [(Counter(hist), [], 0, total)]
    while stack and cost > bound and nodes < max_nodes:
        left, used, bins, rest = stack.pop()
        nodes += 1
        if not left:
            if bins < cost:
                best, cost = used, bins
            continue
        if bins + -(-rest // capacity) >= cost:
            continue  # the waste so far is too much
        largest = max(left)
        branches = []
        for own in _fillings(left, largest, capacity, most):
            filling = (largest, *own)
            times, spare = _times(left, filling), left.copy()
            for x, n in Counter(filling).items():
                spare[x] -= n * times
                if not spare[x]:
                    del spare[x]
            branches.append((spare, [*used, (filling, times)], bins + times, rest - times * sum(filling)))
        stack += reversed(branches)  # the least waste is looked at first
        if nodes % 16 == 1:  # best fit from here may be a new incumbent
            tail = best_fit(left, capacity)
            if bins + sum(n for _, n in tail) < cost:
                best, cost = [*used, *tail], bins + sum(n for _, n in tail)
    return best


def _runs(fillings: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, first sequence, multiplicity and offset of each slot of the fillings."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    base = 0
    for filling, times in fillings:
        at = 0
        for x in filling:
            slots.setdefault(x, []).append((ranks[x], base, times, at))
            ranks[x] += times
            at += x
        base += times
    return {x: tuple(np.array(v, np.int64).T) for x, v in slots.items()}


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset; with ``with_ids`` also their token ids."""
    cut = written(pieces(docs, capacity, tokenizer, end_id, with_ids), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    hist = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    runs = _runs(complete_bins(hist, capacity))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    ranked = cut.join(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base")), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    keep = [c for c in cut.columns if c not in ("part", "nth")]

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                first, base, times, at = runs[int(x)]
                slot = np.searchsorted(first, rank[own], side="right") - 1
                seq[own] = base[slot] + rank[own] - first[slot]
                offset[own] = at[slot]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(seq), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*keep, "rank").mapInArrow(place, schema)
