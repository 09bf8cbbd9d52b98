"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points. On every level, runs of one symbol are merged into one; then deterministic coin
tossing gives each symbol a small label from the lowest bit in which it differs from the symbol before it, again and
again until six labels are left, which are brought down to three. A phrase begins at each local maximum of these. So
where phrases begin depends on a few neighbours only, whatever the offset: equal substrings are cut alike but for
their ends. A phrase's name is a 64-bit hash of its symbols' names, the same in every task, and phrases are the
symbols of the next level. A level divides the number of symbols by 2 to 4 (about 2.6).

Fingerprint: the level on which the text has about ``PHRASES`` phrases or more (by its length, from 1 to ``TOP``)
and the one above it; for each of both, one minimum of the hashes of names (and of their
number among equal ones) in each of ``SLOTS`` ranges, one byte each.
It is the level's digit and base64 text. Likeness: the share of equal minima on the lowest level that both hold gives
the resemblance of the sets, and that (2 r / (1 + r)) the share of common phrases. Texts whose lengths differ so much
that they hold no common level have likeness 0. Equal texts have equal fingerprints and likeness 1.

Edge cases: null counts as empty; the empty text has level 0 and no minima, is like itself (1) and like no other (0).
Repeated rows and ids are fingerprinted alike. Rows with equal ids follow each other by their texts' hashes, then in
any order (their texts are equal); null ids come first. The only row is its own next one. Very long texts are whole,
a text is one task's work. Empty tables give empty results. Other columns pass through; those named like a new one
are replaced.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sized, small_batches, with_arrow, written

SLOTS, PHRASES, TOP = 64, 16, 5
#: Symbols of a level per symbol of the next one, about; bytes of text that are parsed at once.
SHRINK, BLOCK = 2.6, 1 << 18
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tossed(bits: int) -> np.ndarray:
    """Label of (symbol before, symbol), both of ``bits`` bits: lowest bit that differs, and its value."""
    b, a = np.meshgrid(np.arange(1 << bits), np.arange(1 << bits))
    x = a ^ b
    low = np.zeros_like(x)
    for k in range(bits - 1, -1, -1):
        low[(x >> k) & 1 == 1] = k
    return (2 * low + ((b >> low) & 1)).astype(np.uint8).ravel()


#: Labels below 128 (of 64-bit names) come down to 14, 8, 6.
_TOSS = [(7, _tossed(7)), (4, _tossed(4)), (3, _tossed(3))]
#: The smallest of 0, 1, 2 that neither neighbour (6 is none) has.
_FREE = np.array([min({0, 1, 2} - {a, b}) for a in range(8) for b in range(8)], np.uint8)


def _starts(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where phrases begin; ``first``: places where texts begin; neighbours in a text differ."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first] = ~names[first]
    x = names ^ before
    low = np.bitwise_count((x & (~x + names.dtype.type(1))) - names.dtype.type(1))
    low = np.minimum(low, 63).astype(np.uint8)
    label = 2 * low + ((names >> low.astype(names.dtype)) & names.dtype.type(1)).astype(np.uint8)
    for bits, table in _TOSS:
        old = np.empty(len(label), np.uint16)
        old[1:] = label[:-1]
        old[first] = label[first] ^ 1
        label = table[(old << bits) | label]
    label = np.concatenate([[6], label, [6]]).astype(np.uint8)
    begins = np.zeros(len(label), bool)
    begins[first + 1] = True
    for c in (3, 4, 5):
        at = np.flatnonzero(label == c)
        left, right = label[at - 1], label[at + 1]
        # no neighbour beyond the text
        left[begins[at]] = 6
        right[begins[at + 1]] = 6
        label[at] = _FREE[left.astype(np.uint16) << 3 | right]
    own = label[1:-1].astype(np.int8)
    left, right = label[:-2].astype(np.int8), label[2:].astype(np.int8)
    left[0], right[-1] = -1, -1
    left[first] = -1
    right[first[1:] - 1] = -1
    top = (own > left) & (own > right)
    top[first] = True
    return np.flatnonzero(top)


def _up(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, places where texts begin) of the next level."""
    new = np.empty(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    new[first] = True
    at = np.flatnonzero(new)
    if len(at) < len(names):
        size = np.diff(np.concatenate([at, [len(names)]])).astype(_U)
        names = names[at].astype(_U)
        many = size > 1
        names[many] = _mixed(names[many] ^ (size[many] * _U(0x9E3779B97F4A7C15)))
        first = np.searchsorted(at, first)
    begin = _starts(names, first)
    size = np.diff(np.concatenate([begin, [len(names)]]))
    place = np.arange(len(names)) - np.repeat(begin, size)
    parts = _mixed(names.astype(_U) + (place.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
    return _mixed(np.add.reduceat(parts, begin) + size.astype(_U)), np.searchsorted(begin, first)


def level_of(n: int) -> int:
    """The lower of the two levels that stand for a text of ``n`` code points."""
    return max(1, min(TOP, int(math.log(n / PHRASES, SHRINK)))) if n >= PHRASES else int(n > 0)


def levels(texts: list[str], top: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(names, number of each name's text) on levels 1 to ``top``."""
    sizes = np.array([len(t) for t in texts], np.int64)
    names = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    there = np.flatnonzero(sizes)
    first, out = (np.cumsum(sizes) - sizes)[there], []
    for _ in range(top):
        if len(names):
            names, first = _up(names, first)
        out.append((names.astype(_U), np.repeat(there, np.diff(np.concatenate([first, [len(names)]])))))
    return out


def fingerprints_of(texts: list[str]) -> list[str]:
    low = np.array([level_of(len(t)) for t in texts], np.int64)
    table = np.full((2, len(texts) * SLOTS), 255, np.uint8)
    for level, (names, doc) in enumerate(levels(texts, int(low.max(initial=0)) + 1), 1):
        for k in (0, 1):
            own = low[doc] + k == level
            name, text = names[own], doc[own]
            if not len(name):
                continue
            # a name's second occurrence in a text is another element than its first
            by = np.lexsort((name, text))
            name, text = name[by], text[by]
            fresh = np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])])
            nth = np.arange(len(name)) - np.maximum.accumulate(np.where(fresh, np.arange(len(name)), 0))
            x = _mixed(name + nth.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(level))
            np.minimum.at(table[k], text * SLOTS + (x >> _U(58)).astype(np.int64), ((x >> _U(32)) % _U(255)).astype(np.uint8))
    both = np.concatenate([t.reshape(len(texts), SLOTS) for t in table], axis=1)
    return [f"{a}{base64.b64encode(row.tobytes()).decode()}" for a, row in zip(low.tolist(), both, strict=True)]


def fingerprints(docs: DataFrame, text_col: str = "text", n_chars: str = "n_chars", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the text's number of code points and fingerprint, in columns of these names."""

    def run(batches):
        for table in sized(batches, text_col, BLOCK):
            for batch in table.combine_chunks().to_batches():
                texts = [x or "" for x in batch.column(text_col).to_pylist()]
                yield batch, {n_chars: pa.array([len(t) for t in texts], pa.int64()), out: pa.array(fingerprints_of(texts), pa.string())}

    return with_arrow(docs, run, f"`{n_chars}` long, `{out}` string")


def likeness(a: Column, b: Column) -> Column:
    """Likeness (0 to 1) of two fingerprints, by the lowest level that both hold."""
    level = lambda x: F.substring(x, 1, 1).cast("int")
    half = lambda x, other: F.substring(F.unbase64(F.substring(x, 2, 1000)), F.when(level(other) > level(x), SLOTS + 1).otherwise(1), F.lit(SLOTS))
    none = F.unhex(F.lit("FF"))

    def counted(pair):
        byte = lambda x, i: F.substring(x, i, F.lit(1))
        places = F.sequence(F.lit(1), F.lit(SLOTS))
        same = F.size(F.filter(places, lambda i: (byte(pair["a"], i) == byte(pair["b"], i)) & (byte(pair["a"], i) != none)))
        any_ = F.size(F.filter(places, lambda i: (byte(pair["a"], i) != none) | (byte(pair["b"], i) != none)))
        return F.when(any_ > 0, 2 * same / (any_ + same)).otherwise(0.0)

    # the array keeps both halves from being decoded again for every byte
    found = F.get(F.transform(F.array(F.struct(half(a, b).alias("a"), half(b, a).alias("b"))), counted), F.lit(0))
    return F.when(a == b, 1.0).when(F.abs(level(a) - level(b)) > 1, 0.0).otherwise(found)


def followed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted ``rows`` with next_<column> of the row after each in its partition, part (the partition's number), first
    and last (the last row has no next one here)."""
    new = ", ".join(f"next_{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    kinds = {f"next_{c}": rows.schema[c].dataType for c in columns}

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        first, held = True, None

        def out(now: pa.RecordBatch, after: pa.RecordBatch | None, last: bool):
            nonlocal first
            n = now.num_rows
            more = {f"next_{c}": after.column(c) if after is not None else pa.nulls(n, to_arrow_type(kinds[f"next_{c}"])) for c in columns}
            more |= {"first": pa.array([first, *[False] * (n - 1)]), "last": pa.array([last] * n)}
            first = False
            return now, more

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield out(held, batch.slice(0, 1), False)
            if batch.num_rows > 1:
                yield out(batch.slice(0, batch.num_rows - 1), batch.slice(1), False)
            held = batch.slice(batch.num_rows - 1)
        if held is not None:
            yield out(held, None, True)

    return with_arrow(rows.withColumn("part", F.spark_partition_id()), run, f"{new}, first boolean, last boolean")


def compare_with_next(docs: DataFrame, made: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row, in order of its id: id, n_chars, fingerprint; edited_sha256 and edited_fingerprint of the text that
    ``made`` (of the columns text, n_chars, next_text) gives; near_edited, near_next (likeness to it, and to the next
    row's text). After the last row comes the first.

    Texts are shuffled once, by ranges of ids; the last row of a range meets the first of the next one in a join of
    one row for each range.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # equal ids and texts spread over ranges by the row's number
    keys = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    dealt = keys.repartitionByRange("id", "_hash", "_row").sortWithinPartitions("id", "_hash").select("id", "text")

    def finished(x: DataFrame) -> DataFrame:
        x = fingerprints(x.withColumn("edited", made), "edited", "_n", "edited_fingerprint").drop("_n")
        near = lambda c: likeness(F.col("fingerprint"), F.col(c))
        return x.withColumns({"edited_sha256": F.sha2(F.col("edited").cast("binary"), 256), "near_edited": near("edited_fingerprint"), "near_next": near("next_fingerprint")}).drop("edited")

    end = F.when(F.col("first") | F.col("last"), F.col("text"))
    whole = finished(followed(fingerprints(dealt), ["text", "fingerprint"]))
    whole = written(whole.withColumn("text", end).drop("next_text", "next_fingerprint"), "compared")
    # the first row behind each range's last one
    parts = [r["part"] for r in whole.where("first").select("part").orderBy("part").collect()]
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), T.StructType.fromDDL("part int, after int"))
    heads = whole.where("first").select(F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    own = ["id", "text", "part", "n_chars", "fingerprint"]
    ends = finished(whole.where("last").select(*own).join(F.broadcast(after), "part").join(heads, "after"))
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    out = whole.where("not last").select(*names).unionByName(ends.select(*names))
    return out.withColumnRenamed("id", id_col)
