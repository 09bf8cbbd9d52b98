"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Each partition of the documents sorts its distinct 64-bit fingerprints and sends them, by the owner of their
range, as Golomb-coded gaps. An owner sees each fingerprint at most once a partition, so a text that fills a
third of the table costs it one number a partition; it answers with a bitmap of those that came from more than
one partition. Texts are shuffled for suspects only, grouped by their bytes, so a fingerprint collision never
joins different texts; equal texts are first merged where they are read. What goes back to the rows is keyed by
SHA-256 and salted, so a large group is no hot key; rows that are no suspects are not shuffled at all. Very long
texts are kept whole (a part closes once its rows reach ``PART_BYTES``).

Edge cases: a null text counts as empty. Of equal texts the row with the largest doc_id stays; among rows that
also share it, or whose doc_ids are all null (null is smallest), one stays. Empty tables give empty results.
Other columns pass through; those named like a new column (keep_id, group_size, kept, text_sha256) are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, with_arrow, written

NEW = ("keep_id", "group_size", "kept", "text_sha256")
SALTS = 16
#: Bytes of bitmaps, and groups of copies, that may be broadcast; beyond, they are joined by shuffle.
MAX_BITMAPS, MAX_GROUPS = 64 << 20, 100_000
#: Bytes of rows after which a task begins another part; a part's rows are held until their ranks are known.
PART_BYTES = 48 << 20


def golomb_encode(values: np.ndarray, span: int) -> bytes:
    """Sorted distinct numbers below ``span`` as Golomb-Rice gaps: u32 count, u8 k, unary part, low bits."""
    n = len(values)
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, min(63, int(math.log2(max(1.0, 0.69 * span / max(n, 1))))))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(high + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if k else np.zeros(0, np.uint8)
    head = np.packbits(unary).tobytes()
    return n.to_bytes(4, "little") + bytes([k]) + len(head).to_bytes(4, "little") + head + np.packbits(low.ravel()).tobytes()


def golomb_decode(raw: bytes) -> np.ndarray:
    n, k, size = int.from_bytes(raw[:4], "little"), raw[4], int.from_bytes(raw[5:9], "little")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, size, 9)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k and n:
        low = np.unpackbits(np.frombuffer(raw, np.uint8, offset=9 + size))[: n * k].reshape(n, k).astype(np.uint64)
        gaps |= np.bitwise_or.reduce(low << np.arange(k, dtype=np.uint64), axis=1)
    return np.cumsum(gaps, dtype=np.uint64)


def _place(rows: DataFrame, owners: int) -> DataFrame:
    """Rows with part, owner, rank (of the fingerprint among the part's for that owner), twin (seen before here).

    The first row of a part carries the part's messages, one to each owner, made of all its fingerprints: what is
    written may be read in other pieces, and a message of some rows would not be in step with the ranks.
    """
    span = -(-(2**64) // owners)
    message = pa.list_(pa.struct([("owner", pa.int32()), ("message", pa.binary())]))

    def ranked(held: list[pa.RecordBatch], part: int):
        prints = np.concatenate([b.column("print").to_numpy() for b in held]).view(np.uint64)
        distinct, back, count = np.unique(prints, return_inverse=True, return_counts=True)
        owner = (distinct // np.uint64(span)).astype(np.int32)
        rank = np.arange(len(distinct)) - np.searchsorted(owner, owner)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1)).tolist()
        sent = [{"owner": int(owner[a]), "message": golomb_encode(distinct[a:b] - np.uint64(int(owner[a]) * span), span)} for a, b in zip(cuts, [*cuts[1:], len(owner)])]
        at = 0
        for b in held:
            own = back[at : at + b.num_rows]
            first = [sent if at + i == 0 else None for i in range(b.num_rows)]
            yield b, {"part": pa.array(np.full(b.num_rows, part, np.int64)), "owner": pa.array(owner[own]), "rank": pa.array(rank[own].astype(np.int32)), "twin": pa.array(count[own] > 1), "row": pa.array(np.arange(at, at + b.num_rows, dtype=np.int64)), "sent": pa.array(first, message)}
            at += b.num_rows

    def run(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() << 24, []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.nbytes for b in held) >= PART_BYTES:
                yield from ranked(held, part)
                part, held = part + 1, []
        if held:
            yield from ranked(held, part)

    return with_arrow(rows, run, "part long, owner int, rank int, twin boolean, row long, sent array<struct<owner:int,message:binary>>")


def _messages(places: DataFrame) -> DataFrame:
    """The Golomb-coded message from each part to each owner."""
    return places.where(F.col("sent").isNotNull()).select("part", F.inline("sent"))


def _answers(messages: DataFrame) -> DataFrame:
    """Each owner's bitmaps: part, owner, words (64 ranks each), for parts that have any duplicate."""

    def run(key, table):
        sent = [golomb_decode(m) for m in table.column("message").to_pylist()]
        values, count = np.unique(np.concatenate(sent), return_counts=True)
        twice = values[count > 1]
        rows = []
        for part, own in zip(table.column("part").to_pylist(), sent, strict=True):
            hit = np.isin(own, twice, assume_unique=True)
            if hit.any():
                bits = np.packbits(np.concatenate([hit, np.zeros(-len(hit) % 64, bool)]), bitorder="little").view("<i8")
                rows.append({"part": part, "owner": key[0].as_py(), "words": bits.tolist()})
        return pa.Table.from_pylist(rows, schema=pa.schema([("part", pa.int64()), ("owner", pa.int32()), ("words", pa.list_(pa.int64()))]))

    return messages.groupBy("owner").applyInArrow(run, "part long, owner int, words array<long>")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256; without ``keep_text`` only the id is carried along.

    ``owners`` should grow with the table, as shuffle partitions do (the default): an owner holds about
    8 bytes * rows / owners.
    """
    spark = docs.sparkSession
    small_batches(spark)
    owners = owners or int(spark.conf.get("spark.sql.shuffle.partitions"))
    carried = [c for c in docs.columns if c.lower() not in NEW and c != text_col] if keep_text else [id_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc"), F.col(text_col).isNull().alias("void"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("id"))
    rows = rows.withColumns({"print": F.xxhash64("text"), "sha": F.sha2(F.col("text").cast("binary"), 256)})
    placed = written(_place(rows, owners), "prints")
    bitmaps = written(_answers(_messages(placed)), "bitmaps")
    size = bitmaps.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0] * 8
    bitmaps = bitmaps.select(F.col("part").alias("p"), F.col("owner").alias("o"), "words")
    hit = F.getbit(F.element_at("words", (F.floor(F.col("rank") / 64) + 1).cast("int")), F.col("rank") % 64) == 1
    on = (F.col("part") == F.col("p")) & (F.col("owner") == F.col("o"))
    asked = placed.join(F.broadcast(bitmaps) if size <= MAX_BITMAPS else bitmaps, on, "left").withColumn("suspect", F.col("twin") | F.coalesce(hit, F.lit(False)))
    # byte verification: groups of identical texts; max keeps (doc_id, part, row), null doc_ids lowest
    top = F.max(F.struct(F.col("id"), F.col("part"), F.col("row"))).alias("top")
    groups = asked.where("suspect").groupBy("text").agg(top, F.count("*").alias("n"), F.first("sha").alias("sha")).where("n > 1").select("sha", "top", "n")
    groups = written(groups, "groups")
    many = groups.count()
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = asked if keep_text else asked.drop("text")
    # rows that nobody suspects are on their own and are not shuffled
    alone = keys.where("not suspect").select("*", F.lit(None).cast(groups.schema["top"].dataType).alias("top"), F.lit(None).cast("long").alias("n"))
    shared = keys.where("suspect")
    if many <= MAX_GROUPS:
        shared = shared.join(F.broadcast(groups), "sha", "left")
    else:
        shared = shared.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"], "left").drop("salt")
    out = alone.unionByName(shared)
    alone = F.col("n").isNull()
    kept = alone | ((F.col("part") == F.col("top.part")) & (F.col("row") == F.col("top.row")))
    columns = [F.col(f"doc.`{c}`").alias(c) for c in carried]
    if keep_text:
        text = F.when(~F.col("void"), F.col("text")).alias(text_col)
        columns = [text if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c.lower() not in NEW]
    return out.select(*columns, F.when(alone, F.col("id")).otherwise(F.col("top.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
