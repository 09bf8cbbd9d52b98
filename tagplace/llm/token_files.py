"""Token-id files: whole texts encoded, ids packed with word-aligned Simple-8b, written and read back.

Files are Parquet tables of blocks in ascending doc_id order; the packed ids are the binary ``payload``:

    magic "S8B1" | n_docs u32 | n_chunks u32 | n_escapes u32 | n_tokens u64
    | doc_id i64[n_docs] | doc_id given u8[n_docs] | tokens u64[n_docs]
    | first word of each chunk u64[n_chunks + 1] | words u64[...] | escaped values u64[n_escapes]

A chunk is ``CHUNK`` ids (the last may hold fewer). A word's top 4 bits are its selector, which says how many
ids of how many bits follow (``SELECTORS``); selector 15 is an escape: its low 60 bits are an index into the
escaped values, for numbers of more than 60 bits. Chunk offsets allow decoding any chunk without the others.

Edge cases: a null text is empty and gives only the end id. Null doc_ids sort first and stay null. Rows that
share a doc_id are ordered by length and checksum of their ids. An empty table gives an empty file. Further
input columns are ignored, whatever they are called.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, small_batches
from .tokens import default_tokenizer, encoded

#: (ids, bits) of selectors 0 to 14: fixed values of the word-aligned code; selector 15 is the escape.
SELECTORS = [(240, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE, CHUNK = 15, 1 << 16
_HEAD = struct.Struct("<4sIIIQ")
_COUNTS = np.array([n for n, _ in SELECTORS] + [1], np.int64)
#: Documents and ids in a block; a longer document is a block of its own.
BLOCK_DOCS, BLOCK_TOKENS = 4096, 1 << 20


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escaped values) of one chunk of unsigned 64-bit numbers."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    bits = np.zeros(n + 240, np.uint8)  # the padding fits anywhere
    bits[:n] = _bit_lengths(values)
    most, choice = {1: bits}, np.full(n, ESCAPE, np.uint8)
    widths = sorted(c for c, _ in SELECTORS)
    for a, c in zip(widths, widths[1:]):  # the most bits among c ids from each place on
        m, step = most[a], a
        while step < c:
            shift = min(a, c - step)
            m = np.maximum(m[: len(m) - shift], most[a][step : step + len(m) - shift] if shift == a else most[shift][step : step + len(m) - shift])
            step += shift
        most[c] = m
    for s in reversed(range(len(SELECTORS))):
        c, b = SELECTORS[s]
        choice[most[c][:n] <= b] = s
    step, at, i = _COUNTS[choice].tolist(), [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at)
    sel = choice[at]
    padded = np.zeros(n + 240, np.uint64)
    padded[:n] = values
    words = sel.astype(np.uint64) << np.uint64(60)
    for s, (c, b) in enumerate(SELECTORS):
        here = np.flatnonzero(sel == s)
        if b and len(here):
            group = padded[at[here][:, None] + np.arange(c)] << (np.arange(c, dtype=np.uint64) * np.uint64(b))
            words[here] |= np.bitwise_or.reduce(group, axis=1)
    out = np.flatnonzero(sel == ESCAPE)
    words[out] |= np.arange(len(out), dtype=np.uint64)
    return words, values[at[out]]


def unpack(words: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[sel]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    for s, (c, b) in enumerate(SELECTORS):
        here = np.flatnonzero(sel == s)
        if b and len(here):
            mask = np.uint64((1 << b) - 1)
            out[starts[here][:, None] + np.arange(c)] = (words[here][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(b))) & mask
    here = np.flatnonzero(sel == ESCAPE)
    out[starts[here]] = escaped[(words[here] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


def pack_block(doc_ids: list, counts: np.ndarray | list[int], ids: np.ndarray) -> bytes:
    """The payload of documents with these ids one after the other."""
    words, escapes, offsets, shift = [], [], [0], 0
    for i in range(0, len(ids), CHUNK):
        w, e = pack(ids[i : i + CHUNK].astype(np.uint64))
        w[(w >> np.uint64(60)) == ESCAPE] += np.uint64(shift)
        shift += len(e)
        words.append(w)
        escapes.append(e)
        offsets.append(offsets[-1] + len(w))
    given = np.array([x is not None for x in doc_ids], np.uint8)
    parts = [np.array([x or 0 for x in doc_ids], "<i8"), given, np.array(counts, "<u8"), np.array(offsets, "<u8"), *words, *escapes]
    return _HEAD.pack(b"S8B1", len(doc_ids), len(words), shift, len(ids)) + b"".join(x.tobytes() for x in parts)


def unpack_block(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a payload."""
    magic, docs, chunks, escapes, tokens = _HEAD.unpack_from(payload)
    if magic != b"S8B1":
        raise ValueError("not a token block")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(payload, kind, n, at)
        at += x.nbytes
        return x

    doc_ids, given, counts, offsets = take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u8", chunks + 1)
    words, escaped = take("<u8", int(offsets[-1])), take("<u8", escapes)
    parts = [unpack(words[int(offsets[i]) : int(offsets[i + 1])], escaped, min(CHUNK, tokens - i * CHUNK)) for i in range(chunks)]
    return [int(x) if y else None for x, y in zip(doc_ids, given, strict=True)], counts.astype(np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` to each, and write blocks in ascending order of ``id_col``.

    One range shuffle of the texts; then each task encodes and packs its range as a stream. Shuffling texts
    moves fewer bytes than shuffling ids.
    """
    tokenizer = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.length("text"), F.crc32(F.col("text").cast("binary")))

    def run(batches):
        from pyspark import TaskContext

        part, block, start = TaskContext.get().partitionId(), 0, 0
        for docs, ids, counts in encoded(tokenizer, batches, "text", end_id):
            ends, doc_ids, a = np.cumsum(counts), docs.column("doc_id").to_pylist(), 0
            while a < len(counts):
                low = int(ends[a] - counts[a])
                b = max(a + 1, min(a + BLOCK_DOCS, int(np.searchsorted(ends, low + BLOCK_TOKENS, side="right"))))
                own = ids[low : int(ends[b - 1])]
                payload = pack_block(doc_ids[a:b], counts[a:b], own)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([b - a], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([payload], pa.binary())], names=["part", "block", "part_start", "n_docs", "n_tokens", "payload"])
                block, start, a = block + 1, start + len(own), b

    rows.mapInArrow(run, "part int, block int, part_start long, n_docs int, n_tokens long, payload binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of token files: doc_id, start, n_tokens, ids_crc32 and, if asked, ids.

    ``start`` counts the ids of all documents before; it needs one number per written partition, summed up
    without reading payloads.
    """
    blocks = spark.read.schema("part int, block int, part_start long, n_docs int, n_tokens long, payload binary").parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each task that wrote
    before = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    based = blocks.join(F.broadcast(before), "part").select((F.col("base") + F.col("part_start")).alias("start"), "payload")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    small_batches(spark, 16)

    def run(batches):
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                doc_ids, counts, ids = unpack_block(payload)
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                spans = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
                columns = [pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return based.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_index(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the documents' tokens to a new place in the shared folder and return what the files hold."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
