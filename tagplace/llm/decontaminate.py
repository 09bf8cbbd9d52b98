"""Benchmark decontamination: one Aho-Corasick automaton over normalised test texts, texts scanned once.

Normalised text: A-Z lower-cased, words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by one space. A window is
``width`` consecutive words of an item (the whole item if it has fewer words). The automaton holds the windows
with a space on either side and runs over the bytes of each normalised text; word numbers of a match are
counted from the spaces, and spans are mapped to characters of the original text.

The windows reach the tasks as a broadcast of a checked size, ``MAX_WINDOW_BYTES``; a larger benchmark is dealt
into groups of items by their hash, and the texts pass one automaton after the other.

Very long texts are scanned whole.

Edge cases: a null text or item has no words and no windows; a null item_id counts as an item without a name.
Items that share an item_id are one item. Empty tables give no hits. Other columns pass through; those named
like a new column (n_words, n_hit, n_items, items_sha256, contaminated, spans, items) are replaced.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, with_arrow

#: Bytes of windows in one automaton, which takes some 60 bytes for each in every Python worker.
MAX_WINDOW_BYTES = 4 << 20
#: Word bytes stay, A-Z are lower-cased, all else is a space.
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
NEW = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>, items array<string>, _hits binary"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def item_windows(item: str, width: int) -> list[bytes]:
    words = words_of(item)
    return [b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))] if words else []


_BUILT: dict[str, object] = {}


def _automaton(windows: list[tuple[bytes, tuple[str, ...]]], key: str):
    """The automaton of these windows, made once per Python worker."""
    if _BUILT.get("key") != key:
        import ahocorasick

        made = ahocorasick.Automaton()
        for window, items in windows:
            made.add_word(window.decode("latin-1"), (window.count(b" ") - 1, items))
        if windows:
            made.make_automaton()
        _BUILT.update(key=key, automaton=made)
    return _BUILT["automaton"]


def _scan(docs: DataFrame, windows: list[tuple[bytes, tuple[str, ...]]], text_col: str, again: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(windows)
    key = hashlib.sha256(b"\0".join(w for w, _ in windows)).hexdigest()

    def run(batches):
        automaton = _automaton(sent.value, key)
        for batch in batches:
            rows = []
            olds = zip(batch.column("_hits").to_pylist(), batch.column("items").to_pylist()) if again else None
            for text in batch.column(text_col).to_pylist():
                text = text or ""
                words = words_of(text)
                normal = " " + b" ".join(words).decode("latin-1") + " "
                hit, items = np.zeros(len(words), bool), set()
                if olds:
                    old, before = next(olds)
                    hit |= np.unpackbits(np.frombuffer(old, np.uint8), count=len(words)).astype(bool)
                    items.update(before)
                found = list(automaton.iter(normal)) if len(automaton) and words else []
                if found:
                    # the space that ends a match closes word number (spaces up to it) - 2
                    spaces = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)
                    last = np.searchsorted(spaces, [end for end, _ in found])
                    for end, (_, (size, own)) in zip(last.tolist(), found, strict=True):
                        hit[end - size : end] = True
                        items.update(own)
                spans = []
                if hit.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    at = [m.span() for m in _WORD.finditer(text)]
                    spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                names = sorted(items)
                rows.append((len(words), int(hit.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit.any()), spans, names, np.packbits(hit).tobytes()))
            columns = list(zip(*rows)) or [()] * 8
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), span, pa.list_(pa.string()), pa.binary()]
            yield batch, {name.split()[0]: pa.array(list(x), t) for name, x, t in zip(("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items", "_hits"), columns, types, strict=True)}

    return with_arrow(docs, run, NEW)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with counts of words hit, the items found, and the spans in the original text."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] * width
    groups = max(1, -(-size // MAX_WINDOW_BYTES))
    out = docs
    for g in range(groups):
        owners: dict[bytes, set[str]] = {}
        for r in items.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).collect():  # about MAX_WINDOW_BYTES / width of text
            for w in item_windows(r["text"], width):
                owners.setdefault(w, set()).add(r["id"])
        out = _scan(out, [(w, tuple(sorted(o))) for w, o in sorted(owners.items())], text_col, g > 0)
    return out.drop("_hits")
