"""Near-duplicate groups: one-permutation MinHash, banded buckets, star edges, links confirmed on full sets.

1. A text's set is its distinct shingles of ``SHINGLE`` words, as 64-bit hashes. Texts with equal sets (128 bits of
   hash) are one node from here on, named by its least row.
2. One-permutation hashing: the top bits of a shingle's hash choose its bin, the least value in a bin is kept (16
   bits of it), and empty bins borrow from others in the order of a fixed random table (optimal densification).
   Bands of ``ROWS`` bins give the buckets. A pair with similarity 0.8 shares none of the 32 buckets with a chance
   below 1e-7, and fewer than two with one of about 1e-6.
3. A bucket's nodes are joined by star edges to two centres, its least node and the one with most neighbours in all
   its buckets (in a group of edited copies, the text they were made from); so edges are at most twice the rows.
   Edges whose signatures agree enough are confirmed on full sets, made from the two texts. Connected components
   of the links follow.
4. Nodes of one bucket that are in different components after that may be linked without a centre. They are
   compared inside tasks: signatures first, then full sets, the likeliest first, and none that are in one component
   by then. A pair is compared in one of the buckets it shares, two at least; only links that join components
   leave a task, so no pairs are stored or shuffled. A bucket of more than ``BLOCK`` nodes is dealt in blocks, each
   two of which meet once; no bucket is capped.

Texts travel for edges that passed the signatures and to buckets that still hold several components; sets are
never stored.

Edge cases: a null, empty or blank text has an empty set and links with nothing; fewer than five words are one
shingle. Null doc_ids take part; a component of nothing but null doc_ids has a null component_id and nothing of
it is kept but one row. Rows that share the kept doc_id: one of them is kept. Very long texts are compared whole;
Arrow batches are bounded in bytes. Empty tables give empty results. Other columns pass through; those named like
a new column (n_shingles, component_id, kept) are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, small_batches, trim, with_arrow, written

SHINGLE, BINS, ROWS = 5, 128, 4
BANDS, SALTS = BINS // ROWS, 16
#: Signatures that agree by so much less than the threshold exclude a link (over five standard deviations).
MARGIN = 0.2
#: Rows of ids that may be broadcast; beyond, they are joined by shuffle.
MAX_IDS = 1_000_000
#: Nodes of a block, shingles of its sets at most (about), and sets that are compared with one at a time.
BLOCK, BLOCK_SHINGLES, CHUNK = 1024, 1 << 20, 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    """Hashes of words, computed once; cleared when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    size = min(n, SHINGLE)
    h = np.full(n - size + 1, size, np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
    for i in range(size):
        h = (h ^ w[i : n - size + 1 + i]) * _ODD[i]
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h))


_DONORS = np.random.default_rng(20240601).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each bin; an empty bin takes the first filled one's, in its own random order."""
    bins = (s >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    filled, first = np.unique(bins, return_index=True)
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[filled], full[filled] = s[first], True  # sorted, so the first of a bin is its least
    empty = np.flatnonzero(~full)
    if len(empty):
        donors = _DONORS[empty]
        out[empty] = out[donors[np.arange(len(empty)), full[donors].argmax(1)]] ^ np.uint64(0x5BD1E995)
    return (out & np.uint64(0xFFFF)).astype("<u2")


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (the other columns), text, id, and of each row: its number, set size, two hashes of the set, signature."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rows = docs.select(doc.alias("doc"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                s = shingles(text or "")
                raw = s.tobytes()
                out.append((row, len(s), xxhash.xxh3_64_intdigest(raw) - 2**63, xxhash.xxh64_intdigest(raw, 7) - 2**63, signature(s).tobytes() if len(s) else None))
                row += 1
            cols = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield batch, dict(zip(("row", "n", "k1", "k2", "sig"), (pa.array(list(x), t) for x, t in zip(cols, types, strict=True)), strict=True))

    return with_arrow(rows, run, "row long, n int, k1 long, k2 long, sig binary")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """A side whose number of rows was counted: broadcast up to MAX_IDS, else shuffled."""
    return F.broadcast(df) if rows <= MAX_IDS else df


def _sets(rows: DataFrame) -> DataFrame:
    """A row per distinct set: k1, k2, node (its least row), n, sig, first (the row that stands for it), copies."""
    first = F.min(F.struct(F.col("id").isNull().alias("void"), "id", "row")).alias("first")
    return rows.where("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig"), first, F.count("*").alias("copies"))


def _members(sets: DataFrame) -> DataFrame:
    """(key, band, node, size) of the buckets with more than one node."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])
    bands = sets.select("node", F.posexplode(keys).alias("band", "key"))
    return bands.join(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _links(edges: DataFrame, active: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose full sets are similar enough; ``active`` (node, n, sig) and ``bodies`` (node, text)."""
    side = lambda x: active.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    sized = edges.join(side("b"), "b").join(side("a"), "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    sure = percent / 100 - MARGIN

    def agree(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BINS) for c in ("sa", "sb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array((a == b).mean(1) >= sure))

    likely = sized.select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")
    both = likely.join(bodies.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(bodies.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")

    def confirm(batches):
        for batch in batches:
            made: dict[int, np.ndarray] = {}  # a centre's set is made once a batch
            hit = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                for node, text in ((a, ta), (b, tb)):
                    if node not in made:
                        made[node] = shingles(text)
                hit.append(_similar(made[a], made[b], percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(confirm, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable over edges (a, b). Least labels spread and labels of labels are
    taken, so long chains end in a logarithmic number of rounds; only counts reach the driver."""
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    rows = labels.count()
    while True:
        near = both.join(_sent(labels.select(F.col("node").alias("b"), "comp"), rows), "b").select(F.col("a").alias("node"), "comp", F.lit(None).cast("long").alias("own"))
        low = near.unionByName(labels.select("node", "comp", F.col("comp").alias("own"))).groupBy("node").agg(F.min("comp").alias("mid"), F.max("own").alias("old"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        new = written(low.join(_sent(jump, rows), "mid").select("node", "old", F.least("mid", "far").alias("comp")), "labels")
        removed(labels)
        labels = new
        if not new.where("old <> comp").limit(1).count():
            removed(both)
            out = new.select("node", "comp")
            out._written_to = new._written_to
            return out


def _edge(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _stars(members: DataFrame, active: DataFrame) -> DataFrame:
    """(a, b): each bucket's nodes to its least node and to the one with most bucket neighbours."""
    # degree and hash bits in one number
    prio = F.shiftleft(F.least("degree", F.lit(1 << 30)), 32) + F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(1 << 32))
    ranked = members.join(active.select("node", prio.alias("prio")), "node")
    hearts = ranked.groupBy("key").agg(F.array(F.min("node"), F.max_by("node", "prio")).alias("hearts"))
    return members.join(hearts, "key").select("node", F.explode("hearts").alias("a")).where("node <> a").select(*_edge("a", "node")).distinct()


def _mixed(members: DataFrame, least: int) -> DataFrame:
    """Buckets of at least ``least`` nodes that hold several components: key, size, shingles."""
    sums = members.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return sums.where(f"size >= {least} and lo <> hi").select("key", "size", "shingles")


def _settle(rows: pa.Table, percent: int) -> pa.Table:
    """Links that join components among one block's nodes, or between two blocks (side 0 and 1)."""
    node, comp, side, sizes = (rows.column(c).to_numpy() for c in ("node", "comp", "side", "n"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(-1, BINS)
    bands, band, texts = sig.view("<u8"), rows.column("band")[0].as_py(), rows.column("text")
    made: dict[int, np.ndarray] = {}
    root = {c: c for c in set(comp.tolist())}
    sure = percent / 100 - MARGIN

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    def set_of(i):
        if i not in made:
            made[i] = shingles(texts[i].as_py())
        return made[i]

    def here(i, others):
        """Whether a pair belongs to this bucket: of the bands it shares, the first from a place of its own on."""
        same = bands[others] == bands[i]
        turn = (np.bitwise_xor(node[others], node[i]) * 0x9E3779B1 >> 7) % BANDS
        at = (np.arange(BANDS) + turn[:, None]) % BANDS
        first = np.take_along_axis(same, at, 1).argmax(1)
        return (same.sum(1) > 1) & ((first + turn) % BANDS == band)

    found, right = [], np.flatnonzero(side != 0)
    for i in np.flatnonzero(side != 1).tolist():
        j = right[right > i] if side[i] == 2 else right
        j = j[(comp[j] != comp[i]) & (100 * np.minimum(sizes[j], sizes[i]) >= percent * np.maximum(sizes[j], sizes[i]))]
        if len(j):
            like = (sig[j] == sig[i]).mean(1)
            j, like = j[like >= sure], like[like >= sure]
        if len(j):
            own = here(i, j)
            j = j[own][np.argsort(-like[own], kind="stable")]
        while len(j):
            j = j[[find(c) != find(int(comp[i])) for c in comp[j].tolist()]]
            some, j = j[:CHUNK], j[CHUNK:]
            for k in some.tolist():
                p, q = find(int(comp[i])), find(int(comp[k]))
                if p != q and _similar(set_of(i), set_of(k), percent):
                    root[p] = q
                    found.append((int(node[i]), int(node[k])))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _linked(members: DataFrame, active: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """(node, comp) of all linked nodes."""
    links = written(_links(_stars(members, active), active, bodies, percent), "links")
    labels = components(links)
    named = members.select("key", "band", "node").join(_sent(labels, labels.count()), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = written(named.join(active.select("node", "n"), "node"), "named")
    # a bucket of two nodes is settled by its star edge, and a pair that is alike meets in two buckets or more
    open_ = written(named.join(_mixed(named, 3).select("key"), "key", "left_semi"), "open")
    often = open_.groupBy("node").agg(F.count("*").alias("times")).where("times > 1").select("node")
    left = open_.join(often, "node", "left_semi")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    placed = left.join(_mixed(left, 2).select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64(F.lit(9), "node"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    dealt = pairs.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), side.alias("side"), "band", "node", "n", "comp")
    dealt = dealt.join(active.select("node", "sig"), "node").join(bodies, "node")

    def settled(rows):
        found = _settle(rows, percent)
        del rows
        trim()
        return found

    more = written(dealt.groupBy("key", "x", "y").applyInArrow(settled, "a long, b long"), "more")
    removed(named, open_)
    if more.limit(1).count():
        removed(labels)
        labels = components(links.unionByName(more))
    removed(links, more)
    return labels


def _decided(sets: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """(k1, k2, component_id, first_row, salt) of the sets whose component has several rows, and their number."""
    count = labels.count()
    own = sets.select("k1", "k2", "node", "first", "copies").join(_sent(labels, count), "node", "left").where("comp is not null or copies > 1")
    own = written(own.select("k1", "k2", F.coalesce("comp", "node").alias("comp"), "first", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("part")), "own")
    salts = lambda name: F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(name)
    best = own.groupBy("comp").agg(F.min("first").alias("m")).select("comp", F.col("m.id").alias("component_id"), F.col("m.row").alias("first_row"), salts("part"))
    out = written(own.select("k1", "k2", "comp", "part").join(best, ["comp", "part"]).select("k1", "k2", "component_id", "first_row"), "decided")
    removed(own)
    return out.select("*", salts("salt")), out.count() * SALTS


def near_groups(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows as prepared, decisions): row, id, n, component_id, kept of each row of ``docs``."""
    small_batches(docs.sparkSession, 250)
    rows = written(_prepared(docs, id_col, text_col), "rows")
    sets = written(_sets(rows), "sets")
    members = written(_members(sets), "members")
    touched = written(members.groupBy("node").agg(F.sum("size").alias("degree")), "touched")
    count = touched.count()
    active = written(sets.select("node", "n", "sig").join(_sent(touched, count), "node"), "active")
    bodies = written(rows.select(F.col("row").alias("node"), "text").join(_sent(touched.select("node"), count), "node", "left_semi"), "bodies")
    labels = _linked(members, active, bodies, percent)
    removed(members, touched, active, bodies)
    decided, many = _decided(sets, labels)
    removed(sets, labels)
    own = rows.select("row", "id", "n", "k1", "k2", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    out = own.join(_sent(decided, many), ["k1", "k2", "salt"], "left")
    alone = F.col("first_row").isNull()
    return rows, out.select("row", "id", "n", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("row") == F.col("first_row"))).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    _, out = near_groups(docs.select(id_col, text_col), percent, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose near-duplicate group is represented by another row.

    Exactly one row of each group stays, that with the smallest doc_id (nulls last); texts without words stay.
    """
    rows, decided = near_groups(docs, percent, id_col, text_col)
    gone = written(decided.where("not kept").select("row"), "gone")
    left = rows.join(_sent(gone, gone.count()), "row", "left_anti")
    return left.select(*[F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
