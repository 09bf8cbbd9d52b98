"""Merkle dataset manifest over an external-memory node store.

Leaves are dealt by range of (tree, order) into sorted runs, written once with their place in the run; the rows of
a tree before a run are summed over the runs, so every leaf gets a coordinate (tree, idx) without a window over the
table. Nodes live in Parquet, partitioned by level and sorted by coordinate. Levels are made upwards: a chunk of
``2 ** HEIGHT`` consecutive nodes of one tree is read in order and each level is hashed from the one below it, up to
the chunk's top; the tops are the next tier's nodes. Proofs go down again: the leaves (or a tier's nodes) and the
stored levels of the same chunk are merge-scanned by coordinate together with the chunk top's own proof. A task
holds one chunk at a time, so a tree with a third of all rows, or all of them, is no hot key.

``H`` is the lowercase hex SHA-256 of its inputs joined, digests as hex text. Every two consecutive nodes become
their H while a tree has several; a last one without a partner becomes its own H. A tree of one leaf is its root.

Edge cases: trees and order keys may be null (nulls first, one tree for all null keys); rows with equal order keys
are ordered by their leaves, equal leaves are interchangeable. An empty table has no leaves and no root. Empty and
very long texts are leaves like others: only digests are shuffled. Other columns of ``rows`` ride along with the
leaves; columns named like the new ones (``tree``, ``idx``,
``leaf``, ``steps``, ``subroot``) must be renamed before.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, removed, small_batches, with_arrow, written

#: Levels of a chunk: a task holds up to 2 ** HEIGHT nodes of a level.
HEIGHT = 10
#: kind: ``top`` of a chunk, which the next tier goes on with; ``root`` of a tree; null between.
NODE = "tree string, level int, tier int, idx long, digest string, kind string"
STEPS = "array<struct<left:string,right:string>>"


def field_text(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value (integers as decimals)."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*columns: Column) -> Column:
    """The leaf of a row: H of its fields' texts."""
    return F.sha2(F.concat(*[field_text(c) for c in columns]).cast("binary"), 256)


def tree_key(column: Column) -> Column:
    """A key without nulls that sorts like ``column`` does: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("+"), column.cast("string")), F.lit(""))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` and its proof lead to."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def proof_digest(steps: Column) -> Column:
    """H of all siblings of a proof, level by level."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def _hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


@dataclass
class Manifest:
    """leaves: the given rows with tree, idx, leaf. store: path of the node levels. tiers: base level of each tier,
    lowest first. roots: tree, root, tier (base level of the tier where the tree ends). height: levels of a chunk."""

    leaves: DataFrame
    store: str
    tiers: list[int]
    roots: DataFrame
    height: int

    def nodes(self) -> DataFrame:
        """level, tree, idx, digest of all stored nodes (level 0, the leaves, is the table ``leaves``)."""
        return self.leaves.sparkSession.read.schema(NODE).parquet(self.store)


def _runs(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` in sorted runs, written: run, the place among the rows of its tree there, and whether the tree is the
    run's first one."""

    def run(batches):
        first, tree, k = None, None, 0
        for b in batches:
            places, heads = [], []
            for x in b.column("tree").to_pylist():
                if x != tree:
                    tree, k = x, 0
                if first is None:
                    first = x
                places.append(k)
                heads.append(x == first)
                k += 1
            yield b, {"place": pa.array(places, pa.int64()), "head": pa.array(heads, pa.bool_())}

    keys = ["tree", *order, "leaf"]
    # rows that are equal in all keys are interchangeable: the row number only lets them spread over runs
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys, "_row").sortWithinPartitions(*keys).drop("_row")
    return written(with_arrow(dealt.withColumn("run", F.spark_partition_id()), run, "place long, head boolean"), "runs")


def _numbered(runs: DataFrame) -> DataFrame:
    """Leaves with idx: what earlier runs hold of a run's first tree is added; one number a run reaches the driver."""
    tops = F.max(F.struct("tree", "place"))
    ends = runs.groupBy("run").agg(F.min("tree").alias("first"), tops.alias("last")).orderBy("run").collect()
    before, tree, n = [], None, 0
    for r in ends:
        if r["first"] != tree:
            tree, n = r["first"], 0
        before.append((r["run"], n))
        n = (n if r["last"]["tree"] == tree else 0) + r["last"]["place"] + 1
        tree = r["last"]["tree"]
    table = runs.sparkSession.createDataFrame(before, "run int, before long")
    idx = F.col("place") + F.when(F.col("head"), F.col("before")).otherwise(0)
    return runs.join(F.broadcast(table), "run").select(*[c for c in runs.columns if c not in ("run", "place", "head")], idx.alias("idx"))


def _levels(base: DataFrame, level: int, height: int) -> DataFrame:
    """Nodes of all levels above ``level`` that chunks of its nodes (tree, idx, digest) give, and the roots of trees
    that end here. A tree's only node is its root."""

    def run(key, table):
        tree, chunk = key[0].as_py(), key[1].as_py()
        now = [d for _, d in sorted(zip(table.column("idx").to_pylist(), table.column("digest").to_pylist(), strict=True))]
        # a tree's only chunk ends with one node, any other at its full height
        small, h = chunk == 0 and len(now) < 1 << height, 0
        out = [(level, 0, now[0], "root")] if small and len(now) == 1 else []
        while h < height and not (small and len(now) == 1):
            now = [_hash(*now[i : i + 2]) for i in range(0, len(now), 2)]
            h += 1
            kind = "root" if small and len(now) == 1 else "top" if h == height else None
            out += [(level + h, (chunk << height - h) + i, d, kind) for i, d in enumerate(now)]
        levels, places, digests, kinds = zip(*out, strict=True)
        return pa.table({"tree": pa.array([tree] * len(out)), "level": pa.array(levels, pa.int32()), "tier": pa.array([level] * len(out), pa.int32()), "idx": pa.array(places, pa.int64()), "digest": pa.array(digests), "kind": pa.array(kinds, pa.string())})

    return base.select("tree", "idx", "digest", F.shiftright("idx", height).alias("chunk")).groupBy("tree", "chunk").applyInArrow(run, NODE)


def build(rows: DataFrame, order: list[str], height: int = HEIGHT) -> Manifest:
    """The manifest of ``rows`` (tree string without nulls, leaf, the ``order`` columns, any others)."""
    spark = rows.sparkSession
    small_batches(spark)
    runs = _runs(rows, order)
    leaves = written(_numbered(runs), "leaves")
    removed(runs)
    store, tiers, roots = fresh_path(spark, "nodes"), [], None
    base = leaves.select("tree", "idx", F.col("leaf").alias("digest"))
    while base is not None:
        level = height * len(tiers)
        made = written(_levels(base, level, height), "levels")
        # sorted files, each a range of (level, coordinate)
        made.repartitionByRange("level", "tree", "idx").sortWithinPartitions("level", "tree", "idx").write.partitionBy("level").mode("append").parquet(store)
        removed(made)
        tiers.append(level)
        nodes = spark.read.schema(NODE).parquet(store)
        ended = nodes.where((F.col("kind") == "root") & (F.col("tier") == level)).select("tree", F.col("digest").alias("root"), F.lit(level).alias("tier"))
        roots = ended if roots is None else roots.unionByName(ended)
        base = nodes.where((F.col("kind") == "top") & (F.col("level") == level + height)).select("tree", "idx", "digest")
        base = base if base.take(1) else None
    return Manifest(leaves, store, tiers, roots, height)


def _descended(rows: DataFrame, nodes: DataFrame, upper: DataFrame, level: int, height: int) -> DataFrame:
    """``rows`` (tree, idx, digest, others) of ``level`` with steps and subroot: a merge scan, chunk by chunk, with the
    stored ``nodes`` up to the chunk's top and with the top's own steps and subroot in ``upper``."""
    none = lambda kind: F.lit(None).cast(kind)
    stored = nodes.where((F.col("level") > level) & (F.col("level") <= level + height)).select(
        "tree", F.expr(f"shiftright(idx, {level + height} - level)").alias("chunk"), (F.col("level") - level).alias("h"), "idx", "digest", none(STEPS).alias("steps"), none("string").alias("subroot"),
    )
    ends = upper.select("tree", F.col("idx").alias("chunk"), none("int").alias("h"), none("long").alias("idx"), none("string").alias("digest"), "steps", "subroot")
    step = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def run(_, own, store):
        places = own.column("idx").to_pylist()
        levels = [dict(zip(places, own.column("digest").to_pylist(), strict=True))] + [{} for _ in range(height)]
        rest, subroot = [], None
        for h, i, d, s, r in zip(*(store.column(c).to_pylist() for c in ("h", "idx", "digest", "steps", "subroot")), strict=True):
            if h is None:
                rest, subroot = s, r
            else:
                levels[h][i] = d
        top, steps = max(h for h in range(height + 1) if levels[h] or not h), []
        for i in places:
            near = [(levels[h].get((i >> h) ^ 1, ""), (i >> h) & 1) for h in range(top)]
            steps.append([{"left": d, "right": ""} if right else {"left": "", "right": d} for d, right in near] + rest)
        made = own.drop_columns(["chunk"]).append_column("steps", pa.array(steps, step))
        return made.append_column("subroot", pa.array([subroot] * len(places), pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", steps {STEPS}, subroot string"
    left = rows.withColumn("chunk", F.shiftright("idx", height))
    return left.groupBy("tree", "chunk").cogroup(stored.unionByName(ends).groupBy("tree", "chunk")).applyInArrow(run, schema)


def proofs(manifest: Manifest, given: DataFrame | None = None) -> DataFrame:
    """The leaves with subroot (their tree's root) and steps: for each level up to it the sibling on the left or on the
    right, or neither. ``given`` (tree, more): steps that lead on from a tree's root."""
    ends = manifest.roots.select("tree", "tier", F.lit(0).cast("long").alias("idx"), F.col("root").alias("subroot"))
    if given is None:
        ends = ends.withColumn("steps", F.array().cast(STEPS))
    else:
        ends = ends.join(given.select("tree", F.col("more").alias("steps")), "tree")
    nodes, upper = manifest.nodes(), None
    for level in reversed(manifest.tiers):
        here = ends.where(F.col("tier") == level).select("tree", "idx", "steps", "subroot")
        here = here if upper is None else here.unionByName(upper)
        if level == 0:
            return _descended(manifest.leaves.withColumn("digest", F.col("leaf")), nodes, here, 0, manifest.height).drop("digest")
        # a read of its own: both sides of a merge scan must not share columns
        base = manifest.nodes().where((F.col("level") == level) & (F.col("kind") == "top")).select("tree", "idx", "digest")
        upper = written(_descended(base, nodes, here, level, manifest.height).select("tree", "idx", "steps", "subroot"), "steps")


def manifest(rows: DataFrame, order: list[str], height: int = HEIGHT) -> DataFrame:
    """``rows`` with idx, subroot, root and steps, which lead from the leaf through its tree's root to the root.

    The roots of the trees, in order of their keys, are the leaves of one more tree.
    """
    trees = build(rows, order, height)
    whole = build(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("root").alias("leaf")), ["own"], height)
    root = whole.roots.first()
    given = written(proofs(whole).select(F.col("own").alias("tree"), F.col("steps").alias("more")), "given")
    return proofs(trees, given).withColumn("root", F.lit(root["root"] if root else None).cast("string"))
