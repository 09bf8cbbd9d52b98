"""The Merkle manifest against a brute-force tree; odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tagplace.llm import merkle
from tagplace.llm import queries as Q


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Root, and each leaf's siblings up to it."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H(*now[i : i + 2]) for i in range(0, len(now), 2)])
    near = []
    for i in range(len(leaves)):
        near.append([(now[(i >> h) ^ 1] if (i >> h) ^ 1 < len(now) else "", (i >> h) & 1) for h, now in enumerate(levels[:-1])])
    return levels[-1][0], near


def brute(rows):
    """(key, order, leaf) -> multiset of (key, order, leaf, subroot, root, steps)."""
    trees = {}
    for key, order, leaf in rows:
        trees.setdefault(key, []).append((order is not None, order or 0, leaf))
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    made = {k: tree([x[2] for x in sorted(trees[k])]) for k in keys}
    root, above = tree([made[k][0] for k in keys])
    out = []
    for k, more in zip(keys, above, strict=True):
        for (there, order, leaf), near in zip(sorted(trees[k]), made[k][1], strict=True):
            out.append((k, order if there else None, leaf, made[k][0], root, tuple(near + more)))
    return sorted(map(str, out))


def shown(df):
    steps = lambda r: tuple((s.left or s.right, int(bool(s.left))) for s in r.steps)
    return sorted(str((r.k, r.order, r.leaf, r.subroot, r.root, steps(r))) for r in df.collect())


def plain(x):
    """Brute force says left also for a missing sibling."""
    return [r.replace("('', 1)", "('', 0)") for r in x]


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_brute_force(spark, height):
    rng = random.Random(height)
    sizes = {None: 3, "": 1, "a": 8, "b": 9, "Z": 2, "é": 31, "zz": 4}
    rows = [(k, rng.choice([None, *range(20)]), H(str(rng.randrange(40)))) for k, n in sizes.items() for _ in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, order long, leaf string").withColumn("tree", merkle.tree_key(F.col("k"))).repartition(3)
    out = merkle.manifest(df, ["order"], height)
    assert plain(shown(out)) == plain(brute(rows))
    folded = out.select(merkle.fold(F.col("leaf"), F.col("steps")).alias("x"), "root").collect()
    assert all(r.x == r.root for r in folded)
    bad = out.select(merkle.fold(F.lit(H("other")), F.col("steps")).alias("x"), "root").collect()
    assert all(r.x != r.root for r in bad)


def test_store_levels(spark):
    rows = spark.range(37).select(F.lit("t").alias("tree"), "id", F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("leaf"))
    m = merkle.build(rows, ["id"], 2)
    want = [H(str(i)) for i in range(37)]
    assert [r.leaf for r in m.leaves.orderBy("idx").collect()] == want
    level = 0
    while len(want) > 1:
        want, level = [H(*want[i : i + 2]) for i in range(0, len(want), 2)], level + 1
        got = m.nodes().where(F.col("level") == level).select("idx", "digest").distinct().orderBy("idx").collect()
        assert [tuple(r) for r in got] == list(enumerate(want))
    assert m.tiers == [0, 2, 4] and m.roots.collect()[0].root == want[0]


def test_one_leaf_and_none(spark):
    one = spark.createDataFrame([("x", 1, H("1"))], "tree string, order long, leaf string")
    r = merkle.manifest(one, ["order"]).collect()
    assert len(r) == 1 and r[0].root == r[0].subroot == H("1") and r[0].steps == []
    assert merkle.manifest(one.limit(0), ["order"]).count() == 0


def test_many_equal_rows(spark):
    rows = spark.range(3000).select(F.lit("x").alias("tree"), F.lit(None).cast("long").alias("order"), F.lit(H("same")).alias("leaf"))
    out = merkle.manifest(rows, ["order"])
    assert out.select("idx").distinct().count() == 3000
    assert {r.x for r in out.select((merkle.fold(F.col("leaf"), F.col("steps")) == F.col("root")).alias("x")).distinct().collect()} == {True}


def test_query_odd_rows(spark, tmp_path):
    rows = [(1, "s", "en", 3, "abc"), (1, "s", "en", 3, "abc"), (None, None, None, None, None), (7, "", "", 0, ""), (2, "é", "de", None, "x" * 300_000), (21, "s", None, 5, "a:-"), (0, "s", "en", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit("old")).withColumn("Tree", F.lit("old"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op11_merkle(spark, str(tmp_path)).collect()
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    assert sorted(r.leaf for r in got) == sorted(H("".join(map(field, r))) for r in rows)
    import zlib

    for r in got:
        n = next(x[3] for x in rows if x[0] == r.doc_id)
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and n is not None
        assert r.verified == (not hit) == (r.folded_root == r.root)
    want = brute([(x[2], x[0], H("".join(map(field, x)))) for x in rows])
    assert len(want) == len(got) and all(f"'{r.subroot}', '{r.root}'" in str(want) for r in got)
