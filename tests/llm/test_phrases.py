"""Phrase fingerprints: local consistency, likeness, the query against brute force, odd texts."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagplace.llm import phrases
from tagplace.llm import queries as Q


def like(a, b):
    if a == b:
        return 1.0
    if abs(int(a[0]) - int(b[0])) > 1:
        return 0.0
    x, y = (np.frombuffer(base64.b64decode(f[1:]), np.uint8).reshape(2, -1)[int(int(f[0]) < int(o[0]))] for f, o in ((a, b), (b, a)))
    same, both = ((x == y) & (x != 255)).sum(), ((x != 255) | (y != 255)).sum()
    return 2 * same / (both + same) if both else 0.0


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_phrases_cover_and_are_short():
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 200)) for _ in range(20)] + ["", "a", "ab", "aa", "aba" * 50, "a" * 5000, "\U0001f600é" * 40]
    before = [len(t) for t in texts]
    for names, doc in phrases.levels(texts, 6):
        assert len(names) == len(doc) and (np.diff(doc) >= 0).all()
        now = np.bincount(doc, minlength=len(texts))
        for n, m, t in zip(now, before, texts, strict=True):
            assert (n > 0) == bool(t) and n <= max(1, m / 2 + 1)
        before = now
    # without runs of equal symbols a phrase has at most four
    sizes = np.diff(np.append(phrases._starts(np.random.default_rng(2).permutation(5000).astype(np.uint32), np.array([0])), 5000))
    assert sizes[1:-1].min() >= 2 and sizes.max() <= 4


def test_alike_in_any_company():
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(30)] + ["", "x", "xx"]
    alone = [phrases.fingerprints_of([t])[0] for t in texts]
    assert phrases.fingerprints_of(texts) == alone and phrases.fingerprints_of(texts[::-1]) == alone[::-1]


@pytest.mark.parametrize("shift", [1, 2, 3, 5, 8, 13])
def test_equal_substrings_share_names(shift):
    """Whatever stands before, all but a bounded number of names of a common part are the same."""
    rng = random.Random(shift)
    common = prose(rng, 400)
    a, b = prose(rng, shift) + common, prose(rng, 2 * shift + 1) + common
    for level, (names, doc) in enumerate(phrases.levels([a, b], 5), 1):
        own, other = (names[doc == k].tolist() for k in (0, 1))
        same = next((i for i, (x, y) in enumerate(zip(own[::-1], other[::-1], strict=False)) if x != y), min(len(own), len(other)))
        lost = len(common) / np.mean([len(common) / max(1, same)]) if same else 0
        assert lost and len(own) - same <= 12 + shift * 10 / 2**level


def test_likeness_follows_overlap(spark):
    rng = random.Random(5)
    pairs = []
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        for n in (120, 600, 3000):
            a, b = prose(rng, n), prose(rng, n)
            pairs.append((share, a, a[: int(len(a) * share)] + b[int(len(b) * share) :]))
    df = phrases.fingerprints(phrases.fingerprints(spark.createDataFrame(pairs, "share double, text string, other string")), "other", "m", "g")
    rows = df.select("*", phrases.likeness(F.col("fingerprint"), F.col("g")).alias("x"), phrases.likeness(F.col("g"), F.col("fingerprint")).alias("y")).collect()
    for r in rows:
        assert r.x == r.y == pytest.approx(like(r.fingerprint, r.g)) and abs(r.x - r.share) < 0.2 and r.n_chars == len(r.text)


def test_likeness_of_levels(spark):
    a, b, c = phrases.fingerprints_of(["x" * 15 + "yz" * 20, "x" * 15, ""])
    rows = spark.createDataFrame([(a, b), (b, a), (c, c), (c, a), (b, c), (a, a)], "a string, b string").select("a", "b", phrases.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in rows] == pytest.approx([like(r.a, r.b) for r in rows]) and rows[2].x == 1.0 and rows[3].x == 0.0


def check(got, docs):
    """Rows against brute force over (doc_id, text) in order."""
    docs = [(i, t or "") for i, t in docs]
    want = []
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        f, g, h = (phrases.fingerprints_of([x])[0] for x in (t, edited, after))
        want.append((i is not None, i or 0, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, round(like(f, g), 9), round(like(f, h), 9)))
    made = [(r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(made) == sorted(want)


def test_query_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = Q.op13_fingerprints(spark, sf).collect()
    check(got, sorted((r.doc_id, r.text) for r in docs))
    assert np.median([r.near_edited for r in got]) > 0.65 and np.quantile([r.near_next for r in got], 0.95) < 0.2


@pytest.mark.parametrize("parts", [1, 7])
def test_query_odd_rows(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [(i, prose(rng, rng.choice([1, 3, 30]))) for i in range(40)] + [(100, None), (101, ""), (102, "\U0001f600" * 9), (103, "long " * 60_000), (104, "a"), (-5, "bcd" * 3)]
    rows.append((None, "null id"))
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fingerprint": F.lit("old"), "Part": F.lit(1), "first": F.lit(True)}).repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    check(Q.op13_fingerprints(spark, str(tmp_path)).collect(), sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))


def test_query_ties_one_row_none(spark, tmp_path):
    same = [(7, "same text here")] * 50 + [(None, None)] * 20
    spark.createDataFrame(same, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = Q.op13_fingerprints(spark, f"{tmp_path}/a").collect()
    assert len(got) == 70 and sum(r.near_next == 1 for r in got) == 68
    spark.createDataFrame(same[:1], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    check(Q.op13_fingerprints(spark, f"{tmp_path}/b").collect(), same[:1])
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/c/documents.parquet")
    assert Q.op13_fingerprints(spark, f"{tmp_path}/c").count() == 0
