"""Periodic runs against brute force; odd texts."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tagplace.llm import periodic
from tagplace.llm import queries as Q


def brute(w, least=12):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def bags(rng, count, most=60):
    for _ in range(count):
        k, n = rng.randint(1, 4), rng.randint(0, most)
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), 1 + rng.randrange(n)
            w = [w[i] if i < a or a + p > n else w[a + (i - a) % p] for i in range(n)]
        yield w


def test_runs_brute_force():
    rng = random.Random(3)
    for least in (2, 3, 6, 12):
        for _ in range(150):
            docs, codes, off = list(bags(rng, rng.randint(1, 4))), [], []
            for d, w in enumerate(docs):
                off.append(len(codes))
                codes += [d * 100 + x for x in w] + [d * 100 + 99]
            got = zip(*(x.tolist() for x in periodic.runs_of(np.array(codes), least)), strict=True)
            assert sorted(got) == sorted((s + off[d], n, q) for d, w in enumerate(docs) for s, n, q in brute(w, least))


def test_long_runs():
    for w in ([0] * 3000, [0, 1] * 2000, list(range(700)) * 3 + [5], [x % 7 for x in range(5000)]):
        got = list(zip(*(x.tolist() for x in periodic.runs_of(np.array([*w, 10**6]))), strict=True))
        q = next(q for q in range(1, len(w)) if w[q : q + 700] == w[: min(700, len(w) - q)])
        n = next((i for i in range(len(w) - q) if w[i] != w[i + q]), len(w) - q) + q
        assert got == [(0, n, q)]


def test_operator_and_odd_texts(spark):
    rng = random.Random(8)
    words = ["a", "b", "A", "é", "x y", " ", "0"]
    sep = [" ", "  ", "\t", "\n", "\x0b", "\x0c\r"]
    texts = [rng.choice(["", " "]) + "".join(words[x] + rng.choice(sep) for x in w) for w in bags(rng, 120)]
    texts += [None, "", " \n ", "a", texts[3], "so " * 50_000, " ".join(f"w{i % 29_000}" for i in range(90_000))]
    docs = spark.createDataFrame([(i if i % 9 else None, t, "old", 1) for i, t in enumerate(texts)], "doc_id long, text string, Runs string, extra int").repartition(5)
    got = periodic.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "extra", "n_words", "runs", "collapsed"]
    got = got.collect()
    assert len(got) == len(texts)
    for r in got:
        w = (r.text or "").encode().split()
        runs = [tuple(x) for x in r.runs]
        if len(w) < 1000:
            assert runs == brute(w)
        else:
            assert runs == [(0, len(w), 1 if w[0] == w[1] else 29_000)]
        assert r.n_words == len(w) and r.collapsed == collapsed([x.decode() for x in w], runs)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_query_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.op12_periodic_runs(spark, sf).collect()
    assert len(got) == len(texts) and sum(r.n_runs for r in got) > 10
    for r in got:
        w = (texts[r.doc_id] or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        w = [x.decode() for x in w]
        # candidates: periods of words that recur; plain brute force would take too long on long texts
        runs = brute(w) if len(w) < 600 else None
        if runs is None:
            continue
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()


def test_query_null_ids(spark, tmp_path):
    rows = [(None, "a " * 40), (None, None), (0, "b " * 40), (5, ""), (5, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("best", F.lit("old")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_runs, r.length or 0) for r in Q.op12_periodic_runs(spark, str(tmp_path)).collect())
    assert got == [(False, 0, 1, 40), (False, 5, 0, 0), (False, 5, 0, 0), (True, 0, 0, 0), (True, 0, 1, 40)]
