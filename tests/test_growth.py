"""Steps whose work must not grow faster than the input."""

import numpy as np
from pyspark.sql import functions as F

from tagplace.operators import cells, cluster


def test_kmeans_looks_up_each_place_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    xyz = rng.normal(0, 1e6, (60, 3)).tolist()
    points = spark.createDataFrame([(i, *xyz[i % 60 if i % 7 else i % 5]) for i in range(3000)], "id long, x double, y double, z double").repartition(3)
    places = cluster.places_of(points, 2, 42)
    assert {r.n for r in places.collect()} != {1} and places.agg(F.sum("n")).first()[0] == 3000
    # places are drawn if and only if one of their points is
    near = cluster.nearest(points, np.array([0]), np.zeros((1, 3)))
    own = cluster.nearest(places, np.array([0]), np.zeros((1, 3)))
    total = near.agg(F.sum("d2")).first()[0]
    for turn in (1, 2):
        drawn = [set(map(tuple, cluster.oversample_centers(d, 5, total, 42, turn).collect())) for d in (near, own)]
        assert drawn[0] == drawn[1] and drawn[0]
    looked = []
    true = cluster.nearest
    monkeypatch.setattr(cluster, "nearest", lambda p, *a: looked.append(p.count()) or true(p, *a))
    centers = cluster.kmeans_fit(points, 6, max_iter=5, init_steps=2)
    assert centers.count() == 6 and looked and max(looked) <= 60
    monkeypatch.setattr(cluster, "nearest", true)
    # a centre is the mean of its points, each as often as it is there
    means = cluster.centroids(cluster.nearest_center(points, cluster.kmeans_fit(points, 6)), centers)
    final = {r.label: r for r in cluster.kmeans_fit(points, 6).collect()}
    assert all(abs(r[c] - final[r.label][c]) < 1 for r in means.collect() for c in "xyz")


def test_fewer_places_than_centres(spark):
    """Rows grow, places don't: each place is a centre then, and the centres beyond are copies without points."""
    places = np.random.default_rng(5).normal(0, 3e6, (7, 3))
    points = spark.createDataFrame([(i, *places[i % 7].tolist()) for i in range(70)], "id long, x double, y double, z double")
    centers = cluster.kmeans_fit(points, 17)
    assert sorted(r.label for r in centers.collect()) == list(range(17))
    assert {(round(r.x, 3), round(r.y, 3), round(r.z, 3)) for r in centers.collect()} == {tuple(p) for p in places.round(3).tolist()}
    near = cluster.nearest_center(points, centers)
    assert near.agg(F.sum("d2")).first()[0] < 1e-6 and {r.label for r in near.collect()} == set(range(7))
    rings = {r.label: r.ring for r in cells.cells_of(centers).collect()}
    assert len(rings) == 17 and all(len(r) >= 3 for r in rings.values())


def test_large_models_are_scored_in_blocks(spark, sf, monkeypatch):
    from tagplace.jobs.queries import Fitted
    from tagplace.operators import bayes

    f = Fitted(spark, sf)
    n = f.terms.count()
    whole = f.scorer()
    monkeypatch.setattr(bayes, "MAX_THETA", n)
    monkeypatch.setattr(bayes, "PAIRS", 100)
    blocks = f.scorer()
    assert whole.arrays and blocks.blocks and len(blocks.blocks) > 1 and not blocks.joined
    rows = lambda s, c: sorted((r.id, r.rank, r.label, round(r.probability, 8), round(r.score, 6), round(r.before, 8)) for r in bayes.score_bags(f.docs, s, c).collect())
    for count in (3, None, 2**31 - 1):
        assert rows(blocks, count) == rows(whole, count)
    monkeypatch.setattr(bayes, "MAX_EVERY", 8)  # many classes: only the best of a block are told
    narrow = f.scorer()
    assert not narrow.few and rows(narrow, 3) == rows(whole, 3)


def test_fit_of_bags_equals_fit_of_features(spark, sf):
    from tagplace.jobs.queries import Fitted
    from tagplace.operators import bayes

    f = Fitted(spark, sf)
    old = bayes.nb_fit(f.features, f.labels, f.terms.count())
    for k, by in (("classes", ["label"]), ("theta", ["label", "tag"])):
        round_ = lambda d: sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in d.select(sorted(d.columns)).collect())
        assert round_(old[k]) == round_(f.model[k])


def test_a_batch_of_long_bags_is_scored_in_parts(monkeypatch):
    """A task's memory goes by ``PAIRS``, not by how many tags and classes a batch has."""
    import pyarrow as pa

    from tagplace.operators import bayes

    a = bayes.Arrays.__new__(bayes.Arrays)
    rng = np.random.default_rng(1)
    a.labels, a.pi, a.rest = np.arange(16), rng.normal(size=16), rng.normal(size=16)
    a.tags, a.weight = pa.array([f"t{i}" for i in range(50)]), rng.normal(size=50)
    a.at, a.value, a.start = np.tile(np.arange(16, dtype=np.int32), 50), rng.normal(size=800), np.arange(51) * 16
    bags = pa.array([[f"t{j}" for j in rng.choice(60, rng.integers(0, 40), replace=False)] for _ in range(300)])
    want = a.scores(bags)
    made, true = [], np.repeat
    monkeypatch.setattr(bayes, "PAIRS", 1000)
    monkeypatch.setattr(bayes.np, "repeat", lambda x, n: made.append(np.sum(n)) or true(x, n))
    assert np.array_equal(a.scores(bags), want)
    assert max(made[1:]) <= 1000 and len(made) > 10


def test_smoothed_flat_classes_are_scored_in_tasks(spark, monkeypatch):
    from tagplace.operators import bayes, flat

    classes = spark.createDataFrame([(2**40 + i, f"c{i}", 0.0 if i == 4 else (i + 1) / 50, float(i), -float(i), 0 if i == 5 else 4 * i + 3) for i in range(9)], "class_no long, class string, prior double, lat double, lon double, size long")
    counts = spark.createDataFrame([(2**40 + i, f"t{j}", (i * j) % 4 + 1) for i in range(9) for j in range(i, 12)] + [(2**40, None, 3)], "class_no long, tag string, n long")
    bags = [[f"t{j % 14}" for j in range(i, 2 * i)] + ([None, "t1", "t1"] if i % 3 else []) for i in range(12)]
    asked = spark.createDataFrame(list(enumerate(bags)) + [(99, None)], "id long, tags array<string>")
    rows = lambda d: sorted((r.id, r["rank"], r.class_no, r["class"], r.lat, r.lon, round(r.confidence, 9)) for r in d.collect())
    # with more classes asked for than there are, all are joined
    want = rows(flat.classify_counts(classes, counts, asked, 100, flat.SMOOTHING).where("rank <= 3"))
    made = flat.classify_counts(classes, counts, asked, 3, flat.SMOOTHING)
    assert len(want) == 33 and rows(made) == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Window" not in plan
    monkeypatch.setattr(bayes, "MAX_THETA", 20)
    assert rows(flat.classify_counts(classes, counts, asked, 3, flat.SMOOTHING)) == want


def test_occurrences_of_tags_stay_where_they_are(spark, monkeypatch):
    from tagplace.operators import terms

    known = spark.createDataFrame([(f"t{i}", 9, i / 3) for i in range(20)], "tag string, n long, weight double").persist()
    rows = lambda d: sorted((r.id, r.tag, round(r.w, 9)) for r in d.collect())
    once = [(i, [f"t{j}" for j in range(i, i + 5)] + [None, "x"]) for i in range(18)]
    for data, shuffled in ((once, False), ([*once, (3, ["t1", "t9"])], True), ([*once, (30, ["t1", "t1", "t2"])], True)):
        docs = spark.createDataFrame(data, "id long, tags array<string>")
        made = terms.idf_transform(docs, known)
        assert ("hashpartitioning" in made._jdf.queryExecution().executedPlan().toString()) == shuffled
        with monkeypatch.context() as m:
            m.setattr(terms, "MAX_TERMS", 0)
            assert rows(made) == rows(terms.idf_transform(docs, known))


def test_fit_reads_labelled_rows_once(spark):
    from tagplace.operators import bayes

    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    data = [(i, i % 3, None if i % 5 == 0 else [f"t{i % 4}", None, "t9"]) for i in range(60)]
    labelled = spark.createDataFrame(data, "id long, label int, tags array<string>").mapInArrow(counting, "id long, label int, tags array<string>")
    known = spark.createDataFrame([("t0", 0.5), ("t1", 1.5), ("t9", -0.1)], "tag string, weight double")
    model = bayes.nb_fit_bags(labelled, known, 3)
    assert sorted((r.label, r.n) for r in model["classes"].collect()) == [(0, 20), (1, 20), (2, 20)]
    theta = {(r.label, r.tag): round(r.sum_w, 9) for r in model["theta"].collect()}
    want = {}
    for _, label, tags in data:
        for t in tags or []:
            if w := {"t0": 0.5, "t1": 1.5, "t9": -0.1}.get(t):
                want[label, t] = want.get((label, t), 0.0) + w
    assert theta == {k: round(v, 9) for k, v in want.items() if v > -1}
    assert seen.value == 60


def test_first_seen_sorts_no_frame(monkeypatch):
    """A key costs a look at its rows: most have one, and there is a call for each."""
    import pandas as pd

    from tagplace.streaming.jobs import FirstSeen

    class Seen:
        def __init__(self, known):
            self.known = known

        def exists(self):
            return self.known

        def update(self, value):
            self.known = True

    names = ["always", "o1", "o2", "o3", "value"]
    rows = [(False, 1, 0, 2, "b"), (True, 9, 1, 0, "d"), (True, 9, 0, 5, "c"), (False, 1, 0, 2, "a")]
    monkeypatch.setattr(pd.DataFrame, "sort_values", lambda *a, **k: 1 / 0)

    def first(known, *frames):
        f = FirstSeen()
        f.seen = Seen(known)
        out = [tuple(r) for made in f.handleInputRows(("media", 7), iter([pd.DataFrame(x, columns=names) for x in frames]), None) for r in made.itertuples(index=False)]
        assert f.seen.known
        return out

    assert first(False, rows[:1], rows[3:]) == [("media", 7, "a")]
    assert first(False, rows[:2], rows[2:]) == first(True, rows) == [("media", 7, "c")]
    assert first(True, rows[:1], rows[3:]) == []


def test_folds_are_scored_where_their_classes_are_counted(spark, monkeypatch):
    """No table of a row for each tag and class is shuffled or sent, and rates are those of the models as tables."""
    from tagplace.jobs import train
    from tagplace.operators import folds

    rng = np.random.default_rng(7)
    tags = [[f"t{j}" for j in rng.zipf(1.5, 12) % 40] + [None] for _ in range(160)] + [[], None]
    media = spark.createDataFrame([(i, t, float(i % 9), float(i % 7)) for i, t in enumerate(tags)], "id long, tags array<string>, latitude double, longitude double")
    rates = lambda: sorted((r.fold, r.level, round(r.rate, 9)) for r in train.fold_rates(media, 2, per_class=20, max_iter=2, levels=(1, 3)).collect())
    with monkeypatch.context() as m:
        m.setattr(train, "MAX_TERMS", 0)
        want = rates()
    assert len(want) == 4 and 0 < min(want, key=lambda r: r[2])[2] < 1
    for name in ("fold_models", "Scorer", "score_bags"):
        monkeypatch.setattr(train, name, None)
    for name, value in (("WIDTH", 2), ("PART", 300), ("HOT", 5), ("ROWS", 11), ("PAIRS", 40)):
        monkeypatch.setattr(folds, name, value)
    assert rates() == want


def test_first_rows_of_many_keys_take_one_call():
    import pyarrow as pa

    from tagplace.streaming.jobs import first_of_keys

    rng = np.random.default_rng(9)
    rows = [("users", int(k), bool(a), int(o), int(k % 3), 0, f"v{i % 7}") for i, (k, a, o) in enumerate(zip(rng.integers(0, 50, 400), rng.random(400) < 0.1, rng.integers(1, 6, 400), strict=True))]
    names = ["what", "key", "always", "o1", "o2", "o3", "value"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[a : a + 37]]) for a in range(0, 400, 37)]
    got = [tuple(r.values()) for b in first_of_keys((pa.scalar("users"), pa.scalar(3)), iter(batches)) for r in b.to_pylist()]
    best = {k: min((not r[2], *r[3:]) for r in rows if r[1] == k) for k in {r[1] for r in rows}}
    want = [("users", k, 0 if b[0] else b[2], b[4]) for k, b in best.items()] + [("users", k, 0, None) for k, b in best.items() if not b[0]]
    assert sorted(map(str, got)) == sorted(map(str, want)) and list(first_of_keys((pa.scalar("users"), pa.scalar(3)), iter([]))) == []
