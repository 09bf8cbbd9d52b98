import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagplace.operators import bayes, cells, cluster, flat, ingest, predict, terms
from tagplace.sources import kml, media, models


def test_idf_counts_occurrences(spark):
    docs = spark.createDataFrame([(1, ["a"] * 6 + ["b"] * 5), (2, ["c", "c"]), (3, []), (4, ["c"] * 6)], "id long, tags array<string>")
    got = {r.tag: (r.n, r.weight) for r in terms.idf_fit(docs).collect()}
    assert set(got) == {"a", "c"}
    assert got["c"][0] == 8 and math.isclose(got["c"][1], math.log(4 / 8))
    indexed = {r.tag: r.idx for r in terms.idf_fit(docs, indexed=True).collect()}
    assert indexed == {"a": 0, "c": 1}
    vectors = {r.id: r.weights for r in terms.tag_vectors(docs, terms.idf_fit(docs)).collect()}
    assert vectors[3] == {} and math.isclose(vectors[2]["c"], 2 * math.log(0.5))


def nb_tables(spark, lam=1.0):
    rows = [(0, 0, (1, 0, 2)), (1, 0, (1, 0, 0)), (2, 1, (0, 3, 1))]
    f = spark.createDataFrame([(i, "xyz"[j], float(w)) for i, _, ws in rows for j, w in enumerate(ws) if w], "id long, tag string, w double")
    labels = spark.createDataFrame([(i, c) for i, c, _ in rows], "id long, label int")
    return f, labels, bayes.nb_fit(f, labels, 3, lam)


def test_nb_fit(spark):
    f, labels, model = nb_tables(spark)
    c = {r.label: r for r in model["classes"].collect()}
    assert math.isclose(c[0].pi, math.log(3) - math.log(5)) and math.isclose(c[1].pi, math.log(2) - math.log(5))
    theta = {(r.label, r.tag): r.log_w for r in model["theta"].collect()}
    assert math.isclose(theta[0, "x"] - c[0].log_denom, math.log(3 / 7)) and (0, "y") not in theta


@pytest.mark.parametrize("lam", [1.0, 0.3])
def test_scorer_equals_joins(spark, lam):
    f, labels, model = nb_tables(spark, lam)
    t = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", 1.0)], "tag string, weight double")
    docs = spark.createDataFrame([(0, ["x", "z", "z"]), (1, ["y"]), (2, []), (3, ["q"])], "id long, tags array<string>")
    pairs = {(r.id, r.label): r.score for r in bayes.score_pairs(docs, terms.idf_transform(docs, t), model, lam).collect()}
    got = bayes.score_bags(docs, bayes.Scorer(t, model, lam), 2).collect()
    assert len(got) == 8
    for r in got:
        assert math.isclose(r.score, pairs[r.id, r.label], abs_tol=1e-9)
    for i in range(4):
        assert math.isclose(sum(r.probability for r in got if r.id == i), 1)
    arg = {r.id: r.label for r in bayes.argmax_class(bayes.score_pairs(docs, terms.idf_transform(docs, t), model, lam)).collect()}
    assert arg == {r.id: r.label for r in got if r["rank"] == 1} and arg[2] == 0


def test_cover(spark):
    scored = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.3), (1, 2, 0.2), (2, 0, 0.9), (2, 1, 0.1)], "id int, label int, p double")
    ranked = bayes.rank_classes(scored.withColumn("score", F.log("p")), F.col("p"))
    assert sorted((r.id, r.label) for r in bayes.cover_probability(ranked).collect()) == [(1, 0), (1, 1), (2, 0)]


def test_ranks_go_by_score_where_probabilities_vanish(spark):
    # class 2 is likelier than class 1, both far below 1e-9
    scored = spark.createDataFrame([(1, 0, 0.0), (1, 1, -50.0), (1, 2, -40.0), (1, 3, -50.0)], "id int, label int, score double")
    assert [r.label for r in bayes.rank_classes(scored).orderBy("rank").collect()] == [0, 2, 1, 3]
    f = spark.createDataFrame([(i, t, 50.0) for i, t in enumerate("abc")], "id long, tag string, w double")
    labels = spark.createDataFrame([(0, 0), (1, 2), (2, 1)], "id long, label int")
    t = spark.createDataFrame([(x, 1.0) for x in "abc"], "tag string, weight double")
    docs = spark.createDataFrame([(9, ["a"] * 60 + ["b"] * 30 + ["c"] * 20)], "id long, tags array<string>")
    got = bayes.score_bags(docs, bayes.Scorer(t, bayes.nb_fit(f, labels, 3)), 3).orderBy("rank").collect()
    assert [r.label for r in got] == [0, 2, 1] and got[1].probability < 1e-9


def test_a_large_model_is_joined_and_gives_equal_rows(spark, sf, monkeypatch):
    from tagplace.jobs import fixtures, queries

    f = queries.Fitted(spark, sf)
    asked = f.docs.select("id", "tags", F.when(F.col("location_id") % 2 == 0, 3).alias("cnt"))
    rows = lambda s: sorted((r.id, r["rank"], r.label, round(r.probability, 6)) for r in bayes.score_bags(asked, s, "cnt").collect())
    small = bayes.Scorer(f.terms, f.model)
    monkeypatch.setattr(bayes, "MAX_THETA", 0)
    large = bayes.Scorer(f.terms, f.model)
    assert large.joined and not small.joined and rows(small) == rows(large)
    assert bayes.nb_predict_all(f.docs.where("id < 5"), small).count() == 5 * len(small.arrays.labels)
    assert bayes.top_k_classes(bayes.rank_classes(bayes.score_pairs(f.docs, f.features, f.model)), 1).select("id", "label").exceptAll(bayes.nb_predict(f.docs, large)).count() == 0


@pytest.mark.parametrize("kind", ["spread", "ties", "flat", "few"])
def test_lines_equal_all_scores(kind):
    from tagplace.operators.lines import Lines

    rng = np.random.default_rng(5)
    k = 60 if kind == "few" else 4000
    labels = rng.permutation(10 * k)[:k]
    a = {"spread": rng.normal(0, 2, k), "ties": rng.integers(0, 3, k) * 1.0, "flat": np.zeros(k), "few": rng.normal(0, 2, k)}[kind]
    b = {"spread": -rng.gamma(2, 1, k) - 5, "ties": -rng.integers(5, 7, k) * 1.0, "flat": np.full(k, -3.0), "few": -rng.gamma(2, 1, k)}[kind]
    lines, short = Lines(labels, a, b, 6), 0
    for i in range(300):
        mass, n = float(rng.gamma(1.5, 20)) * (i % 10 > 0), int(rng.choice([0, 1, 5, 300]))
        own = np.sort(rng.choice(k, min(n, k // 2), replace=False))
        more = rng.normal(0, 3, len(own)) + rng.choice([0, -40, 20])
        count = [None, 1, 4, 16, 100, 10**9][i % 6]
        got, want = (f(mass, own, more, count, 0.75) for f in (lines.ranked, lines.looked_at))
        assert got[0].tolist() == want[0].tolist() and got[3].tolist() == want[3].tolist()
        for g, w in ((got[1], want[1]), (got[2], want[2]), (got[4], want[4])):
            assert np.allclose(g, w, rtol=1e-9, atol=1e-12)
    assert set(lines.labels) == set(labels)


def test_many_classes_meet_bags_as_lines(spark, monkeypatch):
    """Without a pair for every bag and class, the rows are those of the model sent as arrays."""
    rng = np.random.default_rng(2)
    k = 3000
    classes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.normal(-8, 1, k), 5 + rng.gamma(2, 0.5, k)))], "label int, pi double, log_denom double")
    theta = spark.createDataFrame([(int(c), f"t{t}", float(w)) for t in range(200) for c, w in zip(rng.choice(k, 30, replace=False), rng.gamma(1, 2, 30))], "label int, tag string, log_w double")
    known = spark.createDataFrame([(f"t{t}", float(w)) for t, w in enumerate(rng.gamma(2, 1, 200) - 0.4)], "tag string, weight double")
    bags = [(i, [f"t{t}" for t in rng.integers(0, 230, rng.integers(0, 12))] or None, [None, 1, 4, 16][i % 4]) for i in range(400)]
    docs = spark.createDataFrame(bags, "id long, tags array<string>, cnt int")
    rows = lambda s: sorted((r.id, r["rank"], r.label, round(r.probability, 9), round(r.before, 9), round(r.score, 6)) for r in bayes.score_bags(docs, s, "cnt").collect())
    model = {"classes": classes, "theta": theta}
    small = rows(bayes.Scorer(known, model))
    monkeypatch.setattr(bayes, "MAX_THETA", 0)
    large = bayes.Scorer(known, model)
    assert large.lines and rows(large) == small
    plan = bayes.score_bags(docs, large, "cnt")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    monkeypatch.setattr(bayes, "MAX_CLASSES", 0)
    paired = bayes.Scorer(known, model)
    near = lambda x: sorted((r[0], r[1], r[2]) for r in x)
    assert not paired.lines and near(rows(paired)) == near(small)


def test_a_class_of_negative_weights_has_scores(spark):
    f = spark.createDataFrame([(0, "a", -5.0), (1, "b", 1.0)], "id long, tag string, w double")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "id long, label int")
    model = bayes.nb_fit(f, labels, 2)
    assert all(r.score == r.score and abs(r.score) < 1e9 for r in bayes.score_pairs(labels, f, model).collect())


def test_hit_rates(spark):
    truth = spark.createDataFrame([(1, 0), (2, 1), (3, 9)], "id int, label int")
    ranked = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (2, 1, 2), (3, 0, 1)], "id int, label int, rank int")
    assert [round(r.rate, 3) for r in predict.hit_rates(truth, ranked).orderBy("level").collect()] == [0.333, 0.667, 0.667]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(42)
    points, centers = rng.random((500, 3)), rng.random((40, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double, z double")
    got = {r.id: r.label for r in cluster.nearest_center(df, cluster.centers_frame(spark, centers)).collect()}
    assert all(got[i] == ((centers - p) ** 2).sum(1).argmin() for i, p in enumerate(points))
    rng = np.random.default_rng(3)
    points = np.vstack([rng.random((3000, 3)), rng.integers(0, 4, (500, 3)) / 4.0]) * 1e6
    centers = np.vstack([rng.random((700, 3)), rng.integers(0, 4, (300, 3)) / 4.0]) * 1e6  # with equal and equally near ones
    labels = rng.permutation(1000)
    label, d2 = cluster.Near(labels, centers).find(points)
    for i, p in enumerate(points):
        d = ((p - centers) ** 2).sum(1)
        assert d2[i] == d.min() and label[i] == labels[d == d.min()].min()
    tie = cluster.centers_frame(spark, np.array([[1.0, 0, 0], [-1.0, 0, 0]]))
    at = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert cluster.nearest_center(at, tie).first().label == 0


def test_kmeans_reduces_many_candidates_by_regions(spark, monkeypatch):
    rng = np.random.default_rng(2)
    p = np.vstack([rng.normal(c, 0.05, (80, 3)) for c in rng.random((20, 3)) * 10])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double, z double")
    cost = lambda: cluster.clustering_cost(df, cluster.kmeans_fit(df, 20, max_iter=10)).first()[0]
    whole = cost()
    monkeypatch.setattr(cluster, "MAX_LOCAL", 30)
    assert cluster.kmeans_fit(df, 20, max_iter=0).count() == 20 and cost() < 4 * whole + 50


def test_seats_are_dealt_by_demand():
    rng = np.random.default_rng(5)
    for _ in range(50):
        room = rng.integers(1, 30, 12)
        k = int(rng.integers(12, room.sum() + 1))
        seats = cluster.apportioned(k, rng.random(12) * rng.integers(0, 2, 12), room)
        assert seats.sum() == k and (seats >= 1).all() and (seats <= room).all()
    assert cluster.apportioned(12, np.array([6.0, 3.0, 0.0]), np.array([50, 50, 50])).tolist() == [7, 4, 1]


def test_kmeans_start_costs_alike_on_every_path(spark, sf, monkeypatch):
    from tagplace.jobs import fixtures as fx

    points = models.settled(cluster.points_of(fx.media_sales(spark, sf)), "points")
    cost = lambda: cluster.clustering_cost(points, cluster.kmeans_fit(points, 100, max_iter=0)).first()[0]
    whole = cost()
    monkeypatch.setattr(cluster, "MAX_LOCAL", 200)
    assert cost() < 1.1 * whole
    assert cluster.kmeans_fit(points.repartition(7), 100, max_iter=0).orderBy("label").collect() == cluster.kmeans_fit(points, 100, max_iter=0).orderBy("label").collect()


def test_kmeans(spark):
    rng = np.random.default_rng(1)
    p = np.vstack([rng.normal(c, 0.05, (60, 3)) for c in ((0, 0, 0), (5, 5, 5), (0, 9, 0))])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double, z double")
    cost = lambda n: cluster.clustering_cost(df, cluster.kmeans_fit(df, 3, max_iter=n)).first()[0]
    assert cluster.kmeans_fit(df, 7, max_iter=0).count() == 7
    assert cost(10) <= cost(0) + 1e-9 and cost(10) < 10
    again = cluster.kmeans_fit(df.repartition(5), 3, max_iter=10)
    assert math.isclose(cluster.clustering_cost(df, again).first()[0], cost(10), rel_tol=1e-6)
    with pytest.raises(ValueError):
        cluster.num_classes(10, 1000)


@pytest.mark.parametrize("area", [90, 3])
def test_cells_are_hull_faces(area):
    rng = np.random.default_rng(3)
    lat, lon = np.radians(rng.uniform(-area, area, 24) * 0.9), np.radians(rng.uniform(-area, area, 24) * 2 * (area > 10) + rng.uniform(0, 3, 24))
    n = np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)]) * 6371000
    p, normal = cells.surface_points(n)
    faces = set()
    for i in range(24):
        near = cells.neighbours(i, p, normal)
        faces |= {frozenset((i, a, b)) for a, b in zip(near, near[1:] + near[:1], strict=True)}
    assert len(faces) == 2 * 24 - 4
    for f in faces:
        a, b, c = (p[i] for i in f)
        d = np.delete(p, list(f), 0) @ np.cross(b - a, c - a) - a @ np.cross(b - a, c - a)
        assert (d < 0).all() or (d > 0).all()


def test_hot_tags_are_not_shuffled(spark):
    # one tag in every row, a known one in some, a rare one and a null
    docs = spark.range(0, 4000, 1, 16).selectExpr("id", "array('hot', concat('t', id % 1300), if(id = 7, 'once', null)) as tags")
    known = terms.idf_fit(docs, min_occurrences=1)
    assert {r.tag for r in terms.hot_tags(known).collect()} == {"hot"}
    plain = terms.keep_vocabulary(docs, known.drop("n"))
    made = terms.keep_vocabulary(docs, known)
    assert sorted(made.collect()) == sorted(plain.collect()) and made.count() == 4000 + 4000
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "16")):
            spark.conf.set(k, v)
        sizes = [r["count"] for r in terms.keep_vocabulary(docs, known).groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]
        assert max(r["count"] for r in terms.keep_vocabulary(docs, known.drop("n")).groupBy(F.spark_partition_id().alias("p")).count().collect()) >= 4000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("sizes", [{}, {"region": 15, "seeds": 20, "lookups": 10}, {"region": 15, "seeds": 0}])
@pytest.mark.parametrize("area", [None, 0.02])
def test_cells_by_regions_equal_all_centres(spark, area, sizes):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 3)) if area is None else np.array([0.6, 0.5, 0.62]) + rng.normal(size=(120, 3)) * area
    xyz = v / np.linalg.norm(v, axis=1)[:, None] * 6371000
    p, normal = cells.surface_points(xyz)
    got = {r.label: [(c.lat, c.lon) for c in r.ring] for r in cells.cell_polygons(cluster.centers_frame(spark, xyz), **sizes).collect()}
    assert len(got) == 120
    for i in range(120):
        near = cells.neighbours(i, p, normal)
        want = [cells._to_lla((p[i] + p[a] + p[b]) / 3) for a, b in zip(near, near[1:] + near[:1], strict=True)]
        assert np.allclose(got[i], want, rtol=0, atol=1e-9)


def test_cells_of_ties_copies_and_few(spark):
    # centres on a grid: four on a circle are one face's plane
    lat, lon = (np.radians(x.ravel()) for x in np.meshgrid(np.arange(-60, 61, 20.0), np.arange(-180, 180, 30.0)))
    xyz = np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)]) * 6371000
    rings = lambda a, **k: {r.label: np.array([(c.lat, c.lon) for c in r.ring]) for r in cells.cell_polygons(cluster.centers_frame(spark, a), **k).collect()}
    one, many = rings(xyz), rings(xyz, region=9, seeds=0)
    assert len(one) == 84 and all(one[i].shape == many[i].shape and np.allclose(one[i], many[i], rtol=0, atol=1e-9) for i in one)
    copies = rings(np.vstack([xyz, xyz[:2]]))
    assert (copies[84] == copies[0]).all() and (copies[0] == one[0]).all() and len(copies) == 86
    with pytest.raises(ValueError, match="four"):
        cells.cell_polygons(cluster.centers_frame(spark, xyz[[0, 1, 2, 2]]))


def test_flat_ties_and_empty(spark):
    model = spark.createDataFrame([(0, "p", 0.5, 1.0, 2.0, ["a", "b"]), (1, "q", 0.5, 3.0, 4.0, ["a", "c"]), (2, "r", 0.5, 0.0, 0.0, [])], "class_no long, class string, prior double, lat double, lon double, tags array<string>")
    asked = spark.createDataFrame([(1, ["a"]), (2, []), (3, ["zz"])], "id int, tags array<string>")
    got = [(r.id, r["rank"], r.class_no, r.confidence) for r in flat.classify_flat(model, asked, 2).orderBy("id", "rank").collect()]
    assert got == [(1, 1, 0, 0.5), (1, 2, 1, 0.5), (3, 1, 0, 0.0), (3, 2, 1, 0.0)]
    smooth = flat.classify_flat(model, asked, 3, 0.001).where("id = 1").orderBy("rank").collect()
    assert math.isclose(sum(r.confidence for r in smooth), 1)


def test_flat_long_bags_keep_their_order(spark):
    model = spark.createDataFrame([(0, "p", 0.5, 1.0, 2.0, ["a"] * 3 + ["b"]), (1, "q", 0.5, 3.0, 4.0, ["a"] + ["b"] * 3)], "class_no long, class string, prior double, lat double, lon double, tags array<string>")
    asked = spark.createDataFrame([(1, ["zz"] * 300 + ["b"] * 20 + ["a"]), (2, ["b"] * 900 + ["a"] * 899)], "id int, tags array<string>")
    got = [(r.id, r["rank"], r.class_no) for r in flat.classify_flat(model, asked, 2, 0.001).orderBy("id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 0), (2, 1, 1), (2, 2, 0)]
    best = flat.classify_flat(model, asked, 1).where("id = 2").first()
    assert math.isclose(best.confidence, 0.75)


def test_class_model_files(spark, tmp_path):
    lines = spark.createDataFrame([(0, "c0,0.5,a,b,"), (1, "c1,0.25,")], "class_no long, value string")
    coords = spark.createDataFrame([(1.5, 2.5), (3.5, 4.5)], "lat double, lon double")
    both = flat.zip_rows(lines.orderBy("class_no"), coords)
    made = flat.insert_coordinates(both.select("class_no", "value", "lat", "lon")).orderBy("class_no").collect()
    assert [r.value for r in made] == ["c0,0.5,1.5,2.5,a,b,", "c1,0.25,3.5,4.5,"]
    spark.createDataFrame(made).coalesce(1).orderBy("class_no").select("value").write.text(f"{tmp_path}/m")
    back = models.read_class_model(spark, f"{tmp_path}/m").orderBy("class_no").collect()
    assert [(r["class"], r.prior, r.lat, list(r.tags)) for r in back] == [("c0", 0.5, 1.5, ["a", "b"]), ("c1", 0.25, 3.5, [])]
    models.write_class_model(spark.createDataFrame(back), f"{tmp_path}/n")
    rows = lambda p: [tuple(r) for r in models.read_class_model(spark, p).orderBy("class_no").collect()]
    assert rows(f"{tmp_path}/n") == [tuple(r) for r in back]


def test_media_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text('1,2,2015-10-01 10:00:00,"{a,b}",5,Name,1.5,2.5\n1,2,3\nabc,2,x,{},5,N,1.5,2.5\n7,2,x,{},5,N,1.5,2.5,9\n')
    rows, rejects = media.read_media_csv(spark, str(tmp_path / "m.csv"))
    assert [r.tags for r in rows.collect()] == [["a", "b"]] and rejects.count() == 1
    strict, _ = media.read_media_csv(spark, str(tmp_path / "m.csv"), strict=True)
    with pytest.raises(Exception, match="bad media row"):
        strict.collect()


def page(code, items, next_id=None):
    import json

    return json.dumps({"meta": {"code": code}, "pagination": {"next_max_id": next_id} if next_id else {}, "data": items})


def item(i, user, place, geo=True):
    return {"id": f"{i}_{user}", "created_time": "1443693600", "caption": {"text": "hi"} if i % 2 else None, "tags": ["t"], "type": "image", "user": {"id": str(user)}, "location": {"id": place, "name": "n", "latitude": 1.0, "longitude": 2.0} if geo else None}


def feed(spark):
    return spark.createDataFrame([
        (1, 0, page(200, [item(1, 1, "10"), item(2, 1, "11", geo=False)], "a")), (1, 1, page(200, [item(3, 1, "10", geo=False)], "b")), (1, 2, page(200, [item(4, 1, "12")])),
        (2, 0, page(400, None)), (3, 0, page(500, None)), (4, 0, page(200, [item(1, 4, "10"), item(9, 4, None)])),
    ], "user_id long, page_no int, value string")


def test_ingest(spark):
    made = ingest.ingest_pages(feed(spark))
    assert sorted(r.id for r in made["media"].collect()) == [1]
    assert [r.id for r in made["locations"].collect()] == [10]
    users = {r.id: (r.next_max_id, r.fully_scraped, r.private) for r in made["users"].collect()}
    assert users == {1: ("b", False, False), 2: (None, False, True), 4: (None, True, False)}
    assert sorted(r.what for r in made["rejects"].collect()) == ["item", "page"]
    again = ingest.ingest_pages(feed(spark), made["users"], made["locations"], made["media"])
    assert again["media"].count() == 0 and again["locations"].count() == 0


def test_inactive_users_are_not_visited_again(spark):
    old = spark.createDataFrame([(1, "a", False, False, True), (4, None, True, False, False), (2, None, False, True, False), (3, "x", False, False, False)], "id long, next_max_id string, fully_scraped boolean, private boolean, stopped boolean")
    pages = spark.createDataFrame([(i, 5, page(200, [item(10 * i, i, "10")])) for i in (1, 2, 3, 4)], "user_id long, page_no int, value string")
    assert [r.user_id for r in ingest.ingest_pages(pages, old)["media"].collect()] == [3]
    assert sorted(r.user_id for r in ingest.ingest_pages(pages, old, resume=True)["media"].collect()) == [1, 3]
    assert sorted(r.id for r in ingest.active_users(old).collect()) == [1, 3]


def test_an_empty_page_ends_the_visit_in_later_batches(spark, tmp_path):
    from tagplace.streaming.jobs import stream_ingest

    pages, tables = f"{tmp_path}/pages", f"{tmp_path}/tables"
    for part in ("page_no < 2", "page_no >= 2"):
        feed(spark).where("user_id = 1").where(part).coalesce(1).write.mode("append").parquet(pages)
        stream_ingest(spark, pages, tables, f"{tmp_path}/check").awaitTermination()
    assert [r.id for r in spark.read.parquet(f"{tables}/media").collect()] == [1]


def test_streams_equal_batch(spark, tmp_path):
    from tagplace.streaming.jobs import read_users, stream_ingest

    pages, tables = f"{tmp_path}/pages", f"{tmp_path}/tables"
    feed(spark).where("user_id <= 2").coalesce(1).write.parquet(pages)
    for _ in range(2):
        stream_ingest(spark, pages, tables, f"{tmp_path}/check").awaitTermination()
    feed(spark).where("user_id > 2").coalesce(1).write.mode("append").parquet(pages)
    stream_ingest(spark, pages, tables, f"{tmp_path}/check").awaitTermination()
    assert [r.id for r in spark.read.parquet(f"{tables}/media").collect()] == [1]
    assert sorted(r.id for r in read_users(spark, tables).collect()) == [1, 2, 4]


def test_stream_state_over_many_batches(spark, tmp_path):
    """File by file, with a restart between, the stream gives what ``ingest_pages`` gives step by step."""
    from tagplace.streaming.jobs import read_users, stream_ingest

    rng = np.random.default_rng(11)
    pages, tables, n_user = f"{tmp_path}/pages", f"{tmp_path}/tables", 6
    made = {"users": None, "locations": None, "media": None}
    for step in range(6):
        rows = []
        for user in range(1, n_user + 1):
            code = int(rng.choice([200] * 8 + [400, 500]))
            items = [item(int(rng.integers(1, 40)), user if rng.random() < 0.8 else 77, str(rng.integers(1, 9)) if rng.random() < 0.9 else None, geo=rng.random() < 0.7) for _ in range(3)]
            rows.append((user, step, page(code, items if code == 200 else None, "m" if rng.random() < 0.9 else None)))
        frame = spark.createDataFrame(rows, "user_id long, page_no int, value string")
        frame.coalesce(1).write.mode("append").parquet(pages)
        got = ingest.ingest_pages(frame, made["users"], made["locations"], made["media"])
        for k in ("media", "locations"):
            new = got[k].collect()
            made[k] = spark.createDataFrame(([] if made[k] is None else made[k].collect()) + new, got[k].schema)
        old = made["users"] if made["users"] is not None else spark.createDataFrame([], got["users"].schema)
        made["users"] = spark.createDataFrame(ingest.upsert_users(old, got["users"]).collect(), got["users"].schema)
        if step % 3 == 2:
            stream_ingest(spark, pages, tables, f"{tmp_path}/check", files=1).awaitTermination()
    rows = lambda df: sorted(map(str, df.collect()))
    back = {k: spark.read.parquet(f"{tables}/{k}").select(*made[k].columns) for k in ("media", "locations")}
    assert len(rows(made["media"])) > 5 and rows(made["users"])
    for k in ("media", "locations"):
        assert rows(back[k]) == rows(made[k])
    assert rows(read_users(spark, tables).select(*made["users"].columns)) == rows(made["users"])


@pytest.mark.parametrize("block", ["128m", "3k"])
def test_class_model_line_numbers(spark, tmp_path, block):
    """Lines of many files of unequal sizes, read in many blocks, keep their numbers."""
    import random

    rng = random.Random(1)
    rows = [(i, f"c{i}", float(i), 1.0, 2.0, [f"t{j}" for j in range(rng.choice([0, 1, 3, 80 if i % 400 > 300 else 2]))]) for i in range(2000)]
    model = spark.createDataFrame(rows, "class_no long, class string, prior double, lat double, lon double, tags array<string>").repartition(5)
    models.write_class_model(model, f"{tmp_path}/m", 8)
    assert len(list((tmp_path / "m").glob("part-*.txt"))) == 8
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        back = models.read_class_model(spark, f"{tmp_path}/m").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.class_no for r in back) == list(range(2000)) and all(r["class"] == f"c{r.class_no}" for r in back)


def test_failed_refit_keeps_the_model(spark, tmp_path):
    path, frame = f"file://{tmp_path}/model", lambda n: spark.range(n).toDF("x")
    models.save_model({"centers": frame(3), "theta": frame(4)}, path)
    reader = models.load_model(spark, path)

    bad = frame(5).select(F.raise_error(F.lit("stop")).cast("long").alias("x"))
    with pytest.raises(Exception, match="stop"):
        models.save_model({"centers": frame(9), "theta": bad}, path)
    now = models.load_model(spark, path)
    assert {k: v.count() for k, v in now.items()} == {"centers": 3, "theta": 4}
    # a refit stage is seen when all are published, and what was read before stays readable
    draft = models.Draft(spark, path, load_existing=False)
    draft.fit_or_load(("centers",), lambda: {"centers": frame(7)})
    assert models.load_model(spark, path)["centers"].count() == 3
    draft.fit_or_load(("theta",), lambda: {"theta": frame(8)})
    draft.publish()
    assert {k: v.count() for k, v in models.load_model(spark, path).items()} == {"centers": 7, "theta": 8}
    assert reader["centers"].count() == 3
    # new tables of a first fit are kept when a later stage fails
    draft = models.Draft(spark, path)
    draft.fit_or_load(("terms",), lambda: {"terms": frame(2)})
    with pytest.raises(ZeroDivisionError):
        draft.fit_or_load(("cells",), lambda: 1 / 0)
    assert set(models.load_model(spark, path)) == {"centers", "theta", "terms"}
    models.prune_model(spark, path, 1)
    assert models.Version.numbers(spark, path) == [3] and models.load_model(spark, path)["centers"].count() == 7
    assert models.fit_or_load(spark, path, ("terms",), lambda: 1 / 0)["terms"].count() == 2


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/model"
    a, b = models.Draft(spark, path), models.Draft(spark, path)
    a.write({"x": spark.range(1)})
    b.write({"x": spark.range(2)})
    b.publish()
    a.publish()
    assert models.Version.numbers(spark, path) == [1, 2] and models.load_model(spark, path)["x"].count() == 1
    assert models.Version.of(spark, path, 1).read()["x"].count() == 2


def test_frontier(spark):
    follows = spark.createDataFrame([(1, i) for i in range(2, 12)] + [(2, 1), (3, 20)], "user_id long, follower_id long")
    seeds = spark.createDataFrame([(1,)], "user_id long")
    got = ingest.expand_frontier(seeds, follows, rounds=2).collect()
    assert sum(r.level == 1 for r in got) == 5 and len({r.user_id for r in got}) == len(got)
    stopped = spark.createDataFrame([(1, None, False, True)], "id long, next_max_id string, fully_scraped boolean, private boolean")
    assert ingest.expand_frontier(seeds, follows, stopped).count() == 1
    assert ingest.merge_frontier(seeds, seeds).count() == 1 and ingest.cap_frontier(follows.select("user_id"), 4).count() == 4
    assert [r.i for r in models.numbered(spark.range(100, numPartitions=7).toDF("x").orderBy(F.desc("x"))).orderBy(F.desc("x")).collect()] == list(range(100))


def test_train_and_save(spark, sf, tmp_path):
    from tagplace.jobs import fixtures, train

    docs = fixtures.media_docs(spark, sf)
    made = train.train(docs, f"{tmp_path}/model", per_class=40, max_iter=3)
    assert made["centers"].count() == 5 and made["cells"].count() == 5
    again = train.train(docs, f"{tmp_path}/model", per_class=40)
    assert sorted(map(tuple, again["centers"].collect())) == sorted(map(tuple, made["centers"].collect()))
    assert set(models.load_model(spark, f"{tmp_path}/model")) == {"centers", "cells", "terms", "classes", "theta"}
    kml.write_kml(kml.cells_kml(made["cells"]), f"{tmp_path}/kml")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/kml").collect())
    assert text.count("<Placemark>") == 5


@pytest.mark.parametrize("leaky", [False, True])
def test_folds_in_one_pass_equal_a_fit_for_each(spark, sf, leaky):
    from tagplace.jobs import fixtures, queries, train

    docs = models.settled(fixtures.media_docs(spark, sf), "docs")
    centers = models.settled(queries.fixed_centers(docs), "centers")
    got = {(r.fold, r.level): r.rate for r in train.fold_rates(docs, 3, centers=centers, leaky=leaky).collect()}
    rows = train.assign_folds(docs, 3)
    for fold in range(3):
        training, test = train.train_test_split(rows, fold)
        training = rows if leaky else training
        known = models.settled(terms.idf_fit(training), "terms")
        model = bayes.nb_fit(terms.idf_transform(training, known), cluster.assign_cells(training, centers), known.count())
        for r in predict.validate(test, cluster.assign_cells(test, centers), bayes.Scorer(known, model)).collect():
            assert math.isclose(got[fold, r.level], r.rate)
    assert len(got) == 9


@pytest.mark.parametrize(("region", "per_task"), [(5, 40), (60, 10_000), (10**6, 10**6)])
def test_nearest_by_regions_brute_force(spark, region, per_task):
    """Centres as a table: exact at the borders of regions, on ties, far from all centres, and with a crowded place."""
    from tagplace.operators.regions import nearest_by_regions

    rng = np.random.default_rng(3)
    c = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(5, 0.01, (80, 3)), np.zeros((3, 3)), rng.integers(-2, 3, (60, 3)).astype(float)])
    p = np.concatenate([rng.normal(0, 1.5, (300, 3)), rng.integers(-4, 5, (100, 3)) / 2, rng.normal(0, 60, (20, 3)), np.repeat([[5.0, 5.0, 5.0]], 300, axis=0), c[:20]])
    labels = rng.permutation(len(c)) + 7
    centers = spark.createDataFrame([(int(i), *map(float, x)) for i, x in zip(labels, c, strict=True)], "label int, x double, y double, z double")
    points = spark.createDataFrame([(i, *map(float, x), "k") for i, x in enumerate(p)], "id long, x double, y double, z double, kept string").repartition(3)
    got = nearest_by_regions(points, centers, region, per_task)
    assert got.columns == ["id", "x", "y", "z", "kept", "label", "d2"]
    d = sum((p[:, k, None] - c[None, :, k]) ** 2 for k in range(3))
    want = sorted((i, int(labels[row == row.min()].min()), float(row.min())) for i, row in enumerate(d))
    rows = sorted((r.id, r.label, r.d2) for r in got.collect())
    assert [r[:2] for r in rows] == [w[:2] for w in want] and np.allclose([r[2] for r in rows], [w[2] for w in want])
    assert nearest_by_regions(points.limit(0), centers, region, per_task).count() == 0


def test_many_centers_take_regions(spark, sf, monkeypatch):
    from tagplace.jobs import fixtures, queries

    docs = fixtures.media_docs(spark, sf)
    centers = models.settled(queries.fixed_centers(docs), "centers")
    few = sorted(map(tuple, cluster.assign_cells(docs, centers).collect()))
    monkeypatch.setattr(cluster, "MAX_CENTERS", 3)
    assert sorted(map(tuple, cluster.assign_cells(docs, centers).collect())) == few


def test_folds(spark, sf):
    from tagplace.jobs import fixtures, train

    rows = train.assign_folds(fixtures.media_docs(spark, sf))
    parts = [train.train_test_split(rows, k)[1].select("id").collect() for k in range(5)]
    assert sum(map(len, parts)) == rows.count() and len({r.id for p in parts for r in p}) == rows.count()
