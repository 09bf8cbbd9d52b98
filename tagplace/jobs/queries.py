"""Registered queries over the given tables, and their SQL twins for DuckDB."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, parse
from ..operators import bayes, cells, cluster, flat, ingest, predict, terms
from ..sources import keyed, kml, media, models
from . import fixtures as fx
from . import train


def _r(c, n: int = 6):
    return F.round(c, n)


def fixed_centers(docs: DataFrame) -> DataFrame:
    """One centre per language and quarter of the sources: mean of the points, in millimetres."""
    label = (F.floor(F.col("location_id") / 100) * 4 + F.floor((F.col("location_id") % 100) / 5)).cast("int")
    x, y, z = geo.lla_to_ecef(F.col("latitude"), F.col("longitude"))
    return docs.select(label.alias("label"), x.alias("x"), y.alias("y"), z.alias("z")).groupBy("label").agg(*[_r(F.avg(c), 3).alias(c) for c in "xyz"])


class Fitted:
    """The model of all documents with the fixed centres; tables are computed once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.docs = models.settled(fx.media_docs(spark, sf_dir), "docs")
        self.centers = models.settled(fixed_centers(self.docs), "centers")
        self.labels = models.settled(cluster.assign_cells(self.docs, self.centers), "labels")
        self.terms = models.settled(terms.idf_fit(self.docs), "terms")
        made = bayes.nb_fit_bags(cluster.labelled(self.docs, self.centers), self.terms, self.terms.count())
        self.model = {k: models.settled(v, k) for k, v in made.items()}

    @functools.cached_property
    def features(self) -> DataFrame:
        return models.settled(terms.idf_transform(self.docs, self.terms), "features")

    def scorer(self) -> bayes.Scorer:
        return bayes.Scorer(self.terms, self.model)


# --- parsing and coordinates ------------------------------------------------------------------------------

def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda x: F.col(x).cast("string")
    odd = lambda n, at, x: F.when(F.col("id") % n == at, x).otherwise("")
    line = F.concat(odd(5, 0, " "), c("id"), F.lit(","), c("user_id"), F.lit(',2015-10-01 10:00:00,"{'), F.array_join("tags", ","), odd(7, 3, '""x""'), F.lit('}",'), c("location_id"), F.lit(","), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("location_name")), F.lit(","), c("user_id"), F.lit(".5,"), F.when(F.col("id") % 11 == 4, "abc").otherwise("7.25"), odd(13, 5, ",9"))
    return fx.media_docs(spark, sf_dir).select("id", line.alias("line"))


def csv_fields(spark, sf_dir):
    f = _lines(spark, sf_dir).select("id", parse.csv_fields(parse.java_trim(F.col("line"))).alias("f"))
    return f.select("id", F.size("f").cast("long").alias("n"), F.md5(F.array_join("f", "|").cast("binary")).alias("fields_md5"))


def media_csv(spark, sf_dir):
    rows = media.parse_media_lines(_lines(spark, sf_dir), "line").where("not rejected")
    return rows.select("id", "user_id", F.size("tags").cast("long").alias("n_tags"), F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "location_id", "location_name", "latitude", "longitude")


def tag_list(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.concat(F.when(F.col("doc_id") % 4 == 1, "").otherwise("{"), F.regexp_replace("text", "[ ]+", ","), F.when(F.col("doc_id") % 5 == 2, "}{").otherwise(""), F.lit("}"))
    t = d.select("doc_id", parse.tag_list(text).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|").cast("binary")).alias("tags_md5"))


def request_terms(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    t = c.select("conv_id", "turn", parse.request_terms(F.translate("text", " .", "+,")).alias("t"))
    return t.groupBy("conv_id", "turn").agg(F.count("*").alias("n_rows"), F.sum(F.size("t")).cast("long").alias("n_terms"), F.min(F.md5(F.array_join("t", "|").cast("binary"))).alias("terms_md5"))


def media_samples(spark, sf_dir):
    rows = ingest.first_seen(fx.frame(spark, sf_dir, fx.SALES_MEDIA), "id", ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    out = ingest.media_samples(rows, fx.frame(spark, sf_dir, fx.PLACES))
    return out.select("id", "user_id", F.array_join("tags", " ").alias("tags"), "location_id", "location_name", "latitude", "longitude")


def ecef(spark, sf_dir):
    return cluster.points_of(fx.media_docs(spark, sf_dir)).select("id", *[_r(F.col(c), 3).alias(c) for c in "xyz"])


def ecef_roundtrip(spark, sf_dir):
    lat, lon, alt = geo.ecef_to_lla(F.col("x"), F.col("y"), F.col("z"))
    return cluster.points_of(fx.media_docs(spark, sf_dir)).select("id", _r(lat).alias("lat"), _r(lon).alias("lon"), (F.abs(alt) < 0.01).alias("at_sea_level"))


# --- tags ---------------------------------------------------------------------------------------------------


def tag_counts(spark, sf_dir):
    return terms.tag_counts(fx.media_docs(spark, sf_dir))


def idf_terms(spark, sf_dir):
    return terms.idf_fit(fx.media_docs(spark, sf_dir)).select("tag", "n", _r(F.col("weight"), 9).alias("weight"))


def tag_weights(spark, sf_dir):
    docs = models.settled(fx.media_docs(spark, sf_dir).select("id", "tags"), "docs")
    return terms.idf_transform(docs, models.settled(terms.idf_fit(docs), "terms")).select("id", "tag", _r(F.col("w")).alias("w"))


# --- cells --------------------------------------------------------------------------------------------------


def _assigned(spark, sf_dir):
    docs = fx.media_docs(spark, sf_dir)
    centers = models.settled(fixed_centers(docs), "centers")
    return cluster.nearest_center(cluster.points_of(docs), centers), centers


def cell_assign(spark, sf_dir):
    return _assigned(spark, sf_dir)[0].select("id", "label", _r(F.col("d2"), 0).alias("d2"))


def cell_cost(spark, sf_dir):
    return _assigned(spark, sf_dir)[0].agg(_r(F.sum("d2") / 1e9, 3).alias("cost_e9"), F.count("*").alias("n"))


def cell_centroids(spark, sf_dir):
    near, centers = _assigned(spark, sf_dir)
    return cluster.centroids(near, centers).select("label", *[_r(F.col(c), 3).alias(c) for c in "xyz"], "n")


def candidate_weights(spark, sf_dir):
    docs = fx.media_docs(spark, sf_dir)
    centers = models.settled(fixed_centers(docs), "centers")
    return cluster.candidate_weights(cluster.points_of(fx.media_sales(spark, sf_dir)), centers).select("label", "weight")


def kmeans_fit(spark, sf_dir):
    """The sales rows in classes of about 1000, the default."""
    points = models.settled(cluster.points_of(fx.media_sales(spark, sf_dir)), "points")
    k = cluster.num_classes(points.count(), 1000)
    return cluster.cell_centers(cluster.kmeans_fit(points, k))


def cell_polygons(spark, sf_dir):
    docs = fx.media_docs(spark, sf_dir)
    return cells.cell_polygons(models.settled(fixed_centers(docs), "centers"))


def kml_cells(spark, sf_dir):
    docs = fx.media_docs(spark, sf_dir)
    return kml.cells_kml(cells.cells_of(models.settled(fixed_centers(docs), "centers")))


def cell_corners(spark, sf_dir):
    """A row for each corner of each cell."""
    made = cell_polygons(spark, sf_dir).select("label", F.explode("ring").alias("c"))
    return made.select("label", _r(F.col("c.lat")).alias("lat"), _r(F.col("c.lon")).alias("lon"))


def kml_cell_texts(spark, sf_dir):
    """The lines of the cells' document, with corners to two digits, as digests."""
    docs = fx.media_docs(spark, sf_dir)
    made = cells.cells_of(models.settled(fixed_centers(docs), "centers"))
    ring = F.transform("ring", lambda c: F.struct(_r(c["lat"], 2).alias("lat"), _r(c["lon"], 2).alias("lon")))
    return kml.cells_kml(made.withColumn("ring", ring)).select("section", "sort", F.md5(F.col("value").cast("binary")).alias("value_md5"))


def class_counts(spark, sf_dir):
    """How many classes of 10 media each place and language would make, and with three of four folds of training rows."""
    rows = fx.media_docs(spark, sf_dir).groupBy("location_name").agg(F.count("*").alias("n")).where("n >= 14").toPandas()  # a row a place
    made = [(r.location_name, cluster.num_classes(int(r.n), 10), cluster.num_classes(int(r.n) * 3, 4 * 10)) for r in rows.itertuples()]
    return spark.createDataFrame(made, "place string, k int, k_folds int")


def kml_points(spark, sf_dir):
    docs = fx.media_docs(spark, sf_dir)
    centers = models.settled(fixed_centers(docs), "centers")
    rows = docs.join(cluster.assign_cells(docs, centers), "id")
    return kml.points_kml(rows.select(F.array_join("tags", " & ").alias("tags"), _r(F.col("latitude"), 2).alias("lat"), _r(F.col("longitude"), 2).alias("lon"), F.col("label").alias("cluster"))).select("section", "sort", F.md5(F.col("value").cast("binary")).alias("value_md5"))


# --- classes ------------------------------------------------------------------------------------------------


def nb_classes(spark, sf_dir):
    return Fitted(spark, sf_dir).model["classes"].select("label", "n", *[_r(F.col(c)).alias(c) for c in ("sum_w", "pi", "log_denom")])


def nb_theta(spark, sf_dir):
    return Fitted(spark, sf_dir).model["theta"].select("label", "tag", *[_r(F.col(c)).alias(c) for c in ("sum_w", "log_w")])


def nb_scores(spark, sf_dir):
    f = Fitted(spark, sf_dir)
    return bayes.nb_predict_all(f.docs, f.scorer()).select("id", "label", _r(F.col("score"), 4).alias("score"))


def nb_top_k(spark, sf_dir):
    f = Fitted(spark, sf_dir)
    return bayes.score_bags(f.docs, f.scorer(), 3).select("id", "rank", "label", _r(F.col("probability")).alias("probability"))


def nb_cover(spark, sf_dir):
    f = Fitted(spark, sf_dir)
    return bayes.cover_probability(bayes.nb_predict_all(f.docs, f.scorer())).select("id", "rank", "label", _r(F.col("probability")).alias("probability"))


def nb_argmax(spark, sf_dir):
    f = Fitted(spark, sf_dir)
    return bayes.argmax_class(models.settled(bayes.nb_predict_all(f.docs, f.scorer()).select("id", "label", "score"), "scores"))


def predict_location(spark, sf_dir):
    f = Fitted(spark, sf_dir)
    places = cells.cells_of(f.centers)
    out = predict.predict_location(f.docs, f.scorer(), places)
    return out.select("id", "label", _r(F.element_at("center", 1)).alias("lat"), _r(F.element_at("center", 2)).alias("lon"), _r(F.col("probability")).alias("probability"))


def predictions_json(spark, sf_dir):
    f = Fitted(spark, sf_dir)
    return kml.predictions_to_json(predict.predict_cover(f.docs, f.scorer(), cells.cells_of(f.centers)))


def _requests(spark, sf_dir):
    return fx.frame(spark, sf_dir, fx.REQUESTS).withColumn("text", F.regexp_replace(F.lower("text"), "[^a-z]+", "+"))


def score_requests(spark, sf_dir):
    f = Fitted(spark, sf_dir)
    out = predict.score_requests(_requests(spark, sf_dir), f.scorer())
    return out.select("request_id", F.col("rank").cast("long").alias("rank"), "label", _r(F.col("probability")).alias("probability"))


def hit_rates(spark, sf_dir):
    f = Fitted(spark, sf_dir)
    return predict.validate(f.docs, f.labels, f.scorer()).select("level", _r(F.col("rate")).alias("rate"))


def fold_sizes(spark, sf_dir):
    return train.assign_folds(fx.media_docs(spark, sf_dir)).groupBy("fold").agg(F.count("*").alias("n"))


def cross_validate(spark, sf_dir):
    docs = fx.media_docs(spark, sf_dir)
    centers = models.settled(fixed_centers(docs), "centers")
    return train.cross_validate(docs, centers=centers).select("level", _r(F.col("rate")).alias("rate"))


def cross_validate_clusters(spark, sf_dir):
    return train.cross_validate(fx.media_docs(spark, sf_dir), per_class=100)


# --- flat classes -------------------------------------------------------------------------------------------


def _flat(spark, sf_dir):
    """(classes, counts): classes are language and source, in order of their names; tags are their documents' words."""
    docs = fx.media_docs(spark, sf_dir)
    rows = models.settled(docs.select(F.col("location_id").cast("long").alias("class"), F.concat(F.lit("{"), F.array_join("tags", ","), F.lit("}")).alias("tags"), "latitude", "longitude"), "rows")
    total = rows.count()
    at = rows.groupBy("class").agg(F.min("latitude").alias("lat"), F.min("longitude").alias("lon"))
    sizes, counts = flat.class_frequency(rows)
    classes = sizes.join(at, "class").select(F.col("class").alias("class_no"), F.concat(F.lit("c"), F.col("class").cast("string")).alias("class"), (F.col("n") / F.lit(total)).alias("prior"), "lat", "lon", "size")
    return models.settled(classes, "classes"), models.settled(counts.withColumnRenamed("class", "class_no"), "counts")


def class_frequency(spark, sf_dir):
    return _flat(spark, sf_dir)[0].select("class_no", _r(F.col("prior"), 9).alias("prior"), F.col("size").alias("n_tags"))


def class_tag_counts(spark, sf_dir):
    """Counts from the classes' own tag lists, as a model file has them."""
    return flat.class_tag_counts(_class_model(*_flat(spark, sf_dir)))


def _class_model(classes, counts):
    """The model with its tag lists, as a file has it: a tag stands there as often as it was counted."""
    tags = counts.groupBy("class_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tag", "n"))), lambda x: F.array_repeat(x["tag"], x["n"].cast("int")))).alias("tags"))
    return classes.drop("size").join(tags, "class_no")


def _bags(spark, sf_dir):
    """The distinct words of each user turn."""
    return _requests(spark, sf_dir).select(F.col("request_id").alias("id"), F.array_distinct(parse.request_terms(F.col("text"))).alias("tags"))


def _flat_out(out):
    return out.select("id", F.col("rank").cast("long").alias("rank"), "class_no", "class", _r(F.col("confidence")).alias("confidence"))


def flat_mle(spark, sf_dir):
    """Passages of the benchmark as bags: some classes have all of their words."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bags = items.select(F.col("item_id").alias("id"), F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " ")).alias("tags"))
    return _flat_out(flat.classify_counts(*_flat(spark, sf_dir), bags, 3))


def flat_smoothed(spark, sf_dir):
    return _flat_out(flat.classify_counts(*_flat(spark, sf_dir), _bags(spark, sf_dir), 3, flat.SMOOTHING))


def insert_coordinates(spark, sf_dir):
    m, counts = _flat(spark, sf_dir)
    tags = counts.groupBy("class_no").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    lines = m.join(tags, "class_no").select("class_no", F.concat("class", F.lit(",0.5,"), F.array_join("tags", ","), F.lit(",")).alias("value"), _r(F.col("lat"), 2).alias("lat"), _r(F.col("lon"), 2).alias("lon"))
    return flat.insert_coordinates(lines).select("class_no", F.md5(F.col("value").cast("binary")).alias("value_md5"))


# --- ingest -------------------------------------------------------------------------------------------------


def pages_until_empty(spark, sf_dir):
    return ingest.pages_until_empty(fx.frame(spark, sf_dir, fx.PAGES))


def user_scrape_state(spark, sf_dir):
    pages = ingest.pages_until_empty(fx.frame(spark, sf_dir, fx.PAGES))
    coded = pages.select("user_id", "page_no", "n_geo", F.when(F.col("user_id") % 10 == 0, 400).otherwise(200).alias("code"), F.when(F.col("n_media") == 3, F.col("page_no").cast("string")).alias("next_max_id"))
    return ingest.user_scrape_state(coded)


def insert_if_absent(spark, sf_dir):
    rows = fx.frame(spark, sf_dir, fx.MEDIA_SALES_RAW)
    old = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select((F.col("o_orderkey") * 10 + 1).alias("id"))
    out = ingest.insert_if_absent(rows, old, "id", ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    return out.select("id", "user_id", "l_partkey", "l_suppkey")


def sample_successors(spark, sf_dir):
    return ingest.sample_successors(fx.frame(spark, sf_dir, fx.FOLLOWS))


def _frontier(spark, sf_dir, follows):
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    posters = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id"))
    return ingest.expand_frontier(ingest.seed_from_users(known.join(posters, "id", "left_semi"), 25), follows, rounds=2)


def expand_frontier(spark, sf_dir):
    return _frontier(spark, sf_dir, fx.frame(spark, sf_dir, fx.FOLLOWS))


def frontier_by_key(spark, sf_dir):
    """The same, with the follows as a table by user."""
    return _frontier(spark, sf_dir, keyed.Keyed.create(fx.frame(spark, sf_dir, fx.FOLLOWS), _room(spark, "follows"), "user_id"))


def _line_table(spark, sf_dir, where: str) -> keyed.Keyed:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(where)
    return keyed.Keyed.create(lines.select("l_orderkey", "l_linenumber", "l_quantity"), _room(spark, "lines"), "l_orderkey")


def rows_by_key(spark, sf_dir):
    """Lines of the urgent orders, read by key from a table of all lines."""
    urgent = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return _line_table(spark, sf_dir, "true").rows(urgent)


def lacking_by_key(spark, sf_dir):
    """Orders without a line that was returned."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return _line_table(spark, sf_dir, "l_returnflag = 'R'").lacking(orders)


def upsert_by_key(spark, sf_dir):
    """The table of finished orders' lines after the open orders' ones were added and the urgent orders' ones replaced."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    of = lambda which: lines.join(orders.where(which).select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    table = keyed.Keyed.create(of("o_orderstatus = 'F'"), _room(spark, "lines"), "l_orderkey")
    table.append(of("o_orderstatus = 'O'"))
    table.upsert(of("o_orderpriority = '1-URGENT'").where("l_linenumber = 1").withColumn("l_quantity", -F.col("l_quantity")))
    return keyed.Keyed.open(spark, table.path).all()


def random_users(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    return ingest.random_users(users, 25)


def _feed(spark, sf_dir):
    """A feed page per user and page number: its events as items, some without a place, some private users."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    from pyspark.sql import Window as W

    page = F.floor((F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))) - 1) / 3).cast("int")
    place = F.when(F.col("event_type").isin("view", "purchase"), F.struct((F.col("event_id") % 40).cast("string").alias("id"), F.concat(F.lit("p"), (F.col("event_id") % 40).cast("string")).alias("name"), ((F.col("event_id") % 40) * 1.5).alias("latitude"), ((F.col("event_id") % 40) * 2.5).alias("longitude")))
    item = F.struct(F.concat(F.col("event_id").cast("string"), F.lit("_"), F.col("user_id").cast("string")).alias("id"), F.lit("1443693600").alias("created_time"), F.when(F.col("event_type") == "view", F.struct(F.concat(F.lit("seen "), F.col("event_id").cast("string")).alias("text"))).alias("caption"), F.array("event_type").alias("tags"), F.lit("image").alias("type"), F.struct(F.col("user_id").cast("string").alias("id")).alias("user"), place.alias("location"))
    pages = e.withColumn("page_no", page).groupBy("user_id", "page_no").agg(F.array_sort(F.collect_list(item)).alias("data"))
    private = F.col("user_id") % 10 == 0
    body = F.struct(F.struct(F.when(private, 400).otherwise(200).alias("code")).alias("meta"), F.struct(F.when(F.size("data") == 3, F.col("page_no").cast("string")).alias("next_max_id")).alias("pagination"), F.when(~private, F.col("data")).alias("data"))
    return pages.select("user_id", "page_no", F.to_json(body).alias("value"))


def ingest_media(spark, sf_dir):
    out = ingest.ingest_pages(models.settled(_feed(spark, sf_dir), "feed"))["media"]
    return out.select("id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.element_at("tags", 1).alias("tag"), "user_id", "location_id")


def ingest_users(spark, sf_dir):
    return ingest.ingest_pages(models.settled(_feed(spark, sf_dir), "feed"))["users"]


def stream_ingest(spark, sf_dir):
    """The feed through the stream, in several files: media as in one batch."""
    from ..streaming.jobs import stream_ingest as stream

    root = _room(spark, "stream")
    feed = models.settled(_feed(spark, sf_dir), "feed")
    # a user's pages arrive in two runs of the stream
    for part in ("page_no < 2", "page_no >= 2"):
        feed.where(part).repartition(4, "user_id").write.mode("append").parquet(f"{root}/pages")
        stream(spark, f"{root}/pages", f"{root}/tables", f"{root}/checkpoint", files=2, partitions=spark.sparkContext.defaultParallelism).awaitTermination()
    return spark.read.parquet(f"{root}/tables/media").select("id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.element_at("tags", 1).alias("tag"), "user_id", "location_id")


def stream_score(spark, sf_dir):
    from ..streaming.jobs import stream_score as stream

    f = Fitted(spark, sf_dir)
    root = _room(spark, "stream")
    _requests(spark, sf_dir).select("request_id", "text", F.col("cnt").cast("int").alias("cnt")).repartition(4, "request_id").write.parquet(f"{root}/requests")
    stream(spark, f"{root}/requests", f"{root}/out", f"{root}/checkpoint", f.scorer(), files=2).awaitTermination()
    out = spark.read.parquet(f"{root}/out").drop("batch")
    return out.select("request_id", F.col("rank").cast("long").alias("rank"), "label", _r(F.col("probability")).alias("probability"))


# --- files, answers and smaller operators -------------------------------------------------------------------


def _room(spark, name: str) -> str:
    """A new folder in the shared one."""
    return models.fresh_path(spark, name)


def class_model_files(spark, sf_dir):
    """The flat model written as text lines in ten files and read back with the lines' numbers."""
    model, path = _class_model(*_flat(spark, sf_dir)), _room(spark, "flat")
    models.write_class_model(model, path, 10)
    back = models.read_class_model(spark, path)
    return back.select(F.col("class_no").cast("long").alias("line"), "class", _r(F.col("prior"), 9).alias("prior"), _r(F.col("lat")).alias("lat"), _r(F.col("lon")).alias("lon"), F.md5(F.array_join("tags", ",").cast("binary")).alias("tags_md5"))


def class_predictions_json(spark, sf_dir):
    """The flat answers as JSON, read back."""
    out = flat.classify_counts(*_flat(spark, sf_dir), _bags(spark, sf_dir), 3, flat.SMOOTHING)
    got = kml.class_predictions_to_json(out).select("id", F.from_json("json", "array<struct<lat:double,lon:double,confidence:double,classNum:bigint>>").alias("r"))
    return got.select("id", F.posexplode("r").alias("rank", "r")).select("id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("r.classNum").alias("class_no"), _r(F.col("r.confidence")).alias("confidence"), _r(F.col("r.lat")).alias("lat"), _r(F.col("r.lon")).alias("lon"))


def predict_cover(spark, sf_dir):
    f = Fitted(spark, sf_dir)
    out = predict.predict_cover(f.docs, f.scorer(), cells.cells_of(f.centers))
    return out.select("id", F.col("rank").cast("long").alias("rank"), "label", _r(F.element_at("center", 1)).alias("lat"), _r(F.element_at("center", 2)).alias("lon"), _r(F.col("probability")).alias("probability"))


def predictions_json_read(spark, sf_dir):
    """The service's answers as JSON, read back."""
    kind = "struct<status:int,error:string,result:array<struct<center:array<double>,polygon:array<array<double>>,probability:double>>>"
    got = predictions_json(spark, sf_dir).select("id", F.from_json("json", kind).alias("j"))
    rows = got.select("id", "j.status", "j.error", F.posexplode("j.result").alias("rank", "r"))
    return rows.select("id", "status", "error", (F.col("rank") + 1).cast("long").alias("rank"), _r(F.element_at("r.center", 1)).alias("lat"), _r(F.element_at("r.center", 2)).alias("lon"), _r(F.col("r.probability")).alias("probability"), (F.size("r.polygon") >= 3).alias("has_polygon"))


def cluster_csv(spark, sf_dir):
    """Labelled rows written as CSV and read by the cluster reader."""
    docs, path = fx.media_docs(spark, sf_dir), _room(spark, "csv")
    rows = docs.join(cluster.assign_cells(docs, models.settled(fixed_centers(docs), "centers")), "id")
    rows.select("id", F.array_join("tags", ","), _r(F.col("latitude"), 2), _r(F.col("longitude"), 2), F.concat(F.lit("c"), F.col("label").cast("string"))).write.csv(path)
    return media.read_cluster_csv(spark, path).select(F.md5(F.col("tags").cast("binary")).alias("tags_md5"), "lat", "lon", "cluster")


def train_resumed(spark, sf_dir):
    """Training from saved centres: the stages that are missing are fitted, saved and read again."""
    docs, path = models.settled(fx.media_docs(spark, sf_dir), "docs"), _room(spark, "model")
    models.save_model({"centers": cluster.cell_centers(fixed_centers(docs))}, path)
    train.train(docs, path, polygons=False)
    loaded = models.load_model(spark, path)
    return loaded["classes"].select("label", "n", *[_r(F.col(c)).alias(c) for c in ("sum_w", "pi", "log_denom")])


def train_clusters(spark, sf_dir):
    """Training with k-means and cells, as (name, n): rows of the published tables, and how many centres are off the mean
    of their points, rings are open, and (0 or 1) whether the cost is above half of that of a single centre."""
    docs, path = models.settled(fx.media_docs(spark, sf_dir), "docs"), _room(spark, "model")
    train.train(docs, path, per_class=100)
    made = models.load_model(spark, path)
    points = cluster.points_of(docs)
    near = models.settled(cluster.nearest_center(points, made["centers"]), "near")
    centers = made["centers"].select("label", *[F.col(c).alias(f"c{c}") for c in "xyz"])
    off = cluster.centroids(near, made["centers"].select("label", "x", "y", "z")).join(centers, "label").where(geo.square_dist([F.col(c) for c in "xyz"], [F.col(f"c{c}") for c in "xyz"]) > 1.0)
    single = points.agg(sum((F.var_pop(c) for c in "xyz"), F.lit(0.0)) * F.count("*")).first()[0]
    counts = {
        "centers": made["centers"].agg(F.count("*")), "cells": made["cells"].agg(F.count("*")), "labelled": made["classes"].agg(F.sum("n")), "terms": made["terms"].agg(F.count("*")),
        "assigned": near.agg(F.count("*")), "off_mean": off.agg(F.count("*")), "open_rings": made["cells"].where(F.size("ring") < 3).agg(F.count("*")), "dear": near.agg((F.sum("d2") > 0.5 * single).cast("long")),
    }
    parts = [v.toDF("n").select(F.lit(k).alias("name"), F.col("n").cast("long").alias("n")) for k, v in counts.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def stored_tables(spark, sf_dir):
    """The crawl's tables written and read: rows, distinct keys and the sum of keys of each."""
    made, path = ingest.ingest_pages(models.settled(_feed(spark, sf_dir), "feed")), _room(spark, "tables")
    models.write_tables({k: made[k] for k in ("users", "locations", "media")}, path)
    back = models.read_tables(spark, path)
    parts = [back[k].agg(F.lit(k).alias("name"), F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.sum("id").alias("sum_ids")) for k in ("users", "locations", "media")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def captions(spark, sf_dir):
    out = ingest.ingest_pages(models.settled(_feed(spark, sf_dir), "feed"))["media"]
    return out.select("id", "caption")


def place_names(spark, sf_dir):
    """Nested access with a default: the place's name of every feed item."""
    _, items = media.read_feed_pages(_feed(spark, sf_dir), keep=("user_id",))
    item = items.where("id is not null")
    return item.select(parse.media_key(F.col("id")).alias("id"), parse.safe_access(F.col("location"), "nowhere", "name").alias("place"))


def query_terms(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    t = c.select("conv_id", "turn", parse.query_terms(F.col("text")).alias("t"))
    return t.groupBy("conv_id", "turn").agg(F.count("*").alias("n_rows"), F.sum(F.size("t")).cast("long").alias("n_terms"), F.min(F.md5(F.array_join("t", "|").cast("binary"))).alias("terms_md5"))


def batch_requests(spark, sf_dir):
    r = _requests(spark, sf_dir)
    body = F.to_json(F.struct(F.split("text", "[+]").alias("tags"), F.col("cnt").alias("count"), F.concat(F.lit("p"), F.col("request_id").cast("string")).alias("param")))
    out = media.batch_requests(r.select(body.alias("value")))
    return out.select("param", F.coalesce("count", F.lit(-1)).cast("long").alias("cnt"), F.size("tags").cast("long").alias("n_tags"), F.md5(F.array_join("tags", "|").cast("binary")).alias("tags_md5"))


def zip_rows(spark, sf_dir):
    """Customers by key beside suppliers by name, row by row."""
    left = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").orderBy("c_custkey")
    right = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name").orderBy(F.desc("s_name"), "s_suppkey")
    return flat.zip_rows(left, right)


def cap_frontier(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("user_id"))
    return ingest.cap_frontier(orders, ingest.QUEUE_SIZE)


def merge_frontier(spark, sf_dir):
    follows = fx.frame(spark, sf_dir, fx.FOLLOWS)
    return ingest.merge_frontier(follows.select("user_id"), follows.select(F.col("follower_id").alias("user_id")))


def sample_one(spark, sf_dir):
    return cluster.sample_one(fx.media_docs(spark, sf_dir).select("id"), 42)


def oversample_centers(spark, sf_dir):
    near, _ = _assigned(spark, sf_dir)
    near = models.settled(near, "near")
    total = near.agg(F.sum("d2")).first()[0]
    return cluster.oversample_centers(near, 30, total, 42, 1).select(*[_r(F.col(c), 3).alias(c) for c in "xyz"])


def surface_points(spark, sf_dir):
    """Points lifted over the ground, put back to sea level, and their squared distances from where they were."""
    p = cluster.points_of(fx.media_docs(spark, sf_dir))
    s = geo.surface_point(F.col("x") * 1.001, F.col("y") * 1.001, F.col("z") * 1.001)
    rows = p.select("id", "x", "y", "z", *[c.alias(n) for c, n in zip(s, ("sx", "sy", "sz"), strict=True)])
    lifted = geo.square_dist([F.col(c) for c in "xyz"], [F.col(c) * 1.001 for c in "xyz"])
    return rows.select("id", *[_r(F.col(c), 2).alias(c) for c in ("sx", "sy", "sz")], _r(F.sqrt(lifted), 2).alias("lift"))


def seed_users(spark, sf_dir):
    _, items = media.read_feed_pages(_feed(spark, sf_dir), keep=("page_no",))
    return ingest.seed_users(items)


def ingest_known_users(spark, sf_dir):
    """A step after an earlier one: who was private, finished or at an empty page then is not visited again."""
    feed = models.settled(_feed(spark, sf_dir), "feed")
    first = models.settled(ingest.ingest_pages(feed.where("page_no = 0"))["users"], "users")
    out = ingest.ingest_pages(feed.where("page_no > 0"), first)["media"]
    return out.select("id", F.element_at("tags", 1).alias("tag"), "user_id", "location_id")


def active_users(spark, sf_dir):
    return ingest.active_users(ingest.ingest_pages(models.settled(_feed(spark, sf_dir), "feed"))["users"]).select("id", "next_max_id")


_ALL = [
    csv_fields, media_csv, tag_list, request_terms, media_samples, ecef, ecef_roundtrip, tag_counts, idf_terms, tag_weights, cell_assign, cell_cost, cell_centroids, candidate_weights, kmeans_fit,
    cell_polygons, cell_corners, kml_cells, kml_cell_texts, class_counts, kml_points, nb_classes, nb_theta, nb_scores, nb_top_k, nb_cover, nb_argmax, predict_location, predictions_json, score_requests, hit_rates, fold_sizes, cross_validate,
    cross_validate_clusters, class_frequency, class_tag_counts, flat_mle, flat_smoothed, insert_coordinates, pages_until_empty, user_scrape_state, insert_if_absent, sample_successors, expand_frontier,
    frontier_by_key, rows_by_key, lacking_by_key, upsert_by_key,
    random_users, ingest_media, ingest_users, stream_ingest, stream_score, class_model_files, class_predictions_json, predict_cover, predictions_json_read, cluster_csv, train_resumed, train_clusters, stored_tables,
    captions, place_names, query_terms, batch_requests, zip_rows, cap_frontier, merge_frontier, sample_one, oversample_centers, surface_points, seed_users, ingest_known_users, active_users,
]


def queries() -> dict:
    return {f.__name__: f for f in _ALL}
