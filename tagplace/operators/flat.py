"""The flat class model: class priors and plain counts of tags."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parse import strip_braces_split
from ..functions.scores import normalise
from ..sources.models import numbered, settled
from .bayes import MAX_CLASSES, Scorer, score_bags

#: Classes whose sums of logarithms are equal to so many digits rank by number.
SMOOTHING, DECIMALS = 0.001, 9


def class_tag_counts(model: DataFrame) -> DataFrame:
    """(class_no, tag, n) of a model (class_no, ..., tags)."""
    return model.select("class_no", F.explode("tags").alias("tag")).groupBy("class_no", "tag").agg(F.count("*").alias("n"))


def class_frequency(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((class, n, size), (class, tag, n)) of rows (class, tags as brace text): rows and tags of each class, and how
    often it has each tag. Counts are rows of their own: no class is gathered into one value. A row without tags
    counts as one in its class's size (its text splits to one empty piece), but the empty piece is no tag."""
    rows = labelled.select("class", strip_braces_split(F.col("tags")).alias("tags"))
    sizes = rows.groupBy("class").agg(F.count("*").alias("n"), F.sum(F.size("tags")).alias("size"))
    return sizes, rows.select("class", F.explode("tags").alias("tag")).where("tag <> ''").groupBy("class", "tag").agg(F.count("*").alias("n"))


def zip_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row i of left beside row i of right, by their order."""
    return numbered(left, "i").join(numbered(right, "i"), "i")


def insert_coordinates(lines: DataFrame) -> DataFrame:
    """(class_no, value) of model lines (class_no, value, lat, lon): lat and lon become the third and fourth
    element, then the first empty element goes."""
    d = F.split("value", ",")
    wide = F.concat(F.slice(d, 1, 2), F.array(F.col("lat").cast("string"), F.col("lon").cast("string")), F.slice(d, 3, F.greatest(F.size(d) - 2, F.lit(0))))
    at = F.array_position("w", F.lit("")).cast("int")
    less = F.when(at > 0, F.concat(F.slice("w", F.lit(1), at - 1), F.slice("w", at + 1, F.size("w") - at))).otherwise(F.col("w"))
    return lines.select("class_no", wide.alias("w")).select("class_no", F.array_join(F.concat(less, F.array(F.lit(""))), ",").alias("value"))


def classify_flat(model: DataFrame, requests: DataFrame, n: int, smoothing: float | None = None) -> DataFrame:
    """id, rank, class_no, class, lat, lon, confidence: the ``n`` best classes of requests (id, tags).

    ``model`` has class_no, class, prior, lat, lon and tags or, instead of tags, ``size``, with the counts apart
    (see ``classify_counts``).
    """
    return classify_counts(model.withColumn("size", F.size("tags")), class_tag_counts(model), requests, n, smoothing)


def classify_counts(classes: DataFrame, counts: DataFrame, requests: DataFrame, n: int, smoothing: float | None = None) -> DataFrame:
    """The same from classes (class_no, class, prior, lat, lon, size) and counts (class_no, tag, n).

    A class's posterior is its prior times the product over the request's tags of (n + k) / (size + k). Products
    of many tags are too small for a double, so classes rank by the sum of logarithms and confidence is shared
    relative to the best. A request without tags has no rows. Equal posteriors rank by class_no, each class once; a
    class without tags, or unsmoothed with a tag it never had, has posterior 0, and if all have, so has every
    confidence. Smoothed, requests are scored in tasks, as by the sparse model; unsmoothed, they meet classes by the
    tags they share, and what the other tags add depends on their number only.
    """
    k = smoothing or 0.0
    asked = requests.where(F.size("tags") > 0)
    usable = classes.where((F.col("prior") > 0) & (F.col("size") + k > 0))
    # with fewer classes than are asked for, those with posterior 0 follow
    if k > 0 and usable.count() >= n:
        return _smoothed(usable, counts, asked, n, k)
    shared = asked.select("id", F.explode("tags").alias("tag")).join(counts, "tag").groupBy("id", "class_no").agg(F.count("*").alias("hits"), F.sum(F.log(F.col("n") + k)).alias("logs"))
    every = classes.agg(F.collect_list(F.struct(F.col("class_no").cast("long").alias("class_no"), "class", "lat", "lon", F.coalesce("prior", F.lit(0.0)).alias("prior"), "size")).alias("every"))
    # classes travel as one array, to every task if they are few
    few = classes.count() <= MAX_CLASSES
    pairs = asked.select("id", F.size("tags").alias("asked")).join(F.broadcast(every) if few else every).select("id", "asked", F.explode("every").alias("c")).select("id", "asked", "c.*")
    both = pairs.join(shared, ["id", "class_no"], "left")
    misses = F.col("asked") - F.coalesce("hits", F.lit(0))
    known = (F.col("prior") > 0) & (F.col("size") + k > 0) & ((misses == 0) | F.lit(k > 0))
    log_p = F.log("prior") + F.coalesce("logs", F.lit(0.0)) + misses * F.lit(math.log(k) if k else 0.0) - F.col("asked") * F.log(F.col("size") + k)
    scored = both.withColumn("log_p", F.when(known, log_p))
    by = W.partitionBy("id").orderBy(F.desc_nulls_last(F.round("log_p", DECIMALS)), "class_no")
    weight = F.coalesce(F.exp(F.col("log_p") - F.max("log_p").over(W.partitionBy("id"))), F.lit(0.0))
    out = scored.withColumn("weight", weight).select("id", "class_no", "class", "lat", "lon", normalise(F.col("weight"), "id").alias("confidence"), F.row_number().over(by).alias("rank"))
    return out.where(F.col("rank") <= n)


def _smoothed(classes: DataFrame, counts: DataFrame, asked: DataFrame, n: int, k: float) -> DataFrame:
    """``classify_counts`` of requests with tags, for classes that have a posterior: log prior + sum over all tags of
    log(k / (size + k)) + sum over shared ones of log((n + k) / k) is the sparse model's score with weights of 1. Only
    counts of tags that were asked for are sent."""
    null = F.lit("\0")  # a null tag counts as a miss
    bags = settled(asked.select("id", F.transform("tags", lambda t: F.coalesce(t, null)).alias("tags")), "asked")
    terms = settled(bags.select(F.explode("tags").alias("tag")).distinct().withColumn("weight", F.lit(1.0)), "terms")
    own = settled(numbered(classes.orderBy("class_no"), "label").withColumn("label", F.col("label").cast("int")), "classes")
    theta = counts.where(F.col("tag") != null).join(terms, "tag", "left_semi").join(own.select("class_no", "label"), "class_no").select("tag", "label", F.log(F.col("n") + k).alias("log_w"))
    model = {"classes": own.select("label", F.log("prior").alias("pi"), F.log(F.col("size") + k).alias("log_denom")), "theta": settled(theta, "theta")}
    best = score_bags(bags, Scorer(terms, model, k, DECIMALS), n)
    return best.join(own, "label").select("id", F.col("class_no").cast("long").alias("class_no"), "class", "lat", "lon", F.col("probability").alias("confidence"), "rank")
