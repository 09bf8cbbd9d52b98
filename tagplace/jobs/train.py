"""Training and cross-validation of the location model; each stage is saved and reused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import lla_to_ecef
from ..functions.scores import idf, log_prior
from ..operators.bayes import Scorer, class_denom, class_theta, nb_fit_bags, score_bags
from ..operators.cells import cells_of
from ..operators.cluster import MAX_CENTERS, assign_cells, cell_centers, kmeans_fit, labelled, num_classes, points_of
from ..operators.folds import Folds, fold_hits, freed, terms_by_fold
from ..operators.predict import LEVELS, hit_rates
from ..operators.terms import MAX_TERMS, idf_fit
from ..sources.models import Draft, deleted, settled

MIN_OCCURRENCES = 5


def train(media: DataFrame, path: str, per_class: int = 1000, load_existing: bool = True, seed: int = 42, max_iter: int = 50, polygons: bool = True) -> dict[str, DataFrame]:
    """centers, cells, terms, classes, theta under ``path``; a stage that is there already is only read.

    With ``load_existing`` off all are fitted anew and replace the published ones together, at the end.
    """
    spark = media.sparkSession
    rows = media.count()

    def clusters() -> dict[str, DataFrame]:
        centers = cell_centers(kmeans_fit(points_of(media), num_classes(rows, per_class), max_iter=max_iter, seed=seed)).persist()
        made = {"centers": centers}
        return made | {"cells": cells_of(centers)} if polygons else made

    draft = Draft(spark, path, load_existing)
    out = draft.fit_or_load(("centers", "cells") if polygons else ("centers",), clusters)
    out |= draft.fit_or_load(("terms",), lambda: {"terms": idf_fit(media, total=rows)})
    out |= draft.fit_or_load(("classes", "theta"), lambda: nb_fit_bags(labelled(media, out["centers"]), out["terms"], out["terms"].count()))
    draft.publish()
    return out


def assign_folds(rows: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """``rows`` with fold: from a hash of (seed, id), whatever the partitions."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))
    return rows.withColumn("fold", F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int"))


def train_test_split(rows: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)


def fold_average(rates: DataFrame) -> DataFrame:
    """Mean over folds of (fold, level, rate), not pooled over rows."""
    return rates.groupBy("level").agg(F.avg("rate").alias("rate"))


def fold_models(rows: DataFrame, labels: DataFrame, folds: int, leaky: bool = False, min_occurrences: int = 5, lam: float = 1.0) -> dict[str, DataFrame]:
    """terms, classes and theta of all folds' models, with the fold as a column ``model``.

    Tags are counted once by (label, tag, fold); what the model of a fold is fitted on is the total less the fold's own
    (``leaky``: the total). ``rows`` are (id, tags, fold), ``labels`` (id, label), or (model, id, label) where every
    fold has clusters of its own.
    """
    # rows meet their labels as bags, before they are a row a tag
    bags = rows.select("id", "fold", "tags").join(labels, "id")
    if "model" in labels.columns and not leaky:
        bags = bags.where("model <> fold")
    occurrences = bags.withColumn("tag", F.explode("tags")).drop("tags")
    own = F.array(*[F.sum((F.col("fold") == k).cast("long")) for k in range(folds)])

    def counted(table: DataFrame, *by: str) -> DataFrame:
        """(model, *by, n) of what each model is fitted on."""
        if "model" in table.columns:
            fitted = table if leaky else table.where("model <> fold")
            return fitted.groupBy("model", *by).agg(F.count("*").alias("n"))
        less = lambda x: F.col("n") - (F.lit(0) if leaky else x)
        n = table.groupBy(*by).agg(F.count("*").alias("n"), own.alias("own"))
        return n.select(*by, F.posexplode(F.transform("own", less)).alias("model", "n")).where("n > 0").select("model", *by, "n")

    counts = settled(counted(occurrences, "label", "tag"), "counts")
    sizes = settled(counted(rows.select("id", "fold").join(labels, "id"), "label"), "sizes")
    # a row for each fold
    totals = sizes.groupBy("model").agg(F.sum("n").alias("rows"), F.count("*").alias("labels"))
    tags = counts.groupBy("model", "tag").agg(F.sum("n").alias("n")).where(F.col("n") > min_occurrences)
    terms = settled(tags.join(F.broadcast(totals), "model").select("model", "tag", idf(F.col("rows"), F.col("n")).alias("weight")), "terms")
    sums = settled(counts.join(terms, ["model", "tag"]).select("model", "label", "tag", (F.col("n") * F.col("weight")).alias("sum_w")), "sums")
    weights = sums.groupBy("model", "label").agg(F.sum("sum_w").alias("sum_w"))
    totals = totals.join(terms.groupBy("model").agg(F.count("*").alias("known")), "model", "left").fillna(0, ["known"])
    classes = sizes.join(weights, ["model", "label"], "left").join(F.broadcast(totals), "model").withColumn("sum_w", F.coalesce("sum_w", F.lit(0.0)))
    classes = settled(classes.select("model", "label", "n", "sum_w", log_prior(F.col("n"), F.col("rows"), F.col("labels"), lam).alias("pi"), class_denom(F.col("sum_w"), F.col("known"), lam).alias("log_denom")), "classes")
    return {"terms": terms, "classes": classes, "theta": class_theta(sums, lam)}


def fold_rates(media: DataFrame, folds: int = 5, per_class: int = 1000, seed: int = 42, levels: tuple[int, ...] = LEVELS, leaky: bool = False, centers: DataFrame | None = None, max_iter: int = 50) -> DataFrame:
    """(fold, level, rate); ``leaky`` fits on all rows, ``centers`` are used instead of clustering each fold's rows.

    The models are counted and scored in blocks of classes (``operators/folds.py``). With more than ``MAX_TERMS`` terms or
    ``MAX_CENTERS`` centres they are tables.
    """
    spark, rows = media.sparkSession, settled(assign_folds(media, folds, seed), "folds")
    k = None if centers is not None else num_classes(rows.count() * (folds - 1), folds * per_class)
    counts = terms_by_fold(rows, folds, MIN_OCCURRENCES)
    if counts.count() > MAX_TERMS or (centers.limit(MAX_CENTERS + 1).count() if k is None else k) > MAX_CENTERS:
        return _fold_rates_by_tables(rows, folds, k, seed, levels, leaky, centers, max_iter)
    own = Folds(rows.select("id", "tags", "fold", *[c.alias(n) for c, n in zip(lla_to_ecef(F.col("latitude"), F.col("longitude")), "xyz", strict=True)]), counts, folds, leaky, MIN_OCCURRENCES, 1.0)
    deleted(spark, rows, counts)
    freed(spark)
    found = fold_hits(own, levels, centers, lambda points: kmeans_fit(points, k, max_iter=max_iter, seed=seed))
    own.delete()
    return spark.createDataFrame([(fold, level, int(n) / size) for fold, size, hits in found for level, n in zip(levels, hits, strict=True)], "fold int, level int, rate double")


def _fold_rates_by_tables(rows: DataFrame, folds: int, k: int | None, seed: int, levels: tuple[int, ...], leaky: bool, centers: DataFrame | None, max_iter: int) -> DataFrame:
    if centers is not None:
        labels = settled(assign_cells(rows, centers), "labels")
    else:
        labels = None
        for fold in range(folds):
            fitted = rows if leaky else train_test_split(rows, fold)[0]
            own = assign_cells(rows, kmeans_fit(points_of(fitted), k, max_iter=max_iter, seed=seed)).select(F.lit(fold).alias("model"), "id", "label")
            labels = own if labels is None else labels.unionByName(own)
        labels = settled(labels, "labels")
    made, ranked = fold_models(rows, labels, folds, leaky), None
    for fold in range(folds):
        own = {k: v.where(F.col("model") == fold).drop("model") for k, v in made.items()}
        # written fold by fold: neither the driver nor a task holds the models of several folds
        scored = settled(score_bags(train_test_split(rows, fold)[1], Scorer(own["terms"], own), max(levels)).select("id", "label", "rank"), "ranked")
        ranked = scored if ranked is None else ranked.unionByName(scored)
    truth = rows.select("id", "fold").join(labels, "id")
    truth = truth.where("model = fold") if "model" in labels.columns else truth
    return hit_rates(truth, ranked, levels, by=("fold",))


def cross_validate(media: DataFrame, folds: int = 5, per_class: int = 1000, seed: int = 42, levels: tuple[int, ...] = LEVELS, leaky: bool = False, centers: DataFrame | None = None, max_iter: int = 50) -> DataFrame:
    """(level, rate): mean hit rates over folds."""
    return fold_average(fold_rates(media, folds, per_class, seed, levels, leaky, centers, max_iter))
