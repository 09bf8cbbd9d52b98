"""Places for bags of tags: the best cell, the best k, or the smallest set that covers a probability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import request_terms
from .bayes import Scorer, score_bags

LEVELS = (1, 4, 16)


def attach_cells(ranked: DataFrame, cells: DataFrame) -> DataFrame:
    """``ranked`` with center [lat, lon] and polygon, from cells (label, lat, lon, ring); cells are few."""
    polygon = F.transform("ring", lambda p: F.array(p["lat"], p["lon"]))
    own = cells.select("label", F.array("lat", "lon").alias("center"), polygon.alias("polygon"))
    return ranked.join(own, "label")


def predict_multiple(docs: DataFrame, scorer: Scorer, cells: DataFrame, k: int = 1) -> DataFrame:
    """id, rank, label, probability, center, polygon of the best k cells."""
    return attach_cells(score_bags(docs, scorer, k), cells)


def predict_location(docs: DataFrame, scorer: Scorer, cells: DataFrame) -> DataFrame:
    return predict_multiple(docs, scorer, cells, 1)


def predict_cover(docs: DataFrame, scorer: Scorer, cells: DataFrame, p: float = 0.75) -> DataFrame:
    return attach_cells(score_bags(docs, scorer, None, p), cells)


def score_requests(requests: DataFrame, scorer: Scorer, cover: float = 0.75) -> DataFrame:
    """Ranked cells of requests (request_id, text, cnt): the best ``cnt``, or the cover set where it is null.

    Each distinct (terms, cnt) is scored once; only its key goes back to the requests.
    """
    asked = requests.select("request_id", request_terms(F.col("text")).alias("tags"), F.col("cnt").cast("int").alias("cnt"))
    asked = asked.withColumn("bag", F.md5(F.concat_ws("\x1f", F.col("cnt").cast("string"), F.lit("|"), F.array_join(F.array_sort("tags"), "\x1e")).cast("binary")))
    bags = asked.groupBy("bag").agg(F.first("tags").alias("tags"), F.first("cnt").alias("cnt"))
    ranked = score_bags(bags, scorer, "cnt", cover, key="bag")
    return asked.select("request_id", "bag").join(ranked, "bag").drop("bag")


def hit_rates(truth: DataFrame, ranked: DataFrame, levels: tuple[int, ...] = LEVELS, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, level, rate): share of rows (id, label) whose class is among the first ``level`` of ``ranked``, by columns
    of ``truth``."""
    at = truth.join(ranked.select("id", "label", "rank"), ["id", "label"], "left")
    rates = at.groupBy(*by).agg(*[F.avg(F.coalesce(F.col("rank") <= n, F.lit(False)).cast("double")).alias(str(n)) for n in levels])
    return rates.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(str(n)).alias("rate")) for n in levels])).alias("r")).select(*by, "r.*")


def validate(docs: DataFrame, truth: DataFrame, scorer: Scorer, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Hit rates; a true class that the model lacks is a miss."""
    return hit_rates(truth, score_bags(docs, scorer, max(levels)), levels)
