"""Readers of media rows, feed pages, requests and labelled clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..schemas import CLUSTER_CSV, FEED_PAGE, REQUEST


def parse_media_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Media columns and ``rejected``, for the lines that have exactly eight fields.

    A row with a bad number is rejected (true), a bad date is only null.
    """
    f = lines.select(parse.csv_fields(parse.java_trim(F.col(column))).alias("f")).where(F.size("f") == 8)
    at = lambda i: F.element_at("f", i)
    rows = f.select(
        at(1).try_cast("bigint").alias("id"), at(2).try_cast("bigint").alias("user_id"), parse.parse_date(at(3)).alias("date"), parse.tag_list(at(4)).alias("tags"),
        at(5).try_cast("bigint").alias("location_id"), at(6).alias("location_name"), at(7).try_cast("double").alias("latitude"), at(8).try_cast("double").alias("longitude"), "f",
    )
    bad = F.lit(False)
    for c in ("id", "user_id", "location_id", "latitude", "longitude"):
        bad = bad | F.col(c).isNull()
    return rows.select(*[c for c in rows.columns if c != "f"], bad.alias("rejected"), F.col("f").alias("fields"))


def read_media_csv(spark: SparkSession, path: str, strict: bool = False, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(media, rejects). Lines that do not parse are dropped; ``strict`` raises on a reject when it is read."""
    lines = spark.read.text(path)
    rows = parse_media_lines(lines.repartition(partitions) if partitions else lines)
    media = [c for c in rows.columns if c not in ("rejected", "fields")]
    if strict:
        checked = F.when(F.col("rejected"), F.raise_error(F.concat(F.lit("bad media row: "), F.array_join("fields", ",")))).otherwise(F.lit(None).cast("string"))
        rows = rows.withColumn("rejected", F.coalesce(checked.isNotNull(), F.lit(False)))
    return rows.where(~F.col("rejected")).select(*media), rows.where("rejected").select("fields")


def read_feed_pages(pages: DataFrame, json: str = "value", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(pages, media_raw) of feed answers: code and next_max_id; a row per item, null for an empty page."""
    parsed = pages.select(*keep, F.from_json(json, FEED_PAGE).alias("p"))
    heads = parsed.select(*keep, F.col("p.meta.code").alias("code"), F.col("p.pagination.next_max_id").alias("next_max_id"))
    items = parsed.select(*keep, F.col("p.meta.code").alias("code"), F.posexplode_outer("p.data").alias("pos", "m"))
    return heads, items.select(*keep, "code", "pos", "m.*")


def page_status(pages: DataFrame) -> DataFrame:
    """``pages`` with status: private (400), ok (200) or error."""
    return pages.withColumn("status", F.when(F.col("code") == 400, "private").when(F.col("code") == 200, "ok").otherwise("error"))


def has_location() -> Column:
    return F.col("location.latitude").isNotNull() & F.col("location.longitude").isNotNull()


def caption_text() -> Column:
    return F.col("caption.text")


def batch_requests(requests: DataFrame, json: str = "value") -> DataFrame:
    """tags, count (or null) and the opaque param of request texts."""
    return requests.select(F.from_json(json, REQUEST).alias("r")).select("r.*")


def read_cluster_csv(spark: SparkSession, path: str) -> DataFrame:
    """tags, lat, lon and cluster of labelled rows. A quoted empty field (no tags) is an empty text; nothing between two
    commas is null."""
    # with the default, an empty text, quotes around nothing would be null as well
    return spark.read.csv(path, schema=CLUSTER_CSV, nullValue="\x00").select("tags", "lat", "lon", "cluster")
