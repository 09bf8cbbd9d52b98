"""Tag statistics: counts, IDF weights, weighted sparse rows. Rows are (id, tags)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import idf

#: A tag with at least one in so many of the known occurrences is hot; so there are at most as many hot tags.
SHARE = 1000
#: Terms that are sent to every task (some 100 bytes each); more are joined by a shuffle.
MAX_TERMS = 2_000_000


def tag_counts(docs: DataFrame) -> DataFrame:
    """(tag, n): occurrences, those repeated within a row included."""
    return docs.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def idf_fit(docs: DataFrame, min_occurrences: int = 5, total: int | None = None, indexed: bool = False) -> DataFrame:
    """(tag, n, weight) of tags with more than ``min_occurrences``; with ``indexed`` also idx, by tag order.

    ``total`` is the number of rows; it is counted when not given.
    """
    total = docs.count() if total is None else total
    terms = tag_counts(docs).where(F.col("n") > min_occurrences).withColumn("weight", idf(total, F.col("n")))
    if indexed:
        from ..sources.models import numbered

        terms = numbered(terms.orderBy("tag"), "idx")
    return terms


def hot_tags(terms: DataFrame, share: int = SHARE) -> DataFrame:
    """Terms (tag, n, weight) that make at least one in ``share`` of all known occurrences: at most ``share`` rows."""
    terms = terms.where(F.col("tag").isNotNull())
    total = terms.agg(F.sum("n").alias("_total"))
    return terms.join(F.broadcast(total), F.col("n") * share >= F.col("_total")).select("tag", "weight")


def keep_vocabulary(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, tag, weight): a row per occurrence of a known tag. A null tag is unknown.

    With counts (``n``) in ``terms``, the hot tags are known beforehand: these few are broadcast and their occurrences stay
    where they are; only the others are shuffled by tag, so no task gets more than a ``SHARE``-th of them for one tag.
    """
    own = docs.select("id", F.explode("tags").alias("tag")).where(F.col("tag").isNotNull())
    if "n" not in terms.columns:
        return own.join(terms.select("tag", "weight"), "tag").select("id", "tag", "weight")
    hot = hot_tags(terms)
    told = own.join(F.broadcast(hot), "tag").select("id", "tag", "weight")
    cold = own.join(F.broadcast(hot.select("tag")), "tag", "left_anti")
    return told.unionByName(cold.join(terms.select("tag", "weight"), "tag").select("id", "tag", "weight"))


def idf_transform(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, tag, w): weights summed over occurrences. A row without known tags has no row here, but keeps its id in ``docs``.

    Up to ``MAX_TERMS`` terms are sent to the tasks, so occurrences stay where they are. They are summed, which shuffles
    them by id and tag, only if there is something to sum.
    """
    if terms.count() <= MAX_TERMS:
        own = docs.select("id", F.explode("tags").alias("tag")).join(F.broadcast(terms.select("tag", "weight")), "tag").select("id", "tag", "weight")
    else:
        own = keep_vocabulary(docs, terms)
    return own.groupBy("id", "tag").agg(F.sum("weight").alias("w")) if has_repeats(docs) else own.withColumnRenamed("weight", "w")


def has_repeats(docs: DataFrame) -> bool:
    """Whether a row has a tag twice or an id has two rows."""
    twice = F.coalesce(F.size(F.array_distinct("tags")) < F.size("tags"), F.lit(False))
    ids = docs.select("id", twice.alias("twice")).groupBy("id").agg((F.bool_or("twice") | (F.count("*") > 1)).alias("more"))
    return bool(ids.agg(F.bool_or("more")).first()[0])


def tag_vectors(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, weights): the same as a map per row; empty for rows without known tags."""
    rows = idf_transform(docs, terms).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "w")))).alias("weights"))
    return docs.select("id").join(rows, "id", "left").select("id", F.coalesce("weights", F.map_from_entries(F.array().cast("array<struct<tag:string,w:double>>"))).alias("weights"))
