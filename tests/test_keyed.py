"""Tables by key against plain joins, and what their reads touch."""

import pytest
from pyspark.sql import functions as F

from tagplace.operators import ingest
from tagplace.sources.keyed import Keyed

ROWS = "id long, v string"


def made(spark, path, n=2000, buckets=16):
    hot = spark.range(1000).select(F.lit(7).cast("long").alias("id"), F.concat(F.lit("h"), F.col("id")).alias("v"))
    rows = spark.range(n).select("id", F.col("id").cast("string").alias("v")).unionByName(hot).unionByName(spark.createDataFrame([(None, "null"), (3, "3")], ROWS))
    return rows, Keyed.create(rows, str(path / "t"), "id", buckets)


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rows_by_key(spark, tmp_path):
    rows, table = made(spark, tmp_path)
    for keys in ([3, 7, 3, None, 99999], list(range(0, 2000, 11)), [], [None]):
        frame = spark.createDataFrame([(k,) for k in keys], "id long")
        assert plain(table.rows(frame)) == plain(rows.where(F.col("id").isin([k for k in keys if k is not None])))
        # keys of another type have the same buckets
        assert plain(table.rows(frame.select(F.col("id").cast("int").alias("id")))) == plain(table.rows(frame))
    assert plain(table.all()) == plain(rows) and plain(Keyed.open(spark, table.path).all()) == plain(rows)
    assert table.all().columns == ["id", "v"]


def test_reads_touch_the_buckets_of_the_keys(spark, tmp_path):
    _, table = made(spark, tmp_path)
    read = table.rows(spark.createDataFrame([(3,)], "id long"))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and "In(id" in plan.replace("EqualTo(id", "In(id")
    few = table._touched(spark.createDataFrame([(3,)], "id long"))
    assert {r[0].split("_bucket=")[1].split("/")[0] for r in few.select(F.input_file_name()).distinct().collect()} == {str(few.first()["_bucket"])}


def test_lacking_and_changes(spark, tmp_path):
    rows, table = made(spark, tmp_path)
    new = spark.createDataFrame([(3, "x"), (5000, "y"), (5000, "z"), (None, "n")], ROWS)
    assert plain(table.lacking(new)) == [(5000, "y"), (5000, "z"), (None, "n")]
    table.append(spark.createDataFrame([("late", 6000)], "v string, id long"))
    table.upsert(spark.createDataFrame([(7, "one"), (6001, "new")], ROWS))
    want = plain(rows.where("id is null or id <> 7").unionByName(spark.createDataFrame([(6000, "late"), (7, "one"), (6001, "new")], ROWS)))
    assert plain(table.all()) == want
    table.upsert(spark.createDataFrame([(7, "one"), (6001, "new")], ROWS))  # once more: the same table
    assert plain(table.all()) == want


def test_empty_table_and_names(spark, tmp_path):
    empty = Keyed.create(spark.createDataFrame([], ROWS), str(tmp_path / "e"), "id")
    keys = spark.createDataFrame([(1,)], "id long")
    assert empty.rows(keys).count() == 0 and empty.lacking(keys).count() == 1 and empty.all().columns == ["id", "v"]
    empty.append(spark.createDataFrame([(1, "a")], ROWS))
    assert plain(empty.rows(keys)) == [(1, "a")]
    with pytest.raises(ValueError, match="_bucket"):
        Keyed.create(spark.createDataFrame([(1, 2)], "id long, _bucket int"), str(tmp_path / "c"), "id")


def test_frontier_reads_by_key(spark, tmp_path):
    follows = spark.range(500).select((F.col("id") % 50).alias("user_id"), (F.col("id") * 7 % 60).alias("follower_id")).distinct()
    seeds = spark.createDataFrame([(1,), (2,)], "user_id long")
    table = Keyed.create(follows, str(tmp_path / "f"), "user_id", 8)
    assert plain(ingest.expand_frontier(seeds, table)) == plain(ingest.expand_frontier(seeds, follows))
