"""Media, requests, pages and follows derived from the given tables; the same SQL serves both engines.

``{name}`` stands for a table, ``[tags:...]`` for an expression that the engines spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_WORDS = {
    "spark": r"array_sort(array_distinct(filter(split(regexp_replace(lower(text), '[^a-z]+', ' '), ' '), x -> x <> '')))",
    "duckdb": r"list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '')))",
}
_S = "concat_ws(' ', p_name, lower(p_type), lower(replace(p_brand, '#', '')))"
_SPLIT = {"spark": f"split({_S}, ' ')", "duckdb": f"string_split({_S}, ' ')"}

#: Tags go with places: a document's distinct words, at a point that depends on its language and source.
MEDIA_DOCS = """
select doc_id as id, doc_id % 50 as user_id, cast(null as timestamp) as date, [words] as tags,
 (case lang when 'en' then 0 when 'fr' then 1 when 'de' then 2 else 3 end) * 100 + cast(substr(source, 4) as int) as location_id,
 concat(lang, '-', source) as location_name,
 cast(case lang when 'en' then 40.0 when 'fr' then 47.0 when 'de' then 51.0 else -34.0 end as double)
   + cast(substr(source, 4) as int) * cast(0.25 as double) + (doc_id % 17) * cast(0.01 as double) as latitude,
 cast(case lang when 'en' then -100.0 when 'fr' then 2.0 when 'de' then 11.0 else -64.0 end as double)
   + cast(substr(source, 4) as int) * cast(0.5 as double) + (doc_id % 23) * cast(0.01 as double) as longitude
from {documents}
"""

MEDIA_SALES_RAW = """
select l_orderkey * 10 + l_linenumber as id, o_custkey as user_id, o_orderdate as date, [split] as tags,
 c_nationkey as location_id, n_name as location_name,
 cast(-60.0 as double) + c_nationkey * cast(5.0 as double) + (l_partkey % 1000) * cast(0.004 as double) as latitude,
 cast(-170.0 as double) + c_nationkey * cast(13.0 as double) + (l_suppkey % 100) * cast(0.04 as double) as longitude,
 l_partkey, l_suppkey, l_extendedprice, l_shipdate
from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey
 join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
"""

#: The crawl's media and places as tables.
SALES_MEDIA = "select l_orderkey * 10 + l_linenumber as id, o_orderdate as date, [split] as tags, o_custkey as user_id, c_nationkey as location_id, l_partkey, l_suppkey, l_extendedprice, l_shipdate from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey join {customer} on o_custkey = c_custkey"
PLACES = "select n_nationkey as id, n_name as name, cast(-60.0 as double) + n_nationkey * cast(5.0 as double) as latitude, cast(-170.0 as double) + n_nationkey * cast(13.0 as double) as longitude from {nation}"

PAGES = """
select user_id, page_no, count(*) as n_media,
       cast(sum(case when event_type in ('view', 'purchase') then 1 else 0 end) as bigint) as n_geo
from (select user_id, event_id, event_type,
             cast(floor((row_number() over (partition by user_id order by ts desc, event_id desc) - 1) / 3.0) as int) as page_no
      from {events}) t
group by user_id, page_no
"""
FOLLOWS = "select distinct user_id, event_id % n as follower_id from {events} cross join (select count(distinct user_id) as n from {events}) u where event_id % n <> user_id"
REQUESTS = """
select conv_id * 100 + turn as request_id, text, case when turn % 3 = 0 then null else turn % 3 + 1 end as cnt
from {conversations} where role = 'user'
"""

_SPELLED = {"words": _WORDS, "split": _SPLIT}


def spelled(sql: str, engine: str) -> str:
    return re.sub(r"\[(\w+)\]", lambda m: _SPELLED[m[1]][engine], sql)


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture as a DataFrame; its tables are read from ``sf_dir``."""
    from ..sources.models import spread

    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    if sql == MEDIA_DOCS:  # much work a row
        tables["documents"] = spread(tables["documents"].select("doc_id", "text", "lang", "source"))
    return spark.sql(spelled(sql, "spark"), **tables)


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", spelled(sql, "duckdb"))


def media_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, MEDIA_DOCS)


def media_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row per id of the sales rows."""
    from ..operators.ingest import first_seen

    return first_seen(frame(spark, sf_dir, MEDIA_SALES_RAW), "id", ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]).drop("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
