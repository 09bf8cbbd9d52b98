"""Declared schemas as DDL; nothing is inferred."""

from __future__ import annotations

MEDIA = "id bigint, user_id bigint, date timestamp, tags array<string>, location_id bigint, location_name string, latitude double, longitude double"
USERS = "id bigint, next_max_id string, fully_scraped boolean, private boolean, stopped boolean"
LOCATIONS = "id bigint, name string, latitude double, longitude double"
MEDIA_TABLE = "id bigint, date timestamp, caption string, tags array<string>, type string, user_id bigint, location_id bigint"
FEED_ITEM = "struct<id:string,created_time:string,caption:struct<text:string>,tags:array<string>,type:string,user:struct<id:string>,location:struct<id:string,name:string,latitude:double,longitude:double>>"
FEED_PAGE = f"struct<meta:struct<code:int>,pagination:struct<next_max_id:string>,data:array<{FEED_ITEM}>>"
REQUEST = "struct<tags:array<string>,count:int,param:string>"
CLUSTER_CSV = "ignored string, tags string, lat double, lon double, cluster string"
