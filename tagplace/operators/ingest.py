"""The crawl as batch work: pages into tables, and level-by-level growth of the user frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parse
from ..sources.media import caption_text, has_location, page_status, read_feed_pages
from ..sources.keyed import Keyed
from ..sources.models import settled

MAX_BRANCHING, QUEUE_SIZE = 5, 5000


def media_samples(media: DataFrame, locations: DataFrame) -> DataFrame:
    """The eight sample columns of media that have a location."""
    own = locations.select(F.col("id").alias("location_id"), F.col("name").alias("location_name"), "latitude", "longitude")
    return media.join(own, "location_id").select("id", "user_id", "date", "tags", "location_id", "location_name", "latitude", "longitude")


def first_seen(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key by ``order``; a window per key, no group is gathered."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")


def insert_if_absent(new: DataFrame, existing: DataFrame | None, key: str, order: list) -> DataFrame:
    """Rows of ``new`` to append: the first of each key that ``existing`` lacks. A null key is no key."""
    rows = new.where(F.col(key).isNotNull())
    return first_seen(rows if existing is None else rows.join(existing.select(key), key, "left_anti"), key, order)


def pages_until_empty(pages: DataFrame, geotagged: str = "n_geo") -> DataFrame:
    """Pages (user_id, page_no, ...) up to and including each user's first without geotagged media."""
    empties = F.sum((F.col(geotagged) == 0).cast("int")).over(W.partitionBy("user_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, -1))
    return pages.withColumn("_e", F.coalesce(empties, F.lit(0))).where("_e = 0").drop("_e")


def user_scrape_state(pages: DataFrame) -> DataFrame:
    """(user_id, next_max_id, fully_scraped, private, stopped) of kept pages (user_id, page_no, code, next_max_id, n_geo).

    ``stopped``: the last page had no geotagged media, so the visit ended there.
    """
    ok = F.col("code") == 200
    last = F.max_by(F.struct("next_max_id", (F.col("n_geo") == 0).alias("empty")), F.when(ok, F.col("page_no")))
    got = pages.groupBy("user_id").agg(last.alias("last"), F.bool_or(ok).alias("any"), F.bool_or(F.col("code") == 400).alias("private"))
    done, no = F.col("last.next_max_id").isNull(), lambda c: F.coalesce(c, F.lit(False))
    return got.select("user_id", F.col("last.next_max_id").alias("next_max_id"), (F.col("any") & done).alias("fully_scraped"), no(F.col("private")).alias("private"), no(F.col("last.empty")).alias("stopped"))


def inactive_users(users: DataFrame, resume: bool = False) -> DataFrame:
    """(user_id) of users that are not visited: private or fully scraped ones and, unless a new visit resumes where
    the last one ended, those at an empty page."""
    off = F.coalesce("private", F.lit(False)) | F.coalesce("fully_scraped", F.lit(False))
    if not resume and "stopped" in users.columns:
        off = off | F.coalesce("stopped", F.lit(False))
    return users.where(off).select(F.col("id").alias("user_id"))


def active_users(users: DataFrame, resume: bool = True) -> DataFrame:
    return users.join(inactive_users(users, resume).select(F.col("user_id").alias("id")), "id", "left_anti")


def ingest_pages(pages: DataFrame, users: DataFrame | None = None, locations: DataFrame | None = None, media: DataFrame | None = None, resume: bool = False) -> dict[str, DataFrame]:
    """One crawl step over pages (user_id, page_no, value as JSON).

    Pages of users that are private, fully scraped or at an empty page by then are left out (``resume`` takes up
    the last). Returns what to append to media and locations, the users to write (state of each user of the pages, and
    users who posted kept media), and rejects: pages with an error, items without a usable id.
    """
    if users is not None:
        pages = pages.join(inactive_users(users, resume), "user_id", "left_anti")
    heads, items = read_feed_pages(pages, keep=("user_id", "page_no"))
    state = page_status(heads)
    located = items.where(has_location())
    geo = located.groupBy("user_id", "page_no").agg(F.count("*").alias("n_geo"))
    counted = state.where("status = 'ok'").join(geo, ["user_id", "page_no"], "left").withColumn("n_geo", F.coalesce("n_geo", F.lit(0)))
    kept = pages_until_empty(counted)
    found = located.join(kept.select("user_id", "page_no"), ["user_id", "page_no"], "left_semi")
    rows = found.select(
        parse.media_key(F.col("id")).alias("id"), parse.epoch_to_timestamp(F.col("created_time")).alias("date"), caption_text().alias("caption"), "tags", "type",
        F.coalesce(F.col("user.id").try_cast("bigint"), F.col("user_id")).alias("user_id"), F.col("location.id").try_cast("bigint").alias("location_id"),
        F.col("location.name").alias("name"), F.col("location.latitude").alias("latitude"), F.col("location.longitude").alias("longitude"), "page_no", "pos", F.col("user_id").alias("_page_user"),
    )
    good = F.col("id").isNotNull() & F.col("location_id").isNotNull()
    order = [F.col("_page_user"), F.col("page_no"), F.col("pos")]
    new_media = insert_if_absent(rows.where(good), media, "id", order).select("id", "date", "caption", "tags", "type", "user_id", "location_id")
    places = rows.where(good).select(F.col("location_id").alias("id"), "name", "latitude", "longitude", "_page_user", "page_no", "pos")
    new_locations = insert_if_absent(places, locations, "id", order).select("id", "name", "latitude", "longitude")
    seen = ["user_id", "page_no", "code", "next_max_id", "n_geo"]
    scraped = user_scrape_state(kept.select(*seen).unionByName(state.where("status = 'private'").withColumn("n_geo", F.lit(None).cast("long")).select(*seen)))
    scraped = scraped.select(F.col("user_id").alias("id"), "next_max_id", "fully_scraped", "private", "stopped")
    posters = rows.where(good).select(F.col("user_id").alias("id")).distinct().join(scraped, "id", "left_anti")
    if users is not None:
        posters = posters.join(users, "id", "left_anti")
    added = scraped.unionByName(posters.select("id", F.lit(None).cast("string").alias("next_max_id"), *[F.lit(False).alias(c) for c in ("fully_scraped", "private", "stopped")]))
    errors = state.where("status = 'error'").select("user_id", "page_no", F.lit("page").alias("what"))
    bad = rows.where(~good).select(F.col("_page_user").alias("user_id"), "page_no", F.lit("item").alias("what"))
    return {"media": new_media, "locations": new_locations, "users": added, "rejects": errors.unionByName(bad)}


def upsert_users(users: DataFrame, changed: DataFrame) -> DataFrame:
    return users.join(changed, "id", "left_anti").unionByName(changed.select(*users.columns))


def hash_order(seed: int, *keys: str):
    """A repeatable random order: md5 of the seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def expand_followers(frontier: DataFrame, follows: DataFrame | Keyed) -> DataFrame:
    """(user_id, follower_id) of the frontier's users; of a table by user only their buckets are read."""
    if isinstance(follows, Keyed):
        return follows.rows(frontier)
    return follows.join(frontier.select("user_id"), "user_id", "left_semi")


def sample_successors(follows: DataFrame, n: int = MAX_BRANCHING, seed: int = 42) -> DataFrame:
    """At most ``n`` followers of each user, in a repeatable random order."""
    by = W.partitionBy("user_id").orderBy(hash_order(seed, "user_id", "follower_id"), "follower_id")
    return follows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).drop("_n")


def random_users(users: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return users.orderBy(hash_order(seed, "id"), "id").limit(n)


def cap_frontier(frontier: DataFrame, room: int, seed: int = 42) -> DataFrame:
    return frontier.orderBy(hash_order(seed, "user_id"), "user_id").limit(max(0, room))


def merge_frontier(queue: DataFrame, new: DataFrame) -> DataFrame:
    return queue.unionByName(new).dropDuplicates(["user_id"])


def seed_users(media_raw: DataFrame) -> DataFrame:
    """(user_id) of media with a readable user."""
    return media_raw.select(F.col("user.id").try_cast("bigint").alias("user_id")).where(F.col("user_id").isNotNull()).distinct()


def seed_from_users(users: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return random_users(users, n, seed).select(F.col("id").alias("user_id"))


def expand_frontier(seeds: DataFrame, follows: DataFrame | Keyed, users: DataFrame | None = None, rounds: int = 2, max_branching: int = MAX_BRANCHING, queue_size: int = QUEUE_SIZE, seed: int = 42, revisit: bool = False) -> DataFrame:
    """(user_id, level): users reached from the seeds, level by level.

    Each level visits the queue's users (without private or fully scraped ones), takes a few followers of each,
    and queues those not seen before (all, with ``revisit``) as far as the queue has room. Only the visited users'
    followers are ranked for sampling; each level is written, so the plan stays short. With ``follows`` as a table by
    user_id a level reads the buckets of its users, not all follows.
    """
    stopped = None if users is None else inactive_users(users, resume=True)
    level = settled(cap_frontier(seeds.select("user_id").distinct(), queue_size, seed), "level")
    out = level.withColumn("level", F.lit(0))
    for turn in range(1, rounds + 1):
        visited = level if stopped is None else level.join(stopped, "user_id", "left_anti")
        near = sample_successors(expand_followers(visited, follows), max_branching, seed).select(F.col("follower_id").alias("user_id")).distinct()
        if not revisit:
            near = near.join(out.select("user_id"), "user_id", "left_anti")
        level = settled(cap_frontier(near, queue_size, seed), "level")
        out = out.unionByName(level.withColumn("level", F.lit(turn)))
    return out
