"""Structured Streaming jobs: pages into tables, requests into predictions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions import parse
from ..operators.bayes import Scorer
from ..operators.predict import score_requests
from ..schemas import FEED_PAGE, LOCATIONS, MEDIA_TABLE, USERS

PAGES, REQUESTS = "user_id bigint, page_no int, value string", "request_id bigint, text string, cnt int"


_STATE = "stopped boolean, private boolean, fully_scraped boolean"
#: What the users' stage emits: states (``what`` = user, next_max_id in ``value``, the number of the user's visits as page_no)
#: and pages that are kept (page).
_VISITS = f"user_id bigint, what string, page_no int, value string, {_STATE}"
#: What is looked up by key: media, locations and users, with the row as JSON; ``turn`` is above 0 for rows that are kept
#: though their key was seen, and differs from one to the next of a key.
_SEEN = "what string, key bigint, turn int, value string"
#: Groups of keys of a batch; each is a call of Python.
BUCKETS = 1024
_ROW = "date_us bigint, caption string, tags array<string>, type string, user_id bigint, location_id bigint, name string, latitude double, longitude double, next_max_id string, fully_scraped boolean, private boolean, stopped boolean"


class Visits(StatefulProcessor):
    """A user's pages of a batch, and whether the user is visited at all: the state store holds each user's last state.

    Pages count up to and including the first without geotagged media; an error page is no page. Holds the batch's
    pages of one user, without their texts until they are kept.
    """

    def __init__(self, resume: bool = False):
        self.resume = resume

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", f"{_STATE}, visits int")

    def handleInputRows(self, key, rows, timerValues):
        pages, visits = pd.concat(list(rows)), 0
        if self.state.exists():
            stopped, private, done, visits = self.state.get()
            if private or done or (stopped and not self.resume):
                return
        ok = pages[pages["code"] == 200].sort_values(["page_no", "value"], kind="stable")
        earlier = (ok["n_geo"] == 0).cumsum().shift(fill_value=0)
        ok, private = ok[earlier == 0], bool((pages["code"] == 400).any())
        if not len(ok) and not private:
            return
        last = ok.iloc[-1] if len(ok) else None
        next_id = None if last is None or pd.isna(last["next_max_id"]) else last["next_max_id"]
        stopped, done = last is not None and bool(last["n_geo"] == 0), last is not None and next_id is None
        self.state.update((stopped, private, done, visits + 1))
        found = ok[ok["n_geo"] > 0]
        out = [(key[0], "user", visits + 1, next_id, stopped, private, done)]
        out += [(key[0], "page", int(n), v, None, None, None) for n, v in zip(found["page_no"], found["value"], strict=True)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _VISITS.split(", ")]).astype({"page_no": "Int32", **dict.fromkeys(("stopped", "private", "fully_scraped"), "boolean")})

    def close(self) -> None:
        pass


def first_of_keys(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(what, key, turn, value): the first row of each key of a bucket in a batch; rows with ``always`` take precedence.

    Only the best rows so far are held, so a hot key of a batch takes time in one task, not memory. A row with ``always`` also
    marks its key as seen, by a row without value.
    """
    best, names = None, ["what", "key", "always", "o1", "o2", "o3", "value"]
    for b in batches:
        rows = pa.Table.from_batches([b]).select(names)
        rows = rows if best is None else pa.concat_tables([best, rows])
        rows = rows.sort_by([("key", "ascending"), ("always", "descending"), *[(c, "ascending") for c in ("o1", "o2", "o3", "value")]])
        k = rows["key"].to_numpy()
        best = rows.take(pa.array(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])[: len(k)])))
    if best is None or not best.num_rows:
        return
    always = best["always"].to_numpy()
    turn = np.where(always, best["o2"].to_numpy(), 0).astype(np.int32)
    for rows, turns, value in ((best, turn, best["value"]), (best.filter(pa.array(always)), turn[always] * 0, None)):
        if rows.num_rows:
            value = pa.nulls(rows.num_rows, pa.string()) if value is None else value.combine_chunks().cast(pa.string())
            yield pa.RecordBatch.from_arrays([rows["what"].combine_chunks(), rows["key"].combine_chunks(), pa.array(turns), value], names=["what", "key", "turn", "value"])


class FirstSeen(StatefulProcessor):
    """The first row of each key that no batch had before; rows with ``always`` take precedence, seen or not. A call a key:
    the stream takes ``first_of_keys`` and Spark's own state of keys instead, which give the same rows.

    Only the best row so far is held, so a hot key of a batch takes time in one task, not memory.
    """

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):
        best = None
        known = self.seen.exists()
        for frame in rows:
            # most keys have a row or two: lists cost less than a sort of the frame
            for always, *rest in zip(*(frame[c].tolist() for c in ("always", "o1", "o2", "o3", "value")), strict=True):
                if always or not known:
                    rank = (not always, *rest)
                    best = rank if best is None or rank < best else best
        if not known:
            self.seen.update((True,))
        if best is not None:
            yield pd.DataFrame({"what": [key[0]], "key": [key[1]], "value": [best[4]]})

    def close(self) -> None:
        pass


def _located(items):
    return F.filter(items, lambda m: m["location"]["latitude"].isNotNull() & m["location"]["longitude"].isNotNull())


def _visited(pages: DataFrame, resume: bool) -> DataFrame:
    """Users' states and kept pages of a stream of pages; a page without a user is left out."""
    p = F.from_json("value", FEED_PAGE)
    located = _located(F.col("p.data"))
    n_geo = F.when(F.col("p.data").isNull(), 0).otherwise(F.size(located))
    told = pages.where(F.col("user_id").isNotNull()).withColumn("p", p).select("user_id", "page_no", F.coalesce("p.meta.code", F.lit(0)).alias("code"), F.col("p.pagination.next_max_id").alias("next_max_id"), n_geo.alias("n_geo"), "value")
    return told.groupBy("user_id").transformWithStateInPandas(Visits(resume), _VISITS, "Append", "None")


def _keyed_rows(visited: DataFrame) -> DataFrame:
    """(what, key, always, o1, o2, o3, value): the rows that are looked up by key."""
    page = F.when(F.col("what") == "page", F.from_json("value", FEED_PAGE))
    items = visited.select("*", F.posexplode_outer(_located(page["data"])).alias("pos", "m"))
    user, place = F.coalesce(F.col("m.user.id").try_cast("bigint"), F.col("user_id")), F.col("m.location.id").try_cast("bigint")
    media_id = parse.media_key(F.col("m.id"))
    no = F.lit(False)
    row = lambda what, key, always, **fields: F.struct(F.lit(what).alias("what"), key.alias("key"), F.lit(always).alias("always"), F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("value"))
    state = row("users", F.col("user_id"), True, next_max_id=F.col("value"), fully_scraped=F.col("fully_scraped"), private=F.col("private"), stopped=F.col("stopped"))
    made = [
        row("media", media_id, False, date_us=F.unix_micros(parse.epoch_to_timestamp(F.col("m.created_time"))), caption=F.col("m.caption.text"), tags=F.col("m.tags"), type=F.col("m.type"), user_id=user, location_id=place),
        row("locations", place, False, name=F.col("m.location.name"), latitude=F.col("m.location.latitude"), longitude=F.col("m.location.longitude")),
        row("users", user, False, fully_scraped=no, private=no, stopped=no),
    ]
    usable = media_id.isNotNull() & place.isNotNull()
    rows = F.when(F.col("what") == "user", F.array(state)).when(usable, F.array(*made))
    return items.select(F.explode(rows).alias("r"), F.col("user_id").alias("o1"), F.coalesce("page_no", F.lit(0)).alias("o2"), F.coalesce("pos", F.lit(0)).alias("o3")).select("r.*", "o1", "o2", "o3")


def _write_batch(rows: DataFrame, batch: int, tables: str) -> None:
    """New media and locations and changed users into the batch's own folders; a batch that runs twice replaces them."""
    rows = rows.withColumn("r", F.from_json("value", _ROW)).select("what", F.col("key").alias("id"), "r.*").withColumn("date", F.timestamp_micros("date_us")).persist()
    try:
        for name, schema in (("media", MEDIA_TABLE), ("locations", LOCATIONS), ("users", USERS)):
            own = rows.where(F.col("what") == name).select(*[c.split()[0] for c in schema.split(", ")])
            own.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)).write.mode("overwrite").parquet(f"{tables}/{name}/batch={batch}")
    finally:
        rows.unpersist()


def read_users(spark: SparkSession, tables: str, before: int | None = None) -> DataFrame:
    """The users' last states (of batches before ``before``)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{tables}/users")
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], USERS)
    rows = spark.read.schema(f"{USERS}, batch int").parquet(f"{tables}/users")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    names = [c for c in rows.columns if c not in ("id", "batch")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*names), "batch").alias("u")).select("id", "u.*")


_STORE, _STORE_CLASS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _settings(spark: SparkSession, **values: str):
    """Settings while a query starts: it keeps what it finds then."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_ingest(spark: SparkSession, page_dir: str, tables: str, checkpoint: str, fmt: str = "parquet", files: int = 100, resume: bool = False, partitions: int | None = None) -> StreamingQuery:
    """Pages that arrive as files go into the tables; ends when what is there has been read.

    Users' states and the keys seen so far are in the state store of ``checkpoint``, by key, so a batch looks up its own
    keys and reads no table. ``partitions`` (the session's shuffle partitions when not given) are those of the
    state, fixed by the first run. The tables are the rows of all batch folders; the checkpoint belongs to them.
    """
    parts = str(partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).format(fmt).load(page_dir)
    rows = _keyed_rows(_visited(pages, resume)).withColumn("bucket", F.pmod(F.xxhash64("what", "key"), F.lit(BUCKETS)))
    # the first row of each key in the batch, then those whose key no batch had before
    first = rows.groupBy("what", "bucket").applyInArrow(first_of_keys, _SEEN)
    new = first.dropDuplicates(["what", "key", "turn"]).where(F.col("value").isNotNull())
    out = new.writeStream.foreachBatch(lambda df, batch: _write_batch(df, batch, tables)).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with _settings(spark, **{_STORE: _STORE_CLASS, "spark.sql.shuffle.partitions": parts}):
        return out.start()


def stream_score(spark: SparkSession, request_dir: str, out: str, checkpoint: str, scorer: Scorer, fmt: str = "parquet", files: int = 100) -> StreamingQuery:
    """Requests that arrive as files are ranked; a batch that runs twice overwrites its own folder."""

    def run(df: DataFrame, batch: int) -> None:
        score_requests(df, scorer).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    requests = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files).format(fmt).load(request_dir)
    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
