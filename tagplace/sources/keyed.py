"""Tables by key: rows lie in buckets by the hash of their key, sorted, with a Bloom filter of the keys in each file.

A read by key looks only at the buckets of these keys, and in them, for a few keys, only at the row groups that may have
them. Buckets are dealt by ``rebalance``, so that a bucket with a hot key is written by several tasks. A change rewrites
the buckets of the changed keys alone; each bucket's folder is replaced as a whole at commit, but a job that fails
during its commit may leave some buckets changed and others not: run the same change again, which gives the same table.
One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import _fs, settled

#: Buckets of a table if not told otherwise; keys that are told to the scan itself, for its statistics and filters.
BUCKETS, FEW_KEYS = 256, 10
_COLUMN = "_bucket"


class Keyed:
    """The table under ``path`` with key column ``key``. A null key is in bucket 0 and equals no key."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> Keyed:
        """Write ``df``; there must be no table yet. An empty one has its schema all the same."""
        table = cls(df.sparkSession, path, key, buckets)
        if _COLUMN in df.columns:
            raise ValueError(f"column {_COLUMN} is the table's own")
        df.limit(0).withColumn(_COLUMN, F.lit(0)).write.parquet(f"{path}/schema")
        df.sparkSession.createDataFrame([(key, buckets)], "key string, buckets int").coalesce(1).write.parquet(f"{path}/about")
        table._write(df, "append")
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Keyed:
        about = spark.read.parquet(f"{path}/about").first()
        return cls(spark, path, about.key, about.buckets)

    def _bucket(self, key: str):
        return F.when(F.col(key).isNull(), 0).otherwise(F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame, mode: str) -> None:
        """Rows into their buckets; with mode overwrite the buckets that have rows are replaced, no others."""
        rows = df.withColumn(_COLUMN, self._bucket(self.key)).hint("rebalance", _COLUMN).sortWithinPartitions(_COLUMN, self.key)
        out = rows.write.mode(mode).partitionBy(_COLUMN).option("partitionOverwriteMode", "dynamic").option(f"parquet.bloom.filter.enabled#{self.key}", "true")
        out.option(f"parquet.bloom.filter.adaptive.enabled#{self.key}", "true").parquet(f"{self.path}/rows")

    def _table(self) -> DataFrame:
        root, fs = _fs(self.spark, f"{self.path}/rows")
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows") if fs.exists(root) else self.spark.createDataFrame([], schema)

    def _touched(self, keys: DataFrame) -> DataFrame:
        """Rows of the buckets of ``keys`` (one column like the key); of no others are files listed or read. At most
        ``buckets`` numbers come to the driver."""
        at = [r[0] for r in keys.select(self._bucket(self.key).alias("b")).distinct().collect()]
        rows = self._table().where(F.col(_COLUMN).isin(at))
        few = keys.distinct().limit(FEW_KEYS + 1).collect()
        return rows.where(F.col(self.key).isin([r[0] for r in few])) if len(few) <= FEW_KEYS else rows

    def _keys(self, keys: DataFrame) -> DataFrame:
        """The key column, in the type of the table's: equal values of another type have another hash."""
        dtype = self._table().schema[self.key].dataType
        return keys.select(F.col(self.key).cast(dtype).alias(self.key)).where(F.col(self.key).isNotNull())

    def rows(self, keys: DataFrame) -> DataFrame:
        """All rows whose key is in the key column of ``keys`` (repeated keys count once)."""
        keys = self._keys(keys)
        return self._touched(keys).drop(_COLUMN).join(keys, self.key, "left_semi")

    def all(self) -> DataFrame:
        return self._table().drop(_COLUMN)

    def lacking(self, new: DataFrame) -> DataFrame:
        """Rows of ``new`` whose key the table lacks; a null key is lacking."""
        there = self._touched(self._keys(new)).select(self.key)
        return new.join(there, self.key, "left_anti")

    def append(self, df: DataFrame) -> None:
        self._write(df.select(*self.all().columns), "append")

    def upsert(self, changed: DataFrame) -> None:
        """Rows of the changed keys are replaced by ``changed``; buckets without changed keys are not touched."""
        changed = settled(changed.select(*self.all().columns), "changed")
        at = [r[0] for r in changed.select(self._bucket(self.key)).distinct().collect()]
        old = self._table().where(F.col(_COLUMN).isin(at)).drop(_COLUMN)
        kept = old.join(changed.select(self.key), self.key, "left_anti")
        self._write(settled(kept.unionByName(changed), "upsert"), "overwrite")
