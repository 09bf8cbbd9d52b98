"""Tables and model files: written, read back, or fitted when absent."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def write_tables(tables: Tables, path: str, mode: str = "overwrite") -> None:
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: tuple[str, ...] = ("users", "locations", "media")) -> Tables:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written completely."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


#: The tables of a location model, by stage.
STAGES = {"kmeans": ("centers", "cells"), "idf": ("terms",), "nb": ("classes", "theta")}
_MANIFEST = "_manifest-"


def _fs(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Version:
    """One published state of the model under ``path``: where each of its tables is. A reader that holds one keeps
    seeing it, whatever is saved meanwhile."""

    def __init__(self, spark: SparkSession, path: str, number: int = 0, tables: dict[str, str] | None = None):
        self.spark, self.path, self.number, self.tables = spark, path, number, tables or {}

    @classmethod
    def numbers(cls, spark: SparkSession, path: str) -> list[int]:
        root, fs = _fs(spark, path)
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[len(_MANIFEST) :]) for n in names if n.startswith(_MANIFEST))

    @classmethod
    def latest(cls, spark: SparkSession, path: str) -> Version:
        """The last published version; one without tables if there is none."""
        found = cls.numbers(spark, path)
        return cls.of(spark, path, found[-1]) if found else cls(spark, path)

    @classmethod
    def of(cls, spark: SparkSession, path: str, number: int) -> Version:
        at, fs = _fs(spark, f"{path}/{_MANIFEST}{number:012d}")
        stream = fs.open(at)
        try:
            return cls(spark, path, number, json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def read(self, names: Iterable[str] | None = None) -> Tables:
        return {n: self.spark.read.parquet(f"{self.path}/{self.tables[n]}") for n in (self.tables if names is None else names)}

    def publish(self) -> Version:
        """Make this the next version: its manifest is written aside and renamed, which fails if another writer was
        first; then a later number is tried, so the last one to publish wins as a whole."""
        jvm = self.spark.sparkContext._jvm
        aside, fs = _fs(self.spark, f"{self.path}/_aside-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(self.tables).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        while True:
            number = (self.numbers(self.spark, self.path) or [0])[-1] + 1
            to = _fs(self.spark, f"{self.path}/{_MANIFEST}{number:012d}")[0]
            try:
                context.rename(fs.makeQualified(aside), fs.makeQualified(to), none)
                break
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
        self.number = number
        return self


class Draft:
    """Tables of a version in the making, in a folder of their own; readers see none of those that replace published
    ones before ``publish``. Tables that replace nothing are published at once, so that a failed run can be resumed."""

    def __init__(self, spark: SparkSession, path: str, load_existing: bool = True):
        self.base = Version.latest(spark, path)
        self.folder, self.kept, self.load_existing = f"v-{uuid.uuid4().hex}", {}, load_existing
        self.spark, self.path = spark, path

    def write(self, tables: Tables) -> None:
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{self.folder}/{name}")
        self.kept |= {name: f"{self.folder}/{name}" for name in tables}

    def fit_or_load(self, names: tuple[str, ...], fit: Callable[[], Tables]) -> Tables:
        """A stage's tables: those of the published version when all are there, else fitted and written."""
        if self.load_existing and all(n in self.base.tables for n in names):
            self.kept |= {n: self.base.tables[n] for n in names}
        else:
            self.write(fit())
            if not set(names) & set(self.base.tables):
                self.base = Version(self.spark, self.path, 0, self.base.tables | {n: self.kept[n] for n in names}).publish()
        return Version(self.spark, self.path, 0, self.kept).read(names)

    def publish(self) -> Version:
        """Publish the tables that were written or loaded, and no others."""
        if self.kept == self.base.tables:
            return self.base
        return Version(self.spark, self.path, 0, dict(self.kept)).publish()


def save_model(tables: Tables, path: str) -> Version:
    """Publish ``tables`` as the model under ``path``; until all are written the version before stays, and after a
    failure as well. Files of earlier versions stay until ``prune_model``."""
    draft = Draft(next(iter(tables.values())).sparkSession, path)
    draft.write(tables)
    return draft.publish()


def load_model(spark: SparkSession, path: str) -> Tables:
    """The tables of the last published version."""
    return Version.latest(spark, path).read()


def fit_or_load(spark: SparkSession, path: str, names: tuple[str, ...], fit: Callable[[], Tables], load_existing: bool = True) -> Tables:
    """A stage's tables from the model under ``path`` when all are there, else fitted and published with the others."""
    draft = Draft(spark, path, load_existing)
    out = draft.fit_or_load(names, fit)
    draft.kept = draft.base.tables | draft.kept
    draft.publish()
    return out


def prune_model(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` versions, and table folders that these don't name. No save may be under way."""
    numbers = Version.numbers(spark, path)
    used = {t.split("/")[0] for n in numbers[-keep:] for t in Version.of(spark, path, n).tables.values()}
    root, fs = _fs(spark, path)
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(_MANIFEST) and int(name[len(_MANIFEST) :]) not in numbers[-keep:] or name.startswith(("v-", "_aside-")) and name not in used:
            fs.delete(status.getPath(), True)


def numbered(df: DataFrame, name: str = "i") -> DataFrame:
    """``df`` with the row's place in its order: rows are written with their place in a partition, and the number of
    rows before each partition is added; no single-partition window over rows."""
    rows = settled(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(name, 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, name)


def numbered_lines(spark: SparkSession, path: str, name: str = "i") -> DataFrame:
    """(name, value): lines of the text files under ``path`` with their number, in order of the files.

    Spark reads files in blocks and packs these by size, so the order of its rows is not that of the lines. A line's
    number is the number of lines in earlier files, in earlier blocks of its file, and before it in its block. Files
    follow each other by the number in their name (``part-<number>``), then by name.
    """
    m = F.col("_metadata")
    rows = spark.read.text(path).select("value", m["file_path"].alias("_file"), m["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_row"))
    rows = settled(rows, "lines")
    # a block is read by one task, row after row
    blocks = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    # one row a block, then one a file
    inside = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    part = F.regexp_extract("_file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    files = blocks.groupBy("_file").agg(F.sum("_n").alias("_m")).select("_file", F.coalesce(F.sum("_m").over(W.orderBy(part, "_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_files"))
    starts = blocks.select("_file", "_block", (F.coalesce(F.sum("_n").over(inside), F.lit(0)) - F.col("_first")).alias("_before")).join(files, "_file")
    return rows.join(starts, ["_file", "_block"]).select((F.col("_files") + F.col("_before") + F.col("_row")).alias(name), "value")


def read_class_model(spark: SparkSession, path: str) -> DataFrame:
    """class_no, class, prior, lat, lon, tags of ``class,prior,lat,lon,tag,...,`` lines in one or many files."""
    return class_lines(numbered_lines(spark, path, "class_no"))


def class_lines(lines: DataFrame) -> DataFrame:
    """The same from (class_no, value); the last element of a line is not a tag."""
    d = lines.select("class_no", F.split("value", ",").alias("d"))
    at = lambda i: F.try_element_at("d", F.lit(i))
    return d.select("class_no", at(1).alias("class"), at(2).try_cast("double").alias("prior"), at(3).try_cast("double").alias("lat"), at(4).try_cast("double").alias("lon"), F.slice("d", F.lit(5), F.greatest(F.size("d") - 5, F.lit(0))).alias("tags"))


def class_model_text(model: DataFrame) -> DataFrame:
    """``value`` lines in order of class_no, with the trailing comma."""
    cells = F.concat(F.array(*[F.col(c).cast("string") for c in ("class", "prior", "lat", "lon")]), "tags", F.array(F.lit("")))
    return model.select("class_no", F.array_join(cells, ",", "").alias("value"))


def write_class_model(model: DataFrame, path: str, files: int | None = None) -> None:
    """Lines in order of class_no, in about ``files`` files (as many as Spark likes when not given)."""
    lines = class_model_text(model)
    lines = lines.orderBy("class_no") if files is None else lines.repartitionByRange(files, "class_no").sortWithinPartitions("class_no")
    lines.select("value").write.text(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, deleted when the driver's JVM ends. A local master without
    spark.checkpoint.dir gets a temporary folder, which is noted there."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tagplace-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/tagplace-{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, short lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def deleted(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete the files of ``settled`` tables, or of paths, that nothing reads any more."""
    for table in tables:
        there, fs = _fs(spark, table if isinstance(table, str) else table._written_to)
        fs.delete(there, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as run at once: a small file would be one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
