"""Line deduplication by distinct-site spread: lines that many sites share are boilerplate and are removed.

A line is what stands between newlines, without white space at its ends; blank lines are never counted or
removed. A line is known by 128 bits of hash. Lines of a single site are told by the least and greatest site hash
(exact, and most lines are such); for the others HyperLogLog sketches of their sites are made where the lines are
read and merge by aggregation. A sketch's estimate far from the threshold decides; only lines near it get exact
distinct counts. Lines of at least
``sites`` sites go from all documents.

Only hashes are shuffled for the counting, never text; frequent lines are merged before the shuffle, and the
lines of boilerplate are found by a join whose small side is salted, so a very frequent line is no hot key.

Edge cases: a null text stays null and has no lines; a null source is a site of its own. Repeated rows count as
one site. Very long texts are split like any others. An empty table gives an empty result. Other columns pass through; those named like a new column
(clean_text, n_lines, n_removed) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_arrow, written

SALTS = 16
#: A sketch has 2^LG registers; its relative error is about 1.04 / sqrt(2^LG), NEAR is over four of them.
LG, NEAR = 10, 0.15
_LINES = "transform(split(text, '\n'), x -> trim(BOTH ' \t\r\x0b\x0c' FROM x))"


def _keys(line):
    return F.xxhash64(F.lit(1), line).alias("a"), F.xxhash64(F.lit(2), line).alias("b")


def spread_lines(lines: DataFrame, sites: int) -> DataFrame:
    """(a, b) of the lines that occur on at least ``sites`` sites; ``lines`` has a, b, site (a hash)."""
    spread = lines.groupBy("a", "b").agg(F.min("site").alias("lo"), F.max("site").alias("hi"))
    if sites < 2:
        return spread.select("a", "b")
    shared = written(spread.where("lo <> hi").select("a", "b"), "shared")
    salted = lambda some: lines.join(some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["a", "b", "salt"])
    # tasks send a sketch a line, merged on the way; no line's sites are listed
    sketched = written(salted(shared).groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG)).alias("about")), "sketched")
    sure = sketched.where(F.col("about") >= sites * (1 + NEAR)).select("a", "b")
    near = sketched.where((F.col("about") < sites * (1 + NEAR)) & (F.col("about") >= sites * (1 - NEAR))).select("a", "b")
    exact = salted(near).groupBy("a", "b", "site").agg(F.count("*").alias("n")).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= sites)
    return sure.unionByName(exact.select("a", "b"))


def drop_boilerplate(docs: DataFrame, sites: int = 10, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with clean_text (its other lines, joined by newlines), n_lines (not blank) and n_removed."""
    import numpy as np
    import pyarrow as pa

    def number(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            yield b, {"_row": pa.array(np.arange(row, row + b.num_rows), pa.int64())}
            row += b.num_rows

    kept = [c for c in docs.columns if c.lower() not in ("clean_text", "n_lines", "n_removed")]
    rows = written(with_arrow(docs.select(*[F.col(f"`{c}`") for c in kept]), number, "_row long"), "rows")
    site = F.xxhash64(F.coalesce(F.concat(F.lit("+"), F.col(f"`{site_col}`").cast("string")), F.lit("")))
    lines = rows.select("_row", F.col(f"`{text_col}`").alias("text"), site.alias("site")).select("_row", "site", F.posexplode(F.expr(_LINES)).alias("at", "line")).where("line <> ''")
    hashed = lines.select("_row", "at", "site", *_keys(F.col("line")), F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int").alias("salt"))
    bad = written(spread_lines(hashed.drop("at", "_row"), sites), "boilerplate")
    salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = hashed.join(salted, ["a", "b", "salt"], "left_semi").groupBy("_row").agg(F.collect_set("at").alias("_gone"))
    out = rows.join(hits, "_row", "left")
    text = F.col(f"`{text_col}`")
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    clean = F.when(F.size(gone) == 0, text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n"))
    n = F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r\x0b\x0c")) != "")), F.lit(0))
    return out.select(*[F.col(f"`{c}`") for c in kept], F.when(text.isNotNull(), clean).alias("clean_text"), F.when(text.isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"))
