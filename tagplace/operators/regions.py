"""Nearest centres for more centres than a task should hold: both tables are dealt to regions.

A bounded sample of the centres is halved again and again along its widest side; the cuts make regions of about
``REGION`` centres each. Every point is first looked up in the region whose box of centres is nearest to it. Its distance
there is a certificate against all regions whose boxes are farther away; for the others (few, at the borders) the point
is looked up once more. So the result is exact, whatever the sample. Regions with many points are split by salts, and
only the boxes (six numbers a region) reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.models import settled

#: Centres of a region, centres that the cuts are made from, points that a task looks up at a time in one region.
REGION, SAMPLE, POINTS = 50_000, 100_000, 200_000
XYZ = ["x", "y", "z"]


def cuts_of(xyz: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(side, value) of the inner nodes of a binary tree with 2 ** depth leaves, breadth first."""
    side, value, parts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1), [xyz]
    for node in range(len(side)):
        own = parts[node]
        if len(own):
            side[node] = np.ptp(own, axis=0).argmax()
            value[node] = np.median(own[:, side[node]])
        right = own[:, side[node]] > value[node]
        parts += [own[~right], own[right]]
    return side, value


def region_of(xyz: np.ndarray, side: np.ndarray, value: np.ndarray) -> np.ndarray:
    node, rows = np.zeros(len(xyz), np.int64), np.arange(len(xyz))
    for _ in range((len(side) + 1).bit_length() - 1):
        node = 2 * node + 1 + (xyz[rows, side[node]] > value[node])
    return node - len(side)


def _coordinates(table) -> np.ndarray:
    return np.column_stack([np.asarray(table.column(c)) for c in XYZ]).astype(np.float64)


def _box_squares(xyz: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    d = np.zeros((len(xyz), len(low)))
    for k in range(3):
        x = xyz[:, k, None]
        d += np.maximum(np.maximum(low[None, :, k] - x, x - high[None, :, k]), 0) ** 2
    return d


def _cuts(rows: DataFrame, n: int, region: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of ``n`` rows (label, x, y, z) into regions of about ``region`` rows, from a bounded sample."""
    sample = rows.select("label", *XYZ).orderBy(F.xxhash64("label"), "label").limit(SAMPLE).select(*XYZ).toArrow()
    return cuts_of(_coordinates(sample), max(0, int(np.ceil(np.log2(n / region)))))


def with_region(rows: DataFrame, schema: str, n: int, region: int) -> DataFrame:
    """``n`` rows of ``schema`` (label, x, y, z, ...) with the number of their region, of about ``region`` rows each."""
    side, value = _cuts(rows, n, region)
    names = [c.split()[0] for c in schema.split(", ")]

    def dealt(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region_of(_coordinates(b), side, value).astype(np.int32))], names=[*b.schema.names, "_region"])

    typed = rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]).toDF(*names)
    return typed.mapInArrow(dealt, f"{schema}, _region int")


def nearest_by_regions(points: DataFrame, centers: DataFrame, region: int = REGION, per_task: int = POINTS) -> DataFrame:
    """``points`` with label and d2 of the nearest centre; of equally near ones the lowest label."""
    from .cluster import Near

    centers = centers.select("label", *XYZ)
    n = centers.count()
    if not n:
        raise ValueError("no centres")
    placed = settled(with_region(centers, "label int, x double, y double, z double", n, region), "regions")
    boxes = placed.groupBy("_region").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in XYZ]).toArrow().sort_by("_region")
    names = np.asarray(boxes["_region"])
    low, high = (np.column_stack([np.asarray(boxes[f"{f}_{c}"]) for c in XYZ]) for f in ("min", "max"))
    step = max(1, 4_000_000 // len(names))
    own = points.columns

    def first(batches):
        for b in batches:
            xyz = _coordinates(b)
            at = [names[_box_squares(xyz[a : a + step], low, high).argmin(1)] for a in range(0, len(xyz), step)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(at).astype(np.int32) if at else np.zeros(0, np.int32))], names=[*b.schema.names, "_region"])

    def ddl(df: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def looked_up(rows: DataFrame, others: bool) -> DataFrame:
        """``rows`` (.., _row, _region) with label and d2 of the nearest centre in the region, and with the further
        regions that may have a nearer one."""
        sizes = {r["_region"]: r["n"] for r in rows.groupBy("_region").agg(F.count("*").alias("n")).collect()}
        salts = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (int(k), -(-v // per_task))]) if sizes else F.create_map().cast("map<int,int>")
        count = F.coalesce(F.try_element_at(salts, F.col("_region")), F.lit(1))
        left = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), count).cast("int"))
        right = placed.withColumn("_salt", F.explode(F.sequence(F.lit(0), count - 1)))
        kept = rows.columns

        def run(key, mine, table):
            xyz = _coordinates(mine)
            if table.num_rows and len(xyz):
                near = Near(np.asarray(table.column("label")), _coordinates(table))
                found = [near.find(xyz[a : a + 20_000]) for a in range(0, len(xyz), 20_000)]
                label, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
            else:
                label, d2 = np.zeros(len(xyz), np.int64), np.full(len(xyz), np.inf)
            made = [mine.column(c) for c in kept] + [pa.array(label.astype(np.int32)), pa.array(d2)]
            if others:
                lists, it = [], key[0].as_py()
                for a in range(0, len(xyz), step):
                    # a little more, for rounding
                    near_boxes = _box_squares(xyz[a : a + step], low, high) <= d2[a : a + step, None] * (1 + 1e-9) + 1e-6
                    near_boxes[:, names == it] = False
                    lists += [names[row].tolist() for row in near_boxes]
                made.append(pa.array(lists, pa.list_(pa.int32())))
            return pa.Table.from_arrays(made, names=[*kept, "label", "d2", *["_others"] * others])

        return left.groupBy("_region", "_salt").cogroup(right.groupBy("_region", "_salt")).applyInArrow(run, ddl(rows) + ", label int, d2 double" + ", _others array<int>" * others)

    rows = settled(points.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(first, ddl(points) + ", _row long, _region int"), "points")
    once = settled(looked_up(rows, True), "once")
    again = settled(once.where(F.size("_others") > 0).select("_row", *XYZ, F.explode("_others").alias("_region")), "again")
    best = looked_up(again, False).groupBy("_row").agg(F.min(F.struct("d2", "label")).alias("more"))
    out = once.join(best, "_row", "left")
    nearer = F.least(F.struct("d2", "label"), F.coalesce("more", F.struct("d2", "label")))
    return out.withColumn("best", nearer).select(*own, F.col("best.label").alias("label"), F.col("best.d2").alias("d2"))
