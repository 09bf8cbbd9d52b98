"""World cells by k-means on earth-centred points (id, x, y, z); centres are (label, x, y, z).

Centres are few (rows / 1000) and live on the driver between rounds; points never do. All choices at random come
from hashes of (seed, round, id), so they don't depend on partitions. Points of one place are one weighted row: many media
share a place, and all of them have the same nearest centre. Up to ``MAX_LOCAL`` candidates of the start are
reduced on the driver; of more, each region's centres are picked in a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import ecef_to_lla, lla_to_ecef
from ..sources.models import numbered, settled, spread
from .regions import nearest_by_regions, with_region

#: Centres that are sent to every task (24 bytes each); candidates that the driver reduces by itself.
MAX_CENTERS, MAX_LOCAL = 5_000_000, 20_000


def points_of(media: DataFrame) -> DataFrame:
    x, y, z = lla_to_ecef(F.col("latitude"), F.col("longitude"))
    return media.select("id", x.alias("x"), y.alias("y"), z.alias("z"))


def num_classes(n: int, per_class: int) -> int:
    if n // per_class < 1:
        raise ValueError(f"{n} rows are too few for classes of {per_class}")
    return n // per_class


def centers_array(centers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(labels, k x 3 coordinates) in order of label; their number is checked."""
    got = centers.select("label", "x", "y", "z").limit(MAX_CENTERS + 1).toPandas().sort_values("label")
    if len(got) > MAX_CENTERS:
        raise ValueError(f"more than {MAX_CENTERS} centres")
    return got["label"].to_numpy(np.int32), got[["x", "y", "z"]].to_numpy(np.float64)


def centers_frame(spark: SparkSession, xyz: np.ndarray) -> DataFrame:
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(xyz)]
    return spark.createDataFrame(rows, "label int, x double, y double, z double")


class Near:
    """Nearest centres by blocks: centres that are close together share a block with a middle and a radius, and a
    block is looked at only for points that may have their nearest centre in it. Exact: differences are taken before
    squaring, since squares of earth-centred metres would lose the small ones."""

    def __init__(self, labels: np.ndarray, xyz: np.ndarray):
        size = max(32, math.isqrt(len(xyz)))
        todo, self.blocks = [np.argsort(labels, kind="stable")], []
        while todo:  # halve along the widest side
            own = todo.pop()
            if len(own) <= size:
                self.blocks.append(np.sort(own))
                continue
            x = xyz[own]
            own = own[np.argsort(x[:, np.ptp(x, axis=0).argmax()], kind="stable")]
            todo += [own[: len(own) // 2], own[len(own) // 2 :]]
        self.labels, self.xyz = labels.astype(np.int64), xyz
        self.middle = np.array([xyz[b].mean(0) for b in self.blocks])
        self.radius = np.array([np.sqrt(((xyz[b] - m) ** 2).sum(1).max()) for b, m in zip(self.blocks, self.middle, strict=True)])

    @staticmethod
    def _squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = np.zeros((len(p), len(q)))
        for k in range(3):
            d += (p[:, k, None] - q[None, :, k]) ** 2
        return d

    def find(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(label, squared distance) of each point's nearest centre, the lowest label of equally near ones."""
        best, far = np.full(len(p), np.iinfo(np.int64).max), np.full(len(p), np.inf)
        away = np.sqrt(self._squares(p, self.middle))
        least = (away - self.radius) * (1 - 1e-9) - 1e-6  # no centre of the block is nearer; a little less for rounding
        first = away.argmin(1)

        def look(block, rows):
            own = self.blocks[block]
            d = self._squares(p[rows], self.xyz[own])
            d2 = d.min(1)
            label = np.where(d == d2[:, None], self.labels[own], np.iinfo(np.int64).max).min(1)
            nearer = (d2 < far[rows]) | (d2 == far[rows]) & (label < best[rows])
            best[rows[nearer]], far[rows[nearer]] = label[nearer], d2[nearer]

        for block in np.unique(first):
            look(block, np.flatnonzero(first == block))
        for block in range(len(self.blocks)):
            rows = np.flatnonzero((first != block) & (np.maximum(least[:, block], 0) ** 2 <= far))
            if len(rows):
                look(block, rows)
        return best, far


def nearest(points: DataFrame, labels: np.ndarray, xyz: np.ndarray) -> DataFrame:
    """``points`` with label and d2 of the nearest centre; of equally near ones the lowest label."""
    if not len(labels):
        raise ValueError("no centres")
    schema = T.StructType([*points.schema.fields, T.StructField("label", T.IntegerType()), T.StructField("d2", T.DoubleType())])
    step = max(1, 2_000_000 // (math.isqrt(len(labels)) + 32))
    names, sent = schema.names, points.sparkSession.sparkContext.broadcast(Near(labels, xyz))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                label, d2 = sent.value.find(np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "z")]).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label, pa.int32()), pa.array(d2)], names=names)

    return points.mapInArrow(run, schema)


def nearest_center(points: DataFrame, centers: DataFrame) -> DataFrame:
    """``points`` with label and d2 of the nearest centre. Up to ``MAX_CENTERS`` centres are sent to the tasks; more are a
    table that is dealt to regions, and so are the points."""
    if centers.limit(MAX_CENTERS + 1).count() > MAX_CENTERS:
        return nearest_by_regions(points, centers)
    return nearest(points, *centers_array(centers))


def assign_cells(media: DataFrame, centers: DataFrame) -> DataFrame:
    """(id, label) of media rows."""
    return nearest_center(points_of(media), centers).select("id", "label")


def labelled(media: DataFrame, centers: DataFrame) -> DataFrame:
    """(id, tags, label) of media rows; tags stay with their row, so that no join is needed."""
    x, y, z = lla_to_ecef(F.col("latitude"), F.col("longitude"))
    return nearest_center(media.select("id", "tags", x.alias("x"), y.alias("y"), z.alias("z")), centers).select("id", "tags", "label")


def cell_centers(centers: DataFrame) -> DataFrame:
    lat, lon, _ = ecef_to_lla(F.col("x"), F.col("y"), F.col("z"))
    return centers.select("label", "x", "y", "z", lat.alias("lat"), lon.alias("lon"))


def clustering_cost(points: DataFrame, centers: DataFrame) -> DataFrame:
    return nearest_center(points, centers).agg(F.sum("d2").alias("cost"))


def centroids(assigned: DataFrame, centers: DataFrame) -> DataFrame:
    """(label, x, y, z, n): means of the points of each label; a label without points keeps its centre."""
    means = assigned.groupBy("label").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], F.count("*").alias("n"))
    return centers.join(means, "label", "left").select("label", *[F.coalesce(f"m{c}", c).alias(c) for c in "xyz"], F.coalesce("n", F.lit(0)).alias("n"))


def candidate_weights(points: DataFrame, candidates: DataFrame) -> DataFrame:
    """(label, x, y, z, weight): points for which the candidate is the nearest, 0 for none. A place (with ``n``) counts as
    its points."""
    own = F.sum("n") if "n" in points.columns else F.count("*")
    n = nearest_center(points, candidates).groupBy("label").agg(own.alias("weight"))
    return candidates.join(n, "label", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))


def hashed_uniform(seed: int, turn: int, key: Column) -> Column:
    """A number in [0, 1) that depends on (seed, turn, key) only."""
    h = F.md5(F.concat(F.lit(f"{seed}:{turn}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(1 << 48)


def sample_one(points: DataFrame, seed: int) -> DataFrame:
    return points.orderBy(hashed_uniform(seed, 0, F.col("id")), "id").limit(1)


def oversample_centers(costed: DataFrame, k: int, total: float, seed: int, turn: int) -> DataFrame:
    """Each point with probability 2 * d2 * k / total; a place if any of its points is taken."""
    drawn = F.col(f"u{turn}") if "id" not in costed.columns else hashed_uniform(seed, turn, F.col("id"))
    return costed.where(drawn < 2.0 * k * F.col("d2") / F.lit(total)).select("x", "y", "z")


def places_of(points: DataFrame, init_steps: int, seed: int) -> DataFrame:
    """(x, y, z, n, u0, u1, ..): each distinct place with its number of points and, for each round of the start, the least
    of its points' hashes. A place is taken in a round if and only if one of its points is."""
    drawn = [F.min(hashed_uniform(seed, turn, F.col("id"))).alias(f"u{turn}") for turn in range(init_steps + 2)]
    made = settled(points.groupBy("x", "y", "z").agg(F.count("*").alias("n"), *drawn), "places")
    dealt = spread(made)
    return made if dealt is made else settled(dealt, "places")


def union_candidates(rounds: list[DataFrame]) -> DataFrame:
    """Candidates of all rounds, each place once."""
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out.distinct()


def weighted_kmeanspp(xyz: np.ndarray, weight: np.ndarray, k: int, seed: int, rounds: int = 30) -> np.ndarray:
    """k of about 10 k candidates: picks by weight times squared distance, then weighted Lloyd rounds."""
    if len(xyz) < k:
        raise ValueError(f"{len(xyz)} candidates are too few for {k} centres")
    rng = np.random.default_rng(seed)
    weight = weight.astype(np.float64)
    picked = [int(rng.choice(len(xyz), p=weight / weight.sum()))]
    d2 = ((xyz - xyz[picked[0]]) ** 2).sum(1)
    while len(picked) < k:
        p = weight * d2
        p[picked] = 0
        i = int(rng.choice(len(xyz), p=p / p.sum())) if p.sum() > 0 else int(np.setdiff1d(np.arange(len(xyz)), picked)[0])
        picked.append(i)
        d2 = np.minimum(d2, ((xyz - xyz[i]) ** 2).sum(1))
    centers = xyz[picked].copy()
    before = None
    for _ in range(rounds):
        near = Near(np.arange(k), centers)
        label = np.concatenate([near.find(b)[0] for b in np.array_split(xyz, max(1, len(xyz) // 20_000))])
        if before is not None and (label == before).all():
            break
        before = label
        mass = np.bincount(label, weight, k)
        for c in range(3):
            s = np.bincount(label, weight * xyz[:, c], k)
            centers[:, c] = np.where(mass > 0, s / np.where(mass > 0, mass, 1), centers[:, c])
        for j in np.flatnonzero(mass == 0):
            centers[j] = xyz[int(rng.integers(len(xyz)))]
    return centers


def apportioned(k: int, demand: np.ndarray, room: np.ndarray) -> np.ndarray:
    """k seats: one each, the others by demand, at most ``room`` each; largest remainders first. There must be k places,
    and no more regions than seats."""
    seats = np.minimum(1, room)
    while (left := k - seats.sum()) > 0:
        open_ = seats < room
        d = np.where(open_, np.maximum(demand, 1e-300), 0)
        want = left * d / d.sum()
        more = np.floor(want).astype(np.int64)
        spare = left - more.sum()
        more[np.argsort(-(want - more) * open_ - open_ * 1e-12, kind="stable")[:spare]] += 1
        seats = np.minimum(seats + more, room)
    return seats


def reduce_candidates(weighted: DataFrame, k: int, seed: int) -> DataFrame:
    """(label, x, y, z): k centres of candidates (label, x, y, z, weight).

    More than ``MAX_LOCAL`` are dealt to regions of about ``MAX_LOCAL`` / 4 (cut from a bounded sample). Each region
    tells by a first pick what its candidates cost with its share of the weight; on a surface the cost of m centres
    falls as 1 / m, so the total is least with seats as the root of m times cost (one at least). Then each region picks as many as it
    has seats, in a task of its own: the work grows with k, no step with its square, and the driver deals the seats.
    """
    n = weighted.count()
    if n <= MAX_LOCAL:
        got = weighted.toPandas().sort_values(["x", "y", "z"])
        return centers_frame(weighted.sparkSession, weighted_kmeanspp(got[["x", "y", "z"]].to_numpy(np.float64), got["weight"].to_numpy(), k, seed))
    total = float(weighted.agg(F.sum("weight")).first()[0])
    if n < k:
        raise ValueError(f"{n} candidates are too few for {k} centres")
    # few regions for the seats, since a region's first seat is not by demand
    region = max(MAX_LOCAL // 4, math.ceil(16 * n / k))
    dealt = settled(with_region(weighted, "label long, x double, y double, z double, weight long", n, region), "dealt")

    def own(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        frame = frame.sort_values(["x", "y", "z"])
        return frame[["x", "y", "z"]].to_numpy(np.float64), np.maximum(frame["weight"].to_numpy(np.float64), 1e-9)

    def demand(key, frame):
        xyz, w = own(frame)
        m = min(len(xyz), max(1, math.ceil(k * w.sum() / total)))
        d2 = Near(np.arange(m), weighted_kmeanspp(xyz, w, m, seed, rounds=3)).find(xyz)[1]
        return pd.DataFrame({"_region": [key[0]], "n": [len(xyz)], "demand": [math.sqrt(m * float((w * d2).sum()))]})

    told = dealt.groupBy("_region").applyInPandas(demand, "_region int, n long, demand double").toPandas().sort_values("_region")  # a row a region
    seats = dict(zip(told["_region"].tolist(), apportioned(k, told["demand"].to_numpy(), told["n"].to_numpy()).tolist(), strict=True))

    def pick(key, frame):
        xyz, w = own(frame)
        made = weighted_kmeanspp(xyz, w, seats[key[0]], seed) if seats[key[0]] else xyz[:0]
        return pd.DataFrame(made, columns=["x", "y", "z"])

    made = settled(dealt.groupBy("_region").applyInPandas(pick, "x double, y double, z double"), "picked")
    return numbered(made.orderBy("x", "y", "z"), "label").select(F.col("label").cast("int").alias("label"), "x", "y", "z")


def kmeans_init(points: DataFrame, k: int, init_steps: int = 5, seed: int = 42) -> DataFrame:
    """k-means||: one point, ``init_steps`` rounds of oversampling, then k of the weighted candidates. Centres (label, x, y, z).

    Of fewer than k places, each is a centre and the others are copies of them.
    """
    return _start(places_of(points, init_steps, seed), k, init_steps, seed)


def _start(places: DataFrame, k: int, init_steps: int, seed: int) -> DataFrame:
    # the point with the least hash, as ``sample_one`` takes it
    found = settled(places.orderBy("u0", "x", "y", "z").limit(1).select("x", "y", "z"), "candidates")
    if not found.limit(1).count():
        raise ValueError("no points")
    for turn in range(1, init_steps + 1):
        # distances alone count here, so any label will do
        own = places.select("x", "y", "z", "n", f"u{turn}")
        costed = settled(nearest_center(own, found.withColumn("label", F.hash("x", "y", "z"))), "costed")
        total = costed.agg(F.sum(F.col("n") * F.col("d2"))).first()[0] or 0.0
        if total == 0:
            break
        more = oversample_centers(costed, k, total, seed, turn)  # about 2 k rows
        found = settled(union_candidates([found, more]), "candidates")
    n = found.count()
    if n < k:
        # fewer candidates than cells: take further distinct points in the order of their hashes
        spare = places.join(found, ["x", "y", "z"], "left_anti").orderBy(f"u{init_steps + 1}", "x", "y", "z").limit(k - n).select("x", "y", "z")
        found = settled(union_candidates([found, spare]), "candidates")
        n = found.count()
    labelled = numbered(found.orderBy("x", "y", "z"), "label").withColumn("label", F.col("label").cast("int"))
    if n < k:
        # fewer places than cells: all are centres, and the other centres are copies, which get no points
        copies = F.explode(F.sequence(F.col("label"), F.lit(k - 1), F.lit(n)))
        return labelled.select(copies.alias("label"), "x", "y", "z")
    return reduce_candidates(settled(candidate_weights(places.select("x", "y", "z", "n"), labelled), "weights"), k, seed)


def kmeans_fit(points: DataFrame, k: int, max_iter: int = 50, eps: float = 1e-4, init_steps: int = 5, seed: int = 42) -> DataFrame:
    """Centres after Lloyd rounds: assign, average, until every squared move is at most ``eps``.

    The mean of a label's points is its new centre. With ``max_iter=0`` the centres are those of the start.
    """
    spark = points.sparkSession
    places = places_of(points, init_steps, seed)
    labels, xyz = centers_array(_start(places, k, init_steps, seed))
    own = places.select("x", "y", "z", "n")
    mean = [(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "xyz"]
    # with copies among the centres each place is its own centre, which rounding would only move off the copies
    for _ in range(max_iter if places.count() >= k else 0):
        means = nearest(own, labels, xyz).groupBy("label").agg(*mean).toPandas()  # k rows
        new = xyz.copy()
        new[means["label"].to_numpy()] = means[["x", "y", "z"]].to_numpy()
        moved = ((new - xyz) ** 2).sum(1).max()
        xyz = new
        if moved <= eps:
            break
    return centers_frame(spark, xyz)
