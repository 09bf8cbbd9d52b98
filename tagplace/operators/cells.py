"""Cell polygons: dual cells of the centres' convex hull on the earth's surface.

Seen from a centre, the hull's edges at it are a plane convex hull of the other centres (``seen_from``), and each of its
faces is a plane through the centre: another centre changes the face only if it lies beyond that plane. So a centre's
cell is local, with a certificate. Centres are dealt to regions (``operators/regions.py``); a region's task finds the
cells of its own centres among these and a bounded sample of all centres, and tells for each the regions whose boxes
reach beyond one of its faces. Those look the centre up once more, and what they find is added. Faces only shrink by
that, so no further region can matter, and cells don't depend on the sample or on the regions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import _B, _E2, _EP2, AXIS, surface_point
from ..sources.models import settled
from .cluster import Near, cell_centers
from .regions import XYZ, with_region

RING = "label int, ring array<struct<lat:double,lon:double>>"
#: Centres of a region, centres that every region knows, centres that a task looks up at a time in one region.
REGION, SEEDS, LOOKUPS = 2_000, 4_000, 20_000
#: The ellipsoid is x . (SHAPE * x) = 1.
SHAPE = np.array([AXIS**-2, AXIS**-2, _B**-2])
#: The surface's largest radius of curvature: it lies within a ball of that radius that touches it anywhere.
WIDEST = AXIS**2 / _B
#: Sine of an angle that counts as straight; metres that a plane is moved outward for rounding.
STRAIGHT, MARGIN = 1e-9, 1e-3
_WAYS = np.column_stack([np.cos(np.arange(8) * math.pi / 4), np.sin(np.arange(8) * math.pi / 4)])


def _to_lla(v: np.ndarray) -> tuple[float, float]:
    p, th = math.hypot(v[0], v[1]), math.atan2(AXIS * v[2], _B * math.hypot(v[0], v[1]))
    lat = math.atan2(v[2] + _EP2 * _B * math.sin(th) ** 3, p - _E2 * AXIS * math.cos(th) ** 3)
    return math.degrees(lat), math.degrees(math.atan2(v[1], v[0]))


def surface_points(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points at sea level, their outward normals)."""
    lla = np.radians([_to_lla(v) for v in xyz])
    lat, lon = lla[:, 0], lla[:, 1]
    normal = np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
    n = AXIS / np.sqrt(1 - _E2 * np.sin(lat) ** 2)
    return np.column_stack([n * normal[:, 0], n * normal[:, 1], (1 - _E2) * n * normal[:, 2]]), normal


def axes_at(own: np.ndarray) -> np.ndarray:
    """East, north and up at a point at sea level, as rows."""
    up = SHAPE * own
    up = up / np.linalg.norm(up)
    east = np.array([-up[1], up[0], 0.0])
    east = east / np.linalg.norm(east) if np.linalg.norm(east) > 1e-12 else np.array([1.0, 0, 0])
    return np.array([east, np.cross(up, east), up])


def seen_from(own: np.ndarray, axes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Plane points of the points ``q`` at sea level; (0, 0) for ``own`` itself.

    The surface is convex, so every other point lies below the tangent plane at ``own``; a point's place on that plane is
    scaled by its depth. The depth is taken from the ellipsoid's equation, as differences of coordinates would lose it
    for near points.
    """
    d = q - own
    depth = (d * d) @ SHAPE / (2 * np.linalg.norm(SHAPE * own))
    return (d @ axes[:2].T) / np.where(depth > 0, depth, np.inf)[:, None]


def _hull2(u: np.ndarray) -> list[int]:
    """Indices of the convex hull of plane points, counter-clockwise from the first by coordinates."""
    order = np.lexsort((u[:, 1], u[:, 0])).tolist()
    xy = u.tolist()
    halves = []
    for way in (order, order[::-1]):
        half: list[int] = []
        for i in way:
            x, y = xy[i]
            while len(half) >= 2:
                (ax, ay), (bx, by) = xy[half[-2]], xy[half[-1]]
                turn = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
                if turn > STRAIGHT * math.hypot(bx - ax, by - ay) * math.hypot(x - ax, y - ay):
                    break
                half.pop()
            half.append(i)
        halves.append(half[:-1])
    return halves[0] + halves[1]


def neighbours(i: int, p: np.ndarray, normal: np.ndarray) -> list[int]:
    """Centres that share a hull face with centre i, in order around it, of all centres ``p``."""
    u = seen_from(p[i], axes_at(p[i]), np.delete(p, i, 0))
    return [j + (j >= i) for j in _hull2(u)]


def faces_of(axes: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(outward directions, offsets) of the edges of a plane hull, and the normals and reaches of the hull's faces there: a
    point q is beyond a face if ``(q - own) @ normal > 0``, and only if it is nearer than the reach (a point at distance c
    is seen within 2 * WIDEST / c)."""
    e = np.roll(u, -1, 0) - u
    out = np.column_stack([e[:, 1], -e[:, 0]])
    out = out / np.maximum(np.hypot(out[:, 0], out[:, 1]), 1e-300)[:, None]
    far = (out * u).sum(1)
    reach = np.divide(2 * WIDEST, far, out=np.full(len(far), np.inf), where=far > 1e-6)
    return out, far, out @ axes[:2] + far[:, None] * axes[2], reach + MARGIN


def star(own: np.ndarray, near: Near, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ``near`` that share a hull face with ``own``, normals and reaches of the faces), ``start`` being other
    points that count.

    From a first hull, the blocks that reach beyond a face are searched for the farthest point there, until no face has
    one. Points on a face's plane are returned too.
    """
    axes, rows = axes_at(own), np.zeros(0, np.int64)
    to_block = near.middle - own
    away, wide = np.sqrt((to_block**2).sum(1)), near.radius + MARGIN
    look = near.blocks[int(away.argmin())]
    while True:
        # the farthest of the nearest block each way; of all points if these are too few
        u = seen_from(own, axes, near.xyz[look])
        rows = np.unique(look[(u @ _WAYS.T).argmax(0)])
        rows = rows[(near.xyz[rows] != own).any(1)]
        if len(rows) + len(start) > 2 or len(look) == len(near.xyz):
            break
        look = np.arange(len(near.xyz))
    tried = rows
    while True:
        u = seen_from(own, axes, np.vstack([start, near.xyz[rows]]))
        ring = np.array(_hull2(u), np.int64)
        rows = rows[np.sort(ring[ring >= len(start)]) - len(start)]
        out, far, normals, reach = faces_of(axes, u[ring])
        slack = STRAIGHT * np.abs(u[ring]).max(initial=0)
        beyond = (to_block @ normals.T + np.sqrt((normals**2).sum(1)) * wide[:, None] > 0) & (away[:, None] - wide[:, None] < reach)
        blocks = np.flatnonzero(beyond.any(1))
        look = np.concatenate([near.blocks[b] for b in blocks]) if len(blocks) else np.zeros(0, np.int64)
        look = look[(near.xyz[look] != own).any(1)]
        if not len(look):
            return rows, normals, reach
        over = seen_from(own, axes, near.xyz[look]) @ out.T - far
        best = over.argmax(0)
        # a point that the hull left out once is on a face's plane but for rounding
        more = np.setdiff1d(look[best[over[best, np.arange(len(out))] > slack]], tried)
        if not len(more):
            return np.union1d(rows, look[(over >= -slack).any(1)]), normals, reach
        rows, tried = np.concatenate([rows, more]), np.concatenate([tried, more])


_STAR = ", ".join(f"n{c} array<{'int' if c == 'label' else 'double'}>" for c in ("label", *XYZ))


def _placed(centers: DataFrame) -> DataFrame:
    """label, x, y, z at sea level, and home: the lowest label in the same place (to a millimetre)."""
    x, y, z = surface_point(F.col("x"), F.col("y"), F.col("z"))
    own = settled(centers.select("label", x.alias("x"), y.alias("y"), z.alias("z")), "surface")
    spot = [F.round(c, 3).alias(f"_{c}") for c in XYZ]
    homes = own.select("label", *spot).groupBy("_x", "_y", "_z").agg(F.min("label").alias("home"))
    return own.select("*", *spot).join(homes, ["_x", "_y", "_z"]).select("label", *XYZ, "home")


def cell_neighbours(centers: DataFrame, region: int = REGION, seeds: int = SEEDS, lookups: int = LOOKUPS) -> tuple[DataFrame, DataFrame]:
    """(label, x, y, z, nlabel, nx, ny, nz) with the centres that may share a hull face with a centre, as arrays, for the
    lowest label of each place, and (label, home) of all labels. Fewer than four distinct centres raise."""
    whole = settled(_placed(centers), "homes")
    own = whole.where("label = home").select("label", *XYZ)
    n = own.count()
    if n < 4:
        raise ValueError("cells need at least four distinct centres")
    placed = settled(with_region(own, "label int, x double, y double, z double", n, region), "regions")
    # a row a region, and a bounded sample
    boxes = placed.groupBy("_region").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in XYZ]).toPandas().sort_values("_region")
    names = boxes["_region"].to_numpy()
    low, high = (boxes[[f"{f}_{c}" for c in XYZ]].to_numpy() for f in ("min", "max"))
    some = placed.orderBy(F.xxhash64("label"), "label").limit(seeds).toPandas()
    tasks = len(names)  # told, since few bytes mean much work here
    sent = centers.sparkSession.sparkContext.broadcast((some, names, low, high))

    def arrays(frame: pd.DataFrame, found: list[np.ndarray]) -> dict:
        labels, xyz = frame["label"].to_numpy(), frame[XYZ].to_numpy()
        return {"nlabel": [labels[r] for r in found], **{f"n{c}": [xyz[r, k] for r in found] for k, c in enumerate(XYZ)}}

    def first(key, frame):
        some, names, low, high = sent.value
        pool = pd.concat([frame, some[some["_region"] != key[0]]], ignore_index=True)
        near, none = Near(np.arange(len(pool)), pool[XYZ].to_numpy()), np.zeros((0, 3))
        found, others = [], []
        for p in near.xyz[: len(frame)]:
            rows, normals, reach = star(p, near, none)
            away = np.sqrt((np.maximum(np.maximum(low - p, p - high), 0) ** 2).sum(1))
            at = sum(np.maximum(normals[:, k, None] * (low[:, k] - p[k]), normals[:, k, None] * (high[:, k] - p[k])) for k in range(3))
            touched = names[((at + MARGIN * np.linalg.norm(normals, axis=1)[:, None] > 0) & (away < reach[:, None])).any(0)]
            found.append(rows)
            others.append(touched[touched != key[0]])
        return frame[["label", *XYZ]].assign(**arrays(pool, found), others=others)

    once = settled(placed.repartition(tasks, "_region").groupBy("_region").applyInPandas(first, f"label int, x double, y double, z double, {_STAR}, others array<int>"), "once")
    asked = once.withColumn("_region", F.explode("others")).drop("others")
    sizes = {r["_region"]: -(-r["n"] // lookups) for r in asked.groupBy("_region").agg(F.count("*").alias("n")).collect()}
    salts = F.create_map(*[F.lit(int(x)) for kv in sizes.items() for x in kv]) if sizes else F.create_map().cast("map<int,int>")
    count = F.coalesce(F.try_element_at(salts, F.col("_region")), F.lit(1))
    left = asked.withColumn("_salt", F.pmod(F.xxhash64("label"), count).cast("int"))
    right = placed.join(F.broadcast(asked.select("_region").distinct()), "_region").withColumn("_salt", F.explode(F.sequence(F.lit(0), count - 1)))

    def again(mine, table):
        found = []
        if len(mine):
            near = Near(np.arange(len(table)), table[XYZ].to_numpy())
            for r in mine.itertuples():
                found.append(star(np.array([r.x, r.y, r.z]), near, np.column_stack([r.nx, r.ny, r.nz]))[0])
        return pd.DataFrame({"label": mine["label"], **arrays(table, found)})

    by = ["_region", "_salt"]
    more = left.repartition(tasks, *by).groupBy(*by).cogroup(right.repartition(tasks, *by).groupBy(*by)).applyInPandas(again, f"label int, {_STAR}")
    parts = more.where(F.size("nlabel") > 0).groupBy("label").agg(F.collect_list(F.struct("nlabel", *[f"n{c}" for c in XYZ])).alias("more"))
    joined = [F.when(F.col("more").isNull(), F.col(c)).otherwise(F.concat(F.col(c), F.flatten(F.col("more").getField(c)))).alias(c) for c in ("nlabel", *[f"n{c}" for c in XYZ])]
    return once.join(parts, "label", "left").select("label", *XYZ, *joined), whole.select("label", "home")


def _ring(r) -> list[dict]:
    own = np.array([r.x, r.y, r.z])
    _, at = np.unique(r.nlabel, return_index=True)
    q = np.column_stack([r.nx, r.ny, r.nz])[at]
    near = q[_hull2(seen_from(own, axes_at(own), q))]
    return [dict(zip(("lat", "lon"), _to_lla(v), strict=True)) for v in (own + near + np.roll(near, -1, 0)) / 3]


def cell_polygons(centers: DataFrame, **sizes) -> DataFrame:
    """(label, ring): corners are face centroids at sea level, counter-clockwise.

    Centres in one place count once: the copies of the lowest label get its ring. Fewer than four distinct
    centres have no hull and raise. Centres have coordinates. ``sizes`` are those of ``cell_neighbours``; cells don't
    depend on them.
    """
    stars, homes = cell_neighbours(centers, **sizes)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"home": f["label"], "ring": [_ring(r) for r in f.itertuples()]})

    rings = stars.mapInPandas(run, RING.replace("label", "home", 1))
    return homes.join(rings, "home").select("label", "ring")


def cells_of(centers: DataFrame) -> DataFrame:
    """label, lat, lon, ring; fewer than four distinct centres have no hull, so their rings are null."""
    points = cell_centers(centers).select("label", "lat", "lon")
    if _placed(centers).where("label = home").count() < 4:
        return points.withColumn("ring", F.lit(None).cast(T.StructType.fromDDL(RING)["ring"].dataType))
    return points.join(cell_polygons(centers), "label")
