"""Joins between predictions, labels, boxes and regions. Range conditions always ride on an equality of clip and frame, so that no join is a nested loop over the table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kinefold.functions.geometry import Box, center_dist
from kinefold.operators.filters import BUCKET_FRAMES, FRAME

POINT = [*FRAME, "animal", "bodypart"]
#: Rows of a table of names (bodyparts, cameras) that may be broadcast.
SMALL = 100_000


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Null where either side is absent."""
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """Broadcast a side after its size was checked; a larger one is left to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def align(pred: DataFrame, true: DataFrame) -> DataFrame:
    """Predictions (px, py) beside labels (x, y) of the same key; surplus rows of either side stay."""
    return pred.join(true, POINT, "full")


def resolve_axis(points: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bodyparts by name to global ids, and the names that the registry lacks."""
    names = small(registry)
    return points.join(names, "bodypart"), points.select("bodypart").distinct().join(names, "bodypart", "left_anti")


def frame_pairs(pred: DataFrame, true: DataFrame, n_bodyparts: int, *, min_frac: float = 0.0, max_dist: float | None = None, cost: str = "mean", bucketed: bool = False) -> DataFrame:
    """Every prediction with every label of its frame: i, j, cost over the points that both have, and how many those are; if bucketed, with the bucket of frames that both
    sides are dealt by, which serves the join, the sums and a solver of whole buckets where spark.sql.requireAllClusterKeysForCoPartition is off. Sides that have a bucket are dealt.

    With cost 'penalised' each labelled point that the prediction lacks counts as max_dist.
    """
    import math

    need = max(1, math.ceil(min_frac * n_bodyparts))
    dealt = bucketed and "bucket" in pred.columns and "bucket" in true.columns
    bucket, at = (F.col("bucket") if dealt else F.floor(F.col("frame") / BUCKET_FRAMES).alias("bucket"),) if bucketed else (), [*FRAME, *(["bucket"] if bucketed else [])]
    p = pred.where("x is not null and y is not null").select(*FRAME, *bucket, "bodypart", F.col("pred").alias("i"), F.col("x").alias("px"), F.col("y").alias("py"))
    t = true.where("x is not null and y is not null").select(*FRAME, *bucket, "bodypart", F.col("animal").alias("j"), "x", "y")
    if bucketed and not dealt:
        n = int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        p, t = (df.repartition(n, "group_id", "bucket") for df in (p, t))
    d = distance(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
    pairs = p.join(t, [*at, "bodypart"]).groupBy(*at, "i", "j").agg(F.sum(d).alias("total"), F.count(F.lit(1)).alias("shared"))
    pairs = pairs.where(F.col("shared") >= need)
    out = [*FRAME, "i", "j", "cost", "shared", *(["bucket"] if bucketed else [])]
    if cost == "penalised" and max_dist is not None:
        labelled = t.groupBy(*FRAME, "j").agg(F.count(F.lit(1)).alias("labelled"))
        return pairs.join(labelled, [*FRAME, "j"]).withColumn("cost", (F.col("total") + max_dist * (F.col("labelled") - F.col("shared"))) / F.col("labelled")).select(*out)
    return pairs.withColumn("cost", F.col("total") / F.col("shared")).select(*out)


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str] | None = None, *, strict: bool = False) -> DataFrame:
    """Points (x, y) inside any box of their key: edges count unless strict."""
    x, y, b = F.col("p.x"), F.col("p.y"), Box.named("b.")
    inside = (x > b.x0) & (x < b.x1) & (y > b.y0) & (y < b.y1) if strict else (x >= b.x0) & (x <= b.x1) & (y >= b.y0) & (y <= b.y1)
    same = [F.col(f"p.{k}") == F.col(f"b.{k}") for k in (keys or FRAME)]
    condition = inside
    for c in same:
        condition = c & condition
    return points.alias("p").join(boxes.alias("b"), condition, "left_semi")


def union_rects(regions: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    names = [*keys, *Box._fields]
    return regions.select(*names).unionByName(boxes.select(*names))


def certified(points: DataFrame, regions: DataFrame, boxes: DataFrame, keys: list[str] | None = None, *, has_regions: bool = True) -> DataFrame:
    """Points strictly inside a certified region or any box; without a regions table everything is certified."""
    if not has_regions:
        return points
    keys = keys or [*FRAME, "camera"]
    return points_in_boxes(points, union_rects(regions, boxes, keys).where("x1 > x0 and y1 > y0"), keys, strict=True)


def centroids(keypoints: DataFrame, *keys: str) -> DataFrame:
    return keypoints.where("x is not null").groupBy(*keys).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def assign_points_to_boxes(grid: DataFrame, boxes: DataFrame, *, stride: float, radius: float = 2.5, top_k: int | None = None) -> DataFrame:
    """Grid points (key, point, x, y) to the nearest centre of a box that they are inside and near: point, box, d2."""
    b = Box.named()
    cx, cy = b.centre
    reach = radius * stride
    near = (F.col("x") > b.x0) & (F.col("x") < b.x1) & (F.col("y") > b.y0) & (F.col("y") < b.y1) & (F.abs(F.col("x") - cx) < reach) & (F.abs(F.col("y") - cy) < reach)
    pairs = grid.join(boxes, FRAME).where(near).withColumn("d2", (F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy))
    if top_k is not None:
        pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*FRAME, "box").orderBy("d2", "point"))).where(F.col("rank") <= top_k)
    return pairs.groupBy(*FRAME, "point").agg(F.min_by(F.struct("box", "d2"), F.struct("d2", "box")).alias("m")).select(*FRAME, "point", "m.box", "m.d2")


def cross_camera_pairs(dets: DataFrame) -> DataFrame:
    """Detections of a frame in two cameras, a < b."""
    side = lambda n: dets.select(*FRAME, F.col("camera").alias(f"camera_{n}"), F.col("det").alias(f"det_{n}"))
    return side("a").join(side("b"), FRAME).where("camera_a < camera_b")


def carry_prior(windows: DataFrame, overlap: int) -> DataFrame:
    """Each window (group, animal, win, start, length, predicted) with where its prior comes from: the frame length - overlap of the last predicted window; null if a window between was skipped."""
    w = Window.partitionBy("group_id", "animal").orderBy("win").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("predicted"), F.struct("win", "start", "length")), ignorenulls=True).over(w)
    carried = windows.withColumn("last", last)
    frame = F.col("last.start") + F.col("last.length") - overlap
    return carried.withColumn("prior_frame", F.when((F.col("start") - frame >= 0) & (F.col("last.start") + F.col("last.length") > F.col("start")), frame)).drop("last")


def _nearest(frame: np.ndarray, animal: np.ndarray, part: np.ndarray, x: np.ndarray, y: np.ndarray, has_x: np.ndarray, has_y: np.ndarray, min_usable: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of points (animal and part as numbers in their order): each one's item (an animal in a frame), and by item its animal, the nearest item (-1 without one) and their distance."""
    items, item = np.unique(np.stack([frame, animal]), axis=1, return_inverse=True)
    item, n = item.reshape(-1), items.shape[1]
    usable = np.bincount(item[has_x], minlength=n) >= min_usable
    own = np.flatnonzero(has_x)
    own = own[np.lexsort((part[own], frame[own]))]
    # The points of one frame and bodypart lie together: each meets all of them.
    new = np.ones(len(own), bool)
    new[1:] = (frame[own][1:] != frame[own][:-1]) | (part[own][1:] != part[own][:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(own)))
    run = np.cumsum(new) - 1
    many = size[run]
    a = np.repeat(np.arange(len(own)), many)
    b = np.repeat(first[run] - (np.cumsum(many) - many), many) + np.arange(len(a))
    a, b = own[a], own[b]
    kept = (animal[a] != animal[b]) & usable[item[b]]
    a, b = a[kept], b[kept]
    pairs, pair = np.unique(item[a] * n + item[b], return_inverse=True)
    both = has_y[a] & has_y[b]
    apart = np.sqrt((x[a] - x[b]) * (x[a] - x[b]) + (y[a] - y[b]) * (y[a] - y[b]))
    total, count = np.bincount(pair[both], apart[both], len(pairs)), np.bincount(pair[both], minlength=len(pairs))
    dist = np.where(count > 0, total / np.maximum(count, 1), -np.inf)  # unknown ones come first, as nulls do
    i, other = pairs // max(n, 1), pairs % max(n, 1)
    order = np.lexsort((items[1][other], np.round(dist, 9), i))
    best = order[np.append(True, i[order][1:] != i[order][:-1])] if len(order) else order
    near, far = np.full(n, -1), np.full(n, -np.inf)
    near[i[best]], far[i[best]] = other[best], dist[best]
    return item, items[1], near, far


def _by_frames(points: DataFrame, solve: Callable[[pa.Table, np.ndarray, pa.Array, tuple], pa.Table], schema: StructType, min_usable: int) -> DataFrame:
    """solve(points that have a key, and the others' places; animals in order; what _nearest found) over buckets of frames, from one shuffle."""
    import pyarrow.compute as pc

    names = points.columns

    def bucket(table: pa.Table) -> pa.Table:
        table = table.select(names).combine_chunks()
        here = pc.and_(pc.and_(table["group_id"].is_valid(), table["frame"].is_valid()), pc.and_(table["animal"].is_valid(), table["bodypart"].is_valid())).to_numpy().astype(bool)
        own = table.filter(pa.array(here))
        animals, parts = (pc.unique(own[c]).sort() for c in ("animal", "bodypart"))
        codes = [pc.index_in(own[c], value_set=v).to_numpy() for c, v in (("animal", animals), ("bodypart", parts))]
        xy = [own[c].to_numpy() for c in ("x", "y")]
        has = [own[c].is_valid().to_numpy().astype(bool) for c in ("x", "y")]
        found = _nearest(own["frame"].to_numpy().astype(np.int64), *(c.astype(np.int64) for c in codes), *xy, *has, min_usable)
        return solve(own, table.filter(pa.array(~here)), animals, (codes[1].astype(np.int64), *found)).cast(out)

    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    return points.withColumn("_bucket", F.floor(F.col("frame") / BUCKET_FRAMES)).groupBy("group_id", "_bucket").applyInArrow(bucket, schema)


def nearest_neighbour_row(points: DataFrame, min_usable: int = 2) -> DataFrame:
    """For each animal of a frame the nearest other one of at least min_usable points, by mean distance over the points that both have (one at least)."""

    def solve(own: pa.Table, _: pa.Table, animals: pa.Array, found: tuple) -> pa.Table:
        _, item, animal, near, far = found
        row = np.zeros(len(near), np.int64)
        row[item] = np.arange(len(item))
        has = np.flatnonzero(near >= 0)
        keys = own.select([*FRAME, "animal"]).take(row[has])
        return keys.append_column("neighbour", animals.take(animal[near[has]])).append_column("dist", pa.array(far[has], mask=np.isneginf(far[has])))

    own = points.where("x is not null").select(*POINT, *(F.col(c).cast("double").alias(c) for c in ("x", "y")))
    kind = own.schema["animal"].dataType
    schema = StructType([*(own.schema[c] for c in (*FRAME, "animal")), StructField("neighbour", kind), StructField("dist", DoubleType())])
    return _by_frames(own, solve, schema, min_usable)


def beside_nearest(points: DataFrame, min_usable: int = 2) -> DataFrame:
    """points with neighbour (as nearest_neighbour_row finds it) and its same point's place nx, ny, null where there is none: found and looked up in one go."""

    def solve(own: pa.Table, rest: pa.Table, animals: pa.Array, found: tuple) -> pa.Table:
        part, item, animal, near, _ = found
        other, kinds = near[item], int(part.max()) + 1 if len(part) else 1
        key = item * kinds + part
        order = np.argsort(key, kind="stable")
        wanted = np.where(other >= 0, other * kinds + part, -1)
        first, last = (np.searchsorted(key[order], wanted, side) for side in ("left", "right"))
        times = np.maximum(last - first, 1)
        row = np.repeat(np.arange(len(item)), times)
        at = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(len(row))
        none = (last <= first)[row]
        place = pa.array(order[np.where(none, 0, at)] if len(order) else at, mask=none)
        whole = own.take(row)
        whole = whole.append_column("neighbour", animals.take(pa.array(np.where(other[row] >= 0, animal[other[row]], 0), mask=other[row] < 0)))
        for c in ("x", "y"):
            whole = whole.append_column(f"n{c}", own[c].take(place))
        bare = [pa.nulls(len(rest), whole.schema.field(c).type) for c in ("neighbour", "nx", "ny")]
        return pa.concat_tables([whole, pa.table([*rest.columns, *bare], names=whole.column_names)])

    own = points.withColumns({c: F.col(c).cast("double") for c in ("x", "y")})
    schema = StructType([*own.schema, StructField("neighbour", own.schema["animal"].dataType), *(StructField(c, DoubleType()) for c in ("nx", "ny"))])
    return _by_frames(own, solve, schema, min_usable)


def shared_points(a: DataFrame, b: DataFrame, true: DataFrame) -> DataFrame:
    """Points that both arms and the labels have: ax, ay, bx, by, x, y."""
    here = lambda df, x, y: df.where(f"{x} is not null and {y} is not null")
    return here(a, "ax", "ay").join(here(b, "bx", "by"), POINT).join(here(true, "x", "y"), POINT)


def carry_solved(variant: DataFrame, base: DataFrame) -> DataFrame:
    """Clips whose 2D rows equal the base's in every frame, absent values included: group_id, carried, diverged (frames that differ)."""
    v = variant.select(*POINT, F.col("x").alias("vx"), F.col("y").alias("vy"), F.lit(True).alias("in_v"))
    b = base.select(*POINT, F.col("x").alias("bx"), F.col("y").alias("by"), F.lit(True).alias("in_b"))
    rows = v.join(b, POINT, "full").withColumn("same", F.col("in_v").eqNullSafe(F.col("in_b")) & F.col("vx").eqNullSafe(F.col("bx")) & F.col("vy").eqNullSafe(F.col("by")))
    frames = rows.groupBy(*FRAME).agg(F.bool_and("same").alias("same"))
    return frames.groupBy("group_id").agg(F.bool_and("same").alias("carried"), F.count_if(~F.col("same")).alias("diverged"))


def min_margin_filter(candidates: DataFrame, known: DataFrame, margin: float = 2.5) -> DataFrame:
    """Candidate boxes (c_x0 ..) at least margin box sides from every known box of their view."""
    keys = [*FRAME, "camera"]
    known = known.select(*(F.col(k).alias(f"k_{k}") for k in keys), *(F.col(c).alias(f"k_{c}") for c in Box._fields))
    condition = center_dist(Box.named("c_"), Box.named("k_")) < margin
    for k in keys:
        condition = (F.col(k) == F.col(f"k_{k}")) & condition
    return candidates.join(known, condition, "left_anti")


def rects_cover_points(points: DataFrame, rects: DataFrame) -> DataFrame:
    """Points with covered: inside a half-open rectangle of their frame; such points count as not seen."""
    r = Box.named("r.")
    x, y = F.col("p.x"), F.col("p.y")
    hit = (F.col("p.group_id") == F.col("r.group_id")) & (F.col("p.frame") == F.col("r.frame")) & (x >= r.x0) & (x < r.x1) & (y >= r.y0) & (y < r.y1)
    covered = points.alias("p").join(rects.alias("r"), hit, "left_semi").select(*POINT).withColumn("covered", F.lit(True))
    return points.join(covered, POINT, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def visibility_observation(keypoints: DataFrame, points3d: DataFrame) -> DataFrame:
    """Visible rows without coordinates and without a 3D point of the same key: violations."""
    bare = keypoints.where("status = 'visible' and (x is null or y is null)")
    return bare.join(points3d.select(*POINT).distinct(), POINT, "left_anti")
