"""Queries of the geometry and filter operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefold.functions import geometry as g
from kinefold.functions.random import draw, draw_sql
from kinefold.functions.status import positioned, status_code, visibility_target
from kinefold.operators import filters as f
from kinefold.plans.fixtures import ctes, fixture, table
from kinefold.plans.registry import query

W, H = 256, 192


def r(column, digits: int = 6):
    return F.round(column, digits)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = fixture(spark, sf_dir, "det")
    a = det.select("group_id", "frame", F.col("det").alias("i"), *(F.col(c).alias(f"a_{c}") for c in g.Box._fields))
    b = det.select("group_id", "frame", F.col("det").alias("j"), *(F.col(c).alias(f"b_{c}") for c in g.Box._fields))
    return a.join(b, ["group_id", "frame"]).where("i < j")


_PAIRS = ctes("det") + ", pairs AS (SELECT a.group_id, a.frame, a.det AS i, b.det AS j, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM det a JOIN det b ON a.group_id = b.group_id AND a.frame = b.frame AND a.det < b.det), parts AS (SELECT *, greatest(least(ax1, bx1) - greatest(ax0, bx0), 0.0::DOUBLE) * greatest(least(ay1, by1) - greatest(ay0, by0), 0.0::DOUBLE) AS inter, (ax1 - ax0) * (ay1 - ay0) AS sa, (bx1 - bx0) * (by1 - by0) AS sb, (greatest(ax1, bx1) - least(ax0, bx0)) * (greatest(ay1, by1) - least(ay0, by0)) AS hull FROM pairs) "
_EXTENT = ctes("truth") + ", extent AS (SELECT group_id, frame, animal, min(x) AS lx, min(y) AS ly, max(x) AS hx, max(y) AS hy FROM truth WHERE x IS NOT NULL GROUP BY 1, 2, 3), padded AS (SELECT group_id, frame, animal, CAST(floor(least(greatest(lx - {pad}, 0), {w})) AS INTEGER) AS x0, CAST(floor(least(greatest(ly - {pad}, 0), {h})) AS INTEGER) AS y0, CAST(floor(least(greatest(hx + {pad}, 0), {w})) AS INTEGER) AS x1, CAST(floor(least(greatest(hy + {pad}, 0), {h})) AS INTEGER) AS y1 FROM extent) "
_CROP = ", based AS (SELECT *, least(greatest({side}, x1 - x0, y1 - y0), {w}) AS sx, least(greatest({side}, x1 - x0, y1 - y0), {h}) AS sy FROM padded), crop AS (SELECT group_id, frame, animal, CAST(CASE WHEN x1 - x0 < sx THEN least(greatest(floor((x0 + x1) / 2.0) - floor(sx / 2.0), 0), {w} - sx) ELSE x0 END AS INTEGER) AS x0, CAST(CASE WHEN y1 - y0 < sy THEN least(greatest(floor((y0 + y1) / 2.0) - floor(sy / 2.0), 0), {h} - sy) ELSE y0 END AS INTEGER) AS y0, CAST(CASE WHEN x1 - x0 < sx THEN least(greatest(floor((x0 + x1) / 2.0) - floor(sx / 2.0), 0), {w} - sx) + sx ELSE x1 END AS INTEGER) AS x1, CAST(CASE WHEN y1 - y0 < sy THEN least(greatest(floor((y0 + y1) / 2.0) - floor(sy / 2.0), 0), {h} - sy) + sy ELSE y1 END AS INTEGER) AS y1 FROM based) "


def _crop_sql(pad: int = 20, side: int = 64) -> str:
    return (_EXTENT + _CROP).format(pad=pad, side=side, w=W, h=H)


def extents(points: DataFrame, *keys: str) -> DataFrame:
    """Minima and maxima of the points of each key, as ex_x0 .. ex_y1."""
    return points.where("x is not null").groupBy(*keys).agg(F.min("x").alias("ex_x0"), F.min("y").alias("ex_y0"), F.max("x").alias("ex_x1"), F.max("y").alias("ex_y1"))


def crops(spark: SparkSession, sf_dir: str, pad: float = 20, side: int = 64) -> DataFrame:
    own = extents(fixture(spark, sf_dir, "truth"), "group_id", "frame", "animal")
    return own.select("group_id", "frame", "animal", *(c.alias(n) for n, c in g.crop_box(g.Box.named("ex_"), W, H, side, pad).columns().items()))


@query(_crop_sql() + "SELECT * FROM crop")
def ge1_crop_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crops(spark, sf_dir)


@query(ctes("det") + "SELECT group_id, frame, det, 0 AS corner, x0 AS x, y0 AS y FROM det UNION ALL SELECT group_id, frame, det, 1, x1, y0 FROM det UNION ALL SELECT group_id, frame, det, 2, x1, y1 FROM det UNION ALL SELECT group_id, frame, det, 3, x0, y1 FROM det")
def ge2_box_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = fixture(spark, sf_dir, "det")
    return det.select("group_id", "frame", "det", F.posexplode(g.box_corners(g.Box.named())).alias("corner", "p")).select("group_id", "frame", "det", "corner", "p.x", "p.y")


@query(ctes("det") + f"SELECT group_id, frame, det, CAST(round_even(greatest(0.0::DOUBLE, (x0 + x1) / 2 - (x1 - x0) * 0.625), 0) AS INTEGER) AS x0, CAST(round_even(greatest(0.0::DOUBLE, (y0 + y1) / 2 - (y1 - y0) * 0.625), 0) AS INTEGER) AS y0, CAST(round_even(least({W}::DOUBLE, (x0 + x1) / 2 + (x1 - x0) * 0.625), 0) AS INTEGER) AS x1, CAST(round_even(least({H}::DOUBLE, (y0 + y1) / 2 + (y1 - y0) * 0.625), 0) AS INTEGER) AS y1 FROM det")
def ge3_inflate_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "det").select("group_id", "frame", "det", *(c.alias(n) for n, c in g.inflate_box(g.Box.named(), W, H, 1.25).columns().items()))


_KEYS = ("CAST(substr(group_id, 2) AS BIGINT)", "CAST(frame AS BIGINT)", "CAST(det AS BIGINT)")


@query(
    ctes("det")
    + f", drawn AS (SELECT *, 1.0::DOUBLE + ({draw_sql(1, *_KEYS)} * 2 - 1) * 0.2::DOUBLE AS s, (x0 + x1) / 2 + (x1 - x0) * (({draw_sql(2, *_KEYS)} * 2 - 1) * 0.1::DOUBLE) AS cx, (y0 + y1) / 2 + (y1 - y0) * (({draw_sql(3, *_KEYS)} * 2 - 1) * 0.1::DOUBLE) AS cy FROM det), moved AS (SELECT *, CAST(floor(least(greatest(cx - (x1 - x0) * s / 2, 0), {W})) AS INTEGER) AS mx0, CAST(floor(least(greatest(cy - (y1 - y0) * s / 2, 0), {H})) AS INTEGER) AS my0, CAST(floor(least(greatest(cx + (x1 - x0) * s / 2, 0), {W})) AS INTEGER) AS mx1, CAST(floor(least(greatest(cy + (y1 - y0) * s / 2, 0), {H})) AS INTEGER) AS my1 FROM drawn) SELECT group_id, frame, det, CASE WHEN mx1 - mx0 < 8 OR my1 - my0 < 8 THEN CAST(x0 AS INTEGER) ELSE mx0 END AS x0, CASE WHEN mx1 - mx0 < 8 OR my1 - my0 < 8 THEN CAST(y0 AS INTEGER) ELSE my0 END AS y0, CASE WHEN mx1 - mx0 < 8 OR my1 - my0 < 8 THEN CAST(x1 AS INTEGER) ELSE mx1 END AS x1, CASE WHEN mx1 - mx0 < 8 OR my1 - my0 < 8 THEN CAST(y1 AS INTEGER) ELSE my1 END AS y1 FROM moved"
)
def ge4_jitter_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = g.jitter_box(g.Box.named(), W, H, (draw(1, *_KEYS), 0.2), (draw(2, *_KEYS), 0.1), (draw(3, *_KEYS), 0.1))
    return fixture(spark, sf_dir, "det").select("group_id", "frame", "det", *(c.alias(n) for n, c in b.columns().items()))


@query(
    (_EXTENT + ", joined AS (SELECT e.group_id, e.frame, e.animal, CASE WHEN i.x0 IS NULL THEN e.lx - 20 ELSE i.x0 END AS x0, CASE WHEN i.x0 IS NULL THEN e.ly - 20 ELSE i.y0 END AS y0, CASE WHEN i.x0 IS NULL THEN e.hx + 20 ELSE i.x1 END AS x1, CASE WHEN i.x0 IS NULL THEN e.hy + 20 ELSE i.y1 END AS y1, i.x0 IS NOT NULL AS stored FROM extent e LEFT JOIN (SELECT d.group_id, d.frame, d.det AS animal, d.x0, d.y0, d.x1, d.y1 FROM det d WHERE d.det % 2 = 0) i USING (group_id, frame, animal)) SELECT group_id, frame, animal, stored, CAST(floor(least(greatest(x0, 0), {w})) AS INTEGER) AS x0, CAST(floor(least(greatest(y0, 0), {h})) AS INTEGER) AS y0, CAST(floor(least(greatest(x1, 0), {w})) AS INTEGER) AS x1, CAST(floor(least(greatest(y1, 0), {h})) AS INTEGER) AS y1 FROM joined").format(pad=20, w=W, h=H).replace(ctes("truth"), ctes("truth", "det"))
)
def ge5_crop_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored box is bounded as it is, points with the usual pad."""
    own = extents(fixture(spark, sf_dir, "truth"), "group_id", "frame", "animal")
    stored = fixture(spark, sf_dir, "det").where("det % 2 = 0").select("group_id", "frame", F.col("det").alias("animal"), *(F.col(c).alias(f"st_{c}") for c in g.Box._fields))
    joined = own.join(stored, ["group_id", "frame", "animal"], "left")
    source = g.Box(*(F.coalesce(F.col(f"st_{c}"), F.col(f"ex_{c}") + s * 20) for c, s in zip(g.Box._fields, (-1, -1, 1, 1), strict=True)))
    return joined.select("group_id", "frame", "animal", F.col("st_x0").isNotNull().alias("stored"), *(c.alias(n) for n, c in g.padded_extent(source, W, H, 0).columns().items()))


@query((_EXTENT + "SELECT * FROM padded").format(pad=12, w=W, h=H))
def ge6_padded_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = extents(fixture(spark, sf_dir, "truth"), "group_id", "frame", "animal")
    return own.select("group_id", "frame", "animal", *(c.alias(n) for n, c in g.padded_extent(g.Box.named("ex_"), W, H, 12).columns().items()))


@query(_PAIRS + "SELECT group_id, frame, i, j, round(inter / (sa + sb - inter + 1e-7), 6) AS iou FROM parts")
def ge7_box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("group_id", "frame", "i", "j", r(g.box_iou(g.Box.named("a_"), g.Box.named("b_"))).alias("iou"))


@query(_PAIRS + "SELECT group_id, frame, i, j, round(1.0::DOUBLE - (inter / (sa + sb - inter + 1e-7) - (hull + 1e-7 - (sa + sb - inter + 1e-7)) / (hull + 1e-7)), 6) AS loss FROM parts")
def ge8_giou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("group_id", "frame", "i", "j", r(g.giou_loss(g.Box.named("a_"), g.Box.named("b_"))).alias("loss"))


@query(_PAIRS + "SELECT group_id, frame, i, j, round(sqrt(pow((ax0 + ax1) / 2 - (bx0 + bx1) / 2, 2) + pow((ay0 + ay1) / 2 - (by0 + by1) / 2, 2)) / (((ax1 - ax0 + ay1 - ay0) / 2 + (bx1 - bx0 + by1 - by0) / 2) / 2), 6) AS dist FROM parts")
def ge9_center_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("group_id", "frame", "i", "j", r(g.center_dist(g.Box.named("a_"), g.Box.named("b_"))).alias("dist"))


@query(_PAIRS + "SELECT group_id, frame, i, j, inter > 0 AS shares FROM parts")
def ge10_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("group_id", "frame", "i", "j", g.overlaps(g.Box.named("a_"), g.Box.named("b_")).alias("shares"))


@query(
    ctes("det")
    + f", fit AS (SELECT *, least(160::DOUBLE / ({W} + det), 96::DOUBLE / {H}) AS s FROM det), pad AS (SELECT *, floor((160 - round_even(({W} + det) * s, 0)) / 2) AS px, floor((96 - round_even({H} * s, 0)) / 2) AS py FROM fit), boxed AS (SELECT *, x0 * s + px AS bx0, y0 * s + py AS by0, x1 * s + px AS bx1, y1 * s + py AS by1 FROM pad), back AS (SELECT *, least(greatest((bx0 - px - 60 * s) / s, 0), {W} + det) AS sx0, least(greatest((by0 - py) / s, 0), {H}) AS sy0, least(greatest((bx1 - px - 60 * s) / s, 0), {W} + det) AS sx1, least(greatest((by1 - py) / s, 0), {H}) AS sy1 FROM boxed) SELECT group_id, frame, det, round(s, 6) AS scale, px AS pad_x, py AS pad_y, round(bx0, 6) AS lb_x0, round(by1, 6) AS lb_y1, round(CASE WHEN sx1 > sx0 AND sy1 > sy0 THEN sx0 END, 6) AS src_x0, round(CASE WHEN sx1 > sx0 AND sy1 > sy0 THEN sy1 END, 6) AS src_y1, round(CASE WHEN x0 - 60 >= 0 THEN x0 - 60 END, 6) AS kpt_x FROM back"
)
def ge11_letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into the detector's input, and back with boxes moved 60 px left: some leave the frame."""
    det = fixture(spark, sf_dir, "det").withColumns({"w": (F.col("det") + W).cast("double"), "h": F.lit(float(H))})
    w, h = F.col("w"), F.col("h")
    lb = g.Letterbox.fit(w, h, 160, 96)
    b = lb.box(g.Box.named())
    left = lb._replace(pad_x=lb.pad_x + F.lit(60.0) * lb.scale)
    back = left.source_box(b, w, h)
    kx, _ = left.source_point(b.x0, F.lit(48.0), w, h)
    return det.select("group_id", "frame", "det", r(lb.scale).alias("scale"), lb.pad_x.cast("double").alias("pad_x"), lb.pad_y.cast("double").alias("pad_y"), r(b.x0).alias("lb_x0"), r(b.y1).alias("lb_y1"), r(back.x0).alias("src_x0"), r(back.y1).alias("src_y1"), r(kx).alias("kpt_x"))


_COS, _SIN = math.cos(0.3), math.sin(0.3)
_M = ((1.1 * _COS, -1.1 * _SIN, 5.0), (1.1 * _SIN, 1.1 * _COS, -3.0))


@query(ctes("truth") + f"SELECT group_id, frame, animal, bodypart, round(x * {_M[0][0]!r}::DOUBLE + y * {_M[0][1]!r}::DOUBLE + 5.0::DOUBLE, 6) AS x, round(x * {_M[1][0]!r}::DOUBLE + y * {_M[1][1]!r}::DOUBLE - 3.0::DOUBLE, 6) AS y FROM truth")
def ge13_apply_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = g.apply_affine(F.col("x"), F.col("y"), _M)
    return fixture(spark, sf_dir, "truth").select("group_id", "frame", "animal", "bodypart", r(x).alias("x"), r(y).alias("y"))


#: Three calibrated cameras around the points of the embeddings: rotation about the vertical axis, and how far back.
RIG = [("c0", -0.4, 6.0), ("c1", 0.0, 7.0), ("c2", 0.5, 8.0)]
_DISTORTION = (-0.1, 0.02, 0.001, -0.001, 0.005)


def points3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as points: group_id (its label), frame (its number), point, x, y, z."""
    own = table(spark, sf_dir, "embeddings")
    triple = lambda k: [F.element_at("embedding", 3 * k + j).cast("double").alias(n) for j, n in ((1, "x"), (2, "y"), (3, "z"))]
    all_points = F.array(*(F.struct(F.lit(k).alias("point"), *triple(k)) for k in range(21)))
    return own.select(F.concat(F.lit("e"), F.col("label")).alias("group_id"), F.col("vec_id").cast("int").alias("frame"), F.explode(all_points).alias("p")).select("group_id", "frame", "p.*")


def cameras(spark: SparkSession) -> DataFrame:
    """The rig as a table of three rows, with the entries of the rotations."""
    rows = spark.createDataFrame([(n, ry, tz) for n, ry, tz in RIG], "camera string, ry double, tz double")
    return rows.select("camera", "ry", "tz", *(c.alias(f"r{k}") for k, c in enumerate(g.rodrigues(F.lit(0.0), F.col("ry"), F.lit(0.0)))))


def camera_columns() -> g.Camera:
    lit = F.lit
    return g.Camera(lit(300.0), lit(310.0), lit(128.0), lit(96.0), tuple(F.col(f"r{k}") for k in range(9)), (lit(0.1), lit(-0.2), F.col("tz")), tuple(lit(k) for k in _DISTORTION), lit(4.0), lit(2.0))


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of every point in every camera: u, v (null behind it)."""
    return g.project(points3d(spark, sf_dir).crossJoin(F.broadcast(cameras(spark))), camera_columns())


POINTS_SQL = "points AS (SELECT 'e' || CAST(label AS VARCHAR) AS group_id, CAST(vec_id AS INTEGER) AS frame, CAST(k AS INTEGER) AS point, CAST(embedding[3 * k + 1] AS DOUBLE) AS x, CAST(embedding[3 * k + 2] AS DOUBLE) AS y, CAST(embedding[3 * k + 3] AS DOUBLE) AS z FROM embeddings, (SELECT unnest(range(21)) AS k))"
RIG_SQL = "rig AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {ry}::DOUBLE, {tz}::DOUBLE)" for n, ry, tz in RIG) + ") AS t(camera, ry, tz))"
PROJECTED_SQL = (
    f"{POINTS_SQL}, {RIG_SQL}, seen AS (SELECT *, cos(ry) * x + sin(ry) * z + 0.1::DOUBLE AS px, y - 0.2::DOUBLE AS py, -sin(ry) * x + cos(ry) * z + tz AS pz FROM points, rig), flat AS (SELECT *, CASE WHEN pz > 0 THEN px / pz END AS a, CASE WHEN pz > 0 THEN py / pz END AS b FROM seen), bent AS (SELECT *, a * a + b * b AS r2, 1 + (a * a + b * b) * (-0.1::DOUBLE + (a * a + b * b) * (0.02::DOUBLE + (a * a + b * b) * 0.005::DOUBLE)) AS radial FROM flat), "
    "projected AS (SELECT group_id, frame, point, camera, x, y, z, 300 * (a * radial + 2 * 0.001::DOUBLE * a * b + -0.001::DOUBLE * (r2 + 2 * a * a)) + 128 - 4 AS u, 310 * (b * radial + 0.001::DOUBLE * (r2 + 2 * b * b) + 2 * -0.001::DOUBLE * a * b) + 96 - 2 AS v FROM bent)"
)


@query(f"WITH {PROJECTED_SQL} SELECT group_id, frame, point, camera, round(u, 4) AS u, round(v, 4) AS v FROM projected")
def ge14_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir).select("group_id", "frame", "point", "camera", r("u", 4).alias("u"), r("v", 4).alias("v"))


def mixed_columns() -> g.Camera:
    """The same rig with one pinhole; the other two are fisheyes."""
    return camera_columns()._replace(fisheye=g.is_fisheye(F.when(F.col("camera") == "c0", "pinhole").otherwise("fisheye")))


def projected_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.project(points3d(spark, sf_dir).crossJoin(F.broadcast(cameras(spark))), mixed_columns())


#: The equidistant lens in SQL, in place of the pinhole's two.
_ANGLE = "(1 + t * t * (-0.1::DOUBLE + t * t * (0.02::DOUBLE + t * t * (0.001::DOUBLE + t * t * -0.001::DOUBLE))))"
MIXED_SQL = PROJECTED_SQL.replace("projected AS (", "pinhole AS (") + f", angled AS (SELECT *, sqrt(r2) AS rad, atan(sqrt(r2)) AS t FROM bent), projected AS (SELECT * FROM pinhole WHERE camera = 'c0' UNION ALL SELECT group_id, frame, point, camera, x, y, z, 300 * a * t * {_ANGLE} / rad + 128 - 4 AS u, 310 * b * t * {_ANGLE} / rad + 96 - 2 AS v FROM angled WHERE camera <> 'c0')"


@query(f"WITH {MIXED_SQL} SELECT group_id, frame, point, camera, round(u, 4) AS u, round(v, 4) AS v FROM projected")
def ge14_project_fisheye(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected_mixed(spark, sf_dir).select("group_id", "frame", "point", "camera", r("u", 4).alias("u"), r("v", 4).alias("v"))


@query(f"WITH {PROJECTED_SQL} SELECT group_id, frame, point, camera, round(a, 7) AS a, round(b, 7) AS b FROM flat")
def ge14_unproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directions of the points, back from their pixels in both kinds of lenses."""
    pixels = projected_mixed(spark, sf_dir).select("group_id", "frame", "point", "camera", "u", "v")
    own = g.unproject(pixels.join(F.broadcast(cameras(spark)), "camera"), mixed_columns())
    return own.select("group_id", "frame", "point", "camera", r("a", 7).alias("a"), r("b", 7).alias("b"))


@query(ctes("sess") + ", frames AS (SELECT group_id, unnest(range(n_frames)) AS frame FROM sess), moving AS (SELECT DISTINCT concat('g', CAST(l_orderkey % 8 AS STRING)) AS group_id, CAST(floor(l_orderkey / 8.0) AS BIGINT) AS frame, true AS has FROM lineitem) SELECT group_id, CAST(count(*) AS BIGINT) AS n_frames, CAST(count(has) AS BIGINT) AS n_posed, count(has) < count(*) AS gap, round(avg(coalesce(CASE WHEN has THEN frame * 0.5::DOUBLE END, 0.25::DOUBLE)), 6) AS mean_tx FROM frames LEFT JOIN moving USING (group_id, frame) GROUP BY 1")
def ge15_camera_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static pose, or the frame's own where the camera moves; groups with a gap are marked."""
    frames = fixture(spark, sf_dir, "sess").select("group_id", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame"))
    own = fixture(spark, sf_dir, "inst").select("group_id", "frame").distinct().withColumn("tx", F.col("frame") * F.lit(0.5))
    posed = frames.join(own, ["group_id", "frame"], "left").withColumn("pose", F.coalesce("tx", F.lit(0.25)))
    return posed.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_frames"), F.count("tx").alias("n_posed"), (F.count("tx") < F.count(F.lit(1))).alias("gap"), r(F.avg("pose")).alias("mean_tx"))


@query(_crop_sql() + ", sized AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, 128::DOUBLE / greatest(x1 - x0, y1 - y0) AS f FROM crop) SELECT group_id, frame, animal, x0 + 4 AS offset_x, y0 + 2 AS offset_y, round(300 * f, 6) AS fx, round((x0 + 4) * f, 6) AS rx, greatest(CAST(round_even(w * f, 0) AS INTEGER), 1) AS rw, greatest(CAST(round_even(h * f, 0) AS INTEGER), 1) AS rh FROM sized")
def ge16_crop_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    ox, oy, w, h = g.crop_camera(F.lit(4), F.lit(2), g.Box.named())
    factor = g.resize_factor(w, h, 128.0)
    return crops(spark, sf_dir).select("group_id", "frame", "animal", ox.alias("offset_x"), oy.alias("offset_y"), r(F.lit(300) * factor).alias("fx"), r(ox * factor).alias("rx"), g.resized_side(w, factor).alias("rw"), g.resized_side(h, factor).alias("rh"))


_S, _C = abs(math.sin(0.3)), abs(math.cos(0.3))


@query(
    ctes("regions")
    + f", turned AS (SELECT *, (x0 + x1) / 2 * {_M[0][0]!r}::DOUBLE + (y0 + y1) / 2 * {_M[0][1]!r}::DOUBLE + 5 AS cx, (x0 + x1) / 2 * {_M[1][0]!r}::DOUBLE + (y0 + y1) / 2 * {_M[1][1]!r}::DOUBLE - 3 AS cy, (x1 - x0) * 1.1::DOUBLE AS w, (y1 - y0) * 1.1::DOUBLE AS h FROM regions), sized AS (SELECT *, CASE WHEN least(w, h) <= greatest(w, h) * {2 * _S * _C!r}::DOUBLE THEN CASE WHEN w >= h THEN least(w, h) / 2 / {_S!r}::DOUBLE ELSE least(w, h) / 2 / {_C!r}::DOUBLE END ELSE (w * {_C!r}::DOUBLE - h * {_S!r}::DOUBLE) / {_C * _C - _S * _S!r}::DOUBLE END AS cw, CASE WHEN least(w, h) <= greatest(w, h) * {2 * _S * _C!r}::DOUBLE THEN CASE WHEN w >= h THEN least(w, h) / 2 / {_C!r}::DOUBLE ELSE least(w, h) / 2 / {_S!r}::DOUBLE END ELSE (h * {_C!r}::DOUBLE - w * {_S!r}::DOUBLE) / {_C * _C - _S * _S!r}::DOUBLE END AS ch FROM turned) SELECT group_id, frame, camera, round(cx - cw / 2, 4) AS x0, round(cy - ch / 2, 4) AS y0, round(cx + cw / 2, 4) AS x1, round(cy + ch / 2, 4) AS y1 FROM sized"
)
def ge17_inscribe_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = g.inscribe_rect(g.Box.named(), 0.3, 1.1, _M)
    return fixture(spark, sf_dir, "regions").select("group_id", "frame", "camera", *(r(c, 4).alias(n) for n, c in b.columns().items()))


@query(ctes("truth", "det") + "SELECT group_id, frame, animal, round(avg(CASE WHEN x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE x IS NOT NULL), 6) AS frac FROM truth JOIN (SELECT group_id, frame, det AS animal, x0, y0, x1, y1 FROM det) USING (group_id, frame, animal) GROUP BY 1, 2, 3")
def ge18_kpt_in_box_frac(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fixture(spark, sf_dir, "det").withColumnRenamed("det", "animal")
    inside = F.when(F.col("x").isNotNull(), (F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).cast("double"))
    return fixture(spark, sf_dir, "truth").join(boxes, ["group_id", "frame", "animal"]).groupBy("group_id", "frame", "animal").agg(r(F.avg(inside)).alias("frac"))


@query(_crop_sql() + ", pose AS (SELECT group_id, frame, animal, avg(x) AS mx, avg(y) AS my FROM truth WHERE x IS NOT NULL GROUP BY 1, 2, 3) SELECT group_id, frame, animal, round(sqrt(pow(mx - (x0 + x1) / 2.0::DOUBLE, 2) + pow(my - (y0 + y1) / 2.0::DOUBLE, 2)) / ((x1 - x0 + y1 - y0) / 2.0::DOUBLE), 6) AS agree FROM crop JOIN pose USING (group_id, frame, animal)")
def ge19_box_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pose = fixture(spark, sf_dir, "truth").groupBy("group_id", "frame", "animal").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    b = g.Box.named()
    cx, cy = b.centre
    return crops(spark, sf_dir).join(pose, ["group_id", "frame", "animal"]).select("group_id", "frame", "animal", r(F.hypot(F.col("mx") - cx, F.col("my") - cy) / b.mean_side).alias("agree"))


@query(_crop_sql(10, 32) + "SELECT group_id, frame, animal, first_value(x0) OVER w AS x0, first_value(y0) OVER w AS y0, first_value(x1) OVER w AS x1, first_value(y1) OVER w AS y1 FROM crop WINDOW w AS (PARTITION BY group_id, animal ORDER BY frame)")
def ge20_occupancy_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame's box of each animal, for all its frames."""
    from pyspark.sql import Window

    w = Window.partitionBy("group_id", "animal").orderBy("frame")
    return crops(spark, sf_dir, 10, 32).select("group_id", "frame", "animal", *(F.first(c).over(w).alias(c) for c in g.Box._fields))


@query(_crop_sql().replace(ctes("truth"), ctes("truth", "det")) + f", moved AS (SELECT c.group_id, c.frame, c.animal, (d.x0 - c.x0) * f AS x0, (d.y0 - c.y0) * f AS y0, (d.x1 - c.x0) * f AS x1, (d.y1 - c.y0) * f AS y1 FROM (SELECT *, {H}::DOUBLE / greatest(x1 - x0, y1 - y0) AS f FROM crop) c JOIN (SELECT group_id, frame, det AS animal, x0, y0, x1, y1 FROM det) d USING (group_id, frame, animal)) SELECT group_id, frame, animal, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM moved")
def ge21_box_to_crop_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop = crops(spark, sf_dir).select("group_id", "frame", "animal", *(F.col(c).alias(f"c_{c}") for c in g.Box._fields))
    det = fixture(spark, sf_dir, "det").withColumnRenamed("det", "animal")
    c, d = g.Box.named("c_"), g.Box.named()
    factor = g.resize_factor(c.width, c.height, float(H))
    moved = g.Box((d.x0 - c.x0) * factor, (d.y0 - c.y0) * factor, (d.x1 - c.x0) * factor, (d.y1 - c.y0) * factor)
    return crop.join(det, ["group_id", "frame", "animal"]).select("group_id", "frame", "animal", *(r(v).alias(n) for n, v in moved.columns().items()))


@query(ctes("pred") + "SELECT group_id, frame, pred, bodypart, round(1 / (1 + exp(-logit)), 9) AS score, logit AS score_logit FROM pred")
def ge22_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "pred").select("group_id", "frame", "pred", "bodypart", r(g.sigmoid(F.col("logit")), 9).alias("score"), F.col("logit").alias("score_logit"))


@query(ctes("det") + f"SELECT group_id, camera, CAST(floor(frame / 16.0) AS INTEGER) AS win, CAST(greatest(floor(min(x0)), 0) AS INTEGER) AS x0, CAST(greatest(floor(min(y0)), 0) AS INTEGER) AS y0, CAST(greatest(least(ceil(max(x1)), {W}), greatest(floor(min(x0)), 0) + 1) AS INTEGER) AS x1, CAST(greatest(least(ceil(max(y1)), {H}), greatest(floor(min(y0)), 0) + 1) AS INTEGER) AS y1 FROM det GROUP BY 1, 2, 3")
def ge23_union_window_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of a window's boxes in each camera, at least a pixel."""
    own = fixture(spark, sf_dir, "det").groupBy("group_id", "camera", F.floor(F.col("frame") / 16).cast("int").alias("win"))
    low = own.agg(F.greatest(F.floor(F.min("x0")), F.lit(0)).cast("int").alias("x0"), F.greatest(F.floor(F.min("y0")), F.lit(0)).cast("int").alias("y0"), F.least(F.ceil(F.max("x1")), F.lit(W)).alias("hx"), F.least(F.ceil(F.max("y1")), F.lit(H)).alias("hy"))
    return low.select("group_id", "camera", "win", "x0", "y0", F.greatest("hx", F.col("x0") + 1).cast("int").alias("x1"), F.greatest("hy", F.col("y0") + 1).cast("int").alias("y1"))


@query(ctes("inst") + "SELECT group_id, frame, animal, CAST(least(greatest(frame % 41 + (frame % 41) % 2, 2), 32) AS INTEGER) AS span FROM inst")
def ge24_even_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "inst").select("group_id", "frame", "animal", g.even_span(F.col("frame") % 41, 33).cast("int").alias("span"))


# Filters


@query(ctes("truth") + "SELECT group_id, frame, animal, bodypart, CAST(CASE status WHEN 'missing' THEN 0 WHEN 'visible' THEN 1 WHEN 'projected' THEN 2 END AS TINYINT) AS code, status IN ('visible', 'projected') AS positioned FROM truth")
def pf1_status_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "truth").select("group_id", "frame", "animal", "bodypart", status_code(F.col("status")).alias("code"), positioned(F.col("status")).alias("positioned"))


@query(ctes("truth") + "SELECT group_id, frame, animal, bodypart, CASE status WHEN 'visible' THEN 1.0::DOUBLE WHEN 'missing' THEN 0.0::DOUBLE END AS target FROM truth")
def pf2_visibility_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "truth").select("group_id", "frame", "animal", "bodypart", visibility_target(F.col("status")).alias("target"))


@query(ctes("sess", "truth") + "SELECT group_id, label_source, (label_source = 'annotated') OR coalesce(any_missing, true) AS assessed FROM sess LEFT JOIN (SELECT group_id, bool_or(status = 'missing') AS any_missing FROM truth GROUP BY 1) USING (group_id)")
def pf3_has_visibility_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.has_visibility_assessment(fixture(spark, sf_dir, "sess"), fixture(spark, sf_dir, "truth")).select("group_id", "label_source", "assessed")


@query(ctes("truth") + "SELECT DISTINCT group_id, frame FROM truth WHERE status <> 'unlabeled'")
def pf4_labelled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.labelled_frames(fixture(spark, sf_dir, "truth"))


def _masked(spark: SparkSession, sf_dir: str, rule) -> DataFrame:
    x, y = rule(F.col("x"), F.col("y"))
    return fixture(spark, sf_dir, "truth").select("group_id", "frame", "animal", "bodypart", x.alias("x"), y.alias("y"))


@query(ctes("truth") + "SELECT group_id, frame, animal, bodypart, CASE WHEN x >= 0 AND x < 160 AND y >= 0 AND y < 120 THEN x END AS x, CASE WHEN x >= 0 AND x < 160 AND y >= 0 AND y < 120 THEN y END AS y FROM truth")
def pf5_mask_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, lambda x, y: f.mask_outside(x, y, 160, 120))


@query(ctes("truth") + "SELECT group_id, frame, animal, bodypart, CASE WHEN x BETWEEN 10 AND 140 AND y BETWEEN 8 AND 110 THEN x END AS x, CASE WHEN x BETWEEN 10 AND 140 AND y BETWEEN 8 AND 110 THEN y END AS y FROM truth")
def pf6_drop_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, lambda x, y: f.drop_outside(x, y, 10, 8, 140, 110))


@query(ctes("truth") + "SELECT * FROM truth WHERE frame >= 40 AND frame < 400")
def pf7_frame_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.frame_range(fixture(spark, sf_dir, "truth"), 40, 400)


@query(ctes("pred") + ", m AS (SELECT group_id, frame, pred, quantile_cont(logit, 0.5) AS median_logit FROM pred GROUP BY 1, 2, 3) SELECT group_id, frame, pred, bodypart, CASE WHEN median_logit >= 0.25 THEN x END AS x, CASE WHEN median_logit >= 0.25 THEN y END AS y, median_logit FROM pred JOIN m USING (group_id, frame, pred)")
def pf8_gate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.gate_rows(fixture(spark, sf_dir, "pred"), 0.25).select("group_id", "frame", "pred", "bodypart", "x", "y", "median_logit")


@query(f"WITH {PROJECTED_SQL} SELECT group_id || '/' || CAST(frame AS VARCHAR) AS group_id, point, count(*) FILTER (WHERE u BETWEEN -2 AND {W + 2} AND v BETWEEN -2 AND {H + 2}) >= 2 AS usable FROM projected GROUP BY 1, 2")
def pf9_usable_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = projected(spark, sf_dir).withColumn("group_id", F.concat_ws("/", "group_id", "frame"))
    return f.usable_prior_3d(own, float(W), float(H))


@query(ctes("truth") + "SELECT concat(group_id, '_', CAST(frame AS STRING)) AS group_id, bool_or(status = 'visible') AS kept FROM truth GROUP BY 1")
def pf10_drop_unlabelled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here every frame is a clip of its own: some have no visible row."""
    rows = fixture(spark, sf_dir, "truth").select(F.concat_ws("_", "group_id", "frame").alias("group_id"), "status")
    kept, gone = f.unlabelled_groups(rows.select("group_id").distinct(), rows)
    return kept.select("group_id", F.lit(True).alias("kept")).union(gone.select("group_id", F.lit(False)))


@query(ctes("insts") + "SELECT concat(group_id, '__', camera) AS session_id, CAST(count(*) AS BIGINT) AS n, min(frame) AS first_frame, max(frame) AS last_frame FROM insts GROUP BY 1")
def pf11_slice_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.slice_cameras(fixture(spark, sf_dir, "insts")).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@query(ctes("det") + "SELECT group_id, frame, camera, det, score FROM det WHERE score >= 0.6")
def pf12_det_score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.score_filter(fixture(spark, sf_dir, "det"), 0.6).select("group_id", "frame", "camera", "det", "score")
