"""Queries of the multi-view, tracking and streaming operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefold.operators import multiview as mv
from kinefold.plans.fixtures import ctes, fixture, table
from kinefold.functions import geometry as g
from kinefold.operators.validate import check_v12
from kinefold.plans.q_geometry import _DISTORTION, MIXED_SQL, POINTS_SQL, PROJECTED_SQL, camera_columns, cameras, points3d, projected, projected_mixed
from kinefold.plans.q_metrics import rounded
from kinefold.plans.q_sources import scratch
from kinefold.plans.registry import query
from kinefold.sources.tables import materialize
from kinefold.streaming import tracking as tr
from kinefold.streaming.association import GroupStep, associate_group, associate_stream
from kinefold.streaming import windows as sw

POINT = ["group_id", "frame", "point"]
_MOVED_SQL = PROJECTED_SQL.replace("+ 0.1::DOUBLE AS px", "+ (0.1::DOUBLE + frame % 50 * 0.01::DOUBLE) AS px")


def camera_rows(spark: SparkSession, fisheyes: bool = False) -> DataFrame:
    """The rig's table, with fisheyes or without."""
    lit = F.lit
    own = cameras(spark).select("camera", lit(300.0).alias("fx"), lit(310.0).alias("fy"), lit(128.0).alias("cx"), lit(96.0).alias("cy"), F.array(*(f"r{k}" for k in range(9))).alias("rotation"), F.array(lit(0.1), lit(-0.2), F.col("tz")).alias("translation"), F.array(*map(lit, _DISTORTION)).alias("distortion"), lit(4.0).alias("offset_x"), lit(2.0).alias("offset_y"))
    return own.withColumn("model", F.when(F.col("camera") == "c0", "pinhole").otherwise("fisheye")) if fisheyes else own


def rig(spark: SparkSession) -> mv.Rig:
    return mv.Rig.collect(camera_rows(spark))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir).select(*POINT, "camera", "u", "v")


@query(f"WITH {PROJECTED_SQL} SELECT group_id, frame, point, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, CAST(count(u) AS BIGINT) AS n_views FROM projected GROUP BY group_id, frame, point, x, y, z")
def mv1_triangulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that were projected come back."""
    return rounded(mv.triangulate(views(spark, sf_dir), rig(spark), POINT).select(*POINT, "x", "y", "z", "n_views"), 3)


@query(f"WITH {MIXED_SQL} SELECT group_id, frame, point, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, CAST(count(u) AS BIGINT) AS n_views FROM projected GROUP BY group_id, frame, point, x, y, z")
def mv1_triangulate_fisheye(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pinhole and two fisheyes, joined to the views as a table."""
    seen = projected_mixed(spark, sf_dir).select(*POINT, "camera", "u", "v")
    return rounded(mv.triangulate(seen, camera_rows(spark, True), POINT).select(*POINT, "x", "y", "z", "n_views"), 3)


@query(f"WITH {PROJECTED_SQL} SELECT group_id, frame, point, round(quantile_disc(sqrt(pow(u - round(u), 2) + pow(v - round(v), 2)), 0.5), 4) AS residual FROM projected GROUP BY 1, 2, 3")
def mv2_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = projected(spark, sf_dir).select(*POINT, F.col("u").alias("pu"), F.col("v").alias("pv"), F.round("u").alias("u"), F.round("v").alias("v"))
    return rounded(mv.residual(own, POINT), 4)


@query(f"WITH {_MOVED_SQL} SELECT group_id, frame, point, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, CAST(count(u) AS BIGINT) AS n_views FROM projected GROUP BY group_id, frame, point, x, y, z")
def mv1_moving_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rig that goes along an axis, frame by frame: every view brings the camera as it stood."""
    own = points3d(spark, sf_dir).crossJoin(F.broadcast(cameras(spark))).withColumn("tx", F.lit(0.1) + F.col("frame") % 50 * F.lit(0.01))
    camera = camera_columns()
    seen = g.project(own, camera._replace(t=(F.col("tx"), *camera.t[1:])))
    lens = mv.lens(camera.fx, camera.fy, camera.cx, camera.cy, F.array(*camera.r), F.array(F.col("tx"), *camera.t[1:]), F.array(*camera.k), camera.offset_x, camera.offset_y)
    return rounded(mv.triangulate(seen.select(*POINT, "camera", "u", "v", lens.alias("lens")), None, POINT).select(*POINT, "x", "y", "z", "n_views"), 3)


@query(f"WITH {PROJECTED_SQL}, n AS (SELECT group_id, frame, point, count(u) AS n_views, count(CASE WHEN camera = 'c1' THEN u END) AS odd FROM projected GROUP BY 1, 2, 3) SELECT 'V-12' AS rule, 'error' AS severity, group_id AS session_id, 'views do not meet' AS message, CAST(count(*) AS BIGINT) AS n FROM n WHERE point % 5 = 0 AND n_views >= 2 AND odd = 1 GROUP BY 3")
def v12_views_meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as animals; one camera's view of every fifth is another animal, 200 pixels below."""
    off = (F.col("point") % 5 == 0) & (F.col("camera") == "c1")
    own = views(spark, sf_dir).withColumn("v", F.when(off, F.col("v") + 200).otherwise(F.col("v")))
    return check_v12(mv.triangulate(own, rig(spark), POINT).withColumnRenamed("point", "animal").where("n_views >= 2"), 15.0)


@query(f"WITH {MIXED_SQL}, n AS (SELECT group_id, frame, point, count(u) AS n_views, count(CASE WHEN camera = 'c1' THEN u END) AS odd FROM projected GROUP BY 1, 2, 3) SELECT 'V-12' AS rule, 'error' AS severity, group_id AS session_id, 'views do not meet' AS message, CAST(count(*) AS BIGINT) AS n FROM n WHERE point % 5 = 0 AND n_views >= 2 AND odd = 1 GROUP BY 3")
def v12_fisheye_views_meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among fisheyes."""
    off = (F.col("point") % 5 == 0) & (F.col("camera") == "c1")
    own = projected_mixed(spark, sf_dir).select(*POINT, "camera", "u", "v").withColumn("v", F.when(off, F.col("v") + 200).otherwise(F.col("v")))
    return check_v12(mv.triangulate(own, camera_rows(spark, True), POINT).withColumnRenamed("point", "animal").where("n_views >= 2"), 15.0)


@query()
def mv3_triangulate_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that some cameras lack, rounded to pixels."""
    seen = F.pmod(F.col("frame") + F.col("point"), F.lit(4)) != F.substring("camera", 2, 1).cast("int")
    own = views(spark, sf_dir).select(*POINT, "camera", *(F.when(seen, F.round(c)).alias(c) for c in "uv"))
    return rounded(mv.triangulate_gated(own, rig(spark), POINT, 1.0), 3)


@query()
def mv4_triangulate_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One view of every fifth point is 80 px off."""
    off = (F.col("point") % 5 == 0) & (F.col("camera") == "c1")
    own = views(spark, sf_dir).withColumn("u", F.when(off, F.col("u") + 80).otherwise(F.col("u")))
    return rounded(mv.triangulate(own, rig(spark), POINT, reject_px=15.0), 3)


_RING = "POINTS, ring AS (SELECT unnest(range(15)) AS c)".replace("POINTS", POINTS_SQL)


def _ring(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fifteen cameras around the points, and their views."""
    ring = spark.range(15).select(F.concat(F.lit("c"), F.col("id")).alias("camera"), ((F.col("id") - 7) * 0.2).alias("ry"))
    cams = ring.select("camera", *(c.alias(f"r{k}") for k, c in enumerate(g.rodrigues(F.lit(0.0), F.col("ry"), F.lit(0.0)))), F.lit(7.0).alias("tz"))
    lit, camera = F.lit, camera_columns()
    table = cams.select("camera", lit(300.0).alias("fx"), lit(310.0).alias("fy"), lit(128.0).alias("cx"), lit(96.0).alias("cy"), F.array(*camera.r).alias("rotation"), F.array(*camera.t).alias("translation"), F.array(*camera.k).alias("distortion"), camera.offset_x.alias("offset_x"), camera.offset_y.alias("offset_y"))
    points = mv.dealt(points3d(spark, sf_dir), *POINT)  # a file of few megabytes is one task, and fifteen views a point are not few
    return g.project(points.crossJoin(F.broadcast(cams)), camera).select(*POINT, "camera", "u", "v"), table


@query(f"WITH {_RING} SELECT 'view' AS what, group_id, frame, point % 5 AS animal, point, 'c1' AS camera FROM points WHERE point % 5 = 0 UNION ALL SELECT 'view', group_id, frame, point % 5, point, 'c9' FROM points WHERE point = 7 UNION ALL SELECT DISTINCT 'box', group_id, frame, 0, NULL::INTEGER, 'c1' FROM points")
def mv4_rejected_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera c1 is 40 px too low in all points of animal 0, and c9 in one point of animal 2: the views that go, and the box that is left empty."""
    seen, table = _ring(spark, sf_dir)
    off = ((F.col("point") % 5 == 0) & (F.col("camera") == "c1")) | ((F.col("point") == 7) & (F.col("camera") == "c9"))
    own = seen.withColumn("v", F.when(off, F.col("v") + 40).otherwise(F.col("v"))).withColumn("animal", F.col("point") % 5)
    found = mv.triangulate_rejecting(own, table, ["group_id", "frame", "animal", "point"], 15.0)
    animal = ["group_id", "frame", "animal"]
    boxes = own.select(*animal, "camera").distinct()
    views_gone = found.rejected.select(F.lit("view").alias("what"), *animal, "point", "camera")
    return views_gone.unionByName(mv.emptied_boxes(boxes, found, animal).select(F.lit("box").alias("what"), *animal, F.lit(None).cast("int").alias("point"), "camera"))


@query(ctes("truth") + ", v AS (SELECT group_id, frame, animal, bodypart, status, CASE WHEN frame % 31 = 4 THEN x + 1 ELSE x END AS x FROM truth), b AS (SELECT group_id, frame, animal, bodypart, status, x FROM truth) SELECT *, 'variant' AS side FROM (SELECT * FROM v EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'base' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM v)")
def mv5_check_variants_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fixture(spark, sf_dir, "truth").select("group_id", "frame", "animal", "bodypart", "status", "x")
    return mv.check_variants_equal(base.withColumn("x", F.when(F.col("frame") % 31 == 4, F.col("x") + 1).otherwise(F.col("x"))), base)


def point_dets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each projected point as a detection of 20 px."""
    own = projected(spark, sf_dir).where("u is not null").select("group_id", "frame", "camera", F.col("point").alias("det"), F.col("u").alias("cx"), F.col("v").alias("cy"))
    return own.withColumns({"x0": F.col("cx") - 10, "y0": F.col("cy") - 10, "x1": F.col("cx") + 10, "y1": F.col("cy") + 10})


@query()
def tk4_associate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mv.associate_frames(point_dets(spark, sf_dir), rig(spark), 2.0), 3)


def track_dets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks as detections of 40 px of one camera, numbered without regard to the animal."""
    own = fixture(spark, sf_dir, "track").select("group_id", "frame", F.lit("c0").alias("camera"), F.pmod(F.col("animal") + F.col("frame"), F.lit(6)).alias("det"), "x", "y")
    return own.select("group_id", "frame", "camera", "det", (F.col("x") - 20).alias("x0"), (F.col("y") - 20).alias("y0"), (F.col("x") + 20).alias("x1"), (F.col("y") + 20).alias("y1"))


@query()
def st1_link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.track(track_dets(spark, sf_dir), partial(tr.RowLinker, 6))


@query()
def st2_cross_view_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tr.track(point_dets(spark, sf_dir), partial(tr.CrossViewTracker, rig(spark), 24, 1.0, 24, 2.0)))


@query(ctes("track") + ", d AS (SELECT group_id, frame, CAST((animal + frame) % 6 AS INTEGER) AS det, x, y, row_number() OVER (PARTITION BY group_id, frame ORDER BY (animal + frame) % 6) AS row FROM track) SELECT group_id, frame, det, x, y, CAST(row AS INTEGER) AS row FROM d WHERE row <= 3")
def st3_associate_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One camera without a tracker: the row is the detection's rank."""
    from kinefold.operators.matching import rank_detections

    own = track_dets(spark, sf_dir).withColumn("score", F.lit(1.0))
    return rank_detections(own, 3).select("group_id", "frame", F.col("det").cast("int").alias("det"), (F.col("x0") + 20).alias("x"), (F.col("y0") + 20).alias("y"), F.col("rank").alias("row"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point_dets(spark, sf_dir).withColumn("score", F.lit(1.0) / (F.col("det") + 1))


@query()
def st3_associate_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cameras with the tracker; a detection's own centre and two corners are its points, and rows whose points lie in each other's boxes are one animal."""
    own = _scored(spark, sf_dir)
    spots = F.array(*(F.struct(F.lit(k).alias("bodypart"), (F.col("cx") + d).alias("x"), (F.col("cy") + d).alias("y")) for k, d in (("mid", 0), ("low", 9), ("high", -9))))
    points = own.select("group_id", "frame", "camera", "det", F.explode(spots).alias("p")).select("group_id", "frame", "camera", "det", "p.*")
    return rounded(associate_group(own, rig(spark), 24, max_res=2.0, points=points, overlap=0.8))


@query()
def st3_associate_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cameras, each frame on its own, then linked."""
    return rounded(associate_group(_scored(spark, sf_dir), rig(spark), 24, follow=False, link=True, max_res=2.0))


def moving_dets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Animals that stand still under a rig that goes along an axis: their detections in three cameras, numbered without regard to the animal, and the cameras' poses."""
    own = fixture(spark, sf_dir, "track").select("group_id", "animal", "frame", (F.col("animal") - 2.5).alias("x"), ((F.col("animal") - 2.5) / 2).alias("y"), F.lit(0.0).alias("z"))
    posed = own.crossJoin(F.broadcast(cameras(spark))).withColumn("tx", F.lit(0.1) + F.col("frame") % 50 * F.lit(0.01))
    camera = camera_columns()
    seen = g.project(posed, camera._replace(t=(F.col("tx"), *camera.t[1:])))
    boxes = {n: F.col(c) + d for n, c, d in (("x0", "u", -10), ("y0", "v", -10), ("x1", "u", 10), ("y1", "v", 10))}
    dets = seen.select("group_id", "frame", "camera", F.pmod(F.col("animal") + F.col("frame"), F.lit(6)).alias("det"), *(c.alias(n) for n, c in boxes.items()), (F.lit(1.0) / (F.col("animal") + 1)).alias("score"))
    # A frame's poses are those of its animals, so frames are made distinct, not poses.
    frames = fixture(spark, sf_dir, "track").select("group_id", "frame").distinct().crossJoin(F.broadcast(cameras(spark))).withColumn("tx", F.lit(0.1) + F.col("frame") % 50 * F.lit(0.01))
    poses = frames.select("group_id", "frame", "camera", F.array(*camera.r).alias("rotation"), F.array(F.col("tx"), *camera.t[1:]).alias("translation"))
    return dets, poses


def _by_animal(rows: DataFrame) -> DataFrame:
    """Which animal each row of moving_dets shows, and how many rows it has had."""
    animal = F.pmod(F.col("det") - F.col("frame"), F.lit(6)).alias("animal")
    return rows.groupBy("group_id", animal).agg(F.count("row").alias("n"), F.countDistinct("row").alias("n_rows"), F.count_if(F.col("row").isNull()).alias("n_late"))


def _moving_step() -> GroupStep:
    return GroupStep(6, several=True, max_res=2.0, max_age=10_000)


@query(ctes("track") + "SELECT group_id, animal, CAST(3 * count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_late FROM track GROUP BY 1, 2")
def st2_moving_rig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each animal keeps one row, though the cameras move."""
    dets, poses = moving_dets(spark, sf_dir)
    return _by_animal(tr.track(mv.with_lenses(dets, camera_rows(spark), poses), partial(tr.CrossViewTracker, None, 6, 1.0, 10_000, 2.0)))


@query(ctes("track") + "SELECT group_id, animal, CAST(3 * count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS n_rows, CAST(3 * count(*) FILTER (WHERE frame = 0) AS BIGINT) AS n_late FROM track GROUP BY 1, 2")
def st3_stream_moving_rig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of four files joined with the poses, and a fifth with frame 0 again, which is late."""
    # Written once: four files, the fifth, and every micro-batch's join with the poses read them again.
    dets, poses = (materialize(x, n) for x, n in zip(moving_dets(spark, sf_dir), ("dets", "poses"), strict=True))
    path = scratch(spark)
    last = dets.agg(F.max("frame").alias("last"))
    cut = dets.crossJoin(F.broadcast(last)).withColumn("part", F.floor(F.col("frame") * 4 / (F.col("last") + 1)))
    for k in range(4):
        cut.where(F.col("part") == k).select(*dets.columns).coalesce(1).write.mode("append").parquet(f"{path}/landing")
    dets.where("frame = 0").coalesce(1).write.mode("append").parquet(f"{path}/landing")
    stream = sw.frame_stream(spark, f"{path}/landing", dets.schema)
    sw.run_to_end(associate_stream(mv.with_lenses(stream, camera_rows(spark), poses), _moving_step), path)
    return _by_animal(spark.read.schema(tr.OUT).parquet(f"{path}/data"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of four files, a file a micro-batch."""
    own, landing = table(spark, sf_dir, "events"), f"{scratch(spark)}/landing"
    own.repartition(4, "event_id").write.parquet(landing)
    return sw.frame_stream(spark, landing, own.schema)


@query("SELECT event_id, user_id, value FROM events")
def st4_prediction_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sw.batches_to_table(_events(spark, sf_dir), path)
    return spark.read.parquet(f"{path}/data").select("event_id", "user_id", "value")


@query("WITH k AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h FROM events), w AS (SELECT unnest([h, h - 1]) AS h FROM k), g AS (SELECT h, count(*) AS n FROM w GROUP BY 1) SELECT h AS start_hour, CAST(n AS BIGINT) AS n FROM g")
def st5_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hour windows every hour; the end of the stream closes none, so the totals are read from a batch over the same function."""
    own = table(spark, sf_dir, "events")
    return sw.sliding(own, "ts", "2 hours", "1 hour", "365 days").select(F.floor(F.unix_timestamp(F.col("window.start").cast("timestamp")) / 3600).alias("start_hour"), "n")


@query("SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS start_hour, event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def st6_tumbling_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events")
    return rounded(sw.tumbling(own, "ts", "1 hour", "365 days", "event_type").select(F.floor(F.unix_timestamp(F.col("window.start").cast("timestamp")) / 3600).alias("start_hour"), "event_type", "n", "mean"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 86400 THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s FROM s GROUP BY user_id, k")
def st7_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events")
    return sw.sessions(own, "ts", "1 day", "365 days", "user_id").select("user_id", "n", F.unix_timestamp(F.col("session_window.start").cast("timestamp")).alias("start_s"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def st8_incremental_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sw.counters(_events(spark, sf_dir), path, "event_type")
    totals = spark.read.parquet(f"{path}/totals")
    last = totals.agg(F.max("batch").alias("batch"))
    return rounded(totals.join(F.broadcast(last), "batch", "left_semi").select("event_type", "n", "total"), 4)




def _closed(spark: SparkSession, sf_dir: str, key: str, size_ms: int, slide_ms: int | None = None, sessions: bool = False) -> DataFrame:
    """closing_windows over the events as a stream: four files in order of time, then one with every 50th event again."""
    own, path = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), scratch(spark)
    span = own.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    share = (F.unix_millis("ts") - F.unix_millis("first")) / (F.unix_millis("last") - F.unix_millis("first") + 1)
    cut = own.crossJoin(F.broadcast(span)).withColumn("part", F.floor(share * 4))
    for k in range(4):
        cut.where(F.col("part") == k).select(*own.columns).coalesce(1).write.mode("append").parquet(f"{path}/landing")
    own.where("event_id % 50 = 0").coalesce(1).write.mode("append").parquet(f"{path}/landing")
    stream = sw.frame_stream(spark, f"{path}/landing", own.schema)
    sw.run_to_end(sw.closing_windows(stream, "ts", key, "1 hour", size_ms, slide_ms, sessions=sessions), path)
    return spark.read.parquet(f"{path}/data")


_MARK = "e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events), m AS (SELECT max(ms) - 3600000 AS mark FROM e)"


def _closed_sql(key: str, size: int, slide: int) -> str:
    back = -(-size // slide)
    return f"WITH {_MARK}, w AS (SELECT event_id, {key}, value, (ms // {slide} - k) * {slide} AS start_ms FROM e, (SELECT unnest(range({back})) AS k)), c AS (SELECT * FROM w, m WHERE start_ms + {size} <= mark) SELECT 'window' AS what, {key}, CAST(start_ms AS BIGINT) AS start_ms, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM c GROUP BY 2, 3 UNION ALL SELECT 'late', {key}, CAST(start_ms AS BIGINT), CAST(count(*) AS BIGINT), round(sum(value), 4) FROM c WHERE event_id % 50 = 0 GROUP BY 2, 3"


def _told(rows: DataFrame, key: str) -> DataFrame:
    return rounded(rows.groupBy("what", key, "start_ms").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), 4)


@query(_closed_sql("event_type", 7_200_000, 3_600_000))
def st5_stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hour windows every hour, as the watermark closes them, and what came after that."""
    return _told(_closed(spark, sf_dir, "event_type", 7_200_000, 3_600_000), "event_type")


@query(_closed_sql("event_type", 3_600_000, 3_600_000))
def st6_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_closed(spark, sf_dir, "event_type", 3_600_000), "event_type")


@query(f"WITH {_MARK}, g AS (SELECT user_id, ms, value, CASE WHEN ms - lag(ms) OVER w < 86400000 THEN 0 ELSE 1 END AS cut FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS k FROM g), r AS (SELECT user_id, min(ms) AS start_ms, max(ms) AS last, count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, k) SELECT 'window' AS what, user_id, CAST(start_ms AS BIGINT) AS start_ms, CAST(n AS BIGINT) AS n, round(total, 4) AS total FROM r, m WHERE last + 86400000 <= mark UNION ALL SELECT 'late', user_id, CAST(ms AS BIGINT), CAST(count(*) AS BIGINT), round(sum(value), 4) FROM e, m WHERE event_id % 50 = 0 AND ms + 86400000 <= mark GROUP BY 2, 3")
def st7_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without a day's gap."""
    return _told(_closed(spark, sf_dir, "user_id", 86_400_000, sessions=True), "user_id")
