"""Queries of the joins and the frame windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefold.functions.random import draw_sql
from kinefold.operators import frames as w
from kinefold.operators import joins as j
from kinefold.plans.fixtures import ctes, fixture, table
from kinefold.plans.q_geometry import r
from kinefold.plans.registry import query

POINT = "group_id, frame, animal, bodypart"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions under the name of the row that they fill."""
    return fixture(spark, sf_dir, "pred").withColumnRenamed("pred", "animal")


@query(ctes("pred", "truth") + f"SELECT {POINT}, p.px, p.py, t.x, t.y, t.status FROM (SELECT group_id, frame, pred AS animal, bodypart, x AS px, y AS py FROM pred) p FULL JOIN truth t USING ({POINT})")
def jn1_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = predictions(spark, sf_dir).select(*j.POINT, F.col("x").alias("px"), F.col("y").alias("py"))
    return j.align(pred, fixture(spark, sf_dir, "truth")).select(*j.POINT, "px", "py", "x", "y", "status")


@query(ctes("truth", "part4") + "SELECT CAST(kpt_id AS INTEGER) AS kpt_id, CAST(count(*) AS BIGINT) AS n FROM truth JOIN (SELECT bodypart, row_number() OVER (ORDER BY bodypart) - 1 AS kpt_id FROM part4) USING (bodypart) GROUP BY 1")
def jn2_resolve_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    registry = fixture(spark, sf_dir, "part4").select("bodypart", (F.row_number().over(Window.orderBy("bodypart")) - 1).alias("kpt_id"))
    known, _ = j.resolve_axis(fixture(spark, sf_dir, "truth"), registry)
    return known.groupBy("kpt_id").agg(F.count(F.lit(1)).alias("n"))


PAIR_COST = "pairs AS (SELECT p.group_id, p.frame, p.pred AS i, t.animal AS j, avg(sqrt(pow(p.x - t.x, 2) + pow(p.y - t.y, 2))) AS cost, count(*) AS shared FROM pred p JOIN truth t ON p.group_id = t.group_id AND p.frame = t.frame AND p.bodypart = t.bodypart WHERE p.x IS NOT NULL AND t.x IS NOT NULL GROUP BY 1, 2, 3, 4)"


@query(ctes("pred", "truth") + f", {PAIR_COST} SELECT group_id, frame, i, j, round(cost, 6) AS cost, CAST(shared AS BIGINT) AS shared FROM pairs WHERE shared >= 2")
def jn3_frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.frame_pairs(fixture(spark, sf_dir, "pred"), fixture(spark, sf_dir, "truth"), 4, min_frac=0.5).withColumn("cost", r("cost"))


@query(ctes("pred", "insts") + ", c AS (SELECT group_id, frame, pred, avg(x) AS x, avg(y) AS y FROM pred WHERE x IS NOT NULL GROUP BY 1, 2, 3) SELECT group_id, frame, pred FROM c WHERE EXISTS (SELECT 1 FROM insts b WHERE b.status = 'present' AND b.group_id = c.group_id AND b.frame = c.frame AND c.x BETWEEN b.x0 AND b.x1 AND c.y BETWEEN b.y0 AND b.y1)")
def jn4_points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = j.centroids(fixture(spark, sf_dir, "pred"), "group_id", "frame", "pred")
    return j.points_in_boxes(c, fixture(spark, sf_dir, "insts").where("status = 'present'")).select("group_id", "frame", "pred")


_GRID = "grid AS (SELECT group_id, frame, camera, gx * 3 + gy AS point, 20 + gx * 40.0::DOUBLE AS x, 25 + gy * 35.0::DOUBLE AS y FROM (SELECT DISTINCT group_id, frame, camera FROM det), (SELECT unnest(range(5)) AS gx), (SELECT unnest(range(3)) AS gy))"


def _grid(views: DataFrame) -> DataFrame:
    """Fifteen points in each view."""
    points = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: F.struct(k.alias("point"), (F.lit(20.0) + F.floor(k / 3) * 40.0).alias("x"), (F.lit(25.0) + (k % 3) * 35.0).alias("y")))
    return views.withColumn("p", F.explode(points)).select(*views.columns, "p.*")


@query(ctes("det", "regions") + f", {_GRID} SELECT group_id, frame, camera, CAST(point AS INTEGER) AS point FROM grid c WHERE EXISTS (SELECT 1 FROM regions b WHERE b.group_id = c.group_id AND b.frame = c.frame AND b.camera = c.camera AND c.x > b.x0 AND c.x < b.x1 AND c.y > b.y0 AND c.y < b.y1) OR EXISTS (SELECT 1 FROM det b WHERE b.group_id = c.group_id AND b.frame = c.frame AND b.camera = c.camera AND c.x > b.x0 AND c.x < b.x1 AND c.y > b.y0 AND c.y < b.y1)")
def jn5_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = fixture(spark, sf_dir, "det")
    grid = _grid(det.select("group_id", "frame", "camera").distinct())
    return j.certified(grid, fixture(spark, sf_dir, "regions"), det).select("group_id", "frame", "camera", "point")


@query(ctes("truth", "regions") + ", c AS (SELECT group_id, frame, animal, concat('c', CAST(animal % 2 AS STRING)) AS camera, avg(x) AS x, avg(y) AS y FROM truth WHERE x IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT group_id, frame, animal FROM c WHERE EXISTS (SELECT 1 FROM regions b WHERE b.group_id = c.group_id AND b.frame = c.frame AND b.camera = c.camera AND c.x > b.x0 AND c.x < b.x1 AND c.y > b.y0 AND c.y < b.y1)")
def jn6_certified_animals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By centroid, never by overlap."""
    c = j.centroids(fixture(spark, sf_dir, "truth"), "group_id", "frame", "animal").withColumn("camera", F.concat(F.lit("c"), F.col("animal") % 2))
    return j.points_in_boxes(c, fixture(spark, sf_dir, "regions"), ["group_id", "frame", "camera"], strict=True).select("group_id", "frame", "animal")


@query(ctes("det") + f", {_GRID}, g AS (SELECT DISTINCT group_id, frame, point, x, y FROM grid), near AS (SELECT g.group_id, g.frame, g.point, d.det, pow(g.x - (d.x0 + d.x1) / 2, 2) + pow(g.y - (d.y0 + d.y1) / 2, 2) AS d2 FROM g JOIN det d ON g.group_id = d.group_id AND g.frame = d.frame WHERE g.x > d.x0 AND g.x < d.x1 AND g.y > d.y0 AND g.y < d.y1 AND abs(g.x - (d.x0 + d.x1) / 2) < 20 AND abs(g.y - (d.y0 + d.y1) / 2) < 20), capped AS (SELECT *, row_number() OVER (PARTITION BY group_id, frame, det ORDER BY d2, point) AS k FROM near), best AS (SELECT *, row_number() OVER (PARTITION BY group_id, frame, point ORDER BY d2, det) AS m FROM capped WHERE k <= 2) SELECT group_id, frame, CAST(point AS INTEGER) AS point, det AS box, d2 FROM best WHERE m = 1")
def jn7_assign_points_to_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = fixture(spark, sf_dir, "det")
    grid = _grid(det.select("group_id", "frame").distinct())
    return j.assign_points_to_boxes(grid, det.select("group_id", "frame", F.col("det").alias("box"), "x0", "y0", "x1", "y1"), stride=8.0, top_k=2)


@query(ctes("det") + "SELECT a.group_id, a.frame, a.camera AS camera_a, a.det AS det_a, b.camera AS camera_b, b.det AS det_b FROM det a JOIN det b ON a.group_id = b.group_id AND a.frame = b.frame AND a.camera < b.camera")
def jn8_cross_camera_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.cross_camera_pairs(fixture(spark, sf_dir, "det"))


@query(ctes("det", "inst") + ", ext AS (SELECT group_id, frame, min(sk) % 50 AS tx FROM inst WHERE animal > 1 GROUP BY 1, 2) SELECT group_id, frame, camera, det, CAST(coalesce(tx, 0) AS BIGINT) AS tx, tx IS NULL AS static FROM det LEFT JOIN ext USING (group_id, frame)")
def jn9_with_extrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "inst").where("animal > 1").groupBy("group_id", "frame").agg((F.min("sk") % 50).alias("tx"))
    return fixture(spark, sf_dir, "det").join(own, ["group_id", "frame"], "left").select("group_id", "frame", "camera", "det", F.coalesce("tx", F.lit(0)).cast("long").alias("tx"), F.col("tx").isNull().alias("static"))


_WINDOWS = "wins AS (SELECT group_id, animal, CAST(floor(frame / 12.0) AS INTEGER) AS win, CAST(floor(frame / 12.0) * 12 AS INTEGER) AS start, 16 AS length, min(disc) > 2 AS predicted FROM inst GROUP BY 1, 2, 3, 4)"


@query(ctes("inst") + f", {_WINDOWS}, o AS (SELECT *, max(CASE WHEN predicted THEN win END) OVER (PARTITION BY group_id, animal ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM wins) SELECT group_id, animal, win, start, CAST(CASE WHEN start - (last * 12 + 12) >= 0 AND last * 12 + 16 > start THEN last * 12 + 12 END AS INTEGER) AS prior_frame FROM o")
def jn10_carry_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = F.floor(F.col("frame") / 12).cast("int")
    windows = fixture(spark, sf_dir, "inst").groupBy("group_id", "animal", win.alias("win")).agg((F.min("disc") > 2).alias("predicted")).withColumn("start", F.col("win") * 12).withColumn("length", F.lit(16))
    return j.carry_prior(windows, 4).select("group_id", "animal", "win", "start", "prior_frame")


@query(ctes("truth") + ", u AS (SELECT * FROM (SELECT *, count(x) OVER (PARTITION BY group_id, frame, animal) AS usable FROM truth) WHERE usable >= 2), p AS (SELECT a.group_id, a.frame, a.animal, b.animal AS neighbour, avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS dist FROM truth a JOIN u b ON a.group_id = b.group_id AND a.frame = b.frame AND a.bodypart = b.bodypart AND a.animal <> b.animal WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2, 3, 4), q AS (SELECT *, row_number() OVER (PARTITION BY group_id, frame, animal ORDER BY round(dist, 9), neighbour) AS k FROM p) SELECT group_id, frame, animal, neighbour, round(dist, 6) AS dist FROM q WHERE k = 1")
def jn11_nearest_neighbour_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.nearest_neighbour_row(fixture(spark, sf_dir, "truth")).withColumn("dist", r("dist"))


_ARMS = f"arms AS (SELECT t.group_id, t.frame, t.animal, t.bodypart, t.x, t.y, a.x AS ax, a.y AS ay, a.x + a.logit AS bxx, a.y AS byy FROM truth t JOIN (SELECT group_id, frame, pred AS animal, bodypart, x, y, logit FROM pred) a USING ({POINT}) WHERE t.x IS NOT NULL AND a.logit > -0.5)"


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms: the predictions, and the confident ones moved by their logit."""
    pred = predictions(spark, sf_dir)
    a = pred.select(*j.POINT, F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = pred.where("logit > -0.5").select(*j.POINT, (F.col("x") + F.col("logit")).alias("bx"), F.col("y").alias("by"))
    return j.shared_points(a, b, fixture(spark, sf_dir, "truth"))


@query(ctes("pred", "truth") + f", {_ARMS} SELECT group_id, CAST(count(*) AS BIGINT) AS n, round(avg(sqrt(pow(ax - x, 2) + pow(ay - y, 2))), 6) AS err_a, round(avg(sqrt(pow(bxx - x, 2) + pow(byy - y, 2))), 6) AS err_b FROM arms GROUP BY 1")
def jn12_shared_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda x, y: j.distance(F.col(x), F.col(y), F.col("x"), F.col("y"))
    return arms(spark, sf_dir).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), r(F.avg(d("ax", "ay"))).alias("err_a"), r(F.avg(d("bx", "by"))).alias("err_b"))


@query(ctes("truth") + ", v AS (SELECT concat(group_id, '_', CAST(animal AS STRING)) AS group_id, frame, animal, bodypart, CASE WHEN animal > 4 AND frame % 50 = 3 THEN x + 1 ELSE x END AS x, x AS bx, y FROM truth), f AS (SELECT group_id, frame, bool_and(x IS NOT DISTINCT FROM bx) AS same FROM v GROUP BY 1, 2) SELECT group_id, bool_and(same) AS carried, CAST(count(*) FILTER (WHERE NOT same) AS BIGINT) AS diverged FROM f GROUP BY 1")
def jn13_carry_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fixture(spark, sf_dir, "truth").withColumn("group_id", F.concat_ws("_", "group_id", "animal"))
    return j.carry_solved(base.withColumn("x", F.when(F.expr("animal > 4 and frame % 50 = 3"), F.col("x") + 1).otherwise(F.col("x"))), base)


@query(ctes("det") + ", cand AS (SELECT DISTINCT group_id, frame, camera, CAST((frame * 13) % 120 AS DOUBLE) AS x0, CAST((frame * 17) % 90 AS DOUBLE) AS y0 FROM det) SELECT group_id, frame, camera, x0 AS c_x0, y0 AS c_y0 FROM cand c WHERE NOT EXISTS (SELECT 1 FROM det d WHERE d.group_id = c.group_id AND d.frame = c.frame AND d.camera = c.camera AND sqrt(pow(c.x0 + 16 - (d.x0 + d.x1) / 2, 2) + pow(c.y0 + 16 - (d.y0 + d.y1) / 2, 2)) / ((32 + (d.x1 - d.x0 + d.y1 - d.y0) / 2) / 2) < 2.5)")
def jn14_min_margin_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = fixture(spark, sf_dir, "det")
    x, y = ((F.col("frame") * 13) % 120).cast("double"), ((F.col("frame") * 17) % 90).cast("double")
    candidates = det.select("group_id", "frame", "camera").distinct().withColumns({"c_x0": x, "c_y0": y, "c_x1": x + 32, "c_y1": y + 32})
    return j.min_margin_filter(candidates, det).select("group_id", "frame", "camera", "c_x0", "c_y0")


@query(ctes("truth", "regions") + f"SELECT {POINT}, EXISTS (SELECT 1 FROM regions b WHERE b.group_id = t.group_id AND b.frame = t.frame AND t.x >= b.x0 AND t.x < b.x1 AND t.y >= b.y0 AND t.y < b.y1) AS covered FROM truth t")
def jn15_rects_cover_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.rects_cover_points(fixture(spark, sf_dir, "truth"), fixture(spark, sf_dir, "regions")).select(*j.POINT, "covered")


@query(ctes("truth", "pred") + f", kp AS (SELECT group_id, frame, animal, bodypart, 'visible' AS status, CASE WHEN status = 'visible' THEN x END AS x FROM truth) SELECT {POINT} FROM kp WHERE x IS NULL AND NOT EXISTS (SELECT 1 FROM pred p WHERE p.group_id = kp.group_id AND p.frame = kp.frame AND p.pred = kp.animal AND p.bodypart = kp.bodypart)")
def jn16_visibility_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without coordinates, all said to be visible; the predictions stand for 3D points."""
    bare = fixture(spark, sf_dir, "truth").select(*j.POINT, F.lit("visible").alias("status"), F.when(F.col("status") == "visible", F.col("x")).alias("x"), "y")
    return j.visibility_observation(bare, predictions(spark, sf_dir)).select(*j.POINT)


# Frame windows


@query(ctes("track") + "SELECT group_id, animal, frame, round(CASE WHEN frame - lag(frame) OVER w = 1 THEN sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) END, 6) AS step FROM track WINDOW w AS (PARTITION BY group_id, animal ORDER BY frame)")
def wn1_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.steps(fixture(spark, sf_dir, "track"), "group_id", "animal").select("group_id", "animal", "frame", r("step").alias("step"))


_BEST = f"{PAIR_COST}, ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id, frame, j ORDER BY round(cost, 9), i) AS k FROM pairs)"


@query(ctes("pred", "truth") + f", {_BEST}, l AS (SELECT group_id, frame, i, j, lag(i) OVER (PARTITION BY group_id, j ORDER BY frame) AS last FROM ranked WHERE k = 1) SELECT group_id, frame, i, j, coalesce(last <> i, false) AS switched FROM l")
def wn2_id_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over each label's nearest prediction."""
    pairs = j.frame_pairs(fixture(spark, sf_dir, "pred"), fixture(spark, sf_dir, "truth"), 4)
    nearest = pairs.groupBy("group_id", "frame", "j").agg(F.min_by("i", F.struct(F.round("cost", 9), "i")).alias("i"))
    return w.id_switches(nearest).select("group_id", "frame", "i", "j", "switched")


_STARTS = "starts AS (SELECT group_id, n_frames, unnest(CASE WHEN n_frames <= 32 THEN [0] ELSE list_distinct(list_concat(range(0, n_frames - 31, 24), [n_frames - 32])) END) AS start FROM sess)"


@query(ctes("sess") + f", {_STARTS} SELECT group_id, CAST(start AS INTEGER) AS start FROM starts")
def wn3_window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "sess").select("group_id", F.explode(w.window_starts(F.col("n_frames"), 32, 8)).alias("start"))


@query(ctes("truth", "sess") + ", span AS (SELECT group_id, animal, min(frame) AS lo, max(frame) AS hi, any_value(n_frames) AS n FROM truth JOIN sess USING (group_id) WHERE status = 'visible' GROUP BY 1, 2), f AS (SELECT *, greatest(n - 24, 0) AS top, least(greatest(lo - 12, 0), greatest(n - 24, 0)) AS first FROM span) SELECT DISTINCT group_id, animal, CAST(least(s, top) AS INTEGER) AS start FROM (SELECT *, unnest(range(first, greatest(hi, first) + 1, 20)) AS s FROM f)")
def wn4_eval_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.eval_windows(fixture(spark, sf_dir, "truth").where("status = 'visible'"), fixture(spark, sf_dir, "sess").select("group_id", "n_frames"), 24, 20)


_TRACK = ("CAST(substr(group_id, 2) AS BIGINT)", "CAST(animal AS BIGINT)")


@query(
    ctes("truth", "sess")
    + f", f AS (SELECT group_id, animal, list_sort(list(DISTINCT frame)) AS frames FROM truth WHERE status = 'visible' GROUP BY 1, 2), d AS (SELECT *, CAST(floor({draw_sql(5, *_TRACK)} * 3) + 1 AS INTEGER) AS stride, frames[CAST(floor({draw_sql(6, *_TRACK)} * len(frames)) + 1 AS BIGINT)] AS anchor, {draw_sql(7, *_TRACK)} AS u FROM f), "
    "l AS (SELECT *, list_filter(frames, lambda f: abs(f - anchor) % stride = 0 AND abs(f - anchor) < 16 * stride) AS lattice FROM d), s AS (SELECT *, list_min(lattice) AS lo, (list_max(lattice) - list_min(lattice)) // stride + 1 AS span FROM l), z AS (SELECT *, CAST(least(greatest(span + span % 2, 2), 16) AS INTEGER) AS size FROM s), "
    "b AS (SELECT *, (anchor - greatest(anchor - (size - 1) * stride, lo - (size - 1) * stride)) // stride AS slots FROM z) "
    "SELECT group_id, animal, stride, anchor, size, CAST(anchor - CAST(floor(u * (slots + 1)) AS INTEGER) * stride AS INTEGER) AS start, n_frames FROM b JOIN sess USING (group_id)"
)
def wn5_train_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.train_window(fixture(spark, sf_dir, "truth").where("status = 'visible'"), fixture(spark, sf_dir, "sess").select("group_id", "n_frames"), 16, 3, 5)


_RUNS = "cuts AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY group_id, animal ORDER BY frame) > 2 THEN 1 ELSE 0 END AS cut FROM track), runs AS (SELECT *, sum(cut) OVER (PARTITION BY group_id, animal ORDER BY frame) AS run FROM cuts)"


@query(ctes("track") + f", {_RUNS} SELECT group_id, animal, frame, lpad(CAST(min(frame) OVER (PARTITION BY group_id, animal, run) AS VARCHAR), 6, '0') AS run_id FROM runs")
def wn6_gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.gap_runs(fixture(spark, sf_dir, "track"), 2, "group_id", "animal").select("group_id", "animal", "frame", "run_id")


@query(ctes("truth", "sess") + "SELECT DISTINCT group_id, frame, CAST(greatest(least(frame - 10, n_frames - least(21, n_frames)), 0) AS INTEGER) AS start, CAST(least(21, n_frames) AS INTEGER) AS length FROM truth JOIN sess USING (group_id)")
def wn7_centred_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, length = w.centred_window(F.col("frame"), F.col("n_frames"), 10)
    frames = fixture(spark, sf_dir, "truth").select("group_id", "frame").distinct().join(fixture(spark, sf_dir, "sess"), "group_id")
    return frames.select("group_id", "frame", start.cast("int").alias("start"), length.cast("int").alias("length"))


@query(ctes("inst", "sess") + f", {_STARTS}, f AS (SELECT i.group_id, i.frame, i.animal, max(s.start) AS start FROM inst i JOIN starts s ON i.group_id = s.group_id AND i.frame >= s.start AND i.frame < s.start + 32 GROUP BY 1, 2, 3) SELECT group_id, frame, animal, CAST(start AS INTEGER) AS win FROM f")
def wn8_last_window_owns(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = fixture(spark, sf_dir, "sess").select("group_id", F.explode(w.window_starts(F.col("n_frames"), 32, 8)).alias("win"))
    # A few rows become every frame of the clips, which the planner cannot foresee: they are dealt before, and merged.
    covered = starts.repartition("group_id", "win").select("group_id", "win", F.explode(F.sequence(F.col("win"), F.col("win") + 31)).alias("frame")).hint("merge")
    rows = fixture(spark, sf_dir, "inst").select("group_id", "frame", "animal").join(covered, ["group_id", "frame"])
    return w.last_window_owns(rows, "group_id", "frame", "animal").select("group_id", "frame", "animal", "win")


@query(ctes("truth") + f", d AS (SELECT DISTINCT group_id, frame FROM truth), k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {draw_sql(9, 'CAST(substr(group_id, 2) AS BIGINT)', 'CAST(frame AS BIGINT)')}, frame) AS k FROM d) SELECT group_id, frame FROM k WHERE k <= 50")
def wn9_cap_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.cap_frames(fixture(spark, sf_dir, "truth").select("group_id", "frame").distinct(), 50, 9)


@query(ctes("truth") + ", d AS (SELECT DISTINCT group_id, frame FROM truth), k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY frame) - 1 AS r, count(*) OVER (PARTITION BY group_id) AS m FROM d) SELECT group_id, frame FROM k WHERE m <= 40 OR r IN (SELECT floor(i * (m - 1) / 39.0) FROM range(40) t(i))")
def wn10_spread_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.spread_frames(fixture(spark, sf_dir, "truth").select("group_id", "frame").distinct(), 40)


@query(ctes("truth") + "SELECT group_id, animal, bodypart, CAST(floor(frame / 16.0) AS INTEGER) AS win, coalesce(min(CASE WHEN x IS NOT NULL THEN frame END), 0) AS first_frame, arg_min(x, CASE WHEN x IS NOT NULL THEN frame END) AS x, arg_min(y, CASE WHEN x IS NOT NULL THEN frame END) AS y FROM truth GROUP BY 1, 2, 3, 4")
def wn11_first_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.first_labelled(fixture(spark, sf_dir, "truth").withColumn("win", F.floor(F.col("frame") / 16).cast("int")), "group_id", "animal", "bodypart", "win")


@query(
    ctes("track")
    + ", own AS (SELECT group_id, frame, avg(x) AS x, avg(y) AS y FROM track GROUP BY 1, 2), span AS (SELECT group_id, unnest(range(min(frame), max(frame) + 1)) AS frame FROM own GROUP BY 1), c AS (SELECT span.group_id, CAST(span.frame AS INTEGER) AS frame, x, y, CASE WHEN x IS NOT NULL THEN span.frame END AS f FROM span LEFT JOIN own USING (group_id, frame)), "
    "n AS (SELECT *, last_value(f IGNORE NULLS) OVER b AS fa, last_value(x IGNORE NULLS) OVER b AS xa, last_value(y IGNORE NULLS) OVER b AS ya, first_value(f IGNORE NULLS) OVER a AS fb, first_value(x IGNORE NULLS) OVER a AS xb, first_value(y IGNORE NULLS) OVER a AS yb FROM c WINDOW b AS (PARTITION BY group_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY group_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), "
    "p AS (SELECT group_id, frame, xa + (frame - fa)::DOUBLE / greatest(fb - fa, 1) * (xb - xa) AS x, ya + (frame - fa)::DOUBLE / greatest(fb - fa, 1) * (yb - ya) AS y FROM n), "
    "w AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY frame) AS r, count(*) OVER g AS n, first_value(x) OVER h AS x1, last_value(x) OVER h AS xn, first_value(y) OVER h AS y1, last_value(y) OVER h AS yn, sum(x) OVER m AS sx, sum(y) OVER m AS sy FROM p WINDOW g AS (PARTITION BY group_id), h AS (PARTITION BY group_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), m AS (PARTITION BY group_id ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)), "
    "k AS (SELECT *, greatest(8 - r, 0) AS head, greatest(r + 7 - n, 0) AS tail FROM w) "
    "SELECT group_id, frame, CAST(floor(round(greatest(least((sx + head * x1 + tail * xn) / 15 - 24, 208), 0), 6)) AS INTEGER) AS x0, CAST(floor(round(greatest(least((sy + head * y1 + tail * yn) / 15 - 24, 144), 0), 6)) AS INTEGER) AS y0 FROM k"
)
def wn12_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window that follows the mean of a clip's tracks; frames without a row are interpolated."""
    events = table(spark, sf_dir, "events")
    # Tracks, means and windows share one shuffle of the events by their clip.
    dealt = events.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.expr("concat('t', CAST(CAST(floor(user_id / 6.0) AS INT) AS STRING))"))
    own = fixture(spark, sf_dir, "track", events=dealt).groupBy("group_id", "frame").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return w.follow(own, 48, 256, 192)


@query(ctes("track") + ", d AS (SELECT group_id, animal, CAST(floor(frame / 16.0) AS INTEGER) AS win, frame - lag(frame) OVER (PARTITION BY group_id, animal, floor(frame / 16.0) ORDER BY frame) AS d FROM track) SELECT group_id, animal, win, greatest(coalesce(quantile_cont(d, 0.5), 1.0::DOUBLE), 1.0::DOUBLE) AS stride FROM d GROUP BY 1, 2, 3")
def wn13_window_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.window_stride(fixture(spark, sf_dir, "track").withColumn("win", F.floor(F.col("frame") / 16).cast("int")), "group_id", "animal", "win")


@query(ctes("truth") + f", s AS (SELECT *, coalesce(lead(CASE WHEN x IS NULL THEN -999 ELSE x END, 3) OVER o, last_value(CASE WHEN x IS NULL THEN -999 ELSE x END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS lx FROM truth WINDOW o AS (PARTITION BY group_id, animal, bodypart ORDER BY frame)) SELECT {POINT}, CASE WHEN x IS NOT NULL AND lx <> -999 THEN lx END AS stale_x FROM s")
def wn14_stale_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.stale_prior(fixture(spark, sf_dir, "truth"), 3, "group_id", "animal", "bodypart").select(*j.POINT, "stale_x")
