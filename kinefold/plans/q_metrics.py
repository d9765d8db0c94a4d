"""Queries of the evaluation and matching operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefold.functions.geometry import Box
from kinefold.functions.random import draw_sql
from kinefold.functions.status import visibility_target
from kinefold.operators import joins as j
from kinefold.operators import matching as k
from kinefold.operators import metrics as m
from kinefold.plans.fixtures import bucketed, ctes, fixture, table
from kinefold.plans.q_geometry import PROJECTED_SQL, _crop_sql, crops, projected, r
from kinefold.plans.q_joins import _ARMS, PAIR_COST, arms, predictions
from kinefold.plans.registry import query
from kinefold.sources.tables import materialize

_KEY = "group_id, frame, animal, bodypart"
_ALIGNED = f"al AS (SELECT {_KEY}, p.px, p.py, p.logit, t.x, t.y, t.status, sqrt(pow(p.px - t.x, 2) + pow(p.py - t.y, 2)) AS d FROM (SELECT group_id, frame, pred AS animal, bodypart, x AS px, y AS py, logit FROM pred) p FULL JOIN truth t USING ({_KEY}))"


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = predictions(spark, sf_dir).select(*j.POINT, F.col("x").alias("px"), F.col("y").alias("py"), "logit")
    return j.align(pred, fixture(spark, sf_dir, "truth"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_ERRORS = "round(avg(d), 6) AS err, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75), 6) AS p75, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.95), 6) AS p95, round(quantile_cont(d, 0.99), 6) AS p99, CAST(count(x) AS BIGINT) AS n_true, CAST(count(d) AS BIGINT) AS n_matched, round(count(d)::DOUBLE / nullif(count(x), 0), 6) AS coverage"


@query(ctes("pred", "truth") + f", {_ALIGNED} SELECT group_id, {_ERRORS} FROM al GROUP BY 1")
def ag1_error_and_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.error_and_coverage(aligned(spark, sf_dir), "group_id"))


@query(ctes("pred", "truth") + f", {_ALIGNED} SELECT bodypart, round(quantile_cont(d, 0.75), 6) AS p75, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.95), 6) AS p95, round(quantile_cont(d, 0.99), 6) AS p99 FROM al GROUP BY 1")
def ag2_err_pcts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.error_quantiles(aligned(spark, sf_dir), "bodypart"))


@query(ctes("pred", "truth") + f", {_ALIGNED} SELECT group_id, t AS threshold, round(count(*) FILTER (WHERE d <= t)::DOUBLE / count(*), 6) AS pck FROM al, (SELECT unnest([5.0::DOUBLE, 10.0::DOUBLE, 20.0::DOUBLE]) AS t) WHERE x IS NOT NULL GROUP BY 1, 2")
def ag3_pck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.pck(aligned(spark, sf_dir), [5.0, 10.0, 20.0], "group_id"))


_BOOT = f"boot AS (SELECT r, avg(v) AS m FROM (SELECT r, k, CAST(floor({draw_sql(4, 'r', 'k')} * (SELECT count(*) FROM vals)) AS BIGINT) AS ix FROM range(400) a(r), range((SELECT count(*) FROM vals)) b(k)) JOIN (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS ix FROM vals) USING (ix) GROUP BY 1)"
_INTERVAL = "SELECT round((SELECT avg(v) FROM vals), 6) AS mean, CAST((SELECT count(*) FROM vals) AS BIGINT) AS n, CAST((SELECT count(*) FROM units WHERE v IS NULL) AS BIGINT) AS n_dropped, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM boot"


@query(ctes("pred", "truth") + f", {_ALIGNED}, units AS (SELECT group_id || '/' || CAST(animal AS VARCHAR) AS unit, avg(d) AS v FROM al GROUP BY 1), vals AS (SELECT * FROM units WHERE v IS NOT NULL), {_BOOT} {_INTERVAL}")
def ag4_paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = j.distance(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
    units = aligned(spark, sf_dir).groupBy(F.concat_ws("/", "group_id", "animal").alias("unit")).agg(F.avg(d).alias("a"))
    return rounded(m.paired_bootstrap(units, 400, 4))


@query(ctes("track") + ", p AS (SELECT *, x + frame % 3 AS px, y - frame % 2 AS py FROM track), s AS (SELECT group_id, frame - lag(frame) OVER w AS gap, sqrt(pow(px - lag(px) OVER w, 2) + pow(py - lag(py) OVER w, 2)) AS dp, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS dr FROM p WINDOW w AS (PARTITION BY group_id, animal ORDER BY frame)) SELECT group_id, round(sum(dp), 6) AS pred_path, round(sum(dr), 6) AS ref_path, CAST(count(*) AS BIGINT) AS n_steps, round(sum(dp) / nullif(sum(dr), 0), 6) AS ratio FROM s WHERE gap = 1 GROUP BY 1")
def ag5_motion_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "track").withColumns({"bodypart": F.lit("centre"), "px": F.col("x") + F.col("frame") % 3, "py": F.col("y") - F.col("frame") % 2})
    return rounded(m.motion_ratio(own, "group_id"))


@contextmanager
def buckets_meet(spark: SparkSession) -> Iterator[None]:
    """Joins over tables dealt by clip and bucket of frames need no other shuffle; what is written inside is so, and the session's setting is put back."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "false")
        yield
    finally:
        spark.conf.set(name, before)


def matches(pred: DataFrame, true: DataFrame, max_dist: float = 40.0) -> DataFrame:
    return k.hungarian_match(j.frame_pairs(pred, true, 4, bucketed=True), max_dist)


@query()
def ag6_mota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts, a row a clip, are written while the session lets joins use the buckets."""
    with buckets_meet(spark):
        pred, true, insts = (bucketed(spark, sf_dir, x) for x in ("pred", "truth", "insts"))
        return materialize(rounded(m.mota(matches(pred, true), pred, true, insts.where("status = 'present'"), 40.0, "group_id")), "counts")


@query()
def ag7_matched_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors, a row a clip, are written while the session lets joins use the buckets."""
    with buckets_meet(spark):
        pred, true = (bucketed(spark, sf_dir, x) for x in ("pred", "truth"))
        return materialize(rounded(m.matched_error(matches(pred, true), pred, true, "group_id")), "errors")


@query(ctes("truth") + ", b AS (SELECT group_id, frame, animal, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS d FROM truth WHERE x IS NOT NULL GROUP BY 1, 2, 3) SELECT group_id, round(CASE WHEN quantile_cont(d, 0.5) > 0 THEN quantile_cont(d, 0.5) ELSE 'Infinity'::DOUBLE END, 6) AS radius FROM b GROUP BY 1")
def ag8_match_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.match_radius(fixture(spark, sf_dir, "truth"), "group_id"))


@query(ctes("pred", "truth") + f", {_ALIGNED} SELECT group_id, round(count(*) FILTER (WHERE coalesce(logit > 0, false) AND status = 'visible')::DOUBLE / nullif(count(*) FILTER (WHERE coalesce(logit > 0, false)), 0), 6) AS precision, round(count(*) FILTER (WHERE coalesce(logit > 0, false) AND status = 'visible')::DOUBLE / nullif(count(*) FILTER (WHERE status = 'visible'), 0), 6) AS recall, round(count(*) FILTER (WHERE status = 'visible')::DOUBLE / count(*), 6) AS base FROM al WHERE status IN ('visible', 'missing') GROUP BY 1")
def ag9_vis_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.vis_confusion(aligned(spark, sf_dir), "group_id"))


_AGREE = ", pose AS (SELECT group_id, frame, animal, avg(x) AS mx, avg(y) AS my FROM truth WHERE x IS NOT NULL GROUP BY 1, 2, 3), agree AS (SELECT group_id, sqrt(pow(mx - (x0 + x1) / 2.0::DOUBLE, 2) + pow(my - (y0 + y1) / 2.0::DOUBLE, 2)) / ((x1 - x0 + y1 - y0) / 2.0::DOUBLE) AS a FROM crop JOIN pose USING (group_id, frame, animal))"


@query(_crop_sql() + _AGREE + " SELECT group_id, round(quantile_cont(a, 0.5), 6) AS median, round(quantile_cont(a, 0.99), 6) AS p99 FROM agree GROUP BY 1")
def ag10_agreement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pose = fixture(spark, sf_dir, "truth").groupBy("group_id", "frame", "animal").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    b = Box.named()
    cx, cy = b.centre
    a = F.hypot(F.col("mx") - cx, F.col("my") - cy) / b.mean_side
    return rounded(crops(spark, sf_dir).join(pose, ["group_id", "frame", "animal"]).groupBy("group_id").agg(F.percentile(a, F.lit(0.5)).alias("median"), F.percentile(a, F.lit(0.99)).alias("p99")))


@query(ctes("pred", "truth", "sess") + f", {_ALIGNED}, u AS (SELECT group_id, avg(d) AS err, quantile_cont(d, 0.95) AS p95, count(x) AS n_true, count(d) AS n_matched FROM al GROUP BY 1), j AS (SELECT * FROM u JOIN sess USING (group_id)) SELECT mode, group_id, CAST(count(*) AS BIGINT) AS n_units, round(sum(n_matched)::DOUBLE / sum(n_true), 6) AS coverage, round(avg(err), 6) AS err, round(avg(p95), 6) AS p95 FROM j GROUP BY ROLLUP (mode, group_id)")
def ag11_report_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = m.error_and_coverage(aligned(spark, sf_dir), "group_id").join(fixture(spark, sf_dir, "sess"), "group_id")
    return rounded(m.report_by_mode(units))


@query(ctes("pred", "truth") + f", {_ALIGNED}, c AS (SELECT *, CAST(floor(frame / 64.0) * 64 AS INTEGER) AS t0 FROM al) SELECT group_id || '#' || CAST(t0 AS VARCHAR) AS unit, {_ERRORS} FROM c GROUP BY 1 HAVING min(frame) < max(frame)")
def ag12_chunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.error_and_coverage(m.chunk_units(aligned(spark, sf_dir), 64), "unit"))


@query(ctes("pred", "truth") + f", {_ARMS}, units AS (SELECT group_id || '/' || CAST(animal AS VARCHAR) AS unit, avg(sqrt(pow(ax - x, 2) + pow(ay - y, 2))) - avg(sqrt(pow(bxx - x, 2) + pow(byy - y, 2))) AS v FROM arms GROUP BY 1), vals AS (SELECT * FROM units WHERE v IS NOT NULL), {_BOOT}, o AS ({_INTERVAL}) SELECT *, lo > 0 OR hi < 0 AS star FROM o")
def ag13_paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda x, y: j.distance(F.col(x), F.col(y), F.col("x"), F.col("y"))
    units = arms(spark, sf_dir).groupBy(F.concat_ws("/", "group_id", "animal").alias("unit")).agg(F.avg(d("ax", "ay")).alias("a"), F.avg(d("bx", "by")).alias("b"))
    return rounded(m.paired_bootstrap(units, 400, 4)).withColumn("star", (F.col("lo") > 0) | (F.col("hi") < 0))


def _moved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Boxes as truth, and the same moved by their score as detections, without every one of the lowest."""
    det = fixture(spark, sf_dir, "det")
    gt = det.select("group_id", "frame", "camera", F.col("det").alias("g"), *Box._fields)
    shift = F.round((F.col("score") - 0.5) * 64)
    pred = det.where("score > 0.5").select("group_id", "frame", "camera", F.col("det").alias("p"), (F.col("x0") + shift).alias("x0"), "y0", (F.col("x1") + shift).alias("x1"), "y1")
    return gt, pred


_VIEW = ["group_id", "frame", "camera"]
_GREEDY = (
    ctes("det")
    + ", pr AS (SELECT group_id, frame, camera, det AS p, x0 + round((score - 0.5) * 64) AS x0, y0, x1 + round((score - 0.5) * 64) AS x1, y1 FROM det WHERE score > 0.5), both_ AS (SELECT d.group_id, d.frame, d.camera, d.det AS g, pr.p, greatest(least(d.x1, pr.x1) - greatest(d.x0, pr.x0), 0) * greatest(least(d.y1, pr.y1) - greatest(d.y0, pr.y0), 0) AS inter, (d.x1 - d.x0) * (d.y1 - d.y0) + (pr.x1 - pr.x0) * (pr.y1 - pr.y0) AS areas FROM det d JOIN pr ON d.group_id = pr.group_id AND d.frame = pr.frame AND d.camera = pr.camera), "
    "pairs AS (SELECT *, inter / (areas - inter + 1e-7) AS iou FROM both_ WHERE inter > 0), f AS (SELECT group_id, frame, camera, list({'r': {'n': iou, 'g': g, 'p': p}, 'a': []::STRUCT(n DOUBLE, g INTEGER, p INTEGER)[]} ORDER BY iou DESC, g, p) AS rows FROM pairs GROUP BY 1, 2, 3), "
    "m AS (SELECT group_id, frame, camera, unnest(list_reduce(rows, lambda acc, x: CASE WHEN len(list_filter(acc.a, lambda y: y.g = x.r.g OR y.p = x.r.p)) > 0 THEN acc ELSE {'r': acc.r, 'a': list_append(acc.a, x.r)} END, {'r': {'n': 0::DOUBLE, 'g': 0, 'p': 0}, 'a': []::STRUCT(n DOUBLE, g INTEGER, p INTEGER)[]}).a) AS m FROM f), "
    "np AS (SELECT group_id, frame, camera, count(*) AS n FROM pr GROUP BY 1, 2, 3), nh AS (SELECT group_id, frame, camera, count(*) AS n FROM m GROUP BY 1, 2, 3), "
    "greedy AS (SELECT d.group_id, d.frame, d.camera, d.det AS g, coalesce(m.m.n, 0) AS iou, CAST(coalesce(np.n, 0) - coalesce(nh.n, 0) AS BIGINT) AS unmatched_pred FROM det d LEFT JOIN m ON m.group_id = d.group_id AND m.frame = d.frame AND m.camera = d.camera AND m.m.g = d.det LEFT JOIN np ON np.group_id = d.group_id AND np.frame = d.frame AND np.camera = d.camera LEFT JOIN nh ON nh.group_id = d.group_id AND nh.frame = d.frame AND nh.camera = d.camera) "
)


@query(_GREEDY + "SELECT group_id, frame, camera, g, round(iou, 6) AS iou, unmatched_pred FROM greedy")
def tk2_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(k.greedy_match(*_moved(spark, sf_dir), _VIEW))


@query(_GREEDY + ", fp AS (SELECT group_id, sum(n) AS n FROM (SELECT group_id, max(unmatched_pred) AS n FROM greedy GROUP BY group_id, frame, camera) GROUP BY 1) SELECT group_id, CAST(count(*) AS BIGINT) AS n_gt, round(avg((iou >= 0.5)::INT::DOUBLE), 6) AS r50, round(avg((iou >= 0.75)::INT::DOUBLE), 6) AS r75, round(avg(iou), 6) AS iou, round(any_value(fp.n)::DOUBLE / count(*), 6) AS fp_per_gt FROM greedy JOIN fp USING (group_id) GROUP BY 1")
def ag14_detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = k.greedy_match(*_moved(spark, sf_dir), _VIEW)
    fp = matched.groupBy(*_VIEW).agg(F.max("unmatched_pred").alias("n")).groupBy("group_id").agg(F.sum("n").alias("n_fp"))
    return rounded(m.detection_summary(matched, fp, "group_id"))


@query(ctes("pred", "truth", "sess") + f", {_ALIGNED}, u AS (SELECT group_id, avg(d) AS err, CASE WHEN group_id <> 'g3' THEN count(d)::DOUBLE / count(x) END AS coverage, count(x) AS n FROM al GROUP BY 1) SELECT mode, round(sum(err * n) / sum(CASE WHEN err IS NOT NULL THEN n END), 6) AS err, round(sum(coverage * n) / sum(CASE WHEN coverage IS NOT NULL THEN n END), 6) AS coverage, CAST(sum(n) AS BIGINT) AS n FROM u JOIN sess USING (group_id) GROUP BY 1")
def ag15_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = m.error_and_coverage(aligned(spark, sf_dir), "group_id").join(fixture(spark, sf_dir, "sess"), "group_id")
    units = units.withColumnRenamed("n_true", "n").withColumn("coverage", F.when(F.col("group_id") != "g3", F.col("coverage")))
    return rounded(m.weighted_means(units, "n", ["err", "coverage"], "mode"))


@query()
def ag16_box_mota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as instances of two corner points."""
    gt, pred = _moved(spark, sf_dir)
    clip = F.concat_ws("/", "group_id", "camera").alias("group_id")
    corners = F.array(F.struct(F.lit("lo").alias("bodypart"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.lit("hi").alias("bodypart"), F.col("x1").alias("x"), F.col("y1").alias("y")))
    t = gt.select(clip, "frame", F.col("g").alias("animal"), F.explode(corners).alias("c")).select("group_id", "frame", "animal", "c.*")
    p = pred.select(clip, "frame", F.col("p").alias("pred"), F.explode(corners).alias("c")).select("group_id", "frame", "pred", "c.*")
    found = k.hungarian_match(j.frame_pairs(p, t, 2), 20.0)
    none = fixture(spark, sf_dir, "insts").where("false")
    return rounded(m.mota(found, p, t, none, 20.0, "group_id"))


@query(ctes("sess", "det") + ", grid AS (SELECT group_id, CAST(frame AS INTEGER) AS frame, camera FROM (SELECT group_id, unnest(range(n_frames)) AS frame FROM sess), (SELECT DISTINCT camera FROM det)), d AS (SELECT group_id, frame, camera, count(*) AS n, max(greatest(x1 - x0, y1 - y0)) AS side FROM det GROUP BY 1, 2, 3) SELECT group_id, CAST(count(*) AS BIGINT) AS n_slots, round(count(n)::DOUBLE / count(*), 6) AS det_fill, round(sum(coalesce(n, 0))::DOUBLE / (count(*) * 4), 6) AS slot_fill, round(quantile_cont(side, 0.5), 6) AS side_p50, round(quantile_cont(side, 0.9), 6) AS side_p90 FROM grid LEFT JOIN d USING (group_id, frame, camera) GROUP BY 1")
def ag17_deployment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the grid of frames and cameras the detections fill, four slots a view."""
    det = fixture(spark, sf_dir, "det")
    grid = fixture(spark, sf_dir, "sess").select("group_id", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame")).crossJoin(F.broadcast(det.select("camera").distinct()))
    views = det.groupBy(*_VIEW).agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("side"))
    slots = F.count(F.lit(1))
    return rounded(grid.join(views, _VIEW, "left").groupBy("group_id").agg(slots.alias("n_slots"), (F.count("n") / slots).alias("det_fill"), (F.sum(F.coalesce("n", F.lit(0))) / (slots * 4)).alias("slot_fill"), F.percentile("side", F.lit(0.5)).alias("side_p50"), F.percentile("side", F.lit(0.9)).alias("side_p90")))


_COUNTS = "counts AS (SELECT group_id, 'keypoints' AS tab, status, count(*) AS n FROM truth GROUP BY 1, 3 UNION ALL SELECT group_id, 'instances', status, count(*) FROM insts GROUP BY 1, 3)"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.status_counts({"keypoints": fixture(spark, sf_dir, "truth"), "instances": fixture(spark, sf_dir, "insts")})


@query(ctes("truth", "insts") + f", {_COUNTS} SELECT group_id, tab, status, CAST(n AS BIGINT) AS n FROM counts")
def ag18_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


_HOLES = "holes AS (SELECT group_id, count(DISTINCT (frame, animal)) * count(DISTINCT bodypart) - count(*) AS holes FROM truth GROUP BY 1)"


@query(ctes("truth") + f", {_HOLES} SELECT group_id, CAST(holes AS BIGINT) AS holes FROM holes")
def ag19_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.holes(fixture(spark, sf_dir, "truth"), ["frame", "animal"], "group_id")


@query(ctes("truth", "insts", "sess") + f", {_COUNTS}, {_HOLES}, a AS (SELECT group_id, sum(n) FILTER (WHERE status = 'missing') AS missing, sum(n) FILTER (WHERE status = 'projected') AS projected, sum(n) FILTER (WHERE status = 'visible') AS visible FROM counts GROUP BY 1) SELECT group_id, 'missing not allowed' AS problem FROM a JOIN sess USING (group_id) WHERE missing > 0 AND label_source <> 'annotated' UNION ALL SELECT group_id, 'projected beside visible' FROM a WHERE projected > 0 AND visible > 0 UNION ALL SELECT group_id, 'holes differ' FROM holes JOIN sess USING (group_id) WHERE label_source = 'annotated' AND holes <> 1600")
def ag20_audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = fixture(spark, sf_dir, "sess").select("group_id", (F.col("label_source") == "annotated").alias("allow_missing"), F.when(F.col("label_source") == "annotated", F.lit(1600)).alias("expected_holes"))
    return m.audit_status(_counts(spark, sf_dir), m.holes(fixture(spark, sf_dir, "truth"), ["frame", "animal"], "group_id"), policy)


_OBSERVED = f"WITH {PROJECTED_SQL}, obs AS (SELECT *, sqrt(pow(u - (round(u) + frame % 3), 2) + pow(v - round(v), 2)) AS e FROM projected)"


@query(f"{_OBSERVED} SELECT group_id, CAST(count(e) AS BIGINT) AS n, CAST(count(*) - count(e) AS BIGINT) AS n_unseen, round(quantile_cont(e, 0.5), 4) AS p50, round(quantile_cont(e, 0.95), 4) AS p95, round(quantile_cont(e, 0.99), 4) AS p99, coalesce(quantile_cont(e, 0.5) > 1.0, false) AS fail FROM obs GROUP BY 1")
def ag21_reprojection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the projections from 2D points that were rounded to pixels and moved on some frames."""
    e = F.hypot(F.col("u") - (F.round("u") + F.col("frame") % 3), F.col("v") - F.round("v"))
    own = projected(spark, sf_dir).withColumn("e", e)
    return rounded(own.groupBy("group_id").agg(F.count("e").alias("n"), (F.count(F.lit(1)) - F.count("e")).alias("n_unseen"), F.percentile("e", F.lit(0.5)).alias("p50"), F.percentile("e", F.lit(0.95)).alias("p95"), F.percentile("e", F.lit(0.99)).alias("p99"), F.coalesce(F.percentile("e", F.lit(0.5)) > 1.0, F.lit(False)).alias("fail")), 4)


@query(ctes("det") + "SELECT group_id, det, CAST(floor(frame / 16.0) AS INTEGER) AS win, CAST(count(*) AS BIGINT) AS n FROM det WHERE x1 > x0 GROUP BY 1, 2, 3 HAVING count(*) >= 4")
def ag22_finite_box_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "det").where(Box.named().is_box).groupBy("group_id", "det", F.floor(F.col("frame") / 16).cast("int").alias("win")).agg(F.count(F.lit(1)).alias("n")).where("n >= 4")


@query(ctes("truth") + ", s AS (SELECT * FROM (VALUES ('nose', 'tail'), ('ear_l', 'ear_r')) AS t(a, b)) SELECT s.a, s.b, round(quantile_cont(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)), 0.5), 6) AS length, CAST(count(*) AS BIGINT) AS n FROM s JOIN truth p ON p.bodypart = s.a JOIN truth q ON q.bodypart = s.b AND q.group_id = p.group_id AND q.frame = p.frame AND q.animal = p.animal WHERE p.x IS NOT NULL AND q.x IS NOT NULL GROUP BY 1, 2")
def ag23_bone_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.bone_lengths(fixture(spark, sf_dir, "truth"), [("nose", "tail"), ("ear_l", "ear_r")]))


@query(ctes("truth", "det") + "SELECT group_id, round(avg(CASE WHEN x BETWEEN x0 - 1 AND x1 + 1 AND y BETWEEN y0 - 1 AND y1 + 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS frac FROM truth JOIN (SELECT group_id, frame, det AS animal, x0, y0, x1, y1 FROM det) USING (group_id, frame, animal) WHERE x IS NOT NULL GROUP BY 1")
def ag24_inside_box_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fixture(spark, sf_dir, "det").withColumnRenamed("det", "animal")
    inside = F.col("x").between(F.col("x0") - 1, F.col("x1") + 1) & F.col("y").between(F.col("y0") - 1, F.col("y1") + 1)
    return rounded(fixture(spark, sf_dir, "truth").where("x is not null").join(boxes, ["group_id", "frame", "animal"]).groupBy("group_id").agg(F.avg(inside.cast("double")).alias("frac")))


@query(ctes("track") + ", g AS (SELECT group_id, animal, frame, frame - lag(frame) OVER (PARTITION BY group_id, animal ORDER BY frame) AS step FROM track), c AS (SELECT group_id, animal, step, count(*) AS n, min(frame) AS first FROM g WHERE step IS NOT NULL GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY group_id, animal ORDER BY n DESC, first) AS r FROM c) SELECT t.group_id, t.animal, CAST(coalesce(k.step, 1) AS INTEGER) AS step FROM (SELECT DISTINCT group_id, animal FROM track) t LEFT JOIN k ON k.group_id = t.group_id AND k.animal = t.animal AND k.r = 1")
def ag25_modal_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.modal_step(fixture(spark, sf_dir, "track"), "group_id", "animal")


@query(ctes("truth") + ", s AS (SELECT group_id, animal, list(DISTINCT bodypart ORDER BY bodypart) AS names FROM truth WHERE status = 'visible' GROUP BY group_id, animal, frame) SELECT array_to_string(names, ',') AS names, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY names ORDER BY n DESC LIMIT 1")
def ag26_canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each animal-frame's seen names stand for a session's."""
    sessions = fixture(spark, sf_dir, "truth").where("status = 'visible'").groupBy("group_id", "animal", "frame").agg(F.array_sort(F.collect_set("bodypart")).alias("names"))
    return m.canonical_names(sessions).select(F.array_join("names", ",").alias("names"), "n")


@query("WITH rigs AS (SELECT c_nationkey AS trial, list(DISTINCT CAST(c_custkey % 3 AS VARCHAR) ORDER BY CAST(c_custkey % 3 AS VARCHAR)) AS rig FROM customer GROUP BY 1) SELECT array_to_string(rig, ',') AS rig, CAST(count(*) AS BIGINT) AS n_trials FROM rigs GROUP BY 1")
def ag27_rig_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials with the same rig share a session."""
    rigs = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("trial")).agg(F.array_join(F.array_sort(F.collect_set((F.col("c_custkey") % 3).cast("string"))), ",").alias("rig"))
    return rigs.groupBy("rig").agg(F.count(F.lit(1)).alias("n_trials"))


@query(ctes("det") + "SELECT camera, round(quantile_disc(greatest(x1 - x0, y1 - y0) * 0.625::DOUBLE, 0.5), 6) AS median, round(quantile_cont(greatest(x1 - x0, y1 - y0) * 0.625::DOUBLE, 0.1), 6) AS p10, round(least(greatest(1.0::DOUBLE, 24.0::DOUBLE / quantile_cont(greatest(x1 - x0, y1 - y0) * 0.625::DOUBLE, 0.1)), sqrt(409600.0::DOUBLE / (160.0 * 120.0))), 6) AS scale FROM det GROUP BY 1")
def ag28_size_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box sides at an input of 160 x 120, and the scale that brings small ones to 24 px within an area of 640 x 640."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * 0.625
    p10 = F.percentile(side, F.lit(0.1))
    return rounded(fixture(spark, sf_dir, "det").groupBy("camera").agg(k.lower_median(side).alias("median"), p10.alias("p10"), F.least(F.greatest(F.lit(1.0), F.lit(24.0) / p10), F.sqrt(F.lit(409600.0 / (160.0 * 120.0)))).alias("scale")))


@query(ctes("det") + "SELECT camera, " + ", ".join(f"quantile_cont(score, {q / 100}) AS q{q:02d}" for q in (1, 10, 25, 50, 75, 90)) + " FROM det GROUP BY 1")
def ag29_score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "det").groupBy("camera").agg(*(F.percentile("score", F.lit(q / 100)).alias(f"q{q:02d}") for q in (1, 10, 25, 50, 75, 90)))


@query(ctes("pred", "truth") + f", {_ALIGNED} SELECT group_id, round(avg(greatest(logit, 0) - logit * t + ln(1 + exp(-abs(logit)))), 6) AS loss FROM (SELECT group_id, logit, CASE status WHEN 'visible' THEN 1.0::DOUBLE WHEN 'missing' THEN 0.0::DOUBLE END AS t FROM al) GROUP BY 1")
def ag30_masked_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.masked_log_loss(aligned(spark, sf_dir).withColumn("target", visibility_target(F.col("status"))), "group_id"))


@query(ctes("pred", "truth") + f", {_ALIGNED} SELECT group_id, round(avg(d), 6) AS d, round(avg(logit), 6) AS logit, CAST(count(*) FILTER (WHERE d IS NULL OR logit IS NULL) AS BIGINT) AS n_nonfinite FROM al GROUP BY 1")
def ag31_mean_with_nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = j.distance(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
    return rounded(aligned(spark, sf_dir).withColumn("d", d).groupBy("group_id").agg(F.avg("d").alias("d"), F.avg("logit").alias("logit"), F.count_if(F.col("d").isNull() | F.col("logit").isNull()).alias("n_nonfinite")))


@query(ctes("sess", "truth") + "SELECT group_id, round(count(x)::DOUBLE / (any_value(n_frames) * count(DISTINCT animal) * 4), 6) AS point_fill, round(count(DISTINCT CASE WHEN x IS NOT NULL THEN (frame, animal) END)::DOUBLE / (any_value(n_frames) * count(DISTINCT animal)), 6) AS slot_fill FROM truth JOIN sess USING (group_id) GROUP BY 1")
def ag32_fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "truth").join(fixture(spark, sf_dir, "sess"), "group_id")
    slots = F.first("n_frames") * F.countDistinct("animal")
    return rounded(rows.groupBy("group_id").agg((F.count("x") / (slots * 4)).alias("point_fill"), (F.countDistinct(F.when(F.col("x").isNotNull(), F.struct("frame", "animal"))) / slots).alias("slot_fill")))


@query(ctes("truth") + "SELECT group_id, frame, bodypart, max(CASE status WHEN 'visible' THEN true WHEN 'missing' THEN false END) AS visible FROM truth GROUP BY 1, 2, 3")
def ag33_any_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The animals of a frame stand for cameras."""
    return m.any_visible(fixture(spark, sf_dir, "truth").withColumn("target", visibility_target(F.col("status"))), "group_id", "frame", "bodypart")


# Suppression and matching


@query(ctes("det") + ", o AS (SELECT *, row_number() OVER (PARTITION BY group_id, frame ORDER BY score DESC, det) AS k FROM det), c AS (SELECT a.group_id, a.frame, a.k AS ka, b.k AS kb FROM o a JOIN o b ON a.group_id = b.group_id AND a.frame = b.frame AND a.k < b.k WHERE (greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)) / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) + 1e-7) >= 0.4), h AS (SELECT group_id, frame, kb AS k, list(ka) AS better FROM c GROUP BY 1, 2, 3), f AS (SELECT o.group_id, o.frame, list({'k': o.k, 'b': coalesce(h.better, [])} ORDER BY o.k) AS rows FROM o LEFT JOIN h USING (group_id, frame, k) GROUP BY 1, 2), kept AS (SELECT group_id, frame, list_reduce(rows, lambda acc, r: CASE WHEN len(list_intersect(acc.b, r.b)) > 0 THEN acc ELSE {'k': r.k, 'b': list_append(acc.b, r.k)} END, {'k': 0::BIGINT, 'b': []::BIGINT[]}).b AS ks FROM f) SELECT o.group_id, o.frame, o.det, o.score FROM o JOIN kept USING (group_id, frame) WHERE list_contains(ks, o.k)")
def tk1_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.nms(fixture(spark, sf_dir, "det"), ["group_id", "frame"], iou=0.4).select("group_id", "frame", "det", "score")


@query()
def tk3_hungarian_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches are written while the session lets joins use the buckets; its setting is put back."""
    with buckets_meet(spark):
        return rounded(materialize(matches(*(bucketed(spark, sf_dir, x) for x in ("pred", "truth"))), "matches"))


@query(ctes("det") + ", o AS (SELECT *, row_number() OVER (PARTITION BY group_id, frame, camera ORDER BY score DESC, det) AS rank FROM det) SELECT group_id, frame, camera, det, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 2")
def tk7_rank_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.rank_detections(fixture(spark, sf_dir, "det"), 2).select("group_id", "frame", "camera", "det", "rank")


def _rows_and_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    det = fixture(spark, sf_dir, "det").select("group_id", "frame", F.lit("c0").alias("camera"), F.col("det").alias("row"), *Box._fields, "score")
    points = fixture(spark, sf_dir, "truth").select("group_id", "frame", F.lit("c0").alias("camera"), F.col("animal").alias("row"), "x", "y")
    return det, points


@query()
def tk6_pose_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.pose_nms(*_rows_and_points(spark, sf_dir), 0.5)


_CANDIDATES = f"WITH {PROJECTED_SQL}, views AS (SELECT group_id, frame, camera, u AS cx, v AS cy, point FROM projected WHERE u IS NOT NULL)"


@query(f"{_CANDIDATES} SELECT p.group_id, p.frame, p.point AS cand, CAST(count(DISTINCT p.camera) AS BIGINT) AS support FROM projected p JOIN views w ON p.group_id = w.group_id AND p.frame = w.frame AND p.camera = w.camera AND p.point <> w.point WHERE sqrt(pow(p.u - w.cx, 2) + pow(p.v - w.cy, 2)) <= 25 GROUP BY 1, 2, 3")
def tk5_support_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras in which another point comes near each point's projection."""
    own = projected(spark, sf_dir)
    candidates = own.select("group_id", "frame", F.col("point").alias("cand"), "camera", "u", "v")
    views = own.where("u is not null").select("group_id", "frame", "camera", F.col("point").alias("other"), F.col("u").alias("cx"), F.col("v").alias("cy"))
    near = candidates.join(views, ["group_id", "frame", "camera"]).where("cand <> other").select("group_id", "frame", "camera", "cand", "u", "v", "cx", "cy")
    return near.where(F.hypot(F.col("u") - F.col("cx"), F.col("v") - F.col("cy")) <= 25).groupBy("group_id", "frame", "cand").agg(F.countDistinct("camera").alias("support"))
