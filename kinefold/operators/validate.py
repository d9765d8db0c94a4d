"""The validation contract: each rule gives rows (rule, severity, session_id, message, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinefold.functions.status import positioned
from kinefold.operators.joins import small, visibility_observation
from kinefold.operators.sets import axis_diff, flip_involution
from kinefold.sources.readers import image_file_manifest


def _report(df: DataFrame, rule: str, message, session: str = "group_id", severity: str = "error") -> DataFrame:
    counted = df.select(F.col(session).alias("session_id"), (message if not isinstance(message, str) else F.lit(message)).alias("message"))
    return counted.groupBy("session_id", "message").agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "session_id", "message", "n")


def check_v1(sessions: DataFrame) -> DataFrame:
    """Manifests that could not be read."""
    return _report(sessions.where("violation is not null"), "V-1", F.col("violation"), "session_id")


def check_v2(sessions: DataFrame) -> DataFrame:
    """Names are unique, and skeleton and flip pairs know theirs; pairs are an involution."""
    twice = _report(sessions.where(F.size(F.array_distinct("names")) != F.size("names")), "V-2", "duplicate name", "session_id")
    named = F.array_except(F.flatten(F.coalesce("flip_pairs", F.array().cast("array<array<string>>"))), F.col("names"))
    unknown = _report(sessions.where(F.size(named) > 0), "V-2", "unknown name", "session_id")
    pairs = sessions.select("session_id", F.explode("flip_pairs").alias("p")).select(F.concat_ws("/", "session_id", F.element_at("p", 1)).alias("a"), F.concat_ws("/", "session_id", F.element_at("p", 2)).alias("b"))
    broken = flip_involution(pairs)[1].select(F.regexp_extract("a", "^(.*)/", 1).alias("session_id"))
    if "skeleton" in sessions.columns:
        bones = F.array_except(F.flatten(F.coalesce("skeleton", F.array().cast("array<array<string>>"))), F.col("names"))
        unknown = unknown.union(_report(sessions.where(F.size(bones) > 0), "V-2", "unknown skeleton name", "session_id"))
    return twice.union(unknown).union(_report(broken, "V-2", "not an involution", "session_id"))


def check_v3(sessions: DataFrame, names: list[str]) -> DataFrame:
    """Axes that lack names or have them in another order: a warning."""
    odd = axis_diff(sessions, names).where("size(missing) > 0 or reordered")
    return _report(odd, "V-3", F.when(F.col("reordered"), "reordered").otherwise("subset"), "session_id", "warning")


def check_v4(sessions: DataFrame, cameras: DataFrame) -> DataFrame:
    """Cameras have names and sizes; 3d sessions at least two calibrated ones, 2d sessions exactly one."""
    bare = _report(cameras.where("name is null or width is null or height is null or width <= 0 or height <= 0"), "V-4", "camera without name or size", "session_id")
    n = cameras.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_cameras"), F.count_if("calibrated").alias("n_calibrated"))
    own = sessions.select("session_id", "mode").join(n, "session_id", "left").fillna(0)
    wrong = own.where("(mode = '3d' and n_calibrated < 2) or (mode = '2d' and n_cameras <> 1)")
    return bare.union(_report(wrong, "V-5", F.concat(F.lit("cameras of a "), F.col("mode"), F.lit(" session")), "session_id"))


def check_v6(rows: DataFrame, groups: DataFrame, names: DataFrame) -> DataFrame:
    """Bodyparts and groups exist, frames lie in their group."""
    part = _report(rows.join(small(names), "bodypart", "left_anti"), "V-6", "unknown bodypart")
    group = _report(rows.join(groups, "group_id", "left_anti"), "V-6", "unknown group")
    frame = _report(rows.join(groups, "group_id").where("frame < 0 or frame >= n_frames"), "V-6", "frame out of range")
    return part.union(group).union(frame)


def check_v6_cameras(rows: DataFrame, cameras: DataFrame) -> DataFrame:
    """Cameras exist."""
    return _report(rows.join(small(cameras.select("camera").distinct()), "camera", "left_anti"), "V-6", "unknown camera")


def check_v7(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Image files (group_id, camera, file) are as many as frames, of one extension, numbered without a gap: n is the number of cameras that break the rule."""
    return _report(image_file_manifest(files, groups), "V-7", "image files")


def check_v9(rows: DataFrame, key: list[str]) -> DataFrame:
    twice = rows.groupBy(*key).count().where("count > 1")
    return _report(twice, "V-9", "duplicate key")


def check_v10(rows: DataFrame, points3d: DataFrame) -> DataFrame:
    """Positioned rows have coordinates, others have none; a visible row may leave them to a 3D point of its key."""
    bare = rows.where(positioned(F.col("status")) & (F.col("x").isNull() | F.col("y").isNull()))
    excused = visibility_observation(bare, points3d).select(*rows.columns).unionByName(bare.where("status = 'projected'"))
    extra = rows.where(~positioned(F.col("status")) & (F.col("x").isNotNull() | F.col("y").isNotNull()))
    return _report(excused, "V-10", "no coordinates").union(_report(extra, "V-10", "coordinates without a position"))


def check_v11(rows: DataFrame, instances: DataFrame) -> DataFrame:
    """A keypoint row has a labeled instance, and the other way round."""
    key = ["group_id", "frame", "animal"]
    labeled = instances.where("status = 'labeled'").select(*key)
    points = rows.where("status <> 'unlabeled'").select(*key).distinct()
    return _report(points.join(labeled, key, "left_anti"), "V-11", "keypoints without an instance").union(_report(labeled.join(points, key, "left_anti"), "V-11", "instance without keypoints"))


def check_v12(residuals: DataFrame, limit: float | Column) -> DataFrame:
    """Animals (group_id, frame, animal, residual) whose views do not meet within the limit."""
    return _report(residuals.where(F.col("residual") > limit), "V-12", "views do not meet")


def check_v13(extrinsics: DataFrame, cameras: DataFrame, groups: DataFrame, session: str | None = None) -> DataFrame:
    """Extrinsics belong to moving cameras only, and cover every frame. Cameras and groups of several sessions meet by a column that both have."""
    moving = small(cameras.where("moving").select("camera", *([session] if session else [])))
    still = extrinsics.join(moving.select("camera"), "camera", "left_anti")
    seen = extrinsics.groupBy("group_id", "camera").agg(F.countDistinct("frame").alias("n"))
    pairs = groups.join(moving, session) if session else groups.crossJoin(moving)
    gaps = pairs.select("group_id", "camera", "n_frames").join(seen, ["group_id", "camera"], "left").where("coalesce(n, 0) <> n_frames")
    return _report(still, "V-13", "extrinsics of a still camera").union(_report(gaps, "V-13", "frames without a pose"))


def check_v14(sessions: DataFrame) -> DataFrame:
    return _report(sessions.groupBy("session_id").agg(F.countDistinct("split").alias("n")).where("n > 1"), "V-14", "in several splits", "session_id", "warning")


def check_v15(regions: DataFrame) -> DataFrame:
    """Regions have the one status and area (an empty box is no box among instances, but an error here)."""
    status = _report(regions.where("status is null or status <> 'labelled_complete'"), "V-15", "status")
    return status.union(_report(regions.where("x0 is null or y0 is null or not (x1 > x0 and y1 > y0)"), "V-15", "empty region"))


def check_v16(pred_groups: DataFrame, groups: DataFrame) -> DataFrame:
    """The groups of a prediction and of its source are the same, with as many frames."""
    both = pred_groups.select("group_id", F.col("n_frames").alias("np")).join(groups.select("group_id", F.col("n_frames").alias("ns")), "group_id", "full").where("not (np <=> ns)")
    return _report(both, "V-16", F.when(F.col("np").isNull(), "group not predicted").when(F.col("ns").isNull(), "group not in the source").otherwise("frames differ"))


def check_v16_sessions(predicted: DataFrame, sessions: DataFrame) -> DataFrame:
    """A prediction is of one session, which its source has with the same names and the same cameras, in order: rows (session_id, names, cameras)."""
    side = lambda df, p: df.select("session_id", F.col("names").alias(f"{p}_names"), F.col("cameras").alias(f"{p}_cameras"))
    both = side(predicted, "p").join(side(sessions, "s").withColumn("known", F.lit(True)), "session_id", "left")
    unknown = _report(both.where("known is null"), "V-16", "session not in the source", "session_id")
    names = _report(both.where("known and not (p_names <=> s_names)"), "V-16", "names differ", "session_id")
    cameras = _report(both.where("known and not (p_cameras <=> s_cameras)"), "V-16", "cameras differ", "session_id")
    several = predicted.agg(F.count_distinct("session_id").alias("n"), F.max("session_id").alias("session_id")).where("n > 1")
    return unknown.union(names).union(cameras).union(_report(several, "V-16", "several sessions", "session_id"))
