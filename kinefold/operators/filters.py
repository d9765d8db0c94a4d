"""Predicates and selections over long tables (one row per assessed thing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinefold.functions.status import positioned

#: Keys of one frame of one clip.
FRAME = ["group_id", "frame"]
#: Frames whose rows one Python call takes.
BUCKET_FRAMES = 512


def has_visibility_assessment(sessions: DataFrame, keypoints: DataFrame, key: str = "group_id") -> DataFrame:
    """Annotated sessions assess visibility; tracked ones if any row says missing, or if they have no rows at all."""
    seen = keypoints.groupBy(key).agg(F.bool_or(F.col("status") == "missing").alias("any_missing"))
    return sessions.join(seen, key, "left").withColumn("assessed", (F.col("label_source") == "annotated") | F.coalesce("any_missing", F.lit(True))).drop("any_missing")


def labelled_frames(keypoints: DataFrame, *, per_animal: bool = False) -> DataFrame:
    keys = [*FRAME, "animal"] if per_animal else FRAME
    return keypoints.where(F.col("status") != "unlabeled").select(*keys).distinct()


def mask_outside(x: Column, y: Column, w: float, h: float) -> tuple[Column, Column]:
    """Null outside [0, w) x [0, h): dropped, not moved to the border."""
    inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    return F.when(inside, x), F.when(inside, y)


def drop_outside(x: Column, y: Column, lo_x: float, lo_y: float, hi_x: float, hi_y: float) -> tuple[Column, Column]:
    """Null outside bounds that belong to the inside."""
    inside = x.between(lo_x, hi_x) & y.between(lo_y, hi_y)
    return F.when(inside, x), F.when(inside, y)


def frame_range(df: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """Frames of a half-open range; the filter reaches the scan."""
    if start < 0 or (stop is not None and stop <= start):
        raise ValueError(f"frame range {start}:{stop}")
    return df.where((F.col("frame") >= start) & (F.lit(True) if stop is None else F.col("frame") < stop))


def short_groups(groups: DataFrame, start: int) -> DataFrame:
    """Groups that a range skips by name, as they end before it."""
    return groups.where(F.col("n_frames") <= start).select("group_id", "n_frames")


def gate_rows(points: DataFrame, threshold: float, keys: tuple[str, ...] = ("group_id", "frame", "pred")) -> DataFrame:
    """Points of animal-frames whose median logit is below the threshold, or unknown, lose their coordinates."""
    medians = points.groupBy(*keys).agg(F.percentile(F.col("logit"), F.lit(0.5)).alias("median_logit"))
    kept = F.coalesce(F.col("median_logit") >= threshold, F.lit(False))
    return points.join(medians, list(keys)).withColumns({c: F.when(kept, F.col(c)) for c in ("x", "y")})


def unlabelled_groups(groups: DataFrame, keypoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups with a visible row, and the others."""
    seen = keypoints.where(F.col("status") == "visible").select("group_id").distinct()
    return groups.join(seen, "group_id", "left_semi"), groups.join(seen, "group_id", "left_anti")


def slice_cameras(df: DataFrame) -> DataFrame:
    """Single-camera sessions out of a multi-camera one."""
    return df.withColumn("session_id", F.concat_ws("__", "group_id", "camera"))


def usable_prior_2d(points: DataFrame, crops: DataFrame) -> DataFrame:
    """Points inside their crop."""
    return points.join(crops, [*FRAME, "animal"]).withColumn("usable", F.coalesce(F.col("x").between(F.col("cx0"), F.col("cx1")) & F.col("y").between(F.col("cy0"), F.col("cy1")), F.lit(False)))


def usable_prior_3d(views: DataFrame, w: float, h: float, margin: float = 2.0, min_views: int = 2) -> DataFrame:
    """Points (key columns, u, v a row for each camera) that at least min_views cameras see."""
    seen = F.coalesce(F.col("u").between(-margin, w + margin) & F.col("v").between(-margin, h + margin), F.lit(False))
    return views.groupBy("group_id", "point").agg((F.count_if(seen) >= min_views).alias("usable"))


def score_filter(dets: DataFrame, threshold: float) -> DataFrame:
    return dets.where(F.col("score") >= threshold)


def with_positions(keypoints: DataFrame) -> DataFrame:
    return keypoints.where(positioned(F.col("status")) & F.col("x").isNotNull() & F.col("y").isNotNull())
