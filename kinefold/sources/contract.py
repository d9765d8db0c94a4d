"""The whole validation contract over a path: one call, one table of (rule, severity, session_id, message, n)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefold.functions.geometry import rodrigues
from kinefold.functions.status import positioned
from kinefold.operators import multiview as mv
from kinefold.operators import validate as v
from kinefold.operators.joins import small
from kinefold.sources import readers as rd
from kinefold.sources.schema import ASSOCIATION_PX
from kinefold.sources.tables import materialize

#: The key of each table.
KEYS = {"keypoints": ["group_id", "frame", "animal_id", "camera", "bodypart"], "points3d": ["group_id", "frame", "animal_id", "bodypart"], "instances": ["group_id", "frame", "animal_id", "camera"], "extrinsics": ["group_id", "frame", "camera"]}


def _session() -> Column:
    return F.concat_ws("/", "root", "split", "session_id")


def _scoped(df: DataFrame) -> DataFrame:
    """Ids under their session: names of groups, cameras and bodyparts (folder names and texts) behind root/split/session."""
    ids = [c for c in ("group_id", "camera", "bodypart") if c in df.columns]
    return df.withColumns({c: F.concat_ws("/", "root", "split", "session_id", c) for c in ids}).withColumn("session", _session())


def view_residuals(keypoints: DataFrame, cameras: DataFrame, extrinsics: DataFrame) -> DataFrame:
    """The residual of every point that two calibrated cameras see (group_id, frame, animal, bodypart, residual); cameras that move stand where the frame says."""
    at = lambda c, k: F.element_at(c, k)
    still = F.array(*rodrigues(at("rvec", 1), at("rvec", 2), at("rvec", 3)))
    own = cameras.where("calibrated").select("camera", "matrix", "distortions", still.alias("still"), "tvec", "offset_x", "offset_y", "moving", "fisheye")
    ext = extrinsics.select("group_id", "frame", "camera", "ext")
    seen = keypoints.where(positioned(F.col("status")) & F.col("x").isNotNull() & F.col("y").isNotNull()).join(small(own), "camera").join(ext, ["group_id", "frame", "camera"], "left")
    cell = lambda i, j: at("ext", 4 * i + j + 1)
    posed = F.col("moving") & F.col("ext").isNotNull()
    rotation = F.when(posed, F.array(*(cell(i, j) for i in range(3) for j in range(3)))).otherwise(F.col("still"))
    translation = F.when(posed, F.array(*(cell(i, 3) for i in range(3)))).otherwise(F.col("tvec"))
    lens = mv.lens(at("matrix", 1), at("matrix", 5), at("matrix", 3), at("matrix", 6), rotation, translation, F.col("distortions"), F.col("offset_x"), F.col("offset_y"), F.col("fisheye"))
    keys = ["group_id", "frame", "animal", "bodypart"]
    views = seen.select(*keys, "camera", F.col("x").cast("double").alias("u"), F.col("y").cast("double").alias("v"), lens.alias("lens"))
    return mv.triangulate(views, None, keys).where("n_views >= 2")


def validate(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Every rule over every session below a path; n counts what breaks it. session_id is root/split/session, for V-14 root/session.

    Sessions without a table have none of its rows. V-3 compares with names, by default with all names of the sessions, sorted.
    V-8 (image sizes) needs a decoder and is not checked; V-16 compares two roots and is a function of its own.
    """
    read = {k: _scoped(rd.read_table(spark, path, k)) for k in ("groups", "keypoints", "points3d", "instances", "regions", "extrinsics")}
    sessions = materialize(rd.read_sessions(spark, path).withColumn("id", F.col("session_id")).withColumn("session_id", _session()), "sessions")
    cameras = materialize(_scoped(rd.read_cameras(spark, path).withColumn("camera", F.col("name"))), "cameras")
    whole = sessions.where("violation is null")
    if names is None:
        found = whole.select(F.explode("names").alias("name")).agg(F.array_sort(F.collect_set("name"))).first()
        names = found[0]
    own_cameras = cameras.withColumn("session_id", F.col("session"))
    groups, points, points3d = read["groups"], read["keypoints"].withColumnRenamed("animal_id", "animal"), read["points3d"].withColumnRenamed("animal_id", "animal")
    instances = read["instances"].withColumnRenamed("animal_id", "animal")
    bodyparts = whole.select("session_id", F.explode("names").alias("n")).select(F.concat_ws("/", "session_id", "n").alias("bodypart"))
    boxed = small(instances.select("session").distinct())
    limits = whole.where("mode = '3d'").select(F.col("session_id").alias("session"), F.coalesce("assoc_res_max_px", F.lit(ASSOCIATION_PX)).alias("limit"))
    residuals = view_residuals(points, cameras, read["extrinsics"]).groupBy("group_id", "animal").agg(F.percentile_approx("residual", 0.5).alias("residual"))
    far = residuals.withColumn("session", _parent("group_id")).join(small(limits), "session")
    reports = [
        v.check_v1(sessions),
        v.check_v2(whole),
        v.check_v3(whole, names) if names else None,
        v.check_v4(whole, own_cameras),
        *(v.check_v6(t, groups, bodyparts) for t in (points, points3d)),
        *(v.check_v6_cameras(t, cameras) for t in (points, instances, read["regions"], read["extrinsics"])),
        v.check_v7(_scoped(rd.read_image_files(spark, path)), groups),
        *(v.check_v9(read[k], key) for k, key in KEYS.items()),
        v.check_v10(points, points3d),
        v.check_v11(points.join(boxed, "session", "left_semi"), instances),
        v.check_v12(far, F.col("limit")),
        v.check_v13(read["extrinsics"], cameras.select("camera", "moving", "session"), groups.select("group_id", "n_frames", "session"), "session"),
        v.check_v14(sessions.select(F.concat_ws("/", "root", "id").alias("session_id"), "split")),
        v.check_v15(read["regions"]),
    ]
    out = reduce(DataFrame.unionByName, [r for r in reports if r is not None])
    return out.groupBy("rule", "severity", _parent("session_id").alias("session_id"), "message").agg(F.sum("n").alias("n"))


def _parent(c: str) -> Column:
    """The session of an id below it."""
    return F.regexp_replace(c, r"^([^/]*/[^/]*/[^/]*)/.*$", "$1")
