"""Lens models: columns against arrays, planted rigs, and what is refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinefold.functions import geometry as g
from kinefold.operators import multiview as mv
from kinefold.plans.q_tracking import camera_rows
from kinefold.sources.contract import view_residuals

#: k1 to k4 of a wide fisheye, and a number that it does not use.
K = (0.05, -0.01, 0.002, -0.0005, 9.0)


def planted(n_cameras=3, fisheye=True):
    """Cameras around the origin and points that all of them see, some far off the axis."""
    rng = np.random.default_rng(2)
    turns = [np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]]) for a in np.linspace(-0.6, 0.6, n_cameras)]
    rig = mv.Rig([f"c{k}" for k in range(n_cameras)], np.full((n_cameras, 2), 320.0), np.tile([300.0, 240.0], (n_cameras, 1)), np.stack(turns), np.tile([0.0, 0.1, 3.0], (n_cameras, 1)), np.tile(K, (n_cameras, 1)), np.tile([7.0, 3.0], (n_cameras, 1)), np.full(n_cameras, fisheye))
    return rig, rng.uniform(-2.0, 2.0, (60, 3)) * [1.5, 1.0, 0.8]


def test_fisheye_arrays_follow_the_formula_and_back():
    rig, points = planted()
    cams = np.arange(len(points)) % 3
    seen = rig.project(points, cams)
    for p, c, uv in zip(points, cams, seen, strict=True):
        x, y, z = rig.rotation[c] @ p + rig.translation[c]
        t = np.arctan2(np.hypot(x, y), z)
        bent = t * (1 + K[0] * t**2 + K[1] * t**4 + K[2] * t**6 + K[3] * t**8)
        want = [320 * bent * x / np.hypot(x, y) + 300 - 7, 320 * bent * y / np.hypot(x, y) + 240 - 3]
        assert np.allclose(uv, want, atol=1e-9)
        assert np.allclose(rig.rays(uv[None], np.array([c]))[0], [x / z, y / z, 1], atol=1e-6)
    far = rig.rays(np.array([[5000.0, 5000.0]]), np.array([0]))
    assert not np.isfinite(far[0, :2]).any()


def test_fisheye_columns_equal_arrays(spark):
    rig, points = planted()
    rows = [(k, f"c{c}", *map(float, p), *map(float, rig.rotation[c].ravel()), c > 0) for k, p in enumerate(points) for c in range(3)]
    df = spark.createDataFrame(rows, "k int, camera string, x double, y double, z double, " + ", ".join(f"r{j} double" for j in range(9)) + ", fisheye boolean")
    lit = F.lit
    cam = g.Camera(lit(320.0), lit(320.0), lit(300.0), lit(240.0), tuple(F.col(f"r{j}") for j in range(9)), (lit(0.0), lit(0.1), lit(3.0)), tuple(map(lit, (*K[:4], 0.0))), lit(7.0), lit(3.0), F.col("fisheye"))
    own = rig._replace(fisheye=np.array([False, True, True]), distortion=np.tile((*K[:4], 0.0), (3, 1)))
    got = g.unproject(g.project(df, cam), cam).orderBy("k", "camera").toPandas()
    want = own.project(np.repeat(points, 3, axis=0), np.tile(np.arange(3), len(points)))
    assert np.allclose(got[["u", "v"]], want, atol=1e-9)
    rays = own.rays(want, np.tile(np.arange(3), len(points)))
    fish = got.fisheye.to_numpy(bool)
    assert np.allclose(got.loc[fish, ["a", "b"]], rays[fish, :2], atol=1e-6) and set(got.columns) == {*df.columns, "u", "v", "a", "b"}


@pytest.mark.parametrize("fisheye", [True, False])
def test_points_come_back(fisheye):
    rig, points = planted(4, fisheye)
    if not fisheye:
        rig, points = rig._replace(distortion=np.tile([-0.05, 0.01, 0.001, -0.001, 0.0], (4, 1))), points * 0.2
    cams = np.tile(np.arange(4), (len(points), 1))
    seen = rig.project(np.repeat(points, 4, axis=0), cams.ravel()).reshape(-1, 4, 2)
    back = rig.triangulate(seen, cams, np.isfinite(seen).all(axis=2))
    assert np.abs(back - points).max() < 1e-6


def test_a_table_of_any_number_of_cameras(spark):
    """More cameras than a rig may hold in memory: the table is joined instead."""
    rig, points = planted(1200)
    cameras = spark.createDataFrame([(n, 320.0, 320.0, 300.0, 240.0, rig.rotation[k].ravel().tolist(), rig.translation[k].tolist(), list(K), 7.0, 3.0, "fisheye") for k, n in enumerate(rig.names)], "camera string, fx double, fy double, cx double, cy double, rotation array<double>, translation array<double>, distortion array<double>, offset_x double, offset_y double, model string")
    with pytest.raises(ValueError, match="more than 1000"):
        mv.Rig.collect(cameras)
    own = [(k, int(c)) for k in range(len(points)) for c in (k, k + 500, k + 1000)]
    seen = rig.project(points[[k for k, _ in own]], np.array([c for _, c in own]))
    views = spark.createDataFrame([(k, f"c{c}", *map(float, uv)) for (k, c), uv in zip(own, seen, strict=True)], "k int, camera string, u double, v double")
    got = mv.triangulate(views, cameras, ["k"]).orderBy("k").toPandas()
    assert np.abs(got[["x", "y", "z"]].to_numpy() - points).max() < 1e-5 and (got.n_views == 3).all()


def test_unknown_models_are_refused(spark):
    odd = camera_rows(spark, True).withColumn("model", F.when(F.col("camera") == "c1", "thin prism").otherwise(F.col("model")))
    with pytest.raises(ValueError, match="thin prism"):
        mv.Rig.collect(odd)
    with pytest.raises(Exception, match="unknown lens model"):
        mv.lenses(odd).collect()


def test_residuals_of_a_fisheye_session(spark):
    """What validate measures: the planted views of fisheyes meet, and do not where they are taken for pinholes."""
    rig, points = planted()
    pixels = rig.project(np.repeat(points, 3, axis=0), np.tile(np.arange(3), len(points))).reshape(-1, 3, 2)
    rows = [("g", k, "a", f"c{c}", "nose", "visible", *map(float, pixels[k, c])) for k in range(len(points)) for c in range(3)]
    keypoints = spark.createDataFrame(rows, "group_id string, frame int, animal string, camera string, bodypart string, status string, x double, y double")
    turns = [float(a) for a in np.linspace(-0.6, 0.6, 3)]
    cameras = spark.createDataFrame([(f"c{k}", [320.0, 0.0, 300.0, 0.0, 320.0, 240.0, 0.0, 0.0, 1.0], list(K), [0.0, a, 0.0], [0.0, 0.1, 3.0], True, False, True, 7.0, 3.0) for k, a in enumerate(turns)], "camera string, matrix array<double>, distortions array<double>, rvec array<double>, tvec array<double>, fisheye boolean, moving boolean, calibrated boolean, offset_x double, offset_y double")
    none = spark.createDataFrame([], "group_id string, frame int, camera string, ext array<double>")
    worst = lambda c: view_residuals(keypoints, c, none).agg(F.max("residual"), F.count("*")).first()
    assert worst(cameras)[0] < 1e-6 and worst(cameras)[1] == len(points)
    assert worst(cameras.withColumn("fisheye", F.lit(False)))[0] > 5


def test_rejected_views_are_rows(spark):
    """Every view of a point is kept or rejected, and the points are those of triangulate with the same gate."""
    rig, points = planted(12, False)
    rig, points = rig._replace(distortion=np.zeros((12, 5))), points * 0.3
    seen = rig.project(np.repeat(points, 12, axis=0), np.tile(np.arange(12), len(points))).reshape(-1, 12, 2)
    seen[::4, 5, 1] += 40
    rows = [("g", k, f"c{c:02d}", *map(float, seen[k, c])) for k in range(len(points)) for c in range(12) if (k + c) % 5]
    views = spark.createDataFrame(rows, "group_id string, k int, camera string, u double, v double")
    own = rig._replace(names=[f"c{c:02d}" for c in range(12)])
    found = mv.triangulate_rejecting(views, own, ["group_id", "k"], 10.0)
    want = {("g", k, "c05") for k in range(0, len(points), 4) if (k + 5) % 5}
    assert {(r.group_id, r.k, r.camera) for r in found.rejected.collect()} == want and found.rejected.where("error < 10").count() == 0
    assert found.kept.count() + len(want) == len(rows)
    plain = {r.k: (r.x, r.y, r.z, r.n_views, r.n_rejected) for r in mv.triangulate(views, own, ["group_id", "k"], reject_px=10.0).collect()}
    assert {r.k: (r.x, r.y, r.z, r.n_views, r.n_rejected) for r in found.points.collect()} == plain
    boxes = views.select("group_id", "k", "camera")
    assert {(r.group_id, r.k, r.camera) for r in mv.emptied_boxes(boxes, found, ["group_id", "k"]).collect()} == want
