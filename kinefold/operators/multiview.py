"""Points from several cameras. Views are gathered per point and solved in Arrow batches with batched numpy; grouping, gating and counting stay in Spark."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kinefold.functions.geometry import MODELS, is_fisheye
from kinefold.sources.tables import materialize

#: Cameras of one rig: what a broadcast or a closure may hold. Operators take a table of more as it is.
MOST_CAMERAS = 1000
#: Numbers of a camera in one array.
LENS = 24


class Rig(NamedTuple):
    """A session's cameras as arrays; fisheye tells which lenses are equidistant (None: none is)."""

    names: list[str]
    focal: np.ndarray
    centre: np.ndarray
    rotation: np.ndarray
    translation: np.ndarray
    distortion: np.ndarray
    offset: np.ndarray
    fisheye: np.ndarray | None = None

    @classmethod
    def collect(cls, cameras: DataFrame) -> Rig:
        """From rows camera, fx, fy, cx, cy, rotation[9], translation[3], distortion[5], offset_x, offset_y and, if it is there, model (one of MODELS). Larger tables go to triangulate and track as they are."""
        rows = sorted(cameras.limit(MOST_CAMERAS + 1).collect(), key=lambda r: r.camera)
        if len(rows) > MOST_CAMERAS:
            raise ValueError(f"more than {MOST_CAMERAS} cameras: give the operators the table, or rows with a lens each")
        models = [r.model if "model" in r else "pinhole" for r in rows]
        if unknown := sorted({str(x) for x in models} - set(MODELS)):
            raise ValueError(f"unknown lens models: {', '.join(unknown)}")
        a = lambda f: np.array([f(r) for r in rows], float)
        return cls([r.camera for r in rows], a(lambda r: [r.fx, r.fy]), a(lambda r: [r.cx, r.cy]), a(lambda r: r.rotation).reshape(-1, 3, 3), a(lambda r: r.translation), a(lambda r: r.distortion), a(lambda r: [r.offset_x, r.offset_y]), np.array([x == "fisheye" for x in models], bool))

    @classmethod
    def of_lenses(cls, names: list[str], lenses: np.ndarray) -> Rig:
        """From lens() arrays, one a camera."""
        rows = np.asarray(lenses, float).reshape(-1, LENS)
        if not np.isin(rows[:, 23], range(len(MODELS))).all():
            raise ValueError("unknown lens model")
        return cls(names, rows[:, :2], rows[:, 2:4], rows[:, 4:13].reshape(-1, 3, 3), rows[:, 13:16], rows[:, 16:21], rows[:, 21:23], rows[:, 23] == MODELS.index("fisheye"))

    def _bends(self, cams: np.ndarray) -> np.ndarray:
        return np.zeros(len(cams), bool) if self.fisheye is None else self.fisheye[cams]

    def moved(self, cams: np.ndarray, rotations: list, translations: list) -> Rig:
        """The rig with some cameras in other places: of each camera number its rotation (9 numbers) and translation, or None where it stays."""
        rotation, translation = self.rotation.copy(), self.translation.copy()
        for c, r, t in zip(cams, rotations, translations, strict=True):
            if r is not None and t is not None:
                rotation[c], translation[c] = np.asarray(r, float).reshape(3, 3), np.asarray(t, float)
        return self._replace(rotation=rotation, translation=translation)

    def project(self, points: np.ndarray, cams: np.ndarray) -> np.ndarray:
        """Pixels of points (n, 3) in cameras (n); NaN behind them."""
        p = np.einsum("nij,nj->ni", self.rotation[cams], points) + self.translation[cams]
        with np.errstate(all="ignore"):
            a = np.where(p[:, 2:] > 0, p[:, :2] / p[:, 2:], np.nan)
        return self._bend(a, self.distortion[cams], self._bends(cams)) * self.focal[cams] + self.centre[cams] - self.offset[cams]

    @staticmethod
    def _bend(a: np.ndarray, k: np.ndarray, fisheye: np.ndarray) -> np.ndarray:
        x, y = a[:, 0], a[:, 1]
        r2 = x * x + y * y
        if fisheye.any():
            r = np.sqrt(r2)
            t = np.arctan(r)
            scale = np.where(r > 1e-12, t * _angle_series(t * t, k) / np.where(r > 1e-12, r, 1.0), 1.0)
            return np.where(fisheye[:, None], a * scale[:, None], Rig._bend(a, k, np.zeros(len(a), bool)))
        radial = 1 + r2 * (k[:, 0] + r2 * (k[:, 1] + r2 * k[:, 4]))
        return np.stack([x * radial + 2 * k[:, 2] * x * y + k[:, 3] * (r2 + 2 * x * x), y * radial + k[:, 2] * (r2 + 2 * y * y) + 2 * k[:, 3] * x * y], axis=1)

    def rays(self, pixels: np.ndarray, cams: np.ndarray, rounds: int = 12) -> np.ndarray:
        """Undistorted directions (x, y, 1), by fixed-point steps, of a fisheye by Newton's on the angle; not finite where the steps run away, far outside the image."""
        want = (pixels + self.offset[cams] - self.centre[cams]) / self.focal[cams]
        got, bends = want.copy(), self._bends(cams)
        with np.errstate(all="ignore"):
            for _ in range(rounds):
                got = got + want - self._bend(got, self.distortion[cams], np.zeros(len(got), bool))
            if bends.any():
                got[bends] = _unbent(want[bends], self.distortion[cams][bends], rounds)
        return np.hstack([got, np.ones((len(got), 1))])

    def triangulate(self, pixels: np.ndarray, cams: np.ndarray, use: np.ndarray, rays: np.ndarray | None = None) -> np.ndarray:
        """Points (n, 3) from pixels (n, v, 2) of cameras (n, v) where use (n, v), or from their rays (n, v, 3) if those are known; NaN with fewer than two views; views without a direction count as absent. The smallest right singular vector of two rows a view."""
        n, v = use.shape
        if rays is None:
            rays = self.view_rays(pixels, cams, use)
        use = use & (np.abs(rays) < 1e6).all(axis=2)
        rays = np.where(use[..., None], rays, 0.0)
        m = np.concatenate([self.rotation, self.translation[:, :, None]], axis=2)[cams]
        rows = np.stack([rays[..., :1] * m[:, :, 2] - m[:, :, 0], rays[..., 1:2] * m[:, :, 2] - m[:, :, 1]], axis=2)
        rows = np.where(use[:, :, None, None], rows, 0.0).reshape(n, 2 * v, 4)
        if 2 * v < 4:
            rows = np.concatenate([rows, np.zeros((n, 4 - 2 * v, 4))], axis=1)
        x = np.linalg.svd(rows, full_matrices=False)[2][:, -1]
        with np.errstate(all="ignore"):
            out = x[:, :3] / x[:, 3:]
        return np.where((use.sum(axis=1) >= 2)[:, None], out, np.nan)

    def view_rays(self, pixels: np.ndarray, cams: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Rays (n, v, 3) of pixels (n, v, 2), for triangulations of the same views."""
        return self.rays(np.where(use[..., None], pixels, 0.0).reshape(-1, 2), cams.ravel()).reshape(*use.shape, 3)

    def again(self, points: np.ndarray, pixels: np.ndarray, cams: np.ndarray, use: np.ndarray, rays: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Points of which some, whose views have changed, are solved again."""
        out = points.copy()
        if which.any():
            out[which] = self.triangulate(pixels[which], cams[which], use[which], rays[which])
        return out

    def errors(self, points: np.ndarray, pixels: np.ndarray, cams: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Reprojection distances (n, v), NaN where there is none."""
        n, v = use.shape
        seen = self.project(np.repeat(points, v, axis=0), cams.ravel()).reshape(n, v, 2)
        return np.where(use, np.linalg.norm(seen - pixels, axis=2), np.nan)


def _angle_series(t2: np.ndarray, k: np.ndarray, powers: tuple[int, ...] = (1, 1, 1, 1)) -> np.ndarray:
    k1, k2, k3, k4 = (p * k[:, c] for c, p in enumerate(powers))
    return 1 + t2 * (k1 + t2 * (k2 + t2 * (k3 + t2 * k4)))


def _unbent(want: np.ndarray, k: np.ndarray, rounds: int) -> np.ndarray:
    """Directions that a fisheye bends to want; NaN where the angle's polynomial has none below a right angle."""
    d = np.linalg.norm(want, axis=1)
    t = np.minimum(d, 1.5)
    for _ in range(rounds):
        t = t - (t * _angle_series(t * t, k) - d) / _angle_series(t * t, k, (3, 5, 7, 9))
    there = (np.abs(t * _angle_series(t * t, k) - d) < 1e-9) & (t >= 0) & (t < np.pi / 2)
    return want * np.where(there, np.where(d > 1e-12, np.tan(t) / np.where(d > 1e-12, d, 1.0), 1.0), np.nan)[:, None]


def _lower_median(e: np.ndarray) -> np.ndarray:
    """Of each row the lower of the middle values that are there."""
    s = np.sort(e, axis=1)
    n = (~np.isnan(e)).sum(axis=1)
    out = s[np.arange(len(s)), np.maximum(n - 1, 0) // 2]
    return np.where(n > 0, out, np.nan)


def _views(views: DataFrame, keys: list[str], own_lens: bool) -> DataFrame:
    """One row per point: keys, cams, us, vs of the cameras that see it, and their lenses if every view brings its own."""
    more = ["lens"] if own_lens else []
    seen = F.sort_array(F.collect_list(F.when(F.col("u").isNotNull() & F.col("v").isNotNull(), F.struct("camera", "u", "v", *more))))
    return views.groupBy(*keys).agg(seen.alias("w")).select(*keys, F.col("w.camera").alias("cams"), F.col("w.u").alias("us"), F.col("w.v").alias("vs"), *(F.col(f"w.{c}").alias(c) for c in more))


def lens(fx, fy, cx, cy, rotation, translation, distortion, offset_x, offset_y, fisheye: Column | None = None) -> Column:
    """A camera as one array of numbers: the columns of Rig.collect in their order, and the place of its model in MODELS."""
    model = F.lit(0.0) if fisheye is None else F.coalesce(fisheye, F.lit(False)).cast("double")
    return F.concat(F.array(fx, fy, cx, cy), rotation, translation, distortion, F.array(offset_x, offset_y, model))


def lenses(cameras: DataFrame) -> DataFrame:
    """The rows of Rig.collect as camera, lens."""
    c = F.col
    fisheye = is_fisheye(c("model")) if "model" in cameras.columns else None
    return cameras.select("camera", lens(c("fx"), c("fy"), c("cx"), c("cy"), c("rotation"), c("translation"), c("distortion"), c("offset_x"), c("offset_y"), fisheye).alias("lens"))


def with_lenses(rows: DataFrame, cameras: DataFrame, poses: DataFrame | None = None) -> DataFrame:
    """Rows (group_id, frame, camera, ...) with the lens of their camera: as cameras has it, or where poses (group_id, frame, camera, rotation[9], translation[3]) puts it in that frame. Rows of an unknown camera are left out."""
    own = rows.join(lenses(cameras), "camera")
    if poses is None:
        return own
    moved = own.join(poses.select("group_id", "frame", "camera", "rotation", "translation"), ["group_id", "frame", "camera"], "left")
    there = F.col("rotation").isNotNull() & F.col("translation").isNotNull()
    at = F.concat(F.slice("lens", 1, 4), F.col("rotation"), F.col("translation"), F.slice("lens", 17, 8))
    return moved.withColumn("lens", F.when(there, at).otherwise(F.col("lens"))).drop("rotation", "translation")


def _with_cameras(views: DataFrame, rig: Rig | DataFrame | None) -> tuple[DataFrame, Rig | None]:
    """Views of known cameras and the rig. A table of few cameras becomes a rig; of a larger one each view gets its lens, some 200 bytes that are shuffled and sorted with it."""
    if not isinstance(rig, DataFrame):
        return views, rig
    if rig.limit(MOST_CAMERAS + 1).count() <= MOST_CAMERAS:
        own = Rig.collect(rig)
        if len(set(own.names)) == len(own.names):
            return views.where(F.col("camera").isin(own.names)), own
    return views.join(lenses(rig), "camera"), None


def _own_rig(lenses: pa.Array) -> Rig:
    """A rig with a camera for each view of a batch (a list of lenses a row); the first one stands for views that are not there."""
    rows = lenses.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, LENS)
    return Rig.of_lenses([], np.vstack([np.r_[1.0, 1.0, 0.0, 0.0, np.eye(3).ravel(), np.zeros(LENS - 13)], rows]))


def _padded(batch: pa.RecordBatch, rig: Rig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Camera numbers, pixels and which are there, of the views (lists cams, us, vs) of each row of a batch."""
    size = batch.column("cams").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    use = np.arange(max(2, size.max(initial=0))) < size[:, None]
    cams, pixels = np.zeros(use.shape, int), np.full((*use.shape, 2), np.nan)
    if rig.names:
        names = batch.column("cams").flatten().dictionary_encode()
        number = {n: k for k, n in enumerate(rig.names)}
        cams[use] = np.array([number[x] for x in names.dictionary.to_pylist()], int)[names.indices.to_numpy(zero_copy_only=False)]
    else:
        cams[use] = np.arange(1, size.sum() + 1)
    for k, c in enumerate(("us", "vs")):
        pixels[use, k] = batch.column(c).flatten().to_numpy(zero_copy_only=False)
    return cams, pixels, use


def triangulate(views: DataFrame, rig: Rig | DataFrame | None, keys: list[str], *, reject_px: float | None = None, rounds: int = 2) -> DataFrame:
    """Points x, y, z of each key from its views (camera, u, v), with the residual (lower median over views), the views used, and those rejected.

    Without a rig every view brings its own camera in a column lens, as cameras that move and tables of many rigs need. A
    table of cameras (the rows of Rig.collect) is joined to the views, however many there are.
    With reject_px, views farther off than that and than five times the point's median are left out and the point is solved again.
    """
    views, rig = _with_cameras(views, rig)
    schema = views.select(*keys).schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)

    arrow = to_arrow_schema(views.sparkSession.createDataFrame([], f"{fields}, x double, y double, z double, residual double, n_views long, n_rejected long").schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            here = _own_rig(batch.column("lens")) if rig is None else rig
            cams, pixels, use = _padded(batch, here)
            given, rays = use.sum(axis=1), here.view_rays(pixels, cams, use)
            points = here.triangulate(pixels, cams, use, rays)
            for _ in range(rounds if reject_px is not None else 0):
                e = here.errors(points, pixels, cams, use)
                far = e > np.maximum(reject_px, 5 * _lower_median(e))[:, None]
                use = use & ~far
                points = here.again(points, pixels, cams, use, rays, far.any(axis=1))
            found = [*points.T, _lower_median(here.errors(points, pixels, cams, use)), use.sum(axis=1), given - use.sum(axis=1)]
            own = [batch.column(k).cast(arrow.field(k).type) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, f.type) for x, f in zip(found, list(arrow)[len(keys) :], strict=True))], schema=arrow)

    found = _views(views, keys, rig is None).mapInArrow(solve, f"{fields}, x double, y double, z double, residual double, n_views long, n_rejected long")
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y", "z", "residual")})


class Rejections(NamedTuple):
    """What rejection leaves: points; the views that were rejected (keys, camera, u, v, error in pixels); the views that stay."""

    points: DataFrame
    rejected: DataFrame
    kept: DataFrame


def triangulate_rejecting(views: DataFrame, rig: Rig | DataFrame | None, keys: list[str], reject_px: float, rounds: int = 2) -> Rejections:
    """triangulate with reject_px, and the views that it leaves out as rows of their own: one pass writes points and views under a tag, which are split afterwards. error is the distance in the round that rejected the view."""
    views, rig = _with_cameras(views, rig)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in views.select(*keys).schema)
    schema = views.sparkSession.createDataFrame([], f"{fields}, kind string, camera string, x double, y double, z double, residual double, n_views long, n_rejected long, u double, v double, error double").schema
    arrow = to_arrow_schema(schema)

    def tagged_rows(kind: str, own: list[pa.Array], **columns: object) -> pa.RecordBatch:
        n = len(own[0])
        rest = [pa.array([kind] * n) if f.name == "kind" else (columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type, from_pandas=True)) if f.name in columns else pa.nulls(n, f.type) for f in list(arrow)[len(keys) :]]
        return pa.RecordBatch.from_arrays([*own, *rest], schema=arrow)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            own = [rows.column(k).cast(arrow.field(k).type) for k in keys]
            here = _own_rig(rows.column("lens")) if rig is None else rig
            cams, pixels, use = _padded(rows, here)
            given, error, rays = use.copy(), np.full(use.shape, np.nan), here.view_rays(pixels, cams, use)
            camera = rows.column("cams").flatten()
            points = here.triangulate(pixels, cams, use, rays)
            for _ in range(rounds):
                e = here.errors(points, pixels, cams, use)
                far = e > np.maximum(reject_px, 5 * _lower_median(e))[:, None]
                error[far] = e[far]
                use = use & ~far
                points = here.again(points, pixels, cams, use, rays, far.any(axis=1))
            left = _lower_median(here.errors(points, pixels, cams, use))
            yield tagged_rows("point", own, x=points[:, 0], y=points[:, 1], z=points[:, 2], residual=left, n_views=use.sum(axis=1), n_rejected=given.sum(axis=1) - use.sum(axis=1))
            for kind, of in (("rejected", given & ~use), ("kept", use)):
                row, view = np.nonzero(of)
                if len(row):
                    names = camera.take(pa.array(np.flatnonzero(of[given])))
                    yield tagged_rows(kind, [c.take(pa.array(row)) for c in own], camera=names, u=pixels[row, view, 0], v=pixels[row, view, 1], error=error[row, view])

    tagged = _views(views, keys, rig is None).mapInArrow(solve, schema)
    tagged = materialize(tagged, "rejections")
    points = tagged.where("kind = 'point'").select(*keys, "x", "y", "z", "residual", "n_views", "n_rejected")
    seen = lambda kind, *more: tagged.where(F.col("kind") == kind).select(*keys, "camera", "u", "v", *more)
    return Rejections(points, seen("rejected", "error"), seen("kept"))


def emptied_boxes(boxes: DataFrame, found: Rejections, keys: list[str]) -> DataFrame:
    """Boxes (keys, camera: an animal in a view) that have lost every view of a point: there was one, and none stays."""
    at = [*keys, "camera"]
    lost = found.rejected.select(*at).distinct().join(found.kept.select(*at).distinct(), at, "left_anti")
    return boxes.join(lost, at, "left_semi")


def triangulate_gated(views: DataFrame, rig: Rig, keys: list[str], gate: float) -> DataFrame:
    """Status of each point: visible with at least two views within the gate, missing where every camera looked and none saw it, and no row else."""
    looked = views.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_looked"))
    found = triangulate(views, rig, keys).join(looked, keys)
    visible = (F.col("n_views") >= 2) & (F.col("residual") <= gate)
    missing = (F.col("n_views") == 0) & (F.col("n_looked") == len(rig.names))
    status = F.when(visible, "visible").when(missing, "missing")
    return found.withColumn("status", status).where("status is not null").select(*keys, "status", *(F.when(visible, F.col(c)).alias(c) for c in "xyz"), "n_views")


def residual(points: DataFrame, keys: list[str]) -> DataFrame:
    """The lower median over views of the distance between projection (pu, pv) and view (u, v)."""
    d = F.hypot(F.col("pu") - F.col("u"), F.col("pv") - F.col("v"))
    return points.groupBy(*keys).agg(F.percentile_approx(d, 0.5, 1_000_000).alias("residual"))


def check_variants_equal(variants: DataFrame, base: DataFrame) -> DataFrame:
    """Rows of a variant that its original lacks, and the other way round."""
    names = base.columns
    return variants.select(*names).exceptAll(base).withColumn("side", F.lit("variant")).unionByName(base.exceptAll(variants.select(*names)).withColumn("side", F.lit("base")))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys in as many tasks as a shuffle has. Adaptive execution would put small ones together, but a solver takes far longer than its rows' bytes tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class View(NamedTuple):
    """The detections of one frame: camera numbers, centres, and the rays through those if they are known."""

    cams: np.ndarray
    centres: np.ndarray
    rays: np.ndarray | None = None


def associate(rig: Rig, view: View, max_res: float, min_views: int = 2, max_n: int = 0, free: np.ndarray | None = None, corroborate: bool = True) -> list[tuple[np.ndarray, float, list[int]]]:
    """Detections of one frame as instances (point, residual, members).

    Every pair of detections in two cameras is a candidate, solved at once. Candidates that more of the other
    cameras support come first (unless corroborate is off), then those of a smaller residual; each takes the nearest free detection of every other camera
    and stays if its refitted residual is within the gate. With min_views 1 what is left over becomes an instance without a point. Detections without a centre are never used.
    """
    n = len(view.cams)
    free = (np.ones(n, bool) if free is None else free) & np.isfinite(view.centres).all(axis=1)
    here = np.flatnonzero(free)
    a, b = (x.ravel() for x in np.meshgrid(here, here, indexing="ij"))
    pair = view.cams[a] < view.cams[b]
    a, b = a[pair], b[pair]
    out: list[tuple[np.ndarray, float, list[int]]] = []
    if len(a):
        # A detection's ray serves all of its pairs.
        rays = rig.rays(view.centres, view.cams) if view.rays is None else view.rays

        def solved(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            use = np.ones(ids.shape, bool)
            points = rig.triangulate(view.centres[ids], view.cams[ids], use, rays[ids])
            return points, _lower_median(rig.errors(points, view.centres[ids], view.cams[ids], use))

        two = np.stack([a, b], axis=1)
        points, res = solved(two)
        good = np.isfinite(points).all(axis=1) & (res <= max_res)
        two, points, res = two[good], points[good], res[good]
        # Distances of all detections from each candidate's projections; of each camera the nearest, if it is near, and whether it has one that supports.
        far, known = np.full((len(two), n), np.inf), np.unique(view.cams)
        nearest, support = np.full((len(two), len(known)), -1), np.zeros(len(two), int)
        for j, c in enumerate(known):
            own = np.flatnonzero(view.cams == c)
            seen = rig.project(points, np.full(len(points), c))
            far[:, own] = np.linalg.norm(seen[:, None] - view.centres[None, own], axis=2)
            far[:, own] = np.where(np.isfinite(far[:, own]), far[:, own], np.inf)
            other, own = (view.cams[two] != c).all(axis=1), own[free[own]]
            if len(own):
                first = far[:, own].argmin(axis=1)
                near = other & (far[np.arange(len(two)), own[first]] < max_res)
                nearest[near, j] = own[first[near]]
                support += near
            for k in (0, 1):
                nearest[view.cams[two[:, k]] == c, j] = two[view.cams[two[:, k]] == c, k]
        # Refitted at once with the members that are nearest of all; whose members are taken by then is solved again.
        refit, residual = np.full((len(two), 3), np.nan), np.full(len(two), np.nan)
        count = (nearest >= 0).sum(axis=1)
        for v in np.unique(count):
            rows = count == v
            refit[rows], residual[rows] = solved(nearest[rows][nearest[rows] >= 0].reshape(-1, v))
        order = np.lexsort((np.arange(len(two)), res, -support if corroborate else np.zeros(len(two))))
        pairs, members_of, fits = two.tolist(), nearest.tolist(), residual.tolist()
        for k in order.tolist():
            if not (free[pairs[k][0]] and free[pairs[k][1]]):
                continue
            ids, point, fit = [d for d in members_of[k] if d >= 0], refit[k], fits[k]
            if not all(free[d] for d in ids):
                ids = []
                for j, c in enumerate(known):
                    d = members_of[k][j]
                    if d >= 0 and not free[d]:
                        own = np.flatnonzero((view.cams == c) & free)
                        d = int(own[far[k, own].argmin()]) if len(own) and far[k, own].min() < max_res else -1
                    ids += [d] if d >= 0 else []
                again, left = solved(np.array([ids]))
                point, fit = again[0], float(left[0])
            if not fit <= max_res:
                continue
            out.append((point, fit, ids))
            free[ids] = False
            if max_n and len(out) >= max_n:
                return out
    if min_views == 1:
        for d in np.flatnonzero(free):
            if max_n and len(out) >= max_n:
                break
            out.append((np.full(3, np.nan), float("inf"), [int(d)]))
    return out


def associate_frames(dets: DataFrame, rig: Rig | None, max_res: float, min_views: int = 2, bucket: int = 512, *, max_n: int = 0, corroborate: bool = True, poses: DataFrame | None = None) -> DataFrame:
    """Detections (group_id, frame, camera, det, cx, cy) as rows (group_id, frame, instance, x, y, z, residual, camera, det).

    poses (group_id, frame, camera, rotation[9], translation[3]) moves the rig: in frames that it names a camera
    stands there, in others where the rig has it. Without a rig every detection brings its camera in a column lens. At most max_n instances a frame, if that is not 0.
    """
    number = None if rig is None else {c: k for k, c in enumerate(rig.names)}
    moving = rig is not None and poses is not None

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = rows.sort_values(["frame", "camera", "det"])
        group, frames, cameras, det = rows["group_id"].iloc[0], rows["frame"].to_numpy(), rows["camera"].to_numpy(object), rows["det"].to_numpy()
        centres = rows[["cx", "cy"]].to_numpy(float)
        rays = None if rig is None or moving else rig.rays(centres, np.array([number[c] for c in cameras], int))
        for a, b in pairwise([0, *np.flatnonzero(frames[1:] != frames[:-1]) + 1, len(rows)]):
            if rig is None:
                names, first, cams = np.unique(cameras[a:b], return_index=True, return_inverse=True)
                here = Rig.of_lenses(list(names), np.array([rows["lens"].iloc[a + k] for k in first], float))
            else:
                cams = np.array([number[c] for c in cameras[a:b]], int)
                here = rig.moved(cams, rows["rotation"].iloc[a:b].tolist(), rows["translation"].iloc[a:b].tolist()) if moving else rig
            for k, (p, res, members) in enumerate(associate(here, View(cams, centres[a:b], None if rays is None else rays[a:b]), max_res, min_views, max_n, corroborate=corroborate)):
                out += [(group, frames[a], k, *p, res, cameras[a + d], det[a + d]) for d in members]
        return pd.DataFrame(out, columns=["group_id", "frame", "instance", "x", "y", "z", "residual", "camera", "det"])

    more = ["lens"] if rig is None else []
    own = dets.select("group_id", "frame", "camera", F.col("det").cast("int").alias("det"), "cx", "cy", *more, F.floor(F.col("frame") / bucket).alias("bucket"))
    if moving:
        own = own.join(poses.select("group_id", "frame", "camera", "rotation", "translation"), ["group_id", "frame", "camera"], "left")
    return dealt(own, "group_id", "bucket").groupBy("group_id", "bucket").applyInPandas(solve, "group_id string, frame int, instance int, x double, y double, z double, residual double, camera string, det int")
