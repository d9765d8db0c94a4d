"""Boxes, crops and cameras as expressions over columns. Coordinates are doubles; null means absent."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-7
CROP_PAD = 20
CROP_SIDE = 64


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def named(cls, prefix: str = "", suffix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{n}{suffix}") for n in cls._fields))

    def columns(self, prefix: str = "") -> dict[str, Column]:
        return {f"{prefix}{n}": c for n, c in zip(self._fields, self, strict=True)}

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def centre(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2

    @property
    def mean_side(self) -> Column:
        return (self.width + self.height) / 2

    @property
    def area(self) -> Column:
        return F.greatest(self.width, F.lit(0.0)) * F.greatest(self.height, F.lit(0.0))

    @property
    def is_box(self) -> Column:
        """Present and of positive area."""
        return F.coalesce((self.x1 > self.x0) & (self.y1 > self.y0), F.lit(False))


def clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    """Null stays null (least and greatest alone would skip it)."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def padded_extent(points: Box, w: float, h: float, pad: float = CROP_PAD) -> Box:
    """The extent of points (as their minima and maxima), padded, clamped to the image and truncated."""
    return Box(*(F.floor(clamp(v + s * pad, 0.0, float(m))).cast("int") for v, s, m in zip(points, (-1, -1, 1, 1), (w, h, w, h), strict=True)))


def crop_box(points: Box, w: int, h: int, min_dim: int = CROP_SIDE, pad: float = CROP_PAD) -> Box:
    """The square crop around points, at least min_dim a side and never larger than the image."""
    b = padded_extent(points, w, h, pad)
    base = F.greatest(F.lit(min_dim), b.width, b.height)

    def axis(lo: Column, hi: Column, most: int) -> tuple[Column, Column]:
        side = F.least(base, F.lit(most))
        start = clamp(F.floor((lo + hi) / 2) - F.floor(side / 2), F.lit(0), F.lit(most) - side)
        short = (hi - lo) < side
        return F.when(short, start).otherwise(lo).cast("int"), F.when(short, start + side).otherwise(hi).cast("int")

    x0, x1 = axis(b.x0, b.x1, w)
    y0, y1 = axis(b.y0, b.y1, h)
    return Box(x0, y0, x1, y1)


def box_corners(b: Box) -> Column:
    """All four corners: two would be too few under a rotation."""
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((b.x0, b.y0), (b.x1, b.y0), (b.x1, b.y1), (b.x0, b.y1))))


def inflate_box(b: Box, w: int, h: int, factor: float) -> Box:
    """Scaled about its centre, clamped, rounded half to even; a factor of 1 changes nothing."""
    if factor == 1.0:
        return Box(*(v.cast("int") for v in b))
    cx, cy = b.centre
    hw, hh = b.width * (factor / 2), b.height * (factor / 2)
    return Box(*(F.bround(v).cast("int") for v in (F.greatest(F.lit(0.0), cx - hw), F.greatest(F.lit(0.0), cy - hh), F.least(F.lit(float(w)), cx + hw), F.least(F.lit(float(h)), cy + hh))))


def jitter_box(b: Box, w: int, h: int, scale: tuple[Column, float], shift_x: tuple[Column, float], shift_y: tuple[Column, float]) -> Box:
    """Moved and scaled by draws in [0, 1) with their largest effects; a result under 8 px leaves the box as it was."""
    span = lambda u, most: (u * 2 - 1) * most
    s = F.lit(1.0) + span(*scale)
    cx, cy = b.centre
    cx, cy = cx + b.width * span(*shift_x), cy + b.height * span(*shift_y)
    hw, hh = b.width * s / 2, b.height * s / 2
    moved = Box(*(F.floor(clamp(v, 0.0, float(m))).cast("int") for v, m in zip((cx - hw, cy - hh, cx + hw, cy + hh), (w, h, w, h), strict=True)))
    small = (moved.width < 8) | (moved.height < 8)
    return Box(*(F.when(small, old.cast("int")).otherwise(new) for old, new in zip(b, moved, strict=True)))


def box_iou(a: Box, b: Box) -> Column:
    w = F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.lit(0.0))
    h = F.greatest(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0), F.lit(0.0))
    return w * h / (a.area + b.area - w * h + EPS)


def giou_loss(a: Box, b: Box) -> Column:
    """One less the generalised IoU."""
    w = F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.lit(0.0))
    h = F.greatest(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0), F.lit(0.0))
    union = a.area + b.area - w * h + EPS
    hull = F.greatest(F.greatest(a.x1, b.x1) - F.least(a.x0, b.x0), F.lit(0.0)) * F.greatest(F.greatest(a.y1, b.y1) - F.least(a.y0, b.y0), F.lit(0.0)) + EPS
    return F.lit(1.0) - (w * h / union - (hull - union) / hull)


def center_dist(a: Box, b: Box) -> Column:
    """Distance of the centres in units of the pair's mean side."""
    (ax, ay), (bx, by) = a.centre, b.centre
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) / F.greatest((a.mean_side + b.mean_side) / 2, F.lit(EPS))


def overlaps(a: Box, b: Box) -> Column:
    """Whether two boxes share positive area; an absent one shares none."""
    return F.coalesce((F.least(a.x1, b.x1) > F.greatest(a.x0, b.x0)) & (F.least(a.y1, b.y1) > F.greatest(a.y0, b.y0)), F.lit(False))


class Letterbox(NamedTuple):
    """A source pixel p goes to p * scale + pad."""

    scale: Column
    pad_x: Column
    pad_y: Column

    @classmethod
    def fit(cls, w: Column, h: Column, out_w: int, out_h: int) -> Letterbox:
        scale = F.least(F.lit(float(out_w)) / w, F.lit(float(out_h)) / h)
        return cls(scale, F.floor((out_w - F.bround(w * scale)) / 2), F.floor((out_h - F.bround(h * scale)) / 2))

    @classmethod
    def tile(cls, origin_x: Column, origin_y: Column, scale: Column) -> Letterbox:
        return cls(scale, -origin_x * scale, -origin_y * scale)

    def box(self, b: Box) -> Box:
        return Box(b.x0 * self.scale + self.pad_x, b.y0 * self.scale + self.pad_y, b.x1 * self.scale + self.pad_x, b.y1 * self.scale + self.pad_y)

    def source_box(self, b: Box, w: Column, h: Column) -> Box:
        """Back in source pixels and inside the frame; what has no area there is no box."""
        raw = Box((b.x0 - self.pad_x) / self.scale, (b.y0 - self.pad_y) / self.scale, (b.x1 - self.pad_x) / self.scale, (b.y1 - self.pad_y) / self.scale)
        own = Box(*(clamp(v, F.lit(0.0), m) for v, m in zip(raw, (w, h, w, h), strict=True)))
        return Box(*(F.when(own.is_box, v) for v in own))

    def source_point(self, x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
        """Back in source pixels; a point outside the frame is dropped, not moved to the border."""
        px, py = (x - self.pad_x) / self.scale, (y - self.pad_y) / self.scale
        inside = px.between(F.lit(0.0), w) & py.between(F.lit(0.0), h)
        return F.when(inside, px), F.when(inside, py)


def apply_affine(x: Column, y: Column, m: tuple[tuple[float, float, float], tuple[float, float, float]]) -> tuple[Column, Column]:
    (a, b, c), (d, e, f) = m
    return x * a + y * b + c, x * d + y * e + f


def rotate_z(x: Column, y: Column, cos: Column, sin: Column) -> tuple[Column, Column]:
    """A turn about the vertical axis, the same for points and cameras of a scene."""
    return x * cos - y * sin, x * sin + y * cos


#: Lens models: what a calibration may name. Fisheye is the equidistant one.
MODELS = ("pinhole", "fisheye")


class Camera(NamedTuple):
    """Camera columns: focal lengths, centre, rotation matrix rows, translation, distortion, offset, and whether the lens is a fisheye.

    A pinhole's distortion is (k1, k2, p1, p2, k3). A fisheye is equidistant: a ray at angle t from the axis lands at
    t (1 + k1 t^2 + k2 t^4 + k3 t^6 + k4 t^8) from the centre, with k1 to k4 the first four numbers.
    """

    fx: Column
    fy: Column
    cx: Column
    cy: Column
    r: tuple[Column, ...]
    t: tuple[Column, Column, Column]
    k: tuple[Column, Column, Column, Column, Column]
    offset_x: Column
    offset_y: Column
    fisheye: Column | None = None


def is_fisheye(model: Column) -> Column:
    """Of a model's name; an error where it is not one of MODELS (or is null)."""
    unknown = F.raise_error(F.concat(F.lit("unknown lens model: "), F.coalesce(model, F.lit("null")))).cast("boolean")
    return F.when(model == "fisheye", F.lit(True)).when(model == "pinhole", F.lit(False)).otherwise(unknown)


def _angle_series(t2: Column, k: tuple[Column, ...], powers: tuple[int, ...] = (1, 1, 1, 1)) -> Column:
    """1 + k1 t^2 + k2 t^4 + k3 t^6 + k4 t^8, each term times a power for the derivative."""
    k1, k2, k3, k4 = (F.lit(float(p)) * c for p, c in zip(powers, k[:4], strict=True))
    return F.lit(1.0) + t2 * (k1 + t2 * (k2 + t2 * (k3 + t2 * k4)))


def rodrigues(rx: Column, ry: Column, rz: Column) -> tuple[Column, ...]:
    """Nine entries of the rotation matrix of a rotation vector."""
    angle = F.sqrt(rx * rx + ry * ry + rz * rz)
    safe = F.when(angle > 1e-12, angle).otherwise(F.lit(1.0))
    x, y, z = rx / safe, ry / safe, rz / safe
    c, s = F.cos(angle), F.sin(angle)
    v = F.lit(1.0) - c
    return c + x * x * v, x * y * v - z * s, x * z * v + y * s, y * x * v + z * s, c + y * y * v, y * z * v - x * s, z * x * v - y * s, z * y * v + x * s, c + z * z * v


def to_camera(x: Column, y: Column, z: Column, cam: Camera) -> tuple[Column, Column, Column]:
    r, t = cam.r, cam.t
    return r[0] * x + r[1] * y + r[2] * z + t[0], r[3] * x + r[4] * y + r[5] * z + t[1], r[6] * x + r[7] * y + r[8] * z + t[2]


def project(df: DataFrame, cam: Camera, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """df with u, v: pixels in the camera's stored image; a point behind the camera has none.

    Each step is a column of its own, so that the next one does not repeat its expression.
    """
    px, py, pz = to_camera(F.col(x), F.col(y), F.col(z), cam)
    own = df.withColumns({"_px": px, "_py": py, "_pz": F.when(pz > 0, pz)})
    own = own.withColumns({"_a": F.col("_px") / F.col("_pz"), "_b": F.col("_py") / F.col("_pz")})
    own = _bend(own, cam)
    return own.withColumns({"u": cam.fx * F.col("_ud") + cam.cx - cam.offset_x, "v": cam.fy * F.col("_vd") + cam.cy - cam.offset_y}).drop("_px", "_py", "_pz", "_a", "_b", "_ud", "_vd")


def _bend(own: DataFrame, cam: Camera) -> DataFrame:
    """Where the lens bends the directions _a, _b to: _ud, _vd."""
    k1, k2, p1, p2, k3 = cam.k
    a, b, r2 = F.col("_a"), F.col("_b"), F.col("_r2")
    own = own.withColumn("_r2", a * a + b * b)
    own = own.withColumn("_radial", F.lit(1.0) + r2 * (k1 + r2 * (k2 + r2 * k3)))
    ud = a * F.col("_radial") + F.lit(2.0) * p1 * a * b + p2 * (r2 + F.lit(2.0) * a * a)
    vd = b * F.col("_radial") + p1 * (r2 + F.lit(2.0) * b * b) + F.lit(2.0) * p2 * a * b
    if cam.fisheye is not None:
        own = own.withColumn("_r", F.sqrt(r2)).withColumn("_t", F.atan("_r"))
        t, r = F.col("_t"), F.col("_r")
        own = own.withColumn("_scale", F.when(r > 1e-12, t * _angle_series(t * t, cam.k) / r).otherwise(F.lit(1.0)))
        ud, vd = F.when(cam.fisheye, a * F.col("_scale")).otherwise(ud), F.when(cam.fisheye, b * F.col("_scale")).otherwise(vd)
    return own.withColumns({"_ud": ud, "_vd": vd}).drop("_r2", "_radial", "_r", "_t", "_scale")


def unproject(df: DataFrame, cam: Camera, u: str = "u", v: str = "v", rounds: int = 20) -> DataFrame:
    """df with a, b: the direction (a, b, 1) in the camera's frame that lands on a pixel; none where there is no such direction.

    A pinhole's lens is undone by fixed-point steps, a fisheye's by Newton's on the angle; the steps are a fold, so that the plan stays small.
    """
    own = df.withColumns({"_wu": (F.col(u) + cam.offset_x - cam.cx) / cam.fx, "_wv": (F.col(v) + cam.offset_y - cam.cy) / cam.fy})
    wu, wv = F.col("_wu"), F.col("_wv")
    k1, k2, p1, p2, k3 = cam.k
    steps = F.sequence(F.lit(1), F.lit(rounds))

    def bent(a: Column, b: Column) -> tuple[Column, Column]:
        r2 = a * a + b * b
        radial = F.lit(1.0) + r2 * (k1 + r2 * (k2 + r2 * k3))
        return a * radial + F.lit(2.0) * p1 * a * b + p2 * (r2 + F.lit(2.0) * a * a), b * radial + p1 * (r2 + F.lit(2.0) * b * b) + F.lit(2.0) * p2 * a * b

    def step(s: Column, _: Column) -> Column:
        ud, vd = bent(s["a"], s["b"])
        return F.struct((s["a"] + wu - ud).alias("a"), (s["b"] + wv - vd).alias("b"))

    own = own.withColumn("_p", F.aggregate(steps, F.struct(wu.alias("a"), wv.alias("b")), step))
    ud, vd = bent(F.col("_p.a"), F.col("_p.b"))
    met = F.hypot(ud - wu, vd - wv) < 1e-6
    a, b = F.when(met, F.col("_p.a")), F.when(met, F.col("_p.b"))
    if cam.fisheye is not None:
        own = own.withColumn("_d", F.hypot(wu, wv))
        t, d = F.col("_t"), F.col("_d")
        gap = lambda x: x * _angle_series(x * x, cam.k) - d
        own = own.withColumn("_t", F.aggregate(steps, F.least(d, F.lit(1.5)), lambda x, _: x - gap(x) / _angle_series(x * x, cam.k, (3, 5, 7, 9))))
        there = (F.abs(gap(t)) < 1e-9) & (t >= 0) & (t < F.lit(1.5707963))
        own = own.withColumn("_f", F.when(there, F.when(d > 1e-12, F.tan(t) / d).otherwise(F.lit(1.0))))
        a, b = F.when(cam.fisheye, wu * F.col("_f")).otherwise(a), F.when(cam.fisheye, wv * F.col("_f")).otherwise(b)
    return own.withColumns({"a": a, "b": b}).drop("_wu", "_wv", "_p", "_d", "_t", "_f")


def crop_camera(offset_x: Column, offset_y: Column, b: Box) -> tuple[Column, Column, Column, Column]:
    """Offset and size of the camera of a crop."""
    return offset_x + b.x0, offset_y + b.y0, b.width, b.height


def resize_factor(w: Column, h: Column, target: float) -> Column:
    return F.lit(target) / F.greatest(w, h)


def resized_side(side: Column, factor: Column) -> Column:
    return F.greatest(F.bround(side * factor), F.lit(1.0)).cast("int")


def inscribe_rect(b: Box, angle: float, scale: float, m) -> Box:
    """The largest upright rectangle inside a rectangle turned by angle: a certified area may only shrink."""
    import math

    s, c = abs(math.sin(angle)), abs(math.cos(angle))
    cx, cy = apply_affine(*b.centre, m)
    w, h = b.width * scale, b.height * scale
    if s <= 1e-9:
        cw, ch = w, h
    else:
        long_, short = F.greatest(w, h), F.least(w, h)
        thin = (short <= long_ * (2 * s * c)) if abs(s - c) >= 1e-10 else F.lit(True)
        half, wide = short / 2, w >= h
        denominator = c * c - s * s
        denominator = denominator if abs(denominator) > 1e-12 else 1e-12
        cw = F.when(thin, F.when(wide, half / max(s, 1e-12)).otherwise(half / max(c, 1e-12))).otherwise((w * c - h * s) / denominator)
        ch = F.when(thin, F.when(wide, half / max(c, 1e-12)).otherwise(half / max(s, 1e-12))).otherwise((h * c - w * s) / denominator)
    return Box(cx - cw / 2, cy - ch / 2, cx + cw / 2, cy + ch / 2)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))


def even_span(span: Column, ceiling: int) -> Column:
    """The next even number, from 2 to the ceiling's even part."""
    return F.least(F.greatest(span + span % 2, F.lit(2)), F.lit(max(2, ceiling - ceiling % 2)))
