"""Windows over frames: steps, runs, window placement, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinefold.functions.random import draw_sql
from kinefold.operators.joins import distance


def _track(*keys: str):
    return Window.partitionBy(*keys).orderBy("frame")


def steps(points: DataFrame, *keys: str) -> DataFrame:
    """Displacement of each point from the frame before; a gap gives none."""
    w = _track(*keys)
    before = F.lag(F.struct("frame", "x", "y")).over(w)
    d = distance(F.col("x"), F.col("y"), F.col("before.x"), F.col("before.y"))
    return points.withColumn("before", before).withColumn("step", F.when(F.col("frame") - F.col("before.frame") == 1, d)).drop("before")


def id_switches(matches: DataFrame) -> DataFrame:
    """Matches (group, frame, i, j) with switched: j's last matched prediction was another one."""
    last = F.lag("i").over(Window.partitionBy("group_id", "j").orderBy("frame"))
    return matches.withColumn("switched", F.coalesce(last != F.col("i"), F.lit(False)))


def window_starts(n: Column, length: int, overlap: int, start: int = 0) -> Column:
    """Starts of windows over n frames; the last one is pulled back to end exactly."""
    step = max(1, length - overlap)
    last = n - length
    several = F.array_union(F.sequence(F.lit(start), F.greatest(last, F.lit(start)), F.lit(step)), F.array(last))
    return F.when(n - start <= length, F.array(F.lit(start))).otherwise(several)


def eval_windows(labels: DataFrame, n_frames: DataFrame, length: int, stride: int) -> DataFrame:
    """Window starts that cover each animal's labels: from half a window before the first, every stride, clipped to the clip."""
    span = labels.groupBy("group_id", "animal").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi")).join(n_frames, "group_id")
    top = F.greatest(F.col("n_frames") - length, F.lit(0))
    first = F.least(F.greatest(F.col("lo") - length // 2, F.lit(0)), top)
    starts = F.transform(F.sequence(first, F.greatest(F.col("hi"), first), F.lit(stride)), lambda s: F.least(s, top))
    return span.select("group_id", "animal", F.explode(F.array_distinct(starts)).alias("start"))


def train_window(labels: DataFrame, n_frames: DataFrame, length: int, max_stride: int, seed: int) -> DataFrame:
    """One window for each (group, animal): stride, an anchor on a label, a span shrunk to what labels reach on the anchor's lattice (even, at least 2), and its place so that it covers the anchor."""
    keys = ("CAST(substr(group_id, 2) AS BIGINT)", "CAST(animal AS BIGINT)")
    frames = labels.groupBy("group_id", "animal").agg(F.array_sort(F.collect_set("frame")).alias("frames")).join(n_frames, "group_id")
    drawn = frames.withColumn("stride", (F.floor(F.expr(draw_sql(seed, *keys)) * max_stride) + 1).cast("int"))
    drawn = drawn.withColumn("anchor", F.element_at("frames", (F.floor(F.expr(draw_sql(seed + 1, *keys)) * F.size("frames")) + 1).cast("int")))
    lattice = F.filter("frames", lambda f: (F.abs(f - F.col("anchor")) % F.col("stride") == 0) & (F.abs(f - F.col("anchor")) < F.lit(length) * F.col("stride")))
    drawn = drawn.withColumn("lo", F.array_min(lattice)).withColumn("hi", F.array_max(lattice))
    span = ((F.col("hi") - F.col("lo")) / F.col("stride")).cast("int") + 1
    size = F.least(F.greatest(span + span % 2, F.lit(2)), F.lit(length))
    drawn = drawn.withColumn("size", size)
    earliest = F.greatest(F.col("anchor") - (F.col("size") - 1) * F.col("stride"), F.col("lo") - (F.col("size") - 1) * F.col("stride"))
    slots = ((F.col("anchor") - earliest) / F.col("stride")).cast("int")
    back = (F.floor(F.expr(draw_sql(seed + 2, *keys)) * (slots + 1))).cast("int")
    return drawn.select("group_id", "animal", "stride", "anchor", "size", (F.col("anchor") - back * F.col("stride")).alias("start"), "n_frames")


def gap_runs(frames: DataFrame, max_gap: int, *keys: str) -> DataFrame:
    """Runs of frames without a gap over max_gap; a run is named by its first frame."""
    w = _track(*keys)
    cut = (F.col("frame") - F.lag("frame").over(w) > max_gap).cast("int")
    numbered = frames.withColumn("run", F.sum(F.coalesce(cut, F.lit(0))).over(w))
    first = F.min("frame").over(Window.partitionBy(*keys, "run"))
    return numbered.withColumn("run_id", F.format_string("%06d", first)).drop("run")


def centred_window(frame: Column, n: Column, context: int) -> tuple[Column, Column]:
    """Start and length of the window of context frames to both sides, kept inside the clip."""
    length = F.least(F.lit(2 * context + 1), n)
    return F.greatest(F.least(frame - context, n - length), F.lit(0)), length


def last_window_owns(rows: DataFrame, *keys: str) -> DataFrame:
    """Of a frame that lies in several windows, the row of the last one."""
    w = Window.partitionBy(*keys).orderBy(F.desc("win"))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def cap_frames(frames: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n frames of each clip, chosen by a seeded draw; 0 keeps all."""
    if n == 0:
        return frames
    order = F.expr(draw_sql(seed, "CAST(substr(group_id, 2) AS BIGINT)", "CAST(frame AS BIGINT)"))
    return frames.withColumn("_rank", F.row_number().over(Window.partitionBy("group_id").orderBy(order, "frame"))).where(F.col("_rank") <= n).drop("_rank")


def spread_frames(frames: DataFrame, cap: int) -> DataFrame:
    """Evenly spaced frames: those at int(linspace(0, m - 1, cap)) of each clip's m."""
    w = Window.partitionBy("group_id")
    ranked = frames.withColumn("r", F.row_number().over(w.orderBy("frame")) - 1).withColumn("m", F.count(F.lit(1)).over(w))
    top = F.col("m") - 1
    k = F.ceil(F.col("r") * (cap - 1) / F.greatest(top, F.lit(1)))
    hit = (F.floor(k * top / (cap - 1)) == F.col("r")) & (k <= cap - 1)
    return ranked.where((F.col("m") <= cap) | hit).drop("r", "m")


def first_labelled(points: DataFrame, *keys: str) -> DataFrame:
    """The first frame at which each keypoint has a position, 0 if none, and the pose there."""
    here = F.col("x").isNotNull() & F.col("y").isNotNull()
    return points.groupBy(*keys).agg(F.coalesce(F.min(F.when(here, F.col("frame"))), F.lit(0)).alias("first_frame"), F.min_by("x", F.when(here, F.col("frame"))).alias("x"), F.min_by("y", F.when(here, F.col("frame"))).alias("y"))


def follow(centres: DataFrame, zoom: int, w: int, h: int, smooth: int = 15) -> DataFrame:
    """Corner of a window that follows a clip's centre (group, frame, x, y) in every frame from its first row to its last: gaps and frames without a row interpolated, then a moving average whose edges repeat, clamped to the image.

    What a frame's values follow from is found on the rows as they come; frames without a row are added after that, so they are sorted once and never shuffled.
    """
    track, clip = _track("group_id"), Window.partitionBy("group_id")
    whole = track.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # What follows is looked for backwards: a frame of rows that reaches to a clip's end is read again for every row.
    before, after = track.rowsBetween(Window.unboundedPreceding, 0), clip.orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("x").isNotNull(), F.struct("frame", "x", "y"))
    own = centres.withColumns({"a": F.last(known, ignorenulls=True).over(before), "later": F.last(known, ignorenulls=True).over(after), "next": F.lead("frame").over(track), "lo": F.min("frame").over(clip), "hi": F.max("frame").over(clip)})
    own = own.withColumn("b", F.coalesce(known, F.col("later")))

    def filled(c: str, at: Column, b: Column, otherwise: float) -> Column:
        a = F.col("a")
        part = (at - a["frame"]) / F.greatest(b["frame"] - a["frame"], F.lit(1))
        return F.coalesce(a[c] + part * (b[c] - a[c]), a[c], b[c], F.lit(otherwise))

    middle = {"x": w / 2, "y": h / 2}
    for c, otherwise in middle.items():
        here = filled(c, F.col("frame"), F.col("b"), otherwise)
        own = own.withColumns({f"{c}_first": F.first(here).over(whole), f"{c}_last": F.last(here).over(whole)})
    own = own.withColumn("at", F.explode(F.sequence("frame", F.coalesce(F.col("next") - 1, F.col("frame")))))
    half = smooth // 2
    head, tail = F.greatest(half - (F.col("at") - F.col("lo")), F.lit(0)), F.greatest(half - (F.col("hi") - F.col("at")), F.lit(0))
    b = F.when(F.col("at") == F.col("frame"), F.col("b")).otherwise(F.col("later"))
    edges = {f"{c}_edge": head * F.col(f"{c}_first") + tail * F.col(f"{c}_last") for c in middle}
    own = own.select("group_id", F.col("at").alias("frame"), *(filled(c, F.col("at"), b, otherwise).alias(c) for c, otherwise in middle.items()), *(v.alias(k) for k, v in edges.items()))
    near, out = track.rowsBetween(-half, half), {}
    for c, most in (("x", w), ("y", h)):
        mean = (F.sum(c).over(near) + F.col(f"{c}_edge")) / smooth
        out[f"{c}0"] = F.greatest(F.least(mean - zoom / 2, F.lit(float(max(0, most - zoom)))), F.lit(0.0))
    return own.select("group_id", "frame", *(F.floor(F.round(v, 6)).cast("int").alias(k) for k, v in out.items()))


def window_stride(frames: DataFrame, *keys: str) -> DataFrame:
    """The median difference of a window's frames, at least 1."""
    gaps = frames.withColumn("d", F.col("frame") - F.lag("frame").over(_track(*keys)))
    return gaps.groupBy(*keys).agg(F.greatest(F.coalesce(F.percentile("d", F.lit(0.5)), F.lit(1.0)), F.lit(1.0)).alias("stride"))


def stale_prior(points: DataFrame, d: int, *keys: str) -> DataFrame:
    """The pose d rows later (the last one beyond the end), where both are present."""
    w = _track(*keys)
    ahead = F.lead(F.struct("x", "y"), d).over(w)
    end = F.last(F.struct("x", "y")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = points.withColumn("later", F.coalesce(ahead, end))
    both = F.col("x").isNotNull() & F.col("later.x").isNotNull()
    return own.withColumn("stale_x", F.when(both, F.col("later.x"))).withColumn("stale_y", F.when(both, F.col("later.y"))).drop("later")
