"""Training tables: window indexes, weights, draws, negatives, corrupted priors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinefold.functions.geometry import Box, Letterbox, overlaps
from kinefold.functions.random import draw_sql
from kinefold.operators.filters import FRAME
from kinefold.operators.joins import beside_nearest, distance, nearest_neighbour_row
from kinefold.sources.tables import materialize

#: Frames of a clip in one row of the dense arrays.
BLOCK_FRAMES = 512


def with_totals(rows: DataFrame, keys: list[str], **totals: Column) -> DataFrame:
    """rows with aggregates over the rows of the same keys (over all rows without any). The groups, which are few, are totalled by a partial aggregation and broadcast: no window moves the rows."""
    if not keys:
        return rows.crossJoin(F.broadcast(rows.agg(*(c.alias(n) for n, c in totals.items()))))
    mine = [f"_{k}" for k in keys]
    sums = rows.groupBy(*(F.col(k).alias(m) for k, m in zip(keys, mine, strict=True))).agg(*(c.alias(n) for n, c in totals.items()))
    same = [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, mine, strict=True)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return rows.join(F.broadcast(sums), on).drop(*mine)


GROUP = "CAST(substr(group_id, 2) AS BIGINT)"


def window_index(labels: DataFrame, sessions: DataFrame) -> DataFrame:
    """One training entry per (clip, animal) with labels, and what its session says."""
    return labels.where("status <> 'unlabeled'").select("group_id", "animal").distinct().join(sessions, "group_id")


def pool_weights(index: DataFrame, annot_frac: float | None, mode_3d_frac: float | None) -> DataFrame:
    """Shares of label source, then of mode inside it; a level that a pool lacks is skipped and an unset one keeps its natural share. Entries that lack a value are a cell of their own."""
    for v in (annot_frac, mode_3d_frac):
        if v is not None and not 0 <= v <= 1:
            raise ValueError(f"share {v}")
    # The index is counted once; the rest is sums over its few cells.
    cells = index.groupBy(F.col("label_source").alias("_source"), F.col("mode").alias("_mode")).agg(F.count(F.lit(1)).alias("n_cell"))
    all_, of_source = Window.partitionBy(F.lit(0)), Window.partitionBy("_source")
    totals = cells.withColumns({"n_all": F.sum("n_cell").over(all_), "sources": F.size(F.collect_set(F.struct("_source")).over(all_)), "n_source": F.sum("n_cell").over(of_source), "modes": F.count(F.lit(1)).over(of_source)})
    own = index.join(F.broadcast(totals), F.col("label_source").eqNullSafe(F.col("_source")) & F.col("mode").eqNullSafe(F.col("_mode"))).drop("_source", "_mode")
    source = F.col("n_source") / F.col("n_all")
    if annot_frac is not None:
        wanted = F.when(F.col("label_source") == "annotated", annot_frac).otherwise(1 - annot_frac)
        source = F.when(F.col("sources") > 1, wanted).otherwise(F.lit(1.0))
    mode = F.col("n_cell") / F.col("n_source")
    if mode_3d_frac is not None:
        wanted = F.when(F.col("mode") == "3d", mode_3d_frac).otherwise(1 - mode_3d_frac)
        mode = F.when(F.col("modes") > 1, wanted).otherwise(F.lit(1.0))
    return own.withColumn("w", source * mode / F.col("n_cell")).drop("n_all", "n_source", "n_cell", "sources", "modes")


def mix(weighted: DataFrame, *keys: str) -> DataFrame:
    """Realised share of each cell."""
    return with_totals(weighted.groupBy(*keys).agg(F.sum("w").alias("w")), [], _whole=F.sum("w")).withColumn("share", F.col("w") / F.col("_whole")).drop("w", "_whole")


def weighted_draw(weighted: DataFrame, n: int, seed: int, order: list[str], shard_rows: int = 4096) -> DataFrame:
    """n draws with replacement. Entries are dealt by a hash into shards of about so many, whose totals lay out the line from 0 to 1; a draw falls into a shard by the shards' bounds, and to its entry by an equality of finer buckets inside the shard.

    Only shard totals (one in shard_rows entries) are ordered together and broadcast.
    """
    shards = max(1, -(-weighted.count() // shard_rows))
    own = weighted.withColumn("shard", F.pmod(F.xxhash64(*order), F.lit(shards)))
    totals = own.groupBy("shard").agg(F.sum("w").alias("total"))
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    bounds = with_totals(before, [], whole=F.sum("total"))
    own = own.join(F.broadcast(bounds.select("shard", "before", "whole")), "shard")
    upto = F.col("before") + F.sum("w").over(Window.partitionBy("shard").orderBy(*order))
    own = own.withColumn("hi", upto / F.col("whole")).withColumn("lo", (upto - F.col("w")) / F.col("whole"))
    # As many buckets as there may be entries: an entry and a draw meet in one of them.
    buckets = shards * shard_rows
    spans = own.select(*order, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * buckets), F.floor(F.col("hi") * buckets))).alias("bucket"))
    u = F.expr(draw_sql(seed, "draw"))
    draws = weighted.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("u", u).withColumn("bucket", F.floor(F.col("u") * buckets))
    return draws.join(spans, "bucket").where("u >= lo and u < hi").select("draw", *order)


def balance_datasets(index: DataFrame, dataset: str) -> DataFrame:
    """Uniform over datasets, then within each."""
    own = with_totals(with_totals(index, [dataset], _n=F.count(F.lit(1))), [], _k=F.count_distinct(dataset))
    return own.withColumn("w", F.lit(1.0) / (F.col("_n") * F.col("_k"))).drop("_n", "_k")


def cohort_weights(index: DataFrame, annot_frac: float) -> DataFrame:
    """Weights that give annotated entries a total; null with one cohort."""
    own = with_totals(with_totals(index, ["label_source"], _n=F.count(F.lit(1))), [], _kinds=F.count_distinct("label_source"))
    share = F.when(F.col("label_source") == "annotated", annot_frac).otherwise(1 - annot_frac)
    return own.withColumn("w", F.when(F.col("_kinds") > 1, share / F.col("_n"))).drop("_n", "_kinds")


def alpha_weights(index: DataFrame, alpha: float, group: str = "group_id") -> DataFrame:
    """n ** (alpha - 1) for each of a group's n entries."""
    return index.withColumn("w", F.pow(F.count(F.lit(1)).over(Window.partitionBy(group)), F.lit(alpha - 1)))


def negative_weights(index: DataFrame, frac: float, negative: str = "negative") -> DataFrame:
    """Weights that give negatives a total of frac."""
    own = with_totals(index, [negative], _n=F.count(F.lit(1)))
    return own.withColumn("w", F.when(F.col(negative), frac).otherwise(1 - frac) / F.col("_n")).drop("_n")


def combine_weights(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Products of two weights of the same entries, summing to 1."""
    joined = a.select(*keys, F.col("w").alias("wa")).join(b.select(*keys, F.col("w").alias("wb")), keys)
    return with_totals(joined, [], _total=F.sum(F.col("wa") * F.col("wb"))).select(*keys, (F.col("wa") * F.col("wb") / F.col("_total")).alias("w"))


def absent_negatives(instances: DataFrame) -> DataFrame:
    """Views in which every animal of the clip is absent."""
    animals = instances.groupBy("group_id").agg(F.countDistinct("animal").alias("n_animals"))
    views = instances.groupBy(*FRAME, "camera").agg(F.bool_and(F.col("status") == "absent").alias("all_absent"), F.countDistinct("animal").alias("n"))
    return views.where("all_absent").join(animals, "group_id").where("n = n_animals").select(*FRAME, "camera")


def crop_negatives(views: DataFrame, known: DataFrame, certified: DataFrame, side: float, seed: int, tries: int = 12, margin: float = 2.5) -> DataFrame:
    """For each view the first of some drawn origins whose square lies in certified area and far from every known box."""
    from kinefold.operators.joins import min_margin_filter

    keys = [*FRAME, "camera"]
    drawn = views.join(certified.select(*keys, *Box._fields), keys).withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    ux, uy = (F.expr(draw_sql(seed + k, GROUP, "CAST(frame AS BIGINT)", "CAST(try AS BIGINT)")) for k in (0, 1))
    x = F.floor(F.col("x0") + ux * F.greatest(F.col("x1") - F.col("x0") - side, F.lit(0.0)))
    y = F.floor(F.col("y0") + uy * F.greatest(F.col("y1") - F.col("y0") - side, F.lit(0.0)))
    candidates = drawn.where((F.col("x1") - F.col("x0") >= side) & (F.col("y1") - F.col("y0") >= side)).select(*keys, "try", x.alias("c_x0"), y.alias("c_y0"), (x + side).alias("c_x1"), (y + side).alias("c_y1"))
    far = min_margin_filter(candidates, known, margin)
    return far.groupBy(*keys).agg(F.min_by(F.struct("c_x0", "c_y0"), "try").alias("o"), F.min("try").alias("try")).select(*keys, "try", F.col("o.c_x0").alias("x0"), F.col("o.c_y0").alias("y0"))


def tile_origins(views: DataFrame, centres: DataFrame, regions: DataFrame, tile: float, w: float, h: float, seed: int, background: int = 1, certified: DataFrame | None = None) -> DataFrame:
    """Tile origins of each view: one for each region, one for each animal (centres: cx, cy), and background ones; all moved by up to a quarter tile and kept near the image.

    In groups that certify regions (those of the table, or of certified: group_id) a background tile is centred inside one of the
    view's regions, drawn alike, and a view without any has none; elsewhere it is centred anywhere. A view that gets
    no tile at all has one in the middle.
    """
    keys = [*FRAME, "camera"]
    key = (GROUP, "CAST(frame AS BIGINT)", "CAST(substr(camera, 2) AS BIGINT)")
    known = (regions if certified is None else certified).select("group_id").distinct()
    spots = views.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(background))).alias("n"))
    u = lambda k: F.expr(draw_sql(seed + k, *key, "n"))
    anywhere = spots.join(known, "group_id", "left_anti").select(*keys, (u(0) * w).alias("cx"), (u(1) * h).alias("cy"))
    rects = regions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*Box._fields))).alias("rects"))
    drawn = spots.join(rects, keys).withColumn("r", F.get("rects", F.floor(u(4) * F.size("rects")).cast("int")))
    inside = drawn.select(*keys, (F.col("r.x0") + u(0) * (F.col("r.x1") - F.col("r.x0"))).alias("cx"), (F.col("r.y0") + u(1) * (F.col("r.y1") - F.col("r.y0"))).alias("cy"))
    of_region = regions.select(*keys, F.lit("region").alias("kind"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    of_animal = centres.select(*keys, F.lit("animal").alias("kind"), "cx", "cy")
    back = anywhere.unionByName(inside).select(*keys, F.lit("background").alias("kind"), "cx", "cy")
    all_ = of_region.unionByName(of_animal).unionByName(back)
    place = ("CAST(floor(cx) AS BIGINT)", "CAST(floor(cy) AS BIGINT)")
    jitter = lambda k: (F.expr(draw_sql(seed + k, *key, *place)) - 0.5) * (tile / 2)
    clamp = lambda v, most: F.greatest(F.least(v, F.lit(max(0.0, most - 3 * tile / 4))), F.lit(-tile / 4))
    origins = all_.select(*keys, "kind", clamp(F.col("cx") - tile / 2 + jitter(2), w).alias("x0"), clamp(F.col("cy") - tile / 2 + jitter(3), h).alias("y0"))
    bare = views.select(*keys).join(origins.select(*keys).distinct(), keys, "left_anti")
    middle = bare.select(*keys, F.lit("empty").alias("kind"), F.lit(max(0.0, (w - tile) / 2)).alias("x0"), F.lit(max(0.0, (h - tile) / 2)).alias("y0"))
    return origins.unionByName(middle).select(*keys, "kind", F.floor("x0").cast("int").alias("x0"), F.floor("y0").cast("int").alias("y0"))


def box_targets(boxes: DataFrame, w: float, h: float, out_w: int, out_h: int) -> DataFrame:
    """Boxes in input pixels."""
    lb = Letterbox.fit(F.lit(w), F.lit(h), out_w, out_h)
    return boxes.withColumns(lb.box(Box.named()).columns())


def known_boxes(instances: DataFrame) -> DataFrame:
    return instances.where(F.col("status").isin("labeled", "present"))


def ignore_boxes(instances: DataFrame) -> DataFrame:
    return instances.where("status = 'present'")


def regions_in_view(views: DataFrame, regions: DataFrame, certified: DataFrame, view: Letterbox) -> DataFrame:
    """views with rects: the view's certified rectangles in input pixels, in order. None (null) in a group that certifies nothing, and so claims to be wholly labelled; an empty list where the group does but this view has none."""
    keys = [*FRAME, "camera"]
    moved = regions.select(*keys, F.struct(*(c.alias(n) for n, c in view.box(Box.named()).columns().items())).alias("r"))
    rects = moved.groupBy(*keys).agg(F.array_sort(F.collect_list("r")).alias("rects"))
    known = certified.select("group_id").distinct().withColumn("_known", F.lit(True))
    own = views.join(rects, keys, "left").join(known, "group_id", "left")
    return own.withColumn("rects", F.when(F.col("_known"), F.coalesce("rects", F.array().cast(rects.schema["rects"].dataType)))).drop("_known")


def camera_subset(views: DataFrame, n: int | tuple[int, int], seed: int, single: float = 0.0) -> DataFrame:
    """n cameras of each frame by a seeded draw; of a range (lowest, highest) each number alike, and with a chance of single one camera alone. A frame with fewer cameras has all."""
    frame = (GROUP, "CAST(frame AS BIGINT)")
    order = F.expr(draw_sql(seed, *frame, "CAST(substr(camera, 2) AS BIGINT)"))
    low, high = (n, n) if isinstance(n, int) else n
    count = F.lit(low) + F.floor(F.expr(draw_sql(seed + 1, *frame)) * (high - low + 1))
    count = F.when(F.expr(draw_sql(seed + 2, *frame)) < single, F.lit(1)).otherwise(count)
    return views.withColumn("_rank", F.row_number().over(Window.partitionBy(*FRAME).orderBy(order, "camera"))).where(F.col("_rank") <= count).drop("_rank")


def crop_inflate_draw(split: Column, lo: float, hi: float, u: Column) -> Column:
    """Uniform on train, the middle elsewhere."""
    return F.when(split == "train", F.lit(lo) + u * (hi - lo)).otherwise(F.lit((lo + hi) / 2))


def build_prior(first: DataFrame, p_drop: float, seed: int) -> DataFrame:
    """First labelled poses (group, animal, win, ...), whole items dropped by one draw each."""
    u = F.expr(draw_sql(seed, GROUP, "CAST(animal AS BIGINT)", "CAST(win AS BIGINT)"))
    kept = u >= p_drop
    return first.withColumns({c: F.when(kept, F.col(c)) for c in ("x", "y")}).withColumn("kept", kept)


def _u(seed: int, *more: str) -> Column:
    return F.expr(draw_sql(seed, GROUP, "CAST(frame AS BIGINT)", "CAST(animal AS BIGINT)", *more))


#: A bodypart's number in draws.
PART = "CAST(length(bodypart) * 7 + ascii(bodypart) AS BIGINT)"


def _beside(points: DataFrame, neighbours: DataFrame | None) -> DataFrame:
    """points with their neighbour's place nx, ny: of neighbours (group_id, frame, animal, neighbour), or of the nearest animals without such a table."""
    if neighbours is None:
        return beside_nearest(points)
    other = points.select(*FRAME, F.col("animal").alias("neighbour"), "bodypart", F.col("x").alias("nx"), F.col("y").alias("ny"))
    return points.join(neighbours.select(*FRAME, "animal", "neighbour"), [*FRAME, "animal"], "left").join(other, [*FRAME, "neighbour", "bodypart"], "left")


def corrupt_swap_animal(points: DataFrame, neighbours: DataFrame | None, p: float, seed: int) -> DataFrame:
    """Each keypoint takes its neighbour's position with probability p, where the neighbour has one (neighbours as in _beside)."""
    own = _beside(points, neighbours)
    swap = F.coalesce((_u(seed, PART) < p) & F.col("nx").isNotNull(), F.lit(False))
    return own.withColumns({"x": F.when(swap, F.col("nx")).otherwise(F.col("x")), "y": F.when(swap, F.col("ny")).otherwise(F.col("y")), "swapped": swap}).drop("neighbour", "nx", "ny")


def corrupt_swap_keypoints(points: DataFrame, p: float, seed: int) -> DataFrame:
    """A drawn keypoint takes the original position of another finite keypoint of its animal, never its own."""
    keys = [*FRAME, "animal"]
    w = Window.partitionBy(*keys)
    here = points.where("x is not null").withColumn("r", F.row_number().over(w.orderBy("bodypart")) - 1).withColumn("m", F.count(F.lit(1)).over(w))
    offset = (F.floor(_u(seed + 1, PART) * (F.col("m") - 1)) + 1).cast("int")
    own = here.withColumn("to", F.when((_u(seed, PART) < p) & (F.col("m") > 1), (F.col("r") + offset) % F.col("m")).otherwise(F.col("r")))
    target = here.select(*keys, F.col("r").alias("to"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return own.join(target, [*keys, "to"]).select(*keys, "bodypart", F.col("tx").alias("x"), F.col("ty").alias("y"), (F.col("to") != F.col("r")).alias("swapped"))


def _normal(seed: int, *more: str) -> Column:
    """Box-Muller from two draws."""
    return F.sqrt(F.log(F.greatest(_u(seed, *more), F.lit(1e-12))) * -2) * F.cos(_u(seed + 1, *more) * (2 * math.pi))


def corrupt_noise(points: DataFrame, sigma: float, seed: int, *, per_item: bool = False) -> DataFrame:
    """Gaussian offsets: one for each animal-frame, or one for each point."""
    more = () if per_item else (PART,)
    return points.withColumns({c: F.col(c) + _normal(seed + 10 * k, *more) * sigma for k, c in enumerate(("x", "y"))})


def numbered(rows: DataFrame, order: list[str | Column], out: str, start: int = 0) -> DataFrame:
    """rows with their place in an order, from start: ranges of the order are sorted each on its own, and only the ranges' sizes are added up together."""
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    own = materialize(own, "numbered")
    sizes = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return own.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_at") + start).drop("_part", "_at", "_before")


def block_shuffle(index: DataFrame, order: list[str], chunk: int, pool: int, seed: int) -> DataFrame:
    """An order that keeps neighbours near: chunks are shuffled, then entries inside pools of chunks. position is the place in it."""
    rows = numbered(index.select(*order), order, "row").withColumn("chunk", F.floor(F.col("row") / chunk))
    ranks = numbered(rows.select("chunk").distinct(), [F.expr(draw_sql(seed, "chunk")), "chunk"], "chunk_rank")
    pooled = rows.join(ranks, "chunk").withColumn("pool", F.floor(F.col("chunk_rank") / pool))
    return numbered(pooled, ["pool", F.expr(draw_sql(seed + 1, "row")), "row"], "position").select(*order, F.col("position").cast("int").alias("position"))


def refined_box_or_fallback(views: DataFrame) -> DataFrame:
    """The refined boxes (r_x0 ..) of an item if they share area with the first (x0 ..) in every camera, else the first."""
    keys = [*FRAME, "animal"]
    ok = F.bool_and(overlaps(Box.named("r_"), Box.named())).over(Window.partitionBy(*keys))
    own = views.withColumn("refined", ok)
    return own.select(*keys, "camera", "refined", *(F.when(F.col("refined"), F.col(f"r_{c}")).otherwise(F.col(c)).alias(c) for c in Box._fields))


def oracle_corrupt_near(points: DataFrame, neighbours: DataFrame | None, share: float) -> DataFrame:
    """Points moved a share of the way to the neighbour's same point, where both are there (neighbours as in _beside)."""
    own = _beside(points, neighbours)
    return own.withColumns({c: F.coalesce(F.col(c) + (F.col(f"n{c}") - F.col(c)) * share, F.col(c)) for c in ("x", "y")}).drop("nx", "ny")


def oracle_corrupt(points: DataFrame, kind: str, amount: float, seed: int, boxes: DataFrame | None = None) -> DataFrame:
    """True poses (group_id, frame, animal, bodypart, x, y) broken on purpose, one way for each item (an animal in a frame).

    off: the whole pose moved by amount crop widths (the mean side of its box in boxes; without a box it stays) in a drawn direction.
    stale: the pose of amount frames earlier, of frame 0 at the earliest. other: the pose of the clip's next animal, the first after the last.
    near: the pose of the nearest animal that shares two points, its own without one. swap: amount pairs of its own finite points change
    places, all of them where there are fewer. Draws depend on the item alone, so two runs over one clip break it alike.
    An item whose source has no rows has none.
    """
    item = [*FRAME, "animal"]
    if kind == "off":
        if boxes is None:
            raise ValueError("off needs boxes")
        step = Box.named().mean_side * amount
        angle = _u(seed) * F.lit(2 * math.pi)
        sized = points.join(boxes.select(*item, step.alias("_step")), item, "left").withColumn("_angle", angle)
        moved = {c: F.col(c) + F.coalesce(turn(F.col("_angle")) * F.col("_step"), F.lit(0.0)) for c, turn in (("x", F.cos), ("y", F.sin))}
        return sized.withColumns(moved).drop("_step", "_angle")
    if kind == "swap":
        w = Window.partitionBy(*item)
        here = points.where("x is not null and y is not null").withColumn("_u", _u(seed + 1, PART))
        here = here.withColumn("_r", F.row_number().over(w.orderBy("_u", "bodypart")) - 1).withColumn("_m", F.floor(F.count(F.lit(1)).over(w) / 2) * 2)
        here = here.where((F.col("_r") < F.col("_m")) & (F.col("_r") < 2 * max(1, int(amount))))
        other = here.select(*item, F.col("_r").bitwiseXOR(F.lit(1)).alias("_r"), F.col("x").alias("_x"), F.col("y").alias("_y"))
        swapped = here.join(other, [*item, "_r"]).select(*item, "bodypart", "_x", "_y")
        return points.join(swapped, [*item, "bodypart"], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("x", "y")}).drop("_x", "_y")
    items = points.select(*item).distinct()
    frame, animal = F.col("frame"), F.col("animal")
    if kind == "stale":
        frame = F.greatest(frame - int(amount), F.lit(0))
    elif kind == "other":
        clip = Window.partitionBy("group_id")
        after = F.coalesce(F.lead("animal").over(clip.orderBy("animal")), F.min("animal").over(clip))
        items, animal = items.join(items.select("group_id", "animal").distinct().withColumn("_after", after), ["group_id", "animal"]), F.col("_after")
    elif kind == "near":
        items, animal = items.join(nearest_neighbour_row(points).select(*item, "neighbour"), item, "left"), F.coalesce("neighbour", "animal")
    else:
        raise ValueError(f"kind {kind}")
    source = points.select("group_id", F.col("frame").alias("_frame"), F.col("animal").alias("_animal"), "bodypart", "x", "y")
    return items.select(*item, frame.alias("_frame"), animal.alias("_animal")).join(source, ["group_id", "_frame", "_animal"]).select(*item, "bodypart", "x", "y")


def densify(points: DataFrame, bodyparts: list[str], keys: tuple[str, ...] = ("group_id", "animal"), block: int = BLOCK_FRAMES) -> DataFrame:
    """Nested arrays by frame and bodypart, a row for each animal and block of frames: pose[t][k] = (x, y), nulls where nothing is. Frames run from 0 to the clip's last; a block begins at frame t0, and one without any point is there too.

    An animal's frames that are there are sorted inside their block, and the gaps before each and behind the last are filled with repeated nulls: no look-up.
    The points are read once, into a table of the blocks that have any; the clips' last frames and the blocks without a point come from its narrow columns.
    """
    none = F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    pose = points.groupBy(*keys, "frame").agg(*(F.max(F.when(F.col("bodypart") == b, F.struct("x", "y"))).alias(f"b{k}") for k, b in enumerate(bodyparts)))
    t0 = (F.floor(F.col("frame") / block) * block).cast("int")
    framed = pose.select(*keys, t0.alias("t0"), F.struct((F.col("frame") - t0).alias("t"), F.array(*(F.coalesce(F.col(f"b{k}"), none) for k in range(len(bodyparts)))).alias("row")).alias("r"))
    own = materialize(framed.groupBy(*keys, "t0").agg(F.max("r.t").alias("t"), F.array_sort(F.collect_list("r")).alias("rows")), "blocks")
    last = own.groupBy(keys[0]).agg(F.max(F.col("t0") + F.col("t")).alias("last"))
    grid = own.select(*keys).distinct().join(last, keys[0]).select(*keys, "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(block))).alias("t0"))
    bare = grid.join(own.select(*keys, "t0"), [*keys, "t0"], "left_anti").select(*keys, "t0", "last", F.array().cast(own.schema["rows"].dataType).alias("rows"))
    whole = own.join(last, keys[0]).select(*keys, "t0", "last", "rows").unionByName(bare).withColumn("size", F.least(F.lit(block), F.col("last") + 1 - F.col("t0")).cast("int"))
    rows = F.col("rows")
    before = F.concat(F.array(F.lit(-1)), F.transform(rows, lambda r: r["t"]))
    nothing = F.lit(None).cast("array<struct<x:double,y:double>>")
    filled = F.flatten(F.zip_with(rows, F.slice(before, F.lit(1), F.size(rows)), lambda r, p: F.concat(F.array_repeat(nothing, r["t"] - p - 1), F.array(r["row"]))))
    return whole.select(*keys, "t0", F.concat(filled, F.array_repeat(nothing, F.col("size") - 1 - F.element_at(before, -1))).alias("pose"))


def stale_distance(points: DataFrame) -> Column:
    return distance(F.col("x"), F.col("y"), F.col("stale_x"), F.col("stale_y"))
