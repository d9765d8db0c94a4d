"""Evaluation: errors with coverage, matching scores, audits. Every measure is an aggregate over long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinefold.functions.geometry import Box
from kinefold.functions.random import draw_sql
from kinefold.operators.filters import BUCKET_FRAMES, FRAME
from kinefold.operators.joins import centroids, distance
from kinefold.operators.quantiles import counted, exact_quantiles, quantiles, with_quantiles
from kinefold.operators.sampling import numbered
from kinefold.sources.tables import materialize

#: Upper quantiles of errors.
TAIL = {"p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
#: Draws of a bootstrap that one task makes.
DRAWS_A_TASK = 5_000_000


def error_quantiles(rows: DataFrame, *keys: str) -> DataFrame:
    """The upper quantiles of the distances of aligned rows (px, py, x, y)."""
    d = distance(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
    table = counted(rows, d, *keys)
    return with_quantiles(table.select(*keys).distinct(), quantiles(table, TAIL, *keys), *keys) if keys else quantiles(table, TAIL)


def error_and_coverage(rows: DataFrame, *keys: str) -> DataFrame:
    """Over aligned rows (px, py, x, y): mean, median and upper quantiles of the distance, and the share of labels that have one."""
    d = distance(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
    table = counted(rows, d, *keys, labelled=F.col("x").isNotNull() & F.col("y").isNotNull())
    n_true, n_matched = F.coalesce(F.sum(F.when(F.col("labelled"), F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0))
    err = F.sum(F.col("v") * F.col("n")) / F.nullif(n_matched, F.lit(0))
    groups = table.groupBy(*keys).agg(err.alias("err"), n_true.alias("n_true"), n_matched.alias("n_matched"), (n_matched / F.nullif(n_true, F.lit(0))).alias("coverage"))
    out = with_quantiles(groups, quantiles(table, {"median": 0.5} | TAIL, *keys), *keys)
    return out.select(*keys, "err", "median", *TAIL, "n_true", "n_matched", "coverage")


def pck(rows: DataFrame, thresholds: list[float], *keys: str) -> DataFrame:
    """The share of labelled points within each threshold: a missing prediction is a failure at each."""
    d = distance(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
    labelled = rows.where("x is not null and y is not null").withColumn("d", d).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return labelled.groupBy(*keys, "threshold").agg((F.count_if(F.col("d") <= F.col("threshold")) / F.count(F.lit(1))).alias("pck"))


def paired_bootstrap(units: DataFrame, n: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Mean of a (or of a - b) over units, with the percentile interval of n resamples; units lacking either side are dropped and counted.

    units: (unit, a, b). A resample's draws are rows (resample, number of a unit) that are joined with the numbered units and summed up, so there is
    no bound on the units; only the n means meet at the end.
    """
    spark = units.sparkSession
    own = materialize(units.select("unit", (F.col("a") - F.col("b") if "b" in units.columns else F.col("a")).alias("v")), "units")
    whole = own.agg(F.avg("v").alias("mean"), F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("n_dropped"))
    size = whole.first()["n"]
    values = numbered(own.where("v is not null"), ["unit"], "number").select("number", "v")
    tasks = max(spark.sparkContext.defaultParallelism, -(-n * size // DRAWS_A_TASK))
    drawn = spark.range(0, n * size, 1, tasks).selectExpr(f"id div {max(size, 1)} AS r", f"id % {max(size, 1)} AS k")
    index = F.expr(f"CAST(floor({draw_sql(seed, 'r', 'k')} * {size}) AS BIGINT)")
    means = drawn.select("r", index.alias("number")).join(values, "number").groupBy("r").agg((F.sum("v") / size).alias("m"))
    interval = means.agg(F.percentile("m", F.lit(alpha / 2)).alias("lo"), F.percentile("m", F.lit(1 - alpha / 2)).alias("hi"))
    return whole.crossJoin(interval)


def motion_ratio(rows: DataFrame, *keys: str) -> DataFrame:
    """Path length of predictions (px, py) over that of references (x, y), over steps that both have in consecutive frames."""
    w = Window.partitionBy("group_id", "animal", "bodypart").orderBy("frame")
    own = rows.where("px is not null and x is not null").withColumn("before", F.lag(F.struct("frame", "px", "py", "x", "y")).over(w))
    own = own.where("frame - before.frame = 1")
    dp, dr = distance(F.col("px"), F.col("py"), F.col("before.px"), F.col("before.py")), distance(F.col("x"), F.col("y"), F.col("before.x"), F.col("before.y"))
    sums = own.groupBy(*keys).agg(F.sum(dp).alias("pred_path"), F.sum(dr).alias("ref_path"), F.count(F.lit(1)).alias("n_steps"))
    return sums.withColumn("ratio", F.col("pred_path") / F.nullif(F.col("ref_path"), F.lit(0.0)))


def match_radius(true: DataFrame, *keys: str) -> DataFrame:
    """The median diagonal of the instances' keypoint extents; infinite where that is not positive."""
    box = true.where("x is not null").groupBy(*keys, "frame", "animal").agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("diagonal"))
    found = exact_quantiles(box, F.col("diagonal"), {"radius": 0.5}, *keys)
    return found.select(*keys, F.when(F.col("radius") > 0, F.col("radius")).otherwise(F.lit(float("inf"))).alias("radius"))


def _dealt(matches: DataFrame, like: DataFrame) -> DataFrame:
    """Matches with the bucket of frames and dealt as the table like, if that has one."""
    bucket = F.floor(F.col("frame") / BUCKET_FRAMES)
    if "bucket" not in like.columns:
        return matches.withColumn("bucket", bucket)
    own = matches.withColumn("bucket", bucket.cast(like.schema["bucket"].dataType))
    return own.repartition(int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group_id", "bucket")


def switches(matches: DataFrame) -> DataFrame:
    """group_id and frame of matches whose label was last matched by another prediction: looked for inside buckets of frames, and between a label's buckets by their first and last matches."""
    own, whole = ["group_id", "bucket", "j"], Window.partitionBy("group_id", "j").orderBy("bucket")
    inside = matches.withColumn("last", F.lag("i").over(Window.partitionBy(*own).orderBy("frame"))).where("last <> i")
    ends = matches.groupBy(*own).agg(F.min(F.struct("frame", "i")).alias("first"), F.max(F.struct("frame", "i")).alias("end"))
    across = ends.withColumn("last", F.lag("end.i").over(whole)).where("last <> first.i")
    return inside.select(*FRAME).union(across.select("group_id", "first.frame"))


def mota(matches: DataFrame, pred: DataFrame, true: DataFrame, ignore_boxes: DataFrame, max_dist: float, *keys: str) -> DataFrame:
    """Misses, false positives (those near a claimed label are duplicates, those inside an ignore box are excused), switches and MOTA by keys (columns of the frames' rows).

    A frame's few instances, boxes and matches are arrays of one row. Tables with a bucket are dealt by clip and bucket, and meet by that where
    spark.sql.requireAllClusterKeysForCoPartition is off.
    """
    at = [*FRAME, *(["bucket"] if "bucket" in pred.columns else [])]
    matches = _dealt(materialize(matches, "matches"), pred)  # the solver runs once, though the matches are asked for more often

    def framed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy(*at).agg(F.collect_list(F.struct(*columns)).alias(name))

    keyed = " and ".join(f"{c} is not null" for c in at)
    # Either side is asked for rows with a frame in the same words, so that what deals it is shuffled once; labels without one are only missed.
    p = framed(centroids(pred.withColumnRenamed("pred", "i").where(keyed), *at, "i"), "p", "i", "x", "y")
    t = framed(centroids(true.withColumnRenamed("animal", "j").where(keyed), *at, "j"), "t", "j", "x", "y")
    lost = true.where("x is not null and (group_id is null or frame is null)").select(*FRAME, "animal").distinct().select(*keys, F.lit(1).alias("gt"), F.lit(1).alias("misses"))
    b, m = framed(ignore_boxes, "b", *Box._fields), framed(matches, "m", "i", "j")
    some = lambda c: F.coalesce(c, F.array())
    matched = lambda row, k: F.coalesce(F.exists("m", lambda o: o[k] == row[k]), F.lit(False))
    labels = t.join(m, at, "left").select(*keys, F.size("t").alias("gt"), F.size(F.filter("t", lambda o: ~matched(o, "j"))).alias("misses"))
    near = lambda o, c: distance(o["x"], o["y"], c["x"], c["y"]) <= max_dist
    inside = lambda o: F.coalesce(F.exists("b", lambda c: (o["x"] >= c["x0"]) & (o["x"] <= c["x1"]) & (o["y"] >= c["y0"]) & (o["y"] <= c["y1"])), F.lit(False))
    loose = p.join(m, at, "left").withColumn("p", F.filter("p", lambda o: o["i"].isNotNull() & ~matched(o, "i"))).where(F.size("p") > 0)
    told = loose.join(b, at, "left").withColumn("fps", F.filter("p", lambda o: ~inside(o))).join(t, at, "left").withColumn("claimed", F.filter("t", lambda o: matched(o, "j")))
    dups = F.filter("fps", lambda o: F.coalesce(F.exists("claimed", lambda c: near(o, c)), F.lit(False)))
    wrong = told.select(*keys, F.size("fps").alias("fp"), F.size(dups).alias("fp_dup"), (F.size("p") - F.size("fps")).alias("fp_ignored"))
    parts = [labels, lost, wrong, switches(matches).select(*keys, F.lit(1).alias("idsw"))]
    rows = parts[0]
    for df in parts[1:]:
        rows = rows.unionByName(df, allowMissingColumns=True)
    counts = rows.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gt", "misses", "fp", "fp_dup", "fp_ignored", "idsw")))
    gt = F.nullif(F.col("gt"), F.lit(0))
    counts = counts.withColumn("fp_none", F.col("fp") - F.col("fp_dup"))
    rates = {f"{n}_rate": F.col(c) / gt for n, c in (("miss", "misses"), ("fp", "fp"), ("fp_dup", "fp_dup"), ("fp_none", "fp_none"), ("idsw", "idsw"))}
    return counts.withColumns(rates).withColumn("mota", F.lit(1.0) - (F.col("misses") + F.col("fp") + F.col("idsw")) / gt)


def matched_points(matches: DataFrame, pred: DataFrame, true: DataFrame) -> DataFrame:
    """Every label (j, x, y) beside its point of the matched prediction (px, py), if it has one; matches are dealt as pred and true are."""
    at = [*FRAME, *(["bucket"] if "bucket" in pred.columns else [])]
    p = pred.select(*at, "bodypart", F.col("pred").alias("i"), F.col("x").alias("px"), F.col("y").alias("py"))
    return true.withColumnRenamed("animal", "j").join(matches.select(*at, "i", "j"), [*at, "j"], "left").join(p, [*at, "i", "bodypart"], "left")


def matched_error(matches: DataFrame, pred: DataFrame, true: DataFrame, *keys: str) -> DataFrame:
    """Errors over the points of matched instances, with point and instance counts. Tables with a bucket are dealt by clip and bucket, as in mota."""
    at = [*FRAME, *(["bucket"] if "bucket" in pred.columns else [])]
    matches = _dealt(materialize(matches, "matches"), pred)  # the solver runs once, though the matches are asked for twice
    out = error_and_coverage(matched_points(matches, pred, true), *keys)
    here = true.where("x is not null").select(*at, "animal").distinct()
    n_true = here.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_true_inst"))
    n_matched = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matched_inst"))
    joined = out.join(n_true, list(keys), "left").join(n_matched, list(keys), "left").fillna(0, ["n_true_inst", "n_matched_inst"])
    return joined.withColumn("unmatched_true", F.col("n_true_inst") - F.col("n_matched_inst"))


def vis_confusion(rows: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall and base rate of logit > 0 against what was assessed (status visible or missing)."""
    own = rows.where(F.col("status").isin("visible", "missing"))
    said, seen = F.coalesce(F.col("logit") > 0, F.lit(False)), F.col("status") == "visible"
    hit = F.count_if(said & seen)
    return own.groupBy(*keys).agg((hit / F.nullif(F.count_if(said), F.lit(0))).alias("precision"), (hit / F.nullif(F.count_if(seen), F.lit(0))).alias("recall"), (F.count_if(seen) / F.count(F.lit(1))).alias("base"))


def chunk_units(rows: DataFrame, n: int) -> DataFrame:
    """Rows with unit group#t0 of n frames each; chunks of one frame are dropped. A unit's rows, which n bounds, meet once: the rows are not derived again to look for long units."""
    own = rows.withColumn("t0", (F.floor(F.col("frame") / n) * n).cast("int")).withColumn("unit", F.concat_ws("#", "group_id", "t0"))
    unit = Window.partitionBy("unit")
    return own.withColumn("_long", F.min("frame").over(unit) < F.max("frame").over(unit)).where("_long").drop("_long")


def report_by_mode(units: DataFrame) -> DataFrame:
    """One row per mode (units never mix), and a total per level of the roll-up: points-weighted coverage, mean of the units' errors and quantiles."""
    return units.rollup("mode", "group_id").agg(F.count(F.lit(1)).alias("n_units"), (F.sum("n_matched") / F.sum("n_true")).alias("coverage"), F.avg("err").alias("err"), F.avg("p95").alias("p95"))


def weighted_means(rows: DataFrame, weight: str, columns: list[str], *keys: str) -> DataFrame:
    """Means weighted by a column; a null leaves its own mean only."""
    w = F.col(weight)
    return rows.groupBy(*keys).agg(*((F.sum(F.col(c) * w) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), w)), F.lit(0))).alias(c) for c in columns), F.sum(w).alias(weight))


def detection_summary(matched: DataFrame, n_fp: DataFrame, *keys: str) -> DataFrame:
    """Recalls at IoU .5 and .75, mean IoU over every gt, false positives for each gt."""
    own = matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt"), F.avg((F.col("iou") >= 0.5).cast("double")).alias("r50"), F.avg((F.col("iou") >= 0.75).cast("double")).alias("r75"), F.avg("iou").alias("iou"))
    return own.join(n_fp, list(keys), "left").select(*keys, "n_gt", "r50", "r75", "iou", (F.coalesce("n_fp", F.lit(0)) / F.col("n_gt")).alias("fp_per_gt"))


def status_counts(tables: dict[str, DataFrame], key: str = "group_id") -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.groupBy(key, "status").agg(F.count(F.lit(1)).alias("n")).select(key, F.lit(name).alias("tab"), "status", "n")
        out = one if out is None else out.union(one)
    return out


def holes(rows: DataFrame, live: list[str], *keys: str) -> DataFrame:
    """Rows that are not there: live keys times distinct bodyparts, less the rows."""
    return rows.groupBy(*keys).agg((F.countDistinct(F.struct(*live)) * F.countDistinct("bodypart") - F.count(F.lit(1))).alias("holes"))


def audit_status(counts: DataFrame, found_holes: DataFrame, policy: DataFrame) -> DataFrame:
    """Violations of a policy (group_id, allow_missing, expected_holes): missing where it may not be, projected beside visible, holes other than expected."""
    kinds = counts.groupBy("group_id").agg(F.sum(F.when(F.col("status") == "missing", F.col("n"))).alias("missing"), F.sum(F.when(F.col("status") == "projected", F.col("n"))).alias("projected"), F.sum(F.when(F.col("status") == "visible", F.col("n"))).alias("visible"))
    all_ = kinds.join(found_holes, "group_id", "left").join(policy, "group_id", "left")
    problems = F.array(
        F.when((F.col("missing") > 0) & ~F.coalesce("allow_missing", F.lit(False)), F.lit("missing not allowed")),
        F.when((F.col("projected") > 0) & (F.col("visible") > 0), F.lit("projected beside visible")),
        F.when(F.col("expected_holes").isNotNull() & (F.col("holes") != F.col("expected_holes")), F.lit("holes differ")),
    )
    return all_.select("group_id", F.explode(F.array_compact(problems)).alias("problem"))


def bone_lengths(points: DataFrame, skeleton: list[tuple[str, str]]) -> DataFrame:
    """Median length and count of each named pair."""
    spark = points.sparkSession
    bones = F.broadcast(spark.createDataFrame(skeleton, "a string, b string"))
    keys = [*FRAME, "animal"]
    side = lambda n: points.where("x is not null").select(*keys, F.col("bodypart").alias(n), F.struct("x", "y").alias(f"p{n}"))
    pairs = side("a").join(bones, "a").join(side("b"), [*keys, "b"])
    d = distance(F.col("pa.x"), F.col("pa.y"), F.col("pb.x"), F.col("pb.y"))
    table = counted(pairs, d, "a", "b")
    return with_quantiles(table.groupBy("a", "b").agg(F.sum("n").alias("n")), quantiles(table, {"length": 0.5}, "a", "b"), "a", "b").select("a", "b", "length", "n")


def modal_step(frames: DataFrame, *keys: str) -> DataFrame:
    """The commonest frame difference (the first seen of equals), 1 with fewer than two frames."""
    w = Window.partitionBy(*keys).orderBy("frame")
    gaps = frames.withColumn("step", F.col("frame") - F.lag("frame").over(w))
    counted = gaps.groupBy(*keys, "step").agg(F.count("step").alias("n"), F.min("frame").alias("first"))
    return counted.groupBy(*keys).agg(F.coalesce(F.max_by("step", F.when(F.col("step").isNotNull(), F.struct("n", -F.col("first")))), F.lit(1)).cast("int").alias("step"))


def canonical_names(sessions: DataFrame) -> DataFrame:
    """The ordering of names that most sessions have (the smallest of equals)."""
    return sessions.groupBy("names").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("names", F.struct("n", F.transform("names", lambda x: -F.length(x)), "names")).alias("names"), F.max("n").alias("n"))


def masked_log_loss(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean binary cross-entropy of logits over the targets that are there, in the form that does not overflow."""
    z, y = F.col("logit"), F.col("target")
    loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    return rows.groupBy(*keys).agg(F.avg(F.when(y.isNotNull(), loss)).alias("loss"))


def any_visible(rows: DataFrame, *keys: str) -> DataFrame:
    """Seen in any camera; null where none was assessed."""
    return rows.groupBy(*keys).agg(F.max(F.col("target") == 1.0).alias("visible"))
