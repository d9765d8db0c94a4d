"""Readers of annotation roots and of other projects' labels. Every reader returns long rows; nothing is densified."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefold.functions.status import finite
from kinefold.sources.schema import ASSOCIATION_PX, CAMERA, LABELS, MODES, PREFIX, SESSION, TABLES

#: Tasks a core that list folders.
LISTING_TASKS_A_CORE = 4


@contextmanager
def few_listings(spark: SparkSession) -> Iterator[None]:
    """Sessions' folders, which a load lists at once, are shared out to some tasks a core; Spark takes a task for each, up to ten thousand for each folder above them."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(min(int(before), LISTING_TASKS_A_CORE * spark.sparkContext.defaultParallelism)))
        yield
    finally:
        spark.conf.set(name, before)


def _placed(df: DataFrame, path: Column) -> DataFrame:
    """root, split and session_id from a file's path: the folders above it."""
    return df.withColumns({n: F.substring_index(F.substring_index(path, "/", -k), "/", 1) for n, k in (("root", 4), ("split", 3), ("session_id", 2))})


def manifest_texts(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Files of a name below a path: file, body, root, split, session_id. A scan's task takes but a few files, as each counts as megabytes; here as many tasks as a shuffle has take them all, one after the other."""
    with few_listings(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path)
    files = files.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return _placed(files.select(F.col("path").alias("file"), F.decode("content", "utf-8").alias("body")), F.col("file"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The sessions below a path: root, split, session_id. A session is a folder with a session.toml; none at all is an error."""
    found = manifest_texts(spark, path, "session.toml").select("root", "split", "session_id")
    if found.isEmpty():
        raise FileNotFoundError(f"no session below {path}")
    return found


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Manifests as rows; one that breaks a rule has its text in violation and nulls for the rest."""

    columns = ["root", "split", "session_id", "violation", "mode", "units", "labels", "names", "skeleton", "flip_pairs", "provenance", "assoc_res_max_px"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                out = dict.fromkeys(columns) | {"root": r.root, "split": r.split, "session_id": r.session_id}
                try:
                    doc = tomllib.loads(r.body)
                    lacks = [k for k in ("mode", "units", "labels", "names") if k not in doc]
                    if lacks:
                        raise ValueError(f"missing {', '.join(lacks)}")
                    if doc["mode"] not in MODES or doc["labels"] not in LABELS or not doc["names"]:
                        raise ValueError("mode, labels or names")
                    out |= {k: doc.get(k) for k in ("mode", "units", "labels", "names", "skeleton", "flip_pairs")}
                    out |= {"provenance": {str(k): str(v) for k, v in doc.get("provenance", {}).items()}, "assoc_res_max_px": float(doc.get("assoc_res_max_px", ASSOCIATION_PX))}
                except (ValueError, TypeError) as e:
                    out["violation"] = str(e)
                rows.append(out)
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return manifest_texts(spark, path, "session.toml").mapInPandas(parse, f"{PREFIX}, violation string, {SESSION}")


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Cameras in section order; one without a matrix is a nominal pinhole at the origin and not calibrated.

    What a file does not say (a name, a size) or says wrongly is null, and a file that cannot be read is one row of nulls, which V-4 reports.
    """

    names = [c.split(" ")[0] for c in CAMERA.split(", ")]

    def numbers(c: dict, key: str, n: int, otherwise: list[float] | None) -> list[float] | None:
        flat = [float(v) for row in c[key] for v in (row if isinstance(row, list) else [row])] if key in c else otherwise
        if flat is not None and len(flat) != n:
            raise ValueError(key)
        return flat

    def camera(c: dict, k: int) -> dict:
        w, h = (int(v) for v in c["size"]) if "size" in c else (None, None)
        f = None if w is None else float(max(w, h))
        nominal = None if w is None else [f, 0.0, w / 2, 0.0, f, h / 2, 0.0, 0.0, 1.0]
        ox, oy = (float(v) for v in c.get("offset", (0, 0)))
        return {
            "name": c.get("name"), "cam_ix": k, "width": w, "height": h, "matrix": numbers(c, "matrix", 9, nominal), "distortions": numbers(c, "distortions", 5, [0.0] * 5),
            "rvec": numbers(c, "rotation", 3, [0.0] * 3), "tvec": numbers(c, "translation", 3, [0.0] * 3), "fisheye": bool(c.get("fisheye", False)), "moving": bool(c.get("moving", False)),
            "calibrated": "matrix" in c, "offset_x": ox, "offset_y": oy,
        }

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                place = {"root": r.root, "split": r.split, "session_id": r.session_id}
                try:
                    sections = [v for k, v in tomllib.loads(r.body).items() if isinstance(v, dict) and k != "metadata"]
                except ValueError:
                    sections = [{"size": None}]
                for k, c in enumerate(sections):
                    try:
                        found = camera(c, k)
                    except (ValueError, TypeError):
                        found = {"cam_ix": k}
                    rows.append(place | dict.fromkeys(names) | found)
            yield pd.DataFrame(rows, columns=["root", "split", "session_id", *names], dtype=object)

    return manifest_texts(spark, path, "calibration.toml").mapInPandas(parse, f"{PREFIX}, {CAMERA}")


def read_image_files(spark: SparkSession, path: str) -> DataFrame:
    """Image files below the sessions' group folders: root, split, session_id, group_id, camera, file. Only the listing is read; a file without a byte is no image."""
    with few_listings(spark):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,png}").load(path).select("path")
    place = r"([^/]+)/([^/]+)/([^/]+)/groups/([^/]+)/([^/]+)/([^/]+)$"
    return found.select(*(F.regexp_extract("path", place, k).alias(n) for k, n in enumerate(("root", "split", "session_id", "group_id", "camera", "file"), 1))).where("root <> ''")


def read_table(spark: SparkSession, path: str, stem: str) -> DataFrame:
    """One table of every session; sessions without the file have no rows."""
    with few_listings(spark):
        files = spark.read.schema(TABLES[stem]).option("recursiveFileLookup", "true").option("pathGlobFilter", f"{stem}.pq").parquet(path)
    return _placed(files.select("*", F.col("_metadata.file_path").alias("_file")), F.col("_file")).drop("_file")


def group_defaults(groups: DataFrame) -> DataFrame:
    """Missing starts are 0, steps 1, texts empty; a missing rate stays unknown."""
    return groups.fillna({"source_frame_start": 0, "source_frame_step": 1, "source_video": "", "notes": ""})


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """The clips of every session below a path, with the defaults of what their files leave out."""
    return group_defaults(read_table(spark, path, "groups"))


def read_predictions(keypoints: DataFrame, cameras: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Prediction rows of the first camera, with the logit as confidence; the filter on groups reaches the scan."""
    own = keypoints if groups is None else keypoints.where(F.col("group_id").isin(groups))
    first = F.broadcast(cameras.where("cam_ix = 0").select(F.col("name").alias("camera")))
    return own.join(first, "camera").withColumn("conf", F.col("score_logit"))


def read_annotation_csv(spark: SparkSession, path: str) -> DataFrame:
    """Keypoint rows of CSV files; only visible ones have coordinates, empty texts are null."""
    rows = spark.read.schema("group_id string, frame int, animal int, bodypart string, status string, x double, y double").option("header", "true").csv(path)
    return rows.withColumns({c: F.when(F.col("status") == "visible", F.col(c)) for c in ("x", "y")})


COCO = "images array<struct<id: bigint, group_id: string, frame: int>>, annotations array<struct<image_id: bigint, bbox: array<double>, keypoints: array<double>>>"


def read_coco_json(df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From documents (images, annotations): keypoint rows (flags above 0 are projected, 0 is no row), boxes, and images with several annotations, which are errors."""
    images = df.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.group_id", "i.frame")
    notes = df.select(F.explode("annotations").alias("a")).select("a.*")
    several = notes.groupBy("image_id").count().where("count > 1")
    joined = notes.join(images, "image_id")
    at = lambda k: F.element_at("keypoints", 3 * F.col("k") + k)
    each = joined.select("group_id", "frame", F.posexplode(F.array(*map(F.lit, names))).alias("k", "bodypart"), "keypoints")
    rows = each.where(at(3) > 0).select("group_id", "frame", "bodypart", F.lit("projected").alias("status"), at(1).alias("x"), at(2).alias("y"))
    b = lambda k: F.element_at("bbox", k)
    boxes = joined.select("group_id", "frame", b(1).alias("x0"), b(2).alias("y0"), (b(1) + b(3)).alias("x1"), (b(2) + b(4)).alias("y1"))
    return rows, boxes, several


def read_framesets(df: DataFrame) -> DataFrame:
    """framesets {<trial>/Frame_<N>[__<variant>]: n} as rows trial, frame, variant, n."""
    from kinefold.operators.sets import frame_key

    return df.select(F.explode("framesets").alias("key", "n")).select(frame_key(F.col("key")).alias("k"), "n").select("k.*", "n")


def _pose_points(df: DataFrame, names: list[str], start: str | None, n_frames: str | None, seen: str | None = None) -> DataFrame:
    """The finite points of pose[t][k], with what seen[t][k] holds for them."""
    keys, axis = ["group_id", "animal"], F.array(*map(F.lit, names))
    first = F.coalesce(F.col(start), F.lit(0)) if start else F.lit(0)
    last = F.col(n_frames) if n_frames else F.lit(None)
    rows = df.select(*keys, first.cast("int").alias("_first"), last.cast("int").alias("_n"), *([F.col(seen).alias("_seen")] if seen else []), F.posexplode("pose").alias("_t", "row"))
    rows = rows.withColumn("frame", F.col("_first") + F.col("_t")).where("_n is null or frame < _n")
    parts = rows.select(*keys, "frame", *([F.get("_seen", F.col("_t")).alias("_seen")] if seen else []), F.posexplode("row").alias("k", "p"))
    points = parts.select(*keys, "frame", F.element_at(axis, F.col("k") + 1).alias("bodypart"), finite(F.element_at("p", 1)).alias("x"), finite(F.element_at("p", 2)).alias("y"), *([F.get("_seen", F.col("k")).alias("_seen")] if seen else []))
    return points.where("x is not null and y is not null")


def explode_pose_array(df: DataFrame, names: list[str], *, start: str | None = None, n_frames: str | None = None) -> DataFrame:
    """pose[t][k] = [x, y] of each (group_id, animal): finite points are visible, others have no row, and so have animals without any.

    start names a column with the frame of pose[0], where an array is a block of a clip; n_frames one with the frames that
    the recording really has: later ones are left out.
    """
    points = _pose_points(df, names, start, n_frames)
    return points.select("group_id", "animal", "frame", "bodypart", F.lit("visible").alias("status"), "x", "y")


def explode_visibility(df: DataFrame, names: list[str], cameras: list[str], *, vis: str = "vis", start: str | None = None, n_frames: str | None = None) -> DataFrame:
    """vis[t][k][c] beside pose[t][k]: a row without a place for each finite point and camera, visible or missing; none where vis is null."""
    points = _pose_points(df, names, start, n_frames, vis)
    own = points.select("group_id", "animal", "frame", "bodypart", F.posexplode("_seen").alias("c", "sees"))
    return own.select("group_id", "animal", "frame", F.get(F.array(*map(F.lit, cameras)), F.col("c")).alias("camera"), "bodypart", F.when(F.col("sees"), "visible").otherwise("missing").alias("status")).where("sees is not null and camera is not null")


def read_sequence(df: DataFrame, names: list[str], w: float, h: float, *, start: str | None = None) -> DataFrame:
    """keypoints[t][m] = [[x ..], [y ..]] with boxes[t][m] normalised to the image, as rows with boxes in pixels.

    start names a column with the frame of keypoints[0], where the arrays are a block of a clip.
    """
    first = F.coalesce(F.col(start), F.lit(0)).cast("int") if start else F.lit(0)
    frames = df.select("group_id", first.alias("_first"), F.posexplode(F.arrays_zip("keypoints", "boxes")).alias("_t", "f"))
    mice = frames.select("group_id", (F.col("_first") + F.col("_t")).alias("frame"), F.posexplode(F.arrays_zip(F.col("f.keypoints").alias("k"), F.col("f.boxes").alias("b"))).alias("animal", "m"))
    scale = F.array(*map(F.lit, (w, h, w, h)))
    box = F.zip_with("m.b", scale, lambda v, s: v * s)
    parts = mice.select("group_id", "frame", "animal", F.posexplode(F.arrays_zip(F.element_at("m.k", 1).alias("x"), F.element_at("m.k", 2).alias("y"))).alias("k", "p"), box.alias("box"))
    axis = F.array(*map(F.lit, names))
    corners = {n: F.element_at("box", k + 1) for k, n in enumerate(("x0", "y0", "x1", "y1"))}
    return parts.select("group_id", "frame", "animal", F.element_at(axis, F.col("k") + 1).alias("bodypart"), "p.x", "p.y", *(c.alias(n) for n, c in corners.items()))


def label_status(x: Column) -> Column:
    """Of sources that mark with sentinels: NaN is nothing, infinite is missing, finite is visible."""
    return F.when(F.isnan(x) | x.isNull(), None).when(F.abs(x) == float("inf"), "missing").otherwise("visible")


def rois_to_regions(rois: DataFrame, w: float | Column, h: float | Column) -> tuple[DataFrame, DataFrame]:
    """Vertex rows (group_id, frame, roi, x, y), counted from 1, as upright rectangles counted from 0 and clipped; turned ones (other than two xs and two ys) are errors.

    A region's few corners are a set: counts of distinct xs and ys would take each row three times.
    """
    w, h = (x if isinstance(x, Column) else F.lit(x) for x in (w, h))
    boxes = rois.groupBy("group_id", "frame", "roi").agg(F.max(w).cast("double").alias("w"), F.max(h).cast("double").alias("h"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), *(F.size(F.collect_set(F.col(c) + F.lit(0.0))).alias(f"n{c}") for c in "xy"))
    turned = boxes.where("nx > 2 or ny > 2").select("group_id", "frame", "roi")
    clip = lambda c, m: F.greatest(F.least(F.col(c) - 1, F.col(m)), F.lit(0.0)).alias(c)
    upright = boxes.where("nx <= 2 and ny <= 2").select("group_id", "frame", "roi", clip("x0", "w"), clip("y0", "h"), clip("x1", "w"), clip("y1", "h"))
    return upright.where("x1 > x0 and y1 > y0"), turned


def unblock_xy(df: DataFrame, names: list[str]) -> DataFrame:
    """p = all xs, then all ys of an instance, counted from 1, as a row for each point counted from 0; an empty one gives none."""
    n = len(names)
    keys = [c for c in df.columns if c != "p"]
    parts = df.where(F.size("p") == 2 * n).select(*keys, F.posexplode(F.array(*map(F.lit, names))).alias("k", "bodypart"), "p")
    return parts.select(*keys, "bodypart", (F.element_at("p", F.col("k") + 1) - 1).alias("x"), (F.element_at("p", F.col("k") + 1 + n) - 1).alias("y"))


def split_conflicts(movies: DataFrame) -> DataFrame:
    """Sessions (session_id, split) that would land in several splits, which is an error: session_id, splits."""
    seen = movies.where("split is not null").groupBy("session_id").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return seen.where(F.size("splits") > 1)


def axis_errors(projects: DataFrame, names: list[str]) -> DataFrame:
    """Label projects (project, skeleton_names, label_names, n_points, n_views) whose two lists of names, or their sizes, are not the expected ones: project, field."""
    axis = F.array(*map(F.lit, names))
    wanted = {"skeleton_names": axis, "label_names": axis, "n_points": F.lit(len(names)), "n_views": F.lit(1)}
    wrong = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(x), c) for c, x in wanted.items())))
    return projects.select("project", F.explode(wrong).alias("field"))


def label_movies(movies: DataFrame, labels: DataFrame, rois: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of movies (movie, session_id, split, w, h), their labels (movie, frame, target, p; frames and targets from 1) and certified corners (movie, frame, roi, x, y): points, regions, and what is an error (movie, reason).

    A movie without labels has neither points nor regions. Regions are clipped to their own movie; turned ones, and sessions in two splits, are errors.
    """
    counted = labels.withColumns({"frame": F.col("frame") - 1, "target": F.col("target") - 1})
    own = unblock_xy(counted, names).withColumn("status", label_status(F.col("x")))
    points = movies.select("movie", "session_id", "split").join(own, "movie").where("status is not null")
    points = points.withColumns({c: F.when(F.col("status") == "visible", F.col(c)) for c in ("x", "y")})
    labelled = movies.join(labels.select("movie").distinct(), "movie", "left_semi").select("movie", "w", "h")
    corners = rois.withColumns({"group_id": F.col("movie"), "frame": F.col("frame") - 1}).join(labelled, "movie")
    upright, turned = rois_to_regions(corners, F.col("w"), F.col("h"))
    bad = split_conflicts(movies).select("session_id").join(movies, "session_id").select("movie", F.lit("session in two splits").alias("reason"))
    errors = turned.select(F.col("group_id").alias("movie"), F.lit("turned region").alias("reason")).distinct().union(bad)
    return points, upright.withColumnRenamed("group_id", "movie"), errors


def video_manifest(files: DataFrame, pattern: str, cameras: list[str]) -> tuple[DataFrame, DataFrame]:
    """File names (name, n_frames) as (group_id, camera, ...), and what is refused: no match, a camera twice in a group, a camera that a group lacks. Cameras out of the rig are skipped."""
    hit = F.regexp_extract("name", pattern, 0)
    camera = F.regexp_extract("name", pattern, 1)
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    own = files.withColumns({"camera": F.when(hit != "", camera), "group_id": F.replace(stem, hit, F.lit(""))})
    none = own.where("camera is null").select("name", F.lit("no match").alias("reason"))
    rig = own.where(F.col("camera").isin(cameras))
    counts = rig.groupBy("group_id", "camera").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    twice = counts.where("n > 1").select("name", F.lit("camera twice").alias("reason"))
    lacks = counts.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).where(F.col("n") < len(cameras)).select("name", F.lit("camera missing").alias("reason"))
    return rig.select("group_id", "camera", "name", "n_frames"), none.union(twice).union(lacks)


def manifest_reconcile(manifest: DataFrame) -> DataFrame:
    """Per group: the cameras' lengths, whether they agree, and the length to trim to."""
    return manifest.groupBy("group_id").agg(F.min("n_frames").alias("trim_to"), F.max("n_frames").alias("longest"), (F.min("n_frames") == F.max("n_frames")).alias("agrees"), F.countDistinct("camera").alias("n_cameras"))


def filled_sizes(cameras: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cameras (name, width, height); one that has no size takes that of its first group's video in the manifest (group_id, camera, w, h)."""
    first = manifest.groupBy(F.col("camera").alias("name")).agg(F.min(F.struct("group_id", "w", "h")).alias("_first"))
    sized = F.col("width").isNotNull() & F.col("height").isNotNull()
    own = {c: F.when(sized, F.col(c)).otherwise(F.col(f"_first.{v}")) for c, v in (("width", "w"), ("height", "h"))}
    return cameras.join(first, "name", "left").withColumns(own).drop("_first")


def size_refusals(manifest: DataFrame, cameras: DataFrame) -> DataFrame:
    """Videos whose size is not their camera's: a calibration holds for its own resolution alone. One row each, with both sizes."""
    sizes = filled_sizes(cameras, manifest).select(F.col("name").alias("camera"), "width", "height")
    return manifest.join(sizes, "camera").where("w <> width or h <> height").select("group_id", "camera", "w", "h", "width", "height")


def image_file_manifest(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups and cameras whose image files (group_id, camera, file) break the rule: as many as frames, one extension, numbered %06d (from a million on with more digits) without a gap."""
    number, extension = F.regexp_extract("file", r"^(\d{6}|[1-9]\d{6,})\.", 1), F.regexp_extract("file", r"\.([^.]+)$", 1)
    seen = files.groupBy("group_id", "camera").agg(F.count(F.lit(1)).alias("n"), F.min(F.expr("try_cast(nullif(regexp_extract(file, '^([0-9]{6}|[1-9][0-9]{6,})[.]', 1), '') AS INT)")).alias("first"), F.max(F.expr("try_cast(nullif(regexp_extract(file, '^([0-9]{6}|[1-9][0-9]{6,})[.]', 1), '') AS INT)")).alias("last"), F.countDistinct(extension).alias("extensions"), F.count_if(number == "").alias("unnumbered"))
    joined = seen.join(groups.select("group_id", "n_frames"), "group_id")
    bad = (F.col("n") != F.col("n_frames")) | (F.col("extensions") != 1) | (F.col("unnumbered") > 0) | (F.col("first") != 0) | (F.col("last") != F.col("n") - 1)
    return joined.where(bad).select("group_id", "camera", "n", "n_frames", "first", "last", "extensions")
