"""Writers of the annotation tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinefold.functions.geometry import Box, sigmoid
from kinefold.functions.status import finite
from kinefold.sources.tables import materialize, qualified, shared_path

ROWS_A_FILE = 250_000
#: Frames of a clip that one task writes together.
FRAMES_A_TASK = 32_768
#: Tasks a core that write texts, each as a file.
TEXT_TASKS_A_CORE = 4
PLACE = ["root", "split", "session_id"]
# How a window ended.
OUTCOMES = ("ok", "no box", "no camera", "no points", "crop failed", "decode failed")


def write_table(df: DataFrame, path: str, keys: tuple[str, ...] = ("root", "split", "session_id")) -> None:
    """Zstd Parquet in partitions of the keys, each file sorted by clip and frame (a long clip is written in ranges of frames); no row where nothing was determined, and no number that is not finite. An empty layer is written too: no file and no rows differ."""
    numbers = [c for c, t in df.dtypes if t in ("float", "double")]
    clean = df.withColumns({c: finite(F.col(c)).cast(dict(df.dtypes)[c]) for c in numbers})
    if "status" in df.columns:
        clean = clean.where("status is null or status <> 'unlabeled'")
    order = [c for c in ("group_id", "frame") if c in df.columns]
    ranges = [F.floor(F.col("frame") / FRAMES_A_TASK)] if "frame" in order else []
    clean.repartition(*keys, *order[:1], *ranges).sortWithinPartitions(*keys, *order).write.partitionBy(*keys).option("compression", "zstd").option("maxRecordsPerFile", ROWS_A_FILE).parquet(path)


def prediction_rows(pred: DataFrame) -> DataFrame:
    """Finite points as visible rows, with the logit beside its sigmoid (which saturates in single precision)."""
    x, y = finite(F.col("x")), finite(F.col("y"))
    rows = pred.withColumns({"x": x, "y": y}).where("x is not null and y is not null")
    return rows.withColumns({"status": F.lit("visible"), "score": sigmoid(F.col("logit")), "score_logit": F.col("logit")}).drop("logit")


def window_outcomes(windows: DataFrame) -> DataFrame:
    """What became of each (animal, window, camera) with n_boxes, n_points and has_camera.

    With the window's crop (x0, y0, x1, y1; null or without area: it failed) and decoded, false where its pixels could not be read,
    there are two outcomes more; the crop stays where one was cut, whether it could be read or not.
    """
    outcome = F.when(F.col("n_boxes") == 0, OUTCOMES[1]).when(~F.col("has_camera"), OUTCOMES[2]).when(F.col("n_points") == 0, OUTCOMES[3])
    cropped = set(Box._fields) <= set(windows.columns)
    if cropped:
        outcome = outcome.when(~Box.named().is_box, OUTCOMES[4])
    if "decoded" in windows.columns:
        outcome = outcome.when(~F.coalesce("decoded", F.lit(False)), OUTCOMES[5])
    own = windows.withColumn("outcome", outcome.otherwise(OUTCOMES[0]))
    cut = F.col("outcome").isin(OUTCOMES[0], OUTCOMES[5])
    return own.withColumns({c: F.when(cut, F.col(c)) for c in Box._fields}) if cropped else own


def camera_rows(cameras: DataFrame) -> DataFrame:
    """Uncalibrated cameras keep their name, size and offset only, so that reading them makes no calibration of a nominal pinhole."""
    return cameras.withColumns({c: F.when(F.col("calibrated"), F.col(c)) for c in ("matrix", "distortions", "rvec", "tvec")})


def _text(c: str | Column) -> Column:
    """A text as a quoted TOML string."""
    return F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)


def session_text(sessions: DataFrame) -> DataFrame:
    """root, split, session_id and the body of session.toml; what is null is left out."""
    texts = [F.concat(F.lit(f"{k} = "), _text(k)) for k in ("mode", "units", "labels") if k in sessions.columns]
    lists = [F.concat(F.lit(f"{k} = "), F.to_json(k)) for k in ("names", "skeleton", "flip_pairs") if k in sessions.columns]
    numbers = [F.concat(F.lit(f"{k} = "), F.col(k).cast("string")) for k in ("assoc_res_max_px",) if k in sessions.columns]
    return sessions.select(*PLACE, F.concat_ws("\n", *texts, *lists, *numbers, F.lit("")).alias("body"))


def camera_text(cameras: DataFrame) -> DataFrame:
    """root, split, session_id and the body of calibration.toml, cameras in their order; uncalibrated ones say name, size, offset and moving only."""
    own = camera_rows(cameras)
    nine = F.transform(F.array(F.lit(1), F.lit(4), F.lit(7)), lambda k: F.slice("matrix", k, F.lit(3)))
    lines = [
        F.concat(F.lit("[cam_"), F.col("cam_ix").cast("string"), F.lit("]")),
        F.concat(F.lit("name = "), _text("name")),
        F.when(F.col("width").isNotNull(), F.concat(F.lit("size = "), F.to_json(F.array("width", "height")))),
        F.when(F.col("matrix").isNotNull(), F.concat(F.lit("matrix = "), F.to_json(nine))),
        *(F.concat(F.lit(f"{k} = "), F.to_json(c)) for k, c in (("distortions", "distortions"), ("rotation", "rvec"), ("translation", "tvec"))),
        F.when(F.col("calibrated"), F.concat(F.lit("fisheye = "), F.col("fisheye").cast("string"))),
        F.concat(F.lit("offset = "), F.to_json(F.array("offset_x", "offset_y"))),
        F.concat(F.lit("moving = "), F.col("moving").cast("string")),
    ]
    sections = F.array_sort(F.collect_list(F.struct("cam_ix", F.concat_ws("\n", *lines, F.lit("")).alias("text"))))
    return own.groupBy(*PLACE).agg(F.array_join(F.transform(sections, lambda x: x["text"]), "\n").alias("body"))


def _session_folder(path: str, place: tuple[str, ...]):
    """The file system of a root's parent folder, and a session's folder there, made if it is not."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    folder = "/".join([base.rstrip("/"), *place])
    store.create_dir(folder, recursive=True)
    return store, folder


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, str, str], pa.RecordBatch]]:
    """The rows of a sorted batch by session, without the columns that name it."""
    new = np.zeros(batch.num_rows, bool)
    for k in PLACE:
        code = batch.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            yield tuple(batch.column(k)[a].as_py() for k in PLACE), batch.slice(a, b - a).drop_columns(PLACE)


def write_texts(texts: DataFrame, path: str, name: str) -> int:
    """The body of each row as <path>/<root>/<split>/<session_id>/<name>; how many were written. A file is renamed when it is whole.

    The rows are few bytes beside the work of a file, so they are dealt to several tasks a core.
    """
    path = qualified(texts.sparkSession, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                store, folder = _session_folder(path, tuple(row[k] for k in PLACE))
                part = f"{folder}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(row["body"].encode())
                store.move(part, f"{folder}/{name}")
                n += 1
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    dealt = texts.select(*PLACE, "body").repartition(TEXT_TASKS_A_CORE * texts.sparkSession.sparkContext.defaultParallelism, *PLACE)
    return dealt.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def write_session_files(df: DataFrame, path: str, stem: str) -> int:
    """A table as <path>/<root>/<split>/<session_id>/<stem>.pq, zstd Parquet sorted by clip and frame; how many files were written.

    Rows are sorted apart, in ranges of (session, clip, frame), and written as parts. The format keeps a session's table in one
    file, so one task a session strings its parts together, a batch at a time; it neither sorts nor holds them. A repeated task
    replaces its file, and its earlier parts are not listed.
    """
    spark = df.sparkSession
    path, parts = qualified(spark, path), qualified(spark, shared_path(spark))
    order = [*PLACE, *(c for c in ("group_id", "frame") if c in df.columns)]
    texts = [c for c, t in df.dtypes if t == "string" and c not in PLACE]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, place, name, out = TaskContext.get().partitionId(), None, None, None
        store, folder = _session_folder(parts, (str(number),))
        for batch in batches:
            for here, own in _runs(batch):
                if here != place:
                    if out is not None:
                        out.close()
                        yield pa.RecordBatch.from_pylist([dict(zip(PLACE, place, strict=True)) | {"number": number, "name": name}])
                    place, name = here, f"{folder}/{uuid.uuid4().hex}"
                    out = pq.ParquetWriter(name, own.schema, filesystem=store, compression="zstd")
                out.write_batch(own)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([dict(zip(PLACE, place, strict=True)) | {"number": number, "name": name}])

    def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, (held, _) = 0, _session_folder(parts, ())

        def rows(names: list[str]) -> Iterator[pa.Table]:
            """The rows of parts, put together to row groups."""
            few, size = [], 0
            for name in names:
                with held.open_input_file(name) as f:
                    for own in pq.ParquetFile(f, read_dictionary=texts).iter_batches(ROWS_A_FILE):
                        few.append(own)
                        size += own.num_rows
                        if size >= ROWS_A_FILE:
                            yield pa.Table.from_batches(few).unify_dictionaries()
                            few, size = [], 0
            if few:
                yield pa.Table.from_batches(few).unify_dictionaries()

        for batch in batches:
            for row in batch.to_pylist():
                store, folder = _session_folder(path, tuple(row[k] for k in PLACE))
                whole, out = f"{folder}/_{uuid.uuid4().hex}", None
                for own in rows(row["names"]):
                    out = out or pq.ParquetWriter(whole, own.schema, filesystem=store, compression="zstd", store_schema=False)
                    out.write_table(own, row_group_size=2 * ROWS_A_FILE)
                out.close()
                store.move(whole, f"{folder}/{stem}.pq")
                n += 1
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    kinds = ", ".join(f"{k} string" for k in PLACE)
    listed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, f"{kinds}, number long, name string"), "parts")
    sessions = listed.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("number", "name"))).alias("p")).select(*PLACE, F.col("p.name").alias("names"))
    return sessions.repartitionByRange(max(sessions.count(), 1), *PLACE).mapInArrow(string, "n long").agg(F.sum("n")).first()[0] or 0
