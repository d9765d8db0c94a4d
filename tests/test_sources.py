import pytest
from pyspark.sql import functions as F

from kinefold.operators import validate as v
from kinefold.sources import readers as rd
from kinefold.sources import writers as wr


@pytest.fixture
def root(tmp_path, spark):
    for split, name, mode in (("train", "s1", "2d"), ("val", "s2", "3d"), ("test", "bad", "4d")):
        d = tmp_path / "rats" / split / name
        d.mkdir(parents=True)
        (d / "session.toml").write_text(f'mode = "{mode}"\nunits = "px"\nlabels = "annotated"\nnames = ["nose", "tail"]\nflip_pairs = [["nose", "tail"]]\n[provenance]\nby = "hand"\n')
        (d / "calibration.toml").write_text('[cam_0]\nname = "c0"\nsize = [64, 48]\n[cam_1]\nname = "c1"\nsize = [64, 48]\nmatrix = [[9.0, 0, 32], [0, 9.0, 24], [0, 0, 1]]\nrotation = [0, 0, 0]\ntranslation = [0, 0, 1]\n')
    return str(tmp_path / "rats")


def test_catalog_and_manifests(spark, root, tmp_path):
    assert {(r.root, r.split, r.session_id) for r in rd.catalog(spark, root).collect()} == {("rats", "train", "s1"), ("rats", "val", "s2"), ("rats", "test", "bad")}
    rows = {r.session_id: r for r in rd.read_sessions(spark, root).collect()}
    assert rows["s1"].names == ["nose", "tail"] and rows["s1"].assoc_res_max_px == 30.0 and rows["s1"].provenance == {"by": "hand"}
    assert rows["bad"].violation and rows["bad"].mode is None
    assert v.check_v1(rd.read_sessions(spark, root)).count() == 1
    with pytest.raises(FileNotFoundError):
        rd.catalog(spark, str((tmp_path / "none").mkdir() or tmp_path / "none"))


def test_nominal_cameras_are_not_promoted(spark, root):
    cameras = rd.read_cameras(spark, root).where("session_id = 's1'")
    rows = {r.name: r for r in cameras.collect()}
    assert rows["c0"].matrix == [64.0, 0.0, 32.0, 0.0, 64.0, 24.0, 0.0, 0.0, 1.0] and not rows["c0"].calibrated
    assert rows["c1"].calibrated and rows["c1"].cam_ix == 1
    assert [r.matrix for r in wr.camera_rows(cameras).where("name = 'c0'").collect()] == [None]


def test_camera_counts(spark, root):
    sessions, cameras = rd.read_sessions(spark, root).where("violation is null"), rd.read_cameras(spark, root)
    out = {r.session_id for r in v.check_v4(sessions, cameras).collect()}
    assert out == {"s1", "s2"}


def test_names_and_flips(spark):
    df = spark.createDataFrame([("a", ["x", "y"], [["x", "y"]]), ("b", ["x", "x"], None), ("c", ["x", "y", "z"], [["x", "y"], ["x", "z"]]), ("d", ["x"], [["x", "q"]])], "session_id string, names array<string>, flip_pairs array<array<string>>")
    out = {(r.session_id, r.message) for r in v.check_v2(df).collect()}
    assert out == {("b", "duplicate name"), ("c", "not an involution"), ("d", "unknown name")}


def test_axis_warnings(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y", "x"]), ("c", ["x"])], "session_id string, names array<string>")
    assert {(r.session_id, r.message, r.severity) for r in v.check_v3(df, ["x", "y"]).collect()} == {("b", "reordered", "warning"), ("c", "subset", "warning")}


def test_variant_keys_and_sequences(spark):
    from kinefold.operators.sets import frame_key

    df = spark.createDataFrame([("t/Frame_7",), ("a/b/Frame_12__flip",)], "k string").select(frame_key(F.col("k")).alias("f")).select("f.*")
    assert {tuple(r) for r in df.collect()} == {("t", 7, None), ("a/b", 12, "flip")}
    seq = spark.createDataFrame([("g", [[[[1.0, 2.0], [3.0, 4.0]]]], [[[0.0, 0.5, 1.0, 1.0]]])], "group_id string, keypoints array<array<array<array<double>>>>, boxes array<array<array<double>>>")
    rows = {r.bodypart: r for r in rd.read_sequence(seq, ["p", "q"], 100.0, 50.0).collect()}
    assert (rows["q"].x, rows["q"].y, rows["q"].y0, rows["q"].x1) == (2.0, 4.0, 25.0, 100.0)


def test_views_that_do_not_meet(spark):
    df = spark.createDataFrame([("s", 0, 1, 50.0), ("s", 1, 1, 3.0)], "group_id string, frame int, animal int, residual double")
    assert v.check_v12(df, 30.0).first().n == 1


def test_camera_files_that_break_kill_no_job(spark, tmp_path):
    for name, text in (("a", "[cam_0\n"), ("b", '[cam_0]\nsize = [64, 48]\n[metadata]\n'), ("c", '[cam_0]\nname = "c0"\n'), ("d", '[cam_0]\nname = "c0"\nsize = [64, 48]\nmatrix = [1.0]\n')):
        (tmp_path / "r" / "train" / name).mkdir(parents=True)
        (tmp_path / "r" / "train" / name / "calibration.toml").write_text(text)
    rows = {r.session_id: r for r in rd.read_cameras(spark, str(tmp_path)).collect()}
    assert {k: (r.name, r.width) for k, r in rows.items()} == {"a": (None, None), "b": (None, 64), "c": ("c0", None), "d": (None, None)}
    assert v.check_v4(spark.createDataFrame([], "session_id string, mode string"), rd.read_cameras(spark, str(tmp_path))).count() == 4


def test_texts_come_back(spark, tmp_path):
    df = spark.createDataFrame([("r", "val", 's "1"', "2d", "px", "annotated", ['a"b', "c\\d"], None, 4.0)], "root string, split string, session_id string, mode string, units string, labels string, names array<string>, skeleton array<array<string>>, assoc_res_max_px double")
    assert wr.write_texts(wr.session_text(df), str(tmp_path), "session.toml") == 1
    got = rd.read_sessions(spark, str(tmp_path)).first()
    assert (got.root, got.split, got.names, got.assoc_res_max_px, got.violation) == ("r", "val", ['a"b', "c\\d"], 4.0, None)


def test_names_of_roots(spark):
    from kinefold.operators.sets import names_disagree

    df = spark.createDataFrame([("a", "train", "s", ["x", "y"]), ("b", "train", "s", ["y", "x"]), ("b", "val", "t", ["x", "z"]), ("b", "val", "u", None)], "root string, split string, session_id string, names array<string>")
    assert [r.session_id for r in names_disagree(df).collect()] == ["t"]


def test_contract_over_a_path(spark, tmp_path):
    """Two sessions of two cameras, one that obeys every rule and one that breaks as many as one folder can."""
    from kinefold.functions.geometry import Camera, project, rodrigues
    from kinefold.sources.contract import validate

    lit = F.lit
    place = ["root", "split", "session_id"]
    sessions = spark.createDataFrame([("r", "train", "good", "3d", ["p", "q"]), ("r", "test", "bad", "3d", ["p", "q"])], "root string, split string, session_id string, mode string, names array<string>").withColumns({"units": lit("mm"), "labels": lit("annotated")})
    path = str(tmp_path)
    wr.write_texts(wr.session_text(sessions), path, "session.toml")
    cams = sessions.select(*place, F.explode(F.array(lit(0), lit(1))).alias("cam_ix")).withColumns({"name": F.concat(lit("c"), "cam_ix"), "width": lit(200), "height": lit(200), "matrix": F.array(*map(lit, (100.0, 0.0, 100.0, 0.0, 100.0, 100.0, 0.0, 0.0, 1.0))), "distortions": F.array(*[lit(0.0)] * 5), "rvec": F.array(lit(0.0), F.col("cam_ix") * 0.4, lit(0.0)), "tvec": F.array(F.col("cam_ix") * -1.0, lit(0.0), lit(5.0)), "fisheye": lit(False), "moving": lit(False), "calibrated": lit(True), "offset_x": lit(0.0), "offset_y": lit(0.0)})
    wr.write_texts(wr.camera_text(cams), path, "calibration.toml")
    wr.write_session_files(sessions.select(*place, lit("g").alias("group_id"), lit(3).alias("n_frames")), path, "groups")
    points = spark.createDataFrame([("p", 0.1, 0.2, 0.3), ("q", -0.3, 0.1, 0.1)], "bodypart string, px double, py double, pz double")
    cells = rodrigues(F.element_at("rvec", 1), F.element_at("rvec", 2), F.element_at("rvec", 3))
    seen = project(cams.crossJoin(points).withColumn("frame", F.explode(F.array(lit(0), lit(1), lit(2)))).withColumns({f"r{k}": c for k, c in enumerate(cells)}), Camera(lit(100.0), lit(100.0), lit(100.0), lit(100.0), tuple(F.col(f"r{k}") for k in range(9)), tuple(F.element_at("tvec", k) for k in (1, 2, 3)), tuple(lit(0.0) for _ in range(5)), lit(0.0), lit(0.0)), "px", "py", "pz")
    bad = F.col("session_id") == "bad"
    rows = seen.select(*place, lit("g").alias("group_id"), "frame", lit("m").alias("animal_id"), F.col("name").alias("camera"), "bodypart", lit("visible").alias("status"), F.col("u").cast("float").alias("x"), (F.col("v") + F.when(bad & (F.col("cam_ix") == 1), 150.0).otherwise(0.0)).cast("float").alias("y"))
    first = rows.where(bad & (F.col("frame") == 0) & (F.col("camera") == "c0") & (F.col("bodypart") == "p"))
    odd = first.withColumn("bodypart", lit("zz")).unionByName(first.withColumn("camera", lit("c9"))).unionByName(first.withColumn("frame", lit(3))).unionByName(first.withColumn("group_id", lit("none"))).unionByName(first)
    wr.write_session_files(rows.unionByName(odd), path, "keypoints")
    boxes = rows.where("bodypart = 'p'").select(*place, "group_id", "frame", "animal_id", "camera", *(lit(v).cast("float").alias(c) for c, v in (("x0", 1), ("y0", 1), ("x1", 9), ("y1", 9))), F.when(bad & (F.col("frame") == 2), "present").otherwise("labeled").alias("status"))
    wr.write_session_files(boxes, path, "instances")
    for name, files in (("train/good", ("000000.jpg", "000001.jpg", "000002.jpg")), ("test/bad", ("000000.jpg", "000001.png", "000002.jpg"))):
        for c in ("c0", "c1"):
            folder = tmp_path / "r" / name / "groups" / "g" / c
            folder.mkdir(parents=True)
            for f in files:
                (folder / f).write_bytes(b"x")
    out = {(r.rule, r.session_id, r.message): r.n for r in validate(spark, path).collect()}
    assert out == {
        ("V-6", "r/test/bad", "unknown bodypart"): 1, ("V-6", "r/test/bad", "unknown camera"): 1, ("V-6", "r/test/bad", "frame out of range"): 1, ("V-6", "r/test/bad", "unknown group"): 1,
        ("V-7", "r/test/bad", "image files"): 2, ("V-9", "r/test/bad", "duplicate key"): 1, ("V-11", "r/test/bad", "keypoints without an instance"): 3, ("V-12", "r/test/bad", "views do not meet"): 1,
    }


def test_sizes_of_videos(spark):
    """A camera without a size takes its first group's; one out of the rig, or equal, is not refused."""
    cams = spark.createDataFrame([("a", 4, 3), ("b", None, None), ("d", 4, None)], "name string, width int, height int")
    videos = spark.createDataFrame([("g1", "a", 4, 3), ("g2", "a", 8, 6), ("g1", "b", 5, 5), ("g2", "b", 5, 5), ("g3", "b", 5, 6), ("g1", "c", 1, 1), ("g1", "d", 7, 7)], "group_id string, camera string, w int, h int")
    assert sorted(tuple(r) for r in rd.size_refusals(videos, cams).collect()) == [("g2", "a", 8, 6, 4, 3), ("g3", "b", 5, 6, 5, 5)]
    assert rd.size_refusals(videos.where("false"), cams).count() == 0


def test_label_movies(spark):
    """A movie without labels has no regions, regions are clipped to their movie, a session in two splits is an error for each of its movies."""
    movies = spark.createDataFrame([("m", "s", "train", 10, 8), ("n", "s", "test", 10, 8), ("o", "t", "val", 100, 80)], "movie string, session_id string, split string, w int, h int")
    inf, nan = float("inf"), float("nan")
    labels = spark.createDataFrame([("m", 1, 1, [2.0, inf, 3.0, inf]), ("m", 2, 1, [nan, 4.0, nan, 5.0]), ("m", 3, 1, []), ("o", 1, 2, [1.0, 1.0, 1.0, 1.0]), ("z", 1, 1, [1.0] * 4)], "movie string, frame int, target int, p array<double>")
    corners = [(m, 1, 1, x, y) for m in ("m", "n", "o") for x, y in ((1.0, 1.0), (50.0, 1.0), (50.0, 50.0), (1.0, 50.0))] + [("m", 2, 1, x, y) for x, y in ((1.0, 2.0), (5.0, 1.0), (6.0, 5.0), (2.0, 6.0))]
    points, regions, errors = rd.label_movies(movies, labels, spark.createDataFrame(corners, "movie string, frame int, roi int, x double, y double"), ["p", "q"])
    got = sorted((r.movie, r.frame, r.target, r.bodypart, r.status, r.x, r.y) for r in points.collect())
    assert got == [("m", 0, 0, "p", "visible", 1.0, 2.0), ("m", 0, 0, "q", "missing", None, None), ("m", 1, 0, "q", "visible", 3.0, 4.0), ("o", 0, 1, "p", "visible", 0.0, 0.0), ("o", 0, 1, "q", "visible", 0.0, 0.0)]
    assert sorted((r.movie, r.frame, r.x1, r.y1) for r in regions.collect()) == [("m", 0, 10.0, 8.0), ("o", 0, 49.0, 49.0)]
    assert sorted(tuple(r) for r in errors.collect()) == [("m", "session in two splits"), ("m", "turned region"), ("n", "session in two splits")]


def test_window_outcomes_without_crops(spark):
    df = spark.createDataFrame([(0, 1, True), (1, 1, False), (1, 0, True), (1, 1, True)], "n_boxes int, n_points int, has_camera boolean")
    assert [r.outcome for r in wr.window_outcomes(df).collect()] == ["no box", "no camera", "no points", "ok"]
    crop = df.selectExpr("*", "1 AS x0", "1 AS y0", "CASE WHEN n_points > 0 THEN 1 + n_boxes END AS x1", "2 AS y1", "CAST(NULL AS boolean) AS decoded")
    assert [(r.outcome, r.x0) for r in wr.window_outcomes(crop).collect()] == [("no box", None), ("no camera", None), ("no points", None), ("decode failed", 1)]


def test_weights_of_cells_with_nulls(spark):
    """Entries without a label source or mode are a cell like any other."""
    from kinefold.operators.sampling import pool_weights

    df = spark.createDataFrame([("a", "2d"), ("a", "2d"), ("a", "3d"), (None, "2d"), (None, None)], "label_source string, mode string")
    got = pool_weights(df, None, 0.5)
    assert got.columns == df.columns + ["w"] and got.count() == 5
    assert sorted((str(r.label_source), str(r.mode), round(r.w, 9)) for r in got.collect()) == [("None", "2d", 0.2), ("None", "None", 0.2), ("a", "2d", 0.15), ("a", "2d", 0.15), ("a", "3d", 0.3)]
