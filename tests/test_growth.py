"""What must hold so that the work grows no faster than the tables."""

from pyspark.sql import functions as F

from kinefold.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_follow_reads_a_clip_once(spark):
    """No frame of rows reaches from each row to its clip's end."""
    assert "specifiedwindowframe(RowFrame, currentrow$(), unboundedfollowing$())" not in plan(QUERIES["wn12_follow"](spark, DATA))


def test_windows_frames_are_not_broadcast(spark):
    """Eight clips become millions of frames, which a broadcast would take through the driver."""
    df = QUERIES["wn8_last_window_owns"](spark, DATA)
    df.collect()
    assert "BroadcastHashJoin" not in plan(df)


def test_a_million_image_files_are_numbered(spark):
    """%06d has seven digits from a million on; a leading zero there, or five digits, is no number."""
    from kinefold.sources.readers import image_file_manifest

    files = spark.range(1_000_002).select(F.lit("a").alias("group_id"), F.lit("c").alias("camera"), F.concat(F.format_string("%06d", "id"), F.lit(".jpg")).alias("file"))
    groups = spark.createDataFrame([("a", 1_000_002)], "group_id string, n_frames int")
    assert image_file_manifest(files, groups).count() == 0
    for bad in ("01000001.jpg", "00001.jpg"):
        renamed = files.withColumn("file", F.when(F.col("file") == "1000001.jpg", bad).otherwise(F.col("file")))
        assert image_file_manifest(renamed, groups).count() == 1


def test_sequences_come_in_blocks(spark):
    """A block of a clip's arrays says where it begins, and a clip that starts late has no blocks before."""
    from kinefold.sources.readers import read_sequence

    seq = spark.createDataFrame([("g", 1024, [[[[1.0], [3.0]]], [[[2.0], [4.0]]]], [[[0.0, 0.5, 1.0, 1.0]]] * 2)], "group_id string, t0 int, keypoints array<array<array<array<double>>>>, boxes array<array<array<double>>>")
    assert {(r.frame, r.animal, r.x, r.y) for r in read_sequence(seq, ["p"], 100.0, 50.0, start="t0").collect()} == {(1024, 0, 1.0, 3.0), (1025, 0, 2.0, 4.0)}


def test_a_long_clip_is_written_by_several_tasks(spark, tmp_path):
    """A clip's ranges of frames are dealt apart; every file is still sorted."""
    from kinefold.sources.writers import FRAMES_A_TASK, write_table

    rows = spark.range(8).select(F.lit("g").alias("group_id"), (F.col("id") * FRAMES_A_TASK).cast("int").alias("frame"), F.lit("s").alias("session_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_table(rows, str(tmp_path / "out"), ("session_id",))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = spark.read.parquet(str(tmp_path / "out")).select("frame", F.input_file_name().alias("file")).collect()
    assert sorted(r.frame for r in found) == [k * FRAMES_A_TASK for k in range(8)] and len({r.file for r in found}) > 1


def test_matches_are_solved_once(spark):
    """The counts ask five times for the matches, which are read."""
    assert "FlatMapGroupsInArrow" not in plan(QUERIES["ag6_mota"](spark, DATA))


def test_runs_meet_a_batch_in_one_sweep():
    """Four thousand runs of a key, and one event in each gap's middle: no event is held against every run, and a timer closes all that have ended."""
    import json
    import time
    from types import SimpleNamespace

    import pandas as pd

    from kinefold.streaming.windows import _SessionWindows

    class Value:
        body = None

        def get(self):
            return self.body

        def exists(self):
            return self.body is not None

        def update(self, body):
            self.body = body

    timers, state = set(), Value()
    handle = SimpleNamespace(getValueState=lambda *_: state, registerTimer=timers.add, deleteTimer=timers.discard)
    windows = _SessionWindows("user_id", 10, 10)
    windows.init(handle)
    at = lambda mark: SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
    batch = lambda *ms: pd.DataFrame({"text": "=7", "at": ms, "value": 1.0})
    began = time.process_time()
    assert list(windows.handleInputRows((7,), iter([batch(*range(0, 400_000, 40))]), at(0))) == []
    assert list(windows.handleInputRows((7,), iter([batch(*range(9, 400_000, 40), 399_990)]), at(0))) == []
    assert time.process_time() - began < 5
    runs = json.loads(state.get()[0])
    assert len(runs) == 10_001 and runs[0] == ["=7", 0, 19, 2, 2.0] and runs[-1] == ["=7", 399_990, 400_000, 1, 1.0] and len(timers) == 1
    late = pd.concat(windows.handleInputRows((7,), iter([batch(5)]), at(15)))
    assert late.values.tolist() == [["=7", "late", 5, 15, 1, 1.0]]
    done = pd.concat(windows.handleExpiredTimer((7,), at(100), SimpleNamespace(getExpiryTimeInMs=lambda: min(timers))))
    assert done[["start_ms", "end_ms"]].values.tolist() == [[0, 19], [40, 59], [80, 99]] and len(json.loads(state.get()[0])) == 9_998


def test_keys_of_runs_come_back(spark):
    """Keys go as text, and are the same behind it, null and empty apart."""
    from kinefold.streaming.windows import _key_text, _text_key

    rows = spark.sql("SELECT * FROM VALUES (9007199254740993L, 'a', TIMESTAMP'2024-03-31 02:30:00.123456', X'ff00'), (NULL, '', NULL, X''), (-1L, NULL, TIMESTAMP'1969-01-01', NULL) AS t(k, s, t, b)")
    for name, kind in rows.dtypes:
        back = rows.select(name, _key_text(name, kind).alias("text")).select(name, _text_key(kind).alias("back"))
        assert back.where(~F.col(name).eqNullSafe(F.col("back"))).count() == 0, name


def test_rays_are_found_for_many_frames_at_once(monkeypatch):
    """A detection's ray is found once, not in each of its triangulations; the same as frame by frame."""
    import numpy as np
    import pandas as pd

    from kinefold.operators.multiview import Rig
    from kinefold.streaming.tracking import CrossViewTracker, _run

    turn = lambda a: [[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]]
    rig = Rig(["a", "b", "c"], np.full((3, 2), 300.0), np.full((3, 2), 100.0), np.array([turn(-0.4), turn(0), turn(0.5)]), np.array([[0, 0, 6.0]] * 3), np.tile([-0.1, 0.02, 0.001, -0.001, 0.005], (3, 1)), np.zeros((3, 2)))
    at = np.array([[k - 1.5, 0.3 * k, 0.1 * k] for k in range(4)])
    rows = []
    for frame in range(30):
        for c, name in enumerate(rig.names):
            for k, (u, v) in enumerate(rig.project(at + 0.01 * frame, np.full(4, c))):
                rows.append(("g", frame, name, (k + frame) % 4, u - 9, v - 9, u + 9, v + 9))
    rows = pd.DataFrame(rows, columns=["group_id", "frame", "camera", "det", "x0", "y0", "x1", "y1"]).sort_values(["frame", "camera", "det"])
    calls, rays = [], Rig.rays
    monkeypatch.setattr(Rig, "rays", lambda *a: calls.append(1) or rays(*a))
    got = _run(CrossViewTracker(rig, 4, max_res=2.0), "g", rows)[0]
    assert len(calls) == 1 and len(got) == 360
    one = CrossViewTracker(rig, 4, max_res=2.0)
    alone = [x for f, own in rows.groupby("frame") for x in one.step(f, [(r.camera, r.det, (r.x0, r.y0, r.x1, r.y1)) for r in own.itertuples()])]
    assert [(x[2], x[3], x[4]) for x in got] == [(row, d[0], d[1]) for row, d in alone]
    assert all(len({x[2] for x in got if (x[4] - x[1]) % 4 == k}) == 1 for k in range(4))


def test_small_assignments_equal_the_arrays(monkeypatch):
    """Ties too: whole numbers from a narrow range."""
    import numpy as np

    from kinefold.operators import matching

    rng = np.random.default_rng(2)
    costs = [rng.integers(0, 4, (rng.integers(1, 8), rng.integers(1, 8))).astype(float) for _ in range(300)]
    small = [matching.assignment(c) for c in costs]
    monkeypatch.setattr(matching, "SMALL", 0)
    assert small == [matching.assignment(c) for c in costs]


def test_solvers_are_not_put_together(spark):
    """Clips of few bytes are minutes of work: their partitions stay as many as a shuffle has."""
    from kinefold.plans.q_tracking import track_dets
    from kinefold.streaming.tracking import RowLinker, track

    assert "REPARTITION_BY_NUM" in plan(track(track_dets(spark, DATA), lambda: RowLinker(6)))
    assert "REPARTITION_BY_NUM" in plan(QUERIES["tk4_associate"](spark, DATA))


def test_a_stream_joins_written_poses(spark, monkeypatch):
    """No micro-batch derives the poses from the events again."""
    from kinefold.plans import q_tracking

    plans, run = [], q_tracking.sw.run_to_end
    monkeypatch.setattr(q_tracking.sw, "run_to_end", lambda stream, path: plans.append(stream._jdf.queryExecution().logical().toString()) or run(stream, path))
    QUERIES["st3_stream_moving_rig"](spark, DATA)
    assert len(plans) == 1 and "Aggregate" not in plans[0]


def test_neighbours_take_one_shuffle(spark):
    """The instances are grouped, and their points dealt to buckets of frames: no pair of points is shuffled."""
    for name in ("tr19_corrupt_swap_animal", "tr22_oracle_corrupt", "jn11_nearest_neighbour_row"):
        assert plan(QUERIES[name](spark, DATA)).count("Exchange hashpartitioning") <= 2, name


def test_neighbours_of_odd_points(spark):
    """Keys that are null, a point without y, a bare frame, and an animal's point that is there twice."""
    from kinefold.operators.joins import beside_nearest, nearest_neighbour_row

    rows = [("g", 0, 1, "p", 0.0, 0.0), ("g", 0, 1, "q", 1.0, 0.0), ("g", 0, 2, "p", 3.0, 4.0), ("g", 0, 2, "p", 3.0, 5.0), ("g", 0, 3, "p", 9.0, None), ("g", 0, None, "p", 0.0, 0.0), ("g", None, 1, "p", 0.0, 0.0), (None, 0, 1, "p", 0.0, 0.0), ("g", 1, 1, "p", None, None)]
    own = spark.createDataFrame(rows, "group_id string, frame int, animal int, bodypart string, x double, y double")
    found = {(r.animal, r.neighbour, None if r.dist is None else round(r.dist, 6)) for r in nearest_neighbour_row(own, 1).collect()}
    assert found == {(1, 3, None), (2, 3, None), (3, 1, None)}
    near = {(r.animal, r.neighbour, round(r.dist, 6)) for r in nearest_neighbour_row(own.where("animal < 3"), 2).collect()}
    assert near == {(1, 2, round((5 + 34**0.5) / 2, 6)), (2, 1, round((5 + 34**0.5) / 2, 6))}
    beside = [tuple(r) for r in beside_nearest(own.where("coalesce(animal, 0) < 3")).collect()]
    key = lambda r: tuple((v is not None, v) for v in r)
    want = [("g", 0, 1, "p", 0.0, 0.0, 2, 3.0, 4.0), ("g", 0, 1, "p", 0.0, 0.0, 2, 3.0, 5.0), ("g", 0, 1, "q", 1.0, 0.0, 2, None, None), ("g", 0, 2, "p", 3.0, 4.0, 1, 0.0, 0.0), ("g", 0, 2, "p", 3.0, 5.0, 1, 0.0, 0.0)]
    assert sorted(beside, key=key) == sorted(want + [(*r, None, None, None) for r in rows if None in r[:3] or r[1] == 1], key=key)


def test_tasks_keep_their_size(spark, tmp_path):
    """A larger table has more tasks, not larger ones; what was set finer stays."""
    from kinefold.sources.tables import bounded_tasks

    names = {"spark.sql.files.maxPartitionBytes": "64m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.shuffle.partitions": "4"}
    before = {n: spark.conf.get(n) for n in names}
    large = tmp_path / "large"
    with large.open("wb") as f:
        f.truncate(1 << 30)
    try:
        for n, value in names.items():
            spark.conf.set(n, value)
        QUERIES["tr14_known_boxes"](spark, DATA)
        assert [spark.conf.get(n) for n in names] == [f"{16 << 20}b", "1m", "4"]
        bounded_tasks(spark, str(large))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "256"
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_corners_are_not_multiplied(spark):
    """Distinct xs and ys of a region are counted in one pass; both zeros are one."""
    from kinefold.sources.readers import rois_to_regions

    assert "Expand" not in plan(QUERIES["src14_label_boxes_to_regions"](spark, DATA))
    corners = [("g", 0, 1, x, y) for x, y in ((0.0, 1.0), (-0.0, 5.0), (7.0, 5.0), (7.0, 1.0))]
    upright, turned = rois_to_regions(spark.createDataFrame(corners, "group_id string, frame int, roi int, x double, y double"), 10.0, 10.0)
    assert (upright.count(), turned.count()) == (1, 0)


def test_units_are_cut_once(spark):
    """The rows are not derived a second time to look for the long units."""
    from kinefold.operators.metrics import chunk_units

    rows = spark.createDataFrame([("g", 0), ("g", 1), ("g", 4), ("g", 4), ("h", None), ("h", 7)], "group_id string, frame int")
    cut = chunk_units(rows, 4)
    assert "LeftSemi" not in plan(cut)
    assert sorted(tuple(r) for r in cut.select("unit", "frame").collect()) == [("g#0", 0), ("g#0", 1)]


def test_movies_corners_are_not_multiplied(spark):
    """The regions of label movies share the step of src14."""
    assert "Expand" not in plan(QUERIES["src19_label_movies"](spark, DATA))


def test_tr11_asks_for_small_tasks(spark):
    """Its shuffles are not put together to 64 MB of compressed rows."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        QUERIES["tr11_crop_negatives"](spark, DATA)
        assert spark.conf.get(name) == f"{8 << 20}b"
    finally:
        spark.conf.set(name, before)


def test_jn7_asks_for_small_tasks(spark):
    """Its shuffles are not put together to 64 MB of compressed rows."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        QUERIES["jn7_assign_points_to_boxes"](spark, DATA)
        assert spark.conf.get(name) == f"{8 << 20}b"
    finally:
        spark.conf.set(name, before)


def test_session_files_are_strung_together(spark, tmp_path):
    """A session's rows are sorted by many tasks, and its file has no row group for every Arrow batch."""
    import pyarrow.parquet as pq

    from kinefold.sources.readers import read_table
    from kinefold.sources.writers import write_session_files

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    own = spark.range(6000).selectExpr("'r' AS root", "'t' AS split", "if(id < 5000, '001', 's =%2') AS session_id", "concat('g', id % 2) AS group_id", "CAST(5999 - id AS INT) AS frame", "'c0' AS camera", "CAST(id AS FLOAT) AS x0", "CAST(NULL AS STRING) AS status")
    try:
        spark.conf.set(name, "100")
        assert write_session_files(own, str(tmp_path), "regions") == 2
        assert write_session_files(own.where("false"), str(tmp_path / "none"), "regions") == 0
    finally:
        spark.conf.set(name, before)
    file = pq.ParquetFile(tmp_path / "r" / "t" / "001" / "regions.pq")
    keys = list(zip(*(file.read().column(c).to_pylist() for c in ("group_id", "frame")), strict=True))
    assert file.num_row_groups <= 4 and len(keys) == 5000 and keys == sorted(keys)
    assert file.schema_arrow.names == ["group_id", "frame", "camera", "x0", "status"]
    assert read_table(spark, str(tmp_path), "regions").where("session_id = '001' and status is null").count() == 5000


def test_views_are_dealt_and_bring_no_lens(spark):
    """The ring's views are made by as many tasks as a shuffle has, and a rig of few cameras is not written with every view."""
    from kinefold.operators import multiview as mv
    from kinefold.plans.q_tracking import POINT, _ring

    seen, table = _ring(spark, DATA)
    assert seen.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = seen.limit(60)
    few = mv.triangulate(own, table, POINT)
    assert "lens" not in plan(few)
    one = lambda df: sorted(tuple(r[c] for c in (*POINT, "x", "y", "z", "n_views")) for r in df.collect())
    assert one(mv.triangulate(seen.where("frame < 3"), table, POINT)) == one(mv.triangulate(mv.with_lenses(seen.where("frame < 3"), table), None, POINT))


def test_pairs_are_dealt_once(spark):
    """The join of a frame's points, the sums of its pairs and the solver share one shuffle of either side; the session's setting is put back."""
    from kinefold.operators import joins, matching
    from kinefold.plans.fixtures import fixture

    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before, sides = spark.conf.get(name), [fixture(spark, DATA, x) for x in ("pred", "truth")]
    try:
        spark.conf.set(name, "false")
        shuffles = plan(matching.hungarian_match(joins.frame_pairs(*sides, 4, bucketed=True))).count("Exchange hashpartitioning")
        few = plan(sides[0]).count("Exchange hashpartitioning") + plan(sides[1]).count("Exchange hashpartitioning")
        assert shuffles == few + 2
    finally:
        spark.conf.set(name, before)
    QUERIES["tk3_hungarian_match"](spark, DATA)
    assert spark.conf.get(name) == before
    assert "bucket" not in QUERIES["jn3_frame_pairs"](spark, DATA).columns


def test_a_block_is_filled_after_its_shuffle(spark):
    """Rows of absent animals are made where a block's rows have met: tracks and blocks are all that is shuffled, and nothing is joined."""
    own = plan(QUERIES["src12_read_sequence_json"](spark, DATA))
    assert own.count("Exchange hashpartitioning") == 2 and "Join" not in own


def test_follow_shuffles_the_events_alone(spark):
    """Tracks, means and windows share one shuffle; frames without a row are added after it."""
    from kinefold.operators.frames import follow

    own = plan(QUERIES["wn12_follow"](spark, DATA))
    assert own.count("Exchange hashpartitioning") == 1 and "Join" not in own
    # A clip that begins without a position, and has rows in three of its forty frames: halfway between them lies the middle.
    rows = [("a", 0, None, None), ("a", 10, 100.0, 80.0), ("a", 30, 140.0, 120.0), ("a", 39, None, None), ("b", 5, None, None)]
    found = {(r.group_id, r.frame): (r.x0, r.y0) for r in follow(spark.createDataFrame(rows, "group_id string, frame int, x double, y double"), 48, 256, 192).collect()}
    assert set(found) == {("a", f) for f in range(40)} | {("b", 5)}
    assert found["a", 0] == (76, 56) and found["a", 20] == (96, 76) and found["a", 39] == (116, 96) and found["b", 5] == (104, 72)


def test_the_sides_of_mota_share_a_shuffle(spark):
    """Predictions and labels, asked for three times, are dealt by clip and bucket in the same words; only the boxes, the labels without a frame and the matches come beside them."""
    from kinefold.operators import metrics
    from kinefold.plans.fixtures import bucketed
    from kinefold.plans.q_metrics import buckets_meet, matches

    name, tuned = "spark.sql.requireAllClusterKeysForCoPartition", {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "1k"}
    before, old = spark.conf.get(name), {k: spark.conf.get(k) for k in tuned}
    try:
        for k, v in tuned.items():
            spark.conf.set(k, v)
        with buckets_meet(spark):
            pred, true, insts = (bucketed(spark, DATA, x) for x in ("pred", "truth", "insts"))
            solved = plan(matches(pred, true))
            assert solved.count("- Exchange hashpartitioning(concat(g") == 1 and solved.count("ReusedExchange") >= 1 and "hashpartitioning(group_id" not in solved
            told = plan(metrics.mota(matches(pred, true), pred, true, insts.where("status = 'present'"), 40.0, "group_id"))
        assert told.count("- Exchange hashpartitioning(concat(g") == 3 and told.count("ReusedExchange") >= 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert spark.conf.get(name) == before


def test_bucketed_views_are_the_views(spark):
    from kinefold.plans.fixtures import bucketed, fixture

    for x in ("pred", "truth", "insts"):
        own = bucketed(spark, DATA, x)
        assert own.where("bucket <> floor(frame / 512)").count() == 0
        own, want = own.drop("bucket"), fixture(spark, DATA, x)
        assert own.columns == want.columns and own.exceptAll(want).count() == 0 and want.exceptAll(own).count() == 0


def test_switches_between_buckets_and_labels_without_a_frame(spark):
    """A label's switch is found in its bucket, and from its last match in one bucket to its first in a later one; a label without a frame is missed."""
    from kinefold.operators import metrics

    found = spark.createDataFrame([("g", f, i, 0) for f, i in ((0, 1), (1, 2), (511, 2), (512, 2), (2000, 3), (2001, 3))], "group_id string, frame int, i int, j int")
    assert sorted(r.frame for r in metrics.switches(metrics._dealt(found, found)).collect()) == [1, 2000]
    true = spark.createDataFrame([("g", f, 0, "p", 1.0, 1.0) for f in (0, 1, 511, 512, 2000, 2001, None)], "group_id string, frame int, animal int, bodypart string, x double, y double")
    pred = spark.createDataFrame([("g", r.frame, r.i, "p", 1.0, 1.0) for r in found.collect()] + [("g", 5, 9, "p", 1.0, 1.0)], "group_id string, frame int, pred int, bodypart string, x double, y double")
    none = spark.createDataFrame([], "group_id string, frame int, x0 double, y0 double, x1 double, y1 double")
    got = metrics.mota(found, pred, true, none, 1.0, "group_id").collect()
    assert [(r.gt, r.misses, r.fp, r.fp_dup, r.fp_ignored, r.idsw) for r in got] == [(7, 1, 1, 0, 0, 2)]


def test_matched_points_are_not_dealt_again(spark):
    """Labels meet their matches and these the predictions by the bucket that all were dealt by."""
    from kinefold.operators import metrics
    from kinefold.plans.fixtures import bucketed, fixture
    from kinefold.plans.q_metrics import buckets_meet

    tuned = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "1k"}
    old = {k: spark.conf.get(k) for k in tuned}
    found = fixture(spark, DATA, "inst").select("group_id", "frame", F.lit(1).alias("i"), F.col("animal").alias("j"))
    try:
        for k, v in tuned.items():
            spark.conf.set(k, v)
        with buckets_meet(spark):
            pred, true = (bucketed(spark, DATA, x) for x in ("pred", "truth"))
            own = plan(metrics.matched_points(metrics._dealt(found, pred), pred, true))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert own.count("- Exchange hashpartitioning") - plan(found).count("Exchange hashpartitioning") == 3


def test_manifests_are_read_once_by_few_tasks(spark, tmp_path):
    """Files are written by several tasks, listed and read by as many as a shuffle has, and read once however often their rows are asked for; the session's setting is put back."""
    from kinefold.sources.readers import manifest_texts
    from kinefold.sources.writers import write_texts

    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    own = spark.range(80).coalesce(1).select(F.lit("r").alias("root"), F.lit("train").alias("split"), F.concat(F.lit("s"), "id").alias("session_id"), F.concat(F.lit("n = "), "id").alias("body"))
    tasks = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("texts", "texts")
    try:
        assert write_texts(own, str(tmp_path), "session.toml") == 80
        sizes = lambda: {s.numTasks for j in tasks.getJobIdsForGroup("texts") for i in tasks.getJobInfo(j).stageIds if (s := tasks.getStageInfo(i))}
        assert 4 * spark.sparkContext.defaultParallelism in sizes()
        found = manifest_texts(spark, str(tmp_path), "session.toml")
        assert max(sizes()) < 80
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found.rdd.getNumPartitions() <= max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert {(r.session_id, r.body) for r in found.collect()} == {(f"s{n}", f"n = {n}") for n in range(80)}
    assert spark.conf.get(name) == before
    assert "BinaryFile" not in plan(QUERIES["src18_combine_catalogs"](spark, DATA)) and "binaryFile" not in plan(QUERIES["src18_combine_catalogs"](spark, DATA))


def test_gained_is_the_best_assignment():
    """The same pairs as the whole matrix gives, with many rows and columns that gain nothing, and none without a gain."""
    import numpy as np

    from kinefold.operators.matching import assignment, gained

    draw = np.random.default_rng(5)
    for _ in range(300):
        shape = tuple(draw.integers(1, 9, 2))
        gain = np.where(draw.random(shape) < draw.choice([0.1, 0.3, 0.8]), draw.random(shape), 0.0)
        assert gained(gain) == [(i, j) for i, j in assignment(-gain) if gain[i, j] > 0]
    assert gained(np.zeros((2, 3))) == [] and gained(np.ones((1, 1))) == [(0, 0)]


def test_trackers_run_once(spark):
    """Rows of the solver or the tracker are written: the linker and the suppression read them."""
    assert plan(QUERIES["st3_associate_tracked"](spark, DATA)).count("MapInPandas") == 0
    linked = plan(QUERIES["st3_associate_linked"](spark, DATA))
    assert linked.count("MapInPandas") == 1 and "FlatMapGroupsInPandas" not in linked
