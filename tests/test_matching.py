import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinefold.operators import joins, matching, metrics


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.integers(0, 10**6))
def test_assignment_is_least(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    got = matching.assignment(cost)
    assert len({r for r, _ in got}) == len({c for _, c in got}) == min(n, m)
    short, long_ = (range(n), range(m)) if n <= m else (range(m), range(n))
    best = min(sum(cost[r, c] if n <= m else cost[c, r] for r, c in zip(short, p, strict=True)) for p in itertools.permutations(long_, min(n, m)))
    assert sum(cost[r, c] for r, c in got) == best


def points(spark, rows, who):
    return spark.createDataFrame(rows, f"group_id string, frame int, {who} int, bodypart string, x double, y double")


def test_hungarian_gates_after_solving(spark):
    true = points(spark, [("g", 0, 0, "a", 0.0, 0.0), ("g", 0, 1, "a", 10.0, 0.0)], "animal")
    pred = points(spark, [("g", 0, 0, "a", 9.0, 0.0), ("g", 0, 1, "a", 100.0, 0.0)], "pred")
    pairs = joins.frame_pairs(pred, true, 1)
    # The cheapest pair, (0, 1), is not in the cheapest assignment, and the gate comes after it.
    assert {(r.i, r.j) for r in matching.hungarian_match(pairs).collect()} == {(0, 0), (1, 1)}
    assert matching.hungarian_match(pairs, 5.0).count() == 0


def test_penalised_cost_prefers_the_dense_row(spark):
    true = points(spark, [("g", 0, 0, b, 0.0, 0.0) for b in "abcd"], "animal")
    pred = points(spark, [("g", 0, 0, "a", 0.5, 0.0)] + [("g", 0, 1, b, 1.0, 0.0) for b in "abcd"], "pred")
    best = lambda cost: min(joins.frame_pairs(pred, true, 4, max_dist=10.0, cost=cost).collect(), key=lambda r: r.cost).i
    assert (best("mean"), best("penalised")) == (0, 1)


@pytest.mark.parametrize(("boxes", "want"), [([(0.0, 0.0, 2.0, 2.0)], (1, 1)), ([(-100.0, -100.0, 500.0, 500.0)], (0, 2)), ([], (2, 0))])
def test_mota_ignore_boxes(spark, boxes, want):
    """False positives inside an ignore box are excused."""
    true = points(spark, [("g", 0, 0, "a", 50.0, 50.0)], "animal")
    pred = points(spark, [("g", 0, 0, "a", 1.0, 1.0), ("g", 0, 1, "a", 200.0, 200.0)], "pred")
    ignore = spark.createDataFrame([("g", 0, *b) for b in boxes], "group_id string, frame int, x0 double, y0 double, x1 double, y1 double")
    found = matching.hungarian_match(joins.frame_pairs(pred, true, 1), 5.0)
    r = metrics.mota(found, pred, true, ignore, 5.0, "group_id").first()
    assert (r.fp, r.fp_ignored) == want


def test_duplicates_of_a_claimed_label(spark):
    true = points(spark, [("g", 0, 0, "a", 0.0, 0.0)], "animal")
    pred = points(spark, [("g", 0, 0, "a", 0.0, 0.0), ("g", 0, 1, "a", 1.0, 0.0), ("g", 0, 2, "a", 90.0, 0.0)], "pred")
    none = spark.createDataFrame([], "group_id string, frame int, x0 double, y0 double, x1 double, y1 double")
    found = matching.hungarian_match(joins.frame_pairs(pred, true, 1), 5.0)
    r = metrics.mota(found, pred, true, none, 5.0, "group_id").first()
    assert (r.fp, r.fp_dup, r.fp_none, r.misses, r.gt) == (2, 1, 1, 0, 1)
    r = metrics.mota(found, pred, true, none, 0.5, "group_id").first()
    assert (r.fp, r.fp_dup) == (2, 0)


def test_tail_percentiles(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0)] * 49 + [(1000.0, 0.0, 0.0, 0.0)], "px double, py double, x double, y double")
    r = metrics.error_and_coverage(rows.withColumn("k", F.lit(1)), "k").first()
    assert (r.err, r.p75, r.p90, r.coverage) == (20.0, 0.0, 0.0, 1.0)


def test_motion_ratio_skips_gaps(spark):
    rows = [("g", 0, "a", f, float(f), 0.0, 2.0 * f, 0.0) for f in (0, 1, 2, 5, 6)]
    df = spark.createDataFrame(rows, "group_id string, animal int, bodypart string, frame int, px double, py double, x double, y double")
    r = metrics.motion_ratio(df, "group_id").first()
    assert (r.n_steps, r.pred_path, r.ratio) == (3, 3.0, 0.5)


def test_nms_keeps_what_only_a_dropped_box_overlaps(spark):
    boxes = [(0, 0.9, 0.0), (1, 0.8, 4.0), (2, 0.7, 8.0)]
    dets = spark.createDataFrame([("g", 0, d, s, x, 0.0, x + 10, 10.0) for d, s, x in boxes], "group_id string, frame int, det int, score double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.det for r in matching.nms(dets, ["group_id", "frame"], iou=0.4).collect()) == [0, 2]


def test_greedy_match_spends_each_side_once(spark):
    gt = spark.createDataFrame([("g", 0, 0, 0.0, 0.0, 10.0, 10.0), ("g", 0, 1, 5.0, 0.0, 15.0, 10.0)], "group_id string, frame int, g int, x0 double, y0 double, x1 double, y1 double")
    pred = spark.createDataFrame([("g", 0, 0, 4.0, 0.0, 14.0, 10.0)], "group_id string, frame int, p int, x0 double, y0 double, x1 double, y1 double")
    out = {r.g: (round(r.iou, 3), r.unmatched_pred) for r in matching.greedy_match(gt, pred, ["group_id", "frame"]).collect()}
    assert out == {0: (0.0, 0), 1: (0.818, 0)}
