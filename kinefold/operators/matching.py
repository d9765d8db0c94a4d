"""Suppression and matching inside a frame. Conflicts and costs are joins; only the sequential choice is a fold over a frame's few rows."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinefold.functions.geometry import Box, box_iou, center_dist
from kinefold.operators.filters import BUCKET_FRAMES, FRAME

#: Columns up to which an assignment is solved on plain numbers.
SMALL = 32


def ranked(dets: DataFrame, keys: list[str]) -> DataFrame:
    """rank 1 is the best score; ties keep the detections' order."""
    return dets.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "det")))


def nms(dets: DataFrame, keys: list[str], *, iou: float = 0.5, min_dist: float | None = None, top_k: int | None = None) -> DataFrame:
    """Boxes that survive non-maximum suppression: those, best first, that no kept one overlaps too much (or comes too near)."""
    own = ranked(dets, keys)
    a = own.select(*keys, F.col("rank").alias("ra"), *(F.col(c).alias(f"a_{c}") for c in Box._fields))
    b = own.select(*keys, F.col("rank").alias("rb"), *(F.col(c).alias(f"b_{c}") for c in Box._fields))
    clash = box_iou(Box.named("a_"), Box.named("b_")) >= iou
    if min_dist is not None:
        clash = clash | (center_dist(Box.named("a_"), Box.named("b_")) < min_dist)
    # Only boxes with a better one in conflict need the fold; the others are kept at once.
    conflicts = a.join(b, keys).where((F.col("ra") < F.col("rb")) & clash).groupBy(*keys, F.col("rb").alias("rank")).agg(F.array_sort(F.collect_list("ra")).alias("worse_than"))
    framed = conflicts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "worse_than"))).alias("rows"))
    dropped = F.aggregate("rows", F.array().cast("array<int>"), lambda gone, row: F.when(F.size(F.array_except(row["worse_than"], gone)) > 0, F.array_append(gone, row["rank"])).otherwise(gone))
    lost = framed.select(*keys, F.explode(dropped).alias("rank"))
    kept = own.join(lost, [*keys, "rank"], "left_anti")
    if top_k is None:
        return kept
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).where(F.col("place") <= top_k).drop("place")


def greedy_match(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Each gt box with its IoU under greedy one-to-one matching, best pairs first (0 if none), and how many predictions of its frame stay unmatched.

    gt and pred have columns g or p beside the keys and the box.
    """
    a = gt.select(*keys, "g", *(F.col(c).alias(f"a_{c}") for c in Box._fields))
    b = pred.select(*keys, "p", *(F.col(c).alias(f"b_{c}") for c in Box._fields))
    pairs = a.join(b, keys).withColumn("iou", box_iou(Box.named("a_"), Box.named("b_"))).where("iou > 0")
    order = F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("n"), "g", "p")))
    fold = F.aggregate("rows", F.array().cast("array<struct<n:double,g:int,p:int>>"), lambda acc, row: F.when(F.exists(acc, lambda x: (x["g"] == row["g"]) | (x["p"] == row["p"])), acc).otherwise(F.array_append(acc, row)))
    matched = pairs.groupBy(*keys).agg(order.alias("rows")).select(*keys, F.explode(fold).alias("m")).select(*keys, "m.g", (-F.col("m.n")).alias("iou"), F.lit(1).alias("hit"))
    n_pred = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pred"))
    n_hit = matched.groupBy(*keys).agg(F.sum("hit").alias("n_hit"))
    out = gt.select(*keys, "g").join(matched, [*keys, "g"], "left").join(n_pred, keys, "left").join(n_hit, keys, "left")
    return out.select(*keys, "g", F.coalesce("iou", F.lit(0.0)).alias("iou"), (F.coalesce("n_pred", F.lit(0)) - F.coalesce("n_hit", F.lit(0))).alias("unmatched_pred"))


def _small_assignment(cost: list[list[float]], m: int) -> list[tuple[int, int]]:
    """assignment of a few finite rows, with the same sums in the same order: a call of numpy would cost more than its numbers."""
    inf = float("inf")
    row_price, column_price, owner = [0.0] * len(cost), [0.0] * m, [-1] * m
    for row in range(len(cost)):
        best, via, left, done = [inf] * m, [-1] * m, list(range(m)), []
        at, current = -1, row
        while True:
            own, price, step, to = cost[current], row_price[current], inf, -1
            for j in left:
                reduced = own[j] - price - column_price[j]
                if reduced < best[j]:
                    best[j], via[j] = reduced, at
                if best[j] < step:
                    step, to = best[j], j
            at = to
            row_price[row] += step
            for j in done:
                row_price[owner[j]] += step
                column_price[j] -= step
            for j in left:
                best[j] -= step
            left.remove(at)
            done.append(at)
            if owner[at] < 0:
                break
            current = owner[at]
        while at >= 0:
            owner[at] = owner[via[at]] if via[at] >= 0 else row
            at = via[at]
    return sorted((r, c) for c, r in enumerate(owner) if r >= 0)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of a least-cost assignment of all of the shorter side: shortest augmenting paths with potentials."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assignment(cost.T))
    n, m = cost.shape
    if m <= SMALL and np.isfinite(cost).all():
        return _small_assignment(cost.tolist(), m)
    row_price, column_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        best, via, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, current = -1, row
        while True:
            reduced = cost[current] - row_price[current] - column_price
            closer = ~seen & (reduced < best)
            best[closer], via[closer] = reduced[closer], at
            at = int(np.where(seen, np.inf, best).argmin())
            step = best[at]
            row_price[row] += step
            row_price[owner[seen]] += step
            column_price[seen] -= step
            best[~seen] -= step
            seen[at] = True
            if owner[at] < 0:
                break
            current = owner[at]
        while at >= 0:
            owner[at] = owner[via[at]] if via[at] >= 0 else row
            at = via[at]
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0)


def gained(gain: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of an assignment of greatest gain (none is below 0), without pairs that gain nothing.

    Where every row that gains anything has one best column, and no two have the same, there is no other; else rows and columns that gain nothing
    are left out before it is solved.
    """
    rows = np.flatnonzero(gain.any(axis=1))
    own = gain[rows]
    if not len(rows):
        return []
    best, top = own.argmax(axis=1), own.max(axis=1)
    if len(np.unique(best)) == len(rows) == np.count_nonzero(own == top[:, None]):
        return list(zip(rows.tolist(), best.tolist(), strict=True))
    columns = np.flatnonzero(own.any(axis=0))
    own = own[:, columns]
    return [(int(rows[i]), int(columns[j])) for i, j in assignment(-own) if own[i, j] > 0]


def _choices(n: int, m: int) -> np.ndarray:
    """All ways to give n rows different ones of m columns, in lexical order."""
    return np.array(list(permutations(range(m), n)), np.int64).reshape(-1, n)


def solve_stack(cost: np.ndarray) -> np.ndarray:
    """Of a stack of matrices (k, n, m), n <= m, the column of each row in an assignment of least cost: all choices are summed up at once where they are few, and larger matrices are solved one by one."""
    k, n, m = cost.shape
    if n <= 4 and m <= 6:
        choices = _choices(n, m)
        totals = sum(cost[:, r][:, choices[:, r]] for r in range(n))
        return choices[totals.argmin(axis=1)]
    out = np.empty((k, n), np.int64)
    for i, own in enumerate(cost):
        out[i] = [c for _, c in assignment(own)]
    return out


def solve_frames(frame: np.ndarray, i: np.ndarray, j: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which of the pairs (frame, i, j, cost), sorted by frame, are matched: pairs that are not there are dearer than any of their frame, and never matched."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(frame)) + 1, [len(frame)]])
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))

    def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each value's place among its frame's distinct ones, and how many those are."""
        order = np.lexsort((x, owner))
        new = np.ones(len(x), bool)
        new[1:] = (x[order][1:] != x[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        rank = np.cumsum(new) - 1
        first = rank[np.searchsorted(owner[order], np.arange(len(edges) - 1))]
        out = np.empty(len(x), np.int64)
        out[order] = rank - first[owner[order]]
        return out, np.diff(np.concatenate([first, [rank[-1] + 1]]))

    ri, n = places(i)
    cj, m = places(j)
    turned = n > m
    ri, cj, n, m = np.where(turned[owner], cj, ri), np.where(turned[owner], ri, cj), np.minimum(n, m), np.maximum(n, m)
    dearest = np.maximum.reduceat(cost, edges[:-1]) + 1
    chosen = np.zeros(len(frame), bool)
    for rows, columns in np.unique(np.stack([n, m], axis=1), axis=0).tolist():
        frames = np.flatnonzero((n == rows) & (m == columns))
        number = np.full(len(n), -1)
        number[frames] = np.arange(len(frames))
        own = np.flatnonzero(number[owner] >= 0)
        full = np.repeat(dearest[frames], rows * columns).reshape(len(frames), rows, columns)
        at = number[owner[own]]
        full[at, ri[own], cj[own]] = cost[own]
        chosen[own] = solve_stack(full)[at, ri[own]] == cj[own]
    return chosen


def hungarian_match(pairs: DataFrame, max_dist: float | None = None) -> DataFrame:
    """One-to-one matches (group_id, frame, i, j, cost) of least total cost in each frame, then those within max_dist.

    A frame's pairs meet by one shuffle on (group_id, bucket of frames), or by none where the pairs bring the bucket that they were dealt by; the solver takes all of a bucket's frames of one shape at once.
    """

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by([("frame", "ascending"), ("i", "ascending"), ("j", "ascending")])
        return table.filter(pa.array(solve_frames(*(table[c].to_numpy() for c in ("frame", "i", "j", "cost"))))).select(["group_id", "frame", "i", "j", "cost"])

    own = pairs.where("cost is not null and not isnan(cost)").select(*FRAME, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("cost").cast("double").alias("cost"), (F.col("bucket") if "bucket" in pairs.columns else F.floor(F.col("frame") / BUCKET_FRAMES).alias("bucket")))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    solved = own.groupBy("group_id", "bucket").applyInArrow(solve, f"group_id {kinds['group_id']}, frame {kinds['frame']}, i int, j int, cost double")
    return solved if max_dist is None else solved.where(F.col("cost") <= max_dist)


def rank_detections(dets: DataFrame, k: int) -> DataFrame:
    """The d-th best detection of each view, as row d."""
    return ranked(dets, [*FRAME, "camera"]).where(F.col("rank") <= k)


def pose_overlap(rows: DataFrame, points: DataFrame) -> DataFrame:
    """For each pair a < b of a frame's rows the smaller of the shares of either's points inside the other's box, averaged over the cameras that both have.

    rows: (group, frame, row, camera, box, score); points: (group, frame, row, camera, x, y).
    """
    view = [*FRAME, "camera"]
    inside = F.when(F.col("x").isNotNull(), (F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).cast("double"))
    boxes = rows.where("x0 is not null").select(*view, F.col("row").alias("other"), *Box._fields)
    own = rows.where("x0 is not null").select(*view, "row")
    shares = points.join(own, [*view, "row"], "left_semi").join(boxes, view).where("row <> other").groupBy(*view, "row", "other").agg(F.avg(inside).alias("share"))
    mean = shares.groupBy(*FRAME, "row", "other").agg(F.avg("share").alias("share"))
    back = mean.select(*FRAME, F.col("other").alias("row"), F.col("row").alias("other"), F.col("share").alias("back"))
    return mean.join(back, [*FRAME, "row", "other"]).where("row < other").select(*FRAME, F.col("row").alias("a"), F.col("other").alias("b"), F.least("share", "back").alias("overlap"))


def pose_nms(rows: DataFrame, points: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Rows (group, frame, row) that are duplicates: of a pair that overlaps too much the lower score goes, with equal scores the higher row.

    Pairs are taken in order, as the rule is defined; a row that is gone still meets the ones after it in its own turn only.
    """
    scores = rows.groupBy(*FRAME, "row").agg(F.max("score").alias("score"))
    pairs = pose_overlap(rows, points).where(F.col("overlap") > threshold)
    sided = pairs.join(scores.select(*FRAME, F.col("row").alias("a"), F.col("score").alias("sa")), [*FRAME, "a"]).join(scores.select(*FRAME, F.col("row").alias("b"), F.col("score").alias("sb")), [*FRAME, "b"])
    ordered = sided.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("a", "b", (F.col("sb") <= F.col("sa")).alias("b_goes")))).alias("rows"))
    gone = lambda acc, x: F.array_contains(acc, x)
    fold = F.aggregate("rows", F.array().cast("array<int>"), lambda acc, p: F.when(gone(acc, p["a"]) | gone(acc, p["b"]), acc).otherwise(F.array_append(acc, F.when(p["b_goes"], p["b"]).otherwise(p["a"]))))
    return ordered.select(*FRAME, F.explode(fold).alias("row"))


def support_count(candidates: DataFrame, views: DataFrame, gate: float) -> DataFrame:
    """For each candidate point (group, frame, cand, camera, u, v a row for each camera) the cameras that have a detection centre within the gate of its projection."""
    near = candidates.join(views, [*FRAME, "camera"]).where(F.hypot(F.col("u") - F.col("cx"), F.col("v") - F.col("cy")) <= gate)
    return near.groupBy(*FRAME, "cand").agg(F.countDistinct("camera").alias("support"))


def lower_median(column: Column) -> Column:
    """The lower of the two middle values."""
    return F.percentile_approx(column, 0.5, 1_000_000)
