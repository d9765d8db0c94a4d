"""Operators with a solver, a tracker or draws: their values against plain loops over the rows."""

import itertools
import math
from collections import defaultdict

import numpy as np
import pytest

from kinefold.functions.random import MODULUS
from kinefold.operators import frames as w
from kinefold.operators import joins as j
from kinefold.operators import matching as k
from kinefold.operators import multiview as mv
from kinefold.operators import sampling as t
from kinefold.plans.fixtures import fixture
from kinefold.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
PART = {b: len(b) * 7 + ord(b[0]) for b in ("nose", "ear_l", "ear_r", "tail")}


def draw(seed, *keys):
    """The congruential generator of functions.random."""
    state = seed + 1
    for key in (*keys, 7, 11):
        state = (state * 48271 + 1 + (math.fmod(key, 1000003) + 1000003)) % MODULUS
    return state / MODULUS


@pytest.fixture(scope="module")
def truth(spark):
    return [r.asDict() for r in fixture(spark, DATA, "truth").collect()]


@pytest.fixture(scope="module")
def points(truth):
    return {(r["group_id"], r["frame"], r["animal"], r["bodypart"]): (r["x"], r["y"]) for r in truth}


def rows(df, *keys):
    return {tuple(r[c] for c in keys): r for r in df.collect()}


POINT = ("group_id", "frame", "animal", "bodypart")


def test_many_shapes_of_assignment():
    """Whole stacks at once give the same cost as every permutation of each frame."""
    rng = np.random.default_rng(3)
    frame, i, jj, cost = [], [], [], []
    for f in range(120):
        n, mm = rng.integers(1, 7, 2)
        for a, b in itertools.product(range(n), range(mm)):
            if rng.random() < 0.8:
                frame.append(f)
                i.append(a * 3)
                jj.append(b * 2)
                cost.append(float(rng.integers(0, 50)))
    frame, i, jj, cost = map(np.array, (frame, i, jj, cost))
    chosen = k.solve_frames(frame, i, jj, cost)
    for f in np.unique(frame):
        own = frame == f
        table = {(a, b): c for a, b, c in zip(i[own], jj[own], cost[own], strict=True)}
        ra, rb = sorted({a for a, _ in table}), sorted({b for _, b in table})
        if len(ra) > len(rb):
            ra, rb, table = rb, ra, {(b, a): c for (a, b), c in table.items()}
        dear = max(table.values()) + 1
        best = min(sum(table.get((a, b), dear) for a, b in zip(ra, p, strict=True)) for p in itertools.permutations(rb, len(ra)))
        got = [(a, b) for a, b in zip(i[own & chosen], jj[own & chosen], strict=True)]
        assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})
        paid = sum(cost[own & chosen]) + dear * (len(ra) - len(got))
        assert paid == pytest.approx(best)


def brute_matches(spark):
    """Least-cost matches of every frame by permutations, from the pairs' costs."""
    frames = defaultdict(dict)
    for r in j.frame_pairs(fixture(spark, DATA, "pred"), fixture(spark, DATA, "truth"), 4).collect():
        if r.cost is not None:
            frames[r.group_id, r.frame][r.i, r.j] = r.cost
    total = {}
    for key, table in frames.items():
        ra, rb = sorted({a for a, _ in table}), sorted({b for _, b in table})
        turned = len(ra) > len(rb)
        if turned:
            ra, rb, table = rb, ra, {(b, a): c for (a, b), c in table.items()}
        dear = max(table.values()) + 1
        total[key] = min(sum(table.get((a, b), dear) for a, b in zip(ra, p, strict=True)) for p in itertools.permutations(rb, len(ra)))
    return frames, total


def test_tk3_ag6_ag7_ag16(spark, truth, points):
    frames, total = brute_matches(spark)
    # The metrics follow from the matches within the gate.
    pairs = k.hungarian_match(j.frame_pairs(fixture(spark, DATA, "pred"), fixture(spark, DATA, "truth"), 4), 40.0).collect()
    every = defaultdict(list)
    for r in k.hungarian_match(j.frame_pairs(fixture(spark, DATA, "pred"), fixture(spark, DATA, "truth"), 4)).collect():
        every[r.group_id, r.frame].append((r.i, r.j, r.cost))
    for key, table in frames.items():
        paid = sum(c for *_, c in every[key])
        side = min(len({a for a, _ in table}), len({b for _, b in table}))
        assert paid + (max(table.values()) + 1) * (side - len(every[key])) == pytest.approx(total[key])
    of = {(r.group_id, r.frame, r.j): r.i for r in pairs}
    pred = {(r.group_id, r.frame, r.pred, r.bodypart): (r.x, r.y) for r in fixture(spark, DATA, "pred").collect()}
    errors, seen = defaultdict(list), defaultdict(set)
    for (g, f, a, b), (x, y) in points.items():
        if x is not None:
            seen[g].add((f, a))
            p = pred.get((g, f, of.get((g, f, a)), b))
            if p and p[0] is not None:
                errors[g].append(math.hypot(p[0] - x, p[1] - y))
    matched = defaultdict(int)
    for r in pairs:
        matched[r.group_id] += 1
    for r in QUERIES["ag7_matched_error"](spark, DATA).collect():
        own = np.array(errors[r.group_id])
        assert (r.n_true_inst, r.n_matched_inst, r.unmatched_true) == (len(seen[r.group_id]), matched[r.group_id], len(seen[r.group_id]) - matched[r.group_id])
        assert r.n_matched == len(own) and r.err == pytest.approx(own.mean(), abs=1e-5) and r.median == pytest.approx(np.median(own), abs=1e-5) and r.p95 == pytest.approx(np.quantile(own, 0.95), abs=1e-5)
    last: dict = {}
    switches = defaultdict(int)
    for r in sorted(pairs, key=lambda r: r.frame):
        before = last.get((r.group_id, r.j))
        switches[r.group_id] += before is not None and before != r.i
        last[r.group_id, r.j] = r.i
    there = defaultdict(set)
    for (g, f, i, _), (x, _) in pred.items():
        if x is not None:
            there[g].add((f, i))
    for r in QUERIES["ag6_mota"](spark, DATA).collect():
        g = r.group_id
        assert (r.gt, r.misses, r.idsw) == (len(seen[g]), len(seen[g]) - matched[g], switches[g])
        assert r.fp + r.fp_ignored == len(there[g]) - matched[g] and 0 <= r.fp_dup <= r.fp and r.fp_none == r.fp - r.fp_dup
        assert r.mota == pytest.approx(1 - (r.misses + r.fp + r.idsw) / r.gt, abs=1e-5)
    for r in QUERIES["ag16_box_mota"](spark, DATA).collect():
        assert r.mota == pytest.approx(1 - (r.misses + r.fp + r.idsw) / r.gt, abs=1e-5) and 0 <= r.misses <= r.gt


def test_tr4_weighted_draw(spark):
    """Every draw once, and entries as often as they weigh."""
    index = spark.createDataFrame([(f"g{n}", n, float(n % 5)) for n in range(300)], "group_id string, animal int, w double")
    got = t.weighted_draw(index, 6000, 3, ["group_id", "animal"], shard_rows=16).collect()
    assert sorted(r.draw for r in got) == list(range(6000))
    often = defaultdict(int)
    for r in got:
        often[r.animal % 5] += 1
    assert often[0] == 0
    for n in range(1, 5):
        assert often[n] / 6000 == pytest.approx(n / 10, abs=0.03)
    n = fixture(spark, DATA, "inst").count()
    assert sorted(r.draw for r in QUERIES["tr4_weighted_draw"](spark, DATA).collect()) == list(range(n))


def test_tr18_stale(spark, truth):
    found = rows(QUERIES["tr18_corrupt_stale"](spark, DATA), *POINT)
    assert len(found) == len(truth)
    delays = set()
    stale = [rows(w.stale_prior(fixture(spark, DATA, "truth"), n, "group_id", "animal", "bodypart"), *POINT) for n in (1, 2, 3)]
    for r in truth:
        key = tuple(r[c] for c in POINT)
        got = found[key]
        d = math.floor(draw(34, int(r["group_id"][1:]), r["frame"], r["animal"]) * 4)
        want = (r["x"], r["y"]) if d == 0 else (stale[d - 1][key].stale_x, stale[d - 1][key].stale_y)
        assert got.delay == d and (got.stale_x, got.stale_y) == want
        delays.add(d)
    assert delays == {0, 1, 2, 3}


def neighbours(spark):
    own = fixture(spark, DATA, "truth").select(*j.POINT, "x", "y")
    return {(r.group_id, r.frame, r.animal): r.neighbour for r in j.nearest_neighbour_row(own).collect()}


def test_tr19_and_tr22_take_the_neighbours_points(spark, points):
    near = neighbours(spark)
    swapped = rows(QUERIES["tr19_corrupt_swap_animal"](spark, DATA), *POINT)
    pulled = rows(QUERIES["tr22_oracle_corrupt"](spark, DATA), *POINT)
    assert set(swapped) == set(points) == set(pulled)
    n = 0
    for (g, f, a, b), (x, y) in points.items():
        nx, ny = points.get((g, f, near.get((g, f, a)), b), (None, None))
        take = nx is not None and draw(35, int(g[1:]), f, a, PART[b]) < 0.2
        n += take
        assert (swapped[g, f, a, b].x, swapped[g, f, a, b].y, swapped[g, f, a, b].swapped) == ((nx, ny, True) if take else (x, y, False))
        want = x if x is None or nx is None else x + (nx - x) * 0.25
        assert pulled[g, f, a, b].x == (None if want is None else pytest.approx(want, abs=1e-5))
    assert n


def test_tr20_swaps_inside_an_animal(spark, points):
    found = rows(QUERIES["tr20_corrupt_swap_keypoints"](spark, DATA), *POINT)
    there = {key: p for key, p in points.items() if p[0] is not None}
    assert set(found) == set(there)
    animals = defaultdict(list)
    for g, f, a, b in sorted(there):
        animals[g, f, a].append(b)
    some = 0
    for (g, f, a), parts in animals.items():
        for r, b in enumerate(parts):
            size = len(parts)
            to = r
            if size > 1 and draw(36, int(g[1:]), f, a, PART[b]) < 0.3:
                to = (r + math.floor(draw(37, int(g[1:]), f, a, PART[b]) * (size - 1)) + 1) % size
                some += 1
                assert to != r
            got = found[g, f, a, b]
            assert (got.x, got.y) == there[g, f, a, parts[to]] and got.swapped == (to != r)
    assert some


def test_tr21_noise(spark, points):
    def normal(seed, *keys):
        return math.sqrt(-2 * math.log(max(draw(seed, *keys), 1e-12))) * math.cos(2 * math.pi * draw(seed + 1, *keys))

    found = rows(QUERIES["tr21_corrupt_noise"](spark, DATA), *POINT)
    for (g, f, a, b), (x, y) in points.items():
        own = (int(g[1:]), f, a)
        for n, (name, v) in enumerate((("x", x), ("y", y))):
            want = None if v is None else v + 4 * normal(37 + 10 * n, *own) + normal(38 + 10 * n, *own, PART[b])
            assert found[g, f, a, b][name] == (None if want is None else pytest.approx(want, abs=1e-5))


def test_tr11_and_tr12_stay_inside(spark):
    regions = {(r.group_id, r.frame, r.camera): r for r in fixture(spark, DATA, "regions").collect()}
    boxes = defaultdict(list)
    for r in fixture(spark, DATA, "det").collect():
        boxes[r.group_id, r.frame, r.camera].append(r)
    found = rows(QUERIES["tr11_crop_negatives"](spark, DATA), "group_id", "frame", "camera")
    assert found and set(found) <= set(regions)
    for key, c in found.items():
        r = regions[key]
        assert r.x0 <= c.x0 and c.x0 + 24 <= r.x1 and r.y0 <= c.y0 and c.y0 + 24 <= r.y1 and 1 <= c["try"] <= 12
        for b in boxes[key]:
            assert min(c.x0 + 24, b.x1) <= max(c.x0, b.x0) or min(c.y0 + 24, b.y1) <= max(c.y0, b.y0)
    certified, has_animal, kinds, seen = {k for k in regions if k[0] < "g6"}, {k for k in boxes if k[1] % 7 != 1}, defaultdict(int), set()
    for r in QUERIES["tr12_tile_origins"](spark, DATA).collect():
        key = (r.group_id, r.frame, r.camera)
        kinds[r.kind] += 1
        seen.add(key)
        assert -16 <= r.x0 <= 208 and -16 <= r.y0 <= 144
        if r.kind == "background" and key[0] < "g6":
            # Its centre, before the move of up to a quarter tile and the cut at the border, lies in a region of the view.
            own = [(b.x0, b.y0, b.x1, b.y1) for b in [regions[key]]]
            own += [(x0 + 100, y0 + 50, x1 + 60, y1 + 20) for x0, y0, x1, y1 in own if key[1] % 5 == 0]
            near = [all(lo - 17 <= c <= hi + 17 or edge for c, lo, hi, edge in ((r.x0 + 32, x0, x1, r.x0 in (-16, 208)), (r.y0 + 32, y0, y1, r.y0 in (-16, 144)))) for x0, y0, x1, y1 in own]
            assert any(near)
    several = sum(1 + (k[1] % 5 == 0) for k in certified)
    assert seen == set(boxes) and kinds["region"] == several and kinds["animal"] == sum(len(boxes[k]) for k in has_animal)
    assert kinds["background"] == len([k for k in boxes if k in certified or k[0] >= "g6"])
    assert kinds["empty"] == len([k for k in boxes if k not in certified and k[0] < "g6" and k not in has_animal]) > 0


def test_dense_blocks(spark):
    """Blocks of any size put together are the plain nested arrays."""
    own = [("g1", 0, f, b, float(f), float(n)) for f in (0, 3, 4, 9, 10, 21) for n, b in enumerate(("a", "b")) if (f + n) % 4]
    own += [("g1", 1, 17, "a", 1.0, 2.0), ("g2", 0, 2, "b", 5.0, None)]
    df = spark.createDataFrame(own, "group_id string, animal int, frame int, bodypart string, x double, y double")
    last = {"g1": 21, "g2": 2}
    for block in (1, 4, 8, 512):
        whole = defaultdict(dict)
        for r in t.densify(df, ["a", "b"], block=block).collect():
            for n, row in enumerate(r.pose):
                whole[r.group_id, r.animal][r.t0 + n] = row
        assert set(whole) == {(g, a) for g, a, *_ in own}
        for (g, a), frames in whole.items():
            assert sorted(frames) == list(range(last[g] + 1))
            for f, row in frames.items():
                here = {b: (x, y) for gg, aa, ff, b, x, y in own if (gg, aa, ff) == (g, a, f)}
                assert (row is None) == (not here)
                if here:
                    assert [tuple(p) for p in row] == [here.get(b, (None, None)) for b in ("a", "b")]


def test_numbered_is_the_order(spark):
    df = spark.range(500).selectExpr("id", "id * 7919 % 503 AS k").repartition(7)
    got = sorted((r.place, r.k) for r in t.numbered(df, ["k", "id"], "place").collect())
    assert [p for p, _ in got] == list(range(500)) and [v for _, v in got] == sorted(v for _, v in got)


def rig():
    eye = np.eye(3)
    return mv.Rig(["c0", "c1", "c2"], np.full((3, 2), 300.0), np.tile([128.0, 96.0], (3, 1)), np.stack([eye] * 3), np.array([[0.0, 0, 5], [-1.0, 0, 5], [1.0, 0.5, 5]]), np.zeros((3, 5)), np.zeros((3, 2)))


def test_absent_detections_and_moving_cameras(spark):
    r = rig()
    world = np.array([[0.1, 0.2, 0.3], [-0.4, 0.1, 0.5]])
    shift = np.array([0.3, -0.2, 0.1])
    moved = r.moved(np.array([1]), [np.eye(3).ravel().tolist()], [(r.translation[1] + shift).tolist()])
    dets = []
    for f, own in ((0, r), (1, moved)):
        for c in range(3):
            for n, (u, v) in enumerate(own.project(world, np.full(2, c))):
                dets.append(("g", f, f"c{c}", n, float(u), float(v)))
            dets.append(("g", f, f"c{c}", 7, float("nan"), None))
    df = spark.createDataFrame(dets, "group_id string, frame int, camera string, det int, cx double, cy double")
    poses = spark.createDataFrame([("g", 1, "c1", np.eye(3).ravel().tolist(), (r.translation[1] + shift).tolist())], "group_id string, frame int, camera string, rotation array<double>, translation array<double>")
    for min_views in (1, 2):
        got = mv.associate_frames(df, r, 2.0, min_views, poses=poses).collect()
        assert {x.det for x in got} == {0, 1}
        for x in got:
            assert (x.x, x.y, x.z) == pytest.approx(tuple(world[x.det]), abs=1e-3)
    assert {x.instance for x in mv.associate_frames(df.where("frame = 0"), r, 2.0, max_n=1).collect()} == {0}


def test_pose_suppression(spark):
    """Of two rows whose points lie in each other's boxes the lower score goes; a third stays."""
    box = [("g", 0, n, "c0", x, 0.0, x + 10, 10.0, s) for n, x, s in ((0, 0.0, 0.5), (1, 0.5, 0.9), (2, 50.0, 0.1))]
    at = [("g", 0, n, "c0", x + 4.0, 5.0) for n, x in ((0, 0.0), (1, 0.5), (2, 50.0))]
    gone = k.pose_nms(spark.createDataFrame(box, "group_id string, frame int, row int, camera string, x0 double, y0 double, x1 double, y1 double, score double"), spark.createDataFrame(at, "group_id string, frame int, row int, camera string, x double, y double"))
    assert [r.row for r in gone.collect()] == [0]


def test_triangulation_gates(spark):
    """mv3: the points that are visible come back; mv4: the view that is off is rejected and the point is right."""
    shown = [r for r in QUERIES["mv3_triangulate_gated"](spark, DATA).collect() if r.status == "visible"]
    plain = rows(QUERIES["mv1_triangulate"](spark, DATA), "group_id", "frame", "point")
    assert shown
    for r in shown:
        p = plain[r.group_id, r.frame, r.point]
        assert r.n_views >= 2 and math.dist((r.x, r.y, r.z), (p.x, p.y, p.z)) < 0.5
    for r in QUERIES["mv4_triangulate_robust"](spark, DATA).collect():
        p = plain[r.group_id, r.frame, r.point]
        if r.n_rejected:
            assert r.point % 5 == 0
        if r.n_rejected == 1 and r.n_views >= 3:
            assert math.dist((r.x, r.y, r.z), (p.x, p.y, p.z)) < 0.05


def test_wn5_train_window(spark, truth):
    n_frames = {r.group_id: r.n_frames for r in fixture(spark, DATA, "sess").collect()}
    labels = defaultdict(set)
    for r in truth:
        if r["status"] == "visible":
            labels[r["group_id"], r["animal"]].add(r["frame"])
    found = rows(QUERIES["wn5_train_window"](spark, DATA), "group_id", "animal")
    assert set(found) == set(labels)
    for (g, a), own in labels.items():
        frames, key, got = sorted(own), (int(g[1:]), a), found[g, a]
        stride = math.floor(draw(5, *key) * 3) + 1
        anchor = frames[math.floor(draw(6, *key) * len(frames))]
        lattice = [f for f in frames if abs(f - anchor) % stride == 0 and abs(f - anchor) < 16 * stride]
        span = (max(lattice) - min(lattice)) // stride + 1
        size = min(max(span + span % 2, 2), 16)
        assert (got.stride, got.anchor, got.size, got.n_frames) == (stride, anchor, size, n_frames[g])
        # The window lies on the anchor's lattice and covers it.
        assert (anchor - got.start) % stride == 0 and got.start <= anchor <= got.start + (size - 1) * stride


def test_wn12_follow(spark):
    """Interpolated over gaps, then a moving average of 15 whose edges repeat."""
    means = defaultdict(lambda: defaultdict(list))
    for r in fixture(spark, DATA, "track").collect():
        means[r.group_id][r.frame].append((r.x, r.y))
    found = rows(QUERIES["wn12_follow"](spark, DATA), "group_id", "frame")
    n = 0
    for g, frames in means.items():
        at = sorted(frames)
        every = np.arange(at[0], at[-1] + 1)
        for axis, (name, most) in enumerate((("x0", 256), ("y0", 192))):
            filled = np.interp(every, at, [np.mean([p[axis] for p in frames[f]]) for f in at])
            smooth = np.convolve(np.pad(filled, 7, mode="edge"), np.full(15, 1 / 15), mode="valid")
            want = np.floor(np.round(np.clip(smooth - 24, 0, most - 48), 6)).astype(int)
            for f, v in zip(every.tolist(), want.tolist(), strict=True):
                assert abs(found[g, f][name] - v) <= 1
                n += found[g, f][name] == v
    assert len(found) == sum(max(f) - min(f) + 1 for f in means.values()) and n >= 0.99 * 2 * len(found)
