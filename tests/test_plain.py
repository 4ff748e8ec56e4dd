"""Queries that SQL cannot express against plain loops over the whole small tables."""

import time
from itertools import permutations

import numpy as np
import pytest

from tracklark.functions import kernels as K
from tracklark.operators.features import acf
from tracklark.plans import images as I
from tracklark.plans import tracks as T
from tracklark.plans.catalogue import QUERIES
from tracklark.plans.registry import hourly, points


def run(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


def test_seed_tracks(spark, sf_dir):
    want, groups = set(), {}
    for r in T._detections(spark, sf_dir).where("frame <= 40").collect():
        groups.setdefault((r.movie, r.channel), []).append((r.frame, r.x, r.y))
    for key, rows in groups.items():
        tracks = []
        for frame in sorted({f for f, _, _ in rows}):
            free = sorted((x, y) for f, x, y in rows if f == frame)
            for t in tracks:
                if free and frame - t[-1][0] <= 2:
                    d, x, y = min((float(np.hypot(x - t[-1][1], y - t[-1][2])), x, y) for x, y in free)
                    if d <= 40:
                        t.append((frame, x, y))
                        free.remove((x, y))
            tracks += [[(frame, x, y)] for x, y in free]
        want |= {(*key, n, *p) for n, t in enumerate(tracks, 1) for p in t}
    got = {(r.movie, r.channel, r.seed, r.frame, r.x, r.y) for r in run(spark, sf_dir, "seed_tracks")}
    assert got == want


def test_optimal_seed_matches():
    """Total distance of random small channels against all ways to pair them."""
    import pandas as pd

    from tracklark.functions.assignment import assign

    draw = np.random.default_rng(8)
    for _ in range(60):
        n, m = draw.integers(1, 5, 2)
        cost = draw.uniform(0, 10, (n, m))
        found = assign(cost)
        total = sum(cost[i, j] for i, j in found)
        wide = cost if n <= m else cost.T
        least = min(sum(wide[i, p[i]] for i in range(len(wide))) for p in permutations(range(wide.shape[1]), len(wide)))
        assert abs(total - least) < 1e-9 and len(found) == min(n, m)
    assert pd.DataFrame is not None


def test_optimal_matches_query_takes_the_least_total(spark):
    from tracklark.operators.matching import optimal_matches

    draw = np.random.default_rng(9)
    rows = [(c, r, k, 5, float(draw.uniform(0, 4))) for c in "ab" for r in range(4) for k in range(5)]
    got = optimal_matches(spark.createDataFrame(rows, "channel string, ref int, cand int, shared int, mean_distance double"), 3.0).collect()
    for c in "ab":
        cost = np.array([d for ch, _, _, _, d in rows if ch == c]).reshape(4, 5)
        best = min(permutations(range(5), 4), key=lambda p: sum(cost[i, p[i]] for i in range(4)))
        assert {(r.ref, r.cand) for r in got if r.channel == c} == {(i, j) for i, j in enumerate(best) if cost[i, j] <= 3.0}


def test_sparse_assignment_equals_the_dense_one():
    from tracklark.functions.assignment import assign, assign_sparse

    draw = np.random.default_rng(18)
    for _ in range(400):
        n, m = draw.integers(1, 9, 2)
        known = draw.random((n, m)) < draw.choice([0.2, 0.5, 1.0])
        cost = np.where(known, draw.integers(0, 6, (n, m)) if draw.random() < 0.5 else draw.uniform(0, 10, (n, m)), 1e6)
        want = [(i, j) for i, j in assign(cost) if known[i, j]]
        rows, columns = np.nonzero(known)
        own = cost[rows, columns].tolist()
        found = assign_sparse(rows.tolist(), columns.tolist(), own)
        pairs = [(rows[k], columns[k]) for k in found]
        assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs) == len(want)
        assert abs(sum(own[k] for k in found) - sum(cost[i, j] for i, j in want)) < 1e-9


def test_a_long_chain_is_solved_on_lists():
    from tracklark.functions.assignment import assign_sparse

    # A ladder of 20,000 rows; a dense matrix would hold 4 * 10^8 costs.
    n = 20_000
    rows = [k for k in range(n) for _ in range(2)]
    columns = [c for k in range(n) for c in (k, min(k + 1, n - 1))]
    found = assign_sparse(rows, columns, [1.0 + (k % 7) * 0.01 for k in range(2 * n)])
    assert len(found) == n


SCORED = "channel string, ref int, cand int, shared int, mean_distance double"


def test_greedy_rounds_equal_the_sorted_fold(spark):
    from tracklark.operators.matching import greedy_matches

    draw = np.random.default_rng(10)
    rows = [(c, int(r), int(k), 5, float(draw.integers(0, 12))) for c in ("a", "b", "c", None) for r in range(25) for k in range(30) if draw.random() < 0.4]
    # A chain in which one pair decides the next.
    rows += [("chain", (k + 1) // 2, k // 2, 1, float(k)) for k in range(12)]
    rows += [("a", 90, None, 1, 0.0), ("a", 91, 91, 1, None), ("d", 1, 1, 2, 3.0), ("d", 1, 1, 9, 2.0)]
    got = greedy_matches(spark.createDataFrame(rows, SCORED).repartition(5))
    assert got.columns == ["channel", "ref", "cand", "shared", "mean_distance"]
    want, used = set(), set()
    for row in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[4], r[1], r[2])):
        if (row[0], "r", row[1]) not in used and (row[0], "c", row[2]) not in used:
            used |= {(row[0], "r", row[1]), (row[0], "c", row[2])}
            want.add(row)
    assert {tuple(r) for r in got.collect()} == want
    assert greedy_matches(spark.createDataFrame([], SCORED)).count() == 0


def test_one_channel_of_many_scores(spark):
    from tracklark.operators.matching import greedy_matches, optimal_matches

    draw = np.random.default_rng(11)
    pairs = {(int(r), int(r + draw.integers(-8, 9))) for r in draw.integers(0, 20_000, 150_000)}
    rows = [("one", r, c, 5, float(draw.uniform(0, 100))) for r, c in sorted(pairs)]
    assert len(rows) >= 100_000
    frame = spark.createDataFrame(rows, SCORED)
    refs, cands, want = set(), set(), set()
    for _, r, c, _, _ in sorted(rows, key=lambda x: (x[4], x[1], x[2])):
        if r not in refs and c not in cands:
            refs.add(r)
            cands.add(c)
            want.add((r, c))
    assert {(r.ref, r.cand) for r in greedy_matches(frame).select("ref", "cand").collect()} == want
    # Islands of 20 refs, as components of the optimal matching.
    some = frame.where("abs(ref % 40 - 10) < 10 AND abs(cand % 40 - 10) < 10 AND floor(ref / 40) = floor(cand / 40)")
    found = optimal_matches(some, 1e9)
    assert found.columns == frame.columns
    got = found.collect()
    assert len({r.ref for r in got}) == len({r.cand for r in got}) == len(got) > 4000
    with pytest.raises(Exception, match="more than 3"):
        optimal_matches(some, 1e9, most_scores=3).collect()


def plain_components(mask):
    """Four-neighbour components by flooding, in raster order."""
    seen, out = set(), []
    for start in zip(*np.nonzero(mask)):
        if start not in seen:
            todo, own = [start], []
            seen.add(start)
            while todo:
                y, x = todo.pop()
                own.append((y, x))
                for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and p not in seen:
                        seen.add(p)
                        todo.append(p)
            out.append(own)
    return out


def test_mask_merge(spark, sf_dir):
    from tracklark.operators.pixels import solidity

    masks = {}
    for r in I._objects(spark, sf_dir).collect():
        masks.setdefault(r.fov, {}).setdefault(r.obj, set()).add((r.y, r.x))
    want = set()
    for fov, own in masks.items():
        changed = True
        while changed:
            changed = False
            for a in sorted(own):
                for b in sorted(own):
                    union = own[a] | own[b]
                    grid = np.zeros((8, 8), bool)
                    grid[tuple(zip(*union))] = True
                    near = any(abs(y - v) + abs(x - u) <= 2 for y, x in own[a] for v, u in own[b])
                    if b > a and near and len(union) <= 30 and solidity(grid) >= 0.6:
                        own[a], changed = union, True
                        del own[b]
                        break
                if changed:
                    break
        want |= {(fov, o, len(m)) for o, m in own.items()}
    assert {(r.fov, r.obj, r.area) for r in run(spark, sf_dir, "mask_merge")} == want


def test_merges_of_random_fields_equal_starting_again(spark):
    from tracklark.operators.pixels import merged_masks, solidity

    draw = np.random.default_rng(16)
    fields = {}
    for fov in range(12):
        for obj in range(14):
            y, x = draw.integers(0, 22, 2)
            h, w = draw.integers(1, 5, 2)
            fields.setdefault(fov, {})[int(obj * 3)] = {(int(y + a), int(x + b)) for a in range(h) for b in range(w)}
    rows = [(f, o, y, x) for f, own in fields.items() for o, m in own.items() for y, x in m]
    frame = spark.createDataFrame(rows, "fov int, obj int, y int, x int")
    for square in (False, True):
        close = (lambda dy, dx: max(abs(dy), abs(dx)) <= 2) if square else (lambda dy, dx: abs(dy) + abs(dx) <= 2)
        want = set()
        for fov, first in fields.items():
            own, changed = {o: set(m) for o, m in first.items()}, True
            while changed:
                changed = False
                for a, b in ((a, b) for a in sorted(own) for b in sorted(own) if a < b):
                    union = own[a] | own[b]
                    grid = np.zeros((30, 30), bool)
                    grid[tuple(zip(*union))] = True
                    if len(union) <= 40 and any(close(y - v, x - u) for y, x in own[a] for v, u in own[b]) and solidity(grid) >= 0.6:
                        own[a], changed = union, True
                        del own[b]
                        break
            want |= {(fov, o, y, x) for o, m in own.items() for y, x in m}
        assert {tuple(r) for r in merged_masks(frame, 40, square=square).collect()} == want


def test_many_objects_of_one_field(spark):
    from tracklark.operators.pixels import merged_masks

    # Pairs of 5 x 5 squares, one pixel apart; 5,000 objects in all.
    rows = [(1, 100 * i + j, 14 * i + a, 6 * j + (j // 2) * 4 + b) for i in range(50) for j in range(100) for a in range(5) for b in range(5)]
    frame = spark.createDataFrame(rows, "fov int, obj int, y int, x int").coalesce(2)
    began = time.time()
    got = merged_masks(frame, 60).select("obj").distinct().count()
    assert got == 2500
    assert time.time() - began < 120


def planes(spark, sf_dir):
    return {r.stack_id: np.frombuffer(r.px, "<f8").reshape(24, 24) for r in I.planes(spark, sf_dir).collect()}


def test_planes_are_the_enlarged_images(spark, sf_dir):
    found = planes(spark, sf_dir)
    for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").limit(40).collect():
        want = [[max(0.0, r.embedding[y // 3 * 8 + x // 3]) * 1000 for x in range(24)] for y in range(24)]
        assert np.allclose(found[r.vec_id], want)


def test_bright_spots(spark, sf_dir):
    got = {}
    for r in run(spark, sf_dir, "bright_spots"):
        got.setdefault(r.stack_id, []).append((r.y, r.x, r.level))
    for stack, image in planes(spark, sf_dir).items():
        region = K.nucleus(image)
        region = np.ones(image.shape, bool) if region is None else region
        dark = [c for c in plain_components(image < 0.85 * np.percentile(image, 75)) if any(y in (0, 23) or x in (0, 23) for y, x in c)]
        valid = np.ones(image.shape, bool)
        for c in dark:
            for p in c:
                valid[p] = False
        mean, dev = image[valid].mean(), image[valid].std()

        def parts(k, valid=valid, image=image, region=region, mean=mean, dev=dev):
            out = []
            for c in plain_components((image > mean + k * dev) & valid):
                cy, cx = np.mean([p[0] for p in c]), np.mean([p[1] for p in c])
                if len(c) >= 10 and region[round(cy), round(cx)]:
                    out.append((cy, cx, c))
            return out

        want = []
        for cy, cx, c in parts(1.0):
            kept = [(cy, cx, 1.0)]
            if len(c) > 60:
                for k in (1.0, 1.5, 2.0):
                    inner = [p for p in parts(k) if set(p[2]) & set(c)]
                    if not inner:
                        break
                    if all(len(p[2]) <= 60 for p in inner):
                        kept = [(y, x, k) for y, x, _ in inner]
                        break
            want += kept
        assert np.allclose(sorted(got.get(stack, [])), sorted(want), atol=1e-3) if want else stack not in got


def test_nuclei_are_the_largest_filled_component(spark, sf_dir):
    got = {r.stack_id: r for r in run(spark, sf_dir, "detect_nuclei")}
    for stack, image in planes(spark, sf_dir).items():
        smooth = K.gaussian(image, 2.0)
        level = K.otsu(smooth)
        mask = smooth > level
        holes = [c for c in plain_components(~mask) if not any(y in (0, 23) or x in (0, 23) for y, x in c)]
        for c in holes:
            for p in c:
                mask[p] = True
        largest = max(plain_components(mask), key=len)
        assert got[stack].area == len(largest) and got[stack].cy == pytest.approx(np.mean([p[0] for p in largest]), abs=1e-3)


def test_drift_is_the_best_whole_shift(spark, sf_dir):
    """Moving by the reported shift, rounded, correlates no worse than any other whole shift of a few pixels."""
    stacks = planes(spark, sf_dir)
    first = stacks[min(stacks)]
    got = {r.stack_id: r for r in run(spark, sf_dir, "register_drift")}
    assert len(got) == len(stacks) and abs(got[min(stacks)].shift_y) < 0.1 and got[min(stacks)].correlation > 0.99
    for stack in list(stacks)[:40]:
        product = np.fft.fft2(first) * np.conj(np.fft.fft2(stacks[stack]))
        phase = np.fft.ifft2(product / np.maximum(np.abs(product), 100 * np.finfo(float).eps))
        peak = np.array(np.unravel_index(np.abs(phase).argmax(), phase.shape), float)
        peak[peak > 12] -= 24
        assert abs(got[stack].shift_y - peak[0]) <= 1.5 and abs(got[stack].shift_x - peak[1]) <= 1.5


def test_decay_fits_are_least_squares(spark, sf_dir):
    got = {r.track_id: r for r in run(spark, sf_dir, "decay_fit")}
    tracks = {}
    for r in points(spark, sf_dir).collect():
        tracks.setdefault(r.track_id, []).append((r.frame, r.x, r.y))
    checked = 0
    for track, rows in tracks.items():
        xy = np.array([p[1:] for p in sorted(rows)])
        step = np.hypot(*np.diff(xy, axis=0).T)
        if len(step) < 6 or (tau := got[track].speed_tau) is None or tau < 0.3:
            continue
        value = acf(step)
        lag = np.arange(1, len(value) + 1.0)[value > 0]
        value = value[value > 0]
        error = lambda t: ((np.exp(-lag / t) - value) ** 2).sum()  # noqa: B023, E731
        near = np.linspace(0.8 * tau, 1.2 * tau, 201)
        assert error(tau) <= min(map(error, near)) + 1e-6
        checked += 1
    assert checked > 0


def test_static_roi(spark, sf_dir):
    from tracklark.operators.pixels import line

    want, tracks = {}, {}
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect():
        tracks.setdefault(r.user_id, []).append((r.event_id, round(r.value % 40), round(float(r.event_id % 37))))
    for track, rows in tracks.items():
        path, places = set(), [p[1:] for p in sorted(rows)]
        for a, b in zip(places, places[1:] or places):
            path |= set(line(*a, *b))
        want[track] = {(y + a, x + b) for y, x in path for a in range(-5, 6) for b in range(-5, 6) if abs(a) + abs(b) <= 5 and 0 <= y + a < 40 and 0 <= x + b < 40}
    got = {}
    for r in run(spark, sf_dir, "static_roi"):
        got.setdefault(r.img, set()).add((r.y, r.x))
    assert got == want
    # A path of straight lines is one piece, and so is its ROI.
    for own in list(got.values())[:5]:
        grid = np.zeros((40, 40), bool)
        grid[tuple(zip(*own))] = True
        assert len(plain_components(grid)) == 1


def test_links_never_jump_and_keep_every_detection(spark, sf_dir):
    hours = hourly(spark, sf_dir).count()
    rows = run(spark, sf_dir, "link_detections")
    tracks = {}
    for r in rows:
        tracks.setdefault((r.movie, r.channel, r.track_no), []).append((r.frame, r.x, r.y))
    assert len(rows) <= hours
    for own in tracks.values():
        own.sort()
        assert len(own) >= 4
        for (f, x, y), (g, u, v) in zip(own, own[1:]):
            assert 1 <= g - f <= 4 and np.hypot(x - u, y - v) < 25
