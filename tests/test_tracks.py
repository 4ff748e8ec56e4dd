"""Features, linking and matching against plain versions and known cases."""

import time
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from tracklark.functions.assignment import assign
from tracklark.functions.delaunay import delaunay_edges
from tracklark.operators import features, linking, matching, steps
from tracklark.plans.catalogue import QUERIES
from tracklark.plans.registry import hourly

POINTS = "track_id long, frame int, x double, y double"


@pytest.fixture(scope="module")
def tracks(spark):
    draw = np.random.default_rng(1)
    rows = [(t, int(f), *map(float, draw.normal(0, 100, 2).round(2))) for t in range(12) for f in np.sort(draw.choice(60, draw.integers(1, 40), replace=False)) + 1]
    rows += [(50, f, 5.0, 5.0) for f in range(1, 9)] + [(51, f, float(f), 2.0 * f) for f in range(1, 9)]
    return spark.createDataFrame(rows, POINTS)


def by_track(df):
    return {t: g.sort_values("frame") for t, g in df.toPandas().groupby("track_id")}


def rows(df):
    return {r.track_id: r for r in df.collect()}


def test_basic_features_equal_numpy_and_ignore_rotation(spark, tracks):
    from pyspark.sql import functions as F

    got = rows(features.basic(tracks))
    turned = rows(features.basic(tracks.select("track_id", "frame", (F.col("x") * 0.6 - F.col("y") * 0.8 + 7).alias("x"), (F.col("x") * 0.8 + F.col("y") * 0.6 - 3).alias("y"))))
    for t, g in by_track(tracks).items():
        xy = g[["x", "y"]].to_numpy()
        step = np.hypot(*np.diff(xy, axis=0).T)
        r = got[t]
        assert r.n_frames == len(xy) and np.isclose(r.path_length, step.sum())
        assert np.isclose(r.radius_of_gyration, np.sqrt(((xy - xy.mean(0)) ** 2).sum(1).mean()))
        if len(xy) == 1:
            assert r.x_variance is None and r.net_displacement is None and r.straightness is None
        for c in ("path_length", "radius_of_gyration", "max_step", "net_displacement"):
            assert (r[c] is None and turned[t][c] is None) or np.isclose(r[c], turned[t][c], atol=1e-6)
    assert got[50].straightness is None and np.isclose(got[51].straightness, 1)


def plain_welch(v):
    m = min(len(v), 8)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
    parts = []
    for a in range(0, len(v) - m + 1, m - m // 2):
        s = v[a : a + m]
        p = np.abs(np.fft.rfft((s - s.mean()) * hann)) ** 2 / (hann**2).sum()
        p[1 : -1 if m % 2 == 0 else None] *= 2
        parts.append(p)
    p, f = np.mean(parts, axis=0), np.arange(m // 2 + 1) / m
    return ((p[1:] + p[:-1]) / 2).sum() / m, (f * p).sum() / p.sum()


def plain_wavelet(v):
    def level(x):
        ext = np.concatenate([x[:3][::-1] if len(x) > 2 else x[::-1], x, x[-3:][::-1]])
        out = [[sum(f[t] * ext[3 + 2 * o + 1 - t] for t in range(4)) for o in range((len(x) + 3) // 2)] for f in (features.LOW, features.HIGH)]
        return map(np.array, out)

    a, d = level(v)
    detail = (d**2).sum()
    if len(v) >= 12:
        a, d = level(a)
        detail += (d**2).sum()
    return (a**2).sum(), detail


def test_spectra_and_wavelets_equal_numpy(tracks):
    moved = steps.steps(tracks)
    psd, bank = rows(features.welch(moved, "step")), rows(features.wavelet(moved, "step"))
    for t, g in by_track(moved).items():
        v = g.step.dropna().to_numpy()
        if len(v) < 4:
            assert t not in psd and t not in bank
        elif v.std() > 1e-9:
            assert np.allclose([psd[t].total_power, psd[t].spectral_centroid], plain_welch(v))
            if len(v) >= 6:
                assert np.allclose([bank[t].energy_approx, bank[t].energy_detail], plain_wavelet(v))


def test_one_row_of_features_equals_its_parts(spark, tracks):
    odd = spark.createDataFrame([(60, 1, 1.0, 2.0), (61, 1, 0.0, 0.0), (61, 5, 3.0, 4.0), (62, 2, None, 1.0)] + [(63, f, float(f % 3), float(f % 3)) for f in range(1, 20)], POINTS)
    whole = tracks.union(odd).repartition(5)
    got = rows(features.all_features(whole, 0.5))
    moved = steps.with_angles(steps.steps(whole))
    parts = [features.basic(whole), features.turning(whole), features.hulls(whole), features.vector_autocorrelation(whole), features.decays(whole)]
    named = lambda df, prefix: df.select("track_id", *[df[c].alias(f"{prefix}{c}") for c in df.columns if c != "track_id"])
    parts += [named(features.autocorrelation(moved, "step", (1,)), "speed_acf_"), named(features.autocorrelation(moved, "angle", (1, 2)), "angle_acf_")]
    parts += [named(f, f"{v}_") for v in ("step", "angle") for f in (features.welch(moved, v, 2.0), features.wavelet(moved, v))]
    assert set(got) == {r.track_id for r in whole.select("track_id").distinct().collect()}
    for part in parts:
        found = rows(part)
        for t, own in got.items():
            for c in part.columns[1:]:
                want = found[t][c] if t in found else None
                if c.endswith(("centroid", "peak_frequency")) and own[c.split("_")[0] + "_total_power"] is not None and own[c.split("_")[0] + "_total_power"] < 1e-9:
                    continue  # the shape of rounding noise
                assert (own[c] is None) == (want is None) and (want is None or own[c] == pytest.approx(want, rel=1e-6, abs=1e-9)), (t, c)


def test_hulls_are_cut_before_the_shuffle(spark):
    draw = np.random.default_rng(14)
    points = draw.normal(size=(30_000, 2))
    ring = [(float(np.cos(a)) * 9, float(np.sin(a)) * 9) for a in np.linspace(0, 2 * np.pi, 700, endpoint=False)]
    frame = spark.createDataFrame([(7, k, float(x), float(y)) for k, (x, y) in enumerate([*points.tolist(), *ring])] + [(8, 1, None, 1.0)], POINTS).repartition(4)
    assert features.partial_hulls(frame.where("frame < 30000")).count() < 400
    got = rows(features.hulls(frame))
    assert got[7].hull_area == pytest.approx(features.hull_area(np.array(ring))) and got[8].hull_area is None


def test_the_feature_row_shuffles_points_once(spark):
    frame = spark.createDataFrame([(1, 1, 0.0, 0.0)], POINTS)
    plan = features.all_features(frame)._jdf.queryExecution().executedPlan().toString()
    # One of the points and one of the hulls' corners.
    assert plan.count("Exchange hashpartitioning") == 2


def test_hulls_and_fits(tracks):
    got = rows(features.hulls(tracks))
    assert got[50].hull_area is None and got[51].hull_area is None
    assert features.hull_area(np.array([[0, 0], [4, 0], [4, 3], [0, 3], [2, 1], [2, 0]], float)) == 12
    lag = np.arange(1, 9.0)
    assert np.isclose(features.decay_fit(lag, np.exp(-lag / 3.5), 2.0), 3.5)
    assert features.decay_fit(lag, -np.ones(8), 2.0) is None
    assert {"speed_tau", "angle_tau", "persistence"} <= set(features.decays(tracks).columns)


def test_autocorrelation_needs_enough_lags(tracks):
    moved = steps.with_angles(steps.steps(tracks))
    got = rows(features.autocorrelation(moved, "angle", (1, 2)))
    for t, g in by_track(moved).items():
        v = g.angle.dropna().to_numpy()
        want = features.acf(v)
        for k in (1, 2):
            value = got[t][f"lag{k}"] if t in got else None
            assert (value is None) == (len(want) < k) and (value is None or np.isclose(value, want[k - 1]))


# Linking


def linked(points, reach, memory=0, least=1):
    return linking.linked(pd.DataFrame(points, columns=["x", "y", "frame"]), reach, memory, least)


def test_known_linking_cases():
    assert linked([(10, 10, 1)], 5, least=2).empty
    assert linked([(10, 10, 1), (100, 100, 2)], 1, least=2).empty
    one = linked([(10 + k / 10, 10 + k / 10, k + 1) for k in range(4)], 5, least=4)
    assert one.track_no.tolist() == [1] * 4
    assert linked([(0, 0, 1), (5, 0, 2)], 5).track_no.nunique() == 2
    gap = [(0, 0, 1), (1, 0, 2), (50, 0, 3), (2, 0, 4)]
    assert linked(gap, 5, 0).track_no.nunique() == 3 and linked(gap, 5, 1).track_no.nunique() == 2


def test_links_are_short_once_each_and_optimal():
    draw = np.random.default_rng(3)
    for _ in range(40):
        n, m = draw.integers(1, 5, 2)
        a, b = draw.uniform(0, 10, (n, 2)), draw.uniform(0, 10, (m, 2))
        found = linked([(*p, 1) for p in a] + [(*p, 2) for p in b], 4.0)
        cost, links = 0.0, 0
        for _, g in found.groupby("track_no"):
            assert len(g) <= 2 and not g.frame.duplicated().any()
            if len(g) == 2:
                d = np.hypot(*(g[["x", "y"]].to_numpy()[0] - g[["x", "y"]].to_numpy()[1]))
                assert d < 4
                cost, links = cost + d**2, links + 1
        cost += 16 * (n - links)
        best = 16.0 * n

        def search(i, used, total):
            nonlocal best
            if i == n:
                best = min(best, total)
                return
            search(i + 1, used, total + 16)
            for j in range(m):
                d2 = ((a[i] - b[j]) ** 2).sum()
                if j not in used and d2 < 16:
                    search(i + 1, used | {j}, total + d2)

        search(0, frozenset(), 0.0)
        assert np.isclose(cost, best)


def test_assignment_is_optimal():
    from itertools import permutations

    draw = np.random.default_rng(4)
    for _ in range(60):
        n, m = sorted(map(int, draw.integers(1, 6, 2)))
        cost = draw.integers(0, 9, (n, m)).astype(float)
        assert sum(cost[r, c] for r, c in assign(cost)) == min(sum(cost[r, c] for r, c in enumerate(p)) for p in permutations(range(m), n))
        assert len(assign(cost.T)) == n
    assert assign(np.zeros((0, 3))) == []


def test_blocks_are_not_bridged(spark):
    rows_ = [(1, "G", f, float(f), 0.0) for f in (1, 2, 3, 4, 6, 7, 8, 9, 20, 21)]
    got = linking.link_blocks(spark.createDataFrame(rows_, "movie long, channel string, frame int, x double, y double"), 5.0, 3, 3).toPandas()
    assert sorted(got.groupby("track_no").frame.apply(list)) == [[1, 2, 3, 4], [6, 7, 8, 9]]


def test_delaunay_edges(spark):
    square = [(1, 1, 0.0, 0.0), (1, 1, 4.0, 0.0), (1, 1, 4.0, 3.0), (1, 1, 0.1, 3.0), (1, 2, 0.0, 0.0)]
    got = {r.frame: r for r in linking.crowding(spark.createDataFrame(square, "movie long, frame long, x double, y double")).collect()}
    assert got[1].points == 4 and np.isclose(got[1].edge_min, 3.0) and got[2].edge_mean is None


def plain_edges(points):
    """Edges through whose ends some empty circle goes, by bounds of its centre along their bisector, in fractions."""
    points = [(Fraction(x), Fraction(y)) for x, y in points.tolist()]
    out = set()
    for (i, (ax, ay)), (j, (bx, by)) in combinations(enumerate(points), 2):
        low, high, free = None, None, True
        for k, (x, y) in enumerate(points):
            if k not in (i, j):
                px, py = x - (ax + bx) / 2, y - (ay + by) / 2
                side, beyond = px * (ay - by) + py * (bx - ax), px * px + py * py - ((bx - ax) ** 2 + (by - ay) ** 2) / 4
                if side > 0:
                    high = beyond / side if high is None else min(high, beyond / side)
                elif side < 0:
                    low = beyond / side if low is None else max(low, beyond / side)
                else:
                    free &= beyond > 0
        if free and (low is None or high is None or low <= high):
            out.add((i, j))
    return out


def test_triangulations_equal_the_empty_circles():
    draw = np.random.default_rng(12)
    for n in range(250):
        size = int(draw.integers(2, 25))
        kinds = [draw.integers(0, 5, (size, 2)), draw.normal(size=(size, 2)), np.stack([draw.integers(0, 9, size), np.zeros(size)], axis=1), draw.integers(0, 4, (size, 2)) * 1e-9 + 7e8, draw.integers(0, 3, (size, 2)) * 0.1]
        points = np.unique(kinds[n % 5].astype(float), axis=0)
        draw.shuffle(points)
        assert {tuple(e) for e in delaunay_edges(points).tolist()} == plain_edges(points)


def test_many_points_of_one_frame(spark):
    draw = np.random.default_rng(13)
    points = draw.uniform(0, 1000, (20_000, 2))
    began = time.time()
    edges = delaunay_edges(points)
    assert time.time() - began < 10 * max(1, 0.2 + spin()) and 2 * len(points) < len(edges) < 3 * len(points)
    frame = spark.createDataFrame([(1, 1, float(x), float(y)) for x, y in points[:500]] + [(1, 2, 0.0, 0.0), (1, 2, 0.0, 0.0), (1, 2, None, 1.0), (1, 3, None, None)], "movie long, frame long, x double, y double")
    got = {r.frame: r for r in linking.crowding(frame, reach=30.0).collect()}
    e = delaunay_edges(points[:500])
    mean = np.unique(np.round(np.hypot(*(points[e[:, 0]] - points[e[:, 1]]).T), 9)).mean()
    assert got[1].edge_mean == pytest.approx(mean) and got[1].density_index == pytest.approx(60 / mean) and got[1].warning == "reach beyond half the mean distance"
    assert (got[2].points, got[2].density_index, got[2].warning) == (1, None, "fewer than three points") and set(got) == {1, 2}


def spin():
    """How much slower than usual this machine is."""
    began = time.thread_time()
    sum(range(5_000_000))
    return (time.thread_time() - began) / 0.1


def plain_follow(spots, reference, step, reach):
    out = []
    for t in {r[0] for r in reference}:
        own = {f: (x, y) for u, f, x, y in reference if u == t}
        mean, last = np.mean(list(own.values()), axis=0), None
        for f in sorted({s[0] for s in spots}):
            near = [(np.hypot(x - own.get(f, mean)[0], y - own.get(f, mean)[1]), x, y) for g, x, y in sorted(spots) if g == f]
            near = [s for s in near if s[0] <= reach]
            moved = [(np.hypot(x - last[0], y - last[1]), x, y) for _, x, y in near] if last else []
            if near:
                first = bool(moved) and min(moved)[0] <= step
                last = min(moved if first else near)[1:]
                out.append((t, f, *last, first))
    return sorted(out)


def test_follow_reference_query_takes_all_tracks(spark, tmp_path):
    draw = np.random.default_rng(6)
    users = (3, 19, 20, 250, 70000)
    rows = [(k, int(u), "click" if k % 3 else "view", float(draw.integers(0, 60)), '{"k": %d}' % draw.integers(0, 60), int(draw.integers(0, 40))) for k, u in enumerate(draw.choice(users, 400))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, h int").selectExpr("*", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, h) ts").drop("h")
    events.write.parquet(f"{tmp_path}/events.parquet")
    points = hourly(spark, str(tmp_path)).collect()
    want = plain_follow([(r.frame, r.x, r.y) for r in points if r.channel == "view"], [(r.track_id, r.frame, r.x, r.y) for r in points if r.channel == "click"], 20.0, 30.0)
    assert sorted(map(tuple, QUERIES["follow_reference"](spark, str(tmp_path)).collect())) == want and {r[0] for r in want} == set(users)


def test_crowding_query_takes_all_detections(spark, tmp_path):
    corners = [(0, 0), (30, 0), (0, 40)]
    rows = [(8 * n, float(x), '{"k": %d}' % y, h) for h in (5, 60, 61, 700) for n, (x, y) in enumerate(corners)]
    events = spark.createDataFrame(rows, "user_id long, value double, props string, h int").selectExpr("monotonically_increasing_id() event_id", "user_id", "'view' event_type", "value", "props", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, h) ts")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.frame: r for r in QUERIES["crowding"](spark, str(tmp_path)).collect()}
    assert {f: (r.points, r.edge_mean, r.edge_min, r.edge_std) for f, r in got.items()} == dict.fromkeys((6, 61, 62, 701), (3, 40.0, 30.0, 10.0))


# Matching


def test_greedy_matches_and_decisions(spark):
    def track(channel, name, shift, first=1, n=8):
        return [(channel, name, f, 10.0 * f + shift, 0.0) for f in range(first, first + n)]

    refs = track("R", "a", 0) + track("R", "b", 1) + track("R", "c", 9000) + track("R", "d", 0, 100) + track("R", "e", 20000, 10)
    cands = track("R", "k1", 0.5) + track("R", "k2", 30) + track("R", "k3", 20001, 10) + track("R", "k4", 3)
    frame = lambda some, name: spark.createDataFrame(some, f"channel string, {name} string, frame int, x double, y double")
    got = {r.ref: r for r in matching.match_decisions(frame(refs, "ref"), frame(cands, "cand")).collect()}
    assert [got[k].status for k in "abcde"] == ["saved", "saved", "rejected_distance", "no_match", "rejected_red_late_start"]
    assert got["a"].cand == "k1" and got["b"].cand == "k4" and got["c"].cand == "k2"
    used = [r.cand for r in got.values() if r.cand]
    assert len(used) == len(set(used)) and not [1 for a, b in combinations(used, 2) if a == b]


def test_longest_takes_points_then_span_then_start_then_number(spark):
    audit = spark.createDataFrame([(1, "P", 1, 10, 12, 2), (1, "P", 2, 10, 13, 3), (1, "P", 3, 9, 20, 1)], "allele int, channel string, cand int, points int, frame_span int, first_frame int")
    grid = spark.createDataFrame([(a, c) for a in (1, 2) for c in "GPR"], "allele int, channel string")
    got = {(r.allele, r.channel): r for r in matching.selection_audit(audit, grid, ("allele", "channel")).collect()}
    assert len(got) == 6 and got[1, "P"].cand == 2 and sum(r.candidates == 0 for r in got.values()) == 5


def test_link_radius(spark):
    from pyspark.sql import functions as F

    from tracklark.functions import expressions as E

    assert spark.range(1).select(E.ceil_to(F.lit(2.7268931949549495), 0.05)).first()[0] == pytest.approx(2.75)
    assert [r[0] for r in spark.createDataFrame([("\\u00b5m",), ("Microns",), ("µm",), ("nm",)], "u string").select(E.unit_text(F.col("u"))).collect()] == ["um", "um", "um", "nm"]


def least_cost(old, new, reach):
    """The least sum of squares over all matchings, where a lost track costs the reach squared."""
    if not old:
        return 0.0
    first, rest = old[0], old[1:]
    out = reach**2 + least_cost(rest, new, reach)
    for k, p in enumerate(new):
        d = (first[0] - p[0]) ** 2 + (first[1] - p[1]) ** 2
        if d < reach**2:
            out = min(out, d + least_cost(rest, new[:k] + new[k + 1 :], reach))
    return out


def test_links_of_small_frames_cost_the_least():
    import numpy as np

    from tracklark.operators.linking import Linker

    draw = np.random.default_rng(5)
    for _ in range(60):
        linker = Linker(2.0, 0)
        before = draw.uniform(-3, 3, (draw.integers(0, 6), 2))
        after = draw.uniform(-3, 3, (draw.integers(0, 6), 2))
        linker.step(1, before)
        names = linker.step(2, after)
        cost = sum(((before[n] - p) ** 2).sum() for n, p in zip(names, after) if n < len(before))
        cost += 4.0 * (len(before) - sum(n < len(before) for n in names))
        assert abs(cost - least_cost(before.tolist(), after.tolist(), 2.0)) < 1e-9
        assert len(set(names)) == len(names)


def test_near_pairs_equal_all_pairs_and_large_parts_are_refused(monkeypatch):
    import numpy as np

    from tracklark.operators.linking import Linker, near_pairs

    draw = np.random.default_rng(6)
    for few in (0, 10**6) * 25:
        monkeypatch.setattr(linking, "FEW_PAIRS", few)
        a, b = draw.normal(0, 5, (draw.integers(1, 40), 2)), draw.normal(0, 5, (draw.integers(1, 40), 2))
        r, c, square = near_pairs(a, b, 1.5)
        every = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        assert sorted(zip(r.tolist(), c.tolist())) == [tuple(x) for x in np.argwhere(every < 1.5**2).tolist()] and np.allclose(square, every[r, c])
    linker = Linker(1.0, 0, 50)
    linker.step(1, np.zeros((8, 2)))
    with pytest.raises(ValueError, match="smaller reach"):
        linker.step(2, np.full((8, 2), 0.1))


def test_tracks_are_numbered_on_over_cuts(spark):
    from tracklark.operators import linking

    rows = [(1, "c", f, float(f), 0.0) for f in (1, 2, 3, 10, 11, 12)] + [(1, "c", f, 50.0, 50.0) for f in (2, 3, 10)] + [(2, "c", 1, 0.0, 0.0)]
    det = spark.createDataFrame(rows, "movie int, channel string, frame int, x double, y double")
    got = {(r.movie, r.frame, r.x): r.track_no for r in linking.link(det, 5.0, memory=2).collect()}
    assert len(got) == 10 and got[1, 1, 1.0] == got[1, 3, 3.0] == 1 and got[1, 2, 50.0] == got[1, 3, 50.0] == 2
    assert sorted({got[1, 10, 10.0], got[1, 10, 50.0]}) == [3, 4] and got[2, 1, 0.0] == 1
    assert {r.track_no for r in linking.link(det, 60.0, memory=6).where("x < 20 AND movie = 1").collect()} == {1}


def test_a_lost_particle_is_found_again_if_it_is_remembered():
    five = [(3.6, 5.0, 0), (15.1, 22.6, 0), (4.1, 5.5, 1), (15.9, 20.7, 2), (6.2, 4.3, 2)]
    tracks = lambda memory: sorted(g.frame.tolist() for _, g in linked(five, 5, memory).groupby("track_no"))
    assert tracks(2) == [[0, 1, 2], [0, 2]] and tracks(0) == [[0], [0, 1, 2], [2]]
