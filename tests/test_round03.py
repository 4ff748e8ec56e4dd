"""Small cases for the findings of the third round."""

from fractions import Fraction

import numpy as np

from tracklark.functions.delaunay import delaunay_edges
from tracklark.operators import features, linking


def test_places_on_a_line_in_decimals_are_on_a_line():
    # 0.15 lies between 0.05 and 0.25 on one line, but in doubles a hair beside it.
    points = np.array([(0.05, 63.0), (0.15, 43.0), (0.25, 23.0), (-30.0, 40.0)])
    assert (0, 2) in {tuple(e) for e in delaunay_edges(points).tolist()}
    assert (0, 2) not in {tuple(e) for e in delaunay_edges(points, linking.FLAT).tolist()}


def test_hull_area_with_three_places_nearly_on_a_line():
    points = [(0.11, 25.0), (0.3, 29.0), (2.2, 69.0), (122.19, 1.0), (253.51, 93.0), (19.66, 97.0)]
    ring = [points[k] for k in (0, 3, 4, 5, 2)]
    exact = sum(Fraction(a[0]) * Fraction(b[1]) - Fraction(b[0]) * Fraction(a[1]) for a, b in zip(ring, ring[1:] + ring[:1])) / 2
    assert abs(features.hull_area(np.array(points)) - float(exact)) < 1e-9


def test_overlap_labels_of_copies_nested_and_empty_boxes(spark):
    from tracklark.operators.spatial import overlap_labels

    rng = np.random.default_rng(3)
    boxes = [(int(k), float(t), float(l), float(t + h), float(l + w)) for k, (t, l, h, w) in enumerate(zip(*rng.integers(0, 40, (2, 60)), *rng.integers(0, 4, (2, 60))))]
    boxes += [(k + 100, *b) for k, *b in boxes[:30]]
    label = {b[0]: b[0] for b in boxes}
    for _ in boxes:
        for a, at, al, ab, ar in boxes:
            for b, bt, bl, bb, br in boxes:
                if a != b and at < bb and bt < ab and al < br and bl < ar:
                    label[a] = label[b] = min(label[a], label[b])
    rows = spark.createDataFrame([*boxes, (900, None, 1.0, 2.0, 3.0), (901, None, 1.0, 2.0, 3.0)], "id long, top double, left double, bottom double, right double")
    got = overlap_labels(rows, 3.0)
    assert sorted(map(tuple, got.collect())) == sorted({**label, 900: 900, 901: 901}.items())


def test_overlap_pairs_are_dealt_to_all_tasks(spark):
    from tracklark.operators.spatial import overlapping

    # Copies of few boxes are small in bytes, so merging by size would leave one task.
    rows = spark.range(600).selectExpr("id", "double(id % 30) * 10 AS top", "0D AS left", "double(id % 30) * 10 + 5 AS bottom", "2D AS right")
    found = overlapping(rows, 10.0, across=3.0)
    assert found.count() == 30 * 190
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_spots_of_a_batch_are_fitted_side_by_side():
    from tracklark.functions.kernels import centre, centres

    gy, gx = np.mgrid[0:5, 0:5]
    at = [(1.7, 2.3), (2.2, 1.9), (2.0, 2.4)]
    windows = np.stack([9 + 50 * np.exp(-((gx - x) ** 2) / 2.2 - (gy - y) ** 2 / 3.1) for y, x in at] + [np.full((5, 5), 7.0)])
    y, x, fitted = centres(windows)
    assert np.allclose(np.stack([y, x], axis=1)[:3], at, atol=1e-4) and fitted[:3].all() and (y[3], x[3]) == (2, 2)
    assert [centre(w)[:2] for w in windows] == [*zip(y.tolist(), x.tolist())]


def test_planes_of_one_file_are_dealt_to_all_tasks(spark, sf_dir):
    from tracklark.plans.images import planes

    assert planes(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_components_of_objects_within_and_across_batches(spark):
    from tracklark.operators.pixels import components

    rng = np.random.default_rng(5)
    rows = [(None if k == 3 else 2**60 + k, int(y), int(x)) for k in range(8) for y, x in zip(*np.nonzero(rng.random((9, 9)) < 0.55))]
    want = []
    for k in {r[0] for r in rows}:
        own = {r[1:] for r in rows if r[0] == k}
        while own:
            first = min(own)
            stack, found = [first], {first}
            while stack:
                y, x = stack.pop()
                for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if p in own - found:
                        found.add(p)
                        stack.append(p)
            own -= found
            want += [(k, *p, *first) for p in found]
    mask = spark.createDataFrame(rows, "img long, y int, x int")
    for size in ("10000", "7"):
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = [tuple(r) for r in components(mask).collect()]
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert sorted(got, key=str) == sorted(want, key=str)


def test_first_pixels_of_many_objects_at_once():
    from tracklark.functions.kernels import first_pixels

    y, x = np.array([0, 0, 1, 0, 2**40]), np.array([0, 1, 1, 0, 2**40])
    assert first_pixels(y[:4], x[:4], np.array([0, 0, 0, 1])).tolist() == [0, 0, 0, 3]
    assert first_pixels(y, x, np.array([0, 0, 1, 2, 2])).tolist() == [0, 0, 2, 3, 4]


def test_tracks_that_share_spots_list_no_pairs(spark):
    from tests.test_tracks import plain_follow

    rng = np.random.default_rng(8)
    spots = [(int(f), float(x), float(y)) for f, x, y in zip(rng.integers(0, 6, 900), *rng.integers(0, 90, (2, 900)))]
    reference = {(int(t), int(f)): (float(x), float(y)) for t, f, x, y in zip(rng.integers(0, 40, 90), rng.integers(0, 8, 90), *rng.integers(0, 90, (2, 90)))}
    # Numbers that doubles do not hold.
    reference = [(2**60 + t, f, *v) for (t, f), v in reference.items()]
    odd = spark.createDataFrame([*spots, (None, 1.0, 1.0), (1, float("nan"), 1.0), (1, None, 1.0)], "frame int, x double, y double")
    got = linking.follow_reference(odd, spark.createDataFrame([*reference, (None, 1, 5.0, 5.0)], "track_id long, frame int, rx double, ry double"), 20.0, 30.0)
    assert sorted(map(tuple, got.collect())) == plain_follow(spots, reference, 20.0, 30.0)
    # No pairs of tracks and spots are joined: what is dealt out is spots times walks.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "_gx" not in plan


def test_tied_copies_are_matched_in_one_round(spark, monkeypatch):
    from tracklark.operators import matching

    written = []
    monkeypatch.setattr(matching, "materialize", lambda df, f=matching.materialize: (written.append(1), f(df))[1])
    rows = [("a", r, c, float((r // 30 - c // 30) % 2)) for r in range(60) for c in range(60)] + [("a", 99, c, 7.0) for c in (3, 70)]
    got = matching.greedy_matches(spark.createDataFrame(rows, "channel string, ref long, cand long, mean_distance double"))
    refs, cands, want = set(), set(), []
    for _, r, c, d in sorted(rows, key=lambda t: (t[3], t[1], t[2])):
        if r not in refs and c not in cands:
            want.append(("a", r, c, d))
            refs.add(r), cands.add(c)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # Pair by pair it takes thirty rounds.
    assert len(written) < 20


def test_nearest_matches_are_those_of_all_scores(spark):
    from tracklark.operators import matching

    rng = np.random.default_rng(4)
    draw = lambda n, side: spark.createDataFrame([(str(t % 2), int(f), int(t), None if x == 3 else float(x), float(y)) for t, f, x, y in zip(rng.integers(0, n, 300), rng.integers(0, 40, 300), *rng.integers(0, 60, (2, 300)))], f"channel string, frame int, {side} long, x double, y double").dropDuplicates(["channel", "frame", side]).persist()
    refs, cands = draw(30, "ref"), draw(60, "cand")
    got = matching.nearest_matches(refs, cands, 2, few_pairs=0)
    want = matching.greedy_matches(matching.shared_frame_scores(refs, cands, 2))
    assert sorted(map(tuple, got.select("channel", "ref", "cand", "shared").collect())) == sorted(map(tuple, want.select("channel", "ref", "cand", "shared").collect()))


def test_hulls_of_many_tracks_are_passed_on(spark):
    rows = spark.range(0, 50_000, 1, 1).selectExpr("id % 25000 AS track_id", "double(id % 7) AS x", "double(id % 5) AS y")
    # A task holds 20,000 points, so no track's second point meets its first.
    assert features.partial_hulls(rows).count() == 50_000


def test_series_go_to_python_as_arrays_without_nulls(spark):
    steps = [(k, 1.0, 0.5, 1.0 + k % 3, None if k == 4 else k % 5 / 5.0) for k in range(12)]
    rows = spark.createDataFrame([(1, steps)], "track_id long, s array<struct<frame: int, dx: double, dy: double, step: double, angle: double>>")
    found = rows.select(features.of_series(features.FITS, features.fits_of)("s").alias("f"))
    want = features.fits_of(*(np.array([t[k] for t in steps if t[k] is not None]) for k in (1, 2, 3, 4)))
    assert np.allclose(np.array(found.first().f, float), np.array(want, float), equal_nan=True)
    assert "filter(s" in found._jdf.queryExecution().executedPlan().toString()


def test_planes_go_to_python_in_few_bytes(spark):
    from tracklark.operators.pixels import per_plane

    rows = spark.range(0, 2000, 1, 1).selectExpr("id AS stack_id", "0 AS t", "24 AS h", "24 AS w", "cast(repeat('01234567', 576) AS binary) AS px")
    got = per_plane(rows, lambda image: [(0,)], "batch long", finish=lambda found: [(*r[:-1], len(found)) for r in found])
    assert got.count() == 2000 and got.agg({"batch": "max"}).first()[0] * 24 * 24 * 8 < 6 << 20


def test_counted_assignment_stands_for_all_copies():
    from tracklark.functions.assignment import assign, assign_counts

    draw = np.random.default_rng(21)
    for _ in range(300):
        n, m = draw.integers(1, 6, 2)
        known, supply, room = draw.random((n, m)) < 0.6, draw.integers(1, 4, n), draw.integers(1, 4, m)
        cost = np.where(known, draw.integers(0, 8, (n, m)), 0).astype(float)
        rows, columns = np.nonzero(known)
        alone = 5.0 if draw.random() < 0.5 else None
        taken, price = assign_counts(rows.tolist(), columns.tolist(), cost[rows, columns].tolist(), supply.tolist(), room.tolist(), alone)
        wide, r, c = alone or 1e4, np.repeat(np.arange(n), supply), np.repeat(np.arange(m), room)
        full = np.hstack([np.where(known[r][:, c], cost[r][:, c], 1e6), np.full((len(r), len(r)), wide)])
        got = sum(cost[rows[k], columns[k]] * a for k, a in taken) + wide * (len(r) - sum(a for _, a in taken))
        assert abs(got - sum(full[i, j] for i, j in assign(full))) < 1e-6
        assert len(price) == n and all(sum(a for k, a in taken if rows[k] == i) <= supply[i] for i in range(n))


def test_a_frame_of_many_copies_is_linked_at_once():
    # 3,000 tracks and 3,000 points at few places: the matrix of all pairs had 18 million costs, more than was allowed.
    places = np.array([(0.0, 0.0), (3.0, 0.0), (30.0, 0.0)])
    linker = linking.Linker(5.0)
    before = linker.step(1, places.repeat(1000, axis=0))
    after = linker.step(2, (places + [1.0, 0.0]).repeat(1000, axis=0))
    assert (np.sort(before.reshape(3, -1)) == np.sort(after.reshape(3, -1))).all()


def test_dense_frames_are_linked_at_the_least_cost(monkeypatch):
    from tracklark.functions.assignment import assign

    monkeypatch.setattr(linking, "FEW_PAIRS", 100)
    draw = np.random.default_rng(22)
    for _ in range(20):
        old, new = draw.exponential(10, (60, 2)), draw.exponential(10, (40, 2))
        linker = linking.Linker(8.0)
        linker.step(1, old)
        names = linker.step(2, new)
        square = ((old[:, None] - new[None]) ** 2).sum(axis=2)
        cost = np.hstack([np.where(square < 64, square, 1e6), np.full((60, 60), 64.0)])
        got = sum(square[t, k] for k, t in enumerate(names) if t < 60) + 64.0 * (60 - sum(t < 60 for t in names))
        assert abs(got - sum(cost[r, c] for r, c in assign(cost))) < 1e-6


def test_scores_by_blocks_equal_the_join_and_shuffle_no_pairs(spark, monkeypatch):
    from tracklark.operators import matching

    draw = np.random.default_rng(23)
    side = lambda n: [(str(draw.choice(["a", "b"])), f"t{draw.integers(0, n)}" if draw.random() < 0.97 else None, int(draw.integers(1, 15)), float(draw.integers(0, 9)) if draw.random() < 0.9 else None, float(draw.integers(0, 9))) for _ in range(400)]
    refs = spark.createDataFrame([*side(12), ("only", "r", 1, 0.0, 0.0)], "channel string, ref string, frame int, x double, y double")
    cands = spark.createDataFrame([*side(40), (None, "c", 1, 0.0, 0.0)], "channel string, cand string, frame int, x double, y double")
    rows = lambda df: sorted(((r.channel, r.ref or "", r.cand or "", r.shared, None if r.mean_distance is None else round(r.mean_distance, 9)) for r in df.collect()), key=str)
    want = rows(matching.scored(refs, cands, 2, ("channel", "frame")))
    assert len(want) > 200
    for held, pairs, fewest in ((10**6, 10**6, 10**6), (150, 100, 500), (60, 7, 40)):
        for name, value in (("HELD_ROWS", held), ("PAIRS", pairs), ("LEAST_PAIRS", fewest)):
            monkeypatch.setattr(matching, name, value)
        assert rows(matching.shared_frame_scores(refs, cands, 2)) == want
    plan = matching.shared_frame_scores(refs, cands, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    # The nearest of each reference and block.
    near = matching.shared_frame_scores(refs, cands, 2, nearest=3).collect()
    by = {}
    for c, r, _, _, d in want:
        by.setdefault((c, r), []).append(d)
    for (c, r), all_of in by.items():
        known = sorted(d for d in all_of if d is not None)[:3]
        assert sorted(round(n.mean_distance, 9) for n in near if (n.channel, n.ref or "") == (c, r))[:3] == known


def test_optimal_matches_of_tracks_and_copies_over_growing_lists(spark):
    from tracklark.operators import matching

    draw = np.random.default_rng(24)
    track = lambda k, n: [(str(k % 2), k, int(f), float(draw.integers(0, 60)), float(draw.integers(0, 60))) for f in draw.choice(9, n, replace=False)]
    refs = [r for k in range(14) for r in track(k, 5)]
    cands = [r for k in range(20) for r in track(k, 5)]
    # Copies, more of the references than of the candidates, and a reference that shares no frame with any.
    refs += [(c, k + 100 * n, *rest) for c, k, *rest in refs for n in (1, 2) if k < 8] + [("0", 999, 50, 1.0, 1.0)]
    cands += [(c, k + 100, *rest) for c, k, *rest in cands if k < 6]
    refs = spark.createDataFrame(refs, "channel string, ref int, frame int, x double, y double")
    cands = spark.createDataFrame(cands, "channel string, cand int, frame int, x double, y double")
    scores = matching.shared_frame_scores(refs, cands, 3)
    want = matching.optimal_matches(scores, 1e9).collect()
    got = matching.optimal_track_matches(refs, cands, 3, 1e9, nearest=1)
    assert got.columns == scores.columns
    got = got.collect()
    assert len(got) == len(want) == len({(r.channel, r.ref) for r in got}) == len({(r.channel, r.cand) for r in got}) > 20
    assert abs(sum(r.mean_distance for r in got) - sum(r.mean_distance for r in want)) < 1e-9
    real = {(r.channel, r.ref, r.cand): (r.shared, round(r.mean_distance, 9)) for r in scores.collect()}
    assert all(real[r.channel, r.ref, r.cand] == (r.shared, round(r.mean_distance, 9)) for r in got)


def test_neighbours_look_at_each_pair_once(spark):
    from tracklark.operators.spatial import neighbours

    draw = np.random.default_rng(25)
    places = np.round(draw.uniform(-3, 3, (250, 2)), 1)
    rows = [(int(k), float(x), float(y)) for k, (x, y) in enumerate(places)] + [(900, 0.0, None), (901, None, 0.0)]
    found = neighbours(spark.createDataFrame(rows, "id long, x double, y double"), 0.5)
    got = sorted((r.a, r.b, r.distance) for r in found.collect())
    d = np.sqrt(((places[:, None] - places[None]) ** 2).sum(axis=2))
    assert got == sorted((a, b, float(d[a, b])) for a in range(250) for b in range(a + 1, 250) if d[a, b] <= 0.5)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_quick_round_equals_round(spark):
    from pyspark.sql import functions as F

    from tracklark.functions.expressions import quick_round

    draw = np.random.default_rng(26)
    values = [*draw.uniform(-2, 2, 3000), *(np.arange(-400, 400) / 20000), *np.nextafter(np.arange(400) / 20000, 1), 1e300, -1e7, 0.0, -0.0, -1e-9, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").select(quick_round(F.col("v")).alias("a"), F.round("v", 4).alias("b")).collect()
    assert [repr(r.a) for r in rows] == [repr(r.b) for r in rows]


def test_many_small_stacks_are_few_tasks(tmp_path, monkeypatch):
    from tracklark.sources import stacks

    for k in range(30):
        with open(tmp_path / f"s{k:02d}.tif", "wb") as handle:
            out = stacks.TiffOut(handle, stacks.NONE)
            for t in range(3):
                out.add(np.full((4, 4), 10.0 * k + t), None)
            out.close()
    for name, value in (("PLANNED", 10), ("TASKS", 4)):
        monkeypatch.setattr(stacks, name, value)
    reader = stacks.StackReader(str(tmp_path), 1 << 20)
    parts = reader.partitions()
    assert 4 <= len(parts) <= 8
    rows = [(r[0].rsplit("/", 1)[-1], r[1], float(np.frombuffer(r[4], "<f8")[0])) for p in parts for r in reader.read(p)]
    assert sorted(rows) == [(f"s{k:02d}.tif", t, 10.0 * k + t) for k in range(30) for t in range(3)]


def test_crops_are_joined_in_all_tasks(spark):
    from tracklark.operators.regions import crops

    pixels = spark.range(64 * 6).selectExpr("id div 64 AS fov", "int(id % 64 div 8) AS y", "id % 8 AS x", "double(id) AS v")
    masks = spark.createDataFrame([(f, o, 2 + o, 2 + o) for f in range(6) for o in range(2)], "fov long, obj long, y int, x long")
    found = crops(pixels, masks, 8, 8, 1)
    assert found.count() == 6 * 2 * 9 and found.where("v = 0 AND NOT (y = 0 AND x = 0)").count() == 6 * 2
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
