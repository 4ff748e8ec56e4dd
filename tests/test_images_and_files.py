"""Kernels, pixel operators, sources, sinks and streams."""

import numpy as np
import pytest

from tracklark.functions import kernels as K
from tracklark.operators import linking, pixels, quality
from tracklark.plans.catalogue import QUERIES
from tracklark.sources import binary, sinks, tracks
from tracklark.streaming import events


def test_kernels():
    mask = np.zeros((9, 9), bool)
    mask[2:7, 2:7] = True
    mask[4, 4] = False
    assert K.fill_holes(mask).sum() == 25 and K.label(mask)[1] == 1 and K.dilate(mask, 1).sum() == 45
    assert (K.erode(K.fill_holes(mask)) == (np.pad(np.ones((3, 3), bool), 3))).all()
    assert K.distance(K.fill_holes(mask))[4, 4] == 3 and np.isinf(K.distance(np.ones((2, 2), bool))).all()
    two = np.zeros((5, 9), bool)
    two[1:4, 0:3] = two[1:4, 5:9] = True
    assert K.label(two)[1] == 2 and sorted(m.sum() for m in K.split_at_waist(two, 0.5, 2)) == [9, 12]
    image = np.random.default_rng(1).normal(0, 1, (32, 40))
    assert np.allclose(K.shift(image, K.moved(image, 3, -2)), (-3, 2), atol=0.2)
    gy, gx = np.mgrid[0:7, 0:7]
    assert np.allclose(K.centre(50 * np.exp(-((gx - 3.2) ** 2) / 3 - (gy - 2.7) ** 2 / 4) + 5)[:2], (2.7, 3.2), atol=1e-3)
    spot = np.zeros((21, 21))
    spot[8:12, 9:13] = 100
    assert len(K.peaks(K.bandpass(spot, 1, 3), 1, 3)) == 1
    assert abs(K.otsu(np.r_[np.zeros(50), np.ones(50) * 10]) - 5) < 5


def test_static_roi_is_one_component_and_needs_a_wide_dilation(spark):
    anchor = spark.createDataFrame([(1, 1, 10.0, 10.0), (1, 2, 12.0, 12.0), (1, 3, 12.0, 15.0)], "img long, frame int, y double, x double")
    support = pixels.scaffold(spark, 2, 40, 40).selectExpr("cast(t as long) img", "y", "x")
    roi = pixels.static_roi(anchor, support)
    found = pixels.components(roi)
    assert found.select("cy", "cx").distinct().count() == 1 and {(10, 10), (12, 15)} <= {(r.y, r.x) for r in roi.collect()}
    with pytest.raises(ValueError):
        pixels.static_roi(anchor, support, 4)


def test_static_roi_query_takes_all_tracks_and_frames(spark, tmp_path):
    rows = [(u, k, float(v)) for k, (u, v) in enumerate([(3, 0), (250, 2), (250, 30), (3, 39), (70000, 20)], 1)]
    spark.createDataFrame(rows, "user_id long, event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    paths = {3: pixels.line(0, 1, 39, 4), 250: pixels.line(2, 2, 30, 3), 70000: [(20, 5)]}
    want = {(u, y, x) for u, path in paths.items() for y in range(40) for x in range(40) if any(abs(y - a) + abs(x - b) <= 5 for a, b in path)}
    got = QUERIES["static_roi"](spark, str(tmp_path)).collect()
    assert {(r.img, r.y, r.x) for r in got} == want and len(got) == len(want)


def test_a_static_roi_in_two_pieces_is_refused(spark):
    anchor = spark.createDataFrame([(1, 1, 5.0, 5.0), (1, 2, 5.0, 30.0), (2, 1, 5.0, 5.0)], "img long, frame int, y double, x double")
    support = spark.createDataFrame([(y, x) for y in range(12) for x in range(40) if x not in range(14, 18)], "y int, x int")
    with pytest.raises(Exception, match="several components: 1"):
        pixels.static_roi(anchor, support).collect()
    free = pixels.static_roi(anchor, support, connected=False)
    assert {r.img for r in free.collect()} == {1, 2} and pixels.static_roi(anchor.where("img = 2"), support).count() == free.where("img = 2").count()


def test_image_queries_without_images_or_with_gaps(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(20)
    whole = [(r.vec_id, r.embedding, r.label) for r in e.collect()]
    odd = [(9000, None, 1), (9001, [None] + [1.0] * 63, 1), (9002, [1.0] * 7, 1), (9003, [], None)]
    names = ["detect_spots", "detect_nuclei", "bright_spots", "register_drift", "stack_spots"]
    for name, rows in (("none", []), ("odd", whole + odd), ("whole", whole)):
        spark.createDataFrame(rows, e.schema).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    for q in names:
        assert QUERIES[q](spark, f"{tmp_path}/none").count() == 0
        assert sorted(map(str, QUERIES[q](spark, f"{tmp_path}/odd").collect())) == sorted(map(str, QUERIES[q](spark, f"{tmp_path}/whole").collect()))


def test_batch_reports(spark):
    from pyspark.sql import functions as F

    from tracklark.operators import tables

    rows = [("a", 2, "complete", 5.0, 10.0, "2024-01-02", True), ("a", 1, "failed", 7.0, 0.0, "2024-01-03", None), ("a", 3, "running", 9.0, -1.0, "", False), ("a", 0, "failed", 1.0, 4.0, None, True), ("b", 9, "queued", None, None, None, None)]
    got = {r.fov: r for r in tables.full_roll_up(spark.createDataFrame(rows, "fov string, unit int, state string, value double, duration double, finished string, bad boolean"), ("fov",), "unit", "state", "value", "duration", "finished", F.col("bad")).collect()}
    a, b = got["a"], got["b"]
    assert (a.cells, a.complete, a.failed, a.running, a.flagged, a.value_sum, a.median_duration, a.total_duration, a.last_finished) == (4, 1, 2, 1, 2, 5.0, 7.0, 14.0, "2024-01-03")
    assert (a.failed_units, a.running_units, a.counts) == ([0, 1], [3], {"complete": 1, "failed": 2, "running": 1})
    assert (b.cells, b.complete, b.value_sum, b.median_duration, b.total_duration, b.last_finished, b.failed_units, b.counts) == (1, 0, 0.0, 0.0, 0.0, "", [], {"queued": 1})


def test_envelopes_equal_all_pairs():
    draw = np.random.default_rng(4)
    for _ in range(300):
        sites = np.sort(draw.choice(60, draw.integers(1, 20), replace=False))
        heights = draw.integers(0, draw.choice([3, 400]), len(sites)) ** 2
        at = draw.integers(-5, 65, 30)
        assert (pixels.least_squares_at(sites, heights, at) == ((at[:, None] - sites) ** 2 + heights).min(axis=1)).all()


def test_distances_of_wide_masks(spark):
    """Against all pairs on a small image with repeated pixels, and a large one for its time and known distances."""
    draw = np.random.default_rng(6)
    grid = draw.random((23, 31)) < 0.9
    rows = [(1, y, x) for y in range(23) for x in range(31)]
    frame = lambda some: spark.createDataFrame(some, "img int, y int, x int")
    inner, outer = [r for r in rows if grid[r[1:]]], [r for r in rows if not grid[r[1:]]]
    whole = [(2, y, x) for y in range(3) for x in range(3)]
    got = pixels.edge_distance(frame([*inner, *inner[:9], *whole]), frame(outer)).collect()
    by, bx = np.nonzero(~grid)
    assert {(r.img, r.y, r.x): r.distance for r in got} == {(1, y, x): np.sqrt(((by - y) ** 2 + (bx - x) ** 2).min()) for _, y, x in inner} and len(got) == len(inner)
    n = 800
    large = spark.range(n * n).selectExpr("1 AS img", f"CAST(id DIV {n} AS INT) AS y", f"CAST(id % {n} AS INT) AS x")
    edge = "y = 0 OR x = 0 OR (y = 500 AND x = 300)"
    found = pixels.edge_distance(large.where(f"NOT ({edge})"), large.where(edge))
    assert found.count() == n * n - 2 * n
    some = {(r.y, r.x): r.distance for r in found.where("(y, x) IN ((503, 304), (3, 700), (500, 120))").collect()}
    assert some == {(503, 304): 5.0, (3, 700): 3.0, (500, 120): 120.0}


def test_merged_and_deduplicated_masks(spark):
    square = lambda obj, y0, x0, n: [(1, obj, y, x) for y in range(y0, y0 + n) for x in range(x0, x0 + n)]
    masks = spark.createDataFrame(square(1, 0, 0, 4) + square(2, 0, 5, 4) + square(3, 30, 30, 3), "fov long, obj long, y int, x int")
    assert {r.obj for r in pixels.merged_masks(masks, 40).collect()} == {1, 3}
    over = spark.createDataFrame(square(1, 0, 0, 6) + square(2, 1, 1, 3) + square(3, 9, 9, 2), "fov long, obj long, y int, x int")
    assert {r.obj for r in pixels.deduplicated_masks(over).collect()} == {1, 3}


def test_quality_rules(spark):
    rows = spark.createDataFrame([(0.05, 1.0), (0.05, 2.0), (float("nan"), 1.0), (None, 1.0)], "ch0_contrast double, ch0_boundary_grad double")
    assert [r.bad_qc for r in quality.bad_qc(rows).collect()] == [True, False, False, False]
    with pytest.raises(ValueError, match="ch0_contrast"):
        quality.bad_qc(rows.drop("ch0_contrast"))


def test_track_files(spark, tmp_path):
    folder = tmp_path / "analysis_1"
    folder.mkdir()
    (folder / "G_loci3_traj_x.csv").write_bytes("﻿rame,x_nm,y_nm\r\n1,10.5,2\r\n3.0,1,1\r\n1,11.5,2\r\n".encode().replace(b"frame", b"frame"))
    (folder / "R part+1_m_traj12.csv").write_text("frame,x_nm,y_nm\n2,5,6\n")
    (folder / "nine.csv").write_text("id,frame,x,y,s,i,o,b,u\n1,4,7,8,0.5,100,1,2,3\n")
    got = tracks.read_tracks(spark, *map(str, folder.glob("*traj*.csv"))).orderBy("channel", "frame").collect()
    assert [(r.channel, r.locus, r.number, r.analysis, r.frame, r.x) for r in got] == [("G", 3, None, 1, 1, 11.5), ("G", 3, None, 1, 3, 1.0), ("R", None, 12, 1, 2, 5.0)]
    both = tracks.read_any_tracks(spark, [str(folder / "G_loci3_traj_x.csv")], [str(folder / "nine.csv")])
    assert both.where("sigma IS NOT NULL").count() == 1 and both.count() == 3
    files = spark.createDataFrame([("d/G_loci1_traj_a.csv",), ("d/G_loci1_traj_a_cleaned.csv",), ("d/R_loci1_old.csv",)], "file string")
    assert {r.file for r in tracks.preferred_files(files).collect()} == {"d/G_loci1_traj_a_cleaned.csv", "d/R_loci1_old.csv"}


def test_tracking_rules(spark):
    rows = [("a", 0, 1.0, 0.1, 0.1, "\\u00b5m", 30), ("a", 1, 1.0, 0.1, 0.1, "um", 30), ("b", 0, 1.0, 0.1, 0.1, "um", 30), ("b", 1, 2.0, 0.1, 0.1, "um", 30), ("c", 0, 1.0, 0.1, 0.2, "um", 30), ("d", 0, 1.0, 0.1, 0.1, "inch", 30)]
    got = {(r.file, r.channel): r.failure for r in tracks.tracking_failures(spark.createDataFrame(rows, "file string, channel int, interval double, um_x double, um_y double, unit string, frames int")).collect()}
    assert got == {("a", 0): None, ("a", 1): None, ("b", 0): None, ("b", 1): "same_interval", ("c", 0): "isotropic", ("d", 0): "unit"}


def test_binary_files(spark, tmp_path):
    import zipfile

    planes = [np.arange(12).reshape(3, 4), np.full((3, 4), 7)]
    (tmp_path / "s.tif").write_bytes(binary.tiff_bytes(planes, "ImageJ=1.53\nunit=um\nfinterval=1.5"))
    got = binary.read_stacks(spark, str(tmp_path / "s.tif")).orderBy("t").collect()
    assert [np.frombuffer(r.px, "<f8").reshape(r.h, r.w).tolist() for r in got] == [p.tolist() for p in planes] and "finterval=1.5" in got[0].description
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("one.roi", binary.roi_bytes(1, 2, 30, 40))
    assert [tuple(r)[1:] for r in binary.read_rois(spark, str(tmp_path / "r.zip")).collect()] == [("one.roi", 1, 2, 30, 40)]
    found = pixels.spots(binary.read_stacks(spark, str(tmp_path / "s.tif")).selectExpr("file AS stack_id", "t", "h", "w", "px"), size=1)
    assert found.columns == ["stack_id", "t", "y", "x", "mass", "fitted"] and found.count() >= 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "track_id int, v string")
    sinks.write_csv(df, str(tmp_path / "c"), ["v", "track_id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["v", "track_id"]
    sinks.write_by_entity(df, str(tmp_path / "e"), "track_id")
    sinks.write_by_entity(df.where("track_id = 1").selectExpr("track_id", "concat(v, '0') AS v"), str(tmp_path / "e"), "track_id")
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
    sinks.write_json(df, str(tmp_path / "j"))
    assert tracks.read_sidecars(spark, str(tmp_path / "j"), schema="track_id int, v string").count() >= 1
    assert sinks.key_union(df, df.withColumnRenamed("v", "w")).columns == ["track_id", "v", "w"]


def test_stream_linker_equals_the_batch(spark, tmp_path):
    draw = np.random.default_rng(2)
    rows = [(1, "G", f, *map(float, draw.uniform(0, 20, 2))) for f in range(1, 13) for _ in range(4) if f not in (5, 6)]
    kind = "movie long, channel string, frame int, x double, y double"
    for k, some in enumerate((rows[:16], rows[16:28], rows[28:])):
        spark.createDataFrame(some, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = events.linked_stream(stream, 6.0, 2).writeStream.format("memory").queryName("linked").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    streamed = spark.table("linked").toPandas().sort_values(["frame", "x"])
    batch = linking.linked(spark.createDataFrame(rows, kind).toPandas(), 6.0, 2, 1).sort_values(["frame", "x"])
    assert streamed.track_no.rank(method="dense").tolist() == batch.track_no.rank(method="dense").tolist()


def test_windows_on_streams_equal_the_batch(spark, sf_dir, tmp_path):
    from tracklark.session import table

    rows = table(spark, sf_dir, "events").selectExpr("user_id AS track_id", "event_type AS channel", "cast(ts AS timestamp) AS ts", "value AS x")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for f, mode in ((events.tumbling, "complete"), (events.sessions, "complete")):
        run = f(stream).writeStream.format("memory").queryName(f.__name__).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{f.__name__}").trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert spark.table(f.__name__).count() == f(rows).count()


def test_profiles(spark):
    from tracklark.operators import profiles

    dim = spark.createDataFrame([("one", "TCYX", [(0, "nucleus", "N", ["405"]), (1, "green", "G", ["488", "GFP"])], ["abc"], ["x1", "x2"])], profiles.PROFILE)
    crops = [("ABC_X2.tif", "one", "TCYX", 2, ["Em 405", "gfp"]), ("ABC_x2.tif", "one", "TYX", 2, ["405", "488"]), ("abc_x1", "one", "TCYX", 3, ["405", "488"]), ("abc_x1", "one", "TCYX", 2, ["488", "405"]), ("abc", "one", "TCYX", 2, ["405", "488"]), ("abc", "two", "TCYX", 2, None)]
    got = [r.failure for r in profiles.validated(spark.createDataFrame(crops, profiles.CROP), dim).collect()]
    assert sorted(map(str, got)) == sorted(["None", "axes", "channel count", "raw C0", "file tokens", "profile"])
    assert profiles.channel_rows(dim).count() == 2


def test_run_helpers(tmp_path):
    from tracklark.operators import runs

    (tmp_path / "log").write_text("a\nb\nc\n")
    assert runs.tail(str(tmp_path / "log"), 2) == ["b", "c"] and runs.disk_left(str(tmp_path), 1)
    once = runs.with_section("Report", "qc", "new")
    assert runs.with_section(once, "qc", "newer").count("qc:start") == 1 and "newer" in runs.with_section(once, "qc", "newer")


def test_floods_and_splits():
    gy, gx = np.mgrid[0:30, 0:60]
    bell = ((gy - 15) ** 2 + (gx - 18) ** 2 < 120) | ((gy - 15) ** 2 + (gx - 40) ** 2 < 160)
    halves = K.split_at_waist(bell, 1.0, 6)
    assert len(halves) == 2 and not (halves[0] & halves[1]).any() and (halves[0] | halves[1] == bell).all()
    # The cut runs through the waist, so each disc stays in one part.
    assert {bool(h[15, 18]) + 2 * bool(h[15, 40]) for h in halves} == {1, 2}
    assert len(K.split_at_waist(bell, 1.0, 6, least=200)) == 2 and K.split_at_waist(bell, 1.0, 6, least=450)[0].sum() == bell.sum()
    disc = (gy - 15) ** 2 + (gx - 30) ** 2 < 100
    assert len(K.split_at_waist(disc, 1.0, 25)) == 1
    height = np.array([[3.0, 1.0, 2.0], [3.0, 1.0, 2.0]])
    assert K.flood(height, [(0, 0), (0, 2)], np.ones((2, 3), bool)).tolist() == [[1, 2, 2], [1, 2, 2]] or K.flood(height, [(0, 0), (0, 2)], np.ones((2, 3), bool))[:, 0].tolist() == [1, 1]


def test_large_clusters_split_alone():
    """A large component that parts at a higher level is split although a small one stands on the same rows."""
    image = np.full((80, 100), 100.0)
    image[10:30, 20:50] = 160.0
    image[12:28, 22:33] = image[12:28, 38:49] = 420.0
    image[14:19, 3:8] = 300.0
    region = np.ones(image.shape, bool)
    found = K.split_clusters(image, region, 0.3, 200, 10, (1.0, 1.5, 2.0))
    assert sorted((round(y), round(x)) for y, x, _ in found) == [(16, 5), (20, 27), (20, 43)] and {k for *_, k in found} == {0.3, 1.0}
    assert len(K.split_clusters(image, region, 0.3, 10**6)) == 2
    # Nothing but fill at the border, and centres out of the region, are left out.
    image[:, :4] = 5.0
    assert not K.valid_mask(image)[:, :4].any() and K.valid_mask(image)[:, 8:].all()
    region[:, 20:] = False
    assert [x for _, x, _ in K.split_clusters(image, region, 0.3, 200)] == [pytest.approx(5.5, abs=1)]


def test_mask_lookups_and_listings(spark, tmp_path):
    import json

    from tracklark.sources import masks

    folder = tmp_path / "all nd2 files" / "exp 1"
    folder.mkdir(parents=True)
    for name in ("a_1.tif", "a_mask_1.tif", "b_2.tif", "c_mask_9.tif", "a_1_metadata.json"):
        (folder / name).write_text("{}")
    files = masks.paths(spark, str(tmp_path))
    assert files.count() == 5
    found = {r.stem: r for r in masks.mask_files(files).collect()}
    assert found["a"].nd2_set == "all nd2 files" and found["a"].experiment == "exp 1" and found["a"].metadata.endswith("a_1_metadata.json") and found["c"].metadata is None
    crops = files.where("file LIKE '%/a_1.tif' OR file LIKE '%/b_2.tif'")
    side = spark.createDataFrame([(f"file:{folder}/b_2_metadata.json", None, "c_mask_9.tif", None, None)], "file string, path string, relative_path string, stem string, crop_index int")
    side = side.withColumn("file", side.file)
    root = files.first().file.split("/all nd2")[0]
    side = spark.createDataFrame([(f"{root}/all nd2 files/exp 1/b_2_metadata.json", None, "c_mask_9.tif", None, None)], side.schema)
    got = {r.file.rsplit("/", 1)[1]: (r.mask.rsplit("/", 1)[1], r.source) for r in masks.masks_of_crops(crops, files, side).collect()}
    assert got == {"a_1.tif": ("a_mask_1.tif", 3), "b_2.tif": ("c_mask_9.tif", 1)} and json
    with pytest.raises(Exception, match="no mask for"):
        masks.masks_of_crops(crops, files, side.limit(0), fail=True).collect()


def test_model_columns_and_grids(spark):
    from tracklark.operators import model, tables

    df = spark.createDataFrame([(1, 2.0, 3.0)], "a int, b double, c double")
    assert tables.model_columns(df, ["a", "b", "c"], ["c", "d"]) == (["a", "b"], ["c"])
    with pytest.raises(ValueError, match="x, y"):
        tables.model_columns(df, ["a", "x", "y"], [])
    grid = model.elastic_grid()
    assert len(grid) == 60 and min(g["regParam"] for g in grid) == pytest.approx(1e-4) and max(g["regParam"] for g in grid) == pytest.approx(10)
    assert len(model.forest_grid()) == 8 and model.forest_grid() == model.forest_grid()
    rows = spark.range(5000).withColumnRenamed("id", "group")
    share = model.inner_holdout(rows, "group").where("is_validation").count() / 5000
    assert 0.07 < share < 0.13


def test_gates_and_levels_of_stacks(spark):
    gy, gx = np.mgrid[0:24, 0:24]
    image = 100 * np.exp(-((gy - 7) ** 2 + (gx - 7) ** 2) / 4) + 80 * np.exp(-((gy - 16) ** 2 + (gx - 16) ** 2) / 4)
    gate = (gx < 12).astype(np.uint8)
    rows = [(1, t, 24, 24, (image * (2 if t == 1 else 1)).astype("<f8").tobytes(), gate.tobytes()) for t in (1, 2)]
    planes = spark.createDataFrame(rows, "stack_id long, t int, h int, w int, px binary, gate binary")
    assert sorted((r.t, round(r.y), round(r.x)) for r in pixels.spots(planes.drop("gate")).collect()) == [(1, 7, 7), (1, 16, 16), (2, 7, 7), (2, 16, 16)]
    assert sorted((r.t, round(r.y), round(r.x)) for r in pixels.spots(planes).collect()) == [(1, 7, 7), (2, 7, 7)]
    clean = K.bandpass(2 * image, 1.0, 2)
    level = pixels.first_levels(planes).first().level
    assert level == pytest.approx(clean[clean > 0].mean() + 0.5 * clean[clean > 0].std(ddof=1))
    high = pixels.spots(planes.drop("gate").selectExpr("*", "1e9 AS level")).count()
    assert high == 0


def test_tracks_of_both_formats_and_pixels(spark, tmp_path):
    (tmp_path / "G_loci1_traj2.csv").write_bytes(b"\xef\xbb\xbfframe,x_nm,y_nm\r\n1,216.0,108.0\r\n2.0,1,2\r\n")
    (tmp_path / "R_loci3_traj4.csv").write_text("id,frame,x,y,sigma,intensity,offset,bkgstd,uncertainty\n1,5,10,20,1.5,300,0,0,7\n")
    got = sorted(tuple(r)[1:] for r in tracks.read_mixed_tracks(spark, str(tmp_path)).select("file", "channel", "locus", "number", "frame", "x", "y", "sigma", "uncertainty").collect())
    assert got == [("G", 1, 2, 1, 216.0, 108.0, None, None), ("G", 1, 2, 2, 1.0, 2.0, None, None), ("R", 3, 4, 5, 10.0, 20.0, 1.5, 7.0)]
    first = tracks.in_pixels(tracks.read_mixed_tracks(spark, str(tmp_path)).where("frame = 1"), 108.0).first()
    assert (first.x, first.y) == (1.0, 0.0)


def test_rois_of_several_components_are_refused(spark):
    from tracklark.operators import regions

    rows = [(1, 0, 0), (1, 0, 1), (1, 1, 1), (2, 5, 5)]
    whole = spark.createDataFrame(rows, "img int, y int, x int")
    assert sorted(map(tuple, regions.require_connected(whole).collect())) == rows
    with pytest.raises(Exception, match="several components: 2"):
        regions.require_connected(whole.union(spark.createDataFrame([(2, 7, 5)], whole.schema))).collect()
