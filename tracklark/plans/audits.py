"""Queries on audits, summaries, listings, metadata texts and mask discovery."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.functions import expressions as E
from tracklark.operators import matching, steps, tables
from tracklark.plans.registry import HOURLY, POINTS, hourly, points, query, rounded
from tracklark.session import scratch_dir, table
from tracklark.sources import masks, tracks
from tracklark.streaming import events, summary

_CHANNELS = """c AS (SELECT DISTINCT event_type AS channel, upper(substr(event_type, 1, 1)) AS marker, length(event_type) AS raw_index FROM events)"""


@query(
    f"""WITH {HOURLY}, {_CHANNELS}, p AS (SELECT track_id % 4 AS allele, channel, track_id AS cand, frame, 'x/traj' || track_id || '.csv' AS file, x * 108 / 108.0 - 1 AS x, y * 54 / 108.0 - 1 AS y FROM h),
g AS (SELECT *, frame - lag(frame) OVER w AS gap, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step,
  round_even(y, 0) BETWEEN 0 AND 39 AND round_even(x, 0) BETWEEN allele * 10 AND allele * 10 + 39 AS inside FROM p WINDOW w AS (PARTITION BY allele, channel, cand ORDER BY frame))
SELECT allele, channel, cand, marker, raw_index, any_value(file) AS file, cand AS number, count(*) AS points, min(frame) AS first_frame, max(frame) AS last_frame, max(frame) - min(frame) + 1 AS frame_span,
  round(count(*) / (max(frame) - min(frame) + 1), 4) AS temporal_coverage, coalesce(max(gap - 1), 0) AS max_missing, round(coalesce(median(step), 0), 4) AS median_step, round(coalesce(quantile_cont(step, 0.95), 0), 4) AS p95_step,
  round(avg(CASE WHEN inside THEN 1.0 ELSE 0 END), 4) AS inside_fraction FROM g JOIN c USING (channel) GROUP BY ALL"""
)
def profile_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands = hourly(spark, sf_dir).select((F.col("track_id") % 4).alias("allele"), "channel", F.col("track_id").alias("cand"), "frame", F.concat(F.lit("x/traj"), "track_id", F.lit(".csv")).alias("file"), (F.col("x") * 108).alias("x_nm"), (F.col("y") * 54).alias("y_nm"))
    roi = spark.range(4).select(F.col("id").alias("allele"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("y")).select("allele", "y", F.explode(F.sequence(F.col("allele") * 10, F.col("allele") * 10 + 39)).alias("x"))
    profile = table(spark, sf_dir, "events").select(F.col("event_type").alias("channel")).distinct().select("channel", F.upper(F.substring("channel", 1, 1)).alias("marker"), F.length("channel").alias("raw_index"))
    return rounded(matching.profile_audit(cands, roi, profile, 108.0))


@query(
    f"""WITH {POINTS}, f AS (SELECT *, sqrt(pow(x - first_value(x) OVER w, 2) + pow(y - first_value(y) OVER w, 2)) AS away FROM p WINDOW w AS (PARTITION BY track_id ORDER BY frame))
SELECT track_id, count(*) AS points, min(frame) AS frame_start, max(frame) AS frame_end, round(arg_min(x, frame), 4) AS start_x, round(arg_min(y, frame), 4) AS start_y, round(arg_max(x, frame), 4) AS end_x, round(arg_max(y, frame), 4) AS end_y,
round(arg_max(away, frame), 4) AS net_displacement, round(max(away), 4) AS max_displacement FROM f GROUP BY track_id"""
)
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(steps.summary(points(spark, sf_dir)))


@query("SELECT p_partkey, p_brand, p_size >= 25 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS emphasis FROM part")
def emphasis_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    chosen = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).join(p.where("p_size >= 25"), "p_partkey")
    return matching.with_emphasis(p.drop("p_size"), chosen, ("p_partkey",))


@query("SELECT o_orderkey, s AS l_suppkey FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS s FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey")
def first_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimension = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", F.struct("l_linenumber", "l_suppkey").alias("at"))
    return tables.first_lookup(table(spark, sf_dir, "orders").select("o_orderkey"), dimension, "o_orderkey", "l_suppkey", "at")


@query(
    """WITH f AS (SELECT p_partkey, p_brand, 'loci' || p_partkey AS name FROM part) SELECT p_partkey, p_brand, name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS numeric_place,
CAST(row_number() OVER (PARTITION BY p_brand ORDER BY name) AS INTEGER) AS text_place FROM f"""
)
def locus_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    f = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(F.lit("loci"), "p_partkey").alias("name"))
    place = lambda c: F.row_number().over(Window.partitionBy("p_brand").orderBy(c))
    return f.withColumns({"numeric_place": place(E.number_in(F.col("name"), tracks.LOCUS)), "text_place": place("name")})


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ordinal FROM orders")
def restored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("price"))
    return tables.numbered(o, "price", "o_orderkey").select("o_orderkey", "ordinal")


@query("SELECT p_partkey, CASE WHEN NOT p_size > 5 THEN 'small' WHEN NOT p_type LIKE '%BRASS%' AND p_size > 45 THEN 'metal' END AS reason, p_size > 5 AND (p_type LIKE '%BRASS%' OR p_size <= 45) AS accepted FROM part")
def dry_run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("small", F.col("p_size") > 5), ("metal", F.contains("p_type", F.lit("BRASS")) | (F.col("p_size") <= 45))]
    return tables.dry_run(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type"), rules).select("p_partkey", "reason", "accepted")


@query("SELECT o_orderkey, count(*) OVER w AS done, count(*) FILTER (o_orderstatus = 'F') OVER w AS failures FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def running_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return tables.running_summary(o, ("o_custkey",), ("o_orderdate", "o_orderkey"), F.col("o_orderstatus") == "F").select("o_orderkey", "done", "failures")


@query("SELECT o_orderstatus, count(*) AS units, CAST(max(o_orderdate) AS VARCHAR) AS latest FROM orders GROUP BY ALL")
def streamed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of all orders' last completions, kept up to date by a stream over the table's files."""
    path = f"{scratch_dir(spark)}/summary-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    # The table is a file or a folder of files.
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/orders.parquet*")
    run = summary.start(stream, f"{path}/units", f"{path}/state", "o_orderkey", "o_orderdate", availableNow=True)
    run.awaitTermination()
    if not summary.versions(spark, f"{path}/units"):
        summary.kept(rows.limit(0), 0, f"{path}/units", "o_orderkey", "o_orderdate")
    units = summary.current(spark, f"{path}/units")
    return units.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("units"), F.max("o_orderdate").cast("string").alias("latest"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE NOT (l_quantity <= 25 AND l_discount <= 0.05) GROUP BY ALL")
def all_null_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("q"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).otherwise(float("nan")).alias("d"))  # noqa: E741
    return tables.without_empty(l, ["q", "d"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%'")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.with_prefix(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "Brand#1")


@query("SELECT l_orderkey, l_linenumber, l_quantity, round_even(l_quantity / 8, 2) AS two, round_even(l_quantity / 2, 0) AS whole FROM lineitem")
def half_even_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", E.half_even(F.col("l_quantity") / 8, 2).alias("two"), E.half_even(F.col("l_quantity") / 2).alias("whole"))


_TEXT = """(SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'no interval' ELSE 'a finterval=' || p_size || '.5e-1 b' END || ' Plane #1: Exposure: ' || p_size || ' ms, Plane #2: Exposure: ' || p_partkey || '.5 s; Plane #3: none' AS text FROM part)"""


@query(
    f"""SELECT p_partkey, try_cast(nullif(regexp_extract(text, 'finterval=([0-9.eE+\\-]+)', 1), '') AS DOUBLE) AS interval_s, CAST(regexp_extract(text, '#1: Exposure: (\\d+) ms', 1) AS DOUBLE) AS first_ms,
CAST(regexp_extract(text, '#2: Exposure: ([\\d.]+) s', 1) AS DOUBLE) * 1000 AS second_ms, CAST(NULL AS DOUBLE) AS third_ms, CAST(4 AS INTEGER) AS planes FROM {_TEXT}"""
)
def metadata_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    interval = F.when(F.col("p_size") % 3 == 0, "no interval").otherwise(F.concat(F.lit("a finterval="), "p_size", F.lit(".5e-1 b")))
    text = F.concat(interval, F.lit(" Plane #1: Exposure: "), "p_size", F.lit(" ms, Plane #2: Exposure: "), "p_partkey", F.lit(".5 s; Plane #3: none"))
    found = p.select("p_partkey", E.frame_interval(text).alias("interval_s"), E.exposures_ms(text, 4).alias("e"))
    return found.select("p_partkey", "interval_s", F.col("e")[0].alias("first_ms"), F.col("e")[1].alias("second_ms"), F.col("e")[2].alias("third_ms"), F.size("e").alias("planes"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '0') AS k, coalesce(json_extract_string(props, '$.none'), 'default') AS other FROM events")
def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", E.json_or(props, "$.k", F.lit("0")).alias("k"), E.json_or(props, "$.none", F.lit("default")).alias("other"))


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS finished, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, 3) AS duration_s FROM events GROUP BY ALL")
def run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return e.select("user_id", E.iso_text(F.col("a")).alias("started"), E.iso_text(F.col("b")).alias("finished"), F.round(E.elapsed_seconds(F.col("a"), F.col("b")), 3).alias("duration_s"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_extendedprice > 1000 THEN l_extendedprice / 1000 ELSE l_extendedprice END AS exposure_s FROM lineitem")
def exposure_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", E.seconds(F.col("l_extendedprice")).alias("exposure_s"))


@query(
    """WITH u AS (SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN 'micron' WHEN 1 THEN '\\u00B5m' WHEN 2 THEN 'nm' WHEN 3 THEN 'cm' WHEN 4 THEN 'inch' END AS unit, p_size % 4 AS ru FROM part)
SELECT p_partkey, round(CASE p_partkey % 6 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN p_size * 1000.0 WHEN 2 THEN p_size WHEN 3 THEN p_size * 1e7 ELSE CASE ru WHEN 3 THEN 1e7 WHEN 2 THEN 2.54e7 WHEN 1 THEN 1e3 END / p_size END, 4)::DOUBLE AS nm FROM u"""
)
def pixel_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 6
    unit = F.when(k == 0, "micron").when(k == 1, "\\u00B5m").when(k == 2, "nm").when(k == 3, "cm").when(k == 4, "inch")
    size = F.col("p_size").cast("double")
    return rounded(p.select("p_partkey", E.pixel_nm(unit, size, F.col("p_size") % 4, size).alias("nm")))


_FILES = """(SELECT p_partkey AS k, '/data/' || CASE WHEN p_size % 5 = 0 THEN 'other' ELSE 'all nd2 ' || p_size % 3 END || '/exp' || p_size || '/s_' || p_partkey AS stem FROM part)"""
_LISTED = f"(SELECT k, stem || '_mask_' || k % 7 || '.tif' AS file FROM {_FILES} UNION ALL SELECT k, stem || '_' || k % 7 || '_metadata.json' FROM {_FILES} WHERE k % 2 = 0 UNION ALL SELECT k, stem || '_' || k % 7 || '.tif' FROM {_FILES})"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("p_size") % 5 == 0, "other").otherwise(F.concat(F.lit("all nd2 "), F.col("p_size") % 3))
    stem = F.concat(F.lit("/data/"), folder, F.lit("/exp"), "p_size", F.lit("/s_"), "p_partkey")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), stem.alias("stem"))
    n = (F.col("k") % 7).cast("string")
    listed = p.select("k", F.concat("stem", F.lit("_mask_"), n, F.lit(".tif")).alias("file"))
    listed = listed.unionByName(p.where("k % 2 = 0").select("k", F.concat("stem", F.lit("_"), n, F.lit("_metadata.json")).alias("file")))
    return listed.unionByName(p.select("k", F.concat("stem", F.lit("_"), n, F.lit(".tif")).alias("file")))


@query(
    f"""SELECT stem || '_mask_' || k % 7 || '.tif' AS file, regexp_extract(stem, '/data/([^/]*)', 1) AS nd2_set, regexp_extract(stem, '(exp\\d+)', 1) AS experiment, 's_' || k AS stem, CAST(k % 7 AS INTEGER) AS nucleus_idx,
CASE WHEN k % 2 = 0 THEN stem || '_' || k % 7 || '_metadata.json' END AS metadata FROM {_FILES} WHERE NOT stem LIKE '/data/other%'"""
)
def mask_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.mask_files(_files(spark, sf_dir).select("file"))


@query(
    f"""SELECT c.file, CASE k % 4 WHEN 0 THEN f.stem || '_mask_' || k % 7 || '.tif' WHEN 1 THEN regexp_replace(f.stem, '/[^/]*$', '') || '/s_' || k || '_mask_' || k % 7 || '.tif' ELSE f.stem || '_mask_' || k % 7 || '.tif' END AS mask,
CAST(CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS INTEGER) AS source FROM {_FILES} f JOIN (SELECT k, file FROM {_LISTED} WHERE file NOT LIKE '%mask%' AND file LIKE '%.tif') c USING (k)"""
)
def crop_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _files(spark, sf_dir)
    crops = listed.where("file LIKE '%.tif' AND file NOT LIKE '%mask%'")
    mask = F.regexp_replace("file", r"_(\d+)\.tif$", "_mask_$1.tif")
    k = F.col("k") % 4
    sidecars = crops.where("k % 4 <> 3").select(
        F.regexp_replace("file", r"\.tif$", "_metadata.json").alias("file"),
        F.when(k == 0, mask).when(k == 2, "/nowhere.tif").alias("path"),
        F.when(k == 1, E.matched(mask, r"([^/]+)$")).alias("relative_path"),
        F.when(k == 2, F.concat(F.lit("s_"), "k")).alias("stem"),
        (F.col("k") % 7).cast("int").alias("crop_index"),
    )
    return masks.masks_of_crops(crops, listed, sidecars)


@query(
    """WITH m AS (SELECT l_orderkey AS file, l_linenumber AS channel, min(l_quantity - 2) AS interval_, min(l_discount + 0.01) AS um, CASE WHEN min(l_tax) > 0.07 THEN 'inch' ELSE 'Micron' END AS unit, min(l_suppkey % 2) AS frames FROM lineitem GROUP BY ALL),
f AS (SELECT *, first_value(interval_) OVER w AS i0, first_value(um) OVER w AS u0, first_value(frames) OVER w AS f0 FROM m WINDOW w AS (PARTITION BY file ORDER BY channel))
SELECT file, channel, CASE WHEN NOT interval_ > 0 THEN 'interval' WHEN unit = 'inch' THEN 'unit' WHEN interval_ <> i0 THEN 'same_interval' WHEN abs(um - u0) > 1e-9 THEN 'same_pixel' WHEN frames <> f0 THEN 'same_frames' END AS failure FROM f"""
)
def tracking_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("channel")).agg(
        F.min(F.col("l_quantity") - 2).alias("interval"), F.min(F.col("l_discount") + 0.01).alias("um_x"), F.when(F.min("l_tax") > 0.07, "inch").otherwise("Micron").alias("unit"), F.min(F.col("l_suppkey") % 2).alias("frames")
    )
    return tracks.tracking_failures(m.withColumn("um_y", F.col("um_x"))).select("file", "channel", "failure")


@query(
    """WITH f AS (SELECT '/a/' || p_size || '/' || upper(substr(p_brand, 7, 1)) || '_loci' || p_partkey % 9 || CASE p_partkey % 3 WHEN 0 THEN '_cleaned.csv' WHEN 1 THEN '_traj_1.csv' ELSE '.csv' END AS file, p_partkey % 3 AS r, p_size, upper(substr(p_brand, 7, 1)) AS channel, p_partkey % 9 AS locus FROM part)
SELECT DISTINCT ON (p_size, channel, locus) p_size, channel, CAST(locus AS INTEGER) AS locus, file FROM f ORDER BY p_size, channel, locus, r, file"""
)
def preferred_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    end = F.when(k == 0, "_cleaned.csv").when(k == 1, "_traj_1.csv").otherwise(".csv")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("/a/"), "p_size", F.lit("/"), F.upper(F.substring("p_brand", 7, 1)), F.lit("_loci"), F.col("p_partkey") % 9, end).alias("file"))
    found = tracks.preferred_files(p.distinct())
    return found.select(E.matched(F.col("file"), r"^/a/(\d+)").cast("int").alias("p_size"), "channel", "locus", "file")


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%dT%H:%M:%S') AS hour, event_type AS channel, count(*) AS points, round(avg(value), 4) AS mean_x FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), F.col("value").alias("x"))
    found = events.tumbling(e)
    return rounded(found.select(E.iso_text(F.col("window.start")).alias("hour"), "channel", "points", "mean_x"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id AS track_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL '6 hours', '%Y-%m-%dT%H:%M:%S') AS session_end, count(*) AS points FROM s GROUP BY user_id, k"""
)
def track_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("track_id"))
    found = events.sessions(e, gap="6 hours")
    return found.select("track_id", E.iso_text(F.col("session_start")).alias("session_start"), E.iso_text(F.col("session_end")).alias("session_end"), "points")
