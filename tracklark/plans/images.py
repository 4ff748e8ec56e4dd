"""Queries on pixel tables. The embeddings serve as images of 8 x 8 pixels with whole-number values."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.operators import pixels as P
from tracklark.operators.linking import spread
from tracklark.plans.registry import query, rounded
from tracklark.session import scratch_dir, table
from tracklark.sources import stacks


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, y, x, v."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("k", "e"))
    return e.select("img", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).alias("x"), F.floor(F.col("e").cast("double") * 1000).cast("double").alias("v"))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of 24 x 24 pixels: the image enlarged three times, values above zero. Images without all their pixels are
    left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A plane has 18 times an image's bytes, so few at a time.
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            small = batch.column(1).flatten().to_numpy().astype(float).reshape(-1, 8, 8)
            big = np.maximum(small, 0).repeat(3, axis=1).repeat(3, axis=2) * 1000
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.astype("<f8").tobytes() for p in big], pa.binary())], names=["stack_id", "px"])

    whole = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull())
    # Dealt out while they are small: a file of vectors is one task's, but their planes take long to compute.
    rows = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where(whole), "vec_id").mapInArrow(run, "stack_id long, px binary")
    return rows.select("stack_id", (F.col("stack_id") % 10).cast("int").alias("t"), F.lit(24).alias("h"), F.lit(24).alias("w"), "px")


IMAGES = "i AS (SELECT vec_id AS img, CAST(k // 8 AS INTEGER) AS y, CAST(k % 8 AS INTEGER) AS x, floor(CAST(embedding[k + 1] AS DOUBLE) * 1000) AS v FROM embeddings, unnest(range(0, 64)) AS t(k))"
MASK = IMAGES + ", m AS (SELECT img, y, x FROM i WHERE v > 20)"


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).where("v > 20").select("img", "y", "x")


@query(
    f"""WITH {MASK}, a AS (SELECT m.img, m.y, m.x, r.x AS r, d.y AS d FROM m LEFT JOIN m r ON r.img = m.img AND r.y = m.y AND r.x = m.x + 1 LEFT JOIN m d ON d.img = m.img AND d.y = m.y + 1 AND d.x = m.x),
g AS (SELECT img, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS r0, max(y) + 1 AS r1, min(x) AS c0, max(x) + 1 AS c1, 4 * count(*) - 2 * (count(r) + count(d)) AS perimeter,
  var_pop(x) + 1.0 / 12 AS a, var_pop(y) + 1.0 / 12 AS b, covar_pop(x, y) AS c FROM a GROUP BY img),
f AS (SELECT *, (a + b + sqrt(4 * c * c + (a - b) * (a - b))) / 2 AS l1, greatest(0.0, (a + b - sqrt(4 * c * c + (a - b) * (a - b))) / 2) AS l2 FROM g)
SELECT img, area, round(cy, 4) AS cy, round(cx, 4) AS cx, r0, r1, c0, c1, perimeter, round(area * 0.25, 4)::DOUBLE AS area_um2, round(least(1.0, {4 * pi!r} * area / (perimeter * perimeter)), 4) AS circularity,
round(4 * sqrt(l1), 4) AS major_axis, round(4 * sqrt(l2), 4) AS minor_axis, round(sqrt(greatest(0.0, 1 - l2 / l1)), 4) AS eccentricity FROM f"""
)
def pixel_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.morphology(_mask(spark, sf_dir), 0.5).drop("orientation_deg"))


@query(
    f"""WITH {IMAGES}, c AS (SELECT *, avg(v) OVER (PARTITION BY img) AS m FROM i)
SELECT img, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(median(v), 4) AS median, round(avg(pow(v - m, 3)) / pow(var_pop(v), 1.5), 4) AS skewness, round(avg(pow(v - m, 4)) / pow(var_pop(v), 2) - 3, 4) AS kurtosis FROM c GROUP BY img"""
)
def pixel_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.intensity(images(spark, sf_dir)))


_PLACES = "l AS (SELECT vec_id AS img, CAST(vec_id % 8 AS INTEGER) AS py, CAST(vec_id // 8 % 8 AS INTEGER) AS px FROM embeddings)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("img"), (F.col("vec_id") % 8).cast("int").alias("py"), (F.floor(F.col("vec_id") / 8) % 8).cast("int").alias("px"))


@query(
    f"""WITH {IMAGES}, {_PLACES}, o AS (SELECT img, avg(v) AS om FROM i GROUP BY img)
SELECT l.img, py, px, count(*) AS n, round(avg(v), 4) AS local_mean, round(stddev_pop(v), 4) AS local_std, max(v) AS local_max, round(avg(v) / nullif(any_value(om), 0), 4) AS local_ratio
FROM l JOIN i ON i.img = l.img AND abs(i.y - py) <= 2 AND abs(i.x - px) <= 2 JOIN o ON o.img = l.img GROUP BY l.img, py, px"""
)
def local_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.local_windows(_places(spark, sf_dir), images(spark, sf_dir), 2), "local_max")


@query(
    f"""WITH {IMAGES}, e AS (SELECT img, min(v) AS lo, max(v) AS hi FROM i GROUP BY img), b AS (SELECT i.img, least(floor((v - lo) / ((hi - lo) / 256)), 255) AS bin, lo, (hi - lo) / 256 AS w FROM i JOIN e USING (img) WHERE hi > lo),
c AS (SELECT img, bin, lo + (bin + 0.5) * w AS mid, count(*) AS n FROM b GROUP BY ALL),
s AS (SELECT *, sum(n) OVER u AS below, sum(n * mid) OVER u AS s, sum(n) OVER a AS all_, sum(n * mid) OVER a AS t FROM c WINDOW u AS (PARTITION BY img ORDER BY bin), a AS (PARTITION BY img)),
q AS (SELECT *, coalesce(below * (all_ - below) * pow(s / below - (t - s) / nullif(all_ - below, 0), 2), -1) AS between_ FROM s)
SELECT img, round(arg_max(mid, (round(between_, 6), -bin)), 4) AS threshold FROM q GROUP BY img"""
)
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.otsu(images(spark, sf_dir)))


@query(f"WITH {MASK} SELECT DISTINCT m.img, CAST(m.y + a AS INTEGER) AS y, CAST(m.x + b AS INTEGER) AS x FROM m, unnest(range(-2, 3)) AS t(a), unnest(range(-2, 3)) AS u(b) WHERE abs(a) + abs(b) <= 2")
def dilate_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dilated(_mask(spark, sf_dir), 2)


@query(
    f"""WITH RECURSIVE {MASK}, r AS (SELECT img, y, x, y * 8 + x AS l FROM m UNION SELECT m.img, m.y, m.x, r.l FROM r JOIN m ON m.img = r.img AND abs(m.y - r.y) + abs(m.x - r.x) = 1)
SELECT img, y, x, CAST(min(l) // 8 AS INTEGER) AS cy, CAST(min(l) % 8 AS INTEGER) AS cx FROM r GROUP BY img, y, x"""
)
def label_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.components(_mask(spark, sf_dir))


@query(f"WITH {IMAGES} SELECT a.img, a.y, a.x, round(sqrt(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))), 4) AS distance FROM i a JOIN i b ON a.img = b.img AND b.v <= 20 WHERE a.v > 20 GROUP BY ALL")
def distance_to_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = images(spark, sf_dir)
    return rounded(P.edge_distance(i.where("v > 20"), i.where("v <= 20")))


@query(
    f"""WITH {IMAGES}, {_PLACES}, c AS (SELECT img, avg(y) AS cy, avg(x) AS cx FROM i WHERE v > 20 GROUP BY img),
d AS (SELECT l.img, py, px, o.v > 20 AS inner_, sqrt(min((b.y - py) * (b.y - py) + (b.x - px) * (b.x - px))) AS d FROM l JOIN i o ON o.img = l.img AND o.y = py AND o.x = px JOIN i b ON b.img = l.img AND (b.v > 20) <> (o.v > 20) GROUP BY ALL)
SELECT img, py * 8 + px AS locus, py, px, round(CASE WHEN inner_ THEN d ELSE -d END, 4) AS to_membrane, round(sqrt((py - cy) * (py - cy) + (px - cx) * (px - cx)), 4) AS to_centroid,
round(CASE WHEN inner_ THEN d / (d + sqrt((py - cy) * (py - cy) + (px - cx) * (px - cx))) ELSE 0 END, 4) AS radial FROM d JOIN c USING (img)"""
)
def locus_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = images(spark, sf_dir)
    loci = _places(spark, sf_dir).withColumn("locus", F.col("py") * 8 + F.col("px"))
    return rounded(P.locus_distances(loci, i.where("v > 20"), i.where("v <= 20")))


_CROP = f"""WITH {IMAGES}, s AS (SELECT *, coalesce((lead(v) OVER r - lag(v) OVER r) / 2, lead(v) OVER r - v, v - lag(v) OVER r, 0) AS gx, coalesce((lead(v) OVER c - lag(v) OVER c) / 2, lead(v) OVER c - v, v - lag(v) OVER c, 0) AS gy
  FROM i WINDOW r AS (PARTITION BY img, y ORDER BY x), c AS (PARTITION BY img, x ORDER BY y)),
f AS (SELECT s.*, s.v > 20 AS m, EXISTS (SELECT 1 FROM i b WHERE b.img = s.img AND b.v > 20 AND abs(b.y - s.y) + abs(b.x - s.x) <= 2) AS wide,
  s.v > 20 AND (SELECT count(*) FROM i b WHERE b.img = s.img AND b.v > 20 AND abs(b.y - s.y) + abs(b.x - s.x) = 1) < 4 AS edge FROM s),
g AS (SELECT img, median(v) FILTER (m) AS inside, CASE WHEN count(*) FILTER (NOT m AND wide) >= 5 THEN median(v) FILTER (NOT m AND wide) ELSE median(v) FILTER (NOT m) END AS ring, median(sqrt(gx * gx + gy * gy)) FILTER (edge) AS boundary_gradient FROM f GROUP BY img)
SELECT img, inside, ring, round(boundary_gradient, 4) AS boundary_gradient, round((inside - ring) / nullif(abs(ring), 0), 4) AS contrast FROM g"""


@query(_CROP)
def crop_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = images(spark, sf_dir)
    return rounded(P.crop_quality(i, i.where("v > 20"), 2, 5))


@query(
    f"""WITH {IMAGES}, f AS (SELECT img % 50 AS img, y, x, avg(v) AS mean_v, max(v) AS max_v FROM i GROUP BY ALL), e AS (SELECT img, quantile_cont(max_v, 0.01) AS lo, quantile_cont(max_v, 0.997) AS hi FROM f GROUP BY img)
SELECT img, y, x, round(mean_v, 4) AS mean_v, max_v, CAST(floor(255 * greatest(0.0, least(1.0, coalesce((max_v - lo) / nullif(hi - lo, 0), 0)))) AS INTEGER) AS u8 FROM f JOIN e USING (img)"""
)
def time_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.projected(images(spark, sf_dir).withColumn("img", F.col("img") % 50)), "max_v")


_MASKS = IMAGES + ", k AS (SELECT img // 5 AS fov, img % 5 AS obj, y, x FROM i WHERE v > 90)"


@query(
    f"""WITH {_MASKS}, n AS (SELECT fov, obj, count(*) AS n FROM k GROUP BY ALL), s AS (SELECT a.fov, a.obj AS a, b.obj AS b, count(*) AS shared FROM k a JOIN k b ON a.fov = b.fov AND a.y = b.y AND a.x = b.x AND a.obj < b.obj GROUP BY ALL)
SELECT s.fov, a, b, shared, round(shared / (p.n + q.n - shared), 4) AS iou, round(shared / least(p.n, q.n), 4) AS containment FROM s JOIN n p ON p.fov = s.fov AND p.obj = a JOIN n q ON q.fov = s.fov AND q.obj = b"""
)
def mask_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.overlaps(_objects(spark, sf_dir)).select("fov", "a", "b", "shared", "iou", "containment"))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).where("v > 90").select(F.floor(F.col("img") / 5).alias("fov"), (F.col("img") % 5).alias("obj"), "y", "x")


@query(
    f"""WITH RECURSIVE {_MASKS}, n AS (SELECT fov, obj, count(*) AS size FROM k GROUP BY ALL), s AS (SELECT a.fov, a.obj AS a, b.obj AS b, count(*) AS shared FROM k a JOIN k b ON a.fov = b.fov AND a.y = b.y AND a.x = b.x AND a.obj <> b.obj GROUP BY ALL),
v AS (SELECT s.fov, a, list(b) AS rivals FROM s JOIN n p ON p.fov = s.fov AND p.obj = a JOIN n q ON q.fov = s.fov AND q.obj = b WHERE shared / (p.size + q.size - shared) > 0.1 OR shared / least(p.size, q.size) > 0.3 GROUP BY ALL),
o AS (SELECT n.*, coalesce(rivals, []) AS rivals, row_number() OVER (PARTITION BY n.fov ORDER BY size DESC, obj) AS place FROM n LEFT JOIN v ON v.fov = n.fov AND v.a = n.obj),
g AS (SELECT DISTINCT fov, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS kept FROM o UNION ALL SELECT o.fov, o.place, CASE WHEN list_has_any(kept, rivals) THEN kept ELSE list_append(kept, obj) END FROM g JOIN o ON o.fov = g.fov AND o.place = g.place + 1)
SELECT n.fov, n.obj, n.size FROM n JOIN (SELECT fov, arg_max(kept, place) AS kept FROM g GROUP BY fov) w ON w.fov = n.fov AND list_contains(kept, n.obj)"""
)
def mask_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.deduplicated_masks(_objects(spark, sf_dir), 0.1, 0.3)


@query()
def mask_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.merged_masks(_objects(spark, sf_dir), 30).groupBy("fov", "obj").agg(F.count(F.lit(1)).alias("area"))


@query(
    """WITH t AS (SELECT user_id AS img, event_id AS frame, CAST(round_even(value % 40, 0) AS INTEGER) AS y, CAST(event_id % 37 AS INTEGER) AS x FROM events),
e AS (SELECT img, y, x, coalesce(lag(y) OVER w, y) AS y0, coalesce(lag(x) OVER w, x) AS x0 FROM t WINDOW w AS (PARTITION BY img ORDER BY frame)),
n AS (SELECT *, greatest(abs(y - y0), abs(x - x0), 1) AS n FROM e),
p AS (SELECT DISTINCT img, CAST(round_even(y0 + (y - y0) * k / n, 0) AS INTEGER) AS y, CAST(round_even(x0 + (x - x0) * k / n, 0) AS INTEGER) AS x FROM n, unnest(range(0, n + 1)) AS u(k)),
d AS (SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM unnest(range(-5, 6)) AS u(a), unnest(range(-5, 6)) AS v(b) WHERE abs(a) + abs(b) <= 5)
SELECT DISTINCT img, y + a AS y, x + b AS x FROM p, d WHERE y + a BETWEEN 0 AND 39 AND x + b BETWEEN 0 AND 39"""
)
def static_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = table(spark, sf_dir, "events").select(F.col("user_id").alias("img"), F.col("event_id").alias("frame"), (F.col("value") % 40).alias("y"), (F.col("event_id") % 37).cast("double").alias("x"))
    return P.static_roi(track, P.scaffold(spark, 1, 40, 40).select("y", "x"))


@query("SELECT CAST(t AS INTEGER) AS t, count(*) AS px, CAST(sum(y) AS BIGINT) AS ys, CAST(sum(x) AS BIGINT) AS xs FROM unnest(range(0, 3)) AS a(t), unnest(range(0, 40)) AS b(y), unnest(range(0, 30)) AS c(x) GROUP BY t")
def scaffold_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scaffold(spark, 3, 40, 30).groupBy("t").agg(F.count(F.lit(1)).alias("px"), F.sum("y").alias("ys"), F.sum("x").alias("xs"))


@query("SELECT CAST(t AS INTEGER) AS t, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CASE WHEN y BETWEEN 8 AND 31 AND x BETWEEN 8 AND 21 AND (y - 8) % 4 = 0 AND (x - 8) % 4 = 0 THEN 0 ELSE 1000 END AS v FROM unnest(range(0, 3)) AS a(t), unnest(range(0, 40)) AS b(y), unnest(range(0, 30)) AS c(x)")
def scaffold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scaffold(spark, 3, 40, 30, 1000, (8, 4))


@query(
    """SELECT 'stack_' || (vec_id // 10) || '.tif' AS name, count(*) AS pages, CAST(9 * sum(list_sum([trunc(least(greatest(CAST(x AS DOUBLE), 0) * 1000, 65535)) FOR x IN embedding])) AS DOUBLE) AS total
FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 GROUP BY vec_id // 10"""
)
def stack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All planes written as stacks of up to ten pages and read back page by page."""
    stacks.register(spark)
    path = f"{scratch_dir(spark)}/stacks-{uuid.uuid4().hex}"
    rows = planes(spark, sf_dir).withColumn("name", F.format_string("stack_%d.tif", F.floor(F.col("stack_id") / 10)))
    rows.repartition("name").sortWithinPartitions("name", "t").select("name", "t", "h", "w", "px").write.format("stacks").mode("append").save(path)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [float(np.frombuffer(p, "<f8").sum()) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.float64())], names=["file", "total"])

    found = spark.read.format("stacks").load(path).select("file", "px").mapInArrow(total, "file string, total double")
    return found.groupBy(F.element_at(F.split("file", "/"), -1).alias("name")).agg(F.count(F.lit(1)).alias("pages"), F.sum("total").alias("total"))


@query()
def stack_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planes(spark, sf_dir).withColumn("stack_id", F.floor(F.col("stack_id") / 10))
    return rounded(P.spots(rows.join(P.first_levels(rows), "stack_id")))


@query()
def detect_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.spots(planes(spark, sf_dir)))


@query()
def detect_nuclei(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.nuclei(planes(spark, sf_dir)))


@query()
def bright_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.bright_spots(planes(spark, sf_dir), 1.0, 60))


@query()
def split_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = images(spark, sf_dir).where("v > 20").select(F.floor(F.col("img") / 5).alias("fov"), (F.col("img") % 5).alias("obj"), "y", "x")
    return P.split_masks(whole, 1.0, 2)


@query()
def register_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planes(spark, sf_dir)
    first = rows.orderBy("stack_id").first()
    # Without a plane there is nothing to move either.
    return rounded(P.drift(rows, np.frombuffer(first.px, "<f8").reshape(24, 24) if first else np.zeros((24, 24))))
