"""Queries on masks, loci, crops and signal clusters. Embeddings serve as images of 8 x 8 pixels, as in `images`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.operators import pixels as P
from tracklark.operators import regions as R
from tracklark.plans.images import IMAGES, MASK, _mask, _places, images
from tracklark.plans.registry import HOURLY, hourly, query, rounded
from tracklark.session import table

_OBJECTS = IMAGES + ", k AS (SELECT img // 5 AS fov, img % 5 AS obj, y, x FROM i WHERE v > {level})"
_LIGHT = IMAGES + ", s AS (SELECT img, y, x, v + 1000 AS v FROM i)"


def _objects(spark: SparkSession, sf_dir: str, level: int) -> DataFrame:
    return images(spark, sf_dir).where(f"v > {level}").select(F.floor(F.col("img") / 5).alias("fov"), (F.col("img") % 5).alias("obj"), "y", "x")


def _light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).withColumn("v", F.col("v") + 1000)


@query(
    f"""WITH {MASK}, p AS (SELECT vec_id AS img, vec_id % 19 / 2.0 - 0.5 AS y, vec_id * 7 % 23 / 2.0 - 0.5 AS x FROM embeddings)
SELECT p.img, CAST(p.y AS DOUBLE) AS y, CAST(p.x AS DOUBLE) AS x, m.img IS NOT NULL AS inside FROM p LEFT JOIN m ON m.img = p.img AND m.y = round_even(p.y, 0) AND m.x = round_even(p.x, 0)"""
)
def points_in_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    points = e.select(F.col("vec_id").alias("img"), (F.col("vec_id") % 19 / 2 - 0.5).alias("y"), (F.col("vec_id") * 7 % 23 / 2 - 0.5).alias("x"))
    return R.with_inside(points, _mask(spark, sf_dir))


@query(
    f"""WITH {IMAGES}, {HOURLY}, f AS (SELECT img % 50 AS img, CAST(img // 50 AS INTEGER) AS frame_0idx, count(*) AS area FROM i WHERE v > 90 GROUP BY ALL)
SELECT track_id, channel, frame, frame_0idx, area FROM h JOIN f ON f.img = track_id % 50 AND f.frame_0idx = frame - 1"""
)
def loci_on_mask_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = images(spark, sf_dir).where("v > 90").groupBy((F.col("img") % 50).alias("img"), F.floor(F.col("img") / 50).cast("int").alias("frame_0idx")).agg(F.count(F.lit(1)).alias("area"))
    loci = hourly(spark, sf_dir).withColumn("img", F.col("track_id") % 50)
    return R.on_mask_frames(loci, frames).select("track_id", "channel", "frame", "frame_0idx", "area")


@query(f"WITH {_OBJECTS.format(level=250)} SELECT fov, obj, count(*) AS area FROM k GROUP BY ALL HAVING least(min(y), min(x), 7 - max(y), 7 - max(x)) > 0")
def mask_edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.off_border(_objects(spark, sf_dir, 250), 8, 8, 0).groupBy("fov", "obj").agg(F.count(F.lit(1)).alias("area"))


@query(
    f"""WITH {_OBJECTS.format(level=150)}, w AS (SELECT img // 5 AS fov, y, x, max(v) AS v FROM i GROUP BY ALL),
b AS (SELECT fov, obj, greatest(min(y) - 1, 0) AS r0, least(max(y) + 2, 8) AS r1, greatest(min(x) - 1, 0) AS c0, least(max(x) + 2, 8) AS c1 FROM k GROUP BY ALL)
SELECT b.fov, b.obj, w.y, w.x, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.fov = b.fov AND k.y = w.y AND k.x = w.x AND k.obj <> b.obj) THEN 0 ELSE v END AS v
FROM b JOIN w ON w.fov = b.fov AND w.y >= r0 AND w.y < r1 AND w.x >= c0 AND w.x < c1"""
)
def crop_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = images(spark, sf_dir).groupBy(F.floor(F.col("img") / 5).alias("fov"), "y", "x").agg(F.max("v").alias("v"))
    return R.crops(whole, _objects(spark, sf_dir, 150), 8, 8, 1)


_VALID = f"""{_LIGHT}, u AS (SELECT img, quantile_cont(v, 0.75) * 0.85 AS u FROM s GROUP BY img), dk AS (SELECT s.img, y, x FROM s JOIN u USING (img) WHERE v < u),
fill AS (SELECT img, y, x FROM dk WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT d.img, d.y, d.x FROM fill JOIN dk d ON d.img = fill.img AND abs(d.y - fill.y) + abs(d.x - fill.x) = 1),
val AS (SELECT s.* FROM s ANTI JOIN fill ON fill.img = s.img AND fill.y = s.y AND fill.x = s.x)"""


@query(f"WITH RECURSIVE {_VALID} SELECT img, y, x, v FROM val")
def valid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.valid_pixels(_light(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_VALID}, lv AS (SELECT img, avg(v) + 0.5 * stddev_pop(v) AS lv FROM val GROUP BY img), br AS (SELECT val.* FROM val JOIN lv USING (img) WHERE v > lv),
lab AS (SELECT img, y, x, y * 8 + x AS l FROM br UNION SELECT b.img, b.y, b.x, lab.l FROM lab JOIN br b ON b.img = lab.img AND abs(b.y - lab.y) + abs(b.x - lab.x) = 1),
nm AS (SELECT img, y, x, min(l) AS l FROM lab GROUP BY ALL),
c AS (SELECT img, l, count(*) AS size, sum(v * y) / sum(v) AS centre_y, sum(v * x) / sum(v) AS centre_x, min(y) AS r0, max(y) AS r1, min(x) AS c0, max(x) AS c1, avg(v) AS intensity FROM nm JOIN br USING (img, y, x) GROUP BY img, l HAVING count(*) >= 2)
SELECT img, CAST(row_number() OVER w AS INTEGER) AS rank, size, round(centre_y, 4) AS centre_y, round(centre_x, 4) AS centre_x, r0, r1, c0, c1, round(intensity, 4) AS intensity FROM c
WINDOW w AS (PARTITION BY img ORDER BY round(intensity, 6) DESC, l) QUALIFY row_number() OVER w <= 3"""
)
def signal_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.signal_clusters(_light(spark, sf_dir), 0.5, 2, 3))


@query(
    f"""WITH RECURSIVE {MASK}, e AS (SELECT img, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM m GROUP BY img),
bg AS (SELECT e.img, CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS x, y0, x0 FROM e, unnest(range(-1, 9)) AS t(a), unnest(range(-1, 9)) AS u(b) WHERE a BETWEEN y0 AND y1 AND b BETWEEN x0 AND x1 AND NOT EXISTS (SELECT 1 FROM m WHERE m.img = e.img AND m.y = a AND m.x = b)),
out_ AS (SELECT img, y, x FROM bg WHERE y = y0 AND x = x0 UNION SELECT g.img, g.y, g.x FROM out_ JOIN bg g ON g.img = out_.img AND abs(g.y - out_.y) + abs(g.x - out_.x) = 1)
SELECT img, y, x FROM m UNION ALL SELECT bg.img, bg.y, bg.x FROM bg ANTI JOIN out_ ON out_.img = bg.img AND out_.y = bg.y AND out_.x = bg.x"""
)
def fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filled(_mask(spark, sf_dir))


@query(f"WITH {MASK} SELECT a.img, a.y, a.x FROM m a JOIN m b ON a.img = b.img AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY ALL HAVING count(*) = 5")
def erode_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.eroded(_mask(spark, sf_dir), 1)


@query(
    f"""WITH {_LIGHT}, p AS (SELECT vec_id AS img, CAST(vec_id % 8 AS INTEGER) AS y, CAST(vec_id // 8 % 8 AS INTEGER) AS x FROM embeddings)
SELECT p.img, p.y, p.x, sum(v) AS mass FROM p JOIN s ON s.img = p.img AND abs(s.y - p.y) <= 1 AND abs(s.x - p.x) <= 1 WHERE p.y BETWEEN 1 AND 6 AND p.x BETWEEN 1 AND 6 GROUP BY ALL HAVING sum(v) > 9000"""
)
def refined_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.box_sums(_places(spark, sf_dir).withColumnsRenamed({"py": "y", "px": "x"}), _light(spark, sf_dir), 3, 9000, 8, 8)


@query(
    f"""WITH {IMAGES}, z AS (SELECT img % 50 AS stack_id, img // 50 AS t, greatest(v, 0) AS v FROM i), f AS (SELECT stack_id, min(t) AS t FROM z GROUP BY ALL)
SELECT stack_id, round(avg(v) + 0.5 * stddev_samp(v), 4) AS level FROM z JOIN f USING (stack_id, t) WHERE v <> 0 GROUP BY stack_id"""
)
def first_frame_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir).select((F.col("img") % 50).alias("stack_id"), F.floor(F.col("img") / 50).alias("t"), F.greatest("v", F.lit(0.0)).alias("v"))
    return rounded(R.first_frame_level(rows))


@query(
    f"""WITH {IMAGES}, m AS (SELECT img, y, x FROM i WHERE v > 150), v AS (SELECT DISTINCT img AS track_id, CAST(x + a AS DOUBLE) AS x, CAST(y + b AS DOUBLE) AS y FROM m, unnest([0, 1]) AS t(a), unnest([0, 1]) AS u(b)),
e AS (SELECT a.track_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM v a JOIN v b ON a.track_id = b.track_id AND (a.x, a.y) <> (b.x, b.y)),
b AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM v c WHERE c.track_id = e.track_id AND
  ((bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax) < 0 OR ((bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax) = 0 AND ((c.x - ax) * (c.x - bx) + (c.y - ay) * (c.y - by_) > 0))))),
h AS (SELECT track_id AS img, sum(ax * by_ - bx * ay) / 2 AS hull FROM b GROUP BY ALL)
SELECT img, count(*) AS area, round(count(*) / any_value(hull), 4) AS solidity FROM m JOIN h USING (img) GROUP BY img"""
)
def mask_solidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.solidity(images(spark, sf_dir).where("v > 150").select("img", "y", "x")))


@query(
    f"""WITH RECURSIVE {MASK}, r AS (SELECT img, y, x, y * 8 + x AS l FROM m UNION SELECT m.img, m.y, m.x, r.l FROM r JOIN m ON m.img = r.img AND abs(m.y - r.y) + abs(m.x - r.x) = 1)
SELECT img, count(DISTINCT l) AS components, count(DISTINCT l) = 1 AS connected FROM (SELECT img, y, x, min(l) AS l FROM r GROUP BY ALL) GROUP BY img"""
)
def mask_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.one_component(_mask(spark, sf_dir))


@query(
    f"""WITH {MASK}, g AS (SELECT img, var_pop(x) + 1.0 / 12 AS a, var_pop(y) + 1.0 / 12 AS b, round(covar_pop(x, y), 9) + 0.0 AS c FROM m GROUP BY img)
SELECT img, round(degrees(atan2(2 * c, round(a - b, 9))) / 2, 3) AS orientation_deg FROM g"""
)
def mask_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.morphology(_mask(spark, sf_dir)).select("img", "orientation_deg"), places=3)
