"""Queries on tracks."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.functions import expressions as E
from tracklark.operators import features, linking, matching, model, perceptron, steps
from tracklark.plans.registry import ANGLES, HOURLY, POINTS, STEPS, hourly, points, query, rounded


_BASIC = f"""WITH {STEPS} SELECT track_id, count(*) AS n_frames, round(var_samp(x), 4) AS x_variance, round(var_samp(y), 4) AS y_variance,
  round(sqrt(var_pop(x) + var_pop(y)), 4) AS radius_of_gyration, round(avg(step), 4) AS mean_step, round(max(step), 4) AS max_step,
  round(var_samp(step), 4) AS step_variance, round(coalesce(sum(step), 0), 4) AS path_length,
  round(CASE WHEN count(*) > 1 THEN sqrt(pow(arg_max(x, frame) - arg_min(x, frame), 2) + pow(arg_max(y, frame) - arg_min(y, frame), 2)) END, 4) AS net_displacement,
  round(CASE WHEN count(*) > 1 THEN sqrt(pow(arg_max(x, frame) - arg_min(x, frame), 2) + pow(arg_max(y, frame) - arg_min(y, frame), 2)) END / nullif(sum(step), 0), 4) AS straightness
FROM s GROUP BY track_id"""


@query(_BASIC)
def track_basic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.basic(points(spark, sf_dir)))


_TURNING = (f"WITH {ANGLES} SELECT track_id, round(avg(angle), 4) AS angle_mean, round(var_samp(angle), 4) AS angle_variance, round(median(angle), 4) AS angle_median FROM a GROUP BY track_id")


@query(_TURNING)
def turning_angle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.turning(points(spark, sf_dir)))


@query(f"WITH {ANGLES} SELECT track_id, frame, round(coalesce(atan2(bx * dy - by_ * dx + 0.0, bx * dx + by_ * dy + 0.0), 0), 4) AS signed_angle FROM a WHERE dx IS NOT NULL")
def signed_turning_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = steps.with_signed_angles(steps.steps(points(spark, sf_dir))).where("dx IS NOT NULL")
    return rounded(found.select("track_id", "frame", "signed_angle"))


_LAST = f"""WITH {HOURLY}, g AS (SELECT track_id, channel, frame, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, frame - lag(frame) OVER w AS gap FROM h WINDOW w AS (PARTITION BY track_id, channel ORDER BY frame)),
r AS (SELECT *, row_number() OVER (PARTITION BY track_id, channel ORDER BY frame DESC) AS back, count(*) OVER (PARTITION BY track_id, channel) AS n FROM g WHERE gap = 1)
SELECT track_id, channel, frame, CAST(least(n, 29) - back + 1 AS INTEGER) AS step_no, round(dx, 4) AS dx, round(dy, 4) AS dy FROM r WHERE back <= 29 AND n >= 3"""


@query(_LAST)
def consecutive_steps_last29(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = steps.consecutive_steps(hourly(spark, sf_dir), by=("track_id", "channel"))
    return rounded(found.select("track_id", "channel", "frame", "step_no", "dx", "dy"))


_SEQUENCES = f"""{_LAST.replace(", round(dx, 4) AS dx, round(dy, 4) AS dy FROM r", ", dx, dy FROM r")}"""


@query(
    f"""SELECT track_id, channel, CAST(count(*) AS INTEGER) AS n_steps, round(sum(dx + dy), 2) AS cartesian_sum, round(sum(sqrt(dx * dx + dy * dy)), 2) AS size_sum, round(sum(angle), 2) AS angle_sum
FROM (SELECT *, coalesce(atan2(lag(dx) OVER w * dy - lag(dy) OVER w * dx + 0.0, lag(dx) OVER w * dx + lag(dy) OVER w * dy + 0.0), 0) AS angle FROM ({_SEQUENCES}) WINDOW w AS (PARTITION BY track_id, channel ORDER BY step_no)) GROUP BY ALL"""
)
def step_representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ("track_id", "channel")
    found = steps.step_sequences(steps.consecutive_steps(hourly(spark, sf_dir), by=by), by=by)
    total = lambda c, *at: F.round(F.aggregate(c, F.lit(0.0), lambda t, e: t + sum((e[k] for k in at[1:]), e[at[0]])), 2)
    return found.select(*by, "n_steps", total("combined", 0, 1).alias("cartesian_sum"), total("polar", 0).alias("size_sum"), total("polar", 1).alias("angle_sum"))


def _acf(value: str, lags: tuple[int, ...]) -> str:
    cols = ", ".join(f"lead(c, {k}) OVER w AS c{k}" for k in lags)
    out = ", ".join(f"round(CASE WHEN count(*) >= 3 AND count(*) // 2 >= {k} THEN sum(c * c{k}) / nullif(sum(c * c), 0) END, 4) AS {value}_acf_lag{k}" for k in lags)
    return f"""SELECT track_id, {out} FROM (SELECT track_id, frame, c, {cols} FROM (SELECT track_id, frame, {value} - avg({value}) OVER (PARTITION BY track_id) AS c FROM a WHERE {value} IS NOT NULL) AS i
  WINDOW w AS (PARTITION BY track_id ORDER BY frame)) AS o GROUP BY track_id"""


_ACF = (f"WITH {ANGLES}, one AS ({_acf('step', (1,))}), two AS ({_acf('angle', (1, 2))}) SELECT track_id, step_acf_lag1, angle_acf_lag1, angle_acf_lag2 FROM one FULL JOIN two USING (track_id)")


@query(_ACF)
def autocorr_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = steps.with_angles(steps.steps(points(spark, sf_dir)))
    speed = features.autocorrelation(moved, "step", (1,)).select("track_id", F.col("lag1").alias("step_acf_lag1"))
    angle = features.autocorrelation(moved, "angle", (1, 2)).select("track_id", F.col("lag1").alias("angle_acf_lag1"), F.col("lag2").alias("angle_acf_lag2"))
    return rounded(speed.join(angle, "track_id", "full"))


_VECTOR = f"""WITH {STEPS}, u AS (SELECT track_id, frame, dx / step AS ux, dy / step AS uy FROM s WHERE step > 0),
v AS (SELECT track_id, ux * lag(ux) OVER w + uy * lag(uy) OVER w AS dot FROM u WINDOW w AS (PARTITION BY track_id ORDER BY frame))
SELECT track_id, round(CASE WHEN count(*) >= 3 THEN avg(dot) END, 4) AS vector_acf_lag1 FROM v GROUP BY track_id"""


@query(_VECTOR)
def vector_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.vector_autocorrelation(points(spark, sf_dir)))


def _series(value: str) -> str:
    return f"k AS (SELECT track_id, {value} AS v, row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS k, count(*) OVER (PARTITION BY track_id) AS n FROM a WHERE {value} IS NOT NULL)"


_WELCH = f"""WITH {ANGLES}, {_series("step")},
z AS (SELECT *, least(n, 8) AS m, least(n, 8) - least(n, 8) // 2 AS hop FROM k WHERE n >= 4),
g AS (SELECT z.*, seg, k - seg * hop AS j FROM z, unnest(range(0, (n - m) // hop + 1)) AS t(seg) WHERE k >= seg * hop AND k < seg * hop + m),
w AS (SELECT *, 0.5 - 0.5 * cos({2 * pi!r} * j / m) AS hann, v - avg(v) OVER (PARTITION BY track_id, seg) AS c FROM g),
f AS (SELECT track_id, m, seg, b, sum(c * hann * cos({2 * pi!r} * b * j / m)) AS re, sum(c * hann * sin({2 * pi!r} * b * j / m)) AS im, sum(hann * hann) AS ww FROM w, unnest(range(0, m // 2 + 1)) AS t(b) GROUP BY ALL),
q AS (SELECT track_id, m, b, b * 1.0 / m AS f, avg(CASE WHEN b = 0 OR b * 2 = m THEN 1 ELSE 2 END * (re * re + im * im) / ww) AS p FROM f GROUP BY track_id, m, b),
r AS (SELECT *, (p + lag(p) OVER (PARTITION BY track_id ORDER BY b)) / 2 / m AS area FROM q)
SELECT track_id, round(sum(area), 4) AS total_power, round(arg_max(f, (round(p, 6), -b)), 4) AS peak_frequency, round(sum(f * p) / nullif(sum(p), 0), 4) AS spectral_centroid FROM r GROUP BY track_id"""


@query(_WELCH)
def welch_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.welch(steps.steps(points(spark, sf_dir)), "step"))


def _bank(source: str, name: str) -> str:
    pick = lambda taps: "list_extract([" + ", ".join(f"CAST({t!r} AS DOUBLE)" for t in taps) + "], CAST(t + 1 AS INTEGER))"
    return f"""{name} AS (SELECT track_id, n, o, sum(v * {pick(features.LOW)}) AS low, sum(v * {pick(features.HIGH)}) AS high FROM (
  SELECT r.track_id, r.n, o, t, v FROM (SELECT DISTINCT track_id, n, o, t, CASE WHEN 2 * o + 1 - t < 0 THEN -(2 * o + 1 - t) - 1 WHEN 2 * o + 1 - t >= n THEN 2 * n - 1 - (2 * o + 1 - t) ELSE 2 * o + 1 - t END AS src
    FROM (SELECT DISTINCT track_id, n FROM {source}), unnest(range(0, (n + 3) // 2)) AS a(o), unnest(range(0, 4)) AS b(t)) AS r JOIN {source} AS i ON i.track_id = r.track_id AND i.k = r.src) GROUP BY track_id, n, o)"""


_WAVELET = f"""WITH {ANGLES}, {_series("step")},
z AS (SELECT * FROM k WHERE n >= 6), {_bank("z", "one")}, y AS (SELECT track_id, o AS k, low AS v, (n + 3) // 2 AS n FROM one WHERE n >= 12), {_bank("y", "two")},
e AS (SELECT track_id, CASE WHEN n < 12 THEN low * low END AS a, high * high AS d FROM one UNION ALL SELECT track_id, low * low, high * high FROM two)
SELECT track_id, round(sum(a), 4) AS energy_approx, round(sum(d), 4) AS energy_detail, round(sum(a) + sum(d), 4) AS energy_total FROM e GROUP BY track_id"""


@query(_WAVELET)
def wavelet_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.wavelet(steps.steps(points(spark, sf_dir)), "step"))


_HULL = f"""{POINTS}, v AS (SELECT DISTINCT track_id, x, y FROM p),
e AS (SELECT a.track_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM v a JOIN v b ON a.track_id = b.track_id AND (a.x, a.y) <> (b.x, b.y)),
b AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM v c WHERE c.track_id = e.track_id AND
  ((bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax) < 0 OR ((bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax) = 0 AND ((c.x - ax) * (c.x - bx) + (c.y - ay) * (c.y - by_) > 0))))),
hull AS (SELECT track_id, nullif(sum(ax * by_ - bx * ay) / 2, 0) AS hull_area FROM b GROUP BY track_id)"""


@query(f"WITH {_HULL} SELECT i.track_id, round(hull_area, 3) AS hull_area FROM (SELECT DISTINCT track_id FROM p) i LEFT JOIN hull USING (track_id)")
def hull_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.hulls(points(spark, sf_dir)), places=3)


@query(
    f"""WITH {_HULL}, m AS (SELECT track_id, count(*) AS n_frames, sqrt(var_pop(x) + var_pop(y)) AS rg, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM p GROUP BY track_id)
SELECT track_id, round(hull_area / nullif(area, 0), 4) AS hull_per_area, round(hull_area / nullif(area, 0) / n_frames, 6) AS hull_per_area_frame, round(rg / nullif(sqrt(area), 0), 4) AS gyration_per_root_area FROM m LEFT JOIN hull USING (track_id)"""
)
def size_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    area = p.groupBy("track_id").agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    found = features.size_normalised(features.basic(p).join(features.hulls(p), "track_id").join(area, "track_id"))
    return found.select("track_id", F.round("hull_per_area", 4).alias("hull_per_area"), F.round("hull_per_area_frame", 6).alias("hull_per_area_frame"), F.round("gyration_per_root_area", 4).alias("gyration_per_root_area"))


@query()
def decay_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.decays(points(spark, sf_dir)))


def _named(sql: str, value: str, *columns: str) -> str:
    return f"SELECT track_id, {', '.join(f'{c} AS {value}_{c}' for c in columns)} FROM ({sql.replace(_series('step'), _series(value))})"


_PARTS = [
    _BASIC, _TURNING, f"WITH {_HULL} SELECT track_id, round(hull_area, 4) AS hull_area FROM hull", _VECTOR, _ACF.replace("SELECT track_id, step_acf_lag1,", "SELECT track_id, step_acf_lag1 AS speed_acf_lag1,"),
    *[_named(sql, v, *columns) for v in ("step", "angle") for sql, columns in ((_WELCH, ("total_power", "peak_frequency", "spectral_centroid")), (_WAVELET, ("energy_approx", "energy_detail", "energy_total")))],
]


@query(f"SELECT * FROM ({_PARTS[0]}) " + " ".join(f"LEFT JOIN ({p}) USING (track_id)" for p in _PARTS[1:]))
def track_feature_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.all_features(points(spark, sf_dir)).drop(*features.FITS))


@query()
def perceptron_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of two features of held-out tracks, learned from three others."""
    rows, targets = features.basic(points(spark, sf_dir)), ["path_length", "radius_of_gyration"]
    net = perceptron.trained(rows.where("track_id % 5 <> 0"), ["n_frames", "mean_step", "x_variance"], targets, "track_id", epochs=60)
    tested = rows.where("track_id % 5 = 0")
    found = net.predicted(tested) if net else tested.where("false").selectExpr("*", *[f"{t} AS predicted_{t}" for t in targets])
    one = lambda t: model.metrics(found, t, f"predicted_{t}").where("n > 0").withColumn("target", F.lit(t))
    return rounded(one(targets[0]).unionByName(one(targets[1])))


@query()
def all_track_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.all_features(points(spark, sf_dir)))


@query(
    f"""WITH {HOURLY}, g AS (SELECT *, frame - lag(frame) OVER (PARTITION BY track_id, channel ORDER BY frame) AS gap FROM h)
SELECT track_id, channel, count(*) AS points, min(frame) AS first_frame, max(frame) AS last_frame, max(frame) - min(frame) + 1 AS frame_span,
  round(count(*) / (max(frame) - min(frame) + 1), 4) AS coverage, coalesce(max(gap - 1), 0) AS max_missing FROM g GROUP BY ALL"""
)
def gap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(steps.gaps(hourly(spark, sf_dir), ("track_id", "channel")))


_AUDIT = f"""{HOURLY}, g AS (SELECT *, frame - lag(frame) OVER w AS gap, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM h WINDOW w AS (PARTITION BY channel, track_id ORDER BY frame)),
q AS (SELECT channel, track_id AS cand, count(*) AS points, min(frame) AS first_frame, max(frame) AS last_frame, max(frame) - min(frame) + 1 AS frame_span,
  count(*) / (max(frame) - min(frame) + 1) AS temporal_coverage, coalesce(max(gap - 1), 0) AS max_missing, coalesce(median(step), 0) AS median_step, coalesce(quantile_cont(step, 0.95), 0) AS p95_step,
  avg(CASE WHEN x < 50 AND y < 50 THEN 1.0 ELSE 0.0 END) AS inside_fraction FROM g GROUP BY ALL)"""


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands = hourly(spark, sf_dir).withColumnRenamed("track_id", "cand").withColumn("inside", (F.col("x") < 50) & (F.col("y") < 50))
    return matching.candidate_audit(steps.steps(cands, ("channel", "cand")), "inside")


@query(f"WITH {_AUDIT} SELECT channel, cand, points, first_frame, last_frame, frame_span, round(temporal_coverage, 4) AS temporal_coverage, max_missing, round(median_step, 4) AS median_step, round(p95_step, 4) AS p95_step, round(inside_fraction, 4) AS inside_fraction FROM q")
def candidate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_audit(spark, sf_dir))


_BEST = "b AS (SELECT channel, cand, points, frame_span, first_frame FROM q QUALIFY row_number() OVER (PARTITION BY channel ORDER BY points DESC, frame_span DESC, first_frame, cand) = 1)"


@query(f"WITH {_AUDIT}, {_BEST} SELECT channel, cand, points, frame_span, first_frame FROM b")
def longest_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.longest(_audit(spark, sf_dir)).select("channel", "cand", "points", "frame_span", "first_frame")


@query(
    f"""WITH {_AUDIT}, f AS (SELECT *, cand % 3 AS allele FROM q WHERE NOT (channel = 'view' AND cand % 3 = 2)),
b AS (SELECT allele, channel, cand, points, frame_span FROM f QUALIFY row_number() OVER (PARTITION BY allele, channel ORDER BY points DESC, frame_span DESC, first_frame, cand) = 1),
c AS (SELECT allele, channel, count(*) AS candidates FROM f GROUP BY ALL),
k AS (SELECT CAST(a AS BIGINT) AS allele, channel FROM unnest(range(0, 3)) AS t(a), (SELECT DISTINCT event_type AS channel FROM events))
SELECT k.allele, k.channel, coalesce(candidates, 0) AS candidates, cand, points, frame_span, CASE WHEN cand IS NULL THEN 'no_candidate' ELSE 'selected' END AS status
FROM k LEFT JOIN c USING (allele, channel) LEFT JOIN b USING (allele, channel)"""
)
def baseline_audit_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = _audit(spark, sf_dir).withColumn("allele", F.col("cand") % 3).where("NOT (channel = 'view' AND allele = 2)")
    channels = hourly(spark, sf_dir).select("channel").distinct()
    grid = channels.withColumn("allele", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return matching.selection_audit(audit, grid, ("allele", "channel")).select("allele", "channel", "candidates", "cand", "points", "frame_span", "status")


_SCORES = f"""{HOURLY}, z AS (SELECT r.channel, r.track_id AS ref, c.track_id AS cand, count(*) AS shared, avg(sqrt(pow(r.x - c.x, 2) + pow(r.y - c.y, 2))) AS mean_distance
  FROM h r JOIN h c ON r.channel = c.channel AND r.frame = c.frame WHERE r.track_id % 10 = 0 AND c.track_id % 10 <> 0 GROUP BY ALL HAVING count(*) >= 2)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = hourly(spark, sf_dir)
    return h.where("track_id % 10 = 0").withColumnRenamed("track_id", "ref"), h.where("track_id % 10 <> 0").withColumnRenamed("track_id", "cand")


@query(f"WITH {_SCORES} SELECT channel, ref, cand, shared, round(mean_distance, 4) AS mean_distance FROM z")
def shared_frame_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matching.shared_frame_scores(*_sides(spark, sf_dir), least=2))


_GREEDY = f"""WITH RECURSIVE {_SCORES.replace("HAVING count(*) >= 2", "HAVING count(*) >= 1")}, o AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY mean_distance, ref, cand) AS k FROM z),
g AS (SELECT DISTINCT channel, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS refs, CAST([] AS BIGINT[]) AS cands FROM o
  UNION ALL SELECT o.channel, o.k, CASE WHEN list_contains(refs, ref) OR list_contains(cands, cand) THEN refs ELSE list_append(refs, ref) END, CASE WHEN list_contains(refs, ref) OR list_contains(cands, cand) THEN cands ELSE list_append(cands, cand) END
  FROM g JOIN o ON o.channel = g.channel AND o.k = g.k + 1),
m AS (SELECT channel, unnest(refs) AS ref, unnest(cands) AS cand FROM (SELECT channel, arg_max(refs, k) AS refs, arg_max(cands, k) AS cands FROM g GROUP BY channel)),
s AS (SELECT channel, track_id, min(frame) AS first_frame FROM h GROUP BY ALL)
SELECT r.channel, r.ref, m.cand, coalesce(shared, 0) AS shared, round(mean_distance, 4) AS mean_distance, CASE WHEN m.cand IS NULL THEN 'no_match' WHEN mean_distance > 60 THEN 'rejected_distance'
  WHEN r.channel = 'error' AND first_frame > 100 THEN 'rejected_red_late_start' WHEN r.ref % 20 = 0 THEN 'accepted_missing_file' ELSE 'saved' END AS status
FROM (SELECT DISTINCT channel, track_id AS ref FROM h WHERE track_id % 10 = 0) r LEFT JOIN m USING (channel, ref) LEFT JOIN z USING (channel, ref, cand) LEFT JOIN s ON s.channel = r.channel AND s.track_id = m.cand"""


@query(_GREEDY)
def match_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, cands = _sides(spark, sf_dir)
    return rounded(matching.match_decisions(refs, cands, 60.0, "error", 100, refs.where("ref % 20 <> 0"), 1))


@query()
def optimal_seed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, cands = _sides(spark, sf_dir)
    return rounded(matching.optimal_track_matches(refs, cands, 2, 200.0))


@query(
    f"""WITH {HOURLY}, f AS (SELECT track_id, frame, count(*) AS detections FROM h GROUP BY ALL),
i AS (SELECT *, sum(CASE WHEN gap = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY frame) AS block FROM (SELECT *, frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS gap FROM f))
SELECT track_id, CAST(block AS BIGINT) AS block, min(frame) AS first_frame, max(frame) AS last_frame, CAST(sum(detections) AS BIGINT) AS detections FROM i GROUP BY track_id, block HAVING max(frame) - min(frame) + 1 >= 3"""
)
def frame_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.islands(hourly(spark, sf_dir), ("track_id",), 3)


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    return h.select((F.col("track_id") % 8).alias("movie"), "channel", "frame", "x", "y")


@query()
def link_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link(_detections(spark, sf_dir), 25.0, memory=3, least=4)


@query()
def link_frame_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link_blocks(_detections(spark, sf_dir), 25.0)


@query()
def seed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.seed_tracks(_detections(spark, sf_dir), 40.0, frames=40)


_FOLLOW = f"""WITH RECURSIVE {HOURLY}, sp AS (SELECT frame, x, y FROM h WHERE channel = 'view'), rf AS (SELECT track_id, frame, x AS rx, y AS ry FROM h WHERE channel = 'click'), mn AS (SELECT track_id, avg(rx) AS mx, avg(ry) AS my FROM rf GROUP BY ALL),
pl AS (SELECT mn.track_id, f.frame, coalesce(rx, mx) AS rx, coalesce(ry, my) AS ry FROM (SELECT DISTINCT frame FROM sp) f CROSS JOIN mn LEFT JOIN rf ON rf.track_id = mn.track_id AND rf.frame = f.frame),
cd AS (SELECT track_id, frame, x, y, sqrt(pow(x - rx, 2) + pow(y - ry, 2)) AS away FROM pl JOIN sp USING (frame) WHERE sqrt(pow(x - rx, 2) + pow(y - ry, 2)) <= 30),
ls AS (SELECT track_id, frame, list(struct_pack(x := x, y := y, away := away) ORDER BY x, y) AS c, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS k FROM cd GROUP BY track_id, frame),
r AS (SELECT DISTINCT track_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS INTEGER) AS frame, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, false AS "primary" FROM ls
  UNION ALL SELECT track_id, k, frame, pick.x, pick.y, near FROM (SELECT track_id, k, frame, near, CASE WHEN near THEN list_filter(c, lambda e: sqrt(pow(e.x - lx, 2) + pow(e.y - ly, 2)) = m)[1] ELSE list_filter(c, lambda e: e.away = a)[1] END AS pick
    FROM (SELECT *, coalesce(m <= 20, false) AS near FROM (SELECT ls.*, r.x AS lx, r.y AS ly, list_min(list_transform(c, lambda e: sqrt(pow(e.x - r.x, 2) + pow(e.y - r.y, 2)))) AS m, list_min(list_transform(c, lambda e: e.away)) AS a
      FROM r JOIN ls ON ls.track_id = r.track_id AND ls.k = r.k + 1))))
SELECT track_id, frame, x, y, "primary" FROM r WHERE k > 0"""


@query(_FOLLOW)
def follow_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir).where("channel = 'click'")
    reference = h.select("track_id", "frame", F.col("x").alias("rx"), F.col("y").alias("ry"))
    spots = _detections(spark, sf_dir).where("channel = 'view'").select("frame", "x", "y")
    return linking.follow_reference(spots, reference, 20.0, 30.0)


@query(
    f"""WITH {HOURLY}, g AS (SELECT k AS spot, 20.0 * k AS sx, 50.0 AS sy FROM unnest(range(0, 10)) AS t(k)),
n AS (SELECT spot, frame, x, y, sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS distance FROM h, g WHERE sqrt(pow(x - sx, 2) + pow(y - sy, 2)) < 30)
SELECT spot, frame, round(x, 4) AS x, round(y, 4) AS y, round(distance, 4) AS distance FROM n QUALIFY row_number() OVER (PARTITION BY spot, frame ORDER BY distance, x, y) = 1"""
)
def fixed_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = spark.range(10).select(F.col("id").alias("spot"), (F.col("id") * 20.0).alias("sx"), F.lit(50.0).alias("sy"))
    return rounded(linking.fixed_spot(hourly(spark, sf_dir).select("frame", "x", "y"), spots))


_CROWDING = f"""WITH {HOURLY}, d AS (SELECT DISTINCT track_id % 8 AS movie, channel, frame, x, y FROM h),
n AS (SELECT movie, channel, frame, count(*) AS points FROM d GROUP BY ALL),
ab AS (SELECT a.movie, a.channel, a.frame, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM d a JOIN d b USING (movie, channel, frame) WHERE (a.x, a.y) < (b.x, b.y)),
c AS (SELECT ab.*, (d.x - (ax + bx) / 2) * (ay - by_) + (d.y - (ay + by_) / 2) * (bx - ax) AS side, pow(d.x - (ax + bx) / 2, 2) + pow(d.y - (ay + by_) / 2, 2) - (pow(bx - ax, 2) + pow(by_ - ay, 2)) / 4 AS beyond
  FROM ab JOIN d USING (movie, channel, frame) WHERE (d.x, d.y) <> (ax, ay) AND (d.x, d.y) <> (bx, by_)),
e AS (SELECT movie, channel, frame, round(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)), 9) AS len FROM c GROUP BY movie, channel, frame, ax, ay, bx, by_
  HAVING NOT coalesce(bool_or(abs(side) < 1e-12 AND beyond < 0), false) AND coalesce(max(beyond / (2 * side)) FILTER (side < -1e-12), '-inf') <= coalesce(min(beyond / (2 * side)) FILTER (side > 1e-12), 'inf')),
s AS (SELECT movie, channel, frame, avg(len) AS m, min(len) AS lo, coalesce(stddev_samp(len), 0) AS sd FROM (SELECT DISTINCT * FROM e) GROUP BY ALL)
SELECT n.*, round(m, 4) AS edge_mean, round(lo, 4) AS edge_min, round(sd, 4) AS edge_std, round(25 / (m / 2), 4) AS density_index,
  CASE WHEN points < 3 THEN 'fewer than three points' WHEN 25 > m / 2 THEN 'reach beyond half the mean distance' END AS warning FROM n LEFT JOIN s USING (movie, channel, frame)"""


@query(_CROWDING)
def crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linking.crowding(_detections(spark, sf_dir), ("movie", "channel", "frame"), 25.0))


@query(
    f"""WITH {POINTS}, f AS (SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, median(x) OVER v AS mx, median(y) OVER v AS my, min(frame) OVER v AS f0, max(frame) OVER v AS f1 FROM p
  WINDOW w AS (PARTITION BY track_id ORDER BY frame), v AS (PARTITION BY track_id))
SELECT track_id, frame, round(sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)), 4) AS from_start, round(x - mx, 4) AS x_centred, round(y - my, 4) AS y_centred, round((frame - 1) * CAST(0.5 AS DOUBLE), 4) AS elapsed, round((frame - f0) / greatest(f1 - f0, 1), 4) AS time_share FROM f"""
)
def aligned_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = steps.aligned(points(spark, sf_dir), 0.5)
    return rounded(found.select("track_id", "frame", "from_start", "x_centred", "y_centred", "elapsed", "time_share"))


@query(
    f"""WITH {STEPS} SELECT track_id, frame, round(dx * cos(0.7) - dy * sin(0.7), 4) AS rotated_dx, round(dx * sin(0.7) + dy * cos(0.7), 4) AS rotated_dy,
  CAST(row_number() OVER (PARTITION BY track_id ORDER BY frame DESC) AS INTEGER) AS reversed_no, round(-dx, 4) + 0.0 AS reversed_dx, round(-dy, 4) + 0.0 AS reversed_dy FROM s WHERE dx IS NOT NULL"""
)
def augmented_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rounded(steps.turned(steps.steps(points(spark, sf_dir)), 0.7))
    return found.withColumns({c: F.col(c) + 0.0 for c in ("reversed_dx", "reversed_dy")})


@query(
    """SELECT l_orderkey, l_linenumber, n, round(r, 6) AS radius_um, round(r / 0.10833333604166673, 6) AS radius_px, round(ceil((r / 0.10833333604166673 - 1e-12) / 0.05) * 0.05, 4) AS operational_px, round_even(3 * sqrt(4 * d / 1.5) / 0.10833333604166673, 0) AS legacy_px
FROM (SELECT *, sqrt(-4 * ln(1 - 0.99) * (d * pow(1.0114487409591675, a) + 0.0004)) AS r FROM (SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_discount) * 0.05 + 0.001 AS d, 0.4 + min(l_tax) AS a FROM lineitem GROUP BY ALL))"""
)
def max_step_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklark.session import table

    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), (F.min("l_discount") * 0.05 + 0.001).alias("d"), (F.min("l_tax") + 0.4).alias("a"))
    px = F.lit(0.10833333604166673)
    r = E.link_radius_um(F.lit(1.0114487409591675), F.lit(1.0), F.col("d"), F.col("a"), F.lit(0.99), F.lit(0.02))
    return rows.select(
        "l_orderkey", "l_linenumber", "n", F.round(r, 6).alias("radius_um"), F.round(r / px, 6).alias("radius_px"), F.round(E.ceil_to(r / px, 0.05), 4).alias("operational_px"), E.legacy_radius_px(F.col("d"), F.lit(1.5), px).alias("legacy_px")
    )


@query(
    """SELECT p_partkey, CAST(g AS INTEGER) AS frame_gap, round(g * CAST(1.0114487409591675 AS DOUBLE), 6) AS lag_time_s, round(sqrt(-4 * ln(1 - 0.95) * (p_size * 0.001 * pow(g * 1.0114487409591675, 0.5) + 0.0004)) * 1000, 4) AS radius_nm
FROM part, unnest(range(1, 5)) AS t(g)"""
)
def gap_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklark.session import table

    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("frame_gap"))
    r = E.link_radius_um(F.lit(1.0114487409591675), F.col("frame_gap"), F.col("p_size") * 0.001, F.lit(0.5), F.lit(0.95), F.lit(0.02))
    return rows.select("p_partkey", "frame_gap", F.round(F.col("frame_gap") * 1.0114487409591675, 6).alias("lag_time_s"), F.round(r * 1000, 4).alias("radius_nm"))


@query(
    f"""WITH {HOURLY}, c AS (SELECT track_id, channel, frame, CASE WHEN channel IN ('click', 'error') THEN true ELSE false END AS known, x < 100 AS inside FROM h)
SELECT track_id, count(*) FILTER (known) AS checkable, round(coalesce(count(*) FILTER (known AND NOT inside) / nullif(count(*) FILTER (known), 0), 0), 4) AS outside_share, coalesce(count(*) FILTER (known AND NOT inside) / nullif(count(*) FILTER (known), 0), 0) <= 0.1 AS accepted FROM c GROUP BY track_id"""
)
def outside_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklark.operators.quality import outside_share

    rows = hourly(spark, sf_dir).select("track_id", F.col("channel").isin("click", "error").alias("known"), (F.col("x") < 100).alias("inside"))
    return rounded(outside_share(rows, ("track_id",), "known", "inside"))


