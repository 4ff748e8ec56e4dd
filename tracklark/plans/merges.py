"""Queries on feature, status and metric tables, text and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklark.functions import expressions as E
from tracklark.operators import model, profiles, quality, regression, spatial, tables
from tracklark.plans.registry import query, rounded
from tracklark.session import table


@query(
    """WITH f AS (SELECT l_orderkey, min(struct_pack(s := l_shipdate, q := l_quantity, e := l_extendedprice)) AS m FROM lineitem GROUP BY ALL)
SELECT o_orderkey, o_totalprice, o_orderstatus, m.s AS l_shipdate, m.q AS l_quantity, m.e AS l_extendedprice FROM orders LEFT JOIN f ON o_orderkey = l_orderkey"""
)
def first_child_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_quantity", "l_extendedprice")
    return tables.merge_first(o, c, ("o_orderkey",), ("l_shipdate", "l_quantity", "l_extendedprice"), "_nuc")


@query(
    """SELECT o_orderkey, o_custkey, n_rows, round(q, 6) AS l_quantity, round(e, 6) AS l_extendedprice, round(d, 6) AS l_discount FROM orders LEFT JOIN
(SELECT l_orderkey, count(*) AS n_rows, avg(l_quantity) AS q, avg(l_extendedprice) AS e, avg(l_discount) AS d FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey"""
)
def mean_child_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_extendedprice", "l_discount")
    return rounded(tables.merge_aggregate(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, ("o_orderkey",), "mean", "_locus"), places=6)


@query(
    """SELECT o_orderkey, o_custkey, n_rows, round(q, 4) AS l_quantity, round(e, 4) AS l_extendedprice FROM orders LEFT JOIN
(SELECT l_orderkey, count(*) AS n_rows, median(l_quantity) AS q, median(l_extendedprice) AS e FROM lineitem GROUP BY ALL HAVING count(*) >= 5) ON o_orderkey = l_orderkey"""
)
def median_child_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_extendedprice")
    return rounded(tables.merge_aggregate(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, ("o_orderkey",), "median", "", having=5))


@query("SELECT o_orderkey, count(*) AS hits FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def lookup_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))  # noqa: E741
    return table(spark, sf_dir, "orders").join(l, "o_orderkey").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("hits"))


@query("SELECT o_orderstatus, count(*) AS skipped FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL")
def lookup_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))  # noqa: E741
    return table(spark, sf_dir, "orders").join(l, "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("skipped"))


@query(
    """WITH c AS (SELECT l_orderkey, min(l_linenumber) AS canon FROM lineitem WHERE l_quantity > 10 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem LEFT JOIN c USING (l_orderkey) WHERE canon IS NULL OR canon = l_linenumber GROUP BY ALL"""
)
def canonical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")  # noqa: E741
    canon = l.where("l_quantity > 10").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    return tables.canonical(l.drop("l_quantity"), canon, "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT k AS c_custkey, CASE WHEN o IS NULL THEN c_acctbal ELSE o END AS balance FROM (SELECT c_custkey AS k, c_acctbal FROM customer)
FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS o FROM orders GROUP BY ALL) USING (k)"""
)
def right_wins_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("balance"))
    return tables.override(old, new, keys=("c_custkey",))


@query("SELECT user_id % 5 AS fold, count(*) AS n, count(DISTINCT user_id) AS groups FROM events WHERE user_id IN (SELECT user_id FROM events WHERE user_id % 5 = 0) GROUP BY ALL")
def group_split_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id")
    kept = e.join(e.where("user_id % 5 = 0").distinct(), "user_id", "left_semi")
    return kept.groupBy((F.col("user_id") % 5).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("groups"))


@query("SELECT user_id % 5 AS fold, count(*) AS n, count(DISTINCT user_id) AS groups FROM events WHERE user_id % 5 <> 0 GROUP BY ALL")
def group_split_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id")
    kept = e.join(e.where("user_id % 5 = 0").distinct(), "user_id", "left_anti")
    return kept.groupBy((F.col("user_id") % 5).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("groups"))


@query("SELECT CAST(0 AS BIGINT) AS shared_groups")
def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.shuffled_split(table(spark, sf_dir, "events").select("user_id"), "user_id")
    return model.disjoint(rows.where("NOT is_test"), rows.where("is_test"), "user_id")


_METRICS = "SELECT l_orderkey AS cell, l_discount * 1.5 AS ch0_contrast, l_tax * 40 AS ch0_boundary_grad FROM lineitem"


@query(
    f"""SELECT bad_qc, CASE WHEN bad_qc THEN 'ch0_contrast<0.085 & ch0_boundary_grad<1.70' END AS rule, count(*) AS n, sum(cell)::BIGINT AS cells
FROM (SELECT *, coalesce(ch0_contrast < 0.085 AND ch0_boundary_grad < 1.7, false) AS bad_qc FROM ({_METRICS})) GROUP BY ALL"""
)
def bad_qc_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), (F.col("l_discount") * 1.5).alias("ch0_contrast"), (F.col("l_tax") * 40).alias("ch0_boundary_grad"))
    return quality.bad_qc(m).groupBy("bad_qc", "rule").agg(F.count(F.lit(1)).alias("n"), F.sum("cell").alias("cells"))


@query(
    """SELECT CASE WHEN l_quantity < 3 THEN 'small' WHEN l_quantity > 48 THEN 'huge' WHEN l_linenumber = 1 THEN 'border' WHEN l_discount < 0.03 THEN 'split' WHEN l_quantity <= 24 THEN 'kept' ELSE 'large' END AS reason,
count(*) AS n FROM lineitem GROUP BY ALL"""
)
def ordered_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = quality.filter_reason(F.col("l_quantity"), F.col("l_linenumber") == 1, F.col("l_discount"), 3, 24, 0.03)
    return table(spark, sf_dir, "lineitem").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_ROLL = """count(*) AS cells, count(*) FILTER (o_orderstatus = 'F') AS complete, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS value_sum,
round(coalesce(median(o_totalprice - 100000) FILTER (o_totalprice > 100000), 0), 4) AS median_duration"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("fov"), "o_orderstatus", "o_totalprice", (F.col("o_totalprice") - 100_000).alias("duration"))


def _rolled(df: DataFrame) -> DataFrame:
    return df.withColumns({"value_sum": F.round("value_sum", 2), "median_duration": F.round("median_duration", 4)})


@query(f"SELECT o_orderpriority AS fov, {_ROLL} FROM orders GROUP BY ALL")
def fov_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(tables.roll_up(_cells(spark, sf_dir), ("fov",), F.col("o_orderstatus") == "F", "o_totalprice", "duration"))


@query(f"SELECT o_orderpriority AS fov, {_ROLL} FROM orders GROUP BY ALL UNION ALL SELECT 'urgent_total', {_ROLL} FROM orders WHERE o_orderpriority LIKE '1%'")
def fov_rollup_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    both = cells.unionByName(cells.where("fov LIKE '1%'").withColumn("fov", F.lit("urgent_total")))
    return _rolled(tables.roll_up(both, ("fov",), F.col("o_orderstatus") == "F", "o_totalprice", "duration"))


_STATES = "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'failed' ELSE 'running' END"


@query(
    f"""WITH c AS (SELECT o_orderpriority AS fov, o_orderkey AS unit, {_STATES} AS state, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_orderkey % 7 AS DOUBLE) - 2 AS duration, CASE WHEN o_orderstatus = 'O' THEN '' ELSE CAST(o_orderdate AS VARCHAR) END AS finished, o_custkey % 10 = 0 AS bad FROM orders)
SELECT fov, count(*) AS cells, count(*) FILTER (state = 'complete') AS complete, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'running') AS running, count(*) FILTER (bad) AS flagged,
  round(coalesce(sum(price) FILTER (state = 'complete'), 0), 2) AS value_sum, coalesce(median(duration) FILTER (duration > 0), 0) AS median_duration, round(coalesce(sum(duration) FILTER (duration > 0), 0), 1) AS total_duration, coalesce(max(nullif(finished, '')), '') AS last_finished,
  coalesce(string_agg(CAST(unit AS VARCHAR), ',' ORDER BY unit) FILTER (state = 'failed'), '') AS failed_units, md5(coalesce(string_agg(CAST(unit AS VARCHAR), ',' ORDER BY unit) FILTER (state = 'running'), '')) AS running_units FROM c GROUP BY fov"""
)
def fov_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    finished = F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderdate").cast("string"))
    rows = o.select(F.col("o_orderpriority").alias("fov"), F.col("o_orderkey").alias("unit"), state.alias("state"), F.col("o_totalprice").cast("double").alias("price"), ((F.col("o_orderkey") % 7).cast("double") - 2).alias("duration"), finished.alias("finished"), (F.col("o_custkey") % 10 == 0).alias("bad"))
    found = tables.full_roll_up(rows, ("fov",), "unit", "state", "price", "duration", "finished", F.col("bad"))
    text = lambda c: F.array_join(F.transform(c, lambda k: k.cast("string")), ",")
    return found.withColumns({"value_sum": F.round("value_sum", 2), "failed_units": text("failed_units"), "running_units": F.md5(text("running_units"))}).drop("counts")


@query("SELECT o_orderpriority AS fov, string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) AS counts FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.status_counts(_cells(spark, sf_dir), ("fov",), "o_orderstatus")
    return found.select("fov", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


_TASKS = "(SELECT l_returnflag AS target, l_linestatus || CAST(l_linenumber AS VARCHAR) AS variant, l_suppkey % 5 AS seed, avg(l_discount) AS r2, avg(l_quantity) AS rmse FROM lineitem GROUP BY ALL)"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(F.col("l_returnflag").alias("target"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("variant"), (F.col("l_suppkey") % 5).alias("seed")).agg(F.avg("l_discount").alias("r2"), F.avg("l_quantity").alias("rmse"))


@query(f"""SELECT target, variant, round(avg(r2), 5) AS r2_mean, round(stddev_samp(r2), 5) AS r2_std, round(avg(rmse), 5) AS rmse_mean, round(stddev_samp(rmse), 5) AS rmse_std,
printf('%.2f±%.2f', avg(rmse), coalesce(stddev_samp(rmse), 0)) AS shown FROM {_TASKS} GROUP BY ALL""")
def seed_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.mean_and_spread(_tasks(spark, sf_dir), ("target", "variant"), ("r2", "rmse"))
    return rounded(found.withColumn("shown", tables.mean_text(F.col("rmse_mean"), F.col("rmse_std"), 2)), places=5)


@query(f"SELECT target, round(any_value(r) FILTER (variant = 'F1'), 5) AS F1, round(any_value(r) FILTER (variant = 'O1'), 5) AS O1, round(any_value(r) FILTER (variant = 'O7'), 5) AS O7 FROM (SELECT target, variant, avg(r2) AS r FROM {_TASKS} GROUP BY ALL) GROUP BY target")
def pivot_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _tasks(spark, sf_dir).groupBy("target", "variant").agg(F.avg("r2").alias("r2"))
    return rounded(tables.pivoted(means, "target", "variant", ["F1", "O1", "O7"], "r2"), places=5)


@query(f"SELECT target, variant, round(r, 5) AS r2 FROM (SELECT target, variant, avg(r2) AS r FROM {_TASKS} GROUP BY ALL) WHERE variant <> 'O1' QUALIFY row_number() OVER (PARTITION BY target ORDER BY r DESC, variant) = 1")
def best_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _tasks(spark, sf_dir).groupBy("target", "variant").agg(F.avg("r2").alias("r2"))
    return rounded(tables.best_of(means, "target", "r2", "variant", "O1"), places=5)


@query(f"SELECT target, round(avg(r2) FILTER (variant = 'O1'), 5) AS plain, round(avg(r2) FILTER (variant = 'O2'), 5) AS changed, round(avg(r2) FILTER (variant = 'O2') - avg(r2) FILTER (variant = 'O1'), 5) AS delta FROM {_TASKS} GROUP BY target")
def delta_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.delta(_tasks(spark, sf_dir), ("target",), "variant", "O1", "O2", "r2"), places=5)


@query(f"WITH r AS (SELECT target, variant, row_number() OVER (PARTITION BY target ORDER BY abs(r - 0.05) DESC, variant) AS k FROM (SELECT target, variant, avg(r2) AS r FROM {_TASKS} GROUP BY ALL)) SELECT target, string_agg(variant, ', ' ORDER BY k) AS top FROM r WHERE k <= 5 GROUP BY target")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _tasks(spark, sf_dir).groupBy("target", "variant").agg((F.avg("r2") - 0.05).alias("weight"))
    return tables.top_names(means, ("target",), "weight", "variant")


@query("SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 4) AS p{str(p).replace('.', '_')}" for p in (1, 5, 75, 95, 99, 99.7)) + " FROM events GROUP BY ALL")
def percentile_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [F.percentile("value", F.lit(p / 100)).alias(f"p{str(p).replace('.', '_')}") for p in (1, 5, 75, 95, 99, 99.7)]
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(*found))


@query(
    """SELECT event_type, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(avg(pow(value - m, 3)) / pow(var_pop(value), 1.5), 4) AS skewness, round(avg(pow(value - m, 4)) / pow(var_pop(value), 2) - 3, 4) AS kurtosis,
round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0 END), 4) AS missing_rate, count(DISTINCT user_id) AS users FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type"""
)
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.avg(F.when(F.col("value") > 100, 1.0).otherwise(0.0))
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"), rate.alias("missing_rate"), F.count_distinct("user_id").alias("users")))


@query(
    """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT min(n) AS lo, max(n) AS hi FROM c)
SELECT CAST(least(floor((n - lo) * 8 / (hi - lo)), 7) AS BIGINT) AS bin, count(*) AS tracks, CAST(sum(n) AS BIGINT) AS points FROM c, b GROUP BY ALL"""
)
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    bin_ = F.least(F.floor((F.col("n") - F.col("lo")) * 8 / (F.col("hi") - F.col("lo"))), F.lit(7).cast("long"))
    return counts.crossJoin(F.broadcast(ends)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("tracks"), F.sum("n").alias("points"))


_PAIRED = "SELECT l_returnflag AS target, l_extendedprice / 1000 AS truth, l_quantity * 1.6 AS guess FROM lineitem"


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("target"), (F.col("l_extendedprice") / 1000).alias("truth"), (F.col("l_quantity") * 1.6).alias("guess"))


@query(
    f"""SELECT target, count(*) AS n, round(1 - sum(pow(truth - guess, 2)) / (var_pop(truth) * count(*)), 4) AS r2, round(sqrt(avg(pow(truth - guess, 2))), 4) AS rmse, round(avg(abs(truth - guess)), 4) AS mae,
round(sqrt(avg(pow(truth - guess, 2))) / (max(truth) - min(truth)), 4) AS nrmse, round(avg(abs(truth - guess)) / (max(truth) - min(truth)), 4) AS nmae, round(corr(truth, guess), 4) AS corr FROM ({_PAIRED}) GROUP BY target"""
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model.metrics(_paired(spark, sf_dir), "truth", "guess", ("target",)))


@query(f"WITH m AS (SELECT avg(truth) AS g FROM ({_PAIRED}) WHERE target <> 'R') SELECT target, count(*) AS n, round(sqrt(avg(pow(truth - g, 2))), 4) AS rmse, round(avg(abs(truth - g)), 4) AS mae FROM ({_PAIRED}), m WHERE target = 'R' GROUP BY target")
def mean_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paired(spark, sf_dir)
    mean = rows.where("target <> 'R'").agg(F.avg("truth").alias("mean"))
    found = model.metrics(rows.where("target = 'R'").crossJoin(F.broadcast(mean)), "truth", "mean", ("target",))
    return rounded(found.select("target", "n", "rmse", "mae"))


@query(
    """SELECT round((coalesce(sum(pow(l_quantity - l_tax * 100, 2)) FILTER (l_linenumber < 4), 0) + sum(pow(l_discount - l_tax, 2))) / (count(*) FILTER (l_linenumber < 4) + count(*)), 4) AS mse, count(*) FILTER (l_linenumber < 4) + count(*) AS n FROM lineitem"""
)
def masked_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") < 4, F.col("l_quantity")).alias("a"), (F.col("l_tax") * 100).alias("ga"), F.col("l_discount").alias("b"), F.col("l_tax").alias("gb"))
    return rounded(model.masked_mse(rows, [("a", "ga"), ("b", "gb")]))


@query(
    """WITH t AS (SELECT avg(coalesce(CASE WHEN l_linenumber < 6 THEN l_quantity END, m)) AS mu, stddev_pop(coalesce(CASE WHEN l_linenumber < 6 THEN l_quantity END, m)) AS sd, any_value(m) AS m
  FROM lineitem, (SELECT median(l_quantity) FILTER (l_linenumber < 6) AS m FROM lineitem WHERE l_orderkey % 5 <> 0) WHERE l_orderkey % 5 <> 0)
SELECT l_orderkey % 5 AS fold, count(*) AS n, round(sum((coalesce(CASE WHEN l_linenumber < 6 THEN l_quantity END, m) - mu) / (sd + 1e-8)), 2) AS total FROM lineitem, t GROUP BY ALL"""
)
def normalised_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5).alias("fold"), F.when(F.col("l_linenumber") < 6, F.col("l_quantity")).alias("q"))
    done = model.normalised(rows.where("fold <> 0"), rows, ["q"])
    return rounded(done.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("total")), places=2)


def _modelled(spark: SparkSession, sf_dir: str, kind: str, grid: list[dict]) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("price"))  # noqa: E741
    rows = model.hash_split(l, "l_orderkey").withColumn("fold", model.fold_of(F.col("l_orderkey"), 5))
    done = model.fitted(rows.where("NOT is_test"), rows.where("is_test"), ["l_quantity", "l_discount", "l_tax"], "price", kind, grid, "fold")
    return rounded(model.metrics(done, "price", "prediction").where("n > 0"))


_DEAL = """SELECT g.k, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + n ELSE x END), CAST(list_position(load, list_min(load)) - 1 AS INTEGER)"""


@query(
    f"""WITH RECURSIVE g AS (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id DESC) AS k FROM events GROUP BY user_id),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load, CAST(NULL AS INTEGER) AS fold UNION ALL {_DEAL} FROM r JOIN g ON g.k = r.k + 1)
SELECT user_id, n, fold FROM r JOIN g USING (k)"""
)
def balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.balanced_folds(table(spark, sf_dir, "events"), "user_id")


_SOFT = lambda pull: f"sign({pull}) * greatest(abs({pull}) - alpha * ratio, 0) / (1 + alpha * (1 - ratio))"
_NET = f"""WITH RECURSIVE l AS (SELECT l_suppkey AS s, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b, CASE WHEN l_linenumber < 6 THEN CAST(l_tax AS DOUBLE) END AS c, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
g AS (SELECT s, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, s DESC) AS k FROM l WHERE s % 5 <> 0 GROUP BY s),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load, CAST(NULL AS INTEGER) AS fold UNION ALL {_DEAL} FROM r JOIN g ON g.k = r.k + 1),
tr AS MATERIALIZED (SELECT l.*, fold FROM l JOIN g USING (s) JOIN r USING (k)),
z AS (SELECT CAST(z AS INTEGER) AS z FROM unnest(range(-1, 5)) AS t(z)),
md AS MATERIALIZED (SELECT z, median(a) AS da, median(b) AS db, median(c) AS dc FROM z JOIN tr ON fold <> z GROUP BY z),
im AS MATERIALIZED (SELECT md.*, fold, coalesce(a, da) AS a, coalesce(b, db) AS b, coalesce(c, dc) AS c, y FROM tr, md),
st AS MATERIALIZED (SELECT z, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc, avg(y) AS my FROM im WHERE fold <> z GROUP BY z),
nm AS MATERIALIZED (SELECT z, fold, (a - ma) / sa AS x1, (b - mb) / sb AS x2, (c - mc) / sc AS x3, y - my AS v FROM im JOIN st USING (z)),
gm AS MATERIALIZED (SELECT z, avg(x1 * x2) AS g12, avg(x1 * x3) AS g13, avg(x2 * x3) AS g23, avg(x1 * v) AS q1, avg(x2 * v) AS q2, avg(x3 * v) AS q3 FROM nm WHERE fold <> z GROUP BY z),
cd AS (SELECT gm.*, pow(10.0, -4 + 5 * i / 19) AS alpha, ratio, 0 AS k, CAST(0 AS DOUBLE) AS w1, CAST(0 AS DOUBLE) AS w2, CAST(0 AS DOUBLE) AS w3 FROM gm, unnest(range(0, 20)) AS t(i), unnest([CAST(0.1 AS DOUBLE), 0.5, 0.9]) AS u(ratio)
  UNION ALL SELECT * EXCLUDE (w3), {_SOFT("(q3 - g13 * w1 - g23 * w2)")} FROM (SELECT * EXCLUDE (w2, w3), {_SOFT("(q2 - g12 * w1 - g23 * w3)")} AS w2, w3 FROM (
    SELECT z, g12, g13, g23, q1, q2, q3, alpha, ratio, k + 1 AS k, {_SOFT("(q1 - g12 * w2 - g13 * w3)")} AS w1, w2, w3 FROM cd WHERE k < 60))),
fi AS MATERIALIZED (SELECT * FROM cd WHERE k = 60),
sr AS (SELECT z, alpha, ratio, 1 - sum(pow(v - w1 * x1 - w2 * x2 - w3 * x3, 2)) / (var_pop(v) * count(*)) AS r2 FROM fi JOIN nm USING (z) WHERE fold = z GROUP BY ALL),
av AS MATERIALIZED (SELECT alpha, ratio, avg(r2) AS r2 FROM sr GROUP BY ALL),
be AS (SELECT fi.* FROM fi JOIN (SELECT alpha, ratio FROM av ORDER BY round(r2, 9) DESC, alpha, ratio LIMIT 1) USING (alpha, ratio) WHERE z = -1),
te AS (SELECT alpha, ratio, y AS truth, my + w1 * (coalesce(a, da) - ma) / sa + w2 * (coalesce(b, db) - mb) / sb + w3 * (coalesce(c, dc) - mc) / sc AS guess FROM l, be, md, st WHERE s % 5 = 0 AND md.z = -1 AND st.z = -1)"""


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with three features, one with missing values, in groups by supplier."""
    number = lambda c: F.col(c).cast("double").alias(c)
    return table(spark, sf_dir, "lineitem").select("l_suppkey", number("l_quantity"), number("l_discount"), F.when(F.col("l_linenumber") < 6, F.col("l_tax").cast("double")).alias("l_tax"), F.col("l_extendedprice").cast("double").alias("price"))


def _net(spark: SparkSession, sf_dir: str) -> regression.ElasticNet | None:
    train = regression.with_folds(_suppliers(spark, sf_dir).where("l_suppkey % 5 <> 0"), "l_suppkey")
    return regression.cross_validated(train, ["l_quantity", "l_discount", "l_tax"], "price")


@query(f"{_NET} SELECT round(alpha, 6) AS alpha, ratio, round(r2, 6) AS r2 FROM av")
def elastic_net_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _net(spark, sf_dir)
    return spark.createDataFrame([(round(a, 6), r, round(s, 6)) for a, r, s in net.scores] if net else [], "alpha double, ratio double, r2 double")


@query(
    f"""{_NET} SELECT round(any_value(alpha), 4) AS alpha, any_value(ratio) AS ratio, count(*) AS n, round(1 - sum(pow(truth - guess, 2)) / (var_pop(truth) * count(*)), 4) AS r2, round(sqrt(avg(pow(truth - guess, 2))), 4) AS rmse,
  round(avg(abs(truth - guess)), 4) AS mae, round(sqrt(avg(pow(truth - guess, 2))) / (max(truth) - min(truth)), 4) AS nrmse, round(avg(abs(truth - guess)) / (max(truth) - min(truth)), 4) AS nmae, round(corr(truth, guess), 4) AS corr FROM te"""
)
def elastic_net_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _net(spark, sf_dir)
    tested = _suppliers(spark, sf_dir).where("l_suppkey % 5 = 0")
    # Without a net there is nothing to score.
    found = model.metrics(net.predicted(tested), "price", "prediction") if net else model.metrics(tested.where("false"), "price", "price").where("n > 0")
    return rounded(found.select(F.lit(net.alpha if net else None).cast("double").alias("alpha"), F.lit(net.ratio if net else None).cast("double").alias("ratio"), "*"))


@query()
def random_forest_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modelled(spark, sf_dir, "random_forest", [{"numTrees": 20, "maxDepth": 5}])


@query(
    """SELECT a.l_orderkey AS a, b.l_orderkey AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS distance FROM (SELECT l_orderkey, sum(l_quantity) AS x, sum(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY ALL) a
JOIN (SELECT l_orderkey, sum(l_quantity) AS x, sum(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY ALL) b ON a.l_orderkey < b.l_orderkey AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.5"""
)
def radius_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("x"), (F.sum("l_extendedprice") / 1000).alias("y"))
    return spatial.neighbours(p, 0.5).select("a", "b", E.quick_round(F.col("distance")).alias("distance"))


_BOXES = 'SELECT p_partkey AS id, p_retailprice * 10 AS top, p_partkey * 1.0 % 100 AS "left", p_retailprice * 10 + p_size * 0.5 AS bottom, p_partkey * 1.0 % 100 + 3 AS "right" FROM part'
_PAIRS = f'SELECT a.id AS a, b.id AS b FROM ({_BOXES}) a JOIN ({_BOXES}) b ON a.id < b.id AND a.top < b.bottom AND b.top < a.bottom AND a."left" < b."right" AND b."left" < a."right"'


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, left = F.col("p_retailprice") * 10, F.col("p_partkey") * 1.0 % 100
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), top.alias("top"), left.alias("left"), (top + F.col("p_size") * 0.5).alias("bottom"), (left + 3).alias("right"))


@query(_PAIRS)
def rect_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.overlapping(_boxes(spark, sf_dir), 25.0, across=3.0)


@query(
    f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_PAIRS}) UNION SELECT b, a FROM ({_PAIRS})),
r AS (SELECT p_partkey AS node, p_partkey AS label FROM part UNION SELECT e.b, r.label FROM r JOIN e ON r.node = e.a) SELECT node, min(label) AS label FROM r GROUP BY node"""
)
def overlap_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.overlap_labels(_boxes(spark, sf_dir), 25.0, across=3.0)


@query("SELECT s_suppkey, printf('cell_%03d', row_number() OVER (ORDER BY s_nationkey, s_acctbal, s_suppkey)) AS cell_id FROM supplier")
def spatial_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.numbered(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey", "s_acctbal", "s_suppkey")
    return found.select("s_suppkey", F.format_string("cell_%03d", "ordinal").alias("cell_id"))


@query("SELECT n_nationkey, s_suppkey, k::INTEGER AS place FROM (SELECT n_nationkey, s_suppkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE k <= 5")
def topk_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey").join(n, "n_nationkey")
    place = F.row_number().over(Window.partitionBy("n_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return s.select("n_nationkey", "s_suppkey", place.alias("place")).where("place <= 5")


@query("SELECT n_nationkey, CAST((row_number() OVER (ORDER BY n_nationkey) - 1) % 3 AS INTEGER) AS worker FROM nation")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.round_robin(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", 3)


@query("SELECT n_name FROM nation WHERE n_name > 'C' ORDER BY n_name LIMIT 7")
def start_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.after_key(table(spark, sf_dir, "nation").select("n_name"), "n_name", "C", 7)


_LOG = """(SELECT user_id AS log, event_id AS line, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'Processing cell_' || CAST(value AS INTEGER) % 7 ELSE 'Finished cell_' || CAST(value AS INTEGER) % 7 || ' ok' END AS text FROM events)"""


@query(
    f"""WITH l AS (SELECT log, line, nullif(regexp_extract(text, '^Processing (\\S+)', 1), '') AS s, nullif(regexp_extract(text, '^Finished (\\S+)', 1), '') AS f FROM {_LOG})
SELECT log, arg_max(s, line) AS open_unit FROM l a WHERE s IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l b WHERE b.log = a.log AND b.f = a.s AND b.line > a.line) GROUP BY log"""
)
def log_last_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = (F.bround("value").cast("int") % 7).cast("string")
    text = F.when(F.col("event_type").isin("click", "view", "signup"), F.concat(F.lit("Processing cell_"), unit)).otherwise(F.concat(F.lit("Finished cell_"), unit, F.lit(" ok")))
    return tables.last_open(table(spark, sf_dir, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("line"), text.alias("text")), "log", "line", "text")


@query(
    """SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host, nullif(regexp_extract(url, '(\\d+)', 1), '') AS number, nullif(regexp_extract(url, '([^/]+)$', 1), '') AS tail,
trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM pages"""
)
def regex_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", E.matched(u, r"^https?://([^/]+)").alias("host"), E.matched(u, r"(\d+)").alias("number"), E.matched(u, r"([^/]+)$").alias("tail"), E.slug(u).alias("slug"))


@query("SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CASE WHEN contains(lower(p), 'green') THEN 'G' WHEN contains(lower(p), 'red') THEN 'R' WHEN contains(lower(p), 'purple') THEN 'P' ELSE 'X' END AS channel FROM supplier JOIN (SELECT p_partkey, p_name AS p FROM part) ON s_suppkey = p_partkey")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", E.slug(F.col("s_name")).alias("slug"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("s_suppkey"), E.channel_letter(F.col("p_name")).alias("channel"))
    return s.join(p, "s_suppkey")


@query(
    """SELECT doc_id, CASE WHEN NOT coalesce(n_chars > 200, false) THEN 'too_short' WHEN NOT contains(lower(text), 'the') THEN 'token_the' WHEN NOT (contains(lower(text), 'ing') OR contains(lower(text), 'ion')) THEN 'any_token'
WHEN NOT coalesce(lang = 'en', false) THEN 'lang' END AS failure FROM documents"""
)
def profile_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    rules = [("too_short", F.col("n_chars") > 200), ("token_the", F.forall(F.array(F.lit("the")), lambda t: F.contains(low, t))), ("any_token", F.exists(F.array(F.lit("ing"), F.lit("ion")), lambda t: F.contains(low, t))), ("lang", F.col("lang") == "en")]
    return table(spark, sf_dir, "documents").select("doc_id", quality.first_failure(rules).alias("failure"))


@query(
    """WITH c AS (SELECT p_partkey AS crop_key, p_name AS crop, p_brand AS profile, CASE WHEN p_size % 3 = 0 THEN 'TYX' ELSE 'TCYX' END AS axes, CAST(p_size % 4 + 1 AS INTEGER) AS n, string_split(p_name, ' ') AS names FROM part),
k AS (SELECT DISTINCT p_brand AS profile FROM part WHERE p_brand NOT LIKE '%1')
SELECT crop_key, CASE WHEN k.profile IS NULL THEN 'profile' WHEN axes <> 'TCYX' THEN 'axes' WHEN n <> 2 THEN 'channel count' WHEN NOT coalesce(contains(lower(names[1]), 'e'), false) THEN 'raw C0'
  WHEN NOT coalesce(contains(lower(names[2]), 'a') OR contains(lower(names[2]), 'o'), false) THEN 'raw C1' WHEN NOT (contains(lower(crop), 'e') AND (contains(lower(crop), 'i') OR contains(lower(crop), 'u'))) THEN 'file tokens' END AS failure
FROM c LEFT JOIN k USING (profile)"""
)
def crop_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    crops = p.select("p_partkey", F.col("p_name").alias("crop"), F.col("p_brand").alias("profile"), F.when(F.col("p_size") % 3 == 0, "TYX").otherwise("TCYX").alias("axes"), (F.col("p_size") % 4 + 1).cast("int").alias("n_channels"), F.split("p_name", " ").alias("channel_names"))
    text = lambda *some: F.array(*map(F.lit, some))
    channel = lambda raw, *tokens: F.struct(F.lit(raw).alias("raw"), F.lit(f"C{raw}").alias("name"), F.lit("").alias("prefix"), text(*tokens).alias("tokens"))
    known = p.where("p_brand NOT LIKE '%1'").select(F.col("p_brand").alias("profile")).distinct()
    known = known.withColumns({"axes": F.lit("TCYX"), "channels": F.array(channel(0, "E"), channel(1, "a", "o")), "file_all": text("e"), "file_any": text("I", "u")})
    return profiles.validated(crops, known).select(F.col("p_partkey").alias("crop_key"), "failure")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderkey = o.o_orderkey AND d.o_orderstatus = 'F' AND d.o_orderkey % 3 <> 0 AND d.o_custkey % 2 = 0)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    work = o.select("o_orderkey", (F.col("o_custkey") % 2).alias("version"), F.lit(None).cast("int").alias("radius"))
    done = o.select("o_orderkey", F.lit(0).cast("long").alias("version"), F.lit(None).cast("int").alias("radius"), F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 != 0), "complete").otherwise("failed").alias("status"))
    return tables.pending(work, done, ("o_orderkey",), ("version", "radius")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) >= 4)")
def checkpoint_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return tables.unfinished_configs(table(spark, sf_dir, "orders").select("o_orderkey"), metrics, ("o_orderkey",), "l_linenumber", 4)


@query("SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n, sum(CASE WHEN lower(n_name) IN ('true', '1', 'yes', 'y') THEN 1 ELSE 0 END)::BIGINT AS truths, round(sum(coalesce(try_cast(substr(n_name, 1, 1) AS DOUBLE), 0)), 4) AS numbers FROM nation GROUP BY ALL")
def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return rounded(n.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(quality.as_bool(F.col("n_name"))).alias("truths"), F.sum(quality.safe_number(F.substring("n_name", 1, 1))).alias("numbers")))
