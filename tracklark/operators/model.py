"""Grouped splits, regression baselines and their metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_split(rows: DataFrame, group: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test, the same for all rows of a group: the default, as it needs no list of groups."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(group).cast("string")), F.lit(10_000))
    return rows.withColumn("is_test", place < int(test_share * 10_000))


def shuffled_split(rows: DataFrame, group: str, test_share: float = 0.2, seed: int = 42, most_groups: int = 1_000_000) -> DataFrame:
    """Adds is_test by a seeded permutation of the sorted groups, ceil(share * n) of them for testing. The groups come to
    the driver, so more than `most_groups` are refused; use `hash_split` there."""
    names = [r[0] for r in rows.select(group).where(F.col(group).isNotNull()).distinct().limit(most_groups + 1).collect()]
    if len(names) > most_groups:
        raise ValueError(f"more than {most_groups} groups")
    names.sort()
    chosen = np.random.RandomState(seed).permutation(len(names))[: int(np.ceil(test_share * len(names)))]
    kind = rows.schema[group].dataType.simpleString()
    test = rows.sparkSession.createDataFrame([(names[k],) for k in chosen], f"{group} {kind}").withColumn("is_test", F.lit(True))
    return rows.join(test, group, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def disjoint(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """One row with the number of groups that both sides have, which should be 0."""
    return train.select(group).intersect(test.select(group)).agg(F.count(F.lit(1)).alias("shared_groups"))


def fold_of(group: Column, folds: int, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), group.cast("string")), F.lit(folds)).cast("int")


def inner_holdout(train: DataFrame, group: str, share: float = 0.1, seed: int = 7) -> DataFrame:
    """Adds is_validation, the same for all rows of a group: what early stopping or a choice of parameters looks at."""
    return hash_split(train, group, share, seed).withColumnRenamed("is_test", "is_validation")


def elastic_grid() -> list[dict]:
    """20 strengths from 1e-4 to 10, evenly in logarithm, for each of three mixtures."""
    return [{"regParam": float(10 ** (-4 + 5 * k / 19)), "elasticNetParam": e} for k in range(20) for e in (0.1, 0.5, 0.9)]


def forest_grid(configurations: int = 8, seed: int = 42) -> list[dict]:
    """Random configurations of a forest; unlimited depth is 30, the most that Spark grows."""
    draw = np.random.RandomState(seed)
    pick = lambda some: some[draw.randint(len(some))]
    return [{"numTrees": pick([100, 200]), "maxDepth": pick([30, 5, 10, 20]), "minInstancesPerNode": pick([1, 2, 3, 5]), "featureSubsetStrategy": pick(["sqrt", "log2", "0.5", "0.75"])} for _ in range(configurations)]


def metrics(rows: DataFrame, truth: str, guess: str, by: tuple[str, ...] = ()) -> DataFrame:
    """r2, rmse, mae, both over the truth's range, and correlation over rows that have both values; null below two rows,
    and r2 and correlation null without variation."""
    known = rows.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    error = F.col(truth) - F.col(guess)
    sums = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(error * error).alias("sse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.var_pop(truth) * F.count(F.lit(1))).alias("sst"),
        (F.max(truth) - F.min(truth)).alias("span"),
        F.covar_pop(truth, guess).alias("cov"),
        (F.stddev_pop(truth) * F.stddev_pop(guess)).alias("dev"),
    )
    enough = lambda c: F.when(F.col("n") >= 2, c)
    rmse = F.sqrt(F.col("sse") / F.col("n"))
    return sums.select(
        *by,
        "n",
        enough(1 - F.when(F.col("sst") > 0, F.col("sse") / F.col("sst"))).alias("r2"),
        enough(rmse).alias("rmse"),
        enough(F.col("mae")).alias("mae"),
        enough(F.when(F.col("span") > 0, rmse / F.col("span"))).alias("nrmse"),
        enough(F.when(F.col("span") > 0, F.col("mae") / F.col("span"))).alias("nmae"),
        enough(F.when(F.col("dev") > 0, F.col("cov") / F.col("dev"))).alias("corr"),
    )


def masked_mse(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Mean squared error over all known values of several targets at once."""
    known = lambda t, g: F.when(F.col(t).isNotNull() & F.col(g).isNotNull(), (F.col(t) - F.col(g)) * (F.col(t) - F.col(g)))
    total = sum((F.coalesce(F.sum(known(t, g)), F.lit(0.0)) for t, g in pairs[1:]), F.coalesce(F.sum(known(*pairs[0])), F.lit(0.0)))
    count = sum((F.count(known(t, g)) for t, g in pairs[1:]), F.count(known(*pairs[0])))
    return rows.agg(F.try_divide(total, count).alias("mse"), count.alias("n"))


def normalised(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values replaced by the training median, then training mean taken off and its population deviation divided
    out (plus 1e-8, so constant columns give 0)."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    medians = train.agg(*[F.median(clean(c)).alias(f"{c}_median") for c in columns])
    filled = lambda df: df.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(clean(c), F.col(f"{c}_median")) for c in columns})
    stats = filled(train).agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])
    out = filled(rows).crossJoin(F.broadcast(stats))
    return out.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / (F.col(f"{c}_std") + 1e-8) for c in columns}).select(*rows.columns)


def fitted(train: DataFrame, test: DataFrame, features: list[str], target: str, kind: str = "elastic_net", grid: list[dict] | None = None, fold: str | None = None, seed: int = 42) -> DataFrame:
    """Test rows with column `prediction`: median imputation, standard scaling and an elastic net or random forest whose
    parameters a grouped cross-validation picks from `grid`. Rows without a target take no part; without rows to learn from
    there are no predictions."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator

    known = F.col(target).isNotNull()
    imputed = [f"{c}_imputed" for c in features]
    if kind == "elastic_net":
        learner = LinearRegression(featuresCol="scaled", labelCol=target, maxIter=50)
        grid = grid or [{"regParam": r, "elasticNetParam": e} for r in (0.01, 0.1, 1.0) for e in (0.1, 0.5, 0.9)]
    else:
        learner = RandomForestRegressor(featuresCol="scaled", labelCol=target, seed=seed)
        grid = grid or [{"numTrees": n, "maxDepth": d} for n in (20, 50) for d in (5, 8)]
    stages = [Imputer(inputCols=features, outputCols=imputed, strategy="median"), VectorAssembler(inputCols=imputed, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), learner]
    flow = Pipeline(stages=stages)
    maps = [{learner.getParam(k): v for k, v in one.items()} for one in grid]
    rows = train.where(known)
    if rows.isEmpty():
        return test.where("false").withColumn("prediction", F.lit(None).cast("double"))
    if len(maps) == 1:
        model = flow.fit(rows, maps[0])
    else:
        search = CrossValidator(estimator=flow, estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol=target, metricName="r2"), numFolds=5, seed=seed, **({"foldCol": fold} if fold else {}))
        model = search.fit(rows).bestModel
    return model.transform(test.where(known)).drop("raw", "scaled", *imputed)
