"""Merges, roll-ups, comparison tables and resume logic over feature, metric and status tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklark.operators.quality import first_failure
from tracklark.session import materialize


def renamed(df: DataFrame, keys: tuple[str, ...], taken: list[str], suffix: str) -> DataFrame:
    """Columns of `df` that `taken` also has get a suffix, keys excepted."""
    return df.select(*[F.col(c).alias(c + suffix if c in taken and c not in keys else c) for c in df.columns])


def merge_first(rows: DataFrame, children: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], suffix: str) -> DataFrame:
    """Left join with each key's first child row by `order`."""
    others = [c for c in children.columns if c not in keys]
    first = children.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("f")).select(*keys, "f.*")
    return rows.join(renamed(first, keys, rows.columns, suffix), list(keys), "left")


def merge_aggregate(rows: DataFrame, children: DataFrame, keys: tuple[str, ...], how: str, suffix: str, having: int = 0) -> DataFrame:
    """Left join with the mean or median of each numeric child column; groups of fewer than `having` rows are left out."""
    numeric = [f.name for f in children.schema if f.name not in keys and f.dataType.typeName() in {"double", "float", "long", "integer", "short", "byte"}]
    f = {"mean": F.avg, "median": F.median}[how]
    found = children.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[f(c).alias(c) for c in numeric])
    return rows.join(renamed(found.where(F.col("n_rows") >= having), keys, rows.columns, suffix), list(keys), "left")


def override(*sources: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of all sources; a later source replaces the rows of earlier ones that have its key."""
    both = sources[0].withColumn("_source", F.lit(0))
    for k, df in enumerate(sources[1:], 1):
        both = both.unionByName(df.withColumn("_source", F.lit(k)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in {*keys, "_source"}]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*others), "_source").alias("last")).select(*keys, "last.*")


def canonical(rows: DataFrame, canon: DataFrame, key: str, number: str) -> DataFrame:
    """Rows whose number is the canonical one of their key, or whose key has none."""
    return rows.join(canon.select(key, F.col(number).alias("_canon")), key, "left").where(F.col("_canon").isNull() | (F.col("_canon") == F.col(number))).drop("_canon")


def status_counts(rows: DataFrame, by: tuple[str, ...], status: str) -> DataFrame:
    """A map of how often each status occurs."""
    counts = rows.groupBy(*by, status).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "n")))).alias("counts"))


def roll_up(rows: DataFrame, by: tuple[str, ...], complete: Column, value: str, duration: str) -> DataFrame:
    """Counts of rows and complete rows, the sum of a value over complete ones, the median of positive durations (0 if none)."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(complete).alias("complete"),
        F.coalesce(F.sum(F.when(complete, F.col(value))), F.lit(0)).alias("value_sum"),
        F.coalesce(F.median(F.when(F.col(duration) > 0, F.col(duration))), F.lit(0.0)).alias("median_duration"),
    )


def full_roll_up(rows: DataFrame, by: tuple[str, ...], unit: str, status: str, value: str, duration: str, finished: str, flagged: Column) -> DataFrame:
    """What a batch report says of each group: `roll_up` for the status `complete`, and the counts and sorted lists of
    failed and running units, how many units are flagged (bad quality), the sum of positive durations to one decimal, the
    latest text of `finished` that isn't empty ('' if none), and a map of all statuses.

    The lists are as long as a group has such units; all else is summed before the shuffle.
    """
    is_ = lambda name: F.col(status) == name
    listed = lambda name: F.array_sort(F.collect_list(F.when(is_(name), F.col(unit))))
    more = rows.groupBy(*by).agg(
        F.count_if(is_("failed")).alias("failed"),
        F.count_if(is_("running")).alias("running"),
        F.count_if(F.coalesce(flagged, F.lit(False))).alias("flagged"),
        F.round(F.coalesce(F.sum(F.when(F.col(duration) > 0, F.col(duration))), F.lit(0.0)), 1).alias("total_duration"),
        F.coalesce(F.max(F.nullif(F.col(finished), F.lit(""))), F.lit("")).alias("last_finished"),
        listed("failed").alias("failed_units"),
        listed("running").alias("running_units"),
    )
    out = roll_up(rows, by, is_("complete"), value, duration).join(more, list(by))
    return out.join(status_counts(rows, by, status), list(by))


def mean_and_spread(rows: DataFrame, by: tuple[str, ...], metrics: tuple[str, ...], sample: bool = True) -> DataFrame:
    """Mean and deviation (of a sample or of the population) of each metric."""
    spread = F.stddev_samp if sample else F.stddev_pop
    return rows.groupBy(*by).agg(*[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), spread(m).alias(f"{m}_std"))])


def mean_text(mean: Column, std: Column, places: int = 3) -> Column:
    """mean±std, or a dash without a mean."""
    return F.when(mean.isNull(), "—").otherwise(F.format_string(f"%.{places}f±%.{places}f", mean, F.coalesce(std, F.lit(0.0))))


def best_of(rows: DataFrame, by: str, metric: str, name: str, without: str) -> DataFrame:
    """The row of each group with the highest metric, a named baseline left out; ties by name."""
    order = Window.partitionBy(by).orderBy(F.desc_nulls_last(metric), name)
    return rows.where(F.col(name) != without).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def top_names(rows: DataFrame, by: tuple[str, ...], weight: str, name: str, n: int = 5) -> DataFrame:
    """The names of the n largest absolute weights of each group as one text, largest first."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.abs(weight)), name)
    top = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return top.groupBy(*by).agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("place", name))), lambda s: s[name])).alias("top"))


def pivoted(rows: DataFrame, row: str, column: str, values: list[str], metric: str) -> DataFrame:
    """One column for each of the given values; named up front, so no extra job finds them."""
    return rows.groupBy(row).pivot(column, values).agg(F.first(metric))


def delta(rows: DataFrame, by: tuple[str, ...], variant: str, plain: str, changed: str, metric: str) -> DataFrame:
    """The metric of two variants side by side and its change."""
    pick = lambda v: F.avg(F.when(F.col(variant) == v, F.col(metric)))
    return rows.groupBy(*by).agg(pick(plain).alias("plain"), pick(changed).alias("changed")).withColumn("delta", F.col("changed") - F.col("plain"))


def pending(work: DataFrame, done: DataFrame, keys: tuple[str, ...], options: tuple[str, ...], status: str = "complete") -> DataFrame:
    """Work that no complete manifest row with equal options covers."""
    same = [work[k] == done[k] for k in keys] + [work[o].eqNullSafe(done[o]) for o in options]
    return work.join(done.where(F.col("status") == status), same, "left_anti")


def unfinished_configs(configs: DataFrame, metrics: DataFrame, keys: tuple[str, ...], target: str, n_targets: int) -> DataFrame:
    """Configurations without metrics for all targets."""
    done = metrics.groupBy(*keys).agg(F.count_distinct(target).alias("n")).where(F.col("n") >= n_targets)
    return configs.join(done, list(keys), "left_anti")


def last_open(log: DataFrame, by: str, order: str, text: str, start: str = r"^Processing (\S+)", end: str = r"^Finished (\S+)") -> DataFrame:
    """For each log the last unit that was started and not finished later."""
    marked = log.select(by, order, F.nullif(F.regexp_extract(text, start, 1), F.lit("")).alias("started"), F.nullif(F.regexp_extract(text, end, 1), F.lit("")).alias("ended"))
    ends = marked.where("ended IS NOT NULL").groupBy(by, F.col("ended").alias("started")).agg(F.max(order).alias("ended_at"))
    left = marked.where("started IS NOT NULL").join(ends, [by, "started"], "left").where(F.col("ended_at").isNull() | (F.col("ended_at") < F.col(order)))
    return left.groupBy(by).agg(F.max_by("started", order).alias("open_unit"))


def after_key(rows: DataFrame, key: str, start_after: str | None, most: int | None) -> DataFrame:
    """Rows strictly after a key, and of them the first few."""
    some = rows if start_after is None else rows.where(F.col(key) > start_after)
    return some if most is None else some.orderBy(key).limit(most)


def round_robin(rows: DataFrame, order: str, groups: int) -> DataFrame:
    """Deals the rows of a small dimension to `groups` workers in turn."""
    return rows.withColumn("worker", F.pmod(F.row_number().over(Window.orderBy(order)) - 1, F.lit(groups)))


def without_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have at least one of the columns (NaN counts as missing)."""
    return df.dropna("all", subset=columns)


def with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(F.startswith(F.col(column), F.lit(prefix)))


def model_columns(df: DataFrame, wanted: list[str], leaky: list[str]) -> tuple[list[str], list[str]]:
    """The wanted columns without the leaky ones, and the leaky ones present; an error that names those missing."""
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return [c for c in wanted if c not in leaky], [c for c in leaky if c in df.columns]


def first_lookup(rows: DataFrame, dimension: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Adds the dimension's first value by `order` for each key, null without one."""
    first = dimension.groupBy(key).agg(F.min_by(value, order).alias(value))
    return rows.join(first, key, "left")


def numbered(rows: DataFrame, *order: str, name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """Adds each row's place (from 1) in an order over all rows, without a task that sees them all.

    Rows are dealt to tasks by ranges of the order and written once to the shared folder; a small table of rows for each
    range gives what comes before it.
    """
    ranged = rows.repartitionByRange(*((parts,) if parts else ()), *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    held, _ = materialize(ranged)
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    found = held.join(F.broadcast(before.drop("_n")), "_part")
    return found.withColumn(name, F.col("_before") + F.col("_row") - F.col("_first") + 1).drop("_part", "_row", "_before", "_first")


def dry_run(units: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds whether each unit of work would be taken, and the first rule that speaks against it."""
    return units.withColumn("reason", first_failure(rules)).withColumn("accepted", F.col("reason").isNull())


def running_summary(runs: DataFrame, by: tuple[str, ...], order: tuple[str, ...], failed: Column) -> DataFrame:
    """The summary after each completion: how many units are done and how many failed so far."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.withColumns({"done": F.count(F.lit(1)).over(w), "failures": F.count_if(failed).over(w)})
