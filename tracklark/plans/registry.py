"""Registers queries with their SQL and holds the views of the tables that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklark.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) by its name, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *keep: str, places: int = 4) -> DataFrame:
    """All double columns but those named, rounded."""
    return df.select(*[F.round(c, places).alias(c) if k == "double" and c not in keep else F.col(c) for c, k in df.dtypes])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track points of the events: track_id, frame (order of time), x, y, channel."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("track_id"), F.row_number().over(order).alias("frame"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.col("event_type").alias("channel"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track points by hour, with gaps: the last event of an hour wins. Columns track_id, channel, frame, x, y."""
    e = table(spark, sf_dir, "events")
    hour = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).cast("long")
    rows = e.select(F.col("user_id").alias("track_id"), F.col("event_type").alias("channel"), hour.alias("hour"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.struct("ts", "event_id").alias("at"))
    first = F.floor(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) / F.lit(3_600_000_000)).cast("long")
    return rows.groupBy("track_id", "channel", (F.col("hour") - first + 1).cast("int").alias("frame")).agg(F.max_by("x", "at").alias("x"), F.max_by("y", "at").alias("y"))


#: The same views as common table expressions.
POINTS = """p AS (SELECT user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS frame, value AS x,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type AS channel FROM events)"""
STEPS = (
    POINTS
    + """, d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
s AS (SELECT *, sqrt(dx * dx + dy * dy) AS step FROM d)"""
)
ANGLES = (
    STEPS
    + """, t AS (SELECT *, lag(dx) OVER w AS bx, lag(dy) OVER w AS by_ FROM s WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
a AS (SELECT *, CASE WHEN sqrt(bx * bx + by_ * by_) * step > 0
  THEN acos(greatest(-1.0, least(1.0, (bx * dx + by_ * dy) / nullif(sqrt(bx * bx + by_ * by_) * step, 0)))) END AS angle FROM t)"""
)
HOURLY = """h AS (SELECT user_id AS track_id, event_type AS channel, CAST(floor(epoch_us(ts) / 3600000000) - floor(epoch_us(TIMESTAMP '2024-01-01') / 3600000000) + 1 AS INTEGER) AS frame,
  arg_max(value, (ts, event_id)) AS x, arg_max(CAST(json_extract_string(props, '$.k') AS DOUBLE), (ts, event_id)) AS y FROM events GROUP BY ALL)"""
