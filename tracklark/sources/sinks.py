"""Sinks. All write through Spark, so a failed task leaves nothing behind and results can be on any store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The given fields in their order; an empty table gives files without a header."""
    df.select(*fields).write.mode("overwrite").option("header", not df.isEmpty()).csv(path)


def key_union(*parts: DataFrame) -> DataFrame:
    """All rows with the columns of all parts, in order of first appearance."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def write_by_entity(df: DataFrame, path: str, *entity: str) -> None:
    """A folder for each entity, rewritten as a whole if it occurs in `df`; other entities stay."""
    df.repartition(*entity).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*entity).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON text for each row: manifests and audits."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
