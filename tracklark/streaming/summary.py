"""The summary of a batch run, rewritten as its units end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracklark.session import discard


def versions(spark: SparkSession, path: str) -> list[int]:
    """The batches after which the units' last states were written whole, in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/after=*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or ())


def latest(rows: DataFrame, unit: str, order: str) -> DataFrame:
    """The last completion of each unit; of several at one time the one with the greatest columns, so that it doesn't hang
    on the order of rows. Rows without a unit are left out."""
    every = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.where(F.col(unit).isNotNull()).groupBy(F.col(unit).alias("_unit")).agg(F.max_by(every, F.struct(F.col(order), every)).alias("row")).select("row.*")


def kept(batch: DataFrame, batch_id: int, path: str, unit: str, order: str) -> None:
    """Bring the units' last states up to date with a batch of completions.

    The states after a batch are those after the one before and the batch's rows, in a folder named by the batch. So a
    batch that is replayed rewrites its own folder from the same states and the result is the same; a write that breaks
    off has no success mark and is not read. Late and repeated completions change nothing. Folders before the last two
    are deleted.
    """
    spark = batch.sparkSession
    known = versions(spark, path)
    before = [v for v in known if v < batch_id]
    rows = batch
    if before:
        rows = spark.read.schema(batch.schema).parquet(f"{path}/after={before[-1]}").unionByName(batch)
    latest(rows, unit, order).write.mode("overwrite").parquet(f"{path}/after={batch_id}")
    discard(spark, *[f"{path}/after={v}" for v in before[:-1]])


def current(spark: SparkSession, path: str) -> DataFrame:
    """The units' states after the last batch that was written whole."""
    known = versions(spark, path)
    if not known:
        raise ValueError(f"no summary in {path} yet")
    return spark.read.parquet(f"{path}/after={known[-1]}")


def start(completions: DataFrame, path: str, checkpoint: str, unit: str, order: str, report: Callable[[DataFrame], DataFrame] | None = None, report_path: str | None = None, **trigger) -> StreamingQuery:
    """Keep the summary of a stream of completions (one row each time a unit ends) in `path`. After each batch `report`
    of all units' last states replaces what is in `report_path`; `trigger` is passed to the stream's trigger."""

    def run(batch: DataFrame, batch_id: int) -> None:
        kept(batch, batch_id, path, unit, order)
        if report and report_path:
            report(current(batch.sparkSession, path)).coalesce(1).write.mode("overwrite").option("header", True).csv(report_path)

    writer = completions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
