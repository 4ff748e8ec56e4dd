"""Session helpers shared by the library: table reading, shared scratch space and bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`, which may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` if the session has it, else the checkpoint folder in use.

    Without either, a local session gets a temporary folder and any other session an error: executors of a cluster do
    not see each other's disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracklark-"))
    return spark.sparkContext.getCheckpointDir()


#: Spark's setting to delete the shuffle files of a query at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> tuple[DataFrame, str]:
    """Write `df` as a Parquet table in the shared folder and read it back, which cuts the lineage; also its path.

    The table is all that is read later, so the shuffle files of the write go at once, not when the driver happens to
    collect its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that `materialize` wrote and nothing reads any longer."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether `df` has at most `most_rows` rows; reads no more than one row beyond that."""
    return df.limit(most_rows + 1).agg(F.count(F.lit(1))).first()[0] <= most_rows
