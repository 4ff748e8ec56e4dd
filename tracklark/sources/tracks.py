"""Sources of tracks, tables and nested metadata, with keys taken from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklark.functions import expressions as E
from tracklark.operators.quality import need
from tracklark.operators.steps import last_wins

# The columns of the two track formats and of the name mapping, and patterns in file names.
TRACK = "frame DOUBLE, x_nm DOUBLE, y_nm DOUBLE"
LOCALISATIONS = "id DOUBLE, frame DOUBLE, x_nm DOUBLE, y_nm DOUBLE, sigma DOUBLE, intensity DOUBLE, offset DOUBLE, bkgstd DOUBLE, uncertainty DOUBLE"
MAPPING = "Nuc_num STRING, source_subsub_directory STRING, original_filename STRING, new_filename STRING"
LOCUS, NUMBER, CHANNEL, MASK_NAME, STEM_INDEX = r"loci(\d+)", r"traj(\d+)", r"([^/])[^/]*$", r"([^/]+)_mask_(\d+)\.tif$", r"([^/]+)_(\d+)\.[^./]+$"


def path() -> Column:
    """The file's path, with escapes such as %20 undone."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def keys(at: Column) -> dict[str, Column]:
    """Channel, locus and candidate number in a track's path; null where there is none."""
    return {"channel": E.matched(at, CHANNEL), "locus": E.matched(at, LOCUS).cast("int"), "number": E.matched(at, NUMBER).cast("int"), "analysis": E.matched(at, r"analysis_(\d+)").cast("int")}


def read_tracks(spark: SparkSession, *paths: str, keep_last: bool = True) -> DataFrame:
    """Points of all track files: keys, file, frame (1-based), x, y. A byte-order mark, either line end and frames such
    as 3.0 are accepted; of rows that repeat a frame the last in the file counts."""
    rows = spark.read.schema(TRACK).option("header", True).option("enforceSchema", True).csv(list(paths))
    at = path()
    rows = rows.select(at.alias("file"), F.col("frame").cast("int").alias("frame"), F.col("x_nm").alias("x"), F.col("y_nm").alias("y"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("row"))
    rows = rows.where("frame IS NOT NULL")
    if keep_last:
        rows = last_wins(rows, "row", ("file",))
    return rows.withColumns(keys(F.col("file"))).drop("row")


def read_localisations(spark: SparkSession, *paths: str) -> DataFrame:
    """Points of the nine-column format, with the columns of `read_tracks` and sigma, intensity and uncertainty."""
    rows = spark.read.schema(LOCALISATIONS).option("header", True).option("enforceSchema", True).csv(list(paths))
    return rows.select(path().alias("file"), F.col("frame").cast("int").alias("frame"), F.col("x_nm").alias("x"), F.col("y_nm").alias("y"), "sigma", "intensity", "uncertainty").withColumns(keys(F.col("file")))


def read_any_tracks(spark: SparkSession, three_columns: list[str], nine_columns: list[str]) -> DataFrame:
    """Both formats in one table; what a format lacks is null."""
    parts = [f(spark, *some) for f, some in ((read_tracks, three_columns), (read_localisations, nine_columns)) if some]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def read_mixed_tracks(spark: SparkSession, *paths: str) -> DataFrame:
    """Both formats, told apart by the number of columns of each line; the columns of `read_localisations`."""
    lines = spark.read.text(list(paths)).select(path().alias("file"), F.split(F.regexp_replace("value", "[\\r\\uFEFF]", ""), ",").alias("c"))
    number = lambda k: F.try_element_at("c", F.lit(k)).try_cast("double")
    nine = F.size("c") >= 9
    pick = lambda three, many: F.when(nine, number(many)).otherwise(number(three))
    only = lambda k: F.when(nine, number(k))
    rows = lines.where((F.size("c") == 3) | nine).select("file", pick(1, 2).cast("int").alias("frame"), pick(2, 3).alias("x"), pick(3, 4).alias("y"), only(5).alias("sigma"), only(6).alias("intensity"), only(9).alias("uncertainty"))
    return rows.where("frame IS NOT NULL").withColumns(keys(F.col("file")))


def in_pixels(points: DataFrame, pixel_nm: float, origin: float = 1.0) -> DataFrame:
    """x and y in pixels. `origin` is the coordinate of the first pixel's centre in the file, which becomes 0."""
    return points.withColumns({c: F.col(c) / pixel_nm - origin for c in ("x", "y")})


def preferred_files(files: DataFrame) -> DataFrame:
    """Of files (file) that describe the same channel and locus in a folder, the cleaned one, else the pipeline's, else any."""
    rank = F.when(F.col("file").endswith("_cleaned.csv"), 0).when(F.col("file").contains("_traj_"), 1).otherwise(2)
    found = files.withColumns(keys(F.col("file"))).withColumn("folder", E.matched(F.col("file"), r"^(.*)/[^/]*$"))
    order = Window.partitionBy("folder", "channel", "locus").orderBy(rank, "file")
    return found.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def read_sidecars(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """Nested JSON files, one row each, with their path."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(list(paths)).withColumn("file", path())


def read_mapping(spark: SparkSession, *paths: str) -> DataFrame:
    return need(spark.read.schema(MAPPING).option("header", True).csv(list(paths)), "Nuc_num", "original_filename")


def resolved(first: Column, *others: Column, what: str | None = None) -> Column:
    """The first that is not null; an error naming `what` if all are null and it is given."""
    found = F.coalesce(first, *others)
    return F.coalesce(found, F.raise_error(F.lit(f"no {what}"))) if what else found


def pixel_size_nm(tiff: Column, sidecar_um: Column, argument: float | None) -> Column:
    """The TIFF's size, else the sidecar's, else the given one; rows with null are to be skipped."""
    return F.coalesce(tiff, sidecar_um * 1000, F.lit(argument))


def tracking_failures(meta: DataFrame) -> DataFrame:
    """meta (file, interval, um_x, um_y, unit, frames, channel) with `failure`: the first broken rule, null if valid. All
    channels of a file have to agree with its first channel."""
    from tracklark.operators.quality import first_failure

    w = Window.partitionBy("file").orderBy("channel").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    close = lambda a, b, rel, least: F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(least))
    canon = lambda c: F.first(c).over(w)
    rows = meta.withColumns({f"first_{c}": canon(c) for c in ("interval", "um_x", "frames")})
    rules = [
        ("interval", F.col("interval") > 0),
        ("isotropic", close(F.col("um_x"), F.col("um_y"), 1e-6, 0.0)),
        ("unit", E.unit_text(F.col("unit")) == "um"),
        ("same_interval", close(F.col("interval"), F.col("first_interval"), 1e-9, 1e-12)),
        ("same_pixel", close(F.col("um_x"), F.col("first_um_x"), 1e-9, 1e-12)),
        ("same_frames", F.col("frames") == F.col("first_frames")),
    ]
    return rows.withColumn("failure", first_failure(rules)).drop("first_interval", "first_um_x", "first_frames")
