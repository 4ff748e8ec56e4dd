"""Discovery of mask files and the mask of a crop, on tables of paths.

Paths are listed by Spark (`paths`), so a store that only Spark reads works as well; what belongs together is found by
keys in the names and by joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.functions.expressions import matched
from tracklark.sources.tracks import path

# Patterns of names of masks, their folders and crops.
MASK, SET, FOLDER, CROP = r"/([^/]+)_mask_(\d+)\.tif$", r"/([^/]*all nd2[^/]*)/[^/]+/[^/]+$", r"/([^/]+)/[^/]+$", r"/([^/]+)_(\d+)\.tif$"


def paths(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """The paths of all files below a folder whose names match, without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select(path().alias("file"))


def mask_files(files: DataFrame) -> DataFrame:
    """Mask files in folders of sets, with their set, experiment, stem and index, and the metadata file beside them, null
    without one. files: file."""
    at = F.col("file")
    folder = matched(at, r"^(.*)/[^/]*$")
    masks = files.select("file", matched(at, SET).alias("nd2_set"), matched(at, FOLDER).alias("experiment"), matched(at, MASK).alias("stem"), matched(at, MASK, 2).cast("int").alias("nucleus_idx"), folder.alias("folder"))
    masks = masks.where("stem IS NOT NULL AND nd2_set IS NOT NULL")
    wanted = F.concat("folder", F.lit("/"), "stem", F.lit("_"), F.col("nucleus_idx").cast("string"), F.lit("_metadata.json"))
    there = files.select(at.alias("metadata"))
    return masks.withColumn("wanted", wanted).join(there, F.col("wanted") == F.col("metadata"), "left").drop("wanted", "folder")


def masks_of_crops(crops: DataFrame, files: DataFrame, sidecars: DataFrame, fail: bool = False) -> DataFrame:
    """Each crop's mask: the path in its sidecar, else the relative path there, else the name by the sidecar's stem and
    index, else by the crop's own; of these the first that is a file. Without one null, or an error with `fail`.

    crops: file; files: file; sidecars: file (`<crop>_metadata.json`), path, relative_path, stem, crop_index.
    """
    at = F.col("file")
    own = crops.select("file", matched(at, r"^(.*)/[^/]*$").alias("folder"), F.concat(matched(at, r"^(.*)\.[^./]*$"), F.lit("_metadata.json")).alias("sidecar"), matched(at, CROP).alias("own_stem"), matched(at, CROP, 2).alias("own_index"))
    rows = own.join(sidecars.withColumnRenamed("file", "sidecar"), "sidecar", "left")
    whole = lambda c: F.when(F.startswith(F.col(c), F.lit("/")), F.col(c)).otherwise(F.concat("folder", F.lit("/"), F.col(c)))
    name = lambda stem, index: F.concat("folder", F.lit("/"), stem, F.lit("_mask_"), F.col(index).cast("string"), F.lit(".tif"))
    tries = F.array(whole("path"), whole("relative_path"), name("stem", "crop_index"), name("own_stem", "own_index"))
    options = rows.select("file", F.posexplode(tries).alias("k", "mask")).where("mask IS NOT NULL")
    found = options.join(files.select(at.alias("mask")), "mask", "left_semi").groupBy("file").agg(F.min_by("mask", "k").alias("mask"), F.min("k").alias("source"))
    out = crops.select("file").join(found, "file", "left")
    return out.withColumn("mask", F.coalesce("mask", F.raise_error(F.concat(F.lit("no mask for "), "file")))) if fail else out
