"""Validation of crops against experiment profiles, a small dimension with nested channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklark.operators.quality import first_failure
from tracklark.session import small_enough

#: profile: its name; tokens of a channel and of the file are looked for without regard to case.
PROFILE = "profile string, axes string, channels array<struct<raw:int,name:string,prefix:string,tokens:array<string>>>, file_all array<string>, file_any array<string>"
CROP = "crop string, profile string, axes string, n_channels int, channel_names array<string>"


def validated(crops: DataFrame, profiles: DataFrame, most: int = 10_000) -> DataFrame:
    """`crops` with `failure`, the first broken rule: unknown profile, axes, number of channels, a raw channel whose name
    has none of its tokens (`raw C<k>`), or tokens missing in the file name; null if all hold."""
    dimension = profiles.select("profile", F.col("axes").alias("p_axes"), "channels", "file_all", "file_any")
    if small_enough(dimension, most):
        dimension = F.broadcast(dimension)
    rows = crops.join(dimension, "profile", "left")
    has = lambda text, token: F.contains(F.lower(text), F.lower(token))
    name = lambda c: F.get("channel_names", c["raw"])
    wrong = F.filter("channels", lambda c: ~F.coalesce(F.exists(c["tokens"], lambda t: has(name(c), t)), F.lit(False)))
    found = first_failure(
        [
            ("profile", F.col("channels").isNotNull()),
            ("axes", F.col("axes") == F.col("p_axes")),
            ("channel count", F.col("n_channels") == F.size("channels")),
            ("raw channel", F.size(wrong) == 0),
            ("file tokens", F.forall("file_all", lambda t: has(F.col("crop"), t)) & ((F.size("file_any") == 0) | F.exists("file_any", lambda t: has(F.col("crop"), t)))),
        ]
    )
    named = F.when(found == "raw channel", F.concat(F.lit("raw C"), (F.get(wrong, F.lit(0))["raw"]).cast("string"))).otherwise(found)
    return rows.select(*crops.columns, named.alias("failure"))


def channel_rows(profiles: DataFrame) -> DataFrame:
    """One row for each channel of each profile."""
    return profiles.select("profile", F.inline("channels"))
