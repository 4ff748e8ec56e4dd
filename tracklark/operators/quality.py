"""Row rules: quality flags, ordered filters, validation, safe casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of the crop rule, and texts that count as true.
CONTRAST, GRADIENT = 0.085, 1.70
TRUE_TEXTS = ("true", "1", "yes", "y")


def need(df: DataFrame, *columns: str) -> DataFrame:
    """`df` if it has all columns; an error that names the missing ones if not."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def bad_qc(metrics: DataFrame, contrast: str = "ch0_contrast", gradient: str = "ch0_boundary_grad") -> DataFrame:
    """Adds bad_qc (both measures low; unknown ones are not) and the rule's text where it holds."""
    need(metrics, contrast, gradient)
    low = lambda c, most: F.coalesce((F.col(c) < most) & ~F.isnan(c), F.lit(False))
    rule = f"{contrast}<{CONTRAST} & {gradient}<{GRADIENT:.2f}"
    return metrics.withColumn("bad_qc", low(contrast, CONTRAST) & low(gradient, GRADIENT)).withColumn("rule", F.when(F.col("bad_qc"), rule))


def as_bool(column: Column) -> Column:
    return F.coalesce(F.lower(F.trim(column.cast("string"))).isin(*TRUE_TEXTS), F.lit(False))


def safe_number(column: Column, kind: str = "double") -> Column:
    """A number from text; blank or invalid text gives 0."""
    return F.coalesce(F.trim(column.cast("string")).try_cast("double").try_cast(kind), F.lit(0).cast(kind))


def finite(column: str) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), F.col(column))


def filter_reason(area: Column, border: Column, solidity: Column, least: float, most: float, least_solidity: float = 0.70) -> Column:
    """The first rule that applies to an object: small, huge, border, split (not solid), large, or kept."""
    return (
        F.when(area < least, "small").when(area > 2 * most, "huge").when(border, "border").when(solidity < least_solidity, "split").when(area <= most, "kept").otherwise("large")
    )


def outside_share(points: DataFrame, by: tuple[str, ...], known: str, inside: str, most: float = 0.10) -> DataFrame:
    """For each track the share of its checkable points that lie outside; no checkable point counts as 0, which is accepted."""
    share = F.coalesce(F.try_divide(F.count_if(F.col(known) & ~F.col(inside)), F.count_if(F.col(known))), F.lit(0.0))
    return points.groupBy(*by).agg(F.count_if(F.col(known)).alias("checkable"), share.alias("outside_share")).withColumn("accepted", F.col("outside_share") <= most)


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that does not hold; null if all hold."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def split_quality(df: DataFrame, flag: str = "bad_qc") -> tuple[DataFrame, DataFrame]:
    """Kept and removed rows."""
    bad = F.coalesce(F.col(flag), F.lit(False))
    return df.where(~bad), df.where(bad)
