"""Scalar expressions: physics of the link radius, units, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel words in the order they are looked for, and patterns in metadata texts.
CHANNELS = (("green", "G"), ("red", "R"), ("purple", "P"))
INTERVAL, PLANE, EXPOSURE = r"finterval=([0-9.eE+\-]+)", r"Plane #\d+:", r"Exposure:\s*([0-9.]+)\s*(ms|s)\b"


def link_radius_um(frame_interval: Column, gap: Column, diffusion: Column, exponent: Column, coverage: Column, error_um: Column) -> Column:
    """The radius that covers a share of the displacements of anomalous diffusion in the plane over `gap` frames."""
    spread = diffusion * F.pow(gap * frame_interval, exponent) + error_um * error_um
    return F.sqrt(-4 * F.log(1 - coverage) * spread)


def ceil_to(value: Column, increment: float) -> Column:
    return F.ceil((value - 1e-12) / increment) * increment


def legacy_radius_px(diffusion: Column, rate: Column, um_per_px: Column) -> Column:
    return F.bround(3 * F.sqrt(4 * diffusion / rate) / um_per_px)


def unit_text(unit: Column) -> Column:
    """`um` for every way to write micrometres, escaped signs included; other texts lower-cased."""
    low = F.lower(F.trim(unit))
    for sign in ("\\u00b5", "\\u03bc", "µ", "μ"):
        low = F.replace(low, F.lit(sign), F.lit("u"))
    return F.when(low.isin("um", "micron", "microns", "micrometer", "micrometre"), "um").otherwise(low)


def pixel_nm(unit: Column, per_px: Column, resolution_unit: Column, x_resolution: Column) -> Column:
    """Nanometres for a pixel: the named unit first, else resolution tags (3: per centimetre, 2: per inch, 1: per micrometre)."""
    by_unit = F.when(unit_text(unit) == "um", per_px * 1000).when(unit_text(unit) == "nm", per_px).when(unit_text(unit) == "cm", per_px * 1e7)
    size = F.when(resolution_unit == 3, 1e7).when(resolution_unit == 2, 2.54e7).when(resolution_unit == 1, 1e3)
    return F.coalesce(by_unit, F.try_divide(size, F.nullif(x_resolution, F.lit(0.0))))


def seconds(exposure: Column) -> Column:
    """Values over 1000 are milliseconds."""
    return F.when(exposure > 1000, exposure / 1000).otherwise(exposure)


def slug(text: Column) -> Column:
    """Lower-case letters and digits, runs of others as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def channel_letter(name: Column) -> Column:
    out = F.lit("X")
    for word, letter in reversed(CHANNELS):
        out = F.when(F.contains(F.lower(name), F.lit(word)), letter).otherwise(out)
    return out


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, null without a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def frame_interval(text: Column) -> Column:
    """Seconds between frames from a description; null if it names none or none that is positive."""
    found = matched(text, INTERVAL).try_cast("double")
    return F.when(found > 0, found)


def exposures_ms(text: Column, channels: int) -> Column:
    """An array of the exposure of each of the first planes that a description lists, in milliseconds; null where a
    plane names none."""
    blocks = F.slice(F.split(F.coalesce(text, F.lit("")), PLANE), 2, channels)
    number = lambda b: matched(b, EXPOSURE).try_cast("double") * F.when(matched(b, EXPOSURE, 2) == "s", 1000.0).otherwise(1.0)
    return F.transform(F.sequence(F.lit(1), F.lit(channels)), lambda k: number(F.try_element_at(blocks, k)))


def json_or(text: Column, path: str, default: Column) -> Column:
    """A value of a JSON text by its path, else the default."""
    return F.coalesce(F.get_json_object(text, path), default)


def elapsed_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1_000_000)


def iso_text(at: Column) -> Column:
    """Date and time to the second, as ISO text."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def half_even(column: Column, places: int = 0) -> Column:
    """Rounded, halves to the even digit."""
    return F.bround(column, places)


def number_in(text: Column, pattern: str) -> Column:
    """A number in a name, to sort by; null without one."""
    return matched(text, pattern).try_cast("long")


def quick_round(c: Column, places: int = 4) -> Column:
    """`F.round` of a double column, through whole numbers unless a half may be near: for columns of very many values."""
    up = F.abs(c) * float(10**places)
    near = F.abs(up - F.floor(up) - 0.5)
    return F.when((up < 1e9) & (near > 1e-6), F.signum(c) * F.floor(up + 0.5) / float(10**places) + 0.0).otherwise(F.round(c, places))
