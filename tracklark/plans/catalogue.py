"""All queries of the library with their SQL, by name."""

from __future__ import annotations

from tracklark.plans import audits, images, merges, regions, tracks  # noqa: F401
from tracklark.plans.registry import ORACLES, QUERIES  # noqa: F401
