"""Helpers of the driver for batch runs: disk guard, end of a log, marked sections of reports."""

from __future__ import annotations

import shutil
from collections import deque

#: A batch stops below so many free bytes.
LEAST_FREE = 15 * 10**9


def disk_left(path: str, least: int = LEAST_FREE) -> bool:
    return shutil.disk_usage(path).free >= least


def tail(path: str, lines: int = 40) -> list[str]:
    with open(path, errors="replace") as f:
        return [x.rstrip("\n") for x in deque(f, maxlen=lines)]


def with_section(report: str, name: str, body: str) -> str:
    """The report with the text between the marks of section `name` replaced, or the section added at the end."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    whole = f"{start}\n{body}\n{end}"
    if start in report and end in report[report.index(start) :]:
        a = report.index(start)
        return report[:a] + whole + report[report.index(end, a) + len(end) :]
    return f"{report.rstrip()}\n\n{whole}\n"
