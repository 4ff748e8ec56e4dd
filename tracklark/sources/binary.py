"""Binary sources: uncompressed TIFF stacks and ImageJ ROI files, read with Spark's binaryFile source."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# TIFF tags, bytes of each TIFF type, and the mark of a ROI file.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 270: "description", 273: "offsets", 277: "samples", 279: "counts", 282: "x_resolution", 296: "unit", 339: "format"}
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}
ROI_MARK = b"Iout"


def tiff_pages(data: bytes) -> Iterator[dict]:
    """The pages of an uncompressed grey-scale TIFF: tags and pixels as doubles."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack(order + "I", data[4:8])[0]
    while at:
        n = struct.unpack(order + "H", data[at : at + 2])[0]
        page: dict = {"compression": 1, "samples": 1, "format": 1, "bits": 1, "unit": 2}
        for k in range(n):
            tag, kind, count, _ = struct.unpack(order + "HHI4s", data[at + 2 + 12 * k : at + 14 + 12 * k])
            if tag in TAGS and kind in TYPE_BYTES:
                size = TYPE_BYTES[kind] * count
                place = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
                raw = data[place : place + size]
                if kind == 2:
                    page[TAGS[tag]] = raw.rstrip(b"\0").decode("utf-8", "replace")
                elif kind == 5:
                    a, b = struct.unpack(order + "II", raw[:8])
                    page[TAGS[tag]] = a / b if b else None
                else:
                    values = struct.unpack(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 11: 'f', 12: 'd', 16: 'Q'}[kind] }".replace(" ", ""), raw)
                    page[TAGS[tag]] = list(values) if TAGS[tag] in {"offsets", "counts"} else values[0]
        if page["compression"] != 1 or page["samples"] != 1:
            raise ValueError("only uncompressed grey-scale pages can be read")
        code = {1: "u", 2: "i", 3: "f"}[page["format"]] + str(page["bits"] // 8)
        pixels = b"".join(data[o : o + c] for o, c in zip(page["offsets"], page["counts"], strict=True))
        page["pixels"] = np.frombuffer(pixels, order + code).reshape(page["height"], page["width"]).astype("<f8")
        yield page
        at = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]


def tiff_bytes(planes: list[np.ndarray], description: str = "") -> bytes:
    """An uncompressed little-endian TIFF of 16-bit planes."""
    out, last = bytearray(b"II*\0\0\0\0\0"), 4
    for plane in planes:
        raw = plane.astype("<u2").tobytes()
        data_at = len(out)
        out += raw
        text_at = len(out)
        out += description.encode() + b"\0" * (2 - len(description.encode()) % 2)
        entries = [(256, 4, 1, plane.shape[1]), (257, 4, 1, plane.shape[0]), (258, 3, 1, 16), (259, 3, 1, 1), (262, 3, 1, 1), (270, 2, len(description.encode()) + 1, text_at), (273, 4, 1, data_at), (277, 3, 1, 1), (278, 4, 1, plane.shape[0]), (279, 4, 1, len(raw))]
        if len(description.encode()) < 4:
            entries = [e for e in entries if e[0] != 270]
        struct.pack_into("<I", out, last, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0\0\0\0"
        last = len(out) - 4
    return bytes(out)


def read_stacks(spark: SparkSession, *paths: str) -> DataFrame:
    """Planes of TIFF files: file, t, h, w, px (little-endian doubles), description, x_resolution, unit."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                for t, p in enumerate(tiff_pages(row.content)):
                    yield pd.DataFrame([(row.path, t, p["height"], p["width"], p["pixels"].tobytes(), p.get("description"), p.get("x_resolution"), p["unit"])], columns=["file", "t", "h", "w", "px", "description", "x_resolution", "unit"])

    return files.mapInPandas(run, "file string, t int, h int, w int, px binary, description string, x_resolution double, unit int")


def rectangles(data: bytes, name: str = "") -> Iterator[tuple[str, int, int, int, int]]:
    """Name, top, left, bottom and right of a ROI file or of each ROI in a zip file."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for inner in z.namelist():
                yield from rectangles(z.read(inner), inner)
    elif data[:4] == ROI_MARK:
        yield (name, *struct.unpack(">4h", data[8:16]))


def roi_bytes(top: int, left: int, bottom: int, right: int) -> bytes:
    """A rectangle as a ROI file."""
    return ROI_MARK + struct.pack(">hBB4h", 227, 1, 0, top, left, bottom, right) + b"\0" * 48


def read_rois(spark: SparkSession, *paths: str) -> DataFrame:
    """file, name, top, left, bottom, right of ROI and zip files."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.path, *found) for r in batch.itertuples() for found in rectangles(r.content, r.path.rsplit("/", 1)[-1])]
            yield pd.DataFrame(rows, columns=["file", "name", "top", "left", "bottom", "right"])

    return files.mapInPandas(run, "file string, name string, top int, left int, bottom int, right int")
