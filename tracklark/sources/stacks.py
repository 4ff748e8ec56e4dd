"""A data source for image stacks in TIFF files, planned by page, and committed sinks for stacks and other files.

    register(spark)
    spark.read.format("stacks").load(path)                  # file, t, h, w, px, description
    df.write.format("stacks").mode("append").save(folder)   # name, t, h, w, px: a file for each name
    df.write.format("blobs").mode("append").save(folder)    # name, content: a file for each row, as of `roi_files`

Paths may have any scheme that Arrow's file systems know (none: a local or mounted folder). Reading plans a task for
every `bytes` (an option, 32 MB) of decoded pages from the files' page directories, so a long stack is many tasks; more
than `PLANNED` files are dealt whole to `TASKS` tasks or more. Filters on `t` leave pages out before they are read, where Spark passes filters
to Python sources (spark.sql.python.filterPushdown.enabled). Strips and tiles may be plain, PackBits, LZW or Deflate,
with or without horizontal differences; pages of several samples are refused.

Writing: tasks write to a folder of their own under `_temporary`; the job's commit moves whole files into place, and an
abort leaves nothing. The rows of a stack have to come together and in one task (repartition and sort by name and t).
Rows with a null in a needed column are an error. An empty table writes nothing.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from tracklark.sources.binary import roi_bytes

# TIFF tags, struct codes of the types read, and the kinds of compression.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 270: "description", 273: "offsets", 277: "samples", 278: "rows", 279: "counts", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_counts", 339: "format"}
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 16: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
LISTS = ("offsets", "counts", "tile_offsets", "tile_counts")
#: So many files are planned by page.
PLANNED = 1000
#: More files than that are read by about so many tasks, and by more if they are large.
TASKS = 200
SCHEMA = "file string, t int, h int, w int, px binary, description string"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def unpacked(raw: bytes) -> bytes:
    """PackBits: runs of a byte, and stretches as they are."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += raw[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def unzipped(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first, which grow one code early; 256 clears, 257 ends."""
    out, table, last = bytearray(), [], b""
    bits = held = 0
    width = 9
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
            width = min(12, max(9, (len(table) + 1).bit_length()))
        last = entry
    return bytes(out)


def decoded(raw: bytes, compression: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(raw)
    if compression not in (NONE, PACKBITS, LZW):
        raise ValueError(f"pages of compression {compression} can't be read")
    return raw if compression == NONE else unpacked(raw) if compression == PACKBITS else unzipped(raw)


class Pages:
    """The page directories of an open TIFF file."""

    def __init__(self, handle):
        self.handle = handle
        head = self.read(0, 8)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF file")
        self.order = {b"II": "<", b"MM": ">"}[head[:2]]
        self.first = self.number("I", head[4:8])

    def read(self, at: int, n: int) -> bytes:
        self.handle.seek(at)
        return self.handle.read(n)

    def number(self, code: str, raw: bytes) -> int:
        return struct.unpack(self.order + code, raw)[0]

    def starts(self) -> Iterator[int]:
        """Where each page's directory begins; reads a few bytes for each."""
        at = self.first
        while at:
            yield at
            n = self.number("H", self.read(at, 2))
            at = self.number("I", self.read(at + 2 + 12 * n, 4))

    def page(self, at: int) -> dict:
        n = self.number("H", self.read(at, 2))
        raw, out = self.read(at + 2, 12 * n), {"compression": NONE, "samples": 1, "format": 1, "bits": 1, "predictor": 1}
        for k in range(n):
            tag, kind, count = struct.unpack(self.order + "HHI", raw[12 * k : 12 * k + 8])
            if tag not in TAGS or kind not in TYPES:
                continue
            size = struct.calcsize(TYPES[kind]) * count
            own = raw[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else self.read(self.number("I", raw[12 * k + 8 : 12 * k + 12]), size)
            if kind == 2:
                out[TAGS[tag]] = own.rstrip(b"\0").decode("utf-8", "replace")
            else:
                values = struct.unpack(f"{self.order}{count}{TYPES[kind]}", own)
                out[TAGS[tag]] = list(values) if TAGS[tag] in LISTS else values[0]
        return out

    def pixels(self, p: dict) -> np.ndarray:
        """A page's values as doubles."""
        if p["samples"] != 1 or p["bits"] % 8:
            raise ValueError("only pages of one sample in whole bytes can be read")
        kind = np.dtype(self.order + {1: "u", 2: "i", 3: "f"}[p["format"]] + str(p["bits"] // 8))
        h, w = p["height"], p["width"]
        tiled = "tile_offsets" in p
        th, tw = (p["tile_height"], p["tile_width"]) if tiled else (min(p.get("rows", h), h), w)
        out, across = np.zeros((h, w)), -(-w // tw)
        for k, (at, n) in enumerate(zip(*(p[c] for c in (("tile_offsets", "tile_counts") if tiled else ("offsets", "counts"))), strict=True)):
            y, x = k // across * th, k % across * tw
            rows = th if tiled else min(th, h - y)
            part = np.frombuffer(decoded(self.read(at, n), p["compression"]), kind, rows * tw).reshape(rows, tw)
            if p["predictor"] == 2:
                part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
            out[y : y + rows, x : x + tw] = part[: h - y, : w - x]
        return out


class Part(NamedTuple):
    file: str
    pages: tuple[tuple[int, int], ...] | None


class Chunk(InputPartition):
    """(page number, place of its directory) of some pages of a file, or all pages of it (None)."""

    def __init__(self, part: Part):
        self.value = part


class Files(InputPartition):
    """All pages of some files."""

    def __init__(self, files: list[str]):
        self.value = files


class StackReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most, self.tests = path, most, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the page number are done here."""
        kinds = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}
        for f in filters:
            if type(f) in kinds and f.attribute == ("t",):
                self.tests.append((kinds[type(f)], f.value))
            elif isinstance(f, In) and f.attribute == ("t",):
                self.tests.append(("in", tuple(f.value)))
            else:
                yield f

    def wanted(self, t: int) -> bool:
        return all(t in v if op == "in" else getattr(t, op)(v) for op, v in self.tests)

    def partitions(self) -> Sequence[InputPartition]:
        fs, at = opened(self.path)
        found = fs.get_file_info(at)
        if found.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        infos = [found] if found.is_file else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        sizes = {f.path: f.size or 0 for f in infos if f.is_file and (found.is_file or f.path.lower().endswith((".tif", ".tiff"))) and "/_temporary/" not in f.path}
        files = sorted(sizes)
        if len(files) > PLANNED:
            # The start of a task costs more than a small file.
            largest, runs, held = max(1, min(self.most, sum(sizes.values()) // TASKS)), [[]], 0
            for f in files:
                if runs[-1] and (held + sizes[f] > largest or len(runs[-1]) >= -(-len(files) // TASKS)):
                    runs.append([])
                    held = 0
                runs[-1].append(f)
                held += sizes[f]
            return [Files(own) for own in runs]
        out = []
        for f in files:
            with fs.open_input_file(f) as handle:
                pages = Pages(handle)
                starts = [(t, s) for t, s in enumerate(pages.starts()) if self.wanted(t)]
                if starts:
                    first = pages.page(starts[0][1])
                    each = max(1, self.most // max(1, 8 * first["height"] * first["width"]))
                    out += [Chunk(Part(f, tuple(starts[k : k + each]))) for k in range(0, len(starts), each)]
        return out

    def read(self, partition: Chunk | Files | None) -> Iterator[tuple]:
        if partition is None:  # what Spark reads if there is no partition
            return
        fs, _ = opened(self.path)
        for file, some in [partition.value] if isinstance(partition, Chunk) else [(f, None) for f in partition.value]:
            with fs.open_input_file(file) as handle:
                pages = Pages(handle)
                for t, at in some if some is not None else ((t, s) for t, s in enumerate(pages.starts()) if self.wanted(t)):
                    p = pages.page(at)
                    yield file, t, p["height"], p["width"], pages.pixels(p).astype("<f8").tobytes(), p.get("description")


class Written(WriterCommitMessage):
    """A task's folder and the names of its files."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names


class CommittedWriter(DataSourceWriter):
    """Tasks write files to folders of their own; a commit moves them into place, an abort deletes them."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        fs, at = opened(path)
        fs.create_dir(f"{at}/_temporary/{self.job}")

    def task_folder(self) -> tuple[pafs.FileSystem, str]:
        """Not made with its parents: a task that outlives an abort must not bring the job's folder back."""
        fs, at = opened(self.path)
        folder = f"{at}/_temporary/{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=False)
        return fs, folder

    @staticmethod
    def place(fs: pafs.FileSystem, folder: str, name: str) -> str:
        """Where a file of a task goes; makes the folders of its name."""
        *above, _ = name.split("/")
        for k in range(len(above)):
            fs.create_dir(f"{folder}/{'/'.join(above[: k + 1])}", recursive=False)
        return f"{folder}/{name}"

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            raise ValueError("several tasks wrote rows of one file; repartition by its name")
        if not self.overwrite and (there := [f.path for f in fs.get_file_info([f"{at}/{n}" for n in names]) if f.type != pafs.FileType.NotFound]):
            raise FileExistsError(", ".join(there))
        for m in done:
            for n in m.names:
                fs.create_dir(f"{at}/{n}".rsplit("/", 1)[0])
                fs.move(f"{m.folder}/{n}", f"{at}/{n}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        for folder in (f"{at}/_temporary/{self.job}", f"{at}/_temporary"):
            found = fs.get_file_info(folder)
            # Other jobs may be at work beside this one.
            if found.type == pafs.FileType.Directory and (folder.endswith(self.job) or not fs.get_file_info(pafs.FileSelector(folder))):
                fs.delete_dir(folder)


def safe(name: str | None) -> str:
    if not name or name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"not a file name: {name!r}")
    return name


class TiffOut:
    """A TIFF file written from front to back: each page's directory waits behind its pixels for the next page."""

    def __init__(self, handle, compression: int):
        self.handle, self.compression, self.at, self.waiting = handle, compression, 8, None

    def add(self, pixels: np.ndarray, description: str | None) -> None:
        raw = np.clip(np.nan_to_num(pixels), 0, 65535).astype("<u2").tobytes()
        raw = zlib.compress(raw) if self.compression == DEFLATE else raw
        text = (description or "").encode() + b"\0"
        text += b"\0" * max(0, 5 - len(text))  # kept out of the directory
        data = raw + b"\0" * (len(raw) % 2)
        own = data + text + b"\0" * (len(text) % 2)
        self.ended(self.at + (len(self.waiting) if self.waiting else 0) + len(own))
        h, w = pixels.shape
        entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 16), (259, 3, 1, self.compression), (262, 3, 1, 1), (270, 2, len(text), self.at + len(data)), (273, 4, 1, self.at), (277, 3, 1, 1), (278, 4, 1, h), (279, 4, 1, len(raw))]
        self.put(own)
        self.waiting = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + bytes(4)
        if self.at > 0xFFF00000:
            raise ValueError("a TIFF file holds 4 GB at most")

    def ended(self, next_one: int) -> None:
        """Write what waits, naming the place of the next directory."""
        if self.waiting is None:
            self.handle.write(b"II*\0" + struct.pack("<I", next_one))
        else:
            self.put(self.waiting[:-4] + struct.pack("<I", next_one))

    def put(self, raw: bytes) -> None:
        self.handle.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        self.ended(0)
        self.handle.close()


class StackWriter(CommittedWriter):
    """Pages of unsigned 16-bit values (others are clipped, NaN is 0), plain or by Deflate."""

    def __init__(self, path: str, overwrite: bool, compression: str):
        super().__init__(path, overwrite)
        if compression not in ("none", "deflate"):
            raise ValueError(f"stacks are written plain or by deflate, not {compression}")
        self.compression = DEFLATE if compression == "deflate" else NONE

    def write(self, iterator: Iterator) -> Written:
        fs, folder = self.task_folder()
        names, seen, out = [], set(), None
        for row in iterator:
            name = safe(row["name"])
            if not names or names[-1] != name:
                if name in seen:
                    raise ValueError(f"the pages of {name} don't stand together; sort by name and t")
                if out:
                    out.close()
                names.append(name)
                seen.add(name)
                out = TiffOut(fs.open_output_stream(self.place(fs, folder, name)), self.compression)
            out.add(np.frombuffer(row["px"], "<f8").reshape(row["h"], row["w"]), row["description"] if "description" in row else None)
        if out:
            out.close()
        return Written(folder, names)


class BlobWriter(CommittedWriter):
    def write(self, iterator: Iterator) -> Written:
        fs, folder = self.task_folder()
        names = []
        for row in iterator:
            names.append(safe(row["name"]))
            with fs.open_output_stream(self.place(fs, folder, names[-1])) as out:
                out.write(bytes(row["content"]))
        return Written(folder, names)


class Stacks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stacks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> StackReader:
        return StackReader(self.options["path"], int(self.options.get("bytes", 32 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> StackWriter:
        return StackWriter(self.options["path"], overwrite, self.options.get("compression", "deflate"))


class Blobs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> BlobWriter:
        return BlobWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and let it pass filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Stacks, Blobs):
        spark.dataSource.register(source)


def roi_files(rectangles: DataFrame, by: str | None = None) -> DataFrame:
    """Rows for the format `blobs`: a ROI file for each rectangle (name, top, left, bottom, right), or, with `by`, one zip
    file named by that column for all its rectangles, which one task packs."""
    numbers = ("top", "left", "bottom", "right")
    if by is None:
        one = F.udf(lambda *r: roi_bytes(*r), "binary")
        return rectangles.select("name", one(*numbers).alias("content"))

    @F.udf("binary")
    def packed(rows) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows:
                # Without the time of day, equal ROIs make equal files.
                z.writestr(zipfile.ZipInfo(r["name"]), roi_bytes(*(r[c] for c in numbers)))
        return out.getvalue()

    lists = rectangles.groupBy(F.col(by).alias("name")).agg(F.array_sort(F.collect_list(F.struct("name", *numbers))).alias("rows"))
    return lists.select("name", packed("rows").alias("content"))
