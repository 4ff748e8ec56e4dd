"""The stack source and the committed sinks: round trips, decoders, pruning, and writes that break off."""

import os
import struct
import zlib

import numpy as np
import pytest

from tracklark.sources import binary, stacks


@pytest.fixture(scope="module")
def spark_with(spark):
    stacks.register(spark)
    return spark


def planes(spark, n, name="a/long.tif", h=6, w=9):
    draw = np.random.default_rng(n)
    values = draw.integers(0, 65536, (n, h, w)).astype("<f8")
    rows = [(name, t, h, w, v.tobytes(), f"page {t}") for t, v in enumerate(values)]
    return values, spark.createDataFrame(rows, "name string, t int, h int, w int, px binary, description string")


def read(spark, path, **options):
    return spark.read.format("stacks").options(**options).load(str(path))


@pytest.mark.parametrize("compression", ["none", "deflate"])
def test_a_long_stack_makes_a_round_trip_over_several_tasks(spark_with, tmp_path, compression):
    spark = spark_with
    values, frame = planes(spark, 1000)
    frame.repartition(1).sortWithinPartitions("name", "t").write.format("stacks").option("compression", compression).mode("append").save(f"{tmp_path}/out")
    assert os.listdir(f"{tmp_path}/out") == ["a"]
    back = read(spark, f"{tmp_path}/out", bytes=100 * 8 * 54)
    assert back.rdd.getNumPartitions() == 10
    got = back.orderBy("t").collect()
    assert [r.t for r in got] == list(range(1000)) and {(r.h, r.w) for r in got} == {(6, 9)} and got[7].description == "page 7"
    assert (np.stack([np.frombuffer(r.px, "<f8").reshape(6, 9) for r in got]) == values).all()
    # The other reader agrees.
    with open(f"{tmp_path}/out/a/long.tif", "rb") as f:
        data = f.read()
    if compression == "none":
        assert all((p["pixels"] == v).all() for p, v in zip(binary.tiff_pages(data), values, strict=True))
    some = back.where("t >= 990 AND t < 995 AND t <> 992")
    assert sorted(r.t for r in some.select("t").collect()) == [990, 991, 993, 994]
    assert some.rdd.getNumPartitions() == 1


def test_pages_are_pruned_in_the_reader(tmp_path):
    (tmp_path / "s.tif").write_bytes(binary.tiff_bytes([np.full((2, 2), k) for k in range(50)]))
    reader = stacks.StackReader(str(tmp_path), 1 << 20)
    kept = [*reader.pushFilters([stacks.In(("t",), (3, 9, 70)), stacks.GreaterThan(("t",), 4), stacks.EqualTo(("h",), 2)])]
    assert [type(f).__name__ for f in kept] == ["EqualTo"]
    (chunk,) = reader.partitions()
    assert [t for t, _ in chunk.value.pages] == [9] and [r[1] for r in reader.read(chunk)] == [9]


def packbits(raw):
    out, at = bytearray(), 0
    while at < len(raw):
        run = 1
        while run < 128 and at + run < len(raw) and raw[at + run] == raw[at]:
            run += 1
        out += bytes([257 - run, raw[at]]) if run > 1 else bytes([0, raw[at]])
        at += run
    return bytes(out) + b"\x80"


def lzw(raw):
    """Codes as TIFF has them: they grow one code early."""
    codes, table, width, last = [(256, 9)], {bytes([k]): k for k in range(256)}, 9, b""
    size = 258
    for b in raw:
        if last + bytes([b]) in table:
            last += bytes([b])
            continue
        codes.append((table[last], width))
        table[last + bytes([b])] = size
        size += 1
        if size == 4095:
            codes.append((256, width))
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        elif size in (512, 1024, 2048):
            width += 1
        last = bytes([b])
    if last:
        codes.append((table[last], width))
        size += 1
        if size in (512, 1024, 2048):
            width += 1
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return int(bits + "0" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8, "big")


@pytest.mark.parametrize("n", [0, 1, 300, 5000, 60_000])
def test_decoders_undo_their_encoders(n):
    draw = np.random.default_rng(n)
    for raw in (draw.integers(0, 256, n, np.uint8).tobytes(), draw.integers(0, 3, n, np.uint8).tobytes(), b"\7" * n):
        assert stacks.unpacked(packbits(raw)) == raw
        assert stacks.unzipped(lzw(raw)) == raw


def page_file(values, compression, predictor=1, tile=None, order="<", rows=4):
    """One page in strips of `rows` rows or in tiles."""
    encode = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}[compression]
    h, w = values.shape
    kind = values.dtype.newbyteorder(order)
    shaped = lambda a: (np.diff(a, axis=1, prepend=np.zeros((len(a), 1), a.dtype)) if predictor == 2 else a).astype(kind).tobytes()
    if tile:
        wide = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile), values.dtype)
        wide[:h, :w] = values
        parts = [encode(shaped(wide[y : y + tile, x : x + tile])) for y in range(0, len(wide), tile) for x in range(0, wide.shape[1], tile)]
    else:
        parts = [encode(shaped(values[y : y + rows])) for y in range(0, h, rows)]
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    places = []
    for p in parts:
        places.append(len(out))
        out += p
    lists = {}
    for name, own in (("at", places), ("n", [len(p) for p in parts])):
        lists[name] = len(out)
        out += struct.pack(f"{order}{len(own)}I", *own)
    value = lambda n, at, own: own[0] if n == 1 else at
    k = len(parts)
    entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, values.dtype.itemsize * 8), (259, 3, 1, compression), (277, 3, 1, 1), (317, 3, 1, predictor), (339, 3, 1, {"u": 1, "i": 2, "f": 3}[values.dtype.kind])]
    where = [(k, lists["at"], places), (k, lists["n"], [len(p) for p in parts])]
    tags = (324, 325) if tile else (273, 279)
    entries += [(tag, 4, n, value(n, at, own)) for tag, (n, at, own) in zip(tags, where)] + ([(322, 3, 1, tile), (323, 3, 1, tile)] if tile else [(278, 4, 1, rows)])
    struct.pack_into(order + "I", out, 4, len(out))
    out += struct.pack(order + "H", len(entries))
    for tag, t, n, v in sorted(entries):
        out += struct.pack(order + "HHI", tag, t, n) + (struct.pack(order + "HH", v, 0) if t == 3 else struct.pack(order + "I", v))
    return bytes(out + b"\0\0\0\0")


def test_strips_and_tiles_of_all_kinds(spark_with, tmp_path):
    draw, want = np.random.default_rng(3), {}
    for k, (compression, predictor, tile, order, kind) in enumerate([(1, 1, None, ">", "u2"), (5, 2, None, "<", "u1"), (8, 1, 16, "<", "f4"), (32773, 1, 16, ">", "i2"), (5, 1, 16, "<", "u2"), (8, 2, None, ">", "u2"), (8, 2, 16, "<", "u4")]):
        values = draw.integers(0, 100, (19, 23)).astype(kind)
        (tmp_path / f"k{k}.tif").write_bytes(page_file(values, compression, predictor, tile, order))
        want[f"k{k}.tif"] = values
    got = {os.path.basename(r.file): np.frombuffer(r.px, "<f8").reshape(r.h, r.w) for r in read(spark_with, tmp_path).collect()}
    assert set(got) == set(want) and all((got[k] == want[k]).all() for k in want)
    (tmp_path / "odd.tif").write_bytes(page_file(np.zeros((2, 2), "u1"), 1).replace(struct.pack("<HHIHH", 259, 3, 1, 1, 0), struct.pack("<HHIHH", 259, 3, 1, 7, 0)))
    with pytest.raises(Exception, match="compression 7"):
        read(spark_with, tmp_path / "odd.tif").collect()


def test_broken_writes_leave_nothing(spark_with, tmp_path):
    spark, out = spark_with, f"{tmp_path}/out"
    _, frame = planes(spark, 4)
    save = lambda df, mode="append": df.write.format("stacks").mode(mode).save(out)
    for bad in (frame.withColumn("h", frame.h + 1), frame.selectExpr("CASE WHEN t = 3 THEN '../up.tif' ELSE name END AS name", "t", "h", "w", "px", "description"), frame.repartition(4, "t")):
        with pytest.raises(Exception):
            save(bad)
        assert [f for _, _, names in os.walk(tmp_path) for f in names] == []
    save(frame.coalesce(1))
    with pytest.raises(Exception, match="long.tif"):
        save(frame.coalesce(1))
    save(frame.coalesce(1).where("t = 0"), "overwrite")
    assert read(spark, out).count() == 1
    save(frame.where("false"))
    assert [f for _, _, names in os.walk(out) for f in names] == ["long.tif"]


def test_rois_and_zips_are_written_and_read(spark_with, tmp_path):
    spark = spark_with
    rois = spark.createDataFrame([("a.roi", "one.zip", 1, 2, 30, 40), ("b.roi", "one.zip", 5, 6, 7, 8), ("c.roi", "two.zip", 0, 0, 9, 9)], "name string, image string, top int, left int, bottom int, right int")
    stacks.roi_files(rois).write.format("blobs").mode("append").save(f"{tmp_path}/single")
    stacks.roi_files(rois, "image").write.format("blobs").mode("append").save(f"{tmp_path}/zips")
    assert sorted(os.listdir(f"{tmp_path}/single")) == ["a.roi", "b.roi", "c.roi"] and sorted(os.listdir(f"{tmp_path}/zips")) == ["one.zip", "two.zip"]
    want = sorted((r.name, r.top, r.left, r.bottom, r.right) for r in rois.collect())
    for folder in ("single", "zips"):
        assert sorted((r.name, r.top, r.left, r.bottom, r.right) for r in binary.read_rois(spark, f"{tmp_path}/{folder}").collect()) == want


def test_folders_without_pages(spark_with, tmp_path):
    assert read(spark_with, tmp_path).count() == 0
    (tmp_path / "s.tif").write_bytes(binary.tiff_bytes([np.zeros((2, 2))]))
    assert read(spark_with, tmp_path).where("t > 5").count() == 0
    with pytest.raises(Exception, match="none.tif"):
        read(spark_with, tmp_path / "none.tif").count()
