"""GeoTIFF files: what is written is read, windows read their strips alone, and broken files are told of."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunlattice.sources import geotiff

FRAME = "raster_id string, rows int, columns int, x0 double, y0 double, dx double, dy double, epsg int, tags map<string,string>"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rasters"))
    sizes = {f"r{i:02d}": (70 + 13 * i, 5 + i) for i in range(20)}
    rows = [(k, y, x, None if (y + x) % 11 == 0 else y * 100.5 + x) for k, (h, w) in sizes.items() for y in range(h) for x in range(w) if (y, x) != (1, 1)]
    frames = [(k, h, w, 9.5, 48.25, 0.5, -0.25, 4326 if k < "r10" else 32733, {"original_lon1": "9.1", "dem_source": f"<{k}> & \"é\"", "none": None}) for k, (h, w) in sizes.items()]
    cells = spark.createDataFrame(rows, "raster_id string, yi int, xi int, value double").repartition(5)
    geotiff.write_geotiff(cells, spark.createDataFrame(frames, FRAME), path)
    return path, sizes


def expected(sizes, top=0, bottom=10**6, left=0, right=10**6):
    return {(k, y, x): None if (y + x) % 11 == 0 or (y, x) == (1, 1) else y * 100.5 + x for k, (h, w) in sizes.items() for y in range(h) for x in range(w) if top <= y <= bottom and left <= x <= right}


def as_dict(df):
    return {(r.raster_id, r.yi, r.xi): r.value for r in df.collect()}


def test_round_trip_and_windows(spark, folder, monkeypatch):
    path, sizes = folder
    assert sorted(os.listdir(path)) == [f"{k}.tif" for k in sorted(sizes)]
    assert as_dict(geotiff.read_geotiff(spark, path)) == expected(sizes)
    window = {"top": 60, "bottom": 130, "left": 2, "right": 7}
    assert as_dict(geotiff.read_geotiff(spark, f"file://{path}", **window)) == expected(sizes, **window)
    assert as_dict(geotiff.read_geotiff(spark, f"{path}/r03.tif")) == expected({"r03": sizes["r03"]})
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = geotiff.read_geotiff(spark, path, pushdown="true").where("yi >= 60 and yi < 131 and xi > 1 and xi <= 7 and value is not null")
        assert as_dict(pushed) == {k: v for k, v in expected(sizes, **window).items() if v is not None}
        plan = pushed._jdf.queryExecution().executedPlan().toString()
        assert "yi" not in plan.split("Filter")[1].split("\n")[0] if "Filter" in plan else True
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_windows_touch_their_chunks_alone(folder, monkeypatch):
    path, sizes = folder
    monkeypatch.setattr(geotiff, "SPLIT", 600)
    seen = []
    real = geotiff.read_chunk
    monkeypatch.setattr(geotiff, "read_chunk", lambda f, h, n, *a: seen.append(n) or real(f, h, n, *a))
    reader = geotiff._CellReader({"path": f"{path}/r19.tif", "top": 130, "bottom": 200})
    parts = reader.partitions()
    got = [(y, x, v) for p in parts for b in reader.read(p) for y, x, v in zip(*(b.column(c).to_pylist() for c in ("yi", "xi", "value")), strict=True)]
    want = expected({"r19": sizes["r19"]}, 130, 200)
    assert len(parts) > 3 and sorted(seen) == [2, 3] and {(y, x): v for y, x, v in got} == {k[1:]: v for k, v in want.items()} and len(got) == len(want)


def test_frames(spark, folder):
    path, sizes = folder
    rows = {r.raster_id: r for r in geotiff.geotiff_frames(spark, path).collect()}
    assert len(rows) == 20
    for k, (h, w) in sizes.items():
        r = rows[k]
        assert (r.rows, r.columns, r.bands, r.x0, r.y0, r.dx, r.dy, r.error) == (h, w, 1, 9.5, 48.25, 0.5, -0.25, None)
        assert r.tags == {"original_lon1": "9.1", "dem_source": f"<{k}> & \"é\"", "none": ""}
        assert (r.epsg, r.zone, r.south) == ((4326, None, False) if k < "r10" else (32733, 33, True)) and np.isnan(r.nodata)


def test_one_broken_file_of_twenty(spark, folder, tmp_path):
    path, sizes = folder
    for k in sizes:
        data = open(f"{path}/{k}.tif", "rb").read()
        with open(tmp_path / f"{k}.tif", "wb") as out:
            out.write(data if k != "r05" else data[:20] + b"\xff" * 40 + data[60:])
    (tmp_path / "r21.tif").write_bytes(b"")
    frames = geotiff.geotiff_frames(spark, str(tmp_path), bad="skip", tries=2, wait=0.01)
    errors = frames.where("error is not null").collect()
    assert {r.raster_id for r in errors} == {"r05", "r21"} and frames.where("error is null").count() == 19
    read = geotiff.read_geotiff(spark, str(tmp_path), bad="skip", tries=2, wait=0.01)
    assert as_dict(read.where("raster_id <> 'r05'")) == {k: v for k, v in expected(sizes).items() if k[0] != "r05"}
    with pytest.raises(Exception, match="r05|r21"):
        geotiff.read_geotiff(spark, str(tmp_path), tries=1).count()


def test_retries_then_success():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return 7

    assert geotiff.with_retries(flaky, 3, 0.001) == 7 and len(calls) == 3
    with pytest.raises(OSError):
        geotiff.with_retries(lambda: (_ for _ in ()).throw(OSError("no")), 2, 0.001)


def big_endian_tiles(path, image, tile, planar):
    """A file another program might write: big endian, 16 bits, tiles, horizontal differences, several bands."""
    h, w, n = image.shape
    blocks = []
    for plane in range(n) if planar == 2 else [slice(None)]:
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                part = np.zeros((tile, tile, 1 if planar == 2 else n), np.int16)
                cut = image[y : y + tile, x : x + tile, plane]
                part[: cut.shape[0], : cut.shape[1]] = cut[..., None] if planar == 2 else cut
                blocks.append(zlib.compress(np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1])).astype(">i2").tobytes()))
    offsets = np.cumsum([8, *map(len, blocks)]).tolist()
    fields = [(256, 3, [w]), (257, 3, [h]), (258, 3, [16] * n), (259, 3, [8]), (277, 3, [n]), (284, 3, [planar]), (317, 3, [2]), (322, 3, [tile]), (323, 3, [tile])]
    fields += [(324, 4, offsets[:-1]), (325, 4, [len(b) for b in blocks]), (339, 3, [2] * n), (42113, 2, "-7")]
    at, entries, more = offsets[-1], b"", b""
    for tag, kind, values in fields:
        raw = values.encode() + b"\0" if kind == 2 else struct.pack(">" + {3: "H", 4: "I"}[kind] * len(values), *values)
        size = len(raw) if kind == 2 else len(values)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", at + 2 + 12 * len(fields) + 4 + len(more))
        more += raw if len(raw) > 4 else b""
        entries += struct.pack(">HHI", tag, kind, size) + place
    with open(path, "wb") as out:
        out.write(b"MM" + struct.pack(">HI", 42, at) + b"".join(blocks) + struct.pack(">H", len(fields)) + entries + b"\0" * 4 + more)


@pytest.mark.parametrize("planar", [1, 2])
def test_tiles_bands_and_differences(spark, tmp_path, planar):
    image = np.random.default_rng(2).integers(-300, 300, (37, 50, 3)).astype(np.int16)
    image[4, 4, 1] = -7
    big_endian_tiles(tmp_path / "t.tif", image, 16, planar)
    got = {(r.band, r.yi, r.xi): r.value for r in geotiff.read_geotiff(spark, str(tmp_path), top=3, bottom=20, left=10).collect()}
    assert got == {(b + 1, y, x): None if image[y, x, b] == -7 else float(image[y, x, b]) for b in range(3) for y in range(3, 21) for x in range(10, 50)}
    frame = geotiff.geotiff_frames(spark, str(tmp_path)).first()
    assert (frame.rows, frame.columns, frame.bands, frame.nodata, frame.x0, frame.epsg) == (37, 50, 3, -7.0, None, None)


def test_failed_writes_leave_nothing(spark, tmp_path):
    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 9, 0, 1.0)], "raster_id string, yi int, xi int, value double")
    frames = spark.createDataFrame([(k, 3, 3, 0.0, 0.0, 1.0, -1.0, 4326, None) for k in "ab"], FRAME)
    with pytest.raises(Exception, match="outside its frame"):
        geotiff.write_geotiff(cells, frames, str(tmp_path))
    rasters = lambda: [f for f in os.listdir(tmp_path) if not f.startswith("_staging")]
    assert rasters() == [] and geotiff.read_geotiff(spark, str(tmp_path)).count() == 0
    geotiff.write_geotiff(cells.where("raster_id = 'a'"), frames, str(tmp_path), dtype="f4")
    assert rasters() == ["a.tif"] and geotiff.read_geotiff(spark, str(tmp_path)).agg(F.count("value"), F.count("*")).first() == (1, 9)
    assert geotiff.read_geotiff(spark, str(tmp_path / "nothing")).count() == 0
