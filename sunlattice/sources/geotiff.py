"""GeoTIFF rasters as tables of cells, their headers as a table of frames, and cells as GeoTIFF files.

Files are dealt into partitions by their size alone, so the driver opens none of them. A task reads a file's header, and then
only the strips or tiles that the asked window touches, by seeking; each becomes one Arrow batch. A file that can't be read is
tried again, and then either fails the query or becomes a row of the header table's `error`, with none of its cells read.
"""

from __future__ import annotations

import struct
import tempfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import Any, BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

#: Fixed values of the format: field types (code: letter of `struct`, bytes), tags and keys.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
MODEL_TYPE, RASTER_TYPE, DEGREES_KEY, METRES_KEY = 1024, 1025, 2048, 3072
NONE, DEFLATE, OLD_DEFLATE = 1, 8, 32946
KINDS = {1: "u", 2: "i", 3: "f"}

#: Bytes of a file for one partition, and rows of a strip that is written.
SPLIT, ROWS = 32 << 20, 64
CELLS = "raster_id string, band int, yi int, xi int, value double"
FRAMES = (
    "raster_id string, path string, rows int, columns int, bands int, zone int, south boolean, x0 double, y0 double, dx double, "
    "dy double, epsg int, nodata double, tags map<string,string>, error string"
)


@dataclass
class Header:
    """What a file says of itself."""

    order: str
    fields: dict[int, Any] = field(default_factory=dict)

    def one(self, tag: int, default: Any = None) -> Any:
        return self.fields.get(tag, (default,))[0]

    @property
    def dtype(self) -> np.dtype:
        bits, kind = self.one(BITS, 1), KINDS.get(self.one(SAMPLE_FORMAT, 1))
        if kind is None or bits not in (8, 16, 32, 64) or len(set(self.fields.get(BITS, (1,)))) > 1:
            raise ValueError(f"samples of {bits} bits aren't read")
        return np.dtype(f"{self.order}{kind}{bits // 8}")

    @property
    def text(self) -> dict[str, str]:
        """The items of the metadata, by name."""
        xml = self.fields.get(METADATA)
        return {i.get("name"): i.text or "" for i in ElementTree.fromstring(xml).iter("Item")} if xml else {}

    @property
    def nodata(self) -> float | None:
        given = self.fields.get(NODATA)
        return float(given) if given else None

    @property
    def epsg(self) -> int | None:
        keys = self.fields.get(GEO_KEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        return found.get(METRES_KEY) or found.get(DEGREES_KEY)

    @property
    def place(self) -> tuple[float, float, float, float] | None:
        """x and y of the centre of the first cell, and the steps."""
        if PIXEL_SCALE not in self.fields or TIE_POINT not in self.fields:
            return None
        (dx, dy, *_), (i, j, _, x, y, *_) = self.fields[PIXEL_SCALE], self.fields[TIE_POINT]
        return x + (0.5 - i) * dx, y - (0.5 - j) * dy, dx, -dy


def read_header(file: BinaryIO) -> Header:
    start = file.read(8)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None or len(start) < 8 or struct.unpack(f"{order}H", start[2:4])[0] != 42:
        raise ValueError("no TIFF file")
    header = Header(order)
    file.seek(struct.unpack(f"{order}I", start[4:])[0])
    count = struct.unpack(f"{order}H", file.read(2))[0]
    entries = file.read(12 * count)
    for k in range(count):
        tag, kind, n = struct.unpack_from(f"{order}HHI", entries, 12 * k)
        if kind not in TYPES:
            continue
        letter, size = TYPES[kind]
        raw = entries[12 * k + 8 : 12 * k + 12]
        if n * size > 4:
            file.seek(struct.unpack(f"{order}I", raw)[0])
            raw = file.read(n * size)
        if letter == "s":
            header.fields[tag] = raw[:n].rstrip(b"\0").decode("utf-8", "replace")
        else:
            header.fields[tag] = struct.unpack_from(f"{order}{letter * n}", raw)
    return header


@dataclass
class Window:
    """Rows and columns that are asked for, both ends included."""

    top: int = 0
    bottom: int = 1 << 31
    left: int = 0
    right: int = 1 << 31


def chunks(header: Header, window: Window) -> list[tuple[int, int, int, int, int]]:
    """(number, top, left, height, width) of the strips or tiles that the window touches; planes follow each other."""
    width, height = header.one(WIDTH), header.one(HEIGHT)
    tiled = TILE_WIDTH in header.fields
    h, w = (header.one(TILE_HEIGHT), header.one(TILE_WIDTH)) if tiled else (min(header.one(STRIP_ROWS, height), height), width)
    across, down = -(-width // w), -(-height // h)
    planes = header.one(SAMPLES, 1) if header.one(PLANAR, 1) == 2 else 1
    rows = range(max(0, window.top // h), min(down, window.bottom // h + 1))
    columns = range(max(0, window.left // w), min(across, window.right // w + 1))
    return [(p * across * down + a * across + b, a * h, b * w, h if tiled else min(h, height - a * h), w) for p in range(planes) for a in rows for b in columns]


def read_chunk(file: BinaryIO, header: Header, number: int, height: int, width: int) -> np.ndarray:
    """The samples of a strip or tile: height x width x samples."""
    tiled = TILE_WIDTH in header.fields
    file.seek(header.fields[TILE_AT if tiled else STRIP_AT][number])
    data = file.read(header.fields[TILE_SIZE if tiled else STRIP_SIZE][number])
    packed = header.one(COMPRESSION, NONE)
    if packed in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif packed != NONE:
        raise ValueError(f"compression {packed} isn't read")
    samples = 1 if header.one(PLANAR, 1) == 2 else header.one(SAMPLES, 1)
    block = np.frombuffer(data, header.dtype, height * width * samples).reshape(height, width, samples)
    predictor = header.one(PREDICTOR, 1)
    if predictor == 2 and header.dtype.kind != "f":
        return np.cumsum(block, axis=1, dtype=header.dtype)
    if predictor != 1:
        raise ValueError(f"predictor {predictor} isn't read")
    return block


def raster_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all TIFF files in a folder."""
    store, inner = opened(path)
    info = store.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    start = path[: len(path.rstrip("/")) - len(inner.rstrip("/"))] if path.rstrip("/").endswith(inner.rstrip("/")) else ""
    return sorted((start + i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.lower().endswith((".tif", ".tiff")))


def with_retries(work, tries: int, wait: float):
    """work(), again after failures, with a pause that doubles each time; the last failure is raised."""
    for k in range(tries):
        try:
            return work()
        except (OSError, ValueError, zlib.error, struct.error, KeyError, IndexError):
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)


_BOUNDS = {("yi", GreaterThanOrEqual): ("top", 0), ("yi", GreaterThan): ("top", 1), ("yi", LessThanOrEqual): ("bottom", 0), ("yi", LessThan): ("bottom", -1)}
_BOUNDS |= {("xi", k[1]): ({"top": "left", "bottom": "right"}[v[0]], v[1]) for k, v in _BOUNDS.items()}


class GeoTiffSource(DataSource):
    """spark.read.format("geotiff"): a row a cell. Options: path; top, bottom, left, right (the window, ends included); tries
    (3) and wait (seconds, 0.5) for files that fail; bad = fail (the default) or skip; pushdown = true for comparisons of yi
    and xi with constants (which needs spark.sql.python.filterPushdown.enabled). NULL stands for the file's nodata and for NaN.

    df.write.format("geotiff"): see `write_geotiff`."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        pushed = str(self.options.get("pushdown", "false")).lower() == "true"
        return (_PushingReader if pushed else _CellReader)(self.options)

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return _Writer(self.options)


class GeoTiffFrames(DataSource):
    """spark.read.format("geotiff_frames"): a row a file, read from its header; `error` says why one can't be read."""

    @classmethod
    def name(cls) -> str:
        return "geotiff_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.tries, self.wait = int(options.get("tries", 3)), float(options.get("wait", 0.5))
        self.skip = options.get("bad", "fail") == "skip"
        self.window = Window(**{k: int(options[k]) for k in ("top", "bottom", "left", "right") if k in options})

    def partitions(self) -> list[InputPartition]:
        parts = [(path, k, n) for path, size in _files(self.path) for n in [max(1, -(-size // SPLIT))] for k in range(n)]
        return [InputPartition(p) for p in parts] or [InputPartition(None)]


class _CellReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, part, parts = partition.value
        store, inner = opened(path)
        try:
            header = with_retries(lambda: read_header(store.open_input_file(inner)), self.tries, self.wait)
            asked = chunks(header, self.window)
            with store.open_input_file(inner) as file:
                for number, top, left, height, width in islice(asked, len(asked) * part // parts, len(asked) * (part + 1) // parts):
                    block = with_retries(lambda n=number, h=height, w=width: read_chunk(file, header, n, h, w), self.tries, self.wait)
                    yield from self._rows(raster_name(path), header, block, number, top, left)
        except (OSError, ValueError, zlib.error, struct.error, KeyError, IndexError) as why:
            if not self.skip:
                raise ValueError(f"{path}: {why}") from why

    def _rows(self, name: str, header: Header, block: np.ndarray, number: int, top: int, left: int) -> Iterator[pa.RecordBatch]:
        w = self.window
        y0, y1 = max(top, w.top), min(top + block.shape[0] - 1, w.bottom, header.one(HEIGHT) - 1)
        x0, x1 = max(left, w.left), min(left + block.shape[1] - 1, w.right, header.one(WIDTH) - 1)
        if y0 > y1 or x0 > x1:
            return
        own = block[y0 - top : y1 - top + 1, x0 - left : x1 - left + 1]
        yi, xi = np.repeat(np.arange(y0, y1 + 1, dtype=np.int32), x1 - x0 + 1), np.tile(np.arange(x0, x1 + 1, dtype=np.int32), y1 - y0 + 1)
        planes = len(chunks(header, Window())) // max(1, header.one(SAMPLES, 1)) if header.one(PLANAR, 1) == 2 else 0
        for k in range(own.shape[2]):
            values = own[:, :, k].ravel().astype(np.float64)
            missing = np.isnan(values) if header.nodata is None else np.isnan(values) | (values == header.nodata)
            band = number // planes if planes else k
            yield pa.record_batch(
                [pa.array([name] * len(yi)), pa.array(np.full(len(yi), band + 1, np.int32)), pa.array(yi), pa.array(xi), pa.array(values, mask=missing)],
                names=["raster_id", "band", "yi", "xi", "value"],
            )


class _PushingReader(_CellReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            end = _BOUNDS.get((f.attribute[0], type(f))) if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, IsNotNull) and f.attribute in (("yi",), ("xi",)):
                continue  # they never are
            if end is None or not isinstance(f.value, int):
                yield f
                continue
            side, more = end
            tighter = max if side in ("top", "left") else min
            setattr(self.window, side, tighter(getattr(self.window, side), f.value + more))


class _FrameReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        files = _files(self.path)
        return [InputPartition(files[i : i + 100]) for i in range(0, len(files), 100)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path, _ in partition.value:
            store, inner = opened(path)

            def row(store=store, inner=inner, path=path) -> tuple:
                with store.open_input_file(inner) as file:
                    h = read_header(file)
                    for number, _, _, height, width in chunks(h, Window(0, 0, 0, 0))[:1]:
                        read_chunk(file, h, number, height, width)
                epsg, place = h.epsg, h.place or (None,) * 4
                utm = epsg is not None and (32600 < epsg <= 32660 or 32700 < epsg <= 32760)
                sizes = (h.one(HEIGHT), h.one(WIDTH), h.one(SAMPLES, 1))
                return raster_name(path), path, *sizes, epsg % 100 if utm else None, utm and epsg > 32700, *place, epsg, h.nodata, h.text, None

            try:
                yield with_retries(row, self.tries, self.wait)
            except (OSError, ValueError, zlib.error, struct.error, KeyError, IndexError) as why:
                if not self.skip:
                    raise ValueError(f"{path}: {why}") from why
                yield (raster_name(path), path, *[None] * 12, f"{type(why).__name__}: {why}")


def _register(spark: SparkSession) -> None:
    for source in (GeoTiffSource, GeoTiffFrames):
        spark.dataSource.register(source)


def read_geotiff(spark: SparkSession, path: str, **options) -> DataFrame:
    """raster_id (the file's name), band, yi, xi and value of a GeoTIFF file or of a folder of them; options: `GeoTiffSource`."""
    _register(spark)
    return spark.read.format("geotiff").options(**options).load(path)


def geotiff_frames(spark: SparkSession, path: str, **options) -> DataFrame:
    """The header table: a frame (as in `operators.warp`) with tags and, with bad="skip", an error for each unreadable file."""
    _register(spark)
    return spark.read.format("geotiff_frames").options(**options).load(path)


# --- writing -------------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """(staged, final) paths of the files of one task."""

    files: list[tuple[str, str]]


class _File:
    """One raster that is being written: strips go to a local spool, header and spool to the store at the end."""

    def __init__(self, frame: dict, dtype: str) -> None:
        self.frame, self.dtype = frame, np.dtype(f"<{dtype}")
        self.spool = tempfile.TemporaryFile()
        self.offsets, self.sizes, self.strip = [], [], None
        self.next = 0

    def _flush(self) -> None:
        top = self.next * ROWS
        height = min(ROWS, self.frame["rows"] - top)
        block = self.strip if self.strip is not None else np.full((ROWS, self.frame["columns"]), np.nan)
        data = zlib.compress(block[:height].astype(self.dtype).tobytes(), 6)
        self.offsets.append(8 + self.spool.tell())
        self.sizes.append(len(data))
        self.spool.write(data)
        self.strip, self.next = None, self.next + 1

    def add(self, yi: np.ndarray, xi: np.ndarray, value: np.ndarray) -> None:
        """Cells in order of rows."""
        for number in np.unique(yi // ROWS).tolist():
            while self.next < number:
                self._flush()
            if self.strip is None:
                self.strip = np.full((ROWS, self.frame["columns"]), np.nan)
            here = yi // ROWS == number
            self.strip[yi[here] - number * ROWS, xi[here]] = value[here]

    def close(self, store: fs.FileSystem, path: str) -> None:
        while self.next * ROWS < self.frame["rows"]:
            self._flush()
        f, size = self.frame, self.spool.tell()
        epsg = int(f["epsg"])
        metres = 32600 < epsg <= 32760
        keys = [1, 1, 0, 3, MODEL_TYPE, 0, 1, 1 if metres else 2, RASTER_TYPE, 0, 1, 1, METRES_KEY if metres else DEGREES_KEY, 0, 1, epsg]
        items = "".join(f"<Item name={quoteattr(k)}>{escape(v or '')}</Item>" for k, v in f["tags"] or ())
        fields = [
            (WIDTH, 4, [f["columns"]]), (HEIGHT, 4, [f["rows"]]), (BITS, 3, [self.dtype.itemsize * 8]), (COMPRESSION, 3, [DEFLATE]), (PHOTOMETRIC, 3, [1]),
            (STRIP_AT, 4, self.offsets), (SAMPLES, 3, [1]), (STRIP_ROWS, 4, [ROWS]), (STRIP_SIZE, 4, self.sizes), (PLANAR, 3, [1]), (SAMPLE_FORMAT, 3, [3]),
            (PIXEL_SCALE, 12, [f["dx"], -f["dy"], 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, f["x0"] - f["dx"] / 2, f["y0"] - f["dy"] / 2, 0.0]), (GEO_KEYS, 3, keys),
            *([(METADATA, 2, f"<GDALMetadata>{items}</GDALMetadata>")] if items else []), (NODATA, 2, "nan"),
        ]
        at = 8 + size + size % 2
        after, entries, more = at + 2 + 12 * len(fields) + 4, b"", b""
        for tag, kind, values in fields:
            raw = values.encode() + b"\0" if kind == 2 else struct.pack(f"<{TYPES[kind][0] * len(values)}", *values)
            n = len(raw) if kind == 2 else len(values)
            if len(raw) > 4:
                place = struct.pack("<I", after + len(more))
                more += raw + b"\0" * (len(raw) % 2)
            else:
                place = raw.ljust(4, b"\0")
            entries += struct.pack("<HHI", tag, kind, n) + place
        self.spool.seek(0)
        with store.open_output_stream(path) as out:
            out.write(b"II" + struct.pack("<HI", 42, at))
            while data := self.spool.read(1 << 20):
                out.write(data)
            out.write(b"\0" * (size % 2) + struct.pack("<H", len(fields)) + entries + b"\0" * 4 + more)
        self.spool.close()


class _Writer(DataSourceArrowWriter):
    """A file a raster. Files are staged under a name of the attempt; the commit moves those of the attempts that counted.

    A task that is still running when the write is given up may leave a staged file, which no reader takes for a raster.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.dtype = options["path"].rstrip("/"), options.get("dtype", "f8")
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _at(self, name: str) -> tuple[fs.FileSystem, str]:
        store, inner = opened(self.path)
        return store, f"{inner}/{name}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files: list[tuple[str, str]] = []
        store, folder = self._at(self.staging)
        current, name = None, None

        def finish() -> None:
            store.create_dir(folder, recursive=True)
            staged = f"{self.staging}/{uuid.uuid4().hex}"
            current.close(store, self._at(staged)[1])
            files.append((staged, f"{name}.tif"))

        for batch in iterator:
            names = batch.column("raster_id").to_pylist()
            starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(names)], strict=True):
                if names[a] != name:
                    if current:
                        finish()
                    name = names[a]
                    frame = {c: batch.column(c)[a].as_py() for c in ("rows", "columns", "x0", "y0", "dx", "dy", "epsg", "tags")}
                    current = _File(frame, self.dtype)
                part = batch.slice(a, b - a)
                yi, xi = (part.column(c).to_numpy(zero_copy_only=False) for c in ("yi", "xi"))
                current.add(yi, xi, part.column("value").cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
        if current:
            finish()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        for staged, name in (f for m in messages if m for f in m.files):
            store, source = self._at(staged)
            store.move(source, self._at(name)[1])
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = self._at(self.staging)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


def write_geotiff(cells: DataFrame, frames: DataFrame, path: str, value: str = "value", dtype: str = "f8") -> None:
    """One deflated GeoTIFF a raster in the folder `path`, named raster_id.tif, of `value` as f4 or f8; cells without a row are NaN.

    cells: raster_id, yi, xi, value; frames: raster_id (a row each), rows, columns, x0, y0, dx, dy, epsg and perhaps tags (a map).
    Cells of a raster without a frame, or outside its frame, are an error. Rasters meet their cells sorted, one strip in memory.
    """
    _register(cells.sparkSession)
    tags = F.map_entries("tags") if "tags" in frames.columns else F.array().cast("array<struct<key:string,value:string>>")
    framed = frames.select("raster_id", *[F.col(c).cast("int").alias(c) for c in ("rows", "columns", "epsg")], *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "dx", "dy")], F.transform(tags, lambda t: F.array(t["key"], t["value"])).alias("tags"))
    placed = cells.select("raster_id", F.col("yi").cast("int").alias("yi"), F.col("xi").cast("int").alias("xi"), F.col(value).cast("double").alias("value")).join(framed, "raster_id", "left")
    inside = F.col("yi").between(0, F.col("rows") - 1) & F.col("xi").between(0, F.col("columns") - 1)
    checked = placed.withColumn("yi", F.when(F.coalesce(inside, F.lit(False)), F.col("yi")).otherwise(F.raise_error(F.lit("a cell is outside its frame")).cast("int")))
    checked.repartition("raster_id").sortWithinPartitions("raster_id", "yi", "xi").write.format("geotiff").mode("append").option("dtype", dtype).save(path)
