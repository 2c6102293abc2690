"""Array files (``.npy``) as a Spark data source: ranges of rows are read and written, never a whole file."""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

BANDS = ("VV", "VH")  # in the order of an array's bands
FORMAT = "npy_raster"
SCHEMA = "scene string, band string, row bigint, col bigint, value double"
ENDING = ".npy"
BATCH = 1 << 16  # pixels of a batch


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, of a URI or a plain path that all machines share."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass(frozen=True)
class Header:
    """What a reader needs of an array file: the axes in the order in which they lie in the file."""

    path: str
    offset: int
    dtype: str
    axes: tuple[tuple[str, int], ...]

    def size(self, name: str) -> int:
        return dict(self.axes).get(name, 1)


def read_header(path: str, band_axis: str = "shortest") -> Header:
    files, at = _filesystem(path)
    with files.open_input_file(at) as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(f)
        offset = f.tell()
    if dtype.hasobject or dtype.names:
        raise ValueError(f"{path} holds no numbers")
    names = ["row", "col"]
    if len(shape) == 3:
        names.insert({"first": 0, "last": 2, "shortest": int(np.argmin(shape))}[band_axis], "band")
    elif len(shape) != 2:
        raise ValueError(f"an array of {len(shape)} dimensions is no raster")
    axes = list(zip(names, map(int, shape)))
    return Header(path, offset, dtype.str, tuple(reversed(axes) if fortran else axes))


def read_rows(header: Header, band: int, first: int, last: int) -> np.ndarray:
    """Rows first to last - 1 of a band; only their bytes are read (with bands last, those of all bands)."""
    dtype = np.dtype(header.dtype)
    names, sizes = zip(*header.axes)
    place = names.index("row")
    inner = math.prod(sizes[place + 1:])
    # In front of the rows: one read for each place of these axes, the asked band only.
    front = [[band] if n == "band" else range(s) for n, s in header.axes[:place]]
    files, at = _filesystem(header.path)
    parts = []
    with files.open_input_file(at) as f:
        for index in itertools.product(*front):
            line = 0
            for i, size in zip(index, sizes):
                line = line * size + i
            f.seek(header.offset + (line * sizes[place] + first) * inner * dtype.itemsize)
            parts.append(np.frombuffer(f.read((last - first) * inner * dtype.itemsize), dtype))
    shape = [1 if n == "band" else s for n, s in header.axes[:place]] + [last - first] + list(sizes[place + 1:])
    block = np.concatenate(parts).reshape(shape)
    if "band" in names:
        block = block.take(0 if names.index("band") < place else band, axis=names.index("band"))
    left = [n for n in names if n != "band"]
    return block if left == ["row", "col"] else block.T


class RowRange(InputPartition):
    def __init__(self, header: Header, scene: str, band: int, first: int, last: int):
        self.header, self.scene, self.band, self.first, self.last = header, scene, band, first, last


class RasterReader(DataSourceReader):
    """Plans a partition per range of rows; filters on scene, band and row choose files and ranges."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.band_axis = options.get("bandaxis", "shortest")
        self.bytes = int(options.get("partitionbytes", 32 << 20))
        self.scenes = self.bands = None
        self.first, self.last = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name, value = (f.attribute[0], f.value) if hasattr(f, "value") and len(f.attribute) == 1 else (None, None)
            if name in ("scene", "band") and isinstance(f, EqualTo):
                own = self.scenes if name == "scene" else self.bands
                both = {value} if own is None else own & {value}
                self.scenes, self.bands = (both, self.bands) if name == "scene" else (self.scenes, both)
            elif name == "row" and isinstance(f, EqualTo):
                self.first, self.last = max(self.first, value), min(self.last, value + 1)
            elif name == "row" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            elif name == "row" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[RowRange]:
        files, root = _filesystem(self.path)
        begin = self.path[:len(self.path) - len(root)] if self.path.endswith(root) else ""
        listed = files.get_file_info(fs.FileSelector(root, recursive=True))
        below = sorted((f.path, f.path[len(root):].strip("/")[:-len(ENDING)]) for f in listed
                       if f.type == fs.FileType.File and f.path.endswith(ENDING) and not any(p[:1] in "_." for p in f.path[len(root):].strip("/").split("/")))
        wanted = [(begin + p, s) for p, s in below if self.scenes is None or s in self.scenes]
        with ThreadPoolExecutor(16) as pool:
            headers = list(pool.map(lambda w: read_header(w[0], self.band_axis), wanted))
        out = []
        for header, (_, scene) in zip(headers, wanted):
            width = max(1, header.size("col") * np.dtype(header.dtype).itemsize * (header.size("band") if header.axes[-1][0] == "band" else 1))
            step = max(1, self.bytes // width)
            for band in range(header.size("band")):
                if self.bands is not None and BANDS[band] not in self.bands:
                    continue
                last = min(self.last, header.size("row"))
                out += [RowRange(header, scene, band, a, min(a + step, last)) for a in range(max(0, self.first), last, step)]
        return out

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        p = partition
        if p is None:  # no file at all
            return
        width = max(1, p.header.size("col"))
        lines = max(1, BATCH // width)
        for a in range(p.first, p.last, lines):
            block = read_rows(p.header, p.band, a, min(a + lines, p.last))
            n, w = block.shape
            yield pa.RecordBatch.from_arrays(
                [pa.array([p.scene] * (n * w), pa.string()), pa.array([BANDS[p.band]] * (n * w), pa.string()), pa.array(np.repeat(np.arange(a, a + n), w)),
                 pa.array(np.tile(np.arange(w), n)), pa.array(np.ascontiguousarray(block).ravel().astype(np.float64))], ["scene", "band", "row", "col", "value"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class RasterWriter(DataSourceWriter):
    """One file per scene from rows (scene, height, width, row, line) in order; files get their names when all tasks are done."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = _filesystem(self.path)
        done = []
        for scene, rows in itertools.groupby(iterator, key=lambda r: r["scene"]):
            aside = f"{root}/_{self.run}-{uuid.uuid4().hex}"
            files.create_dir(root, recursive=True)
            with files.open_output_stream(aside) as out:
                expected, shape = 0, None
                for r in rows:
                    if shape is None:
                        shape = r["height"], r["width"]
                        head = BytesIO()
                        np.lib.format.write_array_header_1_0(head, {"descr": "<f4", "fortran_order": False, "shape": shape})
                        out.write(head.getvalue())
                    if (r["row"], len(r["line"]), r["height"], r["width"]) != (expected, shape[1], *shape):
                        raise ValueError(f"scene {scene}: row {expected} of {shape} expected, got row {r['row']} of {len(r['line'])} values")
                    out.write(np.asarray(r["line"], "<f4").tobytes())
                    expected += 1
                if expected != shape[0]:
                    raise ValueError(f"scene {scene}: {expected} of {shape[0]} rows")
            done.append((aside, f"{root}/{scene}{ENDING}"))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = _filesystem(self.path)
        for aside, name in (f for m in messages if m for f in m.files):
            files.create_dir(name.rsplit("/", 1)[0], recursive=True)
            files.move(aside, name)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _filesystem(self.path)
        for aside, _ in (f for m in messages if m for f in m.files):
            files.delete_file(aside)


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options)


def read_arrays(spark: SparkSession, path: str, band_axis: str = "shortest", partition_bytes: int = 32 << 20) -> DataFrame:
    """(scene, band, row, col, value) of every ``.npy`` file below ``path``, a folder that all machines can open.

    ``scene`` is the file's path below ``path`` without its ending; ``band_axis`` tells which of three dimensions holds
    the bands (VV, then VH).  A task reads a range of rows of about ``partition_bytes``, so a file may have any
    size; conditions on scene, band and row choose what is read at all.
    """
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).option("bandaxis", band_axis).option("partitionbytes", str(partition_bytes)).load(path)


def write_arrays(pixels: DataFrame, path: str) -> None:
    """One ``.npy`` file of 32-bit floats per scene from rows (scene, row, col, value); every pixel of a scene must be there.

    Lines are put together in parallel; a scene's lines go through one task as a stream.
    """
    pixels.sparkSession.dataSource.register(RasterSource)
    lines = pixels.groupBy(F.col("scene").cast("string").alias("scene"), F.col("row").cast("bigint").alias("row")).agg(
        F.array_sort(F.collect_list(F.struct("col", F.col("value").cast("float").alias("value")))).alias("p"))
    lines = lines.select("scene", "row", F.transform("p", lambda x: x["value"]).alias("line"))
    sizes = lines.groupBy("scene").agg((F.max("row") + 1).alias("height"), F.max(F.size("line")).cast("bigint").alias("width"))
    parts = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.join(sizes, "scene").repartition(parts, "scene").sortWithinPartitions("scene", "row")
    ordered.select("scene", "height", "width", "row", "line").write.format(FORMAT).mode("append").save(path)
