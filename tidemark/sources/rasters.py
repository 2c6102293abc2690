"""Array files to pixel tables, file listings, and tile sinks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dataset import prefer_arrays

ROWS_PER_BATCH = 64
BANDS = ("VV", "VH")  # in the order of an array's bands


def _plane(arr: np.ndarray, band: int, band_axis: str) -> np.ndarray:
    """The asked band of an array file; a file with two dimensions has only one.

    A band that the file lacks is an error.
    """
    if arr.ndim == 2:
        return arr
    if arr.ndim != 3:
        raise ValueError(f"an array of {arr.ndim} dimensions is no raster")
    return arr.take(band, axis={"first": 0, "last": 2, "shortest": int(np.argmin(arr.shape))}[band_axis])


def read_rasters(spark: SparkSession, path: str, polarization: str = "VV", band_axis: str = "shortest") -> DataFrame:
    """(scene, row, col, value) of every ``.npy`` file below ``path``.

    ``scene`` is the file's path below ``path`` without its ending, so equal names in two
    folders stay two scenes (below a pattern it is the whole path).  ``band_axis`` tells
    which dimension holds the bands (VV, then VH): first, last or the shortest one.  Files
    are decoded in the task that read them and leave it in slices of a few lines, so a large
    scene never becomes one Arrow batch; a file itself is one value of at most 2 GB.
    """
    band = BANDS.index(polarization.upper())

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["scene"], batch["content"]):
                arr = _plane(np.load(io.BytesIO(content), allow_pickle=False), band, band_axis).astype("float32")
                height, width = arr.shape
                for top in range(0, height, ROWS_PER_BATCH):
                    part = arr[top:top + ROWS_PER_BATCH]
                    n = part.shape[0]
                    yield pd.DataFrame({"scene": name, "row": np.repeat(np.arange(top, top + n, dtype="int64"), width),
                                        "col": np.tile(np.arange(width, dtype="int64"), n), "value": part.ravel().astype("float64")})
    root = path.rstrip("/") + "/"
    at = F.locate(root, F.col("path"))
    below = F.when(at > 0, F.substring(F.col("path"), at + len(root), F.length("path"))).otherwise(F.col("path"))
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
             .select(F.regexp_replace(below, r"\.npy$", "").alias("scene"), "content"))
    return files.mapInPandas(decode, "scene string, row bigint, col bigint, value double")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files; the content column is never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def list_raster_files(spark: SparkSession, path: str) -> DataFrame:
    return prefer_arrays(list_files(spark, path))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tile arrays by split (train, val, test)."""
    tiles.write.mode("overwrite").partitionBy("split").parquet(path)


def write_report(summary: DataFrame, path: str) -> None:
    """A summary of a few rows as one JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)
