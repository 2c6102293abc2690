"""Position files and the position store."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.json_lists import read_json_lists
from tidemark.sources.scratch import cut_lineage


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Header CSV, every field as text; unreadable bytes become replacement characters.

    All files must have one header, else reading fails; :func:`csv_by_header` takes folders
    that mix them.  ``multi_line`` allows quoted line breaks; a file is then one task's work.
    ``spark.sql.caseSensitive`` should be true when a file may hold both ``lat`` and ``LAT``.
    """
    return spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", encoding="UTF-8", escape='"', enforceSchema=False,
                          multiLine=multi_line, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def csv_by_header(spark: SparkSession, path: str, multi_line: bool = False) -> list[DataFrame]:
    """One table for each different header line below ``path``, ordered by header.

    A first pass looks at the line that begins each file; only the names of the files come
    to the driver, which lists them anyway.
    """
    place = F.col("_metadata.file_block_start") == 0
    begin = (spark.read.text(path).filter(place).select(F.col("_metadata.file_path").alias("file"), "value")
             .withColumn("line", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "line").alias("header")))
    files: dict[str, list[str]] = {}
    for r in begin.collect():
        files.setdefault(r.header, []).append(unquote(r.file))
    return [read_csv(spark, sorted(files[h]), multi_line) for h in sorted(files)]


def read_json(spark: SparkSession, path: str, lines: bool = False, range_bytes: int | None = None) -> DataFrame:
    """A JSON list of records, or an object with a ``records`` list.

    ``lines`` reads one record per line.  Lists are cut into records by many tasks (:mod:`json_lists`); a file
    with an object is one JSON value, read by one task.  ``range_bytes`` bounds what a task reads of a list.
    Records that spell a field ``mmsi`` and ``MMSI`` need ``spark.sql.caseSensitive`` set to true.
    """
    if lines:
        return spark.read.json(path)
    listed, others = read_json_lists(spark, path, range_bytes)
    if not others and listed is not None:
        return listed
    whole = spark.read.json(others or path, multiLine=True)
    kind = whole.schema["records"].dataType if "records" in whole.columns else None
    if isinstance(kind, T.ArrayType):
        whole = whole.select(F.explode("records").alias("r")).select("r.*")
    return whole if listed is None else listed.unionByName(whole, allowMissingColumns=True)


def append_positions(clean: DataFrame, path: str, batch: str | None = None) -> None:
    """Add to the store, one folder per day and batch; repeated records are kept.

    A batch counts once: a repeated or retried import under the same name replaces what the
    batch has on the same days.  Without a name each call is a batch of its own.  Rows are
    brought together by day first, which keeps files few; a busy day is split by size.  Inside a
    file they lie by ship and time.
    """
    dated = clean.withColumns({"date": F.to_date("ts"), "batch": F.lit(batch or f"import-{uuid.uuid4().hex}")}).hint("rebalance", "date")
    (dated.sortWithinPartitions("date", "mmsi", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date", "batch").parquet(path))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """All stored positions; ``batch`` tells the import, always as text."""
    stored = spark.read.parquet(path)
    return stored.withColumn("batch", F.col("batch").cast("string"))


def replace_candidates(candidates: DataFrame, spills: DataFrame, path: str, buckets: int = 64) -> None:
    """Replace the stored candidates of exactly ``spills``, also where the new run found none.

    The store has a folder per bucket of spills, so their number does not grow; the buckets
    that the spills fall in are rewritten.  A row without a ship notes that a spill was run,
    which :func:`read_candidates` leaves out.  ``buckets`` must stay the same for a store.
    """
    spark = spills.sparkSession
    bucket = F.pmod(F.xxhash64(F.col("spill_id").cast("bigint")), F.lit(buckets)).cast("int")
    asked = cut_lineage(spills.select(F.col("spill_id").cast("bigint").alias("spill_id")).distinct().withColumn("bucket", bucket))
    fresh = candidates.withColumn("spill_id", F.col("spill_id").cast("bigint")).join(asked, "spill_id")
    rows = asked.unionByName(fresh, allowMissingColumns=True)
    try:
        old = spark.read.parquet(path)
    except AnalysisException as none:
        if none.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        touched = old.join(asked.select("bucket").distinct(), "bucket", "left_semi")
        rows = rows.unionByName(touched.join(asked.select("spill_id"), "spill_id", "left_anti"), allowMissingColumns=True)
    # Written aside first: the rows come from the folders that they replace.
    cut_lineage(rows).hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """All stored candidates."""
    return spark.read.parquet(path).filter("vessel_id IS NOT NULL").drop("bucket")
