"""JSON lists that split: a file that is one list of records is cut into records by many tasks.

Spark cuts the files at closing braces, wherever they stand.  What a range of a file does
to the state of a reader (inside a string or not, depth of nesting) depends on its start only
through these two, so a first pass gives each range its effect for both possible starts, the
effects are composed along each file, and in a second pass every range cuts its records by
itself.  Records that cross a seam come in parts and are put together at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import cut_lineage, new_path

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_TO_BRACE = re.compile(r'(?:[^{"]|"(?:[^"\\]|\\.)*")*', re.S)


def effect(text: str, in_string: bool) -> tuple[bool, int]:
    """(inside a string at the end, change of depth) over a text without closing braces outside strings, and a brace after it."""
    if in_string:
        end = _REST_OF_STRING.match(text)
        if end is None:
            return True, 0
        text = text[end.end():]
    bare = _STRING.sub("", text)
    opened = bare.find('"')
    if opened >= 0:
        bare = bare[:opened]
    depth = bare.count("{") + bare.count("[") - bare.count("]")
    return opened >= 0, depth - (opened < 0)


def record_in(text: str, in_string: bool) -> str:
    """``text`` from its first opening brace outside strings."""
    at = _REST_OF_STRING.match(text).end() if in_string else 0
    return text[_TO_BRACE.match(text, at).end():]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The texts of each range of a file, in order; a task reads a range from beginning to end."""
    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
    for key, group in groupby(rows, key=lambda r: r[:2]):
        yield key, (r[2] for r in group)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, start), texts in _ranges(batches):
        inside, depth, opening = [False, True], [0, 0], None
        for text in texts:
            if opening is None:
                opening = text.lstrip("﻿ \t\r\n")[:1]
            for k in (0, 1):
                inside[k], change = effect(text, inside[k])
                depth[k] += change
        row = [[file], [start], [inside[0]], [depth[0]], [inside[1]], [depth[1]], [opening or ""]]
        types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["file", "start", "in0", "depth0", "in1", "depth1", "opening"])


def _cut(states):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
            cols = zip(*rows)
            types = (pa.string(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["file", "start", "part", "value"])
        out = []
        for (file, start), texts in _ranges(batches):
            state = states.value[unquote(file), start]
            if state is None:  # no list
                continue
            inside, depth = state
            # part: 0 a whole record, 1 the end of one (or all of its middle), 2 a beginning.
            held, whole, began = [], depth <= 1, inside
            for text in texts:
                inside, change = effect(text, inside)
                depth += change
                held.append(text + "}")
                if depth == 1 and not inside:
                    joined = "".join(held)
                    out.append((file, start, 0, record_in(joined, began)) if whole else (file, start, 1, joined))
                    held, whole, began = [], True, False
                if len(out) >= 4096:
                    yield batch(out)
                    out = []
            # Behind the last brace of a file there is none; what is left then holds no record.
            if held and depth > (1 if whole else 0):
                joined = "".join(held)
                out.append((file, start, 2, record_in(joined, began)) if whole else (file, start, 1, joined))
        if out:
            yield batch(out)
    return run


@contextmanager
def _steady_ranges(spark: SparkSession, range_bytes: int | None):
    """Both passes read the same ranges, also if executors come or go in between."""
    wanted = {"spark.sql.files.minPartitionNum": spark.conf.get("spark.sql.files.minPartitionNum", None) or str(spark.sparkContext.defaultParallelism)}
    if range_bytes is not None:
        wanted |= {"spark.sql.files.maxPartitionBytes": str(range_bytes), "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def list_records(spark: SparkSession, path: str, range_bytes: int | None = None) -> tuple[DataFrame, list[str]]:
    """(rows (value) with the text of each record, files that are no lists).

    A list holds objects; plain values between them are left out, lists directly in the list are not understood.  The state at each range's start goes to all tasks: one row per
    range of a file, which the driver lists anyway.  ``range_bytes`` bounds a range, else the session does.  Runs actions; the records are written to the shared folder.
    """
    with _steady_ranges(spark, range_bytes):
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
        texts = spark.read.option("lineSep", "}").text(path).select(*place, "value")
        types = "file string, start bigint, in0 boolean, depth0 bigint, in1 boolean, depth1 bigint, opening string"
        states, others = {}, []
        effects = sorted(texts.mapInArrow(_effects, types).collect(), key=lambda r: (r["file"], r["start"]))
        for quoted, ranges in groupby(effects, key=lambda r: r["file"]):
            file, listed, inside, depth = unquote(quoted), None, False, 0
            for r in ranges:
                if listed is None and not (listed := r["opening"] == "["):
                    others.append(file)
                states[file, r["start"]] = (inside, depth) if listed else None
                inside, depth = (r["in1"], depth + r["depth1"]) if inside else (r["in0"], depth + r["depth0"])
        sent = spark.sparkContext.broadcast(states)
        # All files again: without some of them Spark would choose other ranges.
        parts = cut_lineage(texts.mapInArrow(_cut(sent), "file string, start bigint, part int, value string"))
    # Seams: at most two parts a range; a beginning opens a record, ends and middles go on with it.
    seams = parts.filter("part > 0").withColumn("_no", F.count_if(F.col("part") == 2).over(
        Window.partitionBy("file").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, 0)))
    joined = seams.groupBy("file", "_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part", "value"))), lambda x: x["value"]), "").alias("value"))
    return parts.filter("part = 0").select("value").unionAll(joined.select("value")), others


def read_json_lists(spark: SparkSession, path: str, range_bytes: int | None = None) -> tuple[DataFrame | None, list[str]]:
    """(table of the records of all list files, files that are no lists); no table where there is no record."""
    records, others = list_records(spark, path, range_bytes)
    lines = new_path(spark, "json-lines")
    records.select(F.translate("value", "\r\n", "  ").alias("value")).write.text(lines)
    written = spark.read.text(lines)
    return (None if written.isEmpty() else spark.read.json(lines)), others


def write_list(records: DataFrame, path: str) -> None:
    """Write the texts (value) of records as one file that is one JSON list, a record a line, in no set order.

    Many tasks make the texts; one task only copies them into the file, line by line, and sorts or holds nothing.  Runs actions.
    """
    lines = cut_lineage(records.select(F.monotonically_increasing_id().alias("line"), "value"))
    first = lines.agg(F.min("line")).first()[0]
    begin = lines.filter(F.col("line") == F.lit(first)).select(F.concat(F.lit("["), "value").alias("value"))
    others = lines.filter(F.col("line") != F.lit(first)).select(F.concat(F.lit(","), "value").alias("value"))
    end = records.sparkSession.range(1).select(F.lit("[]" if first is None else "]").alias("value"))
    # A union keeps the order of its sides, and one task reads them one after the other.
    begin.unionAll(others).unionAll(end).coalesce(1).write.text(path)
