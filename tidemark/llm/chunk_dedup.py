"""Exact duplicates by recipes of content-defined chunks.

A text is cut where a rolling hash of the last bytes has a certain form, so equal texts are
cut alike.  Chunks are deduplicated to identifiers which a comparison of their bytes
verifies; two texts are equal when their ordered lists of identifiers are.  The chunks'
bytes are shuffled once, combined on the map side; after that only lists of identifiers
move, however long or frequent a document is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytescan import Hasher, segments, text_bytes
from tidemark.sources.scratch import cut_lineage

WINDOW = 32


def cuts(data: np.ndarray, offsets: np.ndarray, mean: int, least: int, most: int) -> list[list[int]]:
    """Ends of each row's chunks, the row's end last.  Only the row's own bytes decide."""
    marks = np.flatnonzero((Hasher(data).grams(WINDOW) & np.uint64(mean - 1)) == 0) + WINDOW
    out = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ends, last = [], lo
        a, b = np.searchsorted(marks, [lo + WINDOW, hi])
        for m in [*marks[a:b].tolist(), hi]:
            while m - last > most:
                last += most
                ends.append(last)
            if m - last >= least and m < hi:
                ends.append(m)
                last = m
        if last < hi:
            ends.append(hi)
        out.append(ends)
    return out


def _chunked(mean: int, least: int, most: int, id_bytes: int, contents: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            for lo, hi in segments(offsets):
                part, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                raw = part.tobytes()
                ids, recipe, chunks = [], [], []
                for start, ends in zip(at[:-1].tolist(), cuts(part, at, mean, least, most)):
                    own = []
                    for end in ends:
                        chunk = raw[start:end]
                        name = hashlib.blake2b(chunk, digest_size=16).digest()[:id_bytes]
                        own.append(name)
                        if contents:
                            ids.append(name)
                            chunks.append(chunk)
                        start = end
                    recipe.append(b"".join(own))
                if contents:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(chunks, pa.binary())], ["id", "chunk"])
                else:
                    kept = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(recipe, pa.binary())], [*batch.schema.names[:-1], "recipe"])
    return run


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text", mean: int = 2048, least: int = 256,
            most: int = 16384, id_bytes: int = 16) -> DataFrame:
    """(key, text_sha256, recipe): the ordered, verified chunk identifiers of every text.

    ``id_bytes`` shortens the first identifier; tests use it to make different chunks meet.
    Where that happens, the identifier is followed by the chunk's rank among those that
    share it, so that equal recipes always mean equal texts.
    """
    if mean & (mean - 1) or not least <= mean <= most:
        raise ValueError("mean must be a power of two between least and most")
    whole = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(key).alias("key"), F.sha2(whole, 256).alias("text_sha256"), whole.alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    lists = named.mapInArrow(_chunked(mean, least, most, id_bytes, False), f"key {kind}, text_sha256 string, recipe binary")
    # Copies meet before the shuffle; each task sends a chunk's bytes once.
    chunks = named.select("text").mapInArrow(_chunked(mean, least, most, id_bytes, True), "id binary, chunk binary").distinct()
    # Verified: an identifier that stands for two contents is split; hardly ever any.
    shared = chunks.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    clash = cut_lineage(chunks.join(shared, "id"))
    lists = cut_lineage(lists)
    if clash.isEmpty():
        return lists
    ranks = clash.select("id", "chunk").groupBy("id").agg(F.array_sort(F.collect_set("chunk")).alias("all"))
    ranked = ranks.select("id", F.posexplode("all").alias("rank", "chunk"))
    return _resolved(named, lists, ranked, mean, least, most, id_bytes)


def _resolved(named: DataFrame, lists: DataFrame, ranked: DataFrame, mean: int, least: int, most: int, id_bytes: int) -> DataFrame:
    """Recipes with ranks after identifiers that several contents share.

    Only such chunks are joined by their bytes.  A text's own hash ties its parts together.
    """
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rows = []
            for i, ends in enumerate(cuts(data, offsets, mean, least, most)):
                start, sha = int(offsets[i]), batch.column(0)[i].as_py()
                for no, end in enumerate(ends):
                    chunk = data[start:end].tobytes()
                    rows.append((sha, no, hashlib.blake2b(chunk, digest_size=16).digest()[:id_bytes], chunk))
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                                             ["text_sha256", "no", "id", "chunk"])
    pieces = named.select("text_sha256", "text").mapInArrow(parts, "text_sha256 string, no bigint, id binary, chunk binary")
    found = pieces.join(ranked, ["id", "chunk"]).select("text_sha256", "no", "rank").distinct()
    suffix = found.groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("no", "rank"))).alias("ranks"))
    tail = F.coalesce(F.to_json("ranks"), F.lit("")).cast("binary")
    return lists.join(suffix, "text_sha256", "left").select("key", "text_sha256", F.concat("recipe", tail).alias("recipe"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **chunking: int) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Of equal texts the one with the largest key stays.  Null texts count as empty and are
    equal to each other; a null key comes last and stays only where a group has no other.
    Rows that repeat key and text are counted each and share their verdict.  Empty tables
    give an empty result; other columns are not read, so their names cannot clash.
    """
    lists = recipes(docs, key, text, **chunking)
    groups = lists.groupBy("recipe").agg(F.max("key").alias("keep_id"), F.count("*").alias("group_size"))
    same = F.col("key").eqNullSafe(F.col("keep_id"))
    return lists.join(groups, "recipe").select(F.col("key").alias("doc_id"), "keep_id", "group_size", same.alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **chunking: int) -> DataFrame:
    """Rows of ``docs`` whose text stays, each once; all columns as they were."""
    stays = exact_duplicates(docs, key, text, **chunking).filter("kept").select(F.col("doc_id").alias("_stays"), F.col("text_sha256").alias("_sha"))
    here: Column = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    left = docs.select(F.struct("*").alias("_row"), here.alias("_here"))
    joined = left.join(stays.distinct(), F.col(f"_row.{key}").eqNullSafe(F.col("_stays")) & (F.col("_here") == F.col("_sha")), "left_semi")
    return joined.select("_row").distinct().select("_row.*") if _repeats(docs, key) else joined.select("_row.*")


def _repeats(docs: DataFrame, key: str) -> bool:
    """Whether some key comes twice."""
    return not docs.groupBy(key).count().filter("count > 1").isEmpty()
