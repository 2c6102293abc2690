"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, cosines of the original vectors.

A rotation of the centred principal directions is learned so that the signs of the rotated
coordinates lose as little as possible (Gong and Lazebnik, 2011).  Several rotations give a
code of as many bits as the index needs; the code is cut into substrings and every vector
is entered in one table for each.  Two vectors that agree in all bits of some substring
are candidates if the rest of their codes is near as well, and candidates are compared by
the cosine of the original vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bytescan import mixed, signed
from tidemark.operators.components import label_runs
from tidemark.sources.scratch import cut_lineage

SKETCH = 64  # bits of the code that travel with a table entry


def tables_for(rows: int, similarity: float, recall: float) -> tuple[int, int]:
    """(tables, bits each): as many bits as keep chance meetings near one a row, and as many tables as the recall needs.

    A bit differs with probability angle / pi, so vectors at ``similarity`` share a
    substring of b bits with probability (1 - angle / pi)**b.
    """
    bits = max(8, math.ceil(math.log2(max(2, rows))))
    share = (1 - math.acos(similarity) / math.pi)**bits
    return math.ceil(math.log(1 - recall) / math.log(1 - share)), bits


@dataclass(frozen=True)
class Quantiser:
    """Centre, projection onto all code bits, and the bits of each table."""

    centre: np.ndarray
    projection: np.ndarray
    tables: np.ndarray

    def codes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sketch, keys by table) of unit vectors."""
        on = (unit - self.centre) @ self.projection > 0
        weight = np.uint64(1) << np.arange(SKETCH, dtype=np.uint64)
        sketch = (on[:, :SKETCH] * weight[:min(SKETCH, on.shape[1])]).sum(1, dtype=np.uint64)
        keys = np.empty((len(unit), len(self.tables)), np.uint64)
        for t, which in enumerate(self.tables):
            code = mixed(np.full(len(unit), t + 1, np.uint64))
            for lo in range(0, len(which), 32):
                part = which[lo:lo + 32]
                code = mixed(code + (on[:, part] * (np.uint64(1) << np.arange(len(part), dtype=np.uint64))).sum(1, dtype=np.uint64))
            keys[:, t] = code
        return sketch, keys


def rotation(flat: np.ndarray, number: int, rounds: int = 30, seed: int = 17) -> np.ndarray:
    """The ``number``-th rotation of centred vectors: a random start, then by turns the nearest codes and the best rotation onto them."""
    d = flat.shape[1]
    turn = np.linalg.qr(np.random.default_rng([seed, number]).standard_normal((d, d)))[0]
    for _ in range(rounds if len(flat) else 0):
        code = np.where(flat @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(flat.T @ code)
        turn = left @ right
    return turn


def principal(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and principal directions."""
    centre = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
    return centre, np.linalg.eigh((sample - centre).T @ (sample - centre))[1]


def learned(sample: np.ndarray, tables: int, bits: int, rounds: int = 30, seed: int = 17, spark: SparkSession | None = None) -> Quantiser:
    """Rotations for ``tables`` x ``bits`` balanced bits (at least ``SKETCH``) from unit vectors, one task each if there is a session.

    Bits of all rotations are dealt to the tables at random, so that a table's bits do not hang together.
    """
    d, total = sample.shape[1], max(SKETCH, tables * bits)
    centre, axes = principal(sample)
    count = -(-total // d)
    if spark is None:
        turns = [rotation((sample - centre) @ axes, i, rounds, seed) for i in range(count)]
    else:
        sent = spark.sparkContext.broadcast((sample - centre) @ axes)

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([rotation(sent.value, i, rounds, seed).tobytes()], pa.binary())], ["id", "turn"])
        rows = spark.range(0, count, 1, count).mapInArrow(fit, "id bigint, turn binary").collect()
        turns = [np.frombuffer(r["turn"]).reshape(d, d) for r in sorted(rows, key=lambda r: r["id"])]
    projection = np.concatenate([axes @ t for t in turns], 1)[:, :total]
    return Quantiser(centre, projection, np.random.default_rng(seed).permutation(total)[:tables * bits].reshape(tables, bits))


def _raw(column: pa.Array, kind: str) -> Iterator[bytes | None]:
    """Each vector's numbers as bytes; null where it links with nothing."""
    for v in column:
        raw = None
        if v.is_valid and v.values is not None and v.values.null_count == 0:
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), kind) + 0.0  # no negative zeros
            size = np.abs(x.astype(np.float64))
            if len(x) and np.isfinite(size).all() and size.any():
                raw = x.astype(kind, copy=False).tobytes()
        yield raw


def _prepared(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pa.array(list(_raw(batch.column(1), kind)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], ["vec_id", "raw"])
    return run


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision; large and small numbers are scaled first."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _entered(models: dict[int, Quantiser], kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v.as_buffer()) for v in batch.column(1)], np.int64)
            for size in np.unique(sizes).tolist():
                at = pa.array(np.flatnonzero(sizes == size))
                sketch, keys = models[size].codes(units(batch.column(1).take(at).to_pylist(), kind))
                width = keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(signed(mixed(keys + np.uint64(size)).ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(signed(sketch)), lists], ["node", "sketch", "keys"])
    return run


def _verified(similarity: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            near = np.zeros(len(a), bool)
            sizes = np.array([len(x) if len(x) == len(y) else 0 for x, y in zip(a, b)], np.int64)
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == size)
                x, y = units([a[i] for i in at], kind), units([b[i] for i in at], kind)
                near[at] = (x * y).sum(1) >= similarity
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(2)], ["a", "b"])
    return run


def _block_links(similarity: float, kind: str):
    """Links between two blocks of a large bucket: for each node the copies it links with, and a tie to one of them.

    A pair that shares an earlier large bucket is counted there.
    """
    def earlier(lists: list[np.ndarray], key: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.zeros((len(first), len(second)), np.float32)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = np.concatenate(lists)
        before = flat < key
        owner = owner[before]
        if not len(owner):
            return out > 0
        names, name = np.unique(flat[before], return_inverse=True)
        for lo in range(0, len(names), 4096):
            some = (name >= lo) & (name < lo + 4096)
            m = np.zeros((len(lists), 4096), np.float32)
            m[owner[some], name[some] - lo] = 1
            out += m[first] @ m[second].T
        return out > 0

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, i, j = key
        node, block = pdf["node"].to_numpy(), pdf["block"].to_numpy()
        copies = pdf["copies"].to_numpy()
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, tie = np.zeros(len(node), np.int64), np.arange(len(node))
        if len(first) and len(second):
            unit = units(pdf["raw"].tolist(), kind)
            link = unit[first] @ unit[second].T >= similarity
            link &= node[first][:, None] != node[second][None]
            link &= ~earlier([np.asarray(x, np.int64) for x in pdf["big"]], bucket, first, second)
            np.add.at(links, first, link @ copies[second])
            if i != j:
                np.add.at(links, second, copies[first] @ link)
            # The least place that a node reaches through links.
            while True:
                new = tie.copy()
                new[first] = np.minimum(new[first], np.where(link, tie[second][None], len(node)).min(1))
                new[second] = np.minimum(new[second], np.where(link, tie[first][:, None], len(node)).min(0))
                if (new == tie).all():
                    break
                tie = new
        some = links > 0
        return pd.DataFrame({"a": node[some], "b": node[tie[some]], "links": links[some]})
    return run


def split_join(rows: DataFrame, facts: DataFrame, on: str, weight: str, parts: int = 1000) -> DataFrame:
    """``rows`` with the one row of ``facts`` that has the same ``on``; ``weight`` in ``facts`` says how many rows ask for it.

    Facts that a ``parts``-th of all rows or more ask for are at most ``parts``: they are sent
    to every task, so that no task gets all rows of a hot key.  The others are shuffled.
    """
    bound = F.sum(weight).alias("_all")
    least = F.greatest(F.lit(1.0), F.coalesce(F.col("_all"), F.lit(0)) / parts)
    sized = facts.crossJoin(F.broadcast(facts.agg(bound))).withColumn("_hot", F.col(weight) >= least).drop("_all")
    hot, cold = (F.broadcast(sized.filter("_hot")).drop("_hot"), sized.filter("NOT _hot").drop("_hot"))
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(sized.filter("_hot").select(on)), on, "left_anti").join(cold, on))


def similar_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", similarity: float = 0.95, recall: float = 0.999,
                    sample: int = 16384, radius: int = 20, small: int = 32, block: int = 512) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, nodes, ties): rows (vec_id, name), the different vectors (name, node, copies, raw, ...), and (a, b, links).

    A node is a vector with all its exact copies, so a group of copies costs one row.  All
    nodes are entered in the tables; the quantiser is fitted on at most ``sample`` of them
    (the least digests), for each length of vector.  ``recall`` is the chance that a pair
    exactly at ``similarity`` meets in a table; nearer pairs meet more often.  Entries
    carry 64 bits of the code, and pairs that differ in more than ``radius`` of them are no
    candidates (at 0.95 the chance of that is below 1e-5).  Buckets of up to ``small`` nodes give pairs; larger ones are
    cut into blocks of about ``block`` nodes that are compared two by two inside tasks, so
    a pair there is no row.  ``links`` sums to the number of other vectors that a vector of
    ``a`` is linked with, copies of ``b`` counted, own copies not; ties connect what links connect.
    """
    spark = vectors.sparkSession
    element = vectors.schema[vector].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    id_type = vectors.schema[key].dataType.simpleString()
    slim = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("raw"))
    rows = slim.mapInArrow(_prepared(kind), f"vec_id {id_type}, raw binary").withColumn("name", F.when(F.col("raw").isNotNull(), F.unhex(F.md5("raw"))))
    rows = cut_lineage(rows)
    nodes = cut_lineage(rows.filter("raw IS NOT NULL").groupBy("name")
                        .agg(F.first("raw").alias("raw"), F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.count_if(F.col("vec_id").isNull()).alias("nameless"))
                        .withColumn("node", F.monotonically_increasing_id()))
    models = {}
    for row in nodes.groupBy(F.octet_length("raw").alias("size")).agg(F.count("*").alias("n")).collect():
        held = nodes.filter(F.octet_length("raw") == row["size"]).orderBy("name").limit(sample).select("raw").toArrow()
        models[row["size"]] = learned(units(held.column(0).to_pylist(), kind), *tables_for(row["n"], similarity, recall), spark=spark)
    entered = nodes.select("node", "raw").mapInArrow(_entered(models, kind), "node bigint, sketch bigint, keys array<bigint>")
    spread = entered.select("node", "sketch", F.explode("keys").alias("key"))
    # Most buckets have one node; they go before anything is joined.
    busy = spread.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    shared = cut_lineage(spread.join(busy, "key"))
    large = shared.filter(F.col("m") > small)
    big = cut_lineage(large.groupBy("node").agg(F.collect_set("key").alias("big")))
    left = shared.filter(F.col("m") <= small).select("key", F.col("node").alias("a"), F.col("sketch").alias("x"))
    right = left.select("key", F.col("a").alias("b"), F.col("x").alias("y"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius)
    pairs = left.join(right, "key").filter(close).select("a", "b").distinct()
    # Pairs that also share a large bucket are counted there.
    for end in "ab":
        pairs = pairs.join(big.select(F.col("node").alias(end), F.col("big").alias(f"big_{end}")), end, "left")
    pairs = pairs.filter(~F.coalesce(F.arrays_overlap("big_a", "big_b"), F.lit(False))).select("a", "b")
    sided = pairs.join(nodes.select(F.col("node").alias("a"), F.col("raw").alias("u")), "a")
    sided = sided.join(nodes.select(F.col("node").alias("b"), F.col("raw").alias("v")), "b").select("a", "b", "u", "v")
    links = cut_lineage(sided.mapInArrow(_verified(similarity, kind), "a bigint, b bigint"))
    sizes = nodes.select(F.col("node").alias("b"), F.col("copies").alias("links"))
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parts = F.ceil(F.col("m") / block).cast("int")
    cut = large.withColumn("k", parts).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("k")).cast("int"))
    placed = cut.select("key", "node", "block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    grouped = (placed.join(nodes.select("node", "raw", "copies").join(big, "node"), "node")
               .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
               .groupBy("key", "i", "j").applyInPandas(_block_links(similarity, kind), "a bigint, b bigint, links bigint"))
    ties = cut_lineage(both.join(sizes, "b").select("a", "b", "links").unionAll(grouped))
    return rows.select("vec_id", "name"), nodes, ties


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", **settings) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    Vectors whose cosine is at least ``similarity`` are linked, exact copies among them;
    ``n_links`` counts the other rows a row is linked with, ``component_id`` is the least key
    in its connected component, ``kept`` says whether that is its own.  A vector that is
    null, empty or zero, or has null or non-finite numbers, links with nothing and is kept; vectors of
    different lengths do not link.  Repeated rows are copies and linked; a null key is a
    member and no name, unless all in the component are null.  An empty table gives an
    empty result; other columns are not read.
    """
    members, nodes, ties = similar_vectors(vectors, key, vector, **settings)
    linked = ties.groupBy("a").agg(F.sum("links").alias("linked")).withColumnRenamed("a", "node")
    zero = F.lit(0).cast("long").alias("scene_id")
    edges = ties.filter("a <> b").select(zero, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels = label_runs(linked.select(zero, "node"), edges).select("node", "label")
    told = (nodes.select("name", "node", "copies", "least").join(linked, "node", "left").join(labels, "node", "left")
            .withColumn("label", F.coalesce("label", "node")))
    groups = told.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("copies").alias("asked"))
    named = cut_lineage(split_join(told, groups, "label", "asked")
                        .select("name", "copies", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")))

    def shown(n_links: Column, component: Column) -> list[Column]:
        return [F.col("vec_id"), n_links.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")]
    found = split_join(members.filter("name IS NOT NULL"), named, "name", "copies").select(*shown(F.col("n_links"), F.col("component_id")))
    alone = members.filter("name IS NULL").select(*shown(F.lit(0), F.col("vec_id")))
    return found.unionAll(alone)
