"""Jaccard similarity join on word shingles: MinHash bands find pairs, full sets verify them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytescan import Hasher, mixed, segments, signed, text_bytes, words
from tidemark.operators.components import label_runs
from tidemark.sources.scratch import cut_lineage


def bands_for(similarity: float, recall: float, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective bands that find a pair at ``similarity`` with probability ``recall``."""
    best = None
    for rows in range(1, hashes + 1):
        chance = similarity**rows
        bands = 1 if chance >= recall else math.ceil(math.log(1 - recall) / math.log(1 - chance))
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError(f"{hashes} hashes cannot reach a recall of {recall}")
    return best


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the different shingles of each text, ordered; shorter texts have one of all their words."""
    row, start, end = words(data, offsets)
    n = len(offsets) - 1
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    one = Hasher(data, 9).slices(start, end)
    weight = np.random.default_rng(5).integers(1, 2**64, size, dtype=np.uint64) | np.uint64(1)
    count = np.bincount(row, minlength=n)
    full = len(one) - size + 1
    if full > 0:
        h = np.zeros(full, np.uint64)
        for k in range(size):
            h += one[k:k + full] * weight[k]
        same = row[:full] == row[size - 1:]
        rows, h = row[:full][same], h[same]
    else:
        rows, h = row[:0], one[:0]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        begin = np.cumsum(count) - count
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            extra[has] += one[begin[short][has] + k] * weight[k]
        rows, h = np.concatenate([rows, short]), np.concatenate([h, extra + count[short].astype(np.uint64)])
    h = mixed(h)
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    head = np.ones(len(rows), bool)
    head[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
    return rows[head], h[head]


def _prints(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two fingerprints) of the sets of n texts."""
    count = np.bincount(row, minlength=n).astype(np.int64)
    has = np.flatnonzero(count)
    begin = (np.cumsum(count) - count)[has]
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(has):
        one[has] = np.add.reduceat(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), begin)
        two[has] = np.add.reduceat(mixed(h ^ np.uint64(0x14057B7EF767814F)), begin)
    return count, signed(one), signed(two)


def _signed_sets(size: int, bands: int, rows_each: int):
    draw = np.random.default_rng(11)
    factor = draw.integers(1, 2**64, bands * rows_each, dtype=np.uint64) | np.uint64(1)
    add = draw.integers(1, 2**64, bands * rows_each, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in segments(offsets):
                row, h = shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], size)
                n = hi - lo
                count, one, two = _prints(row, h, n)
                has = np.flatnonzero(count)
                begin = (np.cumsum(count) - count)[has]
                keys = np.zeros((len(has), bands), np.uint64)
                if len(has):
                    for b in range(bands):
                        code = np.full(len(has), b, np.uint64)
                        for k in range(b * rows_each, (b + 1) * rows_each):
                            x = h * factor[k] + add[k]
                            x ^= x >> np.uint64(32)
                            code = mixed(code + np.minimum.reduceat(x, begin))
                        keys[:, b] = code
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(count > 0, bands, 0))]).astype(np.int32)),
                                                 pa.array(signed(keys.ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(count), pa.array(one), pa.array(two), lists],
                                                 ["doc_id", "n", "one", "two", "bands"])
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in segments(offsets):
                row, h = shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], size)
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                raw = [h[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                prints = [pa.array(x) for x in _prints(row, h, hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *prints, pa.array(raw, pa.binary())], ["node", "n", "one", "two", "members"])
    return run


def _verified(similarity: float):
    """Pairs whose sets are similar enough; the test is in whole numbers of shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, values = [], []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                both = int(np.count_nonzero(np.isin(x, y, assume_unique=True)))
                union = len(x) + len(y) - both
                keep.append(both >= similarity * union - 1e-9)
                values.append(both / union)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(values, pa.float64()).filter(keep)], ["a", "b", "jaccard"])
    return run


def _block_links(similarity: float):
    """Links inside one bucket's pair of blocks, as a count and a tie to one node for each node.

    Set intersections of all pairs are products of incidence matrices over shingles that
    several nodes have.  A pair that shares an earlier busy band is counted there.
    """
    def products(lists: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        out = np.zeros((len(first), len(second)), np.float32)
        if not len(owner):
            return out
        _, name, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        often = np.cumsum(times > 1) - 1
        keep = times[name] > 1
        owner, name = owner[keep], often[name[keep]]
        order = np.argsort(name, kind="stable")
        owner, name = owner[order], name[order]
        for lo in range(0, int(name[-1]) + 1 if len(name) else 0, 4096):
            x, y = np.searchsorted(name, [lo, lo + 4096])
            m = np.zeros((len(lists), 4096), np.float32)
            m[owner[x:y], name[x:y] - lo] = 1
            out += m[first] @ m[second].T
        return out

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        band, i, j = key
        node = pdf["node"].to_numpy()
        block = pdf["block"].to_numpy()
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["members"]]
        size = np.array([len(x) for x in sets], np.float64)
        both = products(sets, first, second).astype(np.float64)
        union = size[first][:, None] + size[second][None] - both
        earlier = products([np.array([b for b in x if b < band], np.int64) for x in pdf["big"]], first, second) > 0
        link = (both >= similarity * union - 1e-9) & ~earlier & (node[first][:, None] != node[second][None])
        links = np.zeros(len(node), np.int64)
        np.add.at(links, first, link.sum(1))
        if i != j:
            np.add.at(links, second, link.sum(0))
        # The least place that a node reaches through links.
        tie = np.arange(len(node))
        while True:
            new = tie.copy()
            if link.any():
                new[first] = np.minimum(new[first], np.where(link, tie[second][None], len(node)).min(1))
                new[second] = np.minimum(new[second], np.where(link, tie[first][:, None], len(node)).min(0))
            if (new == tie).all():
                break
            tie = new
        some = links > 0
        return pd.DataFrame({"a": node[some], "b": node[tie[some]], "links": links[some]})
    return run


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8,
                    recall: float = 0.999999, small: int = 32, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """(membership, ties): rows (doc_id, node) for every row, and (a, b, links).

    A node is a class of texts with the same set of shingles; exact copies meet there before
    anything is paired, so a group of copies costs one row.  Nodes that share a band hash
    are candidates, and all candidates are verified on their full sets.  Buckets of up to
    ``small`` nodes give pairs (both directions, one link each).  Larger buckets are cut into
    blocks that are compared two by two within tasks, so that a pair there is no row: a node
    gets its number of links and a tie to a node it is connected with.  The sums of ``links``
    by ``a`` are exact either way, and the ties connect what the links connect.  Nodes are
    named by 64 bits of the set's fingerprint.
    """
    bands, rows = bands_for(similarity, recall)
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    signs = cut_lineage(slim.mapInArrow(_signed_sets(size, bands, rows), f"doc_id {kind}, n bigint, one bigint, two bigint, bands array<bigint>")
                        .withColumn("node", F.xxhash64("one", "two", "n")))
    nodes = cut_lineage(signs.groupBy("node").agg(F.max("n").alias("n"), F.min("doc_id").alias("speaker"), F.first("bands").alias("bands")))
    spread = nodes.select("node", "n", F.explode("bands").alias("band"))
    # Most bands have one node; they go before anything is joined.
    busy = spread.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1")
    shared = cut_lineage(spread.join(busy, "band"))
    large = shared.filter(F.col("m") > small)
    big = cut_lineage(large.groupBy("node").agg(F.collect_set("band").alias("big")))
    left = shared.filter(F.col("m") <= small).select("band", F.col("node").alias("a"), F.col("n").alias("na"))
    right = left.select("band", F.col("a").alias("b"), F.col("na").alias("nb"))
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
    pairs = left.join(right, "band").filter(near).select("a", "b").distinct()
    # Pairs that also share a large bucket are counted there.
    for end in "ab":
        pairs = pairs.join(big.select(F.col("node").alias(end), F.col("big").alias(f"big_{end}")), end, "left")
    pairs = cut_lineage(pairs.filter(~F.coalesce(F.arrays_overlap("big_a", "big_b"), F.lit(False))).select("a", "b"))
    repeated = not signs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    # Only the speakers of candidate nodes are read again for their sets.
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).unionAll(big.select("node")).distinct()
    asked = wanted.join(nodes.select("node", "speaker"), "node")
    texts = slim.join(asked, F.col("doc_id").eqNullSafe(F.col("speaker"))).select("node", "text")
    # A key may come with several texts; the fingerprint tells which is meant.
    read = texts.mapInArrow(_sets(size), "node bigint, n bigint, one bigint, two bigint, members binary").filter("node = xxhash64(one, two, n)")
    sets = cut_lineage(read.select("node", "members").dropDuplicates(["node"]) if repeated else read.select("node", "members"))
    sided = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    sided = sided.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    links = cut_lineage(sided.mapInArrow(_verified(similarity), "a bigint, b bigint, jaccard double"))
    one = F.lit(1).cast("long").alias("links")
    ties = links.select("a", "b", one).unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"), one))
    blocks = F.ceil(F.col("m") / block).cast("int")
    cut = large.withColumn("k", blocks).withColumn("block", F.pmod(F.xxhash64("node", "band"), F.col("k")).cast("int"))
    placed = cut.select("band", "node", "block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    grouped = (placed.join(sets.join(big, "node"), "node")
               .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
               .groupBy("band", "i", "j").applyInPandas(_block_links(similarity), "a bigint, b bigint, links bigint"))
    return signs.select("doc_id", "node"), ties.unionAll(cut_lineage(grouped))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links, group_size) per row of ``docs``.

    ``copy_of`` is the least key among texts with the same shingles, ``class_id`` the least
    key in the connected component of links, ``n_links`` the number of other shingle sets
    that are similar enough.  Texts without a word share the empty set and link to nothing;
    a null text is empty; texts of fewer words than a shingle have one shingle of all of
    them.  Repeated rows are copies; a null key is a member, never a name unless alone.
    Empty tables give an empty result; other columns are not read.
    """
    members, ties = similar_classes(docs, key, text, **settings)
    linked = ties.groupBy("a").agg(F.sum("links").alias("n_links")).withColumnRenamed("a", "node")
    zero = F.lit(0).cast("long").alias("scene_id")
    edges = ties.filter("a <> b").select(zero, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels = label_runs(linked.select(zero, "node"), edges).select("node", "label")
    nodes = (members.groupBy("node").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("size"))
             .join(linked, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    groups = nodes.groupBy("label").agg(F.min("copy_of").alias("class_id"), F.sum("size").alias("group_size"))
    named = cut_lineage(nodes.join(groups, "label").select("node", "copy_of", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "group_size"))
    return members.join(named, "node").select("doc_id", "class_id", "copy_of", "n_links", "group_size")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` without the members of a group but one with its least key; all columns stay.

    Rows are told apart by a number of their own, so null keys, a key on several texts and
    repeated rows are judged row by row.  A null key is kept only if its group has no other.
    """
    rows = cut_lineage(docs.select(F.monotonically_increasing_id().alias("_id"), F.struct("*").alias("_row")))
    told = rows.select("_id", F.col(f"_row.{key}").alias("key"), F.col(f"_row.{text}").alias("text"))
    grouped = similar_groups(told, "_id", "text", **settings).filter("group_size > 1").select(F.col("doc_id").alias("_id"), "class_id")
    grouped = cut_lineage(grouped)
    least = F.min(F.struct(F.col("key").isNull().alias("nameless"), "key", "_id")).alias("least")
    kept = grouped.join(told.select("_id", "key"), "_id").groupBy("class_id").agg(least).select("least._id")
    gone = grouped.select("_id").join(kept, "_id", "left_anti")
    return rows.join(gone, "_id", "left_anti").select("_row.*")
