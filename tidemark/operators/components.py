"""Connected components of masks: labels inside blocks, then joins over what touches across borders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.scratch import cut_lineage


CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))


def cross_votes(pixels: DataFrame) -> DataFrame:
    """Each pixel and its four neighbours; ``own`` marks the pixel itself."""
    arms = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in CROSS]))
    return pixels.withColumn("_s", arms).withColumns({
        "row": F.col("row") + F.col("_s.dr"), "col": F.col("col") + F.col("_s.dc"),
        "own": (F.col("_s.dr") == 0) & (F.col("_s.dc") == 0)}).drop("_s")


def opened(mask: DataFrame, dims: DataFrame) -> DataFrame:
    """Mask without single-pixel speckle: erosion, then dilation, with a 3x3 cross.

    Only mask pixels move: an eroded pixel is one that all its neighbours inside the
    scene (``dims`` has h, w) vouch for.  Gives the rows of the opened mask.
    """
    on = mask.filter("mask = 1")
    votes = cross_votes(on.select("scene_id", "row", "col")).groupBy("scene_id", "row", "col").agg(F.bool_or("own").alias("own"), F.count("*").alias("k")).filter("own")
    # A vote is missing for every side on the scene's edge.
    r, c = F.col("row"), F.col("col")
    edges = sum((x.cast("int") for x in (r == 0, c == 0, r == F.col("h") - 1, c == F.col("w") - 1)), F.lit(0))
    core = (votes.join(dims.select("scene_id", "h", "w"), "scene_id").filter(F.col("k") + edges == len(CROSS))
            .select("scene_id", "row", "col"))
    grown = cross_votes(core).select("scene_id", "row", "col").distinct()
    return on.join(grown, ["scene_id", "row", "col"], "left_semi")


def label_runs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scene_id, node, label): label = smallest node of the component.

    Each round every node moves to the neighbour with the smallest round-specific hash
    (and on to that one's own choice); the edges are rewritten between the chosen nodes,
    and repeats and loops drop out.  With hashed priorities long chains break up evenly,
    so the graph shrinks by a constant factor per round, until no edge is left.  The moves
    are chained at the end, last first.  Rounds are written to the shared folder, which
    keeps plans short and survives lost executors.  Runs actions.
    """
    left = cut_lineage(edges)
    size, turn = left.count(), 0
    moves: list[DataFrame] = []
    while size:
        both = left.select("scene_id", "a", "b").unionAll(left.select("scene_id", F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("to"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("to"))
        chosen = (both.groupBy("scene_id", "a").agg(F.min(rank).alias("m"))
                  .select("scene_id", F.col("a").alias("node"), F.least("m", own)["to"].alias("to")))
        move = cut_lineage(_follow(chosen, chosen))
        moves.append(move)
        a, b = (move.select("scene_id", F.col("node").alias(k), F.col("to").alias(f"_{k}")) for k in ("a", "b"))
        left = cut_lineage(left.join(a, ["scene_id", "a"]).join(b, ["scene_id", "b"]).filter("_a <> _b")
                           .select("scene_id", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        before, size, turn = size, left.count(), turn + 1
        if size >= before:
            # The node with the largest hash always moves, so its edges shrink.
            raise RuntimeError(f"{size} edges left of {before}")
    chained: DataFrame | None = None
    for move in reversed(moves):
        chained = move if chained is None else _follow(move, chained)
    if chained is None:
        return nodes.select("scene_id", "node", F.col("node").alias("label"))
    placed = nodes.join(chained, ["scene_id", "node"], "left").select("scene_id", "node", F.coalesce("to", "node").alias("rep"))
    names = placed.groupBy("scene_id", "rep").agg(F.min("node").alias("label"))
    return placed.join(names, ["scene_id", "rep"]).select("scene_id", "node", "label")


def _follow(move: DataFrame, then: DataFrame) -> DataFrame:
    """Chain two tables of moves; a target without a further move stays."""
    step = then.select("scene_id", F.col("node").alias("to"), F.col("to").alias("_next"))
    return move.join(step, ["scene_id", "to"], "left").select("scene_id", "node", F.coalesce("_next", "to").alias("to"))


def block_nodes(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """For pixels in order of row and column: the first pixel (row << 32 | column) of each one's 8-connected component."""
    n = len(row)
    if not n:
        return np.zeros(0, np.int64)
    head = np.append(True, (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1))
    first = np.flatnonzero(head)
    line, low, high = row[first], col[first], col[np.append(first[1:], n) - 1]
    # Runs of the next line that overlap, one step to each side included.
    wide = int(col.max()) + 3
    begin = np.searchsorted(line * wide + high, (line + 1) * wide + np.maximum(low - 1, 0))
    end = np.searchsorted(line * wide + low, (line + 1) * wide + high + 1, "right")
    many = np.maximum(end - begin, 0)
    a = np.repeat(np.arange(len(first)), many)
    b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
    root = np.arange(len(first))
    while True:
        new = root.copy()
        # Trees hook onto the least root they touch, then all paths are cut short.
        np.minimum.at(new, root[a], root[b])
        np.minimum.at(new, root[b], root[a])
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new[root]
    node = (line.astype(np.int64) << 32) | low.astype(np.int64)
    return node[root][np.cumsum(head) - 1]


def _label_block(block: pa.Table) -> pa.Table:
    ordered = block.sort_by([("row", "ascending"), ("col", "ascending")])
    row, col = (ordered.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
    return ordered.append_column("_node", pa.array(block_nodes(row, col)))


def components(mask: DataFrame, block: int = 256) -> DataFrame:
    """Mask pixels with ``component``, its first pixel (row << 32 | column); 8-connected.

    Scenes are cut into blocks that are labelled in one pass each; only components that
    touch across a border enter the graph.
    """
    on = mask.filter("mask = 1").withColumns({"_br": F.floor(F.col("row") / block), "_bc": F.floor(F.col("col") / block)})
    schema = T.StructType([*on.schema.fields, T.StructField("_node", T.LongType())])
    labelled = cut_lineage(on.groupBy("scene_id", "_br", "_bc").applyInArrow(_label_block, schema))
    r, c = F.pmod(F.col("row"), F.lit(block)), F.pmod(F.col("col"), F.lit(block))
    border = labelled.filter(r.isin(0, block - 1) | c.isin(0, block - 1)).select("scene_id", "row", "col", "_br", "_bc", "_node")
    ahead = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    steps = border.withColumn("_s", ahead).select("scene_id", (F.col("row") + F.col("_s.dr")).alias("row"), (F.col("col") + F.col("_s.dc")).alias("col"),
                                                  F.col("_br").alias("_r"), F.col("_bc").alias("_c"), F.col("_node").alias("a"))
    outside = (F.floor(F.col("row") / block) != F.col("_r")) | (F.floor(F.col("col") / block) != F.col("_c"))
    met = steps.filter(outside).join(border.select("scene_id", "row", "col", F.col("_node").alias("b")), ["scene_id", "row", "col"])
    edges = cut_lineage(met.select("scene_id", "a", "b").distinct())
    nodes = edges.select("scene_id", F.col("a").alias("node")).unionAll(edges.select("scene_id", F.col("b").alias("node"))).distinct()
    labels = label_runs(nodes, edges).select("scene_id", F.col("node").alias("_node"), "label")
    return (labelled.join(labels, ["scene_id", "_node"], "left").withColumn("component", F.coalesce("label", "_node"))
            .drop("_node", "_br", "_bc", "label"))
