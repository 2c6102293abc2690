"""Code length of texts under prediction by partial matching, beside a word-frequency score.

The model is a trie of byte contexts: real bytes, all orders up to ``ORDER``.  Tasks count
each place's byte under its longest context, Spark adds the counts up, and the shorter contexts
follow by dropping the oldest byte.  Escapes and exclusions are sums over a context's own
symbols (at most 256 rows), so every probability comes from joins and windows of the counts, and
the model grows with the corpus.  The commonest cells and words, as many as tables of fixed size hold,
are sent to the tasks that score; all others meet the documents in joins, where nothing is
hot any more.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bytescan import Hasher, segments, signed, text_bytes, words
from tidemark.sources.scratch import cut_lineage

ORDER, SYMBOLS = 5, 256
END = 255  # no byte of UTF-8 text: stands before a text's first byte and behind its last one
END_WORD = 0  # key of the end token among word hashes
HELD = 8 << 20  # cells that a task adds up before they travel

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cells_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cell of each byte of each text and of its end, in order: the ``ORDER`` bytes before it and the byte, the oldest highest."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    line = np.full(len(data) + (ORDER + 1) * n, END, np.uint8)
    line[np.arange(len(data)) + (ORDER + 1) * row + ORDER] = data
    cell = np.zeros(max(0, len(line) - ORDER), np.int64)
    for k in range(ORDER + 1):
        cell = (cell << 8) | line[k:len(line) - ORDER + k]
    # Each text has its bytes and its end; what follows crosses into the next text.
    keep = np.ones(len(line), bool)
    begin = offsets[:-1] + (ORDER + 1) * np.arange(n)
    for k in range(ORDER):
        keep[begin + k] = False
    return cell[keep[ORDER:]]


def order_counts(cells: DataFrame) -> list[DataFrame]:
    """(cell, n) of each order from 0 up: the rows of the longest contexts, and what follows by dropping the oldest byte."""
    out = [cells]
    for k in range(ORDER - 1, -1, -1):
        shorter = F.col("cell").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1).cast("long"))
        out.append(cut_lineage(out[-1].groupBy(shorter.alias("cell")).agg(F.sum("n").alias("n"))))
    return out[::-1]


def probabilities(cells: DataFrame) -> DataFrame:
    """(cell, n, p) for rows (cell, n), n the count in training text, 0 for cells that only others have.

    Escapes follow method C: a context with T symbols of D kinds gives T / (T + D) to what it
    has seen.  After an escape, symbols that the longer context has seen are excluded from
    the shorter one.  An unseen context is passed over.  Symbols never seen share what the
    empty context leaves.  Two columns go up the orders: ``p``, and ``left``, the probability of a symbol
    that the context has not seen, once it has escaped.
    """
    levels = order_counts(cells)
    kinds, total = F.count_if(F.col("n") > 0), F.sum("n")
    facts = levels[0].agg(F.coalesce(total, F.lit(0)).alias("t"), kinds.alias("d")).first()
    rest, n = 1.0 / max(1, SYMBOLS - facts["d"]), F.col("n")
    if facts["t"] == 0:
        low = levels[0].select("cell", "n", F.lit(1.0 / SYMBOLS).alias("p"), F.lit(1.0 / SYMBOLS).alias("left"))
    else:
        mass = float(facts["t"] + (facts["d"] if facts["d"] < SYMBOLS else 0))
        low = levels[0].select("cell", "n", F.when(n > 0, n / mass).otherwise(F.lit(facts["d"] / mass * rest)).alias("p"), F.lit(rest).alias("left"))
    # Sums of the shorter context itself are needed with its cells.
    def summed(level: DataFrame, *more: Column) -> DataFrame:
        own = Window.partitionBy(F.shiftright("cell", 8))
        return level.withColumns({"t": F.sum("n").over(own), "d": kinds.over(own), **{f"_{i}": c.over(own) for i, c in enumerate(more)}})
    low = summed(low)
    for k in range(1, ORDER + 1):
        parent = F.col("cell").bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long"))
        below = low.select(F.col("cell").alias("_parent"), F.col("n").alias("low_n"), F.col("p").alias("low_p"), F.col("left").alias("low_left"),
                           F.col("t").alias("low_t"), F.col("d").alias("low_d"))
        met = levels[k].withColumn("_parent", parent).join(below, "_parent").drop("_parent")
        # What the shorter context has counted of this one's symbols is excluded there.
        level = summed(met, F.sum(F.when(n > 0, F.col("low_n")).otherwise(0)))
        others, fresh = F.col("low_t") - F.col("_0"), F.col("low_d") - F.col("d")
        weight = others + F.when(F.col("low_d") < SYMBOLS, fresh).otherwise(0)
        left = (F.when(others + fresh == 0, F.col("low_left")).when(F.col("low_n") > 0, F.col("low_n") / weight)
                .otherwise(fresh / weight * F.col("low_left")))
        seen = F.col("t") + F.when(F.col("d") < SYMBOLS, F.col("d")).otherwise(0)
        p = F.when(F.col("t") == 0, F.col("low_p")).when(n > 0, n / seen).otherwise(F.col("d") / seen * F.col("left"))
        low = level.withColumn("left", left).withColumn("p", p).select("cell", "n", "p", "left", "t", "d")
        low = cut_lineage(low)
    return low.select("cell", "n", "p")


def held_out(key: str | int | None, modulus: int, remainder: int) -> bool:
    return zlib.crc32(str("" if key is None else key).encode()) % modulus == remainder


def _learned(modulus: int, remainder: int):
    """Rows (kind, key, n): 0 word counts of a segment's training texts, 1 cells, n counted in training texts alone."""
    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

    def cells(waiting: list[np.ndarray]) -> pa.RecordBatch:
        # The lowest bit tells training text; both kinds of a cell are neighbours in order.
        marked, n = np.unique(np.concatenate(waiting), return_counts=True)
        n[marked & 1 == 0] = 0
        key = marked >> 1
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return rows(1, key[first], np.add.reduceat(n, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            learn = np.array([not held_out(k, modulus, remainder) for k in batch.column(0).to_pylist()], bool)
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in segments(offsets):
                part, at = _LOWER[data[offsets[lo]:offsets[hi]]], offsets[lo:hi + 1] - offsets[lo]
                waiting.append(cells_of(part, at) << 1 | np.repeat(learn[lo:hi], np.diff(at) + 1))
                held += len(waiting[-1])
                if held >= HELD:
                    yield cells(waiting)
                    waiting, held = [], 0
                row, start, end = words(part, at)
                mine = learn[lo:hi][row]
                keys, n = np.unique(Hasher(part, 7).slices(start[mine], end[mine]), return_counts=True)
                yield rows(0, signed(keys), n)
                yield rows(0, np.array([END_WORD]), np.array([learn[lo:hi].sum()]))
        if waiting:
            yield cells(waiting)
    return run


def _rest(row: np.ndarray, key: np.ndarray, n: int) -> pa.ListArray:
    """Lists (key, times) of each of n texts."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    head = np.ones(len(row), bool)
    head[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(head)
    times = np.diff(np.append(first, len(row)))
    sizes = np.bincount(row[first], minlength=n)
    pairs = pa.StructArray.from_arrays([pa.array(key[first].astype(np.int64)), pa.array(times.astype(np.int64))], ["key", "times"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pairs)


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of what is asked among sorted keys."""
    place = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
    return place, keys[place] == asked if len(keys) else np.zeros(len(asked), bool)


def _scored(table, hot, modulus: int, remainder: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, costs = table.value
        keys, counts = hot.value
        weight = np.log10(counts + 1.0)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in segments(offsets):
                part, at = _LOWER[data[offsets[lo]:offsets[hi]]], offsets[lo:hi + 1] - offsets[lo]
                n = hi - lo
                own, back = np.unique(cells_of(part, at), return_inverse=True)
                text = np.repeat(np.arange(n), np.diff(at) + 1)
                place, there = _found(cells, own)
                cost = np.where(there, costs[place], 0.0) if len(cells) else np.zeros(len(own))
                score = np.bincount(text, cost[back], minlength=n)
                lacking = ~there[back]
                rare = _rest(text[lacking], own[back[lacking]], n)
                row, start, end = words(part, at)
                code = signed(Hasher(part, 7).slices(start, end))
                place, there = _found(keys, code)
                base = np.bincount(row[there], weight[place[there]], minlength=n)
                known = np.bincount(row[there], minlength=n)
                own = batch.column(0).slice(lo, n)
                out = [own, pa.array([uuid.uuid4().bytes for _ in range(n)], pa.binary()),
                       pa.array([held_out(k, modulus, remainder) for k in own.to_pylist()], pa.bool_()),
                       pa.array((np.bincount(row, minlength=n) + 1).astype(np.int64)), pa.array(known.astype(np.int64)),
                       pa.array(base.astype(np.float64)), pa.array(score), _rest(row[~there], code[~there], n), rare]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "uid", "held_out", "n_tokens", "known", "base", "score", "rest", "cells"])
    return run


def _commonest(rows: DataFrame, room: int) -> tuple[DataFrame, DataFrame]:
    """(rows that ``room`` holds, the others): whole steps of the logarithm of n, the largest first."""
    step = F.floor(F.log2(F.col("n") + 1) * 8).cast("int")
    least = None
    for r in sorted(rows.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["step"]):
        if r["k"] > room:
            break
        room, least = room - r["k"], r["step"]
    return (rows.filter(F.lit(False)), rows) if least is None else (rows.filter(step >= least), rows.filter(step < least))


def log_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, remainder: int = 2,
               table_words: int = 1 << 20, table_cells: int = 1 << 21) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    Documents whose crc32 of the key (as text; null: empty) leaves ``remainder`` are held
    out, the model learns from all others, whole texts, A-Z lowered.  ``score`` is log10 of
    the probability of the text's bytes and its end; ``base_score`` adds, over words and the
    end, log10((c + 1) / (N + V + 1)).  Null texts are empty; repeated rows are learned and
    scored each; without training documents every symbol is equally likely.  Empty tables
    give an empty result; other columns are not read.  ``table_words`` and ``table_cells`` size the tables of
    common words and cells (16 bytes each) that are sent to tasks; they do not change results.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    counts = cut_lineage(slim.mapInArrow(_learned(modulus, remainder), "kind int, key bigint, n bigint")
                         .groupBy("kind", "key").agg(F.sum("n").alias("n")))
    seen = counts.filter("kind = 0 AND n > 0").select("key", "n")
    sums = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("kinds"),
                    F.coalesce(F.sum(F.when(F.col("key") == END_WORD, F.col("n"))), F.lit(0)).alias("ends")).first()
    total, kinds, ends = sums["n"], sums["kinds"], sums["ends"]
    cells = counts.filter("kind = 1").select(F.col("key").alias("cell"), "n")
    costs = cut_lineage(probabilities(cells).select(F.col("cell").alias("key"), "n", F.log10("p").alias("cost")))
    common_words, rare_words = _commonest(seen, table_words)
    common_cells, rare_cells = _commonest(costs, table_cells)
    hot = common_words.sort("key").toArrow()
    table = common_cells.select("key", "cost").sort("key").toArrow()
    sent = (spark.sparkContext.broadcast((table.column("key").to_numpy(), table.column("cost").to_numpy())),
            spark.sparkContext.broadcast((hot.column("key").to_numpy(), hot.column("n").to_numpy())))
    kind = docs.schema[key].dataType.simpleString()
    scored = cut_lineage(slim.mapInArrow(_scored(*sent, modulus, remainder), f"doc_id {kind}, uid binary, held_out boolean, n_tokens bigint, "
                         "known bigint, base double, score double, rest array<struct<key:bigint,times:bigint>>, cells array<struct<key:bigint,times:bigint>>"))
    zero = F.lit(0)
    told = scored.select("uid", F.inline("rest")).join(rare_words, "key").select(
        "uid", F.col("times").alias("more"), (F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("gain"), F.lit(0.0).alias("code"))
    coded = scored.select("uid", F.inline("cells")).join(rare_cells, "key").select(
        "uid", zero.cast("long").alias("more"), F.lit(0.0).alias("gain"), (F.col("times") * F.col("cost")).alias("code"))
    both = told.unionAll(coded).groupBy("uid").agg(F.sum("more").alias("more"), F.sum("gain").alias("gain"), F.sum("code").alias("code"))
    joined = scored.join(both, "uid", "left")
    # The end token is among the training tokens unless nothing was learned.
    base = (F.col("base") + F.coalesce("gain", F.lit(0.0)) + F.lit(float(np.log10(ends + 1.0)))
            - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1.0))))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", zero) + F.lit(int(ends > 0))).alias("n_known"),
                         F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("code", F.lit(0.0))).alias("score"))
