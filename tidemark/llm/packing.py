"""Token sequences packed shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bytescan import distinct_slices, segments, text_bytes
from tidemark.sources.scratch import cut_lineage

VOCABULARY = 1 << 20  # words a worker remembers at a time
GROUP = 2 << 20  # bytes of text tokenized together

# Byte classes: 0 white space, 1 ASCII letters, 2 ASCII punctuation but the apostrophe, 3 all else.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LEVEL = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PLAIN))}


class WordIds:
    """Token ids of texts, unit by unit: each different unit goes to the tokenizer once.

    White space parts units, and so does the step between ASCII letters and punctuation:
    the tokenizer's own pre-tokenizer parts there too and no merge crosses it, and it lowers
    the case, so a text's ids are its units' ids in order.  Units of Latin letters go to
    the tokenizer's model directly, others through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.known: dict[bytes, int] = {}
        self.pool = [np.zeros(0, np.uint32)]
        self.at = [np.zeros(1, np.int64)]

    def coded(self, unit: bytes) -> list[int]:
        text = unit.decode("utf-8")
        if text.isalpha() and (text.isascii() or max(text) <= "\xff"):
            word = text if text.isascii() else text.lower().encode().decode("latin-1").translate(_LEVEL)
            return [t.id for t in self.model.tokenize(word)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text)."""
        data = _LOWER[data]
        kind = _CLASS[data]
        turn = np.ones(len(data), bool)
        a, b = kind[:-1], kind[1:]
        turn[1:] = ((a == 0) != (b == 0)) | ((a ^ b) == 3) & (a != 0) & (b != 0)
        heads = offsets[1:-1]
        turn[heads[heads < len(data)]] = True
        bound = np.append(np.flatnonzero(turn), len(data))
        start, end = bound[:-1], bound[1:]
        word = kind[start] != 0
        start, end = start[word], end[word]
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        raw = data.tobytes()
        first, back = distinct_slices(data, start, end)
        if len(self.known) > VOCABULARY:
            self.known, self.pool, self.at = {}, self.pool[:1], self.at[:1]
        known, fresh, which = self.known, [], []
        n = len(known)
        for s, e in zip(start[first].tolist(), end[first].tolist()):
            unit = raw[s:e]
            i = known.get(unit)
            if i is None:
                i = known[unit] = n
                n += 1
                fresh.append(self.coded(unit))
            which.append(i)
        if fresh:
            sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
            self.pool.append(np.fromiter((x for c in fresh for x in c), np.uint32, int(sizes.sum())))
            self.at.append(self.at[-1][-1] + np.cumsum(sizes))
        if len(self.pool) > 1:
            self.pool, self.at = [np.concatenate(self.pool)], [np.concatenate(self.at)]
        pool, at = self.pool[0], self.at[0]
        w = np.array(which)[back]
        size = at[w + 1] - at[w]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = np.arange(total[-1]) + np.repeat(at[w] - total[:-1], size)
        return pool[flat], np.diff(total[np.searchsorted(start, offsets)])


def _cut(path: str, most: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordIds(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            for lo, hi in segments(offsets, GROUP):
                ids, sizes = coder.ids(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                rows, start, length, crc, total, kept = [], [], [], [], [], []
                begin = 0
                for i, n in enumerate(sizes.tolist()):
                    own = np.append(ids[begin:begin + n], np.uint32(end_id)).astype("<u4", copy=False)
                    begin += n
                    for a in range(0, n + 1, most):
                        piece = own[a:a + most]
                        rows.append(lo + i)
                        start.append(a)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece))
                        total.append(n + 1)
                        if with_ids:
                            kept.append(piece.tolist())
                front = [batch.column(k).take(pa.array(rows)) for k in range(batch.num_columns - 1)]
                cols = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                ids_col = pa.array(kept if with_ids else [None] * len(rows), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*front, *cols, ids_col], [*batch.schema.names[:-1], "start", "length", "ids_crc32", "doc_tokens", "ids"])
    return run


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", most: int = 2048, end_id: int = 1,
                 with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids): pieces of at most ``most`` tokens of each text and its end id."""
    slim = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return slim.mapInArrow(_cut(path, most, end_id, with_ids),
                           f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids array<bigint>")


def shortest_pack_first(histogram: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, count): lengths longest first, each onto the shortest packs it fits into.

    Packs of the same content are one pattern with a count, so the work depends on the
    number of different lengths (at most ``most``), not on the number of pieces.
    """
    by_size: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # The shortest packs first.  A pack that took a piece is longer and may take another in its turn.
        for size in range(most - length + 1):
            if not left:
                break
            waiting = by_size.pop(size, [])
            while waiting and left:
                pattern, n = waiting.pop()
                used = min(n, left)
                left -= used
                by_size.setdefault(size + length, []).append((pattern + (length,), used))
                if n > used:
                    waiting.append((pattern, n - used))
            if waiting:
                by_size[size] = waiting
        while left:
            # More pieces than open packs: new packs, each filled with as many as fit.
            fit = max(1, most // length)
            full, rest = divmod(left, fit)
            if full:
                by_size.setdefault(fit * length, []).append(((length,) * fit, full))
            left = 0
            if rest:
                by_size.setdefault(rest * length, []).append(((length,) * rest, 1))
    return [p for packs in by_size.values() for p in packs]


def packed(pieces: DataFrame, most: int = 2048, parts: int = 256) -> DataFrame:
    """``pieces`` (doc_id, start, length, ...) with sequence_id and offset.

    The histogram has at most ``most`` rows, so it is read back and planned at once.  A
    pattern asks for so many pieces of each of its lengths; pieces of one length are ranked
    by a distributed numbering (inside hash parts, plus what comes before each part) and
    taken in that order.  A length that most pieces share is cut into ``parts``.
    Repeated rows are separate pieces; an empty table gives an empty result.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, taken, first = [], dict.fromkeys(counts, 0), 0
    for pattern, n in shortest_pack_first(counts, most):
        offset = 0
        for length in pattern:
            slots.append((length, taken[length], taken[length] + n, first, offset))
            taken[length] += n
            offset += length
        first += n
    plan = pieces.sparkSession.createDataFrame(slots, "length long, _from long, _to long, _first long, offset long")
    order = F.xxhash64("doc_id", "start")
    cut = pieces.withColumn("_order", order).withColumn("_part", F.pmod(F.shiftrightunsigned(order, 24), F.lit(parts)))
    sizes = cut.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("length", "_part", before.alias("_before"))
    no = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_order", "doc_id", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("_no", no).join(offsets, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_no"))
    # The plan's size is bounded by the number of different lengths, not by the data.
    taken_by = (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = ranked.join(F.broadcast(plan), taken_by).drop(plan["length"])
    return placed.select(*pieces.columns, (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def packed_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", most: int = 2048, end_id: int = 1,
                     with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset) of all texts.

    Texts are tokenized whole and closed by ``end_id``; a null text is empty and has that
    id alone.  Each id lies in one piece, and pieces fill a sequence from 0 without gaps.
    The pieces are written once to the shared folder, as both the histogram and the ranks
    need them.  Other columns are not read, so their names cannot clash.
    """
    pieces = cut_lineage(token_pieces(docs, path, key, text, most, end_id, with_ids))
    return packed(pieces, most)
