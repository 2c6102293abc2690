"""Repeated substrings by a logarithmic family of suffix arrays.

The arrays are sparse: they hold the suffixes at anchors, which every window of ``length``
bytes picks by its own content (the least hash of the grams inside it), so equal windows
pick the same suffix.  An entry carries the fingerprint of the suffix's first bytes (the
gram) and of the whole stretch of windows that share the anchor.  An array is sorted by
these, bucketed by the first: suffixes with a long common beginning are neighbours.  A batch
of documents gets an array of its own; it is scanned together with the existing arrays for
equal beginnings, and two arrays of one size class become one of the next, so an entry is
rewritten a logarithmic number of times.  Where two stretches agree only in part, their
windows are compared one by one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bytescan import Hasher, mixed, segments, signed, sliding_min, text_bytes
from tidemark.sources.scratch import cut_lineage, new_path

ENTRY = "key bigint, fp int, doc bigint, n int"
STRETCH = 1 << 20  # window starts of one document that are worked on at a time


class Stretches:
    """Anchors of some texts: for each, the windows [first, last] that pick it, and two fingerprints."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.hasher = Hasher(data, seed=4)
        self.length = length
        grams = self.hasher.grams(gram)
        n = len(grams)
        z = np.zeros(0, np.int64)
        self.row = self.first = self.last = self.anchor = z
        self.key, self.fp = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        # Windows lie within one text.
        sizes = np.diff(offsets)
        room = np.maximum(sizes - length + 1, 0)
        if n == 0 or not room.any():
            return
        # The place in the low bits: the leftmost of equal hashes wins, by the window's content alone.
        bits = np.uint64(max(1, int(n).bit_length()))
        packed = ((grams >> bits) << bits) | np.arange(n, dtype=np.uint64)
        least = sliding_min(packed, length - gram + 1)
        rows = np.repeat(np.arange(len(room)), room)
        at = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + np.repeat(offsets[:-1], room)
        pick = (least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        head = np.ones(len(at), bool)
        head[1:] = (pick[1:] != pick[:-1]) | (rows[1:] != rows[:-1])
        begins = np.flatnonzero(head)
        ends = np.append(begins[1:], len(at)) - 1
        self.row, self.first, self.last, self.anchor = rows[begins], at[begins], at[ends], pick[begins]
        anchor = self.anchor
        self.key = grams[anchor]
        whole = self.hasher.slices(self.first, self.last + length) ^ mixed((anchor - self.first).astype(np.uint64))
        self.fp = (whole >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, index into ``which``) of every window of the chosen stretches."""
        count = self.last[which] - self.first[which] + 1
        owner = np.repeat(np.arange(len(which)), count)
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.first[which][owner]
        return start, owner


def _pieces(texts: list[bytes] | pa.Array, length: int):
    """(row numbers, bytes, offsets, start of each piece in its text); long texts in pieces that share length - 1 bytes."""
    data, offsets = text_bytes(pa.array(texts, pa.large_binary()) if isinstance(texts, list) else texts)
    for lo, hi in segments(offsets):
        if hi - lo == 1 and offsets[hi] - offsets[lo] > STRETCH + length:
            n = int(offsets[hi] - offsets[lo])
            for a in range(0, n - length + 1, STRETCH):
                b = min(n, a + STRETCH + length - 1)
                yield np.array([lo]), data[offsets[lo] + a:offsets[lo] + b], np.array([0, b - a]), a
        else:
            yield np.arange(lo, hi), data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], 0


def _entries(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, data, offsets, _ in _pieces(batch.column(1), length):
                s = Stretches(data, offsets, length, gram)
                if not len(s.key):
                    continue
                # Repeats within a text become one entry that counts twice.
                order = np.lexsort((s.fp, s.key, s.row))
                row, key, fp = s.row[order], s.key[order], s.fp[order]
                head = np.ones(len(row), bool)
                head[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
                at = np.flatnonzero(head)
                n = np.minimum(np.diff(np.append(at, len(row))), 2).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key[at])), pa.array(fp[at]), pa.array(docs[rows][row[at]].astype(np.int64)), pa.array(n)],
                                                 ["key", "fp", "doc", "n"])
    return run


class SuffixArrayFamily:
    """Levels of sorted suffix entries in the shared folder; ``close`` removes them.

    Levels are bucketed by ``key`` into as many buckets as the session has shuffle
    partitions when the family is made, so scans and merges need no shuffle.
    """

    def __init__(self, spark: SparkSession, length: int = 200, gram: int = 100):
        if not 8 <= gram < length:
            raise ValueError("gram must lie between 8 and length")
        self.spark, self.length, self.gram = spark, length, gram
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, str] = {}
        self.hits: list[DataFrame] = []
        self.paths: dict[str, str] = {}

    def _store(self, entries: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, name)
        (entries.write.format("parquet").option("path", self.paths[name]).option("compression", "zstd")
         .bucketBy(self.buckets, "key").sortBy("key", "fp").saveAsTable(name))
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def add(self, docs: DataFrame) -> None:
        """Index (doc, text): build the batch's array, scan it with the levels, merge equal levels."""
        entries = docs.select("doc", "text").mapInArrow(_entries(self.length, self.gram), ENTRY)
        new = self._store(entries.repartition(self.buckets, "key"))
        # Neighbours with a common beginning in the new array or between it and a level.
        here = self._keys(new, F.sum("n"))
        scanned = here
        for name in self.levels.values():
            scanned = scanned.join(self._keys(name, F.max(F.lit(1))).withColumnRenamed("c", f"c{name}"), "key", "left").withColumn(
                "c", F.col("c") + F.coalesce(F.col(f"c{name}"), F.lit(0))).drop(f"c{name}")
        self.hits.append(cut_lineage(scanned.filter("c > 1").select("key")))
        rank = 0
        while rank in self.levels:
            old = self.levels.pop(rank)
            both = self.spark.table(old).unionAll(self.spark.table(new))
            merged = self._store(both if self._aligned(both) else both.repartition(self.buckets, "key"))
            self._drop(old)
            self._drop(new)
            new, rank = merged, rank + 1
        self.levels[rank] = new

    def _keys(self, name: str, count) -> DataFrame:
        return self.spark.table(name).groupBy("key").agg(count.cast("long").alias("c"))

    def _aligned(self, df: DataFrame) -> bool:
        """Whether the union of two levels keeps their buckets together (Spark 4.1 and later do)."""
        plan = df.groupBy("key").count()._jdf.queryExecution().executedPlan().toString()
        return "Exchange" not in plan

    def entries(self) -> DataFrame:
        out = None
        for name in self.levels.values():
            out = self.spark.table(name) if out is None else out.unionAll(self.spark.table(name))
        return out if out is not None else self.spark.createDataFrame([], ENTRY)

    def matched(self) -> DataFrame:
        """(doc, found): the entries of each document whose beginning occurs more than once.

        ``found`` holds (key, fp, kind): 1, the whole stretch occurs elsewhere; 2, only its
        beginning does, so its windows must be compared; 3, the whole stretch does, and its
        windows are compared with others' on behalf of all its copies.
        """
        keys = self.hits[0]
        for more in self.hits[1:]:
            keys = keys.unionAll(more)
        hit = self.entries().join(keys.distinct(), "key", "left_semi")
        # One row for each different stretch, however many documents have it.
        alike = hit.groupBy("key", "fp").agg(F.sum("n").alias("times"), F.min("doc").alias("speaker"))
        kinds = alike.groupBy("key").agg(F.count("*").alias("forms"))
        told = alike.join(kinds, "key").filter("times > 1 OR forms > 1")
        kind = F.when(F.col("times") == 1, 2).when((F.col("forms") > 1) & (F.col("doc") == F.col("speaker")), 3).otherwise(1)
        rows = hit.select("key", "fp", "doc").join(told, ["key", "fp"]).select("doc", F.struct("key", "fp", kind.cast("byte").alias("kind")).alias("x"))
        return rows.groupBy("doc").agg(F.collect_set("x").alias("found"))

    def close(self) -> None:
        for name in list(self.paths):
            self._drop(name)
        self.levels = {}


OUT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
PENDING = (f"uid bigint, done boolean, {OUT}, kept string, packed binary, marks binary, "
           "blocks array<struct<core:bigint,fp:int,at:bigint,hashes:array<int>,open:boolean>>")
BLOCK = 25  # windows of a stretch that are compared together at first


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the bytes in any of the ranges [start, end)."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:n]) > 0


def _result(text: bytes, gone: np.ndarray, with_text: bool):
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if runs else text
    return len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the way to their entries."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        raw = memoryview(data)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([squeeze.compress(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())],
                                         ["row", "doc", "packed"])


def _codes(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    return mixed(key ^ (fp.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _blocks(s: Stretches, ask: np.ndarray, speaks_only: np.ndarray, shift: int):
    """Windows of the stretches ``ask`` in blocks of equal offset from the anchor.

    (core, fp, at, sizes, hashes, open): all windows of a block contain its core, so a core
    that occurs once decides the block, and so does a block that occurs whole elsewhere.
    """
    start, owner = s.windows(ask)
    anchor = s.anchor[ask][owner]
    block = (anchor - start) // BLOCK
    head = np.ones(len(start), bool)
    head[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(start)) - 1
    begin = anchor[first] - BLOCK * block[first]
    core = s.hasher.slices(begin, begin + s.length - BLOCK + 1)
    whole = s.hasher.slices(start[first], start[last] + s.length) ^ mixed((anchor[first] - start[first]).astype(np.uint64))
    h = (s.hasher.slices(start, start + s.length) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return signed(core), (whole >> np.uint64(32)).astype(np.uint32).view(np.int32), start[first] + shift, last - first + 1, h, ~speaks_only[owner[first]]


def _marked(length: int, gram: int, with_text: bool):
    """First pass: what whole stretches decide; blocks of windows of the others go out for comparison."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, expand = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            found = batch.column(2)
            texts = [expand.decompress(x.as_py()) for x in batch.column(1)]
            flat, lists = found.values, found.offsets.to_numpy()
            codes = _codes(flat.field("key").to_numpy(zero_copy_only=False).view(np.uint64), flat.field("fp").to_numpy(zero_copy_only=False))
            kinds = flat.field("kind").to_numpy(zero_copy_only=False)
            has = found.is_valid().to_numpy(zero_copy_only=False)
            ranges: dict[int, list] = {}
            asked: dict[int, list] = {}
            for rows, part, at, base in _pieces(texts, length):
                if not has[rows].any():
                    continue
                s = Stretches(part, at, length, gram)
                mine = _codes(s.key, s.fp)
                bounds = np.searchsorted(s.row, np.arange(len(rows) + 1))
                for i, r in enumerate(rows.tolist()):
                    a, b = bounds[i], bounds[i + 1]
                    lo, hi = lists[r], lists[r + 1]
                    if not has[r] or a == b or lo == hi:
                        continue
                    order = np.argsort(codes[lo:hi])
                    place = order[np.minimum(np.searchsorted(codes[lo:hi][order], mine[a:b]), hi - lo - 1)]
                    kind = np.where(codes[lo:hi][place] == mine[a:b], kinds[lo:hi][place], 0)
                    shift = base - int(at[i])
                    sure = np.flatnonzero(kind & 1) + a
                    ranges.setdefault(r, []).append((s.first[sure] + shift, s.last[sure] + shift + length))
                    ask = np.flatnonzero(kind & 2) + a
                    if len(ask):
                        asked.setdefault(r, []).append(_blocks(s, ask, kind[ask - a] == 3, shift))
            out, counts, every = [], [], []
            for r, text in enumerate(texts):
                n = len(text)
                own = ranges.get(r)
                gone = _covered(n, *[np.concatenate([x[k] for x in own]) for k in range(2)]) if own else np.zeros(n, bool)
                blocks = asked.get(r, [])
                every += blocks
                counts.append(sum(len(x[0]) for x in blocks))
                if any(x[5].any() for x in blocks):
                    out.append((False, n, 0, 0, None, None, batch.column(1)[r].as_py(), squeeze.compress(np.packbits(gone).tobytes())))
                else:
                    out.append((True, *_result(text, gone, with_text), None, None))
            cat = [np.concatenate([x[k] for x in every] or [np.zeros(0, t)]) for k, t in enumerate((np.int64, np.int32, np.int64, np.int64, np.int32, bool))]
            hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cat[3])]).astype(np.int32)), pa.array(cat[4]))
            values = pa.StructArray.from_arrays([pa.array(cat[0]), pa.array(cat[1]), pa.array(cat[2]), hashes, pa.array(cat[5])], ["core", "fp", "at", "hashes", "open"])
            lists_out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
            types = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate(types)]
            uid = pa.array(np.arange(number, number + len(out)))
            number += len(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), uid, *cols, lists_out],
                                             ["row", "uid", "done", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "packed", "marks", "blocks"])
    return run


def _settled(length: int, with_text: bool):
    """Second pass, for texts with windows that were compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, marks, answers in zip(batch.column(1), batch.column(2), batch.column(3)):
                text = expand.decompress(packed.as_py())
                gone = np.unpackbits(np.frombuffer(expand.decompress(marks.as_py()), np.uint8), count=len(text)).astype(bool)
                if answers.is_valid:
                    starts = answers.values.field("at").to_numpy(zero_copy_only=False)
                    gone |= _covered(len(text), starts, starts + answers.values.field("n").to_numpy(zero_copy_only=False) - 1 + length)
                out.append(_result(text, gone, with_text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]],
                                             ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def _answers(first: DataFrame) -> DataFrame:
    """(uid, at): runs of windows that occur elsewhere, among the blocks that asked.

    Blocks are judged by counts of their cores and of themselves; only a block whose core
    occurs again but which does not itself is taken apart.  Counts are combined on the map
    side and joined back, so a frequent core needs no task that holds all its rows.
    """
    slim = first.select("uid", F.inline("blocks"))
    small = slim.select("uid", "at", "core", "fp", "open", F.size("hashes").alias("n"))
    alike = small.groupBy("core", "fp").agg(F.count("*").alias("times"), F.min(F.struct("uid", "at")).alias("speaker"))
    total = alike.groupBy("core").agg(F.sum("times").alias("total"), F.count("*").alias("forms"))
    told = alike.join(total, "core").filter("total > 1").drop("total")
    state = cut_lineage(small.join(told, ["core", "fp"]).withColumn("speaks", (F.col("times") == 1) | (F.col("speaker") == F.struct("uid", "at"))).drop("fp", "speaker"))
    whole = state.filter("open AND times > 1").select("uid", "at", "n")
    parted = state.filter("forms > 1 AND speaks").select("uid", "at", "core", (F.col("open") & (F.col("times") == 1)).alias("asks"))
    windows = cut_lineage(parted.join(slim.select("uid", "at", "hashes"), ["uid", "at"])
                          .select("uid", "core", "asks", "at", F.posexplode("hashes").alias("k", "h"))
                          .select("uid", "core", "h", (F.col("at") + F.col("k")).alias("at"), "asks"))
    twice = windows.groupBy("core", "h").agg(F.count("*").alias("c")).filter("c > 1").select("core", "h")
    single = windows.filter("asks").join(twice, ["core", "h"], "left_semi").select("uid", "at", F.lit(1).alias("n"))
    return whole.unionAll(single).groupBy("uid").agg(F.collect_list(F.struct("at", "n")).alias("answers"))


def repeated_removed(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, gram: int = 100,
                     batches: int = 4, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of ``docs``.

    Every byte that a string of ``length`` bytes covers is removed if that string also starts
    anywhere else, in the same text (overlapping or not) or another; matches stay within a
    text and are judged on the input.  Bytes are UTF-8; a null text is empty.  ``row`` is the
    struct of the ``carry`` columns (by default the key), so extra columns cannot clash;
    repeated rows count as different documents.  A null key is like any other, and so is one that is no number.  ``kept`` has
    the remaining text if ``with_text``, without the code points that a cut has split.  An
    empty table gives an empty result.  Strings are told apart by 96 bits of hash.
    """
    if length - gram < BLOCK:
        raise ValueError(f"length must exceed gram by {BLOCK} at least")
    spark = docs.sparkSession
    # Entries come back to a row by its key and text, so that texts of one key, or of none, share no list;
    # rows equal in both share theirs, which has each entry once.
    whole = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.struct(*(carry or [key])).alias("row"), F.xxhash64(F.col(key), whole).alias("doc"), whole.alias("text"))
    family = SuffixArrayFamily(spark, length, gram)
    for i in range(batches):
        family.add(slim.filter(F.pmod(F.xxhash64("doc"), F.lit(batches)) == i))
    found = cut_lineage(family.matched())
    family.close()
    row = slim.schema["row"].dataType.simpleString()
    packed = slim.mapInArrow(_packed, f"row {row}, doc bigint, packed binary")
    joined = packed.join(found, "doc", "left").select("row", "packed", "found")
    first = cut_lineage(joined.mapInArrow(_marked(length, gram, with_text), f"row {row}, {PENDING}"))
    waiting = first.filter("NOT done").select("uid", "row", "packed", "marks").join(_answers(first), "uid", "left").select("row", "packed", "marks", "answers")
    late = waiting.mapInArrow(_settled(length, with_text), f"row {row}, {OUT}, kept string")
    names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    return first.filter("done").select(*names).unionAll(late.select(*names))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings: int) -> DataFrame:
    """``docs`` with the repeated passages cut out of the texts; all rows and columns stay.

    A code point that a cut has split is dropped; a null text that loses nothing stays null.
    """
    others = [c for c in docs.columns if c != text]
    marked = docs.select(F.struct(F.struct(*others).alias("own"), F.col(text).isNull().alias("absent")).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    done = repeated_removed(marked, "key", "text", with_text=True, carry=["row"], **settings)
    kept = F.when(~F.col("row.row.absent"), F.col("kept"))
    return done.select(*[kept.alias(c) if c == text else F.col("row.row.own").getField(c).alias(c) for c in docs.columns])
