"""Collocations by sorting suffix pointers: equal partitions of a multikey three-way quicksort are phrase counts.

Words are counted first.  A suffix pointer is a word's place, read as that word and the
next ones of its piece; a pointer whose first two words are not both frequent can be the
beginning of no frequent phrase and goes.  The others are routed by their two leading words,
so that a block has all suffixes of a beginning, and sorted there word by word: the size of a
partition of equal words is the count of that phrase, and partitions below the least count are
abandoned unsorted.  Which words are frequent is sent to tasks as a table of bits of fixed
size: it may keep too much, never too little.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bytescan import distinct_slices, mixed, segments, text_bytes, words
from tidemark.sources.scratch import cut_lineage

SEGMENT = 2 << 20  # bytes of text whose equal suffixes are added up before they travel
PAGE = 1 << 15  # bits in a row of Spark's bitmaps

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# 0 inside words, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2


class Places:
    """Word places of some texts: ``own`` numbers the different (language, word), ``piece`` the pieces."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: pa.Array):
        low = _LOWER[data]
        kind = _KIND[low]
        row, start, end = words(np.where(kind == 0, low, np.uint8(32)), offsets)
        self.piece = np.cumsum(kind == 2)[start] + row if len(start) else start
        first, word = distinct_slices(low, start, end)
        coded = langs.dictionary_encode()
        tongue = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        pairs, self.own = np.unique(tongue * max(1, len(first)) + word, return_inverse=True)
        self.tongue, at = pairs // max(1, len(first)), first[pairs % max(1, len(first))]
        raw = low.tobytes()
        self.tongues = coded.dictionary
        self.names = [raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist())]

    def lang(self, which: np.ndarray) -> pa.Array:
        return self.tongues.take(pa.array(self.tongue[which]))

    def codes(self) -> np.ndarray:
        """Checksum of each (language, word), as Spark's crc32 gives it."""
        heads = [crc32(x.encode()) for x in self.tongues.to_pylist()]
        return np.fromiter((crc32(w, heads[t]) for w, t in zip(self.names, self.tongue.tolist())), np.int64, len(self.names))


def marked(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether the table has each code's bit."""
    slot = codes & (len(table) * 8 - 1)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[Places]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for lo, hi in segments(offsets, SEGMENT):
            yield Places(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], batch.column(0).slice(lo, hi - lo))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in _places(batches):
        n = np.bincount(p.own, minlength=len(p.names))
        yield pa.RecordBatch.from_arrays([p.lang(np.arange(len(n))), pa.array(p.names, pa.binary()).cast(pa.string()), pa.array(n)], ["lang", "word", "n"])


def suffix_codes(p: Places, usable: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the words of each suffix of two to ``most`` usable words, -1 after its end."""
    n = len(p.own)
    codes = np.full((n, most), -1, np.int64)
    codes[:, 0] = np.where(usable[p.own], p.own, -1) if n else p.own
    for k in range(1, most):
        m = max(0, n - k)
        goes_on = (codes[:m, k - 1] >= 0) & usable[p.own[k:]] & (p.piece[k:] == p.piece[:m])
        codes[:m, k] = np.where(goes_on, p.own[k:], -1)
    return codes[codes[:, 1] >= 0]


def lines_of(names: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a line for each row of word numbers, words joined by blanks."""
    pool = np.frombuffer(b"".join(n + b" " for n in names), np.uint8)
    size = np.fromiter(map(len, names), np.int64, len(names)) + 1
    at = np.cumsum(size) - size
    which = codes[codes >= 0]
    n = size[which]
    ends = np.cumsum(n)
    flat = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[which] - (ends - n), n)]
    last = np.cumsum((codes >= 0).sum(1)) - 1
    offsets = np.append(0, ends[last])
    flat[offsets[1:] - 1] = 10
    return flat, offsets


def packed_rows(names: list[bytes], own: np.ndarray, hot: np.ndarray, codes: np.ndarray, n: np.ndarray, tag: np.ndarray, tongues: pa.Array,
                step: int, fan: int) -> pa.RecordBatch:
    """Suffixes (numbers of ``names``, in order, with their counts) as compressed texts of lines, one for each bundle, language and kind.

    ``own`` and ``hot`` tell each name's checksum and whether it is common in its language; ``tag`` is bundle x number of
    languages + language.  A bundle is cut into ``fan`` by the hash of the two leading words; two common ones count
    with the third.  ``step`` is how many ways earlier cuts have parted the hashes.
    """
    spread = mixed(own.astype(np.uint64))
    split = hot[codes[:, 0]] & hot[codes[:, 1]]
    lead = mixed(spread[codes[:, 0]] + spread[codes[:, 1]] * np.uint64(3))
    third = np.where(codes[:, 2] >= 0, spread[codes[:, 2]], np.uint64(0)) if codes.shape[1] > 2 else lead
    route = np.where(split, mixed(lead + third), lead) // np.uint64(step) % np.uint64(fan)
    langs = max(1, len(tongues))
    tag = ((tag // langs * fan + route.astype(np.int64)) * langs + tag % langs) * 2 + split
    order = np.lexsort([*codes.T[::-1], tag])
    codes, tag, n = codes[order], tag[order], n[order]
    head = np.append(True, (codes[1:] != codes[:-1]).any(1) | (tag[1:] != tag[:-1]))[:len(codes)]
    at = np.flatnonzero(head)
    n = np.add.reduceat(n, at).astype("<u4") if len(at) else n.astype("<u4")
    codes, tag = codes[at], tag[at]
    flat, offsets = lines_of(names, codes)
    begin = np.flatnonzero(np.append(True, tag[1:] != tag[:-1]))[:len(tag)]
    pack = zstandard.ZstdCompressor(level=1).compress
    rows = [(pack(flat[offsets[a]:offsets[b]].tobytes()), pack(n[a:b].tobytes())) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(tag)])]
    tags = tag[begin]
    return pa.RecordBatch.from_arrays(
        [pa.array(tags // (2 * langs)), tongues.take(pa.array(tags // 2 % langs)), pa.array((tags & 1).astype(bool)),
         pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["block", "lang", "split", "lines", "counts"])


def _suffixes(frequent, busy, most: int, fan: int):
    """Suffixes of each segment, in ``fan`` bundles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _places(batches):
            if not p.names:
                continue
            own = p.codes()
            codes = suffix_codes(p, marked(own, frequent.value), most)
            yield packed_rows(p.names, own, marked(own, busy.value), codes, np.ones(len(codes), np.int64), p.tongue[codes[:, 0]], p.tongues, 1, fan)
    return run


class Lines:
    """The suffixes of some packed rows: ``codes`` numbers their words, ``names`` has these, ``of`` is each suffix's row."""

    def __init__(self, lines: list[bytes], counts: list[bytes], most: int):
        unpack = zstandard.ZstdDecompressor().decompress
        weight = [np.frombuffer(unpack(x), "<u4").astype(np.int64) for x in counts]
        self.of = np.repeat(np.arange(len(weight)), [len(w) for w in weight])
        self.weight = np.concatenate([np.zeros(0, np.int64), *weight])
        raw = b"".join(map(unpack, lines))
        data = np.frombuffer(raw, np.uint8)
        _, start, end = words(data, np.array([0, len(data)]))
        line = np.cumsum(data == 10)[start]
        first, word = distinct_slices(data, start, end)
        self.codes = np.full((len(self.weight), most), -1, np.int64)
        self.codes[line, np.arange(len(line)) - np.searchsorted(line, line)] = word
        self.names = [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())]


def _cut_again(busy, most: int, step: int, fan: int):
    """Bundles cut further; a task goes on with rows until they are about a segment."""
    def cut(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        # Words are numbered by language again, as their checksums are.
        for lang in {r[1] for r in rows}:
            mine = [r for r in rows if r[1] == lang]
            x = Lines([r[3] for r in mine], [r[4] for r in mine], most)
            begin = crc32(lang.encode())
            own = np.fromiter((crc32(w, begin) for w in x.names), np.int64, len(x.names))
            block = np.array([r[0] for r in mine], np.int64)[x.of]
            yield packed_rows(x.names, own, marked(own, busy.value), x.codes, x.weight, block, pa.array([lang]), step, fan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[3])
                if size >= SEGMENT:
                    yield from cut(held)
                    held, size = [], 0
        yield from cut(held)
    return run


def equal_runs(keys: list[np.ndarray], weight: np.ndarray, least: int, spared: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, a pointer, total weight) of the partitions of equal keys down to each depth.

    Multikey three-way quicksort, all partitions of a round at once: each takes one of its
    pointers as pivot and parts into less, equal and greater.  Equal parts are done at this depth and go on with
    the next key; parts whose weight is below ``least`` are abandoned.  Pointers with a
    negative key end there.  Partitions of ``spared`` pointers are kept at the first depth
    whatever their weight.
    """
    at = np.random.default_rng(3).permutation(len(weight))  # so that a last pointer is a random one
    part = np.zeros(len(at), np.int64)
    for depth, key in enumerate(keys):
        there = key[at] >= 0
        at, part = at[there], part[there]
        done_at, done_part, done = [], [], 0
        while len(at):
            k = key[at]
            pivot = np.empty(int(part.max()) + 1, np.int64)
            pivot[part] = k
            p = pivot[part]
            into = 3 * part + 1 + (k > p) - (k < p)
            total = np.bincount(into, weight[at], 3 * len(pivot))
            keep = total >= least
            if depth == 0:
                keep[into[spared[at]]] = True
            equal = np.zeros(len(keep), bool)
            equal[1::3] = keep[1::3]
            number = np.cumsum(equal) - 1
            ready = equal[into]
            if ready.any():
                one = np.empty(int(equal.sum()), np.int64)
                one[number[into[ready]]] = at[ready]
                yield depth, one, total[equal].astype(np.int64)
                done_at.append(at[ready])
                done_part.append(number[into[ready]] + done)
                done += len(one)
            open_ = keep & ~equal
            open_[1::3] = False
            on = open_[into]
            at, part = at[on], (np.cumsum(open_) - 1)[into[on]]
        at = np.concatenate([np.zeros(0, np.int64), *done_at])
        part = np.concatenate([np.zeros(0, np.int64), *done_part])


def _block_counts(most: int, least: int):
    def run(block: pa.Table) -> pa.Table:
        x = Lines(block.column("lines").to_pylist(), block.column("counts").to_pylist(), most)
        langs = block.column("lang").combine_chunks().dictionary_encode()
        tag = (langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + block.column("split").to_numpy())[x.of]
        lead = (tag * len(x.names) + x.codes[:, 0]) * len(x.names) + x.codes[:, 1]
        names = [w.decode() for w in x.names]
        out = []
        for depth, at, n in equal_runs([lead, *x.codes[:, 2:].T], x.weight, least, (tag & 1).astype(bool)):
            phrases = [" ".join([names[i] for i in c]) for c in x.codes[at, :depth + 2].tolist()]
            out.append(pa.table([langs.dictionary.take(pa.array(tag[at] >> 1)), pa.array(phrases, pa.string()), pa.array(n)], ["lang", "phrase", "n"]))
        empty = pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())], ["lang", "phrase", "n"])
        return pa.concat_tables(out) if out else empty
    return run


def bit_table(words_: DataFrame, bits: int) -> np.ndarray:
    """Bits of the (lang, word) in a table of 2**bits, read back whatever the number of words."""
    slot = F.crc32(F.concat("lang", "word").cast("binary")).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    pages = (words_.select((slot + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("page"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect())
    table = np.zeros(max(1 << bits, PAGE) // 8, np.uint8)
    for row in pages:
        table[(row["page"] - 1) * PAGE // 8:row["page"] * PAGE // 8] = np.frombuffer(row["bits"], np.uint8)
    return table[:(1 << bits) // 8]


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = 3, least: int = 10, block: int = 1 << 18,
                  bits: int = 25, fan: tuple[int, int] = (1024, 64)) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): rows (lang, word, n), and (lang, phrase, n) of 2 to ``most`` words with n >= ``least``.

    A block has the suffixes of about ``block`` occurrences at most.  Segments send a fixed number of bundles,
    ``fan[0]``; where the texts are too many for so few blocks, bundles are cut into ``fan[1]`` again, as often as it
    takes, so that what travels grows with the texts and no faster.  Two leading words that both occur more
    often than ``block`` share their suffixes among blocks by the third word; what these blocks
    count of the two is added up.  Any other beginning has at most ``block``
    occurrences, so no block holds much more, whatever is common in the texts.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    vocabulary = cut_lineage(slim.mapInArrow(_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    common = vocabulary.filter(F.col("n") >= least)
    frequent, busy = (spark.sparkContext.broadcast(bit_table(x, bits)) for x in (common, common.filter(F.col("n") > block)))
    occurrences = common.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    schema = "block bigint, lang string, split boolean, lines binary, counts binary"
    routed, ways = slim.mapInArrow(_suffixes(frequent, busy, most, fan[0]), schema), fan[0]
    while ways * block < occurrences:
        routed = routed.repartition("block", F.pmod(F.xxhash64("counts"), F.lit(fan[1]))).mapInArrow(_cut_again(busy, most, ways, fan[1]), schema)
        ways *= fan[1]
    counted = routed.groupBy("block").applyInArrow(_block_counts(most, least), "lang string, phrase string, n bigint")
    phrases = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return vocabulary, cut_lineage(phrases)


def _joined(words_: Column, start: int, length: Column | int) -> Column:
    return F.array_join(F.slice(words_, start, length), " ")


def first_of_each(rows: DataFrame, key: str, order: list[Column], first: int, parts: int = 64) -> DataFrame:
    """The first rows of each key, ranked from 1; a key's rows are cut by hash before any task sorts them all."""
    near = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))).filter(F.col("rank") <= first)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= first).drop("_part")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = 3, least: int = 10, first: int = 2000,
                 covered: int = 50, **settings) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of 2 to ``most`` words of each language.

    ``a`` is a phrase's count, at least ``least``; ``l`` and ``r`` are the counts of its two parts at the
    cut that scores lowest (equal scores: the earliest), score = floor(10**6 a a / (l r)), ``n``
    all words of the language.  A phrase inside a longer counted one goes if that one has
    at least ``covered`` percent of its count.  Order: score and count falling, then the
    phrase's bytes.  A null language is ``und``, a null or empty text has no words; repeated
    rows count each; an empty table gives an empty result.  Products are decimals of 38
    digits, exact for counts below 10**15.  Other columns are not read.
    """
    vocabulary, phrases = phrase_counts(docs, lang, text, most, least, **settings)
    spoken = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = vocabulary.filter(F.col("n") >= least).select("lang", F.col("word").alias("part"), "n").unionAll(phrases.select("lang", F.col("phrase").alias("part"), "n"))
    told = phrases.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("ws"))
    # Both parts of every cut, looked up once for all phrases that share them.
    cuts = F.transform(F.sequence(F.lit(1), F.size("ws") - 1), lambda k: F.struct(
        k.alias("k"), _joined(F.col("ws"), 1, k).alias("front"), F.array_join(F.slice("ws", k + 1, F.size("ws") - k), " ").alias("back")))
    cut = told.select("lang", "phrase", "a", F.inline(cuts))
    fronts = counts.select("lang", F.col("part").alias("front"), F.col("n").alias("l"))
    backs = counts.select("lang", F.col("part").alias("back"), F.col("n").alias("r"))
    both = cut.join(fronts, ["lang", "front"]).join(backs, ["lang", "back"])
    a, left, right = (F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r"))
    exact = both.withColumn("top", F.lit(1000000).cast("decimal(7,0)") * a * a).withColumn("under", left * right)
    scored = exact.withColumn("score", F.expr("top DIV under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m")).select("lang", "phrase", "m.*")
    longer = told.filter(F.size("ws") > 2).select("lang", F.col("a").alias("whole"), F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("ws") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("ws") - k + 1), lambda i: F.array_join(F.slice("ws", i, k), " "))))).alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(~F.coalesce(100 * F.col("whole") >= covered * F.col("a"), F.lit(False)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = first_of_each(kept.select("lang", "phrase", "a", "l", "r", "score"), "lang", order, first)
    return ranked.join(spoken, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
