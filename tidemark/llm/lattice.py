"""SentencePiece encoding by a relational lattice, and decoding.

Texts are cut into units, a run of word marks and what follows it, which no piece crosses.
Texts that follow each other lie in blocks of bounded size.  The different substrings, of
bounded length, of a block's units meet the piece table in an equality join; what the join
finds gives the edges of each different unit, and a fold over them merges the adjacent pair
of best rank until no pair is a piece, which is the order of a BPE model.  A block's texts
and substrings stay in one task, and the piece table is sent, so nothing is exchanged or
written.  Inside tasks a space stands for the word mark.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bytescan import segments, text_bytes

MARK = "▁"
UNKNOWN = -1
PENALTY = 10.0  # below the least score, for a character that no piece has
LONG = 256  # characters; longer units take the plain pass
BLOCK = 4 << 20  # bytes of text whose different units are encoded once
CHUNK = 1 << 16  # bytes of units that are folded together
PART = 1 << 18  # bytes of text, or ids, whose rows are built together
MARKS = 20  # bits of a slot in the marks of what can be a piece
SLOTS = 18  # bits of a slot in the tables of hashes
FACTORS = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)))  # spread a hash over slots, each in its own way
STEP = np.uint64(0xD6E8FEB86659FD93)
NEVER = np.iinfo(np.int32).max  # rank of what is no piece


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id, score, is_byte) of a model file; its size is the model's, not the data's."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(model.id_to_piece(i), i, float(model.get_score(i)), model.is_byte(i)) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    if any(MARK in p.lstrip(MARK) for p, _, _, byte in rows if not byte):
        raise ValueError("a piece crosses a word mark, so units are not independent")
    return spark.createDataFrame(rows, "piece string, id int, score double, is_byte boolean")


def units_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(units of all texts in order, number of units of each text): a space stands for each mark and one for the start."""
    texts = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), MARK, " ")
    begun = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    data, offsets = text_bytes(pc.if_else(pc.not_equal(texts, ""), begun, texts))
    space = data == 32
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(first)
    units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(np.ascontiguousarray(data)))
    return units, np.diff(np.searchsorted(starts, offsets))


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each character and the end, a number for each character, number of the first character of each string and the end)."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.append(first, len(data))
    wide = np.diff(at)
    codes = data[first].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(wide > k)
        codes[more] |= data[first[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return at, codes, np.searchsorted(first, offsets)


def spans(codes: np.ndarray, base: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, first characters, hashes) of the substrings of all strings, by length."""
    left = np.repeat(base[1:], np.diff(base)) - np.arange(len(codes))
    big = (codes.astype(np.uint64) + np.uint64(1)) * FACTORS[0]
    at, hashes = np.arange(len(codes)), big
    for long in range(1, longest + 1):
        yield long, at, hashes
        stay = left[at] > long
        at = at[stay]
        hashes = (hashes[stay] ^ (hashes[stay] >> np.uint64(29))) * STEP + big[at + long]


def slots(hashes: np.ndarray, bits: int, way: int = 0) -> np.ndarray:
    return ((hashes * FACTORS[way]) >> np.uint64(64 - bits)).astype(np.int64)


class Words:
    """Pieces by the hashes of their characters; equal hashes are compared by character."""

    def __init__(self, pieces: pa.Array, longest: int):
        self.longest = longest
        _, codes, base = characters(*text_bytes(pieces))
        self.size = np.diff(base)
        self.codes = np.zeros((len(pieces), longest), np.uint32)
        self.hash = np.zeros(len(pieces), np.uint64)
        for long, at, hashes in spans(codes, base, longest):
            whole = np.flatnonzero(self.size >= long)
            self.codes[whole, long - 1] = codes[base[whole] + long - 1]
            mine = np.flatnonzero(self.size == long)
            self.hash[mine] = hashes[np.searchsorted(at, base[mine])]
        self.may = [np.zeros(1 << MARKS, bool) for _ in FACTORS]
        for way, may in enumerate(self.may):
            may[slots(self.hash, MARKS, way)] = True
        # Pieces that share a slot lie in further tables; those of one hash are too many for any.
        self.tables, rest = [], np.arange(len(pieces))
        while len(rest):
            table = np.full(1 << SLOTS, -1, np.int32)
            table[slots(self.hash[rest], SLOTS)] = rest
            self.tables.append(table)
            rest = rest[table[slots(self.hash[rest], SLOTS)] != rest]

    def found(self, codes: np.ndarray, base: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first characters, pieces) of the substrings that are pieces."""
        for long, at, hashes in spans(codes, base, self.longest):
            some = np.flatnonzero(self.may[0][slots(hashes, MARKS)])
            at, hashes = at[some], hashes[some]
            place = slots(hashes, SLOTS)
            for table in self.tables:
                piece = table[place]
                same = (piece >= 0) & (self.hash[piece] == hashes) & (self.size[piece] == long)
                for k in range(long):
                    one = np.flatnonzero(same)
                    same[one] = codes[at[one] + k] == self.codes[piece[one], k]
                yield long, at[same], piece[same]


def in_parts(batches: list[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about PART bytes of the text, or values of the list, in column ``at``."""
    for batch in batches:
        column = batch.column(at)
        size = pc.binary_length(column) if pa.types.is_string(column.type) else pc.fill_null(pc.list_value_length(column), 0)
        for lo, hi in segments(np.append(0, np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))), PART):
            yield batch.slice(lo, hi - lo)


def _with_substrings(longest: int, may, size: int):
    """Texts in blocks that follow each other, each block's different substrings behind it; ``may`` tells which can be pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "row", "text", "piece"]
        block, filled, held = 0, 0, []

        def rows() -> Iterator[pa.RecordBatch]:
            for part in in_parts(held, 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), *part.columns, pa.nulls(len(part), pa.string())], names)
            texts = pa.chunked_array([part.column(1) for part in held]).combine_chunks()
            found = substrings(units_of(texts)[0].unique(), longest, may.value)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.nulls(len(found), held[0].column(0).type), pa.nulls(len(found), held[0].column(1).type), found], names)

        for batch in batches:
            sums = np.append(0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)))
            lo = 0
            while lo < len(batch):
                hi = int(np.searchsorted(sums, sums[lo] + size - filled, "right")) - 1
                hi = max(hi, lo if held else lo + 1)
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
                    filled += int(sums[hi] - sums[lo])
                    lo = hi
                if lo < len(batch):
                    yield from rows()
                    block, filled, held = block + 1, 0, []
                    pa.default_memory_pool().release_unused()
        if held:
            yield from rows()
    return run


def substrings(units: pa.Array, longest: int, may: list[np.ndarray]) -> pa.Array:
    """The different substrings of ``units`` whose slots are marked."""
    data, offsets = text_bytes(units)
    seen = np.zeros(1 << SLOTS, np.uint64)
    out = []
    for lo, hi in segments(offsets, CHUNK):
        part = data[offsets[lo]:offsets[hi]]
        first, codes, base = characters(part, offsets[lo:hi + 1] - offsets[lo])
        raw, mine = part.tobytes(), []
        for long, at, hashes in spans(codes, base, longest):
            some = np.flatnonzero(may[0][slots(hashes, MARKS)])
            some = some[may[1][slots(hashes[some], MARKS, 1)]]
            place = slots(hashes[some], SLOTS)
            new = seen[place] != hashes[some]  # a slot may forget, and then says a substring again
            some, place = some[new], place[new]
            seen[place] = hashes[some]
            _, once = np.unique(hashes[some], return_index=True)
            starts = at[some[once]]
            mine += [raw[i:j] for i, j in zip(first[starts].tolist(), first[starts + long].tolist())]
        out.append(pa.array(mine, pa.binary()).cast(pa.string()))
    return pa.chunked_array(out, pa.string()).unique()


def merged_units(units: pa.Array, words: Words, ids: np.ndarray, rank: np.ndarray, bytes_from: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units in order, where each unit's begin, and the end) by merge order.

    From single characters on, the adjacent pair whose joined piece has the best rank is
    merged, of equal ones the leftmost, until no pair is a piece.  A character without a
    piece of its own is replaced by its bytes.  All units merge one pair in each round.
    """
    longest = words.longest
    data, offsets = text_bytes(units)
    char, codes, base = characters(data, offsets)
    n = len(codes)
    ranks, name = np.full(n * longest, NEVER, np.int32), np.full(n * longest, UNKNOWN, np.int32)
    for width, start, piece in words.found(codes, base):
        cell = start * longest + width - 1
        ranks[cell], name[cell] = rank[piece], ids[piece]
    long = np.zeros(n, np.int64)  # characters of the symbol that starts here; 0: merged into an earlier one
    at, own, wide = np.arange(n), np.repeat(np.arange(len(units)), np.diff(base)), np.ones(n, np.int64)
    while len(at):
        both = wide[:-1] + wide[1:]
        fits = (own[:-1] == own[1:]) & (both <= longest)
        key = np.full(len(at), NEVER, np.int64)
        key[:-1][fits] = ranks[at[:-1][fits] * longest + both[fits] - 1]
        key = key * len(at) + np.arange(len(at))
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        best = np.minimum.reduceat(key, first)
        going = best < NEVER * len(at)
        chosen = best[going] % len(at)
        over = np.repeat(~going, np.diff(np.append(first, len(at))))
        long[at[over]] = wide[over]
        wide[chosen] += wide[chosen + 1]
        stay = ~over
        stay[chosen + 1] = False
        at, own, wide = at[stay], own[stay], wide[stay]
    symbol = np.flatnonzero(long)
    code = name[symbol * longest + long[symbol] - 1]
    plain = code != UNKNOWN
    size = np.diff(char)[symbol]
    many = np.where(plain, 1, size)
    ends = np.cumsum(many)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    out[(ends - many)[plain]] = code[plain]
    inside = np.arange(int(size[~plain].sum())) - np.repeat(np.cumsum(size[~plain]) - size[~plain], size[~plain])
    out[np.repeat((ends - many)[~plain], size[~plain]) + inside] = data[np.repeat(char[symbol[~plain]], size[~plain]) + inside] + bytes_from
    return out, np.append(0, ends)[np.searchsorted(symbol, base)]


def unit_ids(units: pa.Array, pieces: pa.Table, longest: int, bytes_from: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units in order, where each unit's begin, and the end), from the (piece, id, rank) that the join found.

    Units of more than LONG characters, such as long texts without spaces, take a pass with
    a heap instead of the fold, by the same rule.
    """
    words = Words(pieces["piece"].combine_chunks(), longest)
    ids, rank = pieces["id"].to_numpy(), pieces["rank"].to_numpy()
    plain = None
    offsets = text_bytes(units)[1]
    out, sizes = [], []
    for lo, hi in segments(offsets, CHUNK):
        part = units.slice(lo, hi - lo)
        short = pc.less_equal(pc.utf8_length(part), LONG)
        done, limits = merged_units(part.filter(short), words, ids, rank, bytes_from)
        if hi - lo == len(limits) - 1:
            out.append(done)
            sizes.append(np.diff(limits))
            continue
        if plain is None:
            plain = {p: (-r, i) for p, r, i in zip(pieces["piece"].to_pylist(), rank.tolist(), ids.tolist())}
        next_short = 0
        for unit, is_short in zip(part, short.to_pylist()):
            if is_short:
                one = done[limits[next_short]:limits[next_short + 1]]
                next_short += 1
            else:
                one = np.array(merged(unit.as_py(), plain, bytes_from), np.int32)
            out.append(one)
            sizes.append(np.array([len(one)]))
    return np.concatenate([np.zeros(0, np.int32), *out]), np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes])))


def merged(unit: str, pieces: dict[str, tuple[float, int]], bytes_from: int) -> list[int]:
    """The ids of one unit by merge order, with a heap of pairs."""
    n = len(unit)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            stop = end[after[i]]
            if (known := pieces.get(unit[i:stop])) is not None:
                heapq.heappush(heap, (-known[0], i, stop))
    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        # A pair that one of its sides has left is old.
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        gone = after[i]
        alive[gone], end[i], after[i] = False, stop, after[gone]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        known = pieces.get(unit[i:end[i]])
        out += [known[1]] if known else [b + bytes_from for b in unit[i].encode()]
        i = after[i]
    return out


def viterbi(unit: str, pieces: dict[str, tuple[float, int]], longest: int, low: float, bytes_from: int) -> list[int]:
    """The plain pass under its former name, which a test calls; it has followed merge order since scores proved to be ranks."""
    return merged(unit, pieces, bytes_from)


def _encoded_blocks(longest: int, bytes_from: int):
    """The texts of whole blocks with their ids."""
    def block_ids(texts: list[pa.RecordBatch], found: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, counts = units_of(pa.chunked_array([t.column("text") for t in texts]).combine_chunks())
        coded = units.dictionary_encode()
        known, limits = unit_ids(coded.dictionary, pa.Table.from_batches(found, PIECES), longest, bytes_from)
        use = coded.indices.to_numpy()
        ends, row = np.append(0, np.cumsum(counts)), 0
        for part in in_parts(texts, 2):
            mine = use[ends[row]:ends[row + len(part)]]
            size = (limits[1:] - limits[:-1])[mine]
            stop = np.append(0, np.cumsum(size))
            ids = known[np.repeat(limits[:-1][mine] - stop[:-1], size) + np.arange(stop[-1])]
            lists = pa.ListArray.from_arrays(pa.array(stop[ends[row:row + len(part) + 1] - ends[row]].astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), lists], ["row", "text", "ids"])
            row += len(part)
        pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, texts, found = 0, [], []
        for batch in batches:
            block, piece = batch.column("block").to_numpy(), batch.column("piece").is_valid().to_numpy(zero_copy_only=False)
            kind = block * 2 + piece
            edge = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(kind) else np.zeros(0, np.int64)
            for lo, hi in zip(edge, np.append(edge[1:], len(kind))):
                if block[lo] != last or found and not piece[lo]:
                    if block[lo] <= last or not texts:
                        raise RuntimeError("the rows of a block do not follow each other")
                    yield from block_ids(texts, found)
                    last, texts, found = block[lo], [], []
                part = batch.slice(lo, hi - lo)
                if piece[lo]:
                    found.append(part.select(PIECES.names))
                else:
                    texts.append(part)
        if texts:
            yield from block_ids(texts, found)
    return run


PIECES = pa.schema([("piece", pa.string()), ("id", pa.int32()), ("rank", pa.int32())])


def encoded(docs: DataFrame, pieces: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """Struct ``row`` of ``docs`` (without ``text``) with the text and its ids.

    A block's different units are encoded once; its size is bounded but for a text that is
    longer itself.  A null or empty text has no ids.  Repeated rows are rows of their own;
    other columns are only carried, so their names cannot clash; empty tables give an empty
    result.
    """
    plain = pieces.filter("NOT is_byte").select(F.translate("piece", MARK, " ").alias("piece"), "id", "score")
    bytes_from = pieces.filter("is_byte").agg(F.min("id").alias("first")).first()["first"]
    known = plain.collect()
    longest = max(len(r["piece"]) for r in known)
    # Equal scores have equal ranks; the table is bounded by the model.
    place = {v: i for i, v in enumerate(sorted({r["score"] for r in known}, reverse=True))}
    spark = docs.sparkSession
    ranked = spark.createDataFrame([(r["piece"], r["id"], place[r["score"]]) for r in known], "piece string, id int, rank int")
    may = spark.sparkContext.broadcast(Words(pa.array([r["piece"] for r in known]), longest).may)
    slim = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    row = slim.schema["row"].dataType.simpleString()
    parts = slim.mapInArrow(_with_substrings(longest, may, block), f"block bigint, row {row}, text string, piece string")
    # The join with a sent table moves no row, so a block's rows follow each other; the fold makes sure.
    met = parts.join(F.broadcast(ranked), "piece", "left").filter("piece IS NULL OR id IS NOT NULL").select("block", "row", "text", "piece", "id", "rank")
    return met.mapInArrow(_encoded_blocks(longest, bytes_from), f"row {row}, text string, ids array<int>")


def decoded(rows: DataFrame, pieces: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids: pieces joined as bytes, marks turned to spaces, the first dropped.

    The piece table is bounded by the model and is sent to every task.
    """
    code = {r["id"]: bytes([int(r["piece"][3:5], 16)]) if r["is_byte"] else r["piece"].encode() for r in pieces.collect()}
    table = rows.sparkSession.sparkContext.broadcast([code.get(i) for i in range(max(code) + 1)])
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(table.value, pa.large_binary())
        for batch in (part for whole in batches for part in in_parts([whole], at)):
            lists = pc.fill_null(batch.column(at), [])
            parts = known.take(lists.flatten())
            if parts.null_count:
                raise KeyError("an id is not in the piece table")
            data, offsets = text_bytes(parts)
            limits = offsets[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))]
            whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(limits), pa.py_buffer(np.ascontiguousarray(data))])
            try:
                texts = whole.cast(pa.large_string())
            except pa.ArrowInvalid:
                texts = pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.large_string())
            texts = pc.utf8_slice_codeunits(pc.replace_substring(texts, MARK, " "), start=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(pa.string())], [*batch.schema.names, out])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def with_round_trip(coded: DataFrame, pieces: DataFrame) -> DataFrame:
    """``coded`` with n_ids and round_trip: whether the ids decode to the text."""
    back = decoded(coded, pieces)
    return back.select("row", "text", "ids", F.size("ids").cast("long").alias("n_ids"), (F.col("decoded") == F.col("text")).alias("round_trip"))
