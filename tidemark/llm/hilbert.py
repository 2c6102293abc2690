"""Shards along a Hilbert curve through metadata dimensions, in column expressions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row; an expression would be computed at each mention and inside each step of a fold."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """Position on the curve of a cell given by integers in [0, 2**bits).

    The axes are turned into the curve's transposed form one (bit, axis) step at a time by a
    fold over an array (Skilling, 2004), then Gray-coded and interleaved.  Neighbours on the
    curve are neighbours in space.
    """
    n = len(cells)
    start = F.array(*[c.cast("long") for c in cells])
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        first, own = F.get(x, F.lit(0)), F.get(x, s["i"])
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        flip = own.bitwiseAND(s["q"]) != 0
        return F.transform(x, lambda v, j: F.when(flip, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
                           .otherwise(F.when(s["i"] == 0, v).when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v)))

    def gray(turned: Column) -> Column:
        """Each axis takes the exclusive or of itself and all before it."""
        return F.transform(turned, lambda _, j: F.aggregate(F.slice(turned, F.lit(1), j + 1), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v)))

    def index(coded: Column) -> Column:
        last = F.get(coded, F.lit(n - 1))
        carry = F.aggregate(F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>"),
                            F.lit(0).cast("long"), lambda a, q: F.when(last.bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))
        order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        return _once(carry, lambda c: F.aggregate(order, F.lit(0).cast("long"), lambda a, s: a * 2 + F.getbit(F.get(coded, s["i"]).bitwiseXOR(c), s["b"])))

    return _once(F.aggregate(steps, start, turn), lambda turned: _once(gray(turned), index))


def quantised(docs: DataFrame, numeric: Sequence[Column], labels: Sequence[Column], bits: int) -> list[Column]:
    """Cells of numbers (equal shares of the rows) and of labels (by hash); nulls take cell 0.

    The bounds of the shares come from approximate percentiles over all rows: a fixed number
    of figures, read back and put into the plan.
    """
    top = (1 << bits) - 1
    shares = [i / (top + 1) for i in range(1, top + 1)]
    found = docs.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"c{i}") for i, c in enumerate(numeric)]).first() if numeric else []
    out = []
    for c, bounds in zip(numeric, found or [None] * len(numeric)):
        cuts = sorted(set(bounds or []))
        out.append(F.coalesce(F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda b: b < c)), F.lit(0)) if cuts else F.lit(0))
        out[-1] = F.when(c.isNull(), F.lit(0)).otherwise(out[-1])
    return out + [F.when(c.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(c), F.lit(top + 1))) for c in labels]


def curve_shards(docs: DataFrame, shards: int, cells: Sequence[Column], bits: int, key: str = "doc_id", parts: int = 64) -> DataFrame:
    """``docs`` with curve (index), shard and slot: runs of the curve with row counts at most one apart.

    Rows in one cell follow by a hash of the key, then the key.  A cell may hold any share of
    the rows: it is cut into ``parts`` by that hash, rows are numbered inside the parts, and
    two small tables (parts of a cell, cells) give what comes before.  Repeated rows are
    separate rows.  Fewer rows than shards leave shards empty.
    """
    at = docs.withColumn("curve", hilbert_index(cells, bits)).withColumn("_hash", F.xxhash64(key))
    at = at.withColumn("_part", F.pmod(F.shiftrightunsigned("_hash", 20), F.lit(parts)))
    sizes = at.groupBy("curve", "_part").agg(F.count("*").alias("_n"))
    inner = Window.partitionBy("curve").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cell = sizes.groupBy("curve").agg(F.sum("_n").alias("_cell"))
    # At most one row for each cell of the curve: a fixed number.
    across = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cell.select("curve", F.coalesce(F.sum("_cell").over(across), F.lit(0)).alias("_ahead"),
                        F.sum("_cell").over(Window.partitionBy()).alias("_all"))
    offsets = (sizes.select("curve", "_part", F.coalesce(F.sum("_n").over(inner), F.lit(0)).alias("_before"))
               .join(ahead, "curve").select("curve", "_part", (F.col("_ahead") + F.col("_before")).alias("_first"), "_all"))
    no = F.row_number().over(Window.partitionBy("curve", "_part").orderBy("_hash", key)) - 1
    ranked = at.withColumn("_no", no).join(offsets, ["curve", "_part"]).withColumn("_rank", F.col("_first") + F.col("_no"))
    # The k-th shard starts at ceil(k * all / shards).
    shard = F.expr(f"(_rank * {shards}) DIV _all")
    start = F.expr(f"(shard * _all + {shards} - 1) DIV {shards}")
    return (ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_rank") - start)
            .drop("_hash", "_part", "_first", "_no", "_rank", "_all"))


def shard_bounds(sharded: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least and largest value per shard: what a reader needs to skip files."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def document_shards(docs: DataFrame, shards: int = 16, bits: int = 3, key: str = "doc_id", text: str = "text",
                    labels: Sequence[str] = ("source", "lang")) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve): every row, law ``rows``.

    Dimensions: text size, key (a hash of a key that is no number), and the label columns.  A null text has size 1, as an empty
    one; null labels and keys share cell 0.  An empty table gives an empty result.  Other
    columns are not read, so their names cannot clash.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"),
                       *[F.col(c).alias(f"_label{i}") for i, c in enumerate(labels)])
    place = F.col("doc_id") if isinstance(docs.schema[key].dataType, T.NumericType) else F.xxhash64("doc_id")
    cells = quantised(slim, [F.col("size"), F.when(F.col("doc_id").isNotNull(), place)], [F.col(f"_label{i}") for i in range(len(labels))], bits)
    out = curve_shards(slim, shards, cells, bits)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
