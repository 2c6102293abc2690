"""Importance resampling towards a target: hashed word n-grams of both corpora, a gain per bucket, Gumbel top-k.

Words come from the bytes alone: a table of 256 entries lowers A-Z and blanks what parts
words, ``split`` cuts, and a checksum that takes the one before as its seed extends an
n-gram by a word.  Tasks count buckets in a table of fixed size and Spark adds them up, so
all rows of both corpora count and nothing but that table reaches the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import number_rows
from tidemark.sources.scratch import cut_lineage

#: A-Z to a-z; digits, letters and all bytes above ASCII stay; all else is a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TOGETHER = 1 << 14  # words of a long text that are counted at a time


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """The bytes of each text, one at a time; null is empty."""
    for text in column:
        yield b"" if not text.is_valid else text.as_buffer().to_pybytes()


def features(raw: bytes, runs: int, buckets: int) -> tuple[int, int, Counter]:
    """(words, features, count of each bucket) of a text."""
    words = raw.translate(LETTERS).split()
    found: Counter = Counter()
    for lo in range(0, len(words), TOGETHER):
        part = words[lo:lo + TOGETHER]
        codes = list(map(crc32, part))
        seen = Counter(codes)
        # A run that starts in this part may end in the next one.
        spaced = [b" " + w for w in words[lo + 1:lo + TOGETHER + runs - 1]] if runs > 1 else []
        for k in range(runs - 1):
            codes = list(map(crc32, spaced[k:], codes))
            seen.update(codes)
        for code, n in seen.items():
            found[code % buckets] += n
    n_features = sum(max(0, len(words) - k) for k in range(runs))
    return len(words), n_features, found


def _counted(runs: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in texts_of(batch.column(0)):
                found = features(raw, runs, buckets)[2]
                total[np.fromiter(found, np.int64)] += np.fromiter(found.values(), np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, text: str = "text", runs: int = 1, buckets: int = 10000) -> DataFrame:
    """(bucket, n): features of all texts by bucket; at most ``buckets`` rows."""
    counted = texts.select(F.col(text).alias("text")).mapInArrow(_counted(runs, buckets), "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln(P(bucket | target) / P(bucket | raw))), each with one added; reads at most 2 x ``buckets`` rows."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, into in ((raw, s), (target, t)):
        for row in counts.collect():
            into[row["bucket"]] = row["n"]
    all_raw, all_target = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_raw / ((a + 1.0) * all_target))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def _weighed(table, runs: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value.tolist()
        for batch in batches:
            rows = []
            for raw in texts_of(batch.column(1)):
                n_words, n, found = features(raw, runs, buckets)
                rows.append((n_words, n, sum(gain[b] * k for b, k in found.items()) // n if n else 0))
            cols = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["_row", "_words", "n_features", "weight"])
    return run


def noise(key, seed: int):
    """1000 x Gumbel noise, floored, from the first 32 bits of sha256("seed:key")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def importance_weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
                       runs: int = 1, buckets: int = 10000) -> DataFrame:
    """(doc_id, n_words, n_features, weight) per row of ``docs``.

    ``weight`` is the floored mean, over a text's features, of the gains of their buckets
    (1/1000 of a nat).  Texts are read twice, once for the counts and once for the weights.
    """
    spark = docs.sparkSession
    table = gains(bucket_counts(docs, text, runs, buckets), bucket_counts(target, target_text, runs, buckets), buckets)
    sent = spark.sparkContext.broadcast(table)
    slim = docs.select(F.col(key).alias("_row"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    told = slim.mapInArrow(_weighed(sent, runs, buckets), f"_row {kind}, _words bigint, n_features bigint, weight bigint")
    return told.select(F.col("_row").alias("doc_id"), F.col("_words").alias("n_words"), "n_features", "weight")


def importance_sample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", runs: int = 1,
                      buckets: int = 10000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of ``docs``.

    ``score`` adds Gumbel noise to the weight, so the highest scores are a draw without
    replacement in proportion to the importance.  Of the N rows with at least
    ``least_words`` words the first floor(N * percent / 100) get a rank from 1 (by score, ties to
    the smaller key); other ranks are null.  A null text has no words, a null key draws
    the noise of the empty text and comes first among equal scores.  Repeated rows are ranked
    each; equal keys with equal scores come in any order.  An empty table gives an empty
    result, an empty target shrinks all gains alike.  Other columns are not read.

    Ranks number the rows inside each score and add what higher scores have before them: a
    table of one row per score, whose number is bounded by the range of gains and noise.
    """
    weighed = cut_lineage(importance_weights(docs, target, key, text, target_text, runs, buckets)
                          .withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = weighed.filter(F.col("n_words") >= least_words)
    drawn = F.expr(f"_all * {int(percent)} DIV 100")
    ranked = number_rows(able, [], F.col("score"), [F.col("doc_id").asc_nulls_first()], out="rank", bucket_desc=True, total="_all")
    out = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    rest = weighed.filter(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, rank).unionAll(rest)
