"""Suffix arrays and chunk recipes against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chunk_dedup, suffix_index


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i:i + length]] = seen.get(r[i:i + length], 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def made_texts(seed):
    rng = random.Random(seed)
    letters = "abcdeé "
    def text(n):
        return "".join(rng.choice(letters) for _ in range(n))
    shared = [text(n) for n in (60, 150, 240, 420)]
    texts = [None, "", "a" * 700, "ab" * 400, text(30), text(500)]
    for _ in range(40):
        t = text(rng.randrange(0, 300))
        for s in rng.sample(shared, rng.randrange(0, 4)):
            a = rng.randrange(0, 20)
            t += s[a:len(s) - rng.randrange(0, 20)] + text(rng.randrange(0, 200))
        texts.append(t)
    texts += texts[6:10] + [texts[8][:200] + "x" + texts[8][200:]]
    return texts


@pytest.mark.parametrize("length,gram,batches", [(60, 20, 4), (60, 35, 3), (200, 100, 1)])
def test_repeats_equal_brute_force(spark, length, gram, batches):
    texts = made_texts(length)
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    got = suffix_index.repeated_removed(docs, length=length, gram=gram, batches=batches).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = brute_repeats(texts, length)
    assert {r[0]: tuple(r)[1:] for r in got} == {(i if i else None): w for i, w in enumerate(want)}


def test_repeats_across_seams_of_long_texts():
    import numpy as np
    text = "".join(random.Random(3).choice("abcdefgh") for _ in range(900)).encode()
    data = np.frombuffer(text, np.uint8)
    whole = suffix_index.Stretches(data, np.array([0, 900]), 50, 20)
    seen = set()
    for a in range(0, 900 - 49, 97):
        b = min(900, a + 97 + 49)
        s = suffix_index.Stretches(data[a:b], np.array([0, b - a]), 50, 20)
        for first, last, key in zip(s.first, s.last, s.key):
            seen |= {(w + a, int(key)) for w in range(first, last + 1)}
    assert seen == {(w, int(k)) for f, e, k in zip(whole.first, whole.last, whole.key) for w in range(f, e + 1)}


def test_without_repeats_keeps_columns_and_code_points(spark):
    shared = "é" * 130
    docs = spark.createDataFrame([(1, shared + "one", 5), (2, "two" + shared, 6), (3, None, 7), (4, "", 8)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: (r.text, r.n_bytes) for r in suffix_index.without_repeats(docs).collect()}
    assert got == {1: ("one", 5), 2: ("two", 6), 3: (None, 7), 4: ("", 8)}
    assert suffix_index.without_repeats(docs.limit(0)).collect() == []


@pytest.mark.parametrize("id_bytes", [16, 1])
def test_exact_duplicates(spark, id_bytes):
    texts = made_texts(7) + ["x" * 50_000, "x" * 50_000, "x" * 50_001]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "", "clash"), (None, "alone", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, recipe string").repartition(4)
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept)
           for r in chunk_dedup.exact_duplicates(docs, mean=64, least=16, most=256, id_bytes=id_bytes).collect()}
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    want = {}
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, hashlib.sha256(t.encode()).hexdigest()] = (keep, len(ids), i == keep)
    assert got == want


def test_exact_duplicates_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (1, "a", "s"), (2, "a", "s"), (2, "a", "s"), (3, None, "s")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in chunk_dedup.without_duplicates(docs).collect()) == [2, 3]
    assert chunk_dedup.exact_duplicates(docs.limit(0)).collect() == []
    assert chunk_dedup.without_duplicates(docs.drop("source")).columns == ["doc_id", "text"]


def test_chunks_are_cut_by_content():
    import numpy as np
    rng = np.random.default_rng(1)
    text = rng.integers(97, 122, 20_000).astype(np.uint8)
    moved = np.concatenate([np.frombuffer(b"some bytes before", np.uint8), text])
    def contents(x):
        start, out = 0, set()
        for end in chunk_dedup.cuts(x, np.array([0, len(x)]), 256, 32, 1024)[0]:
            out.add(x[start:end].tobytes())
            start = end
        return out
    assert len(contents(text) & contents(moved)) > 0.9 * len(contents(text))


def test_empty_columns_of_nulls(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert {r.group_size for r in chunk_dedup.exact_duplicates(docs).collect()} == {3}
    assert {r.n_removed for r in suffix_index.repeated_removed(docs).collect()} == {0}
