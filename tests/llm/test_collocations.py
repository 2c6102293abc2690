"""Collocations against brute force, and the sort on its own."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, most, least, first, covered=50):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(ws)
            counts.update((lang, tuple(ws[i:i + k])) for k in range(1, most + 1) for i in range(len(ws) - k + 1))
    found = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, ws), a in found.items():
        if any(o == lang and len(v) > len(ws) and 100 * b >= covered * a and any(v[i:i + len(ws)] == ws for i in range(len(v)))
               for (o, v), b in found.items()):
            continue
        cuts = [(10**6 * a * a // (counts[lang, ws[:k]] * counts[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), counts[lang, ws[:k]], counts[lang, ws[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, total[lang], -s)
                  for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1))


def made(seed):
    rng = random.Random(seed)
    common = ["the", "The", "of", "é", "日本", "in", "x1", "#", "b'c", "und"]
    texts = [None, "", " \t", ".,;", "a", "one two", "a\x0bb a b\x0ca b", "\x1fq\x00 q"]
    for _ in range(120):
        words = [rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 40))]
        texts.append("".join(w + rng.choice([" ", " ", " ", "  ", "\t ", ", ", ".\n", " ! "]) for w in words))
    texts += ["new york city hall " * 30, "very common pair " * 200] + texts[20:30]
    return [(rng.choice(["en", "en", "en", "de", None, ""]), t) for t in texts]


# Small blocks: common leading words share their suffixes among blocks; few bits: they collide; few ways: bundles are cut again.
@pytest.mark.parametrize("most,least,block,bits,fan", [(3, 10, 1 << 18, 25, (256, 64)), (3, 4, 60, 16, (5, 4)), (4, 3, 25, 6, (2, 7)), (2, 3, 40, 10, (1, 64))])
def test_equals_brute_force(spark, most, least, block, bits, fan):
    rows = made(most * least)
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(4)
    for first in (7, 2000):
        got = collocations.collocations(docs, most=most, least=least, first=first, block=block, bits=bits, fan=fan).collect()
        assert sorted(map(tuple, got)) == brute(rows, most, least, first)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []


@pytest.mark.parametrize("least", [1, 3, 40])
def test_equal_runs(least):
    rng = np.random.default_rng(least)
    keys = [rng.integers(0, 6, 500), rng.integers(-1, 5, 500), rng.integers(-1, 3, 500)]
    keys[2][keys[1] < 0] = -1
    weight = rng.integers(1, 4, 500)
    spared = keys[0] == 2
    want = Counter()
    for i in range(500):
        for d in range(3):
            if keys[d][i] < 0:
                break
            want[tuple(int(k[i]) for k in keys[:d + 1])] += int(weight[i])
    got = {tuple(int(k[a]) for k in keys[:d + 1]): int(n) for d, at, ns in collocations.equal_runs(keys, weight, least, spared) for a, n in zip(at, ns)}
    assert got == {k: n for k, n in want.items() if n >= least or (len(k) == 1 and k[0] == 2)}


def test_bit_table_is_read_as_spark_writes_it(spark):
    from zlib import crc32
    pairs = [("en", w) for w in ("the", "of", "é", "日本")] + [("", "x")]
    table = collocations.bit_table(spark.createDataFrame(pairs, "lang string, word string"), 20)
    slots = {crc32((a + b).encode()) & (1 << 20) - 1 for a, b in pairs}
    assert set(np.flatnonzero(np.unpackbits(table, bitorder="little")).tolist()) == slots
