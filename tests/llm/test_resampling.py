"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from tidemark.llm import resampling


def brute(docs, target, runs, buckets, percent, least, seed):
    def feats(text):
        raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        ws = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", raw)
        return ws, [crc32(b" ".join(ws[i:i + k])) % buckets for k in range(1, runs + 1) for i in range(len(ws) - k + 1)]
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(feats(x)[1])
    for x in target:
        t.update(feats(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for key, x in docs:
        ws, f = feats(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(ws)])
    able = sorted((-r[3], -1 if r[0] is None else r[0]) for r in rows if r[4] >= least)
    rank = {k: i for i, (_, k) in enumerate(able[:percent * len(able) // 100], 1)}
    return sorted((-1 if r[0] is None else r[0], *r[1:4], rank.get(-1 if r[0] is None else r[0])) for r in rows)


def made():
    rng = random.Random(8)
    texts = [None, "", "-", "ONE two", "É é\x00x", "a" * 40000, "w1 w2 " * 20000, "0 1 2 3 4 5 6 7 8 9 " * 3]
    for _ in range(150):
        texts.append(" ".join(f"{rng.choice('abcdeÄ日')}{rng.randrange(30)}" for _ in range(rng.randrange(0, 60))))
    docs = list(enumerate(texts, 1)) + [(None, texts[30])]
    return docs, [None, "", "w1 a2, B3; c4", "w2 É日", "d5 d5 d5"]


@pytest.mark.parametrize("runs,buckets,percent,least", [(1, 10000, 10, 20), (2, 97, 35, 5), (3, 1000, 100, 0)])
def test_equals_plain(spark, runs, buckets, percent, least):
    docs, target = made()
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rank int, n_words int").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    settings = {"runs": runs, "buckets": buckets, "percent": percent, "least_words": least}
    got = resampling.importance_sample(table, aim, seed=2024, **settings).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got)
    assert got == brute(docs, target, runs, buckets, percent, least, 2024)


def test_long_texts_in_parts(monkeypatch):
    words = [f"w{i % 7}" for i in range(100)]
    raw = " ".join(words).encode()
    whole = resampling.features(raw, 3, 50)
    for together in (1, 2, 3, 33):
        monkeypatch.setattr(resampling, "TOGETHER", together)
        assert resampling.features(raw, 3, 50) == whole


def test_empty_tables_and_repeated_rows(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    text = "some words to count here " * 5
    rows = spark.createDataFrame([(5, text)] * 4 + [(5, None)], "doc_id long, text string")
    assert resampling.importance_sample(nothing, rows).collect() == []
    got = resampling.importance_sample(rows, nothing, percent=50).collect()
    gain = math.floor(1000 * math.log((100 + 10000) / (21 * 10000)))  # five words, 20 times each
    assert len(got) == 5 and sorted(r.rank for r in got if r.rank) == [1, 2] and {r.weight for r in got if r.n_features} == {gain}
    named = spark.createDataFrame([("a", text), ("b", text)], "doc_id string, text string")
    assert sorted(r.rank or 0 for r in resampling.importance_sample(named, rows, percent=100).collect()) == [1, 2]
