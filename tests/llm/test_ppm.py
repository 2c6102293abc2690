"""Scores against a plain trie of byte contexts."""

import math
import random
import zlib

import pytest

from tidemark.llm import ppm

SENTENCES = ["the cat sat on the mat and THE dog saw it", "les élèves préfèrent être là où ça sèche", "größere Bäume müßten schöner blühen", "ελληνικά κείμενα με τόνους", "東京と京都の間"]


class Trie:
    def __init__(self, order):
        self.order, self.counts = order, {}

    def places(self, text):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        line = [255] * self.order + [*raw, 255]
        return [(line, i) for i in range(self.order, len(line))]

    def learn(self, text):
        for line, i in self.places(text):
            for k in range(self.order + 1):
                seen = self.counts.setdefault(tuple(line[i - k:i]), {})
                seen[line[i]] = seen.get(line[i], 0) + 1

    def score(self, text):
        return sum(math.log10(self.chance(line, i)) for line, i in self.places(text))

    def chance(self, line, i):
        out, gone = 1.0, set()
        for k in range(self.order, -1, -1):
            seen = self.counts.get(tuple(line[i - k:i]))
            if seen is None:
                continue
            left = {x: n for x, n in seen.items() if x not in gone}
            total, kinds = sum(left.values()), len(left)
            if not left:
                continue
            gone |= set(seen)
            escape = kinds if len(gone) < 256 else 0
            if line[i] in left:
                return out * left[line[i]] / (total + escape)
            out *= escape / (total + escape)
        return out / (256 - len(gone))


def made():
    rng = random.Random(5)
    texts = [None, "", "aaaa", "abababab" * 30, "x"]
    for _ in range(60):
        words = rng.choice(SENTENCES).split()
        texts.append(" ".join(rng.choice(words) if rng.random() < 0.9 else "".join(rng.choice("qwzé日") for _ in range(4)) for _ in range(rng.randrange(1, 12))))
    return texts + texts[10:14]


@pytest.mark.parametrize("room", [0, 50, 1 << 21])
def test_scores_equal_a_plain_trie(spark, room):
    texts = made()
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(9, texts[20])]
    trie = Trie(ppm.ORDER)
    held = {}
    for k, t in rows:
        held[k] = zlib.crc32(str("" if k is None else k).encode()) % 7 == 2
        if not held[k]:
            trie.learn(t)
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, key int, n int, cell int").repartition(3)
    got = ppm.log_scores(docs, table_words=room, table_cells=room).collect()
    assert len(got) == len(rows) and any(held.values())
    want = sorted((str(k), trie.score(t)) for k, t in rows)
    for (key, score), r in zip(want, sorted(got, key=lambda r: (str(r.doc_id), r.score))):
        assert str(r.doc_id) == key and r.score == pytest.approx(score, abs=1e-9) and r.held_out == held[r.doc_id]


def test_probabilities_of_a_context_sum_to_one(spark):
    rng = random.Random(1)
    context = [rng.randrange(256) for _ in range(5)]
    trie = Trie(5)
    for t in made():
        trie.learn(t)
    for line in (context, list("the c".encode()), list("é et".encode()), [255] * 5):
        assert math.isclose(sum(trie.chance([*line, s], 5) for s in range(256)), 1)


def test_all_bytes_seen_and_nothing_learned(spark):
    """A context that has seen every symbol does not escape; without training texts all symbols are equally likely."""
    cells = spark.createDataFrame([(s, 1 + s % 3) for s in range(256)] + [(256 + 7, 0)], "cell long, n long")
    p = {r.cell: r.p for r in ppm.probabilities(cells).collect()}
    total = sum(1 + s % 3 for s in range(256))
    assert p[4] == pytest.approx((1 + 4 % 3) / total) and p[256 + 7] == pytest.approx((1 + 7 % 3) / total)
    held = next(k for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = ppm.log_scores(spark.createDataFrame([(held, "abc")], "doc_id long, text string")).first()
    assert r.score == pytest.approx(4 * math.log10(1 / 256)) and (r.n_known, r.train_tokens) == (0, 0)
    assert ppm.log_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_contexts_grow_with_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    def filled(rows):
        counts = rows.mapInArrow(ppm._learned(7, 2), "kind int, key bigint, n bigint").filter("kind = 1 AND n > 0")
        return counts.select("key").distinct().count()
    some, all_ = filled(docs.filter("doc_id % 8 = 0")), filled(docs)
    assert all_ > 2 * some
