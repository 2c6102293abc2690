"""Similarity join against brute force, with small and with large buckets."""

import inspect
import random

import pytest

from tidemark.llm import ngram_join


def grams(text):
    w = (text or "").split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    nodes = {}
    for i, t in rows:
        nodes.setdefault(grams(t), []).append(i)
    names = list(nodes)
    links = {g: set() for g in names}
    for x in names:
        for y in names:
            if x != y and x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[x].add(y)
    out, seen = {}, set()
    for g in names:
        if g in seen:
            continue
        group, stack = {g}, [g]
        while stack:
            for y in links[stack.pop()] - group:
                group.add(y)
                stack.append(y)
        seen |= group
        ids = [i for y in group for i in nodes[y]]
        for y in group:
            for i in nodes[y]:
                out[i] = (min(ids), min(nodes[y]), len(links[y]), len(ids))
    return out


def made():
    rng = random.Random(5)
    def text(n):
        return [f"w{rng.randrange(400)}" for _ in range(n)]
    rows = []
    for n, copies in ((60, 40), (120, 3), (300, 25), (5, 2), (8, 6)):
        base = text(n)
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + n // 40)):
                t[rng.randrange(n)] = "edit" + str(rng.randrange(9))
            rows.append(" ".join(t))
    rows += [None, "", " \n", "one two", "one  two", "one two three"] + [" ".join(text(50)) for _ in range(20)]
    return list(enumerate(rows, 3))


@pytest.mark.parametrize("small,block", [(32, 512), (4, 7), (1, 3)])
def test_similar_groups(spark, small, block):
    rows = made()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_links int").repartition(3)
    got = ngram_join.similar_groups(docs, small=small, block=block, recall=0.99999, similarity=0.8).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows)


def test_one_of_each_group_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (None, "a b c d e f g", "z"), (4, "other", "x")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in ngram_join.one_of_each_group(docs).collect()) == [1, 4]
    assert ngram_join.similar_groups(docs.limit(0)).collect() == []


def test_bands_reach_the_recall():
    b, r = ngram_join.bands_for(0.8, 0.9995)
    assert 1 - (1 - 0.8**r)**b >= 0.9995 and b * r <= 128


def test_one_of_each_group_judges_rows_not_keys(spark):
    base = [f"w{i}" for i in range(200)]
    a, near = " ".join(base), " ".join(base[:-1] + ["edit"])
    c, c2 = " ".join(f"c{i}" for i in range(90)), " ".join([f"c{i}" for i in range(89)] + ["edit"])
    rows = [(1, a), (None, near), (None, "a text of its own that no other row is like at all"), (None, c), (None, c2),
            (7, near + " more"), (7, "one more that shares no run of five words with any"), (8, "the same row comes two times here"), (8, "the same row comes two times here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.text) for r in ngram_join.one_of_each_group(docs).collect())
    assert [x for x in got if x[1] not in (c, c2)] == sorted([(1, a), (0, rows[2][1]), (7, rows[6][1]), (8, rows[7][1])])
    assert len([x for x in got if x[1] in (c, c2)]) == 1


def test_production_bands_lose_no_link(spark):
    default = inspect.signature(ngram_join.similar_classes).parameters["recall"].default
    b, r = ngram_join.bands_for(0.8, default)
    assert (1 - 0.8**r)**b <= 1e-6 and b * r <= 128
    rows = made()
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x.doc_id: tuple(x)[1:] for x in got} == brute(rows)
