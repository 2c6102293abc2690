"""Near-duplicate vectors against brute force; recall of the tables at the threshold."""

import numpy as np
import pytest

from tidemark.llm import itq


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def at_cosine(rng, x, cosine):
    """Vectors at exactly that cosine of unit vectors x."""
    y = rng.standard_normal(x.shape)
    y = unit(y - (y * x).sum(1, keepdims=True) * x)
    return cosine * x + np.sqrt(1 - cosine**2) * y


def brute(rows, similarity):
    able = [(i, np.array(v, np.float64)) for i, (_, v) in enumerate(rows)
            if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    links = {i: set() for i in range(len(rows))}
    for size in {len(v) for _, v in able}:
        ids = [i for i, v in able if len(v) == size]
        m = unit(np.array([v for _, v in able if len(v) == size]))
        for a, b in zip(*np.nonzero(m @ m.T >= similarity)):
            if a != b:
                links[ids[a]].add(ids[b])
    out, seen = [None] * len(rows), set()
    for i in links:
        if i in seen:
            continue
        group, stack = {i}, [i]
        while stack:
            for y in links[stack.pop()] - group:
                group.add(y)
                stack.append(y)
        seen |= group
        keys = [rows[g][0] for g in group if rows[g][0] is not None]
        name = min(keys) if keys else None
        for g in group:
            out[g] = (rows[g][0], len(links[g]), name, rows[g][0] == name)
    return sorted(out, key=str)


def made(d, seed):
    rng = np.random.default_rng(seed)
    x = unit(rng.standard_normal((160, d)) + 0.3)
    parts = [x, at_cosine(rng, x[:60], 0.97), at_cosine(rng, x[:60], 0.93), x[:20] * 3.5, x[20:30]]
    parts.append(unit(x[100] + 0.01 * rng.standard_normal((90, d))))  # a large group of different vectors
    vectors = [v.tolist() for v in np.concatenate(parts).astype(np.float32)]
    vectors += [None, [], [0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] * d, [1.0] * (d + 1), [2.0] * (d + 1), [1e-30] + [0.0] * (d - 1)]
    vectors += [vectors[0]] * 40
    rows = [(i + 5, v) for i, v in enumerate(vectors)]
    return rows + [(None, vectors[3]), (None, None), (rows[50][0], vectors[50]), (None, [0.5] * (d + 2))]


@pytest.mark.parametrize("d,kind,small,block", [(64, "float", 32, 512), (64, "double", 4, 7), (24, "float", 1, 5)])
def test_equals_brute_force(spark, d, kind, small, block):
    rows = made(d, small)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, copies int, node int").repartition(5)
    got = itq.near_duplicates(table, small=small, block=block).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 0.95)


def test_no_vectors(spark):
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    lone = spark.createDataFrame([("a", None), (None, None)], "vec_id string, embedding array<float>")
    assert sorted(map(tuple, itq.near_duplicates(lone).collect()), key=str) == [("a", 0, "a", True), (None, 0, None, True)]


def test_recall_of_the_tables():
    """Pairs exactly at the threshold, the hardest ones, in an isotropic and in a clustered space."""
    rng = np.random.default_rng(4)
    for centres in (None, unit(rng.standard_normal((25, 64)))):
        x = rng.standard_normal((6000, 64))
        if centres is not None:
            x = 0.12 * x + centres[rng.integers(0, 25, 6000)]
        x = unit(x)
        y = at_cosine(rng, x, 0.95)
        tables, bits = itq.tables_for(len(x), 0.95, 0.999)
        q = itq.learned(x[:2000], tables, bits)
        (s, a), (t, b) = q.codes(x), q.codes(y)
        apart = np.array([int(v).bit_count() for v in s ^ t])
        found = (a == b).any(1) & (apart <= 20)
        assert found.mean() >= 0.99, (tables, bits, found.mean())
        # Balanced bits: no sign is much more frequent than the other.
        on = ((x - q.centre) @ q.projection > 0).mean(0)
        assert abs(on.mean() - 0.5) < 0.02


def test_rotation_lowers_the_loss():
    rng = np.random.default_rng(2)
    x = unit(rng.standard_normal((3000, 32)) * np.linspace(0.2, 2, 32))
    def loss(q):
        v = (x - q.centre) @ q.projection[:, :32]
        return ((np.sign(v) / np.sqrt(32) - unit(v)) ** 2).sum()
    assert loss(itq.learned(x, 4, 8)) < 0.97 * loss(itq.learned(x, 4, 8, rounds=0))


def test_equal_vectors_in_one_bucket(spark):
    """Copies of one vector are a third of all rows; they are one node."""
    rng = np.random.default_rng(6)
    x = unit(rng.standard_normal((200, 16))).tolist()
    rows = [(i, x[0] if i % 3 == 0 else x[i % 200]) for i in range(600)]
    got = {r.vec_id: tuple(r)[1:] for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {r[0]: r[1:] for r in brute(rows, 0.95)}
