"""Regions as rows of vertices against the plain ring test."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import regions


def shapes():
    rng = np.random.default_rng(1)
    turn = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    star = [(np.cos(t) * r, np.sin(t) * r) for t, r in zip(turn, rng.uniform(0.3, 1.0, 400))]
    comb = [p for i in range(100) for p in ((i * 0.02, 0.0), (i * 0.02 + 0.01, 1.0))] + [(2.0, -0.1), (0.0, -0.1)]
    box = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    return {1: star, 2: comb, 3: box, 4: [(0.5, 0.5), (0.6, 0.5), (0.55, 0.5)]}


def test_equals_the_ring_test(spark):
    rng = np.random.default_rng(2)
    points = [*rng.uniform(-1.1, 2.1, (700, 2)).tolist(), *shapes()[1][:30], *shapes()[2][:30], [0.0, 0.5], [1.0, 0.5], [0.5, 1.0], [0.5, 0.0], [0.5, 0.5]]
    vertices = spark.createDataFrame([(k, i, float(x), float(y)) for k, ring in shapes().items() for i, (x, y) in enumerate(ring, 1)], "ring_id int, seq int, lon double, lat double")
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [(9999, None, 0.5)], "position_id int, lon double, lat double")
    for buffer in (None, 0.03):
        buffers = None if buffer is None else spark.createDataFrame([(k, buffer if k != 3 else None) for k in (1, 2, 3)], "ring_id int, buffer_deg double")
        got = {(r.position_id, r.ring_id) for r in regions.points_in_regions(df, vertices, buffers).collect()}
        want = set()
        for k, ring in shapes().items():
            closed = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in [*ring, ring[0]]])
            grown = F.lit(buffer if k in (1, 2) else None).cast("double")
            inside = df.filter(geo.inside_region(F.col("lon"), F.col("lat"), closed, grown)).select("position_id").collect()
            want |= {(r.position_id, k) for r in inside}
        assert got == want


def test_edges_are_listed_about_twice(spark):
    """A comb has few slabs, a round ring many; neither multiplies its edges."""
    n = 20_000
    turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
    rows = [(1, i, float(np.cos(t)), float(np.sin(t))) for i, t in enumerate(turn, 1)] + [(2, i, i / n, float(i % 2)) for i in range(1, n + 1)]
    edges = regions.ring_edges(spark.createDataFrame(rows, "ring_id int, seq int, lon double, lat double"))
    facts = {r.ring_id: r for r in regions.ring_facts(edges).collect()}
    listed = edges.join(regions.ring_facts(edges), "ring_id").select("ring_id", (regions._slab(F.greatest("ay", "by")) - regions._slab(F.least("ay", "by")) + 1).alias("k"))
    sums = {r.ring_id: r.k for r in listed.groupBy("ring_id").agg(F.sum("k").alias("k")).collect()}
    assert edges.count() == 2 * n and max(sums.values()) <= 3 * n
    assert facts[1].height == pytest.approx(2 / (n / 2), rel=0.01) and facts[2].height > 0.4


def ragged(n=4000):
    rng = np.random.default_rng(3)
    turn, r = np.linspace(0, 2 * np.pi, n, endpoint=False), rng.uniform(0.5, 1.0, n)
    return [(1, i, float(x), float(y)) for i, (x, y) in enumerate(zip(r * np.cos(turn), r * np.sin(turn)), 1)]


def test_a_place_meets_few_edges_of_a_ragged_ring(spark):
    """Long edges that run up and down meet only the places whose cells they pass, not a share of all."""
    rng = np.random.default_rng(4)
    rows, places = ragged(), [(1, float(x), float(y)) for x, y in rng.uniform(-1, 1, (4000, 2))]
    edges = regions.ring_edges(spark.createDataFrame(rows, "ring_id int, seq int, lon double, lat double"))
    places = spark.createDataFrame(places, "ring_id int, lon double, lat double")
    grid = regions.cell_grid(regions.ring_facts(edges), places, "ring_id")
    listed = regions.cell_edges(edges.join(grid.select("ring_id", "step"), "ring_id"), "ring_id")
    at = places.join(grid.select("ring_id", "step"), "ring_id").select("ring_id", regions._cell(F.col("lon")).alias("cx"), regions._cell(F.col("lat")).alias("cy"))
    assert listed.count() < 4000 * 40 and at.join(listed, ["ring_id", "cx", "cy"]).count() < 4000 * 4000 / 100


@pytest.mark.parametrize("missing", [(), (7, 8, 300, 3999)])
def test_ragged_ring_equals_plain_sums(spark, missing):
    """Also where vertices are missing, and where a point has several rows."""
    rng = np.random.default_rng(5)
    rows = [(k, i, None if i in missing else x, None if i in missing else y) for k, i, x, y in ragged(4000)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-1.02, 1.02, (600, 2)))]
    points += [(i, x, y) for i, x, y in points[:50]] + [(i, y, x) for i, x, y in points[50:90]] + [(None, 0.0, 0.0), (None, 0.9, 0.9)]
    buffers = spark.createDataFrame([(1, 0.01)], "ring_id int, buffer_deg double")
    vertices = spark.createDataFrame(rows, "ring_id int, seq int, lon double, lat double")
    df = spark.createDataFrame(points, "position_id int, lon double, lat double")
    ring = [(np.nan, np.nan) if x is None else (x, y) for _, _, x, y in rows]
    a, b = np.array(ring), np.array([*ring[1:], ring[0]])
    known = ~np.isnan(a).any(axis=1) & ~np.isnan(b).any(axis=1)
    (ax, ay), (bx, by) = a[known].T, b[known].T
    sums, near = {}, {}
    for i, x, y in points:
        if not (ax.min() - 0.01 <= x <= ax.max() + 0.01 and ay.min() - 0.01 <= y <= ay.max() + 0.01):
            continue
        with np.errstate(all="ignore"):
            hits = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0, 1)
        close = ((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2).min() < 0.01 ** 2
        sums[i], near[i] = sums.get(i, 0) + int(hits.sum()), near.get(i, False) or close
    for buffer in (None, buffers):
        got = {r.position_id for r in regions.points_in_regions(df, vertices, buffer).collect()}
        bounds = sums if buffer is not None else {i: n for i, n in sums.items()}
        want = {i for i, n in bounds.items() if n % 2 == 1 or (buffer is not None and near[i])}
        if buffer is None:  # without a buffer the bounds are narrower; rows between both bounds cross nothing of a closed ring
            edge = {i for i, x, y in points if not (ax.min() <= x <= ax.max() and ay.min() <= y <= ay.max())}
            got, want = got - edge, want - edge
        assert got == want
