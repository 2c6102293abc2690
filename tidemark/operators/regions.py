"""Points in regions with any number of vertices, each point told from the edges in its own small cell.

Whether a point is inside is whether a line eastwards crosses an odd number of edges.  That number
differs from the one of the north-east corner of the point's cell only by edges that pass through
the cell, and the corners' numbers are running totals along each line of the grid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import lit_f
from tidemark.sources.scratch import cut_lineage

MARGIN = 1e-9  # degrees; more than rounding moves a crossing
ENDS = ("ax", "ay", "bx", "by")


def ring_edges(vertices: DataFrame, ring: str = "ring_id") -> DataFrame:
    """(ring, ax, ay, bx, by) of rings given as rows (ring, seq, lon, lat), seq from 1 without gaps; the last vertex is joined to the first."""
    sizes = vertices.groupBy(ring).agg(F.count("*").alias("_n"))
    begin = vertices.join(sizes, ring).select(ring, (F.col("seq") % F.col("_n") + 1).alias("seq"), F.col("lon").alias("ax"), F.col("lat").alias("ay"))
    return begin.join(vertices.select(ring, "seq", F.col("lon").alias("bx"), F.col("lat").alias("by")), [ring, "seq"]).drop("seq")


def ring_facts(edges: DataFrame, ring: str = "ring_id") -> DataFrame:
    """(ring, bounds, slab height): as many slabs as let all edges together be listed about twice.

    Edges that go up and down the whole ring many times need few slabs, short ones many.
    """
    low, high = F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1")
    facts = edges.groupBy(ring).agg(low, high, F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"),
                                    F.count("*").alias("_n"), F.sum(F.abs(F.col("by") - F.col("ay"))).alias("_rise"))
    tall = F.col("y1") - F.col("y0")
    slabs = F.ceil(F.col("_n") * tall / F.greatest(F.col("_rise"), tall * 2))
    return facts.withColumn("height", F.when(tall > 0, tall / slabs).otherwise(lit_f(1))).drop("_n", "_rise")


def _slab(lat: Column) -> Column:
    return F.floor((lat - F.col("y0")) / F.col("height"))


def _meets(lat: Column) -> Column:
    """Where the edge's line has a latitude; null for level edges."""
    ax, ay, bx, by = (F.col(c) for c in ENDS)
    return (bx - ax) * (lat - ay) / F.nullif(by - ay, lit_f(0)) + ax


def crossing(lon: Column, lat: Column) -> Column:
    """Whether a line from the point eastwards crosses the edge."""
    return ((F.col("ay") > lat) != (F.col("by") > lat)) & (lon < _meets(lat))


def touching(lon: Column, lat: Column) -> Column:
    """Whether the point lies on the edge."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    aside = (bx - ax) * (lat - ay) - (by - ay) * (lon - ax)
    return (aside == 0) & lon.between(F.least(ax, bx), F.greatest(ax, bx)) & lat.between(F.least(ay, by), F.greatest(ay, by))


def square_distance(lon: Column, lat: Column) -> Column:
    """Squared planar distance (degrees) from the point to the edge."""
    ax, ay = F.col("ax"), F.col("ay")
    dx, dy = F.col("bx") - ax, F.col("by") - ay
    t = ((lon - ax) * dx + (lat - ay) * dy) / F.nullif(dx * dx + dy * dy, lit_f(0))
    along = F.coalesce(F.greatest(lit_f(0), F.least(lit_f(1), t)), lit_f(0))
    ex, ey = lon - (ax + along * dx), lat - (ay + along * dy)
    return ex * ex + ey * ey


def _odd(*parts: Column) -> Column:
    """Whether an odd number of conditions holds."""
    return reduce(lambda x, y: x != y, parts)


def _cell(x: Column, step: str = "step") -> Column:
    return F.floor(x / F.col(step))


def _beyond(cell: str) -> Column:
    """The east or north side of a cell."""
    return (F.col(cell) + 1) * F.col("step")


def open_ends(edges: DataFrame, grid: DataFrame, ring: str) -> DataFrame:
    """Level lines from the ends that a missing vertex leaves open to the west of the ring.

    The line eastwards crosses no level line; they only close the ring for :func:`turns`.
    """
    begun, ended = F.col("ax").isNotNull() & F.col("ay").isNotNull(), F.col("bx").isNotNull() & F.col("by").isNotNull()
    x, y = (F.when(begun, F.col(f"a{c}")).otherwise(F.col(f"b{c}")) for c in "xy")
    return edges.filter(begun != ended).join(grid, ring).select(
        ring, x.alias("ax"), y.alias("ay"), (F.col("x0") - F.col("buffer") - F.col("step")).alias("bx"), y.alias("by"), "step", F.lit(False).alias("real"))


def cell_edges(edges: DataFrame, ring: str, step: str = "step", reach: Column | None = None) -> DataFrame:
    """``edges`` (with ``step``) listed under the cells (cx, cy) that they pass, or come within ``reach`` of."""
    away = lit_f(MARGIN) if reach is None else reach + lit_f(MARGIN)
    ax, ay, bx, by = (F.col(c) for c in ENDS)
    low, high, west, east = F.least(ay, by), F.greatest(ay, by), F.least(ax, bx), F.greatest(ax, bx)
    rows = edges.withColumn("cy", F.explode(F.sequence(_cell(low - away, step), _cell(high + away, step))))

    def at(lat: Column) -> Column:
        return _meets(F.least(high, F.greatest(low, lat)))
    one, two = at(F.col("cy") * F.col(step) - away), at((F.col("cy") + 1) * F.col(step) + away)
    level = ay == by
    first = F.when(level, west).otherwise(F.greatest(west, F.least(east, one, two)))
    last = F.when(level, east).otherwise(F.least(east, F.greatest(west, one, two)))
    return rows.withColumn("cx", F.explode(F.sequence(_cell(first - away, step), _cell(last + away, step))))


def turns(lon: Column, lat: Column) -> Column:
    """Whether the edge changes the oddness of crossings between the point and its cell's north-east corner.

    Over all edges of closed rings these add up to the difference exactly, whatever the rounding: ends of
    edges east of the corner and between both latitudes occur twice.  It is false for edges that do not pass the cell.
    """
    x, y = _beyond("cx"), _beyond("cy")

    def between(end: str) -> Column:
        return (F.col(f"{end}x") > x) & ((F.col(f"{end}y") > lat) != (F.col(f"{end}y") > y))
    return _odd(F.coalesce(crossing(lon, lat), F.lit(False)), F.coalesce(crossing(x, y), F.lit(False)), between("a"), between("b"))


def corner_crossings(edges: DataFrame, cells: DataFrame, ring: str) -> DataFrame:
    """(ring, cx, cy, crossed): crossings of the line eastwards from the north-east corner of each of the ``cells``."""
    low, high = _cell(F.least("ay", "by")), _cell(F.greatest("ay", "by"))
    lines = edges.withColumn("cy", F.explode(F.sequence(low - 1, high + 1)))
    y = _beyond("cy")
    met = lines.filter((F.col("ay") > y) != (F.col("by") > y)).select(ring, "cy", "step", _meets(y).alias("x"))
    near = _cell(F.col("x")) - 1

    def west_of(cell: Column) -> Column:
        return (cell + 1) * F.col("step") < F.col("x")
    last = F.when(west_of(near + 1), near + 1).when(west_of(near), near).otherwise(near - 1)
    counts = met.groupBy(ring, "cy", last.alias("cx")).agg(F.count("*").alias("n"))
    both = counts.withColumn("asked", F.lit(False)).unionByName(cells.select(ring, "cy", "cx", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    east = Window.partitionBy(ring, "cy").orderBy(F.col("cx").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("crossed", F.sum("n").over(east)).filter("asked").select(ring, "cx", "cy", "crossed")


def cell_grid(facts: DataFrame, places: DataFrame, ring: str) -> DataFrame:
    """``facts`` with the ``step`` of each ring's grid: about as many cells as places.

    Of n edges of length l and p places in a unit square, cells of size s list n * l / s edges and compare
    p * n * l * s pairs; both are least together at one place a cell.
    """
    wide, tall = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    counts = places.groupBy(ring).agg(F.count("*").alias("_places"))
    step = F.greatest(F.sqrt(wide * tall / F.col("_places")), (wide + tall) / F.col("_places"), F.greatest(wide, tall) / lit_f(1e6), lit_f(1e-6))
    return facts.join(counts, ring).withColumn("step", step).drop("_places", "height")


def points_in_regions(points: DataFrame, vertices: DataFrame, buffers: DataFrame | None = None, *, point: str = "position_id", ring: str = "ring_id",
                      cell_deg: float = 0.25) -> DataFrame:
    """Pairs (point, ring) of the points (point, lon, lat) inside a ring or within its buffer.

    ``vertices`` has rows (ring, seq, lon, lat); ``buffers`` (ring, buffer_deg) grows rings by a planar distance.
    The boundary itself is outside unless there is a buffer.  A point meets the rings whose
    bounds hold it on a grid of cells.  Each different place then meets the edges that pass its cell on
    the ring's own finer grid; only places without an edge near them there look for one in the cells around.
    No row or task holds a ring.  Runs actions.
    """
    edges = cut_lineage(ring_edges(vertices, ring))
    facts = ring_facts(edges, ring)
    facts = (facts.withColumn("buffer", lit_f(0)) if buffers is None else
             facts.join(buffers.select(ring, F.coalesce("buffer_deg", lit_f(0)).alias("buffer")), ring, "left").fillna(0.0, ["buffer"]))
    facts = cut_lineage(facts)

    def cell(x: Column) -> Column:
        return F.floor(x / lit_f(cell_deg)).cast("int")

    def cells(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(cell(low), cell(high)))
    grow = F.col("buffer")
    bounds = {"x0": F.col("x0") - grow, "x1": F.col("x1") + grow}
    listed = (facts.withColumns(bounds).withColumn("_x", cells(F.col("x0"), F.col("x1"))).withColumn("_y", cells(F.col("y0") - grow, F.col("y1") + grow)))
    lon, lat = F.col("lon"), F.col("lat")
    inside_bounds = lon.between(F.col("x0"), F.col("x1")) & lat.between(F.col("y0") - grow, F.col("y1") + grow)
    met = cut_lineage(points.select(point, "lon", "lat", cell(lon).alias("_x"), cell(lat).alias("_y")).join(listed, ["_x", "_y"]).filter(inside_bounds)
                      .select(point, ring, "lon", "lat"))
    place = [ring, "lon", "lat"]
    different = cut_lineage(met.select(*place).distinct())
    grid = cut_lineage(cell_grid(facts, different, ring))
    places = cut_lineage(different.join(grid.select(ring, "buffer", "step"), ring).withColumns({"cx": _cell(lon), "cy": _cell(lat)}))
    whole = edges.dropna(subset=list(ENDS)).join(grid.select(ring, "step"), ring).withColumn("real", F.lit(True))
    pairs = places.join(cell_edges(whole.unionByName(open_ends(edges, grid, ring)), ring).drop("step"), [ring, "cx", "cy"])
    real = F.col("real")
    by_edges = pairs.groupBy(*place).agg(
        F.sum(turns(lon, lat).cast("long")).alias("crossed"), F.bool_or(real & touching(lon, lat)).alias("touched"),
        F.bool_or(real & (grow > 0) & (square_distance(lon, lat) < grow * grow)).alias("near"))
    corners = corner_crossings(whole, places.select(ring, "cx", "cy").distinct(), ring)
    by_corner = places.join(corners, [ring, "cx", "cy"]).select(*place, "crossed", F.lit(False).alias("touched"), F.lit(False).alias("near"))
    told = by_edges.unionByName(by_corner).groupBy(*place).agg(F.sum("crossed").alias("crossed"), F.bool_or("touched").alias("touched"), F.bool_or("near").alias("near"))
    if buffers is not None:
        told = cut_lineage(told)
        wide = grid.filter("buffer > 0").select(ring, "buffer", F.greatest(F.col("step"), grow * 2).alias("wide"))
        left = cut_lineage(told.filter("NOT near").select(*place).join(wide, ring).withColumns({"cx": _cell(lon, "wide"), "cy": _cell(lat, "wide")}))
        around = cell_edges(whole.drop("step").join(wide, ring), ring, "wide", grow).select(ring, "cx", "cy", *ENDS)
        found = left.join(around, [ring, "cx", "cy"]).groupBy(*place).agg(F.bool_or(square_distance(lon, lat) < grow * grow).alias("found"))
        told = told.join(found, place, "left").withColumn("near", F.col("near") | F.coalesce("found", F.lit(False)))
    # A point that has several rows counts them together.
    joined = met.join(told, place).groupBy(point, ring).agg(
        F.sum(F.col("crossed") % 2).alias("crossed"), F.bool_or("touched").alias("touched"), F.bool_or("near").alias("near"))
    return joined.filter(((F.col("crossed") % 2 == 1) & ~F.col("touched")) | F.col("near")).select(point, ring)
