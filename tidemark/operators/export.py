"""GeoJSON text in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import iso
from tidemark.operators.cases import status_value
from tidemark.operators.ordering import number_rows

POINT_SCHEMA = "type string, coordinates array<double>"
POLYGON_SCHEMA = "type string, coordinates array<array<array<double>>>"


def parse_point(text: Column) -> Column:
    """GeoJSON Point text to struct(lon, lat); bad text gives null."""
    g = F.from_json(text, POINT_SCHEMA)
    x, y = F.get(g["coordinates"], F.lit(0)), F.get(g["coordinates"], F.lit(1))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("lon"), y.alias("lat")))


def parse_polygon(text: Column) -> Column:
    """GeoJSON Polygon text to its outer ring; bad text gives null."""
    outer = F.get(F.from_json(text, POLYGON_SCHEMA)["coordinates"], F.lit(0))
    return F.transform(outer, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))


def point(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def line(points: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"),
                    F.transform(points, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))


def polygon(ring: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"),
                    F.array(F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates"))


def feature(geometry: Column, *properties: Column | str) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"),
                              F.struct(*properties).alias("properties")))


def spill_features(spills: DataFrame) -> DataFrame:
    """One Feature text per spill; needs the ring column."""
    return spills.select("spill_id", feature(
        polygon(F.col("ring")), F.lit(True).alias("spill_detected"), "confidence", "area_km2",
        point(F.col("lon"), F.col("lat")).alias("centroid"), "spill_id",
        iso(F.col("detected_at")).alias("detected_at"), status_value(F.col("status")).alias("status")).alias("feature"))


def particle_lines(paths: DataFrame, simulation_type: str = "BACKWARD") -> DataFrame:
    """One LineString Feature per particle; a path has as many points as the run has steps."""
    color = "#fb923c" if simulation_type == "BACKWARD" else "#38bdf8"
    pts = paths.groupBy("spill_id", "particle_id").agg(F.array_sort(F.collect_list(F.struct("ts", "lon", "lat"))).alias("p"))
    return pts.select("spill_id", "particle_id", feature(line(F.col("p")), "particle_id", F.lit(color).alias("color")).alias("feature"))


def _color(priority: Column) -> Column:
    return (F.when(priority == "HIGH", "#ef4444").when(priority == "MEDIUM", "#f59e0b")
            .when(priority == "LOW", "#38bdf8").otherwise("#94a3b8"))


def _radius(priority: Column) -> Column:
    return F.when(priority == "HIGH", 7.5).when(priority == "MEDIUM", 6.5).otherwise(5.5).cast("double")


def vessel_lines(parts: DataFrame, vessels: DataFrame) -> DataFrame:
    """LineString Features from track parts (two points or more) and vessels with priority."""
    v = vessels.select("vessel_id", "mmsi", "name", "priority")
    return (parts.filter(F.size("coordinates") > 1).join(v, "vessel_id")
            .select("vessel_id", "part", feature(line(F.col("coordinates")), "mmsi", "name", _color(F.col("priority")).alias("strokeColor"),
                                                 F.lit(1.8).cast("double").alias("lineWidth")).alias("feature")))


def vessel_points(last: DataFrame, vessels: DataFrame) -> DataFrame:
    """Point Feature of the newest report per ship."""
    v = vessels.select("vessel_id", "mmsi", "name", "ship_type", "priority")
    p = F.col("priority")
    return last.join(v, "vessel_id").select("vessel_id", feature(
        point(F.col("lon"), F.col("lat")), "mmsi", "name", "ship_type", "speed", _color(p).alias("color"),
        _radius(p).alias("radius"), "priority").alias("feature"))


def feature_lines(features: DataFrame, order: list[str]) -> DataFrame:
    """A FeatureCollection as text lines for ``write.text``: opening, one feature per line, closing.

    Lines carry their order, so the collection is never gathered into one value.
    """
    numbered = number_rows(features, [], F.pmod(F.xxhash64(*order), F.lit(4096)), [F.col(c) for c in order], out="line_no")
    body = numbered.select("line_no", F.when(F.col("line_no") == 1, F.col("feature"))
                           .otherwise(F.concat(F.lit(","), "feature")).alias("value"))
    head = features.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("line_no"), F.lit('{"type":"FeatureCollection","features":[').alias("value"))
    tail = features.sparkSession.range(1).select(F.lit(2 ** 62).cast("bigint").alias("line_no"), F.lit("]}").alias("value"))
    return head.unionByName(body).unionByName(tail).sort("line_no")
