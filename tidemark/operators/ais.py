"""Cleaning and lookup of ship position reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import lit_f, wrap360

# Accepted header names, in priority order.
ALIASES = {
    "mmsi": ("mmsi", "MMSI"),
    "lat": ("latitude", "lat", "LAT", "Latitude"),
    "lon": ("longitude", "lon", "LON", "Longitude"),
    "ts": ("timestamp", "time", "BaseDateTime", "TIMESTAMP"),
    "speed": ("speed", "sog", "SOG"),
    "course": ("course", "cog", "COG"),
    "heading": ("heading", "Heading"),
    "name": ("name", "vessel_name", "VesselName"),
    "ship_type": ("ship_type", "vessel_type", "VesselType"),
    "navigation_status": ("navigation_status", "Status"),
}

NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
PLAIN_TIME = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}:\d{1,2}Z?$"
DAY_FIRST = r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"
EPOCH = r"^\d+(\.\d+)?$"


@dataclass(frozen=True)
class CleanRules:
    """``per_record`` chooses the header for each record, as for JSON, and not for the table.

    There an absent coordinate reads as 0 and digits alone are epoch seconds; a field that is
    null cannot be told from one that is absent, nor a number from its text.
    """

    max_speed_kn: float = 50.0
    default_type: str = "Tanker"
    default_status: str = "Under way using engine"
    per_record: bool = False


def _headers(df: DataFrame, field: str, rules: CleanRules) -> list[str]:
    """Accepted headers that the input has: the first alone, or all where records choose."""
    found = [n for n in ALIASES[field] if n in df.columns]
    return found if rules.per_record else found[:1]


def _text(df: DataFrame, field: str, rules: CleanRules) -> Column:
    names = _headers(df, field, rules)
    return F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names]) if names else F.lit(None).cast("string")


def parse_number(x: Column) -> Column:
    """Text to DOUBLE, null when it is not a plain number (Java's 1.5f / 1.5d are not)."""
    return F.when(x.rlike(NUMBER), F.trim(x).try_cast("double"))


def _seconds(x: Column) -> Column:
    return F.when(x != 0, F.timestamp_micros((x.cast("double") * 1e6).cast("bigint")))


def parse_time(df: DataFrame, rules: CleanRules = CleanRules()) -> Column:
    """ISO-8601 or dd/MM/yyyy text, or epoch seconds; blank and 0 give null; naive is UTC."""
    def one(name: str) -> Column:
        kind, raw = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, T.NumericType):
            return _seconds(raw)
        if not isinstance(kind, T.StringType):
            return raw.cast("timestamp")
        t = F.trim(raw)
        # The cast wants seconds, and a colon inside the zone.
        full = F.regexp_replace(t, r"^(\S{10}[T ]\d{2}:\d{2})(?=$|[Z+-])", "$1:00")
        full = F.regexp_replace(full, r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2")
        out = (F.when(t.rlike(ISO_TIME), full.try_cast("timestamp"))
               .when(t.rlike(PLAIN_TIME), F.try_to_timestamp(F.translate(t, "TZ", " "), F.lit("yyyy-M-d H:m:s")))
               .when(t.rlike(DAY_FIRST), F.try_to_timestamp(t, F.lit("d/M/yyyy H:m:s"))))
        return out.when(t.rlike(EPOCH), _seconds(t.try_cast("double"))) if rules.per_record else out
    out = F.lit(None).cast("timestamp")
    for name in reversed(_headers(df, "ts", rules)):
        out = F.when(F.col(f"`{name}`").isNotNull(), one(name)).otherwise(out)
    return out


def audit_positions(raw: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """Every input row with its cleaned fields and ``reject_reason`` (null = accepted).

    All expressions are row-local, so batch and streaming input work alike.
    Columns that are not position fields (for example an ingest sequence) stay.
    """
    used = {n for f in ALIASES for n in _headers(raw, f, rules)}
    keep = [F.col(f"`{c}`") for c in raw.columns if c not in used and c not in ALIASES]
    def text(field: str) -> Column:
        return _text(raw, field, rules)
    mmsi = F.trim(F.coalesce(text("mmsi"), F.lit("")))

    def coordinate(field: str) -> Column:
        # A header that is absent altogether reads as 0; a present but unreadable value rejects.
        if rules.per_record:
            return F.when(text(field).isNull(), lit_f(0)).otherwise(parse_number(text(field)))
        return parse_number(text(field)) if _headers(raw, field, rules) else lit_f(0)

    step1 = raw.select(
        *keep,
        mmsi.alias("mmsi"), coordinate("lat").alias("lat"), coordinate("lon").alias("lon"),
        parse_time(raw, rules).alias("ts"),
        F.coalesce(parse_number(text("speed")), lit_f(0)).alias("speed"),
        F.coalesce(wrap360(parse_number(text("course"))), lit_f(0)).alias("course"),
        wrap360(parse_number(text("heading"))).alias("_heading"),
        F.trim(F.coalesce(text("name"), F.lit(""))).alias("_name"),
        F.trim(F.coalesce(text("ship_type"), F.lit(""))).alias("_type"),
        F.coalesce(text("navigation_status"), F.lit(
            "" if _headers(raw, "navigation_status", rules) and not rules.per_record else rules.default_status)).alias("navigation_status"),
    )
    lat, lon, speed = F.col("lat"), F.col("lon"), F.col("speed")
    bad_position = (lat.isNull() | lon.isNull() | ~lat.between(-90.0, 90.0) | ~lon.between(-180.0, 180.0)
                    | ((lat == 0) & (lon == 0)))
    # NaN sorts above every number in Spark, yet fails both range tests of the rule: keep it.
    bad_speed = ~F.isnan(speed) & ((speed < 0) | (speed > lit_f(rules.max_speed_kn)))
    reason = (F.when(~F.col("mmsi").rlike("^[0-9]{9}$"), "MMSI")
              .when(bad_position, "POSITION")
              .when(F.col("ts").isNull(), "TIMESTAMP")
              .when(bad_speed, "SPEED"))
    return step1.select(
        *keep, "mmsi",
        F.when(F.col("_name") != "", F.col("_name")).otherwise(F.concat(F.lit("VESSEL-"), "mmsi")).alias("name"),
        F.when(F.col("_type") != "", F.col("_type")).otherwise(F.lit(rules.default_type)).alias("ship_type"),
        "ts", "lat", "lon", "speed", "course",
        F.coalesce("_heading", "course").alias("heading"), "navigation_status",
        reason.alias("reject_reason"))


def clean_positions(raw: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """Accepted rows only.

    Rejected rows drop out through an empty ``explode``.  A filter on ``reject_reason``
    would be pushed below the parsing and repeat each parse for every test it appears in.
    """
    audited = audit_positions(raw, rules)
    names = [c for c in audited.columns if c != "reject_reason"]
    kept = F.when(F.col("reject_reason").isNull(), F.array(F.struct(*[F.col(f"`{c}`") for c in names])))
    return audited.select(F.explode(kept).alias("r")).select("r.*")


def with_ids(clean: DataFrame, seq: str | None = None) -> DataFrame:
    """Adds vessel_id, the ship's number, and position_id.

    The latter is ``seq`` if one is named, else a digest of the record, which only equal
    records share.  Both follow from the record alone: repeated runs give the same.
    """
    record = F.xxhash64("mmsi", "ts", "lat", "lon", "speed", "course", "heading", "navigation_status")
    return clean.withColumns({"vessel_id": F.col("mmsi").cast("bigint"), "position_id": record if seq is None else F.col(seq).cast("bigint")})


def new_vessels(clean: DataFrame, vessels: DataFrame, seq: str, flag: str = "India") -> DataFrame:
    """Vessels that the registry lacks; the first record of each (by ``seq``) names it.

    ``min_by`` combines before the shuffle, so a ship with a huge share of the rows
    reaches the reducer as one row per map task.
    """
    firsts = clean.groupBy("mmsi").agg(F.min_by(F.struct("name", "ship_type"), F.col(seq)).alias("v"))
    return (firsts.join(vessels.select("mmsi"), "mmsi", "left_anti")
            .select(F.col("mmsi").cast("bigint").alias("vessel_id"), "mmsi", "v.name", "v.ship_type", F.lit(flag).alias("flag")))


def import_summary(clean: DataFrame) -> DataFrame:
    """Record and vessel counts of one import."""
    return clean.agg(F.count("*").alias("imported_records"), F.count_distinct("mmsi").alias("vessels_updated"))


def join_vessels(positions: DataFrame, vessels: DataFrame) -> DataFrame:
    """Positions with registry attributes; the size of the registry decides the strategy."""
    return positions.drop("mmsi").join(vessels, "vessel_id")


def vessel_by_mmsi(vessels: DataFrame, mmsi: str) -> DataFrame:
    return vessels.filter(F.col("mmsi") == mmsi)


def vessels_page(vessels: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return vessels.orderBy("vessel_id").offset(offset).limit(limit)


def search_vessels(vessels: DataFrame, text: str) -> DataFrame:
    """Name or type holds the text in any case, or the MMSI holds it as typed."""
    low = text.lower()
    return vessels.filter(F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower("ship_type"), F.lit(low))
                          | F.contains("mmsi", F.lit(text)))


def track(positions: DataFrame, mmsi: str, start=None, end=None, limit: int = 1000) -> DataFrame:
    """Positions of one ship in time order; the interval is closed."""
    rows = positions.filter(F.col("mmsi") == mmsi)
    if start is not None:
        rows = rows.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return rows.orderBy("ts", "position_id").limit(limit)
