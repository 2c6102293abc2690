"""Track geometry and behaviour signals per ship."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import haversine_km
from tidemark.functions.scalar import angle_diff, fixed, hours_between, lit_f, rnd
from tidemark.operators.ordering import BUCKET, number_rows, time_bucket, with_next


@dataclass(frozen=True)
class SignalRules:
    cruise_kn: float = 8.0
    drop_ratio: float = 0.35
    turn_deg: float = 45.0
    loiter_kn: float = 3.5
    loiter_share: float = 0.5
    loiter_min_reports: int = 3
    gap_hours: float = 1.5
    origin_km: float = 30.0


STEP_COLUMNS = ("ts", "position_id", "lon", "lat", "speed", "course")


def steps(positions: DataFrame, bucket_seconds: int = 21_600) -> DataFrame:
    """Positions with the following report of the same ship, distance and time to it."""
    n = F.col("nxt")
    return (with_next(positions, STEP_COLUMNS, bucket_seconds=bucket_seconds)
            .withColumn("step_km", haversine_km(F.col("lat"), F.col("lon"), n["lat"], n["lon"]))
            .withColumn("gap_h", hours_between(n["ts"], F.col("ts"))))


def track_summary(positions: DataFrame) -> DataFrame:
    """Length, duration, mean speed, waypoint count and time span per ship."""
    agg = steps(positions).groupBy("vessel_id").agg(
        F.coalesce(F.sum("step_km"), lit_f(0)).alias("length_km"),
        F.count("*").alias("waypoints"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    hours = F.greatest(hours_between(F.col("end_time"), F.col("start_time")), lit_f(0.001))
    return (agg.withColumn("duration_h", hours)
            .withColumn("avg_kmh", F.col("length_km") / F.col("duration_h")))


def track_parts(positions: DataFrame, points_per_part: int = 1000, bucket_seconds: int = 21_600) -> DataFrame:
    """Ordered coordinates per ship in parts of bounded size.

    A track of up to ``points_per_part`` reports is one part; a longer one continues in
    part 1, 2, ... so no ship's whole history becomes one row or one task.
    """
    numbered = number_rows(positions, ["vessel_id"], time_bucket("ts", bucket_seconds),
                           [F.col("ts"), F.col("position_id")])
    point = F.struct("row_no", "lon", "lat")
    return (numbered.withColumn("part", F.floor((F.col("row_no") - 1) / F.lit(points_per_part)).cast("bigint"))
            .groupBy("vessel_id", "part").agg(F.array_sort(F.collect_list(point)).alias("p"))
            .select("vessel_id", "part", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))
                    .alias("coordinates")))


def step_flags(step_rows: DataFrame, origin: tuple[float, float] | None = None,
               rules: SignalRules = SignalRules()) -> DataFrame:
    """Per report pair: speed drop, sharp turn and gap flags."""
    n = F.col("nxt")
    if origin is None:
        dist, near = lit_f(0), F.lit(True)
    else:
        dist = haversine_km(lit_f(origin[0]), lit_f(origin[1]), F.col("lat"), F.col("lon"))
        near = F.col("origin_km") <= lit_f(rules.origin_km)
    s1, s2 = F.coalesce("speed", lit_f(0)), F.coalesce(n["speed"], lit_f(0))
    return (step_rows.withColumn("origin_km", dist)
            .withColumn("turn_deg", angle_diff(n["course"], F.col("course")))
            .withColumn("is_drop", n.isNotNull() & (s1 >= rules.cruise_kn) & (s2 <= lit_f(1 - rules.drop_ratio) * s1))
            .withColumn("is_turn", F.coalesce((F.col("turn_deg") >= rules.turn_deg) & near, F.lit(False)))
            .withColumn("is_gap", F.coalesce((F.col("gap_h") >= rules.gap_hours) & near, F.lit(False))))


def first_signals(flagged: DataFrame, rules: SignalRules = SignalRules()) -> DataFrame:
    """Per ship, in one pass: report counts, mean speed, and the first flagged pair of each kind."""
    n = F.col("nxt")

    def first(flag: str, *payload) -> Column:
        # min skips nulls, so unflagged rows take no part.
        return F.min(F.when(F.col(flag), F.struct("ts", "position_id", *payload)))
    return flagged.groupBy("vessel_id").agg(
        F.count("*").alias("reports"), F.count("speed").alias("speeds"), F.avg("speed").alias("mean_speed"), F.min("ts").alias("start"),
        F.count_if(F.col("speed") <= rules.loiter_kn).alias("slow"),
        first("is_drop", F.coalesce("speed", lit_f(0)).alias("s1"), F.coalesce(n["speed"], lit_f(0)).alias("s2"), n["ts"].alias("ts2")).alias("drop"),
        first("is_turn", "turn_deg", "origin_km", n["ts"].alias("ts2")).alias("turn"),
        first("is_gap", "gap_h", "origin_km").alias("gap"))


def _is_loitering(rules: SignalRules) -> Column:
    return ((F.col("reports") >= 2) & (F.col("speeds") >= rules.loiter_min_reports)
            & (F.col("slow") / F.nullif(F.col("speeds"), F.lit(0)) >= rules.loiter_share))


def anomaly_signals(flagged: DataFrame, origin: tuple[float, float] | None = None,
                    rules: SignalRules = SignalRules()) -> DataFrame:
    """First signal of each kind per ship, from :func:`step_flags` rows.

    Ships with fewer than two reports give no signal.  A drop needs a report at
    cruising speed, so the extra test on the ship's top speed adds nothing.
    """
    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def signal(found: Column, kind: str, severity: str, ts: Column, words: Column) -> Column:
        return F.when(found, F.struct(F.lit(kind).alias("signal_type"), F.lit(severity).alias("severity"),
                                      ts.alias("signal_ts"), words.alias("description")))
    d, t, g = F.col("drop"), F.col("turn"), F.col("gap")
    at_turn = text("(", fixed(t["origin_km"], 1), " km from estimated origin)") if origin else F.lit("")
    at_gap = text("within ", fixed(g["origin_km"], 1), " km of origin") if origin else F.lit("")
    # Kinds, severities and wording of the signals.
    found = F.array(
        signal(d.isNotNull(), "SUDDEN_SPEED_REDUCTION", "MEDIUM", d["ts2"], text(
            "Vessel decelerated sharply from ", fixed(d["s1"], 1), " kts to ", fixed(d["s2"], 1), " kts (",
            fixed((lit_f(1) - d["s2"] / d["s1"]) * lit_f(100), 0), "% reduction while underway).")),
        signal(_is_loitering(rules), "LOITERING_PATTERN", "LOW", F.col("start"), text(
            f"Vessel exhibited low-speed loitering / slow steaming (<{rules.loiter_kn} kts) across ", F.col("slow").cast("string"), " reports.")),
        signal(t.isNotNull(), "SHARP_COURSE_ALTERATION", "MEDIUM", t["ts2"], text(
            "Sharp course alteration of ", fixed(t["turn_deg"], 0), "° detected ", at_turn, ".")),
        signal(g.isNotNull(), "AIS_TRANSMISSION_GAP", "MEDIUM", g["ts"], text(
            "AIS blackout / transmission gap of ", fixed(g["gap_h"], 1), " hours detected ", at_gap, ".")))
    return (first_signals(flagged, rules).select("vessel_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("s"))
            .select("vessel_id", "s.*"))


def gap_until_first_flag(flagged: DataFrame) -> DataFrame:
    """Largest gap per ship over pairs up to and including the first flagged gap.

    Later gaps do not count.  Works inside time buckets first, then over the short
    list of buckets of each ship.
    """
    w = Window.partitionBy("vessel_id", BUCKET).orderBy("ts", "position_id")
    before = F.coalesce(F.max(F.col("is_gap").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_bucket = (flagged.withColumn("_hit", before).groupBy("vessel_id", BUCKET)
                  .agg(F.max(F.when(F.col("_hit") == 0, F.col("gap_h"))).alias("g"),
                       F.max(F.col("is_gap").cast("int")).alias("hit")))
    earlier = Window.partitionBy("vessel_id").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    open_buckets = per_bucket.withColumn("_done", F.coalesce(F.max("hit").over(earlier), F.lit(0))).filter("_done = 0")
    return open_buckets.groupBy("vessel_id").agg(F.coalesce(F.max("g"), lit_f(0)).alias("max_gap_h"))


def anomaly_summary(flagged: DataFrame, rules: SignalRules = SignalRules()) -> DataFrame:
    """One row per ship: number of signals, largest gap, mean speed, data note."""
    enough = F.col("reports") >= 2
    kinds = [F.col("drop").isNotNull(), F.coalesce(_is_loitering(rules), F.lit(False)), F.col("turn").isNotNull(), F.col("gap").isNotNull()]
    count = sum((k.cast("bigint") for k in kinds), F.lit(0).cast("bigint"))
    return (first_signals(flagged, rules).withColumn("_k", F.when(enough, count).otherwise(F.lit(0).cast("bigint")))
            .join(gap_until_first_flag(flagged), "vessel_id", "left")
            .select("vessel_id", "reports", (F.col("_k") > 0).alias("has_anomaly"), F.col("_k").alias("anomaly_count"),
                    F.when(enough, rnd(F.col("max_gap_h"), 2)).alias("max_gap_hours"),
                    F.when(enough, F.coalesce(rnd(F.col("mean_speed"), 1), lit_f(0))).alias("average_speed_knots"),
                    F.when(~enough, "Insufficient position reports to evaluate behavior.").alias("details")))


def last_position(positions: DataFrame) -> DataFrame:
    """Newest report per ship."""
    newest = F.max(F.struct("ts", "position_id", "lon", "lat", "speed", "course"))
    return positions.groupBy("vessel_id").agg(newest.alias("p")).select("vessel_id", "p.*")


def first_reports(positions: DataFrame, n: int = 1000) -> DataFrame:
    """The first ``n`` reports of every ship (per-ship page); limits apply before the shuffle."""
    rn = F.row_number().over(Window.partitionBy("vessel_id").orderBy("ts", "position_id"))
    return positions.withColumn("row_no", rn).filter(F.col("row_no") <= n)
