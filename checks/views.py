"""Domain tables derived from the given tables by arithmetic both engines share.

The templates hold placeholders for the few spellings that differ; ``spark_view`` and
``sql_views`` fill them for Spark and for the checking engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.geo import box_ring
from tidemark.functions.scalar import lit_f

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations")

SPARK = {"[STR]": "STRING", "[TSUS]": "timestamp_micros", "[US]": "unix_micros(CAST(ts AS TIMESTAMP))", "[DIV]": "DIV",
         "[ISO]": "concat(date_format(ts,'yyyy-MM-dd'),'T',date_format(ts,'HH:mm:ss'))",
         "[SPACED]": "date_format(ts,'yyyy-MM-dd HH:mm:ss')", "[DAYFIRST]": "date_format(ts,'dd/MM/yyyy HH:mm:ss')",
         "[ODATE]": "CAST(o_orderdate AS TIMESTAMP)", "[SDATE]": "CAST(l_shipdate AS TIMESTAMP)",
         "[SDATE_US]": "unix_micros(CAST(l_shipdate AS TIMESTAMP))"}
DUCK = {"[STR]": "VARCHAR", "[TSUS]": "make_timestamp", "[US]": "epoch_us(ts)", "[DIV]": "//",
        "[ISO]": "strftime(ts,'%Y-%m-%dT%H:%M:%S')", "[SPACED]": "strftime(ts,'%Y-%m-%d %H:%M:%S')",
        "[DAYFIRST]": "strftime(ts,'%d/%m/%Y %H:%M:%S')", "[ODATE]": "o_orderdate", "[SDATE]": "l_shipdate",
        "[SDATE_US]": "epoch_us(l_shipdate)"}

# Centre of spill {k}; also the forcing cell and the middle of the simulated origin.
CENTRE = ("71.0E0 + CAST(({k}*97) % 300 AS DOUBLE)/100 + 0.05E0", "17.5E0 + CAST(({k}*61) % 300 AS DOUBLE)/100 + 0.05E0")

TEMPLATES = {
    "ais": """SELECT event_id AS position_id, user_id AS vessel_id, CAST(419000000 + user_id AS [STR]) AS mmsi,
 [TSUS](1704067200000000 + ([US] - 1704067200000000) [DIV] 40) AS ts,
 71.0E0 + CAST((user_id*37) % 300 AS DOUBLE)/100 + CAST((event_id*11) % 100 AS DOUBLE)/1000 AS lon,
 17.5E0 + CAST((user_id*53) % 300 AS DOUBLE)/100 + CAST((event_id*7) % 100 AS DOUBLE)/1000 AS lat,
 CASE WHEN event_type='error' THEN NULL WHEN user_id % 3 = 0 THEN 10.0E0 + CAST(event_id % 30 AS DOUBLE)/10
  ELSE CAST(CAST(round(value*100) AS BIGINT) % 2200 AS DOUBLE)/100 END AS speed,
 CASE WHEN event_type='signup' THEN NULL ELSE CAST((event_id*37) % 360 AS DOUBLE) END AS course
 FROM {events}""",
    "vessels": """SELECT u.vessel_id, CAST(419000000 + u.vessel_id AS [STR]) AS mmsi, c.c_name AS name, c.c_mktsegment AS ship_type, n.n_name AS flag
 FROM (SELECT DISTINCT user_id AS vessel_id FROM {events}) u LEFT JOIN {customer} c ON c.c_custkey = u.vessel_id + 1
 LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey""",
    "spills": f"""SELECT s_suppkey AS spill_id, s_suppkey*200 AS satellite_image_id,
 [TSUS](1704088800000000 + CAST((s_suppkey*7) % 72 AS BIGINT)*900000000) AS detected_at,
 {CENTRE[0].format(k='s_suppkey')} AS lon, {CENTRE[1].format(k='s_suppkey')} AS lat,
 0.5E0 + CAST(s_suppkey % 50 AS DOUBLE)/100 AS confidence, abs(s_acctbal)/500 AS area_km2, abs(s_acctbal)/100 AS perimeter_km,
 1.0E0 + CAST(s_suppkey % 12 AS DOUBLE) AS elongation,
 CASE s_suppkey % 4 WHEN 0 THEN 'DETECTED' WHEN 1 THEN 'ACCEPTED' WHEN 2 THEN 'REJECTED' ELSE 'REVIEW_REQUIRED' END AS status
 FROM {{supplier}}""",
    "scenes": """SELECT o_orderkey AS scene_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Sentinel-1B' ELSE 'Sentinel-1A' END AS satellite,
 [ODATE] AS acquisition_time, CASE o_orderstatus WHEN 'F' THEN 'VV' WHEN 'O' THEN 'VV+VH' ELSE 'VH' END AS polarization FROM {orders}""",
    "catalogue": """SELECT CAST(o_orderkey AS [STR]) AS acquisition_id, CASE WHEN o_orderkey % 3 = 0 THEN 'S1B_IW_GRDH' WHEN o_orderkey % 3 = 1 THEN 'S1A_IW_GRDH' ELSE 'S1_IW' END AS product_id,
 [ODATE] AS acquisition_time, CASE o_orderstatus WHEN 'F' THEN 'VV' WHEN 'O' THEN 'VV+VH' ELSE 'VH' END AS polarization,
 CASE WHEN o_custkey % 2 = 0 THEN 'ASCENDING' ELSE 'DESCENDING' END AS orbit_direction,
 70.0E0 + CAST(o_custkey % 50 AS DOUBLE)/10 AS min_lon, 16.0E0 + CAST(o_orderkey % 50 AS DOUBLE)/10 AS min_lat,
 71.0E0 + CAST(o_custkey % 50 AS DOUBLE)/10 AS max_lon, 17.0E0 + CAST(o_orderkey % 50 AS DOUBLE)/10 AS max_lat FROM {orders}""",
    "images": """SELECT doc_id AS scene_id, concat('scene_', CAST(doc_id AS [STR])) AS basename, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split,
 256 AS h, CASE WHEN doc_id % 97 = 0 THEN 128 ELSE 256 END AS w, source = 'src3' AND doc_id % 5 = 0 AS has_nan, doc_id % 89 = 0 AS has_inf FROM {documents}
 UNION ALL SELECT doc_id, concat('scene_', CAST(doc_id AS [STR])), 'val', 256, 256, false, false FROM {labels} WHERE toxic = 1 AND doc_id % 10 < 7""",
    "masks": """SELECT k AS scene_id, concat('scene_', CAST(k AS [STR])) AS basename, CASE WHEN k % 10 < 7 THEN 'train' WHEN k % 10 < 9 THEN 'val' ELSE 'test' END AS split,
 256 AS h, 256 AS w, k % 83 = 0 AS has_nan, false AS has_inf, k % 7 <> 0 AS is_binary
 FROM (SELECT doc_id AS k FROM {labels} UNION SELECT conv_id*20 AS k FROM {conversations})""",
    "paths": """SELECT concat('s3/in/', CASE WHEN doc_id % 3 = 0 THEN 'a/' ELSE '' END, CASE WHEN doc_id % 11 = 0 THEN 'Sc.' ELSE 'scene_' END, CAST(doc_id [DIV] 2 AS [STR]), CASE WHEN doc_id % 13 = 0 THEN '_mask' ELSE '' END,
 CASE doc_id % 5 WHEN 0 THEN '.npy' WHEN 1 THEN '.png' WHEN 2 THEN '.TIF' WHEN 3 THEN '.webp' ELSE '.txt' END) AS path,
 CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n_chars * 20000 END AS length FROM {documents}""",
    "mask_paths": """SELECT concat('s3/gt/', CASE WHEN doc_id % 22 = 0 THEN 'Sc.' ELSE 'scene_' END, CAST(doc_id [DIV] 2 AS [STR]),
 CASE (doc_id + quality) % 6 WHEN 0 THEN '.tif' WHEN 1 THEN '_mask.png' WHEN 2 THEN '.npy' WHEN 3 THEN '_gt.png' WHEN 4 THEN '_label.png' ELSE '.png' END) AS path FROM {labels}""",
    "raw_ais": """SELECT event_id AS ingest_seq, CASE WHEN event_id % 50 = 7 THEN '123' ELSE CAST(419000000 + user_id AS [STR]) END AS mmsi,
 CASE WHEN event_id % 53 = 0 THEN '95.0' WHEN event_id % 59 = 0 THEN '0' ELSE concat('18.', lpad(CAST((user_id*53 + event_id*7) % 1000 AS [STR]), 3, '0')) END AS latitude,
 CASE WHEN event_id % 59 = 0 THEN '0' ELSE concat('72.', lpad(CAST((user_id*37 + event_id*11) % 1000 AS [STR]), 3, '0')) END AS longitude,
 CASE WHEN event_id % 61 = 0 THEN '120.0' WHEN event_id % 67 = 0 THEN '' ELSE concat(CAST(event_id % 22 AS [STR]), '.', CAST(event_id % 10 AS [STR])) END AS speed,
 CASE WHEN event_id % 71 = 0 THEN 'n/a' ELSE CAST((event_id*37) % 720 - 180 AS [STR]) END AS course,
 CASE WHEN event_id % 73 = 0 THEN 'yesterday' WHEN event_id % 3 = 0 THEN concat([ISO], 'Z') WHEN event_id % 3 = 1 THEN [SPACED] ELSE [DAYFIRST] END AS timestamp,
 CASE WHEN event_type = 'view' THEN ' ' ELSE concat('MV ', CAST(user_id AS [STR])) END AS name FROM {events}""",
    "forcing": f"""SELECT cell_lat, cell_lon, hour, max(wind_kmh) AS wind_kmh, max(wind_dir) AS wind_dir, max(current_kmh) AS current_kmh, max(current_dir) AS current_dir
 FROM (SELECT {CENTRE[1].format(k='l_suppkey')} AS cell_lat, {CENTRE[0].format(k='l_suppkey')} AS cell_lon,
  [TSUS](1703980800000000 + CAST((l_orderkey*13 + l_partkey*29) % 400 AS BIGINT)*3600000000) AS hour,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS wind_kmh, CAST((l_partkey*7) % 360 AS DOUBLE) AS wind_dir,
  CASE WHEN l_linestatus = 'O' THEN NULL ELSE 0.5E0 + l_discount*20 END AS current_kmh, CAST((l_orderkey*11) % 360 AS DOUBLE) AS current_dir
  FROM {{lineitem}}) x GROUP BY cell_lat, cell_lon, hour""",
    "simulations": f"""SELECT o_orderkey AS simulation_id, o_custkey AS spill_id, CASE WHEN o_orderstatus = 'F' THEN 'BACKWARD' ELSE 'FORWARD' END AS simulation_type,
 [TSUS](1704067200000000 + CAST((o_orderkey*7) % 72 AS BIGINT)*900000000) AS start_time, [ODATE] AS created_at, 12.0E0 AS duration_hours,
 100 + o_orderkey % 100 AS particle_count, 0.5E0 + CAST(o_orderkey % 50 AS DOUBLE)/100 AS confidence,
 {CENTRE[0].format(k='o_custkey')} AS mid_lon, {CENTRE[1].format(k='o_custkey')} AS mid_lat,
 CASE WHEN o_orderkey % 2 = 0 THEN 0.0205E0 ELSE 0.0E0 END AS buffer_deg FROM {{orders}}""",
    "case_log": """SELECT o_orderkey AS change_id, o_custkey AS spill_id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'NEW' WHEN 2 THEN 'UNDER_REVIEW' WHEN 3 THEN 'HIGH PRIORITY' ELSE 'RESOLVED' END AS status,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS notes, [ODATE] AS updated_at FROM {orders}""",
    "spill_log": """SELECT ((l_orderkey*10 + l_linenumber)*100000 + l_partkey)*1000 + l_suppkey AS change_id, l_suppkey AS spill_id, CASE l_returnflag WHEN 'A' THEN 'ACCEPTED' WHEN 'R' THEN 'REJECTED' END AS status,
 CASE WHEN l_linestatus = 'F' THEN l_discount*5 + 0.25E0 END AS confidence, [SDATE] AS updated_at FROM {lineitem}""",
    "candidates": """SELECT l_suppkey AS spill_id, l_partkey AS vessel_id, max(l_quantity)*2 AS overall_score, max(l_linenumber)*10.0E0 AS spatial_score,
 max(l_tax)*1000 AS temporal_score, CASE WHEN max(l_quantity)*2 >= 80 THEN 'HIGH' WHEN max(l_quantity)*2 >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS priority
 FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    "particles": """SELECT l_orderkey AS simulation_id, CAST(l_linenumber AS BIGINT) AS particle_id, [SDATE] AS ts,
 71.0E0 + CAST(l_partkey % 300 AS DOUBLE)/100 AS lon, 17.5E0 + CAST(l_suppkey % 300 AS DOUBLE)/100 AS lat FROM {lineitem}""",
    "detections": """SELECT l_orderkey*10 + l_linenumber AS detection_id, l_suppkey AS spill_id, 'contrast' AS model_name, l_discount*10 AS confidence, [SDATE] AS created_at FROM {lineitem}""",
    "pixels": {
        "spark": """SELECT CAST(vec_id DIV 64 AS BIGINT) AS scene_id, CAST(vec_id % 64 AS BIGINT) AS row, CAST(p.pos AS BIGINT) AS col,
 0.5D + CAST(p.e AS DOUBLE) AS value, CAST((vec_id + p.pos) % 5 = 0 AS INT) AS truth FROM {embeddings} LATERAL VIEW posexplode(embedding) p AS pos, e""",
        "duck": """SELECT vec_id // 64 AS scene_id, vec_id % 64 AS row, pos - 1 AS col, 0.5E0 + CAST(embedding[pos] AS DOUBLE) AS value,
 CAST((vec_id + pos - 1) % 5 = 0 AS INT) AS truth FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM {embeddings})"""},
}


def _fill(text: str, spelling: dict[str, str]) -> str:
    for k, v in spelling.items():
        text = text.replace(k, v)
    return text


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = TEMPLATES[name]
    text = _fill(text["spark"] if isinstance(text, dict) else text, SPARK)
    used = [t for t in BASE if "{" + t + "}" in text]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def sql_views(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` over the registered base tables."""
    out = []
    for n in names:
        text = TEMPLATES[n]
        text = _fill(text["duck"] if isinstance(text, dict) else text, DUCK)
        for t in BASE:
            text = text.replace("{" + t + "}", t)
        out.append(f"{n} AS ({text})")
    return "WITH " + ",\n".join(out)


class Views:
    """Lazily opened domain tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TEMPLATES:
            raise AttributeError(name)
        df = spark_view(self.spark, self.sf_dir, name)
        self.__dict__[name] = df
        return df

    @cached_property
    def ringed_spills(self) -> DataFrame:
        h = lit_f(0.05)
        return self.spills.withColumn("ring", box_ring(F.col("lon") - h, F.col("lat") - h, F.col("lon") + h, F.col("lat") + h))

    @cached_property
    def ringed_simulations(self) -> DataFrame:
        h, x, y = lit_f(0.04), F.col("mid_lon"), F.col("mid_lat")
        return self.simulations.withColumn("ring", box_ring(x - h, y - h, x + h, y + h))

    @cached_property
    def scene_ext(self) -> DataFrame:
        """Format and wind per scene, from the label of its first line."""
        e = self.spark.read.parquet(f"{self.sf_dir}/embeddings.parquet")
        return (e.groupBy(F.expr("CAST(vec_id DIV 64 AS BIGINT)").alias("scene_id"))
                .agg(F.min_by("label", "vec_id").alias("l"))
                .select("scene_id", F.when(F.col("l") % 3 == 0, ".npy").when(F.col("l") % 3 == 1, ".png").otherwise(".tif").alias("ext"),
                        (F.col("l") * lit_f(1.9)).alias("wind_mps")))


SCENE_EXT_SQL = """scene_ext AS (SELECT vec_id // 64 AS scene_id, CASE WHEN arg_min(label, vec_id) % 3 = 0 THEN '.npy' WHEN arg_min(label, vec_id) % 3 = 1 THEN '.png' ELSE '.tif' END AS ext,
 arg_min(label, vec_id) * 1.9E0 AS wind_mps FROM embeddings GROUP BY 1)"""
