"""Dataset, case and export queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.origin import CALM, drift_sql
from checks.radar import DIMS, FULL, PX, _tile_counts, big
from checks.registry import query
from checks.ships import us
from checks.sql import FIX, R
from checks.views import Views, sql_views
from tidemark.functions import geo
from tidemark.functions.scalar import fixed
from tidemark.operators import cases, dataset, drift, export, tracks
from tidemark.sources.rasters import write_report
from tidemark.sources.scratch import new_path

# --- files and datasets ------------------------------------------------------

NAME = "regexp_extract(path, '([^/]+)$', 1)"
EXT = f"lower(regexp_extract({NAME}, '.(\\.[^.]*)$', 1))"
BASENAME = f"regexp_replace({NAME}, '\\.[^.]*$', '')"
FORMATS = "('.tif', '.tiff', '.png', '.jpg', '.jpeg', '.npy', '.webp')"


@query(sql_views("paths") + f"SELECT path, length, CASE WHEN {EXT} NOT IN {FORMATS} THEN 'UNSUPPORTED_FORMAT' WHEN length > 52428800 THEN 'TOO_LARGE' WHEN length = 0 THEN 'EMPTY' END AS reject_reason FROM paths")
def file_intake(v: Views) -> DataFrame:
    return dataset.intake_check(v.paths)


@query(sql_views("paths") + f""", t AS (SELECT *, {EXT} AS ext, {BASENAME} AS basename, regexp_extract(path, '^(.*/)?[^/]+$', 1) AS folder FROM paths)
SELECT * EXCLUDE (folder) FROM t WHERE ext IN {FORMATS} AND NOT (ext = '.png' AND (folder, basename) IN (SELECT (folder, basename) FROM t WHERE ext = '.npy'))""")
def raster_file_list(v: Views) -> DataFrame:
    return dataset.prefer_arrays(v.paths)


@query(sql_views("paths", "mask_paths") + f""", i AS (SELECT DISTINCT path AS image_path, {BASENAME} AS scene FROM paths WHERE {EXT} IN ('.tif', '.tiff', '.png', '.jpg', '.jpeg', '.npy')
  AND NOT regexp_matches(lower({NAME}), '_mask|-mask|_label|-label|_gt')),
e AS (SELECT unnest(['.tif', '.tiff', '.png', '.npy', '_mask.png', '_mask.tif', '_label.png', '_gt.png']) AS ending, unnest(range(0, 8)) AS pr),
h AS (SELECT scene, image_path, path AS mask_path, row_number() OVER (PARTITION BY image_path ORDER BY pr) AS rn FROM i, e JOIN (SELECT DISTINCT path FROM mask_paths) m ON m.path = 's3/gt/' || scene || ending)
SELECT scene, image_path, mask_path FROM h WHERE rn = 1""")
def scene_mask_pairs(v: Views) -> DataFrame:
    return dataset.pair_scene_mask(v.paths, v.mask_paths)


IM = sql_views("images", "masks")


@query(IM + "SELECT split, basename FROM images ANTI JOIN masks USING (split, basename)")
def images_without_mask(v: Views) -> DataFrame:
    return dataset.missing_masks(v.images, v.masks).select("split", "basename")


@query(IM + "SELECT split, basename FROM masks ANTI JOIN images USING (split, basename)")
def masks_without_image(v: Views) -> DataFrame:
    return dataset.orphan_masks(v.images, v.masks).select("split", "basename")


@query(IM + "SELECT split, basename, i.w, m.w AS mask_w FROM images i JOIN masks m USING (split, basename) WHERE i.h <> m.h OR i.w <> m.w")
def size_mismatches(v: Views) -> DataFrame:
    return dataset.size_mismatches(v.images, v.masks).select("split", "basename", "w", "mask_w")


LEAK = """, lk AS (SELECT DISTINCT a.basename, a.split || '-' || b.split AS pair FROM images a JOIN images b ON a.basename = b.basename
 AND (a.split, b.split) IN (('train', 'val'), ('train', 'test'), ('val', 'test')))"""


@query(sql_views("images") + LEAK + "SELECT * FROM lk")
def leaked_scenes(v: Views) -> DataFrame:
    return dataset.leaked_names(v.images)


FIND = """, pr AS (SELECT split, basename, i.has_nan OR i.has_inf AS bi, m.has_nan OR m.has_inf AS bm, i.h <> m.h OR i.w <> m.w AS sz, is_binary FROM images i JOIN masks m USING (split, basename)),
fi AS (SELECT split, 'ERROR' AS level, 'MISSING_MASK' AS kind, basename FROM images ANTI JOIN masks USING (split, basename) UNION ALL SELECT split, 'WARNING', 'ORPHAN_MASK', basename FROM masks ANTI JOIN images USING (split, basename)
 UNION ALL SELECT split, 'ERROR', 'BAD_IMAGE_VALUES', basename FROM pr WHERE bi UNION ALL SELECT split, 'ERROR', 'BAD_MASK_VALUES', basename FROM pr WHERE NOT bi AND bm
 UNION ALL SELECT split, 'ERROR', 'SIZE_MISMATCH', basename FROM pr WHERE NOT bi AND NOT bm AND sz UNION ALL SELECT split, 'WARNING', 'NOT_BINARY', basename FROM pr WHERE NOT bi AND NOT bm AND NOT is_binary),
mt AS (SELECT split, count(*) AS matched FROM pr GROUP BY 1), fc AS (SELECT split, count(*) FILTER (level = 'ERROR') AS errors, count(*) FILTER (level = 'WARNING') AS warnings FROM fi GROUP BY 1),
sv AS (SELECT split, coalesce(matched, 0) AS matched, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM mt FULL JOIN fc USING (split))"""


@query(IM + FIND + "SELECT * FROM fi")
def dataset_findings(v: Views) -> DataFrame:
    return dataset.findings(v.images, v.masks)


@query(IM + FIND + "SELECT *, errors = 0 AND matched > 0 AS valid FROM sv")
def split_verdicts(v: Views) -> DataFrame:
    return dataset.split_verdicts(v.images, v.masks)


@query(IM + FIND + LEAK + """, s AS (SELECT CAST(sum(matched) AS BIGINT) AS total_images, CAST(sum(errors) AS BIGINT) AS e, CAST(sum(warnings) AS BIGINT) AS warnings, count(*) FILTER (split IN ('train', 'val') AND matched > 0) AS filled FROM sv)
SELECT total_images, e + (SELECT count(DISTINCT pair) FROM lk) AS errors, warnings, (SELECT count(DISTINCT basename) FROM lk) AS leaked_names, e + (SELECT count(DISTINCT pair) FROM lk) = 0 AND filled = 2 AS valid FROM s""")
def dataset_verdict(v: Views) -> DataFrame:
    return dataset.dataset_verdict(v.images, v.masks)


def shuffle_sql(src: str, key: str, seed: int = 42) -> str:
    return f", sh AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '{seed}', {key})), {key}) AS i, count(*) OVER () AS n FROM {src})"


DOCS = "WITH sc AS (SELECT doc_id AS scene_id FROM documents)"
SPLIT70 = """CASE WHEN i <= greatest(1, round_even(n*0.7e0, 0)) THEN 'train' WHEN i <= greatest(1, round_even(n*0.7e0, 0)) + greatest(1, round_even(n*0.2e0, 0)) THEN 'val' ELSE 'test' END AS split"""


def _scenes(v: Views) -> DataFrame:
    return v.spark.read.parquet(f"{v.sf_dir}/documents.parquet").select(F.col("doc_id").alias("scene_id"))


@query(DOCS + shuffle_sql("sc", "scene_id") + f"SELECT scene_id, {SPLIT70} FROM sh")
def scene_split(v: Views) -> DataFrame:
    return dataset.scene_split(_scenes(v), "scene_id")


@query(DOCS + shuffle_sql("sc", "scene_id") + "SELECT scene_id, CASE WHEN i <= greatest(1, floor(n*0.8e0)) THEN 'train' ELSE 'val' END AS split FROM sh")
def flat_split(v: Views) -> DataFrame:
    return dataset.flat_split(_scenes(v), "scene_id")


TC = PX + DIMS + FULL + """, tc AS (SELECT scene_id, r0, c0, count(*) FILTER (truth = 1) AS spill_pixels, count(*) FILTER (truth = 1) >= 205 AS has_spill, printf('scene_%d_r%04d_c%04d', scene_id, r0, c0) AS tile_name FROM ft GROUP BY 1, 2, 3),
ng AS (SELECT *, row_number() OVER (PARTITION BY scene_id, has_spill ORDER BY md5(concat_ws(':', '42', tile_name)), tile_name) AS i, count(*) FILTER (has_spill) OVER (PARTITION BY scene_id) AS pos FROM tc),
kept AS (SELECT * FROM ng WHERE has_spill OR i <= CASE WHEN pos > 0 THEN greatest(1, floor(pos*0.5e0)) ELSE 4 END)"""


@query(TC + "SELECT scene_id, tile_name, has_spill, spill_pixels FROM kept")
def sampled_tiles(v: Views) -> DataFrame:
    return dataset.sample_negatives(_tile_counts(v), 0.5).select("scene_id", "tile_name", "has_spill", "spill_pixels")


@query(TC + ", ts AS (SELECT DISTINCT scene_id FROM pixels)" + shuffle_sql("ts", "scene_id") + f""", sp AS (SELECT scene_id, {SPLIT70} FROM sh),
a AS (SELECT split, count(DISTINCT scene_id) AS scenes, count(*) AS total_patches, count(*) FILTER (has_spill) AS positive_patches, count(*) FILTER (NOT has_spill) AS negative_patches FROM kept JOIN sp USING (scene_id) GROUP BY ROLLUP (split))
SELECT *, {R('positive_patches/total_patches*100e0', 2)} AS pos_percentage, {R('negative_patches/total_patches*100e0', 2)} AS neg_percentage FROM a""")
def preparation_report(v: Views) -> DataFrame:
    splits = dataset.scene_split(v.pixels.select("scene_id").distinct(), "scene_id")
    return dataset.prep_report(dataset.sample_negatives(_tile_counts(v), 0.5).join(splits, "scene_id"))


@query(sql_views("images") + "SELECT count(*) AS total, count(*) FILTER (has_inf) AS with_spill, count(*) FILTER (NOT has_inf) AS without_spill FROM images")
def spill_share(v: Views) -> DataFrame:
    return dataset.spill_share(v.images.withColumn("has_spill", F.col("has_inf")))


@query(sql_views("images") + "SELECT count(*) AS total, count(*) FILTER (has_inf) AS with_spill, count(*) FILTER (NOT has_inf) AS without_spill FROM images")
def report_roundtrip(v: Views) -> DataFrame:
    """The summary through its JSON file and back."""
    path = new_path(v.spark, "report")
    write_report(dataset.spill_share(v.images.withColumn("has_spill", F.col("has_inf"))), path)
    return v.spark.read.json(path)


@query(IM + "SELECT scene_id, CASE WHEN i.h <> m.h OR i.w <> m.w THEN 'SIZE_MISMATCH' WHEN i.has_nan OR m.has_nan THEN 'NAN' ELSE 'INFINITE' END AS reason FROM images i JOIN masks m USING (scene_id) WHERE i.h <> m.h OR i.w <> m.w OR i.has_nan OR m.has_nan OR i.has_inf OR m.has_inf")
def skipped_scenes(v: Views) -> DataFrame:
    return dataset.skipped_scenes(v.images, v.masks)


# --- cases -------------------------------------------------------------------

SPILL_COLS = "spill_id, epoch_us(detected_at) AS detected_us, area_km2"


def _spill(df: DataFrame) -> DataFrame:
    return df.select("spill_id", us("detected_at", "detected_us"), "area_km2")


@query(sql_views("spills") + f"SELECT {SPILL_COLS} FROM spills WHERE replace(status, '_', ' ') = 'REVIEW REQUIRED' ORDER BY detected_at DESC, spill_id LIMIT 10 OFFSET 5")
def spills_page(v: Views) -> DataFrame:
    return _spill(cases.spills_page(v.spills, "REVIEW REQUIRED", 10, 5))


@query(sql_views("spills") + f"SELECT {SPILL_COLS} FROM spills WHERE spill_id = 7")
def spill_by_id(v: Views) -> DataFrame:
    return _spill(cases.by_id(v.spills, "spill_id", 7))


SCENE_COLS = "scene_id, satellite, epoch_us(acquisition_time) AS acquired_us"


def _scene(df: DataFrame) -> DataFrame:
    return df.select("scene_id", "satellite", us("acquisition_time", "acquired_us"))


@query(sql_views("scenes") + f"SELECT {SCENE_COLS} FROM scenes ORDER BY acquisition_time DESC, scene_id LIMIT 50")
def scenes_page(v: Views) -> DataFrame:
    return _scene(cases.scenes_page(v.scenes))


@query(sql_views("scenes") + f"SELECT {SCENE_COLS} FROM scenes WHERE satellite ILIKE '%el-1b%' AND acquisition_time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01' ORDER BY acquisition_time DESC, scene_id LIMIT 100")
def scene_search(v: Views) -> DataFrame:
    return _scene(cases.search_scenes(v.scenes, "el-1b", "1996-01-01", "1997-01-01"))


@query(sql_views("candidates") + "SELECT * FROM candidates WHERE spill_id = 7")
def candidates_of_spill(v: Views) -> DataFrame:
    return cases.candidates_of(v.candidates, 7)


@query(sql_views("candidates") + "SELECT * FROM candidates WHERE spill_id = 7 AND vessel_id = (SELECT min(vessel_id) FROM candidates WHERE spill_id = 7)")
def candidate_detail(v: Views) -> DataFrame:
    of = cases.candidates_of(v.candidates, 7)
    return of.filter(F.col("vessel_id") == of.agg(F.min("vessel_id")).scalar())


@query(sql_views("simulations") + "SELECT simulation_id, spill_id, simulation_type FROM simulations WHERE simulation_id = 42 OR spill_id = 42 ORDER BY created_at DESC, simulation_id DESC LIMIT 1")
def simulation_lookup(v: Views) -> DataFrame:
    return cases.simulation_for(v.simulations, 42).select("simulation_id", "spill_id", "simulation_type")


@query(sql_views("simulations") + "SELECT spill_id, simulation_id, epoch_us(start_time) AS start_us FROM (SELECT *, row_number() OVER (PARTITION BY spill_id ORDER BY created_at DESC, simulation_id DESC) AS rn FROM simulations WHERE simulation_type = 'BACKWARD') WHERE rn = 1")
def newest_hindcast(v: Views) -> DataFrame:
    return cases.newest_per_spill(v.simulations).select("spill_id", "simulation_id", us("start_time", "start_us"))


@query(sql_views("particles") + "SELECT particle_id, epoch_us(ts) AS ts_us, lon, lat FROM particles WHERE simulation_id = 42")
def simulation_particles(v: Views) -> DataFrame:
    return cases.particles_of(v.particles, 42).select("particle_id", us("ts", "ts_us"), "lon", "lat")


@query(sql_views("detections") + "SELECT detection_id, spill_id, model_name, confidence FROM detections WHERE detection_id = 421")
def detection_result(v: Views) -> DataFrame:
    return cases.by_id(v.detections, "detection_id", 421).drop("created_at")


STATE = """, cs AS (SELECT spill_id, arg_max(status, (updated_at, change_id)) FILTER (status IS NOT NULL) AS status, arg_max(notes, (updated_at, change_id)) FILTER (notes IS NOT NULL) AS notes, max(updated_at) AS updated_at FROM case_log GROUP BY 1)"""


def _cases(v: Views) -> DataFrame:
    return cases.current_state(v.case_log, "spill_id", ["status", "notes"]).withColumn("investigation_id", F.col("spill_id"))


@query(sql_views("case_log") + STATE + "SELECT spill_id, status, notes, epoch_us(updated_at) AS updated_us FROM cs")
def investigation_state(v: Views) -> DataFrame:
    return _cases(v).select("spill_id", "status", "notes", us("updated_at", "updated_us"))


@query(sql_views("case_log") + STATE + "SELECT spill_id, notes, epoch_us(updated_at) AS updated_us FROM cs WHERE replace(status, '_', ' ') = 'UNDER REVIEW' ORDER BY updated_at DESC, spill_id LIMIT 25")
def investigations_page(v: Views) -> DataFrame:
    return cases.cases_page(_cases(v), "UNDER REVIEW", 25).select("spill_id", "notes", us("updated_at", "updated_us"))


@query(sql_views("case_log") + STATE + "SELECT spill_id AS investigation_id, status FROM cs WHERE spill_id = 7")
def investigation_by_id(v: Views) -> DataFrame:
    return cases.by_id(_cases(v), "investigation_id", 7).select("investigation_id", "status")


@query(sql_views("spill_log") + """SELECT spill_id, arg_max(status, (updated_at, change_id)) FILTER (status IS NOT NULL) AS status, arg_max(confidence, (updated_at, change_id)) FILTER (confidence IS NOT NULL) AS confidence,
 epoch_us(max(updated_at)) AS updated_us FROM spill_log GROUP BY 1""")
def spill_state(v: Views) -> DataFrame:
    return cases.current_state(v.spill_log, "spill_id", ["status", "confidence"]).select("spill_id", "status", "confidence", us("updated_at", "updated_us"))


@query(sql_views("spills", "candidates", "simulations", "detections", "particles", "case_log") + """, t AS (SELECT spill_id FROM spills WHERE status = 'REJECTED'), k AS (SELECT 'spill' AS tbl, spill_id FROM spills UNION ALL SELECT 'candidate', spill_id FROM candidates UNION ALL SELECT 'simulation', spill_id FROM simulations
 UNION ALL SELECT 'detection', spill_id FROM detections UNION ALL SELECT 'case', spill_id FROM case_log UNION ALL SELECT 'particle', spill_id FROM particles JOIN simulations USING (simulation_id))
SELECT tbl, spill_id, count(*) AS n FROM k ANTI JOIN t USING (spill_id) GROUP BY 1, 2""")
def cascade_delete(v: Views) -> DataFrame:
    dead = v.spills.filter("status = 'REJECTED'")
    tables = {"spill": v.spills, "candidate": v.candidates, "simulation": v.simulations, "detection": v.detections, "case": v.case_log, "particle": v.particles}
    left = cases.with_children_deleted(tables, dead, grandchildren={"particle": ("simulation", "simulation_id")})
    left["particle"] = left["particle"].join(v.simulations.select("simulation_id", "spill_id"), "simulation_id")
    parts = [df.select(F.lit(n).alias("tbl"), "spill_id") for n, df in left.items()]
    return reduce(DataFrame.unionAll, parts).groupBy("tbl", "spill_id").agg(F.count("*").alias("n"))


@query(sql_views("spills", "scenes") + "SELECT spill_id, coalesce(s.satellite, 'Sentinel-1A SAR') AS satellite_source, coalesce(s.polarization, 'VV') AS polarization FROM spills LEFT JOIN scenes s ON s.scene_id = satellite_image_id")
def spills_with_scene(v: Views) -> DataFrame:
    return cases.with_scene(v.spills, v.scenes).select("spill_id", "satellite_source", "polarization")


@query(sql_views("spills", "scenes") + "SELECT spill_id, satellite FROM spills LEFT JOIN scenes s ON s.scene_id = satellite_image_id WHERE replace(status, '_', ' ') = 'REVIEW REQUIRED' AND (contains(CAST(spill_id AS VARCHAR), '1b') OR contains(lower(satellite), '1b'))")
def spill_search(v: Views) -> DataFrame:
    return cases.search_spills(v.spills, v.scenes, "1B", "REVIEW REQUIRED").select("spill_id", "satellite")


@query(sql_views("candidates", "vessels") + """SELECT spill_id, vessel_id, CASE WHEN v.vessel_id IS NULL THEN 'VESSEL-' || CAST(c.vessel_id AS VARCHAR) ELSE name END AS vessel_name, CASE WHEN v.vessel_id IS NULL THEN CAST(c.vessel_id AS VARCHAR) ELSE mmsi END AS mmsi,
 CASE WHEN v.vessel_id IS NULL THEN 'Tanker' ELSE ship_type END AS ship_type, CASE WHEN v.vessel_id IS NULL THEN 'Unknown' ELSE flag END AS flag FROM candidates c LEFT JOIN vessels v USING (vessel_id)""")
def candidates_with_vessel(v: Views) -> DataFrame:
    return cases.with_vessel(v.candidates, v.vessels).select("spill_id", "vessel_id", "vessel_name", "mmsi", "ship_type", "flag")


PRIORITY = ", pr AS (SELECT v.*, coalesce(priority, 'TRACKED') AS priority FROM vessels v LEFT JOIN (SELECT vessel_id, arg_max(priority, (overall_score, -spill_id)) AS priority FROM candidates GROUP BY 1) c USING (vessel_id))"


def _priority(v: Views) -> DataFrame:
    return cases.vessel_priority(v.vessels, v.candidates)


@query(sql_views("vessels", "candidates") + PRIORITY + "SELECT vessel_id, priority FROM pr")
def vessel_priorities(v: Views) -> DataFrame:
    return _priority(v).select("vessel_id", "priority")


@query(sql_views("spills", "spill_log") + "SELECT spill_id, arg_min(status, change_id) AS status FROM (SELECT spill_id, coalesce(status, 'NONE') AS status, change_id FROM spill_log) ANTI JOIN (SELECT spill_id FROM spills WHERE status = 'ACCEPTED') s USING (spill_id) GROUP BY 1")
def insert_if_absent(v: Views) -> DataFrame:
    batch = v.spill_log.select("spill_id", F.coalesce("status", F.lit("NONE")).alias("status"), "change_id")
    return cases.insert_if_absent(v.spills.filter("status = 'ACCEPTED'"), batch, "spill_id", "change_id")


@query(sql_views("spills", "case_log", "vessels") + STATE + """, c AS (SELECT (SELECT count(*) FROM spills) AS active_spills, (SELECT count(*) FROM cs WHERE replace(status, '_', ' ') IN ('NEW', 'UNDER REVIEW', 'HIGH PRIORITY')) AS active_investigations, (SELECT count(*) FROM vessels) AS vessels_tracked)
SELECT *, CASE WHEN vessels_tracked > 0 THEN 'REAL_IMPORTED' ELSE 'DEMO' END AS ais_status FROM c""")
def system_counters(v: Views) -> DataFrame:
    return cases.system_counters(v.spills, _cases(v), v.vessels)


def _full_candidates(v: Views) -> DataFrame:
    pts = F.array(F.concat(F.lit("score "), fixed(F.col("overall_score"), 0)), F.lit("second"), F.lit("third"))
    return v.candidates.withColumns({"trajectory_score": F.lit(1.0), "behaviour_score": F.lit(2.0), "data_quality_score": F.lit(3.0),
                                     "explanation": F.struct(pts.alias("explanation_points"))})


@query(sql_views("spills", "scenes", "simulations", "candidates", "vessels") + f""", ns AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spill_id ORDER BY created_at DESC, simulation_id DESC) AS rn FROM simulations WHERE simulation_type = 'BACKWARD') WHERE rn = 1),
rk AS (SELECT c.*, CASE WHEN v.vessel_id IS NULL THEN 'VESSEL-' || CAST(c.vessel_id AS VARCHAR) ELSE v.name END AS vn, row_number() OVER (PARTITION BY spill_id ORDER BY overall_score DESC, c.vessel_id) AS rank FROM candidates c LEFT JOIN vessels v ON v.vessel_id = c.vessel_id),
ls AS (SELECT spill_id, (rank - 1) // 100 AS part, string_agg(rank || ':' || vn || ':' || {FIX('overall_score', 0)} || ':' || priority, ',' ORDER BY rank) AS candidates FROM rk GROUP BY 1, 2)
SELECT printf('DOSSIER-%05d', s.spill_id) AS report_id, s.spill_id, coalesce(part, 0) AS part, replace(s.status, '_', ' ') AS status, strftime(s.detected_at, '%Y-%m-%dT%H:%M:%S') AS detected_at, coalesce(sc.satellite, 'Sentinel-1A SAR') AS satellite_source,
 {R('area_km2', 2)} AS area_km2, {R('s.confidence*100e0', 1)} AS confidence, coalesce(simulation_type, 'N/A') AS simulation_type, strftime(start_time, '%Y-%m-%dT%H:%M:%S') AS estimated_origin_time, coalesce(particle_count, 150) AS particle_count,
 {R('coalesce(ns.confidence, 0.85e0)*100e0', 1)} AS model_confidence, candidates FROM spills s LEFT JOIN scenes sc ON sc.scene_id = satellite_image_id LEFT JOIN ns ON ns.spill_id = s.spill_id LEFT JOIN ls ON ls.spill_id = s.spill_id""")
def case_dossiers(v: Views) -> DataFrame:
    d = cases.dossiers(v.spills, v.scenes, v.simulations, _full_candidates(v), v.vessels, list_limit=100)
    item = F.transform("candidates", lambda c: F.concat_ws(":", c["rank"].cast("string"), c["vessel_name"], fixed(c["overall_score"], 0), c["priority"]))
    return d.select("report_id", "spill_id", big("part"), "status", "incident.detected_at", "incident.satellite_source", "incident.area_km2", "incident.confidence",
                    "drift.simulation_type", "drift.estimated_origin_time", big("drift.particle_count").alias("particle_count"), "drift.model_confidence", F.array_join(item, ",").alias("candidates"))


@query(sql_views("candidates") + f"SELECT spill_id, vessel_id, 'score ' || {FIX('overall_score', 0)} || '|second' AS top_points FROM candidates")
def top_evidence_points(v: Views) -> DataFrame:
    return cases.top_evidence(_full_candidates(v)).select("spill_id", "vessel_id", F.array_join("top_points", "|").alias("top_points"))


# --- exports -----------------------------------------------------------------

BOX = "lon - 0.05e0 AS x0, lat - 0.05e0 AS y0, lon + 0.05e0 AS x1, lat + 0.05e0 AS y1"


@query(sql_views("spills") + f"SELECT spill_id, 'Feature' AS kind, 'Polygon' AS geometry, {R('lon - 0.05e0', 6)} AS first_lon, 5 AS points, {R('area_km2', 6)} AS area_km2, replace(status, '_', ' ') AS status, strftime(detected_at, '%Y-%m-%dT%H:%M:%S') AS detected_at FROM spills")
def spill_features(v: Views) -> DataFrame:
    """Feature text, read back through its schema."""
    from tidemark.functions.scalar import rnd
    schema = "type string, geometry struct<type string, coordinates array<array<array<double>>>>, properties struct<area_km2 double, status string, detected_at string>"
    f = export.spill_features(v.ringed_spills).withColumn("f", F.from_json("feature", schema))
    ring = F.get(F.col("f.geometry.coordinates"), F.lit(0))
    return f.select("spill_id", F.col("f.type").alias("kind"), F.col("f.geometry.type").alias("geometry"), rnd(F.get(F.get(ring, F.lit(0)), F.lit(0)), 6).alias("first_lon"),
                    F.size(ring).alias("points"), rnd(F.col("f.properties.area_km2"), 6).alias("area_km2"), "f.properties.status", "f.properties.detected_at")


@query(sql_views("spills") + f"SELECT spill_id, {R('lon - 0.05e0', 6)} AS min_lon, {R('lat - 0.05e0', 6)} AS min_lat, {R('lon + 0.05e0', 6)} AS max_lon, {R('lat + 0.05e0', 6)} AS max_lat FROM spills")
def footprint_bounds(v: Views) -> DataFrame:
    from tidemark.functions.scalar import rnd
    b = v.ringed_spills.select("spill_id", geo.ring_bounds(F.col("ring")).alias("b")).select("spill_id", "b.*")
    return b.select("spill_id", *[rnd(F.col(c), 6).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


@query(sql_views("ais") + "SELECT position_id, CASE WHEN course IS NOT NULL THEN lon END AS lon, CASE WHEN course IS NOT NULL THEN lat END AS lat FROM ais")
def parsed_geojson(v: Views) -> DataFrame:
    """Point text, cut short where the course is missing, back to lon and lat."""
    text = F.to_json(export.point(F.col("lon"), F.col("lat")))
    bad = F.when(F.col("course").isNull(), F.substring(text, 1, 20)).otherwise(text)
    return v.ais.select("position_id", export.parse_point(bad).alias("p")).select("position_id", "p.lon", "p.lat")


@query(sql_views("spills") + f""", r AS (SELECT spill_id, lon, lat, unnest(range(1, 6)) AS i FROM spills WHERE spill_id % 9 <> 4)
SELECT spill_id, i, {R("lon + CASE WHEN i IN (2, 3) THEN 0.05e0 ELSE -0.05e0 END", 6)} AS lon, {R("lat + CASE WHEN i IN (3, 4) THEN 0.05e0 ELSE -0.05e0 END", 6)} AS lat FROM r
UNION ALL SELECT spill_id, NULL, NULL, NULL FROM spills WHERE spill_id % 9 = 4""")
def parsed_polygons(v: Views) -> DataFrame:
    """Rings parsed back from the text of the spills' features; cut text has none."""
    from tidemark.functions.scalar import rnd
    geometry = F.get_json_object("feature", "$.geometry")
    text = F.when(F.col("spill_id") % 9 == 4, F.substring(geometry, 1, 40)).otherwise(geometry)
    rings = export.spill_features(v.ringed_spills).select("spill_id", F.posexplode_outer(export.parse_polygon(text)).alias("i", "p"))
    return rings.select("spill_id", (F.col("i") + 1).cast("bigint").alias("i"), rnd(F.col("p.lon"), 6).alias("lon"), rnd(F.col("p.lat"), 6).alias("lat"))


@query(drift_sql(CALM) + f"""SELECT spill_id, count(*) AS points, string_agg({FIX('p_lon', 4)} || ' ' || {FIX('p_lat', 4)}, ',' ORDER BY ts) AS line, '#fb923c' AS color FROM path GROUP BY 1""")
def particle_line_features(v: Views) -> DataFrame:
    f = export.particle_lines(drift.simulate(v.spills, v.forcing, CALM))
    g = F.from_json("feature", "geometry struct<coordinates array<array<double>>>, properties struct<color string>")
    pts = F.transform("g.geometry.coordinates", lambda p: F.concat(fixed(p[0], 4), F.lit(" "), fixed(p[1], 4)))
    return f.withColumn("g", g).select("spill_id", F.size("g.geometry.coordinates").cast("bigint").alias("points"), F.array_join(pts, ",").alias("line"), "g.properties.color")


COLOR = "CASE priority WHEN 'HIGH' THEN '#ef4444' WHEN 'MEDIUM' THEN '#f59e0b' WHEN 'LOW' THEN '#38bdf8' ELSE '#94a3b8' END"


@query(sql_views("ais", "vessels", "candidates") + PRIORITY + f""", n AS (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY ts, position_id) AS rn FROM ais),
p AS (SELECT vessel_id, (rn - 1) // 40 AS part, count(*) AS points FROM n GROUP BY 1, 2)
SELECT vessel_id, part, points, mmsi, {COLOR} AS color FROM p JOIN pr USING (vessel_id) WHERE points > 1""")
def vessel_line_features(v: Views) -> DataFrame:
    f = export.vessel_lines(tracks.track_parts(v.ais, 40), _priority(v))
    g = F.from_json("feature", "geometry struct<coordinates array<array<double>>>, properties struct<mmsi string, strokeColor string>")
    return f.withColumn("g", g).select("vessel_id", "part", F.size("g.geometry.coordinates").cast("bigint").alias("points"), "g.properties.mmsi", F.col("g.properties.strokeColor").alias("color"))


@query(sql_views("ais", "vessels", "candidates") + PRIORITY + f""", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY ts DESC, position_id DESC) AS rn FROM ais) WHERE rn = 1)
SELECT vessel_id, pr.mmsi, pr.name, speed, {COLOR} AS color, CASE priority WHEN 'HIGH' THEN 7.5e0 WHEN 'MEDIUM' THEN 6.5e0 ELSE 5.5e0 END AS radius, priority FROM l JOIN pr USING (vessel_id)""")
def vessel_point_features(v: Views) -> DataFrame:
    f = export.vessel_points(tracks.last_position(v.ais), _priority(v))
    g = F.from_json("feature", "properties struct<mmsi string, name string, speed double, color string, radius double, priority string>")
    return f.withColumn("g", g).select("vessel_id", "g.properties.*")


@query(sql_views("spills") + "SELECT count(*) + 2 AS lines, count(*) AS features FROM spills")
def feature_collection_file(v: Views) -> DataFrame:
    from tidemark.sources.scratch import new_path
    path = new_path(v.spark, "features")
    export.feature_lines(export.spill_features(v.ringed_spills), ["spill_id"]).select("value").write.text(path)
    return v.spark.read.text(path).agg(F.count("*").alias("lines"), F.count_if(F.contains("value", F.lit('"type":"Feature",'))).alias("features"))
