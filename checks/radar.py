"""Pixel, tile, detection and evaluation queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import query
from checks.sql import R
from checks.views import SCENE_EXT_SQL, Views, sql_views
from tidemark.functions import geo, radar
from tidemark.functions.scalar import clamp, lit_f, rnd
from tidemark.operators import components, detect, evaluate, raster
from tidemark.sources import arrays
from tidemark.sources.rasters import write_tiles
from tidemark.sources.scratch import cut_lineage, new_path

PX = sql_views("pixels")
DIMS = ", dims AS (SELECT scene_id, max(row) + 1 AS h, max(col) + 1 AS w FROM pixels GROUP BY 1)"


def big(name: str):
    return F.col(name).cast("bigint").alias(name)


def out(df: DataFrame, name: str, digits: int = 6) -> DataFrame:
    return df.select("scene_id", "row", "col", rnd(F.col(name), digits).alias(name))


@query(PX + f"SELECT scene_id, row, col, {R('10e0*log10(greatest(value*value, 1e-6))', 6)} AS db, {R('(least(greatest(10e0*log10(greatest(value*value, 1e-6)), -30e0), 0e0) + 30e0)/30e0', 6)} AS norm FROM pixels")
def sigma0_and_normalise(v: Views) -> DataFrame:
    db = radar.sigma0_db(F.col("value"))
    return v.pixels.select("scene_id", "row", "col", rnd(db, 6).alias("db"), rnd(radar.normalise_db(db), 6).alias("norm"))


@query(PX + f"SELECT scene_id, max(row) + 1 AS h, max(col) + 1 AS w, count(*) AS n, {R('min(value)', 6)} AS min_val, {R('max(value)', 6)} AS max_val, {R('avg(value)', 6)} AS mean_val, {R('var_pop(value)', 6)} AS variance FROM pixels GROUP BY 1")
def scene_statistics(v: Views) -> DataFrame:
    return raster.scene_stats(v.pixels).withColumns({c: rnd(F.col(c), 6) for c in ("min_val", "max_val", "mean_val", "variance")})


def filt(src: str, value: str, name: str, half: int, weights: list[float] | None = None) -> str:
    """CTE text: two mirrored line passes over table ``src`` (scene_id, row, col, value columns)."""
    def one(frm: str, axis: str, val: str, res: str, tag: str) -> str:
        oth = "row" if axis == "col" else "col"
        size = "w" if axis == "col" else "h"
        w = "avg(y)" if weights is None else "sum(y*wt)"
        wt = "" if weights is None else ", (" + str(weights) + "::DOUBLE[])[CAST(k AS BIGINT) + " + str(half + 1) + "] AS wt"
        return f""", {tag}k AS (SELECT p.scene_id, p.{oth}, p.{axis}, k, CASE WHEN p.{axis} + k < 0 THEN -(p.{axis} + k) WHEN p.{axis} + k >= {size} THEN 2*({size} - 1) - (p.{axis} + k) ELSE p.{axis} + k END AS j {wt}
 FROM (SELECT scene_id, {oth}, {axis}, {size} FROM {frm} JOIN dims USING (scene_id)) p, (SELECT unnest(range(-{half}, {half + 1})) AS k)),
{tag} AS (SELECT t.scene_id, t.{oth}, t.{axis}, {w.replace('y', 'q.' + val)} AS {res} FROM {tag}k t JOIN {frm} q ON q.scene_id = t.scene_id AND q.{oth} = t.{oth} AND q.{axis} = t.j GROUP BY 1, 2, 3)"""
    return one(src, "col", value, name + "_h", name + "1") + one(name + "1", "row", name + "_h", name, name)


BOX5 = filt("pixels", "value", "mean", 2)
GAUSS = filt("pixels", "value", "smooth", 3, raster.gauss_weights())


@query(PX + DIMS + BOX5 + f"SELECT scene_id, row, col, {R('mean', 6)} AS mean FROM mean")
def box_mean(v: Views) -> DataFrame:
    return out(raster.box_mean(v.pixels, 5), "mean")


@query(PX + DIMS + GAUSS + f"SELECT scene_id, row, col, {R('smooth', 6)} AS smooth FROM smooth")
def gaussian_blur(v: Views) -> DataFrame:
    return out(raster.gaussian(v.pixels), "smooth")


def grad_sql(src: str, val: str) -> str:
    def d(axis: str, oth: str) -> str:
        a, b = f"lag({val}) OVER {axis}w", f"lead({val}) OVER {axis}w"
        return f"coalesce(CASE WHEN {a} IS NULL THEN {b} - {val} WHEN {b} IS NULL THEN {val} - {a} ELSE ({b} - {a})/2e0 END, 0e0)"
    return f""", gr AS (SELECT scene_id, row, col, {d('col', 'row')} AS gx, {d('row', 'col')} AS gy FROM {src}
 WINDOW colw AS (PARTITION BY scene_id, row ORDER BY col), roww AS (PARTITION BY scene_id, col ORDER BY row)),
grad AS (SELECT *, sqrt(gx*gx + gy*gy) AS gradient FROM gr)"""


@query(PX + grad_sql("pixels", "value") + f"SELECT scene_id, row, col, {R('gradient', 6)} AS gradient FROM grad")
def gradient_magnitude(v: Views) -> DataFrame:
    return out(raster.gradient(v.pixels), "gradient")


def lee_sql(src: str, val: str, half: int) -> str:
    """CTE "lee" with column despeckled over ``src``."""
    return (f", sq AS (SELECT scene_id, row, col, {val} AS x, {val}*{val} AS xx FROM {src}), nz AS (SELECT scene_id, var_pop(x) AS noise FROM sq GROUP BY 1)"
            + filt("sq", "x", "bm", half) + filt("sq", "xx", "bs", half)
            + """, lv AS (SELECT sq.*, bm, greatest(bs - bm*bm, 1e-6) AS va, noise FROM sq JOIN bm USING (scene_id, row, col) JOIN bs USING (scene_id, row, col) JOIN nz USING (scene_id)),
lee AS (SELECT scene_id, row, col, x, bm + least(greatest(va/(va + noise + 1e-6), 0e0), 1e0)*(x - bm) AS despeckled FROM lv)""")


@query(PX + DIMS + lee_sql("pixels", "value", 2) + f"SELECT scene_id, row, col, {R('despeckled', 6)} AS despeckled FROM lee")
def lee_despeckle(v: Views) -> DataFrame:
    return out(raster.lee(v.pixels, 5), "despeckled")


ROUTE = """, rt AS (SELECT scene_id, CASE WHEN ext IN ('.png', '.jpg', '.jpeg', '.webp') THEN '8BIT_VISUAL_PROXY' WHEN max(value) <= 1 AND ext = '.npy' THEN 'PRE_CALIBRATED_NUMPY' ELSE 'RADIOMETRIC_SIGMA0_DB' END AS calibration_method
 FROM pixels JOIN scene_ext USING (scene_id) GROUP BY scene_id, ext)"""


def preprocess_sql(values: str, method: str, decibel: str) -> str:
    """Both filter sizes over all scenes; each scene takes the one of its route."""
    routes = ROUTE.replace("RADIOMETRIC_SIGMA0_DB", method).replace("FROM pixels", f"FROM {values}")
    scaled = f"(SELECT scene_id, row, col, CASE calibration_method WHEN '8BIT_VISUAL_PROXY' THEN value/255e0 WHEN '{method}' THEN {decibel} ELSE value END AS value FROM {values} JOIN rt USING (scene_id))"
    return SCENE_EXT_SQL + DIMS + routes + lee_sql(scaled, "value", 2) + filt("sq", "x", "bm3", 1) + filt("sq", "xx", "bs3", 1) + f""", l3 AS (SELECT sq.*, bm3, greatest(bs3 - bm3*bm3, 1e-6) AS va, noise FROM sq JOIN bm3 USING (scene_id, row, col) JOIN bs3 USING (scene_id, row, col) JOIN nz USING (scene_id))
SELECT scene_id, row, col, calibration_method, {R(f'''CASE calibration_method WHEN 'PRE_CALIBRATED_NUMPY' THEN lee.x WHEN '{method}' THEN (least(greatest(despeckled, -30e0), 0e0) + 30e0)/30e0
 ELSE least(greatest(bm3 + least(greatest(va/(va + noise + 1e-6), 0e0), 1e0)*(l3.x - bm3), 0e0), 1e0) END''', 6)} AS norm FROM lee JOIN rt USING (scene_id) JOIN l3 USING (scene_id, row, col)"""


def _normalised(v: Views, pixels: DataFrame, **settings) -> DataFrame:
    p = raster.preprocess(pixels, v.scene_ext, **settings)
    return p.select("scene_id", "row", "col", "calibration_method", rnd(F.col("norm"), 6).alias("norm"))


@query(PX + ", " + preprocess_sql("pixels", "RADIOMETRIC_SIGMA0_DB", "10e0*log10(greatest(value*value, 1e-6))"))
def preprocess_scenes(v: Views) -> DataFrame:
    return _normalised(v, v.pixels.drop("truth"))


@query(PX + ", darker AS (SELECT scene_id, row, col, value*20e0 - 18e0 AS value FROM pixels), " + preprocess_sql("darker", "RAW_DN", "value"))
def preprocess_uncalibrated(v: Views) -> DataFrame:
    """Without calibration: values that are decibels already are filtered and clipped as they are."""
    return _normalised(v, v.pixels.drop("truth").withColumn("value", F.col("value") * lit_f(20) - lit_f(18)), calibrate=False)


@query(PX + " SELECT scene_id, row, col, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM pixels WHERE row BETWEEN 5 AND 40")
def array_files(v: Views) -> DataFrame:
    """Scenes written as array files; ranges of their rows read back."""
    path = new_path(v.spark, "arrays")
    arrays.write_arrays(v.pixels.select(F.col("scene_id").alias("scene"), "row", "col", "value"), path)
    back = arrays.read_arrays(v.spark, path, partition_bytes=1 << 12).filter("band = 'VV' AND row >= 5 AND row <= 40")
    return back.select(F.col("scene").cast("bigint").alias("scene_id"), "row", "col", "value")


SHIFTED = "SELECT scene_id, row, col, value*CASE scene_id % 3 WHEN 0 THEN 1e0 WHEN 1 THEN -20e0 ELSE 400e0 END AS value FROM pixels"


@query(PX + f""", s AS ({SHIFTED}), k AS (SELECT scene_id, median(value) AS m, min(value) AS lo, max(value) AS hi FROM s GROUP BY 1)
SELECT scene_id, CASE WHEN m < 0 OR (lo < -5 AND hi <= 10) THEN 'DB' WHEN lo >= 0 AND hi <= 1 THEN 'NORMALISED' ELSE 'DN' END AS value_kind FROM k""")
def scene_value_kind(v: Views) -> DataFrame:
    factor = F.when(F.col("scene_id") % 3 == 0, lit_f(1)).when(F.col("scene_id") % 3 == 1, lit_f(-20)).otherwise(lit_f(400))
    return raster.value_kind(v.pixels.withColumn("value", F.col("value") * factor))


MASKV = "SELECT scene_id, row, col, CAST(CASE scene_id % 3 WHEN 0 THEN truth WHEN 1 THEN truth*255 ELSE truth + (row + col) % 3 END AS DOUBLE) AS value FROM pixels"


def _mask_values(v: Views) -> DataFrame:
    t, k = F.col("truth"), F.col("scene_id") % 3
    value = F.when(k == 0, t).when(k == 1, t * 255).otherwise(t + (F.col("row") + F.col("col")) % 3)
    return v.pixels.select("scene_id", "row", "col", value.cast("double").alias("value"))


@query(PX + f""", m AS ({MASKV}), k AS (SELECT scene_id, bool_and(value IN (0, 1)) AS a, bool_and(value IN (0, 255)) AS b FROM m GROUP BY 1)
SELECT scene_id, row, col, CAST(CASE WHEN a THEN CASE WHEN value > 0.5 THEN 255 ELSE 0 END WHEN b THEN CASE WHEN value >= 128 THEN 255 ELSE 0 END ELSE CASE WHEN abs(value - 1) <= 1.001e-5 THEN 255 ELSE 0 END END AS BIGINT) AS mask FROM m JOIN k USING (scene_id)""")
def binarised_masks(v: Views) -> DataFrame:
    return raster.binarise_masks(_mask_values(v)).select("scene_id", "row", "col", big("mask"))


@query(PX + f", m AS ({MASKV}) SELECT p.scene_id, p.row, p.col, CAST(CASE WHEN m.value > 127 THEN 1 ELSE 0 END AS BIGINT) AS mask FROM pixels p LEFT JOIN (SELECT * FROM m WHERE value > 0) m USING (scene_id, row, col)")
def loader_masks(v: Views) -> DataFrame:
    from tidemark.operators.dataset import loader_pairs
    return loader_pairs(v.pixels.drop("value", "truth"), _mask_values(v).filter("value > 0")).select("scene_id", "row", "col", big("mask"))


@query(PX + f", m AS ({MASKV}) SELECT scene_id, max(row) + 1 AS h, max(col) + 1 AS w, bool_or(isnan(value)) AS has_nan, bool_or(isinf(value)) AS has_inf, bool_and(value IN (0, 1, 255)) AS is_binary FROM m GROUP BY 1")
def raster_scan(v: Views) -> DataFrame:
    return raster.scan(_mask_values(v))


BOUNDS_SQL = ", bounds AS (SELECT *, 72e0 + scene_id/10e0 AS min_lon, 18.5e0 AS min_lat, 73e0 + scene_id/10e0 AS max_lon, 19.5e0 AS max_lat FROM dims)"


def _bounds(v: Views) -> DataFrame:
    s = F.col("scene_id") / lit_f(10)
    return raster.scene_stats(v.pixels).select("scene_id", "h", "w", (lit_f(72) + s).alias("min_lon"), lit_f(18.5).alias("min_lat"),
                                               (lit_f(73) + s).alias("max_lon"), lit_f(19.5).alias("max_lat"))


@query(PX + DIMS + BOUNDS_SQL + f"""SELECT scene_id, row, col, {R('min_lon + (col/w)*(max_lon - min_lon)', 6)} AS lon, {R('max_lat - (row/h)*(max_lat - min_lat)', 6)} AS lat,
 {R('abs(max_lon-min_lon)*(111.320e0*cos(radians((min_lat+max_lat)/2e0)))*(abs(max_lat-min_lat)*110.574e0)/(w*h)', 8)} AS area_km2 FROM pixels JOIN bounds USING (scene_id)""")
def pixel_positions(v: Views) -> DataFrame:
    b = [F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    p = raster.attach_scene(v.pixels, _bounds(v).select("*", F.col("h").alias("hh")), ["w", "hh", "min_lon", "min_lat", "max_lon", "max_lat"])
    return p.select("scene_id", "row", "col", rnd(geo.pixel_lon(F.col("col"), F.col("w"), b[0], b[2]), 6).alias("lon"),
                    rnd(geo.pixel_lat(F.col("row"), F.col("hh"), b[1], b[3]), 6).alias("lat"),
                    rnd(geo.pixel_area_km2(*b, F.col("w"), F.col("hh")), 8).alias("area_km2"))


TILES = """, t AS (SELECT p.*, r0, c0 FROM pixels p JOIN dims USING (scene_id), (SELECT unnest(range(0, 64, 24)) AS r0) a, (SELECT unnest(range(0, 64, 24)) AS c0) b
 WHERE r0 < h AND c0 < w AND row >= r0 AND row < r0 + 32 AND col >= c0 AND col < c0 + 32)"""


@query(PX + DIMS + TILES + f"SELECT scene_id, r0, c0, count(*) AS n, max(row) + 1 AS r_end, max(col) + 1 AS c_end, {R('sum(value)', 6)} AS total FROM t GROUP BY 1, 2, 3")
def padded_tiles(v: Views) -> DataFrame:
    t = raster.tile_pixels(v.pixels, 32, 24)
    return t.groupBy("scene_id", "r0", "c0").agg(F.count("*").alias("n"), (F.max("row") + 1).alias("r_end"), (F.max("col") + 1).alias("c_end"), rnd(F.sum("value"), 6).alias("total"))


FULL = TILES + ", ft AS (SELECT t.* FROM t JOIN dims USING (scene_id) WHERE r0 + 32 <= h AND c0 + 32 <= w)"


@query(PX + DIMS + FULL + """, c AS (SELECT scene_id, r0, c0, count(*) FILTER (truth = 1) AS spill_pixels FROM ft GROUP BY 1, 2, 3)
SELECT *, spill_pixels >= 205 AS has_spill, printf('scene_%d_r%04d_c%04d', scene_id, r0, c0) AS tile_name FROM c""")
def tile_spill_counts(v: Views) -> DataFrame:
    return _tile_counts(v)


def _tile_counts(v: Views) -> DataFrame:
    masked = v.pixels.withColumn("mask", F.col("truth") * 255)
    return raster.tile_counts(raster.full_tile_pixels(masked, raster.scene_stats(v.pixels), 32, 24), 205)


@query(PX + DIMS + TILES + f""", wt AS (SELECT *, greatest((0.5e0 - 0.5e0*cos({2*math.pi!r}*(row - r0)/31e0))*(0.5e0 - 0.5e0*cos({2*math.pi!r}*(col - c0)/31e0)), 1e-4) AS wgt, value + 0.01e0*(r0 + c0)/24 AS pred FROM t)
SELECT scene_id, row, col, {R('least(greatest(sum(pred*wgt)/greatest(sum(wgt), 1e-6), 0e0), 1e0)', 6)} AS value FROM wt GROUP BY 1, 2, 3""")
def blended_scene(v: Views) -> DataFrame:
    t = raster.tile_pixels(v.pixels, 32, 24).withColumn("pred", F.col("value") + lit_f(0.01) * (F.col("r0") + F.col("c0")) / 24)
    return out(raster.blend_tiles(t, 32, "pred"), "value")


@query(PX + DIMS + TILES + f"SELECT scene_id, r0, c0, 1024 AS cells, {R('sum(CAST(value AS FLOAT)::DOUBLE * ((row - r0)*32 + (col - c0) + 1))', 4)} AS checksum FROM t GROUP BY 1, 2, 3")
def tile_arrays_stored(v: Views) -> DataFrame:
    """Zero-padded tile arrays written by split and read back."""
    tiled = raster.tile_arrays(raster.tile_pixels(v.pixels, 32, 24), 32)
    path = new_path(v.spark, "tiles")
    write_tiles(tiled.withColumn("split", F.when(F.col("scene_id") % 2 == 0, "train").otherwise("val")), path)
    spread = v.spark.read.parquet(path).select("scene_id", "r0", "c0", F.posexplode("values").alias("i", "x"))
    return spread.groupBy("scene_id", "r0", "c0").agg(F.count("*").cast("int").alias("cells"),
                                                      rnd(F.sum(F.col("x").cast("double") * (F.col("i") + 1)), 4).alias("checksum"))


# Darkness contrast: the checking SQL runs the two blurs one after the other.
CLIPPED = ", nm AS (SELECT scene_id, row, col, 1e0 - least(greatest(value, 0e0), 1e0) AS dark FROM pixels)"
PROB = CLIPPED + filt("nm", "dark", "sm", 3, raster.gauss_weights()) + filt("sm", "sm", "lm", 15) + """, prob AS (SELECT scene_id, row, col, 1e0/(1e0 + exp(-((sm - lm - 0.05e0)*15e0))) AS prob FROM sm JOIN lm USING (scene_id, row, col))"""


def _prob(v: Views) -> DataFrame:
    return detect.probability(v.pixels.withColumn("norm", clamp(F.col("value"), 0, 1)).drop("value"))


@query(PX + DIMS + PROB + f"SELECT scene_id, row, col, {R('prob', 6)} AS prob FROM prob")
def spill_probability(v: Views) -> DataFrame:
    return out(_prob(v), "prob")


LOOK = ", " + SCENE_EXT_SQL + grad_sql("prob", "prob") + f""", lk AS (SELECT scene_id, count(*) AS n, avg(gradient) AS g FROM grad GROUP BY 1),
ls AS (SELECT scene_id, g, wind_mps, least((CASE WHEN wind_mps < 2.5 THEN 0.55e0 WHEN wind_mps > 12 THEN 0.25e0 ELSE 0e0 END) + (CASE WHEN n > 25 AND g < 0.08 THEN 0.2e0 ELSE 0e0 END), 0.95e0) AS p,
 concat_ws('|', CASE WHEN wind_mps < 2.5 THEN 'LOW_WIND_CALM_ZONE_SUSPECTED' WHEN wind_mps > 12 THEN 'HIGH_WIND_DISPERSION_SUSPECTED' END, CASE WHEN n > 25 AND g < 0.08 THEN 'FEATHERED_BOUNDARY_NATURAL_FILM_CANDIDATE' END) AS flags FROM lk JOIN scene_ext USING (scene_id))"""


@query(PX + DIMS + PROB + LOOK + f"SELECT scene_id, {R('g', 6)} AS mean_gradient, {R('p', 3)} AS lookalike_probability, p < 0.5 AS is_probable_spill, {R('p*0.4e0', 3)} AS confidence_penalty, flags FROM ls")
def lookalike_verdicts(v: Views) -> DataFrame:
    return detect.lookalike(_prob(v), v.scene_ext).drop("h", "w").withColumn("flags", F.array_join("flags", "|"))


MASKED = LOOK + f", mk AS (SELECT prob.scene_id, row, col, CASE WHEN p < 0.5 THEN prob ELSE greatest(prob - {R('p*0.4e0', 3)}, 0e0) END AS prob FROM prob JOIN ls USING (scene_id))"
CUT = 0.3


def _masked(v: Views) -> DataFrame:
    prob = cut_lineage(_prob(v).select("scene_id", "row", "col", "prob"))
    return detect.masks(detect.apply_penalty(prob, detect.lookalike(prob, v.scene_ext)), CUT)


@query(PX + DIMS + PROB + MASKED + f"SELECT scene_id, row, col, {R('prob', 6)} AS prob FROM mk")
def penalised_probability(v: Views) -> DataFrame:
    return out(_masked(v), "prob")


@query(PX + DIMS + PROB + MASKED + f"SELECT scene_id, count(*) FILTER (prob >= {CUT}) AS spill_pixel_count, {R(f'coalesce(avg(prob) FILTER (prob >= {CUT}), 0e0)', 6)} AS mean_spill_confidence FROM mk GROUP BY 1")
def mask_summary(v: Views) -> DataFrame:
    return detect.inference_summary(_masked(v)).withColumn("mean_spill_confidence", rnd(F.col("mean_spill_confidence"), 6))


def _labelled(v: Views) -> DataFrame:
    """Components of the dark half of each scene."""
    dark = v.pixels.select("scene_id", "row", "col", (F.col("value") < 0.45).cast("int").alias("mask"), (lit_f(1) - F.col("value")).alias("prob"))
    return components.components(dark)


# Runs of dark pixels, and labels that sink along touching runs until none changes.
LABELS = """, dk AS (SELECT scene_id, row, col, 1e0 - value AS prob, col - row_number() OVER (PARTITION BY scene_id, row ORDER BY col) AS island FROM pixels WHERE value < 0.45e0),
rn AS (SELECT scene_id, row, min(col) AS s, max(col) AS e, island, row * 4294967296 + min(col) AS node FROM dk GROUP BY scene_id, row, island),
ed AS (SELECT x.scene_id, x.node AS a, y.node AS b FROM rn x JOIN rn y ON y.scene_id = x.scene_id AND y.row = x.row + 1 AND y.s <= x.e + 1 AND y.e >= x.s - 1),
bo AS (SELECT scene_id, a, b FROM ed UNION ALL SELECT scene_id, b, a FROM ed),
lb(scene_id, node, label) USING KEY (scene_id, node) AS (SELECT scene_id, node, node FROM rn UNION
 SELECT bo.scene_id, bo.a, min(n.label) FROM bo JOIN lb n ON n.scene_id = bo.scene_id AND n.node = bo.b JOIN recurring.lb o ON o.scene_id = bo.scene_id AND o.node = bo.a WHERE n.label < o.label GROUP BY 1, 2),
px AS (SELECT dk.*, label AS component FROM dk JOIN rn USING (scene_id, row, island) JOIN lb USING (scene_id, node))"""
PIXEL_KM2 = "(abs(max_lon-min_lon)*(111.320e0*cos(radians((min_lat+max_lat)/2e0)))*(abs(max_lat-min_lat)*110.574e0)/(w*h))"


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query(recursive(PX + DIMS + BOUNDS_SQL + LABELS + f""", c AS (SELECT scene_id, component, count(*) AS pixels, avg(prob) AS p, min(row) AS min_row, max(row) AS max_row, min(col) AS min_col, max(col) AS max_col,
  avg(col) AS x, avg(row) AS y FROM px GROUP BY 1, 2), a AS (SELECT c.*, pixels * {PIXEL_KM2} AS area FROM c JOIN bounds USING (scene_id))
SELECT scene_id, component, pixels, {R('area', 4)} AS area_km2, {R('p', 4)} AS mean_prob, min_row, max_row, min_col, max_col, {R('x', 4)} AS cx, {R('y', 4)} AS cy FROM a WHERE area >= 0.01e0"""))
def mask_components(v: Views) -> DataFrame:
    figures = detect.component_figures(cut_lineage(_labelled(v)), _bounds(v), 0.01)
    return figures.select("scene_id", "component", "pixels", rnd(F.col("area_km2"), 4).alias("area_km2"), rnd(F.col("mean_prob"), 4).alias("mean_prob"),
                          "min_row", "max_row", "min_col", "max_col", rnd(F.col("cx"), 4).alias("cx"), rnd(F.col("cy"), 4).alias("cy"))


BOX = {"box_min_lon": "min_lon + (c0/w)*(max_lon-min_lon)", "box_max_lon": "min_lon + (c1/w)*(max_lon-min_lon)",
       "box_min_lat": "max_lat - (r1/h)*(max_lat-min_lat)", "box_max_lat": "max_lat - (r0/h)*(max_lat-min_lat)"}


@query(recursive(PX + DIMS + BOUNDS_SQL + LABELS + f""",
sq AS (SELECT scene_id, component, row - dr AS r, col - dc AS c, sum(bit) AS form FROM px, (VALUES (0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8)) o(dr, dc, bit) GROUP BY ALL),
ol AS (SELECT scene_id, component, count(*) FILTER (form IN (3, 5, 10, 12)) + (count(*) FILTER (form IN (1, 2, 4, 8, 7, 11, 13, 14)) + 2 * count(*) FILTER (form IN (6, 9))) * sqrt(0.5e0) AS steps FROM sq GROUP BY 1, 2),
c AS (SELECT scene_id, component, count(*) AS n, avg(prob) AS p, min(col) AS c0, max(col) AS c1, min(row) AS r0, max(row) AS r1, avg(col) AS x, avg(row) AS y, var_pop(col) AS vx, var_pop(row) AS vy, covar_pop(col, row) AS xy FROM px GROUP BY 1, 2),
sc AS (SELECT *, {PIXEL_KM2} AS px_area, (abs(max_lon-min_lon)*(111.320e0*cos(radians((min_lat+max_lat)/2e0)))/w + abs(max_lat-min_lat)*110.574e0/h)/2e0 AS px_km FROM bounds),
f AS (SELECT c.*, steps * px_km AS per, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, component) AS no FROM c JOIN ol USING (scene_id, component) JOIN sc USING (scene_id) WHERE n * px_area >= 0.01e0),
g AS (SELECT scene_id, count(*) AS components, avg(p) AS conf, sum(per) AS per, min(c0) AS c0, max(c1) AS c1, min(r0) AS r0, max(r1) AS r1, sum(x*n)/sum(n) AS cx, sum(y*n)/sum(n) AS cy,
  max(vx) FILTER (no = 1) AS vx, max(vy) FILTER (no = 1) AS vy, max(xy) FILTER (no = 1) AS xy FROM f GROUP BY 1),
k AS (SELECT g.*, sc.* EXCLUDE (scene_id), px_area * (SELECT count(*) FROM px WHERE px.scene_id = g.scene_id) AS area,
  4e0*sqrt((vx+vy)/2e0 + sqrt((vx-vy)*(vx-vy)/4e0 + xy*xy))*px_km AS major, 4e0*sqrt(greatest((vx+vy)/2e0 - sqrt((vx-vy)*(vx-vy)/4e0 + xy*xy), 0e0))*px_km AS minor FROM g JOIN sc USING (scene_id))
SELECT scene_id, components, {R('least(greatest(conf, 0.5e0), 0.99e0)', 3)} AS confidence, {R('area', 3)} AS area_km2, {R('per', 3)} AS perimeter_km, {R('major', 3)} AS major_axis_km, {R('minor', 3)} AS minor_axis_km,
  {R('degrees(atan2(2e0*xy, vx-vy)/2e0)', 1)} AS orientation_deg, {R(f'least(1e0, {4*math.pi!r}*area/greatest(per*per, 1e-5))', 3)} AS circularity, {R('major/greatest(minor, 1e-4)', 2)} AS elongation_ratio,
  CASE WHEN major/greatest(minor, 1e-4) > 3 THEN 'ELONGATED_SLICK' ELSE 'COMPACT_FORMATION' END AS compactness, {R('min_lon + (cx/w)*(max_lon-min_lon)', 5)} AS lon, {R('max_lat - (cy/h)*(max_lat-min_lat)', 5)} AS lat,
  {", ".join(f"{R(e, 6)} AS {n}" for n, e in BOX.items())} FROM k"""))
def slick_shapes(v: Views) -> DataFrame:
    lab, bounds = cut_lineage(_labelled(v)), _bounds(v)
    area = lab.groupBy("scene_id").agg(F.count("*").alias("mask_pixels"))
    shapes = detect.spill_figures(detect.component_figures(lab, bounds), detect.boundary_km(lab, bounds), area)
    return shapes.withColumns({c: rnd(F.col(c), 6) for c in BOX})


@query(sql_views("spills") + f"SELECT spill_id, {R(f'least(1e0, {4*math.pi!r}*area_km2/greatest(perimeter_km*perimeter_km, 1e-5))', 6)} AS circularity, CASE WHEN elongation > 3 THEN 'ELONGATED_SLICK' ELSE 'COMPACT_FORMATION' END AS compactness FROM spills")
def shape_class(v: Views) -> DataFrame:
    return v.spills.select("spill_id", rnd(radar.circularity(F.col("area_km2"), F.col("perimeter_km")), 6).alias("circularity"),
                           radar.compactness(F.col("elongation")).alias("compactness"))


CONF = """, cf AS (SELECT {g} count(*) FILTER (value >= 0.5 AND truth = 1) AS tp, count(*) FILTER (value >= 0.5 AND truth = 0) AS fp, count(*) FILTER (value < 0.5 AND truth = 0) AS tn, count(*) FILTER (value < 0.5 AND truth = 1) AS fn FROM pixels {b}),
mt AS (SELECT *, (tp+1e-7)/(tp+fp+1e-7) AS pr, (tp+1e-7)/(tp+fn+1e-7) AS rc FROM cf), ms AS (SELECT {g} tp, fp, tn, fn, """ + f"""{R('(tp+1e-7)/(tp+fp+fn+1e-7)', 4)} AS iou, {R('(2e0*tp+1e-7)/(2e0*tp+fp+fn+1e-7)', 4)} AS dice, {R('pr', 4)} AS precision, {R('rc', 4)} AS recall, {R('2e0*(pr*rc)/(pr+rc+1e-7)', 4)} AS f1 FROM mt)"""
PER_SCENE = CONF.format(g="scene_id,", b="GROUP BY scene_id")


def _judged(v: Views) -> DataFrame:
    keys = ["scene_id", "row", "col"]
    return evaluate.join_truth(v.pixels.select(*keys, "value"), v.pixels.select(*keys, "truth"))


@query(PX + PER_SCENE + "SELECT * FROM ms")
def scene_metrics(v: Views) -> DataFrame:
    return evaluate.scene_metrics(_judged(v))


@query(PX + CONF.format(g="", b="") + "SELECT * FROM ms")
def overall_metrics(v: Views) -> DataFrame:
    return evaluate.overall_metrics(_judged(v))


@query(PX + PER_SCENE + f""", sm AS (SELECT count(*) AS total_samples, {', '.join(R(f'avg({m})', 4) + f' AS mean_{m}' for m in ('iou', 'dice', 'precision', 'recall', 'f1'))},
 CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fn) AS BIGINT) AS fn FROM ms)
SELECT *, {R('(tp+tn)/(tp+fp+tn+fn)', 4)} AS pixel_accuracy, {R('tn/(tn+fp)', 4)} AS specificity FROM sm""")
def evaluation_report(v: Views) -> DataFrame:
    return evaluate.dataset_report(_judged(v))


@query(PX + f""", c AS (SELECT *, least(greatest(value, 1e-7), 1e0 - 1e-7) AS p FROM pixels),
l AS (SELECT scene_id, -avg(truth*ln(p) + (1e0 - truth)*ln(1e0 - p)) AS bce, 1e0 - (2e0*sum(value*truth) + 1e-7)/(sum(value) + sum(truth) + 1e-7) AS dice_loss FROM c GROUP BY 1)
SELECT scene_id, {R('bce', 6)} AS bce, {R('dice_loss', 6)} AS dice_loss, {R('0.5e0*bce + 0.5e0*dice_loss', 6)} AS combined FROM l""")
def segmentation_losses(v: Views) -> DataFrame:
    return evaluate.losses(_judged(v), ["scene_id"]).withColumns({c: rnd(F.col(c), 6) for c in ("bce", "dice_loss", "combined")})


@query(PX + DIMS + """, m AS (SELECT scene_id, row, col FROM pixels WHERE value < 0.6),
nb AS (SELECT unnest([0, -1, 1, 0, 0]) AS dr, unnest([0, 0, 0, -1, 1]) AS dc),
er AS (SELECT m.scene_id, m.row, m.col FROM m JOIN dims USING (scene_id), nb LEFT JOIN m n ON n.scene_id = m.scene_id AND n.row = m.row + dr AND n.col = m.col + dc
 GROUP BY 1, 2, 3 HAVING bool_and(n.row IS NOT NULL OR m.row + dr < 0 OR m.col + dc < 0 OR m.row + dr >= h OR m.col + dc >= w))
SELECT DISTINCT m.scene_id, m.row, m.col FROM m, nb JOIN er ON er.scene_id = m.scene_id AND er.row = m.row + dr AND er.col = m.col + dc""")
def opened_mask(v: Views) -> DataFrame:
    dark = v.pixels.select("scene_id", "row", "col", (F.col("value") < 0.6).cast("int").alias("mask"))
    return components.opened(dark, raster.scene_stats(v.pixels)).select("scene_id", "row", "col")
