"""Import of position records: clean, register new vessels, append."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ais import CleanRules, clean_positions, new_vessels, with_ids
from tidemark.sources.positions import append_positions, csv_by_header
from tidemark.sources.scratch import cut_lineage


def clean_csv(spark: SparkSession, path: str, rules: CleanRules = CleanRules(), multi_line: bool = False) -> DataFrame:
    """Accepted records of CSV files that may differ in their headers."""
    tables = [clean_positions(t, rules) for t in csv_by_header(spark, path, multi_line)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def import_positions(raw: DataFrame, vessels: DataFrame, store: str, seq: str, rules: CleanRules = CleanRules(),
                     batch: str | None = None) -> tuple[DataFrame, Observation]:
    """Append accepted records to ``store``, ready for analysis, and give the vessels to add.

    Records are parsed once.  An import repeated under the same ``batch`` name counts once.  ``seq`` orders them over all imports.  Record and (approximate)
    vessel counts come from the write itself through the returned observation; exact vessel
    counts are in ``ais.import_summary``.
    """
    clean = cut_lineage(with_ids(clean_positions(raw, rules), seq))
    seen = Observation("import")
    watched = clean.observe(seen, F.count("*").alias("imported_records"), F.approx_count_distinct("mmsi").alias("vessels_updated"))
    append_positions(watched, store, batch)
    return new_vessels(clean, vessels, seq), seen
