"""Quality rules judged per document and per host, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: name -> (condition on the figures); a document fails a rule where it holds.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}
BASE_RULES = ("short", "repeats")


def _repeat_words(grams: Column) -> tuple[Column, Column]:
    """Words inside windows whose hash occurs twice or more, the first occurrence included."""
    placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    at = F.col("_placed")
    twice = F.transform(
        F.filter(F.transform(at, lambda x, j: F.struct(
            x["i"].alias("i"),
            (F.get(at, j - 1)["g"].eqNullSafe(x["g"]) | F.get(at, j + 1)["g"].eqNullSafe(x["g"])).alias("on"))), lambda x: x["on"]),
        lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    return placed, F.size(F.array_distinct(F.flatten(twice)))


def figures(docs: DataFrame, text: str, host: Column, carry: list[str]) -> DataFrame:
    """``carry`` columns of ``docs`` in struct ``_row`` with host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are runs outside ASCII white space; lines are parted by line feeds and count when
    they have a word.  The text without any repeated window, which is the usual one, is told
    by a set of hashes; only the others are sorted.  A null text has no words.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(F.struct(*carry).alias("_row"), host.alias("host"), F.filter(F.split(whole, SPACE), lambda w: w != "").alias("_words"), lines.alias("_lines"),
                       F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    step = step.select(
        "_row", "host", "n_symbols", F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"))
    # Triples line up three shifted views of the words; the two last entries are no windows.
    triples = F.transform(F.slice(F.col("_h"), F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0))),
                          lambda h, i: F.xxhash64(h, F.get(F.col("_h"), i + 1), F.get(F.col("_h"), i + 2)))
    step = step.withColumn("_grams", triples).drop("_h")
    step = step.withColumn("_once", F.size(F.array_distinct("_grams")) == F.size("_grams"))
    placed, count = _repeat_words(F.col("_grams"))
    step = step.withColumn("_placed", F.when(~F.col("_once"), placed)).withColumn(
        "n_repeat_words", F.when(F.col("_once"), F.lit(0)).otherwise(count).cast("long"))
    return step.drop("_grams", "_placed", "_once")


def judged(docs: DataFrame, host: Column | str = "source", text: str = "text", max_rate: float = 0.5,
           carry: list[str] | None = None) -> DataFrame:
    """Struct ``_row`` of ``docs`` (or of its ``carry`` columns) with host, the figures, base_failed, failed (rule names), host_rate, host_failed, kept.

    A host's rate of documents that fail some rule is shrunk towards the mean over hosts by
    a beta prior fitted to the hosts' rates by moments, so that a host of few documents is
    not condemned by chance.  A host is rejected when the shrunk rate of *any* one rule
    exceeds ``max_rate``; its documents go with it, others go only by the base rules.
    Documents without a host form one host of their own.  Empty tables give an empty result.
    The figures are written once to the shared folder because the hosts' totals and the
    documents both need them.
    """
    name = F.col(host) if isinstance(host, str) else host
    measured = cut_lineage(_ruled(docs, name, text, carry or docs.columns))
    return _with_verdicts(measured, host_verdicts(measured, max_rate))


def _ruled(docs: DataFrame, host: Column, text: str, carry: list[str]) -> DataFrame:
    measured = figures(docs, text, host, carry)
    measured = measured.select("*", F.array_compact(F.array(*[F.when(F.expr(c), F.lit(r)) for r, c in RULES.items()])).alias("failed"))
    return measured.withColumn("base_failed", F.arrays_overlap("failed", F.array(*[F.lit(r) for r in BASE_RULES])))


def _with_verdicts(measured: DataFrame, hosts: DataFrame) -> DataFrame:
    """Written first, the hosts' table has its real size, by which Spark sends or shuffles it."""
    hosts = cut_lineage(hosts)
    out = measured.join(hosts, measured["host"].eqNullSafe(hosts["_name"]), "left").drop("_name")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def host_verdicts(measured: DataFrame, max_rate: float) -> DataFrame:
    """(_name, host_rate, host_failed): the largest shrunk rate over the rules, and the verdict."""
    rules = list(RULES)
    counts = measured.groupBy("host").agg(F.count("*").alias("n"), *[
        F.sum(F.array_contains("failed", r).cast("long")).alias(r) for r in rules])
    rate = {r: F.col(r) / F.col("n") for r in rules}
    moments = counts.agg(*[F.avg(rate[r]).alias(f"m_{r}") for r in rules],
                         *[F.coalesce(F.var_samp(rate[r]), F.lit(0.0)).alias(f"v_{r}") for r in rules],
                         F.avg(1 / F.col("n")).alias("_thin")).withColumn("_one", F.lit(1))
    # One row whatever the data, so it may be broadcast.
    both = counts.withColumn("_one", F.lit(1)).join(F.broadcast(moments), "_one")
    shrunk = []
    for r in rules:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        # Part of the spread is chance within hosts; what is left is the prior's variance.
        inner = m * (1 - m)
        between = F.greatest(v - inner * F.col("_thin"), inner * 1e-3)
        strength = F.when(inner > 0, F.greatest(inner / between - 1, F.lit(1.0))).otherwise(F.lit(1.0))
        shrunk.append((F.col(r) + m * strength) / (F.col("n") + strength))
    top = F.greatest(*shrunk)
    return both.select(F.col("host").alias("_name"), top.alias("host_rate"), (top > max_rate).alias("host_failed"))


def passing(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    return judged(docs, host, text, max_rate).filter("kept").select(*[F.col(f"_row.{c}").alias(c) for c in docs.columns])
