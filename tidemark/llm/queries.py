"""Queries of the training-data operators over the given tables, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    chat, chunk_dedup, collocations, hilbert, host_rules, itq, lattice, ngram_join, packing, ppm, resampling, revisits, suffix_index,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op1_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


_ESC = r"""replace(replace(replace(coalesce({0}, ''), '\', '\b'), '<', '\l'), '"', '\q')"""


@query(rf"""
WITH m AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (SELECT *, '<turn role="' || {_ESC.format('role')} || '">' || {_ESC.format('text')} || '</turn>' || chr(10) AS piece FROM m),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, piece) AS turns,
    coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, piece) FILTER (role = 'assistant'), '') AS loss,
    string_agg(piece, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, piece) AS formatted
  FROM p GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(length(formatted) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments FROM c""")
def op2_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = rows.select("conv_id", "turn", "role", F.array(chat.text_part(F.col("text"))).alias("parts"))
    back = chat.read_back(chat.formatted_chats(messages))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"))


def _rate_sql(rule: str) -> str:
    inner = f"(m_{rule} * (1 - m_{rule}))"
    between = f"greatest(v_{rule} - {inner} * thin, {inner} * 1e-3)"
    strength = f"(CASE WHEN {inner} > 0 THEN greatest({inner} / {between} - 1, 1e0) ELSE 1e0 END)"
    return f"({rule} + m_{rule} * {strength}) / (n + {strength})"


HOST_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
l AS (SELECT doc_id, source, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM d),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM h WHERE c > 1) GROUP BY doc_id),
f AS (
  SELECT l.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM l LEFT JOIN r ON r.doc_id = l.doc_id),
x AS (SELECT *, {", ".join(f"CAST({c} AS INT) AS {r}" for r, c in host_rules.RULES.items())} FROM f),
s AS (SELECT source, count(*) AS n, {", ".join(f"sum({r}) AS {r}" for r in host_rules.RULES)} FROM x GROUP BY source),
m AS (SELECT {", ".join(f"avg({r} / n) AS m_{r}, coalesce(var_samp({r} / n), 0) AS v_{r}" for r in host_rules.RULES)}, avg(1 / n) AS thin FROM s),
v AS (SELECT source, greatest({", ".join(_rate_sql(r) for r in host_rules.RULES)}) > 0.5 AS bad FROM s, m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short + repeats > 0 AS base_failed, short + repeats = 0 AND NOT bad AS kept
FROM x JOIN v ON v.source IS NOT DISTINCT FROM x.source"""


@query(HOST_SQL)
def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = host_rules.judged(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return told.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op4_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_index.repeated_removed(table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query()
def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    pieces = lattice.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    coded = lattice.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces)
    return lattice.with_round_trip(coded, pieces).select("row.doc_id", "n_ids", "ids", "round_trip")


@query()
def op6_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.document_shards(table(spark, sf_dir, "documents"))


@query()
def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.log_scores(table(spark, sf_dir, "documents"))


@query()
def op8_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query(rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS grams FROM d),
nodes AS (SELECT grams, min(doc_id) AS rep, count(*) AS size FROM s GROUP BY grams),
e AS (SELECT rep, unnest(grams) AS g, len(grams) AS n FROM nodes),
pairs AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE c >= 0.8 * (na + nb - c) - 1e-9),
reach AS (SELECT rep AS a, rep AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
named AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
counted AS (SELECT a AS rep, count(*) AS n_links FROM links GROUP BY a),
sized AS (SELECT class_id, CAST(sum(size) AS BIGINT) AS group_size FROM named JOIN nodes USING (rep) GROUP BY class_id)
SELECT s.doc_id, named.class_id, nodes.rep AS copy_of, coalesce(n_links, 0) AS n_links, group_size
FROM s JOIN nodes USING (grams) JOIN named USING (rep) JOIN sized USING (class_id) LEFT JOIN counted USING (rep)""")
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture records derived from ``pages``: a response for each page and a later or earlier revisit."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("bytes"), F.md5(F.coalesce("html", F.lit(""))).alias("md5"),
        F.expr("1704067200 + (page_id * 7919 % 100003) * 60").alias("at"))
    tag = F.concat(F.lit('"'), "md5", F.lit('"'))
    four = F.col("page_id") % 4
    modified = F.concat(F.lit("t"), F.col("at").cast("string"))
    stored = F.map_filter(F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("bytes"), F.lit("Last-Modified"), modified,
        F.lit("ETag"), F.when(four != 3, tag)), lambda _, v: v.isNotNull())
    fresh = F.map_filter(F.create_map(
        F.lit("Date"), F.col("later").cast("string"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("Connection"), F.lit("close"), F.lit("content-length"), F.lit("0"),
        F.lit("etag"), F.when(four == 0, F.concat(F.lit("W/"), tag)).when(four == 1, tag).when(four == 2, F.lit('"other"')),
        F.lit("last-modified"), F.when(F.col("page_id") % 8 == 3, modified)), lambda _, v: v.isNotNull())
    kinds = pages.withColumn("later", F.expr("at + (page_id % 5 - 1) * 3600"))
    full = kinds.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", F.timestamp_seconds("at").alias("date"),
                        F.when(F.col("page_id") % 10 == 9, 404).otherwise(200).alias("status"), stored.alias("headers"))
    again = kinds.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat("url", F.lit("#again")).alias("url"),
                         F.timestamp_seconds("later").alias("date"), F.lit(304).alias("status"), fresh.alias("headers"))
    return full.unionByName(again)


@query(rf"""
WITH p AS (
  SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS bytes, '"' || md5(coalesce(html, '')) || '"' AS tag, 1704067200 + (page_id * 7919 % 100003) * 60 AS sec FROM pages),
q AS (SELECT *, sec + (page_id % 5 - 1) * 3600 AS later, 't' || sec AS modified,
  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM p),
u AS (SELECT *, regexp_extract(bare, '^[^/?]*') AS host0, regexp_replace(bare, '^[^/?]*', '') AS rest FROM q),
v AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(host0, '^.*@', '')), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_replace(rest, '\?.*$', ''), '/+$', '') AS place,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{revisits.VISIT}'))), '&') AS params FROM u),
c AS (SELECT *, place || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS canonical_url FROM v),
f AS (SELECT canonical_url, sec, page_id * 2 AS record_id, CASE WHEN page_id % 4 <> 3 THEN tag END AS etag, modified, bytes FROM c WHERE page_id % 10 <> 9 AND canonical_url IS NOT NULL),
a AS (SELECT page_id * 2 + 1 AS record_id, canonical_url, later, CASE page_id % 4 WHEN 0 THEN 'W/' || tag WHEN 1 THEN tag WHEN 2 THEN '"other"' END AS etag,
  CASE WHEN page_id % 8 = 3 THEN modified END AS modified FROM c),
j AS (SELECT a.*, f.record_id AS found, f.etag AS f_etag, f.modified AS f_modified, f.bytes,
    row_number() OVER (PARTITION BY a.record_id ORDER BY f.sec DESC, f.record_id DESC) AS rn
  FROM a LEFT JOIN f ON f.canonical_url = a.canonical_url AND f.sec < a.later),
t AS (SELECT *, CASE WHEN found IS NULL THEN 'no_earlier_response' WHEN etag IS NULL AND modified IS NULL THEN 'no_validator'
    WHEN etag IS NOT NULL AND regexp_replace(etag, '^W/', '') IS NOT DISTINCT FROM regexp_replace(f_etag, '^W/', '') THEN 'resolved'
    WHEN etag IS NULL AND modified IS NOT DISTINCT FROM f_modified THEN 'resolved' ELSE 'validator_mismatch' END AS verdict FROM j WHERE rn = 1)
SELECT record_id, canonical_url, CASE WHEN verdict = 'resolved' THEN found END AS refers_to, verdict,
  CASE WHEN verdict = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || bytes || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || later || chr(10) || coalesce('etag: ' || coalesce(etag, f_etag) || chr(10), '') || 'last-modified: ' || coalesce(modified, f_modified) END AS headers
FROM t""")
def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = revisits.resolved_revisits(captures(spark, sf_dir))
    lines = F.array_join(F.transform("headers", lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return done.select("record_id", "canonical_url", "refers_to", "verdict", lines.alias("headers"))


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
o AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws, i, unnest([1, 2, 3]) AS k FROM o),
c AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g WHERE i + k - 1 <= len(ws) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
d AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS v FROM c WHERE k > 1 AND f >= 10),
cuts AS (SELECT d.*, unnest(CASE k WHEN 2 THEN [1] ELSE [1, 2] END) AS h FROM d),
parts AS (SELECT *, array_to_string(v[1:h], ' ') AS front, array_to_string(v[h + 1:k], ' ') AS back FROM cuts),
scored AS (
  SELECT parts.*, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * parts.a * parts.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM parts JOIN c x ON x.lang = parts.lang AND x.phrase = front JOIN c y ON y.lang = parts.lang AND y.phrase = back),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) AS pick FROM scored),
inner_parts AS (
  SELECT lang, array_to_string(v[1:2], ' ') AS phrase, a FROM d WHERE k = 3 UNION ALL SELECT lang, array_to_string(v[2:3], ' ') AS phrase, a FROM d WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS whole FROM inner_parts GROUP BY lang, phrase),
kept AS (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE b.pick = 1 AND (o.whole IS NULL OR 100 * o.whole < 50 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("""
WITH RECURSIVE v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
able AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
named AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT named.vec_id, coalesce(n_links, 0) AS n_links, component_id, named.vec_id = component_id AS kept
FROM named LEFT JOIN counted ON counted.vec_id = named.vec_id""")
def op12_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


_CRC_STEP = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"


def _feature_words(name: str, key: str) -> str:
    return rf"SELECT {key} AS id, list_filter(string_split_regex({LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM {name}"


@query(rf"""
WITH steps AS (SELECT i, list_reduce([CAST(i AS BIGINT)] || [CAST(x AS BIGINT) FOR x IN range(8)], lambda a, x: {_CRC_STEP}) AS v FROM range(256) t(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM steps),
d AS ({_feature_words("documents", "doc_id")}),
b AS ({_feature_words("benchmark", "item_id")}),
dw AS (SELECT id, unnest(ws) AS w FROM d), bw AS (SELECT id, unnest(ws) AS w FROM b),
every AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
h AS (SELECT w, hex(encode(w)) AS h FROM every),
coded AS (
  SELECT w, xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(('0x' || substr(h, 2 * k + 1, 2)) AS BIGINT) FOR k IN range(length(h) // 2)],
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN coded ON coded.w = dw.w GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN coded ON coded.w = bw.w GROUP BY bucket),
totals AS (SELECT CAST((SELECT count(*) FROM dw) + 10000 AS DOUBLE) AS raw, CAST((SELECT count(*) FROM bw) + 10000 AS DOUBLE) AS target),
gains AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + CAST(1 AS DOUBLE)) * raw / ((s.s + CAST(1 AS DOUBLE)) * target))) AS BIGINT) AS gain
  FROM s LEFT JOIN t ON t.bucket = s.bucket, totals),
sums AS (SELECT id, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n FROM dw JOIN coded ON coded.w = dw.w JOIN gains ON gains.bucket = coded.bucket GROUP BY id),
x AS (
  SELECT d.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_features,
    CASE WHEN sums.n IS NULL THEN 0 ELSE (total - ((total % sums.n) + sums.n) % sums.n) // sums.n END AS weight,
    CAST(('0x' || substr(sha256('2024:' || d.id), 1, 8)) AS BIGINT) AS h
  FROM d LEFT JOIN sums ON sums.id = d.id),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM y LEFT JOIN z ON z.doc_id = y.doc_id""")
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
