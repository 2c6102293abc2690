"""Every operator over documents on odd tables: null, text and repeated keys, equal rows, clashing names, nothing at all."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chunk_dedup, collocations, hilbert, host_rules, lattice, ngram_join, packing, ppm, resampling, suffix_index

PASSAGE = "a passage of many words that comes again and again, in this text and in that one, " * 5
TEXTS = [None, "", "one", PASSAGE + "first", PASSAGE + "second", PASSAGE + "first", "é " * 300, "word " * 60]
CLASHING = "_null string, _row int, key string, n int, row int, kept string, size int, rank int, shard int, absent int"


def table(spark, kind):
    keys = {"long": [1, 2, 3, 4, 5, 6, 7, 8], "string": list("abcdefgh"), "null": [None] * 8, "equal": [7] * 8, "rows": [4] * 8, "empty": []}[kind]
    texts = [PASSAGE] * 8 if kind == "rows" else TEXTS
    rows = [(k, t, "fr", "src", len(t or ""), "x", 1, None, 2, 3, "y", 4, 5, 6, 7) for k, t in zip(keys, texts)]
    key_type = "string" if kind == "string" else "bigint"
    return spark.createDataFrame(rows, f"doc_id {key_type}, text string, lang string, source string, n_chars bigint, {CLASHING}").repartition(3)


def packed(docs):
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def coded(docs):
    pieces = lattice.piece_table(docs.sparkSession, public_tokenizers.path("piece_bpe_32k.model"))
    return lattice.encoded(docs, pieces)


ONE_ROW_EACH = {
    "op1": chunk_dedup.exact_duplicates, "op3": lambda d: host_rules.judged(d, carry=["doc_id"]), "op4": suffix_index.repeated_removed, "op5": coded,
    "op6": hilbert.document_shards, "op7": ppm.log_scores, "op9": ngram_join.similar_groups,
    "op13": lambda d: resampling.importance_sample(d, d),
}


@pytest.mark.parametrize("kind", ["long", "string", "null", "equal", "rows", "empty"])
@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_for_each(spark, name, kind):
    docs = table(spark, kind)
    assert len(ONE_ROW_EACH[name](docs).collect()) == docs.count()


@pytest.mark.parametrize("kind", ["string", "null", "rows", "empty"])
def test_pieces_and_phrases(spark, kind):
    docs = table(spark, kind)
    pieces = packed(docs).collect()
    assert sum(r.start == 0 for r in pieces) == docs.count()
    phrases = {r.phrase: r.a for r in collocations.collocations(docs, least=8).collect()}
    # "again and" lies inside longer phrases that are as frequent, so only these stay.
    assert phrases == {} if kind == "empty" else "again and" not in phrases and phrases["again and again"] >= 8


@pytest.mark.parametrize("kind", ["string", "null", "rows", "empty"])
def test_stages_keep_the_columns(spark, kind):
    docs = table(spark, kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count() and (name != "passages" or out.count() == docs.count())


def test_passages_of_text_keys(spark):
    """The same cuts, whatever the keys are."""
    want = None
    for kind in ("long", "string", "null"):
        got = sorted((r.text or "") for r in suffix_index.without_repeats(table(spark, kind)).collect())
        want = want or got
        assert got == want
    assert all(PASSAGE not in t for t in want)


def test_passages_of_clashing_columns(spark):
    rows = suffix_index.without_repeats(table(spark, "long")).orderBy("doc_id").collect()
    assert [(r._null, r.absent, r.kept, r.rank) for r in rows] == [("x", 7, "y", 5)] * 8
    assert rows[0].text is None and rows[1].text == ""


def test_shards_of_odd_keys(spark):
    for kind in ("string", "null", "equal", "rows"):
        got = sorted((r.shard, r.slot) for r in hilbert.document_shards(table(spark, kind), shards=4).collect())
        assert got == [(s, i) for s in range(4) for i in range(2)]


def test_shard_bounds_prune(spark):
    """Shards are runs of the curve: a reader that asks for few sizes may skip most of them."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 7919 % 4000).cast("int")).alias("text"),
                                    (F.col("id") % 4).cast("string").alias("source"), F.lit("en").alias("lang"))
    sharded = hilbert.document_shards(docs, shards=16)
    bounds = hilbert.shard_bounds(sharded, ["size", "doc_id"]).collect()
    assert sorted(b.shard for b in bounds) == list(range(16)) and {b.rows for b in bounds} == {250}
    for low, high in ((0, 300), (1800, 2100), (3900, 4001)):
        may = {b.shard for b in bounds if b.min_size <= high and b.max_size >= low}
        has = {r.shard for r in sharded.filter(F.col("size").between(low, high)).select("shard").distinct().collect()}
        assert has <= may and len(may) <= 13
