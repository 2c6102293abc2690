"""Sharding, scoring, packing and the lattice against plain Python."""

import math
import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import hilbert, lattice, packing, ppm

TEXTS = [None, "", "the cat The CAT sat", "é ü\nthe dog", "a" * 700, "x y z " * 900, "the cat The CAT sat"]


def documents(spark):
    return spark.createDataFrame([(i if i else None, t, "s", "l", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, lang string, slot int")


def test_curve_visits_neighbours(spark):
    cells = spark.range(512).select((F.col("id") % 8).alias("x"), (F.floor(F.col("id") / 8) % 8).alias("y"), F.floor(F.col("id") / 64).alias("z"))
    rows = cells.select("x", "y", "z", hilbert.hilbert_index([F.col(c) for c in "xyz"], 3).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(512))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_are_even_and_gapless(spark):
    rows = hilbert.document_shards(documents(spark), shards=3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, by.values())) == [2, 2, 3] and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 1 for t in TEXTS)


def test_base_score(spark):
    got = {r.doc_id: r for r in ppm.log_scores(documents(spark), table_words=2).collect()}
    def tokens(t):
        return [w.lower() if w.isascii() else w for w in (t or "").split()] + [None]
    count = {}
    for i, t in enumerate(TEXTS):
        if zlib.crc32(str(i if i else "").encode()) % 7 != 2:
            for w in tokens(t):
                count[w] = count.get(w, 0) + 1
    total = sum(count.values())
    for i, t in enumerate(TEXTS):
        r = got[i if i else None]
        want = sum(math.log10((count.get(w, 0) + 1) / (total + len(count) + 1)) for w in tokens(t))
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(tokens(t)), total, sum(w in count for w in tokens(t)))
        assert abs(r.base_score - want) < 1e-9 and r.score <= 0


def test_packing_is_whole_and_gapless(spark):
    rows = packing.packed_documents(documents(spark), public_tokenizers.path("word_bpe_49k.json"), most=64, with_ids=True).collect()
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in enumerate(TEXTS):
        mine = sorted((r for r in rows if r.doc_id == (i if i else None)), key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == coder.encode(t or "", add_special_tokens=False).ids + [1]
    packs = {}
    for r in rows:
        packs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in packs.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(n for _, n in p) <= 64


def test_lattice_equals_plain_pass_and_decodes(spark):
    pieces = lattice.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    table = {r["piece"]: (r["score"], r["id"]) for r in pieces.filter("NOT is_byte").collect()}
    low, longest = min(s for s, _ in table.values()) - lattice.PENALTY, max(map(len, table))
    first = pieces.filter("is_byte").agg(F.min("id")).first()[0]
    rows = lattice.with_round_trip(lattice.encoded(documents(spark), pieces, block=40), pieces).collect()
    assert len(rows) == len(TEXTS)
    assert lattice.with_round_trip(lattice.encoded(documents(spark).limit(0), pieces), pieces).collect() == []
    for r in rows:
        whole = lattice.MARK + r.text.replace(" ", lattice.MARK) if r.text else ""
        assert r.round_trip
        if len(whole) < 60:
            assert list(r.ids) == lattice.viterbi(whole, table, longest, low, first)


def test_lattice_ids_are_the_library_s(spark):
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(150).collect()
    texts = [t for t in TEXTS if t is not None] + [r.text or "" for r in kept] + [
        "  two  spaces ", " ", "▁x", "\tx\r\n\r\ny", "abcabcabc" * 400, "日本語" * 300, "é \U0001f600 " * 90, "the" * 85, "x" * 256, "x" * 257]
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(3)
    pieces = lattice.piece_table(spark, path)
    for settings in ({}, {"block": 700}):
        rows = lattice.with_round_trip(lattice.encoded(docs, pieces, **settings), pieces).collect()
        assert sorted(r.row.n for r in rows) == list(range(len(texts)))
        for r in rows:
            assert list(r.ids) == model.encode(texts[r.row.n]), texts[r.row.n][:80]
            assert r.n_ids == len(r.ids) and r.round_trip == (model.decode(list(r.ids)) == texts[r.row.n])


def test_lattice_moves_and_writes_no_text(spark):
    """Texts and units used to be written and exchanged, 1.07 GB of disk and more over 0.51 GB of documents."""
    pieces = lattice.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    rows = lattice.with_round_trip(lattice.encoded(documents(spark), pieces), pieces)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.replace("BroadcastExchange", "").count("Exchange") == 0
    assert "parquet" not in plan.lower() and rows.count() == len(TEXTS)


def test_substrings_and_fold_in_small_chunks(monkeypatch):
    """Against sets of substrings and the pass with a heap, also where one slot holds several pieces."""
    words = ["ab", "abc", "b", "a", " a", " ", "é", "ca", "aa", "bca", "日", "日本", "aab"]
    pieces = {w: (-i, i + 300) for i, w in enumerate(words)}
    units = [" ab", " abcabcab", "é日本日", " ", "x", " aaaaaab" * 30, "\U0001f600a", " bca", "日本" * 200]
    for chunk, bits in ((1 << 17, 18), (10, 18), (10, 3)):
        monkeypatch.setattr(lattice, "CHUNK", chunk)
        monkeypatch.setattr(lattice, "MARKS", bits)
        monkeypatch.setattr(lattice, "SLOTS", bits)
        table = lattice.Words(pa.array(words), 3)
        got = lattice.substrings(pa.array(units), 3, table.may).to_pylist()
        spans = {u[i:j] for u in units for i in range(len(u)) for j in range(i + 1, min(len(u), i + 3) + 1)}
        assert len(got) == len(set(got)) and spans & set(words) <= set(got) <= spans
        met = [w for w in words if w in got]
        found = pa.table({"piece": met, "id": pa.array([pieces[w][1] for w in met], pa.int32()), "rank": pa.array([-pieces[w][0] for w in met], pa.int32())})
        ids, limits = lattice.unit_ids(pa.array(units), found, 3, 3)
        assert [ids[a:b].tolist() for a, b in zip(limits, limits[1:])] == [lattice.merged(u, pieces, 3) for u in units]


def test_lattice_blocks_end_anywhere(spark):
    """Blocks of one row, of a few rows and of all rows, in one partition and in many batches."""
    pieces = lattice.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.range(300, numPartitions=2).select(F.col("id").alias("piece"), F.concat(F.lit("the cat "), F.col("id") % 7, F.lit(" sat")).alias("text"))
    docs = docs.withColumn("text", F.when(F.col("piece") % 11 > 0, F.col("text")))
    want = None
    for size in (1, 40, 1 << 20):
        rows = lattice.with_round_trip(lattice.encoded(docs, pieces, block=size), pieces).collect()
        assert all(r.round_trip for r in rows)
        got = sorted((r.row.piece, r.text, tuple(r.ids)) for r in rows)
        assert len(got) == 300 and got == (want or got)
        want = got


def test_lattice_query_covers_all_documents(spark):
    from tidemark.llm.queries import op5_lattice
    rows = op5_lattice(spark, "/root/testdata/sf0.001").select("doc_id", "n_ids", "round_trip").collect()
    want = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in want) and all(r.round_trip for r in rows)
    assert {r.doc_id for r in rows if r.n_ids == 0} == {r.doc_id for r in want if not r.text}
