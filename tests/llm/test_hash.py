"""Words that collide for every odd base modulo 2**64: Thue-Morse words and their complements."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import ngram_join, packing, ppm, suffix_index
from tidemark.llm.bytescan import Hasher, distinct_slices


def morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.fixture(params=[1024, 2048, 4096])
def pair(request):
    return morse(request.param)


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_slices_differ(pair):
    n = len(pair[0])
    data = np.frombuffer("".join(pair).encode(), np.uint8)
    for seed in range(12):
        a, b = Hasher(data, seed).slices(np.array([0, n]), np.array([n, 2 * n]))
        assert a != b


def test_distinct_slices_settles_by_bytes(monkeypatch):
    # With a hash that tells nothing apart, bytes alone decide.
    monkeypatch.setattr(Hasher, "slices", lambda self, start, end: np.zeros(len(start), np.uint64))
    data = np.frombuffer(b"abcabdabcab", np.uint8)
    start, end = np.array([0, 3, 6, 9, 3, 0]), np.array([3, 6, 9, 11, 6, 2])
    first, back = distinct_slices(data, start, end)
    told = [data[start[first[k]]:end[first[k]]].tobytes() for k in back]
    assert told == [data[a:b].tobytes() for a, b in zip(start, end)] and len(first) == 3


def test_packing_ids(spark, pair):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.packed_documents(table(spark, pair).coalesce(1), public_tokenizers.path("word_bpe_49k.json"), with_ids=True).collect()
    for i, text in enumerate(pair, 1):
        want = coder.encode(text, add_special_tokens=False).ids + [1]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == want
        assert mine[0].ids_crc32 == zlib.crc32(np.array(mine[0].ids, "<u4").tobytes())


def test_similar_groups_keep_both(spark, pair):
    a, b = (f"a normal sentence around {w} and its end" for w in pair)
    docs = table(spark, [*pair, a, b]).coalesce(1)
    assert sorted(r.doc_id for r in ngram_join.one_of_each_group(docs).collect()) == [1, 2, 3, 4]
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_groups(docs).collect()} == {i: (i, 0) for i in range(1, 5)}


def test_unseen_word_is_unknown(spark, pair):
    # Keys 1 to 9 are learned from unless their crc32 leaves 2.
    learn = next(k for k in range(1, 60) if zlib.crc32(str(k).encode()) % 7 != 2)
    held = next(k for k in range(1, 60) if zlib.crc32(str(k).encode()) % 7 == 2)
    docs = spark.createDataFrame([(learn, pair[0]), (held, pair[1])], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in ppm.log_scores(docs).collect()}
    assert rows[held].n_known == 1 and rows[learn].n_known == 2


def test_repeated_windows(spark, pair):
    texts = [w[:700] for w in pair]
    windows = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - 199):
            windows.setdefault(t[p:p + 200], []).append((i, p))
    gone = [set(), set()]
    for places in windows.values():
        if len(places) > 1:
            for i, p in places:
                gone[i].update(range(p, p + 200))
    rows = suffix_index.repeated_removed(table(spark, texts)).select("row.doc_id", "n_removed").collect()
    assert {r.doc_id: r.n_removed for r in rows} == {1: len(gone[0]), 2: len(gone[1])}
