"""The pipeline as a whole against plain Python, stage by stage, on a small table."""

import random
import re
import statistics
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from tidemark.llm import packing

from .test_near import brute as brute_near

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good(rows):
    """Quality rules and host verdicts."""
    failed, hosts = {}, {}
    for i, text, host in rows:
        t = text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(zip(w, w[1:], w[2:]))
        twice = {k for j, g in enumerate(zip(w, w[1:], w[2:])) if windows[g] > 1 for k in (j, j + 1, j + 2)}
        chars = sum(map(len, w))
        failed[i] = (len(w) < 50, 100 * len(twice) > 50 * len(w), 10 * len(re.findall(r"[#*$%&|<>]", t)) > len(w),
                     10 * (len(lines) - len(set(lines))) > 3 * len(lines), chars < 3 * len(w) or chars > 12 * len(w))
        hosts.setdefault(host, []).append(failed[i])
    bad = set()
    thin = statistics.mean(1 / len(f) for f in hosts.values())
    for rule in range(5):
        rates = [sum(x[rule] for x in f) / len(f) for f in hosts.values()]
        mean = statistics.mean(rates)
        inner = mean * (1 - mean)
        strength = 1.0
        if inner > 0:
            strength = max(1.0, inner / max(statistics.variance(rates) - inner * thin, inner * 1e-3) - 1)
        bad |= {h for h, f in hosts.items() if (sum(x[rule] for x in f) + mean * strength) / (len(f) + strength) > 0.5}
    return [r for r in rows if not failed[r[0]][0] and not failed[r[0]][1] and r[2] not in bad]


def last_of_equal(rows):
    last = {t: max(i for i, u, _ in rows if u == t) for _, t, _ in rows}
    return [r for r in rows if last[r[1]] == r[0]]


def first_of_similar(rows):
    told = brute_near([(i, t) for i, t, _ in rows])
    return [r for r in rows if told[r[0]][0] == r[0]]


def without_passages(rows, length=200):
    raw = [t.encode() for _, t, _ in rows]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (key, _, host), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out.append((key, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore"), host))
    return out


def pieces(rows):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for key, text, _ in rows:
        ids = np.array(coder.encode(text, add_special_tokens=False).ids + [1], "<u4")
        for a in range(0, len(ids), 2048):
            part = ids[a:a + 2048]
            yield key, a, len(part), zlib.crc32(part.tobytes()), len(ids)


def made():
    rng = random.Random(12)
    def text(n):
        return " ".join("".join(rng.choice("abcdeghilmnorstuéü") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    shared = text(70)
    rows = [(text(rng.randrange(60, 260)), "fair.example") for _ in range(25)]
    rows += [(f"{text(60)} {shared}\n{text(60)}", "fair.example") for _ in range(6)]
    rows += [(rows[3][0], "fair.example")] * 4 + [(rows[5][0], None)] * 2
    base = text(200).split()
    for _ in range(5):
        edited = list(base)
        edited[rng.randrange(200)] = "edited" + str(rng.randrange(9))
        rows.append((" ".join(edited), "other.example"))
    rows += [(text(4000), "other.example"), (text(80), None), (text(40), "other.example"), ("one two three " * 60, "other.example")]
    rows += [(None, None), ("", "fair.example"), (" \n\t", "other.example")]
    # A host of which nearly all fails, with a document that by itself does not.
    rows += [(text(60) + " # * | < >" * 8, "junk.example") for _ in range(30)] + [(text(90), "junk.example")]
    rng.shuffle(rows)
    return [(i, t, h) for i, (t, h) in enumerate(rows, 100)]


def write(folder, rows):
    table = pa.table({"doc_id": pa.array([i for i, _, _ in rows], pa.int64()), "text": pa.array([t for _, t, _ in rows], pa.string()),
                      "lang": pa.array(["en"] * len(rows), pa.string()), "source": pa.array([h for _, _, h in rows], pa.string()),
                      "n_chars": pa.array([len(t or "") for _, t, _ in rows], pa.int64())})
    pq.write_table(table, folder / "documents.parquet")


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = made()
    write(tmp_path, rows)
    sizes = [len(rows)]
    for stage in (good, last_of_equal, first_of_similar):
        rows = stage(rows)
        sizes.append(len(rows))
    assert sizes == sorted(set(sizes), reverse=True)
    cut = without_passages(rows)
    assert cut != rows
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(pieces(cut))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    filled = [sum(n for _, n in parts) for parts in sequences.values()]
    assert max(filled) <= 2048 and sum(f <= 1024 for f in filled) <= 1


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    write(tmp_path, [])
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_short_pieces_go_on_filling_open_packs():
    packs = packing.shortest_pack_first({1000: 1, 100: 12, 7: 5}, 2048)
    assert sum(n for _, n in packs) == 2
    assert Counter(x for p, n in packs for x in p * n) == {1000: 1, 100: 12, 7: 5}
    for seed in range(20):
        rng = random.Random(seed)
        histogram = {rng.randrange(1, 65): rng.randrange(1, 30) for _ in range(25)}
        packs = packing.shortest_pack_first(histogram, 64)
        assert Counter(x for p, n in packs for x in p * n) == histogram
        # Longest first, so a new pack is opened only where no open one has room.
        filled = [sum(p) for p, n in packs for _ in range(n)]
        assert max(filled) <= 64 and sum(f <= 32 for f in filled) <= 1
