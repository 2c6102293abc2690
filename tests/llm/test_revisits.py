"""Revisits against brute force: ties, seams of days, null fields, spellings of headers."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.llm import revisits

SCHEMA = "record_id long, kind string, url string, date timestamp, status int, headers map<string,string>, canonical_url string, verdict int"
T0 = datetime(2024, 1, 1, 23, 50)


def spelt(headers):
    """Lower-case names; of equal names the first in written order of name and value."""
    out = {}
    for k, v in sorted((k.lower(), v) for k, v in (headers or {}).items()):
        out.setdefault(k, v)
    return out


def weak(tag):
    return tag[2:] if tag and tag.startswith("W/") else tag


def brute(records, canonical):
    out = []
    for rid, kind, url, date, status, headers, *_ in records:
        if kind != "revisit":
            continue
        own, place = spelt(headers), canonical[rid]
        earlier = [(r[3], r[0], r) for r in records if r[1] == "response" and r[4] == 200 and place is not None and canonical[r[0]] == place
                   and date is not None and r[3] is not None and r[3] < date]
        found = max(earlier, key=lambda e: e[:2])[2] if earlier else None
        tag, modified = own.get("etag"), own.get("last-modified")
        kept = spelt(found[5]) if found else {}
        if found is None:
            verdict = "no_earlier_response"
        elif tag is None and modified is None:
            verdict = "no_validator"
        elif (weak(tag) == weak(kept.get("etag"))) if tag is not None else modified == kept.get("last-modified"):
            verdict = "resolved"
        else:
            verdict = "validator_mismatch"
        merged = None
        if verdict == "resolved":
            merged = sorted({**kept, **{k: v for k, v in own.items() if k not in revisits.FORBIDDEN}}.items())
        out.append((rid, place, found[0] if merged is not None else None, verdict, merged))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    urls = ["http://a.org/x", "HTTPS://www.A.org:443/x/", "http://a.org/x#part", "http://b.org/?b=2&a=1", "http://b.org/?a=1&b=2", "odd", "", None]
    tags = ['"1"', 'W/"1"', '"2"', None]
    rows = []
    for i in range(160):
        headers = {rng.choice(["ETag", "etag", "ETAG"]): rng.choice(tags), rng.choice(["Last-Modified", "last-modified"]): rng.choice(["m1", "m2", None]),
                   "Content-Length": str(i), "X-Note": rng.choice(["p", "q"])}
        headers = {k: v for k, v in headers.items() if v is not None}
        date = None if i % 23 == 0 else T0 + timedelta(minutes=rng.choice([0, 0, 5, 10, 15, 1440, 2 * 1440, 9 * 1440]))
        rows.append((i, rng.choice(["response", "revisit", "revisit", "request", None]), rng.choice(urls), date, rng.choice([200, 200, 304, None]),
                     None if i % 29 == 0 else headers, "clash", i))
    return rows + [rows[3], rows[4]]


@pytest.mark.parametrize("seed,bucket", [(1, 86_400), (2, 600), (3, 10**8)])
def test_equals_brute_force(spark, seed, bucket):
    records = made(seed)
    df = spark.createDataFrame(records, SCHEMA).repartition(4)
    canonical = {r.record_id: r.place for r in df.select("record_id", revisits.canonical_url(df["url"]).alias("place")).collect()}
    assert canonical and len({v for v in canonical.values()}) < 8
    got = revisits.resolved_revisits(df, bucket_seconds=bucket).collect()
    mine = [(r.record_id, r.canonical_url, r.refers_to, r.verdict, None if r.headers is None else [(e["key"], e["value"]) for e in r.headers]) for r in got]
    assert sorted(mine, key=str) == brute(records, canonical)


def test_no_records(spark):
    assert revisits.resolved_revisits(spark.createDataFrame([], SCHEMA)).collect() == []
