"""Not-modified revisit records resolved against earlier full responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header names that a not-modified response must not carry over to the stored one.
FORBIDDEN = ("connection", "content-encoding", "content-length", "content-range", "keep-alive", "proxy-authenticate",
             "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
# Query parameters that name a visit, not a page.
VISIT = r"^(utm_[a-z]+|gclid|fbclid|sessionid|phpsessid|jsessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host and path by which captures are compared.

    Scheme, fragment, user, default port and a leading ``www.`` go, the host is lower case,
    parameters are sorted without those of a visit, and a closing slash goes.  Null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, r"^[^/?]*", 0)
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(host, "^.*@", "")), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(VISIT))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def header(headers: Column, name: str) -> Column:
    """Value of a header by its name in any case; of several the one whose written name comes first."""
    hits = F.array_sort(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name))
    return F.get(hits, F.lit(0))["value"]


def weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def lower_entries(headers: Column) -> Column:
    """Entries with lower-case names; of equal names the first in written order."""
    entries = F.array_sort(F.transform(F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")),
                                       lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.filter(entries, lambda e, i: (i == 0) | (F.get(entries, i - 1)["key"] != e["key"]))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers updated by the permitted fresh ones, sorted by lower-case name."""
    new = F.filter(lower_entries(fresh), lambda e: ~e["key"].isin(*FORBIDDEN))
    names = F.transform(new, lambda e: e["key"])
    old = F.filter(lower_entries(stored), lambda e: ~F.array_contains(names, e["key"]))
    return F.array_sort(F.concat(old, new))


def resolved_revisits(records: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """(record_id, canonical_url, refers_to, verdict, headers) of every revisit among ``records``.

    Input: record_id, kind (``response`` or ``revisit``), url, date, status, headers (map).
    A full response has status 200.  The candidate is the latest one of the same canonical
    URL with an earlier date; of equal dates the largest id.  The revisit's ETag must equal
    its own (weakly); without one, the Last-Modified must.  ``verdict``: resolved,
    validator_mismatch, no_validator, no_earlier_response; only resolved rows have
    ``refers_to`` and merged ``headers``.  A null or odd URL matches nothing; a null date is
    never earlier nor later.  Repeated revisits are resolved each.

    One URL may own any share of the records: the as-of join works in time buckets, and what
    precedes a bucket comes from a table of one row per (URL, bucket).  Payloads never move.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    seen = records.select("record_id", "date", "headers", canonical_url(F.col("url")).alias("canonical_url"), full.alias("_full"),
                          (F.col("kind") == "revisit").alias("_asks")).filter("_full OR _asks")
    own = F.struct("date", "record_id", "headers", header(F.col("headers"), "etag").alias("etag"), header(F.col("headers"), "last-modified").alias("modified"))
    keyed = F.col("canonical_url").isNotNull() & F.col("date").isNotNull()
    seen = seen.withColumn("_offer", F.when(F.col("_full") & keyed, own)).withColumn(
        "_bucket", F.floor(F.unix_micros("date") / F.lit(bucket_seconds * 1_000_000)).cast("long"))
    lost = seen.filter(F.col("_asks") & ~keyed).withColumn("_found", F.lit(None).cast(seen.schema["_offer"].dataType))
    timed = seen.filter(keyed)
    inside = (Window.partitionBy("canonical_url", "_bucket").orderBy("date", F.coalesce("_full", F.lit(False)), "record_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    here = timed.withColumn("_near", F.last("_offer", ignorenulls=True).over(inside)).filter("_asks")
    # The last offer of each bucket, without comparing maps: by date and id.
    latest = timed.filter("_full").groupBy("canonical_url", "_bucket").agg(F.max_by("_offer", F.struct("date", "record_id")).alias("_last"))
    asked = here.select("canonical_url", "_bucket").distinct()
    across = Window.partitionBy("canonical_url").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (asked.join(latest, ["canonical_url", "_bucket"], "full").withColumn("_far", F.last("_last", ignorenulls=True).over(across))
               .select("canonical_url", "_bucket", "_far"))
    found = here.join(carried, ["canonical_url", "_bucket"], "left").withColumn("_found", F.coalesce("_near", "_far"))
    names = ["record_id", "canonical_url", "headers", "_found"]
    both = found.select(*names).unionAll(lost.select(*names))
    tag, modified = header(F.col("headers"), "etag"), header(F.col("headers"), "last-modified")
    same = F.when(tag.isNotNull(), weak(tag).eqNullSafe(weak(F.col("_found.etag")))).otherwise(modified.eqNullSafe(F.col("_found.modified")))
    verdict = (F.when(F.col("_found").isNull(), "no_earlier_response").when(tag.isNull() & modified.isNull(), "no_validator")
               .when(same, "resolved").otherwise("validator_mismatch"))
    told = both.withColumn("verdict", verdict)
    ok = F.col("verdict") == "resolved"
    return told.select("record_id", "canonical_url", F.when(ok, F.col("_found.record_id")).alias("refers_to"), "verdict",
                       F.when(ok, merged_headers(F.col("_found.headers"), F.col("headers"))).alias("headers"))
