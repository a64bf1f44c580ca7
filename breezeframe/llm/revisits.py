"""Not-modified revisits of a web archive, resolved to the full responses they stand for.

A revisit answers a conditional request with status 304 and holds no body. It is resolved by an as-of join:
the latest full response (status 200) of the same canonical URL whose date is earlier. The validators must
agree: the entity tags, compared weakly, if both records have one, else the modification dates; without a
common validator nothing is proven and the revisit stays unresolved. The stored headers are then updated
with those of the revisit, except the ones that describe the stored body or one hop.

The join has no unbounded key. Records are ordered by URL, date and id over range partitions, written once
with their partition number; inside (URL, partition) a window carries the latest response forward, and one
row per (URL, partition) carries it across. A URL with most records is spread like all others.

Records of one URL and date are ordered by id; a response of the same date is not earlier. Null URLs or dates
never resolve. Repeated records are rows of their own. Headers are a map; names are lower-cased, of names
that then clash the first stays; null counts as empty. Columns beside the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeframe.core.shared import materialise

# Headers of a 304 that must not replace stored ones (body description and hop-by-hop fields of HTTP).
KEPT_HEADERS = (
    "connection content-encoding content-length content-location content-range content-type keep-alive "
    "proxy-authenticate proxy-authorization proxy-connection te trailer transfer-encoding upgrade"
).split()
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
PART_ROWS = 200_000


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port, path without fragment, query sorted and without tracking; no scheme."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^https?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", "")
    path = F.regexp_extract(bare, "^[^/?]*([^?]*)", 1)
    query = F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lower_headers(headers: Column) -> Column:
    """Names in lower case; of names that clash the first stays."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda o: o["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(first), F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))


def merged_headers(stored: Column, fresh: Column) -> Column:
    usable = F.map_filter(fresh, lambda k, _: ~k.isin(KEPT_HEADERS))
    old = F.map_filter(stored, lambda k, _: ~F.map_contains_key(usable, k))
    return F.map_concat(old, usable)


def validators_agree(stored: Column, fresh: Column) -> Column:
    """True or false by the first validator that both have, null without one."""
    tag = lambda h: F.regexp_replace(F.try_element_at(h, F.lit("etag")), "^W/", "")
    date = lambda h: F.try_element_at(h, F.lit("last-modified"))
    return F.coalesce(tag(stored) == tag(fresh), date(stored) == date(fresh))


def resolve(records: DataFrame) -> DataFrame:
    """A row for each revisit of ``records(record_id, url, at, status, headers)``.

    ``record_id, url_key, outcome, response_id, response_at, headers``: outcome is ``resolved``, ``changed``
    (validators differ), ``unproven`` (no common validator) or ``missing`` (no earlier response); the response
    and the merged headers are given when resolved.
    """
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url_key"),
        F.col("at").cast("timestamp").alias("at"), F.col("status").cast("int").alias("status"), lower_headers(F.col("headers")).alias("headers"),
    ).where("status in (200, 304)")
    shuffled = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffled, -(-records.count() // PART_ROWS))
    rows = rows.withColumn("micros", F.unix_micros("at"))
    rows = materialise(rows.repartitionByRange(parts, "url_key", "micros").withColumn("part", F.spark_partition_id()), "revisit-records")
    known = F.col("url_key").isNotNull() & F.col("micros").isNotNull()
    # Rows of one URL and moment share a partition, so all rows of earlier partitions are earlier.
    key = F.when((F.col("status") == 200) & known, F.struct("micros", F.col("record_id").alias("id")))
    keyed = rows.select("*", key.alias("key"))
    earlier = Window.partitionBy("url_key", "part").orderBy("micros").rangeBetween(Window.unboundedPreceding, -1)
    near = keyed.withColumn("near", F.max("key").over(earlier)).where("status = 304")
    last = keyed.groupBy("url_key", "part").agg(F.max("key").alias("last"))
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    far = last.select("url_key", "part", F.max("last").over(before).alias("far")).where("far is not null")
    of = F.when(F.col("micros").isNotNull(), F.coalesce("near", "far"))
    found = near.join(far, ["url_key", "part"], "left").withColumn("of", of)
    found = found.select("record_id", "url_key", F.col("headers").alias("fresh"), F.col("of.micros").alias("micros"), F.col("of.id").alias("response_id"))

    responses = rows.where("status = 200").select("url_key", "micros", F.col("record_id").alias("response_id"), F.col("headers").alias("stored"))
    responses = responses.dropDuplicates(["url_key", "micros", "response_id"])
    both = found.join(responses, ["url_key", "micros", "response_id"], "left")
    agree = validators_agree(F.col("stored"), F.col("fresh"))
    outcome = F.when(F.col("response_id").isNull(), "missing").when(agree, "resolved").when(~agree, "changed").otherwise("unproven")
    done = outcome == "resolved"
    return both.select(
        "record_id", "url_key", outcome.alias("outcome"), F.when(done, F.col("response_id")).alias("response_id"),
        F.when(done, F.timestamp_micros("micros")).alias("response_at"),
        F.when(done, merged_headers(F.col("stored"), F.col("fresh"))).alias("headers"),
    )
