"""Not-modified revisit resolution for web-archive records.

A revisit that says "not modified" has no body of its own.  It is resolved by an as-of
join: among the full responses of the same canonical URL, the latest that is earlier.  Its
validators are then checked (an entity tag, compared weakly, goes before a modification
date), and on success the stored headers are updated by those of the revisit's headers
that a 304 may carry.

The join is a running maximum over the records of a URL.  A URL's records are cut into
stretches of time; each stretch is scanned by itself and takes from the stretches before
it only their last response, so a URL that holds a third of all records is spread over
many tasks.  Headers travel with their record, so nothing is joined back by ids; bodies
are fetched by record id where a caller asks for them.

Every revisit gives one row, whatever its id: repeated rows and null ids give a row each.
Earlier means by at least a second: a response at the revisit's own time does not serve.
Of responses at one time that with the greatest id serves (of equal ids the one with the
greatest validators and headers; a null id is the least).  Revisits without URL or time
have no base, responses without them serve none.  Header names are compared in lower
case; null headers are none.  Records of another kind, or none, are left out; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 response may carry and that update the stored ones.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only trace a visitor.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)=.*$"


def canonical_url(url: Column) -> Column:
    """Lower-case host without www, no scheme, default port, fragment, user part or tracing parameters; the others sorted; no slash at the end."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lower_entries(headers: Column) -> Column:
    """Headers as entries in the order of their names, these in lower case; of names that then clash, the least value stays."""
    entries = F.array_sort(F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.filter(entries, lambda e, i: (i == 0) | (F.get(entries, i - 1)["key"] != e["key"]))


def as_of(records: DataFrame, stretch: int = 3600) -> DataFrame:
    """Append ``base``: ts, id, etag, modified and headers of the latest earlier full response of the same url, or null.

    ``records``: canon, ts (seconds), id, full (boolean), etag, modified, headers (sorted entries).  ``stretch``: seconds scanned as one piece.
    """
    response = F.struct("ts", "id", "etag", "modified", "headers")
    dealt = records.withColumn("stretch", F.floor(F.col("ts") / stretch))
    lasts = dealt.groupBy("canon", "stretch").agg(F.max(F.when(F.col("full"), response)).alias("own_last"))
    # A stretch's response is carried to the next stretch that has one, and from there on by the stretches between.
    before = Window.partitionBy("canon").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("canon", "stretch", F.last("own_last", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("canon", "stretch").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    scanned = dealt.withColumn("near", F.max(F.when(F.col("full"), response)).over(within))
    joined = scanned.where("not full").join(carried, ["canon", "stretch"], "left")
    return joined.withColumn("base", F.coalesce("near", "carried")).drop("near", "carried", "stretch")


def status_of(own_etag: Column, own_modified: Column, base_etag: Column, base_modified: Column, found: Column) -> Column:
    weak = lambda tag: F.regexp_replace(tag, r"^W/", "")
    by_tag = F.coalesce(weak(own_etag) == weak(base_etag), F.lit(False))
    by_date = F.coalesce(own_modified == base_modified, F.lit(False))
    checked = F.when(own_etag.isNotNull(), by_tag).when(own_modified.isNotNull(), by_date)
    return F.when(~found, "no_base").when(checked.isNull(), "unvalidated").when(checked, "matched").otherwise("mismatch")


def resolve(captures: DataFrame, stretch: int = 3600) -> DataFrame:
    """One row for each revisit: id, canon, base_id, status and merged headers.

    ``captures``: id, url, ts (seconds), kind ("response" or "revisit"), status (HTTP), headers (map).
    Full responses are those with status 200.  ``status``: matched, unvalidated (the
    revisit names no validator), mismatch or no_base; ``headers`` is null for the last two.
    """
    revisit = F.col("kind") == "revisit"
    canon = canonical_url(F.col("url"))
    rows = captures.where(revisit | ((F.col("kind") == "response") & (F.col("status") == 200)))
    rows = rows.select("id", F.when(canon != "", canon).alias("canon"), F.col("ts").cast("long").alias("ts"), (~revisit).alias("full"), lower_entries(F.col("headers")).alias("headers"))
    value = lambda name: F.get(F.filter("headers", lambda e: e["key"] == name), F.lit(0))["value"]
    rows = rows.withColumn("etag", value("etag")).withColumn("modified", value("last-modified"))
    placed = F.col("canon").isNotNull() & F.col("ts").isNotNull()
    found = as_of(rows.where(placed), stretch)
    lost = rows.where(~placed & ~F.col("full")).withColumn("base", F.lit(None).cast(found.schema["base"].dataType))
    status = status_of(F.col("etag"), F.col("modified"), F.col("base.etag"), F.col("base.modified"), F.col("base").isNotNull())
    judged = found.unionByName(lost).select("id", "canon", F.col("base.id").alias("base_id"), status.alias("status"), "headers", F.col("base.headers").alias("stored"))
    sent = F.filter("headers", lambda e: e["key"].isin(*PERMITTED))
    kept = F.filter("stored", lambda e: ~F.exists(sent, lambda n: n["key"] == e["key"]))
    merged = F.map_from_entries(F.concat(kept, sent))
    return judged.select("id", "canon", "base_id", "status", F.when(F.col("status").isin("matched", "unvalidated"), merged).alias("headers"))


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """Append the body of each resolved revisit's base; ``bodies``: base_id, each once, and body."""
    usable = F.col("status").isin("matched", "unvalidated")
    return resolved.join(bodies.select("base_id", "body"), "base_id", "left").withColumn("body", F.when(usable, F.col("body")))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Records of an archive made from pages: three responses and two revisits of each page's URL.

    With p = page_id, ids 8p + 0 to 4.  Responses: at 10p; at 10p + 200 (a 404 for every third page); and
    at 10p + 200 too or, for odd pages, at the first revisit's own time.  Each has a tag of its own, cut from
    the digest of the html.  Revisits, at 10p + 405 (its URL with a fragment) and a day later: by p % 6 they send
    the first, second or third response's tag, a date alone, a stale tag, or nothing.
    """
    page = F.col("page_id")
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    own = pages.select("page_id", F.col("url").alias("own_url"), digest.alias("digest"), F.length(F.coalesce(F.col("html"), F.lit(""))).cast("string").alias("size"))
    tag = lambda k: F.concat(F.lit('"'), F.substring("digest", 8 * k + 1, 16), F.lit('"'))
    date = lambda k: F.concat(F.lit("day "), (page % 3650 + k).cast("string"))
    pairs = lambda *p: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in p)), lambda e: e["value"].isNotNull()))

    def response(k: int, ts: Column, status: Column) -> Column:
        headers = pairs(("ETag", tag(k)), ("Last-Modified", F.when(page % 3 != 0, date(k))), ("Content-Type", F.lit("text/html")), ("Content-Length", F.col("size")), ("Date", ts.cast("string")))
        return F.struct((page * 8 + k).alias("id"), F.col("own_url").alias("url"), ts.alias("ts"), F.lit("response").alias("kind"), status.alias("status"), headers.alias("headers"))

    def revisit(k: int, ts: Column, url: Column) -> Column:
        kind = (page + k) % 6
        sent = F.when(kind == 0, F.concat(F.lit("W/"), tag(0))).when(kind == 1, tag(1)).when(kind == 2, tag(2)).when(kind == 4, F.lit('"stale"'))
        headers = pairs(("ETag", sent), ("Last-Modified", F.when(kind == 3, date(2))), ("Cache-Control", F.lit("max-age=60")), ("Content-Length", F.lit("0")), ("Date", ts.cast("string")))
        return F.struct((page * 8 + k).alias("id"), url.alias("url"), ts.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), headers.alias("headers"))

    first = page * 10
    third = F.when(page % 2 == 0, first + 200).otherwise(first + 405)
    records = F.array(
        response(0, first, F.lit(200)), response(1, first + 200, F.when(page % 3 == 0, 404).otherwise(200)), response(2, third, F.lit(200)),
        revisit(3, first + 405, F.concat("own_url", F.lit("#part"))), revisit(4, first + 86_400, F.col("own_url")),
    )
    return own.select(F.inline(records))


def oracle() -> str:
    """The query's rows in DuckDB's SQL, from the table pages."""
    return r"""
WITH named AS (
  SELECT page_id AS p, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS size,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages),
parts AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda a: a <> '' AND NOT regexp_matches(lower(a), '^(utm_[a-z]+|gclid|fbclid|ref)=.*$'))) AS args
  FROM named),
pages_c AS (
  SELECT p, size, nullif(host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END, '') AS canon,
    '"' || substr(digest, 1, 16) || '"' AS tag0, '"' || substr(digest, 9, 16) || '"' AS tag1, '"' || substr(digest, 17, 16) || '"' AS tag2
  FROM parts),
responses AS (
  SELECT 8 * p AS base_id, canon, 10 * p AS ts, tag0 AS base_tag, 0 AS k, p, size FROM pages_c
  UNION ALL SELECT 8 * p + 1, canon, 10 * p + 200, tag1, 1, p, size FROM pages_c WHERE p % 3 <> 0
  UNION ALL SELECT 8 * p + 2, canon, 10 * p + CASE WHEN p % 2 = 0 THEN 200 ELSE 405 END, tag2, 2, p, size FROM pages_c),
serving AS (
  SELECT *, CASE WHEN p % 3 <> 0 THEN 'day ' || CAST(p % 3650 + k AS VARCHAR) END AS base_day
  FROM responses WHERE canon IS NOT NULL QUALIFY row_number() OVER (PARTITION BY canon, ts ORDER BY base_id DESC) = 1),
sends AS (
  SELECT *, (p + 3) % 6 AS kind, 8 * p + 3 AS id, 10 * p + 405 AS ts FROM pages_c
  UNION ALL SELECT *, (p + 4) % 6, 8 * p + 4, 10 * p + 86400 FROM pages_c),
revisits AS (
  SELECT id, canon, ts, CASE kind WHEN 0 THEN 'W/' || tag0 WHEN 1 THEN tag1 WHEN 2 THEN tag2 WHEN 4 THEN '"stale"' END AS etag,
    CASE WHEN kind = 3 THEN 'day ' || CAST(p % 3650 + 2 AS VARCHAR) END AS modified
  FROM sends),
joined AS (
  SELECT r.*, b.base_id, b.base_tag, b.base_day, b.size
  FROM revisits r ASOF LEFT JOIN serving b ON r.canon = b.canon AND r.ts > b.ts),
judged AS (
  SELECT *, CASE WHEN base_id IS NULL THEN 'no_base' WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = base_tag THEN 'matched' ELSE 'mismatch' END
    WHEN modified IS NOT NULL THEN CASE WHEN coalesce(modified = base_day, false) THEN 'matched' ELSE 'mismatch' END ELSE 'unvalidated' END AS status
  FROM joined)
SELECT id, canon, base_id, status,
  CASE WHEN status IN ('matched', 'unvalidated') THEN 'cache-control=max-age=60;content-length=' || size || ';content-type=text/html;date=' || ts || ';etag=' ||
    coalesce(etag, base_tag) || CASE WHEN coalesce(modified, base_day) IS NULL THEN '' ELSE ';last-modified=' || coalesce(modified, base_day) END END AS headers
FROM judged"""
