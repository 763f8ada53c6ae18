"""Not-modified revisits of web captures, resolved to the response they stand for.

A revisit record says that a page had not changed.  It is joined as of its date
to the latest earlier full response of the same canonical URL.  Validators are
then compared, and the headers that a not-modified answer may renew are merged
over those of the response.

Records of one URL and date meet first, so the as-of step sees one row per URL
and date.  A URL with very many dates is cut into chunks of dates: inside a
chunk a window finds the latest earlier response, across chunks their latest
ones are carried on (``tradeledger.operators.cuts``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradeledger.operators.cuts import HOT_ROWS, with_chunk

# Headers that a 304 answer may renew in a stored response.
RENEWED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
# Query parameters that name no content.
_TRACKING = "utm_[^=]*|fbclid|gclid|msclkid|ref|sessionid|phpsessid|jsessionid"

HEADERS = "array<struct<name:string,value:string>>"
RECORDS = f"record_id string, kind string, uri string, date timestamp, status int, headers {HEADERS}, digest string"


def canonical(uri: str) -> Column:
    """URLs that differ only in scheme, ``www.``, default port, letter case of the host, fragment, tracking
    parameters, order of parameters or a closing slash are one.  Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.col(uri)), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^({_TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _header(headers: str, name: str) -> str:
    """SQL of the last value of a header, null without one."""
    return f"try_element_at(transform(filter({headers}, h -> lower(trim(h.name)) = '{name}' AND h.value IS NOT NULL), h -> trim(h.value)), -1)"


def _compared(name: str, plain: str = "{0}") -> str:
    """SQL: 1 if both records have the header and agree, -1 if they differ, else 0."""
    a, b = plain.format(_header("headers", name)), plain.format(_header("source.headers", name))
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0 WHEN {a} = {b} THEN 1 ELSE -1 END"


def resolve(records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per revisit record: ``record_id, url, date, source_id, source_date, outcome, headers, digest``.

    ``records`` has the columns of ``RECORDS`` (others are ignored).  ``outcome``:

    * ``resolved``: validators agree (entity tags compared weakly, last-modified, payload digest), none differs;
    * ``changed``: one differs; ``unchecked``: the records have none in common.  Both name the response but merge nothing;
    * ``missing``: no full response (status 200) of that URL has an earlier date.

    Earlier means strictly earlier; among responses of one date the greatest
    record id counts.  Revisits without URL or date are ``missing``.  Repeated
    rows are resolved each.
    """
    rows = records.select("record_id", F.lower("kind").alias("kind"), canonical("uri").alias("url"), "date", "status",
                          F.coalesce("headers", F.array().cast(HEADERS)).alias("headers"), "digest")
    full = F.expr("CASE WHEN kind = 'response' AND status = 200 THEN struct(date, record_id, headers, digest) END")
    moments = rows.where("url IS NOT NULL AND date IS NOT NULL AND kind IN ('response', 'revisit')").groupBy("url", "date").agg(
        F.max(F.struct(full.getField("record_id").alias("record_id"), full.getField("headers").alias("headers"), full.getField("digest").alias("digest"),
                       full.isNotNull().alias("full"))).alias("own"),
        F.max(F.expr("kind = 'revisit'")).alias("asked"))
    # Null record ids of other rows sort below any response; a response without an id still counts.
    moments = moments.withColumn("own", F.when(F.col("own.full"), F.struct("date", "own.record_id", "own.headers", "own.digest")))
    cut = with_chunk(moments, ["url"], "date", hot_rows)
    inside = Window.partitionBy("url", "_chunk").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("url").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumn("near", F.last("own", ignorenulls=True).over(inside)).where("asked")
    carried = (
        cut.where("own IS NOT NULL").groupBy("url", "_chunk").agg(F.max_by("own", "date").alias("own"))
        .union(cut.select("url", "_chunk", F.lit(None).cast(moments.schema["own"].dataType)).distinct())
        .groupBy("url", "_chunk").agg(F.first("own", ignorenulls=True).alias("own"))
        .withColumn("carried", F.last("own", ignorenulls=True).over(ahead)).where("carried IS NOT NULL").select("url", "_chunk", "carried")
    )
    found = near.join(carried, ["url", "_chunk"], "left").select("url", "date", F.coalesce("near", "carried").alias("source"))
    outcome = F.expr(f"""
        CASE WHEN source IS NULL THEN 'missing' ELSE
          CASE array_min(checks) WHEN -1 THEN 'changed' ELSE IF(array_max(checks) = 1, 'resolved', 'unchecked') END END""")
    names = ", ".join(f"'{n}'" for n in RENEWED)
    merged = F.expr(f"""
        CASE WHEN outcome = 'resolved' THEN concat(
          filter(source.headers, s -> NOT exists(renewed, r -> lower(trim(r.name)) = lower(trim(s.name)))), renewed) ELSE headers END""")
    return (
        rows.where("kind = 'revisit'").join(found, ["url", "date"], "left")
        .withColumn("checks", F.expr(
            f"array({_compared('etag', 'regexp_replace({0}, ' + chr(39) + '^[Ww]/' + chr(39) + ', ' + chr(39) * 2 + ')')}, {_compared('last-modified')}, "
            "CASE WHEN digest IS NULL OR source.digest IS NULL THEN 0 WHEN digest = source.digest THEN 1 ELSE -1 END)"))
        .withColumn("outcome", outcome)
        .withColumn("renewed", F.expr(f"filter(headers, h -> lower(trim(h.name)) IN ({names}))"))
        .select("record_id", "url", "date", F.col("source.record_id").alias("source_id"), F.col("source.date").alias("source_date"), "outcome",
                merged.alias("headers"), F.coalesce("source.digest", "digest").alias("digest"))
    )
