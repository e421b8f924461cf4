"""Not-modified revisits resolved to the full response that they confirm.

Records (captures) have record_id, url, ts, kind ('response' or 'revisit'), etag, last_modified, digest and headers (a map
with lower-case names).  A revisit's candidate is the latest full response of its canonical URL with a smaller ts (of equal
ts: the largest record_id).  It is resolved if the validators agree: the entity tags without their weakness mark if both
have one, else the modification dates if both have one, else the payload digests.  The resolved record takes the
response's headers and, over them, those that a not-modified answer may update.

As-of without a hot task: ts is cut into ordered blocks of about equal size; in a block the latest response is a running maximum
within (URL, block), before it the maximum of the URL's earlier blocks, of which there are as many as partitions at most.
Only keys and validators move; headers are joined by record_id at the end.

Defined cases: null or blank URLs share no key and are never resolved; a null ts is before all others (and has no earlier
response) and comes back as null; a null kind counts as a response; repeated rows are kept, as candidates they count once; of a repeated
record_id's headers those of the latest row count (of equal ts: those that are the greatest as text; rows without headers last); percent-escapes of
unreserved characters are these characters, in all others letters are in upper case; without a validator that both have, a candidate is refused; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import OrderedBuckets, fanout

#: Query parameters that name no other content (fixed values).
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(=|$)"
#: Headers of the stored response that a not-modified answer does not update (fixed values).
FIXED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")


#: Characters that need no percent-escape (fixed values).
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def unescaped(text: Column) -> Column:
    """Percent-escapes in their canonical form."""

    def one(part, i):
        code = F.upper(F.substring(part, 1, 2))
        valid = (i > 0) & code.rlike("^[0-9A-F]{2}$")
        char = F.chr(F.conv(code, 16, 10).cast("int"))
        rest = F.substr(part, F.lit(3))
        plain = F.instr(F.lit(UNRESERVED), char) > 0
        return F.when(i == 0, part).when(valid & plain, F.concat(char, rest)).when(valid, F.concat(F.lit("%"), code, rest)).otherwise(F.concat(F.lit("%"), part))

    return F.array_join(F.transform(F.split(text, "%"), one), "")


def canonical(url: Column) -> Column:
    """host/path?query: without scheme, fragment, www., default port, tracking parameters and closing slashes; host in lower case, parameters in order, escapes in canonical form."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^([^/?]*)", 1)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(unescaped(F.regexp_extract(u, "^[^/?]*([^?]*)", 1)), "/+$", "")
    query = unescaped(F.regexp_extract(u, "^[^?]*\\?(.*)$", 1))
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    out = F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(host != "", out)


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit: record_id, url_key, ts, target_id, target_ts, outcome ('resolved', 'changed' or 'no earlier response'), headers."""
    parts = fanout(records)
    revisit = F.coalesce(F.col("kind") == "revisit", F.lit(False))
    r = records.select(
        "record_id",
        canonical(F.col("url")).alias("url_key"),
        # one above the least long: the window looks at the one before
        F.greatest(F.coalesce(F.col("ts").cast("bigint"), F.lit(1 - (1 << 63))), F.lit(1 - (1 << 63))).alias("ts"),
        F.col("ts").cast("bigint").alias("given"),
        revisit.alias("again"),
        "etag",
        "last_modified",
        "digest",
    )
    r = r.withColumn("blk", OrderedBuckets(r, [F.col("ts")], parts).of(F.col("ts")))
    full = F.when(~F.col("again") & F.col("url_key").isNotNull(), F.struct("ts", "record_id", "etag", "last_modified", "digest", "given"))
    r = r.withColumn("full", full)
    in_block = Window.partitionBy("url_key", "blk").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    here = r.where("url_key is not null").withColumn("near", F.max("full").over(in_block)).where("again")
    blocks = r.where("url_key is not null").groupBy("url_key", "blk").agg(F.max("full").alias("last"))
    earlier = Window.partitionBy("url_key").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("carry", F.max("last").over(earlier)).select("url_key", "blk", "carry")
    found = (
        here.join(carried, ["url_key", "blk"], "left")
        .select("record_id", "url_key", F.col("given").alias("ts"), "etag", "last_modified", "digest", F.coalesce("near", "carry").alias("target"))
    )
    lost = (
        r.where("again and url_key is null")
        .select(
            "record_id",
            "url_key",
            F.col("given").alias("ts"),
            "etag",
            "last_modified",
            "digest",
            F.lit(None).cast(found.schema["target"].dataType).alias("target"),
        )
    )
    found = found.unionByName(lost)
    plain = lambda c: F.regexp_replace(c, "^W/", "")
    t = F.col("target")
    agree = (
        F.when(F.col("etag").isNotNull() & t["etag"].isNotNull(), plain(F.col("etag")) == plain(t["etag"]))
        .when(F.col("last_modified").isNotNull() & t["last_modified"].isNotNull(), F.col("last_modified") == t["last_modified"])
        .otherwise(F.coalesce(F.col("digest") == t["digest"], F.lit(False)))
    )
    outcome = F.when(t.isNull(), "no earlier response").when(agree, "resolved").otherwise("changed")
    found = found.select(
        "record_id",
        "url_key",
        "ts",
        t["record_id"].alias("target_id"),
        t["given"].alias("target_ts"),
        outcome.alias("outcome"),
    )
    line = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    latest = F.struct(F.col("headers").isNotNull(), F.col("ts").cast("bigint"), F.array_join(line, "\n"))
    once = records.groupBy("record_id").agg(F.max_by("headers", latest).alias("h"))
    own = once.select("record_id", F.col("h").alias("new"))
    old = once.select(F.col("record_id").alias("target_id"), F.col("h").alias("old"))
    joined = found.join(own, "record_id", "left").join(old, "target_id", "left")
    return joined.select(
        "record_id",
        "url_key",
        "ts",
        "target_id",
        "target_ts",
        "outcome",
        F.when(F.col("outcome") == "resolved", merge_headers(F.col("old"), F.col("new"))).alias("headers"),
    )


def merge_headers(old: Column, new: Column) -> Column:
    """old's entries with new's permitted ones over them."""
    none = F.from_json(F.lit("{}"), "map<string,string>")
    update = F.map_filter(F.coalesce(new, none), lambda k, _: ~k.isin(*FIXED))
    keep = F.map_filter(F.coalesce(old, none), lambda k, _: ~F.coalesce(F.map_contains_key(update, k), F.lit(False)))
    return F.map_concat(keep, update)


#: A page is asked for again after this many further pages.
DELAY = 64


def captures(pages: DataFrame) -> DataFrame:
    """The pages as an archive: every page is a full response at 2 * page_id, and is asked for again DELAY pages later with
    the validators of its own text; the answer is a not-modified revisit (record_id -1 - page_id).  Of page_ids that are 5
    modulo 7 the revisit has another entity tag, and those of 3 modulo 11 stand before all responses."""
    digest = F.sha1(F.coalesce("html", F.lit("")))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    page = pages.select("page_id", "url", digest.alias("digest"), tag.alias("tag"), size.alias("size"))
    day = lambda c: F.concat(F.lit("day "), F.floor(c / 1000).cast("string"))
    response = page.select(
        F.col("page_id").alias("record_id"), "url", (F.col("page_id") * 2).alias("ts"), F.lit("response").alias("kind"), F.col("tag").alias("etag"), day(F.col("page_id")).alias("last_modified"), "digest",
        F.create_map(
            F.lit("content-type"),
            F.lit("text/html"),
            F.lit("content-length"),
            F.col("size"),
            F.lit("etag"),
            F.col("tag"),
            F.lit("date"),
            (F.col("page_id") * 2).cast("string"),
            F.lit("age"),
            F.lit("0"),
        ).alias("headers"),
    )
    at = F.when(F.pmod("page_id", F.lit(11)) == 3, F.lit(-1)).otherwise(F.col("page_id") * 2 + 1 + 2 * DELAY).cast("bigint")
    tag_again = F.when(F.pmod("page_id", F.lit(7)) == 5, F.lit('"another"')).otherwise(F.col("tag"))
    again = page.select(
        (-1 - F.col("page_id")).alias("record_id"), "url", at.alias("ts"), F.lit("revisit").alias("kind"), F.concat(F.lit("W/"), tag_again).alias("etag"), day(F.col("page_id")).alias("last_modified"), "digest",
        F.create_map(
            F.lit("content-length"),
            F.lit("0"),
            F.lit("date"),
            at.cast("string"),
            F.lit("cache-control"),
            F.lit("max-age=60"),
        ).alias("headers"),
    )
    return response.unionByName(again)


def revisit_rows(pages: DataFrame) -> DataFrame:
    """resolve() over captures(pages), with the headers as one line of text in order of their names."""
    found = resolve(captures(pages))
    line = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return found.select("record_id", "url_key", "ts", "target_id", "target_ts", "outcome", line.alias("headers"))


def plain_sql(text: str) -> str:
    """SQL for unescaped()."""
    digit = lambda k: f"instr('0123456789ABCDEF', upper(q[{k}])) - 1"
    char = f"chr(CAST(16 * ({digit(1)}) + {digit(2)} AS INT))"
    one = f"CASE WHEN i = 1 THEN q WHEN NOT regexp_matches(q[1:2], '^[0-9A-Fa-f]{{2}}$') THEN '%' || q WHEN upper(q[1:2]) <> '00' AND instr('{UNRESERVED}', {char}) > 0 THEN {char} || q[3:] ELSE '%' || upper(q[1:2]) || q[3:] END"
    return f"array_to_string(list_transform(string_split({text}, '%'), lambda q, i: {one}), '')"


ORACLE = f"""
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS digest, coalesce(strlen(html), 0) AS size,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
e AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '') AS host,
         regexp_extract(u, '^[^/?]*([^?]*)', 1) AS raw_path, regexp_extract(u, '^[^?]*\\?(.*)$', 1) AS raw_query FROM p),
k AS (
  SELECT page_id, digest, size, host, regexp_replace({plain_sql('raw_path')}, '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split({plain_sql('raw_query')}, '&'),
           lambda q: q <> '' AND NOT regexp_matches(lower(q), '{TRACKING}'))), '&') AS kept FROM e),
c AS (SELECT page_id, digest, size, CASE WHEN page_id % 11 = 3 THEN -1 ELSE page_id * 2 + 1 + {2 * DELAY} END AS asked,
         CASE WHEN page_id % 7 = 5 THEN 'another' ELSE digest[1:16] END AS tag, CASE WHEN host <> '' THEN host || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS url_key FROM k),
t AS (
  SELECT a.page_id, a.url_key, a.tag, a.asked, max(b.page_id) AS target FROM c a
  LEFT JOIN c b ON a.url_key = b.url_key AND b.page_id * 2 < a.asked GROUP BY ALL)
SELECT -1 - t.page_id AS record_id, t.url_key, t.asked AS ts, t.target AS target_id, t.target * 2 AS target_ts,
  CASE WHEN t.target IS NULL THEN 'no earlier response' WHEN c.digest[1:16] = t.tag THEN 'resolved' ELSE 'changed' END AS outcome,
  CASE WHEN c.digest[1:16] = t.tag THEN 'age: 0; cache-control: max-age=60; content-length: ' || c.size || '; content-type: text/html; date: ' || t.asked || '; etag: "' || c.digest[1:16] || '"' END AS headers
FROM t LEFT JOIN c ON c.page_id = t.target
"""
