"""URL filters: rules by host and path, and a path-template tree for urls that no rule fits.

The tree is built of DataFrame functions only.  Urls become (host, segments); a segment that is a number, a hash or very long is
a wildcard by its form.  Level by level, each node's rarer segments (under SUPPORT urls or under SHARE of the node's) become one
wildcard ``*``; then branches of a node whose urls go on alike (share that ends, goes on with a wildcard, goes on otherwise) and
are labelled alike are merged, the largest branch leading.  Labelled urls are those that a rule fits.  A whole template is
rejected if its purity (share of allowed among its labelled urls, smoothed by PRIOR with the weight of WEIGHT urls) is under LEAST.

At scale: urls are counted by host and generalised path first (combined before the shuffle), the levels work on these counts,
and one join brings the verdicts back.  Joins use keyed() (session): keys that hold a thousandth of the rows or more, of which there are a
thousand at most, are broadcast, all others are shuffled.  A node has at most 1 / SHARE + 4 branches, so they fit one row.

Defined cases: null urls and such without ``://`` have host and path '' and the template of that empty host; empty segments are
segments; of more than DEPTH segments the rest is one; a url that stands repeatedly counts repeatedly; without labels a
template is allowed; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut, keyed

#: (host, path, verdict): the rules of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Segments that have levels of their own.
DEPTH = 8
#: Urls that a literal segment has at least, and its share of the node's urls.
SUPPORT, SHARE = 4, 1 / 64
#: Smoothed purity: share of allowed before any label, its weight in labelled urls, the least purity that is allowed.
PRIOR, WEIGHT, LEAST = 0.9, 4.0, 0.5
#: Distance of shares that counts as none; critical values: chi-square with 2 degrees of freedom (0.1 %), normal (5 %).
NEAR, CHI, Z = 0.05, 13.816, 1.96
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z in lower case; path: then up to ? or #; both '' without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def general(segment: Column) -> Column:
    """A segment, or the wildcard of its form: <n> number, <h> hash or UUID, <t> very long; an ending like .html stays."""
    ending = F.regexp_extract(segment, "\\.[A-Za-z]{1,5}$", 0)
    stem = F.substr(segment, F.lit(1), F.length(segment) - F.length(ending))
    form = (
        F.when(F.length(segment) > 64, F.lit("<t>"))
        .when(stem.rlike("^[0-9]+$"), F.concat(F.lit("<n>"), ending))
        .when(stem.rlike("^[0-9A-Fa-f-]{8,}$") & stem.rlike("[0-9]"), F.concat(F.lit("<h>"), ending))
    )
    return F.coalesce(form, segment)


def segments(path: Column) -> Column:
    """The generalised segments of a path; those after DEPTH are one."""
    own = F.split(path, "/")
    own = F.when(F.size(own) > 1, F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(1)))).otherwise(F.slice(own, 1, 0))
    rest = F.array(F.concat_ws("/", F.slice(own, F.lit(DEPTH + 1), F.greatest(F.size(own) - DEPTH, F.lit(1)))))
    short = F.when(F.size(own) > DEPTH, F.concat(F.slice(own, 1, DEPTH), rest)).otherwise(own)
    return F.transform(short, general)


def purity(allowed: Column, blocked: Column) -> Column:
    return (allowed + PRIOR * WEIGHT) / (allowed + blocked + WEIGHT)


def alike(a: Column, b: Column) -> Column:
    """Whether two branches go on alike and are labelled alike."""
    parts = [(a[k] / a["n"], b[k] / b["n"], a[k] + b[k]) for k in ("ends", "wild", "other")]
    distance = sum((F.abs(p - q) for p, q, _ in parts), F.lit(0.0)) / 2
    chi = sum((F.when(s > 0, a["n"] * b["n"] * (p - q) * (p - q) / s).otherwise(0.0) for p, q, s in parts), F.lit(0.0))
    p, q = (purity(x["allowed"], x["blocked"]) for x in (a, b))
    spread = sum((r * (1 - r) / (x["allowed"] + x["blocked"] + WEIGHT + 1) for r, x in ((p, a), (q, b))), F.lit(0.0))
    return ((distance <= NEAR) | (chi <= CHI)) & ((F.abs(p - q) <= NEAR) | (F.abs(p - q) <= Z * F.sqrt(spread)))


def merged(branches: Column) -> Column:
    """Branches of one node (name, n, ends, wild, other, allowed, blocked; the largest first) -> map of name -> name of its group."""
    kind = "array<struct<name:string,lead:string,n:bigint,ends:bigint,wild:bigint,other:bigint,allowed:bigint,blocked:bigint>>"

    def step(done, b):
        leads = F.filter(done, lambda x: (x["name"] == x["lead"]) & alike(x, b))
        lead = F.when(F.size(leads) > 0, F.get(leads, F.lit(0))["lead"]).otherwise(b["name"])
        return F.concat(done, F.array(F.struct(b["name"].alias("name"), lead.alias("lead"), *[b[k].alias(k) for k in ("n", "ends", "wild", "other", "allowed", "blocked")])))

    led = F.aggregate(branches, F.from_json(F.lit("[]"), kind), step)

    def name(led):
        def one(x):
            group = F.array_sort(F.transform(F.filter(led, lambda y: y["lead"] == x["lead"]), lambda y: y["name"]))
            return F.struct(x["name"], F.when(F.size(group) == 1, x["name"]).otherwise(F.concat(F.lit("{"), F.array_join(group, "|"), F.lit("}"))))

        return F.map_from_entries(F.transform(led, one))

    # the groups are found once: a transform over one element names an intermediate value
    return F.get(F.transform(F.array(led), name), F.lit(0))


def templates(paths: DataFrame) -> DataFrame:
    """Counted paths (host, segs, n, allowed, blocked) with their template; host and template are the tree's leaves."""
    state = cut(paths.withColumn("template", F.lit("")))
    deepest = state.agg(F.max(F.size("segs"))).first()[0] or 0
    for level in range(deepest):
        seg, after = F.get("segs", F.lit(level)), F.get("segs", F.lit(level + 1))
        active = F.size("segs") > level
        counts = [F.sum(F.when(x, F.col("n")).otherwise(0)).alias(k) for k, x in (("ends", after.isNull()), ("wild", after.startswith("<")), ("other", after.isNotNull() & ~after.startswith("<")))]
        sums = [F.sum(c).alias(c) for c in ("n", "allowed", "blocked", "paths")]
        branch = (
            state.where(active).withColumn("paths", F.lit(1))
            .groupBy("host", "template", seg.alias("name"))
            .agg(*sums, *counts)
        )
        branch = cut(branch)
        node = branch.groupBy("host", "template").agg(F.sum("n").alias("total"), F.sum("paths").alias("paths"), F.count(F.lit(1)).alias("rows"))
        fixed = F.col("name").isin("<n>", "<h>", "<t>")
        rare = branch.where(~fixed & (F.col("n") < SUPPORT)).withColumn("name", F.lit("*")).drop("paths")
        common = keyed(branch.where(fixed | (F.col("n") >= SUPPORT)).drop("paths"), node.drop("paths"), ["host", "template"], "rows")
        common = common.withColumn("name", F.when(fixed | (F.col("n") >= F.col("total") * SHARE), F.col("name")).otherwise("*"))
        kinds = ("n", "ends", "wild", "other", "allowed", "blocked")
        named = (
            common.select("host", "template", "name", *kinds).unionByName(rare.select("host", "template", "name", *kinds))
            .groupBy("host", "template", "name")
            .agg(*[F.sum(k).alias(k) for k in kinds])
        )
        one = F.struct((-F.col("n")).alias("down"), "name", *kinds)
        names = named.groupBy("host", "template").agg(merged(F.array_sort(F.collect_list(one))).alias("names"))
        names = names.join(node.select("host", "template", "paths"), ["host", "template"])
        moved = keyed(state.where(active), names, ["host", "template"], "paths")
        name = F.coalesce(F.element_at("names", seg), F.element_at("names", F.lit("*")))
        moved = moved.withColumn("template", F.concat("template", F.lit("/"), name)).select(*state.columns)
        state = cut(moved.unionByName(state.where(~active)))
    return state


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict; template, purity and labelled (urls) where no rule fits."""
    host, path = host_path(F.col("url"))
    url = pages.select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    url = url.select("*", text.alias("rule"), verdict.alias("ruled"))
    count = lambda x: F.sum(F.when(x, 1).otherwise(0)).alias
    counted = (
        url.groupBy("host", segments(F.col("path")).alias("segs"))
        .agg(F.count(F.lit(1)).alias("n"), count(F.col("ruled") == "allow")("allowed"), count(F.col("ruled") == "block")("blocked"))
    )
    leaves = templates(counted)
    sums = leaves.groupBy("host", "template").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"), F.count(F.lit(1)).alias("paths"))
    sums = sums.select("host", "template", "paths", purity(F.col("a"), F.col("b")).alias("purity"), (F.col("a") + F.col("b")).alias("labelled"))
    # paths with urls that no rule fits, by one text that names host and segments
    open_ = leaves.where("n > allowed + blocked").withColumn("open", F.col("n") - F.col("allowed") - F.col("blocked"))
    key = F.array_join(F.concat(F.array("host"), F.col("segs")), "/")
    judged = keyed(open_.select("host", "template", "open", key.alias("key")), sums, ["host", "template"], "paths")
    judged = cut(judged.select("key", "template", "purity", "labelled", "open"))
    own = F.array_join(F.concat(F.array("host"), segments(F.col("path"))), "/")
    free = keyed(url.where("ruled is null").withColumn("key", own), judged, ["key"], "open")
    cols = ["page_id", "host", "path", "rule", "verdict", "template", "purity", "labelled"]
    free = free.withColumn("verdict", F.when(F.col("purity") >= LEAST, "allow").otherwise("block")).select(*cols)
    fitted = url.where("ruled is not null").select(
        "page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity"), F.lit(None).cast("bigint").alias("labelled")
    )
    return fitted.unionByName(free)
