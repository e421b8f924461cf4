"""Near-duplicate groups by min-max hashing, with every link confirmed on full shingle sets.

1. One pass over the texts: distinct shingle hashes, a digest of the set, and band keys of the min-max signature.
2. Rows of equal sets are one group (aggregated before the shuffle); only its smallest document goes on.
3. Groups that share a band key are a bucket.  Buckets of equal members are one bucket.
4. Every member is compared with its bucket's leader (the smallest member), each pair of a leader and a member once over all
   buckets, in chunks of BUCKET_BLOCK members: work and texts moved grow with the members.  Members that are linked with a
   leader share its label.
5. Of a bucket only pairs of members with different labels are open.  In a bucket of more than BUCKET_BLOCK members, those
   without the commonest label first meet PIVOTS members that have it, and take that label if linked.
6. What is still open is compared in pairs of blocks: members without the commonest label with all others.  A bucket is BLOCKS
   blocks; only where these would hold more than BLOCK_SHINGLES shingles, it is more, of BUCKET_BLOCK members at least.  So a
   member goes to BLOCKS tasks at most however large its group, up to that bound of memory; no pair is ever a row, and no
   bucket is capped.  Pairs of sizes that can't link, or (in buckets of more than SMALL members) met in an earlier band or
   without a common shingle among their rarest ones, are left out.
7. Components of the links, by star steps.

With 24 bands of 4 values, a pair of likeness 0.85 shares no band with probability (1 - 0.85**4)**24 = 2e-8, one of
0.8 with 3e-6.

Defined cases: null, empty or wordless texts have an empty set and are linked with nothing; a text of fewer words than a
shingle is one shingle; rows of one doc_id count as one document; a null doc_id is linked with nothing, its component is
null and it is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, minmax
from .components import components
from .session import arrow_map, cut, fanout

BUCKET_BLOCK = 128
PIVOTS = 64
SMALL = 16
#: Blocks of a bucket, and shingles from which a block is cut further.
BLOCKS, BLOCK_SHINGLES = 4, 1 << 18
#: Text bytes that are hashed at once.
STEP_BYTES = 4 << 20


def set_rows(docs: DataFrame, words: int = minmax.SHINGLE) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (a 128-bit digest of the set, 0 for the empty set), bands."""

    def hashed(batches):
        for batch in batches:
            raw, at = kernels.flat(batch.column(1))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + STEP_BYTES, "right")) - 1)
                values, v_at = minmax.sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], words)
                n = np.diff(v_at)
                digests = np.zeros((j - i, 2), np.int64)
                for r in np.flatnonzero(n).tolist():
                    digests[r] = np.frombuffer(kernels.digest(values[v_at[r] : v_at[r + 1]]), np.int64)
                full = np.flatnonzero(n)
                keys = np.zeros((j - i, minmax.BANDS), np.uint64)
                if len(full):
                    keys[full] = minmax.bands(minmax.signatures(values, np.concatenate((v_at[full], v_at[-1:]))))
                ends = pa.array(np.arange(j - i + 1, dtype=np.int32) * minmax.BANDS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1).view(np.int64)))],
                    ["doc_id", "n_shingles", "d1", "d2", "bands"],
                )
                i = j

    return arrow_map(
        docs.select(F.col("doc_id").cast("bigint"), "text"),
        hashed,
        "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>",
    )


def bucket_links(percent: int, words: int = minmax.SHINGLE):
    """The work on buckets: rows (bucket, i, j, band, size, own block, doc_id, label, text), sorted by the first three and the
    own block.  If there are two blocks, only pairs across them are compared.  Pairs of one label are linked already."""

    def work(rows: list, band: int, size: int) -> list[tuple[int, int]]:
        own = [r[0] for r in rows]
        ids = [r[1] for r in rows]
        raw, at = kernels.flat_texts([(r[3] or "").encode() for r in rows])
        values, v_at = minmax.sets(raw, at, words)
        part = [values[v_at[i] : v_at[i + 1]] for i in range(len(rows))]
        n = np.diff(v_at)
        keys = None
        if size > SMALL and band > 0:
            keys = minmax.bands(minmax.signatures(values, v_at))[:, :band]
        rare = minmax.Rarest(values, v_at, percent) if len(rows) > SMALL else None
        root = np.array([r[2] for r in rows])
        split = own[0] != own[-1]
        half = own.index(own[-1]) if split else 0
        links = []
        for x in range(half if split else len(rows)):
            lo = half if split else x + 1
            if lo >= len(rows):
                break
            small, large = np.minimum(n[x], n[lo:]), np.maximum(n[x], n[lo:])
            may = (100 * small >= percent * large) & (root[lo:] != root[x])
            if keys is not None:
                may &= ~(keys[lo:] == keys[x]).any(axis=1)
            if rare is not None:
                may &= rare.meets(x)[lo:]
            for y in (np.flatnonzero(may) + lo).tolist():
                if root[x] != root[y] and minmax.linked(part[x], part[y], percent):
                    links.append((ids[x], ids[y]))
                    root[root == root[y]] = root[x]
        return links

    def links(batches):
        key, rows, head = None, [], (0, 0)
        out: list[tuple[int, int]] = []

        def made():
            b = pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())],
                ["a", "b"],
            )
            out.clear()
            return b

        for batch in batches:
            for bucket, i, j, band, size, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (bucket, i, j) != key:
                    if len(rows) > 1:
                        out += work(rows, *head)
                    key, rows, head = (bucket, i, j), [], (band, size)
                rows.append(row)
            if len(out) > 10_000:
                yield made()
        if len(rows) > 1:
            out += work(rows, *head)
        yield made()

    return links


TASK = ("bucket", "i", "j", "band", "size", "own", "rep", "label")


def near_links(docs: DataFrame, groups: DataFrame, percent: int, words: int = minmax.SHINGLE) -> DataFrame:
    """Links (a, b) between groups' documents that join all linked ones."""
    parts = fanout(docs)
    by_band = groups.select("rep", "n", F.posexplode("bands").alias("band", "bucket"))
    sizes = (
        by_band.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min("band").alias("band"),
            F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("s1"),
            F.bit_xor(F.xxhash64(F.lit(7), "rep")).alias("s2"),
            F.min(F.struct("rep", "n")).alias("least"),
        )
        .where("size > 1")
    )
    kept = (
        sizes.groupBy("size", "s1", "s2", "least")
        .agg(F.min(F.struct("band", "bucket")).alias("f"))
        .select("f.bucket", "f.band", "size", F.col("least.rep").alias("lead"), F.col("least.n").alias("lead_n"))
    )
    members = cut(by_band.select("bucket", "rep", "n").join(kept, "bucket"))  # n: shingles
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").where("rep is not null").repartition(parts, "rep")
    texts = cut(texts.join(members.select("rep").distinct(), "rep", "left_semi"))  # stays dealt by rep

    def met(tasks: DataFrame) -> DataFrame:
        """The links within tasks; a text goes to as many tasks as it has rows."""
        with_text = tasks.join(texts, "rep").select(*TASK, "text")
        dealt = with_text.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "own", "rep")
        return cut(arrow_map(dealt, bucket_links(percent, words), "a bigint, b bigint"))

    def task(df: DataFrame, i, j, own, band=0, size=0, bucket="bucket", rep="rep", label="label") -> DataFrame:
        made = {"bucket": bucket, "i": i, "j": j, "band": band, "size": size, "own": own, "rep": rep, "label": label}
        return df.select(*[(F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)).cast("bigint").alias(k) for k, v in made.items()])

    # every member with its leader
    can = F.lit(100) * F.least("n", "lead_n") >= F.lit(percent) * F.greatest("n", "lead_n")
    pairs = members.where((F.col("rep") != F.col("lead")) & can).groupBy("lead", "rep").agg(F.max("size").alias("size"))
    pairs = pairs.withColumn("chunk", F.pmod(F.xxhash64(F.lit(11), "rep"), F.ceil(F.col("size") / BUCKET_BLOCK)))
    heads = pairs.select("lead", "chunk").distinct()
    first = met(task(
        heads,
        "chunk",
        0,
        0,
        bucket="lead",
        rep="lead",
        label="lead",
    ).unionAll(task(pairs, "chunk", 0, 1, bucket="lead", label="rep")))
    labels = first.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("label"))

    # buckets without their leaders that have several labels
    rest = (
        members.where("rep <> lead")
        .join(labels, "rep", "left")
        .select("bucket", "band", "size", "rep", "n", F.coalesce("label", "rep").alias("label"))
    )
    counts = rest.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    several = (
        counts.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("most"))
        .where("kinds > 1")
    )
    several = cut(several.select("bucket", "all", F.col("most.label").alias("main"), F.col("most.n").alias("mains")))  # so that a large bucket's join can be split
    if several.isEmpty():
        return first
    open_ = cut(rest.join(several, "bucket"))
    found = [first]

    # large ones: outsiders with pivots of the commonest label
    left = open_
    if not several.where(F.col("all") > BUCKET_BLOCK).isEmpty():
        second, left = pivoted(open_, task, met)
        found.append(second)
    third = paired(left, task, met)
    return reduce(DataFrame.unionAll, [*found, *([third] if third is not None else [])])


def pivoted(open_: DataFrame, task, met) -> tuple[DataFrame, DataFrame]:
    """(links of large buckets' outsiders with pivots of the commonest label, the rest of all buckets)."""
    large = open_.where(F.col("all") > BUCKET_BLOCK)
    pivots = (
        large.where("label = main")
        .withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(13), "rep"), "rep")))
        .where(F.col("r") <= PIVOTS)
    )
    outside = (
        large.where("label <> main")
        .withColumn("chunk", F.pmod(F.xxhash64(F.lit(11), "rep"), F.ceil((F.col("all") - F.col("mains")) / BUCKET_BLOCK)))
    )
    chunks = outside.select("bucket", "chunk").distinct()
    second = met(task(pivots.join(chunks, "bucket"), "chunk", 0, 0, "band", "size").unionAll(task(outside, "chunk", 0, 1, "band", "size")))
    pivots = pivots.select("bucket", "rep", F.lit(True).alias("pivot"))
    joined = (
        second.join(pivots.select(F.col("rep").alias("a"), "bucket"), "a")
        .select("bucket", F.col("b").alias("rep"), F.lit(True).alias("in"))
        .distinct()
    )
    left = open_.join(pivots, ["bucket", "rep"], "left").where("pivot is null").join(joined, ["bucket", "rep"], "left")
    return second, left.withColumn("label", F.when(F.col("in"), F.col("main")).otherwise(F.col("label"))).select(*open_.columns)


def paired(left: DataFrame, task, met) -> DataFrame | None:
    """Links of the rest in pairs of blocks: outsiders' blocks come first and meet all blocks after them; None if there is nothing to compare."""
    sums = (
        left.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("left"), F.sum((F.col("label") != F.col("main")).cast("bigint")).alias("outs"), F.sum("n").alias("shingles"))
        .where("outs > 0 and left > 1")
    )
    sums = cut(sums)
    if sums.isEmpty():
        return None
    left = left.join(sums, "bucket")
    one = F.col("left") <= BUCKET_BLOCK
    # members of a block
    block = F.greatest(F.lit(BUCKET_BLOCK), F.ceil(F.col("left") / F.greatest(F.lit(BLOCKS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))))
    outs = F.when(one, F.lit(1)).otherwise(F.ceil(F.col("outs") / block))
    mains_blocks = F.when(one, F.lit(0)).otherwise(F.ceil((F.col("left") - F.col("outs")) / block))
    is_out = F.col("label") != F.col("main")
    h = F.xxhash64(F.lit(11), "rep")
    own = F.when(one, F.lit(0)).when(is_out, F.pmod(h, outs)).otherwise(outs + F.pmod(h, mains_blocks)).cast("int")
    blocks = left.select(
        "bucket",
        "band",
        "size",
        "rep",
        "label",
        own.alias("own"),
        outs.cast("int").alias("outs"),
        (outs + mains_blocks).cast("int").alias("blocks"),
    )
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("own") < F.col("outs"), F.col("blocks")).otherwise(F.col("outs")) - 1))
    blocks = blocks.withColumn("o", other)
    return met(task(blocks, F.least("own", "o"), F.greatest("own", "o"), "own", "band", "size"))


def near_groups(docs: DataFrame, percent: int = 85, words: int = minmax.SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links are pairs with 100 * intersection >= percent * union of their sets of shingles of ``words`` words."""
    rows = cut(set_rows(docs, words))
    full = rows.where("n_shingles > 0")
    groups = cut(full.where("doc_id is not null").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"),
        F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
    ))
    reps = groups.select("d1", "d2", "rep")
    # a document with rows of several sets links their groups through itself
    several = (
        full.groupBy("doc_id")
        .agg(F.min(F.struct("d1", "d2")).alias("x"), F.max(F.struct("d1", "d2")).alias("y"))
        .where("x <> y")
        .select("doc_id")
    )
    through = full.join(several, "doc_id").join(reps, ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = near_links(docs, groups, percent, words)
    linked = components(links.unionAll(through))
    reps = reps.join(linked, reps.rep == linked.node, "left").select("d1", "d2", F.coalesce("root", "rep").alias("root"))
    in_group = full.where("doc_id is not null").join(reps, ["d1", "d2"]).select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return in_group.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 85, words: int = minmax.SHINGLE) -> DataFrame:
    """docs with one document of each near-duplicate group: that of the smallest doc_id, once."""
    kept = near_groups(docs, percent, words).where("kept and doc_id is not null").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy("text")
    once = docs.join(kept, "doc_id", "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1").select(docs.columns)
    return once.unionAll(docs.where("doc_id is null"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: near_groups(docs, 85) with shingles of three words.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT b, root FROM reach JOIN edges ON a = node WHERE root < b),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, w.doc_id) AS component_id, coalesce(root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON node = w.doc_id
"""
