"""The prefix trie of conversations, by sorted matrices of turn ids.

A turn's id is the digest (128 bits of SHA-256) of its role and text.  Rebuilt conversations become rows of ids, cut into blocks of BLOCK turns;
a block's row also has the digest of all blocks before it.  Rows are range-partitioned by (block, digest before, ids, whether the conversation goes on,
conv_id).  Each shard sorts its rows with numpy (lexsort on columns padded at the end, WIDTH columns at a time, only rows that reach them),
marks where a row first differs from the row before (change masks, accumulated by OR from left to right), and so has the starts of
all nodes of every depth; reduceat adds up each depth.  How far a shard's first row agrees with the last row of the shard before
is found first, so that sums over the parts of a node that several shards hold are right; those boundary nodes are put together by key.

At scale: texts are hashed where they are read and never move.  Turns get their places in ordered buckets of about equal size, so
a conversation with a third of all turns is spread; its blocks are rows of their own.  What later blocks add to a node of an earlier one comes as
sums by conversation.  ``ends_sha256`` of a boundary node is hashed as a stream over its shards' pieces, in order.

Defined cases: turns without a conv_id belong to no conversation; turns are ordered by turn (null first), of equal turns by the digest; repeated
turns count repeatedly; null role or text is empty; conv_id % 5 has the sign of conv_id; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import OrderedBuckets, arrow_map, cut, fanout, keyed

#: Turns of a block; columns that are sorted at a time; turns of a shard, about.
BLOCK, WIDTH, SHARD = 512, 16, 400_000
#: h of the query: the digest of a conv_id modulo this is how many turns come from conv - conv % GROUP.
HEADS, GROUP = 9, 5
OUT = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
PART = "shard int, key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends string, whole boolean"
NONE = hashlib.sha256(b"").hexdigest()


def halves(digest: Column) -> tuple[Column, Column]:
    """The first 128 bits of a digest in hex as two longs."""
    return tuple(F.conv(F.substring(digest, at, 16), 16, -10).cast("bigint") for at in (1, 17))


def placed(conversations: DataFrame, parts: int) -> DataFrame:
    """conv, pos (from 0), hi, lo, bytes of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hi, lo = halves(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    t = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 63))).alias("turn"),
        F.col("turn").isNotNull().cast("bigint").alias("there"),
        hi.alias("hi"),
        lo.alias("lo"),
        F.octet_length(text).cast("bigint").alias("bytes"),
        # tells equal rows apart, so that they can be spread; which of them comes first makes no difference
        F.monotonically_increasing_id().alias("row"),
    )
    t = cut(t)
    order = ["conv", "turn", "there", "hi", "lo", "row"]
    t = t.withColumn("bucket", OrderedBuckets(t, [F.col(c) for c in order], parts).of(*[F.col(c) for c in order]))
    near = Window.partitionBy("bucket", "conv").orderBy(*order[1:])
    t = t.withColumn("pos", F.row_number().over(near) - 1)
    # a cut parts one conversation at most, so those with turns in earlier buckets are fewer than buckets
    counts = t.groupBy("conv", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("conv", "bucket", before.alias("offset")).where("offset > 0")
    t = t.join(F.broadcast(offsets), ["conv", "bucket"], "left")
    return t.select("conv", (F.col("pos") + F.coalesce("offset", F.lit(0))).alias("pos"), "hi", "lo", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, hi, lo, bytes) of rebuilt conversations, and (conv, turns) of all of them: the first h turns of conv - conv % 5, then the own ones from h on."""
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    base = F.col("conv") - F.expr(f"conv % {GROUP}")
    convs = sizes.select("conv", "own", h.alias("h"), base.alias("base"))
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("own").alias("first")), "base", "left")
    convs = cut(convs.select("conv", "base", "own", "h", F.least("h", F.coalesce("first", F.lit(0))).alias("head")))
    head = turns.where((F.col("pos") < HEADS - 1) & (F.expr(f"conv % {GROUP}") == 0)).withColumnRenamed("conv", "base")
    head = head.join(convs.select("conv", "base", "head"), "base").where("pos < head").select("conv", "pos", "hi", "lo", "bytes")
    own = keyed(turns, convs.select("conv", "own", "h", "head"), ["conv"], "own").where("pos >= h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "hi", "lo", "bytes")
    return head.unionByName(own), convs.select("conv", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns"))


def blocked(turns: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """Rows conv, blk, hi, lo, bytes (arrays by place), whether the conversation goes on (more), digests of the blocks before (p0, p1) and up to this one (q0, q1; of full blocks)."""
    size = lambda c: F.col(c) * F.lit(block)
    item = F.struct("pos", "hi", "lo", "bytes")
    some = turns.select("conv", F.floor(F.col("pos") / block).alias("blk"), item.alias("t"))
    bare = convs.where("turns = 0").select("conv", F.lit(0).cast("bigint").alias("blk"), F.lit(None).cast(some.schema["t"].dataType).alias("t"))
    rows = some.unionByName(bare).groupBy("conv", "blk").agg(F.array_sort(F.collect_list("t")).alias("t"))
    rows = rows.select("conv", "blk", *[F.col("t")[c].alias(c) for c in ("hi", "lo", "bytes")])
    full = F.size("hi") == block
    text = F.concat_ws(",", F.col("blk").cast("string"), F.array_join(F.col("hi").cast("array<string>"), ","), F.array_join(F.col("lo").cast("array<string>"), ","))
    own = halves(F.sha2(text, 256))
    zero = F.lit(0).cast("bigint")
    rows = cut(rows.select("*", *[F.when(full, x).alias(f"d{i}") for i, x in enumerate(own)]))
    # of conversations with a full block only: digests of whole beginnings, as the exclusive or of their blocks' digests (which have the block's number in)
    way = Window.partitionBy("conv").orderBy("blk")
    here, past = way.rowsBetween(Window.unboundedPreceding, 0), way.rowsBetween(Window.unboundedPreceding, -1)
    long_ = rows.join(convs.where(F.col("turns") >= block), "conv").select("conv", "blk", "d0", "d1", (F.col("turns") > size("blk") + block).alias("more"))
    long_ = long_.select("conv", "blk", "more", *[F.coalesce(F.expr(f"bit_xor(coalesce(d{i}, 0))").over(w), zero).alias(f"{n}{i}") for n, w in (("p", past), ("q", here)) for i in (0, 1)])
    short = rows.join(convs.where(F.col("turns") < block).select("conv"), "conv").drop("d0", "d1")
    short = short.select("*", F.lit(False).alias("more"), *[zero.alias(n) for n in ("p0", "p1", "q0", "q1")])
    return short.unionByName(rows.drop("d0", "d1").join(long_, ["conv", "blk"]))


# --- a shard ---


class Shard:
    """The sorted rows of a shard, and where each first differs from the row before."""

    def __init__(self, table, before: int, after: int):
        """``before``: how many turns the first row shares with the row before it (-1: another group of rows); ``after``: the last row with the row after it."""
        import pyarrow.compute as pc

        n = table.num_rows
        plain = lambda c: table.column(c).to_numpy()
        lengths = pc.list_value_length(table.column("hi")).to_numpy().astype(np.int64)
        flat = [table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("hi", "lo", "bytes")]
        # ids as ranks from 1 on: 0 is the end of a row, before all ids
        pairs = np.empty(len(flat[0]), dtype=[("hi", np.int64), ("lo", np.int64)])
        pairs["hi"], pairs["lo"] = flat[0], flat[1]
        by = np.lexsort((pairs["lo"], pairs["hi"]))
        rank = np.empty(len(by), dtype=np.int64)
        if len(by):
            s = pairs[by]
            rank[by] = np.cumsum(np.concatenate([[True], (s["hi"][1:] != s["hi"][:-1]) | (s["lo"][1:] != s["lo"][:-1])]))
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if n else np.zeros(0, dtype=np.int64)

        def columns(values, rows, at, width):
            """A matrix of the values of some rows at places at, at + 1, ...; 0 behind a row's end."""
            place = at + np.arange(width)
            inside = place[None, :] < lengths[rows][:, None]
            index = np.where(inside, start[rows][:, None] + place[None, :], 0)
            return np.where(inside, values[index], 0) if len(values) else np.zeros((len(rows), width), dtype=np.int64)

        most = int(lengths.max(initial=0))
        ats = list(range(0, most, WIDTH))
        rest = np.zeros(n, dtype=np.int64)  # the order of what follows the columns that are sorted already
        for at in reversed(ats):
            rows = np.flatnonzero(lengths > at)
            m = columns(rank, rows, at, WIDTH)
            keys = [rest[rows], *m.T[::-1]]
            o = np.lexsort(keys)
            changed = np.zeros(len(rows), dtype=bool)
            for k in keys:
                changed[1:] |= k[o][1:] != k[o][:-1]
            rest[:] = 0
            rest[rows[o]] = 1 + np.cumsum(changed)
        more, conv, blk = plain("more"), plain("conv"), plain("blk")
        group = [plain(c) for c in ("p1", "p0", "blk")]
        o = np.lexsort((conv, more, rest, *group))
        self.n, self.order, self.conv, self.more, self.blk = n, o, conv[o], more[o], blk[o]
        self.group, self.next = [g[o] for g in group], [plain(c)[o] for c in ("q0", "q1")]
        lengths, start = lengths[o], start[o]
        self.lengths, self.start, self.flat = lengths, start, flat
        # OR-accumulated changes, column block by column block: first depth at which a row differs from the one before
        self.fresh = np.zeros(n, dtype=bool)
        for g in self.group:
            self.fresh[1:] |= g[1:] != g[:-1]
        first = np.where(self.fresh, 0, lengths + 1)
        carry = self.fresh.copy()
        if n:
            carry[0], first[0] = True, before + 1  # row 0 is compared with the shard before
            self.fresh[0] = before < 0
        for at in ats:
            rows = np.flatnonzero(lengths > at)
            rows = rows[~carry[rows]]
            if not len(rows):
                continue
            differ = columns(rank, rows, at, WIDTH) != columns(rank, rows - 1, at, WIDTH)
            differ &= at + np.arange(WIDTH)[None, :] < lengths[rows][:, None]
            mask = np.logical_or.accumulate(differ, axis=1)
            new = mask[:, -1]
            first[rows[new]] = at + 1 + np.argmax(mask[new], axis=1)
            carry[rows] |= new
        self.first = first  # nodes of depths first .. length start in this row
        shared = np.full(n, after, dtype=np.int64)
        shared[:-1] = np.where(self.fresh[1:], -1, first[1:] - 1)
        # the last row of a node that no row goes on from is counted as its leaf
        self.leaf = ~self.more & (shared < lengths)
        self.after = after

        self.total = np.concatenate([[0], np.cumsum(flat[2])])

    def bytes_from(self, depth, rows=slice(None)) -> np.ndarray:
        """Bytes of the rows' turns from a depth (1: the first) on."""
        start = self.start[rows]
        end = start + self.lengths[rows]
        return self.total[end] - self.total[np.minimum(start + np.maximum(depth, 1) - 1, end)]


def unpack(batches):
    import pyarrow as pa

    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept).combine_chunks() if kept else None


def own_sums(shares: dict):
    """Of each row of later blocks: its bytes, those of nodes that it starts, whether it is counted as a leaf."""

    def run(batches):
        import pyarrow as pa

        if (table := unpack(batches)) is None:
            return
        s = Shard(table, *shares[table.column("shard")[0].as_py()])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s.conv, s.blk, s.bytes_from(1), s.bytes_from(s.first), s.leaf.astype(np.int64))], names=["conv", "blk", "bytes_in", "start_in", "leaf_in"])

    return run


def nodes(shares: dict, block: int):
    """The nodes of a shard, of every depth; those that touch its first or last row, or a block's end, are parts to be put together."""

    def run(batches):
        import pyarrow as pa

        if (table := unpack(batches)) is None:
            return
        shard = table.column("shard")[0].as_py()
        before, after = shares[shard]
        s = Shard(table, before, after)
        tail = {c: table.column(c).to_numpy()[s.order] for c in ("tail_bytes", "tail_start", "tail_leaf")}
        leaf = s.leaf.astype(np.int64) + tail["tail_leaf"]
        names = [f.split()[0] for f in PART.split(", ")]

        def key(row: int, depth: int) -> bytes:
            """The name of a node that several shards may have."""
            if depth == block:
                return struct.pack(">qqqq", 1, int(s.blk[row] + 1) * block, int(s.next[0][row]), int(s.next[1][row]))
            prefix = [int(s.group[i][row]) for i in (1, 0)]
            if depth == 0:
                return struct.pack(">qqqq", 1, int(s.blk[row]) * block, *prefix)
            ids = b"".join(s.flat[i][s.start[row] : s.start[row] + depth].tobytes() for i in (0, 1))
            return struct.pack(">qqqq", 2, int(s.blk[row]) * block + depth, *prefix) + hashlib.sha256(ids).digest()[:16]

        parent = None  # of the depth above: node numbers by row, conv_ids, keys of those that are parts
        for depth in range(int(s.lengths.max(initial=0)) + 1):
            rows = np.flatnonzero(s.lengths >= depth)
            begins = s.fresh[rows] | (s.first[rows] <= depth) if depth else s.fresh[rows].copy()
            begins[0] = True
            at = np.flatnonzero(begins)
            add = lambda x: np.add.reduceat(x.astype(np.int64), at)  # noqa: B023, E731
            number = np.cumsum(begins) - 1
            count = np.diff(np.append(at, len(rows)))
            conv = np.minimum.reduceat(s.conv[rows], at)
            saved = add(s.bytes_from(depth, rows) + tail["tail_bytes"][rows]) - add(s.bytes_from(np.maximum(s.first[rows], depth), rows) + tail["tail_start"][rows])
            children = add((s.first[rows] <= depth + 1) & (s.lengths[rows] > depth))
            leaves = add(leaf[rows])
            heads = rows[at]
            base = s.blk[heads] * block
            part = np.zeros(len(at), dtype=bool)
            # parts: nodes of the first or last row that the shard before or after may have too, those at a block's end, and the beginnings of later blocks
            if rows[0] == 0 and depth <= before:
                part[0] = True
            if rows[-1] == s.n - 1 and depth <= after:
                part[-1] = True
            if depth == block:
                part[:] = True
            again = np.zeros(len(at), dtype=bool)
            if depth == 0:
                again = base > 0  # the node is one of the block before: only its children are here
                part |= again
            keys = [key(int(heads[i]), depth) if part[i] else None for i in range(len(at))] if part.any() else [None] * len(at)
            ends = [""] * len(at)
            done = rows[(s.lengths[rows] == depth) & ~s.more[rows]]
            if len(done):
                of = np.full(s.n, -1)
                of[rows] = number
                own = of[done]
                cuts = np.flatnonzero(np.diff(own)) + 1
                for group, i in zip(np.split(done, cuts), own[np.append(0, cuts)], strict=True):
                    ends[i] = ",".join(map(str, s.conv[group].tolist()))
            hashed = [e if p else (hashlib.sha256(e.encode()).hexdigest() if e else NONE) for e, p in zip(ends, part, strict=True)]
            if parent is None:
                up_conv, up_key = [None] * len(at), [None] * len(at)
            else:
                above = parent[0][heads]
                up_key = [parent[2][i] for i in above]
                up_conv = [None if k is not None else int(parent[1][i]) for i, k in zip(above, up_key, strict=True)]
            zero = np.zeros_like(count)
            pick = lambda x: np.where(again, zero, x)  # noqa: B023, E731
            columns = [
                pa.array(np.full(len(at), shard), pa.int32()), pa.array(keys, pa.binary()), pa.array(up_key, pa.binary()),
                pa.array(conv, mask=again), pa.array(base + depth), pa.array(up_conv, pa.int64()),
                pa.array(pick(count)), pa.array(children), pa.array(pick(leaves)), pa.array(pick(saved)), pa.array(hashed, pa.string()), pa.array(~part),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            of = np.full(s.n, -1)
            of[rows] = number
            parent = (of, conv, keys)

    return run


def streamed(batches):
    """SHA-256 of each key's pieces, which come in order: key, ends_sha256."""
    import pyarrow as pa

    now, state = None, None
    for b in batches:
        out = []
        for key, piece in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if key != now:
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def sharded(rows: DataFrame, parts: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """rows in range partitions (column shard), and how many turns each shard's first row shares with the row before, its last with the row after (-1: none of their group)."""
    ids = F.arrays_zip("hi", "lo")
    dealt = rows.withColumn("ids", ids).repartitionByRange(parts, "blk", "p0", "p1", "ids", "more", "conv").drop("ids")
    dealt = cut(dealt.withColumn("shard", F.spark_partition_id()))
    place = F.struct("blk", "p0", "p1", ids.alias("ids"), "more", "conv")
    ends = cut(dealt.groupBy("shard").agg(F.min(place).alias("a"), F.max(place).alias("z")))
    order = sorted(r.shard for r in ends.select("shard").collect())
    if not order:
        return dealt, {}
    follows = rows.sparkSession.createDataFrame(list(zip(order, order[1:], strict=False)), "shard int, following int")
    both = ends.select("shard", "z").join(follows, "shard").join(ends.select(F.col("shard").alias("following"), "a"), "following")
    same = F.zip_with("z.ids", "a.ids", lambda x, y: F.equal_null(x, y))
    n = F.array_position(same, F.lit(False))
    shared = F.when(F.col("z.blk").eqNullSafe(F.col("a.blk")) & (F.col("z.p0") == F.col("a.p0")) & (F.col("z.p1") == F.col("a.p1")), F.when(n == 0, F.size(same)).otherwise(n - 1)).otherwise(-1)
    found = {r.following: r.n for r in both.select("following", shared.cast("int").alias("n")).collect()}
    return dealt, {x: (found.get(x, -1), found.get(y, -1)) for x, y in zip(order, [*order[1:], None], strict=True)}


def trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = cut(placed(conversations, fanout(conversations)))
    made, convs = rebuilt(turns)
    convs = cut(convs)
    count, longest = convs.agg(F.sum("turns"), F.max("turns")).first()
    parts = max(fanout(conversations), (count or 0) // SHARD + 1)
    rows = cut(blocked(made, convs, block))
    zero = F.lit(0).cast("bigint")
    if (longest or 0) > block:  # what later blocks add to nodes of earlier ones
        later, shares = sharded(rows.where("blk > 0"), parts)
        sums = arrow_map(later, own_sums(shares), "conv bigint, blk bigint, bytes_in bigint, start_in bigint, leaf_in bigint")
        every = rows.where("more and blk = 0").select("conv", "blk", zero.alias("bytes_in"), zero.alias("start_in"), zero.alias("leaf_in")).unionByName(sums)
        rest = Window.partitionBy("conv").orderBy("blk").rowsBetween(1, Window.unboundedFollowing)
        tails = every.select("conv", "blk", *[F.sum(f"{a}_in").over(rest).alias(f"tail_{b}") for a, b in (("bytes", "bytes"), ("start", "start"), ("leaf", "leaf"))])
        rows = rows.join(tails, ["conv", "blk"], "left").na.fill(0, ["tail_bytes", "tail_start", "tail_leaf"])
    else:
        rows = rows.select("*", *[zero.alias(f"tail_{b}") for b in ("bytes", "start", "leaf")])
    dealt, shares = sharded(rows, parts)
    found = cut(arrow_map(dealt, nodes(shares, block), PART))
    # boundary nodes
    split = found.where("not whole")
    once = split.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
    )
    pieces = split.where("ends <> ''").select("key", "shard", "ends").repartition(parts, "key").sortWithinPartitions("key", "shard")
    hashed = arrow_map(pieces.select("key", "ends"), streamed, "key binary, ends_sha256 string")
    once = cut(once.join(hashed, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE))))
    # parents that are boundary nodes: each shard has its own of them by its side
    known = once.select("key", F.col("conv_id").alias("up"))
    by_shard = split.select("shard", "key").distinct().join(known, "key").withColumnRenamed("key", "parent_key")
    inner = found.where("whole").withColumnRenamed("ends", "ends_sha256").drop("key", "whole")
    inner = inner.where("parent_key is null").withColumn("up", F.lit(None).cast("bigint")).unionByName(inner.where("parent_key is not null").join(by_shard, ["shard", "parent_key"], "left")).drop("shard")
    outer = once.drop("key").join(known.withColumnRenamed("key", "parent_key"), "parent_key", "left")
    both = inner.unionByName(outer)
    return both.select("conv_id", "depth", F.coalesce("parent_conv_id", "up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


ORACLE = f"""
WITH x AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, count(*) AS n FROM o GROUP BY c),
v AS (SELECT c, n, c - c % {GROUP} AS b, xor(list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda k: CAST(ord(k) AS BIGINT)),
  lambda a, k: xor(a >> 8, x.t[(xor(a, k) & 255) + 1])), 4294967295) % {HEADS} AS h FROM s, x),
w AS (SELECT v.*, least(h, coalesce(s.n, 0)) AS k FROM v LEFT JOIN s ON s.c = v.b),
q AS (SELECT w.c, o.p, r, t FROM w JOIN o ON o.c = w.b AND o.p < h UNION ALL SELECT w.c, o.p - h + k, r, t FROM w JOIN o ON o.c = w.c AND o.p >= h),
m AS (SELECT c, p + 1 AS d, strlen(t) AS bytes, md5(string_agg(md5(strlen(r) || ':' || r || t), ',') OVER (PARTITION BY c ORDER BY p)) AS node FROM q UNION ALL SELECT c, 0, 0, '' FROM s),
l AS (SELECT c, max(d) AS last FROM m GROUP BY c),
g AS (SELECT m.d, m.node, min(m.c) AS conv_id, count(*) AS n, min(m.bytes) AS bytes, min(u.node) AS up,
  coalesce(string_agg(CASE WHEN l.last = m.d THEN CAST(m.c AS VARCHAR) END, ',' ORDER BY m.c), '') AS ends FROM m JOIN l ON l.c = m.c LEFT JOIN m u ON u.c = m.c AND u.d = m.d - 1 GROUP BY m.d, m.node),
k AS (SELECT d - 1 AS d, up AS node, count(*) AS kids FROM g WHERE d > 0 GROUP BY ALL),
e AS (SELECT g.*, coalesce(kids, 0) AS kids FROM g LEFT JOIN k ON k.d = g.d AND k.node = g.node),
f AS (SELECT a.d, a.node, sum((e.n - 1) * e.bytes) AS saved, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves FROM e JOIN m a ON a.c = e.conv_id AND a.d <= e.d GROUP BY a.d, a.node)
SELECT e.conv_id, e.d AS depth, p.conv_id AS parent_conv_id, e.n AS n_convs, e.kids AS n_children, CAST(f.leaves AS BIGINT) AS n_leaves, CAST(f.saved AS BIGINT) AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM e JOIN f ON f.d = e.d AND f.node = e.node LEFT JOIN g p ON p.d = e.d - 1 AND p.node = e.up
"""
