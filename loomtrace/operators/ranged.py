"""Joins on ranges and on the latest earlier row, without comparing all rows with all.

range_join(): an interval of length l is put on a grid of step 2**ceil(log2(l)), where it meets two cells at most; a point is
put into its cell on every grid that an interval uses (their number is the spread of lengths, not of rows).  Grid and cell are
the join's key, and the ends are compared exactly.  Cells that hold a large part of the points are dealt to several tasks,
their intervals repeated for each; the dealt points are written first, so that a lost executor changes nothing.

range_counts(): where only the number of an interval's points is asked for, no pair is made.  It is the number of points up to the
interval's stop less that of points before its start; both are sums over one list of points and ends, range-partitioned by value.  ranks() numbers rows by such sums over
the different values.

as_of_join(): both sides become one list, range-partitioned by key and time.  In a partition the latest right row is carried
along; what stood before a partition's first rows comes from a table of the last row of each key and partition.  A key with a
third of all rows is spread over as many partitions as it fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..shared import cut

#: A cell that holds more than this part of the points is dealt to several tasks.
CELLS = 256


def _grid(length: Column) -> Column:
    """The exponent of the smallest step that a length fits (lengths of zero have the finest one)."""
    return F.when(length <= 2.0**-20, F.lit(-20)).otherwise(F.ceil(F.log2(length))).cast("int")


def range_join(points: DataFrame, intervals: DataFrame, point: str, start: str, stop: str) -> DataFrame:
    """All columns of both sides (names must differ) of pairs with start <= point <= stop.

    Nulls and not-a-numbers match nothing; an interval whose stop is before its start is empty; repeated rows count repeatedly."""
    own = [c for c in points.columns]
    p = points.withColumn("__x", F.col(point).cast("double")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    i = intervals.withColumn("__a", F.col(start).cast("double")).withColumn("__z", F.col(stop).cast("double")).where("__a <= __z and not isnan(__z)")
    i = i.withColumn("__g", _grid(F.col("__z") - F.col("__a")))
    grids = sorted(r[0] for r in i.select("__g").distinct().collect())  # at most as many as there are exponents
    cell = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("__g"))).cast("bigint")
    i = i.withColumn("__c", F.explode(F.array_distinct(F.array(cell(F.col("__a")), cell(F.col("__z"))))))
    p = p.withColumn("__g", F.explode(F.array(*[F.lit(g) for g in grids]).cast("array<int>"))).withColumn("__c", cell(F.col("__x")))
    full = p.groupBy("__g", "__c").agg(F.count(F.lit(1)).alias("__n"))
    full = cut(full.where("__n > 1"))
    total = full.agg(F.sum("__n")).first()[0] or 0
    # CELLS cells of each grid at most
    heavy = full.where(F.col("__n") * F.lit(CELLS) > F.lit(total)).select("__g", "__c", F.ceil(F.col("__n") * F.lit(CELLS) / F.lit(max(total, 1))).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    p = p.join(F.broadcast(heavy), ["__g", "__c"], "left").withColumn("__s", F.pmod(F.xxhash64(*own, F.monotonically_increasing_id()), parts).cast("int"))
    i = i.join(F.broadcast(heavy), ["__g", "__c"], "left").withColumn("__s", F.explode(F.sequence(F.lit(0), parts - 1)))
    p = p.select(*own, "__x", "__g", "__c", "__s")
    if not heavy.isEmpty():  # a task that runs again may see rows in another order: what they were dealt to is kept
        p = cut(p)
    both = p.join(i.select(*intervals.columns, "__a", "__z", "__g", "__c", "__s"), ["__g", "__c", "__s"])
    return both.where("__a <= __x and __x <= __z").select(*own, *intervals.columns)


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), df.rdd.getNumPartitions())


def _up_to(rows: DataFrame, order: list[str], sums: list[str], n: int) -> DataFrame:
    """rows, whose ``order`` is different in each, with the columns of ``sums`` replaced by their sums over all rows up to each."""
    rows = cut(rows.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    here = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition
    before = rows.groupBy("__p").agg(*[F.sum(c).alias(c) for c in sums]).select("__p", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums])
    out = rows.select("*", *[F.sum(c).over(here).alias(f"{c}_here") for c in sums]).join(F.broadcast(before), "__p")
    return out.select(*[(F.col(f"{c}_here") + F.col(f"{c}_before")).alias(c) if c in sums else F.col(c) for c in rows.columns if c != "__p"])


def range_counts(points: DataFrame, intervals: DataFrame, point: str, start: str, stop: str, found: str = "n") -> DataFrame:
    """intervals' columns and ``found``: how many points have start <= point <= stop, as many as range_join() has rows of the interval.

    Whole numbers are compared as such, others as doubles."""
    types = [points.schema[point].dataType, intervals.schema[start].dataType, intervals.schema[stop].dataType]
    kind = "bigint" if all(isinstance(t, IntegralType) for t in types) else "double"
    p = points.select(F.col(point).cast(kind).alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x")).groupBy("__x").agg(F.count(F.lit(1)).alias("__w"))
    i = intervals.withColumn("__a", F.col(start).cast(kind)).withColumn("__z", F.col(stop).cast(kind)).withColumn("__any", F.expr("coalesce(__a <= __z and not isnan(__z), false)"))
    # at one value: starts, points, stops
    end = lambda c, side: i.where("__any").select(F.col(c).alias("__x")).distinct().select("__x", F.lit(0).cast("bigint").alias("__w"), F.lit(side).alias("__side"))
    every = p.withColumn("__side", F.lit(1)).unionByName(end("__a", 0)).unionByName(end("__z", 2))
    up_to = _up_to(every, ["__x", "__side"], ["__w"], _tasks(points))
    ends = [up_to.where(f"__side = {side}").select(F.col("__x").alias(c), F.col("__w").alias(f"{c}n")) for side, c in ((0, "__a"), (2, "__z"))]
    both = i.join(ends[0], "__a", "left").join(ends[1], "__z", "left")
    return both.select(*intervals.columns, F.when(F.col("__any"), F.col("__zn") - F.col("__an")).otherwise(F.lit(0)).alias(found))


def ranks(df: DataFrame, by: str) -> DataFrame:
    """df's columns, rank, dense_rank, percent_rank and cume_dist of ``by`` over all rows, as windows without a partition have them, but not in one task."""
    values = df.groupBy(F.col(by).alias("__v")).agg(F.count(F.lit(1)).alias("__w")).select("__v", "__w", F.col("__w").alias("__up"), F.lit(1).cast("bigint").alias("__k"))
    n = df.count()
    known = _up_to(values, ["__v"], ["__up", "__k"], _tasks(df))
    rank = F.col("__up") - F.col("__w") + 1
    percent = (rank - 1).cast("double") / F.lit(float(max(n - 1, 1)))
    places = [rank.alias("rank"), F.col("__k").alias("dense_rank"), percent.alias("percent_rank"), (F.col("__up").cast("double") / F.lit(float(max(n, 1)))).alias("cume_dist")]
    return df.join(known, F.col(by).eqNullSafe(F.col("__v"))).select(*df.columns, *places)


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, found: str = "found", strict: bool = False) -> DataFrame:
    """left's columns and ``found``: the value of the right row of the same keys with the latest time up to left's (with ``strict``: before it), null if there is none.

    Of right rows of one time that of the largest value counts.  Rows with a null key or time find nothing; keys may be empty."""
    here = [f"__k{i}" for i in range(len(keys))]
    key = lambda df: [F.col(k).alias(a) for k, a in zip(keys, here, strict=True)]
    known = " and ".join(f"{k} is not null" for k in [*here, "__t"])
    l = left.select(*key(left), F.col(time).alias("__t"), F.struct(*left.columns).alias("__row"))  # noqa: E741
    r = right.select(*key(right), F.col(time).alias("__t"), F.col(value).alias("__v")).where(f"{known} and __v is not null")
    # at one time: right rows first, by value, unless only earlier ones count
    side = F.lit(-1 if strict else 1)
    every = l.where(known).select(*here, "__t", side.alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), "__row")
    every = every.unionByName(r.select(*here, "__t", F.lit(0).alias("__side"), "__v", F.lit(None).cast(every.schema["__row"].dataType).alias("__row")))
    order = [*here, "__t", "__side", "__v"]
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), left.rdd.getNumPartitions())
    every = cut(every.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    last = F.last("__v", ignorenulls=True)
    near = last.over(Window.partitionBy("__p", *here).orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0))
    ends = every.where("__side = 0").groupBy("__p", *here).agg(F.max_by("__v", F.struct("__t", "__v")).alias("__last"))
    there = every.select("__p", *here).distinct()
    carried = there.join(ends, ["__p", *here], "left").withColumn("__before", F.last("__last", ignorenulls=True).over(Window.partitionBy(*here).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    out = every.withColumn("__near", near).where("__row is not null").join(carried.select("__p", *here, "__before"), ["__p", *here], "left")
    out = out.select("__row.*", F.coalesce("__near", "__before").alias(found))
    return out.unionByName(l.where(f"not coalesce({known}, false)").select("__row.*", F.lit(None).cast(right.schema[value].dataType).alias(found)))
