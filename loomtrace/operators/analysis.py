"""Names, stars, column traces, lineage graph, semantics and locations as joins over the parsed rows.

One Analysis covers any number of statements: every table is keyed by query_id, and every step is one set of joins for
all of them.  Loops run over the depth of nesting (known from the parse), not over statements.
"""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Iterable
from functools import cached_property, reduce, wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans import parsed
from .. import shared
from ..shared import brought, cut, quick, small_table

ROOT = parsed.ROOT
KEY = ["query_id", "owner", "segment_index"]

#: What a diagnostic says of its subject, and what helps.
MESSAGES = (
    ("PARSE_ERROR", "the statement does not parse", "correct the statement where the parser gave up"),
    ("UNKNOWN_TABLE", "the table {} is not in the catalog", "import its metadata, or correct its name"),
    ("UNKNOWN_COLUMN", "no table in scope has a column {}", "correct the name, or import the table's metadata"),
    ("AMBIGUOUS_COLUMN", "{} is a column of several tables in scope", "name the table before the column"),
    ("DUPLICATE_ALIAS", "the alias {} is given twice in one scope", "give each relation an alias of its own"),
    ("STAR_EXPANSION_FAILED", "{} cannot be expanded: no columns are known", "import the metadata of the tables, or list the columns"),
    ("NOT_SUPPORTED_IN_P0", "{} leads to no column", None),
    ("RECURSIVE_CTE_UNSUPPORTED", "the CTE {} refers to itself", "check the columns of its recursive part"),
    ("WRITE_COLUMNS_DIFFER", "the values that are written to {} are not as many as its columns", "list the target's columns"),
)
#: The stage that a table of the analysis belongs to.
STAGES = {
    "relations": "scope", "_tops": "scope", "scopes": "scope", "resolved": "name_resolution", "_levels": "projection", "_outputs": "projection", "expressions": "expression_analysis", "expression_parts": "expression_analysis",
    "_steps": "lineage", "_ends": "lineage", "row_sources": "lineage", "correlated": "lineage", "outer_keys": "lineage", "writes": "lineage", "write_sources": "lineage", "edges": "lineage", "locations": "source_location", "_places": "source_location", "node_locations": "source_location",
    "nodes": "graph", "summary": "graph", "grain": "semantics", "filters": "semantics", "metrics": "semantics", "joins": "semantics", "dedup": "semantics", "risks": "semantics", "semantics": "semantics",
}


def every(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def stage(make):
    """A table of the analysis, written once it is made: later stages read it, so that plans stay small and nothing runs twice."""

    @wraps(make)
    def kept(self):
        self.inside += 1
        started, self.nested = time.perf_counter(), [*self.nested, 0.0]
        try:
            return self.keep(make(self))
        finally:
            self.inside -= 1
            took, (*self.nested, inner) = time.perf_counter() - started, self.nested
            self.spent[STAGES.get(make.__name__, "other")] += took - inner  # without the stages that it asked for
            if self.nested:
                self.nested[-1] += took
            if not self.inside:
                self.settle()

    return cached_property(kept)


class Analysis:
    """Analysis of (query_id, sql) statements against catalog columns (catalog, schema_name, table_name, column_name, data_type, ordinal, is_partition; comment if there).

    ``extended`` shows true join types, and joins without a condition as errors; otherwise the report's join type is always
    'inner'.  ``disambiguate_by_join`` takes an unqualified column for its first relation's where all its relations are
    joined by equality on it; for USING and NATURAL joins that always holds.
    """

    def __init__(self, spark: SparkSession, statements: Iterable[tuple[str, str]], columns: DataFrame, dialect: str = "spark", extended: bool = False, disambiguate_by_join: bool = False):
        self.extended, self.by_join, caller = extended, disambiguate_by_join, spark
        #: Seconds of each stage so far.
        self.spent: Counter = Counter()
        self.nested: list[float] = []
        started = time.perf_counter()
        # the parsed rows of a large corpus are written batch by batch: the driver holds those of one batch
        folder, rows, self.has = None, {}, set()
        self.depth, self.owners, self.natural, self.cyclic, self.stars = 0, 0, False, False, False
        for more in parsed.batches(spark, statements, dialect):
            if rows and folder is None:
                folder = f"{shared.shared_folder(spark).rstrip('/')}/parsed-{uuid.uuid4().hex}"
            if folder:
                self.write_batch(spark, rows, folder)
            rows = more
            self.has |= {k for k, v in rows.items() if v}
            self.depth = max(self.depth, max((r[2] for r in rows["owners"]), default=0))
            self.stars |= any(r[7] == "star" for r in rows["select_items"])
            self.natural |= any(r[3] == "natural_join" for r in rows["clauses"])
            self.cyclic |= any(r[3] for r in rows["owners"])
            self.owners = max(self.owners, max(Counter(r[0] for r in rows["owners"]).values(), default=0))
        rows = rows or {k: [] for k in parsed.SCHEMAS}
        if folder:
            self.write_batch(spark, rows, folder)
        self.spent["parse"] = time.perf_counter() - started
        comment = F.col("comment") if "comment" in columns.columns else F.lit(None).cast("string")
        self.catalog = columns.select(
            "catalog",
            "schema_name",
            "table_name",
            "column_name",
            "data_type",
            "ordinal",
            "is_partition",
            comment.alias("comment"),
        )
        # what is parsed is on the driver already; of few statements the tables that they name, and all that is derived,
        # stay there as long as they are small; others are written
        self.keep = cut
        if not folder and sum(map(len, rows.values())) <= shared.FEW:
            self.keep = brought
            names = sorted({r[7].strip("`\" ").lower() for r in rows["relations"]} | {r[6].strip("`\" ").lower() for r in rows["writes"]})
            named = self.catalog.where(ids.normal(F.col("table_name")).isin(names)).limit(shared.FEW + 1).toArrow()
            if named.num_rows <= shared.FEW:
                spark = quick(spark)
                self.catalog = spark.createDataFrame(named, self.catalog.schema)
        self.caller, self.spark, self.inside = caller, spark, 0
        for name, ddl in parsed.SCHEMAS.items():
            table = spark.read.schema(ddl).parquet(f"{folder}/{name}") if folder and name in self.has else small_table(spark, [] if folder else rows[name], ddl)
            setattr(self, "p_" + name, table)
        self.settle()

    @staticmethod
    def write_batch(spark: SparkSession, rows: dict[str, list], folder: str) -> None:
        for name, ddl in parsed.SCHEMAS.items():
            if rows[name]:
                small_table(spark, rows[name], ddl).write.mode("append").parquet(f"{folder}/{name}")

    def settle(self) -> None:
        """Making local tables leaves their session the active one; the caller's is that again."""
        if self.spark is not self.caller:
            self.caller.createDataFrame([], "none int")

    # --- relations and their columns ---

    @stage
    def relations(self) -> DataFrame:
        """Relations with found (in the catalog), entity_id and relation_id."""
        known = (
            self.catalog.select(
                F.col("catalog").alias("k_c"),
                F.col("schema_name").alias("k_s"),
                ids.normal(F.col("table_name")).alias("k_t"),
            )
            .distinct()
        )
        r = self.p_relations.join(
            known,
            (F.col("kind") == "table") & (F.col("catalog") == F.col("k_c")) & (F.col("schema") == F.col("k_s")) & (ids.normal(F.col("table")) == F.col("k_t")),
            "left",
        )
        return r.select(
            *self.p_relations.columns,
            ((F.col("kind") != "table") | F.col("k_t").isNotNull()).alias("found"),
            ids.table_id(F.col("catalog"), F.col("schema"), F.col("table")).alias("entity_id"),
            ids.relation_id(F.col("alias")).alias("relation_id"),
        )

    @cached_property
    def _levels(self) -> tuple[DataFrame, DataFrame]:
        """(owner columns, select items with stars expanded and ordinals counted anew)."""
        rel = self.relations.select(*KEY, "ord", "alias", "table", "kind", "source_owner", "found", "entity_id", "catalog", "schema")
        cat = self.catalog.select(
            F.col("catalog").alias("k_c"),
            F.col("schema_name").alias("k_s"),
            ids.normal(F.col("table_name")).alias("k_t"),
            F.col("ordinal").alias("col_ord"),
            "column_name",
            "data_type",
            "is_partition",
        )
        physical = (
            rel.where("kind = 'table' and found")
            .join(
                cat,
                (F.col("catalog") == F.col("k_c")) & (F.col("schema") == F.col("k_s")) & (ids.normal(F.col("table")) == F.col("k_t")),
            )
            .select(
                *KEY,
                "ord",
                "alias",
                "table",
                "kind",
                "source_owner",
                "col_ord",
                "column_name",
                "data_type",
                "is_partition",
                ids.column_id(F.col("catalog"), F.col("schema"), F.col("table"), F.col("column_name")).alias("column_id"),
            )
        )
        columns, items = [self.keep(physical)], []
        nested = rel.where("kind <> 'table'")
        level_of = self.p_owners.groupBy("query_id", "owner").agg(F.max("level").alias("level"))
        # stars need the columns of the levels below; without any, all levels are one
        for level in range(self.depth + 1) if self.stars else [0]:
            have = every(columns)
            own = self.p_select_items
            if self.stars:
                own = own.join(level_of, ["query_id", "owner"]).where(F.col("level") == level).drop("level")
            star = own.where("expression_kind = 'star'").select(*KEY, "ordinal", F.col("star_target"), "start_idx", "stop_idx")
            c = have.select(*KEY, "ord", "alias", "table", "kind", "source_owner", "col_ord", "column_name", "column_id")
            wide = star.join(c, KEY).where((F.col("star_target") == "") | (ids.normal(F.col("alias")) == ids.normal(F.col("star_target"))))
            if "star_except" in self.has:
                left_out = self.p_star_except.select(*KEY, "ordinal", ids.normal(F.col("name")).alias("name")).distinct()
                wide = wide.withColumn("name", ids.normal(F.col("column_name"))).join(left_out, [*KEY, "ordinal", "name"], "left_anti").drop("name")
            wide = wide.select(
                *KEY, F.col("ordinal").alias("item_ord"), F.col("ord").alias("a"), F.col("col_ord").alias("b"), F.concat_ws(".", "alias", "column_name").alias("expression_sql"), F.col("column_name").alias("output_name"),
                F.lit(None).cast("string").alias("alias"), F.lit("column").alias("expression_kind"), F.lit(None).cast("string").alias("expression_class"), F.lit(None).cast("string").alias("function_name"),
                F.lit(True).alias("from_star"), "kind", "source_owner", F.col("col_ord").alias("source_ord"), "column_id", "column_name", "start_idx", "stop_idx",
            )
            plain = own.where("expression_kind <> 'star'").select(
                *KEY, F.col("ordinal").alias("item_ord"), F.lit(0).alias("a"), F.lit(0).alias("b"), "expression_sql", "output_name", "alias", "expression_kind", "expression_class", "function_name",
                F.lit(False).alias("from_star"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("source_owner"), F.lit(None).cast("int").alias("source_ord"), F.lit(None).cast("string").alias("column_id"), F.lit(None).cast("string").alias("column_name"), "start_idx", "stop_idx",
            )
            made = (
                (plain.unionByName(wide) if self.stars else plain)
                .withColumn("ordinal", F.row_number().over(Window.partitionBy(*KEY).orderBy("item_ord", "a", "b")))
                .drop("a", "b")
            )
            if "renames" in self.has:
                made = made.join(self.p_renames, ["query_id", "owner", "ordinal"], "left").withColumn("output_name", F.coalesce("name", "output_name")).drop("name")
            made = self.keep(made)
            items.append(made)
            if level < self.depth or not self.stars:
                out = (
                    made.where("segment_index = 0")
                    .select(
                        "query_id",
                        F.col("owner").alias("source_owner"),
                        F.col("ordinal").alias("col_ord"),
                        F.col("output_name").alias("column_name"),
                    )
                )
                columns.append(self.keep(nested.join(out, ["query_id", "source_owner"]).select(
                    *KEY,
                    "ord",
                    "alias",
                    "table",
                    "kind",
                    "source_owner",
                    "col_ord",
                    "column_name",
                    F.lit("unknown").alias("data_type"),
                    F.lit(False).alias("is_partition"),
                    F.lit(None).cast("string").alias("column_id"),
                )))
        if not self.inside:
            self.settle()
        return every(columns), every(items)

    @property
    def owner_columns(self) -> DataFrame:
        return self._levels[0]

    @property
    def items(self) -> DataFrame:
        return self._levels[1]

    # --- resolution ---

    @cached_property
    def join_keys(self) -> DataFrame:
        """The parsed keys, and those of NATURAL joins: columns of the right relation that one before it has too."""
        if not self.natural:
            return self.p_join_keys
        c = self.owner_columns.select(*KEY, "ord", "alias", "column_name")
        right = (
            self.p_clauses.where("clause = 'natural_join'")
            .select(*KEY, F.col("text").alias("alias"))
            .join(c, [*KEY, "alias"])
            .select(*KEY, F.col("ord").alias("r_ord"), F.col("alias").alias("r_table"), F.col("column_name").alias("r_column"))
        )
        both = right.join(c, KEY).where("ord < r_ord and lower(column_name) = lower(r_column)")
        first = both.groupBy(*KEY, "r_ord", "r_table", "r_column").agg(F.min_by(F.struct("alias", "column_name"), "ord").alias("l"))
        number = F.row_number().over(Window.partitionBy("query_id").orderBy("owner", "segment_index", "r_ord", "r_column")) + 100_000
        made = first.select(
            *KEY,
            number.alias("key_ord"),
            F.lit("Inner").alias("join_type"),
            F.col("l.alias").alias("l_table"),
            F.col("l.column_name").alias("l_column"),
            "r_table",
            "r_column",
            F.concat(F.lit("USING ("), "r_column", F.lit(")")).alias("raw_sql"),
        )
        return self.keep(self.p_join_keys.unionByName(made.select(*self.p_join_keys.columns)))

    @cached_property
    def _refs(self) -> DataFrame:
        """All references that are resolved: those of select lists, ON columns and both sides of join keys."""
        cols = [*KEY, "clause", "ordinal", "ref_ord", "raw", "column", "table", "schema", "start_idx", "stop_idx"]
        refs = self.p_column_refs.select(*cols)
        none = F.lit(None).cast("int")
        side = lambda s, keys=self.join_keys, clause="key": keys.select(*KEY, F.lit(f"{clause}_{s}").alias("clause"), F.col("key_ord").alias("ordinal"), F.lit(0).alias("ref_ord"), F.concat_ws(".", f"{s}_table", f"{s}_column").alias("raw"), F.col(f"{s}_column").alias("column"), F.col(f"{s}_table").alias("table"), F.lit(None).cast("string").alias("schema"), none.alias("start_idx"), none.alias("stop_idx"))
        parts = [refs, side("l"), side("r")]
        if "correlations" in self.has:
            parts += [side(s, self.p_correlations, "cor") for s in "lr"]
        return every(parts)

    @stage
    def resolved(self) -> DataFrame:
        """One row a reference: status resolved, missing (its relation is not in the catalog), ambiguous or unknown; where it leads; candidates."""
        r = self._refs.select("*", F.col("owner").alias("c_owner"), F.col("segment_index").alias("c_segment_index"), F.lit(0).alias("distance"), F.lit(None).cast("int").alias("ord_limit"))
        if "visible" in self.has:
            around = self.p_visible.select("query_id", "owner", F.col("scope_owner").alias("c_owner"), F.col("scope_segment").alias("c_segment_index"), "distance", "ord_limit")
            r = r.unionByName(self._refs.join(around, ["query_id", "owner"]).select(*r.columns))
        c = self.owner_columns.select(
            "query_id",
            F.col("owner").alias("c_owner"),
            F.col("segment_index").alias("c_segment_index"),
            F.col("ord").alias("c_ord"),
            F.col("alias").alias("c_alias"),
            F.col("table").alias("c_table"),
            F.col("kind").alias("c_kind"),
            "source_owner",
            F.col("col_ord").alias("source_ord"),
            "column_name",
            "column_id",
        )
        n = ids.normal
        scope = ["query_id", "c_owner", "c_segment_index"]
        on = reduce(lambda x, y: x & y, [F.col(f"r.{k}") == F.col(f"c.{k}") for k in scope]) & (n(F.col("column")) == n(F.col("column_name"))) & (F.col("table").isNull() | (n(F.col("table")) == n(F.col("c_alias"))) | (n(F.col("table")) == n(F.col("c_table")))) & (F.col("ord_limit").isNull() | (F.col("c_ord") < F.col("ord_limit")))
        ref = [*KEY, "clause", "ordinal", "ref_ord"]
        w = Window.partitionBy(*ref)
        both = r.alias("r").join(c.alias("c"), on, "left").select("r.*", *[f"c.{k}" for k in c.columns if k not in scope])
        if "visible" in self.has:  # the nearest scope that has the name
            both = both.withColumn("near", F.coalesce(F.min(F.when(F.col("c_ord").isNotNull(), F.col("distance"))).over(w), F.lit(0))).where("distance = near").drop("near")
        both = (
            both.withColumn("by_alias", F.max((n(F.col("table")) == n(F.col("c_alias"))).cast("int")).over(w))
            .where("table is null or c_ord is null or by_alias = 0 or lower(trim(table)) = lower(trim(c_alias)) or by_alias is null")
        )
        both = both.withColumn("n", F.count("c_ord").over(w)).withColumn("rank", F.row_number().over(w.orderBy("c_ord", "source_ord")))
        names, aliases = F.array_sort(F.collect_set("c_table").over(w)), F.collect_set(n(F.col("c_alias"))).over(w)
        first = both.withColumn("candidates", names).withColumn("aliases", aliases).where("rank = 1")
        # a column on which all its relations are joined by equality is the first one's
        equal = self.join_keys.where("lower(l_column) = lower(r_column)" + ("" if self.by_join else " and raw_sql like 'USING%'"))
        equal = equal.select(
            *[F.col(k).alias(f"e_{k}") for k in KEY],
            n(F.col("l_column")).alias("e_column"),
            F.explode(F.array(n(F.col("l_table")), n(F.col("r_table")))).alias("e_table"),
        )
        equal = equal.groupBy(*[f"e_{k}" for k in KEY], "e_column").agg(F.collect_set("e_table").alias("joined"))
        e_on = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"e_{k}") for k in KEY]) & (n(F.col("column")) == F.col("e_column")) & F.col("table").isNull() & (F.col("n") > 1)
        first = (
            first.join(equal, e_on, "left")
            .withColumn("n", F.when(F.size(F.array_except("aliases", "joined")) == 0, F.lit(1)).otherwise(F.col("n")))
        )
        lost = (
            self.relations.where("not found")
            .select(
                *[F.col(k).alias(f"m_{k}") for k in KEY],
                F.col("ord").alias("m_ord"),
                F.col("alias").alias("m_alias"),
                F.col("table").alias("m_table"),
                F.col("catalog").alias("m_catalog"),
                F.col("schema").alias("m_schema"),
            )
        )
        m_on = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"m_{k}") for k in KEY]) & (F.col("n") == 0) & (F.col("table").isNull() | (n(F.col("table")) == n(F.col("m_alias"))) | (n(F.col("table")) == n(F.col("m_table")))) & (F.col("schema").isNull() | (n(F.col("schema")) == n(F.col("m_schema"))))
        first = first.join(lost, m_on, "left").withColumn("m_rank", F.row_number().over(w.orderBy("m_ord"))).where("m_rank = 1")
        status = (
            F.when(F.col("n") == 1, "resolved")
            .when(F.col("n") > 1, "ambiguous")
            .when(F.col("m_ord").isNotNull(), "missing")
            .otherwise("unknown")
        )
        ok, miss = status == "resolved", status == "missing"
        return first.select(
            *ref, "raw", "column", "table", "start_idx", "stop_idx", "distance", F.col("c_owner").alias("scope_owner"), status.alias("status"), F.when(ok, F.col("c_kind")).when(miss, "table").alias("kind"), F.when(ok, F.col("source_owner")).alias("source_owner"), F.when(ok, F.col("source_ord")).alias("source_ord"),
            F.when(ok, F.col("column_id")).when(miss, ids.column_id(F.col("m_catalog"), F.col("m_schema"), F.col("m_table"), F.col("column"))).alias("column_id"), F.when(ok, F.col("column_name")).when(miss, F.col("column")).alias("column_name"), F.when(ok, F.col("c_alias")).alias("relation_alias"), "candidates",
        )

    @stage
    def _steps(self) -> DataFrame:
        """From an owner's output to what it is made of: references and expanded stars."""
        own = self.items.where("not from_star").select(*KEY, "item_ord", "ordinal")
        refs = (
            self.resolved.where("clause = 'select' and status in ('resolved', 'missing')")
            .withColumnRenamed("ordinal", "item_ord")
            .join(own, [*KEY, "item_ord"])
        )
        cols = [*KEY, "ordinal", "ref_ord", "kind", "source_owner", "source_ord", "column_id", "column_name", "via"]
        parts = [refs.withColumn("via", F.lit("ref")).select(*cols), self.items.where("from_star").withColumn("ref_ord", F.lit(0)).withColumn("via", F.lit("ref")).select(*cols)]
        none = F.lit(None).cast("string")
        if "subqueries" in self.has:  # an output with a query in it is made of that query's first output
            inner = self.p_subqueries.where("clause = 'select' and kind <> 'exists'").withColumnRenamed("ordinal", "item_ord").join(own, [*KEY, "item_ord"])
            parts.append(inner.select(*KEY, "ordinal", "ref_ord", F.lit("derived").alias("kind"), F.col("sub_owner").alias("source_owner"), F.lit(1).alias("source_ord"), none.alias("column_id"), none.alias("column_name"), F.lit("subquery").alias("via")))
        # columns of VALUES and of table functions of constants lead to themselves
        made = self.items.where("expression_kind = 'generated'")
        parts.append(made.select(*KEY, "ordinal", F.lit(0).alias("ref_ord"), F.lit("table").alias("kind"), none.alias("source_owner"), F.lit(None).cast("int").alias("source_ord"), F.concat(F.lit("generated:"), "owner", F.lit("."), ids.segment(F.col("output_name"))).alias("column_id"), F.col("output_name").alias("column_name"), F.lit("ref").alias("via")))
        return every(parts)

    def _trace(self, start: DataFrame, keep: list[str], path: bool = False) -> DataFrame:
        """Physical columns behind rows with query_id, kind, source_owner, source_ord, column_id, column_name; through as many
        owners as are nested, of recursive ones until nothing new is met.  With ``path``, also where each stands: the references' numbers on the way, from ref_ord on."""
        if path:
            start, keep = start.withColumn("path", F.array("ref_ord")), [*keep, "path"]
        cols = ["query_id", *keep, "kind", "source_owner", "source_ord", "column_id", "column_name"]
        front, done = start.select(*cols), []
        steps = self._steps.select(
            "query_id",
            F.col("owner").alias("s_owner"),
            F.col("ordinal").alias("s_ord"),
            F.col("ref_ord").alias("n_ref"),
            F.col("kind").alias("n_kind"),
            F.col("source_owner").alias("n_owner"),
            F.col("source_ord").alias("n_ord"),
            F.col("column_id").alias("n_id"),
            F.col("column_name").alias("n_name"),
        )
        open_ended = self.cyclic or "subqueries" in self.has or "visible" in self.has
        last, seen = self.owners if open_ended else self.depth, []
        place = ["query_id", *(k for k in keep if k != "path"), "source_owner", "source_ord"]
        for i in range(last + 1):
            done.append(front.where("kind = 'table'"))
            if i == last or open_ended and i and front.where("kind <> 'table'").isEmpty():
                break
            if self.cyclic:
                seen.append(front.where("kind <> 'table'").select(*place).distinct())
            front = (
                front.where("kind <> 'table'").join(steps, "query_id").where("source_owner = s_owner and source_ord = s_ord")
                .select(
                    "query_id",
                    *[F.concat("path", F.array("n_ref")).alias("path") if c == "path" else c for c in keep],
                    F.col("n_kind").alias("kind"),
                    F.col("n_owner").alias("source_owner"),
                    F.col("n_ord").alias("source_ord"),
                    F.col("n_id").alias("column_id"),
                    F.col("n_name").alias("column_name"),
                ).distinct()
            )
            if self.cyclic:
                old = every(seen).select(*[F.col(k).alias(f"old_{k}") for k in place])
                same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"old_{k}")) for k in place]) & (F.col("kind") != "table")
                front = front.join(old, same, "left_anti")
            front = self.keep(front)
        return every(done).select("query_id", *keep, "column_id", "column_name").distinct()

    @stage
    def _ends(self) -> DataFrame:
        """query_id, owner, segment_index, clause ('out' for outputs, 'key_l' and 'key_r' for sides of join keys), ordinal, via, column_id, column_name: outputs and join keys, traced together."""
        keep = ["owner", "segment_index", "clause", "ordinal", "via"]
        cols = ["query_id", *keep, "kind", "source_owner", "source_ord", "column_id", "column_name"]
        out = self._steps.where(F.col("owner") == ROOT).withColumn("clause", F.lit("out"))
        sides = self.resolved.where("clause in ('key_l', 'key_r') and status in ('resolved', 'missing')").withColumn("via", F.lit("ref"))
        return self._trace(out.select(*cols).unionByName(sides.select(*cols)), keep)

    @cached_property
    def sources(self) -> DataFrame:
        """query_id, segment_index, ordinal, via ('ref', or 'subquery' for those of a query in the output), column_id, column_name: the physical columns of every output of the statements' own select lists."""
        return self._ends.where("clause = 'out'").select("query_id", "segment_index", "ordinal", "via", "column_id", "column_name")

    # --- what is written ---

    @stage
    def writes(self) -> DataFrame:
        """query_id, write_ord, action, owner, ordinal, value (its text), table_id, target (a column's id; null where none is), target_name, n_values, n_columns (null: unknown)."""
        on = ["catalog", "schema", "table"]
        cat = self.catalog.select(F.col("catalog"), F.col("schema_name").alias("schema"), ids.normal(F.col("table_name")).alias("table"), "column_name", "ordinal")
        w = self.p_writes.withColumn("own", F.col("table")).withColumn("table", ids.normal(F.col("table")))
        one = ["query_id", "write_ord"]
        given = w.where("columns is not null").select(*one, F.posexplode("columns").alias("pos", "name")).withColumn("pos", F.col("pos") + 1)
        own = w.where("columns is null").join(cat, on).where("not array_contains(fixed, column_name)")
        own = own.select(*one, F.row_number().over(Window.partitionBy(*one).orderBy("ordinal")).alias("pos"), F.col("column_name").alias("name"))
        columns = self.keep(given.unionByName(own))
        count = columns.groupBy(*one).agg(F.count(F.lit(1)).alias("n_columns"))
        items = self.items.where("segment_index = 0").select("query_id", "owner", F.col("ordinal").alias("item"), "output_name", F.col("expression_sql").alias("value"))
        pairs = w.join(items, ["query_id", "owner"], "left").join(count, one, "left")
        columns = columns.withColumnRenamed("query_id", "c_q").withColumnRenamed("write_ord", "c_w")
        near = (F.col("query_id") == F.col("c_q")) & (F.col("write_ord") == F.col("c_w")) & F.when(F.col("pairing") == "name", ids.normal(F.col("output_name")) == ids.normal(F.col("name"))).otherwise(F.col("item") == F.col("pos"))
        # of a table that is made, or not known, the columns are called as the outputs
        name = F.coalesce("name", F.when(F.col("n_columns").isNull() | (F.col("pairing") == "outputs"), F.col("output_name")))
        found = pairs.join(columns, near, "left").withColumn("target_name", name)
        return found.select(
            *one, "action", "owner", F.col("item").alias("ordinal"), "value", ids.table_id(F.col("catalog"), F.col("schema"), F.col("own")).alias("table_id"),
            F.when(F.col("target_name").isNotNull(), ids.column_id(F.col("catalog"), F.col("schema"), F.col("own"), F.col("target_name"))).alias("target"),
            "target_name", F.count("item").over(Window.partitionBy(*one)).alias("n_values"), "n_columns", "pairing", "own", "output_name",
        )

    @stage
    def write_sources(self) -> DataFrame:
        """query_id, owner, ordinal, column_id: the physical columns of every value that is written."""
        owners = self.p_writes.select("query_id", "owner").distinct()
        return self._trace(self._steps.join(owners, ["query_id", "owner"]), ["owner", "ordinal"]).select("query_id", "owner", "ordinal", "column_id").distinct()

    @stage
    def correlated(self) -> DataFrame:
        """query_id, owner, key_ord, l, r (physical columns; one of them of a scope around the owner), raw_sql: the equalities that join a nested query to what is around it."""
        place = [*KEY, "ordinal"]
        sides = self.resolved.where("clause in ('cor_l', 'cor_r') and status in ('resolved', 'missing')")
        apart = sides.groupBy(*place).agg(F.min("distance").alias("a"), F.max("distance").alias("z"), F.count(F.lit(1)).alias("n")).where("n = 2 and a < z")
        ends = self._trace(sides.join(apart.select(*place), place), [*KEY[1:], "clause", "ordinal"])
        keys = self.p_correlations.select(*KEY, F.col("key_ord").alias("ordinal"), "raw_sql")
        for x in "lr":
            keys = keys.join(ends.where(f"clause = 'cor_{x}'").select(*place, F.col("column_id").alias(x)), place)
        return keys.select("query_id", "owner", F.col("ordinal").alias("key_ord"), "l", "r", "raw_sql")

    @stage
    def outer_keys(self) -> DataFrame:
        """query_id, segment_index, ordinal, column_id: the root's columns that a query in an output refers to."""
        inside = self.p_inside.select("query_id", "owner", F.col("segment_index").alias("root_segment"), F.col("ordinal").alias("root_item"))
        refs = self.resolved.where((F.col("distance") > 0) & (F.col("scope_owner") == ROOT) & F.col("status").isin("resolved", "missing") & ~F.col("clause").startswith("cor_"))
        refs = refs.join(inside, ["query_id", "owner"])
        found = self._trace(refs, ["root_segment", "root_item"])
        items = self.items.where((F.col("owner") == ROOT) & ~F.col("from_star")).select("query_id", F.col("segment_index").alias("root_segment"), F.col("item_ord").alias("root_item"), "ordinal")
        return found.join(items, ["query_id", "root_segment", "root_item"]).select("query_id", F.col("root_segment").alias("segment_index"), "ordinal", "column_id").distinct()

    @stage
    def row_sources(self) -> DataFrame:
        """query_id, column_id: the physical columns that decide which rows there are, and in which group or order: those of filters, join conditions, groups, orders, of DISTINCT,
        set operations, generators and pivots, and the outputs of queries in filters; in all owners."""
        cols = ["query_id", "kind", "source_owner", "source_ord", "column_id", "column_name"]
        refs = self.resolved.where("clause <> 'select' and status in ('resolved', 'missing')").select(*cols)
        whole = self.p_clauses.where("clause in ('distinct', 'union_distinct', 'set_op', 'generator', 'pivot')").select("query_id", "owner").distinct()
        parts = [refs, self._steps.join(whole, ["query_id", "owner"]).select(*cols)]
        # groups and orders by the number or the name of an output, and outputs that make rows
        named = self.p_clauses.where("clause in ('group_by', 'order_by', 'generator_item')").select("query_id", "owner", ids.normal(F.col("text")).alias("named"), (F.col("clause") == "generator_item").alias("by_item"))
        items = self.items.select("query_id", "owner", "ordinal", F.col("item_ord").cast("string").alias("item"), ids.normal(F.col("output_name")).alias("output"))
        hit = items.join(named, ["query_id", "owner"]).where("if(by_item, named = item, named = output or named = cast(ordinal as string))").select("query_id", "owner", "ordinal").distinct()
        parts.append(self._steps.join(hit, ["query_id", "owner", "ordinal"]).select(*cols))
        if "subqueries" in self.has:
            inner = self.p_subqueries.where("clause <> 'select'").select("query_id", F.col("sub_owner").alias("owner")).distinct()
            parts.append(self._steps.join(inner, ["query_id", "owner"]).select(*cols))
        return self._trace(self.keep(every(parts).distinct()), []).select("query_id", "column_id").distinct()

    # --- diagnostics ---

    @stage
    def diagnostics(self) -> DataFrame:
        """query_id, code, level, related (names, sorted)."""
        d = self.p_diagnostics.select("query_id", "code", "level", "related")
        rel = self.relations
        table = (
            rel.where("kind = 'table' and not found")
            .select("query_id", F.lit("UNKNOWN_TABLE").alias("code"), F.lit("warning").alias("level"), F.col("table").alias("related"))
            .distinct()
        )
        refs = self.resolved.where("clause = 'select'")
        unknown = (
            refs.where("status = 'unknown'")
            .select("query_id", F.lit("UNKNOWN_COLUMN").alias("code"), F.lit("warning").alias("level"), F.col("raw").alias("related"))
            .distinct()
        )
        ambiguous = (
            refs.where("status = 'ambiguous'")
            .select(
                "query_id",
                F.lit("AMBIGUOUS_COLUMN").alias("code"),
                F.lit("warning").alias("level"),
                F.concat(F.col("raw"), F.lit(": "), F.array_join("candidates", ", ")).alias("related"),
            )
            .distinct()
        )
        twice = (
            rel.withColumn("n", F.row_number().over(Window.partitionBy(*KEY, ids.normal(F.col("alias"))).orderBy("ord")))
            .where("n > 1")
            .select("query_id", F.lit("DUPLICATE_ALIAS").alias("code"), F.lit("warning").alias("level"), F.col("alias").alias("related"))
            .distinct()
        )
        stars = self.p_select_items.where("expression_kind = 'star'").select(*KEY, F.col("ordinal").alias("item_ord"), "star_target")
        failed = (
            stars.join(self.items.where("from_star").select(*KEY, "item_ord").distinct(), [*KEY, "item_ord"], "left_anti")
            .select(
                "query_id",
                F.lit("STAR_EXPANSION_FAILED").alias("code"),
                F.lit("warning").alias("level"),
                F.when(F.col("star_target") == "", "*").otherwise(F.concat("star_target", F.lit(".*"))).alias("related"),
            )
            .distinct()
        )
        # outputs of the statement that are expressions of no class and lead to no column
        plain = self._outputs.where("expression_kind in ('function', 'expression') and expression_class is null and not from_star")
        bare = (
            plain.join(self._led, ["query_id", "ordinal"], "left_anti")
            .select(
                "query_id",
                F.lit("NOT_SUPPORTED_IN_P0").alias("code"),
                F.lit("info").alias("level"),
                F.col("expression_sql").alias("related"),
            )
        )
        return every([d, table, unknown, ambiguous, twice, failed, bare, *self._write_diagnostics()])

    def _write_diagnostics(self) -> list[DataFrame]:
        """Targets that are not in the catalog, values without a column, and numbers of values and columns that differ."""
        if "writes" not in self.has:
            return []
        w = self.writes
        made = lambda df, code, related: df.select("query_id", F.lit(code).alias("code"), F.lit("warning").alias("level"), related.alias("related")).distinct()
        known = self.catalog.select(ids.table_id(F.col("catalog"), F.col("schema_name"), F.col("table_name")).alias("table_id")).distinct()
        lost = w.where("action <> 'create'").join(known, "table_id", "left_anti").join(self.relations.where("kind = 'table'").select("query_id", F.col("table").alias("own")).distinct(), ["query_id", "own"], "left_anti")
        differ = w.where("pairing = 'position' and n_values <> n_columns")
        return [
            made(lost, "UNKNOWN_TABLE", F.col("own")),
            made(w.where("pairing = 'name' and n_columns is not null and target is null and output_name is not null"), "UNKNOWN_COLUMN", F.concat_ws(".", "own", "output_name")),
            made(differ, "WRITE_COLUMNS_DIFFER", F.concat("own", F.lit(": "), F.col("n_values").cast("string"), F.lit(" values, "), F.col("n_columns").cast("string"), F.lit(" columns"))),
        ]

    @stage
    def _places(self) -> DataFrame:
        """query_id, code, named, start_idx, stop_idx: where a diagnostic's subject stands first (a repeated alias: where it stands again)."""
        made = lambda df, code, name, a="start_idx", b="stop_idx": df.select("query_id", F.lit(code).alias("code"), name.alias("named"), F.col(a).alias("start_idx"), F.col(b).alias("stop_idx"))
        refs, rel, items = self.resolved.where("clause = 'select'"), self.relations, self.p_select_items
        parts = [
            made(refs.where("status = 'unknown'"), "UNKNOWN_COLUMN", F.col("raw")),
            made(refs.where("status = 'ambiguous'"), "AMBIGUOUS_COLUMN", F.col("raw")),
            made(rel.where("kind = 'table' and not found"), "UNKNOWN_TABLE", F.col("table")),
            made(items.where("expression_kind = 'star'"), "STAR_EXPANSION_FAILED", F.when(F.col("star_target") == "", "*").otherwise(F.concat("star_target", F.lit(".*")))),
            made(items.where("expression_kind in ('function', 'expression')"), "NOT_SUPPORTED_IN_P0", F.col("expression_sql")),
        ]
        if "writes" in self.has:
            parts += [made(self.p_writes, "UNKNOWN_TABLE", F.col("table")), made(self.p_writes, "WRITE_COLUMNS_DIFFER", F.col("table"))]
        at = self.p_diagnostics.where("at is not null").withColumn("stop_idx", F.col("at"))
        parts.append(at.select("query_id", "code", F.coalesce("related", F.lit("")).alias("named"), F.col("at").alias("start_idx"), "stop_idx"))
        first = every(parts).where("start_idx is not null").groupBy("query_id", "code", "named").agg(F.min(F.struct("start_idx", "stop_idx")).alias("p"))
        again = made(rel, "DUPLICATE_ALIAS", F.col("alias"), "alias_start", "alias_stop").where("start_idx is not null").groupBy("query_id", "code", "named").agg(F.max(F.struct("start_idx", "stop_idx")).alias("p"))
        return first.unionByName(again).select("query_id", "code", "named", "p.*")

    @stage
    def reported(self) -> DataFrame:
        """Diagnostics with ids, numbered in a query by level, code and names, errors first; with message, suggestion, place (location_id, UTF-16 offsets, line and column) and details."""
        rank = F.when(F.col("level") == "error", 0).when(F.col("level") == "warning", 1).otherwise(2)
        n = F.row_number().over(Window.partitionBy("query_id").orderBy(rank, "code", "related"))
        d = self.diagnostics.distinct().withColumn("ord", n)
        ambiguous, differ = F.col("code") == "AMBIGUOUS_COLUMN", F.col("code") == "WRITE_COLUMNS_DIFFER"
        d = d.withColumn("named", F.when(ambiguous | differ, F.substring_index("related", ": ", 1)).otherwise(F.coalesce("related", F.lit(""))))
        said = self.p_diagnostics.groupBy("query_id", "code", F.coalesce("related", F.lit("")).alias("named")).agg(F.min("message").alias("said"))
        d = d.join(self._places, ["query_id", "code", "named"], "left").join(said, ["query_id", "code", "named"], "left")
        tables = self.relations.where("kind = 'table'").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("table")), ", ").alias("tables"))
        d = d.join(tables, "query_id", "left").join(self.p_requests.select("query_id", "sql"), "query_id", "left")
        text, hint = F.col("said"), F.lit(None).cast("string")
        for code, message, suggestion in MESSAGES:
            text = F.coalesce(text, F.when(F.col("code") == code, F.replace(F.lit(message), F.lit("{}"), F.col("named"))))
            hint = F.coalesce(hint, F.when(F.col("code") == code, F.lit(suggestion)))
        rest = F.substring_index("related", ": ", -1)
        details = (
            F.when(ambiguous, F.create_map(F.lit("candidates"), rest))
            .when(differ, F.create_map(F.lit("counts"), rest))
            .when(F.col("code").isin("UNKNOWN_COLUMN", "STAR_EXPANSION_FAILED"), F.create_map(F.lit("tables"), F.coalesce("tables", F.lit(""))))
            .otherwise(F.create_map().cast("map<string,string>"))
        )
        start, end = F.col("start_idx"), F.col("stop_idx") + 1
        return d.select(
            "query_id", "ord", F.concat(F.lit("diag:"), "code", F.lit(":"), F.col("ord").cast("string")).alias("diagnostic_id"), "code", "level", "related", F.coalesce(text, F.col("code")).alias("message"), hint.alias("suggestion"),
            F.when(start.isNotNull(), ids.location_id(F.concat_ws(":", "code", "named"), start, end)).alias("location_id"), start.alias("start_offset"), end.alias("end_offset"),
            F.when(start.isNotNull(), ids.line_of(F.col("sql"), start)).alias("start_line"), F.when(start.isNotNull(), ids.column_of(F.col("sql"), start)).alias("start_col"), details.alias("details"),
        )

    @stage
    def statuses(self) -> DataFrame:
        """query_id, status, errors, warnings, infos."""
        d = (
            self.diagnostics.groupBy("query_id")
            .agg(
                F.count_if(F.col("level") == "error").alias("errors"),
                F.count_if(F.col("level") == "warning").alias("warnings"),
                F.count_if(F.col("level") == "info").alias("infos"),
            )
        )
        r = self.p_requests.join(d, "query_id", "left").na.fill(0, ["errors", "warnings", "infos"])
        return r.select(
            "query_id",
            F.when(F.col("errors") > 0, "failed").when(F.col("warnings") + F.col("infos") > 0, "partial").otherwise("success").alias("status"),
            "errors",
            "warnings",
            "infos",
        )

    # --- graph ---

    @stage
    def expressions(self) -> DataFrame:
        """Classified outputs of the statements' own select lists."""
        i = self.items.where((F.col("owner") == ROOT) & (F.col("segment_index") == 0) & F.col("expression_class").isNotNull())
        p = self.p_select_items.select(
            *KEY,
            F.col("ordinal").alias("item_ord"),
            "is_distinct",
            F.array_join("partition_by", ", ").alias("partition_by"),
            F.array_join("order_by", ", ").alias("order_by"),
        )
        return (
            i.join(p, [*KEY, "item_ord"])
            .select(
                "query_id",
                F.concat(
                    F.lit("expression:scope:root:"),
                    F.col("ordinal").cast("string"),
                    F.lit(":"),
                    "expression_class",
                ).alias("expression_id"),
                "ordinal",
                F.col("expression_class").alias("kind"),
                "function_name",
                "is_distinct",
                "expression_sql",
                "partition_by",
                "order_by",
                "output_name",
            )
        )

    @stage
    def expression_parts(self) -> DataFrame:
        """query_id, expression_id, part (when, then, else, argument), ord, text, columns: what classified outputs are made of."""
        own = self.items.where((F.col("owner") == ROOT) & (F.col("segment_index") == 0)).select("query_id", "item_ord", "ordinal")
        x = (
            self.expressions.select("query_id", "ordinal", "expression_id")
            .join(own, ["query_id", "ordinal"])
            .select("query_id", F.col("item_ord").alias("ordinal"), "expression_id")
        )
        parts = self.p_expression_parts.where((F.col("owner") == ROOT) & (F.col("segment_index") == 0))
        return (
            parts.join(x, ["query_id", "ordinal"])
            .select("query_id", "expression_id", "part", "ord", "text", F.array_join("columns", ", ").alias("columns"))
        )

    @cached_property
    def _led(self) -> DataFrame:
        """query_id, ordinal of outputs that lead to a column, or whose inner query depends on one."""
        led = self.sources.where("segment_index = 0").select("query_id", "ordinal")
        if "inside" in self.has:
            led = led.unionByName(self.outer_keys.where("segment_index = 0").select("query_id", "ordinal"))
        return led.distinct()

    @stage
    def _outputs(self) -> DataFrame:
        return (
            self.items.where((F.col("owner") == ROOT) & (F.col("segment_index") == 0))
            .withColumn("output_id", ids.output_id(F.col("ordinal"), F.col("output_name")))
        )

    @stage
    def edges(self) -> DataFrame:
        """query_id, id, edge_type, source, target, label, confidence, owner."""
        out = self._outputs.select(
            "query_id",
            "ordinal",
            "output_id",
            "output_name",
            "expression_kind",
            "expression_class",
            "item_ord",
            "from_star",
        )
        src = self.sources.where("segment_index = 0").drop("segment_index")
        none, one = F.lit(None).cast("string"), F.lit(1.0)

        def made(df, kind, source, target, label=none, confidence=one, owner=F.lit(ROOT)):  # noqa: B008
            return df.select(
                "query_id",
                kind.alias("edge_type"),
                source.alias("source"),
                target.alias("target"),
                label.alias("label"),
                confidence.alias("confidence"),
                owner.alias("owner"),
            )

        plain = out.where("expression_class is null").join(src, ["query_id", "ordinal"])
        kind = F.when(F.col("via") == "subquery", "subquery").when(F.lower("column_name") == F.lower("output_name"), "projection").otherwise("alias")
        e = [made(plain, kind, F.col("column_id"), F.col("output_id"))]
        x = self.expressions.select("query_id", "ordinal", "expression_id")
        how = F.when(F.col("via") == "subquery", "subquery").otherwise("expression")
        e.append(made(x.join(src, ["query_id", "ordinal"]), how, F.col("column_id"), F.col("expression_id")))
        e.append(made(x.join(out, ["query_id", "ordinal"]), F.lit("expression"), F.col("expression_id"), F.col("output_id")))
        e.append(made(out.where("expression_kind = 'literal'"), F.lit("projection"), ids.literal_id(F.col("ordinal")), F.col("output_id")))
        # outputs with an unresolved reference, and outputs that are made of nothing known
        bad = (
            self.resolved.where((F.col("owner") == ROOT) & (F.col("segment_index") == 0) & (F.col("clause") == "select") & F.col("status").isin("unknown", "ambiguous"))
            .select("query_id", F.col("ordinal").alias("item_ord"), F.col("column").alias("bad"))
            .distinct()
        )
        lost = (
            out.where("expression_class is null and not from_star")
            .join(bad, ["query_id", "item_ord"])
            .select("query_id", "ordinal", "output_id", "bad")
        )
        bare = (
            out.where("expression_class is null and expression_kind <> 'literal' and not from_star")
            .join(self._led, ["query_id", "ordinal"], "left_anti")
            .join(lost.select("query_id", "ordinal"), ["query_id", "ordinal"], "left_anti")
            .select("query_id", "ordinal", "output_id", F.col("output_name").alias("bad"))
        )
        e.append(made(
            lost.unionByName(bare),
            F.lit("unknown"),
            ids.unknown_id(F.col("ordinal"), F.col("bad")),
            F.col("output_id"),
            confidence=F.lit(0.3),
        ))
        branches = self.p_clauses.where((F.col("clause") == "union_segment") & (F.col("owner") == ROOT)).select("query_id").distinct()
        union = (
            self.sources.join(branches, "query_id", "left_semi")
            .join(out.select("query_id", "ordinal", "output_id"), ["query_id", "ordinal"])
        )
        e.append(made(
            union,
            F.lit("union_mapping"),
            F.col("column_id"),
            F.col("output_id"),
            F.concat(F.lit("UNION segment "), F.col("segment_index").cast("string")),
        ))
        ends = self._ends
        place = [*KEY, "ordinal"]
        keys = self.join_keys.select(*KEY, F.col("key_ord").alias("ordinal"), "raw_sql", "l_column", "r_column")
        for x in ("l", "r"):
            keys = keys.join(ends.where(f"clause = 'key_{x}'").select(*place, F.col("column_id").alias(x)), place, "left")
        # a side that leads nowhere is an unknown node
        lost = lambda x: F.coalesce(x, ids.unknown_id(F.concat(F.lit("join_"), F.col("ordinal").cast("string")), F.col(f"{x}_column")))
        keys = keys.where("l is not null or r is not null").withColumn("l", lost("l")).withColumn("r", lost("r"))
        e.append(made(keys, F.lit("join_condition"), F.col("l"), F.col("r"), F.concat(F.lit("ON "), "raw_sql"), owner=F.col("owner")))
        if "correlations" in self.has:
            e.append(made(self.correlated, F.lit("correlation"), F.col("l"), F.col("r"), F.concat(F.lit("ON "), "raw_sql"), owner=F.col("owner")))
        if "inside" in self.has:
            outer = self.outer_keys.where("segment_index = 0").join(out.select("query_id", "ordinal", "output_id"), ["query_id", "ordinal"])
            e.append(made(outer, F.lit("correlation"), F.col("column_id"), F.col("output_id")))
        if "writes" in self.has:
            w = self.writes.where("target is not null").join(self.write_sources, ["query_id", "owner", "ordinal"], "left")
            literal = F.concat(F.lit("literal:write:"), F.col("write_ord").cast("string"), F.lit(":"), F.col("ordinal").cast("string"))
            e.append(made(w, F.lit("write"), F.coalesce("column_id", literal), F.col("target"), F.upper(F.replace("action", F.lit("_"), F.lit(" "))), owner=F.col("owner")))
        e.append(made(self.cte_inputs, F.lit("projection"), F.col("source"), F.col("target"), owner=F.col("owner")))
        all_ = every(e).withColumn("id", ids.edge_id(F.col("edge_type"), F.col("source"), F.col("target")))
        return all_.dropDuplicates(["query_id", "id"])

    @stage
    def _tops(self) -> DataFrame:
        """Relations with the CTE or root that they finally belong to: a query in FROM belongs to the scope around it."""
        rel = self.relations.where("owner not like '\\_\\_subquery%'")
        out = rel.withColumn("top", F.col("owner"))
        parent = (
            rel.where("kind = 'derived'")
            .select(F.col("query_id").alias("p_q"), F.col("source_owner").alias("p_o"), F.col("owner").alias("up"))
            .distinct()
        )
        for _ in range(self.depth):
            out = (
                out.join(parent, (F.col("query_id") == F.col("p_q")) & (F.col("top") == F.col("p_o")), "left")
                .withColumn("top", F.coalesce("up", "top"))
                .drop("p_q", "p_o", "up")
            )
        return out

    @cached_property
    def cte_inputs(self) -> DataFrame:
        """query_id, source (a table's or CTE's id), target (the CTE that selects from it), owner."""
        t = self._tops.where((F.col("top") != ROOT) & (F.col("kind") != "derived") & ~F.col("top").startswith("__"))
        return (
            t.select(
                "query_id",
                F.col("entity_id").alias("source"),
                ids.table_id(F.lit("default"), F.lit("default"), F.col("top")).alias("target"),
                F.col("top").alias("owner"),
            )
            .where("source <> target")
            .distinct()
        )

    @stage
    def nodes(self) -> DataFrame:
        """query_id, id, node_type, label, comment (of tables that are not in the catalog)."""
        rel = self.relations.where("kind <> 'derived'")
        label = F.when(F.col("schema") == "default", F.col("table")).otherwise(F.concat_ws(".", "schema", "table"))
        tables = rel.select("query_id", F.col("entity_id").alias("id"), F.col("kind").alias("node_type"), label.alias("label"), (~F.col("found")).alias("lost"))
        ends = self.edges.select("query_id", F.explode(F.array("source", "target")).alias("id"))
        columns = (
            ends.where("id like 'column:%'")
            .select("query_id", "id", F.lit("column").alias("node_type"), F.substring_index("id", ".", -1).alias("label"))
        )
        unknown = (
            ends.where("id like 'unknown:%'")
            .select("query_id", "id", F.lit("unknown").alias("node_type"), F.substring_index("id", ":", -1).alias("label"))
        )
        out = self._outputs
        outputs = out.select(
            "query_id",
            F.col("output_id").alias("id"),
            F.lit("output_column").alias("node_type"),
            F.col("output_name").alias("label"),
        )
        literals = (
            out.where("expression_kind = 'literal'")
            .select(
                "query_id",
                ids.literal_id(F.col("ordinal")).alias("id"),
                F.lit("literal").alias("node_type"),
                F.col("expression_sql").alias("label"),
            )
        )
        exprs = self.expressions.select(
            "query_id",
            F.col("expression_id").alias("id"),
            F.lit("expression").alias("node_type"),
            F.when(F.col("kind") == "case", "CASE").otherwise(F.col("function_name")).alias("label"),
        )
        parts = [tables, columns, unknown, outputs, literals, exprs]
        made = ends.where("id like 'generated:%'")
        parts.append(made.select("query_id", "id", F.lit("generated").alias("node_type"), F.substring_index("id", ".", -1).alias("label")))
        if "writes" in self.has:
            w = self.writes
            parts.append(w.select("query_id", F.col("table_id").alias("id"), F.lit("table").alias("node_type"), F.substring_index("table_id", ".", -1).alias("label")))
            value = F.concat(F.lit("literal:write:"), F.col("write_ord").cast("string"), F.lit(":"), F.col("ordinal").cast("string"))
            written = ends.where("id like 'literal:write:%'").select("query_id", "id").distinct()
            parts.append(w.select("query_id", value.alias("id"), F.lit("literal").alias("node_type"), F.col("value").alias("label")).join(written, ["query_id", "id"], "left_semi"))
        none = F.lit(False).alias("lost")
        lost = every([tables, *(p.select("*", none) for p in parts if p is not tables)]).groupBy("query_id", "id", "node_type", "label").agg(F.bool_or("lost").alias("lost"))
        return lost.select("query_id", "id", "node_type", "label", F.when(F.col("lost"), "no metadata imported").alias("comment"))

    @stage
    def summary(self) -> DataFrame:
        """query_id, tables, source_columns, output_columns, edges, diagnostics."""
        n = (
            self.nodes.groupBy("query_id")
            .agg(
                F.count_if(F.col("node_type") == "table").alias("tables"),
                F.count_if(F.col("node_type") == "column").alias("source_columns"),
                F.count_if(F.col("node_type") == "output_column").alias("output_columns"),
            )
        )
        e = self.edges.groupBy("query_id").agg(F.count(F.lit(1)).alias("edges"))
        d = self.diagnostics.groupBy("query_id").agg(F.count(F.lit(1)).alias("diagnostics"))
        return self.p_requests.select("query_id").join(n, "query_id", "left").join(e, "query_id", "left").join(d, "query_id", "left").na.fill(0)

    # --- assembly ---

    @stage
    def scopes(self) -> DataFrame:
        """query_id, scope_id, parent, aliases (alias=entity id, sorted): the root and one child for each CTE."""
        t = self._tops.where("kind <> 'derived' and (top = '__root__' or not startswith(top, '__'))")
        own = (
            t.groupBy("query_id", "top")
            .agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "alias", "entity_id"))), "; ").alias("aliases"))
        )
        at_root = F.col("top") == ROOT
        return own.select(
            "query_id",
            F.when(at_root, "scope:root").otherwise(F.concat(F.lit("scope:cte:"), ids.segment(F.col("top")))).alias("scope_id"),
            F.when(~at_root, "scope:root").alias("parent"),
            "aliases",
        )

    @stage
    def stages(self) -> DataFrame:
        """query_id, ord, stage, state, codes (of its diagnostics, each once), elapsed_ms (of all statements together, so far; null: not asked for): how each stage of the analysis went."""
        names = ("parse", "scope", "name_resolution", "projection", "expression_analysis", "lineage", "source_location", "graph", "semantics")
        of = {"PARSE_ERROR": "parse", "RECURSIVE_CTE_UNSUPPORTED": "scope", "DUPLICATE_ALIAS": "scope", "UNKNOWN_TABLE": "name_resolution", "UNKNOWN_COLUMN": "name_resolution", "AMBIGUOUS_COLUMN": "name_resolution", "STAR_EXPANSION_FAILED": "projection", "NOT_SUPPORTED_IN_P0": "projection"}
        code = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
        hit = (
            self.diagnostics.select("query_id", F.element_at(code, F.col("code")).alias("stage"), "level", "code")
            .groupBy("query_id", "stage")
            .agg(F.max(F.col("level") == "error").alias("error"), F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("codes"))
        )
        each = self.p_requests.select("query_id", "parsed", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("ord", "stage"))
        state = (
            F.when(~F.col("parsed") & (F.col("stage") != "parse"), "skipped")
            .when(F.col("error"), "failed")
            .when(F.col("error").isNotNull(), "partial")
            .otherwise("success")
        )
        spent = F.lit(None).cast("bigint")
        for name, seconds in self.spent.items():
            spent = F.when(F.col("stage") == name, F.lit(round(1000 * seconds))).otherwise(spent)
        return (
            each.join(hit, ["query_id", "stage"], "left")
            .select(
                "query_id",
                F.col("ord").cast("int").alias("ord"),
                "stage",
                state.alias("state"),
                F.coalesce("codes", F.lit("")).alias("codes"),
                spent.alias("elapsed_ms"),
            )
        )

    @stage
    def confidence(self) -> DataFrame:
        """query_id, partial, level, reasons: a lineage with outputs that are not resolved in full is partial."""
        lost = (
            self.edges.where("edge_type = 'unknown'")
            .groupBy("query_id")
            .agg(F.array_join(F.array_sort(F.collect_set(F.substring_index("target", ":", -1))), ", ").alias("lost"))
        )
        r = self.statuses.join(lost, "query_id", "left")
        level = (
            F.when(F.col("status") == "failed", "low")
            .when((F.col("status") == "partial") | F.col("lost").isNotNull(), "medium")
            .otherwise("high")
        )
        reasons = (
            F.when(F.col("status") == "failed", "the statement does not parse")
            .when(F.col("lost").isNotNull(), F.concat(F.lit("not resolved in full: "), "lost"))
            .when(F.col("status") == "partial", "there are diagnostics")
            .otherwise("all columns are resolved")
        )
        return r.select("query_id", F.col("lost").isNotNull().alias("partial"), level.alias("level"), reasons.alias("reasons"))

    @stage
    def results(self) -> DataFrame:
        """query_id, result: status, confidence, nodes, edges and diagnostics of a statement as one JSON text."""
        def lists(df, name):
            rest = [c for c in df.columns if c != "query_id"]
            return df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))

        r = self.statuses.select(
            "query_id",
            "status",
            F.when(F.col("status") == "failed", "low").when(F.col("status") == "partial", "medium").otherwise("high").alias("confidence"),
        )
        for df, name in ((self.nodes, "nodes"), (self.edges.select(
            "query_id",
            "id",
            "edge_type",
            "source",
            "target",
            "label",
            "confidence",
        ), "edges"), (self.diagnostics, "diagnostics")):
            r = r.join(lists(df, name), "query_id", "left").withColumn(name, F.coalesce(name, F.array()))
        return r.select("query_id", F.to_json(F.struct(*[c for c in r.columns if c != "query_id"])).alias("result"))

    # --- semantics ---

    @stage
    def grain(self) -> DataFrame:
        """query_id, grain_type, columns: of the statement's own select; GROUP BY before DISTINCT before windows."""
        c = self.p_clauses.where((F.col("owner") == ROOT) & (F.col("segment_index") == 0))
        group = (
            c.where("clause = 'group_by'")
            .groupBy("query_id")
            .agg(F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]),
                ", ",
            ).alias("group_columns"))
        )
        distinct = c.where("clause = 'distinct'").select("query_id", F.lit(True).alias("is_distinct")).distinct()
        window = (
            self.expressions.where("kind = 'window'")
            .groupBy("query_id")
            .agg(F.min_by("partition_by", "ordinal").alias("window_columns"))
        )
        names = (
            self._outputs.groupBy("query_id")
            .agg(F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "output_name"))), lambda x: x["output_name"]),
                ", ",
            ).alias("names"))
        )
        q = (
            self.p_requests.where("parsed")
            .select("query_id")
            .join(group, "query_id", "left")
            .join(distinct, "query_id", "left")
            .join(window, "query_id", "left")
            .join(names, "query_id", "left")
        )
        kind = (
            F.when(F.col("group_columns").isNotNull(), "group_by")
            .when(F.col("is_distinct"), "distinct")
            .when(F.col("window_columns").isNotNull(), "window_partition")
            .when(F.col("names").isNotNull(), "detail")
            .otherwise("unknown")
        )
        return q.select(
            "query_id",
            kind.alias("grain_type"),
            F.coalesce("group_columns", F.when(F.col("is_distinct"), F.col("names")), "window_columns", F.lit("")).alias("columns"),
        )

    @stage
    def filters(self) -> DataFrame:
        """query_id, owner, filter_type, expression: a WHERE on a partition column (by the catalog or by its name) is a partition_filter."""
        refs = self.p_column_refs.where("clause = 'where'").select(*KEY, "column")
        parts = self.owner_columns.where("is_partition").select(*KEY, F.lower("column_name").alias("p")).distinct()
        named = F.lower("column").rlike("^(dt|pt|ds|date)$|_(dt|date)$")
        hit = (
            refs.join(parts, [refs[k] == parts[k] for k in KEY] + [F.lower(refs["column"]) == parts["p"]], "left")
            .select(*[refs[k] for k in KEY], (named | F.col("p").isNotNull()).alias("hit"))
        )
        hit = hit.groupBy(*KEY).agg(F.max("hit").alias("hit"))
        w = self.p_clauses.where("clause in ('where', 'having', 'qualify')").join(hit, KEY, "left")
        kind = (
            F.when(F.col("clause") != "where", F.col("clause"))
            .when(F.coalesce("hit", F.lit(False)), "partition_filter")
            .otherwise("where")
        )
        on = self.join_keys.select("query_id", "owner", F.lit("join_condition").alias("filter_type"), F.col("raw_sql").alias("expression"))
        return w.select("query_id", "owner", kind.alias("filter_type"), F.col("text").alias("expression")).unionByName(on)

    @stage
    def metrics(self) -> DataFrame:
        """query_id, output_name, metric_type, target (the physical column of the first reference, or null)."""
        own = self._steps.where((F.col("owner") == ROOT) & (F.col("segment_index") == 0))
        first = (
            self._trace(own, ["ordinal"], path=True)
            .groupBy("query_id", "ordinal")
            .agg(F.min_by("column_id", F.struct("path", "column_id")).alias("target"))
        )
        o = self._outputs.where("expression_kind in ('function', 'expression')")
        head = F.upper(F.regexp_replace("expression_sql", r"\s+", " "))
        kind = F.when(head.rlike(r"^COUNT ?\( ?DISTINCT"), "count_distinct")
        for name in ("SUM", "COUNT", "AVG", "MIN", "MAX"):
            kind = kind.when(head.rlike(rf"^{name} ?\("), name.lower())
        return (
            o.join(first, ["query_id", "ordinal"], "left")
            .select("query_id", "output_name", kind.otherwise("expression").alias("metric_type"), "target")
        )

    @stage
    def joins(self) -> DataFrame:
        """query_id, owner, join_type, left_key, right_key, risk."""
        many = self._tops.where("kind = 'table'").groupBy("query_id").agg(F.count_distinct("entity_id").alias("n"))
        how = F.lower("join_type") if self.extended else F.lit("inner")
        return (
            self.join_keys.join(many, "query_id", "left")
            .select(
                "query_id",
                "owner",
                how.alias("join_type"),
                F.concat_ws(".", "l_table", "l_column").alias("left_key"),
                F.concat_ws(".", "r_table", "r_column").alias("right_key"),
                F.when(F.col("n") >= 2, "medium").otherwise("low").alias("risk"),
            )
        )

    @stage
    def dedup(self) -> DataFrame:
        """query_id, dedup_type, owner."""
        c = self.p_clauses.where("owner not like '\\_\\_subquery%'")
        named = (
            c.where("clause in ('distinct', 'group_by', 'union_distinct')")
            .select(
                "query_id",
                "owner",
                F.when(F.col("clause") == "union_distinct", "union").otherwise(F.col("clause")).alias("dedup_type"),
            )
        )
        rows = (
            self.p_select_items.where("expression_class = 'window' and function_name = 'ROW_NUMBER'")
            .select("query_id", "owner", F.lit("row_number").alias("dedup_type"))
        )
        return named.unionByName(rows).distinct()

    @stage
    def risks(self) -> DataFrame:
        """query_id, risk_type, level."""
        made = lambda df, kind, level: df.select("query_id", F.lit(kind).alias("risk_type"), F.lit(level).alias("level")).distinct()
        partitioned = self.filters.where("filter_type = 'partition_filter'").select("query_id").distinct()
        has = self._tops.where("kind = 'table'").select("query_id").distinct()
        per = (
            self.relations.where("kind = 'table' and owner not like '\\_\\_subquery%'")
            .groupBy(*KEY)
            .agg(F.count(F.lit(1)).alias("n"))
            .where("n > 1")
        )
        keyless = per.join(self.join_keys.select(*KEY).distinct(), KEY, "left_anti")
        return every([
            made(self.joins.where("risk = 'medium'"), "join_amplification", "warning"),
            made(has.join(partitioned, "query_id", "left_anti"), "no_partition_filter", "info"),
            made(keyless, "potential_cartesian", "warning"),
            made(self.metrics.where("target is null"), "ambiguous_metrics", "info"),
            *([made(keyless, "join_amplification", "error")] if self.extended else []),
        ])

    @stage
    def semantics(self) -> DataFrame:
        """query_id, status ('partial' with an unknown grain or an error among the risks), report: grain, filters, metrics, joins, de-duplication, risks and evidence as one JSON text."""
        def lists(df, name):
            return (
                df.groupBy("query_id")
                .agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "query_id"]))).alias(name))
            )

        r = self.grain.join(self.risks.where("level = 'error'").select("query_id", F.lit(True).alias("bad")).distinct(), "query_id", "left")
        r = r.select(
            "query_id",
            F.when((F.col("grain_type") == "unknown") | F.col("bad"), "partial").otherwise("success").alias("status"),
            F.struct("grain_type", "columns").alias("result_grain"),
        )
        marks = every([
            self.filters.select("query_id", F.concat(F.lit("filter:"), "expression").alias("e")),
            self.metrics.where("target is not null").select("query_id", F.col("target").alias("e")),
            self.joins.select("query_id", F.concat(F.lit("join:"), "left_key", F.lit("="), "right_key").alias("e")),
        ])
        r = (
            r.join(marks.groupBy("query_id").agg(F.array_sort(F.collect_set("e")).alias("evidence")), "query_id", "left")
            .withColumn("evidence", F.coalesce("evidence", F.array()))
        )
        for df, name in ((self.filters, "filters"), (self.metrics, "metrics"), (self.joins, "joins"), (self.dedup, "dedup"), (self.risks, "risks")):
            r = r.join(lists(df, name), "query_id", "left").withColumn(name, F.coalesce(name, F.array()))
        return r.select(
            "query_id",
            "status",
            F.to_json(F.struct(*[c for c in r.columns if c not in ("query_id", "status")])).alias("report"),
        )

    # --- locations ---

    @stage
    def locations(self) -> DataFrame:
        """query_id, entity_id, entity_type, raw_text, start_offset, end_offset (UTF-16, end exclusive), start_line, start_col: exact positions from the parser."""
        made = lambda df, kind, entity, a="start_idx", b="stop_idx": df.select("query_id", entity.alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(a).alias("start_offset"), (F.col(b) + 1).alias("end_offset")).where("start_offset is not null")
        root = F.col("owner") == ROOT
        out = self._outputs.where("not from_star")
        refs = self.resolved.where(~F.col("clause").startswith("key_") & ~F.col("clause").startswith("cor_"))
        entity = F.coalesce("column_id", F.concat(F.lit("ref:"), "raw"))
        c = self.p_clauses
        parts = [
            made(out, "output_column", F.col("output_id")),
            made(self.relations.where("kind <> 'derived'"), "table", F.col("entity_id")),
            made(
                self.relations.where("kind <> 'derived' and alias_start is not null"),
                "table_alias",
                F.col("relation_id"),
                "alias_start",
                "alias_stop",
            ),
            made(
                self.relations.where("kind = 'derived'"),
                "subquery",
                F.concat(F.lit("subquery:scope:root:"), F.regexp_extract("source_owner", r"(\d+)$", 1)),
            ),
            made(refs, "column", entity),
            made(c.where("clause = 'cte'"), "cte", F.concat(F.lit("cte:scope:root:"), ids.segment(F.col("text")))),
            made(c.where("clause = 'join_on'"), "join", F.concat(F.lit("join_on:scope:root:"), F.col("ord").cast("string"))),
            made(
                c.where("clause in ('where', 'having', 'qualify', 'group_by', 'order_by')"),
                "clause",
                F.concat("clause", F.lit(":"), F.col("ord").cast("string")),
            ),
            made(
                c.where((F.col("clause") == "union_segment") & root),
                "union_segment",
                F.concat(F.lit("union_segment:root:"), F.col("ord").cast("string")),
            ),
        ]
        body = (
            self.p_select_items.where(root & F.col("expression_class").isNotNull())
            .select("query_id", F.col("ordinal").alias("item_ord"), F.col("segment_index"), "body_start", "body_stop")
        )
        ex = self._outputs.where("expression_class is not null").join(body, ["query_id", "item_ord", "segment_index"])
        parts.append(made(
            ex,
            "expression",
            F.concat(F.lit("expression:scope:root:"), F.col("ordinal").cast("string"), F.lit(":"), "expression_class"),
            "body_start",
            "body_stop",
        ))
        sql = self.p_requests.select("query_id", "sql")
        at = every(parts).distinct().join(sql, "query_id")
        return at.select(
            "query_id", "entity_id", "entity_type", F.decode(
                F.substring(F.encode("sql", "UTF-16LE"), F.col("start_offset") * 2 + 1, (F.col("end_offset") - F.col("start_offset")) * 2),
                "UTF-16LE",
            ).alias("raw_text"),
            "start_offset", "end_offset", ids.line_of(F.col("sql"), F.col("start_offset")).alias("start_line"), ids.column_of(F.col("sql"), F.col("start_offset")).alias("start_col"),
        )

    @stage
    def node_locations(self) -> DataFrame:
        """query_id, id, node_type, status ('exact', 'unavailable'), confidence, location_id, start_offset, end_offset: the first place of every node of the graph."""
        first = (
            self.locations.groupBy("query_id", F.col("entity_id").alias("id"))
            .agg(F.min(F.struct("start_offset", "end_offset")).alias("at"))
        )
        n = self.nodes.select("query_id", "id", "node_type").distinct().join(first, ["query_id", "id"], "left")
        there = F.col("at").isNotNull()
        return n.select(
            "query_id",
            "id",
            "node_type",
            F.when(there, "exact").otherwise("unavailable").alias("status"),
            F.when(there, F.lit(1.0)).otherwise(F.lit(0.0)).alias("confidence"),
            F.when(there, ids.location_id(F.col("id"), F.col("at.start_offset"), F.col("at.end_offset"))).alias("location_id"),
            "at.start_offset",
            "at.end_offset",
        )
