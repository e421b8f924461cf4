"""Completion and hover for unfinished statements: by Spark's lexer, as they need not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..shared import small_table

#: Keywords and functions that are offered (fixed values).
KEYWORDS = (
    "SELECT", "FROM", "WHERE", "JOIN", "LEFT", "RIGHT", "INNER", "OUTER",
    "FULL", "CROSS", "ON", "AND", "OR", "NOT", "IN", "EXISTS", "BETWEEN",
    "LIKE", "IS", "NULL", "AS", "DISTINCT", "ALL", "UNION", "INTERSECT",
    "EXCEPT", "ORDER", "BY", "ASC", "DESC", "GROUP", "HAVING", "LIMIT",
    "OFFSET", "INSERT", "INTO", "VALUES", "UPDATE", "SET", "DELETE",
    "CREATE", "TABLE", "VIEW", "ALTER", "DROP", "WITH", "CASE", "WHEN",
    "THEN", "ELSE", "END", "CAST", "COUNT", "SUM", "AVG", "MIN", "MAX",
    "COALESCE", "IFNULL", "NVL", "NULLIF", "TRUE", "FALSE",
)
FUNCTIONS = (
    "COUNT", "SUM", "AVG", "MIN", "MAX", "COALESCE", "IFNULL", "NVL",
    "NULLIF", "CAST", "CONCAT", "SUBSTR", "TRIM", "UPPER", "LOWER",
    "LENGTH", "REPLACE", "ROUND", "FLOOR", "CEIL", "ABS", "DATE",
    "DATE_FORMAT", "NOW", "CURRENT_DATE", "CURRENT_TIMESTAMP",
    "ROW_NUMBER", "RANK", "DENSE_RANK", "LAG", "LEAD", "FIRST_VALUE",
    "LAST_VALUE",
)
#: Words that are no names: keywords that aren't functions, and a few that are not offered.
STRUCTURE = {*KEYWORDS, "USING", "OVER", "PARTITION", "ROWS", "RANGE", "NATURAL", "LATERAL"} - set(FUNCTIONS)
TABLE_AFTER, COLUMN_AFTER = {"FROM", "JOIN", "INTO", "TABLE", "UPDATE"}, {"SELECT", "WHERE", "AND", "OR", "ON", "BY", "HAVING", "WHEN", "THEN", "ELSE", "SET", "DISTINCT"}


def tokens(spark: SparkSession, sql: str, comments: bool = False) -> list[str]:
    """The words of a text, by Spark's lexer; blanks are left out, and comments unless they are wanted."""
    jvm = spark._jvm
    parser = jvm.org.apache.spark.sql.catalyst.parser
    lexer = parser.SqlBaseLexer(parser.UpperCaseCharStream(jvm.org.antlr.v4.runtime.CharStreams.fromString(sql)))
    lexer.removeErrorListeners()
    found = lexer.getAllTokens()
    every = [found.get(i) for i in range(found.size())]
    return [t.getText() for t in every if t.getChannel() == 0 or (comments and t.getText().startswith(("--", "/*")))]


def context(words: list[str]) -> str:
    """What is written at the text's end: table, column or keyword."""
    for w in reversed(words):
        if w.upper() in TABLE_AFTER:
            return "table"
        if w.upper() in COLUMN_AFTER:
            return "column"
    return "keyword"


def tables_in(words: list[str]) -> dict[str, tuple[str, str]]:
    """Alias -> (schema, table) of what follows FROM and JOIN; a name without a schema is in the default one."""
    out = {}
    plain = lambda w: w.strip("`").lower()
    for i, w in enumerate(words[:-1]):
        before = [x.upper() for x in words[:i]]
        listed = w == "," and "FROM" in before and not {"WHERE", "GROUP", "ORDER"} & set(before)
        if w.upper() not in ("FROM", "JOIN") and not listed:
            continue
        end = i + 2
        while words[end : end + 1] == ["."] and len(words) > end + 1:
            end += 2
        parts = [plain(x) for x in words[i + 1 : end : 2]]
        rest = words[end : end + 2]
        if len(rest) == 2 and rest[0].upper() == "AS":
            alias = rest[1]
        else:
            alias = rest[0] if rest and rest[0].upper() not in STRUCTURE and rest[0].isidentifier() else parts[-1]
        out[plain(alias)] = ((["default", *parts])[-2], parts[-1])
    return out


def of_tables(columns: DataFrame, named: set[tuple[str, str]]) -> DataFrame:
    """Catalog rows of (schema, table) names."""
    hit = F.lit(False)
    for schema, table in sorted(named):
        hit = hit | ((F.lower("schema_name") == schema) & (F.lower("table_name") == table))
    return columns.where(hit)


def first_tables(columns: DataFrame, tables: int = 50, each: int = 200) -> DataFrame:
    """The first tables by name, and of each the first columns: what is offered where no table is named."""
    few = columns.select("schema_name", "table_name").distinct().orderBy("table_name", "schema_name").limit(tables)
    place = F.row_number().over(Window.partitionBy("schema_name", "table_name").orderBy("ordinal"))
    return columns.join(few, ["schema_name", "table_name"], "left_semi").withColumn("place", place).where(F.col("place") <= each)


def complete(spark: SparkSession, columns: DataFrame, sql: str, line: int, col: int) -> DataFrame:
    """kind, label: candidates at a cursor (both from 1)."""
    lines = sql.replace("\r\n", "\n").split("\n")
    offset = sum(len(x) + 1 for x in lines[: line - 1]) + col - 1
    before, every = tokens(spark, sql[:offset]), tokens(spark, sql)
    words = small_table(spark, [("keyword", k) for k in KEYWORDS] + [("function", f) for f in FUNCTIONS], "kind string, label string")
    where = context(before)
    if where == "table":
        return words.unionByName(columns.select(
            F.lit("table").alias("kind"),
            F.col("table_name").alias("label"),
        ).distinct().orderBy("label").limit(100))
    if where == "column":
        named = set(tables_in(every).values())
        found = of_tables(columns, named) if named else first_tables(columns)
        label = F.col("column_name") if named else F.concat_ws(".", "table_name", "column_name")
        return words.unionByName(found.select(F.lit("column").alias("kind"), label.alias("label")).distinct())
    return words


def hover(spark: SparkSession, columns: DataFrame, sql: str, line: int, col: int) -> DataFrame:
    """kind, name, data_type of what the cursor is on: a column by its prefix, else a table, else a column of the statement's tables; no row if nothing."""
    lines = sql.replace("\r\n", "\n").split("\n")
    text = lines[line - 1] if 0 < line <= len(lines) else ""
    col = max(1, min(col, len(text) + 1))
    is_name = lambda ch: ch.isalnum() or ch in "_`"
    a = b = col - 1
    while a > 0 and is_name(text[a - 1]):
        a -= 1
    while b < len(text) and is_name(text[b]):
        b += 1
    word, prefix = text[a:b].strip("`").lower(), None
    if a > 0 and text[a - 1] == ".":
        p = a - 1
        while p > 0 and is_name(text[p - 1]):
            p -= 1
        prefix = text[p : a - 1].strip("`").lower()
    used = tables_in(tokens(spark, sql))
    owner = {used.get(prefix, ("default", prefix))} if prefix else set(used.values())
    column = (
        of_tables(columns, owner).where(F.lower("column_name") == word)
        .select(
            F.lit("column").alias("kind"),
            F.concat_ws(".", "table_name", "column_name").alias("name"),
            "data_type",
            F.lit(2 if not prefix else 0).alias("r"),
        )
    )
    table = (
        of_tables(columns, {(prefix, word) if prefix else used.get(word, ("default", word))})
        .select(
            F.lit("table").alias("kind"),
            F.col("table_name").alias("name"),
            F.lit(None).cast("string").alias("data_type"),
            F.lit(1).alias("r"),
        )
        .distinct()
    )
    both = column.unionByName(table)
    least = both.agg(F.min("r").alias("least"))
    return both.join(F.broadcast(least), F.col("r") == F.col("least")).select("kind", "name", "data_type")


#: Clauses that begin a line (fixed values).
BREAKS = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "WITH")


def format_sql(spark: SparkSession, sql: str) -> str:
    """A statement with keywords in capitals, a line for each clause, an indented line for each select item and each condition; queries in
    parentheses are indented in the same way; comments stay where they are."""
    words = tokens(spark, sql, comments=True)
    operators = ("=", "<", ">", "<=", ">=", "<>", "!=", "+", "-", "*", "/", "%")
    out, last, sign, between = "", "", False, False
    #: Of each open parenthesis whether it holds a query; the clause of each query that is open.
    open_, clauses, due = [], [""], False

    def line(extra: int = 0) -> None:
        nonlocal out
        out = out.rstrip() + "\n" + "  " * (2 * (len(clauses) - 1) + extra)

    for n, w in enumerate(words):
        if w.startswith(("--", "/*")):
            out = (out if out.endswith("\n") or not out else out.rstrip(" ") + " ") + w.rstrip()
            if w.startswith("--"):
                line(int(due or bool(clauses[-1])))
                due = False
            else:
                out += " "
            continue
        up = w.upper() if w.upper() in STRUCTURE or w.upper() in BREAKS or w.upper() in ("BETWEEN", "AND", "OR", "DISTINCT") else w
        here = not open_ or open_[-1]
        if w == ")" and open_ and open_.pop():
            clauses.pop()
            line(1)
        elif up in BREAKS and here and not (up in ("JOIN", "OUTER") and last in (*BREAKS, "OUTER")):
            if out and last != "(":
                line()
            clauses[-1], due, between = up, False, False
        elif due and up not in ("DISTINCT", "ALL"):
            line(1)
            due = False
        elif up in ("AND", "OR") and here and clauses[-1] in ("WHERE", "HAVING"):
            if up == "OR" or not between:
                line(1)
            between = False
        between = between or up == "BETWEEN"
        fresh = not out or out.rstrip(" ").endswith("\n")
        glue = sign or w in (",", ")", ".", ";") or last in ("(", ".") or (w == "(" and last.upper() not in STRUCTURE and last.upper() not in ("IN", "AS", "EXISTS", "AND", "OR", "NOT") and last not in (",", *operators))
        out = out + up if fresh else out.rstrip(" ") + up if glue else out + up
        out += " "
        if w == "(":
            query = n + 1 < len(words) and words[n + 1].upper() in ("SELECT", "WITH")
            open_.append(query)
            if query:
                clauses.append("")
                line()
                last = "("
                sign = False
                continue
        if up == "SELECT":
            due = True
        elif up == "," and here and clauses[-1] == "SELECT":
            line(1)
        sign = w in ("+", "-") and (not last or last in ("(", ",", *operators) or last.upper() in STRUCTURE)
        last = up
    return "\n".join(x.rstrip() for x in out.strip().split("\n"))


def revealed(locations: DataFrame, requests: DataFrame, entity_id: str) -> DataFrame:
    """query_id, start_line, start_col, end_line, end_col: the range of an entity's first place, for an editor."""
    first = (
        locations.where(F.col("entity_id") == entity_id)
        .groupBy("query_id")
        .agg(F.min(F.struct("start_offset", "end_offset", "start_line", "start_col")).alias("at"))
    )
    j = first.join(requests.select("query_id", "sql"), "query_id")
    return j.select(
        "query_id",
        "at.start_line",
        "at.start_col",
        ids.line_of(F.col("sql"), F.col("at.end_offset")).alias("end_line"),
        ids.column_of(F.col("sql"), F.col("at.end_offset")).alias("end_col"),
    )


def as_of(locations: DataFrame, line: int, col: int) -> DataFrame:
    """query_id, entity_id: the location on the cursor's line that begins last at or before it."""
    return (
        locations.where((F.col("start_line") == line) & (F.col("start_col") <= col))
        .groupBy("query_id")
        .agg(F.max_by("entity_id", F.struct("start_col", "entity_id")).alias("entity_id"))
    )
