"""Statements explained in one batch against rows derived by hand, and cases beside the registered ones."""

import pytest

from loomtrace import queries as q
from loomtrace.operators.analysis import Analysis
from loomtrace.plans import parsed


@pytest.fixture(scope="module")
def all_at_once(spark):
    return {e: Analysis(spark, [(n, x[1]) for n, x in q.EXPLAINED.items() if x[6] == e], q.shop(spark), extended=e) for e in (False, True)}


@pytest.fixture(scope="module")
def tables(all_at_once):
    made: dict = {}

    def rows(name, table, where, extended):
        key = (table, where, extended)
        if key not in made:
            made[key] = getattr(all_at_once[extended], table).where(where).collect()
        return [r for r in made[key] if r.query_id == name]

    return rows


@pytest.mark.parametrize("name", sorted(q.EXPLAINED))
def test_explained(tables, name):
    table, _, columns, want, kinds, where, extended = q.EXPLAINED[name]
    names = columns.split(", ")
    cast = {"s": lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v), "i": lambda v: None if v is None else int(v), "d": float}
    got = [tuple(cast[k](r[n]) for n, k in zip(names, kinds, strict=True)) for r in tables(name, table, where, extended)]
    assert sorted(got, key=str) == sorted(want, key=str)


OTHERS = [
    ("missing", "SELECT t.a, b FROM ods.raw t"),
    ("shadow", "WITH order_table AS (SELECT user_id FROM user_table) SELECT user_id FROM order_table"),
    ("same_alias", "WITH a AS (SELECT t.order_no FROM order_table t), b AS (SELECT t.user_name FROM user_table t) SELECT a.order_no, b.user_name FROM a JOIN b ON 1 = 1"),
    ("cte_union", "WITH a AS (SELECT user_id AS k FROM order_table UNION ALL SELECT user_name FROM user_table) SELECT k FROM a"),
    ("scalar", "SELECT (SELECT MAX(user_name) FROM user_table) AS m, order_no FROM order_table"),
    ("using", "SELECT order_no FROM order_table JOIN user_table USING (user_id)"),
    ("insert", "INSERT INTO t SELECT order_no FROM order_table"),
    ("fromless", "SELECT 1 AS one, NOW() AS t"),
    ("case_ids", "SELECT `ORDER_NO` FROM Order_Table"),
    ("bad", "SELEC 1"),
    ("empty", " "),
]


@pytest.fixture(scope="module")
def others(spark):
    return Analysis(spark, OTHERS, q.shop(spark))


def edges(a, name):
    return {(r.edge_type, r.source, r.target) for r in a.edges.where(f"query_id = '{name}'").collect()}


def test_missing_metadata_is_synthesised(others):
    assert edges(others, "missing") == {("projection", "column:ods.raw.a", q.OUT + "1:a"), ("projection", "column:ods.raw.b", q.OUT + "2:b")}


def test_a_cte_shadows_a_table(others):
    assert ("projection", q.UT + "user_id", q.OUT + "1:user_id") in edges(others, "shadow")


def test_one_alias_in_two_ctes(others):
    e = edges(others, "same_alias")
    assert ("projection", q.OT + "order_no", q.OUT + "1:order_no") in e and ("projection", q.UT + "user_name", q.OUT + "2:user_name") in e
    assert others.diagnostics.where("query_id = 'same_alias'").count() == 0


def test_all_branches_of_a_cte(others):
    e = edges(others, "cte_union")
    assert ("alias", q.OT + "user_id", q.OUT + "1:k") in e and ("alias", q.UT + "user_name", q.OUT + "1:k") in e


def test_using_gives_a_key(others):
    assert ("join_condition", q.OT + "user_id", q.UT + "user_id") in edges(others, "using")


def test_insert_and_scalar_subquery(others):
    assert edges(others, "insert") == {("projection", q.OT + "order_no", q.OUT + "1:order_no"), ("write", q.OT + "order_no", "column:default.t.order_no")}
    assert ("projection", q.OT + "order_no", q.OUT + "2:order_no") in edges(others, "scalar")


def test_from_less(others):
    assert edges(others, "fromless") == {("projection", "literal:scope:root:1", q.OUT + "1:one"), ("unknown", "unknown:scope:root:2:t", q.OUT + "2:t")}


def test_names_match_in_any_case(others):
    assert edges(others, "case_ids") == {("projection", q.OT + "order_no", q.OUT + "1:order_no")}


def test_statuses(others):
    got = {r.query_id: r.status for r in others.statuses.collect()}
    assert got["bad"] == got["empty"] == "failed" and got["missing"] == "partial" and got["using"] == "success"


def test_result_and_stages(others):
    import json

    rows = {r.query_id: r for r in others.results.collect()}
    assert len(rows) == len(OTHERS)
    body = json.loads(rows["using"].result)
    assert body["status"] == "success" and body["confidence"] == "high" and len(body["edges"]) == 2
    stages = {(r.query_id, r.stage): r.state for r in others.stages.collect()}
    assert stages["bad", "parse"] == "failed" and stages["bad", "lineage"] == "skipped" and stages["using", "graph"] == "success"


def test_flagship(spark, sf_dir):
    got = {(r.edge_type, r.source, r.target) for r in q.flagship(spark, sf_dir).collect()}
    assert ("alias", "column:default.lineitem.l_discount", q.OUT + "2:revenue") in got and len(got) == 9


def test_the_callers_session_stays_active(spark, others):
    from pyspark.sql import SparkSession

    Analysis(spark, OTHERS[:2], q.shop(spark)).edges.collect()
    assert SparkSession.getActiveSession().conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_many_statements_go_through_the_shared_folder(spark, monkeypatch):
    from loomtrace import shared

    monkeypatch.setattr(shared, "FEW", 0)
    a = Analysis(spark, OTHERS[:3], q.shop(spark))
    assert ("projection", q.UT + "user_id", q.OUT + "1:user_id") in edges(a, "shadow") and a.statuses.count() == 3


def test_reports_say_what_where_and_how_long(spark):
    sql = {
        "parse": "SELECT order_no\nFROM order_table\nWHERE dt = = 1",
        "column": "SELECT order_no,\n  nope FROM order_table",
        "table": "SELECT a FROM nowhere n",
        "ambiguous": "SELECT user_id FROM order_table o JOIN user_table u ON o.dt = u.dt",
        "alias": "SELECT 1 AS one FROM order_table o JOIN user_table o ON 1 = 1",
        "written": "INSERT INTO user_table SELECT order_no FROM order_table",
    }
    a = Analysis(spark, list(sql.items()), q.shop(spark))
    a.edges.count()
    got = {r.query_id: r for r in a.reported.collect() if r.code in ("PARSE_ERROR", "UNKNOWN_COLUMN", "UNKNOWN_TABLE", "AMBIGUOUS_COLUMN", "DUPLICATE_ALIAS", "WRITE_COLUMNS_DIFFER")}
    assert got["parse"].start_line == 3 and sql["parse"][got["parse"].start_offset :].startswith("= 1") and "Syntax error" in got["parse"].message
    r = got["column"]
    assert (r.start_line, r.start_col, r.start_offset, r.end_offset) == (2, 3, 19, 23) and r.message == "no table in scope has a column nope" and r.details == {"tables": "order_table"} and r.location_id.startswith("loc:")
    assert sql["table"][got["table"].start_offset : got["table"].end_offset] == "nowhere" and got["table"].suggestion
    assert got["ambiguous"].details == {"candidates": "order_table, user_table"} and sql["ambiguous"][got["ambiguous"].start_offset :].startswith("user_id")
    assert got["alias"].start_offset > sql["alias"].index("JOIN") and got["written"].details == {"counts": "1 values, 3 columns"}
    nodes = {r.id: r.comment for r in a.nodes.where("query_id = 'table' and node_type = 'table'").collect()}
    assert nodes == {"table:default.nowhere": "no metadata imported"}
    spent = {r.stage: r.elapsed_ms for r in a.stages.where("query_id = 'column'").collect()}
    assert spent["parse"] > 0 and spent["lineage"] > 0 and spent["semantics"] is None


def test_a_corpus_in_batches_and_repeated_texts(spark, monkeypatch):
    """Parsed rows that are written batch by batch give what they give at once; a text that stands repeatedly is parsed once."""
    texts = [f"SELECT order_no AS a{i % 4}, nope FROM order_table o JOIN user_table u ON o.user_id = u.user_id" for i in range(12)] + ["SELEC"]
    statements = [(f"q{i}", t) for i, t in enumerate(texts)]
    whole = Analysis(spark, statements, q.shop(spark))
    small = parsed.batches
    monkeypatch.setattr(parsed, "batches", lambda spark, statements, dialect: small(spark, statements, dialect, 5))
    parts = Analysis(spark, iter(statements), q.shop(spark))
    for table in ("edges", "diagnostics", "statuses", "locations"):
        rows = [sorted(map(str, getattr(a, table).collect())) for a in (whole, parts)]
        assert rows[0] == rows[1] and len(rows[0]) >= 12, table


@pytest.mark.parametrize("name", sorted(q.PAIRS))
def test_pairs_are_counted_without_making_them(spark, sf_dir, name, monkeypatch):
    sql, run = q.EXPLAINED[name][1], []
    want = q.rows_of(spark, sf_dir, sql)
    monkeypatch.setattr(q, "rows_of", lambda *a, count=q.rows_of: run.append((a[2], count(*a))) or run[-1][1])
    frame = type(spark)
    sent, plain = [], frame.sql
    monkeypatch.setattr(frame, "sql", lambda self, text, *a, **k: (sent.append(text), plain(self, text, *a, **k))[1])
    got = q.QUERIES[name](spark, sf_dir).collect()
    assert run == [(sql, want)] and want > 10_000 and {r.n_rows for r in got} == {want}
    assert sum("COUNT(*)" in s for s in sent) == 2 and not any(sql in s for s in sent)
