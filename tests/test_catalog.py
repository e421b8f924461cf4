"""The import format, its checks, and the store."""

import json

import pytest

from loomtrace import queries as q
from loomtrace.operators import editor
from loomtrace.sources import catalog
from loomtrace.sources.store import Store


def write(path, payload):
    path.write_text(json.dumps(payload) if isinstance(payload, dict) else payload)
    return str(path)


PAYLOAD = {"schema_version": "1.0", "metadata_version": "v9", "tables": [{"name": "t", "columns": [{"name": "a", "data_type": "int", "ordinal": 1}, {"name": "m", "data_type": "map<string,int>", "ordinal": 2, "is_partition": True}]}, {"schema": "ods", "name": "u", "columns": [{"name": "x"}]}]}


def test_payload_round_trip(spark, tmp_path):
    p = catalog.read_payload(spark, write(tmp_path / "p.json", PAYLOAD))
    got = {(r.schema_name, r.table_name, r.column_name): (r.data_type, r.is_partition, r.ordinal) for r in catalog.merged(p, q.shop(spark)).collect()}
    assert got["default", "t", "m"] == ("map<string,int>", True, 2) and got["ods", "u", "x"] == ("unknown", False, 1) and ("default", "order_table", "dt") in got
    assert {r.code for r in catalog.validate(p).collect()} == {"METADATA_IMPORT_COMPLEX_TYPE", "METADATA_IMPORT_MISSING_ORDINAL"}


@pytest.mark.parametrize("bad", ['{"schema_version": "1.0",}', json.dumps(PAYLOAD | {"surprise": 1})])
def test_malformed_payloads_fail(spark, tmp_path, bad):
    with pytest.raises(Exception):  # noqa: B017
        catalog.read_payload(spark, write(tmp_path / "b.json", bad)).collect()


def test_checks(spark, tmp_path):
    bad = {"schema_version": "2.0", "metadata_version": "v", "tables": [{"name": " ", "columns": [{"name": "a", "ordinal": 1}]}, {"name": "e", "columns": []}]}
    codes = sorted(r.code for r in catalog.validate(catalog.read_payload(spark, write(tmp_path / "c.json", bad))).collect())
    assert codes == ["METADATA_IMPORT_EMPTY_COLUMNS", "METADATA_IMPORT_EMPTY_TABLE_NAME", "METADATA_IMPORT_SCHEMA_UNSUPPORTED"]


def test_nested_unknown_keys_fail(spark, tmp_path):
    for bad in ({"name": "t", "extra": 1, "columns": [{"name": "a"}]}, {"name": "t", "columns": [{"name": "a", "extra": 1}]}):
        with pytest.raises(ValueError, match="extra"):
            catalog.read_payload(spark, write(tmp_path / "n.json", PAYLOAD | {"tables": [bad]}))


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.versions().count() == 0 and store.effective_version() is None and store.tables().count() == 0
    first = store.load(write(tmp_path / "a.json", PAYLOAD | {"source_name": "test"}))
    assert store.effective_version() == "v9" and store.effective_version("no") is None
    made = {r.normalized_name: (r.created_at, r.updated_at) for r in store.read("tables").collect()}
    again = {"metadata_version": "v9", "tables": [{"name": "T", "columns": [{"name": "a", "ordinal": 1}, {"name": "b", "ordinal": 2}]}, {"name": " ", "columns": [{"name": "x"}]}]}
    p = catalog.read_payload(spark, write(tmp_path / "b.json", again))
    seen = store.preview(p).first()
    assert (seen.status, seen.tables, seen.total_columns, seen.added, seen.updated, seen.unchanged, seen.errors, seen.warnings) == ("preview_ready", 2, 3, 1, 1, 0, 1, 1)
    second = store.commit(p)
    now = {r.normalized_name: (r.created_at, r.updated_at) for r in store.read("tables").collect()}
    assert now["t"][0] == made["t"][0] and now["t"][1] > made["t"][1] and now["u"] == made["u"]
    assert [r.column_name for r in store.columns("t").collect()] == ["a", "b"] and store.table("T").count() == 1 and store.table("zz").count() == 0
    jobs = {r.job_id: (r.status, r.total_tables, r.skipped_tables, r.error_count) for r in store.read("jobs").collect()}
    assert jobs == {first: ("committed", 2, 0, 0), second: ("committed", 2, 1, 1)} and store.read("errors").count() == 1
    store.commit(catalog.read_payload(spark, write(tmp_path / "c.json", {"metadata_version": "v10", "tables": [{"name": "n", "schema": "ods", "columns": [{"name": "a"}]}]})))
    assert [(r.version, r.table_count) for r in store.versions().collect()] == [("v10", 1), ("v9", 2)]
    assert [r.table_name for r in store.tables(schema="ods").collect()] == ["n"] and store.tables("v9", schema="default").count() == 1 and {r.table_name for r in store.context("v9").collect()} == {"T", "u"}
    failed = store.commit(catalog.read_payload(spark, write(tmp_path / "d.json", PAYLOAD | {"schema_version": "2.0", "metadata_version": "v11"})))
    assert store.read("jobs").where(f"job_id = '{failed}'").first().status == "failed" and store.effective_version() == "v10"


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.load(write(tmp_path / "a.json", PAYLOAD))
    before = store._newest()
    with pytest.raises(Exception):  # noqa: B017
        store.publish({"columns": store.read("columns").limit(0), "jobs": spark.range(1).selectExpr("raise_error('stop') as job_id")})
    assert store._newest() == before and store.read("columns").count() == 3


def test_export_and_import_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "one"))
    store.load(write(tmp_path / "a.json", PAYLOAD))
    store.export(str(tmp_path / "out"))
    other = Store(spark, str(tmp_path / "two"))
    other.load(str(tmp_path / "out"))
    assert sorted(map(tuple, other.read("columns").collect()), key=str) == sorted(map(tuple, store.read("columns").collect()), key=str)


def test_formatting_keeps_comments(spark):
    assert editor.format_sql(spark, "select -1, a - -2 -- why\nfrom t /* all */ where b=1") == "SELECT\n  -1,\n  a - -2 -- why\nFROM t /* all */\nWHERE b = 1"
    nested = editor.format_sql(spark, "select a from (select b as a from t where x between 1 and 2 and y in (1, 2)) q left join r on q.a=r.a and r.z>1")
    assert nested == "SELECT\n  a\nFROM (\n    SELECT\n      b AS a\n    FROM t\n    WHERE x BETWEEN 1 AND 2\n      AND y IN (1, 2)\n  ) q\nLEFT JOIN r ON q.a = r.a AND r.z > 1" and editor.format_sql(spark, nested) == nested


def test_completion_of_unfinished_text(spark):
    got = editor.complete(spark, q.shop(spark), "SELECT u. FROM user_table AS u WHERE (", 1, 10).where("kind = 'column'")
    assert {r.label for r in got.collect()} == {"user_id", "user_name", "dt"}
    assert editor.hover(spark, q.shop(spark), "SELECT zz FROM user_table", 1, 9).count() == 0
    assert editor.hover(spark, q.shop(spark), "SELECT 1", 7, 90).count() == 0
    two = catalog.columns_from(spark, {"t": "a int", "ods.t": "b int, c int"})
    assert {r.label for r in editor.complete(spark, two, "SELECT  FROM ods.t x", 1, 8).where("kind = 'column'").collect()} == {"b", "c"}
    assert {r.label for r in editor.complete(spark, two, "SELECT  FROM t", 1, 8).where("kind = 'column'").collect()} == {"a"}
    assert {r.label for r in editor.complete(spark, two, "SELECT ", 1, 8).where("kind = 'column'").collect()} == {"t.a", "t.b", "t.c"}
    assert editor.hover(spark, two, "SELECT x.c FROM ods.t x", 1, 10).first().name == "t.c" and editor.hover(spark, two, "SELECT 1 FROM ods.t", 1, 19).first().kind == "table"
