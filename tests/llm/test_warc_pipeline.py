"""Revisits, components, and the pipeline from end to end."""

from loomtrace.llm import warc
from loomtrace.llm.components import components

from .helpers import PROSE, SCHEMA

RECORD = "record_id bigint, url string, ts bigint, kind string, etag string, last_modified string, digest string, headers map<string,string>, target string"


def test_resolve(spark):
    rows = [
        (1, "http://www.A.org:80/x/?b=2&a=1&utm_source=q#top", 10, "response", '"v1"', None, "d1", {"etag": '"v1"', "content-length": "9", "age": "5"}, ""),
        (2, "https://a.org/x?a=1&b=2", 20, None, '"v2"', None, "d2", {"etag": '"v2"'}, ""),
        (3, "a.org/x?a=1&b=2", 20, "revisit", '"v1"', None, "d1", {"age": "0", "content-length": "0"}, ""),  # ts 20 itself is not earlier
        (4, "a.org/x?a=1&b=2", 25, "revisit", 'W/"v2"', None, None, None, ""),
        (5, "a.org/x?a=1&b=2", 30, "revisit", '"v1"', None, "d2", {}, ""),
        (6, "b.org", 5, "revisit", None, None, "d", {}, ""),
        (7, None, 50, "revisit", None, None, "d", {}, ""),
        (8, "c.org/", 1, "response", None, "monday", "z", {}, ""),
        (9, "c.org", None, "revisit", None, "monday", "z", {}, ""),
        (10, "c.org", 2, "revisit", '"q"', "monday", None, {"x": "1"}, ""),
        (10, "c.org", 2, "revisit", '"q"', "monday", None, {"x": "1"}, ""),
    ]
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, RECORD)).collect()}
    assert {k: (r.target_id, r.outcome) for k, r in got.items()} == {3: (1, "resolved"), 4: (2, "resolved"), 5: (2, "changed"), 6: (None, "no earlier response"), 7: (None, "no earlier response"), 9: (None, "no earlier response"), 10: (8, "resolved")}
    assert got[3].headers == {"etag": '"v1"', "content-length": "9", "age": "0"} and got[5].headers is None
    assert warc.resolve(spark.createDataFrame([], RECORD)).count() == 0


def test_missing_times_repeated_records_and_escapes(spark):
    rows = [
        (1, "http://a.org/~x%2fy?q=%41", None, "response", '"v"', None, None, {"etag": '"v"', "a": "1"}, ""),
        (1, "http://a.org/~x%2fy?q=%41", None, "response", '"v"', None, None, {"etag": '"v"', "a": "2"}, ""),
        (1, "http://a.org/~x%2fy?q=%41", None, "response", '"v"', None, None, None, ""),
        (2, "http://a.org/%7Ex%2Fy?q=A", 5, "revisit", '"v"', None, None, {}, ""),
        (3, "http://a.org/%7ex%2Fy?q=A", None, "revisit", '"v"', None, None, {}, ""),
        (4, "b.org/%zz%", 1, "response", '"w"', None, None, {"a": "old"}, ""),
        (4, "b.org/%zz%", 2, "response", '"w"', None, None, {"a": "new"}, ""),
        (5, "b.org/%zz%", 3, "revisit", '"w"', None, None, {}, ""),
    ]
    for parts in (1, 4):
        got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, RECORD).repartition(parts)).collect()}
        assert (got[2].url_key, got[2].target_id, got[2].target_ts, got[2].ts, got[2].outcome, got[2].headers["a"]) == ("a.org/~x%2Fy?q=A", 1, None, 5, "resolved", "2")
        assert (got[3].ts, got[3].target_id, got[3].outcome) == (None, None, "no earlier response")
        assert (got[5].url_key, got[5].target_ts, got[5].headers) == ("b.org/%zz%", 2, {"a": "new"})


def test_one_url_over_many_blocks(spark):
    rows = [(i, "hot.org/p", 2 * i, "response", f'"{i}"', None, None, {}, "") for i in range(400)] + [(1000 + i, "hot.org/p", 2 * i + 1, "revisit", f'"{i}"', None, None, {}, "") for i in range(400)]
    got = warc.resolve(spark.createDataFrame(rows, RECORD))
    assert got.where("target_id <> record_id - 1000 or outcome <> 'resolved'").count() == 0 and got.count() == 400


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 1)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = top(a), top(b)
            root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: top(x) for x in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns, name
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() < docs.count() and out.where("not round_trip").count() == 0
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").collect()}
    assert len(kept & bad) <= 0.1 * len(bad)


def test_near_copies_of_the_pipeline(spark):
    import corpus_pipeline

    def text(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    # shared and all shingles of five words: 82 of 100 at the end or the start, 80 of 100, 79 of 100
    rows = [(1, text("a", 86)), (2, text("a", 104)), (3, text("b", 104)), (4, text("b", 104).split(" ", 18)[18]), (5, text("c", 84)), (6, text("c", 104)), (7, text("d", 83)), (8, text("d", 104))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, None).collect()) == [1, 3, 5, 7, 8]


def test_pipeline_of_awkward_documents(spark, sf_dir):
    import corpus_pipeline

    from .helpers import frame

    for rows in (None, [], [(1, None, None, None, None)], [(1, PROSE, "en", "s", 3)] * 3):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        ids = [r.doc_id for r in docs.collect()]
        assert len(ids) == len({i for i in ids if i is not None}) + ids.count(None) and set(ids) <= {r.doc_id for r in frame(spark, rows).collect()}
        assert {"doc_id", "k", "score", "token_ids"} <= set(docs.columns)
        if rows == []:
            assert ids == []


def test_captures_have_all_outcomes(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/{i % 90}?ref=x", f"text {i % 5}") for i in range(400)], "page_id bigint, url string, html string")
    got = warc.revisit_rows(pages)
    assert got.count() == 400 and {r.outcome for r in got.collect()} == {"resolved", "changed", "no earlier response"}


def test_resolve_with_ties_and_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = [(i, "hot.org/p", 10, "response", f'"{i}"', None, None, {}, "") for i in range(5)] + [(100 + i, "hot.org/p", 11, "revisit", '"4"', None, None, {}, "") for i in range(300)]
    df = spark.createDataFrame(rows, RECORD)
    for name in ("blk", "again", "near", "carry", "full", "url_key", "outcome", "old", "new"):
        df = df.withColumn(name, F.lit(name))
    got = warc.resolve(df)
    assert got.where("target_id = 4 and outcome = 'resolved'").count() == 300 and got.count() == 300
