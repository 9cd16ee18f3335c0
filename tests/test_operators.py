"""Operators on small tables, and every query against its SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import context, ingest, metrics, predicates
from fathomline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(rows):
    return sorted(repr(tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(sql)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert _norm(rows) == _norm(tuple(x[i] for i in at) for x in want.fetchall())


def test_predicates_note_what_they_skip(spark):
    schema = {"a": predicates.Field("integer"), "s": predicates.Field("string", "name")}
    built = predicates.build(schema, {"a": {"$gt": 1, "$like": 2}, "zzz": 1, "s": ["x", 3]})
    assert len(built.notes) == 3
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (None, None)], "a int, name string")
    assert [r.a for r in rows.where(built.predicate).collect()] == [2]
    assert predicates.simple(schema, "a", True, strict=True).predicate is None
    with pytest.raises(ValueError):
        predicates.combine([], "$xor")


def test_merging_pages_follows_the_rule():
    """A page limit also for the last small chunk: pages 0-6 of 10 10 100 10 10 10 10 tokens."""
    assert ingest._merged([10, 10, 100, 10, 10, 10, 10], 75, 3) == [(0, 3), (3, 3), (6, 1)]
    assert ingest._merged([100, 100, 10], 75, 3) == [(0, 1), (1, 2)] and ingest._merged([3], 75, 3) == [(0, 1)] and ingest._merged([], 75, 3) == []


def test_transitions_begin_where_the_limit_is_reached():
    assert ingest._topics([300, 250, 100, 500, 50], 512) == [0, 1, 1, 2, 2] and ingest._topics([600, 1], 512) == [0, 0]


def test_elements_keep_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a\n\n b "), (None, "c"), (1, "x"), (2, None), (3, " ")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.elem_idx, r.content, r.total_pages) for r in ingest.elements(docs).collect())
    assert got == [(0, 0, "a", 1), (0, 0, "c", 1), (0, 2, "b", 1), (1, 0, "x", 1)]


def test_chunks_of_whole_documents(spark):
    long = "One sentence of a few words. " * 300
    docs = spark.createDataFrame([(1, "short"), (2, long), (None, "none"), (None, long)], "doc_id bigint, text string")
    got = ingest.chunks(docs).collect()
    assert {r.chunk_id for r in got if r.doc_id == 1} == {"1_chunk_0000"}
    parts = [r for r in got if r.doc_id == 2]
    assert len(parts) > 4 and all(r.tokens <= 512 and r.chunk_type == "slide_split" and r.parent_chunk_id == "2_0000" for r in parts)
    assert len([r for r in got if r.doc_id is None]) == len(parts) + 1


def test_cleaning(spark):
    assert ingest.repaired("cafÃ©") == "café" and ingest.repaired("café Ã") == "café Ã"
    df = spark.createDataFrame([(1, 0, "ﬁne  text\x07 "), (1, 1, "x"), (1, 2, "a bro-\nken, line\nhere")], "doc_id bigint, elem_idx bigint, content string")
    got = {r.elem_idx: (r.content, r.fixed) for r in ingest.clean(df, ocr=True).collect()}
    assert got == {0: ("fine text", True), 2: ("a bro-\nken, line here", True)}


def test_text_functions(spark):
    row = spark.createDataFrame([("  Ab c!\tD \n\n\n\nx\x07 ", "Straße été A1")], "a string, b string").select(T.tidy(F.col("a")).alias("tidy"), T.slug(F.col("b")).alias("slug"), T.tokens(F.col("b")).alias("tokens"), T.slug(F.lit("!!")).alias("none")).first()
    assert row.slug == "strae_t_a1" and row.none == "default" and row.tokens == ["straße", "été", "a1"]
    assert "\x07" not in row.tidy and "\n\n\n" not in row.tidy


def test_incidents_and_levels(spark):
    rows = spark.createDataFrame([(i, i, 1, int(f)) for i, f in enumerate([0, 1, 1, 0, 1])], "id int, ts int, user_id int, refused int")
    assert {(r.first_i, r.last_i) for r in metrics.incidents(rows).collect()} == {(2, 3), (5, 5)}
    assert [r[0] for r in spark.createDataFrame([(0.8,), (0.6,), (0.1,)], "s double").select(context.level(F.col("s"))).collect()] == ["high", "medium", "low"]


def test_stream_counts_every_event(spark, tmp_path):
    from fathomline.streaming import requests

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    rows = requests.windowed(requests.stream(spark, str(tmp_path / "in"), events.schema), "1 hour", "1 hour")
    q = rows.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == events.count()
