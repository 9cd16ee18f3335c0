"""The retrieval loop, generation with failing providers, streams."""

import pytest
from pyspark.sql import functions as F

from fathomline.functions import vectors as V
from fathomline.operators import answers, expansion, prompts, search
from fathomline.plans import retrieval
from fathomline.plans.config import Preset, preset
from fathomline.streaming import requests

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    topics = ["paging moves memory pages between disk and memory", "a mutex guards shared data of threads", "tcp retransmits lost packets of a network"]
    return spark.createDataFrame([(i, f"{topics[i % 3]} note {i}", f"s{i % 2}") for i in range(30)], "doc_id bigint, text string, section string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "how does paging move memory pages"), (2, "what guards shared data"), (3, "zzz qqq")], "query_id bigint, text string")


def test_loop_asks_again_only_what_is_open(spark, corpus, asked):
    strict = Preset("learning", min_confidence="high")
    got = retrieval.retrieve(asked, corpus, strict)
    per = {r.query_id: (r.tries, r.fb) for r in got.groupBy("query_id").agg(F.max("attempts").alias("tries"), F.max("is_fallback").alias("fb"), F.countDistinct("attempts").alias("n")).collect()}
    assert all(1 <= t <= 3 for t, _ in per.values()) and any(t > 1 for t, _ in per.values())
    once = retrieval.retrieve(asked, corpus, preset("learning"), 0)
    assert {r.attempts for r in once.collect()} == {1} and set(once.columns) == set(got.columns)
    best = {r.query_id: r.chunk_id for r in once.where("rerank_rank = 1").collect()}
    assert best[1] % 3 == 0 and best[2] % 3 == 1
    lost = retrieval.empty_results(asked, once.where("query_id = 1"), "timeout", "slow").collect()
    assert {r.query_id for r in lost} == {2, 3} and lost[0].level == "low" and "simpler" in lost[0].recommendation


def test_decomposed_queries(spark, corpus):
    q = spark.createDataFrame([(7, "paging memory pages and mutex shared data")], "query_id bigint, text string")
    got = retrieval.decomposed(q, expansion.sub_queries(q, ["query_id"], 6), corpus, preset("learning")).collect()
    assert {r.chunk_id % 3 for r in got} >= {0, 1} and len({r.chunk_id for r in got}) == len(got) and [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, len(got) + 1))


def test_contexts_of_results(spark, corpus, asked):
    found = retrieval.attempt(asked, corpus, preset("learning"))
    chunks = corpus.select("doc_id", F.col("text").alias("content"), F.lit("").alias("chunk_type"), F.lit("C").alias("course"), F.lit("ch").alias("chapter"), F.col("doc_id").alias("page"), F.col("doc_id").alias("page_end"), F.lit("pdf").alias("file_type"), F.lit("").alias("prefix"))
    got = {r.query_id: r for r in retrieval.contexts(found, chunks, "learning").collect()}
    assert "paging" in got[1].context and got[1].chunks_used <= 5


def test_branches_of_no_weight_are_not_planned(spark, corpus, asked):
    rows = asked.withColumn("keywords", F.col("text"))
    only = search.hybrid(rows, corpus, {"semantic": 1.0, "keyword": 0.0, "metadata": 0.0})
    assert {r.source for r in only.collect()} == {"semantic"}
    assert search.hybrid(rows, corpus, {"semantic": 0.0, "keyword": 0.0, "metadata": 0.0}).count() == 0
    assert retrieval.status(corpus, True, {"a": 1})["keyword_backend"] == "bm25"


def test_nearest_in_blocks(spark, monkeypatch):
    rows = [(i, [float((i * k) % 7) for k in range(1, 5)]) for i in range(60)] + [(100, None)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    q = v.where("vec_id < 9").withColumnRenamed("vec_id", "query_id")
    view = lambda df: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())
    one = view(V.nearest(q, v, 4))
    monkeypatch.setattr(V, "QUERY_BYTES", 64)
    assert view(V.nearest(q, v, 4)) == one and len(one) == 36
    assert V.nearest(q.limit(0), v, 4).count() == 0


def test_generation_tries_again_what_may_pass(spark):
    seen = []

    @answers.provider("answer", "flaky")
    def flaky(rows):
        seen.append(1)
        ok = len(seen) > 2
        kind = F.when(F.col("id") == 1, F.lit(None)).when(F.col("id") == 2, None if ok else "429 retry after 2s").when(F.col("id") == 3, "429 quota per day").otherwise("broken")
        return rows.select("id", F.when(kind.isNull(), "fine").alias("answer"), kind.cast("string").alias("error"))

    rows = spark.createDataFrame([(i, "q", "c", "", "", {"a": ""}) for i in (1, 2, 3, 4)] + [(5, "", "c", "", "", {"a": ""})], "request_id bigint, query string, context string, course string, chapter string, answer_hints map<string,string>")
    got = {r.request_id: r for r in prompts.generate(rows, provider="flaky").collect()}
    assert (got[1].answer, got[1].tries) == ("fine", 1) and (got[2].answer, got[2].error_type, got[2].tries) == ("fine", None, 2)
    assert (got[3].error_type, got[3].is_daily_quota, got[3].tries) == ("rate_limit", True, 1) and (got[4].error_type, got[5].error_type) == ("error", "empty")
    assert {r.error_type for r in prompts.generate(rows, "poetry").collect()} == {"config"}


def test_templates(tmp_path):
    (tmp_path / "t.json").write_text('{"mine": {"version": "2", "system": "s", "user": "u {query}"}, "bad": {"system": "", "user": "x"}}')
    with pytest.raises(ValueError, match="empty"):
        prompts.load_templates(str(tmp_path / "t.json"))
    assert prompts.template("mine")[0] == "2"
    with pytest.raises(KeyError):
        prompts.template("none")
    with pytest.raises(FileNotFoundError):
        prompts.load_templates(str(tmp_path / "missing.json"))
    assert answers.embedding_model("hashed")["dim"] == V.DIM
    with pytest.raises(KeyError):
        answers.embedding_model("none")


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.unionByName(e.limit(7)).write.parquet(path)
    return path, e.schema, e


def _run(rows, name, mode, ck, **trigger):
    q = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", ck).trigger(**(trigger or {"availableNow": True})).start()
    done = q.awaitTermination(60)
    q.stop()
    assert done
    return q.exception()


def test_streamed_daily_counts(spark, events, tmp_path):
    path, schema, e = events
    assert _run(requests.daily_counts(requests.stream(spark, path, schema)), "days", "complete", str(tmp_path / "ck")) is None
    got = {(r.day, r.event_type): r.n for r in spark.table("days").collect()}
    want = {(r.day, r.event_type): r.n for r in spark.read.parquet(path).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_streamed_dedup_and_sink(spark, events, tmp_path):
    path, schema, e = events
    rows = requests.deduplicated(requests.stream(spark, path, schema), ["id"])
    requests.sink(rows, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()


def test_late_rows_go_to_a_side_table(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "id bigint, ts timestamp, refused bigint"
    write = lambda rows: spark.createDataFrame(rows, "id bigint, ts string, refused bigint").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    run = lambda: requests.split_late(spark.readStream.schema(schema).parquet(src), str(tmp_path / "ok"), str(tmp_path / "late"), str(tmp_path / "ck")).awaitTermination(60)
    write([(1, "2024-01-01 10:00:00", 0), (2, "2024-01-01 09:00:00", 0)])
    run()
    write([(3, "2024-01-01 09:30:00", 0), (4, "2024-01-01 09:55:00", 0), (5, None, 0)])
    run()
    assert {r.id for r in spark.read.parquet(str(tmp_path / "ok")).collect()} == {1, 2, 4, 5}
    assert {(r.id, r.refused) for r in spark.read.parquet(str(tmp_path / "late")).collect()} == {(3, 1)}


def test_conversation_state_as_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "conv_id bigint, turn bigint, role string, concept string"
    spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "Paging"), (2, 0, "user", "X")], schema).coalesce(1).write.parquet(src)
    rows = requests.conversation_state(spark.readStream.schema(schema).parquet(src))
    # timeouts ask for further batches without end, so one is run
    assert _run(rows, "states", "update", str(tmp_path / "ck"), once=True) is None
    assert {(r.conv_id, r.turns, r.last_concept, r.ended) for r in spark.table("states").collect()} == {(1, 2, "Paging", False), (2, 1, None, False)}
    cache = spark.createDataFrame([("a", "2024-01-01 10:00:00", 1), ("b", "2024-01-01 08:00:00", 2), ("c", "2024-01-01 09:30:00", 3)], "key string, at string, used_at int").withColumn("stored_at", F.col("at").cast("timestamp"))
    assert [r.key for r in requests.unexpired(cache, "2024-01-01 10:00:01", 3600, 1).collect()] == ["c"]
    assert {r.key for r in requests.unexpired(cache, "2024-01-01 10:00:01").collect()} == {"a", "c"}
