"""Tables, filters, metrics and evaluation queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from fathomline.functions import text as T
from fathomline.operators import predicates
from fathomline.plans.catalog import _M, _m, query
from fathomline.sources import tables
from fathomline.sources.tables import read
from fathomline.streaming import requests

_SCHEMA = StructType([StructField("o_orderkey", LongType()), StructField("o_orderstatus", StringType()), StructField("o_totalprice", DoubleType()), StructField("o_orderpriority", StringType()), StructField("o_custkey", LongType()), StructField("tags", ArrayType(StringType()))])
_ORDERS = predicates.schema_of(_SCHEMA, {"status": "o_orderstatus", "price": "o_totalprice", "priority": "o_orderpriority", "customer": "o_custkey"})


def _orders(spark, d):
    """Orders with a list of tags and a status that is missing now and then."""
    o = read(spark, d, "orders")
    tags = F.array_compact(F.array(F.when(F.col("o_custkey") % 2 == 0, "even"), F.when(F.col("o_custkey") % 3 == 0, "third"), F.lit("all")))
    return o.withColumn("tags", tags).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")))


_O = "WITH o AS (SELECT * REPLACE (CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS o_orderstatus), list_filter([CASE WHEN o_custkey % 2 = 0 THEN 'even' END, CASE WHEN o_custkey % 3 = 0 THEN 'third' END, 'all'], lambda x: x IS NOT NULL) tags FROM orders)"
_CASES = {
    "ne": ({"status": {"$ne": "F"}}, "o_orderstatus IS DISTINCT FROM 'F'"),
    "gt_lte": ({"price": {"$gt": 50000, "$lte": 150000}}, "o_totalprice > 50000 AND o_totalprice <= 150000"),
    "lt_gte": ({"customer": {"$lt": 100, "$gte": 10}}, "o_custkey < 100 AND o_custkey >= 10"),
    "exists": ({"status": {"$exists": True}}, "o_orderstatus IS NOT NULL"),
    "missing": ({"status": {"$exists": False}}, "o_orderstatus IS NULL"),
    "in_list": ({"tags": {"$in": ["third", "none"]}}, "list_has_any(tags, ['third', 'none'])"),
    "nin_list": ({"tags": {"$nin": ["even"]}}, "NOT list_has_any(tags, ['even'])"),
    "all": ({"tags": {"$all": ["even", "third"]}}, "list_has_all(tags, ['even', 'third'])"),
    "nin": ({"priority": {"$nin": ["5-LOW", "1-URGENT"]}}, "o_orderpriority NOT IN ('5-LOW', '1-URGENT')"),
    "eq_or": ({"$or": [{"status": "P"}, {"$and": [{"price": {"$gte": 200000}}, {"priority": ["1-URGENT"]}]}]}, "o_orderstatus = 'P' OR (o_totalprice >= 200000 AND o_orderpriority IN ('1-URGENT'))"),
}


@query(_O + " " + " UNION ALL ".join(f"SELECT '{k}' AS filter, o_orderkey FROM o WHERE {sql}" for k, (_, sql) in _CASES.items()))
def f2_every_operator(spark, d):
    """Each of the ten operators, on scalars and lists, with missing values; one scan for all filters."""
    hits = [F.when(predicates.build(_ORDERS, spec).predicate, F.lit(k)) for k, (spec, _) in _CASES.items()]
    return _orders(spark, d).select("o_orderkey", F.explode(F.array_compact(F.array(*hits))).alias("filter"))


@query(_O + " SELECT o_orderkey FROM o WHERE o_orderstatus IN ('O', 'F') AND o_totalprice < 250000 AND o_orderpriority = '2-HIGH' AND o_custkey >= 5")
def f9_f10_full_build(spark, d):
    """A preset's filters, an agent's without the keys it may not set, and a template, joined."""
    built = predicates.full(
        _ORDERS, {"status": ["O", "F"], "price": {"$lt": 250000}}, {"priority": "2-HIGH", "subject": "x", "course": "y"}, {"high": {"customer": "$gte"}}, {"customer": 5, "high": True}, without=predicates.AGENT_MAY_NOT
    )
    return _orders(spark, d).where(built.predicate).select("o_orderkey")


@query("SELECT * FROM (VALUES ('customer', 'integer', 'o_custkey'), ('o_orderkey', 'integer', 'o_orderkey'), ('price', 'number', 'o_totalprice'), ('priority', 'string', 'o_orderpriority'), ('status', 'string', 'o_orderstatus'), ('tags', 'list', 'tags')) t(field, kind, column_name)")
def f14_schema_fields(spark, d):
    return spark.createDataFrame(predicates.fields(_ORDERS), "field string, kind string, column_name string")


@query("SELECT event_id::VARCHAR request_id, CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'dev' END env, (event_type <> 'error')::INT retrieval_hit, (CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 2 END)::INT is_grounded, (event_type = 'error')::INT refused, '{\"search\":' || (user_id % 7) || '.5}' stage_timings_json FROM events")
def s17_metrics_rows(spark, d):
    """Calls as the metrics table holds them: flags as numbers, a missing flag 0, timings as JSON."""
    e = read(spark, d, "events")
    flag = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 2 == 1)
    calls = e.select(
        F.col("event_id").cast("string").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("user_id") % 2 == 0, "prod").otherwise("dev").alias("env"), F.lit("q").alias("query"), F.col("value").alias("total_time_ms"), (F.col("event_type") != "error").alias("retrieval_hit"),
        flag.alias("is_grounded"), (F.col("event_type") == "error").alias("refused"), F.lit(0.0).alias("cost_usd"), F.lit(None).cast("double").alias("faithfulness_score"), F.create_map(F.lit("search"), F.col("user_id") % 7 + 0.5).alias("stage_timings"),
    )
    return tables.metrics_record(calls).select("request_id", "env", "retrieval_hit", "is_grounded", "refused", "stage_timings_json")


@query(_M + ", d AS (SELECT id, total_time_ms, row_number() OVER (ORDER BY ts, id) nth FROM m WHERE env = 'dev') SELECT id, total_time_ms FROM d")
def s19_every_request(spark, d):
    return _m(spark, d).where("env = 'dev'").orderBy("ts", "id").select("id", "total_time_ms")


@query("SELECT n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'doc_' || substr(md5(n_name), 1, 8) ELSE lower(replace(n_name, ' ', '_')) || '_' || substr(md5(n_name), 1, 8) END namespace FROM nation")
def s14_namespace_of_id(spark, d):
    name = F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.col("n_name"))
    uuid = F.regexp_replace(F.md5("n_name"), r"^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    return read(spark, d, "nation").select("n_name", tables.namespace_of_id(name, T.slug(F.col("n_name")), uuid).alias("namespace"))


@query("SELECT label::BIGINT AS namespace, count(*) n, 64 AS dim, (CASE WHEN vec_id % 10 = 0 THEN 'rejected' ELSE 'stored' END) state FROM embeddings GROUP BY 1, 4")
def s11_stored_vectors(spark, d):
    v = read(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("namespace"), F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("embedding"), F.lit("x").alias("global_context"))
    good, bad = tables.vector_rows(v, 64, "hashed")
    both = good.select("namespace", F.col("embedding_dim").alias("dim"), F.lit("stored").alias("state")).unionByName(bad.select("namespace", F.lit(64).alias("dim"), F.lit("rejected").alias("state")))
    return both.groupBy("namespace", "dim", "state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey, sum(CASE WHEN l_linenumber % 4 <> 0 THEN 100 ELSE 0 END)::BIGINT written, sum(CASE WHEN l_linenumber % 4 = 0 THEN 100 ELSE 0 END)::BIGINT lost, count(*) batches, round(avg(l_quantity), 6) mean_ms, max(l_quantity) most_ms, min(l_quantity) least_ms FROM lineitem GROUP BY 1")
def s12_upsert_statistics(spark, d):
    batches = read(spark, d, "lineitem").select("l_suppkey", F.lit(100).alias("n"), (F.col("l_linenumber") % 4 == 0).alias("failed"), F.col("l_quantity").alias("ms"))
    return tables.upsert_statistics(batches, "l_suppkey").withColumn("mean_ms", F.round("mean_ms", 6))


@query("SELECT count(*) FILTER (event_type = 'view') hits, count(*) FILTER (event_type <> 'view') misses, count(*) FILTER (event_type = 'view') / count(*) rate FROM events")
def a21_cache_hits(spark, d):
    return requests.hit_rate(read(spark, d, "events").select((F.col("event_type") == "view").alias("hit")))


@query("SELECT event_id \"key\" FROM events WHERE ts > TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 86400 SECONDS AND event_id % 2 = 0")
def g2_unexpired(spark, d):
    """Results of the last day before a point in time."""
    rows = read(spark, d, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("key"), F.col("ts").cast("timestamp_ntz").alias("stored_at"), F.col("ts").alias("used_at"))
    now = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    return rows.where(F.col("stored_at") > now - F.expr("INTERVAL 86400 SECONDS")).select("key")


@query("SELECT l.doc_id, l.quality + b.toxic total FROM labels l JOIN labels b USING (doc_id) WHERE l.quality IS NOT NULL")
def j12_scores_by_id(spark, d):
    """Records and judged rows meet by id, never by place."""
    rows = read(spark, d, "labels")
    return rows.select("doc_id", "quality").where("quality is not null").join(rows.select("doc_id", "toxic"), "doc_id").select("doc_id", (F.col("quality") + F.col("toxic")).alias("total"))


@query("SELECT DISTINCT lower(x) term FROM (SELECT n_name x FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT 'kernel' UNION ALL SELECT 'KERNEL')")
def u2_vocabulary_union(spark, d):
    own = spark.createDataFrame([("kernel",), ("KERNEL",)], "x string")
    rows = read(spark, d, "nation").select(F.col("n_name").alias("x")).unionByName(read(spark, d, "region").select(F.col("r_name").alias("x"))).unionByName(own)
    return rows.select(F.lower("x").alias("term")).distinct()
