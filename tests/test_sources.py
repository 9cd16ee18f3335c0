"""Readers, stored index, metrics table, settings."""

import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from fathomline.operators import search
from fathomline.plans import config
from fathomline.sources import index, readers, tables

W = 'xmlns:w="http://w"'


def _docx(path):
    p = lambda t, style="", more="": f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}{more}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Head", "Heading1") + p("Text one") + p("item", more="<w:numPr/>") + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>" + "<w:p><w:r><w:lastRenderedPageBreak/><w:t>next page</w:t></w:r></w:p>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")


def _pptx(path):
    shape = lambda t, kind="": f'<p:sp><p:nvSpPr>{f"""<p:ph type="{kind}"/>""" if kind else ""}</p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    with zipfile.ZipFile(path, "w") as z:
        for n in (1, 2, 10):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<p:sld xmlns:p="http://p" xmlns:a="http://a">{shape(f"Title {n}", "title")}{shape(f"Body {n}")}</p:sld>')


def _pdf(path):
    body = zlib.compress(rb"BT (Hello) Tj T* [(Wor) -20 (ld \(1\))] TJ ET")
    path.write_bytes(b"%PDF-1.4\n1 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream\nendobj\n")


def test_documents_of_every_format(spark, tmp_path):
    _docx(tmp_path / "a.docx")
    _pptx(tmp_path / "b.pptx")
    _pdf(tmp_path / "c.pdf")
    (tmp_path / "d.md").write_text("# Top\n- item\nplain\fpage two")
    (tmp_path / "e.html").write_text("<h1>T</h1><script>no()</script><li>x &amp; y</li>")
    (tmp_path / "f.xyz").write_text("?")
    (tmp_path / "g.docx").write_text("no archive")
    rows = readers.read_documents(spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.filename, r.elem_idx or 0)):
        got.setdefault(r.filename, []).append((r.type, r.content, r.page, r.total_pages) if r.error is None else "error")
    assert got["a.docx"] == [("title", "Head", 1, 2), ("text", "Text one", 1, 2), ("list_item", "item", 1, 2), ("table", "a | b", 1, 2), ("text", "next page", 2, 2)]
    assert [x[1] for x in got["b.pptx"]] == ["Title 1", "Body 1", "Title 2", "Body 2", "Title 10", "Body 10"] and got["b.pptx"][0][0] == "title" and got["b.pptx"][-1][3] == 10
    assert [x[1] for x in got["c.pdf"]] == ["Hello", "World (1)"]
    assert got["d.md"] == [("title", "Top", 1, 2), ("list_item", "- item", 1, 2), ("text", "plain", 1, 2), ("text", "page two", 2, 2)]
    assert got["e.html"] == [("title", "T", 1, 1), ("list_item", "x & y", 1, 1)]
    assert got["f.xyz"] == got["g.docx"] == ["error"]
    assert {"docx", "pptx", "pdf", "html", "txt"} <= set(readers.formats())
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_documents(spark, str(tmp_path / "missing"))


def test_vocabulary_and_golden_set(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"terms": ["x"], "acronyms": {"os": "operating system"}, "synonyms": {"cache": ["a", "b"]}}))
    (tmp_path / "l.json").write_text('["x", "y"]')
    (tmp_path / "g.json").write_text(json.dumps({"items": [{"id": 1, "q": "a"}, {"id": 2, "q": "b"}]}, indent=1))
    assert {(r.term, r.expansion) for r in readers.vocabulary(spark, str(tmp_path / "v.json")).collect()} == {("x", None), ("os", "operating system"), ("cache", "a"), ("cache", "b")}
    assert readers.vocabulary(spark, str(tmp_path / "l.json")).count() == 2
    assert sorted((r.id, r.q) for r in readers.golden_set(spark, str(tmp_path / "g.json")).collect()) == [(1, "a"), (2, "b")]


def test_stored_index_answers_like_a_fresh_one(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{'alpha ' * (i % 4)} beta{i % 3} gamma", f"n{i % 2}") for i in range(40)] + [(50, None, "n1")], "doc_id bigint, text string, ns string")
    q = spark.createDataFrame([(1, "alpha beta1"), (2, "gamma gamma"), (3, "none")], "query_id bigint, text string")
    path = str(tmp_path / "index")
    assert not index.stored(spark, path)
    index.save(docs, path, "ns")
    assert index.stored(spark, path)
    view = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in df.collect())
    assert view(index.look_up(spark, path, q, 5)) == view(search.bm25(docs, q, 5))
    some = view(index.look_up(spark, path, q, 5, F.col("namespace") == "n1"))
    assert some == view(search.bm25(docs, q, 5, F.col("ns") == "n1")) and all(d % 2 for _, d, _, _ in some)
    assert index.drop(spark, path) and not index.stored(spark, path)


def test_namespaces_are_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_partitioned(spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, namespace string"), path, "namespace")
    tables.write_partitioned(spark.createDataFrame([(3, "b")], "id bigint, namespace string"), path, "namespace")
    assert tables.namespaces(spark, path) == ["a", "b"] and {r.id for r in spark.read.parquet(path).collect()} == {1, 3}
    assert tables.drop_namespace(spark, path, "a") and not tables.drop_namespace(spark, path, "zzz") and tables.namespaces(spark, path) == ["b"]


def test_metrics_table(spark, tmp_path):
    path = str(tmp_path / "m")
    schema = "request_id string, ts timestamp, env string, query string, total_time_ms double, retrieval_hit boolean, is_grounded boolean, refused boolean, cost_usd double, faithfulness_score double, stage_timings map<string,double>"
    calls = spark.createDataFrame([("a", None, "prod", "q", 1.0, True, None, False, 0.1, None, {"s": 2.0})], schema)
    tables.record(calls, path)
    tables.record(calls.withColumn("request_id", F.lit("b")).withColumn("ts", F.lit("2020-01-01").cast("timestamp")).withColumn("env", F.lit("dev")), path)
    rows = tables.every_record(spark, path).collect()
    assert [r.request_id for r in rows] == ["b", "a"] and rows[1].is_grounded == 0 and rows[1].retrieval_hit == 1 and rows[1].ts is not None and json.loads(rows[1].stage_timings_json) == {"s": 2.0}
    assert [r.request_id for r in tables.every_record(spark, path, "prod").collect()] == ["a"]


def test_small_scans_are_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(40).write.parquet(str(tmp_path / "many"))
    one, many = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "many"))
    assert tables.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and tables.spread(many) is many
    assert tables.spread(one).count() == 1000


def test_settings_and_presets(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text('{"weights": {"semantic": 0.7}, "x": 1}')
    monkeypatch.setenv("FATHOMLINE_WEIGHTS__KEYWORD", "0.3")
    monkeypatch.setenv("FATHOMLINE_NAME", "plain text")
    defaults = {"weights": {"semantic": 0.6, "keyword": 0.4}, "x": 0, "y": 2}
    assert config.load(str(tmp_path / "c.json"), defaults) == {"weights": {"semantic": 0.7, "keyword": 0.3}, "x": 1, "y": 2, "name": "plain text"}
    assert config.load(None, {"a": 1})["a"] == 1 and defaults["x"] == 0
    base = config.preset("learning")
    assert config.for_retry(base).candidate_k == 50 and config.for_retry(base).min_confidence == "low" and config.relaxed("high") == "medium"
    assert (config.for_timeout(base).candidate_k, config.for_timeout(base).rerank_k) == (20, 2)
    assert config.for_fallback(base).weights["semantic"] == 1.0 and config.for_fallback(base).rerank_k == 3
    with pytest.raises(ValueError, match="sum to 1"):
        config.Preset("x", weights={"semantic": 0.5})
    with pytest.raises(KeyError):
        config.preset("none")
