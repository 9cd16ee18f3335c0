"""Folds and text operators against plain Python."""

import re

from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import answers, assembly, evaluation, expansion, ingest


def _sentences(text):
    return re.split(r"(?<=[.!?])\s+", text)


def _leading(text, budget):
    if budget <= 0 or not text:
        return ""
    kept = []
    for s in _sentences(text):
        if sum(len(x) // 4 for x in kept) + len(s) // 4 > budget:
            return " ".join(kept) if kept else text[: budget * 4] + "..."
        kept.append(s)
    return " ".join(kept)


def test_leading_sentences(spark):
    texts = ["", "One. Two.", "A sentence here. " * 20, "x" * 300 + ". End.", "No end " * 30]
    df = spark.createDataFrame([(t, b) for t in texts for b in (-1, 0, 1, 9, 40, 500)], "text string, budget int")
    for r in df.select("text", "budget", T.leading_sentences(F.col("text"), F.col("budget")).alias("got")).collect():
        assert r.got == _leading(r.text, r.budget) == assembly._leading(r.text, r.budget), (r.text[:20], r.budget)


def test_assembly(spark):
    text = "One short sentence. " * 6
    rows = [(1, 1, 1, "a_b", text), (1, 1, 2, "a_b", text), (1, 2, 3, "b", "Tiny."), (2, 1, 1, "a_b", "x" * 500), (2, 2, 2, "b", "End.")]
    df = spark.createDataFrame(rows, "q long, section_ord int, ord int, section string, content string")

    def run(budget, header="Head"):
        return {r.q: (r.context, r.used, r.n_chunks, r.truncated) for r in assembly.assemble(df, "q", header, budget).collect()}

    assert run(3, "A header of more tokens than that") == {1: ("", 0, 0, True), 2: ("", 0, 0, True)}
    full = run(1000)
    assert full[1] == (f"Head\n\n## A B\n{text}\n{text}\n\n## B\nTiny.", 1 + 1 + 30 + 30 + 1 + 1, 3, False)
    some = run(40)  # the second chunk is cut at a sentence, which ends its section; the next label does not fit any more
    assert some[1][0] == f"Head\n\n## A B\n{text}\nOne short sentence. One short sentence." + assembly.CUT_MARK and some[1][3]
    assert run(1)[1] == ("Head[...]", 1, 0, True)
    assert "x" * 100 + "..." in run(40)[2][0]


def test_build_of_a_context(spark):
    rows = [(1, i, s, c, k, "C", "ch", p, None, "pptx", "") for i, (s, c, k, p) in enumerate([(0.9, "A thing is defined as x.", "", 1), (0.8, "For example: y", "", 1), (0.7, "[pre] z", "slide", 2)])]
    df = spark.createDataFrame(rows, "q long, chunk_id long, score double, content string, chunk_type string, course string, chapter string, page int, page_end int, file_type string, prefix string")
    got = assembly.build(df, "q", "learning", 500).first()
    assert got.context.startswith("## DEFINITION\n[C | ch | Slide 1]\nA thing") and "## EXAMPLE" in got.context and got.context.index("EXAMPLE") < got.context.index("ADDITIONAL")
    assert got.chunks_used == 3 and got.sections == "definition,example,general" and got.citations.count(";") == 2


def _packed(text, most):
    done, cur = [], []
    if len(text) // 4 <= most:
        return [text]
    for s in _sentences(text):
        n = len(s) // 4
        if n > most:
            done += [" ".join(cur)] * bool(cur) + [s[i : i + most * 4].strip() for i in range(0, len(s), most * 4)]
            cur = []
        elif sum(len(x) // 4 for x in cur) + n <= most:
            cur.append(s)
        else:
            done, cur = done + [" ".join(cur)], [s]
    return done + [" ".join(cur)] * bool(cur)


def test_sentence_packing(spark):
    texts = ["", "One.", "One. Two! Three? " * 30, "y" * 333 + ". Short. " + "z" * 100, "No end " * 40]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    for most in (1, 7, 20):
        assert [[x.strip() for x in r["p"]] for r in df.select(ingest.packed(F.col("text"), most).alias("p")).collect()] == [[x.strip() for x in _packed(t, most)] for t in texts]


def test_answers(spark):
    df = spark.createDataFrame([(1, "A cat sat. Dogs flew away.", "the cat sat here"), (2, "", "x"), (3, "Word.", None)], "id long, answer string, context string")
    assert {r["id"]: r["faithfulness"] for r in answers.faithfulness(df).collect()} == {1: 0.5, 2: None, 3: None}
    row = df.limit(1).select(answers.clean(F.lit("<think>a</think>One two three"), 10).alias("cut"), answers.json_in(F.lit('x {"a": [1,],} y')).alias("json"), answers.json_in(F.lit("none")).alias("none")).first()
    assert tuple(row) == ("One two...", '{"a": [1]}', None)


def test_sub_queries_and_report(spark):
    q = spark.createDataFrame([(1, "cats and dogs; birds"), (2, None), (3, "one")], "id long, text string")
    assert sorted(tuple(r) for r in expansion.sub_queries(q, ["id"], 10).collect()) == [(1, 0, "cats", 3), (1, 1, "dogs", 3), (1, 2, "birds", 3), (3, 0, "one", 10)]
    empty = spark.createDataFrame([], "score double, answerable boolean, citations long")
    assert evaluation.report(empty).first()["passed"] is False
    assert "| mean | n/a |" in evaluation.markdown(spark, evaluation.report(empty))
