"""Joins whose sides grow with the input are not broadcast by the size of compressed files."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from fathomline.llm import components, line_dedup, near_dedup, simhash, toxicity
from fathomline.llm.common import cut

ROWS = [(k, f"some words of a text that stands here for number {k // 3} and goes on for a while") for k in range(30)] + [(40, None), (41, ""), (41, "")]


def _plans(monkeypatch, *modules):
    seen = []

    def noted(df, *more, **named):
        seen.append(df._jdf.queryExecution().sparkPlan().toString())
        return cut(df, *more, **named)

    for m in modules:
        monkeypatch.setattr(m, "cut", noted)
    return seen


def test_simhash_ships_no_growing_table(spark, monkeypatch):
    """F1."""
    seen = _plans(monkeypatch, simhash, components)
    out = simhash.near_duplicates(spark.createDataFrame(ROWS, "doc_id bigint, text string"))
    seen.append(out._jdf.queryExecution().sparkPlan().toString())
    assert out.count() == len(ROWS) and sum("SortMergeJoin" in p for p in seen) > 5
    assert not [p for p in seen if "Broadcast" in p]


def test_near_dedup_ships_no_growing_table(spark, monkeypatch):
    """the pipeline's stage takes the same steps."""
    seen = _plans(monkeypatch, near_dedup, simhash, components)
    out = near_dedup.keep_one(spark.createDataFrame(ROWS, "doc_id bigint, text string"))
    seen.append(out._jdf.queryExecution().sparkPlan().toString())
    assert {r.doc_id for r in out.collect()} == {*range(0, 30, 3), 40} and not [p for p in seen if "Broadcast" in p]


def test_toxicity_holds_its_sample_as_numbers(spark):
    """Pipeline: a Python object for each of 640,000 terms of this sample takes more than 20 MB of the driver."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(400)]
    texts = [(i, " ".join(rng.sample(words, 160)) + " vile" * (i % 5 == 0)) for i in range(1250)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in texts], "doc_id bigint, toxic int")
    tracemalloc.start()
    try:
        model = toxicity.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20e6 and model.score(b"vile") > 0.5 > model.score(texts[1][1].encode())


def test_toxicity_orders_its_sample_as_lists_do():
    best = np.array([3, 5, 256, 70_000, 1 << 19])
    rows = [(1, [3, 256]), (0, [5]), (1, [3]), (0, []), (0, [3, 70_000]), (1, [3, 256]), (0, [3, 256, 1 << 19]), (2, [])]
    # more than one chunk, as Spark hands them over
    schema = pa.schema([("y", pa.int32()), ("terms", pa.list_(pa.int64()))])
    got = pa.concat_tables([pa.Table.from_pylist([{"y": y, "terms": t} for y, t in part], schema) for part in (rows[:3], rows[3:])])
    lists, y = toxicity._sample(got, best)
    assert [[int(best[i]) for i in r] for r in lists] == [t for _, t in sorted(rows)] and list(y) == [0] * 4 + [1] * 3 + [0]


def test_line_dedup_compiles_what_need_not_be_interpreted(spark):
    """op6_line_dedup: Spark interprets what a transform reads, so repeats and empty words are removed outside of it."""
    docs = spark.createDataFrame([(1, "b A  a b\n\nB"), (2, None)], "doc_id bigint, text string")
    lines = line_dedup._lines(docs, [0, 1, 2], "doc_id", "text")
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and not re.search(r"transform\(array_(remove|distinct)", plan)
    assert {(r.id, r.line_no): len(r.tokens) for r in lines.collect()} == {(1, 0): 2, (1, 2): 1}


def test_line_dedup_interprets_pairs_of_common_tokens_only(spark, monkeypatch):
    """op6_line_dedup: an array for each single token of a prefix was made by interpreted code, and the words of a line were stored."""
    seen = _plans(monkeypatch, line_dedup)
    monkeypatch.setattr(line_dedup, "HOT", 1)
    twice = "the same seven words and a repeated word word"
    docs = spark.createDataFrame([*ROWS, (50, f"{twice}\n\n"), (51, f"  {twice.upper()} more \nx"), (52, "\n")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.digest(docs).collect()}
    assert seen and not [p for p in seen if "explode(CASE WHEN" in p or "array_distinct(array_remove(split(lower" in p and "size(array_distinct" not in p]
    assert got[40] == (0, 0) and got[41] == (1, 0) and got[50] == (3, 0) and got[51] == (2, 1) and got[52] == (2, 0)
    assert sum(n for i, (_, n) in got.items() if i < 40) == 29
