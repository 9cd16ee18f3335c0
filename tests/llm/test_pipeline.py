"""Stages of the pipeline, each by itself, on odd tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"token{i}" for i in range(30_000))
PLAIN = "a quiet text about rivers and the towns that stand along them in the north of the land"
ROWS = [
    (1, PLAIN, "en", "a"), (1, PLAIN, "en", "a"), (2, PLAIN + " today", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n\t\n", "en", "b"),
    (None, "no id at all in this row of text", "en", "a"), (None, None, None, None), (6, LONG, "en", "c"), (7, f"{PLAIN}\nown line of seven\n{PLAIN}", "en", "a"),
]
#: Extra columns whose names the operators use themselves.
NAMES = ["n_words", "row_key", "row_again", "gone", "rk", "fp", "key", "text2", "id", "row", "doc", "k", "at"]
SCHEMA = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{n} int" for n in NAMES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *range(i, i + len(NAMES))) for i, r in enumerate(ROWS)], SCHEMA).repartition(3)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, docs, name, stage):
    out = stage(spark, docs, SF)
    if name == "bpe":
        assert {r.doc_id: r.n_tokens for r in out.collect()}[3] == 0 and out.count() == len(ROWS)
        return
    assert out.columns == docs.columns
    rows = out.collect()
    kept = [(r.doc_id, r.text) for r in rows]
    if name == "toxicity":
        assert len(kept) == len(ROWS)
    elif name == "line_dedup":
        texts = dict(kept)
        assert len(kept) == len(ROWS) and texts[3] is None and texts[4] == "" and texts[5] == " \n\t\n" and texts[6] == LONG
        assert texts[1] == PLAIN and texts[2] == "" and texts[7] == "own line of seven"
    elif name == "simhash_near_dedup":
        ids = [i for i, _ in kept]
        # the least id of each group stays, a null id being the least; empty texts are one group
        assert sorted(i for i in ids if i is not None) == [1, 6, 7] and ids.count(None) == 2
    else:
        assert len(kept) == len(ROWS)
    assert all(len({r[n] - r["n_words"] for r in rows}) == 1 for n in NAMES)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, docs, name, stage):
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "bpe"]


def test_run_follows_the_stages(spark):
    whole = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in docs.collect())
    assert 0 < whole.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
