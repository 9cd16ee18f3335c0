"""Cases of review findings: small inputs on which the code was wrong before."""

import datetime
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.functions import vectors as V
from fathomline.operators import ingest, metrics


def test_usage_takes_the_nearest_second(spark):
    at = lambda s: datetime.datetime(2024, 3, 10, 2, 0, 0) + datetime.timedelta(seconds=s)
    rows = [(1, 7, at(0.2), 1.0), (2, 7, at(60.6), 10.0), (3, 7, at(120.5), 100.0), (4, 7, at(180.4), 1000.0)]
    df = spark.createDataFrame(rows, "id long, user_id long, ts timestamp_ntz, total_time_ms double")
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):  # the hour from 2 on is skipped there
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = {r.id: (r.requests, r.used) for r in metrics.usage(df).collect()}
            # seconds 0, 61, 120, 180
            assert got == {1: (1, 1.0), 2: (1, 10.0), 3: (2, 110.0), 4: (2, 1100.0)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_sentences_end_at_the_white_space_of_the_sql(spark):
    """Only space, tab, line feed, form feed and return end a sentence; pieces are trimmed of spaces only."""
    sentences = "One.\x0bTwo.\u00a0Three. Four.\x01Five"
    long = "x" * 2046 + "\t\u2003" + "y" * 10
    df = spark.createDataFrame([(1, sentences), (2, long), (3, "word " * 500 + ". \u00a0")], "doc_id bigint, text string")
    got = {r.doc_id: (r.s, r.p) for r in df.select("doc_id", T.sentences(F.col("text")).alias("s"), ingest.packed(F.col("text")).alias("p")).collect()}
    assert got[1][0] == ["One.\x0bTwo.\u00a0Three.", "Four.", "Five"]
    assert got[2][1] == ["x" * 2046 + "\t\u2003", "y" * 10]
    assert got[3][1][-1] == "\u00a0"
    parts = {d: [r.content for r in ingest.chunks(df).where(F.col("doc_id") == d).orderBy("chunk_id").collect()] for d in (2, 3)}
    assert parts == {d: got[d][1] for d in (2, 3)}


def test_rounding_in_binary(spark):
    df = spark.createDataFrame([(56.5, 0.56), (28.5, 0.28), (14.5, 0.14), (-56.5, -0.56), (12.5, 0.13), (50.0, 0.5), (None, None)], "value double, want double")
    assert all(r.got == r.want for r in df.select("want", T.rounded(F.col("value") / 100, 2).alias("got")).collect())


def test_scores_of_a_model_as_the_sql_has_them(spark, tmp_path):
    from fathomline.plans import ranking

    spark.createDataFrame([(0, 56.5), (6, None), (12, 250.0)], "event_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.scores for r in ranking.r13_model_scores(spark, str(tmp_path)).collect()}
    assert got == {0: "0.56,0.5,1.0,0.0", 6: "1.0,0.5,1.0,0.0", 12: "1.0,0.5,1.0,0.0"}


def test_learned_weights_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Rows 100 and 101 have one order and number; the update at the 100th sees one of them."""
    from fathomline.plans import ranking

    rows = [(1, i, 1, float(i % 7), i % 3 / 10, i % 4 / 100) for i in range(1, 100)] + [(1, 100, 1, 50.0, 0.9, 0.1), (1, 100, 1, 1.0, 0.0, 0.5)]
    out = []
    for k, some in enumerate((rows, rows[::-1])):
        spark.createDataFrame(some, "l_suppkey bigint, l_orderkey bigint, l_linenumber bigint, l_quantity double, l_discount double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        out.append(ranking.c15_learned_weights(spark, f"{tmp_path}/{k}").collect())
    assert out[0] == out[1]


def _batch(ids, vectors):
    values = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(ids), values], names=["vec_id", "embedding"])


def test_nearest_holds_tiles_and_not_all_scores():
    """3,000 queries meet 10,000 vectors, half of them copies of one: all scores at once would be 240 MB."""
    draw = np.random.default_rng(1)
    v = draw.normal(size=(10_000, 8))
    v[draw.permutation(10_000)[:5000]] = v[0]
    own, q, k = draw.permutation(10_000).astype(np.int64), v[:3000].copy(), 7
    norm = np.sqrt((q**2).sum(axis=1))
    batches = [_batch(own[a : a + 5000], v[a : a + 5000]) for a in (0, 5000)]
    tracemalloc.start()
    out = pa.Table.from_batches(list(V.scan(batches, np.arange(3000), q, norm, k)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    got = {}
    for query, vec in zip(out["query_id"].to_pylist(), out["vec_id"].to_pylist(), strict=True):
        got.setdefault(query, []).append(vec)
    for i in range(0, 3000, 61):
        scores = np.round(q[i] @ v.T / (norm[i] * np.sqrt((v**2).sum(axis=1)) + 1e-6), 9)
        assert got[i] == own[np.lexsort((own, -scores))[:k]].tolist()


def test_embedding_makes_a_word_an_object_once(spark):
    """Words of a batch repeat; counts stay what they were, also of batches that are slices."""
    df = spark.createDataFrame([(1, "Red red GREEN"), (2, ""), (3, "green"), (4, None), (5, "red " * 1000)], "id bigint, text string")
    got = {r.vec_id: r.embedding for r in V.embed(df, "id", F.col("text")).collect()}
    want = {i: [sum(V._dimension(w) == d for w in words) for d in range(V.DIM)] for i, words in {1: ["red", "red", "green"], 3: ["green"], 5: ["red"] * 1000}.items()}
    assert got == want


def test_language_is_calibrated_on_every_training_text(spark):
    """2,400 usable texts: limits and slope are those of all of them."""
    from fathomline.llm import language

    draw = np.random.default_rng(3)
    text = lambda i: " ".join("".join(chr(97 + c) for c in draw.integers(0, 26 if i % 2 else 9, 4)) for _ in range(1 + i % 5))
    rows = [(i, text(i), "aa" if i % 2 else "bb") for i in range(3200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    usable = df.where(language.crc_mod("doc_id", language.FOLDS) != language.HOLD_OUT).collect()
    assert len(usable) > 2000
    model = language.train(df)
    h = model.entropies([r.text for r in usable])
    truth = np.array([model.languages.index(r.lang) for r in usable])
    own = h[np.arange(len(h)), truth]
    want = [own[truth == k].mean() + 4 * own[truth == k].std() + 0.1 for k in range(2)]
    np.testing.assert_allclose(model.limits, want, rtol=1e-9)

    def loss(slope):
        z = -slope * (h - h.min(axis=1, keepdims=True))
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean()

    assert model.slope == min(language.SLOPES, key=loss)


def test_pipeline_takes_candidates_of_simhash(spark, monkeypatch):
    """Where MinHash finds nothing SimHash still proposes; what the Jaccard does not confirm stays apart."""
    import corpus_pipeline
    from fathomline.llm import near_dedup, simhash

    far = lambda a, b: bin(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).count("1")
    base = " ".join(f"w{i}" for i in range(900))
    near = next(t for t in (f"{base} more{k}" for k in range(99)) if far(base, t) <= simhash.DISTANCE)
    # many repeats of one run outvote the rest of a fingerprint and are few distinct shingles
    run = " ".join(["alpha beta gamma"] * 400)
    a, b = run + " one two three four five six", run + " seven eight nine ten eleven twelve"
    assert far(a, b) <= simhash.DISTANCE
    docs = spark.createDataFrame([(5, base, "en"), (3, near, "en"), (7, a, "en"), (8, b, "en")], "doc_id bigint, text string, lang string")
    monkeypatch.setattr(near_dedup, "links", lambda distinct, texts: distinct.select(F.col("entry").alias("node"), F.col("entry").alias("label")).limit(0))
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()) == [3, 7, 8]
