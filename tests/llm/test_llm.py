"""Training-data operators against brute force and on odd tables."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import bpe, components, decontaminate, html_text, language, license_scan, line_dedup, near_dedup, quality, simhash, token_store, toxicity
from fathomline.llm.queries import tokenizer_path

P = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
TEXTS = [
    (1, f"Intro line here.\n{P}\nThe end of it all.", "en", "a"), (2, f"{P} x\n\n   \nshort", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, "ÉTÉ été Straße ΑΣ\tx\r\n漢字 🙂 a1b2 don't <|endoftext|> !!", "fr", "b"),
    (6, "word " * 3000, "en", "b"), (7, f"Intro line here.\n{P}\nThe end of it all.", "en", "a"), (7, f"Intro line here.\n{P}\nThe end of it all.", "en", "a"), (8, f"Intro line here.\n{P.replace('ten ', 'TEN ')} y\nOther words close this text now.", "de", None), (None, "no id at all", "en", "a"),
    (9, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License. GNU General Public License", "en", "c"), (10, "x" * 5000 + " ### $$$ " + "ab" * 300, "en", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(TEXTS)], SCHEMA + ", n_words int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert rows(bpe.encode(empty, tokenizer_path())) == rows(simhash.near_duplicates(empty)) == rows(token_store.round_trip(empty, tokenizer_path())) == []
    assert rows(decontaminate.decontaminate(empty, items)) == rows(quality.judge(empty)) == rows(line_dedup.dedup_lines(empty)) == rows(license_scan.license_scan(empty)) == []
    assert rows(toxicity.score(empty, toxicity.fit(empty, labels))) == rows(language.identify(empty, language.train(empty))) == rows(simhash.keep_one(empty)) == []


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, text, *_ in TEXTS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(bpe.encode(docs, tokenizer_path(), with_ids=False)) == sorted(want, key=repr)


def test_token_store(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got, start = [], 0
    for i, text, *_ in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        got.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert rows(token_store.round_trip(docs, tokenizer_path())) == sorted(got, key=repr)


def test_random_access():
    ids = np.random.default_rng(0).integers(0, 1 << 20, 5000).astype(np.uint32)
    ids[::3] %= 256
    seg = token_store.Segment(token_store.pack_segment([5, None], [ids[:1234], ids[1234:]]))
    assert seg.doc_ids == [5, None] and (seg.document(1) == ids[1234:]).all()
    at = np.random.default_rng(1).integers(0, 5000, 300)
    assert (seg.get(at) == ids[at]).all() and all(seg.one(int(a)) == ids[a] for a in at)


def test_decontamination(spark, docs):
    items = [(1, P), (22, "three four"), (3, None), (4, "!!"), (5, "ÉTÉ été straße"), (6, P)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    want = []
    for i, text, *_ in TEXTS:
        w, hit, found = words(text), set(), set()
        for item, x in items:
            iw = words(x)
            for s in [iw[k : k + 10] for k in range(max(1, len(iw) - 9))] if iw else []:
                for k in range(len(w) - len(s) + 1):
                    if w[k : k + len(s)] == s:
                        hit |= set(range(k, k + len(s)))
                        found.add(item)
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    assert rows(decontaminate.digest(decontaminate.decontaminate(docs, benchmark))) == sorted(want, key=repr)
    assert decontaminate.clean(docs, benchmark).columns == docs.columns
    assert decontaminate.clean(docs, benchmark).count() == sum(not w[-1] for w in want)


def test_simhash_components(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    marks = [int(base[i % 40]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for i in range(600)]
    parent = list(range(600))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(600):
        for j in range(i):
            if bin(marks[i] ^ marks[j]).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(i, m - (1 << 64) if m >> 63 else m) for i, m in enumerate(marks)], "doc_id bigint, fp bigint")
    got = simhash._classes(df, ("component_id", F.min, "doc_id"))
    found = {r.doc_id: r.component_id for r in df.join(got, F.col("fp") == F.col("fp2")).collect()}
    assert found == {i: find(i) for i in range(600)}


def test_simhash_rows(docs):
    got = {r.doc_id: r for r in simhash.digest(simhash.near_duplicates(docs)).collect()}
    assert got[3].fingerprint == got[4].fingerprint == "0" * 16 and got[3].component_id == got[4].component_id == 3
    assert got[1].component_id == got[7].component_id == 1
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert len(kept) == len(set(kept)) and 7 not in kept and 1 in kept and simhash.keep_one(docs).columns == docs.columns


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    assert {r.node: r.label for r in components.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@pytest.mark.parametrize("hot", [512, 1])
def test_line_dedup(docs, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", hot)  # 1: pairs of tokens as keys, and lists that meet a leader first
    first, lines = {}, []
    order = sorted({(r[0] is not None, r[0] or 0, r[0], r[1]) for r in TEXTS if r[1] is not None})
    for *_, i, text in order:
        for k, line in enumerate(text.split("\n")):
            if s := frozenset(x for x in re.sub("[\t\r\x0b\x0c]", " ", line).lower().split(" ") if x):
                lines.append((i, k, s))
                first.setdefault(s, len(lines))
    classes = sorted(first, key=first.get)
    later = {s for n, s in enumerate(classes) if any(len(s & o) * 5 >= 4 * len(s | o) for o in classes[:n])}
    gone = collections.defaultdict(set)
    for n, (i, k, s) in enumerate(lines, 1):
        if first[s] != n or s in later:
            gone[i].add(k)
    want = {i: None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i]) for i, text, *_ in TEXTS}
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert "fifteen" not in want[8] and "fifteen" not in want[2]


def test_quality(docs):
    want = []
    for i, text, *_ in TEXTS:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cov = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(cov), len(w) < 10 or 100 * len(cov) > 20 * len(w)))
    got = quality.judge(docs)
    assert rows(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(want, key=repr)
    assert not got.where("base_failed and kept").count() and got.where("kept").count()


def test_licenses(docs):
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert got[9].base_labels == "apache,cc-by,gpl,mit" and got[9].n_base == 4 and got[9].first_word == 3
    assert {"apache-2.0", "cc-by-nc-4.0", "mit-notice"} <= set(got[9].labels.split(",")) and got[9].score == 1.0
    assert got[3].n_words == 0 and got[3].first_word is None and got[3].score == 0.0
    a = license_scan.Automaton("a <<opt>> b <<end>> <<alt>> c <<or>> d e <<end>> <<var 2>> f")
    for words, ok in (("a b c f", 1), ("a d e x y f", 1), ("a c x y z f", 0), ("a b f", 0), ("a d f", 0)):
        assert (a.accepts_at([x.encode() for x in words.split()], 0) is not None) == bool(ok), words


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="ad">Buy this thing now please</div>
    <article><header><h1>Head&amp;line</h1></header><p>First  <b>bold</b>\n text.<br>more</p><p>Sec&eacute;nd<p>Third<div class="comments"><p>I like it</p></div></article><aside>side</aside><form>f <input></form><footer>&copy; x</footer>"""
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "plain text only")], "page_id bigint, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    text = "Head&line\n\nFirst bold text. more\n\nSecénd\n\nThird"
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0), 4: ("plain text only", 15)}


def test_held_out_quality(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = toxicity.digest(toxicity.score(d, toxicity.fit(d, labels))).join(labels, "doc_id")
    r = scored.agg(F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false"), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("true")).first()
    assert r.false <= 0.02 and r.true >= 0.5
    named = language.digest(language.identify(d, language.train(d))).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert named.where("lang_pred = lang").count() >= 0.97 * named.count()


def test_language_without_letters(spark, docs):
    got = {r.doc_id: r for r in language.identify(docs, language.train(docs)).collect()}
    assert got[3].lang_pred == got[4].lang_pred == "und" and got[1].lang_pred in {"en", "fr", "de"}
    # shares of all continuations of a seen context sum to one
    keys = np.unique(language.grams(language.codes("abab abba baba abab")), return_counts=True)
    m = language.kneser_ney(*keys)
    some = (np.uint64(keys[0][5]) >> np.uint64(16)) << np.uint64(16)
    total = language._probability(m, some + np.arange(65536, dtype=np.uint64), 4).sum()
    assert abs(total - 1) < 1e-6


def test_quality_fences_follow_the_group(spark):
    """The sketches decide: the same share of symbols is an outlier in one source and usual in the other."""
    plain = [" ".join(f"w{i}x{k}" for k in range(100)) for i in range(300)]
    marked = [t + " #####" for t in plain]
    rows_ = [(i, t, "en", "prose") for i, t in enumerate(plain)] + [(1000, marked[0] + " " + "#" * 25, "en", "prose")]
    rows_ += [(2000 + i, t + " ##" * (i % 20), "en", "tables") for i, t in enumerate(marked)]
    rows_ += [(9000, plain[0] + " " + "y" * 2000, "en", "prose"), (9001, plain[0] + " #####", "xx", "few")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows_, SCHEMA)).collect()}
    assert not got[1000].kept and got[1000].failed == "symbol_share" and 30 / got[1000].word_chars < 0.1
    assert all(got[2000 + i].kept for i in range(300)) and max(r.n_symbols for r in got.values() if r.kept) > 30
    assert all(got[i].kept for i in range(300)) and "mean_word" in got[9000].failed and got[9001].kept


def test_near_dedup_of_the_pipeline(spark):
    """Groups by Jaccard >= 0.8 over 5-word shingles, against brute force; simhash at 3 bits keeps such copies."""
    import corpus_pipeline

    rng = np.random.default_rng(11)
    texts = []
    for _ in range(25):
        w = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(40, 300))]
        texts.append(" ".join(w))
        for edits in (1, 2, 3, 5, 8):
            v = list(w)
            for k in rng.integers(0, len(w), edits):
                v[k] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(v))
    texts += ["", None, " \n", "One two", "one  TWO", texts[0].upper()]
    sets = [set(zip(*((t or "").lower().split()[k:] for k in range(5)))) or {tuple((t or "").lower().split())} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)] + [(0, texts[0], "en", "a")], SCHEMA).repartition(3)
    out = corpus_pipeline.dedup_documents(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(set(label))
    assert len(set(label)) < simhash.keep_one(docs).count()
    assert rows(near_dedup.keep_one(docs.limit(0))) == []


def test_language_keeps_rare_grams(spark):
    """Over a million characters a language: an n-gram seen once stays, and scores as the models say."""
    counts = spark.createDataFrame([("en", int(language.grams(language.codes("abcd"))[3]), 3_000_000), ("en", int(language.grams(language.codes("wxyz"))[3]), 1)], "lang string, gram bigint, n bigint")
    m = language.build(counts)
    assert len(m.grams[-1][0]) == 2
    keys, n = np.sort(language.grams(language.codes("abcd wxyz"))[[3, 8]]), np.array([3_000_000, 1])
    want = np.log(language._probability(language.kneser_ney(keys, n), keys, 4))
    assert np.allclose(m.logs(keys)[:, 0], want, atol=1e-4)
