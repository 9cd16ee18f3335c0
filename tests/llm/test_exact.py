"""Training-data operators against plain versions of themselves, on fixtures and whole small tables."""

import collections
import hashlib
import html
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fathomline.llm import common, decontaminate, html_text, language, license_scan, line_dedup, quality, simhash, token_store, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(4)


def test_fingerprints_against_plain_bits(spark):
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        if not words:
            return 0
        parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = documents(spark).select("doc_id", "text").collect()
    got = {r.doc_id: r.fingerprint for r in simhash.digest(simhash.near_duplicates(documents(spark))).collect()}
    assert got == {r.doc_id: f"{plain(r.text):016x}" for r in rows}


def test_html_pages_against_plain_blocks(spark):
    def plain(page):
        blocks = re.split(r"</?(?:p|h1)[^>]*>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", re.sub(r"<br[^>]*>", " ", x)))).strip() for x in blocks]
        return "\n\n".join(x for x in blocks if x)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want


PARAGRAPHS = ["The river rose for three days before anyone in the valley thought of leaving.", "Short one.", "On the fourth day the bridge went, and with it the only road that led to the south."]
BARE = f"""<html><body><div>Daily Post</div><ul>{"".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(20))}</ul>
<h1><a href="/self">A flood</a></h1><p>{PARAGRAPHS[0]}</p><div>{PARAGRAPHS[1]}</div><p><a href="/map">See the map of the valley</a></p><p>{PARAGRAPHS[2]}</p>
<div>Share</div><ul>{"".join(f'<li><a href="/more/{i}">Another story {i}</a></li>' for i in range(12))}</ul><p>Weather today</p><ul>{"".join(f'<li><a href="/x{i}">Link {i}</a></li>' for i in range(6))}</ul>
<div>© 2024 Daily Post. All rights reserved.</div></body></html>"""


def test_html_the_distribution_decides():
    """No article, no telling names: surges and dives find the text; without them more would be kept."""
    text = html_text.main_text(BARE)
    assert text == "\n\n".join(["A flood", PARAGRAPHS[0], PARAGRAPHS[1], "See the map of the valley", PARAGRAPHS[2]])
    lines, named = html_text.lines_of(BARE)
    weight = html_text.weights(lines, named)
    assert not named and len(html_text.stretches(weight, surge=0)) > len(html_text.stretches(weight)) == 1
    kept = {lines[i].text for a, b in html_text.stretches(weight, surge=0) for i in range(a, b + 1)}
    assert "Weather today" in kept and "Weather today" not in text and "Section 3" not in kept
    # inside an article too: a lone line far from the text does not surge
    far = "<article><p>" + PARAGRAPHS[0] + "</p>" + "<p><a href=x>linked</a></p>" * 6 + "<p>By us</p></article>"
    assert html_text.main_text(far) == PARAGRAPHS[0]


@pytest.mark.parametrize("tag", ["nav", "footer", "aside", "form"])
def test_html_odd_markup(tag):
    assert html_text.main_text(f"<body class='menu'><article class=content><p>One<p>Two &lt;b&gt;</p><{tag}>x</{tag}></article>") == "One\n\nTwo <b>"
    assert html_text.main_text("<p") == "<p" and html_text.main_text("<!-- <p>a</p> -->") == "" and html_text.main_text("a\x00<b>b</b>") == "a\x00b"


def test_licenses_against_plain_search(spark):
    rows = documents(spark).select("doc_id", "text").collect()
    got = {r.doc_id: r for r in license_scan.license_scan(documents(spark)).collect()}
    for r in rows:
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (r.text or "").encode().lower())
        places = collections.defaultdict(list)
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.encode().split()
            places[label] += [i for i in range(len(words)) if words[i : i + len(p)] == p]
        every = sorted(i for x in places.values() for i in x)
        want = (len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(k for k, v in places.items() if v)))
        x = got[r.doc_id]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == want
        assert set(filter(None, want[4].split(","))) <= set(filter(None, x.labels.split(",")))


def test_whole_license_texts():
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
    files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
    publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
    subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
    portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
    THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
    BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
    CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    assert license_scan.scan(mit.encode())["labels"] == "mit,mit-clause"
    assert license_scan.scan(mit.replace("sublicense", "rent").encode())["labels"] == "mit-clause"
    bsd = f"{license_scan._CONDITIONS}: 1. {license_scan._SOURCE}. 2. {license_scan._BINARY}. "
    names, rest = license_scan._NAMES.replace("<<var 12>>", "the holder"), license_scan._NO_WARRANTY.replace("<<var 12>>", "the holder")
    assert license_scan.scan(f"{bsd}{rest}".encode())["labels"] == "bsd-2-clause,bsd-clause"
    assert license_scan.scan(f"{bsd}3. {names}. {rest}".encode())["labels"] == "bsd-3-clause,bsd-clause"
    many = b"mit license " * 20000
    assert license_scan.scan(many)["n_base"] == 20000 and license_scan.scan(many)["last_word"] == 39998


def test_decontamination_in_blocks(spark, monkeypatch):
    docs = documents(spark).unionByName(documents(spark).limit(5))
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    order = ["doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated"]
    one = sorted(map(repr, decontaminate.decontaminate(docs, items).select(order).collect()))
    kept = sorted(map(repr, decontaminate.clean(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 200)
    assert len(list(decontaminate._blocks(items, 10, "item_id", "text"))) > 2
    assert sorted(map(repr, decontaminate.decontaminate(docs, items).select(order).collect())) == one
    assert sorted(map(repr, decontaminate.clean(docs, items).collect())) == kept
    assert decontaminate._joined([0, 3, 2, 5, 9, 10]) == 6 and decontaminate._spans(np.array([1, 1, 0, 1], bool)) == [0, 2, 3, 4]


def test_factorization_machine_against_plain_sums():
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(30)]
    buckets = sorted(set().union(*(toxicity.term_buckets(w.encode()) for w in words)))
    m = toxicity.Model({b: i for i, b in enumerate(buckets)}, 0.3, rng.normal(0, 1, len(buckets)), rng.normal(0, 0.5, (len(buckets), toxicity.RANK)))
    for n in (0, 1, 7, 30):
        text = " ".join(words[:n]).encode()
        on = sorted({m.columns[b] for w in words[:n] for b in toxicity.term_buckets(w.encode())})
        z = 0.3 + sum(m.weights[i] for i in on) + sum(float(m.vectors[i] @ m.vectors[j]) for k, i in enumerate(on) for j in on[:k])
        assert abs(m.score(text) - 1 / (1 + math.exp(-z))) < 1e-9


def test_pairs_that_single_terms_do_not_tell(spark):
    """Toxic where exactly one of two words stands: no weight of a word alone can tell."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join([f"w{rng.randrange(400)}" for _ in range(8)] + ["xaaaa"] * a + ["ybbbb"] * b), "en", "a"))
        labels.append((i, 0, int(a != b)))
    docs, table = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.digest(toxicity.score(docs, toxicity.fit(docs, table))).join(table, "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() >= 0.95 * got.count()
    assert toxicity.reject(docs, toxicity.fit(docs, table)).columns == docs.columns


def test_kneser_ney_against_plain_counts():
    """The interpolated model as its formula has it, with dictionaries."""
    texts = ["the cat sat on the mat", "a cat and a hat", "that hat"]
    grams = np.concatenate([language.grams(language.codes(t)) for t in texts])
    keys, n = np.unique(grams, return_counts=True)
    model = language.kneser_ney(keys, n)
    seen = [collections.Counter(map(int, grams))]
    for k in (3, 2, 1):
        seen.insert(0, collections.Counter(g & (1 << 16 * k) - 1 for g in seen[0]))

    def p(gram, k):
        if k == 0:
            return 1 / 65536
        counts = seen[k - 1]
        ones, twos = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        same = {g: c for g, c in counts.items() if g >> 16 == gram >> 16}
        rest = p(gram & (1 << 16 * (k - 1)) - 1 if k > 1 else gram, k - 1)
        if not same:
            return rest
        total = sum(same.values())
        return max(counts.get(gram, 0) - d, 0) / total + d * len(same) / total * rest

    some = [int(g) for g in keys[::3]] + [int(keys[0]) ^ 1, int(language.grams(language.codes("zebra"))[3])]
    got = language._probability(model, np.array(some, np.uint64), 4)
    assert np.allclose(got, [p(g, 4) for g in some], rtol=1e-9)
    assert len(set(language.codes("\U00020000\U00020001").tolist())) == 2


def test_quality_fences_against_exact_quantiles(spark):
    """Where the sketches hold all values, a fence is the formula on exact quantiles, leaning by weight."""
    rng = random.Random(9)
    def text(marked):
        return " ".join("w" * rng.randrange(2, 9) + str(k) + "#" * (k < marked) for k in range(60))

    rows = [(i, text(rng.randrange(0, 4 if s == "a" else 30)), "en", s) for i, s in enumerate(["a"] * 150 + ["b"] * 90 + ["c"] * 3)]
    measured = quality.measures(spark.createDataFrame(rows, SCHEMA))
    fences = {r.group_source: r for r in quality.thresholds(measured).collect()}
    taken = [(r.source, r.n_symbols / max(r.word_chars, 1), r.word_chars / r.n_words) for r in measured.collect()]

    def fence(values, least, share):
        values = sorted(values)
        at = lambda x: values[max(0, math.ceil(x * len(values)) - 1)]
        spread = max(at(0.75) - at(0.25), least, at(0.9) - at(0.5) if share else 0)
        return at(0.75) + 4 * spread, at(0.25) - 4 * spread

    def lean(own, wider, n):
        return (own * n + wider * quality.PRIOR) / (n + quality.PRIOR)

    for source, n in (("a", 150), ("b", 90), ("c", 3)):
        for k, name, least, share in ((1, "symbol_share", 0.01, True), (2, "mean_word", 0.1, False)):
            own, lang = fence([x[k] for x in taken if x[0] == source], least, share), fence([x[k] for x in taken], least, share)
            assert fences[source][f"high_{name}"] == pytest.approx(math.exp(lean(math.log(own[0]), math.log(lang[0]), n)), rel=0.05)
            if not share:
                assert fences[source][f"low_{name}"] == pytest.approx(lean(own[1], lang[1], n), rel=0.05)
    assert fences["a"].high_symbol_share < fences["c"].high_symbol_share
    # the same text is kept in one group and not in the other
    same = text(25)
    docs = spark.createDataFrame([*rows, (1000, same, "en", "a"), (1001, same, "en", "b")], SCHEMA)
    assert {r.doc_id: r.kept for r in quality.judge(docs).where("doc_id >= 1000").collect()} == {1000: False, 1001: True}


def test_random_access_reads_few_blocks():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 1 << 17, 200_000).astype(np.uint32)
    seg = token_store.Segment(token_store.pack_segment([1], [ids]))
    for n in (1, 40, 5000, 200_000):
        at = rng.integers(0, len(ids), n)
        assert (seg.get(at) == ids[at]).all()


def test_line_dedup_on_whole_tables(spark):
    """Removed lines of the 0.01 documents against a plain inverted index."""
    docs = documents(spark)
    texts = sorted({(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.text is not None})
    first, lines = {}, []
    for i, text in texts:
        for k, line in enumerate(text.split("\n")):
            if s := frozenset(x for x in re.sub("[\t\r\x0b\x0c]", " ", line).lower().split(" ") if x):
                lines.append((i, k, s))
                first.setdefault(s, len(lines))
    count = collections.Counter(w for s in first for w in s)
    index, later = collections.defaultdict(list), set()
    for s in sorted(first, key=first.get):
        tokens = sorted(s, key=lambda w: (count[w], w))
        prefix = tokens[: len(s) - math.ceil(len(s) * 0.8 - 1e-9) + 1]
        if any(len(s & o) * 5 >= 4 * len(s | o) for o in {o for w in prefix for o in index[w] if 4 * len(s) <= 5 * len(o) <= 6.25 * len(s) + 1e-9}):
            later.add(s)
        for w in prefix:
            index[w].append(s)
    want = collections.Counter(i for n, (i, k, s) in enumerate(lines, 1) if first[s] != n or s in later)
    got = {(r.id): len(r.gone) for r in line_dedup.removals(docs).collect()}
    assert got == dict(want)


def test_shared_folder(spark):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()
        sparkContext = type("S", (), {"master": "spark://x"})()

    with pytest.raises(ValueError):
        common.shared_dir(Elsewhere())
    table = common.cut(spark.range(3), "gone")
    common.discard(table)
    with pytest.raises(Exception):  # noqa: B017, PT011
        table.count()


def test_row_keys_tell_nulls(spark):
    rows = spark.createDataFrame([(1, None), (1, ""), (None, "1"), (None, ""), (11, ""), (1, "1")], "id bigint, text string")
    assert rows.select(common.row_key("id", "text")).distinct().count() == 6
    assert hashlib.md5(b"1\x001").hexdigest() in {r[0] for r in rows.select(common.row_key("id", "text")).collect()}
