"""Toxicity, language identification, Katz scoring and extraction."""

import math
import random
import resource
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from heliograph.llm import html_extraction, language_id, lm_scoring, toxicity
from pyspark.sql import functions as F

from .fixtures import empty, messy, messy_rows


def train_rows(n=400):
    r = random.Random(3)
    plain = ["".join(r.choice("lmnop") for _ in range(4)) for _ in range(200)]
    rows = []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(3, 40))]
        if bad := i % 4 == 0:
            words.insert(r.randrange(len(words)), r.choice(["vileword", "nastyone"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_learns_and_holds_out(spark):
    rows = train_rows()
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    truth = {r[0]: r[2] for r in rows}
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(got) == len(rows) and len(held) > 40
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    sample = toxicity.labelled_sample(docs, labels, most_per_class=10)
    assert sample.count() == 20


def test_toxic_share_is_that_of_all_labels(spark):
    """Below the bound on the sample, with one class at it, and with both: the same score."""
    docs = spark.createDataFrame([(i, "same words") for i in range(400)], "doc_id long, text string")
    labels = [(i, int(i % 8 == 0)) for i in range(400)]
    learnt = [t for i, t in labels if zlib.crc32(str(i).encode()) % 5]
    for most in (8000, 100, 20):
        got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), most_per_class=most).first()
        assert abs(got["score"] - sum(learnt) / len(learnt)) < 0.01 and got["predicted"] == 0


def exclusive_rows(n=1500, fill=20):
    """Toxic if both or neither of two words occur: no word tells anything by itself."""
    r, rows = random.Random(1), []
    for i in range(n):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = [f"w{r.randrange(200)}" for _ in range(fill)] + ["aye"] * a + ["bee"] * b
        r.shuffle(words)
        rows.append((i, " ".join(words), int(a == b)))
    return rows


def test_interactions_of_terms_that_are_neutral_alone(spark):
    """The whole operator, and its scores against the machine's formula summed pair by pair."""
    rows = exclusive_rows()
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    truth = {r[0]: r[2] for r in rows}
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 200 and sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.95
    machine = toxicity.train(toxicity.labelled_sample(docs, labels))
    for i, text, _ in rows[:40]:
        x = sorted({machine.index[t] for w in set(text.split()) for t in toxicity.terms(w, machine.bits) if t in machine.index})
        raw = machine.bias + sum(machine.w[j] for j in x) + sum(float(machine.v[j] @ machine.v[k]) for n, j in enumerate(x) for k in x[n + 1 :])
        assert math.isclose(got[i]["score"], 1 / (1 + math.exp(-raw)), rel_tol=1e-6, abs_tol=1e-9)


def test_toxic_rows_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "fine words", 0.5), (2, "fine words", 0.7)], "doc_id long, text string, __toxicity double")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(r["__toxicity"] for r in kept.collect()) == [0.5, 0.7]


def test_toxicity_of_messy_tables(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, 0), (8, None), (12, 1), (4, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(messy(spark), labels).collect()
    assert len(got) == len(messy_rows()) and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.toxicity(messy(spark), labels.limit(0)).collect()
    assert all(r["score"] < 1e-20 and r["predicted"] == 0 for r in none)
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    kept = toxicity.without_toxic(messy(spark), labels)
    assert kept.columns == messy(spark).columns


def phrases(text, learned):
    """Greedy longest matches, by search."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in learned:
            size += 1
        n, at = n + 1, at + size
    return n


@pytest.mark.parametrize("stretch,cells", [(1000, 1 << 22), (7, 1 << 22), (256, 1 << 22), (16, 0)])
def test_cross_parsing_counts(stretch, cells):
    """Whole texts, in one stretch and in many, with tables and with sorted transitions; periodic texts never meet the first run."""
    r = random.Random(5)
    learned = ["".join(r.choice("abc") for _ in range(300)), "".join(r.choice("abd") for _ in range(200)), "ab" * 150, "a" * 90]
    t = language_id.Tables([language_id.normalised(x) for x in learned], cells)
    texts = ["".join(r.choice("abcde") for _ in range(n)) for n in (1, 2, 50, 120, 700, 2000)] + ["ab" * 500, "a" * 777, "ab ab" * 90]
    assert t.phrases([language_id.normalised(x) for x in texts], stretch).tolist() == [[phrases(x, y) for y in learned] for x in texts]


def test_cross_parsing_of_many_letters():
    """3 000 letters: 40 000 symbols take well under a gigabyte, and parse like the brute parser."""
    r = random.Random(6)
    learned = "".join(chr(0x4E00 + min(2999, int(r.expovariate(1 / 500)))) for _ in range(40_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    t = language_id.Tables([language_id.normalised(learned)])
    text = learned[500:900] + "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(100))
    assert t.phrases([language_id.normalised(text)], 64).tolist() == [[phrases(text, learned)]]
    assert t.automata[0].table is None and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_language_prediction(spark):
    r = random.Random(2)
    make = {"xx": "abcdef", "yy": "cdefgh"}
    rows = [(i, " ".join("".join(r.choice(make[k]) for _ in range(4)) for _ in range(25)), k) for i in range(200) for k in [r.choice(["xx", "yy"])]]
    docs = spark.createDataFrame([*rows, (900, "123 !?", "xx"), (901, None, "yy"), (902, "", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.language_samples(docs)).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert sum(got[i]["lang_pred"] == k for i, _, k in held) / len(held) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))


def test_language_of_messy_tables(spark):
    docs = messy(spark)
    got = language_id.identify(docs, language_id.language_samples(docs)).collect()
    assert len(got) == len(messy_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert language_id.language_samples(empty(spark)) == []
    assert {r["lang_pred"] for r in language_id.identify(docs, []).collect()} == {"und"}


def katz(rows, trained, k=5):
    tok = [t.encode().lower().split() + [b"\n"] if t else [b"\n"] for _, t in rows]
    c1 = Counter(w for t, h in zip(tok, trained) if h for w in t)
    c2 = Counter(p for t, h in zip(tok, trained) if h for p in zip([None, *t[:-1]], t))
    kinds = lambda c: np.array([0] + [sum(v == r for v in c.values()) for r in range(1, k + 2)])
    n, v = sum(c1.values()), len(c1)
    u1, d = lm_scoring.Unigrams.of(n, v, kinds(c1), k), lm_scoring.discounts(kinds(c2), k)
    p1 = lambda w: float(u1.p(np.array([c1.get(w, 0)]))[0])
    ctx = defaultdict(dict)
    for (a, b), r in c2.items():
        ctx[a][b] = r

    def p(b, a):
        if a not in ctx:
            return p1(b)
        mass, total = sum(d[min(r, k + 1)] * r for r in ctx[a].values()), sum(ctx[a].values())
        div = total + 1 if total - mass <= 1e-9 * total else total
        if b in ctx[a]:
            return d[min(ctx[a][b], k + 1)] * ctx[a][b] / div
        return (1 - mass / div) / (1 - sum(map(p1, ctx[a]))) * p1(b)

    for a in [*ctx][:5] + ["never"]:
        assert sum(p(w, a) for w in [*c1, "never"]) == pytest.approx(1) if c1 else True
    out = []
    for (i, _), t in zip(rows, tok):
        base = sum(math.log10((c1.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        out.append((i, len(t), sum(w in c1 for w in t), n, base, sum(math.log10(p(b, a)) for a, b in zip([None, *t[:-1]], t))))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_katz_against_brute_force(spark, small):
    docs = messy(spark).where("coalesce(doc_id, 0) <> 6")
    rows = [r[:2] for r in messy_rows() if r[0] != 6]
    sizes = {"chunk_tokens": 300, "part_tokens": 100} if small else {}
    got = lm_scoring.katz_scores(docs.withColumn("held", F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))), "held", **sizes).collect()
    want = katz(rows, [(i or 1) % 3 != 0 for i, _ in rows])
    key = lambda x: (x[0] or -1, x[1], round(x[4], 6))
    got = sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got], key=key)
    want = sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want])


def test_katz_without_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").withColumn("held", F.lit(True))
    got = {r["doc_id"]: r for r in lm_scoring.katz_scores(docs, "held").collect()}
    assert got[1]["score"] == 0 and got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0 and got[2]["n_tokens"] == 1
    assert lm_scoring.katz_scores(docs.limit(0), "held").count() == 0


def test_sum_product_is_exact():
    rng = np.random.default_rng(0)
    parent = np.array([-1, 0, 0, 1, 1, 2, -1, 6])
    unary, pair = rng.normal(size=8), rng.normal(size=(2, 2))
    marginal, joint = html_extraction.sum_product(parent, unary, pair)
    total, one, both = 0.0, np.zeros(8), np.zeros((8, 2, 2))
    for s in product((0, 1), repeat=8):
        w = math.exp(sum(unary[i] * s[i] for i in range(8)) + sum(pair[s[p], s[i]] for i, p in enumerate(parent) if p >= 0))
        total += w
        for i, p in enumerate(parent):
            one[i] += w * s[i]
            if p >= 0:
                both[i, s[p], s[i]] += w
    assert np.allclose(marginal, one / total) and np.allclose(joint[parent >= 0], (both / total)[parent >= 0])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="site-header"><div>Site name</div><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies. <button>OK</button></div><!-- <p>hidden</p> -->
<article><h1>Title &amp;  more</h1><p>First   paragraph of the text, with an <a href="/x">inner link</a> &lt;tag&gt; &eacute;.<p>Second one
over two lines, long enough to be read as a paragraph.</p><div class="ad">Buy now cheap things</div><ul><li>Point one of it.</li><li>Point two of it.</li></ul></article>
<div class="comments"><h3>Comments</h3><div class="comment"><p>I like this text a lot, said a reader of it.</p></div></div>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/q">Other story</a></li></ul></aside><form><label>Name</label><input><select><option>A</select></form>
<footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""


def test_extraction(spark):
    text = html_extraction.extract([PAGE], html_extraction.train())[0]
    assert text == "Title & more\nFirst paragraph of the text, with an inner link <tag> é.\nSecond one over two lines, long enough to be read as a paragraph.\nPoint one of it.\nPoint two of it."


def test_extraction_of_odd_pages(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    odd = [None, "", "plain text", "<p>un<b>closed", "</p></div>stray", "<", "a < b <3", "<script>never closed", "<!-- never", deep, "<p>" + "word " * 100_000, "<article><p>x</article></article><p>", "<ul><li>a<li>b</ul>", "<a href='>'>q</a>"]
    pages = spark.createDataFrame([(i if i else None, f"u{i}", h) for i, h in enumerate(odd)], "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = html_extraction.main_text(pages.union(pages)).collect()
    assert len(got) == 2 * len(odd) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extraction.main_text(pages.limit(0)).count() == 0
    for h in odd:
        t = html_extraction.parse(h)
        assert all(p < i for i, p in enumerate(t.parent))
