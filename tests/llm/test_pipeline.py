"""The pipeline's stages, in order, against plain Python."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from heliograph.llm import simhash, toxicity
from heliograph.llm.queries import tokenizer_path
from tokenizers import Tokenizer

from .test_text_rules import LOWER, WORDS, base_rules, brute_hits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(30)) for i in range(4)]
    docs, labels = [], []
    for i in range(130):
        body = text(r.randint(60, 160))
        if i % 4 == 0:
            body += " zork you grue " + text(5) + " zork grue"
        docs.append((i, body + "\nShared  footer LINE", "en", "s1"))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(200, docs[1][1], "en", "s1"), (201, docs[2][1].replace(docs[2][1].split()[20], "qqq"), "en", "s1"), (202, None, None, None), (203, "too short", "en", "s1")]
    docs += [(204, f"{text(50)} {items[0][1]} {text(20)} {items[1][1]}", "en", "s2"), (205, f"{text(60)} {items[2][1]} {text(20)}", "en", "s2"), (206, text(2500), "en", "s3")]
    docs += [(207, "\n".join(["Shared footer line"] * 3 + [text(60)]), "en", "s1"), (208, "same words here " * 30, "en", "s1")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*d, None) for d in docs], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def stages(spark, path, tmp_path):
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        out.append((docs, after))
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_plain_python(spark, tables, tmp_path):
    path, items = tables
    (docs, quality), (_, clean), (_, unique), (_, apart), (_, packed) = stages(spark, path, tmp_path)
    assert all(x.columns == docs.columns for x in (quality, clean, unique, apart))

    # Quality rules: a line in more than 20 documents of a host goes.
    rows, lines = docs.collect(), defaultdict(set)
    norm = lambda x: " ".join(WORDS.findall(x)).translate(LOWER)
    for d in rows:
        for x in (d["text"] or "").split("\n"):
            lines[d["source"], norm(x)].add(d["text"])
    want = {}
    for d in rows:
        body = d["text"] or ""
        b = base_rules(body)
        left = [x for x in body.split("\n") if not (norm(x) and len(lines[d["source"], norm(x)]) > 20)]
        gone = b[0] - sum(len(WORDS.findall(x)) for x in left)
        if b[0] >= 50 and 100 * b[4] <= 50 * b[0] and gone <= b[0] * 0.5:
            want[d["doc_id"]] = "\n".join(left)
    assert texts(quality) == want and not any("footer" in t for t in want.values()) and 208 not in want

    # Toxicity: all pairwise interactions summed one by one.
    machine = toxicity.train(toxicity.labelled_sample(quality, spark.read.parquet(f"{path}/labels.parquet")))
    known = toxicity._Buckets(machine.index, machine.bits)

    def raw(text):
        x = sorted(toxicity.rows_of(text, known))
        return machine.bias + sum(machine.w[i] for i in x) + sum(float(machine.v[i] @ machine.v[j]) for i, j in combinations(x, 2))

    want = {d: t for d, t in want.items() if raw(t) < 0}
    assert texts(clean) == want and not any("zork" in t for t in want.values()) and len(want) > 60

    # Near-duplicates: any of five fingerprints within 6 bits.
    def marks(text, seed):
        w = text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed) for i in range(len(w) - 2)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {d: [marks(t, s) for s in range(42, 47)] for d, t in want.items()}
    up = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(sorted(up), 2):
            if up[a] != up[b] and any((x ^ y).bit_count() <= 6 for x, y in zip(prints[a], prints[b])):
                low = min(up[a], up[b])
                up[a] = up[b] = low
                changed = True
    want = {d: t for d, t in want.items() if up[d] == d}
    assert texts(unique) == want and 200 not in want and 201 not in want and 1 in want and 2 in want

    # Decontamination: two items reject, one is cut out.
    found = brute_hits([*want.items()], items)
    hit = {k[0]: k for k in found}
    got = texts(apart)
    assert set(got) == {d for d in want if hit[d][3] < 2} and 204 not in got and 205 in got
    for d, t in got.items():
        assert len(t.split()) == hit[d][1] - hit[d][2] and (t == want[d]) == (hit[d][2] == 0)

    # Packing: every id once, windows of at most 2048, gapless.
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    size = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in got.items()}
    pieces, by_doc, by_window = packed.collect(), defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["doc_tokens"] == size[p["doc_id"]]
        by_doc[p["doc_id"]].append((p["start"], p["length"]))
        by_window[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(size)
    for spans, most in [*((by_doc[d], size[d]) for d in by_doc), *((w, 2048) for w in by_window.values())]:
        ends = np.cumsum([n for _, n in sorted(spans)]).tolist()
        assert [a for a, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= most
    assert all(sum(n for _, n in by_doc[d]) == size[d] for d in size)

    again = corpus_pipeline.run(spark, path).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, pieces))


@pytest.mark.parametrize("large", [2048, 3])
def test_near_duplicates_share_their_shingles(spark, large, monkeypatch):
    """Of a chain of links, only texts with 0.8 of a kept text's shingles go."""
    monkeypatch.setattr(simhash._apart, "__defaults__", (large, 256))
    r = random.Random(9)
    words, rows = [f"w{r.randrange(10**6)}" for _ in range(300)], []
    for i in range(24):
        rows.append((i, " ".join(words)))
        for _ in range(5):
            words[r.randrange(300)] = f"v{r.randrange(10**6)}"
    rows += [(30, rows[3][1]), (31, rows[9][1]), (None, rows[0][1]), (32, ""), (33, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {t: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in rows for w in [t.split()]}
    kept = []
    for d, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        if not any(not (a := sets[t] | sets[u]) or len(sets[t] & sets[u]) / len(a) >= 0.8 for _, u in kept):
            kept.append((d, t))
    got = simhash.deduplicated(docs, tau=16, seeds=(42,), least_share=0.8)
    assert sorted(map(tuple, got.collect())) == sorted(kept) and 4 < len(kept) < 24
