"""Sharding, quality rules and decontamination against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from heliograph.llm import decontamination, quality_rules, sharding
from pyspark.sql import functions as F

from .fixtures import empty, messy, messy_rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_rules(text):
    text = text or ""
    w = WORDS.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_sharding_laws(spark):
    rows = sharding.interleaved_shards(messy(spark), 8).collect()
    assert len(rows) == len(messy_rows())
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in messy_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    # Any contiguous cut holds each source in its share, to within one row at either end.
    total = Counter(r["stratum"] for r in rows)
    for s in range(8):
        own = Counter(r["stratum"] for r in rows if r["shard"] == s)
        assert all(abs(own[k] - n * sizes[s] / len(rows)) <= 2 for k, n in total.items())
    assert rows == sharding.interleaved_shards(messy(spark), 8).collect() or sorted(map(str, rows)) == sorted(map(str, sharding.interleaved_shards(messy(spark).repartition(3), 8).collect()))


def test_sharding_few_rows_and_none(spark):
    assert sharding.interleaved_shards(empty(spark), 8).count() == 0
    few = sharding.interleaved_shards(messy(spark).where("doc_id < 4"), 8).collect()
    assert sorted(r["shard"] for r in few) == [0, 1, 2] and all(r["slot"] == 0 for r in few)


def test_quality_base_and_lines(spark):
    report = quality_rules.quality_report(messy(spark), line_docs=5, line_share=0.05).collect()
    rows = messy_rows()
    assert len(report) == len(rows)
    host, lines = defaultdict(set), defaultdict(set)
    norm = lambda x: " ".join(WORDS.findall(x)).translate(LOWER)
    for _, text, _, source, _ in rows:
        host[source].add(text or "")
        for x in (text or "").split("\n"):
            if WORDS.search(x):
                lines[source, norm(x)].add(text or "")
    common = {k for k, v in lines.items() if len(v) > 5 and len(v) > 0.05 * len(host[k[0]])}
    assert common
    want = Counter()
    for d, text, _, source, _ in rows:
        b = base_rules(text)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        removed = sum(len(WORDS.findall(x)) for x in (text or "").split("\n") if (source, norm(x)) in common)
        want[(d, *b, removed, failed, not failed and removed <= b[0] * 0.5)] += 1
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["removed_words"], r["base_failed"], r["kept"]) for r in report)
    assert got == want


def test_quality_limit_of_a_large_host_is_bounded(spark):
    """A line in 12 of 60 texts is under half of them, and above ten texts."""
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, body(i) + ("\nThe footer" if i < 12 else ""), "h") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"line_docs": 5, "line_share": 0.5}
    left = lambda **more: sum("footer" in r["text"] for r in quality_rules.apply_quality_rules(docs, **options, **more).collect())
    assert left() == 12 and left(most_line_docs=12) == 12 and left(most_line_docs=10) == 0


def test_quality_applied(spark):
    docs = messy(spark)
    out = quality_rules.apply_quality_rules(docs, line_docs=5, line_share=0.05)
    assert out.columns == docs.columns
    kept = out.collect()
    assert kept and all("Common footer" not in r["text"] for r in kept)
    salted = quality_rules.apply_quality_rules(docs, line_docs=5, line_share=0.05, broadcast_lines=0)
    assert sorted(map(str, salted.collect())) == sorted(map(str, kept))
    assert quality_rules.apply_quality_rules(empty(spark)).count() == 0 and quality_rules.quality_report(empty(spark)).count() == 0


def brute_hits(docs, items, n=8):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1) if w else ():
            windows[tuple(w[a : a + k])].add(i)
    out = Counter()
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if (x := tuple(w[a : a + k])) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[x]
        listed = ",".join(sorted(map(str, found)))
        out[d, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), len(found) >= 2] += 1
    return out


def test_decontamination_report(spark):
    docs = messy(spark)
    texts = {r[0]: r[1] for r in messy_rows()}
    long = texts[6].split()
    items = [(1, " ".join(long[100:130])), (2, "ONE"), (3, "two... WORDS"), (4, None), (5, " .;"), (6, " ".join(long[120:140])), (10, " ".join(long[120:140])), (7, texts[7]), (8, "a b a b a b a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("gram", F.lit(1)).withColumn("k", F.lit(2))
    for options in ({}, {"broadcast_windows": 0, "bits": 64}):
        got = decontamination.per_row(decontamination.decontamination_report(docs, bench, **options)).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == brute_hits([r[:2] for r in messy_rows()], items)
    out = decontamination.decontaminate(docs, bench, min_items=3)
    assert out.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert 6 not in left and left[4] == "" and left[2] == "" and left[1] is None and left[11] == texts[11]
    assert left[9] == " tail"


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.per_row(decontamination.decontamination_report(messy(spark), bench)).collect()
    assert len(got) == len(messy_rows()) and not any(r["n_hit"] or r["contaminated"] for r in got)
    assert decontamination.decontamination_report(empty(spark), bench).count() == 0
