"""Tokens, packing, token files and SimHash."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from heliograph.llm import packing, simhash, token_binary, tokens
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from .fixtures import empty, messy, messy_rows

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def whole(path, text):
    return tokens.loaded(path, path == BYTE).tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Zé\n\t .,'1  ́\x1c<|>sß世\ue000!_"), max_size=40))
def test_chunked_ids_are_exact(text):
    for path in (BYTE, WORD):
        flat, sizes = tokens.loaded(path, path == BYTE).ids([text, "", text])
        ids = whole(path, text)
        assert flat.tolist() == ids * 2 and sizes.tolist() == [len(ids), 0, len(ids)]


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 20)
    t = tokens.ChunkTokenizer(WORD, False)
    for i in range(30):
        text = " ".join(f"word{j}" for j in range(i, i + 9))
        assert t.ids([text])[0].tolist() == whole(WORD, text)
    assert len(t.index) < 40


def expected(path, end):
    return [(r[0], whole(path, r[1]) + [end]) for r in messy_rows()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark):
    got = packing.pack(messy(spark), BYTE).collect()
    want = Counter((d, len(i), crc(i)) for d, i in expected(BYTE, 1))
    # Pieces of each document cover it; documents that share an id are told apart by their sizes.
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"], r["doc_tokens"]].append(r)
    for d, ids in expected(BYTE, 1):
        n = want[d, len(ids), crc(ids)]
        p = sorted(((r["start"], r["length"], r["ids_crc32"]) for r in by[d, len(ids)]))
        assert sum(x[1] for x in p) == n * len(ids)
        for s, m, c in p:
            assert c == crc(ids[s : s + m])
    seq = defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in seq.values():
        at = 0
        for o, m in sorted(p):
            assert o == at
            at += m
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(seq) <= -(-total // 2048) + 1
    assert packing.pack(empty(spark), BYTE).count() == 0


def test_packing_keeps_ids(spark):
    """A null beside an id that no double holds, and ids of another type."""
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "a b"), (None, "c"), (big + 1, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in packing.pack(docs, BYTE).collect()} == {big, None, big + 1}
    named = spark.createDataFrame([("x1", "a b"), (None, "c")], "doc_id string, text string")
    assert {r["doc_id"] for r in packing.pack(named, BYTE).collect()} == {"x1", None}


def test_equal_rows_spread(spark):
    """30 000 rows with no id and no text make several groups, none of them large."""
    docs = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    got = packing.pack(docs, BYTE, group_windows=1).groupBy(F.shiftright("sequence_id", 32)).count().collect()
    assert len(got) > 8 and sum(r["count"] for r in got) == 30_000 and max(r["count"] for r in got) < 4096
    order = token_binary.round_trip(docs, WORD)
    assert order.count() == 30_000 and order.select("start").distinct().count() == 30_000


def test_token_files_take_whole_numbers(spark, tmp_path):
    with pytest.raises(TypeError, match="64-bit"):
        token_binary.write_files(spark.createDataFrame([("x", "a")], "doc_id string, text string"), WORD, str(tmp_path))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_balance(sizes):
    parts = packing.balance(sizes, 100)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in p) <= 100 for p in parts)


def test_differencing_is_near_equal():
    r = random.Random(4)
    sizes = [r.randint(1, 256) for _ in range(800)]
    sums = [sum(sizes[i] for i in p) for p in packing.differencing(sizes, 50)]
    assert max(sums) - min(sums) <= 20
    assert sorted(map(sorted, packing.differencing([8, 7, 6, 5, 4], 2))) in ([[0, 1], [2, 3, 4]], [[0, 2], [1, 3, 4]], [[0, 3], [1, 2, 4]], [[0, 3, 4], [1, 2]], [[0, 4], [1, 2, 3]], [[0, 2, 4], [1, 3]])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 70_000) | st.integers(0, 300), max_size=9), max_size=8))
def test_codec(docs):
    counts = np.array([len(d) for d in docs], np.int64)
    flat = np.array([x for d in docs for x in d], "<u4")
    e = token_binary.encode(flat, counts)
    assert len(e.control) == sum(-(-len(d) // 4) for d in docs)
    assert token_binary.decode(e.control, e.data, counts).tolist() == flat.tolist()


def test_token_files(spark, tmp_path):
    token_binary.write_files(messy(spark), WORD, str(tmp_path), block_tokens=500)
    got = sorted(token_binary.read_files(spark, str(tmp_path)).collect(), key=lambda r: r["start"])
    want = sorted(expected(WORD, 1), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(d, len(i), crc(i)) for d, i in want]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    order = np.frombuffer(spark.read.parquet(f"{tmp_path}/ranks").first()[0], "<u4").tolist()
    c = Counter(x for _, i in want for x in i)
    assert order == sorted(c, key=lambda x: (-c[x], x))
    assert token_binary.round_trip(empty(spark), WORD).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, tau=3):
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    names = sorted(up)
    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= tau:
                up[find(a)] = find(b)
    return {f: find(f) for f in names}


def test_simhash_components(spark):
    got = simhash.near_duplicates(messy(spark)).collect()
    rows = messy_rows()
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = roots(fps)
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[root[f]] = min(r[0], least.get(root[f], r[0]))
    want = Counter((r[0], f, least.get(root[f])) for r, f in zip(rows, fps))
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want
    kept = simhash.deduplicated(messy(spark))
    assert kept.columns == messy(spark).columns and kept.count() == len(set(root.values()))
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.deduplicated(empty(spark)).count() == 0


@pytest.mark.parametrize("block,tau", [(8, 3), (2048, 3), (64, 6)])
def test_links_are_whole(spark, block, tau):
    """Clusters, chains and noise, with groups over and under the block size."""
    r = random.Random(block)
    fps = {r.getrandbits(64) for _ in range(300)}
    for _ in range(5):
        x = r.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
    for b in range(0, 60):
        fps.add((1 << 63) | (1 << b))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = {x["node"] % 2**64: x["root"] % 2**64 for x in simhash.components(simhash.links(df, tau, block=block)).collect()}
    want, groups, mine = roots(fps, tau), defaultdict(set), defaultdict(set)
    for f in fps:
        groups[want[f]].add(f)
        mine[got.get(f, f)].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_plan_thresholds_suffice():
    r = np.random.default_rng(1)
    sample = r.integers(0, 2**63, 500, dtype=np.uint64)
    for n in (100, 10**6, 10**10):
        for tau in (2, 3, 5):
            parts = simhash.plan(sample, n, tau)
            covered = 0
            for mask, t in parts:
                assert covered & mask == 0 and t >= 0
                covered |= mask
            assert sum(t + 1 for _, t in parts) == tau + 1
