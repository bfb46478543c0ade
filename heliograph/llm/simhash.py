"""SimHash near-duplicates: fingerprints linked at a few differing bits, and their components.

Linking follows the generalised pigeonhole: the 64 bits are grouped into m
partitions of correlated bits with thresholds t_i that sum to tau - m + 1, and two
fingerprints within tau bits agree to within t_i on some partition i (a threshold
of -1 leaves its partition out). Thresholds need not be equal: dynamic programming
takes those with the least estimated number of candidates, for each m, and the
cheapest m wins. Sample and estimate only steer the cost; links are exact for any choice.

A fingerprint probes each partition with every value within t_i of its own.
Rows that meet at a value are verified on all 64 bits. A value where more than
`block` rows meet is split into blocks, and each pair of blocks is a group of
its own, so no task holds a large group. A dense group emits a spanning forest of its
links. Components come from alternating large-star and small-star rounds, with a
table in the shared folder after each.

With several seeds a text has that many independent fingerprints, each linked by
itself; the links of all make the components.

With `least_share`, deduplication takes components as candidates only. Their texts go in order
of id, and one is left out only if a kept text before it has that share of its five-word
shingles in common, exactly; texts of fewer words have one shingle, texts without words are alike.

Defined results: text without words, null too, has fingerprint zero, which links
like any other; a component whose ids are all null has a null id; repeated rows
each get a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mark, python_workers, released, unused, written

BITS = 64


def prints(text: str | None, shingle: int = 3, seeds: tuple[int, ...] = (42,)) -> list[int]:
    """Signed 64-bit SimHash of the word shingles, repeats included, for each seed of the hash."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: only A-Z, only ASCII white space
    if not words:
        return [0] * len(seeds)
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    shingles = [joined[a : b - 1] for a, b in zip([0, *ends], ends[k - 1 :], strict=False)]
    digest, out = xxhash.xxh64_digest, []
    for seed in seeds:
        h = np.frombuffer(b"".join([digest(x, seed) for x in shingles]), np.uint8).reshape(-1, 8)
        votes = sum(np.unpackbits(h[i : i + (1 << 15)], axis=1).sum(0, dtype=np.int64) for i in range(0, len(h), 1 << 15))
        out.append(int.from_bytes(np.packbits(2 * votes > len(h)).tobytes(), "big", signed=True))
    return out


def fingerprints(docs: DataFrame, *, shingle: int = 3, seeds: tuple[int, ...] = (42,), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, k (hash of id and text), t (hash of the text), fps (a signed long for each seed)."""
    python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [prints(t, shingle, seeds) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "k", "t", "fps"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("k"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, k long, t long, fps array<long>")


def correlated_groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about equal size; a group grows by the bit most correlated with it."""
    spread = bits.std(0)
    z = np.where(spread > 0, (bits - bits.mean(0)) / np.where(spread > 0, spread, 1), 0)
    c = np.abs(z.T @ z) / max(1, len(bits))
    left, out = set(range(BITS)), []
    for g in range(m):
        size = len(left) // (m - g)
        first = max(left, key=lambda i: (c[i, [*left]].sum(), -i))
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(left, key=lambda i: (c[i, group].sum(), -i))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def probes(width: int, t: int) -> int:
    """Values within t bits of one of `width` bits."""
    return sum(_choose(width, k) for k in range(t + 1))


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def plan(sample: np.ndarray, n: int, tau: int, most_t: int = 2, probe_cost: float = 50.0) -> list[tuple[int, int]]:
    """(mask, threshold) of each partition that is probed. sample: distinct fingerprints as uint64.

    Costs are in verified candidates; a probe row costs as much as probe_cost of them.
    """
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(float)
    some = bits[:: max(1, len(bits) // 1500)]
    best: tuple[float, list[tuple[int, int]]] | None = None
    for m in range(2, tau + 2):
        groups = correlated_groups(bits, m)
        costs: list[dict[int, float]] = []
        for g in groups:
            b = some[:, g]
            distance = b @ (1 - b.T) + (1 - b) @ b.T
            pairs = max(1, len(some) * (len(some) - 1))
            of = {-1: 0.0}
            for t in range(min(most_t, tau) + 1):
                near = (np.count_nonzero(distance <= t + 0.5) - len(some)) / pairs
                of[t] = probe_cost * n * probes(len(g), t) + near * n * n / 2
            costs.append(of)
        # Least total cost of thresholds for the first partitions, by their sum.
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for of in costs:
            grown: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, chosen) in table.items():
                for t, extra in of.items():
                    if total + t not in grown or cost + extra < grown[total + t][0]:
                        grown[total + t] = (cost + extra, [*chosen, t])
            table = grown
        if tau - m + 1 in table:
            cost, chosen = table[tau - m + 1]
            if best is None or cost < best[0]:
                best = cost, [(sum(1 << (BITS - 1 - i) for i in g), t) for g, t in zip(groups, chosen, strict=True) if t >= 0]
    if best is None:
        raise ValueError(f"no thresholds reach {tau}")
    return best[1]


def _flips(mask: int, t: int) -> np.ndarray:
    """All patterns of at most t bits inside the mask, none first."""
    bits, out = [1 << i for i in range(BITS) if mask >> i & 1], [0]
    layer = [(0, 0)]
    for _ in range(t):
        layer = [(x | b, j + 1) for x, i in layer for j, b in enumerate(bits[i:], i)]
        out += [x for x, _ in layer]
    return np.array(out, np.uint64)


def probe_rows(fps: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """p, key, fp, own (the key is the fingerprint's own value, not a probe)."""
    flips = [_flips(mask, t) for mask, t in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(at, 20_000).to_numpy().view(np.uint64)
                for p, (mask, _) in enumerate(parts):
                    key = ((fp & np.uint64(mask))[:, None] ^ flips[p]).reshape(-1)
                    k = len(flips[p])
                    own = np.tile(np.arange(k) == 0, len(fp))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), p, np.int32)), pa.array(key.view(np.int64)), pa.array(np.repeat(fp, k).view(np.int64)), pa.array(own)], ["p", "key", "fp", "own"])

    return fps.select("fp").mapInArrow(run, "p int, key long, fp long, own boolean")


def _forest(fp: np.ndarray, own: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Links that connect the rows as all links within tau do; one of each two rows must be `own`."""
    left, out = np.arange(len(fp)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = (np.bitwise_count(fp[left] ^ fp[i]) <= tau) & (own[left] | own[i])
            found = left[near]
            if len(found):
                out += [(i, j) for j in found.tolist()]
                queue += found.tolist()
                left = left[~near]
    return out


def group_links(columns: list[np.ndarray], fp: np.ndarray, own: np.ndarray, tau: int, most_pairs: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of rows, which are sorted by the group columns.

    Every own row is compared with all rows of its group, for all groups at once. Where
    a group has more links than two for each row, it gives a spanning forest instead.
    """
    n = len(fp)
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    group = np.cumsum(new) - 1
    rows = np.flatnonzero(own & (sizes[group] > 1))
    ends = np.cumsum(sizes[group[rows]])
    a, b, at = [], [], 0
    while at < len(rows):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most_pairs, side="right")))
        left, count = rows[at:to], sizes[group[rows[at:to]]]
        right = np.arange(int(count.sum())) + np.repeat(starts[group[left]] - (np.cumsum(count) - count), count)
        left = np.repeat(left, count)
        hit = (np.bitwise_count(fp[left] ^ fp[right]) <= tau) & ((left < right) | ~own[right]) & (fp[left] != fp[right])
        a.append(left[hit])
        b.append(right[hit])
        at = to
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(a), np.concatenate(b)
    dense = np.bincount(group[a], minlength=len(sizes)) > 2 * sizes
    if dense.any():
        keep = ~dense[group[a]]
        more = [np.zeros((0, 2), np.int64)]
        for g in np.flatnonzero(dense):
            s = slice(starts[g], starts[g] + sizes[g])
            more.append(np.array(_forest(fp[s], own[s], tau), np.int64).reshape(-1, 2) + starts[g])
        more = np.concatenate(more)
        a, b = np.concatenate([a[keep], more[:, 0]]), np.concatenate([b[keep], more[:, 1]])
    a, b = fp[a], fp[b]
    return a[a != b], b[a != b]


def links(fps: DataFrame, tau: int = 3, *, block: int = 2048, sample: int = 16_000) -> DataFrame:
    """a, b: links that connect distinct fingerprints (column fp) as all pairs within tau bits do."""
    n = fps.count()
    some = fps.orderBy(F.xxhash64("fp")).limit(sample).collect()
    if n < 2:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    rows = probe_rows(fps, plan(np.array([r["fp"] for r in some], np.int64).view(np.uint64), n, tau))
    hot = rows.groupBy("p", "key").count().where(F.col("count") > block).select("p", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = (
        rows.join(hot, ["p", "key"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("r", F.pmod(F.xxhash64("fp", "own"), F.col("blocks")).cast("int"))
        .withColumn("s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("p", "key", F.least("r", "s").alias("i"), F.greatest("r", "s").alias("j"), "fp", "own")
    )
    keys = ["p", "key", "i", "j"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = group_links(cols[:4], cols[4].view(np.uint64), cols[5], tau)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            # All but the last group of the batch are whole.
            new = np.zeros(len(cols[0]), bool)
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if held and any(h[-1] != c[0] for h, c in zip(held[-1][:4], cols[:4], strict=True)):
                yield found([np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
            if cut:
                yield found([np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols], strict=True)])
                held = []
            held.append([c[cut:] for c in cols])
        if held:
            yield found([np.concatenate(x) for x in zip(*held, strict=True)])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root: the least node of each component, for every node of edges (a, b)."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)

    def state(e: DataFrame) -> tuple[int, int]:
        r = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        return r["n"], int(r["h"])

    before, last = state(edges), mark()
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select("m", F.col("b").alias("v"))
        large = large.where("m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # Small star: each node and its lesser neighbours point to the least of them.
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select("m", "v").union(low.select("m", F.col("u").alias("v"))).where("m < v")
        edges = written(small.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), name)
        now = state(edges)
        released(edges.sparkSession, last - 1, last)  # the round before
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def linked(docs: DataFrame, *, tau: int = 3, shingle: int = 3, seeds: tuple[int, ...] = (42,), doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, k, fps, c of every document; classes c with least id and fps; node and root of the linked classes).

    Texts are linked if the fingerprints of any seed are; more seeds find more of the alike texts.
    """
    marks = fingerprints(docs, shingle=shingle, seeds=seeds, doc_id=doc_id, text=text)
    # Texts with all fingerprints in common are a class, named by the one fingerprint, or by a hash of several.
    marks = written(marks.withColumn("c", F.element_at("fps", 1) if len(seeds) == 1 else F.xxhash64("fps")), "fingerprints")
    classes = written(marks.groupBy("c").agg(F.min("doc_id").alias("least"), F.first("fps").alias("fps")), "classes")
    edges = None
    for i in range(len(seeds)):
        own = classes.select("c", F.element_at("fps", i + 1).alias("fp"))
        if len(seeds) == 1:
            found = links(own.select("fp"), tau)
        else:
            # The least class with a fingerprint stands for it.
            named = written(own.groupBy("fp").agg(F.min("c").alias("rep"), F.count("*").alias("n")), "named")
            pairs = links(named.select("fp"), tau)
            for end in ("a", "b"):
                pairs = pairs.join(named.select(F.col("fp").alias(end), F.col("rep").alias(f"rep_{end}")), end).drop(end).withColumnRenamed(f"rep_{end}", end)
            shared = own.join(named.where("n > 1"), "fp").select(F.col("rep").alias("a"), F.col("c").alias("b"))
            # Each seed's links are a table, so that no plan holds those of all.
            found = written(pairs.select("a", "b").union(shared), "links")
            released(docs.sparkSession, mark() - 2, mark() - 1)
        edges = found if edges is None else edges.union(found)
    return marks, classes, components(edges)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, k, fp (of the first seed), root (names the component), component_id (the least id that is reachable over links)."""
    marks, classes, roots = linked(docs, **options)
    rooted = classes.join(roots, classes["c"] == roots["node"], "left").select("c", "least", F.coalesce("root", "c").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.join(rooted.join(ids, "root").select("c", "root", "component_id"), "c").select("doc_id", "k", F.element_at("fps", 1).alias("fp"), "root", "component_id")


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    k = min(shingle, len(words))
    found = (xxhash.xxh64_intdigest(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)) if k else ()
    return np.unique(np.fromiter(found, np.uint64))


def alike(a: np.ndarray, b: np.ndarray, least_share: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return not either or both / either >= least_share


class _Kept:
    """Texts kept in a component. Two that have the share in common meet at one of their least hashes."""

    def __init__(self, least_share: float) -> None:
        self.least_share, self.sets, self.at, self.wordless = least_share, [], {}, False

    def takes(self, s: np.ndarray) -> bool:
        """Whether no kept text is alike; then s is kept."""
        if not len(s):
            new, self.wordless = not self.wordless, True
            return new
        first = s[: len(s) - math.ceil(self.least_share * len(s) - 1e-9) + 1].tolist()
        if any(alike(s, self.sets[i], self.least_share) for i in {i for h in first for i in self.at.get(h, ())}):
            return False
        for h in first:
            self.at.setdefault(h, []).append(len(self.sets))
        self.sets.append(s)
        return True


def _apart(texts: DataFrame, docs: DataFrame, least_share: float, doc_id: str, text: str, large: int = 2048, most_heads: int = 256) -> DataFrame:
    """Of texts (root, x), those that no kept text before them in the component is alike to.

    In a large component all texts are first held against its first, wherever they are; so it is in the
    `most_heads` largest of them, a bound on what the driver broadcasts. It only saves work: what is left
    of any component is compared in order.
    """
    python_workers(docs.sparkSession)
    texts = written(texts, "texts")
    sizes = texts.groupBy("root").agg(F.count("*").alias("n"), F.min("x").alias("first"))
    alone = sizes.where("n = 1").select(F.col("first").alias("x"))
    big = written(sizes.where(F.col("n") > large).orderBy(F.desc("n"), "root").limit(most_heads), "large")
    few = F.broadcast(big.select("root"))
    in_big = texts.join(few, "root").select("root", "x", F.lit(True).alias("big"))
    rest = texts.join(few, "root", "left_anti").join(sizes.where("n > 1").select("root"), "root").select("root", "x", F.lit(False).alias("big"))
    body = docs.select(F.col(doc_id).alias("d"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"), F.col(text).alias("text"))
    found = body.join(in_big.unionByName(rest), F.col("d").eqNullSafe(F.col("x.doc_id")) & (F.col("h") == F.col("x.k"))).select("root", "x", "big", "text")
    found = written(found, "candidates")
    heads = found.where("big").join(F.broadcast(big.select("root", "first")), "root").where("x = first")
    first = docs.sparkSession.sparkContext.broadcast({r["root"]: shingles(r["text"]) for r in heads.select("root", "text").collect()})

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, bodies = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            yield batch.filter(pa.array([not alike(first.value[r], shingles(t), least_share) for r, t in zip(roots, bodies, strict=True)], pa.bool_()))

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, last = _Kept(least_share), None
        for batch in batches:
            stays = []
            for r, t in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if r != last:
                    kept, last = _Kept(least_share), r
                stays.append(kept.takes(shingles(t)))
            yield batch.select([1]).filter(pa.array(stays, pa.bool_()))

    left = found.where("not big")
    if first.value:
        left = left.unionByName(found.where("big").mapInArrow(others, found.schema))
    kept = left.repartition("root").sortWithinPartitions("root", "x").mapInArrow(greedy, found.select("x").schema)
    return alone.union(kept).union(big.select(F.col("first").alias("x")))


def deduplicated(docs: DataFrame, *, least_share: float | None = None, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row for each component: of its least id, or with a null id if it has no other.

    least_share: a row stays unless a row that stays, of its component, has that share of shingles in common.
    Each class (or text) gives its first row before components are looked up, so large groups meet only as partial minima.
    """
    marks, _, roots = linked(docs, doc_id=doc_id, text=text, **options)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "count")).alias("x")
    unit = ["c"] if least_share is None else ["c", "t"]
    classes = marks.groupBy(*unit, "doc_id", "k").count().groupBy(*unit).agg(least)
    rooted = classes.join(roots, classes["c"] == roots["node"], "left").select(F.coalesce("root", "c").alias("root"), "x")
    first = rooted.groupBy("root").agg(F.min("x").alias("x")) if least_share is None else _apart(rooted, docs, least_share, doc_id, text)
    d, k, n = (unused(docs.columns, x) for x in ("d", "k", "n"))
    keep = first.select(F.col("x.doc_id").alias(d), F.col("x.k").alias(k), F.col("x.count").alias(n))
    found = docs.join(keep, F.col(doc_id).eqNullSafe(F.col(d)) & (F.xxhash64(F.col(doc_id), F.col(text)) == F.col(k)))
    # Only of fully repeated rows is more than one left.
    own = [F.col(f"`{c}`") for c in docs.columns]
    return found.where(F.col(n) == 1).select(own).unionByName(found.where(F.col(n) > 1).dropDuplicates([d, k]).select(own))
