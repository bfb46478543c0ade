"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words, lower-cased, and the first four and five
characters of longer words, hashed into 2**bits buckets. The machine has a weight and a
factor vector for every bucket that the labelled sample uses, and with the factors every
pairwise interaction:

    w0 + sum_i w_i + 1/2 sum_f ((sum_i v_if)^2 - sum_i v_if^2)

No term is left out beforehand: a pair that is toxic only together, each of its terms alone
being as common in either class, is learned like any other. Instead the fit is sparse.
A weight, or a factor vector as a whole, shrinks in each step by a multiple (`least_weight`,
`least_factor`) of the noise that its own gradient would have if residuals had random signs, so
what the other terms explain already, or chance does, ends at exactly zero. In the last `refit`
steps the terms that are left learn without shrinking.

The sample holds at most `most_per_class` labelled documents of each class, those
with the lowest hash of the id, with their whole texts; that bound also bounds what reaches the driver.
Each weighs in by the labels of its class that it stands for, so the share of toxic
labels that the machine learns is that of all labels, at any size.
Every document is scored over its whole text.

Defined results: null or empty text has no term and gets the score of w0;
without labels of both classes the score is the share of toxic labels, next to 0 with
none; repeated ids in `labels` count once, toxic if any says so; null labels are
left out; repeated rows each get a row; an empty table gives an empty result; columns of
the input keep their names and values, whatever they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import held_out_fold, python_workers, unused

WORD = re.compile(r"\w+")


class Machine(NamedTuple):
    bits: int
    bias: float
    index: dict[int, int]  # bucket -> row of w and v
    w: np.ndarray
    v: np.ndarray


def terms(word: str, bits: int) -> list[int]:
    parts = [word, *("^" + word[:k] for k in (4, 5) if len(word) > k)]
    return [xxhash.xxh32_intdigest(p) >> (32 - bits) for p in parts]


class _Buckets(dict):
    """word -> rows of the machine for its terms; bounded."""

    def __init__(self, index: dict[int, int] | None, bits: int, most: int = 150_000) -> None:
        super().__init__()
        self.index, self.bits, self.most = index, bits, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        found = terms(word, self.bits)
        self[word] = out = tuple(found if self.index is None else (self.index[b] for b in found if b in self.index))
        return out


def rows_of(text: str | None, known: _Buckets) -> set[int]:
    return {i for w in set(WORD.findall(text.lower())) for i in known[w]} if text else set()


def train(labelled: DataFrame, *, bits: int = 20, factors: int = 8, steps: int = 100, refit: int = 30, rate: float = 0.1, least_weight: float = 4.0, least_factor: float = 2.0, seed: int = 7) -> Machine:
    """labelled: text, toxic (0 or 1), and labels of the class that a row stands for in `stands`, 1 without it; a bounded sample."""
    python_workers(labelled.sparkSession)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(None, bits)
        for batch in batches:
            found = [np.array(sorted(rows_of(t, known)), "<i4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["toxic", "stands", "x"])

    stands = F.col("stands") if "stands" in labelled.columns else F.lit(1.0)
    given = labelled.select(F.col("toxic").cast("int").alias("toxic"), stands.cast("double").alias("stands"), "text")
    rows = sorted((r["toxic"], bytes(r["x"]), r["stands"]) for r in given.mapInArrow(pick, "toxic int, stands double, x binary").collect())
    y, weight = np.array([r[0] for r in rows], float), np.array([r[2] for r in rows], float)
    if len({*y.tolist()}) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Machine(bits, float(np.log(max(share, 1e-300) / max(1 - share, 1e-300))), {}, np.zeros(0), np.zeros((0, factors)))
    at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[1]) // 4 for r in rows])
    buckets, x = np.unique(np.frombuffer(b"".join(r[1] for r in rows), "<i4"), return_inverse=True)
    x = x.astype(np.int32)
    del rows
    w, v, bias = _fit(y, weight / weight.sum(), at, x, len(buckets), factors, steps, refit, rate, least_weight, least_factor, seed)
    live = np.flatnonzero((w != 0) | (v != 0).any(1))
    return Machine(bits, bias, {b: i for i, b in enumerate(buckets[live].tolist())}, w[live], v[live])


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, f], n) for f in range(values.shape[1])], 1) if n else np.zeros((0, values.shape[1]))


def _raw(bias: float, w: np.ndarray, v: np.ndarray, at: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    s = _sums(at, v[x], n)
    return bias + np.bincount(at, w[x], n) + 0.5 * (s * s - _sums(at, v[x] ** 2, n)).sum(1), s


def _tally(index: np.ndarray, n: int, weigh, step: int = 1 << 18) -> np.ndarray:
    """Sums of weigh(slice) by index, a stretch of entries at a time."""
    out = np.zeros(n)
    for a in range(0, len(index), step):
        part = slice(a, a + step)
        out += np.bincount(index[part], weigh(part), n)
    return out


def _fit(y, weight, at, x, n_terms, factors, steps, refit, rate, least_weight, least_factor, seed):
    """Full-batch Adam with proximal steps on the weighted log loss; one factor and one stretch of entries at a time, to stay small."""
    rng, n = np.random.default_rng(seed), len(y)
    w, v = np.zeros(n_terms), rng.normal(0, 0.4 / np.sqrt(max(1.0, len(at) / n)), (n_terms, factors))
    share = float((weight * y).sum() / weight.sum())
    bias = float(np.log(share / (1 - share)))
    m, u = [np.zeros(1), np.zeros(n_terms), np.zeros_like(v)], [np.zeros(1), np.zeros(n_terms), np.zeros(n_terms)]
    noise = [np.zeros(n_terms), np.zeros(n_terms)]
    rows, terms_ = at, x  # entries whose term has factors
    for t in range(1, steps + 1):
        shrink = float(t <= steps - refit)
        s = np.zeros((n, factors))
        raw = bias + _tally(at, n, lambda p: w[x[p]])
        for f in range(factors):
            vf = v[:, f]
            s[:, f] = _tally(rows, n, lambda p, vf=vf: vf[terms_[p]])
            raw += 0.5 * (s[:, f] ** 2 - _tally(rows, n, lambda p, vf=vf: vf[terms_[p]] ** 2))
        g = (_sigmoid(raw) - y) * weight
        grad = [np.array([g.sum()]), _tally(x, n_terms, lambda p: g[at[p]]), np.zeros_like(v)]
        square = [_tally(x, n_terms, lambda p: g[at[p]] ** 2), np.zeros(n_terms)]
        for f in range(factors):
            each = lambda p, vf=v[:, f], sf=s[:, f]: g[rows[p]] * (sf[rows[p]] - vf[terms_[p]])
            grad[2][:, f] = _tally(terms_, n_terms, each)
            square[1] += _tally(terms_, n_terms, lambda p, each=each: each(p) ** 2)
        first, second = 1 - 0.9**t, 1 - 0.99**t
        for k in range(3):
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            u[k] = 0.99 * u[k] + 0.01 * (grad[k] ** 2 if k < 2 else (grad[k] ** 2).mean(1))
        for k in range(2):
            noise[k] = 0.9 * noise[k] + 0.1 * square[k]
        step = [rate / (np.sqrt(a / second) + 1e-6) for a in u]
        bias -= float(step[0][0] * m[0][0] / first)
        open_ = (w != 0) | (shrink > 0)
        w = np.where(open_, w - step[1] * m[1] / first, 0)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink * step[1] * least_weight * np.sqrt(noise[0] / first), 0)
        alive = (v != 0).any(1)
        v = np.where(alive[:, None], v - step[2][:, None] * m[2] / first, 0)
        # Factors begin free and shrink fully from step 20 on: only after some steps does a pair stand out.
        much = shrink * step[2] * least_factor * min(1.0, t / 20) * np.sqrt(noise[1] / first)
        v *= np.maximum(1 - much / np.maximum(np.sqrt((v * v).sum(1)), 1e-12), 0)[:, None]
        keep = (v != 0).any(1)[terms_]
        if keep.sum() < 0.8 * len(keep):
            rows, terms_ = rows[keep], terms_[keep]
    return w, v, bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def scored(docs: DataFrame, machine: Machine, name: str, *, text: str = "text") -> DataFrame:
    """docs with the score in a further column `name`."""
    python_workers(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(machine.index, machine.bits)
        for batch in batches:
            found = [[*rows_of(t, known)] for t in batch.column(at).to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            x = np.array([i for f in found for i in f], np.int64)
            raw, _ = _raw(machine.bias, machine.w, machine.v, owner, x, len(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_sigmoid(raw), pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, machine: Machine, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every document."""
    return scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), machine, "score").select("doc_id", "score")


def labelled_sample(docs: DataFrame, labels: DataFrame, *, most_per_class: int = 2000, folds: int = 5, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """text, toxic, stands (labels of its class for each in the sample) of the sample: never documents of fold 0."""
    ids = (
        labels.select(F.col(doc_id).alias("i"), F.col(toxic).cast("int").alias("toxic"))
        .where(F.col("i").isNotNull() & F.col("toxic").isin(0, 1) & (held_out_fold(F.col("i"), folds) != 0))
        .groupBy("i").agg(F.max("toxic").alias("toxic"))
    )
    totals = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    picked = None
    for k in (0, 1):
        stands = max(1.0, totals.get(k, 0) / max(1, most_per_class))
        part = ids.where(F.col("toxic") == k).orderBy(F.xxhash64("i"), "i").limit(most_per_class).withColumn("stands", F.lit(stands))
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * most_per_class ids.
    return docs.select(F.col(doc_id).alias("i"), F.col(text).alias("text")).join(F.broadcast(picked), "i").select("text", "toxic", "stands")


def toxicity(docs: DataFrame, labels: DataFrame, *, train_docs: DataFrame | None = None, most_per_class: int = 2000, **columns) -> DataFrame:
    """doc_id, score in 0 to 1, predicted (1 if score >= 0.5). train_docs: where labelled texts are, if not in docs."""
    sample = labelled_sample(docs if train_docs is None else train_docs, labels, most_per_class=most_per_class, **columns)
    return score(docs, train(sample), **columns).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, text: str = "text", **options) -> DataFrame:
    """docs that score below the threshold; the machine learns from those of them that are labelled."""
    machine = train(labelled_sample(docs, labels, text=text, **options))
    name = unused(docs.columns, "toxicity")
    return scored(docs, machine, name, text=text).where(F.col(name) < threshold).select([F.col(f"`{c}`") for c in docs.columns])
