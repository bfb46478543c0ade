"""Fusing rankings: reciprocal rank, convex combination, distribution-based; hybrid and document scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

RRF_K = 60


def rrf(rows: DataFrame, scores: list[str], out: str = "rrf_score", k: int = RRF_K, id: str = "id") -> DataFrame:
    """Sum over methods of 1 / (k + rank); equal scores share a rank, and a row that a method
    did not match takes the rank after its last.

    Ranks need no global sort in one task: rows are counted by distinct score, and only the
    distinct scores, fewer than rows, are accumulated by range.
    """
    total, matched = F.lit(0.0), rows.agg(*[F.count(s).alias(f"__n_{s}") for s in scores])
    ranks = {s: score_ranks(rows, s).select(F.col(s).alias(f"__s_{s}"), F.col("rank").alias(f"__r_{s}")) for s in scores}
    rows = rows.join(F.broadcast(matched), F.lit(True))  # one row of counts
    for s in scores:
        rows = rows.join(ranks[s], rows[s] == F.col(f"__s_{s}"), "left").drop(f"__s_{s}")
        total = total + 1.0 / (k + F.coalesce(F.col(f"__r_{s}"), F.col(f"__n_{s}") + 1))
    return rows.withColumn(out, total).drop(*[f"__{x}_{s}" for s in scores for x in "rn"])


def score_ranks(rows: DataFrame, score: str) -> DataFrame:
    """score, rank (competition, from 1 for the greatest) of each distinct score."""
    counts = rows.where(F.col(score).isNotNull()).groupBy(score).count()
    # Kept, as the sums inside and before a range must see the same ranges.
    parts = cut(counts.repartitionByRange(F.col(score).desc()).withColumn("__p", F.spark_partition_id()))
    parts = parts.sortWithinPartitions(F.col(score).desc())
    inside = F.sum("count").over(Window.partitionBy("__p").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1))
    before = parts.groupBy("__p").agg(F.max(score).alias("top"), F.sum("count").alias("n"))
    w = Window.orderBy(F.col("top").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = before.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).select("__p", "before")
    return parts.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "__p").select(score, (F.col("inside") + F.col("before") + 1).alias("rank"))


def _with_stats(rows: DataFrame, aggs: list[Column]) -> DataFrame:
    return rows.join(F.broadcast(rows.agg(*aggs)), F.lit(True))  # one row of statistics


def convex(rows: DataFrame, weights: dict[str, float], out: str = "cc_score") -> DataFrame:
    """Weighted min-max scores; a method whose scores are all equal, or that misses a row, adds 0."""
    names = list(rows.columns)
    both = _with_stats(rows, [f(s).alias(f"__{n}_{s}") for s in weights for n, f in (("lo", F.min), ("hi", F.max))])
    total = F.lit(0.0)
    for s, w in weights.items():
        lo, hi = F.col(f"__lo_{s}"), F.col(f"__hi_{s}")
        total = total + w * F.coalesce(F.when(hi > lo, (F.col(s) - lo) / (hi - lo)), F.lit(0.0))
    return both.withColumn(out, total).select(*names, out)


def dbsf(rows: DataFrame, weights: dict[str, float], out: str = "dbsf_score") -> DataFrame:
    """Weighted z-scores with the population deviation; none where it is 0."""
    names = list(rows.columns)
    both = _with_stats(rows, [f(s).alias(f"__{n}_{s}") for s in weights for n, f in (("m", F.avg), ("d", F.stddev_pop))])
    total = F.lit(0.0)
    for s, w in weights.items():
        m, d = F.col(f"__m_{s}"), F.col(f"__d_{s}")
        total = total + w * F.coalesce(F.when(d > 0, (F.col(s) - m) / d), F.lit(0.0))
    return both.withColumn(out, total).select(*names, out)


def hybrid_score(vector: Column, text: Column | None, similarity: bool = True) -> Column:
    """0.65 of the vector score and 0.35 of the text score, each in 0 to 1."""
    v = F.greatest(F.least((vector + 1) / 2 if similarity else 1 / (1 + vector), F.lit(1.0)), F.lit(0.0))
    t = text / (1 + text) if text is not None else F.lit(0.0)
    return 0.65 * F.coalesce(v, F.lit(0.0)) + 0.35 * F.coalesce(t, F.lit(0.0))


def doc_score(docs: DataFrame, chunks: DataFrame, similarity: str, alpha: float = 0.5, beta: float = 0.3, gamma: float = 0.2, id: str = "id", doc: str | None = None, out: str = "doc_score") -> DataFrame:
    """docs with alpha max + beta mean + gamma share of matching chunks; 0.0 without chunks.

    chunks: a row a chunk with the document's id in `id` and its similarity, or NULL. doc: docs' column of ids, if another.
    """
    s = F.col(similarity)
    per = chunks.groupBy(F.col(id).alias("__doc")).agg(F.max(s).alias("__m"), F.avg(s).alias("__a"), F.sum((s > 0).cast("int")).alias("__hits"), F.count("*").alias("__n"))
    score = alpha * F.greatest(F.coalesce("__m", F.lit(0.0)), F.lit(0.0)) + beta * F.coalesce("__a", F.lit(0.0)) + gamma * F.coalesce(F.col("__hits") / F.col("__n"), F.lit(0.0))
    return docs.join(per, docs[doc or id] == F.col("__doc"), "left").withColumn(out, F.when(F.col("__n").isNull(), F.lit(0.0)).otherwise(score)).drop("__doc", "__m", "__a", "__hits", "__n")
