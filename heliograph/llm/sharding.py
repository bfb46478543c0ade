"""Proportional stratified interleaving of documents into shards.

Rows of each source are put in a seeded random order and get the fractional
rank `(rank - 1 + jitter(source)) / n_source`. All rows sorted by that number
are the interleaved corpus: any contiguous cut of it holds every source in
its share of the whole, to within one row. The cut into shards makes row counts
at most one apart (law `rows`).

No source is ever gathered in one task. A rank is the number of rows in earlier
hash buckets of the source, from a small table of counts, plus the row number in
the own bucket; the place in the corpus is found in the same way over slices of
the fractional rank, which are equally full by construction.

Defined results: null text has size 1 and crc32 0; null sources are a stratum of
their own; null or repeated ids are rows like any other; fully equal rows take
adjacent places; an empty table gives an empty result. Other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hash60(text: Column) -> Column:
    """60 bits of md5, as a non-negative long that any SQL engine can compute."""
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("long")


def interleaved_shards(docs: DataFrame, n_shards: int = 8, seed: str = "interleave-1", *, doc_id: str = "doc_id", text: str = "text", source: str = "source", bucket_bits: int = 12) -> DataFrame:
    """doc_id, size, text_crc32, stratum, position (in the interleaved corpus), shard, slot.

    bucket_bits: 2**bucket_bits hash buckets in a source and slices of the
    corpus; a task sorts about 1/2**bucket_bits of the rows at a time.
    """
    slices = 1 << bucket_bits
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s:"), F.col(source).cast("string")), F.lit("null")).alias("stratum"),
        _hash60(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("h"),
    ).withColumn("b", F.shiftright("h", 60 - bucket_bits))

    by_bucket = Window.partitionBy("stratum").orderBy("b")
    before = keyed.groupBy("stratum", "b").count().select(
        "stratum",
        "b",
        F.coalesce(F.sum("count").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("count").over(Window.partitionBy("stratum")).alias("n"),
    )
    jitter = _hash60(F.concat(F.lit(seed + "/"), F.col("stratum"))) / F.lit(float(1 << 60))
    ranked = (
        keyed.withColumn("r", F.row_number().over(Window.partitionBy("stratum", "b").orderBy("h", "doc_id", "text_crc32", "size")))
        .join(before, ["stratum", "b"])
        .withColumn("f", ((F.col("before") + F.col("r") - 1).cast("double") + jitter) / F.col("n").cast("double"))
        .withColumn("g", F.least(F.floor(F.col("f") * slices), F.lit(slices - 1)).cast("int"))
    )
    everything = Window.partitionBy(F.lit(0))
    starts = ranked.groupBy("g").count().select(  # at most 2**bucket_bits rows
        "g",
        F.coalesce(F.sum("count").over(everything.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.sum("count").over(everything).alias("total"),
    )
    placed = (
        ranked.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("f", "stratum", "h", "doc_id", "text_crc32", "size")))
        .join(F.broadcast(starts), "g")
        .withColumn("position", F.col("start") + F.col("k") - 1)
    )
    base, extra = F.expr(f"total div {n_shards}"), F.col("total") % n_shards
    head = extra * (base + 1)  # rows of the shards that hold one more
    in_head = F.col("position") < head
    shard = F.when(in_head, F.expr(f"position div (total div {n_shards} + 1)")).otherwise(extra + F.expr(f"(position - (total % {n_shards}) * (total div {n_shards} + 1)) div greatest(total div {n_shards}, 1)"))
    first = F.when(in_head, F.col("shard") * (base + 1)).otherwise(head + (F.col("shard") - extra) * base)
    return placed.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "stratum", "position", F.col("shard").cast("int").alias("shard"), (F.col("position") - first).cast("long").alias("slot"))
