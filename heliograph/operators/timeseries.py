"""Measurements: buckets, rollover, bitemporal reads, late data, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPANS = {"seconds": "1 hour", "minutes": "1 day", "hours": "30 days"}


def buckets(rows: DataFrame, fields: list[str], granularity: str = "seconds", ts: str = "ts", meta: str = "meta") -> DataFrame:
    """meta, bucket, n, first_ts, last_ts and each field's min and max: one row a bucket that has rows."""
    start = F.window(F.col(ts), SPANS[granularity])["start"]
    aggs = [F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")]
    aggs += [f(c).alias(f"{c}_{n}") for c in fields for n, f in (("min", F.min), ("max", F.max))]
    return rows.groupBy(meta, start.alias("bucket")).agg(*aggs)


def rollover(rows: DataFrame, most: int, *, order: list[str], meta: str = "meta") -> DataFrame:
    """rows with `bucket`: a new one after `most` measurements of a meta value."""
    w = Window.partitionBy(meta).orderBy(*order)
    return rows.withColumn("bucket", F.floor((F.row_number().over(w) - 1) / most).cast("long"))


def schema_rollover(rows: DataFrame, fields: str, *, order: list[str], meta: str = "meta") -> DataFrame:
    """rows with `bucket`: a new one whenever the set of keys of the map `fields` changes."""
    w = Window.partitionBy(meta).orderBy(*order)
    keys = F.array_join(F.sort_array(F.map_keys(fields)), ",")
    change = (~keys.eqNullSafe(F.lag(keys).over(w))).cast("int")
    return rows.withColumn("__c", change).withColumn("bucket", (F.sum("__c").over(w) - 1).cast("long")).drop("__c")


def as_of(rows: DataFrame, instant: Column, *, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The latest version of each key that was there at an instant, and how many there were."""
    key = F.struct(*order)
    return rows.where(F.col(order[0]) <= instant).groupBy(*by).agg(*[F.max_by(c, key).alias(c) for c in keep], F.count("*").alias("versions"))


def visible(rows: DataFrame, instant: Column | None = None, created: str = "created_at", deleted: str = "deleted_at") -> DataFrame:
    """System time: rows there at an instant, or now."""
    if instant is None:
        return rows.where(F.col(deleted).isNull())
    return rows.where((F.col(created) <= instant) & (F.col(deleted).isNull() | (F.col(deleted) > instant)))


def late_tiers(rows: DataFrame, granularity: str = "seconds", ts: str = "ts", ingested: str = "ingestion_ts", meta: str = "meta") -> DataFrame:
    """rows with `tier`: 1 in order or while the bucket is open, 2 within twice its span after, 3 later."""
    span = {"seconds": 3600, "minutes": 86400, "hours": 30 * 86400}[granularity]
    end = F.unix_micros(F.window(F.col(ts), SPANS[granularity])["end"].cast("timestamp")) / 1e6
    late = F.unix_micros(F.col(ingested).cast("timestamp")) / 1e6 - end
    return rows.withColumn("tier", F.when(late < 0, 1).when(late < 2 * span, 2).otherwise(3))


def page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """Keyset paging: the next rows after a key."""
    return (rows.where(F.col(key) > after) if after is not None else rows).orderBy(key).limit(size)
