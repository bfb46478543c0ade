"""Change feeds, triggers and windows with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

CHANGE = T.StructType(
    [T.StructField(n, t) for n, t in (("seq", T.LongType()), ("ts", T.TimestampType()), ("op", T.StringType()), ("kind", T.StringType()), ("name", T.StringType()), ("id", T.LongType()), ("src", T.LongType()), ("dst", T.LongType()), ("payload", T.StringType()))]
)
MAX_DEPTH, MAX_FANOUT = 10, 100


def subscribe(spark: SparkSession, path: str, types: list[str] | None = None, migrations: bool = False, per_batch: int = 256) -> DataFrame:
    """The change table as a stream. The resume token is the query's checkpoint; files come in order, at most per_batch at a time."""
    out = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", per_batch).parquet(path)
    if types:
        out = out.where((F.col("kind") != "edge") | F.col("name").isin(types))
    return out if migrations else out.where(F.col("op") != "migrate")


def after_commit(changes: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, dead_letters: str, attempts: int = 3, **trigger) -> StreamingQuery:
    """Runs handler on each batch, at least once; a batch that fails `attempts` times goes to the dead-letter table.

    Batches are written under their id, so a batch that runs again replaces itself.
    """

    def run(batch: DataFrame, number: int) -> None:
        error = None
        for _ in range(attempts):
            try:
                return handler(batch, number)
            except Exception as e:  # noqa: BLE001  whatever the handler raises is the dead letter's reason
                error = e
        batch.withColumn("error", F.lit(str(error)[:500])).write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class BeforeCommitError(ValueError):
    pass


def before_commit(changes: DataFrame, rules: dict[str, object]) -> DataFrame:
    """changes, if no row breaks a rule (name -> Column that must not be false)."""
    broken = changes.agg(*[F.count(F.when(~c, 1)).alias(n) for n, c in rules.items()]).first()
    bad = {n: broken[n] for n in rules if broken[n]}
    if bad:
        raise BeforeCommitError(f"rows that break a rule: {bad}")
    return changes


def cascade(first: DataFrame, step: Callable[[DataFrame], DataFrame], max_depth: int = MAX_DEPTH, max_fanout: int = MAX_FANOUT) -> list[DataFrame]:
    """Triggered changes, level by level, until none is left; beyond the limits it is an error."""
    levels, now = [first], first
    while True:
        now = step(now)
        n = now.limit(max_fanout + 1).count()
        if not n:
            return levels
        if n > max_fanout or len(levels) > max_depth:
            raise BeforeCommitError("a trigger's cascade went beyond its limits")
        levels.append(now)


def windowed(measurements: DataFrame, span: str, late: str, ts: str = "ts", meta: str = "meta", value: str = "value") -> DataFrame:
    """meta, window, n, sum, min, max; rows later than `late` behind the newest are left to the side table."""
    return measurements.withWatermark(ts, late).groupBy(meta, F.window(ts, span)).agg(F.count("*").alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))


def sessions(measurements: DataFrame, gap: str, late: str, ts: str = "ts", meta: str = "meta") -> DataFrame:
    return measurements.withWatermark(ts, late).groupBy(meta, F.session_window(ts, gap)).agg(F.count("*").alias("n"))


def overflow(late_rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Rows past the watermark, appended to a side table that a batch job merges."""
    return late_rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
