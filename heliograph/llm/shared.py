"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the session names in `spark.checkpoint.dir`; only where that is
    unset and Spark runs on one machine (tests) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="heliograph-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path.rstrip("/")


_written: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: cuts the lineage
    and lets later stages read it again after executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables written() has made and nobody has released."""
    return len(_written)


def released(spark: SparkSession, since: int, to: int | None = None) -> None:
    """Deletes the tables from one mark to another, which nothing may read any more."""
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for path in _written[since:to]:
        path_of(path).getFileSystem(conf).delete(path_of(path), True)
    del _written[since:to]


def unused(columns: list[str], name: str) -> str:
    """A column name that none of `columns` has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while f"__{name}".lower() in taken:
        name += "_"
    return f"__{name}"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; no other character changes. Text of ASCII alone takes lower(), which is much faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def held_out_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as ''."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds


def bind(value: Column, body) -> Column:
    """body(value) with `value` computed once per row.

    A higher-order function evaluates an outer expression once per element, so
    an array that its lambda looks into has to be a lambda variable itself.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


_shipped: set[str] = set()


def python_workers(spark: SparkSession, rows: int = 1000) -> None:
    """Make ready for Python functions on executors.

    Executors get this package from the driver, once for an application. Arrow
    batches get fewer rows than Spark's default, so that a batch of long texts
    stays small; a value that the session has set itself stays.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).parents[1]
        target = Path(tempfile.mkdtemp(prefix="heliograph-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
