"""Cutting lineage with tables in storage that all executors share.

A stage is a Parquet table below the folder in ``spark.checkpoint.dir``: it is
columnar and compressed, later readers prune its columns, and it survives the
loss of any executor. The folder is read from the session; only where the
session names none and runs in local mode is a temporary one made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder for stages; raises on a cluster whose session names none."""
    global _local
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="granary-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return f"file://{_local}"


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to a new table in the shared folder, partitioned ``by`` a column of few values if given, and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM delete the table when it ends; until then lazy readers may need it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def row_bytes(df: DataFrame):
    """Bytes of a row: the lengths of texts, eight for each other value and for each element of an array."""
    from pyspark.sql import functions as F

    def of(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind == "string":
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if kind == "array<string>":
            return F.coalesce(F.aggregate(c, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16), F.lit(0)) + 16
        return F.greatest(F.size(c), F.lit(0)) * 8 * (kind.count(",") + 1) + 16 if kind.startswith("array") else F.lit(8)

    return sum((of(*c) for c in df.dtypes), F.lit(16))


def is_bounded(df: DataFrame, rows: int, size: int = 64 << 20) -> bool:
    """True if ``df`` has at most ``rows`` rows and about ``size`` bytes. Runs ``df`` once: stage what is costly first."""
    from pyspark.sql import functions as F

    n, total = df.agg(F.count("*"), F.sum(row_bytes(df).cast("long"))).first()
    return n <= rows and (total or 0) <= size


def bounded_broadcast(df: DataFrame, rows: int, size: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes, else unchanged.

    Both are taken from the data, so the hint can't outgrow its bound; beyond it
    Catalyst and AQE choose a shuffled join.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if is_bounded(df, rows, size) else df
