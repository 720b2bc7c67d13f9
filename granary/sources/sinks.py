"""Sinks: upserts by rewriting a table, appends of what is new, text files, retention.

Parquet tables take no MERGE; a rewrite makes a new version of the table in a
folder of its own. A version counts once its job has committed (its _SUCCESS mark
is there), so readers see the old or the new state and never none: nothing is
renamed, a crash leaves an unmarked folder that nobody reads, and of two writers
of one version the second fails. The version before stays for running readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.relational import insert_or_ignore, latest_by_key, upsert
from granary.operators.textops import one_line


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions of a table, in order."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()]
    done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def _folder(path: str, n: int) -> str:
    return f"{path}/v{n:08d}"


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as it is now, or None if there is none."""
    v = versions(spark, path)
    return spark.read.parquet(_folder(path, v[-1])) if v else None


def swap(df: DataFrame, path: str) -> None:
    """Make ``df`` the new state of the table at ``path``, which it may read."""
    spark = df.sparkSession
    v = versions(spark, path)
    df.write.parquet(_folder(path, v[-1] + 1 if v else 1))
    jvm = spark.sparkContext._jvm
    for n in v[:-1]:
        p = jvm.org.apache.hadoop.fs.Path(_folder(path, n))
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_upsert(updates: DataFrame, path: str, keys: list[str], order: list[str], columns: list[str] | None = None) -> None:
    """Insert or update rows by key; of several updates of a key the latest by ``order`` holds."""
    once = latest_by_key(updates, keys, order)
    old = current(updates.sparkSession, path)
    swap(once if old is None else upsert(old, once, keys, columns), path)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Add the rows whose key isn't in the table yet."""
    spark = rows.sparkSession
    v = versions(spark, path)
    if v:
        insert_or_ignore(current(spark, path), rows, key).write.mode("append").parquet(_folder(path, v[-1]))
    else:
        swap(insert_or_ignore(rows.limit(0), rows, key), path)


def keep_recent(spark: SparkSession, path: str, column: str, since: str) -> None:
    """Retention: drop the rows before an instant."""
    old = current(spark, path)
    if old is not None:
        swap(old.where(F.col(column) >= F.lit(since).cast("timestamp")), path)


def write_csv(df: DataFrame, path: str, text: str, size: int = 500) -> None:
    """CSV with a header; the text column on one line of at most ``size`` characters."""
    df.withColumn(text, one_line(F.col(text), size)).write.mode("overwrite").option("header", True).csv(path)


def write_keyed(df: DataFrame, path: str, url: str) -> None:
    """JSON rows partitioned by the first two characters of the url's hash, which names the entry."""
    key = F.substring(F.md5(url), 1, 12)
    df.withColumn("key", key).withColumn("shard", F.substring(key, 1, 2)).write.mode("overwrite").partitionBy("shard").json(path)


def save_progress(done: DataFrame, path: str) -> None:
    """Keep the last state of each task of ``done(task, state, at)``, so that a later run can go on from there."""
    write_upsert(done.select("task", "state", "at"), path, ["task"], ["at"])


def remaining(tasks: DataFrame, path: str) -> DataFrame:
    """``tasks(task, ...)`` that aren't completed yet; failed ones come again."""
    state = current(tasks.sparkSession, path)
    return tasks if state is None else tasks.join(state.where("state = 'completed'").select("task"), "task", "left_anti")
