"""Session settings the library relies on, and the shared folder it may write to."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SQL_CONF = {
    # Zone-less timestamps in log exports mean UTC.
    "spark.sql.session.timeZone": "UTC",
    # JSON objects with a repeated key keep the last value instead of failing.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Broadcast decisions and skew splits are taken on measured shuffle sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


_OWN_DIR = "logclew.stage.dir"
_RUN_DIR = "logclew.run.dir"
_STAGED = "_logclew_staged"


def prepare(spark: SparkSession) -> SparkSession:
    """Set the SQL options every operator assumes; safe to call repeatedly.

    They stay set: pass a session of your own (``spark.newSession()``) if other work
    in this one needs another time zone or variant handling.
    """
    for key, value in _SQL_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder visible to every executor: that of the run (``run_folder``), or the session's checkpoint folder.

    Where none is set, as in a small test, and the driver and the executors are one process
    (``local``, ``local[n]``; not ``local-cluster``), a folder in the session's warehouse
    is used, and removed when the session ends.
    """
    configured = spark.conf.get(_RUN_DIR, None) or spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    configured = configured or spark.conf.get(_OWN_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    own = f"{warehouse}/logclew-{uuid.uuid4().hex}"
    files, path = _files(spark, own)
    files.deleteOnExit(path)
    spark.conf.set(_OWN_DIR, own)
    return own


def _files(spark: SparkSession, path: str):
    """The file system of ``path``, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds, if it is there."""
    files, where = _files(spark, path)
    files.delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder to a name that is still free."""
    files, where = _files(spark, path)
    target = _files(spark, to)[1]
    if files.exists(target) or not files.rename(where, target):
        raise FileExistsError(to)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Everything staged within goes to a folder of its own, which is removed at the end.

    Tables that are to be used afterwards must be written elsewhere before (a bundle is).
    """
    before = spark.conf.get(_RUN_DIR, None)
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    spark.conf.set(_RUN_DIR, folder)
    try:
        yield folder
    finally:
        if before is None:
            spark.conf.unset(_RUN_DIR)
        else:
            spark.conf.set(_RUN_DIR, before)
        remove(spark, folder)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, folders: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several outputs need the same intermediate result: the columnar
    copy survives lost executors and later readers only scan the columns they use.
    Its size is known from the files, so a join broadcasts it only when it is
    under ``spark.sql.autoBroadcastJoinThreshold``. Rows that differ in ``folders``, columns of
    few values, lie in different folders, so a filter on them skips the others. Packed with zstd,
    as whole log rows take a third less room so than by default.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*folders).option("compression", "zstd").parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.__dict__[_STAGED] = path
    return staged


def is_staged(df: DataFrame) -> bool:
    """Whether ``df`` is a table that ``stage`` gave back, as it gave it."""
    return _STAGED in df.__dict__


def spread(df: DataFrame, by: str) -> DataFrame:
    """Deal the rows of input that cannot be split out to all cores.

    A whole-document export, or a small file of one row group, is read by one
    task, and without this all the work on its rows would stay there. Input with
    a partition per core or more is returned as it is. Rows go by a hash of
    ``by``, a unique column, so a retried task deals them out the same way.
    ``df`` should come straight from a scan: counting the partitions of a plan
    with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, by)
