"""Intermediate tables written to the cluster's shared folder.

A written table cuts lineage: it outlives the executors that produced it, and every later
stage sees one fixed version of the rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
AUTO_BUCKETS = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it gets a scratch folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="lexivec-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Queries run inside have these settings; afterwards the session is as before."""
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def write_table(df: DataFrame, label: str, release: bool = False, batch_rows: int = 0) -> DataFrame:
    """Runs ``df`` once, writes it to the shared folder and returns the written rows. With ``release``
    the shuffle files of the run go as soon as the table is written; ``batch_rows`` bounds what Python functions
    are handed at a time."""
    spark = df.sparkSession
    path = new_path(spark, label)
    settings = {SHUFFLE_CLEANUP: "true"} if release else {}
    with session_settings(spark, settings | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, key: str, buckets: int, label: str, *order: str) -> DataFrame:
    """As ``write_table``, with the rows of a key in one bucket (sorted by ``order``, if any): joins and groups by ``key``
    read the buckets and do not shuffle these rows again. Shuffle files go when the table is written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    name = re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    writer = df.write.bucketBy(buckets, key).option("path", path)
    with session_settings(spark, {SHUFFLE_CLEANUP: "true"}):
        (writer.sortBy(*order) if order else writer).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry only: the files were given a place of their own
    return table


def unshuffled_buckets(spark: SparkSession) -> AbstractContextManager[None]:
    """Plans made inside read bucketed tables bucket by bucket, whatever stands between scan and group."""
    return session_settings(spark, {AUTO_BUCKETS: "false"})


def drop_table(table: DataFrame) -> None:
    """Deletes the files behind a table made by ``write_table``, when nothing reads it any more.
    Anything else in or outside the shared folder is left alone."""
    spark = table.sparkSession
    folders = {name.rsplit("/", 1)[0] for name in table.inputFiles()}
    home = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        inside = path.getParent().toUri().getPath() == home
        if inside and re.search(r"-[0-9a-f]{32}$", path.getName()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
