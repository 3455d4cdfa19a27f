"""Tables between phases, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Deletes the shuffle files of a query when it has ended: what it made is written then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set: one of this machine in local mode, as in tests; an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\[]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='passagemill-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and end inside free their shuffles."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again; the shuffles that made it are freed.

    It cuts the lineage: a lost executor costs the tasks that it ran, not the phases before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/passagemill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
