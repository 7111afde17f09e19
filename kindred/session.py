"""Session defaults and durable materialisation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings the operators were planned for to a session builder."""
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is only used in local mode, where driver and executors
    share one disk; on a cluster an unset folder is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="kindred-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def unbroadcast(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input, never to be sent whole through the driver.

    Spark judges a file by its size on disk. Vectors and names that repeat are
    compressed many times over, so a table of gigabytes may seem small enough.
    """
    return df.hint("merge")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside gives back the disk of its shuffles as soon as it is written. Otherwise they
    stay until the driver happens to collect its garbage, and the steps of a job add up."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def materialise(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several branches of a plan: it cuts the lineage,
    survives lost executors and, being parquet, still prunes columns. With a
    ``path`` it takes the place of what was written there before, which it must not
    read: so the passes of a loop leave one or two tables behind, not one each.
    """
    path = path or scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_waves(waves: Iterable[DataFrame], name: str = "table", path: str | None = None) -> DataFrame:
    """Write tables of one schema to one place, each before the next is asked for. So a job whose shuffles
    would not fit the disk all at once can be done part by part."""
    for i, df in enumerate(waves):
        path = path or scratch_path(df.sparkSession, name)
        with shuffles_freed(df.sparkSession):
            df.write.mode("append" if i else "overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
