"""Tables written between the steps of an operator, in the folder all executors share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from salescast.session import shared_dir


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULT_BYTES = ("67108864b", "64MB")
MODEST_BYTES = "4m"


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of about 4 MB of texts, where the session keeps Spark's 64 MB.

    A batch lies in the JVM and in the worker, on its way in and on its way out, for each
    task of an executor.
    """
    if spark.conf.get(_BATCH_BYTES) in _DEFAULT_BYTES:
        spark.conf.set(_BATCH_BYTES, MODEST_BYTES)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    It is left there after the run, because results are lazy and may still read it;
    the folder's owner clears it.
    """
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: cuts the lineage, and a lost executor re-reads files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
