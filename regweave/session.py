"""Session helpers: where intermediate results that cut lineage are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where nothing is set (a local test
    session) a temporary folder is made and remembered on the session.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    current = spark.sparkContext.getCheckpointDir()
    if not folder and current:
        return current
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="regweave-")
    if not current:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint (survives the loss of executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_once(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Store as a columnar scratch table in the shared folder and read it back.

    Cheaper to re-read than a checkpoint: later stages prune columns and push filters.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def read_stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns of a stored table; its other columns are not read."""
    return spark.read.schema(schema).parquet(path)


def drop_stored(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no plan reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_others(spark: SparkSession, path: str, keep: set[str]) -> None:
    """Delete what lies directly below a folder and is not to be kept."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(place):
        if status.getPath().getName() not in keep:
            fs.delete(status.getPath(), True)
