"""Tables between steps, in the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where none is set and Spark runs on this machine alone, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
        atexit.register(clear, spark)
    return f"{sc.getCheckpointDir()}/tables"


def stored(df: DataFrame, compression: str = "snappy", by: str | None = None, parts: int | None = None) -> DataFrame:
    """Write df as Parquet under folder() and go on from there.

    Unlike a cache it outlives executors and is read by column. It stays until
    clear() is called, or the driver ends. With by and parts, it is bucketed: a table that
    that column deals to as many partitions is written without a shuffle, and read back as dealt.
    """
    spark = df.sparkSession
    name = uuid.uuid4()
    path = f"{folder(spark)}/{name}"
    if by and parts:
        table = f"stored_{name.hex}"
        df.repartition(parts, by).write.option("compression", compression).option("path", path).bucketBy(parts, by).format("parquet").saveAsTable(table)
        return spark.table(table)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what stored() has written in this session; tables made from it can no longer be read."""
    sc = spark.sparkContext
    if sc._jsc is None or sc.getCheckpointDir() is None:
        return
    try:
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{sc.getCheckpointDir()}/tables")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session or its JVM is gone: the cluster clears its folder
        return
