"""Durable intermediate tables: they cut the lineage of long plans and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one a session on one machine gets a temporary folder; on a cluster
    that would lose rows, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="girder-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        found = _own[0]
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` as Parquet to the shared folder and read it back.

    Unlike a cached block the table survives lost executors; unlike checkpoint() it is compressed and columnar. Lazy results
    may read it until the session ends, so it is deleted when the driver's JVM does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/girder-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)
