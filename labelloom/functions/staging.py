"""Cutting lineage with written tables.

A stage that several later stages read (votes, manifest keys) is written once to the shared
folder the cluster names in ``spark.checkpoint.dir`` and read back as Parquet, so a lost
executor costs a re-read and never a recomputation of the texts.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of the warehouse.

    The warehouse is as shared as the session's tables are, so no machine-local folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has written to yet."""
    return f"{shared_folder(spark)}/labelloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and return the written table (runs one job)."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(df: DataFrame, path: str, files: int | None = 1) -> bool:
    """Write ``df`` to ``path`` unless a table is there; of several writers exactly one wins, and it tells so by true.

    Records are written as one file; with ``files=None`` a table is written as it is dealt.

    The rows are written to a hidden folder beside ``path`` and moved there in one step, which the file system
    refuses where ``path`` exists.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    if target.getFileSystem(conf).exists(target):
        return False
    own = f"{path.rstrip('/').rsplit('/', 1)[0]}/_unpublished-{uuid.uuid4().hex}"
    (df if files is None else df.coalesce(files)).write.parquet(own)
    try:
        context = hadoop.FileContext.getFileContext(target.toUri(), conf) if target.toUri().getScheme() else hadoop.FileContext.getFileContext(conf)
        context.rename(hadoop.Path(own), target, spark.sparkContext._gateway.new_array(
            spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if not target.getFileSystem(conf).exists(target):
            raise
        del e
        target.getFileSystem(conf).delete(hadoop.Path(own), True)
        return False
    return True
