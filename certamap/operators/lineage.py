"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this session has written under its shared root; they go when it ends.
_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir, the context's checkpoint folder, or else the warehouse, which is shared wherever tables are."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return root or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/certamap-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@atexit.register
def drop_written() -> None:
    """Delete what `cut` has written, once nothing reads it any more; nothing is lost where the session has gone already."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is None:  # the session was stopped; what lies in a plain folder can still go
            if path.startswith(("file:", "/")):
                shutil.rmtree(re.sub("^file:/+", "/", path), ignore_errors=True)
            continue
        try:
            _remove(spark, path)
        except Exception:  # the JVM has ended before us
            return


def fresh_path(spark: SparkSession) -> str:
    """A new path under the shared root, deleted when the session ends."""
    path = f"{shared_root(spark)}/certamap-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there and a lost executor loses nothing. The table stays until `drop` or the end of the session."""
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the table that `cut` has returned as `df`, once everything read from it is in tables of its own."""
    names = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    for spark, path in [x for x in _written if x[1].rpartition("/")[2] in names]:
        _remove(spark, path)
        _written.remove((spark, path))
