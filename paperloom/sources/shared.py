"""The folder that driver and executors share, and what is written there on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names one, else the checkpoint folder set in code.

    Only a local session, as in tests, gets a temporary folder of its own; executors on other
    machines would not see it, so a cluster that names no folder is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("a cluster has to name its shared folder in spark.checkpoint.dir")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="paperloom-"))
    return context.getCheckpointDir().rstrip("/")


_folders: dict[str, list[str]] = {}


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, which ``remove_folders`` knows."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, sizes are known."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folders(spark: SparkSession) -> int:
    """Removes all ``new_folder`` paths of this application: for callers whose results are written. Returns how many."""
    paths = _folders.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)
