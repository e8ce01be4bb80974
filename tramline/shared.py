"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Shuffles behind a table go once it is written: nothing else reads them.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def on_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir as a full URI; where it is unset and all runs on this machine (tests), a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not on_one_machine(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = "file://" + tempfile.mkdtemp(prefix="tramline-")
        return _own[application]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tramline/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df, written once to the shared folder and read back: survives lost executors."""
    path, conf = path or fresh_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *patterns: str) -> None:
    """Deletes what lies under patterns in the shared folder, once nothing reads it any more."""
    context = spark.sparkContext
    for pattern in patterns:
        path = context._jvm.org.apache.hadoop.fs.Path(pattern)
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        for found in store.globStatus(path) or ():
            store.delete(found.getPath(), True)
