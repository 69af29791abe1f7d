"""Small results between the passes of a job, as tables in the cluster's shared folder.

A staged table cuts lineage, survives the loss of any executor, and has a known
size: Catalyst broadcasts it while it is under the broadcast threshold and
shuffles it beyond, without anyone counting rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
# The folder of each application that names none; the setting can't be changed in a running one.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; a temporary one only on a single machine."""
    folder = spark.conf.get(_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_CONF} must name a shared folder on a cluster")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="run-harvestline-")
    return _LOCAL[application]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a result once and read it back."""
    return _written(df, f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Staging:
    """Stages tables under one folder, deleted as a whole when the job is done."""

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"
        self.count = 0

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        self.count += 1
        return _written(df, f"{self.folder}/{self.count}-{label}")

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
