"""What the operators share: session settings, staged tables, and the words of a text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestline.plans.staging import shared_folder
from harvestline.session import configure

# White space that separates words; the same six characters everywhere in this package.
SPACE = r"\x20\x09-\x0D"
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"

# Rows of long texts go to Python in small batches, so that a worker's memory is a batch's.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "33554432",
}


def prepare(spark: SparkSession) -> SparkSession:
    """The session settings the operators assume."""
    configure(spark)
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(df: DataFrame, rows: int, a_task: int) -> DataFrame:
    """``df``, whose size is known, in no more partitions than ``a_task`` rows each need."""
    return df.coalesce(max(1, -(-rows // a_task)))


# Whether the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Staged tables of one operator; those that are no longer read are deleted.

    A table is written once into the cluster's shared folder, so a lost executor
    costs its running tasks and nothing that is already written.  With ``tidy``,
    the shuffle files behind a table go as soon as it is written.
    """

    def __init__(self, spark: SparkSession, label: str, tidy: bool = False) -> None:
        self.spark, self.label, self.tidy = spark, label, tidy
        self._kept: list[tuple[DataFrame, str]] = []

    def path(self, step: str) -> str:
        """A new folder in the shared one."""
        return f"{shared_folder(self.spark)}/{self.label}-{step}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, step: str) -> DataFrame:
        path, before = self.path(step), self.spark.conf.get(_TIDY, "false")
        self.spark.conf.set(_TIDY, "true" if self.tidy else before)
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_TIDY, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._kept.append((kept, path))
        return kept

    def drop(self, *staged: DataFrame) -> None:
        """Delete staged tables; what was read from one before is of no use after."""
        gone = [path for df, path in self._kept if any(df is s for s in staged)]
        self._kept = [(df, path) for df, path in self._kept if path not in gone]
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in gone:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z; other letters may change too, but never into ASCII ones.

    Two characters lower to ASCII letters in Unicode (U+212A, U+0130); texts with
    them take the slower character table.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def texts_of(column) -> Iterator[str]:
    """Python texts of an Arrow column; null is empty."""
    for value in column:
        yield value.as_py() or ""
