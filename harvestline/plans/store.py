"""Where runs, shapes, tables and dead letters live.

Data is written first, under the batch that made it; the ledger row comes last.
Readers join on the ledger, so a batch that died half-way is invisible, and
writing it again replaces exactly its own partitions.

Ledger rows, shapes and columns go to the current generation.  A snapshot closes
it: what later batches need of the runs so far (a fold state, open runs, accepted
shapes, current columns) is written as a few rows a source, and the generation's
ledger rows as one sorted table of history.  From then on a batch reads one
snapshot and the generation after it, however old the ledger is.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from harvestline.model import DEAD_LETTERS, PAGES, RUNS
from harvestline.operators.landing import landed_name, read_ndjson_line
from harvestline.operators.foldstate import (
    fold_state,
    merge_states,
    newest_attempts,
    resolve,
    settled,
    still_open,
)
from harvestline.operators.ledger import failure_streaks, run_order

_LANDED = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
_BATCH = T.StructField("batch_id", T.StringType())
LEDGER = T.StructType([*RUNS.fields, T.StructField("table_name", T.StringType()), _BATCH])
SHAPES = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("type", T.StringType()),
        _BATCH,
    ]
)
COLUMNS = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("landing_type", T.StringType()),
        _BATCH,
    ]
)
# What each table version holds, by digest; a partition a first digit of the digest.
DIGESTS = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("prefix", T.StringType()),
        _BATCH,
    ]
)
OPEN_PAGES = T.StructType(
    [*PAGES.fields, T.StructField("bucket", T.IntegerType()), T.StructField("label", T.StringType())]
)
_BUCKETS = 64  # folders of kept pages an epoch
_ORDER = T.StructType(
    [T.StructField("run_time", T.TimestampType()), T.StructField("run_id", T.StringType())]
)
MADE = T.StructType([*COLUMNS.fields, T.StructField("at", _ORDER)])
# What a table has beside its records' columns.
TABLE_COLUMNS = ("_source_id", "_run_id", "_digest")
_PART = "batch"  # the folders of a table version and of the NDJSON files
DEAD = T.StructType([*DEAD_LETTERS.fields, T.StructField("table_name", T.StringType()), _BATCH])


def _bucket() -> Column:
    return F.pmod(F.xxhash64("source_id", "run_id"), F.lit(_BUCKETS)).cast("int")


def _folder(batch_id: str) -> str:
    """A batch's id as a folder's name."""
    return sha256(batch_id.encode()).hexdigest()


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(""))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._files().exists(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name)))

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, schema: T.StructType) -> None:
        df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write.mode(
            "overwrite"
        ).option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(
            self._path(name)
        )

    # --- generations ----------------------------------------------------------------------

    def generation(self) -> int:
        """The generation that batches write to: the one after the last snapshot."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._path("snapshots"))
        if not self._files().exists(folder):
            return 0
        taken = [int(f.getPath().getName()) for f in self._files().listStatus(folder)]
        return max([n + 1 for n in taken if self._exists(f"snapshots/{n}/state/_SUCCESS")], default=0)

    def _current(self, name: str, schema: T.StructType) -> DataFrame:
        return self._read(f"{name}/generation={self.generation()}", schema)

    def _append(self, df: DataFrame, name: str, schema: T.StructType) -> None:
        self._write(df, f"{name}/generation={self.generation()}", schema)

    def _snapshot(self, name: str, schema: T.StructType) -> DataFrame:
        """A table of the last snapshot, empty before the first."""
        last = self.generation() - 1
        if last < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(f"snapshots/{last}/{name}"))

    def recent_batches(self) -> int:
        """How many batches the current generation has."""
        folder = f"runs/generation={self.generation()}"
        if not self._exists(folder):
            return 0
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(folder))
        return sum(f.getPath().getName().startswith("batch_id=") for f in self._files().listStatus(path))

    def snapshot(self) -> int:
        """Settle the current generation's runs; returns the generation batches write to next.

        To be taken between batches, by whoever runs them.  One that died half-way
        is not seen and is taken again; the generation it was of is whole until
        the snapshot after it.
        """
        of = self.generation()
        recent = self._current("runs", LEDGER)
        history = recent.repartitionByRange("source_id", "run_id").sortWithinPartitions("source_id", "run_id")
        history.write.mode("overwrite").parquet(self._path(f"history/generation={of}"))

        def keep(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(self._path(f"snapshots/{of}/{name}"))

        live = self._live_runs()
        keep(self._batches().distinct(), "batches")
        keep(still_open(live).select(*LEDGER.fieldNames()), "open")
        keep(self.accepted_shape(runs=True), "shapes")
        keep(self._live_columns(), "columns")
        # The state's own mark of success makes the snapshot the one that is read.
        keep(merge_states(self._settled_state().unionByName(fold_state(settled(live)))), "state")
        older = [f"runs/generation={of - 1}", f"snapshots/{of - 1}"]
        for name in older if of else []:
            self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name)), True)
        return of + 1

    def _settled_state(self) -> DataFrame:
        return self._snapshot("state", fold_state(self.spark.createDataFrame([], LEDGER)).schema)

    def _live_runs(self) -> DataFrame:
        """The newest attempt of the runs that the last snapshot left open or that came since."""
        return newest_attempts(self._snapshot("open", LEDGER).unionByName(self._current("runs", LEDGER)))

    def _state(self) -> DataFrame:
        return merge_states(self._settled_state().unionByName(fold_state(self._live_runs())))

    def folded(self) -> DataFrame:
        """The fold of the whole ledger, out of a snapshot and what came since."""
        return resolve(self._state())

    def streaks(self) -> DataFrame:
        """Failed runs since each source's last success; those are all still open."""
        return failure_streaks(self._live_runs(), self.folded())

    # --- ledger ---------------------------------------------------------------------------

    def _rows(self) -> DataFrame:
        """Every ledger row ever written."""
        rows, now = self._current("runs", LEDGER), self.generation()
        if now:
            past = self.spark.read.schema(LEDGER).parquet(
                *[self._path(f"history/generation={n}") for n in range(now)]
            )
            rows = past.unionByName(rows)
        return rows

    def ledger(self) -> DataFrame:
        """L1: every run, the latest attempt of each."""
        return newest_attempts(self._rows())

    def append_runs(self, runs: DataFrame) -> None:
        self._append(runs, "runs", LEDGER)

    def has_batch(self, batch_id: str) -> bool:
        return not self._batches().where(F.col("batch_id") == batch_id).isEmpty()

    def _batches(self) -> DataFrame:
        known = T.StructType([_BATCH])
        return self._snapshot("batches", known).unionByName(self._current("runs", LEDGER).select("batch_id"))

    def batch(self, batch_id: str) -> DataFrame:
        """The runs of one batch, as it recorded them."""
        recent = self._current("runs", LEDGER).where(F.col("batch_id") == batch_id)
        return self._rows().where(F.col("batch_id") == batch_id) if recent.isEmpty() else recent

    def attempts_of(self, runs: DataFrame) -> DataFrame:
        """Of the named runs, result and number of the newest attempt.  Reads keys, not rows."""
        keys = self._rows().select("source_id", "run_id", "attempt", "created_at", "result")
        return newest_attempts(keys.join(runs, ["source_id", "run_id"], "left_semi"))

    def started(self) -> DataFrame:
        """What tells whether a request was carried out: ids, results and backfills of all runs."""
        return self._rows().select("source_id", "run_id", "result", "backfill_id")

    def append_shapes(self, shapes: DataFrame) -> None:
        self._append(shapes, "shapes", SHAPES)

    def accepted_shape(self, runs: bool = False) -> DataFrame:
        """The shape of each source's latest successful run that observed one; ``runs``: with the run's columns."""
        shapes = self._snapshot("shapes", SHAPES).unionByName(self._current("shapes", SHAPES))
        latest = self._state().select("source_id", F.col("shaped_run")["value"]["run_id"].alias("run_id"))
        found = shapes.join(latest, ["source_id", "run_id"], "left_semi")
        return found.select(*SHAPES.fieldNames()) if runs else found.select("source_id", "path", "type")

    def resume_points(self) -> DataFrame:
        """Where each source's next run starts."""
        return self.folded().select("source_id", "watermark")

    def append_columns(self, columns: DataFrame) -> None:
        self._append(columns, "columns", COLUMNS)

    def _live_columns(self) -> DataFrame:
        """Columns of each table's current version, by the committed batches that made them, and when those ran."""
        committed = settled(newest_attempts(self._current("runs", LEDGER)))
        when = committed.groupBy("table_name", "batch_id").agg(F.max(run_order()).alias("at"))
        recent = self._current("columns", COLUMNS).join(when, ["table_name", "batch_id"])
        made = self._snapshot("columns", MADE).unionByName(recent.select(*MADE.fieldNames()))
        current = made.groupBy("table_name").agg(F.max_by("version", "at").alias("version"))
        return made.join(current, ["table_name", "version"], "left_semi").select(*MADE.fieldNames())

    def columns(self) -> DataFrame:
        """Columns of each table's current version, which a committed run must have made."""
        return self._live_columns().select("table_name", "version", "column_name", "landing_type")

    def append_digests(self, rows: DataFrame) -> None:
        """Remember what a batch wrote, sorted so that a digest's neighbours share row groups."""
        index = rows.withColumn("prefix", F.substring("digest", 1, 1)).select(*DIGESTS.fieldNames())
        index.hint("rebalance", "prefix").sortWithinPartitions("prefix", "digest").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("prefix", "batch_id").parquet(self._path("digests"))

    def landed_digests(self, fresh: DataFrame) -> DataFrame:
        """Of the distinct ``(table_name, version, source_id, digest)`` given, those that committed runs landed.

        Reads the index, never a table's rows, and of the index the partitions and
        row groups that the given digests can be in.  What a batch wrote without
        committing doesn't count.
        """
        key = ["prefix", "table_name", "version", "source_id", "digest"]
        asked = fresh.withColumn("prefix", F.substring("digest", 1, 1)).select(*key)
        found = self._read("digests", DIGESTS).join(asked, key, "left_semi")
        committed = self._rows().where(F.col("result") == "Succeeded").select("source_id", "run_id", "batch_id")
        return (
            found.join(committed, ["source_id", "run_id", "batch_id"], "left_semi")
            .select("table_name", "source_id", "digest")
            .distinct()
        )

    def table_path(self, table_name: str, version: str) -> str:
        return self._path(f"tables/{table_name}/{version}")

    def table_part(self, table_name: str, version: str, batch_id: str) -> str:
        """Where a batch writes a table's rows; writing again replaces exactly those."""
        return f"{self.table_path(table_name, version)}/{_PART}={_folder(batch_id)}"

    def ndjson_path(self) -> str:
        return self._path("ndjson")

    def ndjson_part(self, batch_id: str) -> str:
        return f"{self.ndjson_path()}/{_PART}={_folder(batch_id)}"

    def _committed(self) -> DataFrame:
        """Runs whose rows count, by the batch that committed them."""
        return self.ledger().where(F.col("result") == "Succeeded").select(
            F.col("source_id").alias("_source_id"),
            F.col("run_id").alias("_run_id"),
            F.sha2(F.col("batch_id"), 256).alias(_PART),
        )

    def read_table(self, table_name: str) -> DataFrame:
        """Rows of a table's current version, those of committed runs only."""
        columns = self.columns().where(F.col("table_name") == table_name).sort("column_name").collect()
        if not columns:
            raise ValueError(f"table {table_name} does not exist")
        # Ids are text even where they look like numbers or dates.
        kinds = [(landed_name(c["column_name"], TABLE_COLUMNS), c["landing_type"]) for c in columns]
        schema = T.StructType(
            [
                T.StructField("_source_id", T.StringType()),
                T.StructField("_run_id", T.StringType()),
                T.StructField("_digest", T.StringType()),
                *[T.StructField(name, _LANDED[kind]) for name, kind in kinds],
            ]
        )
        path = self.table_path(table_name, columns[0]["version"])
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
        # The folder is no column, so a record's own key can't clash with it.
        folder = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), f"{_PART}=", -1)
        folder = F.substring_index(folder, "/", 1)
        packed = rows.select(
            F.struct("*").alias("row"), "_source_id", "_run_id", folder.alias(_PART)
        )
        return packed.join(self._committed(), ["_source_id", "_run_id", _PART], "left_semi").select("row.*")

    def read_ndjson(self) -> DataFrame:
        lines = self.spark.read.schema(f"value string, {_PART} string").text(self.ndjson_path())
        rows = lines.select(*read_ndjson_line(F.col("value")), _PART)
        return rows.join(self._committed(), ["_source_id", "_run_id", _PART], "left_semi").select(
            "_source_id", "_run_id", "value"
        )

    def append_dead_letters(self, letters: DataFrame) -> None:
        self._write(letters, "dead_letters", DEAD)

    def dead_letters(self) -> DataFrame:
        """Refused records of committed runs, each by the batch that committed it."""
        done = self.ledger().where(F.col("result") == "Succeeded").select("source_id", "run_id", "batch_id")
        letters = self._read("dead_letters", DEAD)
        return letters.join(done, ["source_id", "run_id", "batch_id"], "left_semi").select(
            *[f.name for f in DEAD.fields]
        )

    # --- pages of open runs -----------------------------------------------------------------

    def keep_pages(self, pages: DataFrame, label: str) -> None:
        """Add an epoch's pages of runs that are still open; written once, by the bucket of their run.

        Writing the same label again replaces what it wrote.
        """
        kept = pages.select(*PAGES.fieldNames()).withColumns({"bucket": _bucket(), "label": F.lit(label)})
        # A bucket's pages meet in few files, however many tasks read them.
        kept.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "bucket", "label"
        ).parquet(self._path("open_pages"))

    def open_pages(self, runs: DataFrame | None = None) -> DataFrame:
        """The kept pages, of the given runs (``source_id, run_id``) only; prunes to their buckets."""
        kept = self._read("open_pages", OPEN_PAGES)
        if runs is None:
            return kept.select(*PAGES.fieldNames())
        wanted = runs.select("source_id", "run_id", _bucket().alias("bucket")).distinct()
        return kept.join(wanted, ["bucket", "source_id", "run_id"], "left_semi").select(*PAGES.fieldNames())

    def open_runs(self) -> DataFrame:
        """Runs that wait for pages, with the first request of each; reads no body."""
        waiting = self._live_runs().where(F.col("result") == "Running")
        return waiting.select("source_id", "run_id", "started_at", "attempt", "batch_id")

    def forget_pages(self) -> int:
        """Delete the kept pages of runs that are over; returns how many folders went.

        To be called after the commit that ended them.  A folder holds one bucket of
        one epoch and goes when none of its runs is open; so a bucket with a run
        that stays open keeps only the folders that run has pages in.
        """
        if not self._exists("open_pages"):
            return 0
        kept = self._read("open_pages", OPEN_PAGES).select("bucket", "label", "source_id", "run_id")
        alive = kept.join(self.open_runs().select("source_id", "run_id"), ["source_id", "run_id"], "left_semi")
        alive = alive.select("bucket", "label").distinct().withColumn("alive", F.lit(True))
        folders = kept.select("bucket", "label").distinct().join(alive, ["bucket", "label"], "left")
        # One short row a folder.
        gone = folders.where(F.col("alive").isNull()).select("bucket", "label").collect()
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for row in gone:
            name = f"open_pages/bucket={row['bucket']}/label={escape(row['label'])}"
            self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name)), True)
        return len(gone)
