"""One batch of runs: any number of sources, from landed pages to ledger rows.

Pass 1 reads the pages for where each walk ends (short rows only).  Pass 2 takes
the pages apart once more and stages every record with its verdict and digest;
JSON is not parsed again after it.  Counts, high-water marks and shapes (a few
rows a run) come from the staged records, and the gate decides on those.  Only
then are tables written, each reading its own sources' row groups of the staged
records, and the ledger last.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, functions as F

from harvestline.model import REQUESTS, SHAPE_CHANGE
from harvestline.operators import drift, landing, resume, shape, walk
from harvestline.operators.chains import number_pages
from harvestline.operators.ledger import failure_message
from harvestline.operators.requestlog import page_outcomes, request_counts
from harvestline.operators.specs import with_defaults, with_violations
from harvestline.operators.status import pending_requests, suspended_sources
from harvestline.plans.staging import Staging, stage
from harvestline.plans.store import TABLE_COLUMNS, Store
from harvestline.sources.pages import (
    decode_pages,
    explode_records,
    one_answer,
    page_config,
    page_facts,
)

RUN = ["source_id", "run_id"]
_CONCURRENT_WRITES = 8


def table_name(destination: Column) -> Column:
    return F.when(
        destination["type"] == "BigQuery",
        F.concat_ws(".", destination["dataset"], destination["table"]),
    )


def known_fields(bounds: DataFrame) -> list[str]:
    """The resume fields the specs use: configuration, not data."""
    found = bounds.where(F.col("record_field").isNotNull()).select("record_field").distinct()
    return sorted(r[0] for r in found.collect())


def checked_specs(specs: DataFrame) -> DataFrame:
    """One row a source with its violations, those between sources among them."""
    rest = [c for c in specs.columns if c != "source_id"]
    once = specs.groupBy("source_id").agg(F.first(F.struct(*rest)).alias("row")).select(
        "source_id", *[F.col(f"row.{c}").alias(c) for c in rest]
    )
    declared = specs.groupBy("source_id").agg(F.count("*").alias("declared"))
    full = with_violations(with_defaults(once)).withColumn("table_name", table_name(F.col("destination")))
    full = full.join(declared, "source_id")
    ways = full.where(F.col("table_name").isNotNull()).groupBy("table_name").agg(
        F.count_distinct(F.col("destination.write_disposition")).alias("ways")
    )
    more = F.array_compact(
        F.array(
            F.when(F.col("declared") > 1, F.lit("source: declared more than once")),
            F.when(F.col("ways") > 1, F.lit("destination.write_disposition: the table's sources differ")),
        )
    )
    return full.join(ways, "table_name", "left").withColumn(
        "violations", F.array_sort(F.concat("violations", more))
    ).drop("ways", "declared")


def bound_requests(calls: DataFrame, requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Which request each run of this batch carries out, one at most.

    A run with a request's own id is that request's.  A source none of whose runs
    has one gives its first run its first pending request, backfills before
    triggers; what else is asked of it waits for a later batch.
    """
    pending = pending_requests(requests, ledger)
    exact = pending.join(calls.select(*RUN), RUN, "left_semi")
    turn = F.struct("kind", "request_id")
    waiting = (
        pending.join(exact.select("source_id"), "source_id", "left_anti")
        .groupBy("source_id")
        .agg(F.min_by(F.struct("kind", "request_id", "from_value", "to_value"), turn).alias("r"))
    )
    first_run = calls.groupBy("source_id").agg(F.min("run_id").alias("run_id"))
    loose = waiting.join(first_run, "source_id").select(*RUN, "r.*")
    asked = exact.select(*RUN, "kind", "request_id", "from_value", "to_value").unionByName(loose)
    # The same id asked for twice is one request.
    return asked.groupBy(*RUN).agg(
        F.min(F.struct("kind", "request_id", "from_value", "to_value")).alias("r")
    ).select(*RUN, "r.*")


def read_batch(
    pages: DataFrame,
    specs: DataFrame,
    bounds: DataFrame,
    targets: DataFrame | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = stage,
    ready: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Pass 1, and the plan of pass 2: staged walks, and every record read with its verdict.

    ``targets``: ``(source_id, target)`` column maps of tables that exist
    already; rows those would refuse are marked so.  ``ready`` gives, of the walks,
    those whose records are wanted.
    """
    decoded = decode_pages(one_answer(pages, keep), page_config(specs))
    walks = keep(walk.walk_runs(page_facts(decoded)), "walks")
    wanted = walks if ready is None else keep(ready(walks), "ready")
    records = explode_records(walk.keep_walked(decoded, wanted))
    marked = resume.mark_records(records, bounds, known_fields(bounds))
    if targets is None:
        return walks, marked
    reasons = F.when(
        (F.col("verdict") == "accepted") & F.col("target").isNotNull(),
        landing.row_reasons("record", "target"),
    ).otherwise(F.array().cast("array<string>"))
    checked = marked.join(targets, "source_id", "left").withColumn("reasons", reasons)
    verdict = F.when(F.size("reasons") > 0, "refused").otherwise(F.col("verdict"))
    return walks, checked.withColumn("verdict", verdict).drop("target")


def fetch_errors(pages: DataFrame) -> DataFrame:
    """The first page of each run that never got an answer, and why."""
    # A page that no walk asks for has no number and can't fail one.
    bad = page_outcomes(pages.where(F.col("page_no").isNotNull())).where(F.col("outcome").isin("terminal", "gave_up"))
    status = F.coalesce(F.col("last_status").cast("string"), F.lit("no response"))
    text = F.when(
        F.col("outcome") == "gave_up",
        F.concat(
            F.lit("giving up after "),
            F.col("attempts").cast("string"),
            F.lit(" attempts: upstream returned "),
            status,
        ),
    ).otherwise(F.concat(F.lit("upstream returned "), status))
    return bad.groupBy(*RUN).agg(F.min_by(text, "page_no").alias("fetch_error"))


def run_batch(
    store: Store,
    pages: DataFrame,
    specs: DataFrame,
    requests: DataFrame | None = None,
    *,
    batch_id: str,
    now: datetime,
    dedupe: bool | str = True,
    hold_open: bool = False,
    expire_before: datetime | None = None,
    snapshot_every: int | None = None,
) -> DataFrame:
    """Run every source that has pages in this batch; returns the ledger rows written.

    ``batch_id`` names the batch's content: one already in the ledger is not run
    again, and of any other the runs that have succeeded before are left out.
    ``dedupe`` collapses copies of a record within its run; ``"table"`` lands a
    source's record once in a table, whatever run brings it again.
    Scheduled runs of suspended sources are left out, unless ``hold_open``.
    ``requests`` holds backfills and triggers; those not carried out before are
    bound to this batch's runs, see ``bound_requests``.  With ``hold_open`` a run
    whose pages end before its result set does is not failed but ``Running``: it
    lands nothing, and is to be given again with all its pages, unless its first
    request was before ``expire_before``: then it fails for good.  Once
    ``snapshot_every`` batches have come since the last snapshot, a new one is taken.
    """
    if not store.has_batch(batch_id):
        keep = Staging(store.spark, f"batch-{batch_id}")
        try:
            _run(store, pages, specs, requests, batch_id, now, dedupe, hold_open, expire_before, keep)
        finally:
            keep.clear()
        if snapshot_every is not None and store.recent_batches() >= snapshot_every:
            store.snapshot()
    return store.batch(batch_id)


def _run(
    store: Store,
    pages: DataFrame,
    specs: DataFrame,
    requests: DataFrame | None,
    batch_id: str,
    now: datetime,
    dedupe: bool | str,
    hold_open: bool,
    expire_before: datetime | None,
    keep: Staging,
) -> None:
    spark = store.spark
    # One row a run of this batch, so the page bodies meet only a short list.
    times = pages.groupBy(*RUN).agg(
        F.min("requested_at").alias("first_request"),
        F.count_if(F.col("page_no").isNull()).alias("unnumbered"),
    )
    calls = keep(request_counts(pages).join(times, RUN), "calls")
    before = keep(
        store.attempts_of(calls.select(*RUN)).select(*RUN, "result", F.col("attempt").alias("tried")),
        "before",
    )
    done = before.where(F.col("result") == "Succeeded").select(*RUN)
    calls = keep(calls.join(done, RUN, "left_anti"), "fresh")
    pages = pages.join(calls.select(*RUN), RUN, "left_semi")

    full = keep(checked_specs(specs), "specs")
    valid = full.where(F.size("violations") == 0)
    if not calls.where(F.col("unnumbered") > 0).isEmpty():
        pages = number_pages(pages, page_config(valid), keep)
    if requests is None:
        requests = spark.createDataFrame([], REQUESTS)
    asked = keep(bound_requests(calls, requests, store.started()), "requests")
    if not hold_open:
        # What a stream brings was fetched before and would be gone; a batch can be given again.
        off = keep(suspended_sources(full, store.streaks()), "suspended")
        idle = calls.select(*RUN).join(off, "source_id", "left_semi").join(asked, RUN, "left_anti")
        calls = keep(calls.join(idle, RUN, "left_anti"), "due")
        pages = pages.join(calls.select(*RUN), RUN, "left_semi")
    runs_of_specs = valid.join(calls.select(*RUN), "source_id")
    bounds = keep(resume.resolve_bounds(runs_of_specs, store.resume_points(), asked), "bounds")

    # Tables that exist refuse rows; a table made from this batch's shape fits them all.
    existing = keep(store.columns(), "columns")
    appending = valid.where(
        (F.col("destination.write_disposition") == "Append") & F.col("table_name").isNotNull()
    )
    targets = keep(
        appending.select("source_id", "table_name").join(
            landing.column_maps(existing, ["table_name"]), "table_name"
        ).select("source_id", "target"),
        "targets",
    )
    failed = keep(fetch_errors(pages), "fetch_errors")

    def ready(walks: DataFrame) -> DataFrame:
        """All but the walks of runs that will wait: their records are read when the rest has come."""
        waiting = walks.where(F.col("walk_status") == "truncated").join(failed, RUN, "left_anti")
        if expire_before is not None:
            overdue = calls.where(F.coalesce("first_request", F.lit(now)) < F.lit(expire_before))
            waiting = waiting.join(overdue, RUN, "left_anti")
        return walks.join(waiting, RUN, "left_anti")

    walks, marked = read_batch(pages, valid, bounds, targets, keep, ready if hold_open else None)
    marked = keep(landing.with_digest(marked), "records")
    profile = keep(shape.profile_runs(marked), "profile")

    seen = profile.where(F.col("verdict").isin("accepted", "refused"))
    shapes = keep(shape.merge_shapes(seen), "shapes")
    verdicts = drift.judge(
        drift.shape_diff(shapes, store.accepted_shape()), drift.policies(valid)
    )
    prints = shape.fingerprint(shapes)
    exists = existing.select("table_name").distinct().withColumn("table_exists", F.lit(True))

    runs = (
        calls
        .join(full.select("source_id", "table_name", "destination", "violations"), "source_id")
        .join(bounds.select(*RUN, "kind", "backfill_id"), RUN, "left")
        .join(before.select(*RUN, "tried"), RUN, "left")
        .join(failed, RUN, "left")
        .join(walks.select(*RUN, "walk_status", "walk_error"), RUN, "left")
        .join(shape.summarise(profile), RUN, "left")
        .join(prints.select(*RUN, "schema_fingerprint"), RUN, "left")
        .join(
            verdicts.select(
                *RUN, "added", "removed", "changed", "unchanged", "accepted_paths", "drift_error"
            ),
            RUN,
            "left",
        )
        .join(exists, "table_name", "left")
        .join(_clashes(shapes, full, exists), RUN, "left")
    )
    zero = F.lit(0).cast("bigint")
    count = lambda c: F.coalesce(F.col(c), zero)
    no_table = (
        F.col("table_name").isNotNull()
        & F.col("table_exists").isNull()
        & ~F.col("destination.create_if_missing")
        & (count("rows_accepted") > 0)
    )
    unfinished = (F.size("violations") == 0) & F.col("fetch_error").isNull() & (
        F.coalesce(F.col("walk_status"), F.lit("truncated")) == "truncated"
    )
    expired = F.lit(False)
    if expire_before is not None:
        expired = unfinished & (F.coalesce("first_request", F.lit(now)) < F.lit(expire_before))
    waits = F.lit(hold_open) & unfinished & ~expired
    # What a failed run says.
    error = F.coalesce(
        F.when(F.size("violations") > 0, F.array_join("violations", "; ")),
        F.col("fetch_error"),
        F.when(expired, F.concat(F.lit("gave up waiting for pages: "), F.coalesce("walk_error", F.lit("no page was answered")))),
        F.when(F.col("walk_status") != "complete", F.col("walk_error")),
        F.when(F.col("walk_status").isNull(), F.lit("no page was answered")),
        F.col("drift_error"),
        F.when(
            no_table,
            F.concat(
                F.lit("table "),
                F.col("table_name"),
                F.lit(" does not exist and createIfMissing is false"),
            ),
        ),
        F.concat(F.lit("columns differ only in case: "), F.col("clash")),
    )
    # End of fixed values.
    outcome = keep(
        runs.withColumn("waits", waits).withColumn("error", F.when(~F.col("waits"), error)), "verdicts"
    )
    writable = outcome.where(
        ~F.col("waits") & F.col("error").isNull() & (count("rows_accepted") > 0)
    ).select(*RUN, "table_name")
    rows = marked.where(F.col("verdict") == "accepted").join(writable, RUN)
    if dedupe:
        rows = _without_copies(rows, keep)
    if dedupe == "table":
        rows = _not_in_tables(store, rows, full, existing, batch_id, keep)
    broken = _write_tables(store, rows, writable, shapes, full, existing, batch_id, keep)
    if dedupe == "table":
        store.append_digests(rows.where(F.col("table_name").isNotNull()).withColumn("batch_id", F.lit(batch_id)))
    _write_ndjson(store, rows, writable, batch_id)

    if broken:
        told = F.lit(None).cast("string")
        for name, text in broken.items():
            told = F.when(F.col("table_name") == name, F.lit(text)).otherwise(told)
        took_part = count("rows_accepted") > 0
        outcome = outcome.withColumn(
            "error", F.coalesce("error", F.when(~F.col("waits") & took_part, told))
        )
    reported = ~F.coalesce(F.col("unchanged"), F.lit(True))
    change = F.when(reported, F.struct(*SHAPE_CHANGE.fieldNames()))
    waiting, ok = F.col("waits"), F.col("error").isNull() & ~F.col("waits")
    outcome = keep(
        outcome.select(
            *RUN,
            (F.coalesce("tried", F.lit(0)) + 1).alias("attempt"),
            F.coalesce("kind", F.lit("scheduled")).alias("kind"),
            "backfill_id",
            F.lit(now).alias("created_at"),
            F.coalesce("first_request", F.lit(now)).alias("started_at"),
            F.when(ok, F.lit(now)).alias("completed_at"),
            F.when(waiting, "Running").when(ok, "Succeeded").otherwise("Failed").alias("result"),
            F.when(ok, count("rows_accepted")).otherwise(0).alias("rows_ingested"),
            F.when(waiting, 0)
            .otherwise(count("rows_rejected") + F.when(ok, count("rows_refused")).otherwise(0))
            .alias("rows_rejected"),
            F.when(waiting, 0).otherwise(count("rows_skipped")).alias("rows_skipped"),
            "request_count",
            F.when(~waiting, F.col("high_water")).alias("watermark"),
            F.when(~waiting, F.col("schema_fingerprint")).alias("schema_fingerprint"),
            F.when(~waiting, change).alias("schema_change"),
            "error",
            F.when(
                ~waiting,
                failure_message(
                    F.col("error"), change, F.lit(None).cast("string"), F.lit(None).cast("string"), ~ok
                ),
            ).alias("message"),
            "table_name",
            F.lit(batch_id).alias("batch_id"),
        ),
        "outcome",
    )
    _write_dead_letters(store, marked, outcome, full, now, batch_id)
    over = outcome.where(F.col("result") != "Running").select(*RUN)
    store.append_shapes(shapes.join(over, RUN, "left_semi").withColumn("batch_id", F.lit(batch_id)))
    store.append_runs(outcome)


def _clashes(shapes: DataFrame, specs: DataFrame, exists: DataFrame) -> DataFrame:
    """K6: runs that bring keys to a table to be made which differ only in case, from whichever run."""
    tables = specs.where(F.col("table_name").isNotNull()).select(
        "source_id", "table_name", F.col("destination.write_disposition").alias("way")
    )
    made = tables.join(exists, "table_name", "left").where(
        F.col("table_exists").isNull() | (F.col("way") == "Truncate")
    )
    brought = shapes.join(made.select("source_id", "table_name"), "source_id")
    names = landing.clashing_names(brought, ["table_name"])
    mine = brought.select(*RUN, "table_name", "path").withColumn("folded", F.lower("path"))
    return mine.join(names, ["table_name", "folded"]).groupBy(*RUN).agg(
        F.min(F.array_join("names", ", ")).alias("clash")
    )


def _without_copies(rows: DataFrame, keep: Staging) -> DataFrame:
    """Copies of a record within a run collapse; only digests are shuffled to find them."""
    index = landing.digest_index(rows, RUN)
    repeated = keep(index.where(F.col("copies") > 1), "copies")
    return landing.first_copies(rows, repeated, RUN)


def _not_in_tables(
    store: Store, rows: DataFrame, specs: DataFrame, existing: DataFrame, batch_id: str, keep: Staging
) -> DataFrame:
    """Rows of no table, and of the others those whose record their table doesn't hold yet, with its ``version``.

    A record that several runs of the batch bring goes with the first of them.
    What is compared are digests; a table that is new or truncated holds nothing.
    """
    appending = specs.where(F.col("destination.write_disposition") == "Append").select("table_name").distinct()
    versions = existing.select("table_name", "version").distinct().join(appending, "table_name", "left_semi")
    key = ["table_name", "source_id", "digest"]
    named = rows.where(F.col("table_name").isNotNull())
    index = named.groupBy(*key).agg(F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"))
    index = keep(index.join(versions, "table_name", "left"), "fresh_digests")
    landed = keep(store.landed_digests(index.where(F.col("version").isNotNull())), "landed_digests")
    several = keep(index.where(F.col("first_run") < F.col("last_run")).select(*key, "first_run"), "several_runs")
    once = named.join(several, key, "left").where(
        F.col("first_run").isNull() | (F.col("run_id") == F.col("first_run"))
    )
    new = once.drop("first_run").join(landed, key, "left_anti").join(versions, "table_name", "left")
    new = new.withColumn("version", F.coalesce("version", F.lit(f"v-{batch_id}")))
    plain = rows.where(F.col("table_name").isNull()).withColumn("version", F.lit(None).cast("string"))
    return plain.unionByName(new)


def _write_tables(
    store: Store,
    rows: DataFrame,
    writable: DataFrame,
    shapes: DataFrame,
    specs: DataFrame,
    existing: DataFrame,
    batch_id: str,
    keep: Staging,
) -> dict[str, str]:
    """One write per destination table that has rows; gives the tables that failed, and why.

    What is collected is the column list of those tables: as many names as the
    tables have columns.  A table that can't be written fails its own runs only.
    """
    disposition = F.col("destination.write_disposition")
    active = writable.where(F.col("table_name").isNotNull()).join(
        specs.select("source_id", disposition.alias("disposition")), "source_id"
    )
    per_table = active.groupBy("table_name").agg(
        F.max(F.col("disposition") == "Truncate").alias("truncate"),
        F.sort_array(F.collect_set("source_id")).alias("sources"),
    )
    fresh_shape = (
        shapes.join(active.select(*RUN, "table_name"), RUN)
        .groupBy("table_name", "path")
        .agg(F.collect_set("type").alias("types"))
        .select("table_name", "path", shape.merged_type(F.col("types")).alias("type"))
    )
    fresh = landing.table_columns(fresh_shape, ["table_name"])
    # A table keeps its columns unless it is new or this batch truncates it.
    old = existing.join(per_table.where(~F.col("truncate")), "table_name", "left_semi")
    new = fresh.join(old.select("table_name").distinct(), "table_name", "left_anti").select(
        "table_name", F.lit(f"v-{batch_id}").alias("version"), "column_name", "landing_type"
    )
    new = keep(new.withColumn("batch_id", F.lit(batch_id)), "new_columns")
    layout = (
        old.unionByName(new.drop("batch_id"))
        .groupBy("table_name", "version")
        .agg(F.sort_array(F.collect_list(F.struct("column_name", "landing_type"))).alias("columns"))
        .join(per_table, "table_name")
        .collect()
    )

    def write_one(table: Row) -> tuple[str, str] | None:
        columns = [(c["column_name"], c["landing_type"]) for c in table["columns"]]
        mine = rows.where(F.col("source_id").isin(table["sources"])).select(
            F.col("source_id").alias("_source_id"),
            F.col("run_id").alias("_run_id"),
            F.col("digest").alias("_digest"),
            "record",
        )
        typed = landing.typed_rows(mine, columns, list(TABLE_COLUMNS))
        # Rows of a run meet in few files; a hot run is split again by size.
        typed = typed.hint("rebalance", "_source_id", "_run_id")
        try:
            # One folder a batch: one a run would be as many files as runs, made and moved one by one.
            typed.write.mode("overwrite").parquet(store.table_part(table["table_name"], table["version"], batch_id))
        except PySparkException as failed:
            return table["table_name"], f"write {table['table_name']}: {failed.getCondition() or failed}"

    # Tables are independent jobs; a few at a time keep the cluster busy through their tails.
    with ThreadPoolExecutor(_CONCURRENT_WRITES) as pool:
        broken = dict(filter(None, pool.map(write_one, layout)))
    if layout:
        good = new.where(~F.col("table_name").isin(list(broken))) if broken else new
        store.append_columns(good)
    return broken


def _write_ndjson(store: Store, rows: DataFrame, writable: DataFrame, batch_id: str) -> None:
    """K1: records of sources without a table, one JSON document a line with the run it is of."""
    plain = writable.where(F.col("table_name").isNull())
    if plain.isEmpty():
        return
    mine = rows.where(F.col("table_name").isNull())
    mine.select(landing.ndjson_line(F.col("source_id"), F.col("run_id"), F.col("record"))).write.mode(
        "overwrite"
    ).text(store.ndjson_part(batch_id))


def _write_dead_letters(
    store: Store, marked: DataFrame, outcome: DataFrame, specs: DataFrame, now: datetime, batch_id: str
) -> None:
    """Refused rows and non-objects of committed runs that have somewhere to put them."""
    wanted = specs.where(F.coalesce("destination.dead_letter_table", F.lit("")) != "").select(
        "source_id",
        F.concat_ws(".", "destination.dataset", "destination.dead_letter_table").alias("dead_table"),
    )
    runs = outcome.where((F.col("result") == "Succeeded") & (F.col("rows_rejected") > 0)).select(*RUN)
    takers = runs.join(wanted, "source_id")
    if takers.isEmpty():
        return
    refused = marked.where(F.col("verdict").isin("refused", "rejected")).join(takers, RUN)
    refused = refused.withColumn(
        "reasons",
        F.when(F.col("verdict") == "rejected", F.array(F.lit("record is not an object"))).otherwise(
            F.col("reasons")
        ),
    )
    letters = landing.dead_letters(
        refused, F.lit(now), extra=[F.col("dead_table").alias("table_name")]
    )
    store.append_dead_letters(letters.withColumn("batch_id", F.lit(batch_id)))
