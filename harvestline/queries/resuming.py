"""Resume bounds, filters, high-water marks and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestline.operators import resume
from harvestline.operators.shape import profile_runs, summarise
from harvestline.plans.run import read_batch
from harvestline.plans.staging import stage
from harvestline.queries import inputs
from harvestline.queries.book import Book
from harvestline.queries.fetching import walked_event_records

BOOK = Book()

_FROM = "2024-01-10T06:00:00Z"
_TO = "2024-01-20T08:30:00+02:30"
_FROM_SQL = "TIMESTAMP '2024-01-10 06:00:00'"
_TO_SQL = "TIMESTAMP '2024-01-20 06:00:00'"


def bounds_for(
    spark: SparkSession,
    sf_dir: str,
    fmt: str = "RFC3339",
    field: str = "updated_at",
    since: str | None = _FROM,
    until: str | None = None,
) -> DataFrame:
    """The same range for every event source, resolved from specs, status and requests."""
    specs = inputs.event_specs(
        spark,
        sf_dir,
        watermark=f"named_struct('record_field', '{field}', 'param', 'since', 'format', '{fmt}')",
    )
    ids = specs.select("source_id")
    status = ids.withColumn("watermark", F.lit(since if until is None else "2024-01-29T00:00:00Z"))
    asked = ids.select(
        "source_id",
        F.lit("january").alias("request_id"),
        F.lit(since).cast("string").alias("from_value"),
        F.lit(until).cast("string").alias("to_value"),
    )
    if until is None:
        asked = asked.where(F.lit(False))
    return stage(resume.resolve_bounds(specs, status, asked), "bounds")


def _marked(spark, sf_dir, **kwargs) -> DataFrame:
    bounds = bounds_for(spark, sf_dir, **kwargs)
    field = [kwargs.get("field", "updated_at")]
    return resume.mark_records(walked_event_records(spark, sf_dir), bounds, field)


def _kept(marked: DataFrame) -> DataFrame:
    return marked.where(F.col("verdict") == "accepted").select(
        "source_id", "run_id", "page_no", "record_pos", "resume_value"
    )


def _kept_oracle(value: str, where: str) -> str:
    return f"""WITH {inputs.EVENTS_CTE}
    SELECT source_id, run_id, page_no, CAST(record_pos AS INTEGER) AS record_pos,
      {value} AS resume_value
    FROM ev WHERE is_object AND ({where})"""


_VALUE = "CASE WHEN has_value THEN resume_text END"


@BOOK.add("resume_filter_rfc3339", _kept_oracle(_VALUE, f"NOT has_key OR seen_at > {_FROM_SQL}"))
def resume_filter_rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_marked(spark, sf_dir))


@BOOK.add(
    "resume_backfill_range",
    _kept_oracle(_VALUE, f"NOT has_key OR (seen_at > {_FROM_SQL} AND seen_at <= {_TO_SQL})"),
)
def resume_backfill_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_marked(spark, sf_dir, until=_TO))


@BOOK.add("resume_filter_unix", _kept_oracle("CAST(event_id AS STRING)", "event_id > 400"))
def resume_filter_unix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The numeric id stands in for seconds, so the value is read from a JSON number.
    return _kept(_marked(spark, sf_dir, fmt="UnixSeconds", field="id", since="400"))


@BOOK.add(
    "resume_fail_open",
    f"""WITH {inputs.EVENTS_CTE}
    SELECT source_id, run_id, count(*) AS kept,
      count(*) FILTER (NOT has_value) AS without_value,
      count(*) FILTER (has_value AND NOT has_key) AS unreadable
    FROM ev WHERE is_object GROUP BY ALL""",
)
def resume_fail_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored value that cannot be read filters nothing out."""
    marked = _marked(spark, sf_dir, since="a while ago").where(F.col("verdict") == "accepted")
    return marked.groupBy("source_id", "run_id").agg(
        F.count("*").alias("kept"),
        F.count_if(F.col("resume_value").isNull()).alias("without_value"),
        F.count_if(F.col("resume_value").isNotNull() & F.col("resume_key").isNull()).alias(
            "unreadable"
        ),
    )


@BOOK.add("resume_opaque", _kept_oracle(_VALUE, "true"))
def resume_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_marked(spark, sf_dir, fmt="Opaque", since="zzz"))


@BOOK.add(
    "resume_full_pull",
    f"""WITH {inputs.EVENTS_CTE}
    SELECT source_id, run_id, count(*) AS kept, CAST(NULL AS STRING) AS high_water
    FROM ev WHERE is_object GROUP BY ALL""",
)
def resume_full_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = inputs.event_specs(spark, sf_dir, watermark="NULL")
    nothing = specs.select(
        "source_id",
        F.lit("x").alias("request_id"),
        F.lit("x").alias("from_value"),
        F.lit("x").alias("to_value"),
        F.lit("2024-01-15T00:00:00Z").alias("watermark"),
    )
    bounds = stage(resume.resolve_bounds(specs, nothing, nothing.where("false")), "bounds")
    marked = resume.mark_records(walked_event_records(spark, sf_dir), bounds)
    counts = resume.run_counts(marked).select("source_id", "run_id", F.col("rows_accepted").alias("kept"))
    return counts.join(resume.high_water(marked), ["source_id", "run_id"])


@BOOK.add(
    "resolve_bounds",
    """SELECT 'c' || lpad(CAST(c_custkey AS STRING), 7, '0') AS source_id,
      CASE WHEN c_custkey % 4 = 0 THEN 'backfill' ELSE 'scheduled' END AS kind,
      CASE WHEN c_custkey % 4 = 0 THEN 'b' || CAST(c_custkey AS STRING) END AS backfill_id,
      CASE WHEN c_custkey % 7 <> 0 THEN 'at' END AS record_field,
      CASE WHEN c_custkey % 7 <> 0 THEN 'UnixSeconds' END AS format,
      CASE WHEN c_custkey % 7 = 0 THEN NULL
        WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 8 = 0 THEN '100' END
        WHEN c_custkey % 3 = 0 THEN CAST(c_custkey + 500 AS STRING)
        WHEN c_custkey % 5 = 0 THEN '50' END AS from_value,
      CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 4 = 0 THEN '200' END AS to_value
    FROM customer""",
)
def resolve_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    keyed = c.select(
        n, F.concat(F.lit("c"), F.lpad(n.cast("string"), 7, "0")).alias("source_id")
    )
    specs = keyed.select(
        "source_id",
        F.when(
            n % 7 != 0,
            F.struct(
                F.lit("at").alias("record_field"),
                F.lit("UnixSeconds").alias("format"),
                F.when(n % 5 == 0, "50").otherwise("").alias("initial_value"),
            ),
        ).alias("watermark"),
    )
    # An empty stored value counts as none.
    status = keyed.select(
        "source_id",
        F.when(n % 3 == 0, (n + 500).cast("string")).when(n % 3 == 1, "").alias("watermark"),
    )
    asked = keyed.where(n % 4 == 0).select(
        "source_id",
        F.concat(F.lit("b"), n.cast("string")).alias("request_id"),
        F.when(n % 8 == 0, "100").otherwise("").alias("from_value"),
        F.lit("200").alias("to_value"),
    )
    return resume.resolve_bounds(specs, status, asked)


@BOOK.add(
    "reject_non_object",
    f"""WITH {inputs.EVENTS_CTE}
    SELECT source_id, run_id, count(*) AS records, count(*) FILTER (NOT is_object) AS rows_rejected
    FROM ev GROUP BY ALL""",
)
def reject_non_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestline.functions.variants import is_object

    return (
        walked_event_records(spark, sf_dir)
        .groupBy("source_id", "run_id")
        .agg(
            F.count("*").alias("records"),
            F.count_if(~is_object(F.col("record"))).alias("rows_rejected"),
        )
    )


_NEW = f"is_object AND (NOT has_key OR seen_at > {_FROM_SQL})"


@BOOK.add(
    "high_water",
    f"""WITH {inputs.EVENTS_CTE}
    SELECT source_id, run_id, arg_max(resume_text, seen_at) FILTER (has_key AND {_NEW}) AS high_water
    FROM ev GROUP BY ALL""",
)
def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.high_water(_marked(spark, sf_dir))


@BOOK.add(
    "opaque_last",
    f"""WITH {inputs.EVENTS_CTE}
    SELECT source_id, run_id, arg_max(resume_text, event_id) FILTER (has_value) AS high_water
    FROM ev GROUP BY ALL""",
)
def opaque_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.high_water(_marked(spark, sf_dir, fmt="Opaque", since="zzz"))


@BOOK.add(
    "run_counts",
    f"""WITH {inputs.EVENTS_CTE}
    SELECT source_id, run_id, count(*) FILTER ({_NEW}) AS rows_accepted,
      count(*) FILTER (NOT is_object) AS rows_rejected,
      count(*) FILTER (is_object AND NOT ({_NEW})) AS rows_skipped
    FROM ev GROUP BY ALL""",
)
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.run_counts(_marked(spark, sf_dir))


@BOOK.add(
    "incremental_runs",
    f"""WITH {inputs.EVENTS_CTE}
    SELECT source_id, run_id, CAST(count(*) FILTER ({_NEW}) AS BIGINT) AS rows_ingested,
      CAST(count(*) FILTER (NOT is_object) AS BIGINT) AS rows_rejected,
      CAST(count(*) FILTER (is_object AND NOT ({_NEW})) AS BIGINT) AS rows_skipped,
      arg_max(resume_text, seen_at) FILTER (has_key AND {_NEW}) AS high_water
    FROM ev GROUP BY ALL""",
)
def incremental_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: landed pages to what every run brought in, in one pass over the records."""
    _, marked = read_batch(
        inputs.event_pages(spark, sf_dir),
        inputs.event_specs(spark, sf_dir),
        bounds_for(spark, sf_dir),
    )
    return summarise(profile_runs(marked)).select(
        "source_id",
        "run_id",
        F.col("rows_accepted").alias("rows_ingested"),
        "rows_rejected",
        "rows_skipped",
        "high_water",
    )
