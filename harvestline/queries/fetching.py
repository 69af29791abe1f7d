"""Pages, walks, request plans and request-log audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harvestline.functions.variants import dotted_text
from harvestline.operators import chains, requestlog, walk
from harvestline.plans.staging import stage
from harvestline.queries import inputs
from harvestline.queries.book import Book
from harvestline.sources import pages as pg
from harvestline.sources import requests as rq

BOOK = Book()


def walked_event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed event pages, decoded, walked to their end, and taken apart."""
    landed = inputs.event_pages(spark, sf_dir)
    decoded = pg.decode_pages(
        pg.responses(landed), pg.page_config(inputs.event_specs(spark, sf_dir))
    )
    walks = stage(walk.walk_runs(pg.page_facts(decoded)), "walks")
    return pg.explode_records(walk.keep_walked(decoded, walks))


@BOOK.add(
    "land_pages",
    f"""WITH {inputs.EVENTS_CTE}
    SELECT source_id, run_id, page_no,
      '{{"data":{{"items":[' || string_agg(record, ',' ORDER BY event_id) || ']}},"meta":{{'
      || CASE WHEN page_no < max(page_no) OVER (PARTITION BY source_id, run_id)
        THEN '"next_cursor":"' || CAST(page_no AS STRING) || '"' ELSE '' END
      || '}}}}' AS body
    FROM ev GROUP BY source_id, run_id, page_no""",
)
def land_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.event_pages(spark, sf_dir).select("source_id", "run_id", "page_no", "body")


@BOOK.add(
    "extract_records",
    f"""WITH {inputs.EVENTS_CTE}
    SELECT source_id, run_id, page_no, CAST(record_pos AS INTEGER) AS record_pos,
      CASE WHEN is_object THEN event_id END AS id
    FROM ev""",
)
def extract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walked_event_records(spark, sf_dir).select(
        "source_id",
        "run_id",
        "page_no",
        "record_pos",
        dotted_text(F.col("record"), "id").cast("bigint").alias("id"),
    )


@BOOK.add(
    "extract_path_string",
    f"""WITH {inputs.EVENTS_CTE}
    SELECT event_id, CASE WHEN is_object THEN CAST(cents AS STRING) END AS amount,
      CASE WHEN is_object AND event_id % 13 <> 0
        THEN 'u' || CAST(user_id AS STRING) || '@example.invalid' END AS email,
      CASE WHEN is_object THEN k END AS k,
      CASE WHEN is_object AND event_id % 7 <> 0 THEN CAST(user_id AS STRING) END AS n,
      CAST(NULL AS STRING) AS nested, CAST(NULL AS STRING) AS missing
    FROM ev""",
)
def extract_path_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = inputs.event_records(spark, sf_dir).select(
        "event_id", F.try_parse_json("record").alias("v")
    )
    at = lambda path: dotted_text(F.col("v"), path)
    return parsed.select(
        "event_id",
        at("amount").alias("amount"),
        at("email").alias("email"),
        at("meta.k").alias("k"),
        at("meta.n").alias("n"),
        at("meta").alias("nested"),
        at("meta.k.deeper").alias("missing"),
    )


# --- walks --------------------------------------------------------------------------------

_WALK_SQL = """
  capped AS (SELECT *, row_number() OVER (PARTITION BY source_id, run_id ORDER BY page_no) AS rn
    FROM facts WHERE page_no <= {cap}),
  ends AS (SELECT source_id, run_id, min(page_no) FILTER (terminal AND NOT bad) AS stop,
      min(page_no) FILTER (bad) AS err, count(*) FILTER (page_no = rn) AS reach
    FROM capped GROUP BY ALL),
  walks AS (SELECT *, CASE WHEN coalesce(err <= reach AND (stop IS NULL OR err < stop), false)
        THEN 'failed'
      WHEN NOT {supported} THEN 'unsupported'
      WHEN coalesce(stop <= reach, false) THEN 'complete'
      WHEN reach >= {cap} THEN 'max_pages_exceeded' ELSE 'truncated' END AS walk_status
    FROM ends),
  ended AS (SELECT *, CASE walk_status WHEN 'complete' THEN stop WHEN 'failed' THEN err - 1
      WHEN 'unsupported' THEN least(reach, 1) ELSE reach END AS end_page FROM walks)
  SELECT e.source_id, e.run_id, e.walk_status, CAST(e.end_page AS INTEGER) AS end_page,
    CAST(coalesce(sum(f.n), 0) AS BIGINT) AS records
  FROM ended e LEFT JOIN facts f ON f.source_id = e.source_id AND f.run_id = e.run_id
    AND f.page_no <= e.end_page
  GROUP BY ALL"""


def _walk_oracle(terminal: str, bad: str = "false", cap: int = 1000, supported: str = "true", drop: str = "false") -> str:
    return (
        f"WITH {inputs.ORDER_PAGES_CTE}, facts AS (SELECT source_id, run_id, page_no, n,"
        f" {terminal} AS terminal, {bad} AS bad FROM op WHERE NOT ({drop})),"
        + _WALK_SQL.format(cap=cap, supported=supported)
    )


def _walked(landed: DataFrame, config: DataFrame) -> DataFrame:
    """Walk outcome of every run with the number of records it read."""
    decoded = pg.decode_pages(pg.responses(landed), config)
    walks = stage(walk.walk_runs(pg.page_facts(decoded)), "walks")
    kept = pg.explode_records(walk.keep_walked(decoded, walks))
    counts = kept.groupBy("source_id", "run_id").agg(F.count("*").alias("records"))
    return walks.join(counts, ["source_id", "run_id"], "left").select(
        "source_id",
        "run_id",
        "walk_status",
        "end_page",
        F.coalesce("records", F.lit(0)).alias("records"),
    )


def _items(extra=None):
    tail = F.lit("}") if extra is None else F.concat(extra, F.lit("}"))
    return F.concat(F.lit('{"items":'), F.col("items"), tail)


def _kind() -> Column:
    return F.col("kind")


def _page() -> Column:
    return F.col("page_no")


# Runs of kind 0 end at page 7, 1 repeat a cursor from page 5 on, 2 miss page 4,
# 3 break on page 6, 4 never end; the cap is 12 pages.
@BOOK.add(
    "walk_cursor",
    _walk_oracle(
        "(kind = 0 AND page_no = 7) OR (kind = 1 AND page_no >= 6)",
        bad="kind = 3 AND page_no = 6",
        cap=12,
        drop="kind = 2 AND page_no = 4",
    ),
)
def walk_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = inputs.order_pages(spark, sf_dir).where(~((_kind() == 2) & (_page() == 4)))
    own = F.format_string("c%d", _page())
    token = F.when((_kind() == 1) & (_page() >= 5), F.lit("same")).when(
        ~((_kind() == 0) & (_page() == 7)), own
    )
    sent = F.when((_kind() == 1) & (_page() >= 6), F.lit("same")).when(
        _page() > 1, F.format_string("c%d", _page() - 1)
    )
    meta = F.coalesce(F.concat(F.lit(',"meta":{"next":"'), token, F.lit('"}')), F.lit(""))
    body = F.when((_kind() == 3) & (_page() == 6), F.lit('{"items":[')).otherwise(_items(meta))
    landed = inputs.as_landed(grouped, body, cursor=sent)
    config = inputs.order_sources(
        grouped, pagination_type="Cursor", next_cursor_path="meta.next", max_pages=12
    )
    return _walked(landed, config)


@BOOK.add("walk_page_number", _walk_oracle("n < 12"))
def walk_page_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = inputs.order_pages(spark, sf_dir)
    config = inputs.order_sources(grouped, pagination_type="PageNumber", page_size=12)
    return _walked(inputs.as_landed(grouped, _items()), config)


@BOOK.add("walk_offset", _walk_oracle("n < 14", bad="kind = 1 AND page_no = 3", cap=15))
def walk_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = inputs.order_pages(spark, sf_dir)
    # A page whose records are an object, not an array, is in error.
    body = F.when((_kind() == 1) & (_page() == 3), F.lit('{"items":{"id":1}}')).otherwise(_items())
    config = inputs.order_sources(grouped, pagination_type="Offset", page_size=14, max_pages=15)
    return _walked(inputs.as_landed(grouped, body), config)


@BOOK.add(
    "walk_link",
    _walk_oracle("(kind = 0 AND page_no >= 5) OR (kind = 1 AND page_no >= 9) OR kind = 2", cap=18),
)
def walk_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = inputs.order_pages(spark, sf_dir)
    target = F.format_string("https://vendor.invalid/?p=%d", _page() + 1)
    following = F.concat(
        F.lit('<https://vendor.invalid/?p=99>; rel="last", <'), target, F.lit('>; rel="next"')
    )
    plain = F.concat(F.lit("<"), target, F.lit(">;title=x; rel=next"))
    link = (
        F.when(_kind() == 2, F.lit("garbage"))
        .when((_kind() == 0) & (_page() >= 5), F.lit('<https://vendor.invalid/?p=9>; rel="last"'))
        .when((_kind() == 1) & (_page() >= 9), F.lit(""))
        .when(_kind() == 3, plain)
        .otherwise(following)
    )
    config = inputs.order_sources(grouped, pagination_type="LinkHeader", max_pages=18)
    return _walked(inputs.as_landed(grouped, _items(), link=link), config)


@BOOK.add("walk_none", _walk_oracle("true"))
def walk_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = inputs.order_pages(spark, sf_dir)
    return _walked(inputs.as_landed(grouped, _items()), inputs.order_sources(grouped))


@BOOK.add("walk_unsupported", _walk_oracle("false", supported="false"))
def walk_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = inputs.order_pages(spark, sf_dir)
    config = inputs.order_sources(grouped, pagination_type="Spiral")
    return _walked(inputs.as_landed(grouped, _items()), config)


# The pages of walk_cursor without numbers, in no order, every third one landed twice.  Runs of
# kind 1 go round pages 5, 6 and 7 for ever.
@BOOK.add(
    "walk_chain",
    f"""WITH RECURSIVE {inputs.ORDER_PAGES_CTE}, edges AS (
      SELECT source_id, run_id, n, kind = 3 AND page_no = 6 AS bad,
        CASE WHEN page_no > 1 THEN 'c' || CAST(page_no - 1 AS STRING) ELSE '' END AS key,
        CASE WHEN (kind = 0 AND page_no = 7) OR (kind = 3 AND page_no = 6) THEN NULL
          WHEN kind = 1 AND page_no = 7 THEN 'c4' ELSE 'c' || CAST(page_no AS STRING) END AS after
      FROM op WHERE NOT (kind = 2 AND page_no = 4)),
    walk AS (SELECT *, 1 AS step FROM edges WHERE key = ''
      UNION ALL SELECT e.*, step + 1 FROM walk w JOIN edges e ON e.source_id = w.source_id
        AND e.run_id = w.run_id AND e.key = w.after WHERE step < 12),
    ends AS (SELECT source_id, run_id, count(DISTINCT key) FILTER (NOT bad) AS reach, max(step) AS steps,
        bool_or(bad) AS failed, bool_or(after IS NULL AND NOT bad) AS done FROM walk GROUP BY ALL),
    read AS (SELECT source_id, run_id, sum(n) AS records FROM
      (SELECT DISTINCT source_id, run_id, key, n FROM walk WHERE NOT bad) GROUP BY ALL)
    SELECT r.source_id, r.run_id, CASE WHEN failed THEN 'failed' WHEN done THEN 'complete'
        WHEN steps = 12 THEN 'max_pages_exceeded' ELSE 'truncated' END AS walk_status,
      CAST(coalesce(reach, 0) AS INTEGER) AS end_page, CAST(coalesce(records, 0) AS BIGINT) AS records
    FROM (SELECT DISTINCT source_id, run_id FROM edges) r
      LEFT JOIN ends e ON e.source_id = r.source_id AND e.run_id = r.run_id
      LEFT JOIN read d ON d.source_id = r.source_id AND d.run_id = r.run_id""",
)
def walk_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = inputs.order_pages(spark, sf_dir).where(~((_kind() == 2) & (_page() == 4)))
    token = F.when((_kind() == 1) & (_page() == 7), F.lit("c4")).when(
        ~((_kind() == 0) & (_page() == 7)), F.format_string("c%d", _page())
    )
    sent = F.when(_page() > 1, F.format_string("c%d", _page() - 1))
    meta = F.coalesce(F.concat(F.lit(',"meta":{"next":"'), token, F.lit('"}')), F.lit(""))
    body = F.when((_kind() == 3) & (_page() == 6), F.lit('{"items":[')).otherwise(_items(meta))
    config = inputs.order_sources(
        grouped, pagination_type="Cursor", next_cursor_path="meta.next", max_pages=12
    )
    twice = F.explode(F.when(_page() % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    landed = inputs.as_landed(grouped, body, cursor=sent).withColumn("copy", twice).drop("copy")
    loose = landed.withColumn("page_no", F.lit(None).cast("int")).repartition(F.xxhash64("body"))
    return _walked(pg.one_answer(chains.number_pages(loose, config)), config)


# --- requests -----------------------------------------------------------------------------


@BOOK.add(
    "request_plan",
    """WITH c AS (SELECT c_custkey AS n, 'c' || lpad(CAST(c_custkey AS STRING), 7, '0') AS source_id,
        c_custkey % 3 AS style FROM customer),
      steps AS (SELECT *, unnest(range(CASE WHEN style = 0 THEN 1 ELSE 1 + n % 5 END)) AS i FROM c)
    SELECT source_id, CAST(i AS INTEGER) AS page_index,
      CASE WHEN style = 0 AND n % 9 = 0 THEN 'https://vendor.invalid/next?id=' || CAST(n AS STRING)
        ELSE 'https://vendor.invalid/v1/items?'
          || CASE WHEN style = 0 THEN 'cursor=cur%2F' || CAST(n AS STRING) || '&' ELSE '' END
          || 'fixed=a+b%2Ac'
          || CASE style WHEN 1 THEN '&page=' || CAST((CASE WHEN n % 4 = 0 THEN 1 ELSE n % 4 END) + i AS STRING)
               WHEN 2 THEN '&page=' || CAST(n % 4 + i * 50 AS STRING) ELSE '' END
          || CASE WHEN n % 2 = 0 THEN '&since=2024-01-0' || CAST(n % 7 + 1 AS STRING) || 'T00%3A00%3A00Z' ELSE '' END
          || '&size=50'
          || CASE WHEN n % 5 = 0 THEN '&until=2024-02-01T00%3A00%3A00Z' ELSE '' END
          || '&v=2'
        END AS url
    FROM steps""",
)
def request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("n"),
        F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("source_id"),
        (F.col("c_custkey") % 3).alias("style"),
    )
    style, n = F.col("style"), F.col("n")
    specs = inputs.shaped(
        c.select(
            "source_id",
            F.struct(
                F.lit("https://vendor.invalid/v1/items?v=1&fixed=old").alias("url"),
                F.create_map(
                    F.lit("v"), F.lit("2"), F.lit("fixed"), F.lit("a b*c")
                ).alias("query"),
                F.struct(
                    F.when(style == 0, "Cursor")
                    .when(style == 1, "PageNumber")
                    .otherwise("Offset")
                    .alias("type"),
                    F.lit("cursor").alias("cursor_param"),
                    F.lit("page").alias("page_param"),
                    F.lit("size").alias("size_param"),
                    F.lit(50).alias("page_size"),
                    (n % 4).cast("int").alias("start_page"),
                ).alias("pagination"),
            ).alias("source"),
            F.struct(
                F.lit("at").alias("record_field"),
                F.lit("since").alias("param"),
                F.lit("until").alias("to_param"),
            ).alias("watermark"),
        ),
        _plan_schema(),
    )
    bounds = c.select(
        "source_id",
        F.when(n % 2 == 0, F.format_string("2024-01-0%dT00:00:00Z", n % 7 + 1)).alias("from_value"),
        F.when(n % 5 == 0, F.lit("2024-02-01T00:00:00Z")).alias("to_value"),
    )
    counts = c.select("source_id", (n % 5 + 1).cast("int").alias("pages"))
    counted = rq.counted_steps(specs.join(counts, "source_id"), F.col("pages"))
    cursors = c.where(style == 0).select(
        "source_id",
        F.lit(0).alias("page_index"),
        F.format_string("cur/%d", n).alias("cursor"),
        F.when(n % 9 == 0, F.format_string("https://vendor.invalid/next?id=%d", n)).alias("next_url"),
    )
    return rq.plan_requests(specs, bounds, counted.unionByName(cursors))


def _plan_schema():
    from pyspark.sql import types as T

    from harvestline.model import SPECS

    return T.StructType([f for f in SPECS.fields if f.name in ("source_id", "source", "watermark")])


# Events as a request log: four consecutive ids of a source make up to four
# attempts at one page; errors answer 503 or 429, some carry Retry-After.
_LOG_CTE = """log0 AS (
  SELECT event_id, 'h' || CAST(user_id % 7 AS STRING) AS source_id,
    'r' || lpad(CAST(event_id // 5000 AS STRING), 6, '0') AS run_id,
    CAST(event_id // 4 AS INTEGER) AS page_no, ts,
    CASE WHEN event_id % 17 = 0 THEN NULL
      WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 503 ELSE 429 END
      WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 404 ELSE 500 END
      ELSE 200 END AS status,
    CASE event_id % 6 WHEN 0 THEN '120' WHEN 1 THEN '0' WHEN 2 THEN 'soon'
      WHEN 3 THEN 'Wed, 31 Jan 2024 00:00:00 GMT' WHEN 4 THEN 'Fri, 01 Jan 2021 00:00:00 GMT' END
      AS retry_after
  FROM events),
log AS (SELECT *, row_number() OVER (PARTITION BY source_id, run_id, page_no ORDER BY event_id)
  AS attempt FROM log0)"""


def _request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = inputs.table(spark, sf_dir, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    rows = e.select(
        F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string")).alias("source_id"),
        F.concat(F.lit("r"), F.lpad(F.expr("event_id div 5000").cast("string"), 6, "0")).alias(
            "run_id"
        ),
        F.expr("event_id div 4").cast("int").alias("page_no"),
        i.alias("request_id"),
        F.col("ts").cast("timestamp").alias("requested_at"),
        F.when(i % 17 == 0, F.lit(None))
        .when(kind == "error", F.when(i % 2 == 0, 503).otherwise(429))
        .when(kind == "signup", F.when(i % 3 == 0, 404).otherwise(500))
        .otherwise(200)
        .alias("status"),
        F.when(i % 6 == 0, "120")
        .when(i % 6 == 1, "0")
        .when(i % 6 == 2, "soon")
        .when(i % 6 == 3, "Wed, 31 Jan 2024 00:00:00 GMT")
        .when(i % 6 == 4, "Fri, 01 Jan 2021 00:00:00 GMT")
        .alias("retry_after"),
    )
    one_page = Window.partitionBy(*requestlog.PAGE).orderBy("request_id")
    return rows.withColumn("attempt", F.row_number().over(one_page))


_CLASS = """CASE WHEN {s} IS NULL OR {s} = 429 OR {s} >= 500 THEN 'retryable'
  WHEN {s} >= 300 THEN 'terminal' ELSE 'ok' END"""


@BOOK.add(
    "page_outcomes",
    f"""WITH {_LOG_CTE}, last AS (SELECT source_id, run_id, page_no, count(*) AS attempts,
        max(attempt) AS m FROM log GROUP BY ALL)
    SELECT l.source_id, l.run_id, l.page_no, l.attempts, g.status AS last_status,
      CASE WHEN {_CLASS.format(s="g.status")} <> 'retryable' THEN {_CLASS.format(s="g.status")}
        WHEN l.attempts >= 4 THEN 'gave_up' ELSE 'pending' END AS outcome
    FROM last l JOIN log g ON g.source_id = l.source_id AND g.run_id = l.run_id
      AND g.page_no = l.page_no AND g.attempt = l.m""",
)
def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requestlog.page_outcomes(_request_log(spark, sf_dir))


@BOOK.add(
    "retry_audit",
    f"""WITH {_LOG_CTE}, paired AS (SELECT *,
        lag(ts) OVER w AS previous_at, lag(retry_after) OVER w AS asked FROM log
        WINDOW w AS (PARTITION BY source_id, run_id, page_no ORDER BY attempt)),
      need AS (SELECT *, CASE WHEN asked = '120' THEN 120.0
          WHEN asked LIKE 'Wed%' AND previous_at < TIMESTAMP '2024-01-31 00:00:00'
            THEN (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(previous_at)) / 1e6
          ELSE least(power(2.0, attempt - 2), 30.0) END AS required_seconds,
        (epoch_us(ts) - epoch_us(previous_at)) / 1e6 AS actual_seconds
        FROM paired WHERE attempt > 1)
    SELECT source_id, run_id, page_no, CAST(attempt AS INTEGER) AS attempt,
      CAST(required_seconds AS DOUBLE) AS required_seconds, actual_seconds,
      actual_seconds < required_seconds AS too_soon FROM need""",
)
def retry_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requestlog.backoff_audit(_request_log(spark, sf_dir))


@BOOK.add(
    "rate_audit",
    f"""WITH {_LOG_CTE}, lim AS (SELECT *, CAST(substr(source_id, 2) AS INTEGER) AS rps FROM log),
      gaps AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (
        PARTITION BY source_id, run_id ORDER BY ts, event_id)) AS gap_micros FROM lim WHERE rps > 0)
    SELECT source_id, run_id, event_id AS request_id, gap_micros,
      CAST(floor(1000000.0 / rps) AS BIGINT) * 1 AS interval_micros,
      coalesce(gap_micros < floor(1000000.0 / rps), false) AS violation FROM gaps""",
)
def rate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _request_log(spark, sf_dir)
    limits = (
        log.select("source_id")
        .distinct()
        .withColumn("max_requests_per_second", F.substring("source_id", 2, 9).cast("int"))
    )
    return requestlog.rate_audit(log, limits)


@BOOK.add(
    "request_counts",
    f"WITH {_LOG_CTE} SELECT source_id, run_id, count(*) AS request_count FROM log GROUP BY ALL",
)
def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requestlog.request_counts(_request_log(spark, sf_dir))
