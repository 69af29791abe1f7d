"""Shapes, fingerprints, drift and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestline.operators import drift, shape
from harvestline.plans.staging import stage
from harvestline.queries import inputs
from harvestline.queries.book import Book
from harvestline.queries.fetching import walked_event_records

BOOK = Book()

# Every (path, type) a record made of an event contributes.
_LEAVES = """leaves AS (
  SELECT source_id, run_id, event_id, unnest([
    {'p': 'amount', 't': CASE WHEN event_id % 97 = 0 THEN 'string' ELSE 'number' END},
    {'p': CASE WHEN event_id % 13 <> 0 THEN 'email' END, 't': 'string'},
    {'p': 'id', 't': 'number'}, {'p': 'kind', 't': 'string'}, {'p': 'meta', 't': 'object'},
    {'p': 'meta.k', 't': 'number'},
    {'p': 'meta.n', 't': CASE WHEN event_id % 7 = 0 THEN 'null' ELSE 'number' END},
    {'p': 'tags', 't': CASE event_id % 5 WHEN 0 THEN 'array<>' WHEN 1 THEN 'array<string>'
      WHEN 2 THEN 'array<number>' WHEN 3 THEN 'array<null>' ELSE 'array<mixed>' END},
    {'p': CASE WHEN event_id % 103 <> 0 THEN 'updated_at' END, 't': 'string'}]) AS x
  FROM ev WHERE is_object),
leaf AS (SELECT source_id, run_id, event_id, x.p AS path, x.t AS type FROM leaves WHERE x.p IS NOT NULL)"""

_MERGE = """CASE count(DISTINCT type) FILTER (type <> 'null') WHEN 0 THEN 'null'
  WHEN 1 THEN max(type) FILTER (type <> 'null') ELSE 'mixed' END"""

_SHAPE = f"shape AS (SELECT source_id, run_id, path, {_MERGE} AS type FROM leaf GROUP BY source_id, run_id, path)"

_WITH = f"WITH {inputs.EVENTS_CTE}, {_LEAVES}, {_SHAPE}"


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestline.functions.variants import is_object

    return walked_event_records(spark, sf_dir).where(is_object(F.col("record")))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(shape.observe_shape(_objects(spark, sf_dir)), "shapes")


@BOOK.add("shape_observe", f"{_WITH} SELECT * FROM shape")
def shape_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.observe_shape(_objects(spark, sf_dir))


@BOOK.add(
    "shape_types_arrays",
    f"""WITH {inputs.EVENTS_CTE}, {_LEAVES}
    SELECT event_id, type AS tags_type FROM leaf WHERE path = 'tags'""",
)
def shape_types_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of one field of every record, arrays by their elements."""
    from harvestline.functions.variants import dotted_get, dotted_text, observed_type

    record = F.col("record")
    return (
        _objects(spark, sf_dir)
        .select(
            dotted_text(record, "id").cast("bigint").alias("event_id"),
            dotted_get(record, "tags").alias("tags"),
        )
        .select("event_id", observed_type("tags").alias("tags_type"))
    )


# Ten nested levels; only eight are entered.
@BOOK.add(
    "shape_depth_limit",
    """WITH o AS (SELECT 's' || lpad(CAST(o_custkey % 25 AS STRING), 2, '0') AS source_id,
        o_orderkey % 11 AS deep FROM orders),
      m AS (SELECT source_id, deep, unnest(range(1, CAST(least(deep, 8) AS BIGINT) + 1)) AS d FROM o),
      p AS (SELECT source_id, array_to_string(list_transform(range(1, d + 1), lambda i: 'n' || i), '.')
        AS path, CASE WHEN d < deep THEN 'object' ELSE 'number' END AS type FROM m)
    SELECT source_id, path, CASE WHEN count(DISTINCT type) > 1 THEN 'mixed' ELSE max(type) END AS type
    FROM p GROUP BY source_id, path""",
)
def shape_depth_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = F.col("o_orderkey") % 11
    opening = F.array_join(
        F.transform(
            F.when(deep > 0, F.sequence(F.lit(1).cast("bigint"), deep)).otherwise(
                F.array().cast("array<bigint>")
            ),
            lambda i: F.concat(F.lit('{"n'), i.cast("string"), F.lit('":')),
        ),
        "",
    )
    text = F.when(deep == 0, F.lit("{}")).otherwise(
        F.concat(opening, F.lit("1"), F.repeat(F.lit("}"), deep.cast("int")))
    )
    records = inputs.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), F.lpad(F.expr("o_custkey % 25").cast("string"), 2, "0")).alias(
            "source_id"
        ),
        F.try_parse_json(text).alias("record"),
    )
    return shape.observe_shape(records, ["source_id"])


_PRINT = """substr(sha256(string_agg(path || ':' || type || chr(10), '' ORDER BY path)), 1, 16)"""


@BOOK.add(
    "shape_fingerprint",
    f"""{_WITH} SELECT source_id, run_id, {_PRINT} AS schema_fingerprint,
      array_to_string(list(path ORDER BY path), ',') AS paths FROM shape GROUP BY source_id, run_id""",
)
def shape_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.fingerprint(shape.observe_shape(_objects(spark, sf_dir))).withColumn(
        "paths", F.array_join("paths", ",")
    )


# What the sources had accepted before: the shape of their first run, altered.
_ACCEPTED = """acc AS (
  SELECT source_id, path, CASE WHEN path = 'kind' AND source_id IN ('click', 'view') THEN 'number'
    ELSE type END AS type
  FROM shape WHERE run_id = 'r000000' AND source_id <> 'signup'
    AND NOT (path = 'meta.k' AND source_id IN ('error', 'view'))
  UNION ALL SELECT DISTINCT source_id, 'legacy.flag', 'bool' FROM shape
    WHERE source_id IN ('purchase', 'view')),
diff AS (
  SELECT r.source_id, r.run_id,
    list_sort(list(o.path) FILTER (a.path IS NULL AND o.path IS NOT NULL)) AS added,
    list_sort(list(a.path) FILTER (o.path IS NULL AND a.path IS NOT NULL)) AS removed,
    list_sort(list(o.path || '(' || a.type || '->' || o.type || ')') FILTER (a.type <> o.type))
      AS changed,
    count(a.path) AS accepted_paths
  FROM (SELECT DISTINCT source_id, run_id FROM shape) r
  JOIN (SELECT DISTINCT path FROM shape UNION SELECT 'legacy.flag') p ON true
  LEFT JOIN shape o ON o.source_id = r.source_id AND o.run_id = r.run_id AND o.path = p.path
  LEFT JOIN acc a ON a.source_id = r.source_id AND a.path = p.path
  GROUP BY r.source_id, r.run_id),
texts AS (SELECT *, coalesce(array_to_string(added, ','), '') AS a,
    coalesce(array_to_string(removed, ','), '') AS r,
    coalesce(array_to_string(changed, ','), '') AS c FROM diff),
worded AS (SELECT *, concat_ws('; ', CASE WHEN a <> '' THEN 'added ' || a END,
    CASE WHEN r <> '' THEN 'removed ' || r END,
    CASE WHEN c <> '' THEN 'changed ' || c END) AS change_text FROM texts)"""


def _accepted(shapes: DataFrame) -> DataFrame:
    src, path = F.col("source_id"), F.col("path")
    first = shapes.where((F.col("run_id") == "r000000") & (src != "signup")).where(
        ~((path == "meta.k") & src.isin("error", "view"))
    )
    first = first.select(
        src,
        path,
        F.when((path == "kind") & src.isin("click", "view"), "number")
        .otherwise(F.col("type"))
        .alias("type"),
    )
    legacy = (
        shapes.where(src.isin("purchase", "view"))
        .select(src)
        .distinct()
        .select(src, F.lit("legacy.flag").alias("path"), F.lit("bool").alias("type"))
    )
    return first.unionByName(legacy)


@BOOK.add(
    "shape_diff",
    f"{_WITH}, {_ACCEPTED} SELECT source_id, run_id, a AS added, r AS removed, c AS changed,"
    " accepted_paths FROM worded",
)
def shape_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = _shapes(spark, sf_dir)
    diff = drift.shape_diff(shapes, _accepted(shapes))
    return diff.select(
        "source_id",
        "run_id",
        *[F.array_join(c, ",").alias(c) for c in ("added", "removed", "changed")],
        "accepted_paths",
    )


@BOOK.add("change_text", f"{_WITH}, {_ACCEPTED} SELECT source_id, run_id, change_text FROM worded")
def change_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = _shapes(spark, sf_dir)
    diff = drift.shape_diff(shapes, _accepted(shapes))
    text = drift.change_text(F.col("added"), F.col("removed"), F.col("changed"))
    return diff.select("source_id", "run_id", text.alias("change_text"))


_POLICIES = ("Ignore", "Warn", "EvolveAdditive", "Fail", "Shrug")


@BOOK.add(
    "drift_verdict",
    f"""{_WITH}, {_ACCEPTED}, pol AS (SELECT unnest({list(_POLICIES)}) AS drift),
      j AS (SELECT w.*, drift, CASE
        WHEN change_text = '' OR accepted_paths = 0 OR drift = 'Ignore' THEN 'accept'
        WHEN drift = 'Warn' THEN 'warn'
        WHEN drift = 'EvolveAdditive' AND r = '' AND c = '' THEN 'accept' ELSE 'reject' END AS verdict
        FROM worded w, pol)
    SELECT source_id || '/' || drift AS source_id, run_id, verdict, r <> '' OR c <> '' AS breaking,
      CASE WHEN verdict = 'reject' THEN CASE drift
        WHEN 'EvolveAdditive' THEN 'record shape changed in a non-additive way: ' || change_text
        WHEN 'Fail' THEN 'record shape changed: ' || change_text
        ELSE 'unsupported schema drift policy "' || drift || '"' END END AS drift_error
    FROM j""",
)
def drift_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy on every source: each source is repeated once a policy."""
    shapes = _shapes(spark, sf_dir)
    diff = drift.shape_diff(shapes, _accepted(shapes))
    named = diff.withColumn("drift", F.explode(F.array(*[F.lit(p) for p in _POLICIES])))
    named = named.withColumn("source_id", F.concat_ws("/", "source_id", "drift"))
    policies = named.select("source_id", "drift").distinct()
    return drift.judge(named.drop("drift"), policies).select(
        "source_id", "run_id", "verdict", "breaking", "drift_error"
    )


@BOOK.add(
    "adopt_shape",
    f"""{_WITH}, {_ACCEPTED}, win AS (SELECT source_id, max(run_id) AS run_id FROM shape
        WHERE source_id <> 'click' GROUP BY source_id)
    SELECT source_id, path, type FROM acc WHERE source_id NOT IN (SELECT source_id FROM win)
    UNION ALL SELECT s.source_id, path, type FROM shape s JOIN win USING (source_id, run_id)""",
)
def adopt_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted shapes after every source but one succeeded, through their stored documents."""
    shapes = _shapes(spark, sf_dir)
    stored = drift.parse_accepted(drift.format_accepted(_accepted(shapes)))
    winners = (
        shapes.where(F.col("source_id") != "click")
        .groupBy("source_id")
        .agg(F.max("run_id").alias("run_id"))
    )
    return drift.adopt_shape(stored, shapes, winners)


@BOOK.add(
    "corrupt_shapes",
    f"""{_WITH}, {_ACCEPTED} SELECT source_id, path, type FROM acc WHERE source_id IN ('click', 'view')""",
)
def corrupt_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents that are cut off, of another form, empty or missing count as nothing accepted."""
    documents = drift.format_accepted(_accepted(_shapes(spark, sf_dir)))
    of = lambda name: F.col("source_id") == name
    spoilt = (
        F.when(of("purchase"), F.expr("substring(document, 1, length(document) - 3)"))
        .when(of("error"), F.lit('[{"fields": 1}]'))
        .when(of("signup"), F.lit(None))
        .otherwise(F.col("document"))
    )
    more = documents.select(F.concat("source_id", F.lit("-empty")).alias("source_id"), F.lit("").alias("document"))
    return drift.parse_accepted(documents.withColumn("document", spoilt).unionByName(more))
