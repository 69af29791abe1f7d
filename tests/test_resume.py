"""F2-F9, A1-A3 on single records."""

from pyspark.sql import functions as F

from harvestline.operators.resume import high_water, mark_records, run_counts


def marked(spark, values, fmt="RFC3339", since=None, until=None, field="at", kind="scheduled"):
    """Records holding the given JSON texts as their resume value; None leaves the field out."""
    rows = [
        ("s", "r", 1, i, "{}" if v is None else '{"at":%s}' % v) for i, v in enumerate(values)
    ]
    records = spark.createDataFrame(
        rows, "source_id string, run_id string, page_no int, record_pos int, text string"
    ).withColumn("record", F.try_parse_json("text"))
    bounds = spark.createDataFrame(
        [("s", kind, field, fmt, since, until)],
        "source_id string, kind string, record_field string, format string, from_value string, to_value string",
    )
    return mark_records(records, bounds, [field] if field else None)


def verdicts(df):
    return "".join(r.verdict[0] for r in df.sort("record_pos").collect())


def value(df):
    return high_water(df).head().high_water


def test_boundary_record_is_dropped(spark):
    df = marked(spark, ['"2031-07-09T06:30:00Z"', '"2031-07-09T08:30:00+02:00"', '"2031-07-09T06:30:00.25Z"'], since="2031-07-09T06:30:00Z")
    assert verdicts(df) == "ssa"
    assert value(df) == "2031-07-09T06:30:00.25Z"
    assert tuple(run_counts(df).head())[2:] == (1, 0, 2)


def test_highest_not_last_and_first_seen_wins_ties(spark):
    df = marked(spark, ['"2031-07-12T00:00:00Z"', '"2031-09-30T21:00:00Z"', '"2031-10-01T00:00:00+03:00"', '"2031-08-01T00:00:00Z"'])
    assert value(df) == "2031-09-30T21:00:00Z"


def test_nanoseconds_order(spark):
    df = marked(spark, ['"2031-07-09T06:30:00.000000012Z"', '"2031-07-09T06:30:00.000000011Z"'], since="2031-07-09T06:30:00.000000011Z")
    assert verdicts(df) == "as"


def test_fail_open(spark):
    values = [None, "null", '""', "{}", "[3]", '"yesterday"', "false"]
    df = marked(spark, values, since="2031-07-09T06:30:00Z")
    assert verdicts(df) == "a" * 7
    assert value(df) is None
    mixed = marked(spark, ['"soon"', '"2029-05-05T05:05:05Z"'])
    assert value(mixed) == "2029-05-05T05:05:05Z"
    assert verdicts(marked(spark, ['"2019-12-12T00:00:00Z"'], since="once upon a time")) == "a"


def test_backfill_range(spark):
    df = marked(
        spark,
        ['"2030-03-31T23:59:59Z"', '"2030-04-01T00:00:00Z"', '"2030-06-30T12:00:00Z"', '"2030-06-30T12:00:00.001Z"', '"2030-05-17T00:00:00Z"'],
        since="2030-03-31T23:59:59Z",
        until="2030-06-30T12:00:00Z",
        kind="backfill",
    )
    assert verdicts(df) == "saasa"
    assert value(df) is None


def test_unix_seconds(spark):
    df = marked(spark, ['"41"', "77", "78", '"+90"', "6e1"], fmt="UnixSeconds", since="77")
    assert verdicts(df) == "ssaas"
    assert value(df) == "+90"


def test_opaque_takes_the_last(spark):
    df = marked(spark, ['"tok-9"', '"tok-1"', '"tok-4"', None], fmt="Opaque", since="tok-7")
    assert verdicts(df) == "aaaa"
    assert value(df) == "tok-4"


def test_full_pull(spark):
    df = marked(spark, ['"2031-07-09T06:30:00Z"'], field=None, fmt=None)
    assert verdicts(df) == "a" and value(df) is None


def test_path_column_and_known_path_agree(spark):
    df = marked(spark, ['"2026-01-03T00:00:00Z"'], since="2026-01-02T00:00:00Z")
    assert verdicts(df) == "a"
    nested = marked(spark, ['{"x":"2026-01-01T00:00:00Z"}'], since="2026-01-02T00:00:00Z", field="at.x")
    assert verdicts(nested) == "s"
