"""Keys, links, delays, URLs and byte limits."""

from datetime import datetime

from pyspark.sql import functions as F

from harvestline.functions.ordering import order_key
from harvestline.functions.text import cut_bytes
from harvestline.functions.web import doubling_backoff, header, next_link, query_escape, retry_after_seconds


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).sort("i").select("o").collect()]


def test_rfc3339_keys(spark):
    values = [
        "2026-01-02T00:00:00Z",
        "2026-01-02T01:30:00+01:30",
        "2026-01-02T00:00:00.000000001Z",
        "2026-01-02T00:00:00,5Z",
        "2026-01-02T00:00:00.1234567899Z",
        "1969-12-31T23:59:59.9Z",
        "2026-01-02",
        "2026-01-02 00:00:00Z",
        "2026-02-30T00:00:00Z",
        "2026-01-02T00:00:60Z",
        "2026-01-02T00:00:00",
        "yesterday at noon",
        "",
    ]
    keys = column(spark, values, lambda v: order_key(v, "RFC3339"))
    base = keys[0].major
    assert tuple(keys[1]) == (base, 0)
    assert tuple(keys[2]) == (base, 1)
    assert tuple(keys[3]) == (base + 500_000, 0)
    assert tuple(keys[4]) == (base + 123_456, 789)
    assert tuple(keys[5]) == (-100_000, 0)
    assert keys[6:] == [None] * 7


def test_unix_and_opaque_keys(spark):
    values = ["1000", "+7", "-3", " 5", "1.5", "9223372036854775807", "9223372036854775808", "x"]
    got = column(spark, values, lambda v: order_key(v, "UnixSeconds")["major"])
    assert got == [1000, 7, -3, None, None, 9223372036854775807, None, None]
    assert column(spark, values[:1], lambda v: order_key(v, "Opaque")) == [None]


def test_next_link(spark):
    values = [
        '<https://shop.invalid/orders?at=40>; rel="prev", <https://shop.invalid/orders?at=60>; hreflang="de"; rel="next"',
        "<https://shop.invalid/orders?at=80>; rel=next",
        '<https://shop.invalid/orders?at=0>; rel="first", <https://shop.invalid/orders?at=20>; rel="prev"',
        '<https://a/2>;title=t; rel=next, <https://a/3>; rel="next"',
        'https://a/2; rel="next"',
        "<>; rel=next",
        ",;,",
        " ",
        None,
    ]
    assert column(spark, values, next_link) == [
        "https://shop.invalid/orders?at=60", "https://shop.invalid/orders?at=80", None, "https://a/2", None, None, None, None, None
    ]


def test_header_name_in_any_case(spark):
    df = spark.createDataFrame([({"LINK": "x"},), ({"Link": "y"},), ({},)], "h map<string,string>")
    assert [r[0] for r in df.select(header(F.col("h"), "Link")).collect()] == ["x", "y", None]


def test_retry_after(spark):
    at = F.lit(datetime(2015, 10, 21, 7, 27, 0))
    values = ["120", "0", "-5", "soon", "Wed, 21 Oct 2015 07:28:00 GMT", "Wed, 21 Oct 2015 07:26:00 GMT", "", None]
    assert column(spark, values, lambda v: retry_after_seconds(v, at)) == [120.0, None, None, None, 60.0, None, None, None]
    others = ["Wednesday, 21-Oct-15 07:29:30 GMT", "Wed Oct 21 07:27:45 2015", "Sun Nov  1 07:27:00 2015", "Wednesday, 21-Oct-15"]
    assert column(spark, others, lambda v: retry_after_seconds(v, at)) == [150.0, 45.0, 950_400.0, None]
    df = spark.range(2, 9).select(doubling_backoff(F.col("id"), 30))
    assert [r[0] for r in df.collect()] == [1, 2, 4, 8, 16, 30, 30]


def test_query_escape(spark):
    assert column(spark, ["a b*c~d-_.e/é"], query_escape) == ["a+b%2Ac~d-_.e%2F%C3%A9"]


def test_cut_bytes(spark):
    got = column(spark, ["abc", "abcdef", "ééé", None], lambda v: cut_bytes(v, 5))
    assert got == ["abc", "abcde", "éé�", None]
