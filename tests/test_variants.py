"""Reading JSON and observing shapes."""

import hashlib
import json

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from harvestline.functions.variants import (
    dotted_get,
    dotted_text,
    flatten_shape,
    has_element,
    is_array,
    observed_type,
    shape_signature,
)
from harvestline.operators.shape import fingerprint, observe_shape


def parsed(spark, *texts):
    rows = [("s", "r", i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "source_id string, run_id string, i int, text string")
    return df.withColumn("record", F.try_parse_json("text"))


def test_paths(spark):
    doc = '{"result":{"rows":[[7],[8]],"page":{"after":"k-93","left":0,"gone":null}},"":{"deep":"d"},"x.y":2,"he \\"said\\"":{"ok":false}}'
    v = F.col("record")
    row = (
        parsed(spark, doc)
        .withColumn("p", F.lit("result.page.after"))
        .withColumn("odd", F.lit('he "said".ok'))
        .select(
            dotted_text(v, "result.page.after"),
            dotted_text(v, "result.page.left"),
            dotted_text(v, "result.page.other"),
            dotted_text(v, "result.page.gone"),
            dotted_text(v, "result.page"),
            dotted_text(v, "result.rows"),
            dotted_text(v, "result.page.left.below"),
            dotted_text(v, F.col("p")),
            dotted_text(v, F.col("odd")),
            dotted_text(v, 'he "said".ok'),
            dotted_text(v, "x.y"),
            dotted_text(v, ".deep"),
            is_array(dotted_get(v, "result.rows")),
            is_array(dotted_get(v, "result.page")),
            has_element(dotted_get(v, "result.rows"), 1),
            has_element(dotted_get(v, "result.rows"), 2),
        )
        .head()
    )
    assert tuple(row) == (
        "k-93", "0", None, None, None, None, None, "k-93", "false", "false", None, "d",
        True, False, True, False,
    )


def test_text_of_scalars(spark):
    doc = '{"a":1e3,"b":1.50,"c":100,"d":0.1234567,"e":-0.5,"f":"","g":false,"h":"  x ","i":12345678901234567890}'
    v = F.col("record")
    row = parsed(spark, doc).select(*[dotted_text(v, k) for k in "abcdefghi"]).head()
    assert tuple(row) == ("1000", "1.5", "100", "0.123457", "-0.5", None, "false", "  x ", "12345678901234567890")


def test_bodies(spark):
    from harvestline.functions.variants import parse_body

    df = parsed(spark, '{"a":1,"a":2}', "{", "[]", "").select(
        "i", F.to_json(parse_body(F.col("text"))).alias("v"), parse_body(F.col("text"), 2).isNull().alias("small")
    )
    assert [(r.v, r.small) for r in df.sort("i").collect()] == [
        ('{"a":2}', True), (None, True), ("[]", False), (None, True)
    ]


def python_type(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    kinds = {"array" if isinstance(x, list) else python_type(x) for x in value}
    if not kinds:
        return "array<>"
    solid = kinds - {"null"}
    return f"array<{'null' if not solid else solid.pop() if len(solid) == 1 else 'mixed'}>"


def python_shape(records):
    """Brute force: every path of every record with the set of its types."""
    seen = {}

    def visit(node, prefix, depth):
        for key, value in node.items():
            path = f"{prefix}.{key}" if prefix else key
            if path:
                seen.setdefault(path, set()).add(python_type(value))
            if isinstance(value, dict) and depth < 8:
                visit(value, path, depth + 1)

    for record in records:
        visit(record, "", 1)
    out = {}
    for path, types in seen.items():
        solid = types - {"null"}
        out[path] = "null" if not solid else solid.pop() if len(solid) == 1 else "mixed"
    return out


def spark_shape(spark, records):
    texts = [json.dumps(r) for r in records]
    return {r.path: r.type for r in observe_shape(parsed(spark, *texts)).collect()}


def test_golden_shapes(spark):
    cases = [
        ([{"sku": "K-7", "stock": 12, "sold_out": False, "note": None}], {"sku": "string", "stock": "number", "sold_out": "bool", "note": "null"}),
        ([{"sku": "K-7"}, {"stock": 3}, {}], {"sku": "string", "stock": "number"}),
        ([{"price": 9}, {"price": None}, {"price": 9.25}], {"price": "number"}),
        ([{"price": "9.25"}, {"price": True}], {"price": "mixed"}),
        ([{"size": {"w": 2, "h": {"cm": 4}}}, {"size": {"w": "2"}}], {"size": "object", "size.w": "mixed", "size.h": "object", "size.h.cm": "number"}),
        ([{"size": {"w": 2}}, {"size": "small"}], {"size": "mixed", "size.w": "number"}),
        ([{"codes": [4, 8, None]}, {"codes": [15]}], {"codes": "array<number>"}),
        ([{"codes": [[1], [2]], "flags": [True, "no"]}], {"codes": "array<array>", "flags": "array<mixed>"}),
        ([{"codes": []}, {"codes": []}], {"codes": "array<>"}),
        ([{"codes": [None]}, {"codes": ["x"]}], {"codes": "mixed"}),
        ([{"rows": [{"inner": 1}]}], {"rows": "array<object>"}),
    ]
    for records, want in cases:
        assert spark_shape(spark, records) == want


def test_depth_limit(spark):
    names = [f"floor{n}" for n in range(12)]
    house = {names[-1]: "roof"}
    for name in reversed(names[:-1]):
        house = {name: house, f"{name}_door": True}
    shape = spark_shape(spark, [house])
    assert ".".join(names[:8]) in shape and ".".join(names[:9]) not in shape
    assert sum(p.endswith("_door") for p in shape) == 8


JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.sampled_from([0.5, 1e30, "", "x", 's"]{[', "null"]),
    lambda inner: st.lists(inner, max_size=3)
    | st.dictionaries(st.sampled_from(["a", "b", "", "x.y", "DOUBLE", "a-b", "ARRAY<VOID>"]), inner, max_size=3),
    max_leaves=12,
)
RECORD = st.dictionaries(st.sampled_from(["a", "b", "", "c", "k: BIGINT, q"]), JSON, max_size=4)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(RECORD, min_size=1, max_size=30))
def test_shape_equals_brute_force(spark, records):
    assert spark_shape(spark, records) == python_shape(records)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(RECORD, min_size=20, max_size=60))
def test_signature_never_joins_different_shapes(spark, records):
    df = parsed(spark, *[json.dumps(r) for r in records])
    df = df.withColumn("t", F.schema_of_variant("record"))
    per = df.select(
        shape_signature("record", "t").alias("sig"), F.to_json(flatten_shape("record")).alias("shape")
    )
    worst = per.groupBy("sig").agg(F.countDistinct("shape").alias("n")).agg(F.max("n")).head()[0]
    assert worst == 1


def test_repartitioning_changes_nothing(spark):
    texts = [json.dumps({"id": i, "v": [None, i, "x"][i % 3], "t": [[], [1], [None]][i % 3]}) for i in range(50)]
    df = parsed(spark, *texts)
    once = {tuple(r) for r in observe_shape(df).collect()}
    assert once == {tuple(r) for r in observe_shape(df.repartition(13)).collect()}


def test_observed_type(spark):
    df = parsed(spark, '[1,"a"]', "[[1],[]]", "[null,{}]", "true", "null", "[null,2.5]")
    assert [r[0] for r in df.sort("i").select(observed_type("record")).collect()] == [
        "array<mixed>", "array<array>", "array<object>", "bool", "null", "array<number>"
    ]


def test_fingerprint(spark):
    shape = spark.createDataFrame(
        [("s", "r", "name", "string"), ("s", "r", "id", "number")],
        "source_id string, run_id string, path string, type string",
    )
    row = fingerprint(shape).head()
    want = hashlib.sha256(b"id:number\nname:string\n").hexdigest()[:16]
    assert (row.schema_fingerprint, row.paths) == (want, ["id", "name"])
    # Sorted by path, not by line: "a" comes before "a.b" although ":" sorts after ".".
    nested = spark.createDataFrame(
        [("s", "r", "a.b", "number"), ("s", "r", "a", "object")],
        "source_id string, run_id string, path string, type string",
    )
    want = hashlib.sha256(b"a:object\na.b:number\n").hexdigest()[:16]
    assert fingerprint(nested).head().schema_fingerprint == want
