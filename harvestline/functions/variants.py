"""Reading JSON values held as VARIANT: paths, text forms and kinds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from harvestline.model import MAX_RESPONSE_BYTES, MAX_SHAPE_DEPTH

OBJECT_TYPE = "map<string,variant>"
ARRAY_TYPE = "array<variant>"


def parse_body(body: Column, cap: int = MAX_RESPONSE_BYTES) -> Column:
    """Decode one response body; NULL when malformed or over the size cap."""
    return F.when(F.octet_length(body) <= cap, F.try_parse_json(body))


def _walk_keys(v: Column, path: Column) -> Column:
    """Key-by-key lookup, for keys a variant path cannot spell."""
    return F.aggregate(
        F.split(path, r"\."), v, lambda node, key: node.try_cast(OBJECT_TYPE)[key]
    )


def dotted_get(v: Column, path: Column | str | None) -> Column:
    """S3: value at a dotted path through objects only; the empty path is the document.

    A literal path becomes a constant variant path.  A path held in a column
    (one per source) is spelled per row.
    """
    if path is None or (isinstance(path, str) and path == ""):
        return v
    if isinstance(path, str):
        if '"' in path:
            return _walk_keys(v, F.lit(path))
        spelled = "$" + "".join(f'["{key}"]' for key in path.split("."))
        return F.try_variant_get(v, spelled, "variant")
    spelled = F.concat(F.lit('$["'), F.replace(path, F.lit("."), F.lit('"]["')), F.lit('"]'))
    return (
        F.when(F.coalesce(path, F.lit("")) == "", v)
        .when(~path.contains('"'), F.try_variant_get(v, spelled, "variant"))
        .otherwise(_walk_keys(v, path))
    )


def dotted_get_any(v: Column, path: Column, known: list[str] | None) -> Column:
    """Like ``dotted_get`` with a path column, using constant paths for the known values.

    Spelling a path per record costs as much as reading the value, so a plan
    that knows the handful of paths its specs use compares text instead.
    """
    if not known:
        return dotted_get(v, path)
    choice = F.when(path.isNull(), F.lit(None).cast("variant"))
    for value in known:
        choice = choice.when(path == value, dotted_get(v, value))
    return choice.otherwise(dotted_get(v, path))


def has_element(v: Column, index: Column | int) -> Column:
    """True when ``v`` is an array longer than ``index``; does not materialise the array."""
    spelled = F.concat(F.lit("$["), F.lit(index).cast("string"), F.lit("]"))
    return F.try_variant_get(v, spelled, "variant").isNotNull()


def is_array(v: Column) -> Column:
    return F.coalesce(
        F.try_variant_get(v, "$[0]", "variant").isNotNull() | v.try_cast(ARRAY_TYPE).isNotNull(),
        F.lit(False),
    )


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))


def number_text(v: Column) -> Column:
    """A JSON number in plain decimals, at most six places, no trailing zeros."""
    fixed = F.coalesce(
        v.try_cast("decimal(38,6)").cast("string"),
        F.format_string("%f", v.try_cast("double")),
    )
    return F.regexp_replace(fixed, r"\.?0+$", "")


def scalar_text(v: Column, kind: Column | None = None) -> Column:
    """Scalar as text; NULL for null, objects, arrays and the empty string."""
    kind = F.schema_of_variant(v) if kind is None else kind
    return (
        F.when(kind == "STRING", F.nullif(v.try_cast("string"), F.lit("")))
        .when(kind.isin("BIGINT", "BOOLEAN"), v.try_cast("string"))
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), number_text(v))
    )


def dotted_text(v: Column, path: Column | str | None) -> Column:
    """Text of the scalar at a dotted path."""
    return scalar_text(dotted_get(v, path))


_KIND_SQL = (
    "CASE WHEN {t} LIKE 'OBJECT<%' THEN 'object'"
    " WHEN {t} = 'STRING' THEN 'string' WHEN {t} = 'BOOLEAN' THEN 'bool'"
    " WHEN {t} = 'VOID' THEN 'null' WHEN {t} = 'VARIANT' THEN 'mixed'"
    " WHEN {t} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {t} LIKE 'DECIMAL%' THEN 'number'"
    " WHEN {t} LIKE 'ARRAY<%' THEN {array} ELSE 'unknown' END"
)


def kind_sql(text: str) -> str:
    """Observed kind from ``schema_of_variant`` text; arrays are only 'array' here."""
    return _KIND_SQL.format(t=text, array="'array'")


def observed_sql(value: str, text: str) -> str:
    """The type recorded for one value.

    The element type inside ``ARRAY<...>`` already follows the rules wanted:
    nulls yield to anything, two kinds make VARIANT.  Only ``[]`` and ``[null]``
    share a text and are told apart by size.
    """
    element = kind_sql(f"substring({text}, 7, length({text}) - 7)")
    array = (
        f"(CASE WHEN {text} <> 'ARRAY<VOID>' THEN concat('array<', {element}, '>')"
        f" WHEN size(try_cast({value} AS array<variant>)) = 0 THEN 'array<>' ELSE 'array<null>' END)"
    )
    return _KIND_SQL.format(t=text, array=array)


def observed_type(value: str) -> Column:
    """The type recorded for the value of a column or field."""
    return F.expr(observed_sql(value, f"schema_of_variant({value})"))


_LEAF = "array<struct<path:string,type:string>>"


def _below_sql(node: str, prefix: str | None, left: int, level: int = 0) -> str:
    """Leaves under one object, with ``left`` levels still to enter."""
    e, x = f"e{level}", f"x{level}"
    path = (
        f"{e}.key"
        if prefix is None
        else f"if({prefix} = '', {e}.key, concat({prefix}, '.', {e}.key))"
    )
    entries = (
        f"transform(map_entries(try_cast({node} AS {OBJECT_TYPE})), {e} -> named_struct("
        f"'path', {path}, 'value', {e}.value, 'text', schema_of_variant({e}.value)))"
    )
    kind = observed_sql(f"{x}.value", f"{x}.text")
    leaf = f"array(named_struct('path', {x}.path, 'type', {kind}))"
    if left > 1:
        deeper = _below_sql(f"{x}.value", f"{x}.path", left - 1, level + 1)
        leaf = (
            f"concat({leaf}, CASE WHEN {x}.text LIKE 'OBJECT<%' THEN {deeper}"
            f" ELSE CAST(array() AS {_LEAF}) END)"
        )
    return f"flatten(transform({entries}, {x} -> {leaf}))"


def flatten_shape(record: str, depth: int = MAX_SHAPE_DEPTH) -> Column:
    """A4, A5: every ``(path, type)`` of one record, objects entered down to ``depth``.

    Objects inside arrays are never entered.  The result may repeat a path when
    a key itself contains a dot; merging happens in the aggregate.  Written as
    SQL text because eight nested lambdas built call by call cost seconds.
    """
    return F.expr(f"filter({_below_sql(record, None, depth)}, n -> n.path <> '')")


# A number type where a type may stand in ``schema_of_variant`` text.
_NUMBER_IN_SCHEMA = r"(?<=: |ARRAY<)(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))"
# Possessive, so the length of a string costs no stack.
_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _array_skeleton(record: str) -> Column:
    """Brackets of a record: which arrays are empty, which hold only nulls, which hold values."""
    text = F.regexp_replace(F.to_json(record), _JSON_STRING, '"')
    text = F.regexp_replace(text, r"\[null(?:,null)*+\]", "N")
    return F.regexp_replace(text, r'\[[^\[\]{}]++\]|[^\[\]{},:"N]++', "v")


def shape_signature(record: str, schema_text: str) -> Column:
    """Text equal only for records with the same ``flatten_shape``.

    ``schema_of_variant`` is compiled and cheap, and almost exact: number widths
    differ where our types do not (folded here; skipped when a key needed
    quoting, which only makes the signature finer), and it cannot tell ``[]``
    from ``[null]``, so records with such arrays add their bracket structure.
    ``schema_text`` names the column holding it.
    """
    text = F.col(schema_text)
    folded = F.when(text.contains("`"), text).otherwise(
        F.regexp_replace(text, _NUMBER_IN_SCHEMA, "NUMBER")
    )
    return F.when(
        text.contains("ARRAY<VOID>"), F.concat(folded, F.lit(" "), _array_skeleton(record))
    ).otherwise(folded)
