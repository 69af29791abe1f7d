"""Operator 10: chat formatting of heterogeneous layouts, in DataFrame operations only.

A record's layout is told by its schema fingerprint: the hash of its nested field
paths, types left out.  Fingerprints select the declarative mapping that turns a
record into canonical turns (role, text): rows of one turn, prompt-and-answer
pairs, instructions with input and output, lists of messages under two spellings.
Records are JSON texts or rows of typed columns, each fingerprinted by itself, so
one table may hold several layouts.  Fields that a layout doesn't name are set
aside; of layouts that a record has all fields of, the first in ``LAYOUTS`` is
its own.

A turn is written as

    <|turn|>ROLE newline TEXT<|end|> newline

Inside roles and texts the backslash and every control string (this template's
and the widely used ones, ``CONTROL``) are replaced by a backslash and a letter,
so none is left and reading back is exact.  The loss mask is a list of spans, one
an assistant turn, over that turn's text and nothing else.

Null text or role: empty; a column or JSON field that is null is there all the
same.  An empty list of messages has no turns.  Null ``conv_id``: a conversation of
its own.  Turns are in order of ``turn`` (null first), then role, then text, so
repeated rows stand side by side.  A record of unknown layout gives no turns and is
reported by ``canonical_turns`` with layout null; a table whose columns hold no
layout is refused.  Columns called ``layout`` or ``turns`` beside records are
replaced.  An empty table gives an empty result.  A record may have 128 MiB, as much
as a VARIANT holds; JSON strings may have 20 million characters, Spark's parser's limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestline.functions.once import compute_once

TURN, END = "<|turn|>", "<|end|>\n"

# Control strings and the letters that stand for them after a backslash.
CONTROL = {
    "\\": "s",
    "<|": "l",
    "|>": "r",
    "</s>": "e",
    "<s>": "b",
    "[INST]": "i",
    "[/INST]": "j",
    "<<SYS>>": "y",
    "<</SYS>>": "z",
}

_TURN = "array<struct<role string, text string>>"


def _pairs(*turns: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', {role}, 'text', {text})" for role, text in turns) + ")"


def _field(path: str) -> str:
    return f"variant_get(record, '$.{path}', 'string')"


def _list(path: str, role: str, text: str) -> str:
    """Turns of a list of messages; the names some layouts give to speakers become the usual ones."""
    kinds = {"human": "user", "gpt": "assistant", "bot": "assistant"}
    speaker = f"CASE m.`{role}` " + "".join(f"WHEN '{a}' THEN '{b}' " for a, b in kinds.items()) + f"ELSE m.`{role}` END"
    return (
        f"transform(from_json(to_json(variant_get(record, '$.{path}', 'variant')),"
        f" 'array<struct<`{role}` string, `{text}` string>>'),"
        f" m -> named_struct('role', {speaker}, 'text', m.`{text}`))"
    )


# Layouts: name, field paths, and the turns as an expression over the variant ``record``.
# One that has all paths of another comes before it.
LAYOUTS: list[tuple[str, list[str], str]] = [
    ("turn", ["role", "text"], _pairs((_field("role"), _field("text")))),
    ("messages", ["messages[].content", "messages[].role"], _list("messages", "role", "content")),
    ("conversations", ["conversations[].from", "conversations[].value"], _list("conversations", "from", "value")),
    (
        "instruction_input",
        ["input", "instruction", "output"],
        _pairs(
            ("'user'", f"concat_ws('\\n\\n', {_field('instruction')}, nullif({_field('input')}, ''))"),
            ("'assistant'", _field("output")),
        ),
    ),
    (
        "instruction",
        ["instruction", "output"],
        _pairs(("'user'", _field("instruction")), ("'assistant'", _field("output"))),
    ),
    ("prompt", ["completion", "prompt"], _pairs(("'user'", _field("prompt")), ("'assistant'", _field("completion")))),
    ("answer", ["prompt", "response"], _pairs(("'user'", _field("prompt")), ("'assistant'", _field("response")))),
    (
        "question",
        ["answer", "question"],
        _pairs(("'user'", _field("question")), ("'assistant'", _field("answer"))),
    ),
]
KNOWN = sorted({path for _, paths, _ in LAYOUTS for path in paths})


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a Spark type, sorted."""
    if isinstance(schema, T.StructType):
        found = [p for f in schema for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
        return sorted(found)
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, at + "[]")
    return [at]


def known_paths(record: Column) -> Column:
    """Of a variant: its nested field paths that some layout has, sorted."""
    fields = F.map_keys(F.try_variant_get(record, "$", "map<string,variant>"))
    there = []
    for path in KNOWN:
        head, _, inner = path.partition("[].")
        if inner:
            items = F.try_variant_get(record, f"$.{head}", "array<map<string,variant>>")
            # An empty list has the fields of any.
            names = F.flatten(F.transform(items, lambda item: F.map_keys(item)))
            has = (F.size(items) == 0) | F.array_contains(names, inner)
        else:
            has = F.array_contains(fields, head)
        there.append(F.when(has, F.lit(path)))
    return F.array_compact(F.array(*there))


def _hashed(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def fingerprint_of(paths: list[str]) -> Column:
    return _hashed(F.array(*(F.lit(path) for path in sorted(paths))))


def fingerprint(record: Column) -> Column:
    """Of a variant: the hash of its field paths, unknown ones set aside."""
    return _hashed(known_paths(record))


def _layout(paths: Column) -> Column:
    """The first layout whose fingerprint is that of the record's paths without those that it doesn't name."""

    def told(name: str, wanted: list[str]) -> Column:
        own = F.array_intersect(F.array(*(F.lit(path) for path in sorted(wanted))), paths)
        return F.when(_hashed(own) == fingerprint_of(wanted), F.lit(name))

    return F.coalesce(*(told(name, wanted) for name, wanted, _ in LAYOUTS))


def _mapped(records: DataFrame) -> DataFrame:
    """``row, layout, turns`` of ``row`` and a variant ``record``."""
    known = compute_once(records, paths=known_paths(F.col("record")))
    known = compute_once(known, layout=_layout(F.col("paths")))
    turns = reduce(
        lambda rest, layout: F.when(F.col("layout") == layout[0], F.expr(layout[2]).cast(_TURN)).otherwise(rest),
        LAYOUTS,
        F.array().cast(_TURN),
    )
    return known.select("row", "layout", turns.alias("turns"))


def canonical_turns(records: DataFrame) -> DataFrame:
    """``layout`` and ``turns`` beside the columns of ``records``, whose JSON text is in ``record``."""
    parsed = compute_once(records.select(F.struct("*").alias("row")), record=F.try_parse_json("row.record"))
    kept = [F.col("row").getField(name).alias(name) for name in records.columns if name not in ("record", "layout", "turns")]
    return _mapped(parsed).select(*kept, "layout", "turns")


def _spread(mapped: DataFrame) -> DataFrame:
    """``conv_id, turn, part, role, text``: a row a turn."""
    each = mapped.select("row.conv_id", "row.turn", F.posexplode("turns").alias("part", "made"))
    return each.select("conv_id", "turn", "part", "made.role", "made.text")


def record_rows(records: DataFrame) -> DataFrame:
    """``conv_id, turn, part, role, text`` from JSON records (``conv_id, turn, record``) of any layouts."""
    rows = F.struct("conv_id", "turn").alias("row")
    return _spread(_mapped(compute_once(records.select(rows, F.col("record").alias("raw")), record=F.try_parse_json("raw"))))


def turn_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, part, role, text`` from rows of typed columns, each row a record.

    The row's columns that some mapping knows make up the record; others, and fields
    inside them that no mapping knows, are left aside.
    """
    heads = {path.partition("[]")[0] for path in KNOWN}
    message = T.StructType([f for f in rows.schema if f.name in heads])
    paths = schema_paths(message)
    if not any(set(wanted) <= set(paths) for _, wanted, _ in LAYOUTS):
        raise ValueError(f"no mapping for rows with the fields {paths}")
    record = F.to_variant_object(F.struct(*message.names))
    return _spread(_mapped(compute_once(rows.select(F.struct("conv_id", "turn").alias("row"), *message.names), record=record)))


def _escaped(text: Column, line: bool = False) -> Column:
    out = F.coalesce(text, F.lit(""))
    for control, letter in CONTROL.items():
        out = F.replace(out, F.lit(control), F.lit("\\" + letter))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line else out


def _plain(text: Column, line: bool = False) -> Column:
    out = F.replace(text, F.lit("\\n"), F.lit("\n")) if line else text
    for control, letter in reversed(CONTROL.items()):
        out = F.replace(out, F.lit("\\" + letter), F.lit(control))
    return out


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask`` from rows of ``conv_id, turn, role, text``.

    ``loss_mask``: spans of ``formatted`` in code points (``start``, ``length``),
    with the number of the turn and the place of its text after the turn's mark.
    """
    part = F.col("part") if "part" in turns.columns else F.lit(0)
    marked = turns.select(
        "conv_id",
        F.struct(F.col("turn").alias("turn"), part.alias("part"), F.col("role").alias("role"), F.col("text").alias("text")).alias("at"),
        _escaped(F.col("role"), line=True).alias("head"),
        _escaped(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("learn"),
    ).withColumn("piece", F.concat(F.lit(TURN), "head", F.lit("\n"), "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("at")
    placed = marked.withColumn("number", F.row_number().over(order) - 1).withColumn(
        "before", F.coalesce(F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inner = F.char_length("head") + 1
    span = F.struct(
        F.col("number").alias("turn"),
        inner.alias("inner"),
        (F.col("before") + len(TURN) + inner).alias("start"),
        F.char_length("body").alias("length"),
    )
    grouped = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("number", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("learn"), span))).alias("loss_mask"),
    )
    return grouped.select("conv_id", F.array_join("pieces.piece", "").alias("formatted"), "loss_mask")


def read_back(chats: DataFrame) -> DataFrame:
    """Turns and learnt texts, from ``formatted`` and ``loss_mask`` alone."""
    raw = F.slice(F.split("formatted", r"<\|turn\|>"), 2, F.greatest(F.size(F.split("formatted", r"<\|turn\|>")) - 1, F.lit(0)))
    head = lambda x: F.substring_index(x, "\n", 1)
    body = lambda x: F.substring(x, F.char_length(head(x)) + 2, F.char_length(x) - F.char_length(head(x)) - 1 - len(END))
    parsed = chats.withColumn("raw", raw)
    return parsed.select(
        "conv_id",
        "formatted",
        F.transform(
            "raw", lambda x: F.struct(_plain(head(x), line=True).alias("role"), _plain(body(x)).alias("text"))
        ).alias("turns"),
        F.transform(
            "loss_mask", lambda s: _plain(F.substring(F.get("raw", s["turn"]), s["inner"] + 1, s["length"]))
        ).alias("learnt"),
    )


def chat_report(rows: DataFrame) -> DataFrame:
    """Digests of each conversation as read back from its formatted text."""
    return digests(read_back(format_chats(turn_rows(rows))))


def digests(back: DataFrame) -> DataFrame:
    """What was read back, a row a conversation, as digests."""
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    loss = F.array_join("learnt", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", turn), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
