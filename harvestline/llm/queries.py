"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from harvestline.llm import (
    chat_format,
    decontaminate,
    exact_dedup,
    filter_audit,
    jaccard_join,
    language_id,
    license_scan,
    mixing,
    near_dedup,
    sharding,
    token_counts,
    token_files,
    vector_codes,
)
from harvestline.llm.common import Scratch, prepare, table
from harvestline.queries.book import Book

BOOK = Book()
_ADD = BOOK.add

# A source's weight at the start and the end of training, and between: 5, 2 and 1 on average.
SCHEDULES = [
    [(0.0, 6.0), (1.0, 4.0)],
    [(0.0, 1.0), (0.5, 3.0), (1.0, 1.0)],
    [(0.0, 0.5), (1.0, 1.5)],
]
SHARD_BYTES = 16 << 20


@cache
def word_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def add(name: str, oracle: str | None = None):
    """Register a query that hands Python small batches."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        return _ADD(name, oracle)(run)

    return register


@add(
    "op1_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS n,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
        FROM documents
    )
    SELECT doc_id,
           first_value(doc_id) OVER g AS keep_id,
           count(*) OVER (PARTITION BY body) AS group_size,
           row_number() OVER g = 1 AS kept,
           sha256(body) AS text_sha256
    FROM d
    WINDOW g AS (PARTITION BY body ORDER BY n DESC, doc_id)
    """,
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@add("op2_curriculum_mix")
def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"), SCHEDULES)


@add("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), word_tokenizer())


@add("op4_extendible_shards")
def op4_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"), SHARD_BYTES)


@add("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-files")
    path = scratch.path("ids")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, word_tokenizer())
    return token_files.read_digests(spark, path)


@add("op6_spaced_seed_leaks")
def op6_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


@add("op9_license_diagonals")
def op9_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def _escape_sql(text: str, line: bool = False) -> str:
    out = f"coalesce({text}, '')"
    for control, letter in chat_format.CONTROL.items():
        out = f"replace({out}, '{control}', '\\{letter}')"
    return f"replace({out}, chr(10), '\\n')" if line else out


_PROBE = "</s>[INST] ok [/INST]"


@add(
    "op10_chat_format",
    f"""
    WITH rows AS (
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '{_PROBE}'), (-1, 1, 'assistant', '{_PROBE}')
    ), turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               length('{chat_format.TURN}') + length({_escape_sql("role", line=True)}) + 1
               + length({_escape_sql("text")}) + {len(chat_format.END)} AS written,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
        FROM rows
    ), chats AS (
        SELECT conv_id, count(*) AS n_turns,
               string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS told,
               coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS learnt,
               sum(written)::BIGINT AS formatted_chars
        FROM turns GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learnt) AS loss_chars,
           sha256(learnt) AS loss_sha256, formatted_chars
    FROM chats
    """,
)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame(
        [(-1, 0, "user", _PROBE), (-1, 1, "assistant", _PROBE)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.chat_report(rows)


@add("op5_bbit_minhash")
def op5_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_report(table(spark, sf_dir, "documents"))


@add("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def _codebook_sql() -> str:
    """The rounds as one step after the other: nearest entries of all parts, then floors of their means."""
    nearest = """a{n} AS MATERIALIZED (
        SELECT vec_id, p, y, arg_min(k, struct_pack(d := d, k := k)) AS k, min(d) AS d
        FROM (SELECT v.vec_id, p, v.y, c.k,
                     (list_dot_product(v.y, v.y) - 2 * list_dot_product(v.y, c.y) + list_dot_product(c.y, c.y))::BIGINT AS d
              FROM parts v JOIN c{n} c USING (p))
        GROUP BY vec_id, p, y)"""
    means = """m{n} AS MATERIALIZED (
        SELECT p, k, list(m ORDER BY i) AS y FROM (
            SELECT p, k, i, floor(sum(y[i]) / count(*)) AS m FROM a{n}, range(1, 1 + len(y)) AS places(i) GROUP BY p, k, i)
        GROUP BY p, k),
    c{next} AS MATERIALIZED (SELECT p, k, coalesce(m.y, c.y) AS y FROM c{n} c LEFT JOIN m{n} m USING (p, k))"""
    rounds = ", ".join(f"{nearest.format(n=n)}, {means.format(n=n, next=n + 1)}" for n in range(vector_codes.ROUNDS))
    return f"""
    WITH whole AS (
        SELECT vec_id, label, list_transform(embedding, lambda c: floor({vector_codes.SCALE} * c::DOUBLE)) AS x
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    ), parts AS MATERIALIZED (
        SELECT vec_id, p, x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4] AS y FROM whole, range(4) AS positions(p)
    ), c0 AS MATERIALIZED (
        SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, y FROM parts
        QUALIFY k < {vector_codes.ENTRIES}
    ), {rounds}, {nearest.format(n=vector_codes.ROUNDS)}, coded AS (
        SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
        FROM a{vector_codes.ROUNDS} GROUP BY vec_id
    ), book AS (
        SELECT sha256(string_agg(list_aggregate(list_transform(y, lambda c: c::BIGINT), 'string_agg', ','), ',' ORDER BY p, k))
               AS codebooks_sha256 FROM c{vector_codes.ROUNDS}
    )
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM coded JOIN whole USING (vec_id), book
    """


@add("op11_vector_codes", _codebook_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


@add(
    "op12_filter_audit",
    r"""
    WITH words AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), failing AS (
        SELECT doc_id, part,
               CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
               || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
               || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
               || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
               || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed
        FROM words
    ), told AS (
        SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
    ), counts AS (
        SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
        FROM failing LEFT JOIN told USING (doc_id) GROUP BY part, failed
    ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
    ), steps AS (
        SELECT *, substr(filter_order, step, 1) AS letter, contains(failed, substr(filter_order, step, 1)) AS here,
               translate(failed, substr(filter_order, 1, step - 1), '') <> failed AS earlier
        FROM counts, orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)
    ), each AS (
        SELECT part, filter_order, step, letter,
               coalesce(sum(n) FILTER (NOT earlier AND NOT here), 0)::BIGINT AS kept,
               coalesce(sum(n) FILTER (NOT earlier AND here), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (earlier AND here), 0)::BIGINT AS redundant,
               coalesce(sum(n) FILTER (failed = letter), 0)::BIGINT AS unique_fails,
               coalesce(sum(good) FILTER (NOT earlier AND here), 0)::BIGINT AS good_lost,
               coalesce(sum(toxic) FILTER (NOT earlier AND here), 0)::BIGINT AS toxic_lost
        FROM steps GROUP BY part, filter_order, step, letter
    )
    SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM each
    """,
)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@add("op13_segment_join")
def op13_segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_report(table(spark, sf_dir, "documents"))
