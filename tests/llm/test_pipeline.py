"""Each stage on what its predecessor kept, and the registered queries with SQL."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from llm_helpers import DOCUMENTS, SF_DIR, awkward_rows, cycled, mix_targets, near_components, space_words
from tokenizers import Tokenizer

import corpus_pipeline
from harvestline.llm.common import Scratch, table
from harvestline.llm.language_id import has_letter
from harvestline.llm.queries import BOOK, word_tokenizer


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage."""
    docs, out = table(spark, SF_DIR, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = Scratch(spark, "test").keep(stage(spark, docs, SF_DIR), name)
        out.append((name, docs, made))
        docs = made
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_all_but_the_last_keep_the_columns(stages):
    assert [name for name, _, _ in stages] == ["language_id", "near_dedup", "decontaminate", "mix", "token_files"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_language_stage_drops_what_has_no_letters(stages):
    _, before, after = stages[0]
    assert Counter(rows_of(after)) == Counter(r for r in rows_of(before) if has_letter(r[1]))


def test_near_dedup_stage_keeps_one_of_each_group(stages):
    _, before, after = stages[1]
    rows = sorted(rows_of(before))
    roots, sizes = near_components([r[1] for r in rows], 5, 80, 100)
    assert sorted(rows_of(after)) == [r for i, (r, n) in enumerate(zip(rows, sizes, strict=True)) if not n or roots[i] == i]


def test_decontamination_stage_drops_whole_passages(spark, stages):
    _, before, after = stages[2]
    words = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [words(r["text"]) for r in table(spark, SF_DIR, "benchmark").collect()]
    clean = {r[0] for r in rows_of(before) if not any(f" {i} " in f" {words(r[1])} " for i in items)}
    kept = {r[0] for r in rows_of(after)}
    assert kept <= clean
    # What else goes must hold much of an item.
    for r in rows_of(before):
        if r[0] in clean - kept:
            own = words(r[1]).split()
            grams = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
            assert any(len(grams & {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) >= 3 for w in map(str.split, items))


def test_mixing_stage_takes_the_targets(stages):
    _, before, after = stages[3]
    total, longest = Counter(), Counter()
    for r in rows_of(before):
        n = len(space_words(r[1]))
        total[r[3]] += n
        longest[r[3]] = max(longest[r[3]], n)
    want = mix_targets(total, cycled(total), 3)
    taken = Counter()
    for r in rows_of(after):
        taken[r[3]] += len(space_words(r[1]))
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in total)
    assert set(rows_of(after)) <= set(rows_of(before))
    assert max(Counter(rows_of(after)).values()) <= 3


def test_token_files_hold_the_mix(stages):
    _, before, after = stages[4]
    library, start, want = Tokenizer.from_file(word_tokenizer()), 0, []
    for doc_id, text, *_ in sorted(rows_of(before), key=lambda r: (r[0], r[1].encode())):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(rows_of(after), key=lambda r: r[1]) == want


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(rows_of(corpus_pipeline.run(spark, SF_DIR))) == sorted(rows_of(stages[-1][2]))


def test_awkward_and_empty_documents_pass_all_stages(spark):
    for rows in (awkward_rows(), []):
        docs = spark.createDataFrame(rows, DOCUMENTS)
        for name, stage in corpus_pipeline.STAGES:
            docs = Scratch(spark, "test").keep(stage(spark, docs, SF_DIR), name)
        assert (docs.count() > 0) == bool(rows)


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in BOOK.queries) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(BOOK.oracles))
def test_matches_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = BOOK.queries[name](spark, SF_DIR)
    columns = sorted(df.columns)
    relation = con.sql(BOOK.oracles[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want
