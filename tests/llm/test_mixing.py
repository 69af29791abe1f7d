from collections import Counter

import pytest
from llm_helpers import DOCUMENTS, awkward_rows, cycled, mix_targets, space_words

from harvestline.llm.mixing import mix_documents, mix_report
from harvestline.llm.queries import SCHEDULES


def sizes(rows):
    total = Counter()
    for _, text, _, source, _ in rows:
        total[source] += len(space_words(text))
    return total


def check(rows, got):
    total = sizes(rows)
    want = mix_targets(total, cycled(total), 3)
    words = sorted((r[0], len(space_words(r[1]))) for r in rows if r[0] is not None)
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == words
    by_target = {(r["source_size"], round(r["target"], 4)) for r in got}
    assert by_target == {(total[s], round(want[s], 4)) for s in total}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    return want


def test_targets_and_taken(spark):
    rows = [(i, "w " * (i % 17 + 1), "en", f"s{i % 7}" if i % 7 else None, 1) for i in range(2000)]
    got = mix_report(spark.createDataFrame(rows, DOCUMENTS), SCHEDULES).collect()
    want = check(rows, got)
    taken = Counter()
    for r, row in zip(sorted(got, key=lambda r: r["doc_id"]), rows, strict=True):
        taken[row[3]] += r["taken"]
    for source, target in want.items():
        assert taken[source] == pytest.approx(target, abs=17)


def test_awkward_rows(spark):
    rows = awkward_rows()
    check(rows, mix_report(spark.createDataFrame(rows, DOCUMENTS), SCHEDULES).collect())


def test_reruns_agree_whatever_the_partitions(spark):
    rows = [(i, "w " * (i % 5), "en", f"s{i % 3}", 1) for i in range(500)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    a, b = (sorted(map(tuple, mix_report(d, SCHEDULES).collect())) for d in (df.repartition(3), df.repartition(11)))
    assert a == b


def test_documents_follow_the_plan_in_order_of_position(spark):
    rows = [(i, f"w{i} " * 4, "en", "early" if i % 2 else "late", 1) for i in range(400)]
    schedules = [[(0.0, 1.0), (1.0, 0.0)], [(0.0, 0.0), (1.0, 1.0)]]
    df = spark.createDataFrame(rows, DOCUMENTS)
    plan = {r["doc_id"]: r["copies"] for r in mix_report(df, schedules).collect()}
    mixed = mix_documents(df, schedules, partitions=4)
    assert mixed.columns == df.columns
    out = [r["doc_id"] for r in mixed.collect()]
    assert Counter(out) == Counter({d: c for d, c in plan.items() if c})
    # The falling source fills the start, the rising one the end.
    quarter = len(out) // 4
    assert sum(d % 2 for d in out[:quarter]) > 0.75 * quarter
    assert sum(d % 2 for d in out[-quarter:]) < 0.25 * quarter


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert mix_report(empty, SCHEDULES).collect() == []
    assert mix_documents(empty, SCHEDULES).collect() == []
    rows = awkward_rows()
    named = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 AS size", "2 AS target", "3 AS unit", "4 AS copies", "5 AS _of", "6 AS _at", "7 AS doc")
    check(rows, mix_report(named, SCHEDULES).collect())
    assert mix_documents(named, SCHEDULES).columns == named.columns


def test_sources_without_words(spark):
    empty = [(1, None, None, "none", None), (2, "", "en", "none", 0), (3, " \t\n", "en", "none", 3), (4, "", "en", None, 0)]
    words = [(i, "w " * (i % 5 + 1), "en", f"s{i % 2}", 1) for i in range(10, 60)]
    for rows in (empty, empty + words):
        df = spark.createDataFrame(rows, DOCUMENTS)
        got = mix_report(df, SCHEDULES).collect()
        check(rows, got)
        none = [r for r in got if r["doc_id"] < 10]
        assert [(r["target"], r["copies"], r["taken"], r["first_position"]) for r in none] == [(0.0, 1, 0, 0.0)] * 4
        mixed = Counter(r["doc_id"] for r in mix_documents(df, SCHEDULES).collect())
        assert mixed == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


@pytest.mark.parametrize("schedules", [[[(0.0, 0.0), (1.0, 0.0)], [(0.0, 2.0), (1.0, 1.0)]], [[(0.0, 0.0), (1.0, 0.0)]]])
def test_a_source_without_weight_gives_no_words(spark, schedules):
    rows = [(i, "w " * (i % 5 + 1), "en", f"s{i % 3}", 1) for i in range(90)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    got = mix_report(df, schedules).collect()
    total = sizes(rows)
    weightless = {s for k, s in enumerate(sorted(total)) if sum(w for _, w in schedules[k % len(schedules)]) == 0}
    source = {r[0]: r[3] for r in rows}
    for r in got:
        if source[r["doc_id"]] in weightless:
            assert (r["target"], r["taken"], r["copies"]) == (0.0, 0, 0)
    open_ = [r for r in got if source[r["doc_id"]] not in weightless]
    # One open source, which stops at three times its size.
    assert all(r["target"] == 3 * r["source_size"] and r["copies"] == 3 for r in open_)
    assert mix_documents(df, schedules).count() == 3 * len(open_)
