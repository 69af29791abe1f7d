"""Where pagination ends."""

import json

import pytest

from conftest import page, rows_of, spec
from harvestline.operators.walk import keep_walked, walk_runs
from harvestline.sources.pages import decode_pages, explode_records, page_config, page_facts, responses


def walk(pages, specs):
    decoded = decode_pages(responses(pages), page_config(specs))
    walks = walk_runs(page_facts(decoded))
    return decoded, walks


def ids(n, start=0):
    return [{"id": start + i} for i in range(n)]


def cursor_page(no, nxt, sent=None, run="r1", n=2):
    meta = {} if nxt is None else {"next_cursor": nxt}
    body = json.dumps({"data": {"items": ids(n)}, "meta": meta})
    return page([], run=run, no=no, body=body, cursor=sent)


CURSOR = dict(records_path="data.items", pagination={"type": "Cursor", "next_cursor_path": "meta.next_cursor", "max_pages": 10})


def outcome(walks, run="r1"):
    r = walks.where(f"run_id = '{run}'").head()
    return r.walk_status, r.end_page


def test_cursor_walks(pages_df, specs_df):
    rows = [
        # Ends when no cursor comes; a page after that is not read.
        cursor_page(1, "2"), cursor_page(2, "4", "2"), cursor_page(3, None, "4"), cursor_page(4, "9", "8"),
        # A repeated cursor ends the walk at its first repeat.
        cursor_page(1, "same", run="r2", n=1), cursor_page(2, "same", "same", run="r2", n=1),
        cursor_page(3, "same", "same", run="r2", n=1),
        # A numeric cursor counts, an empty one does not.
        cursor_page(1, 7, run="r3"), cursor_page(2, "", "7", run="r3"),
        # A page is missing.
        cursor_page(1, "2", run="r4"), cursor_page(3, None, "4", run="r4"),
        # The first page is missing.
        cursor_page(2, None, "2", run="r5"),
    ]
    decoded, walks = walk(pages_df(*rows), specs_df(spec(**CURSOR)))
    walks.cache()
    assert outcome(walks) == ("complete", 3)
    assert outcome(walks, "r2") == ("complete", 2)
    assert outcome(walks, "r3") == ("complete", 2)
    assert outcome(walks, "r4") == ("truncated", 1)
    assert outcome(walks, "r5") == ("truncated", 0)
    kept = explode_records(keep_walked(decoded, walks))
    counts = {r.run_id: r["count"] for r in kept.groupBy("run_id").count().collect()}
    assert counts == {"r1": 6, "r2": 2, "r3": 4, "r4": 2}


def test_max_pages_is_a_failure(pages_df, specs_df):
    settings = {**CURSOR, "pagination": {**CURSOR["pagination"], "max_pages": 2}}
    rows = [cursor_page(i, str(i), str(i - 1)) for i in (1, 2, 3)]
    _, walks = walk(pages_df(*rows), specs_df(spec(**settings)))
    r = walks.head()
    assert (r.walk_status, r.end_page) == ("max_pages_exceeded", 2)
    assert "maxPages=2" in r.walk_error


@pytest.mark.parametrize("kind", ["PageNumber", "Offset"])
def test_short_page_ends_the_walk(kind, pages_df, specs_df):
    rows = [page(ids(3), no=1), page(ids(3), no=2), page(ids(1), no=3), page(ids(3), no=4)]
    # Without a page size only an empty page is the last.
    rows += [page(ids(1), source="s2", no=1), page([], source="s2", no=2)]
    decoded, walks = walk(
        pages_df(*rows),
        specs_df(
            spec(pagination={"type": kind, "page_size": 3, "max_pages": 10}),
            spec("s2", pagination={"type": kind, "max_pages": 10}),
        ),
    )
    got = {(r.source_id, r.walk_status, r.end_page) for r in walks.collect()}
    assert got == {("s1", "complete", 3), ("s2", "complete", 2)}
    assert explode_records(keep_walked(decoded, walks)).where("source_id = 's1'").count() == 7


def test_null_elements_count_as_records(pages_df, specs_df):
    rows = [page([None, None, None], no=1), page([None], no=2)]
    _, walks = walk(pages_df(*rows), specs_df(spec(pagination={"type": "PageNumber", "page_size": 3})))
    assert outcome(walks) == ("complete", 2)


def test_link_none_and_unknown(pages_df, specs_df):
    link = {"Link": '<https://v.invalid/?p=2>; rel="next", <https://v.invalid/?p=9>; rel="last"'}
    rows = [
        page(ids(1), no=1, headers=link), page(ids(1), no=2),
        page(ids(1), source="s2", no=1), page(ids(1), source="s2", no=2),
        page(ids(1), source="s3", no=1),
    ]
    specs = specs_df(
        spec(pagination={"type": "LinkHeader", "max_pages": 5}), spec("s2"), spec("s3", pagination={"type": "Spiral"})
    )
    _, walks = walk(pages_df(*rows), specs)
    assert rows_of(walks, "source_id", "walk_status", "end_page") == [
        ("s1", "complete", 2), ("s2", "complete", 1), ("s3", "unsupported", 1)
    ]


def test_bad_pages_are_errors_not_empty_runs(pages_df, specs_df):
    bodies = {"a": '{"items":', "b": '{"other":[]}', "c": '{"items":{"id":1}}', "d": '{"items":null}', "e": '{"items":[]}'}
    rows = [page([], run=k, body=v) for k, v in bodies.items()]
    _, walks = walk(pages_df(*rows), specs_df())
    got = {r.run_id: (r.walk_status, r.walk_error) for r in walks.collect()}
    assert got["a"] == ("failed", "decode response: not valid JSON")
    assert got["b"] == ("failed", 'recordsPath "items" not found in response')
    assert got["c"] == ("failed", 'recordsPath "items" is an object, want an array')
    assert got["d"] == ("failed", 'recordsPath "items" is null, want an array')
    assert got["e"] == ("complete", None)


def test_whole_document_as_array(pages_df, specs_df):
    decoded, _ = walk(pages_df(page([], body='[{"id":1},2]')), specs_df(spec(records_path=None)))
    assert explode_records(decoded).count() == 2


def test_retried_page_is_read_once(pages_df, specs_df):
    rows = [page([], status=503, attempt=1, body="busy"), page(ids(2), attempt=2)]
    decoded, walks = walk(pages_df(*rows), specs_df())
    assert outcome(walks) == ("complete", 1)
    assert explode_records(decoded).count() == 2


def test_long_walks_end_at_their_first_gap(spark):
    missing = {"whole": [], "late": [150_001], "edge": [1024], "after_edge": [1025, 4000], "first": [1], "many": list(range(2, 200_000, 2))}
    stop = {"whole": 200_000, "after_edge": 1024, "edge": 1025}
    numbers = spark.range(1, 200_001).selectExpr("CAST(id AS int) AS page_no").repartition(8)
    gaps = spark.createDataFrame([(run, no) for run, out in missing.items() for no in out] or [("", 0)], "run_id string, page_no int")
    runs = spark.createDataFrame([(run, stop.get(run)) for run in missing], "run_id string, stop int")
    facts = (
        numbers.crossJoin(runs)
        .join(gaps, ["run_id", "page_no"], "left_anti")
        .selectExpr(
            "'s1' AS source_id", "run_id", "page_no", "1000000 AS max_pages", "'PageNumber' AS pagination_type",
            "CAST(NULL AS string) AS page_error", "page_no <=> stop AS terminal", "false AS loops",
        )
    )
    walks = {r.run_id: (r.walk_status, r.end_page) for r in walk_runs(facts).collect()}
    assert walks == {
        "whole": ("complete", 200_000),
        "late": ("truncated", 150_000),
        "edge": ("truncated", 1023),
        "after_edge": ("complete", 1024),
        "first": ("truncated", 0),
        "many": ("truncated", 1),
    }
