"""Pages without numbers, in any order."""

import json
import random
from datetime import datetime

import pytest

from conftest import page, rows_of, spec, table
from harvestline.operators.chains import chain_places, number_pages
from harvestline.operators.walk import walk_runs
from harvestline.plans.run import run_batch
from harvestline.sources.pages import decode_pages, one_answer, page_config, page_facts

CURSOR = dict(records_path="items", pagination={"type": "Cursor", "next_cursor_path": "next", "max_pages": 10})
LINK = dict(records_path="items", pagination={"type": "LinkHeader", "max_pages": 10})


def asked(key, after, run="r1", n=1, **more):
    body = json.dumps({"items": [{"id": f"{key}-{i}"} for i in range(n)], **({} if after is None else {"next": after})})
    return page([], run=run, no=None, body=body, cursor=key, **more)


def walked(pages, specs):
    config = page_config(specs)
    found = number_pages(pages, config)
    return found, walk_runs(page_facts(decode_pages(one_answer(found), config)))


def outcomes(walks):
    return {r.run_id: (r.walk_status, r.end_page) for r in walks.collect()}


def test_cursor_chains(pages_df, specs_df):
    rows = [
        asked(None, "b"), asked("b", "d"), asked("d", None), asked("x", "y"),
        # Three cursors in a ring.
        asked(None, "1", "ring"), asked("1", "2", "ring"), asked("2", "3", "ring"), asked("3", "1", "ring"),
        # A cursor that repeats itself ends the walk; so does one that never was asked for.
        asked(None, "s", "self"), asked("s", "s", "self"),
        asked(None, "gone", "broken"), asked("later", None, "broken"),
        asked("only", None, "headless"),
        # The last answer to a question counts, and a refused one is none.
        asked(None, "old", "again"), asked(None, "new", "again", attempt=2), asked("new", None, "again"),
        asked("new", None, "again", status=503, attempt=4),
    ]
    random.Random(3).shuffle(rows)
    found, walks = walked(pages_df(*rows), specs_df(spec(**CURSOR)))
    assert outcomes(walks) == {
        "r1": ("complete", 3),
        "ring": ("max_pages_exceeded", 4),
        "self": ("complete", 2),
        "broken": ("truncated", 1),
        "headless": ("truncated", 0),
        "again": ("complete", 2),
    }
    numbers = rows_of(found.where("run_id IN ('r1', 'again')"), "run_id", "request_cursor", "page_no")
    assert numbers == sorted(
        [("again", None, 1)] * 2 + [("again", "new", 2)] * 2 + [("r1", None, 1), ("r1", "b", 2), ("r1", "d", 3), ("r1", "x", None)],
        key=repr,
    )


def test_link_chains_and_numbered_pages_beside_them(pages_df, specs_df):
    link = lambda url: {"link": f'<{url}>; rel="next"'}
    at = "https://vendor.invalid/?at="
    rows = [
        page([{"id": 3}], no=None, cursor=at + "c"),
        page([{"id": 1}], no=None, headers=link(at + "b")),
        page([{"id": 2}], no=None, cursor=at + "b", headers=link(at + "c")),
        page([{"id": 1}], run="r2", no=1, headers=link(at + "z")),
        page([{"id": 2}], run="r2", no=2, cursor=at + "z"),
    ]
    _, walks = walked(pages_df(*rows), specs_df(spec(**LINK)))
    assert outcomes(walks) == {"r1": ("complete", 3), "r2": ("complete", 2)}


@pytest.mark.parametrize("length", [1, 2, 63, 64, 65, 300])
def test_places_of_long_chains_and_rings(spark, length):
    rng = random.Random(length)
    keys = [""] + [f"k{i}" for i in range(1, length)]
    line = [("s", "line", a, b) for a, b in zip(keys, keys[1:])]  # noqa: B905
    back = rng.randrange(length)
    ring = [("s", "ring", a, b) for a, b in zip(keys, keys[1:] + [keys[back]])]  # noqa: B905
    steps = [s for s in line + ring if s[2] != s[3]]
    rng.shuffle(steps)
    schema = "source_id string, run_id string, key string, after string"
    starts = spark.createDataFrame([("s", "line"), ("s", "ring")], "source_id string, run_id string")
    got = rows_of(chain_places(starts, spark.createDataFrame(steps, schema), 1000))
    loops = back < length - 1
    want = [("s", run, k, i + 1, loops and run == "ring") for run in ("line", "ring") for i, k in enumerate(keys)]
    assert got == sorted(want, key=repr)


def test_a_batch_of_loose_pages_lands_what_numbered_ones_do(store, pages_df, specs_df):
    loose = [asked(None, "b", n=2), asked("b", "c", n=3), asked("c", None, n=1), asked("stray", "b", n=5)]
    loose += [asked(None, "b", "r2"), asked("b", None, "r2", status=404), asked("c", None, "r2")]
    specs = specs_df(spec(watermark=False, destination=table(), **CURSOR))
    random.Random(1).shuffle(loose)
    out = run_batch(store, pages_df(*loose), specs, batch_id="b1", now=datetime(2026, 2, 1))
    assert rows_of(out, "run_id", "result", "rows_ingested", "error") == [
        ("r1", "Succeeded", 6, None),
        ("r2", "Failed", 0, "upstream returned 404"),
    ]
    assert rows_of(store.read_table("d.events"), "id") == sorted(
        [("None-0",), ("None-1",), ("b-0",), ("b-1",), ("b-2",), ("c-0",)], key=repr
    )
