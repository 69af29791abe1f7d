import json
import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from harvestline import model as m  # noqa: E402
from harvestline.plans.store import Store  # noqa: E402
from harvestline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", "6g")
    yield session
    session.stop()


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def day(n):
    return f"2026-01-{n:02d}T00:00:00Z"


def page(items, source="s1", run="r1", no=1, status=200, attempt=1, body=None, headers=None, cursor=None):
    text = json.dumps({"items": items}) if body is None else body
    return (source, run, no, attempt, datetime(2026, 1, 1), status, headers or {}, cursor, text)


@pytest.fixture
def pages_df(spark):
    return lambda *rows: spark.createDataFrame(list(rows), m.PAGES)


def spec(source="s1", drift=None, watermark=True, destination=None, suspend_after=None, **http):
    settings = {"url": "https://vendor.invalid/e", "records_path": "items", **http}
    resume = {"record_field": "updated_at", "param": "since"} if watermark else None
    return (source, "* * * * *", None, None, settings, resume, destination, drift, suspend_after, None, None, None)


@pytest.fixture
def specs_df(spark):
    return lambda *rows: spark.createDataFrame(list(rows) or [spec()], m.SPECS)


def table(name="events", **more):
    return {"type": "BigQuery", "project": "p", "dataset": "d", "table": name, **more}


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
