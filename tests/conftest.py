from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from usertrail.config import local_session  # noqa: E402

TINY = [
    ("101", "2026-04-01 09:00:00", "page_viewed"),
    ("101", "2026-04-01 09:00:15", "signup_clicked"),
    ("101", "2026-04-01 09:01:00", "signup_submitted"),
    ("101", "2026-04-01 09:01:05", "welcome_viewed"),
    ("101", "2026-04-01 11:30:00", "page_viewed"),
    ("101", "2026-04-02 14:15:00", "settings_opened"),
    ("101", "2026-04-02 14:15:12", "settings_closed"),
    ("102", "2026-04-01 10:05:00", "page_viewed"),
    ("102", "2026-04-01 10:05:30", "search_submitted"),
    ("102", "2026-04-01 10:06:00", "result_clicked"),
    ("102", "2026-04-01 10:06:30", "item_viewed"),
    ("102", "2026-04-03 08:00:00", "page_viewed"),
    ("102", "2026-04-03 08:02:00", "checkout_started"),
    ("102", "2026-04-03 08:03:00", "checkout_failed"),
    ("102", "2026-04-03 08:04:00", "checkout_retried"),
    ("102", "2026-04-03 08:05:00", "checkout_completed"),
    ("103", "2026-04-02 16:00:00", "page_viewed"),
    ("103", "2026-04-02 16:00:45", "help_opened"),
    ("103", "2026-04-02 16:01:00", "help_closed"),
    ("103", "2026-04-02 16:01:30", "page_viewed"),
]

WITH_ATTRS = [
    ("201", "2026-04-01 10:00:00", "page_viewed", "PL", "premium"),
    ("201", "2026-04-01 10:01:00", "item_clicked", "PL", "premium"),
    ("201", "2026-04-01 10:01:30", "checkout_started", "PL", "premium"),
    ("201", "2026-04-01 10:03:00", "checkout_completed", "PL", "premium"),
    ("202", "2026-04-01 11:00:00", "page_viewed", "UA", "free"),
    ("202", "2026-04-01 11:00:30", "item_clicked", "UA", "free"),
    ("202", "2026-04-01 11:01:00", "checkout_started", "UA", "free"),
    ("202", "2026-04-01 11:35:00", "page_viewed", "UA", "free"),
]

ALIASED = [
    ("A", "2026-04-01 09:00:00", "viewed"),
    ("A", "2026-04-01 09:00:15", "clicked"),
    ("A", "2026-04-01 09:00:30", "submitted"),
    ("B", "2026-04-02 10:00:00", "viewed"),
    ("B", "2026-04-02 10:00:20", "clicked"),
]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture
def tiny(spark):
    return spark.createDataFrame(TINY, "user_id string, timestamp string, event_name string")


@pytest.fixture
def with_attrs(spark):
    return spark.createDataFrame(
        WITH_ATTRS, "user_id string, timestamp string, event_name string, user_country string, user_plan string")


@pytest.fixture
def aliased(spark):
    return spark.createDataFrame(ALIASED, "uid string, ts string, event string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
