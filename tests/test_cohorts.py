"""Edge rows of cohorts, extracts and the event catalogue."""

import datetime as dt

import pytest

from lectern.operators.cohorts import reading_list
from lectern.operators.events import event_catalog


def test_existence_semantics(spark):
    matches = spark.createDataFrame([(1, 5, "No"), (2, 6, "No"), (3, None, "No"), (4, 6, "Yes")],
                                    "book_id long, list_isbn long, available_status string")
    cleanup = spark.createDataFrame([(5,), (5,), (None,)], "list_isbn long")
    assert sorted(r.book_id for r in reading_list(matches, cleanup).collect()) == [1, 4]


def test_event_age_whole_days_and_tie_break(spark):
    ev = spark.createDataFrame([("b", "prod", dt.datetime(2024, 5, 20, 10)), ("a", "prod", dt.datetime(2024, 5, 19)),
                                ("c", "prod", dt.datetime(2024, 5, 25))],
                               "event_name string, environment_name string, record_date timestamp_ntz")
    out = event_catalog(ev, "2024-05-21", "2024-05-22", limit=1).collect()
    assert [(r.event_name, r.cnt) for r in out] == [("a", 1)]
    out = {r.event_name: r.last_time_event_was_received for r in event_catalog(ev, "2024-05-21", "2024-05-22").collect()}
    assert out == {"a": 3, "b": 1}


def _registrations(spark, rows):
    from lectern.sources.schemas import LOGICAL_SCHEMAS
    schema = LOGICAL_SCHEMAS["registrations"]
    full = [(u, ts, "direct", None, None, conv) + (None,) * 14 for u, ts, conv in rows]
    return spark.createDataFrame(full, schema)


def test_reference_cohort_labels_and_converted_filter(spark):
    from lectern.operators.cohorts import label_cohorts
    regs = _registrations(spark, [(1, dt.datetime(2022, 9, 14, 8), "Y"), (2, dt.datetime(2023, 10, 31, 23), "Y"),
                                  (3, dt.datetime(2022, 9, 2), "N"), (4, dt.datetime(2022, 11, 1), "Y")])
    got = {r.user_id: (r.cohort_month, r.cohort_year, r.cohort_period, r.registration_month)
           for r in label_cohorts(regs).collect()}
    assert got == {1: ("Sept", "2022", "Sept-2022", dt.datetime(2022, 9, 1)),
                   2: ("Oct", "2023", "Oct-2023", dt.datetime(2023, 10, 1))}


def test_subscription_rollup_rules(spark):
    from lectern.operators.cohorts import rollup_subscriptions
    subs = spark.createDataFrame(
        [(1, "subscribed", dt.datetime(2023, 1, 5), None, dt.date(2023, 3, 1), None),
         (1, "subscribed", dt.datetime(2023, 2, 5), dt.date(2023, 2, 20), dt.date(2023, 4, 1), 2),
         (1, "trial", dt.datetime(2022, 1, 1), dt.date(2030, 1, 1), None, 9)],
        "user_id long, subscription_type string, subscription_start_time timestamp_ntz, end_timestamp date, "
        "paid_end_timestamp date, subscribed_months int")
    r = rollup_subscriptions(subs).collect()[0]
    assert (r.sub_start_timestamp, r.sub_end_timestamp, r.subscribed_months) == \
        (dt.datetime(2023, 1, 5), dt.date(2023, 3, 1), 2)


def test_cohort_filters_optional_and_validated(spark):
    from lectern.operators.cohorts import filter_cohort
    df = spark.createDataFrame([("Sept", "p1", "web"), ("Oct", "p2", "app")],
                               "cohort_month string, user_persona string, platform_status string")
    assert filter_cohort(df, cohort_month=None, platform=None).count() == 2
    assert [r.cohort_month for r in filter_cohort(df, cohort_month=["Oct"], platform=["app"]).collect()] == ["Oct"]
    with pytest.raises(KeyError):
        filter_cohort(df, colour=["red"])
