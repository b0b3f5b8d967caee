"""Declared schemas of the logical tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B, DT, TS = (T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(),
                         T.BooleanType(), T.DateType(), T.TimestampNTZType())


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


LOGICAL_SCHEMAS: dict[str, T.StructType] = {
    # daily reading facts (reading_activity_daily / fct__reading_activity)
    "reading_activity": _schema(("user_id", L), ("book_id", L), ("read_date", DT),
                                ("reading_minutes", D)),
    # user dimension (dim__users)
    "users": _schema(("user_id", L), ("registration_date", DT), ("payment_model", S),
                     ("is_converted_subscribed", B), ("is_converted_paid", B),
                     ("user_persona", S), ("referrer_book_id", L), ("country_id", I)),
    "country_regions": _schema(("country_id", I), ("country", S), ("continent", S),
                               ("market", S), ("region", S)),
    # subscriptions (fct__subscriptions and analytics subscriptions in one)
    "subscriptions": _schema(("user_id", L), ("subscription_type", S),
                             ("subscription_start_time", TS), ("subscription_end_time", DT),
                             ("end_timestamp", DT), ("paid_end_timestamp", DT),
                             ("total_paid_gbp", D), ("subscribed_months", I)),
    # product events (fct__events / user_tracking_events)
    "event_facts": _schema(("user_id", L), ("event_id", L), ("event_name", S),
                           ("event_date", DT), ("session_id", S), ("book_id", I),
                           ("value", D)),
    "report_events": _schema(("user_id", L), ("event_id", L), ("event_name", S),
                           ("event_date", DT), ("session_id", S), ("book_id", I),
                           ("value", D)),
    "event_users": _schema(("user_id", L), ("reg_sub_start_time", DT)),
    "event_reading": _schema(("user_id", L), ("book_id", I), ("read_date", DT),
                             ("reading_minutes", D)),
    "book_meta": _schema(("id", L), ("isbn13_idvalue", S), ("hardback_isbn", S),
                         ("softback_isbn", S), ("title_text", S), ("publisher_name", S),
                         ("publisher_imprint", S), ("publication_date", S),
                         ("date_activated", DT), ("date_added", DT), ("subject_name", S),
                         ("topic_name1", S), ("topic_name2", S), ("topic_name3", S),
                         ("topic_name4", S), ("contributor1_name", S), ("contributor2_name", S),
                         ("contributor3_name", S), ("language_name", S), ("is_available", I)),
    "landing_pages": _schema(("dates", DT), ("book_id", S), ("locale", S),
                             ("impressions", S), ("clicks", S)),
    "academic_matches": _schema(("book_id", L), ("isbn", L), ("degree_name", S),
                                ("uni_code", S), ("degree_new_enrollments", S),
                                ("available_status", S)),
    "tracking": _schema(("event_name", S), ("environment_name", S), ("record_date", TS)),
    "book_matches": _schema(("book_id", L), ("list_isbn", L), ("available_status", S)),
    "cleanup": _schema(("list_isbn", L)),
    "registrations": _schema(("user_id", L), ("registration_time", TS),
                             ("payment_channel_crude", S), ("internal_user", S),
                             ("converted_trial", S), ("converted_subscribed", S),
                             ("converted_paid", S), ("acquisition_country", S),
                             ("acquisition_region", S), ("user_persona", S),
                             ("academic_institution", S), ("organisation_id", I),
                             ("organisation_name", S), ("utm_source", S), ("utm_medium", S),
                             ("referrer_book", L), ("internal_persona", S),
                             ("platform_status", S), ("country_language", S),
                             ("user_language", S)),
    "disciplines": _schema(("user_id", L), ("academic_discipline", S)),
}

# The published cohort table: 28 columns, appended by position.
COHORT_TABLE_SCHEMA = _schema(
    ("cohort_month", S), ("cohort_year", S), ("cohort_period", S),
    ("registration_month", TS), ("registration_time", TS), ("user_id", I),
    ("payment_channel_crude", S), ("internal_user", S), ("converted_trial", S),
    ("converted_subscribed", S), ("converted_paid", S), ("acquisition_country", S),
    ("acquisition_region", S), ("user_persona", S), ("academic_institution", S),
    ("organisation_id", I), ("organisation_name", S), ("utm_source", S), ("utm_medium", S),
    ("referrer_book", I), ("internal_persona", S), ("platform_status", S),
    ("country_language", S), ("user_language", S), ("academic_discipline", S),
    ("sub_start_timestamp", TS), ("sub_end_timestamp", TS), ("subscribed_months", L),
)
