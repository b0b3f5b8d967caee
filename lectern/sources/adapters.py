"""Adapters: the logical tables built from the driver's star-schema tables.

The test data has no reader or subscription tables, so each logical table is
derived from the driver tables by a fixed rule (see FIXTURES.md §3). On real
data ``catalog.load`` reads the logical table itself and none of this runs.
Every adapter is a plain DataFrame plan, so column pruning and filter
pushdown reach the driver-table scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import spread, spread_tasks

Reader = Callable[[str], DataFrame]


def _date(value: str) -> Column:
    return F.lit(value).cast("date")


def _days(start: Column, n: Column) -> Column:
    return F.date_add(start, n.cast("int"))


def _first_number(col: str) -> Column:
    return F.regexp_extract(F.col(col), "[0-9]+", 0)


def _event_day_offset(step: int) -> Column:
    return F.lit(step) * (F.dayofmonth("ts") - 1)


def reading_activity(read: Reader) -> DataFrame:
    li = read("lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_quantity")
    o = read("orders").select("o_orderkey", "o_custkey")
    tasks = spread_tasks(li, o)
    li, o = spread(li, tasks, "l_orderkey"), spread(o, tasks, "o_orderkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("book_id"),
                    F.to_date("l_shipdate").alias("read_date"),
                    (F.col("l_quantity") * 4).alias("reading_minutes")))


def users(read: Reader) -> DataFrame:
    c = read("customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    first = (read("orders").groupBy("o_custkey")
             .agg(F.to_date(F.min("o_orderdate")).alias("registration_date")))
    key = F.col("c_custkey")
    return (c.join(first, key == first.o_custkey)
            .select(key.alias("user_id"), "registration_date",
                    F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE"), "direct")
                    .otherwise("partner").alias("payment_model"),
                    (F.col("c_acctbal") > 0).alias("is_converted_subscribed"),
                    (F.col("c_acctbal") > 2000).alias("is_converted_paid"),
                    F.col("c_mktsegment").alias("user_persona"),
                    F.when(key % 10 == 0, F.lit(None)).otherwise(key % 200).alias("referrer_book_id"),
                    F.col("c_nationkey").alias("country_id")))


def country_regions(read: Reader) -> DataFrame:
    n = read("nation")
    r = read("region")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("n_nationkey").alias("country_id"), F.col("n_name").alias("country"),
                    F.col("r_name").alias("continent"), F.col("r_name").alias("market"),
                    F.concat("r_name", F.lit("-"), (F.col("n_nationkey") % 2).cast("string"))
                    .alias("region")))


def subscriptions(read: Reader) -> DataFrame:
    o = read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    planned_end = _days(day, 30 * (key % 12))
    return o.select(
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "P", "trial").otherwise("subscribed").alias("subscription_type"),
        F.when(key % 50 == 0, F.lit(None)).otherwise(F.col("o_orderdate")).alias("subscription_start_time"),
        F.when(F.col("o_orderstatus") == "O", _date("9999-12-31")).otherwise(planned_end)
        .alias("subscription_end_time"),
        F.when(key % 9 == 0, F.lit(None)).otherwise(planned_end).alias("end_timestamp"),
        F.date_add(day, 45).alias("paid_end_timestamp"),
        F.when(key % 5 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("total_paid_gbp"),
        F.when(key % 7 == 0, F.lit(None)).otherwise((key % 12).cast("int")).alias("subscribed_months"),
    )


def event_facts(read: Reader) -> DataFrame:
    e = read("events")
    kind = F.col("event_type")
    return e.select(
        "user_id", "event_id",
        F.when(kind == "view", "open book").when(kind == "click", "page load")
        .when(kind == "signup", "chapter load").when(kind == "purchase", "highlight creation")
        .otherwise("annotation creation").alias("event_name"),
        _days(_date("2024-01-01"), _event_day_offset(4)).alias("event_date"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.dayofmonth("ts").cast("string"))
        .alias("session_id"),
        F.when(F.col("event_id") % 20 == 0, F.lit(None)).otherwise(_first_number("props").cast("int"))
        .alias("book_id"),
        "value",
    )


def report_events(read: Reader) -> DataFrame:
    """Events of the reports' people: each event belongs to the customer of the
    order with its number, up to 120 days after that customer's first order,
    so that the reports' event windows hold data."""
    facts = event_facts(read).drop("user_id", "event_date", "session_id")
    o = read("orders")
    first = o.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("_first"))
    owner = o.select(F.col("o_orderkey").alias("event_id"), "o_custkey").join(first, "o_custkey")
    day = read("events").select("event_id", _event_day_offset(4).alias("_day"))
    return facts.join(owner, "event_id").join(day, "event_id").select(
        F.col("o_custkey").alias("user_id"), "event_id", "event_name", _days(F.col("_first"), F.col("_day")).alias("event_date"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.col("_day").cast("string")).alias("session_id"),
        "book_id", "value")


def event_users(read: Reader) -> DataFrame:
    u = read("events").select("user_id").distinct()
    return u.select("user_id", _days(_date("2024-01-01"), F.col("user_id") % 3).alias("reg_sub_start_time"))


def event_reading(read: Reader) -> DataFrame:
    e = read("events")
    return e.select("user_id", _first_number("props").cast("int").alias("book_id"),
                    _days(_date("2024-01-01"), _event_day_offset(4)).alias("read_date"),
                    F.col("value").alias("reading_minutes"))


def book_meta(read: Reader) -> DataFrame:
    p = read("part")
    key, size = F.col("p_partkey"), F.col("p_size")

    def blank_if(cond: Column, value: Column) -> Column:
        return F.when(cond, F.lit("")).otherwise(value)

    def pad2(c: Column) -> Column:
        return F.lpad(c.cast("string"), 2, "0")

    pub = (F.when(size % 10 == 0, F.lit("")).when(size % 10 == 1, F.lit("NONE"))
           .when(size % 10 == 2, F.lit(None).cast("string")).when(size % 10 == 3, F.lit("na"))
           .otherwise(F.concat(F.lit("20"), pad2(size % 25), F.lit("-"), pad2(1 + key % 12),
                               F.lit("-"), pad2(1 + key % 28))))
    none = F.lit(None).cast("string")
    return p.select(
        key.alias("id"), none.alias("isbn13_idvalue"),
        blank_if(key % 5 == 0, (9780000 + key).cast("string")).alias("hardback_isbn"),
        (9790000 + key).cast("string").alias("softback_isbn"),
        F.col("p_name").alias("title_text"), F.col("p_brand").alias("publisher_name"),
        F.col("p_type").alias("publisher_imprint"), pub.alias("publication_date"),
        _days(_date("2020-01-01"), key % 365).alias("date_activated"),
        _days(_date("2019-01-01"), key % 200).alias("date_added"),
        blank_if(key % 3 == 0, F.col("p_type")).alias("subject_name"),
        blank_if(key % 2 == 0, F.col("p_brand")).alias("topic_name1"),
        blank_if(key % 4 == 0, F.col("p_type")).alias("topic_name2"),
        none.alias("topic_name3"), none.alias("topic_name4"),
        blank_if(key % 6 == 0, F.col("p_name")).alias("contributor1_name"),
        F.when(key % 7 == 0, none).otherwise(F.col("p_brand")).alias("contributor2_name"),
        none.alias("contributor3_name"),
        F.when(size % 3 == 0, "English").when(size % 3 == 1, "Spanish").otherwise("German")
        .alias("language_name"),
        F.when(key % 20 == 0, 0).otherwise(1).alias("is_available"),
    )


def landing_pages(read: Reader) -> DataFrame:
    e = read("events")
    mod = F.col("user_id") % 4
    return e.select(
        _days(_date("2024-01-01"), _event_day_offset(10)).alias("dates"),
        F.when(F.col("event_id") % 40 == 0, F.lit(None)).otherwise(_first_number("props")).alias("book_id"),
        F.when(mod == 0, "es").when(mod == 1, "fr").when(mod == 2, "it").otherwise("de").alias("locale"),
        F.floor("value").cast("int").cast("string").alias("impressions"),
        F.when(F.col("event_type") == "click", "1").otherwise("0").alias("clicks"),
    )


def academic_matches(read: Reader) -> DataFrame:
    li = read("lineitem")
    return li.select(
        F.col("l_partkey").alias("book_id"), F.col("l_suppkey").alias("isbn"),
        F.col("l_returnflag").alias("degree_name"), F.col("l_linestatus").alias("uni_code"),
        F.col("l_quantity").cast("int").cast("string").alias("degree_new_enrollments"),
        F.when(F.col("l_linenumber") <= 4, "Yes").otherwise("No").alias("available_status"),
    )


def tracking(read: Reader) -> DataFrame:
    e = read("events")
    mod = F.col("user_id") % 3
    return e.select(F.col("event_type").alias("event_name"),
                    F.when(mod == 0, "prod").when(mod == 1, "stage").otherwise("dev")
                    .alias("environment_name"),
                    F.col("ts").alias("record_date"))


def book_matches(read: Reader) -> DataFrame:
    p = read("part")
    return p.select(F.col("p_partkey").alias("book_id"), (F.col("p_partkey") % 97).alias("list_isbn"),
                    F.when(F.col("p_size") <= 25, "Yes").otherwise("No").alias("available_status"))


def cleanup(read: Reader) -> DataFrame:
    return read("supplier").select((F.col("s_suppkey") % 10).alias("list_isbn")).distinct()


def registrations(read: Reader) -> DataFrame:
    u = users(read)
    r = country_regions(read)
    none = F.lit(None).cast("string")
    return (u.join(r, "country_id")
            .select("user_id", F.col("registration_date").cast("timestamp_ntz").alias("registration_time"),
                    F.when(F.col("payment_model") == "direct", "direct").otherwise("partner")
                    .alias("payment_channel_crude"),
                    none.alias("internal_user"), none.alias("converted_trial"),
                    F.when(F.col("is_converted_subscribed"), "Y").otherwise("N").alias("converted_subscribed"),
                    F.when(F.col("is_converted_paid"), "Y").otherwise("N").alias("converted_paid"),
                    F.col("country").alias("acquisition_country"),
                    F.col("region").alias("acquisition_region"), "user_persona",
                    none.alias("academic_institution"), F.lit(None).cast("int").alias("organisation_id"),
                    none.alias("organisation_name"), none.alias("utm_source"), none.alias("utm_medium"),
                    F.col("referrer_book_id").alias("referrer_book"), none.alias("internal_persona"),
                    F.when(F.col("user_id") % 2 == 0, "web").otherwise("app").alias("platform_status"),
                    F.col("continent").alias("country_language"), none.alias("user_language")))


def disciplines(read: Reader) -> DataFrame:
    c = read("customer")
    return (c.filter(F.col("c_custkey") % 3 != 0)
            .select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("academic_discipline")))


ADAPTERS: dict[str, Callable[[Reader], DataFrame]] = {
    "reading_activity": reading_activity,
    "users": users,
    "country_regions": country_regions,
    "subscriptions": subscriptions,
    "event_facts": event_facts,
    "report_events": report_events,
    "event_users": event_users,
    "event_reading": event_reading,
    "book_meta": book_meta,
    "landing_pages": landing_pages,
    "academic_matches": academic_matches,
    "tracking": tracking,
    "book_matches": book_matches,
    "cleanup": cleanup,
    "registrations": registrations,
    "disciplines": disciplines,
}
