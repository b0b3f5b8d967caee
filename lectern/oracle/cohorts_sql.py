"""Expected results of the cohort, extract, sink and dashboard keys, in DuckDB.

Cohorts are a table of months; days of a period are half-open ranges; a book
category is looked up by the number of books; values given here are literals.
"""

from __future__ import annotations

from ..plans import params as P
from ..sources.schemas import LOGICAL_SCHEMAS
from .adapters_sql import ADAPTER_SQL, with_tables

MONTH_ROWS = "select * from (values " + ", ".join(
    f"(timestamp '{first}', '{month}', '{year}', '{period}')" for first, month, year, period in P.COHORTS) + ") m(registration_month, cohort_month, cohort_year, cohort_period)"
JOINED = """
select m.cohort_month, m.cohort_year, m.cohort_period, m.registration_month, r.*
from registrations r join months m on r.registration_time >= m.registration_month and r.registration_time < m.registration_month + to_months(1)
where r.converted_subscribed = 'Y'"""
SUBSCRIBED = """
select user_id, min(subscription_start_time) as sub_start_timestamp, max(ifnull(end_timestamp, paid_end_timestamp)) as sub_end_timestamp,
       ifnull(sum(subscribed_months), 0)::bigint as subscribed_months
from subscriptions where subscription_type = 'subscribed' group by user_id"""
COHORT = """
select l.*, ifnull(d.academic_discipline, 'Unknown') as academic_discipline, s.* exclude (user_id)
from labelled l left join disciplines d using (user_id) left join subscribed s using (user_id)"""
COHORT_SOURCES = ["registrations", "disciplines", "subscriptions"]
COHORT_STEPS = [("months", MONTH_ROWS), ("labelled", JOINED), ("subscribed", SUBSCRIBED), ("cohort", COHORT)]


def during(column: str, period: tuple) -> str:
    return f"{column} >= date '{period[0]}' and {column} < date '{period[1]}' + 1"


READS = f"from reading_activity where {during('read_date', P.READING_RANGE)}"
#: Event names of a reading session in the retention study.
SESSION_EVENTS = """('open book', 'annotation creation', 'blur reader', 'focus reader', 'book reference copied', 'bookmark creation',
  'chapter click from within book', 'copy text', 'eye saver mode change', 'font family change', 'font size change',
  'highlight creation', 'highlight removal', 'open chapter tab', 'page or chapter load')"""
EVENTS = f"from event_facts where event_name in {SESSION_EVENTS} and {during('event_date', P.EVENT_RANGE)}"

READ_STEPS = [("reads", READS), ("reader_days", "select distinct user_id, read_date from reads where user_id + 0 is not null and read_date is not null"),
              ("readers", "select user_id, count(*) as active_reading_days from reader_days group by user_id"),
              ("middle", "select quantile_cont(active_reading_days, 0.5)::double as m from readers")]
EVENT_STEPS = [("events_read", EVENTS), ("visitors", """
select user_id, count(distinct session_id) as active_reading_sessions, ['0', '1', '2', '3+'][1 + least(count(distinct book_id), 3)] as book_category
from events_read where user_id is not null group by user_id""")]


def week(day: str) -> str:
    """Week of the subscription, from 1, that a day falls in."""
    return f"(floor(({day} - c.sub_start_timestamp::date) / 7.0) + 1)::bigint"


#: A DuckDB type as Spark names it.
SPARK_TYPE = "map {{'BIGINT': 'bigint', 'INTEGER': 'int', 'DOUBLE': 'double', 'VARCHAR': 'string', 'DATE': 'date', 'BOOLEAN': 'boolean', 'TIMESTAMP': 'timestamp_ntz'}}[{}]"
#: The logical tables' columns.
COLUMNS = {name: [f.name for f in schema.fields] for name, schema in LOGICAL_SCHEMAS.items()}
#: C3 as the declared table has it.
DECLARED = """
select * replace (registration_month::timestamp as registration_month, registration_time::timestamp as registration_time,
                  user_id::int as user_id, organisation_id::int as organisation_id, referrer_book::int as referrer_book,
                  sub_start_timestamp::timestamp as sub_start_timestamp, sub_end_timestamp::timestamp as sub_end_timestamp) from cohort"""


def cohort_oracles() -> dict[str, str]:
    cohort = lambda select, more=(), sources=(): with_tables([*sources, *COHORT_SOURCES], select, [*COHORT_STEPS, *more])
    return {
        "source_scan": with_tables(["book_meta"], "from book_meta"),
        "cohort_label": with_tables(["registrations"], "from labelled", COHORT_STEPS[:2]),
        "subscription_rollup": with_tables(["subscriptions"], "from subscribed", [("subscribed", SUBSCRIBED)]),
        "cohort_enrich": cohort("from cohort"),
        "ctas_sink": cohort("from cohort"),
        "cohort_enrich_bucketed": cohort("from cohort"),
        "source_profile": with_tables(list(ADAPTER_SQL), " union all ".join(
            f"""select '{name}' as table_name, '{c}' as column_name, {SPARK_TYPE.format(f'typeof(any_value({c}))')} as column_type, count(*) as row_count, count({c}) as value_count from {name}"""
            for name, columns in COLUMNS.items() for c in columns)),
        "schema_append_sink": cohort(DECLARED),
        "cohort_append_repeated": cohort(DECLARED),
        "cohort_filter": cohort("""
from cohort where cohort_month = 'Jan' and user_persona in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')
  and academic_discipline in ('BUILDING', 'MACHINERY', 'Unknown')"""),
        "reading_list_extract": with_tables(["book_matches", "cleanup"], """
select b.book_id from book_matches b
where b.available_status = 'Yes' or exists (from cleanup c where c.list_isbn = b.list_isbn)"""),
        "reading_window_extract": with_tables(["reading_activity"], READS),
        "session_event_extract": with_tables(["event_facts"], EVENTS),
        "ard_distribution": with_tables(["reading_activity"], """
select active_reading_days, count(*) as users, any_value(m) as median_ard from readers, middle group by active_reading_days""", READ_STEPS),
        "ard_daily_segment": with_tables(["reading_activity"], """
select read_date, if(active_reading_days > m, 'above', 'below') as segment, count(*) as active_readers
from reader_days join readers using (user_id), middle group by all""", READ_STEPS),
        "readers_by_sub_week": cohort(f"""
select c.cohort_period, {week('d.read_date')} as sub_week, count(distinct d.user_id) as active_readers
from reader_days d join cohort c using (user_id) where d.read_date >= c.sub_start_timestamp::date group by all""", READ_STEPS[:2], ["reading_activity"]),
        "readers_by_sub_week_of_all": cohort(f"""
select {week('d.read_date')} as sub_week, count(distinct d.user_id) as active_readers
from reader_days d join cohort c using (user_id) where d.read_date >= c.sub_start_timestamp::date group by all""", READ_STEPS[:2], ["reading_activity"]),
        "ars_distribution": with_tables(["event_facts"], """
select distinct book_category, active_reading_sessions, count(*) over (partition by book_category, active_reading_sessions) as users,
       quantile_cont(active_reading_sessions, 0.5) over (partition by book_category)::double as median_ars
from visitors""", EVENT_STEPS),
        "sessions_by_sub_week": cohort(f"""
select c.cohort_period, {week('e.event_date')} as sub_week, v.book_category, count(distinct e.session_id) as reading_sessions,
       count(distinct e.user_id) as users, round(reading_sessions / users, 6) as sessions_per_user
from events_read e join cohort c using (user_id) join visitors v using (user_id)
where e.event_date >= c.sub_start_timestamp::date group by all""", EVENT_STEPS, ["event_facts"]),
    }
