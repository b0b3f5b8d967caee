"""Adapter SQL for the DuckDB oracle (same rules as ``sources.adapters``)."""

from __future__ import annotations

ADAPTER_SQL: dict[str, str] = {
    "reading_activity": """
select o.o_custkey as user_id, l.l_partkey as book_id, cast(l.l_shipdate as date) as read_date,
       l.l_quantity * 4 as reading_minutes
from lineitem l join orders o on l.l_orderkey = o.o_orderkey""",
    "users": """
select c.c_custkey as user_id, o.registration_date,
       case when c.c_mktsegment in ('BUILDING','MACHINERY','FURNITURE') then 'direct' else 'partner' end as payment_model,
       c.c_acctbal > 0 as is_converted_subscribed, c.c_acctbal > 2000 as is_converted_paid,
       c.c_mktsegment as user_persona,
       case when c.c_custkey % 10 = 0 then null else c.c_custkey % 200 end as referrer_book_id,
       c.c_nationkey as country_id
from customer c
join (select o_custkey, cast(min(o_orderdate) as date) as registration_date from orders group by o_custkey) o
  on c.c_custkey = o.o_custkey""",
    "country_regions": """
select n.n_nationkey as country_id, n.n_name as country, r.r_name as continent, r.r_name as market,
       concat(r.r_name, '-', cast(n.n_nationkey % 2 as varchar)) as region
from nation n join region r on n.n_regionkey = r.r_regionkey""",
    "subscriptions": """
select o_custkey as user_id,
       case when o_orderstatus = 'P' then 'trial' else 'subscribed' end as subscription_type,
       case when o_orderkey % 50 = 0 then null else o_orderdate end as subscription_start_time,
       case when o_orderstatus = 'O' then cast('9999-12-31' as date)
            else cast(o_orderdate as date) + cast(30 * (o_orderkey % 12) as int) end as subscription_end_time,
       case when o_orderkey % 9 = 0 then null
            else cast(o_orderdate as date) + cast(30 * (o_orderkey % 12) as int) end as end_timestamp,
       cast(o_orderdate as date) + 45 as paid_end_timestamp,
       case when o_orderkey % 5 = 0 then null else o_totalprice end as total_paid_gbp,
       case when o_orderkey % 7 = 0 then null else cast(o_orderkey % 12 as int) end as subscribed_months
from orders""",
    "event_facts": """
select user_id, event_id,
       case event_type when 'view' then 'open book' when 'click' then 'page load'
            when 'signup' then 'chapter load' when 'purchase' then 'highlight creation'
            else 'annotation creation' end as event_name,
       date '2024-01-01' + cast(4 * (day(ts) - 1) as int) as event_date,
       concat(cast(user_id as varchar), '-', cast(day(ts) as varchar)) as session_id,
       case when event_id % 20 = 0 then null else cast(regexp_extract(props, '[0-9]+', 0) as int) end as book_id,
       value
from events""",
    "report_events": """
select f.o_custkey as user_id, e.event_id, e.event_name, f.first_day + cast(4 * (day(x.ts) - 1) as int) as event_date,
       concat(cast(f.o_custkey as varchar), '-', cast(4 * (day(x.ts) - 1) as varchar)) as session_id, e.book_id, e.value
from event_facts e
join events x on x.event_id = e.event_id
join (select o_orderkey, o_custkey, cast(min(o_orderdate) over (partition by o_custkey) as date) as first_day from orders) f on f.o_orderkey = e.event_id""",
    "event_users": """
select user_id, date '2024-01-01' + cast(user_id % 3 as int) as reg_sub_start_time
from (select distinct user_id from events) u""",
    "event_reading": """
select user_id, cast(regexp_extract(props, '[0-9]+', 0) as int) as book_id,
       date '2024-01-01' + cast(4 * (day(ts) - 1) as int) as read_date, value as reading_minutes
from events""",
    "book_meta": """
select p_partkey as id, cast(null as varchar) as isbn13_idvalue,
       case when p_partkey % 5 = 0 then '' else cast(9780000 + p_partkey as varchar) end as hardback_isbn,
       cast(9790000 + p_partkey as varchar) as softback_isbn,
       p_name as title_text, p_brand as publisher_name, p_type as publisher_imprint,
       case p_size % 10 when 0 then '' when 1 then 'NONE' when 2 then null when 3 then 'na'
            else concat('20', lpad(cast(p_size % 25 as varchar), 2, '0'), '-',
                        lpad(cast(1 + p_partkey % 12 as varchar), 2, '0'), '-',
                        lpad(cast(1 + p_partkey % 28 as varchar), 2, '0')) end as publication_date,
       date '2020-01-01' + cast(p_partkey % 365 as int) as date_activated,
       date '2019-01-01' + cast(p_partkey % 200 as int) as date_added,
       case when p_partkey % 3 = 0 then '' else p_type end as subject_name,
       case when p_partkey % 2 = 0 then '' else p_brand end as topic_name1,
       case when p_partkey % 4 = 0 then '' else p_type end as topic_name2,
       cast(null as varchar) as topic_name3, cast(null as varchar) as topic_name4,
       case when p_partkey % 6 = 0 then '' else p_name end as contributor1_name,
       case when p_partkey % 7 = 0 then null else p_brand end as contributor2_name,
       cast(null as varchar) as contributor3_name,
       case p_size % 3 when 0 then 'English' when 1 then 'Spanish' else 'German' end as language_name,
       case when p_partkey % 20 = 0 then 0 else 1 end as is_available
from part""",
    "landing_pages": """
select date '2024-01-01' + cast(10 * (day(ts) - 1) as int) as dates,
       case when event_id % 40 = 0 then null else regexp_extract(props, '[0-9]+', 0) end as book_id,
       case user_id % 4 when 0 then 'es' when 1 then 'fr' when 2 then 'it' else 'de' end as locale,
       cast(cast(floor(value) as int) as varchar) as impressions,
       case when event_type = 'click' then '1' else '0' end as clicks
from events""",
    "academic_matches": """
select l_partkey as book_id, l_suppkey as isbn, l_returnflag as degree_name, l_linestatus as uni_code,
       cast(cast(l_quantity as int) as varchar) as degree_new_enrollments,
       case when l_linenumber <= 4 then 'Yes' else 'No' end as available_status
from lineitem""",
    "tracking": """
select event_type as event_name,
       case user_id % 3 when 0 then 'prod' when 1 then 'stage' else 'dev' end as environment_name,
       ts as record_date
from events""",
    "book_matches": """
select p_partkey as book_id, p_partkey % 97 as list_isbn,
       case when p_size <= 25 then 'Yes' else 'No' end as available_status
from part""",
    "cleanup": """
select distinct s_suppkey % 10 as list_isbn from supplier""",
    "registrations": """
select u.user_id, cast(u.registration_date as timestamp) as registration_time,
       case when u.payment_model = 'direct' then 'direct' else 'partner' end as payment_channel_crude,
       cast(null as varchar) as internal_user, cast(null as varchar) as converted_trial,
       case when u.is_converted_subscribed then 'Y' else 'N' end as converted_subscribed,
       case when u.is_converted_paid then 'Y' else 'N' end as converted_paid,
       r.country as acquisition_country, r.region as acquisition_region, u.user_persona,
       cast(null as varchar) as academic_institution, cast(null as int) as organisation_id,
       cast(null as varchar) as organisation_name, cast(null as varchar) as utm_source,
       cast(null as varchar) as utm_medium, u.referrer_book_id as referrer_book,
       cast(null as varchar) as internal_persona,
       case when u.user_id % 2 = 0 then 'web' else 'app' end as platform_status,
       r.continent as country_language, cast(null as varchar) as user_language
from users u join country_regions r on u.country_id = r.country_id""",
    "disciplines": """
select c_custkey as user_id, c_mktsegment as academic_discipline from customer where c_custkey % 3 <> 0""",
}

ADAPTER_DEPS: dict[str, tuple[str, ...]] = {"registrations": ("users", "country_regions"), "report_events": ("event_facts",)}


def with_tables(tables: list[str] | tuple[str, ...], body: str, extra: list[tuple[str, str]] = ()) -> str:
    """``WITH`` the adapter CTEs ``tables`` (and their dependencies), then
    the ``extra`` (name, sql) CTEs in order, then ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in ADAPTER_DEPS.get(name, ()):
            add(dep)
        if name not in order:
            order.append(name)

    for t in tables:
        add(t)
    ctes = [f"{n} as ({ADAPTER_SQL[n]}\n)" for n in order]
    ctes += [f"{n} as ({sql}\n)" for n, sql in extra]
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body
