"""Expected results of the engagement keys (G1-G24), in DuckDB.

Activity is kept long: one row per person and span of days, from a table of
spans and the day each fact falls on; the columns are picked out of it last.
Spans, thresholds and months are spelled out here, apart from the engine.
"""

from __future__ import annotations

from ..plans import params as P
from .adapters_sql import with_tables

#: Span of days after the anchor day, both ends included, by name.
SPANS = {
    **{f"d{k}": (k - 1, k - 1) for k in range(1, 113)},
    **{f"w{k}": (7 * k - 7, 7 * k - 1) for k in range(1, 17)},
    **{f"m{k}": (28 * k - 28, 28 * k - 1) for k in range(1, 5)},
    "m1_to_m3": (0, 83), "m1_to_m4": (0, 111),
}
SPAN_ROWS = "select * from (values " + ", ".join(f"('{n}', {a}, {b})" for n, (a, b) in SPANS.items()) + ") s(span, first_day, last_day)"

#: Which events feed a metric.
METRIC_ROWS = """select * from (values ('book_opened', 'open book'), ('reading_session', 'open book'),
  ('reading_session', 'chapter load'), ('reading_session', 'page load'),
  ('highlight', 'highlight creation'), ('annotation', 'annotation creation')) m(metric, event_name)"""
METRICS = ("book_opened", "reading_session", "highlight", "annotation")
#: Event names of the engagement reports.
REPORT_EVENTS = "('highlight creation', 'annotation creation', 'open book', 'chapter load', 'page load', 'book opening')"


def whole_months(end: str, start: str) -> str:
    """Months from start to end, cut towards zero; whole where both fall on the
    same day of the month or both on its last day, whatever the time."""
    e, s = f"({end})::timestamp", f"({start})::timestamp"
    months = f"((12 * year({e}) + month({e})) - (12 * year({s}) + month({s})))"
    in_month = lambda x: f"(86400 * day({x}) + epoch({x}) % 86400)"
    return (f"(case when day({e}) = day({s}) or (last_day({e}) = ({e})::date and last_day({s}) = ({s})::date) then {months} "
            f"else {months} - ({months} > 0 and {in_month(e)} < {in_month(s)})::int + ({months} < 0 and {in_month(e)} > {in_month(s)})::int end)::int")


# -- people -------------------------------------------------------------------------

COUNTRY_LIST = ", ".join(f"'{c.lower()}'" for c in P.COUNTRIES)
READERS = f"""
select date_trunc('month', u.registration_date)::date as registration_month,
       if(coalesce(u.payment_model, '') = 'direct', 'd2c', 'b2b') as user_type, u.user_id, u.registration_date,
       u.user_persona, u.referrer_book_id, g.country, g.continent, g.market, g.region
from users u, country_regions g
where g.country_id = u.country_id and lower(g.country) in ({COUNTRY_LIST})
  and u.is_converted_subscribed and u.registration_date >= date '{P.SINCE}'"""
PAYERS = f"""
select date_trunc('month', registration_date)::date as registration_month, registration_date, user_id
from users where is_converted_paid and registration_date >= date '{P.SINCE}'"""


def tenures(months: str) -> str:
    until = f"if(s.subscription_end_time::date = date '9999-12-31', timestamp '{P.AS_OF}', s.subscription_end_time::timestamp)"
    return f"""
select s.user_id, min(s.subscription_start_time) as subscription_start_time, max(s.subscription_end_time) as subscription_end_time,
       sum(if(s.subscription_start_time is null, 0, {whole_months(until, 's.subscription_start_time')}))::bigint as {months}
from subscriptions s
where s.subscription_type = 'subscribed' and exists (from members b where b.user_id = s.user_id)
group by s.user_id"""


def anchored(months: str) -> str:
    return f"""
select b.*, t.subscription_start_time, t.subscription_end_time, t.{months},
       ifnull(t.subscription_start_time, b.registration_date::timestamp) as reg_sub_start_time,
       if(t.subscription_start_time is null, 'reg', 'sub') as start_time_status
from members b left join tenure t using (user_id)"""


# -- activity, long and then wide -----------------------------------------------------

def activity(reads: str, since: str | None = None) -> list[tuple[str, str]]:
    """CTEs over ``people``: what each person read in each span."""
    recent = f"and r.read_date >= date '{since}'" if since else ""
    return [("spans", SPAN_ROWS), ("read_long", f"""
select p.user_id, s.span, count(distinct r.book_id) as books, sum(r.reading_minutes::decimal(28, 10))::double as minutes,
       count(distinct r.read_date) as days, count(distinct r.read_date - isodow(r.read_date)::int) as weeks
from people p, {reads} r, spans s
where r.user_id = p.user_id {recent} and r.read_date - p.reg_sub_start_time::date between s.first_day and s.last_day
group by p.user_id, s.span""")]


def happenings(events: str, since: str | None = None) -> list[tuple[str, str]]:
    """CTEs over ``people``: distinct things each person did in each span."""
    recent = f"and e.event_date >= date '{since}' and e.event_name in {REPORT_EVENTS}" if since else ""
    return [("spans", SPAN_ROWS), ("metrics", METRIC_ROWS), ("event_long", f"""
select p.user_id, s.span, m.metric,
       count(distinct case m.metric when 'book_opened' then e.book_id::varchar when 'reading_session' then e.session_id
                                    else e.event_id::varchar end) as things
from people p, {events} e, metrics m, spans s
where e.user_id = p.user_id {recent} and m.event_name = e.event_name
  and e.event_date - p.reg_sub_start_time::date between s.first_day and s.last_day
group by p.user_id, s.span, m.metric""")]


def _pick(what: str, span: str, name: str, missing: str | None = "0") -> str:
    value = f"max({what}) filter (span = '{span}')"
    return f"{f'coalesce({value}, {missing})' if missing else value} as {name}"


books = lambda s: _pick("books", s, f"book_read_{s}")
minutes = lambda s: _pick("minutes", s, f"reading_mins_{s}", None)
read_days = lambda s: _pick("days", s, f"reading_days_{s}")
read_weeks = lambda s: _pick("weeks", s, f"reading_weeks_{s}")


def things(metric: str, span: str) -> str:
    return f"coalesce(max(things) filter (metric = '{metric}' and span = '{span}'), 0) as {metric}_{span}"


def weeks_with(condition: str, weeks: list[int]) -> str:
    """In how many of the listed weeks (a repeated one counts twice) the condition holds."""
    return " + ".join(f"coalesce(bool_or({condition}) filter (span = 'w{k}'), false)::int" for k in weeks)


ACTIVE = "books >= 1 and minutes >= 5"
#: Month 1 of the power months looks at week 3 twice and never at week 4, as the reference does.
POWER_WEEKS = {1: [1, 2, 3, 3], **{j: list(range(4 * j - 3, 4 * j + 1)) for j in (2, 3, 4)}}


def active_weeks(n: int) -> list[str]:
    return [f"coalesce(bool_or({ACTIVE}) filter (span = 'w{k}'), false){cast} as active_{name}w{k}"
            for k in range(1, n + 1) for cast, name in (("::int", ""), ("", "flag_"))]


def active_months(n: int) -> list[str]:
    counts = {j: weeks_with(ACTIVE, list(range(4 * j - 3, 4 * j + 1))) for j in range(1, n + 1)}
    return [f"({c}) as active_wk_m{j}" for j, c in counts.items()] + [f"({c}) >= 2 as active_wk_flag_m{j}" for j, c in counts.items()]


def power_months() -> list[str]:
    hit = {j: f"(({weeks_with('minutes >= 72', w)}) >= 2)::int" for j, w in POWER_WEEKS.items()}
    return [f"{h} as power_active_m{j}" for j, h in hit.items()] + [" + ".join(hit.values()) + " as power_active_m1_to_m4"]


THREE_PLUS = "coalesce(max(books) filter (span = 'm1_to_m4'), 0) >= 3 as flag_3plus_m1_m4"
#: The both-flag of w4 looks at annotations of w3, that of m1 at those of w1, as the reference does.
UGC_PARTNER = {"d1": "d1", "w1": "w1", "w2": "w2", "w3": "w3", "w4": "w3", "m1": "w1"}


def ugc_flags() -> list[str]:
    did = lambda m, s: f"coalesce(bool_or(things > 0) filter (metric = '{m}' and span = '{s}'), false)"
    return [x for s, other in UGC_PARTNER.items() for x in (
        f"{did('highlight', s)} as highlight_{s}_flag", f"{did('annotation', s)} as annotation_{s}_flag",
        f"{did('highlight', s)} and {did('annotation', other)} as ugc_{s}_flag")]


def read_columns(weeks: int, months: int, daily: bool, total: str | None) -> list[str]:
    spans = [f"d{k}" for k in range(1, 8)] * daily + [f"w{k}" for k in range(1, weeks + 1)] + [f"m{k}" for k in range(1, months + 1)]
    out = [f(s) for s in spans for f in (books, minutes)]
    if daily:
        out += [read_days(s) for s in ("w1", "w2", "w3", "w4", "m1")] + [read_weeks("m1")]
    return out + ([books(total)] if total else [])


def wide(columns: list[str], long: str) -> str:
    return f"select p.user_id, {', '.join(columns)} from people p left join {long} using (user_id) group by p.user_id"


#: Report: (weeks, months, days too, span of all months, event spans, session months).
REPORTS = {"engagement_report_v1": (12, 3, False, None), "engagement_report_v2": (12, 3, True, None),
           "engagement_report_v3": (12, 3, True, "m1_to_m3")}


def engagement_report(key: str) -> str:
    weeks, months, daily, total = REPORTS[key]
    done = [things(m, s) for s in ("w1", "w2", "w3", "w4") for m in METRICS] + [things("reading_session", f"m{k}") for k in (1, 2, 3)]
    each = ", ".join(f"round(r.reading_mins_m{k} / nullif(e.reading_session_m{k}, 0), 6) as reading_mins_per_session_m{k}" for k in (1, 2, 3))
    return with_tables(
        ["users", "country_regions", "subscriptions", "reading_activity", "report_events"],
        f"select p.*, r.* exclude (user_id), e.user_id as user_id_ref, e.* exclude (user_id), {each} from people p join r using (user_id) join e on e.user_id = p.user_id",
        [("members", READERS), ("tenure", tenures("tenure_months_todate")), ("people", anchored("tenure_months_todate")),
         *activity("reading_activity", P.SINCE), *happenings("report_events", P.SINCE)[1:],
         ("r", wide(read_columns(weeks, months, daily, total) + active_weeks(weeks) + active_months(months), "read_long")),
         ("e", wide(done, "event_long"))])


EXPECTED = f"{whole_months(f'timestamp {chr(39)}{P.AS_OF}{chr(39)}', 'a.reg_sub_start_time')} as tenure_months_expected"
KPI_PEOPLE = [("members", PAYERS), ("tenure", tenures("tenure_months")), ("a", anchored("tenure_months")), ("people", f"select a.*, {EXPECTED} from a")]


def learning_kpi() -> str:
    done = [things(m, s) for s in UGC_PARTNER for m in METRICS]
    return with_tables(
        ["users", "subscriptions", "reading_activity", "report_events"],
        "select p.* replace (coalesce(p.tenure_months, 0) as tenure_months), r.* exclude (user_id), e.user_id as user_id_ref, e.* exclude (user_id) from people p join r using (user_id) join e on e.user_id = p.user_id",
        [*KPI_PEOPLE, *activity("reading_activity", P.SINCE), *happenings("report_events", P.SINCE)[1:],
         ("r", wide(read_columns(16, 4, True, "m1_to_m4") + [THREE_PLUS] + power_months(), "read_long")),
         ("e", wide(done + ugc_flags(), "event_long"))])


def _dense(columns: list[str], events: bool = False) -> str:
    facts = "event_facts" if events else "event_reading"
    return with_tables(["event_users", facts], wide(columns, "event_long" if events else "read_long"),
                       [("people", "from event_users"), *(happenings("event_facts") if events else activity("event_reading"))])


def standalone() -> dict[str, str]:
    w16, m4, m3 = [f"w{k}" for k in range(1, 17)], ["m1", "m2", "m3", "m4"], ["m1", "m2", "m3"]
    both = lambda spans: [f(s) for s in spans for f in (books, minutes)]
    people = ["users", "country_regions", "subscriptions"]
    o = {
        "engagement_base": with_tables(people[:2], READERS),
        "kpi_base": with_tables(["users"], PAYERS),
        "subscription_tenure": with_tables(people, tenures("tenure_months_todate"), [("members", READERS)]),
        "anchor_start": with_tables(people, anchored("tenure_months_todate"), [("members", READERS), ("tenure", tenures("tenure_months_todate"))]),
        "tenure_expected": with_tables(["users", "subscriptions"], "from people", KPI_PEOPLE),
        "reading_for_cohort": with_tables([*people[:2], "reading_activity"], f"""
from reading_activity r where r.read_date >= date '{P.SINCE}' and exists (from members b where b.user_id = r.user_id)""", [("members", READERS)]),
        "events_for_cohort": with_tables([*people[:2], "event_facts"], f"""
from event_facts e where e.event_date >= date '{P.SINCE}' and e.event_name in {REPORT_EVENTS}
  and exists (from members b where b.user_id = e.user_id)""", [("members", READERS)]),
        "reading_days_d1_d7": _dense(both([f"d{k}" for k in range(1, 8)])),
        "reading_weeks": _dense(both(w16)),
        "reading_weeks_by_increments": _dense(both(w16)),
        "reading_days_16_weeks": _dense([books(f"d{k}") for k in range(1, 113)] + [read_days(s) for s in (*m4, "m1_to_m4")]),
        "reading_months": _dense(both(m4)),
        "active_reading_days": _dense([read_days(s) for s in ("w1", "w2", "w3", "w4", "m1")] + [read_weeks("m1")]),
        "cumulative_books": _dense([books("m1_to_m4")]),
        "active_week_flags": _dense(active_weeks(12)),
        "active_month_flags": _dense(active_months(3)),
        "power_months": _dense(power_months()),
        "three_plus_readers": _dense([THREE_PLUS]),
        "event_windows": _dense([things(m, s) for s in UGC_PARTNER for m in METRICS], events=True),
        "session_months": _dense([things("reading_session", s) for s in m3], events=True),
        "ugc_flags": _dense(ugc_flags(), events=True),
        "minutes_per_session": with_tables(["event_users", "event_reading", "event_facts"], "select user_id, " + ", ".join(
            f"round(max(minutes) filter (r.span = '{s}') / nullif(max(things) filter (e.span = '{s}'), 0), 6) as reading_mins_per_session_{s}" for s in m3)
            + " from people left join read_long r using (user_id) left join (from event_long where metric = 'reading_session') e using (user_id) group by user_id",
            [("people", "from event_users"), *activity("event_reading"), *happenings("event_facts")[1:]]),
        "learning_kpi_report": learning_kpi(),
    }
    return o | {key: engagement_report(key) for key in REPORTS} | {"engagement_report_published": engagement_report("engagement_report_v3")}
