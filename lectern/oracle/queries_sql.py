"""DuckDB text per query key: what a query must return, worked out another way.

Nothing here uses the engine's operators, shapes or windows; only the test
parameters and the adapters' SQL are shared. Where the dialects disagree
(month arithmetic, null order, division by zero) the rule is spelled out.
"""

from __future__ import annotations

from ..plans import params as P
from .adapters_sql import with_tables
from .cohorts_sql import cohort_oracles
from .engagement_sql import standalone
from .ranking_sql import ranking_oracles

#: Whole days of 24 hours between the last event and the clock.
CATALOG = with_tables(["tracking"], f"""
select event_name, environment_name, count(*) as cnt, min(record_date) as first_event_timestamp, max(record_date) as last_event_timestamp,
       (epoch(timestamp '{P.EVENT_AS_OF}') - epoch(max(record_date)))::bigint // 86400 as last_time_event_was_received
from tracking where record_date <= timestamp '{P.EVENT_CUTOFF}'
group by event_name, environment_name
order by cnt desc, event_name, environment_name
limit {P.EVENT_LIMIT}""")

ORACLE: dict[str, str] = {"event_catalog": CATALOG, **standalone(), **ranking_oracles(), **cohort_oracles()}
