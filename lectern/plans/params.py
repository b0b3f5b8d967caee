"""Parameters of the registered queries on the driver's test data.

The test tables cover 1995-2001 (orders) and January 2024 (events), so the
dates and markets of the reference are replaced by equivalents that select
data (FIXTURES.md, "Fixed parameters for the driver data").
"""

from __future__ import annotations

from datetime import date

from ..config import Market

AS_OF = date(1996, 3, 15)                # cohort, tenure and ranking clock
SINCE = date(1995, 1, 1)                 # registration / activity lower bound
EVENT_AS_OF = date(2024, 1, 31)          # E1 clock
EVENT_CUTOFF = date(2024, 1, 25)         # E1 cut-off
EVENT_LIMIT = 10                         # E1 top-k on 15 pairs
AGAIN_FROM = date(1995, 7, 1)            # months of G23 that are published a second time
COUNTRIES = ("nation_1", "nation_2")     # G1 country filter

COHORTS = (
    (date(1995, 1, 1), "Jan", "1995", "Jan-1995"),
    (date(1995, 2, 1), "Feb", "1995", "Feb-1995"),
    (date(1996, 1, 1), "Jan", "1996", "Jan-1996"),
    (date(1996, 2, 1), "Feb", "1996", "Feb-1996"),
)
READING_RANGE = (date(1995, 9, 1), date(1995, 11, 30))   # C6, D1-D3 period
EVENT_RANGE = (date(2024, 1, 1), date(2024, 2, 29))      # C7, D4, D5 period

MARKETS = (
    Market("spanish", "es", language="EUROPE"),
    Market("spain", "es", countries=("nation_1",)),
    Market("mexico", "es", countries=("nation_2",)),
    Market("france", "fr", countries=("nation_3",)),
    Market("italy", "it", countries=("nation_4",), mandate=True),
    Market("germany", "de", countries=("nation_5", "nation_6", "nation_7")),
)
MARKET_BY_NAME = {m.name: m for m in MARKETS}
