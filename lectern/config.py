"""Business vocabulary: windows, event names, cohorts and market records.

Everything here is a parameter of some operator; operators take these as
keyword defaults so a caller can override any of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's constants for identical results)
# ---------------------------------------------------------------------------

# Event names counted as a reading session.
READING_SESSION_EVENTS = ("open book", "chapter load", "page load")

# Event names fetched for the engagement reports ('book opening' is fetched
# but never counted).
ENGAGEMENT_EVENTS = ("highlight creation", "annotation creation", "open book",
                     "chapter load", "page load", "book opening")

BOOK_OPEN_EVENT = "open book"
HIGHLIGHT_EVENT = "highlight creation"
ANNOTATION_EVENT = "annotation creation"

# Event names of the retention reading-session extract.
RETENTION_SESSION_EVENTS = (
    "open book", "annotation creation", "blur reader", "focus reader",
    "book reference copied", "bookmark creation", "chapter click from within book",
    "copy text", "eye saver mode change", "font family change", "font size change",
    "highlight creation", "highlight removal", "open chapter tab", "page or chapter load",
)

# Thresholds.
ACTIVE_WEEK_MIN_BOOKS = 1
ACTIVE_WEEK_MIN_MINUTES = 5
ACTIVE_MONTH_MIN_WEEKS = 2
POWER_WEEK_MIN_MINUTES = 72
POWER_MONTH_MIN_WEEKS = 2
THREE_PLUS_MIN_BOOKS = 3

# Window lengths (days after the anchor day, both ends inclusive).
DAYS_PER_WEEK = 7
DAYS_PER_MONTH = 28  # four weeks, not a calendar month

# Look-backs of the ranking signals, in months from the first of the month.
REVENUE_LOOKBACK_MONTHS = 12
READING_LOOKBACK_MONTHS = 6
CLICKS_LOOKBACK_MONTHS = 3

# Score scale.
SCORE_SCALE = 1000
SCORE_ROUND_DIGITS = -1
SCORE_FLOOR = 1.0

# Event catalogue size.
EVENT_CATALOG_LIMIT = 475

# Open-ended subscription sentinel.
OPEN_END_DATE = date(9999, 12, 31)

# Cohorts of the retention study: (first day of month, month, year, period).
REFERENCE_COHORTS = (
    (date(2022, 9, 1), "Sept", "2022", "Sept-2022"),
    (date(2022, 10, 1), "Oct", "2022", "Oct-2022"),
    (date(2023, 9, 1), "Sept", "2023", "Sept-2023"),
    (date(2023, 10, 1), "Oct", "2023", "Oct-2023"),
)


@dataclass(frozen=True)
class Market:
    """One market of the book ranking.

    ``language`` selects users by ``country_language``; otherwise
    ``countries`` selects them by lower-cased ``acquisition_country``.
    """

    name: str
    locale: str
    countries: tuple[str, ...] = ()
    language: str | None = None
    mandate: bool = False


# Market records of the reference.
REFERENCE_MARKETS = (
    Market("spanish", "es", language="Spanish - ES"),
    Market("spain", "es", countries=("spain",)),
    Market("mexico", "es", countries=("mexico",)),
    Market("france", "fr", countries=("france",)),
    Market("italy", "it", countries=("italy",), mandate=True),
    Market("germany", "de", countries=("germany", "austria", "switzerland")),
)


# ---------------------------------------------------------------------------
# Window sets
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Window:
    """Days ``lo`` .. ``hi`` after the anchor day, both inclusive."""

    name: str
    lo: int
    hi: int


def day_windows(n: int = 7) -> list[Window]:
    return [Window(f"d{k}", k - 1, k - 1) for k in range(1, n + 1)]


def week_windows(n: int) -> list[Window]:
    return [Window(f"w{k}", DAYS_PER_WEEK * (k - 1), DAYS_PER_WEEK * k - 1) for k in range(1, n + 1)]


def month_windows(n: int) -> list[Window]:
    return [Window(f"m{k}", DAYS_PER_MONTH * (k - 1), DAYS_PER_MONTH * k - 1) for k in range(1, n + 1)]


def cumulative_window(months: int) -> Window:
    return Window(f"m1_to_m{months}", 0, DAYS_PER_MONTH * months - 1)


@dataclass(frozen=True)
class ReportShape:
    """Which metric blocks one engagement report carries."""

    weeks: int
    months: int
    daily: bool
    active_days: bool
    cumulative: bool
    event_windows: tuple[str, ...] = field(default_factory=tuple)
    session_months: int = 0


SHAPE_V1 = ReportShape(weeks=12, months=3, daily=False, active_days=False, cumulative=False,
                       event_windows=("w1", "w2", "w3", "w4"), session_months=3)
SHAPE_V2 = ReportShape(weeks=12, months=3, daily=True, active_days=True, cumulative=False,
                       event_windows=("w1", "w2", "w3", "w4"), session_months=3)
SHAPE_V3 = ReportShape(weeks=12, months=3, daily=True, active_days=True, cumulative=True,
                       event_windows=("w1", "w2", "w3", "w4"), session_months=3)
SHAPE_KPI = ReportShape(weeks=16, months=4, daily=True, active_days=True, cumulative=True,
                        event_windows=("d1", "w1", "w2", "w3", "w4", "m1"), session_months=0)
