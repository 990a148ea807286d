"""Event dates and the periods derived from them."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, timedelta


@dataclass(frozen=True)
class Period:
    """A named range of days, both ends included."""

    name: str
    start: date
    end: date

    def contains(self, column: str) -> str:
        """The SQL condition that a date column lies in the period."""
        return f"{column} BETWEEN DATE '{self.start}' AND DATE '{self.end}'"


def add_months(day: date, months: int) -> date:
    """The same day of another month, or that month's last day if it is shorter."""
    years, month0 = divmod(day.year * 12 + day.month - 1 + months, 12)
    last = calendar.monthrange(years, month0 + 1)[1]
    return date(years, month0 + 1, min(day.day, last))


@dataclass(frozen=True)
class EventSpec:
    """An event date and the window lengths, in days, on either side of it.

    The event day itself belongs to no window.
    """

    event_date: date
    lengths: tuple[int, ...] = (28, 91)
    status_months: int = 3

    def pre(self, days: int) -> Period:
        return Period(
            f"{days}d_pre",
            self.event_date - timedelta(days=days),
            self.event_date - timedelta(days=1),
        )

    def post(self, days: int) -> Period:
        return Period(
            f"{days}d_post",
            self.event_date + timedelta(days=1),
            self.event_date + timedelta(days=days),
        )

    @property
    def pre_periods(self) -> list[Period]:
        return [self.pre(n) for n in self.lengths]

    @property
    def periods(self) -> list[Period]:
        return [p for n in self.lengths for p in (self.pre(n), self.post(n))]

    @property
    def before(self) -> Period:
        """The longest period before the event."""
        return self.pre(max(self.lengths))

    @property
    def span(self) -> Period:
        """Everything from the first pre day to the last post day."""
        longest = max(self.lengths)
        return Period("span", self.pre(longest).start, self.post(longest).end)

    @property
    def status_dates(self) -> dict[str, date]:
        """Dates at which membership is looked up, by name."""
        n = self.status_months
        return {
            f"{n}m_before": add_months(self.event_date, -n),
            "event_day": self.event_date,
            f"{n}m_after": add_months(self.event_date, n),
        }
