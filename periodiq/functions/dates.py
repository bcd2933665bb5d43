"""Date and time functions; the present is always a parameter (FD-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def notice_time(c: Column) -> Column:
    """Month/day/year hour:minute as a timestamp; empty, `0` and impossible ones null (FD-01)."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"), F.try_to_timestamp(t, F.lit("M/d/yyyy H:mm")))


def recent_by_year(at: Column, as_of: Column, years: int) -> Column:
    """Whether the calendar years differ by at most so many; later dates count as recent (FD-02)."""
    return F.year(as_of) - F.year(at) <= years


def expiry(as_of: Column, hours: int) -> Column:
    """Time to live from now (FD-03)."""
    return as_of + F.make_interval(hours=F.lit(hours))


def is_stale(last: Column, as_of: Column, days: int) -> Column:
    """Whether more whole days than given have passed, or it never happened (FD-04)."""
    return F.coalesce(F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(last)) / 86400) > days, F.lit(True))


def plausible_year(c: Column, first: int = 1900, last: int = 2100) -> Column:
    """Integer year within bounds, else null (FD-05)."""
    y = F.trim(c).try_cast("int")
    return F.when(y.between(first, last), y)


def date_parts_iso(parts: Column) -> Column:
    """ISO date of an array [year, month, day]; null if a part is missing (FD-06)."""
    return F.when(F.size(parts) >= 3, F.format_string("%d-%02d-%02d", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))))


def years_active(first: Column, last: Column) -> Column:
    """At least 1; 1 where no first year is known (FD-07)."""
    return F.coalesce(F.greatest(F.lit(1), last - first + 1), F.lit(1))
