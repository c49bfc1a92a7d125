"""Text and calendar functions: tolerant parsing that gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wind phrases in the order in which they are tried, with the share that blows out and toward the left.
WIND = [
    ("out to cf", 1.0, 0.0),
    ("out to lf", 0.7, 0.7),
    ("out to rf", 0.7, -0.7),
    ("in from cf", -1.0, 0.0),
    ("in from lf", -0.7, -0.7),
    ("in from rf", -0.7, 0.7),
    ("l to r", 0.0, -1.0),
    ("r to l", 0.0, 1.0),
    ("calm", 0.0, 0.0),
    ("none", 0.0, 0.0),
    ("varies", 0.0, 0.0),
]


def wind_parts(text: Column) -> tuple[Column, Column, Column]:
    """(speed, out, toward left) of a text like "11 mph, R To L"; null, blank or calm gives zeros."""
    low = F.lower(F.coalesce(text, F.lit("")))
    speed = F.coalesce(F.regexp_extract(low, "([0-9]+(?:\\.[0-9]+)?) *mph", 1).try_cast("double"), F.lit(0.0))
    out = left = None
    for phrase, o, t in WIND:
        hit = F.contains(low, F.lit(phrase))
        out = F.when(hit, o) if out is None else out.when(hit, o)
        left = F.when(hit, t) if left is None else left.when(hit, t)
    return speed, speed * out.otherwise(0.0), speed * left.otherwise(0.0)


def season_date(text: Column, season: Column) -> Column:
    """A date from a text like "Thursday, Mar 30 (1)" and a season; null if it is none."""
    bare = F.trim(F.element_at(F.split(F.regexp_replace(text, " *\\([0-9]+\\) *$", ""), ","), -1))
    return F.to_date(F.try_to_timestamp(F.concat_ws(" ", bare, season.cast("string")), F.lit("MMM d yyyy")))


def game_of_day(text: Column) -> Column:
    """The number in brackets at the end, 1 without one."""
    return F.coalesce(F.regexp_extract(text, "\\(([0-9]+)\\) *$", 1).try_cast("int"), F.lit(1))


def percent(v: Column, digits: int = 1) -> Column:
    return F.when(v.isNull(), "-").otherwise(F.concat(F.format_string(f"%.{digits}f", v * 100), F.lit("%")))


def clock(ts: Column, zone: str) -> Column:
    """A UTC time on the zone's twelve-hour clock."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "h:mm a")


def context_line(*parts: Column) -> Column:
    """Parts joined with a dot between them, nulls and blanks left out."""
    return F.concat_ws(" · ", *(F.when(F.trim(p) != "", F.trim(p)) for p in parts))


def today() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def tomorrow() -> Column:
    return F.date_format(F.date_add(F.current_date(), 1), "yyyy-MM-dd")


def coded(code: Column, ids: dict[str, int], default: Column) -> Column:
    """A code's id from a table of codes, else the default."""
    known = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))
    return F.coalesce(F.try_element_at(known, code), default)
