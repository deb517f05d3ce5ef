"""Wall-clock times: the hour and day as written, whatever the offset behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date, optional time of day (hours down to fractions of a second), optional offset; date and time each
# have all of their separators or none.
ISO_PATTERN = (
    r"\A(?=\d{4}-\d\d-\d\d|\d{8})(\d{4})-?(\d\d)-?(\d\d)"
    r"(?:.(?=\d\d(?::\d\d(?::\d\d)?)?(?![\d:])|\d\d(?:\d\d(?:\d\d)?)?(?![\d:]))(\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,](\d{1,6})\d*)?)?)?"
    r"(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d)?)?)?)?\z"
)

# A year and week, with or without the day of the week, and the rest. With separators a lone digit after a hyphen is
# the day; without, a digit is the day unless an even number of digits follows it, which then are a separator and a time.
WEEK_PATTERN = r"(?s)\A(\d{4})(?:-W(\d\d)(?:-(\d)(?!\d))?|W(\d\d)(?:(\d)(?=(?:\d(?:\d\d)*)?(?!\d)))?)(.*)\z"


def _week_as_date(text: Column) -> Column:
    """Text that starts with an ISO week date, with a calendar date in its place; NULL if there is no such week."""

    def number(group: int, missing: str) -> Column:
        found = F.regexp_extract(text, WEEK_PATTERN, group)
        return F.when(found == "", missing).otherwise(found).cast("int")

    year, week = number(1, "1"), F.greatest(number(2, "0"), number(4, "0"))
    given = F.greatest(number(3, "-1"), number(5, "-1"))
    day = F.when(given == -1, 1).otherwise(given)
    # The week with January 4th is the first, the week with December 28th the last.
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_sub(fourth, F.weekday(fourth))
    valid = (year >= 1) & week.between(1, F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))) & day.between(1, 7)
    date = F.date_add(monday, (week - 1) * 7 + day - 1)
    return F.when(valid, F.concat(F.date_format(date, "yyyy-MM-dd"), F.regexp_extract(text, WEEK_PATTERN, 6)))


def parse_wall_clock(text: Column) -> Column:
    """ISO-8601 text, of a calendar or week date, as a zone-less timestamp; NULL if it is not a full valid date."""
    by_week = F.when(text.rlike(WEEK_PATTERN), _week_as_date(text)).otherwise(text)
    # Only texts with a W pay for the week's pattern.
    return F.when(text.contains("W"), _parse_date(by_week)).otherwise(_parse_date(text))


def _parse_date(text: Column) -> Column:
    def part(group: int) -> Column:
        found = F.regexp_extract(text, ISO_PATTERN, group)
        return F.when(found == "", "0").otherwise(found)

    micros = F.rpad(F.regexp_extract(text, ISO_PATTERN, 7), 6, "0")
    second = F.concat(part(6), F.lit("."), micros).cast("decimal(8,6)")
    parsed = F.try_make_timestamp_ntz(
        part(1).cast("int"),
        part(2).cast("int"),
        part(3).cast("int"),
        part(4).cast("int"),
        part(5).cast("int"),
        F.when(second < 60, second),
    )
    return F.when(text.rlike(ISO_PATTERN), parsed)


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def is_weekend(ts: Column) -> Column:
    """Saturday or Sunday; False without a time."""
    return F.coalesce(F.weekday(ts) >= 5, F.lit(False))
