"""Calendar expressions. Instants are UTC; local days are those of a named zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "America/Mexico_City"


def local_time(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """The wall-clock time in a zone of a zone-less UTC time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def local_day(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(local_time(ts, zone))


def day_of_text(text: Column, zone: str = LOCAL_ZONE) -> Column:
    """A bare day passes through; a full instant becomes its local day; anything else is null."""
    bare = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(bare, text.try_cast("date")).otherwise(local_day(F.try_to_timestamp(text).cast("timestamp_ntz"), zone))


def iso_week(day: Column) -> Column:
    """ISO year and week as yyyy-Www."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("yearofweek"), day).cast("int"), F.weekofyear(day))


def week_start(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def month_precision(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def billing_cycle_start(day: Column, first_day: int = 4) -> Column:
    """The last first_day-of-month at or before the day."""
    this = F.date_add(F.trunc(day, "month"), first_day - 1)
    return F.when(F.dayofmonth(day) >= first_day, this).otherwise(F.date_add(F.trunc(F.add_months(day, -1), "month"), first_day - 1))


def swapped_day_month(day: Column) -> Column:
    """The date with day and month exchanged, null where that is no date."""
    return F.try_to_timestamp(F.date_format(day, "yyyy-dd-MM"), F.lit("yyyy-MM-dd")).cast("date")


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by the anonymous algorithm."""
    y = year.cast("int")
    a, b, c = y % 19, F.floor(y / 100), y % 100
    d, e = F.floor(b / 4), b % 4
    f = F.floor((b + 8) / 25)
    g = F.floor((b - f + 1) / 3)
    h = (19 * a + b - d - g + 15) % 30
    i, k = F.floor(c / 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = F.floor((a + 11 * h + 22 * m) / 451)
    month, day = F.floor((h + m - 7 * n + 114) / 31), (h + m - 7 * n + 114) % 31 + 1
    return F.make_date(y, month.cast("int"), day.cast("int"))


def is_holiday(day: Column) -> Column:
    """New Year, Labour Day, Christmas and Good Friday."""
    fixed = F.date_format(day, "MM-dd").isin("01-01", "05-01", "12-25")
    return fixed | (day == F.date_sub(easter(F.year(day)), 2))


def is_quiet(day: Column) -> Column:
    """A weekend or a holiday."""
    return F.dayofweek(day).isin(1, 7) | is_holiday(day)


def quiet_until(day: Column, most: int = 14) -> Column:
    """The last day of the run of quiet days that a quiet day lies in; null on working days. A run is shorter than `most`."""
    ahead = F.sequence(F.lit(1), F.lit(most))
    first_working = F.array_min(F.filter(F.transform(ahead, lambda k: F.when(~is_quiet(F.date_add(day, k)), k)), lambda k: k.isNotNull()))
    return F.when(is_quiet(day), F.date_add(day, first_working - 1))


def day_bucket(text: Column) -> Column:
    """The first ten characters, or a mark where there is no date."""
    return F.coalesce(F.nullif(F.substring(text, 1, 10), F.lit("")), F.lit("__no_date__"))


def week_of_slug(slug: Column) -> Column:
    """The Monday of yyyy-Www; null where the slug is no week of that year."""
    year, week = F.regexp_extract(slug, r"^([0-9]{4})-W([0-9]{2})$", 1).try_cast("int"), F.regexp_extract(slug, r"^([0-9]{4})-W([0-9]{2})$", 2).try_cast("int")
    monday = F.date_add(week_start(F.make_date(year, F.lit(1), F.lit(4))), (week - 1) * 7)
    return F.when(iso_week(monday) == slug, monday)


def shifted_week(slug: Column, weeks: int) -> Column:
    return iso_week(F.date_add(week_of_slug(slug), 7 * weeks))


def source_date(text: Column) -> Column:
    """A day written yyyy-MM-dd, dd/MM/yyyy, dd-MM-yyyy or yyyyMMdd, with or without a time after it."""
    head = F.regexp_extract(F.trim(text), r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/-][0-9]{2}[/-][0-9]{4}|[0-9]{8})", 1)
    tries = [F.try_to_timestamp(head, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyyMMdd")]
    return F.coalesce(*tries)


def digest_slot(ts: Column, zone: str = LOCAL_ZONE, morning: int = 8, evening: int = 17) -> Column:
    """The slot of an instant by the hour on the wall: morning, evening or null."""
    hour = F.hour(local_time(ts, zone))
    return F.when(hour == morning, "morning").when(hour == evening, "evening")


def digest_hours(slot: Column, cadence: Column, monday: Column) -> Column:
    """How many hours a recipient's window reaches back, null where no mail is due: weekly on Monday mornings, daily in the
    morning, else twice a day, since the slot before."""
    return (
        F.when((cadence == "weekly") & (slot == "morning") & monday, 168)
        .when((cadence == "daily") & (slot == "morning"), 24)
        .when((cadence == "each") & (slot == "morning"), 15)
        .when((cadence == "each") & (slot == "evening"), 9)
    )
