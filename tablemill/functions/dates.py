"""Date column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names, 1 = Sunday.
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]

# Last month-day of each sign in calendar order; the first one also closes the year.
SIGN_ENDS = [
    (119, "Capricorn"), (218, "Aquarius"), (320, "Pisces"), (419, "Aries"), (520, "Taurus"), (620, "Gemini"),
    (722, "Cancer"), (822, "Leo"), (922, "Virgo"), (1022, "Libra"), (1121, "Scorpio"), (1221, "Sagittarius"),
]


def weekday_name(number: Column) -> Column:
    """Name for 1..7, null outside."""
    return F.try_element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.when(number.between(1, 7), number))


def age_in_years(day: Column, today: Column) -> Column:
    """Difference of calendar years, months ignored."""
    return F.year(today) - F.year(day)


def sign_of(day: Column) -> Column:
    month_day = F.month(day) * 100 + F.dayofmonth(day)
    label = None
    for end, name in SIGN_ENDS:
        label = F.when(month_day <= end, name) if label is None else label.when(month_day <= end, name)
    return label.otherwise(SIGN_ENDS[0][1])


def excel_to_timestamp(serial: Column) -> Column:
    """Day 0 is 1899-12-30; the fraction gives hour, minute and second, each cut down in turn."""
    serial = serial.cast("double")
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))
    hours = F.pmod(serial, F.lit(1.0)) * 24
    hour = F.floor(hours)
    rest = hours - hour
    minute_rest = rest % F.lit(1 / 60)
    minute = F.round((rest - minute_rest) / F.lit(1 / 60)).cast("bigint")
    second = F.floor(minute_rest * 60 * 60)
    return F.timestamp_add("SECOND", (hour * 3600 + minute * 60 + second).cast("int"), day.cast("timestamp"))


def excel_is_readable(serial: Column) -> Column:
    """Serials that fall on a representable day (year 1 to 9999)."""
    return serial.between(-693593, 2958465.999999)


def slashed(text: Column) -> Column:
    """First blank-separated part with ``- . ,`` turned into slashes."""
    return F.translate(F.split_part(F.ltrim(text), F.lit(" "), F.lit(1)), "-.,", "///")


# Month and day as digits; texts that pass hardly ever fail to convert, so no time goes into failures.
_MONTH, _DAY, _MONTH2, _DAY2 = "0?[1-9]|1[0-2]", "0?[1-9]|[12][0-9]|3[01]", "0[1-9]|1[0-2]", "0[1-9]|[12][0-9]|3[01]"
_TIME = "(?: (?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9])?"


def _reads_as(text: Column, first: str, second: str, shown: str) -> Column:
    pattern = f"^({first})/({second})/([0-9]{{4}}|[0-9]{{2}})$"
    # two-digit years lie in a century whose 00 is a leap year
    iso = F.regexp_replace(F.regexp_replace(text, pattern, shown), "^([0-9]{2}-)", "20$1")
    return F.coalesce(F.when(text.rlike(pattern), iso.try_cast("date").isNotNull()), F.lit(False))


def is_dayfirst(text: Column) -> Column:
    return _reads_as(slashed(text), _DAY, _MONTH, "$3-$2-$1")


def is_monthfirst(text: Column) -> Column:
    return _reads_as(slashed(text), _MONTH, _DAY, "$3-$1-$2")


# Month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# The date formats tried on a text column, each as (pattern, ISO form): year first, without
# separators, day or month first, month by name.  A time may follow; days and months may have one
# digit; years of two digits from 69 on lie in the last century.
_CLOCK = "(?:[ T]((?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:[.][0-9]{1,6})?)?)(?:Z)?)?"
_NAME = "(" + "|".join(MONTHS) + ")[a-z]*[.]?"
YEAR_FIRST = (f"^([0-9]{{4}})[-/.]({_MONTH})[-/.]({_DAY}){_CLOCK}$", "$1-$2-$3 $4")
COMPACT = (f"^([0-9]{{4}})({_MONTH2})({_DAY2})$", "$1-$2-$3 ")
DAY_FIRST = (f"^({_DAY})[-/.]({_MONTH})[-/.]([0-9]{{4}}|[0-9]{{2}}){_CLOCK}$", "$3-$2-$1 $4")
MONTH_FIRST = (f"^({_MONTH})[-/.]({_DAY})[-/.]([0-9]{{4}}|[0-9]{{2}}){_CLOCK}$", "$3-$1-$2 $4")
NAME_FIRST = (f"^{_NAME}[ -]({_DAY})(?:st|nd|rd|th)?,?[ -]([0-9]{{4}}){_CLOCK}$", "$3-$1-$2 $4")
NAME_SECOND = (f"^({_DAY})(?:st|nd|rd|th)?[ -]{_NAME},?[ -]([0-9]{{4}}){_CLOCK}$", "$3-$2-$1 $4")


def parse_date(text: Column, dayfirst: bool = False) -> Column:
    """Timestamp of a text in one of the known formats, otherwise null."""
    low = F.lower(F.trim(text))
    low = F.regexp_replace(low, "([0-9])t([0-9])", "$1T$2")
    low = F.regexp_replace(low, "([0-9])z$", "$1Z")
    order = [YEAR_FIRST, COMPACT, *((DAY_FIRST, MONTH_FIRST) if dayfirst else (MONTH_FIRST, DAY_FIRST)), NAME_FIRST, NAME_SECOND]
    iso = None
    for pattern, shown in order:
        hit, value = low.rlike(pattern), F.trim(F.regexp_replace(low, pattern, shown))
        iso = F.when(hit, value) if iso is None else iso.when(hit, value)
    iso = F.regexp_replace(F.regexp_replace(iso, "^([0-5][0-9]-|6[0-8]-)", "20$1"), "^(69-|[7-9][0-9]-)", "19$1")
    name = F.regexp_extract(iso, "-([a-z]{3})-", 1)
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("string")
    return F.when(name == "", iso).otherwise(F.replace(iso, name, number)).try_cast("timestamp")


def is_nanoseconds(number: Column) -> Column:
    """Aggregate: the numbers read as nanoseconds since 1970, a range of more than a day after its start."""
    return (F.max(number) - F.min(number) > 86_400 * 10**9) & (F.min(number) > 0)


def nanoseconds_to_timestamp(number: Column) -> Column:
    return F.timestamp_micros(F.floor(number / 1000).cast("long"))


def date_key(day: Column) -> Column:
    """20240131 as int."""
    return F.date_format(day, "yyyyMMdd").cast("int")


def year_of_key(key: Column) -> Column:
    return F.year(F.to_date(key.cast("string"), "yyyyMMdd"))
