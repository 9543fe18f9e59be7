"""Numbers, dates and conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    """Whole division, towards zero, exact for whole numbers of any size; null where b is 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def trunc(x: Column, digits: int = 0) -> Column:
    """Towards zero at a decimal place."""
    away = F.round(x, digits)
    return F.when(F.abs(away) > F.abs(x), F.round(away - F.signum(x) * F.lit(10.0**-digits), digits)).otherwise(away)


def round_(x: Column, digits: int = 0, decimal: bool = False) -> Column:
    """Halves go to even for floats, away from zero for decimals."""
    return F.round(x, digits) if decimal else F.bround(x, digits)


def sqrt(x: Column) -> Column:
    return F.when(x < 0, F.raise_error(F.lit("cannot take square root of a negative number"))).otherwise(F.sqrt(x))


def sind(x: Column) -> Column:
    """Sine of degrees, exact at multiples of 30 and 90."""
    m = F.pmod(x, F.lit(360.0))
    exact = F.when(m.isin(0.0, 180.0), 0.0).when(m.isin(30.0, 150.0), 0.5).when(m == 90, 1.0).when(m.isin(210.0, 330.0), -0.5).when(m == 270, -1.0)
    return F.coalesce(exact, F.sin(F.radians(x)))


def cosd(x: Column) -> Column:
    return sind(x + 90)


def tand(x: Column) -> Column:
    m = F.pmod(x, F.lit(180.0))
    return F.when(m == 0, 0.0).when(m == 45, 1.0).when(m == 135, -1.0).otherwise(sind(x) / cosd(x))


def width_bucket(x: Column, low: float, high: float, n: int) -> Column:
    return F.when(x < low, 0).when(x >= high, n + 1).otherwise(F.floor((x - low) / ((high - low) / n)).cast("int") + 1)


def num_nulls(*values: Column) -> Column:
    return sum((v.isNull().cast("int") for v in values), F.lit(0))


def num_nonnulls(*values: Column) -> Column:
    return sum((v.isNotNull().cast("int") for v in values), F.lit(0))


def size_pretty(n: Column) -> Column:
    """Bytes as text: the unit changes at ten times its size, halves are rounded up."""
    out, units = None, ("bytes", "kB", "MB", "GB", "TB")
    for k, unit in enumerate(units):
        value = n if k == 0 else F.floor((n / float(1 << 10 * k)) + 0.5).cast("bigint")
        text = F.concat(value.cast("string"), F.lit(f" {unit}"))
        below = F.abs(value) < (10 * 1024 if k == 0 else 10 * 1024)
        out = F.when(below, text) if out is None else (out.when(below, text) if k < len(units) - 1 else out.otherwise(text))
    return out


def size_bytes(s: Column) -> Column:
    number = F.regexp_extract(s, r"^\s*(-?[0-9.]+)", 1).cast("double")
    unit = F.lower(F.regexp_extract(s, r"([A-Za-z]*)\s*$", 1))
    scale = F.when(unit.isin("", "b", "bytes"), 1.0).when(unit == "kb", 2.0**10).when(unit == "mb", 2.0**20).when(unit == "gb", 2.0**30).when(unit == "tb", 2.0**40)
    return (number * scale).cast("bigint")


def extract(field: str, ts: Column) -> Column:
    """Fields of a timestamp, those that Spark's EXTRACT lacks too; as double."""
    year = F.year(ts)
    ages = lambda n: F.when(year > 0, F.floor((year + n - 1) / n)).otherwise(-F.floor((-year + n) / n))
    own = {
        "century": lambda: ages(100), "millennium": lambda: ages(1000), "decade": lambda: F.floor(year / 10), "epoch": lambda: F.unix_micros(ts.cast("timestamp")) / 1e6,
        "isoyear": lambda: F.date_part(F.lit("YEAROFWEEK"), ts), "dow": lambda: F.dayofweek(ts) - 1, "isodow": lambda: F.weekday(ts) + 1, "week": lambda: F.weekofyear(ts),
        "doy": lambda: F.dayofyear(ts), "quarter": lambda: F.quarter(ts), "milliseconds": lambda: F.date_part(F.lit("SECOND"), ts) * 1000, "microseconds": lambda: F.date_part(F.lit("SECOND"), ts) * 1_000_000,
    }
    return (own[field]() if field in own else F.date_part(F.lit(field), ts)).cast("double")


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """(s1, e1) OVERLAPS (s2, e2): half-open, ends in any order, equal ends are a point."""
    a, b, c, d = F.least(s1, e1), F.greatest(s1, e1), F.least(s2, e2), F.greatest(s2, e2)
    return F.when(a == c, F.lit(True)).otherwise(((a > c) & (a < d)) | ((c > a) & (c < b)))


def justify_hours(days: Column, micros: Column) -> tuple[Column, Column]:
    """Whole days move from the microseconds to the days, with one sign for both."""
    day = F.lit(86_400_000_000)
    total = days * day + micros
    return (F.signum(total) * F.floor(F.abs(total) / day)).cast("bigint"), (total - F.signum(total) * F.floor(F.abs(total) / day) * day).cast("bigint")


def justify_days(months: Column, days: Column) -> tuple[Column, Column]:
    total = months * 30 + days
    return (F.signum(total) * F.floor(F.abs(total) / 30)).cast("bigint"), (total - F.signum(total) * F.floor(F.abs(total) / 30) * 30).cast("bigint")


#: Template words of to_char and to_date, and what date_format has for them.
TEMPLATES = (("YYYY", "yyyy"), ("MONTH", "MMMM"), ("Month", "MMMM"), ("MON", "MMM"), ("Mon", "MMM"), ("MM", "MM"), ("DDD", "DDD"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("Day", "EEEE"), ("Dy", "EEE"), ("AM", "a"), ("PM", "a"))


def template(pattern: str) -> str:
    out, at = "", 0
    while at < len(pattern):
        for word, java in TEMPLATES:
            if pattern.startswith(word, at):
                out, at = out + java, at + len(word)
                break
        else:
            c = pattern[at]
            out, at = out + (f"'{c}'" if c.isalpha() else c), at + 1
    return out


def to_char(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, template(pattern))


def to_date(s: Column, pattern: str) -> Column:
    return F.to_date(s, template(pattern))


def to_timestamp(s: Column, pattern: str) -> Column:
    return F.to_timestamp(s, template(pattern)).cast("timestamp_ntz")


def isfinite(x: Column) -> Column:
    """Of numbers: neither infinite nor no number. Of dates and times without those values: true."""
    return ~(F.isnan(x.cast("double")) | x.cast("double").isin(float("inf"), float("-inf")))


def justify_interval(months: Column, days: Column, micros: Column) -> tuple[Column, Column, Column]:
    """All three parts of one sign where they can be: 24 hours to the day, 30 days to the month."""
    day, month = 86_400_000_000, 30
    total = (months * month + days) * day + micros
    sign, size = F.signum(total).cast("bigint"), F.abs(total)
    whole = F.call_function("div", size, F.lit(day))
    return (sign * F.call_function("div", whole, F.lit(month))), (sign * (whole % month)), (sign * (size % day))


def hypothetical(value: Column, new, order_desc: bool = False) -> dict[str, Column]:
    """Aggregates that tell where ``new`` would stand among the group's values (nulls last): rank, dense_rank, percent_rank, cume_dist."""
    new = F.lit(new)
    before = F.count_if((value > new) if order_desc else (value < new))
    peers = F.count_if(value == new)
    distinct = F.count_distinct(F.when((value > new) if order_desc else (value < new), value))
    rows = F.count(F.lit(1))
    return {"rank": before + 1, "dense_rank": distinct + 1, "percent_rank": F.when(rows == 0, F.lit(0.0)).otherwise(before / rows), "cume_dist": (before + peers + 1) / (rows + 1)}
