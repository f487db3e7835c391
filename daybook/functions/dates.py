"""Texts that name dates, read into candidate parts by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

#: Month and weekday names with their short forms; Sunday is 0.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5,
    "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sept": 9, "sep": 9,
    "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
WEEKDAYS = {
    "sunday": 0, "sun": 0, "monday": 1, "mon": 1, "tuesday": 2, "tues": 2, "tue": 2, "wednesday": 3, "wed": 3,
    "thursday": 4, "thurs": 4, "thur": 4, "thu": 4, "friday": 5, "fri": 5, "saturday": 6, "sat": 6,
}

STRENGTH = {"exact": 3.0, "narrow": 1.5, "broad": 0.8}
CANDIDATE = "struct<year:int,month:int,day:int,weekday:int>"


def weekday(col: Column) -> Column:
    return F.dayofweek(col) - 1


def lookup(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def resolve_year(value: Column, digits: Column, span: tuple[int, int], source: str) -> Column:
    """Four digits as they are, two in the century inside the span; outside the span only for filters."""
    low, high = span
    inside = lambda y: (y >= low) & (y <= high)
    four = F.when(F.lit(source == "filter") | inside(value), value)
    two = F.when(inside(value + 1900), value + 1900).when(inside(value + 2000), value + 2000)
    if source == "filter":
        two = F.coalesce(two, value + 1900)
    return F.when(digits == 4, four).when(digits == 2, two)


def real_date(year: Column, month: Column, day: Column) -> Column:
    """The date of the parts, null if there is none."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def parse_dates(df: DataFrame, col: str, span: tuple[int, int], source: str = "query") -> DataFrame:
    """Adds candidates (array of CANDIDATE, null if the text names no date) and precision.

    A text is split at spaces, commas, points, slashes and dashes; every piece has to be a month name, a weekday
    name, a number, an ordinal or a compact date of 6 or 8 digits.  Numbers take roles by their count; where day
    and month can change places both readings stay.  A weekday has to agree with a full date, else it narrows.
    """
    c = F.col
    pieces = F.filter(F.split(F.lower(c(col)), "[\\s,./\\-]+"), lambda p: p != "")

    def classify(p: Column) -> Column:
        digits = F.regexp_extract(p, "^'?([0-9]+)$", 1)
        ordinal = F.regexp_extract(p, "^([0-9]{1,2})(st|nd|rd|th)$", 1)
        size = F.length(digits)
        number = F.when(ordinal != "", ordinal).when((size >= 1) & (size <= 4), digits)
        compact = F.when((ordinal == "") & size.isin(6, 8), digits)
        return F.struct(
            lookup(MONTHS, p).alias("month"),
            lookup(WEEKDAYS, p).alias("weekday"),
            F.struct(number.cast("int").alias("v"), F.length(number).alias("d"), (ordinal != "").alias("o")).alias("n"),
            compact.alias("compact"),
        )

    def pick(tk: Column, name: str) -> Column:
        return F.filter(F.transform(tk, lambda t: t[name]), lambda v: v.isNotNull())

    def sorted_out(tk: Column) -> Column:
        numbers = F.filter(F.transform(tk, lambda t: t["n"]), lambda n: n["v"].isNotNull())
        return F.struct(
            pick(tk, "month").alias("m"), pick(tk, "weekday").alias("wd"), pick(tk, "compact").alias("cp"), numbers.alias("ns"), F.size(tk).alias("size")
        )

    year = lambda n: F.when(~n["o"], resolve_year(n["v"], n["d"], span, source))
    as_month = lambda n: F.when(~n["o"] & (n["d"] <= 2) & n["v"].between(1, 12), n["v"])
    as_day = lambda n: F.when((n["d"] <= 2) & n["v"].between(1, 31), n["v"])
    role = {"y": year, "m": as_month, "d": as_day}
    none = F.lit(None).cast("int")

    def found(x: Column) -> Column:
        m, wd, cps, ns = x["m"], x["wd"], x["cp"], x["ns"]
        month = F.get(m, F.lit(0))

        def reading(roles: str) -> Column:
            """The numbers in these roles; null if one cannot hold it."""
            n = {r: role[r](F.get(ns, F.lit(i))) for i, r in enumerate(roles)}
            whole = F.struct(n.get("y", none).alias("year"), n.get("m", month).cast("int").alias("month"), n.get("d", none).alias("day"))
            parts = {"y": "year", "m": "month", "d": "day"}

            def kept(w: Column) -> Column:
                every = F.size(ns) == len(roles)
                for r in roles:
                    every = every & w[parts[r]].isNotNull()
                return F.when(every, w)

            return let(whole, kept)

        def some(*readings: str) -> Column:
            return F.array_distinct(F.filter(F.array(*map(reading, readings)), lambda r: r.isNotNull()))

        named = F.when(F.size(ns) == 1, some("y")).when(F.size(ns) == 2, some("yd", "dy"))
        if source == "filter":
            plain = F.when(F.size(ns) == 1, some("y")).when(F.size(ns) == 2, some("ym")).when(F.size(ns) == 3, some("ymd"))
        else:
            plain = (
                F.when((F.size(ns) == 1) & (F.get(ns, F.lit(0))["d"] == 4), some("y"))
                .when(F.size(ns) == 2, some("ym", "my"))
                .when(F.size(ns) == 3, let(some("ymd"), lambda f: F.when(F.size(f) > 0, f).otherwise(some("mdy", "dmy"))))
            )
        cp = F.get(cps, F.lit(0))
        part = lambda a, n: F.substring(cp, F.lit(a), F.lit(n)).try_cast("int")
        size = F.length(cp)
        packed = F.struct(resolve_year(part(1, 4), F.lit(4), span, source).alias("year"), part(5, 2).alias("month"), F.when(size == 8, part(7, 2)).alias("day"))
        sound = lambda c: c["year"].isNotNull() & c["month"].between(1, 12) & ((size == 6) | real_date(c["year"], c["month"], c["day"]).isNotNull())
        compact = let(packed, lambda c: F.when(sound(c), F.array(c)))
        sane = (F.size(m) + F.size(wd) + F.size(cps) + F.size(ns) == x["size"]) & (x["size"] > 0) & (F.size(m) < 2) & (F.size(wd) < 2) & (F.size(cps) < 2)
        alone = (F.size(m) == 0) & (F.size(ns) == 0)
        return F.when(sane, F.when(F.size(cps) == 1, F.when(alone, compact)).when(F.size(m) == 1, named).otherwise(plain))

    def checked(x: Column) -> Column:
        day = F.get(x["wd"], F.lit(0))

        def valid(c: Column) -> Column:
            full = c["month"].isNotNull() & c["day"].isNotNull()
            agrees = lambda d: d.isNotNull() & (day.isNull() | F.coalesce(weekday(d) == day, F.lit(False)))
            return c["year"].isNotNull() & (~full | let(real_date(c["year"], c["month"], c["day"]), agrees))

        kept = F.transform(F.filter(found(x), valid), lambda c: F.struct(c["year"].alias("year"), c["month"].alias("month"), c["day"].alias("day"), day.alias("weekday")))
        return let(kept, lambda k: F.when(F.size(k) > 0, k))

    candidates = let(F.transform(pieces, classify), lambda tk: let(sorted_out(tk), checked))
    return with_precision(df.withColumn("candidates", candidates.cast(f"array<{CANDIDATE}>")))


def with_precision(df: DataFrame) -> DataFrame:
    exact = F.forall("candidates", lambda x: x["month"].isNotNull() & x["day"].isNotNull())
    bare = F.forall("candidates", lambda x: x["month"].isNull() & x["day"].isNull() & x["weekday"].isNull())
    named = F.when(exact, "exact").when(bare, "broad").otherwise("narrow")
    return df.withColumn("precision", F.when(F.col("candidates").isNotNull(), named))


def span_bounds(candidates: Column) -> Column:
    """struct(first, last) of the one candidate without weekday, else null: a year, a month or a day."""
    x = F.get(candidates, F.lit(0))
    y, m, d = x["year"], x["month"], x["day"]
    first = real_date(y, F.coalesce(m, F.lit(1)), F.coalesce(d, F.lit(1)))
    last = F.when(m.isNull(), real_date(y, F.lit(12), F.lit(31))).when(d.isNull(), F.last_day(first)).otherwise(first)
    return F.when((F.size(candidates) == 1) & x["weekday"].isNull() & y.isNotNull(), F.struct(first.alias("first"), last.alias("last")))
