"""Filters over dated documents: their predicates, their spelling in query texts, and date matches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import MONTHS, STRENGTH, WEEKDAYS, lookup, parse_dates, resolve_year, span_bounds, weekday
from ..params import DEFAULT, Params

#: The filters of a query text, with and without a value.
VALUED = ("in", "year", "month", "day", "date", "before", "after")
FLAGS = ("sunday", "daily", "empty")


@dataclass(frozen=True)
class Spec:
    """Values of one field unite, fields intersect, an empty field does not restrict; impossible passes nothing."""

    years: tuple[int, ...] = ()
    months: tuple[int, ...] = ()
    month_days: tuple[int, ...] = ()
    weekdays: tuple[int, ...] = ()
    collections: tuple[str, ...] = ()
    windows: tuple[dict, ...] = field(default_factory=tuple)
    after: tuple[str, ...] = ()
    before: tuple[str, ...] = ()
    sunday: bool = False
    daily: bool = False
    empty: bool = False
    impossible: bool = False


def filter_years(df: DataFrame, years) -> DataFrame:
    return df.where(F.year("date").isin(*years))


def filter_months(df: DataFrame, months) -> DataFrame:
    return df.where(F.month("date").isin(*months))


def filter_month_days(df: DataFrame, days) -> DataFrame:
    return df.where(F.dayofmonth("date").isin(*days))


def filter_weekdays(df: DataFrame, days) -> DataFrame:
    return df.where(weekday(F.col("date")).isin(*days))


def filter_format(df: DataFrame, sunday: bool, daily: bool) -> DataFrame:
    """Sundays, Mondays to Saturdays, or both; neither flag does not restrict."""
    days = ([0] if sunday else []) + ([1, 2, 3, 4, 5, 6] if daily else [])
    return filter_weekdays(df, days) if days else df


def filter_collections(df: DataFrame, bridge: DataFrame, collections, key: str = "doc") -> DataFrame:
    return df.join(bridge.where(F.col("collection").isin(*collections)).select(key), key, "left_semi")


def validate_collections(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Wanted collections that are unknown; with no known collection at all every value is accepted."""
    some = known.limit(1).agg(F.count("*").alias("n"))
    return wanted.join(known, "collection", "left_anti").crossJoin(F.broadcast(some)).where("n > 0").drop("n")


def candidate_match(date: Column, c: Column) -> Column:
    """Whether the date agrees with every part that the candidate has."""
    agree = lambda part, value: c[part].isNull() | (c[part] == value)
    return agree("year", F.year(date)) & agree("month", F.month(date)) & agree("day", F.dayofmonth(date)) & agree("weekday", weekday(date))


def match_dates(calendar: DataFrame, expressions: DataFrame, key: str) -> DataFrame:
    """(key, date) of the calendar's days that any candidate of expressions(key, candidates) names.

    A candidate is spelt by the parts that it has, and a day by every choice of its parts, so they meet by equality; documents
    then join by date."""
    spell = lambda *parts: F.concat_ws("/", *(F.coalesce(x.cast("string"), F.lit("*")) for x in parts))
    c, d, none = F.col("c"), F.col("date"), F.lit(None).cast("int")
    own = (F.year(d), F.month(d), F.dayofmonth(d), weekday(d))
    ways = F.array(*(spell(*(x if way >> i & 1 else none for i, x in enumerate(own))) for way in range(16)))
    each = expressions.select(key, F.explode("candidates").alias("c"))
    each = each.select(key, spell(c["year"], c["month"], c["day"], c["weekday"]).alias("spelt")).distinct()
    return calendar.select("date", F.explode(ways).alias("spelt")).join(each, "spelt").select(key, "date").distinct()


def filter_windows(df: DataFrame, calendar: DataFrame, expressions: DataFrame) -> DataFrame:
    days = match_dates(calendar, expressions.withColumn("_k", F.lit(0)), "_k").select("date").distinct()
    return df.join(days, "date", "left_semi")


def filter_after(df: DataFrame, ends) -> DataFrame:
    """Strictly after the earliest of the ends (repeats widen)."""
    return df.where(F.col("date") > F.lit(min(ends)).cast("date"))


def filter_before(df: DataFrame, starts) -> DataFrame:
    return df.where(F.col("date") < F.lit(max(starts)).cast("date"))


def filter_empty(df: DataFrame) -> DataFrame:
    return df.where("transcript = ''")


def predicate(spec: Spec) -> Column:
    """The conjunction of all fields that are decided by the row itself."""
    out, d = F.lit(not spec.impossible), F.col("date")
    days = set(spec.weekdays) | ({0} if spec.sunday else set()) | (set(range(1, 7)) if spec.daily else set())
    for values, part in ((spec.years, F.year(d)), (spec.months, F.month(d)), (spec.month_days, F.dayofmonth(d)), (sorted(days), weekday(d))):
        out = out & part.isin(*values) if values else out
    if spec.windows:
        some = F.lit(False)
        for w in spec.windows:
            c = {k: F.lit(w.get(k)).cast("int") for k in ("year", "month", "day", "weekday")}
            some = some | candidate_match(d, c)
        out = out & some
    out = out & (d > F.lit(min(spec.after)).cast("date")) if spec.after else out
    out = out & (d < F.lit(max(spec.before)).cast("date")) if spec.before else out
    return out & (F.col("transcript") == "") if spec.empty else out


def apply_filters(df: DataFrame, spec: Spec, bridge: DataFrame | None = None) -> DataFrame:
    """Rows that pass; on scored results this runs after scoring, as counts and normalisers are those of all documents."""
    df = df.where(predicate(spec))
    return filter_collections(df, bridge, spec.collections) if spec.collections and bridge is not None else df


def date_text(transcript: Column, description: Column) -> Column:
    return F.coalesce(F.nullif(transcript, F.lit("")), F.nullif(description, F.lit("")), F.lit(""))


def filter_only(df: DataFrame, spec: Spec, bridge: DataFrame | None = None) -> DataFrame:
    """All passing documents at one score, as results of source filter."""
    rows = apply_filters(df, spec, bridge)
    return rows.withColumn("score", F.lit(STRENGTH["broad"])).withColumn("source", F.lit("filter")).withColumn("text", date_text(F.col("transcript"), F.col("description")))


def with_date_matches(results: DataFrame, matched: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """results(query_id, doc, score, source) united with matched(query_id, doc, strength): both kinds of evidence add up,
    documents matched by date alone are appended, others stay."""
    both = results.join(matched, ["query_id", "doc"], "full")
    s, d = F.col("score"), F.col("strength")
    total = F.when(s.isNull(), d).when(d.isNull(), s).otherwise(F.greatest(s, d) + p.agreement_bonus * F.least(s, d))
    return both.select("query_id", "doc", total.alias("score"), F.coalesce("source", F.lit("date")).alias("source"))


def extract_filters(queries: DataFrame, span: tuple[int, int]) -> DataFrame:
    """(query_id, start, end, name, value, plus what the value means, valid) for each @name[:value] of the ten names.

    Names in any case; an unknown name is text, value included.  Offsets count characters."""
    run = "@([a-zA-Z]+)(?::(\\S+))?"
    text = F.coalesce("query", F.lit(""))
    whole = F.regexp_extract_all(text, F.lit(run), F.lit(0))
    gaps = F.split(text, run, -1)
    zipped = F.arrays_zip(whole.alias("m"), F.slice(gaps, 1, F.size(whole)).alias("gap"))
    one = queries.select("query_id", F.posexplode(zipped).alias("i", "x"))
    end = F.sum(F.length("x.gap") + F.length("x.m")).over(Window.partitionBy("query_id").orderBy("i")).cast("int")
    one = one.select("query_id", "i", (end - F.length("x.m")).alias("start"), end.alias("end"), F.lower(F.regexp_extract("x.m", "@([a-zA-Z]+)", 1)).alias("name"), F.nullif(F.lower(F.regexp_extract("x.m", ":(\\S+)", 1)), F.lit("")).alias("value"))
    one = one.where(F.col("name").isin(*VALUED, *FLAGS))
    name, value = F.col("name"), F.col("value")
    small = F.when(value.rlike("^[0-9]{1,2}$"), value.cast("int"))
    year = F.when(value.rlike("^([0-9]{2}|[0-9]{4})$"), resolve_year(value.try_cast("int"), F.length("value"), span, "filter"))
    one = parse_dates(one, "value", span, "filter").withColumn("bounds", span_bounds(F.col("candidates"))).drop("precision")
    is_ = lambda n: name == n
    one = one.withColumns(
        {
            "year": F.when(is_("year"), year),
            "month": F.when(is_("month"), F.coalesce(lookup(MONTHS, value), F.when(small.between(1, 12), small))),
            "weekday": F.when(is_("day"), lookup(WEEKDAYS, value)),
            "month_day": F.when(is_("day") & lookup(WEEKDAYS, value).isNull() & small.between(1, 31), small),
            "collection": F.when(is_("in"), value),
            "candidates": F.when(is_("date"), F.col("candidates")),
            "after": F.when(is_("after"), F.col("bounds.last")),
            "before": F.when(is_("before"), F.col("bounds.first")),
        }
    ).drop("bounds", "i")
    meant = F.coalesce(*(F.col(c).isNotNull() for c in ("year",)), F.lit(False))
    for c in ("month", "weekday", "month_day", "collection", "candidates", "after", "before"):
        meant = meant | F.col(c).isNotNull()
    return one.withColumn("valid", F.when(name.isin(*FLAGS), value.isNull()).otherwise(meant))


def residual(queries: DataFrame, extracted: DataFrame) -> DataFrame:
    """(query_id, residual, segments): the text between recognised filters, trimmed, blanks dropped."""
    own = Window.partitionBy("query_id").orderBy("start")
    cuts = extracted.select("query_id", "start", "end").withColumn("from", F.coalesce(F.lag("end").over(own), F.lit(0)))
    cuts = cuts.select("query_id", "from", F.col("start").alias("to"))
    tail = queries.join(extracted.groupBy("query_id").agg(F.max("end").alias("from")), "query_id", "left")
    tail = tail.select("query_id", F.coalesce("from", F.lit(0)).alias("from"), F.length("query").alias("to"))
    both = cuts.unionByName(tail).join(queries.select("query_id", "query"), "query_id")
    piece = F.trim(F.expr("substring(query, from + 1, to - from)"))
    got = both.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("from", piece.alias("s")))).alias("p"))
    segments = F.filter(F.transform("p", lambda x: x["s"]), lambda s: s != "")
    return got.select("query_id", segments.alias("segments"), F.array_join(segments, " ").alias("residual"))


def fold_filters(extracted: DataFrame) -> DataFrame:
    """One row per query: sets per field, widest bounds, flags and impossible."""
    days = F.when(F.col("name") == "sunday", F.array(F.lit(0))).when(F.col("name") == "daily", F.array(*map(F.lit, range(1, 7)))).otherwise(F.array("weekday"))
    rows = extracted.withColumn("days", days)
    known = lambda c: F.array_sort(F.collect_set(c))
    return rows.groupBy("query_id").agg(
        known("year").alias("years"), known("month").alias("months"), known("month_day").alias("month_days"),
        F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list("days")), lambda x: x.isNotNull()))).alias("weekdays"),
        known("collection").alias("collections"), F.min("after").alias("after"), F.max("before").alias("before"),
        F.bool_or((F.col("name") == "empty") & F.col("valid")).alias("empty"), F.bool_or(~F.col("valid")).alias("impossible"),
    )


def canonical_filters(extracted: DataFrame) -> DataFrame:
    """(query_id, token): distinct valid filters in their one spelling."""
    names = F.create_map(*(F.lit(x) for n, v in MONTHS.items() if len(n) > 3 or n == "may" for x in (v, n) if n != "sept"))
    token = (
        F.when(F.col("name").isin("sunday", "daily"), F.concat(F.lit("@"), "name"))
        .when(F.col("year").isNotNull(), F.concat(F.lit("@year:"), "year"))
        .when(F.col("month").isNotNull(), F.concat(F.lit("@month:"), F.try_element_at(names, F.col("month"))))
        .when(F.col("month_day").isNotNull(), F.concat(F.lit("@day:"), "month_day"))
        .when(F.col("collection").isNotNull(), F.concat(F.lit("@in:"), "collection"))
    )
    return extracted.where("valid").select("query_id", token.alias("token")).where("token is not null").distinct()
