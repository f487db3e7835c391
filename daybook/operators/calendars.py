"""Calendars, neighbours in time, and what collections cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import weekday


def calendar(spark: SparkSession, start: str, end: str, gaps: list[tuple[str, str]] = ()) -> DataFrame:
    """(date, week, weekday, state): every day of the span; weeks count from the Monday on or before the start."""
    d, monday = F.col("date"), F.date_sub(F.lit(start).cast("date"), F.weekday(F.lit(start).cast("date")))
    gone = F.lit(False)
    for a, b in gaps:
        gone = gone | d.between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return days.select("date", F.floor(F.datediff(d, monday) / 7).cast("int").alias("week"), weekday(d).alias("weekday"), F.when(gone, "gap").otherwise("strip").alias("state"))


def mark_missing(days: DataFrame, docs: DataFrame) -> DataFrame:
    """Days without a document become none."""
    held = docs.select("date").distinct().withColumn("_held", F.lit(True))
    out = days.join(held, "date", "left")
    return out.withColumn("state", F.when(F.col("_held").isNull() & (F.col("state") == "strip"), "none").otherwise(F.col("state"))).drop("_held")


def in_collection(days: DataFrame, ranges: DataFrame, sundays: DataFrame) -> DataFrame:
    """(collection, date): days within any range(collection, first, last); collections listed in sundays hold Sundays only.

    Ranges open into days, an equi join with the calendar; a collection without range has no day."""
    opened = ranges.select("collection", F.explode(F.sequence("first", "last")).alias("date")).distinct()
    out = days.select("date", "weekday").join(opened, "date").join(sundays.select("collection").distinct().withColumn("_only", F.lit(True)), "collection", "left")
    return out.where("_only is null or weekday = 0").select("collection", "date")


def label_spans(days: DataFrame, level: str) -> DataFrame:
    """(period, first_week, next_week): from a month's or year's first week to the next one's; the last ends with the calendar."""
    one = days.groupBy(F.trunc("date", level).alias("period")).agg(F.min("week").alias("first_week"), F.max("week").alias("last_week"))
    own = Window.orderBy("period")  # one row per period of the span
    return one.select("period", "first_week", F.coalesce(F.lead("first_week").over(own), F.col("last_week") + 1).alias("next_week"))


def adjacent(docs: DataFrame, days: DataFrame, jump: int = 1) -> DataFrame:
    """(date, previous, next): the nearest document dates at least jump days away.

    An as-of lookup on the calendar, one row a day, joined back by date."""
    held = days.select("date").join(docs.select("date").distinct().withColumn("h", F.col("date")), "date", "left")
    back = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -jump)  # the calendar is small
    ahead = Window.orderBy("date").rowsBetween(jump, Window.unboundedFollowing)
    out = held.withColumn("previous", F.last("h", True).over(back)).withColumn("next", F.first("h", True).over(ahead))
    return out.where("h is not null").select("date", "previous", "next")


def adjacent_same_weekday(docs: DataFrame) -> DataFrame:
    own = Window.partitionBy(weekday(F.col("date"))).orderBy("date")
    one = docs.select("date").distinct()
    return one.select("date", F.lag("date").over(own).alias("previous"), F.lead("date").over(own).alias("next"))


def published_label(year: Column, month: Column, day: Column) -> Column:
    """1987, April 1987 or April 1, 1987; null for year 0."""
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, F.coalesce(month, F.lit(1)), F.coalesce(day, F.lit(1))), "yyyy-MM-dd")
    form = F.when(month.isNull(), F.date_format(date, "yyyy")).when(day.isNull(), F.date_format(date, "MMMM yyyy")).otherwise(F.date_format(date, "MMMM d, yyyy"))
    return F.when(year > 0, form)


def collection_summary(collections: DataFrame, members: DataFrame) -> DataFrame:
    """Per collection: number of documents, first and last date, and a coverage label."""
    own = members.groupBy("collection").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    label = F.when(F.col("n").isNull(), "nothing").when(F.col("first") == F.col("last"), F.date_format("first", "MMMM d, yyyy")).otherwise(
        F.concat(F.date_format("first", "MMMM yyyy"), F.lit(" to "), F.date_format("last", "MMMM yyyy"))
    )
    return collections.join(own, "collection", "left").withColumn("coverage", label).withColumn("n", F.coalesce("n", F.lit(0)))


def calendar_values(days: DataFrame, depth: int, prefix: str = "") -> DataFrame:
    """(value, n): the years (depth 1), months (2) or days (3) with a document whose digits start with prefix, padded or not."""
    form = {1: "yyyy", 2: "MM", 3: "dd"}[depth]
    one = days.where("state = 'strip'").groupBy(F.date_format("date", form).alias("value")).agg(F.count("*").alias("n"))
    return one.where(F.col("value").startswith(prefix) | F.col("value").cast("int").cast("string").startswith(prefix))


def drill_down(days: DataFrame) -> DataFrame:
    """(year, month, n) with the totals of years and of all, one rollup."""
    held = days.where("state = 'strip'").select(F.year("date").alias("year"), F.month("date").alias("month"))
    return held.rollup("year", "month").agg(F.count("*").alias("n"))


def page_label(pages: Column) -> Column:
    """12, 12-13 for neighbours in a row, 12, 15 otherwise."""
    n = F.size(pages)
    low, high = F.element_at(pages, 1), F.element_at(pages, -1)
    return F.when(n == 1, low.cast("string")).when(high - low == n - 1, F.concat_ws("-", low, high)).otherwise(F.array_join(pages.cast("array<string>"), ", "))


def appearance_report(appearances: DataFrame, names: DataFrame) -> DataFrame:
    """(key, collection, name, lines): one entry per document and book, a line for each edition and volume."""
    line = F.concat_ws(" ", F.col("edition"), F.when(F.col("volume").isNotNull(), F.concat(F.lit("vol. "), "volume")), F.lit("p."), page_label(F.col("pages")))
    one = appearances.groupBy("key", "collection").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return one.join(names, "collection")


def unprinted(docs: DataFrame, appearances: DataFrame, key: str) -> DataFrame:
    return docs.join(appearances.select(F.col("key").alias("_k")), docs[key].cast("string") == F.col("_k"), "left_anti")


def alterations(appearances: DataFrame, collections: DataFrame) -> DataFrame:
    """Adds the collection's alteration for the document's key, and whether a Sunday page stands there in black and white."""
    own = collections.select("collection", "alterations", "colour")
    out = appearances.join(own, "collection").withColumn("alteration", F.try_element_at("alterations", F.col("key")))
    return out.withColumn("grey_sunday", (F.dayofweek("date") == 1) & ~F.col("colour")).drop("alterations", "colour")


def completion_table(vocab: DataFrame, k: int = 40) -> DataFrame:
    """(kind, prefix, position, value): the first k values of vocab(kind, value, spelling, ord) for every prefix of a spelling."""
    cut = F.transform(F.sequence(F.lit(0), F.length("spelling")), lambda i: F.substring(F.lower("spelling"), F.lit(1), i))
    one = vocab.select("kind", "value", "ord", F.explode(cut).alias("prefix")).groupBy("kind", "prefix", "value").agg(F.min("ord").alias("ord"))
    own = Window.partitionBy("kind", "prefix").orderBy("ord", "value")
    return one.withColumn("position", F.row_number().over(own)).where(F.col("position") <= k).select("kind", "prefix", "position", "value")
