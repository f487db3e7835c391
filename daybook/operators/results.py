"""Order, cut, tier and print result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lowest ratio to the best score of tiers 5, 4, 3 and 2.
STEPS = (0.85, 0.70, 0.55, 0.40)
FIFTHS = (0.8, 0.6, 0.4, 0.2)
#: Width to height of Sunday and weekday pages.
SUNDAY_RATIO, DAILY_RATIO = 1.427, 3.098


def _chronology() -> list[Column]:
    return [F.col("date"), F.coalesce("id", F.lit(""))]


def ranked(df: DataFrame, by: str | tuple[str, ...] = "query_id") -> DataFrame:
    """Adds position: score down, then date, then id, within each query."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(F.desc("score"), *_chronology())))


def order_by_rank(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("score"), *_chronology())


def order_by_date(df: DataFrame) -> DataFrame:
    return df.orderBy(*_chronology())


def top_k(df: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The first k rows of each query with their position and the query's row count."""
    return ranked(df, by).withColumn("total", F.count("*").over(Window.partitionBy(by))).where(F.col("position") <= k)


def union_results(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_semi").select(key).distinct()


def assign_tiers(df: DataFrame, mode: str = "steps", by: str = "query_id") -> DataFrame:
    """Adds tier 1 to 5.  steps and fifths compare with the best score, stretch with the range of scores, quantile
    with the rank, where ties share the first rank."""
    own = Window.partitionBy(by)
    s, top, low = F.col("score"), F.max("score").over(own), F.min("score").over(own)
    if mode == "quantile":
        rank = F.rank().over(own.orderBy(F.desc("score"))) - 1
        return df.withColumn("tier", F.least(F.lit(5), F.greatest(F.lit(1), 5 - F.floor(rank * 5 / F.count("*").over(own)))).cast("int"))
    if mode == "stretch":
        ratio, cuts = F.when(top == low, 1.0).otherwise((s - low) / (top - low)), FIFTHS
    else:
        ratio, cuts = F.when(top <= 0, 1.0).otherwise(s / top), STEPS if mode == "steps" else FIFTHS
    tier = F.when(ratio >= cuts[0], 5).when(ratio >= cuts[1], 4).when(ratio >= cuts[2], 3).when(ratio >= cuts[3], 2).otherwise(1)
    return df.withColumn("tier", tier)


def best_tier_per_date(df: DataFrame, by: str = "query_id") -> DataFrame:
    return df.groupBy(by, "date").agg(F.max("tier").alias("tier"))


def escaped(col: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        col = F.replace(col, F.lit(char), F.lit(name))
    return col


def render_snippets(df: DataFrame, text: str = "text", ranges: str = "ranges", tag: str = "mark") -> DataFrame:
    """Adds html: the escaped text with each range in a tag; a range that starts before the last one's end is skipped."""
    cut = lambda a, b: escaped(F.substring(F.col(text), a + 1, b - a))
    start = F.struct(F.lit("").alias("html"), F.lit(0).alias("at"))
    step = lambda acc, r: F.when(r["start"] < acc["at"], acc).otherwise(
        F.struct(
            F.concat(acc["html"], cut(acc["at"], r["start"]), F.lit(f"<{tag}>"), cut(r["start"], r["end"]), F.lit(f"</{tag}>")).alias("html"),
            r["end"].alias("at"),
        )
    )
    done = lambda acc: F.concat(acc["html"], cut(acc["at"], F.length(F.col(text))))
    return df.withColumn("html", F.aggregate(F.coalesce(ranges, F.array().cast("array<struct<start:int,end:int>>")), start, step, done))


def report_columns(df: DataFrame) -> DataFrame:
    """Adds date_label (Monday, November 18, 1985), source_label and ratio."""
    source = F.when(F.col("source") == "transcript", "Transcript").when(F.col("source") == "description", "Description").when(F.col("source") == "date", "Date").otherwise("Filter")
    return df.withColumns(
        {
            "date_label": F.date_format("date", "EEEE, MMMM d, yyyy"),
            "source_label": source,
            "ratio": F.when(F.dayofweek("date") == 1, SUNDAY_RATIO).otherwise(DAILY_RATIO),
        }
    )


def result_counts(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, n, empty) for every query, those without a result too."""
    n = results.groupBy("query_id").agg(F.count("*").alias("n"))
    out = queries.select("query_id").join(n, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("empty", F.col("n") == 0)
