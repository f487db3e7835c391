"""Calendars, collections and toggles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendars as K
from ..sources import archive as A
from ..streaming import toggles
from ..tables import dealt
from .archive_plans import apps, books
from .bindings import CALENDAR_SQL, END, GAPS, PRINTED_SQL, RARE_SQL, START, STRIPS_SQL, flat, printed, printed_rows, rare, strips, table


def days(spark):
    return K.calendar(spark, START, END, GAPS)


def order_days(spark):
    return K.calendar(spark, "1995-01-01", "2001-12-31")


def c02(spark, d):
    return flat(K.mark_missing(days(spark), strips(spark, d)))


def c03(spark, d):
    r = A.date_ranges(dealt(printed(spark, d).select("collection", "date"), printed_rows(spark, d), "collection"))
    sundays = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("collection"))
    return flat(K.in_collection(order_days(spark), r, sundays))


def c04(spark, d):
    held = days(spark).join(strips(spark, d).select("date").distinct(), "date", "left_semi")
    return flat(K.label_spans(held, "month"))


def docs(spark, d):
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))


def c05(spark, d):
    return flat(K.adjacent(docs(spark, d), order_days(spark), 7))


def c06(spark, d):
    return flat(K.adjacent_same_weekday(docs(spark, d)))


def c07(spark, d):
    return flat(K.collection_summary(books(spark, d).select("collection", "name"), rare(spark, d)))


def c08(spark, d):
    held = order_days(spark).join(docs(spark, d).distinct(), "date", "left_semi")
    return flat(K.calendar_values(held, 2, "1").withColumn("depth", F.lit(2)).unionByName(K.calendar_values(held, 1, "199").withColumn("depth", F.lit(1))))


def c08b(spark, d):
    return flat(K.drill_down(order_days(spark).join(docs(spark, d).distinct(), "date", "left_semi")))


def c09(spark, d):
    return flat(K.appearance_report(apps(spark, d), books(spark, d).select("collection", "name")))


def c10(spark, d):
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"))
    return flat(K.unprinted(own, rare(spark, d).select(F.col("key").cast("string").alias("key")), "doc"))


def c11(spark, d):
    # a book alters the pages of orders that end like its nation's number
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("collection"), F.create_map(F.col("s_nationkey").cast("string"), F.lit("altered")).alias("alterations"), (F.col("s_suppkey") % 2 == 0).alias("colour"))
    own = printed(spark, d).select(F.col("key").alias("doc"), (F.col("key") % 25).cast("string").alias("key"), "collection", "date").distinct()
    return flat(K.alterations(own, b))


def c12(spark, d):
    return flat(toggles.toggle_state(table(spark, d, "events").where("event_type = 'click'")))


def c13(spark, d):
    n = table(spark, d, "nation").select(F.lit("in").alias("kind"), F.col("n_name").alias("value"), F.lower("n_name").alias("spelling"), F.col("n_nationkey").alias("ord"))
    years = docs(spark, d).select(F.year("date").alias("y")).distinct()
    y = years.select(F.lit("year").alias("kind"), F.col("y").cast("string").alias("value"), F.explode(F.array(F.col("y").cast("string"), F.right(F.col("y").cast("string"), F.lit(2)))).alias("spelling"), F.col("y").alias("ord"))
    return flat(K.completion_table(n.unionByName(y), 5))


DOCS = "docs AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"
PLANS = {
    "c02_missing_days": (c02, f"WITH {STRIPS_SQL}, {CALENDAR_SQL} SELECT CAST(date AS VARCHAR) AS date, week, weekday, CASE WHEN state = 'strip' AND date NOT IN (SELECT date FROM strips) THEN 'none' ELSE state END AS state FROM calendar"),
    "c03_in_collection": (c03, f"WITH {PRINTED_SQL} SELECT DISTINCT collection, CAST(date AS VARCHAR) AS date FROM printed WHERE collection NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) OR dayofweek(date) = 0"),
    "c04_period_spans": (c04, f"WITH {STRIPS_SQL}, {CALENDAR_SQL}, m AS (SELECT date_trunc('month', date) AS p, min(week) AS a, max(week) AS b FROM calendar WHERE date IN (SELECT date FROM strips) GROUP BY 1) SELECT CAST(CAST(p AS DATE) AS VARCHAR) AS period, a AS first_week, coalesce(lead(a) OVER (ORDER BY p), b + 1) AS next_week FROM m"),
    "c05_adjacent": (c05, f"WITH {DOCS} SELECT CAST(date AS VARCHAR) AS date, CAST((SELECT max(x.date) FROM docs x WHERE x.date <= docs.date - 7) AS VARCHAR) AS previous, CAST((SELECT min(x.date) FROM docs x WHERE x.date >= docs.date + 7) AS VARCHAR) AS next FROM docs"),
    "c06_adjacent_same_weekday": (c06, f"WITH {DOCS} SELECT CAST(date AS VARCHAR) AS date, CAST(lag(date) OVER w AS VARCHAR) AS previous, CAST(lead(date) OVER w AS VARCHAR) AS next FROM docs WINDOW w AS (PARTITION BY dayofweek(date) ORDER BY date)"),
    "c07_collection_summary": (c07, f"WITH {RARE_SQL}, m AS (SELECT collection, count(*) AS n, min(date) AS first, max(date) AS last FROM rare GROUP BY 1) SELECT s_suppkey AS collection, s_name AS name, coalesce(n, 0) AS n, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last, CASE WHEN n IS NULL THEN 'nothing' WHEN first = last THEN monthname(first) || ' ' || day(first) || ', ' || year(first) ELSE monthname(first) || ' ' || year(first) || ' to ' || monthname(last) || ' ' || year(last) END AS coverage FROM supplier LEFT JOIN m ON collection = s_suppkey"),
    "c08_calendar_values": (c08, f"WITH {DOCS} SELECT strftime(date, '%m') AS value, count(*) AS n, CAST(2 AS BIGINT) AS depth FROM docs WHERE starts_with(CAST(month(date) AS VARCHAR), '1') GROUP BY 1 UNION ALL SELECT CAST(year(date) AS VARCHAR), count(*), 1 FROM docs WHERE year(date) < 2000 GROUP BY 1"),
    "c08_drill_down": (c08b, f"WITH {DOCS} SELECT year(date) AS year, month(date) AS month, count(*) AS n FROM docs GROUP BY ROLLUP (year(date), month(date))"),
    "c09_appearance_report": (c09, f"WITH {PRINTED_SQL}, a AS (SELECT key, collection, list_sort(list(DISTINCT page)) AS ps FROM printed GROUP BY key, collection) SELECT collection, key, 'p. ' || CASE WHEN len(ps) = 1 THEN CAST(ps[1] AS VARCHAR) WHEN ps[-1] - ps[1] = len(ps) - 1 THEN ps[1] || '-' || ps[-1] ELSE array_to_string(ps, ', ') END AS lines, s_name AS name FROM a JOIN supplier ON s_suppkey = collection"),
    "c10_unprinted": (c10, f"WITH {RARE_SQL} SELECT o_orderkey AS doc FROM orders WHERE o_orderkey NOT IN (SELECT key FROM rare)"),
    "c11_alterations": (c11, f"WITH {PRINTED_SQL} SELECT DISTINCT key AS doc, CAST(key % 25 AS VARCHAR) AS key, collection, CAST(date AS VARCHAR) AS date, CASE WHEN key % 25 = s_nationkey THEN 'altered' END AS alteration, dayofweek(date) = 0 AND collection % 2 <> 0 AS grey_sunday FROM printed JOIN supplier ON s_suppkey = collection"),
    "c12_toggle_state": (c12, "SELECT user_id, count(*) AS n, count(*) % 2 = 1 AS is_set FROM events WHERE event_type = 'click' GROUP BY user_id"),
    "c13_completion_table": (c13, f"WITH {DOCS}, v AS (SELECT 'in' AS kind, n_name AS value, lower(n_name) AS s, n_nationkey AS ord FROM nation UNION ALL SELECT DISTINCT 'year', CAST(year(date) AS VARCHAR), CAST(year(date) AS VARCHAR), year(date) FROM docs UNION ALL SELECT DISTINCT 'year', CAST(year(date) AS VARCHAR), strftime(date, '%y'), year(date) FROM docs), p AS (SELECT DISTINCT kind, value, ord, s[1:i] AS prefix FROM v, LATERAL (SELECT unnest(range(0, length(s) + 1)) AS i)) SELECT kind, prefix, row_number() OVER (PARTITION BY kind, prefix ORDER BY ord, value) AS position, value FROM p QUALIFY position <= 5"),
}
