"""Filters, filter texts and date expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import calendars as K
from ..operators import evaluate as E
from ..operators import filters as L
from ..tables import dealt
from .bindings import CALENDAR_SQL, END, GAPS, START, STRIPS_SQL, flat, printed, printed_rows, strips, table

SPAN_ORDERS = (1995, 2001)


def orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("t").alias("transcript"), F.lit(None).cast("string").alias("description"))


def keys(df):
    return flat(df.select("doc", "date"))


def f(fn):
    return lambda spark, d: keys(fn(orders(spark, d)))


def bridge(spark, d):
    return printed(spark, d).select(F.col("key").alias("doc"), F.col("collection").cast("string").alias("collection"))


def f06(spark, d):
    return keys(L.filter_collections(orders(spark, d), bridge(spark, d), ["1", "3"]))


def f07(spark, d):
    wanted = table(spark, d, "part").select((F.col("p_partkey") % 2000).cast("string").alias("collection")).distinct()
    return flat(L.validate_collections(wanted, bridge(spark, d).select("collection").distinct()))


def order_days(spark):
    return K.calendar(spark, "1995-01-01", "2001-12-31")


def f08(spark, d):
    key = F.col("r_regionkey")
    e = table(spark, d, "region").where("r_regionkey < 2").select(F.when(key == 0, "august 1996").otherwise("1998-02-03").alias("t"))
    return keys(L.filter_windows(orders(spark, d), order_days(spark), D.parse_dates(e, "t", SPAN_ORDERS, "filter")))


def f11(spark, d):
    c = F.array(F.struct(F.year("date").alias("year"), F.when(F.col("doc") % 3 > 0, F.month("date")).alias("month"), F.when(F.col("doc") % 3 > 1, F.dayofmonth("date")).alias("day"), F.when(F.col("doc") % 7 == 0, F.lit(0)).alias("weekday")))
    return flat(orders(spark, d).select("doc", D.span_bounds(c).alias("b")).select("doc", "b.first", "b.last"))


SPEC = L.Spec(years=(1995, 1996), months=(2, 8), daily=True, after=("1995-02-10", "1995-03-01"), windows=({"weekday": 1}, {"day": 14}))


def f13(spark, d):
    return keys(L.apply_filters(orders(spark, d), SPEC))


def f14(spark, d):
    one = printed(spark, d).groupBy("key", "collection").agg((F.count("*") * 1.0).alias("n"), F.first("date").alias("date"))
    one = dealt(one, printed_rows(spark, d), "collection")
    share = one.withColumn("share", F.col("n") / F.sum("n").over(L.Window.partitionBy("collection")))
    return flat(L.apply_filters(share.withColumn("transcript", F.lit("t")), L.Spec(months=(2,))).select("key", "collection", "share"))


def f15(spark, d):
    return flat(L.filter_only(orders(spark, d), L.Spec(weekdays=(0,), empty=True)).select("doc", "score", "source", "text"))


def log(spark, d):
    """A log of query texts with filters, one an order."""
    o = orders(spark, d)
    k, date = F.col("doc"), F.col("date")
    text = (
        F.when(k % 8 == 0, F.concat(F.lit("snow @year:"), F.date_format(date, "yy"), F.lit(" man")))
        .when(k % 8 == 1, F.concat(F.lit("@Sunday @month:"), F.lower(F.date_format(date, "MMM")), F.lit(" @nope:@year:1996 end")))
        .when(k % 8 == 2, F.concat(F.lit("@after:"), F.date_format(date, "yyyy-MM"), F.lit(" @before:"), F.date_format(date, "yyyy")))
        .when(k % 8 == 3, F.concat(F.lit("a  @day:"), F.dayofmonth(date), F.lit(" @day:saturday  b ")))
        .when(k % 8 == 4, F.lit("@month:13 x"))
        .when(k % 8 == 5, F.concat(F.lit("@daily @date:"), F.date_format(date, "yyyyMMdd"), F.lit(" @empty")))
        .when(k % 8 == 6, F.lit("plain words"))
        .otherwise(F.concat(F.lit("@in:"), k % 10, F.lit(" @sunday:yes")))
    )
    return o.select(k.alias("query_id"), "date", text.alias("query"))


def found(spark, d):
    return L.extract_filters(log(spark, d).drop("date"), SPAN_ORDERS)


def f16(spark, d):
    return flat(found(spark, d).select("query_id", "start", "end", "name", "value", "valid"))


def f17(spark, d):
    q = log(spark, d).drop("date")
    return flat(L.residual(q, L.extract_filters(q, SPAN_ORDERS)).select("query_id", "residual", F.size("segments").alias("n")))


def f18(spark, d):
    return flat(L.fold_filters(found(spark, d)))


def f19(spark, d):
    return flat(L.canonical_filters(found(spark, d)))


def texts(spark, d):
    """Date texts in eight spellings, one an order."""
    k, date = F.col("doc"), F.col("date")
    forms = ("MMMM d yyyy", "M/d/yy", "yyyy-MM", "yyyy", "yyyyMMdd", "EEEE MMM d, yyyy", "MMM yy", "d.M.yyyy")
    text = F.lit("no date here")
    for i, form in enumerate(forms):
        text = F.when(k % 9 == i, F.date_format(date, form)).otherwise(text)
    return orders(spark, d).select("doc", "date", text.alias("t"))


def parsed(spark, d):
    return D.parse_dates(texts(spark, d), "t", SPAN_ORDERS)


def d01(spark, d):
    return flat(parsed(spark, d).select("doc", F.size("candidates").alias("n"), "precision"))


def d02(spark, d):
    return flat(parsed(spark, d).select("doc", F.explode("candidates").alias("c")).select("doc", "c.year", "c.month", "c.day"))


def d03(spark, d):
    c = orders(spark, d).select((F.col("doc") % 500).alias("k"), F.year("date").alias("y"), F.month("date").alias("m")).groupBy("k").agg(F.min(F.struct("y", "m")).alias("x"))
    c = c.select("k", F.array(F.struct(F.col("x.y").alias("year"), F.col("x.m").alias("month"), F.lit(None).cast("int").alias("day"), (F.col("k") % 7).cast("int").alias("weekday"))).alias("candidates"))
    return flat(L.match_dates(order_days(spark), c, "k"))


def d04(spark, d):
    v = (F.col("o_orderkey") % 100).cast("int")
    return flat(table(spark, d, "orders").select("o_orderkey", D.resolve_year(v, F.lit(2), SPAN_ORDERS, "query").alias("y"), D.resolve_year(v, F.lit(2), SPAN_ORDERS, "filter").alias("z")))


def d05(spark, d):
    o = F.col("o_orderkey")
    return flat(table(spark, d, "orders").select("o_orderkey", D.real_date(1995 + o % 6, o % 12 + 1, o % 31 + 1).alias("date")))


def d06(spark, d):
    """Each date with its own weekday and with Sunday, right or wrong."""
    o, kept = orders(spark, d), lambda t: D.parse_dates(t, "t", SPAN_ORDERS).select("doc", F.greatest(F.coalesce(F.size("candidates"), F.lit(0)), F.lit(0)).alias("n"))
    right = kept(o.select("doc", F.date_format("date", "EEEE MMM d, yyyy").alias("t")))
    sunday = kept(o.select("doc", F.concat(F.lit("sunday "), F.date_format("date", "MMM d, yyyy")).alias("t"))).withColumnRenamed("n", "m")
    return flat(right.join(sunday, "doc"))


def d08(spark, d):
    return flat(parsed(spark, d).where("precision is not null").select("doc", F.coalesce(*(F.when(F.col("precision") == k, F.lit(v)) for k, v in D.STRENGTH.items())).alias("strength")))


def d09(spark, d):
    one = printed(spark, d).groupBy(F.col("collection").alias("query_id"), F.col("key").alias("doc")).agg((F.count("*") / 10).alias("score"), F.first("date").alias("date")).withColumn("source", F.lit("transcript"))
    strong = one.where(F.month("date") == 2).select((F.col("query_id") % 7 + 1).alias("query_id"), "doc").distinct().withColumn("strength", F.lit(1.5))
    own = lambda df: dealt(df, printed_rows(spark, d), "query_id", "doc")
    return flat(L.with_date_matches(own(one.select("query_id", "doc", "score", "source")), own(strong)))


def d10(spark, d):
    return flat(strips(spark, d).select("doc", F.md5(L.date_text(F.col("transcript"), F.col("description"))).alias("hash")))


def e26(spark, d):
    p = parsed(spark, d).where("candidates is not null").select((F.col("t")).alias("k"), "candidates").dropDuplicates(["k"])
    return flat(E.reach(order_days(spark), p, "k"))


def c01(spark, d):
    return flat(K.calendar(spark, START, END, GAPS).join(strips(spark, d).select("date").distinct(), "date", "left_semi"))


O = "SELECT o_orderkey AS doc, CAST(o_orderdate AS DATE) AS date FROM orders"
OUT = f"WITH o AS ({O}) SELECT doc, CAST(date AS VARCHAR) AS date FROM o WHERE "
LOG = f"""WITH o AS ({O}), log AS (SELECT doc AS query_id, date, CASE doc % 8
 WHEN 0 THEN 'snow @year:' || strftime(date, '%y') || ' man' WHEN 1 THEN '@Sunday @month:' || lower(strftime(date, '%b')) || ' @nope:@year:1996 end'
 WHEN 2 THEN '@after:' || strftime(date, '%Y-%m') || ' @before:' || year(date) WHEN 3 THEN 'a  @day:' || day(date) || ' @day:saturday  b ' WHEN 4 THEN '@month:13 x'
 WHEN 5 THEN '@daily @date:' || strftime(date, '%Y%m%d') || ' @empty' WHEN 6 THEN 'plain words' ELSE '@in:' || doc % 10 || ' @sunday:yes' END AS query FROM o)"""
AMB = "day(date) <= 12 AND month(date) <> day(date)"

PLANS = {
    "f01_years": (f(lambda o: L.filter_years(o, [1995, 1998])), OUT + "year(date) IN (1995, 1998)"),
    "f02_months": (f(lambda o: L.filter_months(o, [2, 8])), OUT + "month(date) IN (2, 8)"),
    "f03_month_days": (f(lambda o: L.filter_month_days(o, [1, 31])), OUT + "day(date) IN (1, 31)"),
    "f04_weekdays": (f(lambda o: L.filter_weekdays(o, [0, 6])), OUT + "dayofweek(date) IN (0, 6)"),
    "f05_format": (f(lambda o: L.filter_format(o, False, True)), OUT + "dayofweek(date) BETWEEN 1 AND 6"),
    "f06_collections": (f06, OUT + "doc IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (1, 3))"),
    "f07_unknown_collections": (f07, "SELECT DISTINCT CAST(p_partkey % 2000 AS VARCHAR) AS collection FROM part WHERE p_partkey % 2000 NOT IN (SELECT l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"),
    "f08_windows": (f08, OUT + "(year(date) = 1996 AND month(date) = 8) OR date = DATE '1998-02-03'"),
    "f09_after": (f(lambda o: L.filter_after(o, ["1997-05-31", "1996-12-31"])), OUT + "date > DATE '1996-12-31'"),
    "f10_before": (f(lambda o: L.filter_before(o, ["1997-05-01", "1996-01-01"])), OUT + "date < DATE '1997-05-01'"),
    "f11_span_bounds": (f11, f"WITH o AS ({O}) SELECT doc, CASE WHEN doc % 7 <> 0 THEN CAST(CASE doc % 3 WHEN 0 THEN date_trunc('year', date) WHEN 1 THEN date_trunc('month', date) ELSE date END AS DATE)::VARCHAR END AS first, CASE WHEN doc % 7 <> 0 THEN CAST(CASE doc % 3 WHEN 0 THEN make_date(year(date), 12, 31) WHEN 1 THEN last_day(date) ELSE date END AS DATE)::VARCHAR END AS last FROM o"),
    "f12_empty": (f(L.filter_empty), OUT + "doc % 5 = 0"),
    "f13_conjunction": (f13, OUT + "year(date) IN (1995, 1996) AND month(date) IN (2, 8) AND dayofweek(date) > 0 AND date > DATE '1995-02-10' AND (dayofweek(date) = 1 OR day(date) = 14)"),
    "f14_filter_after_scoring": (f14, "WITH p AS (SELECT l_orderkey AS key, l_suppkey AS collection, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3), s AS (SELECT *, n / sum(n) OVER (PARTITION BY collection) AS share FROM p) SELECT key, collection, round(share, 6) AS share FROM s WHERE month(date) = 2"),
    "f15_filter_only": (f15, f"WITH o AS ({O}) SELECT doc, 0.8::DOUBLE AS score, 'filter' AS source, '' AS text FROM o WHERE dayofweek(date) = 0 AND doc % 5 = 0"),
    "f16_extract_filters": (f16, LOG + """, m AS (
 SELECT query_id, 'year' AS name, strftime(date, '%y') AS value, 5 AS start, TRUE AS valid FROM log WHERE query_id % 8 = 0
 UNION ALL SELECT query_id, 'sunday', NULL, 0, TRUE FROM log WHERE query_id % 8 = 1 UNION ALL SELECT query_id, 'month', lower(strftime(date, '%b')), 8, TRUE FROM log WHERE query_id % 8 = 1
 UNION ALL SELECT query_id, 'after', strftime(date, '%Y-%m'), 0, TRUE FROM log WHERE query_id % 8 = 2 UNION ALL SELECT query_id, 'before', CAST(year(date) AS VARCHAR), 15, TRUE FROM log WHERE query_id % 8 = 2
 UNION ALL SELECT query_id, 'day', CAST(day(date) AS VARCHAR), 3, TRUE FROM log WHERE query_id % 8 = 3 UNION ALL SELECT query_id, 'day', 'saturday', 9 + length(CAST(day(date) AS VARCHAR)), TRUE FROM log WHERE query_id % 8 = 3
 UNION ALL SELECT query_id, 'month', '13', 0, FALSE FROM log WHERE query_id % 8 = 4
 UNION ALL SELECT query_id, 'daily', NULL, 0, TRUE FROM log WHERE query_id % 8 = 5 UNION ALL SELECT query_id, 'date', strftime(date, '%Y%m%d'), 7, TRUE FROM log WHERE query_id % 8 = 5 UNION ALL SELECT query_id, 'empty', NULL, 22, TRUE FROM log WHERE query_id % 8 = 5
 UNION ALL SELECT query_id, 'in', CAST(query_id % 10 AS VARCHAR), 0, TRUE FROM log WHERE query_id % 8 = 7 UNION ALL SELECT query_id, 'sunday', 'yes', 6, FALSE FROM log WHERE query_id % 8 = 7)
 SELECT query_id, CAST(start AS BIGINT) AS start, CAST(start + 1 + length(name) + coalesce(1 + length(value), 0) AS BIGINT) AS "end", name, value, valid FROM m"""),
    "f17_residual": (f17, LOG + " SELECT query_id, CASE query_id % 8 WHEN 0 THEN 'snow man' WHEN 1 THEN '@nope:@year:1996 end' WHEN 3 THEN 'a b' WHEN 4 THEN 'x' WHEN 6 THEN 'plain words' ELSE '' END AS residual, CAST(CASE query_id % 8 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 1 WHEN 6 THEN 1 ELSE 0 END AS BIGINT) AS n FROM log"),
    "f18_fold_filters": (f18, LOG + """ SELECT query_id, CASE WHEN query_id % 8 = 0 THEN CAST(year(date) AS VARCHAR) ELSE '' END AS years, CASE WHEN query_id % 8 = 1 THEN CAST(month(date) AS VARCHAR) ELSE '' END AS months,
 CASE WHEN query_id % 8 = 3 THEN CAST(day(date) AS VARCHAR) ELSE '' END AS month_days, CASE query_id % 8 WHEN 1 THEN '0' WHEN 3 THEN '6' WHEN 5 THEN '1,2,3,4,5,6' WHEN 7 THEN '0' ELSE '' END AS weekdays,
 CASE WHEN query_id % 8 = 7 THEN CAST(query_id % 10 AS VARCHAR) ELSE '' END AS collections, CASE WHEN query_id % 8 = 2 THEN CAST(last_day(date) AS VARCHAR) END AS after, CASE WHEN query_id % 8 = 2 THEN year(date) || '-01-01' END AS before,
 query_id % 8 = 5 AS empty, query_id % 8 IN (4, 7) AS impossible FROM log WHERE query_id % 8 <> 6"""),
    "f19_canonical_filters": (f19, LOG + """ SELECT query_id, '@year:' || year(date) AS token FROM log WHERE query_id % 8 = 0 UNION ALL SELECT query_id, '@sunday' FROM log WHERE query_id % 8 = 1
 UNION ALL SELECT query_id, '@month:' || lower(monthname(date)) FROM log WHERE query_id % 8 = 1 UNION ALL SELECT query_id, '@day:' || day(date) FROM log WHERE query_id % 8 = 3
 UNION ALL SELECT query_id, '@daily' FROM log WHERE query_id % 8 = 5 UNION ALL SELECT query_id, '@in:' || query_id % 10 FROM log WHERE query_id % 8 = 7"""),
    "d01_date_texts": (d01, f"WITH o AS ({O}) SELECT doc, CAST(CASE WHEN doc % 9 IN (1, 7) AND {AMB} THEN 2 WHEN doc % 9 = 8 THEN NULL ELSE 1 END AS BIGINT) AS n, CASE WHEN doc % 9 = 8 THEN NULL WHEN doc % 9 = 3 THEN 'broad' WHEN doc % 9 IN (2, 6) THEN 'narrow' ELSE 'exact' END AS precision FROM o"),
    "d02_date_candidates": (d02, f"WITH o AS ({O}), a AS (SELECT doc, year(date) AS year, CASE WHEN doc % 9 <> 3 THEN month(date) END AS month, CASE WHEN doc % 9 NOT IN (2, 3, 6) THEN day(date) END AS day FROM o WHERE doc % 9 <> 8) SELECT * FROM a UNION ALL SELECT doc, year(date), day(date), month(date) FROM o WHERE doc % 9 IN (1, 7) AND {AMB}"),
    "d03_match_dates": (d03, f"WITH o AS ({O}), c AS (SELECT doc % 500 AS k, min(year(date) * 100 + month(date)) AS ym FROM o GROUP BY 1), days AS (SELECT CAST(g AS DATE) AS date FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) t(g)) SELECT k, CAST(date AS VARCHAR) AS date FROM c JOIN days ON year(date) * 100 + month(date) = ym AND dayofweek(date) = k % 7"),
    "d04_two_digit_years": (d04, "SELECT o_orderkey, CASE WHEN v >= 95 THEN 1900 + v WHEN v <= 1 THEN 2000 + v END AS y, CASE WHEN v <= 1 THEN 2000 + v ELSE 1900 + v END AS z FROM (SELECT o_orderkey, o_orderkey % 100 AS v FROM orders)"),
    "d05_real_dates": (d05, "SELECT o_orderkey, CAST(try_cast(printf('%04d-%02d-%02d', 1995 + o_orderkey % 6, o_orderkey % 12 + 1, o_orderkey % 31 + 1) AS DATE) AS VARCHAR) AS date FROM orders"),
    "d06_weekday_agreement": (d06, f"WITH o AS ({O}) SELECT doc, CAST(1 AS BIGINT) AS n, CAST(CASE WHEN dayofweek(date) = 0 THEN 1 ELSE 0 END AS BIGINT) AS m FROM o"),
    "d07_precision": (lambda s, d: flat(parsed(s, d).where("candidates is not null").groupBy("precision").agg(F.count("*").alias("n"))), f"WITH o AS ({O}) SELECT CASE WHEN doc % 9 = 3 THEN 'broad' WHEN doc % 9 IN (2, 6) THEN 'narrow' ELSE 'exact' END AS precision, count(*) AS n FROM o WHERE doc % 9 <> 8 GROUP BY 1"),
    "d08_strength": (d08, f"WITH o AS ({O}) SELECT doc, CASE WHEN doc % 9 = 3 THEN 0.8::DOUBLE WHEN doc % 9 IN (2, 6) THEN 1.5 ELSE 3.0 END AS strength FROM o WHERE doc % 9 <> 8"),
    "d09_date_union": (d09, "WITH p AS (SELECT l_suppkey AS query_id, l_orderkey AS doc, count(*) / 10 AS score, min(CAST(o_orderdate AS DATE)) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), m AS (SELECT DISTINCT query_id % 7 + 1 AS query_id, doc, 1.5::DOUBLE AS strength FROM p WHERE month(date) = 2) SELECT query_id, doc, round(CASE WHEN score IS NULL THEN strength WHEN strength IS NULL THEN score ELSE greatest(score, strength) + 0.15 * least(score, strength) END, 6) AS score, CASE WHEN score IS NULL THEN 'date' ELSE 'transcript' END AS source FROM p FULL JOIN m USING (query_id, doc)"),
    "d10_date_text": (d10, f"WITH {STRIPS_SQL} SELECT doc, md5(coalesce(nullif(transcript, ''), nullif(description, ''), '')) AS hash FROM strips"),
    "e26_reach": (e26, f"""WITH o AS ({O}), f AS (SELECT CASE doc % 9 WHEN 0 THEN strftime(date, '%B') || ' ' || day(date) || ' ' || year(date) WHEN 1 THEN month(date) || '/' || day(date) || '/' || strftime(date, '%y') WHEN 2 THEN strftime(date, '%Y-%m')
 WHEN 3 THEN strftime(date, '%Y') WHEN 4 THEN strftime(date, '%Y%m%d') WHEN 5 THEN strftime(date, '%A %b ') || day(date) || ', ' || year(date) WHEN 6 THEN strftime(date, '%b %y') ELSE day(date) || '.' || month(date) || '.' || year(date) END AS k,
 CASE WHEN doc % 9 IN (1, 7) AND {AMB} THEN 2 WHEN doc % 9 IN (2, 6) THEN day(last_day(date)) WHEN doc % 9 = 3 THEN 337 + day(last_day(make_date(year(date), 2, 1))) ELSE 1 END AS n FROM o WHERE doc % 9 <> 8)
 SELECT DISTINCT k, CAST(n AS BIGINT) AS n FROM f"""),
    "c01_calendar": (c01, f"WITH {STRIPS_SQL}, {CALENDAR_SQL} SELECT CAST(date AS VARCHAR) AS date, week, weekday, state FROM calendar WHERE date IN (SELECT date FROM strips)"),
}
