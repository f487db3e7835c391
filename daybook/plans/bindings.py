"""How archive concepts map to the given tables, as DataFrames and as the SQL that oracles start from."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import index as I
from ..tables import dealt, forget_at_end, shared_dir

START, END = "1985-11-18", "1995-12-31"
SPAN = (1985, 1995)
GAPS = [("1991-05-05", "1992-02-01"), ("1994-04-03", "1994-12-31")]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def strips(spark: SparkSession, d: str) -> DataFrame:
    """doc, date, transcript, description and alternate: documents with the conversation of their number, what the assistant
    says as alternate transcript and all the other turns as description, each in the order of turns."""
    turn = F.struct("turn", "text")
    said = lambda mine: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(mine, turn))), lambda x: x["text"]), "\n")
    assistant = F.col("role") == "assistant"
    talk = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(
        F.nullif(said(~assistant), F.lit("")).alias("description"), F.nullif(said(assistant), F.lit("")).alias("alternate")
    )
    docs = table(spark, d, "documents")
    date = F.date_add(F.lit(START).cast("date"), (F.col("doc_id") % 3696).cast("int"))
    own = docs.select(F.col("doc_id").alias("doc"), date.alias("date"), F.coalesce("text", F.lit("")).alias("transcript"))
    return own.join(talk, "doc", "left").withColumn("id", F.lit(None).cast("string"))


def stored(spark: SparkSession, d: str) -> I.Index:
    """The index of the strips of d, built by the first search of an application and opened by its path by the others."""
    path = f"{shared_dir(spark)}/daybook-index-{spark.sparkContext.applicationId}-{hashlib.md5(d.encode()).hexdigest()}"
    forget_at_end(spark, path)
    return I.stored(strips(spark, d), path)


def asked(spark: SparkSession, d: str) -> DataFrame:
    """query_id, query: the benchmark's texts, whole."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def printed_rows(spark: SparkSession, d: str) -> int:
    return table(spark, d, "lineitem").count()


def printed(spark: SparkSession, d: str) -> DataFrame:
    """key, collection, page, date, flag, quantity: an order line stands for a document printed on a page of a supplier's book.

    Dealt by key into tasks of counted size, which groups by key and more columns keep."""
    named = {"key": "l_orderkey", "collection": "l_suppkey", "page": "l_linenumber", "flag": "l_returnflag", "quantity": "l_quantity"}
    lines = table(spark, d, "lineitem").select(*(F.col(c).alias(n) for n, c in named.items()))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("date"))
    n = printed_rows(spark, d)
    return dealt(lines, n, "key").join(dealt(orders, n, "key"), "key")


def rare(spark: SparkSession, d: str) -> DataFrame:
    """Printed lines that were returned in full quantity: for operators about books that lack something, as some books have none."""
    return printed(spark, d).where("flag = 'R' and quantity >= 50")


def flat(df: DataFrame) -> DataFrame:
    """Integers as bigint, dates as text, doubles rounded to six places, arrays joined: values that hash alike everywhere."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


STRIPS_SQL = f"""
talk AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (role <> 'assistant') AS description,
  string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant') AS alternate FROM conversations GROUP BY conv_id),
strips AS (
  SELECT d.doc_id AS doc, CAST(DATE '{START}' + CAST(d.doc_id % 3696 AS INTEGER) AS DATE) AS date, coalesce(d.text, '') AS transcript,
         t.description, t.alternate
  FROM documents d LEFT JOIN talk t ON t.conv_id = d.doc_id)"""
FIELDS_SQL = (
    STRIPS_SQL
    + """,
fields AS (
  SELECT doc, 'transcript' AS corpus, 'transcript' AS field, transcript AS text FROM strips
  UNION ALL SELECT doc, 'transcript', 'alternate', alternate FROM strips WHERE alternate <> ''
  UNION ALL SELECT doc, 'description', 'description', description FROM strips WHERE description <> '')"""
)
WORD_SQL = r"[\p{L}\p{N}'']+"
POSTS_SQL = (
    FIELDS_SQL
    + f""",
split AS (SELECT doc, corpus, field, regexp_extract_all(lower(text), '{WORD_SQL}') AS ws FROM fields),
posts AS (SELECT doc, corpus, field, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM split)"""
)
VOCAB_SQL = (
    POSTS_SQL
    + """,
ndocs AS (SELECT corpus, count(DISTINCT doc) AS n_docs FROM fields GROUP BY corpus),
vocab AS (SELECT corpus, word, df, n_docs, greatest(0, ln(n_docs / df)) AS idf
  FROM (SELECT corpus, word, count(DISTINCT doc) AS df FROM posts GROUP BY corpus, word) JOIN ndocs USING (corpus))"""
)
ASKED_SQL = f"""
asked AS (SELECT item_id AS query_id, text AS query, regexp_extract_all(lower(text), '{WORD_SQL}') AS ws FROM benchmark)"""
PRINTED_SQL = """
printed AS (SELECT l_orderkey AS key, l_suppkey AS collection, l_linenumber AS page, CAST(o_orderdate AS DATE) AS date, l_returnflag AS flag, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
RARE_SQL = PRINTED_SQL + ", rare AS (SELECT * FROM printed WHERE flag = 'R' AND quantity >= 50)"
CALENDAR_SQL = f"""
days AS (SELECT CAST(g AS DATE) AS date FROM generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY) t(g)),
calendar AS (SELECT date, CAST(floor((date - (DATE '{START}' - CAST(isodow(DATE '{START}') - 1 AS INTEGER))) / 7) AS BIGINT) AS week,
  CAST(dayofweek(date) AS BIGINT) AS weekday,
  CASE WHEN {' OR '.join(f"date BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in GAPS)} THEN 'gap' ELSE 'strip' END AS state FROM days)"""
SOUNDS = "CASE WHEN {0} = '' THEN '' ELSE list_reduce(list_prepend('', string_split({0}, '')), lambda s, c: s || CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') OR (c = 'y' AND ends_with(s, 'c')) THEN 'v' ELSE 'c' END) END"
#: The stem of every word of forms(w), ending by ending.
STEMS = f"""
st1 AS (SELECT w, CASE WHEN ends_with(w, chr(39) || 's') THEN left(w, length(w) - 2) WHEN ends_with(w, chr(39)) THEN left(w, length(w) - 1) ELSE w END AS o FROM forms),
st2 AS (SELECT w, CASE WHEN ends_with(o, 'ies') OR regexp_matches(o, '(x|z|ch|sh|ss)es$') THEN left(o, length(o) - 2) WHEN NOT ends_with(o, 's') OR regexp_matches(o, '(ss|us|is)$') THEN o ELSE left(o, length(o) - 1) END AS p FROM st1),
st3 AS (SELECT w, p, {SOUNDS.format("p")} AS s, CASE WHEN ends_with(p, 'eed') THEN NULL WHEN ends_with(p, 'ed') THEN 2 WHEN ends_with(p, 'ing') THEN 3 END AS k FROM st2),
st4 AS (SELECT w, p, s, left(p, length(p) - k) AS b, left(s, length(p) - k) AS z FROM st3),
st5 AS (SELECT w, CASE WHEN ends_with(p, 'eed') THEN CASE WHEN regexp_matches(left(s, length(p) - 3), 'v+c') THEN left(p, length(p) - 1) ELSE p END
  WHEN z IS NULL OR NOT contains(z, 'v') THEN p WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
  WHEN length(b) > 1 AND right(b, 1) = left(right(b, 2), 1) AND ends_with(z, 'c') AND right(b, 1) NOT IN ('l', 's', 'z') THEN left(b, length(b) - 1)
  WHEN len(regexp_extract_all(z, 'v+c+')) = 1 AND ends_with(z, 'cvc') AND right(b, 1) NOT IN ('w', 'x', 'y') THEN b || 'e' ELSE b END AS t FROM st4),
st6 AS (SELECT w, t, {SOUNDS.format("t")} AS u FROM st5),
stems AS (SELECT w, CASE WHEN ends_with(t, 'y') AND contains(left(u, length(t) - 1), 'v') THEN left(t, length(t) - 1) || 'i' ELSE t END AS stem FROM st6)"""
