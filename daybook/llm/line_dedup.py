"""Operator 10: drop lines that too many pages of one site share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ROW_BYTES, settle

#: A line on over this share of a site's pages is boilerplate.
RATIO = 0.05
#: A line on fewer pages than this is not shared at all, whatever its share of a tiny site.
MIN_PAGES = 2


def _keys(text: F.Column) -> F.Column:
    """Hashes of the trimmed lines that are not blank; 64 bits, within one host."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")))
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES):
    """(host, line_keys): per host the lines on more than ratio of its pages.

    A page counts a line once, however often it repeats it.  Partial sums run before each shuffle, so a
    host with a third of all pages sends one row per line and task.  A host's list holds at most
    (mean distinct lines a page) / ratio entries, whatever the number of pages.
    """
    rows = pages.select(F.col(host_col).alias("host"), F.array_distinct(_keys(F.col(text_col))).alias("keys"))
    totals = rows.groupBy("host").agg(F.count("*").alias("total"))
    counts = rows.select("host", F.explode("keys").alias("key")).groupBy("host", "key").count()
    counts = counts.where(F.col("count") >= min_pages)
    common = counts.join(totals, counts.host.eqNullSafe(totals.host)).where(
        F.col("count") > ratio * F.col("total")
    )
    return common.groupBy(counts.host.alias("host")).agg(F.collect_list("key").alias("line_keys"))


def drop_boilerplate(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """docs with boilerplate lines removed from text_col and n_dropped added; row count and other columns stay.

    Null hosts form one site of their own; null text stays null; blank lines stay; repeated rows count as
    pages each.  The small side is broadcast only if its measured size allows.  n_dropped is replaced if docs has
    one; a column of any other name is carried through untouched.
    """
    common = settle(boilerplate(docs, host_col, text_col, ratio, min_pages))
    size = common.agg(F.coalesce(F.sum(F.size("line_keys") * 8 + ROW_BYTES), F.lit(0))).first()[0]
    side = F.broadcast(common) if size <= BROADCAST_BYTES else common
    rest = F.struct(*(c for c in docs.columns if c != text_col))
    rows = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"), rest.alias("row"))
    joined = rows.join(side, rows["host"].eqNullSafe(side["host"]), "left")
    lines = F.split(F.col("text"), "\n")
    key = lambda x: F.xxhash64(F.btrim(x, F.lit(" \t\x0b\x0c\r")))
    kept = F.when(F.col("line_keys").isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.array_contains(F.col("line_keys"), key(x)))
    )
    joined = joined.select("row", "text", kept.alias("kept"))
    n_dropped = F.coalesce(F.size(lines) - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped")
    own = [F.array_join("kept", "\n").alias(text_col) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c != "n_dropped"]
    return joined.select(*own, n_dropped)


def op10(docs: DataFrame) -> DataFrame:
    return drop_boilerplate(docs.select("doc_id", "source", "text")).select(
        "doc_id", "source", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("kept_md5")
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their site's boilerplate lines; only text and n_chars change, whatever other columns there are."""
    rows = docs.select(F.col("source"), F.col("text"), F.struct(*docs.columns).alias("row"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return drop_boilerplate(rows).select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


SQL = f"""
WITH lines AS (
  SELECT doc_id, source, u.pos, u.line, trim(u.line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k
  FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line,
                                  generate_subscripts(string_split(text, chr(10)), 1) AS pos) u),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
common AS (SELECT source, k FROM lines JOIN totals USING (source) WHERE k <> ''
  GROUP BY source, k, total
  HAVING count(DISTINCT doc_id) >= {MIN_PAGES} AND count(DISTINCT doc_id) > {RATIO} * total),
marked AS (SELECT l.*, c.k IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.source = c.source AND l.k = c.k),
kept AS (SELECT doc_id, source, count(*) FILTER (gone) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS t FROM marked GROUP BY doc_id, source)
SELECT doc_id, source, CAST(n_dropped AS BIGINT) AS n_dropped, CAST(length(t) AS BIGINT) AS n_chars_kept, md5(t) AS kept_md5
FROM kept
"""
