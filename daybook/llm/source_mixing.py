"""Operator 13: mix sources to target weights by whole repetitions and one hash-seeded draw a document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fit, settle

#: Weights dealt to the sources in order, again and again; the mix's size and a source's largest repetition, of what there is.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Hex digits of MD5 that make a draw between 0 and 1: 52 bits, which a double holds exactly.
DIGITS = 13


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE[1:]}")), F.lit(0)).cast("long")


def draw(seed: Column) -> Column:
    """A number from 0 up to 1 that only the seed decides."""
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, DIGITS), 16, 10).cast("long") / F.lit(float(1 << 4 * DIGITS))


def placed(keys: DataFrame, col: str) -> DataFrame:
    """keys with place: the number, from 0, of each row in the order of col, null last.  Rows are ranged, sorted within
    their ranges and numbered there; only the ranges' sizes, one row each, meet in one task."""
    order = F.asc_nulls_last(col)
    rows = settle(keys.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    sizes = rows.groupBy(part).agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rows = rows.withColumn("part", part).join(fit(sizes), "part")
    return rows.withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "before")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target, rate) for sizes(source, source_size).

    weights go to the sources in the order of their names, null last, over and over.  A target is level * weight, at most most times
    its source's size, with the level at which all targets add up to share times all sizes: a round gives what the full sources
    leave to the others by weight, until no other is full; each round is one sum over the table.  A
    source without words has target and rate 0; where share is most or more, all are full.
    """
    dealt = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    rows = settle(placed(sizes, "source").select("source", "source_size", dealt.alias("weight"), (most * F.col("source_size")).alias("cap")))
    whole = share * float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, before = 0.0, -1.0
    while level > before:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        taken, rest = rows.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        before, level = level, (whole - (taken or 0.0)) / rest if rest else float("inf")
    rows = rows.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return rows.select("source", "source_size", "weight", "target", rate.alias("rate"))


def _seed(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))


def _copies(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows(source, draw, ...) with source_size, target, rate and copies: floor(rate), and one more where draw is below the rest."""
    side = fit(wanted.select(F.col("source").alias("of"), "source_size", "target", "rate"), 128)
    whole = F.floor("rate")
    copies = whole + (F.col("draw") < F.col("rate") - whole).cast("long")
    return rows.join(side, rows["source"].eqNullSafe(side["of"])).drop("of").withColumn("copies", copies)


def repetitions(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies) per row of docs.

    copies is floor(rate) and one more where the id's draw is below the fraction, so most at most (a whole number).
    Null text has size 0; null sources are one source, the last; a row without an id is drawn by its text; repeated rows are
    drawn alike, so reruns and retried tasks agree; extra columns are ignored; an empty table gives an empty result.
    Texts are read once: sizes and draws are written, and a source's sizes are added up before any shuffle.
    """
    read = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), draw(_seed(id_col, text_col)).alias("draw")
    )
    rows = settle(read)
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    return _copies(rows, wanted).select("id", "source", "size", "source_size", "target", "rate", "copies")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """The mix itself: each row of docs once per copy, with the copy's number from 1 in column copy (replaced if docs has one).

    The same copies as repetitions has.  Texts are not shuffled while the sources fit a counted broadcast; beyond it Spark joins
    by source and splits the hot ones."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_of(F.col(text_col))).alias("source_size"))
    row = F.struct(*(c for c in docs.columns if c != "copy")).alias("row")
    rows = docs.select(F.col(source_col).alias("source"), draw(_seed(id_col, text_col)).alias("draw"), row)
    taken = _copies(rows, targets(sizes, weights, share, most)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*", "copy")


def op13(docs: DataFrame) -> DataFrame:
    return repetitions(docs).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", "copies"
    )


SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, {DIGITS}) AS BIGINT) AS DOUBLE) / {float(1 << 4 * DIGITS)} AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([{", ".join(map(str, WEIGHTS))}][1 + place % {len(WEIGHTS)}] AS DOUBLE) AS weight,
  CAST({MOST} AS DOUBLE) * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS rn FROM w),
l AS (SELECT rn, cap, weight, (CAST({SHARE} AS DOUBLE) * (SELECT sum(source_size) FROM w)
    - coalesce(sum(cap) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
level AS (SELECT min_by(level, rn) AS level FROM l WHERE cap > level * weight),
t AS (SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap ELSE level * weight END AS target FROM w, level),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
c AS (SELECT d.*, source_size, target, rate, CAST(floor(rate) AS BIGINT) + CAST(draw < rate - floor(rate) AS BIGINT) AS copies
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken, source, rate, copies FROM c
"""
