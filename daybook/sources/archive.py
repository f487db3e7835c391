"""Archive tables: documents, appearances, collections, descriptions, labels and their sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STRIPS = "id string, date date, transcript string, alternate string, image string, sort int, aspect_ratio double"
LABELS = "id string, query string, date date, class string, corruption string, decoy date, status string, reason string, source string"
DESCRIPTIONS = "key string, text string"
CLASSES = ("A", "B", "C", "D", "E")
STATUSES = ("validated", "draft", "ambiguous", "rejected")


def compact(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd")


def from_compact(text: Column) -> Column:
    return F.try_to_date(text, "yyyyMMdd")


def load_strips(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Documents under a fixed schema; an entry that is a bare text is its transcript, a missing one is empty."""
    df = spark.read.format(fmt).schema(STRIPS + ", value string").load(path)
    return df.withColumn("transcript", F.coalesce("transcript", "value", F.lit(""))).drop("value")


def unify_strips(dailies: DataFrame, specials: DataFrame) -> DataFrame:
    """Dailies (key yyyyMMdd) and specials (own id and date) in one table; dailies have no id."""
    daily = dailies.withColumn("date", from_compact(F.col("key"))).withColumn("id", F.lit(None).cast("string")).drop("key")
    return daily.unionByName(specials, allowMissingColumns=True)


def archive_order(df: DataFrame) -> DataFrame:
    return df.orderBy("date", F.coalesce("sort", F.lit(0)), F.coalesce("id", F.lit("")))


def attach_asset(df: DataFrame, listing: DataFrame, stem: str, extensions: list[str]) -> DataFrame:
    """The file of the earliest listed extension with the row's stem; null if there is none."""
    known = F.array(*map(F.lit, extensions))
    rank = F.array_position(known, F.regexp_extract("path", "\\.([^./]+)$", 1))
    files = listing.select(F.regexp_extract("path", "([^/]+)\\.[^./]+$", 1).alias("_stem"), "path", rank.alias("_rank"))
    best = files.where("_rank > 0").groupBy("_stem").agg(F.min_by("path", "_rank").alias("image"))
    return df.drop("image").join(best, df[stem] == best["_stem"], "left").drop("_stem")


def explode_page_index(pages: DataFrame, editions: DataFrame | None = None) -> DataFrame:
    """(collection, edition, volume, page, key) from pages map<page, keys> and from editions -> volumes -> pages."""
    flat = pages.select(
        "collection", F.lit(None).cast("string").alias("edition"), F.lit(None).cast("int").alias("volume"), F.explode("pages").alias("page", "keys")
    )
    if editions is not None:
        flat = flat.unionByName(
            editions.select("collection", F.explode("editions").alias("edition", "volumes"))
            .select("collection", "edition", F.explode("volumes").alias("volume", "pages"))
            .select("collection", "edition", "volume", F.explode("pages").alias("page", "keys"))
        )
    return flat.select("collection", "edition", "volume", "page", F.explode("keys").alias("key"))


def build_appearances(exploded: DataFrame) -> DataFrame:
    """One row per document and book (edition, volume), with its sorted pages."""
    keys = ["key", "collection", "edition", "volume"]
    return exploded.groupBy(*keys).agg(F.array_sort(F.collect_set("page")).alias("pages"))


def attach_appearances(df: DataFrame, appearances: DataFrame, key: str) -> DataFrame:
    """Appearances as an array of structs, null where there are none."""
    row = F.struct("collection", "edition", "volume", "pages")
    own = appearances.groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.collect_list(row)).alias("appearances"))
    same = df[key] if df.schema[key].dataType == own.schema["_key"].dataType else df[key].cast("string")  # a key that is not cast stays dealt as it is
    return df.join(own, same == own["_key"], "left").drop("_key")


def date_ranges(dates: DataFrame, by: str = "collection") -> DataFrame:
    """Runs of consecutive days per collection, as "yyyymmdd-yyyymmdd" or one day; dates(by, date) may repeat."""
    own = Window.partitionBy(by).orderBy("date")
    runs = dates.select(by, "date").distinct().withColumn("_g", F.date_sub("date", F.row_number().over(own)))
    ends = runs.groupBy(by, "_g").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    label = F.when(F.col("first") == F.col("last"), compact(F.col("first"))).otherwise(
        F.concat_ws("-", compact(F.col("first")), compact(F.col("last")))
    )
    return ends.select(by, "first", "last", label.alias("range"))


def collection_index(collections: DataFrame, appearances: DataFrame) -> DataFrame:
    """Collections with at least one printed document."""
    return collections.join(appearances.select("collection").distinct(), "collection", "left_semi")


def project_index(kept: DataFrame, ranges: DataFrame, specials: DataFrame, raw: tuple[str, ...] = ("extras", "pages", "dailies", "specials")) -> DataFrame:
    """Index columns: raw parts dropped, day ranges and specials attached (empty where none), alteration keys as strings."""
    days = ranges.groupBy("collection").agg(F.array_sort(F.collect_list("range")).alias("dailies"))
    own = specials.groupBy("collection").agg(F.array_sort(F.collect_list("id")).alias("specials"))
    out = kept.drop(*raw).join(days, "collection", "left").join(own, "collection", "left")
    empty = F.array().cast("array<string>")
    out = out.withColumn("dailies", F.coalesce("dailies", empty)).withColumn("specials", F.coalesce("specials", empty))
    if "alterations" in out.columns:
        out = out.withColumn("alterations", F.transform_keys("alterations", lambda k, v: k.cast("string")))
    return out


def strip_volumes(df: DataFrame) -> DataFrame:
    """editions without their volumes."""
    return df.withColumn("editions", F.transform_values("editions", lambda k, v: v.dropFields("volumes")))


def collection_extras(collections: DataFrame, appearances: DataFrame) -> DataFrame:
    """(collection, pos, text) of the extras of kept collections."""
    return collection_index(collections, appearances).where(F.size("extras") > 0).select("collection", F.posexplode("extras").alias("pos", "text"))


def export_descriptions(strips: DataFrame, key: Column) -> DataFrame:
    return strips.where("description is not null and description <> ''").select(key.cast("string").alias("key"), F.col("description").alias("text"))


def attach_descriptions(strips: DataFrame, descriptions: DataFrame, key: Column) -> DataFrame:
    """Adds description by key; absent stays null."""
    own = descriptions.select(F.col("key").alias("_key"), F.col("text").alias("description"))
    return strips.drop("description").join(own, key.cast("string") == F.col("_key"), "left").drop("_key")


def write_archive(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write df under path, all of it or nothing: readers see the folder only when it is whole.  An existing one is an error."""
    spark = df.sparkSession
    target, staged = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.part"))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    df.write.format(fmt).save(staged.toString())
    if not files.rename(staged, target):
        files.delete(staged, True)
        raise FileExistsError(path)


def append_log(df: DataFrame, path: str) -> None:
    """Add the rows of df to the JSON lines under path; rows of a failed append are not there."""
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that were appended under path; none if there is no log yet."""
    return load_optional(spark, path, schema, "json")


def load_labelled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels, bad lines with their numbers and text); blank lines are skipped.

    Lines are numbered within their file."""
    row = Window.partitionBy("file").orderBy("at")
    lines = spark.read.text(path, wholetext=False).select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at")
    )
    parsed = lines.withColumn("line", F.row_number().over(row)).where("trim(value) <> ''")
    parsed = parsed.withColumn("row", F.from_json("value", LABELS + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.col("row._bad").isNull() & F.col("row.id").isNotNull()
    return parsed.where(good).select("row.*").drop("_bad"), parsed.where(~good).select("file", "line", "value")


def by_date(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy("date").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("strips"))


def load_optional(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """The table, or an empty one of its schema if the path does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.read.format(fmt).schema(schema).load(path)
    return spark.createDataFrame([], schema)
