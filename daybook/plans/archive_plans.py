"""Sources, joins and collection tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import results as R
from ..sources import archive as A
from ..tables import dealt, forget_at_end, shared_dir
from .bindings import PRINTED_SQL, RARE_SQL, STRIPS_SQL, flat, printed, printed_rows, rare, strips, table


def s01(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id as doc", "coalesce(text, '') as transcript")
    return flat(docs.select("doc", F.length("transcript").alias("n"), F.md5("transcript").alias("hash")))


def s02(spark, d):
    docs = table(spark, d, "documents")
    daily = strips(spark, d).where("doc % 10 <> 0").select(A.compact(F.col("date")).alias("key"), "transcript", "doc")
    special = strips(spark, d).where("doc % 10 = 0").select(F.concat(F.lit("special-"), "doc").alias("id"), "date", "transcript", "doc")
    return flat(A.unify_strips(daily, special).select("doc", "id", "date", F.length("transcript").alias("n")))


def s03(spark, d):
    df = strips(spark, d).select("doc", "date", (F.col("doc") % 3).cast("int").alias("sort"), F.col("doc").cast("string").alias("id"))
    return flat(A.archive_order(df).select("doc", "date", "sort", "id"))


def s04(spark, d):
    page = table(spark, d, "pages").select("page_id", F.concat(F.lit("page"), "page_id").alias("stem"))
    ext = F.array(*map(F.lit, ("webp", "png", "jpg")))
    files = page.select(F.explode(F.transform(F.filter(ext, lambda e: F.md5(F.concat("stem", e)) < "8"), lambda e: F.concat(F.lit("img/"), "stem", F.lit("."), e))).alias("path"))
    return flat(A.attach_asset(page, files, "stem", ["png", "jpg", "webp"]).select("page_id", "image"))


def apps(spark, d):
    own = printed(spark, d).select("key", "collection", F.lit(None).cast("string").alias("edition"), F.lit(None).cast("int").alias("volume"), "page")
    return A.build_appearances(own)


def s05(spark, d):
    orders = dealt(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), printed_rows(spark, d), "key")
    out = A.attach_appearances(orders, apps(spark, d), "key")
    return flat(out.select("key", F.transform("appearances", lambda a: F.concat_ws(":", a["collection"], F.array_join(a["pages"].cast("array<string>"), "+"))).alias("appearances")))


def _maps(spark, d):
    by_page = printed(spark, d).groupBy("collection", "page").agg(F.collect_list("key").alias("keys"))
    return by_page.groupBy("collection").agg(F.map_from_entries(F.collect_list(F.struct("page", "keys"))).alias("pages"))


def s06(spark, d):
    maps = _maps(spark, d)
    nested = maps.select("collection", F.create_map(F.lit("complete"), F.create_map(F.lit(1), F.col("pages"))).alias("editions"))
    return flat(A.explode_page_index(maps, nested))


def s07(spark, d):
    return flat(apps(spark, d).select("key", "collection", "pages"))


def ranges(spark, d):
    return A.date_ranges(dealt(printed(spark, d).select("collection", "date"), printed_rows(spark, d), "collection"))


def s08(spark, d):
    return flat(ranges(spark, d))


def books(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("collection"), F.col("s_name").alias("name"), F.array("s_name", F.lit("note")).alias("extras"), F.create_map(F.col("s_nationkey"), F.lit("altered")).alias("alterations"))


def s09(spark, d):
    return flat(A.collection_index(books(spark, d), rare(spark, d)).select("collection", "name"))


def s10(spark, d):
    kept = A.collection_index(books(spark, d), rare(spark, d))
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("key"))
    special = rare(spark, d).join(urgent, "key").select("collection", F.concat(F.lit("s"), "key").alias("id")).distinct()
    out = A.project_index(kept, A.date_ranges(rare(spark, d).select("collection", "date")), special)
    return flat(out.select("collection", "name", F.size("dailies").alias("n_ranges"), F.array_max("dailies").alias("last_range"), "specials", F.map_keys("alterations").alias("altered")))


def s11(spark, d):
    df = _maps(spark, d).select("collection", F.create_map(F.lit("complete"), F.struct(F.lit("label").alias("label"), F.col("pages").alias("volumes"))).alias("editions"))
    out = A.strip_volumes(df)
    return flat(out.select("collection", F.explode("editions").alias("edition", "x")).select("collection", "edition", F.to_json("x").alias("kept")))


def s12(spark, d):
    return flat(A.collection_extras(books(spark, d), rare(spark, d)))


def s13(spark, d):
    return flat(A.export_descriptions(strips(spark, d), F.col("doc")).select("key", F.md5("text").alias("hash")))


def place(spark):
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/daybook-archive-{uuid.uuid4().hex}"
    forget_at_end(spark, path)
    return path


def s14(spark, d):
    """The strips written as JSON and read back."""
    path, own = place(spark), strips(spark, d).select("doc", "date", "transcript", "description")
    A.write_archive(own, path, "json")
    return flat(A.load_optional(spark, path, "doc long, date date, transcript string, description string", "json").select("doc", "date", F.md5("transcript").alias("hash"), F.md5("description").alias("told")))


def s16(spark, d):
    """A log of order counts by day, appended once for each order status, and read back."""
    path, schema = place(spark), "status string, date date, n long"
    orders = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"))
    for status in ("F", "O", "P"):
        A.append_log(orders.where(F.col("status") == status), path)
    return flat(A.read_log(spark, path, schema))


def s18(spark, d):
    """Strips whose descriptions are missing as a whole, and the number of labels of a file that is there."""
    none = A.load_optional(spark, f"{d}/no-descriptions.parquet", A.DESCRIPTIONS)
    labels = A.load_optional(spark, f"{d}/labels.parquet", "doc_id long, quality int")
    own = A.attach_descriptions(strips(spark, d), none, F.col("doc")).join(labels.withColumnRenamed("doc_id", "doc"), "doc", "left")
    return flat(own.select("doc", F.col("description").isNull().alias("bare"), "quality"))


def s17(spark, d):
    out = A.by_date(strips(spark, d).select("date", "doc"), ["doc"])
    return flat(out.select("date", F.transform("strips", lambda x: x["doc"]).alias("docs")))


def s19(spark, d):
    told = A.export_descriptions(strips(spark, d), F.col("doc"))
    out = A.attach_descriptions(strips(spark, d), told, F.coalesce("id", F.col("doc").cast("string")))
    return flat(out.select("doc", F.md5("description").alias("hash")))


def o04(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return flat(R.union_results(a, b))


def o05(spark, d):
    return flat(R.difference(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_custkey as c_custkey"), "c_custkey"))


def o06(spark, d):
    return flat(R.intersection(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").selectExpr("o_custkey as c_custkey"), "c_custkey"))


APPS_SQL = "SELECT key, collection, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM printed GROUP BY key, collection"
RANGES_SQL = """
u AS (SELECT DISTINCT collection, date FROM src), r AS (SELECT collection, date, date - CAST(row_number() OVER (PARTITION BY collection ORDER BY date) AS INTEGER) AS g FROM u),
runs AS (SELECT collection, min(date) AS first, max(date) AS last FROM r GROUP BY collection, g),
ranges AS (SELECT *, strftime(first, '%Y%m%d') || CASE WHEN first = last THEN '' ELSE '-' || strftime(last, '%Y%m%d') END AS range FROM runs)"""

PLANS = {
    "s01_load_strips": (s01, "SELECT doc_id AS doc, length(coalesce(text, '')) AS n, md5(coalesce(text, '')) AS hash FROM documents"),
    "s02_unify_strips": (s02, f"WITH {STRIPS_SQL} SELECT doc, CASE WHEN doc % 10 = 0 THEN 'special-' || doc END AS id, CAST(date AS VARCHAR) AS date, length(transcript) AS n FROM strips"),
    "s03_archive_order": (s03, f"WITH {STRIPS_SQL} SELECT doc, CAST(date AS VARCHAR) AS date, doc % 3 AS sort, CAST(doc AS VARCHAR) AS id FROM strips ORDER BY date, sort, id"),
    "s04_attach_asset": (s04, "WITH f AS (SELECT page_id, e, p, md5('page' || page_id || e) < '8' AS there FROM pages, (VALUES ('png', 1), ('jpg', 2), ('webp', 3)) x(e, p)) SELECT page_id, arg_min('img/page' || page_id || '.' || e, p) FILTER (there) AS image FROM f GROUP BY page_id"),
    "s05_attach_appearances": (s05, f"WITH {PRINTED_SQL}, a AS (SELECT key, collection, array_to_string(list_sort(list(DISTINCT page)), '+') AS pages FROM printed GROUP BY key, collection) SELECT o_orderkey AS key, (SELECT string_agg(collection || ':' || pages, ',' ORDER BY collection) FROM a WHERE a.key = o_orderkey) AS appearances FROM orders"),
    "s06_explode_page_index": (s06, f"WITH {PRINTED_SQL} SELECT collection, CAST(NULL AS VARCHAR) AS edition, CAST(NULL AS BIGINT) AS volume, CAST(page AS BIGINT) AS page, key FROM printed UNION ALL SELECT collection, 'complete', 1, page, key FROM printed"),
    "s07_build_appearances": (s07, f"WITH {PRINTED_SQL} {APPS_SQL}"),
    "s08_date_ranges": (s08, f"WITH {PRINTED_SQL}, src AS (SELECT collection, date FROM printed), {RANGES_SQL} SELECT collection, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last, range FROM ranges"),
    "s09_collection_index": (s09, f"WITH {RARE_SQL} SELECT s_suppkey AS collection, s_name AS name FROM supplier WHERE s_suppkey IN (SELECT collection FROM rare)"),
    "s10_project_index": (s10, f"WITH {RARE_SQL}, src AS (SELECT collection, date FROM rare), {RANGES_SQL}, n AS (SELECT collection, count(*) AS n, max(range) AS last_range FROM ranges GROUP BY collection), sp AS (SELECT collection, array_to_string(list_sort(list(DISTINCT 's' || key)), ',') AS s FROM rare JOIN orders ON o_orderkey = key WHERE o_orderpriority = '1-URGENT' GROUP BY collection) SELECT s_suppkey AS collection, s_name AS name, coalesce(n, 0) AS n_ranges, last_range, coalesce(s, '') AS specials, CAST(s_nationkey AS VARCHAR) AS altered FROM supplier LEFT JOIN n ON n.collection = s_suppkey LEFT JOIN sp ON sp.collection = s_suppkey WHERE s_suppkey IN (SELECT collection FROM rare)"),
    "s11_strip_volumes": (s11, """SELECT DISTINCT l_suppkey AS collection, 'complete' AS edition, '{"label":"label"}' AS kept FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "s12_collection_extras": (s12, f"WITH {RARE_SQL}, kept AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT collection FROM rare)) SELECT s_suppkey AS collection, CAST(0 AS BIGINT) AS pos, s_name AS text FROM kept UNION ALL SELECT s_suppkey, 1, 'note' FROM kept"),
    "s13_export_descriptions": (s13, f"WITH {STRIPS_SQL} SELECT CAST(doc AS VARCHAR) AS key, md5(description) AS hash FROM strips WHERE description <> ''"),
    "s14_write_archive": (s14, f"WITH {STRIPS_SQL} SELECT doc, CAST(date AS VARCHAR) AS date, md5(transcript) AS hash, md5(nullif(description, '')) AS told FROM strips"),
    "s16_append_log": (s16, "SELECT o_orderstatus AS status, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1, 2"),
    "s18_load_optional": (s18, f"WITH {STRIPS_SQL} SELECT doc, true AS bare, CAST(quality AS BIGINT) AS quality FROM strips LEFT JOIN labels ON doc_id = doc"),
    "s17_by_date": (s17, f"WITH {STRIPS_SQL} SELECT CAST(date AS VARCHAR) AS date, array_to_string(list_sort(list(doc)), ',') AS docs FROM strips GROUP BY date"),
    "s19_attach_descriptions": (s19, f"WITH {STRIPS_SQL} SELECT doc, md5(nullif(description, '')) AS hash FROM strips"),
    "o04_union_results": (o04, "SELECT c_custkey AS key, c_name AS name, CAST(NULL AS BIGINT) AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier"),
    "o05_difference": (o05, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "o06_intersection": (o06, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
}
