"""Relevance measures, label checks, splits and sweeps.

Results and labels that SQL can check come from order lines: a supplier is a query, its order dates by number of lines
are its results, and its target is a date of its own or of another."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import evaluate as E
from ..operators import results as R
from ..operators import search as S
from ..operators import tuning as T
from ..operators.corrections import corrected
from ..params import DEFAULT
from ..tables import dealt, settle
from .bindings import ASKED_SQL, PRINTED_SQL, STEMS, STRIPS_SQL, VOCAB_SQL, asked, flat, printed, printed_rows, stored, strips, table
from .search_plans import QUERIES, RANKED, TERMS, found, once
from .text_plans import vocab


def results(spark, d):
    one = printed(spark, d).groupBy(F.col("collection").alias("query_id"), "date").agg((F.count("*") * 1.0).alias("score"))
    one = one.withColumns({"id": F.lit(None).cast("string"), "source": F.when(F.month("date") < 4, "description").otherwise("transcript")})
    return R.ranked(one)


def labelled(spark, d):
    """Suppliers as queries: class by number, target and decoy the earliest dates of the supplier and of the next ones."""
    first = printed(spark, d).groupBy("collection").agg(F.max("date").alias("t"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"))
    k = F.col("query_id")
    out = s.join(first.withColumnRenamed("collection", "query_id"), "query_id", "left")
    out = out.join(first.select((F.col("collection") - 1).alias("query_id"), F.col("t").alias("decoy")), "query_id", "left")
    return out.select(
        "query_id", F.concat(F.lit("q"), k).alias("query"), F.when(k % 5 != 3, F.col("t")).alias("date"), F.expr("substring('ABCDE', 1 + query_id % 5, 1)").alias("class"),
        "decoy", F.when(k % 4 == 0, "ambiguous").otherwise("validated").alias("status"), F.when(k % 8 == 0, "why").alias("reason"),
    )


def over(fn):
    return lambda spark, d: flat(fn(results(spark, d), labelled(spark, d)))


def pairs(spark, d):
    """Each benchmark query with the document of its number as target and the next as other."""
    q = asked(spark, d)
    return q.withColumn("target", F.col("query_id")).withColumn("other", F.col("query_id") + 1)


def neighbours(spark, d):
    """Each document asked for by its own transcript, with the next one as other."""
    return strips(spark, d).select(F.col("doc").alias("query_id"), F.col("transcript").alias("query"), F.col("doc").alias("target"), (F.col("doc") + 1).alias("other"))


def texts(spark, d):
    return C.combined_text(strips(spark, d))


def known(spark, d):
    return C.informative(vocab(spark, d).where("corpus = 'transcript'"), 1.0)


def e06(spark, d):
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("a_id"), "text")
    return flat(E.shared_spans(a, table(spark, d, "documents").select(F.col("doc_id").alias("b_id"), "text"), 5))


def e07(spark, d):
    p = pairs(spark, d).join(strips(spark, d).select(F.col("doc").alias("target"), F.col("transcript").alias("text")), "target")
    return E.recite(p).drop("text", "target", "other")


def e09(spark, d):
    return flat(E.answerable(pairs(spark, d), texts(spark, d), known(spark, d)))


def e10(spark, d):
    return flat(E.decidable(pairs(spark, d), texts(spark, d), known(spark, d)))


def e11(spark, d):
    return flat(E.emphasis_pairs(neighbours(spark, d), texts(spark, d), known(spark, d)))


def e12(spark, d):
    r = printed(spark, d).select(F.col("collection").alias("query_id"), F.col("key").alias("doc")).distinct()
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("text"))
    return flat(E.strays(r, dealt(t, printed_rows(spark, d), "doc"), "^[12]-"))


def e13(spark, d):
    """Labels of suppliers in debt stand twice; the days with returned lines are the known ones."""
    own = labelled(spark, d)
    debt = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("query_id"))
    return flat(E.validate_labels(own.unionByName(own.join(debt, "query_id").select(own.columns)), printed(spark, d).where("flag = 'R'").select("date")))


def e14(spark, d):
    return flat(E.assign_split(strips(spark, d).select("doc", "date"), F.col("date").cast("string")).select("doc", "split"))


def counts(spark, d):
    return printed(spark, d).groupBy(F.col("collection").alias("query_id")).agg(F.count("*").alias("n"))


def targets(spark, d):
    """Benchmark queries labelled with the date of the first document that has their text word for word."""
    docs = strips(spark, d).select("doc", "date", "transcript")
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hit = b.join(E.shared_spans(b.selectExpr("query_id as a_id", "text"), docs.selectExpr("doc as b_id", "transcript as text"), 8).groupBy("a_id").agg(F.max_by("b_id", F.struct("n", -F.col("b_id"))).alias("doc")), F.col("query_id") == F.col("a_id"))
    hit = hit.join(docs.select("doc", "date"), "doc")
    return asked(spark, d).join(hit.select("query_id", "date"), "query_id", "left").withColumn("class", F.expr("substring('ABCDE', 1 + cast(query_id % 5 as int), 1)"))


@once
def goals(spark, d):
    return settle(targets(spark, d))


def e01_search(spark, d):
    return flat(E.evaluate(found(spark, d), goals(spark, d)))


def tuner(spark, d, size=None):
    """A tuner on the labels of classes A, B and C (a stratified sample of size, if it is given) with its guards: the first half of a
    query is a shorter query of its own, described queries (B) are probes, and queries without a target are hollow.

    A pair that the shipped settings break already cannot guard anything and is left out, as are probes without a result."""
    index = stored(spark, d)
    every = goals(spark, d)
    labels = every.where("date is not null and class in ('A', 'B', 'C')").withColumn("status", F.lit("validated"))
    labels = settle(labels if size is None else E.subsample(labels, size, 20260810))
    words = F.split(F.trim("query"), " +")
    half = F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.size(words) / 2).cast("int")), " ")
    shorter = every.select((-1 - F.col("query_id")).alias("query_id"), half.alias("query"))
    hollow = settle(every.where("date is null").select("query_id"))
    asked_ = settle(labels.select("query_id", "query").unionByName(every.where("date is null").select("query_id", "query")).unionByName(shorter))
    pairs_ = every.select((-1 - F.col("query_id")).alias("shorter"), F.col("query_id").alias("longer"))
    probe = settle(labels.where("class = 'B'").select("query_id"))
    tune = T.Tuner(index, asked_, labels)
    counts_ = settle(asked_.select("query_id").join(tune.counts([DEFAULT]).select("query_id", "n"), "query_id", "left").na.fill(0, ["n"]))
    holds = settle(pairs_.join(E.monotonicity(counts_, pairs_), ["shorter", "longer"], "left_anti"))
    some = settle(probe.join(counts_.where("n > 0"), "query_id", "left_semi"))
    tune.guards = T.Guards(holds, some, hollow)
    return tune


#: Queries of a sweep.
SWEPT = 250


@once
def swept(spark, d):
    """(best settings, log rows) of the sweep of the whole grid in two passes, on a sample and under its guards."""
    tune = tuner(spark, d, SWEPT)
    best, _, log = E.sweep(tune, DEFAULT, allowed=tune.allowed)
    return best, log


def e15(spark, d):
    return flat(spark.createDataFrame(swept(spark, d)[1], E.LOG))


def e21(spark, d):
    """The moves of the sweep, each undone on all labels."""
    rows = E.confirm(DEFAULT, swept(spark, d)[0], tuner(spark, d))
    return flat(spark.createDataFrame(rows, "knob string, before double, after double, kept boolean, at_edge boolean"))


#: Knobs that act after the fields are scored, which SQL can follow.
LAST = {k: E.GRID[k] for k in ("description_preference", "agreement_bonus")}


def moves(grid):
    """The moves from the shipped settings to every value of the grid's knobs, and whether the sweep's rule accepts them without guards."""

    def plan(spark, d):
        trials = [(k, DEFAULT.but(**{k: float(v)})) for k, (_, values) in grid.items() for v in values if v != getattr(DEFAULT, k)]
        base, *got = tuner(spark, d)([DEFAULT, *(p for _, p in trials)])
        rows = [(1, k, float(getattr(p, k)), grid[k][0], g[grid[k][0]] - base[grid[k][0]], g["combined"] - base["combined"], False) for (k, p), g in zip(trials, got, strict=True)]
        table_ = spark.createDataFrame(rows, E.LOG)
        ok = E.accepted(table_).select("knob", "value", F.lit(True).alias("accepted"))
        return flat(table_.join(ok, ["knob", "value"], "left").select("knob", "value", "gain", "change", F.coalesce("accepted", F.lit(False)).alias("accepted")))

    return plan


def e17(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("shorter"), (F.col("s_suppkey") + 1).alias("longer"))
    return flat(E.monotonicity(counts(spark, d), p))


def lasting(spark, d):
    """Counts of the lines that were neither returned nor accepted yet."""
    return printed(spark, d).where("flag = 'N'").groupBy(F.col("collection").alias("query_id")).agg(F.count("*").alias("n"))


def e18(spark, d):
    return flat(E.collapse(lasting(spark, d), counts(spark, d)))


def e19(spark, d):
    return flat(E.bloat(counts(spark, d), lasting(spark, d)))


def e20(spark, d):
    """Each benchmark word as a query of its own, whose results are all documents that any route reaches; those that an exact, longer or
    inflected word reaches are no corrections whatever else they say, so only words that edits alone reach are looked for."""
    terms = S.query_terms(asked(spark, d))
    one = terms.select((F.col("query_id") * 1000 + F.col("term_no")).alias("query_id"), F.col("term").alias("query")).distinct()
    return flat(corrected(texts(spark, d), one))


def e22(spark, d):
    return flat(E.subsample(labelled(spark, d), 20, 7).select("query_id", "class"))


def e23(spark, d):
    return flat(E.sample_docs(strips(spark, d).select("doc"), 50, 7))


def e24(spark, d):
    own = E.assign_split(labelled(spark, d), F.col("query_id").cast("string"))
    return flat(E.count_by_class(E.select_labels(own, "train", ("A", "B", "C"))))


def e25(spark, d):
    golden = asked(spark, d).join(strips(spark, d).select(F.col("doc").alias("query_id"), "date"), "query_id").select("query", "date")
    return flat(E.golden_as_labels(golden, "A").select("query_id", "query", "date", "class"))


RES = """WITH p AS (SELECT l_orderkey AS key, l_suppkey AS collection, CAST(o_orderdate AS DATE) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
res AS (SELECT collection AS query_id, date, row_number() OVER (PARTITION BY collection ORDER BY count(*) DESC, date) AS position, CASE WHEN month(date) < 4 THEN 'description' ELSE 'transcript' END AS source FROM p GROUP BY collection, date),
mx AS (SELECT collection, max(date) AS t FROM p GROUP BY collection),
lab AS (SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 5 <> 3 THEN a.t END AS date, substring('ABCDE', 1 + CAST(s_suppkey % 5 AS INTEGER), 1) AS class, b.t AS decoy, CASE WHEN s_suppkey % 4 = 0 THEN 'ambiguous' ELSE 'validated' END AS status, CASE WHEN s_suppkey % 8 = 0 THEN 'why' END AS reason
  FROM supplier LEFT JOIN mx a ON a.collection = s_suppkey LEFT JOIN mx b ON b.collection = s_suppkey + 1),
cnt AS (SELECT query_id, count(*) AS n FROM res GROUP BY query_id),
rk AS (SELECT lab.*, (SELECT min(position) FROM res WHERE res.query_id = lab.query_id AND res.date = lab.date) AS rank, (SELECT min(position) FROM res WHERE res.query_id = lab.query_id AND res.date = lab.decoy) AS drank, coalesce(n, 0) AS n FROM lab LEFT JOIN cnt USING (query_id))
"""
EVAL = "count(*) AS queries, round(coalesce(sum(1 / rank), 0) / count(*), 6) AS mrr, round(count(*) FILTER (rank = 1) / count(*), 6) AS recall_at_1, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_at_10, round(count(*) FILTER (n = 0) / count(*), 6) AS zero_rate, round(sum(n) / count(*), 6) AS mean_results, list_sort(list(n))[1 + CAST(floor(count(*) / 2) AS INTEGER)] AS median_results"
OUTCOME = "CASE WHEN rank IS NULL THEN 'target_absent' WHEN drank IS NULL THEN 'decoy_uncontested' WHEN rank < drank THEN 'target_above' ELSE 'decoy_wins' END"
NEAR = ", near AS (SELECT query_id, " + OUTCOME + " AS outcome FROM rk WHERE class = 'E' AND date IS NOT NULL AND decoy IS NOT NULL)"
TEXTS = VOCAB_SQL + ", texts AS (SELECT doc, transcript || ' ' || coalesce(alternate, '') || ' ' || coalesce(description, '') AS text FROM strips), dw AS (SELECT DISTINCT doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}'']+')) AS word FROM texts), known AS (SELECT word FROM vocab WHERE corpus = 'transcript' AND ln(n_docs / df) >= 1), qw AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}'']+')) AS word FROM benchmark), iw AS (SELECT * FROM qw WHERE word IN (SELECT word FROM known))"
RECITE = "WITH " + STRIPS_SQL + """, q AS (SELECT item_id AS query_id, text AS query, regexp_extract_all(lower(text), '[\\p{L}\\p{N}'']+') AS ws FROM benchmark),
t AS (SELECT query_id, query, ws, regexp_extract_all(lower(transcript), '[\\p{L}\\p{N}'']+') AS ts FROM q JOIN strips ON doc = query_id),
s AS (SELECT query_id, ws, ts, unnest(range(1, len(ws) + 1)) AS a FROM t), sp AS (SELECT query_id, ws, ts, a, unnest(range(a, len(ws) + 1)) AS b FROM s),
r AS (SELECT query_id, max(CASE WHEN contains(array_to_string(ts, ' '), array_to_string(list_slice(ws, a, b), ' ')) THEN b - a + 1 ELSE 0 END) AS run FROM sp GROUP BY query_id),
rec AS (SELECT t.query_id, query, run, len(list_filter(ws, lambda w: list_contains(ts, w))) / len(ws) AS overlap, len(ws) AS length, len(ws) / greatest(1, len(ts)) AS share FROM t JOIN r USING (query_id))"""
EMPHASIS = "WITH " + VOCAB_SQL + """, texts AS (SELECT doc, transcript || ' ' || coalesce(alternate, '') || ' ' || coalesce(description, '') AS text FROM strips),
dw AS (SELECT doc, word, count(*) AS n FROM (SELECT doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}'']+')) AS word FROM texts) GROUP BY ALL),
known AS (SELECT word FROM vocab WHERE corpus = 'transcript' AND ln(n_docs / df) >= 1),
qw AS (SELECT DISTINCT doc AS query_id, unnest(regexp_extract_all(lower(transcript), '[\\p{L}\\p{N}'']+')) AS word FROM strips),
forms AS (SELECT DISTINCT word AS w FROM dw),""" + STEMS + """,
said AS (SELECT query_id, q.word, stem FROM qw q JOIN dw ON dw.doc = query_id AND dw.word = q.word AND n >= 3 JOIN stems ON w = q.word
  WHERE q.word IN (SELECT word FROM known) AND (query_id + 1, q.word) NOT IN (SELECT doc, word FROM dw)),
kin AS (SELECT doc, stem FROM dw JOIN stems ON w = word GROUP BY ALL HAVING count(*) >= 2)
SELECT query_id, word FROM said JOIN kin ON doc = query_id + 1 AND kin.stem = said.stem"""
TARGETS = """, ga AS (SELECT DISTINCT query_id AS id, array_to_string(list_slice(ws, p, p + 7), ' ') AS g FROM (SELECT query_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM asked)),
gb AS (SELECT DISTINCT doc AS id, array_to_string(list_slice(ws, p, p + 7), ' ') AS g FROM (SELECT doc, ws, unnest(range(1, len(ws) - 6)) AS p FROM split WHERE field = 'transcript')),
best AS (SELECT ga.id AS query_id, gb.id AS doc, count(*) AS n FROM ga JOIN gb USING (g) GROUP BY ga.id, gb.id QUALIFY row_number() OVER (PARTITION BY ga.id ORDER BY count(*) DESC, gb.id) = 1),
goal AS (SELECT query_id, date, substring('ABCDE', 1 + CAST(query_id % 5 AS INTEGER), 1) AS class FROM best JOIN strips USING (doc))"""
QUALITY = RANKED.rstrip() + TARGETS + """, cnt AS (SELECT query_id, count(*) AS n FROM ranked GROUP BY query_id),
rk AS (SELECT g.query_id, (SELECT min(position) FROM ranked r WHERE r.query_id = g.query_id AND r.date = g.date) AS rank, coalesce(n, 0) AS n FROM goal g LEFT JOIN cnt USING (query_id))
"""
MOVES = TERMS.rstrip() + TARGETS + """, knobs AS (SELECT 'base' AS knob, 0.7::DOUBLE AS value, 0.7::DOUBLE AS d, 0.15::DOUBLE AS a UNION ALL SELECT 'description_preference', v, v, 0.15 FROM (VALUES (0.4::DOUBLE), (0.55), (0.85), (1)) t(v)
  UNION ALL SELECT 'agreement_bonus', v, 0.7, v FROM (VALUES (0::DOUBLE), (0.3), (0.6)) t(v)),
fu AS (SELECT knob, value, query_id, doc, round(greatest(coalesce(t, 0), coalesce(told.d / 0.7 * knobs.d, 0)) + a * least(coalesce(t, 0), coalesce(told.d / 0.7 * knobs.d, 0)), 9) AS score
  FROM spoken FULL JOIN told USING (query_id, doc) CROSS JOIN knobs),
po AS (SELECT knob, value, query_id, date, row_number() OVER (PARTITION BY knob, value, query_id ORDER BY score DESC, date) AS position FROM fu JOIN strips USING (doc)),
rr AS (SELECT knob, value, g.query_id, class, coalesce(max(1 / position), 0) AS rr FROM knobs CROSS JOIN (SELECT * FROM goal WHERE class IN ('A', 'B', 'C')) g LEFT JOIN po USING (knob, value, query_id, date) GROUP BY ALL),
me AS (SELECT knob, value, (coalesce(avg(rr) FILTER (class IN ('A', 'C')), 0) + coalesce(avg(rr) FILTER (class IN ('B', 'C')), 0)) / 2 AS combined FROM rr GROUP BY ALL),
ch AS (SELECT knob, value, combined - (SELECT combined FROM me WHERE knob = 'base') AS gain FROM me WHERE knob <> 'base')
SELECT knob, value, round(gain, 6) AS gain, round(gain, 6) AS change, gain > 0.005 AS accepted FROM ch"""
CORRECTED = QUERIES + """texts AS (SELECT doc, transcript || ' ' || coalesce(alternate, '') || ' ' || coalesce(description, '') AS text FROM strips),
dw AS (SELECT DISTINCT doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}'']+')) AS word FROM texts),
lit AS (SELECT DISTINCT term, word FROM pre UNION SELECT term, b.w FROM terms JOIN stems a ON a.w = term JOIN stems b ON b.stem = a.stem),
every AS (SELECT * FROM lit UNION SELECT term, word FROM fuzzy),
one AS (SELECT query_id * 1000 + term_no AS query_id, term FROM qt),
res AS (SELECT DISTINCT query_id, doc FROM one JOIN every USING (term) JOIN dw USING (word)),
said AS (SELECT DISTINCT query_id, doc FROM one JOIN lit USING (term) JOIN dw USING (word))
SELECT query_id, doc FROM res ANTI JOIN said USING (query_id, doc)"""
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"

PLANS = {
    "e01_evaluate": (over(E.evaluate), RES + f"SELECT {EVAL} FROM rk WHERE date IS NOT NULL"),
    "e01_search_quality": (e01_search, QUALITY + f"SELECT {EVAL} FROM rk"),
    "e02_misses": (over(E.misses), RES + "SELECT query_id, coalesce(rank, 0) AS rank, coalesce((SELECT string_agg(CAST(date AS VARCHAR), ',' ORDER BY position) FROM res WHERE res.query_id = rk.query_id AND position <= 3), '') AS found FROM rk WHERE date IS NOT NULL AND (rank IS NULL OR rank <> 1)"),
    "e03_hollow": (over(E.evaluate_hollow), RES + "SELECT count(*) AS queries, round(avg(n), 6) AS mean_results, max(n) AS worst_results, CAST(sum((SELECT count(*) FROM res WHERE res.query_id = rk.query_id AND source = 'description')) AS BIGINT) AS description_sourced FROM rk WHERE class = 'D'"),
    "e04_by_class": (over(E.evaluate_by_class), RES + f"SELECT class, {EVAL} FROM rk WHERE date IS NOT NULL AND class <> 'D' GROUP BY class"),
    "e05_near_miss": (over(E.evaluate_near_miss), RES.rstrip() + NEAR + " SELECT count(*) AS pairs, count(*) FILTER (outcome = 'target_above') AS target_above, count(*) FILTER (outcome IN ('target_above', 'decoy_wins')) AS contested, count(*) FILTER (outcome = 'decoy_wins') AS decoy_wins, count(*) FILTER (outcome = 'target_absent') AS target_absent, count(*) FILTER (outcome = 'decoy_uncontested') AS decoy_uncontested, count(*) FILTER (outcome IN ('decoy_wins', 'target_absent')) AS losses FROM near"),
    "e06_shared_spans": (e06, "WITH a AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}'']+') AS ws FROM benchmark), b AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}'']+') AS ws FROM documents), ga AS (SELECT DISTINCT id, array_to_string(list_slice(ws, p, p + 4), ' ') AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 3)) AS p FROM a)), gb AS (SELECT DISTINCT id, array_to_string(list_slice(ws, p, p + 4), ' ') AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 3)) AS p FROM b)) SELECT ga.id AS a_id, gb.id AS b_id, count(*) AS n FROM ga JOIN gb USING (g) GROUP BY ALL"),
    "e07_recitation": (lambda s, d: flat(e07(s, d)), RECITE + " SELECT query_id, query, run, round(overlap, 6) AS overlap, length, round(share, 6) AS share FROM rec"),
    "e08_bound_violations": (lambda s, d: flat(E.violations(e07(s, d))), RECITE + " SELECT query_id, 'run' AS bound FROM rec WHERE run < 5 UNION ALL SELECT query_id, 'overlap' FROM rec WHERE overlap < 0.7 UNION ALL SELECT query_id, 'length' FROM rec WHERE length > 14 UNION ALL SELECT query_id, 'share' FROM rec WHERE share > 0.65"),
    "e09_answerable": (e09, "WITH " + TEXTS + " SELECT item_id AS query_id, item_id IN (SELECT query_id FROM iw JOIN dw USING (word) WHERE doc = query_id) AS answerable FROM benchmark"),
    "e10_decidable": (e10, "WITH " + TEXTS + " SELECT item_id AS query_id, EXISTS (SELECT 1 FROM iw WHERE iw.query_id = item_id AND (item_id, word) IN (SELECT doc, word FROM dw) AND (item_id + 1, word) NOT IN (SELECT doc, word FROM dw)) AS separable, EXISTS (SELECT 1 FROM iw WHERE iw.query_id = item_id AND (item_id + 1, word) IN (SELECT doc, word FROM dw)) AS contested FROM benchmark"),
    "e11_emphasis_pairs": (e11, EMPHASIS),
    "e12_strays": (e12, "SELECT DISTINCT l_suppkey AS query_id, o_orderkey AS doc FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT regexp_matches(o_orderpriority, '^[12]-')"),
    "e13_label_problems": (e13, RES.rstrip() + ", ev AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') SELECT query_id, 'repeated_id' AS problem FROM lab WHERE query_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT query_id, 'no_target' FROM lab WHERE class <> 'D' AND date IS NULL UNION ALL SELECT query_id, 'unknown_target' FROM lab WHERE date IS NOT NULL AND date NOT IN (SELECT date FROM ev) UNION ALL SELECT query_id, 'decoy_is_target' FROM lab WHERE decoy = date UNION ALL SELECT query_id, 'no_reason' FROM lab WHERE status = 'ambiguous' AND reason IS NULL"),
    "e14_split": (e14, "WITH " + STRIPS_SQL + f", k AS (SELECT doc, CAST(date AS VARCHAR) AS key FROM strips) SELECT doc, CASE WHEN ({FNV}) % 1000 < 200 THEN 'test' ELSE 'train' END AS split FROM k"),
    "e15_sweep": (e15, None),
    "e16_accept": (moves(LAST), MOVES),
    "e16_all_knobs": (moves(E.GRID), None),
    "e21_confirmation": (e21, None),
    "e17_monotonicity": (e17, RES.rstrip() + ", c AS (SELECT collection AS q, count(*) AS n FROM p GROUP BY 1) SELECT a.q AS shorter, b.q AS longer, a.n AS n_shorter, b.n AS n_longer FROM c a JOIN c b ON b.q = a.q + 1 WHERE b.n > a.n"),
    "e18_collapse": (e18, f"WITH {PRINTED_SQL}, c AS (SELECT collection AS query_id, count(*) AS before, count(*) FILTER (flag = 'N') AS n FROM printed GROUP BY 1) SELECT * FROM c WHERE n < ceil(before * 0.5)"),
    "e19_bloat": (e19, f"WITH {PRINTED_SQL}, c AS (SELECT collection, count(*) AS n FROM printed GROUP BY 1), b AS (SELECT collection, count(*) AS n FROM printed WHERE flag = 'N' GROUP BY 1), m AS (SELECT (SELECT avg(n) FROM c) AS after, (SELECT avg(n) FROM b) AS before) SELECT round(after, 6) AS after, round(before, 6) AS before FROM m WHERE before > 0 AND after > 1.5 * before"),
    "e20_corrections": (e20, CORRECTED),
    "e22_subsample": (e22, RES.rstrip() + """, z AS (SELECT query_id, class, count(*) OVER () AS every, count(*) OVER (PARTITION BY class) AS own,
  row_number() OVER (PARTITION BY class ORDER BY md5('7:' || query_id), query_id) AS r FROM lab)
SELECT query_id, class FROM z WHERE r <= CASE WHEN every <= 20 THEN own ELSE greatest(1, round(own / every * 20)) END"""),
    "e23_sample": (e23, "SELECT doc_id AS doc FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50"),
    "e24_selection": (e24, RES.rstrip() + f", k AS (SELECT *, CAST(query_id AS VARCHAR) AS key FROM lab) SELECT class, count(*) AS n FROM k WHERE class IN ('A', 'B', 'C') AND status = 'validated' AND ({FNV}) % 1000 >= 200 GROUP BY class"),
    "e25_golden": (e25, "WITH " + STRIPS_SQL + ", q AS (SELECT item_id, text AS query FROM benchmark) SELECT 'A-' || md5(query) AS query_id, query, CAST(date AS VARCHAR) AS date, 'A' AS class FROM q JOIN strips ON doc = item_id"),
}
