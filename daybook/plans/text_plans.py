"""Words and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import shingles, words
from ..operators import corpus as C
from .bindings import FIELDS_SQL, POSTS_SQL, STEMS, STRIPS_SQL, VOCAB_SQL, WORD_SQL, flat, strips, table

#: A lexicon of words that the given texts do have.
LEXICON = {"thand": ["th", "and"], "ofthe": ["of", "the"], "anin": ["an", "in"], "inthe": ["in", "the"], "onon": ["on", "on"]}


def rows(spark, d):
    return C.fields(strips(spark, d))


def tokens(spark, d):
    return C.tokenised(strips(spark, d))


def vocab(spark, d):
    return C.vocabulary_of(strips(spark, d))


def t01(spark, d):
    return flat(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(words(F.col("text"))).alias("pos", "word")))


def t02(spark, d):
    return flat(C.spans(rows(spark, d)))


def t03(spark, d):
    return flat(C.postings(C.tokenised(strips(spark, d), LEXICON)))


def t05(spark, d):
    return flat(C.document_counts(rows(spark, d)))


def t06(spark, d):
    return flat(C.corpus_stats(tokens(spark, d)))


def t08(spark, d):
    return flat(C.inflection_families(vocab(spark, d)))


def t09(spark, d):
    return flat(C.mine_compounds(C.combined_text(strips(spark, d)), ["thand"]))


def t10(spark, d):
    return flat(C.bigram_df(C.combined_text(strips(spark, d))))


def t11(spark, d):
    return flat(C.combined_text(strips(spark, d)).select("doc", F.md5("text").alias("hash")))


def t12(spark, d):
    return flat(table(spark, d, "benchmark").select("item_id", F.explode(shingles(F.col("text"), 3)).alias("shingle")))


COMBINED = STRIPS_SQL + ", texts AS (SELECT doc, transcript || ' ' || coalesce(alternate, '') || ' ' || coalesce(description, '') AS text FROM strips)"
PAIRS = COMBINED + f""", tok AS (SELECT doc, regexp_extract_all(lower(text), '{WORD_SQL}') AS ws FROM texts),
pairs AS (SELECT DISTINCT doc, unnest(ws[:-2]) AS "left", unnest(ws[2:]) AS "right" FROM tok WHERE len(ws) > 1),
bigrams AS (SELECT "left", "right", count(*) AS df FROM pairs GROUP BY "left", "right")"""
CASES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEXICON.items())

PLANS = {
    "t01_tokens": (t01, f"SELECT doc_id AS doc, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD_SQL}') AS ws FROM documents)"),
    "t02_token_spans": (t02, "WITH " + FIELDS_SQL + f""", g AS (SELECT doc, corpus, field, regexp_split_to_array(text, '{WORD_SQL}') AS gaps, regexp_extract_all(text, '{WORD_SQL}') AS ws FROM fields),
one AS (SELECT doc, corpus, field, unnest(ws) AS w, unnest(gaps[1:len(ws)]) AS gap, generate_subscripts(ws, 1) - 1 AS token FROM g),
e AS (SELECT *, CAST(sum(length(gap) + length(w)) OVER (PARTITION BY doc, corpus, field ORDER BY token) AS BIGINT) AS fin FROM one)
SELECT doc, corpus, field, token, fin - length(w) AS start, fin AS "end" FROM e"""),
    "t03_decompose": (t03, "WITH " + POSTS_SQL + f""", cut AS (SELECT doc, corpus, field, pos AS token, CASE word {CASES} ELSE [word] END AS ps FROM posts),
flat AS (SELECT doc, corpus, field, token, unnest(ps) AS word, generate_subscripts(ps, 1) AS part FROM cut)
SELECT doc, corpus, field, row_number() OVER (PARTITION BY doc, corpus, field ORDER BY token, part) - 1 AS pos, token, word FROM flat"""),
    "t04_document_frequency": (lambda s, d: flat(vocab(s, d).select("corpus", "word", "df")), "WITH " + VOCAB_SQL + " SELECT corpus, word, df FROM vocab"),
    "t05_document_count": (t05, "WITH " + VOCAB_SQL + " SELECT * FROM ndocs"),
    "t06_field_length": (t06, "WITH " + VOCAB_SQL + ", l AS (SELECT corpus, round(avg(len(ws)), 6) AS avg_len FROM split GROUP BY corpus) SELECT * FROM ndocs JOIN l USING (corpus)"),
    "t07_idf": (lambda s, d: flat(vocab(s, d).select("corpus", "word", "idf")), "WITH " + VOCAB_SQL + " SELECT corpus, word, round(idf, 6) AS idf FROM vocab"),
    "t08_inflection_families": (t08, "WITH " + VOCAB_SQL + ", forms AS (SELECT DISTINCT word AS w FROM vocab)," + STEMS + " SELECT corpus, stem, array_to_string(list_sort(list(word)), ',') AS words FROM vocab JOIN stems ON w = word GROUP BY corpus, stem"),
    "t09_compound_mining": (t09, "WITH " + PAIRS + f""", w AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc, unnest(ws) AS word FROM tok) GROUP BY word),
cuts AS (SELECT word, df, unnest(range(3, length(word) - 2)) AS cut FROM w WHERE length(word) >= 6 AND word <> 'thand'),
ok AS (SELECT c.word, c.cut, b."left", b."right" FROM cuts c JOIN bigrams b ON b."left" = c.word[1:c.cut] AND b."right" = c.word[c.cut + 1:] WHERE b.df >= 2 AND b.df >= c.df)
SELECT word, "left", "right" FROM ok QUALIFY row_number() OVER (PARTITION BY word ORDER BY cut) = 1"""),
    "t10_bigram_frequency": (t10, "WITH " + PAIRS + " SELECT * FROM bigrams"),
    "t11_combined_text": (t11, "WITH " + COMBINED + " SELECT doc, md5(text) AS hash FROM texts"),
    "t12_shingles": (t12, f"SELECT DISTINCT item_id, array_to_string(list_slice(ws, p, p + 2), ' ') AS shingle FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM (SELECT item_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS ws FROM benchmark))"),
    "t13_informative": (lambda s, d: flat(C.informative(vocab(s, d), 1.0).select("corpus", "word")), "WITH " + VOCAB_SQL + " SELECT corpus, word FROM vocab WHERE ln(n_docs / df) >= 1.0"),
    "t14_term_counts": (lambda s, d: flat(C.term_counts(strips(s, d))), "WITH " + POSTS_SQL + " SELECT doc, word, count(*) AS n FROM posts GROUP BY doc, word"),
    "t15_fields": (lambda s, d: flat(rows(s, d).select("doc", "corpus", "field", F.md5("text").alias("hash"))), "WITH " + FIELDS_SQL + " SELECT doc, corpus, field, md5(text) AS hash FROM fields"),
}
