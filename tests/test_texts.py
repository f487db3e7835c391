"""Words, counts and spans are made inside a document's row, and vocabularies in one pass over the texts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from daybook.functions.text import opened, words
from daybook.operators import corpus as C

SAID = [(1, "Anymore snow, anymore SNOW", "snow any\U0001d518x", None), (2, None, None, "  it's a tiger  "), (3, "", "", ""), (4, "snow anymore", None, "Snow — tiger tiger")]


@pytest.fixture(scope="module")
def strips(spark):
    return spark.createDataFrame(SAID, "doc long, transcript string, alternate string, description string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


def test_a_vocabulary_splits_each_text_once(strips):
    """As the vocabulary of tokens; the count of documents splits no text (F37, F40, F42)."""
    rows = lambda df: sorted(map(str, df.select("corpus", "word", "df", "n_docs", "idf", "stem").collect()))
    for lexicon in (None, {"anymore": ["any", "more"]}):
        assert rows(C.vocabulary_of(strips, lexicon)) == rows(C.vocabulary(C.tokenised(strips, lexicon))) != []
    assert 3 <= scans(C.vocabulary_of(strips, None)) < scans(C.vocabulary(C.tokenised(strips, None)))
    assert scans(C.document_counts(C.fields(strips))) == 0


def test_compounds_are_opened_in_lists(spark):
    df = spark.createDataFrame([("anymore any snow anymore",), ("snow any snow",)], "t string")
    for repeats, want in ((True, [["any", "more", "any", "snow", "any", "more"], ["snow", "any", "snow"]]), (False, [["any", "more", "snow"], ["snow", "any"]])):
        w = words(F.col("t")) if repeats else F.array_distinct(words(F.col("t")))
        assert [r[0] for r in df.select(opened(w, {"anymore": ["any", "more"]}, repeats)).collect()] == want


def test_counts_move_no_word(strips):
    """a document's words are counted in its row."""
    want = Counter((r.doc, r.word) for r in C.postings(C.tokenised(strips)).collect())
    got = C.term_counts(strips)
    assert {(r.doc, r.word): r.n for r in got.collect()} == want and "Exchange" not in plan(got)
    assert {(r.doc, r.word): r.n for r in C.counted(strips.select("doc", words(F.col("transcript")).alias("words")), 2).collect()} == {(1, "snow"): 2, (1, "anymore"): 2}


def test_spans_move_no_token(strips):
    """ends are sums inside a field; offsets count characters, also beyond 16 bits."""
    got = C.spans(C.fields(strips))
    text = {(r.doc, r.field): r.text for r in C.fields(strips).collect()}
    found = {(k, t): x for k, v in text.items() for t, x in enumerate(w for w in __import__("regex").findall(r"[\p{L}\p{N}']+", v or ""))}
    assert {((r.doc, r.field), r.token): text[r.doc, r.field][r.start : r.end] for r in got.collect()} == found
    assert "Exchange" not in plan(got) and "Window" not in plan(got)
