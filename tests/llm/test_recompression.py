"""Operator 6 against brute force, on texts made to be hard: periods, runs, shared passages, copies, odd rows."""

import hashlib
import random
import re

import pytest

from daybook.llm import recompression
from daybook.llm.common import table

WORDS = re.compile("[^\x20\x09-\x0d]+")


def by_hand(texts):
    words = {d: WORDS.findall(t or "") for d, t in texts.items()}
    seen, out = set(), {}
    for d in sorted(words):
        w, gone = words[d], set()
        for p in range(len(w) - 19):
            g = tuple(w[p : p + 20])
            if g in seen:
                gone.update(range(p, p + 20))
            seen.add(g)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def run(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.op6(df).collect()}


@pytest.fixture(scope="module")
def hard():
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefg") + rng.choice(["", "x", "yy"])
    texts = {i: " ".join(word() for _ in range(rng.randrange(0, 90))) for i in range(60)}
    passage = [" ".join(word() for _ in range(n)) for n in (20, 23, 45)]
    for i in range(60, 140):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 30))), rng.choice(passage), word(), rng.choice(passage)]
        texts[i] = rng.choice([" ", "\n", "\t \x0b"]).join(parts)
    for i in range(140, 170):
        period = [word() for _ in range(rng.randrange(1, 12))]
        texts[i] = " ".join([word(), *(period * 12)[: rng.randrange(15, 70)], word()])
    texts |= {170: None, 171: "", 172: texts[150], 173: texts[100], 174: "one two", 175: "one two", 176: "same " * 500, 177: "same " * 40}
    return texts


def test_hard_texts(spark, hard):
    df = spark.createDataFrame(list(hard.items()), "doc_id long, text string").repartition(5)
    assert run(df) == by_hand(hard)


def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    assert run(docs) == by_hand({r.doc_id: r.text for r in docs.collect()})


def test_odd_rows(spark):
    rows = [(None, "a " * 30, 1), (None, "a " * 30, 2), (5, "b " * 30, 3), (5, "b " * 30, 4)]
    got = recompression.op6(spark.createDataFrame(rows, "doc_id long, text string, keys int")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 30, 0), (0, 30, 0), (5, 30, 29)]
    assert recompression.op6(spark.createDataFrame(rows, "doc_id long, text string, keys int").limit(0)).count() == 0
