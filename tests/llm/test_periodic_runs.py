"""Operator 11 against every run tried by hand."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from daybook.llm import periodic_runs
from daybook.llm.common import table

WORDS = re.compile("[^\x20\x09-\x0d]+")


def runs_by_hand(w):
    """Every maximal stretch at every lag, then those of smallest period only."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def expected(doc, text):
    w = WORDS.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(((-k, s, q) for s, k, q in runs), default=None)
    top = {"start": best and best[1], "length": best and -best[0], "period": best and best[2]}
    return top | {
        "doc_id": doc, "n_words": n, "n_runs": len(runs), "exponent_milli": best and 1000 * -best[0] // best[2],
        "runs_sha256": hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    }


def test_rows_match_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    got = sorted((r.asDict() for r in periodic_runs.op11(docs).collect()), key=lambda r: r["doc_id"])
    want = [expected(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    assert got == want
    assert sum(r["n_runs"] > 0 for r in want) >= 10


def test_odd_rows(spark):
    texts = [None, "", " \n\t ", "a", "a " * 5, "a " * 6, "a b " * 4, "x\x1cy z " * 5, "Ü ß Ü ß Ü ß Ü ß Ü", "a a b " * 9 + "c " + "b a " * 7]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(7, texts[7], "clash"), (None, "q " * 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")
    got = [r.asDict() for r in periodic_runs.op11(docs).collect()]
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r == expected(r["doc_id"], texts[r["doc_id"]])
    alone = next(r for r in got if r["doc_id"] is None)
    assert (alone["n_runs"], alone["start"], alone["length"], alone["period"], alone["exponent_milli"]) == (1, 0, 8, 1, 8000)
    assert periodic_runs.op11(docs.limit(0)).count() == 0


def test_general_interface_gives_texts(spark):
    docs = spark.createDataFrame([("k", "start " + "one two three " * 5 + "end")], "name string, body string")
    row = periodic_runs.periodic_runs(docs, "name", "body").first()
    assert (row["starts"], row["lengths"], row["periods"]) == ([1], [15], [3])
    assert row["collapsed"] == "start one two three end"


@pytest.mark.parametrize("letters,length", [(2, 40), (2, 200), (3, 120), (6, 300)])
def test_random_rows(letters, length):
    dice = random.Random(letters * length)
    for _ in range(300):
        w = [dice.randrange(letters) for _ in range(dice.randrange(length))]
        for _ in range(dice.randrange(4)):
            a = dice.randrange(len(w) + 1)
            w[a:a] = w[a : a + dice.randrange(1, 9)] * dice.randrange(1, 8)
        assert periodic_runs.runs_of(np.array(w, np.int64)) == runs_by_hand(w)


def test_segments_hold_no_rare_word_and_lose_no_run():
    dice = random.Random(3)
    for _ in range(200):
        w = np.array([min(dice.randrange(40), dice.randrange(40)) for _ in range(dice.randrange(400))], np.int64)
        parts = periodic_runs.segments(w)
        for lo, hi in parts:
            assert np.unique(w[lo:hi], return_counts=True)[1].min() >= 4
        for s, k, _ in runs_by_hand(w.tolist()):
            assert any(lo <= s and s + k <= hi for lo, hi in parts)


def test_long_rows_end_soon():
    dice, n = np.random.default_rng(1), 200_000
    nested = np.repeat(np.arange(n // 4), 4)  # each word rare as soon as one copy is cut off
    nested = np.concatenate((np.arange(n // 8), nested[: n // 2], np.arange(n // 8)))
    for w in (np.zeros(n, np.int64), dice.integers(0, 3, n), np.tile(dice.integers(0, 9, n // 5), 5), nested, np.tile([0, 0, 0, 0, 0, 0, 1], n // 7)):
        began = time.time()
        periodic_runs.runs_of(w)
        assert time.time() - began < 20
