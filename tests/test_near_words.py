"""Words near by edits meet through names of what deletions leave, which are put together in the task."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.operators import search as S


def test_names_are_those_of_what_deletions_leave():
    name = lambda w: int(next(S._left(np.array([w]).view(np.uint32).reshape(1, -1), 0))[0]) if w else 0
    for word in ("a", "ab", "sñow", "abcdefghij", "aaaa"):
        got = [int(x[0]) for x in S._left(np.array([word]).view(np.uint32).reshape(1, -1), 2)]
        less = lambda at: "".join(c for i, c in enumerate(word) if i not in at)  # noqa: E731, B023
        want = [word, *(less(at) for n in (1, 2) if n <= len(word) for at in combinations(range(len(word)), n))]
        assert sorted(got) == sorted(map(name, want))


@pytest.mark.parametrize("names", [1 << 20, 0])
def test_only_names_that_queries_have_leave_a_task(spark, monkeypatch, names):
    """The same words with bits and without, and few names leave the tasks with them."""
    monkeypatch.setattr(S, "NAMES", names)
    dice = random.Random(5)
    words = sorted({"".join(dice.choice("abcñ") for _ in range(dice.randrange(2, 11))) for _ in range(400)})
    vocab = spark.createDataFrame([(c, w) for c in ("transcript", "description") for w in words[:: 1 + (c == "description")]], "corpus string, word string")
    terms = spark.createDataFrame([(w,) for w in [*words[::40], "bañabcab", "abcabcabcabcabcabc"]], "term string")
    got = S.expand_fuzzy(terms, vocab).collect()
    most = F.when(F.length("term") <= 3, 0).when(F.length("term") <= 7, 1).otherwise(2)
    want = vocab.crossJoin(terms).withColumn("most", most).where("word <> term and most > 0").withColumn("d", S.edit_distance(F.col("word"), F.col("term"))).where("d <= most")
    assert sorted((r.corpus, r.term, r.word, r.weight) for r in got) == sorted((r.corpus, r.term, r.word, 0.7 if r.d == 1 else 0.55) for r in want.collect()) != []
    keys = S._deletions(terms.select(F.col("term").alias("word"), F.lit(2).alias("reach")))
    known = vocab.select("word", F.lit(2).alias("reach"))
    every, bits = S._deletions(known), S._bits(keys.where("length(word) > 9").select("key").distinct())
    assert (bits is None) == (names == 0) and (bits is None or S._deletions(known, bits).count() < every.count() / 4)
