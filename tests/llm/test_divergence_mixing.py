"""Operators 12 and 13 against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from daybook.llm import source_divergence, source_mixing
from daybook.llm.common import table

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
WORDS = re.compile("[^\x20\x09-\x0d]+")


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def audited(rows, least):
    """rows of (lang, source, text)."""
    own, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = TERM.findall(small(text))
        own[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang in {g[0] for g in own}:
        kept = [t for t, c in docs[lang].items() if c >= least]
        groups = {g[1]: {t: c[t] for t in kept} for g, c in own.items() if g[0] == lang}

        def shares(counts, kept=kept):
            n = sum(counts.values())
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        whole = shares({t: sum(c[t] for c in groups.values()) for t in kept})
        p = {s: shares(c) for s, c in groups.items()}
        far = defaultdict(dict)
        for a, b in permutations(groups, 2):
            far[a][b] = sum(abs(p[a][t] - p[b][t]) for t in kept)
        for s in groups:
            terms = {t: p[s][t] - whole[t] for t in kept if groups[s][t] and p[s][t] > whole[t]}
            for part, values, top in (("pair", far[s], None), ("term", terms, 50)):
                order = sorted(values, key=lambda t: (-values[t], t.encode()))[:top]
                out |= {(lang, s, part, t, values[t], i + 1) for i, t in enumerate(order)}
    return out


def test_audit_matches_plain_counts(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    got = source_divergence.audit(docs, least_docs=8).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == audited(rows, 8)


def test_audit_in_small_blocks_and_lots(spark):
    dice = random.Random(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)] + ["É", "日本", "Zz"]
    rows = [
        (dice.choice(["en", None, ""]), dice.choice([*"abcdefgh", None]), " ".join(dice.choice(words[: dice.randrange(2, 303)]) for _ in range(dice.randrange(80))))
        for _ in range(150)
    ] + [("xx", "a", None), ("xx", "b", "1 2 3"), ("yy", "a", "one"), ("en", "only zero", "-")]
    rows += rows[:5]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, source string, text string, term long")
    shared = source_divergence.Audit(docs, least_docs=4)
    want = audited(rows, 4)
    pairs = {(g, s, t, v) for g, s, part, t, v, _ in want if part == "pair"}
    for meet, block in ((512, 2048), (3, 40), (1, 64)):
        got = [tuple(r) for r in shared.pairs(meet, block).collect()]
        assert len(got) == len(pairs) and set(got) == pairs
    assert ("xx", "a", "b", 0) in pairs
    assert set(map(tuple, source_divergence.audit(docs, least_docs=4).collect())) == want
    assert source_divergence.op12(docs.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    n, total, terms = 10**13 + 7, 10**14 + 3, 10**9
    row = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    assert row.select(source_divergence.share("n", "total", "terms")).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def mixed(rows, weights=(3, 1, 2), share=1.5, most=2):
    """rows of (id, source, text): {source: (size, target)} by pouring the excess again and again."""
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = {}, share * sum(sizes.values())
    while len(full) < len(order):
        part = {s: left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order if s not in full}
        over = [s for s in part if part[s] >= most * sizes[s]]
        if not over:
            break
        full |= {s: most * sizes[s] for s in over}
        left = share * sum(sizes.values()) - sum(full.values())
    return {s: (sizes[s], full[s] if s in full else part[s]) for s in order}


@pytest.mark.parametrize("nulls", [False, True])
def test_mix_matches_plain_pouring(spark, sf, nulls):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in table(spark, sf, "documents").collect()]
    if nulls:
        rows += [(1000, None, "a b c"), (1001, None, None), (1002, "empty", " \n"), (None, "src0", "x y"), rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, text string, copies int")
    want, got = mixed(rows), source_mixing.op13(docs).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        size, target = want[r["source"]]
        assert r["source_size"] == size and math.isclose(r["target"], target, rel_tol=1e-12)
        rate = target / size if size else 0
        assert r["taken"] == r["size"] * r["copies"] and math.floor(rate) <= r["copies"] <= min(2, math.floor(rate) + 1)
        if r["doc_id"] is not None:
            at = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:13], 16) / 2**52
            assert r["copies"] == math.floor(r["rate"]) + (at < r["rate"] - math.floor(r["rate"]))
        taken[r["source"]] += r["taken"]
    assert sorted(map(str, got)) == sorted(map(str, source_mixing.op13(docs.repartition(7)).collect()))
    copies = Counter(r["doc_id"] for r in source_mixing.mix(docs.drop("copies")).collect())
    wanted = Counter()
    for r in got:
        wanted[r["doc_id"]] += r["copies"]
    assert copies == +wanted


def test_mix_nears_its_targets(spark):
    dice = random.Random(8)
    rows = [(i, f"s{i % 7 if i % 3 else 0}", "w " * dice.randrange(1, 60)) for i in range(20_000)]
    got = source_mixing.op13(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, rel=0.03)


def test_empty_tables_and_full_sources(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert source_mixing.op13(none).count() == 0 and source_mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert {(r["size"], r["target"], r["taken"]) for r in source_mixing.op13(blank).collect()} == {(0, 0.0, 0)}
    some = spark.createDataFrame([(1, "a", "x y"), (2, "b", "z")], "doc_id long, source string, text string")
    assert {r["copies"] for r in source_mixing.repetitions(some, share=5.0).collect()} == {2}


def test_places_follow_the_order(spark):
    keys = spark.createDataFrame([(None,), ("b",), ("B",), ("",), ("é",), ("z",)], "k string")
    assert [r["k"] for r in source_mixing.placed(keys, "k").orderBy("place").collect()] == ["", "B", "b", "z", "é", None]
