"""The near-duplicate stage against brute-force Jaccard similarity."""

from collections import defaultdict

import pytest
from test_rules_simhash_lines_packing import WORDS

from daybook.llm import near_copies, simhash
from daybook.llm.common import table


def sets(texts):
    out = {}
    for d, t in texts.items():
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def pairs_by_hand(texts):
    """(pairs of Jaccard 0.8 or more, smallest id of each one's group)."""
    own, on = sets(texts), defaultdict(list)
    for d, s in own.items():
        for g in s or {()}:
            on[g].append(d)
    common = defaultdict(int)
    for ids in on.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                common[max(a, b), min(a, b)] += 1
    pairs = {(a, b) for (a, b), n in common.items() if not own[a] | own[b] or 5 * n >= 4 * len(own[a] | own[b])}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return pairs, {d: find(d) for d in texts}


@pytest.mark.parametrize("cap", [near_copies.CAP, 2])
def test_groups_match_brute_force(spark, cap):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pairs, want = pairs_by_hand(texts)
    fps = {d: simhash.fingerprint(texts[d]) for pair in pairs for d in pair}
    assert any((fps[a] ^ fps[b]).bit_count() > 4 for a, b in pairs)  # what op7's distance does not reach
    assert {r.id: r.component for r in near_copies.near_copies(docs, cap=cap).collect()} == want
    kept = simhash.stage(spark, docs, None)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(want.values()))


def test_edge_of_the_similarity(spark):
    # 24 words have 20 shingles; a new last word changes one of them (19 / 21), two last words two (18 / 22), three three (17 / 23)
    words = [f"w{i}" for i in range(24)]
    text = lambda n, tag: " ".join(words[: 24 - n] + [f"{tag}{i}" for i in range(n)])
    for n, linked in ((1, True), (2, True), (3, False)):
        df = spark.createDataFrame([(2, text(0, "")), (1, text(n, "x")), (None, text(0, "")), (4, ""), (5, None)], "doc_id long, text string")
        got = {r.id: r.component for r in near_copies.near_copies(df).collect()}
        one = 1 if linked else 2
        assert got == {1: 1, 2: one, None: one, 4: 4, 5: 4}
    assert near_copies.near_copies(df.limit(0)).collect() == []


def test_bands_meet_at_the_least_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(2000):  # 40 of 50 in common: 0.8
        s = rng.integers(0, 1 << 63, 50, np.uint64)
        assert (near_copies.bands(np.sort(s[:45])) == near_copies.bands(np.sort(s[5:]))).any()


def test_rows_of_one_id_with_different_texts(spark):
    a, b = "a b c d e f g h", "zz yy xx ww vv uu"
    near, alone = " ".join(f"w{i}" for i in range(40)), "other words that stand here alone"
    rows = [(1, a), (1, b), (6, b), (6, b), (2, near), (2, alone), (0, near + " end"), (2, None), (None, a)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, fp int")
    kept = [(r.doc_id, r.text) for r in simhash.stage(spark, docs, None).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (0, near + " end"), (2, alone), (2, None), (None, a)], key=str)
    got = {(r.id, r.component, r.kept) for r in near_copies.near_copies(docs).collect()}
    assert {(1, 1, True), (6, 1, False), (2, 0, False), (0, 0, True), (2, 2, True), (None, 1, False)} == got


def test_fingerprints_propose_links_and_the_check_decides(spark, monkeypatch):
    """Without a band, pairs within four bits are still found by their blocks, and one that is not similar enough is not linked."""
    import numpy as np
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(400)]
    texts = {1: " ".join(words), 2: " ".join(words + ["end"]), 3: " ".join(f"v{i}" for i in range(50))}
    own = {d: near_copies.shingles(t) for d, t in texts.items()}
    sims = {d: near_copies.majority(s) for d, s in own.items()}
    assert (sims[1] ^ sims[2]).bit_count() <= 4 < (sims[1] ^ sims[3]).bit_count()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.id: r.sim for r in near_copies.sketches(docs).collect()} == {d: int(np.uint64(s).view(np.int64)) for d, s in sims.items()}
    nodes = near_copies.sketches(docs).withColumn("node", F.col("id")).withColumn("keys", F.array().cast("array<long>"))
    assert {tuple(r) for r in near_copies.links(docs, nodes, "doc_id", "text").collect()} == {(2, 1)}
    nodes = nodes.withColumn("sim", F.lit(5).cast("long"))  # equal fingerprints of texts that are not similar
    assert len(near_copies.proposed(nodes).collect()) == 2
    assert {tuple(r) for r in near_copies.links(docs, nodes, "doc_id", "text").collect()} == {(2, 1)}
