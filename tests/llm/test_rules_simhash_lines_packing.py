"""Operators 3, 5, 7 and 10 against brute force on a small table, and their edge cases."""

import re
import zlib
from collections import Counter

import pytest
import xxhash

from daybook.llm import line_dedup, packing, quality_rules, simhash
from daybook.llm.common import table

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 700}" for i in range(5000))
    texts = [None, "", " \n\t ", "a", "a b c d", "a b c d", long, long + " tail", "x\x1cy z\n" * 30, "# $ %|" * 9, "Ü ß é\n" * 4]
    data = [(i, t, None, "s" if i % 2 else None, None) for i, t in enumerate(texts)] + [(None, "a b c d", None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def measured(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(w) < 20 or 100 * len(covered) > 30 * len(w),
    }


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_rules_match_brute_force(name, request):
    df = request.getfixturevalue(name)
    text = {r["doc_id"]: r["text"] for r in rows(df)}
    for r in rows(quality_rules.op5(df)):
        want = measured(text[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert not (r["kept"] and r["base_failed"])


def test_policies_and_ablations(spark, docs):
    entries = quality_rules.ledger(docs, ["doc_id"])
    bits = [r["fail_bits"] for r in rows(entries)]
    for r in rows(quality_rules.ablations(entries)):
        names = quality_rules.POLICIES[r["policy"]]
        less = quality_rules.mask(tuple(n for n in names if n != r["rule"]))
        assert r["n_docs"] == len(bits)
        assert r["n_kept"] == sum(b & quality_rules.mask(names) == 0 for b in bits)
        assert r["n_kept_without"] == sum(b & less == 0 for b in bits)
    assert {r["n_docs"] for r in rows(quality_rules.ablations(entries.limit(0)))} == {0}


def simhash_by_hand(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(lower)
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_simhash_matches_brute_force(name, request):
    df = request.getfixturevalue(name)
    fps = [(r["doc_id"], simhash_by_hand(r["text"])) for r in rows(df)]
    root = {f: f for _, f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = list(root)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    best = {}
    for d, f in fps:
        if d is not None:
            best[find(f)] = min(best.get(find(f), d), d)
    want = sorted(((d, f"{f:016x}", best.get(find(f))) for d, f in fps), key=str)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(simhash.op7(df))), key=str)
    assert got == want


def test_chunked_buckets_lose_no_link(spark):
    fps = [(1 << 40) | (1 << i) | (1 << j) for i in range(20) for j in range(20)] + [0x0F0F << 48, (0x0F0F << 48) | 7]
    nodes = spark.createDataFrame([(f if f < 1 << 63 else f - (1 << 64), i) for i, f in enumerate(dict.fromkeys(fps))], "fp long, node long")
    from daybook.llm.components import components

    whole = {tuple(r) for r in components(simhash.links(nodes)).collect()}
    assert whole == {tuple(r) for r in components(simhash.links(nodes, cap=7)).collect()}
    assert len({c for _, c in whole}) == 2


def test_more_blocks_lose_no_link(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ sum({1 << rng.randrange(64) for _ in range(n)}) for b in base for n in (1, 3, 4)]
    nodes = spark.createDataFrame([(f if f < 1 << 63 else f - (1 << 64), i) for i, f in enumerate(dict.fromkeys(fps))], "fp long, node long")
    from daybook.llm.components import components

    want = {tuple(r) for r in components(simhash.links(nodes)).collect()}
    assert len({c for _, c in want}) == 40
    for blocks in (5, 7, 8):
        assert {tuple(r) for r in components(simhash.links(nodes, blocks=blocks)).collect()} == want
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**8, 10**10)] == [6, 6, 7, 8]


def test_components_of_paths_and_stars(spark):
    from daybook.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 260) for i in range(60)] + [(300, 300), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 261)}


def test_lines(spark, odd):
    page = lambda i, *lines: (i, "\n".join(lines), None, "h", None)
    df = spark.createDataFrame([page(i, "menu", f"own {i}", " menu ", "") for i in range(10)], SCHEMA)
    got = rows(line_dedup.drop_boilerplate(df))
    assert {r["text"] for r in got} == {f"own {i}\n" for i in range(10)} and {r["n_dropped"] for r in got} == {2}
    assert len(rows(line_dedup.drop_boilerplate(odd))) == 12
    # a host of two pages loses what both have, one of a single page nothing
    few = spark.createDataFrame([page(1, "menu", "a"), page(2, "menu", "b"), (3, "menu\nc", None, "lone", None)], SCHEMA)
    assert [r["text"] for r in sorted(rows(line_dedup.drop_boilerplate(few)), key=lambda r: r["doc_id"])] == ["a", "b", "menu\nc"]
    clash = df.selectExpr("*", "1 as line_keys", "2 as host", "77 as n_dropped", "3 as kept", "4 as row", "5 as __host")
    got = rows(line_dedup.stage(spark, clash, None))
    assert {(r["line_keys"], r["host"], r["n_dropped"], r["kept"], r["row"], r["__host"]) for r in got} == {(1, 2, 77, 3, 4, 5)}
    assert {r["n_dropped"] for r in rows(line_dedup.drop_boilerplate(clash))} == {2}
    assert {(r["text"], r["n_chars"]) for r in got} == {(f"own {i}\n", 6) for i in range(10)}
    assert rows(line_dedup.op10(odd.limit(0))) == []


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_packing(name, request):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    df = request.getfixturevalue(name)
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] or "" for r in rows(df)}
    got, total = rows(packing.op3(df)), 0
    for doc in text:
        ids = [*tokenizer.encode(text[doc], add_special_tokens=False).ids, 2]
        own = sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids) and [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["length"] == 1024 for r in own[1:])
        for r in own:
            part = b"".join(i.to_bytes(4, "little") for i in ids[r["start"] : r["start"] + r["length"]])
            assert r["ids_crc32"] == zlib.crc32(part)
        total += len(ids)
    fill = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 1024 and len(fill) <= total / 1024 * 1.02 + 2


def test_place_follows_the_sum_of_squares():
    """Against brute force: every gap that has room is tried and the squared counts of all gaps are summed anew."""
    import random

    import numpy as np

    rng, capacity = random.Random(8), 24
    for case in range(60):
        lengths = [rng.randint(1, rng.choice([6, 24])) for _ in range(50)]
        if case % 2:
            lengths.sort(reverse=True)
        bins, offsets = packing.place(np.array(lengths), capacity)
        gaps = []  # of every sequence so far
        for s, b, at in zip(lengths, bins.tolist(), offsets.tolist()):
            def squares(gap, s=s):
                n = Counter(g for g in gaps if g)
                n[gap] -= 1
                n[gap - s] += gap > s
                return sum(v * v for v in n.values())

            room = sorted({g for g in gaps if g >= s})
            want = min(room, key=lambda g: (squares(g), g)) if room else capacity
            assert (b == len(gaps)) == (not room) and capacity - at == want
            if not room:
                gaps.append(capacity)
            assert gaps[b] == want  # a tie of gap and squares goes to any sequence of that gap
            gaps[b] -= s


def test_packing_of_nothing(spark, odd):
    assert rows(packing.op3(odd.limit(0))) == []
