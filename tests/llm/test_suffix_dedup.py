"""Operator 8 and its suffix arrays against brute force, on texts made to be hard."""

import hashlib
import random

import numpy as np
import pytest

from daybook.llm import suffix_dedup
from daybook.llm.common import table
from daybook.llm.suffix_array import common_prefixes, suffix_array


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(150):
        b = bytes(rng.randrange(rng.choice([1, 2, 3, 26])) + 65 for _ in range(rng.randrange(1, 120)))
        b = (b * 5)[:300] if rng.random() < 0.3 else b
        x = np.frombuffer(b, np.uint8)
        sa = suffix_array(x, 1000)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        p = common_prefixes(x, sa)
        for i in range(1, len(b)):
            u, v = b[sa[i - 1] :], b[sa[i] :]
            assert p[sa[i]] == next((k for k in range(min(len(u), len(v))) if u[k] != v[k]), min(len(u), len(v)))


def by_hand(texts, length=400):
    seen = {}
    for d, t in texts.items():
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    gone = {d: np.zeros(len(t) + 1, bool) for d, t in texts.items()}
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d][i : i + length] = True
    out = {}
    for d, t in texts.items():
        g = gone[d]
        kept = bytes(c for c, x in zip(t, g) if not x)
        out[d] = (len(t), int(g.sum()), int((g[1:] & ~g[:-1]).sum() + g[0]), hashlib.sha256(kept).hexdigest())
    return out


def run(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op8(df).collect()}


@pytest.fixture(scope="module")
def hard():
    rng = random.Random(7)
    prose = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passages = [prose(n) for n in (399, 400, 401, 460, 900)]
    texts = {i: prose(rng.randrange(0, 900)) for i in range(20)}
    for i in range(20, 120):
        texts[i] = prose(rng.randrange(0, 500)) + rng.choice(passages) + prose(rng.randrange(0, 300)) + rng.choice(passages)
    base = prose(3000)
    for i in range(120, 150):
        at = rng.randrange(len(base))
        texts[i] = base[:at] + "#" + base[at + 1 :]
    texts |= {150: None, 151: "", 152: texts[30], 153: texts[30], 154: "z" * 2000, 155: "z" * 401, 156: "ab" * 900, 157: passages[4] * 2}
    return texts


@pytest.mark.parametrize("common", [(64, 2000, 1 << 18), (2, 5, 1 << 18), (2, 5, 37)])
def test_hard_texts(spark, hard, monkeypatch, common):
    monkeypatch.setattr(suffix_dedup, "COMMON", common[0])
    monkeypatch.setattr(suffix_dedup, "COMMON_ALL", common[1])
    monkeypatch.setattr(suffix_dedup, "NAMED", common[2])
    df = spark.createDataFrame(list(hard.items()), "doc_id long, text string").repartition(6)
    assert run(df) == by_hand({d: (t or "").encode() for d, t in hard.items()})


def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    assert run(docs) == by_hand({r.doc_id: r.text.encode() for r in docs.collect()})


def test_odd_rows(spark):
    rows = [(None, "a" * 900, 1), (None, "a" * 900, 2), (5, "bc" * 300, 3), (5, "bc" * 300, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.op8(df).collect())
    assert got == [(0, 900, 0), (0, 900, 0), (5, 600, 600)]
    assert suffix_dedup.op8(df.limit(0)).count() == 0
