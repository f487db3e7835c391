"""The whole pipeline against a plain Python version of its stages."""

from collections import Counter, defaultdict

import corpus_pipeline
from test_near_copies import pairs_by_hand
from test_rules_simhash_lines_packing import WORDS, measured

from daybook.llm import decontamination as dc
from daybook.llm.common import table
from daybook.llm.line_dedup import MIN_PAGES, RATIO


def passes(text):
    m = measured(text)
    n, chars = m["n_words"], m["word_chars"]
    lines = sum(bool(WORDS.search(x)) for x in text.split("\n"))
    upper = sum(c.isupper() for c in text)
    letters = sum(c.isalpha() for c in text)
    return not (
        m["base_failed"] or 10 * m["n_symbols"] > n or 10 * m["n_dup_lines"] > 3 * lines or not 2 * n <= chars <= 14 * n
        or 10 * upper > 3 * chars or 10 * text.count("!!") > n or 10 * letters < 6 * chars
    )


def by_hand(docs, items):
    docs = {d: (t, s) for d, (t, s) in docs.items() if passes(t)}
    pages, on = Counter(s for _, s in docs.values()), defaultdict(set)
    for d, (t, s) in docs.items():
        for x in t.split("\n"):
            if x.strip(" \t\x0b\x0c\r"):
                on[s, x.strip(" \t\x0b\x0c\r")].add(d)
    common = {k for k, v in on.items() if len(v) >= MIN_PAGES and len(v) > RATIO * pages[k[0]]}
    docs = {d: "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\x0b\x0c\r")) not in common) for d, (t, s) in docs.items()}
    group = pairs_by_hand(docs)[1]
    docs = {d: t for d, t in docs.items() if group[d] == d}
    return {d: t for d, t in docs.items() if not any(p in dc.normal(t) for p in items)}


def test_pipeline(spark, sf):
    docs = {r.doc_id: (r.text, r.source) for r in table(spark, sf, "documents").collect()}
    items = [dc.normal(r.text) for r in table(spark, sf, "benchmark").collect()]
    want = by_hand(docs, items)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(want) and len(want) > 50
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]
    fill = Counter()
    for r in sorted(got, key=lambda r: r.offset):
        assert fill[r.sequence_id] == r.offset
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024
