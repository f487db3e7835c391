"""Operators 2 and 9: worked cases, brute force and odd inputs."""

import datetime as dt
import random

from daybook.llm import decontamination as dc
from daybook.llm import warc
from daybook.llm.common import table

RECORD = "record_id long, warc_type string, target_uri string, warc_date timestamp, http_status int, http_headers string, payload_digest string, verdict string"


def day(n, s=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, seconds=s)


def resolved(spark, *rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], RECORD)
    return {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}


def test_revisits(spark):
    ok, no = "HTTP/1.1 200 OK\r\n", "HTTP/1.1 304 Not Modified\r\n"
    got = resolved(
        spark,
        (1, "response", "http://www.A.com:80/x/?b=2&a=1&utm_source=q#f", day(0), 200, ok + 'ETag: "1"\r\nContent-Length: 9\r\nX: old\r\nVia: a\r\nVia: b\r\n', "d1"),
        (2, "response", "https://a.com/x?a=1&b=2", day(9), 200, ok + 'ETag: "2"\r\n', "d2"),
        (3, "revisit", "https://a.com/x?a=1&b=2", day(5), 304, no + 'ETag: W/"1"\r\nContent-Length: 0\r\nX: new\r\n', None),
        (4, "revisit", "https://a.com/x?a=1&b=2", day(9), 304, no + 'ETag: "2"\r\n', None),  # a tie is not earlier
        (5, "revisit", "https://a.com/x?a=1&b=2", day(9, 1), 304, no, None),
        (6, "revisit", "https://a.com/y", day(9), 304, no, "d"),
        (7, "revisit", None, day(9), 304, None, None),
        (8, "revisit", "https://a.com/x?a=1&b=2", None, 304, None, None),
        (9, "revisit", "https://a.com/x?a=1&b=2", day(9, 2), None, None, "d2"),
        (10, "response", "https://a.com/y", day(1), 404, ok, "d"),
    )
    assert {k: (r["verdict"], r["referred_id"]) for k, r in got.items()} == {
        3: ("resolved", 1), 4: ("changed", None), 5: ("unchecked", 2), 6: ("unresolved", None),
        7: ("unresolved", None), 8: ("unresolved", None), 9: ("resolved", 2),
    }
    assert got[3]["headers"] == {"etag": 'W/"1"', "content-length": "9", "x": "new", "via": "a, b"}


def test_slices_do_not_matter(spark, sf):
    rec = warc.records(table(spark, sf, "pages")).withColumn("target_uri", warc.F.lit("http://one.com/"))
    a, b = ({r["record_id"]: r for r in warc.resolve_revisits(rec, s).collect()} for s in (3_600, 10_000_000))
    assert a == b and len({r["referred_id"] for r in a.values()}) > 3
    assert warc.resolve_revisits(rec.limit(0)).count() == 0


def edited(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + "q" + text[at:], text[:at] + text[at + 1 :], text[:at] + "z" + text[at + 1 :]])
    return text


def distance(p, t):
    row = [0] * (len(t) + 1)
    for a in p:
        new = [row[0] + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edited_passages_are_found_and_nothing_else(spark, sf):
    rng = random.Random(5)
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    index = dc.Index(items)
    clean = [r.text for r in table(spark, sf, "documents").collect()][:40]
    texts, want = [], []
    for n, (item, text) in enumerate(items):
        budget = int(index.k[index.ids.index(item)])
        for edits in (0, budget // 2, budget, 3 * budget):
            texts.append(clean[n % 40][:200] + " " + edited(rng, dc.normal(text), edits) + " " + clean[n % 7][:150])
            want.append(item)
    got = {(m[0], m[1]): m[2] for m in dc.matches(index, [None, "", *texts])}
    for n, (item, text) in enumerate(zip(want, texts)):
        d = distance(dc.normal(dict(items)[item]), dc.normal(text))
        assert (d <= index.k[index.ids.index(item)]) == ((n + 2, item) in got)
        assert got.get((n + 2, item), d) == d


def test_counting_by_band_loses_nothing(monkeypatch):
    items = [(1, "ab" * 300), (2, "abcde" * 60), (3, "the quick brown fox jumps over the lazy dog again")]
    texts = ["ab" * 3000 + " x y", "zz " + "abcde" * 300 + "q" + "abcde" * 3, "the quick brown fox jumped over the lazy dog again", None]
    index, found = dc.Index(items), []
    for hits, dense in ((1 << 40, 1 << 40), (1000, 1 << 40), (1000, 50)):
        monkeypatch.setattr(dc, "HITS", hits)
        monkeypatch.setattr(dc, "DENSE", dense)
        found.append(list(dc.matches(index, texts)))
    assert found[0] == found[1] == found[2] and {m[:2] for m in found[0]} == {(0, 1), (1, 2), (2, 3)}


def test_a_repetitive_page_stays_small():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = list(dc.matches(dc.Index([(1, "ab" * 1000)]), ["ab" * 500_000]))
    assert [(m[0], m[1], m[2]) for m in got] == [(0, 1, 0)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # kilobytes: one GB


def test_short_items_match_as_whole_words():
    index = dc.Index([(1, "A cat!"), (2, "ca"), (3, "..."), (4, "a cat"), (5, None), (6, "twelve letters")])
    texts = ["see: a  CAT sat", "a cats", "acat", "a ca t", None, "", "twelve letters"]
    got = {(m[0], m[1], m[2], m[4], m[5]) for m in dc.matches(index, texts)}
    assert got == {(0, 1, 0, 5, 11), (0, 4, 0, 5, 11), (3, 2, 0, 2, 4), (6, 6, 0, 0, 14)}


def test_blocks_of_the_benchmark_do_not_matter(spark, sf, monkeypatch):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    one, kept = rows(dc.contaminated(docs, bench)), rows(dc.clean(docs, bench).select("doc_id"))
    monkeypatch.setattr(dc, "BLOCK", 4_000)
    assert rows(dc.contaminated(docs, bench)) == one and rows(dc.clean(docs, bench).select("doc_id")) == kept


def test_contaminated_and_clean(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    found = dc.contaminated(docs, bench).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    items = {r.item_id: r.text for r in bench.collect()}
    exact = {(d, i) for d, t in text.items() for i, p in items.items() if dc.normal(p) in dc.normal(t)}
    assert exact and exact <= {(r.doc_id, r.item_id) for r in found}
    for r in found:
        if r.edits == 0:
            assert dc.normal(text[r.doc_id][r.start : r.end]) == dc.normal(items[r.item_id])
    kept = {r.doc_id for r in dc.clean(docs, bench).collect()}
    assert kept == set(text) - {r.doc_id for r in found}
    odd = docs.selectExpr("cast(null as long) doc_id", "cast(null as string) text", "1 item_id").limit(2)
    assert dc.contaminated(odd, bench).count() == 0 and dc.clean(odd, bench).count() == 2
    assert dc.contaminated(docs.limit(0), bench).count() == 0 and dc.clean(docs, bench.limit(0)).count() == 200


def test_spans_where_letters_grow_in_lower_case():
    item = "the quick brown fox jumps over the lazy dog and runs away from the old grey wolf"
    index = dc.Index([(5, item)])
    for before in ("İ" * 10 + " ", "aİb " * 5, "", "ẞ İ, "):
        (_, _, edits, _, start, end), = dc.matches(index, [before + item.upper() + " end"])
        assert (edits, start, end) == (0, len(before), len(before) + len(item))


def test_headers_are_parsed_once(spark, sf):
    """What follows the written records parses no header block and no URL again."""
    out = warc.resolve_revisits(warc.records(spark.read.parquet(f"{sf}/pages.parquet")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and "regexp_extract" not in plan and out.count() > 0
