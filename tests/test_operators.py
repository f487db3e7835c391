"""Small tables with known answers for the archive, search, filter, date, result and evaluation operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from daybook.functions import dates as D
from daybook.functions.text import with_stem
from daybook.operators import corpus as C
from daybook.operators import evaluate as E
from daybook.operators import filters as L
from daybook.operators import results as R
from daybook.operators import search as S
from daybook.params import DEFAULT, GRID, Settings
from daybook.sources import archive as A
from daybook.streaming import toggles


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["the snow man stands in deep snow", "a dinosaur in the transmogrifier box", "man the box of snow goons", "", "the cat sleeps"] + ["filler words here"] * 20
    rows = [(i, dt.date(1988, 1, 1) + dt.timedelta(i), None, t, None, "a tiger watches the hose freeze" if i == 4 else "people walk outside" if i > 4 else None) for i, t in enumerate(texts)]
    return S.build(spark.createDataFrame(rows, "doc long, date date, id string, transcript string, alternate string, description string"))


def search(spark, corpus, *queries):
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    out = S.text_search(corpus, q).collect()
    return [sorted(((r.doc, r.score, r.source) for r in out if r.query_id == i), key=lambda x: -x[1]) for i in range(len(queries))]


def test_search(spark, corpus):
    phrase, typo, blank, told, mark = search(spark, corpus, "snow man", "transmogrifer", "  ", "freezes tiger", "###")
    assert phrase[0][0] == 0 and {d for d, _, _ in phrase} >= {0, 2}
    assert [d for d, _, _ in typo] == [1] and blank == mark == []
    assert told and told[0][0] == 4 and told[0][2] == "description"


def test_subsequence_breaks_runs_not_order():
    import numpy as np

    terms, pos, w = np.array([0, 1, 2]), np.array([4, 5, 6]), np.ones(3)
    assert S.subsequence([0, 1, 2], [False] * 3, terms, pos, w) == (3.0, 3.0)
    assert S.subsequence([0, 1, 2], [False, True, False], terms, pos, w) == (3.0, 2.0)


def restricted_distance(a, b):
    """Edits with neighbouring letters swapped as one, no letter edited twice, by the textbook table."""
    rows = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best = min(rows[i - 1, j] + 1, rows[i, j - 1] + 1, rows[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[i - 2, j - 2] + 1)
            rows[i, j] = best
    return rows[len(a), len(b)]


def test_edit_distance(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(0, 9)))
    pairs = [(word(), word()) for _ in range(3000)] + [("ca", "ac"), ("ca", "abc"), ("abcd", "badc"), ("", ""), ("abcdef", "badcef")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == min(3, restricted_distance(r.a, r.b)) for r in got) and {r.d for r in got} == {0, 1, 2, 3}


def test_fuzzy_expansion_finds_every_near_word(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 11))) for _ in range(900)})
    terms, vocab = words[::7], words
    got = S.expand_fuzzy(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([("transcript", w) for w in vocab], "corpus string, word string"))
    want = set()
    for t in terms:
        most = 0 if len(t) <= 3 else 1 if len(t) <= 7 else 2
        want |= {(t, w, 0.7 if d == 1 else 0.55) for w in vocab if w != t and (d := restricted_distance(t, w)) <= most}
    assert {(r.term, r.word, r.weight) for r in got.collect()} == want and len(want) > 50


def test_many_settings_at_once(spark, corpus):
    q = spark.createDataFrame([(0, "snow man"), (1, "freezes tiger"), (2, "the box of snow"), (3, "transmogrifer box")], "query_id long, query string")
    trials = [DEFAULT, DEFAULT.but(rarity_exponent=2.0), DEFAULT.but(description_idf_floor=0.25, description_preference=1.0), DEFAULT.but(transcript_inflection_weight=0.7, transcript_length_normalization=1.0)]
    rows = lambda df: sorted((r.query_id, r.doc, round(r.score, 9), r.source, r.field) for r in df.collect())
    together = S.text_search(corpus, q, Settings(tuple(trials)))
    for i, p in enumerate(trials):
        assert rows(together.where(F.col("setting") == i)) == rows(S.text_search(corpus, q, p)) != []


def test_stems(spark):
    same = [("hoping", "hope"), ("hopping", "hop"), ("hurries", "hurry"), ("houses", "house"), ("agreed", "agree"), ("boxes", "box"), ("dog's", "dogs"), ("played", "plays")]
    rows = spark.createDataFrame([(w,) for pair in same for w in pair] + [("care",), ("car",), ("bus",), ("string",)], "word string")
    got = {r.word: r.stem for r in with_stem(rows).collect()}
    assert all(got[a] == got[b] for a, b in same)
    assert got["care"] != got["car"] and got["bus"] == "bus" and got["string"] == "string"


def test_dates(spark):
    cases = {
        "august 3rd 1988": ([(1988, 8, 3, None)], "exact"), "8/3/88": ([(1988, 8, 3, None), (1988, 3, 8, None)], "exact"),
        "1988-08": ([(1988, 8, None, None)], "narrow"), "19880803": ([(1988, 8, 3, None)], "exact"), "1988": ([(1988, None, None, None)], "broad"),
        "sunday 1988": ([(1988, None, None, 0)], "narrow"), "monday aug 1 1988": ([(1988, 8, 1, 1)], "exact"),
    }
    none = ["88", "sunday aug 1 1988", "30 feb 1988", "snow 1988", "", None, "aug 1988 8 9", "2020", "9/3"]
    df = spark.createDataFrame([(t,) for t in [*cases, *none]], "t string")
    got = {r.t: r for r in D.parse_dates(df, "t", (1985, 1995)).collect()}
    for t, (want, precision) in cases.items():
        assert sorted(tuple(c) for c in got[t].candidates) == sorted(want) and got[t].precision == precision, t
    assert all(got[t].candidates is None for t in none)


def test_filter_texts(spark):
    q = spark.createDataFrame([(1, "snow @year:88 @nope:@month:1 man @SUNDAY"), (2, "@after:1990 @after:1989-02 @month:13")], "query_id long, query string")
    found = L.extract_filters(q, (1985, 1995))
    rest = {r.query_id: (r.residual, list(r.segments)) for r in L.residual(q, found).collect()}
    assert rest == {1: ("snow @nope:@month:1 man", ["snow", "@nope:@month:1 man"]), 2: ("", [])}
    spec = {r.query_id: r for r in L.fold_filters(found).collect()}
    assert spec[1].years == [1988] and spec[1].weekdays == [0] and not spec[1].impossible
    assert spec[2].after == dt.date(1989, 2, 28) and spec[2].impossible
    assert {r.token for r in L.canonical_filters(found).collect()} == {"@year:1988", "@sunday"}


def test_tiers_and_snippets(spark):
    df = spark.createDataFrame([(1, dt.date(2000, 1, i), None, s) for i, s in ((1, 10.0), (2, 7.0), (3, 7.0), (4, 1.0))], "query_id int, date date, id string, score double")
    tiers = lambda mode: [r.tier for r in R.assign_tiers(df, mode).orderBy("date").collect()]
    assert tiers("steps") == [5, 4, 4, 1] and tiers("fifths") == [5, 4, 4, 1] and tiers("stretch") == [5, 4, 4, 1] and tiers("quantile") == [5, 4, 4, 2]
    text = spark.createDataFrame([("a<b & c", [(0, 1), (0, 3), (4, 5)])], "text string, ranges array<struct<start:int,end:int>>")
    assert R.render_snippets(text).first().html == "<mark>a</mark>&lt;b <mark>&amp;</mark> c"


def test_evaluation(spark):
    day = lambda i: dt.date(2000, 1, i)
    res = spark.createDataFrame([(1, day(1), 1, "transcript"), (1, day(2), 2, "transcript"), (2, day(3), 1, "description")], "query_id int, date date, position int, source string")
    lab = spark.createDataFrame([(1, "a", day(2), "E", day(1)), (2, "b", day(3), "A", None), (3, "c", day(4), "A", None), (4, "d", None, "D", None)], "query_id int, query string, date date, class string, decoy date")
    got = E.evaluate(res, lab).first()
    assert (got.queries, got.mrr, got.recall_at_1, got.zero_rate, got.median_results) == (3, pytest.approx(0.5), pytest.approx(1 / 3), pytest.approx(1 / 3), 1)
    assert E.near_miss_outcomes(res, lab).first().outcome == "decoy_wins"
    assert E.assign_split(spark.createDataFrame([("1985-11-18",)], "k string"), F.col("k")).first().split in ("test", "train")


def test_sweep(spark):
    asked = []

    def score(trials):
        asked.extend(trials)
        return [{"recited": r, "described": -abs(p.description_min_mass - 1.5), "combined": r - (p.run_weight == 0)} for p in trials for r in [-abs(p.run_weight - 1)]]

    grid = {"run_weight": GRID["run_weight"], "description_min_mass": GRID["description_min_mass"]}
    best, value, log = E.sweep(score, DEFAULT, grid)
    assert (best.run_weight, best.description_min_mass, value["recited"]) == (1.0, 1.5, 0)
    assert len(log) == 2 * (4 + 4) and len(asked) == len(set(asked))  # nothing is searched twice
    trials = spark.createDataFrame(log, E.LOG)
    ok = {(r.turn, r.knob, r.value) for r in E.accepted(trials).collect()}
    assert ok == {(1, "run_weight", 1.0), (1, "description_min_mass", 0.0), (1, "description_min_mass", 1.0), (1, "description_min_mass", 1.5)} - {
        (t, k, v) for t, k, v, _, gain, _, _ in log if gain <= 0.005
    }
    blocked, _, log = E.sweep(score, DEFAULT, grid, allowed=lambda p: p.run_weight != 1)
    assert blocked.run_weight != 1 and any(row[-1] for row in log)
    moves = E.confirm(DEFAULT, best, score, grid)
    assert [(m[0], m[2], m[3], m[4]) for m in moves] == [("run_weight", 1.0, True, False), ("description_min_mass", 1.5, True, False)]
    assert not E.accept(0.01, -0.1, False) and not E.accept(0.005, 0, False) and not E.accept(1, 0, True) and E.accept(1, 0, False)


def test_guards(spark):
    n = lambda *rows: spark.createDataFrame(rows, "query_id int, n int")
    none = n((1, 5)).where("false")
    assert E.check_guards(none, n((1, 5)), n((1, 2))).collect() == []
    assert {r.guard for r in E.check_guards(n((1, 5)), n((1, 0)), n((1, 0))).collect()} == {"monotonicity", "empty_probe", "idle_correction"}


def test_corrections(spark):
    said = spark.createDataFrame([(1, "snow"), (2, "snows"), (3, "snowman"), (4, "show")], "doc int, word string")
    res = spark.createDataFrame([(7, d) for d in (1, 2, 3, 4)], "query_id int, doc int")
    got = E.corrections(res, said, spark.createDataFrame([(7, "snow")], "query_id int, query string"))
    assert [r.doc for r in got.collect()] == [4]


def test_dates_meet_by_their_parts(spark):
    days = spark.sql("select explode(sequence(date'1996-01-01', date'1996-12-31')) as date")
    part = lambda **k: [tuple(k.get(x) for x in ("year", "month", "day", "weekday"))]
    rows = [(1, part(month=2, weekday=0)), (2, part(day=31)), (3, part(year=1996, month=2, day=30)), (4, part()), (5, part(month=5) + part(day=1))]
    e = spark.createDataFrame(rows, "k int, candidates array<struct<year:int,month:int,day:int,weekday:int>>")
    n = {r.k: r["count"] for r in L.match_dates(days, e, "k").groupBy("k").count().collect()}
    assert n == {1: 4, 2: 7, 4: 366, 5: 31 + 11}


def test_label_source_and_log_sink(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "a", "query": "x", "class": "A"}\n\nnot json\n{"id": "b", "query": "y"}\n')
    good, bad = A.load_labelled(spark, str(tmp_path / "q.jsonl"))
    assert {r.id for r in good.collect()} == {"a", "b"} and [(r.line, r.value) for r in bad.collect()] == [(3, "not json")]
    for _ in range(2):
        A.append_log(good, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert A.load_optional(spark, str(tmp_path / "none"), A.DESCRIPTIONS).count() == 0
    A.write_archive(good, str(tmp_path / "out"), "json")


def test_toggle_stream(spark, tmp_path, sf):
    src = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type")
    src.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run goes on from the first one's state with twice the events
        stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
        query = toggles.start(stream, str(tmp_path / "state"), str(tmp_path / "ck"))
        query.processAllAvailable()
        query.stop()
        rows = spark.read.parquet(str(tmp_path / "in"))
        assert {tuple(r) for r in toggles.latest(spark, str(tmp_path / "state")).collect()} == {tuple(r) for r in toggles.toggle_state(rows).collect()}
        src.limit(100).write.mode("append").parquet(str(tmp_path / "in"))


def test_compounds(spark):
    t = spark.createDataFrame([(1, "snow man snow man"), (2, "a snow man"), (3, "snowman")], "doc long, text string")
    assert [tuple(r) for r in C.mine_compounds(t, []).collect()] == [("snowman", "snow", "man")]


def test_shared_folder():
    from types import SimpleNamespace

    from daybook import tables

    context = SimpleNamespace(master="spark://host:7077", getConf=dict, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        tables.shared_dir(SimpleNamespace(sparkContext=context))
    context.getConf = lambda: {"spark.checkpoint.dir": "file:///shared/"}
    assert tables.shared_dir(SimpleNamespace(sparkContext=context)) == "file:///shared"


def test_written_tables_leave_the_session_as_it_was(spark):
    from daybook import tables

    before = {k: spark.conf.get(k, None) for k in tables.WRITING}
    df = tables.settle(spark.range(5))
    assert {k: spark.conf.get(k, None) for k in tables.WRITING} == before and df.count() == 5
    tables.discard(df)


def test_recitation_matches_every_span_tried(spark):
    import re
    import time

    dice = random.Random(6)
    some = lambda n: " ".join(dice.choice(["a", "ba", "ab", "cab", "d'e"]) for _ in range(n))
    rows = [(i, some(dice.randrange(1, 12)), some(dice.randrange(0, 60))) for i in range(60)] + [(90, "--", "a b"), (91, "a a b", "")]
    for r in E.recite(spark.createDataFrame(rows, "k int, query string, text string")).collect():
        q, t = (re.findall("[a-z']+", x) for x in (r.query, r.text))
        spans = [b - a for a in range(len(q)) for b in range(a + 1, len(q) + 1) if " ".join(q[a:b]) in " ".join(t)]
        assert (r.run, r.length, r.share) == (max(spans, default=0), len(q), len(q) / max(1, len(t)))
        assert r.overlap == (sum(w in t for w in q) / len(q) if q else None)
    text = " ".join(f"w{i % 997}" for i in range(5000))
    began = time.time()
    row = E.recite(spark.createDataFrame([("x " + " ".join(text.split()[500:1500]) + " y", text)], "query string, text string")).first()
    assert (row.run, row.length) == (1000, 1002) and time.time() - began < 20
