"""Ranked search of a whole table of queries against a corpus of strips.

Tables that depend on the parameters carry a column setting, so one search serves many settings (params.Settings)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import COMPOUNDS, let, parts, with_stem
from ..params import DEFAULT, Params, Settings, settings
from ..tables import fit, settle
from . import corpus as C

FIELD = ["setting", "query_id", "corpus", "doc", "field"]
ROUTES = ("prefix", "fuzzy", "stem")


@dataclass(frozen=True)
class Corpus:
    """Written tables of one corpus: make them once and search many times."""

    strips: DataFrame
    tokens: DataFrame
    vocab: DataFrame
    stats: DataFrame


def build(strips: DataFrame, lexicon: dict[str, list[str]] | None = COMPOUNDS) -> Corpus:
    """Texts are split into words once; the vocabulary and the statistics are read from that table."""
    tokens = settle(C.tokenised(strips, lexicon))
    return Corpus(strips, tokens, settle(C.vocabulary(tokens)), settle(C.corpus_stats(tokens)))


def query_terms(queries: DataFrame, lexicon: dict[str, list[str]] | None = COMPOUNDS) -> DataFrame:
    """(query_id, seq, term, term_no, breaks): words of queries(query_id, query[, segments]) in order.

    term_no numbers distinct terms by first use; breaks is true where a new segment of the query starts.  A query without words has no rows.
    """
    segments = F.col("segments") if "segments" in queries.columns else F.array("query")
    one = queries.select("query_id", F.posexplode(segments).alias("segment", "s"))
    one = one.select("query_id", "segment", F.posexplode(parts(F.trim("s"), lexicon)).alias("at", "p"))
    own = Window.partitionBy("query_id").orderBy("segment", "at")
    one = one.select("query_id", (F.row_number().over(own) - 1).alias("seq"), F.col("p.word").alias("term"), ((F.col("at") == 0)).alias("opens"))
    first = one.withColumn("first", F.min("seq").over(Window.partitionBy("query_id", "term")))
    number = F.dense_rank().over(Window.partitionBy("query_id").orderBy("first")) - 1
    return first.select("query_id", "seq", "term", number.alias("term_no"), (F.col("opens") & (F.col("seq") > 0)).alias("breaks"))


def _with_lengths(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """vocab with the lengths that terms have, one array in one row, whatever the number of terms."""
    return vocab.crossJoin(F.broadcast(terms.agg(F.collect_set(F.length("term")).alias("lengths"))))


def expand_prefix(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(corpus, term, word, weight, route): the term itself at 1, longer words that start with it at 0.85.

    Each word meets terms through its own prefixes of the lengths that terms have, an equi join."""
    asked = terms.select("term").distinct()
    cut = F.transform(F.filter("lengths", lambda n: n <= F.length("word")), lambda n: F.substring(F.col("word"), F.lit(1), n))
    pre = _with_lengths(vocab.select("corpus", "word"), asked).select("corpus", "word", F.explode(cut).alias("term"))
    met = pre.join(asked, "term")
    same = F.col("term") == F.col("word")
    return met.select("corpus", "term", "word", F.when(same, 1.0).otherwise(0.85).alias("weight"), F.when(same, "exact").otherwise("prefix").alias("route"))


#: Names of letters left are numbers in this base; query names up to which a table of bits keeps other names from leaving the tasks.
BASE, NAMES = np.uint64(0x9E3779B97F4A7C15), 1 << 20


def _left(letters: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Names of words of one length, a row of letters each, then of what is left of them after one or two deletions, the second one behind
    the first.  Each name is put together from those of stretches, for all the words at once."""
    size, ahead, power = letters.shape[1], [np.zeros(len(letters), np.uint64)], [np.uint64(1)]
    with np.errstate(over="ignore"):
        for i in range(size):
            ahead.append(ahead[-1] * BASE + letters[:, i])
            power.append(power[-1] * BASE)
        between = lambda i, j: ahead[j] - ahead[i] * power[j - i]
        yield ahead[size]
        for i in range(size if most else 0):
            yield ahead[i] * power[size - 1 - i] + between(i + 1, size)
            for j in range(i + 1, size if most > 1 else 0):
                yield (ahead[i] * power[j - i - 1] + between(i + 1, j)) * power[size - 1 - j] + between(j + 1, size)


def _bit(names: np.ndarray, size: int) -> np.ndarray:
    """The place of names among 2 ** size bits."""
    return names * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - size)


def _deletions(words: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """words(word, reach, ...) once for each name, key, of the word and of what is left of it after up to reach deletions; with bits only
    those whose bit is set.  Equal strings have equal names; where different ones do, the distance tells them apart."""
    held = None if bits is None else words.sparkSession.sparkContext.broadcast(bits)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_, reach = batch.column("word"), batch.column("reach").to_numpy()
            sizes = pc.utf8_length(words_).to_numpy()
            rows, keys, n = [], [], 0
            for size, most in sorted(set(zip(sizes.tolist(), reach.tolist(), strict=True))):
                own = np.flatnonzero((sizes == size) & (reach == most))
                letters = np.array(words_.take(pa.array(own)).to_pylist(), f"U{size}").view(np.uint32).reshape(len(own), size)
                for names in _left(letters, most):
                    if held is not None:
                        at = _bit(names, int(len(held.value) * 8).bit_length() - 1)
                        on = np.flatnonzero(held.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                        names, met = names[on], own[on]
                    else:
                        met = own
                    rows.append(met)
                    keys.append(names)
                    n += len(met)
                    if n > 1 << 18:
                        yield batch.take(pa.array(np.concatenate(rows))).append_column("key", pa.array(np.concatenate(keys).view(np.int64)))
                        rows, keys, n = [], [], 0
            if n:
                yield batch.take(pa.array(np.concatenate(rows))).append_column("key", pa.array(np.concatenate(keys).view(np.int64)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema.fields)
    return words.mapInArrow(name, f"{kinds}, key long")


def _bits(keys: DataFrame) -> np.ndarray | None:
    """Bits that are set for keys(key), sixteen bits a key or more; None for so many keys that the bits would be no help."""
    n = keys.count()
    if n > NAMES:
        return None
    size = max(16, (16 * n).bit_length())
    bits = np.zeros(1 << size, bool)
    bits[_bit(keys.toPandas()["key"].to_numpy(np.int64).view(np.uint64), size)] = True
    return np.packbits(bits, bitorder="little")


def _swapped(x: Column, y: Column) -> Column:
    """Whether x and y differ by one swap of neighbouring letters and nothing else."""
    letters = lambda w: F.split(w, "")
    at = F.array_position(F.zip_with(letters(x), letters(y), lambda p, q: p != q), True).cast("int")
    tail = lambda w, i: F.substring(w, i, F.length(w))
    pair = lambda w: F.substring(w, at, F.lit(2))
    same = (F.length(x) == F.length(y)) & (at > 0)
    return F.coalesce(same & (pair(x) == F.reverse(pair(y))) & (F.length(pair(x)) == 2) & (tail(x, at + 2) == tail(y, at + 2)), F.lit(False))


def edit_distance(a: Column, b: Column) -> Column:
    """0, 1 or 2 edits between a and b, 3 for more; a swap of neighbours is one edit, and no letter is edited twice.

    Two edits with a swap among them: behind the letters that both begin with, the first edit is the swap, or it
    replaces, drops or adds a letter and the rest is a swap."""

    def beyond(x: Column, y: Column) -> Column:
        tail = lambda w, i: F.substring(w, F.lit(i), F.length(w))
        head = (F.length(x) > 1) & (F.length(y) > 1) & (F.left(x, F.lit(2)) == F.reverse(F.left(y, F.lit(2))))
        rest = (F.levenshtein(tail(x, 3), tail(y, 3), 1) >= 0) | _swapped(tail(x, 3), tail(y, 3))
        return (head & rest) | _swapped(tail(x, 2), tail(y, 2)) | _swapped(tail(x, 2), y) | _swapped(x, tail(y, 2))

    def behind(pair: Column) -> Column:
        letters = lambda w: F.split(w, "")
        at = F.array_position(F.zip_with(letters(pair["a"]), letters(pair["b"]), lambda p, q: ~p.eqNullSafe(q)), True).cast("int")
        cut = lambda w: F.substring(w, at, F.length(w))
        return let(F.struct(cut(pair["a"]).alias("x"), cut(pair["b"]).alias("y")), lambda s: beyond(s["x"], s["y"]))

    near = F.levenshtein(a, b, 2)
    two = (near == 2) | let(F.struct(a.alias("a"), b.alias("b")), behind)
    return F.when(near.isin(0, 1), near).when(_swapped(a, b), 1).when(two, 2).otherwise(3)


def expand_fuzzy(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Words within 1 edit of terms of 4 to 7 letters (0.7), 2 of longer ones (0.55), none of shorter.

    Term and word meet on a shared deletion, then the distance decides.  Words of a length that no term comes near leave first."""
    allowed = F.when(F.length("term") <= 3, 0).when(F.length("term") <= 7, 1).otherwise(2)
    asked = terms.select("term").distinct().withColumn("most", allowed).where("most > 0")
    reach = F.when(F.length("word") >= 6, 2).when(F.length("word") >= 3, 1).otherwise(0)
    sizes = {r[0] + d for r in asked.select(F.length("term")).distinct().collect() for d in range(-2, 3)}
    known = vocab.where(F.length("word").isin(*sorted(sizes))).select("corpus", "word", reach.alias("reach"))
    asked = settle(_deletions(asked.select(F.col("term").alias("word"), F.col("most").alias("reach"))).distinct())
    known = _deletions(known, _bits(asked.select("key").distinct())).drop("reach")
    asked = asked.select(F.col("word").alias("term"), F.col("reach").alias("most"), "key")
    met = known.join(fit(asked, 96), "key").where("word <> term and abs(length(word) - length(term)) <= most")
    met = met.select("corpus", "term", "word", "most").distinct().where("levenshtein(word, term) <= 2 * most")  # a swap is two edits there
    met = met.withColumn("d", edit_distance(F.col("word"), F.col("term"))).where("d <= most")
    return met.select("corpus", "term", "word", F.when(F.col("d") == 1, 0.7).otherwise(0.55).alias("weight"), F.lit("fuzzy").alias("route"))


def expand_inflection(terms: DataFrame, vocab: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Words with the term's stem, at the corpus's weight; none where it is 0."""
    value = F.coalesce(*(F.when(F.col("corpus") == c, F.lit(w)) for c, w in weights.items()), F.lit(0.0))
    asked = with_stem(terms.select("term").distinct(), "term", "stem")
    met = vocab.select("corpus", "word", "stem").join(asked, "stem").withColumn("weight", value).where("weight > 0")
    return met.select("corpus", "term", "word", "weight", F.lit("stem").alias("route"))


def reached(terms: DataFrame, vocab: DataFrame, routes: tuple[str, ...] = ROUTES) -> DataFrame:
    """(corpus, term, word, w, f, s, idf): what each route says of a pair, before any parameter: the weight by an exact or
    prefix match, by edits, and whether the stems agree.  Distinct terms of the whole query table are expanded once."""
    rows = expand_prefix(terms, vocab)
    rows = rows.unionByName(expand_fuzzy(terms, vocab)) if "fuzzy" in routes else rows
    rows = rows.unionByName(expand_inflection(terms, vocab, {"transcript": 1.0, "description": 1.0})) if "stem" in routes else rows
    of = lambda *names: F.max(F.when(F.col("route").isin(*names), F.col("weight")))
    one = rows.groupBy("corpus", "term", "word").agg(of("exact", "prefix").alias("w"), of("fuzzy").alias("f"), of("stem").alias("s"))
    return one.join(vocab.select("corpus", "word", "idf"), ["corpus", "word"])


def expand(pairs: DataFrame, p: Params | Settings = DEFAULT) -> DataFrame:
    """(setting, corpus, term, word, weight, literal, contribution, idf) of reached pairs: an edit route counts only without an
    exact or prefix one; a stem lifts the weight to the corpus's, where that is over 0."""
    p = settings(p)
    return weighed(p.spread(pairs), p).select("setting", "corpus", "term", "word", "weight", "literal", "contribution", "idf")


def weighed(pairs: DataFrame, p: Settings) -> DataFrame:
    """pairs(setting, corpus, w, f, s, idf, ...) that count in their setting, with weight, literal and contribution instead of w, f, s."""
    stem = p.by_corpus("inflection_weight")
    one = pairs.withColumn("s", F.when((stem > 0) & F.col("s").isNotNull(), stem)).where("w is not null or f is not null or s is not null")
    weight = F.greatest(F.coalesce("w", "f", F.lit(0.0)), F.coalesce("s", F.lit(0.0)))
    one = one.withColumns({"weight": weight, "literal": F.col("w").isNotNull() | F.col("s").isNotNull()}).drop("w", "f", "s")
    return one.withColumn("contribution", F.col("weight") * F.pow("idf", p.of("rarity_exponent")))


def anchors(expansion: DataFrame, p: Params | Settings = DEFAULT) -> DataFrame:
    """(setting, corpus, term, rarity, ceiling, suppressed) per expanded term: its own idf and contribution if it is a word, else
    those of its largest contribution.  Description terms below the floor are suppressed."""
    own = F.col("term") == F.col("word")
    best = F.max_by("idf", F.struct("contribution", "idf"))
    one = expansion.groupBy("setting", "corpus", "term").agg(
        F.max(F.when(own, F.col("idf"))).alias("i"), F.max(F.when(own, F.col("contribution"))).alias("c"),
        F.max("contribution").alias("top"), best.alias("bi"),
    )
    rarity = F.coalesce("i", F.when(F.col("top") > 0, F.col("bi")).otherwise(0.0))
    one = one.select("setting", "corpus", "term", rarity.alias("rarity"), F.coalesce("c", "top").alias("ceiling"))
    floor = (F.col("corpus") == "description") & (F.col("rarity") < settings(p).of("description_idf_floor"))
    return one.withColumn("suppressed", floor).withColumn("ceiling", F.when(floor, 0.0).otherwise(F.col("ceiling")))


def denominators(terms: DataFrame, anchor: DataFrame, stats: DataFrame, p: Params | Settings = DEFAULT) -> DataFrame:
    """(setting, query_id, corpus, term, term_no, ceiling, rarity): a term absent here but present in the other corpus counts as the rarest."""
    p = settings(p)
    both = p.spread(terms.select("query_id", "term", "term_no").distinct())
    wide = anchor.groupBy("setting", "term").agg(
        *(
            F.max(F.when(F.col("corpus") == c, F.col(v))).alias(f"{c}_{v}")
            for c in ("transcript", "description")
            for v in ("ceiling", "rarity")
        )
    )
    both = both.join(wide, ["setting", "term"], "left")
    out = both.crossJoin(F.broadcast(stats.select("corpus", "n_docs")))  # two rows
    here = F.when(F.col("corpus") == "transcript", F.col("transcript_ceiling")).otherwise(F.col("description_ceiling"))
    there = F.when(F.col("corpus") == "transcript", F.col("description_ceiling")).otherwise(F.col("transcript_ceiling"))
    rarity = F.when(F.col("corpus") == "transcript", F.col("transcript_rarity")).otherwise(F.col("description_rarity"))
    absent = F.pow(F.greatest(F.lit(0.0), F.log("n_docs")), p.of("rarity_exponent"))
    ceiling = F.when(here.isNotNull(), here).when(there.isNotNull(), absent).otherwise(0.0)
    return out.select("setting", "query_id", "corpus", "term", "term_no", ceiling.alias("ceiling"), F.coalesce(rarity, F.lit(0.0)).alias("rarity"))


def thresholds(denoms: DataFrame, p: Params | Settings = DEFAULT) -> DataFrame:
    """(setting, query_id, corpus, total, live, effective, required): the coverage that a field has to reach."""
    p = settings(p)
    one = denoms.groupBy("setting", "query_id", "corpus").agg(
        F.sum("ceiling").alias("total"), F.count_if(F.col("ceiling") > 0).alias("live"), F.max("ceiling").alias("top")
    )
    one = one.withColumn("effective", F.when(F.col("top") > 0, F.col("total") / F.col("top")).otherwise(0.0)).drop("top")
    floor, give = p.by_corpus("coverage_floor"), p.by_corpus("length_forgiveness")
    required = F.when(F.col("effective") == 0, 0.0).otherwise(floor + (1 - floor) / F.pow("effective", give))
    return one.withColumn("required", required)


def unsuppressed(expansion: DataFrame, anchor: DataFrame) -> DataFrame:
    """The expansion without suppressed terms, which is also what keeps very common words from the joins."""
    return expansion.join(anchor.where("not suppressed").select("setting", "corpus", "term"), ["setting", "corpus", "term"], "left_semi")


def hits(tokens: DataFrame, live: DataFrame, terms: DataFrame, gated: DataFrame | None = None) -> DataFrame:
    """(setting, query_id, corpus, doc, field, pos, token, term_no, weight, contribution, literal) for every word that a term
    reaches, in all fields or in those of gated only, whose words meet no other query's terms."""
    asked = fit(terms.select("query_id", "term", "term_no").distinct().join(live, "term"), 160)
    out = [*FIELD, "pos", "token", "term_no", "weight", "contribution", "literal"]
    if gated is None:
        return C.postings(tokens).join(asked, ["corpus", "word"]).select(*out)
    own = tokens.join(fit(gated.select(*FIELD), 160), ["corpus", "doc", "field"])
    own = own.select(*FIELD, F.posexplode("parts").alias("pos", "p")).select(*FIELD, "pos", "p.token", "p.word")
    return own.join(asked, ["setting", "query_id", "corpus", "word"]).select(*out)


def heads(denoms: DataFrame, limits: DataFrame) -> DataFrame:
    """(setting, query_id, corpus, term): a field that reaches the required coverage has one of these terms at least.

    From the largest ceiling down, a term is a head while it and the terms behind it could still reach what is required: all that
    come later cannot, even together."""
    rest = Window.partitionBy("setting", "query_id", "corpus").orderBy("ceiling", "term_no")
    ends = denoms.withColumn("rest", F.sum("ceiling").over(rest)).join(limits, ["setting", "query_id", "corpus"])
    return ends.where(F.col("rest") >= F.col("required") * F.col("total") * (1 - 1e-9)).select("setting", "query_id", "corpus", "term")


def summarise(counts: DataFrame, live: DataFrame, denoms: DataFrame, limits: DataFrame, p: Params | Settings = DEFAULT, head: DataFrame | None = None) -> DataFrame:
    """Per query and field: base, achieved, matched, coverage, literal_share and the limits.

    counts has the words of each field (corpus.word_counts, dealt by document).  What a field holds of a term does not
    depend on the query, so it is summed once for all queries that have the term, per contribution (one word of one term), then
    per term, then per query.  Every key holds the document, so the sums need no shuffle but that of counts.  With head (see
    heads) only fields with a head term of a query are summed for it, which leaves out none that the gate would pass."""
    p = settings(p)
    where = ["setting", *C.WHERE]
    word = counts.join(fit(live.select("setting", "corpus", "word", "term", "contribution", "literal"), 160), ["corpus", "word"]).groupBy(*where, "term", "contribution").agg(F.sum("n").alias("n"), F.max("literal").alias("literal"))
    term = word.groupBy(*where, "term").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("contribution").alias("best"), F.max("literal").alias("literal"))
    asked = fit(denoms.select("setting", "query_id", "corpus", "term", "ceiling"), 160)
    if head is None:
        term = term.join(asked, ["setting", "corpus", "term"])
    else:
        own = term.groupBy(*where).agg(F.collect_list(F.struct("term", "n", "most", "best", "literal")).alias("own"))
        met = own.select(*where, "own", F.explode("own.term").alias("term")).join(fit(head, 160), ["setting", "corpus", "term"])
        met = met.groupBy(*where).agg(F.first("own").alias("own"), F.collect_set("query_id").alias("queries"))
        met = met.select(*where, "own", F.explode("queries").alias("query_id")).select(*FIELD, F.inline("own"))
        term = met.join(asked, ["setting", "query_id", "corpus", "term"])
    times = F.col("most") + p.of("repeat_variety") * (F.col("n") - F.col("most"))
    got = F.least("best", "ceiling")
    field = term.groupBy(*FIELD).agg(
        F.sum(got * (1 + p.by_corpus("repeat_weight") * F.log2(times))).alias("base"), F.sum(got).alias("achieved"), F.count("*").alias("matched"),
        F.count_if(F.col("literal") & (F.col("ceiling") > 0)).alias("literal_terms"),
    )
    return covered(field, limits)


def covered(field: DataFrame, limits: DataFrame) -> DataFrame:
    """field(setting, query_id, corpus, achieved, literal_terms, ...) with the limits, coverage and literal_share."""
    return shares(field.join(fit(limits, 160), ["setting", "query_id", "corpus"]))


def shares(field: DataFrame) -> DataFrame:
    """field(achieved, literal_terms, total, live, ...) with coverage and literal_share."""
    share = F.when(F.col("live") > 1, F.col("literal_terms") / F.col("live")).otherwise(1.0)
    coverage = F.when(F.col("total") > 0, F.col("achieved") / F.col("total")).otherwise(0.0)
    return field.withColumn("coverage", coverage).withColumn("literal_share", share)


def gate(summary: DataFrame, p: Params | Settings = DEFAULT) -> DataFrame:
    """Fields that pass: enough coverage and literal terms, and for descriptions enough rarity per matched term."""
    p = settings(p)
    passed = (F.col("total") > 0) & (F.col("coverage") >= F.col("required")) & (F.col("literal_share") >= p.by_corpus("literal_share"))
    mass = F.col("achieved") / F.pow(F.greatest(F.lit(1), "matched"), p.of("description_mass_normalization"))
    return summary.where(passed & ((F.col("corpus") == "transcript") | (mass >= p.of("description_min_mass"))))


def subsequence(order: list[int], breaks: list[bool], terms: np.ndarray, positions: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(lcs, run): the heaviest common subsequence of the query's terms and the hits, and the heaviest unbroken stretch.

    Only the first needs a step a word.  Stretches are chains of pairs of a query's word and a hit, each behind the pair of the word and the hit
    before it: they lie together once such pairs are in the order of hit minus word, so all are summed at once."""
    asked, best = np.asarray(order, np.int64), np.zeros(len(terms) + 1)
    live = np.flatnonzero(weights > 0)
    live = live[np.argsort(terms[live], kind="stable")]
    by, own, up = terms[live], weights[live], live + 1
    first, last = np.searchsorted(by, asked), np.searchsorted(by, asked, "right")
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if a < b:
            at = up[a:b]
            best[at] = np.maximum(best[live[a:b]] + own[a:b], best[at])
            np.maximum.accumulate(best[at[0] :], out=best[at[0] :])
    many = last - first
    if not many.any():
        return 0.0, 0.0
    seq = np.repeat(np.arange(len(asked)), many)
    hit = live[np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(seq))]
    seq, hit, alone = seq[behind := (seq > 0) & (hit > 0)], hit[behind], float(weights[hit].max())
    follows = (positions[hit] - 1 == positions[hit - 1]) & (terms[hit - 1] == asked[seq - 1]) & (weights[hit - 1] > 0) & ~np.asarray(breaks, bool)[seq]
    if not follows.any():
        return float(best[-1]), alone
    seq, hit = seq[follows], hit[follows]
    chain = np.lexsort((hit, hit - seq))
    seq, hit = seq[chain], hit[chain]
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(seq) != 1) | (np.diff(hit) != 1))))
    return float(best[-1]), max(alone, float((weights[hit[starts] - 1] + np.add.reduceat(weights[hit], starts)).max()))


def ordered_subsequence(hit: DataFrame, terms: DataFrame) -> DataFrame:
    """(setting, query_id, corpus, doc, field, lcs, run, n_seq) of hits in gated fields: one row of hits per field, in Arrow batches."""
    line = terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("seq", "term_no", "breaks"))).alias("q"))
    own = hit.groupBy(*FIELD).agg(F.array_sort(F.collect_list(F.struct("pos", "term_no", "weight"))).alias("h")).join(fit(line, 1000), "query_id")
    flat = own.select(*FIELD, F.col("q.term_no").alias("o"), F.col("q.breaks").alias("b"), F.col("h.term_no").alias("t"), F.col("h.pos").alias("p"), F.col("h.weight").alias("w"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [
                subsequence(list(o), list(b), np.asarray(t), np.asarray(x), np.asarray(w, float))
                for o, b, t, x, w in zip(batch["o"], batch["b"], batch["t"], batch["p"], batch["w"], strict=True)
            ]
            yield batch[FIELD].assign(lcs=[g[0] for g in got], run=[g[1] for g in got], n_seq=batch["o"].map(len))

    kinds = ", ".join(f"{c} {flat.schema[c].dataType.simpleString()}" for c in FIELD)
    return flat.mapInPandas(score, f"{kinds}, lcs double, run double, n_seq int")


def runs(hit: DataFrame, terms: DataFrame) -> DataFrame:
    """(setting, query_id, corpus, doc, field, run) by windows: islands of steps by one in query, hit list and position."""
    own = Window.partitionBy(*FIELD).orderBy("pos", "term_no")
    col = hit.withColumn("col", F.row_number().over(own)).withColumn("before", F.lag("pos").over(own))
    pair = col.join(terms.select("query_id", "term_no", "seq", "breaks"), ["query_id", "term_no"])
    diagonal = Window.partitionBy(*FIELD, F.col("col") - F.col("seq")).orderBy("col")
    follows = (F.lag("col").over(diagonal) == F.col("col") - 1) & (F.col("before") == F.col("pos") - 1) & ~F.col("breaks")
    island = pair.withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("diag", F.col("col") - F.col("seq"))
    island = island.withColumn("island", F.sum("new").over(Window.partitionBy(*FIELD, "diag").orderBy("col")))
    return island.groupBy(*FIELD, "diag", "island").agg(F.sum("weight").alias("w")).groupBy(*FIELD).agg(F.max("w").alias("run"))


def score_fields(gated: DataFrame, sequence: DataFrame, lengths: DataFrame, stats: DataFrame, p: Params | Settings = DEFAULT) -> DataFrame:
    """Adds strength (pivoted by field length) and the sequence multiplier (1 for descriptions)."""
    out = gated.join(lengths, ["doc", "corpus", "field"]).join(F.broadcast(stats.select("corpus", "avg_len")), "corpus")
    return strengths(out.join(sequence, FIELD, "left"), p)


def length_pivot(p: Params | Settings = DEFAULT) -> Column:
    """By how much a field of length len is divided where avg_len is the mean."""
    b = settings(p).by_corpus("length_normalization")
    return F.when((b == 0) | (F.col("avg_len") == 0), 1.0).otherwise(F.greatest(F.lit(0.01), 1 - b + b * F.col("len") / F.col("avg_len")))


def strengths(rows: DataFrame, p: Params | Settings = DEFAULT) -> DataFrame:
    """rows(base, total, len, avg_len, lcs, run, n_seq, ...) with strength and multiplier."""
    p = settings(p)
    out = rows.withColumn("strength", F.col("base") / F.col("total") / length_pivot(p))
    bonus = 1 + p.of("sequence_weight") * F.col("lcs") / F.col("n_seq") + p.of("run_weight") * F.pow(F.col("run") / F.col("n_seq"), F.lit(2))
    return out.withColumn("multiplier", F.coalesce(bonus, F.lit(1.0)))


def best_field(scored: DataFrame, p: Params | Settings = DEFAULT) -> DataFrame:
    """(setting, query_id, doc, tf, t): the better transcript field of each document and its score, divided by the
    query's best multiplier over all documents."""
    spoken = scored.where("corpus = 'transcript'")
    first = Window.partitionBy("setting", "query_id", "doc").orderBy(F.col("strength") * F.col("multiplier") * -1, F.desc("field"))
    spoken = spoken.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    tops = spoken.groupBy("setting", "query_id").agg(F.greatest(F.max("multiplier"), 1 + F.max(settings(p).of("sequence_weight"))).alias("norm"))
    spoken = spoken.join(fit(tops), ["setting", "query_id"])
    return spoken.select("setting", "query_id", "doc", F.col("field").alias("tf"), (F.col("strength") * F.col("multiplier") / F.col("norm")).alias("t"))


def fuse(scored: DataFrame, p: Params | Settings = DEFAULT) -> DataFrame:
    """(setting, query_id, doc, score, source, field): the better transcript field joined with the description; the smaller of
    the two adds a share."""
    p = settings(p)
    told = scored.where("corpus = 'description'").select("setting", "query_id", "doc", (F.col("strength") * p.of("description_preference")).alias("d"))
    both = best_field(scored, p).join(told, ["setting", "query_id", "doc"], "full")
    t, d = F.coalesce("t", F.lit(0.0)), F.coalesce("d", F.lit(0.0))
    prefer = F.col("t").isNotNull() & (t >= d)
    return both.select(
        "setting", "query_id", "doc", (F.greatest(t, d) + p.of("agreement_bonus") * F.least(t, d)).alias("score"),
        F.when(prefer, "transcript").otherwise("description").alias("source"), F.when(prefer, F.col("tf")).otherwise("description").alias("field"),
    )


def shown(denoms: DataFrame, p: Params | Settings = DEFAULT) -> DataFrame:
    """(setting, query_id, corpus, term, term_no): the terms over the rarity floor, or all of a query that has none."""
    above = denoms.withColumn("above", F.col("rarity") >= settings(p).by_corpus("idf_floor"))
    some = Window.partitionBy("setting", "query_id", "corpus")
    return above.withColumn("any", F.max("above").over(some)).where("above or not any").select("setting", "query_id", "corpus", "term", "term_no")


def highlight_ranges(hit: DataFrame, denoms: DataFrame, token_spans: DataFrame, p: Params | Settings = DEFAULT) -> DataFrame:
    """(setting, query_id, corpus, doc, field, ranges): one span per token hit, of terms over the rarity floor unless no term is."""
    own = hit.join(fit(shown(denoms, p).drop("term")), ["setting", "query_id", "corpus", "term_no"], "left_semi").select(*FIELD, "token").distinct()
    own = own.join(token_spans, ["doc", "corpus", "field", "token"])
    return own.groupBy(*FIELD).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ranges"))


def literal_search(field_rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc, score, source, field) of queries without a word, as substrings: the transcript field with most
    occurrences, else the description; the score is the count.

    Such a query is made of marks only, so it meets a text through its first character, an equi join."""
    asked = queries.select("query_id", F.lower(F.trim("query")).alias("q")).where((F.col("q") != "") & (F.size(parts(F.col("q"))) == 0))
    asked = asked.withColumn("mark", F.left("q", F.lit(1)))
    marks = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), "[\\p{L}\\p{N}\\s]+", ""), ""))
    rows = field_rows.select("doc", "corpus", "field", "text", F.explode(marks).alias("mark"))
    met = rows.join(asked, "mark").where(F.contains(F.lower("text"), F.col("q")))
    count = (F.length("text") - F.length(F.replace(F.lower("text"), F.col("q"), F.lit("")))) / F.length("q")
    best = Window.partitionBy("query_id", "doc").orderBy(F.desc("corpus"), F.desc("score"), F.desc("field"))
    met = met.select("query_id", "doc", "corpus", "field", count.cast("double").alias("score")).withColumn("rn", F.row_number().over(best))
    return met.where("rn = 1").select("query_id", "doc", "score", F.col("corpus").alias("source"), "field")


@dataclass(frozen=True)
class Stages:
    """The written stages of a search, small tables but for gated fields."""

    terms: DataFrame
    expansion: DataFrame
    anchor: DataFrame
    live: DataFrame
    denoms: DataFrame
    limits: DataFrame
    heads: DataFrame


def stages(corpus: Corpus, queries: DataFrame, p: Params | Settings = DEFAULT, routes: tuple[str, ...] = ROUTES, pairs: DataFrame | None = None) -> Stages:
    terms = settle(query_terms(queries))
    expansion = settle(expand(reached(terms, corpus.vocab, routes) if pairs is None else pairs, p))
    anchor = settle(anchors(expansion, p))
    denoms = settle(denominators(terms, anchor, corpus.stats, p))
    limits = settle(thresholds(denoms, p))
    return Stages(terms, expansion, anchor, settle(unsuppressed(expansion, anchor)), denoms, limits, settle(heads(denoms, limits)))


def scored_fields(corpus: Corpus, s: Stages, p: Params | Settings = DEFAULT, counts: DataFrame | None = None) -> DataFrame:
    """Gated fields with their strength and multiplier; positions are looked at in gated transcripts only."""
    counts = C.word_counts(corpus.tokens) if counts is None else counts
    gated = settle(gate(summarise(counts, s.live, s.denoms, s.limits, p, s.heads), p))
    spoken = gated.where("corpus = 'transcript'")
    sequence = ordered_subsequence(hits(corpus.tokens.where("corpus = 'transcript'"), s.live, s.terms, spoken), s.terms)
    return score_fields(gated, sequence, C.field_lengths(corpus.tokens), corpus.stats, p)


def text_search(corpus: Corpus, queries: DataFrame, p: Params | Settings = DEFAULT, routes: tuple[str, ...] = ROUTES) -> DataFrame:
    """(setting, query_id, doc, score, source, field) for queries(query_id, query[, segments]); blank queries give nothing."""
    asked = queries.where(F.trim("query") != "")
    found = fuse(scored_fields(corpus, stages(corpus, asked, p, routes), p), p)
    return found.unionByName(settings(p).spread(literal_search(corpus.tokens, asked)))
