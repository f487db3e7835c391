"""Operator 12: how far the sources of a language differ in their use of its terms, by count-level bitmaps."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fit, settle

#: A term of a language is in so many of its documents at least; every count is smoothed by ADDED; shares are of a thousand million.
LEAST_DOCS, ADDED, WHOLE = 30, 5, 1_000_000_000
#: Terms reported for a group.
TOP = 50
#: Terms that a block holds on average, sources that meet in one task, and counts that a task gathers before it sends them.
BLOCK, MEET, GATHER = 2048, 512, 300_000

#: Bytes outside A-Z, a-z and the non-ASCII ones become blanks, A-Z small letters.
_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """The runs of ASCII letters and non-ASCII characters, only A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split(b" ")


def counted(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """cells(lang, source, term, n, df): occurrences and documents by term, and one row with a null term for every group.

    Each task sums what it reads before the shuffle, which deals by (lang, term): a source with a third of the documents
    sends one row a term and task."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df, groups, held = defaultdict(Counter), defaultdict(Counter), Counter(), 0

        def sums() -> pd.DataFrame:
            rows = [(*g, w.decode("utf-8", "surrogatepass"), c, df[g][w]) for g, own in n.items() for w, c in own.items() if w]
            rows += [(*g, None, 0, c) for g, c in groups.items()]
            return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "df"])

        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["t"], strict=True):
                g = lang, source
                words, groups[g] = terms_of(text), groups[g] + 1
                before = len(n[g])
                n[g].update(words)
                df[g].update(set(words))
                held += len(n[g]) - before
                if held > GATHER:
                    yield sums()
                    n, df, groups, held = defaultdict(Counter), defaultdict(Counter), Counter(), 0
        yield sums()

    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.col(text_col).alias("t"),
    ).mapInPandas(scan, "lang string, source string, term string, n long, df long")
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(WHOLE * (n + ADDED) / (total + ADDED * terms)) in whole numbers; 1 + WHOLE * ... stays below 2 ** 63."""
    n, total, terms = (F.col(c) if isinstance(c, str) else c for c in (n, total, terms))
    above = (F.lit(WHOLE).cast("decimal(10,0)") * (n + ADDED).cast("decimal(20,0)")).alias("above")
    below = F.greatest(total + ADDED * terms, F.lit(1)).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


class Audit:
    """The shared tables of an audit, written once.

    groups(lang, source, place, total, terms, lang_total): every occurring pair of a language and a source, even without terms;
    place numbers the sources of a language by UTF-8 order, total is the group's count over kept terms, terms their number.
    kept(lang, source, term, n, whole): how often a kept term is in a group (never 0) and in the language.
    """

    def __init__(
        self, docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS
    ) -> None:
        term = Window.partitionBy("lang", "term")  # as the counts are dealt already
        summed = counted(docs, lang_col, source_col, text_col).withColumns({"docs": F.sum("df").over(term), "whole": F.sum("n").over(term)})
        cells = settle(summed.where((F.col("docs") >= least_docs) | F.col("term").isNull()).drop("df"))
        self.kept = cells.where("term is not null")
        totals = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        words = self.kept.groupBy("lang", "term").agg(F.max("whole").alias("whole"))
        words = words.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("whole").alias("lang_total"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        named = cells.where("term is null").select("lang", "source")
        named = named.join(totals, ["lang", "source"], "left").join(words, "lang", "left")
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        self.groups = settle(named.select("lang", "source", place.alias("place"), zero("total"), zero("terms"), zero("lang_total")))

    def levels(self, block: int = BLOCK) -> DataFrame:
        """(lang, bucket, place, p, word, bits): the stored bitmaps.  For a group and a count the ids of the terms with that count,
        64 ids a word; p is the count's share in the group.

        Terms are dealt by hash to buckets of about block and numbered there from those in most documents to those in fewest, so
        a word of rare terms has few counts and many bits.  The row with word -1 gives a group's share for count 0, and in
        the first bucket the number of terms."""
        n_buckets = F.greatest(F.lit(1), F.ceil(F.col("terms") / block)).cast("int")
        group = fit(self.groups.withColumn("buckets", n_buckets), 128)
        rows = self.kept.join(group, ["lang", "source"])
        bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")
        rows = rows.select("lang", bucket.alias("bucket"), "place", "n", "total", "terms", "docs", "term")
        number = F.dense_rank().over(Window.partitionBy("lang", "bucket").orderBy(F.desc("docs"), "term")) - 1
        rows = rows.withColumn("id", number)
        keys = ["lang", "bucket", "place", "n", "total", "terms"]
        bits = rows.groupBy(*keys, F.floor(F.col("id") / 64).cast("int").alias("word")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("id", F.lit(64)))).alias("bits")
        )
        bits = bits.select("lang", "bucket", "place", share("n", "total", "terms").alias("p"), "word", "bits")
        zeros = self.groups.withColumn("bucket", F.explode(F.sequence(F.lit(0), n_buckets - 1)))
        zeros = zeros.select(
            "lang", "bucket", "place", share(F.lit(0), "total", "terms").alias("p"), F.lit(-1).alias("word"),
            F.when(F.col("bucket") == 0, F.col("terms")).otherwise(0).alias("bits"),
        )
        return bits.unionByName(zeros)

    def pairs(self, meet: int = MEET, block: int = BLOCK) -> DataFrame:
        """(lang, source, other, value): for every two sources of a language the sum of abs(p - q) over all its kept terms.

        Tasks get a block of terms of two lots of meet sources, so what one holds is bounded whatever the number of sources."""
        rows = settle(self.levels(block))
        lots = self.groups.groupBy("lang").agg(F.floor(F.max("place") / meet).cast("int").alias("last"))
        rows = rows.join(fit(lots, 128), "lang").withColumn("lot", F.floor(F.col("place") / meet).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
        rows = rows.select("lang", "bucket", F.least("lot", "other").alias("lo"), F.greatest("lot", "other").alias("hi"), "word", "place", "p", "bits")
        keys = ["lang", "bucket", "lo", "hi"]
        rows = rows.repartition(*keys).sortWithinPartitions(*keys, "word", "place", "p")
        met = rows.mapInPandas(lambda batches: _meet(batches, meet), "lang string, a int, b int, value long")
        sums = met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        both = sums.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("s"))
        both = both.select("lang", "s.a", "s.b", "value")
        name = lambda place, col: fit(self.groups.select("lang", F.col("place").alias(place), F.col("source").alias(col)), 128)
        return both.join(name("a", "source"), ["lang", "a"]).join(name("b", "other"), ["lang", "b"]).select("lang", "source", "other", "value")

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, term, value, rank): for each group its top terms whose share is above the language's, by the difference."""
        rows = self.kept.join(fit(self.groups, 128), ["lang", "source"])
        value = share("n", "total", "terms") - share("whole", "lang_total", "terms")
        rows = rows.select("lang", "source", "term", value.alias("value")).where("value > 0")
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def _meet(batches: Iterator[pd.DataFrame], meet: int) -> Iterator[pd.DataFrame]:
    """Sums of abs(p - q) by pair for sorted rows of levels: a block is a lang, bucket, lo and hi, its words come in order.

    With f(x, y) = abs(px - qy) the sum over all terms is terms * f(0, 0) plus, for each level x of one source,
    its terms times f(x, 0) - f(0, 0), likewise for the other, plus for joint cells f(x, y) - f(x, 0) - f(0, y) + f(0, 0): the
    terms that one source lacks come by complement, and only cells with common bits are added up."""
    now, block = None, None
    for batch in batches:
        keys = list(zip(batch["lang"], batch["bucket"].tolist(), batch["lo"].tolist(), batch["hi"].tolist(), strict=True))
        word = batch["word"].to_numpy()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or word[i] != word[i - 1]), len(keys)]
        place, p, bits = batch["place"].to_numpy(), batch["p"].to_numpy(), batch["bits"].to_numpy()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if keys[lo] != now:
                if block:
                    yield block.sums()
                now, block = keys[lo], _Block(keys[lo], meet)
            block.add(int(word[lo]), place[lo:hi], p[lo:hi], bits[lo:hi])
    if block:
        yield block.sums()


class _Block:
    """The sums of one block; rows of a word may come in several parts."""

    def __init__(self, key: tuple, meet: int) -> None:
        self.lang, self.bucket, self.low, self.high = key
        self.meet, self.at, self.parts = meet, None, []

    def add(self, word: int, *rows: np.ndarray) -> None:
        if word != self.at:
            self.close()
            self.at = word
        self.parts.append(rows)

    def close(self) -> None:
        if not self.parts:
            return
        place, p, bits = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        if self.at < 0:  # every source of both lots, in order
            self.place, self.zero = place, p
            self.far = np.abs(p[:, None] - p[None, :])
            self.sum, self.lone = int(bits[0]) * self.far, np.zeros_like(self.far)
            return
        own, sets = np.searchsorted(self.place, place), bits.view(np.uint64)
        ones = np.bitwise_count(sets).astype(np.int64)[:, None]
        zero, step = self.zero[own], max(1, (1 << 21) // max(len(sets), len(self.place)))
        for lo in range(0, len(sets), step):
            some = slice(lo, lo + step)
            np.add.at(self.lone, own[some], ones[some] * (np.abs(p[some, None] - self.zero[None, :]) - self.far[own[some]]))
            joint = np.bitwise_count(sets[some, None] & sets[None, lo:])
            i, j = np.nonzero(joint)
            n, i, j = joint[i, j].astype(np.int64), i + lo, j + lo
            up = own[i] < own[j]
            n, i, j = n[up], i[up], j[up]
            both = np.abs(p[i] - p[j]) - np.abs(p[i] - zero[j]) - np.abs(zero[i] - p[j]) + np.abs(zero[i] - zero[j])
            np.add.at(self.sum, (own[i], own[j]), n * both)

    def sums(self) -> pd.DataFrame:
        self.close()
        total = self.sum + self.lone + self.lone.T
        lot = self.place // self.meet
        a, b = np.nonzero(np.triu(np.ones_like(total, dtype=bool), 1))
        if self.low != self.high:  # two of one lot meet elsewhere
            across = lot[a] != lot[b]
            a, b = a[across], b[across]
        return pd.DataFrame({"lang": self.lang, "a": self.place[a], "b": self.place[b], "value": total[a, b]})


def audit(docs: DataFrame, **names: object) -> DataFrame:
    """(lang, source, part, item, value, rank): how each (lang, source) group uses the language's terms.

    Part pair ranks the other sources of the language by the summed difference of shares (0 without kept terms), part term the
    group's TOP terms above the language's share.  Null text, lang and source are read as ''; a repeated row is a document of
    its own; a language with one source has no pairs; a group without terms has pairs but no terms; extra columns are
    ignored; an empty table gives an empty result.  All arithmetic is exact.
    """
    shared = Audit(docs, **names)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other"))
    pairs = shared.pairs().select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", rank.alias("rank"))
    terms = shared.terms().select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)


def op12(docs: DataFrame) -> DataFrame:
    return audit(docs)


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
vocab AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(whole)::HUGEINT AS n FROM vocab GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN vocab USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN cells c USING (lang, source) GROUP BY g.lang, g.source),
shares AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
    1 + ({WHOLE}::HUGEINT * (coalesce(c.n, 0) + {ADDED})) // (g.n + {ADDED} * l.v) AS p,
    1 + ({WHOLE}::HUGEINT * (v.whole + {ADDED})) // (l.n + {ADDED} * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN vocab v USING (lang) LEFT JOIN cells c USING (lang, source, term)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= {TOP}
"""
