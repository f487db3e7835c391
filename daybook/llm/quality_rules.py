"""Operator 5: a ledger of rule failures as bits, with policies and ablations over it.  Native SQL functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, words_col

#: Policy version -> the rules that reject.  v1: the base rules alone; v2: all.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_words"),
    "v2": (
        "few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "upper_case", "exclaims", "no_letters",
    ),
}
CURRENT = "v2"
WINDOW = 8


def rules() -> dict[str, Column]:
    c = F.col
    return {
        "few_words": c("n_words") < 20,
        "repeated_words": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "repeated_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words")),
        "upper_case": 10 * c("n_upper") > 3 * c("word_chars"),
        "exclaims": 10 * c("n_exclaims") > c("n_words"),
        "no_letters": 10 * c("n_letters") < 6 * c("word_chars"),
    }


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever the optimizer folds together."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: str, n: str) -> Column:
    """Words in windows of 8 that occur twice or more.

    Hashes decide only that nothing repeats (no false negative); where one repeats, the windows' own words
    are sorted, neighbours compared and the covered words added up, so the count is exact.
    """
    starts = F.sequence(F.lit(1), F.col(n) - (WINDOW - 1))
    window = lambda i: F.slice(words, i, WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(window(i)))
    pairs = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", window(i)).alias("w"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.when(k >= 0, F.get(s, k)["w"] == x["w"]).otherwise(False)
        return F.filter(s, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))

    at = F.array_sort(F.transform(_let(pairs, repeated), lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, i: F.struct(
        (i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")
    )
    exact = F.aggregate(at, zero, step, lambda a: a["n"])
    some = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.col(n) <= WINDOW, 0).otherwise(F.when(some, exact).otherwise(0)).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' key columns are kept by the caller; adds every measurement once.  Null text counts as no text."""
    text = F.coalesce(F.col("_t"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    dense = F.translate(text, " \t\n\x0b\x0c\r", "")
    out = docs.withColumn("_t", F.col(text_col)).withColumn("_w", words_col("_t"))
    out = out.withColumn("_n", F.size("_w")).withColumn("_lines", lines)
    return out.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": F.length(dense).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeat_words("_w", "_n"),
            "n_upper": F.regexp_count(text, F.lit("\\p{Lu}")).cast("long"),
            "n_exclaims": F.regexp_count(text, F.lit("!!")).cast("long"),
            "n_letters": (F.length(text) - F.regexp_count(text, F.lit("\\P{L}"))).cast("long"),
        }
    ).drop("_t", "_w", "_n", "_lines")


def mask(names: tuple[str, ...]) -> int:
    order = list(rules())
    return sum(1 << order.index(name) for name in names)


def ledger(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys + measurements + fail_bits (long): each rule is evaluated once, bit k is rule k's failure.

    One pass without a shuffle.  Null or empty text: zero measurements, few_words fails.  Repeated rows
    stay repeated; columns of docs outside keys never clash, as only keys and the text are read.
    """
    rows = docs.select(*keys, F.col(text_col).alias("__text"))
    bits = sum(
        (F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, failed in enumerate(rules().values())),
        F.lit(0).cast("long"),
    )
    return measure(rows, "__text").drop("__text").withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, version: str = CURRENT, to: str = "kept") -> DataFrame:
    """Adds the verdict of a policy version; no text is read again."""
    return entries.withColumn(to, F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(entries: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """(policy, rule, n_docs, n_failed, n_kept, n_kept_without) in one aggregation over the bits.

    n_kept_without: documents kept if the rule left the policy.  An empty ledger gives zero counts.
    """
    order = list(rules())
    fails = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m))
    asked = [
        F.struct(
            F.lit(version).alias("policy"),
            F.lit(rule).alias("rule"),
            F.count("*").alias("n_docs"),
            F.count_if(fails(1 << order.index(rule)) != 0).alias("n_failed"),
            F.count_if(fails(mask(names)) == 0).alias("n_kept"),
            F.count_if(fails(mask(names) & ~(1 << order.index(rule))) == 0).alias("n_kept_without"),
        )
        for version, names in policies.items()
        for rule in names
    ]
    return entries.agg(F.array(*asked).alias("rows")).select(F.inline("rows"))


def op5(docs: DataFrame) -> DataFrame:
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES["v1"]))) != 0
    return apply_policy(ledger(docs, ["doc_id"])).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "fail_bits",
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps.

    The ledger is written beside the rows before the policy reads it: a filter right on it would be pushed below
    the measurements and compute them again for every use."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__text"))
    entries = settle(ledger(rows, ["__row"], "__text").select("__row", "fail_bits"))
    return apply_policy(entries).where("kept").select("__row.*")
