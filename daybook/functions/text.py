"""Words, word spans, shingles and inflectional stems as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: letters, digits and apostrophes.
WORD = "[\\p{L}\\p{N}']+"

#: Closed compounds that the archive writes open.
COMPOUNDS = {
    "anymore": ["any", "more"], "anytime": ["any", "time"], "babysitter": ["baby", "sitter"],
    "backyard": ["back", "yard"], "boogerbrain": ["booger", "brain"], "comeback": ["come", "back"],
    "flamethrower": ["flame", "thrower"], "flyswatter": ["fly", "swatter"], "fuzzbrain": ["fuzz", "brain"],
    "getaway": ["get", "away"], "goodnight": ["good", "night"], "grownups": ["grown", "ups"],
    "hotdog": ["hot", "dog"], "hotdogs": ["hot", "dogs"], "lookout": ["look", "out"], "lunchbox": ["lunch", "box"],
    "lunchtime": ["lunch", "time"], "runaway": ["run", "away"], "schoolbooks": ["school", "books"],
    "stepladder": ["step", "ladder"], "superhighway": ["super", "highway"], "superpowers": ["super", "powers"],
    "takeoff": ["take", "off"], "teenager": ["teen", "ager"], "thermonuclear": ["thermo", "nuclear"],
    "turnaround": ["turn", "around"], "workout": ["work", "out"],
}


def words(col: Column) -> Column:
    """The text's words in lower case; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(WORD), F.lit(0))


def parts(col: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """array<struct<token, word>>: words with lexicon compounds replaced by their parts, each with its token's number."""
    plain = lambda words_: F.transform(words_, lambda w, i: F.struct(i.alias("token"), w.alias("word")))
    if not lexicon:
        return plain(words(col))
    split = lambda words_: F.flatten(F.transform(words_, lambda w, i: F.transform(_parts(w, lexicon), lambda p: F.struct(i.alias("token"), p.alias("word")))))
    return let(words(col), lambda w: F.when(_any(w, lexicon), split(w)).otherwise(plain(w)))


def _parts(word: Column, lexicon: dict[str, list[str]]) -> Column:
    table = F.create_map(*(x for k, v in lexicon.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.when(word.isin(*lexicon), F.try_element_at(table, word)).otherwise(F.array(word))


def _any(words_: Column, lexicon: dict[str, list[str]]) -> Column:
    """Whether a compound is among the words, so that the texts without one, which are most, need no look at each word."""
    return F.arrays_overlap(words_, F.array(*map(F.lit, lexicon)))


def opened(words_: Column, lexicon: dict[str, list[str]] | None = None, repeats: bool = False) -> Column:
    """Words with lexicon compounds replaced by their parts; words that differ stay so unless repeats is true."""
    if not lexicon:
        return words_
    split = lambda w: F.flatten(F.transform(w, lambda x: _parts(x, lexicon)))
    own = split if repeats else lambda w: F.array_distinct(split(w))
    return let(words_, lambda w: F.when(_any(w, lexicon), own(w)).otherwise(w))


def shingles(col: Column, k: int) -> Column:
    """The distinct runs of k words, joined by spaces."""

    def every(w: Column) -> Column:
        n = F.size(w) - (k - 1)
        each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.array_distinct(F.when(n >= 1, each).otherwise(F.array().cast("array<string>")))

    return let(words(col), every)


def sounds(col: Column) -> Column:
    """c or v for each letter; y is a vowel only after a consonant."""
    step = lambda acc, x: F.concat(
        acc,
        F.when(x.isin(*"aeiou"), "v").when((x == "y") & acc.endswith("c"), "v").otherwise("c"),
    )
    return F.aggregate(F.filter(F.split(col, ""), lambda x: x != ""), F.lit(""), step)


def let(value: Column, body) -> Column:
    """body(value) with value written and computed once, so that expressions built in steps stay as long as their steps,
    also where the optimizer copies them into a filter."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stem(col: Column) -> Column:
    """The stem of an English word: inflectional endings only, so that forms of one word meet.

    Possessives go first, then plurals, then past and progressive endings with a doubled consonant or silent e put
    right, and an end y becomes i.
    """
    cut = lambda x, n: F.left(x, F.length(x) - n)

    def plural(o: Column) -> Column:
        return (
            F.when(o.endswith("ies"), cut(o, 2))
            .when(o.rlike("(x|z|ch|sh|ss)es$"), cut(o, 2))
            .when(~o.endswith("s") | o.rlike("(ss|us|is)$"), o)
            .otherwise(cut(o, 1))
        )

    def restored(b: Column, bs: Column) -> Column:
        last = F.right(b, F.lit(1))
        doubled = (F.length(b) > 1) & (last == F.substring(b, F.lit(-2), F.lit(1))) & bs.endswith("c")
        silent = (F.regexp_count(bs, F.lit("v+c+")) == 1) & bs.endswith("cvc") & ~last.isin("w", "x", "y")
        return (
            F.when(b.rlike("(at|bl|iz)$"), F.concat(b, F.lit("e")))
            .when(doubled & ~last.isin("l", "s", "z"), cut(b, 1))
            .when(silent, F.concat(b, F.lit("e")))
            .otherwise(b)
        )

    def tense(p: Column) -> Column:
        size = F.when(p.endswith("eed"), None).when(p.endswith("ed"), 2).when(p.endswith("ing"), 3).cast("int")
        base = lambda s: let(
            F.struct(cut(p, size).alias("b"), F.left(s, F.length(p) - size).alias("s")),
            lambda x: F.when(x["s"].contains("v"), restored(x["b"], x["s"])).otherwise(p),
        )
        eed = lambda s: F.when(F.left(s, F.length(p) - 3).rlike("v+c"), cut(p, 1)).otherwise(p)
        return let(sounds(p), lambda s: F.when(p.endswith("eed"), eed(s)).otherwise(base(s)))

    def settled(t: Column) -> Column:
        end = lambda s: t.endswith("y") & F.left(s, F.length(t) - 1).contains("v")
        return let(sounds(t), lambda s: F.when(end(s), F.concat(cut(t, 1), F.lit("i"))).otherwise(t))

    owned = F.when(col.endswith("'s"), cut(col, 2)).when(col.endswith("'"), cut(col, 1)).otherwise(col)
    return let(owned, lambda o: let(plural(o), lambda p: let(tense(p), settled)))


def with_stem(df: DataFrame, col: str = "word", to: str = "stem") -> DataFrame:
    """Adds the stem of each word; meant for a distinct vocabulary."""
    return df.withColumn(to, stem(F.col(col)))
