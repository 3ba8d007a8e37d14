"""Dictionary correction. Corrections are tables, so that looking words up is a join.

Of every term the spellings are listed that one misread syllable or one confused letter would make of it; a spelling that
leads to exactly one term is corrected to it. The tables grow with the dictionary times a term's length, not with the texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

BASE, LAST = 0xAC00, 0xD7A3


def is_syllable(c: Column) -> Column:
    return F.ascii(c).between(BASE, LAST)


def union_terms(*dictionaries: DataFrame) -> DataFrame:
    """The distinct non-empty terms of dictionaries, of whose columns the first is the term."""
    terms = [d.select(F.col(d.columns[0]).alias("term")) for d in dictionaries]
    every = terms[0]
    for t in terms[1:]:
        every = every.unionByName(t)
    return every.where("term != ''").distinct()


def decompose(c: Column) -> Column:
    """(initial, vowel, final) of a syllable, null for other characters."""
    n = F.ascii(c) - BASE
    parts = F.struct(F.floor(n / 588).cast("int").alias("initial"), F.floor(F.pmod(n, F.lit(588)) / 28).cast("int").alias("vowel"), F.pmod(n, F.lit(28)).cast("int").alias("final"))
    return F.when(is_syllable(c), parts)


def compose(initial: Column, vowel: Column, final: Column) -> Column:
    """The syllable of three parts, ? for parts that don't exist."""
    code = F.lit(BASE) + initial * 588 + vowel * 28 + final
    fits = initial.between(0, 18) & vowel.between(0, 20) & final.between(0, 27)
    return F.when(fits, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")).otherwise("?")


def strip_particle(c: Column, particles=V.PARTICLES) -> Column:
    """(stem, particle) by the first particle in order that leaves two characters; null if none does."""
    if all(len(p) >= len(q) for p, q in zip(particles, particles[1:], strict=False)):
        # longer ones come first, so the first that fits is the one that leaves the shortest stem
        pattern = "(?s)^(.{2,}?)(" + "|".join(particles) + ")$"
        return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("stem"), F.regexp_extract(c, pattern, 2).alias("particle")))
    fits = [F.when(c.endswith(p) & (F.char_length(c) - len(p) >= 2), F.struct(F.substr(c, F.lit(1), F.char_length(c) - len(p)).alias("stem"), F.lit(p).alias("particle"))) for p in particles]
    return F.coalesce(*fits)


def _characters(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.substr(c, i, F.lit(1)))


def _replaced(c: Column, i: Column, to: Column) -> Column:
    return F.concat(F.substr(c, F.lit(1), i), to, F.substr(c, i + 2, F.char_length(c)))


def confusable_spellings(terms: DataFrame, confusions: dict[str, str] | None = None) -> DataFrame:
    """(spelling, term) of D01: spellings of which one misread character makes exactly one term; terms themselves aren't spellings."""
    pairs = list((V.CONFUSIONS if confusions is None else confusions).items())
    wrong = F.create_map(*[x for right in sorted({r for _, r in pairs}) for x in (F.lit(right), F.array(*[F.lit(w) for w, r in pairs if r == right]))])
    own = terms.where("term != ''").select("term", F.posexplode(_characters(F.col("term"))).alias("i", "c"))
    made = own.select("term", F.explode(F.transform(F.coalesce(wrong[F.col("c")], F.array().cast("array<string>")), lambda w: _replaced(F.col("term"), F.col("i"), w))).alias("spelling"))
    return _unique(made, terms)


def letter_spellings(terms: DataFrame) -> DataFrame:
    """(spelling, term) of D02: one vowel, initial or final taken for another that it is confused with."""
    swaps = []
    for part, pairs in (("vowel", V.VOWELS), ("initial", V.INITIALS), ("final", V.FINALS)):
        for a, b in pairs:
            swaps += [(part, a, b), (part, b, a)]
    own = terms.where("term != ''").select("term", F.posexplode(_characters(F.col("term"))).alias("i", "c")).where(is_syllable(F.col("c"))).withColumn("p", decompose(F.col("c")))
    made = []
    for part, a, b in dict.fromkeys(swaps):
        parts = [F.lit(b) if x == part else F.col(f"p.{x}") for x in ("initial", "vowel", "final")]
        made.append(F.when(F.col(f"p.{part}") == a, _replaced(F.col("term"), F.col("i"), compose(*parts))))
    return _unique(own.select("term", F.explode(F.array_compact(F.array(*made))).alias("spelling")), terms)


def _unique(made: DataFrame, terms: DataFrame) -> DataFrame:
    single = made.groupBy("spelling").agg(F.countDistinct("term").alias("n"), F.min("term").alias("term")).where("n = 1").drop("n")
    return single.join(terms.select(F.col("term").alias("spelling")).distinct(), "spelling", "left_anti")


_BETWEEN = f"(?U)(?<={V.DELIMITERS})|(?={V.DELIMITERS})"


def tokens(text: Column) -> Column:
    """Words and delimiters in turn; joined they are the text."""
    return F.split(text, _BETWEEN, -1)


def corrected_words(words: DataFrame, terms: DataFrame, spellings: DataFrame) -> DataFrame:
    """words with their column `now` corrected by a table of spellings (D01 or D02).

    A word that isn't a term becomes the one term of its spelling; failing that, its stem is looked up the same way, and the
    particle stays. Joins are on the word; Spark broadcasts a dictionary that is small and shuffles otherwise.
    """
    known = terms.select(F.col("term").alias("_known")).distinct()
    stems = terms.select(F.col("term").alias("_stem_known")).distinct()
    joined = (
        words.withColumn("_cut", strip_particle(F.col("now")))
        .join(known, F.col("now") == F.col("_known"), "left")
        .join(spellings.select(F.col("spelling").alias("_s1"), F.col("term").alias("_t1")), F.col("now") == F.col("_s1"), "left")
        .join(stems, F.col("_cut.stem") == F.col("_stem_known"), "left")
        .join(spellings.select(F.col("spelling").alias("_s2"), F.col("term").alias("_t2")), F.col("_cut.stem") == F.col("_s2"), "left")
    )
    by_stem = F.when(F.col("_stem_known").isNull() & F.col("_t2").isNotNull(), F.concat("_t2", "_cut.particle"))
    return joined.select(*[c for c in words.columns if c != "now"], F.when(F.col("_known").isNotNull(), F.col("now")).otherwise(F.coalesce("_t1", by_stem, "now")).alias("now"))


def correct(docs: DataFrame, keys: list[str], terms: DataFrame, steps: list[tuple[DataFrame, dict[str, str]]], text: str = "text") -> DataFrame:
    """Keys and corrected text of each row; steps are tables of spellings, each with words that are replaced before it.

    The distinct words of all texts go through the steps, and each text gets the changes of its own words as a map. No text is
    taken apart across rows: null texts stay null, and rows that share their keys stay apart. An empty dictionary changes
    nothing. Words that are replaced, and what they become, must not hold delimiters.
    """
    if terms.where("term IS NOT NULL").isEmpty():
        return docs.select(*keys, text)
    # two hashes stand for a text: equal texts have equal corrections
    rows = docs.select(*keys, text, F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2"))
    parts = rows.select("_h1", "_h2", F.explode_outer(F.array_distinct(tokens(F.col(text)))).alias("token")).where(~F.col("token").rlike(f"(?U)^{V.DELIMITERS}?$"))
    words = parts.select("token").distinct().withColumn("now", F.col("token"))
    for spellings, direct in steps:
        now = F.col("now")
        for wrong, right in direct.items():
            now = F.replace(now, F.lit(wrong), F.lit(right))
        words = corrected_words(words.withColumn("now", now), terms, spellings)
    own = parts.distinct().join(words.where("now != token"), "token").groupBy(F.col("_h1").alias("_one"), F.col("_h2").alias("_two")).agg(F.map_from_entries(F.collect_list(F.struct("token", "now"))).alias("_fixed"))
    joined = rows.join(own, (F.col("_h1") == F.col("_one")) & (F.col("_h2") == F.col("_two")), "left")
    whole = F.array_join(F.transform(tokens(F.col(text)), lambda t: F.coalesce(F.element_at("_fixed", t), t)), "")
    return joined.select(*keys, F.when(F.col("_fixed").isNull(), F.col(text)).otherwise(whole).alias(text))


def correct_all(docs: DataFrame, keys: list[str], terms: DataFrame, text: str = "text", rounds: int = 1) -> DataFrame:
    """D06 (one round) and D05 (three): misread characters, then confused letters."""
    steps = [(confusable_spellings(terms), V.DIRECT_WORDS), (letter_spellings(terms), {})]
    return correct(docs, keys, terms, steps * rounds, text)


def known_words(words: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows whose word is a term."""
    return words.join(terms.select(F.col("term").alias("_t")).distinct(), words["word"] == F.col("_t"), "left_semi")


def term_hits(lines: DataFrame, keys: list[str], terms: DataFrame, line: str = "line", few: int = 500_000) -> DataFrame:
    """How many terms of two characters or more a line holds as substrings, by keys.

    Terms are looked up by equality at every place of a line: first the beginning, of four characters at most, which says how
    long the terms that begin so are, then those lengths alone. Up to `few` terms go to the tasks, so that places are looked up
    where they are read; more are joined.
    """
    long = terms.where(F.char_length("term") >= 2).select("term").distinct()
    known = [r["term"] for r in long.limit(few + 1).collect()]
    counted = _hits_in_tasks(lines, keys, known, line) if len(known) <= few else _hits_by_join(lines, keys, long, line)
    return counted.groupBy(*keys).agg(F.sum("hits").alias("hits"))


def _hits_in_tasks(lines: DataFrame, keys: list[str], known: list[str], line: str) -> DataFrame:
    every, sizes = frozenset(known), {}
    for t in known:
        sizes.setdefault(t[:4], set()).add(len(t))
    heads = sorted({len(h) for h in sizes})

    def held(text: str) -> int:
        found = set()
        for h in heads:
            for i in range(len(text) - h + 1):
                for n in sizes.get(text[i : i + h], ()):
                    found.add(text[i : i + n])
        return len(found & every)

    @F.pandas_udf("long")
    def hits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: held(t) if t else 0)

    return lines.select(*keys, hits(F.col(line)).alias("hits"))


def _hits_by_join(lines: DataFrame, keys: list[str], long: DataFrame, line: str, block: int = 64) -> DataFrame:
    """Lines are read in blocks, as a place in a text is found from its start, and stand as two hashes of their text."""
    heads = long.groupBy(F.substring("term", 1, 4).alias("_head")).agg(F.collect_set(F.char_length("term")).alias("_sizes"))
    most = long.agg(F.max(F.char_length("term"))).first()[0]
    n = F.char_length(line)
    marks = [F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit(1), line).alias("_h2")]
    starts = F.transform(F.sequence(F.lit(1), n - 1, F.lit(block)), lambda k: F.substr(F.col(line), k, F.lit(block + most - 1)))
    pieces = lines.where(n >= 2).select(*marks, F.explode(starts).alias("_piece"))
    places = F.sequence(F.lit(1), F.least(F.char_length("_piece") - 1, F.lit(block)))
    part = lambda size: F.substr(F.col("_piece"), F.col("_at"), size)
    begun = pieces.select("_h1", "_h2", "_piece", F.explode(places).alias("_at")).select("*", F.explode(F.array(*[part(F.lit(h)) for h in (2, 3, 4)])).alias("_head"))
    sized = begun.join(heads, "_head").select("_h1", "_h2", "_piece", "_at", F.explode("_sizes").alias("_size"))
    found = sized.select("_h1", "_h2", part(F.col("_size")).alias("term")).join(long, "term").groupBy("_h1", "_h2").agg(F.count_distinct("term").alias("hits"))
    return lines.select(*keys, *marks).join(found, ["_h1", "_h2"], "left").select(*keys, F.coalesce("hits", F.lit(0)).alias("hits"))
