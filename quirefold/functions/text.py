"""Predicates, cleaning, classification and splitting of recognised text, as Column functions.

Patterns with classes such as \\s and \\w carry (?U), and those with a dot (?d), so that they mean what they do in Python. A
null text gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

BLANK = r"(?U)^\s*$"
HANGUL = "[가-힣]"
_BLOCKS = "array<struct<text:string,kind:string,x1:int,y1:int,x2:int,y2:int>>"


def once(value: Column, then) -> Column:
    """then(value), with value computed once however often then names it."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), 0)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | c.rlike(BLANK)


def is_anomalous(c: Column, most: int = 5000) -> Column:
    """more characters than a page can have."""
    return F.char_length(c) > most


def is_leakage(c: Column) -> Column:
    """a text without Hangul that repeats its instructions."""
    # one look at a character tells that no phrase starts there
    phrases = "(?i)(?=[" + "".join(sorted({p[0].lower() for p in V.LEAKAGE_PHRASES})) + "])(?:" + "|".join(V.LEAKAGE_PHRASES) + ")"
    return ~c.rlike(BLANK) & ~c.rlike(HANGUL) & (c.rlike(phrases) | c.rlike(r"(?U)\\#\s*\\#\s*\\#"))


def is_leakage_line(c: Column) -> Column:
    """F03."""
    return c.rlike(r"(?Ui)^\s*\.?\s*(" + "|".join(V.LEAKAGE_STARTS) + ")")


def is_separator_line(c: Column) -> Column:
    """only three or more of - = *."""
    return c.rlike(r"(?U)^\s*[-=*]{3,}\s*$")


def should_refine(c: Column) -> Column:
    """worth sending to a model: 50 characters, and neither a page number nor a rule."""
    s = strip(c)
    return (F.char_length(s) >= 50) & ~s.rlike(r"(?U)^[\s\-–—]*\d+[\s\-–—]*$") & ~s.rlike(r"(?U)^[=\-_─━*]{3,}\s*$")


def guarded(c: Column) -> Column:
    """empty for blank texts, texts of fewer than five characters, and leakage."""
    return F.when(is_blank(c) | ~c.rlike(r"(?Us)\S.{3,}\S") | is_leakage(c), "").otherwise(c)


def is_valid_refinement(refined: Column, original: Column) -> Column:
    """length ratio from 0.3 to 2; an empty original allows nothing."""
    n, m = F.char_length(strip(original)), F.char_length(strip(refined))
    return F.when(m == 0, False).when(n == 0, m == 0).otherwise((m >= 0.3 * n) & (m <= 2.0 * n))


def is_valid_correction(corrected: Column, original: Column) -> Column:
    """length ratio from 0.7 to 1.3, and no talk about the correction."""
    s = strip(corrected)
    ratio = F.char_length(s) / F.greatest(F.char_length(original), F.lit(1))
    return ~is_blank(corrected) & (ratio >= 0.7) & (ratio <= 1.3) & ~s.rlike("^(" + "|".join(V.BAD_CORRECTION_STARTS) + ")")


def has_proper_nouns(c: Column, markers=V.PROPER_NOUNS) -> Column:
    """F16: markers of letters are sought as they are, others are patterns; one that holds another marker needs no look of its own."""
    if not all(m.isalnum() for m in markers):
        return c.rlike("|".join(markers))
    needed = [m for m in markers if not any(o != m and o in m for o in markers)]
    found = c.contains(needed[0])
    for m in needed[1:]:
        found = found | c.contains(m)
    return found


def is_truncated(c: Column, max_tokens: int) -> Column:
    """an open tag at the end, far too long, or, with four closed tags or more, long and ending without a terminator. Empty texts aren't cut."""
    limit = 2.5 * max_tokens
    parts = F.split(c, r"<\|/det\|>", -1)
    tail = strip(F.element_at(parts, -1))
    cut = (F.size(parts) > 4) & (tail != "") & ~F.contains(F.lit(V.TERMINATORS), F.right(tail, F.lit(1)))
    return F.when(F.coalesce(c, F.lit("")) == "", False).otherwise(c.rlike(r"(<\|ref\|>[^<]*$)|(<\|det\|>[^<]*$)") | (F.char_length(c) > limit) | ((F.char_length(c) > 0.6 * limit) & cut))


def grounded_blocks(raw: Column, max_tokens: int = 16384) -> Column:
    """The blocks (text, kind, x1, y1, x2, y2, truncated) of a recogniser's answer, in order; those without text go.

    Corners are held within 0 to 999 and have at least one step between them where there is room. Text before the first whole
    mark is a block where it begins like one. The last block says whether the answer was cut off; null and unmarked answers
    give no blocks.
    """
    pattern, first = "(?Ud)" + V.GROUNDED_BLOCK, "(?Ud)" + V.GROUNDED_START

    def corner(mark: Column, p: str, group: int) -> Column:
        digits = F.regexp_replace(F.regexp_extract(mark, p, group), "^0+(?=.)", "")
        return F.when(F.char_length(digits) > 3, 999).otherwise(digits.cast("int"))

    def block(mark: Column, p: str, text: Column) -> Column:
        def sized(c: Column) -> Column:
            after = lambda low, high: F.when(c[high] <= c[low], F.least(c[low] + 1, F.lit(999))).otherwise(c[high])
            return F.struct(strip(text).alias("text"), strip(F.regexp_extract(mark, p, 1)).alias("kind"), c["x1"].alias("x1"), c["y1"].alias("y1"), after("x1", "x2").alias("x2"), after("y1", "y2").alias("y2"))

        return once(F.struct(*[corner(mark, p, i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"), 2)]), sized)

    def of_parts(parts: Column) -> Column:
        marks = F.regexp_extract_all(raw, F.lit(pattern), F.lit(0))
        lead = F.get(parts, 0)
        start = F.when(lead.rlike(first), F.array(block(F.regexp_extract(lead, first, 0), first, F.regexp_replace(lead, first, "")))).otherwise(F.array().cast(_BLOCKS))
        rest = F.zip_with(marks, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda m, t: block(m, pattern, t))
        return F.filter(F.concat(F.when(F.size(parts) > 1, start).otherwise(F.array().cast(_BLOCKS)), rest), lambda x: x["text"] != "")

    def flagged(found: Column) -> Column:
        cut = is_truncated(raw, max_tokens)
        return F.transform(found, lambda x, i: F.struct(*[x[n].alias(n) for n in ("text", "kind", "x1", "y1", "x2", "y2")], ((i == F.size(found) - 1) & cut).alias("truncated")))

    return once(once(F.split(raw, pattern, -1), of_parts), flagged)


# ---- repetition


def repeated_line_offset(c: Column) -> Column:
    """Where the first line starts that two equal, non-blank lines follow; -1 without one."""

    def offset(lines: Column) -> Column:
        starts = F.filter(F.transform(lines, lambda x, i: F.when((i >= 2) & (x == F.get(lines, i - 1)) & (x == F.get(lines, i - 2)) & ~x.rlike(BLANK), i)), lambda i: i.isNotNull())
        before = lambda i: F.aggregate(F.slice(lines, 1, i - 2), F.lit(0), lambda a, x: a + F.char_length(x) + 1)
        return once(F.get(starts, 0), lambda i: F.when(i.isNull(), -1).otherwise(before(i)))

    return F.when(c.isNull(), None).otherwise(once(F.split(c, "\n", -1), offset))


def remove_repetition(c: Column) -> Column:
    """Cut where lines begin to repeat, and collapse repeated units and characters; texts under 100 characters stay."""
    cut = once(repeated_line_offset(c), lambda at: F.when(at > 0, F.regexp_replace(F.substr(c, F.lit(1), at), r"(?U)\s+$", "")).otherwise(c))
    less = F.regexp_replace(F.regexp_replace(cut, r"(?d)(.{1,5})\1{9,}", "$1"), r"(?d)(.)\1{29,}", "$1")
    return F.when(F.char_length(c) < 100, c).otherwise(strip(less))


# ---- cleaning


def tables_to_text(c: Column) -> Column:
    """Cell boundaries become tabs, row ends line breaks; the other table tags go."""
    cells = F.regexp_replace(F.regexp_replace(c, "(?Ui)" + V.CELL_BOUNDARY, "\t"), "(?i)" + V.ROW_END, "\n")
    return F.regexp_replace(cells, "(?i)" + V.TABLE_TAGS, "")


def clean_line(c: Column, inline: bool = True) -> Column:
    """X03; without inline, paired marks inside a line stay."""
    steps = [(V.RECOGNISER_MARKS, ""), ("(?U)" + V.COORDINATES, ""), (V.TAGS, ""), ("(?U)" + V.LINE_START_MARKS, "$1")]
    steps += [("(?d)" + V.PAIRED_MARKS, "$2")] if inline else []
    for pattern, left in [*steps, ("(?U)" + V.ROW_END_BARS, ""), (V.SYMBOLS, "")]:
        c = F.regexp_replace(c, pattern, left)
    return strip(c)


#: Without a match a line has nothing that clean_line removes but its outer white space.
_MARKED = r"(?U)^\s*[#`>\-]|[<\[*_`|]|" + V.SYMBOLS


def _clean_marked_line(x: Column) -> Column:
    """clean_line of a lambda's variable, with its steps only where a line has a mark."""
    return F.when(x.rlike(_MARKED), clean_line(x)).otherwise(strip(x))


def collapse_blank_lines(c: Column) -> Column:
    """X04."""
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def split_lines(c: Column) -> Column:
    """At every kind of line break, without an empty last line."""
    lines = F.split(c, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", -1)
    return once(lines, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


MATH_REGION = "(?U)" + V.MATH_REGION


def over_plain_text(c: Column, change) -> Column:
    """Change what is outside formulas."""
    plain = F.split(c, MATH_REGION, -1)
    math = F.regexp_extract_all(c, F.lit(MATH_REGION), F.lit(0))
    return F.array_join(F.flatten(F.zip_with(F.transform(plain, change), math, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")


def over_math(c: Column, change, delimited: bool = True) -> Column:
    """Change what is inside formulas; a text without any is one formula, unless delimited is False."""

    def inside(m: Column) -> Column:
        n = F.when(m.startswith("$$") | m.startswith("\\"), 2).otherwise(1)
        return F.concat(F.substr(m, F.lit(1), n), change(F.substr(m, n + 1, F.char_length(m) - 2 * n)), F.substr(m, F.char_length(m) - n + 1, n))

    def whole(x: Column) -> Column:
        plain = F.split(x, MATH_REGION, -1)
        joined = lambda math: F.array_join(F.flatten(F.zip_with(plain, F.transform(math, lambda m: inside(m)), lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")
        found = F.when(x.contains("$") | x.contains("\\"), F.regexp_extract_all(x, F.lit(MATH_REGION), F.lit(0))).when(x.isNotNull(), F.array().cast("array<string>"))
        return once(found, lambda math: F.when(F.size(math) > 0, joined(math)).otherwise(change(x) if delimited else x))

    return once(c, whole)


def clean_text(c: Column, correct=None) -> Column:
    """The whole chain; correct is a Column function for what is outside formulas (a dictionary's, say)."""
    from .latex import clean_latex

    kept = F.filter(split_lines(tables_to_text(remove_repetition(c))), lambda x: ~is_leakage_line(x) & ~is_separator_line(x))
    text = strip(collapse_blank_lines(F.array_join(F.transform(kept, _clean_marked_line), "\n")))
    text = once(text, lambda x: F.when(is_leakage(x), "").otherwise(x))
    if correct is not None:
        text = once(text, lambda x: over_plain_text(x, correct))
    return once(text, clean_latex)


def parse_refined(raw: Column, original: Column) -> Column:
    """The corrected text inside a model's answer, or the original."""
    text = strip(F.regexp_replace(strip(raw), "(?Ui)" + V.THOUGHTS, ""))
    header = r"(?Uim)^" + V.CORRECTED_HEADER
    text = once(text, lambda x: F.when(x.rlike(header), strip(F.element_at(F.split(x, header, 2), -1))).otherwise(x))
    text = strip(F.element_at(F.split(text, r"(?Um)^-{3,}\s*$", -1), -1))
    for pattern in V.EXPLANATIONS:
        text = F.regexp_replace(text, "(?Udm)" + pattern, "")
    return once(strip(text), lambda x: F.when(is_blank(raw) | ~is_valid_refinement(x, original), original).otherwise(x))


# ---- classification


CLASSES = ("korean", "english", "math", "code", "table")


def content_scores(c: Column) -> Column:
    """Struct of the share of Hangul and Latin letters and the capped counts of formulas, code and table marks."""
    n = F.char_length(c)
    # the letters are counted by what is left without them: listing each one is several times slower
    letters_of = lambda letters: n - F.char_length(F.regexp_replace(c, letters + "+", ""))
    count = lambda patterns: F.regexp_count(c, F.lit("(?Um)" + "|".join(patterns)))
    share = lambda letters: F.when(n > 0, letters_of(letters) / n).otherwise(0.0)
    capped = lambda k, x: F.least(F.lit(k) * x, F.lit(1.0))
    scores = (share("[가-힣ㄱ-ㅎㅏ-ㅣ]"), share("[a-zA-Z]"), capped(0.15, count(V.MATH)), capped(0.15, count(V.CODE)), capped(0.2, count(V.TABLE)))
    return F.struct(*[s.alias(name) for name, s in zip(CLASSES, scores, strict=True)])


def _of_scores(c: Column, then) -> Column:
    """then(scores), with the scores of a text computed once."""
    return F.get(F.transform(F.array(content_scores(c)), lambda s: then({name: s[name] for name in CLASSES})), 0)


def class_of_scores(c: Column, s: Column) -> Column:
    """A05 of a text and its scores (a column that holds them): the class of the highest; mixed on a tie, korean without any score."""
    top = F.greatest(*[s[name] for name in CLASSES])
    ties = sum(((s[name] == top).cast("int") for name in CLASSES), F.lit(0))
    best = F.when(top == 0, "korean").when(ties > 1, "mixed").otherwise(F.coalesce(*[F.when(s[name] == top, F.lit(name)) for name in CLASSES]))
    return F.when(is_blank(c), "korean").otherwise(best)


def classify(c: Column) -> Column:
    """The class of the highest score; mixed on a tie, korean without any score."""
    return F.when(is_blank(c), "korean").otherwise(once(content_scores(c), lambda s: class_of_scores(c, s)))


REASONING = ("math", "code", "table")


def needs_reasoning(c: Column) -> Column:
    """texts of a class that a reasoning model looks at again."""
    return classify(c).isin(*REASONING)


def dominant_types(c: Column, least: float = 0.2) -> Column:
    """The classes with at least that share of all scores, in order; [korean] without any score."""

    def dominant(scores: dict[str, Column]) -> Column:
        total = sum(scores.values(), F.lit(0.0))
        found = F.array_compact(F.array(*[F.when(s >= least * total, F.lit(name)) for name, s in scores.items()]))
        return F.when(total == 0, F.array(F.lit("korean"))).otherwise(found)

    return F.when(is_blank(c), F.array(F.lit("korean"))).otherwise(_of_scores(c, dominant))


def classify_line(c: Column) -> Column:
    """X14, for one line, which is looked at without its outer white space."""

    def of_line(x: Column) -> Column:
        letters = lambda kind: F.char_length(F.regexp_replace(x, f"[^{kind}]+", ""))
        matches = lambda patterns: x.rlike("(?Um)" + "|".join(patterns))
        return F.when(x == "", "korean").when(matches(V.TABLE), "table").when(matches(V.CODE), "code").when(matches(V.MATH), "math").when(letters("a-zA-Z") > letters("가-힣ㄱ-ㅎㅏ-ㅣ"), "english").otherwise("korean")

    return F.when(c.isNull(), "korean").otherwise(once(strip(c), of_line))


# ---- splitting


def sentences(c: Column) -> Column:
    """Split after . ? ! and white space, or at the second of two line breaks."""
    return F.filter(F.split(c, r"(?U)(?<=[.?!])\s+|(?<=\n)\n", -1), lambda x: x != "")


def chunks(c: Column, most: int = 2000, overlap: int = 100) -> Column:
    """Sentences packed greedily; each chunk after the first starts with the end of the one before."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("current"))

    def step(a: Column, s: Column) -> Column:
        joined = F.when(a["current"] == "", s).otherwise(F.concat(a["current"], F.lit("\n"), s))
        over = (F.char_length(joined) > most) & (a["current"] != "")
        tail = F.when(F.char_length(a["current"]) > overlap, F.substr(a["current"], F.char_length(a["current"]) - overlap + 1, F.lit(overlap))).otherwise(a["current"])
        return F.when(over, F.struct(F.concat(a["done"], F.array(a["current"])).alias("done"), F.concat(tail, F.lit("\n"), s).alias("current"))).otherwise(F.struct(a["done"].alias("done"), joined.alias("current")))

    packed = F.aggregate(sentences(c), start, step, lambda a: F.when(is_blank(a["current"]), a["done"]).otherwise(F.concat(a["done"], F.array(a["current"]))))
    return F.when(is_blank(c), F.array().cast("array<string>")).when(F.char_length(c) <= most, F.array(c)).otherwise(packed)


def max_tokens(tokens: Column) -> Column:
    """1.3 times the tokens and 50, from 128 to 2048."""
    return F.least(F.greatest(F.floor(tokens * F.lit(13) / 10) + 50, F.lit(128)), F.lit(2048)).cast("long")


def max_tokens_of_text(c: Column) -> Column:
    return max_tokens(F.floor(F.char_length(c) * F.lit(3) / 2))


def prompt(c: Column, template: str, most: int = 2000) -> Column:
    """A template around the first characters of a text."""
    before, after = template.split("{text}")
    return F.concat(F.lit(before), F.substring(c, 1, most), F.lit(after))


def safe_name(c: Column) -> Column:
    """A file name without reserved characters, dots and spaces at its ends."""
    name = F.regexp_replace(F.regexp_replace(c, V.RESERVED, "_"), r"^[. ]+|[. ]+$", "")
    return F.when(name == "", "output").otherwise(name)


def bytes_text(c: Column) -> Column:
    """B, KB, MB or GB with one decimal."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    shown = lambda d, unit: F.format_string(f"%.1f {unit}", c / F.lit(d))
    return F.when(c < kb, F.format_string("%d B", c.cast("long"))).when(c < mb, shown(kb, "KB")).when(c < gb, shown(mb, "MB")).otherwise(shown(gb, "GB"))


def megabytes_text(mb: Column) -> Column:
    """MB without decimals, or GB with one from 1024 MB on."""
    return F.when(mb >= 1024, F.format_string("%.1f GB", mb.cast("double") / 1024)).otherwise(F.format_string("%.0f MB", mb.cast("double")))


def percent_text(done: Column, total: Column) -> Column:
    """A share in per cent with one decimal; 0.0 of nothing."""
    return F.format_string("%.1f%%", F.when(total > 0, done / total * 100).otherwise(0.0))


def duration_text(seconds: Column) -> Column:
    """Minutes and seconds."""
    s = F.floor(seconds).cast("long")
    return F.when(s >= 60, F.format_string("%dm %ds", F.floor(s / 60).cast("long"), s % 60)).otherwise(F.format_string("%ds", s))
