"""Hand-computed cases of the Column functions."""

from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.functions import latex
from quirefold.functions import text as T
from quirefold.operators import lexicon, partitioning


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, value, f):
    return values(spark, [(value,)], "c string", f(F.col("c")).alias("x"))[0][0]


def test_refinement_bounds(spark):
    rows = [("a" * 100, "b" * n) for n in (30, 29, 200, 201)] + [("", "x"), ("x", "")]
    got = values(spark, rows, "o string, r string", T.is_valid_refinement(F.col("r"), F.col("o")).alias("x"))
    assert [g[0] for g in got] == [True, False, True, False, False, False]


def test_predicates(spark):
    assert one(spark, "Do not use markdown", T.is_leakage) is True
    assert one(spark, "Do not use 한글", T.is_leakage) is False
    assert one(spark, " . From the image: text", T.is_leakage_line) is True
    assert one(spark, " ---- ", T.is_separator_line) is True
    assert one(spark, "--", T.is_separator_line) is False
    assert one(spark, "- 42 -" + " " * 60, T.should_refine) is False
    assert one(spark, "abc", T.guarded) == ""
    assert one(spark, "text <|ref|>open", lambda c: T.is_truncated(c, 2048)) is True
    assert one(spark, "", lambda c: T.is_truncated(c, 2048)) is False


def test_repetition(spark):
    lines = "a\nb\nb\nb\nc"
    assert one(spark, lines, T.repeated_line_offset) == 2
    assert one(spark, "a\n\n\n\n", T.repeated_line_offset) == -1
    assert one(spark, "short aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", T.remove_repetition) == "short aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"
    assert one(spark, "start " + "ab" * 60, T.remove_repetition) == "start abab"
    assert one(spark, None, T.remove_repetition) is None


def test_cleaning(spark):
    assert one(spark, "<tr><td>A</td><td>B</td></tr>", T.tables_to_text) == "A\tB\n"
    assert one(spark, "## **Title** [[1, 2,3,4]] |", T.clean_line) == "Title"
    assert one(spark, "a\r\nb\x85c\n", lambda c: F.array_join(T.split_lines(c), "|")) == "a|b|c"
    assert one(spark, "x $a$ y $$b$$ z", lambda c: T.over_plain_text(c, F.upper)) == "X $a$ Y $$b$$ Z"
    assert one(spark, "# Head\n---\noutput only text\nbody", T.clean_text) == "Head\nbody"
    answer = "<think>hm</think>corrected text: fixed words here"
    assert values(spark, [(answer, "fixed wordz here")], "r string, o string", T.parse_refined(F.col("r"), F.col("o")).alias("x"))[0][0] == "fixed words here"


def test_classification(spark):
    assert one(spark, "", T.classify) == "korean"
    assert one(spark, "123", T.classify) == "korean"
    assert one(spark, "plain words", T.classify) == "english"
    assert one(spark, "가나다라", T.classify) == "korean"
    assert one(spark, "a\tb\tc", T.classify_line) == "table"
    # a closing brace at the end makes code, which comes before mathematics
    assert one(spark, "x \\frac{1}{2}", T.classify_line) == "code"
    assert one(spark, "x \\frac{1}{2} y", T.classify_line) == "math"
    assert one(spark, "    if x", T.classify_line) == "english"
    assert one(spark, "   ", T.classify_line) == one(spark, None, T.classify_line) == "korean"


def test_truncation(spark):
    long, closed = "a" * 200, "b<|/det|>" * 4
    cut = lambda c: T.is_truncated(c, 100)
    assert [one(spark, closed + long + e, cut) for e in ("다", "9", "①", ")", '"', " 다\n", "x", "}", ">")] == [False] * 6 + [True] * 3
    assert not one(spark, "b<|/det|>" * 3 + long + "x", cut) and one(spark, "a" * 251, cut) and not one(spark, "", cut)
    assert one(spark, "x<|ref|>te", cut) and one(spark, "x<|det|>[[1", cut)


def test_grounded_blocks(spark):
    raw = "head<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|> A <|ref|>text<|/ref|> <|det|>[[5,5,5,1500]]<|/det|>B\nC<|ref|>text<|/ref|><|det|>[[0,0,1,1]]<|/det|>  <|ref|>table<|/ref|><|det|>[[999999999999999999999,0,1,1]]<|/det|>D<|ref|>"
    got = [tuple(b) for b in one(spark, raw, T.grounded_blocks)]
    assert got == [("A", "head", 1, 2, 3, 4, False), ("B\nC", "text", 5, 5, 6, 999, False), ("D<|ref|>", "table", 999, 0, 999, 1, True)]
    assert one(spark, "no marks", T.grounded_blocks) == [] and one(spark, "head<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|> A", T.grounded_blocks) == []


def test_chunks(spark):
    text = " ".join(f"Sentence number {i} has some words." for i in range(200))
    got = one(spark, text, T.chunks)
    assert len(got) > 2 and all(got[i + 1].startswith(got[i][-100:]) for i in range(len(got) - 1))
    assert one(spark, "short.", T.chunks) == ["short."]
    assert one(spark, " ", T.chunks) == []


def test_latex(spark):
    assert one(spark, r"$\sum{i=1}$", latex.clean_latex) == r"$\sum_{i=1}$"
    assert one(spark, "$ A{i}$", latex.clean_latex) == "$A_{i}$"
    assert one(spark, "A{i}", latex.clean_latex) == "A{i}"
    assert one(spark, "$A{i}$", latex.clean_latex) == "$A{i}$"
    assert one(spark, "$x_10$", latex.clean_latex) == "$x_{10}$"
    assert one(spark, "$E^mc$", latex.clean_latex) == "$E^{mc}$"
    assert one(spark, "a_long", latex.clean_latex) == "a_{long}"
    assert one(spark, "{{a", latex.close_braces) == "{{a}}"


def test_geometry(spark):
    row = values(spark, [(0,)], "z int", *[c.alias(f"c{i}") for i, c in enumerate(G.clamp(F.lit(999), F.lit(5), F.lit(999), F.lit(5)))])
    assert row == [(999, 5, 999, 6)]
    assert values(spark, [(0,)], "z int", G.max_workers(F.lit(24), F.lit(8)).alias("x")) == [(2,)]
    assert values(spark, [(0,)], "z int", G.percent(F.lit(15), F.lit(142)).alias("x")) == [(10.56,)]
    assert values(spark, [(0,)], "z int", *[c.alias(f"c{i}") for i, c in enumerate(G.model_progress(F.lit(25), F.lit(30), F.lit(10)))]) == [(3, 3, 5)]
    assert values(spark, [(10,), (5000,)], "t int", T.max_tokens(F.col("t")).alias("x")) == [(128,), (2048,)]


def test_volumes(spark):
    def ranges(pages, parts):
        got = values(spark, [(pages, parts)], "n long, k long", partitioning.aligned_ranges(F.col("n"), F.col("k"), 10).alias("x"))[0][0]
        return [(r["start"], r["end"]) for r in got]

    assert [e - s + 1 for s, e in ranges(100, 4)] == [30, 30, 20, 20]
    assert ranges(7, 3) == [(0, 2), (3, 4), (5, 6)]
    assert [e - s + 1 for s, e in ranges(95, 4)] == [30, 20, 20, 25]
    got = values(spark, [(p,) for p in range(25)], "p long", partitioning.worker_of(F.col("p"), F.lit(25), 2, 10).alias("x"))
    assert [g[0] for g in got] == [0] * 12 + [1] * 13
    assert {g[0] for g in values(spark, [(p,) for p in range(15)], "p long", partitioning.worker_of(F.col("p"), F.lit(15), 2, 10).alias("x"))} == {0}


def test_syllables(spark):
    got = values(spark, [("데",), ("a",)], "c string", lexicon.decompose(F.col("c")).alias("x"))
    assert tuple(got[0][0]) == (3, 5, 0) and got[1][0] is None
    assert values(spark, [(0,)], "z int", lexicon.compose(F.lit(3), F.lit(5), F.lit(0)).alias("x"), lexicon.compose(F.lit(19), F.lit(0), F.lit(0)).alias("y")) == [("데", "?")]
    assert tuple(one(spark, "학교에서는", lexicon.strip_particle)) == ("학교", "에서는")
    assert one(spark, "나는", lexicon.strip_particle) is None


def _plain_l02(s, cmds):
    out, i = "", 0
    while i < len(s):  # one of two backslashes before a command
        double = s[i : i + 2] == "\\\\" and s.startswith(cmds, i + 2)
        out += "\\" if double else s[i]
        i += 2 if double else 1
    s, out = out, ""
    for i, ch in enumerate(s):
        out += ch
        if out.endswith("\\frac") and not s[i + 1 :].lstrip().startswith("{"):
            out += "{}{}"
    s, out = out, ""
    for i, ch in enumerate(s):
        out += "{" + ch + "}" if s[:i].endswith("\\sqrt") and ch.isascii() and ch.isalnum() else ch
    return out


def _plain_l03(s, cmds):
    out = ""
    for i, ch in enumerate(s):
        out += "_" * (ch == "{" and s[:i].endswith(tuple("\\" + c for c in cmds))) + ch
    s, out = out, ""
    for i, ch in enumerate(s):
        inside = s[i + 1 : s.find("}", i)] if ch == "{" and "}" in s[i:] else ""
        scripted = inside and all(c.isspace() or c == "," or c.isascii() and c.isalnum() for c in inside)
        out += "_" * bool(scripted and i >= 2 and s[i - 1].isascii() and s[i - 1].isalpha() and s[i - 2] not in "\\_") + ch
    return out


def _plain_l04(s):
    if s.rstrip() and s.rstrip()[-1] in "_^":
        s = s.rstrip()[:-1]
    out, i = "", 0
    while i < len(s):
        j = i + 1
        while s[i] in "_^" and j < len(s) and s[j].isascii() and s[j].isalnum():
            j += 1
        if j - i > 2 and not s[j:].startswith("{") and not (i and s[i - 1] == "\\"):
            out += s[i] + "{" + s[i + 1 : j] + "}"
            i = j
        else:
            out += s[i]
            i += 1
    return out


def test_formula_repairs_against_plain_statements(spark):
    import random

    from quirefold.functions import values as V

    r = random.Random(1)
    parts = ["\\", "\\\\", "frac", "sqrt", "sum", "lim", "inf", "alpha", "{", "}", "_", "^", "a", "b", "x1", "12", " ", "  ", "\n", ",", "A{i}", "$", "é"]
    texts = sorted({"".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(3000)})
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", latex.common_errors(F.col("x")).alias("a"), latex.missing_subscripts(F.col("x")).alias("b"), latex.scripts(F.col("x")).alias("c"))
    for t in rows.collect():
        assert (t.a, t.b, t.c) == (_plain_l02(t.x, V.DOUBLED_COMMANDS), _plain_l03(t.x, V.SUBSCRIPT_COMMANDS), _plain_l04(t.x)), t.x


def test_display_of_small_and_large_numbers(spark):
    got = spark.createDataFrame([(0.0,), (1023.0,), (1024.0,), (5.5e9,)], "n double").select(T.bytes_text(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == ["0 B", "1023 B", "1.0 KB", "5.1 GB"]
    got = spark.createDataFrame([(512, 3, 9), (1536, 0, 0)], "mb int, a int, b int").select(T.megabytes_text(F.col("mb")).alias("s"), T.percent_text(F.col("a"), F.col("b")).alias("p")).collect()
    assert [(r.s, r.p) for r in got] == [("512 MB", "33.3%"), ("1.5 GB", "0.0%")]


ODD = ["", " ", "\\", "{", "a_{b", "\\frac12 \\sqrt3", "\\\\frac{1}{2}", "\\sum{i} xy{ab} x_ab ^", "{\\} {", "$ x_ab $ {", "$$\n x{a} $$", "no marks at all", "_ ", "a\\sqrt{2}}", None]


def test_formula_steps_are_skipped_where_nothing_can_change(spark):
    from pyspark.sql import functions as F

    from quirefold.functions import latex
    from quirefold.functions import values as V

    c = F.col("t")
    was = F.regexp_replace(F.regexp_replace(c, r"(?<=\\(?:" + "|".join(V.SUBSCRIPT_COMMANDS) + r"))(?=\{)", "_"), r"(?U)(?<=[^\\_][A-Za-z])(?=\{[A-Za-z0-9,\s]+\})", "_")
    rows = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", latex.missing_subscripts(c).alias("now"), was.alias("was"), latex.scripts(c).alias("s"), F.regexp_replace(F.regexp_replace(c, r"(?U)[\^_]\s*\z", ""), r"(?<!\\)([_^])(\p{Alnum}{2,}+)(?!\{)", "$1{$2}").alias("s0"))
    assert all(r["now"] == r["was"] and r["s"] == r["s0"] for r in rows.collect())
    assert "Contains" in spark.createDataFrame([("a",)], "t string").select(latex.clean_latex(c))._jdf.queryExecution().executedPlan().toString()


def test_lines_without_marks_skip_the_cleaning_steps(spark):
    from pyspark.sql import functions as F

    from quirefold.functions import text as T

    lines = ["plain", "  # head", "- item", "a - b", "> q", "```x", "**b** _i_ `c`", "|a|", " a | ", "<b>x</b>", "<|ref|>:x", "[[1, 2, 3, 4]]", "x \u2192 y", " \u00a0x\u3000", "", " ", "a_b"]
    rows = spark.createDataFrame([(x,) for x in lines], "t string").select(F.transform(F.array("t"), T._clean_marked_line)[0].alias("now"), T.clean_line(F.col("t")).alias("was"))
    assert all(r["now"] == r["was"] for r in rows.collect())


def test_guards_look_once(spark):
    from pyspark.sql import functions as F

    from quirefold.functions import text as T
    from quirefold.functions import values as V

    texts = ["", " \n", "abcd", " abcd ", " abcde\u3000", "a   b", "ab\ncd", "\U0001f600bcd", "\U0001f600bcde", "x DO NOT USE y", "ocr with GROUNDING", "\ubc95 print only", "\uc0b0\uc5c5\uae30\uc0ac x", "\ub300\ud55c", None]
    c, texts = F.col("t"), spark.createDataFrame([(x,) for x in texts], "t string")
    was = F.when(T.is_blank(c) | (F.char_length(T.strip(c)) < 5) | T.is_leakage(c), "").otherwise(c)
    rows = texts.select(T.guarded(c).alias("g"), was.alias("g0"), T.has_proper_nouns(c).alias("p"), c.rlike("|".join(V.PROPER_NOUNS)).alias("p0")).collect()
    assert all(r["g"] == r["g0"] and r["p"] == r["p0"] for r in rows) and any(r["p"] for r in rows)
    assert "RLIKE" not in texts.select(T.has_proper_nouns(c))._jdf.queryExecution().executedPlan().toString()
    assert [r[0] for r in texts.select(T.has_proper_nouns(c, ("^ab", "x.D"))).collect()][2:4] == [True, False]
