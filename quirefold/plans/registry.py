"""Registered queries of the document operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import latex
from ..functions import text as T
from ..functions import values as V
from ..operators import catalogue, layout, lexicon, pages, partitioning, placement, profiles, tables, voting
from ..streaming import jobs
from .derived import ctes, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
col = F.col


def query(*inputs: str, sql: str | None = None):
    """Register a function of the inputs' DataFrames under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[read(spark, sf_dir, n) for n in inputs])
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _q(pattern: str) -> str:
    """A pattern as a DuckDB string."""
    return "'" + pattern.replace("'", "''") + "'"


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
BLANK = r"regexp_full_match({0}, '\s*')"
LEAK_LINE = _q(r"(?i)^\s*\.?\s*(" + "|".join(V.LEAKAGE_STARTS) + ")")
MATH, CODE, TABLE = (_q("(?m)" + "|".join(p)) for p in (V.MATH, V.CODE, V.TABLE))


def _cleaned(c: str) -> str:
    """The steps of X03 in SQL, but for paired marks."""
    for pattern, left, every in ((V.RECOGNISER_MARKS, "", "g"), (V.COORDINATES, "", "g"), (V.TAGS, "", "g"), (V.LINE_START_MARKS, r"\1", ""), (V.ROW_END_BARS, "", "g"), (V.SYMBOLS, "", "g")):
        c = f"regexp_replace({c}, {_q(pattern)}, {_q(left)}, {_q(every)})"
    return c


def _scores(c: str) -> str:
    n = lambda p: f"len(regexp_extract_all({c}, {p}))"
    share = lambda p: f"CASE WHEN length({c}) > 0 THEN {n(p)} / length({c})::DOUBLE ELSE 0.0::DOUBLE END"
    cap = lambda k, p: f"least({k}::DOUBLE * {n(p)}, 1.0::DOUBLE)"
    return f"{share(_q('[가-힣ㄱ-ㅎㅏ-ㅣ]'))} AS korean, {share(_q('[a-zA-Z]'))} AS english, {cap(0.15, MATH)} AS math, {cap(0.15, CODE)} AS code, {cap(0.2, TABLE)} AS tbl"


def _class(text: str) -> str:
    top = "greatest(korean, english, math, code, tbl)"
    ties = " + ".join(f"({c} = {top})::INT" for c in ("korean", "english", "math", "code", "tbl"))
    return f"CASE WHEN {BLANK.format(text)} OR {top} = 0 THEN 'korean' WHEN {ties} > 1 THEN 'mixed' WHEN korean = {top} THEN 'korean' WHEN english = {top} THEN 'english' WHEN math = {top} THEN 'math' WHEN code = {top} THEN 'code' ELSE 'table' END"


# ---- text predicates


@query(
    "documents",
    sql=rf"""SELECT doc_id, length(text) > 5000 AS anomalous,
  length({STRIP.format('text')}) >= 50 AND NOT regexp_matches({STRIP.format('text')}, '^[\s\-–—]*\d+[\s\-–—]*$') AND NOT regexp_matches({STRIP.format('text')}, '^[=\-_─━*]{{3,}}\s*$') AS refine,
  NOT regexp_matches(text, '^\s*$') AND NOT regexp_matches(text, '[가-힣]') AND (regexp_matches(text, {_q('(?i)' + '|'.join(V.LEAKAGE_PHRASES))}) OR regexp_matches(text, '\\#\s*\\#\s*\\#')) AS leakage
FROM documents""",
)
def f01_f02_f05_text_predicates(docs):
    return docs.select("doc_id", T.is_anomalous(col("text")).alias("anomalous"), T.should_refine(col("text")).alias("refine"), T.is_leakage(col("text")).alias("leakage"))


@query(
    "dv_lines",
    sql=ctes("dv_lines") + rf"""SELECT doc_id, count(*)::BIGINT AS lines, count_if(regexp_matches(line, {LEAK_LINE}))::BIGINT AS leakage, count_if(regexp_matches(line, '^\s*[-=*]{{3,}}\s*$'))::BIGINT AS separators FROM dv_lines GROUP BY doc_id""",
)
def f03_f04_line_filters(lines):
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(T.is_leakage_line(col("line"))).alias("leakage"), F.count_if(T.is_separator_line(col("line"))).alias("separators"))


@query(
    "dv_versions",
    sql=ctes("dv_versions")
    + rf"""SELECT doc_id, page_num, CASE WHEN m = 0 THEN false WHEN n = 0 THEN m = 0 ELSE m >= 0.3::DOUBLE * n AND m <= 2.0::DOUBLE * n END AS refined,
  m > 0 AND m / greatest(length(original), 1)::DOUBLE >= 0.7::DOUBLE AND m / greatest(length(original), 1)::DOUBLE <= 1.3::DOUBLE AND NOT regexp_matches(b, {_q('^(' + '|'.join(V.BAD_CORRECTION_STARTS) + ')')}) AS corrected
FROM (SELECT *, length({STRIP.format('original')}) AS n, length({STRIP.format('v0')}) AS m, {STRIP.format('v0')} AS b FROM dv_versions)""",
)
def f07_f08_validity(versions):
    return versions.select("doc_id", "page_num", T.is_valid_refinement(col("v0"), col("original")).alias("refined"), T.is_valid_correction(col("v0"), col("original")).alias("corrected"))


@query(
    "documents",
    sql=rf"""SELECT doc_id, CASE WHEN t = '' THEN false ELSE regexp_matches(t, '(<\|ref\|>[^<]*$)|(<\|det\|>[^<]*$)') OR length(t) > 2000 OR (length(t) > 1200 AND len(parts) > 4 AND tail <> '' AND NOT contains({_q(V.TERMINATORS)}, right(tail, 1))) END AS truncated
FROM (SELECT *, {STRIP.format('parts[len(parts)]')} AS tail FROM (SELECT doc_id, t, string_split(t, '<|/det|>') AS parts FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN repeat('<|/det|>', 4) || text WHEN 2 THEN text || '<|det|>[[1' ELSE repeat('x<|/det|>', 5) || text || '다' END AS t FROM documents)))""",
)
def f17_truncation(docs):
    n = col("doc_id") % 4
    t = F.when(n == 0, col("text")).when(n == 1, F.concat(F.repeat(F.lit("<|/det|>"), F.lit(4)), "text")).when(n == 2, F.concat("text", F.lit("<|det|>[[1"))).otherwise(F.concat(F.repeat(F.lit("x<|/det|>"), F.lit(5)), "text", F.lit("다")))
    return docs.select("doc_id", T.is_truncated(t, 800).alias("truncated"))


@query(
    "documents",
    sql=rf"SELECT doc_id, regexp_matches(text, {_q('|'.join(V.PROPER_NOUNS))}) AS proper, md5(CASE WHEN {BLANK.format('text')} OR length({STRIP.format('text')}) < 5 OR (NOT regexp_matches(text, '[가-힣]') AND (regexp_matches(text, {_q('(?i)' + '|'.join(V.LEAKAGE_PHRASES))}) OR regexp_matches(text, '\\#\s*\\#\s*\\#'))) THEN '' ELSE text END) AS guarded, left(text, 500) AS first FROM documents",
)
def f06_f16_t06_guards(docs):
    return docs.select("doc_id", T.has_proper_nouns(col("text")).alias("proper"), F.md5(T.guarded(col("text"))).alias("guarded"), F.substring("text", 1, 500).alias("first"))


@query(
    "dv_versions",
    sql=ctes("dv_versions")
    + rf"""SELECT doc_id, page_num, kind, CASE WHEN m = 0 THEN false WHEN n = 0 THEN m = 0 ELSE m >= 0.3::DOUBLE * n AND m <= 2.0::DOUBLE * n END AS refined,
  m > 0 AND m / greatest(length(original), 1)::DOUBLE >= 0.7::DOUBLE AND m / greatest(length(original), 1)::DOUBLE <= 1.3::DOUBLE AND NOT regexp_matches(b, {_q('^(' + '|'.join(V.BAD_CORRECTION_STARTS) + ')')}) AS corrected
FROM (SELECT *, length({STRIP.format('original')}) AS n, length({STRIP.format('v')}) AS m, {STRIP.format('v')} AS b
FROM (SELECT doc_id, page_num, original, unnest(['whole', 'short', 'long']) AS kind, unnest([v0, left(v0, 40), v0 || v0 || v0]) AS v FROM dv_versions))""",
)
def f07_f08_validity_whole(versions):
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in (("whole", col("v0")), ("short", F.substring("v0", 1, 40)), ("long", F.concat("v0", "v0", "v0")))])
    rows = versions.select("doc_id", "page_num", "original", F.explode(kinds).alias("k")).select("doc_id", "page_num", "original", "k.*")
    return rows.select("doc_id", "page_num", "kind", T.is_valid_refinement(col("v"), col("original")).alias("refined"), T.is_valid_correction(col("v"), col("original")).alias("corrected"))


# ---- rewriting


@query(
    "pages",
    sql=f"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, {_q('(?i)' + V.CELL_BOUNDARY)}, chr(9), 'g'), {_q('(?i)' + V.ROW_END)}, chr(10), 'g'), {_q('(?i)' + V.TABLE_TAGS)}, '', 'g') AS text FROM pages",
)
def x02_tables_to_text(pages):
    return pages.select("page_id", T.tables_to_text(col("html")).alias("text"))


@query(
    "dv_lines",
    sql=ctes("dv_lines")
    + f"SELECT doc_id, i, {STRIP.format(_cleaned('line'))} AS line FROM dv_lines",
)
def x03_clean_line(lines):
    return lines.select("doc_id", "i", T.clean_line(col("line"), inline=False).alias("line"))


@query("documents", sql=r"SELECT doc_id, md5(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents")
def x04_blank_lines(docs):
    return docs.select("doc_id", F.md5(T.collapse_blank_lines(col("text"))).alias("digest"))


@query("documents", sql="SELECT doc_id, least(greatest(floor(floor(length(text) * 3 / 2) * 13 / 10) + 50, 128), 2048)::BIGINT AS tokens FROM documents")
def x13_max_tokens(docs):
    return docs.select("doc_id", T.max_tokens_of_text(col("text")).alias("tokens"))


@query(
    "documents",
    sql=r"""SELECT doc_id, count(*)::BIGINT AS sentences, sum(length(s))::BIGINT AS characters FROM (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), '\n\n+', chr(10) || chr(1), 'g'), chr(1))) AS s FROM documents) WHERE s <> '' GROUP BY doc_id""",
)
def x09_sentences(docs):
    s = docs.select("doc_id", F.explode(T.sentences(col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.char_length("s")).alias("characters"))


@query("documents")
def x10_x11_chunks(docs):
    return docs.select("doc_id", F.posexplode(T.chunks(col("text"))).alias("chunk", "text"))


@query("documents")
def x01_remove_repetition(docs):
    return docs.select("doc_id", T.remove_repetition(col("text")).alias("text"))


@query("documents")
def x06_clean_text(docs):
    return docs.select("doc_id", T.clean_text(col("text")).alias("text"))


@query("dv_versions")
def x08_parse_refined(versions):
    answer = F.concat(F.lit("<think>so</think>\ncorrected text:\n"), "v0")
    return versions.select("doc_id", "page_num", T.parse_refined(answer, col("original")).alias("text"))


@query("documents")
def l01_clean_latex(docs):
    return docs.select("doc_id", latex.clean_latex(col("text")).alias("text"))


@query(
    "documents",
    sql=r"""SELECT doc_id, least(greatest(len(regexp_extract_all(u, '\{')) - len(regexp_extract_all(u, '\}')), 0), 10)::BIGINT AS missing, md5(regexp_replace(regexp_replace(t, '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest
FROM (SELECT doc_id, t, regexp_replace(t, '\\[{}]', '', 'g') AS u FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{{a' WHEN 1 THEN '{' ELSE '' END || text AS t FROM documents))""",
)
def l05_l06_braces_spaces(docs):
    t = F.concat(F.when(col("doc_id") % 3 == 0, "{{a").when(col("doc_id") % 3 == 1, "{").otherwise(""), "text")
    rows = docs.select("doc_id", t.alias("t"))
    return rows.select("doc_id", (F.char_length(latex.close_braces(col("t"))) - F.char_length("t")).cast("long").alias("missing"), F.md5(latex.spaces(col("t"))).alias("digest"))


@query(
    "part",
    sql="""SELECT p_partkey, CASE WHEN n < 1024 THEN printf('%d B', n::BIGINT) WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024 * 10 + 0.5::DOUBLE) / 10) WHEN n < 1073741824 THEN printf('%.1f MB', floor(n / 1048576 * 10 + 0.5::DOUBLE) / 10) ELSE printf('%.1f GB', floor(n / 1073741824 * 10 + 0.5::DOUBLE) / 10) END AS size,
  CASE WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END AS took, CASE WHEN m >= 1024 THEN printf('%.1f GB', floor(m / 1024.0::DOUBLE * 10 + 0.5::DOUBLE) / 10) ELSE printf('%.0f MB', m::DOUBLE) END AS memory, printf('%.1f%%', s / 4099.0::DOUBLE * 100) AS share
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey ELSE p_partkey * power(1000, p_partkey % 4) + 7 END::DOUBLE AS n, p_partkey * 7 % 4000 AS s, p_partkey * 3 % 5000 AS m FROM part)""",
)
def x17_display(part):
    key = col("p_partkey")
    n = F.when(key % 4 == 0, key.cast("double")).otherwise(key * F.pow(F.lit(1000.0), key % 4) + 7)
    return part.select("p_partkey", T.bytes_text(n).alias("size"), T.duration_text(key * 7 % 4000).alias("took"), T.megabytes_text(key * 3 % 5000).alias("memory"), T.percent_text(key * 7 % 4000, F.lit(4099)).alias("share"))


@query("part", sql=r"""SELECT p_partkey, CASE WHEN n = '' THEN 'output' ELSE n END AS name FROM (SELECT p_partkey, regexp_replace(regexp_replace(p_name || ': a/b?.', '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS n FROM part)""")
def s18_safe_names(part):
    return part.select("p_partkey", T.safe_name(F.concat("p_name", F.lit(": a/b?."))).alias("name"))


# ---- classification


@query("documents", sql=f"SELECT doc_id, lang, {_class('text')} AS content, round(korean, 6) AS korean, round(english, 6) AS english, math, code, tbl FROM (SELECT *, {_scores('text')} FROM documents)")
def a04_a05_classify(docs):
    scored = docs.select("doc_id", "lang", "text", T.content_scores(col("text")).alias("s"))
    return scored.select("doc_id", "lang", T.class_of_scores(col("text"), col("s")).alias("content"), F.round("s.korean", 6).alias("korean"), F.round("s.english", 6).alias("english"), "s.math", "s.code", col("s.table").alias("tbl"))


@query(
    "conversations",
    sql=f"""SELECT conv_id, turn, CASE WHEN {BLANK.format('text')} OR total = 0 THEN 'korean' ELSE array_to_string(list_filter([CASE WHEN korean >= 0.2::DOUBLE * total THEN 'korean' END, CASE WHEN english >= 0.2::DOUBLE * total THEN 'english' END, CASE WHEN math >= 0.2::DOUBLE * total THEN 'math' END, CASE WHEN code >= 0.2::DOUBLE * total THEN 'code' END, CASE WHEN tbl >= 0.2::DOUBLE * total THEN 'table' END], lambda x: x IS NOT NULL), ',') END AS types
FROM (SELECT *, 0.0::DOUBLE + korean + english + math + code + tbl AS total FROM (SELECT *, {_scores('text')} FROM conversations))""",
)
def a06_dominant_types(conversations):
    return conversations.select("conv_id", "turn", F.array_join(T.dominant_types(col("text")), ",").alias("types"))


@query(
    "dv_lines",
    sql=ctes("dv_lines")
    + f"""SELECT doc_id, i, CASE WHEN line = '' THEN 'korean' WHEN regexp_matches(line, {TABLE}) THEN 'table' WHEN regexp_matches(line, {CODE}) THEN 'code' WHEN regexp_matches(line, {MATH}) THEN 'math' WHEN len(regexp_extract_all(line, '[a-zA-Z]')) > len(regexp_extract_all(line, '[가-힣ㄱ-ㅎㅏ-ㅣ]')) THEN 'english' ELSE 'korean' END AS content
FROM (SELECT doc_id, i, {STRIP.format("CASE i % 4 WHEN 0 THEN '    if ' || line WHEN 1 THEN line || ' $a$' WHEN 2 THEN line || ' | a | b |' ELSE line END")} AS line FROM dv_lines)""",
)
def x14_classify_lines(lines):
    n = col("i") % 4
    line = F.when(n == 0, F.concat(F.lit("    if "), "line")).when(n == 1, F.concat("line", F.lit(" $a$"))).when(n == 2, F.concat("line", F.lit(" | a | b |"))).otherwise(col("line"))
    return lines.select("doc_id", "i", T.classify_line(line).alias("content"))


@query("dv_versions", sql=ctes("dv_versions") + f"SELECT doc_id, page_num, {_class('original')} AS content FROM (SELECT *, {_scores('original')} FROM (SELECT doc_id, page_num, CASE WHEN doc_id % 3 = 0 THEN original || repeat(' $x$ ', 12) WHEN doc_id % 3 = 1 THEN original || repeat(' class A', 12) ELSE original END AS original FROM dv_versions)) WHERE {_class('original')} IN ('math', 'code', 'table')")
def f21_reasoning_pages(versions):
    n = col("doc_id") % 3
    page = F.when(n == 0, F.concat("original", F.repeat(F.lit(" $x$ "), F.lit(12)))).when(n == 1, F.concat("original", F.repeat(F.lit(" class A"), F.lit(12)))).otherwise(col("original"))
    pages = versions.select("doc_id", "page_num", page.alias("text")).where(T.needs_reasoning(col("text")))
    return pages.select("doc_id", "page_num", T.classify(col("text")).alias("content"))


@query(
    "documents",
    sql=rf"""WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'title<|/ref|><|det|>[[5, 6, 5, 2000]]<|/det|> lead ' ELSE '' END || '<|ref|>text<|/ref|><|det|>[[' || doc_id % 1300 || ', 7, 20, 30]]<|/det|>' || text || '<|ref|> table <|/ref|> <|det|>[[1,2,999,' || doc_id || ']]<|/det|>' || CASE doc_id % 4 WHEN 0 THEN '  ' ELSE 'a b' || chr(10) END AS raw FROM documents),
m AS (SELECT doc_id, unnest(list_zip(kinds, x1, y1, x2, y2, texts)) AS b, generate_subscripts(kinds, 1) AS n FROM (SELECT doc_id, {', '.join(f"regexp_extract_all(raw, {_q(V.GROUNDED_BLOCK)}, {g}) AS {c}" for g, c in enumerate(('kinds', 'x1', 'y1', 'x2', 'y2'), 1))}, regexp_split_to_array(raw, {_q(V.GROUNDED_BLOCK)})[2:] AS texts FROM r)),
rows AS (SELECT doc_id, n, {STRIP.format('b[1]')} AS kind, least(b[2]::BIGINT, 999) AS x1, least(b[3]::BIGINT, 999) AS y1, least(b[4]::BIGINT, 999) AS x2, least(b[5]::BIGINT, 999) AS y2, {STRIP.format('b[6]')} AS text FROM m
UNION ALL SELECT doc_id, 0, 'title', 5, 6, 5, 999, 'lead' FROM r WHERE doc_id % 3 = 0)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n))::BIGINT AS place, kind, x1::BIGINT AS x1, y1::BIGINT AS y1, (CASE WHEN x2 <= x1 THEN least(x1 + 1, 999) ELSE x2 END)::BIGINT AS x2, (CASE WHEN y2 <= y1 THEN least(y1 + 1, 999) ELSE y2 END)::BIGINT AS y2, md5(text) AS digest FROM rows WHERE text <> ''""",
)
def x16_grounded_blocks(docs):
    lead = F.when(col("doc_id") % 3 == 0, "title<|/ref|><|det|>[[5, 6, 5, 2000]]<|/det|> lead ").otherwise("")
    last = F.when(col("doc_id") % 4 == 0, "  ").otherwise("a b\n")
    raw = F.concat(lead, F.lit("<|ref|>text<|/ref|><|det|>[["), col("doc_id") % 1300, F.lit(", 7, 20, 30]]<|/det|>"), "text", F.lit("<|ref|> table <|/ref|> <|det|>[[1,2,999,"), "doc_id", F.lit("]]<|/det|>"), last)
    rows = docs.select("doc_id", F.posexplode_outer(T.grounded_blocks(raw)).alias("place", "b")).where("b IS NOT NULL")
    return rows.select("doc_id", (col("place") + 1).cast("long").alias("place"), "b.kind", *[col(f"b.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")], F.md5("b.text").alias("digest"))


# ---- repetition


@query(
    "dv_lines",
    sql=ctes("dv_lines")
    + r"""SELECT doc_id, min(i)::BIGINT AS line, arg_min(coalesce(before, 0), i)::BIGINT AS start_offset FROM (SELECT doc_id, i, line, lag(line, 1) OVER w AS p, lag(line, 2) OVER w AS q, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING) AS before FROM dv_lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE line = p AND line = q AND NOT regexp_full_match(line, '\s*') GROUP BY doc_id""",
)
def g14_repeated_lines(lines):
    return layout.repeated_line_start(lines, ["doc_id"]).select("doc_id", "line", col("offset").cast("long").alias("start_offset"))


# ---- lexicon


@query("dv_lines", "dv_terms", sql=ctes("dv_lines", "dv_terms") + "SELECT doc_id, count(*)::BIGINT AS known FROM (SELECT doc_id, unnest(string_split(line, ' ')) AS word FROM dv_lines) WHERE word IN (SELECT term FROM dv_terms) GROUP BY doc_id")
def k07_known_words(lines, terms):
    words = lines.select("doc_id", F.explode(F.split("line", " ", -1)).alias("word"))
    return lexicon.known_words(words, terms).groupBy("doc_id").agg(F.count("*").alias("known"))


@query("dv_versions", "dv_terms", sql=ctes("dv_versions", "dv_terms") + "SELECT v.line AS line, count(t.term)::BIGINT AS hits FROM (SELECT DISTINCT unnest(string_split(original, chr(10))) AS line FROM dv_versions) v LEFT JOIN dv_terms t ON contains(v.line, t.term) GROUP BY v.line")
def k08_term_hits(versions, terms):
    lines = versions.select(F.explode(F.split("original", "\n", -1)).alias("line")).distinct()
    return lexicon.term_hits(lines, ["line"], terms)


@query("part", "nation", sql="SELECT DISTINCT term FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS term FROM part UNION ALL SELECT lower(n_name) FROM nation) WHERE term <> ''")
def u01_union_terms(part, nation):
    words = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("term"))
    return lexicon.union_terms(words, nation.select(F.lower("n_name")))


def _hangul(spark_df, shift):
    """Words of two syllables made from part keys: a dictionary and misreadings of it."""
    n = col("p_partkey") + shift
    one = lexicon.compose((n % 19).cast("int"), (n % 21).cast("int"), F.lit(0))
    two = lexicon.compose((n * 7 % 19).cast("int"), (n * 5 % 21).cast("int"), F.lit(4))
    return spark_df.select(F.concat(one, two).alias("term"))


@query("part")
def d02_letter_spellings(part):
    return lexicon.letter_spellings(_hangul(part, 0).distinct())


@query("part")
def d01_d05_correct(part):
    terms = _hangul(part.where("p_partkey % 2 = 0"), 0).distinct()
    n = col("p_partkey")
    wrong = lexicon.compose((n % 19).cast("int"), F.when(n % 21 == 8, 13).otherwise(n % 21).cast("int"), F.lit(0))
    text = F.concat(wrong, lexicon.compose((n * 7 % 19).cast("int"), (n * 5 % 21).cast("int"), F.lit(4)), F.lit("에서, 끝"))
    return lexicon.correct_all(part.select("p_partkey", text.alias("text")), ["p_partkey"], terms, rounds=3)


_CODE = "(44032 + p_partkey * 2791 % 11172)"


@query("part", sql=f"SELECT p_partkey, chr({_CODE}::INT) AS syllable, (({_CODE} - 44032) // 588)::BIGINT AS initial, (({_CODE} - 44032) % 588 // 28)::BIGINT AS vowel, (({_CODE} - 44032) % 28)::BIGINT AS final FROM part")
def d04_syllables(part):
    n = col("p_partkey") * 2791 % 11172
    rows = part.select("p_partkey", lexicon.compose(F.floor(n / 588).cast("int"), F.floor(n % 588 / 28).cast("int"), (n % 28).cast("int")).alias("syllable"))
    return rows.withColumn("p", lexicon.decompose(col("syllable"))).select("p_partkey", "syllable", *[col(f"p.{c}").cast("long").alias(c) for c in ("initial", "vowel", "final")])


# ---- voting

_LINES = """lines AS (SELECT doc_id, page_num, original, i, coalesce(string_split(original, chr(10))[i + 1], '') AS o, coalesce(string_split(v0, chr(10))[i + 1], '') AS a, coalesce(string_split(v1, chr(10))[i + 1], '') AS b, coalesce(string_split(v2, chr(10))[i + 1], '') AS c
  FROM (SELECT *, unnest(range(greatest(len(string_split(original, chr(10))), len(string_split(v0, chr(10))), len(string_split(v1, chr(10))), len(string_split(v2, chr(10)))))) AS i FROM dv_versions)),
classed AS (SELECT doc_id, page_num, """ + _class("original") + """ AS content FROM (SELECT *, """ + _scores("original") + """ FROM dv_versions)),
stripped AS (SELECT l.*, k.content, """ + ", ".join(STRIP.format(c) + f" AS s{c}" for c in "abc") + """ FROM lines l JOIN classed k USING (doc_id, page_num)),
voted AS (SELECT *, CASE WHEN sa = '' AND sb = '' AND sc = '' THEN o WHEN sa = sb AND sb = sc THEN a WHEN sa = sb OR sa = sc THEN a WHEN sb = sc THEN b WHEN content = 'english' THEN a WHEN content IN ('korean', 'mixed') THEN b ELSE c END AS line,
  CASE WHEN sa = sb AND sb = sc THEN 'unanimous' WHEN sa = sb OR sa = sc OR sb = sc THEN 'majority' ELSE 'specialist' END AS source FROM stripped)"""  # fmt: skip


@query("dv_versions", sql=ctes("dv_versions") + ", " + _LINES + " SELECT doc_id, page_num, i::BIGINT AS i, content, line, source FROM voted")
def k04_v01_vote_lines(versions):
    return voting.vote_lines(versions, ["doc_id", "page_num"]).withColumn("i", col("i").cast("long"))


_PAGES = """, pages_voted AS (SELECT doc_id, page_num, any_value(content) AS content, string_agg(line, chr(10) ORDER BY i) AS text, count_if(source = 'unanimous') AS u, count_if(source = 'majority') AS m, count_if(source = 'specialist') AS s FROM voted GROUP BY doc_id, page_num),
sourced AS (SELECT *, CASE WHEN u = greatest(u, m, s) THEN 'unanimous' WHEN m = greatest(u, m, s) THEN 'majority' ELSE 'specialist' END AS source FROM pages_voted)"""


@query("dv_versions", sql=ctes("dv_versions") + ", " + _LINES + _PAGES + " SELECT doc_id, page_num, text, source, content FROM sourced")
def v02_a08_vote_pages(versions):
    return voting.vote_pages(versions, ["doc_id", "page_num"])


@query("dv_versions", sql=ctes("dv_versions") + ", " + _LINES + _PAGES + " SELECT source, count(*)::BIGINT AS pages FROM sourced GROUP BY source")
def a09_vote_stats(versions):
    return voting.vote_stats(voting.vote_pages(versions, ["doc_id", "page_num"]))


_HITS = """, hit AS (SELECT s, count(t.term) AS h FROM (SELECT DISTINCT sa AS s FROM stripped UNION SELECT DISTINCT sb FROM stripped UNION SELECT DISTINCT sc FROM stripped) LEFT JOIN dv_terms t ON contains(s, t.term) GROUP BY s),
counted AS (SELECT l.*, p.h AS ha, q.h AS hb, r.h AS hc, greatest(p.h, q.h, r.h) AS top FROM stripped l JOIN hit p ON sa = p.s JOIN hit q ON sb = q.s JOIN hit r ON sc = r.s),
chosen AS (SELECT *, top > 0 AND (ha = top)::INT + (hb = top)::INT + (hc = top)::INT = 1 AS alone FROM counted)"""


@query(
    "dv_versions",
    "dv_terms",
    sql=ctes("dv_versions", "dv_terms")
    + ", "
    + _LINES
    + _HITS
    + """ SELECT CASE WHEN sa = sb AND sb = sc THEN 'unanimous' WHEN alone THEN 'dictionary' WHEN sa = sb OR sa = sc OR sb = sc THEN 'majority' ELSE 'specialist' END AS source, count(*)::BIGINT AS lines FROM chosen GROUP BY 1""",
)
def v01_dictionary_vote(versions, terms):
    return voting.vote_lines(versions, ["doc_id", "page_num"], terms).groupBy("source").agg(F.count("*").alias("lines"))


_ENSEMBLE = "WITH dv_versions AS (SELECT conv_id AS doc_id, turn AS page_num, text AS original, CASE WHEN b THEN text ELSE replace(text, 'e', '3') END AS v0, text AS v1, CASE WHEN b THEN text ELSE replace(text, 'o', '0') END AS v2 FROM (SELECT *, " + BLANK.format("text") + " AS b FROM conversations)), "


@query("conversations", sql=_ENSEMBLE + _LINES + _PAGES + " SELECT doc_id AS conv_id, page_num AS turn, text, source, content FROM sourced")
def v03_ensemble(conversations):
    pages = conversations.select("conv_id", "turn", "text")
    return voting.ensemble(pages, ["conv_id", "turn"], (lambda c: F.replace(c, F.lit("e"), F.lit("3")), lambda c: c, lambda c: F.replace(c, F.lit("o"), F.lit("0"))))


@query("conversations", sql="SELECT conv_id, turn, replace(replace(text, 'e', '3'), 'o', '0') AS text FROM conversations")
def v04_cascade(conversations):
    return conversations.select("conv_id", "turn", voting.cascade(col("text"), (lambda c: F.replace(c, F.lit("e"), F.lit("3")), lambda c: F.replace(c, F.lit("o"), F.lit("0")))).alias("text"))


def _valid(new: str, old: str) -> str:
    """F08 in SQL; both are stripped."""
    return f"({new} <> '' AND length({new}) / greatest(length({old}), 1)::DOUBLE >= 0.7::DOUBLE AND length({new}) / greatest(length({old}), 1)::DOUBLE <= 1.3::DOUBLE AND NOT regexp_matches({new}, {_q('^(' + '|'.join(V.BAD_CORRECTION_STARTS) + ')')}))"


@query(
    "dv_versions",
    sql=ctes("dv_versions") + f""", z AS (SELECT doc_id, page_num, original, string_split(original, chr(10)) AS a, string_split(v0, chr(10)) AS b FROM dv_versions),
  l AS (SELECT doc_id, page_num, i, a[i] AS x, {STRIP.format('b[i]')} AS y FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM z WHERE len(a) = len(b)))
SELECT doc_id, page_num, string_agg(CASE WHEN {_valid('y', 'x')} THEN y ELSE x END, chr(10) ORDER BY i) AS text FROM l GROUP BY ALL UNION ALL SELECT doc_id, page_num, original FROM z WHERE len(a) <> len(b)""",
)
def v05_accept_lines(versions):
    return versions.select("doc_id", "page_num", voting.accept_lines(col("original"), col("v0")).alias("text"))


_FIX = "replace(replace({0}, 'e', '3'), 'q', chr(10))"


@query(
    "dv_lines",
    sql=ctes("dv_lines") + f""", r AS (SELECT *, i // 4 AS row_id, {STRIP.format('line')} AS own FROM dv_lines),
  g AS (SELECT doc_id, row_id, string_agg(line, chr(10) ORDER BY i) AS batch, count(*) AS n FROM r WHERE length(own) >= 3 GROUP BY ALL),
  h AS (SELECT *, string_split({STRIP.format(_FIX.format('batch'))}, chr(10)) AS answer FROM g),
  k AS (SELECT r.*, h.n, h.answer, h.batch, row_number() OVER (PARTITION BY r.doc_id, r.row_id, length(own) >= 3 ORDER BY i) AS place FROM r LEFT JOIN h USING (doc_id, row_id)),
  m AS (SELECT *, {STRIP.format('answer[place]')} AS together, {STRIP.format(_FIX.format('left(own, 500)'))} AS alone FROM k)
SELECT doc_id, row_id::BIGINT AS row_id, i, md5(CASE WHEN length(own) < 3 THEN line WHEN length(batch) > 500 OR len(answer) <> n THEN CASE WHEN {_valid('alone', 'own')} THEN alone ELSE line END WHEN {_valid('together', 'own')} THEN together ELSE line END) AS digest FROM m""",
)
def v05_correct_blocks(lines):
    rows = lines.select("doc_id", F.floor(col("i") / 4).alias("row_id"), "i", col("line").alias("text"))
    fixed = voting.correct_blocks(rows, ["doc_id", "row_id"], lambda c: F.replace(F.replace(c, F.lit("e"), F.lit("3")), F.lit("q"), F.lit("\n")), order="i")
    return fixed.select("doc_id", "row_id", "i", F.md5("text").alias("digest"))


# ---- geometry


@query(
    "dv_boxes",
    sql=ctes("dv_boxes")
    + """SELECT page_num, ord, round(x1 / 999.0::DOUBLE * 595, 6) AS x, round(842 - y2 / 999.0::DOUBLE * 842, 6) AS y, round((x2 - x1) / 999.0::DOUBLE * 595, 6) AS w, round((y2 - y1) / 999.0::DOUBLE * 842, 6) AS h,
  least(greatest(x1, 0), 999)::BIGINT AS cx1, CASE WHEN least(x2, 999) <= x1 THEN least(x1 + 1, 999) ELSE least(x2, 999) END::BIGINT AS cx2, floor(x1 / 1200.0::DOUBLE * 999)::BIGINT AS grid, least(x2 + floor((y2 - y1) * 0.3::DOUBLE), 1200)::BIGINT AS padded FROM dv_boxes""",
)
def m01_m02_m04_m05_boxes(boxes):
    b = [col(c) for c in ("x1", "y1", "x2", "y2")]
    x, y, w, h = G.to_points(*b, F.lit(595), F.lit(842))
    c = G.clamp(*b)
    pad = G.padded(*b, F.floor((b[3] - b[1]) * F.lit(0.3)), F.lit(1200), F.lit(1200))
    return boxes.select("page_num", "ord", *[F.round(v, 6).alias(n) for v, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))], c[0].cast("long").alias("cx1"), c[2].cast("long").alias("cx2"), G.to_grid(b[0], F.lit(1200)).alias("grid"), pad[2].cast("long").alias("padded"))


@query(
    "dv_words",
    sql=ctes("dv_words") + """SELECT page_num, ord, w < 0.008::DOUBLE * 1200 OR h < 0.004::DOUBLE * 400 OR h / greatest(w, 1)::DOUBLE > 10 AS noise, w >= 0.01::DOUBLE * 1200 AND h >= 0.003::DOUBLE * 400 AS large, h >= greatest(floor(400 * 0.003::DOUBLE), 8) AND h <= floor(400 * 0.06::DOUBLE) AND w >= floor(1200 * 0.015::DOUBLE) AS fits, conf >= 30 AND w >= 5 AND h >= 5 AND trim(text) <> '' AS word FROM dv_words""",
)
def f09_f10_f11_f12_size_filters(words):
    a = (col("w"), col("h"), F.lit(1200), F.lit(400))
    return words.select("page_num", "ord", G.is_noise(*a).alias("noise"), G.is_large_enough(*a).alias("large"), G.is_text_size(*a).alias("fits"), G.is_word(col("conf"), col("w"), col("h"), col("text")).alias("word"))


@query("dv_boxes", sql=ctes("dv_boxes") + "SELECT a.page_num, a.ord, count(*)::BIGINT AS n FROM dv_boxes a JOIN dv_boxes b ON a.page_num = b.page_num AND NOT (a.x2 < b.x1 OR b.x2 < a.x1 OR a.y2 < b.y1 OR b.y2 < a.y1) GROUP BY 1, 2")
def f22_overlaps(boxes):
    other = boxes.select("page_num", *[col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    pairs = boxes.join(other, "page_num").where(G.overlaps([col(c) for c in ("x1", "y1", "x2", "y2")], [col(f"_{c}") for c in ("x1", "y1", "x2", "y2")]))
    return pairs.groupBy("page_num", "ord").agg(F.count("*").alias("n"))


@query("part", sql="SELECT p_partkey, CASE WHEN p_size - 6 <= 0 THEN 1 ELSE greatest(least(floor((p_size - 6) / 8.0::DOUBLE), 4), 1) END::BIGINT AS workers, CASE WHEN p_retailprice * 5 >= 8000 THEN 'fatal' WHEN p_retailprice * 5 >= 5000 THEN 'danger' WHEN p_retailprice * 5 >= 4000 THEN 'warn' ELSE 'ok' END AS level, CASE WHEN p_size > 30 THEN floor(p_size * (30.0::DOUBLE / p_size)) ELSE p_size END::BIGINT AS resized FROM part")
def m06_m08_m12_limits(part):
    size = G.resized(col("p_size"), col("p_size"), 30)[0]
    return part.select("p_partkey", G.max_workers(col("p_size"), F.lit(8)).cast("long").alias("workers"), G.memory_level(col("p_retailprice") * 5).alias("level"), size.cast("long").alias("resized"))


@query("dv_job_events", sql=ctes("dv_job_events") + "SELECT job_id, seq, round(seq % 100 / 100.0::DOUBLE * 100, 2) AS pct, ceil(300 / 100.0::DOUBLE)::BIGINT AS models, least(greatest(ceil((seq % 300) / 100.0::DOUBLE), 1), 3)::BIGINT AS model FROM dv_job_events")
def m09_m11_progress(events):
    models, model, _ = G.model_progress(col("seq") % 300, F.lit(300), F.lit(100))
    return events.select("job_id", "seq", G.percent(col("seq") % 100, F.lit(100)).alias("pct"), models.cast("long").alias("models"), model.cast("long").alias("model"))


# ---- layout

_RUNNING = """w AS (SELECT *, y + h / 2.0::DOUBLE AS cy, row_number() OVER (PARTITION BY page_num ORDER BY y, x, ord) AS k FROM dv_words),
f AS (SELECT page_num, k, ord, 0 AS rid, 1.0::DOUBLE AS n, cy::DOUBLE AS sc, h::DOUBLE AS sh FROM w WHERE k = 1
  UNION ALL SELECT w.page_num, w.k, w.ord, CASE WHEN {joins} THEN f.rid ELSE f.rid + 1 END, CASE WHEN {joins} THEN f.n + 1 ELSE 1.0::DOUBLE END, CASE WHEN {joins} THEN f.sc + w.cy ELSE w.cy::DOUBLE END, CASE WHEN {joins} THEN f.sh + w.h ELSE w.h::DOUBLE END
  FROM f JOIN w ON w.page_num = f.page_num AND w.k = f.k + 1)"""


def _running(joins: str) -> str:
    return "WITH RECURSIVE " + ctes("dv_words")[5:].rstrip() + ", " + _RUNNING.format(joins=joins)


_G03 = "abs(w.cy - f.sc / f.n) <= 0.6::DOUBLE * (f.sh / f.n)"
_G01 = "(abs(w.cy - f.sc / f.n) <= 0.5::DOUBLE * (f.sh / f.n) AND least(f.sh / f.n, w.h) / greatest(f.sh / f.n, w.h, 1.0::DOUBLE) > 0.33::DOUBLE)"


@query("dv_words", sql=_running(_G03) + " SELECT page_num, ord, rid::BIGINT AS row_id FROM f")
def g03_running_rows(words):
    return layout.running_rows(words, ["page_num"]).select("page_num", "ord", col("row_id").cast("long").alias("row_id"))


@query("dv_words", sql=_running(_G01) + " SELECT page_num, ord, rid::BIGINT AS row_id FROM f")
def g01_region_rows(words):
    return layout.running_rows(words, ["page_num"], 0.5, 0.33).select("page_num", "ord", col("row_id").cast("long").alias("row_id"))


def _boxed(words):
    return words.withColumns({"x2": col("x") + col("w"), "y2": col("y") + col("h")})


_CELLS = """, j AS (SELECT w.*, w.x + w.w AS x2, w.y + w.h AS y2, f.rid FROM w JOIN f USING (page_num, ord)),
m AS (SELECT *, avg(h) OVER (PARTITION BY page_num, rid) AS mh, lag(x2) OVER (PARTITION BY page_num, rid ORDER BY x, ord) AS px2 FROM j),
c AS (SELECT *, sum(CASE WHEN x - px2 > {threshold} THEN 1 ELSE 0 END) OVER (PARTITION BY page_num, rid ORDER BY x, ord ROWS UNBOUNDED PRECEDING) AS cid FROM m)"""


@query(
    "dv_words",
    sql=_running(_G03) + _CELLS.format(threshold="greatest(1.2::DOUBLE * mh, 36.0::DOUBLE)") + r""" SELECT page_num, rid::BIGINT AS row_id, cid::BIGINT AS cell_id, min(x)::BIGINT AS x, min(y)::BIGINT AS y, max(x2)::BIGINT AS x2, max(y2)::BIGINT AS y2, coalesce(string_agg(text, ' ' ORDER BY x, ord) FILTER (WHERE text <> ' '), '') AS text FROM c GROUP BY page_num, rid, cid""",
)
def g03_cells(words):
    c = layout.cells(_boxed(words), ["page_num"], 1200)
    return c.select("page_num", *[col(n).cast("long").alias(n) for n in ("row_id", "cell_id", "x", "y", "x2", "y2")], "text")


@query("dv_words", sql=_running(_G01) + _CELLS.format(threshold="1.5::DOUBLE * mh") + " SELECT page_num, rid::BIGINT AS row_id, cid::BIGINT AS cell_id, min(x)::BIGINT AS x, max(x2)::BIGINT AS x2, count(*)::BIGINT AS n FROM c GROUP BY page_num, rid, cid")
def g02_a02_regions(words):
    c = layout.regions(_boxed(words), ["page_num"])
    return c.select("page_num", *[col(n).cast("long").alias(n) for n in ("row_id", "cell_id", "x", "x2", "n")])


@query("dv_words", sql=ctes("dv_words") + """SELECT page_num, block_num::BIGINT AS block_num, line_num::BIGINT AS line_num, min(x)::BIGINT AS x, min(y)::BIGINT AS y, max(x + w)::BIGINT AS x2, max(y + h)::BIGINT AS y2, string_agg(text, ' ' ORDER BY ord) FILTER (WHERE text <> ' ') AS text FROM dv_words GROUP BY page_num, block_num, par_num, line_num HAVING count_if(text <> ' ') > 0""")
def a01_word_lines(words):
    lines = layout.word_lines(_boxed(words), ["page_num"])
    return lines.select("page_num", *[col(n).cast("long").alias(n) for n in ("block_num", "line_num", "x", "y", "x2", "y2")], "text")


@query("dv_words", sql=ctes("dv_words") + "SELECT page_num, list_sort(list(h))[(len(list(h)) // 2 + 1)::BIGINT]::BIGINT AS mid, min(x)::BIGINT AS x, max(y + h)::BIGINT AS y2 FROM dv_words GROUP BY page_num HAVING count(*) >= 2")
def a03_a12_page_hull(words):
    h = layout.hull(_boxed(words), ["page_num"], layout.upper_median("h").cast("long").alias("mid"), F.count("*").alias("n"))
    return h.where("n >= 2").select("page_num", "mid", col("x").cast("long").alias("x"), col("y2").cast("long").alias("y2"))


@query(
    "dv_words",
    sql=ctes("dv_words") + """, h AS (SELECT page_num, conf % 3 = 0 AS second, min(x) AS x, min(y) AS y, max(x + w) AS x2, max(y + h) AS y2, count(*) AS n FROM dv_words WHERE conf % 3 = 0 OR page_num % 5 > 1 AND ord < 14 OR ord = 1 GROUP BY ALL)
SELECT page_num, x::BIGINT AS x, y::BIGINT AS y, x2::BIGINT AS x2, y2::BIGINT AS y2, n::BIGINT AS n FROM h WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY page_num ORDER BY n DESC, second) = 1""",
)
def a03_longer_list(words):
    words = _boxed(words)
    first = words.where("conf % 3 != 0 AND (page_num % 5 > 1 AND ord < 14 OR ord = 1)")
    return _longs(layout.page_hull(first, words.where("conf % 3 = 0"), ["page_num"]), "x", "y", "x2", "y2", "n")


@query(
    "part",
    "supplier",
    sql="""WITH c AS (SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 3 <> 0 THEN concat('k', s_suppkey % 40) END AS id, CASE WHEN s_suppkey % 4 <> 0 THEN concat('k', s_suppkey * 7 % 60) END AS alias, s_name AS name FROM supplier),
  n AS (SELECT id AS key, 0 AS kind, ord, name FROM c WHERE id IS NOT NULL UNION ALL SELECT alias, 1, ord, name FROM c WHERE alias IS NOT NULL), f AS (SELECT key, name FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY kind, ord) = 1)
SELECT p_partkey, f.name FROM (SELECT p_partkey, concat('k', p_partkey % 70) AS key FROM part) p LEFT JOIN f USING (key)""",
)
def k10_catalogue(part, supplier):
    key = lambda n: F.concat(F.lit("k"), n.cast("string"))
    n = col("s_suppkey")
    entries = supplier.select(n.alias("ord"), F.when(n % 3 != 0, key(n % 40)).alias("id"), F.when(n % 4 != 0, key(n * 7 % 60)).alias("alias"), col("s_name").alias("name"))
    return catalogue.lookup(part.select("p_partkey", key(col("p_partkey") % 70).alias("key")), entries, "key").select("p_partkey", "entry.name")


@query("dv_boxes", sql=ctes("dv_boxes") + """SELECT page_num, ord, sum(CASE WHEN abs(c - p) > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY page_num ORDER BY c, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS row_id FROM (SELECT *, lag(c) OVER (PARTITION BY page_num ORDER BY c, ord) AS p FROM (SELECT *, floor((y1 + y2) / 2)::BIGINT AS c FROM dv_boxes))""")
def g07_table_rows(boxes):
    return layout.table_rows(boxes, ["page_num"]).select("page_num", "ord", col("row_id").cast("long").alias("row_id"))


@query("dv_words", sql=ctes("dv_words") + """SELECT page_num, ord, sum(CASE WHEN abs(c - p) > 0.5::DOUBLE * h THEN 1 ELSE 0 END) OVER (PARTITION BY page_num ORDER BY y, x, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS row_id FROM (SELECT *, lag(c) OVER (PARTITION BY page_num ORDER BY y, x, ord) AS p FROM (SELECT *, y + h / 2.0::DOUBLE AS c FROM dv_words))""")
def g08_reading_rows(words):
    return layout.reading_rows(words, ["page_num"]).select("page_num", "ord", col("row_id").cast("long").alias("row_id"))


@query(
    "dv_words",
    sql=ctes("dv_words") + """, r AS (SELECT *, sum(CASE WHEN abs(c - p) > 0.5::DOUBLE * h THEN 1 ELSE 0 END) OVER (PARTITION BY page_num ORDER BY y, x, ord ROWS UNBOUNDED PRECEDING) AS rid FROM (SELECT *, lag(c) OVER (PARTITION BY page_num ORDER BY y, x, ord) AS p FROM (SELECT *, y + h / 2.0::DOUBLE AS c FROM dv_words))),
  t AS (SELECT page_num, rid, coalesce(string_agg(text, chr(9) ORDER BY x, ord) FILTER (WHERE text <> ' '), '') AS text FROM r GROUP BY page_num, rid)
SELECT page_num, string_agg(text, chr(10) ORDER BY rid) AS text FROM t GROUP BY page_num""",
)
def a15_page_text(words):
    return layout.page_text(words, ["page_num"])


_longs = lambda df, *names: df.withColumns({n: col(n).cast("long") for n in names})


@query("dv_words", sql=_running(_G03).replace("AS k FROM dv_words)", "AS k FROM dv_words WHERE conf >= 10 AND trim(text) <> '')") + " SELECT w.page_num, rid::BIGINT AS row_id, min(x)::BIGINT AS x, min(y)::BIGINT AS y, max(x + w)::BIGINT AS x2, max(y + h)::BIGINT AS y2, 0.8::DOUBLE AS confidence FROM w JOIN f USING (page_num, ord) GROUP BY w.page_num, rid")
def s09_region_rows(words):
    return _longs(layout.region_rows(_boxed(words), ["page_num"]), "row_id", "x", "y", "x2", "y2")


@query(
    "dv_words",
    sql=_running(_G03) + """, d AS (SELECT page_num, list_sort(list(h))[(len(list(h)) // 2 + 1)::BIGINT] AS mid FROM dv_words GROUP BY page_num),
  j AS (SELECT w.*, w.x + w.w AS x2, w.y + w.h AS y2, f.rid, mid, CASE WHEN w.h > 1.4::DOUBLE * mid THEN 'large' WHEN w.h < 0.7::DOUBLE * mid THEN 'small' ELSE 'medium' END AS size FROM w JOIN f USING (page_num, ord) JOIN d USING (page_num)),
  c AS (SELECT *, sum(CASE WHEN x - px2 > 1.5::DOUBLE * mid THEN 1 ELSE 0 END) OVER (PARTITION BY page_num, rid, size ORDER BY x, ord ROWS UNBOUNDED PRECEDING) AS cid FROM (SELECT *, lag(x2) OVER (PARTITION BY page_num, rid, size ORDER BY x, ord) AS px2 FROM j))
SELECT page_num, rid::BIGINT AS row_id, size, cid::BIGINT AS cell_id, min(x)::BIGINT AS x, min(y)::BIGINT AS y, max(x2)::BIGINT AS x2, max(y2)::BIGINT AS y2, floor(avg(h))::BIGINT AS char_height, coalesce(string_agg(text, ' ' ORDER BY x, ord) FILTER (WHERE text <> ' '), '') AS text FROM c GROUP BY page_num, rid, size, cid""",
)
def g04_sized_blocks(words):
    return _longs(layout.sized_blocks(_boxed(words), ["page_num"]), "row_id", "cell_id", "x", "y", "x2", "y2", "char_height")


_G06 = "abs(w.cy - f.sc / f.n) <= 0.7::DOUBLE * (f.sh / f.n)"
_JOINS_SENTENCE = "o.rid = s.rid AND o.size = s.size AND o.size <> 'small' AND o.x - s.reach <= 3 * s.head"


@query(
    "dv_words",
    sql=_running(_G06) + f""", o AS (SELECT w.*, f.rid, w.x + w.w AS x2, row_number() OVER (PARTITION BY w.page_num ORDER BY f.rid, CASE WHEN w.h > 22 THEN 'large' WHEN w.h < 18 THEN 'small' ELSE 'medium' END, w.x, w.ord) AS place, CASE WHEN w.h > 22 THEN 'large' WHEN w.h < 18 THEN 'small' ELSE 'medium' END AS size FROM w JOIN f USING (page_num, ord)),
  s AS (SELECT page_num, place, ord, rid, size, 0 AS gid, x2 AS reach, h AS head FROM o WHERE place = 1
    UNION ALL SELECT o.page_num, o.place, o.ord, o.rid, o.size, CASE WHEN {_JOINS_SENTENCE} THEN s.gid ELSE s.gid + 1 END, o.x2, CASE WHEN {_JOINS_SENTENCE} THEN s.head ELSE o.h END FROM s JOIN o ON o.page_num = s.page_num AND o.place = s.place + 1)
SELECT o.page_num, s.gid::BIGINT AS group_id, o.rid::BIGINT AS row_id, o.size, min(x)::BIGINT AS x, min(y)::BIGINT AS y, max(o.x2)::BIGINT AS x2, max(y + h)::BIGINT AS y2, floor(avg(h))::BIGINT AS char_height, count(*)::BIGINT AS n FROM o JOIN s USING (page_num, place) GROUP BY ALL""",
)
def g06_sentence_blocks(words):
    sized = _boxed(words).withColumn("size", F.when(col("h") > 22, "large").when(col("h") < 18, "small").otherwise("medium"))
    return _longs(layout.sentence_blocks(sized, ["page_num"]), "group_id", "row_id", "x", "y", "x2", "y2", "char_height", "n")


def _growing(table: str, order: str, joins: str, more: str = "", more_kept: str = "", more_new: str = "") -> str:
    """Boxes of a table b in an order, each in the group of the box before or in a new one; the group's box grows."""
    grow = lambda c, f: f"CASE WHEN {joins} THEN {f}(s.{c}, o.{c}) ELSE o.{c} END"
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY page_num ORDER BY {order}) AS place FROM ({table})),
  s AS (SELECT page_num, place, 0 AS gid, x, y, x2, y2{more} FROM o WHERE place = 1
    UNION ALL SELECT o.page_num, o.place, CASE WHEN {joins} THEN s.gid ELSE s.gid + 1 END, {grow('x', 'least')}, {grow('y', 'least')}, {grow('x2', 'greatest')}, {grow('y2', 'greatest')}{more_new and f', CASE WHEN {joins} THEN {more_kept} ELSE {more_new} END'} FROM s JOIN o ON o.page_num = s.page_num AND o.place = s.place + 1)"""


_WORD_BOXES = "SELECT page_num, ord, x::DOUBLE AS x, y::DOUBLE AS y, (x + w)::DOUBLE AS x2, (y + h)::DOUBLE AS y2, h::DOUBLE AS h, text FROM dv_words"
_CLOSE = "(abs((o.y + o.y2) / 2 - (s.y + s.y2) / 2) <= 0.35::DOUBLE * greatest(o.y2 - o.y, s.y2 - s.y) AND o.x < s.x2 + 0.3::DOUBLE * greatest(o.y2 - o.y, s.y2 - s.y))"
_BELOW = "(least(s.x2, o.x2) - greatest(s.x, o.x) >= 0.7::DOUBLE * least(s.x2 - s.x, o.x2 - o.x) AND o.y - s.y2 <= 1.5::DOUBLE * s.h)"
_RECURSIVE_WORDS = "WITH RECURSIVE " + ctes("dv_words")[5:].rstrip() + ", "
_GROUPED = "min(o.x)::BIGINT AS x, min(o.y)::BIGINT AS y, max(o.x2)::BIGINT AS x2, max(o.y2)::BIGINT AS y2"


@query("dv_words", sql=_RECURSIVE_WORDS + _growing(_WORD_BOXES, "(y + y2) / 2, (x + x2) / 2, ord", _CLOSE) + f" SELECT o.page_num, s.gid::BIGINT AS group_id, {_GROUPED}, arg_min(o.text, o.place) AS text, count(*)::BIGINT AS n FROM o JOIN s USING (page_num, place) GROUP BY o.page_num, s.gid")
def g09_merge_close(words):
    return _longs(layout.merge_close(_boxed(words), ["page_num"]), "group_id", "x", "y", "x2", "y2")


_INSIDE = "o.x >= s.x AND o.y >= s.y AND o.x2 <= s.x2 AND o.y2 <= s.y2"
_SMALL_BOXES = "SELECT page_num, ord, x1 - x1 % 60 AS x, y1 - y1 % 200 AS y, x1 - x1 % 60 + 20 + (ord * 37) % 200 AS x2, y1 - y1 % 200 + 20 + (ord * 53) % 300 AS y2 FROM dv_boxes"


@query(
    "dv_boxes",
    sql="WITH RECURSIVE " + ctes("dv_boxes")[5:].rstrip() + f""", o AS (SELECT *, row_number() OVER (PARTITION BY page_num ORDER BY y, x, ord) AS place FROM ({_SMALL_BOXES})),
  s AS (SELECT *, true AS kept FROM o WHERE place = 1 UNION ALL SELECT o.page_num, o.ord, CASE WHEN {_INSIDE} THEN s.x ELSE o.x END, CASE WHEN {_INSIDE} THEN s.y ELSE o.y END, CASE WHEN {_INSIDE} THEN s.x2 ELSE o.x2 END, CASE WHEN {_INSIDE} THEN s.y2 ELSE o.y2 END, o.place, NOT ({_INSIDE}) FROM s JOIN o ON o.page_num = s.page_num AND o.place = s.place + 1)
SELECT page_num, ord, x::BIGINT AS x, y::BIGINT AS y, x2::BIGINT AS x2, y2::BIGINT AS y2 FROM s WHERE kept""",
)
def g10_drop_contained(boxes):
    x, y = col("x1") - col("x1") % 60, col("y1") - col("y1") % 200
    small = boxes.select("page_num", "ord", x.alias("x"), y.alias("y"), (x + 20 + col("ord") * 37 % 200).alias("x2"), (y + 20 + col("ord") * 53 % 300).alias("y2"))
    return layout.drop_contained(small, ["page_num"])


@query("dv_words", sql=_RECURSIVE_WORDS + _growing(_WORD_BOXES, "y, x, ord", _BELOW, ", h", "s.h", "o.h") + f" SELECT o.page_num, s.gid::BIGINT AS group_id, 'medium' AS size, {_GROUPED}, coalesce(string_agg(o.text, chr(10) ORDER BY o.place) FILTER (WHERE o.text <> ' '), '') AS text, count(*)::BIGINT AS n FROM o JOIN s USING (page_num, place) GROUP BY o.page_num, s.gid")
def g11_merge_paragraphs(words):
    return _longs(layout.merge_paragraphs(_boxed(words).withColumn("size", F.lit("medium")), ["page_num"]), "group_id", "x", "y", "x2", "y2")


@query("dv_words")
def g18_k09_combine_lines(words):
    lines = layout.word_lines(_boxed(words), ["page_num"]).withColumn("ord", col("block_num") * 100 + col("line_num"))
    other = layout.region_rows(_boxed(words), ["page_num"]).withColumnRenamed("row_id", "ord")
    return layout.combine_lines(lines, other, ["page_num"], 1200, 400)


@query(
    "dv_boxes",
    sql=ctes("dv_boxes") + """, b AS (SELECT page_num, ord, y1 / 999.0::DOUBLE AS y, y2 / 999.0::DOUBLE AS y2, replace(text, ' ', chr(10)) AS t FROM dv_boxes),
  n AS (SELECT *, CASE WHEN y2 - y >= 0.02::DOUBLE AND len(list_filter(string_split(t, chr(10)), lambda s: trim(s) <> '')) >= 2 THEN list_filter(string_split(t, chr(10)), lambda s: trim(s) <> '') ELSE [t] END AS ls FROM b)
SELECT page_num, ord, i::BIGINT AS line, ls[i + 1] AS text, round(y + i * ((y2 - y) / len(ls)), 9) AS y, round(y + (i + 1) * ((y2 - y) / len(ls)), 9) AS y2 FROM (SELECT *, unnest(range(len(ls))) AS i FROM n)""",
)
def g15_explode_lines(boxes):
    norm = boxes.select("page_num", "ord", F.replace("text", F.lit(" "), F.lit("\n")).alias("text"), (col("y1") / 999).alias("y"), (col("y2") / 999).alias("y2"))
    return layout.explode_lines(norm).select("page_num", "ord", col("line").cast("long").alias("line"), "text", F.round("y", 9).alias("y"), F.round("y2", 9).alias("y2"))


# ---- profiles


@query(
    "dv_profile",
    sql=ctes("dv_profile")
    + """, runs AS (SELECT page_num, min(pos) AS s, max(pos) AS e FROM (SELECT *, pos - row_number() OVER (PARTITION BY page_num ORDER BY pos) AS g FROM dv_profile WHERE dark >= 3) GROUP BY page_num, g HAVING max(pos) - min(pos) + 1 >= 5),
chained AS (SELECT *, sum(CASE WHEN s - pe > 18 THEN 1 ELSE 0 END) OVER (PARTITION BY page_num ORDER BY s ROWS UNBOUNDED PRECEDING) AS band FROM (SELECT *, lag(e) OVER (PARTITION BY page_num ORDER BY s) AS pe FROM runs))
SELECT page_num, band::BIGINT AS band, min(s)::BIGINT AS first, max(e)::BIGINT AS last FROM chained GROUP BY page_num, band""",
)
def g12_bands(profile):
    b = profiles.bands(profile, ["page_num"], 3, 5, 18)
    return b.select("page_num", col("band").cast("long").alias("band"), col("start").cast("long").alias("first"), col("end").cast("long").alias("last"))


@query("dv_profile", sql=ctes("dv_profile") + "SELECT page_num, count(*)::BIGINT AS edges FROM (SELECT page_num, pos, dark >= 5 AS cur, coalesce(lag(dark >= 5) OVER (PARTITION BY page_num ORDER BY pos), false) AS was FROM dv_profile) WHERE cur AND NOT was GROUP BY page_num")
def a19_g17_edges(profile):
    return profiles.rising_edges(profile, ["page_num"], col("dark") >= 5).groupBy("page_num").agg(F.count("*").alias("edges"))


@query("dv_profile", sql=ctes("dv_profile") + "SELECT page_num, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last FROM (SELECT *, pos - row_number() OVER (PARTITION BY page_num ORDER BY pos) AS g FROM dv_profile WHERE dark >= 5) GROUP BY page_num, g HAVING max(pos) - min(pos) + 1 >= 20")
def b03_long_runs(profile):
    r = profiles.long_runs(profile, ["page_num"], col("dark") >= 5, 20)
    return r.select("page_num", col("start").cast("long").alias("first"), col("end").cast("long").alias("last"))


@query("dv_profile", sql=ctes("dv_profile") + "SELECT page_num, arg_min(pos, dark * 1000 + pos)::BIGINT AS split FROM dv_profile WHERE pos BETWEEN 175 AND 324 GROUP BY page_num")
def b04_split_row(profile):
    return profiles.brightest(profile, ["page_num"], 500).select("page_num", col("split").cast("long").alias("split"))


@query(
    "dv_profile",
    sql=ctes("dv_profile") + """, b AS (SELECT p.page_num, k AS bin, (SELECT count(*) FROM dv_profile d WHERE d.page_num = p.page_num AND d.dark = k)::DOUBLE AS n FROM (SELECT DISTINCT page_num FROM dv_profile) p, (SELECT unnest(range(256)) AS k)),
  c AS (SELECT page_num, bin, sum(n) OVER w AS w0, sum(bin * n) OVER w AS s0, sum(n) OVER (PARTITION BY page_num) AS w, sum(bin * n) OVER (PARTITION BY page_num) AS s FROM b WINDOW w AS (PARTITION BY page_num ORDER BY bin)),
  v AS (SELECT page_num, bin, w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) AS between_classes FROM c WHERE w0 > 0 AND w - w0 > 0)
SELECT page_num, min(bin)::BIGINT AS threshold FROM v JOIN (SELECT page_num, max(between_classes) AS between_classes FROM v GROUP BY page_num) USING (page_num, between_classes) GROUP BY page_num""",
)
def a17_otsu(profile):
    return _longs(profiles.otsu(profile, ["page_num"], "dark"), "threshold")


@query(
    "dv_profile",
    sql=ctes("dv_profile") + """, g AS (SELECT *, pos - row_number() OVER (PARTITION BY page_num, dark < 1 ORDER BY pos) AS r FROM dv_profile),
  l AS (SELECT *, dark < 1 AND count(*) OVER (PARTITION BY page_num, dark < 1, r) >= 5 AS wide FROM g),
  z AS (SELECT *, sum(wide::INT) OVER (PARTITION BY page_num ORDER BY pos) AS part FROM l),
  p AS (SELECT page_num, min(pos) AS s, max(pos) AS e FROM z WHERE NOT wide GROUP BY page_num, part HAVING max(pos) - min(pos) + 1 >= 5),
  n AS (SELECT *, row_number() OVER (PARTITION BY page_num ORDER BY s) - 1 AS segment, count(*) OVER (PARTITION BY page_num) AS n FROM p)
SELECT page_num, segment::BIGINT AS segment, s::BIGINT AS first, e::BIGINT AS last FROM n WHERE n > 1 UNION ALL SELECT page_num, 0, min(pos), max(pos) FROM dv_profile WHERE page_num NOT IN (SELECT page_num FROM n WHERE n > 1) GROUP BY page_num""",
)
def g13_splits(profile):
    s = profiles.splits(profile, ["page_num"], 1, 5)
    return s.select("page_num", col("segment").cast("long").alias("segment"), col("start").cast("long").alias("first"), col("end").cast("long").alias("last"))


@query("dv_words", sql=ctes("dv_words") + "SELECT page_num, y AS pos, sum(w)::BIGINT AS dark FROM dv_words GROUP BY page_num, y")
def a18_projection(words):
    return profiles.projection(words, ["page_num"], "y", "w")


_BANDS = "SELECT {k}, sum(CASE WHEN pos - p > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS band, pos FROM (SELECT {k}, pos, lag(pos) OVER (PARTITION BY {k} ORDER BY pos) AS p FROM (SELECT DISTINCT {k}, {pos} AS pos FROM {t}))"


@query(
    "dv_words",
    sql=ctes("dv_words") + f""", p AS (SELECT page_num, x // 10 AS x, y // 10 AS y FROM dv_words), r AS ({_BANDS.format(k='page_num', pos='y', t='p')}), q AS (SELECT p.page_num, r.band AS row_band, p.x, p.y FROM p JOIN r ON r.page_num = p.page_num AND r.pos = p.y),
  c AS ({_BANDS.format(k='page_num, row_band', pos='x', t='q')}), t AS (SELECT page_num, band AS row_band, min(pos) AS y_min, max(pos) AS y_max FROM r GROUP BY ALL)
SELECT page_num, row_band::BIGINT AS row_band, band::BIGINT AS band, min(pos)::BIGINT AS x_min, any_value(y_min)::BIGINT AS y_min, max(pos)::BIGINT AS x_max, any_value(y_max)::BIGINT AS y_max FROM c JOIN t USING (page_num, row_band) GROUP BY page_num, row_band, band""",
)
def b05_text_regions(words):
    pixels = words.select("page_num", (col("x") / 10).cast("int").alias("x"), (col("y") / 10).cast("int").alias("y"), F.lit(1).alias("dark"))
    return _longs(profiles.text_regions(pixels, ["page_num"], 1, 1, 2), "row_band", "band", "x_min", "y_min", "x_max", "y_max")


# ---- joins, tables, placement


@query("dv_words", "dv_boxes", sql=ctes("dv_words", "dv_boxes") + """SELECT page_num, ord FROM dv_words d WHERE conf >= 30 AND w >= 5 AND h >= 5 AND trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM dv_boxes b WHERE b.page_num = d.page_num AND least(d.x + d.w, b.x2) > greatest(d.x, b.x1) AND least(d.y + d.h, b.y2) > greatest(d.y, b.y1) AND (least(d.x + d.w, b.x2) - greatest(d.x, b.x1)) * (least(d.y + d.h, b.y2) - greatest(d.y, b.y1)) >= 0.5::DOUBLE * d.w * d.h)""")
def k02_uncovered_words(words, boxes):
    regions = boxes.select("page_num", col("x1").alias("x"), col("y1").alias("y"), "x2", "y2")
    return tables.uncovered(_boxed(words), regions, ["page_num"]).select("page_num", "ord")


_REGIONS = "SELECT page_num, 100 AS x1, 100 AS y1, 500 AS x2, 500 AS y2 FROM (SELECT DISTINCT page_num FROM dv_boxes)"


@query("dv_boxes", sql=ctes("dv_boxes") + f"SELECT b.page_num, b.ord, NOT (b.x2 < 100 OR 500 < b.x1 OR b.y2 < 100 OR 500 < b.y1) AS inside FROM dv_boxes b JOIN ({_REGIONS}) r USING (page_num)")
def k11_u04_region_split(boxes):
    regions = boxes.select("page_num").distinct().withColumns({"x1": F.lit(100), "y1": F.lit(100), "x2": F.lit(500), "y2": F.lit(500)})
    a, b = tables.split_by_regions(boxes, regions, ["page_num"])
    return a.select("page_num", "ord", F.lit(True).alias("inside")).unionByName(b.select("page_num", "ord", F.lit(False).alias("inside")))


@query("dv_boxes", sql=ctes("dv_boxes") + "SELECT page_num, block_type, string_agg(trim(text), chr(9) ORDER BY x1, ord) AS text FROM dv_boxes WHERE trim(text) <> '' GROUP BY page_num, block_type")
def x15_row_text(boxes):
    return tables.row_text(boxes, ["page_num", "block_type"])


@query("dv_boxes", sql=ctes("dv_boxes") + """, placed AS (SELECT page_num, ord, block_type, text, floor(floor((x1 + x2) / 2) / 250) AS col_id FROM dv_boxes WHERE floor((x1 + x2) / 2) < 1000) SELECT page_num, block_type AS row_id, col_id::BIGINT AS col_id, arg_min(text, ord) AS text FROM placed GROUP BY 1, 2, 3""")
def k06_table_cells(boxes):
    bounds = boxes.select("page_num").distinct().select("page_num", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).withColumn("pos", col("i") * 250)
    return tables.table_cells(boxes.withColumn("row_id", col("block_type")), bounds, ["page_num"]).withColumn("col_id", col("col_id").cast("long"))


_B01 = """, i AS (SELECT * FROM dv_boxes WHERE NOT (x2 < 100 OR 500 < x1 OR y2 < 100 OR 500 < y1)),
  g AS (SELECT *, sum(CASE WHEN abs(c - p) > {tolerance} THEN 1 ELSE 0 END) OVER (PARTITION BY page_num ORDER BY c, ord ROWS UNBOUNDED PRECEDING) AS rid FROM (SELECT *, lag(c) OVER (PARTITION BY page_num ORDER BY c, ord) AS p FROM (SELECT *, (y1 + y2) // 2 AS c FROM i)))"""
_B01_REST = "UNION ALL SELECT page_num, block_type, x1, y1, x2, y2, text, 0 FROM dv_boxes WHERE x2 < 100 OR 500 < x1 OR y2 < 100 OR 500 < y1"


@query("dv_boxes", sql=ctes("dv_boxes") + _B01.format(tolerance=15) + f" SELECT page_num, 'table_row' AS block_type, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, string_agg(trim(text), chr(9) ORDER BY x1, c, ord) AS text, 1 AS part FROM g GROUP BY page_num, rid {_B01_REST}")
def b01_rebuild_tables(boxes):
    regions = boxes.select("page_num").distinct().withColumns({"x1": F.lit(100), "y1": F.lit(100), "x2": F.lit(500), "y2": F.lit(500)})
    return tables.rebuild(boxes, regions, ["page_num"])


def _page_lines(lines):
    return lines.select(col("doc_id").alias("page_num"), "i", "line")


def _positions(boxes):
    return boxes.select("page_num", "ord", col("x1").alias("x"), col("y1").alias("y"), "x2", "y2")


_MAPPED = "lines AS (SELECT doc_id AS page_num, i, line, count(*) OVER (PARTITION BY doc_id) AS n FROM dv_lines), pos AS (SELECT *, row_number() OVER (PARTITION BY page_num ORDER BY ord) - 1 AS p, count(*) OVER (PARTITION BY page_num) AS m FROM dv_boxes)"


@query("dv_lines", "dv_boxes", sql=ctes("dv_lines", "dv_boxes") + ", " + _MAPPED + " SELECT l.page_num, l.i, p.ord, round(p.x1 * 0.5::DOUBLE, 6) AS x, round(500 - p.y2 * 0.5::DOUBLE, 6) AS y FROM lines l JOIN pos p ON l.page_num = p.page_num AND p.p = least(floor(l.i * p.m / l.n), p.m - 1)")
def k05_l11_mapped_lines(lines, boxes):
    from pyspark.sql import Window

    positions = _positions(boxes).withColumn("pos", F.row_number().over(Window.partitionBy("page_num").orderBy("ord")) - 1)
    placed = placement.map_lines(_page_lines(lines), positions, ["page_num"])
    return placed.select("page_num", "i", "ord", F.round(col("x") * 0.5, 6).alias("x"), F.round(500 - col("y2") * 0.5, 6).alias("y"))


@query("dv_lines", sql=ctes("dv_lines") + "SELECT doc_id AS page_num, i, round(1000 * 0.5::DOUBLE - (1000 * 0.08::DOUBLE + i * sp + least(0.8::DOUBLE * sp, 80)) * 0.5::DOUBLE, 6) AS y, round(least(0.8::DOUBLE * sp, 80) * 0.5::DOUBLE, 6) AS height FROM (SELECT *, 1000 * 0.84::DOUBLE / count(*) OVER (PARTITION BY doc_id) AS sp FROM dv_lines)")
def l13_fallback(lines):
    placed = placement.fallback(_page_lines(lines), ["page_num"], 700.0, 1000.0, 0.5, 0.5)
    return placed.select("page_num", "i", F.round("y", 6).alias("y"), F.round("height", 6).alias("height"))


@query("dv_lines", sql=ctes("dv_lines") + "SELECT doc_id AS page_num, i, round(842 * 0.95::DOUBLE - (i + 1) * st, 6) AS y FROM (SELECT *, least(842 * 0.9::DOUBLE / count(*) OVER (PARTITION BY doc_id), 20) AS st FROM dv_lines) WHERE 842 * 0.95::DOUBLE - (i + 1) * st >= 842 * 0.05::DOUBLE")
def l14_flow(lines):
    placed = placement.flow(_page_lines(lines), ["page_num"], 595.0, 842.0)
    return placed.select("page_num", "i", F.round("y", 6).alias("y"))


@query("dv_lines", "dv_boxes")
def l10_l12_t02_place(lines, boxes):
    return placement.place(_page_lines(lines), _positions(boxes), ["page_num"], 1000.0, 1000.0, 0.5, 0.5)


_L16 = """, b AS (SELECT page_num, ord, x1 / 999.0::DOUBLE AS x, y1 / 999.0::DOUBLE AS y, x2 / 999.0::DOUBLE AS x2, y2 / 999.0::DOUBLE AS y2, list_filter(string_split(text, ' '), lambda s: trim(s) <> '') AS ls FROM dv_boxes),
  p AS (SELECT *, (y2 - y) * 842 / len(ls) AS slot, unnest(range(len(ls))) AS i FROM b),
  q AS (SELECT page_num, ord, i, ls, ls[i + 1] AS line, x * 595 AS x, 842 * (1 - y) - (i + 1) * slot AS y, (x2 - x) * 595 AS width, slot AS height FROM p)"""


@query("dv_boxes", sql=ctes("dv_boxes") + _L16 + " SELECT page_num, ord, i::BIGINT AS i, line, round(x, 6) AS x, round(y, 6) AS y, round(width, 6) AS width, round(height, 6) AS height FROM (SELECT *, min(y) OVER (PARTITION BY page_num, ord ORDER BY i) AS low FROM q) WHERE low >= 0")
def l16_block_lines(boxes):
    norm = boxes.select("page_num", "ord", F.replace("text", F.lit(" "), F.lit("\n")).alias("text"), *[(col(a) / 999).alias(b) for a, b in (("x1", "x"), ("y1", "y"), ("x2", "x2"), ("y2", "y2"))])
    placed = placement.block_lines(norm, ["page_num", "ord"], 595.0, 842.0)
    return placed.select("page_num", "ord", col("i").cast("long").alias("i"), "line", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


_GLYPH = "CASE WHEN c = 'a' THEN 900.0::DOUBLE WHEN c BETWEEN 'b' AND 'y' THEN 400.0::DOUBLE + (ascii(c) - 98) * 20 ELSE 300.0::DOUBLE END"


@query(
    "dv_boxes",
    sql=ctes("dv_boxes") + _L16 + f""", e AS (SELECT page_num, ord, max(w) AS em FROM (SELECT page_num, ord, i, sum({_GLYPH}) AS w FROM (SELECT page_num, ord, i, unnest(string_split(line, '')) AS c FROM q) GROUP BY ALL) GROUP BY ALL),
  s AS (SELECT q.*, greatest(least(height, 48.0::DOUBLE), 3.0::DOUBLE) AS f, em FROM q JOIN e USING (page_num, ord)),
  z AS (SELECT *, CASE WHEN width > 0 AND em * f / 1000 > width THEN greatest(f * width / (em * f / 1000), 3.0::DOUBLE) ELSE f END AS font FROM s),
  k AS (SELECT *, y + height / 2 - font * (0.766::DOUBLE - 0.5::DOUBLE) AS baseline FROM z)
SELECT page_num, ord, i::BIGINT AS i, line, round(font, 5) AS font, round(baseline, 5) AS baseline FROM (SELECT *, min(baseline) OVER (PARTITION BY page_num, ord ORDER BY i) AS low FROM k) WHERE low >= 0""",
)
def m13_l16_fitted_lines(boxes):
    widths = boxes.sparkSession.range(98, 122).select(col("id").alias("code"), (400.0 + (col("id") - 98) * 20).alias("width"))
    widths = widths.unionByName(boxes.sparkSession.createDataFrame([(97, 900.0), (-1, 300.0)], "code long, width double"))
    norm = boxes.select("page_num", "ord", F.replace("text", F.lit(" "), F.lit("\n")).alias("text"), *[(col(a) / 999).alias(b) for a, b in (("x1", "x"), ("y1", "y"), ("x2", "x2"), ("y2", "y2"))])
    placed = placement.block_lines(norm, ["page_num", "ord"], 595.0, 842.0, widths)
    return placed.select("page_num", "ord", col("i").cast("long").alias("i"), "line", F.round("font", 5).alias("font"), F.round("baseline", 5).alias("baseline"))


_GRID = "(SELECT page_num, CASE WHEN page_num % 4 = 0 THEN 15 ELSE greatest(floor((40 + page_num % 30) / 1000.0::DOUBLE * 999 / 2), 1)::BIGINT END AS tolerance, CASE WHEN page_num % 3 = 0 THEN []::BIGINT[] ELSE [99, floor((180 + page_num % 50) / 1000.0::DOUBLE * 999)::BIGINT, 299, 499] END AS b FROM (SELECT DISTINCT page_num FROM dv_boxes))"


@query(
    "dv_boxes",
    sql=ctes("dv_boxes") + _B01.replace("FROM i)", "FROM i) q JOIN " + _GRID + " USING (page_num)").format(tolerance="tolerance") + f""",
  c AS (SELECT page_num, rid, k, arg_min(trim(text), (c, ord)) FILTER (WHERE trim(text) <> '' AND (x1 + x2) // 2 >= b[k] AND (x1 + x2) // 2 < b[k + 1]) AS cell FROM g, (SELECT unnest([1, 2, 3]) AS k) WHERE len(b) > 0 GROUP BY page_num, rid, k),
  t AS (SELECT page_num, rid, string_agg(coalesce(cell, ''), chr(9) ORDER BY k) AS text FROM c GROUP BY ALL)
SELECT g.page_num, 'table_row' AS block_type, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, CASE WHEN any_value(len(b)) > 0 THEN any_value(t.text) ELSE string_agg(trim(g.text), chr(9) ORDER BY x1, c, ord) END AS text, 1 AS part FROM g LEFT JOIN t USING (page_num, rid) GROUP BY g.page_num, g.rid {_B01_REST}""",
)
def b01_a13_k06_grid_tables(boxes):
    ys = F.when(col("page_num") % 4 == 0, F.array(F.lit(100))).otherwise(F.array(F.lit(100), 140 + col("page_num") % 30, 220 + col("page_num") % 30 * 2, 240 + col("page_num") % 30 * 3))
    xs = F.when(col("page_num") % 3 == 0, F.array(F.lit(100))).otherwise(F.array(F.lit(100), 180 + col("page_num") % 50, F.lit(300), F.lit(500)))
    found = boxes.select("page_num").distinct().select("page_num", F.lit(0).alias("region"), F.lit(101).alias("x"), F.lit(101).alias("y"), F.lit(400).alias("width"), F.lit(400).alias("height"), ys.alias("h_positions"), xs.alias("v_positions"))
    return tables.rebuild(boxes, tables.on_grid(found, ["page_num"], 1000, 1000), ["page_num"], grid=tables.first_grid(found, ["page_num"], 1000, 1000))


@query("documents", "labels", sql="SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS quality, coalesce(l.toxic, -1)::BIGINT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def k01_page_join(docs, labels):
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"), F.coalesce("toxic", F.lit(-1)).cast("long").alias("toxic"))


@query("documents", sql="SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'blocks' WHEN text <> '' AND doc_id % 2 = 0 THEN 'cached' WHEN text <> '' THEN 'positioned' ELSE 'image' END AS route FROM documents")
def f19_route(docs):
    return docs.select("doc_id", G.route(col("doc_id") % 7 == 0, col("text"), col("doc_id") % 2 == 0).alias("route"))


_CODES = ", ".join(f"({_q(k)}, {_q(v)})" for k, v in V.ERRORS.items())


@query("events", sql=f"WITH codes(code, message) AS (VALUES {_CODES}) SELECT k.code, c.message, k.n, k.code IN ('E010', 'E020', 'E021', 'E040') AS recoverable FROM (SELECT printf('E%03d', event_id % 64) AS code, count(*)::BIGINT AS n FROM events GROUP BY 1) k LEFT JOIN codes c USING (code)")
def f18_k10_error_lookup(events):
    code = F.format_string("E%03d", col("event_id") % 64)
    return catalogue.with_messages(events.groupBy(code.alias("code")).agg(F.count("*").alias("n")))


@query("dv_words", sql=ctes("dv_words") + """, p AS (SELECT *, CASE ord % 3 WHEN 0 THEN 6 WHEN 1 THEN 11 ELSE 3 END AS psm, CASE ord % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank FROM dv_words WHERE conf >= 10 AND trim(text) <> '' AND w >= 5 AND h >= 5), c AS (SELECT page_num, psm, rank, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT page_num, coalesce(arg_min(psm, rank) FILTER (WHERE n >= 5), 3) AS psm FROM c GROUP BY page_num) SELECT p.page_num, p.ord, p.psm::BIGINT AS psm FROM p JOIN b USING (page_num, psm)""")
def s05_word_scan(words):
    scanned = words.withColumn("psm", F.element_at(F.array(F.lit(6), F.lit(11), F.lit(3)), (col("ord") % 3 + 1).cast("int")))
    return pages.word_scan(scanned, ["page_num"]).select("page_num", "ord", col("psm").cast("long").alias("psm"))


@query("dv_words", sql=ctes("dv_words") + "SELECT page_num, ord, row_number() OVER (PARTITION BY page_num ORDER BY y, x, ord)::BIGINT AS reading FROM dv_words")
def t01_reading_order(words):
    return _longs(layout.reading_order(words, ["page_num"]), "reading").select("page_num", "ord", "reading")


# ---- partitioning, jobs


@query("orders", sql="WITH p AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page, count(*) OVER (PARTITION BY o_custkey) AS pages FROM orders), n AS (SELECT *, least(CASE WHEN pages < 12 THEN greatest(pages // 3, 1) ELSE 4 END, pages) AS workers FROM p) SELECT doc_id, page, least(page // (pages // workers), workers - 1)::BIGINT AS worker, (page // 3)::BIGINT AS chunk FROM n")
def p01_p05_workers(orders):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    pages = orders.select(col("o_custkey").alias("doc_id"), (F.row_number().over(w.orderBy("o_orderkey")) - 1).cast("long").alias("page"), F.count("*").over(w).alias("pages"))
    return pages.select("doc_id", "page", partitioning.worker_of(col("page"), col("pages"), 4, 3).alias("worker"), partitioning.chunk_of(col("page"), 3).alias("chunk"))


_P03 = "SELECT p_partkey, n, k, i, i * (n // k) + least(i, n % k) AS s, (i + 1) * (n // k) + least(i + 1, n % k) - 1 AS e FROM z"
_P02 = "SELECT p_partkey, n, k, i, i * b + least(i, (n - b * k) // 10) * 10 AS s, CASE WHEN i = k - 1 THEN n ELSE (i + 1) * b + least(i + 1, (n - b * k) // 10) * 10 END - 1 AS e FROM z"


@query("part", sql=f"WITH z AS (SELECT *, n // k // 10 * 10 AS b FROM (SELECT p_partkey, p_partkey % 97 + 5 AS n, p_partkey % 5 + 1 AS k, unnest(range(p_partkey % 5 + 1)) AS i FROM part)) SELECT p_partkey, i::BIGINT AS part, s::BIGINT AS first, e::BIGINT AS last FROM (SELECT a.*, z.b FROM ({_P02}) a JOIN z USING (p_partkey, i) WHERE b > 0 UNION ALL SELECT a.*, z.b FROM ({_P03}) a JOIN z USING (p_partkey, i) WHERE b = 0 AND e >= s)")
def p02_p03_volumes(part):
    n, k = col("p_partkey") % 97 + 5, col("p_partkey") % 5 + 1
    rows = part.select("p_partkey", F.explode(partitioning.aligned_ranges(n, k, 10)).alias("r"))
    return rows.select("p_partkey", col("r.part").alias("part"), col("r.start").alias("first"), col("r.end").alias("last"))


@query("part", sql="SELECT p_partkey, CASE WHEN p_size - 10 <= 0 OR p_size - 10 > 30 THEN 'E060' END AS error FROM part")
def p04_split_error(part):
    return part.select("p_partkey", partitioning.split_error(F.lit(30), col("p_size") - 10).alias("error"))


@query("dv_job_events", sql=ctes("dv_job_events") + "SELECT job_id, count_if(type = 'init')::BIGINT AS n_init, count_if(type = 'progress')::BIGINT AS n_progress, count_if(type = 'page_error')::BIGINT AS n_page_error, count_if(type = 'complete')::BIGINT AS n_complete, count_if(type = 'log')::BIGINT AS n_log, arg_max(type, (ts, seq)) AS last_type FROM dv_job_events GROUP BY job_id")
def a11_r02_job_counters(events):
    return jobs.job_counters(events)


@query("dv_job_events", sql=ctes("dv_job_events") + "SELECT job_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS r FROM dv_job_events WHERE type = 'log') WHERE r <= 50")
def t04_last_logs(events):
    return jobs.last_logs(events).select("job_id", "seq")


@query("dv_job_events", sql=ctes("dv_job_events") + "SELECT job_id, string_agg(page::VARCHAR, ', ' ORDER BY seq) FILTER (WHERE r <= 5) AS pages, greatest(count(*) - 5, 0)::BIGINT AS more FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS r FROM dv_job_events WHERE type = 'page_error') GROUP BY job_id")
def t05_failed_pages(events):
    return jobs.failed_pages(events).withColumn("more", col("more").cast("long"))


@query("dv_job_events", sql=ctes("dv_job_events") + "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM dv_job_events GROUP BY ALL")
def event_time_windows(events):
    return jobs.event_windows(events).withColumn("total", F.round("total", 4))


# ---- the flagship: clean, classify, summarise


@query(
    "documents",
    sql=rf"""WITH lines AS (SELECT doc_id, lang, text, list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, {LEAK_LINE}) AND NOT regexp_matches(l, '^\s*[-=*]{{3,}}\s*$')) AS kept FROM documents),
cleaned AS (SELECT lang, length(text) > 5000 AS anomalous, regexp_replace(array_to_string(list_transform(kept, lambda l: {STRIP.format('l')}), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM lines)
SELECT lang, {_class('text')} AS content, count(*)::BIGINT AS documents, sum(length(text))::BIGINT AS characters, count_if(anomalous)::BIGINT AS anomalous FROM (SELECT *, {_scores('text')} FROM cleaned) GROUP BY 1, 2""",
)
def clean_and_classify(docs):
    kept = F.filter(F.split("text", "\n", -1), lambda x: ~T.is_leakage_line(x) & ~T.is_separator_line(x))
    cleaned = docs.select("lang", T.is_anomalous(col("text")).alias("anomalous"), T.collapse_blank_lines(F.array_join(F.transform(kept, T.strip), "\n")).alias("text"))
    scored = cleaned.select("lang", "text", "anomalous", T.content_scores(col("text")).alias("s"))
    classed = scored.select("lang", T.class_of_scores(col("text"), col("s")).alias("content"), F.char_length("text").alias("n"), "anomalous")
    return classed.groupBy("lang", "content").agg(F.count("*").alias("documents"), F.sum("n").alias("characters"), F.count_if("anomalous").alias("anomalous"))
