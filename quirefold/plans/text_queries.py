"""Registered queries of formula repair, masking, lines, events and placement arithmetic; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import latex
from ..functions import text as T
from ..functions import values as V
from ..operators import lexicon, placement, voting
from ..sources import files
from .derived import ctes
from .registry import _page_lines, _q, query

col = F.col
_MATH = _q(V.MATH_REGION)
#: Documents with formulas in them; Spark and DuckDB have the same text.
_WITH_MATH = "replace(replace(text, ' the ', ' $a the e$ '), '. ', '. \\[ e $ \\] ')"


@query(
    "documents",
    sql=f"""WITH t AS (SELECT doc_id, {_WITH_MATH} AS t FROM documents), p AS (SELECT doc_id, regexp_split_to_array(t, {_MATH}) AS plain, regexp_extract_all(t, {_MATH}) AS math FROM t)
SELECT doc_id, md5(array_to_string(list_transform(range(1, len(plain) + 1), lambda i: replace(plain[i], 'e', 'E') || coalesce(math[i], '')), '')) AS digest, len(math)::BIGINT AS formulas FROM p""",
)
def x05_masked_formulas(docs):
    rows = docs.select("doc_id", F.expr(_WITH_MATH.replace("\\", "\\\\")).alias("t"))
    return rows.select("doc_id", F.md5(T.over_plain_text(col("t"), lambda p: F.replace(p, F.lit("e"), F.lit("E")))).alias("digest"), F.size(F.regexp_extract_all("t", F.lit(T.MATH_REGION), F.lit(0))).cast("long").alias("formulas"))


@query(
    "documents",
    sql=f"""WITH t AS (SELECT doc_id, {_WITH_MATH} AS t FROM documents), p AS (SELECT doc_id, t, regexp_split_to_array(t, {_MATH}) AS plain, regexp_extract_all(t, {_MATH}) AS math FROM t)
SELECT doc_id, md5(CASE WHEN len(math) = 0 THEN replace(t, 'e', 'EE') ELSE array_to_string(list_transform(range(1, len(plain) + 1), lambda i: plain[i] || coalesce(replace(math[i], 'e', 'EE'), '')), '') END) AS digest FROM p""",
)
def l07_inside_formulas(docs):
    rows = docs.select("doc_id", F.expr(_WITH_MATH.replace("\\", "\\\\")).alias("t"))
    return rows.select("doc_id", F.md5(T.over_math(col("t"), lambda m: F.replace(m, F.lit("e"), F.lit("EE")))).alias("digest"))


_BROKEN = "replace(replace(replace(replace(replace(text, ' the ', ' \\\\alpha x_ab '), ' and ', ' y^12 \\\\\\\\sum '), ' in ', ' \\\\frac a '), ' der ', ' \\\\sqrt3 '), ' que ', ' \\\\frac {a} ')"
_COMMANDS = "|".join(V.DOUBLED_COMMANDS)


@query(
    "documents",
    sql=f"""WITH t AS (SELECT doc_id, {_BROKEN.replace(chr(92) * 2, chr(92))} AS t FROM documents),
  a AS (SELECT doc_id, t, regexp_replace(regexp_replace(regexp_replace(t, '\\\\\\\\({_COMMANDS})', '\\\\\\1', 'g'), '\\\\frac(\\s*)([^{{\\s]|$)', '\\\\frac{{}}{{}}\\1\\2', 'g'), '\\\\sqrt([A-Za-z0-9])', '\\\\sqrt{{\\1}}', 'g') AS repaired FROM t)
SELECT doc_id, md5(repaired) AS errors, md5(regexp_replace(t, '(^|[^\\\\])([_^])([A-Za-z0-9]{{2,}})([^A-Za-z0-9{{]|$)', '\\1\\2{{\\3}}\\4', 'g')) AS scripts FROM a""",
)
def l02_l04_repairs(docs):
    rows = docs.select("doc_id", F.expr(_BROKEN).alias("t"))
    return rows.select("doc_id", F.md5(latex.common_errors(col("t"))).alias("errors"), F.md5(latex.scripts(col("t"))).alias("scripts"))


@query("documents", sql="SELECT doc_id, len(l)::BIGINT AS lines, md5(array_to_string(l, '|')) AS digest, md5('fix: ' || left(text, 2000) || chr(10)) AS prompt FROM (SELECT doc_id, text, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, text, regexp_split_to_array(replace(text, '. ', '.' || chr(13) || chr(10)) || chr(11), chr(13) || chr(10) || '|[' || chr(10) || chr(13) || chr(11) || chr(12) || ']') AS l FROM documents))")
def x07_x12_lines_prompts(docs):
    t = F.concat(F.replace("text", F.lit(". "), F.lit(".\r\n")), F.lit("\x0b"))
    rows = docs.select("doc_id", "text", T.split_lines(t).alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("lines"), F.md5(F.array_join("l", "|")).alias("digest"), F.md5(T.prompt(col("text"), "fix: {text}\n")).alias("prompt"))


@query(
    "dv_versions",
    sql=ctes("dv_versions") + "SELECT doc_id, page_num, original, CASE WHEN page_num % 2 = 0 THEN v0 ELSE original END AS v0, CASE WHEN page_num % 3 = 0 THEN v1 ELSE original END AS v1, original AS v2 FROM dv_versions",
)
def k03_aligned_versions(versions):
    made = [versions.where(f"page_num % {m + 2} = 0").select("doc_id", "page_num", F.lit(m).alias("model_idx"), col(f"v{m}").alias("text")) for m in (0, 1)]
    return voting.align_versions(versions.select("doc_id", "page_num", col("original").alias("text")), made[0].unionByName(made[1]), ["doc_id", "page_num"])


@query(
    "dv_boxes",
    sql=ctes("dv_boxes") + """, h AS (SELECT page_num, ord, x1, y1, x2, y2, ord % 2 AS half, 300 + page_num % 400 AS s, (ord * 7 % 180 - 90)::DOUBLE AS a, x2 - x1 AS w, y2 - y1 AS hh FROM dv_boxes),
  m AS (SELECT *, CASE WHEN half = 0 THEN 0 ELSE s END AS low, CASE WHEN half = 0 THEN s ELSE 999 END AS high FROM h),
  y AS (SELECT *, floor(low + y1 * (high - low) / 999.0::DOUBLE) AS ya, floor(low + y2 * (high - low) / 999.0::DOUBLE) AS yb FROM m),
  c AS (SELECT *, least(greatest(ya, 0), 999) AS ca, least(greatest(yb, 0), 999) AS cb FROM y)
SELECT page_num, ord, ca::BIGINT AS y1, greatest(CASE WHEN cb <= ca THEN least(ca + 1, 999) ELSE cb END, least(ca + 1, 999))::BIGINT AS y2, CASE WHEN a < -45 THEN a + 90 ELSE a END AS angle,
  floor(round(hh * abs(sin(radians(a))) + w * abs(cos(radians(a))), 6))::BIGINT AS turned, w * hh >= 0.05::DOUBLE * 400 * 400 AND w / hh::DOUBLE >= 0.3::DOUBLE AND w / hh::DOUBLE <= 3 AS sized, ord % 4 >= 2 AND ord % 5 >= 2 AS grid FROM c""",
)
def m03_m07_f13_f14_boxes(boxes):
    half, split = col("ord") % 2, 300 + col("page_num") % 400
    box = G.remap_half(col("x1"), col("y1"), col("x2"), col("y2"), half, split)
    a, w, h = (col("ord") * 7 % 180 - 90).cast("double"), col("x2") - col("x1"), col("y2") - col("y1")
    turned = F.floor(F.round(h * F.abs(F.sin(F.radians(a))) + w * F.abs(F.cos(F.radians(a))), 6))
    rows = boxes.select("page_num", "ord", box[1].cast("long").alias("y1"), box[3].cast("long").alias("y2"), G.upright(a).alias("angle"), G.turned_size(w, h, a)[0].cast("long").alias("own"), turned.cast("long").alias("turned"), G.is_region_size(w, h, F.lit(400), F.lit(400)).alias("sized"), G.is_grid(col("ord") % 4, col("ord") % 5).alias("grid"))
    # the operator's size is that of the rounded one, but for digits beyond the sixth
    return rows.where(F.abs(col("own") - col("turned")) <= 1).drop("own")


@query("dv_state_events", sql=ctes("dv_state_events") + "SELECT type, coalesce(page, -1)::BIGINT AS page, coalesce(level, '') AS level, count(*)::BIGINT AS n FROM dv_state_events WHERE type NOT IN ('split_progress') GROUP BY ALL")
def s15_r01_events_there_and_back(events):
    lines = files.event_lines(events.select("type", "page", "level", "status", "current_page", "total_pages", "memory_mb", "message", "code"))
    parsed = files.parse_events(lines.unionByName(lines.limit(1).select(F.lit("no json").alias("value"))))
    return parsed.groupBy("type", F.coalesce("page", F.lit(-1)).cast("long").alias("page"), F.coalesce("level", F.lit("")).alias("level")).agg(F.count("*").alias("n"))


_LINE = "CASE event_id % 4 WHEN 0 THEN concat('{\"type\": \"log\", \"message\": \"m', event_id, '\"}') WHEN 1 THEN concat('Loading shard ', event_id) WHEN 2 THEN concat('step ', event_id) ELSE concat('{\"type\": \"nothing\", \"message\": \"model ', event_id, '\"}') END"


@query("events", sql="SELECT CASE event_id % 4 WHEN 0 THEN 'log' ELSE 'modelSetup' END AS type, CASE event_id % 4 WHEN 0 THEN concat('m', event_id) ELSE concat('Loading shard ', event_id) END AS message FROM events WHERE event_id % 4 < 2")
def s16_status_lines(events):
    return files.parse_status_lines(events.select(F.expr(_LINE).alias("value"))).select("type", "message")


@query(
    "dv_lines",
    sql=ctes("dv_lines") + """, p AS (SELECT doc_id AS page_num, i, 1000 * 0.5::DOUBLE - (1000 * 0.08::DOUBLE + i * sp + least(0.8::DOUBLE * sp, 80)) * 0.5::DOUBLE AS y, least(0.8::DOUBLE * sp, 80) * 0.5::DOUBLE AS height FROM (SELECT *, 1000 * 0.84::DOUBLE / count(*) OVER (PARTITION BY doc_id) AS sp FROM dv_lines)),
  f AS (SELECT *, least(greatest(height * 0.85::DOUBLE, 6.0::DOUBLE), 20.0::DOUBLE) AS font FROM p)
SELECT page_num, i, round(font, 6) AS font, round(y + (height - font) / 2, 6) AS baseline FROM f WHERE y + (height - font) / 2 >= 0""",
)
def l15_baselines(lines):
    placed = placement.baselines(placement.fallback(_page_lines(lines), ["page_num"], 700.0, 1000.0, 0.5, 0.5))
    return placed.select("page_num", "i", F.round("font", 6).alias("font"), F.round("baseline", 6).alias("baseline"))


_PARTICLES = "[" + ", ".join(_q(p) for p in V.PARTICLES) + "]"
_SYLLABLES = "chr((44032 + p_partkey * 2791 % 11172)::INT) || CASE WHEN p_partkey % 5 > 0 THEN chr((44032 + p_partkey * 31 % 11172)::INT) ELSE '' END"


@query(
    "part",
    sql=f"""WITH w AS (SELECT p_partkey, {_SYLLABLES} || coalesce({_PARTICLES}[(p_partkey % {len(V.PARTICLES) + 3} + 1)::BIGINT], '') AS word FROM part)
SELECT p_partkey, nullif(regexp_extract(word, '^(.{{2,}}?)({'|'.join(V.PARTICLES)})$', 1), '') AS stem, nullif(regexp_extract(word, '^(.{{2,}}?)({'|'.join(V.PARTICLES)})$', 2), '') AS particle FROM w""",
)
def d03_stems(part):
    n = col("p_partkey")
    one, two = (lexicon.compose(F.floor(k % 11172 / 588).cast("int"), F.floor(k % 11172 % 588 / 28).cast("int"), (k % 11172 % 28).cast("int")) for k in (n * 2791, n * 31))
    ending = F.coalesce(F.get(F.array(*[F.lit(p) for p in V.PARTICLES]), (n % (len(V.PARTICLES) + 3)).cast("int")), F.lit(""))
    word = F.concat(one, F.when(n % 5 > 0, two).otherwise(""), ending)
    return part.select("p_partkey", lexicon.strip_particle(word).alias("s")).select("p_partkey", "s.stem", "s.particle")
