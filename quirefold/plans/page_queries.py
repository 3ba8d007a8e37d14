"""Registered queries of the page operators; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages
from ..streaming import jobs
from .derived import ctes
from .registry import query

col = F.col
KEYS = ["page_num"]
_PSM = "CASE ord % 3 WHEN 0 THEN 6 WHEN 1 THEN 11 ELSE 3 END"
_BOXES = "(SELECT page_num, ord, x1 AS x, y1 AS y, x2, y2, x2 - x1 AS w, y2 - y1 AS h, text FROM dv_boxes)"


def _scanned(words):
    return words.withColumn("psm", F.element_at(F.array(F.lit(6), F.lit(11), F.lit(3)), (col("ord") % 3 + 1).cast("int")))


def _pages(boxes):
    return boxes.select("page_num").distinct()


@query(
    "dv_words",
    sql=ctes("dv_words") + f""", p AS (SELECT *, {_PSM} AS psm, ord % 3 AS rank FROM dv_words WHERE conf >= 10 AND trim(text) <> '' AND w >= 3 AND h >= 3),
  c AS (SELECT page_num, psm, rank, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT page_num, coalesce(arg_min(psm, rank) FILTER (WHERE n >= 5), 3) AS psm FROM c GROUP BY page_num)
SELECT p.page_num, p.ord, p.psm::BIGINT AS psm, p.x + p.w AS x2, p.y + p.h AS y2 FROM p JOIN b USING (page_num, psm)""",
)
def s06_block_words(words):
    return pages.word_scan(_scanned(words), KEYS, smallest=3).select("page_num", "ord", col("psm").cast("long").alias("psm"), (col("x") + col("w")).alias("x2"), (col("y") + col("h")).alias("y2"))


@query(
    "dv_words",
    sql=ctes("dv_words") + """, p AS (SELECT *, CASE WHEN page_num % 3 = 0 AND line_num > 2 THEN 11 WHEN page_num % 3 = 1 THEN 11 ELSE 6 END AS psm FROM dv_words WHERE conf >= 10),
  l AS (SELECT page_num, psm, block_num, par_num, line_num, min(x) AS x, min(y) AS y, max(x + w) AS x2, max(y + h) AS y2, string_agg(text, ' ' ORDER BY ord) FILTER (WHERE trim(text) <> '') AS text FROM p GROUP BY ALL HAVING text IS NOT NULL),
  b AS (SELECT page_num, coalesce(min(psm) FILTER (WHERE n >= 3), 11) AS psm FROM (SELECT page_num, psm, count(*) AS n FROM l GROUP BY ALL) GROUP BY page_num)
SELECT l.page_num, l.psm::BIGINT AS psm, x, y, x2, y2, text FROM l JOIN b USING (page_num, psm)""",
)
def s07_line_scan(words):
    mode = F.when((col("page_num") % 3 == 0) & (col("line_num") > 2), 11).when(col("page_num") % 3 == 1, 11).otherwise(6)
    boxed = words.withColumns({"psm": mode, "x2": col("x") + col("w"), "y2": col("y") + col("h")})
    return pages.line_scan(boxed, KEYS).select("page_num", col("psm").cast("long").alias("psm"), "x", "y", "x2", "y2", "text")


@query(
    "dv_boxes",
    sql=ctes("dv_boxes") + f""", k AS (SELECT page_num, x, y, x2, y2, greatest(floor(h * 0.1::DOUBLE), 2)::BIGINT AS pad FROM {_BOXES} WHERE w >= 0.005::DOUBLE * 8000 AND h >= 0.003::DOUBLE * 5000),
  p AS (SELECT page_num, greatest(x - pad, 0) AS x, greatest(y - pad, 0) AS y, least(x2 + pad, 8000) AS x2, least(y2 + pad, 5000) AS y2 FROM k)
SELECT page_num, x::BIGINT AS x, y::BIGINT AS y, x2::BIGINT AS x2, y2::BIGINT AS y2, round(x / 8000.0::DOUBLE, 9) AS nx, round(y2 / 5000.0::DOUBLE, 9) AS ny2, row_number() OVER (PARTITION BY page_num ORDER BY y, x, x2, y2)::BIGINT AS reading FROM p""",
)
def s08_detected_regions(boxes):
    named = boxes.select("page_num", col("x1").alias("x"), col("y1").alias("y"), "x2", "y2")
    rows = pages.detected_regions(named, KEYS, 8000, 5000)
    return rows.select("page_num", "x", "y", "x2", "y2", F.round("nx", 9).alias("nx"), F.round("ny2", 9).alias("ny2"), col("reading").cast("long").alias("reading"))


@query(
    "dv_boxes",
    sql=ctes("dv_boxes") + """, p AS (SELECT page_num, ord, x1 AS x, y1 AS y, 30 + ord * 3 AS w, 8 + ord % 5 AS h, radians(ord * 4 % 81 - 40) AS a FROM dv_boxes),
  c AS (SELECT *, unnest([x, x + w * cos(a), x + w * cos(a) - h * sin(a), x - h * sin(a)]) AS px, unnest([y, y + w * sin(a), y + w * sin(a) + h * cos(a), y + h * cos(a)]) AS py FROM p)
SELECT page_num, ord, trunc(round(min(px), 6))::BIGINT AS x, trunc(round(min(py), 6))::BIGINT AS y, trunc(round(max(px), 6))::BIGINT AS x2, trunc(round(max(py), 6))::BIGINT AS y2, round(ord * 4 % 81 - 40, 4)::DOUBLE AS angle FROM c GROUP BY page_num, ord""",
)
def s08_polygon_boxes(boxes):
    a, w, h = F.radians(col("ord") * 4 % 81 - 40), 30 + col("ord") * 3, 8 + col("ord") % 5
    corner = lambda x, y: F.struct(F.round(col("x1") + x, 6).alias("x"), F.round(col("y1") + y, 6).alias("y"))
    points = F.array(corner(F.lit(0.0), F.lit(0.0)), corner(w * F.cos(a), w * F.sin(a)), corner(w * F.cos(a) - h * F.sin(a), w * F.sin(a) + h * F.cos(a)), corner(-h * F.sin(a), h * F.cos(a)))
    found = pages.polygon_boxes(boxes.select("page_num", "ord", points.alias("points")), ["page_num", "ord"])
    return found.withColumn("angle", F.round("angle", 4))


_S21 = "string_agg(concat_ws(' ', x1, y1, x2, y2, text), '|' ORDER BY y1, x1, x2, y2, text)"


@query("dv_boxes", sql=ctes("dv_boxes") + f"SELECT page_num, {_S21} FILTER (WHERE block_type = 'text' AND page_num % 3 <> 0) AS positions FROM dv_boxes GROUP BY page_num")
def s21_cached_positions(boxes):
    lines = boxes.where("block_type = 'text' AND page_num % 3 != 0").select("page_num", col("x1").alias("x"), col("y1").alias("y"), "x2", "y2", "text")
    shown = F.transform("line_positions", lambda p: F.concat_ws(" ", p["x"], p["y"], p["x2"], p["y2"], p["text"]))
    return pages.cached_positions(_pages(boxes), lines, KEYS).select("page_num", F.array_join(shown, "|").alias("positions"))


@query("dv_boxes", sql=ctes("dv_boxes") + "SELECT page_num, coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (WHERE text <> '' AND ord % 5 <> 0), '') AS text FROM dv_boxes GROUP BY page_num")
def a16_full_text(boxes):
    return pages.full_text(boxes.withColumn("text", F.when(col("ord") % 5 != 0, col("text")).otherwise("")), KEYS)


@query(
    "dv_boxes",
    sql=ctes("dv_boxes") + """, k AS (SELECT page_num, ord, x1, y1, y2 - y1 AS h, text, y1 + (y2 - y1) / 2.0::DOUBLE AS c FROM dv_boxes WHERE ord % 4 = 0 AND page_num % 2 = 0),
  r AS (SELECT *, sum(CASE WHEN abs(c - p) > 0.5::DOUBLE * h THEN 1 ELSE 0 END) OVER (PARTITION BY page_num ORDER BY y1, x1, ord ROWS UNBOUNDED PRECEDING) AS rid FROM (SELECT *, lag(c) OVER (PARTITION BY page_num ORDER BY y1, x1, ord) AS p FROM k)),
  t AS (SELECT page_num, string_agg(line, chr(10) ORDER BY rid) AS text FROM (SELECT page_num, rid, coalesce(string_agg(text, chr(9) ORDER BY x1, ord) FILTER (WHERE trim(text) <> ''), '') AS line FROM r GROUP BY ALL) GROUP BY page_num)
SELECT page_num, count(*)::BIGINT AS n_detected, count_if(ord % 2 = 0)::BIGINT AS n_sentences, count_if(ord % 4 = 0 AND page_num % 2 = 0)::BIGINT AS n_recognised, any_value(coalesce(t.text, '')) AS text FROM dv_boxes LEFT JOIN t USING (page_num) GROUP BY page_num""",
)
def a14_page_rollup(boxes):
    sized = boxes.select("page_num", "ord", col("x1").alias("x"), col("y1").alias("y"), "x2", "y2", (col("x2") - col("x1")).alias("w"), (col("y2") - col("y1")).alias("h"), "text")
    rows = pages.page_rollup(sized, sized.where("ord % 2 = 0"), sized.where("ord % 4 = 0 AND page_num % 2 = 0"), KEYS)
    return rows.select("page_num", "n_detected", "n_sentences", "n_recognised", "text")


@query(
    "dv_boxes",
    sql=ctes("dv_boxes") + """, b AS (SELECT page_num, string_agg(text, chr(10) ORDER BY ord) AS t FROM dv_boxes WHERE page_num % 4 <> 0 AND block_type IN ('table_header', 'table_cell', 'table_row') GROUP BY page_num)
SELECT p.page_num, p.page_num % 2 = 1 AND t IS NOT NULL AS by_blocks, CASE WHEN p.page_num % 2 = 1 AND t IS NOT NULL THEN t ELSE 'page' END AS text FROM (SELECT DISTINCT page_num FROM dv_boxes) p LEFT JOIN b USING (page_num)""",
)
def f15_f20_table_pages(boxes):
    whole = _pages(boxes).withColumns({"has_table": col("page_num") % 2 == 1, "text": F.lit("page")})
    blocks = boxes.where(pages.is_table_block(col("block_type"))).where("page_num % 4 != 0")
    return pages.route_table_pages(whole, blocks, KEYS).select("page_num", "by_blocks", "text")


@query(
    "dv_boxes",
    sql=ctes("dv_boxes") + """, p AS (SELECT page_num, page_num // 10 AS doc, coalesce(max(CASE WHEN page_num % 3 <> 0 THEN text END), '') AS text, page_num % 2 = 0 AS b, page_num % 5 <> 0 AS l FROM dv_boxes GROUP BY page_num)
SELECT doc::BIGINT AS doc, count(*)::BIGINT AS n_pages, count_if(b)::BIGINT AS n_blocks, count_if(l)::BIGINT AS n_cached, sum(length(text))::BIGINT AS chars FROM p GROUP BY doc""",
)
def k01_a10_collection(boxes):
    texts = boxes.where("page_num % 3 != 0").groupBy("page_num").agg(F.max("text").alias("text"))
    blocks = boxes.where("page_num % 2 = 0").groupBy("page_num").agg(F.collect_list("text").alias("block_results"))
    lines = pages.cached_positions(_pages(boxes), boxes.where("page_num % 5 != 0").select("page_num", col("x1").alias("x"), col("y1").alias("y"), "x2", "y2", "text"), KEYS)
    rows = pages.join_pages(_pages(boxes), texts, blocks, lines, KEYS).withColumn("doc", F.floor(col("page_num") / 10))
    chars = rows.groupBy("doc").agg(F.sum(F.char_length("text")).alias("chars"))
    return pages.collection_stats(rows, ["doc"]).join(chars, "doc")


@query(
    "dv_boxes",
    sql=ctes("dv_boxes") + "SELECT page_num, CASE WHEN page_num % 5 = 0 THEN 'no result' WHEN page_num % 3 = 0 THEN 'broken' END AS error, CASE WHEN page_num % 5 = 0 OR page_num % 3 = 0 THEN '' ELSE max(text) END AS text FROM dv_boxes GROUP BY page_num",
)
def r07_skip_failed(boxes):
    results = boxes.where("page_num % 5 != 0").groupBy("page_num").agg(F.max("text").alias("text")).withColumn("error", F.when(col("page_num") % 3 == 0, "broken"))
    return pages.skip_failed(_pages(boxes), results, KEYS).select("page_num", "error", "text")


@query("dv_job_events", sql=ctes("dv_job_events") + "SELECT type, count(*)::BIGINT AS n, CASE type WHEN 'init' THEN 'starting' WHEN 'progress' THEN 'working' WHEN 'complete' THEN 'ready' ELSE 'other' END AS label FROM dv_job_events GROUP BY type")
def x18_x19_labels(events):
    return events.groupBy("type").agg(F.count("*").alias("n")).withColumn("label", pages.shown_as(col("type"), {"init": "starting", "progress": "working", "complete": "ready"}, F.lit("other")))


@query("dv_boxes", sql=ctes("dv_boxes") + "SELECT page_num, ord, block_type IN ('table_header', 'table_cell', 'table_row') AS is_table FROM dv_boxes UNION ALL SELECT page_num, ord, NULL FROM dv_boxes WHERE ord < 3")
def u03_union_all(boxes):
    return boxes.select("page_num", "ord", pages.is_table_block(col("block_type")).alias("is_table")).unionByName(boxes.where("ord < 3").select("page_num", "ord", F.lit(None).cast("boolean").alias("is_table")))


_POINTS = "x1 / 999.0::DOUBLE * 595 AS x, 842 - y2 / 999.0::DOUBLE * 842 AS y, (x2 - x1) / 999.0::DOUBLE * 595 AS width, (y2 - y1) / 999.0::DOUBLE * 842 AS h"


@query(
    "dv_boxes",
    sql=ctes("dv_boxes") + f""", t AS (SELECT *, floor((y1 + y2) / 2)::BIGINT AS c FROM dv_boxes WHERE block_type <> 'text'),
  g AS (SELECT *, sum(CASE WHEN abs(c - p) > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY page_num ORDER BY c, ord ROWS UNBOUNDED PRECEDING) AS row_id FROM (SELECT *, lag(c) OVER (PARTITION BY page_num ORDER BY c, ord) AS p FROM t)),
  r AS (SELECT page_num, 1 AS part, row_id AS number, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, string_agg(trim(text), chr(9) ORDER BY x1, ord) AS line FROM g GROUP BY page_num, row_id UNION ALL SELECT page_num, 0, ord, x1, y1, x2, y2, trim(text) FROM dv_boxes WHERE block_type = 'text'),
  z AS (SELECT page_num, part, number, line, {_POINTS}, greatest(least((y2 - y1) / 999.0::DOUBLE * 842, 48.0::DOUBLE), 3.0::DOUBLE) AS font FROM r)
SELECT page_num, part::BIGINT AS part, number::BIGINT AS number, line, round(x, 6) AS x, round(width, 6) AS width, round(font, 6) AS font, round(y + 0.5::DOUBLE * h - font * (0.766::DOUBLE - 0.5::DOUBLE), 6) AS baseline FROM z WHERE y + 0.5::DOUBLE * h - font * (0.766::DOUBLE - 0.5::DOUBLE) >= 0""",
)
def l17_place_blocks(boxes):
    rows = pages.place_blocks(boxes, KEYS, 595.0, 842.0, clean=F.trim)
    return rows.select("page_num", col("part").cast("long").alias("part"), "number", "line", *[F.round(c, 6).alias(c) for c in ("x", "width", "font", "baseline")])


@query(
    "dv_boxes",
    sql=ctes("dv_boxes") + f""", b AS (SELECT page_num, ord, x1, y1, x2, y2, list_filter(list_transform(string_split(replace(text, ' ', CASE ord % 3 WHEN 0 THEN chr(10) ELSE chr(10) || ' ' || chr(10) || ' ' END), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ls FROM dv_boxes WHERE block_type = 'text'),
  z AS (SELECT page_num, ord, i, ls[i + 1] AS line, len(ls) AS n, {_POINTS} FROM (SELECT *, unnest(range(len(ls))) AS i FROM b)),
  f AS (SELECT *, greatest(least(h / n, 48.0::DOUBLE), 3.0::DOUBLE) AS font FROM z)
SELECT page_num, ord::BIGINT AS number, i::BIGINT AS i, line, round(font, 6) AS font, round(y + h - (i + 0.5::DOUBLE) * (h / n) - font * (0.766::DOUBLE - 0.5::DOUBLE), 6) AS baseline FROM f WHERE y + h - (i + 0.5::DOUBLE) * (h / n) - font * (0.766::DOUBLE - 0.5::DOUBLE) >= 0""",
)
def l17_place_lines(boxes):
    breaks = F.when(col("ord") % 3 == 0, "\n").otherwise("\n \n ")
    texts = boxes.where("block_type = 'text'").withColumn("text", F.replace(col("text"), F.lit(" "), breaks))
    placed = pages.place_blocks(texts, KEYS, 595.0, 842.0, clean=F.trim)
    return placed.select("page_num", "number", col("i").cast("long").alias("i"), "line", F.round("font", 6).alias("font"), F.round("baseline", 6).alias("baseline"))


@query("dv_boxes", sql=ctes("dv_boxes") + f"SELECT page_num, number, round(x, 6) AS x, round(width, 6) AS width FROM (SELECT page_num, ord::BIGINT AS number, greatest(least((y2 - y1) / 999.0::DOUBLE * 842, 48.0::DOUBLE), 3.0::DOUBLE) AS font, {_POINTS} FROM dv_boxes WHERE block_type = 'text' AND trim(text) <> '') WHERE y + 0.5::DOUBLE * h - font * (0.766::DOUBLE - 0.5::DOUBLE) >= 0")
def l18_positions_alone(boxes):
    placed = pages.without_text(pages.place_blocks(boxes.where("block_type = 'text'"), KEYS, 595.0, 842.0))
    return placed.select("page_num", "number", F.round("x", 6).alias("x"), F.round("width", 6).alias("width"))


@query(
    "dv_state_events",
    sql=ctes("dv_state_events") + """, a AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY job_id) AS n, coalesce(status, '') AS st, lag(coalesce(status, '')) OVER w AS was FROM dv_state_events WHERE type = 'progress' WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
  b AS (SELECT *, sum(CASE WHEN st <> was AND st IN ('post_processing', 'generating_pdf', 'writing_output') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq) AS phase FROM a),
  p AS (SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY job_id, phase))) / 1000000.0::DOUBLE AS e FROM b)
SELECT job_id, seq, round(CASE WHEN k > 0 THEN e / k ELSE 0 END, 4) AS seconds_per_page, round(CASE WHEN k > 0 AND e > 0 AND n > k THEN (n - k) * (e / k) ELSE 0 END, 4) AS remaining, round(CASE WHEN e > 0 THEN n / e * 60 ELSE 0 END, 6) AS pages_per_minute FROM p""",
)
def m10_pace(events):
    from pyspark.sql import Window

    job = Window.partitionBy("job_id")
    rows = events.where("type = 'progress'").select("job_id", "seq", "ts", "status", (F.row_number().over(job.orderBy("seq")) - 1).alias("current"), F.count("*").over(job).alias("total"))
    return pages.job_pace(rows).select("job_id", "seq", F.round("seconds_per_page", 4).alias("seconds_per_page"), F.round("remaining", 4).alias("remaining"), F.round("pages_per_minute", 6).alias("pages_per_minute"))


_STATE = """, n AS (SELECT *, i IS NULL OR seq >= i AS now FROM (SELECT *, max(CASE WHEN type = 'init' THEN seq END) OVER (PARTITION BY job_id) AS i FROM dv_state_events)),
  q AS (SELECT *, lag(st) OVER w AS was, row_number() OVER w AS k FROM (SELECT *, CASE WHEN type = 'init' THEN '' ELSE coalesce(status, '') END AS st FROM n WHERE now AND type IN ('init', 'progress')) WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
  g AS (SELECT job_id, min(seq) AS begun, arg_max(st, seq) AS phase, coalesce(arg_max(ts, seq) FILTER (k > 1 AND st <> was AND st IN ('post_processing', 'generating_pdf', 'writing_output')), arg_min(ts, seq) FILTER (k > 1)) AS phase_start,
    coalesce(arg_max(current_page, seq) FILTER (type = 'progress' AND current_page IS NOT NULL), 0) AS current_page, coalesce(arg_max(CASE WHEN type = 'init' THEN coalesce(total_pages, 0) ELSE total_pages END, seq) FILTER (type = 'init' OR total_pages IS NOT NULL), 0) AS total_pages,
    coalesce(arg_max(memory_mb, seq) FILTER (type = 'progress' AND memory_mb IS NOT NULL), 0) AS memory_mb FROM q GROUP BY job_id),
  s AS (SELECT n.job_id, count(*) AS skipped FROM n JOIN g USING (job_id) WHERE now AND seq > begun AND (type = 'page_error' OR type = 'error' AND recoverable) GROUP BY n.job_id),
  c AS (SELECT job_id, arg_max(type, seq) AS t, arg_max(output_path, seq) AS own, arg_max(CASE WHEN pt = 'complete' THEN pp ELSE '' END, seq) FILTER (type = 'split_complete') AS path, arg_max(coalesce(total_parts, 0), seq) FILTER (type = 'split_complete') AS parts
    FROM (SELECT *, lag(type) OVER w AS pt, lag(output_path) OVER w AS pp FROM n WHERE type IN ('complete', 'split_complete') WINDOW w AS (PARTITION BY job_id ORDER BY seq)) GROUP BY job_id),
  d AS (SELECT job_id, arg_max(CASE type WHEN 'download' THEN 'downloading' WHEN 'error' THEN 'error' WHEN 'split_complete' THEN 'complete' ELSE 'processing' END, seq) FILTER (type IN ('init', 'progress', 'download', 'split_complete') OR type = 'error' AND NOT recoverable) AS app,
    arg_max(code, seq) FILTER (type = 'error' AND NOT recoverable) AS error_code, arg_max(message, seq) FILTER (type = 'log' AND level = 'warn' AND contains(message, 'memory')) AS warning, least(count_if(type = 'log'), 50) AS logs FROM n GROUP BY job_id)
SELECT d.job_id, CASE WHEN c.t = 'complete' THEN 'complete' WHEN app = 'processing' THEN 'error' ELSE coalesce(app, 'idle') END AS app_state, g.phase, g.phase_start, g.current_page::INT AS current_page, g.total_pages::INT AS total_pages, g.memory_mb, coalesce(s.skipped, 0)::BIGINT AS skipped,
  CASE WHEN c.t = 'complete' THEN c.own ELSE nullif(c.path, '') END AS output_path, false AS pending, c.parts::INT AS parts, d.error_code, d.warning, d.logs::BIGINT AS logs FROM d LEFT JOIN g USING (job_id) LEFT JOIN s USING (job_id) LEFT JOIN c USING (job_id)"""


@query("dv_state_events", sql=ctes("dv_state_events") + _STATE)
def r02_r04_job_states(events):
    return jobs.job_table(events, splits=2, finished=True)


@query(
    "dv_worker_events",
    sql=ctes("dv_worker_events") + """, p AS (SELECT job_id, seq, worker_id, row_number() OVER (PARTITION BY job_id, worker_id ORDER BY seq) AS n FROM dv_worker_events WHERE type = 'page_done'),
  m AS (SELECT a.job_id, a.seq, b.worker_id, max(b.n) AS n FROM p a JOIN p b ON a.job_id = b.job_id AND b.seq <= a.seq GROUP BY ALL)
SELECT job_id, seq, string_agg(worker_id || ':' || n, ' ' ORDER BY worker_id) AS workers, sum(n)::BIGINT AS completed FROM m GROUP BY job_id, seq""",
)
def a11_worker_progress(events):
    shown = F.array_join(F.transform("workers", lambda w: F.concat_ws(":", w["worker_id"], w["completed"])), " ")
    return jobs.worker_progress(events).select("job_id", "seq", shown.alias("workers"), "completed")


@query("documents")
def e03_x11_refined(docs):
    return docs.select("doc_id", F.sha2(pages.refined(col("text"), lambda c: F.replace(c, F.lit("e"), F.lit("3")), "{text}").cast("binary"), 256).alias("text_sha256"))
