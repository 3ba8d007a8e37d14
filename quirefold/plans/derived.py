"""Inputs derived from the driver's tables by the same SQL in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name: (table, SQL over {t}).
SQL = {
    "dv_words": (
        "events",
        """SELECT CAST(floor(event_id / 40) AS BIGINT) AS page_num, event_id % 40 AS ord,
  60 + (event_id % 8) * 110 + (event_id * 31) % 25 + CASE WHEN event_id % 8 >= 4 THEN 60 ELSE 0 END AS x,
  80 + CAST(floor((event_id % 40) / 8) AS BIGINT) * 40 + (event_id * 7919) % 13 + CASE WHEN CAST(floor(event_id / 40) AS BIGINT) % 2 = 1 THEN (event_id % 8) * 4 ELSE 0 END AS y,
  50 + (event_id * 17) % 40 AS w, 16 + (event_id * 13) % 9 AS h, (event_id * 53) % 100 AS conf,
  1 + CAST(floor((event_id % 40) / 24) AS BIGINT) AS block_num, 1 AS par_num,
  1 + CAST(floor((event_id % 40) / 8) AS BIGINT) AS line_num,
  CASE WHEN event_id % 29 = 0 THEN ' ' ELSE event_type END AS text FROM {t}""",
    ),
    "dv_boxes": (
        "part",
        """SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS page_num, p_partkey % 20 AS ord,
  CASE WHEN p_partkey % 3 = 0 THEN 'text' WHEN p_partkey % 3 = 1 THEN 'table_cell' ELSE 'table_header' END AS block_type,
  (p_partkey * 37) % 900 AS x1, (p_partkey * 53) % 900 AS y1,
  (p_partkey * 37) % 900 + 20 + (p_partkey * 11) % 90 AS x2, (p_partkey * 53) % 900 + 10 + (p_partkey * 7) % 40 AS y2,
  p_name AS text FROM {t}""",
    ),
    "dv_versions": (
        "conversations",
        """SELECT conv_id AS doc_id, turn AS page_num, text AS original,
  CASE WHEN (conv_id + turn) % 2 = 0 THEN replace(text, 'e', '3') ELSE text END AS v0,
  CASE WHEN (conv_id + turn) % 3 = 0 THEN replace(text, 'n', 'm') ELSE text END AS v1,
  CASE WHEN (conv_id + turn) % 5 = 0 THEN replace(text, 'o', '0') ELSE text END AS v2 FROM {t}""",
    ),
    "dv_profile": (
        "events",
        """SELECT CAST(floor(event_id / 500) AS BIGINT) AS page_num, event_id % 500 AS pos,
  CASE WHEN event_id % 37 < 20 THEN 5 + (event_id * 7) % 60 WHEN event_id % 37 = 28 THEN 3 ELSE 0 END AS dark FROM {t}""",
    ),
    "dv_job_events": (
        "events",
        """SELECT user_id AS job_id, event_id AS seq, ts,
  CASE event_type WHEN 'error' THEN 'page_error' WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'init' WHEN 'view' THEN 'progress' ELSE 'log' END AS type,
  CASE WHEN event_type = 'error' THEN 1 + event_id % 97 END AS page, value FROM {t}""",
    ),
    "dv_state_events": (
        "events",
        """SELECT user_id AS job_id, event_id AS seq, ts,
  CASE event_type WHEN 'error' THEN CASE WHEN event_id % 9 = 0 THEN 'error' ELSE 'page_error' END WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'split_complete' ELSE 'complete' END
    WHEN 'signup' THEN 'init' WHEN 'view' THEN 'progress' ELSE CASE WHEN event_id % 5 = 0 THEN 'download' ELSE 'log' END END AS type,
  CASE event_id % 4 WHEN 0 THEN 'ocr_processing' WHEN 1 THEN 'post_processing' WHEN 2 THEN 'generating_pdf' END AS status,
  CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 50 AS INT) END AS current_page, CASE WHEN event_id % 6 <> 0 THEN CAST(50 + event_id % 3 AS INT) END AS total_pages,
  CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 8000 AS DOUBLE) END AS memory_mb, CASE WHEN event_id % 2 = 0 THEN 'warn' ELSE 'info' END AS level,
  concat(CASE WHEN event_id % 6 = 0 THEN 'low memory ' ELSE 'working ' END, event_id) AS message, CASE WHEN event_id % 4 = 0 THEN 'E020' ELSE 'E099' END AS code, event_id % 4 = 1 AS recoverable,
  CAST(1 + event_id % 97 AS INT) AS page, concat('out/', event_id) AS output_path, CASE WHEN event_id % 2 = 0 THEN 3 END AS total_parts FROM {t}""",
    ),
    "dv_strokes": (
        "events",
        """SELECT page_num, CASE WHEN k < 8 THEN 10 WHEN k < 14 THEN 10 + (k - 8) * 14 ELSE event_id * 37 % 94 END AS x1, CASE WHEN k < 8 THEN 10 + k * 10 WHEN k < 14 THEN 10 ELSE event_id * 53 % 98 END AS y1,
  CASE WHEN k < 8 THEN 80 - page_num % 3 * (event_id % 17) WHEN k < 14 THEN 10 + (k - 8) * 14 ELSE event_id * 37 % 94 + event_id % 6 END AS x2, CASE WHEN k < 8 THEN 10 + k * 10 WHEN k < 14 THEN 80 - page_num % 5 * (event_id % 4) * 3 ELSE event_id * 53 % 98 END AS y2
  FROM (SELECT event_id, CAST(floor(event_id / 40) AS BIGINT) AS page_num, event_id % 40 AS k FROM {t})""",
    ),
    "dv_worker_events": (
        "events",
        """SELECT user_id AS job_id, event_id AS seq, event_id * 7 % 5 AS worker_id, CASE WHEN event_type = 'error' THEN 'page_error' ELSE 'page_done' END AS type FROM {t}""",
    ),
}

#: A pixel of dv_gray: lines of text of 8 rows in 15, of several widths, on a light ground; a page in seven has no contrast.
GRAY = "CASE WHEN y % 15 < 8 AND page_num % 7 <> 6 AND x BETWEEN 5 + page_num % 3 * 4 AND 50 - CAST(floor(y / 15) AS BIGINT) * 6 THEN 20 + (event_id * 7 + x * 13) % 70 ELSE 215 + (event_id * 11 + x * 5) % 30 END"

#: For DuckDB: common table expressions, lines and terms among them.
CTE = {name: f"{name} AS ({sql.format(t=table)})" for name, (table, sql) in SQL.items()} | {
    "dv_lines": "dv_lines AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)",
    "dv_pixels": f"dv_pixels AS (SELECT DISTINCT page_num, x, y FROM (SELECT page_num, y1, y2, unnest(range(x1, x2 + 1)) AS x FROM ({SQL['dv_strokes'][1].format(t='events')})) s, LATERAL (SELECT unnest(range(y1, y2 + 1)) AS y))",
    "dv_gray": "dv_gray AS (SELECT page_num, x, y, {gray} AS gray FROM (SELECT event_id, event_id // 120 AS page_num, event_id % 120 AS y, unnest(range(60)) AS x FROM events))",
    "dv_terms": "dv_terms AS (SELECT DISTINCT term FROM (SELECT unnest(string_split(text, ' ')) AS term FROM benchmark) WHERE length(term) >= 4)",
}


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(CTE[n].replace("{gray}", GRAY) for n in names) + " "


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table or a derived input."""
    if name in SQL:
        table, sql = SQL[name]
        return spark.sql(sql, t=read(spark, sf_dir, table))
    if name == "dv_lines":
        return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).withColumn("i", F.col("i").cast("long"))
    if name == "dv_pixels":
        strokes = read(spark, sf_dir, "dv_strokes").select("page_num", "y1", "y2", F.explode(F.sequence("x1", "x2")).alias("x"))
        return strokes.select("page_num", "x", F.explode(F.sequence("y1", "y2")).alias("y")).distinct()
    if name == "dv_gray":
        rows = read(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 120).alias("page_num"), (F.col("event_id") % 120).alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))).alias("x"))
        return rows.select("page_num", "x", "y", F.expr(GRAY).alias("gray"))
    if name == "dv_gray_rows":  # dv_gray with a row for each of an image's rows
        rows = read(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 120).alias("page_num"), (F.col("event_id") % 120).alias("y"), F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long")).alias("xs"))
        return rows.select("page_num", "y", F.col("xs").alias("x"), F.expr(f"transform(xs, x -> cast({GRAY} AS SMALLINT))").alias("gray"))
    if name == "dv_terms":
        return read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("term")).where("length(term) >= 4").distinct()
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
