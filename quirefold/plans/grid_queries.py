"""Registered queries of the grid operators and of font fitting; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids
from .derived import ctes
from .registry import query

col = F.col
KEYS = ["page_num"]


def _runs(line: str, pos: str, least: int) -> str:
    """Runs of at least `least` dark pixels along one axis."""
    return f"(SELECT page_num, {line} AS line, min({pos}) AS s, max({pos}) AS e FROM (SELECT *, {pos} - row_number() OVER (PARTITION BY page_num, {line} ORDER BY {pos}) AS g FROM dv_pixels) GROUP BY page_num, {line}, g HAVING count(*) >= {least})"


def _edges(runs: str) -> str:
    return f"(SELECT page_num, count_if(line > coalesce(p, -9) + 1) AS n FROM (SELECT page_num, line, lag(line) OVER (PARTITION BY page_num ORDER BY line) AS p FROM (SELECT DISTINCT page_num, line FROM {runs})) GROUP BY page_num)"


@query(
    "dv_strokes",
    sql=ctes("dv_pixels") + f"""SELECT p.page_num, coalesce(h.n, 0)::BIGINT AS h_lines, coalesce(v.n, 0)::BIGINT AS v_lines, coalesce(h.n, 0) >= 2 AND coalesce(v.n, 0) >= 2 AS has_grid
FROM (SELECT DISTINCT page_num FROM dv_pixels) p LEFT JOIN {_edges(_runs('y', 'x', 5))} h USING (page_num) LEFT JOIN {_edges(_runs('x', 'y', 5))} v USING (page_num)""",
)
def b03_quick_table(strokes):
    return grids.has_table(strokes, KEYS, 100, 100).withColumnRenamed("table", "has_grid")


@query("dv_strokes")
def b02_table_regions(strokes):
    return grids.table_regions(strokes, KEYS, 100, 100)


@query(
    "dv_gray_rows",
    sql=ctes("dv_gray") + """, b AS (SELECT page_num, y // 100 AS k, avg(gray) AS m, stddev_pop(gray) AS s FROM dv_gray GROUP BY ALL),
  d AS (SELECT g.page_num, x, y FROM dv_gray g JOIN b ON b.page_num = g.page_num AND b.k = g.y // 100 WHERE s >= 10 AND gray < greatest(m - s * 0.8::DOUBLE, 80.0::DOUBLE)),
  n AS (SELECT r.page_num, r.y, count(d.x) AS n FROM (SELECT DISTINCT page_num, y FROM dv_gray) r LEFT JOIN d USING (page_num, y) GROUP BY ALL),
  f AS (SELECT page_num, y, (coalesce(lag(n) OVER w, 0) + n + coalesce(lead(n) OVER w, 0)) / 3.0::DOUBLE > 60 * 0.005::DOUBLE AS lit FROM n WINDOW w AS (PARTITION BY page_num ORDER BY y)),
  r AS (SELECT page_num, min(y) AS y, max(y) + 1 AS y2 FROM (SELECT *, y - row_number() OVER (PARTITION BY page_num ORDER BY y) AS g FROM f WHERE lit) GROUP BY page_num, g),
  c AS (SELECT r.page_num, r.y, r.y2, min(d.x) AS x, max(d.x) AS x2 FROM r JOIN d ON d.page_num = r.page_num AND d.y >= r.y AND d.y < r.y2 GROUP BY ALL HAVING count(DISTINCT d.x) >= 60 * 0.015::DOUBLE)
SELECT page_num, x, y::BIGINT AS y, x2, y2::BIGINT AS y2, row_number() OVER (PARTITION BY page_num ORDER BY y, x)::BIGINT - 1 AS ord FROM c WHERE NOT (y2 - y <= 5 AND x2 - x > 60 * 0.7::DOUBLE)""",
)
def g16_text_lines(gray):
    return grids.text_lines(gray, KEYS, 60, 120).withColumn("ord", col("ord").cast("long"))
