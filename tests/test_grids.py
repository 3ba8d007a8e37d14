"""Grids, polygons, fonts, block corrections and table rows against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quirefold.functions.text import is_valid_correction
from quirefold.operators import grids, layout, pages, placement, profiles, tables, voting

# --- grids


def _opened(grid, k, down):
    """Pixels of runs of at least k along one axis."""
    kept = set()
    for x, y in grid:
        step = (0, 1) if down else (1, 0)
        if (x - step[0], y - step[1]) in grid:
            continue
        run = [(x, y)]
        while (nxt := (run[-1][0] + step[0], run[-1][1] + step[1])) in grid:
            run.append(nxt)
        if len(run) >= k:
            kept.update(run)
    return kept


def _flood(start, allowed, steps):
    seen, stack = {start}, [start]
    while stack:
        x, y = stack.pop()
        for dx, dy in steps:
            p = (x + dx, y + dy)
            if p in allowed and p not in seen:
                seen.add(p)
                stack.append(p)
    return seen


FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]
EIGHT = [*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1)]


def _outer(mask, w, h):
    everywhere = {(x, y) for x in range(-1, w + 1) for y in range(-1, h + 1)}
    outside = _flood((-1, -1), everywhere - mask, FOUR)
    left, out = set(mask), []
    while left:
        part = _flood(next(iter(left)), left, EIGHT)
        left -= part
        if any((x + dx, y + dy) in outside for x, y in part for dx, dy in FOUR):
            xs, ys = [x for x, _ in part], [y for _, y in part]
            out.append((min(xs), min(ys), max(xs), max(ys)))
    return out


def _regions(grid, w, h):
    across, down = _opened(grid, max(1, w // 30), False), _opened(grid, max(1, h // 30), True)
    out = []
    for x1, y1, x2, y2 in sorted(_outer(across | down, w, h), key=lambda b: (b[1], b[0], b[2], b[3])):
        rw, rh = x2 - x1 + 1, y2 - y1 + 1
        if rw * rh < 0.05 * w * h or not 0.3 <= rw / rh <= 3:
            continue
        rows = [sum((x, y) in across for x in range(x1, x2 + 1)) for y in range(y1, y2 + 1)]
        cols = [sum((x, y) in down for y in range(y1, y2 + 1)) for x in range(x1, x2 + 1)]
        edges = lambda lit: [i for i, v in enumerate(lit) if v and (i == 0 or not lit[i - 1])]
        hs, vs = [y1 + i for i in edges([n >= rw * 0.1 for n in rows])], [x1 + i for i in edges([n >= rh * 0.1 for n in cols])]
        if len(hs) >= 2 and len(vs) >= 2:
            n = lambda lit: max(1, sum(i > 0 for i in edges([v > 0 for v in lit])) + 1)
            out.append((len(out), x1, y1, rw, rh, n(rows), n(cols), hs, vs))
    return out


def _drawn(r, w, h):
    grid = set()
    for _ in range(r.randint(0, 3)):
        x, y, cw, ch = r.randrange(w // 2), r.randrange(h // 2), r.randint(3, 9), r.randint(3, 9)
        n, m = r.randint(1, 4), r.randint(1, 4)
        for i in range(n + 1):
            grid |= {(x + d, y + i * ch) for d in range(m * cw + 1)}
        for j in range(m + 1):
            grid |= {(x + j * cw, y + d) for d in range(n * ch + 1)}
    grid |= {(r.randrange(w), r.randrange(h)) for _ in range(r.randint(0, 60))}
    grid -= {(r.randrange(w), r.randrange(h)) for _ in range(r.randint(0, 100))}
    return {(x, y) for x, y in grid if x < w and y < h}


def test_table_regions_on_random_grids(spark):
    r, w, h = random.Random(2), 64, 60
    pages_ = {p: _drawn(r, w, h) for p in range(60)}
    # a table inside a table's cell is not one of its own
    ring = {(x, y) for x in range(64) for y in (0, 59)} | {(x, y) for x in (0, 63) for y in range(60)}
    pages_[100] = ring | {(x, y) for x in range(10, 41) for y in (10, 20, 30)} | {(x, y) for x in (10, 25, 40) for y in range(10, 31)}
    pixels = spark.createDataFrame([(p, x, y) for p, g in pages_.items() for x, y in g], "page int, x int, y int")
    got = {}
    for t in grids.table_regions(pixels, ["page"], w, h).orderBy("page", "region").collect():
        got.setdefault(t.page, []).append((t.region, t.x, t.y, t.width, t.height, t.rows, t.cols, list(t.h_positions), list(t.v_positions)))
    want = {p: found for p, g in pages_.items() if (found := _regions(g, w, h))}
    assert got == want and len(want) > 20 and len(want[100]) == 1
    quick = {t.page: (t.h_lines, t.v_lines, t.table) for t in grids.has_table(pixels, ["page"], w, h).collect()}
    for p, g in pages_.items():
        if g:
            ys, xs = sorted({y for _, y in _opened(g, 3, False)}), sorted({x for x, _ in _opened(g, 3, True)})
            n = [sum(i == 0 or v[i - 1] < at - 1 for i, at in enumerate(v)) for v in (ys, xs)]
            assert quick[p] == (*n, min(n) >= 2)
    assert grids.table_regions(pixels.limit(0), ["page"], w, h).collect() == []


def test_strokes_stay_whole(spark):
    r, strokes = random.Random(4), []
    for p in range(12):
        x, y, cell = r.randint(2, 12), r.randint(2, 12), r.randint(9, 14)
        for i in range(4):
            strokes += [(p, x, y + i * cell, x + 3 * cell - r.randint(0, 3), y + i * cell), (p, x + i * cell, y, x + i * cell, y + 3 * cell)]
        strokes += [(p, a, b, a + r.randint(0, 5), b + r.randint(0, 3)) for a, b in ((r.randrange(55), r.randrange(55)) for _ in range(6))]
    strokes += [(0, 5, 5, 4, 9)]
    pixels = sorted({(p, x, y) for p, x1, y1, x2, y2 in strokes for x in range(x1, x2 + 1) for y in range(y1, y2 + 1)})
    boxes, points = spark.createDataFrame(strokes, "page int, x1 int, y1 int, x2 int, y2 int"), spark.createDataFrame(pixels, "page int, x int, y int")
    for found in (grids.table_regions, grids.has_table):
        got = found(boxes, ["page"], 64, 60)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, found(points, ["page"], 64, 60).collect())) and got.count() > 5
        plan = found(boxes, ["page"], 64, 60)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan and "Window" not in plan


@pytest.mark.parametrize("size", [(100, 80), (101, 83), (3, 3)])
def test_quarter_takes_the_middle_pixels(spark, size):
    w, h = size
    pixels = spark.createDataFrame([(1, x, y) for x in range(w) for y in range(h)], "page int, x int, y int")
    nw, nh = max(1, int(w * 0.25)), max(1, int(h * 0.25))
    got = {(r.x, r.y) for r in grids.quarter(pixels, ["page"], w, h).collect()}
    assert got == {(x, y) for x in range(nw) for y in range(nh)} and grids.quarter(pixels, ["page"], w, h).count() == nw * nh


def test_text_lines_exchange_image_rows_once(spark):
    r = random.Random(9)
    shade = {(p, x, y): 230 if y % 11 > 6 or x > 50 - p else r.randint(0, 90) for p in range(3) for x in range(60) for y in range(130)}
    pixels = spark.createDataFrame([(p, x, y, g) for (p, x, y), g in shade.items()], "page int, x int, y int, gray int")
    rows = spark.createDataFrame([(p, y, list(range(60)), [shade[p, x, y] for x in range(60)]) for p in range(3) for y in range(130)], "page int, y int, x array<int>, gray array<int>")
    found = grids.text_lines(rows, ["page"], 60, 130)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, grids.text_lines(pixels, ["page"], 60, 130).collect())) and found.count() > 9
    plan = grids.text_lines(rows, ["page"], 60, 130)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_text_lines_on_grey_images(spark):
    r, w, h, rows = random.Random(5), 40, 230, []
    for p in range(4):
        for y in range(h):
            for x in range(w):
                ink = y % 17 < 6 + p and 4 <= x < 36 - p * 5 and p < 3
                rows.append((p, x, y, r.randint(0, 110) if ink else 250 if p == 3 else r.randint(180, 255)))
    got = [(t.page, t.ord, t.x, t.y, t.x2, t.y2) for t in grids.text_lines(spark.createDataFrame(rows, "page int, x int, y int, gray int"), ["page"], w, h).orderBy("page", "ord").collect()]
    want = []
    for p in range(4):
        gray = {(x, y): g for q, x, y, g in rows if q == p}
        dark = set()
        for start in range(0, h, 100):
            block = {k: g for k, g in gray.items() if start <= k[1] < start + 100}
            mean = sum(block.values()) / len(block)
            std = math.sqrt(sum((g - mean) ** 2 for g in block.values()) / len(block))
            if std >= 10:
                dark |= {k for k, g in block.items() if g < max(mean - 0.8 * std, 80)}
        n = [0, *[sum((x, y) in dark for x in range(w)) for y in range(h)], 0]
        lit = [sum(n[y : y + 3]) / 3 > w * 0.005 for y in range(h)]
        found, y = [], 0
        while y < h:
            if lit[y]:
                end = y
                while end < h and lit[end]:
                    end += 1
                xs = sorted({x for x, v in dark if y <= v < end})
                if len(xs) >= w * 0.015 and not (end - y <= 5 and xs[-1] - xs[0] > w * 0.7):
                    found.append((xs[0], y, xs[-1], end))
                y = end
            y += 1
        want += [(p, i, *f) for i, f in enumerate(found)]
    assert got == want and len(want) > 20


# --- polygons


def test_polygons_get_an_upright_box_and_an_angle(spark):
    r, rows, want = random.Random(8), [], {}
    for i in range(40):
        w, h, turn, cx, cy = r.uniform(30, 90), r.uniform(5, 20), r.uniform(-44, 44), r.uniform(100, 200), r.uniform(100, 200)
        a = math.radians(turn)
        corners = [(cx + x * math.cos(a) - y * math.sin(a), cy + x * math.sin(a) + y * math.cos(a)) for x, y in ((0, 0), (w, 0), (w, h), (0, h), (w / 2, h / 2))]
        r.shuffle(corners)
        rows.append((i, corners))
        want[i] = (*[int(f(c[k] for c in corners)) for f, k in ((min, 0), (min, 1), (max, 0), (max, 1))], turn)
    rows += [(50, [(1.0, 2.0)] * 3), (51, []), (52, None), (53, [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)])]
    df = spark.createDataFrame(rows, "page int, points array<struct<x:double,y:double>>")
    got = {t.page: t for t in pages.polygon_boxes(df, ["page"]).collect()}
    for i, (x, y, x2, y2, turn) in want.items():
        assert (got[i].x, got[i].y, got[i].x2, got[i].y2) == (x, y, x2, y2) and abs(got[i].angle - turn) < 1e-4
    assert got[50].angle == 0 and got[53].angle == 0 and 51 not in got and 52 not in got
    found = pages.detected_regions(pages.polygon_boxes(df, ["page"]), ["page"], 400, 400)
    assert {t.page: t.angle for t in found.collect()}[3] == got[3].angle
    merged = layout.regions(found.withColumns({"h": F.col("y2") - F.col("y"), "ord": F.lit(0), "page": F.lit(1)}).where("false").unionByName(found.withColumns({"h": F.col("y2") - F.col("y"), "ord": F.lit(0)}).where("page < 2")), ["page"])
    assert {t.page: t.angle for t in merged.collect()} == {p: got[p].angle for p in (0, 1)}


# --- fonts


def test_fonts_fit_their_boxes(spark):
    widths = {ord("a"): 500.0, ord("W"): 1000.0, ord("가"): 900.0, ord("𝄞"): 700.0, -1: 250.0}
    table = spark.createDataFrame(list(widths.items()), "code int, width double")
    texts = ["aWa", "", "가 a𝄞?", "W" * 40, "  \n a \n\nWWW"]
    rows = [(1, i, "text", 100 * i, 100, 100 * i + 90, 150, t) for i, t in enumerate(texts)]
    blocks = spark.createDataFrame(rows, "page int, ord long, block_type string, x1 long, y1 long, x2 long, y2 long, text string")
    measure = lambda s: sum(widths.get(ord(c), 250.0) for c in s)
    got = {(r.number, r.i): (r.line, round(r.font, 6), round(r.baseline, 6)) for r in pages.place_blocks(blocks, ["page"], 999.0, 999.0, clean=F.trim, widths=table).collect()}
    want = {}
    for i, t in enumerate(texts):
        lines = [s.strip() for s in t.split("\n") if s.strip()]
        for k, line in enumerate(lines):
            font = max(3.0, min(50 / len(lines), 48.0))
            longest = max(measure(s) for s in lines) * font / 1000
            font = max(3.0, font * 90 / longest) if longest > 90 else font
            want[i, k] = (line, round(font, 6), round(999 - 100 - (k + 0.5) * 50 / len(lines) - font * 0.266, 6))
    assert got == want and want[3, 0][1] == 3.0
    norm = blocks.select("page", "ord", "text", *[(F.col(a) / 999).alias(b) for a, b in (("x1", "x"), ("y1", "y"), ("x2", "x2"), ("y2", "y2"))])
    fitted = {(r.ord, r.i): (r.line, round(r.font, 6), round(r.baseline, 6)) for r in placement.block_lines(norm, ["page", "ord"], 999.0, 999.0, widths=table).collect()}
    assert fitted == want
    assert placement.block_lines(norm, ["page", "ord"], 999.0, 999.0, widths=table.limit(0)).where("ord = 0").first().font == min(48.0, 48.0 * 90 / (3 * 48))


# --- corrections in batches


def _valid(new, old):
    return bool(new.strip()) and 0.7 <= len(new.strip()) / max(len(old), 1) <= 1.3


def _plain_blocks(texts, f):
    def alone(t):
        own = t.strip()
        if len(own) < 3:
            return t
        answer = f(own[:500])
        return answer.strip() if answer is not None and _valid(answer, own) else t

    worth = [i for i, t in enumerate(texts) if len(t.strip()) >= 3]
    if not worth:
        return texts
    batch = "\n".join(texts[i] for i in worth)
    if len(batch) > 500:
        return [alone(t) for t in texts]
    answer = f(batch)
    if answer is None:
        return texts
    lines = answer.strip().split("\n")
    if len(lines) != len(worth):
        return [alone(t) for t in texts]
    out = list(texts)
    for i, line in zip(worth, lines, strict=True):
        if line.strip() and _valid(line, texts[i].strip()):
            out[i] = line.strip()
    return out


def test_blocks_are_corrected_together_or_alone(spark):
    # of the answers: line counts change by X, a line's length by L, there is none for N; a digit is corrected anywhere
    column = lambda c: F.when(c.contains("N"), F.lit(None)).otherwise(F.replace(F.replace(F.replace(c, F.lit("X"), F.lit("\n")), F.lit("L"), F.lit("long answer in place of a letter")), F.lit("0"), F.lit("o")))
    plain = lambda s: None if "N" in s else s.replace("X", "\n").replace("L", "long answer in place of a letter").replace("0", "o")
    r = random.Random(3)
    pages_ = [[r.choice(["w0rd 0ne", "ab", " 0k ", "", "anXother 0ne", "Line 0f text", "N0ne", "plain", "f00 " * r.choice([1, 90, 140]), "two\nl1nes 0"]) for _ in range(r.randint(1, 6))] for _ in range(120)]
    rows = [(p, i, t, p * 7) for p, ts in enumerate(pages_) for i, t in enumerate(ts)] + [(500, 0, None, 1)]
    got = {}
    for t in voting.correct_blocks(spark.createDataFrame(rows, "page int, ord int, text string, other int"), ["page"], column).orderBy("page", "ord").collect():
        assert t.other == (1 if t.page == 500 else t.page * 7)
        got.setdefault(t.page, []).append(t.text)
    assert got == {p: _plain_blocks(ts, plain) for p, ts in enumerate(pages_)} | {500: [""]}
    assert spark.range(1).select(is_valid_correction(F.lit("ab"), F.lit("ab")).alias("v")).first().v


# --- tables by grids


def _plain_rows(blocks, regions, width, height):
    first = min(regions, key=lambda t: t[0])
    box = lambda t: (int(t[1] / width * 999), int(t[2] / height * 999), int((t[1] + t[3]) / width * 999), int((t[2] + t[4]) / height * 999))
    boxes = [box(t) for t in regions]
    meets = lambda b: any(not (b[3] < x1 or b[1] > x2 or b[4] < y1 or b[2] > y2) for x1, y1, x2, y2 in boxes)
    inside, out = [b for b in blocks if meets(b)], [("text", *b[1:5], b[5], 0) for b in blocks if not meets(b)]
    gaps = sorted(b - a for a, b in zip(first[5], first[5][1:], strict=False) if b > a)
    median = (gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2 if gaps else None
    tolerance = 15 if median is None else max(1, int(median / height * 999 / 2))
    bounds, rows = [int(x / width * 999) for x in first[6]], []
    centre = lambda b: (b[2] + b[4]) // 2
    for b in sorted(inside, key=lambda b: (centre(b), b[0])):
        if rows and abs(centre(b) - centre(rows[-1][-1])) <= tolerance:
            rows[-1].append(b)
        else:
            rows.append([b])
    for row in rows:
        if len(bounds) >= 2:
            cells = [""] * (len(bounds) - 1)
            for b in row:
                k = next((i for i in range(len(cells)) if bounds[i] <= (b[1] + b[3]) // 2 < bounds[i + 1]), None)
                if k is not None and cells[k] == "":
                    cells[k] = b[5].strip()
        else:
            cells = [b[5].strip() for b in sorted(row, key=lambda b: b[1])]
        out.append(("table_row", min(b[1] for b in row), min(b[2] for b in row), max(b[3] for b in row), max(b[4] for b in row), "\t".join(cells), 1))
    return sorted(out)


def test_tables_are_rebuilt_by_their_grids(spark):
    r, blocks, regions, want = random.Random(6), [], [], {}
    for p in range(60):
        mine = []
        for i in range(r.randint(0, 25)):
            x, y = r.randrange(900), r.randrange(900)
            mine.append((i, x, y, x + r.randint(1, 99), y + r.randint(1, 60), r.choice(["a", " b ", "", " ", f"t{i}"])))
        found = []
        for k in range(r.randint(1, 2)):
            x, y = r.randrange(500), r.randrange(700)
            hs = sorted(r.sample(range(y, y + 600), r.choice([0, 1, 2, 5, 6])))
            vs = sorted(r.sample(range(x, x + 500), r.choice([0, 1, 2, 4])))
            found.append((k, x, y, r.randint(50, 500), r.randint(50, 600), hs, vs))
        blocks += [(p, *b) for b in mine]
        regions += [(p, *t) for t in found]
        want[p] = _plain_rows(mine, found, 1000, 1400)
    b = spark.createDataFrame(blocks, "page int, ord long, x1 long, y1 long, x2 long, y2 long, text string").withColumn("block_type", F.lit("text"))
    t = spark.createDataFrame(regions, "page int, region long, x long, y long, width long, height long, h_positions array<long>, v_positions array<long>")
    got = {p: [] for p in want}
    for x in tables.rebuild(b, tables.on_grid(t, ["page"], 1000, 1400), ["page"], grid=tables.first_grid(t, ["page"], 1000, 1400)).collect():
        got[x.page].append((x.block_type, x.x1, x.y1, x.x2, x.y2, x.text, x.part))
    assert {p: sorted(v) for p, v in got.items()} == want


def test_regions_of_pixels_without_the_empty_ones(spark):
    dark = [(1, x, y, 1) for x in (0, 1, 2, 20, 21) for y in (0, 1, 10)]
    got = profiles.text_regions(spark.createDataFrame(dark, "page int, x int, y int, dark int"), ["page"], 1, 1, 2).collect()
    assert sorted((r.x_min, r.y_min, r.x_max, r.y_max) for r in got) == [(0, 0, 2, 1), (0, 10, 2, 10), (20, 0, 21, 1), (20, 10, 21, 10)]


def test_polygons_are_dealt_over_tasks(spark):
    rows = spark.range(0, 50, 1, 1).select("id", F.expr("array(struct(0.0D AS x, 0.0D AS y), struct(4.0D AS x, 4.0D AS y), struct(2.0D AS x, 6.0D AS y), struct(-2.0D AS x, 2.0D AS y))").alias("points"))
    found = pages.polygon_boxes(rows, ["id"])
    assert "Exchange hashpartitioning(id" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.x, r.y, r.x2, r.y2, r.angle) for r in found.collect()} == {(-2, 0, 4, 6, 45.0)} and found.count() == 50
