"""Operators against plain Python and against the registered SQL."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quirefold.operators import layout, lexicon, placement, profiles, tables, voting
from quirefold.plans.registry import ORACLES, QUERIES
from quirefold.sources import files
from quirefold.streaming import jobs

SF = "/root/testdata/sf0.001"


def _plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    rows = QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in rows.collect()), key=repr)
    if name not in ORACLES:
        return
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(_plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_running_rows_follow_the_mean(spark):
    # centres drift: each box is near the one before, but the last is far from the row's mean
    boxes = [(1, i, 10 * i, 100 + 5 * i, 10) for i in range(4)]
    got = layout.running_rows(spark.createDataFrame(boxes, "page int, ord int, x int, y int, h int"), ["page"]).orderBy("ord").collect()
    mean, rows, current = [], [], -1
    for _, _, _, y, h in boxes:
        cy = y + h / 2
        if mean and abs(cy - sum(mean) / len(mean)) <= 6.0:
            mean.append(cy)
        else:
            current, mean = current + 1, [cy]
        rows.append(current)
    assert [r["row_id"] for r in got] == rows and len(set(rows)) > 1


def test_contained_boxes_are_compared_with_the_last_kept(spark):
    boxes = [(1, 0, 0, 0, 100, 100), (1, 1, 10, 10, 20, 20), (1, 2, 30, 15, 40, 25), (1, 3, 0, 200, 10, 210)]
    got = layout.drop_contained(spark.createDataFrame(boxes, "page int, ord int, x int, y int, x2 int, y2 int"), ["page"])
    assert sorted(r["ord"] for r in got.collect()) == [0, 3]


def test_merge_and_match(spark):
    schema = "page int, ord int, x int, y int, x2 int, y2 int, text string"
    a = spark.createDataFrame([(1, 0, 0, 0, 50, 20, "a"), (1, 1, 52, 2, 90, 22, "b"), (1, 2, 0, 100, 50, 120, "c")], schema)
    merged = layout.merge_close(a, ["page"]).orderBy("group_id").collect()
    assert [(r["text"], r["x2"], r["n"]) for r in merged] == [("a", 90, 2), ("c", 50, 1)]
    b = spark.createDataFrame([(1, 0, -5, 3, 60, 21, ""), (1, 1, 0, 300, 50, 320, ""), (1, 2, 10, 302, 70, 322, "")], schema)
    lines = layout.match_lines(a.where("ord = 0"), b, ["page"]).orderBy("ord").collect()
    assert [(r["x"], r["x2"]) for r in lines] == [(-5, 60), (0, 70)]


def test_gap_tolerance_and_medians(spark):
    lines = spark.createDataFrame([(1, 0), (1, 100), (1, 200), (2, 5)], "page int, pos int")
    got = {r["page"]: r["tolerance"] for r in layout.gap_tolerance(lines, ["page"], 1000).collect()}
    assert got == {1: 49, 2: 15}
    heights = spark.createDataFrame([(10,), (20,), (30,), (40,)], "h int")
    assert heights.agg(layout.upper_median("h").alias("m")).first()["m"] == 30


def test_corrections(spark):
    terms = spark.createDataFrame([("하둡",), ("빅데이터",), ("결과",)], "term string")
    docs = spark.createDataFrame([(1, "하둔에서 빵데이터를"), (2, "하둡, 결과"), (3, None)], "id int, text string")
    docs = docs.unionByName(spark.createDataFrame([(2, "other 빵데이터 x"), (None, "하둔"), (4, "")], "id int, text string"))
    got = sorted(((r["id"] or 0, r["text"]) for r in lexicon.correct_all(docs, ["id"], terms, rounds=3).collect()), key=repr)
    assert got == sorted([(1, "하둡에서 빅데이터를"), (2, "하둡, 결과"), (3, None), (2, "other 빅데이터 x"), (0, "하둡"), (4, "")], key=repr)
    unchanged = lexicon.correct_all(docs, ["id"], terms.where("term = 'none'")).collect()
    assert sorted(map(repr, unchanged)) == sorted(map(repr, docs.collect()))
    hits = lexicon.term_hits(spark.createDataFrame([("하둡 하둡 결과",), ("none",)], "line string"), ["line"], terms).collect()
    assert {r["line"]: r["hits"] for r in hits} == {"하둡 하둡 결과": 2, "none": 0}


def test_term_hits_look_up_places(spark):
    from quirefold.operators.lexicon import _hits_by_join, term_hits

    words = ["ab", "abc", "abcd", "abcde", "cdefg", "b\U0001f600", "z z", "x"]
    texts = ["", "a", "abcde abcde", "xabz z", "-" * 61 + "abcdefg", "-" * 130 + "cdefg b\U0001f600", None]
    terms, lines = spark.createDataFrame([(w,) for w in [*words, "ab"]], "term string"), spark.createDataFrame([(t,) for t in texts], "line string")
    expected = {t: sum(w in t for w in words if len(w) > 1) if t else 0 for t in texts}
    counted = term_hits(lines, ["line"], terms)
    # places are looked up where they are read: only whole lines are exchanged
    assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()
    assert {r["line"]: r["hits"] for r in counted.collect()} == expected
    assert {r["line"]: r["hits"] for r in term_hits(lines, ["line"], terms, few=2).collect()} == expected
    long = terms.where("length(term) >= 2").distinct()
    assert {r["line"]: r["hits"] for r in _hits_by_join(lines, ["line"], long, "line", block=3).collect()} == expected
    assert {r["hits"] for r in term_hits(lines, ["line"], terms.where("false")).collect()} == {0}


def test_vote_asks_no_dictionary_where_candidates_agree(spark):
    pages = spark.createDataFrame([(1, "o\np", "same\nq term", "same\nq", "same\nr"), (1, "o", "x", "y", "term")], "page int, original string, v0 string, v1 string, v2 string")
    got = voting.vote_lines(pages.where("v0 <> 'x'"), ["page"], spark.createDataFrame([("term",)], "term string")).collect()
    assert sorted((r["i"], r["line"], r["source"]) for r in got) == [(0, "same", "unanimous"), (1, "q term", "dictionary")]
    # pages that share their key keep one row a line
    assert voting.vote_lines(pages, ["page"]).count() == 3


def test_votes(spark):
    rows = spark.createDataFrame([("english", "p", "q", "r"), ("korean", "p", "q", "r"), ("code", "p", "q", "r"), ("code", "x", "x", "y"), ("code", " ", "", "")], "k string, a string, b string, c string")
    got = rows.select(voting.vote(F.lit("o"), F.col("a"), F.col("b"), F.col("c"), F.col("k")).alias("v")).collect()
    assert [tuple(r["v"]) for r in got] == [("p", "specialist"), ("q", "specialist"), ("r", "specialist"), ("x", "majority"), ("o", "unanimous")]
    assert spark.createDataFrame([("one\ntwo", "one\ntwa"), ("a", "a\nb")], "o string, c string").select(voting.accept_lines(F.col("o"), F.col("c")).alias("x")).collect()[1]["x"] == "a"


def test_placement(spark):
    lines = spark.createDataFrame([(1, i, f"l{i}") for i in range(4)] + [(2, i, f"m{i}") for i in range(5)] + [(3, 0, "z")], "page int, i int, line string")
    positions = spark.createDataFrame([(1, i, 0, 10 * i, 50, 10 * i + 8) for i in range(4)] + [(2, i, 0, 10 * i, 50, 10 * i + 8) for i in range(2)], "page int, ord int, x int, y int, x2 int, y2 int")
    got = placement.place(lines, positions, ["page"], 100.0, 100.0, 1.0, 1.0).collect()
    assert {(r["page"], r["mode"]) for r in got} == {(1, "direct"), (2, "distributed"), (3, "fallback")}
    assert len(got) == 10
    assert sorted(r["y"] for r in got if r["page"] == 1) == [100 - 10 * i - 8 for i in range(3, -1, -1)]


def test_profiles(spark):
    profile = spark.createDataFrame([(1, i, 1 if i in (0, 1, 2, 5, 6, 7, 15, 16, 17) else 0) for i in range(20)], "page int, pos int, dark int")
    got = profiles.bands(profile, ["page"], 1, 2, 3).orderBy("band").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 7), (15, 17)]
    assert profiles.rising_edges(profile, ["page"], F.col("dark") > 0, from_start=False).count() == 2
    pixels = spark.createDataFrame([(1, v) for v in [10] * 50 + [200] * 50], "page int, v int")
    assert profiles.otsu(pixels, ["page"], "v").first()["threshold"] == 10


def test_table_cells(spark):
    blocks = spark.createDataFrame([(1, 0, 0, 95, 103, "a"), (1, 1, 0, 100, 101, " "), (1, 2, 0, 110, 112, "b"), (1, 3, 0, 200, 201, "c")], "page int, ord int, row_id int, x1 int, x2 int, text string")
    bounds = spark.createDataFrame([(1, i, p) for i, p in enumerate((0, 100, 200))], "page int, i int, pos int")
    got = tables.table_cells(blocks, bounds, ["page"]).orderBy("col_id").collect()
    assert [(r["col_id"], r["text"]) for r in got] == [(0, "a"), (1, "b")]


def test_files(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("# note\n alpha \n\nbeta\nalpha\n")
    assert {r["term"] for r in files.read_terms(spark, str(tmp_path / "terms.txt")).collect()} == {"alpha", "beta"}
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.pdf").write_bytes(b"%PDF-1")
    (docs / "b.PDF").write_bytes(b"")
    (docs / "c.txt").write_bytes(b"text")
    got = {os.path.basename(r["path"]): (r["error"], r["named_pdf"]) for r in files.check_documents(spark, str(docs)).collect()}
    assert got == {"a.pdf": (None, True), "b.PDF": ("E003", True), "c.txt": ("E001", False)}
    with open(docs / "huge.pdf", "wb") as f:  # sparse, of 6 GiB
        f.write(b"%PDF")
        f.truncate(6 << 30)
    codes = lambda path, **more: sorted((os.path.basename(r["path"]), r["length"], r["error"]) for r in files.check_documents(spark, path, **more).collect())
    assert codes(str(docs / "*.pdf")) == [("a.pdf", 6, None), ("huge.pdf", 6 << 30, "E001")]
    assert codes(str(docs / "huge.pdf"), most=7 << 30) == [("huge.pdf", 6 << 30, None)]
    assert codes(str(docs), most=5, per_partition=2) == [("a.pdf", 6, "E001"), ("b.PDF", 0, "E003"), ("c.txt", 4, "E001"), ("huge.pdf", 6 << 30, "E001")]
    assert codes(str(tmp_path / "*" / "[ac].*")) == [("a.pdf", 6, None), ("c.txt", 4, "E001")]
    assert codes(f"file://{docs}/none.pdf") == [("none.pdf", None, "E002")] and codes(str(docs / "none*")) == [("none*", None, "E002")]
    assert files.check_documents(spark, str(docs), per_partition=2).rdd.getNumPartitions() == 2
    results = tmp_path / "results"
    results.mkdir()
    (results / "ocr_1.json").write_text(json.dumps([{"page_num": 1, "text": "old"}, {"page_num": 2, "text": "two"}]))
    (results / "ocr_2.json").write_text(json.dumps([{"page_num": 1, "text": "new"}, {"page_num": -1, "text": "x"}]))
    assert {r["page_num"]: r["text"] for r in files.read_pages(spark, str(results)).collect()} == {1: "new", 2: "two"}
    lines = spark.createDataFrame([('{"type": "page_error", "page": 3}',), ("no json",), ('{"type": "other"}',)], "value string")
    events = files.parse_events(lines).collect()
    assert [(e["type"], e["page"], e["recoverable"]) for e in events] == [("page_error", 3, True)]
    names = spark.createDataFrame([(1, "a:b.pdf"), (2, "a:b.pdf"), (3, "...")], "doc_id int, name string")
    assert [r["output"] for r in files.output_names(names).orderBy("doc_id").collect()] == ["a_b_OCR.pdf", "a_b_OCR(2).pdf", "output_OCR.pdf"]


def test_whole_texts(spark):
    from quirefold.plans import registry

    text = "a sentence of words that goes on " * 20
    versions = spark.createDataFrame([(1, 1, text, text)], "doc_id long, page_num int, original string, v0 string")
    got = {r["kind"]: (r["refined"], r["corrected"]) for r in registry.f07_f08_validity_whole(versions).collect()}
    assert got == {"whole": (True, True), "short": (False, False), "long": (False, False)}
    docs = spark.createDataFrame([(2, text + "{{  x")], "doc_id long, text string")
    assert registry.l05_l06_braces_spaces(docs).first()["missing"] == 2
    assert registry.f06_f16_t06_guards(docs).first()["guarded"] != registry.f06_f16_t06_guards(docs.selectExpr("doc_id", "concat(text, 'y') AS text")).first()["guarded"]
