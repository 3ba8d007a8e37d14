from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import pages

BOX = "page int, ord long, block_type string, x1 long, y1 long, x2 long, y2 long, text string"


def test_scans_take_the_first_mode_with_enough(spark):
    rows = [(1, 6, i, 50, "a", 9, 9) for i in range(4)] + [(1, 11, i, 50, "b", 9, 9) for i in range(5)] + [(2, 6, 0, 50, "a", 9, 9), (2, 3, 1, 50, "c", 9, 4), (2, 3, 2, 50, "d", 9, 9), (3, 6, 0, 50, None, 9, 9)]
    words = spark.createDataFrame(rows, "page int, psm int, ord long, conf int, text string, w int, h int")
    assert sorted((r.page, r.psm, r.text) for r in pages.word_scan(words, ["page"]).collect()) == [(1, 11, "b")] * 5 + [(2, 3, "d")]
    assert pages.word_scan(words, ["page"], smallest=3).where("page = 2").count() == 2
    assert pages.word_scan(words.limit(0), ["page"]).count() == 0


def test_regions_fall_back_only_on_pages_without_boxes(spark):
    boxes = spark.createDataFrame([(1, 0, 5, 40, 45), (1, 50, 0, 990, 200), (2, 0, 0, 1, 1)], "page int, x long, y long, x2 long, y2 long")
    words = spark.createDataFrame([(p, 0, 10, 10, 30, 20, 20, 10, 90, "w") for p in (1, 2, 3)], "page int, ord long, x long, y long, x2 long, y2 long, w long, h long, conf int, text string")
    got = sorted((r.page, r.reading, r.x, r.y, r.x2, r.y2, r.confidence) for r in pages.detected_regions(boxes, ["page"], 1000, 1000, words).collect())
    assert got == [(1, 1, 30, 0, 1000, 220, 1.0), (1, 2, 0, 1, 44, 49, 1.0), (3, 1, 10, 10, 30, 20, 0.8)]


def test_failed_and_missing_pages_keep_their_place(spark):
    results = spark.createDataFrame([(1, "a", None), (2, "b", "broken"), (3, None, None)], "page int, text string, error string")
    got = pages.skip_failed(spark.range(1, 5).select(F.col("id").cast("int").alias("page")), results, ["page"]).orderBy("page").collect()
    assert [(r.page, r.text, r.error) for r in got] == [(1, "a", None), (2, "", "broken"), (3, "", None), (4, "", "no result")]


def test_refined_texts_keep_overlaps_and_failed_chunks(spark):
    long = " ".join(f"This is sentence number {i} of a text that has to be cut." for i in range(90))
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, "")], "id int, text string")
    fail_first = lambda c: F.when(~c.contains("number 0 "), F.replace(c, F.lit("sentence"), F.lit("SENTENCE")))
    got = {r.id: r.out for r in docs.select("id", pages.refined(F.col("text"), fail_first, "{text}").alias("out")).collect()}
    parts = docs.where("id = 1").select(T.chunks(F.col("text")).alias("c")).first().c
    assert len(parts) > 1
    assert got == {1: "\n".join(p if "number 0 " in p else p.replace("sentence", "SENTENCE") for p in parts), 2: "short", 3: None, 4: ""}


def test_blocks_and_table_rows_are_placed(spark):
    blocks = spark.createDataFrame(
        [(1, 0, "text", 0, 0, 999, 999, " a \n\nb"), (1, 1, "table_cell", 500, 100, 600, 110, "y"), (1, 2, "table_cell", 0, 102, 100, 112, "x"), (1, 3, None, 0, 0, 10, 10, ""), (1, 4, "table_row", 0, 500, 9, 510, " ")], BOX
    )
    got = sorted((r.part, r.number, r.i, r.line, round(r.font, 3), round(r.baseline, 3)) for r in pages.place_blocks(blocks, ["page"], 999.0, 999.0, clean=F.trim).collect())
    size = lambda top, h, n, i: round(999 - top - (i + 0.5) * h / n - min(48, h / n) * 0.266, 3)
    assert got == [(0, 0, 0, "a", 48.0, size(0, 999, 2, 0)), (0, 0, 1, "b", 48.0, size(0, 999, 2, 1)), (1, 0, 0, "x\ty", 12.0, size(100, 12, 1, 0))]
    assert "line" not in pages.without_text(pages.place_blocks(blocks, ["page"], 9.0, 9.0)).columns


def test_pace_guards_its_divisions(spark):
    events = spark.createDataFrame([(1, 0, 0, 10), (1, 20, 4, 10), (1, 50, 10, 10), (2, 5, 0, 0)], "job_id int, s int, current int, total int").withColumn("ts", F.timestamp_seconds("s"))
    got = pages.job_pace(events).orderBy("job_id", "s").collect()
    assert [(r.seconds_per_page, r.remaining, r.pages_per_minute) for r in got] == [(0, 0, 0), (5, 30, 30), (5, 0, 12), (0, 0, 0)]
