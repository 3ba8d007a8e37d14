"""Files in and out: dictionaries, page results, events, documents to check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .heads import DocumentHeads

BLOCK = "struct<text:string,bbox_norm:array<double>,size:string,char_height:int>"
LINE = "struct<x:int,y:int,x2:int,y2:int,text:string>"
PAGE = f"page_num int, text string, error string, block_results array<{BLOCK}>, line_positions array<{LINE}>"
EVENT = (
    "type string, timestamp string, model_name string, model_loaded boolean, total_pages int, current_page int, percent double, status string, memory_mb double, num_workers int, "
    "worker_progress array<struct<worker_id:int,completed:int,total:int>>, downloaded_mb double, total_mb double, output_path string, elapsed_seconds double, current_part int, total_parts int, "
    "start_page int, end_page int, parts array<string>, level string, message string, code string, details string, recoverable boolean, page int"
)
#: Words of status lines that speak of models.
MODEL_WORDS = ("fetching", "downloading", "model", "tokenizer", "loading", r"config\.json")
EVENT_TYPES = ("init", "progress", "download", "complete", "split_progress", "split_complete", "log", "error", "page_error")


def read_terms(spark: SparkSession, *paths: str) -> DataFrame:
    """The terms of text files, one a line, without blank lines and lines from #."""
    lines = spark.read.text(list(paths)).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("term"))
    return lines.where("term != '' AND NOT startswith(term, '#')").distinct()


def check_documents(spark: SparkSession, path: str, most: int = 5 << 30, per_partition: int = 10_000) -> DataFrame:
    """(path, length, named_pdf, error) for each file of a folder, pattern or file: too large, unreadable or no PDF header E001, empty E003, else null; E002 for a path without files.

    Of a file the first four bytes are read, whatever its size, in tasks of at most per_partition files; folders are not entered.
    """
    spark.dataSource.register(DocumentHeads)
    return spark.read.format("document_heads").option("most", most).option("per_partition", per_partition).load(path)


def write_pages(pages: DataFrame, path: str, by: str = "worker") -> None:
    """Page results as JSON, by worker."""
    pages.write.mode("overwrite").partitionBy(by).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page results of all files of JSON arrays or lines; of a page that several files have, the last file's last row counts."""
    rows = spark.read.schema(PAGE).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).select("*", F.col("_metadata.file_name").alias("_file"))
    w = Window.partitionBy("page_num").orderBy(F.desc("_file"), F.desc(F.col("text").isNotNull()), F.desc("text"))
    return rows.where("page_num >= 0").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_file")


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of JSON lines; other lines, and events of unknown types, go. Works on streams too."""
    events = lines.select(F.from_json(column, EVENT).alias("e")).select("e.*")
    return events.where(F.col("type").isin(*EVENT_TYPES)).withColumn("recoverable", F.when(F.col("type") == "page_error", True).otherwise(F.col("recoverable")))


def parse_status_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of a stream that mixes JSON with plain text: other lines that speak of models become events of the type modelSetup with the line as message, the rest go. Works on streams too."""
    parsed = lines.select(F.col(column).alias("_line"), F.try_variant_get(F.try_parse_json(column), "$.type", "string").alias("_type"), F.from_json(column, EVENT).alias("e"))
    plain = F.try_parse_json("_line").isNull()
    speaks = F.lower("_line").rlike("|".join(MODEL_WORDS))
    kept = parsed.where((F.trim("_line") != "") & (F.when(plain, speaks).otherwise(F.coalesce(F.col("_type").isin(*EVENT_TYPES), F.lit(False)))))
    fields = [F.when(plain, {"type": F.lit("modelSetup"), "message": F.col("_line")}.get(c, F.lit(None))).otherwise(F.col(f"e.{c}")).alias(c) for c in T.StructType.fromDDL(EVENT).names]
    return kept.select(*fields).withColumn("recoverable", F.when(F.col("type") == "page_error", True).otherwise(F.col("recoverable")))


def event_lines(events: DataFrame) -> DataFrame:
    """Events as JSON lines, without their null fields."""
    return events.select(F.to_json(F.struct("*")).alias("value"))


def write_volumes(pages: DataFrame, path: str) -> None:
    """A folder a volume; pages have a column part."""
    pages.write.mode("overwrite").partitionBy("part").parquet(path)


def output_names(docs: DataFrame, name: str = "name", suffix: str = "_OCR") -> DataFrame:
    """A safe name with the suffix, and a number from the second file of a name on."""
    from ..functions.text import safe_name

    rows = docs.withColumn("_base", F.concat(safe_name(F.regexp_replace(name, r"\.[^.]*$", "")), F.lit(suffix)))
    w = Window.partitionBy("_base").orderBy("doc_id")
    return rows.withColumn("_n", F.row_number().over(w)).withColumn("output", F.concat("_base", F.when(F.col("_n") > 1, F.format_string("(%d)", "_n")).otherwise(""), F.lit(".pdf"))).drop("_base", "_n")
