"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A line here is a piece of text up to a line break or the end of a sentence. The hashes of two lines in a row are winnowed: in
every window of `width` lines the least of them is the fingerprint. A run of `width` or more lines that two places share always
shares a fingerprint, so the positions of fingerprints that occur again are joined, and their matches extended window by window
both ways: the maximal repeats are the unions of the windows of equal content that occurred earlier. One or two lines that hold
FLOOR words or more are windows as well, each its own fingerprint, so that a long passage of few lines isn't missed. Later
repeats are deleted; what occurs first in the order of doc_id and line stays.

Lines are hashed once; what is shuffled are fingerprints, window contents and places, as fixed-width numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_broadcast, cut

WIDTH, GRAM = 3, 2
_FIRST = -(2**63)  # in place of a null id
FLOOR = 50  # words from which fewer lines than WIDTH are a window; a character of a script without spaces counts as a word
# these scripts begin at U+0E00; the range is looked at first, since a script is searched for anew in every character
_SPACELESS = r"[\x{E00}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]]"
_PIECE = r"[^.!?\n]+[.!?\n]*\s*|[.!?\n]+\s*"


def lines_of(text: Column) -> Column:
    """The lines of a text, with what ends them; joined they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECE), F.lit(0))


def _single_spaced(line: Column) -> Column:
    """A line without outer white space, and with single spaces inside; the pattern runs only where there is something to replace."""
    odd = line.contains("  ")
    for c in "\n\t\r\f\x0b":
        odd = odd | line.contains(c)
    return F.trim(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line))


def _spaced_lines(text: Column, lines: Column) -> Column:
    """_single_spaced() of all lines of a text. What hardly a text has is looked for once in the text; without it only line breaks are to be replaced."""
    rare = F.coalesce(text.contains("  "), F.lit(False))
    for c in "\t\r\f\x0b":
        rare = rare | F.coalesce(text.contains(c), F.lit(False))
    broken = lambda line: F.trim(F.when(line.contains("\n"), F.regexp_replace(line, r"\s+", " ")).otherwise(line))
    return F.when(rare, F.transform(lines, _single_spaced)).otherwise(F.transform(lines, broken))


def _words(line: Column) -> Column:
    """Words of a line with single spaces. A character of a script without spaces has three bytes at least."""
    spaced = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return F.when(F.octet_length(line) - F.char_length(line) < 2, spaced).otherwise(spaced + F.regexp_count(line, F.lit(_SPACELESS)))


def _hashed(docs: DataFrame, width: int, floor: int) -> DataFrame:
    """(doc_id, text_hash, hashes, few): the line hashes of each row, and the windows (start from 1, width) of fewer lines than width that hold floor words."""
    lines = _spaced_lines(F.col("text"), lines_of(F.col("text")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), lines.alias("lines"))
    # two plain arrays: a field of an array of structs would be taken out anew for every element below
    rows = rows.select("doc_id", "text_hash", F.transform("lines", lambda p: F.xxhash64(F.lower(p))).alias("hashes"), F.transform("lines", _words).alias("words"))

    def few(w: int) -> Column:
        held = lambda i: sum((F.get("words", i + j) for j in range(1, w)), F.get("words", i))
        return F.filter(F.transform("words", lambda _, i: F.when(held(i) >= floor, F.struct((i + 1).alias("start"), F.lit(w).alias("width")))), lambda x: x.isNotNull())

    found = F.array().cast("array<struct<start:int,width:int>>")
    if width > 1:
        # of fewer lines than width that hold floor words, one holds its share
        found = F.when(F.array_max("words") * (width - 1) >= floor, F.concat(*[few(w) for w in range(1, width)])).otherwise(found)
    return rows.select("doc_id", "text_hash", "hashes", found.alias("few"))


def repeated_lines(rows: DataFrame, width: int = WIDTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_hash, starts): the windows (start from 1, width) of _hashed() rows that occurred earlier, for documents that have any.

    Earlier is a smaller doc_id (null first), then a smaller text_hash, then a smaller start. Each row is another place.
    """
    gram = min(GRAM, width)
    inside = width - gram + 1
    n = F.size("hashes")
    grams = F.transform(F.slice("hashes", 1, F.greatest(n - gram + 1, F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get("hashes", i + j) for j in range(1, gram)]))
    rows = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc"), "text_hash", "hashes", "few", grams.alias("grams"))
    starts = F.slice("hashes", 1, F.greatest(n - width + 1, F.lit(0)))
    at = lambda i: [F.get("grams", i + j) for j in range(inside)]
    minimum = lambda i: F.least(*at(i)) if inside > 1 else at(i)[0]
    # where in its window the minimum is
    place = lambda i: F.coalesce(*[F.when(g == minimum(i), i + j) for j, g in enumerate(at(i))])
    picks = F.transform(starts, lambda _, i: F.when((i == 0) | (place(i) != place(i - 1)), minimum(i)))
    again = rows.select(F.explode_outer(picks).alias("fingerprint")).where("fingerprint IS NOT NULL").groupBy("fingerprint").count().where("count > 1").select("fingerprint")
    again = cut(again)
    whole = lambda i, w: F.struct((i + 1).alias("start"), F.lit(width).alias("width"), F.xxhash64(F.slice("hashes", i + 1, w)).alias("content"))
    every = rows.select("doc", "text_hash", F.explode_outer(F.transform(starts, lambda _, i: F.struct(minimum(i).alias("fingerprint"), whole(i, width).alias("window")))).alias("x")).where("x IS NOT NULL").select("doc", "text_hash", "x.*")
    every = every.join(bounded_broadcast(again, again.count(), broadcast_rows), "fingerprint", "left_semi").select("doc", "text_hash", "window.*")
    short = rows.where(F.size("few") > 0).select("doc", "text_hash", "hashes", F.explode("few").alias("few")).select("doc", "text_hash", "few.*", F.xxhash64(F.slice("hashes", F.col("few.start"), F.col("few.width"))).alias("content"))
    # read twice: to count their contents and to find those that occur again
    windows = cut(every.unionByName(short))
    # the least id by partial aggregation: a hot window moves one row a task
    first = cut(windows.groupBy("content").agg(F.min("doc").alias("first_doc"), F.count("*").alias("n")).where("n > 1").select("content", "first_doc"))
    found = windows.join(bounded_broadcast(first, first.count(), broadcast_rows), "content").select("doc", "text_hash", "content", "start", "width", (F.col("doc") > F.col("first_doc")).alias("later"))
    several = cut(rows.groupBy("doc").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low != high").select("doc"))
    if not several.isEmpty():
        # texts of one id: the smaller text_hash is the earlier one
        of_id = found.join(several, "doc", "left_semi").groupBy("doc", "content").agg(F.min("text_hash").alias("first_hash"))
        found = found.join(of_id, ["doc", "content"], "left").withColumn("later", F.col("later") | F.coalesce(F.col("text_hash") > F.col("first_hash"), F.lit(False))).drop("first_hash")
    # within a text, all but the first of equal windows; a document's own windows are what is gathered here
    own = found.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_list(F.struct("content", "start", "width", "later"))).alias("w"))
    starts = F.transform("w", lambda x, i: F.when(x["later"] | ((i > 0) & (x["content"] == F.get("w", i - 1)["content"])), F.struct(x["start"].alias("start"), x["width"].alias("width"))))
    return own.select("doc", "text_hash", F.filter(starts, lambda x: x.isNotNull()).alias("starts")).where(F.size("starts") > 0)


def line_dedup(docs: DataFrame, width: int = WIDTH, floor: int = FLOOR, **parameters) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_deleted, runs (deleted runs: start, length), text (without them).

    A line is compared without its outer and repeated white space, in lower case, and by its 64-bit hash. Texts of fewer than
    width lines and floor words stay as they are; a null text has no lines and stays null, an empty one stays empty. A
    repeated row (same doc_id and text) is the same place as its twin, so twins don't delete each other's lines and are
    treated alike. Null ids come first. Other columns are ignored; an empty table gives an empty result.
    """
    rows = cut(_hashed(docs, width, floor))
    twins = cut(rows.groupBy("doc_id", "text_hash").count().where("count > 1").drop("count"))
    if not twins.isEmpty():
        twin = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(0)))
        same = [rows[c].eqNullSafe(twins[c]) for c in ("doc_id", "text_hash")]
        rows = cut(rows.join(twins, same, "left_anti").unionByName(rows.join(twins, same, "left_semi").withColumn("twin", twin).where("twin = 1").drop("twin")))
    later = repeated_lines(rows, width, **parameters)
    facts = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("of"), F.col("text_hash").alias("of_hash"), F.size("hashes").alias("n_lines"))
    facts = facts.join(later, (F.col("of") == F.col("doc")) & (F.col("of_hash") == F.col("text_hash")), "left").select("of", "of_hash", "n_lines", "starts")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = rows.join(facts, (F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)) == F.col("of")) & (F.col("text_hash") == F.col("of_hash")))
    # only texts that lose lines are taken apart again
    lines = rows.select("doc_id", "text", "n_lines", "starts", F.when(F.col("starts").isNotNull(), lines_of(F.col("text"))).alias("lines"))
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["start"], s["start"] + s["width"] - 1)))))
    lines = lines.withColumn("gone", F.coalesce(gone, F.array().cast("array<int>")))
    # of a sorted list of line numbers, those that don't follow their predecessor begin a run
    begins = F.filter(F.transform("gone", lambda g, i: F.when((i == 0) | (g != F.get("gone", i - 1) + 1), i)), lambda i: i.isNotNull())
    lines = lines.withColumn("begins", begins)
    runs = F.transform("begins", lambda b, j: F.struct(F.get("gone", b).alias("start"), (F.coalesce(F.get("begins", j + 1), F.size("gone")) - b).alias("length")))
    lines = lines.withColumn("runs", runs)
    # the kept lines are what lies between the runs
    bounds = F.concat(F.transform("runs", lambda r: r["start"]), F.array(F.size("lines") + 1))
    after = F.concat(F.array(F.lit(1)), F.transform("runs", lambda r: r["start"] + r["length"]))
    kept = F.array_join(F.flatten(F.transform(F.arrays_zip(after.alias("from"), bounds.alias("to")), lambda z: F.slice("lines", z["from"], z["to"] - z["from"]))), "")
    return lines.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_deleted"),
        "runs",
        F.when(F.size("gone") == 0, F.col("text")).otherwise(kept).alias("text"),
    )
