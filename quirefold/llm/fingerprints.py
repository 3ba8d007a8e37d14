"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A text's paragraphs (its lines, cut at every sentence end, and long runs without one at words that their hash chooses) are
hashed to 64-bit digests. Each digest is added to one cell of each of three small tables; a cell holds a count and the exclusive or of its digests and of their check hashes. Subtracting the cells of
two versions leaves the digests that differ. Cells that hold one digest are peeled until nothing is left. Where a sketch is
too small for the difference, the digests are dealt into blocks by their check hash, and each block is sketched, subtracted
and peeled by itself, with more cells after each failure; a block that no size peels is compared digest by digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut

SLOTS = 8  # of each of the three tables of a sketch; powers of two up to 64
#: Digests of both versions in a block, and the slots of its tables: more after each failure.
PER_BLOCK, RETRIES = 3, (4, 8, 16, 32, 64)
ROUNDS = 7
ID_CELLS, BUCKET_ROWS = 1 << 16, 2048
#: Longer runs (code points) without a sentence end are cut after one word in RUN_WORDS, chosen by content; what has no such word for LONGEST, there.
LONG, RUN_WORDS, LONGEST = 240, 16, 960
_SPACE = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_CLOSERS = r"[\p{Pe}\p{Pf}\p{Pi}\"']*"
#: Sentence ends of other scripts (Unicode's Sentence_Terminal and the Tibetan shad), which need no white space after them.
_STOPS = (
    r"\u0589\u061D-\u061F\u06D4\u0700-\u0702\u07F9\u0837\u0839\u083D\u083E\u0964\u0965\u0F0D\u0F0E\u104A\u104B\u1362\u1367\u1368\u166E\u1735\u1736\u17D4\u17D5\u1803\u1809\u1944\u1945"
    r"\u1AA8-\u1AAB\u1B5A\u1B5B\u1B5E\u1B5F\u1C3B\u1C3C\u1C7E\u1C7F\u203C\u203D\u2047-\u2049\u2E2E\u2E3C\u3002\uA4FF\uA60E\uA60F\uA6F3\uA6F7\uA876\uA877\uA8CE\uA8CF\uA92F\uA9C8\uA9C9"
    r"\uAA5D-\uAA5F\uAAF0\uAAF1\uABEB\uFE52\uFE56\uFE57\uFF01\uFF0E\uFF1F\uFF61"
)
#: The first look spares the characters before all of these stops, most of most texts, the long class.
_SENTENCE_END = rf"([.!?\u2026]+{_CLOSERS}){_SPACE}+|((?=[\u0589-\uFF61])[{_STOPS}][{_STOPS}.!?\u2026]*{_CLOSERS}){_SPACE}*"
#: A character of a script without spaces, a word of at most 64 characters, or a character of a longer one; with the white space after it.
_SPACELESS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
_WORD = rf"[{_SPACELESS}]\s*|(?<![^\s{_SPACELESS}])[^\s{_SPACELESS}]{{1,64}}(?![^\s{_SPACELESS}])\s*|\S\s*|\s+"
_KEYS = "array<struct<n:int,key:bigint,check:bigint>>"
_DEALT = "array<struct<block:bigint,n:int,key:bigint,check:bigint>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def _runs(piece: Column) -> Column:
    """A long piece cut after the words whose hash, with that of the word before, says so; the choice moves with the words."""

    def marked(words: Column) -> Column:
        ends = lambda w, i: F.pmod(F.xxhash64(F.coalesce(F.get(words, i - 1), F.lit("")), w), F.lit(RUN_WORDS)) == 0
        return F.array_join(F.transform(words, lambda w, i: F.when(ends(w, i), F.concat(w, F.lit("\n"))).otherwise(w)), "")

    parts = F.split(_let(F.regexp_extract_all(piece, F.lit(_WORD), F.lit(0)), marked), "\n")
    return F.flatten(F.transform(parts, lambda p: F.when(F.char_length(p) <= LONGEST, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{LONGEST}}}"), F.lit(0)))))


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs with their check hashes.

    A paragraph ends at a line break and at every sentence end: stops before white space, and those of other scripts anywhere.
    What is still long is cut at word boundaries that depend on the words beside them alone, so that an edit changes the
    paragraphs around it and no others.
    """
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _SENTENCE_END, "$1$2\n"), "\n")
    pieces = _let(
        lines,
        lambda ls: F.when(F.exists(ls, lambda p: F.char_length(p) > LONG), F.flatten(F.transform(ls, lambda p: F.when(F.char_length(p) <= LONG, F.array(p)).otherwise(_runs(p))))).otherwise(ls),
    )
    pieces = F.array_remove(pieces, "")
    return F.transform(F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p))), lambda k: F.struct(F.lit(1).alias("n"), k.alias("key"), F.xxhash64(k).alias("check")))


def _slot(check: Column, place: int, slots: int) -> Column:
    """A digest's slot in a table: six bits of the check hash for each table, as many of them as the table has slots for."""
    return F.shiftrightunsigned(check, 40 + 6 * place).bitwiseAND(F.lit(slots - 1).cast("bigint"))


def _plus(a: Column, k: Column, sign: int = 1) -> Column:
    n = a["n"] + k["n"] if sign > 0 else a["n"] - k["n"]
    return F.struct(n.alias("n"), a["key"].bitwiseXOR(k["key"]).alias("key"), a["check"].bitwiseXOR(k["check"]).alias("check"))


def _zero() -> Column:
    return F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("check"))


def sketch(keys: Column, slots: int = SLOTS) -> Column:
    """The cells of all tables for keys (n: 1, or -1 for what is subtracted; key; check)."""

    def one_table(place: int) -> Column:
        def cell(i: Column) -> Column:
            return F.aggregate(F.filter(keys, lambda k: _slot(k["check"], place, slots) == i), _zero(), lambda a, k: _plus(a, k))

        return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint")), cell)

    return F.concat(*[one_table(place) for place in range(3)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _plus(x, y, -1))


def peel(cells: Column, slots: int = SLOTS) -> Column:
    """Struct of what is left in the cells and of the digests that they give up (n is 1 for the first version's, -1 for the second's)."""
    start = F.struct(cells.alias("cells"), F.array().cast(_KEYS).alias("found"), F.lit(False).alias("done"))

    def without(cells: Column, pure: Column) -> Column:
        def one_table(place: int) -> Column:
            def cell(c: Column, i: Column) -> Column:
                return F.aggregate(F.filter(pure, lambda k: _slot(k["check"], place, slots) == i), c, lambda a, k: _plus(a, k, -1))

            return F.transform(F.slice(cells, 1 + place * slots, slots), cell)

        return F.concat(*[one_table(place) for place in range(3)])

    def step(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (F.xxhash64(c["key"]) == c["check"])))

        def less(p: Column) -> Column:
            return F.when(F.size(p) == 0, F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("done"))).otherwise(
                F.struct(without(state["cells"], p).alias("cells"), F.concat(state["found"], p).alias("found"), F.lit(False).alias("done"))
            )

        return F.when(state["done"], state).otherwise(_let(pure, less))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _emptied(state: Column) -> Column:
    return F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0))


def _peeled_size(cells: Column, slots: int) -> Column:
    """The number of differing digests, or null if the sketch is too small."""
    return _let(peel(cells, slots), lambda s: F.when(_emptied(s), F.size(s["found"])))


def _block_size(keys: Column) -> Column:
    """The number of digests in which the two versions of a block differ; keys hold the first's with n = 1, the second's with n = -1, so their sketch is the difference of the two sketches."""

    def attempt(slots: int) -> Column:
        return _let(sketch(keys, slots), lambda c: _peeled_size(c, slots))

    # after all sizes the digests of the block are compared as they are
    of = lambda n: F.transform(F.filter(keys, lambda k: k["n"] == n), lambda k: k["key"])
    rest = F.size(F.array_except(of(1), of(-1))) + F.size(F.array_except(of(-1), of(1)))
    return F.coalesce(*[attempt(s) for s in RETRIES], rest)


def likenesses(pairs: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, likeness and the columns of carry for pairs (keys..., a, b: digests; cells_a, cells_b: sketches): common digests over all digests, 1 if there are none.

    First the sketches themselves are subtracted and peeled. Where they are too small, the digests are dealt into blocks.
    """
    sized = pairs.withColumn("first_try", _peeled_size(subtract(F.col("cells_a"), F.col("cells_b")), SLOTS)).drop("cells_a", "cells_b")
    sized = sized.withColumn("n_a", F.size("a")).withColumn("n_b", F.size("b"))
    blocks = F.greatest(F.ceil((F.col("n_a") + F.col("n_b")) / PER_BLOCK), F.lit(1)).cast("bigint")

    def dealt(col: str, n: int) -> Column:
        return F.transform(col, lambda k: F.struct(F.pmod(k["check"], blocks).alias("block"), F.lit(n).alias("n"), k["key"].alias("key"), k["check"].alias("check")))

    more = ["first_try", "n_a", "n_b", *carry]
    all_keys = F.when(F.col("first_try").isNull(), F.sort_array(F.concat(dealt("a", 1), dealt("b", -1)))).otherwise(F.array().cast(_DEALT))
    sized = sized.select(*keys, *more, all_keys.alias("all_keys"))
    begins = F.filter(F.transform("all_keys", lambda k, i: F.when((i == 0) | (k["block"] != F.get("all_keys", i - 1)["block"]), i)), lambda i: i.isNotNull())
    sized = sized.withColumn("begins", begins)
    cut_up = F.transform("begins", lambda i, j: F.slice("all_keys", i + 1, F.coalesce(F.get("begins", j + 1), F.size("all_keys")) - i))
    rows = sized.select(*keys, *more, F.explode_outer(cut_up).alias("block"))
    # a pair that was peeled at once has one row without a block
    sizes = rows.select(*keys, *more, F.when(F.col("block").isNull(), F.col("first_try")).otherwise(_block_size(F.col("block"))).alias("differ"))
    totals = sizes.groupBy(*keys).agg(F.sum("differ").alias("differ"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), *[F.first(c).alias(c) for c in carry])
    union = (F.col("n_a") + F.col("n_b") + F.col("differ")) / 2.0
    return totals.select(*keys, *carry, F.when(union > 0, F.greatest(F.least((union - F.col("differ")) / union, F.lit(1.0)), F.lit(0.0))).otherwise(1.0).alias("likeness"))


def fingerprint_text(keys: Column, cells: Column) -> Column:
    """The sketch as text: the number of digests, and each cell's count, digests and checks in hexadecimal."""
    hexed = F.transform(cells, lambda c: F.concat(F.hex(c["n"].cast("long")), F.lit("."), F.lower(F.hex(c["key"])), F.lit("."), F.lower(F.hex(c["check"]))))
    return F.concat_ws(":", F.size(keys).cast("string"), F.array_join(hexed, ":"))


def with_next(docs: DataFrame, id_cells: int = ID_CELLS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (bucket, row_number, doc_id, text, own, own_cells, following) with the same of each document's next one by descending doc_id; after the last comes the first.

    Ids are dealt into buckets of neighbours by a histogram of at most id_cells cells; each bucket gets the first row of the
    next one as well, so texts are moved once. Rows of one id go by text; null ids come last.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    cell = F.coalesce(F.floor((F.col("doc_id").cast("double") - float(low)) / (float(high - low) + 1.0) * id_cells).cast("int"), F.lit(-1))
    w = Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.select(cell.alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))  # id_cells + 1 rows at most
    cells = cut(cells.select("cell", F.floor(F.coalesce(F.sum("n").over(w), F.lit(0)) / bucket_rows).cast("long").alias("bucket")))
    placed = rows.withColumn("cell", cell).join(F.broadcast(cells), "cell").drop("cell")
    firsts = placed.groupBy("bucket").agg(F.max("doc_id").alias("first_id"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket"))
    firsts = cut(firsts.select("first_id", F.coalesce(F.lag("bucket").over(order), F.min("bucket").over(Window.partitionBy(F.lit(0)))).alias("for_bucket")))
    halo = placed.drop("bucket").join(bounded_broadcast(firsts, firsts.count()), F.col("doc_id").eqNullSafe(F.col("first_id")))
    halo = halo.groupBy(F.col("for_bucket").alias("bucket")).agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text")).select("doc_id", "text", "bucket")
    both = placed.withColumn("halo", F.lit(0)).unionByName(halo.withColumn("halo", F.lit(1)))
    # the digests are made after the shuffle and before the window, once for each text
    dealt = both.repartition("bucket").select("*", digests(F.col("text")).alias("own"))
    dealt = dealt.select("*", sketch(F.col("own")).alias("own_cells"))
    own = Window.partitionBy("bucket").orderBy("halo", F.col("doc_id").desc_nulls_last(), "text")
    following = F.lead(F.struct("text", "own", "own_cells")).over(own)
    return dealt.select("bucket", F.row_number().over(own).alias("row_number"), "halo", "doc_id", "text", "own", "own_cells", following.alias("following")).where("halo = 0").drop("halo")


def fingerprints(docs: DataFrame, **parameters) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third (floor of its code points) replaced by as many first code points of the next document
    by descending doc_id, or by all of it. Null texts count as empty; an empty text has no digests, and two such texts are
    alike (1). Repeated rows follow each other as documents of their own; other columns are ignored.
    """
    rows = with_next(docs, **parameters)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.select("bucket", "row_number", "doc_id", n.cast("long").alias("n_chars"), F.concat(F.substr("text", F.lit(1), n - third), F.substr("following.text", F.lit(1), third)).alias("edited"), "own", "own_cells", F.col("following.own").alias("other"), F.col("following.own_cells").alias("other_cells"))
    keyed = rows.select("*", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests(F.col("edited")).alias("changed")).drop("edited")
    drawn = keyed.select("*", sketch(F.col("changed")).alias("changed_cells"))
    told = F.struct("doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("own"), F.col("own_cells")).alias("fingerprint"), fingerprint_text(F.col("changed"), F.col("changed_cells")).alias("edited_fingerprint"))
    two = F.array(
        F.struct(F.lit(0).alias("which"), F.col("own").alias("a"), F.col("changed").alias("b"), F.col("own_cells").alias("cells_a"), F.col("changed_cells").alias("cells_b")),
        F.struct(F.lit(1).alias("which"), F.col("own").alias("a"), F.col("other").alias("b"), F.col("own_cells").alias("cells_a"), F.col("other_cells").alias("cells_b")),
        # a row that only carries the texts, so that they aren't repeated for each block
        F.struct(F.lit(2).alias("which"), F.array().cast(_KEYS).alias("a"), F.array().cast(_KEYS).alias("b"), F.slice("own_cells", 1, 0).alias("cells_a"), F.slice("own_cells", 1, 0).alias("cells_b")),
    )
    keys = ["bucket", "row_number"]
    drawn = drawn.select(*keys, told.alias("told"), two.alias("pairs"))
    pairs = drawn.select(*keys, "told", F.explode_outer("pairs").alias("pair")).select(*keys, F.when(F.col("pair.which") == 2, F.col("told")).alias("told"), "pair.*")
    near = likenesses(pairs, [*keys, "which"], ("told",))
    # everything is still partitioned by bucket, so these groups need no shuffle
    rows = near.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("likeness"))).alias("near_edited"), F.max(F.when(F.col("which") == 1, F.col("likeness"))).alias("near_next"), F.first("told", ignorenulls=True).alias("told"))
    return rows.select("told.*", "near_edited", "near_next")
