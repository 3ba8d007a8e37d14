"""Repair of conversations whose turns don't follow the grammar `(s?(ua)+)?` over role initials, by the cheapest edits.

Edits are Keep (0), Rerole to user or assistant (2), Delete (3; required for blank and repeated turns) and Insert of an empty
user or assistant turn (2); a truncated turn that isn't deleted adds 1. A backward pass computes the cost to go for every turn
and grammar state. A forward walk then takes, of the transitions that keep to that cost, the one whose initial is least in ASCII.

A conversation may have any number of turns. All turns are sorted over the cluster, equal ones counted into one row, and cut
into blocks of bounded size that end wherever a task or batch does. A block is a matrix of costs from state to state, so
the costs to go at the ends of a long conversation's blocks follow from small numbers a block, and its start states from where
its blocks lead from each state; then every block is walked by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a. In each, one letter that an insertion or a rerole can give.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = "uuau"
AFTER = tuple(STEP[s, x] for s, x in enumerate(WANTED))
#: Cost to go after the last turn: the insertions up to an accepting state.
AT_END = (0, 2 * INSERT, INSERT, 0)
LEGAL = ("su", "ua", "au")
NEVER = 1 << 60
#: Rows of a block at most, and about its characters.
ROWS, CHARS = 1024, 1 << 20
SPACES = " \t\n\x0b\x0c\r"
FINE, CUT_OFF, BLANK, REPEATED = range(4)
BLOCKS = "conv_id long, part int, block int, turns array<long>, roles array<string>, texts array<string>, counts array<long>, faults array<int>"
REPAIRED = (
    "conv_id long, part int, block int, audit string, cost long, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, "
    "first_initial string, last_initial string, first_turn long, last_turn long, turns long"
)
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the damage that crc32(`conv_id:turn`) % 20 deals; nulls count as one space.

    0 drops a row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes it a user's.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    rows = rows.where("kind <> 0").withColumn("times", F.when(F.col("kind") == 3, 2).otherwise(1))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy"))
    return rows.drop("copy")


def _digest_of(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def sorted_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, fault): equal rows as one with their number, in the order of conversations over all partitions.

    fault is that of the first of the n rows; the others are repeats. Order: turn, nulls first, then role and text by their
    first 64 characters and a digest, so that what Spark samples to cut the order into partitions is small.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = rows.groupBy("conv_id", _digest_of(F.col("role"), F.col("text")).alias("digest")).agg(F.min(at).alias("first"), F.count("*").alias("times"))
    seen = cut(seen.where("times > 1").select(F.col("conv_id").alias("of"), F.col("digest").alias("seen"), F.col("first.turn").alias("first_turn"), F.lit(True).alias("again")))
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    fault = F.when(last == "", BLANK).when(F.col("again") & ~F.col("turn").eqNullSafe(F.col("first_turn")), REPEATED).when(last.isin(".", "!", "?"), FINE).otherwise(CUT_OFF)
    turns = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", _digest_of(F.col("role"), F.col("text")))
    turns = turns.join(bounded_broadcast(seen, seen.count()), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("seen")), "left")
    turns = turns.withColumn("fault", F.coalesce(fault, F.lit(CUT_OFF)).cast("int"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.substring("text", 1, 64), "digest"]
    return turns.orderBy(*order).select("conv_id", "turn", "role", "text", "n", "fault")


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    part, block = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0)
        ids, missing = pc.fill_null(conv, 0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
        chars = np.cumsum(pc.utf8_length(batch.column(3)).to_numpy().astype(np.int64)) // CHARS
        new = np.r_[True, (ids[1:] != ids[:-1]) | (missing[1:] != missing[:-1])]
        place = np.arange(len(ids))
        new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % rows == 0
        new |= np.r_[True, chars[1:] != chars[:-1]]
        starts = np.flatnonzero(new)
        offsets = pa.array(np.r_[starts, len(ids)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, batch.column(i)) for i in range(1, 6)]
        numbers = pa.array(np.arange(block, block + len(starts), dtype=np.int32))
        block += len(starts)
        yield pa.RecordBatch.from_arrays([conv.take(pa.array(starts)), pa.array(np.full(len(starts), part, np.int32)), numbers, *lists], names=["conv_id", "part", "block", "turns", "roles", "texts", "counts", "faults"])


def step(after: tuple[int, ...], initial: str, truncated: int) -> tuple[int, ...]:
    """Cost to go by state before a turn that may be kept, from that after it, with insertions before the turn."""
    w = []
    for s in range(4):
        best = min(DELETE + after[s], REROLE + truncated + after[AFTER[s]])
        kept = STEP.get((s, initial))
        w.append(best if kept is None else min(best, KEEP + truncated + after[kept]))
    w[2], w[3] = min(w[2], INSERT + w[3]), min(w[3], INSERT + w[2])
    return min(w[0], INSERT + w[2]), min(w[1], INSERT + w[2]), w[2], w[3]


def costs_to_go(initials: list[str], counts: list[int], faults: list[int], after: tuple[int, ...]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """For each row, from the last to the first: costs to go before it, and after its first turn but before the repeats of it."""
    out = []
    for x, n, fault in zip(reversed(initials), reversed(counts), reversed(faults), strict=True):
        forced = DELETE * (n - (fault < BLANK))
        middle = tuple(min(NEVER, v + forced) for v in after)
        after = step(middle, x, TRUNCATED * (fault == CUT_OFF)) if fault < BLANK else middle
        out.append((after, middle))
    return out


def walk(initials: list[str], counts: list[int], faults: list[int], togo: tuple[int, ...], state: int, last: bool) -> tuple[str, list[tuple[int, str]], int, int]:
    """The edits of a block from a state: their initials, the turns that stay as (row or -1, letter given or ''), the cost and the state after.

    togo are the costs to go after the block; last: the conversation ends there.
    """
    costs = costs_to_go(initials, counts, faults, togo)
    begin = costs[-1][0][state] if costs else togo[state]
    audit, turns = [], []
    for i, (x, n, fault) in enumerate(zip(initials, counts, faults, strict=True)):
        before, after = costs[len(costs) - 1 - i]
        if fault < BLANK:
            extra = TRUNCATED * (fault == CUT_OFF)
            while before[state] != DELETE + after[state] and before[state] == INSERT + before[AFTER[state]]:
                audit.append("I")
                turns.append((-1, WANTED[state]))
                state = AFTER[state]
            if before[state] == DELETE + after[state]:
                audit.append("D")
            elif (kept := STEP.get((state, x))) is not None and before[state] == KEEP + extra + after[kept]:
                audit.append("K")
                turns.append((i, ""))
                state = kept
            else:
                audit.append("R")
                turns.append((i, WANTED[state]))
                state = AFTER[state]
        audit.append("D" * (n - (fault < BLANK)))
    while last and AT_END[state]:
        audit.append("I")
        turns.append((-1, WANTED[state]))
        state = AFTER[state]
    return "".join(audit), turns, begin - (0 if last else togo[state]), state


def _light(batch: pa.RecordBatch) -> Iterator[tuple]:
    for conv, part, block, initials, counts, faults, *more in zip(*[c.to_pylist() for c in batch.columns], strict=True):
        yield conv, part, block, initials, counts, faults, *more


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


_KEY = [("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32())]


def _batch(rows: list[tuple], more: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return _rows(rows, [n for n, _ in _KEY + more], [t for _, t in _KEY + more])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, part, block, initials, counts, faults in _light(batch):
            ends = [costs_to_go(initials, counts, faults, tuple(0 if s == e else NEVER for s in range(4)))[-1][0] for e in range(4)]
            out.append((conv, part, block, [ends[e][s] for s in range(4) for e in range(4)]))
        yield _batch(out, [("matrix", pa.list_(pa.int64()))])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each conversation from the last to the first: the costs to go after each."""
    key, togo = (), AT_END
    for batch in batches:
        out = []
        for conv, part, block, matrix in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            last = key != (conv,)
            if last:
                key, togo = (conv,), AT_END
            out.append((conv, part, block, list(togo), last))
            togo = tuple(min(min(NEVER, matrix[4 * s + e] + togo[e]) for e in range(4)) for s in range(4))
        yield _batch(out, [("togo", pa.list_(pa.int64())), ("last", pa.bool_())])


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, part, block, initials, counts, faults, togo, last in _light(batch):
            leads = [walk(initials, counts, faults, tuple(togo), s, last)[3] for s in range(4)]
            out.append((conv, part, block, leads, togo, last))
        yield _batch(out, [("leads", pa.list_(pa.int32())), ("togo", pa.list_(pa.int64())), ("last", pa.bool_())])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each conversation from the first to the last: the state in which each begins."""
    key, state = (), 0
    for batch in batches:
        out = []
        for conv, part, block, leads, togo, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != (conv,):
                key, state = (conv,), 0
            out.append((conv, part, block, state, togo, last))
            state = leads[state]
        yield _batch(out, [("start", pa.int32()), ("togo", pa.list_(pa.int64())), ("last", pa.bool_())])


def _ends_of_blocks(blocks: DataFrame) -> DataFrame:
    """(part, block, start, togo, last) for the blocks of conversations that have more than one."""
    many = blocks.groupBy(F.col("conv_id").alias("of")).agg(F.count("*").alias("blocks")).where("blocks > 1")
    initials = F.transform("roles", lambda r: F.left(r, F.lit(1)))
    light = cut(blocks.join(many, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi").select("conv_id", "part", "block", initials.alias("initials"), "counts", "faults"))
    key = "conv_id long, part int, block int"
    matrices = light.mapInArrow(_matrices, f"{key}, matrix array<long>").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block"))
    togo = matrices.mapInArrow(_backward, f"{key}, togo array<long>, last boolean").drop("conv_id")
    leads = light.join(togo, ["part", "block"]).select("conv_id", "part", "block", "initials", "counts", "faults", "togo", "last")
    leads = leads.mapInArrow(_leads, f"{key}, leads array<int>, togo array<long>, last boolean").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return cut(leads.mapInArrow(_forward, f"{key}, start int, togo array<long>, last boolean").drop("conv_id"))


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    more = [("audit", pa.string()), ("cost", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), *((x, pa.int64()) for x in ("blank", "duplicate", "truncated", "illegal"))]
    more += [("first_initial", pa.string()), ("last_initial", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64())]
    for batch in batches:
        out, chars = [], 0
        for conv, part, block, turns, roles, texts, counts, faults, start, togo, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            initials = [r[:1] for r in roles]
            audit, kept, cost, _ = walk(initials, counts, faults, tuple(togo), start, last)
            extra = sum(n - 1 for n in counts)
            illegal = extra + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            blank = sum(n for n, f in zip(counts, faults, strict=True) if f == BLANK)
            repeats = sum(n - (f != REPEATED) for n, f in zip(counts, faults, strict=True) if f != BLANK)
            known = sorted({t for t in turns if t is not None})
            new_roles = [ROLES[x] if x else roles[i] for i, x in kept]
            new_texts = [texts[i] if i >= 0 else "" for i, _ in kept]
            out.append((conv, part, block, audit, cost, new_roles, new_texts, blank, repeats, faults.count(CUT_OFF), illegal, initials[0], initials[-1], known[0] if known else None, known[-1] if known else None, len(known)))
            chars += sum(map(len, new_texts))
            if chars > CHARS:
                yield _batch(out, more)
                out, chars = [], 0
        if out:
            yield _batch(out, more)


def repair(conversations: DataFrame, block: int = ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Repaired blocks (REPAIRED), of the conversations that are one block, and of those that are more (None if there are none).

    A conversation's turns after repair are the roles and texts of its blocks by (part, block), its audit their audits joined.
    Null roles and texts count as one space; rows with a null conv_id are one conversation, null turns come first; ties go by
    role and text; repeated rows are turns of their own. Other columns are ignored.
    """
    blocks = cut(sorted_turns(conversations).mapInArrow(partial(_blocks, rows=block), BLOCKS))
    ends = _ends_of_blocks(blocks)
    columns = ["conv_id", "part", "block", "turns", "roles", "texts", "counts", "faults", "start", "togo", "last"]
    n = ends.count()
    ends = bounded_broadcast(ends, n)
    alone = blocks.join(ends.select("part", "block"), ["part", "block"], "left_anti") if n else blocks
    alone = alone.select(*columns[:8], F.lit(0).alias("start"), F.array(*[F.lit(x).cast("long") for x in AT_END]).alias("togo"), F.lit(True).alias("last")).mapInArrow(_repair, REPAIRED)
    return alone, blocks.join(ends, ["part", "block"]).select(*columns).mapInArrow(_repair, REPAIRED) if n else None


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [pa.int64(), *[pa.int64()] * 6, pa.string(), pa.string()]
    key, rows, held = (), [], 0
    state: dict = {}

    def close() -> None:
        if key:
            gaps = state["high"] - state["low"] + 1 - state["turns"] if state["low"] is not None else 0
            rows.append((*key, min(gaps, (1 << 63) - 1), *state["sums"], "".join(state["audit"]), state["sha"].hexdigest()))

    for batch in batches:
        for conv, _, _, audit, cost, roles, texts, blank, repeats, truncated, illegal, first, last, low, high, turns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != (conv,):
                close()
                key, state = (conv,), {"sums": [0] * 5, "audit": [], "sha": hashlib.sha256(), "any": False, "before": None, "low": None, "high": None, "turns": 0}
            s = state
            s["sums"] = [a + b for a, b in zip(s["sums"], (blank, repeats, truncated, illegal, cost), strict=True)]
            s["sums"][3] += s["before"] is not None and s["before"] + first not in LEGAL
            s["before"] = last
            if low is not None:
                s["turns"] += turns - (s["high"] == low)
                s["low"], s["high"] = low if s["low"] is None else s["low"], high
            s["audit"].append(audit)
            held += len(audit)
            for role, text in zip(roles, texts, strict=True):
                s["sha"].update(f"{chr(10) * s['any']}{role}:{text}".encode())
                s["any"] = True
        if len(rows) > 1000 or held > CHARS:
            yield _rows(rows, names, types)
            rows, held = [], 0
    close()
    yield _rows(rows, names, types)


def report(conversations: DataFrame, of: DataFrame, block: int = ROWS) -> DataFrame:
    """Per conv_id of `of`: faults, cost, audit and digest of the repaired conversation (REPORT); zeros, an empty audit and the
    digest of the empty text where conversations has no rows of it. A digest is one sequence: blocks of a long conversation
    pass one task in order, one after another."""
    alone, more = repair(conversations, block)
    reports = alone.mapInArrow(_report, REPORT)
    if more is not None:
        reports = reports.unionByName(more.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(_report, REPORT))
    reports = reports.withColumnRenamed("conv_id", "of")
    every = of.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(reports, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
