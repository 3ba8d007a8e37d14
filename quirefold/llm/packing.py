"""Best-fit packing of tokenized documents, after a dominance reduction.

A document's tokens are cut at the sequence length only where the document is longer than that, so the pieces to pack are
numbers from 1 to the length. All that packing needs is how many pieces there are of each number: a table of at most 2048 rows,
however many documents there are. On it the reduction and best fit run with multiplicities, for all pieces of a number at once:

- Reduction (Martello and Toth): for a piece, a set of it and at most two others is fixed for good if it dominates every other
  set with that piece, that is, every other set's pieces fit into the places of its own; the instance shrinks by that set.
- Best fit: what remains goes by falling length, each piece into the fullest sequence that has room for it.

The result is a short list of slots (length, ranks from and to, first sequence, ...). Every piece has a rank among those of its
length, by partition and place in it, and so finds its sequence and offset alone; no task orders all pieces of a length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CAPACITY, TOKENIZER, END = 2048, "/opt/tokenizers/word_bpe_49k.json", 0
#: Texts are encoded in parts of about so many characters, cut at white space.
CHARS = 1 << 21
#: Words whose tokens a task remembers.
REMEMBERED = 1_000_000
_SPACE = re.compile(r"[ \t\n\r]")
#: The pre-tokenizer with which words can be encoded alone.
_BY_WORDS = ["Sequence", ("Split", {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, True), ("ByteLevel", None, None)]
#: Words that NFC leaves alone and lower-casing treats alike everywhere.
_SIMPLE = re.compile(r"[\x21-\x3B\x3D-\u012F\u0131-\u017F]+")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


class Words:
    """Token ids of texts, for a tokenizer that drops white space and merges nothing across it, by their words, which repeat.

    A word of letters that ends in ASCII stops is two: stem and stops. Neither normalisation nor the tokenizer's own splitting
    joins a letter with a stop, so their tokens are those of the word; the stem is looked up in lower case. With any other
    tokenizer whole texts are encoded.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(source)
        parts = json.loads(source)
        steps = [(parts.get("pre_tokenizer") or {}).get("type"), *((x["type"], x.get("pattern"), x.get("invert")) for x in (parts.get("pre_tokenizer") or {}).get("pretokenizers", []))]
        self.by_words = steps == _BY_WORDS and bool(parts["model"].get("end_of_word_suffix"))
        if self.by_words:
            # for stems of letters, which are lower case and normal: the same model behind white space alone
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab, suffix = parts["model"]["vocab"], parts["model"]["end_of_word_suffix"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.words: dict[str, int] = {}
        self.word_ids, self.word_begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encode new words: stems of letters many at once, told apart by the tokens that end a word, and others alone."""
        stems = [w for w in words if w.isalpha() and _SIMPLE.fullmatch(w) and w == w.lower()]
        others = list(set(words).difference(stems))
        ids, ends, at = [self.ids], [self.begin], len(self.ids)
        for e in self.bare.encode_batch_fast([" ".join(stems[i : i + 512]) for i in range(0, len(stems), 512)], add_special_tokens=False):
            ids.append(np.array(e.ids, np.uint32))
            ends.append(at + np.flatnonzero(self.last[ids[-1]]) + 1)
            at += len(ids[-1])
        for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False):
            ids.append(np.array(e.ids, np.uint32))
            at += len(ids[-1])
            ends.append(np.array([at]))
        self.ids, self.begin = np.concatenate(ids), np.concatenate(ends)
        self.known.update(zip(stems + others, range(len(self.known), len(self.known) + len(words)), strict=True))
        if len(self.begin) != len(self.known) + 1:
            raise ValueError("the tokenizer does not end each word with a token of its own")

    def _add(self, words: list[str]) -> None:
        """Token ids of new words from those of their stems and stops."""
        both = []
        for word in words:
            stem = word.rstrip(".,;:!?")
            if stem != word and stem and stem[-1].isalpha() and _SIMPLE.fullmatch(stem):
                both += (stem.lower(), word[len(stem) :])
            else:
                both += (word.lower() if stem == word and _SIMPLE.fullmatch(word) else word, "")
        if new := [w for w in dict.fromkeys(both) if w not in self.known]:
            self._learn(new)
        numbers = np.fromiter(map(self.known.__getitem__, both), np.int64, len(both))
        ids, ends = _gather(self.ids, self.begin, numbers)
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))
        self.word_ids = np.concatenate([self.word_ids, ids])
        self.word_begin = np.concatenate([self.word_begin, self.word_begin[-1] + ends[2::2]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's end."""
        if not self.by_words:
            encoded = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *encoded]), np.cumsum([len(e) for e in encoded], dtype=np.int64)
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.words) > REMEMBERED:
            self._forget()
        if new := [w for w in distinct if w not in self.words]:
            self._add(new)
        numbers = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))
        ids, ends = _gather(self.word_ids, self.word_begin, numbers[coded.indices.to_numpy(zero_copy_only=False)])
        return ids, ends[words.offsets.to_numpy()][1:]


def _gather(ids: np.ndarray, begin: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ids[begin[n]:begin[n + 1]] one after another, and where they begin and end."""
    first = begin[numbers]
    ends = np.zeros(len(numbers) + 1, np.int64)
    np.cumsum(begin[numbers + 1] - first, out=ends[1:])
    at = np.repeat(first - ends[:-1], np.diff(ends))
    at += np.arange(ends[-1])
    return ids[at], ends


_LOADED: dict[int, Words] = {}


def _words(source: str) -> Words:
    """The words of this tokenizer; a Python worker keeps them from task to task."""
    key = zlib.crc32(source.encode())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Words(source)
    return _LOADED[key]


def _parts(texts: pa.Array, chars: int, cut_long: bool) -> Iterator[tuple[pa.Array, bool]]:
    """Runs of texts of about `chars` characters; with cut_long one that is longer comes in parts of its own, and False means that more of it follows."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > chars:
            yield texts[first:i], True
            first, held = i, 0
        if n > chars and cut_long:
            text, at = texts[i].as_py(), 0
            while at < len(text):
                stop = _SPACE.search(text, at + chars)
                past = stop.start() if stop else len(text)
                yield pa.array([text[at:past]]), past == len(text)
                at = past
            first, held = i + 1, 0
        else:
            held += n
    if first < len(texts):
        yield texts[first:], True


def _pieces(batches: Iterator[pa.RecordBatch], source, capacity: int, keep_ids: bool, chars: int) -> Iterator[pa.RecordBatch]:
    words = _words(source.value)
    for batch in batches:
        docs, at, carried = batch.column(0), 0, []
        for texts, whole in _parts(pc.fill_null(batch.column(1), ""), chars, words.by_words):
            ids, ends = words.encode(texts)
            if not whole:
                carried.append(ids)
                continue
            rows, begin = [], 0
            for end in ends.tolist():
                tokens = np.concatenate([*carried, ids[begin:end], np.array([END], np.uint32)]).astype("<u4")
                carried, begin, doc = [], end, docs[at].as_py()
                for p, start in enumerate(range(0, len(tokens), capacity)):
                    piece = tokens[start : start + capacity]
                    rows.append((doc, p, start, len(piece), zlib.crc32(piece.tobytes()), piece.astype(np.int32) if keep_ids else None))
                at += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, keep_ids: bool = False, chars: int = CHARS) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, ids): each row of docs as token ids and a final 0, cut where they exceed the capacity.

    A null or empty text is the 0 alone. Repeated rows are documents of their own; null ids stay null. ids are null unless
    keep_ids. Other columns are ignored. The driver reads the tokenizer's file, a few MB, and broadcasts it.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_pieces, source=source, capacity=capacity, keep_ids=keep_ids, chars=chars), PIECES)


def _largest(sizes: list[int], most: int) -> int:
    """The largest of the rising sizes that is at most `most`, or 0."""
    i = bisect_left(sizes, most + 1)
    return sizes[i - 1] if i else 0


def _dominating(left: dict[int, int], sizes: list[int], j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with j, of three at most, that dominates every set with j among the sizes left; None if none is found.

    left has the number of pieces of each size in sizes, j among them. One piece of j is taken out first.
    """
    room = capacity - j
    have = lambda s: left[s] - (s == j)
    smallest = []
    for s in sizes:
        smallest += [s] * min(have(s), 3 - len(smallest))
        if len(smallest) == 3:
            break
    others = sum(1 for k in range(1, len(smallest) + 1) if sum(smallest[:k]) <= room)
    if not others:
        return (j,)
    one = _largest(sizes, room)
    if one == j and not have(j):
        one = _largest(sizes[: bisect_left(sizes, j)], room)
    # one more piece at most, or one that leaves no room: the largest that fits stands for all others
    if others == 1 or one == room:
        return (j, one)
    if others > 2:
        return None
    best, pair, lo, hi = 0, None, 0, bisect_left(sizes, room)
    hi = min(hi, len(sizes) - 1)
    while lo <= hi:
        a, b = sizes[hi], sizes[lo]
        if not have(b) or (lo == hi and have(b) < 2):
            lo += 1
        elif not have(a) or a + b > room:
            hi -= 1
        else:
            if a + b > best:
                best, pair = a + b, (a, b)
            lo += 1
    if pair is None or one >= best:
        return (j, one)
    # sets of two others that aren't below the best pair place by place have both above its smaller one; the two smallest such decide
    above = []
    for s in sizes[bisect_left(sizes, pair[1] + 1) :]:
        above += [s] * min(have(s), 2 - len(above))
        if len(above) == 2:
            break
    return (j, *pair) if one == pair[0] and (len(above) < 2 or sum(above) > room) else None


def reduce_instance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets that can be fixed without losing the optimum, as (sizes, how often), and the counts of what remains.

    A set found stays dominating while its pieces last, as others only disappear, so it is fixed as often as they allow.
    """
    left = {s: n for s, n in counts.items() if n}
    sizes, fixed, changed = sorted(left), [], True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j) and (found := _dominating(left, sizes, j, capacity)):
                times = min(left[s] // found.count(s) for s in set(found))
                fixed.append((found, times))
                for s in found:
                    left[s] -= times
                for s in set(found):
                    if not left[s]:
                        del left[s]
                        sizes.remove(s)
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit by falling size, as patterns ([(size, how many), ...], sequences of that pattern).

    Sequences with the same contents are one group. The fullest with room for a piece takes as many of that size as fit, for
    its room only shrinks and stays the best fit.
    """
    groups: dict[int, list[tuple[tuple, int]]] = {}
    rooms: list[int] = []
    done: list[tuple[list[tuple[int, int]], int]] = []

    def put(room: int, pattern: tuple, times: int) -> None:
        if times and room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((pattern, times))
        elif times:
            done.append((list(pattern), times))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect_left(rooms, size)
            room = rooms[i] if i < len(rooms) else capacity
            pattern, times = groups[room].pop() if i < len(rooms) else ((), n)
            each = room // size
            full = min(times, n // each)
            some = n - full * each if full < times and n > full * each else 0
            if room in groups and not groups[room]:
                del groups[room]
                del rooms[i]
            put(room - each * size, (*pattern, (size, each)), full)
            put(room - some * size, (*pattern, (size, some)), 1 if some else 0)
            if pattern:
                put(room, pattern, times - full - bool(some))
            n -= full * each + some
    return done + [(list(p), t) for room in rooms for p, t in groups[room]]


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns for all pieces: what the reduction fixes, then best fit. Full pieces are sequences of their own."""
    fixed, left = reduce_instance({s: n for s, n in counts.items() if s < capacity}, capacity)
    whole = [([(capacity, 1)], counts[capacity])] if counts.get(capacity) else []
    return whole + [([(s, sizes.count(s)) for s in dict.fromkeys(sizes)], times) for sizes, times in fixed] + best_fit(left, capacity)


def slots(patterns: list[tuple[list[tuple[int, int]], int]], capacity: int = CAPACITY) -> np.ndarray:
    """Slots (length, first rank, sequence, pieces in a sequence, offset) in order of length and first rank."""
    rank, sequence, rows = [0] * (capacity + 1), 0, []
    for pattern, times in patterns:
        offset = 0
        for size, each in pattern:
            rows.append((size, rank[size], sequence, each, offset))
            rank[size] += times * each
            offset += size * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    slot = table.value
    edges = np.searchsorted(slot[:, 0], np.arange(slot[-1, 0] + 2))
    for batch in batches:
        length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        order = np.lexsort((rank, length))
        at = np.zeros(len(order), np.int64)
        for size in np.unique(length):
            mine = order[np.searchsorted(length[order], size) : np.searchsorted(length[order], size, side="right")]
            low, high = edges[size], edges[size + 1]
            at[mine] = low + np.searchsorted(slot[low:high, 1], rank[mine], side="right") - 1
        _, first, sequence, each, offset = slot[at].T
        inside = rank - first
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence + inside // each), pa.array(offset + inside % each * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every row of pieces with its sequence and place there.

    Sequences are numbered from 0; offsets in a sequence have no gaps. Repeated rows are pieces of their own; an empty table
    gives an empty result. To the driver comes one number for each length.
    """
    rows = cut(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.spark_partition_id().alias("part")))
    parts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    table = pieces.sparkSession.sparkContext.broadcast(slots(pack_counts(counts, capacity), capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = rows.withColumn("inside", inside).join(parts, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside")).alias("rank"))
    return ranked.mapInArrow(partial(_place, table=table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence, from pieces with ids. Rows of one (doc_id, piece) must be equal."""
    ids = pieces.groupBy("doc_id", "piece", "ids_crc32").agg(F.first("ids").alias("ids"))
    on = [F.col("p." + c).eqNullSafe(F.col("i." + c)) for c in ("doc_id", "piece", "ids_crc32")]
    rows = packed.alias("p").join(ids.alias("i"), on).select("sequence_id", F.struct("offset", "ids").alias("at"))
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["ids"])).alias("ids"))
