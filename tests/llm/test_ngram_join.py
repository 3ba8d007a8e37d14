"""The n-gram join against all pairs."""

import random
import re

import numpy as np
import pytest

from quirefold.llm import ngram_join as N
from quirefold.llm import pair_blocks
from quirefold.llm.components import connected_components
from quirefold.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, lang string, component string, signature int"


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if rows[i][0] is None or rows[j][0] is None:
                continue
            if sets[i] and sets[j] and (same or 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = []
    for i, (d, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), None if d is None else (min(members) if sets[i] else d)))
    return sorted(out, key=repr)


def corpus(seed, n=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [r.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.5:
            w = (r.choice(rows)[1] or "").split()
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
        elif kind < 0.7:
            w = passage + [r.choice(words) for _ in range(r.randint(0, 25))]
        else:
            w = [r.choice(words) for _ in range(r.randint(0, 120))]
        rows.append((i, " ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "One"), (n + 3, "one"), (n + 4, "a b c"), (None, rows[0][1]), (3, rows[3][1])]


@pytest.mark.parametrize(("seed", "broadcast_rows"), [(1, None), (2, 0)])
def test_all_links_are_found(spark, seed, broadcast_rows):
    """broadcast_rows 0 shuffles every join."""
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)
    got = N.similarity_classes(docs, 4, 85, broadcast_rows)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 4, 85)


def test_large_group_of_near_copies(spark):
    """Copies with few and with many changed words: some link with the original, some only with each other, most with none."""
    r = random.Random(5)
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(r.choice((1, 2, 3, 4, 5, 6, 9, 14))):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(60):
        w = rows[r.randrange(len(rows))][1].split()
        w[r.randrange(len(w))] = "y"
        rows.append((1000 - i, " ".join(w)))
    got = N.similarity_classes(spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA), 4, 85)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 4, 85)


def test_one_id_with_several_texts_is_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (7, b), (7, a), (9, b), (9, c), (11, c + " end"), (7, None), (12, "lone text of five words"), (5, "")]
    got = N.similarity_classes(spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA))
    assert sorted(map(tuple, got.collect())) == [(5, 0, 5), (5, 37, 5), (7, 0, 7), (7, 37, 5), (7, 37, 5), (9, 37, 5), (9, 37, 5), (11, 38, 5), (12, 2, 12)]


def test_very_long_text(spark):
    w = [f"w{i * i % 9973}" for i in range(150_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:-9000])), (3, " ".join(w[: len(w) // 2]))]
    got = N.similarity_classes(spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 4, 85)


@pytest.mark.parametrize("percent", [85, 80])
def test_linked_pairs_share_as_many_signatures_as_promised(percent):
    r = np.random.default_rng(4)
    for n in (1, 2, 5, 7, 8, 13, 40, 41, 200, 900):
        for _ in range(40):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            lost, changed = int(r.integers(0, n * 17 // 100 + 1)), int(r.integers(0, n // 12 + 1))
            b = np.unique(np.r_[a[lost + changed :], r.integers(0, 2**63, changed, dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < percent * (len(a) + len(b) - both) or both == len(a) == len(b):
                continue
            (x, need_x), (y, need_y) = N.signatures(a, percent), N.signatures(b, percent)
            assert len(np.intersect1d(x, y)) >= min(need_x, need_y) >= 1


def test_words_and_shingles():
    a, b, c, d = shingle_sets(["A b  C d\te", "a B c D e", "", None], 4)
    assert a.tolist() == b.tolist() and len(a) == 2 and len(c) == len(d) == 0


def test_empty_and_kept(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert N.similarity_classes(none).count() == 0
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (None, "q r s t u"), (4, "z y x w v u")]
    kept = N.keep_one_of_each_class(spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA), k=5, percent=80)
    assert sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 1, 3, 4] and kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(200, 100), (100, 150), (7, 7), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(51)) and got[200] == got[150] == got[100] == 100 and 7 in got


def test_words_that_polynomial_hashes_confuse_stay_apart():
    """The sequence of Thue and Morse and its complement have one hash modulo 2^64 under every polynomial."""
    for n in (10, 11, 12):
        bits = [bin(i).count("1") % 2 for i in range(1 << n)]
        a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
        one, two, upper = shingle_sets([a, b, a.upper()], 4)
        assert one.tolist() != two.tolist() and one.tolist() == upper.tolist()


def test_blocks_give_their_pairs_back_in_few_bytes():
    """A row of Spark for each pair of longs took some 14 bytes in each shuffle, more than the texts in all."""
    import pyarrow as pa

    r = np.random.default_rng(8)
    x, y = r.integers(0, 2**44, 700_000), r.integers(-5_000, 5_000, 700_000)
    x[:1000], y[:3] = x[0], (-(2**63), 2**63 - 1, 0)
    made = list(pair_blocks.by_range(iter([(x[:600_000], y[:600_000]), (x[600_000:], y[600_000:])]), 50, 44))
    assert sum(b.num_rows for b in made) == 100
    table = pa.Table.from_batches(made)
    assert sorted(zip(*map(np.ndarray.tolist, pair_blocks.pairs(table)), strict=True)) == sorted(zip(x.tolist(), y.tolist(), strict=True))
    # without the bucket of the extreme ids
    assert sorted((len(a) + len(b)) / n for a, b, n in zip(table["x"].to_pylist(), table["y"].to_pylist(), table["n"].to_pylist(), strict=True))[90] <= 7
    seen = set()
    for bucket, n in zip(table["bucket"].to_pylist(), range(100), strict=True):
        own = set(pair_blocks.pairs(table.slice(n, 1))[0].tolist())
        seen.add((bucket, (min(own) >> 20) * 50 >> 24, (max(own) >> 20) * 50 >> 24))
    assert all(b == low == high for b, low, high in seen)
    (few,) = pair_blocks.by_range(iter([(np.full(900, 7), np.arange(900))]), 50, 44, most=2)
    assert few["n"].to_pylist() == [2] and pair_blocks.blocks(x[:0], x[:0], y[:0]).num_rows == 0


def test_shared_signatures_and_lone_shingles_are_those_of_whole_sets(spark):
    texts = {i: " ".join(f"w{(j * j + (i // 3) * 7) % 97}" if (i + j) % 41 else f"x{i}" for j in range(60 + i % 3)) for i in range(40)} | {-(2**40): "a b", 2**62: "a c"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = dict(zip(texts, shingle_sets(list(texts.values()), 4), strict=True))
    signed = {d: N.signatures(s, 85) for d, s in sets.items()}
    holders = {}
    for d, (found, _) in signed.items():
        for x in found.tolist():
            holders.setdefault(x, []).append(d)
    want = {}
    for d, (found, need) in signed.items():
        many = [x for x in found.tolist() if len(holders[x]) > 1]
        if many and len(many) >= min(signed[e][1] for x in many for e in holders[x]):
            want[d] = (need, sum(len(holders[x]) - 1 for x in many), sorted(x >> 20 for x in many))
    got = {r["doc_id"]: (r["need"], r["company"], sorted(r["signatures"])) for r in N.shared_signatures(docs, 4, 85, 5).collect()}
    assert got == want and len(want) > 10

    lone = {d: [x for x in s.tolist() if sum(x in set(o.tolist()) for o in sets.values()) == 1] for d, s in sets.items()}
    for r in N._bounds(docs, docs, 4, 5).collect():
        rest = np.bincount([x >> 20 & 31 for x in sets[r["doc_id"]].tolist() if x not in set(lone[r["doc_id"]])], minlength=32)
        assert r["alone"] == len(lone[r["doc_id"]]) and r["counts"] == rest.tolist()


@pytest.mark.parametrize("percent", [85, 80])
def test_sets_with_nothing_in_common_share_no_signature(percent):
    """They shared the signatures of empty subparts: large texts met in groups that grow with the corpus."""
    r = np.random.default_rng(6)
    for n in (450, 1000, 2300, 5000):
        seen = set()
        for _ in range(6):
            found = set(N.signatures(np.unique(r.integers(0, 2**63, n, dtype=np.uint64)), percent)[0].tolist())
            assert not found & seen
            seen |= found


@pytest.mark.parametrize("percent", [85, 80])
def test_linked_pairs_share_what_either_set_needs(percent):
    r = np.random.default_rng(7)
    linked = 0
    for n in (2, 5, 9, 30, 41, 57, 120, 400, 900):
        for _ in range(60):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            lost, changed = int(r.integers(0, n * (100 - percent) // 100 + 1)), int(r.integers(0, n // 8 + 1))
            b = np.unique(np.r_[a[lost + changed :], r.integers(0, 2**63, changed, dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < percent * (len(a) + len(b) - both) or both == len(a) == len(b):
                continue
            (x, need_x), (y, need_y) = N.signatures(a, percent), N.signatures(b, percent)
            assert len(np.intersect1d(x, y)) >= max(need_x, need_y) >= 1
            assert sum(int(v).bit_count() for v in (N.sketch(a) ^ N.sketch(b)).view(np.uint64)) <= len(a) + len(b) - 2 * both
            linked += 1
    assert linked > 100


def test_a_pair_leaves_the_join_once_or_a_few_times(spark):
    """Near copies whose changes other copies share: a pair came out once for each of its signatures, and the bound by lone shingles let nearly all pass."""
    r = random.Random(9)
    base, other = ([f"{x}{i}" for i in range(400)] for x in "ab")
    rows = []
    for i in range(60):
        w = list(base)
        for at in r.sample(range(400), 3 if i % 2 else 12):
            w[at] = other[at]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = dict(enumerate(shingle_sets([t for _, t in rows], 4)))
    shared = N.shared_signatures(docs, 4, 85, 5)
    apart = N._still_apart(shared, spark.createDataFrame([], "node long, component long"))
    facts = N._bounds(apart, docs, 4, 5).join(spark.createDataFrame([(d, len(s)) for d, s in sets.items()], "doc_id long, size int"), "doc_id")
    got = [tuple(x) for x in N._pairs_left(apart, facts, 85).collect()]
    want = {(a, b) for a in sets for b in sets if a < b and 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (len(sets[a]) + len(sets[b]) - n)}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 70 * (len(sets[a]) + len(sets[b]) - n)}
    assert want <= set(got) <= near and 50 < len(want) and len(got) <= 3 * len(set(got))
