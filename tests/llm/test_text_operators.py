"""Decontamination, line dedup, licences and fingerprints against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quirefold.llm import decontaminate, fingerprints, licenses, line_dedup

SCHEMA = "doc_id long, text string, words string, window string, item_id string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}é" for i in range(40)] + ["The", "of"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate((30, 12, 10, 9, 3, 1, 25))] + [(7, ""), (8, None), (9, "the of the of the of the of the of the of")]
    rows = []
    for d in range(60):
        t = [r.choice(vocabulary) for _ in range(r.choice((0, 5, 60, 200)))]
        if r.random() < 0.5:
            w = (items[r.randrange(7)][1]).split()
            a = r.randrange(len(w))
            t[r.randrange(len(t) + 1) : 0] = w[a : a + r.randint(5, 30)]
        rows.append((d, ", ".join(t)))
    rows += [(60, None), (61, ""), (62, "The-of the, of the of The of the of the"), (None, items[1][1])]
    expected = {}
    for d, text in rows:
        w, hit, found = words(text), set(), set()
        for item, said in items:
            v = words(said)
            n = min(10, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1) if windows else ():
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        expected[d] = (len(w), len(hit), sorted(found))
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    for limit in (10**6, 0):
        got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["items"]) for x in decontaminate.contamination(docs, bench, broadcast_rows=limit).collect()}
        assert got == expected
    clean = decontaminate.decontaminate(docs, bench)
    assert {x["doc_id"] for x in clean.collect()} == {d for d, e in expected.items() if not e[1]} and clean.columns == docs.columns


def test_decontamination_without_rows(spark):
    docs, bench = frame(spark, [(1, "a b")]), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(x)[:3] for x in decontaminate.contamination(docs, bench).collect()] == [(1, 2, 0)]
    assert decontaminate.contamination(docs.where("doc_id > 1"), bench).count() == 0


def test_line_dedup(spark):
    r = random.Random(8)
    sentences = [f"Sentence {i} {'x' * i}. " for i in range(40)]
    shared = "".join(sentences[:6])
    rows = [(d, "".join(r.choice(sentences) for _ in range(r.randint(0, 30))) + (shared if d % 3 == 0 else "")) for d in range(40)]
    rows += [(40, None), (41, ""), (42, "\n\n\n"), (43, "one. two. "), (44, rows[3][1]), (45, "a. a. a. a. a. a.")]
    pieces = {d: re.findall(r"[^.!?\n]+[.!?\n]*\s*|[.!?\n]+\s*", t or "") for d, t in rows}
    normal = {d: [re.sub(r"\s+", " ", p).strip().lower() for p in ps] for d, ps in pieces.items()}
    seen, expected = set(), {}
    for d, text in rows:
        gone = set()
        for i in range(len(normal[d]) - 2):
            window = tuple(normal[d][i : i + 3])
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        expected[d] = (len(pieces[d]), len(gone), text if not gone else "".join(p for i, p in enumerate(pieces[d]) if i not in gone))
    for limit in (10**6, 0):
        got = {x["doc_id"]: (x["n_lines"], x["n_deleted"], x["text"]) for x in line_dedup.line_dedup(frame(spark, rows), broadcast_rows=limit).collect()}
        assert got == expected


def test_licenses(spark):
    apache = "Some words.\nLicensed under\nthe Apache License, Version 2.0.\nMore."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    rows = [(1, apache), (2, bsd), (3, "plain"), (4, None), (5, ""), (6, "All rights reserved."), (7, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (7, "plain")]
    got = sorted((x["doc_id"], x["licenses"]) for x in licenses.scan_licenses(frame(spark, rows)).collect())
    assert got == [(1, ["Apache-2.0"]), (2, ["BSD-2-Clause"]), (3, []), (4, []), (5, []), (6, ["unrecognised"]), (7, []), (7, ["CC-BY-NC-4.0", "MIT"])]


@pytest.mark.parametrize("bucket_rows", [2048, 3])
def test_fingerprints(spark, bucket_rows):
    r = random.Random(2)
    line = lambda: " ".join(r.choice("alpha beta gamma delta éps zeta".split()) + str(r.randrange(99)) for _ in range(6)) + "d. "
    rows = [(5 * d, "".join(line() for _ in range(r.choice((0, 1, 4, 30, 120))))) for d in range(20)] + [(200, None), (201, ""), (7, "same"), (8, "same"), (None, "no id")]
    got = {x["doc_id"]: x for x in fingerprints.fingerprints(frame(spark, rows), bucket_rows=bucket_rows).collect()}
    order = sorted((x for x in rows if x[0] is not None), key=lambda x: -x[0]) + [(None, "no id")]
    assert len(got) == len(rows)
    units = lambda t: {p for p in re.sub(r"([d-h][.!?]) ", r"\1\n", t).split("\n") if p}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, (d, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        x = got[d]
        assert x["n_chars"] == len(text) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(x["near_edited"] - alike(units(text), units(edited))) < 1e-9
        assert abs(x["near_next"] - alike(units(text), units(following))) < 1e-9
    assert got[7]["fingerprint"] == got[8]["fingerprint"]
    assert fingerprints.fingerprints(frame(spark, rows).where("doc_id < 0")).count() == 0


def test_likeness_where_no_sketch_can_be_peeled(spark, monkeypatch):
    """Blocks far too large for every retry: the end of the retries is exact."""
    monkeypatch.setattr(fingerprints, "PER_BLOCK", 10**9)
    monkeypatch.setattr(fingerprints, "RETRIES", (4, 8))
    a, b = ("\n".join(f"{x} line {i}" for i in range(150)) for x in ("one", "two"))
    rows = [(2, "both\n" + a), (1, "both\n" + b)]
    got = {x["doc_id"]: x["near_next"] for x in fingerprints.fingerprints(frame(spark, rows)).collect()}
    assert got == {1: 1 / 301, 2: 1 / 301}


def test_fingerprints_of_one_line(spark):
    texts = [
        "".join(units)
        for units in (
            ["Sentence %d of MANY. " % i for i in range(60)],
            ["Это предложение номер %d! " % i for i in range(60)],
            ["这是第%d句话。" % i for i in range(60)],
            ["هذه هي الجملة رقم %d؟ " % i for i in range(60)],
            ["word%d and " % (i * i) for i in range(400)],
            [chr(0x4E00 + i * i % 3001) for i in range(2000)],
            [hashlib.md5(b"%d" % i).hexdigest() for i in range(80)],
        )
    ]
    rows = [(2 * i + 1, t) for i, t in enumerate(texts)] + [(2 * i, "x" + t) for i, t in enumerate(texts)]
    for x in fingerprints.fingerprints(frame(spark, rows)).where("doc_id % 2 = 1").collect():
        # a third is replaced; the next text has one more character in front, which changes the paragraphs around it alone
        assert 0.5 < x["near_edited"] < 0.85 and x["near_next"] > 0.85


_GPL = """This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation%s either version %d of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
_NOTICES = {
    "GPL-2.0-or-later": _GPL % (";", ";", 2),
    "GPL-3.0-or-later": _GPL % (":", ",", 3),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": _BSD
    + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License,\nVersion 3.",
    "GPL-2.0-only": "Licensed under the GNU\nGeneral Public License version 2.",
    "LGPL-3.0-only": "Licensed under the GNU\nLesser General Public License version 3.",
    "AGPL-3.0-only": "Licensed under the GNU\nAffero General Public License version 3.",
    "CC-BY-4.0": "This work is licensed under a\nCreative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "Licensed under\nCC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under\nCC BY-NC-SA 4.0.",
    "CC0-1.0": "Licensed under\nCC0 1.0.",
}


def test_licenses_of_real_notices(spark):
    assert set(_NOTICES) == {name for name, _, _ in licenses.RULES}
    names = sorted(_NOTICES)
    marks = ["", "# ", " * ", "// ", "dnl "]
    rows = [(100 * m + i, "\n".join(mark + line for line in _NOTICES[n].split("\n"))) for m, mark in enumerate(marks) for i, n in enumerate(names)]
    got = {x["doc_id"]: x["licenses"] for x in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert got == {d: [names[d % 100]] for d, _ in rows}
    # a known sentence that is only part of a longer one doesn't count
    assert licenses.scan_licenses(frame(spark, [(1, "This isn't\nlicensed under the MIT license.")])).first()["licenses"] == []


def test_line_dedup_of_repeated_rows_and_ids(spark):
    a, b = ("".join(f"{x} line {i}. " for i in range(5)) for x in "ab")
    rows = [(3, a), (3, a), (4, a), (None, b), (5, b), (6, "x. y. " + b + "z. " + b), (7, a + "one."), (7, a + "two."), (8, "u. u. u. u. u.")]
    got = sorted((x["doc_id"] or 0, x["n_lines"], x["n_deleted"]) for x in line_dedup.line_dedup(frame(spark, rows)).collect())
    assert got == [(0, 5, 0), (3, 5, 0), (3, 5, 0), (4, 5, 5), (5, 5, 5), (6, 13, 10), (7, 6, 5), (7, 6, 5), (8, 5, 4)]
    assert line_dedup.line_dedup(frame(spark, rows).where("doc_id > 99")).count() == 0


def test_line_dedup_of_one_id_with_two_texts(spark):
    a = "".join(f"line {i}. " for i in range(5))
    rows = [(7, a + "one."), (7, a + "two.")]
    got = sorted(x["n_deleted"] for x in line_dedup.line_dedup(frame(spark, rows)).collect())
    assert got == [0, 5]


def test_line_dedup_of_few_long_lines(spark):
    one = " ".join(f"a{i}" for i in range(60)) + ". "
    two = " ".join(f"b{i}" for i in range(30)) + ". " + " ".join(f"c{i}" for i in range(30)) + ". "
    cjk = "".join(chr(0x4E00 + i) for i in range(80)) + "。"
    short = "only a few words. "
    rows = [(1, "First. " + one + "End."), (2, "Second. " + one + "Other end."), (3, two), (4, two), (5, cjk), (6, cjk), (7, short), (8, short)]
    got = {x["doc_id"]: (x["n_deleted"], x["text"]) for x in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got[2] == (1, "Second. Other end.") and got[4] == (2, "") and got[6] == (1, "")
    assert all(got[d] == (0, t) for d, t in rows if d not in (2, 4, 6))


def test_words_of_scripts_without_spaces(spark):
    """A range before the scripts spares most characters the search for their script; it counts the same characters."""
    scripts = line_dedup._SPACELESS.partition("&&")[2].removesuffix("]")
    assert line_dedup._SPACELESS == r"[\x{E00}-\x{10FFFF}&&" + scripts + "]" and "IsHan" in scripts
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and not chr(c).isspace()]
    lines = ["".join(map(chr, points[i : i + 4096])) for i in range(0, len(points), 4096)] + ["", "a", "a b", "é ü", "漢", "a 漢字 b"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").repartition(4)
    own, plain = line_dedup._words(F.col("line")), F.regexp_count("line", F.lit(scripts)) + 1
    got = rows.select("line", own.alias("own"), (plain + F.regexp_count("line", F.lit(" "))).alias("plain")).collect()
    assert all(x["own"] == x["plain"] for x in got) and {x["line"]: x["own"] for x in got}["a 漢字 b"] == 5


def test_lines_are_spaced_by_one_look_at_a_text(spark):
    """Five marks were looked for in every line; texts with and without them give what white space replaced in every line gives."""
    texts = ["One two.\nThree\n. Four?\n\n five", "a  b.\tc\td. e", "x\r\ny. z\x0bw\f.", "plain. words here. ", " \n ", "", None, "\n.\n", "a\n \nb. \u00a0c"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    lines = line_dedup.lines_of(F.col("text"))
    got = docs.select(line_dedup._spaced_lines(F.col("text"), lines).alias("own"), F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))).alias("plain"))
    assert all(r["own"] == r["plain"] for r in got.collect())
    # a line of a text without the rare marks is looked at once
    plan = docs.select(line_dedup._spaced_lines(F.col("text"), lines))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Contains(text#") + plan.count("contains(text#") == 5
