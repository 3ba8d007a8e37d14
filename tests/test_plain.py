"""Queries that have no SQL, against plain Python over the same tables."""

import os
import re

import pytest

from quirefold.functions import values as V
from quirefold.plans import derived, grid_queries, page_queries, registry, text_queries  # noqa: F401  (importing registers)

SF = "/root/testdata/sf0.001"


def blank(s):
    return s is None or not s.strip()


def repeated_at(text):
    lines = text.split("\n")
    for i in range(2, len(lines)):
        if lines[i] == lines[i - 1] == lines[i - 2] and not blank(lines[i]):
            return sum(len(x) + 1 for x in lines[: i - 2])
    return -1


def without_repetition(text):
    if len(text) < 100:
        return text
    at = repeated_at(text)
    kept = text[:at].rstrip() if at > 0 else text
    kept = re.sub(r"(.{1,5})\1{9,}", r"\1", kept)
    return re.sub(r"(.)\1{29,}", r"\1", kept).strip()


def sentences(text):
    return [s for s in re.split(r"(?<=[.?!])\s+|(?<=\n)\n", text) if s]


def chunks(text, most=2000, overlap=100):
    if blank(text):
        return []
    if len(text) <= most:
        return [text]
    out, current = [], ""
    for s in sentences(text):
        if current and len(current) + 1 + len(s) > most:
            out.append(current)
            current = current[-overlap:] + "\n" + s
        else:
            current = current + "\n" + s if current else s
    return out if blank(current) else [*out, current]


def leaks(line):
    return re.match(r"(?i)\s*\.?\s*(" + "|".join(V.LEAKAGE_STARTS) + ")", line) is not None


def clean_line(line):
    for pattern, left in ((V.RECOGNISER_MARKS, ""), (V.COORDINATES, ""), (V.TAGS, "")):
        line = re.sub(pattern, left, line)
    line = re.sub(V.LINE_START_MARKS, r"\1", line, count=1)
    line = re.sub(V.PAIRED_MARKS, r"\2", line)
    for pattern in (V.ROW_END_BARS, V.SYMBOLS):
        line = re.sub(pattern, "", line)
    return line.strip()


def over_math(text, change, whole=True):
    found = list(re.finditer(V.MATH_REGION, text))
    if not found:
        return change(text) if whole else text
    out, at = "", 0
    for m in found:
        n = 2 if m[0].startswith(("$$", "\\")) else 1
        out += text[at : m.start()] + m[0][:n] + change(m[0][n : len(m[0]) - n]) + m[0][len(m[0]) - n :]
        at = m.end()
    return out + text[at:]


def clean_latex(text):
    from test_functions import _plain_l02, _plain_l03, _plain_l04

    if text == "":
        return text
    text = over_math(_plain_l02(text, V.DOUBLED_COMMANDS), lambda m: _plain_l04(_plain_l03(m, V.SUBSCRIPT_COMMANDS)))
    bare = text.replace("\\{", "").replace("\\}", "")
    text += "}" * min(max(bare.count("{") - bare.count("}"), 0), 10)
    return over_math(text, lambda m: re.sub("[ \t]{2,}", " ", m).strip())


def clean_text(text):
    text = without_repetition(text)
    text = re.sub("(?i)" + V.TABLE_TAGS, "", re.sub("(?i)" + V.ROW_END, "\n", re.sub("(?i)" + V.CELL_BOUNDARY, "\t", text)))
    lines = [clean_line(x) for x in text.splitlines() if not leaks(x) and not re.match(r"\s*[-=*]{3,}\s*$", x)]
    text = re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()
    if not blank(text) and not re.search("[가-힣]", text) and re.search("(?i)" + "|".join(V.LEAKAGE_PHRASES) + r"|\\\\#\s*\\\\#\s*\\\\#", text):
        text = ""
    return clean_latex(text)


def valid_refinement(new, old):
    n, m = len(old.strip()), len(new.strip())
    return m > 0 and n > 0 and 0.3 * n <= m <= 2 * n


def parsed(raw, original):
    text = re.sub("(?i)" + V.THOUGHTS, "", raw.strip()).strip()
    if re.search("(?im)^" + V.CORRECTED_HEADER, text):
        text = re.split("(?im)^" + V.CORRECTED_HEADER, text, maxsplit=1)[-1].strip()
    text = re.split(r"(?m)^-{3,}\s*$", text)[-1].strip()
    for pattern in V.EXPLANATIONS:
        text = re.sub("(?m)" + pattern, "", text)
    return original if blank(raw) or not valid_refinement(text.strip(), original) else text.strip()


def refined(text):
    import hashlib

    own = text.strip()
    worth = len(own) >= 50 and not re.fullmatch(r"[\s\-–—]*\d+[\s\-–—]*", own) and not re.match(r"[=\-_─━*]{3,}\s*$", own)
    if worth and (parts := chunks(text)):
        text = "\n".join(parsed(p[:2000].replace("e", "3"), p) for p in parts)
    return hashlib.sha256(text.encode()).hexdigest()


def letters(terms):
    """Spellings with one vowel, initial or final taken for another that make one term alone."""
    made = {}
    for term in terms:
        for i, ch in enumerate(term):
            code = ord(ch) - 0xAC00
            if not 0 <= code < 11172:
                continue
            parts = [code // 588, code % 588 // 28, code % 28]
            for k, pairs in ((1, V.VOWELS), (0, V.INITIALS), (2, V.FINALS)):
                for a, b in [*pairs, *[(b, a) for a, b in pairs]]:
                    if parts[k] == a:
                        p = parts[:k] + [b] + parts[k + 1 :]
                        made.setdefault(term[:i] + chr(0xAC00 + (p[0] * 21 + p[1]) * 28 + p[2]) + term[i + 1 :], set()).add(term)
    return {s: next(iter(t)) for s, t in made.items() if len(t) == 1 and s not in terms}


def _syllables(n):
    make = lambda i, v, f: chr(0xAC00 + (i * 21 + v) * 28 + f)
    return make(n % 19, n % 21, 0) + make(n * 7 % 19, n * 5 % 21, 4)


PLAIN = {
    "x01_remove_repetition": lambda t: [{"doc_id": d, "text": without_repetition(x)} for d, x in t("documents", "doc_id", "text")],
    "x06_clean_text": lambda t: [{"doc_id": d, "text": clean_text(x)} for d, x in t("documents", "doc_id", "text")],
    "x10_x11_chunks": lambda t: [{"doc_id": d, "chunk": i, "text": c} for d, x in t("documents", "doc_id", "text") for i, c in enumerate(chunks(x))],
    "x08_parse_refined": lambda t: [{"doc_id": d, "page_num": p, "text": parsed("<think>so</think>\ncorrected text:\n" + v, o)} for d, p, o, v in t("dv_versions", "doc_id", "page_num", "original", "v0")],
    "l01_clean_latex": lambda t: [{"doc_id": d, "text": clean_latex(x)} for d, x in t("documents", "doc_id", "text")],
    "e03_x11_refined": lambda t: [{"doc_id": d, "text_sha256": refined(x)} for d, x in t("documents", "doc_id", "text")],
    "d02_letter_spellings": lambda t: [{"spelling": s, "term": w} for s, w in letters({_syllables(n) for (n,) in t("part", "p_partkey")}).items()],
}
#: Queries without SQL that other tests hold against plain Python.
ELSEWHERE = {
    "b02_table_regions": "test_grids.test_table_regions_on_random_grids",
    "d01_d05_correct": "test_operators.test_corrections",
    "g18_k09_combine_lines": "test_operators.test_merge_and_match",
    "l10_l12_t02_place": "test_operators.test_placement",
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(PLAIN))
def test_query_without_sql(spark, name):
    def table(source, *columns):
        return [tuple(r) for r in derived.read(spark, SF, source).select(*columns).collect()]

    got = registry.QUERIES[name](spark, SF)
    want = PLAIN[name](table)
    key = lambda r: repr(sorted(r.items()))
    assert sorted((r.asDict() for r in got.collect()), key=key) == sorted(want, key=key) and want


def test_every_query_has_sql_or_a_plain_version():
    without = set(registry.QUERIES) - set(registry.ORACLES)
    assert without == set(PLAIN) | set(ELSEWHERE)
