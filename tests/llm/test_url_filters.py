"""The template tree against a plain one, and rows of every kind."""

import random
import re
from collections import defaultdict
from math import sqrt

from quirefold.llm import url_filters as U

PAGES = "page_id long, url string"
PATHS = "host string, path string, pages long, bad long, labelled long"


def plain(rows, depth):
    """{(host, path): template} by recursion over the nodes."""
    out = {}

    def grow(node, level, template):
        children = defaultdict(list)
        for row in node:
            if len(row[1]) > level:
                children[row[1][level]].append(row)
            else:
                out[row[0]] = (template or "") + ("/**" if row[2] else "")
        bad, labelled = (sum(r[k] for c in children.values() for r in c) for k in (3, 4))
        merged = []
        for name, c in children.items():
            b, n = sum(r[3] for r in c), sum(r[4] for r in c)
            keep = len(children) == 1
            if not keep and n >= U.MIN_LABELS and labelled > n:
                rate = bad / labelled
                keep = abs(b / n - (bad - b) / (labelled - n)) > U.Z * sqrt(rate * (1 - rate) * (1 / n + 1 / (labelled - n)))
            if keep and name != "*":  # a segment that is `*` is part of the merged branch
                grow(c, level + 1, name if template is None else f"{template}/{name}")
            else:
                merged += c
        if merged:
            grow(merged, level + 1, "*" if template is None else f"{template}/*")

    hosts = defaultdict(list)
    for host, path, _, bad, labelled in rows:
        seg = path.split("/") if path else []
        hosts[host].append(((host, path), [re.sub("[0-9]+", "#", s) for s in seg[:depth]], len(seg) > depth, bad, labelled))
    for node in hosts.values():
        grow(node, 0, None)
    return out


def test_templates_against_a_plain_tree(spark):
    rng = random.Random(3)
    paths = {}
    for _ in range(900):
        segs = [rng.choice("abcd"), rng.choice(["x", "y", "7", "88"]), rng.choice(["", "*", "q1", "q22", "z"]), rng.choice("mn")][: rng.randint(0, 4)]
        host, path = rng.choice(["h", "h", "k.org"]), "".join("/" + s for s in segs)
        labelled = rng.randint(0, 12)
        share = 0.9 if segs[:1] == ["a"] or "z" in segs else 0.1
        paths[host, path] = (host, path, 12, sum(rng.random() < share for _ in range(labelled)), labelled)
    rows = list(paths.values())
    for depth, limit in ((3, 1), (8, 1000)):
        want = plain(rows, depth)
        got = {(r.host, r.path): r.template for r in U.templates(spark.createDataFrame(rows, PATHS), depth, limit).collect()}
        assert got == want
    assert any("*" in t for t in want.values()) and any("/a" in t for t in want.values())


def test_children_of_merged_branches_are_counted_together(spark):
    # no user has enough labels for itself; below all of them /bad/ is bad
    rows = [("h", f"/u{c}/{kind}/{i}", 1, int(kind == "bad"), 1) for c in "abcdefghij" for kind in ("bad", "good") for i in range(2)]
    got = {r.path: r.template for r in U.templates(spark.createDataFrame(rows, PATHS)).collect()}
    assert got["/ua/bad/0"] == "/*/bad/#" and got["/uj/good/1"] == "/*/good/#"


def test_rows_of_every_kind(spark):
    long = "http://h/" + "s/" * 20000
    rows = [(1, None), (2, "no scheme"), (3, "http://h"), (4, "http://h/a"), (4, "http://h/a"), (None, "http://h/a"), (5, long), (6, "")]
    got = U.filter_urls(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert (by_id[1].host, by_id[1].path, by_id[1].template, by_id[6].verdict) == ("", "", "", "allow")
    assert by_id[5].path == long[8:] and by_id[5].template.endswith("/**")
    assert U.filter_urls(spark.createDataFrame([], PAGES)).count() == 0
