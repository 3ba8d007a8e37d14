"""DuckDB SQL for the queries that SQL can express.

Not here: fingerprints (64-bit hashes of Spark's own), toxicity (a trained model), sharding (a tree) and packing (a tokenizer);
the tests compare these with brute force, held-out accuracy and the law that they promise.
"""

from __future__ import annotations

from . import ball_tree, chat, licenses, mixing, url_filters
from .common import LOWER, UPPER


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _az(c: str) -> str:
    return f"translate(coalesce({c}, ''), '{UPPER}', '{LOWER}')"


_ITEM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORDS = r"'[^\x20\x09-\x0D]+'"

OP1 = r"""WITH p AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?\n]*\s*|[.!?\n]+\s*') AS l FROM documents),
n AS (SELECT doc_id, list_transform(l, lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))) AS h FROM p),
q AS (SELECT doc_id, h, list_transform(h, lambda x: length(x) - length(replace(x, ' ', '')) + 1 + CASE WHEN strlen(x) = length(x) THEN 0 ELSE len(regexp_extract_all(x, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]')) END) AS c FROM n),
spans AS (SELECT doc_id, h, c, v AS wide, unnest(range(1, len(h) - v + 2)) AS s FROM q, (SELECT unnest([1, 2, 3]) AS v) WHERE len(h) >= v),
w AS (SELECT doc_id, s, wide, h[s:s + wide - 1] AS c FROM spans WHERE wide = 3 OR list_sum(c[s:s + wide - 1]) >= 50),
later AS (SELECT doc_id, s, wide FROM (SELECT doc_id, s, wide, row_number() OVER (PARTITION BY c ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + wide)) AS i FROM later),
kept AS (SELECT e.doc_id, string_agg(e.x, '' ORDER BY e.i) AS text FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM p) e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i WHERE g.i IS NULL GROUP BY e.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT p.doc_id, len(l)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_deleted, sha256(CASE WHEN c.n IS NULL THEN p.text ELSE coalesce(k.text, '') END) AS text_sha256 FROM p LEFT JOIN kept k USING (doc_id) LEFT JOIN counts c USING (doc_id)"""

OP2 = f"""WITH dw AS (SELECT doc_id, regexp_extract_all({_az('text')}, {_ITEM_WORDS}) AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_az('text')}, {_ITEM_WORDS}) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM win),
tried AS (SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') AS t FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM dw, ls)),
hits AS (SELECT doc_id, l, s, item_id FROM tried JOIN win USING (l, t)),
cover AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + l)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(cover.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AS contaminated FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)"""

OP3 = f"""WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_az('text')}, {_WORDS}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT dw.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(dw.doc_id, coalesce(m.low, dw.doc_id)) AS component_id FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) m USING (doc_id)"""


def _op4() -> str:
    name = verdict = "NULL"
    for host, path, says in sorted(url_filters.RULES, key=lambda r: (len(r[0] + r[1]), r)):
        fits = f"((host = {_q(host)} OR ends_with(host, {_q('.' + host)})) AND starts_with(path, {_q(path)}))"
        name, verdict = f"CASE WHEN {fits} THEN {_q(host + path)} ELSE {name} END", f"CASE WHEN {fits} THEN {_q(says)} ELSE {verdict} END"
    u = url_filters
    levels = "t0 AS MATERIALIZED (SELECT host, path, bad, labelled, seg, rest, NULL::VARCHAR AS template FROM g),\n"
    for i in range(u.DEPTH):
        levels += f"""b{i} AS MATERIALIZED (SELECT host, template, seg[{i + 1}] AS name, sum(bad) AS bad, sum(labelled) AS labelled FROM t{i} WHERE len(seg) > {i} GROUP BY ALL),
u{i} AS (SELECT host, template, sum(bad) AS ab, sum(labelled) AS al, count(*) AS n FROM b{i} GROUP BY ALL),
c{i} AS (SELECT b.host, b.template, name, n = 1 OR (labelled >= {u.MIN_LABELS} AND al > labelled AND abs(bad::DOUBLE / labelled - (ab - bad)::DOUBLE / (al - labelled)) > {u.Z}::DOUBLE * sqrt(ab::DOUBLE / al * (1 - ab::DOUBLE / al) * (1::DOUBLE / labelled + 1::DOUBLE / (al - labelled)))) AS named FROM b{i} b JOIN u{i} u ON b.host = u.host AND b.template IS NOT DISTINCT FROM u.template),
t{i + 1} AS MATERIALIZED (SELECT t.host, path, bad, labelled, seg, rest, CASE WHEN len(seg) > {i} THEN concat_ws('/', t.template, CASE WHEN named THEN name ELSE '*' END) ELSE t.template END AS template FROM t{i} t LEFT JOIN c{i} c ON t.host = c.host AND t.template IS NOT DISTINCT FROM c.template AND seg[{i + 1}] = name),
"""
    return rf"""WITH r0 AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {name} AS rule, {verdict} AS says FROM r0),
p AS (SELECT host, path, count(*) AS pages, count_if(says = 'block') AS bad, count(says) AS labelled FROM r GROUP BY host, path),
g AS (SELECT *, len(string_split(path, '/')) > {u.DEPTH} AS rest, CASE WHEN path = '' THEN []::VARCHAR[] ELSE list_transform(string_split(path, '/')[1:{u.DEPTH}], lambda s: regexp_replace(s, '[0-9]+', '#', 'g')) END AS seg FROM p),
{levels}shaped AS (SELECT host, path, bad, labelled, CASE WHEN rest THEN template || '/**' ELSE coalesce(template, '') END AS template FROM t{u.DEPTH}),
prior AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(labelled), 0), 0) AS prior FROM shaped),
judged AS (SELECT host, template, (sum(bad) + {u.PRIOR_WEIGHT}::DOUBLE * any_value(prior)) / (sum(labelled) + {u.PRIOR_WEIGHT}::DOUBLE) AS share FROM shaped, prior GROUP BY host, template)
SELECT page_id, r.host, r.path, rule, s.template, coalesce(says, CASE WHEN share >= {u.REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict FROM r JOIN shaped s ON s.host = r.host AND s.path = r.path JOIN judged j ON j.host = s.host AND j.template = s.template"""


def _op5() -> str:
    known = ", ".join(f"({_q(i)}, {_q(s)})" for i, s in licenses.SENTENCES)
    match = [f"regexp_matches(',' || sequence || ',', {_q(',' + ',(.*,)?'.join(rule) + ',')})" for _, rule, _ in licenses.RULES]
    found = []
    for r, (name, _, _) in enumerate(licenses.RULES):
        better = [f" AND NOT {match[n]}" for n, (_, _, less) in enumerate(licenses.RULES) if name in less]
        found.append(f"CASE WHEN {match[r]}{''.join(better)} THEN {_q(name)} END")
    return rf"""WITH k(id, sentence) AS (VALUES {known}),
s AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([^.!?:;\n])\r?\n[ \t]*([a-z(])', '\1 \2', 'g'), '([.!?:;])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)) AS l FROM documents)),
m AS (SELECT doc_id, string_agg(id, ',' ORDER BY i) AS sequence FROM s JOIN k ON trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) = sentence GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(sequence, '') AS sequence FROM documents LEFT JOIN m USING (doc_id)),
f AS (SELECT *, list_sort(list_distinct(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))) AS names FROM d)
SELECT doc_id, sequence, CASE WHEN sequence = '' THEN '' WHEN len(names) = 0 THEN 'unrecognised' ELSE array_to_string(names, ',') END AS licenses FROM f"""


OP8 = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(r % 3 + 1)::BIGINT] AS wt, ss::DOUBLE * 3 AS most FROM s),
f AS (SELECT *, sum(ss) OVER ()::DOUBLE AS total, coalesce(sum(most) OVER o, 0.0::DOUBLE) AS stopped, sum(wt) OVER () - coalesce(sum(wt) OVER o, 0.0::DOUBLE) AS sharing FROM w WINDOW o AS (ORDER BY most / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CASE WHEN (total - stopped) / sharing * wt <= most THEN (total - stopped) / sharing END) OVER () AS level FROM f),
t AS (SELECT source, ss, docs, least(most, coalesce(level * wt, most)) AS target FROM l),
j AS (SELECT d.*, t.ss, t.docs, t.target, least(floor(CASE WHEN t.ss > 0 THEN t.target / t.ss ELSE 0 END), 3)::BIGINT AS certain, (('0x' || substr(md5('mix' || d.doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, greatest(least(CASE WHEN ss > 0 THEN target / ss ELSE 0.0::DOUBLE END - certain, 1 - 1e-12::DOUBLE), 1e-12::DOUBLE) AS share, CASE WHEN size = 0 THEN {mixing.SPREAD}::DOUBLE ELSE greatest(least((ss::DOUBLE / docs) / size, {mixing.SPREAD}::DOUBLE), {1 / mixing.SPREAD}::DOUBLE) END AS rel FROM j),
r AS (SELECT *, (u / (1 - u)) / (share / (1 - share) * rel) AS q FROM p),
b AS (SELECT *, target - certain * ss AS wanted, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT doc_id, size, ss AS source_size, target, (least(certain + (before + size / 2.0::DOUBLE <= wanted)::BIGINT, 3) * size)::BIGINT AS taken FROM b"""

_SAID = _q(f"{chat.END}{chat.START}assistant ok")
OP10 = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {_SAID} UNION ALL SELECT -1, 1, 'assistant', {_SAID})
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.START + chat.SEP + chat.END)} + length(role) + length(text) + len(regexp_extract_all(role, '<\|+')) + len(regexp_extract_all(text, '<\|+')))::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""

def _op11() -> str:
    b = ball_tree
    far = "list_sum(list_transform(range(1, len(k.p) + 1), lambda i: (k.p[i] - c.p[i]) * (k.p[i] - c.p[i])))::BIGINT"
    whole = f"list_transform(embedding, lambda x: greatest(least(floor({b.SCALE} * x::DOUBLE), {b.LARGEST}), -{b.LARGEST})::BIGINT)"
    sql = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {whole} AS p FROM embeddings WHERE len(embedding) = {b.DIMENSIONS} AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = {b.DIMENSIONS}),
c0 AS MATERIALIZED (SELECT j, p FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), p) - 1 AS j, p FROM kept) WHERE j < {b.CLUSTERS}),
"""
    for i in range(b.ROUNDS + 1):
        sql += f"a{i} AS MATERIALIZED (SELECT r, best[1] AS distance, best[2] AS j FROM (SELECT k.r, min([{far}, c.j]) AS best FROM kept k, c{i} c GROUP BY k.r)),\n"
        if i < b.ROUNDS:
            sql += f"""s{i} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT a.j, unnest(k.p) AS x, generate_subscripts(k.p, 1) AS i FROM kept k JOIN a{i} a USING (r)) GROUP BY j, i),
c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.p, c.p) AS p FROM c{i} c LEFT JOIN (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS p FROM s{i} GROUP BY j) m USING (j)),
"""
    return sql + f"""t AS (SELECT j, sum(distance)::BIGINT AS s FROM a{b.ROUNDS} GROUP BY j)
SELECT k.vec_id, a.j::INTEGER AS cluster, a.distance, t.s AS cluster_inertia, (SELECT sum(s) FROM t)::BIGINT AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256 FROM kept k JOIN a{b.ROUNDS} a USING (r) JOIN t USING (j) JOIN c{b.ROUNDS} c USING (j)"""


def _op13() -> str:
    after = "[2, 2, 3, 2]"  # by state, from 1 on
    kept = "CASE WHEN {s} = 0 AND x = 's' THEN 1 WHEN {s} IN (0, 1, 3) AND x = 'u' THEN 2 WHEN {s} = 2 AND x = 'a' THEN 3 END"
    before = ", ".join(f"least(3 + v[{s + 1}], CASE WHEN forced THEN 99999999 ELSE least(2 + t + v[{after}[{s + 1}] + 1], coalesce(t + v[({kept.format(s=s)}) + 1], 99999999)) END)" for s in range(4))
    return rf"""WITH RECURSIVE table256 AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, y: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda y: ascii(y)::BIGINT) AS code FROM conversations),
dealt AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, code), lambda c, y: xor(crc[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM given, table256),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM dealt, range(2) r(i) WHERE kind <> 0 AND (i = 0 OR kind = 3)),
placed AS (SELECT *, left(role, 1) AS x, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 64), left(text, 64)) AS k FROM damaged),
faults AS (SELECT *, CASE WHEN final = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 3 WHEN final IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault, lag(x) OVER (PARTITION BY conv_id ORDER BY k) AS px FROM placed),
turns AS MATERIALIZED (SELECT *, fault >= 2 AS forced, (fault = 1)::INTEGER AS t FROM faults),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 2) AS blank, count_if(fault = 3) AS duplicate, count_if(fault = 1) AS truncated, count_if(px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM turns GROUP BY conv_id),
back AS (SELECT conv_id, n + 1 AS k, [0, 4, 2, 0]::BIGINT[] AS v FROM counts
  UNION ALL SELECT conv_id, k, [least(w[1], 2 + least(w[3], 2 + w[4])), least(w[2], 2 + least(w[3], 2 + w[4])), least(w[3], 2 + w[4]), least(w[4], 2 + w[3])]::BIGINT[] FROM (SELECT b.conv_id, r.k, [{before}]::BIGINT[] AS w FROM back b JOIN turns r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.k = b.k - 1)),
costs AS MATERIALIZED (SELECT * FROM back),
walk AS (SELECT conv_id, 1::BIGINT AS k, 0 AS s, '' AS audit, []::VARCHAR[] AS lines FROM counts
  UNION ALL SELECT conv_id, CASE WHEN edit = 'I' THEN k ELSE k + 1 END, CASE edit WHEN 'D' THEN s WHEN 'K' THEN {kept.format(s='s')} ELSE {after}[s + 1] END, audit || edit,
    CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE WHEN s = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END) END
  FROM (SELECT w.*, r.x, r.role, r.text, CASE WHEN r.k IS NOT NULL AND b.v[s + 1] = 3 + a.v[s + 1] THEN 'D' WHEN b.v[s + 1] = 2 + b.v[{after}[s + 1] + 1] THEN 'I' WHEN b.v[s + 1] = t + a.v[({kept.format(s='s')}) + 1] THEN 'K' ELSE 'R' END AS edit
    FROM walk w JOIN costs b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.k = w.k LEFT JOIN turns r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k LEFT JOIN costs a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.k = w.k + 1 WHERE r.k IS NOT NULL OR b.v[s + 1] > 0)),
ended AS (SELECT w.conv_id, audit, sha256(array_to_string(lines, chr(10))) AS digest FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.k = c.n + 1 AND w.s IN (0, 3) QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY length(audit) DESC) = 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN costs b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.k = 1 LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1,
    "op2_decontamination": OP2,
    "op3_ngram_join": OP3,
    "op4_url_filters": _op4(),
    "op5_license_scan": _op5(),
    "op8_mixing": OP8,
    "op10_chat_formatting": OP10,
    "op11_centroid_clustering": _op11(),
    "op13_conversation_repair": _op13(),
}
