"""DuckDB twins of the training-data queries (where SQL can express them).

Left out, and tested against plain versions in ``tests/llm``: the packing (a
heuristic's places), the secret scan (match positions and a trained field), the
main text (inferred wrappers), toxicity (a trained model) and the pipeline.
"""

from __future__ import annotations

from txnlens.llm.chat import BEGIN
from txnlens.llm.queries import CHAT_PROBE, URL_RULES
from txnlens.llm.urls import LISTED_DIGIT

#: ``string_split_regex`` leaves empty ends; they are no words
WORDS = r"list_filter(string_split_regex({t}, '{sep}'), lambda x: x <> '')"
SPACE = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, sep: str, lower: bool) -> str:
    text = f"coalesce({text}, '')"
    if lower:
        text = f"translate({text}, '{UPPER}', '{LOWER}')"
    return WORDS.format(t=text, sep=sep)


OP1 = f"""WITH d AS (SELECT doc_id, {_words('text', SPACE, False)} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
least AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
cut AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone
        FROM win JOIN least USING (g) WHERE first < doc_id GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

_RULES = ", ".join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in URL_RULES)
OP2 = f"""WITH r AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
c AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') AS canonical FROM p),
spam AS (SELECT DISTINCT canonical FROM c WHERE canonical <> '' AND starts_with(sha256(canonical), '{LISTED_DIGIT}')),
rules(rule, rhost, rpath, rverdict) AS (VALUES {_RULES}),
best AS (SELECT page_id, max(struct_pack(n := length(rule), rule := rule, v := rverdict)) AS b
         FROM c JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT c.page_id, host, path, b.rule AS rule, coalesce(b.v, CASE WHEN s.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       s.canonical IS NOT NULL AS listed
FROM c LEFT JOIN best USING (page_id) LEFT JOIN spam s ON s.canonical = c.canonical"""

# the products are added in component order, as the operator adds them
OP3 = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
    AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(generate_series(1, len(q.e)), lambda k: q.e[k] * c.e[k]), lambda a, b: a + b) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

_PROBE = f"(-1, 0, 'user', '{CHAT_PROBE}'), (-1, 1, 'assistant', '{CHAT_PROBE}')"
OP4 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {_PROBE}) p(conv_id, turn, role, text)),
f AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\\\\\[<]', '', 'g'))
    + CASE role WHEN 'assistant' THEN 5 WHEN 'user' THEN 15
      ELSE 16 + length(role) + length(regexp_replace(role, '[^\\\\\\[<\\]]', '', 'g')) END AS n FROM t),
c AS (SELECT *, sum(n) OVER w AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
      FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto + {len(BEGIN)}) FILTER (WHERE role = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars,
       count(*) FILTER (WHERE role = 'assistant') AS n_examples
FROM c GROUP BY conv_id"""

OP8 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words('text', SPACE, True)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.x, reach.r FROM reach JOIN link l ON l.y = reach.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r) AS component_id, min(r) = d.doc_id AS kept
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n"""

OP9 = f"""WITH d AS (SELECT doc_id, {_words('text', NON_WORD, True)} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, least(len(w), 13) AS n
      FROM (SELECT item_id, {_words('text', NON_WORD, True)} AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
win AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT doc_id, len(list_distinct(flatten(list(range(i, i + n))))) AS hit, list_sort(list_distinct(list(item))) AS items
      FROM win JOIN g USING (n, g) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(hit > 0 AND 20 * hit >= len(w), false) AS contaminated
FROM d LEFT JOIN h USING (doc_id)"""


ENDS = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT *, translate(trim(x, {ENDS}), '{UPPER}', '{LOWER}') AS k
      FROM (SELECT r, doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM d)),
least AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT coalesce(first < doc_id, false)), '')) AS kept_sha256
FROM l LEFT JOIN least USING (k) GROUP BY r, doc_id"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = "-1, " * 7 + "-1"
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), {bits}]))"
    step = (
        "lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) "
        "ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END"
    )
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), {step}), 4294967295)"


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in fields) + ")"


_STEPS = """SELECT *, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' ||
             coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step
      FROM {t} WHERE n > 1 WINDOW w AS (PARTITION BY tree, lvl, pos // 16 ORDER BY pos)"""
_UP = """SELECT tree, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM {t} WHERE n > 1
      GROUP BY tree, lvl, pos // 16, n"""
OP12 = f"""WITH RECURSIVE l AS (SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS tree, {_leaf('text')} AS leaf,
  CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS altered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
up(tree, lvl, pos, n, h) AS (SELECT tree, 0, pos, n, leaf FROM p UNION ALL {_UP.format(t='up')}),
subs AS (SELECT tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(tree, lvl, pos, n, h) AS (SELECT '', 0, pos, n, h FROM subs UNION ALL {_UP.format(t='top')}),
low AS ({_STEPS.format(t='up')}),
high AS ({_STEPS.format(t='top')}),
way AS (SELECT r, lvl, step FROM p JOIN low USING (tree) WHERE low.pos = p.pos // CAST(pow(16, lvl) AS BIGINT)
  UNION ALL SELECT r, 1000 + lvl, step FROM p JOIN subs ON name = tree JOIN high ON high.pos = subs.pos // CAST(pow(16, lvl) AS BIGINT)),
proof AS (SELECT r, list(step ORDER BY lvl) AS steps FROM way GROUP BY r),
f AS (SELECT doc_id, leaf, subs.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(steps, CAST([] AS VARCHAR[])) AS steps,
        list_reduce(list_prepend(coalesce(altered, leaf), coalesce(steps, CAST([] AS VARCHAR[]))),
                    lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
      FROM p JOIN subs ON name = tree LEFT JOIN proof USING (r))
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root,
       folded_root = root AS verified FROM f"""


_NAMED = "coalesce(CAST({c} AS VARCHAR), ' ')"
_KIND = crc32_sql(f"{_NAMED.format(c='conv_id')} || ':' || {_NAMED.format(c='turn')}") + " % 20"
_INSERTS = ", ".join(
    f"('{q}', '{r}', '{a}', {3 * len(a)})"
    for q, way in (("", "ua"), ("s", "ua"), ("u", "au"), ("a", "ua"))
    for a, r in (("", q), ("I", way[0]), ("II", way[1]))
)
_EDITS = ", ".join(
    [f"('D', '{q}', NULL, '{q}', 4)" for q in ("", "s", "u", "a")]
    + [f"('R', '{q}', NULL, '{r}', 3)" for q, r in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u"))]
    + [f"('K', '{q}', '{r}', '{r}', 0)" for q, r in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u"))]
)
OP13 = f"""WITH RECURSIVE src AS (SELECT conv_id, turn, {_NAMED.format(c='role')} AS role, {_NAMED.format(c='text')} AS text, {_KIND} AS kind FROM conversations),
dam AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE kind <> 0),
o AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), '') AS k, left(role, 1) AS r0, rtrim(text, {ENDS}) AS e,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 32), left(text, 32), sha256(length(role) || ':' || role || text)) AS i FROM dam),
f AS (SELECT *, coalesce(lag(r0) OVER (PARTITION BY k ORDER BY i) || r0 NOT IN ('su', 'ua', 'au'), false) AS illegal,
             CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
                  WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
ins(q, q2, a, c) AS (VALUES {_INSERTS}),
ed(op, q, r, q2, c) AS (VALUES {_EDITS}),
best(k, i, q, b) AS (SELECT DISTINCT k, CAST(0 AS BIGINT), '', {{'c': 0, 'a': ''}} FROM f UNION ALL
  SELECT best.k, best.i + 1, ed.q2, min({{'c': b.c + ins.c + ed.c + CASE WHEN fault = 'truncated' AND op <> 'D' THEN 3 ELSE 0 END, 'a': b.a || ins.a || op}})
  FROM best JOIN f ON f.k = best.k AND f.i = best.i + 1 JOIN ins ON ins.q = best.q
  JOIN ed ON ed.q = ins.q2 AND (op = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (op = 'R' OR r = r0)))
  GROUP BY best.k, best.i, ed.q2),
s AS (SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (illegal) AS illegal FROM f GROUP BY k),
fin AS (SELECT k, min({{'c': b.c + ins.c, 'a': b.a || ins.a}}) AS b FROM best JOIN s USING (k) JOIN ins USING (q) WHERE i = n AND ins.q2 IN ('', 'a') GROUP BY k),
x AS (SELECT k, unnest(string_split(b.a, '')) AS op, unnest(range(len(b.a))) AS p FROM fin),
y AS (SELECT *, count(*) FILTER (op <> 'I') OVER w AS i, count(*) FILTER (op <> 'D') OVER w AS place FROM x WINDOW w AS (PARTITION BY k ORDER BY p)),
z AS (SELECT y.k, p, op, place, role, text, max(CASE WHEN op = 'K' AND r0 = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY y.k) AS has_system
      FROM y LEFT JOIN f ON f.k = y.k AND f.i = y.i AND op <> 'I' WHERE op <> 'D'),
rep AS (SELECT k, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (place - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS h
        FROM z GROUP BY k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(fin.b.c, 0) AS BIGINT) AS cost, coalesce(fin.b.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS k FROM conversations) LEFT JOIN s USING (k) LEFT JOIN fin USING (k) LEFT JOIN rep USING (k)"""


def llm_oracle() -> dict[str, str]:
    return {
        "op1_substring": OP1,
        "op2_url_filter": OP2,
        "op3_nearest": OP3,
        "op4_chat_format": OP4,
        "op8_minhash": OP8,
        "op9_decontamination": OP9,
        "op11_line_dedup": OP11,
        "op12_merkle": OP12,
        "op13_conversation_repair": OP13,
    }
