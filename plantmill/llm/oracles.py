"""DuckDB SQL for the queries that SQL can express, made from the same fixed values and parameters."""

from __future__ import annotations

import re

from plantmill.llm import chat, manifest, quality, urls

WHITE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = urls.UPPER, urls.LOWER


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op3() -> str:
    rules = ", ".join(f"({_quoted(h)}, {_quoted(p)}, {_quoted(v)})" for h, p, v in urls.RULES)
    host = lambda url: rf"translate(regexp_extract(regexp_replace({url}, '^[\s\S]*?://', ''), '^[^/?#]*'), '{UPPER}', '{LOWER}')"
    link = r"""(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']"""
    rounds = lambda name: "".join(
        f""",
{name}{k + 1} AS (SELECT n.kind, n.u, n.w, {1 - urls.DAMPING!r} * n.w + {urls.DAMPING} * coalesce(g.got, 0.0) AS s
  FROM {name}{k} n LEFT JOIN (SELECT kind, v, sum(s * p) AS got FROM {name}{k} JOIN step USING (kind, u) GROUP BY kind, v) g ON n.kind = g.kind AND n.u = g.v)"""
        for k in range(urls.ROUNDS)
    )
    return rf"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
own AS (SELECT page_id, html,
    CASE WHEN contains(url, '://') THEN {host('url')} ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(regexp_replace(url, '^[\s\S]*?://[^/?#]*', ''), '^[^?#]*') ELSE '' END AS path FROM pages),
placed AS (SELECT page_id, html, coalesce(host, '') AS host, coalesce(path, '') AS path FROM own),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS href FROM placed WHERE host <> '' AND html IS NOT NULL),
full_links AS (SELECT src, CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END AS href FROM links),
targets AS (SELECT src, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {host('href')} ELSE src END AS dst FROM full_links),
edges AS (SELECT src, dst, count(*) AS n FROM targets WHERE dst <> '' GROUP BY src, dst),
ranked AS (SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.rule_verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST, r.rule_host || r.rule_path) AS k
  FROM placed p LEFT JOIN rules r ON p.host <> '' AND (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)),
ruled AS (SELECT page_id, host, path, rule, rule_verdict FROM ranked WHERE k = 1),
seeds AS (SELECT host, avg(CASE WHEN rule_verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS t, avg(CASE WHEN rule_verdict = 'block' THEN 1.0 ELSE 0.0 END) AS d FROM ruled WHERE host <> '' GROUP BY host),
walk AS (SELECT 't' AS kind, src AS u, dst AS v, n FROM edges UNION ALL SELECT 'd', dst, src, n FROM edges),
hosts AS (SELECT src AS u FROM edges UNION SELECT dst FROM edges UNION SELECT host FROM seeds),
nodes AS (SELECT kind, u FROM hosts, (VALUES ('t'), ('d')) k(kind)),
totals AS (SELECT kind, u, sum(n) AS total FROM walk GROUP BY kind, u),
step AS (SELECT w.kind, w.u, w.v, n / total AS p FROM walk w JOIN totals USING (kind, u)
  UNION ALL SELECT kind, u, u, 1.0 FROM nodes ANTI JOIN totals USING (kind, u)),
s0 AS (SELECT n.kind, n.u, coalesce(CASE WHEN n.kind = 't' THEN s.t ELSE s.d END, 0.0)::DOUBLE AS w, coalesce(CASE WHEN n.kind = 't' THEN s.t ELSE s.d END, 0.0)::DOUBLE AS s FROM nodes n LEFT JOIN seeds s ON s.host = n.u){rounds('s')},
found AS (SELECT u AS host, sum(CASE WHEN kind = 't' THEN s ELSE 0 END) AS trust, sum(CASE WHEN kind = 'd' THEN s ELSE 0 END) AS distrust FROM s{urls.ROUNDS} GROUP BY u),
apart AS (SELECT f.host, CASE WHEN distrust = 0 THEN 1.0 WHEN coalesce(d, 0) > 0 THEN 1.0 - d ELSE 0.0 END::DOUBLE AS w FROM found f LEFT JOIN seeds s ON s.host = f.host),
c0 AS (SELECT 'd' AS kind, host AS u, w, w AS s FROM apart){rounds('c')},
final AS (SELECT f.*, c.s AS clean FROM found f JOIN c{urls.ROUNDS} c ON c.u = f.host)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.rule_verdict, CASE WHEN f.distrust * {urls.NEAR!r} >= {urls.LEAST} * (f.distrust + f.clean) AND f.distrust > f.trust * {urls.NEAR!r} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN final f ON f.host = r.host"""


def _op7() -> str:
    t = chat.Template()
    by_first = {f: "|".join(re.escape(c[1:]) for c in sorted(t.control, key=len, reverse=True) if c[0] == f) for f in sorted({c[0] for c in t.control})}

    def escaped(x: str) -> str:
        out = rf"regexp_replace({x}, '\\', '\\\\', 'g')"
        for first, rest in by_first.items():
            out = rf"regexp_replace({out}, '({re.escape(first)})({rest})', '\1\\\2', 'g')"
        return out

    frame = len(t.open) + len(t.role_end) + len(t.close)
    legal = " OR ".join(f"(before = {_quoted(s)} AND role IN ({', '.join(map(_quoted, n))}))" for s, n in t.follows.items())
    roles = ", ".join(map(_quoted, t.loss_roles))
    return rf"""
WITH own(conv_id, turn, role, text) AS (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM own)),
placed AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), '') AS before FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role IN ({roles})), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role IN ({roles})), '')) AS loss_sha256,
  sum(length({escaped('role')}) + length({escaped('text')}) + {frame})::BIGINT AS formatted_chars,
  bool_and({legal}) AS in_order
FROM placed GROUP BY conv_id"""


def _op9() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT s.doc_id, s.i, s.n, w.item_id FROM spots s JOIN windows w ON s.n = w.n AND s.k = w.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def quality_judged(source: str = "documents") -> str:
    """A SELECT of doc_id, the base counts, base_failed and kept over a table of documents."""
    r, n, m = quality.Rules(), len(quality.CLASSES), len(quality.WORDS)
    without = lambda c: f"length(text) - length(regexp_replace(text, '[{c}]+', '', 'g'))"
    listed = "[" + ", ".join(map(_quoted, quality.WORDS)) + "]"
    term = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2.0 * {x} / ({x} + {y})) ELSE 0.0 END"
    js = lambda p, q, k: f"sqrt(greatest(0.0, list_sum([{term(f'{p}[i]', f'{q}[i]')} + {term(f'{q}[i]', f'{p}[i]')} for i in range(1, {k} + 1)]) / 2))"
    with_rest = lambda c, total: f"list_concat([x / {total} for x in {c}], [1.0 - list_sum([x / {total} for x in {c}])])"
    none = "[" + "0.0, " * m + "1.0]"
    sums = lambda c, k: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(k)) + "]"
    return rf"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND (n_chars < {r.least_chars} OR ref_c IS NULL OR {js(with_rest('cls', 'n_chars'), 'ref_c', n + 1)} <= {r.class_distance})
  AND (ref_w IS NULL OR n_words * (1.0 - ref_w[{m + 1}]) < {r.least_common} OR {js(with_rest('cw', 'n_words'), 'ref_w', m + 1)} < {r.missing_share} * {js(none, 'ref_w', m + 1)}) AS kept
FROM (
  SELECT f.*, n_words < {r.least_words} OR 100 * n_repeat_words > {r.most_repeat_percent} * n_words AS base_failed, ref_c, ref_w
  FROM (
    SELECT t.doc_id, t.lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(text) AS n_chars,
      [{', '.join(without(c) for c in quality.CLASSES.values())}] AS cls, [len([x for x in common if x = k]) for k in {listed}] AS cw, len(common) AS n_common
    FROM (SELECT *, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines, [lower(x) for x in w if list_contains({listed}, lower(x))] AS common
      FROM (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, [x for x in string_split_regex(coalesce(text, ''), '{WHITE}') if x <> ''] AS w FROM {source})) t
    LEFT JOIN (
      WITH spots AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i
        FROM (SELECT doc_id, [x for x in string_split_regex(coalesce(text, ''), '{WHITE}') if x <> ''] AS w FROM {source}) WHERE len(w) >= 5)),
      twice AS (SELECT doc_id, k FROM spots GROUP BY doc_id, k HAVING count(*) > 1)
      SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM spots SEMI JOIN twice USING (doc_id, k)) GROUP BY doc_id) rep ON rep.doc_id = t.doc_id) f
  LEFT JOIN (
    SELECT lang, {with_rest('c', 'chars')} AS ref_c, {with_rest('w', 'n_all')} AS ref_w FROM (
      SELECT lang, sum(n_chars) AS chars, sum(n_words) AS n_all, {sums('cls', n)} AS c, {sums('cw', m)} AS w FROM (
        SELECT lang, length(text) AS n_chars, n_words, [{', '.join(without(c) for c in quality.CLASSES.values())}] AS cls, [len([x for x in common if x = k]) for k in {listed}] AS cw
        FROM (SELECT *, len([x for x in string_split_regex(text, '{WHITE}') if x <> '']) AS n_words, [lower(x) for x in string_split_regex(text, '{WHITE}') if list_contains({listed}, lower(x))] AS common
          FROM (SELECT coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM {source})))
      GROUP BY lang HAVING count(*) >= {r.least_docs})) refs ON refs.lang = f.lang)"""


def _op13() -> str:
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"
    leaf = lambda text: f"sha256({' || '.join(field(text if c == 'text' else c) for c in manifest.FIELDS)})"
    w = manifest.WIDTH
    tree = lambda name, base: f"""{name} AS ({base} UNION ALL
  SELECT key, level + 1, [sha256(array_to_string(nodes[i : i + {w - 1}], '')) for i in range(1, len(nodes) + 1, {w})] FROM {name} WHERE len(nodes) > 1)"""  # noqa: E731
    steps = lambda name, rows, tree: f"""{name} AS (SELECT id, list(array_to_string(nodes[{w} * (own // {w}) + 1 : own], '') || '.' || array_to_string(nodes[own + 2 : {w} * (own // {w}) + {w}], '') ORDER BY level) AS steps
  FROM (SELECT id, level, nodes, pos // ({w} ** level)::BIGINT AS own FROM {rows} JOIN {tree} USING (key) WHERE len(nodes) > 1) GROUP BY id)"""  # noqa: E731
    return f"""
WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
ids AS (SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table),
own AS (SELECT d.*, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents d LEFT JOIN ids USING (doc_id)),
hashed AS (SELECT doc_id, coalesce('=' || source, '') AS key, {leaf('text')} AS leaf, {leaf('changed')} AS offered FROM own),
leaves AS (SELECT *, row_number() OVER (ORDER BY key, doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
{tree('trees', "SELECT key, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY key")},
subroots AS (SELECT key AS source_key, nodes[1] AS subroot, '' AS key, row_number() OVER (ORDER BY key) AS id, row_number() OVER (ORDER BY key) - 1 AS pos FROM trees WHERE len(nodes) = 1),
{tree('tops', "SELECT key, 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots GROUP BY key")},
{steps('low', 'leaves', 'trees')},
{steps('high', 'subroots', 'tops')},
proofs AS (SELECT doc_id, leaf, offered, subroot, list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
  FROM leaves l JOIN subroots s ON s.source_key = l.key LEFT JOIN low ON low.id = l.id LEFT JOIN high ON high.id = s.id),
folded AS (SELECT *, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root, list_reduce(list_prepend(offered, steps), lambda h, s: sha256(replace(s, '.', h))) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '.', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


ORACLES: dict[str, str] = {"op3_url_filter": _op3(), "op7_chat": _op7(), "op9_decontaminate": _op9(), "op10_quality": quality_judged(), "op13_merkle_manifest": _op13()}
