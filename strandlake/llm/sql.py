"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UP}', '{LOW}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""

NEAR = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN list_aggregate(words, 'string_agg', ' ')
         ELSE list_aggregate(words[i:i + 4], 'string_agg', ' ') END AS shingle
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_OPEN = "'<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)"


def _rendered(turns: str) -> str:
    return f"coalesce(list_aggregate(list_transform({turns}, lambda t: {_OPEN}), 'string_agg', ''), '')"


def _masked(turns: str) -> str:
    sizes = f"list_transform({turns}, lambda t: length({_OPEN}))"
    ends = f"list_transform(range(1, len({turns}) + 1), lambda i: list_sum(({sizes})[1:i]))"
    one = f"lambda i: (({ends})[i] - length(({turns})[i].text) - 8)::BIGINT || ':' || (({ends})[i])::BIGINT"
    who = f"list_filter(range(1, len({turns}) + 1), lambda i: ({turns})[i].role = 'assistant')"
    return f"coalesce(list_aggregate(list_transform({who}, {one}), 'string_agg', ','), '')"


CHAT = f"""
WITH c AS (
  SELECT conv_id, list({{'role': coalesce(role, 'user'), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS turns
  FROM conversations GROUP BY 1),
p AS (
  SELECT coalesce(a.conv_id, b.conv_id) // 2 AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.turns AS a, b.turns AS b
  FROM (SELECT * FROM c WHERE conv_id % 2 = 0) a FULL JOIN (SELECT * FROM c WHERE conv_id % 2 = 1) b ON a.conv_id // 2 = b.conv_id // 2),
n AS (
  SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE
    coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) END AS k FROM p),
x AS (SELECT *, a[k + 1:] AS ra, b[k + 1:] AS rb FROM n)
SELECT pair_id, chosen_id, rejected_id, k::INT AS n_prompt_turns,
       CASE WHEN k = 0 THEN '' ELSE {_rendered('a[1:k]')} END AS prompt,
       CASE WHEN a IS NOT NULL THEN {_rendered('ra')} END AS chosen_completion,
       CASE WHEN b IS NOT NULL THEN {_rendered('rb')} END AS rejected_completion,
       CASE WHEN a IS NOT NULL THEN {_masked('ra')} END AS chosen_mask,
       CASE WHEN b IS NOT NULL THEN {_masked('rb')} END AS rejected_mask
FROM x
"""

MIX = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents),
s AS (SELECT source, sum(n)::DOUBLE AS t FROM d GROUP BY 1),
g AS (
  SELECT k, ln(sum(u)) - sum(u * ln(u)) / sum(u) AS h, ln(count(*)) AS top, max(u / t) * max(t / u) AS rep
  FROM (SELECT k, t, pow(t, k / 1024.0::DOUBLE) AS u FROM s, range(0, 1025) r(k) WHERE t > 0) GROUP BY k),
k AS (SELECT greatest(max(k) FILTER (WHERE h >= 0.9 * top - 1e-9), min(k) FILTER (WHERE rep <= 4.0 + 1e-9)) AS k FROM g),
z AS (SELECT max(t / pow(t, k / 1024.0::DOUBLE)) AS most FROM s, k WHERE t > 0),
q AS (
  SELECT source, t::BIGINT AS t, CASE WHEN t > 0 THEN greatest(floor(pow(t, k / 1024.0::DOUBLE) * most + 1e-6), 0) ELSE 0 END::BIGINT AS quota,
         greatest(ceil(t / 100000), 1)::BIGINT AS nb
  FROM s, k, z),
b AS (
  SELECT doc_id, d.source, n, t, quota, ('0x' || md5(doc_id::VARCHAR)[1:12])::BIGINT % nb AS block
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
e AS (
  SELECT *, unnest(range(0, CASE WHEN t > 0 THEN greatest(floor((quota - 1) / t), 0) ELSE 0 END::BIGINT + 1)) AS epoch
  FROM (SELECT source, block, sum(n)::BIGINT AS bn, max(t) AS t, max(quota) AS quota FROM b GROUP BY 1, 2)),
f AS (
  SELECT *, epoch * t + coalesce(sum(bn) OVER (PARTITION BY source, epoch ORDER BY md5(block || ':' || epoch || ':block'), block
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM e),
o AS (
  SELECT b.doc_id, b.source, f.epoch, b.block, b.n AS n_tokens, b.quota, f.at + coalesce(sum(b.n) OVER (PARTITION BY b.source, b.block, f.epoch
         ORDER BY md5(b.doc_id || ':' || f.epoch), b.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM b JOIN f ON b.source IS NOT DISTINCT FROM f.source AND b.block = f.block
  WHERE (f.at < f.quota OR (f.epoch = 0 AND f.quota >= f.t)) AND (b.n > 0 OR f.epoch = 0))
SELECT doc_id, source, epoch, block, n_tokens, start FROM o WHERE start < quota OR n_tokens = 0
"""


def _matches(kind: str, no: int, pattern: str, group: int, least: int) -> str:
    """One row per document: the kept spans of one rule, from the text between matches and the matches themselves."""
    quoted = pattern.replace("'", "''")
    return f"""
SELECT doc_id, '{kind}' AS kind, {no} AS no, begin, stop FROM (
  SELECT doc_id, own, (list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i - 1]), 0))::BIGINT AS begin,
         (list_sum(gaps[1:i]) + list_sum(lens[1:i]))::BIGINT AS stop
  FROM (
    SELECT doc_id, unnest(range(1, len(lens) + 1)) AS i, gaps, lens, unnest(owns) AS own FROM (
      SELECT doc_id, list_transform(regexp_split_to_array(body, '{quoted}'), lambda x: length(x)) AS gaps,
             list_transform(regexp_extract_all(body, '{quoted}'), lambda x: length(x)) AS lens,
             list_transform(regexp_extract_all(body, '{quoted}', {group}), lambda x: length(x)) AS owns
      FROM t WHERE regexp_matches(body, '{quoted}'))))
WHERE own >= {least}"""


def _secrets() -> str:
    from strandlake.llm.secret_scan import BASE_RULES, RULES

    parts = []
    for no, r in enumerate(RULES):
        pattern = "[0-9a-f]{32,}" if r.kind == "hex" else ("(?i)" if r.ignore_case else "") + r.pattern
        parts.append(_matches(r.kind, no, pattern, r.group, r.least))
    counts = ", ".join(f"coalesce(len(list_filter(all_spans, lambda s: s.no = {i})), 0)::BIGINT AS n_{r.kind}" for i, r in enumerate(BASE_RULES))
    text = "coalesce(list_aggregate(list_transform({}, lambda s: s.kind || ':' || s.begin || ':' || s.stop), 'string_agg', ','), '')"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
m AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, list({{'begin': begin, 'no': no, 'kind': kind, 'stop': stop}} ORDER BY begin, no, stop) AS all_spans FROM m GROUP BY 1)
SELECT t.doc_id, {counts},
       sha256({text.format(f'list_filter(all_spans, lambda s: s.no < {len(BASE_RULES)})')}) AS base_sha256,
       {text.format('all_spans')} AS spans
FROM t LEFT JOIN g USING (doc_id)
"""


ORACLE = {
    "op1_exact_dedup": EXACT,
    "op3_minhash_near_dedup": NEAR,
    "op4_chat_format": CHAT,
    "op8_secret_scan": _secrets(),
    "op10_mixing": MIX,
}
