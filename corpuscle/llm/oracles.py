"""DuckDB SQL for the queries that SQL expresses at the size of the correctness run."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node)
SELECT node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = node GROUP BY node"""

_RATE = "({0}_f + m.{0}_mean * m.{0}_s) / (documents + m.{0}_s)"
_RULES = ("base", "symbols", "lines")


def _prior(rule: str) -> str:
    mean = f"sum({rule}_f) / sum(documents)"
    noise = f"(({mean}) * (1 - {mean}))"
    between = f"((sum({rule}_f * {rule}_f / documents) - sum(documents) * ({mean}) * ({mean}) - (count(*) - 1) * {noise}) / nullif(sum(documents) - sum(documents * documents) / sum(documents), 0))"
    return f"{mean} AS {rule}_mean, CASE WHEN {between} > 0 THEN least(1e6, greatest(1.0, {noise} / {between} - 1)) ELSE 1e6 END AS {rule}_s"


OP8 = rf"""WITH w AS (SELECT doc_id, source AS host, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '{WORD}')) AS ls FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w WHERE len(ws) >= 5),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
b AS (SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
(len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT host, count(*)::DOUBLE AS documents, sum(base_failed::INT)::DOUBLE AS base_f, sum((n_words < 2 * n_symbols)::INT)::DOUBLE AS symbols_f, sum((n_words < 10 * n_dup_lines)::INT)::DOUBLE AS lines_f FROM f GROUP BY host),
m AS (SELECT {', '.join(map(_prior, _RULES))} FROM h),
v AS (SELECT host, greatest({', '.join(_RATE.format(r) for r in _RULES)}) > 0.5 AS host_failed FROM h, m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, NOT base_failed AND NOT host_failed AS kept FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host"""

SQL = {"op2_ngram_jaccard_join": OP2, "op8_quality_rules": OP8}
