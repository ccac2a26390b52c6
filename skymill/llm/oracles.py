"""DuckDB SQL for the training-data queries that SQL can express: op3, op9, op10 and op11."""

from __future__ import annotations


WORD = r"[^\x20\x09-\x0D]+"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Kind, pattern, group of the value and its shortest length: written here once more, for RE2, so that a wrong pattern of the operator shows.
SECRET_KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("vendor", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35,}", 0, 0),
    ("url", r"://[^\s/:@]{1,64}:[^\s/:@]{1,64}@", 0, 0),
    ("opaque", r"[A-Za-z0-9+/_-]+", 0, 24),
)


def _secrets() -> str:
    found = []
    for i, (name, pattern, group, shortest) in enumerate(SECRET_KINDS):
        p = _text(pattern)
        found.append(f"""SELECT row, owner, {i} AS ord, '{name}' AS kind, val[i] AS v, m[i] AS whole,
  CAST(list_sum(list_transform(seg[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start, {shortest} AS shortest
  FROM (SELECT row, owner, m, val, seg, unnest(list_filter(generate_series(1, len(m)), lambda i: length(val[i]) >= {shortest})) AS i FROM (SELECT row, owner, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS val, string_split_regex(t, {p}) AS seg FROM d))""")
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(found)}),
g AS (SELECT *, start + length(whole) AS stop FROM f WHERE length(v) >= shortest),
named AS (SELECT * FROM g WHERE kind <> 'opaque'),
o AS (SELECT * FROM g WHERE kind = 'opaque' AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')
  AND NOT EXISTS (SELECT 1 FROM named n WHERE n.row = g.row AND n.start < g.stop AND g.start < n.stop)),
s AS (SELECT * FROM named UNION ALL SELECT * FROM o),
own AS (SELECT v, count(DISTINCT coalesce(owner, chr(1))) AS n_owners, count(DISTINCT row) AS n_repos FROM s GROUP BY v),
j AS (SELECT s.*, n_owners, n_repos, CASE WHEN n_owners >= 3 OR n_repos >= 10 THEN 'example' WHEN n_owners = 1 AND regexp_matches(s.v, '[0-9]') AND NOT regexp_matches(s.v, '(?i)example|changeme|placeholder|your|xxxx|dummy|sample') THEN 'live' ELSE 'unsure' END AS verdict FROM s JOIN own USING (v)),
kept AS (SELECT *, kind || ':' || start || ':' || stop AS span FROM j WHERE kind <> 'opaque' OR verdict = 'live'),
a AS (SELECT row, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, ord) FILTER (WHERE ord < 3) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans,
  count_if(verdict = 'live') AS n_live, count_if(verdict = 'example') AS n_example, max(n_repos) AS most_repos, max(n_owners) AS most_owners FROM kept GROUP BY row)
SELECT doc_id, {', '.join(f'CAST(coalesce({n}, 0) AS BIGINT) AS {n}' for n in ('n_assign', 'n_access', 'n_hex', 'n_live', 'n_example', 'most_repos', 'most_owners'))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (row)"""


def _embeddings() -> str:
    return """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9e0),
reach AS (SELECT vec_id AS v, vec_id AS r FROM v UNION SELECT reach.v, link.b FROM reach JOIN link ON reach.r = link.a),
comp AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp ON comp.v = vec_id LEFT JOIN n ON n.a = vec_id"""


def _quality() -> str:
    """The rules' limits are written here once more, so that a wrong one of the operator shows."""
    return rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
s AS (SELECT row, regexp_extract_all(t, '{WORD}') AS w, string_split(t, chr(10)) AS lines, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
p AS (SELECT row, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM s),
tri AS (SELECT row, i, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY row ORDER BY i)),
again AS (SELECT row, i, count(*) OVER (PARTITION BY row, w1, w2, w3) AS k FROM tri WHERE w3 IS NOT NULL),
rep AS (SELECT row, count(DISTINCT i + x) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) o(x) WHERE k > 1 GROUP BY row),
ln AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT row, unnest(lines) AS line FROM s) WHERE regexp_matches(line, '{WORD}') GROUP BY row),
c AS (SELECT d.doc_id, d.host, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d JOIN s USING (row) LEFT JOIN rep USING (row) LEFT JOIN ln USING (row)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
j AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed FROM f),
h AS (SELECT host, count(*) AS n, count_if(failed) AS k FROM j WHERE host IS NOT NULL GROUP BY host),
m AS (SELECT sum(k) / sum(n) AS mean FROM h),
b AS (SELECT any_value(mean) AS mean, avg(pow(k / n - mean, 2)) - any_value(mean * (1 - mean)) * avg(1 / n) AS between_hosts FROM h, m),
prior AS (SELECT mean, greatest(1e0, least(1e2, mean * (1 - mean) / greatest(between_hosts, 1e-9) - 1)) AS strength FROM b),
r AS (SELECT host, mean, (k + mean * strength) / (n + strength) AS rate, n + strength AS size FROM h, prior),
low AS (SELECT *, rate - 2 * sqrt(rate * (1 - rate) / (size + 1)) AS low FROM r),
verdict AS (SELECT host, rate, low > mean + 0.5e0 * (1 - mean) AS rejected, low > 1.5e0 * mean AS suspect FROM low)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AND NOT (failed AND coalesce(suspect, false)) AS kept, failed,
  round(rate, 6) AS host_rate, coalesce(rejected, false) AS host_rejected, coalesce(suspect, false) AS host_suspect FROM j LEFT JOIN verdict USING (host)"""


def _divergence() -> str:
    share = "1 + CAST(1000000000 AS HUGEINT) * (n + 1) // nullif(total + v, 0)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
own AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(l.v), 0) AS v FROM d LEFT JOIN l USING (lang) GROUP BY d.lang, d.source),
gn AS (SELECT g.*, coalesce(s.total, 0) AS total FROM g LEFT JOIN (SELECT lang, source, sum(n) AS total FROM own GROUP BY lang, source) s USING (lang, source)),
p AS (SELECT gn.lang, gn.source, k.term, {share.replace('(n + 1)', '(coalesce(own.n, 0) + 1)')} AS p, coalesce(own.n, 0) AS n FROM gn JOIN (SELECT lang, term FROM kept) k USING (lang) LEFT JOIN own ON own.lang = gn.lang AND own.source = gn.source AND own.term = k.term),
q AS (SELECT kept.lang, kept.term, {share} AS q FROM kept JOIN l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
parts AS (SELECT 'pair' AS part, * FROM every UNION ALL SELECT 'term' AS part, * FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item) AS r FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 200"""


ORACLE_SQL = {"op3_secret_ownership": _secrets(), "op9_embedding_neighbours": _embeddings(), "op10_host_quality": _quality(), "op11_divergence_audit": _divergence()}
