"""DuckDB twins of the numbered queries that SQL can express."""

from gistmeter.llm import ranked_search, secret_scan

OP1 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST)
"""

OP8 = r"""
WITH l AS (SELECT doc_id, i, lines[i] AS line,
                  trim(translate(lines[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
           FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
                 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
     r AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
     m AS (SELECT l.*, r.k IS NOT NULL AND r.first <> l.doc_id AS gone FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

# conversation -1 is added as the query does
OP5_TURNS = """
SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
"""
OP5 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM ({OP5_TURNS})),
     f AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\\\\\[\\]<]', '', 'g')) AS esc FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(esc + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6
                ELSE 16 + length(role) + length(regexp_replace(role, '[^\\\\\\[\\]<]', '', 'g')) END))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) = 1 THEN l
                  ELSE list_distinct(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) END AS g FROM w),
     e AS (SELECT doc_id, len(g) AS n, unnest(g) AS v FROM s),
     i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
           FROM e a JOIN e b ON a.v = b.v AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY 1, 2),
     k AS (SELECT a, b FROM i WHERE 100 * shared >= 80 * (na + nb - shared)),
     r AS (SELECT a AS node, a AS reach FROM k UNION SELECT r.node, k.b FROM r JOIN k ON r.reach = k.a)
SELECT s.doc_id, len(g) AS n_shingles, coalesce(m, s.doc_id) AS component_id, coalesce(m, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN (SELECT node, min(reach) AS m FROM r GROUP BY node) c ON c.node = s.doc_id
"""



def _matches(kind: int, pattern: str) -> str:
    return f"""
g{kind} AS (SELECT row, i, length(gaps[i]) AS gap, found[i] AS value
       FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i
             FROM (SELECT row, string_split_regex(text, {pattern}) AS gaps, regexp_extract_all(text, {pattern}) AS found FROM d))),
s{kind} AS (SELECT row, {kind} AS kind, value, sum(gap + length(value)) OVER (PARTITION BY row ORDER BY i) AS e FROM g{kind})"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_ASSIGN, _RUN = _quoted(secret_scan.ASSIGN), secret_scan.RUN
_START, _SIZE = secret_scan.START, len(secret_scan.ALPHABET)


def _chance(m: str) -> str:
    return (f"({m} + {secret_scan.BACKOFF} * ((n{m} + 1)::DOUBLE / (a{m} + {_SIZE})::DOUBLE)) "
            f"/ (f{m} + {secret_scan.BACKOFF})::DOUBLE")


OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
{_matches(0, _ASSIGN)},
{_matches(1, _quoted(secret_scan.ACCESS))},
{_matches(2, _quoted(secret_scan.HEX))},
{_matches(3, _quoted(_RUN + "{%d,}" % secret_scan.LONG))},
base AS (SELECT * FROM s0 WHERE length(regexp_extract(value, {_ASSIGN}, 1)) >= {secret_scan.ASSIGNED_CHARS}
         UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2),
known AS (SELECT DISTINCT true AS random, v AS value FROM
          (SELECT CASE kind WHEN 0 THEN regexp_extract(value, {_ASSIGN}, 1) ELSE value END AS v FROM base)
          WHERE regexp_full_match(v, '{_RUN}+')),
words AS (SELECT DISTINCT false AS random, value FROM
          (SELECT unnest(regexp_extract_all(regexp_replace(text, {_ASSIGN}, ' ', 'g'), '{_RUN}+')) AS value FROM d
           WHERE ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE
                 < {secret_scan.SAMPLE_TEXTS} / greatest((SELECT count(*) FROM d), 1) * 4294967296.0::DOUBLE)
          WHERE length(value) BETWEEN {secret_scan.SHORT} AND {secret_scan.LONG - 1}),
chars AS (SELECT random, '{_START}' || value AS v, unnest(range(1, length(value) + 1)) AS i FROM (FROM known UNION ALL FROM words)),
counts AS (SELECT v[i] AS a, v[i + 1] AS b, count(*) FILTER (random) AS r, count(*) FILTER (NOT random) AS o FROM chars GROUP BY ALL),
cells AS (SELECT a, b, coalesce(r, 0) AS r, coalesce(o, 0) AS o
          FROM (SELECT unnest(string_split('{_START}{secret_scan.ALPHABET}', '')) AS a) x
          CROSS JOIN (SELECT unnest(string_split('{secret_scan.ALPHABET}', '')) AS b) y LEFT JOIN counts USING (a, b)),
sums AS (SELECT *, sum(r) OVER f AS fr, sum(o) OVER f AS fo, sum(r) OVER n AS nr, sum(o) OVER n AS no, sum(r) OVER () AS ar, sum(o) OVER () AS ao
         FROM cells WINDOW f AS (PARTITION BY a), n AS (PARTITION BY b)),
weights AS (SELECT a || b AS pair, floor(ln(({_chance("r")}) / ({_chance("o")})) * 1000)::BIGINT AS weight FROM sums),
asked AS (SELECT row_number() OVER () AS k, * FROM s3 WHERE NOT regexp_full_match(value, '[0-9]+')),
judged AS (SELECT k, sum(weight) AS score FROM
           (SELECT k, ('{_START}' || value)[i:i + 1] AS pair
            FROM (SELECT k, value, unnest(range(1, length(value) + 1)) AS i FROM asked)) JOIN weights USING (pair) GROUP BY k),
spans AS (SELECT row, kind, e - length(value) AS s, e FROM base UNION ALL
          SELECT row, kind, e - length(value), e FROM asked JOIN judged USING (k) WHERE score >= {secret_scan.THRESHOLD}),
named AS (SELECT *, {secret_scan.KINDS}[kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT AS name FROM spans)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       count(*) FILTER (kind = 3) AS n_random, sha256(coalesce(string_agg(name, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(name, ',' ORDER BY s, kind, e), '') AS spans
FROM d LEFT JOIN named USING (row) GROUP BY row, doc_id
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWERED}, '{ranked_search.TERM}') AS l FROM documents),
t AS (SELECT row, unnest(l) AS term FROM d),
f AS (SELECT row, term, count(*) AS tf FROM t GROUP BY row, term),
s AS (SELECT count(*) FILTER (len(l) > 0) AS docs, sum(len(l))::BIGINT AS total FROM d),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term),
m AS (SELECT row, doc_id, 50 + (50 * len(l)::BIGINT * docs) // total AS m FROM d, s WHERE len(l) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED}, '{ranked_search.TERM}')) AS term FROM benchmark),
r AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (row) GROUP BY item_id, row, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
FROM k WHERE rank <= {ranked_search.TOP}
"""

ORACLES = {"op1_exact_dedup": OP1, "op4_minhash_near_dedup": OP4, "op5_chat_formatting": OP5, "op8_line_dedup": OP8, "op11_ranked_search": OP11,
           "op12_secret_scan": OP12}
