"""Pieces of the oracle SQL that several queries share: token stream, vocabulary, ids, pairs, chains."""

TOKEN = r"[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
MIN_COUNT = 5
QUOTES = "'" + "''" * 2 + '"' * 4 + "'"

STREAM = rf"""
t AS (SELECT doc_id, unnest(l) AS t0, generate_subscripts(l, 1) - 1 AS pos
      FROM (SELECT doc_id, regexp_extract_all(lower(translate(nfc_normalize(text), '‘’“”„‟', {QUOTES})), '{TOKEN}') AS l FROM documents)),
q AS (SELECT *, sum(CASE WHEN t0 = '"' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS nq,
             CAST(coalesce(sum(CASE WHEN t0 IN ('.', '!', '?', ',', ';', ':', '"') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS clause FROM t),
s AS MATERIALIZED (SELECT doc_id, pos, clause, row_number() OVER (PARTITION BY doc_id, clause ORDER BY pos) - 1 AS cpos,
             count(*) OVER (PARTITION BY doc_id, clause) AS clen,
             CASE WHEN t0 = '"' AND nq % 2 = 0 THEN '"_close' ELSE t0 END AS tok FROM q)"""

CENSUS = STREAM + """,
c AS (SELECT tok, count(*) AS cnt, CAST(sum((CAST(cpos AS BIGINT) * 1000000000) // greatest(clen - 1, 1)) AS BIGINT) AS pos_sum FROM s GROUP BY tok)"""

VOCAB = CENSUS + """,
v AS MATERIALIZED (SELECT tok AS token, row_number() OVER (ORDER BY pos_sum // cnt, cnt DESC, tok) - 1 AS idx, cnt FROM c)"""

LOOKUP = VOCAB + f""",
k AS MATERIALIZED (SELECT token, row_number() OVER (ORDER BY idx) - 1 AS id FROM v WHERE cnt >= {MIN_COUNT}),
lk AS (SELECT token, id FROM k UNION ALL SELECT '<unk>', count(*) FROM k)"""

#: x: the id stream with the unknown token; i: only tokens of the lookup, their places counted anew.
IDS = LOOKUP + """,
x AS MATERIALIZED (SELECT s.doc_id, s.pos, s.clause, s.cpos, s.clen, coalesce(k.id, (SELECT count(*) FROM k)) AS id FROM s LEFT JOIN k ON s.tok = k.token)"""

PAIRS = IDS + """,
a AS (SELECT id AS u, clause, lead(id) OVER w AS v, lead(clause) OVER w AS nc FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
p AS MATERIALIZED (SELECT u, v, count(*) AS w FROM a WHERE v IS NOT NULL AND u <> v AND clause = nc GROUP BY u, v),
b AS MATERIALIZED (SELECT p.u, p.v, p.w, coalesce(r.w, 0) AS back FROM p LEFT JOIN p r ON p.u = r.v AND p.v = r.u)"""

LOSSES = PAIRS + """,
lo AS (SELECT u, sum(least(w, back)) AS loss, sum(w) AS o FROM b GROUP BY u),
li AS (SELECT v AS u, sum(w) AS i FROM p GROUP BY v),
losses AS (SELECT u, CAST(coalesce(loss, 0) AS BIGINT) AS loss, CAST(coalesce(o, 0) + coalesce(i, 0) AS BIGINT) AS directed FROM lo FULL JOIN li USING (u))"""

PLAN = LOSSES + """,
par AS (SELECT u, loss FROM losses WHERE loss > 0 AND loss * 100 >= greatest(directed, 1) * 5 ORDER BY loss DESC, u LIMIT 100),
pl AS MATERIALIZED (SELECT u AS old_index, u + row_number() OVER (ORDER BY u) - 1 AS early_new, u + row_number() OVER (ORDER BY u) AS late_new, loss FROM par)"""


def chains(reset: bool = False) -> str:
    """ch: the id stream with chain and the place in it."""
    clause = "OR clause <> lag(clause) OVER w" if reset else ""
    return (
        IDS
        + f""",
br AS (SELECT *, CASE WHEN lag(id) OVER w IS NULL OR id <= lag(id) OVER w {clause} THEN 1 ELSE 0 END AS nb FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ch0 AS (SELECT *, sum(nb) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chain FROM br),
ch AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, chain ORDER BY pos) - 1 AS at FROM ch0),
cl AS MATERIALIZED (SELECT doc_id, chain, count(*) AS len, array_to_string(list(id ORDER BY pos), ' ') AS ids, min(id) AS first_id FROM ch GROUP BY doc_id, chain)"""
    )


KWAY = (
    IDS
    + """,
h AS (SELECT id AS token_id, least((20 * cpos) // greatest(clen - 1, 1), 19) AS bin, count(*) AS n FROM x GROUP BY ALL),
ks AS (SELECT unnest(range(1, 7)) AS k),
hp AS (SELECT token_id, bin, n, k, len(list_filter(range(1, k), lambda i: bin >= (20 * i) // k)) AS copy FROM h, ks),
bp AS MATERIALIZED (SELECT token_id, k, copy, sum(n) AS mass, sum((2 * bin + 1) * n) AS moment FROM hp GROUP BY ALL),
tt AS (SELECT token_id, k, sum(mass) AS total, min(mass) AS least_mass, count(*) AS parts FROM bp GROUP BY ALL),
best AS (SELECT token_id, max(k) AS k FROM tt WHERE k = 1 OR (parts = k AND least_mass * 100 >= total * 15) GROUP BY token_id),
kw AS MATERIALIZED (SELECT token_id, k, copy, CAST((moment * 1000000) // (mass * 40) AS BIGINT) AS target_scaled FROM bp JOIN best USING (token_id, k)),
kp AS (SELECT token_id, k, token_id + coalesce(sum(k - 1) OVER (ORDER BY token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM (SELECT DISTINCT token_id, k FROM kw WHERE k >= 2)),
plan AS MATERIALIZED (SELECT kw.token_id AS old_index, CAST(kp.base + kw.copy AS BIGINT) AS new_index, kw.copy, kw.target_scaled FROM kw JOIN kp USING (token_id))"""
)


def with_(parts: str, select: str) -> str:
    return f"WITH {parts.strip()}\n{select.strip()}"
