"""DuckDB statements of vocabulary training and encoding (N = 2), for the oracles.

A training round is spelled out as CTEs over one row a position of a distinct segment: pair counts, the
legal repeated pairs, the best pair of each text, the cap, and one left-to-right replacement (of a
chain of overlapping pairs every other one is taken).  ``ROUNDS`` rounds are written down; a training that is
full earlier adds nothing in the later ones.
"""

from __future__ import annotations

from glyphmill.functions.text import LEGAL_RE2, SEGMENT_BODY, TOK_ID_OFFSET

ROUNDS = 6

_KEY = "CASE WHEN {0} < " + str(TOK_ID_OFFSET) + " THEN {0} + 1099511627776 ELSE {0} - " + str(TOK_ID_OFFSET) + " END DESC"


def _round(r: int, cap: int) -> str:
    order = f"n DESC, {_KEY.format('c1')}, {_KEY.format('c2')}"
    spelt = "coalesce({0}.display, chr({1}::INTEGER))"
    return f"""
q{r} AS MATERIALIZED (SELECT *, lead(c) OVER w AS c2, lead(t) OVER w AS t2 FROM p{r}
        WINDOW w AS (PARTITION BY segment ORDER BY i)),
b{r} AS (SELECT c1, c2, unrolled, n FROM (
          SELECT *, row_number() OVER (PARTITION BY unrolled ORDER BY {order}) AS nth FROM (
            SELECT c AS c1, c2, t || t2 AS unrolled, sum(freq) AS n FROM q{r} WHERE c2 IS NOT NULL
            GROUP BY ALL HAVING sum(freq) > 1)
          WHERE regexp_full_match(unrolled, '{LEGAL_RE2}')) WHERE nth = 1),
k{r} AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rn
         FROM b{r} ANTI JOIN v{r} USING (unrolled)),
n{r} AS MATERIALIZED (SELECT {TOK_ID_OFFSET} + (SELECT count(*) FROM v{r}) + rn - 1 AS code, k.c1, k.c2, k.unrolled,
        ((SELECT count(*) FROM v{r}) + rn - 1) || '=(' || {spelt.format('x', 'k.c1')} || '|' || {spelt.format('y', 'k.c2')} || ')' AS display
        FROM k{r} k LEFT JOIN v{r} x ON x.code = k.c1 LEFT JOIN v{r} y ON y.code = k.c2
        WHERE rn <= {cap} - (SELECT count(*) FROM v{r})),
v{r + 1} AS MATERIALIZED (SELECT * FROM v{r} UNION ALL SELECT * FROM n{r}),
m{r} AS (SELECT q.*, v.code FROM q{r} q LEFT JOIN v{r + 1} v ON v.c1 = q.c AND v.c2 = q.c2),
g{r} AS (SELECT *, i - row_number() OVER (PARTITION BY segment, code IS NOT NULL ORDER BY i) AS chain FROM m{r}),
h{r} AS (SELECT *, code IS NOT NULL AND row_number() OVER (PARTITION BY segment, code IS NOT NULL, chain ORDER BY i) % 2 = 1 AS taken FROM g{r}),
p{r + 1} AS MATERIALIZED (SELECT segment, freq, row_number() OVER (PARTITION BY segment ORDER BY i) AS i,
        CASE WHEN taken THEN code ELSE c END AS c, CASE WHEN taken THEN t || t2 ELSE t END AS t
        FROM (SELECT *, lag(taken, 1, false) OVER (PARTITION BY segment ORDER BY i) AS eaten FROM h{r}) WHERE NOT eaten)"""


def training(cap: int, rounds: int = ROUNDS) -> str:
    """CTEs ``vocab(code, c1, c2, unrolled, display)`` and ``coded(segment, freq, i, c, t)``, with those of each round."""
    head = f"""
dp AS (SELECT doc_id, unnest(regexp_extract_all(text, '{SEGMENT_BODY}')) AS segment FROM documents WHERE text IS NOT NULL),
p0 AS MATERIALIZED (SELECT segment, freq, i, unicode(t)::BIGINT AS c, t
       FROM (SELECT segment, freq, unnest(string_split(segment, '')) AS t, unnest(range(1, length(segment) + 1)) AS i
             FROM (SELECT segment, count(*) AS freq FROM dp GROUP BY segment))),
v0 AS (SELECT 0::BIGINT AS code, 0::BIGINT AS c1, 0::BIGINT AS c2, '' AS unrolled, '' AS display WHERE false)"""
    parts = [head, *[_round(r, cap) for r in range(rounds)],
             f"\nvocab AS (SELECT * FROM v{rounds})", f"\ncoded AS (SELECT * FROM p{rounds})"]
    return ",".join(parts)


def report(cap: int, rounds: int = ROUNDS) -> str:
    """CTE ``rounds(round, new_tokens, vocab_count, windows)``: until the vocabulary is full or a round adds nothing."""
    rows = []
    for r in range(rounds):
        newest = f"{TOK_ID_OFFSET} + (SELECT count(*) FROM v{r - 1})" if r else "0"
        go = f"WHERE (SELECT count(*) FROM v{r}) < {cap}" + (f" AND (SELECT count(*) FROM n{r - 1}) > 0" if r else "")
        rows.append(f"SELECT {r} AS round, (SELECT count(*) FROM n{r})::BIGINT AS new_tokens, (SELECT count(*) FROM v{r + 1})::BIGINT "
                    f"AS vocab_count, (SELECT count(*) FROM q{r} WHERE c2 IS NOT NULL AND greatest(c, c2) >= {newest})::BIGINT AS windows {go}")
    return f"rounds AS ({' UNION ALL '.join(rows)})"
