"""DuckDB statement of the gradient rounds (M04-M11), written out round by round, for the oracles.

Matrices are tables (row, j, v).  ``windows`` brings the CTEs ``tok`` and ``sw`` of the training windows.
"""

from __future__ import annotations


def rounds_sql(windows: str, clip, seed: int, batch: int, lr: float, max_norm: float, embed: int, sample_size: int,
               small: str, digits: int, rounds: int) -> str:
    """Metrics of the first ``rounds`` complete batches; ``clip(x)`` is the SQL of the magnitude clip."""
    def tensor(name: str) -> str:
        return (f"SELECT row, j, (('0x' || substr(md5(concat_ws(':', '{seed}', '{name}', -1, row, j)), 1, 8))::BIGINT "
                f"/ 4294967296.0::DOUBLE * 2.0 - 1.0) * (1.0 / sqrt(n * {embed}))::DOUBLE AS v "
                f"FROM (SELECT n, unnest(range(0, n)) AS row FROM nv), range({embed}) t(j)")

    head = f"""
WITH {windows},
mv AS (SELECT code, (row_number() OVER (ORDER BY code) - 1)::BIGINT AS idx
       FROM (SELECT DISTINCT unnest(tokens) AS code FROM tok)),
nv AS (SELECT count(*) AS n FROM mv),
ix AS (SELECT doc_id, k, (row_number() OVER (ORDER BY doc_id, k) - 1)::BIGINT AS i FROM sw),
bt AS (SELECT doc_id, k, ceil(i / {batch})::BIGINT AS b FROM ix WHERE ceil(i / {batch}) * {batch} <= (SELECT max(i) FROM ix)),
sp AS MATERIALIZED (SELECT b, doc_id, k, mx.idx AS x, my.idx AS y, count(*) AS n
      FROM (SELECT doc_id, k, unnest(x) AS cx, unnest(y) AS cy FROM sw) JOIN bt USING (doc_id, k)
      JOIN mv mx ON mx.code = cx JOIN mv my ON my.code = cy GROUP BY ALL),
pick AS (SELECT doc_id, tokens FROM tok WHERE len(tokens) >= {sample_size}
         ORDER BY md5(concat_ws(':', '{seed}', doc_id)), doc_id LIMIT {max(batch // 10, 1)}),
vp AS MATERIALIZED (SELECT doc_id, mx.idx AS x, my.idx AS y, count(*) AS n
      FROM (SELECT doc_id, unnest(list_slice(tokens, 1, {sample_size - 1})) AS cx,
                   unnest(list_slice(tokens, 2, {sample_size})) AS cy FROM pick)
      JOIN mv mx ON mx.code = cx JOIN mv my ON my.code = cy GROUP BY ALL),
e0 AS MATERIALIZED ({tensor('embed')}),
u0 AS MATERIALIZED ({tensor('unembed')})"""

    def one(r: int) -> str:
        return f"""
d{r} AS (SELECT e.row AS x, u.row AS y, sum(e.v * u.v) AS s FROM e{r} e JOIN u{r} u USING (j) GROUP BY 1, 2),
z{r} AS (SELECT x, sum(exp(s)) AS total FROM d{r} GROUP BY x),
q{r} AS MATERIALIZED (SELECT x, y, {clip('exp(s)')} / {clip('total')} AS p FROM d{r} JOIN z{r} USING (x)),
l{r} AS (SELECT doc_id, k, sum(n * -ln(greatest(p, {small}))) AS loss FROM sp JOIN q{r} USING (x, y) WHERE b = {r} GROUP BY doc_id, k),
w{r} AS (SELECT avg(loss) AS loss FROM (SELECT sum(n * -ln(greatest(p, {small}))) AS loss FROM vp JOIN q{r} USING (x, y) GROUP BY doc_id)),
c{r} AS (SELECT x, y, sum(n) AS n FROM sp WHERE b = {r} GROUP BY x, y),
x{r} AS (SELECT x, sum(n) AS nx FROM c{r} GROUP BY x),
g{r} AS MATERIALIZED (SELECT x, y, nx * p - coalesce(n, 0) AS g FROM q{r} JOIN x{r} USING (x) LEFT JOIN c{r} USING (x, y)),
a{r} AS MATERIALIZED (SELECT x AS row, j, sum(g * v) / {batch} AS g FROM g{r} JOIN u{r} u ON u.row = y GROUP BY 1, 2),
b{r} AS MATERIALIZED (SELECT y AS row, j, sum(g * v) / {batch} AS g FROM g{r} JOIN e{r} e ON e.row = x GROUP BY 1, 2),
n{r} AS (SELECT sqrt(sum(g * g)) AS norm FROM (SELECT g FROM a{r} UNION ALL SELECT g FROM b{r})),
k{r} AS (SELECT least(1.0, {max_norm} / {clip('norm')}) * {lr * batch!r} AS step FROM n{r}),
e{r + 1} AS MATERIALIZED (SELECT e.row, e.j, e.v - coalesce(g, 0) * step AS v FROM e{r} e LEFT JOIN a{r} USING (row, j), k{r}),
u{r + 1} AS MATERIALIZED (SELECT u.row, u.j, u.v - coalesce(g, 0) * step AS v FROM u{r} u LEFT JOIN b{r} USING (row, j), k{r}),
m{r} AS (SELECT {r}::BIGINT AS batch_id, avg(loss) AS avg_loss, min(loss) AS min_loss, max(loss) AS max_loss, count(*)::BIGINT AS n_samples,
                (SELECT loss FROM w{r}) AS val_loss, (SELECT norm FROM n{r}) AS grad_norm FROM l{r} HAVING count(*) > 0)"""

    rounded = ", ".join(f"round({c}, {digits}) AS {c}" for c in ("avg_loss", "min_loss", "max_loss", "val_loss", "grad_norm"))
    every = " UNION ALL ".join(f"SELECT * FROM m{r}" for r in range(rounds))
    return ",".join([head, *map(one, range(rounds))]) + f"\nSELECT batch_id, n_samples, {rounded} FROM ({every})"
