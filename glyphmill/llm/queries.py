"""The operators' registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import exact_dedup as exact
from glyphmill.llm import (
    anchors, embed_dedup, filter_audit, langid, line_dedup, lm_scoring, minhash, mixing, packing, pii, resample, suffix_dedup)
from glyphmill.llm.common import documents, residue

#: The folder of public vocabulary files; override with the environment where it lies elsewhere.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
PACK_VOCAB = "word_bpe_49k.json"


def tokenizer_path(name: str = PACK_VOCAB) -> str:
    """The vocabulary file's place: the installed ``public_tokenizers`` if it is importable."""
    try:
        import public_tokenizers
        return public_tokenizers.path(name)
    except ModuleNotFoundError:
        return os.path.join(TOKENIZERS, name)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir), digest=True)


SQL_OP4 = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS kept,
       text_sha256
FROM n
"""


SQL_OP8 = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
blocks AS (SELECT doc_id, n, c, substr(h, 512 * c + 1, 610) AS part
           FROM (SELECT doc_id, h, n, unnest(range(0, (n + 206) // 256)) AS c FROM b WHERE n >= 50)),
win AS (SELECT doc_id, 256 * c + j AS i, substr(part, 2 * j + 1, 100) AS k
        FROM (SELECT doc_id, c, part, unnest(range(0, least(256, n - 49 - 256 * c))) AS j FROM blocks)),
holder AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
bad AS (SELECT doc_id, i FROM win JOIN holder USING (k) WHERE d < doc_id),
step AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new
         FROM bad),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z
         FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM step) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, a, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS f FROM runs
         UNION ALL SELECT b.doc_id, b.n AS a, coalesce(max(z), 0) AS f FROM b LEFT JOIN runs USING (doc_id) GROUP BY b.doc_id, b.n),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY f) AS kh
         FROM gaps JOIN b USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT b.doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(kh)) AS kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL_OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
links AS (
  SELECT a.vec_id AS s, b.vec_id AS d FROM u a JOIN u b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
   AND list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.n * b.n) >= 0.93),
reach AS (
  SELECT s, s AS d FROM links UNION SELECT reach.s, links.d FROM reach JOIN links ON links.s = reach.d),
comp AS (SELECT s, min(d) AS c FROM reach GROUP BY s),
degree AS (SELECT s, count(*) AS n FROM links GROUP BY s)
SELECT e.vec_id, coalesce(degree.n, 0) AS n_links, coalesce(comp.c, e.vec_id) AS component_id,
       e.vec_id = coalesce(comp.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN comp ON comp.s = e.vec_id LEFT JOIN degree ON degree.s = e.vec_id
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = residue("doc_id", 3) == 1
    got = langid.predict(docs, langid.fit(docs, ~held))
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.remove_repeats(documents(spark, sf_dir), with_text=False)


_SQL_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

SQL_OP5 = f"""
WITH w AS (SELECT doc_id, {_SQL_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
holder AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN holder USING (k) WHERE d < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n
         FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


SQL_OP6 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_SQL_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
           FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
          WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.c, w.doc_id) AS component_id,
       w.doc_id = coalesce(comp.c, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp ON comp.x = w.doc_id
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.fit(docs))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), with_text=False)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(packing.pack(documents(spark, sf_dir), tokenizer_path()))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(documents(spark, sf_dir))


_SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_BARE = "regexp_replace(regexp_replace({}, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '')"

SQL_OP11 = f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, pos, line, {_SQL_LOWER.format(_SQL_BARE.format("line"))} AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {line_dedup.MIN_CHARS}
        GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS})
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (keeper <> doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY doc_id
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_SQL_BITS = " + ".join(f"{1 << i} * {c.lower()}" for i, c in enumerate(filter_audit.FILTERS))
_SQL_STEPS = " UNION ALL ".join(
    f"SELECT filter_order, {i} AS step, substr(filter_order, 1, {i - 1}) AS earlier, substr(filter_order, {i}, 1) AS own FROM orders"
    for i in range(1, 6))

SQL_OP12 = f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                  {_SQL_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
lab AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT doc_id, part, len(ws) < {filter_audit.MIN_WORDS} AS a,
             100 * len(list_distinct(ws)) < {filter_audit.DISTINCT_PERCENT} * len(ws) AS b,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {filter_audit.UPPER_PERCENT} * length(t) AS c,
             regexp_matches(t, '[#$%&*|]') AS d,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
g AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN lab USING (doc_id) GROUP BY ALL),
m AS (SELECT part, n, good, toxic, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END,
             CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS failed FROM g),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT v.x || w.x || y.x || z.x || u.x AS filter_order
           FROM letter v, letter w, letter y, letter z, letter u
           WHERE len(list_distinct([v.x, w.x, y.x, z.x, u.x])) = 5),
steps AS ({_SQL_STEPS}),
s AS (SELECT part, filter_order, step, own, n, good, toxic, failed, contains(failed, own) AS fails,
             len(translate(earlier, failed, '')) < len(earlier) AS gone FROM m, steps),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
      FROM s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql_features(table: str, key: str) -> str:
    lower = _SQL_LOWER.format("coalesce(text, '')")
    return (f"SELECT {key}, unnest(regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {table}")


#: crc32 by its table, a byte at a time over each distinct word.
SQL_OP13 = f"""
WITH RECURSIVE step(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tb FROM step WHERE k = 8),
df AS ({_sql_features('documents', 'doc_id')}),
bf AS ({_sql_features('benchmark', 'item_id')}),
voc AS (SELECT DISTINCT w FROM (SELECT w FROM df UNION ALL SELECT w FROM bf)),
byt AS (SELECT w, list_transform(range(octet_length(encode(w))),
               lambda j: ('0x' || substr(hex(encode(w)), 2 * j + 1, 2))::BIGINT) AS bs FROM voc),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bs),
               lambda acc, y: xor(acc // 256, tb[(xor(acc % 256, y) + 1)::BIGINT])), 4294967295::BIGINT) % {resample.BUCKETS} AS b
        FROM byt, tab),
sc AS (SELECT b, count(*) AS s FROM df JOIN crc USING (w) GROUP BY b),
tc AS (SELECT b, count(*) AS t FROM bf JOIN crc USING (w) GROUP BY b),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM sc)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM tc)::DOUBLE AS tt),
gain AS (SELECT b, floor({resample.SCALE} * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + {resample.BUCKETS})
                / ((s::DOUBLE + 1) * (tt + {resample.BUCKETS}))))::BIGINT AS g
         FROM sc LEFT JOIN tc USING (b), tot),
wt AS (SELECT doc_id, count(*) AS n, sum(g) AS weight FROM df JOIN crc USING (w) JOIN gain USING (b) GROUP BY doc_id),
sco AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
               coalesce(weight, 0)::BIGINT + floor(-{resample.SCALE}.0 * ln(-ln((
                 ('0x' || substr(sha256(concat('{resample.SEED}:', d.doc_id)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
        FROM documents d LEFT JOIN wt ON wt.doc_id = d.doc_id),
ord AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n
        FROM sco WHERE n_features >= {resample.MIN_WORDS})
SELECT sco.*, CASE WHEN r <= {resample.PERCENT} * n // 100 THEN r END::BIGINT AS rank
FROM sco LEFT JOIN ord USING (doc_id)
"""


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_embedding_dedup, op3_language_id, op4_exact_dedup, op5_substring_dedup, op6_minhash_dedup, op7_pii, op8_suffix_dedup, op9_mixing, op10_packing,
                                    op11_line_dedup, op12_filter_audit, op13_importance_resample)}


def oracle() -> dict[str, str]:
    return {"op2_embedding_dedup": SQL_OP2, "op4_exact_dedup": SQL_OP4,
            "op5_substring_dedup": SQL_OP5, "op6_minhash_dedup": SQL_OP6, "op8_suffix_dedup": SQL_OP8,
            "op11_line_dedup": SQL_OP11, "op12_filter_audit": SQL_OP12, "op13_importance_resample": SQL_OP13}
