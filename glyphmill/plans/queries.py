"""Named queries over the driver tables, each with its DuckDB oracle (when SQL can say it).

Every query reads whole tables (no id subsets, prefixes or row caps); a limit
appears only where it is the feature (top-k, seeded sample).  Floating results
are rounded identically on both sides; vectors are reported as scalar digests
(sum and position-weighted sum) so the value hash compares plain numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as TX
from glyphmill.functions import vectors as V
from glyphmill.operators import codec, nseq, samples, scoring, vector_ops, vocab as vocab_ops
from glyphmill.plans import train_sql, vocab_sql
from glyphmill.session import bound_batches, save_scratch
from glyphmill.sources import corpus as src

# Parameters of the registered queries (fixed here, shared by Spark and SQL).
TOP_K = 50
FIRST_ROUND_CAP = 500
NULL_ABOVE = 25_000
TRAIN_VOCAB = 2_000
SEED = samples.RNG_SEED
SAMPLE_SIZE = samples.SAMPLE_SIZE
BATCH = samples.BATCH_SIZE
N_SAMPLES = samples.N_SAMPLES
LR = 3e-5
MAX_NORM = 1.0
ROUND = 6

WS = TX.WS_CLASS
LEGAL_SQL = TX.LEGAL_RE2
SEG_SQL = TX.SEGMENT_BODY


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return src.read_corpus(spark, f"{d}/documents.parquet")


def _r(c, digits: int = ROUND):
    return F.round(c, digits)


# ---------------------------------------------------------------------------
# Scans and text statistics

def q_scan_text_stats(spark, d):
    df = src.read_table(spark, d, "documents").select("lang", "text")
    return src.text_stats(df, ["lang"])


SQL_SCAN_TEXT_STATS = """
SELECT lang, count(*)::BIGINT AS n_rows, count(text)::BIGINT AS n_text,
       sum(length(text))::BIGINT AS n_chars, sum(strlen(text))::BIGINT AS n_bytes
FROM documents GROUP BY lang
"""


def _with_nulls(spark, d):
    """The documents with texts of over NULL_ABOVE characters taken as missing."""
    return src.read_table(spark, d, "documents").select(
        "doc_id", F.when(F.length("text") <= NULL_ABOVE, F.col("text")).alias("text"))


def q_null_stop_corpus(spark, d):
    c = src.apply_nulls(_with_nulls(spark, d), ["doc_id"], "stop")
    return c.select("doc_id", F.length("text").alias("n_chars"))


SQL_NULL_STOP_CORPUS = f"""
WITH c AS (SELECT doc_id, CASE WHEN length(text) <= {NULL_ABOVE} THEN text END AS text FROM documents)
SELECT doc_id, length(text)::INTEGER AS n_chars FROM c
WHERE text IS NOT NULL
  AND (doc_id < (SELECT min(doc_id) FROM c WHERE text IS NULL)
       OR (SELECT min(doc_id) FROM c WHERE text IS NULL) IS NULL)
"""


def q_null_skip_corpus(spark, d):
    return src.text_stats(src.apply_nulls(_with_nulls(spark, d), ["doc_id"], "skip"))


SQL_NULL_SKIP_CORPUS = f"""
SELECT count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_text, sum(length(text))::BIGINT AS n_chars,
       sum(strlen(text))::BIGINT AS n_bytes
FROM documents WHERE length(text) <= {NULL_ABOVE}
"""


def q_null_stop_whole(spark, d):
    """S02 over the unchanged table: only real nulls stop it."""
    c = src.read_corpus(spark, f"{d}/documents.parquet", nulls="stop")
    return c.select("doc_id", F.length("text").alias("n_chars"))


SQL_NULL_STOP_WHOLE = """
SELECT doc_id, length(text)::INTEGER AS n_chars FROM documents
WHERE text IS NOT NULL
  AND (doc_id < (SELECT min(doc_id) FROM documents WHERE text IS NULL)
       OR (SELECT min(doc_id) FROM documents WHERE text IS NULL) IS NULL)
"""


def q_null_skip_whole(spark, d):
    return src.text_stats(_docs(spark, d))


SQL_NULL_SKIP_WHOLE = """
SELECT count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_text, sum(length(text))::BIGINT AS n_chars,
       sum(strlen(text))::BIGINT AS n_bytes
FROM documents WHERE text IS NOT NULL
"""


def _injected_nulls(spark, d):
    """The documents with every seventh id's text missing in the last quarter of the id range."""
    t = src.read_table(spark, d, "documents").select("doc_id", "text")
    top = t.agg(F.max("doc_id")).scalar()
    gone = (F.col("doc_id") * 4 >= top * 3) & (F.col("doc_id") % 7 == 0)
    return t.select("doc_id", F.when(~gone, F.col("text")).alias("text"))


_SQL_INJECTED_NULLS = """
WITH c AS (SELECT doc_id, CASE WHEN NOT (doc_id * 4 >= (SELECT max(doc_id) FROM documents) * 3 AND doc_id % 7 = 0)
                          THEN text END AS text FROM documents)
"""


def q_null_stop_injected(spark, d):
    c = src.apply_nulls(_injected_nulls(spark, d), ["doc_id"], "stop")
    return c.select("doc_id", F.length("text").alias("n_chars"))


SQL_NULL_STOP_INJECTED = _SQL_INJECTED_NULLS + """
SELECT doc_id, length(text)::INTEGER AS n_chars FROM c
WHERE text IS NOT NULL
  AND (doc_id < (SELECT min(doc_id) FROM c WHERE text IS NULL)
       OR (SELECT min(doc_id) FROM c WHERE text IS NULL) IS NULL)
"""


def q_null_skip_injected(spark, d):
    return src.text_stats(src.apply_nulls(_injected_nulls(spark, d), ["doc_id"], "skip"))


SQL_NULL_SKIP_INJECTED = _SQL_INJECTED_NULLS + """
SELECT count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_text, sum(length(text))::BIGINT AS n_chars,
       sum(strlen(text))::BIGINT AS n_bytes
FROM c WHERE text IS NOT NULL
"""


def q_validation_sample(spark, d):
    c = _docs(spark, d)
    return src.sample_n(c, 25, SEED).select("doc_id", F.length("text").alias("n_chars"))


SQL_VALIDATION_SAMPLE = f"""
SELECT doc_id, length(text)::INTEGER AS n_chars FROM documents WHERE text IS NOT NULL
ORDER BY md5(concat_ws(':', '{SEED}', doc_id)), doc_id LIMIT 25
"""


def q_char_codes_sum(spark, d):
    c = _docs(spark, d)
    codes = TX.char_codes(F.col("text"))
    return c.select("doc_id", F.size(codes).cast("bigint").alias("n_codes"),
                    F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("code_sum"))


SQL_CHAR_CODES_SUM = """
SELECT doc_id, length(text)::BIGINT AS n_codes,
       CASE WHEN length(text) = 0 THEN 0
            ELSE list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))) END::BIGINT
         AS code_sum
FROM documents WHERE text IS NOT NULL
"""


# ---------------------------------------------------------------------------
# N-sequence statistics

def q_bigram_counts(spark, d):
    return nseq.nseq_counts(_docs(spark, d), 2)


def q_trigram_counts(spark, d):
    return nseq.nseq_counts(_docs(spark, d), 3)


def _sql_nseq(n: int, scope_doc: bool = False, min_count: int = 2) -> str:
    expr = " || ".join(f"cs[i + {j}]" for j in range(n))
    key = "doc_id, " if scope_doc else ""
    return f"""
WITH d AS (SELECT doc_id, string_split(text, '') AS cs FROM documents
           WHERE text IS NOT NULL AND length(text) >= {n}),
w AS (SELECT {key}unnest(list_transform(range(1, len(cs) - {n - 2}), lambda i: {expr})) AS nseq
      FROM d)
SELECT {key}nseq, count(*)::BIGINT AS cnt FROM w GROUP BY {key}nseq
HAVING count(*) >= {min_count} AND regexp_full_match(nseq, '{LEGAL_SQL}')
"""


def q_legal_bigrams(spark, d):
    """T03 + T04: every legal character bigram with its count (no repeat threshold)."""
    return nseq.nseq_counts(_docs(spark, d), 2, min_count=1)


def q_doc_bigrams(spark, d):
    return nseq.nseq_counts(_docs(spark, d), 2, scope="doc")


def q_top_bigrams(spark, d):
    return nseq.top_nseqs(_docs(spark, d), 2, TOP_K)


SQL_TOP_BIGRAMS = f"""
SELECT nseq, cnt FROM ({_sql_nseq(2)}) ORDER BY cnt DESC, nseq DESC LIMIT {TOP_K}
"""


def q_segment_counts(spark, d):
    return nseq.segment_counts(_docs(spark, d)).select("segment", "freq")


SQL_SEGMENT_COUNTS = f"""
SELECT segment, count(*)::BIGINT AS freq
FROM (SELECT unnest(regexp_extract_all(text, '{SEG_SQL}')) AS segment
      FROM documents WHERE text IS NOT NULL)
GROUP BY segment
"""


# ---------------------------------------------------------------------------
# Vocabulary

def q_first_round_vocab(spark, d):
    c = _docs(spark, d)
    segs = vocab_ops._initial_segments(c, 2)
    empty = spark.createDataFrame([], "unrolled string")
    chosen = vocab_ops.round_candidates(segs, empty, 2, FIRST_ROUND_CAP)
    # <= cap rows after the TakeOrderedAndProject: ids over a bounded table
    w = Window.orderBy(F.col("cnt").desc(), F.col("skey").desc())
    return chosen.select((F.row_number().over(w) - 1).cast("bigint").alias("id"),
                         "unrolled", "cnt")


SQL_FIRST_ROUND_VOCAB = f"""
SELECT (row_number() OVER (ORDER BY cnt DESC, nseq DESC) - 1)::BIGINT AS id,
       nseq AS unrolled, cnt
FROM ({_sql_nseq(2)}) ORDER BY cnt DESC, nseq DESC LIMIT {FIRST_ROUND_CAP}
"""


def q_round_candidates(spark, d):
    """The first round's candidates, uncapped."""
    segs = vocab_ops._initial_segments(_docs(spark, d), 2)
    empty = spark.createDataFrame([], "unrolled string")
    return vocab_ops.round_candidates(segs, empty, 2, None).select("unrolled", "cnt")


def trained(spark, d, size: int = TRAIN_VOCAB):
    return vocab_ops.train_vocab(_docs(spark, d), 2, size)


def _vocab_rows(entries):
    """A vocabulary as plain values: the components of an entry as text."""
    return entries.select("code", "id", F.array_join("comps", ",").alias("comps"), "unrolled")


def q_trained_vocab(spark, d):
    v, _ = trained(spark, d)
    return _vocab_rows(v.to_df(spark))


SQL_TRAINED_VOCAB = f"""
WITH {vocab_sql.training(TRAIN_VOCAB)}
SELECT code, code - {TX.TOK_ID_OFFSET} AS id, c1 || ',' || c2 AS comps, unrolled FROM vocab
"""


def q_train_report(spark, d):
    _, rep = trained(spark, d)
    return rep.select("round", "new_tokens", "vocab_count", "full", "input_bytes")


SQL_TRAIN_REPORT = f"""
WITH {vocab_sql.training(TRAIN_VOCAB)}, {vocab_sql.report(TRAIN_VOCAB)}
SELECT round, new_tokens, vocab_count, vocab_count >= {TRAIN_VOCAB} AS full,
       (SELECT sum(strlen(text)) FROM documents)::BIGINT AS input_bytes FROM rounds
"""


#: As many tokens as make the training run over several rounds.
DEEP_VOCAB = 40_000


def q_train_windows(spark, d):
    """Windows that each round counts: all in round 0, then those with a token of the round before."""
    _, rep = trained(spark, d, DEEP_VOCAB)
    return rep.select("round", "new_tokens", "vocab_count", "windows")


SQL_TRAIN_WINDOWS = f"""
WITH {vocab_sql.training(DEEP_VOCAB, 10)}, {vocab_sql.report(DEEP_VOCAB, 10)}
SELECT round, new_tokens, vocab_count, windows FROM rounds
"""


def q_encode_token_counts(spark, d):
    v, _ = trained(spark, d)
    enc = codec.encode(_docs(spark, d), v)
    return enc.select("doc_id", F.size("tokens").alias("n_tokens"))


SQL_ENCODE_TOKEN_COUNTS = f"""
WITH {vocab_sql.training(TRAIN_VOCAB)},
sizes AS (SELECT segment, count(*) AS n FROM coded GROUP BY segment)
SELECT doc_id, coalesce(sum(n), 0)::INTEGER AS n_tokens
FROM documents LEFT JOIN dp USING (doc_id) LEFT JOIN sizes USING (segment) WHERE text IS NOT NULL GROUP BY doc_id
"""


def _by_table(spark, d, **options):
    """Per document the number of tokens and a sum that depends on each and its place, by a vocabulary table."""
    v, _ = trained(spark, d)
    entries = save_scratch(v.to_df(spark).select("code", "comps"), "vocabulary")
    enc = codec.encode(_docs(spark, d), entries, all_legal=True, **options)
    placed = F.aggregate(F.transform("tokens", lambda c, i: c * (i % 1009 + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return enc.select("doc_id", F.size("tokens").alias("n_tokens"), placed.alias("token_sum"))


def q_encode_table(spark, d):
    """The vocabulary is a table, broadcast as one packed array."""
    return _by_table(spark, d)


def q_encode_joined(spark, d):
    """The plan for a vocabulary too large to broadcast: a join a pass over distinct pieces."""
    return _by_table(spark, d, max_packed_bytes=0)


SQL_ENCODE_TABLE = f"""
WITH {vocab_sql.training(TRAIN_VOCAB)},
held AS (SELECT doc_id, unnest(ss) AS segment, unnest(range(len(ss))) AS place
         FROM (SELECT doc_id, regexp_extract_all(text, '{SEG_SQL}') AS ss FROM documents WHERE text IS NOT NULL)),
tokens AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY place, i) - 1 AS j FROM held JOIN coded USING (segment))
SELECT d.doc_id, count(c)::INTEGER AS n_tokens, coalesce(sum(c * (j % 1009 + 1)), 0)::BIGINT AS token_sum
FROM documents d LEFT JOIN tokens ON tokens.doc_id = d.doc_id WHERE text IS NOT NULL GROUP BY d.doc_id
"""


def q_encode_decode_roundtrip(spark, d):
    v, _ = trained(spark, d)
    enc = codec.encode(_docs(spark, d), v).select("doc_id", "tokens")
    return codec.decode(enc, v, "tokens", "text").select("doc_id", "text")


SQL_ENCODE_DECODE_ROUNDTRIP = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL"


def q_model_vocab_size(spark, d):
    c = _docs(spark, d).select("doc_id", TX.char_codes(F.col("text")).alias("tokens"))
    mv = codec.model_vocab(c)
    return mv.agg(F.count(F.lit(1)).alias("n_codes"), F.max("tok_idx").alias("max_idx"),
                  F.min("code").alias("min_code"), F.max("code").alias("max_code"))


SQL_MODEL_VOCAB_SIZE = """
WITH c AS (SELECT DISTINCT unicode(ch)::BIGINT AS code
           FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents
                 WHERE text IS NOT NULL AND length(text) > 0))
SELECT count(*)::BIGINT AS n_codes, (count(*) - 1)::INTEGER AS max_idx,
       min(code) AS min_code, max(code) AS max_code FROM c
"""


# ---------------------------------------------------------------------------
# Training examples (tokens = character codes, so SQL can check them)

def _char_tokens(spark, d):
    return _docs(spark, d).select("doc_id", TX.char_codes(F.col("text")).alias("tokens"))


def _sql_char_tokens() -> str:
    return """
tok AS (SELECT doc_id,
               CASE WHEN length(text) = 0 THEN []::BIGINT[]
                    ELSE list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT) END
                 AS tokens
        FROM documents WHERE text IS NOT NULL)"""


def _sql_windows() -> str:
    return f"""{_sql_char_tokens()},
lens AS (SELECT doc_id, tokens, len(tokens) AS n,
                least({SAMPLE_SIZE}, len(tokens)) AS sl FROM tok WHERE len(tokens) > 0),
wins AS (SELECT doc_id, tokens, n, sl, unnest(range(0, ceil(n / sl)::BIGINT)) AS k FROM lens),
st AS (SELECT doc_id, tokens, k::INTEGER AS k, sl::INTEGER AS sample_len,
              (CASE WHEN n = sl THEN 0
                    ELSE ('0x' || substr(md5(concat_ws(':', '{SEED}', doc_id, k)), 1, 8))::BIGINT
                         % (n - sl) END)::INTEGER AS start_idx
       FROM wins),
sw AS (SELECT doc_id, k, start_idx, sample_len,
              list_slice(tokens, start_idx + 1, start_idx + sample_len - 1) AS x,
              list_slice(tokens, start_idx + 2, start_idx + sample_len) AS y
       FROM st WHERE sample_len > 1)"""


def _windows(spark, d):
    return samples.sample_windows(_char_tokens(spark, d), SAMPLE_SIZE, SEED)


def q_sample_windows(spark, d):
    w = _windows(spark, d)
    return w.select("doc_id", "k", "start_idx", "sample_len",
                    F.md5(F.array_join("x", ",")).alias("x_md5"),
                    F.md5(F.array_join("y", ",")).alias("y_md5"))


SQL_SAMPLE_WINDOWS = f"""
WITH {_sql_windows()}
SELECT doc_id, k, start_idx, sample_len,
       md5(array_to_string(x, ',')) AS x_md5, md5(array_to_string(y, ',')) AS y_md5 FROM sw
"""


def q_shift_pairs(spark, d):
    return samples.pair_counts(_windows(spark, d))


SQL_SHIFT_PAIRS = f"""
WITH {_sql_windows()},
p AS (SELECT unnest(x) AS x, unnest(y) AS y FROM sw)
SELECT x, y, count(*)::BIGINT AS n FROM p GROUP BY x, y
"""


def q_sample_limit_batches(spark, d):
    lim = samples.limit_samples(_windows(spark, d), N_SAMPLES, BATCH)
    return lim.select("doc_id", "k", "i", "batch_id", "complete")


SQL_SAMPLE_LIMIT_BATCHES = f"""
WITH {_sql_windows()},
ix AS (SELECT doc_id, k, (row_number() OVER (ORDER BY doc_id, k) - 1)::BIGINT AS i FROM sw),
cap AS (SELECT * FROM ix WHERE i < {N_SAMPLES})
SELECT doc_id, k, i, ceil(i / {BATCH})::BIGINT AS batch_id,
       ceil(i / {BATCH}) * {BATCH} <= (SELECT max(i) FROM cap) AS complete
FROM cap
"""


#: A cap far below the corpus's windows.
FEW_SAMPLES = 150


def q_sample_capped(spark, d):
    """L05/L06 with a small cap: files behind the cap are not windowed."""
    to_codes = lambda c: c.select("doc_id", TX.char_codes(F.col("text")).alias("tokens"))
    got = samples.capped_samples(spark, f"{d}/documents.parquet", FEW_SAMPLES, to_codes, BATCH, SAMPLE_SIZE, SEED)
    return got.select("doc_id", "k", "i", "batch_id", "complete", F.md5(F.array_join("x", ",")).alias("x_md5"))


SQL_SAMPLE_CAPPED = f"""
WITH {_sql_windows()},
ix AS (SELECT doc_id, k, x, (row_number() OVER (ORDER BY doc_id, k) - 1)::BIGINT AS i FROM sw),
cap AS (SELECT * FROM ix WHERE i < {FEW_SAMPLES})
SELECT doc_id, k, i, ceil(i / {BATCH})::BIGINT AS batch_id,
       ceil(i / {BATCH}) * {BATCH} <= (SELECT max(i) FROM cap) AS complete, md5(array_to_string(x, ',')) AS x_md5
FROM cap
"""


def q_sample_summary(spark, d):
    wins = samples.sample_windows(_char_tokens(spark, d), SAMPLE_SIZE, SEED, keep_short=True)
    return samples.sample_summary(wins, N_SAMPLES)


SQL_SAMPLE_SUMMARY = f"""
WITH {_sql_windows()}
SELECT count(*) FILTER (sample_len > 1)::BIGINT AS n_samples,
       count(*) FILTER (sample_len <= 1)::BIGINT AS n_dropped,
       count(*) FILTER (sample_len > 1) < {N_SAMPLES} AS short FROM st
"""


def q_conversation_windows(spark, d):
    conv = src.read_corpus(spark, f"{d}/conversations.parquet", key_col=["conv_id", "turn"])
    toks = conv.select("conv_id", "turn", TX.char_codes(F.col("text")).alias("tokens"))
    keys = ["conv_id", "turn"]
    wins = samples.sample_windows(toks, SAMPLE_SIZE, SEED, keys=keys)
    idx = samples.limit_samples(wins, None, BATCH, keys=keys)
    return idx.select(*keys, "k", "start_idx", "sample_len", "i", "batch_id",
                      F.md5(F.array_join("x", ",")).alias("x_md5"))


def q_validation_windows(spark, d):
    v = samples.validation_set(_char_tokens(spark, d), BATCH, SAMPLE_SIZE, SEED)
    return v.select("doc_id", F.size("x").alias("x_len"),
                    F.md5(F.array_join("x", ",")).alias("x_md5"),
                    F.md5(F.array_join("y", ",")).alias("y_md5"))


SQL_CONVERSATION_WINDOWS = f"""
WITH tok AS (SELECT conv_id, turn, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT) AS tokens
             FROM conversations WHERE text IS NOT NULL AND length(text) > 0),
lens AS (SELECT conv_id, turn, tokens, len(tokens) AS n, least({SAMPLE_SIZE}, len(tokens)) AS sl FROM tok),
wins AS (SELECT conv_id, turn, tokens, n, sl, unnest(range(0, ceil(n / sl)::BIGINT)) AS k FROM lens),
st AS (SELECT conv_id, turn, tokens, k::INTEGER AS k, sl::INTEGER AS sample_len,
              (CASE WHEN n = sl THEN 0
                    ELSE ('0x' || substr(md5(concat_ws(':', '{SEED}', conv_id, turn, k)), 1, 8))::BIGINT
                         % (n - sl) END)::INTEGER AS start_idx
       FROM wins WHERE sl > 1),
ix AS (SELECT *, (row_number() OVER (ORDER BY conv_id, turn, k) - 1)::BIGINT AS i FROM st)
SELECT conv_id, turn, k, start_idx, sample_len, i, ceil(i / {BATCH})::BIGINT AS batch_id,
       md5(array_to_string(list_slice(tokens, start_idx + 1, start_idx + sample_len - 1), ',')) AS x_md5
FROM ix
"""

SQL_VALIDATION_WINDOWS = f"""
WITH {_sql_char_tokens()},
pick AS (SELECT doc_id, tokens FROM tok WHERE len(tokens) >= {SAMPLE_SIZE}
         ORDER BY md5(concat_ws(':', '{SEED}', doc_id)), doc_id LIMIT {max(BATCH // 10, 1)})
SELECT doc_id, ({SAMPLE_SIZE} - 1)::INTEGER AS x_len,
       md5(array_to_string(list_slice(tokens, 1, {SAMPLE_SIZE - 1}), ',')) AS x_md5,
       md5(array_to_string(list_slice(tokens, 2, {SAMPLE_SIZE}), ',')) AS y_md5
FROM pick
"""


# ---------------------------------------------------------------------------
# Vector steps on the embeddings table

def _emb(spark, d):
    return src.read_table(spark, d, "embeddings")


def _digest(vec_col: str = "v"):
    return [_r(V.vec_sum(F.col(vec_col))).alias("s1"),
            _r(V.weighted_checksum(F.col(vec_col))).alias("s2")]


def _sql_digest(expr: str) -> str:
    return (f"round(list_sum({expr}), {ROUND}) AS s1, "
            f"round(list_sum(list_transform(list_zip({expr}, range(1, len({expr}) + 1)), "
            f"lambda t: t[1] * t[2])), {ROUND}) AS s2")


def _vec_query(fn):
    def q(spark, d):
        return _emb(spark, d).select("vec_id", fn(F.col("embedding")).alias("v")).select(
            "vec_id", *_digest())
    return q


# SQL spellings of the vector formulas (DuckDB lambda syntax).
SMOL, BIGE, K = repr(V.SMOL), repr(V.BIGE), repr(V.GELU_K)


def _sql_clip(x: str) -> str:
    small = (f"(CASE WHEN isnan({x}) THEN {SMOL} WHEN abs({x}) > {SMOL} THEN {x} "
             f"WHEN {x} < 0 THEN -{SMOL} ELSE {SMOL} END)")
    return (f"(CASE WHEN abs({small}) < {BIGE} THEN {small} "
            f"WHEN {small} < 0 THEN -{BIGE} ELSE {BIGE} END)")


def _sql_vec_query(expr: str) -> str:
    return f"SELECT vec_id, {_sql_digest(expr)} FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


SQL_VECTOR_SOFTMAX = _sql_vec_query(
    f"list_transform(e, lambda a: {_sql_clip('exp(a)')} / "
    f"{_sql_clip('list_sum(list_transform(e, lambda b: exp(b)))')})")
SQL_VECTOR_GELU = _sql_vec_query(f"list_transform(e, lambda a: a * (1.0 / {_sql_clip(f'1.0 + exp(-{K} * a)')}))")
SQL_VECTOR_GELU_GRAD = _sql_vec_query(
    f"list_transform(e, lambda a: (1.0 / {_sql_clip(f'1.0 + exp({K} * a)')}) * "
    f"(1.0 + {K} * a * (1.0 - (1.0 / {_sql_clip(f'1.0 + exp({K} * a)')}))))")
SQL_VECTOR_LAYERNORM = _sql_vec_query(
    f"list_transform(e, lambda a: a - (list_sum(e) / len(e)) / "
    f"sqrt(list_sum(list_transform(e, lambda b: (b - list_sum(e) / len(e)) * "
    f"(b - list_sum(e) / len(e)))) / len(e) + {SMOL}))")
SQL_VECTOR_CLIP = _sql_vec_query(f"list_transform(e, lambda a: {_sql_clip('a')})")


def q_vector_moments(spark, d):
    e = F.col("embedding")
    return _emb(spark, d).select("vec_id", _r(V.mean(e)).alias("mean"), _r(V.variance(e)).alias("var"))


SQL_VECTOR_MOMENTS = f"""
SELECT vec_id, round(list_sum(e) / len(e), {ROUND}) AS mean,
       round(list_sum(list_transform(e, lambda b: (b - list_sum(e) / len(e)) * (b - list_sum(e) / len(e))))
             / len(e), {ROUND}) AS var
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
"""


def q_vector_validity(spark, d):
    """C06 over the embeddings with large elements replaced: NaN above 0.3, infinity below -0.3."""
    spoilt = F.transform("embedding", lambda a: F.when(a > 0.3, F.lit(float("nan")))
                         .when(a < -0.3, F.lit(float("-inf"))).otherwise(a.cast("double")))
    return vector_ops.vector_validity(_emb(spark, d).select("label", spoilt.alias("vec")), ["label"])


SQL_VECTOR_VALIDITY = """
SELECT label, count(*)::BIGINT AS n_vecs,
       sum(len(list_filter(embedding, lambda a: a > 0.3)))::BIGINT AS n_nan,
       sum(len(list_filter(embedding, lambda a: a < -0.3)))::BIGINT AS n_inf
FROM embeddings GROUP BY label
"""


def q_vector_validity_whole(spark, d):
    """C06 over the unchanged embeddings."""
    return vector_ops.vector_validity(_emb(spark, d), ["label"], "embedding")


SQL_VECTOR_VALIDITY_WHOLE = """
SELECT label, count(*)::BIGINT AS n_vecs,
       sum(len(list_filter(embedding, lambda a: isnan(a))))::BIGINT AS n_nan,
       sum(len(list_filter(embedding, lambda a: isinf(a))))::BIGINT AS n_inf
FROM embeddings GROUP BY label
"""


def q_vector_validity_injected(spark, d):
    """C06 with NaN and infinities put at places given by id and index; all other elements stay."""
    spoilt = F.transform("embedding", lambda a, i: F.when((F.col("vec_id") + i) % 97 == 0, F.lit(float("nan")))
                         .when((F.col("vec_id") + i) % 89 == 0, F.when(i % 2 == 0, F.lit(float("inf")))
                               .otherwise(F.lit(float("-inf")))).otherwise(a.cast("double")))
    return vector_ops.vector_validity(_emb(spark, d).select("label", spoilt.alias("vec")), ["label"])


SQL_VECTOR_VALIDITY_INJECTED = """
WITH v AS (SELECT label, list_transform(embedding::DOUBLE[], lambda a, i:
             CASE WHEN (vec_id + i - 1) % 97 = 0 THEN 'nan'::DOUBLE
                  WHEN (vec_id + i - 1) % 89 = 0 THEN (CASE WHEN i % 2 = 1 THEN 'inf' ELSE '-inf' END)::DOUBLE
                  ELSE a END) AS e FROM embeddings)
SELECT label, count(*)::BIGINT AS n_vecs,
       sum(len(list_filter(e, lambda a: isnan(a))))::BIGINT AS n_nan,
       sum(len(list_filter(e, lambda a: isinf(a))))::BIGINT AS n_inf
FROM v GROUP BY label
"""


def q_vector_sum_by_label(spark, d):
    s = vector_ops.sum_vectors(_emb(spark, d), ["label"], "embedding", "v")
    return s.select("label", *_digest())


SQL_VECTOR_SUM_BY_LABEL = f"""
WITH x AS (SELECT label, i, sum(e[i]) AS v
           FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i
                 FROM (SELECT label, embedding::DOUBLE[] AS e FROM embeddings))
           GROUP BY label, i),
agg AS (SELECT label, list(v ORDER BY i) AS v FROM x GROUP BY label)
SELECT label, {_sql_digest('v')} FROM agg
"""


def q_global_norm(spark, d):
    return vector_ops.global_l2_norm(_emb(spark, d), "embedding").select(_r(F.col("norm")).alias("norm"))


SQL_GLOBAL_NORM = f"""
SELECT round(sqrt(sum(list_sum(list_transform(embedding::DOUBLE[], lambda a: a * a)))), {ROUND}) AS norm
FROM embeddings
"""


def q_clip_by_norm(spark, d):
    e = _emb(spark, d).select("vec_id", F.col("embedding").alias("v"))
    return vector_ops.clip_by_norm(e, MAX_NORM, "v").select("vec_id", *_digest())


SQL_CLIP_BY_NORM = f"""
WITH nrm AS (SELECT sqrt(sum(list_sum(list_transform(embedding::DOUBLE[], lambda a: a * a)))) AS norm
             FROM embeddings),
c AS (SELECT {MAX_NORM} / {_sql_clip('norm')} AS coeff FROM nrm),
s AS (SELECT vec_id, CASE WHEN coeff < 1.0 THEN list_transform(embedding::DOUBLE[], lambda a: a * coeff)
                          ELSE embedding::DOUBLE[] END AS v
      FROM embeddings, c)
SELECT vec_id, {_sql_digest('v')} FROM s
"""


def q_vector_scale(spark, d):
    e = _emb(spark, d).select("vec_id", F.col("embedding").alias("v"))
    return vector_ops.scale_vectors(e, 1.0 / BATCH, "v").select("vec_id", *_digest())


SQL_VECTOR_SCALE = _sql_vec_query(f"list_transform(e, lambda a: a * {1.0 / BATCH!r})")


def q_apply_update(spark, d):
    """Parameters = embeddings rows; gradient = the row's label mean (labels 0-9 only)."""
    emb = _emb(spark, d)
    params = emb.select(F.lit("embed").alias("tensor"), F.lit(0).alias("block"),
                        F.col("vec_id").alias("row"), F.col("embedding").alias("vec"))
    means = vector_ops.sum_vectors(emb, ["label"], "embedding", "vec")
    counts = emb.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    grads = (means.join(counts, "label")
             .select(F.lit("embed").alias("tensor"), F.lit(0).alias("block"),
                     F.col("label").cast("bigint").alias("row"),
                     V.scale_vec(F.col("vec"), 1.0 / F.col("n")).alias("vec")))
    out = vector_ops.apply_update(params, grads, LR * BATCH)
    return out.select(F.col("row").alias("vec_id"), *_digest("vec"))


SQL_APPLY_UPDATE = f"""
WITH x AS (SELECT label, i, sum(e[i]) / count(*) AS g
           FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i
                 FROM (SELECT label, embedding::DOUBLE[] AS e FROM embeddings))
           GROUP BY label, i),
gr AS (SELECT label::BIGINT AS row, list(g ORDER BY i) AS g FROM x GROUP BY label),
u AS (SELECT e.vec_id,
             CASE WHEN gr.g IS NULL THEN e.embedding::DOUBLE[]
                  ELSE list_transform(list_zip(e.embedding::DOUBLE[], gr.g),
                                      lambda t: t[1] - t[2] * {LR * BATCH!r}) END AS v
      FROM embeddings e LEFT JOIN gr ON gr.row = e.vec_id)
SELECT vec_id, {_sql_digest('v')} FROM u
"""


# ---------------------------------------------------------------------------
# Scoring: character tokens, model ids = rank of the code among codes seen,
# embed = embeddings rows (vec_id = model id), unembed tied to it (U = E^T).

def _model(spark, d):
    from glyphmill.session import cut_lineage
    toks = _char_tokens(spark, d)
    # small (distinct codes) and read several times: materialise it once
    mv = cut_lineage(codec.model_vocab(toks))
    emb = _emb(spark, d).select(F.col("vec_id").alias("idx"),
                                F.col("embedding").cast("array<double>").alias("vec"))
    return toks, mv, emb


def _to_idx(df, mv, cols):
    """Codes to model ids; a code without an id is an error."""
    for c in cols:
        ids = mv.select(F.col("code").alias(c), F.col("tok_idx").alias("_i"))
        df = scoring.required(df, ids, c, "_i", "model ids").drop(c).withColumnRenamed("_i", c)
    return df


def q_embedding_lookup(spark, d):
    toks, mv, emb = _model(spark, d)
    # counted per document and code before any join; each embedding row is reduced once
    counts = scoring.token_counts_per_row(toks, id_col="idx")
    row_sums = emb.select("idx", V.vec_sum(F.col("vec")).alias("vsum"))
    looked = scoring.required(_to_idx(counts, mv, ["idx"]), row_sums, "idx", "vsum", "embedding lookup")
    return looked.groupBy("doc_id").agg(F.sum("n").alias("n_pos"),
                                        _r(F.sum(F.col("n") * F.col("vsum"))).alias("s1"))


def q_next_token(spark, d):
    toks, mv, emb = _model(spark, d)
    last = (toks.filter(F.size("tokens") > 0)
            .select("doc_id", F.element_at("tokens", -1).alias("code")))
    last = _to_idx(last, mv, ["code"])
    seqs = last.select("doc_id", F.array("code").alias("tokens"))
    return scoring.predict_next(seqs, emb, emb).select("doc_id", "next_idx")


def _scored_windows(spark, d):
    """Windows with their pair counts in model ids, stored once, and per-pair terms."""
    toks, mv, emb = _model(spark, d)
    wins = save_scratch(samples.window_pairs(samples.sample_windows(toks, SAMPLE_SIZE, SEED), mv), "window-pairs")
    totals = save_scratch(samples.total_pairs(wins), "pairs")
    return wins, save_scratch(scoring.pair_terms(totals, emb, emb), "terms")


def q_pair_loss(spark, d):
    toks, mv, emb = _model(spark, d)
    wins = samples.window_pairs(samples.sample_windows(toks, SAMPLE_SIZE, SEED), mv)
    terms = scoring.pair_terms(save_scratch(samples.total_pairs(wins), "pairs"), emb, emb)
    return terms.select("x", "y", "n", _r(F.col("term")).alias("term"))


def _metrics(losses, index):
    m = scoring.batch_metrics(losses.join(index.select("doc_id", "k", "batch_id"), ["doc_id", "k"]))
    return m.select("batch_id", _r(F.col("avg_loss")).alias("avg_loss"),
                    _r(F.col("min_loss")).alias("min_loss"), _r(F.col("max_loss")).alias("max_loss"),
                    "n_samples")


def q_batch_metrics(spark, d):
    wins, terms = _scored_windows(spark, d)
    losses = scoring.losses_from_windows(wins, terms, ["doc_id", "k"])
    return _metrics(losses, samples.limit_samples(wins.select("doc_id", "k"), None, BATCH))


def q_trained_tokens_loss(spark, d):
    """Train a vocabulary, encode with it, window the tokens and score them: per-batch losses.

    Model ids are the ranks of the codes; a code's embedding is a seeded row of M01.
    """
    from glyphmill.operators import training
    v, _ = trained(spark, d)
    toks = save_scratch(codec.encode(_docs(spark, d), v).select("doc_id", "tokens"), "tokens")
    mv = save_scratch(codec.model_vocab(toks), "model-vocab")
    shape = training.ModelShape(vocab_size=mv.count(), embed_dim=TRAIN_EMBED)
    params = save_scratch(training.init_params(spark, shape, SEED), "params")
    emb, unemb = (params.filter(F.col("tensor") == t).select(F.col("row").alias("idx"), "vec")
                  for t in ("embed", "unembed"))
    wins = save_scratch(samples.window_pairs(samples.sample_windows(toks, SAMPLE_SIZE, SEED), mv), "window-pairs")
    totals = save_scratch(samples.total_pairs(wins), "pairs")
    terms = save_scratch(scoring.pair_terms(totals, emb, unemb), "terms")
    losses = scoring.losses_from_windows(wins, terms, ["doc_id", "k"])
    return _metrics(losses, samples.limit_samples(wins.select("doc_id", "k"), None, BATCH))


def q_validation_loss(spark, d):
    toks, mv, emb = _model(spark, d)
    val = samples.validation_set(toks, BATCH, SAMPLE_SIZE, SEED)
    pc = _to_idx(samples.pair_counts(val, ["doc_id"]), mv, ["x", "y"])
    losses = scoring.losses_from_pairs(pc, emb, emb, ["doc_id"])
    return losses.agg(_r(F.avg("loss")).alias("val_loss"), F.count(F.lit(1)).alias("n_val"))


def q_embed_scatter_add(spark, d):
    """Next-token embedding rows scatter-added by current token over every window position.

    Pairs are counted first (partial aggregate), so each distinct (x, y) adds
    ``n * E[y]`` once; the vector sum per x is a partial + final aggregate.
    """
    toks, mv, emb = _model(spark, d)
    wins = samples.sample_windows(toks, SAMPLE_SIZE, SEED)
    pc = _to_idx(samples.pair_counts(wins), mv, ["x", "y"])
    rows = pc.join(emb.select(F.col("idx").alias("y"), "vec"), "y").select(
        "x", V.scale_vec(F.col("vec"), F.col("n").cast("double")).alias("vec"))
    summed = vector_ops.sum_vectors(rows, ["x"], "vec", "v")
    back = summed.join(mv.select(F.col("tok_idx").alias("x"), "code"), "x")
    return back.select(F.col("code").alias("x"), *_digest())


def _sql_model() -> str:
    return f"""{_sql_windows()},
mv AS (SELECT code, (row_number() OVER (ORDER BY code) - 1)::BIGINT AS idx
       FROM (SELECT DISTINCT unnest(tokens) AS code FROM tok)),
E AS (SELECT vec_id AS idx, embedding::DOUBLE[] AS e FROM embeddings)"""


def _sql_embed_scatter_add() -> str:
    return f"""
WITH {_sql_model()},
p AS (SELECT unnest(x) AS x, unnest(y) AS y FROM sw),
pc AS (SELECT p.x, my.idx AS yi, count(*)::BIGINT AS n
       FROM p JOIN mv my ON my.code = p.y GROUP BY 1, 2),
el AS (SELECT pc.x, i, sum(pc.n * E.e[i]) AS v
       FROM pc JOIN E ON E.idx = pc.yi, range(1, len(E.e) + 1) r(i) GROUP BY pc.x, i),
agg AS (SELECT x, list(v ORDER BY i) AS v FROM el GROUP BY x)
SELECT x, {_sql_digest('v')} FROM agg
"""


def _sql_terms(pairs: str) -> str:
    """pairs: a CTE name with columns xi, yi."""
    return f"""xs AS (SELECT DISTINCT xi FROM {pairs}),
z AS (SELECT xi, sum(exp(list_dot_product(ex.e, ev.e))) AS zsum
      FROM xs JOIN E ex ON ex.idx = xs.xi, E ev GROUP BY xi),
dp AS (SELECT DISTINCT xi, yi FROM {pairs}),
terms AS (SELECT dp.xi, dp.yi,
                 -ln(greatest({_sql_clip('exp(list_dot_product(ex.e, ey.e))')} / {_sql_clip('z.zsum')},
                              {SMOL})) AS term
          FROM dp JOIN E ex ON ex.idx = dp.xi JOIN E ey ON ey.idx = dp.yi JOIN z ON z.xi = dp.xi)"""


SQL_EMBEDDING_LOOKUP = f"""
WITH {_sql_model()},
pos AS (SELECT doc_id, unnest(tokens) AS code FROM tok)
SELECT doc_id, count(*)::BIGINT AS n_pos, round(sum(list_sum(E.e)), {ROUND}) AS s1
FROM pos JOIN mv USING (code) JOIN E ON E.idx = mv.idx GROUP BY doc_id
"""

SQL_NEXT_TOKEN = f"""
WITH {_sql_model()},
last AS (SELECT doc_id, mv.idx AS xi FROM tok JOIN mv ON mv.code = tokens[len(tokens)]
         WHERE len(tokens) > 0),
xs AS (SELECT DISTINCT xi FROM last),
sc AS (SELECT xi, ev.idx AS v, {_sql_clip('exp(list_dot_product(ex.e, ev.e))')} AS val
       FROM xs JOIN E ex ON ex.idx = xs.xi, E ev),
best AS (SELECT xi, v FROM (SELECT xi, v, row_number() OVER (PARTITION BY xi ORDER BY val DESC, v) AS rn
                            FROM sc) WHERE rn = 1)
SELECT doc_id, best.v::BIGINT AS next_idx FROM last JOIN best USING (xi)
"""

SQL_PAIR_LOSS = f"""
WITH {_sql_model()},
p AS (SELECT unnest(x) AS x, unnest(y) AS y FROM sw),
pc AS (SELECT mx.idx AS xi, my.idx AS yi, count(*)::BIGINT AS n
       FROM p JOIN mv mx ON mx.code = p.x JOIN mv my ON my.code = p.y GROUP BY 1, 2),
{_sql_terms('pc')}
SELECT pc.xi AS x, pc.yi AS y, pc.n, round(terms.term, {ROUND}) AS term
FROM pc JOIN terms ON terms.xi = pc.xi AND terms.yi = pc.yi
"""

SQL_BATCH_METRICS = f"""
WITH {_sql_model()},
p AS (SELECT doc_id, k, unnest(x) AS x, unnest(y) AS y FROM sw),
pc AS (SELECT doc_id, k, mx.idx AS xi, my.idx AS yi, count(*)::BIGINT AS n
       FROM p JOIN mv mx ON mx.code = p.x JOIN mv my ON my.code = p.y GROUP BY 1, 2, 3, 4),
{_sql_terms('pc')},
loss AS (SELECT doc_id, k, sum(n * term) AS loss FROM pc
         JOIN terms ON terms.xi = pc.xi AND terms.yi = pc.yi GROUP BY doc_id, k),
ix AS (SELECT doc_id, k, (row_number() OVER (ORDER BY doc_id, k) - 1)::BIGINT AS i FROM sw),
b AS (SELECT doc_id, k, ceil(i / {BATCH})::BIGINT AS batch_id FROM ix)
SELECT batch_id, round(avg(loss), {ROUND}) AS avg_loss, round(min(loss), {ROUND}) AS min_loss,
       round(max(loss), {ROUND}) AS max_loss, count(*)::BIGINT AS n_samples
FROM loss JOIN b USING (doc_id, k) GROUP BY batch_id
"""

SQL_VALIDATION_LOSS = f"""
WITH {_sql_model()},
pick AS (SELECT doc_id, tokens FROM tok WHERE len(tokens) >= {SAMPLE_SIZE}
         ORDER BY md5(concat_ws(':', '{SEED}', doc_id)), doc_id LIMIT {max(BATCH // 10, 1)}),
vs AS (SELECT doc_id, list_slice(tokens, 1, {SAMPLE_SIZE - 1}) AS x,
              list_slice(tokens, 2, {SAMPLE_SIZE}) AS y FROM pick),
p AS (SELECT doc_id, unnest(x) AS x, unnest(y) AS y FROM vs),
pc AS (SELECT doc_id, mx.idx AS xi, my.idx AS yi, count(*)::BIGINT AS n
       FROM p JOIN mv mx ON mx.code = p.x JOIN mv my ON my.code = p.y GROUP BY 1, 2, 3),
{_sql_terms('pc')},
loss AS (SELECT doc_id, sum(n * term) AS loss FROM pc
         JOIN terms ON terms.xi = pc.xi AND terms.yi = pc.yi GROUP BY doc_id)
SELECT round(avg(loss), {ROUND}) AS val_loss, count(*)::BIGINT AS n_val FROM loss
"""


# ---------------------------------------------------------------------------
# Vocabulary files and resolution, parameters and gradient rounds (rows-only checks)

def q_vocab_json_roundtrip(spark, d):
    import uuid
    from glyphmill.session import checkpoint_dir
    from glyphmill.sources import vocab_io
    v, _ = trained(spark, d)
    path = f"{checkpoint_dir(spark).rstrip('/')}/glyphmill-vocab-{uuid.uuid4().hex}.json"
    vocab_io.export_vocab(v, path)
    back = vocab_io.import_vocab(spark, path)
    return _vocab_rows(back.to_df(spark))


def q_vocab_resolve(spark, d):
    v, _ = trained(spark, d)
    entries = v.to_df(spark).select("code", "comps")
    return vocab_ops.resolve_vocab(entries)


SQL_VOCAB_RESOLVE = f"""
WITH {vocab_sql.training(TRAIN_VOCAB)}
SELECT code, unrolled, display FROM vocab
"""


def q_vocab_violations(spark, d):
    """T16 on the trained vocabulary with entries spoilt at places given by id: cycles of two, of one, undefined
    components, a surrogate and a missing component."""
    v, _ = trained(spark, d)
    at = lambda k: F.col("id") % 400 == k
    first, second = F.col("comps")[0], F.col("comps")[1]
    spoilt = (F.when(at(3), F.array(F.col("code") + 1, second)).when(at(4), F.array(first, F.col("code") - 1))
              .when(at(6), F.array(F.col("code"), second)).when(at(9), F.array(F.col("code") + 10_000_000, second))
              .when(at(11), F.array(F.lit(0xD800).cast("bigint"), second)).when(at(13), F.array(first)).otherwise(F.col("comps")))
    entries = save_scratch(v.to_df(spark).select("code", spoilt.alias("comps")), "spoilt")
    return vocab_ops.validate_vocab(entries, 2)


SQL_VOCAB_VIOLATIONS = f"""
WITH RECURSIVE {vocab_sql.training(TRAIN_VOCAB)},
e AS (SELECT code, CASE (code - {TX.TOK_ID_OFFSET}) % 400 WHEN 3 THEN [code + 1, c2] WHEN 4 THEN [c1, code - 1] WHEN 6 THEN [code, c2]
             WHEN 9 THEN [code + 10000000, c2] WHEN 11 THEN [55296, c2] WHEN 13 THEN [c1] ELSE [c1, c2] END AS comps FROM vocab),
c AS (SELECT code, unnest(comps) AS c FROM e),
refs AS (SELECT DISTINCT c.code, c.c FROM c JOIN e ON e.code = c.c),
reach AS (SELECT code, c FROM refs UNION SELECT reach.code, refs.c FROM reach JOIN refs ON refs.code = reach.c),
loops AS (SELECT code FROM reach WHERE code = c)
SELECT code, 'undefined component ' || c AS problem FROM c WHERE c >= {TX.TOK_ID_OFFSET} AND c NOT IN (SELECT code FROM e)
UNION ALL SELECT code, 'not a unicode scalar ' || c FROM c WHERE c BETWEEN 55296 AND 57343
UNION ALL SELECT code, 'arity ' || len(comps) FROM e WHERE len(comps) <> 2
UNION ALL SELECT DISTINCT code, 'on or behind a cycle' FROM (
  SELECT code FROM loops UNION SELECT reach.code FROM reach JOIN loops ON loops.code = reach.c)
"""


TRAIN_EMBED = 64
TRAIN_BATCH = 1_000
PARAM_BLOCKS = 16   # as in the reference


def q_init_params(spark, d):
    from glyphmill.operators import training
    toks = _char_tokens(spark, d)
    V_ = codec.model_vocab(toks).count()
    shape = training.ModelShape(vocab_size=V_, embed_dim=TRAIN_EMBED, n_blocks=1, n_heads=8,
                                ff_dim=128)
    p = training.init_params(spark, shape, SEED)
    return p.groupBy("tensor", "block").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("vec")).alias("width"),
        _r(F.max(F.array_max("vec"))).alias("max_val"), _r(F.min(F.array_min("vec"))).alias("min_val"))


def _sql_tensors(n_blocks: int, tables: bool) -> str:
    """CTEs ``vals(tensor, block, n_rows, cols, row, j, v)`` of the seeded parameters."""
    c, h, f = TRAIN_EMBED, 8, 128
    hs = c // h
    spec = [(t, b, 1, c, "0") for b in range(n_blocks) for t in ("ln_scale", "ln_bias")]
    spec += [(t, b, h * c, hs, f"1.0 / sqrt({h * hs * c})") for b in range(n_blocks) for t in ("query", "key", "value")]
    spec += [x for b in range(n_blocks) for x in (
        ("atn_out", b, c, c, f"1.0 / sqrt({c * c})"), ("ff1", b, c, f, f"1.0 / sqrt({c * f})"),
        ("ff1_b", b, 1, f, f"1.0 / sqrt({f})"), ("ff2", b, f, c, f"1.0 / sqrt({c * f})"),
        ("ff2_b", b, 1, c, f"1.0 / sqrt({c})"))]
    rows = [f"SELECT '{t}' AS tensor, {b} AS block, {n}::BIGINT AS n_rows, {w} AS cols, {lim}::DOUBLE AS lim"
            for t, b, n, w, lim in spec]
    rows += [f"SELECT '{t}', -1, n, {c}, 1.0 / sqrt(n * {c}) FROM ids" for t in ("embed", "unembed") if tables]
    return f"""{_sql_char_tokens()},
ids AS (SELECT count(DISTINCT code)::BIGINT AS n FROM (SELECT unnest(tokens) AS code FROM tok)),
spec AS ({' UNION ALL '.join(rows)}),
cells AS (SELECT *, unnest(range(0, cols)) AS j FROM (SELECT *, unnest(range(0, n_rows)) AS row FROM spec)),
vals AS (SELECT tensor, block, n_rows, cols, row, j,
                CASE tensor WHEN 'ln_scale' THEN 1.0 WHEN 'ln_bias' THEN 0.0 ELSE
                  (('0x' || substr(md5(concat_ws(':', '{SEED}', tensor, block, row, j)), 1, 8))::BIGINT
                   / 4294967296.0::DOUBLE * 2.0 - 1.0) * lim END::DOUBLE AS v
         FROM cells)"""


def _sql_init_params() -> str:
    return f"""
WITH {_sql_tensors(1, True)}
SELECT tensor, block::INTEGER AS block, n_rows, cols::INTEGER AS width,
       round(max(v), {ROUND}) AS max_val, round(min(v), {ROUND}) AS min_val
FROM vals GROUP BY tensor, block, n_rows, cols
"""


def _sql_param_checkpoint() -> str:
    return f"""
WITH {_sql_tensors(PARAM_BLOCKS, False)},
e AS (SELECT embedding::DOUBLE[] AS e FROM embeddings)
SELECT tensor, block::INTEGER AS block, n_rows, cols::INTEGER AS width, round(sum(v), {ROUND}) AS s1
FROM vals GROUP BY tensor, block, n_rows, cols
UNION ALL SELECT t, -1, count(*)::BIGINT, max(len(e))::INTEGER, round(sum(list_sum(e)), {ROUND})
FROM e, (SELECT unnest(['embed', 'unembed']) AS t) GROUP BY t
"""


def _training_set(spark, d):
    """Pairs and batch ids of all windows, validation pairs and seeded parameters, on character tokens."""
    from glyphmill.operators import training
    bound_batches(spark)
    docs = _docs(spark, d)
    mv = save_scratch(codec.model_vocab(docs, "text"), "model-vocab")
    per_sample = save_scratch(samples.text_window_pairs(docs, mv, SAMPLE_SIZE, SEED), "window-pairs")
    batch_ids = samples.limit_samples(per_sample.select("doc_id", "k"), None, TRAIN_BATCH)
    val = save_scratch(samples.validation_set(docs, TRAIN_BATCH, SAMPLE_SIZE, SEED, "text"), "validation-set")
    val_pairs = _to_idx(samples.pair_counts(val, ["doc_id"]), mv, ["x", "y"])
    params = training.init_params(spark, training.ModelShape(vocab_size=mv.count(), embed_dim=TRAIN_EMBED), SEED)
    return per_sample, batch_ids, params, val_pairs


def _train_metrics(metrics):
    return metrics.select("batch_id", "n_samples", *[_r(F.col(c)).alias(c) for c in (
        "avg_loss", "min_loss", "max_loss", "val_loss", "grad_norm")])


def q_train_rounds(spark, d):
    from glyphmill.operators import training
    per_sample, batch_ids, params, val_pairs = _training_set(spark, d)
    cfg = training.TrainConfig(batch_size=TRAIN_BATCH, lr=LR, max_norm=MAX_NORM)
    _, metrics = training.train(per_sample, batch_ids, params, cfg, val_pairs)
    return _train_metrics(metrics)


def q_train_resumed(spark, d):
    """Training that stops after its second round and goes on from the commit log."""
    import uuid
    from dataclasses import replace
    from glyphmill.operators import training
    from glyphmill.session import checkpoint_dir
    per_sample, batch_ids, params, val_pairs = _training_set(spark, d)
    out = f"{checkpoint_dir(spark).rstrip('/')}/glyphmill-train-{uuid.uuid4().hex}"
    cfg = training.TrainConfig(batch_size=TRAIN_BATCH, lr=LR, max_norm=MAX_NORM, checkpoint_every=1, output_dir=out, resume=True)
    training.train(per_sample, batch_ids, params, replace(cfg, max_batches=2), val_pairs)
    _, metrics = training.train(per_sample, batch_ids, params, cfg, val_pairs)
    return _train_metrics(metrics)


#: Rounds that the oracle writes out; sf0.01 has three complete batches.
SQL_TRAIN_ROUNDS = train_sql.rounds_sql(_sql_windows(), _sql_clip, SEED, TRAIN_BATCH, LR, MAX_NORM, TRAIN_EMBED, SAMPLE_SIZE, SMOL, ROUND, 4)


def q_param_checkpoint(spark, d):
    """A parameter table (tied embeddings and seeded blocks) written as one round folder and read back."""
    import uuid
    from glyphmill.operators import training
    from glyphmill.session import checkpoint_dir
    _, mv, emb = _model(spark, d)
    shape = training.ModelShape(vocab_size=mv.count(), embed_dim=TRAIN_EMBED, n_blocks=PARAM_BLOCKS)
    params = training.init_params(spark, shape, SEED).filter(F.col("block") >= 0)
    for t in ("embed", "unembed"):
        params = params.unionByName(emb.select(F.lit(t).alias("tensor"), F.lit(-1).alias("block"),
                                               F.col("idx").alias("row"), "vec"))
    out = f"{checkpoint_dir(spark).rstrip('/')}/glyphmill-params-{uuid.uuid4().hex}"
    path = training.write_params(params, out, 0)
    back = spark.read.parquet(path)
    return back.groupBy("tensor", "block").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("vec")).alias("width"),
        _r(F.sum(V.vec_sum(F.col("vec")))).alias("s1"))


# ---------------------------------------------------------------------------
# Second corpus with a composite key, held-out scoring, per-sample log

def q_conversation_turn_bigrams(spark, d):
    conv = src.read_corpus(spark, f"{d}/conversations.parquet", key_col=["conv_id", "turn"])
    return nseq.nseq_counts(conv, 2, scope=["conv_id", "turn"])


SQL_CONVERSATION_TURN_BIGRAMS = f"""
WITH d AS (SELECT conv_id, turn, string_split(text, '') AS cs FROM conversations
           WHERE text IS NOT NULL AND length(text) >= 2),
w AS (SELECT conv_id, turn, unnest(list_transform(range(1, len(cs)), lambda i: cs[i] || cs[i + 1])) AS nseq
      FROM d)
SELECT conv_id, turn, nseq, count(*)::BIGINT AS cnt FROM w GROUP BY conv_id, turn, nseq
HAVING count(*) > 1 AND regexp_full_match(nseq, '{LEGAL_SQL}')
"""


def q_benchmark_loss(spark, d):
    """Each held-out benchmark text scored as one sequence under the corpus model."""
    _, mv, emb = _model(spark, d)
    bench = src.read_corpus(spark, f"{d}/benchmark.parquet", key_col="item_id")
    toks = bench.select("item_id", TX.char_codes(F.col("text")).alias("t"))
    seqs = toks.filter(F.size("t") > 1).select(
        "item_id", F.slice("t", 1, F.size("t") - 1).alias("x"), F.slice("t", 2, F.size("t") - 1).alias("y"))
    pc = samples.pair_counts(seqs, ["item_id"])
    # characters the corpus never saw have no model id: those pairs are reported, not scored
    known = mv.select("code")
    scored = _to_idx(pc.join(known.withColumnRenamed("code", "x"), "x", "left_semi")
                     .join(known.withColumnRenamed("code", "y"), "y", "left_semi"), mv, ["x", "y"])
    losses = scoring.losses_from_pairs(scored, emb, emb, ["item_id"])
    totals = pc.groupBy("item_id").agg(F.sum("n").alias("n_pairs"))
    kept = scored.groupBy("item_id").agg(F.sum("n").alias("n_scored"))
    return (totals.join(kept, "item_id", "left").join(losses, "item_id", "left")
            .select("item_id", "n_pairs", F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
                    _r(F.col("loss")).alias("loss")))


SQL_BENCHMARK_LOSS = f"""
WITH {_sql_model()},
bt AS (SELECT item_id, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT) AS t
       FROM benchmark WHERE text IS NOT NULL AND length(text) > 1),
p AS (SELECT item_id, unnest(list_slice(t, 1, len(t) - 1)) AS x, unnest(list_slice(t, 2, len(t))) AS y FROM bt),
tot AS (SELECT item_id, count(*)::BIGINT AS n_pairs FROM p GROUP BY item_id),
pc AS (SELECT item_id, mx.idx AS xi, my.idx AS yi, count(*)::BIGINT AS n
       FROM p JOIN mv mx ON mx.code = p.x JOIN mv my ON my.code = p.y GROUP BY 1, 2, 3),
{_sql_terms('pc')},
loss AS (SELECT item_id, sum(n)::BIGINT AS n_scored, sum(n * term) AS loss FROM pc
         JOIN terms ON terms.xi = pc.xi AND terms.yi = pc.yi GROUP BY item_id)
SELECT tot.item_id, tot.n_pairs, coalesce(loss.n_scored, 0)::BIGINT AS n_scored,
       round(loss.loss, {ROUND}) AS loss
FROM tot LEFT JOIN loss USING (item_id)
"""


def q_sample_log(spark, d):
    """Per sample -- doc, global index, start, end, length, loss."""
    wins, terms = _scored_windows(spark, d)
    losses = scoring.losses_from_windows(wins, terms, ["doc_id", "k"])
    idx = samples.limit_samples(wins.select("doc_id", "k"), None, BATCH)
    return (wins.select("doc_id", "k", "start_idx", "sample_len")
            .join(idx.select("doc_id", "k", "i"), ["doc_id", "k"])
            .join(losses, ["doc_id", "k"])
            .select("doc_id", "i", "start_idx",
                    (F.col("start_idx") + F.col("sample_len")).alias("end_idx"),
                    "sample_len", _r(F.col("loss")).alias("loss")))


SQL_SAMPLE_LOG = f"""
WITH {_sql_model()},
p AS (SELECT doc_id, k, unnest(x) AS x, unnest(y) AS y FROM sw),
pc AS (SELECT doc_id, k, mx.idx AS xi, my.idx AS yi, count(*)::BIGINT AS n
       FROM p JOIN mv mx ON mx.code = p.x JOIN mv my ON my.code = p.y GROUP BY 1, 2, 3, 4),
{_sql_terms('pc')},
loss AS (SELECT doc_id, k, sum(n * term) AS loss FROM pc
         JOIN terms ON terms.xi = pc.xi AND terms.yi = pc.yi GROUP BY doc_id, k),
ix AS (SELECT doc_id, k, start_idx, sample_len,
              (row_number() OVER (ORDER BY doc_id, k) - 1)::BIGINT AS i FROM sw)
SELECT doc_id, i, start_idx, start_idx + sample_len AS end_idx, sample_len,
       round(loss, {ROUND}) AS loss
FROM ix JOIN loss USING (doc_id, k)
"""


# ---------------------------------------------------------------------------

def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "scan_text_stats": q_scan_text_stats,
        "null_stop_corpus": q_null_stop_corpus,
        "null_stop_whole": q_null_stop_whole,
        "null_stop_injected": q_null_stop_injected,
        "null_skip_corpus": q_null_skip_corpus,
        "null_skip_whole": q_null_skip_whole,
        "null_skip_injected": q_null_skip_injected,
        "validation_sample": q_validation_sample,
        "char_codes_sum": q_char_codes_sum,
        "bigram_counts": q_bigram_counts,
        "trigram_counts": q_trigram_counts,
        "doc_bigrams": q_doc_bigrams,
        "legal_bigrams": q_legal_bigrams,
        "top_bigrams": q_top_bigrams,
        "segment_counts": q_segment_counts,
        "first_round_vocab": q_first_round_vocab,
        "round_candidates": q_round_candidates,
        "trained_vocab": q_trained_vocab,
        "train_report": q_train_report,
        "train_windows": q_train_windows,
        "encode_token_counts": q_encode_token_counts,
        "encode_table": q_encode_table,
        "encode_joined": q_encode_joined,
        "encode_decode_roundtrip": q_encode_decode_roundtrip,
        "model_vocab_size": q_model_vocab_size,
        "sample_windows": q_sample_windows,
        "shift_pairs": q_shift_pairs,
        "sample_limit_batches": q_sample_limit_batches,
        "sample_capped": q_sample_capped,
        "validation_windows": q_validation_windows,
        "vector_softmax": _vec_query(V.softmax),
        "vector_gelu": _vec_query(V.gelu),
        "vector_gelu_grad": _vec_query(V.gelu_grad),
        "vector_layernorm": _vec_query(V.layer_norm),
        "vector_clip_magnitude": _vec_query(lambda e: F.transform(e, V.clip_magnitude)),
        "vector_moments": q_vector_moments,
        "vector_validity": q_vector_validity,
        "vector_validity_whole": q_vector_validity_whole,
        "vector_validity_injected": q_vector_validity_injected,
        "vector_sum_by_label": q_vector_sum_by_label,
        "vector_scale": q_vector_scale,
        "global_norm": q_global_norm,
        "clip_by_norm": q_clip_by_norm,
        "apply_update": q_apply_update,
        "embed_scatter_add": q_embed_scatter_add,
        "embedding_lookup": q_embedding_lookup,
        "next_token": q_next_token,
        "pair_loss": q_pair_loss,
        "batch_metrics": q_batch_metrics,
        "validation_loss": q_validation_loss,
        "vocab_json_roundtrip": q_vocab_json_roundtrip,
        "vocab_resolve": q_vocab_resolve,
        "vocab_violations": q_vocab_violations,
        "init_params": q_init_params,
        "train_rounds": q_train_rounds,
        "train_resumed": q_train_resumed,
        "trained_tokens_loss": q_trained_tokens_loss,
        "sample_summary": q_sample_summary,
        "conversation_windows": q_conversation_windows,
        "param_checkpoint": q_param_checkpoint,
        "conversation_turn_bigrams": q_conversation_turn_bigrams,
        "benchmark_loss": q_benchmark_loss,
        "sample_log": q_sample_log,
    }


def oracle() -> dict[str, str]:
    return {
        "scan_text_stats": SQL_SCAN_TEXT_STATS,
        "null_stop_corpus": SQL_NULL_STOP_CORPUS,
        "null_stop_whole": SQL_NULL_STOP_WHOLE,
        "null_stop_injected": SQL_NULL_STOP_INJECTED,
        "null_skip_corpus": SQL_NULL_SKIP_CORPUS,
        "null_skip_whole": SQL_NULL_SKIP_WHOLE,
        "null_skip_injected": SQL_NULL_SKIP_INJECTED,
        "validation_sample": SQL_VALIDATION_SAMPLE,
        "char_codes_sum": SQL_CHAR_CODES_SUM,
        "bigram_counts": _sql_nseq(2),
        "trigram_counts": _sql_nseq(3),
        "doc_bigrams": _sql_nseq(2, scope_doc=True),
        "legal_bigrams": _sql_nseq(2, min_count=1),
        "top_bigrams": SQL_TOP_BIGRAMS,
        "segment_counts": SQL_SEGMENT_COUNTS,
        "first_round_vocab": SQL_FIRST_ROUND_VOCAB,
        "round_candidates": f"SELECT nseq AS unrolled, cnt FROM ({_sql_nseq(2)})",
        "trained_vocab": SQL_TRAINED_VOCAB,
        "train_report": SQL_TRAIN_REPORT,
        "train_windows": SQL_TRAIN_WINDOWS,
        "encode_token_counts": SQL_ENCODE_TOKEN_COUNTS,
        "encode_table": SQL_ENCODE_TABLE,
        "encode_joined": SQL_ENCODE_TABLE,
        "vocab_json_roundtrip": SQL_TRAINED_VOCAB,
        "vocab_resolve": SQL_VOCAB_RESOLVE,
        "vocab_violations": SQL_VOCAB_VIOLATIONS,
        "encode_decode_roundtrip": SQL_ENCODE_DECODE_ROUNDTRIP,
        "model_vocab_size": SQL_MODEL_VOCAB_SIZE,
        "sample_windows": SQL_SAMPLE_WINDOWS,
        "shift_pairs": SQL_SHIFT_PAIRS,
        "sample_limit_batches": SQL_SAMPLE_LIMIT_BATCHES,
        "validation_windows": SQL_VALIDATION_WINDOWS,
        "sample_capped": SQL_SAMPLE_CAPPED,
        "train_rounds": SQL_TRAIN_ROUNDS,
        "train_resumed": SQL_TRAIN_ROUNDS,
        "sample_summary": SQL_SAMPLE_SUMMARY,
        "conversation_windows": SQL_CONVERSATION_WINDOWS,
        "vector_softmax": SQL_VECTOR_SOFTMAX,
        "vector_gelu": SQL_VECTOR_GELU,
        "vector_gelu_grad": SQL_VECTOR_GELU_GRAD,
        "vector_layernorm": SQL_VECTOR_LAYERNORM,
        "vector_clip_magnitude": SQL_VECTOR_CLIP,
        "vector_moments": SQL_VECTOR_MOMENTS,
        "vector_validity": SQL_VECTOR_VALIDITY,
        "vector_validity_whole": SQL_VECTOR_VALIDITY_WHOLE,
        "vector_validity_injected": SQL_VECTOR_VALIDITY_INJECTED,
        "vector_sum_by_label": SQL_VECTOR_SUM_BY_LABEL,
        "vector_scale": SQL_VECTOR_SCALE,
        "global_norm": SQL_GLOBAL_NORM,
        "clip_by_norm": SQL_CLIP_BY_NORM,
        "apply_update": SQL_APPLY_UPDATE,
        "embed_scatter_add": _sql_embed_scatter_add(),
        "embedding_lookup": SQL_EMBEDDING_LOOKUP,
        "next_token": SQL_NEXT_TOKEN,
        "pair_loss": SQL_PAIR_LOSS,
        "batch_metrics": SQL_BATCH_METRICS,
        "validation_loss": SQL_VALIDATION_LOSS,
        "conversation_turn_bigrams": SQL_CONVERSATION_TURN_BIGRAMS,
        "benchmark_loss": SQL_BENCHMARK_LOSS,
        "sample_log": SQL_SAMPLE_LOG,
        "init_params": _sql_init_params(),
        "param_checkpoint": _sql_param_checkpoint(),
    }
