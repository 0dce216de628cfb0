"""The registered query of each operator, and DuckDB statements for those
that SQL can express. Each query applies its operator with production
parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, collocations, exact_dedup, language_id, licenses, mixing, ngram_join, pii, quality, secrets, toxicity

TOKENIZER = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/lang/doc_id, so that a directory holds the
    documents of one source and language."""
    docs = _read(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    return licenses.scan(docs.select(F.col("doc_id").alias("file"), path.alias("path"), "text")).withColumnRenamed("file", "doc_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), tokenizer_path())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("copies")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(_read(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(_read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents")).drop("n_words")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_licenses": op3_licenses,
    "op4_bpe": op4_bpe,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_quality": op8_quality,
    "op9_ann": op9_ann,
    "op10_pii": op10_pii,
    "op11_alignment": op11_alignment,
    "op12_collocations": op12_collocations,
    "op13_secrets": op13_secrets,
}

_OP5 = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
turns AS (
  SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS goal
  FROM per),
fill AS (
  SELECT *, goal - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM turns),
lvl AS (
  SELECT rest, open_weight FROM fill WHERE NOT cap * open_weight <= rest * weight
  ORDER BY cap / weight, source NULLS LAST LIMIT 1),
goals AS (
  SELECT f.source, f.source_size,
         CASE WHEN f.cap * f.open_weight <= f.rest * f.weight OR l.rest IS NULL THEN f.cap ELSE l.rest * f.weight / l.open_weight END AS target
  FROM fill f LEFT JOIN lvl l ON TRUE),
ratios AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM goals),
quotas AS (
  SELECT *, floor(ratio) AS whole, target - floor(ratio) * source_size AS quota,
         least(greatest(ratio - floor(ratio), 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) AS pi
  FROM ratios),
ranked AS (
  SELECT d.doc_id, d.size, q.*, d.u * (1 - q.pi) / (d.u * (1 - q.pi) + (1 - d.u) * q.pi) AS rnk
  FROM docs d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source),
run AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rnk, doc_id NULLS FIRST) AS upto,
         sum(size) OVER (PARTITION BY source, rnk, doc_id) AS own
  FROM ranked)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
       ((whole + CASE WHEN upto <= quota OR (upto - own < quota AND upto - quota < quota - (upto - own)) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM run
"""

_OP6 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS txt FROM documents),
g AS (SELECT txt, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY txt)
SELECT t.doc_id, g.keep_id, g.group_size::BIGINT AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.txt) AS text_sha256
FROM t JOIN g ON t.txt = g.txt
"""

_OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
sized AS (SELECT lang, words, unnest(range(1, 6)) AS k FROM w),
spots AS (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM sized),
f AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM spots GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k >= 2 AND f >= 100),
cuts AS (SELECT *, unnest(range(1, k)) AS j FROM cand),
sides AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.j, l.f AS l, r.f AS r, n.n,
         (1000::HUGEINT * c.a::HUGEINT * n.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM cuts c JOIN n USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:c.j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[c.j + 1:], ' ')),
weakest AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
long_lengths AS (SELECT lang, a, k, words, unnest(range(2, k)) AS m FROM cand),
inner_spots AS (SELECT lang, a, words, m, unnest(range(1, k - m + 2)) AS i FROM long_lengths),
inside AS (SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM inner_spots GROUP BY ALL),
kept AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, a DESC, t.phrase) AS rank
  FROM weakest t LEFT JOIN inside i ON i.lang = t.lang AND i.phrase = t.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept WHERE rank <= 2000
"""

SQL: dict[str, str] = {"op5_mixing": _OP5, "op6_exact_dedup": _OP6, "op12_collocations": _OP12}
