"""The queries opN_<name> of the corpus operators, and their SQL where it can express them.

Every query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import ann, decontaminate, importance, jaccard_join, language_model, license_scan, packing, pii, quality, substring_dedup, token_counts, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.search(vectors.filter(F.col("vec_id") % 50 == 0), vectors, k=5)


@_query
def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "coverage").distinct()


@_query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


@_query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_read(spark, sf_dir, "documents"))


#: ASCII lower case and words between ASCII white space, in DuckDB.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op4_jaccard_join"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w
), flat AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sets sa ON sa.doc_id = a JOIN sets sb ON sb.doc_id = b WHERE 100 * n >= 90 * (len(sa.s) + len(sb.s) - n)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, l.b FROM reach r JOIN edges l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.least, s.doc_id)) AS component_id
FROM sets s LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY 1) m ON m.a = s.doc_id
"""


@_query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


_TEMPLATE_ROWS = ", ".join(f"({n}, '{label}', {step}, {license_scan.need(len(pairs))}, {pairs}, {must or [' ']}, {len(must)})" for n, (label, step, pairs, must) in enumerate(license_scan.template_sets()))
#: The ends of sentences as a word of their own.
_MARKED = rf"translate(regexp_replace(coalesce(text, ''), '[.!?][ \t\n\x0B\f\r]+([A-Z])', ' {license_scan.MARK} \1', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PHRASE_ROWS = ", ".join(f"('{label}', string_split('{words}', ' '))" for words, label in license_scan.PHRASES)

ORACLE_SQL["op5_license_scan"] = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases(label, p) AS (VALUES {_PHRASE_ROWS}),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS start FROM w, phrases
), base AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY 1
), templates(nth, label, step, need, t, must, musts) AS (VALUES {_TEMPLATE_ROWS}),
pair_of AS (SELECT nth, label, step, need, musts, len(t) AS size, unnest(t) AS pair, must FROM templates),
marked AS (SELECT doc_id, regexp_extract_all({_MARKED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS m FROM documents),
spot AS (SELECT doc_id, m[i + 1] || ' ' || m[i + 2] AS pair, i FROM (SELECT doc_id, m, unnest(range(0, len(m) - 1)) AS i FROM marked)),
hit AS (SELECT doc_id, nth, label, need, musts, size, pair, list_contains(must, pair) AS is_must, i // step AS block FROM spot JOIN pair_of USING (pair)),
near AS (SELECT * FROM hit UNION ALL SELECT doc_id, nth, label, need, musts, size, pair, is_must, block - 1 FROM hit WHERE block > 0),
held AS (SELECT doc_id, nth, label, need, musts, size, block, count(DISTINCT pair) AS n, count(DISTINCT pair) FILTER (is_must) AS m FROM near GROUP BY ALL),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(n * 1.0 / size) AS share FROM held WHERE n >= need AND m = musts GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN found ON found.doc_id = w.doc_id
"""


@_query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_read(spark, sf_dir, "documents"))


@_query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


#: The rules of op8, as (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@_query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), URL_RULES)


ORACLE_SQL["op8_url_filter"] = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fitting AS (
  SELECT c.page_id, c.host, c.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.rule_host) DESC NULLS LAST, length(r.rule_path) DESC) AS nth
  FROM cut c LEFT JOIN rules r ON (c.host = r.rule_host OR ends_with(c.host, '.' || r.rule_host)) AND starts_with(c.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fitting WHERE nth = 1
"""


@_query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


@_query
def op10_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    removed = F.array_join(F.transform("removed", lambda i: i.cast("string")), ",")
    return found.select("doc_id", "n_sentences", "n_removed", removed.alias("removed"), F.sha2("text", 256).alias("kept_sha256"))


_RUNS = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, " + " || chr(1) || ".join(f"full_s[p + {j}].n" for j in range(k)) + f" AS run, full_s[p].i AS a, full_s[p + {k - 1}].i AS z FROM starts WHERE p + {k - 1} <= len(full_s) AND " + " + ".join(f"full_s[p + {j}].w" for j in range(k)) + f" >= {words}"
    for k, words in substring_dedup.SPANS
)

ORACLE_SQL["op10_sentence_span_dedup"] = rf"""
WITH cut AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])([\x20\t])', E'\\1\x02\\2', 'g'), '([.!?][\x22'')\]])([\x20\t])', E'\\1\x02\\2', 'g'), '\n', E'\n\x02', 'g'), E'\x02'), lambda x: x <> '') AS s FROM documents
), named AS (
  SELECT doc_id, s, list_transform(s, lambda x: trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS n FROM cut
), full_rows AS (
  SELECT doc_id, list_filter(list_transform(range(0, len(n)), lambda i: {{'n': n[i + 1], 'i': i, 'w': len(string_split(n[i + 1], ' '))}}), lambda x: x.n <> '') AS full_s FROM named
), starts AS (SELECT doc_id, full_s, unnest(range(1, len(full_s) + 1)) AS p FROM full_rows),
runs AS ({_RUNS}),
firsts AS (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY doc_id, a) AS nth FROM runs),
gone AS (SELECT doc_id, list_sort(list(DISTINCT i)) AS removed FROM (SELECT doc_id, unnest(range(a, z + 1)) AS i FROM firsts WHERE nth > 1) GROUP BY 1)
SELECT c.doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(len(coalesce(removed, [])) AS BIGINT) AS n_removed, array_to_string(coalesce(removed, []), ',') AS removed,
  sha256(array_to_string(list_transform(list_filter(range(0, len(s)), lambda i: NOT list_contains(coalesce(removed, []), i)), lambda i: s[i + 1]), '')) AS kept_sha256
FROM cut c LEFT JOIN gone g ON g.doc_id = c.doc_id
"""


@_query
def op11_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored, v = language_model.log_likelihood(docs, ~language_model.held_out())
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


@_query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = importance.weigh(docs, _read(spark, sf_dir, "benchmark")).drop("text")
    return importance.draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda c: F.floor(F.lit(64.0) * c.cast("double")).cast("bigint") + F.lit(1_000_000).cast("bigint")
    vectors = whitening.usable(_read(spark, sf_dir, "embeddings"), "embedding").select("vec_id", F.transform("embedding", entry).alias("x"))
    rows, fit, error = whitening.whiten(vectors, "x", 32)
    n = F.lit(fit.n).cast("bigint")
    apart = F.aggregate(F.zip_with("row.x", F.array(*map(F.lit, fit.sums)), lambda x, s: n * x - s), F.lit(0).cast("bigint"), lambda total, x: total + x * x)
    out = rows.select(F.col("row.vec_id").alias("vec_id"), n.alias("n"), apart.alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, fit.explained or [0.0])), F.col("at") + 1)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository; it uses the operators of this subpackage

    return corpus_pipeline.run(spark, sf_dir)
