"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embed_dedup, html_text, language, near_dup, pieces, quality, secrets, token_files, token_ledger
from .common import doc_bucket, fresh_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels").where(doc_bucket("doc_id", 5) != 0))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (doc_bucket("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs, docs.where(doc_bucket("doc_id", 4) != 2))
    found = language.predict(docs, model)
    return found.select("doc_id", (doc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: all documents by either tokenizer; toxic ones revised to their text without digits; bad ones deleted; the last is sent twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = table(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    bad = labels.where("quality = 0").select("doc_id").distinct()
    ledger = token_ledger.TokenLedger(spark, fresh_folder(spark, "token-ledger"))
    versions = ("word_bpe_49k", "piece_bpe_32k")
    files = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    ledger.apply("all", token_ledger.puts(docs, *files, versions))
    # up to so many ids are sent to every executor, so that no text moves; more are joined by a shuffle of the texts
    few = toxic.count() <= token_ledger.BROADCAST_IDS
    revised = docs.join(F.broadcast(toxic) if few else toxic, "doc_id", "left_semi").withColumn("text", F.regexp_replace("text", "[0-9]+", " "))
    ledger.apply("toxic", token_ledger.puts(revised, *files, versions))
    gone = bad.select(F.lit("delete").alias("op"), "doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.explode(F.array(*map(F.lit, versions))).alias("tokenizer"), F.lit(None).cast("long").alias("tokens"))
    ledger.apply("bad", gone)
    ledger.apply("bad", gone)
    return ledger.totals()


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_neighbours": op1_quality_neighbours,
    "op2_token_files": op2_token_files,
    "op3_language_kernel": op3_language_kernel,
    "op4_html_density": op4_html_density,
    "op5_latent_decontamination": op5_latent_decontamination,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_embedding_cells": op7_embedding_cells,
    "op8_token_rollups": op8_token_rollups,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_secret_scan": op10_secret_scan,
}

_OP7 = """
WITH RECURSIVE valid AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reached AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reached GROUP BY 1),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY 1),
found AS (SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id
  FROM embeddings LEFT JOIN counted c ON vec_id = c.x LEFT JOIN least l ON vec_id = l.x)
SELECT *, coalesce(vec_id = component_id, FALSE) AS kept FROM found"""

_OP9 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reached GROUP BY 1),
found AS (SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id FROM sets LEFT JOIN least ON doc_id = x)
SELECT *, coalesce(doc_id = component_id, FALSE) AS kept FROM found"""


def _places(name: str, pattern: str, keep: str) -> str:
    """SQL of the matches ``name`` of a pattern with their places (code points, end exclusive) where ``keep`` holds for match m."""
    return f"""{name}_cut AS (SELECT doc_id, regexp_extract_all(t, {pattern}) AS m, string_split_regex(t, {pattern}) AS p FROM texts),
{name} AS (SELECT doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': (list_sum(list_transform(p[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0))::BIGINT, 'm': m[i]}}), lambda x: {keep.replace("$m", "x.m")}) AS f FROM {name}_cut)"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _limit(window: str) -> str:
    """SQL of the limit of a window's class."""
    classes = {"digits": "[0-9+/_=-]+", "hex": "(?:[0-9a-f]+|[0-9A-F]+)", "letters": "[A-Za-z+/_=-]+"}
    return "CASE " + " ".join(f"WHEN regexp_full_match({window}, '{pattern}') THEN {secrets.LIMITS[name]}" for name, pattern in classes.items()) + f" ELSE {secrets.LIMITS['base64']} END"


_ASSIGN = _sql(secrets.ASSIGN)
_NAMED = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(secrets.KINDS))
_OP10 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_places("assign", _ASSIGN, f"length(regexp_extract($m, {_ASSIGN}, 2)) >= 12")},
{_places("access", _sql(secrets.ACCESS), "length($m) >= 18")},
{_places("hex", "'[0-9a-f]{16,}'", "TRUE")},
{_places("high", "'[A-Za-z0-9+/_=-]{20,}'", "NOT regexp_matches($m, " + _sql(secrets.ALLOW) + ")")},
based AS (
  SELECT doc_id, high.f AS h, list_concat(
    list_transform(assign.f, lambda x: {{'s': x.s, 'k': 0, 'e': x.s + length(x.m)}}),
    list_transform(access.f, lambda x: {{'s': x.s, 'k': 1, 'e': x.s + length(x.m)}}),
    list_transform(hex.f, lambda x: {{'s': x.s, 'k': 2, 'e': x.s + length(x.m)}})) AS b
  FROM assign JOIN access USING (doc_id) JOIN hex USING (doc_id) JOIN high USING (doc_id)),
judged AS (
  SELECT doc_id, list_sort(b) AS b, list_sort(list_concat(b, list_transform(list_filter(h, lambda x: len(list_filter(b, lambda y: y.s <= x.s AND y.e >= x.s + length(x.m))) = 0
    AND list_max(list_transform(range(1, length(x.m) - {secrets.WINDOW} + 2), lambda i: list_aggregate(string_split(substr(x.m, i, {secrets.WINDOW}), ''), 'entropy') - {_limit(f"substr(x.m, i, {secrets.WINDOW})")})) >= 0),
    lambda x: {{'s': x.s, 'k': 3, 'e': x.s + length(x.m)}}))) AS a FROM based),
joined AS (SELECT *, coalesce(array_to_string(list_transform(b, lambda x: (CASE x.k {_NAMED} END) || ':' || x.s || ':' || x.e), ','), '') AS jb,
  coalesce(array_to_string(list_transform(a, lambda x: (CASE x.k {_NAMED} END) || ':' || x.s || ':' || x.e), ','), '') AS spans FROM judged)
SELECT doc_id, len(list_filter(b, lambda x: x.k = 0))::BIGINT AS n_assign, len(list_filter(b, lambda x: x.k = 1))::BIGINT AS n_access, len(list_filter(b, lambda x: x.k = 2))::BIGINT AS n_hex,
  sha256(jb) AS base_sha256, spans FROM joined"""

ORACLE_SQL: dict[str, str] = {
    "op7_embedding_cells": _OP7,
    "op9_minhash_near_dedup": _OP9,
    "op10_secret_scan": _OP10,
}
