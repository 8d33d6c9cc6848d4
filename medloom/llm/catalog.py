"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clustering, exact_dedup, filter_audit, language_id, line_dedup, mixing, ppm, quality_rules, sentencepiece_bpe, sharding, simhash, url_filter


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_docs(spark, sf_dir))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(_docs(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    if ranks_path is None or pattern is None:
        import public_tokenizers

        ranks_path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.round_trip(_docs(spark, sf_dir).select("doc_id", "text"), ranks_path, pattern)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_docs(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_docs(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_docs(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _docs(spark, sf_dir).select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group")
    )
    out = sharding.shard(rows, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustering.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", *clustering.RESULT)


def op12_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    out = sentencepiece_bpe.encode(_docs(spark, sf_dir).select("doc_id", "text"), model_path, decoded_col="decoded", drop_text=True)
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "language_id_pages": language_id_pages,
    "op2_ppm_scoring": op2_ppm_scoring,
    "op3_bpe": op3_bpe,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_sharding": op8_sharding,
    "op9_url_filter": op9_url_filter,
    "op10_mixing": op10_mixing,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_filter_audit": op13_filter_audit,
}


def _clustering_sql(k: int = 8, rounds: int = 10) -> str:
    """Every vector against every centroid, one common table for each round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS MATERIALIZED (
            SELECT row_id, vec_id, v, arg_min(c, {{'d': d, 'c': c}}) AS cluster, min(d) AS distance
            FROM (SELECT v.*, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v CROSS JOIN c{r})
            GROUP BY row_id, vec_id, v
        )""")
        if r < rounds:
            steps.append(f"""
        c{r + 1} AS MATERIALIZED (
            SELECT c, coalesce(n.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
                SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m
                FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n
                      FROM (SELECT cluster, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{r}) GROUP BY cluster, i)
                GROUP BY cluster) n ON c = cluster
        )""")
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v)::INT - 1 AS c, v AS m FROM v QUALIFY c < {k}
        ), {",".join(steps)}
        SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON cluster = c
    """


ORACLES = {
    "op11_centroid_clustering": _clustering_sql(),
    "op13_filter_audit": r"""
        WITH t AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), l AS (
            SELECT doc_id, max(coalesce(quality = 1, false)::INT) = 1 AS good, max(coalesce(toxic = 1, false)::INT) = 1 AS toxic FROM labels GROUP BY doc_id
        ), f AS (
            SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
                   + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
                   + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
            FROM t
        ), cells AS (
            SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
            FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
        ), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), o AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
            FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
        ), s AS (
            SELECT filter_order, step, substr(filter_order, step, 1) AS filter, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
                   list_sum(list_transform(string_split(substr(filter_order, 1, step), ''), lambda c: 1 << (ascii(c) - 65)))::INT AS upto
            FROM (SELECT filter_order, unnest(generate_series(1, 5))::INT AS step FROM o)
        ), r AS (
            SELECT part, filter_order, step, filter,
                   sum(n * (mask & upto = 0)::INT)::BIGINT AS kept, sum(n * (mask & upto = bit)::INT)::BIGINT AS removed,
                   sum(n * (mask & bit <> 0 AND mask & upto <> bit)::INT)::BIGINT AS redundant, sum(n * (mask = bit)::INT)::BIGINT AS unique_fails,
                   sum(n * (mask & upto = bit AND good)::INT)::BIGINT AS good_lost, sum(n * (mask & upto = bit AND toxic)::INT)::BIGINT AS toxic_lost
            FROM cells CROSS JOIN s GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
        FROM r
    """,
    "op5_quality_rules": r"""
        WITH t AS (
            SELECT doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   string_split(coalesce(text, ''), chr(10)) AS lines
            FROM documents
        ), win AS (
            SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM t)
        ), rep AS (
            SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
        ), cov AS (
            SELECT doc_id, count(DISTINCT p) AS n_repeat_words
            FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM rep) GROUP BY doc_id
        ), ln AS (
            SELECT doc_id, host, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, host, unnest(lines) AS line FROM t)
        ), freq AS (
            SELECT host, key FROM ln WHERE key <> '' GROUP BY host, key HAVING count(DISTINCT doc_id) > 50
        ), gone AS (
            SELECT doc_id, sum(len(regexp_extract_all(key, '[^\x20\x09-\x0D]+'))) AS n_gone
            FROM ln JOIN freq USING (host, key) GROUP BY doc_id
        ), b AS (
            SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
                   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
                   - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words, n_gone
            FROM t LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)
        ), v AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                   n_words - coalesce(n_gone, 0) AS n_left_words
            FROM b
        )
        SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               n_left_words::BIGINT AS n_left_words,
               NOT base_failed AND (n_gone IS NULL OR NOT (n_left_words < 10 OR n_left_words < 0.2 * n_words)) AS kept
        FROM v
    """,
    "op6_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), k AS (
            SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM k
    """,
    "op7_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, i, line,
                   translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (
                SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
                FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
            )
        ), f AS (
            SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        ), m AS (
            SELECT l.*, f.key IS NOT NULL AS gone FROM l LEFT JOIN f ON l.key = f.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
}
