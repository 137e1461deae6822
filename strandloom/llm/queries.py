"""Queries and DuckDB oracles of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import language_id, log_bilinear, quality
from strandloom.llm.clustering import cluster_vectors
from strandloom.llm.common import documents
from strandloom.llm.exact_dedup import exact_dedup
from strandloom.llm.mixing import mix_sources, taken_words
from strandloom.llm.packing import pack_pow2
from strandloom.llm.pii import KINDS, find_personal_data, spans_text
from strandloom.llm.simhash import simhash_components
from strandloom.llm.substring_dedup import substring_dedup
from strandloom.llm.suffix_dedup import remove_repeats
from strandloom.llm.topk import exact_topk, quantised, usable
from strandloom.llm.whitening import integers, whiten


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix_sources(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("spans")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.train(docs))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir), whole=True)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["j"] - s["i"])
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["i"].cast("string"), s["j"].cast("string"))), ",")
    return out.select(
        "doc_id",
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(gone, F.lit(0)).alias("chars_removed"),
        F.coalesce(spans, F.lit("")).alias("removed"),
        F.col("kept_text").alias("text"),
    )


def op6_pack_pow2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_pow2(documents(spark, sf_dir)).drop("row_id")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, quality.label_grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.grade_documents(docs.select("doc_id", "text"), model).drop("text")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(spans_text("base").cast("binary"), 256).alias("base_sha256"), spans_text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable("embedding")).select("vec_id", quantised("embedding").alias("vector"))
    return exact_topk(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(documents(spark, sf_dir), words=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale, shift = 64, 1_000_000
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), integers("embedding", scale, shift).alias("vector"))
    out = whiten(rows, components=32, fill=shift).select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.language_model(documents(spark, sf_dir))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding").alias("vector"))
    return cluster_vectors(rows, k=8, rounds=10, dim=64, seed=3).drop("vector")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_pack_pow2": op6_pack_pow2,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_personal_data": op8_personal_data,
    "op9_exact_topk": op9_exact_topk,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_language_model": op12_language_model,
    "op13_sort_means": op13_sort_means,
}


def _means_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """k-means with a table of assignments and one of centroids for each round."""
    near = """a{n} AS MATERIALIZED (SELECT row, c AS cluster, d AS distance FROM (
            SELECT v.row, k.c, CAST(v.norm - 2 * list_dot_product(v.f, k.f) + k.norm AS BIGINT) AS d, row_number() OVER (PARTITION BY v.row ORDER BY v.norm - 2 * list_dot_product(v.f, k.f) + k.norm, k.c) AS nth FROM v CROSS JOIN c{n} k) WHERE nth = 1)"""
    move = """s{m} AS MATERIALIZED (SELECT cluster, i, sum(q[i]) AS s, count(*) AS n FROM a{n} JOIN v USING (row) CROSS JOIN (SELECT unnest(range(1, {dim} + 1)) AS i) GROUP BY ALL),
        q{m} AS (SELECT cluster AS c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{m} GROUP BY 1),
        c{m} AS MATERIALIZED (SELECT c, q, CAST(q AS DOUBLE[]) AS f, list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[])) AS norm FROM (SELECT c, coalesce(q{m}.q, c{n}.q) AS q FROM c{n} LEFT JOIN q{m} USING (c)))"""
    steps = [x.format(n=n, m=n + 1, dim=dim) for n in range(rounds) for x in (near, move)] + [near.format(n=rounds)]
    return f"""
        WITH v0 AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, q, CAST(q AS DOUBLE[]) AS f, list_dot_product(f, f) AS norm FROM v0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS c, q, f, norm FROM v QUALIFY c < {k}),
        {', '.join(steps)}
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (row) JOIN c{rounds} c ON c.c = cluster
    """


ORACLES = {
    "op13_sort_means": _means_sql(),
    "op9_exact_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND vec_id IS NOT NULL),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
