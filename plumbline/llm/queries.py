"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpedfa, cotrain, cpsjoin, cuckoo, decontam, fmindex, ring, secrets, sstable, zdict


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return sstable.read_shards(spark, manifest, with_ids=False)


def op2_cuckoo_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.verdicts(_docs(spark, sf_dir))


def op3_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_rows(_docs(spark, sf_dir), shards=16)


def op4_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpsjoin.cluster(_docs(spark, sf_dir), width=2, percent=80)


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold != 1)
    model = zdict.train(docs, labels)
    scored = zdict.score(docs, model)
    held_out = F.coalesce(fold == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = secrets.scan(docs, secrets.train(spark, dictionary=secrets.corpus_words(docs)))
    return found.select("doc_id", "nth", F.sha2("value", 256).alias("value_sha256"), F.char_length("value").alias("length"), "score", "is_secret")


def op7_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_ngram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def op9_fm_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.remove_repeats(_docs(spark, sf_dir), width=35, keep_text=False)


def op10_automaton_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpedfa.encode(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), outputs=("n_tokens", "ids_text", "decoded"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sstable_tokens,
        op2_cuckoo_exact_dedup,
        op3_bounded_ring,
        op4_chosen_path_join,
        op5_compression_toxicity,
        op6_forest_secrets,
        op7_cotraining_quality,
        op8_ngram_decontamination,
        op9_fm_index_repeats,
        op10_automaton_bpe,
    )
}

ORACLES = {
    "op2_cuckoo_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op4_chosen_path_join": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
          FROM documents),
        s AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS g
          FROM d),
        e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
        p AS (
          SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.root FROM r JOIN l ON r.doc_id = l.a)
        SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.root) AS component_id, s.doc_id = min(r.root) AS kept
        FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(s.g)""",
    "op9_fm_index_repeats": r"""
        WITH d AS (
          SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
          FROM documents),
        win AS (
          SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS g
          FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM rep),
        each_word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0),
        kept AS (
          SELECT e.doc_id, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN e.x END, ' ' ORDER BY e.p) AS t
          FROM each_word e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(k.t, '')) AS kept_sha256
        FROM d LEFT JOIN kept k USING (doc_id)""",
    "op8_ngram_decontamination": r"""
        WITH d AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
          FROM documents),
        b AS (
          SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
          FROM benchmark),
        g AS (
          SELECT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS gram
          FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM g),
        dw AS (
          SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
          FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
        h AS (SELECT dw.doc_id, dw.i, dw.n, g.item_id FROM dw JOIN g ON dw.n = g.n AND dw.gram = g.gram),
        cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(cov.n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
               coalesce(cov.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
