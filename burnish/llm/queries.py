"""Registered queries of the operators, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm import (
    alignment,
    bpe,
    chat,
    context_tree,
    decontaminate,
    html_text,
    language_id,
    near_duplicates,
    negatives,
    pii,
    quality,
    repeats,
    topk,
)
from burnish.llm.common import bucket_of

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that must give the same rows."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizers' files lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts of all documents."""
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), vocabulary_path())


@query()
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of(F.col("doc_id"), 4) == 2
    trees = language_id.learn(docs.where(~held_out))
    found = language_id.identified(docs, trees)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query()
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base spans, and those the trees add."""
    docs = table(spark, sf_dir, "documents")
    found = pii.found_spans(docs, pii.learn(docs))
    counts = [f"n_{kind}" for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


@query()
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extracted(table(spark, sf_dir, "pages"))


@query(
    """
    WITH v AS (
      SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
    ), ranked AS (
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
      FROM scored
    )
    SELECT * FROM ranked WHERE rank <= 20
    """
)
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty best candidates of every twentieth vector."""
    return topk.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query(chat.ORACLE)
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, rendered for each of their participants."""
    return chat.rotated(table(spark, sf_dir, "conversations"))


@query()
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, and which."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
      FROM documents
    ), shingles AS (
      SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS s
      FROM words
    ), sets AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM shingles
    ), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
    ), common AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY ALL
    ), links AS MATERIALIZED (
      SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
      WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)
    ), reach AS (
      SELECT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
    ), least AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.c, d.doc_id) AS component_id, coalesce(l.c, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)
    """
)
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with nearly the same three-word shingles."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


@query()
def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of all documents under a context tree learned from nine tenths of them."""
    return context_tree.scored(table(spark, sf_dir, "documents"), bucket_of(F.col("doc_id"), 10) == 0)


@query()
def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of hundred-byte strings that occur earlier."""
    return repeats.deduplicated(table(spark, sf_dir, "documents"))


@query()
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers over all documents, cut into groups with the same bytes, and their links' counts."""
    paths = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
    return alignment.alignments(table(spark, sf_dir, "documents"), *paths)


@query()
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels of two thirds of them."""
    held_out = bucket_of(F.col("doc_id"), 3) == 1
    measures = quality.measured(table(spark, sf_dir, "documents"))
    model = quality.learn(measures, table(spark, sf_dir, "labels"), ~held_out)
    found = quality.scored(measures, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "weakest")


@query(
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
      FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    ), scored AS (
      SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
    ), positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    ), ranked AS (
      SELECT anchor_id, positive_id,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
      FROM positives JOIN scored USING (anchor_id)
      WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    )
    SELECT * FROM ranked WHERE rank <= 3
    """
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the best positives of every fiftieth vector, some labels shifted."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)
