"""A training corpus from raw documents: five stages, each an operator of ``burnish.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet and reads
it back as the next stage's documents. All but the last return the columns of ``documents``.

Null, empty and very long texts pass through each stage by its operator's rules. Ids identify documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm import bpe, decontaminate, language_id, near_duplicates, pii
from burnish.llm.common import bucket_of, only
from burnish.llm.queries import vocabulary_path
from burnish.session import settle

# A text that takes more bits a byte in its best language than this is in none of them. Chance would be 8, a letter
# that no language has costs about 20; a short text with a key or an address in it stays below.
FOREIGN_BITS = 10.0


def _plain(docs: DataFrame) -> DataFrame:
    """Documents with columns named by place, as names may differ in case only or hold dots."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def _whole(docs: DataFrame, but_text: bool = False) -> DataFrame:
    """Each document as one column, handed through by an operator, beside its text; without it where a new one comes."""
    plain, text = _plain(docs), f"c{docs.columns.index('text')}"
    handed = [c for c in plain.columns if c != text or not but_text]
    return plain.select(F.struct(*handed).alias("row"), F.col(text).alias("text"))


def _columns(found: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of the documents from what an operator handed through."""
    places = {docs.columns.index(c): column for c, column in new.items() if c in docs.columns}
    cells = [places[i] if i in places else F.col("doc_id").getField(f"c{i}") for i in range(len(docs.columns))]
    return found.select(*(cell.alias(name) for cell, name in zip(cells, docs.columns, strict=True)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts without a letter and in none of them go."""
    trees = language_id.learn(docs.where(bucket_of(F.col("doc_id"), 4) != 2))
    found = language_id.identified(_whole(docs), trees, doc_id="row")
    native = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("bits_per_byte") <= FOREIGN_BITS)
    return _columns(found.where(native), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near duplicates."""
    found = near_duplicates.near_duplicates(docs)
    copies = settle(found.where(~F.col("kept")).select(F.col("doc_id").alias("copy")), "copies")
    plain = _plain(docs)
    ids = plain[f"c{docs.columns.index('doc_id')}"].cast("long")
    return plain.join(copies, ids == copies["copy"], "left_anti").toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _columns(decontaminate.flagged(_whole(docs), items, doc_id="row").where("hits = 0"), docs)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    found = pii.redacted(_whole(docs, but_text=True), pii.learn(docs), doc_id="row")
    size = F.length("redacted").cast("long")
    given = F.col("doc_id").getField(f"c{docs.columns.index('n_chars')}") if "n_chars" in docs.columns else size
    return _columns(found, docs, text=F.col("redacted"), n_chars=F.coalesce(size, given))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, joined by one space."""
    own = only(docs, doc_id="doc_id", lang="lang", source="source", text="text")
    row = own.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    return bpe.encoded(row, vocabulary_path(), doc_id="row").select("doc_id.*", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("redaction", redaction),
    ("tokens", tokens),
]

# No stage can be told in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
