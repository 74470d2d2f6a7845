import corpus_pipeline
import pytest
from corpus_pipeline import STAGES, run

from burnish.llm import pii
from burnish.llm.queries import ORACLES, QUERIES

from .test_near_duplicates import brute


@pytest.fixture(scope="module")
def outputs(spark, sf_dir):
    """What each stage returns for the test documents, in order."""
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, sf_dir)).collect(), out.schema)
        found.append(docs)
    return found


def test_stages(spark, sf_dir, outputs):
    assert [name for name, _ in STAGES] == ["language", "near_dedup", "decontamination", "redaction", "tokens"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert all(out.columns == docs.columns for out in outputs[:-1])
    rows = [{r["doc_id"]: r for r in out.collect()} for out in (docs, *outputs)]
    assert rows[1] == rows[0]  # all are clean
    near = brute([(i, r["text"]) for i, r in rows[1].items()], 5, 80)
    assert set(rows[2]) == {i for i, _, _, kept in near if kept}
    assert 0 < len(rows[3]) < len(rows[2])
    assert set(rows[4]) == set(rows[3]) == set(rows[5])
    for i, r in rows[4].items():
        spans = pii.search(rows[3][i]["text"]).base
        assert (r["text"] == rows[3][i]["text"]) == (not spans) or "[" in r["text"]
        assert r["n_chars"] == len(r["text"])
    assert {(r["doc_id"], r["n_tokens"]) for r in outputs[-1].collect()} == {(r["doc_id"], r["n_tokens"]) for r in run(spark, sf_dir).collect()}


def test_odd_rows(spark, sf_dir, odd_docs, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    plain = odd_docs.toDF(*columns, *"uvwxy").select(columns)
    for docs in (plain, odd_docs, plain.where("false")):
        for name, stage in STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            rows = out.collect()
            if docs is plain:
                assert sorted(r["doc_id"] or 0 for r in rows) == {"language": [0, 1, 1, 4, 6]}.get(name, [0, 1, 1, 2, 3, 4, 5, 6, 7])
        assert STAGES[-1][1](spark, docs, sf_dir).columns == ["doc_id", "lang", "source", "n_tokens", "ids"]


def test_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert len(QUERIES) == 13 and set(ORACLES) <= set(QUERIES)
    assert corpus_pipeline.ORACLE_SQL is None
