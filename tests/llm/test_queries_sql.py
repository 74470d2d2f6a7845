"""Queries of the subpackage against their SQL, and over whole tables where there is none."""

import duckdb
import pytest

import __spark_entry__ as driver
from burnish.llm.queries import ORACLES, QUERIES

from ..test_queries import plain, sorted_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    found = QUERIES[name](spark, sf_dir)
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    want = sorted(names)
    assert sorted(found.columns) == want
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[k] for c, k in found.dtypes} == {d[0]: str(d[1]) for d in rel.description}
    assert sorted_rows(found.collect(), found.columns, want) == sorted_rows(rel.fetchall(), names, want)
    assert plain(True) is True


COLUMNS = {
    "op2_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    "op3_html_text": ["page_id", "url", "text", "n_chars"],
    "op4_exact_topk": ["query_id", "rank", "vec_id", "score"],
    "op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_repeats": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op8_context_tree": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op11_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op12_quality": ["doc_id", "held_out", "score", "predicted"],
    "op13_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
}
KINDS = {"rank": "int", "held_out": "boolean", "kept": "boolean", "score": "double", "base_score": "double", "predicted": "int"}
TEXTS = ("url", "text", "lang_pred", "spans")


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_types(spark, sf_dir, name):
    found = dict(driver.queries()[name](spark, sf_dir).dtypes)
    for c in COLUMNS[name]:
        kind = "string" if c in TEXTS or c.endswith("sha256") else KINDS.get(c, "bigint")
        assert found[c] == ("bigint" if name == "op4_exact_topk" and c == "score" else kind), (name, c)
