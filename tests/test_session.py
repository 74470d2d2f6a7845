"""Where tables written on the way go."""

import os
from types import SimpleNamespace

import pytest

from burnish.session import scratch, scratch_path, settle, shared_folder, tuned, use_folder


def session(**conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf.get(key.replace(".", "_"), default)))


def test_the_named_folder_is_used():
    named = session(spark_checkpoint_dir="hdfs://a/b/", burnish_scratch_dir="/own")
    assert shared_folder(named) == "hdfs://a/b"
    assert scratch_path(session(burnish_scratch_dir="/own"), "t").startswith("/own/burnish/t-")


def test_a_session_without_a_folder_is_refused():
    with pytest.raises(RuntimeError):
        shared_folder(session())


def test_a_folder_of_its_own_only_where_none_is_named(spark):
    assert shared_folder(use_folder(spark, "/elsewhere")) != "/elsewhere"


def test_scratch_drops_what_was_written(spark):
    with scratch(spark):
        kept = settle(spark.range(5), "t")
        path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert kept.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_settle_keeps_rows_types_and_emptiness(spark):
    df = spark.range(10).selectExpr("id", "struct(id as a, 'x' as b) as s", "cast(null as string) as n")
    assert sorted(settle(df, "t").collect()) == sorted(df.collect())
    assert settle(df.limit(0), "t").columns == df.columns and settle(df.limit(0), "t").count() == 0


def test_tuned_sets_the_method_limit(spark):
    assert tuned(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
