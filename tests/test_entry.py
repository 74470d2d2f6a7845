"""The driver's contract where parts are missing."""

import subprocess
import sys
from types import SimpleNamespace

import pytest

import __spark_entry__ as driver
from burnish.queries import QUERIES


def listed(prelude):
    """Names of the queries in an interpreter of its own."""
    code = f"import sys\n{prelude}\nimport __spark_entry__ as d\nprint(*d.queries(), *(f'sql:{{n}}' for n in d.oracle_sql()))"
    return set(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())


@pytest.mark.parametrize("module", ["ahocorasick", "regex", "burnish.llm", "corpus_pipeline"])
def test_a_missing_library_costs_no_table_query(module):
    got = listed(f"sys.modules[{module!r}] = None")
    assert set(QUERIES) <= got
    assert "pipeline" not in got and (module == "corpus_pipeline" or not any(n.startswith("op") and n[2].isdigit() for n in got))


def test_a_cluster_without_a_shared_folder_is_refused():
    conf = SimpleNamespace(get=lambda key, default=None: default, set=lambda *pair: None)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
        with pytest.raises(RuntimeError):
            driver.queries()["dedup_exact"](cluster, "nowhere")
