"""Queries whose definition is easily got wrong equal their SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = "a01_read_entity_tables a06_validate_tables a09_expand_nested_accounts a10_read_truth a13_read_flows a18_read_cod_tables d05_build_entity_graph d07_prefix_edges f10_cod_features f11_validity f11_validity_summary h04_landed_in h18_period_trend i02_missed_cost i07_parameter_gap i08_propose_value j08_effect_sizes j09_z_score_sum j15_segmented_threshold".split()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF, con)


def test_entry_works_without_the_corpus_package(tmp_path):
    root = Path(entry.__file__).parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "tests"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": ""})
    shutil.copy(root / "corpus_pipeline.py", tmp_path / "r")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": ""})
