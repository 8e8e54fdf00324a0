import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry_module
from side_by_side import compare, open_tables, sorted_rows
from tallyrank.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(root):
    return open_tables(root)


# A whole training run; test_models.py and test_certificates.py run these with small settings.
TRAINED = {"model_roundtrip", "penalty_certificates", "stacking_certificate", "forest_recount", "forest_votes", "importance_certificate",
           "isolation_recount", "isolation_rescored", "oof_folds", "training_sizes", "history_falls", "scores_agree"}


@pytest.mark.parametrize("name", [n for n in ORACLES if n not in TRAINED])
def test_query_equals_its_sql(spark, con, root, name):
    diff, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], root)
    assert diff is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["roc_auc", "recommend", "stratified_split", "latency_percentiles"])
def test_results_do_not_depend_on_partitioning(spark, root, name):
    def rows():
        df = QUERIES[name](spark, root)
        return sorted_rows(df.columns, [tuple(r) for r in df.collect()])

    before = rows()
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_a_missing_library_leaves_the_other_queries():
    """Hides one library that only the training-data operators use, in a process of its own."""
    hidden = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", hidden], capture_output=True, text=True, cwd=os.path.dirname(entry_module.__file__), check=True)
    assert out.stdout.split()[-2:] == [str(len(QUERIES)), str(len(ORACLES))]
