"""Every query of the subpackage as it is registered: against its SQL, on the given tables, and on empty ones."""

import os
import shutil

import pytest

from side_by_side import compare, open_tables
from tallyrank.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(root):
    return open_tables(root)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, con, root, name):
    diff, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], root)
    assert diff is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_its_rows(spark, root, name):
    got = QUERIES[name](spark, root).toPandas()
    docs = spark.read.parquet(os.path.join(root, "documents.parquet")).count()
    if name.startswith(("op5_", "op8_")):
        assert len(got)
    else:
        assert len(got) == docs and got["doc_id"].is_unique
    if "score" in got and "predicted" in got:
        assert got["score"].between(0, 1).all() and set(got["predicted"]) <= {0, 1}


@pytest.fixture(scope="module")
def empty(spark, root, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "embeddings", "labels", "conversations"):
        spark.read.parquet(os.path.join(root, f"{name}.parquet")).limit(0).write.parquet(str(folder / f"{name}.parquet"))
    yield str(folder)
    shutil.rmtree(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    # The fixed conversation of op2 is there all the same.
    assert [r["conv_id"] for r in rows] == [-7] if name.startswith("op2_") else rows == []
