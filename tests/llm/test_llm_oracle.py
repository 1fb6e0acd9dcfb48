"""Queries of this package against their SQL, and every one of them computed in full."""

import pytest
from compare import connect, difference

from ticketlens.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows(spark, con, folder, name):
    assert difference(QUERIES[name](spark, folder), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_whole_result(spark, folder, name):
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = QUERIES[name](spark, folder).collect()
    assert len({r.doc_id for r in rows}) == n and (len(rows) == n or name.startswith("op1_"))


def test_registered():
    import __spark_entry__ as entry

    assert [sum(q.startswith(f"op{n}_") for q in entry.queries()) for n in range(1, 14)] == [1] * 13 and "pipeline" in entry.queries()
