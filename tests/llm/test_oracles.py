import pytest

from lattica.llm.registry import ORACLES, QUERIES

from ..oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_for_each_document_at_least(spark, name):
    assert QUERIES[name](spark, SF).count() >= spark.read.parquet(f"{SF}/documents.parquet").count()


def test_nothing_else_imports_this_subpackage():
    from pathlib import Path

    top = Path(__file__).resolve().parents[2] / "lattica"
    assert not [p for p in top.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]
