import pytest

import __spark_entry__ as entry
from vecloom.plans import catalogue

SQL = catalogue.oracle_sql()
QUERIES = catalogue.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert set(SQL) <= set(QUERIES)
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_without_optional_part():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for path in (root / "vecloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "vecloom.llm" not in path.read_text()
