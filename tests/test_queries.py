import pytest

from tests.oracle import differs
from tidemark.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differs(registry.queries()[name](spark, sf_dir), SQL[name], sf_dir) is None


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
