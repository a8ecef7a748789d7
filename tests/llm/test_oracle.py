import pytest

from tests.compare import SF, same_rows
from vicinal.llm.catalog import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    same_rows(QUERIES[name](spark, SF), ORACLE[name])
