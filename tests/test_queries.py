"""Every registered query of the core against its SQL."""

import pytest

from loomline.plans import lifecycle_queries, session_queries, text_queries  # noqa: F401
from loomline.plans.registry import QUERIES, SQL
from tests.conftest import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in SQL:
        same(got, duck.execute(SQL[name]).df())
