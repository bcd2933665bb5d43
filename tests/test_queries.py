"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import os

import pytest

from periodiq.plans import core_queries, lookup_queries, record_queries, reference_queries, source_queries, stream_queries
from verify import compare

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {**core_queries.QUERIES, **reference_queries.QUERIES, **lookup_queries.QUERIES, **record_queries.QUERIES, **source_queries.QUERIES, **stream_queries.QUERIES}
ORACLE = {**core_queries.ORACLE, **reference_queries.ORACLE, **lookup_queries.ORACLE, **record_queries.ORACLE, **source_queries.ORACLE, **stream_queries.ORACLE}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLE[name], FOLDER).startswith("ok")
