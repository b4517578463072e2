"""The queries that SQL can stand for, against it, over whole tables."""

import os

import pytest

from tests.conftest import load_views, same_rows
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, name):
    same_rows(queries.QUERIES[name](spark, SF).toPandas(), load_views(SF).execute(queries.ORACLES[name]).fetchdf())
