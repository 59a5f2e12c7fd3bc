"""The registered queries against their SQL, and their names."""

import re

import pytest
from check import compare, connect

import __spark_entry__
from lodeglass.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, name):
    verdict = compare(QUERIES[name](spark, sf), connect(sf).sql(ORACLE[name]))
    assert verdict.startswith("ok ") and "but" not in verdict, verdict


def test_all_are_registered():
    numbers = sorted(int(m[1]) for n in QUERIES if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    assert ORACLE.keys() <= __spark_entry__.oracle_sql().keys()
