"""The registered queries against their SQL, where there is some, on the smallest tables."""

import sys

import pytest

sys.path.insert(0, __file__.rsplit("/llm/", 1)[0])
from test_queries import compare  # noqa: E402

from seqlake.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("name", sorted(queries.more_oracle_sql()))
def test_more_queries_match_sql(spark, sf_dir, name):
    compare(spark, queries.more_queries()[name], queries.more_oracle_sql()[name], sf_dir)


def test_ten_queries_and_the_pipeline():
    import corpus_pipeline

    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5
