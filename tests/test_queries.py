"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from seqlake import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return [names[i] for i in order], sorted(repr(tuple(tidy(r[i]) for i in order)) for r in rows)


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(*oracle(sql, sf_dir))


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_matches_sql(spark, sf_dir, name):
    compare(spark, plans.queries()[name], plans.oracle_sql()[name], sf_dir)


def test_entry_is_in_order(spark):
    keys = [r.key for r in plans.entry(spark).collect()]
    assert keys and keys == sorted(keys)
