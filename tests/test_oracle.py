"""Every registered query of the library against its SQL on DuckDB, where the tables are there."""

import math
import os

import pytest

from tidewright.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return ("nan" if math.isnan(x) else round(x, 9)) if isinstance(x, float) else x


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    wrong = []
    for name, sql in catalog.oracle_sql().items():
        df = catalog.queries()[name](spark, FOLDER)
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        columns = sorted(df.columns)
        mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        theirs = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
        if columns != sorted(names) or mine != theirs:
            wrong.append(name)
    assert wrong == []


def test_queries_without_sql_are_the_known_ones():
    assert sorted(set(catalog.queries()) - set(catalog.oracle_sql())) == ["chain_merge", "path_variant_colouring", "trace_policy"]
