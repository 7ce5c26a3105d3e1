import os

import duckdb
import pytest

from lodestone.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
@pytest.mark.parametrize("name", list(registry.queries()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, D)
    rel = duck.execute(registry.oracle_sql()[name])
    cols = [x[0] for x in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == sorted(repr(r) for r in rel.fetchall())
