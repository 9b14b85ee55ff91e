"""Every catalogue query against its SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import flowlens.plans.attempts  # noqa: F401
import flowlens.plans.audits  # noqa: F401
import flowlens.plans.flows  # noqa: F401
import flowlens.plans.packets  # noqa: F401
import flowlens.plans.pools  # noqa: F401
import flowlens.plans.stores  # noqa: F401
import flowlens.plans.tables  # noqa: F401
import flowlens.plans.windows  # noqa: F401
from flowlens.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) + 0.0 if isinstance(x, float) or type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in catalog.oracle_sql():
        assert got
        return
    rel = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
