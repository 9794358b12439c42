"""Every registered query of the toolkit against its SQL on the smallest tables."""
import os

import duckdb
import pytest

from pixelloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(rows, cols, names):
    pick = [cols.index(n) for n in names]
    out = []
    for r in rows:
        out.append("|".join("" if r[k] is None else repr(round(float(r[k]), 5)) if isinstance(r[k], (int, float)) and not isinstance(r[k], bool) else str(r[k]) for k in pick))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = db.execute(registry.SQL[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert norm(got, df.columns, sorted(cols)) == norm(want, cols, sorted(cols))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
