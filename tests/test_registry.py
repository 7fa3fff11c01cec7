"""Every oracle against its query on the smallest tables."""

import math

import duckdb
import pytest

from panelforge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert sorted(names) == columns
    assert want, "an empty oracle proves nothing"
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", ["a6_model_daily_after_dedup", "b3_objectives", "t5_paired_p_values", "h4_greedy_cap", "m4_boosting_round"])
def test_query_equals_oracle_without_slack(spark, name):
    """Where the order of addition once decided: a larger table, values compared as they are."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.queries()[name](spark, sf)
    rel = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in rel.fetchall()), key=repr)
    assert want and sorted(map(tuple, df.collect()), key=repr) == want
