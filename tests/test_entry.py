"""The driver contract: names, SQL for known queries, and every query against its SQL on the smallest tables."""

import sys

import duckdb
import pytest

import __spark_entry__ as entry
from jobs import registered
from skymill.plans import oracles, queries

QUERIES = {**queries.QUERIES, **registered.QUERIES}
SQL = {**oracles.ORACLE_SQL, **registered.ORACLE_SQL}
#: Not registered, but tested alike.
EVERY, EVERY_SQL = {**QUERIES, **queries.FIXED}, {**SQL, **oracles.FIXED_SQL}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{entry.SMOKE}/{t}.parquet')")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert set(queries.FIXED).isdisjoint(entry.queries()) and set(oracles.FIXED_SQL) <= set(queries.FIXED)


@pytest.mark.parametrize("missing", ["skymill.llm", "corpus_pipeline", "public_tokenizers"])
def test_particle_queries_stand_alone(monkeypatch, missing):
    for name in [m for m in sys.modules if m.startswith(("skymill.llm", "corpus_pipeline", "public_tokenizers"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    with pytest.warns(UserWarning, match="training-data"):
        names = set(entry.queries())
    assert set(QUERIES) <= names and "pipeline" not in names
    with pytest.warns(UserWarning, match="training-data"):
        assert set(SQL) <= set(entry.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def rows(values):
    out = []
    for r in values:
        out.append(tuple("-" if v is None else repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(out)


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(EVERY_SQL))
def test_query_equals_sql(spark, duck, name):
    df = EVERY[name](spark, entry.SMOKE)
    names = sorted(df.columns)
    sql = duck.sql(EVERY_SQL[name])
    assert names == sorted(sql.columns)
    kinds = dict(zip(sql.columns, map(str, sql.types), strict=True))
    assert {n: KINDS[t] for n, t in df.dtypes} == kinds
    assert rows(df.select(*names).collect()) == rows(sql.select(*names).fetchall())


@pytest.mark.parametrize("name", sorted(set(EVERY) - set(EVERY_SQL)))
def test_other_queries_run(spark, name):
    assert EVERY[name](spark, entry.SMOKE).count() > 0
