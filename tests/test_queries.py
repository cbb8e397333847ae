import datetime
import decimal
import importlib.util

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return str(v)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def rows_of(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in table.to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, sf_dir, oracle, name):
    got, want = entry.queries()[name](spark, sf_dir).toArrow(), oracle.execute(entry.oracle_sql()[name]).to_arrow_table()
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {"pipeline"}))
def test_query_runs(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "k", "cap", "overall", "local"]


def test_corpus_operators_are_optional():
    have = importlib.util.find_spec("optara.llm") is not None
    assert ("op1_toxicity" in entry.queries()) == have and ("pipeline" in entry.queries()) == (importlib.util.find_spec("corpus_pipeline") is not None)
