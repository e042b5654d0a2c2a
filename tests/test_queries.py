"""Every query that has SQL agrees with it on the smallest tables; all others run."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("DOCLOOM_TEST_SF", "/root/testdata/sf0.001")
CORE = [n for n in entry.queries() if n not in (entry._llm().QUERIES if entry._llm() else {})]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 5) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        r = duck.execute(sql)
        columns = [d[0] for d in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_what_the_training_data_queries_need(monkeypatch):
    """Whatever keeps the subpackage from being imported, the core queries stay."""

    def missing(name, *_):
        raise ImportError("no module named xxhash")

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    with pytest.warns(UserWarning, match="xxhash"):
        assert set(entry.queries()) == set(CORE)


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
