"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()
NO_SQL = {"embed_hash", "ingest_md_parse", "dup_groups", "throttle_turns", "breaker_states", "user_stated_fuzzy", "summaries_stemmed"}


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(NO_SQL & set(QUERIES)))
def test_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_query_has_sql_or_a_reason():
    own = {k for k in QUERIES if not k.startswith("op") and k != "pipeline"}
    assert own - set(ORACLES) == NO_SQL


def test_entry(spark):
    assert entry.entry(spark).columns == ["uuid", "distance", "bm25", "base", "trust_score", "fusion"]


@pytest.mark.parametrize("name", ["import_pass_overwrite", "import_pass_new_uuid"])
def test_imports_of_ids_that_repeat(spark, tmp_path, name):
    """With more than 100,000 ids, shifted ones meet others of the same batch; the SQL keeps both."""
    con = duckdb.connect()
    con.sql(f"copy (select * from (values (3::bigint, 'a b', 'en', 'Web', 3::bigint), (99999, 'c', 'en', 'Web', 1), (100003, 'd', 'en', 'Web', 1), (100001, 'e', 'en', 'Web', 1)) t(doc_id, text, lang, source, n_chars)) to '{tmp_path}/documents.parquet'")
    con.sql(f"copy (select 0::bigint as vec_id, [1.0::float] as embedding, 1 as label) to '{tmp_path}/embeddings.parquet'")
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.sql(ORACLES[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(tuple(plain(v) for v in r) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
