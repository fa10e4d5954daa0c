"""Best matches: parts that meet in tasks of their own, one pass for several checks."""

import numpy as np
import pandas as pd
import pytest

from tessella.operators import graph


def rows(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(n, 8)), 1).astype("float32")
    v[n // 2] = v[1]
    pdf = pd.DataFrame({"uuid": np.arange(n), "data_type": np.where(np.arange(n) % 3 == 0, "A", "B"), "embedding": v.tolist()})
    return spark.createDataFrame(pdf, "uuid long, data_type string, embedding array<float>"), v


def test_each_pair_of_parts_has_a_task(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_ROWS", 32)
    df, _ = rows(spark, 300)

    def told(pdf):
        from pyspark import TaskContext

        return pd.DataFrame({"part": [TaskContext.get().partitionId()], "new": [int(pdf["new"].sum())], "old": [int((~pdf["new"]).sum())]})

    got = graph._grid(df, df.where("uuid % 2 = 0"), "data_type").applyInPandas(told, "part long, new long, old long").toPandas()
    # 100 and 200 rows meet 50 and 100: 4 * 2 + 7 * 4 pairs of parts
    assert len(got) == 36 and got["part"].nunique() == 36
    assert got["new"].sum() == 100 * 2 + 200 * 4 and got["old"].sum() == 50 * 4 + 100 * 7


@pytest.mark.parametrize("tasks", [3, 1000])
def test_best_matches_over_parts(spark, monkeypatch, tasks):
    monkeypatch.setattr(graph, "BLOCK_ROWS", 32)
    monkeypatch.setattr(graph, "MOST_TASKS", tasks)
    df, v = rows(spark, 300, 1)
    got = {r.uuid: (r.match, r.sim) for r in graph.best_matches(df, df.where("uuid % 2 = 0")).collect()}
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    sim = np.round(np.clip(unit @ unit.T, -1, 1), 6)
    for i in range(300):
        of = [j for j in range(0, 300, 2) if j != i and (j % 3 == 0) == (i % 3 == 0)]
        best = max(of, key=lambda j: (sim[i, j], -j))
        assert got[i] == (best, sim[i, best])


def test_first_best():
    sim = np.array([[0.1, 0.5, 0.4999999, 0.5], [-2, -2, -2, -2], [np.nan, np.nan, np.nan, np.nan], [-0.3, -2, -0.30000001, -0.4]])
    best, top = graph._first_best(sim)
    assert best.tolist() == [1, 0, 0, 0] and top[[0, 1, 3]].tolist() == [0.5, -2, -0.3] and np.isnan(top[2])


@pytest.mark.parametrize("name", ["add_batch_verdicts", "add_pass"])
def test_verdicts_of_ids_with_two_vectors(spark, tmp_path, name):
    """Each vector of an id makes a row of the store, as in the SQL, and a verdict for it."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.sql(f"copy (select * from (values (1::bigint, 'a b', 'en', 'Web', 3::bigint), (8, 'c d', 'en', 'Web', 3), (15, 'e f', 'en', 'Web', 3)) t(doc_id, text, lang, source, n_chars)) to '{tmp_path}/documents.parquet'")
    con.sql(f"copy (select * from (values (1::bigint, [1.0::float, 0.0], 1), (1, [0.0, 1.0], 1), (8, [1.0, 0.5], 1)) t(vec_id, embedding, label)) to '{tmp_path}/embeddings.parquet'")
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(entry.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_rows_meet_pivots_in_steps(spark, monkeypatch):
    """Vectors in clusters have cells; a worker holds the angles of STEP_ROWS rows at once."""
    unit, step = graph._unit, 16

    def checked(rows):
        assert len(rows) <= step, len(rows)
        return unit(rows)

    for name, value in (("_unit", checked), ("BLOCK_ROWS", 20), ("STEP_ROWS", step)):
        monkeypatch.setattr(graph, name, value)
    rng = np.random.default_rng(3)
    x = np.repeat(np.eye(8), 50, 0) + rng.normal(size=(400, 8)) * 0.01
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate(x.tolist())], "uuid long, block string, embedding array<double>")
    got = graph._celled(df, 0.9).where("home")
    assert got.count() == 400 and got.select("cell").distinct().count() > 4
