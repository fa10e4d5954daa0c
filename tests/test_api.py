"""The facade: what each action returns."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.api import Store, register
from tessella.operators import enrich
from tessella.sources.records import records


@pytest.fixture(scope="module")
def store(spark, sf):
    rows = records(spark, sf).cache()
    return Store(rows, "alpha", datetime(2026, 1, 1))


def test_retrieve(spark, store):
    words = store.own.where("status = 'active'").orderBy("uuid").first().content[:60]
    vector = store.own.where("embedding is not null").first().embedding
    top = store.retrieve(words, vector, limit=3).collect()
    assert 0 < len(top) <= 3 and [r.fusion for r in top] == sorted((r.fusion for r in top), reverse=True)
    assert store.retrieve(words).count() > 0 and store.retrieve("ok thanks", vector).count() == 0
    assert {r.profile for r in store.retrieve(words, vector, limit=50, across=True).collect()} > {"alpha"}
    assert all(r.profile != "alpha" for r in store.discover(vector).collect())
    scores = spark.createDataFrame([(top[-1].uuid, 9.0)], "uuid long, model_score double")
    assert store.retrieve(words, vector, depth=3, limit=3, scores=scores).first().uuid == top[-1].uuid
    with pytest.raises(TypeError):
        store.retrieve(3)


def test_changes(spark, store):
    new = store.own.limit(2).withColumn("uuid", F.col("uuid") + 10_000)
    table, verdicts = store.add(new.withColumn("embedding", F.lit(None).cast("array<float>")))
    assert {r.verdict for r in verdicts.collect()} == {"added"} and table.count() == store.rows.count() + 2
    assert store.delete(store.own.limit(1).select("uuid")).where("status = 'deleted'").count() > 0
    assert store.delete_many(content_like="%zzzz%").first().would_delete == 0
    with pytest.raises(ValueError):
        store.delete_many(most=0, execute=True, content_like="%e%")
    assert store.sleep().count() > 0 and store.decay().count() > 0 and store.purge().count() < store.rows.count()
    assert store.import_records(new.select("uuid", "content", "source"), "overwrite").count() == store.rows.count() + 2


def test_rest(spark, store, tmp_path):
    assert store.count().first().n > 0 and store.stats().count() == 1 and store.overview().count() > 0 and store.list("trust", 5).count() == 5
    assert store.export("markdown").count() == store.export("json").count()
    Store.write(store.rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == store.rows.count()
    assert store.review(limit=3).where("verdict is not null").count() == 3
    assert enrich.first_json('sure: {"a": [1]} and more') == {"a": [1]} and enrich.first_json("none") is None


def test_register(spark):
    register(spark)
    row = spark.sql("select text_tokens('A b-2') t, cosine(array(1D, 0D), array(1D, 0D)) c, fence_untrusted('x', 'import') f").first()
    assert (row.t, row.c, row.f) == (["a", "b", "2"], 1.0, "<untrusted_external_doc>x</untrusted_external_doc>")
