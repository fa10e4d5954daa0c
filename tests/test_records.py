"""The store derived from the tables: what passes its join, and what ids that repeat make."""

import duckdb

from tessella.sources.records import MEM_SQL, records


def joined(df):
    """Names of the columns that enter the left side of each join."""
    todo, out = [df._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            attributes = below[0].output()
            out.append({attributes.apply(i).name() for i in range(attributes.size())})
        todo += below
    return out


def test_texts_pass_the_join_only_where_they_are_asked_for(spark, sf):
    (left,) = joined(records(spark, sf).select("uuid", "keywords", "topic", "embedding"))
    assert "keywords" in left and not left & {"text", "content"}
    assert joined(records(spark, sf, vectors=False)) == []


def test_vectors_that_repeat_an_id_make_rows(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"copy (select * from (values (3::bigint, 'a b', 'en', 'Web', 3::bigint), (4, 'c', 'en', 'Web', 1)) t(doc_id, text, lang, source, n_chars)) to '{tmp_path}/documents.parquet'")
    con.sql(f"copy (select * from (values (3::bigint, [1.0::float], 1), (3, [2.0::float], 1)) t(vec_id, embedding, label)) to '{tmp_path}/embeddings.parquet'")
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = sorted(con.sql(f"with {MEM_SQL} select uuid, topic from mem").fetchall())
    assert want == [(3, "en a"), (3, "en a"), (4, "en c")]
    for vectors in (True, False):
        assert sorted(map(tuple, records(spark, str(tmp_path), vectors=vectors).select("uuid", "topic").collect())) == want
