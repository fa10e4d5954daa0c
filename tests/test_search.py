"""Stemmed search against the full-text search of an embedded database."""

import random
import re
import sqlite3
import uuid

import pytest
from pyspark.sql import functions as F

from tessella.functions import stem
from tessella.operators import summaries as S
from tessella.sources import postings, scratch

TOKENIZER = "porter unicode61 remove_diacritics 2"


def database(columns):
    con = sqlite3.connect(":memory:")
    try:
        con.execute(f"create virtual table t using fts5({columns}, tokenize='{TOKENIZER}')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search in this build")
    return con


def told(words):
    """Terms of each word by the database."""
    con, out = database("a"), [[] for _ in words]
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    con.executemany("insert into t(rowid, a) values (?, ?)", list(enumerate(words)))
    for term, doc in con.execute("select term, doc from v order by doc, offset"):
        out[doc].append(term)
    return out


@pytest.mark.parametrize("word, wanted", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
    ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
    ("rational", "ration"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"), ("adjustable", "adjust"),
    ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("is", "is"), ("Élans", "elan"), ("x́y", "xy"), ("straße", "straß"),
])
def test_stems(word, wanted):
    assert stem.search_terms(word) == [wanted]


def test_stems_equal_the_database(spark, sf):
    words = {w for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() for w in re.findall(r"[^\W_]+", (r.text or "").lower())}
    rng = random.Random(5)
    endings = [e for e, _ in stem.STEP_2 + stem.STEP_3] + stem.STEP_4 + "ed ing eed s es ies sses y e ll tt ss at bl iz sion".split()
    for start in ("rel", "hop", "bl", "y", "sky", "ag", "gener", "x", "vi", "émin", "Ünï", "слов", "λόγ", "ẩm", "straß"):
        words |= {start + a + b for a in endings for b in rng.sample(endings, 6) + [""]}
    words = sorted(words | {a + b for a in endings for b in endings} | {"x" * 70 + "ing"})
    assert [stem.search_terms(w) for w in words] == told(words)


def test_columns_equal_the_function(spark):
    texts = ["The Élan's running, RUNNING runners ẩm x́y", "", None, "a_b foo-bar 12th", "İstanbul Straßen", "—"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(stem.search_tokens(F.col("t"))).collect()]
    assert got == [None if t is None else stem.search_terms(t) for t in texts]


TEXTS = ["running dogs run", "the runner ran; a dog runs", "Élan vital, élans", "nothing of it", None, "", "dogs " * 60 + "running " + "cats " * 60, "relational databases relate relations"]


def summary_rows(spark, texts):
    rows = [(i, f"Title {i}" if i % 2 else None, t) for i, t in texts.items()]
    return spark.createDataFrame(rows, "page_id long, title string, full_text string").withColumn("created_at", F.expr("timestamp_ntz'2026-01-01' + make_dt_interval(cast(page_id as int))"))


@pytest.mark.parametrize("query", ["Runs, dog!", "elan", "relating", "run run title", "nowhere", "?!"])
def test_search_equals_the_database(spark, query):
    texts = dict(enumerate(TEXTS))
    index = postings.Postings(spark, f"{scratch.checkpoints(spark)}/test-{uuid.uuid4().hex}", 4, S.stemmed_words)
    index.write(S.indexed(summary_rows(spark, texts)), 0)
    changed = {3: "dogs again", 20: "it runs", 21: "the vital relation"}
    texts |= changed
    index.write(S.indexed(summary_rows(spark, changed)), 1)
    index.delete(spark.createDataFrame([(1,)], "uuid long"), 2)
    del texts[1]
    con = database("title, full_text")
    con.executemany("insert into t(rowid, title, full_text) values (?, ?, ?)", [(i, f"Title {i}" if i % 2 else None, t) for i, t in texts.items()])
    asked = " OR ".join(f'"{w}"' for w in re.findall(r"\w+", query.lower()))
    wanted = con.execute("select rowid, -rank from t where t match ?", (asked,)).fetchall() if asked else []
    rows = summary_rows(spark, texts)
    found = S.search_stems(rows, index, query, 50).collect()
    assert {r.page_id: r.score for r in found} == pytest.approx(dict(wanted), abs=1e-5)
    assert [r.page_id for r in found] == [r.page_id for r in sorted(found, key=lambda r: (-r.score, r.page_id))]
    assert [r.page_id for r in S.search_stems(rows, index, query, 50, "date").collect()] == sorted((i for i, _ in wanted), reverse=True)


def test_marks(spark):
    text = "w " * 20 + "Running élans " + "v " * 60
    got = spark.createDataFrame([(text,), ("no hit",), (None,), ("",)], "t string").select(S.marked(F.col("t"), ["run", "elan"])).collect()
    assert got[0][0] == "..." + "w " * 8 + "<b>Running</b> <b>élans</b> " + " ".join(["v"] * 38) + "..."
    assert [r[0] for r in got[1:]] == ["no hit", None, ""]
