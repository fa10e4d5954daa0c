"""The chain of embedding providers."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.operators import embed
from tessella.operators.embed import Chain, Provider


def failing():
    raise OSError("no endpoint")


def of(f):
    return lambda: f


def flat(texts):
    return [[float(len(t))] * 4 for t in texts]


def test_the_next_provider_is_asked(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else f"text {i % 5}") for i in range(200)] + [(500, "")], "id long, text string").coalesce(1)
    wrong = [Provider("down", failing), Provider("few", of(lambda ts: flat(ts)[1:])), Provider("size", of(lambda ts: [[1.0]] * len(ts))), Provider("nan", of(lambda ts: [[np.nan] * 4] * len(ts)))]
    got = embed.embedded(rows, "text", [*wrong, Provider("good", of(flat))], 4, "q: ").collect()
    assert len(got) == 201
    for r in got:
        want = (None, None) if r.text is None else ([float(len("q: " + r.text))] * 4, "good")
        assert (r.embedding, r.provider) == want
    # five texts and the empty one are asked for once
    assert sum(r.cached is False for r in got) == 6 and sum(r.cached is True for r in got) == 194


def test_no_provider_left(spark):
    rows = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(PySparkException, match="down: no endpoint"):
        embed.embedded(rows, "t", [Provider("down", failing)], 4).collect()


def test_memory_is_bounded_and_counts():
    asked = []
    chain = Chain([Provider("p", of(lambda ts: asked.extend(ts) or flat(ts)))], 4, 2)
    assert [x[2] for x in chain.vectors(["a", "b", "a"])] == [False, False, True]
    assert chain.vectors(["c"])[0][2] is False and list(chain.known) == ["a", "c"]
    assert [x[2] for x in chain.vectors(["a", "b"])] == [True, False] and asked == ["a", "b", "c", "b"]
    many = [f"t{i}" for i in range(300)]
    assert len(chain.vectors(many + [None])) == 301 and len(chain.known) == 2


def test_a_provider_that_comes_back_is_used():
    up = []
    def sometimes(texts):
        if not up:
            raise OSError
        return flat(texts)
    chain = Chain([Provider("first", of(sometimes)), embed.hashing(4)], 4)
    assert chain.vectors(["a"])[0][1] == "hashing"
    up.append(1)
    assert chain.vectors(["b"])[0][1] == "first"


def test_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([("x y", [1.0], "old")], "t string, embedding array<double>, provider string")
    got = embed.embedded(rows, "t", [embed.hashing(8)], 8)
    assert got.columns == ["t", "embedding", "provider", "cached"]
    assert got.select(F.size("embedding"), "provider").first() == (8, "hashing")
    assert embed.embedded(rows.limit(0), "t", [embed.hashing(8)], 8).count() == 0
    assert np.allclose(embed.query_vector("x y", [embed.hashing(8)], 8), got.first().embedding)
