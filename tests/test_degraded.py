"""Each way of the degraded chain, forced by the rows of a small table."""

from datetime import datetime

import pytest

from tessella.api import Store
from tessella.operators import retrieval as R
from tessella.sources.records import RECORD

HIT = {1: 0.9, 2: 0.5, 9: 0.99}


@pytest.fixture(scope="module")
def rows(spark):
    columns = [c.split()[0] for c in RECORD.split(", ")]
    base = dict.fromkeys(columns) | {"sensitivity": 0, "priority": 1, "protected": False, "status": "active", "reference_count": 0, "keywords": [], "summary": "", "topic": "", "data_id": "",
                                     "created_at": datetime(2025, 1, 1), "updated_at": datetime(2025, 1, 1)}
    given = [
        (1, "own", "red fox", 0.2, [1.0, 0.0]), (2, "own", "blue fox fox", 0.9, [0.6, 0.8]), (3, "own", "green", 0.5, None), (4, "own", "fox", 0.7, [1.0]),
        (5, "other", "fox den", 0.1, [1.0, 0.0]), (6, "other", "plain", 0.8, None), (7, "own", "fox", 0.99, [1.0, 0.0]),
    ]
    out = [base | {"uuid": u, "profile": p, "content": c, "trust_score": t, "embedding": e} | ({"status": "deleted"} if u == 7 else {}) for u, p, c, t, e in given]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in out], RECORD)


def told(df):
    found = sorted(((r.distance, r.uuid, r["mode"]) for r in df.collect()))
    return {m for _, _, m in found}, [(u, round(d, 6)) for d, u, _ in found]


@pytest.mark.parametrize("query, vector, profile, mode, wanted", [
    ("fox", [1.0, 0.0], None, {"brute_force"}, [(1, 0.0), (2, 0.4)]), ("fox", [1.0, 0.0, 0.0], None, {"lexical"}, None), ("fox", None, "own", {"lexical"}, None),
    ("fox", [1.0, 0.0], "other", {"lexical"}, [(5, 0.1)]), ("owl", [1.0, 0.0], "other", {"scan"}, [(6, 0.1), (5, 0.5)]),
    ("owl", None, None, {"scan"}, [(2, 0.1), (4, 0.233333), (3, 0.366667), (1, 0.5)]), ("?", None, None, {"scan"}, None), ("fox", None, "nobody", set(), []),
])
def test_ways(rows, query, vector, profile, mode, wanted):
    got, found = told(Store(rows, "own", datetime(2026, 1, 1)).fallback(query, vector, profile))
    assert got == mode
    if wanted is not None:
        assert found == wanted


@pytest.mark.parametrize("state, hits, mode, wanted", [
    (False, HIT, "vector", [(1, 0.1), (2, 0.5)]), (True, HIT, "brute_force", [(1, 0.0), (2, 0.4)]), (False, {}, "brute_force", [(1, 0.0), (2, 0.4)]), (None, HIT, "vector", [(1, 0.1), (2, 0.5)]),
])
def test_breaker_and_index(spark, rows, state, hits, mode, wanted):
    own = rows.where("profile = 'own'")
    breaker = None if state is None else spark.createDataFrame([(state,)], "open boolean")
    indexed = spark.createDataFrame(list(hits.items()), "uuid long, sim double")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    assert told(R.degraded(own, q, R.bm25(own, ["fox"]), 30, indexed=indexed, breaker=breaker)) == ({mode}, wanted)


def test_limits(spark, rows):
    own = rows.where("profile = 'own'")
    none = spark.createDataFrame([], "q array<float>")
    mode, found = told(R.degraded(own, none, R.bm25(own, ["fox"]), 2))
    assert mode == {"lexical"} and len(found) == 2 and [d for _, d in found] == [0.1, 0.5]
    assert R.degraded(own.limit(0), none, R.bm25(own.limit(0), ["fox"]), 2).count() == 0
