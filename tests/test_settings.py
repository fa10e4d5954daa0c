"""Settings and taxonomy against a replay, one request after the other; deletions and synchronising of summaries."""

import random

from tessella.operators import settings as S
from tessella.operators import summaries


def test_config_replay(spark):
    rng = random.Random(5)
    keys = ["max_layer", "dedup_threshold", "tracing", "scoring", "own", "other", "", None]
    values = ["1", "0", "4", "5", "yes", "no", "0.5", "1.5", "nan", "x", "{}", '{"a": 1}', "[1]", "", None, " 2 "]
    requests = [(i, rng.choice(["set", "set", "delete", "get", None]), rng.choice(keys), rng.choice(values)) for i in range(300)]
    layers = [("max_layer", "env", "3"), ("own", "env", "e"), ("own", "file", "f"), ("other", "file", "o"), ("dedup_threshold", "file", "0.9"), ("unused", "file", "u")]

    def fits(key, v):
        if v is None or not key:
            return False
        t = v.strip()
        try:
            n = float(t)
        except ValueError:
            n = None
        if key == "max_layer":
            return t.lstrip("+-").isdigit() and 0 <= int(t) <= 4
        if key == "dedup_threshold":
            return n is not None and 0 <= n <= 1
        if key == "tracing":
            return t.lower() in ("1", "0", "yes", "no", "true", "false", "on", "off")
        return t.startswith("{") if key == "scoring" else True

    env = {k: v for k, where, v in layers if where == "env"}
    file = {k: v for k, where, v in layers if where == "file"}
    runtime, want = {}, {}
    for seq, action, key, value in requests:
        if action == "set" and fits(key, value):
            runtime[key] = value
            file.pop(key, None)
            want[seq] = ("updated", value)
        elif action == "delete":
            if key in runtime:
                del runtime[key]
                want[seq] = ("deleted", env.get(key))
            else:
                want[seq] = ("not_a_runtime_override" if key in env or key in file else "not_found", None)
        else:
            want[seq] = ("error", None)
    asked = spark.createDataFrame(requests, "seq long, action string, key string, value string").repartition(3)
    under = spark.createDataFrame(layers, "key string, layer string, value string")
    got = {r.seq: (r.status, None if r.status == "error" else r.value) for r in S.config_changes(asked, under).collect()}
    assert got == want
    now = {r.key: (r.value, r.layer) for r in S.config_now(asked, under).collect()}
    assert now == {k: (v, "file") for k, v in file.items()} | {k: (v, "env") for k, v in env.items()} | {k: (v, "runtime") for k, v in runtime.items()}
    assert S.config_changes(asked.limit(0), under).count() == 0 and S.config_now(asked.limit(0), under.limit(0)).count() == 0


def test_taxonomy_replay(spark):
    rng = random.Random(6)
    names = ["A", "b.c", "x" * 64, "x" * 65, "-bad", "", "é", None]
    requests = [(i, rng.choice(["register", "unregister", "rename", None]), rng.choice(names), rng.choice(["data_type", "data_id", "other", None]), rng.choice([None, "c"]), str(i)) for i in range(300)]
    table, want = {}, {}
    for seq, action, name, kind, collection, told in requests:
        good = name is not None and 0 < len(name) <= 64 and name not in ("-bad", "é")
        if action == "register" and kind in S.TAXONOMY_KINDS and good:
            table[name, kind] = (collection or "memories" if kind == "data_type" else collection, told)
            want[seq] = "registered"
        elif action == "unregister" and name is not None and (kind is None or kind in S.TAXONOMY_KINDS):
            hit = [k for k in table if k[0] == name and kind in (None, k[1])]
            for k in hit:
                del table[k]
            want[seq] = "unregistered" if hit else "not_found"
        else:
            want[seq] = "error"
    asked = spark.createDataFrame(requests, "seq long, action string, name string, kind string, collection string, description string").repartition(3)
    assert {r.seq: r.status for r in S.taxonomy_changes(asked).collect()} == want
    assert {(r.name, r.kind): (r.collection, r.description) for r in S.taxonomy_now(asked).collect()} == table
    assert S.taxonomy_now(asked.limit(0)).count() == 0


def test_summaries_deleted_and_synced(spark):
    rows = spark.createDataFrame([(1, "a", "t", "p1"), (2, "b", "t", "p2"), (3, "a", "", "p3"), (4, "a", "t", "p4"), (5, None, "t", "p5"), (6, "a", "t", None)], "page_id long, profile_name string, full_text string, summary_path string")
    asked = spark.createDataFrame([(1,), (1,), (2,), (99,), (None,), (5,)], "page_id long")
    left, told = summaries.deleted(rows, asked, "own", "a")
    assert {r.page_id for r in left.collect()} == {2, 3, 4, 5, 6} and {(r.page_id, r.outcome) for r in told.collect()} == {(1, "deleted"), (2, "foreign"), (5, "foreign"), (99, "missing")}
    assert {r.page_id for r in summaries.deleted(rows, asked, "all")[0].collect()} == {3, 4, 6}
    files = spark.createDataFrame([("p1",), ("p1",), ("p9",)], "path string")
    outcomes = summaries.sync_outcomes(rows, files, "all", "a")
    assert {(r.page_id, r.outcome) for r in outcomes.collect()} == {(1, "kept"), (2, "foreign"), (3, "orphaned"), (4, "preserved"), (5, "foreign")}
    assert {(r.page_id, r.summary_path) for r in summaries.synced(rows, outcomes).collect()} == {(1, "p1"), (2, "p2"), (4, None), (5, "p5"), (6, None)}
