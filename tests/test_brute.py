"""What SQL can't express, against plain Python."""

import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()


def by_user(spark, sf):
    out: dict = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").collect():
        out.setdefault(r.user_id, []).append(r)
    return {u: sorted(rows, key=lambda r: (r.ts, r.event_id)) for u, rows in out.items()}


def test_throttle_turns(spark, sf):
    want = set()
    for user, rows in by_user(spark, sf).items():
        last = None
        for r in rows[4::5]:
            if last is None or (r.ts - last).total_seconds() >= 30:
                last = r.ts
                want.add((user, r.event_id))
    assert {tuple(r) for r in QUERIES["throttle_turns"](spark, sf).collect()} == want and want


def test_breaker_states(spark, sf):
    from tessella.operators import history

    # short limits, so that the few errors of a user open it
    want = {}
    for rows in by_user(spark, sf).values():
        errors, opened = 0, None
        for r in rows:
            over = opened is not None and (r.ts - opened).total_seconds() >= 3600
            if r.event_type == "error":
                errors += 1
                opened = r.ts if over or errors >= 2 else opened
            elif opened is None or over:
                errors, opened = 0, None
            want[r.event_id] = "open" if opened else "closed"
    events = spark.read.parquet(f"{sf}/events.parquet")
    got = {r.event_id: r.state for r in history.breaker_states(events, 2, 3600).collect()}
    assert got == want and set(got) == {r.event_id for r in QUERIES["breaker_states"](spark, sf).collect()}


def test_embed_hash(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["embed_hash"](spark, sf).collect():
        v = np.zeros(32)
        for w in re.findall(r"[^\W_]+", texts[r.uuid].lower()):
            h = zlib.crc32(w.encode())
            v[h % 32] += 1 if h & 0x10000 else -1
        assert np.allclose(r.embedding, v / (np.linalg.norm(v) or 1), atol=1e-6)


def test_ingest_md_parse(spark, sf):
    pages = {f"page{r.page_id}.md": r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["ingest_md_parse"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r.path]
        links = {m.split("|")[0].split("#")[0].strip() for m in re.findall(r"\[\[([^\]]+)\]\]", page.html)}
        assert (r.title, r.chars, r.n_links) == (f"t{page.page_id}", len(page.html), len(links - {""}))


@pytest.mark.parametrize("few", [200_000, 0])
@pytest.mark.parametrize("least", [0.2, 0.35])
def test_dup_groups(spark, sf, least, few, monkeypatch):
    from tessella.operators import filters, graph
    from tessella.sources.records import records

    monkeypatch.setattr(graph, "FEW_CLAIMS", few)
    rows = filters.status(records(spark, sf), "active")
    edges = graph.duplicate_edges(rows, least).select("a", "b", "sim")
    at = {r.uuid: (r.updated_at, r.source) for r in rows.collect()}
    near: dict = {}
    for r in edges.collect():
        if at[r.a][1] == at[r.b][1]:
            near.setdefault(r.a, []).append((-r.sim, r.b))
            near.setdefault(r.b, []).append((-r.sim, r.a))
    taken, want = set(), set()
    for seed in sorted(sorted(near), key=lambda u: at[u][0], reverse=True):
        free = [u for _, u in sorted(near[seed])[:10] if u not in taken]
        if seed not in taken and free:
            taken.update([seed, *free])
            want.update((seed, u) for u in [seed, *free])
    assert {(r.grp, r.uuid) for r in graph.greedy_groups(edges, rows, "source").collect()} == want
    if few:
        order = sorted({g for g, _ in want}, key=lambda u: (-at[u][0].timestamp(), u))
        kept = graph.greedy_groups(edges, rows, "source", most_groups=3).collect()
        assert {(r.grp, r.uuid) for r in kept} == {x for x in want if x[0] in order[:3]}
        seeds = sorted(near, key=lambda u: (-at[u][0].timestamp(), u))[:5]
        assert {r.grp for r in graph.greedy_groups(edges, rows, "source", most_seeds=5).collect()} == {g for g, _ in want if g in seeds}


def clustered(n, spread, seed=0):
    """Unit vectors around one centre for each 60 rows."""
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(max(1, n // 60), 16))
    x = c[rng.integers(0, len(c), n)] + rng.normal(size=(n, 16)) * spread
    return x / np.linalg.norm(x, axis=1)[:, None]


def vectors(spark, x):
    rows = [(i, "ab"[i % 2], [float(y) for y in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows + [(-1, "a", None), (-2, "a", [0.0] * 16)], "uuid long, block string, embedding array<double>")


@pytest.mark.parametrize("spread, least", [(0.1, 0.9), (0.02, 0.999), (1.0, 0.6), (0.1, 0.0)])
def test_similar_pairs_in_cells(spark, monkeypatch, spread, least):
    from tessella.operators import graph

    monkeypatch.setattr(graph, "BLOCK_ROWS", 40)
    x = clustered(900, spread)
    x[800:850] = x[:50]
    sim = np.round(np.clip(x @ x.T, -1, 1), 6)
    want = {(i, j) for i, j in zip(*np.nonzero(sim >= least)) if i < j and i % 2 == j % 2}
    got = graph.similar_pairs(vectors(spark, x), least).where("a >= 0").collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_cells_grow_with_the_rows(spark, monkeypatch):
    from tessella.operators import graph

    monkeypatch.setattr(graph, "BLOCK_ROWS", 40)
    visits = [graph._celled(vectors(spark, clustered(n, 0.02)).where("embedding is not null"), 0.97).count() / n for n in (800, 8000)]
    assert visits[1] < 1.5 * visits[0] < 8


def test_user_stated_fuzzy(spark, sf):
    import difflib

    from pyspark.sql import functions as F

    from tessella.functions import text as T

    rows = [("deployed postgres 16 cluster", "we have deploid the postgress 16 clusters"), ("deployed postgres 16 cluster", "deployed postgres 17 cluster"), ("", "words here"), ("alpha beta", None), ("kitchen table", "kitten stable table"), ("deployed postgres cluster", "we deployed postgres16 on the cluster")]
    df = spark.createDataFrame(rows, "content string, message string")
    words = df.select(T.user_tokens(F.col("content")), T.user_tokens(F.col("message")), T.fuzzy_user_share(F.col("content"), F.col("message"))).collect()
    digits = lambda w: any(c.isdigit() for c in w)
    for own, said, share in words:
        if not own or not said:
            assert share is None
            continue
        hits = [w in said or not digits(w) and any(difflib.SequenceMatcher(None, w, x, autojunk=False).ratio() >= 0.8 for x in said) for w in own]
        assert share == pytest.approx(sum(hits) / len(own))
    exact = {r.uuid for r in QUERIES["user_stated_exact"](spark, sf).collect() if r.stated}
    assert exact <= {r.uuid for r in QUERIES["user_stated_fuzzy"](spark, sf).collect() if r.stated}


def test_import_ids_are_uuid5(spark):
    import uuid

    from pyspark.sql import functions as F

    from tessella.operators import validation as V

    given = ["note 1", "é", str(uuid.uuid4()), uuid.uuid4().hex, "", "0" * 31]
    space = uuid.UUID(V.IMPORT_NAMESPACE)
    got = {r.t: r.i for r in spark.createDataFrame([(t,) for t in given], "t string").select("t", V.import_id(F.col("t")).alias("i")).collect()}
    assert got == {t: uuid.UUID(t).hex if len(t.replace("-", "")) == 32 else uuid.uuid5(space, t).hex for t in given}


def test_logs_rotate_prune_and_back_up(spark, sf, tmp_path):
    from tessella.sources import logs
    from tessella.sources.records import records

    events, path = spark.read.parquet(f"{sf}/events.parquet"), str(tmp_path / "log")
    logs.append(events, path)
    logs.append(events.limit(5), path)
    assert logs.read(spark, path).count() == events.count() + 5
    days = sorted(str(r.day) for r in logs.read(spark, path).select("day").distinct().collect())
    assert logs.prune(spark, path, days[1]) == [f"day={days[0]}"] and logs.rotate(spark, path, 1) == [f"day={x}" for x in days[1:-1]]
    assert logs.rotate(spark, path, 1 << 40) == [] and logs.prune(spark, str(tmp_path / "none"), "2020-01-01") == []
    rows = records(spark, sf)
    for name in ("b1", "b2", "b3"):
        logs.backup(rows, str(tmp_path / "backups"), name, keep=2)
    assert sorted(p.name for p in (tmp_path / "backups").iterdir()) == ["b2", "b3"] and spark.read.parquet(str(tmp_path / "backups/b3")).count() == rows.count()
    for name in ("../x", "", ".hidden", "a/b"):
        with pytest.raises(ValueError):
            logs.backup(rows, str(tmp_path / "backups"), name)
    logs.write_index(rows, str(tmp_path / "index"), "Hash v1")
    assert logs.read_index(spark, str(tmp_path / "index"), "Hash v1", 64).count() == rows.where("embedding is not null").count()
    assert logs.read_index(spark, str(tmp_path / "index"), "Hash v1", 32).count() == 0


def test_coercions():
    from tessella.operators import coerce

    assert [coerce.truth(x) for x in ("Yes", "0", None, 1, "off ", True)] == [True, False, False, True, False, True]
    with pytest.raises(ValueError):
        coerce.truth("maybe")
    assert [coerce.whole(x, 7, 0, 10) for x in ("3", "3.9", 99, "x", None, True, -4, float("inf"))] == [3, 3, 10, 7, 7, 7, 0, 7]
    assert coerce.structure('{"a": [1]}') == {"a": [1]} and coerce.structure("[1,") == "[1," and coerce.structure(5) == 5
    assert [coerce.like(d, v) for d, v in ((True, "no"), (3, "4"), (0.5, "x"), ([], "[1]"), ("a", 2))] == [False, 4, 0.5, [1], "2"]


def test_add_and_compact_passes(spark, sf):
    from pyspark.sql import functions as F

    from tessella.operators import filters, graph, passes
    from tessella.sources.records import records

    rows = records(spark, sf)
    told = passes.verdicts(rows, rows, 0.45, 0.4, -0.5)
    new = rows.withColumn("uuid", F.col("uuid") + 50_000)
    moved = told.withColumn("uuid", F.col("uuid") + 50_000)
    out = passes.added(rows, new, moved)
    kept = {r.uuid: r for r in moved.collect() if r.verdict in ("added", "supersedes")}
    after = {r.uuid: r for r in out.collect()}
    assert set(after) == {r.uuid for r in rows.collect()} | set(kept) and len(after) == out.count()
    for r in kept.values():
        if r.contradicts is not None:
            assert after[r.contradicts].superseded_by is not None
    live = filters.status(rows)
    groups = graph.greedy_groups(graph.duplicate_edges(live, 0.2).select("a", "b", "sim"), live, "source")
    members: dict = {}
    for r in groups.collect():
        members.setdefault(r.grp, []).append(r.uuid)
    texts = {r.uuid: r.content for r in rows.collect()}
    merged = passes.compacted(rows, groups).collect()
    assert {r.grp: r.compacted_from for r in merged} == {g: sorted(m) for g, m in members.items()} and merged
    assert all(r.content == "\n\n".join(texts[u] for u in r.compacted_from) and r.n == len(r.compacted_from) for r in merged)


def test_gap_is_asked_once(spark, sf):
    from datetime import datetime

    from tessella.api import Store
    from tessella.sources.records import records

    store = Store(records(spark, sf), "alpha", datetime(2026, 1, 1))
    words = store.own.where("status = 'active'").orderBy("uuid").first().content[:60]
    rows = store.retrieve(words, depth=4, limit=3, gap=lambda prompts: [f"{len(p)} characters" for p in prompts]).orderBy("rank").collect()
    assert rows[0].gap.endswith(" characters") and all(r.gap is None for r in rows[1:]) and "embedding" not in rows[0].asDict()


def test_compaction_asks_a_model_and_previews(spark, sf):
    from pyspark.sql import functions as F

    from tessella.operators import passes
    from tessella.sources.records import now, records

    rows = records(spark, sf).where("status = 'active'")
    ids = sorted(r.uuid for r in rows.select("uuid").collect())
    parts = {0: ids[:14], 1: ids[14:17], 2: ids[17:19], 3: ids[19:20]}
    groups = spark.createDataFrame([(m[0], u) for m in parts.values() for u in m], "grp long, uuid long")
    seen = {r.grp: r.would_merge for r in passes.compaction_preview(groups).collect()}
    assert seen == {ids[0]: ids[:10], ids[14]: ids[14:17], ids[17]: ids[17:19]}
    # nothing is said about two of the texts
    table, made = passes.compaction(rows, groups, now(), lambda texts: [None if t.count("\n\n") == 1 else f"merged {len(t)}" for t in texts])
    told = {r.grp: (r.uuid, r.compacted_from) for r in made.collect()}
    some = {g: (ids[-1] + 1 + g, m) for g, m in seen.items()}
    out = {r.uuid: r for r in table.collect()}
    assert told and told.items() <= some.items() and len(out) == len(ids) + len(told)
    gone = {u for _, m in told.values() for u in m}
    assert {u for u in ids if out[u].status == "deleted"} == gone and not {r.superseded_by for r in out.values()} & gone
    assert all(out[u].content.startswith("merged ") and out[u].embedding is None and out[u].status == "active" for u, _ in told.values())
    assert passes.compaction(rows, groups.limit(0), now())[0].count() == len(ids)


@pytest.mark.parametrize("most, forest", [(None, False), (3, False), (None, True)])
def test_similar_pairs_in_parts_that_return_less(spark, monkeypatch, most, forest):
    """The best of each row, and pairs that connect as all do, from parts of any size."""
    from tessella.operators import graph

    monkeypatch.setattr(graph, "BLOCK_ROWS", 60)
    monkeypatch.setattr(graph, "STEP_ROWS", 16)
    monkeypatch.setattr(graph, "BATCH_PAIRS", 7)
    x = clustered(300, 1.0, 3)
    x[250:] = x[:50]
    sim = np.round(np.clip(x @ x.T, -1, 1), 6)
    pairs = {(i, j): sim[i, j] for i, j in zip(*np.nonzero(sim >= 0.5)) if i < j and i % 2 == j % 2}
    got = {(r.a, r.b): r.sim for r in graph.similar_pairs(vectors(spark, x), 0.5, most, forest=forest).collect()}
    assert pairs and (forest or got.items() <= pairs.items())
    if forest:
        for edges in (pairs, got):
            label = {i: i for i in range(300)}
            for _ in range(300):
                for a, b in edges:
                    label[a] = label[b] = min(label[a], label[b])
            if edges is pairs:
                want = label
        assert label == want and len(got) < len(pairs)
    elif most:
        near: dict = {}
        for (a, b), s in pairs.items():
            near.setdefault(a, []).append((-s, b))
            near.setdefault(b, []).append((-s, a))
        for a, all_ in near.items():
            for _, b in sorted(all_)[:most]:
                assert (min(a, b), max(a, b)) in got
        assert len(got) < len(pairs)
    else:
        assert got == pairs


def test_rows_without_near_cells_are_not_copied_to_all_of_them(spark, monkeypatch):
    from tessella.operators import graph

    monkeypatch.setattr(graph, "BLOCK_ROWS", 40)
    x = np.random.default_rng(1).normal(size=(2000, 16))
    assert graph._celled(vectors(spark, x).where("embedding is not null"), 0.3).count() <= 2001


def test_parts_are_large_enough_for_few_copies(spark):
    """A row of 20,000 of a type is copied three times, not once for each 512 others."""
    from tessella.operators import graph

    rows = spark.range(20_000).selectExpr("id as uuid", "'x' as data_type", "array(float(id % 7), float(1)) as embedding")
    copies = graph._grid(rows, rows, "data_type").agg({"uuid": "count"}).agg({"count(uuid)": "sum"}).first()[0]
    assert copies == 2 * 3 * 20_000


@pytest.mark.parametrize("jaccard_min", [0.0, 0.4])
def test_conflicts_against_brute_force(spark, monkeypatch, jaccard_min):
    import datetime

    from tessella.operators import graph

    monkeypatch.setattr(graph, "BLOCK_ROWS", 50)
    monkeypatch.setattr(graph, "STEP_ROWS", 16)
    rng = np.random.default_rng(5)
    day = datetime.datetime(2025, 1, 1)
    rows = [
        (i, "ab"[i % 2], [None, "p", "q"][i % 3], [None, "s", "t"][int(rng.integers(3))], None if i == 7 else day + datetime.timedelta(days=int(rng.integers(60))),
         None if i % 11 == 0 else [str(w) for w in rng.integers(0, 6, int(rng.integers(0, 5)))], [float(v) for v in rng.normal(size=4)])
        for i in range(240)
    ]
    df = spark.createDataFrame(rows, "uuid long, data_type string, data_id string, source string, created_at timestamp_ntz, keywords array<string>, embedding array<double>")

    def sim(a, b):
        x, y = np.array(a[6]), np.array(b[6])
        return round(float(np.clip(x @ y / np.linalg.norm(x) / np.linalg.norm(y), -1, 1)), 6)

    def may(a, b):
        if a[1] != b[1] or a[4] is None or b[4] is None:
            return False
        days = abs((a[4] - b[4]).total_seconds()) / 86400
        return (a[2] is None or b[2] is None or a[2] == b[2]) and days >= 1 and not (a[2] == b[2] and a[3] == b[3] and days <= 30)

    def overlap(a, b):
        p, q = set(a[5] or ()), set(b[5] or ())
        return len(p & q) / len(p | q) if p and q else None

    want, against = {}, {}
    for a in rows:
        for b in rows:
            if a[0] != b[0] and may(a, b):
                s, j = sim(a, b), overlap(a, b)
                if a[0] < b[0] and s >= 0.5 and (s >= 0.95 if j is None else jaccard_min - 1e-9 < j < 1):
                    want[a[0], b[0]] = s
                if 0.1 <= s < 0.8 and (j is None or jaccard_min <= j < 1):
                    against[a[0]] = max(against.get(a[0], (-2, 0, 0)), (s, -b[0], b[0]))
    assert {(r.a, r.b): r.sim for r in graph.conflict_pairs(df, 0.5, jaccard_min - 1e-9).collect()} == want and want
    got = {r.uuid: (r.sim, r.match) for r in graph.contradictions(df, df, 0.1, 0.8, jaccard_min).collect()}
    assert got == {u: (s, m) for u, (s, _, m) in against.items()}
    parts = {r.node: r.component for r in graph.components(graph.conflict_pairs(df, 0.5, jaccard_min - 1e-9, forest=True)).collect()}
    assert parts == {r.node: r.component for r in graph.components(graph.conflict_pairs(df, 0.5, jaccard_min - 1e-9)).collect()}
