"""Centroid clustering (operator 11): exact integer k-means with block-norm screening.

A vector's components become integers floor(256 * x). Its compressed form is the Euclidean norms of its
``BLOCKS`` segments, worked out once and kept beside it. By Cauchy-Schwarz, within each segment, the
inner product of a vector and a centroid is at most the product of their segment norms, so

    |v|^2 + |c|^2 - 2 * sum of (segment norms of v * segment norms of c)

is at most their squared distance. A centroid whose bound, less a margin for rounding, is above the
best exact distance so far can be neither nearer nor tied; only the others get exact integer distances.

A round is one pass over the stored table and one sum of K rows a partition; the centroids (K times the
components, whatever the table's size) are all that the driver holds.

Defined cases: vectors that are null, of another length, or that hold null or non-finite components are
left out; components beyond +-2^27 after scaling (524,288 before) are held there, as squared distances
beyond would not fit a long; repeated rows count as often as they stand there and are clustered alike; a
null vec_id is hashed as an empty text; with fewer than K vectors each starts a centroid, and an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

SIZE, K, ROUNDS, SEED = 64, 40, 5, 2
#: Segments of a vector.
BLOCKS = 8
SCALE, MOST = 256, 1 << 27


def block_norms(v: np.ndarray) -> np.ndarray:
    """The Euclidean norm of each segment of each row."""
    blocks = min(BLOCKS, v.shape[1])
    edges = np.linspace(0, v.shape[1], blocks + 1).astype(int)[:-1]
    return np.sqrt(np.add.reduceat((v * v).astype(np.float64), edges, axis=1))


def nearest(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each integer row, ties to the smaller number, and how many exact distances it took."""
    own = block_norms(centroids)
    squares, theirs = (norms * norms).sum(axis=1)[:, None], (own * own).sum(axis=1)[None, :]
    bound = squares + theirs - 2 * norms @ own.T
    bound -= 1e-9 * (squares + theirs) + 1
    first = bound.argmin(axis=1)
    diff = v - centroids[first]
    best, which, made = (diff * diff).sum(axis=1), first.astype(np.int64), len(v)
    for c in range(len(centroids)):
        at = np.flatnonzero((bound[:, c] <= best) & (first != c))
        diff = v[at] - centroids[c]
        d = (diff * diff).sum(axis=1)
        made += len(at)
        nearer = (d < best[at]) | ((d == best[at]) & (c < which[at]))
        best[at[nearer]], which[at[nearer]] = d[nearer], c
    return which, best, made


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        with np.errstate(over="ignore"):
            v = np.clip(np.floor(SCALE * x), -MOST, MOST).astype("<i4")
        norms = block_norms(v.astype(np.int64))
        binary = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), binary(v), binary(norms)], ["vec_id", "v", "norms"])


def prepared(vectors: DataFrame, size: int) -> DataFrame:
    """(vec_id, v, norms) of the kept vectors: integers and segment norms as bytes; vectors has vec_id and one other column."""
    other = [c for c in vectors.columns if c != "vec_id"][0]
    rows = tables.pick(vectors, "vec_id", other).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(other).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("x") == size) & finite).mapInArrow(_prepare, "vec_id long, v binary, norms binary")


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    join = lambda column: b"".join(column.to_pylist())
    v = np.frombuffer(join(batch.column("v")), "<i4").reshape(len(batch), -1).astype(np.int64)
    return v, np.frombuffer(join(batch.column("norms")), np.float64).reshape(len(batch), -1)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for batch in batches:
        v, norms = _arrays(batch)
        which, _, _ = nearest(v, norms, centroids)
        n += np.bincount(which, minlength=len(n))
        np.add.at(total, which, v)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        which, distance, _ = nearest(*_arrays(batch), centroids)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(which, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floors of the means; empty ones stay."""
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    parts = rows.select("v", "norms").mapInArrow(partial(_sums, centroids=centroids), "cluster int, n long, sums array<bigint>")
    sums = [exact(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(exact(F.col("n")).alias("n"), *sums).collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the kept vectors."""
    spark = vectors.sparkSession
    rows = tables.store(prepared(vectors, size), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select("v", order.alias("h")).orderBy("h", "v").limit(k).collect()
    told = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], told)
    centroids = np.array([np.frombuffer(r["v"], "<i4") for r in first], np.int64)
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    out = tables.store(rows.mapInArrow(partial(_assign, centroids=centroids), "vec_id long, cluster int, distance long"), "clusters")
    tables.drop(rows)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    held = lambda d: min(d, (1 << 63) - 1)
    total = held(sum(sums.values()))
    # one row for each of the k centroids
    small = spark.createDataFrame([(c, held(d), total, digests[c]) for c, d in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(small), "cluster").select(*[x.split()[0] for x in told.split(", ")])


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(tables.read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql() -> str:
    """The rounds as one chain of common table expressions."""
    nearest_of = lambda i: (
        f"d{i} as (select v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) as d from e v join c{i} c on v.j = c.j group by v.r, c.c), "
        f"a{i} as (select r, min(d) as d, arg_min(c, (d, c)) as c from d{i} group by r)"
    )
    parts = [
        f"""k as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
 where len(embedding) = {SIZE} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        "e as materialized (select r, unnest(v) as x, generate_subscripts(v, 1) as j from k)",
        f"s as (select row_number() over (order by sha256('{SEED}:' || vec_id::varchar)) - 1 as c, v from k order by c limit {K})",
        "c0 as (select c, unnest(v) as x, generate_subscripts(v, 1) as j from s)",
    ]
    for i in range(ROUNDS):
        mean = f"select a.c, e.j, sum(e.x)::bigint as t, count(*) as n from a{i} a join e on e.r = a.r group by a.c, e.j"
        parts += [nearest_of(i), f"m{i} as ({mean})", f"c{i + 1} as materialized (select c.c, c.j, case when m.n is null then c.x else (m.t - ((m.t % m.n) + m.n) % m.n) // m.n end as x from c{i} c left join m{i} m on m.c = c.c and m.j = c.j)"]
    parts.append(nearest_of(ROUNDS))
    parts.append(f"h as (select c, sha256(string_agg(x::varchar, ',' order by j)) as h from c{ROUNDS} group by c)")
    return (
        "with " + ",\n".join(parts) + f"\nselect k.vec_id, a.c::integer as cluster, a.d::bigint as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia, "
        f"(sum(a.d) over ())::bigint as inertia, h.h as centroid_sha256 from a{ROUNDS} a join k on k.r = a.r join h on h.c = a.c"
    )


ORACLE_SQL = {"op11_centroids": _sql()}
