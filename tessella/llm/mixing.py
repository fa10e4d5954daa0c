"""Mixing sources to target weights (operator 8): iterative proportional fitting.

Token counts are summed by cell (source, language, topic). Raking then scales the cells'
weights until their sums match a target share for every source, language and topic, and
each document is sampled with its cell's calibrated probability: the cell's target over
its tokens, by ``scale``, never above 1. Unless given, the scale is the largest at which,
in each dimension, at most ``MARGIN`` of the kept tokens are in other categories than
raked; so it follows from the mass of tokens, and cells of a few can't set it.

A target is, unless given, the observed share to a power below 1: small sources,
languages and topics are raised, the mix stays near what there is. A document weighs the
tokens of its whole text. Its topic is a cluster of hashed token vectors: each token id adds
its weight to one component, the mean of the document's language goes, and TOPICS centres
are fitted by spherical k-means over all documents, from the same start every time.

Cells are sums; there are as many as combinations of categories, not documents. Up to
``DRIVER_CELLS`` of them are raked in numpy; more are raked by the same steps as
DataFrame operations. Sampling compares a hash of doc_id and text with the probability,
so it needs no shuffle, is repeatable, and treats repeated rows alike.

Defined cases: null source, language and topic are categories of their own; a null or
empty text counts no token and has probability 1 (it changes no mix); categories without
target tokens get weight 0; an empty table stays empty; other columns are kept by ``mix``.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, tables, workers

DIMENSIONS = ("source", "lang", "topic")
#: Target share = observed share to this power, then made to sum to 1.
POWERS = {"source": 0.8, "lang": 0.9, "topic": 0.9}
ROUNDS = 200
TOLERANCE = 1e-9
DRIVER_CELLS = 200_000
#: Share of the kept tokens that capped probabilities may move between categories; scales tried in a pass, and passes.
MARGIN, STEPS, PASSES = 0.01, 24, 3
NONE, OTHERS = "(none)", "(others)"
#: Components of a token vector and their scale, topics, rounds that fit them, languages with a mean of their own.
DIMS, UNIT, TOPICS, TOPIC_ROUNDS, CENTRED = 32, 10_000, 12, 5, 256
SEED = 20260
#: Bytes of text encoded at a time, chunks kept and rows sent at once by mix(): in a pipeline its workers stand beside a JVM that has grown.
SLICE_BYTES, FEW_KEPT, FEW_ROWS = 1 << 20, 150_000, 1000


def _directions(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(component, signed weight) of each token id. Vocabularies list frequent pieces first, so later ids say more."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIMS, size), rng.choice([-1.0, 1.0], size) * np.log2(2 + np.arange(size))


def token_vectors(ids: list[np.ndarray], component: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(text, DIMS) whole numbers: hashed sums of each text's token weights, damped and scaled to the length UNIT."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    sums = np.bincount(row * DIMS + component[flat], weight[flat], len(ids) * DIMS).reshape(-1, DIMS)
    return _scaled(np.sign(sums) * np.sqrt(np.abs(sums)))


def _scaled(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.round(np.divide(x, norm, out=np.zeros_like(x), where=norm > 0) * UNIT).astype("<i2")


def with_tokens(rows: DataFrame, text: str, keep: list[str], tokenizer: str | None = None, little: bool = False) -> DataFrame:
    """The columns ``keep`` of rows with n_tokens and vec (a token vector's bytes) of the whole text; ``little``: in less memory, with more time."""
    bounds = (FEW_KEPT, True) if little else ()
    most = SLICE_BYTES if little else encoding.SLICE_BYTES
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + ["n_tokens long", "vec binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(tokenizer or encoding.default_path(), *bounds)
        component, weight = _directions(enc.model.get_vocab_size())
        for batch in batches:
            sizes, vectors = [], []
            for _, part in encoding.slices(batch.column(text).cast(pa.string()), most):
                ids = enc.encode(part)
                sizes += [len(x) for x in ids]
                vectors += [v.tobytes() for v in token_vectors(ids, component, weight)]
            made = [pa.array(sizes, pa.int64()), pa.array(vectors, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, "n_tokens", "vec"])
        workers.trim()

    return rows.select(*keep, *([] if text in keep else [text])).mapInArrow(run, schema)


class Topics:
    """Clusters of token vectors, each less the mean of its language, so that languages aren't topics."""

    def __init__(self, means: dict[str, np.ndarray], centres: np.ndarray):
        self.means, self.centres = means, centres

    def apart(self, langs: list[str], vectors: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(vectors), "<i2").reshape(-1, DIMS).astype(float)
        names = sorted(set(langs))
        number = {n: i for i, n in enumerate(names)}
        at = np.array([number[n] for n in langs], np.int64)
        mean = np.array([self.means.get(n, self.means[OTHERS]) for n in names]).reshape(-1, DIMS)
        return np.where((x != 0).any(1, keepdims=True), _scaled(x - mean[at]), 0) if len(x) else x

    def of(self, apart: np.ndarray) -> np.ndarray:
        """The number of the nearest centre, -1 of what is empty or no different from its language; ties go to the first."""
        return np.where((apart != 0).any(1), (apart @ self.centres.T).argmax(1), -1) if len(apart) else np.zeros(0, np.int64)


def _sums(rows: DataFrame, keyed) -> dict[str, tuple[int, np.ndarray]]:
    """(rows, exact sums of their vectors) by key, where keyed(langs, vectors) gives each row's key and vector. Each task sends one row a key and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                keys, x = keyed(batch.column("lang").to_pylist(), batch.column("vec").to_pylist())
                names, at = np.unique(np.array(keys), return_inverse=True)
                for i, n in enumerate(names.tolist()):
                    own = x[at == i].astype(np.int64)
                    held[n] = held.get(n, np.zeros(DIMS + 1, np.int64)) + np.r_[own.sum(0), len(own)]
        for n, v in sorted(held.items()):
            yield pa.RecordBatch.from_arrays([pa.array([n] * (DIMS + 1)), pa.array(np.arange(DIMS + 1), pa.int32()), pa.array(v)], ["key", "at", "s"])

    out: dict[str, np.ndarray] = {}
    for r in rows.select("lang", "vec").mapInArrow(run, "key string, at int, s long").groupBy("key", "at").agg(F.sum("s").alias("s")).collect():
        out.setdefault(r["key"], np.zeros(DIMS + 1, np.int64))[r["at"]] = r["s"]
    return {k: (int(v[DIMS]), v[:DIMS]) for k, v in out.items()}


def fit_topics(rows: DataFrame, topics: int = TOPICS, rounds: int = TOPIC_ROUNDS) -> Topics:
    """Topics of rows (lang, vec): spherical k-means from seeded directions, each round an aggregate over all rows.

    Sums are of whole numbers, so they don't depend on how rows lie in tasks. The CENTRED
    commonest languages have means of their own, the others one together.
    """
    common = {r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(CENTRED).collect()}

    def by_language(langs: list[str], vectors: list[bytes]) -> tuple[list[str], np.ndarray]:
        return [n if n in common else OTHERS for n in langs], np.frombuffer(b"".join(vectors), "<i2").reshape(-1, DIMS)

    means = {k: s / n for k, (n, s) in _sums(rows, by_language).items()}
    means.setdefault(OTHERS, np.zeros(DIMS))
    centres = np.random.default_rng(SEED + 1).normal(size=(topics, DIMS))
    model = Topics(means, centres / np.sqrt((centres * centres).sum(1, keepdims=True)))
    for _ in range(rounds):

        def by_topic(langs: list[str], vectors: list[bytes], now: Topics = model) -> tuple[list[str], np.ndarray]:
            x = now.apart(langs, vectors)
            return [str(t) for t in now.of(x)], x

        centres = model.centres.copy()
        for key, (_, s) in _sums(rows, by_topic).items():
            length = math.sqrt(float((s.astype(float) ** 2).sum()))
            if key != "-1" and length > 0:
                centres[int(key)] = s / length
        model = Topics(means, centres)
    return model


def with_topic(rows: DataFrame) -> DataFrame:
    """rows (lang, vec, ...) with topic in place of vec."""
    model = fit_topics(rows)

    def name(lang: pd.Series, vec: pd.Series) -> pd.Series:
        at = model.of(model.apart(lang.tolist(), vec.tolist()))
        return pd.Series([f"topic {i + 1}" if i >= 0 else NONE for i in at.tolist()], dtype=object)

    return rows.withColumn("topic", F.pandas_udf(name, "string")("lang", "vec")).drop("vec")


def place_of(doc_id: Column, text: Column) -> Column:
    """Where the sampling draws for a document, in 0..1."""
    return F.shiftrightunsigned(F.xxhash64(doc_id.cast("long"), text, F.lit("mix")), 11) / F.lit(float(1 << 53))


def _name(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(NONE))


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, place) of docs, written; place is where the sampling draws, in 0..1."""
    d = tables.pick(docs, "doc_id", "text", "source", "lang")
    d = d.select(F.col("doc_id").cast("long").alias("doc_id"), _name(F.col("source")).alias("source"), _name(F.col("lang")).alias("lang"), F.col("text").cast("string").alias("text"),
                 place_of(F.col("doc_id"), F.col("text")).alias("place"))
    rows = tables.store(with_tokens(d, "text", ["doc_id", "source", "lang", "place"]), "tokens")
    out = tables.store(with_topic(rows).select("doc_id", *DIMENSIONS, "n_tokens", "place"), "described")
    tables.drop(rows)
    return out


def default_targets(cells: DataFrame) -> dict[str, DataFrame]:
    """(category, target share) for each dimension."""
    out = {}
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    for d in DIMENSIONS:
        raised = cells.groupBy(d).agg(F.pow(F.sum("tokens") / F.lit(total), F.lit(POWERS[d])).alias("r"))
        whole = float(raised.agg(F.sum("r")).first()[0] or 1)
        out[d] = raised.select(d, (F.col("r") / F.lit(whole)).alias("target"))
    return out


def rake(weights: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Cell weights, scaled until the sums by each dimension's code match its targets."""
    w = weights.astype(float)
    worst = math.inf
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets):
            sums = np.bincount(code, w, len(target))
            factor = np.divide(target, sums, out=np.ones_like(target), where=sums > 0)
            worst = max(worst, float(np.abs(sums - target)[sums > 0].max(initial=0)))
            w = w * factor[code]
        if worst < tolerance:
            break
    _report(worst, rounds, tolerance)
    return w


def _report(worst: float | None, rounds: int, tolerance: float) -> None:
    """Says so if the marginals weren't met: then targets contradict each other or cells that they need are empty."""
    if worst is not None and worst >= tolerance:
        warnings.warn(f"raking stopped after {rounds} rounds with a marginal {worst:.2g} off its target", stacklevel=3)


def _rake_rows(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, tolerance: float) -> DataFrame:
    """rake() for more cells than the driver should hold."""
    now = tables.store(cells.withColumn("w", F.col("tokens").cast("double")), "cells")
    worst = None
    for _ in range(rounds):
        step, gaps = now, []
        for d in DIMENSIONS:
            sums = step.groupBy(d).agg(F.sum("w").alias("s")).join(targets[d], d)
            step = step.join(sums, d).withColumn("w", F.when(F.col("s") > 0, F.col("w") * F.col("target") / F.col("s")).otherwise(F.col("w")))
            step = step.withColumn(f"gap_{d}", F.abs(F.col("s") - F.col("target"))).drop("s", "target")
            gaps.append(f"gap_{d}")
        new = tables.store(step, "cells")
        tables.drop(now)
        worst = new.agg(F.max(F.greatest(*gaps))).first()[0]
        now = new.drop(*gaps)
        now._tessella_path = new._tessella_path
        if worst is None or worst < tolerance:
            break
    _report(worst, rounds, tolerance)
    return now


def cell_weights(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """cells (source, lang, topic, tokens) with w: the raked share of the cell."""
    spark = cells.sparkSession
    full = cells.where("tokens > 0")
    targets = targets or default_targets(full)
    if full.count() > driver_cells:
        return _rake_rows(full, targets, rounds, tolerance)
    rows = sorted(full.collect(), key=lambda r: [r[d] for d in DIMENSIONS])
    codes, shares = [], []
    for d in DIMENSIONS:
        wanted = {r[d]: r["target"] for r in targets[d].collect()}
        names = sorted({r[d] for r in rows})
        number = {n: i for i, n in enumerate(names)}
        codes.append(np.array([number[r[d]] for r in rows], np.int64))
        shares.append(np.array([wanted.get(n, 0.0) for n in names]))
    w = rake(np.array([r["tokens"] for r in rows], float), codes, shares, rounds, tolerance)
    made = [(*(r[d] for d in DIMENSIONS), r["tokens"], float(x)) for r, x in zip(rows, w)]
    return spark.createDataFrame(made, "source string, lang string, topic string, tokens long, w double")


def fitting_scale(ratio: DataFrame, margin: float = MARGIN) -> float:
    """The largest scale of ratio's weights at which capped probabilities keep each dimension's shares within the margin."""
    some = ratio.where("weight > 0").select(*DIMENSIONS, "tokens", "weight", "w")
    most, least, whole = some.agg(F.max("weight"), F.min("weight"), F.sum("w")).first()
    if most is None:
        return 1.0
    low, high = 1 / most, 1 / least
    each = some.withColumn("x", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("c")) for d in DIMENSIONS])))
    for _ in range(PASSES):
        if low >= high:
            break
        scales = [low * (high / low) ** (i / STEPS) for i in range(STEPS + 1)]
        kept = [F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * s)).alias(f"k{i}") for i, s in enumerate(scales)]
        total = some.agg(*kept).first()
        sums = each.groupBy("x").agg(F.sum("w").alias("w"), *kept)
        gaps = sums.groupBy("x.d").agg(*[(F.sum(F.abs(F.col(f"k{i}") / total[i] - F.col("w") / whole)) / 2).alias(f"g{i}") for i in range(STEPS + 1)])
        gaps = gaps.agg(*[F.max(f"g{i}") for i in range(STEPS + 1)]).first()
        # nothing is capped at the first
        best = max(i for i, gap in enumerate(gaps) if i == 0 or gap <= margin)
        low, high = scales[best], scales[min(best + 1, STEPS)]
    return low


def cell_probabilities(described_docs: DataFrame, targets: dict[str, DataFrame] | None = None, scale: float | None = None) -> tuple[DataFrame, bool]:
    """((source, lang, topic, weight, probability), whether they are few enough to broadcast)."""
    cells = tables.store(described_docs.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    weighed = cell_weights(cells, targets)
    total = float(weighed.agg(F.sum("tokens")).first()[0] or 1)
    ratio = weighed.withColumn("weight", F.col("w") * total / F.col("tokens"))
    factor = scale if scale else fitting_scale(ratio)
    ratio = ratio.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), F.col("weight") * factor).alias("probability"))
    return ratio, cells.count() <= DRIVER_CELLS


def probabilities(docs: DataFrame, targets: dict[str, DataFrame] | None = None, scale: float | None = None) -> DataFrame:
    """described(docs) with weight (target share over observed share), probability and selected."""
    rows = described(docs)
    ratio, few = cell_probabilities(rows, targets, scale)
    out = rows.join(F.broadcast(ratio) if few else ratio, list(DIMENSIONS), "left")
    out = out.withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return out.select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", (F.col("place") < F.col("probability")).alias("selected"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, scale: float | None = None) -> DataFrame:
    """The sampled rows of docs, with their columns. Texts are encoded once, pass to a worker once, and aren't shuffled as long as the cells are few."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    at = {c: F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text", "source", "lang")}
    own = [_name(at["source"]).alias("source"), _name(at["lang"]).alias("lang"), place_of(at["doc_id"], at["text"]).alias("place")]
    text = f"c{docs.columns.index('text')}"
    if dict(rows.dtypes)[text] != "string":  # else the column that is kept is the one that is encoded
        own.append(at["text"].cast("string").alias("text"))
        text = "text"
    rows = rows.select(*names, *own)
    with tables.small_batches(docs.sparkSession, FEW_ROWS):
        rows = tables.store(with_tokens(rows, text, [*names, "source", "lang", "place"], little=True), "tokens")
    told = with_topic(rows)
    ratio, few = cell_probabilities(told, targets, scale)
    ratio = ratio.select(*DIMENSIONS, "probability")
    told = told.join(F.broadcast(ratio) if few else ratio, list(DIMENSIONS), "left")
    kept = told.where(F.col("place") < F.coalesce("probability", F.lit(1.0)))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probabilities(tables.read(spark, sf_dir, "documents"))
