"""Token counts (operator 9): an exact histogram of encoded lengths with suffix sums.

``length_histogram`` encodes every whole text and counts documents by length. From it
``suffix_sums`` derives, for each length L that occurs, how many documents and tokens
are at L or above and what every context limit needs: with a limit of L ids, truncation
keeps ``tokens_below + L * docs_at_least``. ``total``, ``quantile`` and ``truncated_total``
answer for limits and shares between the lengths that occur, too.

The running sums use two levels (blocks of ``BLOCK`` lengths, then lengths within one
block), so no task sorts the whole histogram.

Defined cases: a null text is empty and has the length of the end id alone (0 without
one); rows that repeat count each time; an empty table gives an empty histogram; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import encoding, tables

BLOCK = 1024


def length_histogram(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = None) -> DataFrame:
    """(length, n_docs): each task counts its own documents first, then counts are summed by length."""
    extra = int(end_id is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(tokenizer or encoding.default_path())
        counts: dict[int, int] = {}
        for batch in batches:
            for _, text in encoding.slices(batch.column("text")):
                sizes, n = np.unique(enc.lengths(text) + extra, return_counts=True)
                for a, b in zip(sizes.tolist(), n.tolist()):
                    counts[a] = counts.get(a, 0) + b
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["length", "n"])

    each = tables.pick(docs, "text").select(F.col("text").cast("string").alias("text")).mapInArrow(run, "length long, n long")
    return each.groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds docs_at_least, tokens_at_least, docs_below, tokens_below and truncated_total (limit = length)."""
    rows = histogram.select("length", "n_docs", F.floor(F.col("length") / BLOCK).alias("block"), (F.col("length") * F.col("n_docs")).alias("n_tokens"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("block").alias("b"),
        *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_{n}") for n, w in (("below", before), ("above", after)) for c in ("d", "t")),
    )
    up = W.partitionBy("block").orderBy("length").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy("block").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, 0)
    inside = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    out = rows.join(blocks, rows["block"] == blocks["b"]).select(
        "length", "n_docs", "n_tokens",
        (inside("n_docs", down) + F.col("d_above")).alias("docs_at_least"), (inside("n_tokens", down) + F.col("t_above")).alias("tokens_at_least"),
        (inside("n_docs", up) + F.col("d_below")).alias("docs_below"), (inside("n_tokens", up) + F.col("t_below")).alias("tokens_below"),
    )
    return out.withColumn("truncated_total", F.col("tokens_below") + F.col("length") * F.col("docs_at_least"))


def total(sums: DataFrame) -> DataFrame:
    """(n_docs, n_tokens) of the corpus."""
    return sums.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents don't exceed."""
    n = F.col("docs_below") + F.col("n_docs")
    return sums.where(n >= F.lit(share) * (F.col("docs_below") + F.col("docs_at_least"))).agg(F.min("length").alias("length"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens that remain if every document is cut to ``limit`` ids."""
    kept = F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs"))
    return sums.agg(F.coalesce(kept, F.lit(0)).cast("long").alias("n_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # stored, as the sums read it twice
    return suffix_sums(tables.store(length_histogram(tables.read(spark, sf_dir, "documents"), end_id=2), "lengths"))
