"""The corpus pipeline: language ID, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents; a stage works on every row its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import language, line_dedup, mixing, ngram_join, packing, tables


#: Rows sent to a Python worker at once: executors that have run all stages before have little memory left for it.
BATCH_ROWS = 4000


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (no text or no letter); lang becomes the predicted language."""
    samples = language.bounded_sample(tables.pick(docs, "text", "lang"))
    # columns go by place, whatever their names
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text, lang = (f"c{docs.columns.index(c)}" for c in ("text", "lang"))
    if not samples:  # nothing to learn from: only texts without a letter go
        return rows.where(F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}")).toDF(*docs.columns)
    told = language.identify(rows, samples, rows.columns, text).where(F.col("lang_pred") != language.UNKNOWN)
    # written here, as batches are small only while an action runs
    with tables.small_batches(spark, BATCH_ROWS):
        told = tables.store(told, "told")
    return told.withColumn(lang, F.col("lang_pred")).drop("lang_pred", "score").toDF(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates; a document of which no line is left goes, as all its lines are kept elsewhere."""
    out = line_dedup.dedup_lines(docs, short=True)
    left = F.length(F.trim(F.col("text"))) > 0
    return _columns(out.where(left).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates: the one with the smallest doc_id.

    Rows that share a doc_id are kept or dropped together, equal rows stay once; documents without words stay.
    """
    with tables.small_batches(spark, BATCH_ROWS):
        told = tables.store(ngram_join.join(docs).select("doc_id", "n_shingles", "component_id", "key"), "components")
    kept = told.where("n_shingles = 0 or component_id is null or doc_id = component_id").select(F.col("key").alias("_key")).distinct()
    kept = tables.store(kept, "kept")
    if kept.count() <= ngram_join.BROADCAST_ROWS:
        kept = F.broadcast(kept)
    named = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    out = named.join(kept, "_key", "left_semi")
    if not told.groupBy("key").count().where("count > 1").isEmpty():
        out = out.withColumn("_text", F.xxhash64("text")).dropDuplicates(["_key", "_text"])
    return _columns(out, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents towards the target weights of sources, languages and topics."""
    return _columns(mixing.mix(docs), docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows; see packing.pack for the columns."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = tables.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else tables.store(out, "stage")
    return docs


#: Language ID, raking and packing go beyond SQL. tests/llm hold language ID against held-out labels, line dedup and the
#: n-gram join against brute force, and the chain of stages against brute force on a small table.
ORACLE_SQL = None
