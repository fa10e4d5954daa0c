"""Import and export: JSON lines, Markdown, Markdown vaults, embeddings of text."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens, wikilinks
from . import vault
from .records import RECORD

EXPORTED = ("uuid", "data_type", "data_id", "priority", "status", "trust_score")


def json_lines(rows: DataFrame) -> DataFrame:
    """(uuid, line): a record as JSON; write with ``.select('line').write.text``."""
    return rows.select("uuid", F.to_json(F.struct(*EXPORTED)).alias("line"))


def markdown(rows: DataFrame) -> DataFrame:
    kind = F.concat(F.lit("- type: "), "data_type", F.lit("/"), "data_id")
    return rows.select("uuid", F.concat_ws("\n", F.concat(F.lit("## "), "topic"), F.lit(""), "content", F.lit(""), kind, F.concat(F.lit("- trust: "), F.col("trust_score").cast("string"))).alias("block"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; lines that can't be read are in _corrupt_record."""
    return spark.read.schema(RECORD + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_vault(spark: SparkSession, path: str, exclude: tuple[str, ...] = (), roots: tuple[str, ...] = ()) -> DataFrame:
    """(path, source_url, data_id, topic, body) of a vault's notes (see sources.vault); exclude adds to the folders that are left out."""
    vault.register(spark)
    read = spark.read.format("vault").option("exclude", ",".join(exclude)).option("roots", os.pathsep.join(roots))
    return read.load(path).where("outcome = 'note'").drop("outcome")


def vault_records(notes: DataFrame) -> DataFrame:
    """Columns of a record, as far as a vault's notes tell them; the title of the head, else the name, is the summary."""
    both = parse_markdown(notes).withColumnsRenamed({"text": "content", "tags": "keywords", "links": "backlinks"})
    return both.where(F.trim("content") != "").select(
        "source_url", "content", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("topic")).alias("summary"), "topic",
        F.lit("OBSIDIAN").alias("data_type"), "data_id", F.lit("obsidian").alias("source"), "keywords", "backlinks",
    )


def front_matter(body: Column) -> tuple[Column, Column]:
    """(text, YAML head) of a Markdown body; the head is empty without one."""
    pattern = r"(?s)^---\n(.*?)\n---\n(.*)$"
    head = F.regexp_extract(body, pattern, 1)
    return F.when(head != "", F.regexp_extract(body, pattern, 2)).otherwise(body), head


def parse_markdown(files: DataFrame) -> DataFrame:
    """The columns beside body, and text, title, tags, links; title and tags are simple keys of the head."""
    text, head = front_matter(F.col("body"))
    key = lambda k: F.trim(F.regexp_extract(head, rf"(?m)^{k}:\s*(.*)$", 1))
    tags = F.filter(F.split(F.regexp_replace(key("tags"), r"[\[\]]", ""), r"\s*,\s*"), lambda t: t != "")
    return files.select(*[c for c in files.columns if c != "body"], text.alias("text"), key("title").alias("title"), tags.alias("tags"), wikilinks(text).alias("links"))


def hashed_embedding(rows: DataFrame, size: int, directed: bool = False) -> DataFrame:
    """(uuid, embedding): signed token hashes, normalised. A stand-in for a model that works offline.

    A text without words, or whose words cancel out, has a zero vector; with ``directed`` it points along one axis, by a hash of its words.
    """

    @F.pandas_udf("array<float>")
    def embed(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zlib

        import numpy as np

        for batch in words:
            out = []
            for ws in batch:
                v = np.zeros(size)
                for w in ws if ws is not None else []:
                    h = zlib.crc32(w.encode())
                    v[h % size] += 1 if h & 0x10000 else -1
                n = np.linalg.norm(v)
                if directed and not n:
                    v[zlib.crc32(" ".join(ws if ws is not None else []).encode()) % size] = n = 1.0
                out.append((v / n if n else v).astype("float32"))
            yield pd.Series(out)

    return rows.select("uuid", embed(tokens(F.col("content"))).alias("embedding"))
