"""Operators that ask a model. The model is any callable from texts to texts; the default is deterministic and offline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import FENCE_CLOSE, FENCE_OPEN, entities, fence, merge_folded

Model = Callable[[list[str]], list[str]]
BATCH = 40


def offline(prompts: list[str]) -> list[str]:
    """Stands in for a model: the prompt's first ten words."""
    return [" ".join(p.replace(FENCE_OPEN, "").replace(FENCE_CLOSE, "").split()[:10]) for p in prompts]


def ask(rows: DataFrame, prompt: str, answer: str = "answer", model: Model = offline, batch: int = BATCH) -> DataFrame:
    """rows with a model's answers to their prompt column, asked in batches; null prompts get none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{answer}` string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out: list[str | None] = [None] * len(pdf)
            asked = [i for i, p in enumerate(pdf[prompt]) if p is not None]
            for a in range(0, len(asked), batch):
                some = asked[a : a + batch]
                for i, text in zip(some, model([pdf[prompt].iloc[i] for i in some])):
                    out[i] = text
            yield pdf.assign(**{answer: out})

    return rows.mapInPandas(run, schema)


def parsed(rows: DataFrame, answer: str, schema: str) -> DataFrame:
    """rows whose answer column is its first JSON object or list, as schema; null where there is none, and in fields that don't fit."""

    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import json

        for texts in parts:
            found = [None if t is None else first_json(t) for t in texts]
            yield pd.Series([None if f is None else json.dumps(f) for f in found], dtype=object)

    return rows.withColumn(answer, F.from_json(clean(F.col(answer)), schema))


def enriched(rows: DataFrame, model: Model | None = None, least_keywords: int = 5) -> DataFrame:
    """rows with summary, topic and keywords where these are missing: what is there stays, then the model's answer counts, then the text's own
    entities and its first 100 characters. The model is asked about rows that lack something; an answer without JSON is none."""
    lacks = F.col("summary").isNull() | F.col("topic").isNull() | (F.size("keywords") < least_keywords)
    if model is None:
        asked = rows.withColumn("_a", F.lit(None).cast("struct<summary:string,topic:string,keywords:array<string>>"))
    else:
        want = F.lit('Answer with JSON: {"summary": "...", "topic": "...", "keywords": ["..."]}\n')
        prompts = rows.withColumn("_p", F.when(lacks, F.concat(want, fence(F.coalesce("content", F.lit("")), F.col("source")))))
        asked = parsed(ask(prompts.select("uuid", "_p"), "_p", "_a", model).drop("_p"), "_a", "summary string, topic string, keywords array<string>")
        asked = rows.join(asked, "uuid")
    none = F.array().cast("array<string>")
    said = F.filter(F.coalesce("_a.keywords", none), lambda k: k.isNotNull() & (F.trim(k) != ""))
    named = lambda c: F.when(F.trim(F.col(f"_a.{c}")) != "", F.col(f"_a.{c}"))
    words = merge_folded(F.col("keywords"), F.concat(said, F.coalesce(entities(F.col("content")), none)))
    return asked.withColumns({
        "summary": F.coalesce("summary", named("summary"), F.substring("content", 1, 100)), "topic": F.coalesce("topic", named("topic")),
        "keywords": F.when(lacks, words).otherwise(F.col("keywords")),
    }).drop("_a")


def first_json(text: str) -> object | None:
    """The first JSON value in a model's answer, whatever follows it; None without one."""
    import json

    for i, c in enumerate(text):
        if c in "{[":
            try:
                return json.JSONDecoder().raw_decode(text[i:])[0]
            except ValueError:
                continue
    return None
