"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat, gif, language, line_dedup, mixing, neighbours, ngram_join, packing, pieces, spelling, token_counts, token_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_gif_media": gif.op1_gif_media,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_language_id": language.op3_language_id,
        "op4_token_store": token_store.op4_token_store,
        "op5_packing": packing.op5_packing,
        "op6_chat_format": chat.op6_chat_format,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_mixing": mixing.op8_mixing,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_nn_descent": neighbours.op10_nn_descent,
        "op11_centroids": centroids.op11_centroids,
        "op12_sentencepiece": pieces.op12_sentencepiece,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return centroids.ORACLE_SQL | spelling.ORACLE_SQL
