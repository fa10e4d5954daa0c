"""Vector functions on array<float> columns, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Clamped to -1..1; 0 for null, zero or unequally long vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(F.lit(0.0))


def unpacked(blob: Column) -> Column:
    """array<float> from little-endian float32 bytes, a JSON list, or the word null; null if it is none of them."""

    @F.pandas_udf("array<float>")
    def read(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(b, "<f4") if b and len(b) % 4 == 0 else None)

    text = F.when(F.substring(blob, 1, 1) == F.lit(b"["), blob.cast("string"))
    packed = F.when((F.substring(blob, 1, 1) != F.lit(b"[")) & (blob != F.lit(b"null")), blob)
    return F.coalesce(F.from_json(text, "array<float>"), read(packed))
