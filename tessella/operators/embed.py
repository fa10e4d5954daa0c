"""Embeddings of texts by a chain of providers.

A provider makes vectors of texts, all of one size. Each worker opens a provider once; where one
fails, or gives something else than a vector of the wanted size for each text, the next is asked.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], Sequence[Sequence[float]]]
#: Texts that a provider is asked for at once, and vectors that a task remembers.
BATCH, REMEMBERED = 64, 4096
SCHEMA = "embedding array<float>, provider string, cached boolean"


@dataclass(frozen=True)
class Provider:
    """A named provider; ``open`` runs in the worker (it may load a model or connect) and gives the function."""

    name: str
    open: Callable[[], Embed]


def hashing(size: int) -> Provider:
    """Signed hashes of the words, normalised; works offline and never fails."""

    def embed(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            v = np.zeros(size)
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                v[h % size] += 1 if h & 0x10000 else -1
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return out

    return Provider("hashing", lambda: embed)


class Chain:
    """The providers within one worker, with a bounded memory of the vectors last used."""

    def __init__(self, providers: Sequence[Provider], size: int, remembered: int = REMEMBERED):
        self.providers, self.size, self.remembered = providers, size, remembered
        self.opened: dict[str, Embed] = {}
        self.known: OrderedDict[str, tuple[np.ndarray, str]] = OrderedDict()

    def _checked(self, vectors: Sequence[Sequence[float]], n: int) -> list[np.ndarray]:
        if len(vectors) != n:
            raise ValueError(f"{len(vectors)} vectors for {n} texts")
        out = [np.asarray(v, "float32") for v in vectors]
        if any(v.shape != (self.size,) or not np.isfinite(v).all() for v in out):
            raise ValueError(f"not all vectors are of {self.size} finite components")
        return out

    def _asked(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        failed = []
        for p in self.providers:
            try:
                if p.name not in self.opened:
                    self.opened[p.name] = p.open()
                return [(v, p.name) for v in self._checked(self.opened[p.name](texts), len(texts))]
            except Exception as e:  # noqa: BLE001 - whatever a provider fails with, the next is asked
                failed.append(f"{p.name}: {e}")
        raise RuntimeError("no provider gave vectors; " + "; ".join(failed))

    def vectors(self, texts: Sequence[str | None]) -> list[tuple[np.ndarray, str, bool] | None]:
        """(vector, provider, whether it was remembered or asked for already) of each text; None for None."""
        out: list[tuple[np.ndarray, str, bool] | None] = [None] * len(texts)
        for a in range(0, len(texts), BATCH):
            some = {t for t in texts[a : a + BATCH] if t is not None}
            new = [t for t in dict.fromkeys(texts[a : a + BATCH]) if t in some and t not in self.known]
            held = {t: self.known[t] for t in some if t in self.known}
            held |= dict(zip(new, self._asked(new))) if new else {}
            fresh = set(new)
            for i, t in enumerate(texts[a : a + BATCH], a):
                if t is None:
                    continue
                out[i] = (*held[t], t not in fresh)
                fresh.discard(t)
                self.known[t] = held[t]
                self.known.move_to_end(t)
            while len(self.known) > self.remembered:
                self.known.popitem(last=False)
        return out


def embedded(rows: DataFrame, text: str, providers: Sequence[Provider], size: int, prefix: str = "", remembered: int = REMEMBERED) -> DataFrame:
    """rows with embedding, provider and cached of a text column, each text after the prefix (an instruction that a model wants before queries).

    A null text has nulls, an empty one is embedded. If all providers fail the task fails, so no row goes without its vector.
    A task asks for equal texts once while it remembers them; columns of the three names are replaced.
    """

    @F.pandas_udf(SCHEMA)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chain = Chain(providers, size, remembered)
        for texts in parts:
            found = chain.vectors([None if t is None else prefix + t for t in texts])
            yield pd.DataFrame({
                "embedding": pd.Series([None if f is None else f[0] for f in found], dtype=object),
                "provider": pd.Series([None if f is None else f[1] for f in found], dtype=object),
                "cached": pd.Series([None if f is None else f[2] for f in found], dtype=object),
            })

    kept = [c for c in rows.columns if c not in ("embedding", "provider", "cached")]
    return rows.withColumn("_e", run(F.col(text))).select(*kept, "_e.embedding", "_e.provider", "_e.cached")


def query_vector(query: str, providers: Sequence[Provider], size: int, instruction: str = "") -> list[float]:
    """One query's vector, on the driver."""
    found = Chain(providers, size, 1).vectors([instruction + query])[0]
    return [float(x) for x in found[0]] if found is not None else []
