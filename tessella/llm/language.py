"""Language identification (operator 3): cross-parsing entropy with suffix automata.

Training takes a bounded sample of the different labelled texts of each language
(``SAMPLE_CHARS`` characters, chosen by the hash of the text), and builds a suffix automaton of it. A text
is cross-parsed against each automaton: from left to right, the longest piece that occurs
in the sample is one phrase (an unknown symbol is a phrase of its own). The entropy
estimate is phrases * log2(sample length) / text length; the lowest one wins, and ties go
to the language that comes first by name.

Texts are lower-cased and mapped to a small alphabet: the most frequent letters of the
samples, one symbol for other letters and one for every run of non-letters. The automata
of all languages are one table of transitions with the restarts filled in, so that all
texts of a batch advance together, one symbol a step and language, in numpy.

Defined cases: a null text or one without a letter gets ``und`` and score 0; so does
every text if no language can be learned; null labels and null texts teach nothing; rows
that repeat are predicted alike; a long text is parsed whole; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables, workers

#: Characters of sample text for a language, and for all languages together.
SAMPLE_CHARS = 48_000
SAMPLE_CHARS_ALL = 1_000_000
#: Labels that are learned, at most.
MOST_LANGUAGES = 1000
LETTERS = 61
UNKNOWN = "und"
#: Texts that advance together.
LANES = 2048


def bounded_sample(labelled: DataFrame, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Sample text for each language of labelled (text, lang).

    Texts that repeat count once. The counts cover all rows; then texts whose hash is below a
    share set for each language are taken, about twice ``chars`` characters of each, and cut to
    the bound in order of hash before they are collected. Of more labels than
    ``MOST_LANGUAGES``, those with the most text are learned.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    # only hashes and lengths are shuffled
    once = rows.select("lang", "h", F.length("text").cast("long").alias("n")).groupBy("lang", "h").agg(F.max("n").alias("n"))
    sizes = once.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return {}
    chars = max(500, min(chars, SAMPLE_CHARS_ALL // len(sizes)))
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(r["lang"], min(1.0, 2.0 * chars / r["n"])) for r in sizes], "lang string, share double")
    place = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    # shares has one row for each language
    picked = rows.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("lang", "h", place.alias("place"), F.substring("text", 1, chars).alias("text"))
    picked = picked.dropDuplicates(["lang", "h"]).withColumn("n", F.length("text"))
    # what is left is about twice the bound for each language
    before = F.sum("n").over(W.partitionBy("lang").orderBy("place", "h", "text")) - F.col("n")
    kept = picked.withColumn("before", before).where(F.col("before") < chars).select("lang", "before", F.expr(f"substring(text, 1, cast({chars} - before as int))").alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(kept.collect(), key=lambda r: (r["lang"], r["before"], r["text"])):
        if r["text"]:
            out.setdefault(r["lang"], []).append(r["text"])
    return {k: "\n".join(v) for k, v in out.items()}


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for s in symbols:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in go[p]:
            go[p][s] = new
            p = link[p]
        if p >= 0:
            q = go[p][s]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(go)
                go.append(go[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and go[p].get(s) == q:
                    go[p][s] = twin
                    p = link[p]
        last = new
    return go


class Model:
    """Cross-parses texts against every language's sample."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        letters = Counter(c for t in samples.values() for c in t.lower() if c.isalpha())
        chosen = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]]
        self.symbols = len(chosen) + 2
        # 0: anything but a letter, 1: another letter; 255 is not used
        self.code = np.zeros(0x110000, np.uint8)
        for first in range(0, 0x110000, 0x1000):
            if not 0xD000 <= first < 0xE000:
                self.code[first : first + 0x1000] = [c.isalpha() for c in map(chr, range(first, first + 0x1000))]
        for c in range(0xD000, 0xD800):
            self.code[c] = chr(c).isalpha()
        for i, c in enumerate(chosen):
            self.code[ord(c)] = i + 2
            for big in {c.upper(), c.title()}:
                if len(big) == 1:
                    self.code[ord(big)] = i + 2
        parts, self.start, self.bits, base = [], [], [], 0
        for lang in self.langs:
            go = automaton(self.sequence(samples[lang]).tolist())
            step = np.full((len(go), self.symbols), -1, np.int64)
            for i, out in enumerate(go):
                for s, to in out.items():
                    step[i, s] = to
            # where a state has no way on, the phrase ends and the symbol starts the next one;
            # a symbol that the sample lacks is a phrase of its own, after which none is open
            lacks = step[0] < 0
            ends = np.where(lacks, 2, 1)[None, :].repeat(len(go), 0)
            ends[0] = lacks
            step = np.where(step >= 0, (step + base) * 4, (np.where(lacks, 0, step[0]) + base) * 4 + ends)
            parts.append(step.reshape(-1))
            self.start.append(base)
            self.bits.append(np.log2(max(2, len(samples[lang]))))
            base += len(go)
        self.step = (np.concatenate(parts) if parts else np.zeros(0)).astype(np.int32)

    def sequence(self, text: str) -> np.ndarray:
        """Symbols of a text: runs of non-letters are one symbol."""
        s = self.code[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        return s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]] if len(s) else s

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(text, language) numbers of phrases; an unended last phrase counts."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for i in range(0, len(order), LANES):
            lanes = order[i : i + LANES]
            out[lanes] = self._together([texts[k] for k in lanes])
        return out

    def _together(self, texts: list[np.ndarray]) -> np.ndarray:
        """Longest text first. Symbols are laid out step by step, for those lanes that are still going."""
        sizes = np.array([len(t) for t in texts])
        n, langs, width = len(texts), len(self.langs), np.int32(self.symbols)
        flat = np.concatenate(texts) if n else np.zeros(0, np.uint8)
        begin = np.cumsum(sizes) - sizes
        state = np.repeat(np.array(self.start, np.int32)[:, None], n, 1)
        ended = np.zeros((langs, n), np.int32)
        going = np.searchsorted(-sizes, -np.arange(sizes.max(initial=0)), "left")
        at = 0
        while at < len(going) and going[at]:
            # a block of steps with the lanes that are in it, so that a step reads neighbouring bytes
            m = int(going[at])
            to = min(at + 256, int(sizes[0]))
            block = np.zeros((to - at, m), np.uint8)
            for lane in range(m):
                part = flat[begin[lane] + at : begin[lane] + min(to, sizes[lane])]
                block[: len(part), lane] = part
            for k in range(to - at):
                m = int(going[at + k])
                now = self.step[state[:, :m] * width + block[k, :m]]
                ended[:, :m] += now & 3
                state[:, :m] = now >> 2
            at = to
        return (ended + (state != np.array(self.start, np.int32)[:, None])).T

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [(i, self.sequence(t)) for i, t in enumerate(texts) if t]
        known = [(i, s) for i, s in known if s.any()]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs or not known:
            return langs, scores
        counts = self.phrases([s for _, s in known])
        entropy = counts * np.array(self.bits) / np.array([[len(s)] for _, s in known])
        best = entropy.argmin(1)
        least = entropy[np.arange(len(known)), best]
        others = entropy.copy()
        others[np.arange(len(known)), best] = np.inf
        second = others.min(1) if len(self.langs) > 1 else np.full(len(known), np.inf)
        alone = np.isinf(second)
        score = np.where(alone, 1.0, np.where(alone, 0.0, second) / np.where(alone, 1.0, second + least))
        for (i, _), b, s in zip(known, best, score):
            langs[i], scores[i] = self.langs[b], float(s)
        return langs, scores


def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    """One model for each worker process, as long as it is in use."""
    return workers.only(("language", samples), lambda: Model(dict(samples)))


def identify(docs: DataFrame, samples: dict[str, str], keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of docs with lang_pred and score."""
    key = tuple(sorted(samples.items()))
    rows = docs.select(*keep, *([] if text in keep else [text]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key)
        for batch in batches:
            langs, scores = model.predict(batch.column(text).cast(pa.string()).to_pylist())
            held = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*held, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])
        workers.trim()

    return rows.mapInArrow(run, schema)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learnable = docs.where(F.coalesce(~held_out(), F.lit(True))).select("text", "lang")
    samples = bounded_sample(learnable)
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return identify(rows, samples, ["doc_id", "held_out"])
