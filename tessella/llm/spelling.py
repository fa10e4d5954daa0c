"""Spelling variant grouping (operator 13): halves of words in Aho-Corasick automata.

Words that differ by one inserted, deleted or replaced code point share a half: of a word cut in two,
one segment stands unchanged in the other word, the first at its start or the second at its end.

* Every word's two segments are dealt out to shards by a hash of (half, word length, segment); a shard's
  automaton holds its segments.
* A word is scanned by the shards that may hold a segment of it: those of its own starts and ends as
  the halves of words one shorter, as long, or one longer. So the work grows with the vocabulary and not
  with its square.
* A hit of the automaton counts if its offset fits its half and the two lengths differ by one at most.
  The rest of such a word is at distance one from the rest of the other, so it shares a half again; the
  words that do, found by hashes of the quarters, are verified: the common start and end must cover all but one.
* A pair that both halves find is counted where the first half does. A shard returns each word's number
  of near words and the best of them, so pairs don't leave it.

Extraction and counts are DataFrame functions with partial sums before the shuffle; the chains of forms
are followed by doubling (each link at least doubles n, so a chain is short).

Defined cases: a null text has no words; a null doc_id is hashed as an empty text; repeated rows count as
often as they stand there; ties go to the smaller word in code-point order; an empty table gives an
empty result; very long words go to shards of their own size class; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables, workers

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_CHARS, LEAST_COUNT, MODULUS = 5, 3, 97
#: Bytes that a shard's words may take in a worker, about, and the longest words that share a size class.
SHARD_BYTES, SHORT = 12 << 20, 32
#: Pairs verified at a time.
PAIRS = 200_000


def occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(word) of each run of letters of at least so many code points, after the seeded deletions."""
    # a run of enough letters is matched from its first one on, so shorter ones needn't be laid out
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0))).alias("run"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.when(F.octet_length("run") == F.char_length("run"), F.lower("run")).otherwise(F.translate("run", upper, lower))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("low")).cast("binary"))
    rows = runs.select("doc_id", low.alias("low")).select("low", h.alias("h"))
    at = (F.col("h") % F.char_length("low")).cast("int")
    cut = F.concat(F.substring(F.col("low"), F.lit(1), at), F.substring(F.col("low"), at + 2, F.char_length("low")))
    word = F.when(F.col("h") % MODULUS == 0, cut).otherwise(F.col("low"))
    return rows.select(word.alias("word")).where(F.char_length("word") >= least_chars)


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words with at least so many occurrences."""
    return occurrences(docs, least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _size_class(length: Column) -> Column:
    return F.when(length <= SHORT, 0).otherwise(F.ceil(F.log2(length))).cast("int")


def _dealt(words: DataFrame, shards: int) -> DataFrame:
    """(class, shard, role, word, n): a word with its halves (roles 0, 1) and as one to be scanned (role 2)."""
    m = F.char_length("word")

    def place(kind: int, length: Column, segment: Column, role: int) -> Column:
        shard = F.pmod(F.xxhash64(F.lit(kind), length.cast("int"), segment), F.lit(shards)).cast("int")
        return F.struct(_size_class(length).alias("class"), shard.alias("shard"), F.lit(role).alias("role"))

    def halves(length: Column) -> tuple[Column, Column]:
        k = F.floor(length / 2).cast("int")
        rest = (length - k).cast("int")
        return F.substring(F.col("word"), F.lit(1), k), F.substring(F.col("word"), (m - rest + 1).cast("int"), rest)

    own = [place(kind, m, s, kind) for kind, s in enumerate(halves(m))]
    # a half of a word that is one longer may be longer than this one: it is none of it then, and nothing matches
    scans = [place(kind, m + d, s, 2) for d in (-1, 0, 1) for kind, s in enumerate(halves(m + d))]
    every = F.concat(F.array(*own), F.array_distinct(F.array(*scans)))
    return words.select("word", "n", F.explode(every).alias("p")).select("p.class", "p.shard", "p.role", "word", "n")


def _matrix(words: list[str], width: int) -> np.ndarray:
    out = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)
    return out.astype(np.uint8) if out.max(initial=0) < 256 else out


class _Shard:
    """Words as rows of code points, with hashes of their starts."""

    def __init__(self, words: list[str]):
        self.length = np.array([len(w) for w in words], np.int64)
        width = int(self.length.max(initial=1))
        self.left, self.right = _matrix(words, width), _matrix([w[::-1] for w in words], width)
        base = np.uint64(0x9E3779B97F4A7C15)
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(width, base)]), dtype=np.uint64)
        self.start = np.zeros((len(words), width + 1), np.uint64)
        for i in range(width):
            self.start[:, i + 1] = self.start[:, i] * base + self.left[:, i].astype(np.uint64) + np.uint64(1)

    def part(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of rows[a:b]."""
        return self.start[rows, b] - self.start[rows, a] * self.power[b - a]

    def common(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the common starts and ends of pairs that differ."""
        return tuple((side[v] != side[w]).argmax(axis=1) for side in (self.left, self.right))


def _key(segment: np.ndarray, kind: int, length: np.ndarray, sub: int, rest: np.ndarray) -> np.ndarray:
    u = lambda x: np.asarray(x).astype(np.uint64)
    out = (u(segment) * np.uint64(4) + np.uint64(2 * kind + sub)) * np.uint64(0xD6E8FEB86659FD93) + u(length) * np.uint64(0xA0761D6478BD642F) + rest
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def near_pairs(words: list[str], owners: list[np.ndarray], scanned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (v, w) of the near pairs: v scanned, a half of w in the automaton. owners: places of the words whose first, or second, half is here."""
    import ahocorasick

    s = _Shard(words)
    numbers: dict[str, int] = {}
    segment = [np.array([numbers.setdefault(words[i][: len(words[i]) // 2] if kind == 0 else words[i][len(words[i]) // 2 :], len(numbers)) for i in owners[kind]], np.int64) for kind in (0, 1)]
    none = np.zeros(0, np.int64)
    if not numbers or not len(scanned):
        return none, none
    automaton = ahocorasick.Automaton()
    for text, i in numbers.items():
        automaton.add_word(text, i)
    automaton.make_automaton()
    hits = np.array([x for hit in automaton.iter("\n".join(words[i] for i in scanned)) for x in hit], np.int64).reshape(-1, 2)
    size = np.array([len(x) for x in numbers], np.int64)[hits[:, 1]]
    ends = np.cumsum(s.length[scanned] + 1)
    row = np.searchsorted(ends, hits[:, 0], "right")
    v, stop = scanned[row], hits[:, 0] + 1 - (ends[row] - s.length[scanned][row] - 1)
    inside = stop >= size
    v, found, size, stop = v[inside], hits[inside, 1], size[inside], stop[inside]
    m = s.length[v]
    pairs: list[np.ndarray] = []
    for kind in (0, 1):
        w = owners[kind]
        length = s.length[w]
        k = length // 2
        a, r = (k, length - k) if kind == 0 else (np.zeros_like(k), k)
        for sub in (0, 1):
            q = r // 2
            rest = s.part(w, a, a + q) if sub == 0 else s.part(w, a + q, a + r)
            keys = _key(segment[kind], kind, length, sub, rest)
            order = np.argsort(keys)
            keys = keys[order]
            # a first half of this size is of words twice as long or one more, a second half of those or one less
            for long in (2 * size, 2 * size + (1 if kind == 0 else -1)):
                at_side = stop == size if kind == 0 else stop == m
                ok = at_side & (np.abs(long - m) <= 1)
                half = long // 2
                begin, finish = (half, m) if kind == 0 else (np.zeros_like(m), m - size)
                rest_of = long - half if kind == 0 else half
                need = rest_of // 2 if sub == 0 else rest_of - rest_of // 2
                ok &= finish - begin >= need
                p, b, f, d = np.flatnonzero(ok), begin[ok], finish[ok], need[ok]
                part = s.part(v[p], b, b + d) if sub == 0 else s.part(v[p], f - d, f)
                asked = _key(found[p], kind, long[p], sub, part)
                lo, hi = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
                n = hi - lo
                p, lo, n = p[n > 0], lo[n > 0], n[n > 0]
                total = np.cumsum(n)
                i = 0
                while i < len(p):
                    before = total[i - 1] if i else 0
                    j = max(i + 1, int(np.searchsorted(total, before + PAIRS, "right")))
                    x = np.repeat(v[p[i:j]], n[i:j])
                    y = w[order[np.repeat(lo[i:j] - (total[i:j] - n[i:j] - before), n[i:j]) + np.arange(len(x))]]
                    other = x != y
                    x, y = x[other], y[other]
                    start, end = s.common(x, y)
                    longer = np.maximum(s.length[x], s.length[y])
                    good = (np.abs(s.length[x] - s.length[y]) <= 1) & (start + end >= longer - 1)
                    if kind == 1:
                        good &= start < s.length[y] // 2
                    pairs.append(np.stack([x[good], y[good]]))
                    i = j
    if not pairs:
        return none, none
    # both quarters may find a pair
    both = np.unique(np.concatenate(pairs, axis=1), axis=1)
    return both[0], both[1]


NEAR = "word string, n_near long, best_n long, best string"


def _scan(rows: pa.Table) -> pa.Table:
    coded = rows["word"].combine_chunks().dictionary_encode()
    words = coded.dictionary.to_pylist()
    place, role = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows["role"].to_numpy()
    n = np.zeros(len(words), np.int64)
    n[place] = rows["n"].to_numpy()
    v, w = near_pairs(words, [place[role == 0], place[role == 1]], place[role == 2])
    rank = np.zeros(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[w], -n[w], v))
    v, w = v[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(v)]]))
    names = [pa.array([words[i] for i in x], pa.string()) for x in (v[first], w[first])]
    workers.trim()
    return pa.Table.from_arrays([names[0], pa.array(count, pa.int64()), pa.array(n[w[first]], pa.int64()), names[1]], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have near words; words are unique."""
    # a word stands in eight places, with nine bytes a code point
    weight = words.agg(F.sum(72 * (F.char_length("word").cast("double") + 1))).first()[0] or 0
    shards = max(1, int(weight // shard_bytes) + 1)
    each = _dealt(words, shards).groupBy("class", "shard").applyInArrow(_scan, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), none of them null: the last form reached; forms must not go in circles."""
    at = tables.store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = tables.store(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        tables.drop(at)
        at = new
        if new.where("moved").isEmpty():
            return new


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of (word, n)."""
    near = words.join(near_words(words), "word", "left")
    form = F.col("best_n") >= 2 * F.col("n")
    told = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n"))
    told = tables.store(told, "forms")
    ends = roots(told.where("form is not null").select("word", "form"))
    return told.join(ends.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def group(docs: DataFrame) -> DataFrame:
    """The words of docs with their forms and roots."""
    return variants(tables.store(vocabulary(tables.doc_columns(docs)), "vocabulary"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(tables.read(spark, sf_dir, "documents"))


#: A word with its deletions by place: words that share one at the same place differ by a replaced code point, a word that is one of them by a deleted one.
ORACLE_SQL = {
    "op13_spelling": r"""with recursive runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{5,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents),
pairs as (select doc_id, low, count(*) as m, string_split(coalesce(doc_id::varchar, '') || ':' || low, '') as l from runs group by doc_id, low),
bytes as (select low, m, flatten(list_transform(l, lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end)) as b from pairs),
bits as (select low, m, flatten(list_transform(b, lambda x: list_transform(range(8), lambda i: (x >> i::integer) & 1))) as b from bytes),
crc as (select low, m, xor(list_reduce(b, lambda c, x: xor(c >> 1, 3988292384::bigint * (xor(c, x) & 1)), 4294967295::bigint), 4294967295::bigint) as h from bits),
cut as (select case when h % 97 = 0 then substr(low, 1, (h % length(low))::integer) || substr(low, (h % length(low))::integer + 2) else low end as word, m from crc),
words as materialized (select word, sum(m)::bigint as n from cut where length(word) >= 5 group by word having sum(m) >= 3),
less as materialized (select word, n, i, substr(word, 1, i::integer - 1) || substr(word, i::integer + 1) as d from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (select a.word, b.word as other, b.n from less a join less b on a.i = b.i and a.d = b.d and a.word <> b.word
 union select l.word, w.word, w.n from less l join words w on w.word = l.d union select w.word, l.word, l.n from less l join words w on w.word = l.d),
best as (select word, count(*) as n_near, max(n) as m, arg_min(other, (-n, other)) as other from near group by word),
told as materialized (select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.m >= 2 * w.n then b.other end as form, case when b.m >= 2 * w.n then b.m end as form_n from words w left join best b using (word)),
chain as (select word, word as at from told union all select c.word, t.form from chain c join told t on t.word = c.at where t.form is not null),
roots as (select c.word, c.at as root from chain c join told t on t.word = c.at where t.form is null)
select t.*, r.root from told t join roots r using (word)"""
}
