"""Tokenizer access shared by the token operators.

Vocabulary files are read through a path parameter and never trained or copied.
``Encoder`` wraps a ``tokenizers`` JSON file. Where a tokenizer drops white space
(checked on probe strings when it is loaded), a text is the concatenation of its
blank-separated chunks. Arrow finds the distinct chunks of a batch, only those the
process has not met are run through the model, and the ids are put together by a
vectorised gather.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import workers

#: Chunks longer than this are encoded each time and not kept.
LONGEST_KEPT = 48
#: Entries of the chunk dictionary; it is emptied when full, which bounds memory.
MOST_KEPT = 1_500_000
#: Cells that tell, by a hash, whether a chunk was met before; two that share one are only kept the earlier.
MET_CELLS = 1 << 22
#: Bytes of text encoded at a time (one longer text still goes at once).
SLICE_BYTES = 8 << 20

_PROBES = (
    "Plain words, and 12 more.\nA second  line\twith blanks",
    "don't we're <b>x</b> a.b.c ... ?! été straße İx ẞ é É.",
)


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file on this machine (executors resolve it themselves)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) parts of a string column with about ``most`` bytes each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield at, column.slice(at, end - at)
        at = end


class Encoder:
    """Encodes texts to unsigned ids; null is an empty text. With ``twice`` it keeps only chunks that it meets again."""

    def __init__(self, path: str, most: int = MOST_KEPT, twice: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.model.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        special = [(i, t.content) for i, t in self.model.get_added_tokens_decoder().items() if t.special]
        self._mark = special[0] if special else None
        self._kept: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self.most = most
        self._met = np.zeros(MET_CELLS, bool) if twice else None
        self.by_chunk = True
        self.by_chunk = all(self._whole([p])[0] == self.encode(pa.array([p]))[0].tobytes() for p in _PROBES)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids. Many chunks go through one model run, with a special token between them."""
        if self._mark is None:
            return self._whole(chunks)
        number, mark = self._mark
        out: list[bytes] = []
        for i in range(0, len(chunks), 2000):
            part = chunks[i : i + 2000]
            if any("|" in c or mark in c for c in part):
                out += self._whole(part)
                continue
            ids = np.frombuffer(self._whole([mark.join(part)])[0], self.dtype)
            ends = np.flatnonzero(ids == number)
            starts, ends = [0, *(ends + 1)], [*ends, len(ids)]
            out += [ids[a:b].tobytes() for a, b in zip(starts, ends)]
        return out

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        kept = self._kept
        if len(kept) > self.most:
            # with ``twice``, those that were met since the last time stay
            self._older, self._kept = kept if self._met is not None else {}, {}
            kept = self._kept
        older = self._older
        if older:
            kept.update((c, older[c]) for c in chunks if c in older and c not in kept)
        new = {c for c in chunks if c not in kept}
        # a letter and a full stop or comma are split by the model: such an end is encoded apart
        ended = [c for c in new if len(c) > 1 and c[-1] in ",." and c[-2].isalpha()]
        plain = [c for c in new.difference(ended).union(c[:-1] for c in ended) | {",", "."} if c not in kept]
        made = dict(zip(plain, self._apart(plain)))
        for c in ended:
            made[c] = b"".join(made[x] if x in made else kept[x] for x in (c[:-1], c[-1]))
        out = [kept[c] if c in kept else made[c] for c in chunks]
        if self._met is None:
            kept.update((c, ids) for c, ids in made.items() if len(c) <= LONGEST_KEPT)
        else:
            # most chunks that are new come only once: one is kept when it is met again
            names = list(made)
            places = np.fromiter(map(hash, names), np.int64, len(names)) % len(self._met)
            kept.update((names[i], made[names[i]]) for i in np.flatnonzero(self._met[places]) if len(names[i]) <= LONGEST_KEPT)
            self._met[places] = True
        return out

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string column."""
        out: list[np.ndarray] = []
        for _, part in slices(pc.fill_null(column, "")):
            ids, ends = self._encode(part)
            out += np.split(ids, ends[:-1])
        return out

    def lengths(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        return np.array([len(x) for x in self.encode(column)], np.int64)

    def _encode(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in turn, and where each row ends."""
        if not self.by_chunk:
            ids = [np.frombuffer(b, self.dtype) for b in self._whole(part.to_pylist())]
            return np.concatenate(ids), np.cumsum([len(x) for x in ids])
        # lower-casing makes chunks alike, but must not make a special token
        small = pc.if_else(pc.match_substring(part, "|>"), part, pc.ascii_lower(part))
        lists = pc.split_pattern(pc.replace_substring(small, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False)
        each = self._ids_of(words.dictionary.to_pylist())
        table = np.frombuffer(b"".join(each), self.dtype)
        # a slice has fewer ids than 2**31: half the memory of 64-bit places
        kind = np.int32 if len(part) == 0 or pc.sum(pc.binary_length(part)).as_py() < 1 << 29 else np.int64
        size = np.array([len(x) for x in each], kind) // self.dtype.itemsize
        start = np.cumsum(size, dtype=kind) - size
        sizes = size[at]
        ends = np.cumsum(sizes, dtype=kind)
        places = np.repeat(start[at] - (ends - sizes), sizes)
        places += np.arange(len(places), dtype=kind)
        ids = table[places]
        rows = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return ids, ends[rows - 1]


def encoder(path: str, most: int = MOST_KEPT, twice: bool = False) -> Encoder:
    """One encoder for each worker process, as long as it is in use."""
    return workers.only(("encoder", path, most, twice), lambda: Encoder(path, most, twice))
