"""Byte-level BPE of whole corpora: numpy merge rounds over the symbols of many words at once."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pattern that splits text into words before merging; fixed value, belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHIFT = 20
_NONE = np.int64(1) << 40
#: Words and ids a worker remembers; beyond either the memory starts anew.
CACHE_WORDS, CACHE_IDS = 400_000, 4_000_000
#: Words longer than this are encoded but not remembered.
CACHE_LENGTH = 64
#: Bytes from which a word is merged by a heap: rounds cost its length times the number of different merges in it.
LONG_BYTES = 512
#: Characters handled at once inside a batch.
CHUNK_CHARS = 2_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file: the installed package's folder, else /opt/tokenizers."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


@dataclass(frozen=True)
class MergeTable:
    """Pair keys sorted for binary search, the id each pair merges into (its rank), and the ids of the 256 bytes."""

    keys: np.ndarray
    merged: np.ndarray
    byte_ids: np.ndarray


def load_merges(path: str) -> MergeTable:
    """Read a rank file and list every pair of known pieces whose concatenation is known."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    keys, merged = [], []
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                keys.append((a << _SHIFT) | b)
                merged.append(rank)
    k = np.array(keys, dtype=np.int64)
    order = np.argsort(k)
    return MergeTable(k[order], np.array(merged, dtype=np.int64)[order], np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64))


def merge_rounds(words: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words: (flat ids, number of ids of each word).

    All symbols lie in one flat array. In each round every unfinished word
    merges its lowest-ranked pair wherever it occurs, from the left;
    words without a known pair are finished and leave the array.
    """
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    symbols = table.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(n), lengths)
    out_symbols, out_owner = [], []
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        rank = np.full(len(symbols), _NONE)
        if len(symbols) > 1:
            key = (symbols[:-1] << _SHIFT) | symbols[1:]
            at = np.minimum(np.searchsorted(table.keys, key), len(table.keys) - 1)
            known = (table.keys[at] == key) & (owner[:-1] == owner[1:])
            rank[:-1][known] = table.merged[at[known]]
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(symbols)])
        lowest = np.repeat(least, sizes)
        over = lowest == _NONE
        if over.any():
            out_symbols.append(symbols[over])
            out_owner.append(owner[over])
        pick = np.flatnonzero((rank == lowest) & ~over)
        if len(pick):
            # Overlapping picks (runs such as "aaaa"): every other one, from the left.
            run_start = np.r_[True, pick[1:] != pick[:-1] + 1]
            first = np.maximum.accumulate(np.where(run_start, np.arange(len(pick)), 0))
            pick = pick[(np.arange(len(pick)) - first) % 2 == 0]
            symbols[pick] = rank[pick]
            over[pick + 1] = True
        symbols, owner = symbols[~over], owner[~over]
    if not out_symbols:
        return np.empty(0, np.int32), np.zeros(n, np.int64)
    flat, owner = np.concatenate(out_symbols), np.concatenate(out_owner)
    order = np.argsort(owner, kind="stable")
    return flat[order].astype(np.int32), np.bincount(owner, minlength=n)


def merge_long(word: bytes, table: MergeTable) -> np.ndarray:
    """Ids of one long word: the lowest-ranked pair first, the leftmost of equal ones, from a heap over linked symbols."""
    symbols = table.byte_ids[np.frombuffer(word, np.uint8)]

    def ranks(key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(table.keys, key), len(table.keys) - 1)
        return np.where(table.keys[at] == key, table.merged[at], _NONE)

    rank = ranks((symbols[:-1] << _SHIFT) | symbols[1:])
    there = np.flatnonzero(rank != _NONE)
    heap = list(zip(rank[there].tolist(), there.tolist(), strict=True))
    heapq.heapify(heap)
    ids, n, none = symbols.tolist(), len(symbols), int(_NONE)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    wanted = rank.tolist() + [none]  # rank of the pair that starts here; none once a symbol is swallowed
    known: dict[int, int] = {}

    def renew(i: int) -> None:
        j = after[i]
        wanted[i] = none
        if j < n:
            key = (ids[i] << _SHIFT) | ids[j]
            if key not in known:
                known[key] = int(ranks(np.array([key]))[0])
            wanted[i] = known[key]
            if wanted[i] != none:
                heapq.heappush(heap, (wanted[i], i))

    while heap:
        r, i = heapq.heappop(heap)
        if wanted[i] != r:
            continue
        j = after[i]
        ids[i], after[i], wanted[j], ids[j] = r, after[j], none, -1
        if after[j] < n:
            before[after[j]] = i
        renew(i)
        if before[i] >= 0:
            renew(before[i])
    return np.array([x for x in ids if x >= 0], np.int32)


class Encoder:
    """Encodes texts, remembering the short words met before; memory is bounded by ``CACHE_WORDS`` and ``CACHE_IDS`` plus one chunk of text."""

    def __init__(self, table: MergeTable, pattern: str = PATTERN) -> None:
        self.table, self.split = table, regex.compile(pattern).findall
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.store = np.empty(0, np.int32)

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in their order, the very long ones apart."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        long = [i for i, w in enumerate(raw) if len(w) >= LONG_BYTES]
        flat, count = merge_rounds([w for w in raw if len(w) < LONG_BYTES], self.table)
        if not long:
            return flat, count
        parts = np.split(flat, np.cumsum(count)[:-1]) if len(count) else []
        for i in long:  # ascending, so earlier insertions are counted in
            parts.insert(i, merge_long(raw[i], self.table))
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each text); null and empty texts have none."""
        parts = [self.split(t) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS or len(self.store) > CACHE_IDS:
            self._reset()
        fresh = list(dict.fromkeys(w for w in chain.from_iterable(parts) if w not in self.known))
        # Long words are forgotten with this chunk: they come last, and only what stands before them is kept.
        fresh.sort(key=lambda w: len(w) > CACHE_LENGTH)
        start, number, store = self.start, self.count, self.store
        index_of = self.known
        if fresh:
            flat, count = self._merged(fresh)
            base, keep = len(start), sum(len(w) <= CACHE_LENGTH for w in fresh)
            self.known.update(zip(fresh[:keep], range(base, base + keep), strict=True))
            index_of = self.known if keep == len(fresh) else dict(zip(fresh[keep:], range(base + keep, base + len(fresh)), strict=True))
            start = np.concatenate([start, len(store) + np.cumsum(count) - count])
            number = np.concatenate([number, count])
            store = np.concatenate([store, flat])
            kept_ids = len(self.store) + int(count[:keep].sum())
            self.start, self.count, self.store = start[: base + keep], number[: base + keep], store[:kept_ids]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        look = self.known.__getitem__ if index_of is self.known else lambda w: self.known[w] if w in self.known else index_of[w]
        index = np.fromiter(map(look, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        count = number[index]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        flat = store[np.repeat(start[index] - (ends - count), count) + np.arange(total)]
        bounds = np.r_[0, np.cumsum(sizes)]
        return flat, np.diff(np.r_[0, ends][bounds])


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    chunk: list[str | None] = []
    chars = 0
    for t in texts:
        chunk.append(t)
        chars += len(t) if t else 0
        if chars >= CHUNK_CHARS:
            yield chunk
            chunk, chars = [], 0
    if chunk:
        yield chunk


def token_ids(df: DataFrame, id_col: str, text_col: str, path: str | None = None, count_only: bool = False) -> DataFrame:
    """Encode every text whole: (id_col, ids array<int>), or (id_col, n_tokens bigint) with ``count_only``.

    Null and empty texts give an empty list (or 0); rows are kept one for one,
    repeated ids included. Special tokens are never produced: their spelling
    in a text is ordinary text. The merge table (a fixed vocabulary file, a few MB)
    is broadcast.
    """
    table = df.sparkSession.sparkContext.broadcast(load_merges(path or vocabulary_path()))
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(table.value)
        for batch in batches:
            ids, texts, done = batch.column(0), batch.column(1).to_pylist(), 0
            for chunk in _chunks(texts):
                flat, sizes = encoder.encode(chunk)
                part = ids.slice(done, len(chunk))
                done += len(chunk)
                if count_only:
                    out = pa.array(sizes, pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part, out], [id_col, "n_tokens" if count_only else "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ("n_tokens bigint" if count_only else "ids array<int>"))
