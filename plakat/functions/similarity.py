"""Ratcliff-Obershelp similarity: Spark has no such expression, so an Arrow-batched function over the standard library."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def shared_tokens(tokens: pd.Series, others: pd.Series, exact: pd.Series) -> pd.Series:
    """Share of ``tokens`` that are among ``exact``, or (four letters or more) resemble one of ``others``: same first letter, lengths at most two apart, ratio 0.85 or more.

    Null arrays give null, so decided rows cost nothing.
    """
    near: dict[tuple[str, str], bool] = {}

    def alike(t: str, u: str) -> bool:
        if abs(len(t) - len(u)) > 2 or t[0] != u[0]:
            return False
        if (t, u) not in near:
            near[t, u] = SequenceMatcher(None, t, u).ratio() >= 0.85
        return near[t, u]

    out = []
    for ts, us, es in zip(tokens, others, exact, strict=True):
        if ts is None or us is None or es is None:
            out.append(None)
            continue
        have = set(es)
        out.append(sum(t in have or len(t) >= 4 and any(alike(t, u) for u in us) for t in ts) / len(ts) if len(ts) else 0.0)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts, 0..1; asymmetric like its definition; null with a null."""
    seen: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a, b, strict=True):
        if not isinstance(x, str) or not isinstance(y, str):
            out.append(None)
            continue
        if (x, y) not in seen:
            seen[x, y] = SequenceMatcher(None, x, y).ratio()
        out.append(seen[x, y])
    return pd.Series(out, dtype="float64")


def at_least(threshold: float):
    """Column function: is the ratio of two texts at least ``threshold``? Null texts give null, so undecided rows alone cost time.

    Two cheap upper bounds (lengths, then shared characters) spare most full comparisons.
    """

    @F.pandas_udf(T.BooleanType())
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        m = SequenceMatcher(None)
        out = []
        for x, y in zip(a, b, strict=True):
            if not isinstance(x, str) or not isinstance(y, str):
                out.append(None)
                continue
            total = len(x) + len(y)
            if total and 2 * min(len(x), len(y)) / total < threshold:
                out.append(False)
                continue
            m.set_seqs(x, y)
            out.append(m.quick_ratio() >= threshold and m.ratio() >= threshold)
        return pd.Series(out, dtype="boolean")

    return similar


# Upper bounds of the ratio, many pairs at once -----------------------------------------------------------

# Letters with a class of their own; others share the rest. Classes only widen a bound.
_OWN = "abcdefghijklmnopqrstuvwxyz ąćęłńóśźż0"
_CLASSES, _COUNTED, _LEVELS, _LONGEST, _WORD = 64, 32, 4, 128, 64


@functools.cache
def _class_of() -> np.ndarray:
    out = (np.arange(0x110000) % (_CLASSES - len(_OWN)) + len(_OWN)).astype(np.uint8)
    out[[ord(c) for c in _OWN]] = np.arange(len(_OWN))
    return out


def pair_ranges(start: np.ndarray, end: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with ``start[i] <= j < end[i]``, about ``most`` at a time."""
    n = np.maximum(end - start, 0)
    total = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        m = n[at:to]
        i = np.repeat(np.arange(at, to), m)
        if len(i):
            yield i, np.arange(len(i)) + np.repeat(start[at:to] - (np.cumsum(m) - m), m)
        at = to


class Texts:
    """Texts coded for bounds of their pairwise ratios: shared characters first, then the longest common subsequence.

    Matching blocks are a common subsequence, so a pair that fails a bound fails the ratio. Texts beyond ``_LONGEST`` characters are bounded by length alone.
    """

    def __init__(self, texts: Sequence[str]) -> None:
        n = len(texts)
        self.size = np.array([len(t) for t in texts], np.int32).reshape(n)
        self.long = self.size > _LONGEST
        width = max(1, int(self.size[~self.long].max(initial=1)))
        codes = np.array([t[:width] for t in texts], f"U{width}").reshape(n, 1).view(np.uint32).reshape(n, width)
        inside = np.arange(width) < self.size[:, None]
        self.cls = np.where(inside, _class_of()[codes], _CLASSES).astype(np.uint8)
        small = np.where(self.cls < 27, self.cls, 27 + self.cls % (_COUNTED - 27)).astype(np.int32)
        small[~inside] = _COUNTED
        counts = np.bincount((small + (_COUNTED + 1) * np.arange(n)[:, None]).ravel(), minlength=n * (_COUNTED + 1)).reshape(n, _COUNTED + 1)[:, :_COUNTED]
        bits = np.packbits((counts[:, :, None] > np.arange(_LEVELS)).reshape(n, -1), axis=1)
        self.bits = [np.ascontiguousarray(w) for w in bits.view(np.uint64).T]
        self.over = np.maximum(counts - _LEVELS, 0).sum(axis=1).astype(np.int16)
        self.masks = np.zeros((n, _CLASSES + 1), np.uint64)
        rows = np.arange(n)
        for p in range(min(width, _WORD)):
            self.masks[rows, self.cls[:, p]] |= np.uint64(1 << p)
        self.masks[:, _CLASSES] = 0

    def _passes(self, i: np.ndarray, j: np.ndarray, shared: np.ndarray, threshold: float, held: bool) -> np.ndarray:
        ok = 2 * shared >= threshold * (self.size[i] + self.size[j]) - 1e-6
        return ok | (shared >= np.minimum(self.size[i], self.size[j])) if held else ok

    def near(self, i: np.ndarray, j: np.ndarray, threshold: float, held: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose ratio may reach ``threshold``; with ``held`` also those of which one may lie in the other."""
        shared = np.minimum(self.over[i], self.over[j])
        for w in self.bits:
            shared += np.bitwise_count(w[i] & w[j])
        if self.long.any():
            shared = np.where(self.long[i] | self.long[j], np.minimum(self.size[i], self.size[j]), shared)
        ok = self._passes(i, j, shared, threshold, held)
        i, j = i[ok], j[ok]
        ok = self._passes(i, j, self._subsequence(i, j), threshold, held)
        return i[ok], j[ok]

    def _subsequence(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence, bit-parallel; the shorter length where neither text fits a word."""
        short = self.size[i] <= self.size[j]
        p, t = np.where(short, i, j), np.where(short, j, i)
        out = self.size[p].copy()
        fits = np.flatnonzero((self.size[p] <= _WORD) & ~self.long[t])
        fits = fits[np.argsort(self.size[t[fits]].astype(np.uint8), kind="stable")]  # texts of one length take as many steps
        flat = self.masks.ravel()
        for k in range(0, len(fits), 1 << 13):
            at = fits[k : k + (1 << 13)]
            rows, text = p[at] * (_CLASSES + 1), np.ascontiguousarray(self.cls[t[at]].T)
            v, u, w, where = np.full(len(at), ~np.uint64(0)), np.empty(len(at), np.uint64), np.empty(len(at), np.uint64), np.empty_like(rows)
            for c in text[: int(self.size[t[at]].max(initial=0))]:
                np.take(flat, np.add(rows, c, out=where), out=u, mode="clip")
                np.bitwise_and(u, v, out=u)
                np.add(v, u, out=w)
                np.subtract(v, u, out=v)
                np.bitwise_or(v, w, out=v)
            out[at] = np.bitwise_count(~v)
        return out
