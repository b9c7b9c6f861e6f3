"""Filling containers of fixed capacity: exact complements by length first, best fit for what is left."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plakat.runtime import cut

CAPACITY = 2048
#: Items of one length that one ranking task sorts.
RANK_ROWS = 200_000
_KEY = np.int64(1) << 40


class SumIndex:
    """Hash index of the sums of one, two and three lengths that are at hand.

    Pairs lie in buckets by their sum, triples in buckets by their sum as (largest part, bucket of the pair that completes it).
    Buckets are cut from flat arrays when they are first asked for. Counts only fall, so an entry found used up leaves its bucket for good
    and is never met again. Memory: at most (lengths)^2 / 4 pairs and (lengths x capacity) / 2 triples, whatever the number of items.
    """

    def __init__(self, left: np.ndarray) -> None:
        self.left = left  # counts by length, shared with the caller
        capacity = len(left) - 1
        lengths = np.flatnonzero(left)[::-1].astype(np.int32)
        a, b = lengths[:, None], lengths[None, :]
        i, j = np.nonzero((a >= b) & (a + b <= capacity))  # larger part first, descending
        self._pairs = self._by_sum(lengths[i] + lengths[j], np.c_[lengths[i], lengths[j]], capacity)
        some = np.flatnonzero(np.diff(self._pairs[0]) > 0).astype(np.int32)
        x, s = lengths[:, None], some[None, :]
        i, j = np.nonzero((s <= 2 * x) & (x + s <= capacity))
        self._triples = self._by_sum(lengths[i] + some[j], np.c_[lengths[i], some[j]], capacity)
        self._cache: dict[tuple[int, int], list[list[int]]] = {}

    @staticmethod
    def _by_sum(sums: np.ndarray, entries: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
        return np.r_[0, np.cumsum(np.bincount(sums, minlength=capacity + 1))], entries[np.argsort(sums, kind="stable")]

    def _bucket(self, size: int, total: int) -> list[list[int]]:
        key = (size, total)
        if key not in self._cache:
            at, entries = self._pairs if size == 2 else self._triples
            self._cache[key] = entries[at[total] : at[total + 1]].tolist()
        return self._cache[key]

    def _pair(self, total: int, taken: Counter, most: int) -> tuple[list[int] | None, bool]:
        """(an available pair whose larger part is at most ``most``, is any pair of the sum left at all?)."""
        bucket, alive, found = self._bucket(2, total), [], None
        for n, (a, b) in enumerate(bucket):
            if self.left[a] < 1 + (a == b) or self.left[b] < 1:
                continue
            alive.append([a, b])
            if a <= most and self.left[a] - taken[a] >= 1 + (a == b) and self.left[b] - taken[b] >= 1:
                found = [a, b]
                alive += bucket[n + 1 :]
                break
        self._cache[2, total] = alive
        return found, bool(alive)

    def complement(self, gap: int, taken: Counter) -> list[int] | None:
        """One, two or three lengths that fill ``gap`` exactly beside the lengths ``taken`` already; the fewest, then the largest first."""
        if self.left[gap] > taken[gap]:
            return [gap]
        pair, _ = self._pair(gap, taken, gap)
        if pair:
            return pair
        bucket, alive, found = self._bucket(3, gap), [], None
        for n, (x, rest) in enumerate(bucket):
            if self.left[x] < 1:
                continue
            taken[x] += 1
            pair, any_left = self._pair(rest, taken, x) if self.left[x] >= taken[x] else (None, True)
            taken[x] -= 1
            if any_left:
                alive.append([x, rest])
            if pair:
                found = [x, *pair]
                alive += bucket[n + 1 :]
                break
        self._cache[3, gap] = alive
        return found


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Patterns of lengths and how often each is filled.

    For the longest length left, lengths that fill its gap exactly are
    looked up in the index of single, pair and triple sums; if there are none, the
    largest length that fits goes in (best fit) and the look-up is repeated. Each pattern
    is used as often as the counts allow, so a pattern uses up a length and the plan has
    about as many entries as there are lengths, however many items there are.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    index = SumIndex(left)
    out: list[tuple[Counter, int]] = []
    for size in range(capacity, 0, -1):
        while left[size] > 0:
            used = Counter([size])
            gap = capacity - size
            while gap:
                exact = index.complement(gap, used)
                if exact:
                    used.update(exact)
                    break
                best = next((int(f) for f in np.flatnonzero(left[: gap + 1])[::-1] if left[f] > used[int(f)]), 0)
                if not best:
                    break
                used[best] += 1
                gap -= best
            used = Counter({s: k for s, k in used.items() if k})
            times = min(int(left[s]) // k for s, k in used.items())
            for s, k in used.items():
                left[s] -= k * times
            out.append((used, times))
    return out


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Put every item into a container: (id_col, piece, first_unit, size, container_id).

    An item longer than the capacity is split into full pieces and a rest;
    no other item is split. Items of size 0 or null get one row with size 0 and a null
    container. Repeated ids are separate items.

    Only the counts by length reach the driver: at most ``capacity`` rows.
    Items are ranked within their length by hashed buckets and prefix sums, so that one
    length with a third of all items is ranked by many tasks.
    """
    kind = dict(items.dtypes)[id_col]
    size = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0))
    base = items.select(F.col(id_col).alias("_id"), size.alias("_n"))
    last = F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0)).cast("bigint")
    pieces = base.select("_id", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_p")).select(
        "_id", F.col("_p").alias("_piece"), (F.col("_p") * capacity).alias("_first"), F.least(F.col("_n") - F.col("_p") * capacity, F.lit(capacity)).cast("bigint").alias("_size")
    )
    counts = {r["_size"]: r["count"] for r in pieces.where("_size > 0").groupBy("_size").count().collect()}
    total = sum(counts.values())
    buckets = max(1, -(-total // rank_rows))

    keys, first, per, container = [], [], [], []
    seen: Counter = Counter()
    next_container = 0
    for pattern, times in plan_containers(counts, capacity):
        for s, k in pattern.items():
            keys.append(int(s) * int(_KEY) + seen[s])
            first.append(seen[s])
            per.append(k)
            container.append(next_container)
            seen[s] += k * times
        next_container += times
    order = np.argsort(np.array(keys, np.int64)) if keys else np.empty(0, np.int64)
    arrays = tuple(np.array(x, np.int64)[order] for x in (keys, first, per, container))
    plan = items.sparkSession.sparkContext.broadcast(arrays)  # about one entry a length and pattern: bounded by the capacity

    bucketed = pieces.where("_size > 0").withColumn("_b", F.pmod(F.xxhash64("_id", "_piece"), F.lit(buckets)).cast("int"))
    ahead = bucketed.groupBy("_size", "_b").agg(F.count("*").alias("_c"))
    ahead = ahead.withColumn("_ahead", F.sum("_c").over(W.partitionBy("_size").orderBy("_b")) - F.col("_c")).drop("_c")
    ranked = bucketed.withColumn("_r", F.row_number().over(W.partitionBy("_size", "_b").orderBy("_id", "_piece")))
    ranked = ranked.join(ahead, ["_size", "_b"]).select("_id", "_piece", "_first", "_size", (F.col("_ahead") + F.col("_r") - 1).alias("_rank"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, f, n, c = plan.value
        for pdf in batches:
            at = np.searchsorted(k, pdf["_size"].to_numpy() * _KEY + pdf["_rank"].to_numpy(), "right") - 1
            pdf["container_id"] = c[at] + (pdf["_rank"].to_numpy() - f[at]) // n[at]
            yield pdf.drop(columns="_rank")

    names = {"_id": id_col, "_piece": "piece", "_first": "first_unit", "_size": "size"}
    placed = ranked.mapInPandas(assign, f"_id {kind}, _piece bigint, _first bigint, _size bigint, container_id bigint")
    empty = pieces.where("_size = 0").withColumn("container_id", F.lit(None).cast("bigint"))
    return placed.unionByName(empty).withColumnsRenamed(names)


def pack_documents(sizes: DataFrame, id_col: str, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` over token counts; the counts are cut off from the encoding so that it runs once."""
    return pack(cut(sizes), id_col, "n_tokens", capacity)
