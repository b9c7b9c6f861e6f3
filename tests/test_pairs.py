"""Pairs of duplicate titles and bounds of ratios, against plain loops."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from plakat.functions.similarity import Texts, pair_ranges
from plakat.operators import dedup

_WORDS = ["Jazz", "nad", "rzeką", "Koncert", "wieczór", "Opera", "nocą", "bilety", "Ćwiczenia", "dzieci", "Łąka", "żarty", "ŻARTY", "Ночь", "12"]


def _titles(n, seed=1):
    rnd = random.Random(seed)
    out = [" ".join(rnd.choice(_WORDS) for _ in range(rnd.randint(1, 6))) for _ in range(n)]
    return out + [t.replace("a", "e", 1) for t in out[: n // 4]] + ["", " ", "x" * 70, "x" * 66 + " y", "długi " * 40, "długi " * 41]


@pytest.mark.parametrize("threshold", [0.65, 0.8])
def test_bounds_keep_what_passes(threshold):
    t = [x.lower() for x in _titles(120)]
    kept, n = set(), 0
    for i, j in pair_ranges(np.arange(1, len(t) + 1), np.full(len(t), len(t)), 1000):
        n += len(i)
        kept |= set(zip(*(x.tolist() for x in Texts(t).near(i, j, threshold, held=True)), strict=True))
    assert n == len(t) * (len(t) - 1) // 2 > 2 * len(kept)
    pairs = [(i, j) for i in range(len(t)) for j in range(i + 1, len(t))]
    assert not [p for p in pairs if p not in kept and (SequenceMatcher(None, t[p[0]], t[p[1]]).ratio() >= threshold or t[p[0]] in t[p[1]] or t[p[1]] in t[p[0]])]


@pytest.mark.parametrize(("most", "at_once"), [(2048, 1), (7, 16)])
def test_pairs_of_blocks_and_their_parts(spark, most, at_once):
    """Whatever the parts, the pairs are those of ``same_title``, as often as distinct (title, time) say."""
    rnd, times = random.Random(2), ["19:00", "19:30", "19:45", "20:00", "9:00", None, "Według harmonogramu"]
    rows = [(rnd.choice("abc") if i % 9 else None, t, rnd.choice(times)) for i, t in enumerate(_titles(32))] * 2 + [("a", None, "19:00")]
    df = spark.createDataFrame(rows, "d string, title string, t string")
    a, b = (df.distinct().withColumnsRenamed({"title": f"title_{x}", "t": f"t_{x}"}) for x in "ab")
    same = dedup.same_title(F.col("title_a"), F.col("title_b"), F.col("t_a"), F.col("t_b"))
    want = a.join(b, "d").where("title_a < title_b").where(same).select("d", "title_a", "title_b")
    got = dedup.same_title_pairs(df, ["d"], "title", "t", most, at_once)
    assert sorted(got.collect()) == sorted(want.collect()) and got.columns == want.columns
    assert dedup.same_title_pairs(df.where("d = 'x'"), ["d"], "title", "t").count() == 0


def test_many_titles_of_a_day(spark):
    """A block of 3,000 titles at two hours in one task's memory: joined pairwise it is 4.5 million rows."""
    rnd = random.Random(3)
    rows = [("d", f"{rnd.choice(_WORDS)} {i * 7919 % 100003:05d} {''.join(rnd.choices('abdefgiklmnoprstuwyz', k=18))}", "19:00" if i % 2 else None) for i in range(3000)]
    rows += [("d", r[1] + " bilety", r[2]) for r in rows[:50]]
    got = dedup.same_title_pairs(spark.createDataFrame(rows, "d string, title string, t string"), ["d"], "title", "t")
    assert {(r[1], r[1] + " bilety") for r in rows[:50]} <= {(r.title_a, r.title_b) for r in got.collect()}


def _plain_upsert(stored, batch, threshold=0.65):
    known = {}
    for o, _, _, u in sorted(stored):
        if u is not None:
            known.setdefault(u, o)
    targets, links, out = {}, {}, {}
    for o, d, k, _ in sorted(stored):
        targets.setdefault(d, []).append((o, k or ""))
    for o, d, k, u in sorted(batch):
        k = k or ""
        if u in known or (u is not None and (d, u) in links):
            out[o] = ("update", known[u] if u in known else links[d, u])
            continue
        like = lambda x: x and (x == k or x in k or k in x or SequenceMatcher(None, k, x).ratio() >= threshold)
        found = next((t for t, x in targets.get(d, []) if k and like(x)), None)
        if found is None:
            targets.setdefault(d, []).append((o, k))
            links[d, u] = o
        out[o] = ("insert", o) if found is None else ("merge", found)
    return out


@pytest.mark.parametrize(("chunk", "at_once"), [(256, 4096), (3, 1)])
def test_upsert_in_chunks_against_a_plain_loop(spark, chunk, at_once):
    rnd, keys = random.Random(4), [*_titles(150), None]
    rows = [(i, rnd.choice("aab") if i % 11 else None, rnd.choice(keys), f"u{rnd.randrange(250)}" if i % 3 else None) for i in range(400)]
    stored, batch = rows[:80], rows[80:]
    schema = "i int, d string, k string, u string"
    got = dedup.fuzzy_upsert(spark.createDataFrame(stored, schema), spark.createDataFrame(batch, schema), ["d"], "i", "k", "u", chunk=chunk, at_once=at_once)
    want = _plain_upsert(stored, batch)
    assert {r.ord: (r.action, r.target) for r in got.collect()} == want and {a for a, _ in want.values()} == {"update", "merge", "insert"}
