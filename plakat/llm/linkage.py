"""Matching entities across sources without keys: matching functions vote, a generative model weighs them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plakat.llm.canonical import fold
from plakat.llm.lookalike import UNUSUAL_JAVA, skeleton
from plakat.llm.mojibake import CLEAN, Model, predict, repair
from plakat.runtime import cut

#: A title word is common if more than this share of all records has it, and more than COMMON_ROWS records.
COMMON_SHARE, COMMON_ROWS = 0.002, 60
#: Start times further apart than this many minutes belong to different showings.
APART_MINUTES = 45
#: Minutes from the opening of the doors to the start.
DOORS_MINUTES = 30
#: Least posterior. Patterns between a quarter and a half agree in artist, day and time and differ in rare votes only.
ACCEPT = 0.25

#: Records of one word and day beyond which its pairs meet by town and start too, and how many of them one task joins with the others.
HOT_ROWS, PART_ROWS, MOST_PARTS = 200, 5_000, 64

#: Hash slots by which rows that no join needs are left out beforehand.
SLOTS = 1 << 18

# The label model -------------------------------------------------------------------------------------


@dataclass
class LabelModel:
    """Two latent classes over categorical votes; each vote depends on the class and on one other vote (a tree)."""

    names: list[str]
    prior: float
    parents: list[int]
    tables: list[np.ndarray]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Confidence of a match for rows of votes (codes 0..k-1 a column)."""
        score = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for j, table in enumerate(self.tables):
            p = self.parents[j]
            up = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
            score += np.log(table[:, up, votes[:, j]]).T
        score -= score.max(axis=1, keepdims=True)
        e = np.exp(score)
        return e[:, 1] / e.sum(axis=1)


def _tables(votes: np.ndarray, weight: np.ndarray, sizes: list[int], parents: list[int], smooth: float) -> list[np.ndarray]:
    """Conditional tables [class, parent's vote, vote] from weighted rows; weight[:, c] is a row's mass in class c."""
    out = []
    for j, k in enumerate(sizes):
        p = parents[j]
        up = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
        n_up = sizes[p] if p >= 0 else 1
        t = np.zeros((2, n_up, k))
        for c in range(2):
            np.add.at(t[c], (up, votes[:, j]), weight[:, c])
        lone = t.sum(axis=1, keepdims=True)
        lone = (lone + 1) / (lone.sum(axis=2, keepdims=True) + k)
        t += smooth * lone  # rare parents fall back on the vote's own distribution
        out.append(t / t.sum(axis=2, keepdims=True))
    return out


def _tree(votes: np.ndarray, weight: np.ndarray, sizes: list[int], least: float = 0.01) -> list[int]:
    """Chow-Liu tree on the mutual information of votes given the class; votes that share less than ``least`` nats stay free."""
    m = len(sizes)
    info = np.zeros((m, m))
    total = weight.sum()
    for i in range(m):
        for j in range(i):
            for c in range(2):
                t = np.full((sizes[i], sizes[j]), 1e-9)
                np.add.at(t, (votes[:, i], votes[:, j]), weight[:, c])
                mass = t.sum()
                q = t / mass
                info[i, j] += mass / total * float((q * np.log(q / (q.sum(1, keepdims=True) * q.sum(0, keepdims=True)))).sum())
    info = np.maximum(info, info.T)
    parents = [-1] * m
    inside = {0}
    while len(inside) < m:
        a, b = max(((i, j) for i in inside for j in range(m) if j not in inside), key=lambda x: info[x])
        parents[b] = a if info[a, b] >= least else -1
        inside.add(b)
    return parents


def fit_label_model(patterns: pd.DataFrame, names: list[str], sizes: list[int], positive: list[set[int]], negative: list[set[int]], rounds: int = 40, smooth: float = 20.0) -> LabelModel:
    """Learn accuracies and correlations by expectation maximisation over counted vote patterns.

    The tree of correlated votes is read off the starting guess before the first round, so that votes that
    repeat each other don't pass for independent witnesses, and once more half way. ``positive`` and ``negative`` name the codes by which each matching function speaks for or
    against a match; they only start the estimation. An empty pattern table gives a model that accepts nothing.
    """
    if not len(patterns):
        return LabelModel(names, 1e-6, [-1] * len(names), [np.full((2, 1, k), 1 / k) for k in sizes])
    votes, count = patterns[names].to_numpy(np.int64), patterns["n"].to_numpy(float)
    lean = sum(np.isin(votes[:, j], list(positive[j])).astype(float) - 1.5 * np.isin(votes[:, j], list(negative[j])) for j in range(len(names)))
    post = 1 / (1 + np.exp(-1.5 * (lean - 1.0)))
    model = None
    for _ in range(2):
        parents = _tree(votes, np.c_[(1 - post) * count, post * count], sizes)
        for _ in range(rounds):
            w = np.c_[(1 - post) * count, post * count]
            model = LabelModel(names, float(np.clip(w[:, 1].sum() / count.sum(), 0.01, 0.99)), parents, _tables(votes, w, sizes, parents, smooth))
            post = model.posterior(votes)
    return model


# Records ---------------------------------------------------------------------------------------------


def tidy_records(df: DataFrame, columns: list[str], garbled: Model | None) -> DataFrame:
    """Put text columns into consistent characters, in one pass: Python gets nulls but for texts with unusual characters."""
    shared = df.sparkSession.sparkContext.broadcast(garbled)

    @F.pandas_udf("string")
    def tidied(values: pd.Series) -> pd.Series:
        texts = sorted({v for v in values if isinstance(v, str)})
        verdicts = [CLEAN] * len(texts) if shared.value is None else predict(texts, shared.value)
        clean = {t: skeleton(repair(t, v)) for t, v in zip(texts, verdicts, strict=True)}
        return pd.Series([clean[v] if isinstance(v, str) else None for v in values], dtype=object)

    unusual = lambda c: F.coalesce(F.col(c).rlike(UNUSUAL_JAVA), F.lit(False))
    marked = df.withColumns({f"_u{c}": unusual(c) for c in columns})
    return marked.withColumns({c: F.when(F.col(f"_u{c}"), tidied(F.when(F.col(f"_u{c}"), F.col(c)))).otherwise(F.col(c)) for c in columns}).drop(*[f"_u{c}" for c in columns])


def minutes(c: Column) -> Column:
    """Minute of the day of HH:MM or H.MM; null for anything else."""
    h, m = F.regexp_extract(c, r"^\s*(\d{1,2})[:.](\d{2})\s*$", 1), F.regexp_extract(c, r"^\s*(\d{1,2})[:.](\d{2})\s*$", 2)
    return F.when(h != "", h.cast("int") * 60 + m.cast("int"))


def day(c: Column) -> Column:
    """Date of YYYY-MM-DD with or without a time, or DD.MM.YYYY; null for anything else."""
    iso = F.regexp_extract(c, r"^\s*(\d{4}-\d{2}-\d{2})", 1)
    dotted = F.regexp_replace(F.regexp_extract(c, r"^\s*(\d{1,2}\.\d{1,2}\.\d{4})", 1), r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3-$2-$1")
    return F.coalesce(F.try_to_date(F.nullif(iso, F.lit(""))), F.try_to_date(F.nullif(dotted, F.lit(""))))


VOTES = ["artist", "phrase", "kind", "start", "venue", "place", "town", "doors", "same"]
SIZES = [3, 4, 3, 4, 4, 3, 3, 3, 2]
FOR = [{1}, {1}, {1}, {1, 3}, {1, 3}, {1}, {1}, {1}, {1}]
AGAINST = [{2}, {2}, {2}, {2}, {2}, {2}, {2}, {2}, set()]


def showing_links(records: DataFrame, garbled: Model | None = None, accept: float = ACCEPT) -> DataFrame:
    """Pairs of records of different sources that announce the same showing: (id_a < id_b, confidence).

    ``records``: (id, source, title, date, date_end, start, doors, venue, place, town, kind).
    Candidates share the day and a rare title word, or common ones and the town (see ``_common_pairs``). An end date before the
    start date shows that the latter is off: the day is then the end date; it is also used if the start
    date is missing. Nine matching functions vote on each candidate; only counted vote patterns (at
    most 31,104 by the sizes of the votes) reach the driver, where the label model learns from
    them. Pairs below ``accept`` are dropped, and by exact check those whose starts are known to lie
    more than 45 minutes apart or whose towns are known to differ; words that many records of a day share are joined by town and start besides, which
    loses none of the pairs that pass this check. A record without a time that fits several starts of a day is linked to one: a
    start its own source doesn't list otherwise, then the one with most records, then the earliest.
    Records without a day or without any title word form no pairs; records of one source never do. Repeated ids are one record.
    """
    base = records.select("id", "source", "title", "date", "date_end", "start", "doors", "venue", "place", "town", "kind").where(F.col("id").isNotNull())
    base = tidy_records(base, ["title", "venue"], garbled)
    d, e = day(F.col("date")), day(F.col("date_end"))
    bare = lambda c: F.filter(F.array_distinct(F.split(fold(F.col(c)), r"[^\p{L}\p{N}]+")), lambda x: F.length(x) >= 2)
    venue = F.when(F.trim("venue") != "", bare("venue"))
    # Venue words count by their first five letters (inflection); names of three words or more also by their initials.
    initials = F.array_join(F.transform(F.filter(F.split(fold(F.regexp_replace("venue", r"[,(].*$", "")), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.substring(x, 1, 1)), "")
    base = base.select(
        "id", "source", bare("title").alias("w"), F.when(e < d, e).otherwise(F.coalesce(d, e)).alias("day"),
        F.coalesce(minutes(F.col("start")), minutes(F.col("doors")) + DOORS_MINUTES).alias("t"), minutes(F.col("doors")).alias("dr"),
        F.transform(F.coalesce(F.concat(venue, F.when(F.size(venue) >= 3, F.array(initials)).otherwise(F.array().cast("array<string>"))), F.array().cast("array<string>")), lambda x: F.hash(F.substring(x, 1, 5))).alias("v"),
        F.hash(F.nullif(F.trim("place"), F.lit(""))).alias("p"), F.when(F.trim("place") == "", True).otherwise(F.col("place").isNull()).alias("no_p"),
        F.hash(F.nullif(F.trim("town"), F.lit(""))).alias("c"), F.coalesce(F.trim("town") == "", F.lit(True)).alias("no_c"),
        F.hash("kind").alias("k"), F.col("kind").isNull().alias("no_k"), F.hash(fold(F.col("title"))).alias("h"),
    ).where("day is not null and size(w) > 0")
    base = cut(base)
    n = base.count()
    counted = base.select(F.explode("w").alias("x")).groupBy("x").count().where(F.col("count") > max(COMMON_ROWS, COMMON_SHARE * n))
    # Words above a fixed share of the records: at most (words a title) / COMMON_SHARE of them; Spark tests them by a hash set.
    common = sorted(r[0] for r in counted.select("x").collect())
    own = base.select("*", F.filter("w", lambda x: ~x.isin(common)).alias("r"), F.transform(F.filter("w", lambda x: x.isin(common)), lambda x: F.hash(x)).alias("m")).drop("w")
    own = cut(own) if common else own
    keyed = own.withColumn("key", F.explode("r"))
    hot = cut(keyed.groupBy("key", "day").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS))
    # Both sides of the join read the one exchange.
    a = keyed.join(hot, ["key", "day"], "left_anti").repartition("key", "day")
    cols = [c for c in a.columns if c not in ("key", "day")]
    other = lambda df, *more: df.select(*more, "key", "day", *[F.col(c).alias(f"{c}_b") for c in cols])
    pairs = a.join(other(a), ["key", "day"]).where("id < id_b")
    if not hot.isEmpty():
        h = keyed.join(hot.select("key", "day", F.least(F.lit(MOST_PARTS), F.ceil(F.col("n") / PART_ROWS)).cast("int").alias("_n")), ["key", "day"])
        left = h.withColumn("_m", F.explode(_meets(True))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        right = other(h.withColumn("_m", F.explode(_meets(False))).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")), "_m", "_part")
        pairs = pairs.unionByName(left.join(right, ["key", "day", "_m", "_part"]).where("id < id_b").drop("_m", "_part"))
    # A pair that shares several rare words is kept once, at the smallest of them.
    pairs = pairs.where(F.col("key") == F.array_min(F.array_intersect("r", "r_b"))).drop("key", "day")
    if common:
        met = cut(_common_pairs(own))
        part = _among(own.drop("day"), ["id"], met.select("id").union(met.select("id_b")))
        pairs = pairs.unionByName(met.join(part, "id").join(part.select(*[F.col(c).alias(f"{c}_b") for c in cols]), "id_b").where(~F.arrays_overlap("r", "r_b")))
    both = F.array_intersect("r", "r_b")

    # A slip in one name: some unshared words differ by one letter, or by two exchanged ones.
    slip = F.exists(F.array_except("r", "r_b"), lambda x: F.exists(F.array_except("r_b", "r"), lambda y: F.levenshtein(x, y) <= F.when(F.length(x) == F.length(y), 2).otherwise(1)))
    artist = F.when(F.size(both) >= 2, 1).when((F.size("r") < 2) | (F.size("r_b") < 2), 0).when(slip, 1).otherwise(2)
    least = F.least(F.size("m"), F.size("m_b"))
    shared = F.size(F.array_intersect("m", "m_b")) / F.greatest(least, F.lit(1))
    phrase = F.when(least < 2, 0).when(shared >= 0.6, 1).when(shared < 0.34, 2).otherwise(3)
    kind = F.when(F.col("no_k") | F.col("no_k_b"), 0).when(F.col("k") == F.col("k_b"), 1).otherwise(2)
    gap = F.abs(F.col("t") - F.col("t_b"))
    start = F.when(gap.isNull(), 0).when(gap == 0, 1).when(gap <= APART_MINUTES, 3).otherwise(2)
    v_least = F.least(F.size("v"), F.size("v_b"))
    v_shared = F.size(F.array_intersect("v", "v_b")) / F.greatest(v_least, F.lit(1))
    place_text = F.when(v_least == 0, 0).when(v_shared >= 0.99, 1).when(v_shared >= 0.5, 3).otherwise(2)
    place = F.when(F.col("no_p") | F.col("no_p_b"), 0).when(F.col("p") == F.col("p_b"), 1).otherwise(2)
    town = F.when(F.col("no_c") | F.col("no_c_b"), 0).when(F.col("c") == F.col("c_b"), 1).otherwise(2)
    doors = F.when(F.col("dr").isNull() | F.col("dr_b").isNull(), 0).when(F.abs(F.col("dr") - F.col("dr_b")) <= APART_MINUTES, 1).otherwise(2)
    same = F.when(F.col("h") == F.col("h_b"), 1).otherwise(0)
    votes = dict(zip(VOTES, (artist, phrase, kind, start, place_text, place, town, doors, same), strict=True))
    cand = pairs.select("id", "id_b", (F.col("source").eqNullSafe(F.col("source_b"))).alias("one_source"), "t", "t_b", *[x.cast("int").alias(v) for v, x in votes.items()])
    code = F.lit(0)
    for v, k in zip(VOTES, SIZES, strict=True):
        code = code * k + F.col(v)
    cand = cut(cand.select("id", "id_b", "one_source", "t", "t_b", code.alias("code")))

    seen = cand.where("not one_source").groupBy("code").agg(F.count("*").alias("n")).toPandas().sort_values("code")
    left = seen["code"].to_numpy(np.int64)
    for v, k in reversed(list(zip(VOTES, SIZES, strict=True))):
        seen[v] = left % k
        left = left // k
    model = fit_label_model(seen, VOTES, SIZES, FOR, AGAINST)
    every = cand.select("code").distinct().toPandas()
    left, grid = every["code"].to_numpy(np.int64), np.zeros((len(every), len(VOTES)), np.int64)
    for j in range(len(VOTES) - 1, -1, -1):
        grid[:, j] = left % SIZES[j]
        left = left // SIZES[j]
    table = [(int(c), float(p)) for c, p in zip(every["code"], model.posterior(grid) if len(grid) else [], strict=True)]
    known = F.broadcast(records.sparkSession.createDataFrame(table, "code int, confidence double"))  # a row a vote pattern
    apart = F.floor(F.col("code") / int(np.prod(SIZES[VOTES.index("town") + 1 :]))) % SIZES[VOTES.index("town")] == 2
    good = cand.join(known, "code").where((F.col("confidence") >= accept) & (gap.isNull() | (gap <= APART_MINUTES)) & ~apart).drop("code")
    return _settle(good)


def _among(df: DataFrame, on: list[str], keys: DataFrame) -> DataFrame:
    """Rows whose key may be among ``keys`` (columns in the order of ``on``), by hash slots; a join follows."""
    slot = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(SLOTS)).alias("_s")
    seen = keys.select(slot([F.col(c) for c in keys.columns])).distinct()
    return df.withColumn("_s", slot([F.col(c) for c in on])).join(F.broadcast(seen), "_s", "left_semi").drop("_s")  # SLOTS rows at most


_OPEN, _ANY = 1 << 40, (1 << 40) + 1  # keys of towns (hashes of 32 bits) and of starts that aren't known


def _meets(left: bool) -> Column:
    """Keys (town, start) by which two records of columns c, no_c, t meet exactly once, unless their towns differ or their starts lie more than 45 minutes apart (next slots may).

    Known towns meet at the town alone. A record without a town meets those of all towns, by starts; one without a start those of all starts.
    """
    at = lambda town, start: F.struct(F.lit(town).cast("bigint").alias("town") if not isinstance(town, Column) else town.cast("bigint").alias("town"), (start if isinstance(start, Column) else F.lit(start)).cast("bigint").alias("start"))
    slot = F.floor(F.col("t") / (APART_MINUTES + 1))
    if left:
        starts = lambda town: F.when(F.col("t").isNull(), F.array(at(town, _ANY))).otherwise(F.array(at(town, slot - 1), at(town, slot), at(town, slot + 1), at(town, _OPEN)))
        return F.when(F.col("no_c"), starts(_ANY)).otherwise(F.concat(F.array(at(F.col("c"), 0)), starts(_OPEN)))
    starts = lambda town: F.array(at(town, F.coalesce(slot, F.lit(_OPEN))), at(town, _ANY))
    return F.when(F.col("no_c"), F.concat(starts(_OPEN), starts(_ANY))).otherwise(F.concat(F.array(at(F.col("c"), 0)), starts(_ANY)))


def _common_pairs(own: DataFrame) -> DataFrame:
    """Pairs of records of a day that share a common title word and whose towns and starts don't contradict: (id < id_b).

    At least one of the two has fewer than two rare words; titles with two or more each name their artists by them.
    """
    slim = own.where("size(m) > 0").select("id", "day", "t", "c", "no_c", "m", (F.size("r") < 2).alias("few"))
    few = slim.where("few").withColumn("_m", F.explode(_meets(True))).withColumn("key", F.explode("m"))
    every = slim.withColumn("_m", F.explode(_meets(False))).withColumn("key", F.explode("m"))
    every = _among(every, ["key", "day", "_m"], few.select("key", "day", "_m"))
    met = every.drop("c", "no_c").join(few.select("key", "day", "_m", *[F.col(x).alias(f"{x}_b") for x in ("id", "t", "m")]), ["key", "day", "_m"])
    gap = F.abs(F.col("t") - F.col("t_b"))
    # A pair of two records with few words is met from both sides, and one that shares several words at each of them.
    met = met.where("id <> id_b and (not few or id < id_b)").where(gap.isNull() | (gap <= APART_MINUTES)).where(F.col("key") == F.array_min(F.array_intersect("m", "m_b")))
    return met.select(F.least("id", "id_b").alias("id"), F.greatest("id", "id_b").alias("id_b"))


def _settle(good: DataFrame) -> DataFrame:
    """Link records without a time to one start of the day where several fit."""
    timed = good.where("(t is null and t_b is null) or (t is not null and t_b is not null)").where("not one_source").select("id", "id_b", "confidence")
    half = good.where("(t is null) <> (t_b is null)")
    half = half.select(F.when(F.col("t").isNull(), F.col("id")).otherwise(F.col("id_b")).alias("open"), F.when(F.col("t").isNull(), F.col("id_b")).otherwise(F.col("id")).alias("other"), F.coalesce("t", "t_b").alias("t"), "one_source", "confidence")
    # Starts of a day within 45 minutes of each other are one; a chain starts anew after a larger gap.
    starts = half.groupBy("open", "t").agg(F.max(F.col("one_source").cast("int")).alias("own"), F.count("*").alias("n"))
    per = starts.groupBy("open").agg(F.sort_array(F.collect_list(F.struct("t", "own", "n"))).alias("s"))
    groups = F.aggregate(
        "s", F.array().cast("array<struct<lo:int,hi:int,own:int,n:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["t"] - F.element_at(acc, -1)["hi"] <= APART_MINUTES),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["lo"].alias("lo"), x["t"].alias("hi"), F.greatest(F.element_at(acc, -1)["own"], x["own"]).alias("own"), (F.element_at(acc, -1)["n"] + x["n"]).alias("n")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["t"].alias("lo"), x["t"].alias("hi"), x["own"].alias("own"), x["n"].alias("n"))))),
    )
    pick = F.array_min(F.transform(groups, lambda g: F.struct(F.when(F.size(groups) > 1, g["own"]).otherwise(0).alias("o"), (-g["n"]).alias("m"), g["lo"].alias("lo"), g["hi"].alias("hi"))))
    chosen = per.select("open", pick.alias("g")).select("open", "g.lo", "g.hi")
    settled = half.where("not one_source").join(chosen, "open").where(F.col("t").between(F.col("lo"), F.col("hi")))
    settled = settled.select(F.least("open", "other").alias("id"), F.greatest("open", "other").alias("id_b"), "confidence")
    return timed.unionByName(settled).groupBy(F.col("id").alias("id_a"), "id_b").agg(F.max("confidence").alias("confidence"))
