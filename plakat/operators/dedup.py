"""Duplicates: signatures, similar titles of one day, record merge, unique slugs."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plakat.functions.dates import minute_of_day, times_apart
from plakat.functions.similarity import Texts, at_least, pair_ranges, sequence_ratio, shared_tokens
from plakat.functions.text import acronym, stem, stem_word
from plakat.operators.order import positions
from plakat.runtime import cut

# Title words that tell nothing apart.
TITLE_STOPWORDS = ["przy", "swiecach", "świecach", "koncert", "spektakl", "recital", "festiwal", "festival", "stand", "standup", "stand-up", "show", "muzyka", "muzyki", "polska", "polskiej", "bielsko", "biala", "bielsku", "bialej", "opole", "opolu", "live", "tour", "trasa", "nowy", "program", "wieczor", "wieczór", "kameralny", "akustycznie", "bilety", "kup", "dla", "oraz", "jego", "orzeł", "orlem", "orłem", "sala", "redutowa", "domu", "kultury", "bck", "cavatina", "hall", "żywo", "zywo"]
GENERIC_VENUE_WORDS = ["teatr", "centrum", "dom", "kultura", "kultury", "galeria", "muzeum", "osrodek", "hala", "klub", "szkola", "biblioteka", "filharmonia", "arena"]
GENERIC_VENUE_TERMS = ["miejsce", "sala", "klub", "centrum", "teatr", "kawiarnia", "restauracja", "pub", "park", "plac", "hala", "dom", "osrodek", "ośrodek", "scena", "galeria", "filharmonia", "kino", "studio", "foyer", "kameralna"]
RAW_RATIO, JACCARD, SORTED_RATIO = 0.80, 0.40, 0.75


def first_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """First row of each key in a stated order; ``dropDuplicates`` would leave the choice open. Rows with null keys form groups of their own."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def title_stems(title: Column) -> Column:
    """struct(every, content): distinct stems of words of three or more letters or digits, sorted; and those that aren't stop words, unless only such are there."""
    words = F.regexp_extract_all(F.lower(title), F.lit(r"([a-z0-9ąćęłńóśźż]{3,})"), 1)
    every = F.array_sort(F.array_distinct(F.transform(words, stem)))
    stop = F.array(*[F.lit(w) for w in sorted({stem_word(w) for w in TITLE_STOPWORDS})])
    content = F.array_except(every, stop)
    return F.struct(every.alias("every"), F.when(F.size(content) > 0, content).otherwise(every).alias("content"))


def same_title(a: Column, b: Column, time_a: Column, time_b: Column, stems_a: Column | None = None, stems_b: Column | None = None) -> Column:
    """Are two titles of one day duplicates? Never if their times are 45 minutes or more apart.

    The cheap native tests come first; the Arrow function gets null for what they decide. Pass the
    titles' stems (``title_stems``) when each title meets several others, so that they are made once a title.
    """
    sa, sb = title_stems(a) if stems_a is None else stems_a, title_stems(b) if stems_b is None else stems_b
    s, t = sa["content"], sb["content"]
    both = F.size(F.array_intersect(s, t))
    every = F.size(s) + F.size(t) - both
    some = (F.size(s) > 0) & (F.size(t) > 0)
    native = some & ((both / F.greatest(every, F.lit(1)) >= JACCARD) | (both == F.size(s)) | (both == F.size(t)))
    apart = times_apart(time_a, time_b)
    ask = ~apart & ~F.coalesce(native, F.lit(False))
    raw = F.coalesce(at_least(RAW_RATIO)(F.when(ask, F.lower(F.trim(a))), F.when(ask, F.lower(F.trim(b)))), F.lit(False))
    words = lambda x: F.array_join(x["every"], " ")
    late = some & F.coalesce(at_least(SORTED_RATIO)(F.when(ask & some, words(sa)), F.when(ask & some, words(sb))), F.lit(False))
    return F.coalesce(~apart & (native | raw | late), F.lit(False))


def _whole(batches: Iterator[pd.DataFrame], by: list[str], at_once: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``by`` in frames of whole groups, each of ``at_once`` rows or more but for the last; a group may span batches."""
    held, n = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[by].to_numpy()
        at = 0
        for s in np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]):
            if n + s - at >= at_once and (s or held and list(held[-1][by].iloc[-1]) != list(keys[0])):
                yield pd.concat([*held, pdf.iloc[at:s]])
                held, n, at = [], 0, s
        held.append(pdf.iloc[at:])
        n += len(pdf) - at
    if n:
        yield pd.concat(held)


def _same_titles(title: np.ndarray, low: np.ndarray, words: np.ndarray, minute: np.ndarray, block: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of row numbers with ``same_title`` in a block, the smaller title first.

    Rows are sorted by block and minute (unknown: -1, first). ``right``: 0 and 1 are sides that meet only each other, -1 a block that meets itself.
    """
    n = len(title)
    tid = np.unique(title, return_inverse=True)[1]
    stop = {stem_word(w) for w in TITLE_STOPWORDS}
    stems = [[w for w in x.split() if w not in stop] or x.split() for x in words]
    size = np.array([len(s) for s in stems])
    end = np.searchsorted(block, block, "right")
    # Titles whose times may agree are neighbours: known times from the own up to 44 minutes later; unknown ones meet all.
    until = np.where(minute < 0, end, np.searchsorted(block * 10000 + minute, block * 10000 + minute + 44, "right"))

    def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (tid[i] != tid[j]) & ((right[i] < 0) | (right[i] != right[j]))

    # Shared stems: rows of one block and stem meet.
    row = np.repeat(np.arange(n), size)
    stem_id = np.unique(np.array([w for s in stems for w in s], object), return_inverse=True)[1] if len(row) else row
    order = np.lexsort((row, stem_id, block[row]))
    row, key = row[order], block[row[order]] * (int(stem_id.max(initial=0)) + 1) + stem_id[order]
    met = [np.zeros(0, np.int64)]
    for i, j in pair_ranges(np.arange(1, len(row) + 1), np.searchsorted(key, key, "right")):
        i, j = row[i], row[j]
        ok = (j < until[i]) & allowed(i, j)
        met.append(i[ok] * n + j[ok])
    met, both = np.unique(np.concatenate(met), return_counts=True)
    s, t = size[met // n], size[met % n]
    native = met[(both / (s + t - both) >= JACCARD) | (both == s) | (both == t)]

    # Ratios: bounds leave few pairs.
    asked = {}
    raw, late = Texts(low), Texts(words)
    for i, j in pair_ranges(np.arange(1, n + 1), until):
        ok = allowed(i, j)
        i, j = i[ok], j[ok]
        for texts, threshold, x in ((low, RAW_RATIO, (i, j)), (words, SORTED_RATIO, tuple(k[(size[i] > 0) & (size[j] > 0)] for k in (i, j)))):
            a, b = (raw if texts is low else late).near(*x, threshold)
            asked.setdefault(threshold, []).append(a * n + b)
    found = [native]
    for texts, threshold in ((low, RAW_RATIO), (words, SORTED_RATIO)):
        keys = np.setdiff1d(np.concatenate(asked.get(threshold, [native[:0]])), np.concatenate(found))
        i, j = keys // n, keys % n
        a, b = np.where(tid[i] < tid[j], i, j), np.where(tid[i] < tid[j], j, i)
        m, ok, last = SequenceMatcher(None), np.zeros(len(keys), bool), None
        for k in np.lexsort((a, b)):
            if b[k] != last:
                last = b[k]
                m.set_seq2(texts[last])
            m.set_seq1(texts[a[k]])
            ok[k] = m.ratio() >= threshold
        found.append(keys[ok])
    keys = np.concatenate(found)
    i, j = keys // n, keys % n
    return np.where(tid[i] < tid[j], i, j), np.where(tid[i] < tid[j], j, i)


def same_title_pairs(events: DataFrame, block: list[str], title: str, time: str, most: int = 2048, at_once: int = 4096) -> DataFrame:
    """Pairs of distinct (title, time) of a block whose different titles are duplicates (``same_title``): (*block, title_a, title_b), the smaller first.

    Blocks of more than ``most`` rows are split into parts by a hash, and each two parts meet in a unit of their own, so no block is one task's. Units pass
    through Python sorted, ``at_once`` rows or more together. Null blocks, and null titles, meet nothing.
    """
    rows = events.select(*block, F.col(title).alias("_title"), F.col(time).alias("_time")).dropna(subset=[*block, "_title"])
    parts = rows.groupBy(*block).agg(F.ceil(F.count("*") / most).cast("int").alias("_n"))
    k = F.pmod(F.xxhash64("_title", "_time"), F.col("_n")).cast("int")
    unit = lambda j: F.struct(F.least("_k", j).alias("i"), F.greatest("_k", j).alias("j"), F.when(j == F.col("_k"), -1).when(j < F.col("_k"), 1).otherwise(0).alias("side"))
    texts = {"_low": F.lower(F.trim("_title")), "_words": F.array_join(title_stems(F.col("_title"))["every"], " "), "_minute": F.coalesce(minute_of_day(F.col("_time")), F.lit(-1))}
    units = rows.join(parts, block).withColumns({"_k": k, **texts}).withColumn("_u", F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), unit)))
    block_cols = [f"_b{i}" for i in range(len(block))]
    units = units.select(*[F.col(c).alias(b) for c, b in zip(block, block_cols, strict=True)], "_u.*", "_title", "_time", "_low", "_words", "_minute")
    slots = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*block_cols, "i", "j"]
    ordered = units.repartition(slots, *by).sortWithinPartitions(*by)
    kinds = dict(events.select(*block).dtypes)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates([*by, "_title", "_time"])
        pdf = pdf.assign(_unit=pdf.groupby(by, sort=False).ngroup()).sort_values(["_unit", "_minute"], kind="stable", ignore_index=True)
        a, b = _same_titles(*(pdf[c].to_numpy() for c in ("_title", "_low", "_words", "_minute", "_unit", "side")))
        out = {c: pdf[k].to_numpy()[a] for c, k in zip(block, block_cols, strict=True)}
        return pd.DataFrame({**out, "title_a": pdf["_title"].to_numpy()[a], "title_b": pdf["_title"].to_numpy()[b]})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(meet, _whole(batches, by, at_once))

    return ordered.mapInPandas(walk, ", ".join([*[f"`{c}` {kinds[c]}" for c in block], "title_a string", "title_b string"]))


def place_similarity(query: Column, place: Column) -> Column:
    """Score 0..1 of two token arrays (see ``venue_tokens``): ordered early exits, native but for the last step."""
    q, p = F.array_distinct(query), F.array_distinct(place)
    generic = F.array(*[F.lit(w) for w in GENERIC_VENUE_WORDS])
    q_dist, p_dist = F.filter(query, lambda t: ~F.array_contains(generic, t)), F.filter(place, lambda t: ~F.array_contains(generic, t))
    meaning = lambda a: F.filter(a, lambda t: ~t.isin(GENERIC_VENUE_TERMS) & (F.length(t) > 2))
    qm, pm = meaning(q_dist), meaning(p_dist)
    inside = lambda a, b: (F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0)
    qs, ps = F.array_join(F.array_sort(query), " "), F.array_join(F.array_sort(place), " ")
    short = (F.size(place) == 1) & (F.length(F.element_at(place, 1)) <= 3)
    jaccard = F.size(F.array_intersect(q, p)) / F.size(F.array_union(q, p))
    inside_p, inside_q = inside(pm, q), inside(qm, p)
    initials, initials_dist = acronym(place), acronym(p_dist)
    by_initials, by_distinct = (F.length(initials) >= 3) & F.array_contains(q, initials), (F.length(initials_dist) >= 2) & F.array_contains(q, initials_dist)
    held = (F.size(place) >= 2) & qs.contains(ps)
    none = (F.size(query) == 0) | (F.size(place) == 0)
    # The Arrow functions get null for what the native tests decide.
    ask = ~F.coalesce(none | short | inside_p | inside_q | by_initials | by_distinct | (qs == ps) | held, F.lit(True))
    given = lambda c: F.when(ask, c)
    ratio, distinct = sequence_ratio(given(ps), given(qs)), shared_tokens(given(p_dist), given(q_dist), given(q))
    return (
        F.when(none, 0.0)
        .when(short, F.when(F.array_contains(q, F.element_at(place, 1)), 0.95).otherwise(0.0))
        .when(inside_p, 0.90 + 0.09 * F.size(pm) / F.size(place))
        .when(inside_q, 0.85 + 0.10 * F.size(qm) / F.greatest(F.size(pm), F.lit(1)))
        .when(by_initials, 0.92)
        .when(by_distinct, 0.88)
        .when(qs == ps, 0.95)
        .when(held, 0.86)
        .otherwise(F.greatest(jaccard, 0.80 * ratio, 0.85 * distinct))
    )


def resolve_by_text(events: DataFrame, key: str, tokens: Column, places: DataFrame, threshold: float = 0.75, area: str | None = None) -> DataFrame:
    """Best place for each event's tokens: (key, place_id, score). ``places``: (place_id, place_tokens, place_ord).

    Candidates share a token or an acronym; the first place in order wins ties. With ``area``, a column of both sides, they
    share it too, and the result is the best place for each (key, area), with that column.
    """
    block = [area] if area else []
    e = events.select(key, *block, tokens.alias("_q"))
    words = F.array_union(F.col("place_tokens"), F.array(acronym(F.col("place_tokens"))))
    e2, p2 = e.withColumn("_t", F.explode("_q")), places.withColumn("_t", F.explode(words)).where("_t <> ''")
    cand = e2.join(p2, ["_t", *block]).select(key, *block, "_q", "place_id", "place_tokens", "place_ord").dropDuplicates([key, *block, "place_id"])
    scored = cand.withColumn("score", place_similarity(F.col("_q"), F.col("place_tokens"))).where(F.col("score") >= threshold)
    w = W.partitionBy(key, *block).orderBy(F.col("score").desc(), "place_ord")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, *block, "place_id", "score")


def greedy_clusters(events: DataFrame, block: list[str], order: str, title: str, time: str) -> DataFrame:
    """Cluster the rows of each block in order: a row joins the first cluster that holds any duplicate, else starts one.

    Duplicates are found between distinct (title, time) pairs of a block by ``same_title``; only the edges go to
    the grouped function, which keeps one state a block. Adds ``cluster`` = the order value of its first row.
    """
    texts = cut(events.select(*block, F.col(title).alias("_t"), F.col(time).alias("_m")).distinct().withColumn("_s", title_stems(F.col("_t"))))
    a, b = texts.withColumnsRenamed({"_t": "_ta", "_m": "_ma", "_s": "_sa"}), texts.withColumnsRenamed({"_t": "_tb", "_m": "_mb", "_s": "_sb"})
    edges = a.join(b, block).where(same_title(F.col("_ta"), F.col("_tb"), F.col("_ma"), F.col("_mb"), F.col("_sa"), F.col("_sb")))
    edges = edges.groupBy(*block, F.col("_ta").alias("_t"), F.col("_ma").alias("_m")).agg(F.collect_set(F.struct("_tb", "_mb")).alias("_like"))
    rows = events.select(*block, F.col(order).alias("_o"), F.col(title).alias("_t"), F.col(time).alias("_m"))
    same = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in block]
    e = edges.withColumnsRenamed({**{c: f"_r{c}" for c in block}, "_t": "_rt", "_m": "_rm"})
    cond = F.col("_t").eqNullSafe(F.col("_rt")) & F.col("_m").eqNullSafe(F.col("_rm"))
    for s in same:
        cond = cond & s
    with_edges = rows.join(e, cond, "left").select(*block, "_o", "_t", "_m", "_like")
    kinds = dict(events.dtypes)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, first = None, [], []
        for pdf in batches:
            out = []
            for o, t, m, like, *at in pdf[["_o", "_t", "_m", "_like", *block_cols]].itertuples(index=False):
                if at != block:
                    block, held, first = at, [], []
                keys = {(x["_tb"], x["_mb"]) for x in like} if like is not None else set()
                i = next((i for i, h in enumerate(held) if not keys.isdisjoint(h)), None) if keys else None
                if i is None:
                    held.append(set())
                    first.append(o)
                    i = len(held) - 1
                held[i].add((t, m))
                out.append((o, first[i]))
            yield pd.DataFrame(out, columns=["_o", "cluster"])

    # Blocks are many and small: they pass through Python sorted, one after the other, not one call each.
    block_cols = [f"_b{i}" for i in range(len(block))]
    keyed = with_edges.select("_o", "_t", "_m", "_like", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(k) for c, k in zip(block, block_cols, strict=True)])
    slots = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartition(slots, *block_cols).sortWithinPartitions(*block_cols, "_o")
    got = ordered.mapInPandas(walk, f"_o {kinds[order]}, cluster {kinds[order]}")
    return events.join(got, F.col(order) == F.col("_o"), "left").drop("_o")


def merge_records(events: DataFrame, group: str, order: str, longest: list[str], first: list[str], prefer: dict[str, Column] | None = None, together: tuple[Column, list[str]] | None = None) -> DataFrame:
    """One record a group, field by field: the longest text of some columns, the first non-empty value of others.

    ``together``: a test and columns that are taken from one row, the first that passes, else the first row. ``prefer``: for a column, a test whose passing values come first, the last of them winning (thumbnails). Ties go to the
    first row in order. Aggregation only, so a group with a third of all rows is combined before the shuffle.
    """
    picks = []
    for c in longest:
        n = F.length(F.coalesce(F.col(c), F.lit("")))
        picks.append(F.min(F.struct((-n).alias("n"), F.col(order).alias("o"), F.col(c).alias("v")))["v"].alias(c))
    for c in first:
        told = F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
        plain = F.min(F.when(told, F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"]
        if prefer and c in prefer:
            liked = F.max(F.when(told & prefer[c], F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"]
            plain = F.coalesce(liked, plain)
        picks.append(plain.alias(c))
    if together:
        test, columns = together
        row = F.min(F.struct(F.when(F.coalesce(test, F.lit(False)), 0).otherwise(1).alias("t"), F.col(order).alias("o"), *[F.col(c) for c in columns]))
        picks += [row[c].alias(c) for c in columns]
    return events.groupBy(group).agg(F.count("*").alias("n_rows"), *picks)


def unique_slugs(events: DataFrame, base: str, date: str, time: str, order: str) -> DataFrame:
    """Slugs 'base-date', then with '-HHMM', then '-2', '-3'...: unique whatever the order of tasks; adds ``slug``.

    Of the rows of a (base, date) the first takes the plain slug; of the others the first of each time takes the time's; the rest are counted on.
    """
    # The firsts come from aggregation; only the rest is ranked, over range partitions, so a (base, date) of many rows is no single task's.
    t = F.regexp_replace(F.coalesce(F.col(time), F.lit("")), ":", "")
    step = events.withColumns({"_k": F.struct(F.col(base).alias("b"), F.col(date).alias("d")), "_t": t})
    first = step.groupBy("_k").agg(F.min(order).alias("_f")).withColumnRenamed("_k", "_k1")
    step = step.join(first, F.col("_k").eqNullSafe(F.col("_k1"))).drop("_k1")
    late = (F.col(order) != F.col("_f")) & (F.col("_t") != "")
    timed = step.where(late).groupBy(F.col("_k").alias("_k2"), F.col("_t").alias("_t2")).agg(F.min(order).alias("_ft"))
    step = step.join(timed, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_t") == F.col("_t2")), "left").drop("_k2", "_t2")
    step = cut(step.withColumn("_w", F.when(F.col(order) == F.col("_f"), 0).when(late & (F.col(order) == F.col("_ft")), 1).otherwise(2)))
    plain = F.concat_ws("-", F.col(base), F.col(date))
    named = step.where("_w < 2").withColumn("slug", F.when(F.col("_w") == 0, plain).otherwise(F.concat_ws("-", plain, F.col("_t"))))
    rest = positions(step.where("_w = 2"), "_k", order, name="_n").withColumn("slug", F.concat_ws("-", plain, (F.col("_n") + 1).cast("string"))).drop("_n")
    return named.unionByName(rest).drop("_k", "_t", "_f", "_ft", "_w")


def _meet_targets(block: np.ndarray, new: np.ndarray, key: np.ndarray, url: np.ndarray, threshold: float, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Action and row number of the target of each new row; rows are sorted by block, old before new, then in order.

    The new rows of each block go in chunks: bounds of the ratios to all targets so far, and to the rows before them in the chunk, are taken at once; what passes is decided row by row.
    """
    n = len(key)
    texts, some = Texts(key), np.array([k != "" for k in key], bool)
    action, target, is_target = np.full(n, None, object), np.arange(n), ~new & some
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    left = []  # of each block: end, targets, next new row, links
    for a, b in zip(first, np.r_[first[1:], n]):
        if new[b - 1]:
            at = a + int(np.searchsorted(new[a:b], True))
            left.append((int(b), np.arange(a, at)[some[a:at]], at, {}))
    matcher = SequenceMatcher(None)
    while left:
        rows, starts, ends, among, n_among = [], [], [], [], 0
        for b, known, at, _ in left:
            r = np.arange(at, min(at + chunk, b))
            among += [known, r]
            rows.append(r)
            starts.append(np.full(len(r), n_among))
            ends.append(np.where(some[r], n_among + len(known) + np.arange(len(r)), n_among))
            n_among += len(known) + len(r)
        row, among = np.concatenate(rows), np.concatenate(among)
        near = [texts.near(row[i], among[j], threshold, held=True) for i, j in pair_ranges(np.concatenate(starts), np.concatenate(ends))]
        asked, other = (np.concatenate([np.zeros(0, np.int64), *[x[k] for x in near]]) for k in (0, 1))
        lo, hi = np.searchsorted(asked, row), np.searchsorted(asked, row, "right")
        rest, p = [], 0
        for (b, known, at, links), r in zip(left, rows, strict=True):
            added = []
            for i in r.tolist():
                k, u = key[i], url[i]
                found = links.get(u) if u is not None else None
                if found is not None:
                    action[i], target[i] = "update", found
                else:
                    for j in other[lo[p] : hi[p]].tolist():
                        if is_target[j]:
                            x = key[j]
                            if x in k or k in x:
                                found = j
                                break
                            matcher.set_seqs(k, x)
                            if matcher.ratio() >= threshold:
                                found = j
                                break
                    if found is None:
                        action[i], is_target[i] = "insert", some[i]
                        links[u] = i
                        if some[i]:
                            added.append(i)
                    else:
                        action[i], target[i] = "merge", found
                p += 1
            if at + chunk < b:
                rest.append((b, np.r_[known, np.array(added, np.int64)], at + chunk, links))
        left = rest
    return action, target


def fuzzy_upsert(stored: DataFrame, batch: DataFrame, block: list[str], order: str, key: str, url: str, threshold: float = 0.65, chunk: int = 256, at_once: int = 4096) -> DataFrame:
    """Where each incoming row goes: (ord, action 'update', 'merge' or 'insert', target).

    Rows whose link is stored update it. Others merge with the first row of their block whose title key is equal,
    contained or similar; rows inserted earlier in the batch are targets too. An empty title key
    never merges (contained in everything otherwise). ``stored`` and ``batch`` share columns and one order. Blocks pass through Python
    ``at_once`` rows or more together, their rows in chunks.
    """
    cols = [*block, order, key, url]
    known = first_by(stored.select(url, F.col(order).alias("_target")).where(F.col(url).isNotNull()), [url], "_target")
    hit = batch.select(*cols).join(known, url, "left")
    updates = hit.where("_target is not null").select(F.col(order).alias("ord"), F.lit("update").alias("action"), F.col("_target").alias("target"))
    fresh = hit.where("_target is null").select(*cols).withColumn("_new", F.lit(True))
    both = stored.select(*cols).withColumn("_new", F.lit(False)).unionByName(fresh)
    kind = dict(stored.dtypes)[order]
    block_cols = [f"_b{i}" for i in range(len(block))]
    both = both.select(F.col(order).alias("_o"), F.coalesce(key, F.lit("")).alias("_k"), F.col(url).alias("_u"), "_new", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(k) for c, k in zip(block, block_cols, strict=True)])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = pdf.groupby(block_cols, sort=False).ngroup().to_numpy()
        new, o = pdf["_new"].to_numpy(bool), pdf["_o"].to_numpy()
        action, target = _meet_targets(unit, new, pdf["_k"].to_numpy(), pdf["_u"].to_numpy(), threshold, chunk)
        return pd.DataFrame({"ord": o[new], "action": action[new], "target": o[target[new]]})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(meet, _whole(batches, block_cols, at_once))

    slots = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(slots, *block_cols).sortWithinPartitions(*block_cols, "_new", "_o")
    return updates.unionByName(ordered.mapInPandas(walk, f"ord {kind}, action string, target {kind}"))
