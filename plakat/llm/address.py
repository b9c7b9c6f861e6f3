"""Same postal address written differently: MinHash banding, then affine-gap token alignment with abbreviation costs."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plakat.llm.lookalike import skeleton
from plakat.runtime import cut

# Words of Polish street addresses.
KINDS = {"ul": "ul", "ulica": "ul", "ulicy": "ul", "al": "al", "aleja": "al", "aleje": "al", "alei": "al", "pl": "pl", "plac": "pl", "placu": "pl", "os": "os", "osiedle": "os", "osiedlu": "os", "rynek": "rynek", "skwer": "skwer", "bulwar": "bulwar", "bulw": "bulwar", "rondo": "rondo"}
TITLES = {"gen", "generala", "dr", "doktora", "prof", "profesora", "ks", "ksiedza", "kard", "bp", "sw", "swietej", "swietego", "mjr", "majora", "plk", "pulkownika", "kpt", "kapitana", "por", "marsz", "marszalka", "inz", "im", "imienia", "hr", "o"}
#: Abbreviation dictionary for alignment: short form to the beginnings of long ones.
ABBREVIATIONS = {"gen": "general", "dr": "doktor", "prof": "profesor", "ks": "ksi", "kard": "kardynal", "sw": "swiet", "mjr": "major", "plk": "pulkownik", "kpt": "kapitan", "marsz": "marszal", "inz": "inzynier", "st": "star", "now": "now", "wlk": "wielk", "ml": "mal", "woj": "wojsk"}
GAP_OPEN, GAP_EXTEND, ACCEPT = 0.35, 0.3, 0.65
#: Bands of the MinHash signatures of the streets of one town. Writings that share four tenths of their shingles (a short word with a slip) meet with probability 0.9998,
#: unlike ones (a twentieth) with 0.12.
BANDS, ROWS = 50, 2
#: Members of one building that one task pairs with the others.
PAIR_ROWS = 5_000

_NUMBER = r"(?:\b(?:nr|numer)\.?\s*)?\b(\d{1,6})\s?(?:([a-ln-z]|m(?!\s*\.?\s*\d))(?![\w.]))?(?:\s*(?:/|\bm\b\.?|\blok\b\.?|\bmieszk\w*\.?)\s*\d+\w?)?"
_TRAILING = re.compile(_NUMBER + r"\s*$")
_POSTCODE = re.compile(r"\b(\d{2})\s*-\s*(\d{3})\b|\b(\d{5})\b")
_KIND = re.compile(r"(?:^|(?<=[\s,]))(ulica|ulicy|ul|aleja|aleje|alei|al|plac|placu|pl|osiedle|osiedlu|os)(?:\.\s*|\s+)(?=\S)")


@lru_cache(maxsize=50_000)
def fold(text: str) -> str:
    """Lower case, plain Latin letters, single spaces."""
    if not text.isascii():
        text = skeleton(text)
    text = unicodedata.normalize("NFKD", text.lower().replace("ł", "l"))
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).split())


def split_number(text: str) -> tuple[str, str, str]:
    """(rest, number, letter) of a street line; flats are dropped, the number is empty if there is none at the end."""
    m = _TRAILING.search(text)
    if not m:
        return text.strip(" ,"), "", ""
    return text[: m.start()].strip(" ,"), str(int(m[1])), m[2] or ""


def street_words(text: str) -> tuple[str, str]:
    """(kind, words) of a street; titles and dots go, initials stay."""
    kind = ""
    out = []
    for w in re.findall(r"[a-z0-9]+", text):
        if w in KINDS and not kind and not out:
            kind = KINDS[w]
        elif w not in TITLES or len(w) == 1 and w != "o":
            out.append(w)
    return kind, " ".join(out)


def _forms(word: str) -> list[str]:
    """The word and its forms with one letter left out; short words only themselves."""
    return [word] + ([word[:i] + word[i + 1 :] for i in range(len(word))] if len(word) > 4 else [])


def parse_line(text: str, towns: frozenset[str]) -> dict[str, str]:
    """Parts of an address in one line: town, postcode, street, number, letter; missing ones are empty."""
    s = fold(text)
    out = {"town": "", "postcode": "", "street": "", "number": "", "letter": ""}
    m = _POSTCODE.search(s)
    if m:
        out["postcode"] = m[3] or m[1] + m[2]
        after = s[m.end() :].split(",")[0].strip()
        if after and not any(c.isdigit() for c in after) and not _KIND.search(" " + after + " x"):
            out["town"] = after
            s = s[: m.start()] + "," + s[m.end() :].strip()[len(after) :]
        else:
            s = s[: m.start()] + "," + s[m.end() :]
    parts = [p.strip() for p in s.split(",") if p.strip()]
    for i in range(len(parts) - 1, -1, -1):
        rest, number, letter = split_number(parts[i])
        if number:
            if not rest and i:
                rest = parts.pop(i - 1)
                i -= 1
            out.update(street=rest, number=number, letter=letter)
            parts.pop(i)
            break
    if not out["street"] and parts:
        at = next((i for i, p in enumerate(parts) if _KIND.search(p + " x")), None)
        if at is not None:
            out["street"] = parts.pop(at)
    street = out["street"]
    k = _KIND.search(street)
    if k and k.start() > 0:
        parts.insert(0, street[: k.start()].strip(" ,"))
        out["street"] = street[k.start() :]
    elif not k and street:
        ws = street.split(" ")
        for n in (3, 2, 1):
            if len(ws) > n and " ".join(ws[:n]) in towns:
                parts.insert(0, " ".join(ws[:n]))
                out["street"] = " ".join(ws[n:])
                break
    if not out["town"] and parts:
        out["town"] = next((p for p in parts if p in towns), parts[0])
    return out


def parse_address(kind: str, street: str | None, number: str | None, city: str | None, postcode: str | None, line: str | None, towns: frozenset[str]) -> dict[str, str]:
    """Parts of a structured address or of a line (text, or a JSON object with the same fields)."""
    if kind == "event":
        text = (line or "").strip()
        if text.startswith("{"):
            try:
                o = json.loads(text)
                get = lambda *names: next((str(o[n]) for n in names if o.get(n) not in (None, "")), "")
                street, number, postcode = get("street", "road", "name"), get("housenumber", "house_number", "number"), get("postcode", "zip")
                city = get("city", "town") or city
            except (ValueError, AttributeError):
                return parse_line(text, towns)
        else:
            out = parse_line(text, towns)
            if city and city.strip():
                out["town"] = fold(city)
            return out
    s = fold(street or "")
    rest, n, letter = split_number(fold(number or ""))
    if not n:
        line_parts = parse_line(s, towns) if s else {}
        if line_parts.get("number"):
            s, n, letter = line_parts["street"], line_parts["number"], line_parts["letter"]
            city = city if city and city.strip() else line_parts["town"]
            postcode = postcode or line_parts["postcode"]
        if rest and not s:  # the street stands in the number's field
            s = rest
    elif rest and rest not in ("nr", "numer") and not s:
        s = rest
    pc = re.sub(r"\D", "", postcode or "")
    return {"town": fold(city or ""), "postcode": pc if len(pc) == 5 else "", "street": s, "number": n, "letter": letter}


# Alignment ------------------------------------------------------------------------------------------


def _close(a: str, b: str) -> bool:
    """At most one slip: a letter changed, missing, doubled, or two neighbours exchanged."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[2:] == y[2:] and x[:2] == y[1::-1])


def _substitution(a: str, b: str) -> float:
    if a == b:
        return 0.0
    short, long = (a, b) if len(a) < len(b) else (b, a)
    if len(short) == 1:
        return 0.1 if long[0] == short else 9.0
    if short in ABBREVIATIONS and long.startswith(ABBREVIATIONS[short]):
        return 0.05
    if len(long) >= 3 and _close(a, b):
        return 0.25
    return 9.0


def align(a: list[str], b: list[str]) -> float:
    """Least cost of aligning two token lists with affine gaps, row by row."""
    inf = 99.0
    weight = lambda w: 0.3 if len(w) == 1 else 1.0
    skip = [weight(w) for w in b]
    m = len(b)
    both, up, left = [0.0] + [inf] * m, [inf] * (m + 1), [inf] * (m + 1)  # last step: both tokens, a's alone, b's alone
    for j in range(m):
        left[j + 1] = min(min(both[j], up[j]) + GAP_OPEN * skip[j], left[j] + GAP_EXTEND * skip[j])
    for w in a:
        g = weight(w)
        new_both, new_up, new_left = [inf] * (m + 1), [inf] * (m + 1), [inf] * (m + 1)
        for j in range(m + 1):
            new_up[j] = min(min(both[j], left[j]) + GAP_OPEN * g, up[j] + GAP_EXTEND * g)
            if j:
                new_both[j] = min(both[j - 1], up[j - 1], left[j - 1]) + _substitution(w, b[j - 1])
                new_left[j] = min(min(new_both[j - 1], new_up[j - 1]) + GAP_OPEN * skip[j - 1], new_left[j - 1] + GAP_EXTEND * skip[j - 1])
        both, up, left = new_both, new_up, new_left
    return min(both[m], up[m], left[m])


@lru_cache(maxsize=200_000)
def same_street(kind_a: str, a: str, kind_b: str, b: str) -> bool:
    """Do two streets read alike? Kinds must not contradict, and some whole word must have a partner."""
    if kind_a and kind_b and kind_a != kind_b:
        return False
    x, y = a.split(" "), b.split(" ")
    if len(x) > len(y):
        x, y = y, x
    if not any(_substitution(v, w) < 1 for v in x if len(v) > 2 for w in y if len(w) > 2):
        return False
    if align(x, y) <= ACCEPT:
        return True
    # Parts in another order: turns that begin with a partner of the other's first word.
    return any(align(x[i:] + x[:i], y) <= ACCEPT for i in range(1, len(x)) if any(_substitution(x[i], w) < 1 for w in y[:2]))


# MinHash --------------------------------------------------------------------------------------------

_SEEDS = np.random.default_rng(7).integers(1, 2**61 - 1, (2, BANDS * ROWS), dtype=np.uint64)


def _shingles(text: str) -> set[str]:
    out = set()
    for w in text.split(" "):
        if len(w) > 1:
            out.add(w)
            p = f"^{w}$"
            out.update(p[i : i + 2] for i in range(len(p) - 1))
            if len(w) > 3:
                out.add("=" + "".join(sorted(w)))  # the same for exchanged letters
    return out or {text}


@lru_cache(maxsize=200_000)
def _hash(shingle: str) -> int:
    h = 1469598103934665603
    for c in shingle.encode():
        h = ((h ^ c) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


@lru_cache(maxsize=100_000)
def bands(text: str) -> tuple[int, ...]:
    """One hash a band of the text's MinHash signature over words and pairs of letters."""
    h = np.array([_hash(s) for s in _shingles(text)], np.uint64)
    with np.errstate(over="ignore"):
        mixed = h[:, None] * (_SEEDS[0] | np.uint64(1)) + _SEEDS[1]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        out = np.arange(BANDS, dtype=np.uint64)
        for row in mixed.min(axis=0).reshape(BANDS, ROWS).T:
            out = out * np.uint64(31) + row
    return tuple(int(x) for x in out.astype(np.int64))


# The operator ---------------------------------------------------------------------------------------

_FORM = ["town", "number", "letter", "kind", "street"]


def parsed(rows: DataFrame, towns: frozenset[str]) -> DataFrame:
    """Parse rows (key, side, area, street, housenumber, city, postcode, line) to (key, side, area, town, postcode, number, letter, kind, street)."""
    shared = rows.sparkSession.sparkContext.broadcast(towns)  # names of a country's towns: some 100,000 at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        slips: dict[str, str] = {}
        for t in sorted(known):
            for form in _forms(t):
                slips[form] = "" if form in slips and slips[form] != t else t
        for pdf in batches:
            out = []
            for key, side, area, st, hn, ci, pc, line in pdf.itertuples(index=False):
                p = parse_address(side, st, hn, ci, pc, line, known)
                if p["town"] and p["town"] not in known:
                    p["town"] = next((slips[f] for f in _forms(p["town"]) if slips.get(f) and _close(slips[f], p["town"])), p["town"])
                kind, words = street_words(p["street"])
                if words and p["number"]:
                    out.append((key, side, fold(area or "").replace("-", "_").replace(" ", "_"), p["town"], p["postcode"], p["number"], p["letter"], kind, words))
            yield pd.DataFrame(out, columns=["key", "side", "area", "town", "postcode", "number", "letter", "kind", "street"])

    return rows.select("key", "side", "area", "street", "housenumber", "city", "postcode", "line").mapInPandas(run, "key string, side string, area string, town string, postcode string, number string, letter string, kind string, street string")


def _banded(forms: DataFrame) -> DataFrame:
    schema = ", ".join(f"`{c}` {t}" for c, t in forms.dtypes) + ", band array<bigint>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(band=[list(bands(s)) for s in pdf["street"]])

    return forms.mapInPandas(run, schema).withColumn("band", F.explode("band"))


def _verified(pairs: DataFrame) -> DataFrame:
    """Keep candidate pairs whose streets (kind_a, street_a, kind_b, street_b) align."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [same_street(*x) for x in zip(pdf["kind_a"], pdf["street_a"], pdf["kind_b"], pdf["street_b"], strict=True)]
            yield pdf[np.array(ok, bool)]

    return pairs.mapInPandas(run, pairs.schema)


def _components(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Smallest street writing of each group of linked writings; rows arrive sorted by block, and only one block is held at a time."""
    root: dict[tuple[str, str], tuple[str, str]] = {}
    block = None

    def find(x: tuple[str, str]) -> tuple[str, str]:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def done() -> list[tuple]:
        return [(*block, k, s, " ".join(find((k, s))).strip()) for k, s in list(root)]

    for pdf in batches:
        out: list[tuple] = []
        for *at, ka, sa, kb, sb in pdf[["town", "number", "letter", "kind_a", "street_a", "kind_b", "street_b"]].itertuples(index=False):
            if at != block:
                if root:
                    out += done()
                    root.clear()
                block = at
            x, y = find((ka, sa)), find((kb, sb))
            if x != y:
                root[max(x, y)] = min(x, y)
        yield pd.DataFrame(out, columns=[*_FORM, "building"])
    if root:
        yield pd.DataFrame(done(), columns=[*_FORM, "building"])


def _like(a: DataFrame, b: DataFrame, block: list[str]) -> DataFrame:
    """Pairs of streets (kind, street) of one block that read alike: (block, kind_a, street_a, kind_b, street_b); of a frame with itself each pair once, the smaller first."""
    left = _banded(a).withColumnsRenamed({c: f"{c}_a" for c in a.columns if c not in block})
    right = _banded(b).withColumnsRenamed({c: f"{c}_b" for c in b.columns if c not in block})
    return _verified(left.join(right, [*block, "band"]).drop("band").where(F.struct("kind_a", "street_a") < F.struct("kind_b", "street_b") if a is b else F.lit(True)).distinct())


def buildings(rows: DataFrame) -> DataFrame:
    """Assign addresses to buildings: (key, side, town, number, letter, building).

    ``rows``: (key, side 'place' or 'event', area, street, housenumber, city, postcode, line).
    Same town, number and letter (exact after parsing), and streets that read alike. Streets are compared once a town, whatever the number of addresses in them: distinct
    writings meet by MinHash bands over words and pairs of letters and are verified by alignment; then the addresses
    of a town, number and letter whose streets are alike are linked, and links are closed inside that block. Towns are those the data names
    most often with each postcode (five digits: 100,000 at most), up to one slip.
    A missing town is taken from the postcode, else from the single
    town of the same area that has the same street and number. Addresses without street or number
    (null, blank or unreadable) denote no building and are dropped. Repeated rows stay.
    """
    code = F.regexp_replace("postcode", r"\D", "")
    named = rows.where(F.trim("city") != "").select(code.alias("code"), F.trim(F.lower("city")).alias("city")).where(F.length("code") == 5).groupBy("code", "city").count()
    by_code = cut(named.groupBy("code").agg(F.max_by("city", F.struct("count", "city")).alias("city")))
    codes = {r[0]: fold(r[1]) for r in by_code.toLocalIterator()}
    towns = frozenset(codes.values())
    base = parsed(rows, towns)
    spark = rows.sparkSession
    by_code = spark.createDataFrame(sorted(codes.items()), "postcode string, code_town string")
    known = spark.createDataFrame([(t,) for t in sorted(towns)], "town string").withColumn("sure", F.lit(True))
    base = base.join(by_code, "postcode", "left").join(known, "town", "left")
    # A name that isn't a town of the gazetteer is a slip or a part of the street: the postcode is better, if there is one.
    town = F.when(F.col("sure"), F.col("town")).otherwise(F.coalesce("code_town", "town"))
    base = cut(base.select("key", "side", "area", town.alias("town"), "number", "letter", "kind", "street"))

    lone = base.where("town = ''").select("area", "number", "letter", "kind", "street").distinct()
    full = base.where("town <> ''").select("area", "town", "number", "letter", "kind", "street").distinct()
    near = _like(lone.select("area", "kind", "street").distinct(), full.select("area", "kind", "street").distinct(), ["area"])
    near = near.withColumnsRenamed({"kind_a": "kind", "street_a": "street"}).join(lone, ["area", "kind", "street"])
    near = near.join(full.withColumnsRenamed({"kind": "kind_b", "street": "street_b"}), ["area", "number", "letter", "kind_b", "street_b"])
    guess = near.groupBy("area", "number", "letter", "kind", "street").agg(F.countDistinct("town").alias("n"), F.first("town").alias("guess")).where("n = 1").drop("n")
    guess = guess.withColumn("town", F.lit(""))
    rows2 = cut(base.join(guess, ["area", "town", "number", "letter", "kind", "street"], "left").withColumn("town", F.coalesce("guess", F.when(F.col("town") != "", F.col("town")), F.concat(F.lit("?"), F.col("key")))).drop("guess", "area"))

    forms = rows2.select(*_FORM).distinct()
    streets = forms.where("town not like '?%'").select("town", "kind", "street").distinct()
    alike = cut(_like(streets, streets, ["town"]))
    pairs = alike.join(forms.withColumnsRenamed({"kind": "kind_a", "street": "street_a"}), ["town", "kind_a", "street_a"])
    pairs = pairs.join(forms.withColumnsRenamed({"kind": "kind_b", "street": "street_b"}), ["town", "number", "letter", "kind_b", "street_b"])
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    linked = pairs.repartition(slots, "town", "number", "letter").sortWithinPartitions("town", "number", "letter")
    linked = linked.mapInPandas(_components, "town string, number string, letter string, kind string, street string, building string")
    out = rows2.join(linked, _FORM, "left")
    return out.select("key", "side", "town", "number", "letter", F.coalesce("building", F.trim(F.concat_ws(" ", "kind", "street"))).alias("building"))


_SPOT = ["town", "number", "letter", "building"]


def with_links(members: DataFrame) -> DataFrame:
    """Each address with its class, the building, and its number of links: places link to all others of the building, events to its places."""
    n = members.groupBy(*_SPOT).agg(F.count_distinct(F.when(F.col("side") == "place", F.col("key"))).alias("p"), F.count_distinct(F.when(F.col("side") != "place", F.col("key"))).alias("e"))
    links = F.when(F.col("side") == "place", F.col("p") - 1 + F.col("e")).otherwise(F.col("p"))
    return members.join(n, _SPOT).select(*members.columns, links.alias("links"))


def same_building_pairs(members: DataFrame, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Pairs (key_a < key_b) of two places, or a place and an event, in one building; each once.

    A building with more than ``pair_rows`` members is paired by several tasks: its places are split by hash, and each part meets all members.
    """
    m = members.select(*_SPOT, "key", "side").distinct()
    hot = m.groupBy(*_SPOT).agg(F.ceil(F.count("*") / pair_rows).cast("int").alias("parts")).where("parts > 1")
    m = m.join(hot, _SPOT, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = m.where("side = 'place'").select(*_SPOT, F.col("key").alias("k1"), F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    b = m.select(*_SPOT, F.col("key").alias("k2"), F.col("side").alias("s2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = a.join(b, [*_SPOT, "part"]).where((F.col("s2") == "event") | (F.col("k1") < F.col("k2")))
    return pairs.select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b"))
