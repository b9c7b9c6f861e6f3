"""Ordered rules: first matching row of a table decides. One builder serves all classifiers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plakat.functions.text import contains_any


def first_match(rules: Iterable[tuple[Column, Column | str | None]], default: Column | str | None = None) -> Column:
    """CASE WHEN of (condition, value) in order; text values are literals."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = None
    for cond, value in rules:
        out = F.when(cond, lit(value)) if out is None else out.when(cond, lit(value))
    return lit(default) if out is None else out.otherwise(lit(default))


def by_words(text: Column, table: Sequence[tuple[Sequence[str], str]], default: str | None = None) -> Column:
    """Value of the first row one of whose words the text holds (lower case, substring)."""
    return first_match([(contains_any(text, list(words)), value) for words, value in table], default)


def by_value(c: Column, table: Mapping[str, str], default: Column | str | None = None) -> Column:
    """Value of an exact key (lower case) in a small literal table."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(c)), d) if pairs else d


def flags(text: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """Names of the rows one of whose patterns matches: array in table order; [] for null text."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.lower(text).rlike("(?U)" + "|".join(f"(?:{p})" for p in ps)), F.lit(False)), F.lit(name)) for name, ps in table.items()]))


def rule_join(rows: DataFrame, key: str, text: Column, rules: DataFrame, extra: str | None = None) -> DataFrame:
    """First rule whose word the text holds: (key, rule_ord, target).

    ``rules``: (word, rule_ord, target), and with ``extra`` a column of the rows that must equal the rule's column
    of that name. The rule table is configuration; it is broadcast only if Spark finds it small.
    """
    left = rows.select(key, text.alias("_text"), *([extra] if extra else [])).where("_text is not null")
    # Each distinct text meets the rules once, however many rows have it.
    texts = left.select(*[c for c in left.columns if c != key]).distinct()
    cond = F.lower("_text").contains(F.lower("word"))
    r = rules.withColumnRenamed(extra, "_rx") if extra else rules
    if extra:
        cond = (F.col(extra) == F.col("_rx")) & cond
    hit = texts.join(r, cond).groupBy(*texts.columns).agg(F.min(F.struct("rule_ord", "target")).alias("_m"))
    return left.join(hit, texts.columns).select(key, F.col("_m.rule_ord").alias("rule_ord"), F.col("_m.target").alias("target"))


def pick_candidate(text: Column, words: Sequence[str], town: Column, sep: str = "|", least: int = 3, most: int = 60) -> Column:
    """Venue among separated parts of a card: the first fitting part with a preferred word, else the first fitting part, else the town."""
    parts = F.filter(F.transform(F.split(text, f"[{sep}]"), lambda x: F.trim(x)), lambda p: (F.length(p) >= least) & (F.length(p) <= most) & ~p.rlike(r"\d{1,2}[:.]\d{2}|\d{4}|zł"))
    good = F.filter(parts, lambda p: contains_any(p, list(words)))
    return F.coalesce(F.get(good, F.lit(0)), F.get(parts, F.lit(0)), town)


def access(*levels: Column) -> Column:
    """Tri-state access: the first known level of texts or booleans given as text; 'yes', 'limited', 'no' or null."""
    clean = [F.when(F.lower(x).isin("yes", "true", "tak", "dostępny"), "yes").when(F.lower(x) == "limited", "limited").when(F.lower(x).isin("no", "false", "brak", "nie"), "no") for x in levels]
    return F.coalesce(*clean)


def parking_note(distance_m: Column, paid: Column) -> Column:
    """Sentence about the nearest car park; a default without one."""
    fee = F.when(paid, "płatny").when(~paid, "bezpłatny").otherwise("brak danych o opłatach")
    return F.when(distance_m.isNull(), "Parking w okolicy obiektu").otherwise(F.concat(F.lit("Parking "), distance_m.cast("int").cast("string"), F.lit(" m ("), fee, F.lit(")")))


def parking_text(detail: Column, nearest: Column) -> Column:
    """Parking sentence of a page: struct(fee_label, distance_m, street) of the best known car park, else struct(distance_m, is_fee) of the nearest, else a general one."""
    m = lambda c: c["distance_m"].cast("int").cast("string")
    told = F.concat(F.coalesce(detail["fee_label"], F.lit("Parking")), F.lit(" ("), m(detail), F.lit("m, ul. "), F.coalesce(detail["street"], F.lit("w pobliżu")), F.lit(")"))
    near = F.concat(F.when(nearest["is_fee"], "Płatny parking").otherwise("Bezpłatny parking"), F.lit(" (~"), m(nearest), F.lit("m)"))
    return F.when(detail.isNotNull(), told).when(nearest.isNotNull(), near).otherwise("Dostępny w strefie miejskiej")


def lookup(key: Column, table: Mapping[str, Mapping[str, object]], default: Mapping[str, object]) -> Column:
    """Struct of a table's row by a lower-case key; the default's values for unknown and null keys."""
    k = F.lower(key)
    return F.struct(*[first_match([(F.coalesce(k == name, F.lit(False)), F.lit(row.get(c, d))) for name, row in table.items()], F.lit(d)).alias(c) for c, d in default.items()])


def known_venue(text: Column, table: Sequence[tuple[Sequence[str], Mapping[str, str]]]) -> Column:
    """Struct of the first row one of whose words the text holds; nulls without any."""
    fields = list(table[0][1])
    return F.struct(*[first_match([(contains_any(text, list(words)), row[c]) for words, row in table]).alias(c) for c in fields])


# Age limits and sensory warnings by patterns of whole words.
AGE_LIMITS = [(r"tylko\s+dla\s+dorosłych|od\s+18\s*lat", "18+"), (r"od\s+16\s*lat|dla\s+widzów\s+od\s+16", "16+"), (r"dla\s+dzieci|spektakl\s+familijny", "Dla dzieci")]
SENSORY = {
    "światła stroboskopowe": [r"\b(?:stroboskop(?:y|owe)?|światł[ao]\s+stroboskop)\b"], "dym sceniczny": [r"\b(?:używane\s+są\s+dymy|efekty\s+dymne)\b"], "dosadny język": [r"\b(?:wulgaryzm(?:y)?|wulgarny\s+język)\b"],
    "efekty hukowe / wystrzały": [r"\b(?:wystrzał(?:y)?|efekty\s+hukowe)\b"],
}


def age_limit(text: Column) -> Column:
    """Age limit that a text names, the strictest first; null without any."""
    return first_match([(F.coalesce(text.rlike(rf"(?iU)\b(?:{p})\b"), F.lit(False)), v) for p, v in AGE_LIMITS])


# Event categories by words of the title, for rows whose own category is general.
TITLE_CATEGORIES = [
    (["turniej", "sport", "bieg", "triathlon", "siatków", "orlik", "parkrun", "spływ", "rolk"], "Sport i Rekreacja"),
    (["kino", "film"], "Kino"),
    (["koncert", "muzyka", "cover", "dj", "festiwal", "fado"], "Koncert"),
    (["bibliotek", "książk", "dzieci", "półkolonia", "lekcje", "bajk"], "Dla Dzieci"),
]


def title_category(category: Column, title: Column, general: Sequence[str]) -> Column:
    """A more telling category for rows of a general one; others keep theirs."""
    return F.when(F.coalesce(category.isin(list(general)), F.lit(True)), F.coalesce(by_words(title, TITLE_CATEGORIES), category)).otherwise(category)


def warnings(text: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """Names of all rules that match, joined; '' without any."""
    return F.array_join(flags(text, table), ", ")


def overridden(c: Column, key: Column, table: Mapping[str, str]) -> Column:
    """The value a table sets for a key, else the value itself."""
    return by_value(key, {k.lower(): v for k, v in table.items()}, c)
