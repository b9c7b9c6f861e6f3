"""Best surviving value per field in each group of duplicate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words and phrases that stand for "no data".
FILLER_WORDS = [
    "brak", "brak danych", "brak lokalizacji", "brak informacji", "brak adresu", "brak ceny", "bd", "nd", "na", "none", "null", "nan", "nil", "undefined", "unknown", "nieznane", "nieznany", "miejsce nieznane",
    "nie podano", "nie dotyczy", "do ustalenia", "do potwierdzenia", "tba", "tbd", "tbc", "wkrotce", "wkrótce", "sprawdz", "sprawdź", "sprawdź dostępność", "sprawdz dostepnosc", "sprawdź szczegóły", "sprawdz szczegoly", "cena do ustalenia", "placeholder", "xxx", "test",
]
FREE_PRICE = r"(?iu)bezp[łl]atn|wst[ęe]p woln|woln[yae] wst|darmow|za darmo|gratis|\bfree\b"
PLACEHOLDER_IMAGE = r"(?iu)(no[-_ ]?(image|photo|picture|img)|not[-_ ]?available|placeholder|default|blank|spacer|1x1|pixel|missing|brak)[^/]*$"


def _bare(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}\s]", ""), r"(?U)\s+", " "))


def says_something(value: Column) -> Column:
    """Neither missing nor blank nor a filler word; false for null."""
    bare = _bare(value)
    return F.coalesce((bare != "") & ~bare.isin(FILLER_WORDS), F.lit(False))


def url_says(value: Column) -> Column:
    """A link with a host, or a rooted path with a name in it."""
    return F.coalesce(says_something(value) & F.trim(value).rlike(r"(?i)^((https?:)?//[^/\s?#]+\.[^/\s?#]+|www\.[^/\s]+\.|/[^/\s]*[\p{L}\p{N}])"), F.lit(False))


def image_says(value: Column) -> Column:
    """A link or file name of a picture that isn't a stand-in; inline ``data:`` pixels say nothing."""
    name = F.regexp_replace(F.trim(value), r"[?#].*$", "")
    linked = url_says(value) | name.rlike(r"(?i)^[\w./-]+\.(jpe?g|png|webp|gif|svg|avif)$")
    return F.coalesce(says_something(value) & linked & ~name.rlike(PLACEHOLDER_IMAGE), F.lit(False))


def price_says(value: Column) -> Column:
    """A price has a digit or states free admission."""
    return F.coalesce(value.rlike(r"\p{Nd}") | value.rlike(FREE_PRICE), F.lit(False))


def surviving_values(versions: DataFrame, group: str, row_id: str, fields: dict[str, tuple[Column, Column]], trust: Column, recency: Column, min_rows: int = 2) -> DataFrame:
    """Rank the versions of each group field by field and keep the top one: (group, field, row_id, value).

    ``fields`` maps a field's name to (value, does it say something). Order:
    complete before incomplete (the latter never survive), then trust
    descending (null last), then recency descending (null is oldest), then
    the smallest ``row_id``. A group without any telling value of a field
    yields no row for it; groups with fewer than ``min_rows`` rows yield none,
    and rows with a null group belong to none. Repeated rows count as rows.

    The window keeps one row a group and field before the shuffle
    (WindowGroupLimit), so a group with a third of all rows costs no more.
    """
    base = versions.select(
        F.col(group).alias("_g"), F.col(row_id).alias("_id"), trust.alias("_trust"), recency.alias("_recency"),
        F.array(*[F.struct(F.lit(n).alias("field"), v.cast("string").alias("value"), ok.alias("ok")) for n, (v, ok) in fields.items()]).alias("_f"),
    ).where(F.col("_g").isNotNull())
    told = base.select("_g", "_id", "_trust", "_recency", F.inline("_f")).where("ok").drop("ok")
    order = [F.col("_trust").desc_nulls_last(), F.col("_recency").desc_nulls_last(), F.col("_id").asc_nulls_last()]
    best = told.withColumn("_r", F.row_number().over(W.partitionBy("_g", "field").orderBy(*order))).where("_r = 1")
    if min_rows > 1:
        large = base.groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows).select("_g")
        best = best.join(large, "_g", "left_semi")
    return best.select(F.col("_g").alias(group), "field", F.col("_id").alias(row_id), "value")
