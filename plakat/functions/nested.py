"""JSON, array and map columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_first(doc: Column, *paths: str) -> Column:
    """First non-empty text among JSON paths; null if the document isn't JSON."""
    return F.coalesce(*[F.nullif(F.get_json_object(doc, p), F.lit("")) for p in paths])


def encode(value: Column) -> Column:
    """JSON text that keeps null fields."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def json_ld(html: Column) -> Column:
    """Event fields of the JSON-LD blocks of a page: struct(description longest, image first, place first under 60 characters)."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), 1)
    events = F.filter(blocks, lambda b: F.coalesce(F.get_json_object(b, "$.@type").rlike("Event"), F.lit(False)))
    texts = F.filter(F.transform(events, lambda b: F.get_json_object(b, "$.description")), lambda x: x.isNotNull())
    longest = F.element_at(F.array_sort(texts, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)), 1)
    first = lambda get: F.get(F.filter(F.transform(events, get), lambda x: x.isNotNull()), F.lit(0))
    places = F.filter(F.transform(events, lambda b: F.get_json_object(b, "$.location.name")), lambda x: F.length(x) < 60)
    image = first(lambda b: F.coalesce(F.get_json_object(b, "$.image[0]"), F.get_json_object(b, "$.image")))
    return F.struct(F.when(F.size(texts) > 0, longest).alias("description"), image.alias("image"), F.get(places, F.lit(0)).alias("place"))


def first_where(items: Column, test: Callable[[Column], Column]) -> Column:
    """First element that passes; null if none does."""
    return F.get(F.filter(items, test), F.lit(0))


def ranked(items: Column, before: Callable[[Column, Column], Column], flag: str = "is_primary") -> Column:
    """Sort an array of structs and mark the first one."""
    return F.transform(F.array_sort(items, before), lambda x, i: x.withField(flag, i == 0))


def merged(*maps: Column) -> Column:
    """Merge maps, the earlier ones winning; null maps count as empty."""

    def two(a: Column, b: Column) -> Column:
        rest = F.map_filter(b, lambda k, _: ~F.coalesce(F.map_contains_key(a, k), F.lit(False)))
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(a, rest))

    return reduce(two, maps)


def tag(tags: Column, *keys: str) -> Column:
    """First non-empty value among alternative keys of a tag map."""
    return F.coalesce(*[F.nullif(F.element_at(tags, k), F.lit("")) for k in keys])


def address_line(*parts: Column) -> Column:
    """Non-empty parts joined by ', '."""
    return F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])
