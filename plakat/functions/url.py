"""URL columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plakat.functions.text import slugify

# Parameters that only track visits.
TRACKERS = r"(?i)^(utm_[^=]*|fbclid|gclid|_ga)(=.*)?$"


def clean_url(c: Column) -> Column:
    """Without the fragment and without tracking parameters; the order of the others stays."""
    base = F.substring_index(c, "#", 1)
    path = F.substring_index(base, "?", 1)
    query = F.substring(base, F.length(path) + 2, F.length(base))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKERS)), "&")
    return F.trim(F.when(base.contains("?"), F.concat(path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))).otherwise(base))


def url_identity(c: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_extract(c, r"^([^#?]*)", 1)


def netloc(c: Column) -> Column:
    """Lower-case authority (host, port and user), '' without one."""
    return F.lower(F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def provider(c: Column, organizer: Column, institutions: dict[str, str], aggregators: dict[str, str], words: list[str], unknown: str = "Bilety", box_office: str = "Oficjalna kasa") -> Column:
    """Who sells behind a link: struct(authority, name, official).

    Ordered: no link; an institution's domain (100); an institution's word anywhere in the link and no
    aggregator (100); an aggregator's domain (80); a named organizer (100); unknown (10).
    """
    u, org = F.lower(c), F.trim(organizer)
    made = lambda p, n, o: F.struct(F.lit(p).alias("authority"), n.alias("name"), F.lit(o).alias("official"))
    has = lambda ws: reduce(lambda a, w: a | u.contains(w), ws, F.lit(False))
    out = F.when(F.coalesce(c, F.lit("")) == "", made(10, F.coalesce(F.nullif(organizer, F.lit("")), F.lit(unknown)), False))
    for domain, name in institutions.items():
        out = out.when(u.contains(domain), made(100, F.lit(name), True))
    out = out.when(has(words) & ~has(aggregators), made(100, F.coalesce(F.nullif(org, F.lit("")), F.lit(box_office)), True))
    for domain, name in aggregators.items():
        out = out.when(u.contains(domain), made(80, F.lit(name), False))
    return out.when(F.length(org) > 2, made(100, org, True)).otherwise(made(10, F.lit(unknown), False))


def with_parameter(c: Column, key: str, value: str) -> Column:
    """Append a parameter with the fitting separator."""
    return F.concat(c, F.when(c.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit(f"{key}={value}"))


def path_parts(c: Column) -> Column:
    """Non-empty parts of the path."""
    path = F.regexp_replace(url_identity(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", "")
    return F.filter(F.split(path, "/"), lambda p: p != "")


def is_landing(c: Column, prefixes: list[str], least_parts: int = 2) -> Column:
    """A category or town page: too few path parts, or a first part on the list."""
    parts = path_parts(c)
    return (F.size(parts) < least_parts) | F.coalesce(F.get(parts, F.lit(0)).isin(prefixes), F.lit(False))


def with_fragment(c: Column, *parts: Column) -> Column:
    """Instance link: the parts joined by hyphens as fragment."""
    return F.concat(c, F.lit("#"), F.concat_ws("-", *parts))


def local_url(town: Column, title: Column, date: Column) -> Column:
    """Synthetic link of a row without one; depends on the row's values only."""
    return F.concat(F.lit("local://"), town, F.lit("/"), slugify(title), F.lit("-"), date)


def absolute(c: Column, base: str) -> Column:
    """Join a relative link to a base 'scheme://host/path'."""
    scheme, host = base.split("://", 1)
    root = f"{scheme}://{host.split('/')[0]}"
    folder = base[: base.rfind("/") + 1] if "/" in host else base + "/"
    return (
        F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), c).when(c.startswith("//"), F.concat(F.lit(scheme + ":"), c)).when(c.startswith("/"), F.concat(F.lit(root), c))
        .when(c == "", F.lit(base)).otherwise(F.concat(F.lit(folder), c))
    )
