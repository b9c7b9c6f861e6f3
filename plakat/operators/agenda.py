"""Filters and order of the agenda: what is on, when, and which page it is on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plakat.functions.dates import weekend
from plakat.functions.text import contains_any
from plakat.operators.order import positions


def end_of(start: Column, end: Column) -> Column:
    """End date, the start where it is missing or empty."""
    return F.coalesce(F.nullif(end, F.lit("")), start)


def active(events: DataFrame, as_of: Column, start: str = "date_start", end: str = "date_end", town: Column | None = None) -> DataFrame:
    """Rows that end on ``as_of`` or later (ISO text compares like dates); rows without any date drop out."""
    keep = end_of(F.col(start), F.col(end)) >= as_of
    return events.where(keep if town is None else town & keep)


def purge(events: DataFrame, as_of: Column, start: str = "date_start", end: str = "date_end") -> tuple[DataFrame, DataFrame]:
    """(kept, expired); a row without any date is kept."""
    gone = F.coalesce(end_of(F.col(start), F.col(end)) < as_of, F.lit(False))
    return events.where(~gone), events.where(gone)


def overlaps(start: Column, end: Column, as_of: Column, period: str) -> Column:
    """'today', 'weekend' and 'all' by overlap, 'tomorrow' by the start alone; what ended before today is never shown."""
    w = weekend(as_of)
    test = {"today": (start <= as_of) & (end >= as_of), "tomorrow": start == F.date_add(as_of, 1), "weekend": (start <= w["last"]) & (end >= w["first"]), "all": F.lit(True)}[period]
    return (end >= as_of) & test


def badge(start: Column, end: Column, as_of: Column) -> Column:
    """DZIŚ, TRWA, JUTRO or null."""
    return F.when(start == as_of, "DZIŚ").when((start < as_of) & (end >= as_of), "TRWA").when(start == F.date_add(as_of, 1), "JUTRO")


def first_page(events: DataFrame, *order: Column, size: int = 40) -> DataFrame:
    """The first rows in a total order, with their position: a top-k, so no full sort."""
    top = events.orderBy(*order).limit(size)
    return top.withColumn("position", F.row_number().over(W.orderBy(*order)))


def not_junk(name: Column, words: list[str], least: int = 3) -> Column:
    """Named, long enough, without a word of the deny list."""
    return (F.length(F.coalesce(F.trim(name), F.lit(""))) >= least) & ~contains_any(name, words)


def public_access(access: Column) -> Column:
    """Open car parks: anything but private, permit and no; unknown is open."""
    return ~F.coalesce(F.lower(access).isin("private", "permit", "no"), F.lit(False))


def relevant(texts: list[Column], slug: str, not_words: list[str]) -> Column:
    """Is the town named in any of the texts, and no excluded word?"""
    out = F.lit(False)
    bad = F.lit(False)
    for t in texts:
        out, bad = out | contains_any(t, [slug]), bad | contains_any(t, not_words)
    return out & ~bad


def garbage(source: Column, title: Column, venue: Column, aggregators: list[str], buttons: list[str], generic: list[str], longest: int = 60, spam: list[str] | None = None) -> Column:
    """Rows of aggregators whose title is a button or holds search spam, or whose venue is too long or generic; null if nothing tells."""
    return source.isin(aggregators) & (F.lower(F.trim(title)).isin(buttons) | contains_any(title, spam or ["\x00"]) | (F.length(venue) > longest) | F.lower(F.trim(venue)).isin(generic))


def guard(df: DataFrame, least: int) -> DataFrame:
    """Stop before anything is written if there are fewer than ``least`` rows."""
    n = df.limit(least).count()
    if n < least:
        raise RuntimeError(f"only {n} rows, at least {least} are expected")
    return df


def iso_date(c: Column) -> Column:
    """Exactly YYYY-MM-DD."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


#: Distance that stands for an unknown one in orders.
SENTINEL = 9_999


def or_sentinel(c: Column, sentinel: int = SENTINEL) -> Column:
    """The value, or a sentinel that sorts unknown ones among the far ones."""
    return F.coalesce(c, F.lit(sentinel))


def split_pages(rows: DataFrame, block: str, *order: str, size: int = 40) -> tuple[DataFrame, DataFrame]:
    """(first page, remainder) of each block's rows in a stable order."""
    at = positions(rows, block, *order)
    return at.where(F.col("position") <= size), at.where(F.col("position") > size)


def sample_rows(rows: DataFrame, n: int, order: str) -> DataFrame:
    """``n`` rows in order of a column: a sample that is the same each time."""
    return rows.orderBy(order).limit(n)
