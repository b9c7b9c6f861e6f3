"""Registry of sources: discovery, choice and union."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plakat.sources.feeds import FEEDS, Feed, read_feed


class Sources:
    """Feeds by name; later registrations replace earlier ones."""

    def __init__(self, feeds: Iterable[Feed] = FEEDS) -> None:
        self.feeds = {f.name: f for f in feeds}

    def register(self, feed: Feed) -> None:
        self.feeds[feed.name] = feed

    def chosen(self, only: str | None = None) -> list[Feed]:
        """Enabled feeds in order of name; ``only`` compares without case."""
        return [f for n, f in sorted(self.feeds.items()) if f.enabled and (only is None or n.lower() == only.lower())]

    def read(self, pages: DataFrame, as_of: Column, only: str | None = None) -> DataFrame:
        """UNION ALL of the chosen feeds over one page table (source, url, body), with a stable ordinal a source."""
        parts = [read_feed(pages.where(F.lower("source") == f.name.lower()), f, as_of) for f in self.chosen(only)]
        if not parts:
            raise ValueError("no enabled source of that name")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def health(log: DataFrame) -> DataFrame:
    """Sources whose last fetch (source, status, at) failed: any status but 200, or none."""
    last = log.groupBy("source").agg(F.max_by(F.coalesce("status", F.lit(0)), F.struct("at", F.coalesce("status", F.lit(0)))).alias("status"))
    return last.where("status <> 200")
