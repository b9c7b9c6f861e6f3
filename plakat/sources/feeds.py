"""Source adapters: declarative descriptions of page and API kinds, read into one event schema.

Acquisition is not the engine's work: the input is a table of fetched pages (url, body), so every
adapter is a plain transform that Spark spreads over its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plakat.functions import dates
from plakat.functions.text import contains_any, cut_at_word, filled, squeeze, strip_html
from plakat.functions.url import is_landing
from plakat.operators.dedup import first_by
from plakat.operators.rules import first_match
from plakat.sources.html import parse, value

_COLS = ["title", "date_text", "time_text", "url", "venue", "stage", "address", "category", "price", "organizer", "description", "image_url"]


@dataclass(frozen=True)
class Feed:
    """How a source is read.

    ``cards``: selector of the repeated element. ``fields``: column -> (selector, attribute), an empty selector
    meaning the card itself. ``columns``: for table rows, column -> cell number. ``api``: JSON path of the list
    and column -> path inside an item. ``html_in``: JSON path that holds the HTML of an AJAX answer.
    ``date_rule`` and ``default_time`` fill the typed columns; ``dedup`` names the signature of which the first row is kept.
    """

    name: str
    base_url: str = ""
    cards: str = ""
    fields: dict[str, tuple[str, str]] = field(default_factory=dict)
    columns: dict[str, int] = field(default_factory=dict)
    api: tuple[str, dict[str, str]] | None = None
    html_in: str = ""
    skip_class: str = ""
    date_rule: str = "iso"
    default_time: str = dates.SCHEDULED
    dedup: tuple[str, ...] = ("url",)
    constant: dict[str, str] = field(default_factory=dict)
    enabled: bool = True
    #: Output rules: values set on every row; titles and links that drop a row; names that are no venue; venues told by words (words, venue, address).
    fixed: dict[str, str] = field(default_factory=dict)
    title_case: bool = False
    least_title: int = 1
    deny_titles: tuple[str, ...] = ()
    skip_url: str = ""
    landing: tuple[str, ...] | None = None
    no_venues: tuple[str, ...] = ()
    longest_venue: int = 0
    venue_words: tuple[tuple[tuple[str, ...], str, str], ...] = ()
    #: Pattern whose first group numbers a branch, with the venue's template.
    branch: tuple[str, str] | None = None
    address_town: str = ""
    #: Descriptions shorter than this are replaced by the template (fields in braces), longer ones cut at a word after ``lead`` characters.
    least_description: int = 1
    template: str = ""
    lead: int = 0
    keep_running: bool = False
    #: Fragment that makes the link of each date its own: 'town' or 'date_time'.
    fragment: str = ""
    town: str = ""


def _cards(pages: DataFrame, feed: Feed) -> DataFrame:
    """Cut pages into cards: one row a repeated element."""
    schema = "page_url string, pos int, " + ", ".join(f"`{c}` string" for c in _COLS)
    wanted = set(_COLS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, body in zip(pdf["url"], pdf["body"], strict=True):
                for i, card in enumerate(parse(body).select(feed.cards)):
                    if feed.skip_class and feed.skip_class in card.attrs.get("class", "").split():
                        continue
                    row = dict.fromkeys(wanted)
                    if feed.columns:
                        cells = card.select("td")
                        if len(cells) < 3:
                            continue
                        row |= {c: cells[k].text() for c, k in feed.columns.items()}
                    for c, (selector, attr) in feed.fields.items():
                        row[c] = value(card if not selector else card.first(selector), attr)
                    for c in ("url", "image_url"):
                        if row[c]:
                            row[c] = urljoin(feed.base_url or url or "", row[c])
                    rows.append((url, i, *(row[c] for c in _COLS)))
            yield pd.DataFrame(rows, columns=["page_url", "pos", *_COLS])

    return pages.select("url", "body").mapInPandas(run, schema)


def _items(pages: DataFrame, feed: Feed) -> DataFrame:
    """Items of JSON answers: native, no Python."""
    path, fields = feed.api
    raw = F.from_json(F.get_json_object("body", path), "array<string>")
    items = pages.select(F.col("url").alias("page_url"), F.posexplode(F.coalesce(raw, F.array().cast("array<string>"))).alias("pos", "item"))
    take = {c: F.get_json_object("item", p) for c, p in fields.items()}
    return items.select("page_url", "pos", *[take.get(c, F.lit(None).cast("string")).alias(c) for c in _COLS])


def _when(rule: str, c: Column, as_of: Column) -> Column:
    """struct(start, end) by the feed's date rule."""
    one = lambda d: F.struct(d.alias("start"), d.alias("end"))
    iso = F.try_to_date(F.substring(c, 1, 10))
    day_month = lambda r: dates.make(dates.infer_year(dates.part(c, r"(\d{1,2})\.(\d{1,2})", 2).try_cast("int"), as_of, r), dates.part(c, r"(\d{1,2})\.(\d{1,2})", 2), dates.part(c, r"(\d{1,2})\.(\d{1,2})", 1))
    rules = {
        "iso": lambda: one(iso),
        "zoned": lambda: one(dates.zoned(c)["day"]),
        "compact": lambda: one(F.coalesce(dates.compact_timestamp(c).cast("date"), iso)),
        "dotted": lambda: one(dates.dotted(c)),
        "dotted_or_worded": lambda: one(F.coalesce(dates.dotted(c), dates.worded(c, 1))),
        "worded": lambda: one(dates.worded(c)),
        "worded_next": lambda: one(F.coalesce(dates.worded(c), dates.worded_no_year(c, as_of, "next"))),
        "day_month_season": lambda: one(F.coalesce(dates.dotted(c), day_month("season"))),
        "any_winter": lambda: one(F.coalesce(dates.dotted(c), dates.worded(c), dates.worded_no_year(c, as_of, "winter"), day_month("winter"))),
        "range": lambda: dates.date_range(c, as_of),
        "range_or_month": lambda: F.get(F.filter(F.array(dates.date_range(c, as_of), dates.month_range(c, as_of)), lambda x: x["start"].isNotNull()), F.lit(0)),
    }
    return rules[rule]()


def read_feed(pages: DataFrame, feed: Feed, as_of: Column) -> DataFrame:
    """Events of one feed from its pages (url, body).

    Rows without a title or without a readable date are dropped; of rows with one signature the first (page, position)
    stays. Null and empty bodies give nothing.
    """
    src = pages.select("url", F.get_json_object("body", feed.html_in).alias("body")) if feed.html_in else pages
    raw = _items(src, feed) if feed.api else _cards(src, feed)
    span = _when(feed.date_rule, F.col("date_text"), as_of)
    text = F.coalesce(F.col("time_text"), F.col("date_text"), F.lit(""))
    start = dates.zoned(F.col("date_text"))["time"] if feed.date_rule == "zoned" else dates.time_of(text, feed.default_time)
    out = raw.select(
        F.lit(feed.name).alias("source"), squeeze(strip_html(F.col("title"))).alias("title"), "date_text", "time_text", span.alias("_d"), F.coalesce(start, F.lit(feed.default_time)).alias("time_start"), F.coalesce("url", "page_url").alias("url"), "venue", "stage",
        "address", "category", "price", "organizer", strip_html(F.col("description")).alias("description"), "image_url", "page_url", "pos",
    )
    out = out.where("title <> ''").withColumn("date_start", F.col("_d.start")).withColumn("date_end", F.col("_d.end")).where("date_start is not null")
    sig = [F.lower(F.col(c)) if c == "title" else F.col(c) for c in feed.dedup]
    out = out.withColumn("_s", F.concat_ws("\x1f", *[F.coalesce(x.cast("string"), F.lit("")) for x in sig]))
    return finish(first_by(out, ["_s"], "page_url", "pos"), feed, as_of).select("source", "title", "date_text", "time_text", "date_start", "date_end", "time_start", "url", "venue", "stage", "address", "category", "price", "organizer", "description", "image_url")


def finish(events: DataFrame, feed: Feed, as_of: Column) -> DataFrame:
    """Apply a feed's output rules to its parsed events: filters, venue, address, description, link."""
    out = events.withColumns({c: F.lit(v) for c, v in feed.fixed.items()})
    title, link = F.col("title"), F.coalesce(F.col("url"), F.lit(""))
    keep = (F.length(title) >= feed.least_title) & ~contains_any(title, list(feed.deny_titles) or ["\x00"])
    if feed.skip_url:
        keep = keep & ~link.rlike(feed.skip_url)
    if feed.landing is not None:
        keep = keep & ~F.coalesce(is_landing(link, list(feed.landing)), F.lit(False))
    if feed.keep_running:
        keep = keep & (F.coalesce("date_end", "date_start") >= as_of)
    out = out.where(keep)
    if feed.title_case:
        out = out.withColumn("title", F.initcap(F.lower("title")))
    if feed.no_venues or feed.longest_venue:
        v = F.lower(F.trim("venue"))
        bad = v.isin(list(feed.no_venues)) | ((F.length("venue") > feed.longest_venue) if feed.longest_venue else F.lit(False))
        out = out.withColumn("venue", F.when(~F.coalesce(bad, F.lit(False)), F.col("venue")))
    if feed.venue_words:
        text = F.concat_ws(" ", "title", "description")
        told = [(contains_any(text, list(ws)), v, a) for ws, v, a in feed.venue_words]
        out = out.withColumns({"venue": first_match([(t, v) for t, v, _ in told], F.col("venue")), "address": first_match([(t, a) for t, _, a in told], F.col("address"))})
    if feed.branch:
        n = F.regexp_extract(F.concat_ws(" ", "title", "description"), feed.branch[0], 1)
        out = out.withColumn("venue", F.when(n != "", F.replace(F.lit(feed.branch[1]), F.lit("{n}"), n)).otherwise(F.col("venue")))
    for c, v in feed.constant.items():
        out = out.withColumn(c, F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(v)))
    if feed.address_town:
        town = F.lit(feed.address_town)
        made = F.when(F.coalesce(F.col("venue"), F.lit("")) == "", town).when(F.col("venue").contains(town), F.col("venue")).otherwise(F.concat_ws(", ", "venue", town))
        out = out.withColumn("address", F.coalesce(F.nullif("address", F.lit("")), made))
    if feed.template:
        out = out.withColumn("description", F.when(F.length(F.coalesce("description", F.lit(""))) < feed.least_description, filled(feed.template)).otherwise(F.col("description")))
    if feed.lead:
        out = out.withColumn("description", cut_at_word(F.col("description"), feed.lead))
    if feed.fragment:
        mark = F.lit(feed.town) if feed.fragment == "town" else F.concat_ws("-", F.col("date_start").cast("string"), F.replace("time_start", F.lit(":"), F.lit("")))
        out = out.withColumn("url", F.concat_ws("#", "url", mark))
    return out


def details(events: DataFrame, pages: DataFrame, body: str, image: str = "meta[property='og:image']", least: int = 20, most: int = 4) -> DataFrame:
    """Add description and image from detail pages (url, body): each distinct page is read once, then joined."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, html in zip(pdf["url"], pdf["body"], strict=True):
                tree = parse(html)
                box = tree.first(body) or tree
                ps = [t for t in (p.text() for p in box.select("p")) if len(t) > least]
                img = tree.first(image)
                src = (img.attrs.get("content") or img.attrs.get("src")) if img else None
                rows.append((url, "\n\n".join(ps[:most]) or None, urljoin(url or "", src) if src else None))
            yield pd.DataFrame(rows, columns=["_u", "_description", "_image"])

    wanted = events.select("url").distinct()
    # Of several fetches of a page the last counts, if they have a time; else the first in order of their text.
    order = [F.col("fetched_at").desc_nulls_last()] if "fetched_at" in pages.columns else []
    last = pages.join(wanted, "url", "left_semi").withColumn("_n", F.row_number().over(W.partitionBy("url").orderBy(*order, "body"))).where("_n = 1")
    got = last.select("url", "body").mapInPandas(run, "_u string, _description string, _image string")
    out = events.join(got, F.col("url") == F.col("_u"), "left")
    return out.withColumn("description", F.coalesce(F.nullif("_description", F.lit("")), "description")).withColumn("image_url", F.coalesce(F.nullif("image_url", F.lit("")), "_image")).drop("_u", "_description", "_image")


def linked_pages(listing: DataFrame, selector: str) -> DataFrame:
    """Distinct detail links of listing pages (url, body): (url), made absolute."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(urljoin(u or "", a.attrs["href"]),) for u, b in zip(pdf["url"], pdf["body"], strict=True) for a in parse(b).select(selector) if a.attrs.get("href")], columns=["link"])

    return listing.select("url", "body").mapInPandas(run, "link string").distinct().select(F.col("link").alias("url"))


# The kinds of sources, with their selectors, date rules, default times and signatures (one source has two: a table and its news).
FEEDS = [
    Feed("ajax_rows", html_in="$.html", cards="article.small-event-row", fields={"title": ("a", "text"), "url": ("a[href]", "href"), "date_text": (".small-event-row__day", "text"), "time_text": (".small-event-row__hour", "text")}, date_rule="day_month_season", default_time="10:00", dedup=("date_start", "time_start", "title"), title_case=True, fixed={"venue": "Teatr Lalek Banialuka", "address": "ul. Mickiewicza 20, Bielsko-Biała", "category": "Teatr i Spektakle"}, least_description=30, template="{title}. Czas: {date_start} {time_start}. Miejsce: {venue}."),
    Feed("events_api", api=("$.events", {"title": "$.title", "date_text": "$.start_date", "time_text": "$.start_date", "description": "$.description", "venue": "$.venue.venue", "address": "$.venue.address", "price": "$.cost", "image_url": "$.image.url", "url": "$.url", "organizer": "$.organizer[0].organizer", "category": "$.categories[0].name"}), date_rule="iso", default_time="18:00", dedup=("date_start", "time_start", "title"), no_venues=("bielsko-biała", "bielsko biala", "bielsko"), constant={"venue": "Przestrzeń Miejska Bielsko-Biała", "address": "Bielsko-Biała"}, fixed={"category": "Kultura i Sztuka"}),
    Feed("paged_cards", cards=".event-block-2", fields={"title": ("h3 a, h3", "text"), "url": ("h3 a, .item-image a", "href"), "date_text": (".event-meta", "text"), "time_text": (".event-meta", "text"), "image_url": (".item-image img, img", "src"), "description": (".event-description, .field--name-field-skrot", "text")}, date_rule="worded_next", default_time="18:00", dedup=("date_start", "time_start", "title"), fixed={"venue": "Bielskie Centrum Kultury im. Marii Koterbskiej", "address": "ul. Juliusza Słowackiego 27, Bielsko-Biała"}),
    Feed("posts_api", api=("$", {"title": "$.title.rendered", "url": "$.link", "date_text": "$.acf.event_datetime", "time_text": "$.acf.event_datetime", "description": "$.content.rendered", "image_url": "$.yoast_head_json.og_image[0].url"}), date_rule="compact", default_time="19:00", dedup=("date_start", "time_start", "title"), skip_url="/en/|/en-", fixed={"venue": "Cavatina Hall", "address": "ul. Dworkowa 2, Bielsko-Biała"}, lead=300),
    Feed("calendar_list", cards="ul.eventlist a.event", skip_class="-past", fields={"title": (".event_title, .event_titlepart", "text"), "url": ("", "href"), "date_text": (".event_txt", "text"), "category": (".event_pix", "text"), "image_url": ("img", "src")}, date_rule="range", default_time="10:00", dedup=("date_start", "title"), constant={"category": "Wystawa", "venue": "Galeria Bielska BWA", "address": "ul. 3 Maja 11, Bielsko-Biała"}, venue_words=((("willi sixta", "willa sixta"), "Willa Sixta (Galeria Bielska BWA)", "ul. Mickiewicza 24, Bielsko-Biała"),), least_description=31, template="{category}: {title} w przestrzeni {venue}."),
    Feed("repertoire_api", api=("$.events", {"title": "$.title", "date_text": "$.date", "stage": "$.stage.name", "url": "$.showEvent.slug"}), date_rule="zoned", default_time=dates.SCHEDULED, dedup=("date_start", "time_start", "stage", "title"), constant={"stage": "Duża Scena"}, fixed={"venue": "Teatr Polski w Bielsku-Białej", "address": "ul. 1 Maja 1, Bielsko-Biała"}),
    Feed("views_list", cards="#block-system-main .views-row", fields={"title": (".views-field-title .field-content, .views-field-title a", "text"), "url": (".view-read-more a, .views-field-title a", "href"), "date_text": (".data-wydarzenia", "text"), "time_text": (".data-wydarzenia", "text"), "venue": (".views-field-field-miejsce-wydarzenia .field-content", "text"), "image_url": (".views-field-field-obrazek img", "src")}, date_rule="worded", dedup=("url",), constant={"venue": "Kędzierzyn-Koźle"}, address_town="Kędzierzyn-Koźle", keep_running=True),
    Feed("post_cards", cards="article, .post, .elementor-post, .event-item", fields={"title": ("h2, h3, h4, .entry-title, .elementor-post__title", "text"), "url": ("a[href]", "href"), "date_text": ("", "text"), "time_text": ("", "text"), "image_url": ("img[src]", "src"), "description": ("p, .entry-summary, .elementor-post__excerpt", "text")}, date_rule="range", dedup=("url",), least_title=5, constant={"venue": "Miejska Biblioteka Publiczna w Kędzierzynie-Koźlu", "address": "Rynek 3, Kędzierzyn-Koźle"}, branch=(r"(?iu)fili\w*\s+nr\s*(\d+)", "MBP Filia nr {n}")),
    Feed("wall_items", cards=".mnwall-item", fields={"title": ("", "data-title"), "url": ("a[href]", "href"), "date_text": ("", "text"), "time_text": ("", "text"), "image_url": (".mnwall-photo-link, .mnwall-item-photo", "style-url")}, date_rule="any_winter", dedup=("url",), venue_words=((("sławięcic",), "Park w Sławięcicach", "Park w Sławięcicach"), (("chemik",), "DK Chemik (al. Jana Pawła II 27)", "DK Chemik (al. Jana Pawła II 27)"), (("twierdza", "dk koźle"), "DK Koźle / Kino Twierdza (ul. Skarbowa 10)", "DK Koźle / Kino Twierdza (ul. Skarbowa 10)"), (("dk lech",), "DK Lech (ul. Wyzwolenia 7)", "DK Lech (ul. Wyzwolenia 7)")), constant={"venue": "MOK Kędzierzyn-Koźle", "address": "MOK Kędzierzyn-Koźle"}),
    Feed("table_rows", cards="table tr", columns={"date_text": 1, "title": 2}, fields={"url": ("a[href]", "href")}, date_rule="range_or_month", dedup=("title", "date_start")),
    Feed("news_items", cards=".item, article, .article, .blog-item, .news-item, .contentpaneopen", fields={"title": ("h2, h3, h4, .title, a", "text"), "url": ("a[href]", "href"), "date_text": ("", "text"), "image_url": ("img[src]", "src"), "description": ("", "text")}, date_rule="dotted", dedup=("title", "date_start")),
    Feed("listing_details", cards=".content, #content, .text, article, main", fields={"title": ("h1, h2", "text"), "date_text": ("", "text"), "time_text": ("", "text"), "image_url": ("img[src]", "src")}, date_rule="worded", default_time="19:00", dedup=("url",), constant={"venue": "Narodowe Centrum Polskiej Piosenki", "category": "Koncert"}, address_town="Opole", template="{title} w {venue}. Czas: {date_start} {time_start}."),
    Feed("national_rows", cards="tr.event-row, .event-row, .single-event, .event-list-item", fields={"title": ("h2, h3, h4, strong, a.title", "text"), "url": ("a[href]", "href"), "date_text": ("", "text"), "time_text": ("", "text"), "venue": ("a[href*='/miejsce/']", "text")}, date_rule="dotted", dedup=("url", "date_start", "time_start"), landing=(), longest_venue=60, template="{title}. Czas: {date_start} {time_start}. Miejsce: {venue}.", fragment="town", town="miasto"),
    Feed("national_cards", cards=".card, .event, .search-item", fields={"title": ("h1, h2, h3, a", "text"), "url": ("a[href*='/event/'], a[href*='/imprezy/'], a[href*='/wydarzenia/']", "href"), "date_text": ("", "text"), "time_text": ("", "text"), "venue": ("a[href*='/obiekty/'], a[href*='/miejsce/'], [itemprop='location']", "text")}, date_rule="dotted_or_worded", default_time="19:00", dedup=("url", "date_start", "time_start"), fixed={"category": "Kultura i Rozrywka"}, template="Wydarzenie: {title}. Miejsce: {venue}. Bilety dostępne online.", fragment="date_time"),
]
