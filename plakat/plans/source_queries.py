"""Driver queries over sources and sinks: pages and answers are rendered from the records, read back by the adapters, and compared with the records."""

from __future__ import annotations

from pyspark.sql import functions as F

from plakat.functions import dates, nested, text
from plakat.operators import agenda, dedup, joins, rules
from plakat.plans.event_queries import _DAY, _V, AS_OF, as_of, day, records
from plakat.plans.registry import Registry
from plakat.runtime import read_table
from plakat.sources import feeds, registry
from plakat.sources.feeds import FEEDS

R = Registry()

#: Records to a rendered page.
PAGE = 25
_MONTH = "['" + "', '".join(dates.MONTHS_OF) + "'][month(d)]"
_BASE = f"b AS (SELECT record_id AS id, d, lpad(CAST(record_id % 24 AS VARCHAR), 2, '0') || ':30' AS t FROM (SELECT record_id, {_DAY} AS d FROM event_records) WHERE d IS NOT NULL)"


def base(spark, sf_dir):
    """(id, d, t): records with a day, and a time made of the id."""
    r = records(spark, sf_dir).select(F.col("record_id").alias("id"), day().alias("d")).where("d is not null")
    return r.withColumn("t", F.concat(F.lpad((F.col("id") % 24).cast("string"), 2, "0"), F.lit(":30")))


def fill(template):
    """A template with {id}, {t}, {d} (ISO), {dotted}, {worded}, {ddmm}, {compact} as text."""
    month = F.element_at(F.array(*map(F.lit, dates.MONTHS_OF)), F.month("d"))
    c = {"id": F.col("id").cast("string"), "t": F.col("t"), "d": F.col("d").cast("string"), "dotted": F.date_format("d", "dd.MM.yyyy"), "worded": F.concat_ws(" ", F.dayofmonth("d").cast("string"), month, F.year("d").cast("string")), "ddmm": F.date_format("d", "d.MM"), "compact": F.date_format("d", "yyyyMMdd")}
    parts = []
    for i, piece in enumerate(template.split("\x01")):
        parts.append(F.lit(piece) if i % 2 == 0 else c[piece])
    return F.concat(*parts)


def pages_of(spark, sf_dir, card, around, sep=""):
    """Pages (url, body) of rendered cards, PAGE records each, in order of id."""
    b = base(spark, sf_dir)
    cards = b.select((F.col("id") / PAGE).cast("bigint").alias("p"), F.struct("id", fill(card).alias("c")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]), sep)
    head, tail = around
    return cards.groupBy("p").agg(body.alias("c")).select(F.concat(F.lit("https://x.example/list/"), F.col("p").cast("string")).alias("url"), F.concat(F.lit(head), F.col("c"), F.lit(tail)).alias("body"))


def _m(name):
    return f"\x01{name}\x01"


_T = f"Pokaz {_m('id')}"
_A = f"<a href='/e/{_m('id')}'>"
#: Adapter -> (card, page around the cards, separator): how its source writes a record.
RENDERED = {
    "ajax_rows": (f"<article class='small-event-row'>{_A.replace(chr(39), '')}{_T}</a><span class='small-event-row__day'>{_m('ddmm')}</span><i class='small-event-row__hour'>{_m('t')}</i></article>", ('{"html": "', '"}'), ""),
    "events_api": (f'{{"title": "{_T}", "start_date": "{_m("d")} {_m("t")}:00", "url": "https://x.example/e/{_m("id")}", "venue": {{"venue": "Bielsko"}}}}', ('{"events": [', "]}"), ","),
    "paged_cards": (f"<div class=event-block-2><h3>{_A}{_T}</a></h3><div class=event-meta>{_m('worded')} godz. {_m('t')}</div></div>", ("<html>", "</html>"), ""),
    "posts_api": (f'{{"title": {{"rendered": "{_T}"}}, "link": "https://x.example/e/{_m("id")}", "acf": {{"event_datetime": "{_m("d")} {_m("t")}:00"}}, "content": {{"rendered": "<p>Opis</p>"}}}}', ("[", "]"), ","),
    "calendar_list": (f"<a class=event href='/e/{_m('id')}'><span class=event_title>{_T} Willa Sixta</span><i class=event_txt>do {_m('dotted')}</i></a>", ("<ul class=eventlist><a class='event -past' href='/e/0'><span class=event_title>Dawny</span><i class=event_txt>1.01.2026</i></a>", "</ul>"), ""),
    "repertoire_api": (f'{{"title": "{_T}", "date": "{_m("d")}T{_m("t")}:00Z", "showEvent": {{"slug": "s-{_m("id")}"}}}}', ('{"events": [', "]}"), ","),
    "views_list": (f"<div class=views-row><div class=views-field-title><span class=field-content>{_A}{_T}</a></span></div><div class=data-wydarzenia>{_m('worded')}, {_m('t')}</div></div>", ("<div id=block-system-main>", "</div>"), ""),
    "post_cards": (f"<article><h3>{_T} w Filii nr 7</h3>{_A}x</a><p>{_m('dotted')} godz. {_m('t')}</p></article>", ("<main>", "</main>"), ""),
    "wall_items": (f"<div class=mnwall-item data-title='{_T} Chemik'>{_A}x</a>{_m('worded')}</div>", ("<div>", "</div>"), ""),
    "table_rows": (f"<tr><td>{_m('id')}</td><td>{_m('worded')}</td><td>{_A}{_T}</a></td></tr>", ("<table><tr><th>Lp.</th></tr><tr><td>tylko</td><td>dwie</td></tr>", "</table>"), ""),
    "news_items": (f"<div class=item><h2>{_T}</h2>{_A}x</a> {_m('dotted')}</div>", ("<div>", "</div>"), ""),
    "national_rows": (f"<tr class=event-row><td><h3>{_T}</h3><a href='/event/view/id/{_m('id')}'>x</a> {_m('dotted')} {_m('t')}<a href='/miejsce/1'>Klub</a></td></tr>", ("<table>", "</table>"), ""),
    "national_cards": (f"<div class=card><h2>{_T}</h2><a href='/imprezy/{_m('id')}/'>x</a> {_m('dotted')} {_m('t')}</div>", ("<div>", "</div>"), ""),
}

_LOCAL = "(timezone('Europe/Warsaw', timezone('UTC', CAST(CAST(d AS VARCHAR) || ' ' || t || ':00' AS TIMESTAMP))))"
_E = "'https://x.example/e/' || id"
_TXT = "'Pokaz ' || id"
#: Adapter -> SQL of (title, date_start, date_end, time_start, url, venue, address, category, description) over the base, and a condition.
WANTED = {
    "ajax_rows": (_TXT, "make_date(2026, month(d), day(d))", None, "t", _E, "'Teatr Lalek Banialuka'", "'ul. Mickiewicza 20, Bielsko-Biała'", "'Teatr i Spektakle'", f"{_TXT} || '. Czas: ' || make_date(2026, month(d), day(d)) || ' ' || t || '. Miejsce: Teatr Lalek Banialuka.'"),
    "events_api": (_TXT, "d", None, "t", _E, "'Przestrzeń Miejska Bielsko-Biała'", "'Bielsko-Biała'", "'Kultura i Sztuka'", "NULL"),
    "paged_cards": (_TXT, "d", None, "t", _E, "'Bielskie Centrum Kultury im. Marii Koterbskiej'", "'ul. Juliusza Słowackiego 27, Bielsko-Biała'", "NULL", "NULL"),
    "posts_api": (_TXT, "d", None, "t", _E, "'Cavatina Hall'", "'ul. Dworkowa 2, Bielsko-Biała'", "NULL", "'Opis'"),
    "calendar_list": (f"{_TXT} || ' Willa Sixta'", f"least(d, DATE '{AS_OF}')", "d", "'10:00'", _E, "'Willa Sixta (Galeria Bielska BWA)'", "'ul. Mickiewicza 24, Bielsko-Biała'", "'Wystawa'", f"'Wystawa: ' || {_TXT} || ' Willa Sixta w przestrzeni Willa Sixta (Galeria Bielska BWA).'"),
    "repertoire_api": (_TXT, f"CAST({_LOCAL} AS DATE)", None, f"strftime({_LOCAL}, '%H:%M')", "'s-' || id", "'Teatr Polski w Bielsku-Białej'", "'ul. 1 Maja 1, Bielsko-Biała'", "NULL", "NULL"),
    "views_list": (_TXT, "d", None, "t", _E, "'Kędzierzyn-Koźle'", "'Kędzierzyn-Koźle'", "NULL", "NULL"),
    "post_cards": (f"{_TXT} || ' w Filii nr 7'", "d", None, "t", _E, "'MBP Filia nr 7'", "'Rynek 3, Kędzierzyn-Koźle'", "NULL", "strftime(d, '%d.%m.%Y') || ' godz. ' || t"),
    "wall_items": (f"{_TXT} || ' Chemik'", "d", None, "'Według harmonogramu'", _E, "'DK Chemik (al. Jana Pawła II 27)'", "'DK Chemik (al. Jana Pawła II 27)'", "NULL", "NULL"),
    "table_rows": (_TXT, "d", None, "'Według harmonogramu'", _E, "NULL", "NULL", "NULL", "NULL"),
    "news_items": (_TXT, "d", None, "'Według harmonogramu'", _E, "NULL", "NULL", "NULL", f"{_TXT} || ' x ' || strftime(d, '%d.%m.%Y')"),
    "national_rows": (_TXT, "d", None, "t", "'https://x.example/event/view/id/' || id || '#miasto'", "'Klub'", "NULL", "NULL", f"{_TXT} || '. Czas: ' || d || ' ' || t || '. Miejsce: Klub.'"),
    "national_cards": (_TXT, "d", None, "t", "'https://x.example/imprezy/' || id || '/#' || d || '-' || replace(t, ':', '')", "NULL", "NULL", "'Kultura i Rozrywka'", f"'Wydarzenie: ' || {_TXT} || '. Miejsce: . Bilety dostępne online.'"),
}
_OUT = ["title", "date_start", "date_end", "time_start", "url", "venue", "address", "category", "description"]
_FEED = {f.name: f for f in FEEDS}


def _register(name):
    card, around, sep = RENDERED[name]
    title, start, end, *rest = WANTED[name]
    cond = f" WHERE d >= DATE '{AS_OF}'" if _FEED[name].keep_running else ""
    cond = f" WHERE NOT (month(d) = 2 AND day(d) = 29)" if name == "ajax_rows" else cond
    sql = f"WITH {_BASE} SELECT " + ", ".join(f"{x} AS {c}" for x, c in zip((title, start, end or start, *rest), _OUT, strict=True)) + f" FROM b{cond}"

    @R.add(f"src_{name}", sql)
    def query(spark, sf_dir):
        """Records read back from the pages of one adapter's source."""
        return feeds.read_feed(pages_of(spark, sf_dir, card, around, sep), _FEED[name], as_of()).select(*_OUT)


for _name in RENDERED:
    _register(_name)


@R.add("s09_details", f"WITH {_BASE} SELECT {_E} AS url, 'Opis wydarzenia numer ' || id || ' w całości' AS description, 'https://x.example/img/' || id || '.jpg' AS image_url FROM b WHERE id IN (SELECT id FROM b)")
def s09_details(spark, sf_dir):
    """Listing pages to distinct detail links, each detail page fetched twice and read once, the later fetch counting."""
    listing = pages_of(spark, sf_dir, f"<li>{_A}x</a></li><li>{_A}znowu</a></li>", ("<ul>", "</ul>"))
    links = feeds.linked_pages(listing, "a[href*='/e/']")
    b = base(spark, sf_dir)
    body = fill(f"<meta property='og:image' content='/img/{_m('id')}.jpg'><article><p>Opis wydarzenia numer {_m('id')} w całości</p><p>krótki</p></article>")
    fetch = b.select(F.concat(F.lit("https://x.example/e/"), F.col("id").cast("string")).alias("url"), body.alias("body"), F.lit(2).alias("fetched_at"))
    old = fetch.withColumns({"body": F.lit("<article><p>Przestarzały opis tej samej strony</p></article>"), "fetched_at": F.lit(1)})
    events = links.withColumns({"description": F.lit(None).cast("string"), "image_url": F.lit("")})
    return feeds.details(events, fetch.unionByName(old), "article").select("url", "description", "image_url")


@R.add("s13_registry", "WITH " + _BASE + " SELECT source, count(*) AS n FROM b, (VALUES ('news_items'), ('table_rows')) t(source) GROUP BY source")
def s13_registry(spark, sf_dir):
    """All registered feeds over one page table of two sources; the others give nothing."""
    parts = [pages_of(spark, sf_dir, *RENDERED[n]).withColumn("source", F.lit(n)) for n in ("news_items", "table_rows")]
    return registry.Sources().read(parts[0].unionByName(parts[1]), as_of()).groupBy("source").agg(F.count("*").alias("n"))


@R.add("s14_health", "SELECT source, count(*) AS failed FROM (SELECT source, arg_max(st, ts) AS st FROM (SELECT source, city, record_id AS ts, CASE WHEN record_id % 3 = 0 THEN 500 WHEN record_id % 3 = 1 THEN 200 ELSE 0 END AS st FROM event_records) GROUP BY source, city) WHERE st <> 200 GROUP BY source")
def s14_health(spark, sf_dir):
    """Feeds and towns whose last fetch failed, counted by feed."""
    st = F.when(F.col("record_id") % 3 == 0, 500).when(F.col("record_id") % 3 == 1, 200)
    log = records(spark, sf_dir).select(F.concat_ws("|", "source", F.coalesce("city", F.lit(""))).alias("source"), st.alias("status"), F.col("record_id").alias("at"))
    return registry.health(log).groupBy(F.substring_index("source", "|", 1).alias("source")).agg(F.count("*").alias("failed"))


@R.add("a03_json_ld", "SELECT record_id, description, nullif(image_url, '') AS image, CASE WHEN length(name) < 60 THEN name END AS place FROM (SELECT record_id, description, image_url, " + _V + " AS name FROM event_records) WHERE description IS NOT NULL AND description <> ''")
def a03_json_ld(spark, sf_dir):
    """Event fields read from linked data embedded in a page."""
    r = records(spark, sf_dir).where("description is not null and description <> ''")
    ld = F.to_json(F.struct(F.lit("Event").alias("@type"), "description", F.nullif("image_url", F.lit("")).alias("image"), F.struct(F.col(_V).alias("name")).alias("location")))
    other = '<script type="application/ld+json">{"@type": "Organization", "description": "x"}</script>'
    page = F.concat(F.lit(f"<html>{other}<script type='application/ld+json'>"), ld, F.lit("</script></html>"))
    return r.select("record_id", nested.json_ld(page).alias("x")).select("record_id", "x.*")


@R.add("a05_ranked_offers", "SELECT record_id, list_transform(l, lambda x: x.u)[1] AS first_url, len(l) AS n, 1 AS n_primary FROM (SELECT record_id, list_sort(list_transform(ticket_offers, lambda o: {'n': length(coalesce(o.url, '')), 'u': o.url})) AS l FROM event_records WHERE len(ticket_offers) > 0)")
def a05_ranked_offers(spark, sf_dir):
    """Offers sorted by the length of the link, then the link; the first is primary."""
    n = lambda o: F.length(F.coalesce(o["url"], F.lit("")))
    u = lambda o: F.coalesce(o["url"], F.lit("\U0010ffff"))
    before = lambda a, b: F.when(n(a) < n(b), -1).when(n(a) > n(b), 1).when(u(a) < u(b), -1).when(u(a) > u(b), 1).otherwise(0)
    r = records(spark, sf_dir).where(F.size("ticket_offers") > 0).select("record_id", nested.ranked(F.col("ticket_offers"), before).alias("o"))
    return r.select("record_id", F.get("o", F.lit(0))["url"].alias("first_url"), F.size("o").alias("n"), F.size(F.filter("o", lambda x: x["is_primary"])).alias("n_primary"))


# Dates --------------------------------------------------------------------------------------------------


@R.add("d02_worded_dates", f"WITH {_BASE} SELECT id, d AS day, d AS padded FROM b")
def d02_worded_dates(spark, sf_dir):
    """Dates with month names, in a sentence; an unknown month counts as January where the source wants it."""
    got = dates.worded(fill(f"Start: {_m('worded')} r."))
    odd = dates.worded(F.concat(F.dayofmonth("d").cast("string"), F.lit(" xyz 2026")), 1)
    both = F.when(odd == dates.make(F.lit(2026), F.lit(1), F.dayofmonth("d")), got)
    return base(spark, sf_dir).select("id", got.alias("day"), both.alias("padded"))


@R.add(
    "d03_d05_months",
    "SELECT m AS month_no, s AS seen_month, CASE WHEN m < s THEN y + 1 ELSE y END AS next_rule, CASE WHEN s >= 11 AND m <= 2 THEN y + 1 ELSE y END AS winter_rule, CASE WHEN m < s AND s >= 8 THEN y + 1 ELSE y END AS season_rule, y AS seen_year FROM (SELECT DISTINCT month(o_orderdate) AS s, year(o_orderdate) AS y FROM orders), range(1, 13) t(m)",
)
def d03_d05_months(spark, sf_dir):
    """The three ways to infer a missing year, for every month seen from every month of the orders."""
    seen = read_table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").cast("date").alias("at")).distinct()
    every = seen.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12))))
    rule = lambda r: dates.infer_year(F.col("m"), F.col("at"), r).alias(f"{r}_rule")
    return every.select(F.col("m").alias("month_no"), F.month("at").alias("seen_month"), rule("next"), rule("winter"), rule("season"), F.year("at").alias("seen_year"))


@R.add(
    "d06_ranges",
    f"WITH {_BASE}, w AS (SELECT id, d, CAST(d + CAST(id % 9 AS INT) AS DATE) AS e, id % 4 AS k FROM b), x AS (SELECT *, k = 1 AND month(d) <> month(e) AS broken FROM w) "
    f"SELECT id, CASE WHEN k = 2 THEN least(e, DATE '{AS_OF}') ELSE d END AS first, CASE WHEN k = 3 THEN d ELSE e END AS last FROM x WHERE NOT broken",
)
def d06_ranges(spark, sf_dir):
    """Ranges in four writings: 'd.m - d.m.y', 'd-d month y', 'do d.m.y' and a single day."""
    b = base(spark, sf_dir).withColumns({"e": F.date_add("d", (F.col("id") % 9).cast("int")), "k": F.col("id") % 4})
    month = F.element_at(F.array(*map(F.lit, dates.MONTHS_OF)), F.month("d"))
    dm = lambda c: F.date_format(c, "d.MM")
    full = lambda c: F.date_format(c, "d.MM.yyyy")
    c = F.when(F.col("k") == 0, F.concat(full("d"), F.lit(" - "), full("e"))).when(F.col("k") == 1, F.concat(F.dayofmonth("d").cast("string"), F.lit("-"), F.dayofmonth("e").cast("string"), F.lit(" "), month, F.lit(" "), F.year("d").cast("string"))).when(F.col("k") == 2, F.concat(F.lit("do "), full("e"))).otherwise(full("d"))
    rows = b.where(~((F.col("k") == 1) & (F.month("d") != F.month("e")))).select("id", dates.date_range(c, as_of()).alias("r"))
    return rows.select("id", F.col("r.start").alias("first"), F.col("r.end").alias("last"))


_NAMES = "['" + "', '".join(dates.MONTHS) + "']"


@R.add("d07_whole_months", f"WITH {_BASE} SELECT id, CAST(date_trunc('month', d) AS DATE) AS first, CASE WHEN month(d) = 2 THEN make_date(year(d), 2, 28) ELSE last_day(d) END AS last FROM b")
def d07_whole_months(spark, sf_dir):
    """A month's name and year cover the month; February has 28 days."""
    name = F.element_at(F.array(*map(F.lit, dates.MONTHS)), F.month("d"))
    r = dates.month_range(F.concat_ws(" ", name, F.year("d").cast("string")), as_of())
    return base(spark, sf_dir).select("id", r.alias("r")).select("id", F.col("r.start").alias("first"), F.col("r.end").alias("last"))


@R.add("d10_worded_times", f"WITH {_BASE} SELECT id, CASE id % 4 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN t ELSE '20:00' END AS start FROM b")
def d10_worded_times(spark, sf_dir):
    """Times in running text: with 'godz.', with a point, without a leading zero, and missing."""
    short = F.regexp_replace("t", "^0", "")
    c = F.when(F.col("id") % 4 == 0, F.concat(F.lit("Start godz. "), F.col("t"))).when(F.col("id") % 4 == 1, F.concat(F.lit("o "), F.replace("t", F.lit(":"), F.lit(".")))).when(F.col("id") % 4 == 2, F.concat(short, F.lit(" w foyer"))).otherwise(F.lit("wieczorem"))
    return base(spark, sf_dir).select("id", dates.time_of(c, "20:00").alias("start"))


@R.add("d11_time_blocks", f"WITH {_BASE} SELECT id, CASE WHEN id % 3 = 2 THEN 'Całodniowe' ELSE t END AS start, CASE WHEN id % 3 = 1 THEN '23:45' END AS stop, id % 3 = 2 AS all_day FROM b")
def d11_time_blocks(spark, sf_dir):
    """Blocks with a start, a start and an end, or a whole day."""
    c = F.when(F.col("id") % 3 == 0, F.concat(F.lit("od "), F.col("t"))).when(F.col("id") % 3 == 1, F.concat(F.col("t"), F.lit(" - 23:45"))).otherwise(F.lit("Wydarzenie całodzienne"))
    return base(spark, sf_dir).select("id", dates.time_block(c).alias("b")).select("id", "b.start", F.col("b.end").alias("stop"), "b.all_day")


# Text and rules -----------------------------------------------------------------------------------------

_UNGLUED = "description"
for _p, _to in ((r"([\wąćęłńóśźżĄĆĘŁŃÓŚŹŻ])\(", r"\1 ("), (r"\)([\wąćęłńóśźżĄĆĘŁŃÓŚŹŻ])", r") \1"), (r"([a-ząćęłńóśźż])([A-ZĄĆĘŁŃÓŚŹŻ]{2,})", r"\1 \2"), (r"([a-ząćęłńóśźż])([A-ZĄĆĘŁŃÓŚŹŻ][a-ząćęłńóśźż])", r"\1 \2")):
    _UNGLUED = f"regexp_replace({_UNGLUED}, '{_p}', '{_to}', 'g')"


@R.add("t08_scrub_generated", "SELECT record_id, CASE record_id % 3 WHEN 0 THEN 'Opis ' || record_id WHEN 1 THEN '18:00' ELSE 'Opis  koniec' END AS shown FROM event_records")
def t08_scrub_generated(spark, sf_dir):
    """Generated texts without a leading 'np.', an alternative and broken pieces, one kind a record."""
    n = F.col("record_id").cast("string")
    c = F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("  Np. Opis "), n)).when(F.col("record_id") % 3 == 1, F.lit("18:00 lub Całodniowe")).otherwise(F.lit("Opis zep?suty koniec??"))
    return records(spark, sf_dir).select("record_id", text.scrub_generated(c).alias("shown"))


@R.add("t08_scrub_descriptions")
def t08_scrub_descriptions(spark, sf_dir):
    """All descriptions as if they were generated. Normal form KC has no SQL."""
    return records(spark, sf_dir).where("description is not null").select("record_id", text.scrub_generated(F.col("description")).alias("shown"))


@R.add("t14_unglued", f"SELECT record_id, {_UNGLUED} AS shown FROM (SELECT record_id, replace(description, '. ', '(x)') || 'KoniecOpisu' AS description FROM event_records WHERE description IS NOT NULL)")
def t14_unglued(spark, sf_dir):
    """Glued words parted, in descriptions whose full stops were glued into brackets."""
    r = records(spark, sf_dir).where("description is not null")
    return r.select("record_id", text.unglue(F.concat(F.replace("description", F.lit(". "), F.lit("(x)")), F.lit("KoniecOpisu"))).alias("shown"))


@R.add("t09_every_entity", "SELECT record_id, CASE WHEN record_id % 2 = 0 THEN 'é' || record_id || 'ó ł &lt; „x' ELSE 'a & b ' || record_id END AS shown FROM event_records")
def t09_every_entity(spark, sf_dir):
    """Markup and entities of any kind taken out; texts with common entities only stay native."""
    n = F.col("record_id").cast("string")
    c = F.when(F.col("record_id") % 2 == 0, F.concat(F.lit("<p>&eacute;"), n, F.lit("&#243;&nbsp;<b>&#x142;</b> &amp;lt; &bdquo;x</p>"))).otherwise(F.concat(F.lit("a &amp; <i>b</i> "), n))
    return records(spark, sf_dir).select("record_id", text.strip_html(c, every_entity=True).alias("shown"))


@R.add("t16_seo_title", "SELECT record_id, 'Pokaz ' || record_id AS title FROM event_records")
def t16_seo_title(spark, sf_dir):
    """Page titles with the suffixes that search engines like, taken off."""
    n = F.concat(F.lit("Pokaz "), F.col("record_id").cast("string"))
    c = F.when(F.col("record_id") % 3 == 0, F.concat(n, F.lit(" - Opole | Bilety online"))).when(F.col("record_id") % 3 == 1, F.concat(n, F.lit(" – bilety"))).otherwise(F.concat(n, F.lit(", Opole - Bilety")))
    return records(spark, sf_dir).select("record_id", text.clean_seo_title(c, "Opole").alias("title"))


@R.add("t17_role_rewrite", "SELECT record_id, CASE record_id % 3 WHEN 0 THEN 'Muzyk (Jan ' || record_id || ')' WHEN 1 THEN 'Gra na flecie - solo (Ewa)' ELSE 'Bez roli' END AS shown FROM event_records")
def t17_role_rewrite(spark, sf_dir):
    """'muzyk - X' written as 'Muzyk (X)'."""
    c = F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("muzyk - Jan "), F.col("record_id").cast("string"))).when(F.col("record_id") % 3 == 1, F.lit("gra na flecie - solo - Ewa")).otherwise(F.lit("Bez roli"))
    return records(spark, sf_dir).select("record_id", text.role_shown(c).alias("shown"))


@R.add("t18_fallback_text", f"WITH {_BASE} SELECT id, CASE WHEN id % 2 = 0 THEN 'Opis' ELSE 'Pokaz ' || id || '. Czas: ' || d || ' ' || t || '.' END AS shown FROM b")
def t18_fallback_text(spark, sf_dir):
    """The description, or a sentence made of the other fields."""
    b = base(spark, sf_dir).withColumns({"description": F.when(F.col("id") % 2 == 0, "Opis").otherwise(F.lit("")), "title": F.concat(F.lit("Pokaz "), F.col("id").cast("string"))})
    return b.select("id", text.filled_or(F.col("description"), "{title}. Czas: {d} {t}.").alias("shown"))


@R.add("t12_cut_lengths", "SELECT record_id, " + ", ".join(f"CASE WHEN length(description) > {n} THEN concat(CASE WHEN contains(description[1:{n}], ' ') THEN regexp_extract(description[1:{n}], '(?s)^(.*) ', 1) ELSE description[1:{n}] END, '...') ELSE description END AS cut_{n}" for n in (20, 60, 300)) + " FROM event_records WHERE description IS NOT NULL")
def t12_cut_lengths(spark, sf_dir):
    """Descriptions cut at a word at three lengths."""
    return records(spark, sf_dir).where("description is not null").select("record_id", *[text.cut_at_word(F.col("description"), n).alias(f"cut_{n}") for n in (20, 60, 300)])


@R.add("t19_geometry", "SELECT record_id, CAST(('0x' || right(md5(title), 1))::INT % 8 AS INT) AS palette, CAST(('0x' || md5(title)[1:2])::INT % 60 + 20 AS INT) AS x, CAST(('0x' || md5(title)[3:4])::INT % 60 + 20 AS INT) AS y, CAST(('0x' || md5(title)[5:6])::INT % 40 + 30 AS INT) AS radius FROM event_records WHERE title IS NOT NULL")
def t19_geometry(spark, sf_dir):
    """Palette and circle of the placeholder poster, from digits of the title's hash."""
    r = records(spark, sf_dir).where("title is not null").select("record_id", text.palette_index(F.col("title")).alias("palette"), text.poster_circle(F.col("title")).alias("c"))
    return r.select("record_id", "palette", "c.*")


@R.add("c12_candidate_venue", "SELECT record_id, CASE WHEN record_id % 3 = 0 THEN 'Klub Nowy' WHEN record_id % 3 = 1 THEN 'Piwnica' ELSE 'Starograb' END AS venue FROM event_records")
def c12_candidate_venue(spark, sf_dir):
    """The venue among the parts of a card's text: a preferred word first, then any fitting part, then the town."""
    c = F.when(F.col("record_id") % 3 == 0, "Jazz | Piwnica | Klub Nowy | 19:30 | 45 zł").when(F.col("record_id") % 3 == 1, "19:30 | Piwnica | 12.07.2026").otherwise(F.lit("19:30 | 45 zł | x"))
    return records(spark, sf_dir).select("record_id", rules.pick_candidate(c, ["klub", "teatr"], F.lit("Starograb")).alias("venue"))


_C13 = "CASE WHEN regexp_matches(t, '(^|[^\\wą-ż])(tylko\\s+dla\\s+dorosłych|od\\s+18\\s*lat)($|[^\\wą-ż])') THEN '18+' WHEN regexp_matches(t, '(^|[^\\wą-ż])(od\\s+16\\s*lat|dla\\s+widzów\\s+od\\s+16)($|[^\\wą-ż])') THEN '16+' WHEN regexp_matches(t, '(^|[^\\wą-ż])(dla\\s+dzieci|spektakl\\s+familijny)($|[^\\wą-ż])') THEN 'Dla dzieci' END"


@R.add(
    "c13_age_warnings",
    f"SELECT record_id, {_C13} AS age_limit, concat_ws(', ', CASE WHEN record_id % 5 = 1 THEN 'światła stroboskopowe' END, CASE WHEN record_id % 5 IN (1, 2) THEN 'dym sceniczny' END, CASE WHEN record_id % 5 = 3 THEN 'dosadny język' END, CASE WHEN record_id % 5 = 4 THEN 'efekty hukowe / wystrzały' END) AS warnings FROM (SELECT record_id, lower(coalesce(title, '') || ' ' || coalesce(age_limit, '') || CASE record_id % 7 WHEN 0 THEN ' od 18 lat' WHEN 1 THEN ' Spektakl familijny.' WHEN 2 THEN ' dla widzów od 16' ELSE '' END) AS t FROM event_records)",
)
def c13_age_warnings(spark, sf_dir):
    """Age limits and sensory warnings named in texts."""
    age = F.when(F.col("record_id") % 7 == 0, " od 18 lat").when(F.col("record_id") % 7 == 1, " Spektakl familijny.").when(F.col("record_id") % 7 == 2, " dla widzów od 16").otherwise("")
    k = F.col("record_id") % 5
    told = F.when(k == 1, "Używamy stroboskopu: światła stroboskopowe; używane są dymy.").when(k == 2, "Efekty dymne w finale").when(k == 3, "Wulgaryzmy!").when(k == 4, "wystrzały na scenie").otherwise("Bez uwag")
    about = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("age_limit", F.lit("")), age)
    told = F.replace(told, F.lit("światła stroboskopowe"), F.lit("stroboskopowe"))
    return records(spark, sf_dir).select("record_id", rules.age_limit(about).alias("age_limit"), rules.warnings(told, rules.SENSORY).alias("warnings"))


_PK = "parkings"


@R.add("c15_parking_texts", "SELECT osm_id, CASE WHEN capacity IS NOT NULL THEN CASE WHEN fee THEN 'Płatny' ELSE 'Bezpłatny' END || ' (' || m || 'm, ul. Leśna)' WHEN fee IS NOT NULL THEN CASE WHEN fee THEN 'Płatny parking' ELSE 'Bezpłatny parking' END || ' (~' || m || 'm)' ELSE 'Dostępny w strefie miejskiej' END AS shown FROM (SELECT DISTINCT osm_id, capacity, fee, length(osm_id) * 10 AS m FROM parkings)")
def c15_parking_texts(spark, sf_dir):
    """Parking sentence of a page: details, else the nearest car park, else a general one."""
    p = read_table(spark, sf_dir, "parkings").select("osm_id", "capacity", "fee").distinct()
    m = F.length("osm_id") * 10
    detail = F.when(F.col("capacity").isNotNull(), F.struct(F.when(F.col("fee"), "Płatny").otherwise("Bezpłatny").alias("fee_label"), m.alias("distance_m"), F.lit("Leśna").alias("street")))
    nearest = F.when(F.col("fee").isNotNull(), F.struct(m.alias("distance_m"), F.col("fee").alias("is_fee")))
    return p.select("osm_id", rules.parking_text(detail, nearest).alias("shown"))


@R.add("f07_garbage", f"SELECT record_id FROM event_records WHERE NOT coalesce(source IN ('biletoraj_pl', 'kupmiejsce_pl') AND (lower(trim(title)) IN ('kup bilet', 'kup bilety', 'bilety', 'szczegóły') OR regexp_matches(lower(title), 'bilety online|opis, recenzje|2026, 2027|2026/2027|bilety') OR length(trim({_V})) > 25 OR lower(trim({_V})) IN ('obiekt widowiskowy', 'wydarzenie')), false)")
def f07_garbage(spark, sf_dir):
    """Rows of aggregators that aren't garbage: button titles, search spam, long and generic venues."""
    spam = ["bilety online", "opis, recenzje", "2026, 2027", "2026/2027", "bilety"]
    bad = agenda.garbage(F.col("source"), F.col("title"), F.trim(_V), ["biletoraj_pl", "kupmiejsce_pl"], ["kup bilet", "kup bilety", "bilety", "szczegóły"], ["obiekt widowiskowy", "wydarzenie"], 25, spam)
    return records(spark, sf_dir).where(~F.coalesce(bad, F.lit(False))).select("record_id")


@R.add("j16_stage_specs", "SELECT record_id, CASE lower(trim(stage_name)) WHEN 'duża scena' THEN true WHEN 'mała scena' THEN false ELSE false END AS wheelchair, CASE lower(trim(stage_name)) WHEN 'duża scena' THEN true ELSE false END AS loop FROM event_records")
def j16_stage_specs(spark, sf_dir):
    """Equipment of a stage by its name; unknown stages have none."""
    table = {"duża scena": {"wheelchair": True, "loop": True}, "mała scena": {"wheelchair": False, "loop": False}}
    got = rules.lookup(F.trim("stage_name"), table, {"wheelchair": False, "loop": False})
    return records(spark, sf_dir).select("record_id", got.alias("s")).select("record_id", "s.*")


@R.add("j17_known_venue", f"SELECT record_id, CASE WHEN contains(lower({_V}), 'mdk') THEN 'Miejski Dom Kultury' WHEN contains(lower({_V}), 'iglica') THEN 'Muzeum Iglica' END AS venue, CASE WHEN contains(lower({_V}), 'mdk') THEN 'Rynek 1' WHEN contains(lower({_V}), 'iglica') THEN 'ul. Leśna 2' END AS address FROM event_records")
def j17_known_venue(spark, sf_dir):
    """Canonical venue and address by a word of the text, in order."""
    table = [(["mdk"], {"venue": "Miejski Dom Kultury", "address": "Rynek 1"}), (["iglica"], {"venue": "Muzeum Iglica", "address": "ul. Leśna 2"})]
    return records(spark, sf_dir).select("record_id", rules.known_venue(F.col(_V), table).alias("v")).select("record_id", "v.*")


@R.add("j10_details_by_link", "SELECT s.id, count(d.url) AS n_details, max(d.body) AS body FROM stored_events s LEFT JOIN (SELECT source_url AS url, 'opis ' || id AS body FROM stored_events WHERE id % 3 <> 0) d ON d.url = s.source_url GROUP BY s.id")
def j10_details_by_link(spark, sf_dir):
    """Stored events with the details fetched for their links; a third of the pages is missing."""
    s = read_table(spark, sf_dir, "stored_events").select("id", "source_url")
    got = s.where("id % 3 <> 0").select(F.col("source_url").alias("url"), F.concat(F.lit("opis "), F.col("id").cast("string")).alias("body"))
    return joins.with_details(s, got, "source_url").select("id", F.when(F.col("body").isNotNull(), 1).otherwise(0).cast("bigint").alias("n_details"), "body")


@R.add("j15_cached_links", "SELECT DISTINCT s.id FROM stored_events s SEMI JOIN (SELECT 'https://brzostow.portal.example/' || regexp_extract(source_url, '[^/]*$', 0) AS u FROM stored_events) c ON c.u = s.source_url")
def j15_cached_links(spark, sf_dir):
    """Stored events whose link is in a cache that holds the pages of one portal under every page name."""
    s = read_table(spark, sf_dir, "stored_events").select("id", "source_url")
    cache = s.select(F.concat(F.lit("https://brzostow.portal.example/"), F.regexp_extract("source_url", "[^/]*$", 0)).alias("source_url"))
    return joins.cached(s, cache, "source_url").select("id")


@R.add("w03_best_offer", "SELECT record_id, first_value(o.url) OVER (PARTITION BY record_id ORDER BY length(coalesce(o.price, '')) DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS url FROM (SELECT record_id, unnest(ticket_offers) AS o, generate_subscripts(ticket_offers, 1) AS i FROM event_records) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY i) = 1")
def w03_best_offer(spark, sf_dir):
    """The offer of each record with the highest score (length of its price), the first of equal ones."""
    o = records(spark, sf_dir).select("record_id", F.posexplode("ticket_offers").alias("i", "o"))
    best = dedup.first_by(o.withColumn("_s", -F.length(F.coalesce("o.price", F.lit("")))), ["record_id"], "_s", "i")
    return best.select("record_id", "o.url")
