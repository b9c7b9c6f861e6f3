"""Driver queries over the event tables: scalars, filters, windows, aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plakat.functions import dates, nested, text, url
from plakat.operators import agenda, audit, dedup, joins, offers, rules
from plakat.plans.registry import Registry
from plakat.runtime import read_table

R = Registry()
AS_OF = "2026-06-10"

_LET = "\\p{L}\\p{N}_"
_SRC, _DST = text.ACCENTS_FROM, text.ACCENTS_TO
_FULL = f"translate(%s, '{_SRC}łŁ', '{_DST}lL')"


def records(spark, sf_dir):
    return read_table(spark, sf_dir, "event_records")


def as_of():
    return F.lit(AS_OF).cast("date")


# Text ---------------------------------------------------------------------------------------------------

_SLUG = f"trim(regexp_replace(regexp_replace(lower({_FULL % 'title'}), '[^{_LET}\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '-')"


@R.add("t01_slug", f"SELECT record_id, {_SLUG} AS slug FROM event_records WHERE title IS NOT NULL")
def t01_slug(spark, sf_dir):
    """Slugs of all titles."""
    return records(spark, sf_dir).where("title is not null").select("record_id", text.slugify(F.col("title")).alias("slug"))


@R.add("t02_title_key", f"SELECT record_id, array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(title), '20\\d{{2}}', '', 'g'), '[^{_LET}\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1)), ' ') AS title_key FROM event_records WHERE title IS NOT NULL")
def t02_title_key(spark, sf_dir):
    """Order-free keys of all titles."""
    return records(spark, sf_dir).where("title is not null").select("record_id", text.title_key(F.col("title")).alias("title_key"))


_STOP = ", ".join(f"'{w}'" for w in text.VENUE_STOPWORDS + text.town_forms("starograb"))


@R.add(
    "t03_venue_tokens",
    f"SELECT record_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace(translate(venue, '{_SRC}', '{_DST}'), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP})), ' ') AS tokens FROM (SELECT record_id, analysis.ticket_info.venue_name AS venue FROM event_records) WHERE venue IS NOT NULL",
)
def t03_venue_tokens(spark, sf_dir):
    """Tokens of venue texts without stop words and town forms."""
    v = F.col("analysis.ticket_info.venue_name")
    return records(spark, sf_dir).where(v.isNotNull()).select("record_id", F.array_join(text.venue_tokens(v, "starograb"), " ").alias("tokens"))


@R.add("t04_acronym", "SELECT place_id, CASE WHEN len(w) >= 2 THEN array_to_string(list_transform(w, lambda x: x[1]), '') ELSE '' END AS acronym FROM (SELECT place_id, string_split(name, ' ') AS w FROM venue_refs)")
def t04_acronym(spark, sf_dir):
    """Initials of venue names."""
    return read_table(spark, sf_dir, "venue_refs").select("place_id", text.acronym(F.split("name", " ")).alias("acronym"))


_STEM = "CASE " + " ".join(f"WHEN length(w) > {len(e) + 3} AND w LIKE '%{e}' THEN left(w, length(w) - {len(e)})" for e in text.STEM_ENDINGS) + " ELSE w END"


@R.add("t05_stems", f"SELECT w AS word, {_STEM} AS stem, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(description), '[a-ząćęłńóśźż]{{3,}}')) AS w FROM event_records) GROUP BY ALL")
def t05_stems(spark, sf_dir):
    """Stems of description words with their frequency."""
    w = records(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("description"), F.lit("([a-ząćęłńóśźż]{3,})"), 1)).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).withColumn("stem", text.stem(F.col("word")))


@R.add(
    "t06_clean_title",
    r"""SELECT record_id, CASE WHEN coalesce(title, '') = '' THEN 'Wydarzenie' ELSE trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(title), '(?i)\s*-\s*(?:Opole|Bielsko|Kędzierzyn|Bilety|Kup|Amfiteatr|NCPP|NCK|MOK|Dom Kultury|\d{1,2}\s+[a-ząćęłńóśźż]+).*$', ''), '\s*\|\s*.*$', ''), '(?i)\s*\([^)]*(?:Narodowe|Centrum|Amfiteatr|Kultury|Piosenki)[^)]*\)', '', 'g'), '(?i),\s*\d{1,2}\s+[a-ząćęłńóśźż]+.*$', ''), ' -:,') END AS title FROM event_records""",
)
def t06_clean_title(spark, sf_dir):
    """Titles without appended towns, venues and dates."""
    return records(spark, sf_dir).select("record_id", text.clean_title(F.col("title")).alias("title"))


@R.add("t07_scrub")
def t07_scrub(spark, sf_dir):
    """All titles in normal form KC without broken pieces. DuckDB has no such form, so no SQL; see t07_marks."""
    return records(spark, sf_dir).where("title is not null").select("record_id", text.scrub(F.col("title")).alias("title"))


@R.add("t07_marks", "SELECT record_id, CASE record_id % 4 WHEN 0 THEN 'Pokaz ' || record_id WHEN 1 THEN 'Co dalej' WHEN 2 THEN 'fi 1/2 ' || record_id ELSE 'i  dalej' END AS title FROM event_records")
def t07_marks(spark, sf_dir):
    """Broken pieces of every kind, one a record: entities, question marks, words with one inside, and characters with a compatibility form."""
    n, k = F.col("record_id").cast("string"), F.col("record_id") % 4
    c = F.when(k == 0, F.concat(F.lit("Pokaz &#65533;"), n)).when(k == 1, F.lit("Co dalej???")).when(k == 2, F.concat(F.lit("\ufb01 \u00bd "), n)).otherwise(F.lit("i sąs?iedzi dalej"))
    return records(spark, sf_dir).select("record_id", F.replace(text.scrub(c), F.lit("\u2044"), F.lit("/")).alias("title"))


_UNESC = "text"
for _k, _v in text.ENTITIES.items():
    _UNESC = f"replace({_UNESC}, '{_k}', '{_v.replace(chr(39), chr(39) * 2)}')"


@R.add("t09_strip_html", rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace({_UNESC}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents WHERE text IS NOT NULL")
def t09_strip_html(spark, sf_dir):
    """Digest of each document's text without markup."""
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(text.strip_html(F.col("text")).cast("binary")).alias("digest"))


@R.add("t11_lead", "SELECT doc_id, CASE WHEN length(text) > 275 THEN concat(rtrim(text[1:272]), '...') ELSE text END AS lead FROM documents WHERE text IS NOT NULL")
def t11_lead(spark, sf_dir):
    """Leads of 275 characters."""
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.lead(F.col("text")).alias("lead"))


@R.add("t12_cut_at_word", "SELECT doc_id, CASE WHEN length(text) > 180 THEN concat(CASE WHEN contains(text[1:180], ' ') THEN regexp_extract(text[1:180], '(?s)^(.*) ', 1) ELSE text[1:180] END, '...') ELSE text END AS cut FROM documents WHERE text IS NOT NULL")
def t12_cut_at_word(spark, sf_dir):
    """Texts cut at a word boundary."""
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.cut_at_word(F.col("text"), 180).alias("cut"))


@R.add("t13_first_sentence", "SELECT doc_id, trim(split_part(text, '. ', 1)) AS sentence FROM documents WHERE text IS NOT NULL")
def t13_first_sentence(spark, sf_dir):
    """First sentences."""
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@R.add("t15_paragraphs", r"SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda p: length(trim(p)) >= 40 AND NOT contains(lower(p), 'bilety') AND NOT contains(lower(p), 'zapraszamy'))[1:4], chr(10) || chr(10))) AS digest FROM documents WHERE text IS NOT NULL")
def t15_paragraphs(spark, sf_dir):
    """The first four telling paragraphs."""
    kept = text.keep_paragraphs(F.split("text", "\n"), 40, ["bilety", "zapraszamy"])
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(kept.cast("binary")).alias("digest"))


@R.add("t17_role_pair", "SELECT record_id, CASE WHEN regexp_matches(title, '[–—]') THEN trim(regexp_extract(title, '^(.*?)\\s*[–—]\\s*(.*)$', 1)) WHEN contains(title, ' - ') THEN trim(regexp_extract(title, '^(.*) - (.*)$', 1)) END AS role, trim(CASE WHEN regexp_matches(title, '[–—]') THEN regexp_extract(title, '^(.*?)\\s*[–—]\\s*(.*)$', 2) WHEN contains(title, ' - ') THEN regexp_extract(title, '^(.*) - (.*)$', 2) ELSE title END) AS person FROM event_records WHERE title IS NOT NULL")
def t17_role_pair(spark, sf_dir):
    """Both sides of a dash in all titles."""
    return records(spark, sf_dir).where("title is not null").select("record_id", text.role_pair(F.col("title")).alias("p")).select("record_id", "p.role", "p.person")


@R.add("t19_palette", "SELECT record_id, CAST(('0x' || right(md5(title), 1))::INT % 8 AS INT) AS palette FROM event_records WHERE title IS NOT NULL")
def t19_palette(spark, sf_dir):
    """Palette of the placeholder poster."""
    return records(spark, sf_dir).where("title is not null").select("record_id", text.palette_index(F.col("title")).alias("palette"))


@R.add("t20_venue_display", "SELECT record_id, CASE WHEN nullif(trim(stage_name), '') IS NOT NULL AND trim(stage_name) <> v THEN v || ' (' || trim(stage_name) || ')' ELSE v END AS shown FROM (SELECT record_id, stage_name, analysis.ticket_info.venue_name AS v FROM event_records)")
def t20_venue_display(spark, sf_dir):
    """Venue with its stage."""
    return records(spark, sf_dir).select("record_id", text.venue_display(F.col("analysis.ticket_info.venue_name"), F.col("stage_name")).alias("shown"))


# URL ----------------------------------------------------------------------------------------------------

_QUERY = "array_to_string(list_filter(string_split(CASE WHEN contains(b, '?') THEN b[strpos(b, '?') + 1:] ELSE '' END, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=]*|fbclid|gclid|_ga)(=.*)?$')), '&')"


@R.add("u01_clean_url", f"SELECT record_id, trim(CASE WHEN contains(b, '?') THEN split_part(b, '?', 1) || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END ELSE b END) AS url FROM (SELECT record_id, split_part(source_url, '#', 1) AS b FROM event_records)")
def u01_clean_url(spark, sf_dir):
    """Links without tracking."""
    return records(spark, sf_dir).select("record_id", url.clean_url(F.col("source_url")).alias("url"))


@R.add("u02_repeated_urls", "SELECT url, count(*) AS n FROM (SELECT regexp_extract(source_url, '^([^#?]*)', 1) AS url FROM event_records) WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1")
def u02_repeated_urls(spark, sf_dir):
    """Pages delivered more than once."""
    u = records(spark, sf_dir).select(url.url_identity(F.col("source_url")).alias("url")).where("url is not null")
    return u.groupBy("url").agg(F.count("*").alias("n")).where("n > 1")


@R.add("u03_hosts", "SELECT lower(regexp_extract(source_url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS host, count(*) AS n FROM event_records WHERE source_url IS NOT NULL GROUP BY 1")
def u03_hosts(spark, sf_dir):
    """Records by host."""
    return records(spark, sf_dir).where("source_url is not null").groupBy(url.netloc(F.col("source_url")).alias("host")).agg(F.count("*").alias("n"))


INSTITUTIONS = {"kultura.starograb.example": "Kultura Starograb", "mdk.modrzewin.example": "MDK Modrzewin"}
AGGREGATORS = {"biletoraj.example": "Biletoraj", "kupmiejsce.example": "KupMiejsce", "eventoskop.test": "Eventoskop", "scenomat.test": "Scenomat"}
WORDS = ["teatr", "filharmonia", "opera", "amfiteatr", "bilety."]
_AGG = " OR ".join(f"contains(u, '{a}')" for a in AGGREGATORS)


@R.add(
    "u04_provider",
    "SELECT record_id, " + ", ".join(
        f"CASE WHEN coalesce(u, '') = '' THEN {empty} " + " ".join(f"WHEN contains(u, '{d}') THEN {inst % {'n': n}}" for d, n in INSTITUTIONS.items())
        + f" WHEN ({' OR '.join(f'''contains(u, '{w}')''' for w in WORDS)}) AND NOT ({_AGG}) THEN {word} " + " ".join(f"WHEN contains(u, '{d}') THEN {agg % {'n': n}}" for d, n in AGGREGATORS.items()) + f" WHEN length(org) > 2 THEN {named} ELSE {unknown} END AS {name}"
        for name, empty, inst, word, agg, named, unknown in (
            ("authority", "10", "100%(n).0s", "100", "80%(n).0s", "100", "10"),
            ("seller", "coalesce(nullif(organizer, ''), 'Bilety')", "'%(n)s'", "coalesce(nullif(org, ''), 'Oficjalna kasa')", "'%(n)s'", "org", "'Bilety'"),
            ("official", "false", "true%(n).0s", "true", "false%(n).0s", "true", "false"),
        )
    ) + " FROM (SELECT record_id, lower(source_url) AS u, organizer, trim(organizer) AS org FROM event_records)",
)
def u04_provider(spark, sf_dir):
    """Seller behind each link."""
    p = url.provider(F.col("source_url"), F.col("organizer"), INSTITUTIONS, AGGREGATORS, WORDS)
    return records(spark, sf_dir).select("record_id", p.alias("p")).select("record_id", "p.authority", F.col("p.name").alias("seller"), "p.official")


@R.add("u05_u09_built_urls", f"SELECT record_id, source_url || CASE WHEN contains(source_url, '?') THEN '&' ELSE '?' END || 'ref=portal' AS decorated, source_url || '#' || concat_ws('-', city, date_start) AS instance, 'local://' || city || '/' || {_SLUG} || '-' || date_start AS local_url, 'https://a.example/kup/' || regexp_replace(source_url, '^https?://[^/]*/', '') AS joined FROM event_records WHERE source_url IS NOT NULL AND title IS NOT NULL")
def u05_u09_built_urls(spark, sf_dir):
    """Decorated, instance, synthetic and joined links of all titles."""
    u = F.col("source_url")
    rel = F.regexp_replace(u, "^https?://[^/]*/?", "")
    r = records(spark, sf_dir).where("title is not null and source_url is not null")
    return r.select("record_id", url.with_parameter(u, "ref", "portal").alias("decorated"), url.with_fragment(u, F.col("city"), F.col("date_start")).alias("instance"), url.local_url(F.col("city"), F.col("title"), F.col("date_start")).alias("local_url"), url.absolute(rel, "https://a.example/kup/x.html").alias("joined"))


@R.add("u06_landing", "SELECT record_id, len(p) < 2 OR coalesce(p[1] IN ('e'), false) AS landing FROM (SELECT record_id, list_filter(string_split(regexp_replace(regexp_extract(source_url, '^([^#?]*)', 1), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*', ''), '/'), lambda x: x <> '') AS p FROM event_records WHERE source_url IS NOT NULL)")
def u06_landing(spark, sf_dir):
    """Is the link a landing page?"""
    return records(spark, sf_dir).where("source_url is not null").select("record_id", url.is_landing(F.col("source_url"), ["e"]).alias("landing"))


# Dates --------------------------------------------------------------------------------------------------

_DAY = "coalesce(try_cast(nullif(regexp_extract(date_start, '^(\\d{4}-\\d{2}-\\d{2})', 1), '') AS DATE), try_strptime(nullif(regexp_extract(date_start, '(\\d{1,2}\\.\\d{1,2}\\.\\d{4})', 1), ''), '%d.%m.%Y')::DATE)"


def day():
    c = F.col("date_start")
    return F.coalesce(F.try_to_date(dates.part(c, r"^(\d{4}-\d{2}-\d{2})", 1)), dates.dotted(c))


@R.add("d01_start_day", f"SELECT record_id, {_DAY} AS day FROM event_records")
def d01_start_day(spark, sf_dir):
    """Start day of ISO and dotted dates."""
    return records(spark, sf_dir).select("record_id", day().alias("day"))


_MONTHS = "CASE lower(m) " + " ".join(f"WHEN '{g}' THEN {i} WHEN '{n}' THEN {i}" for i, (n, g) in enumerate(zip(dates.MONTHS, dates.MONTHS_OF, strict=True), 1) if n != g) + " WHEN 'maj' THEN 5 END"


@R.add("d02_worded", f"SELECT doc_id, try_cast('2026-' || lpad(CAST({_MONTHS} AS VARCHAR), 2, '0') || '-' || lpad(d, 2, '0') AS DATE) AS day FROM (SELECT doc_id, regexp_extract(text, 'do (\\d{{1,2}}) ([a-ząćęłńóśźż]+), ', 1) AS d, regexp_extract(text, 'do (\\d{{1,2}}) ([a-ząćęłńóśźż]+), ', 2) AS m FROM documents) WHERE d <> ''")
def d02_worded(spark, sf_dir):
    """Dates with month names in running text, for a given year."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"do (\d{1,2}) ([a-ząćęłńóśźż]+), ", 1).alias("d"), F.regexp_extract("text", r"do (\d{1,2}) ([a-ząćęłńóśźż]+), ", 2).alias("m")).where("d <> ''")
    return d.select("doc_id", dates.make(F.lit(2026), dates.month_number(F.col("m")), F.col("d")).alias("day"))


@R.add("d08_compact", "SELECT o_orderkey, o_orderdate AS at_day FROM orders")
def d08_compact(spark, sf_dir):
    """Compact dates read back."""
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", dates.compact_timestamp(F.date_format("o_orderdate", "yyyyMMdd")).cast("timestamp_ntz").alias("at_day"))


@R.add("d09_zoned", "SELECT event_id, CAST(timezone('Europe/Warsaw', timezone('UTC', ts)) AS DATE) AS day, strftime(timezone('Europe/Warsaw', timezone('UTC', ts)), '%H:%M') AS local_time FROM events")
def d09_zoned(spark, sf_dir):
    """UTC instants as local day and time."""
    z = dates.zoned(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return read_table(spark, sf_dir, "events").select("event_id", z.alias("z")).select("event_id", "z.day", F.col("z.time").alias("local_time"))


@R.add("d10_time", "SELECT record_id, CASE WHEN regexp_matches(t, '^\\d{1,2}:\\d{2}$') THEN lpad(t, 5, '0') ELSE '19:00' END AS start FROM (SELECT record_id, coalesce(time_start, '') AS t FROM event_records)")
def d10_time(spark, sf_dir):
    """Start time with a default."""
    return records(spark, sf_dir).select("record_id", dates.time_of(F.coalesce("time_start", F.lit("")), "19:00").alias("start"))


_DAYS = ", ".join(f"'{d}'" for d in dates.DAYS)
_GEN = ", ".join(f"'{d}'" for d in dates.MONTHS_OF)
_SHORT = ", ".join(f"'{d}'" for d in dates.MONTHS_SHORT)


@R.add("d12_long_date", f"SELECT record_id, coalesce([{_DAYS}][isodow(d)] || ', ' || day(d) || ' ' || [{_GEN}][month(d)], date_start) AS shown FROM (SELECT record_id, date_start, CASE WHEN regexp_full_match(date_start, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(date_start AS DATE) END AS d FROM event_records)")
def d12_long_date(spark, sf_dir):
    """Long Polish dates."""
    return records(spark, sf_dir).select("record_id", dates.long_date(F.col("date_start")).alias("shown"))


@R.add("d13_badge", f"SELECT o_orderkey, [{_SHORT}][month(o_orderdate)] AS month_badge, lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') AS day_badge FROM orders")
def d13_badge(spark, sf_dir):
    """Month and day badges."""
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", dates.month_badge(F.col("o_orderdate")).alias("month_badge"), F.lpad(F.dayofmonth("o_orderdate").cast("string"), 2, "0").alias("day_badge"))


@R.add("d14_doors_gap", "SELECT record_id, (CAST(t[1:2] AS INT) * 60 + CAST(t[4:5] AS INT)) - (CAST(d[1:2] AS INT) * 60 + CAST(d[4:5] AS INT)) >= 45 AS apart FROM (SELECT record_id, time_start AS t, analysis.ticket_info.doors_open AS d FROM event_records) WHERE regexp_full_match(t, '\\d\\d:\\d\\d') AND regexp_full_match(d, '\\d\\d:\\d\\d')")
def d14_doors_gap(spark, sf_dir):
    """Does the start lie 45 minutes or more after the doors?"""
    d = F.col("analysis.ticket_info.doors_open")
    r = records(spark, sf_dir).where(F.col("time_start").rlike(r"^\d\d:\d\d$") & d.rlike(r"^\d\d:\d\d$"))
    return r.select("record_id", dates.times_apart(F.col("time_start"), d).alias("apart"))


# Filters, order, pages ----------------------------------------------------------------------------------

_END = "coalesce(nullif(date_end, ''), date_start)"


@R.add("f01_active", f"SELECT record_id, city, date_start FROM event_records WHERE city = 'starograb' AND {_END} >= '{AS_OF}'")
def f01_active(spark, sf_dir):
    """Events of a town that aren't over."""
    return agenda.active(records(spark, sf_dir), F.lit(AS_OF), town=F.col("city") == "starograb").select("record_id", "city", "date_start")


@R.add("f02_purge", f"SELECT city, count(*) FILTER (WHERE coalesce({_END} < '{AS_OF}', false)) AS purged, count(*) FILTER (WHERE NOT coalesce({_END} < '{AS_OF}', false)) AS kept FROM event_records GROUP BY city")
def f02_purge(spark, sf_dir):
    """Expired and kept rows by town."""
    kept, gone = agenda.purge(records(spark, sf_dir).select("city", "date_start", "date_end"), F.lit(AS_OF))
    both = kept.select("city", F.lit(0).alias("g")).unionByName(gone.select("city", F.lit(1).alias("g")))
    return both.groupBy("city").agg(F.count_if(F.col("g") == 1).alias("purged"), F.count_if(F.col("g") == 0).alias("kept"))


@R.add(
    "f03_periods",
    f"WITH e AS (SELECT record_id, {_DAY} AS s, coalesce(try_cast(date_end AS DATE), {_DAY}) AS e FROM event_records) SELECT record_id, coalesce(e >= DATE '{AS_OF}' AND s <= DATE '{AS_OF}', false) AS today, coalesce(e >= DATE '{AS_OF}' AND s = DATE '{AS_OF}' + 1, false) AS tomorrow, coalesce(e >= DATE '{AS_OF}' AND s <= DATE '2026-06-14' AND e >= DATE '2026-06-12', false) AS weekend, coalesce(e >= DATE '{AS_OF}', false) AS every FROM e",
)
def f03_periods(spark, sf_dir):
    """What is on today, tomorrow, at the weekend, and at all (10 June 2026 is a Wednesday)."""
    s, e = day(), F.coalesce(F.try_to_date("date_end"), day())
    r = records(spark, sf_dir).select("record_id", s.alias("s"), e.alias("e"))
    names = {"today": "today", "tomorrow": "tomorrow", "weekend": "weekend", "every": "all"}
    return r.select("record_id", *[F.coalesce(agenda.overlaps(F.col("s"), F.col("e"), as_of(), p), F.lit(False)).alias(n) for n, p in names.items()])


@R.add("f04_badge", f"WITH e AS (SELECT record_id, {_DAY} AS s, coalesce(try_cast(date_end AS DATE), {_DAY}) AS e FROM event_records) SELECT record_id, CASE WHEN s = DATE '{AS_OF}' THEN 'DZIŚ' WHEN s < DATE '{AS_OF}' AND e >= DATE '{AS_OF}' THEN 'TRWA' WHEN s = DATE '{AS_OF}' + 1 THEN 'JUTRO' END AS badge FROM e")
def f04_badge(spark, sf_dir):
    """Badge of each event."""
    r = records(spark, sf_dir).select("record_id", day().alias("s"), F.coalesce(F.try_to_date("date_end"), day()).alias("e"))
    return r.select("record_id", agenda.badge(F.col("s"), F.col("e"), as_of()).alias("badge"))


@R.add("f06_denied_titles", "SELECT record_id FROM event_records WHERE contains(lower(title), 'warsztaty') OR contains(lower(title), 'pokaz')")
def f06_denied_titles(spark, sf_dir):
    """Titles with a word of a deny list."""
    return records(spark, sf_dir).where(text.contains_any(F.col("title"), ["warsztaty", "pokaz"])).select("record_id")


@R.add("f07_garbage", "SELECT record_id FROM (SELECT *, analysis.ticket_info.venue_name AS v FROM event_records) WHERE source IN ('biletoraj_pl', 'kupmiejsce_pl') AND (lower(trim(title)) IN ('bilety', 'kup bilet') OR length(v) > 30 OR lower(trim(v)) IN ('obiekt widowiskowy', 'plener'))")
def f07_garbage(spark, sf_dir):
    """Aggregator rows that say nothing."""
    v = F.col("analysis.ticket_info.venue_name")
    bad = agenda.garbage(F.col("source"), F.col("title"), v, ["biletoraj_pl", "kupmiejsce_pl"], ["bilety", "kup bilet"], ["obiekt widowiskowy", "plener"], 30)
    return records(spark, sf_dir).where(bad).select("record_id")


@R.add("f08_like", "SELECT id FROM stored_events WHERE title ILIKE '%koncert%' AND source_url LIKE '%portal.example%'")
def f08_like(spark, sf_dir):
    """Substring filters with and without case."""
    return read_table(spark, sf_dir, "stored_events").where(F.col("title").ilike("%koncert%") & F.col("source_url").like("%portal.example%")).select("id")


@R.add("f09_places", "SELECT place_id FROM places_final WHERE length(coalesce(trim(name), '')) >= 3 AND NOT coalesce(contains(lower(name), 'bar'), false) AND NOT coalesce(contains(lower(name), 'siłownia'), false)")
def f09_places(spark, sf_dir):
    """Named places without words of a deny list."""
    return read_table(spark, sf_dir, "places_final").where(agenda.not_junk(F.col("name"), ["bar", "siłownia"])).select("place_id")


@R.add("f10_public_parking", "SELECT osm_id, access FROM parkings WHERE NOT coalesce(lower(access) IN ('private', 'permit', 'no'), false)")
def f10_public_parking(spark, sf_dir):
    """Car parks open to all; unknown access counts as open."""
    return read_table(spark, sf_dir, "parkings").where(agenda.public_access(F.col("access"))).select("osm_id", "access")


@R.add("f11_town_relevance", "SELECT record_id FROM event_records WHERE (coalesce(contains(lower(source_url), 'starograb'), false) OR coalesce(contains(lower(title), 'starograb'), false)) AND NOT (coalesce(contains(lower(source_url), 'mdk'), false) OR coalesce(contains(lower(title), 'mdk'), false))")
def f11_town_relevance(spark, sf_dir):
    """Records that name a town and no excluded word."""
    return records(spark, sf_dir).where(agenda.relevant([F.col("source_url"), F.col("title")], "starograb", ["mdk"])).select("record_id")


@R.add("f13_f14_iso_of_source", "SELECT record_id, coalesce(regexp_full_match(date_start, '\\d{4}-\\d{2}-\\d{2}'), false) AS iso FROM event_records WHERE lower(source) = 'biletoraj_pl'")
def f13_f14_iso_of_source(spark, sf_dir):
    """Date validity of one source, named in any case."""
    return records(spark, sf_dir).where(F.lower("source") == "BILETORAJ_PL".lower()).select("record_id", agenda.iso_date(F.col("date_start")).alias("iso"))


@R.add("f15_guarded", "SELECT count(*) AS n FROM event_records")
def f15_guarded(spark, sf_dir):
    """Counts only if there are enough rows."""
    return agenda.guard(records(spark, sf_dir).select("record_id"), 15).agg(F.count("*").alias("n"))


@R.add("m06_signature", "SELECT record_id FROM event_records QUALIFY row_number() OVER (PARTITION BY date_start, time_start, lower(title) ORDER BY record_id) = 1")
def m06_signature(spark, sf_dir):
    """First record of each date, time and title."""
    return dedup.first_by(records(spark, sf_dir).select("record_id", "date_start", "time_start", F.lower("title").alias("t")), ["date_start", "time_start", "t"], "record_id").select("record_id")


@R.add("o02_first_page", f"SELECT record_id, date_start, CAST(row_number() OVER (ORDER BY date_start, record_id) AS INT) AS position FROM event_records WHERE {_END} >= '{AS_OF}' ORDER BY date_start, record_id LIMIT 40")
def o02_first_page(spark, sf_dir):
    """First page of the agenda."""
    r = agenda.active(records(spark, sf_dir), F.lit(AS_OF)).select("record_id", "date_start").where("date_start is not null")
    return agenda.first_page(r, F.col("date_start"), F.col("record_id"))


# JSON, arrays -------------------------------------------------------------------------------------------


@R.add("a01_json_paths", "SELECT id, coalesce(nullif(json_extract_string(payload, '$.analysis.category'), ''), nullif(json_extract_string(payload, '$.category'), '')) AS category, nullif(json_extract_string(payload, '$.venue'), '') AS venue FROM stored_events")
def a01_json_paths(spark, sf_dir):
    """Fields of payloads with fallbacks."""
    p = F.col("payload")
    return read_table(spark, sf_dir, "stored_events").select("id", nested.json_first(p, "$.analysis.category", "$.category").alias("category"), nested.json_first(p, "$.venue").alias("venue"))


@R.add("a02_round_trip", "SELECT record_id, source, title FROM event_records")
def a02_round_trip(spark, sf_dir):
    """Records encoded as JSON and read back; null fields stay."""
    r = records(spark, sf_dir).select("record_id", nested.encode(F.struct("source", "title")).alias("j"))
    return r.select("record_id", F.from_json("j", "source string, title string").alias("o")).select("record_id", "o.source", "o.title")


@R.add("a04_primary_offer", "SELECT record_id, list_filter(ticket_offers, lambda o: coalesce(o.is_primary, false))[1].url AS url FROM event_records")
def a04_primary_offer(spark, sf_dir):
    """First primary offer."""
    o = nested.first_where(F.col("ticket_offers"), lambda x: F.coalesce(x["is_primary"], F.lit(False)))
    return records(spark, sf_dir).select("record_id", o["url"].alias("url"))


@R.add("a08_address", "SELECT place_id, concat_ws(', ', nullif(trim(address.street), ''), nullif(trim(address.postcode), ''), nullif(trim(address.city), '')) AS line FROM places_final")
def a08_address(spark, sf_dir):
    """Address lines."""
    a = nested.address_line(F.col("address.street"), F.col("address.postcode"), F.col("address.city"))
    return read_table(spark, sf_dir, "places_final").select("place_id", a.alias("line"))


# Offers -------------------------------------------------------------------------------------------------

_OFF = "(SELECT record_id, unnest(ticket_offers) AS o, generate_subscripts(ticket_offers, 1) - 1 AS ord FROM event_records)"


@R.add("e06_e08_offers", "SELECT record_id, seller, min(ord) AS ord, count(*) AS n_offers FROM (SELECT record_id, CAST(ord AS INT) AS ord, coalesce(o.provider, 'Bilety') AS seller FROM " + _OFF + " WHERE coalesce(trim(o.url), '') <> '' UNION ALL SELECT record_id, 0, 'Bilety' FROM event_records WHERE len(list_filter(coalesce(ticket_offers, []), lambda o: coalesce(trim(o.url), '') <> '')) = 0 AND coalesce(source_url, '') <> '') GROUP BY record_id, seller")
def e06_e08_offers(spark, sf_dir):
    """One offer a seller, the page itself where there is none."""
    o = offers.offers_of(records(spark, sf_dir), "record_id", "ticket_offers", F.col("source_url"))
    return offers.dedup_offers(o, "record_id", F.coalesce("provider", F.lit("Bilety")), F.col("price").rlike(r"\d")).select("record_id", "seller", "ord", "n_offers")


_NUM = "CASE WHEN regexp_matches(lower(o.price), 'bezpłat|woln') THEN 0.0 ELSE try_cast(nullif(replace(regexp_extract(o.price, '(\\d+(?:[.,]\\d+)?)', 1), ',', '.'), '') AS DOUBLE) END"
_AUTH = "CASE " + " ".join(f"WHEN contains(lower(trim(o.url)), '{d}') THEN 100" for d in INSTITUTIONS) + f" WHEN ({' OR '.join(f'contains(lower(trim(o.url)), {chr(39)}{w}{chr(39)})' for w in WORDS)}) AND NOT ({' OR '.join(f'contains(lower(trim(o.url)), {chr(39)}{w}{chr(39)})' for w in AGGREGATORS)}) THEN 100 " + " ".join(f"WHEN contains(lower(trim(o.url)), '{d}') THEN 80" for d in AGGREGATORS) + " ELSE 10 END"


@R.add("e07_offer_rank", f"SELECT record_id, ord, CAST(row_number() OVER (PARTITION BY record_id ORDER BY n NULLS LAST, a DESC, ord) AS INT) AS rank, a = 100 AS is_official, row_number() OVER (PARTITION BY record_id ORDER BY n NULLS LAST, a DESC, ord) = 1 AS is_primary FROM (SELECT record_id, CAST(ord AS INT) AS ord, {_NUM} AS n, {_AUTH} AS a FROM " + _OFF + " WHERE coalesce(trim(o.url), '') <> '')")
def e07_offer_rank(spark, sf_dir):
    """Offers by amount, then the authority of the seller behind the link, then position."""
    o = offers.offers_of(records(spark, sf_dir), "record_id", "ticket_offers")
    who = url.provider(F.col("url"), F.lit(None).cast("string"), INSTITUTIONS, AGGREGATORS, WORDS)
    return offers.ranked_by_price(o, "record_id", who).select("record_id", "ord", "rank", "is_official", "is_primary")


@R.add("w01_offer_rank", "SELECT record_id, ord, CAST(row_number() OVER (PARTITION BY record_id ORDER BY length(url) DESC, ord) AS INT) AS rank FROM (SELECT record_id, CAST(ord AS INT) AS ord, trim(o.url) AS url FROM " + _OFF + " WHERE coalesce(trim(o.url), '') <> '')")
def w01_offer_rank(spark, sf_dir):
    """Offers ranked by a stated order."""
    o = offers.offers_of(records(spark, sf_dir), "record_id", "ticket_offers")
    return offers.rank_offers(o, "record_id", F.length("url").desc()).select("record_id", "ord", "rank")


# Classification -----------------------------------------------------------------------------------------

@R.add("t14_paragraphs")
def t14_paragraphs(spark, sf_dir):
    """Number of paragraphs and longest one of each document; stateful packing has no SQL counterpart."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", text.paragraphs(F.col("text")).alias("p"))
    return d.select("doc_id", F.size("p").alias("n"), F.coalesce(F.array_max(F.transform("p", lambda x: F.length(x))), F.lit(0)).alias("longest"))


_CATS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(title), '{w}')" for w in ws) + f" THEN '{v}'" for ws, v in rules.TITLE_CATEGORIES) + " END"


@R.add("c03_title_category", f"SELECT record_id, CASE WHEN coalesce(category IN ('other', 'concert'), true) THEN coalesce({_CATS}, category) ELSE category END AS kind FROM event_records")
def c03_title_category(spark, sf_dir):
    """Categories refined by the title."""
    return records(spark, sf_dir).select("record_id", rules.title_category(F.col("category"), F.col("title"), ["other", "concert"]).alias("kind"))


@R.add("c16_overrides", "SELECT place_id, CASE lower(name) WHEN 'kino rotunda' THEN 'kultura*' WHEN 'bar latarnik' THEN 'gastronomia*' ELSE poi_group END AS shown FROM places_final")
def c16_overrides(spark, sf_dir):
    """Groups overridden for named places."""
    return read_table(spark, sf_dir, "places_final").select("place_id", rules.overridden(F.col("poi_group"), F.col("name"), {"Kino Rotunda": "kultura*", "Bar Latarnik": "gastronomia*"}).alias("shown"))


@R.add("k06_thumbnail_key", f"SELECT record_id, 'ev_' || {_SLUG} || '.webp' AS file FROM event_records WHERE title IS NOT NULL")
def k06_thumbnail_key(spark, sf_dir):
    """File names of pictures of all titles."""
    return records(spark, sf_dir).where("title is not null").select("record_id", text.thumbnail_key("ev", F.col("title")).alias("file"))


HALLS = [(["mała scena"], "mala"), (["duża scena"], "duza"), (["foyer", "piwnica"], "inne")]


@R.add("c11_hall_by_words", "SELECT record_id, CASE WHEN contains(v, 'mała scena') THEN 'mala' WHEN contains(v, 'duża scena') THEN 'duza' WHEN contains(v, 'foyer') OR contains(v, 'piwnica') THEN 'inne' END AS hall FROM (SELECT record_id, lower(analysis.ticket_info.venue_name) AS v FROM event_records)")
def c11_hall_by_words(spark, sf_dir):
    """Hall named in the venue text, first rule wins."""
    return records(spark, sf_dir).select("record_id", rules.by_words(F.col("analysis.ticket_info.venue_name"), HALLS).alias("hall"))


@R.add("c14_access", "SELECT p.place_id, CASE WHEN lower(wheelchair) IN ('yes', 'true', 'tak', 'dostępny') THEN 'yes' WHEN lower(wheelchair) = 'limited' THEN 'limited' WHEN lower(wheelchair) IN ('no', 'false', 'brak', 'nie') THEN 'no' WHEN is_indoor THEN 'yes' WHEN NOT is_indoor THEN 'no' END AS access FROM places_final p")
def c14_access(spark, sf_dir):
    """Access with a fallback level."""
    return read_table(spark, sf_dir, "places_final").select("place_id", rules.access(F.col("wheelchair"), F.col("is_indoor").cast("string")).alias("access"))


FLAGS = {"duration": [r"\d+ minut"], "punctual": ["punktualn"], "booking": ["rezerwacj"]}


@R.add("ag10_flags", "SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(t, '\\d+ minut') THEN 'duration' END, CASE WHEN contains(t, 'punktualn') THEN 'punctual' END, CASE WHEN contains(t, 'rezerwacj') THEN 'booking' END], lambda x: x IS NOT NULL)) AS flag FROM (SELECT lower(description) AS t FROM event_records)) GROUP BY flag")
def ag10_flags(spark, sf_dir):
    """Distribution of text flags."""
    return records(spark, sf_dir).select(F.explode(rules.flags(F.col("description"), FLAGS)).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


# Audits -------------------------------------------------------------------------------------------------

_V = "analysis.ticket_info.venue_name"
_P = "analysis.ticket_info.place_id"


@R.add("ag01_unresolved", f"SELECT city, {_V} AS venue, count(*) AS n, min(record_id) AS first_id FROM event_records WHERE coalesce({_P}, '') = '' AND coalesce({_V}, '') <> '' GROUP BY ALL")
def ag01_unresolved(spark, sf_dir):
    """Venues without a place, with a sample."""
    return audit.unresolved(records(spark, sf_dir), "city", F.col(_V), F.col(_P), "record_id")


@R.add("ag02_top_mappings", f"SELECT '[' || upper(city) || '] ' || {_V} || ' → ' || {_P} AS mapping, count(*) AS n FROM event_records WHERE city IS NOT NULL AND {_V} IS NOT NULL AND {_P} IS NOT NULL GROUP BY 1 ORDER BY n DESC, mapping LIMIT 15")
def ag02_top_mappings(spark, sf_dir):
    """The fifteen most frequent mappings."""
    m = F.concat(F.lit("["), F.upper("city"), F.lit("] "), F.col(_V), F.lit(" → "), F.col(_P))
    return audit.top(records(spark, sf_dir), m, "mapping", 15)


@R.add("ag03_town_audit", f"SELECT city, count(*) FILTER (WHERE coalesce({_P}, '') <> '') AS mapped, count(*) FILTER (WHERE coalesce({_P}, '') = '') AS unmapped, count(DISTINCT {_P}) AS places FROM event_records GROUP BY city")
def ag03_town_audit(spark, sf_dir):
    """Mapped and unmapped records by town."""
    has = F.coalesce(F.col(_P), F.lit("")) != ""
    return records(spark, sf_dir).groupBy("city").agg(F.count_if(has).alias("mapped"), F.count_if(~has).alias("unmapped"), F.countDistinct(F.col(_P)).alias("places"))


@R.add("ag03_places_by_use", f"SELECT city, place, n, kind FROM (SELECT city, coalesce(nullif({_P}, ''), '(' || coalesce({_V}, '') || ')') AS place, count(*) AS n, CASE WHEN coalesce({_P}, '') <> '' THEN 'mapped' ELSE 'unmapped' END AS kind FROM event_records GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY city ORDER BY n DESC, kind, place) <= 15")
def ag03_places_by_use(spark, sf_dir):
    """The 15 most used mapped and unmapped venues of each town, in one list."""
    return audit.places_by_use(records(spark, sf_dir), "city", F.col(_P), F.col(_V), 15)


@R.add("ag04_feed_quality", f"SELECT source, count(*) AS total, count(*) FILTER (WHERE regexp_full_match(date_start, '\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS valid_dates, count(*) FILTER (WHERE date_start >= '{AS_OF}') AS future, count(*) FILTER (WHERE coalesce(image_url, '') <> '') AS with_image, count(*) FILTER (WHERE is_free) AS free, count(*) FILTER (WHERE coalesce(source_url, '') <> '') AS with_url FROM event_records GROUP BY source")
def ag04_feed_quality(spark, sf_dir):
    """Quality report of each feed."""
    return audit.feed_quality(records(spark, sf_dir), F.lit(AS_OF))


@R.add("ag05_histograms", "SELECT 'category' AS what, category AS value, count(*) AS n FROM event_records GROUP BY category UNION ALL SELECT 'group', poi_group, count(*) FROM places_final GROUP BY poi_group")
def ag05_histograms(spark, sf_dir):
    """Histograms of two columns, one table."""
    return audit.histograms({"category": records(spark, sf_dir).select(F.col("category").alias("value")), "group": read_table(spark, sf_dir, "places_final").select(F.col("poi_group").alias("value"))})


@R.add("ag06_ag07_counts", "SELECT count(*) AS n, count(*) FILTER (WHERE is_sold_out) AS sold_out FROM event_records")
def ag06_ag07_counts(spark, sf_dir):
    """Global and conditional counts."""
    return records(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("is_sold_out").alias("sold_out"))


@R.add("ag08_per_place", f"SELECT v.place_id, count(e.record_id) AS n_events, min(e.date_start) AS first_date FROM venue_refs v LEFT JOIN event_records e ON {_P} = v.place_id GROUP BY v.place_id")
def ag08_per_place(spark, sf_dir):
    """Events of each venue; aggregated before the join, so the hot venue costs nothing extra."""
    n = records(spark, sf_dir).where(F.col(_P).isNotNull()).groupBy(F.col(_P).alias("place_id")).agg(F.count("*").alias("n_events"), F.min("date_start").alias("first_date"))
    return read_table(spark, sf_dir, "venue_refs").select("place_id").join(n, "place_id", "left").select("place_id", F.coalesce("n_events", F.lit(0)).alias("n_events"), "first_date")


@R.add("ag11_backlog", f"SELECT v AS venue, count(*) AS active_events, array_to_string(list_sort(list_distinct(list(title)))[1:2], ' | ') AS samples FROM (SELECT {_V} AS v, title FROM event_records WHERE coalesce({_P}, '') = '' AND {_END} >= '{AS_OF}') WHERE v IS NOT NULL AND title IS NOT NULL GROUP BY v")
def ag11_backlog(spark, sf_dir):
    """Venues to be mapped with two sample titles; the samples are two minima, no list of a group is built."""
    r = agenda.active(records(spark, sf_dir), F.lit(AS_OF)).where((F.coalesce(F.col(_P), F.lit("")) == "") & F.col(_V).isNotNull() & F.col("title").isNotNull()).select(F.col(_V).alias("venue"), "title")
    return audit.with_samples(r, "venue", "title")


@R.add("ag12_anomalies", f"SELECT 'no_venue' AS anomaly, count(*) AS n FROM event_records WHERE coalesce({_V}, '') = '' UNION ALL SELECT 'no_place', count(*) FROM event_records WHERE coalesce({_P}, '') = '' UNION ALL SELECT 'dead_place', count(*) FROM event_records WHERE coalesce({_P}, '') <> '' AND {_P} NOT IN (SELECT place_id FROM venue_refs) UNION ALL SELECT 'no_date', count(*) FROM event_records WHERE coalesce(date_start, '') = ''")
def ag12_anomalies(spark, sf_dir):
    """Four classes of anomalies."""
    ids = read_table(spark, sf_dir, "venue_refs").select(F.col("place_id").alias("_known")).distinct()
    r = records(spark, sf_dir).join(ids, F.col(_P) == F.col("_known"), "left")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return audit.anomalies(r, {"no_venue": empty(F.col(_V)), "no_place": empty(F.col(_P)), "dead_place": ~empty(F.col(_P)) & F.col("_known").isNull(), "no_date": empty(F.col("date_start"))})


@R.add("ag13_distinct_sets", "SELECT record_id, array_to_string(list_sort(list_distinct(tags)), ',') AS tags FROM event_records")
def ag13_distinct_sets(spark, sf_dir):
    """Distinct tags of each record."""
    return records(spark, sf_dir).select("record_id", F.array_join(F.array_sort(F.array_distinct("tags")), ",").alias("tags"))


@R.add("j12_dead_keys", f"SELECT record_id, {_P} AS place_id FROM event_records WHERE {_P} IS NOT NULL AND {_P} NOT IN (SELECT place_id FROM venue_refs)")
def j12_dead_keys(spark, sf_dir):
    """Place ids that are in no list."""
    r = records(spark, sf_dir).select("record_id", F.col(_P).alias("place_id"))
    return joins.dead_keys(r, read_table(spark, sf_dir, "venue_refs"), "place_id").select("record_id", "place_id")


@R.add("j13_blind_spots", f"SELECT place_id, name FROM venue_refs WHERE place_id NOT IN (SELECT {_P} FROM event_records WHERE {_P} IS NOT NULL AND {_END} >= '2027-05-01')")
def j13_blind_spots(spark, sf_dir):
    """Venues without an event from May 2027 on."""
    r = agenda.active(records(spark, sf_dir), F.lit("2027-05-01")).select(F.col(_P).alias("place_id"))
    return joins.without_partner(read_table(spark, sf_dir, "venue_refs").select("place_id", "name"), r, "place_id")


@R.add("j14_orphans", f"SELECT record_id FROM event_records WHERE {_P} IS NULL")
def j14_orphans(spark, sf_dir):
    """Records without a place id."""
    return records(spark, sf_dir).where(F.col(_P).isNull()).select("record_id")


@R.add("o03_top_sources", "SELECT source, count(*) AS n FROM event_records GROUP BY source ORDER BY n DESC, source LIMIT 10")
def o03_top_sources(spark, sf_dir):
    """The ten largest feeds."""
    return audit.top(records(spark, sf_dir), F.col("source"), "source", 10)


@R.add("o06_sitemap", "SELECT DISTINCT regexp_extract(source_url, '^([^#?]*)', 1) AS loc FROM event_records WHERE source_url IS NOT NULL")
def o06_sitemap(spark, sf_dir):
    """Distinct page addresses in order."""
    return records(spark, sf_dir).where("source_url is not null").select(url.url_identity(F.col("source_url")).alias("loc")).distinct().orderBy("loc")


@R.add("set_union_sources", "SELECT 'event_records' AS tbl, city, count(*) AS n FROM event_records GROUP BY city UNION ALL SELECT 'places_final', city_tag, count(*) FROM places_final GROUP BY city_tag")
def set_union_sources(spark, sf_dir):
    """UNION ALL of two sources by name."""
    a = records(spark, sf_dir).select(F.lit("event_records").alias("tbl"), "city")
    b = read_table(spark, sf_dir, "places_final").select(F.lit("places_final").alias("tbl"), F.col("city_tag").alias("city"))
    return a.unionByName(b).groupBy("tbl", "city").agg(F.count("*").alias("n"))
