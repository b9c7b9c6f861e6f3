import datetime as dt
import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plakat.functions import dates, nested, similarity, text, url
from plakat.functions.geo import coordinate, walk_minutes

TITLES = ["Koncert: Zażółć gęślą – jaźń", "  A--b c_d ", "", "Wystawa 2026 w Łodzi!", "É è ü ñ", "Kto tu rządzi?", "x" * 5000, "żółw ŻÓŁW"]


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def slug(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s.replace("ł", "l").replace("Ł", "L")) if not unicodedata.combining(c)).lower()
    return re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", s)).strip("-")


def test_slug_and_key(spark):
    assert col(spark, TITLES, text.slugify) == [slug(t) for t in TITLES]
    key = lambda s: " ".join(sorted(w for w in re.sub(r"[^\w\s]", " ", re.sub(r"20\d{2}", "", s.lower())).split() if len(w) > 1))
    assert col(spark, TITLES, text.title_key) == [key(t) for t in TITLES]
    assert col(spark, [None], text.slugify) == [None]
    assert col(spark, ["Jazz w Opole 2026"], lambda c: text.title_key(c, F.lit("Opole"))) == ["jazz"]


def test_stems_in_order(spark):
    def stem(w):
        w = w.lower().strip()
        for e in text.STEM_ENDINGS:
            if len(w) > len(e) + 3 and w.endswith(e):
                return w[: -len(e)]
        return w

    words = ["koncertami", "świecach", "dom", "ulicy", "ogrodowego", "bielsku", "Oku", "teatrów", "rzeką", ""]
    assert col(spark, words, text.stem) == [stem(w) for w in words]


@pytest.mark.parametrize(
    ("value", "want"),
    [("Kabaret X - Opole, bilety", "Kabaret X"), ("Recital | Starograb", "Recital"), ("Opera (Centrum Kultury)", "Opera"), ("Jazz, 12 maja w klubie", "Jazz"), ("", "Wydarzenie"), (None, "Wydarzenie"), (" - Bal: ", "Bal")],
)
def test_clean_title(spark, value, want):
    assert col(spark, [value], text.clean_title) == [want]


def test_small_text_rules(spark):
    assert col(spark, ["np. ﬁlm? lub Całodniowe"], text.scrub_generated) == ["film"]
    assert col(spark, ["<p>A&nbsp;&amp;  B</p>\n<br/>c"], text.strip_html) == ["A & B c"]
    assert col(spark, ["a" * 276, "a" * 275, None], text.lead) == ["a" * 272 + "...", "a" * 275, None]
    assert col(spark, ["raz dwa trzy", "bezspacji", "ok"], lambda c: text.cut_at_word(c, 8)) == ["raz dwa...", "bezspacj...", "ok"]
    assert col(spark, ["Raz. Dwa. Trzy", "Raz"], text.first_sentence) == ["Raz", "Raz"]
    assert col(spark, ["Koncert | Klub", "Jazz - Bilety", "Jazz Opole"], lambda c: text.clean_seo_title(c, "Opole")) == ["Koncert", "Jazz", "Jazz"]
    assert [tuple(x) for x in col(spark, ["reżyseria – Jan", "a - b - c", "sam"], text.role_pair)] == [("reżyseria", "Jan"), ("a - b", "c"), (None, "sam")]
    assert col(spark, ["Dom Kultury"], lambda c: text.venue_display(c, F.lit("Foyer"))) == ["Dom Kultury (Foyer)"]
    assert col(spark, ["", None, "x"], lambda c: text.either(c, F.lit("y"))) == ["y", "y", "x"]


def test_paragraphs(spark):
    long = "Zdanie ma trochę słów i tak dalej. " * 9
    raw = f"KoncertWspaniały(sala)Dobra. Czas trwania: 90 minut<br/>{long}UWAGA limit. 🎭 Zobacz więcej informacji na stronie"
    got = col(spark, [raw, None, "", "abc"], text.paragraphs)
    assert got[1:] == [[], [], []]
    got = got[0]
    sentence = "Zdanie ma trochę słów i tak dalej."
    assert got == ["Koncert Wspaniały (sala) Dobra.", "* Czas trwania: 90 minut", " ".join([sentence] * 7), " ".join([sentence] * 2), "UWAGA limit. na stronie"]


def test_phrase_with_its_lead_up_is_cut_out(spark):
    cases = {
        "Gramy. Zobacz tu: więcej informacji - dziś": "Gramy.. dziś",  # from the last stop
        "Gramy 🎭 dziś. Tu więcej informacji": "Gramy . ",  # a picture goes before a stop
        "x" * 100 + "więcej informacji. Koniec": "x" * 40 + ". Koniec",  # neither: 60 characters
        "Bez frazy": "Bez frazy",
        None: None,
    }
    assert col(spark, list(cases), text.without_phrase) == list(cases.values())
    assert col(spark, ["a Więcej Informacji b Więcej informacji c", "y" * 300], text.paragraphs) == [[". c"], ["y" * 300]]


def test_urls(spark):
    got = col(spark, ["https://a.pl/x?utm_source=1&id=2&REF=3#top", "https://a.pl/?fbclid=1", "https://a.pl/y", "https://a.pl/z?a=1&a=2", None], url.clean_url)
    assert got == ["https://a.pl/x?id=2&REF=3", "https://a.pl/", "https://a.pl/y", "https://a.pl/z?a=1&a=2", None]
    assert col(spark, ["HTTPS://U@Host.PL:80/x", "x/y"], url.netloc) == ["u@host.pl:80", ""]
    assert col(spark, ["/a", "b.html", "//c.pl/d", "mailto:x", "https://e.pl"], lambda c: url.absolute(c, "https://h.pl/p/q")) == ["https://h.pl/a", "https://h.pl/p/b.html", "https://c.pl/d", "mailto:x", "https://e.pl"]
    who = lambda c: url.provider(c, F.lit(""), {"kasa.miasto.pl": "Kasa Miasta"}, {"agregat.pl": "Agregat"}, ["teatr", "bilety."])
    assert [tuple(x) for x in col(spark, ["https://kasa.miasto.pl/1", "https://agregat.pl/teatr", "https://teatr.pl/x", "https://inny.pl", "", None], who)] == [
        (100, "Kasa Miasta", True), (80, "Agregat", False), (100, "Oficjalna kasa", True), (10, "Bilety", False), (10, "Bilety", False), (10, "Bilety", False),
    ]


def test_dates(spark):
    d = dt.date
    assert col(spark, ["od 5.03.2026 r.", "30.02.2026", None], dates.dotted) == [d(2026, 3, 5), None, None]
    assert col(spark, ["sobota 5 marca 2026", "5 foo 2026"], dates.worded) == [d(2026, 3, 5), None]
    assert col(spark, ["5 foo 2026"], lambda c: dates.worded(c, 1)) == [d(2026, 1, 5)]
    nov = F.lit("2026-11-20").cast("date")
    assert col(spark, ["3 stycznia", "3 marca", "30 listopada"], lambda c: dates.worded_no_year(c, nov, "winter")) == [d(2027, 1, 3), d(2026, 3, 3), d(2026, 11, 30)]
    assert col(spark, ["3 marca", "3 grudnia"], lambda c: dates.worded_no_year(c, nov, "season")) == [d(2027, 3, 3), d(2026, 12, 3)]
    spans = col(spark, ["1.05 - 3.06.2026", "4-6 maja 2026", "wystawa do 20.12", "7.07.2026"], lambda c: dates.date_range(c, nov))
    assert [tuple(x) for x in spans] == [(d(2026, 5, 1), d(2026, 6, 3)), (d(2026, 5, 4), d(2026, 5, 6)), (d(2026, 11, 20), d(2026, 12, 20)), (d(2026, 7, 7), d(2026, 7, 7))]
    assert [tuple(x) for x in col(spark, ["luty 2028", "maj 2027"], lambda c: dates.month_range(c, nov))] == [(d(2028, 2, 1), d(2028, 2, 28)), (d(2027, 5, 1), d(2027, 5, 31))]
    assert [tuple(x) for x in col(spark, ["2026-07-01T22:30:00Z", "2026-01-01T10:00:00+01:00", "2026-05-06T07:08", "zły"], dates.zoned)] == [(d(2026, 7, 2), "00:30"), (d(2026, 1, 1), "10:00"), (d(2026, 5, 6), "07:08"), (None, None)]
    assert col(spark, ["godz. 9.30", "o 18:05", "brak", "5.03.2026"], lambda c: dates.time_of(c, "19:00")) == ["09:30", "18:05", "19:00", "19:00"]
    assert [tuple(x) for x in col(spark, ["10:00 - 12:30", "Wydarzenie całodzienne", "x"], dates.time_block)] == [("10:00", "12:30", False), ("Całodniowe", None, True), (None, None, False)]
    assert col(spark, ["2026-10-10", "jutro", "2026-02-30"], dates.long_date) == ["Sobota, 10 października", "jutro", "2026-02-30"]
    apart = spark.createDataFrame([("17:00", "19:30"), ("17:00", "17:15"), ("17:00", None), ("17:00", "17:45")], "a string, b string").select(dates.times_apart(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in apart] == [True, False, False, True]
    assert [tuple(x) for x in col(spark, [d(2026, 6, 10), d(2026, 6, 12), d(2026, 6, 14)], dates.weekend, "date")] == [(d(2026, 6, 12), d(2026, 6, 14))] * 3


def test_nested(spark):
    assert col(spark, ['{"a": {"b": ""}, "c": "x"}', "nope", None], lambda c: nested.json_first(c, "$.a.b", "$.c")) == ["x", None, None]
    page = '<script type="application/ld+json">{"@type": "Event", "description": "ab", "location": {"name": "Klub"}, "image": ["i.png"]}</script><script type="application/ld+json">{"@type": "MusicEvent", "description": "abc"}</script>'
    assert [tuple(x) for x in col(spark, [page, "<p>"], nested.json_ld)] == [("abc", "i.png", "Klub"), (None, None, None)]
    m = spark.sql("select map('a', 1, 'b', 2) as x, map('b', 3, 'c', 4) as y, cast(null as map<string,int>) as z").select(nested.merged(F.col("x"), F.col("z"), F.col("y")).alias("m")).first().m
    assert m == {"a": 1, "b": 2, "c": 4}
    r = spark.sql("select array(struct(3 as n), struct(1 as n)) as a").select(nested.ranked(F.col("a"), lambda x, y: x["n"] - y["n"]).alias("a")).first().a
    assert [(x.n, x.is_primary) for x in r] == [(1, True), (3, False)]
    assert col(spark, [" ul. A ", ""], lambda c: nested.address_line(c, F.lit("00-001"), F.lit(None).cast("string"))) == ["ul. A, 00-001", "00-001"]


def test_numbers(spark):
    assert col(spark, [0.0, 200.0, 280.0, 10_000.0], walk_minutes, "double") == [1, 2, 4, 125]  # half to even
    assert col(spark, [0.0, None, 5.0], lambda c: coordinate(c, F.lit(7.0)), "double") == [7.0, 7.0, 5.0]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(max_size=12), st.text(max_size=12)), max_size=8))
def test_sequence_ratio(spark, pairs):
    pairs = [(a.replace("\x00", ""), b.replace("\x00", "")) for a, b in pairs if not any(0xD800 <= ord(c) < 0xE000 for c in a + b)] + [("ab", None)]
    got = [r[0] for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", similarity.sequence_ratio("a", "b").alias("r")).orderBy("i").select("r").collect()]
    assert got == [None if b is None else SequenceMatcher(None, a, b).ratio() for a, b in pairs]
