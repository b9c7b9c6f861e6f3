"""Queries cover all rows of their tables."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from plakat.functions import text
from plakat.functions.url import local_url
from plakat.plans import event_queries as ev
from plakat.plans import relation_queries as rel

RECORD = "record_id bigint, city string, title string, date_start string, date_end string, time_start string, analysis struct<ticket_info:struct<time_start:string,venue_name:string,price_range:string,doors_open:string,place_id:string>>"


def test_same_titles_of_every_town(spark):
    rows = [(10 * k + i, c, t, "2026-06-10", None, "19:00", None) for k, c in enumerate(("brzostow", "modrzewin", None)) for i, t in enumerate((f"Koncert: Artysta Numer{k}", f"Artysta Numer{k} – bilety"))]
    got = rel.same_titles(spark.createDataFrame(rows, RECORD)).collect()
    assert len(got) == 3


def test_cascade_of_every_town(spark):
    refs = spark.createDataFrame([("md-kuznia", "Muzeum Kuźnia", "modrzewin"), ("md-mdk", "Miejski Dom Kultury", "modrzewin"), ("sg-miejski-dom-kultury", "Miejski Dom Kultury", "starograb")], "place_id string, name string, city string")
    info = lambda v, p=None: ((None, v, None, None, p),)
    rows = [(1, "modrzewin", info("Muzeum Kuznia")), (2, None, info("Muzeum Kuznia")), (3, None, info("Miejski Dom Kultury")), (4, "modrzewin", info("Miejski Dom Kultury")), (5, "starograb", info("MDK")), (6, "kaminiec", info("x", "md-mdk"))]
    r = spark.createDataFrame([(i, c, None, None, None, None, a) for i, c, a in rows], RECORD)
    got = {x.record_id: (x.place_id, x.how) for x in rel.cascade(r, refs).collect()}
    assert got == {1: ("md-kuznia", "text"), 2: ("md-kuznia", "text"), 3: (None, "none"), 4: ("md-mdk", "text"), 5: ("sg-miejski-dom-kultury", "rule"), 6: ("md-mdk", "id")}


def test_text_queries_of_all_titles(spark):
    """Titles that DuckDB folds differently, against plain Python."""
    titles = ["Ночные огни – wystawa: Jili", "Ｋｏｎｃｅｒｔ １２ – ﬁnał??", "Café Ñandú – Übermut", "Łąka – 🎭 bez końca", "Zwykły tytuł - bilety", "Ćwiczenia № 5 ²", ""]
    r = spark.createDataFrame(list(enumerate(titles)), "record_id bigint, title string")
    fold = str.maketrans(text.ACCENTS_FROM + "łŁ", text.ACCENTS_TO + "lL")
    slug = lambda t: re.sub(r"[-\s]+", "-", "".join(c for c in t.translate(fold).lower() if unicodedata.category(c)[0] in "LN" or c in "_- \t")).strip("-")
    got = lambda f: {x.record_id: x.c for x in r.select("record_id", f(F.col("title")).alias("c")).collect()}
    want = dict(enumerate(titles))
    assert got(text.slugify) == {i: slug(t) for i, t in want.items()}
    assert got(lambda c: text.thumbnail_key("ev", c)) == {i: f"ev_{slug(t)}.webp" for i, t in want.items()}
    words = lambda t: "".join(c if unicodedata.category(c)[0] in "LN" or c == "_" else " " for c in re.sub(r"20\d{2}", "", t.lower())).split()
    assert got(text.title_key) == {i: " ".join(sorted(w for w in words(t) if len(w) > 1)) for i, t in want.items()}
    scrub = lambda t: re.sub(r"&#65533;|\?+", "", unicodedata.normalize("NFKC", t)).strip()
    assert got(text.scrub) == {i: scrub(t) for i, t in want.items()}
    side = lambda t: re.split(r"\s*[–—]\s*", t, maxsplit=1) if re.search("[–—]", t) else ([None, t] if " - " not in t else t.rsplit(" - ", 1))
    assert {i: list(p) for i, p in got(text.role_pair).items()} == {i: side(t) for i, t in want.items()}
    assert got(lambda c: local_url(F.lit("sg"), c, F.lit("2026-06-10"))) == {i: f"local://sg/{slug(t)}-2026-06-10" for i, t in want.items()}


@pytest.mark.parametrize("name", ["t01_slug", "t02_title_key", "t07_scrub", "t17_role_pair", "k06_thumbnail_key"])
def test_all_titles_are_registered(spark, small, name):
    n = spark.read.parquet(f"{small}/event_records.parquet").where("title is not null").count()
    assert ev.R.queries[name](spark, small).count() == n


def test_upsert_inserts_new_links(spark, small):
    stored = {r[0] for r in spark.read.parquet(f"{small}/stored_events.parquet").select("source_url").collect()}
    links = {r[0] for r in spark.read.parquet(f"{small}/event_records.parquet").where("source_url is not null").select("source_url").collect()}
    got = {r.source_url for r in rel.R.queries["m01_upsert_records"](spark, small).collect()}
    assert links - stored and got == links | stored
