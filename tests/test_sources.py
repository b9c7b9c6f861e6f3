import datetime as dt
import json
import shutil

import pytest
from pyspark.sql import functions as F

from plakat.operators import store
from plakat.sources import config, feeds, generators, places, registry
from plakat.sources.html import parse
from plakat.streaming import streams


def now():
    return F.lit("2026-06-10").cast("date")



def test_html_tree():
    t = parse("<div id=main class='x y'><p>raz<p>dwa <b>trzy</b><ul><li>a<li>b</ul></div><table><tr><td>1<td>2<tr><td>3</table><img src=i.png>")
    assert [p.text() for p in t.select("div > p")] == ["raz", "dwa trzy a b"]
    assert [n.text() for n in t.select("#main .z, li, tr")] == ["a", "b", "1 2", "3"]
    assert t.first("img[src$='.png']").attrs["src"] == "i.png" and parse(None).select("*") == []
    assert len(parse("<div>" * 20_000).select("div")) == 20_000


def test_feeds(spark):
    pages = [
        ("paged_cards", "https://x.pl/r", "<div class=event-block-2><h3><a href=/e/1>Jazz  nocą</a></h3><div class=event-meta>12 lipca godz. 20:15</div></div>" * 2 + "<div class=event-block-2><h3>Bez daty</h3></div>"),
        ("ajax_rows", "https://y.pl/a", json.dumps({"html": "<article class=small-event-row><a href=/s>Bajka</a><span class=small-event-row__day>5.07</span><i class=small-event-row__hour>9.30</i></article>"})),
        ("events_api", "https://z.pl/api", json.dumps({"events": [{"title": "Bieg &amp; marsz", "start_date": "2026-07-01 10:00:00", "venue": {"venue": "Park"}, "description": "<p>Opis</p>", "url": "https://z.pl/1"}]})),
        ("table_rows", "https://t.pl", "<table><tr><td>1<td>3-5 lipca<td><a href=b>Turniej</a></tr><tr><td>x</tr></table>"),
        ("repertoire_api", "https://r.pl", json.dumps({"events": [{"title": "Opera", "date": "2026-07-01T17:00:00Z", "stage": {"name": "Duża"}}]})),
        ("events_api", "https://z.pl/api2", None), ("paged_cards", "https://x.pl/r2", ""),
    ]
    got = registry.Sources().read(spark.createDataFrame(pages, "source string, url string, body string"), now()).collect()
    assert {(r.source, r.title, r.date_start, r.date_end, r.time_start, r.url) for r in got} == {
        ("paged_cards", "Jazz nocą", dt.date(2026, 7, 12), dt.date(2026, 7, 12), "20:15", "https://x.pl/e/1"), ("ajax_rows", "Bajka", dt.date(2026, 7, 5), dt.date(2026, 7, 5), "09:30", "https://y.pl/s"),
        ("events_api", "Bieg & marsz", dt.date(2026, 7, 1), dt.date(2026, 7, 1), "10:00", "https://z.pl/1"), ("table_rows", "Turniej", dt.date(2026, 7, 3), dt.date(2026, 7, 5), "Według harmonogramu", "https://t.pl/b"),
        ("repertoire_api", "Opera", dt.date(2026, 7, 1), dt.date(2026, 7, 1), "19:00", "https://r.pl"),
    }
    s = registry.Sources()
    s.register(feeds.Feed("ajax_rows", enabled=False))
    assert "ajax_rows" not in [f.name for f in s.chosen()] and [f.name for f in s.chosen("EVENTS_API")] == ["events_api"]
    with pytest.raises(ValueError, match="no enabled source"):
        s.read(spark.createDataFrame(pages, "source string, url string, body string"), now(), "nope")


def test_detail_lookup(spark):
    listing = spark.createDataFrame([("https://x.pl/l", "<a href=/d/1>a</a><a href=/d/1>b</a><a href=/d/2>c</a>")], "url string, body string")
    links = feeds.linked_pages(listing, "a[href*='/d/']")
    assert sorted(r.url for r in links.collect()) == ["https://x.pl/d/1", "https://x.pl/d/2"]
    pages = spark.createDataFrame([("https://x.pl/d/1", "<meta property='og:image' content='/i.png'><article><p>" + "długi opis " * 4 + "<p>nie</article>")] * 2, "url string, body string")
    ev = links.withColumn("description", F.lit("stary")).withColumn("image_url", F.lit(""))
    got = {r.url[-1]: (r.description[:5], r.image_url) for r in feeds.details(ev, pages, "article").collect()}
    assert got == {"1": ("długi", "https://x.pl/i.png"), "2": ("stary", None)}


def test_places(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps([{"place_id": "a", "name": "1", "geo": {"lat": 0.0, "lon": 0.0}, "lat": 5.0, "lon": 6.0}, {"id": "a", "name": "2", "address": {"street": "S", "city": "C"}}, {"name": "3", "address": "ul. X"}]))
    got = {r.place_id: (r.name, r.lat, r.street) for r in places.read_places(spark, str(p)).collect()}
    assert got == {"a": ("2", None, "S"), "idx-2": ("3", None, "ul. X")}
    q = tmp_path / "q.json"
    q.write_text(json.dumps({"k": {"place_id": "b", "coordinates": {"lat": 1.5, "lon": 2.5}}}))
    assert [(r.place_id, r.lat) for r in places.read_places(spark, str(tmp_path / "missing.json"), str(q)).collect()] == [("b", 1.5)]
    q.write_text("not json")
    assert places.read_places(spark, str(q)).count() == 0
    o = tmp_path / "o.json"
    o.write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 50.0, "lon": 20.0, "tags": {"amenity": "cafe", "name": "K", "contact:phone": "1"}}, {"type": "way", "id": 2, "center": {"lat": 50.0, "lon": 20.0}, "tags": {"amenity": "parking", "access": "private"}}, {"type": "node", "id": 3}]}))
    e = places.read_elements(spark, str(o))
    assert [(r.place_id, r.poi_group, r.phone) for r in places.places_of(e).collect()] == [("node/1", "gastronomia", "1")]
    assert [r.osm_id for r in places.choose(e, {"amenity": "cafe|parking"}, (49, 19, 51, 21), {"access": "private"}).collect()] == ["node/1"]
    places.write_json(e.select("osm_id", F.lit(None).cast("string").alias("x")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_config(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("city: A\ncity_tag: a\nsources: {x: {enabled: false}, y: {min_events: 15}}\nvenue_match_rules: [{target_id: p, keywords: [k1, k2]}, {keywords: [k3]}]\n")
    (tmp_path / "global.yaml").write_text("x: 1\n")
    (tmp_path / "broken.yml").write_text("a: [")
    c = config.load_configs(str(tmp_path))
    assert list(c) == ["a"] and config.enabled_sources(c["a"]) == ["y"] and config.least_events(c["a"], "y") == 15 and config.least_events(c["a"]) == 1
    r = config.venue_rules(spark, c)
    full = config.target_by_name(r, spark.createDataFrame([("q", "Hala Górna"), ("z", "Hala")], "place_id string, name string"), spark.createDataFrame([("a", 1, "hala")], "city_tag string, rule_ord int, target_word string"))
    assert {(x.word, x.target) for x in full.collect()} == {("k1", "p"), ("k2", "p"), ("k3", "q")}


def test_generated_and_health(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 1),), (None,)], "s date")
    assert [r.day for r in generators.weekly_series(df, "s").collect()] == [dt.date(2026, 1, 3 + 7 * i) for i in range(4)]
    log = spark.createDataFrame([("a", 200, 1), ("a", 500, 2), ("b", 500, 1), ("b", 200, 2), ("c", None, 1)], "source string, status int, at int")
    assert {r.source for r in registry.health(log).collect()} == {"a", "c"}


def test_streams_equal_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, v int, ts timestamp"
    for i in range(3):
        spark.sql(f"select concat('k', id % 4) as k, cast(id + {i * 10} as int) as v, timestamp'2026-01-0{i + 1} 10:00:00' as ts from range(6)").coalesce(1).write.mode("append").parquet(src)
    s = streams.read_stream(spark, src, schema, max_files=1)
    q = streams.upsert_batches(s, out, str(tmp_path / "c1"), "k", "v", store.upsert)
    q.awaitTermination()
    batch = spark.read.parquet(src)
    want = {r.k: r.v for r in batch.groupBy("k").agg(F.max("v").alias("v")).collect()}
    assert {r.k: r.v for r in streams.current(spark, out).collect()} == want
    # Three batches, each of which touched the parts of its four keys only: what newer versions replace is gone.
    assert len(streams.versions(spark, out)) == 2 and len(streams.latest(spark, out)) <= 4
    again = streams.upsert_batches(s, out, str(tmp_path / "c1"), "k", "v", store.upsert)
    again.awaitTermination()
    assert {r.k: r.v for r in streams.current(spark, out).collect()} == want
    for name, df, ckpt in (("seen", streams.first_seen(s, ["k"], "ts", "10 days").select("k"), "c2"), ("counted", streams.windowed_counts(s, "ts", "1 day", "10 days"), "c3")):
        mode = "append" if name == "seen" else "complete"
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / ckpt)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("seen").count() == 4
    assert {(r.start, r.n) for r in spark.table("counted").collect()} == {(r.start, r.n) for r in streams.buckets(batch, "ts").collect()}
    shutil.rmtree(src)
