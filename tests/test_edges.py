"""Nulls, empty and repeated rows, ties and hot groups in operators of the second round."""

import pytest
from pyspark.sql import functions as F

from plakat.operators import agenda, dedup, offers, order, poi, rules, store, views
from plakat.plans.planted_queries import _BATCH, _EVENT, _STORED


def test_classifiers_of_nothing(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", {}), (3, "Park linowy", {"leisure": "park", "dog": "no"}), (4, "x" * 50_000, {"amenity": "cafe"})], "id int, name string, tags map<string,string>")
    none = F.lit(None).cast("string")
    got = {r.id: r for r in df.select("id", poi.group_of(F.col("tags")).alias("g"), poi.three_axes(F.col("name"), none, none)["sub_category"].alias("s"), poi.leisure_cluster(F.col("tags"))["cluster"].alias("c"), poi.page_label(none, none, none).alias("l"), poi.is_junk(F.col("name")).alias("j")).collect()}
    assert [(got[i].g, got[i].s, got[i].c, got[i].l, got[i].j) for i in (1, 2)] == [("inne", "inne", "natura_relaks", "Obiekt Kulturalny", False)] * 2
    assert got[3].g == "natura" and got[4].g == "gastronomia"
    kept = {r.id: (r.name, r.for_dogs, r.is_free) for r in poi.resolve(df.withColumn("clash", F.lit("x")), "tags", none).collect()}
    assert kept == {}  # names count only as tags
    named = spark.createDataFrame([(1, {"leisure": "playground"}), (2, {"leisure": "dog_park"}), (3, {"amenity": "cafe"}), (4, {"amenity": "cafe", "name": "K", "fee": "no"}), (5, None)], "id int, tags map<string,string>")
    assert {r.id: (r.name, r.is_free) for r in poi.resolve(named, "tags", none).collect()} == {1: ("Plac zabaw (osiedlowy)", True), 2: ("Wybieg dla psów", True), 4: ("K", False)}


def test_positions_of_a_hot_block(spark):
    rows = [("a" if i % 3 else None, i % 5 if i % 7 else None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "b string, k int, id int")
    got = {(r.b, r.position): r.id for r in order.positions(df, "b", "k", "id").collect()}
    for b in ("a", None):
        want = sorted((r for r in rows if r[0] == b), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[b, i + 1] for i in range(len(want))] == [r[2] for r in want]
    assert order.positions(df.where("id < 0"), "b", "k", "id").count() == 0
    first, more = agenda.split_pages(df, "b", "k", "id", size=40)
    assert first.count() == 80 and more.count() == 220


def test_slugs_of_a_hot_group(spark):
    df = spark.createDataFrame([(i, "x", "d" if i < 90 else None, "10:00" if i % 2 else None) for i in range(100)], "id int, b string, d string, t string")
    got = [r.slug for r in dedup.unique_slugs(df, "b", "d", "t", "id").orderBy("id").collect()]
    assert got[:4] == ["x-d", "x-d-1000", "x-d-2", "x-d-3"] and len(set(got[:90])) == 90 and len(set(got[90:])) == 10
    assert dedup.unique_slugs(df.where("id < 0"), "b", "d", "t", "id").count() == 0


def test_upsert_of_empty_sides_and_hot_targets(spark):
    s, b = spark.createDataFrame(_STORED, _EVENT), spark.createDataFrame(_BATCH, _EVENT)
    sell, rank = lambda u: F.lit("Bilety"), lambda u: F.lit(1)
    assert {r.target for r in store.upsert_events(s, b.where("false"), sell, rank).collect()} == {1, 2, 3}
    assert {r.target for r in store.upsert_events(s.where("false"), b, sell, rank).collect()} >= {11, 12, 13, 15}
    many = spark.createDataFrame([(100 + i, "a", "2026-07-01", "Jazz nad rzeką", f"https://z/{i}", "d" * (i % 50), None, None, None, [("S", "https://s/1", "", [f"r{i}"])]) for i in range(200)], _EVENT)
    got = {r.target: r for r in store.upsert_events(s, many, sell, rank).collect()}[1]
    assert got.n_merged == 200 and len(got.description) == 49 and [(o.provider, o.discounts) for o in got.offers] == [("Biletyna", []), ("S", ["r199"])]


def test_offers_and_rules(spark):
    df = spark.createDataFrame([("a", 0, "u", "od 30,50 zł"), ("a", 1, "u", None), ("a", 2, "u", "Wstęp wolny"), ("a", 3, "u", "30,50")], "event string, ord int, url string, price string")
    who = F.struct(F.lit(10).alias("authority"), F.lit("x").alias("name"), F.lit(False).alias("official"))
    assert {r.ord: r["rank"] for r in offers.ranked_by_price(df, "event", who).collect()} == {2: 1, 0: 2, 3: 3, 1: 4}
    rows = spark.createDataFrame([(1, "Klub ABC"), (2, None), (3, ""), (4, "klub abc")], "id int, v string")
    table = spark.createDataFrame([("klub", 1, "p2"), ("abc", 0, "p1"), ("abc", 0, "p0")], "word string, rule_ord int, target string")
    assert {(r.id, r.target) for r in rules.rule_join(rows, "id", F.col("v"), table).collect()} == {(1, "p0"), (4, "p0")}
    assert rules.rule_join(rows, "id", F.col("v"), table.where("false")).count() == 0


@pytest.mark.parametrize("most", [1, 40])
def test_place_pages(spark, most):
    places = spark.createDataFrame([("p", "P", False), ("q", "Q", True), ("r", "R", False)], "place_id string, name string, kept boolean")
    events = spark.createDataFrame([(1, "p", "2026-07-01", None), (2, "p", "2026-07-01", ""), (3, "p", "2020-01-01", None), (4, None, "2026-07-01", None)], "record_id int, place string, date_start string, date_end string")
    got = {(r.place_id, r.position, r.record_id, r.n_upcoming) for r in views.place_pages(places, events, F.col("place"), F.lit("2026-06-10"), F.col("kept"), most).collect()}
    assert got == ({("p", 1, 1, 2), ("q", None, None, 0)} if most == 1 else {("p", 1, 1, 2), ("p", 2, 2, 2), ("q", None, None, 0)})
