"""Nulls, empty tables, very long texts, repeated rows and clashing extra columns for every operator."""

import pytest
from pyspark.sql import functions as F

from plakat.llm import address, bpe, canonical, linkage, lookalike, mojibake, packing, pii, survivor

LONG = "Zażółć " * 20_000
TEXTS = [None, "", " ", LONG, "x" * 100_000, "Kоnсert", "PieÅ›ni", "\x00", "tel. 601 234 567", "tel. 601 234 567"]
CLASH = ["_n", "_id", "key", "day", "tok", "code", "band", "tokens", "latin", "_h", "_r", "_g", "w", "n", "value2"]


def with_clash(df):
    return df.withColumns({c: F.lit(1) for c in CLASH if c not in df.columns})


def fields(spark, rows):
    df = spark.createDataFrame([("t", str(i), "f", v, i % 2 == 0) for i, v in enumerate(rows)], "tbl string, row_key string, field string, value string, is_json boolean")
    return with_clash(df)


@pytest.fixture(scope="module")
def model():
    return mojibake.train(["Pieśni o źródłach", "Żarty"] * 3)


def test_text_operators(spark, model):
    f = fields(spark, TEXTS)
    assert {r.row_key for r in lookalike.lookalike_fields(f, mojibake.garbled_fields(f, model)).collect()} == {"5"}
    assert {r.row_key for r in mojibake.garbled_fields(f, mojibake.fit(f)).collect()} <= {"6", "7"}
    docs = with_clash(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string"))
    assert bpe.token_ids(docs, "doc_id", "text").count() == len(TEXTS)
    assert pii.found_spans(docs, "doc_id", "text").count() == 2
    assert pii.masked_texts(docs, "doc_id", "text", "k").count() == len(TEXTS)
    assert packing.pack(bpe.token_ids(docs, "doc_id", "text", count_only=True), "doc_id", "n_tokens", 64).where("size > 64").count() == 0


def test_empty_tables(spark, model):
    f = fields(spark, TEXTS).where("false")
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert lookalike.lookalike_fields(f, mojibake.garbled_fields(f, model)).count() == mojibake.garbled_fields(f, mojibake.fit(f)).count() == 0
    assert pii.found_spans(docs, "doc_id", "text").count() == pii.masked_texts(docs, "doc_id", "text", "k").count() == 0
    none = spark.createDataFrame([], "id bigint, source string, title string, date string, date_end string, start string, doors string, venue string, place string, town string, kind string")
    assert linkage.showing_links(none).count() == 0
    a = spark.createDataFrame([], "key string, side string, area string, street string, housenumber string, city string, postcode string, line string")
    assert address.same_building_pairs(address.buildings(a)).count() == 0
    v = spark.createDataFrame([], "g string, id bigint, v string, trust int, at timestamp")
    assert survivor.surviving_values(v, "g", "id", {"v": (F.col("v"), survivor.says_something(F.col("v")))}, F.col("trust"), F.col("at")).count() == 0
    ref = spark.createDataFrame([], "entry string, entry_name string, area string, area_name string")
    asked = spark.createDataFrame([("Klub", "sg")], "name string, area string")
    assert [r.entry for r in canonical.map_names(asked, ref, spark.createDataFrame([], "tok string")).collect()] == [None]


def test_matching_with_odd_rows(spark):
    row = ("s1", "Recital: Kuro Nekonek", "2027-03-16", None, "18:30", None, "Klub", None, "sg", "concert")
    odd = [(i, *(None if j == k else v for j, v in enumerate(row))) for k, i in zip(range(10), range(100, 110), strict=True)]
    rows = [(1, *row), (2, "s2", *row[1:]), (2, "s2", *row[1:]), (3, "s3", LONG, *row[2:]), (4, "s4", LONG, *row[2:]), (None, "s5", *row[1:]), *odd]
    df = spark.createDataFrame(rows, "id bigint, source string, title string, date string, date_end string, start string, doors string, venue string, place string, town string, kind string")
    got = {(r.id_a, r.id_b) for r in linkage.showing_links(with_clash(df)).collect()}
    assert all(a < b for a, b in got) and not any({a, b} & {101, 102} for a, b in got)


def test_addresses_with_odd_rows(spark):
    row = ("place", "a", "ul. Zielona", "5", "Miwiwsk", "00-174", None)
    odd = [(f"place:{k}", *(None if j == k else v for j, v in enumerate(row))) for k in range(1, 7)]
    rows = [("place:x", *row), ("place:x", *row), ("event:1", "event", "a", None, None, None, None, LONG), ("event:2", "event", "a", None, None, None, None, "ul. Zielona 5, 00-174 Miwiwsk"), ("event:3", "event", "a", None, None, None, None, "{broken"), *odd]
    df = spark.createDataFrame(rows, "key string, side string, area string, street string, housenumber string, city string, postcode string, line string")
    extra = df.withColumns({c: F.lit(1) for c in CLASH if c != "key"})
    got = {(r.key_a, r.key_b) for r in address.same_building_pairs(address.buildings(extra)).collect()}
    assert ("event:2", "place:x") in got and not any("place:2" in p or "place:3" in p for p in got)


def test_names_with_odd_rows(spark):
    ref = with_clash(spark.createDataFrame([("a", "Klub Perkoz", "sg", "Starograb"), ("b", None, "sg", None), (None, "Klub X", None, "Y")], "entry string, entry_name string, area string, area_name string"))
    asked = with_clash(spark.createDataFrame([("Klub Perkoz", "sg"), ("Klub Perkoz", "sg"), (LONG, "sg"), (None, None), ("x" * 50_000, None), ("Perkoz", "nowhere")], "name string, area string"))
    got = {(r["name"] if r["name"] is None else r["name"][:11], r.area): r.entry for r in canonical.map_names(asked, ref, spark.createDataFrame([("klub",)], "tok string")).collect()}
    assert got["Klub Perkoz", "sg"] == "a" and got["Perkoz", "nowhere"] is None and got[None, None] is None
