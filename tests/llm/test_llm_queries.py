"""The subpackage's queries over the smallest tables, whole."""

import base64
from collections import Counter

import pytest

from plakat.llm import bpe, packing
from plakat.llm.queries import R
from plakat.runtime import read_table

SHAPE = {
    "p1_found": {"record_id_a": "bigint", "record_id_b": "bigint"}, "p2_found": {"tbl": "string", "row_key": "string", "field": "string"}, "p4_found": {"record_id": "bigint", "place_id": "string"},
    "p5_found": {"key_a": "string", "key_b": "string"}, "p6_found": {"tbl": "string", "row_key": "string", "field": "string"}, "p7_found": {"listing_id": "string", "field": "string", "version_id": "bigint"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p10_found": {"doc_id": "bigint", "pii_type": "string", "found": "string"},
}


@pytest.mark.parametrize("name", sorted(SHAPE))
def test_columns_and_distinct_rows(spark, small, name):
    df = R.queries[name](spark, small)
    assert dict(df.dtypes) == SHAPE[name]
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))


def test_pairs_are_ordered_and_of_two_sources(spark, small):
    source = {r.record_id: r.source for r in read_table(spark, small, "event_records").select("record_id", "source").collect()}
    for r in R.queries["p1_confidence"](spark, small).collect():
        assert r.record_id_a < r.record_id_b and source[r.record_id_a] != source[r.record_id_b] and 0 < r.confidence <= 1
    for r in R.queries["p5_found"](spark, small).collect():
        assert r.key_a < r.key_b and (r.key_a.startswith("place:") or r.key_b.startswith("place:"))


def test_every_asked_record_is_mapped_once(spark, small):
    ids = {r[0] for r in read_table(spark, small, "venue_refs").select("place_id").collect()}
    rec = read_table(spark, small, "event_records").selectExpr("record_id", "analysis.ticket_info.venue_name v", "analysis.ticket_info.place_id p").collect()
    asked = {r.record_id for r in rec if r.v and r.v.strip() and (r.p or "") not in ids}
    got = R.queries["p4_found"](spark, small).collect()
    assert Counter(r.record_id for r in got) == Counter(asked) and {r.place_id for r in got} <= ids | {"none"}


def test_ids_of_all_documents(spark, small):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary_path(), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: list(r.ids) for r in R.queries["p8_ids"](spark, small).collect()}
    texts = {r.doc_id: r.text for r in read_table(spark, small, "documents").select("doc_id", "text").collect()}
    assert got == {k: enc.encode_ordinary(t) if t else [] for k, t in texts.items()}
    fill, seen = Counter(), Counter()
    for r in R.queries["p9_packing"](spark, small).collect():
        seen[r.doc_id] += r["size"]
        if r.container_id is not None:
            fill[r.container_id] += r["size"]
    assert seen == {k: len(v) for k, v in got.items()} and max(fill.values()) <= packing.CAPACITY
    assert len(fill) <= -(-sum(map(len, got.values())) // packing.CAPACITY) + 2


def test_masked_texts_hold_nothing_found(spark, small):
    found = {}
    for r in R.queries["p10_found"](spark, small).collect():
        if r.pii_type != "person":
            found.setdefault(r.doc_id, []).append(r.found)
    for r in R.queries["p10_masked"](spark, small).collect():
        assert not any(f in r.text for f in found.get(r.doc_id, []))


def test_survivors_equal_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("listing_versions", "feed_sources"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = c.execute(f"SELECT listing_id, field, version_id FROM ({R.sql['p7_found']})").fetchall()
    assert sorted(tuple(r) for r in R.queries["p7_found"](spark, small).select("listing_id", "field", "version_id").collect()) == sorted(want)


@pytest.mark.parametrize("name", ["p2_canonical", "p4_unmatched", "p5_buildings", "p6_restored"])
def test_the_others_run(spark, small, name):
    assert R.queries[name](spark, small).count() > 0
