import base64
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plakat.llm import bpe, packing, survivor

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", "   ", "a" * 5000, "aaab" * 900, "Zażółć gęślą jaźń – 12 m² 👩‍🎤\r\n\tx", "<|endoftext|> it's we'll", "日本語テキスト" * 20, "\x00\x01", "x\n\n\n  y", "".join(random.Random(4).choices("abcdefghij", k=20_000))]


def test_ids_equal_the_public_library(spark, encoding):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, None)]
    got = bpe.token_ids(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), "doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in got:
        want = encoding.encode_ordinary(TEXTS[r.doc_id]) if TEXTS[r.doc_id] else []
        assert list(r.ids) == want
        assert encoding.decode(list(r.ids)) == (TEXTS[r.doc_id] or "")
    n = {r.doc_id: r.n_tokens for r in bpe.token_ids(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", count_only=True).collect()}
    assert n[6] == len(encoding.encode_ordinary(TEXTS[6])) and n[0] == 0
    assert bpe.token_ids(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_plan_uses_every_item_once():
    rng = random.Random(3)
    for cap in (10, 64, 200):
        counts = Counter(rng.randint(1, cap) for _ in range(500))
        used, bins = Counter(), 0
        for pattern, times in packing.plan_containers(dict(counts), cap):
            assert sum(s * k for s, k in pattern.items()) <= cap
            bins += times
            for s, k in pattern.items():
                used[s] += k * times
        assert used == counts
        assert bins <= -(-sum(s * n for s, n in counts.items()) // cap) * 1.05 + 1


def test_packing_keeps_items_whole(spark):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(1, 60, 400)] + [7] * 300 + [0, None, 250, 100, 101]
    df = spark.createDataFrame(list(enumerate(sizes)), "id bigint, n bigint")
    rows = packing.pack(df, "id", "n", capacity=100, rank_rows=50).collect()
    fill, per_item, places = Counter(), Counter(), Counter()
    for r in rows:
        if r.container_id is not None:
            fill[r.container_id] += r["size"]
            places[r.id] += 1
        per_item[r.id] += r["size"]
    assert max(fill.values()) <= 100
    assert all(per_item[i] == (s or 0) for i, s in enumerate(sizes))
    assert all(places[i] == 1 for i, s in enumerate(sizes) if s and s <= 100) and places[702] == 3
    assert len(fill) <= -(-sum(s or 0 for s in sizes) // 100) + 2
    assert packing.pack(df.where("id < 0"), "id", "n", 100).count() == 0


def test_survivor_rules(spark):
    schema = "g string, id bigint, v string, trust int, at timestamp, ok string"
    rows = [
        ("a", 1, "brak", 3, None, ""), ("a", 2, "x", 1, None, ""), ("a", 3, "y", 1, None, ""),
        ("b", 4, "x", 2, None, ""), ("b", 5, None, 3, None, ""), ("b", 6, " - ", 3, None, ""),
        ("c", 7, "alone", 3, None, ""), ("d", 8, "???", 1, None, ""), ("d", 9, "", 1, None, ""), (None, 10, "x", 1, None, ""), (None, 11, "x", 1, None, ""),
        ("e", 12, "old", None, None, ""), ("e", 13, "new", None, None, ""),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("at", F.when(F.col("id") == 13, F.timestamp_seconds(F.lit(5))))
    v = F.col("v")
    got = survivor.surviving_values(df, "g", "id", {"v": (v, survivor.says_something(v))}, F.col("trust"), F.col("at")).collect()
    assert {(r.g, r.id) for r in got} == {("a", 2), ("b", 4), ("e", 13)}
    assert "WindowGroupLimit" in survivor.surviving_values(df, "g", "id", {"v": (v, survivor.says_something(v))}, F.col("trust"), F.col("at"))._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    ("rule", "telling", "empty"),
    [
        (survivor.url_says, ["https://a.example/x", "//cdn.example/y", "/kup/12"], ["#", "/", "https://", "javascript:void(0)", "mailto:", "about:blank", "null", "", None, "brak"]),
        (survivor.price_says, ["od 30 zł", "bezpłatne", "Wstęp wolny", "Wstęp Wolny!"], ["N/A", "?", "cena do ustalenia", None, " "]),
        (survivor.image_says, ["https://a.example/img/1.jpg", "plakat.png"], ["placeholder.jpg", "/static/no-image.png", "https://c.example/blank_1x1.gif", "data:image/gif;base64,R0", "none", None]),
        (survivor.says_something, ["MDK", "„Klub”"], ["[brak lokalizacji]", "TBA", "???", "  ", None]),
    ],
)
def test_fillers(spark, rule, telling, empty):
    df = spark.createDataFrame([(x,) for x in telling + empty], "v string")
    got = [r[0] for r in df.select(rule(F.col("v"))).collect()]
    assert got == [True] * len(telling) + [False] * len(empty)
