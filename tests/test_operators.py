import datetime as dt
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from plakat.functions import text
from plakat.operators import agenda, audit, dedup, joins, offers, rules, store, views


def test_titles_of_one_day(spark):
    rows = [
        ("Wielka gala", "Wielka gala", None, None, True), ("Nowak stand-up Opole nowy program", "Stand-up w Opolu: Nowak", None, None, True), ("Jazz nad rzeką", "Jazz nad rzeką", "17:00", "19:30", False),
        ("Jazz nad rzeką", "Jazz nad rzeką", "17:00", "17:15", True), ("Bajka o kocie", "Wykład o fizyce", None, None, False), (None, "x", None, None, False), ("", "Coś", None, None, False),
    ]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, s string, t string, w boolean").select("i", "w", dedup.same_title(F.col("a"), F.col("b"), F.col("s"), F.col("t")).alias("g")).orderBy("i").collect()
    assert [r.g for r in got] == [r.w for r in got]


@pytest.mark.parametrize(
    ("query", "place", "low", "high"),
    [("NCK w Starogrębie", "Narodowe Centrum Kowalstwa", 0.75, 1), ("spektakl w Teatrze Zielony Most sala A", "Teatr Zielony Most", 0.85, 1), ("Iglica", "Muzeum Iglica", 0.85, 1), ("Klub ABC", "Filharmonia Kuźnia", 0, 0.4), ("", "Muzeum", 0, 0), ("xyz mura", "Zajazd Mury", 0, 0.74), ("xyz kolorowa", "Zajazd Kolorowy", 0.42, 0.74)],
)
def test_place_similarity(spark, query, place, low, high):
    tok = lambda s: text.venue_tokens(F.lit(s))
    s = spark.range(1).select(dedup.place_similarity(tok(query), tok(place))).first()[0]
    assert low <= s <= high


def test_greedy_clusters_against_a_plain_loop(spark):
    rnd = random.Random(1)
    words = ["koncert", "jazz", "rzeka", "gala", "opera", "bajka", "kot"]
    rows = [(i, f"d{rnd.randint(0, 2)}", " ".join(rnd.sample(words, 3)), rnd.choice([None, "17:00", "17:30", "20:00"])) for i in range(60)]
    rows.append((60, None, "jazz", None))
    got = {r.i: r.cluster for r in dedup.greedy_clusters(spark.createDataFrame(rows, "i int, d string, t string, m string"), ["d"], "i", "t", "m").collect()}

    def dup(a, b):
        if a[3] and b[3]:
            x, y = (int(v[:2]) * 60 + int(v[3:]) for v in (a[3], b[3]))
            if abs(x - y) >= 45:
                return False
        if SequenceMatcher(None, *sorted([a[2], b[2]])).ratio() >= 0.8 or SequenceMatcher(None, a[2], b[2]).ratio() >= 0.8:
            return True
        stem = lambda w: next((w[: -len(e)] for e in text.STEM_ENDINGS if len(w) > len(e) + 3 and w.endswith(e)), w)
        stop = {stem(w) for w in dedup.TITLE_STOPWORDS}
        s, t = ({stem(w) for w in re.findall(r"[a-z0-9ąćęłńóśźż]{3,}", v[2])} for v in (a, b))
        p, q = s - stop or s, t - stop or t
        return len(p & q) / len(p | q) >= 0.4 or p <= q or q <= p or SequenceMatcher(None, " ".join(sorted(s)), " ".join(sorted(t))).ratio() >= 0.75

    want = {}
    for d in ("d0", "d1", "d2", None):
        held = []
        for r in [r for r in rows if r[1] == d]:
            at = next((h for h in held if any(dup(r, x) for x in h)), None)
            if at is None:
                held.append([r])
                at = held[-1]
            else:
                at.append(r)
            want[r[0]] = at[0][0]
    assert got == want


def test_merge_records(spark):
    rows = [(1, "g", "Krótki", "https://x/a.jpg", None), (2, "g", "Najdłuższy tytuł", "thumb_1.webp", "Klub"), (3, "g", "Najdłuższy tytuł", "", "Inny"), (4, "h", None, None, None)]
    df = spark.createDataFrame(rows, "o int, g string, title string, image string, venue string")
    got = {r.g: r for r in dedup.merge_records(df, "g", "o", ["title"], ["image", "venue"], {"image": F.col("image").startswith("thumb")}).collect()}
    assert (got["g"].title, got["g"].image, got["g"].venue, got["g"].n_rows) == ("Najdłuższy tytuł", "thumb_1.webp", "Klub", 3)
    assert got["h"].title is None


def test_slugs_are_unique(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), "2026-01-01", rnd.choice([None, "", "18:00", "20:00"])) for i in range(60)]
    got = sorted((r.i, r.slug) for r in dedup.unique_slugs(spark.createDataFrame(rows, "i int, b string, d string, t string"), "b", "d", "t", "i").collect())
    assert len({s for _, s in got}) == 60

    seen, want = set(), []
    for i, b, d, t in rows:
        s = f"{b}-{d}"
        if s in seen and t:
            s2 = f"{s}-{t.replace(':', '')}"
            s = s2 if s2 not in seen else s
        n = 2
        base = f"{b}-{d}"
        while s in seen:
            s, n = f"{base}-{n}", n + 1
        seen.add(s)
        want.append((i, s))
    assert got == want


def test_upserts(spark):
    s = spark.createDataFrame([(1, "u1", "a"), (2, "u2", "b")], "i int, u string, v string")
    b = spark.createDataFrame([(3, "u2", "c"), (4, "u2", "d"), (5, "u3", "e"), (6, None, "f")], "i int, u string, v string")
    assert sorted((r.u or "", r.v) for r in store.upsert(s, b, "u", "i").collect()) == [("", "f"), ("u1", "a"), ("u2", "d"), ("u3", "e")]
    assert sorted((r.u, r.v) for r in store.insert_ignore(s, b, "u", "i").collect()) == [("u1", "a"), ("u2", "b"), ("u3", "e")]
    k = spark.createDataFrame([(1, "d", "jazz rzeka", "u1")], "i int, d string, k string, u string")
    n = spark.createDataFrame([(10, "d", "x", "u1"), (11, "d", "jazz rzeka noc", "u9"), (12, "d", "opera", "u8"), (13, "d", "opera", "u7"), (14, "d", "", "u6"), (15, "e", "opera", "u8")], "i int, d string, k string, u string")
    got = {r.ord: (r.action, r.target) for r in dedup.fuzzy_upsert(k, n, ["d"], "i", "k", "u").collect()}
    assert got == {10: ("update", 1), 11: ("merge", 1), 12: ("insert", 12), 13: ("merge", 12), 14: ("insert", 14), 15: ("insert", 15)}


def test_store_files(spark, tmp_path):
    p = str(tmp_path / "t")
    df = store.ensure_table(spark, p, "city string, v int")
    assert df.count() == 0 and store.ensure_table(spark, p, "city string, v int").count() == 0
    q = str(tmp_path / "q")
    store.replace_partitions(spark, spark.createDataFrame([("a", 1), ("b", 2)], "city string, v int"), q, "city")
    store.replace_partitions(spark, spark.createDataFrame([("a", 9)], "city string, v int"), q, "city")
    assert {(r.city, r.v) for r in spark.read.parquet(q).collect()} == {("a", 9), ("b", 2)}


def test_offers(spark):
    schema = "e int, o array<struct<provider: string, url: string, price: string, is_primary: boolean>>, page string"
    rows = [(1, [("A", "https://a.pl/1?utm_source=x", "sprawdź", None), ("A", "https://a.pl/2", "10 zł", None), ("B", " ", "5 zł", None), ("Inne", "https://c.pl", "1", None), ("Inne", "https://d.pl", "2", None)], None), (2, [], "https://p.pl"), (3, None, None)]
    df = spark.createDataFrame(rows, schema)
    o = offers.offers_of(df, "e", "o", F.col("page"))
    got = {(r.e, r.seller): (r.ord, r.url, r.n_offers) for r in offers.dedup_offers(o, "e", F.coalesce("provider", F.lit("Bilety")), F.col("price").rlike(r"\d")).collect()}
    assert got == {(1, "A"): (0, "https://a.pl/2", 2), (1, "Inne:c.pl"): (3, "https://c.pl", 1), (1, "Inne:d.pl"): (4, "https://d.pl", 1), (2, "Bilety"): (0, "https://p.pl", 1)}


def test_offers_of_a_stored_event_grow(spark):
    schema = "e int, ord int, provider string, url string, price string"
    old = spark.createDataFrame([(1, 0, "A", "https://a.pl/1", "sprawdź"), (1, 1, "Inne", "https://b.pl/x?r=1", "5 zł")], schema)
    new = spark.createDataFrame([(1, 0, "A", "https://a.pl/2", "10 zł"), (1, 1, "Inne", "https://b.pl/x", "7 zł"), (1, 2, None, "https://c.pl", "9 zł"), (2, 0, "A", "https://a.pl", "1")], schema)
    got = {(r.e, r.side, r.ord): (r.url, r.price) for r in store.merge_offers(old, new, "e", F.col("price").rlike(r"\d")).collect()}
    assert got == {(1, 0, 0): ("https://a.pl/1", "10 zł"), (1, 0, 1): ("https://b.pl/x?r=1", "5 zł"), (1, 1, 2): ("https://c.pl", "9 zł"), (2, 1, 0): ("https://a.pl", "1")}


def test_agenda(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2026, 6, 10), d(2026, 6, 10)), (d(2026, 6, 1), d(2026, 6, 20)), (d(2026, 6, 11), d(2026, 6, 11)), (d(2026, 6, 1), d(2026, 6, 5))], "s date, e date")
    now = F.lit("2026-06-10").cast("date")
    assert [r[0] for r in df.select(agenda.badge(F.col("s"), F.col("e"), now)).collect()] == ["DZIŚ", "TRWA", "JUTRO", None]
    assert [[r[0] for r in df.select(agenda.overlaps(F.col("s"), F.col("e"), now, p)).collect()] for p in ("today", "tomorrow", "weekend", "all")] == [[True, True, False, False], [False, False, True, False], [False, True, False, False], [True, True, True, False]]
    with pytest.raises(RuntimeError):
        agenda.guard(df, 5)
    assert agenda.guard(df, 4) is df
    assert [(r.s, r.position) for r in agenda.first_page(df, F.col("s"), F.col("e"), size=2).collect()] == [(d(2026, 6, 1), 1), (d(2026, 6, 1), 2)]


def test_nearest_and_knn(spark):
    pts = spark.createDataFrame([("a", 50.0, 20.0), ("b", 50.001, 20.0), ("c", -33.0, 151.0), ("d", None, 1.0)], "id string, lat double, lon double")
    near = {(r.left_id): r.right_id for r in joins.nearest(pts, pts.where("id = 'a'")).collect()}
    assert near == {"a": "a", "b": "a", "c": "a"}
    k = joins.knn(pts, pts, 1, 500.0, exclude_self=True).collect()
    assert {(r.left_id, r.right_id, r["rank"]) for r in k} == {("a", "b", 1), ("b", "a", 1)}
    assert joins.nearest(pts, pts.where("false")).count() == 0


def test_resolution_cascade(spark):
    ev = spark.createDataFrame([(1, "p1"), (2, ""), (3, "old"), (4, None)], "k int, pid string")
    places = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "place_id string")
    rule = spark.createDataFrame([(2, "p2"), (1, "p3")], "k int, place_id string")
    txt = spark.createDataFrame([(2, "p3"), (4, "p3")], "k int, place_id string")
    got = {r.k: (r.place_id, r.how) for r in joins.resolve(ev, "k", F.col("pid"), places, rule, txt).collect()}
    assert got == {1: ("p1", "id"), 2: ("p2", "rule"), 3: ("old", "own"), 4: ("p3", "text")}
    r = rules.rule_join(spark.createDataFrame([(1, "Wielka SALA klubu"), (2, None)], "k int, v string"), "k", F.col("v"), spark.createDataFrame([("klub", 2, "x"), ("sala", 1, "y")], "word string, rule_ord int, target string")).collect()
    assert [(x.k, x.target) for x in r] == [(1, "y")]


def test_rules(spark):
    df = spark.createDataFrame([("Teatr Lalek",), (None,)], "v string")
    assert [r[0] for r in df.select(rules.by_words(F.col("v"), [(["kino"], "k"), (["teatr"], "t")], "inne")).collect()] == ["t", "inne"]
    assert [r[0] for r in df.select(rules.flags(F.col("v"), {"a": ["lalek"], "b": ["x"]})).collect()] == [["a"], []]
    pick = spark.createDataFrame([("Sob 12:00 | Klub X | od 20 zł",), ("12:30",)], "v string").select(rules.pick_candidate(F.col("v"), ["klub"], F.lit("Miasto"))).collect()
    assert [r[0] for r in pick] == ["Klub X", "Miasto"]


def test_running_ids_and_audit(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int")
    got = [r.g for r in views.running_ids(df, "k", "g_", "g").orderBy("k").collect()]
    assert got == [f"g_{i:03d}" for i in range(1, 102)]
    s = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "z")], "k string, t string")
    assert {(r.k, r.active_events, r.samples) for r in audit.with_samples(s, "k", "t").collect()} == {("a", 3, "x | y"), ("b", 1, "z")}
