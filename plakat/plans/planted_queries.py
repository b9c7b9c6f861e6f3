"""Driver queries over planted rows with their expected results as literals: operators that SQL cannot compute (ratios of matching blocks, greedy and sequential rules).

Each also runs over whole tables under another name (e02, e04, j04, m02).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plakat.functions import text
from plakat.functions.similarity import sequence_ratio
from plakat.operators import dedup, offers, store
from plakat.plans.registry import Registry

R = Registry()


def _sql(v):
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"


def expected(columns, rows):
    """Literal rows as SQL."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({', '.join(columns)})"


# (id, a, b, ratio): matching blocks are found longest first, so the order of texts counts.
RATIOS = [(1, "abcd", "bcde", 0.75), (2, "tide", "diet", 0.25), (3, "diet", "tide", 0.5), (4, "", "", 1.0), (5, "x", "", 0.0), (6, "jazz nad rzeką", "jazz nad rzeka", 0.928571), (7, None, "x", None)]


@R.add("e03_ratio", expected(["id", "ratio"], [(i, r) for i, _, _, r in RATIOS]))
def e03_ratio(spark, sf_dir):
    """Ratios of matching blocks."""
    df = spark.createDataFrame([r[:3] for r in RATIOS], "id int, a string, b string")
    return df.select("id", F.round(sequence_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


# (id, title, title, time, time, are they duplicates?)
TITLES = [
    (1, "Koncert Organowy", "Koncert Organowy", None, None, True), (2, "Stand-up: Nowy Program na żywo w Bielsku", "Nowy Program Standup Bielsko-Biała", None, None, True), (3, "Kordian", "Kordian", "17:00", "19:30", False),
    (4, "Kordian", "Kordian", "17:00", "17:15", True), (5, "Kordian", "Kordian", "17:00", "17:45", False), (6, "Bajka o kocie", "Wykład o fizyce", None, None, False), (7, "Opera nocą", "Opera nocna", "18:00", None, True),
    (8, "Jazz", "Wieczór: Jazz i blues", None, None, True), (9, "", "", None, None, True), (10, None, "Jazz", None, None, False), (11, "Koncert", "Spektakl", None, None, False),
]


@R.add("e02_title_pairs", expected(["id", "same"], [(t[0], t[5]) for t in TITLES]))
def e02_title_pairs(spark, sf_dir):
    """Duplicate titles of a day: times, raw ratio, stems, subset, sorted ratio."""
    df = spark.createDataFrame([t[:5] for t in TITLES], "id int, a string, b string, s string, t string")
    return df.select("id", dedup.same_title(F.col("a"), F.col("b"), F.col("s"), F.col("t")).alias("same"))


# (id, query, place, score): one row a branch of the cascade.
PLACES = [
    (1, "Mieszko Minkiewicz NCPP Kameralna", "Narodowe Centrum Polskiej Piosenki", 0.92), (2, "Katarzyna Piasecka Stand-up Studenckie Centrum Kultury", "Studenckie Centrum Kultury", 0.93),
    (3, "Filharmonia Zachodnia im. Józefa Elsnera", "Filharmonia Zachodnia", 0.945), (4, "Wydarzenie Teatr Jana Kochanowskiego", "OPO", 0.0), (5, "Wieczór OPO", "OPO", 0.95), (6, "", "Muzeum", 0.0),
    (7, "Iglica", "Muzeum Iglica Nowa", 0.9), (8, "xyz mura", "Zajazd Mury", 0.421053), (9, "ruina kolorowy", "Zajazd Kolorowa Sowa", 0.376471), (10, "kuznia wschod", "Teatr Kuznie Zachod", 0.5), (11, "galeria muzeum", "Muzeum Galeria", 0.95), (12, "filia kolorowy abc", "Teatr Kolorowa", 0.85),
]


@R.add("e01_place_scores", expected(["id", "score"], [(p[0], p[3]) for p in PLACES]))
def e01_place_scores(spark, sf_dir):
    """Similarity of a text and a place, every branch."""
    df = spark.createDataFrame([p[:3] for p in PLACES], "id int, q string, p string")
    return df.select("id", F.round(dedup.place_similarity(text.venue_tokens(F.col("q")), text.venue_tokens(F.col("p"))), 6).alias("score"))


@R.add("j03_by_text", expected(["id", "place_id", "score"], [(1, "p1", 0.92), (2, "p2", 0.93), (3, "p3", 0.945), (5, "p0", 0.95)]))
def j03_by_text(spark, sf_dir):
    """Best place of each text among all places, at least 0.75, the first of equal ones."""
    asked = spark.createDataFrame([p[:2] for p in PLACES if p[0] not in (7, 11)], "id int, q string")
    refs = spark.createDataFrame([("p0", "OPO"), ("p1", "Narodowe Centrum Polskiej Piosenki"), ("p2", "Studenckie Centrum Kultury"), ("p3", "Filharmonia Zachodnia"), ("p9", "Filharmonia Zachodnia")], "place_id string, name string")
    local = refs.select("place_id", text.venue_tokens(F.col("name")).alias("place_tokens"), F.col("place_id").alias("place_ord"))
    return dedup.resolve_by_text(asked, "id", text.venue_tokens(F.col("q")), local).select("id", "place_id", F.round("score", 6).alias("score"))


# (id, day, title, time, cluster): a row joins the first cluster with any duplicate, even if the first row of it isn't one.
CLUSTERS = [
    (1, "d1", "Jazz nad rzeką", None, 1), (2, "d1", "Bajka o kocie", None, 2), (3, "d1", "Jazz nad rzeką i blues", "18:00", 1), (4, "d1", "Blues rzeką nocą", None, 1), (5, "d1", "Jazz nad rzeką", "20:00", 1),
    (6, "d2", "Jazz nad rzeką", None, 6), (7, "d2", "Jazz nad rzeką", "10:00", 6), (8, "d2", "Bajka o kocie", "10:00", 8), (9, "d2", "bajka o KOCIE!", "11:00", 9), (10, None, "Bajka o kocie", None, 10),
]


@R.add("e04_planted_clusters", expected(["id", "cluster"], [(c[0], c[4]) for c in CLUSTERS]))
def e04_planted_clusters(spark, sf_dir):
    """Greedy clusters in order within a day."""
    df = spark.createDataFrame([c[:4] for c in CLUSTERS], "id int, day string, title string, time string")
    return dedup.greedy_clusters(df, ["day"], "id", "title", "time").select("id", "cluster")


@R.add("e05_cluster_records", expected(["cluster", "n_rows", "title", "description", "image_url", "place_id", "venue", "url"], [(1, 3, "Długi Tytuł Spektaklu Teatralnego", "dłuższy opis", "/assets/thumbnails/teatr.jpg", "p1", "Teatr Polski", "http://source1.com"), (4, 1, "Wykład", None, None, None, "Aula", "http://source4.com")]))
def e05_cluster_records(spark, sf_dir):
    """Record merge of whole clusters: longest texts, stored picture, first row with a place, the rest of the first row."""
    rows = [
        (1, "d", "Długi Tytuł Spektaklu Teatralnego", "19:00", "opis", "http://example.com/img1.jpg", None, "", "http://source1.com"), (2, "d", "Spektakl Teatralny", "19:00", "dłuższy opis", "/assets/thumbnails/teatr.jpg", "p1", "Teatr Polski", "http://source2.com"),
        (3, "d", "Długi spektakl teatralny", None, "opisy takie", "http://example.com/x.jpg", "p2", "Inny", "http://source3.com"), (4, "d", "Wykład", None, None, None, None, "Aula", "http://source4.com"),
    ]
    df = spark.createDataFrame(rows, "id int, day string, title string, time string, description string, image_url string, place_id string, venue string, url string")
    c = dedup.greedy_clusters(df, ["day"], "id", "title", "time")
    return dedup.merge_records(c, "cluster", "id", ["title", "description"], ["image_url", "url"], {"image_url": F.col("image_url").contains(store.THUMBNAILS)}, (F.col("place_id").isNotNull(), ["place_id", "venue"]))


_SELL = {"biletyna.pl": (80, "Biletyna"), "ncpp.opole.pl": (100, "NCPP Opole"), "kupbilecik.pl": (80, "KupBilecik")}


@R.add("e06_e07_sellers", expected(["event", "seller", "url", "price", "n_offers", "rank", "is_official"], [("a", "NCPP Opole", "https://bilety.ncpp.opole.pl/event/1", "140 zł", 1, 1, True), ("a", "Biletyna", "https://biletyna.pl/event/2", "160 zł", 2, 2, False), ("a", "KupBilecik", "https://kupbilecik.pl/event/1", None, 1, 3, False), ("b", "Biletyna", "https://biletyna.pl/event/1", "120 zł", 1, 1, False), ("b", "NCPP Opole", "https://bilety.ncpp.opole.pl/event/1", "140 zł", 1, 2, True)]))
def e06_e07_sellers(spark, sf_dir):
    """Offers grouped by the seller behind the link, a telling price replacing one that says nothing, then ranked by amount and authority."""
    rows = [
        ("a", 0, "https://biletyna.pl/event/1", None), ("a", 1, "https://bilety.ncpp.opole.pl/event/1?utm_source=x", "140 zł"), ("a", 2, "https://kupbilecik.pl/event/1", None), ("a", 3, "https://biletyna.pl/event/2", "160 zł"),
        ("b", 0, "https://biletyna.pl/event/1", "120 zł"), ("b", 1, "https://bilety.ncpp.opole.pl/event/1", "140 zł"),
    ]
    from plakat.functions.url import provider

    who = lambda c: provider(c, F.lit(None).cast("string"), {"ncpp.opole.pl": "NCPP Opole"}, {"biletyna.pl": "Biletyna", "kupbilecik.pl": "KupBilecik"}, ["teatr", "filharmonia"])
    df = spark.createDataFrame(rows, "event string, ord int, url string, price string")
    one = offers.dedup_offers(df, "event", who(F.col("url"))["name"], F.col("price").isNotNull())
    return offers.ranked_by_price(one, "event", who(F.col("url"))).select("event", "seller", "url", "price", "n_offers", "rank", "is_official")


# (ord, town, day, title, url, description, picture, discounts, price, offers)
_STORED = [
    (1, "a", "2026-07-01", "Jazz nad rzeką", "https://x/1", "krótki opis", "https://x/1.jpg", [], "50 zł", [("Biletyna", "https://b/1?x=1", "", [])]), (2, "a", "2026-07-01", "Opera nocą", "https://x/2", None, None, None, "", None),
    (3, "a", "2026-07-02", "Bajka o kocie", "https://x/3", "opis", "", [], "", []),
]
_BATCH = [
    (11, "a", "2026-07-05", "Bajka o kocie", "https://x/3", "nowy opis", "https://x/3b.jpg", ["-10%"], "20 zł", []),
    (12, "a", "2026-07-01T10:00", "JAZZ nad rzeką: koncert", "https://y/12", "dłuższy opis niż był", "/assets/thumbnails/j.webp", ["s"], "", [("Biletyna", "https://b/1", "60 zł", ["grupy"]), ("Kup", "https://k/9", "70 zł", [])]),
    (13, "a", "2026-07-01", "Wernisaż", "https://x/13", None, None, [], "", []), (14, "a", "2026-07-01", "Wernisaż prac", "", "opis", "", [], "", []), (15, "b", "2026-07-01", "Jazz nad rzeką", "https://x/15", None, None, None, None, None),
]
_EVENT = "ord int, town string, date_start string, title string, url string, description string, image_url string, discounts array<string>, price string, offers array<struct<provider:string,url:string,price:string,discounts:array<string>>>"


def _store(spark):
    return spark.createDataFrame(_STORED, _EVENT), spark.createDataFrame(_BATCH, _EVENT)


_K01 = [
    (1, 1, "2026-07-01", "JAZZ nad rzeką: koncert", "https://x/1", "dłuższy opis niż był", "/assets/thumbnails/j.webp", "s", "Kup|https://k/9|70 zł|;Biletyna|https://b/1?x=1|60 zł|grupy", 1),
    (2, 2, "2026-07-01", "Opera nocą", "https://x/2", None, None, "", "Bilety|https://x/2||", 0), (3, 11, "2026-07-05", "Bajka o kocie", "https://x/3", "nowy opis", "https://x/3b.jpg", "-10%", "Bilety|https://x/3|20 zł|", 0),
    (13, 13, "2026-07-01", "Wernisaż prac", "https://x/13", "opis", None, "", "Bilety|https://x/13||", 1), (15, 15, "2026-07-01", "Jazz nad rzeką", "https://x/15", None, None, "", "Bilety|https://x/15||", 0),
]


@R.add("k01_upsert_batch", expected(["target", "ord", "date_start", "title", "url", "description", "image_url", "discounts", "offers", "n_merged"], _K01))
def k01_upsert_batch(spark, sf_dir):
    """Store after a batch: replaced by link, merged into similar titles of the day field by field with their offers, inserted."""
    s, b = _store(spark)
    out = store.upsert_events(s, b, lambda u: F.lit("Bilety"), lambda u: F.when(u.contains("k/"), 100).otherwise(80))
    line = F.array_join(F.transform("offers", lambda o: F.concat_ws("|", o["provider"], o["url"], o["price"], F.array_join(o["discounts"], ","))), ";")
    return out.select("target", "ord", "date_start", "title", "url", "description", "image_url", F.array_join("discounts", ",").alias("discounts"), line.alias("offers"), "n_merged")


@R.add("m02_planted_actions", expected(["ord", "action", "target"], [(11, "update", 3), (12, "merge", 1), (13, "insert", 13), (14, "merge", 13), (15, "insert", 15)]))
def m02_planted_actions(spark, sf_dir):
    """Where each incoming row goes, in order; rows inserted earlier are targets too."""
    keyed = lambda df: df.select("town", F.substring("date_start", 1, 10).alias("date_start"), "ord", text.title_key(F.col("title")).alias("k"), F.nullif("url", F.lit("")).alias("url"))
    s, b = _store(spark)
    return dedup.fuzzy_upsert(keyed(s), keyed(b), ["town", "date_start"], "ord", "k", "url")


_LONG = "Zdanie ma trochę słów i tak dalej."


@R.add("t14_planted_paragraphs", expected(["id", "pos", "paragraph"], [(1, 0, "Koncert Wspaniały (sala) Dobra."), (1, 1, "* Czas trwania: 90 minut"), (1, 2, " ".join([_LONG] * 7)), (1, 3, " ".join([_LONG] * 2)), (1, 4, "UWAGA limit. na stronie"), (4, 0, "Abc def."), (4, 1, "P.S. Dopisek")]))
def t14_planted_paragraphs(spark, sf_dir):
    """Paragraphs of planted descriptions: glued words, labels, packing, openings, the phrase cut out; too short and null texts give none."""
    rows = [(1, f"KoncertWspaniały(sala)Dobra. Czas trwania: 90 minut<br/>{(_LONG + ' ') * 9}UWAGA limit. 🎭 Zobacz więcej informacji na stronie"), (2, "abc"), (3, None), (4, "Abc def. P.S. Dopisek")]
    df = spark.createDataFrame(rows, "id int, t string")
    return df.select("id", F.posexplode(text.paragraphs(F.col("t"))).alias("pos", "paragraph"))
