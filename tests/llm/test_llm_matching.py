import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plakat.llm import address, canonical, linkage
from plakat.runtime import read_table

REF = [("sg-mdk", "Miejski Dom Kultury", "sg", "Starograb"), ("md-mdk", "Miejski Dom Kultury", "md", "Modrzewin"), ("sg-iglica", "Muzeum Iglica", "sg", "Starograb"), ("sg-grobla", "Klub Na Grobli", "sg", "Starograb"), ("md-zuraw", "Scena „Żuraw” im. Olgi Rdzawol", "md", "Modrzewin"), ("md-kuznia", "Muzeum Kuźnia", "md", "Modrzewin"), ("md-perkoz", "Klub Perkoz", "md", "Modrzewin")]
REF += [(f"{a}-{k}-{w}".lower(), f"{k} {w}", a, t) for a, t in (("sg", "Starograb"), ("md", "Modrzewin")) for k, w in (("Muzeum", f"Wagon{a}"), ("Muzeum", f"Tartak{a}"), ("Klub", f"Olszyna{a}"), ("Klub", f"Dziupla{a}"), ("Scena", f"Rotunda{a}"))]


def test_names_are_mapped(spark):
    ref = spark.createDataFrame(REF, "entry string, entry_name string, area string, area_name string")
    context = spark.createDataFrame([("mala",), ("scena",), ("starograb",), ("modrzewin",)], "tok string")
    want = {
        ("w Miejskim Domu Kultury", "sg"): "sg-mdk", ("MDK Modrzewin", "md"): "md-mdk", ("Muze. Iglica", "sg"): "sg-iglica", ("Mała Scena, Iglcia muzeum", "sg"): "sg-iglica", ("Iglica, ul. Promenada 4", "sg"): "sg-iglica",
        ("Sсenа Żurаw", "md"): "md-zuraw", ("Kościół na Wzgórzu", "sg"): None, ("Klub Łasica", "md"): None, ("do ustalenia", "sg"): None, ("Starograb", "sg"): None, ("Perkoz", None): "md-perkoz", ("Miejski Dom Kultury, Modrzewin", None): "md-mdk", ("", "sg"): None, (None, "sg"): None,
    }
    asked = spark.createDataFrame(list(want) * 2, "name string, area string")
    got = {(r["name"], r.area): r.entry for r in canonical.map_names(asked, ref, context).collect()}
    assert got == want
    assert canonical.map_names(asked.where("false"), ref, context).count() == 0


def test_repair_tokens_against_brute_force(spark):
    ref = ["muzeum", "iglica", "teatr", "dom", "biblioteka"]
    toks = ["muzuem", "iglca", "teatrze", "dm", "bibliotece", "muze", "zamek", "iglica", "x" * 500]
    got = {(r.tok, r.rtok): r.sim for r in canonical.repair_tokens(spark.createDataFrame([(t,) for t in toks], "tok string"), spark.createDataFrame([(t,) for t in ref], "rtok string")).collect()}
    assert {("muzuem", "muzeum"), ("iglca", "iglica"), ("teatrze", "teatr"), ("dm", "dom"), ("bibliotece", "biblioteka"), ("muze", "muzeum")} <= set(got)
    assert got["iglica", "iglica"] == 1.0 and not any(t == "zamek" for t, _ in got)


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("ul Zielona, 71, 00-055 LERIZYN", ("lerizyn", "00055", "ul zielona", "71", "")),
        ("00-041 Pawalec, Poprzeczna 10 c/4", ("pawalec", "00041", "poprzeczna", "10", "c")),
        ("Kuszirno Boczna 134C m. 3", ("kuszirno", "", "boczna", "134", "c")),
        ("Fatatów Al. Grabowa nr 42", ("fatatow", "", "al. grabowa", "42", "")),
        ("Łąkowa  107, 00-132", ("", "00132", "lakowa", "107", "")),
        ("00-013 Dymakyn", ("dymakyn", "00013", "", "", "")),
        ("", ("", "", "", "", "")),
    ],
)
def test_lines(line, want):
    p = address.parse_line(line, frozenset({"kuszirno", "lerizyn"}))
    assert (p["town"], p["postcode"], p["street"], p["number"], p["letter"]) == want


def test_streets():
    same = lambda a, b: address.same_street("", a, "", b)
    assert same("stanislawy smuzeckiej", "s smuzeckiej") and same("smuzeckiej stanislawy", "smuzeckiej") and same("zielona", "zileona")
    assert not same("wierzbowa", "wisniowa") and not same("bukowina dolna", "bukowina gorna") and not address.same_street("ul", "topolowa", "al", "topolowa")


def test_buildings(spark):
    schema = "key string, side string, area string, street string, housenumber string, city string, postcode string, line string, town int"
    rows = [
        ("place:1", "place", "a", "ul. Zielona", "5 A", "Miwiwsk", "00-174", None, 0), ("place:2", "place", "a", "ZIELONA 5a/3", None, None, "00174", None, 0), ("place:3", "place", "a", "ul. Zielona", "5b", "Miwiwsk", "00-174", None, 0),
        ("event:1", "event", "a", None, None, None, None, "Miwiwsk, Zileona 5A", 0), ("event:2", "event", "a", None, None, "Miwiwsk", None, "ul. Zielona 5A", 0), ("event:3", "event", "a", None, None, None, None, '{"street": "Zielona", "housenumber": "5 a", "city": "Miwiwsk"}', 0),
        ("place:4", "place", "a", None, "5a", "Miwiwsk", None, None, 0), ("place:5", "place", "a", None, None, None, None, None, 0), ("place:6", "place", "a", "Zielona", "5a", None, None, None, 0),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {(r.key_a, r.key_b) for r in address.same_building_pairs(address.buildings(df)).collect()}
    one = ["event:1", "event:2", "event:3", "place:1", "place:2", "place:6"]
    assert got == {(x, y) for x in one for y in one if x < y and not (x[0] == y[0] == "e")}
    assert address.buildings(df.where("false")).count() == 0


def test_label_model_finds_the_accurate_votes():
    rng = np.random.default_rng(0)
    truth = rng.random(6000) < 0.4
    a = np.where(rng.random(6000) < 0.9, truth, ~truth)
    b = np.where(rng.random(6000) < 0.85, truth, ~truth)
    c = np.where(rng.random(6000) < 0.95, b, ~b)  # repeats b
    d = np.where(rng.random(6000) < 0.8, truth, ~truth)
    votes = pd.DataFrame({n: np.where(v, 1, 2) for n, v in zip("abcd", (a, b, c, d), strict=True)})
    patterns = votes.groupby(list("abcd")).size().reset_index(name="n")
    m = linkage.fit_label_model(patterns, list("abcd"), [3] * 4, [{1}] * 4, [{2}] * 4)
    p = m.posterior(votes.to_numpy()) > 0.5
    assert (p == truth).mean() > 0.9
    assert m.parents[2] == 1 or m.parents[1] == 2


def test_showings(spark):
    schema = "id bigint, source string, title string, date string, date_end string, start string, doors string, venue string, place string, town string, kind string, key int"
    base = dict(title="Recital: Kuro Nekonek – Opowieści bez końca", date="2027-03-16", date_end=None, start="18:30", doors=None, venue="Klub Muszla", place=None, town="sg", kind="concert")
    rows = []
    for k in range(300):
        t = dict(base, title=f"Recital: Artysta{chr(97 + k % 26)}{chr(97 + k // 26)}x Nazwisko{chr(97 + k // 26)}{chr(97 + k % 26)}q – Sny o rzece", date=f"2027-04-{1 + k % 28:02d}")
        rows += [(10 * k, "s1", *t.values(), 0), (10 * k + 1, "s2", *dict(t, title=t["title"].upper(), start="18:45").values(), 0), (10 * k + 2, "s3", *dict(t, start=None, doors="18:00").values(), 0), (10 * k + 3, "s2", *dict(t, start="21:45").values(), 0)]
    rows += [(9001, "s1", *dict(base, title=None).values(), 0), (9002, "s2", *dict(base, date=None).values(), 0), (9003, "s2", *dict(base, date="2027-03-17", date_end="2027-03-16").values(), 0), (9004, "s3", *base.values(), 0)]
    df = spark.createDataFrame([tuple(r) for r in rows], schema)
    out = linkage.showing_links(df).collect()
    got = {(r.id_a, r.id_b) for r in out}
    want = {(10 * k + a, 10 * k + b) for k in range(300) for a, b in ((0, 1), (0, 2), (1, 2))} | {(9003, 9004)}
    assert got == want and all(0.5 <= r.confidence <= 1 for r in out)


def test_venue_labels_of_the_data(spark, small):
    """Records with a usable place id are the truth."""
    from plakat.llm import queries

    asked, mapped = queries._venue_names(spark, small, all_rows=True)
    ok = {r[0] for r in read_table(spark, small, "venue_refs").select("place_id").collect()}
    m = {(r["name"], r.area): r.entry for r in mapped.collect()}
    rows = [r for r in asked.collect() if r.place_id in ok and r.area]
    assert sum(m[r["name"], r.area] == r.place_id for r in rows) / len(rows) > 0.97


def _announcements(rows):
    """Ordinary announcements to learn from, and the given (id, source, title, date, date_end, start, venue, town)."""
    out = []
    for k in range(200):
        a, b = chr(97 + k % 26), chr(97 + k // 26)
        t, d = f"Recital: Artysta{a}{b}x Nazwisko{b}{a}q – Sny o rzece", f"2027-04-{1 + k % 28:02d}"
        out += [(10**6 + 10 * k, "s1", t, d, None, "18:30", "Klub Muszla", "sg"), (10**6 + 10 * k + 1, "s2", t.upper(), d, None, "18:45", "Klub Muszla", "sg"), (10**6 + 10 * k + 2, "s2", t, d, None, "21:45", "Klub Muszla", "sg")]
    return [(*r[:6], None, r[6], None, r[7], "concert") for r in out + rows]


SHOWING = "id bigint, source string, title string, date string, date_end string, start string, doors string, venue string, place string, town string, kind string"


def test_showings_of_an_artist_of_many_rows(spark):
    rows = []
    for k in range(100):
        d = f"2027-{5 + k // 28:02d}-{1 + k % 28:02d}"
        rows += [(10 * k, "s1", "Koncert: Hara Hełodar", d, None, "19:00", "Klub Muszla", "sg"), (10 * k + 1, "s2", "Hara Hełodar – bilety", d, None, "19:00", "Klub Muszla", "sg" if k else None), (10 * k + 2, "s3", "Hara Hełodar", d, None, "22:30", "Klub Muszla", "sg")]
    got = {(r.id_a, r.id_b) for r in linkage.showing_links(spark.createDataFrame(_announcements(rows), SHOWING)).collect() if r.id_a < 10**6}
    assert got == {(10 * k, 10 * k + 1) for k in range(100)}


def test_long_tokens_match_their_equals(spark):
    long = "muzeum" * 8
    got = canonical.repair_tokens(spark.createDataFrame([(long,), (long + "x",)], "tok string"), spark.createDataFrame([(long,), ("dom",)], "rtok string")).collect()
    assert [tuple(r) for r in got] == [(long, long, 1.0)]


def test_equal_entries_go_to_the_smaller_id(spark):
    ref = spark.createDataFrame([("kino", "Nowy Zdrój", "a", "A"), ("alfa", "Nowy Zdrój", "a", "A"), ("z9", "Hala", "a", "A")], "entry string, entry_name string, area string, area_name string")
    asked = spark.createDataFrame([("Nowy Zdrój", "a"), ("Nowy Zdroj", None), (None, None), ("", "a"), ("Inna", "a")], "name string, area string")
    context = spark.createDataFrame([], "tok string")
    got = {(r.name, r.area): r.entry for r in canonical.map_names(asked, ref, context).collect()}
    assert got == {("Nowy Zdrój", "a"): "alfa", ("Nowy Zdroj", None): "alfa", (None, None): None, ("", "a"): None, ("Inna", "a"): None}
    popular = spark.createDataFrame([("kino", 3)], "entry string, popular bigint")
    assert {r.entry for r in canonical.map_names(asked.limit(2), ref, context, popular).collect()} == {"kino"}


def test_hot_words_give_the_same_links(spark, small, monkeypatch):
    """Words refined by town and start, split over parts, link what the plain join links."""
    from plakat.llm import queries

    plain = {(r.id_a, r.id_b) for r in queries._showings(spark, small).collect()}
    monkeypatch.setattr(linkage, "HOT_ROWS", 1)
    monkeypatch.setattr(linkage, "PART_ROWS", 1)
    assert plain and {(r.id_a, r.id_b) for r in queries._showings(spark, small).collect()} == plain


def test_records_meet_once(spark):
    """Every pair of compatible town and start meets in exactly one key; known contradictions never do, beyond neighbouring slots."""
    rows = [(i, c, t) for i, (c, t) in enumerate((c, t) for c in (None, 1, 2) for t in (None, 600, 640, 645, 700, 1200))]
    df = spark.createDataFrame(rows, "id int, c int, t int").withColumn("no_c", F.col("c").isNull())
    a = df.withColumn("m", F.explode(linkage._meets(True)))
    b = df.select(F.col("id").alias("id_b"), F.explode(linkage._meets(False)).alias("m"))
    got = {(r.id, r.id_b): r["count"] for r in a.join(b, "m").groupBy("id", "id_b").count().collect()}
    for i, c, t in rows:
        for j, d, u in rows:
            if (c is None or d is None or c == d) and (t is None or u is None or abs(t - u) <= linkage.APART_MINUTES or c == d is not None):
                assert got.get((i, j)) == 1
            elif c is not None and d is not None and c != d:
                assert (i, j) not in got
