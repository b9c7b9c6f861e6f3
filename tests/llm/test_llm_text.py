import pytest
from pyspark.sql import functions as F

from plakat.llm import lookalike, mojibake, pii

CLEAN = ["Pieśni o źródłach", "Żarty dla zabłąkanych", "Świat na święto żniw", "Kołysanki w pół drogi", "Śmiech spod łąki", "koło gospodyń działa dziś", "Café Señal", "für älgar", "Вечір пісень", "Tańce na cztery ręce", "gość specjalny", "książki leżą"] * 6


@pytest.fixture(scope="module")
def model():
    return mojibake.train(CLEAN)


def fields(spark, values, js=False):
    rows = [("t", str(i), "f", v, js) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "tbl string, row_key string, field string, value string, is_json boolean")


def test_every_chain_is_inverted_by_undo():
    for chain in mojibake.CHAINS:
        g = mojibake.garble("Zażółć gęślą jaźń", chain)
        if g is not None and g != "Zażółć gęślą jaźń":
            assert mojibake.undo(g, chain) == "Zażółć gęślą jaźń"


def test_held_out_words_are_restored(model):
    words = ["wśród", "żaglówek", "północy", "dźwięki", "późne", "książkach", "Łódź"]
    right = total = 0
    for w in words:
        for chain in mojibake.CHAINS:
            g = mojibake.garble(w, chain)
            if g is None or g == w or " " in g:
                continue
            total += 1
            right += mojibake.predict([g], model)[0].originals.get(g) == w
    assert right / total > 0.8


def test_one_chain_a_field(model):
    """The chain predicted for whole titles: exactly the one applied, or one that undoes them to the same text."""
    titles = ["Pieśni o źródłach i dźwięki wśród żaglówek", "Późne książki – żarty spod łąki", "„Kołysanki” na północy, gość Żółty Świt", "Ćwiczenia dla zabłąkanych: śnieg, mżawka, gęś"]
    right = exact = total = 0
    for t in titles:
        for chain in mojibake.CHAINS:
            g = mojibake.garble(t, chain)
            if g is None or g == t:
                continue
            total += 1
            v = mojibake.predict([g], model)[0]
            exact += v.chain == chain
            right += mojibake.repair(g, v) == t
    assert right / total > 0.9 and exact / total > 0.75
    v = mojibake.predict(["Pie?ni o ?r?d?ach", "Co dalej? Nic.", "P��ne", "Café Señal"], model)
    assert [x.chain for x in v] == ["lost", None, "lost", None]


def test_found_fields(spark, model):
    bad = ["PieÅ›ni o rzece", "Ko³o Gospodyñ", "dla du�ych", "Go?cie chwal? nas", mojibake.garble("Żarty", "utf-8>cp1252>utf-8>cp1252")]
    good = ["Café Señal", "für älgar", "Вечір пісень", "Co dalej, sąsiedzie? w mieście", "https://x.example/a?b=1", "", None, "Ｆull", "x" * 50_000]
    got = {int(r.row_key) for r in mojibake.garbled_fields(fields(spark, bad + good), model).collect()}
    assert got == set(range(len(bad)))
    js = ['{"a": "Pie\\u00c5\\u203ani"}', '{"a": "Pie\\u015bni", "u": "https://x.example/?q=a"}', '{"a": ["Go?cie"]}', "not json PieÅ›ni", "{}"]
    out = {int(r.row_key): r.restored for r in mojibake.garbled_fields(fields(spark, js, True), model).collect()}
    assert set(out) == {0, 2, 3} and out[0] == '{"a": "Pieśni"}' and out[3] == "not json Pieśni"
    assert mojibake.garbled_fields(fields(spark, []), mojibake.fit(fields(spark, []))).count() == 0


def test_lookalikes(spark, model):
    bad = {
        "Jіli Воszulоn": "Jili Boszulon", "L​isty": "Listy", "Stand‐up": "Stand-up", "gość": "gość", "Ｊuti": "Juti", "szuﬂady": "szuflady",
        "Sny bez": "Sny bez", "Cienie о rzece": "Cienie o rzece", "\U0001f3ad Ta­ńce": "\U0001f3ad Tańce",
    }
    good = ["Вечір пісень", "Αλφα i Ωμέγα", "\U0001f469‍\U0001f3a4 Sny", "Trio №5 „x” – 12 m²", "  Klub  Nowy ", "o rzece", "КАЗКИ СТАРОГО МІСТА", "PieÅ›ni", "", None]
    f = fields(spark, [*bad, *good])
    garbled = mojibake.garbled_fields(f, model)
    got = {int(r.row_key): r.skeleton for r in lookalike.lookalike_fields(f, garbled).collect()}
    assert got == dict(enumerate(bad.values()))
    assert lookalike.lookalike_fields(fields(spark, []), garbled).count() == 0


def test_mixed_tokens_are_replaced_only_by_corpus_words(spark):
    values = ["Lіsty o rzece", "Listy z łąk", "Воszulоn", "Zоsia i Zosіa", "Zоsia sama", "о rzece", "КОТ"]
    got = {int(r.row_key): (r.kinds, r.canonical, r.skeleton) for r in lookalike.lookalike_fields(fields(spark, values)).collect()}
    assert got == {
        0: ("script", "Listy o rzece", "Listy o rzece"),
        2: ("script", "Воszulоn", "Boszulon"),
        3: ("script", "Zosia i Zosia", "Zosia i Zosia"),
        4: ("script", "Zosia sama", "Zosia sama"),
        5: ("word", "o rzece", "o rzece"),
    }


def test_pii_spans():
    t = "Pisze ANNA ŻDZIEBICZ (nr 44051401359), tel. (+48) 64 214 92 41, dowód XQV 414153, mail: a_b małpa listy kropka invalid. Adres: ul. R. Mrokoluka 80/4, 00-1 X."
    assert {(k, t[a:b]) for a, b, k in pii.find(t)} == {
        ("person", "ANNA ŻDZIEBICZ"), ("id_number", "44051401359"), ("phone", "(+48) 64 214 92 41"), ("id_number", "XQV 414153"), ("email", "a_b małpa listy kropka invalid"), ("address", "ul. R. Mrokoluka 80/4"),
    }
    for clean in ("Numer zamówienia 332778350, nr biletu 77451529676.", "Teatr im. Olgi Rdzawol", "Zespół „Jana Sokalicz” zagra", "ISBN 978-83-520633550-24", "PESEL 44051401358", "sceny: 50.51262, 18.79673", "Obserwuj nas: @mdk.modrzewin", "", None):
        assert pii.find(clean) == []
    assert [t[a:b] for t in ["z Romanem Tłuczymiczem", "Nupywecka Anna.", "L. Mrokolicz;", "leon rybidski, call"] for a, b, _ in pii.find(t)] == ["Romanem Tłuczymiczem", "Nupywecka Anna", "L. Mrokolicz", "leon rybidski"]


def test_pseudonyms_keep_format_and_links():
    key = b"k"
    assert sorted(pii.feistel(v, 777, key, "x") for v in range(777)) == list(range(777))
    assert all(pii.unfeistel(pii.feistel(v, 777, key, "x"), 777, key, "x") == v for v in range(0, 777, 7))
    a, b = pii.pseudonym("id_number", "44051401359", key), pii.pseudonym("id_number", "440514 01359", key)
    assert pii.valid_pesel(a) and b.replace(" ", "") == a and b[6] == " "
    p, q = pii.pseudonym("phone", "+48 601-234-567", key), pii.pseudonym("phone", "601234567", key)
    assert p.startswith("+48 ") and p[4:].replace("-", "") == q
    assert pii.pseudonym("phone", "601234567", b"other") != q


def test_pii_frames(spark):
    df = spark.createDataFrame([(1, "tel. 601 234 567 i 601 234 567"), (2, None), (3, ""), (1, "x " * 30_000)], "doc_id bigint, text string")
    assert pii.found_spans(df, "doc_id", "text").count() == 2
    got = sorted((r.doc_id, r.n_spans, r.text if r.text is None else len(r.text)) for r in pii.masked_texts(df, "doc_id", "text", "k").where(F.col("n_spans") == 0).collect())
    assert got == [(1, 0, 60_000), (2, 0, None), (3, 0, 0)]


def test_known_words_come_from_all_rows(spark, model):
    """Words that the classifier's sample doesn't hold."""
    values = ["Zofia Kuręda", "Zofia Kurêda", "Kapela Wytrzęsą", "Kapela Wytrzês¹", "Wytrzęs? dalej"]
    f = fields(spark, values)
    assert not {"kuręda", "wytrzęsą"} & model.words
    got = {values[int(r.row_key)]: r.restored for r in mojibake.garbled_fields(f, model).collect()}
    assert got == {"Zofia Kurêda": "Zofia Kuręda", "Kapela Wytrzês¹": "Kapela Wytrzęsą", "Wytrzęs? dalej": None}


def test_pseudonyms_of_persons_are_long():
    assert all(len(pii.pseudonym(k, "Jan Kowal", b"key")) == 24 for k in ("person", "email", "address"))


@pytest.mark.parametrize("name", ["Anna Wróbel", "Piotr Mazur", "Tomasz Wójcik", "Maria Zając", "Ewa Król", "Marek Dudek", "Jan Kaczmarek", "Jan Duda", "Anna Lis", "Oksana Kowalska", "John Smith"])
def test_names_outside_the_surname_endings(name):
    for text in (name, f"Grupę zapisał {name}, tel. 600 700 800", f"Kontakt: {name}."):
        assert (text.index(name), text.index(name) + len(name), "person") in pii.find(text)


def test_catalogue_lines_patrons_and_venues_are_no_persons():
    for text in ("Janu Wetorek – 82/2017", "Teatr im. Heleny Smużeń", "Opera Śląska", "Kino Miedziak", "Zespół „Jana Kołudar” zagra"):
        assert pii.find(text) == []


def test_phones_of_other_countries():
    for text, want in (("tel. +49 30 1234567", "+49 30 1234567"), ("call +1 212-555-0123 now", "+1 212-555-0123"), ("nr zamówienia +49 30 1234567", None)):
        assert [text[a:b] for a, b, k in pii.find(text) if k == "phone"] == ([want] if want else [])
    masked = pii.pseudonym("phone", "+49 30 1234567", b"k")
    assert masked.startswith("+49 ") and len(masked) == len("+49 30 1234567") and masked != "+49 30 1234567"


def test_fitted_names(spark):
    rows = [(i, f"Zgłoszenia przyjmuje {g} {s}. Rako Dryzidek – {i}/2010.\nKino Perkoz zaprasza") for i, (g, s) in enumerate([("Jan", "Kowalski"), ("Ewa", "Nowicka"), ("Adam", "Sadowski")] * 20)]
    df = spark.createDataFrame([*rows, (99, None), (98, "")], "id bigint, text string")
    w = pii.fit(df, "id", "text")
    assert (w == pii.fit(df.repartition(3), "id", "text")).all()
    assert [k for *_, k in pii.find("Zgłoszenia przyjmuje Anna Wróbel.", w)] == ["person"] and pii.find("Anna Dryzidek – 3/2010.", w) == []
    assert (pii.fit(df.where("id > 100"), "id", "text") == pii.prior_weights()).all()
