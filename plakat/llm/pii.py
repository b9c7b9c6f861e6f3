"""Personal data in free text: typed spans, readable placeholders, format-preserving pseudonyms."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plakat.llm.sampling import hashed_sample

#: Documents (those with the smallest hash) and word pairs of them on which the classifier of names is fitted.
TRAIN_ROWS, TRAIN_PAIRS = 4_000, 40_000
#: Hash buckets of its features.
BUCKETS = 1 << 14

# Common Polish given names, nominative.
GIVEN = """Adam Adrian Agata Agnieszka Albert Aleksander Aleksandra Alicja Alina Andrzej Anna Antoni Antonina Artur Barbara Bartosz Beata Bogdan Bogumiła Bogusław Bolesław Borys Bożena Bronisław Cezary
Czesław Damian Daniel Danuta Dariusz Dawid Dominik Dominika Dorota Edward Edyta Elżbieta Emil Emilia Eryk Ewa Ewelina Feliks Filip Franciszek Gabriela Grażyna Grzegorz Halina Hanna Helena Henryk Hubert Ignacy
Igor Irena Iwona Izabela Jacek Jadwiga Jakub Jan Janina Janusz Jarosław Jerzy Joanna Jolanta Józef Julia Julian Justyna Kacper Kamil Kamila Karol Karolina Katarzyna Kazimierz Kinga Klaudia Konrad Krystian
Krystyna Krzysztof Leon Leszek Lucjan Ludwik Łucja Łukasz Maciej Magdalena Małgorzata Marcel Marcin Marek Maria Marian Mariusz Marta Marzena Mateusz Michał Michalina Mieczysław Mikołaj Milena Mirosław Monika
Natalia Norbert Olga Oliwia Oskar Patrycja Patryk Paulina Paweł Piotr Przemysław Radosław Rafał Renata Robert Roman Ryszard Sabina Sebastian Sławomir Sonia Stanisław Stefan Sylwia Szymon Tadeusz Teresa Tomasz
Urszula Wacław Waldemar Wanda Weronika Wiesław Wiktor Wiktoria Witold Władysław Wojciech Zbigniew Zdzisław Zenon Zofia Zuzanna Zygmunt""".split()  # fmt: skip
# Given names of neighbours and guests, nominative.
GIVEN_ABROAD = """Aaron Albin Alice Anastasia Andreas Andrew Andrij Antonio Arthur Astrid Bernd Bohdan Bruno Carlos Caroline Charles Charlotte Christian Christine Claire Daniela David Denys Diana Dieter Dmytro Elena Elisabeth
Emma Eva Franz Frank Fritz George Giovanni Giulia Hans Harald Heinrich Ingrid Ivan Iryna James Jana Jason Jean Jennifer Jessica Jiří John Jörg Joseph Juan Jürgen Karin Karl Kateryna Kevin Klaus Kurt Larysa Laura Lena Linda Lisa Louise
Ludmila Luis Luke Manfred Marco Margaret Marie Mark Markus Martin Mary Matthew Michael Mychajło Mykoła Nadia Nicole Oksana Oleg Ołeksandr Ołena Oleh Pablo Patrick Paul Pavel Petr Peter Petra Philip Pierre Richard Rosa Samuel Sara Sarah
Serhij Simon Sophie Stefanie Stephen Steven Susan Susanne Svitlana Taras Tatiana Thomas Tim Ulrich Uwe Vaclav Victor Viktor Vincent Vira Volodymyr Walter William Wolfgang Yuliia""".split()  # fmt: skip
# Nouns that begin names of venues, bodies and events.
VENUE_WORDS = frozenset("teatr opera kino muzeum galeria klub pub scena sala hala dom centrum filharmonia amfiteatr biblioteka orkiestra zespół fundacja stowarzyszenie szkoła akademia gmina miasto powiat festiwal noc dni plac park".split())
#: Endings of Polish surnames that tell persons from bands, with their cases.
SURNAME_ENDING = r"(?:(?:s|c|dz)k(?:i|a|iego|iemu|im|iej|ą|ich)|icz(?:a|owi|em|u|owie|ów)?|(?<=\w\w)uk(?:a|owi|iem|u)?|czyk(?:a|owi|iem)?|(?<=\w\w\w)ak(?:a|owi|iem)?|wicz(?:a|owi|em)?)"
NOT_PHONE = re.compile(r"(?i)(zam[óo]wieni\w*|katalogow\w*|\bkat\.|bilet\w*|rezerwacj\w*|spraw\w*|faktur\w*|\border\b|ticket|booking|isbn|issn|krs|nip|regon|kont[oa]|№|numer\s+zam\w*)\W{0,3}(?:nr\.?|numer|no\.?)?\W{0,3}$")
_UP = "A-ZĄĆĘŁŃÓŚŹŻ"
_LOW = "a-ząćęłńóśźż"
_GAP = r"[    ]"

_AT = rf"(?:{_GAP}?@{_GAP}?|{_GAP}?[\[(]{_GAP}?(?:at|małpa|malpa|a){_GAP}?[\])]{_GAP}?|{_GAP}(?:małpa|malpa){_GAP})"
_DOT = rf"(?:\.|{_GAP}?[\[(]{_GAP}?(?:dot|kropka){_GAP}?[\])]{_GAP}?|{_GAP}(?:kropka|dot){_GAP})"
EMAIL = re.compile(rf"(?i)(?<![\w.+-])[\w][\w.+%-]*{_AT}[\w-]+(?:{_DOT}[\w-]+)+")
#: A plain "at" counts only where the dots are written out too.
SPOKEN = re.compile(rf"(?i)(?<![\w.+-])[\w][\w.+%-]*{_GAP}at{_GAP}[\w-]+(?:{_GAP}(?:dot|kropka){_GAP}[\w-]+)+")
_PHONE_BODY = rf"(?:\(\d\d\){_GAP}?\d{{3}}{_GAP}\d\d{_GAP}\d\d|\d\d{_GAP}\d{{3}}{_GAP}\d\d{_GAP}\d\d|\d{{3}}(?:{_GAP}|[-.‑–])\d{{3}}(?:{_GAP}|[-.‑–])\d{{3}}|\d{{9}})"
PHONE = re.compile(rf"(?<![\w./=+(-])(?<!\d{_GAP})(?:(?:\(\+48\)|\+48|0048){_GAP}?)?{_PHONE_BODY}(?![\w/=-]|[.,]\d)")
#: Numbers of other countries always carry their prefix.
_ABROAD = rf"(?:\(\+\d{{1,3}}\)|\+\d{{1,3}}|00[1-9]\d{{0,2}})"
PHONE_ABROAD = re.compile(rf"(?<![\w./=+(-])(?<!\d{_GAP}){_ABROAD}{_GAP}?(?:\(0?\d{{1,4}}\){_GAP}?)?\d{{1,5}}(?:(?:{_GAP}|[-.‑–/])?\d{{2,5}}){{1,4}}(?![\w/=-]|[.,]\d)")
PESEL = re.compile(rf"(?<![\w./=+-])(?<!\d{_GAP})\d{{6}}{_GAP}?\d{{5}}(?![\w/=-]|[.,]\d)")
DOCUMENT = re.compile(rf"(?<![\w./=-])(?:[A-Z]{{3}}{_GAP}?\d{{6}}|[A-Z]{{2}}{_GAP}?\d{{7}})(?![\w/=-])")
_KIND = r"(?:ul|ulica|ulicy|ulicą|al|aleja|alei|aleje|pl|plac|placu|os|osiedle|osiedlu)"
_NUMBER = rf"(?:(?:nr|numer)\.?{_GAP})?\d{{1,4}}(?:{_GAP}?[A-Ha-hJ-Lj-l](?![\w]))?(?:{_GAP}?/{_GAP}?\d{{1,4}}[a-zA-Z]?(?!\w)|{_GAP}?(?:m|lok|mieszk)\.?{_GAP}?\d{{1,4}}(?!\w))?"
_STREET_WORD = rf"(?:[{_UP}][{_LOW}{_UP}]*\.?|(?:gen|dr|ks|prof|św|płk|mjr|kpt|marsz)\.|[{_LOW}]{{3,}})"
ADDRESS = re.compile(rf"(?<![\w.])(?i:{_KIND})(?:\.{_GAP}?|{_GAP}+)(?:{_STREET_WORD}(?:[{_GAP[1:-1]}-]+|(?<=\.))){{1,4}}?{_NUMBER}(?!\w)")
#: Where an address may begin; patterns that begin with plain letters are found much faster.
_KIND_START = re.compile(rf"(?:ul|Ul|UL|al|Al|AL|pl|Pl|PL|os|Os|OS)(?i:ica|icy|icą|eja|ei|eje|ac|acu|iedle|iedlu)?(?:\.|{_GAP})")
#: Runs of six digits or more: only around them lie phones and identity numbers.
_RUN = re.compile(r"\d(?:[^\w\n]{0,3}\d){5,}")
SQUARE = re.compile(rf"(?<![\w.])(?i:rynek|rynku){_GAP}(?:[{_UP}]\w+{_GAP})?{_NUMBER}(?!\w)")
_PLAIN = rf"(?:(?:gen|dr|ks|prof|św|płk|mjr|kpt|marsz)\.{_GAP}?)?(?:[{_UP}]\.{_GAP}?)?[{_UP}{_LOW}][{_LOW}{_UP}]+(?:{_GAP}[{_UP}{_LOW}][{_LOW}{_UP}]+){{0,2}}{_GAP}{_NUMBER}(?!\w)"
#: Words before an address that names no kind of street.
LEADS = re.compile(rf"(?:przy(?<!\wprzy)|Przy|PRZY|adres(?:em|u)?:?|Adres(?:em|u)?:?|ADRES(?:EM|U)?:?|адреса:|Адреса:|korespondencji(?: to|:)|Korespondencji(?: to|:)|address:|Address:|adresse:|Adresse:|wohnt in der|Wohnt in der|lives at|Lives at){_GAP}+")
PLAIN = re.compile(_PLAIN)
AFTER_NAME = re.compile(rf",{_GAP}+({_PLAIN})(?=,{_GAP}\d\d-\d{{3}}|{_GAP}w{_GAP}[{_UP}]|[.\s]*$|\.\s)")
PATRON = re.compile(rf"(?:im|Im|IM)(?<!\w[Ii][Mm])(?i:ienia)?\b\.?{_GAP}+(?:[{_UP}]\w*\.?{_GAP}?){{1,3}}")
QUOTED = re.compile(r"[„“«\"][^„“”«»\"\n]{2,80}[”“»\"]")


def _cases(name: str) -> set[str]:
    """A given name in its grammatical cases, by rule."""
    out = {name}
    if name.endswith("a"):
        s = name[:-1]
        out |= {s + "ą", s + "ę", s + ("i" if s[-1] in "kgilj" else "y"), s + "o"}
        soft = {"t": "cie", "d": "dzie", "r": "rze", "n": "nie", "ł": "le", "w": "wie", "k": "ce", "g": "dze", "b": "bie", "z": "zie", "m": "mie", "l": "li", "i": "i", "j": "i", "s": "sie", "c": "cy", "p": "pie"}
        out.add(s[:-1] + soft.get(s[-1], s[-1] + "ie"))
    elif name.endswith("y") or name.endswith("i"):
        s = name[:-1] if name.endswith("y") else name
        out |= {s + "ego", s + "emu", s + "ym" if name.endswith("y") else s + "m"}
    else:
        s = name
        if name.endswith("ek"):
            s = name[:-2] + "k"
        elif name.endswith("eł"):
            s = name[:-2] + "ł"
        out |= {s + "a", s + "owi", s + ("iem" if s[-1] in "kg" else "em"), s + "ie", s + "u"}
        if s[-1] in "ł":
            out.add(s[:-1] + "le")
        if s[-1] == "r":
            out.add(s + "ze")
    return out


NAMES = frozenset(c.lower() for n in [*GIVEN, *GIVEN_ABROAD] for c in _cases(n))
_NAME = r"[^\W\d_]+(?:[-’'][^\W\d_]+)*"
_ENDING = re.compile(rf"(?i).*{SURNAME_ENDING}$")
_STRONG = re.compile(r"(?i).*(?:(?:s|c|dz)k(?:i|a|iego|iemu|im|iej|ą|ich)|icz(?:a|owi|em|u|owie|ów)?)$")
#: Neighbouring words with capitals; found at every word, so that each may begin or end a name.
_CAPITALS = re.compile(rf"[{_UP}](?<![\w.-][{_UP}])(?=([^\W\d_]+(?:[-’'][^\W\d_]+)*)({_GAP}{{1,2}})([{_UP}]{_NAME})(?![\w-]))")
#: A surname in small letters with its neighbours.
_SMALL = re.compile(rf"(?<![\w-])[{_LOW}]+(?:sk|ck|dzk|icz|uk|czyk|ak|wicz)[{_LOW}ó]{{0,4}}(?![\w-])")
_BEFORE, _AFTER = re.compile(rf"(?<![\w-])({_NAME}){_GAP}$"), re.compile(rf"{_GAP}({_NAME})(?![\w-])")
_INITIAL_FIRST = re.compile(rf"[{_UP}](?<![\w.][{_UP}])\.{_GAP}?(?:[{_UP}]\.{_GAP}?)?([{_UP}][^\W\d_]+(?:-[{_UP}][^\W\d_]+)?)")
_INITIAL_LAST = re.compile(rf"[{_UP}](?<![\w.-][{_UP}])[^\W\d_]+(?:-[{_UP}][^\W\d_]+)?{_GAP}[{_UP}]\.(?!\w)")
#: A line of a catalogue or repertoire: name, dash, number and year.
_LISTED = re.compile(rf"{_GAP}?[–—-]{_GAP}?\d+/\d{{4}}")
_LAST_WORDS = re.compile(r"([^\W\d_]*)\W*([^\W\d_]*)(\W*)$")


def valid_pesel(digits: str) -> bool:
    """Check digit and a real date (the month tells the century)."""
    if len(digits) != 11 or sum(int(d) * w for d, w in zip(digits, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1), strict=True)) % 10:
        return False
    return _pesel_date(digits) is not None


_CENTURY = {0: 1900, 1: 2000, 2: 2100, 3: 2200, 4: 1800}


def _pesel_date(digits: str) -> dt.date | None:
    y, m, d = int(digits[:2]), int(digits[2:4]), int(digits[4:6])
    try:
        return dt.date(_CENTURY[m // 20] + y, m % 20, d)
    except (ValueError, KeyError):
        return None


@lru_cache(maxsize=200_000)
def _is_name(word: str) -> bool:
    return word.lower() in NAMES


@lru_cache(maxsize=200_000)
def _is_surname(word: str) -> bool:
    return len(word) > 3 and bool(_ENDING.match(word)) and word.lower() not in NAMES


# The classifier of names ----------------------------------------------------------------------------

# Prior weights of the features that don't depend on a corpus; fitting starts from them.
PRIOR = {"bias": -3.0, "given first": 4.5, "given last": 4.5, "given small": 5.0, "no given": -1.5, "strong": 2.0, "weak": 1.0, "listed": -8.0, "venue": -6.0}


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


_FIXED = {f: _bucket(f) for f in PRIOR}


def prior_weights() -> np.ndarray:
    w = np.zeros(BUCKETS, np.float32)
    for f, v in PRIOR.items():
        w[_FIXED[f]] += v
    return w


@lru_cache(maxsize=100_000)
def _word_features(side: str, word: str) -> tuple[int, ...]:
    """Hashed n-grams at both ends of a word, and its shape."""
    low = word.lower()
    shape = "A" if word.isupper() else "a" if word.islower() else "Aa"
    return tuple(_bucket(f"{side}{x}") for x in (f"shape {shape}", f"^{low[:2]}", f"^{low[:3]}", f"{low[-2:]}$", f"{low[-3:]}$", f"={low}"))


@lru_cache(maxsize=100_000)
def _context_feature(name: str, value: str) -> int:
    return _bucket(f"{name} {value}")


def _pair_features(kind: str, first: str, last: str, surname: str, before: str, after: str) -> list[int]:
    """Features of a candidate: which word is a given name, n-grams and shapes of both, the words around."""
    out = [_FIXED["bias"], _FIXED[kind]]
    if _STRONG.match(surname):
        out.append(_FIXED["strong"])
    elif _is_surname(surname):
        out.append(_FIXED["weak"])
    if _LISTED.match(after):
        out.append(_FIXED["listed"])
    if first.lower() in VENUE_WORDS:
        out.append(_FIXED["venue"])
    out += _word_features("1", first)
    out += _word_features("2", last)
    m = _LAST_WORDS.search(before)
    out += [_context_feature("before", m[2].lower()), _context_feature("before that", m[1].lower()), _context_feature("sign before", m[3].strip()[-1:]), _context_feature("after", after[:2])]
    return out


def _candidates(text: str) -> Iterator[tuple[int, int, str, str, str, str]]:
    """Neighbouring words of which one at least looks like a part of a name: (start, end, kind, first, last, surname)."""
    pairs = [(m.start(), m.start(3), m.end(3), m[0] + m[1], m[3]) for m in _CAPITALS.finditer(text)]
    follows = {p[0]: p for p in pairs}
    for a, b, e, w1, w2 in pairs:
        if _is_name(w1):
            if not _is_name(w2):
                if len(w2) > 2:
                    yield a, e, "given first", w1, w2, w2
            elif b in follows and not _is_name(follows[b][4]) and len(follows[b][4]) > 2:  # a second given name
                yield a, follows[b][2], "given first", w1, follows[b][4], follows[b][4]
        elif _is_name(w2):
            if _is_surname(w1):
                yield a, e, "given last", w1, w2, w1
        elif _STRONG.match(w2) and len(w2) > 4:
            yield a, e, "no given", w1, w2, w2
    for m in _SMALL.finditer(text):
        if _is_surname(m[0]):
            p = _BEFORE.search(text, max(0, m.start() - 40), m.start())
            n = _AFTER.match(text, m.end())
            if p and p[1].islower() and _is_name(p[1]):
                yield p.start(), m.end(), "given small", p[1], m[0], m[0]
            elif n and n[1].islower() and _is_name(n[1]):
                yield m.start(), n.end(), "given small", m[0], n[1], m[0]


def _hidden(text: str) -> str:
    """Patrons and quoted names blanked out; a quotation with a colon holds speech or data and stays."""
    if '"' in text or "„" in text or "“" in text or "«" in text:
        text = QUOTED.sub(lambda m: m[0] if ":" in m[0] else "\x00" * len(m[0]), text)
    return PATRON.sub(lambda m: "\x00" * len(m[0]), text)


def _persons(text: str, weights: np.ndarray) -> list[tuple[int, int]]:
    """Names the classifier accepts, of overlapping ones those with a surname ending first, then the surest; and initials with a surname."""
    scored = []
    for a, e, kind, first, last, surname in _candidates(text):
        score = float(weights[_pair_features(kind, first, last, surname, text[max(0, a - 40) : a], text[e : e + 12])].sum())
        if score > 0:
            scored.append((not _is_surname(surname), -score, a, e))
    out: list[tuple[int, int]] = []
    for *_, a, e in sorted(scored):
        if not any(s < e and a < t for s, t in out):
            out.append((a, e))
    for pattern in (_INITIAL_FIRST, _INITIAL_LAST):
        for m in pattern.finditer(text):
            if _is_surname(m[1] if pattern is _INITIAL_FIRST else m[0][:-3]) and not any(s < m.end() and m.start() < e for s, e in out):
                out.append((m.start(), m.end()))
    return out


def _labelled(text: str, rng: np.random.Generator) -> list[tuple[int, float, list[int]]]:
    """Labelled pairs (label, weight, features) of a text.

    Sure names (given name and surname ending) are positive, also with the surname exchanged for any capitalised word of the text, and with the
    given name exchanged for one. Other capitalised pairs, quoted names and lines of catalogues are negative, the latter also with a given name put in.
    """
    body = _hidden(text)
    out: list[tuple[int, float, list[int]]] = []
    caps = [(m.start(), m.end(3), m[0] + m[1], m[3]) for m in _CAPITALS.finditer(text)]
    words = [w for c in caps for w in c[2:] if not _is_name(w) and not _is_surname(w)]
    sure: set[int] = set()
    for a, e, kind, first, last, surname in _candidates(body):
        before, after = text[max(0, a - 40) : a], text[e : e + 12]
        if kind == "no given" or _LISTED.match(after) or not _is_surname(surname):
            continue
        sure.update(range(a, e))
        out.append((1, 1.0, _pair_features(kind, first, last, surname, before, after)))
        if kind == "given first" and words:
            other = words[int(rng.integers(len(words)))]
            out.append((1, 0.5, _pair_features(kind, first, other, other, before, after)))
            if _STRONG.match(surname):
                out.append((1, 0.3, _pair_features("no given", other, last, surname, before, after)))
    for a, e, w1, w2 in caps:
        if a in sure or e - 1 in sure:
            continue
        before, after = text[max(0, a - 40) : a], text[e : e + 12]
        if _LISTED.match(after):
            given = GIVEN[int(rng.integers(len(GIVEN)))]
            out.append((0, 1.0, _pair_features("given first", given, w2, w2, before, after)))
        if not _is_name(w1) and not _is_name(w2):
            out.append((0, 0.5, _pair_features("no given", w1, w2, w2, before, after)))
    return out


def fit(df: DataFrame, id_col: str, text_col: str, rows: int = TRAIN_ROWS, pairs: int = TRAIN_PAIRS) -> np.ndarray:
    """Weights of the classifier of names: logistic regression from the prior on at most ``pairs`` pairs of at most ``rows`` texts, those with the smallest hashes.

    Only hashed features reach the driver. Without any text the prior stays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(zlib.crc32(np.array(f).tobytes()), y, w, f) for h, t in zip(pdf["_h"], pdf[text_col], strict=True) for y, w, f in _labelled(t, np.random.default_rng(abs(h)))]
            yield pd.DataFrame(got, columns=["h", "y", "w", "f"])

    texts = hashed_sample(df.select(id_col, text_col), [id_col, text_col], rows).where(F.length(text_col) > 0)
    found = texts.select("_h", text_col).mapInPandas(run, "h bigint, y int, w double, f array<int>").orderBy("h").limit(pairs).collect()
    return train([(r["y"], r["w"], r["f"]) for r in found])


def train(labelled: list[tuple[int, float, list[int]]], rounds: int = 8, rate: float = 0.15) -> np.ndarray:
    """Adaptive gradient steps over hashed features, in a fixed order."""
    weights = prior_weights()
    if not labelled:
        return weights
    sizes = np.array([len(f) for _, _, f in labelled])
    flat = np.concatenate([np.array(f, np.int64) for _, _, f in labelled])
    starts = np.r_[0, np.cumsum(sizes)]
    y, w = np.array([x[0] for x in labelled], np.float32), np.array([x[1] for x in labelled], np.float32)
    seen = np.full(BUCKETS, 1.0, np.float32)
    order = np.random.default_rng(0).permutation(len(labelled))
    for _ in range(rounds):
        for lot in np.array_split(order, max(1, len(order) // 256)):
            at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in lot])
            own = np.repeat(np.arange(len(lot)), sizes[lot])
            score = np.bincount(own, weights[flat[at]], len(lot))
            slope = np.bincount(flat[at], (w[lot] * (y[lot] - 1 / (1 + np.exp(-score))))[own], BUCKETS).astype(np.float32)
            seen += slope * slope
            weights += rate * slope / np.sqrt(seen)
    return weights


_PRIOR_WEIGHTS = prior_weights()
_DIGIT = re.compile(r"\d")
_AT_HINT = re.compile(r"@|[\[(][  ]?(?:at|a|ma[łl]pa)[  ]?[\])]|[  ]ma[łl]pa[  ]", re.I)


def find(text: str | None, weights: np.ndarray = _PRIOR_WEIGHTS) -> list[tuple[int, int, str]]:
    """Spans (start, end, type), in order and without overlaps; none for null and empty texts. ``weights`` are those of the classifier of names.

    Earlier kinds win: email, identity numbers, phone, address, person. Patrons ("im. ..."),
    quoted names and streets are no persons; numbers named as orders, tickets,
    bookings, catalogue or case numbers are neither phones nor identity numbers.
    """
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []
    body = text

    def take(a: int, b: int, kind: str) -> None:
        nonlocal body
        spans.append((a, b, kind))
        body = body[:a] + "\x00" * (b - a) + body[b:]

    if _AT_HINT.search(text):
        for m in EMAIL.finditer(body):
            take(m.start(), m.end(), "email")
    if " at " in text:
        for m in SPOKEN.finditer(body):
            take(m.start(), m.end(), "email")
    if _DIGIT.search(body):
        runs = [(m.start(), m.end()) for m in _RUN.finditer(body)]
        for pattern, kind in ((DOCUMENT, "id_number"), (PESEL, "id_number"), (PHONE, "phone"), (PHONE_ABROAD, "phone")):
            for start, end in runs:
                at = max(0, start - 12)
                while (m := pattern.search(body, at, end + 20)) and m.start() <= end:
                    at = m.end()
                    digits = [c for c in m[0] if c.isdigit()]
                    sure = valid_pesel("".join(digits)) if pattern is PESEL else 9 <= len(digits) <= 15 if pattern is PHONE_ABROAD else True
                    if sure and not NOT_PHONE.search(body, max(0, m.start() - 40), m.start()):
                        take(m.start(), m.end(), kind)
        for start in _KIND_START.finditer(body):
            m = ADDRESS.match(body, start.start())
            if m:
                take(m.start(), m.end(), "address")
        if "ynek" in body or "ynku" in body or "YNEK" in body or "YNKU" in body:
            for m in SQUARE.finditer(body):
                take(m.start(), m.end(), "address")
        for lead in LEADS.finditer(body):
            m = PLAIN.match(body, lead.end())
            if m:
                take(m.start(), m.end(), "address")
    people = _persons(_hidden(body), weights)
    for a, b in people:
        m = AFTER_NAME.match(body, b)
        if m:
            take(m.start(1), m.end(1), "address")
    for a, b in people:
        if "\x00" not in body[a:b]:
            take(a, b, "person")
    return sorted(spans)


# Pseudonyms ------------------------------------------------------------------------------------------


def _round(key: bytes, tweak: str, r: int, value: int, modulus: int) -> int:
    return int.from_bytes(hmac.new(key, f"{tweak}:{r}:{value}".encode(), hashlib.blake2b).digest()[:16], "big") % modulus


def feistel(value: int, size: int, key: bytes, tweak: str, rounds: int = 8) -> int:
    """Keyed permutation of 0..size-1: alternating Feistel over a*b >= size, walking the cycle back into the range."""
    a = max(1, int(size**0.5))
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for r in range(rounds):
            if r % 2:
                right = (right + _round(key, tweak, r, left, b)) % b
            else:
                left = (left + _round(key, tweak, r, right, a)) % a
        value = left * b + right
        if value < size:
            return value


def unfeistel(value: int, size: int, key: bytes, tweak: str, rounds: int = 8) -> int:
    """Inverse of ``feistel``."""
    a = max(1, int(size**0.5))
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for r in reversed(range(rounds)):
            if r % 2:
                right = (right - _round(key, tweak, r, left, b)) % b
            else:
                left = (left - _round(key, tweak, r, right, a)) % a
        value = left * b + right
        if value < size:
            return value


_FIRST_DAY = dt.date(1800, 1, 1).toordinal()
_DAYS = dt.date(2299, 12, 31).toordinal() - _FIRST_DAY + 1


def _refill(pattern: str, chars: str) -> str:
    """Put characters in place of the letters and digits of a written form, separators kept."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


_PREFIX = re.compile(rf"(?:(?:\(\+48\)|\+48|0048)|{_ABROAD}(?=\D)){_GAP}?")


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, found: str, key: bytes) -> str:
    """Same format, other value: digits and letters are keyed-permuted, so equal values stay equal however they are separated.

    Personal numbers keep a valid date and check digit; phones keep their country prefix; other kinds get a keyed tag.
    """
    if kind == "phone":
        prefix = _PREFIX.match(found)
        head = prefix[0] if prefix else ""
        digits = re.sub(r"\D", "", found[len(head) :])
        n = feistel(int(digits), 10 ** len(digits), key, f"phone{len(digits)}")
        return head + _refill(found[len(head) :], str(n).zfill(len(digits)))
    if kind == "id_number":
        bare = re.sub(r"\W", "", found)
        if bare.isdigit() and len(bare) == 11:
            day = _pesel_date(bare)
            new = dt.date.fromordinal(_FIRST_DAY + feistel(day.toordinal() - _FIRST_DAY, _DAYS, key, "date"))
            serial = str(feistel(int(bare[6:10]), 10_000, key, "serial")).zfill(4)
            month = new.month + {1900: 0, 2000: 20, 2100: 40, 2200: 60, 1800: 80}[new.year // 100 * 100]
            ten = f"{new.year % 100:02d}{month:02d}{new.day:02d}{serial}"
            return _refill(found, ten + str(-sum(int(d) * w for d, w in zip(ten, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3), strict=True)) % 10))
        letters, digits = re.sub(r"\d", "", bare), re.sub(r"\D", "", bare)
        number = 0
        for c in letters:
            number = number * 26 + ord(c.upper()) - 65
        number = feistel(number, 26 ** len(letters), key, f"letters{len(letters)}")
        out = ""
        for _ in letters:
            out = chr(65 + number % 26) + out
            number //= 26
        return _refill(found, out + str(feistel(int(digits), 10 ** len(digits), key, f"digits{len(digits)}")).zfill(len(digits)))
    plain = re.sub(r"\W+", " ", found.lower()).strip()
    return hmac.new(key, f"{kind}:{plain}".encode(), hashlib.blake2b).hexdigest()[:24]


def mask(text: str | None, spans: list[tuple[int, int, str]], key: bytes) -> str | None:
    """The text with ``[TYPE pseudonym]`` in place of each span; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()} {pseudonym(kind, text[a:b], key)}]"]
        at = b
    return "".join([*out, text[at:]])


def _may_hold(c: str) -> Column:
    """Cheap JVM test: a digit, a sign of an address, a capital, or a surname's ending; other texts hold nothing that ``find`` looks for."""
    return F.coalesce(F.col(c).rlike(r"(?iu)[\d@]|\bat\b|ma[łl]pa|(s|c|dz)k[iaąie]|icz|uk|czyk|ak") | F.col(c).rlike(r"\p{Lu}\p{L}+\s\p{Lu}"), F.lit(False))


def found_spans(df: DataFrame, id_col: str, text_col: str, weights: np.ndarray | None = None) -> DataFrame:
    """Every span of every text: (id_col, pii_type, start, found); texts without any give no row, repeated rows repeat."""
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(_PRIOR_WEIGHTS if weights is None else weights)  # BUCKETS numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, k, a, t[a:b]) for i, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True) for a, b, k in find(t, shared.value)]
            yield pd.DataFrame(out, columns=[id_col, "pii_type", "start", "found"])

    return df.select(id_col, text_col).where(_may_hold(text_col)).mapInPandas(run, f"`{id_col}` {kind}, pii_type string, start int, found string")


def masked_texts(df: DataFrame, id_col: str, text_col: str, key: str, weights: np.ndarray | None = None) -> DataFrame:
    """(id_col, text, n_spans) with typed placeholders; null and empty texts stay as they are."""
    kind = dict(df.dtypes)[id_col]
    secret = key.encode()
    shared = df.sparkSession.sparkContext.broadcast(_PRIOR_WEIGHTS if weights is None else weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [find(t, shared.value) for t in pdf.iloc[:, 1]]
            yield pd.DataFrame({id_col: pdf.iloc[:, 0], "text": [mask(t, s, secret) for t, s in zip(pdf.iloc[:, 1], spans, strict=True)], "n_spans": [len(s) for s in spans]})

    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, text string, n_spans int")
