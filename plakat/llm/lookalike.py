"""Text that looks alike but differs in its characters: script-aware repair to one consistent form."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plakat.llm.mojibake import Model, garbled_fields
from plakat.runtime import cut

# Letters of other scripts that print like Latin ones, in pairs "other Latin".
CYRILLIC_LIKE = "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ԛq ԝw ӏl ҽe АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԜW ԚQ ӀI"
GREEK_LIKE = "οo αa νv ρp ιi κk υu χx τt γy ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ"
# The same for further scripts and phonetic letters.
OTHER_LIKE = "օo ոn սu հh ցg ɑa ɡg ıi ɩi ꓲI ꓳO ꓮA ᴏo ᴠv ᴡw ᴢz ꜱs ᴜu ᴄc"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁦-⁯﻿￹-￻"
SPACES = "   -   　"
HYPHENS = "‐‑﹣－"
#: Compatibility forms that print like ordinary letters, digits or signs.
FORMS = "！-～ﬀ-ﬆǄ-ǌǱ-ǳĲĳⅠ-ⅿℂℊ-ℕℙ-ℝℤℨK-ℭℯ-ℴℹⅅ-ⅉ\U0001d400-\U0001d7ff﹐-﹫․ʹ-ʼ"

LIKE = {p[0]: p[1] for p in (CYRILLIC_LIKE + " " + GREEK_LIKE + " " + OTHER_LIKE).split() if p[0] != p[1]}
_BACK = {p[1]: p[0] for p in reversed(CYRILLIC_LIKE.split()) if p[0] != p[1]}
_EMOJI_RUN = re.compile("(?:[\U0001f1e6-\U0001faff☀-➿⌀-⏿⬀-⯿©®#*0-9](?:[︎️]|⃣|[\U0001f3fb-\U0001f3ff])*‍?)+")
_INVISIBLE, _SPACES, _HYPHENS, _FORMS = (re.compile(f"[{x}]") for x in (INVISIBLE, SPACES, HYPHENS, FORMS))
_SELECTOR = re.compile("[︀-️]")
_TOKEN = re.compile(r"[^\W\d_]+")
#: Cheap JVM test: anything outside printable ASCII, Polish letters and common signs.
UNUSUAL_JAVA = "[^\\x20-\\x7EąćęłńóśźżĄĆĘŁŃÓŚŹŻ–—„”“’…•²№]"


@lru_cache(maxsize=20_000)
def script(c: str) -> str:
    """Latin, Cyrillic, Greek or Other, by the character's name."""
    name = unicodedata.name(c, "")
    return next((s for s in ("LATIN", "CYRILLIC", "GREEK") if name.startswith(s)), "OTHER")


def _shield(text: str) -> tuple[str, list[str]]:
    """Take emoji sequences out so that their joiners and selectors don't count."""
    kept: list[str] = []

    def put(m: re.Match) -> str:
        run = m[0]
        if run.isascii() or not any(c in run for c in "‍️︎⃣"):
            return run
        tail = "‍" if run.endswith("‍") else ""
        kept.append(run[: len(run) - len(tail)])
        return "" + tail

    return _EMOJI_RUN.sub(put, text), kept


def _to_latin(token: str) -> str | None:
    """The token in Latin letters if every other letter has a Latin look-alike."""
    out = [LIKE.get(c, c) for c in token]
    return "".join(out) if all(script(c) == "LATIN" for c in out) else None


def _to_cyrillic(token: str) -> str | None:
    out = [_BACK.get(c, c) if script(c) == "LATIN" else c for c in token]
    return "".join(out) if all(script(c) == "CYRILLIC" for c in out) else None


def fold_token(token: str) -> str | None:
    """Mixed-script token in its dominant script; null if it isn't mixed or a letter has no look-alike there."""
    scripts = [script(c) for c in token]
    if len(set(scripts)) < 2:
        return None
    latin, cyrillic = _to_latin(token), _to_cyrillic(token)
    if latin and cyrillic:
        return latin if scripts.count("LATIN") >= scripts.count("CYRILLIC") else cyrillic
    return latin or cyrillic


def examine(text: str) -> tuple[list[str], str, dict[str, str], dict[str, str]]:
    """(kinds of trouble, text with the certain repairs, mixed-script tokens, lone tokens of another script), tokens with their form in the dominant script.

    Certain: invisible characters, unusual spaces and hyphens, compatibility
    forms and loose accents. Mixed-script tokens all of whose minority letters have look-alikes are trouble in
    themselves; whether they are replaced, the vocabulary decides. A lone token is written wholly in another script than its neighbours, or is the only one, in letters that all
    have Latin look-alikes.
    """
    kinds = []
    body, emoji = _shield(text)
    for name, pattern, put in (("space", _SPACES, " "), ("invisible", _INVISIBLE, ""), ("hyphen", _HYPHENS, "-")):
        if pattern.search(body):
            kinds.append(name)
            body = pattern.sub(put, body)
    body = _SELECTOR.sub("", body) if _SELECTOR.search(body) else body
    if _FORMS.search(body):
        kinds.append("form")
        body = _FORMS.sub(lambda m: unicodedata.normalize("NFKC", m[0]), body)
    composed = unicodedata.normalize("NFC", body)
    if composed != body or any(unicodedata.category(c) == "Mn" for c in composed):
        kinds.append("accent")
        body = composed
    mixed: dict[str, str] = {}
    lone: dict[str, str] = {}
    if not body.isascii():
        tokens = _TOKEN.findall(body)
        mixed = {t: f for t in tokens if not t.isascii() and (f := fold_token(t))}
        if mixed:
            kinds.append("script")
        tokens = [mixed.get(t, t) for t in tokens]
        kind = [script(t[0]) for t in tokens]
        for i, t in enumerate(tokens):
            if kind[i] in ("CYRILLIC", "GREEK", "OTHER") and (latin := _to_latin(t)) and (len(kind) == 1 or any(0 <= j < len(kind) and kind[j] != kind[i] for j in (i - 1, i + 1))):
                lone[t] = latin
        # A mixed token whose minority is Latin may still mean a Latin word: then that is the form the vocabulary is asked for.
        mixed = {t: lone.get(f, f) for t, f in mixed.items()}
        there = set(_TOKEN.findall(body))
        lone = {t: f for t, f in lone.items() if t in there}
    for e in emoji:
        body = body.replace("\ue000", e, 1)
    return kinds, body, mixed, lone


def replaced(body: str, forms: dict[str, str]) -> str:
    """The text with whole tokens exchanged."""
    return _TOKEN.sub(lambda m: forms.get(m[0], m[0]), body) if forms else body


def skeleton(text: str) -> str:
    """The key form of a text: all repairs, whether the vocabulary knows the result or not. Equal-looking texts have equal skeletons."""
    _, body, mixed, lone = examine(text)
    return replaced(replaced(body, mixed), lone)


def vocabulary(fields: DataFrame) -> DataFrame:
    """Distinct lower-case words of one script (word), over all rows."""
    return fields.select(F.explode(F.split(F.lower("value"), r"[^\p{L}\p{M}]+")).alias("word")).where(F.col("word").rlike(r"^(\p{IsLatin}+|\p{IsCyrillic}+|\p{IsGreek}+)$")).distinct()


def lookalike_fields(fields: DataFrame, garbled: DataFrame | None = None) -> DataFrame:
    """Values of (tbl, row_key, field, value) made of other characters than they print like: (tbl, row_key, field, kinds, canonical, skeleton).

    Each token has a dominant script; a mixed-script token whose minority letters have look-alikes in it is a case. In ``canonical`` it is
    replaced if the result is a word of the corpus (``vocabulary``: a word of one script in any row, or a result that two values agree on); else it stays as it is and only
    ``skeleton``, the form in which equal-looking values are equal, has it replaced. A token wholly in
    another script mixes scripts only with its neighbours: it is a case, and replaced, if its Latin form is a corpus word. Text rightly in another script, emoji sequences and signs that print
    differently stay. Values listed in ``garbled`` (tbl, row_key, field) are left out.
    Null, empty and plain values are never returned; repeated rows are returned as often as they occur.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = [examine(v) for v in pdf["value"]]
            out = pdf[["tbl", "row_key", "field"]].assign(
                kinds=[",".join(k) for k, *_ in seen], canonical=[b for _, b, _, _ in seen], skeleton=[replaced(replaced(b, m), o) for _, b, m, o in seen],
                tokens=[[*m, *o] for *_, m, o in seen], forms=[[*m.values(), *o.values()] for *_, m, o in seen], lone=[[False] * len(m) + [True] * len(o) for *_, m, o in seen],
            )
            yield out[[bool(k or o) for k, _, _, o in seen]]

    rows = fields.where(F.col("value").rlike(UNUSUAL_JAVA)).mapInPandas(run, "tbl string, row_key string, field string, kinds string, canonical string, skeleton string, tokens array<string>, forms array<string>, lone array<boolean>")
    if garbled is not None:
        rows = rows.join(garbled.select("tbl", "row_key", "field"), ["tbl", "row_key", "field"], "left_anti")
    rows = cut(rows.withColumn("_n", F.monotonically_increasing_id()))
    asked = rows.where(F.size("tokens") > 0).select("_n", F.inline(F.arrays_zip("tokens", "forms", "lone"))).withColumn("word", F.lower("forms"))
    agreed = asked.where("not lone").groupBy("word").agg(F.countDistinct("_n").alias("n")).where("n > 1").select("word")
    known = asked.join(vocabulary(fields).union(agreed), "word", "left_semi").groupBy("_n").agg(F.collect_set(F.struct("tokens", "forms")).alias("known"), F.max("lone").alias("word"))
    both = rows.join(known, "_n", "left").where((F.col("kinds") != "") | F.col("word"))
    swap = F.aggregate(F.coalesce("known", F.array().cast("array<struct<tokens:string,forms:string>>")), F.col("canonical"), lambda a, k: F.regexp_replace(a, F.concat(F.lit(r"(?<!\p{L})"), k["tokens"], F.lit(r"(?!\p{L})")), k["forms"]))
    kinds = F.concat_ws(",", F.nullif("kinds", F.lit("")), F.when(F.col("word"), F.lit("word")))
    return both.select("tbl", "row_key", "field", kinds.alias("kinds"), swap.alias("canonical"), "skeleton")
