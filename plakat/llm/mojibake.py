"""Garbled text: predict the chain of wrong decodings from byte bigrams, undo it, verify strictly."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plakat.llm.sampling import hashed_sample
from plakat.runtime import cut

#: Rows of text the classifier is fitted on (those with the smallest hash) and their distinct tokens; everything else, known words too, covers all data.
TRAIN_ROWS, TRAIN_TOKENS = 12_000, 60_000
#: Hash buckets of byte bigrams.
BUCKETS = 1 << 14
#: Log odds by which a UTF-8 chain may trail the clean class and still be tried: strict decoding then decides.
UTF8_MARGIN = 12.0
#: Longest token learnt or scored as one piece; longer ones count with all their pieces of this length.
TOKEN_CHARS = 120
#: Share of a garbled field's doubtful tokens that come from its chain; the others are clean foreign words.
FROM_CHAIN = 0.7

# Letters and signs of ordinary Polish text.
POLISH = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"
ORDINARY_SIGNS = "–—„”“’‘…•«»°§№²³½×€→"
#: Encodings that text in UTF-8 is wrongly read in.
WRONG = ["cp1252", "latin-1", "cp1250", "iso8859-2", "cp852", "cp1251", "mac_roman", "cp437", "cp850", "iso8859-15", "cp1257", "mac_latin2", "koi8-r"]
TWICE = ["cp1252", "latin-1", "cp1250", "iso8859-2"]
#: One-byte encodings read as another: (written, read).
CROSS = [
    ("cp1250", "cp1252"), ("cp1250", "latin-1"), ("cp1250", "iso8859-2"), ("cp1250", "cp852"), ("iso8859-2", "cp1252"), ("iso8859-2", "latin-1"), ("iso8859-2", "cp1250"),
    ("cp852", "cp1250"), ("cp852", "cp1252"), ("cp852", "latin-1"), ("cp852", "iso8859-2"), ("mac_latin2", "cp1250"), ("mac_latin2", "cp1252"),
]


def _tables(encoding: str) -> tuple[dict[int, int], dict[str, int]]:
    """Decoding and encoding tables of a one-byte encoding; undefined bytes stand for the control code of the same number."""
    forth = {}
    for b in range(256):
        try:
            forth[b] = ord(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            forth[b] = b
    back: dict[str, int] = {}
    for b, c in forth.items():
        back.setdefault(chr(c), b)
    for b in range(128, 160):
        back.setdefault(chr(b), b)
    return forth, back


_CODES = {e: _tables(e) for e in {*WRONG, *TWICE, *(x for p in CROSS for x in p)}}
#: Chains by name: steps of (written in, read in).
CHAINS: dict[str, list[tuple[str, str]]] = {
    **{f"utf-8>{w}": [("utf-8", w)] for w in WRONG},
    **{f"utf-8>{w}>utf-8>{w}": [("utf-8", w), ("utf-8", w)] for w in TWICE},
    **{f"{a}>{b}": [(a, b)] for a, b in CROSS},
}


#: Chains that can't be undone: letters replaced by a question mark, by one replacement mark, or by one a byte.
LOST = {"lost>?": "?", "lost>mark": "\ufffd", "lost>marks": "\ufffd\ufffd"}


def _write(text: str, encoding: str) -> bytes | None:
    if encoding == "utf-8":
        try:
            return text.encode("utf-8")
        except UnicodeEncodeError:
            return None
    back = _CODES[encoding][1]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


def _read(raw: bytes, encoding: str) -> str | None:
    if encoding == "utf-8":
        try:
            return raw.decode("utf-8", "strict")
        except UnicodeDecodeError:
            return None
    forth = _CODES[encoding][0]
    return "".join(chr(forth[b]) for b in raw)


def garble(text: str, chain: str) -> str | None:
    """Apply a chain; null if the text can't be written in its encoding."""
    if chain in LOST:
        return "".join(c if c.isascii() else LOST[chain] for c in text)
    for written, read in CHAINS[chain]:
        raw = _write(text, written)
        if raw is None:
            return None
        text = _read(raw, read)
    return text


def undo(text: str, chain: str) -> str | None:
    """Invert a chain strictly; null if any step doesn't decode, and for lost letters."""
    if chain in LOST:
        return None
    for written, read in reversed(CHAINS[chain]):
        raw = _write(text, read)
        text = None if raw is None else _read(raw, written)
        if text is None:
            return None
    return text


# The tests of plain characters ---------------------------------------------------------------------

_SAFE = f"\t\n\r -~{POLISH}–—„”“’‘…•"
#: Java class of characters outside ordinary Polish text.
UNSAFE_JAVA = "[^\\t\\n\\r\\x20-\\x7E" + POLISH + "–—„”“’‘…•]"
#: JSON escapes of characters outside ordinary Polish text.
_PLAIN_ESCAPES = "|".join(f"{ord(c):04x}" for c in POLISH + "–—„”“’‘…•")
UNSAFE_ESCAPE_JAVA = rf"(?i)\\u(?!{_PLAIN_ESCAPES})"
LOST_JAVA = r"(?U)[\p{L}?]\?\p{L}|(^|[\s„(\"])\?+\p{L}|\p{L}\?\s+\p{L}"
_UNSAFE = re.compile("[^\\t\\n\\r\\x20-\\x7E" + POLISH + "–—„”“’‘…•]")
_LOST = re.compile(r"[^\W\d_]\?+[^\W\d_]|(?:^|[\s„(\"])\?+[^\W\d_]")
_LOST_END = re.compile(r"([^\W\d_]+)\? +(?=[^\W\d_])")
_LINK = re.compile(r"(?i)\S*(?:://|www\.)\S*")
_WORD = re.compile(r"[^\W\d_]+")
_EMOJI = re.compile("[\U0001f000-\U0001faff☀-➿⌀-⏿⬀-⯿️‍\U000e0020-\U000e007f]")


def suspicious(c: Column) -> Column:
    """Cheap JVM test; rows it rejects hold nothing that could be garbled."""
    return F.coalesce(c.rlike(UNSAFE_JAVA) | (c.contains("?") & c.rlike(LOST_JAVA)), F.lit(False))


def suspicious_json(c: Column) -> Column:
    return F.coalesce(c.rlike(UNSAFE_JAVA) | (c.contains("\\u") & c.rlike(UNSAFE_ESCAPE_JAVA)) | (c.contains("?") & c.rlike(r"(?U)[\p{L}?]\?+\p{L}|[\s\"„(]\?+[\p{L}\\]|\p{L}\?\s+[\p{L}\\]|[0-9a-f]\?+\\u|[0-9a-f]\?+\p{L}")), F.lit(False))


def _pieces(token: str) -> list[str]:
    return [token[i : i + TOKEN_CHARS] for i in range(0, len(token), TOKEN_CHARS)]


def _bigrams(token: str) -> np.ndarray:
    b = np.frombuffer(b"\x02" + token.encode("utf-8", "surrogatepass") + b"\x03", np.uint8).astype(np.int64)
    return ((b[:-1] * 40503 + b[1:] * 2654435761) >> 4) % BUCKETS


@dataclass
class Model:
    """Multinomial naive Bayes over hashed byte bigrams; class 0 is clean text, the others are chains."""

    names: list[str]
    log_p: np.ndarray
    #: Known words with Polish letters, and those with one letter left out.
    words: frozenset[str] = field(default_factory=frozenset)
    nearly: frozenset[str] = field(default_factory=frozenset)
    #: Words of the clean class that hold other letters (foreign words, names).
    foreign: frozenset[str] = field(default_factory=frozenset)

    def scores(self, tokens: list[str]) -> np.ndarray:
        grams = [_bigrams(t) for t in tokens]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        flat = np.concatenate(grams) if grams else np.empty(0, np.int64)
        return np.add.reduceat(self.log_p[flat], np.cumsum(sizes) - sizes, axis=0) if len(grams) else np.zeros((0, len(self.names)))


def _obviously_broken(token: str) -> bool:
    """Control codes, replacement marks, or strictly decodable as UTF-8 read wrongly: no model for clean text."""
    if any(unicodedata.category(c) in ("Cc", "Co") for c in token) or "�" in token:
        return True
    return any((u := undo(token, c)) is not None and u != token for c in CHAINS if c.startswith("utf-8>"))


def _doubtful(token: str) -> bool:
    """Does the token hold characters that decide about garbling: other letters or signs (emoji aside), marks, control codes, or question marks inside a word?"""
    if "?" in token and _LOST.search(token) and not _LINK.search(token):
        return True
    return bool(_UNSAFE.search(token)) and (not _EMOJI.sub("", token).isascii() or any(unicodedata.category(c) == "Cc" for c in token))


def train(texts: Iterable[str | None], smooth: float = 0.02) -> Model:
    """Fit on texts: see ``train_tokens``."""
    seen: Counter[str] = Counter()
    for t in texts:
        for tok in (t or "").split(" "):
            if tok and not tok.isascii():
                seen.update(_pieces(tok))
    return train_tokens(seen, smooth)


def train_tokens(seen: dict[str, int], smooth: float = 0.02) -> Model:
    """Fit on counted tokens: words of ordinary letters are garbled by every chain; words that can't be undone to anything are the clean class."""
    plain = {t: n for t, n in seen.items() if not _UNSAFE.search(t)}
    other = {t: n for t, n in seen.items() if t not in plain}
    names = ["clean", *CHAINS, *LOST]
    counts = np.full((BUCKETS, len(names)), 0.0)

    def learn(token: str, n: float, k: int) -> None:
        np.add.at(counts[:, k], _bigrams(token), n)

    known: Counter[str] = Counter()
    for tok, n in plain.items():
        w = float(n) ** 0.75
        learn(tok, w, 0)
        for k, chain in enumerate(names[1:], 1):
            g = garble(tok, chain)
            if g is not None and g != tok:
                learn(g, w, k)
        for x in _WORD.findall(tok):
            known[x.lower()] += n

    def twin(tok: str, n: int) -> bool:
        """Does a one-byte chain undo the token to words that are more frequent than it? Then the sample holds garbled text."""
        return any(all(known[w.lower()] > n for w in _WORD.findall(f) if not w.isascii()) for f in _undone(tok))

    clean = {tok: n for tok, n in other.items() if n >= 2 and not _obviously_broken(tok) and not twin(tok, n)}
    for tok, n in clean.items():
        w = float(n) ** 0.75
        learn(tok, w, 0)
        for k, chain in enumerate(names[1:], 1):
            if chain.startswith("utf-8>"):
                g = garble(tok, chain)
                if g is not None and g != tok:
                    learn(g, w, k)
    counts += smooth
    words = frozenset(w.lower() for tok in plain for w in _WORD.findall(tok) if len(w) > 1)
    nearly = frozenset(d for w in words if len(w) > 4 for d in _shorter(w))
    foreign = frozenset(w.lower() for tok in clean for w in _WORD.findall(tok))
    return Model(names, np.log(counts / counts.sum(axis=0)).astype(np.float32), words, nearly, foreign)


def _shorter(word: str) -> list[str]:
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


def _plausible(token: str, fixed: str, chain: str, model: Model) -> bool:
    """Is the undone text better?

    UTF-8 chains prove themselves by strict decoding. One-byte chains always
    decode: there the result must have ordinary letters only, and either
    a word known in clean text (up to one slip) or a sign inside a word before.
    """
    if fixed == token or any(unicodedata.category(c) in ("Cc", "Co", "Cn") and c not in "\t\n\r" for c in fixed):
        return False
    if chain.startswith("utf-8>"):
        # Look-alike letters and invisible characters can decode by chance. Restored text has no word that mixes alphabets, and marks or invisible characters only around emoji.
        if any(unicodedata.category(c) in ("Mn", "Me", "Cf") for c in fixed) and not any(c >= "\u2600" and unicodedata.category(c) == "So" for c in fixed):
            return False
        if any("\u0530" <= c <= "\u1fff" for c in fixed):
            return False
        return not any(len({c <= "\u024f" for c in w}) > 1 for w in _WORD.findall(fixed))
    if _UNSAFE.search(fixed):
        return False
    bad = [i for i, c in enumerate(token) if _UNSAFE.match(c)]
    if not bad or any(fixed[i] not in POLISH for i in bad):
        return False
    before = [w.lower() for w in _WORD.findall(token)]
    if before and all(w in model.foreign or w.isascii() for w in before) and all(token[i].isalpha() for i in bad):
        return False
    after = [w.lower() for w in _WORD.findall(fixed) if not w.isascii()]
    if any(w in model.words or w in model.nearly or any(d in model.words for d in _shorter(w)) for w in after):
        return True
    inside = [i for i in bad if (i and token[i - 1].isalpha()) or (i + 1 < len(token) and token[i + 1].isalpha())]
    return any(not token[i].isalpha() and (token[i] not in "²³°½№×" or i + 1 < len(token) and token[i + 1].isalpha()) for i in inside)


@dataclass
class Verdict:
    """One text's chain (None: clean) and the originals of its garbled tokens."""

    chain: str | None = None
    originals: dict[str, str] = field(default_factory=dict)


CLEAN = Verdict()


def predict(strings: list[str], model: Model) -> list[Verdict]:
    """The chain of each text (a field, or one string of a JSON document): predicted once a text, then inverted and verified.

    A text's doubtful tokens (see ``_doubtful``) come either from the clean class or, with ``FROM_CHAIN``, from the text's one chain; a token that a chain's inverse
    can't decode strictly has no likelihood under it. The chain of the highest likelihood is the prediction. UTF-8 chains may trail
    the clean class by ``UTF8_MARGIN``, as strict decoding decides. Some token that the prediction undoes must read better (``_plausible``),
    else the text is clean, or "unknown" if it holds control codes. Replacement marks always are "lost".
    """
    tokens = [sorted({t for t in s.split(" ") if _doubtful(t)}) if not s.isascii() or "?" in s else [] for s in strings]
    distinct = sorted({t for ts in tokens for t in ts})
    if not distinct:
        return [CLEAN] * len(strings)
    at = {t: i for i, t in enumerate(distinct)}
    pieces = [(i, p) for i, t in enumerate(distinct) for p in _pieces(t)]
    total = np.zeros((len(distinct), len(model.names)))
    np.add.at(total, [i for i, _ in pieces], model.scores([p for _, p in pieces]))
    mixed = np.logaddexp(np.log(1 - FROM_CHAIN) + total[:, :1], np.log(FROM_CHAIN) + total)
    without = np.log(1 - FROM_CHAIN) + total[:, 0]
    undone: dict[tuple[int, int], str | None] = {}

    def inverse(i: int, k: int) -> str | None:
        if (i, k) not in undone:
            undone[i, k] = undo(distinct[i], model.names[k])
        return undone[i, k]

    out = []
    for ts in tokens:
        if not ts:
            out.append(CLEAN)
            continue
        rows = [at[t] for t in ts]
        score = mixed[rows].sum(axis=0)
        score[0] = -np.inf
        marks = {"lost>?": any("?" in t and _LOST.search(t) for t in ts), "lost>mark": any("\ufffd" in t for t in ts), "lost>marks": any("\ufffd\ufffd" in t for t in ts)}
        for chain, there in marks.items():
            if not there:
                score[model.names.index(chain)] = -np.inf
        settled: set[int] = set()
        while (k := int(np.argmax(score))) not in settled and model.names[k] not in LOST:
            # Tokens that this chain can't have made lose their likelihood under it.
            score[k] = sum(mixed[i, k] if inverse(i, k) is not None else without[i] for i in rows)
            settled.add(k)
        name, lead = model.names[k], float(score[k] - total[rows, 0].sum())
        control = any("\x80" <= c <= "\x9f" for t in ts for c in t)
        originals = {}
        if name not in LOST and (control or lead > (-UTF8_MARGIN if name.startswith("utf-8>") else 0.0)):
            originals = {t: f for t, i in zip(ts, rows, strict=True) if (f := inverse(i, k)) is not None and _plausible(t, f, name, model)}
        if originals:
            # The chain is proven: what else is likelier under it than clean, and becomes ordinary text, was made by it too.
            originals |= {t: f for t, i in zip(ts, rows, strict=True) if total[i, k] > total[i, 0] and (f := inverse(i, k)) is not None and f != t and not _UNSAFE.search(f)}
            out.append(Verdict(name, originals))
        elif name in LOST or any("\ufffd" in t for t in ts):
            out.append(Verdict("lost"))
        else:
            out.append(Verdict("unknown") if control else CLEAN)
    return out


def _strings(value: object) -> Iterator[str]:
    if isinstance(value, dict):
        for v in value.values():
            yield from _strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from _strings(v)
    elif isinstance(value, str):
        yield value


def lost_letters(text: str, model: Model) -> bool:
    """Question marks where letters were: inside or before a word, or after one that a Polish letter completes to a known word; links left out."""
    if "?" not in text:
        return False
    text = _LINK.sub(" ", text)
    if _LOST.search(text):
        return True
    return any(w.lower() + c in model.words for w in _LOST_END.findall(text) for c in "ąćęłńóśźż")


def repair(text: str, verdict: Verdict) -> str:
    """Put the originals in place of garbled tokens; tokens without an original stay."""
    return " ".join(verdict.originals.get(t, t) for t in text.split(" ")) if verdict.originals else text


def _parts(value: str, js: bool) -> list[str]:
    if js:
        try:
            return list(_strings(json.loads(value)))
        except (ValueError, RecursionError):
            pass
    return [value]


def _undone(token: str) -> list[str]:
    """What the one-byte chains undo a token to, if it is ordinary text."""
    return [f for a, b in CROSS if (f := undo(token, f"{a}>{b}")) is not None and f != token and not _UNSAFE.search(f)]


def _counts(fields: DataFrame) -> DataFrame:
    """(other, text, n): words of ordinary tokens with Polish letters, in lower case, and tokens with other characters, over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter[tuple[bool, str]] = Counter()
            for v, js in zip(pdf["value"], pdf["is_json"], strict=True):
                for tok in {} if v is None else (t for p in _parts(v, js) if not p.isascii() for t in p.split(" ") if not t.isascii()):
                    if _UNSAFE.search(tok):
                        n.update((True, piece) for piece in _pieces(tok))
                    else:
                        n.update((False, w.lower()) for w in _WORD.findall(tok) if len(w) > 1)
            yield pd.DataFrame([(*k, c) for k, c in n.items()], columns=["other", "text", "n"])

    rows = fields.where(F.col("value").rlike(r"[^\x00-\x7F]") | F.col("is_json") & F.col("value").contains("\\u")).select("value", "is_json")
    return cut(rows.mapInPandas(run, "other boolean, text string, n bigint").groupBy("other", "text").agg(F.sum("n").alias("n")))


def _foreign(counts: DataFrame, known: DataFrame) -> DataFrame:
    """Words (x) of tokens with other letters that occur twice, aren't broken, and that no chain undoes to more frequent words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tok, n in zip(pdf["text"], pdf["n"], strict=True):
                if _obviously_broken(tok):
                    continue
                back = [[w.lower() for w in _WORD.findall(f) if not w.isascii()] for f in _undone(tok)]
                if all(back):
                    words = [w.lower() for w in _WORD.findall(tok)]
                    out += [(tok, n, i, w, words) for i, ws in enumerate(back) for w in ws] or [(tok, n, -1, None, words)]
            yield pd.DataFrame(out, columns=["tok", "n", "chain", "x", "words"])

    tried = counts.where("other and n > 1").select("text", "n").mapInPandas(run, "tok string, n bigint, chain int, x string, words array<string>")
    tried = tried.join(known.select("x", F.col("n").alias("k")), "x", "left")
    chains = tried.groupBy("tok", "chain").agg(F.min(F.coalesce(F.col("k") > F.col("n"), F.lit(False))).alias("twin"), F.first("words").alias("words"))
    return chains.groupBy("tok").agg(F.max("twin").alias("twin"), F.first("words").alias("words")).where("not twin").select(F.explode("words").alias("x")).distinct()


def _lexicon(fields: DataFrame, rows: DataFrame) -> DataFrame:
    """What all rows tell about the words that ``rows`` ask for: (_k, facts), facts of (kind, x) with kinds word, near and foreign."""
    counts = _counts(fields)
    known = counts.where("not other").select(F.col("text").alias("x"), "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = set()
            for k, v, js in zip(pdf["_k"], pdf["value"], pdf["is_json"], strict=True):
                for p in _parts(v, js):
                    if "?" in p:
                        out |= {(k, "word", w.lower() + c) for w in _LOST_END.findall(_LINK.sub(" ", p)) for c in "ąćęłńóśźż"}
                    for tok in p.split(" "):
                        if tok.isascii() or not _UNSAFE.search(tok):
                            continue
                        out |= {(k, "foreign", w.lower()) for w in _WORD.findall(tok) if not w.isascii()}
                        for w in {w.lower() for f in _undone(tok) for w in _WORD.findall(f) if not w.isascii()}:
                            out |= {(k, "near", w)} | {(k, "word", x) for x in (w, *_shorter(w))}
            yield pd.DataFrame(list(out), columns=["_k", "kind", "x"])

    asked = rows.select("_k", "value", "is_json").mapInPandas(run, "_k bigint, kind string, x string")
    near = known.where(F.length("x") > 4).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("x")), lambda i: F.concat(F.substring(F.col("x"), F.lit(1), i - 1), F.substring(F.col("x"), i + 1, F.length("x"))))).alias("x")).distinct()
    facts = known.select(F.lit("word").alias("kind"), "x").unionByName(near.select(F.lit("near").alias("kind"), "x")).unionByName(_foreign(counts, known).select(F.lit("foreign").alias("kind"), "x"))
    return asked.join(facts, ["kind", "x"]).groupBy("_k").agg(F.collect_set(F.concat_ws(":", "kind", "x")).alias("facts"))


def garbled_fields(fields: DataFrame, model: Model) -> DataFrame:
    """Find garbled fields among (tbl, row_key, field, value, is_json): returns (tbl, row_key, field, chain, restored).

    A field is found if it, or a string inside its JSON, is predicted to come from a
    chain of wrong decodings whose inverse decodes strictly and reads better (``predict``), or holds
    replacement marks or question marks in place of letters ("lost"). ``chain`` names
    the predictions of its strings; ``restored`` is the value with every recoverable part put right
    (null if nothing is recoverable; for JSON the document is written anew).
    Null and empty values are never found. Text that isn't valid JSON is treated as plain text. Repeated rows give one.
    """
    rows = fields.where(F.when(F.col("is_json"), suspicious_json(F.col("value"))).otherwise(suspicious(F.col("value"))))
    rows = cut(rows.withColumn("_k", F.xxhash64("tbl", "row_key", "field")))
    rows = rows.join(_lexicon(fields, rows), "_k", "left")
    shared = fields.sparkSession.sparkContext.broadcast(model)  # BUCKETS x chains numbers and the words of TRAIN_ROWS rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = shared.value
        for pdf in batches:
            known: dict[str, set[str]] = {"word": set(), "near": set(), "foreign": set()}
            for facts in pdf["facts"]:
                for f in facts if facts is not None else ():
                    kind, _, x = f.partition(":")
                    known[kind].add(x)
            m = replace(base, words=base.words | known["word"], nearly=base.nearly | known["near"], foreign=base.foreign | known["foreign"])
            parsed: list[tuple[object, list[str]]] = []
            for v, js in zip(pdf["value"], pdf["is_json"], strict=True):
                if js:
                    try:
                        o = json.loads(v)
                        parsed.append((o, list(_strings(o))))
                        continue
                    except (ValueError, RecursionError):
                        pass
                parsed.append((None, [v]))
            each = iter(predict([x for _, strings in parsed for x in strings], m))
            keep, chains, restored = [], [], []
            for i, (o, strings) in enumerate(parsed):
                verdicts = [next(each) for _ in strings]
                found = {v.chain or ("lost" if lost_letters(x, m) else None) for x, v in zip(strings, verdicts, strict=True)} - {None}
                keep.append(bool(found))
                chains.append(",".join(sorted(found)))
                if not any(v.originals for v in verdicts):
                    restored.append(None)
                elif o is None:
                    restored.append(repair(pdf["value"].iloc[i], verdicts[0]))
                else:
                    restored.append(json.dumps(_mapped(o, iter(verdicts)), ensure_ascii=False))
            out = pdf[["tbl", "row_key", "field"]].assign(chain=chains, restored=restored)
            yield out[np.array(keep, bool)]

    return rows.mapInPandas(run, "tbl string, row_key string, field string, chain string, restored string").distinct()


def _mapped(value: object, verdicts: Iterator[Verdict]) -> object:
    """The document with its strings repaired; verdicts come in the order of ``_strings``."""
    if isinstance(value, dict):
        return {k: _mapped(v, verdicts) for k, v in value.items()}
    if isinstance(value, list):
        return [_mapped(v, verdicts) for v in value]
    return repair(value, next(verdicts)) if isinstance(value, str) else value


def fit(fields: DataFrame, rows: int = TRAIN_ROWS, tokens: int = TRAIN_TOKENS) -> Model:
    """Train on at most ``tokens`` tokens (each at most ``TOKEN_CHARS`` long) of at most ``rows`` rows of (tbl, row_key, field, value, is_json), those with the smallest hashes; JSON values count with their strings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter[str] = Counter()
            for v, js in zip(pdf["value"], pdf["is_json"], strict=True):
                n.update(piece for p in ([] if v is None else _parts(v, js)) if not p.isascii() for t in p.split(" ") if not t.isascii() for piece in _pieces(t))
            yield pd.DataFrame(list(n.items()), columns=["tok", "n"])

    sample = hashed_sample(fields.select("tbl", "row_key", "field", "value", "is_json"), ["tbl", "row_key", "field"], rows).select("value", "is_json")
    found = sample.mapInPandas(run, "tok string, n bigint").groupBy("tok").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("tok"), "tok").limit(tokens).collect()
    return train_tokens({r["tok"]: r["n"] for r in found})
