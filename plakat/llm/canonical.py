"""Mapping free-entered names to a canonical list: token-level repair, then soft TF-IDF over whole entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plakat.llm.lookalike import UNUSUAL_JAVA, skeleton
from plakat.runtime import cut

#: Least score of an accepted entry; 'none' below it.
ACCEPT = 0.62
#: Least share of an entry's distinctive weight that must be found; of an entry without distinctive words, of its whole weight.
DISTINCTIVE, WHOLE = 0.7, 0.75
#: Characters of a token that take part in repair; longer tokens are matched by equality only.
TOKEN_CHARS = 40

_FOLD_FROM = "ąćęłńóśźżàáâãäåèéêëìíîïòôõöùúûüýÿñçčďěňřšťůžßøđ"
_FOLD_TO = "acelnoszzaaaaaaeeeeiiiioooouuuuyynccdenrstuzsod"
#: Patron clause of an entry: never needed in free text.
PATRON = r"\s+im(\.|ienia)\s.*$"
#: Street part of a free text.
STREET = r"[,(]?\s*(?U)\b(ul|ulica|al|aleja|pl|plac|os|osiedle|rynek)\b\.?\s+[^,()]*$"


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(c), _FOLD_FROM, _FOLD_TO)


def words(c: Column) -> Column:
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def stem(c: Column) -> Column:
    """Crude stem of an inflected Polish word without diacritics: case ending off, c and k alike at the end."""
    s = F.when(F.length(c) >= 4, F.regexp_replace(c, r"(owi|iej|ego|emu|ymi|ach|ami|ych|ich|im|ym|ej|ze|ie|em|[aeiouy])$", "")).otherwise(c)
    s = F.when(F.length(s) >= 3, s).otherwise(c)
    return F.regexp_replace(s, "c$", "k")


def _drops(c: Column) -> Column:
    """The string and each form with one character left out."""
    return F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))))


def repair_tokens(tokens: DataFrame, reference: DataFrame) -> DataFrame:
    """Join distinct tokens (tok) to reference tokens (rtok) by edit distance: (tok, rtok, sim).

    Both sides list themselves, their stem, and the forms of both with one character left out: equal forms propose every pair within one slip (a character
    missing, added, changed, or exchanged with its neighbour) and some within two; the smaller distance of words or stems decides. A token that is the
    beginning of a reference token (three letters or more) counts as its abbreviation. Tokens longer than ``TOKEN_CHARS`` meet their equals only.
    Equal tokens have 1.0, equal stems 0.97, abbreviations 0.9, one slip 1 - 0.6 / length of the stem, two 1 - 0.8 / length.
    """
    t = tokens.select("tok", stem(F.col("tok")).alias("ts")).where(F.length("tok") <= TOKEN_CHARS)
    r = reference.select("rtok", stem(F.col("rtok")).alias("rs")).where(F.length("rtok") <= TOKEN_CHARS)
    forms = lambda w, s: F.array_distinct(F.concat(_drops(F.col(w)), _drops(F.col(s))))
    by_edit = t.select("tok", "ts", F.explode(forms("tok", "ts")).alias("k")).where(F.length("k") >= 2)
    ref_edit = r.select("rtok", "rs", F.explode(forms("rtok", "rs")).alias("k")).where(F.length("k") >= 2)
    d = F.least(F.levenshtein("ts", "rs"), F.levenshtein("tok", "rtok"))
    longest = F.greatest(F.length("ts"), F.length("rs"))
    near = by_edit.join(ref_edit, "k").select("tok", "ts", "rtok", "rs").distinct()
    edit = near.where((F.col("ts") == F.col("rs")) | ((longest >= 3) & (d <= 2))).select(
        "tok", "rtok", F.when(F.col("tok") == F.col("rtok"), 1.0).when(F.col("ts") == F.col("rs"), 0.97).otherwise(1 - F.when(d <= 1, 0.6).otherwise(0.8) / longest).alias("sim")
    )
    begin = r.select("rtok", F.explode(F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length("rtok") - 1)), lambda i: F.substring(F.col("rtok"), F.lit(1), i))).alias("tok"))
    short = t.select("tok").where(F.length("tok").between(3, 6)).join(begin, "tok").select("tok", "rtok", F.lit(0.9).alias("sim"))
    long = tokens.select("tok").where(F.length("tok") > TOKEN_CHARS).join(reference.select(F.col("rtok").alias("tok"), "rtok"), "tok").select("tok", "rtok", F.lit(1.0).alias("sim"))
    return edit.unionByName(short).unionByName(long).groupBy("tok", "rtok").agg(F.max("sim").alias("sim"))


def tidy(names: DataFrame, col: str, out: str) -> DataFrame:
    """Add ``out``: the name in consistent characters (see ``lookalike``); only unusual names pass through Python."""
    plain = names.where(F.col(col).isNull() | ~F.col(col).rlike(UNUSUAL_JAVA)).withColumn(out, F.col(col))
    schema = ", ".join(f"`{c}` {t}" for c, t in names.dtypes) + f", `{out}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: [skeleton(v) for v in pdf[col]]})

    return plain.unionByName(names.where(F.col(col).rlike(UNUSUAL_JAVA)).mapInPandas(run, schema))


def map_names(asked: DataFrame, reference: DataFrame, context: DataFrame, popularity: DataFrame | None = None, accept: float = ACCEPT) -> DataFrame:
    """Map distinct (name, area) to reference entries (entry, entry_name, area, area_name): (name, area, entry, score).

    ``area`` limits the candidates if it isn't null; a null area is open. ``context`` holds
    tokens (tok) that accompany names without telling them apart (halls,
    towns): they don't count against a match. Score of an entry: soft TF-IDF, the
    mean of the share of the entry's weight found in the name and the share
    of the name's weight found in the entry. Weights are the rarity of a token among the entries
    of an area. The best entry wins; ties go to the more popular, then the smaller id.
    Names without an accepted entry have a null entry; so have null and blank names. Entries without an id or a name are left out.
    """
    named = tidy(asked.select("name", "area").distinct(), "name", "_t")
    named = cut(named.select("name", "area", F.array_distinct(words(F.regexp_replace(F.regexp_replace(F.col("_t"), STREET, " "), "(?i)" + PATRON, " "))).alias("toks")))
    toks = named.select("name", "area", F.explode("toks").alias("tok"))

    ref = reference.where("entry is not null and entry_name is not null").select("entry", "entry_name", F.col("area").alias("r_area"))
    ref_words = words(F.regexp_replace("entry_name", PATRON, ""))
    acronym = F.when(F.size(ref_words) >= 3, F.array_join(F.transform(ref_words, lambda w: F.substring(w, 1, 1)), ""))
    listed = ref.select("entry", "r_area", ref_words.alias("rw"), acronym.alias("ac"))
    r_tok = listed.select("entry", "r_area", F.explode(F.array_distinct("rw")).alias("rtok"))
    freq = r_tok.groupBy("rtok").agg(F.countDistinct("entry").alias("df"), F.greatest(F.countDistinct("r_area"), F.lit(1)).alias("areas"))
    # A token's rarity inside an area: tokens found once an area weigh most.
    freq = freq.select("rtok", (F.lit(1.0) + F.lit(3.0) / F.pow(F.col("df") / F.col("areas"), F.lit(1.2))).alias("w"), (F.col("df") <= F.col("areas") * 1.2).alias("distinct_one"))
    entries = r_tok.join(freq, "rtok").groupBy("entry", "r_area").agg(
        F.sort_array(F.collect_list(F.struct((~F.col("distinct_one")).alias("common"), (-F.col("w")).alias("low"), "rtok"))).alias("e"),
        F.sum("w").alias("r_total"), F.sum(F.when(F.col("distinct_one"), F.col("w")).otherwise(0.0)).alias("d_total"),
    )
    # An accepted name misses less than this weight of the entry, so it holds one at least of the first tokens (rarest first) that weigh more together.
    slack = F.when(F.col("d_total") > 0, F.col("d_total") * (1 - DISTINCTIVE)).otherwise(F.col("r_total") * (1 - WHOLE))
    before = lambda i: F.aggregate(F.slice("e", 1, i), F.lit(0.0), lambda a, x: a - x["low"])
    keys = F.filter(F.transform("e", lambda x, i: F.when(before(i) <= slack, x["rtok"])), lambda x: x.isNotNull())
    entries = cut(entries.select("entry", "r_area", "e", "r_total", "d_total", keys.alias("keys")))
    known = entries.select(F.inline("e")).select("rtok", (-F.col("low")).alias("w")).distinct()

    # One join for all reference tokens: of entries, of contexts and of towns.
    beside = context.select(F.col("tok").alias("rtok")).distinct()
    area_tok = reference.select(F.col("area").alias("a2"), F.explode(words(F.col("area_name"))).alias("rtok")).distinct()
    matches = cut(repair_tokens(toks.select("tok").distinct(), known.select("rtok").union(beside).union(area_tok.select("rtok")).distinct()))
    known_context = matches.where("sim >= 0.8").join(beside, "rtok", "left_semi").select("tok").distinct().withColumn("ctx", F.lit(True))
    weigh = matches.join(known, "rtok").groupBy("tok").agg(F.max(F.col("w") * F.col("sim")).alias("w_known"), F.collect_list(F.struct("rtok", "sim")).alias("hits"))
    own_w = F.when(F.length("tok") <= 2, 0.5).when(F.col("ctx"), 0.0).otherwise(F.greatest(F.coalesce("w_known", F.lit(0.0)), F.lit(2.5)))
    tok = toks.select("tok").distinct().join(known_context, "tok", "left").join(weigh, "tok", "left").select("tok", own_w.alias("n_w"), "hits")
    names = toks.join(tok, "tok").groupBy("name", "area").agg(F.sum("n_w").alias("n_total"), F.collect_list(F.struct("tok", "n_w", "hits")).alias("t"))
    hits = F.flatten(F.transform(F.filter("t", lambda x: x["hits"].isNotNull()), lambda x: F.transform(x["hits"], lambda h: F.struct(x["tok"].alias("tok"), h["rtok"].alias("rtok"), h["sim"].alias("sim"), x["n_w"].alias("n_w")))))
    names = cut(names.select("name", "area", "n_total", hits.alias("m")))

    near = lambda: F.col("area").isNull() | (F.col("area") == F.col("r_area"))
    asking = names.select("name", "area", F.explode(F.array_distinct(F.transform("m", lambda x: x["rtok"]))).alias("rtok"))
    cand = asking.join(entries.select("entry", "r_area", F.explode("keys").alias("rtok")), "rtok").where(near()).select("name", "area", "entry").distinct()
    per = cand.join(entries, "entry").join(names.withColumnsRenamed({"name": "n2", "area": "a2"}), (F.col("name") == F.col("n2")) & F.col("area").eqNullSafe(F.col("a2")))
    weights = F.map_from_entries(F.transform("e", lambda x: F.struct(x["rtok"], F.struct((-x["low"]).alias("w"), (~x["common"]).alias("distinct_one")))))
    per = per.select("name", "area", "entry", "r_total", "d_total", "n_total", weights.alias("ew"), "m")
    met = F.transform(F.filter("m", lambda x: F.map_contains_key("ew", x["rtok"])), lambda x: x.withField("w", F.element_at("ew", x["rtok"])["w"]).withField("distinct_one", F.element_at("ew", x["rtok"])["distinct_one"]))
    per = per.withColumn("m", met)

    def best(key: str, weight: str, only_distinct: bool = False) -> Column:
        """Sum over distinct tokens of the weight times the best similarity."""
        got = F.filter("m", lambda x: x["distinct_one"]) if only_distinct else F.col("m")
        keys = F.array_distinct(F.transform(got, lambda x: x[key]))
        top = F.transform(keys, lambda k: F.array_max(F.transform(F.filter(got, lambda x: x[key] == k), lambda x: x["sim"] * x[weight])))
        return F.aggregate(top, F.lit(0.0), lambda a, x: a + x)

    # A context token that the entry itself holds ("Scena" of "Scena Bursztyn") counts for the entry only.
    scored = per.select("name", "area", "entry", "r_total", "d_total", "n_total", best("rtok", "w").alias("r_hit"), best("rtok", "w", True).alias("d_hit"), best("tok", "n_w").alias("n_hit"))
    r_share, n_share = F.col("r_hit") / F.col("r_total"), F.when(F.col("n_total") > 0, F.col("n_hit") / F.col("n_total")).otherwise(0.0)
    enough = F.when(F.col("d_total") > 0, F.col("d_hit") / F.col("d_total") >= DISTINCTIVE).otherwise(r_share >= WHOLE)
    scored = scored.where(enough).select("name", "area", "entry", ((r_share + n_share) / 2).alias("score"))

    short = toks.join(listed.where(F.col("ac").isNotNull()).select("entry", "r_area", F.col("ac").alias("tok")), "tok").where(near())
    scored = scored.unionByName(short.select("name", "area", "entry", F.lit(0.95).alias("score"))).where(F.col("score") >= accept)
    # The town named in an open text decides among entries of equal names.
    told = toks.where(F.col("area").isNull()).join(matches.where("sim >= 0.8"), "tok").join(area_tok, "rtok")
    in_text = told.select(F.col("name").alias("n2"), "a2").distinct().withColumn("told", F.lit(0.2))
    scored = scored.join(listed.select("entry", "r_area"), "entry").join(in_text, (F.col("name") == F.col("n2")) & (F.col("a2") == F.col("r_area")) & F.col("area").isNull(), "left").select(
        "name", "area", "entry", "score", (F.col("score") + F.coalesce("told", F.lit(0.0))).alias("rank")
    )
    if popularity is not None:
        scored = scored.join(popularity.select("entry", "popular"), "entry", "left")
    else:
        scored = scored.withColumn("popular", F.lit(0))
    top = F.min_by(F.struct("entry", "score"), F.struct(-F.round("rank", 6), -F.coalesce("popular", F.lit(0)), "entry"))
    chosen = scored.groupBy("name", "area").agg(top.alias("t")).select(F.col("name").alias("n2"), F.col("area").alias("a2"), "t.entry", "t.score")
    return named.select("name", "area").join(chosen, F.col("name").eqNullSafe(F.col("n2")) & F.col("area").eqNullSafe(F.col("a2")), "left").select("name", "area", "entry", "score")
