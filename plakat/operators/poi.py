"""Classification of points of interest by ordered rule tables. Tables are data; one builder turns them into CASE expressions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plakat.functions.nested import tag
from plakat.operators.rules import first_match


@dataclass(frozen=True)
class Rule:
    """One row of a table: what it asks, any of it being enough, and what it says.

    ``holds``: column -> texts of which the column's lower-case value must hold one. ``equals``: column -> values. ``present``: columns that must be set.
    """

    says: dict[str, object]
    holds: dict[str, list[str]] = field(default_factory=dict)
    equals: dict[str, list[str]] = field(default_factory=dict)
    present: list[str] = field(default_factory=list)

    def test(self, get) -> Column:
        out = F.lit(False)
        for name, words in self.holds.items():
            for w in words:
                out = out | get(name).contains(w)
        for name, values in self.equals.items():
            out = out | get(name).isin(values)
        for name in self.present:
            out = out | (get(name) != "")
        return out


def classify(get, rules: Iterable[Rule], default: dict[str, object]) -> Column:
    """Struct of the default's fields; each is set by the first rule that matches, or stays at the default where that rule says nothing of it."""
    rules = list(rules)

    def value(v: object) -> Column:
        return v if isinstance(v, Column) else F.array(*map(F.lit, v)) if isinstance(v, list) and v else F.array().cast("array<string>") if isinstance(v, list) else F.lit(v)

    return F.struct(*[first_match([(r.test(get), value(r.says.get(name, fallback))) for r in rules], value(fallback)).alias(name) for name, fallback in default.items()])


def lowered(columns: dict[str, Column]):
    """Access to lower-case values, '' for null."""
    return lambda name: F.lower(F.coalesce(columns[name], F.lit("")))


def tags_of(tags: Column):
    """Access to the lower-case values of a tag map, '' for missing ones."""
    return lambda name: F.lower(F.coalesce(F.element_at(tags, name), F.lit("")))


# Groups ---------------------------------------------------------------------------------------------

# Three group tables by map tags; the first matching row wins.
_FOOD = ["restaurant", "cafe", "pub", "bar", "ice_cream", "fast_food", "biergarten", "food_court"]
_CULTURE = ["cinema", "theatre", "arts_centre", "community_centre", "library", "nightclub", "events_venue"]
TOWN_GROUPS = [
    Rule({"group": "gastronomia"}, equals={"amenity": _FOOD}),
    Rule({"group": "kultura"}, equals={"amenity": _CULTURE, "tourism": ["museum", "gallery"]}),
    Rule({"group": "historia"}, equals={"man_made": ["water_tower", "tower"]}, present=["historic"]),
    Rule({"group": "natura"}, equals={"leisure": ["park", "nature_reserve", "bathing_place", "beach_resort"], "tourism": ["viewpoint", "attraction", "theme_park"]}),
    Rule({"group": "sport"}, equals={"leisure": ["sports_centre", "water_park", "swimming_pool", "skatepark", "pumptrack", "pitch", "track", "fitness_centre", "ice_rink", "climbing"]}, present=["sport", "aerialway"]),
    Rule({"group": "parking"}, equals={"amenity": ["parking"]}),
]
REGION_GROUPS = [
    Rule({"group": "parking"}, equals={"amenity": ["parking"]}),
    Rule({"group": "gastronomia"}, equals={"amenity": _FOOD}),
    Rule({"group": "kultura"}, equals={"amenity": _CULTURE, "tourism": ["museum", "gallery"]}),
    Rule({"group": "historia"}, equals={"waterway": ["lock", "dam"], "man_made": ["water_tower", "tower"]}, present=["historic"]),
    Rule({"group": "natura"}, equals={"leisure": ["park", "nature_reserve", "bathing_place", "beach_resort"], "tourism": ["viewpoint", "picnic_site"]}),
    Rule({"group": "sport"}, equals={"leisure": ["sports_centre", "water_park", "swimming_pool", "skatepark", "pumptrack", "pitch", "track", "fitness_centre"]}, present=["sport"]),
]
STARTER_GROUPS = [
    Rule({"group": "kultura"}, equals={"tourism": ["museum", "gallery", "attraction"], "amenity": ["theatre", "cinema", "arts_centre", "community_centre", "planetarium"]}),
    Rule({"group": "gastronomia"}, equals={"amenity": ["restaurant", "cafe", "pub", "fast_food", "bar"]}),
    Rule({"group": "sport"}, equals={"leisure": ["sports_centre", "stadium", "water_park", "ice_rink"]}),
    Rule({"group": "edukacja"}, equals={"amenity": ["library"]}),
]


def group_of(tags: Column, table: list[Rule] = TOWN_GROUPS) -> Column:
    """Group of a tag map by a table, 'inne' without a match and for null."""
    return classify(tags_of(tags), table, {"group": "inne"})["group"]


# Resolution -----------------------------------------------------------------------------------------

# Tag values that make a point of interest, with its category and whether it is indoors; keys are asked in this order.
ALLOWED = {
    "amenity": [
        (["restaurant", "cafe", "fast_food", "bar", "pub"], "Gastronomia", True), (["ice_cream", "biergarten"], "Gastronomia", False),
        (["cinema", "theatre", "nightclub", "events_venue", "community_centre", "library"], "Kultura i Rozrywka", True),
    ],
    "tourism": [(["museum", "gallery"], "Kultura i Rozrywka", True), (["viewpoint", "theme_park", "zoo", "attraction"], "Turystyka i Atrakcje", False), (["aquarium"], "Turystyka i Atrakcje", True)],
    "leisure": [
        (["park", "dog_park"], "Parki i Natura", False), (["playground"], "Dla Dzieci", False), (["sports_centre", "swimming_pool", "water_park", "ice_rink", "fitness_centre"], "Sport i Rekreacja", True),
        (["escape_game", "bowling_alley"], "Kultura i Rozrywka", True),
    ],
    "historic": [(["castle", "ruins", "monument"], "Historia i Zabytki", False)],
}
FOOD, NATURE = "Gastronomia", "Parki i Natura"
KIDS_CATEGORIES, KIDS_KINDS = ["Dla Dzieci", NATURE], ["playground", "theme_park", "aquarium", "water_park", "ice_rink", "museum", "library", "community_centre", "swimming_pool", "cinema"]
FREE_KINDS = ["park", "dog_park", "playground", "viewpoint", "monument", "ruins"]
NAMELESS = {"playground": "Plac zabaw ({street})", "dog_park": "Wybieg dla psów"}


def resolve(elements: DataFrame, tags: str, street: Column) -> DataFrame:
    """Points of interest among map elements: adds name, category, kind, is_indoor, for_kids, for_dogs, is_free, is_food.

    Elements without an allowed tag drop out, and so do nameless ones, but for playgrounds (named after ``street``, the nearest one, else 'osiedlowy') and dog runs.
    Null and empty tag maps drop out.
    """
    t = F.col(tags)
    rows = [(F.element_at(t, key).isin(values), key, category, indoor) for key, entries in ALLOWED.items() for values, category, indoor in entries]
    pick = lambda f: first_match([(F.coalesce(hit, F.lit(False)), f(key, c, i)) for hit, key, c, i in rows])
    out = elements.withColumns({"category": pick(lambda k, c, i: F.lit(c)), "kind": pick(lambda k, c, i: F.element_at(t, k)), "_indoors": pick(lambda k, c, i: F.lit(i))}).where("category is not null")
    near = F.coalesce(F.concat(F.lit("ul. "), F.nullif(street, F.lit(""))), F.lit("osiedlowy"))
    name = F.coalesce(tag(t, "name"), F.when(F.col("kind") == "playground", F.replace(F.lit(NAMELESS["playground"]), F.lit("{street}"), near)).when(F.col("kind") == "dog_park", F.lit(NAMELESS["dog_park"])))
    category, kind, value = F.col("category"), F.col("kind"), lambda k: F.coalesce(F.element_at(t, k), F.lit(""))
    return out.withColumns({
        "name": name,
        "is_indoor": F.when(value("indoor") == "yes", True).when(value("indoor") == "no", False).otherwise(F.col("_indoors")),
        "for_kids": category.isin(KIDS_CATEGORIES) | kind.isin(KIDS_KINDS),
        "for_dogs": (kind == "dog_park") | value("dog").isin("yes", "leashed") | ((category == NATURE) & (value("dog") != "no")),
        "is_free": (category != FOOD) & ((value("fee") == "no") | kind.isin(FREE_KINDS)),
        "is_food": category == FOOD,
    }).where("name is not null").drop("_indoors")


def free_and_indoor(tags: Column, group: Column) -> Column:
    """struct(is_free, is_indoor): by fee and group, a later condition overriding an earlier one."""
    get = lambda k: F.coalesce(F.element_at(tags, k), F.lit(""))
    free = ((get("fee") == "no") | group.isin("natura", "historia")) & (get("fee") != "yes") & (group != "gastronomia")
    indoor = (group.isin("gastronomia", "kultura") | (get("indoor") == "yes") | F.element_at(tags, "building").isNotNull()) & ~get("leisure").isin("park", "nature_reserve", "bathing_place")
    return F.struct(free.alias("is_free"), indoor.alias("is_indoor"))


# Axes of places by name, group and raw amenity --------------------------------------------------------

_M, _A, _E, _N = "poranek", "popoludnie", "wieczor", "noc"


def _place(sub: str, names: list[str], amenities: list[str], group: str | None = None, **says: object) -> Rule:
    return Rule({"sub_category": sub, **says}, holds={"name": names}, equals={"amenity": amenities, **({"group": [group]} if group else {})})


# Kinds of places with company, time of day, season and weather; the first matching row wins.
WATERFALL = [
    _place("lodziarnia", ["lody", "lodziarnia", "ice cream"], ["ice_cream"], context=["dzieci_mlodsze", "rodzina", "randka"], time=[_A, _E], season="lato"),
    _place("fast_food", ["kebab", "doner", "burger", "frytki", "fast food"], ["fast_food"], context=["nastolatki", "znajomi", "solo"], time=[_A, _E, _N]),
    _place("kawiarnia", ["kawiarnia", "cafe", "kawa", "cukiernia", "mikafka", "mała czarna"], ["cafe"], context=["dorosli", "randka", "solo"], time=[_M, _A]),
    _place("bar_pub", ["pub", "bar", "piwo", "browar", "szkwał"], ["pub", "bar", "biergarten"], context=["dorosli", "znajomi"], time=[_E, _N]),
    _place("restauracja", ["sushi", "pizzeria", "pizza", "restauracja", "bistro", "obiady", "trattoria"], ["restaurant"], context=["dorosli", "rodzina", "randka", "znajomi"], time=[_A, _E]),
    _place("akwen", ["dębowa", "kąpielisko", "plaża"], ["bathing_place"], context=["dzieci_mlodsze", "nastolatki", "rodzina", "znajomi"], time=[_M, _A, _E], season="lato", weather="outdoor"),
    _place("park", [], ["park", "nature_reserve"], "natura", context=["dzieci_mlodsze", "rodzina", "dorosli"], time=[_M, _A], weather="outdoor"),
    _place("sport_basen", ["basen", "pływalnia", "wodnik"], ["swimming_pool", "water_park"], context=["dzieci_mlodsze", "nastolatki", "rodzina"], time=[_M, _A, _E]),
    _place("sport_rekreacja", [], ["sports_centre", "skatepark", "pumptrack"], "sport", context=["dorosli", "rodzina"], time=[_A, _E]),
    _place("schron_militaria", ["schron", "blechhammer", "bunker"], ["bunker"], context=["nastolatki", "dorosli", "znajomi"], time=[_M, _A]),
    _place("kino", ["kino", "twierdza"], ["cinema"], context=["nastolatki", "rodzina", "randka"], time=[_A, _E], weather="indoor"),
    _place("muzeum", ["muzeum", "galeria", "izba"], ["museum", "gallery"], context=["dorosli", "rodzina"], time=[_M, _A], weather="indoor"),
    _place("instytucja_kultury", ["dom kultury", "chemik", "mok", "biblioteka"], ["arts_centre", "library"], context=["dorosli", "dzieci_mlodsze", "rodzina"], time=[_A, _E], weather="indoor"),
    _place("inzynieria_wodna", ["śluza", "syfon", "port", "kanał", "wieża"], ["lock", "water_tower"], context=["dorosli", "rodzina", "solo"], time=[_M, _A], weather="outdoor"),
    _place("miejsce_pamieci", ["pomnik", "cmentarz", "mauzoleum"], ["memorial", "monument"], context=["dorosli", "solo"], time=[_M, _A], weather="outdoor"),
    _place("zabytek", [], ["castle", "fort", "ruins"], "historia", context=["dorosli", "rodzina"], time=[_M, _A]),
]
#: Company of skate parks, which differs from other sports.
SKATING, SKATERS = ["skatepark", "pumptrack"], ["nastolatki", "znajomi"]


def six_axes(name: Column, group: Column, amenity: Column, wheelchair: Column, indoor: Column) -> Column:
    """struct(sub_category, context, time, weather, season, accessibility) of a place; nulls count as empty or not indoor."""
    get = lowered({"name": name, "group": group, "amenity": amenity})
    default = {"sub_category": "inne", "context": ["dorosli", "solo"], "time": [_A], "weather": F.when(F.coalesce(indoor, F.lit(False)), "indoor").otherwise("outdoor"), "season": "caly_rok"}
    got = classify(get, WATERFALL, default)
    skating = (got["sub_category"] == "sport_rekreacja") & (get("name").contains(SKATING[0]) | get("name").contains(SKATING[1]))
    chair = F.coalesce(wheelchair, F.lit(""))
    access = first_match([(chair == "yes", F.lit(True)), (chair == "no", F.lit(False)), (get("group").isin("natura", "park"), F.lit(True)), (get("name").contains("schron") | (get("amenity") == "bunker"), F.lit(False))])
    context = F.when(skating, F.array(*map(F.lit, SKATERS))).otherwise(got["context"])
    return F.struct(got["sub_category"].alias("sub_category"), context.alias("context"), *[got[c].alias(c) for c in ("time", "weather", "season")], access.alias("accessibility"))


# Kinds of places with company, time of day and mood; the first matching row wins.
ORTHOGONAL = [
    _place("restauracja", ["bar mleczny"], [], tags_context=["solo", "rodzina", "znajomi"], tags_time=[_M, _A], tags_vibe=["szybko"]),
    _place("fast_food", ["kebab", "doner", "burger", "frytki"], ["fast_food"], tags_context=["solo", "znajomi"], tags_time=[_A, _E, _N], tags_vibe=["szybko"]),
    _place("kawiarnia", ["kawiarnia", "cafe", "kawa", "cukiernia", "lody", "mikafka", "mała czarna", "krukafe"], ["cafe", "ice_cream"], tags_context=["randka", "solo", "znajomi"], tags_time=[_M, _A], tags_vibe=["cicho", "relaks"]),
    _place("bar_pub", ["pub", "bar", "piwo", "browar", "szkwał", "street bar"], ["pub", "bar", "biergarten"], tags_context=["znajomi", "randka"], tags_time=[_E, _N], tags_vibe=["glosno"]),
    _place("restauracja", ["sushi", "pizzeria", "pizza", "restauracja", "bistro", "trattoria", "obiady", "hugo"], ["restaurant"], tags_context=["randka", "rodzina", "znajomi"], tags_time=[_A, _E], tags_vibe=["relaks"]),
    _place("kino", ["kino", "twierdza"], ["cinema"], tags_context=["randka", "rodzina", "znajomi"], tags_time=[_A, _E], tags_vibe=["kultura", "relaks"]),
    _place("instytucja_kultury", ["dom kultury", "chemik", "mok", "kultura", "biblioteka"], ["arts_centre", "community_centre", "library"], tags_context=["solo", "rodzina"], tags_time=[_M, _A, _E], tags_vibe=["kultura", "cicho"]),
    _place("muzeum", ["muzeum", "izba pamięci", "galeria"], ["museum", "gallery"], tags_context=["solo", "rodzina", "znajomi"], tags_time=[_M, _A], tags_vibe=["historia", "cicho", "kultura"]),
    _place("schron_militaria", ["schron", "blechhammer", "bunker"], ["bunker"], tags_context=["solo", "znajomi"], tags_time=[_M, _A], tags_vibe=["historia"]),
    _place("inzynieria_wodna", ["śluza", "syfon", "port", "kanał", "wieża ciśnień"], ["lock", "water_tower"], tags_context=["solo", "randka", "rodzina"], tags_time=[_M, _A], tags_vibe=["historia", "natura", "relaks"]),
    _place("miejsce_pamieci", ["pomnik", "cmentarz", "mauzoleum", "krzyż"], ["memorial", "monument"], tags_context=["solo"], tags_time=[_M, _A], tags_vibe=["historia", "cicho"]),
    _place("zabytek", [], ["castle", "fort", "ruins"], "historia", tags_context=["solo", "rodzina", "znajomi"], tags_time=[_M, _A], tags_vibe=["historia"]),
    _place("akwen", ["dębowa", "akwen", "jezioro", "kąpielisko", "plaża"], ["bathing_place"], tags_context=["randka", "rodzina", "znajomi", "solo"], tags_time=[_M, _A, _E], tags_vibe=["natura", "aktywnosc", "relaks"]),
    _place("park", [], ["park", "nature_reserve"], "natura", tags_context=["randka", "rodzina", "solo"], tags_time=[_M, _A], tags_vibe=["natura", "cicho", "relaks"]),
    _place("sport_basen", ["basen", "pływalnia", "wodnik"], ["swimming_pool", "water_park"], tags_context=["solo", "rodzina", "znajomi"], tags_time=[_M, _A, _E], tags_vibe=["aktywnosc"]),
    _place("sport_rekreacja", [], ["sports_centre", "skatepark", "pumptrack", "pitch", "kort"], "sport", tags_context=["solo", "znajomi"], tags_time=[_M, _A], tags_vibe=["aktywnosc", "glosno"]),
]
ORTHOGONAL_DEFAULT = {"sub_category": "inne", "tags_context": ["solo"], "tags_time": [_A], "tags_vibe": []}


def three_axes(name: Column, group: Column, amenity: Column) -> Column:
    """struct(sub_category, tags_context, tags_time, tags_vibe) of a place; nulls count as empty."""
    return classify(lowered({"name": name, "group": group, "amenity": amenity}), ORTHOGONAL, ORTHOGONAL_DEFAULT)


# Leisure clusters by map tags -------------------------------------------------------------------------

#: Weather of kinds that a roof decides.
ROOFED = "by roof"


def _leisure(cluster: str, sub: str, context: list[str], time: list[str], weather: str | None = None, season: str | None = None, holds: dict | None = None, **equals: list[str]) -> Rule:
    says = {"cluster": cluster, "sub_category": sub, "context": context, "time": time, **({"weather": weather} if weather else {}), **({"season": season} if season else {})}
    return Rule(says, holds=holds or {}, equals=equals)


# Leisure kinds by map tags with their cluster, company, time, weather and season; the first matching row wins.
LEISURE = [
    _leisure("aktywnosc_adrenalina", "karting", ["nastolatki", "znajomi"], [_A, _E], ROOFED, holds={"sport": ["karting"], "name": ["gokart"]}),
    _leisure("aktywnosc_adrenalina", "park_linowy_wspinaczka", ["nastolatki", "rodzina", "znajomi"], [_A], "outdoor", "lato", holds={"sport": ["climbing"], "name": ["park linowy"]}),
    _leisure("aktywnosc_adrenalina", "skatepark_pumptrack", ["nastolatki", "znajomi"], [_A, _E], "outdoor", holds={"sport": ["skate", "bmx"], "name": ["skatepark", "pumptrack"]}, leisure=["track"]),
    _leisure("aktywnosc_adrenalina", "strzelectwo_militaria", ["nastolatki", "znajomi"], [_A, _E], sport=["laser_tag", "paintball", "shooting"]),
    _leisure("aktywnosc_adrenalina", "lodowisko", ["nastolatki", "rodzina", "znajomi"], [_A, _E], "indoor", "zima", leisure=["ice_rink"]),
    _leisure("aktywnosc_adrenalina", "kregielnia_trampoliny", ["nastolatki", "rodzina", "znajomi"], [_A, _E], "indoor", leisure=["bowling_alley", "trampoline_park"], sport=["billiards"]),
    _leisure("woda_rekreacja", "basen_aquapark", ["dzieci_mlodsze", "nastolatki", "rodzina"], [_M, _A, _E], ROOFED, leisure=["water_park", "swimming_pool"], sport=["swimming"]),
    _leisure("woda_rekreacja", "plaza_kapielisko", ["dzieci_mlodsze", "nastolatki", "rodzina", "znajomi"], [_M, _A, _E], "outdoor", "lato", holds={"name": ["debowa", "kąpielisko"]}, leisure=["bathing_place"], natural=["beach"]),
    _leisure("historia_inzynieria", "inzynieria_wodna", ["dorosli", "rodzina", "solo"], [_M, _A], "outdoor", holds={"name": ["syfon"]}, waterway=["lock"], man_made=["water_tower"]),
    _leisure("rodzina_dzieci", "sala_zabaw", ["dzieci_mlodsze", "rodzina"], [_M, _A], "indoor", leisure=["indoor_play"]),
    _leisure("rodzina_dzieci", "plac_zabaw", ["dzieci_mlodsze", "rodzina"], [_M, _A], "outdoor", leisure=["playground"], amenity=["boat_rental"]),
    _leisure("rozrywka_kultura", "kino", ["dorosli", "randka", "rodzina"], [_A, _E], "indoor", amenity=["cinema"]),
    _leisure("rozrywka_kultura", "instytucja_kultury", ["dorosli", "randka", "rodzina"], [_A, _E], "indoor", amenity=["theatre", "arts_centre"], tourism=["museum", "gallery"]),
    _leisure("historia_inzynieria", "militaria_fortyfikacje", ["nastolatki", "dorosli", "solo"], [_M, _A], "outdoor", historic=["bunker", "fort", "castle", "ruins"]),
    _leisure("natura_relaks", "punkt_widokowy", ["randka", "solo", "rodzina"], [_A, _E], "outdoor", tourism=["viewpoint"]),
    _leisure("historia_inzynieria", "miejsce_pamieci", ["dorosli", "solo"], [_M, _A], "outdoor", historic=["monument", "memorial"]),
]
LEISURE_DEFAULT = {"cluster": "natura_relaks", "sub_category": "park", "context": ["rodzina", "solo"], "time": [_A], "weather": "outdoor", "season": "caly_rok"}


def leisure_cluster(tags: Column) -> Column:
    """struct(cluster, sub_category, context, time, weather, season, accessibility) of a tag map."""
    get = tags_of(tags)
    got = classify(get, LEISURE, LEISURE_DEFAULT)
    weather = F.when(got["weather"] == ROOFED, F.when(get("covered") == "yes", "indoor").otherwise("outdoor")).otherwise(got["weather"])
    access = first_match([(get("wheelchair") == "yes", F.lit(True)), ((get("wheelchair") == "no") | (get("historic") == "bunker"), F.lit(False)), (get("leisure").isin("park", "playground"), F.lit(True))])
    return F.struct(*[(weather if c == "weather" else got[c]).alias(c) for c in LEISURE_DEFAULT], access.alias("accessibility"))


# Labels ---------------------------------------------------------------------------------------------

# Labels of wheelchair access and age groups, and of categories on a place's page.
ACCESS_LABELS = {"yes": "Pełny dostęp", "limited": "Ograniczony", "no": "Brak dostępu"}
BARRIER_LABELS = {"yes": "Dostępny bez barier", "limited": "Częściowy dostęp", "no": "Brak dostępu"}
NO_ACCESS_LABEL = "Brak danych"
AGE_GROUPS, ANY_AGE = {"indoor_play": "1 - 8 lat", "escape_game": "12+ lat"}, "Bez ograniczeń"
PAGE_LABELS = [
    (["venue", "theatre", "teatr"], "Scena / Obiekt"), (["museum", "muzeum", "gallery", "galeria"], "Galeria / Muzeum"), (["cinema", "kino"], "Kino"), (["pub", "bar", "klub"], "Klub Muzyczny"),
]
PAGE_LABEL = "Obiekt Kulturalny"


def access_label(wheelchair: Column, labels: dict[str, str] | None = None, unknown: str | None = NO_ACCESS_LABEL) -> Column:
    """Label of a wheelchair tag."""
    return first_match([(F.coalesce(wheelchair == k, F.lit(False)), v) for k, v in (labels or ACCESS_LABELS).items()], unknown)


def age_group(leisure: Column) -> Column:
    """Age group of a leisure kind."""
    return first_match([(F.coalesce(leisure == k, F.lit(False)), v) for k, v in AGE_GROUPS.items()], ANY_AGE)


def page_label(category: Column, amenity: Column, group: Column) -> Column:
    """Category shown on a place's page: by words of the first non-empty of category, amenity and group; else the category itself, else a general one."""
    told = lambda c: F.nullif(c, F.lit(""))
    raw = F.lower(F.trim(F.coalesce(told(category), told(amenity), told(group), F.lit(""))))
    rows = []
    for words, label in PAGE_LABELS:
        hit = F.lit(False)
        for w in words:
            hit = hit | raw.contains(w)
        rows.append((hit, label))
    return first_match(rows, F.coalesce(told(category), F.lit(PAGE_LABEL)))


# Words of names that are exhibits, animals and fixtures rather than places.
JUNK_WORDS = [
    "gibon", "goryl", "kapibara", "lama", "lew", "marmozeta", "małpy", "malpy", "miał ćwir", "ostronos", "sajmirki", "siamang", "tamaryna", "tygrys", "uchatka", "wilk grzywiasty", "wyderki", "żyrafiarnia", "zyrafiarnia",
    "mini zoo", "kraina bioróżnorodności", "stawonogi", "płazy", "plazy", "ptaszek festiwalowy", "peryskop", "krzywe zwierciadła", "kalejdoskop", "drezyna", "lokomotywa", "fontanna", "mara patagońska",
]


def is_junk(name: Column, words: list[str] | None = None) -> Column:
    """Does the name hold a word of the deny list? False for null."""
    out = F.lit(False)
    for w in words or JUNK_WORDS:
        out = out | F.lower(name).contains(w)
    return F.coalesce(out, F.lit(False))
