"""Driver queries over places and map elements: groups, kinds, axes, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from plakat.functions import nested
from plakat.operators import agenda, order, poi
from plakat.plans.registry import Registry
from plakat.runtime import read_table

R = Registry()

#: Tags under which a place's raw amenity is looked up, so that each table meets each kind.
_KEYS = ["amenity", "tourism", "leisure", "historic", "sport"]


def tagged(spark, sf_dir):
    """Places with a tag map: the raw amenity under one key by its place in the table, name, fee, indoor and wheelchair."""
    p = read_table(spark, sf_dir, "places_final")
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (F.length("place_id") % len(_KEYS) + 1).cast("int"))
    pair = lambda k, v: F.struct((F.lit(k) if isinstance(k, str) else k).alias("k"), v.alias("v"))
    pairs = F.array(
        pair(key, F.col("raw_amenity")), pair("name", F.col("name")), pair("wheelchair", F.col("wheelchair")), pair("fee", F.when(F.col("is_free"), "no").when(~F.col("is_free"), "yes")),
        pair("indoor", F.when(F.col("is_indoor"), "yes").when(~F.col("is_indoor"), "no")), pair("covered", F.when(F.col("is_indoor"), "yes")),
        pair("dog", F.when(F.col("phone").isNull(), "leashed").when(F.length("phone") % 2 == 0, "no")),
    )
    return p.select("place_id", F.col("address.street").alias("street"), F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull())).alias("tags"))


_TAGS = (
    "t AS (SELECT place_id, address.street AS street, " + ", ".join(f"CASE WHEN length(place_id) % {len(_KEYS)} = {i} THEN raw_amenity END AS {k}" for i, k in enumerate(_KEYS))
    + ", name, wheelchair, CASE WHEN is_free THEN 'no' WHEN NOT is_free THEN 'yes' END AS fee, CASE WHEN is_indoor THEN 'yes' WHEN NOT is_indoor THEN 'no' END AS indoor, CASE WHEN is_indoor THEN 'yes' END AS covered,"
    " CASE WHEN phone IS NULL THEN 'leashed' WHEN length(phone) % 2 = 0 THEN 'no' END AS dog, NULL AS man_made, NULL AS waterway, NULL AS aerialway, NULL AS \"natural\", NULL AS building FROM places_final)"
)


def _quoted(v):
    return "'" + str(v).replace("'", "''") + "'"


def _test(rule, low):
    get = (lambda n: f"lower(coalesce(\"{n}\", ''))") if low else (lambda n: f"coalesce(\"{n}\", '')")
    return " OR ".join(
        [f"contains({get(n)}, {_quoted(w)})" for n, ws in rule.holds.items() for w in ws] + [f"{get(n)} IN ({', '.join(map(_quoted, vs))})" for n, vs in rule.equals.items() if vs] + [f"{get(n)} <> ''" for n in rule.present]
    )


def _case(rules, default, name, low=True):
    """One field of a rule table as SQL: what the first matching row says."""
    text = lambda v: _quoted(", ".join(v)) if isinstance(v, list) else v if v.startswith("CASE") else _quoted(v)
    return "CASE " + " ".join(f"WHEN {_test(r, low)} THEN {text(r.says.get(name, default))}" for r in rules) + f" ELSE {text(default)} END AS {name}"


def _flat(c):
    return lambda *names: [F.array_join(f"{c}.{n}", ", ").alias(n) for n in names]


@R.add("c04_poi_group", f"WITH {_TAGS} SELECT place_id, " + ", ".join(_case(t, "inne", "group").replace(" AS group", f" AS {n}") for n, t in (("town", poi.TOWN_GROUPS), ("region", poi.REGION_GROUPS), ("starter", poi.STARTER_GROUPS))) + " FROM t")
def c04_poi_group(spark, sf_dir):
    """Coarse groups of places by the three tables."""
    t = F.col("tags")
    return tagged(spark, sf_dir).select("place_id", poi.group_of(t).alias("town"), poi.group_of(t, poi.REGION_GROUPS).alias("region"), poi.group_of(t, poi.STARTER_GROUPS).alias("starter"))


_HIT = [(k, vs, c, i) for k, es in poi.ALLOWED.items() for vs, c, i in es]
_PICK = lambda what: "CASE " + " ".join(f"WHEN {k} IN ({', '.join(map(_quoted, vs))}) THEN {what(k, c, i)}" for k, vs, c, i in _HIT) + " END"


@R.add(
    "c05_poi_resolve",
    f"WITH {_TAGS}, r AS (SELECT *, {_PICK(lambda k, c, i: _quoted(c))} AS category, {_PICK(lambda k, c, i: k)} AS kind, {_PICK(lambda k, c, i: i)} AS inside FROM t), "
    "n AS (SELECT *, coalesce(nullif(name, ''), CASE kind WHEN 'playground' THEN 'Plac zabaw (' || coalesce('ul. ' || nullif(street, ''), 'osiedlowy') || ')' WHEN 'dog_park' THEN 'Wybieg dla psów' END) AS shown FROM r WHERE category IS NOT NULL) "
    "SELECT place_id, shown AS name, category, kind, CASE indoor WHEN 'yes' THEN true WHEN 'no' THEN false ELSE inside END AS is_indoor, "
    "category IN ('Dla Dzieci', 'Parki i Natura') OR kind IN ('playground', 'theme_park', 'aquarium', 'water_park', 'ice_rink', 'museum', 'library', 'community_centre', 'swimming_pool', 'cinema') AS for_kids, "
    "kind = 'dog_park' OR coalesce(dog IN ('yes', 'leashed'), false) OR (category = 'Parki i Natura' AND coalesce(dog, '') <> 'no') AS for_dogs, "
    "category <> 'Gastronomia' AND (coalesce(fee = 'no', false) OR kind IN ('park', 'dog_park', 'playground', 'viewpoint', 'monument', 'ruins')) AS is_free, category = 'Gastronomia' AS is_food FROM n WHERE shown IS NOT NULL",
)
def c05_poi_resolve(spark, sf_dir):
    """Points of interest with their category and the matrix of intents."""
    out = poi.resolve(tagged(spark, sf_dir), "tags", F.col("street"))
    return out.select("place_id", "name", "category", "kind", "is_indoor", "for_kids", "for_dogs", "is_free", "is_food")


_PLACE = "t AS (SELECT place_id, name, poi_group AS \"group\", raw_amenity AS amenity, wheelchair, is_indoor FROM places_final)"
_SKATE = "contains(lower(coalesce(name, '')), 'skatepark') OR contains(lower(coalesce(name, '')), 'pumptrack')"


@R.add(
    "c06_six_axes",
    f"WITH {_PLACE}, x AS (SELECT *, {_case(poi.WATERFALL, 'inne', 'sub_category')}, {_case(poi.WATERFALL, ['dorosli', 'solo'], 'context')}, {_case(poi.WATERFALL, ['popoludnie'], 'time')}, "
    + _case(poi.WATERFALL, "CASE WHEN coalesce(is_indoor, false) THEN 'indoor' ELSE 'outdoor' END", "weather") + f", {_case(poi.WATERFALL, 'caly_rok', 'season')} FROM t) "
    f"SELECT place_id, sub_category, CASE WHEN sub_category = 'sport_rekreacja' AND ({_SKATE}) THEN 'nastolatki, znajomi' ELSE context END AS context, time, weather, season, "
    "CASE WHEN wheelchair = 'yes' THEN true WHEN wheelchair = 'no' THEN false WHEN lower(\"group\") IN ('natura', 'park') THEN true WHEN contains(lower(name), 'schron') OR lower(amenity) = 'bunker' THEN false END AS accessibility FROM x",
)
def c06_six_axes(spark, sf_dir):
    """Six axes of places by the first matching kind."""
    p = read_table(spark, sf_dir, "places_final").select("place_id", poi.six_axes(F.col("name"), F.col("poi_group"), F.col("raw_amenity"), F.col("wheelchair"), F.col("is_indoor")).alias("x"))
    return p.select("place_id", "x.sub_category", *_flat("x")("context", "time"), "x.weather", "x.season", "x.accessibility")


@R.add("c07_three_axes", f"WITH {_PLACE} SELECT place_id, " + ", ".join(_case(poi.ORTHOGONAL, d, n) for n, d in poi.ORTHOGONAL_DEFAULT.items()) + " FROM t")
def c07_three_axes(spark, sf_dir):
    """Three independent axes of places."""
    p = read_table(spark, sf_dir, "places_final").select("place_id", poi.three_axes(F.col("name"), F.col("poi_group"), F.col("raw_amenity")).alias("x"))
    return p.select("place_id", "x.sub_category", *_flat("x")("tags_context", "tags_time", "tags_vibe"))


@R.add(
    "c08_leisure_cluster",
    f"WITH {_TAGS}, x AS (SELECT *, " + ", ".join(_case(poi.LEISURE, d, n).replace(f"'{poi.ROOFED}'", "CASE WHEN covered = 'yes' THEN 'indoor' ELSE 'outdoor' END") for n, d in poi.LEISURE_DEFAULT.items())
    + " FROM t) SELECT place_id, cluster, sub_category, context, time, weather, season, CASE WHEN lower(wheelchair) = 'yes' THEN true WHEN lower(wheelchair) = 'no' OR lower(historic) = 'bunker' THEN false WHEN lower(leisure) IN ('park', 'playground') THEN true END AS accessibility FROM x",
)
def c08_leisure_cluster(spark, sf_dir):
    """Leisure clusters of tagged elements."""
    p = tagged(spark, sf_dir).select("place_id", poi.leisure_cluster(F.col("tags")).alias("x"))
    return p.select("place_id", "x.cluster", "x.sub_category", *_flat("x")("context", "time"), "x.weather", "x.season", "x.accessibility")


@R.add(
    "c09_free_indoor",
    f"WITH {_TAGS}, g AS (SELECT *, {_case(poi.TOWN_GROUPS, 'inne', 'group').replace(' AS group', ' AS grp')} FROM t) "
    "SELECT place_id, CASE WHEN coalesce(fee, '') = 'yes' OR grp = 'gastronomia' THEN false ELSE coalesce(fee = 'no', false) OR grp IN ('natura', 'historia') END AS is_free, "
    "CASE WHEN coalesce(leisure IN ('park', 'nature_reserve', 'bathing_place'), false) THEN false ELSE grp IN ('gastronomia', 'kultura') OR coalesce(indoor = 'yes', false) OR building IS NOT NULL END AS is_indoor FROM g",
)
def c09_free_indoor(spark, sf_dir):
    """Free and indoor flags by fee, group and building."""
    t = F.col("tags")
    return tagged(spark, sf_dir).select("place_id", poi.free_and_indoor(t, poi.group_of(t)).alias("x")).select("place_id", "x.is_free", "x.is_indoor")


@R.add("c10_labels", "SELECT place_id, CASE wheelchair WHEN 'yes' THEN 'Pełny dostęp' WHEN 'limited' THEN 'Ograniczony' WHEN 'no' THEN 'Brak dostępu' ELSE 'Brak danych' END AS access, CASE wheelchair WHEN 'yes' THEN 'Dostępny bez barier' WHEN 'limited' THEN 'Częściowy dostęp' WHEN 'no' THEN 'Brak dostępu' END AS barrier, CASE raw_amenity WHEN 'indoor_play' THEN '1 - 8 lat' WHEN 'escape_game' THEN '12+ lat' ELSE 'Bez ograniczeń' END AS age_group FROM places_final")
def c10_labels(spark, sf_dir):
    """Labels of wheelchair access and age groups."""
    w = F.col("wheelchair")
    return read_table(spark, sf_dir, "places_final").select("place_id", poi.access_label(w).alias("access"), poi.access_label(w, poi.BARRIER_LABELS, None).alias("barrier"), poi.age_group(F.col("raw_amenity")).alias("age_group"))


@R.add(
    "c17_page_label",
    "SELECT place_id, CASE WHEN regexp_matches(c, 'venue|theatre|teatr') THEN 'Scena / Obiekt' WHEN regexp_matches(c, 'museum|muzeum|gallery|galeria') THEN 'Galeria / Muzeum' WHEN regexp_matches(c, 'cinema|kino') THEN 'Kino' WHEN regexp_matches(c, 'pub|bar|klub') THEN 'Klub Muzyczny' ELSE coalesce(own, 'Obiekt Kulturalny') END AS label "
    "FROM (SELECT place_id, own, lower(trim(coalesce(own, nullif(raw_amenity, ''), nullif(poi_group, ''), ''))) AS c FROM (SELECT *, CASE WHEN poi_group = 'atrakcje' THEN 'Atrakcja' END AS own FROM places_final))",
)
def c17_page_label(spark, sf_dir):
    """Category label on a place's page; attractions have a category of their own."""
    own = F.when(F.col("poi_group") == "atrakcje", "Atrakcja")
    return read_table(spark, sf_dir, "places_final").select("place_id", poi.page_label(own, F.col("raw_amenity"), F.col("poi_group")).alias("label"))


@R.add("f12_junk_names", f"SELECT place_id, name FROM places_final WHERE NOT coalesce({' OR '.join(f'contains(lower(name), {_quoted(w)})' for w in poi.JUNK_WORDS)}, false)")
def f12_junk_names(spark, sf_dir):
    """Places whose names aren't those of exhibits and fixtures."""
    return read_table(spark, sf_dir, "places_final").where(~poi.is_junk(F.col("name"))).select("place_id", "name")


@R.add("a06_merged_tags", f"WITH {_TAGS} SELECT place_id, CASE WHEN place_id LIKE 'sg-%' THEN 'yes' ELSE fee END AS fee, coalesce(wheelchair, 'unknown') AS wheelchair, 'osm' AS origin FROM t")
def a06_merged_tags(spark, sf_dir):
    """Tag maps with overrides before and defaults after them."""
    over = F.when(F.col("place_id").startswith("sg-"), F.create_map(F.lit("fee"), F.lit("yes")))
    m = nested.merged(over, F.col("tags"), F.create_map(F.lit("wheelchair"), F.lit("unknown"), F.lit("origin"), F.lit("osm")))
    return tagged(spark, sf_dir).select("place_id", m.alias("m")).select("place_id", *[F.element_at("m", k).alias(k) for k in ("fee", "wheelchair", "origin")])


@R.add("a07_tag_lookup", f"WITH {_TAGS} SELECT place_id, coalesce(nullif(amenity, ''), nullif(leisure, ''), nullif(tourism, '')) AS kind FROM t")
def a07_tag_lookup(spark, sf_dir):
    """First tag among alternative keys."""
    return tagged(spark, sf_dir).select("place_id", nested.tag(F.col("tags"), "amenity", "leisure", "tourism").alias("kind"))


@R.add("o01_stable_order", "SELECT record_id, city, CAST(row_number() OVER (PARTITION BY city ORDER BY date_start, record_id) AS INT) AS position FROM event_records WHERE date_start IS NOT NULL")
def o01_stable_order(spark, sf_dir):
    """Position of each record in its town's agenda, in date order, ties by id."""
    r = read_table(spark, sf_dir, "event_records").where("date_start is not null").select("record_id", "city", "date_start")
    return order.positions(r, "city", "date_start", "record_id").select("record_id", "city", "position")


@R.add("o02_first_page_and_rest", "SELECT city, CASE WHEN n <= 40 THEN 'first' ELSE 'more' END AS page, count(*) AS n, min(record_id) AS lo, max(record_id) AS hi FROM (SELECT city, record_id, row_number() OVER (PARTITION BY city ORDER BY date_start, record_id) AS n FROM event_records WHERE date_start IS NOT NULL) GROUP BY 1, 2")
def o02_first_page_and_rest(spark, sf_dir):
    """The first 40 of each town's agenda, and the remainder."""
    r = read_table(spark, sf_dir, "event_records").where("date_start is not null").select("record_id", "city", "date_start")
    first, more = agenda.split_pages(r, "city", "date_start", "record_id")
    both = first.select("city", "record_id", F.lit("first").alias("page")).unionByName(more.select("city", "record_id", F.lit("more").alias("page")))
    return both.groupBy("city", "page").agg(F.count("*").alias("n"), F.min("record_id").alias("lo"), F.max("record_id").alias("hi"))


@R.add("o04_sample", "SELECT record_id, city, title FROM event_records ORDER BY record_id LIMIT 10")
def o04_sample(spark, sf_dir):
    """Ten records to look at: the smallest ids, so that the sample is repeatable."""
    return agenda.sample_rows(read_table(spark, sf_dir, "event_records"), 10, "record_id").select("record_id", "city", "title")


_O5 = "SELECT place_id, CAST(row_number() OVER (PARTITION BY poi_group ORDER BY coalesce(m, 9999), place_id) AS INT) AS position, m FROM (SELECT place_id, poi_group, CASE WHEN geo.lat BETWEEN 50 AND 51 THEN CAST(floor((geo.lat - 50) * 10000) AS INT) END AS m FROM places_final)"


@R.add("o05_sentinel_order", _O5)
def o05_sentinel_order(spark, sf_dir):
    """Order by a distance in which unknown ones stand at 9,999."""
    m = F.when(F.col("geo.lat").between(50, 51), F.floor((F.col("geo.lat") - 50) * 10000).cast("int"))
    p = read_table(spark, sf_dir, "places_final").select("place_id", "poi_group", m.alias("m"))
    return order.positions(p, "poi_group", agenda.or_sentinel(F.col("m")), "place_id").select("place_id", "position", "m")
