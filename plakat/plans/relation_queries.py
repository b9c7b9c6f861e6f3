"""Driver queries over joins, resolution, clustering, upserts and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from plakat.functions import dates, text
from plakat.functions.geo import haversine_m, in_box, rounded, walk_minutes
from plakat.operators import agenda, dedup, joins, rules, store, views
from plakat.operators.near import near_pairs
from plakat.plans.event_queries import _DAY, _P, _V, AS_OF, day, records
from plakat.plans.registry import Registry
from plakat.runtime import cut, read_table
from plakat.sources import config
from plakat.sources.generators import weekly_series

R = Registry()

_DIST = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
_OK = "geo.lat IS NOT NULL AND geo.lon IS NOT NULL AND NOT (geo.lat = 0 AND geo.lon = 0)"
_PTS = f"p AS (SELECT place_id AS id, poi_group, geo.lat AS lat, geo.lon AS lon FROM places_final WHERE {_OK}), k AS (SELECT osm_id AS id, min(geo.lat) AS lat, min(geo.lon) AS lon FROM parkings WHERE {_OK} GROUP BY osm_id)"


def places(spark, sf_dir):
    return read_table(spark, sf_dir, "places_final").select(F.col("place_id").alias("id"), "poi_group", F.col("geo.lat").alias("lat"), F.col("geo.lon").alias("lon"))


def parkings(spark, sf_dir):
    ok = F.col("geo.lat").isNotNull() & F.col("geo.lon").isNotNull() & ~((F.col("geo.lat") == 0) & (F.col("geo.lon") == 0))
    return read_table(spark, sf_dir, "parkings").where(ok).groupBy(F.col("osm_id").alias("id")).agg(F.min("geo.lat").alias("lat"), F.min("geo.lon").alias("lon"))


@R.add("g01_distance", f"WITH {_PTS} SELECT id, round({_DIST.format(a='p', b='c')}, 3) AS metres FROM p, (SELECT 50.57 AS lat, 20.92 AS lon) c")
def g01_distance(spark, sf_dir):
    """Distance of each place to a point."""
    p = places(spark, sf_dir).where("lat is not null and lon is not null and not (lat = 0 and lon = 0)")
    return p.select("id", F.round(haversine_m(F.col("lat"), F.col("lon"), F.lit(50.57), F.lit(20.92)), 3).alias("metres"))


@R.add("g03_buckets", f"SELECT CAST(round(lat, 3) AS VARCHAR) || ',' || CAST(round(lon, 3) AS VARCHAR) AS bucket, count(*) AS n FROM (SELECT geo.lat AS lat, geo.lon AS lon FROM places_final WHERE {_OK}) WHERE lat BETWEEN 50 AND 51 AND lon BETWEEN 20 AND 21 GROUP BY 1")
def g03_buckets(spark, sf_dir):
    """Rounded buckets of places inside a box."""
    p = places(spark, sf_dir).where("lat is not null and lon is not null and not (lat = 0 and lon = 0)")
    return p.where(in_box(F.col("lat"), F.col("lon"), 50, 20, 51, 21)).groupBy(rounded(F.col("lat"), F.col("lon")).alias("bucket")).agg(F.count("*").alias("n"))


@R.add("j05_gastro_knn", f"WITH {_PTS}, d AS (SELECT p.id AS place, g.id AS gastro, {_DIST.format(a='p', b='g')} AS m FROM p JOIN p g ON g.poi_group = 'gastronomia' AND g.id <> p.id AND g.lat BETWEEN p.lat - 0.0136 AND p.lat + 0.0136 WHERE p.poi_group = 'kultura') SELECT place, gastro, CAST(r AS INT) AS rank, CAST(floor(m) AS INT) AS metres, CAST(greatest(1, round_even(m / 80, 0)) AS INT) AS walk FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY m, gastro) AS r FROM d WHERE m <= 1500) WHERE r <= 2")
def j05_gastro_knn(spark, sf_dir):
    """The two nearest eating places within 1,500 m of each cultural place."""
    p = places(spark, sf_dir)
    k = joins.knn(p.where("poi_group = 'kultura'"), p.where("poi_group = 'gastronomia'"), 2, 1500.0, exclude_self=True)
    return k.select(F.col("left_id").alias("place"), F.col("right_id").alias("gastro"), F.col("rank").cast("int").alias("rank"), F.floor("distance_m").cast("int").alias("metres"), walk_minutes(F.col("distance_m")).alias("walk"))


@R.add("j06_nearest_parking", f"WITH {_PTS}, d AS (SELECT p.id AS place, k.id AS parking, {_DIST.format(a='p', b='k')} AS m FROM p, k) SELECT place, round(m, 1) AS metres FROM d QUALIFY row_number() OVER (PARTITION BY place ORDER BY m, parking) = 1")
def j06_nearest_parking(spark, sf_dir):
    """The nearest car park of each place, however far."""
    return joins.nearest(places(spark, sf_dir), parkings(spark, sf_dir)).select(F.col("left_id").alias("place"), F.round("distance_m", 1).alias("metres"))


def _knn_parking(k, radius):
    sql = f"WITH {_PTS}, d AS (SELECT p.id AS place, k.id AS parking, {_DIST.format(a='p', b='k')} AS m FROM p JOIN k ON k.lat BETWEEN p.lat - {radius / 111000} AND p.lat + {radius / 111000}) SELECT place, parking, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY m, parking) AS r FROM d WHERE m <= {radius}) WHERE r <= {k}"

    def query(spark, sf_dir):
        got = joins.knn(places(spark, sf_dir), parkings(spark, sf_dir), k, float(radius))
        return got.select(F.col("left_id").alias("place"), F.col("right_id").alias("parking"), F.col("rank").cast("int").alias("rank"))

    query.__doc__ = f"The {k} nearest car parks within {radius} m."
    return sql, query


for _name, _k, _r in (("j07_parking_k2", 2, 500), ("j08_parking_k3", 3, 800), ("j09_nearest_50m", 1, 50)):
    _sql, _q = _knn_parking(_k, _r)
    R.add(_name, _sql)(_q)


@R.add("j01_by_id", f"SELECT record_id, coalesce(v.place_id, nullif(e.p, '')) AS place_id, CASE WHEN v.place_id IS NOT NULL THEN 'id' WHEN nullif(e.p, '') IS NOT NULL THEN 'own' ELSE 'none' END AS how FROM (SELECT record_id, {_P} AS p FROM event_records) e LEFT JOIN venue_refs v ON v.place_id = nullif(e.p, '')")
def j01_by_id(spark, sf_dir):
    """Venue by id; unknown ids stay."""
    r = records(spark, sf_dir)
    return joins.resolve(r, "record_id", F.col(_P), read_table(spark, sf_dir, "venue_refs"))


RULES = [("mdk", 0, "sg-miejski-dom-kultury"), ("miejski dom kultury", 0, "sg-miejski-dom-kultury"), ("iglica", 1, "sg-muzeum-iglica"), ("bibliotek", 2, "sg-miejska-biblioteka-publiczna")]
RULES_OF = {"starograb": RULES, "modrzewin": [("kino", 0, "md-kino"), ("muzeum", 1, "md-muzeum")], "brzostow": [("klub", 0, "br-klub"), ("sala", 1, "br-sala"), ("dom", 1, "br-dom")], "kaminiec_wielki": [("teatr", 0, "kw-teatr")]}
TOWN_RULES = [(*x, town) for town, rs in RULES_OF.items() for x in rs]
_RULES = ", ".join(f"('{w}', {o}, '{t}', '{c}')" for w, o, t, c in TOWN_RULES)


@R.add("j02_by_rule", f"SELECT record_id, CAST(o AS INT) AS rule_ord, t AS target FROM (SELECT record_id, city, {_V} AS v FROM event_records) JOIN (VALUES {_RULES}) r(w, o, t, c) ON contains(lower(v), w) AND c = city QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY o, t) = 1")
def j02_by_rule(spark, sf_dir):
    """Venue by the keyword rules of the record's town, first match; records of all towns."""
    table = spark.createDataFrame(TOWN_RULES, "word string, rule_ord int, target string, city string")
    r = records(spark, sf_dir).select("record_id", "city", F.col(_V).alias("v"))
    return rules.rule_join(r, "record_id", F.col("v"), table, "city").select("record_id", "rule_ord", "target")


@R.add("j02_targets_by_name", "SELECT w.city_tag, w.rule_ord, w.word, coalesce(w.target, min(p.place_id)) AS target FROM (VALUES ('starograb', 0, 'mdk', 'sg-x', NULL), ('starograb', 1, 'kino', NULL, 'kino'), ('brzostow', 0, 'bar', NULL, 'rotunda'), ('brzostow', 1, 'nic', NULL, 'zzzz')) w(city_tag, rule_ord, word, target, name) LEFT JOIN places_final p ON contains(lower(p.name), w.name) GROUP BY w.city_tag, w.rule_ord, w.word, w.target HAVING coalesce(w.target, min(p.place_id)) IS NOT NULL")
def j02_targets_by_name(spark, sf_dir):
    """Rules without a target take the first place whose name holds one of their target words; rules without any fall through."""
    rules_ = spark.createDataFrame([("starograb", 0, "mdk", "sg-x"), ("starograb", 1, "kino", None), ("brzostow", 0, "bar", None), ("brzostow", 1, "nic", None)], "city_tag string, rule_ord int, word string, target string")
    words = spark.createDataFrame([("starograb", 1, "kino"), ("brzostow", 0, "rotunda"), ("brzostow", 1, "zzzz")], "city_tag string, rule_ord int, target_word string")
    return config.target_by_name(rules_, read_table(spark, sf_dir, "places_final"), words)


@R.add("j04_cascade")
def j04_cascade(spark, sf_dir):
    """Venue by id, rule and text; each step only for what the earlier ones left. Similarity has no SQL counterpart.

    Rules and texts count in the record's town. Without a town, no rule applies, and the text must mean a venue of one town best.
    """
    return cascade(records(spark, sf_dir), read_table(spark, sf_dir, "venue_refs"))


def cascade(r, refs):
    """Venue of each record: (record_id, place_id, how)."""
    known = refs.select(F.col("place_id").alias("_known"))
    open_ = r.join(known, F.col(_P) == F.col("_known"), "left_anti").select("record_id", F.nullif("city", F.lit("")).alias("city"), F.col(_V).alias("v"))
    table = r.sparkSession.createDataFrame(TOWN_RULES, "word string, rule_ord int, target string, city string")
    # A rule whose target isn't among the venues falls through to the next.
    table = table.join(refs.select(F.col("place_id").alias("target")).distinct(), "target", "left_semi")
    by_rule = rules.rule_join(open_, "record_id", F.col("v"), table, "city").select("record_id", F.col("target").alias("place_id"))
    rest = open_.join(by_rule, "record_id", "left_anti").where(F.length(F.trim("v")) > 3)
    towns = sorted(x[0] for x in refs.where("city is not null").select("city").distinct().collect())  # towns of the portal: a fixed table
    rest = rest.withColumn("city", F.explode(F.when(F.col("city").isNull(), F.array(*[F.lit(t) for t in towns])).otherwise(F.array("city"))))
    tokens = lambda c: F.coalesce(*[F.when(F.col("city") == t, text.venue_tokens(F.col(c), t)) for t in towns])
    local = refs.select("place_id", "city", tokens("name").alias("place_tokens"), F.col("place_id").alias("place_ord"))
    # Each distinct text of a town is compared once, however many records have it.
    texts = dedup.resolve_by_text(rest.select("v", "city").distinct(), "v", tokens("v"), local, area="city")
    best = rest.join(texts, ["v", "city"]).select("record_id", "place_id", "score")
    top = best.groupBy("record_id").agg(F.max("score").alias("top"))
    by_text = best.join(top, "record_id").where("score = top").groupBy("record_id").agg(F.min("place_id").alias("place_id"), F.count("*").alias("n")).where("n = 1").select("record_id", "place_id")
    return joins.resolve(r, "record_id", F.col(_P), refs, by_rule, by_text)


@R.add("j11_place_pages", f"SELECT v.place_id, v.name, n.n_events FROM venue_refs v JOIN (SELECT {_P} AS p, count(*) AS n_events FROM event_records GROUP BY 1) n ON n.p = v.place_id WHERE v.venue_type IN ('muzeum', 'teatr')")
def j11_place_pages(spark, sf_dir):
    """Venues of two kinds with their events."""
    n = records(spark, sf_dir).where(F.col(_P).isNotNull()).groupBy(F.col(_P).alias("place_id")).agg(F.count("*").alias("n_events"))
    v = read_table(spark, sf_dir, "venue_refs").where(F.col("venue_type").isin("muzeum", "teatr"))
    return v.join(n, "place_id").select("place_id", "name", "n_events")


@R.add("j19_near_and_alike", f"WITH p AS (SELECT place_id AS id, lower(trim(name)) AS n, geo.lat AS lat, geo.lon AS lon FROM places_final WHERE {_OK} AND trim(name) <> '') SELECT p.id AS a, q.id AS b FROM p JOIN p q ON q.id > p.id AND q.lat BETWEEN p.lat - 0.0004 AND p.lat + 0.0004 WHERE (contains(p.n, q.n) OR contains(q.n, p.n)) AND {_DIST.format(a='p', b='q')} <= 40")
def j19_near_and_alike(spark, sf_dir):
    """Places within 40 m of each other whose names hold one another."""
    p = places(spark, sf_dir)
    names = read_table(spark, sf_dir, "places_final").select("place_id", "name")
    near = near_pairs(p, p, "id", "id", "lat", "lon", "lat", "lon", 40.0).where("left_id < right_id")
    named = near.join(names.select(F.col("place_id").alias("left_id"), F.col("name").alias("n1")), "left_id").join(names.select(F.col("place_id").alias("right_id"), F.col("name").alias("n2")), "right_id")
    return named.where(joins.contains_either_way(F.col("n1"), F.col("n2"))).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))


@R.add("k02_sync_town", "SELECT city_tag, count(*) AS n FROM (SELECT id, city_tag FROM stored_events WHERE coalesce(city_tag <> 'starograb', true) UNION ALL SELECT id, city_tag FROM stored_events WHERE city_tag = 'starograb' AND id % 2 = 0) GROUP BY city_tag")
def k02_sync_town(spark, sf_dir):
    """Stored rows after one town was replaced by half of its rows."""
    s = read_table(spark, sf_dir, "stored_events").select("id", "city_tag", "source_url")
    new = s.where("city_tag = 'starograb' and id % 2 = 0")
    return store.sync_town(s, new, "city_tag", "starograb", "source_url", "id").groupBy("city_tag").agg(F.count("*").alias("n"))


@R.add("j18_either_way", "SELECT p.place_id, v.place_id AS ref_id FROM places_final p JOIN venue_refs v ON v.city = p.city_tag WHERE trim(p.name) <> '' AND (contains(lower(trim(p.name)), lower(trim(v.name))) OR contains(lower(trim(v.name)), lower(trim(p.name))))")
def j18_either_way(spark, sf_dir):
    """Places whose name holds a venue's name of the same town, or lies in it."""
    v = read_table(spark, sf_dir, "venue_refs").select(F.col("place_id").alias("ref_id"), F.col("name").alias("ref_name"), F.col("city").alias("city_tag"))
    p = read_table(spark, sf_dir, "places_final").select("place_id", "name", "city_tag")
    return joins.held_names(p, v, "city_tag", "name", "ref_name").select("place_id", "ref_id")


@R.add("s10_show_details", "SELECT record_id, first_value(image_url IGNORE NULLS) OVER (PARTITION BY lower(title) ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS image FROM event_records WHERE title IS NOT NULL")
def s10_show_details(spark, sf_dir):
    """One detail lookup a show, shared by its dates: distinct dimension, then join."""
    r = records(spark, sf_dir).where("title is not null").select("record_id", F.lower("title").alias("t"), "image_url")
    dim = r.where("image_url is not null").groupBy("t").agg(F.min_by("image_url", "record_id").alias("image"))
    return r.join(dim, "t", "left").select("record_id", "image")


@R.add("s15_weekly_series", "SELECT r.record_id, CAST(d AS DATE) AS day FROM (SELECT record_id, try_cast(date_start AS DATE) AS s FROM event_records WHERE category = 'workshop' AND regexp_full_match(date_start, '\\d{4}-\\d{2}-\\d{2}')) r, unnest([s + 2, s + 9, s + 16, s + 23]) t(d)")
def s15_weekly_series(spark, sf_dir):
    """Four weekly dates after each workshop."""
    r = records(spark, sf_dir).where((F.col("category") == "workshop") & agenda.iso_date(F.col("date_start"))).select("record_id", F.to_date("date_start").alias("s"))
    return weekly_series(r, "s").select("record_id", "day")


# Duplicates and the store --------------------------------------------------------------------------------


@R.add("e02_same_titles")
def e02_same_titles(spark, sf_dir):
    """Pairs of records of one town and day whose titles are duplicates, between distinct titles. No SQL counterpart."""
    return same_titles(records(spark, sf_dir))


def same_titles(r):
    """Duplicate titles of a town and day; records without a town meet each other."""
    r = r.select(F.coalesce("city", F.lit("")).alias("city"), day().alias("day"), "title", F.col("time_start").alias("t"))
    return dedup.same_title_pairs(r, ["city", "day"], "title", "t").select("day", "title_a", "title_b")


@R.add("e04_clusters")
def e04_clusters(spark, sf_dir):
    """Greedy clusters of duplicate titles, blocked by town, day and venue kind. No SQL counterpart."""
    r = records(spark, sf_dir).where("title is not null").select("record_id", "city", "category", day().cast("string").alias("day"), "title", "time_start")
    return dedup.greedy_clusters(r, ["city", "day", "category"], "record_id", "title", "time_start").select("record_id", "cluster")


@R.add("e05_merged", "SELECT t AS title_key, count(*) AS n_rows, min(record_id) AS first_id, arg_min(description, struct_pack(n := -length(coalesce(description, '')), o := record_id)) AS description FROM (SELECT record_id, lower(title) AS t, description FROM event_records WHERE title IS NOT NULL) GROUP BY t")
def e05_merged(spark, sf_dir):
    """One record a title with the longest description."""
    r = records(spark, sf_dir).where("title is not null").select("record_id", F.lower("title").alias("title_key"), "description", F.col("record_id").alias("first_id"))
    m = dedup.merge_records(r, "title_key", "record_id", ["description"], ["first_id"])
    return m.select("title_key", "n_rows", F.col("first_id").cast("bigint").alias("first_id"), "description")


@R.add("m01_upsert_records", "WITH b AS (SELECT source_url, min(record_id) + 1000000 AS id FROM event_records WHERE source_url IS NOT NULL GROUP BY source_url) SELECT coalesce(b.source_url, s.source_url) AS source_url, coalesce(b.id, s.id) AS id FROM stored_events s FULL JOIN b ON b.source_url = s.source_url")
def m01_upsert_records(spark, sf_dir):
    """Stored table after a batch of all records, the first of each link: known and new links."""
    s = read_table(spark, sf_dir, "stored_events").select("id", "source_url")
    batch = records(spark, sf_dir).where("source_url is not null").groupBy("source_url").agg((F.min("record_id") + 1000000).alias("id"))
    return store.upsert(s, batch, "source_url", "id").select("source_url", "id")


@R.add("m02_fuzzy_upsert")
def m02_fuzzy_upsert(spark, sf_dir):
    """What happens to each record when it meets the stored events of its town and day. Sequential by nature, so no SQL."""
    s = read_table(spark, sf_dir, "stored_events").select(F.col("city_tag").alias("city"), "date_start", F.col("id").alias("ord"), text.title_key(F.col("title")).alias("k"), F.col("source_url").alias("u"))
    b = records(spark, sf_dir).where("date_start is not null").select("city", "date_start", (F.col("record_id") + 10_000_000_000).alias("ord"), text.title_key(F.col("title")).alias("k"), F.col("source_url").alias("u"))
    return dedup.fuzzy_upsert(s, b, ["city", "date_start"], "ord", "k", "u")


@R.add("m05_insert_ignore", "SELECT source_url, min(id) AS id FROM (SELECT id, source_url FROM stored_events UNION ALL SELECT record_id + 1000000, source_url FROM event_records WHERE source_url IS NOT NULL) GROUP BY source_url")
def m05_insert_ignore(spark, sf_dir):
    """Only new links are added."""
    s = read_table(spark, sf_dir, "stored_events").select("id", "source_url")
    b = records(spark, sf_dir).select((F.col("record_id") + 1000000).alias("id"), "source_url")
    return store.insert_ignore(s, b, "source_url", "id").select("source_url", "id")


@R.add("m07_poi_dedup", f"SELECT min(place_id) AS place_id FROM (SELECT place_id, lower(name) AS n, round(geo.lat, 3) AS la, round(geo.lon, 3) AS lo FROM places_final WHERE {_OK} AND name IS NOT NULL) GROUP BY n, la, lo")
def m07_poi_dedup(spark, sf_dir):
    """Places deduplicated by name and rounded point."""
    p = read_table(spark, sf_dir, "places_final").select("place_id", F.lower("name").alias("n"), F.col("geo.lat").alias("lat"), F.col("geo.lon").alias("lon")).where("n is not null and lat is not null and lon is not null and not (lat = 0 and lon = 0)")
    return dedup.first_by(p.withColumn("la", F.round("lat", 3)).withColumn("lo", F.round("lon", 3)), ["n", "la", "lo"], "place_id").select("place_id")


@R.add(
    "m08_slugs",
    "WITH a AS (SELECT record_id, category AS b, date_start AS d, replace(coalesce(time_start, ''), ':', '') AS t, row_number() OVER (PARTITION BY category, date_start ORDER BY record_id) AS r FROM event_records WHERE date_start IS NOT NULL), b2 AS (SELECT *, CASE WHEN r > 1 AND t <> '' THEN row_number() OVER (PARTITION BY b, d, r > 1 AND t <> '', t ORDER BY record_id) END AS rt FROM a), c AS (SELECT *, r > 1 AND coalesce(rt, 2) <> 1 AS rest FROM b2), e AS (SELECT *, row_number() OVER (PARTITION BY b, d, rest ORDER BY record_id) + 1 AS n FROM c) SELECT record_id, concat_ws('-', b, d, CASE WHEN r = 1 THEN NULL WHEN rt = 1 THEN t ELSE CAST(n AS VARCHAR) END) AS slug FROM e",
)
def m08_slugs(spark, sf_dir):
    """Unique slugs."""
    r = records(spark, sf_dir).where("date_start is not null").select("record_id", "category", "date_start", "time_start")
    return dedup.unique_slugs(r, "category", "date_start", "time_start", "record_id").select("record_id", "slug")


@R.add("m09_m10_write_back", f"SELECT record_id, CASE WHEN {_P} = 'sg-muzeum-iglica' THEN NULL WHEN {_V} = 'MDK' AND city = 'starograb' THEN 'sg-miejski-dom-kultury' ELSE {_P} END AS place_id FROM event_records")
def m09_m10_write_back(spark, sf_dir):
    """Resolved places written into nested fields, then one place reset."""
    r = records(spark, sf_dir)
    got = r.where((F.col(_V) == "MDK") & (F.col("city") == "starograb") & (F.coalesce(F.col(_P), F.lit("")) != "sg-muzeum-iglica")).select("record_id", F.lit("sg-miejski-dom-kultury").alias("place_id"))
    out = store.reset_place(store.write_back(r, got, "record_id"), F.col(_P) == "sg-muzeum-iglica")
    return out.select("record_id", F.col(_P).alias("place_id"))


@R.add("w05_group_ids", "SELECT place_id, 'poi_group_' || lpad(CAST(row_number() OVER (ORDER BY place_id) AS VARCHAR), 3, '0') AS group_id FROM places_final")
def w05_group_ids(spark, sf_dir):
    """Running ids over all rows, numbered without one single-task window."""
    return views.running_ids(read_table(spark, sf_dir, "places_final").select("place_id"), "place_id", "poi_group_", "group_id")


# Views --------------------------------------------------------------------------------------------------


@R.add("v01_pages", f"SELECT record_id, CASE WHEN coalesce(title, '') = '' THEN 'Wydarzenie' ELSE title END AS title, {_DAY} AS day, coalesce(v.name, {_V}) AS venue, v.street || ' ' || v.housenumber AS address FROM event_records e LEFT JOIN venue_refs v ON v.place_id = {_P} WHERE coalesce(nullif(date_end, ''), date_start) >= '{AS_OF}'")
def v01_pages(spark, sf_dir):
    """Page model of active events."""
    return views.pages(agenda.active(records(spark, sf_dir), F.lit(AS_OF)), read_table(spark, sf_dir, "venue_refs"), day())


@R.add("v02_home", f"SELECT city, count(*) AS n, least(count(*), 40) AS first_page, greatest(count(*) - 40, 0) AS later FROM event_records WHERE coalesce(nullif(date_end, ''), date_start) >= '{AS_OF}' GROUP BY city")
def v02_home(spark, sf_dir):
    """Page split of each town's agenda."""
    n = agenda.active(records(spark, sf_dir), F.lit(AS_OF)).groupBy("city").agg(F.count("*").alias("n"))
    return n.select("city", "n", F.least("n", F.lit(40)).alias("first_page"), F.greatest(F.col("n") - 40, F.lit(0)).alias("later"))


@R.add("v04_hub", "SELECT city, min(city_name) AS city_name, count(*) AS n_venues FROM venue_refs GROUP BY city")
def v04_hub(spark, sf_dir):
    """Towns of the portal."""
    return read_table(spark, sf_dir, "venue_refs").groupBy("city").agg(F.min("city_name").alias("city_name"), F.count("*").alias("n_venues"))


@R.add("v05_schema_org", "SELECT record_id, title AS name, date_start AS start_date, CASE WHEN status = 'cancelled' THEN 'EventCancelled' ELSE 'EventScheduled' END AS event_status FROM event_records WHERE title IS NOT NULL")
def v05_schema_org(spark, sf_dir):
    """Linked-data projection."""
    return views.schema_org(records(spark, sf_dir).where("title is not null"))


@R.add("v06_build_checks", "SELECT count(*) AS n, count(*) FILTER (WHERE length(coalesce(description, '')) = 0) AS empty_pages, count(*) FILTER (WHERE coalesce(contains(description, 'None'), false)) AS leaks FROM event_records")
def v06_build_checks(spark, sf_dir):
    """Checks before publication."""
    return views.build_checks(records(spark, sf_dir), "description")


_CL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(title), '(?i)\s*-\s*(?:Opole|Bielsko|Kędzierzyn|Bilety|Kup|Amfiteatr|NCPP|NCK|MOK|Dom Kultury|\d{1,2}\s+[a-ząćęłńóśźż]+).*$', ''), '\s*\|\s*.*$', ''), '(?i)\s*\([^)]*(?:Narodowe|Centrum|Amfiteatr|Kultury|Piosenki)[^)]*\)', '', 'g'), '(?i),\s*\d{1,2}\s+[a-ząćęłńóśźż]+.*$', ''), ' -:,')"
_MODEL = rf"""
WITH e AS (SELECT *, {_DAY} AS d, coalesce(CAST({_DAY} AS VARCHAR), nullif(date_start, '')) AS dt, replace(coalesce(nullif(category, ''), 'wydarzenie'), '_', '_') AS b, replace(coalesce(time_start, ''), ':', '') AS t FROM event_records WHERE coalesce(title, '') <> ''),
a AS (SELECT *, row_number() OVER (PARTITION BY b, dt ORDER BY record_id) AS r FROM e WHERE dt IS NOT NULL),
b2 AS (SELECT *, CASE WHEN r > 1 AND t <> '' THEN row_number() OVER (PARTITION BY b, dt, r > 1 AND t <> '', t ORDER BY record_id) END AS rt FROM a), c AS (SELECT *, r > 1 AND coalesce(rt, 2) <> 1 AS rest FROM b2),
s AS (SELECT *, concat_ws('-', b, dt, CASE WHEN r = 1 THEN NULL WHEN rt = 1 THEN t ELSE CAST(row_number() OVER (PARTITION BY b, dt, rest ORDER BY record_id) + 1 AS VARCHAR) END) AS slug FROM c),
j AS (SELECT s.*, v.place_id AS vp, v.name AS vn, v.street || ' ' || v.housenumber AS va, v.city_name AS vt, coalesce(v.name, nullif(s.{_V}, ''), 'Wydarzenie') AS ve, coalesce(try_cast(nullif(date_end, '') AS DATE), d, try_cast(dt AS DATE)) AS en FROM s LEFT JOIN venue_refs v ON v.place_id = s.{_P})
SELECT record_id, slug, {_CL} AS title, coalesce({{days}}[isodow(sd)] || ', ' || day(sd) || ' ' || {{months}}[month(sd)], dt) AS date_shown, CASE WHEN d = DATE '{AS_OF}' THEN 'DZIŚ' WHEN d < DATE '{AS_OF}' AND en >= DATE '{AS_OF}' THEN 'TRWA' WHEN d = DATE '{AS_OF}' + 1 THEN 'JUTRO' END AS badge,
  coalesce(nullif(analysis.ticket_info.time_start, ''), nullif(time_start, ''), '18:00') AS time_start, CASE WHEN nullif(trim(stage_name, ' '), '') IS NOT NULL AND trim(stage_name, ' ') <> ve THEN ve || ' (' || trim(stage_name, ' ') || ')' ELSE ve END AS venue,
  CASE WHEN vp IS NOT NULL THEN va || ', ' || vt ELSE 'Portal' END AS address, coalesce(nullif(category, ''), 'Kultura i Rozrywka') AS category, coalesce(nullif(organizer, ''), source, ve) AS organizer, coalesce(nullif(description[1:180], ''), {_CL} || '.') AS lead,
  nullif(analysis.ticket_info.doors_open, '') AS doors_open, nullif(age_limit, '') AS age_limit, CASE WHEN wheelchair_accessible THEN 'yes' WHEN NOT wheelchair_accessible THEN 'no' WHEN vp IS NOT NULL THEN 'limited' END AS access, coalesce(len(ticket_offers), 0) AS n_offers, nullif(image_url, '') AS image_url
FROM (SELECT *, CASE WHEN regexp_full_match(dt, '\d{{4}}-\d{{2}}-\d{{2}}') THEN try_cast(dt AS DATE) END AS sd FROM j)
"""
_MODEL = _MODEL.replace("{days}", "['" + "', '".join(dates.DAYS) + "']").replace("{months}", "['" + "', '".join(dates.MONTHS_OF) + "']")


@R.add("v01_page_model", _MODEL)
def v01_page_model(spark, sf_dir):
    """The whole page model of every event: slug, shown texts, venue, access, defaults."""
    return views.page_model(records(spark, sf_dir), read_table(spark, sf_dir, "venue_refs"), F.lit(AS_OF).cast("date"), day(), "Portal")


@R.add("v03_place_pages", f"WITH u AS (SELECT {_P} AS p, record_id, row_number() OVER (PARTITION BY {_P} ORDER BY date_start, record_id) AS position, count(*) OVER (PARTITION BY {_P}) AS n FROM event_records WHERE coalesce(nullif(date_end, ''), date_start) >= '{AS_OF}' AND {_P} IS NOT NULL) SELECT v.place_id, v.name, CAST(u.position AS INT) AS position, u.record_id, coalesce(u.n, 0) AS n_upcoming FROM venue_refs v LEFT JOIN (SELECT * FROM u WHERE position <= 40) u ON u.p = v.place_id WHERE u.p IS NOT NULL OR v.venue_type IN ('muzeum', 'teatr')")
def v03_place_pages(spark, sf_dir):
    """Pages of venues with their next 40 events; museums and theatres come without events too."""
    v = read_table(spark, sf_dir, "venue_refs")
    return views.place_pages(v, records(spark, sf_dir), F.col(_P), F.lit(AS_OF), F.col("venue_type").isin("muzeum", "teatr"))


@R.add("v05_linked_data", f"SELECT record_id, title AS name, date_start AS start_date, coalesce(nullif(date_end, ''), date_start) AS end_date, CASE WHEN status = 'cancelled' THEN 'EventCancelled' ELSE 'EventScheduled' END AS event_status, coalesce(v.name, {_V}) AS location, v.street || ' ' || v.housenumber AS street_address, coalesce(array_to_string(list_filter(list_transform(ticket_offers, lambda o: o.url), lambda u: coalesce(u, '') <> ''), ' '), '') AS offers, coalesce(len(list_filter(list_transform(ticket_offers, lambda o: o.url), lambda u: coalesce(u, '') <> '')), 0) AS n_offers FROM event_records e LEFT JOIN venue_refs v ON v.place_id = e.{_P}")
def v05_linked_data(spark, sf_dir):
    """Linked data with location, address, end and offers."""
    return views.linked_data(records(spark, sf_dir), read_table(spark, sf_dir, "venue_refs"))
