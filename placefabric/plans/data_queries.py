"""Walk, ingestion, source and log queries over the test tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placefabric.functions import hours, text
from placefabric.operators import ingest, logs, walk
from placefabric.plans.registry import query
from placefabric.plans.testmap import cte, entity, table
from placefabric.sources import readers

P = cte("places")
_H = "540 + (id % 7) * 1440 AS o, 540 + (id % 7) * 1440 + 60 * (2 + id % 14) AS c"


def _hours(spark, sf):
    p = entity(spark, sf, "places")
    o = (540 + (F.col("id") % 7) * 1440).cast("int")
    c = (o + 60 * (2 + F.col("id") % 14)).cast("int")
    spans = F.array(F.struct(o.alias("open"), c.alias("close")), F.struct((c - 30).alias("open"), (c + 45).alias("close")))
    return p.withColumn("merged", F.when(F.col("id") % 10 != 0, hours.merged_week(spans)))


@query("dat3_merged_week", P + f", h AS (SELECT id, {_H} FROM places) SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE concat(o - 10080, '-', c + 45 - 10080, ',', o, '-', c + 45, ',', o + 10080, '-', c + 45 + 10080) END AS spans FROM h")
def dat3(spark, sf):
    said = F.array_join(F.transform("merged", lambda s: F.concat(s["open"].cast("string"), F.lit("-"), s["close"].cast("string"))), ",")
    return _hours(spark, sf).select("id", said.alias("spans"))


@query("flt16_open_within", P + f", h AS (SELECT id, {_H} FROM places) SELECT id FROM h WHERE id % 10 = 0 OR least(2100, c + 45) - greatest(1980, o) >= 60 OR least(2100, c + 45 - 10080) - greatest(1980, o - 10080) >= 60")
def flt16(spark, sf):
    return _hours(spark, sf).where(hours.open_within(F.col("merged"), F.lit(1980), F.lit(2100), F.lit(60))).select("id")


@query("dat4_visit_wait", P + f", h AS (SELECT id, {_H} FROM places) SELECT id, CASE WHEN id % 10 = 0 THEN 0 WHEN greatest(1970, o) + 40 <= c + 45 AND greatest(1970, o) - 1970 <= 30 THEN greatest(1970, o) - 1970 END AS wait FROM h")
def dat4(spark, sf):
    return _hours(spark, sf).select("id", hours.visit_wait(F.col("merged"), F.lit(1970), F.lit(40)).alias("wait"))


@query("dat5_day_text", P + f", h AS (SELECT id, {_H} FROM places) SELECT id, CASE WHEN id % 10 = 0 THEN NULL WHEN id % 7 <> 1 THEN 'closed' ELSE concat('09:00-', lpad(CAST((c + 45) % 1440 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST((c + 45) % 60 AS VARCHAR), 2, '0')) END AS monday_like FROM h")
def dat5(spark, sf):
    return _hours(spark, sf).select("id", hours.day_text(F.col("merged"), 1).alias("monday_like"))


@query("dat2_timetable", P + " SELECT id, concat(CAST(1440 + (id % 12) * 60 AS INTEGER), '-', CAST(CASE WHEN (id * 5) % 24 <= id % 12 THEN 2880 + ((id * 5) % 24) * 60 ELSE 1440 + ((id * 5) % 24) * 60 END AS INTEGER)) AS spans FROM places")
def dat2(spark, sf):
    j = F.concat(F.lit('{"tuesday":[{"open":{"hour":'), F.col("id") % 12, F.lit(',"minute":0},"close":{"hour":'), (F.col("id") * 5) % 24, F.lit("}},{}]}"))
    spans = hours.spans_of_timetable(j)
    return entity(spark, sf, "places").select("id", F.array_join(F.transform(spans, lambda s: F.concat(s["open"].cast("string"), F.lit("-"), s["close"].cast("string"))), ",").alias("spans"))




@query("mth13_dwell", P + ", b AS (SELECT id, 40e0 * CASE WHEN reviews_count < 20 THEN 0.5e0 WHEN reviews_count < 200 THEN 0.75e0 WHEN reviews_count < 2000 THEN 1 WHEN reviews_count < 10000 THEN 1.25e0 ELSE 1.5e0 END * CASE WHEN name LIKE '%ring%' THEN 1 ELSE 1 END AS b FROM places) SELECT id, greatest(10, least(180, CAST(5 * round_even(b / 5, 0) AS INTEGER))) AS dwell FROM b")
def mth13(spark, sf):
    return entity(spark, sf, "places").select("id", walk.dwell_minutes(F.col("theme"), F.col("name"), F.col("reviews_count"), F.lit(None).cast("string")).alias("dwell"))


@query("flt15_slot_membership", P + " SELECT id, theme = 'theme1' AS strict, theme = 'theme1' OR contains(lower(name), 'ring') OR contains(lower(name), 'small') AS relaxed FROM places")
def flt15(spark, sf):
    member = lambda relaxed: walk.slot_member("theme1", ["ring", "small"], F.lit(relaxed))
    return entity(spark, sf, "places").select("id", member(False).alias("strict"), member(True).alias("relaxed"))


_KM = "2 * 6371.0088e0 * asin(sqrt(least(1e0, pow(sin(radians(44.43e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(44.43e0)) * pow(sin(radians(26.10e0 - lng) / 2), 2))))"


@query("alg37_slot_candidates", P + f", s AS (SELECT id, coalesce(rating, 0.3e0) AS interest, {_KM} AS km FROM places WHERE theme = 'theme2' AND {_KM} <= 1.2), a AS (SELECT id, 0 AS l, row_number() OVER (ORDER BY interest DESC, id) AS rn FROM s), b AS (SELECT id, 1 AS l, row_number() OVER (ORDER BY km, id) AS rn FROM s), u AS (SELECT * FROM a WHERE rn <= 15 UNION ALL SELECT * FROM b WHERE rn <= 15), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l, rn) AS k FROM u) SELECT id, row_number() OVER (ORDER BY l, rn) AS order_no FROM f WHERE k = 1")
def alg37(spark, sf):
    p = entity(spark, sf, "places").withColumn("interest", F.coalesce("rating", F.lit(0.3)))
    return walk.slot_candidates(p, "theme2", ["ring"], 44.43, 26.10, 1.2, 15).select("id", "order_no")


@query("alg39_place_policy", P + ", s AS (SELECT id, CASE id % 5 WHEN 0 THEN 'closed_forever' WHEN 1 THEN 'CLOSED_PERMANENTLY' WHEN 2 THEN 'temporarily_closed' WHEN 3 THEN 'OPERATIONAL' END AS st FROM places) SELECT id, CASE WHEN st IN ('closed_forever', 'CLOSED_PERMANENTLY') THEN 'closed_forever' WHEN st = 'temporarily_closed' AND id % 2 = 0 THEN 'temporarily_closed' END AS reason FROM s")
def alg39(spark, sf):
    st = F.when(F.col("id") % 5 == 0, "closed_forever").when(F.col("id") % 5 == 1, "CLOSED_PERMANENTLY").when(F.col("id") % 5 == 2, "temporarily_closed").when(F.col("id") % 5 == 3, "OPERATIONAL")
    return entity(spark, sf, "places").select("id", walk.place_policy(st, F.col("id") % 2 == 1).alias("reason"))


@query("alg49_route_legs", "WITH s AS (SELECT l_orderkey, l_partkey, 44.43e0 + ((l_partkey * 7919) % 2000 - 1000) * 1.2e-5 AS lat, 26.10e0 + ((l_partkey * 104729) % 2000 - 1000) * 1.7e-5 AS lng FROM lineitem), d AS (SELECT DISTINCT * FROM s), n AS (SELECT *, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2 FROM d WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey)) SELECT l_orderkey AS request_id, l_partkey AS place_id, round(2 * 6371.0088e0 * asin(sqrt(least(1e0, pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng) / 2), 2)))) * 1.35e0 / 4.5e0 * 60, 6) AS minutes FROM n WHERE lat2 IS NOT NULL")
def alg49(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("place_id")).distinct()
    s = s.withColumns({"lat": F.lit(44.43) + ((F.col("place_id") * 7919) % 2000 - 1000) * F.lit(1.2e-5), "lng": F.lit(26.10) + ((F.col("place_id") * 104729) % 2000 - 1000) * F.lit(1.7e-5)})
    w = Window.partitionBy("request_id").orderBy("place_id")
    s = s.withColumns({"lat2": F.lead("lat").over(w), "lng2": F.lead("lng").over(w)}).where("lat2 is not null")
    return s.select("request_id", "place_id", F.round(walk.leg_minutes(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")), 6).alias("minutes"))


@query("str6_words_matched", "SELECT doc_id, CAST(contains(lower(text), 'license') AS INTEGER) + CAST(contains(lower(text), 'token') AS INTEGER) + CAST(contains(lower(text), 'the') AS INTEGER) AS matched FROM documents")
def str6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.words_matched(F.lower("text"), ["license", "token", "the"]).alias("matched"))


@query("str5_fold_tiers", P + " SELECT id, CASE WHEN name = 'small ring' THEN 0 WHEN contains(name, 'small') AND contains(name, 'ring') THEN 1 WHEN contains(name, 'ring') THEN 2 END AS tier FROM places")
def str5(spark, sf):
    n = text.fold(F.col("name"))
    tier = F.when(n == "small ring", 0).when(text.words_matched(n, ["small", "ring"]) == 2, 1).when(F.contains(n, F.lit("ring")), 2)
    return entity(spark, sf, "places").select("id", tier.alias("tier"))


@query("str7_listish", P + " SELECT id, concat(category, '|', theme, '|', lower(city)) AS items FROM places")
def str7(spark, sf):
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit("['"), "category", F.lit("', '"), "theme", F.lit("', None, '"), F.lower("city"), F.lit("']"))).when(F.col("id") % 3 == 1, F.concat(F.lit('["'), "category", F.lit('","'), "theme", F.lit('","'), F.lower("city"), F.lit('"]'))).otherwise(F.concat("category", F.lit("; "), "theme", F.lit(", "), F.lower("city"), F.lit(","), "theme"))
    return entity(spark, sf, "places").select("id", F.array_join(ingest.listish(raw), "|").alias("items"))


@query("str8_ai_tags", P + " SELECT id, CASE WHEN id % 2 = 0 THEN concat(category, ',', theme) ELSE category END AS tags FROM places")
def str8(spark, sf):
    j = F.when(F.col("id") % 2 == 0, F.concat(F.lit('["'), F.upper("theme"), F.lit('"," '), "category", F.lit('","'), "theme", F.lit('"]'))).otherwise(F.concat(F.lit('[{"tag":"'), "category", F.lit('","confidence":"high"},{"tag":"x","confidence":"LOW"},{"tag":"'), "theme", F.lit('","confidence":"high","polarity":"negative"}]')))
    return entity(spark, sf, "places").select("id", F.array_join(ingest.ai_tags(j), ",").alias("tags"))


@query("str9_embedding_text", P + " SELECT id, sha256(concat_ws(chr(10), concat('Name: ', name), concat('Type: ', primary_type), concat('City: ', city))) AS digest, CASE WHEN visibility IS NULL THEN NULL WHEN visibility < 20 THEN 'very low' WHEN visibility < 40 THEN 'low' WHEN visibility < 60 THEN 'medium' WHEN visibility < 80 THEN 'high' ELSE 'very high' END AS bucket FROM places")
def str9(spark, sf):
    t = ingest.embedding_text({"Name": F.col("name"), "Type": F.col("primary_type"), "Blurb": F.lit(" "), "City": F.col("city")})
    return entity(spark, sf, "places").select("id", F.sha2(t, 256).alias("digest"), ingest.axis_bucket(F.col("visibility")).alias("bucket"))


@query("str10_subtype", P + " SELECT id, CASE WHEN primary_type = 'economy' THEN 'budget' WHEN contains(category, '#3') THEN 'third' WHEN contains(name, 'ring') THEN 'ring' END AS subtype FROM places")
def str10(spark, sf):
    s = ingest.subtype(F.col("primary_type"), F.col("category"), F.col("name"), {"economy": "budget"}, {"#3": "third", "ring": "ring"})
    return entity(spark, sf, "places").select("id", s.alias("subtype"))


@query("str13_url_shape", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '\\?.*$', ''), '/\\d+/\\d+/\\d+', '/:z/:x/:y', 'g'), '/\\d+', '/:id', 'g') AS shape FROM pages WHERE NOT regexp_matches(url, '[0-9a-f]{8}-[0-9a-f]{4}')")
def str13(spark, sf):
    return table(spark, sf, "pages").where("not url rlike '[0-9a-f]{8}-[0-9a-f]{4}'").select("page_id", text.url_shape(F.col("url")).alias("shape"))


@query("str14_website_rule", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE url END AS website FROM pages")
def str14(spark, sf):
    u = F.when(F.col("page_id") % 4 == 0, F.lit("https://maps.google.com/x")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", u.alias("u")).select("page_id", ingest.website(F.col("u")).alias("website"))


@query("str15_price_words", P + " SELECT id, CASE id % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN NULL ELSE 1 END AS price FROM places")
def str15(spark, sf):
    words = F.element_at(F.array(*[F.lit(x) for x in ("Free", "moderate", "$$$", "VERY_EXPENSIVE", "unknown", " 1 ")]), (F.col("id") % 6 + 1).cast("int"))
    return entity(spark, sf, "places").select("id", ingest.price_level(words).alias("price"))


@query("str16_leftover_json", P + " SELECT id, CASE WHEN rating IS NULL THEN concat('{\"theme\":\"', theme, '\"}') ELSE concat('{\"theme\":\"', theme, '\",\"has\":\"yes\"}') END AS attributes FROM places")
def str16(spark, sf):
    p = entity(spark, sf, "places").select("id", "theme", F.when(F.col("rating").isNotNull(), "yes").otherwise(" ").alias("has"))
    return p.select("id", ingest.leftovers(p, ["id"]).alias("attributes"))


@query("str17_id_rules", P + " SELECT id, regexp_full_match(source_id, '\\d{1,20}') AS is_cid, regexp_replace(category, '[^a-zA-Z0-9._-]', '_', 'g') AS segment FROM places")
def str17(spark, sf):
    return entity(spark, sf, "places").select("id", F.col("source_id").rlike(r"^\d{1,20}$").alias("is_cid"), ingest.safe_segment(F.col("category")).alias("segment"))


@query("snk2_array_literal", P + " SELECT id, concat('{', category, ',\"', name, '\",', theme, '}') AS literal FROM places WHERE contains(name, ' ')")
def snk2(spark, sf):
    return entity(spark, sf, "places").where("contains(name, ' ')").select("id", ingest.array_literal(F.array("category", "name", "theme")).alias("literal"))


@query("agg27_info_score", P + " SELECT id, round((2e0 + CASE WHEN rating IS NULL THEN 0 ELSE 1 END + CASE WHEN photo_path IS NULL THEN 0 ELSE 1 END) / 4, 6) AS info FROM places")
def agg27(spark, sf):
    parts = [(F.col("name"), 2.0), (F.col("rating"), 1.0), (F.col("photo_path"), 1.0)]
    return entity(spark, sf, "places").select("id", F.round(ingest.info_score(parts), 6).alias("info"))


@query("agg18_coverage", P + " SELECT theme, count(*) AS n, round(count(photo_path) / count(*), 6) AS with_photo, round(count(rating) / count(*), 6) AS with_rating, min(lat) AS south, max(lat) AS north FROM places GROUP BY theme")
def agg18(spark, sf):
    share = lambda c: F.round(F.count(c) / F.count(F.lit(1)), 6)
    return entity(spark, sf, "places").groupBy("theme").agg(F.count(F.lit(1)).alias("n"), share("photo_path").alias("with_photo"), share("rating").alias("with_rating"), F.min("lat").alias("south"), F.max("lat").alias("north"))


@query("alg50_bundle_violations", P + " SELECT count(*) AS n_rows, count(*) FILTER (WHERE trim(name) = '') AS blank_names, 0 AS bad_coordinates, count(*) FILTER (WHERE visibility NOT BETWEEN 0 AND 100) AS bad_scores, count(*) FILTER (WHERE photo_path IS NULL) AS without_photo, 0 AS duplicate_ids FROM places")
def alg50(spark, sf):
    return ingest.violations(entity(spark, sf, "places"))


@query("src3_first_by_numeric_key", "SELECT CAST(event_id % 300 AS VARCHAR) AS cid, min(event_id) AS first_event FROM events WHERE event_id % 9 <> 0 GROUP BY 1")
def src3(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 9 == 0, "x1").otherwise((F.col("event_id") % 300).cast("string")).alias("cid"), F.col("event_id").alias("first_event"), F.col("event_id").alias("line_order"))
    return ingest.first_by_key(e, "cid", "line_order").select("cid", "first_event")


@query("src4_photo_manifest", "SELECT CAST(l_orderkey AS VARCHAR) AS cid, l_linenumber AS photo_index, CASE WHEN l_returnflag = 'A' THEN 'vibe' ELSE 'all' END AS kind FROM lineitem WHERE l_returnflag <> 'R'")
def src4(spark, sf):
    path = F.concat(F.when(F.col("l_returnflag") == "R", F.lit("bad-")).otherwise(F.lit("")), "l_orderkey", F.lit("/"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.when(F.col("l_returnflag") == "A", F.lit("_vibe.jpg")).otherwise(F.lit("_all.png")))
    return ingest.photo_manifest(table(spark, sf, "lineitem").select(path.alias("value")))[0].select("cid", "photo_index", "kind")


@query("src9_json_array_rows", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def src9(spark, sf):
    j = table(spark, sf, "events").select(F.concat(F.lit('[{"event_id":'), "event_id", F.lit(","), F.expr("substring(props, 2)"), F.lit("]")).alias("j"))
    return readers.from_json_array(j, "j", "event_id:bigint,k:int")


@query("src10_ordinality", P + " SELECT id, o AS ordinality, CASE o WHEN 1 THEN category ELSE theme END AS item FROM places, (VALUES (1), (2)) AS v(o)")
def src10(spark, sf):
    return readers.with_ordinality(entity(spark, sf, "places").select("id", F.array("category", "theme").alias("a")), "a").select("id", "ordinality", "item")


@query("src13_embedding_outputs", "SELECT vec_id AS place_row, round(embedding[1]::DOUBLE, 6) AS first_value FROM embeddings WHERE vec_id % 6 <> 0")
def src13(spark, sf):
    e = table(spark, sf, "embeddings")
    line = F.to_json(F.struct(F.concat(F.lit("location_"), "vec_id", F.lit("_x")).alias("custom_id"), F.struct(F.when(F.col("vec_id") % 6 == 0, 500).otherwise(200).alias("status_code"), F.struct(F.array(F.struct(F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))).alias("data")).alias("body")).alias("response")))
    return ingest.embedding_outputs(e.select(line.alias("value")))[0].select("place_row", F.round(F.col("vector")[0], 6).alias("first_value"))


@query("src7_alignment", "SELECT count(*) FILTER (WHERE vec_id IS NULL) AS only_places, count(*) FILTER (WHERE p_partkey IS NULL) AS only_features, count(*) FILTER (WHERE vec_id IS NOT NULL AND p_partkey IS NOT NULL) AS both FROM (SELECT * FROM part WHERE p_partkey % 3 = 0) FULL JOIN embeddings ON p_partkey = vec_id")
def src7(spark, sf):
    return readers.aligned(table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("place_id")), table(spark, sf, "embeddings").select(F.col("vec_id").alias("place_id")))


@query("jsn1_json_build", "SELECT event_id, concat('{\"t\":\"', event_type, '\",\"u\":', user_id, '}') AS j FROM events")
def jsn1(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("t"), F.col("user_id").alias("u"))).alias("j"))


@query("jsn2_row_hash", "SELECT n_nationkey AS id, sha256(concat('{\"n_name\":\"', n_name, '\",\"n_nationkey\":', n_nationkey, ',\"n_regionkey\":', n_regionkey, '}')) AS digest FROM nation")
def jsn2(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("id"), ingest.row_hash(n, n.columns).alias("digest"))


@query("mth14_normalize_score", P + " SELECT id, CAST(floor(coalesce(visibility, 0) / 100 * 100 + 0.5) AS INTEGER) AS score FROM places")
def mth14(spark, sf):
    return entity(spark, sf, "places").select("id", F.floor(F.coalesce("visibility", F.lit(0.0)) / 100 * 100 + 0.5).cast("int").alias("score"))


@query("mth10_subtype_affinity", P + ", m AS (SELECT * FROM (VALUES ('economy', 'promo', 0.8e0), ('economy', 'economy', 1e0), ('promo', 'standard', 0.4e0)) AS v(a, b, w)) SELECT id, coalesce(max(w), 0) AS affinity FROM places LEFT JOIN m ON a = 'economy' AND b = primary_type GROUP BY id")
def mth10(spark, sf):
    m = spark.createDataFrame([("economy", "promo", 0.8), ("economy", "economy", 1.0), ("promo", "standard", 0.4)], "a string, b string, w double").where("a = 'economy'")
    return entity(spark, sf, "places").join(F.broadcast(m), F.col("b") == F.col("primary_type"), "left").groupBy("id").agg(F.coalesce(F.max("w"), F.lit(0.0)).alias("affinity"))


@query("mth11_context_boost", P + " SELECT id, round(greatest(0.25e0, least(3e0, CASE WHEN contains(primary_type, 'economy') THEN 1.8e0 ELSE 1 END * CASE WHEN contains(name, 'ring') THEN 2e0 ELSE 1 END * CASE WHEN contains(category, '#1') THEN 0.1e0 ELSE 1 END)), 6) AS boost FROM places")
def mth11(spark, sf):
    rules = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("economy", 1.8), ("ring", 2.0), ("#1", 0.1))])
    hay = F.concat_ws(" ", "primary_type", "name", "category")
    p = entity(spark, sf, "places").withColumn("hay", hay)
    product = F.aggregate(rules, F.lit(1.0), lambda a, x: a * F.when(F.contains(F.col("hay"), x["k"]), x["v"]).otherwise(1.0))
    return p.select("id", F.round(F.greatest(F.lit(0.25), F.least(F.lit(3.0), product)), 6).alias("boost"))


@query("mth12_taste_focus", P + ", t AS (SELECT theme, count(*) / (SELECT count(*) FROM places) AS p FROM places GROUP BY theme), s AS (SELECT theme, count(*) / (SELECT count(*) FROM places WHERE rating >= 4) AS q FROM places WHERE rating >= 4 GROUP BY theme) SELECT round(sum(q * ln(q / p)), 6) AS kl, round(-sum(q * ln(q)), 6) AS entropy FROM s JOIN t USING (theme)")
def mth12(spark, sf):
    p = entity(spark, sf, "places")
    n = p.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("rating") >= 4, 1)).alias("k"))  # one row
    g = p.groupBy("theme").agg(F.count(F.lit(1)).alias("a"), F.count(F.when(F.col("rating") >= 4, 1)).alias("b")).where("b > 0").crossJoin(F.broadcast(n))
    q, base = F.col("b") / F.col("k"), F.col("a") / F.col("n")
    return g.agg(F.round(F.sum(q * F.log(q / base)), 6).alias("kl"), F.round(-F.sum(q * F.log(q)), 6).alias("entropy"))


def _log(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.to_json(F.struct(
        F.concat(F.lit("r"), F.floor(F.col("event_id") / 3)).alias("reqId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"),
        F.when(F.col("event_id") % 3 == 0, "request completed").alias("event"), F.when(F.col("event_id") % 3 != 0, "metric").alias("eventType"), F.when(F.col("event_id") % 3 != 0, "dependency").alias("metricType"),
        F.col("value").alias("durationMs"), F.col("value").alias("responseTimeMs"), F.concat(F.lit("/v1/places/"), F.col("user_id"), F.lit("?q=1")).alias("url"), F.when(F.col("event_id") % 30 == 0, 500).when(F.col("event_id") % 21 == 0, 404).otherwise(200).alias("statusCode"),
    )).alias("value")).unionByName(spark.createDataFrame([("not json",), ("",)], "value string"))


@query("jn17_request_dependencies", "WITH d AS (SELECT event_id // 3 AS r, count(*) AS n, sum(value) AS ms FROM events WHERE event_id % 3 <> 0 GROUP BY 1) SELECT concat('r', event_id // 3) AS req, coalesce(n, 0) AS n_calls, round(coalesce(ms, 0), 6) AS call_ms FROM events LEFT JOIN d ON r = event_id // 3 WHERE event_id % 3 = 0")
def jn17(spark, sf):
    return logs.request_dependencies(logs.parse_lines(_log(spark, sf))).select(F.col("reqId").alias("req"), "n_calls", F.round("call_ms", 6).alias("call_ms"))


@query("agg21_latency_by_shape", "WITH r AS (SELECT event_type AS k, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT k AS event_type, max(value) FILTER (WHERE i = floor(n * 0.5)) AS p50, max(value) FILTER (WHERE i = floor(n * 0.9)) AS p90, max(n) AS n FROM r GROUP BY k")
def agg21(spark, sf):
    return logs.nearest_rank_by(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9})


@query("agg22_nearest_rank", "WITH r AS (SELECT event_type AS k, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT k AS event_type, max(value) FILTER (WHERE i = ceil(n * 0.95) - 1) AS p95, max(n) AS n FROM r GROUP BY k")
def agg22(spark, sf):
    return logs.nearest_rank_by(table(spark, sf, "events"), ["event_type"], "value", {"p95": 0.95}, rule="ceil")


@query("agg23_status_windows", "SELECT to_timestamp(floor(epoch(ts) / 10) * 10)::TIMESTAMP AS start, sum(CASE WHEN event_id % 30 <> 0 AND event_id % 21 <> 0 THEN 1 ELSE 0 END)::BIGINT AS n_2xx, sum(CASE WHEN event_id % 30 <> 0 AND event_id % 21 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_4xx, sum(CASE WHEN event_id % 30 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_5xx, count(*) AS n FROM events GROUP BY 1")
def agg23(spark, sf):
    return logs.status_windows(logs.parse_lines(_log(spark, sf)))


@query("agg24_log_windows", "SELECT date_trunc('hour', ts) AS start, round(avg(value), 6) AS mean, max(value) AS most, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def agg24(spark, sf):
    w = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"))
    return w.agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.count(F.lit(1)).alias("n"), F.round(F.expr("percentile(value, 0.95)"), 6).alias("p95")).select(F.col("w.start").alias("start"), "mean", "most", "n", "p95")


@query("agg25_counter_rate", "WITH s AS (SELECT event_id, event_type, ts, (event_id * 7) % 1000 AS c FROM events), d AS (SELECT event_id, c, c - lag(c) OVER w AS delta, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS s FROM s WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) SELECT event_id, round(CASE WHEN delta < 0 THEN c ELSE delta END / nullif(s, 0), 6) AS rate FROM d WHERE delta IS NOT NULL AND s > 0")
def agg25(spark, sf):
    s = table(spark, sf, "events").select("event_id", "event_type", "ts", ((F.col("event_id") * 7) % 1000).alias("c"))
    return logs.counter_rate(s, ["event_type"], "ts", "c").where("rate is not null").select("event_id", F.round("rate", 6).alias("rate"))


@query("agg25_histogram_quantile", """WITH b AS (SELECT event_type, le, count(*) FILTER (value <= le) AS c FROM events, (SELECT unnest([5e0, 10e0, 25e0, 50e0, 100e0, CAST('inf' AS DOUBLE)]) AS le) GROUP BY event_type, le),
w AS (SELECT *, coalesce(lag(le) OVER k, 0e0) AS lo, coalesce(lag(c) OVER k, 0) AS below, max(c) OVER (PARTITION BY event_type) AS total FROM b WINDOW k AS (PARTITION BY event_type ORDER BY le)),
h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS n FROM w WHERE c >= total * 0.95e0)
SELECT event_type, CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (total * 0.95e0 - below) / nullif(c - below, 0) END AS quantile FROM h WHERE n = 1""")
def agg25h(spark, sf):
    b = F.explode(F.array(*[F.lit(float(x)) for x in (5, 10, 25, 50, 100)], F.lit(float("inf")))).alias("le")
    e = table(spark, sf, "events").select("event_type", "value", b).groupBy("event_type", "le").agg(F.count(F.when(F.col("value") <= F.col("le"), 1)).alias("count"))
    return logs.histogram_quantile(e, ["event_type"], 0.95)


@query("src12_report_counters", "SELECT concat('/e', user_id % 5) AS endpoint, '200' AS code, count(*) AS n FROM events GROUP BY 1")
def src12(spark, sf):
    c = table(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    j = c.select(F.concat(F.lit('{"aggregate":{"counters":{"http.requests":1,"plugins.metrics.endpoint./e'), "k", F.lit('.codes.200":'), "n", F.lit("}}}")).alias("value"))
    return logs.report_counters(j)


@query("stm9_metric_windows", "SELECT date_trunc('minute', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stm9(spark, sf):
    """The batch form of the streaming windows: the same transformation on a static frame."""
    from placefabric.streaming.intake import windowed_counts

    return windowed_counts(table(spark, sf, "events"), "ts", "1 minute")


