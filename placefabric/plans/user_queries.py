"""User state and event log queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from placefabric.operators import events, feed, userstate
from placefabric.plans.registry import query
from placefabric.plans.testmap import cte, entity, table

_LAST = "ORDER BY updated_at DESC, order_id DESC, line DESC, reaction"


@query("win10_latest_reaction", cte("reactions") + f"SELECT user_id, place_id, reaction FROM (SELECT *, row_number() OVER (PARTITION BY user_id, place_id {_LAST}) AS rn FROM reactions) WHERE rn = 1")
def win10(spark, sf):
    return userstate.latest(entity(spark, sf, "reactions"), ["user_id", "place_id"], userstate.newest_reaction()).select("user_id", "place_id", "reaction")


_SIGNALS = (
    cte("saves", "reactions").rstrip()
    + f""", latest AS (SELECT user_id, place_id, reaction FROM (SELECT *, row_number() OVER (PARTITION BY user_id, place_id {_LAST}) AS rn FROM reactions) WHERE rn = 1),
    l AS (SELECT user_id, place_id, max(CASE WHEN slug = 'saved' THEN 1 ELSE 0 END) AS wanted, min(CASE WHEN slug = 'been' THEN 1 ELSE 0 END) AS only_been FROM saves GROUP BY user_id, place_id),
    u AS (SELECT user_id, max(CASE WHEN wanted = 1 OR only_been = 0 THEN 1 ELSE 0 END) AS wanting FROM l GROUP BY user_id),
    d AS (SELECT l.user_id, place_id, CASE WHEN wanted = 1 THEN 'want_to_go' WHEN only_been = 0 OR wanting = 0 THEN 'favourite' END AS derived FROM l JOIN u USING (user_id)),
    s AS (SELECT user_id, place_id, CASE WHEN reaction IN ('dislike', 'hide') THEN reaction WHEN reaction = 'favorite' THEN 'favourite' ELSE derived END AS signal FROM d FULL JOIN latest USING (user_id, place_id))
    SELECT * FROM s WHERE signal IS NOT NULL"""
)


@query("alg6_user_signals", _SIGNALS)
def alg6(spark, sf):
    return feed.signals(entity(spark, sf, "saves"), entity(spark, sf, "reactions"))


@query("jn4_saves_with_places", cte("saves", "places") + "SELECT user_id, place_id, name, list_name FROM saves JOIN places ON id = place_id")
def jn4(spark, sf):
    s = entity(spark, sf, "saves")
    return s.join(entity(spark, sf, "places"), F.col("id") == F.col("place_id")).select("user_id", "place_id", "name", "list_name")


@query("jn5_review_place", cte("reviews", "places") + "SELECT review_id, r.rating, name FROM reviews r JOIN places ON id = place_id AND source = 'catalog'")
def jn5(spark, sf):
    r = entity(spark, sf, "reviews").select("review_id", "place_id", F.col("rating").alias("stars"), F.lit("catalog").alias("review_source"))
    p = entity(spark, sf, "places").select("id", "source", "name")
    return r.join(p, (F.col("id") == F.col("place_id")) & (F.col("source") == F.col("review_source"))).select("review_id", F.col("stars").alias("rating"), "name")


@query("jn6_place_review_chain", cte("reviews", "places") + "SELECT id, r.rating, helpful, c_name AS author FROM places LEFT JOIN reviews r ON id = place_id LEFT JOIN customer ON c_custkey = user_id")
def jn6(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("author"))
    p = entity(spark, sf, "places")
    return userstate.place_reviews(p, entity(spark, sf, "reviews"), users).select("id", "rating", "helpful", "author")


@query("jn9_not_exists_insert", "SELECT c_custkey AS user_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def jn9(spark, sf):
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return userstate.insert_new(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id")), new, ["user_id"])


@query("jn10_update_from", "SELECT o_orderkey AS id, coalesce(c_mktsegment, o_orderpriority) AS label FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON c_custkey = o_custkey")
def jn10(spark, sf):
    old = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p"))
    new = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return old.join(new, "k", "left").select("id", F.coalesce("c_mktsegment", "p").alias("label"))


@query("jn16_id_translation", cte("places") + "SELECT source_id, id FROM places WHERE source_id IN ('5', '77', '1000')")
def jn16(spark, sf):
    return entity(spark, sf, "places").where(F.col("source_id").isin("5", "77", "1000")).select("source_id", "id")


@query("jn18_exclude_seeds", cte("places", "reactions") + "SELECT id FROM places WHERE id NOT IN (SELECT place_id FROM reactions WHERE reaction IN ('dislike', 'hide') AND user_id = 7)")
def jn18(spark, sf):
    out = entity(spark, sf, "reactions").where("user_id = 7 and reaction in ('dislike', 'hide')").select(F.col("place_id").alias("id")).distinct()
    return entity(spark, sf, "places").join(out, "id", "left_anti").select("id")


@query("agg2_distinct_sorted_array", cte("log") + "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM log GROUP BY user_id")
def agg2(spark, sf):
    return entity(spark, sf, "log").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


@query("agg3_filtered_max", cte("log") + "SELECT user_id, max(place_id) FILTER (WHERE event_type = 'click') AS max_clicked FROM log GROUP BY user_id")
def agg3(spark, sf):
    return entity(spark, sf, "log").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("place_id"))).alias("max_clicked"))


@query("agg4_coverage_counts", cte("places") + "SELECT count(*) FILTER (WHERE rating IS NOT NULL) AS rated, count(*) FILTER (WHERE popularity >= 50) AS popular, count(*) FILTER (WHERE photo_path IS NULL) AS bare, count(*) AS total FROM places")
def agg4(spark, sf):
    n = lambda c: F.count(F.when(c, 1))
    return entity(spark, sf, "places").agg(n(F.col("rating").isNotNull()).alias("rated"), n(F.col("popularity") >= 50).alias("popular"), n(F.col("photo_path").isNull()).alias("bare"), F.count(F.lit(1)).alias("total"))


@query("agg5_counts", cte("places") + "SELECT count(*) AS n, count(DISTINCT source_id) AS n_ids, count(DISTINCT city) AS n_cities FROM places")
def agg5(spark, sf):
    return entity(spark, sf, "places").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("n_ids"), F.count_distinct("city").alias("n_cities"))


@query("agg6_nested_lists", cte("saves") + "SELECT user_id, string_agg(list_name || ':' || place_id, ',' ORDER BY list_name, place_id) AS items FROM (SELECT DISTINCT user_id, list_name, place_id FROM saves) GROUP BY user_id")
def agg6(spark, sf):
    s = entity(spark, sf, "saves").select("user_id", "list_name", "place_id").distinct()
    items = F.transform(F.sort_array(F.collect_list(F.struct("list_name", "place_id"))), lambda x: F.concat(x["list_name"], F.lit(":"), x["place_id"].cast("string")))
    return s.groupBy("user_id").agg(F.array_join(items, ",").alias("items"))


@query("agg7_signal_rows", cte("saves", "reactions").rstrip() + ", s AS (SELECT user_id, count(DISTINCT place_id) AS n_saved, count(DISTINCT CASE WHEN slug = 'saved' THEN place_id END) AS n_wanted FROM saves GROUP BY user_id), r AS (SELECT user_id, count(*) AS n_reactions FROM reactions GROUP BY user_id) SELECT user_id, coalesce(n_saved, 0) AS n_saved, coalesce(n_wanted, 0) AS n_wanted, coalesce(n_reactions, 0) AS n_reactions FROM s FULL JOIN r USING (user_id)")
def agg7(spark, sf):
    rows = userstate.signal_rows(entity(spark, sf, "saves"), entity(spark, sf, "reactions"))
    return rows.select("user_id", F.size("saved").alias("n_saved"), F.size("wanted").alias("n_wanted"), F.size("reactions").alias("n_reactions"))


@query("agg8_exists_counts", cte("reviews", "places") + "SELECT id, (SELECT count(*) FROM reviews WHERE place_id = id) AS n_reviews, EXISTS (SELECT 1 FROM reviews WHERE place_id = id AND rating = 5) AS has_five FROM places")
def agg8(spark, sf):
    r = entity(spark, sf, "reviews").groupBy("place_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("rating") == 5).cast("int")).alias("five"))
    p = entity(spark, sf, "places").select("id")
    return p.join(r, F.col("id") == F.col("place_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n_reviews"), F.coalesce(F.col("five") == 1, F.lit(False)).alias("has_five"))


@query("win1_page_with_total", cte("reviews") + "SELECT review_id, rating, (SELECT count(*) FROM reviews) AS total FROM reviews ORDER BY helpful DESC, review_id LIMIT 20 OFFSET 40")
def win1(spark, sf):
    return userstate.page_with_total(entity(spark, sf, "reviews"), [F.desc("helpful"), F.asc("review_id")], 40, 20).select("review_id", "rating", "total")


@query("top5_page_past_end", cte("reviews") + "SELECT count(*) AS rows_in_page, (SELECT count(*) FROM reviews) AS total FROM (SELECT * FROM reviews ORDER BY review_id LIMIT 20 OFFSET 1000000)")
def top5(spark, sf):
    r = entity(spark, sf, "reviews")
    page = r.orderBy("review_id").offset(1_000_000).limit(20)
    return page.agg(F.count(F.lit(1)).alias("rows_in_page")).crossJoin(r.agg(F.count(F.lit(1)).alias("total")))


@query("win2_first_impression", cte("log") + "SELECT request_id, place_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id, place_id ORDER BY server_ts, event_id) AS rn FROM log WHERE event_type = 'view') WHERE rn = 1")
def win2(spark, sf):
    return events.first_impressions(entity(spark, sf, "log")).select("request_id", "place_id", "event_id")


@query("jn7_served_items", cte("served", "served_items") + "SELECT request_id, served_user, position, place_id, score FROM served JOIN served_items USING (request_id)")
def jn7(spark, sf):
    return events.served_with_items(entity(spark, sf, "served"), entity(spark, sf, "served_items")).select("request_id", "served_user", "position", "place_id", "score")


_DAY = ("2024-01-01", "2024-01-11")
_TRAIN = (
    cte("log", "served", "served_items").rstrip()
    + f""", shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, place_id ORDER BY server_ts, event_id) AS rn FROM log WHERE event_type = 'view' AND server_ts >= TIMESTAMP '{_DAY[0]}' AND server_ts < TIMESTAMP '{_DAY[1]}') WHERE rn = 1),
    a AS (SELECT request_id, place_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS actions, max(value) FILTER (WHERE event_type = 'click') AS max_dwell, count(*) AS n_actions FROM log WHERE event_type <> 'view' GROUP BY request_id, place_id)
    SELECT shown.request_id, shown.place_id, coalesce(shown.user_id, served_user) AS user_id, event_id, version, position, score, coalesce(actions, '') AS actions, max_dwell, coalesce(n_actions, 0) AS n_actions
    FROM shown LEFT JOIN served ON served.request_id = shown.request_id LEFT JOIN served_items i ON i.request_id = shown.request_id AND i.place_id = shown.place_id LEFT JOIN a ON a.request_id = shown.request_id AND a.place_id = shown.place_id"""
)


def _impressions(spark, sf):
    log = entity(spark, sf, "log")
    return events.labelled_impressions(events.day_slice(log, *_DAY), log, entity(spark, sf, "served"), entity(spark, sf, "served_items"))


@query("jn8_labelled_impressions", _TRAIN)
def jn8(spark, sf):
    return _impressions(spark, sf)


@query("alg_value_weighted_labels", f"SELECT event_id, greatest(CASE WHEN contains(actions, 'purchase') THEN 5e0 ELSE 0 END, CASE WHEN contains(actions, 'click') THEN 1e0 ELSE 0 END) AS label FROM ({_TRAIN})")
def labels(spark, sf):
    return events.weighted_labels(_impressions(spark, sf), {"click": 1, "purchase": 5}).select("event_id", "label")


@query("flt9_day_slice", cte("log") + f"SELECT event_id, server_ts FROM log WHERE server_ts >= TIMESTAMP '{_DAY[0]}' AND server_ts < TIMESTAMP '2024-01-03'")
def flt9(spark, sf):
    return events.day_slice(entity(spark, sf, "log"), _DAY[0], "2024-01-03").select("event_id", "server_ts")


@query("dat1_day_counts", cte("log") + "SELECT CAST(server_ts AS DATE) AS day, event_type, count(*) AS n FROM log GROUP BY 1, 2")
def dat1(spark, sf):
    return entity(spark, sf, "log").groupBy(F.to_date("server_ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("set2_event_days", cte("log", "served") + "SELECT CAST(server_ts AS DATE) AS day FROM log UNION SELECT CAST(served_at AS DATE) FROM served")
def set2(spark, sf):
    return events.event_days(entity(spark, sf, "log"), entity(spark, sf, "served"))


@query("set3_distinct_users", cte("saves") + "SELECT DISTINCT user_id FROM saves")
def set3(spark, sf):
    return entity(spark, sf, "saves").select("user_id").distinct()


@query("set4_membership_diff", cte("saves") + ", c AS (SELECT DISTINCT user_id, place_id FROM saves WHERE slug = 'saved'), w AS (SELECT DISTINCT user_id, place_id FROM saves WHERE slug = 'been') SELECT *, 'add' AS change FROM (SELECT * FROM w EXCEPT SELECT * FROM c) UNION ALL SELECT *, 'remove' FROM (SELECT * FROM c EXCEPT SELECT * FROM w)")
def set4(spark, sf):
    s = entity(spark, sf, "saves")
    return userstate.membership_diff(s.where("slug = 'saved'"), s.where("slug = 'been'"), ["user_id", "place_id"])


@query("set5_tag_jaccard", "WITH d AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents) SELECT a.doc_id AS a_id, b.doc_id AS b_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM d a JOIN d b ON b.doc_id = a.doc_id + 1")
def set5(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    a, b = d.select(F.col("doc_id").alias("a_id"), F.col("w").alias("x")), d.select(F.col("doc_id").alias("b_id"), F.col("w").alias("y"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 1).select("a_id", "b_id", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))


@query("set6_exact_cover", "SELECT o_orderkey AS order_id, coalesce(count(l_linenumber) FILTER (WHERE l_linenumber <= 4) = count(DISTINCT l_linenumber) AND count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber <= 4) = count(DISTINCT l_linenumber), false) AS complete FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def set6(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(F.col("l_orderkey").alias("order_id"), "l_linenumber")
    return userstate.complete_reorder(lines, lines.where("l_linenumber <= 4"), "order_id", "l_linenumber")


_OLD = "old_ AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS amount, c_nationkey AS created FROM customer WHERE c_custkey < 900)"
_NEW = "new_ AS (SELECT c_custkey AS id, upper(c_mktsegment) AS name, c_acctbal * 2 AS amount, 99 AS created FROM customer WHERE c_custkey % 3 = 0)"


def _old_new(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where("c_custkey < 900").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"), F.col("c_nationkey").alias("created"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.upper("c_mktsegment").alias("name"), (F.col("c_acctbal") * 2).alias("amount"), F.lit(99).alias("created"))
    return old, new


@query("ups1_full_merge", f"WITH {_OLD}, {_NEW} SELECT id, CASE WHEN new_.id IS NULL THEN old_.name ELSE new_.name END AS name, round(CASE WHEN new_.id IS NULL THEN old_.amount ELSE new_.amount END, 6) AS amount, coalesce(old_.created, new_.created) AS created FROM old_ FULL JOIN new_ USING (id)")
def ups1(spark, sf):
    return userstate.upsert(*_old_new(spark, sf), ["id"], keep=["created"]).withColumn("amount", F.round("amount", 6))


@query("ups2_insert_if_absent", f"WITH {_OLD}, {_NEW} SELECT id, name FROM new_ WHERE id NOT IN (SELECT id FROM old_)")
def ups2(spark, sf):
    return userstate.insert_new(*_old_new(spark, sf), ["id"]).select("id", "name")


@query("ups3_insert_or_keep", f"WITH {_OLD}, {_NEW} SELECT id, coalesce(old_.name, new_.name) AS name FROM new_ LEFT JOIN old_ USING (id)")
def ups3(spark, sf):
    old, new = _old_new(spark, sf)
    return new.select("id", F.col("name").alias("n")).join(old.select("id", "name"), "id", "left").select("id", F.coalesce("name", "n").alias("name"))


@query("ups4_upsert_keep_columns", f"WITH {_OLD}, {_NEW} SELECT id, coalesce(old_.name, new_.name) AS name, round(CASE WHEN new_.id IS NULL THEN old_.amount ELSE new_.amount END, 6) AS amount FROM old_ FULL JOIN new_ USING (id)")
def ups4(spark, sf):
    return userstate.upsert(*_old_new(spark, sf), ["id"], keep=["name", "created"]).select("id", "name", F.round("amount", 6).alias("amount"))


@query("ups5_fill_missing", cte("places") + "SELECT id, coalesce(rating, google_rating) AS rating FROM places")
def ups5(spark, sf):
    p = entity(spark, sf, "places")
    return userstate.fill_missing(p.select("id", "rating"), p.select("id", F.col("google_rating").alias("rating")), ["id"], ["rating"])


@query("ups6_backfill_json", "SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 THEN 'high' WHEN json_extract_string(props, '$.k') IS NULL THEN 'none' ELSE 'low' END AS band FROM events")
def ups6(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", F.when(k.cast("int") >= 50, "high").when(k.isNull(), "none").otherwise("low").alias("band"))


@query("ups7_reorder", "SELECT l_orderkey AS list_id, l_linenumber AS item, CASE l_linenumber WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE l_linenumber + 10 END AS sort_order FROM lineitem")
def ups7(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").alias("item"), (F.col("l_linenumber") + 10).alias("sort_order"))
    return userstate.reorder(items, "list_id", "item", [3, 1, 2]).select("list_id", "item", "sort_order")


_SLUGS = """WITH l AS (SELECT o_orderkey AS list_id, o_custkey AS user_id, o_orderpriority AS name, o_orderdate AS created_at, CASE WHEN o_orderkey % 5 = 0 AND o_orderpriority = '1-URGENT' THEN 'saved' END AS slug FROM orders),
w AS (SELECT *, coalesce(slug, CASE lower(trim(name)) WHEN '1-urgent' THEN 'saved' WHEN '2-high' THEN 'been' END) AS wanted FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, wanted ORDER BY slug IS NULL, created_at, list_id) AS rn FROM w),
s AS (SELECT list_id, user_id, created_at, CASE WHEN rn = 1 THEN wanted ELSE slug END AS slug FROM r)
SELECT list_id, user_id, slug, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN slug = 'saved' THEN 0 ELSE 1 END, created_at, list_id) = 1 AS is_default FROM s"""


@query("ups8_adopt_slugs", _SLUGS)
def ups8(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("list_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("created_at"), F.when((F.col("o_orderkey") % 5 == 0) & (F.col("o_orderpriority") == "1-URGENT"), "saved").alias("slug"))
    return userstate.adopt_slugs(o, {"1-urgent": "saved", "2-high": "been"}).select("list_id", "user_id", "slug", "is_default")


_KEEP_DAYS = "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) SELECT day, day < DATE '2024-01-20' - 7 AND (day_of_month % 2 = 0) AS deleted FROM (SELECT day, day(day) AS day_of_month FROM d)"


@query("del1_retention", _KEEP_DAYS)
def del1(spark, sf):
    days = table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()
    sets = spark.createDataFrame([("events", 0), ("served", 0), ("impressions", 1)], "dataset string, only_even int")
    archived = days.crossJoin(F.broadcast(sets)).where("only_even = 0 or day(day) % 2 = 0").select("day", "dataset")
    return events.retention(days, archived, "2024-01-20", 7)


@query("del2_delete_reported", cte("reviews") + "SELECT review_id FROM reviews WHERE NOT (user_id = 12 AND place_id IN (SELECT place_id FROM reviews WHERE user_id = 12))")
def del2(spark, sf):
    r = entity(spark, sf, "reviews")
    return userstate.delete(r, r.where("user_id = 12").select("user_id", "place_id").distinct()).select("review_id")


_ONE_SAVE = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, list_name, place_id ORDER BY created_at DESC, order_id DESC, line DESC) AS k FROM saves) WHERE k = 1), ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, list_name ORDER BY created_at DESC, place_id) AS rn FROM one)"


@query("alg53_saved_dashboard", cte("saves").rstrip() + f", {_ONE_SAVE} SELECT user_id, list_name, count(*) AS n, string_agg(CAST(place_id AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS previews FROM ranked GROUP BY user_id, list_name")
def alg53(spark, sf):
    return userstate.dashboard(entity(spark, sf, "saves"))


@query("alg54_saved_state", cte("saves", "reactions", "places").rstrip() + f", s AS (SELECT place_id, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists FROM saves WHERE user_id = 33 GROUP BY place_id), r AS (SELECT place_id, reaction FROM (SELECT *, row_number() OVER (PARTITION BY place_id {_LAST}) AS rn FROM reactions WHERE user_id = 33) WHERE rn = 1) SELECT id, lists, reaction, lists IS NOT NULL AS is_saved FROM places LEFT JOIN s ON s.place_id = id LEFT JOIN r ON r.place_id = id")
def alg54(spark, sf):
    return userstate.saved_state(entity(spark, sf, "places").select("id"), entity(spark, sf, "saves"), entity(spark, sf, "reactions"), 33).select("id", "lists", "reaction", "is_saved")


_KIND = "coalesce(string_agg(CAST(place_id AS VARCHAR), ',' ORDER BY place_id) FILTER (WHERE reaction = '{0}'), '') AS {0}"


@query("alg55_reactions_by_kind", cte("reactions").rstrip() + f", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, place_id {_LAST}) AS rn FROM reactions) WHERE rn = 1) SELECT user_id, {', '.join(_KIND.format(k) for k in ('favorite', 'dislike', 'hide'))} FROM l GROUP BY user_id")
def alg55(spark, sf):
    return userstate.reactions_by_kind(entity(spark, sf, "reactions"))


@query("alg56_onboarding", cte("saves", "places") + "SELECT user_id, count(DISTINCT place_id) AS n_picks FROM saves JOIN places ON id = place_id WHERE id % 2 = 0 GROUP BY user_id")
def alg56(spark, sf):
    return userstate.onboarding(entity(spark, sf, "saves"), entity(spark, sf, "places").where("id % 2 = 0"))


@query("stm6_identity_stitch", "WITH e AS (SELECT event_id, 'a' || (event_id % 400) AS anon_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS user_id, ts AS server_ts FROM events), l AS (SELECT anon_id, user_id, min(server_ts) AS linked_at FROM e WHERE user_id IS NOT NULL GROUP BY anon_id, user_id), m AS (SELECT anon_id, user_id AS linked FROM (SELECT *, row_number() OVER (PARTITION BY anon_id ORDER BY linked_at DESC, user_id DESC) AS rn FROM l) WHERE rn = 1) SELECT event_id, coalesce(user_id, linked) AS user_id FROM e LEFT JOIN m USING (anon_id)")
def stm6(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("a"), F.col("event_id") % 400).alias("anon_id"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("user_id"), F.col("ts").alias("server_ts"))
    return events.stitched(e, events.link_identities(e)).select("event_id", "user_id")


_UUIDS = "CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE concat('00000000-0000-4000-8000-', lpad(concat(event_id % 4000, ''), 12, '0')) END"
_JSON = f"""CASE WHEN event_id % 17 = 0 THEN '[1]' ELSE concat('{{"event_id":"', {_UUIDS}, '","event_type":"', CASE WHEN event_id % 13 = 0 THEN 'Bad Type' ELSE event_type END, '","client_ts":"', CASE WHEN event_id % 7 = 0 THEN 'soon' ELSE '2024-01-02T03:04:05Z' END, '"}}') END"""
_REASON = "CASE WHEN event_id % 17 = 0 THEN 'not_an_object' WHEN event_id % 11 = 0 THEN 'bad_event_id' WHEN event_id % 13 = 0 THEN 'bad_event_type' WHEN event_id % 7 = 0 THEN 'bad_client_ts' END"


@query("flt14_event_validation", f"SELECT coalesce(r, 'accepted') AS outcome, count(*) AS n FROM (SELECT {_REASON} AS r FROM events) GROUP BY 1")
def flt14(spark, sf):
    raw = table(spark, sf, "events").selectExpr(f"{_JSON} AS value")
    return events.validated(raw).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("stm2_batch_outcome", f"WITH a AS (SELECT {_UUIDS} AS id FROM events WHERE ({_REASON}) IS NULL) SELECT count(*) AS accepted, count(DISTINCT CASE WHEN CAST(right(id, 12) AS BIGINT) >= 1000 THEN id END) AS inserted, count(*) - count(DISTINCT CASE WHEN CAST(right(id, 12) AS BIGINT) >= 1000 THEN id END) AS duplicates FROM a")
def stm2(spark, sf):
    accepted = events.validated(table(spark, sf, "events").selectExpr(f"{_JSON} AS value")).where("reject_reason is null")
    store = spark.range(1000).select(F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("event_id"))
    return events.batch_outcome(accepted, store)
