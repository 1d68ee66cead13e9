"""Walk planning over many requests, sources and sinks that write and read again, and streams that run to their end."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placefabric.functions.geo import haversine_km
from placefabric.operators import search, walk
from placefabric.plans.geo_queries import KM, LAT, LNG
from placefabric.plans.registry import query
from placefabric.plans.testmap import cte, entity, table
from placefabric.sources import readers, scratch, sinks
from placefabric.streaming import intake
from placefabric.streaming.event_store import EventStore
from placefabric.streaming.identity import last_told, stitched_stream
from placefabric.streaming.limits import Rule, keyed_state, limited

P = cte("places")


def _p(spark, sf):
    return entity(spark, sf, "places")


# walks


def _candidates(spark, sf):
    """Requests of three slots with eight places each, over all places; every third place has opening hours."""
    hours = F.array(F.array((540 + F.col("id") % 90).cast("long"), (900 + F.col("id") % 300).cast("long")))
    return _p(spark, sf).select(
        F.floor(F.col("id") / 24).alias("request_id"), (F.col("id") % 3).cast("int").alias("slot"), F.col("id").alias("place_id"), "lat", "lng", F.coalesce(F.col("rating") / 5, F.lit(0.3)).alias("interest"),
        (20 + (F.col("id") * 7) % 30).cast("int").alias("dwell"), F.lit(LAT).alias("start_lat"), F.lit(LNG).alias("start_lng"), F.when(F.col("id") % 3 == 0, hours).alias("hours"),
    )


def solved(candidates, kind, budget=240.0):
    """One step of the solver on each request: request_id, position, place_id."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        q = walk._request(pdf, budget, True)
        flat = [s for slot in q.slots for s in slot]
        if kind == "order":
            stops = [flat[i] for i in walk.order_stops([(s.lat, s.lng) for s in flat])]
        elif kind == "orienteering":
            stops = walk.orienteering(flat, q, 6, frozenset(s.place_id for s in flat if s.place_id % 4 == 0))
        else:
            stops = walk.solve_slots(q)
            if kind == "insert":
                new = next((s for s in flat if s.place_id not in {x.place_id for x in stops}), None)
                if new:
                    k = walk.insertion(stops, new, q)
                    stops = [*stops[:k], new, *stops[k:]]
            elif kind == "fill":
                stops = walk.fill_extras(stops, q)
        return pd.DataFrame({"request_id": int(pdf.request_id.iloc[0]), "position": range(len(stops)), "place_id": [s.place_id for s in stops]})

    return candidates.groupBy("request_id").applyInPandas(work, "request_id long, position int, place_id long")


for _name, _kind in (("alg41_slot_beam", "beam"), ("alg42_stop_order", "order"), ("alg43_orienteering", "orienteering"), ("alg44_best_insertion", "insert"), ("alg45_fill_extras", "fill")):
    query(_name)(lambda spark, sf, kind=_kind: solved(_candidates(spark, sf), kind))


@query("alg46_plan_totals")
def alg46(spark, sf):
    return walk.plan_totals(_candidates(spark, sf), 2)


@query("alg48_edited_sequences")
def alg48(spark, sf):
    """Six stops of each request in a given order, a seventh to be inserted; every ninth request repeats a place."""
    c = _candidates(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy((F.col("place_id") * 31) % 97, "place_id"))).where("n <= 7")
    c = c.withColumn("position", F.when(F.col("n") < 7, F.col("n").cast("int"))).withColumn("place_id", F.when((F.col("request_id") % 9 == 4) & (F.col("n") == 2), F.min("place_id").over(Window.partitionBy("request_id"))).otherwise(F.col("place_id")))
    return walk.edited_sequences(c.drop("n", "slot"))


def _slots_and_places(spark, sf):
    """A request for each supplier: three slots by theme. And the places."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("request_id"), (F.lit(44.42) + (F.col("s_suppkey") * 7919) % 2000 * F.lit(1e-5)).alias("start_lat"), (F.lit(26.09) + (F.col("s_suppkey") * 104729) % 2000 * F.lit(1e-5)).alias("start_lng"))
    s = s.withColumn("slot", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("theme", F.concat(F.lit("theme"), (F.col("request_id") + F.col("slot")) % 6))
    return s, _p(spark, sf).select(F.col("id").alias("place_id"), "lat", "lng", F.coalesce(F.col("rating") / 5, F.lit(0.3)).alias("interest"), "theme")


@query("alg47_walk_plans")
def alg47(spark, sf):
    """Two plans for each request from the fifteen best places of a slot within two kilometres."""
    return walk.plan_requests(walk.best_within(*_slots_and_places(spark, sf), 2.0, 15).withColumn("dwell", F.lit(30)))


@query("top8_best_and_nearest", P + f", s AS (SELECT theme, id, coalesce(rating, 0.3e0) AS interest, {KM} AS km FROM places), a AS (SELECT *, 0 AS l, row_number() OVER (PARTITION BY theme ORDER BY interest DESC, id) AS rn FROM s), b AS (SELECT *, 1 AS l, row_number() OVER (PARTITION BY theme ORDER BY km, id) AS rn FROM s), u AS (SELECT * FROM a WHERE rn <= 12 UNION ALL SELECT * FROM b WHERE rn <= 12), f AS (SELECT *, row_number() OVER (PARTITION BY theme, id ORDER BY l, rn) AS k FROM u) SELECT theme, id, CAST(row_number() OVER (PARTITION BY theme ORDER BY l, rn) AS INTEGER) AS order_no FROM f WHERE k = 1")
def top8(spark, sf):
    c = _p(spark, sf).select("theme", "id", F.coalesce("rating", F.lit(0.3)).alias("interest"), haversine_km(F.col("lat"), F.col("lng"), LAT, LNG).alias("distance_km"))
    return walk.best_and_nearest(c, "theme", 12).select("theme", "id", "order_no")


@query("top10_walk_search", P + ", t AS (SELECT *, CASE WHEN name = 'ring' THEN 0 WHEN starts_with(name, 'ring') THEN 1 WHEN contains(name, 'ring') THEN 2 WHEN contains(concat_ws(' ', name, category, primary_type), 'ring') THEN 3 END AS tier FROM places) SELECT id, name, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, visibility DESC NULLS LAST, name, id LIMIT 40")
def top10(spark, sf):
    return search.tiered_search(_p(spark, sf), " RING ", 40).select("id", "name", "tier")


_SHARE = "(CAST(contains(lower(name), 'small') AS INTEGER) + CAST(contains(lower(name), 'ring') AS INTEGER)) / 2e0"


@query("top4_search_rank", P + f", s AS (SELECT *, {_SHARE} AS ns, CAST(contains(primary_type, 'promo') AS INTEGER) * 1e0 AS ts, {KM} AS km FROM places) SELECT id, round(100 * greatest(ns, 0.6e0 * ts) + CASE WHEN name = 'small ring' THEN 30 ELSE 0 END + CASE WHEN starts_with(name, 'small ring') THEN 15 ELSE 0 END + CASE WHEN lower(city) = 'nation_3' THEN 12 ELSE 0 END + CASE WHEN lower(country) = 'europe' THEN 6 ELSE 0 END + 10 / (1 + km) + 8 * coalesce(visibility, 0) / 100 + 5 * coalesce(popularity, 0) / 100, 6) AS search_score FROM s ORDER BY 2 DESC, id LIMIT 50")
def top4(spark, sf):
    """The rank formula of search over given similarities, best fifty."""
    from placefabric.functions import text

    share = text.words_matched(F.lower("name"), ["small", "ring"]) / 2
    rows = _p(spark, sf).withColumns({"name_norm": text.norm(F.col("name")), "name_similarity": share, "category_similarity": F.lit(0.0), "type_similarity": F.contains("primary_type", F.lit("promo")).cast("double")})
    score = search.search_score(haversine_km(F.col("lat"), F.col("lng"), LAT, LNG), "nation_3", "europe", "small ring")
    return rows.select("id", F.round(score, 6).alias("search_score")).orderBy(F.desc("search_score"), "id").limit(search.MOST)


@query(
    "alg35_interest_map",
    P
    + """, u AS (SELECT s_suppkey AS user_id FROM supplier), sd AS (SELECT DISTINCT user_id, (user_id * 7 + j * 13) % 300 AS id, true AS seed FROM u, range(4) t(j) WHERE user_id % 5 <> 0),
    x AS (SELECT user_id, id, source_id, theme, coalesce(rating, 0.3e0) AS cold, CASE WHEN id % 11 <> user_id % 11 THEN (id * 53 + user_id * 17) % 997 END AS taste FROM places, u),
    y AS (SELECT x.*, coalesce(seed, false) AND taste IS NOT NULL AS is_seed FROM x LEFT JOIN sd USING (user_id, id)), z AS (SELECT *, bool_or(is_seed) OVER (PARTITION BY user_id) AS warm FROM y),
    m AS (SELECT * FROM z WHERE warm AND NOT is_seed AND taste IS NOT NULL),
    r AS (SELECT *, rank() OVER (PARTITION BY user_id, theme ORDER BY cold) AS rc, count(*) OVER (PARTITION BY user_id, theme, cold) AS cc, rank() OVER (PARTITION BY user_id, theme ORDER BY taste) AS rt, count(*) OVER (PARTITION BY user_id, theme, taste) AS ct, count(*) OVER (PARTITION BY user_id, theme) AS n FROM m),
    b AS (SELECT *, (rt + (ct - 1) / 2e0) / n AS pct, 0.4e0 * (rc + (cc - 1) / 2e0) / n + 0.6e0 * (rt + (ct - 1) / 2e0) / n AS b FROM r),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id, theme ORDER BY round(b, 9), source_id) AS k, row_number() OVER (PARTITION BY user_id, theme ORDER BY cold) AS j FROM b),
    d AS (SELECT p.user_id, p.id, q.cold AS interest, p.pct FROM o p JOIN o q ON p.user_id = q.user_id AND p.theme = q.theme AND p.k = q.j)
    SELECT z.user_id, z.source_id, round(coalesce(d.interest, z.cold), 6) AS interest, CASE WHEN warm THEN 'favourites' ELSE 'popularity' END AS mode, round(CASE WHEN is_seed THEN 1e0 ELSE d.pct END, 9) AS taste_pct FROM z LEFT JOIN d USING (user_id, id)""",
)
def alg35(spark, sf):
    """Interest of every place for every supplier as a user; each fifth user has no seeds."""
    users = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"))
    p = _p(spark, sf).select("id", "source_id", "theme", F.coalesce("rating", F.lit(0.3)).alias("cold"))
    every = users.join(p, F.lit(True))  # each user has a map of the whole catalogue
    seeds = users.where("user_id % 5 <> 0").select("user_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).select("user_id", ((F.col("user_id") * 7 + F.col("j") * 13) % 300).cast("string").alias("source_id")).distinct()
    taste = every.where("id % 11 <> user_id % 11").select("user_id", "source_id", ((F.col("id") * 53 + F.col("user_id") * 17) % 997).cast("double").alias("taste"))
    out = walk.interest_map(every.drop("id"), seeds, taste, 0.6)
    return out.select("user_id", "source_id", F.round("interest", 6).alias("interest"), "mode", F.round("taste_pct", 9).alias("taste_pct"))


@query(
    "alg40_request_rules",
    "WITH q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'soon' ELSE '2026-10-02' END AS d, concat(lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0'), ':15') AS t, o_orderkey % 1700 AS minutes, o_orderkey % 11 AS slots, o_orderkey % 13 AS must, o_orderkey % 8 AS variants, (o_orderkey % 600) / 10e0 AS radius FROM orders) SELECT id, concat_ws(',', CASE WHEN d = 'soon' THEN 'date' END, CASE WHEN o > 23 THEN 'start_time' END, CASE WHEN minutes < 15 OR minutes > 1440 THEN 'minutes' END, CASE WHEN slots > 8 THEN 'slots' END, CASE WHEN must > 10 THEN 'must_visit' END, CASE WHEN variants < 1 OR variants > 5 THEN 'variants' END, CASE WHEN radius < 0.3 OR radius > 50 THEN 'radius_km' END) AS errors FROM (SELECT *, id % 30 AS o FROM q)",
)
def alg40(spark, sf):
    k = F.col("o_orderkey")
    errors = walk.request_errors(F.when(k % 7 == 0, "soon").otherwise("2026-10-02"), F.concat(F.lpad((k % 30).cast("string"), 2, "0"), F.lit(":15")), k % 1700, k % 11, k % 13, k % 8, (k % 600) / 10.0)
    return table(spark, sf, "orders").select(k.alias("id"), F.array_join(errors, ",").alias("errors"))


# sources and sinks


@query("src1_csv_scan", P + "SELECT source_id, concat(name, chr(10), '\"', category, '\", ') AS name, primary_type, CASE WHEN id % 6 = 0 THEN NULL ELSE city END AS city FROM places")
def src1(spark, sf):
    """Written as CSV with line breaks, quotes, blanks and empty values, and read again."""
    p = _p(spark, sf).select("source_id", F.concat("name", F.lit('\n"'), "category", F.lit('", ')).alias("name"), "primary_type", F.when(F.col("id") % 6 != 0, F.col("city")).alias("city"), F.col("lat").alias("latitude"), F.col("lng").alias("longitude"), "rating", F.lit(None).cast("string").alias("opening_hours"))
    sinks.csv(p, path := scratch.folder(spark, "csv"))
    return readers.csv(spark, path, readers.PLACES).select("source_id", "name", "primary_type", "city")


@query("src2_exact_ids", P + "SELECT concat('18000000000000', lpad(CAST(id AS VARCHAR), 6, '0')) AS source_id, lat AS latitude, lng AS longitude, rating FROM places")
def src2(spark, sf):
    """Ids of twenty digits stay text and doubles keep every bit through CSV."""
    p = _p(spark, sf).select(F.concat(F.lit("18000000000000"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("source_id"), "name", "primary_type", "city", F.col("lat").alias("latitude"), F.col("lng").alias("longitude"), "rating", F.lit(None).cast("string").alias("opening_hours"))
    sinks.csv(p, path := scratch.folder(spark, "csv"))
    return readers.csv(spark, path, readers.PLACES).select("source_id", "latitude", "longitude", "rating")


@query("src6_matrix", "SELECT CAST(vec_id AS VARCHAR) AS place_id, round(embedding[1]::DOUBLE, 6) AS first_value, round(embedding[64]::DOUBLE, 6) AS last_value FROM embeddings")
def src6(spark, sf):
    """Vectors packed as .npy files, one for each label, read back with the ids of their rows."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import io

        out = io.BytesIO()
        np.save(out, np.stack(pdf.sort_values("vec_id").embedding.to_numpy()).astype("float32"))
        return pd.DataFrame({"path": [f"m{pdf.label.iloc[0]}.npy"], "content": [out.getvalue()]})

    e = table(spark, sf, "embeddings")
    files = e.select("vec_id", "label", "embedding").groupBy("label").applyInPandas(pack, "path string, content binary")
    row = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    ids = e.select(F.concat(F.lit("m"), "label", F.lit(".npy")).alias("path"), row.cast("long").alias("row"), F.col("vec_id").cast("string").alias("place_id"))
    return readers.matrix(files, ids).select("place_id", F.round(F.col("vector")[0].cast("double"), 6).alias("first_value"), F.round(F.col("vector")[63].cast("double"), 6).alias("last_value"))


@query("snk1_daily_partitions", "SELECT CAST(ts AS DATE) AS event_date, count(*) AS n, count(*) FILTER (WHERE CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM events)) AS rewritten FROM events GROUP BY 1")
def snk1(spark, sf):
    """Written by day; the first day is written again, marked, and replaces itself alone."""
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("event_date"), F.lit(0).alias("mark"))
    path = scratch.folder(spark, "days")
    sinks.parquet_by_day(e, path)
    first = e.agg(F.min("event_date")).first()[0]
    sinks.parquet_by_day(e.where(F.col("event_date") == F.lit(first)).withColumn("mark", F.lit(1)), path)
    return spark.read.parquet(path).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"), F.sum("mark").alias("rewritten"))


@query("snk3_bundle", P + "SELECT count(*) AS rows, count(DISTINCT id) AS keys, min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east, true AS files_match FROM places")
def snk3(spark, sf):
    """The manifest of a bundle, and whether the files have the digests that it lists."""
    path = scratch.folder(spark, "bundle")
    m = sinks.bundle(_p(spark, sf), path)
    checked = sinks.changed_files(spark, path).agg((F.count(F.lit(1)) == 0).alias("files_match"))
    return checked.select(*[F.lit(m[k]).alias(k) for k in ("rows", "keys", "south", "north", "west", "east")], "files_match")


@query("snk4_batch_requests", P + "SELECT count(*) AS n, count(DISTINCT id) AS n_ids, 'POST' AS methods, 'small-1' AS models FROM places")
def snk4(spark, sf):
    r = _p(spark, sf).select(F.concat(F.lit("location_"), "id", F.lit("_x")).alias("custom_id"), F.col("name").alias("text"))
    sinks.batch_requests(r, path := scratch.folder(spark, "requests"), "small-1")
    return sinks.check_requests(spark.read.json(path)).select("n", "n_ids", F.array_join("methods", ",").alias("methods"), F.array_join("models", ",").alias("models"))


# streams, run over all that is there


_BATCHED = """b AS (SELECT *, CASE WHEN (event_id // 600) % 2 = 0 THEN concat('s', event_id // 200) ELSE concat('l', event_id // 600) END AS batch FROM events), c AS (SELECT *, count(*) OVER (PARTITION BY batch) > 500 AS refused FROM b)"""


def _batches(spark, sf):
    """Files of batches as text: of two hundred events, and of six hundred, which are too many."""
    e = table(spark, sf, "events")
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    kind = F.when(F.col("event_id") % 17 == 0, "Not A Type").otherwise(F.col("event_type"))
    event = F.to_json(F.struct(F.when(F.col("event_id") % 19 == 0, F.lit("x")).otherwise(uuid).alias("event_id"), kind.alias("event_type"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("client_ts")))
    k = F.floor(F.col("event_id") / 600)
    batch = F.when(k % 2 == 0, F.concat(F.lit("s"), F.floor(F.col("event_id") / 200))).otherwise(F.concat(F.lit("l"), k))
    lines = e.groupBy(batch.alias("b")).agg(F.array_join(F.collect_list(event), ",").alias("a")).select(F.concat(F.lit('{"batch_id":"'), "b", F.lit('","events":['), "a", F.lit("]}")).alias("value"))
    lines.write.text(path := scratch.folder(spark, "batches"))
    return intake.json_lines(spark, path)


@query("stm1_batch_intake", f"WITH {_BATCHED}, r AS (SELECT CASE WHEN refused THEN 'too_many_events' WHEN event_id % 19 = 0 THEN 'bad_event_id' WHEN event_id % 17 = 0 THEN 'bad_event_type' ELSE 'accepted' END AS outcome, batch, refused FROM c) SELECT outcome, CASE WHEN outcome = 'too_many_events' THEN count(DISTINCT batch) ELSE count(*) END AS n FROM r GROUP BY outcome")
def stm1(spark, sf):
    """Batches as a stream: one that is too large goes as a whole, a bad event alone."""
    out = intake.batch_events(_batches(spark, sf)).select(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))
    return intake.to_end(out, scratch.folder(spark, "intake")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("stm3_arrival_time", f"WITH {_BATCHED} SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS event, CAST(date_trunc('second', ts) AS VARCHAR) AS client_ts, true AS stamped FROM c WHERE NOT refused AND event_id % 19 <> 0 AND event_id % 17 <> 0")
def stm3(spark, sf):
    """Accepted events keep the device's time and get the time of their arrival, which is later."""
    e = intake.batch_events(_batches(spark, sf)).where("reject_reason is null").withColumn("server_ts", F.current_timestamp())
    out = intake.to_end(e.select("event_id", "client_ts", "server_ts"), scratch.folder(spark, "intake"))
    at = F.to_timestamp("client_ts")
    return out.select(F.substring("event_id", 25, 12).alias("event"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("client_ts"), (F.col("server_ts") > at).alias("stamped"))


@query("stm5_late_flush", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stm5(spark, sf):
    """Two deliveries: the second holds what devices kept back for up to a day. Within the floor of two days nothing is lost."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    path = scratch.folder(spark, "late")
    e.where("event_id % 3 <> 0").write.parquet(path)
    e.where("event_id % 3 = 0").write.mode("append").parquet(path)
    counts = intake.windowed_counts(spark.readStream.schema(e.schema).parquet(path), "ts", "1 hour", late="36500 days")
    return intake.to_end(counts, scratch.folder(spark, "windows"), "complete")


_ACTED = "l AS (SELECT event_id, event_type, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS place_id, ts FROM events)"


@query("stm4_actions_stream", f"WITH {_ACTED} SELECT a.event_id AS impression, b.event_id AS action FROM l a LEFT JOIN l b ON a.user_id = b.user_id AND a.place_id = b.place_id AND b.event_type <> 'view' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 5 DAY WHERE a.event_type = 'view'")
def stm4_stream(spark, sf):
    """Impressions and what followed within five days, as a join of two streams. A last event a year later closes what is open."""
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", (F.get_json_object("props", "$.k").cast("long") % 5).alias("place_id"), F.col("ts").cast("timestamp").alias("ts"))
    path, views, others = scratch.folder(spark, "acts"), e.where("event_type = 'view'"), e.where("event_type <> 'view'")
    last = e.agg(F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("string").alias("event_type"), F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("place_id"), (F.max("ts") + F.expr("interval 1 year")).alias("ts"))
    streams = []
    for name, own in (("views", views), ("others", others)):
        parts = [own.where("user_id % 2 = 0"), own.where("user_id % 2 = 1"), last.select(own.columns)]  # three deliveries, the last to close
        for k, part in enumerate(parts):
            part.write.mode("append").parquet(f"{path}/{name}/{k}")
        streams.append(spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1000).parquet(f"{path}/{name}/*"))
    out = intake.to_end(intake.actions_joined(*streams, ["user_id", "place_id"], "5 days", "60 days"), scratch.folder(spark, "joined"))
    return out.where("impression >= 0").select("impression", "action")


@query("stm6_identity_stream", "WITH e AS (SELECT event_id, 'a' || (event_id % 400) AS anon_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS user_id, ts AS server_ts FROM events), l AS (SELECT anon_id, user_id, min(server_ts) AS linked_at FROM e WHERE user_id IS NOT NULL GROUP BY anon_id, user_id), m AS (SELECT anon_id, user_id AS linked FROM (SELECT *, row_number() OVER (PARTITION BY anon_id ORDER BY linked_at DESC, user_id DESC) AS rn FROM l) WHERE rn = 1) SELECT event_id, coalesce(user_id, linked) AS user_id FROM e LEFT JOIN m USING (anon_id)")
def stm6_stream(spark, sf):
    """The links of the log by a stream of four deliveries, which are not in the order of time."""
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("a"), F.col("event_id") % 400).alias("anon_id"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("user_id"), F.col("ts").cast("timestamp").alias("server_ts"))
    path = scratch.folder(spark, "told")
    for k in (2, 0, 3, 1):
        e.where(F.floor(F.col("event_id") / 7) % 4 == k).coalesce(1).write.parquet(f"{path}/{k}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    with keyed_state(spark):
        told = intake.to_end(stitched_stream(stream), scratch.folder(spark, "stitched"))
    return last_told(told).select(F.col("event_id").cast("long").alias("event_id"), "user_id")


@query("stm2_event_store", "SELECT 'e' || event_id AS event_id, CASE WHEN event_id % 3 <> 0 THEN 1 WHEN event_id % 2 = 0 THEN 2 ELSE 3 END AS delivery, event_type FROM events UNION ALL SELECT 'counts', d, a || ' ' || i FROM (SELECT 1 AS d, count(*) FILTER (event_id % 3 <> 0) AS a, count(*) FILTER (event_id % 3 <> 0) AS i FROM events UNION ALL SELECT 2, count(*) FILTER (event_id % 2 = 0), count(*) FILTER (event_id % 6 = 0) FROM events UNION ALL SELECT 3, 2 * count(*), count(*) FILTER (event_id % 6 = 3) FROM events)")
def stm2_store(spark, sf):
    """Three deliveries over two years into one store: the second resends half of the log after 400 days, the third all of it, twice."""
    e = table(spark, sf, "events").select(F.concat(F.lit("e"), F.col("event_id")).alias("event_id"), "event_id", "event_type", F.col("ts").cast("timestamp").alias("server_ts")).toDF("event_id", "n", "event_type", "server_ts")
    late = lambda days, k: e.withColumns({"server_ts": F.col("server_ts") + F.expr(f"interval {days} days"), "delivery": F.lit(k)})
    store = EventStore(spark, scratch.folder(spark, "events"))
    third = late(700, 3)
    done = [store.append(d) for d in (late(0, 1).where("n % 3 <> 0"), late(400, 2).where("n % 2 = 0"), third.unionByName(third))]
    counts = spark.createDataFrame([("counts", k, f"{c['accepted']} {c['inserted']}") for k, c in enumerate(done, 1)], "event_id string, delivery int, event_type string")
    return spark.read.parquet(store.path).select("event_id", "delivery", "event_type").unionByName(counts)


@query("stm10_rate_limit", "WITH k AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts) AS rn FROM events) SELECT CAST(user_id AS VARCHAR) AS key, date_trunc('second', ts) AS ts, rn <= 3 AS allowed FROM k")
def stm10(spark, sf):
    """Three events of a user in a day's window, by the stateful limiter."""
    return _limited(spark, sf, [Rule(3, 86_400, sliding=False)])


def _limited(spark, sf, rules):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(path := scratch.folder(spark, "hits"))
    with keyed_state(spark):
        out = intake.to_end(limited(spark.readStream.schema(e.schema).parquet(path), rules), scratch.folder(spark, "limited"))
    return out.withColumn("ts", F.date_trunc("second", "ts"))


@query(
    "stm10_sliding_limits",
    """WITH RECURSIVE k AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
r AS (SELECT user_id, 0 AS rn, CAST(NULL AS TIMESTAMP) AS ts, false AS allowed, CAST([] AS TIMESTAMP[]) AS held FROM (SELECT DISTINCT user_id FROM k)
UNION ALL SELECT user_id, rn, ts, ok, CASE WHEN ok THEN list_append(held, ts) ELSE held END FROM (SELECT k.user_id, k.rn, k.ts, r.held, len(list_filter(held, lambda x: x > k.ts - INTERVAL 3 HOUR)) < 1 AND len(list_filter(held, lambda x: x > k.ts - INTERVAL 48 HOUR)) < 3 AS ok FROM r JOIN k ON k.user_id = r.user_id AND k.rn = r.rn + 1))
SELECT CAST(user_id AS VARCHAR) AS key, date_trunc('second', ts) AS ts, allowed FROM r WHERE rn > 0""",
)
def stm10_sliding(spark, sf):
    """One event of a user in three hours and three in two days, both windows sliding."""
    return _limited(spark, sf, [Rule(1, 3 * 3600), Rule(3, 48 * 3600)])
