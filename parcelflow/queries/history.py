"""Sightings of one flat over time: events, summaries, delisting and snapshot merge."""

import uuid

from pyspark.sql import functions as F

from parcelflow.plans import cycles, history, state
from parcelflow.queries.proxy import AS_OF, listings, table, with_listings
from parcelflow.queries.registry import R, query
from parcelflow.sources.storage import materialise, shared_dir

_NOW = f"{AS_OF} 00:00:00"
_KEY = "concat_ws('/', deal_type, district, rooms, CAST(area_m2 AS INT))"


def sightings(spark, sf_dir):
    """A flat is a (deal type, district, rooms, area) cell; its rows are sightings."""
    return listings(spark, sf_dir).withColumn("listing_key", F.expr(_KEY))


_SEEN = f""", seen AS (SELECT *, concat_ws('/', deal_type, district, rooms, CAST(area_m2 AS INTEGER)) AS listing_key FROM listings),
  linked AS (
    SELECT *, lag(seen_at) OVER w AS was_seen, lag(price_usd) OVER w AS was_price, row_number() OVER w AS nth
    FROM seen WINDOW w AS (PARTITION BY listing_key ORDER BY seen_at, id)),
  gaps AS (SELECT *, CAST(floor(date_diff('second', was_seen, seen_at) / 86400) AS INTEGER) AS gap FROM linked),
  events AS (
    SELECT listing_key, 'first_seen' AS event_type, NULL::DOUBLE AS old_price_usd, price_usd AS new_price_usd, NULL AS old_status,
      'active' AS new_status, NULL::INTEGER AS gap_days, seen_at AS "at" FROM gaps WHERE nth = 1
    UNION ALL SELECT listing_key, 'relisted', NULL, NULL, 'active', 'active', gap, seen_at FROM gaps WHERE gap >= 3
    UNION ALL SELECT listing_key, 'price_changed', was_price, price_usd, NULL, NULL, NULL, seen_at FROM gaps
      WHERE was_price > 0 AND price_usd < was_price AND (was_price - price_usd) / was_price > 0.01),
  last AS (
    SELECT listing_key, max(seen_at) AS seen_at, arg_max(price_usd, (seen_at, id)) AS price_usd, min(created_at) AS created_at
    FROM seen GROUP BY listing_key),
  gone AS (SELECT listing_key, TIMESTAMP '{_NOW}' AS "at" FROM last WHERE seen_at < TIMESTAMP '{_NOW}' - INTERVAL 3 DAY)"""


def _events(rows):
    # the columns that events are made of: what else a sighting holds is neither dealt nor written
    return history.listing_events(history.sightings_with_previous(rows.select("listing_key", "id", "seen_at", "price_usd")))


def _last(rows):
    order = F.struct("seen_at", "id")
    return rows.groupBy("listing_key").agg(
        F.max("seen_at").alias("seen_at"), F.max_by("price_usd", order).alias("price_usd"), F.min("created_at").alias("created_at"))


def _settled(df):
    return df.withColumns({c: F.round(c, 6) for c in ("old_price_usd", "new_price_usd") if c in df.columns})


@query("listing_events", with_listings(_SEEN + f""" SELECT listing_key, event_type, {R('old_price_usd', 6)} AS old_price_usd,
  {R('new_price_usd', 6)} AS new_price_usd, old_status, new_status, gap_days, "at" FROM events"""))
def listing_events(spark, sf_dir):
    return _settled(_events(sightings(spark, sf_dir)))


@query("price_drops", with_listings(_SEEN + f""" SELECT listing_key, "at", {R('old_price_usd', 6)} AS old_price_usd,
  {R('new_price_usd', 6)} AS new_price_usd FROM events WHERE event_type = 'price_changed'"""))
def price_drops(spark, sf_dir):
    e = _events(sightings(spark, sf_dir)).where("event_type = 'price_changed'")
    return _settled(e.select("listing_key", "at", "old_price_usd", "new_price_usd"))


@query("relist_gaps", with_listings(_SEEN + ' SELECT listing_key, "at", gap_days FROM events WHERE event_type = \'relisted\''))
def relist_gaps(spark, sf_dir):
    return _events(sightings(spark, sf_dir)).where("event_type = 'relisted'").select("listing_key", "at", "gap_days")


@query("purge_noise_events", with_listings(_SEEN + """ SELECT event_type, count(*) AS kept FROM events
  WHERE NOT (event_type = 'price_changed' AND (new_price_usd >= old_price_usd
    OR old_price_usd - new_price_usd <= old_price_usd * 0.05)) GROUP BY event_type"""))
def purge_noise_events(spark, sf_dir):
    return history.without_noise(_events(sightings(spark, sf_dir)), 0.05).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@query("history_summary", with_listings(_SEEN + f""", sums AS (
    SELECT listing_key, min("at") FILTER (event_type = 'first_seen') AS first_at,
      arg_min(new_price_usd, "at") FILTER (event_type = 'first_seen') AS first_price,
      count(*) FILTER (event_type = 'price_changed') AS price_change_count,
      count(*) FILTER (event_type = 'relisted') AS relisted_count, max("at") FILTER (event_type = 'relisted') AS last_relisted_at
    FROM events GROUP BY listing_key),
  h AS (
    SELECT l.listing_key, coalesce(first_at, created_at) AS first_seen_at, first_price, price_usd, price_change_count,
      relisted_count, last_relisted_at, g."at" AS last_delisted_at,
      CASE WHEN first_price > 0 THEN (price_usd - first_price) / first_price * 100 END AS change
    FROM last l JOIN sums USING (listing_key) LEFT JOIN gone g USING (listing_key))
  SELECT listing_key, first_seen_at, {R('first_price', 6)} AS first_price_usd, {R('price_usd', 6)} AS current_price_usd,
    {R('change', 6)} AS total_price_change_percent, price_change_count, relisted_count, last_relisted_at, last_delisted_at,
    CASE WHEN relisted_count > 0 AND change <= -5 THEN 'ready_to_bargain' WHEN relisted_count > 0 THEN 'relisted'
      WHEN change <= -5 THEN 'price_falling' END AS verdict FROM h"""))
def history_summary(spark, sf_dir):
    rows = materialise(sightings(spark, sf_dir).select("listing_key", "id", "seen_at", "price_usd", "created_at"), "sightings")
    last = materialise(_last(rows), "last-sightings")
    _, gone = history.delist(last.select(F.col("listing_key").alias("id"), "price_usd", "seen_at", F.lit("active").alias("status")), _NOW)
    current = last.select("listing_key", F.col("price_usd").alias("current_price_usd"), "created_at")
    out = history.history_summary(_events(rows).unionByName(gone), current)
    return out.withColumns({
        "verdict": history.history_verdict(F.col("total_price_change_percent"), F.col("relisted_count")),
        **{c: F.round(c, 6) for c in ("first_price_usd", "current_price_usd", "total_price_change_percent")}})


@query("delist", with_listings(f"""SELECT id, source, CASE WHEN seen_at < TIMESTAMP '{_NOW}' - INTERVAL 3 DAY THEN 'removed' ELSE status END AS status
  FROM listings WHERE status = 'active'"""))
def delist(spark, sf_dir):
    active = listings(spark, sf_dir).where("status = 'active'")
    marked, _ = history.delist(active, _NOW)
    return marked.select("id", "source", "status")


@query("delist_events", with_listings(f"""SELECT id AS listing_key, {R('price_usd', 6)} AS old_price_usd FROM listings
  WHERE status = 'active' AND source = '2-HIGH' AND deal_type = 'rent' AND seen_at < TIMESTAMP '{_NOW}' - INTERVAL 3 DAY"""))
def delist_events(spark, sf_dir):
    _, gone = history.delist(listings(spark, sf_dir), _NOW, scope={"source": "2-HIGH", "deal_type": "rent"})
    return _settled(gone.select("listing_key", "old_price_usd"))


_SPLIT = "1999-01-01 00:00:00"
_UP_NOW = "1999-01-02 00:00:00"


def _sides(spark, sf_dir):
    """Latest sighting of each flat before and from the split date, found in one pass and written once."""
    cut = F.expr(f"TIMESTAMP_NTZ '{_SPLIT}'")
    cols = ["id", "price_usd", "price_per_m2_usd", "seen_at", "source", "district", "rooms", "area_m2", "floor", "deal_type"]
    row, order = F.struct(*cols), F.struct("seen_at", "id")
    return materialise(sightings(spark, sf_dir).groupBy("listing_key").agg(
        F.max_by(row, F.when(F.col("seen_at") < cut, order)).alias("before"),
        F.max_by(row, F.when(F.col("seen_at") >= cut, order)).alias("after")), "latest-sightings")


def _as_rows(sides, side: str):
    """One side's sightings, shaped as snapshot rows."""
    rows = sides.select("listing_key", F.col(side).alias("r")).where("r IS NOT NULL")
    none = F.lit(None)
    return rows.select(
        F.col("r.*"), F.col("listing_key").alias("source_id")
    ).withColumns({
        "id": F.col("source_id"), "source": F.lit("board"), "currency": F.lit("USD"), "price": F.col("price_usd"),
        "duplicate_group_key": F.sha1("source_id"), "published_at": F.col("seen_at"),
        "lat": none.cast("double"), "lng": none.cast("double"), "coords_precision": none.cast("string"),
        "total_floors": F.lit(50), "status": F.lit("active"),
    })


_UPSERT = _SEEN + f""", old AS (SELECT listing_key, arg_max(price_usd, (seen_at, id)) AS price, arg_max(floor, (seen_at, id)) AS floor,
    max(seen_at) AS seen FROM seen WHERE seen_at < TIMESTAMP '{_SPLIT}' GROUP BY listing_key),
  new AS (SELECT listing_key, arg_max(price_usd, (seen_at, id)) AS price, arg_max(floor, (seen_at, id)) AS floor
    FROM seen WHERE seen_at >= TIMESTAMP '{_SPLIT}' GROUP BY listing_key),
  m AS (SELECT coalesce(o.listing_key, n.listing_key) AS id, o.price AS was, n.price AS price, o.seen, o.floor AS ofl, n.floor AS nfl,
    o.listing_key IS NULL AS is_new, n.listing_key IS NOT NULL AS touched FROM old o FULL JOIN new n ON o.listing_key = n.listing_key)"""


def _upsert(spark, sf_dir):
    rows = _sides(spark, sf_dir)
    stored, incoming = _as_rows(rows, "before"), _as_rows(rows, "after").drop("status", "seen_at")
    # Flats are told apart by key alone here, so the tolerant match has no candidates to offer.
    stored = stored.withColumn("district", F.col("source_id"))
    incoming = incoming.withColumn("district", F.col("source_id"))
    return state.upsert(stored, incoming, _UP_NOW)


@query("upsert_snapshot", with_listings(_UPSERT + f""" SELECT id, {R('coalesce(price, was)', 6)} AS price_usd, coalesce(nfl, ofl) AS floor,
  CASE WHEN touched THEN TIMESTAMP '{_UP_NOW}' ELSE seen END AS seen_at, 'active' AS status FROM m"""))
def upsert_snapshot(spark, sf_dir):
    snapshot, _ = _upsert(spark, sf_dir)
    return snapshot.select("id", F.round("price_usd", 6).alias("price_usd"), "floor", "seen_at", "status")


@query("upsert_events", with_listings(_UPSERT + f""" SELECT id AS listing_id, unnest(list_filter([
    CASE WHEN is_new THEN 'first_seen' END,
    CASE WHEN NOT is_new AND floor(date_diff('second', seen, TIMESTAMP '{_UP_NOW}') / 86400) >= 3 THEN 'relisted' END,
    CASE WHEN price < was AND (was - price) / was > 0.01 THEN 'price_changed' END], lambda x: x IS NOT NULL)) AS event_type
  FROM m WHERE touched"""))
def upsert_events(spark, sf_dir):
    _, events = _upsert(spark, sf_dir)
    return events.select("listing_id", "event_type")


# Two cycles: flats whose latest floor is even come first, the others a day later; implausible ones are refused.
_CYCLES = _SEEN + f""", old AS (SELECT listing_key AS id, arg_max(price_usd, (seen_at, id)) AS price, max(seen_at) AS seen
    FROM seen WHERE seen_at < TIMESTAMP '{_SPLIT}' GROUP BY listing_key),
  new AS (SELECT listing_key AS id, arg_max(price_usd, (seen_at, id)) AS price, arg_max(price_per_m2_usd, (seen_at, id)) AS ppm,
      arg_max(deal_type, (seen_at, id)) AS deal, 1 + arg_max(floor, (seen_at, id)) % 2 AS cycle
    FROM seen WHERE seen_at >= TIMESTAMP '{_SPLIT}' GROUP BY listing_key),
  judged AS (SELECT *, price >= CASE WHEN deal = 'rent' THEN 50 ELSE 5000 END
      AND ppm >= CASE WHEN deal = 'rent' THEN 0.3 ELSE 100 END AS ok FROM new),
  kept AS (SELECT * FROM judged WHERE ok)"""


def _cycled(spark, sf_dir):
    """Both cycles, each of them tried again after it was committed; returns their folder."""
    rows = _sides(spark, sf_dir)
    unseen = {"seller_id": F.col("source_id"), "is_business": F.lit(None).cast("boolean"), "seller_type": F.lit(None).cast("string"),
              "district": F.col("source_id")}
    stored, incoming = _as_rows(rows, "before").withColumns(unseen), _as_rows(rows, "after").drop("status", "seen_at").withColumns(unseen)
    incoming = materialise(incoming, "cycle-incoming")
    out = f"{shared_dir(spark)}/cycles-{uuid.uuid4().hex}"
    cycles.begin(stored, out)
    first, second = incoming.where("floor % 2 = 0"), incoming.where("floor % 2 = 1")
    for batch, as_of, cycle in ((first, _UP_NOW, 1), (first, _UP_NOW, 1), (second, _CYCLE_NOW, 2), (first, _UP_NOW, 1)):
        cycles.run_cycle(batch, as_of, cycle, out)
    return out


_CYCLE_NOW = "1999-01-03 00:00:00"


@query("ingest_cycles", with_listings(_CYCLES + f""" SELECT id, {R('coalesce(k.price, o.price)', 6)} AS price_usd,
    CASE WHEN k.id IS NULL AND seen < TIMESTAMP '{_CYCLE_NOW}' - INTERVAL 3 DAY THEN 'removed' ELSE 'active' END AS status
  FROM old o FULL JOIN kept k USING (id)"""))
def ingest_cycles(spark, sf_dir):
    """The listings after two cycles."""
    return cycles.current_listings(spark, _cycled(spark, sf_dir)).select("id", F.round("price_usd", 6).alias("price_usd"), "status")


@query("ingest_cycle_runs", with_listings(_CYCLES + """ SELECT CAST(cycle AS INTEGER) AS cycle, 'board' AS source, count(*) FILTER (ok) AS found,
    count(*) FILTER (ok AND id NOT IN (SELECT id FROM old)) AS new_count, count(*) FILTER (NOT ok) AS rejected, 'success' AS status
  FROM judged GROUP BY cycle"""))
def ingest_cycle_runs(spark, sf_dir):
    """One run a cycle and source, however often a cycle was tried."""
    return cycles.log(spark, _cycled(spark, sf_dir), "runs").drop("finished_at")


@query("probe_sweep", with_listings(f""", probes AS (
    SELECT id, is_business AS gone, CASE WHEN rooms % 2 = 0 THEN price_usd * (1 - commission_pct / 100) END AS usd FROM listings),
  j AS (SELECT l.*, p.gone, p.usd, p.gone AND status = 'active' AS drops,
      NOT p.gone AND usd > 0 AND abs(price_usd - usd) / price_usd >= 0.01 AS fixes FROM listings l JOIN probes p USING (id))
  SELECT id, CASE WHEN drops THEN 'removed' ELSE status END AS status, {R('CASE WHEN fixes THEN usd ELSE price_usd END', 6)} AS price_usd,
    CASE WHEN drops THEN 'delisted' WHEN fixes AND usd < price_usd AND (price_usd - usd) / price_usd > 0.01 THEN 'price_changed' END AS event_type
  FROM j"""))
def probe_sweep(spark, sf_dir):
    """K9: the return flag stands for an archived page, the tax for a price correction."""
    rows = listings(spark, sf_dir).withColumns({
        "url": F.col("id"), "photos": F.array().cast("array<string>"), "price": F.col("price_usd"), "currency": F.lit("UZS")})
    probes = rows.select(
        "url", F.col("is_business").alias("is_gone"), F.array(F.lit("p.jpg")).alias("photos"),
        F.when(F.col("rooms") % 2 == 0, F.col("price_usd") * (1 - F.col("commission_pct") / 100)).alias("usd_price"),
        F.lit(None).cast("int").alias("floor"), F.lit(None).cast("int").alias("total_floors"))
    marked, events = state.apply_probes(rows, probes, _NOW)
    return marked.select("id", "status", F.round("price_usd", 6).alias("price_usd")).join(
        events.select(F.col("listing_id").alias("id"), "event_type"), "id", "left")


# One scene per customer, in a district of its own; the scene's number says which branch of the upsert it is for:
# 0 known and cheaper, 1 known and back after removal, 2 a dearer repost with a floor, 3 a cheaper repost, 4 the same flat
# without fingerprint, 5 another floor of it, 6 a search-page repost of a confirmed price, 7 two new rows of one flat,
# 8 two new rows without fingerprint in two districts, 9 untouched.  Coordinates: 0 an exact point meets an approximate one, 2 the other
# way round, 3 none meets an approximate one, 4 two approximate ones, 7 a new listing brings one.
_OLD = "TIMESTAMP_NTZ '1998-12-30 00:00:00'"


def _scenes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING) AS k", "c_custkey % 10 AS scene", "50000D + c_custkey % 1000 AS p")
    shared = ["'sale' AS deal_type", "CAST(2 AS BIGINT) AS rooms", "60D AS area_m2", "9 AS total_floors"]

    def point(value, exact, approx):
        """Coordinates of the scenes that have some."""
        return [f"IF(scene IN ({exact}, {approx}), {value}D, NULL) AS {c}" for c in ("lat", "lng")] + [
            f"CASE WHEN scene IN ({exact}) THEN 'exact' WHEN scene IN ({approx}) THEN 'approx' END AS coords_precision"]

    stored = c.where("scene NOT IN (7, 8)").selectExpr(
        "concat('s', k) AS id", "IF(scene = 6, 'offer_page', 'board') AS source", "concat('a', k) AS source_id", "concat('u', k) AS url", "'old' AS title",
        "concat('d', k) AS district", "p AS price_usd", "p AS price", "'USD' AS currency", "p / 60 AS price_per_m2_usd",
        "IF(scene IN (2, 9), NULL, 3) AS floor", "concat('f', k) AS duplicate_group_key", "IF(scene = 1, 'removed', 'active') AS status",
        f"{_OLD} AS seen_at", *shared, *point(41, "0", "2, 4"))
    incoming = c.where("scene < 9").selectExpr("k", "scene", "p", "explode(sequence(1, IF(scene IN (7, 8), 2, 1))) AS i").selectExpr(
        "concat('n', k, '-', i) AS id", "IF(scene = 6, 'offer_page', 'board') AS source",
        "IF(scene < 2, concat('a', k), concat('b', k, '-', i)) AS source_id", "concat('v', k, '-', i) AS url", "'new' AS title",
        "concat('d', k, IF(scene = 8, concat('-', i), '')) AS district",
        """CASE scene WHEN 0 THEN p * 0.95D WHEN 2 THEN p * 1.01D WHEN 3 THEN p * 0.97D WHEN 4 THEN p * 0.98D WHEN 6 THEN p * 0.9D WHEN 7 THEN p * (1 + i / 100D)
          ELSE p END AS price_usd""", "IF(scene = 6, 'UZS', 'USD') AS currency", "CASE scene WHEN 5 THEN 4 WHEN 8 THEN NULL ELSE 3 END AS floor",
        "CASE WHEN scene IN (2, 3, 6) THEN concat('f', k) WHEN scene <> 8 THEN concat('g', k, '-', i) END AS duplicate_group_key",
        f"{_OLD} AS published_at", *shared, *point(42, "2", "0, 3, 4, 7")).selectExpr("*", "price_usd AS price", "price_usd / area_m2 AS price_per_m2_usd")
    return stored, incoming


_SCENES = f""", c AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_custkey % 10 AS scene, 50000.0::DOUBLE + c_custkey % 1000 AS p FROM customer),
  was AS (SELECT * FROM c WHERE scene NOT IN (7, 8)),
  put AS (
    SELECT 's' || k AS id, scene, k, CASE WHEN scene IN (3, 4, 6) THEN 'b' || k || '-1' ELSE 'a' || k END AS source_id,
      CASE WHEN scene IN (0, 1, 3, 4, 6) THEN 'new' ELSE 'old' END AS title,
      CASE scene WHEN 0 THEN p * 0.95 WHEN 3 THEN p * 0.97 WHEN 4 THEN p * 0.98 ELSE p END AS price_usd,
      CASE WHEN scene = 9 THEN NULL ELSE 3 END AS floor, scene NOT IN (5, 9) AS touched, p, 'f' || k AS print,
      CASE WHEN scene = 0 THEN 41.0::DOUBLE WHEN scene IN (2, 3, 4) THEN 42.0::DOUBLE END AS lat,
      CASE WHEN scene IN (0, 2) THEN 'exact' WHEN scene IN (3, 4) THEN 'approx' END AS coords_precision FROM was
    UNION ALL SELECT 'n' || k || '-' || i, scene, k, 'b' || k || '-' || i, 'new', CASE scene WHEN 7 THEN p * (1 + i / 100.0::DOUBLE) ELSE p END,
      CASE scene WHEN 5 THEN 4 WHEN 7 THEN 3 END, true, p, CASE WHEN scene <> 8 THEN 'g' || k || '-' || i END,
      CASE WHEN scene = 7 THEN 42.0::DOUBLE END, CASE WHEN scene = 7 THEN 'approx' END FROM c, range(1, 3) t(i) WHERE (scene IN (5, 7) AND i = 1) OR scene = 8)"""


@query("upsert_branches", with_listings(_SCENES + f""" SELECT id, source_id, title, {R('price_usd', 4)} AS price_usd, 'USD' AS currency, floor, 'active' AS status,
  CASE WHEN touched THEN TIMESTAMP '{_UP_NOW}' ELSE TIMESTAMP '1998-12-30 00:00:00' END AS seen_at,
  CAST(CASE WHEN scene = 7 THEN 2 WHEN scene = 9 OR id[1] = 'n' OR scene = 5 THEN 1 ELSE 2 END AS INTEGER) AS duplicate_count,
  print AS duplicate_group_key, lat, lat AS lng, coords_precision FROM put"""))
def upsert_branches(spark, sf_dir):
    """K1 and K2 with rows for every branch, with the places each listing is offered at."""
    stored, incoming = _scenes(spark, sf_dir)
    routed = state.route(stored, incoming)
    snapshot, _ = state.upsert(stored, incoming, _UP_NOW, routed=routed)
    links = state.source_url_rows(stored.selectExpr("id AS listing_id", "source", "url"), routed)
    return state.with_duplicate_count(snapshot, links).select(
        "id", "source_id", "title", F.round("price_usd", 4).alias("price_usd"), "currency", "floor", "status", "seen_at", "duplicate_count",
        "duplicate_group_key", "lat", "lng", "coords_precision")


@query("upsert_branch_events", with_listings(_SCENES + f""" SELECT id AS listing_id, 'first_seen' AS event_type, NULL::DOUBLE AS old_price_usd,
    {R('price_usd', 4)} AS new_price_usd, NULL AS old_status, 'active' AS new_status FROM put WHERE id[1] = 'n'
  UNION ALL SELECT id, 'relisted', NULL, NULL, CASE WHEN scene = 1 THEN 'removed' ELSE 'active' END, 'active' FROM put WHERE id[1] = 's' AND touched
  UNION ALL SELECT id, 'price_changed', {R('p', 4)}, {R('price_usd', 4)}, NULL, NULL FROM put WHERE id[1] = 's' AND scene IN (0, 3, 4)"""))
def upsert_branch_events(spark, sf_dir):
    stored, incoming = _scenes(spark, sf_dir)
    _, events = state.upsert(stored, incoming, _UP_NOW)
    return events.select("listing_id", "event_type", *[F.round(c, 4).alias(c) for c in ("old_price_usd", "new_price_usd")], "old_status", "new_status")
