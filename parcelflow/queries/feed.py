"""Search, feed statistics, complexes, yields, sellers and hubs."""

from pyspark.sql import functions as F

from parcelflow.operators.predicates import sane_active
from parcelflow.operators.quantiles import grouped_median
from parcelflow.plans import complexes, hubs, search, sellers, state, yields
from parcelflow.plans.history import price_verdict
from parcelflow.queries.proxy import AS_OF, listings, table, with_listings
from parcelflow.queries.registry import MED, R, query
from parcelflow.sources.storage import materialise

_CARD = ["id", "source", "district", "rooms", "area_m2", "discount_percent"]
_CARD_SQL = f"id, source, district, rooms, area_m2, {R('discount_percent')} AS discount_percent"


def _card(df):
    return df.select(*_CARD).withColumn("discount_percent", F.round("discount_percent", 4))


@query("search_page", with_listings(f"""SELECT {_CARD_SQL} FROM sane
  WHERE deal_type = 'sale' AND district IN ('NATION_1', 'NATION_2', 'NATION_3') AND rooms = 2
    AND area_m2 BETWEEN 10 AND 45 AND price_usd <= 80000 AND floor >= 3
  ORDER BY discount_percent DESC NULLS LAST, id LIMIT 50 OFFSET 10"""))
def search_page(spark, sf_dir):
    f = search.Filters(districts=["NATION_1", "NATION_2", "NATION_3"], rooms=2,
                       bounds={"area_m2": (10, 45), "price_usd": (None, 80000), "floor": (3, None)})
    return _card(search.page(search.search(listings(spark, sf_dir), f), search.order_for("discount"), limit=50, offset=10))


@query("search_total", with_listings("""SELECT count(*) AS total FROM sane
  WHERE deal_type = 'sale' AND rooms = 2 AND price_per_m2_usd BETWEEN 500 AND 2500"""))
def search_total(spark, sf_dir):
    f = search.Filters(rooms=2, bounds={"price_per_m2_usd": (500, 2500)})
    return search.total(search.search(listings(spark, sf_dir), f))


@query("search_sorts", with_listings(f"""
  (SELECT 'price' AS sort, {_CARD_SQL} FROM sane WHERE deal_type = 'rent' ORDER BY price_usd NULLS LAST, id LIMIT 20)
  UNION ALL
  (SELECT 'price_per_m2', {_CARD_SQL} FROM sane WHERE deal_type = 'rent' ORDER BY price_per_m2_usd NULLS LAST, id LIMIT 20)
  UNION ALL
  (SELECT 'fresh', {_CARD_SQL} FROM sane WHERE deal_type = 'rent' ORDER BY seen_at DESC NULLS LAST, id DESC LIMIT 20)"""))
def search_sorts(spark, sf_dir):
    rows = search.search(listings(spark, sf_dir), search.Filters(deal_type="rent"))
    out = None
    for sort in ("price", "price_per_m2", "fresh"):
        part = _card(search.page(rows, search.order_for(sort), limit=20)).withColumn("sort", F.lit(sort))
        out = part if out is None else out.unionByName(part)
    return out


@query("search_keyset", with_listings(f"""SELECT {_CARD_SQL} FROM sane
  WHERE deal_type = 'sale' AND id > '5000' ORDER BY id LIMIT 100"""))
def search_keyset(spark, sf_dir):
    rows = search.search(listings(spark, sf_dir), search.Filters())
    return _card(search.page_after(rows, "5000", limit=100))


@query("search_keywords", with_listings(f"""SELECT {_CARD_SQL} FROM sane WHERE deal_type = 'sale'
  AND (title ILIKE '%RED%' OR description ILIKE '%RED%') AND (title ILIKE '%widget%' OR description ILIKE '%widget%')"""))
def search_keywords(spark, sf_dir):
    f = search.Filters(q="RED, widget")
    return _card(search.search(listings(spark, sf_dir), f, text_fields=["title", "description"]))


@query("search_exclude", with_listings(f"""SELECT {_CARD_SQL} FROM sane WHERE deal_type = 'sale'
  AND NOT (title ILIKE '%small%' OR coalesce(description, '') ILIKE '%small%')
  AND NOT (title ILIKE '%blue%' OR coalesce(description, '') ILIKE '%blue%') AND discount_percent >= 9"""))
def search_exclude(spark, sf_dir):
    f = search.Filters(exclude="small blue", discount_min=9)
    return _card(search.search(listings(spark, sf_dir), f, text_fields=["title", "description"]))


@query("search_documents", """SELECT doc_id, lang, source FROM documents
  WHERE text ILIKE '%the%' AND text ILIKE '%tion%' AND NOT (text ILIKE '%license%')""")
def search_documents(spark, sf_dir):
    """C4/C5 over the whole text of every document."""
    from parcelflow.operators.predicates import contains_words, excludes_words

    docs = table(spark, sf_dir, "documents")
    return docs.where(contains_words("the, tion", ["text"]) & excludes_words("license", ["text"])).select(
        "doc_id", "lang", "source")


@query("search_semi", with_listings(f"""SELECT {_CARD_SQL} FROM sane
  WHERE deal_type = 'sale' AND complex IN (SELECT DISTINCT p_brand FROM part WHERE p_brand ILIKE '%brand#1%')"""))
def search_semi(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_brand").alias("name")).distinct()
    rows = listings(spark, sf_dir).withColumn("residential_complex_id", F.col("complex"))
    return _card(search.search(rows, search.Filters(complex_name=" brand#1 "), complexes=names))


@query("search_owner", with_listings(f""", sellers AS (
    SELECT source, seller_id, CASE WHEN bool_or(is_business) OR count(*) >= 3 THEN 'agent' WHEN count(*) = 1 THEN 'owner'
      ELSE 'unknown' END AS seller_type FROM listings WHERE status = 'active' GROUP BY ALL)
  SELECT {_CARD_SQL}, seller_type FROM sane LEFT JOIN sellers USING (source, seller_id)
  WHERE deal_type = 'rent' AND (seller_type = 'owner' OR commission_pct = 0)"""))
def search_owner(spark, sf_dir):
    """C7 on freshly classified sellers."""
    rows = listings(spark, sf_dir)
    labelled = sellers.label_listings(rows, sellers.classify_sellers(rows))
    found = search.search(labelled, search.Filters(deal_type="rent", seller_type="owner"))
    return found.select(*_CARD, "seller_type").withColumn("discount_percent", F.round("discount_percent", 4))


@query("best_deals_top6", with_listings(
    f"SELECT {_CARD_SQL} FROM sane WHERE deal_type = 'sale' ORDER BY discount_percent DESC, id LIMIT 6"))
def best_deals_top6(spark, sf_dir):
    return _card(search.best_deals(search.search(listings(spark, sf_dir), search.Filters())))


@query("search_stats", with_listings(f"""SELECT count(*) AS total, count(*) FILTER (discount_percent >= 8) AS hot,
    count(*) FILTER (discount_percent >= 8 AND created_at >= DATE '2001-07-01') AS new_today,
    count(*) FILTER (discount_percent >= 8 AND created_at < DATE '2001-07-01' AND created_at >= DATE '2001-06-30') AS new_yesterday,
    count(DISTINCT district) AS districts FROM sane WHERE deal_type = 'sale'"""))
def search_stats(spark, sf_dir):
    return search.feed_totals(listings(spark, sf_dir), "2001-07-01 00:00:00", threshold=8)


@query("search_stats_sources", with_listings("""SELECT source, count(*) AS total,
    count(*) FILTER (discount_percent >= 8) AS hot FROM sane WHERE deal_type = 'sale' GROUP BY source"""))
def search_stats_sources(spark, sf_dir):
    return search.feed_by_source(listings(spark, sf_dir), threshold=8)


@query("district_options", "SELECT DISTINCT n_name AS district FROM lineitem JOIN supplier ON l_suppkey = s_suppkey "
       "JOIN nation ON s_nationkey = n_nationkey")
def district_options(spark, sf_dir):
    return search.district_options(listings(spark, sf_dir))


@query("complex_stats", with_listings(f"""SELECT complex, count(*) AS count, {R(MED('price_usd'), 2)} AS median_price_usd,
    {R(MED('price_per_m2_usd'), 2)} AS median_price_per_m2_usd, {R('min(price_usd)', 2)} AS min_price_usd
  FROM sane WHERE deal_type = 'sale' GROUP BY complex HAVING count(*) >= 5"""))
def complex_stats(spark, sf_dir):
    return complexes.complex_stats(listings(spark, sf_dir)).orderBy(*complexes.complex_order())


@query("complex_compare", with_listings(f""", m AS (
    SELECT complex, count(*) AS n, {R(MED('price_per_m2_usd'), 2)} AS med FROM sane WHERE deal_type = 'sale'
    GROUP BY complex HAVING count(*) >= 5),
  v AS (SELECT id, complex, n, med, {R('(1 - price_per_m2_usd / med) * 100', 1)} AS vs
        FROM sane LEFT JOIN m USING (complex) WHERE deal_type = 'sale')
  SELECT id, complex, n AS complex_count, med AS complex_median_ppm, vs AS vs_complex_percent,
    coalesce(vs >= 15, false) AS is_below_complex FROM v"""))
def complex_compare(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return complexes.compare_with_complex(rows.where(sane_active("sale")), rows).select(
        "id", "complex", "complex_count", "complex_median_ppm", "vs_complex_percent", "is_below_complex")


@query("complex_rooms", with_listings(f"""SELECT complex, rooms, count(*) AS count, {R(MED('price_usd'), 2)} AS median_price
  FROM sane WHERE deal_type = 'sale' AND rooms BETWEEN 1 AND 5 GROUP BY complex, rooms"""))
def complex_rooms(spark, sf_dir):
    return complexes.complex_rooms(listings(spark, sf_dir))


_RENT = f""", rents AS (SELECT * FROM sane WHERE deal_type = 'rent'),
  c AS (SELECT complex, rooms, {R(MED('price_per_m2_usd'), 3)} AS med, count(*) AS n FROM rents GROUP BY ALL HAVING count(*) >= 5),
  d AS (SELECT district, rooms, {R(MED('price_per_m2_usd'), 3)} AS med, count(*) AS n FROM rents GROUP BY ALL HAVING count(*) >= 5)"""


@query("rent_medians", with_listings(_RENT + """ SELECT 'complex' AS level, complex AS place, rooms, n, med AS median FROM c
  UNION ALL SELECT 'district', district, rooms, n, med FROM d"""))
def rent_medians(spark, sf_dir):
    return yields.rent_medians(listings(spark, sf_dir))


@query("rental_yield", with_listings(_RENT + f""", j AS (
    SELECT s.id, s.price_per_m2_usd AS ppm, coalesce(c.med, d.med) AS rent, coalesce(c.n, d.n) AS n,
      CASE WHEN c.med IS NOT NULL THEN 'complex' ELSE 'district' END AS basis
    FROM sane s LEFT JOIN c ON s.complex = c.complex AND s.rooms = c.rooms
      LEFT JOIN d ON s.district = d.district AND s.rooms = d.rooms WHERE s.deal_type = 'sale'),
  g AS (SELECT *, rent * 12 / ppm * 100 AS gross FROM j)
  SELECT id, {R('gross', 1)} AS gross_yield_percent, {R('100 / gross', 1)} AS payback_years, rent AS rent_median_ppm_month,
    basis AS yield_basis, n AS yield_sample_size FROM g WHERE gross BETWEEN 1 AND 20"""))
def rental_yield(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return yields.with_yield(rows.where(sane_active("sale")), yields.rent_medians(rows)).where(
        F.col("gross_yield_percent").isNotNull()).select(
        "id", "gross_yield_percent", "payback_years", "rent_median_ppm_month", "yield_basis", "yield_sample_size")


_SELLERS = """, sellers AS (
  SELECT source, seller_id, count(*) AS active_listings, bool_or(is_business) AS business,
    CASE WHEN bool_or(is_business) OR count(*) >= 3 THEN 'agent' WHEN count(*) = 1 THEN 'owner' ELSE 'unknown' END AS seller_type
  FROM listings WHERE status = 'active' GROUP BY source, seller_id)"""


@query("seller_classes", with_listings(_SELLERS + " SELECT * FROM sellers"))
def seller_classes(spark, sf_dir):
    return sellers.classify_sellers(listings(spark, sf_dir))


@query("seller_counts", with_listings(_SELLERS + " SELECT seller_type, count(*) AS sellers FROM sellers GROUP BY seller_type"))
def seller_counts(spark, sf_dir):
    return sellers.seller_counts(sellers.classify_sellers(listings(spark, sf_dir)))


@query("seller_labels", with_listings(_SELLERS + """ SELECT l.id, s.seller_type FROM listings l
  LEFT JOIN sellers s ON l.source = s.source AND l.seller_id = s.seller_id"""))
def seller_labels(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return sellers.label_listings(rows, sellers.classify_sellers(rows)).select("id", "seller_type")


_HUBS = """, hubs AS (
  SELECT deal_type, district, rooms,
    CASE WHEN grouping(rooms) = 1 THEN 'district' WHEN grouping(district) = 1 THEN 'rooms' ELSE 'district_rooms' END AS level,
    count(*) AS total, min(price_usd) AS lo, sum(price_per_m2_usd) AS sppm, sum(price_usd) AS sprice
  FROM sane GROUP BY GROUPING SETS ((deal_type, district), (deal_type, rooms), (deal_type, district, rooms))
  HAVING count(*) >= 3 AND (grouping(rooms) = 1 OR rooms BETWEEN 1 AND 6))"""


@query("hub_catalogue", with_listings(_HUBS + " SELECT deal_type, district, rooms, level, total FROM hubs"))
def hub_catalogue(spark, sf_dir):
    return hubs.hub_slices(listings(spark, sf_dir)).select("deal_type", "district", "rooms", "level", "total")


@query("hub_slices", with_listings(_HUBS + f""" SELECT deal_type, district, rooms, level, total,
  {R('lo', 4)} AS min_price_usd, {R('sppm / total', 3)} AS avg_ppm_usd,
  CASE WHEN deal_type = 'rent' THEN {R('sprice / total', 3)} END AS avg_price_usd FROM hubs"""))
def hub_slices(spark, sf_dir):
    out = hubs.hub_slices(listings(spark, sf_dir))
    return out.withColumns({"min_price_usd": F.round("min_price_usd", 4), "avg_ppm_usd": F.round("avg_ppm_usd", 3),
                            "avg_price_usd": F.round("avg_price_usd", 3)})


_CARDS = """, cards AS (SELECT *, row_number() OVER (PARTITION BY deal_type, district, rooms
  ORDER BY discount_percent DESC NULLS LAST, price_per_m2_usd, id) AS card FROM sane)"""


@query("hub_top_cards", with_listings(_CARDS + """ SELECT deal_type, district, rooms, CAST(card AS INTEGER) AS card, id
  FROM cards WHERE card <= 48"""))
def hub_top_cards(spark, sf_dir):
    return hubs.hub_cards(listings(spark, sf_dir)).select("deal_type", "district", "rooms", "card", "id")


@query("hub_below_market", with_listings(_CARDS + """ SELECT deal_type, district, rooms, count(*) AS cards,
  count(*) FILTER (discount_percent >= 15) AS below_market FROM cards WHERE card <= 48 GROUP BY ALL"""))
def hub_below_market(spark, sf_dir):
    return hubs.below_market_in_cards(hubs.hub_cards(listings(spark, sf_dir)))


@query("rooms_breakdown", with_listings(f"""SELECT deal_type, district, rooms, count(*) AS count,
  {R('avg(price_usd)', 3)} AS avg_price FROM sane WHERE rooms BETWEEN 1 AND 5 GROUP BY ALL"""))
def rooms_breakdown(spark, sf_dir):
    return hubs.rooms_breakdown(listings(spark, sf_dir)).withColumn("avg_price", F.round("avg_price", 3))


@query("mirror_slices", with_listings(_HUBS + """ SELECT a.deal_type, a.district, a.rooms, a.level, a.total, b.total AS mirror_total
  FROM hubs a JOIN hubs b ON a.deal_type <> b.deal_type AND a.district IS NOT DISTINCT FROM b.district
    AND a.rooms IS NOT DISTINCT FROM b.rooms"""))
def mirror_slices(spark, sf_dir):
    return hubs.mirror_slices(hubs.hub_slices(listings(spark, sf_dir)))


@query("related_slices", with_listings(_HUBS + """ SELECT deal_type, district, rooms,
    count(*) OVER (PARTITION BY deal_type, district) - 1 AS other_rooms,
    count(*) OVER (PARTITION BY deal_type, rooms) - 1 AS other_districts FROM hubs WHERE level = 'district_rooms'"""))
def related_slices(spark, sf_dir):
    return hubs.related_slices(hubs.hub_slices(listings(spark, sf_dir)))


@query("lastmod", with_listings("SELECT deal_type, strftime(max(seen_at), '%Y-%m-%d') AS last_day FROM sane GROUP BY deal_type"))
def lastmod(spark, sf_dir):
    out = hubs.last_modified(listings(spark, sf_dir), "seen_at")
    return out.select("deal_type", F.date_format("last_at", "yyyy-MM-dd").alias("last_day"))


@query("catalogue_rows", with_listings(_HUBS + """, big AS (
    SELECT complex FROM sane WHERE deal_type = 'sale' GROUP BY complex HAVING count(*) >= 5),
  rows AS (
    SELECT 'sale' AS deal_type, * FROM (VALUES ('/', 'daily', '1.0'), ('/kvartira', 'daily', '0.8'), ('/terms', 'monthly', '0.3'),
      ('/disclaimer', 'monthly', '0.3'), ('/removal', 'monthly', '0.3'), ('/jk', 'daily', '0.7')) t(loc, changefreq, priority)
    UNION ALL SELECT 'rent', '/arenda', 'daily', '0.8'
    UNION ALL SELECT deal_type, CASE WHEN deal_type = 'rent' THEN '/arenda' ELSE '/kvartira' END
        || CASE WHEN district IS NOT NULL THEN '/' || lower(replace(district, '_', '-')) ELSE '' END
        || CASE WHEN rooms IS NOT NULL THEN '/' || rooms || '-komnatnye' ELSE '' END,
      'daily', CASE WHEN level = 'district' THEN '0.7' ELSE '0.6' END FROM hubs
    UNION ALL SELECT 'sale', '/jk/' || lower(replace(complex, '#', '-')), 'weekly', '0.6' FROM big),
  stamp AS (SELECT deal_type, strftime(max(seen_at), '%Y-%m-%d') AS lastmod FROM sane GROUP BY deal_type)
  SELECT loc, lastmod, changefreq, priority FROM rows LEFT JOIN stamp USING (deal_type)"""))
def catalogue_rows(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return hubs.catalogue(rows, hubs.hub_slices(rows), complexes.complex_stats(rows), modified="seen_at")


@query("card_rows", with_listings(f"""SELECT id, {R('price_usd')} AS price_usd, rooms, district,
    CASE WHEN discount_percent >= 8 THEN {R('discount_percent')} END AS discount_percent,
    CASE WHEN discount_percent >= 8 THEN 'hot' ELSE 'plain' END AS badge FROM sane"""))
def card_rows(spark, sf_dir):
    """The public row shows a discount only when it is worth showing."""
    hot = search.is_hot(8)
    return listings(spark, sf_dir).where(sane_active()).select(
        "id", F.round("price_usd", 4).alias("price_usd"), "rooms", "district",
        F.when(hot, F.round("discount_percent", 4)).alias("discount_percent"),
        F.when(hot, "hot").otherwise("plain").alias("badge"))


@query("listing_detail", with_listings("""SELECT id, source, title, district, rooms FROM listings
  WHERE id IN (SELECT max(id) FROM listings GROUP BY source)"""))
def listing_detail(spark, sf_dir):
    """Rows by primary key, for a table of keys."""
    rows = listings(spark, sf_dir)
    keys = rows.groupBy("source").agg(F.max("id").alias("id")).select("id")
    return search.details(rows, keys).select("id", "source", "title", "district", "rooms")


@query("stale_selection", with_listings(f"""SELECT source, count(*) AS stale,
    count(*) FILTER (discount_percent IS NULL) AS pending FROM listings
  WHERE status = 'active' AND seen_at < TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY GROUP BY source"""))
def stale_selection(spark, sf_dir):
    """C11: rows unseen for three days, and how many still wait for an estimate."""
    cutoff = F.expr(f"TIMESTAMP_NTZ '{AS_OF} 00:00:00' - INTERVAL 3 DAYS")
    return listings(spark, sf_dir).where((F.col("status") == "active") & (F.col("seen_at") < cutoff)).groupBy("source").agg(
        F.count(F.lit(1)).alias("stale"), F.count_if(F.col("discount_percent").isNull()).alias("pending"))


@query("photo_gaps", with_listings("""SELECT source, count(*) AS missing FROM listings
  WHERE status = 'active' AND rooms % 2 = 0 GROUP BY source"""))
def photo_gaps(spark, sf_dir):
    """C11: odd room counts have photos here."""
    rows = listings(spark, sf_dir).withColumn("photos", F.expr("IF(rooms % 2 = 0, array(), array('p'))"))
    return state.without_photos(rows).groupBy("source").agg(F.count(F.lit(1)).alias("missing"))


@query("price_verdicts", with_listings(f""", m AS (SELECT complex, {MED('price_per_m2_usd')} AS med FROM sane WHERE deal_type = 'sale' GROUP BY complex),
  v AS (SELECT (price_per_m2_usd / med - 1) * 100 AS diff FROM sane JOIN m USING (complex) WHERE deal_type = 'sale')
  SELECT CASE WHEN diff <= -10 THEN 'good' WHEN diff >= 10 THEN 'expensive' ELSE 'in_market' END AS verdict, count(*) AS listings FROM v GROUP BY 1"""))
def price_verdicts(spark, sf_dir):
    """B33 against the complex median."""
    rows = listings(spark, sf_dir).where(sane_active("sale"))
    med = grouped_median(rows, ["complex"], "price_per_m2_usd", name="med")
    diff = (F.col("price_per_m2_usd") / F.col("med") - 1) * 100
    return rows.join(med, "complex").groupBy(price_verdict(diff).alias("verdict")).agg(F.count(F.lit(1)).alias("listings"))


@query("feed_districts", with_listings("SELECT DISTINCT district FROM sane WHERE deal_type = 'sale' AND district <> ''"))
def feed_districts(spark, sf_dir):
    return search.feed_districts(listings(spark, sf_dir))


@query("related_links", with_listings(_HUBS + """ SELECT a.deal_type, a.level, a.district, a.rooms, b.level AS to_level, b.district AS to_district,
    b.rooms AS to_rooms FROM hubs a JOIN hubs b ON a.deal_type = b.deal_type AND (
      (a.level = 'district' AND ((b.level = 'district_rooms' AND a.district = b.district) OR (b.level = 'district' AND a.district <> b.district)))
      OR (a.level = 'rooms' AND ((b.level = 'district_rooms' AND a.rooms = b.rooms) OR (b.level = 'rooms' AND a.rooms <> b.rooms)))
      OR (a.level = 'district_rooms' AND b.level = 'district_rooms' AND ((a.district = b.district AND a.rooms <> b.rooms)
        OR (a.rooms = b.rooms AND a.district <> b.district))))"""))
def related_links(spark, sf_dir):
    """D14."""
    return hubs.related_links(hubs.hub_slices(listings(spark, sf_dir)))


@query("complex_sorts", with_listings(f""", c AS (SELECT complex, count(*) AS count, {R(MED('price_usd'), 2)} AS price, {R(MED('price_per_m2_usd'), 2)} AS ppm
    FROM sane WHERE deal_type = 'sale' GROUP BY complex HAVING count(*) >= 5),
  s AS (SELECT 'count' AS sort, complex, row_number() OVER (ORDER BY count DESC, complex) AS n FROM c
    UNION ALL SELECT 'median_ppm', complex, row_number() OVER (ORDER BY ppm, complex) FROM c
    UNION ALL SELECT 'median_price', complex, row_number() OVER (ORDER BY price, complex) FROM c)
  SELECT sort, complex FROM s WHERE n <= 8"""))
def complex_sorts(spark, sf_dir):
    """The first complexes of each order."""
    stats = materialise(complexes.complex_stats(listings(spark, sf_dir)), "complex-stats")
    parts = [stats.orderBy(*complexes.complex_order(s)).limit(8).select(F.lit(s).alias("sort"), "complex") for s in ("count", "median_ppm", "median_price")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
