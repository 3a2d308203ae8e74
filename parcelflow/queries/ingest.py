"""Payload parsing, normalising, features and the complex dictionary.

Listing payloads are derived from the order tables: every order is one landed page in the layout at
hand, its lineitems are the adverts on it.
"""

from pyspark.sql import functions as F

from parcelflow.functions import complex_names as CN, text as T
from parcelflow.functions import vocabulary as V
from parcelflow.functions.features import blob, material, micro_location, segment, year_after
from parcelflow.plans import complexes, dictionary, hubs, normalise, product, state
from parcelflow.plans.alerts import csv_ints
from parcelflow.queries.proxy import table
from parcelflow.queries.registry import R, query
from parcelflow.sources import payloads
from parcelflow.sources.schemas import duplicate_keys
from parcelflow.sources.storage import materialise
from parcelflow.sources.tables import json_strings

_LINE = "li AS (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS lid FROM lineitem)"


def _pages(spark, sf_dir, layout, item, page, deal="sale"):
    """One landed page per order; ``item`` and ``page`` are SQL expressions over a row and the page's list of items."""
    li = table(spark, sf_dir, "lineitem").withColumn("lid", F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"))
    pages = li.groupBy("l_orderkey").agg(F.expr(f"sort_array(collect_list(named_struct('line', l_linenumber, 'lid', lid, 'item', {item})))").alias("items"))
    return pages.selectExpr(
        f"'{layout}' AS source", f"'{layout}' AS layout", f"'{deal}' AS deal_type", "CAST(l_orderkey AS STRING) AS page_id",
        "CAST(NULL AS TIMESTAMP_NTZ) AS fetched_at", f"{page} AS body")


_FLAT_ITEM = """named_struct('id', lid, 'isActive', l_returnflag <> 'A', 'moderationStatus', IF(l_linestatus = 'F', 'approved', 'waiting'),
  'square', l_quantity, 'room', IF(l_linenumber = 7, 'studio', CAST(l_linenumber AS STRING)), 'price', l_extendedprice,
  'priceCurrency', IF(l_tax > 0.04, 'uzs', 'usd'), 'priceType', IF(l_tax < 0.02, 'sqm', 'total'),
  'address', 'Чиланзар  улица 5', 'floor', CAST(l_partkey % 9 + 1 AS INT), 'floorTotal', 9, 'districtId', l_suppkey % 40,
  'media', transform(sequence(1, 10), i -> named_struct('url', concat('p', i))), 'upAt', '2026-05-11T10:02:25.955Z', 'userId', l_suppkey)"""


@query("payload_flat_api", f"""WITH {_LINE} SELECT lid AS source_id,
    CASE WHEN l_tax < 0.02 THEN {R('l_extendedprice * l_quantity', 2)} ELSE l_extendedprice END AS price,
    CASE WHEN l_tax > 0.04 THEN 'UZS' ELSE 'USD' END AS currency, l_quantity AS area_m2,
    CAST(CASE WHEN l_linenumber = 7 THEN 1 ELSE l_linenumber END AS INTEGER) AS rooms,
    CASE WHEN n.n_name IS NULL THEN 'Чиланзарский район' ELSE 'Не указан' END AS district, 'Чиланзар улица 5' AS address_raw,
    CAST(l_partkey % 9 + 1 AS INTEGER) AS floor, 8 AS photos, CAST(l_suppkey AS VARCHAR) AS seller_id
  FROM li LEFT JOIN nation n ON n.n_nationkey = l_suppkey % 40 WHERE l_returnflag <> 'A' AND l_linestatus = 'F'""")
def payload_flat_api(spark, sf_dir):
    p = _pages(spark, sf_dir, "flat_api", _FLAT_ITEM, "to_json(named_struct('total', size(items), 'results', items.item))")
    places = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS name")
    return payloads.parse_payloads(p, locations=places, layouts=["flat_api"]).select(
        "source_id", "price", "currency", "area_m2", "rooms", "district", "address_raw", "floor",
        F.size("photos").alias("photos"), "seller_id")


_NESTED_ITEM = """named_struct('id', lid, 'attributes', named_struct(
    'name', named_struct('ru', concat(l_linenumber, '-комнатная квартира − ', CAST(l_quantity AS INT) + 10, ' м², ', l_partkey % 9 + 1, '/9 этаж')),
    'statusKey', IF(l_returnflag = 'A', 'archived', 'active'), 'price', named_struct('usd', l_extendedprice, 'uzs', l_extendedprice * 12700),
    'currency', 'usd', 'imageSets', array(named_struct('w600', 'a', 'original', ''), named_struct('w600', '', 'original', 'b'))),
  'relations', named_struct('address', named_struct('data', named_struct('attributes', named_struct('fullAddress', named_struct('uz', 'Yunusabad 4')))),
    'user', named_struct('data', named_struct('relations', named_struct('role', named_struct('data', named_struct('attributes', named_struct('key', 'owner'))))))))"""


@query("payload_nested_api", f"""WITH {_LINE} SELECT lid AS source_id, l_extendedprice AS price, l_quantity + 10 AS area_m2, l_linenumber AS rooms,
    CAST(l_partkey % 9 + 1 AS INTEGER) AS floor, 9 AS total_floors, 'Юнусабадский район' AS district, 'owner' AS seller_type, 'a|b' AS photos
  FROM li WHERE l_returnflag <> 'A'""")
def payload_nested_api(spark, sf_dir):
    p = _pages(spark, sf_dir, "nested_api", _NESTED_ITEM, "to_json(named_struct('data', items.item))")
    return payloads.parse_payloads(p, layouts=["nested_api"]).select(
        "source_id", "price", "area_m2", "rooms", "floor", "total_floors", "district", "seller_type",
        F.array_join("photos", "|").alias("photos"))


_CARD_ITEM = """concat('<article data-listing data-id="', lid, '" data-price="', l_extendedprice, '" data-currency="',
  IF(l_tax > 0.04, 'UZS', 'USD'), '" data-area="', CAST(l_quantity AS INT), '" data-rooms="', l_linenumber,
  '"><h2 data-title>Flat &amp; ', l_returnflag, '</h2><span data-floor>', l_partkey % 9 + 1, '/9</span><p data-district>Sergeli</p><img src="x.jpg"></article>')"""


@query("payload_cards", f"""WITH {_LINE} SELECT lid AS source_id, l_extendedprice AS price, CASE WHEN l_tax > 0.04 THEN 'UZS' ELSE 'USD' END AS currency,
    l_quantity AS area_m2, l_linenumber AS rooms, CAST(l_partkey % 9 + 1 AS INTEGER) AS floor, 9 AS total_floors,
    'Flat & ' || l_returnflag AS title, 'Сергелийский район' AS district, '#' AS url, 1 AS photos FROM li""")
def payload_cards(spark, sf_dir):
    p = _pages(spark, sf_dir, "cards", _CARD_ITEM, "concat('<html><body>', array_join(items.item, ' '), '</body></html>')")
    return payloads.parse_payloads(p, layouts=["cards"]).select(
        "source_id", "price", "currency", "area_m2", "rooms", "floor", "total_floors", "title", "district", "url", F.size("photos").alias("photos"))


_OFFER_ITEM = """named_struct(
  'offer', named_struct('name', concat('Квартира ', l_linenumber, '/', l_partkey % 9 + 1, '/9 ', CAST(l_quantity AS INT) + 10, 'м2'),
    'url', concat('https://board.example/d/flat-ID', replace(lid, '-', 'x'), '.html'), 'price', l_extendedprice, 'priceCurrency', 'UZS',
    'areaServed', named_struct('name', 'Mirabad')),
  'card', concat('<div data-cy="l-card"><a href="/d/flat-ID', replace(lid, '-', 'x'), '.html"><h4>Квартира у парка</h4></a><p data-testid="ad-price">',
    CAST(l_extendedprice AS INT), ' у.е.</p><p data-testid="location-date">Ташкент, Яшнабадский район — Сегодня</p></div>'),
  'ad', named_struct('id', concat('n', lid), 'url', concat('https://board.example/d/flat-ID', replace(lid, '-', 'x'), '.html'),
    'photos', array('a', 'b'), 'isBusiness', l_returnflag = 'R', 'user', named_struct('id', l_suppkey), 'map', named_struct('lat', 41.25, 'lon', 69.5),
    'params', array(named_struct('key', 'total_area', 'value', CAST(CAST(l_quantity AS INT) + 10 AS STRING)),
      named_struct('key', 'number_of_rooms', 'value', CAST(l_linenumber AS STRING)), named_struct('key', 'comission', 'value', IF(l_returnflag = 'N', 'No', 'Yes')))),
  'listed', l_linestatus = 'F')"""
_OFFER_PAGE = r"""concat('<html><script type="application/ld+json">',
  to_json(named_struct('@type', 'Product', 'offers', named_struct('offers', transform(filter(items.item, i -> i.listed), i -> i.offer)))),
  '</script>', array_join(transform(items.item, i -> i.card), ' '), '<script>window.__PRERENDERED_STATE__ = "',
  replace(replace(to_json(named_struct('listing', named_struct('listing', named_struct('ads', transform(items.item, i -> i.ad))))), '\\', '\\\\'), '"', '\\"'),
  '";</script></html>')"""


@query("payload_offer_pages", f"""WITH {_LINE} SELECT replace(lid, '-', 'x') AS source_id,
    CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE floor(l_extendedprice) END AS price,
    CASE WHEN l_linestatus = 'F' THEN 'UZS' ELSE 'USD' END AS currency, l_quantity + 10 AS area_m2, CAST(l_linenumber AS INTEGER) AS rooms,
    CASE WHEN l_linestatus = 'F' THEN CAST(l_partkey % 9 + 1 AS INTEGER) END AS floor,
    CASE WHEN l_linestatus = 'F' THEN 'Мирабадский район' ELSE 'Яшнабадский район' END AS district,
    CASE WHEN l_linestatus = 'F' THEN 'Квартира' ELSE 'Квартира у парка' END AS address_raw,
    CAST(l_suppkey AS VARCHAR) AS seller_id, l_returnflag = 'R' AS is_business, CASE WHEN l_returnflag = 'N' THEN 0.0::DOUBLE END AS commission_pct,
    'month' AS price_period, 41.25::DOUBLE AS lat, 2 AS photos
  FROM li""")
def payload_offer_pages(spark, sf_dir):
    """A4: half of the adverts appear as offer and card and must come out once."""
    # landed once: offers, cards and state are three readings of a page
    p = materialise(_pages(spark, sf_dir, "offer_page", _OFFER_ITEM, _OFFER_PAGE, deal="rent"), "offer-pages")
    return payloads.parse_payloads(p, layouts=["offer_page"]).select(
        "source_id", "price", "currency", "area_m2", "rooms", "floor", "district", "address_raw", "seller_id", "is_business",
        "commission_pct", "price_period", "lat", F.size("photos").alias("photos"))


@query("detail_probes", f"""WITH {_LINE} SELECT lid AS url, l_linenumber = 7 OR l_returnflag = 'A' AS is_gone,
    CASE WHEN l_linenumber < 7 AND l_returnflag = 'R' THEN l_extendedprice END AS usd_price,
    CASE WHEN l_linenumber < 7 AND l_returnflag <> 'A' THEN CAST(l_partkey % 9 + 1 AS INTEGER) END AS floor FROM li""")
def detail_probes(spark, sf_dir):
    """A9 on one detail page per lineitem."""
    state = """to_json(named_struct('ad', named_struct('ad', named_struct('isActive', l_returnflag <> 'A', 'status', 'active',
      'params', array(named_struct('key', 'floor', 'value', CAST(l_partkey % 9 + 1 AS STRING))),
      'price', named_struct('regularPrice', named_struct('value', l_extendedprice, 'currencyCode', IF(l_returnflag = 'R', 'UYE', 'UZS')))))))"""
    pages = table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS url", "IF(l_linenumber = 7, 410, 200) AS status_code",
        rf"""concat('<script>window.__PRERENDERED_STATE__ = "', replace(replace({state}, '\\', '\\\\'), '"', '\\"'), '";</script>') AS html""")
    return payloads.detail_probes(pages).select("url", "is_gone", "usd_price", "floor")


@query("page_statistics", """SELECT o_orderpriority AS source, max(o_orderkey) AS total, 40 AS page_size, max(o_custkey) AS last_page,
    count(*) AS landed_pages, CAST(greatest(1, ceil(max(o_orderkey) / 40)) AS BIGINT) AS total_pages FROM orders GROUP BY 1""")
def page_statistics(spark, sf_dir):
    p = table(spark, sf_dir, "orders").selectExpr("o_orderpriority AS source", "o_orderkey AS total", "40 AS page_size", "o_custkey AS page")
    return product.page_statistics(p)


@query("unique_keys", """SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def unique_keys(spark, sf_dir):
    return duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("page_links", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a\b[^>]*\bhref\s*=\s*"([^"]*)"[^>]*>.*?</a>', 1)) AS href,
    generate_subscripts(regexp_extract_all(html, '(?s)<a\b[^>]*\bhref\s*=\s*"([^"]*)"[^>]*>.*?</a>', 1), 1) - 1 AS pos FROM pages)
  SELECT page_id, href, CAST(min(pos) AS INTEGER) AS pos FROM l GROUP BY page_id, href""")
def page_links(spark, sf_dir):
    return payloads.page_links(table(spark, sf_dir, "pages")).select("page_id", "href", "pos")


@query("page_cards", """SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?s)<article\\b[^>]*>(.*)</article>', 1), '<p\\b')) AS paragraphs FROM pages""")
def page_cards(spark, sf_dir):
    return payloads.page_cards(table(spark, sf_dir, "pages")).select("page_id", F.col("paragraphs").cast("long").alias("paragraphs"))


@query("text_normalise", r"""SELECT doc_id, length(trim(regexp_replace(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F]+', ' ', 'g'))) AS length,
    md5(trim(regexp_replace(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F]+', ' ', 'g'))) AS digest FROM documents""")
def text_normalise(spark, sf_dir):
    clean = T.collapse(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(clean).cast("long").alias("length"), F.md5(clean).alias("digest"))


def _alternatives(words):
    return " OR ".join("contains(t, '{}')".format(w.replace("'", "''")) for w in words)


def _year_sql(hints):
    tries = []
    for h in hints:
        digits = f"try_cast(nullif(regexp_extract(substr(t, instr(t, '{h}') + {len(h)}, 16), '(\\d{{4}})', 1), '') AS INTEGER)"
        tries.append(f"CASE WHEN instr(t, '{h}') > 0 AND {digits} BETWEEN 1900 AND 2099 THEN {digits} END")
    return f"coalesce({', '.join(tries)})"


# Listing texts: part names and documents, with the wording of adverts woven in by key.
_ADVERTS = """SELECT p_partkey AS id, p_name || CASE p_partkey % 7 WHEN 0 THEN ' новостройка' WHEN 1 THEN ', год постройки: ' || (1960 + p_partkey % 65)
    WHEN 2 THEN ' кирпичный дом' WHEN 3 THEN ' Монолит, City Park' WHEN 4 THEN ' массив Чорсу' WHEN 5 THEN ' сдан в ' || (1990 + p_partkey % 40) || ' году'
    ELSE ' панельный' END AS text FROM part
  UNION ALL SELECT -doc_id - 1, text FROM documents"""


def _adverts(spark, sf_dir):
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", """concat(p_name, CASE p_partkey % 7 WHEN 0 THEN ' новостройка'
      WHEN 1 THEN concat(', год постройки: ', 1960 + p_partkey % 65) WHEN 2 THEN ' кирпичный дом' WHEN 3 THEN ' Монолит, City Park'
      WHEN 4 THEN ' массив Чорсу' WHEN 5 THEN concat(' сдан в ', 1990 + p_partkey % 40, ' году') ELSE ' панельный' END) AS text""")
    return parts.unionByName(table(spark, sf_dir, "documents").selectExpr("-doc_id - 1 AS id", "text"))


@query("text_segment", f"""WITH a AS (SELECT id, lower(text) AS t FROM ({_ADVERTS}))
  SELECT id, CASE WHEN {_alternatives(V.NEW_BUILD_MARKERS + V.NEW_BUILD_BRANDS)} OR coalesce({_year_sql(V.SEGMENT_YEAR_HINTS)} >= 2015, false)
    THEN 'new' ELSE 'secondary' END AS segment FROM a""")
def text_segment(spark, sf_dir):
    return _adverts(spark, sf_dir).select("id", segment(blob(F.col("text"))).alias("segment"))


@query("text_year", f"WITH a AS (SELECT id, lower(text) AS t FROM ({_ADVERTS})) SELECT id, {_year_sql(V.FEATURE_YEAR_HINTS)} AS year_built FROM a")
def text_year(spark, sf_dir):
    return _adverts(spark, sf_dir).select("id", year_after(blob(F.col("text")), V.FEATURE_YEAR_HINTS).alias("year_built"))


_MATERIAL_SQL = "CASE " + " ".join("WHEN contains(t, '{}') THEN '{}'".format(m.replace("'", "''"), v) for m, v in V.MATERIAL_MARKERS) + " END"


@query("text_material", f"WITH a AS (SELECT id, lower(text) AS t FROM ({_ADVERTS})) SELECT id, {_MATERIAL_SQL} AS material FROM a")
def text_material(spark, sf_dir):
    return _adverts(spark, sf_dir).select("id", material(blob(F.col("text"))).alias("material"))


_KNOWN_SQL = "CASE " + " ".join(f"WHEN contains(t, '{p}') THEN '{p.replace(' ', '-')}'" for p in V.KNOWN_LOCATIONS) + " END"
_BLOCK = r"(?:^|[^\p{L}\p{M}\p{N}_])(ттз|ц|с|q)[\s-]?(\d{1,2})(?:$|[^\p{L}\p{M}\p{N}_])"


@query("text_micro_location", f"""WITH a AS (SELECT id, lower(text) AS t FROM ({_ADVERTS}))
  SELECT id, coalesce(nullif(regexp_extract(t, 'масс?ив\\s+([\\p{{L}}\\p{{M}}\\p{{N}}_-]{{2,30}})', 1), ''),
    'квартал-' || nullif(regexp_extract(t, 'квартал\\s+([\\p{{L}}\\p{{M}}\\p{{N}}_-]{{2,30}})', 1), ''),
    nullif(regexp_extract(t, '{_BLOCK}', 1), '') || '-' || regexp_extract(t, '{_BLOCK}', 2), {_KNOWN_SQL}) AS micro_location FROM a""")
def text_micro_location(spark, sf_dir):
    return _adverts(spark, sf_dir).select("id", micro_location(blob(F.col("text"))).alias("micro_location"))


@query("feature_report", f"""WITH a AS (SELECT id, lower(text) AS t FROM ({_ADVERTS})), f AS (
    SELECT CASE WHEN {_alternatives(V.NEW_BUILD_MARKERS + V.NEW_BUILD_BRANDS)} OR coalesce({_year_sql(V.SEGMENT_YEAR_HINTS)} >= 2015, false)
      THEN 'new' ELSE 'secondary' END AS segment, {_MATERIAL_SQL} AS material, {_year_sql(V.FEATURE_YEAR_HINTS)} AS year_built FROM a)
  SELECT segment, count(*) AS rows, count(material) AS with_material, count(year_built) AS with_year_built FROM f GROUP BY segment""")
def feature_report(spark, sf_dir):
    """J3 over all advert texts."""
    rows = _adverts(spark, sf_dir).selectExpr("id", "text AS title", "'' AS address_raw", "CAST(NULL AS STRING) AS description",
                                              "CAST(NULL AS INT) AS floor", "CAST(NULL AS INT) AS total_floors")
    return normalise.feature_report(normalise.listing_features(rows)).select("segment", "rows", "with_material", "with_year_built")


_DISTRICT_SQL = "CASE " + " ".join(f"WHEN contains(d, '{a}') THEN '{n}'" for a, n in V.DISTRICT_ALIASES) + " ELSE 'Не указан' END"
_RAW_DISTRICT = """CASE l_suppkey % 6 WHEN 0 THEN 'Ташкент,  Юнусабадский р-н' WHEN 1 THEN 'ЧИЛАНЗАР 5' WHEN 2 THEN 'Mirzo Ulugbek'
  WHEN 3 THEN 'Sergeli' WHEN 4 THEN 'центр' ELSE 'Олмазор туман' END"""


@query("normalise_listings", f"""WITH {_LINE}, raw AS (SELECT lid, lower({_RAW_DISTRICT}) AS d, l_quantity AS area, l_linenumber,
    {R("CASE WHEN l_tax > 0.04 THEN l_extendedprice * 12700 / 12700 ELSE l_extendedprice END", 2)} AS usd FROM li),
  j AS (SELECT *, {R('usd / area', 2)} AS ppm, {_DISTRICT_SQL} AS district FROM raw)
  SELECT lid AS source_id, usd AS price_usd, ppm AS price_per_m2_usd, district,
    lower(district) || '::' || 'паркентский ' || l_linenumber AS building_key FROM j WHERE usd >= 5000 AND ppm >= 100""")
def normalise_listings(spark, sf_dir):
    """Half of the prices arrive in the national currency."""
    raw = table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS source_id", "'board' AS source", "'sale' AS deal_type",
        "IF(l_tax > 0.04, l_extendedprice * 12700, l_extendedprice) AS price", "IF(l_tax > 0.04, 'UZS', 'usd') AS currency",
        "l_quantity AS area_m2", "l_linenumber AS rooms", f"{_RAW_DISTRICT} AS district",
        "concat('ул. Паркентский,  дом ', l_linenumber) AS address_raw")
    silver, _ = normalise.normalise_listings(raw)
    return silver.select("source_id", "price_usd", "price_per_m2_usd", "district", "building_key")


@query("district_coverage", f"""WITH j AS (SELECT l_returnflag AS source, {_DISTRICT_SQL} AS district FROM (
    SELECT l_returnflag, lower({_RAW_DISTRICT}) AS d FROM lineitem)) SELECT source, count(*) AS rows,
  count(*) FILTER (district = 'Не указан') AS unmatched FROM j GROUP BY source""")
def district_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("source"), T.district(F.expr(_RAW_DISTRICT)).alias("district"))
    return normalise.district_coverage(rows)


@query("recanonicalise_districts", f"""SELECT district, count(*) AS rows FROM (SELECT {_DISTRICT_SQL} AS district FROM (
    SELECT lower({_RAW_DISTRICT}) AS d FROM lineitem)) GROUP BY district""")
def recanonicalise_districts(spark, sf_dir):
    """L8."""
    rows = table(spark, sf_dir, "lineitem").select(F.expr(_RAW_DISTRICT).alias("district"))
    return normalise.recanonicalise(rows).groupBy("district").agg(F.count(F.lit(1)).alias("rows"))


@query("purge_listings", f"""WITH {_LINE} SELECT l_returnflag, count(*) AS kept FROM li
  WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY l_returnflag""")
def purge_listings(spark, sf_dir):
    """Rows of suppliers in debt go."""
    keys = table(spark, sf_dir, "supplier").where("s_acctbal < 0").selectExpr("s_suppkey AS l_suppkey")
    return state.purge(table(spark, sf_dir, "lineitem"), keys, ["l_suppkey"]).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("kept"))


@query("known_listings", f"""WITH {_LINE} SELECT l_linestatus, count(*) FILTER (o_orderstatus = 'F') AS known, count(*) FILTER (o_orderstatus <> 'F') AS unknown
  FROM li JOIN orders ON o_orderkey = l_orderkey GROUP BY l_linestatus""")
def known_listings(spark, sf_dir):
    """Finished orders stand for the stored keys."""
    incoming = table(spark, sf_dir, "lineitem").selectExpr("'board' AS source", "l_orderkey AS source_id", "l_linestatus")
    stored = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("'board' AS source", "o_orderkey AS source_id")
    both = state.known(incoming, stored).withColumn("k", F.lit(True)).unionByName(state.unknown(incoming, stored).withColumn("k", F.lit(False)))
    return both.groupBy("l_linestatus").agg(F.count_if("k").alias("known"), F.count_if(~F.col("k")).alias("unknown"))


# Complex names: a part's name in several spellings, some with advert noise, some noise only.
_NAMES = """CASE p_partkey % 8 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' вид' WHEN 2 THEN p_name || ' Мирабадский' WHEN 3 THEN 'ЖК ' || p_name
  WHEN 4 THEN p_name || ' Сити' WHEN 5 THEN p_name || ' city ID' WHEN 6 THEN 'СРОЧНО ' || (p_partkey % 10) ELSE p_name END"""
_KEY_SQL = """replace(replace(replace(replace(replace(replace(replace(lower({n}), 'жк', ''), 'вид', ''), 'мирабадский', ''), 'срочно', ''), 'сити', 'city'), ' id', ''), ' ', '')"""


_DICT = f"""WITH d AS (SELECT p_partkey AS id, {_NAMES} AS name FROM part),
  k AS (SELECT id, name, regexp_replace({_KEY_SQL.format(n='name')}, '^[0-9]$', '') AS key FROM d),
  c AS (SELECT l_partkey AS id, count(*) FILTER (l_returnflag <> 'R') AS active, count(*) AS linked FROM lineitem GROUP BY 1),
  r AS (SELECT k.*, coalesce(active, 0) AS active, coalesce(linked, 0) AS linked FROM k LEFT JOIN c USING (id)),
  canon AS (SELECT key, arg_max(id, (active, -id)) AS canonical_id, count(*) AS members FROM r WHERE key <> '' GROUP BY key)"""


def _rows_for_dictionary(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("""CASE p_partkey % 8 WHEN 0 THEN upper(p_name)
      WHEN 1 THEN concat(p_name, ' вид') WHEN 2 THEN concat(p_name, ' Мирабадский') WHEN 3 THEN concat('ЖК ', p_name)
      WHEN 4 THEN concat(p_name, ' Сити') WHEN 5 THEN concat(p_name, ' city ID') WHEN 6 THEN concat('СРОЧНО ', p_partkey % 10)
      ELSE p_name END""").alias("name")).withColumns({"match_key": F.lit(""), "district": F.lit(None).cast("string")})
    listings = table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id", "l_partkey AS residential_complex_id",
        "IF(l_returnflag = 'R', 'removed', 'active') AS status")
    return d, listings


@query("dictionary_merge", _DICT + """ SELECT r.id, CASE WHEN key <> '' THEN key END AS new_key, canonical_id FROM r LEFT JOIN canon USING (key)""")
def dictionary_merge(spark, sf_dir):
    """Canonical row of every spelling."""
    d, rows = _rows_for_dictionary(spark, sf_dir)
    counts = rows.groupBy(F.col("residential_complex_id").alias("id")).agg(F.count_if(F.col("status") == "active").alias("active"))
    return dictionary.merge_plan(d, counts).select("id", F.nullif("new_key", F.lit("")).alias("new_key"), "canonical_id")


@query("dictionary_report", _DICT + """ SELECT count(*) AS complexes_before, (SELECT count(*) FROM canon WHERE members > 1) AS merge_groups,
    count(*) FILTER (r.id <> canonical_id) AS rows_deleted, coalesce(sum(linked) FILTER (r.id <> canonical_id), 0)::BIGINT AS listings_repointed,
    count(*) FILTER (canonical_id IS NULL) AS orphans_dropped, coalesce(sum(linked) FILTER (canonical_id IS NULL), 0)::BIGINT AS orphan_listings_nulled,
    count(*) FILTER (r.id = canonical_id) AS complexes_after FROM r LEFT JOIN canon USING (key)""")
def dictionary_report(spark, sf_dir):
    """L3."""
    d, rows = _rows_for_dictionary(spark, sf_dir)
    return dictionary.merge_complexes(d, rows)["report"].drop("rows_rekeyed")


@query("dictionary_links", _DICT + """ SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, canonical_id AS residential_complex_id
  FROM lineitem JOIN r ON r.id = l_partkey LEFT JOIN canon USING (key)""")
def dictionary_links(spark, sf_dir):
    """L3: every listing points at its canonical complex."""
    d, rows = _rows_for_dictionary(spark, sf_dir)
    return dictionary.merge_complexes(d, rows)["listings"].select("id", "residential_complex_id")


# The same steps on lists: words, their Latin form, noise and place marks.
_PLAIN_SPLIT = "[^0-9A-Za-zА-Яа-яЁёЎўҚқҒғҲҳ]+"
_LATIN_SQL = "translate(lower({r}), '" + "".join(V.TRANSLIT_SINGLE) + "', '" + "".join(V.TRANSLIT_SINGLE.values()) + "')"
for _letter, _latin in V.TRANSLIT_MULTI.items():
    _LATIN_SQL = f"replace({_LATIN_SQL}, '{_letter}', '{_latin}')"
_NOISE_SQL = "^(?:" + "|".join(V.COMPLEX_NOISE) + r"|\d+|.|u\d?k\d?|id\d*|[abr]\d+)$"
_PLACE_SQL = "^(?:" + "|".join(V.DISTRICT_TOKENS) + ")$|(?:" + "|".join(V.DISTRICT_ENDINGS) + ")$"
_PHONETIC_SQL = "CASE t.canon " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.PHONETIC.items()) + " ELSE t.canon END"


def _tokens_sql(text):
    words = f"""list_transform(regexp_split_to_array({text}, '{_PLAIN_SPLIT}'),
      lambda r: {{'raw': r, 'canon': regexp_replace({_LATIN_SQL.format(r='r')}, '[^a-z0-9]+', '', 'g')}})"""
    return f"""list_transform(list_filter({words}, lambda t: t.canon <> ''),
      lambda t: {{'raw': t.raw, 'canon': t.canon, 'noise': regexp_matches(t.canon, '{_NOISE_SQL}'), 'place': regexp_matches(t.canon, '{_PLACE_SQL}')}})"""


def _branded_sql(tokens):
    return f"CASE WHEN len(list_filter({tokens}, lambda t: NOT t.place)) > 0 THEN list_filter({tokens}, lambda t: NOT t.place) ELSE {tokens} END"


def _written_sql(tokens):
    return f"trim(array_to_string(list_transform(({tokens})[1:4], lambda t: t.raw), ' '))"


_SPOKEN = r"(?i:жк|ж/к|ж\.\s?к|жилой\s+комплекс|residential\s+complex)[\s:«»“”‘’„‟\"''`\-–—]*"
_NAMED_SQL = r"(?:^|[^A-Za-zА-Яа-яЁё0-9])" + _SPOKEN + r"([A-Za-zА-ЯЁ][\p{L}\p{M}\p{N}_&.\-]*(?:\s+[A-Za-zА-Яа-яЁё][\p{L}\p{M}\p{N}_&.\-]*){0,5})"


@query("complex_names", f"""WITH a AS (SELECT id, 'квартира в ЖК «' || text || '» срочно' AS said FROM ({_ADVERTS})),
  n AS (SELECT id, {_tokens_sql(f"regexp_extract(said, '{_NAMED_SQL}', 1)")} AS tokens FROM a),
  s AS (SELECT id, tokens, list_position(list_transform(tokens, lambda t: t.noise), true) AS stop FROM n),
  l AS (SELECT id, (CASE WHEN stop > 0 THEN tokens[1:stop - 1] ELSE tokens END)[1:6] AS lead FROM s),
  w AS (SELECT id, {_written_sql(_branded_sql('lead'))} AS name FROM l),
  k AS (SELECT id, name, list_filter({_tokens_sql('name')}, lambda t: NOT t.noise) AS kept FROM w)
  SELECT id, CASE WHEN length(array_to_string(list_transform({_branded_sql('kept')}, lambda t: {_PHONETIC_SQL}), '')) >= 2 THEN name END AS name FROM k""")
def complex_names(spark, sf_dir):
    """B15 on whole texts: names behind a complex keyword."""
    texts = _adverts(spark, sf_dir).withColumn("t", F.concat(F.lit("квартира в ЖК «"), "text", F.lit("» срочно")))
    return texts.select("id", CN.extract_name(F.col("t")).alias("name"))


@query("clean_names", f"""WITH d AS (SELECT p_partkey AS id, {_NAMES} AS name FROM part),
  k AS (SELECT id, list_filter({_tokens_sql('name')}, lambda t: NOT t.noise) AS kept FROM d)
  SELECT id, {_written_sql(_branded_sql('kept'))} AS name FROM k""")
def clean_names(spark, sf_dir):
    """B14 on every spelling of the dictionary."""
    d, _ = _rows_for_dictionary(spark, sf_dir)
    return d.select("id", CN.clean_name(F.col("name")).alias("name"))


@query("text_furnished", """SELECT p_partkey AS id, [true, false, false, true, NULL][1 + p_partkey % 5] AS is_furnished FROM part""")
def text_furnished(spark, sf_dir):
    """Mentions, denials and silence in a part's advert."""
    said = F.element_at(F.array(*[F.lit(x) for x in ("сдаётся С мебелью", "без  мебели", "не меблирована, есть мебель на кухне",
                                                     "Вся мебель новая", "ремонт")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.furnished(F.concat("p_name", F.lit(" "), said)).alias("is_furnished"))


@query("text_instants", "SELECT event_id, ts AS at, CAST(NULL AS TIMESTAMP) AS broken FROM events")
def text_instants(spark, sf_dir):
    """ISO date-times with and without offsets."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    offset = F.element_at(F.array(*[F.lit(x) for x in ("Z", "+05:00", "", "-0330")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", T.instant(F.concat(iso, offset)).alias("at"), T.instant(F.concat(F.lit("on "), iso)).alias("broken"))


@query("json_lists", """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN [p_name, p_type] ELSE [] END AS photos,
  CASE WHEN p_partkey % 2 = 0 THEN [p_size, 7] ELSE [7] END AS rooms FROM part""")
def json_lists(spark, sf_dir):
    """JSON lists with broken ones among them, comma lists with blanks and words."""
    photos = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.array("p_name", "p_type"))).when(F.col("p_partkey") % 3 == 1, F.lit("[\"a\", "))
    rooms = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.lit("any")), F.lit(" , , 7 "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), json_strings(photos).alias("photos"),
                                               csv_ints(rooms).alias("rooms"))


@query("probe_candidates", f"""WITH {_LINE} SELECT lid AS source_id FROM li
  WHERE l_tax > 0.04 AND NOT (round(1 - 2 * l_discount, 6) BETWEEN 0.90 AND 1.02)""")
def probe_candidates(spark, sf_dir):
    """Half of the rows come back in the national currency, off by twice their discount."""
    li = table(spark, sf_dir, "lineitem").selectExpr("'board' AS source", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS source_id",
                                                     "l_extendedprice AS p", "l_discount", "l_tax")
    stored = li.selectExpr("source", "source_id", "'USD' AS currency", "CAST(100 AS DOUBLE) AS price_usd")
    incoming = li.selectExpr("source", "source_id", "IF(l_tax > 0.04, 'UZS', 'USD') AS currency", "round(100 * (1 - 2 * l_discount), 4) AS price_usd")
    return state.needs_probe(incoming, stored).select("source_id")


@query("listing_complex_names", f"""WITH {_LINE} SELECT lid AS id, CASE WHEN l_partkey % 5 > 0 THEN p_name END AS complex_name
  FROM li JOIN part ON p_partkey = l_partkey""")
def listing_complex_names(spark, sf_dir):
    """Every listing with the name of its complex; a fifth of the links point nowhere."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id", "l_partkey AS residential_complex_id")
    names = table(spark, sf_dir, "part").where("p_partkey % 5 > 0").selectExpr("p_partkey AS id", "p_name AS name")
    return complexes.with_complex_name(rows, names).select("id", "complex_name")


@query("slugs", """SELECT c_custkey AS id, c_custkey || '-' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
    (1 + c_custkey % 6) || '-komnatnye' AS rooms_slug, c_custkey AS back, CAST(1 + c_custkey % 6 AS INTEGER) AS rooms_back FROM customer""")
def slugs(spark, sf_dir):
    """Slugs and their inverses."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), hubs.complex_slug(F.col("c_custkey"), F.col("c_name")).alias("slug"),
        hubs.rooms_slug(1 + F.col("c_custkey") % 6).alias("rooms_slug"))
    return rows.withColumns({"back": hubs.complex_id_from_slug(F.col("slug")), "rooms_back": hubs.rooms_from_slug(F.col("rooms_slug"))})


# Listings whose advert names a complex in several spellings; a third is linked already, line 1 names none.
_SPELT = "CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN {title} ELSE p_name END"
_BACKFILL = f"""WITH {_LINE}, l AS (SELECT lid AS id, CAST(l_suppkey % 25 AS VARCHAR) AS district, CASE WHEN l_returnflag = 'R' THEN l_partkey END AS linked,
    CASE WHEN l_linenumber > 1 THEN {_SPELT.format(title="upper(p_name[1]) || p_name[2:]")} END AS spelt, replace(p_name, ' ', '') AS key
    FROM li JOIN part ON p_partkey = l_partkey),
  known AS (SELECT min(p_partkey) AS kid, p_name, replace(p_name, ' ', '') AS key FROM part GROUP BY p_name HAVING min(p_partkey) % 2 = 0),
  seen AS (SELECT * FROM l WHERE linked IS NULL AND spelt IS NOT NULL),
  fresh AS (SELECT key, arg_min(spelt, id) AS name, arg_min(district, id) AS district FROM seen WHERE key NOT IN (SELECT key FROM known) GROUP BY key)"""


def _backfilled(spark, sf_dir):
    spelt = _SPELT.format(title="concat(upper(left(p_name, 1)), substring(p_name, 2))")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("p_partkey = l_partkey")).selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id", "CAST(l_suppkey % 25 AS STRING) AS district",
        "IF(l_returnflag = 'R', l_partkey, NULL) AS residential_complex_id", "CAST(NULL AS STRING) AS address_raw",
        f"IF(l_linenumber > 1, concat('квартира в ЖК «', {spelt}, '» срочно'), 'дом с садом') AS description")
    known = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id")).where("id % 2 = 0").selectExpr(
        "id", "name", "replace(name, ' ', '') AS match_key", "CAST(NULL AS STRING) AS district")
    return known, *dictionary.backfill(rows, known)


@query("complex_backfill", _BACKFILL + """ SELECT l.id, coalesce(l.linked, o.kid) AS known_id, coalesce(k.key, o.key, f.key) AS match_key,
    coalesce(k.p_name, o.p_name, f.name) AS complex_name, f.district AS district
  FROM l LEFT JOIN known k ON k.kid = l.linked LEFT JOIN known o ON l.linked IS NULL AND l.spelt IS NOT NULL AND o.key = l.key
    LEFT JOIN fresh f ON l.linked IS NULL AND l.spelt IS NOT NULL AND f.key = l.key""")
def complex_backfill(spark, sf_dir):
    """L2 and L4: every listing's complex afterwards; ids of new complexes are hashes and not shown."""
    known, grown, updated, _ = _backfilled(spark, sf_dir)
    named = grown.select(F.col("id").alias("residential_complex_id"), F.col("name").alias("complex_name"), "match_key",
                         F.col("district").alias("complex_district"))
    old = known.select(F.col("id").alias("residential_complex_id"), F.lit(True).alias("old"))
    out = updated.join(named, "residential_complex_id", "left").join(old, "residential_complex_id", "left")
    is_new = F.col("old").isNull() & F.col("match_key").isNotNull()
    return out.select("id", F.when(~is_new, F.col("residential_complex_id")).alias("known_id"), "match_key", "complex_name",
                      F.col("complex_district").alias("district"))


@query("complex_backfill_report", _BACKFILL + """ SELECT (SELECT count(*) FROM l WHERE linked IS NULL) AS scanned, (SELECT count(*) FROM seen) AS updated""")
def complex_backfill_report(spark, sf_dir):
    """L2: the report, which is all that a dry run shows."""
    return _backfilled(spark, sf_dir)[3]


@query("source_tokens", """WITH t AS (SELECT doc_id, left(regexp_replace(text, '[^A-Za-z0-9_-]', '', 'g'), 64) AS token, lang FROM documents)
  SELECT doc_id, nullif(token, '') AS token, CASE WHEN doc_id % 4 IN (0, 2) THEN 'uz' ELSE 'ru' END AS language FROM t""")
def source_tokens(spark, sf_dir):
    """Texts as acquisition labels, and language codes in several forms."""
    code = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('UZ-', coalesce(lang, '')) WHEN 1 THEN NULL WHEN 2 THEN 'uz' ELSE lang END")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.source_token(F.col("text")).alias("token"), T.language(code).alias("language"))
