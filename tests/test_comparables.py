import random

import pytest
from pyspark.sql import functions as F

from helpers import listings, table
from parcelflow.operators import nearest as N
from parcelflow.operators.keys import group_key
from parcelflow.operators.nearest import Tolerant, class_key, nearest_lists, others
from parcelflow.plans import comparables as C, search
from parcelflow.queries import comparables as Q
from parcelflow.sources.storage import materialise


def compared(spark, rows):
    return C.comparables(C.features(listings(spark, rows)))


def basis(spark, rows, ident="s"):
    return compared(spark, rows).where(F.col("id") == ident).select("basis", F.size("analogs").alias("n")).first()


S = {"id": "s", "ppm": 1000.0}


def test_complex_needs_three(spark):
    same = [{"ppm": 1000.0, "complex": "X"}] * 3
    assert tuple(basis(spark, [{**S, "complex": "X"}, *same, {"ppm": 900.0}])) == ("complex", 3)
    assert tuple(basis(spark, [{**S, "complex": "X"}, same[0], {"ppm": 900.0}])) == ("district", 2)


def test_area_window(spark):
    rows = [S, *[{"ppm": 1000.0, "area_m2": a} for a in (90.0, 70.0, 130.0)]]
    assert tuple(basis(spark, rows)) == ("district", 1)


def test_relaxed_when_nothing_is_strict(spark):
    assert tuple(basis(spark, [S, {"ppm": 1000.0, "floor": 8}])) == ("district_relaxed", 1)
    assert tuple(basis(spark, [{**S, "material": "brick"}, {"ppm": 1000.0, "material": "panel"}])) == ("district_relaxed", 1)
    assert tuple(basis(spark, [{**S, "material": "brick"}, {"ppm": 1000.0}])) == ("district", 1)
    assert tuple(basis(spark, [{**S, "year_built": 1980}, {"ppm": 1000.0, "year_built": 2000}])) == ("district_relaxed", 1)
    assert basis(spark, [S, {"ppm": 1000.0, "rooms": 3}]).basis is None


def test_estimate(spark):
    rows = [{"id": "s", "ppm": 800.0, "building_key": "b"}, {"ppm": 1020.0, "building_key": "b"}, {"ppm": 1029.0, "building_key": "b"}]
    got = C.estimates(compared(spark, rows)).where("id = 's'").first()
    assert (got.market_basis, got.market_sample_size, got.is_below_market) == ("building", 2, True)
    assert got.market_price_per_m2_usd == 1024.5 and got.discount_percent == 21.91


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_against_brute_force(spark, seed):
    """Unknown attributes, ties, self exclusion and a hot group, against a plain loop."""
    rnd = random.Random(seed)
    rows = [(i, "g" if rnd.random() < 0.7 else "h", rnd.choice([40.0, 41.0, 42.5, 44.0, 60.0, rnd.uniform(30, 70)]),
             rnd.choice([None, 1, 2, 3, 4, 5, 6, 7]), rnd.choice([None, "a", "b"]), rnd.choice([None, 1970, 1980, 1990, 2000]))
            for i in range(250)]
    df = spark.createDataFrame(rows, "id int, g string, pos double, fl int, mat string, yr int")
    k, reach = 4, (0.15, 0.15)
    attrs = [Tolerant("fl", 2, routed=True), Tolerant("mat"), Tolerant("yr", 15)]
    df = df.withColumn("key", group_key("g"))
    lists = nearest_lists(df, df, key="key", position="pos", ident="id", payload=[], k=k, reach=reach, attrs=attrs)
    found = df.withColumn("class", class_key("key", attrs)).join(lists, ["class", "pos"])
    got = {r.id: list(r.ids) for r in found.select(
        "id", F.transform(others("near", "id", F.col("id"), k), lambda e: e["id"]).alias("ids")).collect()}

    def fits(a, b):
        close = lambda x, y, gap: x is None or y is None or abs(x - y) <= gap
        return (a[0] != b[0] and a[1] == b[1] and a[2] * 0.85 <= b[2] <= a[2] * 1.15 and close(a[3], b[3], 2)
                and (a[4] is None or b[4] is None or a[4] == b[4]) and close(a[5], b[5], 15))

    want = {a[0]: [b[0] for b in sorted((b for b in rows if fits(a, b)), key=lambda b: (abs(b[2] - a[2]), b[0]))][:k] for a in rows}
    assert got == want


def test_incremental_scope_holds_every_changed_estimate(spark):
    """Valuing only the neighbours of a change gives what a full rebuild gives."""
    rnd = random.Random(5)
    rows = [{"ppm": rnd.uniform(800, 1200), "district": rnd.choice("DE"), "complex": rnd.choice(["X", None]),
             "rooms": rnd.choice([1, 2])} for _ in range(40)]
    before, after = [dict(r) for r in rows], [dict(r) for r in rows]
    after[3]["ppm"] = 700.0
    changed = spark.createDataFrame([("4",)], "id string")
    cols = ["id", "market_price_per_m2_usd", "market_basis"]
    old = {r[0]: tuple(r) for r in C.estimates(compared(spark, before)).select(*cols).collect()}
    base = C.features(listings(spark, after))
    new = {r[0]: tuple(r) for r in C.estimates(C.comparables(base)).select(*cols).collect()}
    was = C.features(listings(spark, before))
    part = {r[0]: tuple(r) for r in C.estimates(C.comparables(base, C.changed_and_neighbours(was, base, changed))).select(*cols).collect()}
    assert {**old, **part} == new
    assert len(part) < len(rows)


def test_incremental_scope_follows_removed_moved_and_placeless_rows(spark):
    rows = [{"ppm": 900.0 + 7 * i, "district": d, "complex": None, "rooms": 2} for i, d in enumerate([*"DDDDEEEE", None, None])]
    before = C.features(listings(spark, rows))
    after_rows = listings(spark, rows).where("id <> '1'").withColumn("district", F.expr("IF(id = '5', 'D', district)"))
    after = C.features(after_rows)
    changed = spark.createDataFrame([("1",), ("5",), ("9",)], "id string")
    scope = {r.id for r in C.changed_and_neighbours(before, after, changed).collect()}
    assert scope == {"2", "3", "4", "5", "6", "7", "8", "9", "10"}
    only = {r.id for r in C.changed_and_neighbours(before, after, changed.where("id = '9'")).collect()}
    assert only == {"9", "10"}


@pytest.mark.parametrize("unknown", [True, False])
def test_nearest_routes_every_equal_attribute(spark, unknown):
    """Candidates meet classes of their own material and floor block only; unknown values meet all."""
    rnd = random.Random(7)
    maybe = [None] if unknown else []
    rows = [(i, rnd.choice([40.0, 41.0, 43.0]), rnd.choice([*maybe, -3, -1, 0, 1, 2, 5, 7]), rnd.choice([*maybe, "a", "b", "?", "*"])) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, pos double, fl int, mat string").withColumn("key", group_key(F.lit("g")))
    attrs = [Tolerant("fl", 2, routed=True), Tolerant("mat", routed=True)]
    lists = nearest_lists(df, df, key="key", position="pos", ident="id", payload=[], k=3, reach=(0.15, 0.15), attrs=attrs)
    got = {r.id: list(r.ids) for r in df.withColumn("class", class_key("key", attrs)).join(lists, ["class", "pos"]).select(
        "id", F.transform(others("near", "id", F.col("id"), 3), lambda e: e["id"]).alias("ids")).collect()}

    def fits(a, b):
        return (a[0] != b[0] and (a[2] is None or b[2] is None or abs(a[2] - b[2]) <= 2) and (a[3] is None or b[3] is None or a[3] == b[3]))

    want = {a[0]: [b[0] for b in sorted((b for b in rows if fits(a, b)), key=lambda b: (abs(b[1] - a[1]), b[0]))][:3] for a in rows}
    assert got == want


def test_later_tiers_search_open_subjects_only(spark, monkeypatch):
    """Listings that their complex values ask no later tier, and a tier that nobody asks is left out; class keys stay short."""
    asked = []

    def counted(subjects, *args, **kwargs):
        asked.append(sorted(r.id for r in subjects.select("id").collect()))
        return nearest_lists(subjects, *args, **kwargs)

    monkeypatch.setattr(C, "nearest_lists", counted)
    rows = [*[{"ppm": 1000.0, "complex": "X"}] * 4, {"ppm": 900.0, "complex": "Y"}, {"ppm": 900.0, "district": "far"}]
    got = {r.id: r.basis for r in compared(spark, rows).collect()}
    assert got == {**dict.fromkeys("1234", "complex"), "5": "district", "6": None}
    assert asked == [["1", "2", "3", "4", "5"], ["5", "6"], ["6"]]
    key = spark.range(1).select(class_key(group_key(F.lit("a" * 100)), []).alias("k")).first().k
    assert len(key) == 16


@pytest.mark.parametrize("routed", [True, False])
def test_nearest_over_many_chunks(spark, monkeypatch, routed):
    """Groups that part across chunks, subjects that are no candidates and ties over a narrow part of the reach; one shuffle, and no join of lists."""
    monkeypatch.setattr(N, "CHUNK_ROWS", 7)
    monkeypatch.setattr(N, "CHUNK_PAIRS", 5)
    rnd = random.Random(11)
    rows = [(i, rnd.choice("gh"), rnd.choice([10.0, 10.1, 11.0, 11.4, 12.0, 50.0]), rnd.choice([None, 1, 2, 3, 9]), rnd.choice([None, "a", "b"]), rnd.random() < 0.7)
            for i in range(120)]
    df = spark.createDataFrame(rows, "id int, g string, pos double, fl int, mat string, offered boolean").withColumn("key", group_key("g"))
    attrs = [Tolerant("fl", 2, routed=routed), Tolerant("mat", routed=routed)]
    lists = nearest_lists(df, df.where("offered"), key="key", position="pos", ident="id", payload=["mat"], k=3, reach=(0.15, 0.15), attrs=attrs, carry=["id", "g"])
    assert lists.columns == ["id", "g", "near"]
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Window" not in plan
    got = {r.id: [(e.distance, e.id, e.pos, e.mat) for e in r.near] for r in lists.collect()}

    def fits(a, b):
        return (b[5] and a[1] == b[1] and a[2] * 0.85 <= b[2] <= a[2] * 1.15 and (a[3] is None or b[3] is None or abs(a[3] - b[3]) <= 2)
                and (a[4] is None or b[4] is None or a[4] == b[4]))

    want = {a[0]: [(abs(b[2] - a[2]), b[0], b[2], b[4]) for b in sorted((b for b in rows if fits(a, b)), key=lambda b: (abs(b[2] - a[2]), b[0]))][:4] for a in rows}
    assert got == want


def test_analog_lists_are_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(C, "materialise", lambda df, label: written.append(df.columns) or materialise(df, label))
    rows = [*[{"ppm": 1000.0, "complex": "X"}] * 4, {"ppm": 900.0, "complex": "Y"}]
    assert compared(spark, rows).where("analogs IS NOT NULL").count() == 5
    assert written and not any("analogs" in columns for columns in written)


def test_analog_places_sort_as_the_window_does(spark):
    """Every sort of a subject's own table, with unknown figures and ties, gives the places of a window over the subject."""
    rows = [(1, "b", 40.0, 7.0, 1.5, None, "district"), (2, "a", 40.0, None, 1.5, 2.0, "district"), (3, "c", 41.0, 7.0, -3.0, 2.0, "district")]
    pairs = spark.createDataFrame(rows, "rank int, analog_id string, analog_area_m2 double, analog_price_usd double, analog_ppm double, diff_percent double, basis string")
    table = pairs.agg(F.collect_list(F.struct(*pairs.columns)).alias("t"))
    for key in ("price", "area", "ppm", "rank", "diff", "basis", "id"):
        for down in (False, True):
            got = table.select(search.analog_places("t", key, down).alias("p")).first().p
            want = [r.rank for r in pairs.orderBy(*search.analog_order(key, down)).collect()]
            assert got == want, (key, down)


def test_incremental_values_a_listing_once(spark, sf, monkeypatch):
    """Subjects are the neighbours of changes in the new rows and the kept listings in the old ones, not all listings again."""
    asked = []

    def seen(rows, subjects=None):
        asked.append({r.id for r in subjects.select("id").collect()})
        return subjects.select("*", F.lit(None).cast("string").alias("basis"), F.lit(None).cast("array<struct<price_usd:double,price_per_m2_usd:double>>").alias("analogs"))

    monkeypatch.setattr(C, "comparables", seen)
    found = {r.id for r in Q.incremental_estimates(spark, sf).collect()}
    assert len(asked) == 2 and not asked[0] & asked[1] and asked[0] | asked[1] == found


def test_a_listing_that_meets_only_its_own_id_has_no_figures(spark):
    """Rows of one id count as each other's analogs and leave an empty list."""
    rows = [{"id": "s", "ppm": 1000.0, "complex": None}] * 2
    got = C.analog_stats(compared(spark, rows)).select("basis", "analog_count", "median_ppm").collect()
    assert [tuple(r) for r in got] == [("district", 0, None)] * 2
