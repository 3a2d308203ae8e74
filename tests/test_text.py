import pytest
from pyspark.sql import functions as F

from parcelflow.functions import complex_names as CN, features as FE, text as T


def apply(spark, fn, values, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r[0] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_numbers_and_currency(spark):
    assert apply(spark, T.number, ["8 071,25 руб", "цена", "", None, "4.5.6", "37$"]) == [8071.25, None, None, None, None, 37.0]
    assert apply(spark, T.currency, ["75 $", "у.е.", "640 сум", "uzs", None, "gbp"]) == ["USD", "USD", "UZS", "UZS", "USD", "USD"]
    df = spark.createDataFrame([(254000000.0, "UZS", 40.0), (33.0, "USD", 0.0)], "p double, c string, a double")
    usd = T.to_usd(F.col("p"), F.col("c"))
    assert [tuple(r) for r in df.select(usd, T.price_per_m2(usd, F.col("a"))).collect()] == [(20000.0, 500.0), (33.0, None)]


def test_floor(spark):
    df = spark.createDataFrame([("6/16",), ("на 11 ярусе",), ("неизвестно",), (None,), ("2 / 5 уровней",)], "x string")
    a, b = T.floor_pair(F.col("x"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [(6, 16), (11, None), (None, None), (None, None), (2, 5)]


def test_district_and_building(spark):
    got = apply(spark, T.district, ["город, Сергелийский р-н, сквер", "Uchtepa tumani", "за рекой", None, "БЕКТЕМИР"])
    assert got == ["Сергелийский район", "Учтепинский район", "Не указан", "Не указан", "Бектемирский район"]
    df = spark.createDataFrame([("возле парка, улица Сиреневая; дом 7",), ("кв 4",), (None,)], "x string")
    keys = [r[0] for r in df.select(T.building_key(F.lit("Алмазарский район"), F.col("x"))).collect()]
    assert keys == ["алмазарский район::парка сиреневая 7", None, None]


def test_furnished(spark):
    yes = ["Дача с  мебелью у озера", "МЕБЛИРОВАН полностью", "есть мебель и посуда", "вся кухня, мебель есть"]
    no = ["пустая, без мебели", "не  меблирован", "Офис НЕмеблированный", "не-меблирована, есть мебель у соседей"]
    unknown = ["Тихий двор и сад", "", None]
    assert apply(spark, T.furnished, yes + no + unknown) == [True] * 4 + [False] * 4 + [None] * 3
    assert apply(spark, T.yes_no, ["yes", " No ", "YeS", None, "", "maybe"]) == [True, False, True, None, None, None]


def test_rooms_and_area(spark):
    assert apply(spark, T.rooms_code, ["Studio", "7", "free_layout", "0", "many_more", None]) == [1, 7, 1, None, 5, None]
    assert apply(spark, T.rooms_in_title, ["светлая 6-комн", "2 комн.", "5 xonali uy", "30-комн", "участок"]) == [6, 2, 5, None, None]
    assert apply(spark, T.area_in_title, ["дача 88 м²", "41м2 сад", "склад 73,4 м2", "9 м2", "участок"]) == [88.0, 41.0, 73.4, None, None]


def test_segment_material_year_micro(spark):
    new = ["сдаётся НОВЫЙ ДОМ", "жилой комплекс Липа", "у City Park", "год сдачи 2020"]
    old = ["у реки, массив Себзор", "qurilgan yili 1962", "дача с садом", ""]
    low = lambda x: FE.segment(FE.blob(x))
    assert apply(spark, low, new + old) == ["new"] * 4 + ["secondary"] * 4
    mat = lambda x: FE.material(FE.blob(x))
    assert apply(spark, mat, ["кирпич и монолит", "серая панель, панели", "из G'isht", "саман"]) == ["monolith", "panel", "brick", None]
    year = lambda x: FE.year_after(FE.blob(x), FE.V.FEATURE_YEAR_HINTS)
    assert apply(spark, year, ["построен около 1974", "дом сдан в мае 2016", "год сдачи 2500", "в 2003", None]) == [1974, 2016, None, None, None]
    micro = lambda x: FE.micro_location(FE.blob(x))
    assert apply(spark, micro, ["у рынка, массив Липовый 8", "квартал 31", "дом на Ц 7", "ттз4, сад", "вид на Chorsu", "у реки"]) == [
        "липовый", "квартал-31", "ц-7", "ттз-4", "chorsu", None]


def test_instants(spark):
    got = apply(spark, T.instant, ["2019-02-28T23:59:01.5Z", "2020-12-31T08:00:00.000042-0330", "вчера", None])
    assert [str(x) if x else None for x in got] == ["2019-02-28 23:59:01.500000", "2020-12-31 08:00:00.000042", None, None]


EXTRACT = [  # a keyword of any kind, quotes of any kind, and where a name ends
    ("Дача / ЖК SILVER Birch Yard  Ремонт : новый", "SILVER Birch Yard"),
    ("офис в ЖК LakeSide, 2/3", "LakeSide"),
    ("жилой комплекс Кедровый Лог", "Кедровый Лог"),
    ("Residential Complex Juniper", "Juniper"),
    ("ЖК «Orchid Terrace» возле сада", "Orchid Terrace"),
    ("Сад у ЖК “Uzum Bog” 5 соток", "Uzum Bog"),
    ("ж/к ‘Maple Row’ близко", "Maple Row"),
    ("ж. к Waterfall, тихий двор", "Waterfall"),
    ("ЛИПОВАЯ АЛЛЕЯ и сад", None),
    ("Дача в Сергелийском районе", None),
    ("ЖК срочно", None),
    ("", None),
    (None, None),
    ("ЖК Заозёрская Квартира светлая", "Заозёрская"),
]
SAME = [  # case and space, noise words, district words, transliteration, phonetic variants
    ("Orchid Terrace", "ORCHID   TERRACE"), ("Кедровый Лог", "кедровый  лог"), ("Maple Row", "Maple Row метро"),
    ("Maple Row", "Срочно Maple Row"), ("Maple Row", "Maple Row Бектемирский"), ("Maple Row", "Maple Row блок"),
    ("Silver Birch Klub", "Silver Birch Club Учтепинский ID"), ("Lake siti", "Лаке Сити"),
    ("Orhid Avenue", "Орхид Авеню"), ("Pine Haus", "Pine House"), ("Berezka Residence", "Березка Резиденс"),
    ("Terek Tower", "Терек Тауер"),
]
DIFFERENT = [
    ("Orchid Terrace", "Orchid Avenue"), ("Orchid Avenue", "Orchid Village"), ("KLM Lily", "KLM A-Tower"),
    ("Uzum Bog", "Uzum Hill"), ("Olma Bog", "Uzum Bog"), ("Maple Row", "Maple Lane"), ("Pine Tower", "Pine Club"),
]


def test_extract_complex_name(spark):
    assert apply(spark, CN.extract_name, [t for t, _ in EXTRACT]) == [n for _, n in EXTRACT]


@pytest.mark.parametrize("pairs,equal", [(SAME, True), (DIFFERENT, False)])
def test_match_keys(spark, pairs, equal):
    left = apply(spark, CN.match_key, [a for a, _ in pairs])
    right = apply(spark, CN.match_key, [b for _, b in pairs])
    assert [a == b for a, b in zip(left, right)] == [equal] * len(pairs)


def test_place_word_as_name(spark):
    names = ["Заозёрская", "Кедровский", "Португальский", "Бектемирский"]
    assert apply(spark, CN.clean_name, names) == names
    assert all(len(k) >= 2 for k in apply(spark, CN.match_key, names))
    assert apply(spark, CN.match_key, ["Birches Учтепинский"]) == apply(spark, CN.match_key, ["Birches"])


def test_a_title_pattern_runs_once(spark):
    from parcelflow.functions import text as T

    rows = spark.createDataFrame([("3-комнат, 64 м2",), ("9 комнат",), (None,)], "t string")
    out = rows.select(T.first_in_range(F.col("t"), [r"(\d+)\s*[- ]?комнат"], 1, 8).alias("n"))
    assert [r.n for r in out.collect()] == [3.0, None, None]
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract(") == 1
