"""Word lists and lookup tables of the listing domain.

Fixed values: results agree with the source system only if these match it word for word.
"""

DISTRICT_ALIASES = [
    ("чиланзар", "Чиланзарский район"),
    ("чилонзор", "Чиланзарский район"),
    ("chilanzar", "Чиланзарский район"),
    ("мираба", "Мирабадский район"),
    ("mirabad", "Мирабадский район"),
    ("мирзо", "Мирзо-Улугбекский район"),
    ("улугбек", "Мирзо-Улугбекский район"),
    ("mirzo", "Мирзо-Улугбекский район"),
    ("ulugbek", "Мирзо-Улугбекский район"),
    ("юнусабад", "Юнусабадский район"),
    ("юнус-абад", "Юнусабадский район"),
    ("yunusabad", "Юнусабадский район"),
    ("yunus", "Юнусабадский район"),
    ("яккасарай", "Яккасарайский район"),
    ("yakkasaray", "Яккасарайский район"),
    ("яшнабад", "Яшнабадский район"),
    ("yashnobod", "Яшнабадский район"),
    ("yashnabad", "Яшнабадский район"),
    ("сергел", "Сергелийский район"),
    ("sergeli", "Сергелийский район"),
    ("алмазар", "Алмазарский район"),
    ("олмазор", "Алмазарский район"),
    ("almazar", "Алмазарский район"),
    ("учтеп", "Учтепинский район"),
    ("uchtepa", "Учтепинский район"),
    ("шайхантахур", "Шайхантахурский район"),
    ("шайхонтохур", "Шайхантахурский район"),
    ("shaykhantakhur", "Шайхантахурский район"),
    ("shayxontoxur", "Шайхантахурский район"),
    ("бектемир", "Бектемирский район"),
    ("bektemir", "Бектемирский район"),
    ("янгихаёт", "Янгихаётский район"),
    ("янгихает", "Янгихаётский район"),
    ("yangihayot", "Янгихаётский район"),
]

DISTRICT_SLUGS = {
    "Чиланзарский район": "chilanzar",
    "Мирабадский район": "mirabad",
    "Мирзо-Улугбекский район": "mirzo-ulugbek",
    "Юнусабадский район": "yunusabad",
    "Яккасарайский район": "yakkasaray",
    "Яшнабадский район": "yashnabad",
    "Сергелийский район": "sergeli",
    "Алмазарский район": "almazar",
    "Учтепинский район": "uchtepa",
    "Шайхантахурский район": "shaykhantakhur",
    "Бектемирский район": "bektemir",
    "Янгихаётский район": "yangihayot",
}

ADDRESS_STOP_WORDS = ["ул", "улица", "дом", "д", "кв", "ориентир", "возле"]

# One Cyrillic letter to one Latin letter, and the letters that need more than one.
TRANSLIT_SINGLE = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "з": "z", "и": "i", "й": "y", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h",
    "ы": "y", "э": "e", "ў": "o", "қ": "q", "ғ": "g", "ҳ": "h",
}
TRANSLIT_MULTI = {"ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "yu", "я": "ya", "ъ": "", "ь": ""}

# Letters that slugs write otherwise than match keys; letters not in either table end up as dashes.
SLUG_LETTERS = {"ц": "c"}
SLUG_UNKNOWN = ["ў", "қ", "ғ", "ҳ"]

COMPLEX_NOISE = [
    "zhk", "zhiloy", "kompleks", "residential", "complex", "id", "adres", "srochno", "srochnaya", "srochnuyu",
    "gorod", "goroda", "menyaetsya", "vash", "uvazhaemye", "gosti", "kvartira", "kvartiry", "kvartir", "kvartiru",
    "arenda", "arendu", "arenduyu", "arendoy", "prodam", "prodayu", "prodazha", "prodaetsya", "sdaetsya", "sdam",
    "sdayu", "evro", "evroremont", "evrolyuks", "remont", "remontom", "novaya", "novyy", "novoe", "novostroyka",
    "vid", "vidom", "korobka", "penthaus", "studiya", "studiyu", "komnata", "komnat", "komnaty", "komnatu",
    "ploshchad", "etazh", "dom", "doma", "ulitsa", "ul", "prospekt", "massiv", "kvartal", "mkr", "mfy", "orientir",
    "ryadom", "vozle", "near", "metro", "elitnyy", "elitnaya", "elitnom", "shikarnaya", "idealno", "idealnaya",
    "polnostyu", "dlya", "vse", "vsemi", "eksklyuziv", "tsentr", "vpervye", "predlagaetsya", "toropites", "zhivite",
    "neboskreb", "teplaya", "chistaya", "avtorskiy", "avtorskim", "kirpich", "kirpichnyy", "dvor", "gotovye",
    "gotovaya", "predlozhenie", "unikalnoe", "unikalnaya", "sovremennyy", "potryasayushchiy", "prosto", "samaya",
    "pervaya", "liniya", "sostoyanie", "harakteristiki", "osnovnye", "posrednikov", "bez", "nahoditsya", "lyuks",
    "pod", "mebel", "tehnika", "sistema", "umnyy", "dolgosrochnaya", "posutochnaya", "apartment", "for", "sale",
    "rent", "urgent", "ot", "na", "zastroy", "zastroyshchik", "blok", "block", "bloka", "korpus", "korpusa", "blic",
]

DISTRICT_TOKENS = ["rayon", "rn", "mahalla"]
DISTRICT_ENDINGS = ["skiy", "skoy", "skij", "skaya"]

PHONETIC = {
    "avenyu": "avenue", "aveny": "avenue", "avenu": "avenue",
    "siti": "city",
    "rezidens": "residence", "residens": "residence", "rezidence": "residence",
    "haus": "house", "hause": "house",
    "klab": "club", "klub": "club",
    "tauer": "tower", "tawer": "tower",
    "layf": "life",
    "bulvar": "boulevard",
    "viladzh": "village", "vilage": "village", "villadzh": "village",
    "garden": "gardens",
}

NEW_BUILD_MARKERS = [
    "новостройка", "новостройки", "новостройке", "новостроек", "новый дом", "жк ", "жк-", "жилой комплекс",
    "сдан в эксплуатацию", "ввод в эксплуатацию", "комфорт-класс", "бизнес-класс", "премиум-класс", "эконом-класс",
    "yangi qurilish", "yangi uy", "yangi bino", "turar joy majmuasi",
]
NEW_BUILD_BRANDS = [
    "boulevard", "nest one", "nest two", "tashkent city", "tashkent-city", "yangi uzbekistan", "yangi o'zbekiston",
    "akay city", "rich house", "izumrud", "qushbegi", "darhan towers", "yangi hayot", "novza city", "asson",
    "millenium", "millennium", "golden house", "manhattan", "city park",
]
SEGMENT_YEAR_HINTS = ["год постройки", "построен в", "построен ", "год сдачи", "qurilgan yili", "qurilish yili"]
FEATURE_YEAR_HINTS = ["год постройки", "построен в", "построен ", "год сдачи", "сдан в", "qurilgan yili", "qurilish yili"]

MATERIAL_MARKERS = [
    ("монолит", "monolith"), ("monolit", "monolith"),
    ("панельн", "panel"), ("панел", "panel"), ("panel uy", "panel"), ("panel ", "panel"),
    ("кирпичн", "brick"), ("кирпич", "brick"), ("g'isht", "brick"), ("gisht", "brick"),
]

KNOWN_LOCATIONS = [
    "феруза", "себзор", "sebzor", "куйлюк", "куйлук", "qoʻyliq", "qoyliq", "каракамыш", "qoraqamish", "чорсу", "chorsu",
    "хадра", "khadra", "дархан", "darxon", "новза", "novza", "лабзак", "сергели", "sergeli", "шахристон", "shahriston",
    "максим горький", "буюк ипак йули", "юнусабад", "юнусобод", "yunusabad", "yunusobod", "tashkent city",
    "tashkent-city", "boulevard", "nest one", "nest two", "akay city", "millennium", "millenium", "izumrud",
    "rich house", "city park", "manhattan", "asson", "yangi hayot", "golden house", "darhan towers", "qushbegi",
    "novza city",
]
