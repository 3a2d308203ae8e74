"""Business constants; every operator takes them as overridable arguments."""

# They must equal the source system's figures for results to agree.
UZS_PER_USD = 12700.0
PRICE_FLOOR = {"sale": 5000.0, "rent": 50.0}
PPM_FLOOR = {"sale": 100.0, "rent": 0.3}
SANE_PPM = {"sale": (400.0, 3000.0), "rent": (2.0, 60.0)}
BELOW_MARKET_PERCENT = 15.0
MAX_DISCOUNT_PERCENT = 30.0
MIN_BUILDING_SAMPLES = 5
MIN_DISTRICT_SAMPLES = 3
AREA_TOLERANCE = 0.15
MAX_ANALOGS = 20
MIN_COMPLEX_ANALOGS = 3
YEAR_GAP = 15
FLOOR_GAP = 2
NEW_BUILD_YEAR = 2015
RELIST_GAP_DAYS = 3
DELIST_AFTER_DAYS = 3
PRICE_DROP_MIN = 0.01
DUPLICATE_PRICE_TOLERANCE = 0.05
COMPLEX_MIN_LISTINGS = 5
YIELD_MIN_SAMPLES = 5
YIELD_RANGE_PERCENT = (1.0, 20.0)
AGENT_MIN_LISTINGS = 3
HUB_MIN_LISTINGS = 3
HUB_LIST_LIMIT = 48
FX_NOISE_RATIO = (0.90, 1.02)
PROBE_PRICE_TOLERANCE = 0.01
PLAN_ALERT_CAP = {"free": 1, "pro": 5, "agent": None}
UNSPECIFIED_DISTRICT = "Не указан"
MAX_PAGE = 200
MAX_PHOTOS = {"flat_api": 8, "nested_api": 8, "offer_page": 5}
MAX_ADDRESS = 180
