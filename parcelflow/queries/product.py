"""Product analytics over events and orders."""

from pyspark.sql import functions as F

from parcelflow.plans import product
from parcelflow.queries.alerts import alert_rows
from parcelflow.queries.proxy import EVENTS_AS_OF, table
from parcelflow.queries.registry import R, query

_NOW = f"{EVENTS_AS_OF} 00:00:00"
_RUNS_NOW = "2001-08-01 12:00:00"

_RUNS = """WITH runs AS (SELECT o_orderkey AS id, o_orderpriority AS source,
    CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
    CASE WHEN o_custkey % 2 = 0 THEN 'auto' ELSE 'manual' END AS trigger, o_orderkey % 5 AS new_count, o_orderkey % 2 AS updated_count,
    o_orderdate AS started_at, o_orderdate AS finished_at FROM orders)"""


def runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_orderpriority AS source",
        "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'running' END AS status",
        "IF(o_custkey % 2 = 0, 'auto', 'manual') AS trigger", "o_orderkey % 5 AS new_count", "o_orderkey % 2 AS updated_count",
        "o_orderdate AS started_at", "o_orderdate AS finished_at")


@query("source_health", _RUNS + f""", g AS (SELECT source, arg_max(status, (started_at, id)) AS last_status,
    max(finished_at) FILTER (status = 'success') AS ok_at,
    arg_max(new_count + updated_count, (finished_at, id)) FILTER (status = 'success') AS found,
    coalesce(sum(new_count) FILTER (status = 'success' AND finished_at >= DATE '2001-08-01'), 0)::BIGINT AS new_today FROM runs GROUP BY source)
  SELECT source, last_status, {R(f"date_diff('second', ok_at, TIMESTAMP '{_RUNS_NOW}') / 3600", 1)} AS last_success_age_h,
    coalesce(found, 0) AS last_found, new_today,
    CASE WHEN ok_at IS NULL THEN 'down' WHEN last_status = 'failed' THEN 'error'
      WHEN date_diff('second', ok_at, TIMESTAMP '{_RUNS_NOW}') > 2880 * 60 THEN 'stale' WHEN coalesce(found, 0) = 0 THEN 'empty' ELSE 'ok' END AS health
  FROM g""")
def source_health(spark, sf_dir):
    return product.source_health(runs(spark, sf_dir), _RUNS_NOW, stale_minutes=2880)


@query("auto_runs_24h", _RUNS + """ SELECT count(*) AS runs, coalesce(sum(new_count), 0)::BIGINT AS new_count FROM runs
  WHERE trigger = 'auto' AND started_at >= TIMESTAMP '2001-07-31 12:00:00'""")
def auto_runs_24h(spark, sf_dir):
    return product.auto_runs(runs(spark, sf_dir), _RUNS_NOW)


def touches(spark, sf_dir):
    """The event type stands for the acquisition label; errors carry none."""
    return table(spark, sf_dir, "events").select(
        "user_id", "ts", F.expr("IF(event_type = 'error', NULL, event_type)").alias("source"))


_USERS = """WITH users AS (SELECT user_id, arg_min(event_type, (ts, event_type)) FILTER (event_type <> 'error') AS source,
    min(ts) AS created_at, max(ts) AS last_seen_at FROM events GROUP BY user_id)"""


@query("first_touch", _USERS + " SELECT * FROM users")
def first_touch(spark, sf_dir):
    return product.first_touch(touches(spark, sf_dir))


@query("attribution", _USERS + """, active AS (SELECT DISTINCT c_custkey AS user_id FROM customer WHERE c_mktsegment = 'MACHINERY')
  SELECT source, count(*) AS registered, count(a.user_id) AS activated,
    CAST(round_even(count(a.user_id) * 100.0 / count(*), 0) AS INTEGER) AS conversion FROM users u LEFT JOIN active a ON a.user_id = u.user_id GROUP BY source""")
def attribution(spark, sf_dir):
    users = product.first_touch(touches(spark, sf_dir))
    return product.attribution(users, alert_rows(spark, sf_dir).join(
        table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").selectExpr("c_custkey AS user_id"), "user_id", "left_semi"))


@query("daily_activity", "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events")
def daily_activity(spark, sf_dir):
    return product.daily_activity(table(spark, sf_dir, "events"))


@query("dau_wau_mau", """SELECT count(DISTINCT user_id) FILTER (ts >= DATE '2024-01-30') AS dau,
  count(DISTINCT user_id) FILTER (ts >= DATE '2024-01-24') AS wau, count(DISTINCT user_id) FILTER (ts >= DATE '2024-01-01') AS mau FROM events""")
def dau_wau_mau(spark, sf_dir):
    return product.active_users(product.daily_activity(table(spark, sf_dir, "events")), "2024-01-30")


@query("daily_gapfill", f"""WITH days AS (SELECT CAST(d AS DATE) AS day FROM range(DATE '2024-01-02', DATE '2024-02-01', INTERVAL 1 DAY) t(d)),
  n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '{_NOW}' - INTERVAL 30 DAY GROUP BY 1),
  f AS (SELECT days.day, coalesce(n, 0) AS count FROM days LEFT JOIN n ON n.day = days.day)
  SELECT day, count, (SELECT max(count) FROM f) AS max_count FROM f""")
def daily_gapfill(spark, sf_dir):
    return product.daily_counts(table(spark, sf_dir, "events").where("event_type = 'signup'"), "ts", _NOW)


@query("retention", _USERS + f""", c AS (SELECT user_id, CAST(date_trunc('week', created_at) AS DATE) AS cohort FROM users
    WHERE created_at >= DATE '2023-12-11'),
  a AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM events),
  grid AS (SELECT CAST(DATE '2023-12-11' + INTERVAL (7 * i) DAY AS DATE) AS cohort, CAST(o AS INTEGER) AS offset_
    FROM range(8) w(i), range(8) x(o) WHERE o <= 7 - i),
  s AS (SELECT cohort, count(*) AS size FROM c GROUP BY cohort),
  v AS (SELECT cohort, date_diff('day', cohort, week) // 7 AS offset_, count(*) AS active FROM c JOIN a USING (user_id) GROUP BY ALL)
  SELECT cohort, offset_ AS "offset", coalesce(size, 0) AS size, coalesce(active, 0) AS active,
    CAST(coalesce(round_even(active * 100.0 / size, 0), 0) AS INTEGER) AS percent
  FROM grid LEFT JOIN s USING (cohort) LEFT JOIN v USING (cohort, offset_)""")
def retention(spark, sf_dir):
    users = product.first_touch(touches(spark, sf_dir))
    return product.retention(users, product.daily_activity(table(spark, sf_dir, "events")), _NOW)


@query("dashboard_counters", _USERS + """ SELECT count(*) AS total_users, count(*) FILTER (created_at >= DATE '2024-01-10') AS new_today,
    count(*) FILTER (created_at >= DATE '2024-01-03') AS new_7d, count(*) FILTER (created_at >= DATE '2023-12-11') AS new_30d,
    count(*) FILTER (source IN ('view', 'click')) AS individuals, count(*) FILTER (source = 'purchase') AS agents,
    count(*) FILTER (user_id % 3 <> 0) AS lang_ru, count(*) FILTER (user_id % 3 = 0) AS lang_uz FROM users""")
def dashboard_counters(spark, sf_dir):
    users = product.first_touch(touches(spark, sf_dir)).withColumns({
        "account_type": F.expr("CASE WHEN source IN ('view', 'click') THEN 'individual' WHEN source = 'purchase' THEN 'agent' END"),
        "lang": F.expr("IF(user_id % 3 = 0, 'uz', 'ru')")})
    return product.user_counters(users, "2024-01-10 00:00:00")


@query("recipients", _USERS + " SELECT user_id FROM users WHERE last_seen_at >= DATE '2024-01-20' AND user_id > 20")
def recipients(spark, sf_dir):
    users = product.first_touch(touches(spark, sf_dir)).withColumn("is_active", F.expr("last_seen_at >= TIMESTAMP_NTZ '2024-01-20 00:00:00'"))
    return product.recipients(users, 20).select("user_id")


@query("find_users", "SELECT c_custkey AS user_id, c_name AS username FROM customer WHERE c_name ILIKE '%77%' OR c_custkey = 77")
def find_users(spark, sf_dir):
    return product.find_users(table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "c_name AS username"), "77")


@query("newest_runs", _RUNS + " SELECT id, source, status, started_at FROM runs ORDER BY id DESC LIMIT 50")
def newest_runs(spark, sf_dir):
    return product.newest(runs(spark, sf_dir), "id").select("id", "source", "status", "started_at")


@query("reply_targets", """SELECT conv_id, turn, c_name AS telegram_id FROM conversations LEFT JOIN customer ON c_custkey = conv_id""")
def reply_targets(spark, sf_dir):
    """Conversation turns stand for tickets, customers for their authors."""
    tickets = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "conv_id AS user_id")
    users = table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "c_name AS telegram_id")
    return product.reply_targets(tickets, users).select("conv_id", "turn", "telegram_id")


@query("latency_percentiles", f"""WITH r AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)
  SELECT w AS window_start, n AS samples, {R("v[CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1]", 1)} AS p50_ms,
    {R("v[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1]", 1)} AS p95_ms FROM r""")
def latency_percentiles(spark, sf_dir):
    return product.latency(table(spark, sf_dir, "events").select("ts", F.col("value").alias("duration")))


@query("latency_daily", f"""WITH r AS (SELECT date_trunc('day', ts)::TIMESTAMP AS w, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)
  SELECT w AS window_start, n AS samples, {R("v[CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1]", 1)} AS p50_ms,
    {R("v[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1]", 1)} AS p95_ms FROM r""")
def latency_daily(spark, sf_dir):
    return product.latency(table(spark, sf_dir, "events").select("ts", F.col("value").alias("duration")), window="1 day")


@query("peak_concurrency", """WITH steps AS (SELECT ts AS t, 1 AS d FROM events UNION ALL
    SELECT ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)), -1 FROM events),
  r AS (SELECT sum(d) OVER (ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS run FROM steps) SELECT max(run)::BIGINT AS peak_inflight FROM r""")
def peak_concurrency(spark, sf_dir):
    """Values stand for minutes in flight."""
    return product.peak_concurrency(table(spark, sf_dir, "events").select(
        "ts", (F.round(F.col("value") * 60000000) / 1000000).alias("duration")))


@query("traffic_summary", f"""WITH g AS (SELECT *, lag(ts) OVER w AS p, lead(ts) OVER w AS nx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  f AS (SELECT *, p IS NULL OR ts - p > INTERVAL 30 MINUTE AS starts, nx IS NULL OR nx - ts > INTERVAL 30 MINUTE AS last FROM g),
  per AS (SELECT period, f.* FROM f JOIN (VALUES ('today', 0), ('7d', 6), ('30d', 29)) t(period, back)
    ON CAST(ts AS DATE) >= CAST(DATE '2024-01-30' - INTERVAL (back) DAY AS DATE))
  SELECT period, count(DISTINCT user_id) AS users, count(*) FILTER (starts) AS visits, count(*) AS page_views,
    {R('count(*) FILTER (starts AND last) * 100.0 / count(*) FILTER (starts)', 1)} AS bounce_percent,
    {R('count(*) / count(*) FILTER (starts)', 2)} AS depth FROM per GROUP BY period""")
def traffic_summary(spark, sf_dir):
    return product.traffic(table(spark, sf_dir, "events"), "2024-01-30")


@query("traffic_sources", "SELECT event_type AS source, count(*) AS visits FROM events GROUP BY 1 ORDER BY visits DESC, source LIMIT 6")
def traffic_sources(spark, sf_dir):
    return product.top_sources(table(spark, sf_dir, "events").withColumnRenamed("event_type", "source"))


@query("web_users", f"""SELECT count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY) AS web_users_7d,
  count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '{_NOW}' - INTERVAL 30 DAY) AS web_users_30d FROM events WHERE event_type = 'signup'""")
def web_users(spark, sf_dir):
    """Sign-up events stand for logins."""
    return product.web_users(table(spark, sf_dir, "events").where("event_type = 'signup'"), _NOW)


@query("admins", "SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 7 = 0 AND c_acctbal > 0 AND c_nationkey <> 3")
def admins(spark, sf_dir):
    """A seventh of the customers administrate; debtors are inactive, one nation cannot be written to."""
    users = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS user_id", "IF(c_custkey % 7 = 0, 'admin', 'user') AS role", "c_acctbal > 0 AS is_active",
        "IF(c_nationkey <> 3, c_custkey, NULL) AS telegram_id")
    return product.admins(users).select("user_id")
