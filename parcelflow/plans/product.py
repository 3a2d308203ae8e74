"""Product analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelflow.operators.previous import with_previous
from parcelflow.operators.quantiles import grouped_ranks, nearest_rank


def _now(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _days(n: int) -> Column:
    return F.expr(f"INTERVAL {n} DAYS")


def source_health(runs: DataFrame, as_of: str, *, stale_minutes: int = 60) -> DataFrame:
    """Status of each source, worst reason first: down, error, stale, empty, ok."""
    now = _now(as_of)
    good = F.col("status") == "success"
    agg = runs.groupBy("source").agg(
        F.max_by("status", F.struct("started_at", "id")).alias("last_status"),
        F.max(F.when(good, F.struct("finished_at", "id", "new_count", "updated_count"))).alias("ok"),
        F.sum(F.when(good & (F.col("finished_at") >= F.date_trunc("day", now).cast("timestamp_ntz")), F.col("new_count")).otherwise(0)).alias("new_today"),
    )
    found = F.coalesce(F.col("ok.new_count") + F.coalesce(F.col("ok.updated_count"), F.lit(0)), F.lit(0))
    age = F.timestamp_diff("SECOND", F.col("ok.finished_at"), now)
    return agg.select(
        "source", "last_status", F.round(age / 3600, 1).alias("last_success_age_h"), found.alias("last_found"), "new_today",
        F.when(F.col("ok").isNull(), "down").when(F.col("last_status") == "failed", "error")
        .when(age > stale_minutes * 60, "stale").when(found == 0, "empty").otherwise("ok").alias("health"))


def auto_runs(runs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Automatic runs of the last hours and the rows they brought."""
    since = _now(as_of) - F.expr(f"INTERVAL {hours} HOURS")
    return runs.where((F.col("trigger") == "auto") & (F.col("started_at") >= since)).agg(
        F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("new_count"), F.lit(0)).alias("new_count"))


def page_statistics(payloads: DataFrame) -> DataFrame:
    """Pages, page size and totals per source from the landed payloads' own counters."""
    out = payloads.groupBy("source").agg(
        F.max("total").alias("total"), F.max("page_size").alias("page_size"), F.max("page").alias("last_page"),
        F.count(F.lit(1)).alias("landed_pages"))
    return out.withColumn("total_pages", F.coalesce(
        F.greatest(F.lit(1), F.ceil(F.try_divide(F.col("total"), F.col("page_size")))), F.col("last_page")))


def first_touch(touches: DataFrame) -> DataFrame:
    """First known source, first and last time seen per user."""
    return touches.groupBy("user_id").agg(
        F.min_by("source", F.when(F.col("source").isNotNull(), F.struct("ts", "source"))).alias("source"),
        F.min("ts").alias("created_at"), F.max("ts").alias("last_seen_at"))


def attribution(users: DataFrame, alerts: DataFrame) -> DataFrame:
    """Registrations and activations (has an alert) per source; NULL is a source of its own."""
    active = alerts.select("user_id").distinct().withColumn("__a", F.lit(1))
    out = users.join(active, "user_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("registered"), F.count("__a").alias("activated"))
    return out.withColumn("conversion", F.bround(F.col("activated") * 100.0 / F.col("registered"), 0).cast("int"))


def daily_activity(events: DataFrame) -> DataFrame:
    """K7: one row per user and day."""
    return events.select("user_id", F.to_date("ts").alias("day")).distinct()


def active_users(activity: DataFrame, as_of: str) -> DataFrame:
    """Distinct users of the day, the last 7 and the last 30 days."""
    today = F.lit(as_of).cast("date")

    # Distinct users first, so each window is a plain conditional count over one row per user.
    per_user = activity.groupBy("user_id").agg(F.max("day").alias("day"))
    return per_user.agg(
        *[F.count_if(F.col("day") >= F.date_sub(today, days - 1)).alias(name) for days, name in ((1, "dau"), (7, "wau"), (30, "mau"))])


def web_users(logins: DataFrame, as_of: str) -> DataFrame:
    """Distinct users who logged in over the last 7 and 30 days."""
    per_user = logins.groupBy("user_id").agg(F.max("ts").alias("last"))
    return per_user.agg(*[F.count_if(F.col("last") >= _now(as_of) - _days(n)).alias(f"web_users_{n}d") for n in (7, 30)])


def daily_counts(rows: DataFrame, at: str, as_of: str, days: int = 30) -> DataFrame:
    """Rows per day over the last days, days without rows included, with the maximum."""
    spark = rows.sparkSession
    last = F.lit(as_of).cast("date")
    calendar = spark.range(days).select(F.date_sub(last, F.col("id").cast("int")).alias("day"))
    counts = rows.where(F.col(at) >= _now(as_of) - _days(days)).groupBy(F.to_date(at).alias("day")).agg(
        F.count(F.lit(1)).alias("n"))
    filled = calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("count"))
    # The calendar has ``days`` rows, so one window over all of it is small.
    return filled.withColumn("max_count", F.max("count").over(Window.partitionBy(F.lit(1))))


def retention(users: DataFrame, activity: DataFrame, as_of: str, weeks: int = 8) -> DataFrame:
    """Weekly cohorts by week offset; only weeks that have begun are shown.

    Active users are counted on distinct (user, week) rows; the grid of cohorts and offsets comes
    from the calendar, so a cell without activity is a zero.
    """
    spark = users.sparkSession
    this_week = F.date_trunc("week", _now(as_of)).cast("date")
    first_week = F.date_sub(this_week, 7 * (weeks - 1))
    cohort = users.select("user_id", F.date_trunc("week", "created_at").cast("date").alias("cohort")).where(
        F.col("cohort") >= first_week)
    sizes = cohort.groupBy("cohort").agg(F.count(F.lit(1)).alias("size"))
    seen = activity.select("user_id", F.date_trunc("week", "day").cast("date").alias("week")).distinct()
    active = cohort.join(seen, "user_id").groupBy(
        "cohort", F.floor(F.datediff("week", "cohort") / 7).cast("int").alias("offset")).agg(F.count(F.lit(1)).alias("active"))
    grid = spark.range(weeks).select(F.col("id").cast("int").alias("i")).select(
        F.date_add(first_week, F.col("i") * 7).alias("cohort"),
        F.explode(F.sequence(F.lit(0), F.lit(weeks - 1) - F.col("i"))).alias("offset"))
    return grid.join(sizes, "cohort", "left").join(active, ["cohort", "offset"], "left").select(
        "cohort", "offset", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("active", F.lit(0)).alias("active"),
        F.coalesce(F.bround(F.try_divide(F.col("active") * 100.0, F.col("size")), 0).cast("int"), F.lit(0)).alias("percent"))


def active_subscription(as_of: str) -> Column:
    """C14."""
    return (F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") >= _now(as_of)))


def plan_per_user(users: DataFrame, subscriptions: DataFrame, as_of: str, *, expired_newest_is_free: bool = False) -> DataFrame:
    """Plan of the newest active subscription, free without one.

    By default expired rows are dropped before the newest is taken; with
    ``expired_newest_is_free`` the newest active row decides and an expired one means free.
    """
    newest = F.struct("created_at", "id")
    if expired_newest_is_free:
        held = subscriptions.where("status = 'active'").groupBy("user_id").agg(
            F.max_by(F.struct("plan", "expires_at"), newest).alias("s")).select(
            "user_id", F.when(F.col("s.expires_at").isNull() | (F.col("s.expires_at") >= _now(as_of)), F.col("s.plan")).alias("plan"))
    else:
        held = subscriptions.where(active_subscription(as_of)).groupBy("user_id").agg(F.max_by("plan", newest).alias("plan"))
    return users.select("user_id").join(held, "user_id", "left").withColumn("plan", F.coalesce("plan", F.lit("free")))


def user_counters(users: DataFrame, as_of: str) -> DataFrame:
    """Totals, new users and breakdowns in one pass over the users."""
    now, at = _now(as_of), F.col("created_at")
    day = F.date_trunc("day", now).cast("timestamp_ntz")
    return users.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count_if(at >= day).alias("new_today"),
        F.count_if(at >= now - _days(7)).alias("new_7d"),
        F.count_if(at >= now - _days(30)).alias("new_30d"),
        F.count_if(F.col("account_type") == "individual").alias("individuals"),
        F.count_if(F.col("account_type") == "agent").alias("agents"),
        F.count_if(F.coalesce(F.col("lang") != "uz", F.lit(True))).alias("lang_ru"),
        F.count_if(F.col("lang") == "uz").alias("lang_uz"),
    )


def alert_counters(alerts: DataFrame) -> DataFrame:
    """The alert funnel."""
    per_user = alerts.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_active").alias("on"))
    return per_user.agg(
        F.count(F.lit(1)).alias("bot_users"), F.count_if(F.col("on") > 0).alias("bot_active_users"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_alerts"), F.coalesce(F.sum("on"), F.lit(0)).alias("active_alerts"))


def plan_counters(users: DataFrame, subscriptions: DataFrame, as_of: str) -> DataFrame:
    """Users per plan; everyone without an active subscription is free."""
    held = subscriptions.where(active_subscription(as_of)).groupBy("user_id", "plan").agg(F.count(F.lit(1)).alias("n"))
    by_plan = held.groupBy("plan").agg(F.count(F.lit(1)).alias("users"))
    idle = users.select("user_id").join(held.select("user_id"), "user_id", "left_anti").agg(
        F.count(F.lit(1)).alias("users")).select(F.lit("free").alias("plan"), "users")
    return by_plan.unionByName(idle).groupBy("plan").agg(F.sum("users").alias("users"))


def latency(requests: DataFrame, *, window: str = "5 minutes") -> DataFrame:
    """Exact p50 and p95 and the request count of every window."""
    keyed = requests.select(F.window("ts", window)["start"].alias("window_start"), "duration")
    out = grouped_ranks(keyed, ["window_start"], "duration", {"p50": nearest_rank(0.50), "p95": nearest_rank(0.95)},
                        count_name="samples")
    return out.select("window_start", "samples", F.round("p50", 1).alias("p50_ms"), F.round("p95", 1).alias("p95_ms"))


def peak_concurrency(requests: DataFrame, *, inner: str = "minute", outer: str = "day") -> DataFrame:
    """The most requests in flight at once.

    Starts and ends are +1/-1 steps, summed per instant first (an end at the same instant counts
    before a start).  Running totals are added up in three levels: instants inside a minute, minutes inside a day, days.
    The widest window has one row per day.
    """
    steps = requests.select(F.explode(F.array(
        F.struct(F.col("ts").alias("t"), F.lit(1).alias("d")),
        F.struct((F.col("ts") + F.make_dt_interval(secs=F.col("duration"))).alias("t"), F.lit(-1).alias("d")),
    )).alias("s")).groupBy("s.t").agg(F.sum("s.d").alias("d")).withColumn("b", F.date_trunc(inner, "t"))
    inside = steps.withColumn("run", F.sum("d").over(
        Window.partitionBy("b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    buckets = inside.groupBy("b").agg(F.sum("d").alias("net"), F.max("run").alias("high")).withColumn("o", F.date_trunc(outer, "b"))

    def before(window) -> Column:
        return F.coalesce(F.sum("net").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    spans = buckets.withColumn("top", before(Window.partitionBy("o").orderBy("b")) + F.col("high")).groupBy("o").agg(
        F.sum("net").alias("net"), F.max("top").alias("high"))
    return spans.withColumn("peak", before(Window.orderBy("o")) + F.col("high")).agg(F.max("peak").alias("peak_inflight"))


def traffic(events: DataFrame, as_of: str, *, gap_minutes: int = 30, periods=((1, "today"), (7, "7d"), (30, "30d"))) -> DataFrame:
    """Users, visits, views, bounce rate and depth per period.

    A visit starts after a pause; it is a bounce when the next event of the user starts another
    one.  Both facts sit on the row itself, so no session has to be gathered.
    """
    pause = F.expr(f"INTERVAL {gap_minutes} MINUTES")
    rows = with_previous(events, ["user_id"], ["ts", "event_id"], ["ts"])
    rows = rows.withColumn("starts", F.col("prev").isNull() | (F.col("ts") - F.col("prev.ts") > pause)).drop("prev")
    back = rows.withColumn("__t", -F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("__i", -F.col("event_id"))
    rows = with_previous(back, ["user_id"], ["__t", "__i"], ["starts"])
    rows = rows.withColumn("bounces", F.col("starts") & F.coalesce(F.col("prev.starts"), F.lit(True)))
    today = F.lit(as_of).cast("date")
    spans = F.array(*[F.when(F.to_date("ts") >= F.date_sub(today, d - 1), F.lit(name)) for d, name in periods])
    per = rows.withColumn("period", F.explode(F.array_compact(spans)))
    users = per.groupBy("period", "user_id").agg(
        F.count(F.lit(1)).alias("views"), F.count_if("starts").alias("visits"), F.count_if("bounces").alias("bounces"))
    out = users.groupBy("period").agg(
        F.count(F.lit(1)).alias("users"), F.sum("visits").alias("visits"), F.sum("views").alias("page_views"),
        F.sum("bounces").alias("__b"))
    return out.select(
        "period", "users", "visits", "page_views",
        F.round(F.try_divide(F.col("__b") * 100, F.col("visits")), 1).alias("bounce_percent"),
        F.round(F.try_divide(F.col("page_views"), F.col("visits")), 2).alias("depth"))


def top_sources(touches: DataFrame, limit: int = 6) -> DataFrame:
    """The sources with the most rows."""
    return touches.groupBy("source").agg(F.count(F.lit(1)).alias("visits")).orderBy(F.desc("visits"), "source").limit(limit)


def recipients(users: DataFrame, after_id: int = 0) -> DataFrame:
    """Active users behind a cursor."""
    return users.where(F.col("is_active") & (F.col("user_id") > after_id)).orderBy("user_id")


def admins(users: DataFrame) -> DataFrame:
    """Active administrators that can be written to."""
    return users.where((F.col("role") == "admin") & F.col("is_active") & F.col("telegram_id").isNotNull())


def find_users(users: DataFrame, text: str) -> DataFrame:
    """By part of the name in any case, or by exact numeric id."""
    from parcelflow.operators.predicates import like_escaped

    by_name = F.col("username").ilike(like_escaped(text))
    return users.where(by_name | (F.col("user_id") == int(text)) if text.isdigit() else by_name)


def newest(rows: DataFrame, column: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Latest rows first."""
    return rows.orderBy(F.col(column).desc()).offset(offset).limit(limit)


def reply_targets(feedback: DataFrame, users: DataFrame) -> DataFrame:
    """Who a reply goes to; anonymous tickets keep a NULL target."""
    return feedback.join(users.select("user_id", "telegram_id"), "user_id", "left")
