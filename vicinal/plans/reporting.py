"""Daily rollups, read models over them, and the snapshot.

All days are rolled up in one job: a row's business day is computed from its instant, and each source is aggregated
once by day. A trailing window is the same job over a filtered source, written with dynamic partition overwrite.
"""

from __future__ import annotations

import datetime as dt

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.gathering import count_where, total
from ..functions.times import attribution_days, business_day, ZONE

# Event types that make a user active on a day.
ACTIVE_TYPES = ("user_login_succeeded", "search_performed", "post_created", "favorite_created", "like_created", "comment_created", "follow_created")
#: Kinds of interactions and the names of their counts.
CONVERSIONS = {"result_click": "clicks", "store_open": "opens", "favorite": "favorites", "review_created": "reviews"}
DIMENSIONS = ("category", "product", "style", "location", "price_intent")
INTENT = "categories string, product_terms string, style_terms string, location_text string, price_intent string"


def clamped(limit: int, default: int = 20, most: int = 100) -> int:
    return limit if 1 <= limit <= most else default


def dated(df: DataFrame, zone: str = ZONE) -> DataFrame:
    return df.withColumn("metric_date", business_day(F.col("created_at"), zone))


def _counts(rows: DataFrame, day: Column, **counters: Column) -> DataFrame:
    return rows.groupBy(day.alias("metric_date")).agg(*(c.alias(n) for n, c in counters.items())).where("metric_date is not null")


def _lifetimes(rows: DataFrame, name: str, zone: str) -> DataFrame:
    """Rows that appear on a day (``new_``) and that are gone at its end (``gone_``)."""
    created, deleted = business_day(F.col("created_at"), zone), business_day(F.col("deleted_at"), zone)
    new = _counts(rows, created, **{f"new_{name}": F.count("*")})
    gone = _counts(rows.where("deleted_at is not null"), F.greatest(created, deleted), **{f"gone_{name}": F.count("*")})
    return new.unionByName(gone, allowMissingColumns=True)


def span(t, zone: str = ZONE) -> DataFrame:
    """One row (a, z): the first and the last business day of users, searches and events; none for empty tables."""
    ends = reduce(DataFrame.union, [x.agg(F.min("created_at").alias("a"), F.max("created_at").alias("z")) for x in (t.users, t.searches, t.platform_events)])
    return ends.agg(business_day(F.min("a"), zone).alias("a"), business_day(F.max("z"), zone).alias("z")).where("a is not null")


def platform_daily(t, zone: str = ZONE, days: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """39 measures for every business day between the first and the last of users, searches and events.

    Totals at the end of a day are running sums over one row per day. Rows of likes, follows and favorites carry no
    history of removals, so their totals are the current ones on every day. days: one row (a, z), other ends of the span.
    before: rows (metric_date, searches_count) for searches that ``t`` leaves out and that count in totals.
    """
    day = business_day(F.col("created_at"), zone)
    has = lambda *kinds: count_where(F.col("event_type").isin(*kinds))
    events = _counts(
        t.platform_events, day,
        active_users_count=F.countDistinct(F.when(F.col("event_type").isin(*ACTIVE_TYPES), F.col("user_id"))),
        posts_deleted_count=has("post_deleted"), location_rejected_post_attempts=has("post_location_rejected"), new_likes_count=has("like_created"), new_follows_count=has("follow_created"),
        new_favorites_count=has("favorite_created"), otp_requests_count=has("otp_requested"), successful_auth_count=has("user_login_succeeded"), failed_auth_count=has("user_login_failed", "otp_verification_failed"),
    )
    searches = _counts(
        t.searches, day,
        anonymous_visitors_count=F.countDistinct("visitor_session_id"), searches_count=F.count("*"), searches_with_results_count=count_where(F.col("total_result_count") > 0),
        zero_result_searches_count=count_where(F.col("total_result_count") == 0), authenticated_searches_count=count_where(F.col("user_id").isNotNull()), anonymous_searches_count=count_where(F.col("user_id").isNull()),
        ai_searches_count=count_where(F.col("ai_used")), google_places_searches_count=count_where(F.col("google_places_used")),
    )
    shown = t.search_results.groupBy("search_id").count().join(t.searches.select(F.col("id").alias("search_id"), "created_at"), "search_id")
    impressions = _counts(shown, day, search_result_impressions_count=F.sum("count"))
    interactions = _counts(t.search_interactions, day, search_result_clicks_count=has("result_click"), store_opens_from_search_count=has("store_open"), favorites_from_search_count=has("favorite"), reviews_from_search_count=has("review_created"))
    sources = t.store_external_sources.where("provider = 'google'").groupBy("store_id").agg(F.min("created_at").alias("created_at"))
    imported = sources.join(t.stores.select(F.col("id").alias("store_id"), "deleted_at"), "store_id")
    media = _counts(t.media, day, new_media_count=F.count("*"), live_media=count_where(F.col("status") != "deleted"))
    verified = _counts(t.posts.where("visit_verified"), day, verified_posts_count=F.count("*"))
    lifetimes = [_lifetimes(rows, name, zone) for name, rows in (("users", t.users), ("stores", t.stores), ("imported", imported), ("posts", t.posts), ("comments", t.comments))]
    facts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [events, searches, impressions, interactions, media, verified, *lifetimes, *([] if before is None else [before])])
    daily = facts.groupBy("metric_date").agg(*(total(F.col(c)).alias(c) for c in facts.columns if c != "metric_date"))
    spine = (span(t, zone) if days is None else days).select(F.explode(F.sequence("a", "z")).alias("metric_date"), F.lit(True).alias("in_span"))
    # Days before the span count in the totals, so all days go through the running sums.
    days = daily.join(spine, "metric_date", "full").fillna(0)
    upto = W.orderBy("metric_date").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = lambda *parts: sum((s * F.sum(c).over(upto) for s, c in parts[1:]), parts[0][0] * F.sum(parts[0][1]).over(upto))
    now = [x.agg(F.count("*").alias(n)) for n, x in (("likes_current_total", t.likes), ("follows_current_total", t.follows), ("favorites_current_total", t.favorites))]
    totals = days.withColumns(
        {
            "registered_users_total": running((1, "new_users"), (-1, "gone_users")), "stores_total": running((1, "new_stores"), (-1, "gone_stores")), "google_imported_stores_total": running((1, "new_imported"), (-1, "gone_imported")),
            "posts_current_total": running((1, "new_posts"), (-1, "gone_posts")), "posts_created_lifetime": running((1, "new_posts")), "comments_current_total": running((1, "new_comments"), (-1, "gone_comments")),
            "searches_total": running((1, "searches_count")), "media_current_total": running((1, "live_media")),
        }
    )
    named = totals.where("in_span").withColumnsRenamed({"new_users": "new_users_count", "new_stores": "new_stores_count", "new_posts": "new_posts_count", "new_comments": "new_comments_count"})
    current = reduce(lambda a, b: a.join(b), now)  # one row each
    return named.join(F.broadcast(current)).select("metric_date", *MEASURES)


#: The measures of a day, in the order in which they are stored.
MEASURES = (
    "registered_users_total", "new_users_count", "active_users_count", "anonymous_visitors_count", "stores_total", "new_stores_count", "google_imported_stores_total", "posts_current_total", "posts_created_lifetime",
    "new_posts_count", "posts_deleted_count", "verified_posts_count", "location_rejected_post_attempts", "comments_current_total", "new_comments_count", "likes_current_total", "new_likes_count", "follows_current_total",
    "new_follows_count", "favorites_current_total", "new_favorites_count", "searches_total", "searches_count", "searches_with_results_count", "zero_result_searches_count", "authenticated_searches_count",
    "anonymous_searches_count", "ai_searches_count", "google_places_searches_count", "search_result_impressions_count", "search_result_clicks_count", "store_opens_from_search_count", "favorites_from_search_count",
    "reviews_from_search_count", "media_current_total", "new_media_count", "otp_requests_count", "successful_auth_count", "failed_auth_count",
)
#: Totals, which the daily series leaves out.
SERIES = tuple(m for m in MEASURES if not m.endswith(("_total", "_lifetime")) and m not in ("posts_deleted_count", "new_media_count"))


def conversions(interactions: DataFrame, key: str) -> DataFrame:
    """Counts of each kind of conversion for a search or a result, before anything is joined to them."""
    return interactions.where(F.col(key).isNotNull()).groupBy(key).agg(*(count_where(F.col("event_type") == k).alias(n) for k, n in CONVERSIONS.items()))


def query_daily(t, zone: str = ZONE) -> DataFrame:
    """Searches by day, normalised query and language."""
    rows = dated(t.searches, zone).join(conversions(t.search_interactions, "search_id").withColumnRenamed("search_id", "id"), "id", "left")
    out = rows.groupBy("metric_date", "normalized_query", F.col("query_language").alias("raw_language")).agg(
        F.count("*").alias("search_count"), F.countDistinct("user_id").alias("unique_user_count"), F.countDistinct("visitor_session_id").alias("unique_visitor_count"), total(F.col("total_result_count")).alias("result_count_total"),
        count_where(F.col("total_result_count") == 0).alias("zero_result_count"), total(F.col("clicks")).alias("result_click_count"), total(F.col("opens")).alias("store_open_count"), total(F.col("favorites")).alias("favorite_count"),
        total(F.col("reviews")).alias("review_count"), count_where(F.col("ai_used")).alias("ai_search_count"), count_where(F.col("google_places_used")).alias("google_places_search_count"),
    )
    fingerprint = F.sha2(F.concat(F.coalesce("raw_language", F.lit("unknown")), F.lit(":"), F.col("normalized_query")).cast("binary"), 256)
    return out.withColumns({"query_fingerprint": fingerprint, "query_language": F.coalesce("raw_language", F.lit("tr"))}).drop("raw_language")


#: Registers of a sketch are 2 to this power: a standard error of 1.04 / sqrt(2 ** 12), 1.6 %.
SKETCH_BITS = 12


def query_sketches(t, zone: str = ZONE) -> DataFrame:
    """Sketches of the users and visitors behind the counts of ``query_daily``, by the same day, query and language.

    Distinct counts of days can't be added up without counting people twice; sketches can be united over any days.
    """
    rows = dated(t.searches, zone).withColumn("query_language", F.coalesce("query_language", F.lit("tr")))
    return rows.groupBy("metric_date", "normalized_query", "query_language").agg(F.hll_sketch_agg("user_id", SKETCH_BITS).alias("user_sketch"), F.hll_sketch_agg("visitor_session_id", SKETCH_BITS).alias("visitor_sketch"))


def distinct_people(sketches: DataFrame, first: str, last: str, keys: tuple[str, ...] = ("normalized_query", "query_language")) -> DataFrame:
    """Estimated different users and visitors over a span of days, from the days' sketches."""
    united = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c))
    return between(sketches, first, last).groupBy(*keys).agg(united("user_sketch").alias("user_count"), united("visitor_sketch").alias("visitor_count"))


def intent_daily(t, zone: str = ZONE) -> DataFrame:
    """Searches by day, dimension of the parsed intent, value and language, in one pass over the searches."""
    intent = F.from_json("parsed_intent", INTENT)
    rows = dated(t.searches, zone).select("metric_date", F.coalesce("query_language", F.lit("tr")).alias("query_language"), intent.alias("i"))
    several = lambda field, name: F.transform(F.coalesce(F.from_json(F.col(f"i.{field}"), "array<string>"), F.array()), lambda v: F.struct(F.lit(name).alias("dimension"), v.alias("value")))
    one = lambda field, name: F.array(F.struct(F.lit(name).alias("dimension"), F.nullif(F.col(f"i.{field}"), F.lit("")).alias("value")))
    all_values = F.concat(several("categories", "category"), several("product_terms", "product"), several("style_terms", "style"), one("location_text", "location"), one("price_intent", "price_intent"))
    found = rows.select("metric_date", "query_language", F.inline(all_values)).where("value is not null")
    return found.groupBy("metric_date", "dimension", "value", "query_language").agg(F.count("*").alias("search_count"))


def store_daily(t, zone: str = ZONE) -> DataFrame:
    """Impressions and conversions by the search's day and the store, or the provider's place where there is no store."""
    days = dated(t.searches, zone).select(F.col("id").alias("search_id"), "metric_date")
    key = F.coalesce(F.col("store_id").cast("string"), F.concat(F.col("external_provider"), F.lit(":"), F.col("external_place_id")))
    shown = t.search_results.withColumn("result_key", key).where("result_key is not null").join(days, "search_id")
    rows = shown.join(conversions(t.search_interactions, "search_result_id").withColumnRenamed("search_result_id", "id"), "id", "left")
    return rows.groupBy("metric_date", "result_key").agg(
        F.max("store_id").alias("store_id"), F.max("external_provider").alias("external_provider"), F.max("external_place_id").alias("external_place_id"), F.count("*").alias("impression_count"), total(F.col("clicks")).alias("click_count"),
        total(F.col("opens")).alias("open_count"), total(F.col("favorites")).alias("favorite_count"), total(F.col("reviews")).alias("review_count"), F.max("platform_review_count_at_time").alias("platform_review_count_latest"),
    )


def locale_daily(t, zone: str = ZONE, days: DataFrame | None = None) -> DataFrame:
    """Six uses of languages by day. Preferences and devices are counted as they are at the end of each day of the span,
    whose ends ``days`` (one row, a and z) may tell."""
    by_day = lambda rows, name, zero, ai: dated(rows, zone).groupBy("metric_date", F.lit(name).alias("dimension"), "locale").agg(F.count("*").alias("event_count"), zero.alias("zero_result_count"), ai.alias("ai_fallback_count"))
    none = F.sum(F.lit(0)).cast("long")
    queries = t.searches.where("query_language is not null").withColumnRenamed("query_language", "locale")
    flows = [
        by_day(queries, "search_query", count_where(F.col("total_result_count") == 0), count_where(F.col("fallback_state").like("%ai_%"))),
        by_day(t.visitor_sessions.where("locale is not null"), "anonymous_session", none, none),
        by_day(t.email_outbox, "email", none, none),
        by_day(t.notification_outbox, "notification", none, none),
    ]
    days = span(t, zone) if days is None else days
    states = [_state_daily(t.users.withColumnRenamed("preferred_locale", "locale"), "deleted_at", "user_preference", days, zone), _state_daily(t.push_devices, "disabled_at", "push_device", days, zone)]
    return reduce(DataFrame.unionByName, flows + states)


def _state_daily(rows: DataFrame, end: str, name: str, days: DataFrame, zone: str) -> DataFrame:
    created, gone = business_day(F.col("created_at"), zone), business_day(F.col(end), zone)
    steps = rows.select("locale", created.alias("metric_date"), F.lit(1).alias("step"), F.lit(False).alias("in_span"))
    steps = steps.union(rows.where(F.col(end).isNotNull()).select("locale", F.greatest(created, gone), F.lit(-1), F.lit(False)))
    grid = rows.select("locale").distinct().join(F.broadcast(days)).select("locale", F.explode(F.sequence("a", "z")), F.lit(0), F.lit(True))
    changed = steps.union(grid).groupBy("locale", "metric_date").agg(F.sum("step").alias("step"), F.max("in_span").alias("in_span"))
    count = F.sum("step").over(W.partitionBy("locale").orderBy("metric_date").rowsBetween(W.unboundedPreceding, W.currentRow))
    out = changed.withColumn("event_count", count).where("in_span and event_count > 0")
    return out.select("metric_date", F.lit(name).alias("dimension"), "locale", "event_count", F.lit(0).cast("long").alias("zero_result_count"), F.lit(0).cast("long").alias("ai_fallback_count"))


# Read models. ``daily`` and the like are rollups, computed here or read from where they were written.


def between(daily: DataFrame, first: str, last: str) -> DataFrame:
    return daily.where(F.col("metric_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def daily_series(daily: DataFrame, first: str, last: str) -> DataFrame:
    return between(daily, first, last).select("metric_date", *SERIES).orderBy("metric_date")


OVERVIEW = ("searches_count", "searches_with_results_count", "zero_result_searches_count", "authenticated_searches_count", "anonymous_searches_count", "ai_searches_count", "google_places_searches_count", "search_result_impressions_count", "search_result_clicks_count", "store_opens_from_search_count", "favorites_from_search_count", "reviews_from_search_count")
FUNNEL = ("searches_count", "searches_with_results_count", "store_opens_from_search_count", "favorites_from_search_count", "reviews_from_search_count")


def sums(daily: DataFrame, first: str, last: str, measures=OVERVIEW) -> DataFrame:
    """One row of sums, zeros for an empty range."""
    return between(daily, first, last).agg(*(total(F.col(m)).alias(m) for m in measures))


QUERY_SUMS = ("search_count", "unique_user_count", "unique_visitor_count", "result_count_total", "zero_result_count", "result_click_count", "store_open_count", "favorite_count", "review_count")


def top_queries(daily: DataFrame, first: str, last: str, limit: int = 20, locale: str = "", zero_only: bool = False) -> DataFrame:
    """Queries by their searches, or by those without results. Distinct users of a range are the sum of the days'."""
    rows = between(daily, first, last)
    if zero_only:
        rows = rows.where("zero_result_count > 0")
    if locale:
        rows = rows.where(F.col("query_language") == locale)
    found = rows.groupBy("normalized_query", "query_language").agg(*(total(F.col(m)).alias(m) for m in QUERY_SUMS))
    return found.orderBy(F.desc("zero_result_count" if zero_only else "search_count"), "normalized_query", "query_language").limit(clamped(limit))


def top_dimensions(daily: DataFrame, first: str, last: str, dimension: str, locale: str = "", limit: int = 20) -> DataFrame:
    if dimension not in DIMENSIONS:
        raise ValueError(f"no such dimension: {dimension}")
    rows = between(daily, first, last).where(F.col("dimension") == dimension)
    if locale:
        rows = rows.where(F.col("query_language") == locale)
    language = F.col("query_language") if locale else F.lit("")
    return rows.groupBy("dimension", "value", language.alias("query_language")).agg(total(F.col("search_count")).alias("search_count")).orderBy(F.desc("search_count"), "value", "query_language").limit(clamped(limit))


def top_stores(daily: DataFrame, first: str, last: str, order: str = "impression_count", limit: int = 20, most_reviews: int | None = None) -> DataFrame:
    """Stores by impressions or clicks; with ``most_reviews`` only those that had fewer reviews at their latest."""
    found = between(daily, first, last).groupBy("result_key").agg(
        F.max("store_id").alias("store_id"), F.max("external_provider").alias("external_provider"), F.max("external_place_id").alias("external_place_id"),
        *(total(F.col(m)).alias(m) for m in ("impression_count", "click_count", "open_count", "favorite_count", "review_count")), F.max("platform_review_count_latest").alias("platform_review_count"),
    )
    if most_reviews is not None:
        found = found.where(F.coalesce("platform_review_count", F.lit(0)) < most_reviews)
    return found.orderBy(F.desc(order), "result_key").limit(clamped(limit))


def snapshot(t) -> DataFrame:
    """One row of current totals from the tables themselves."""
    live = count_where(F.col("deleted_at").isNull())
    imported = t.store_external_sources.where("provider = 'google'").join(t.stores.where("deleted_at is null").select(F.col("id").alias("store_id")), "store_id", "left_semi")
    parts = [
        t.users.agg(live.alias("registered_users_total")), t.stores.agg(live.alias("stores_total")), imported.agg(F.countDistinct("store_id").alias("google_imported_stores_total")),
        t.posts.agg(live.alias("posts_current_total"), F.count("*").alias("posts_created_lifetime"), count_where(F.col("deleted_at").isNotNull()).alias("posts_deleted_lifetime")), t.comments.agg(live.alias("comments_current_total")),
        t.likes.agg(F.count("*").alias("likes_current_total")), t.follows.agg(F.count("*").alias("follows_current_total")), t.favorites.agg(F.count("*").alias("favorites_current_total")),
        t.searches.agg(F.count("*").alias("searches_lifetime")), t.media.agg(count_where(F.col("status") != "deleted").alias("media_current_total")),
    ]
    return reduce(lambda a, b: a.join(b), parts)  # one row each


# The days that a job takes anew.


def trailing_days(today: str, attribution_hours: int = 72) -> tuple[str, str]:
    """The first and last business day that are taken anew: today, and as many before as an attribution may reach."""
    last = dt.date.fromisoformat(today)
    return str(last - dt.timedelta(days=attribution_days(attribution_hours))), str(last)
