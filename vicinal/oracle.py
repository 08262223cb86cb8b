"""DuckDB SQL that says the same as the named queries, over the raw tables."""

from __future__ import annotations

from .functions.geo import bounding_box
from .functions.text import MARKED, PLAIN, fold_literal
from .plans import intent as I
from .queries import ACTOR, AS_OF, CENTRE, ERASED_USERS, FIRST, LAST, LATE_DAYS, LATE_LIMITS, LATE_MAIL, LETTERS, REQUESTS, STATE, STORE, TOKEN_KEY, USER, VIEWER
from .sources.canonical import inlined

DAY = "CAST((created_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Istanbul' AS DATE)"


def day(column: str) -> str:
    return DAY.replace("created_at", column)


def metres(lat: str, lon: str, centre=CENTRE) -> str:
    a, b = centre
    x = f"(pow(sin(radians({a} - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({a})) * pow(sin(radians({b} - {lon}) / 2), 2))"
    return f"(12742000.0 * atan2(sqrt({x}), sqrt(1 - {x})))"


def folded(x: str) -> str:
    return f"translate(replace({x}, 'ß', 'ss'), '{MARKED}', '{PLAIN}')"


def low(x: str) -> str:
    return f"lower(translate({x}, 'İ', 'i'))"


TOKENS = "list_filter(regexp_split_to_array({}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def tokens(x: str) -> str:
    return TOKENS.format(low(x))


# Rollups.

SPAN = f"""span AS (SELECT min({DAY}) AS a, max({DAY}) AS z FROM (SELECT created_at FROM {{users}} UNION ALL SELECT created_at FROM {{searches}} UNION ALL SELECT created_at FROM {{platform_events}})),
spine AS (SELECT CAST(unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d FROM span)"""


def _asof(table: str, deleted: str = "deleted_at") -> str:
    return f"(SELECT count(*) FROM (SELECT {DAY} AS c, {day(deleted)} AS x FROM {table}) q WHERE c <= d AND (x IS NULL OR x > d))"


def _by_day(name: str, table: str, **measures: str) -> str:
    return f"{name} AS (SELECT {DAY} AS d, " + ", ".join(f"{v} AS {k}" for k, v in measures.items()) + f" FROM {table} GROUP BY 1)"


def _has(*kinds: str) -> str:
    return "count(*) FILTER (WHERE event_type IN (" + ", ".join(f"'{k}'" for k in kinds) + "))"


PLATFORM_DAILY = f"""WITH {SPAN},
{_by_day("e", "{platform_events}", active_users_count="count(DISTINCT user_id) FILTER (WHERE event_type IN ('user_login_succeeded', 'search_performed', 'post_created', 'favorite_created', 'like_created', 'comment_created', 'follow_created'))",
         posts_deleted_count=_has("post_deleted"), location_rejected_post_attempts=_has("post_location_rejected"), new_likes_count=_has("like_created"), new_follows_count=_has("follow_created"), new_favorites_count=_has("favorite_created"),
         otp_requests_count=_has("otp_requested"), successful_auth_count=_has("user_login_succeeded"), failed_auth_count=_has("user_login_failed", "otp_verification_failed"))},
{_by_day("s", "{searches}", anonymous_visitors_count="count(DISTINCT visitor_session_id)", searches_count="count(*)", searches_with_results_count="count(*) FILTER (WHERE total_result_count > 0)",
         zero_result_searches_count="count(*) FILTER (WHERE total_result_count = 0)", authenticated_searches_count="count(user_id)", anonymous_searches_count="count(*) FILTER (WHERE user_id IS NULL)",
         ai_searches_count="count(*) FILTER (WHERE ai_used)", google_places_searches_count="count(*) FILTER (WHERE google_places_used)")},
{_by_day("i", "{search_interactions}", search_result_clicks_count=_has("result_click"), store_opens_from_search_count=_has("store_open"), favorites_from_search_count=_has("favorite"), reviews_from_search_count=_has("review_created"))},
{_by_day("r", "(SELECT s.created_at FROM {search_results} r JOIN {searches} s ON s.id = r.search_id) q", search_result_impressions_count="count(*)")},
{_by_day("u", "{users}", new_users_count="count(*)")}, {_by_day("st", "{stores}", new_stores_count="count(*)")}, {_by_day("p", "{posts}", new_posts_count="count(*)", verified_posts_count="count(*) FILTER (WHERE visit_verified)")},
{_by_day("c", "{comments}", new_comments_count="count(*)")}, {_by_day("m", "{media}", new_media_count="count(*)")},
imported AS (SELECT x.store_id, min(x.created_at) AS created_at, any_value(st.deleted_at) AS deleted_at FROM {{store_external_sources}} x JOIN {{stores}} st ON st.id = x.store_id WHERE x.provider = 'google' GROUP BY x.store_id)
SELECT d AS metric_date, {_asof("{users}")} AS registered_users_total, {_asof("{stores}")} AS stores_total, {_asof("imported")} AS google_imported_stores_total, {_asof("{posts}")} AS posts_current_total,
  (SELECT count(*) FROM {{posts}} WHERE {DAY} <= d) AS posts_created_lifetime, {_asof("{comments}")} AS comments_current_total, (SELECT count(*) FROM {{likes}}) AS likes_current_total,
  (SELECT count(*) FROM {{follows}}) AS follows_current_total, (SELECT count(*) FROM {{favorites}}) AS favorites_current_total, (SELECT count(*) FROM {{searches}} WHERE {DAY} <= d) AS searches_total,
  (SELECT count(*) FROM {{media}} WHERE status <> 'deleted' AND {DAY} <= d) AS media_current_total,
  coalesce(new_users_count, 0) AS new_users_count, coalesce(active_users_count, 0) AS active_users_count, coalesce(anonymous_visitors_count, 0) AS anonymous_visitors_count, coalesce(new_stores_count, 0) AS new_stores_count,
  coalesce(new_posts_count, 0) AS new_posts_count, coalesce(posts_deleted_count, 0) AS posts_deleted_count, coalesce(verified_posts_count, 0) AS verified_posts_count, coalesce(location_rejected_post_attempts, 0) AS location_rejected_post_attempts,
  coalesce(new_comments_count, 0) AS new_comments_count, coalesce(new_likes_count, 0) AS new_likes_count, coalesce(new_follows_count, 0) AS new_follows_count, coalesce(new_favorites_count, 0) AS new_favorites_count,
  coalesce(searches_count, 0) AS searches_count, coalesce(searches_with_results_count, 0) AS searches_with_results_count, coalesce(zero_result_searches_count, 0) AS zero_result_searches_count,
  coalesce(authenticated_searches_count, 0) AS authenticated_searches_count, coalesce(anonymous_searches_count, 0) AS anonymous_searches_count, coalesce(ai_searches_count, 0) AS ai_searches_count,
  coalesce(google_places_searches_count, 0) AS google_places_searches_count, coalesce(search_result_impressions_count, 0) AS search_result_impressions_count, coalesce(search_result_clicks_count, 0) AS search_result_clicks_count,
  coalesce(store_opens_from_search_count, 0) AS store_opens_from_search_count, coalesce(favorites_from_search_count, 0) AS favorites_from_search_count, coalesce(reviews_from_search_count, 0) AS reviews_from_search_count,
  coalesce(new_media_count, 0) AS new_media_count, coalesce(otp_requests_count, 0) AS otp_requests_count, coalesce(successful_auth_count, 0) AS successful_auth_count, coalesce(failed_auth_count, 0) AS failed_auth_count
FROM spine LEFT JOIN e USING (d) LEFT JOIN s USING (d) LEFT JOIN i USING (d) LEFT JOIN r USING (d) LEFT JOIN u USING (d) LEFT JOIN st USING (d) LEFT JOIN p USING (d) LEFT JOIN c USING (d) LEFT JOIN m USING (d)"""

CONVERSIONS = ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {n}" for k, n in (("result_click", "clicks"), ("store_open", "opens"), ("favorite", "favorites"), ("review_created", "reviews")))

QUERY_DAILY = f"""WITH ia AS (SELECT search_id, {CONVERSIONS} FROM {{search_interactions}} GROUP BY search_id)
SELECT {DAY} AS metric_date, sha256(coalesce(query_language, 'unknown') || ':' || normalized_query) AS query_fingerprint, normalized_query, coalesce(query_language, 'tr') AS query_language, count(*) AS search_count,
  count(DISTINCT user_id) AS unique_user_count, count(DISTINCT visitor_session_id) AS unique_visitor_count, sum(total_result_count)::BIGINT AS result_count_total, count(*) FILTER (WHERE total_result_count = 0) AS zero_result_count,
  coalesce(sum(clicks), 0)::BIGINT AS result_click_count, coalesce(sum(opens), 0)::BIGINT AS store_open_count, coalesce(sum(favorites), 0)::BIGINT AS favorite_count, coalesce(sum(reviews), 0)::BIGINT AS review_count,
  count(*) FILTER (WHERE ai_used) AS ai_search_count, count(*) FILTER (WHERE google_places_used) AS google_places_search_count
FROM {{searches}} s LEFT JOIN ia ON ia.search_id = s.id GROUP BY {DAY}, normalized_query, s.query_language"""


def _values_of(field: str, name: str) -> str:
    return f"SELECT metric_date, query_language, '{name}' AS dimension, unnest(CASE WHEN json_type(parsed_intent, '$.{field}') = 'ARRAY' THEN from_json(json_extract(parsed_intent, '$.{field}'), '[\"VARCHAR\"]') ELSE [] END) AS value FROM ds"


def _value_of(field: str, name: str) -> str:
    return f"SELECT metric_date, query_language, '{name}', nullif(json_extract_string(parsed_intent, '$.{field}'), '') FROM ds"


INTENT_DAILY = f"""WITH ds AS (SELECT {DAY} AS metric_date, coalesce(query_language, 'tr') AS query_language, parsed_intent FROM {{searches}}),
dims AS ({_values_of("categories", "category")} UNION ALL {_values_of("product_terms", "product")} UNION ALL {_values_of("style_terms", "style")} UNION ALL {_value_of("location_text", "location")} UNION ALL {_value_of("price_intent", "price_intent")})
SELECT metric_date, dimension, value, query_language, count(*) AS search_count FROM dims WHERE value IS NOT NULL GROUP BY ALL"""

STORE_DAILY = f"""WITH ia AS (SELECT search_result_id, {CONVERSIONS} FROM {{search_interactions}} WHERE search_result_id IS NOT NULL GROUP BY search_result_id),
ri AS (SELECT r.*, {day("s.created_at")} AS metric_date, coalesce(r.store_id::VARCHAR, r.external_provider || ':' || r.external_place_id) AS result_key FROM {{search_results}} r JOIN {{searches}} s ON s.id = r.search_id)
SELECT metric_date, result_key, max(store_id) AS store_id, max(external_provider) AS external_provider, max(external_place_id) AS external_place_id, count(*) AS impression_count, coalesce(sum(clicks), 0)::BIGINT AS click_count,
  coalesce(sum(opens), 0)::BIGINT AS open_count, coalesce(sum(favorites), 0)::BIGINT AS favorite_count, coalesce(sum(reviews), 0)::BIGINT AS review_count, max(platform_review_count_at_time) AS platform_review_count_latest
FROM ri LEFT JOIN ia ON ia.search_result_id = ri.id WHERE result_key IS NOT NULL GROUP BY metric_date, result_key"""


def _flow(name: str, table: str, locale: str = "locale", zero: str = "0", ai: str = "0") -> str:
    return f"SELECT {DAY} AS metric_date, '{name}' AS dimension, {locale} AS locale, count(*) AS event_count, ({zero})::BIGINT AS zero_result_count, ({ai})::BIGINT AS ai_fallback_count FROM {table} WHERE {locale} IS NOT NULL GROUP BY ALL"


def _state(name: str, table: str, locale: str, end: str) -> str:
    return f"SELECT d, '{name}', locale, count(*), 0::BIGINT, 0::BIGINT FROM spine JOIN (SELECT {locale} AS locale, {DAY} AS c, {day(end)} AS x FROM {table}) q ON c <= d AND (x IS NULL OR x > d) GROUP BY ALL"


LOCALE_DAILY = f"""WITH {SPAN}
{_flow("search_query", "{searches}", "query_language", "count(*) FILTER (WHERE total_result_count = 0)", "count(*) FILTER (WHERE fallback_state LIKE '%ai_%')")}
UNION ALL {_flow("anonymous_session", "{visitor_sessions}")} UNION ALL {_flow("email", "{email_outbox}")} UNION ALL {_flow("notification", "{notification_outbox}")}
UNION ALL {_state("user_preference", "{users}", "preferred_locale", "deleted_at")} UNION ALL {_state("push_device", "{push_devices}", "locale", "disabled_at")}"""

RANGE = f"metric_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"


ENDS = f"ends AS (SELECT min({DAY}) AS a, max({DAY}) AS z FROM (SELECT created_at FROM {{users}} UNION ALL SELECT created_at FROM {{searches}} UNION ALL SELECT created_at FROM {{platform_events}}))"
#: The log of runs: a rebuild before a third of the last days' searches came, a daily run, one that failed, one at work.
RUNS = f"""WITH {ENDS},
early AS (SELECT count(*) AS n FROM ({INTENT_DAILY.replace("FROM {searches}", f"FROM {{searches}} WHERE NOT ({DAY} >= (SELECT z - 3 FROM ends) AND id % 3 = 0)")})),
daily AS (SELECT count(*) AS n FROM ({INTENT_DAILY}), ends WHERE metric_date BETWEEN z - 3 AND z)
SELECT 'rebuild' AS run_type, a AS from_date, z AS to_date, 'completed' AS status, TIMESTAMP '2001-12-01 00:00:00' AS started_at, TIMESTAMP '2001-12-01 01:00:00' AS finished_at, early.n AS rows, NULL::VARCHAR AS error FROM ends, early
UNION ALL SELECT 'daily', z - 3, z, 'completed', TIMESTAMP '2001-12-01 02:00:00', TIMESTAMP '2001-12-01 03:00:00', daily.n, NULL FROM ends, daily
UNION ALL SELECT 'daily', z - 3, z, 'failed', TIMESTAMP '2001-12-01 04:00:00', TIMESTAMP '2001-12-01 05:00:00', NULL, 'aggregation failed' FROM ends
UNION ALL SELECT 'daily', z, z, 'running', TIMESTAMP '2001-12-01 06:00:00', NULL, NULL, NULL FROM ends"""


def _sums(*names: str) -> str:
    return ", ".join(f"coalesce(sum({n}), 0)::BIGINT AS {n}" for n in names)


def _over(daily: str, rest: str) -> str:
    """``rest`` reads the rollup as the table ``daily``."""
    head, _, body = daily.partition("WITH ")
    return f"SELECT * FROM (WITH daily AS ({daily}) {rest}) q" if not head else body


OVERVIEW = ("searches_count", "searches_with_results_count", "zero_result_searches_count", "authenticated_searches_count", "anonymous_searches_count", "ai_searches_count", "google_places_searches_count", "search_result_impressions_count", "search_result_clicks_count", "store_opens_from_search_count", "favorites_from_search_count", "reviews_from_search_count")
FUNNEL = ("searches_count", "searches_with_results_count", "store_opens_from_search_count", "favorites_from_search_count", "reviews_from_search_count")
SERIES = "metric_date, new_users_count, active_users_count, anonymous_visitors_count, new_stores_count, new_posts_count, verified_posts_count, location_rejected_post_attempts, new_comments_count, new_likes_count, new_follows_count, new_favorites_count, searches_count, searches_with_results_count, zero_result_searches_count, authenticated_searches_count, anonymous_searches_count, ai_searches_count, google_places_searches_count, search_result_impressions_count, search_result_clicks_count, store_opens_from_search_count, favorites_from_search_count, reviews_from_search_count, otp_requests_count, successful_auth_count, failed_auth_count"
QUERY_SUMS = _sums("search_count", "unique_user_count", "unique_visitor_count", "result_count_total", "zero_result_count", "result_click_count", "store_open_count", "favorite_count", "review_count")


def _top_queries(where: str, order: str, limit: int) -> str:
    return _over(QUERY_DAILY, f"SELECT normalized_query, query_language, {QUERY_SUMS} FROM daily WHERE {RANGE} {where} GROUP BY ALL ORDER BY sum({order}) DESC, normalized_query, query_language LIMIT {limit}")


def _top_stores(first: str, last: str, order: str, having: str = "") -> str:
    return _over(
        STORE_DAILY,
        f"SELECT result_key, max(store_id) AS store_id, max(external_provider) AS external_provider, max(external_place_id) AS external_place_id, {_sums('impression_count', 'click_count', 'open_count', 'favorite_count', 'review_count')}, max(platform_review_count_latest) AS platform_review_count "
        f"FROM daily WHERE metric_date BETWEEN DATE '{first}' AND DATE '{last}' GROUP BY result_key {having} ORDER BY sum({order}) DESC, result_key LIMIT 20",
    )


SNAPSHOT = """SELECT (SELECT count(*) FROM {users} WHERE deleted_at IS NULL) AS registered_users_total, (SELECT count(*) FROM {stores} WHERE deleted_at IS NULL) AS stores_total,
  (SELECT count(DISTINCT x.store_id) FROM {store_external_sources} x JOIN {stores} s ON s.id = x.store_id WHERE x.provider = 'google' AND s.deleted_at IS NULL) AS google_imported_stores_total,
  (SELECT count(*) FROM {posts} WHERE deleted_at IS NULL) AS posts_current_total, (SELECT count(*) FROM {posts}) AS posts_created_lifetime, (SELECT count(deleted_at) FROM {posts}) AS posts_deleted_lifetime,
  (SELECT count(*) FROM {comments} WHERE deleted_at IS NULL) AS comments_current_total, (SELECT count(*) FROM {likes}) AS likes_current_total, (SELECT count(*) FROM {follows}) AS follows_current_total,
  (SELECT count(*) FROM {favorites}) AS favorites_current_total, (SELECT count(*) FROM {searches}) AS searches_lifetime, (SELECT count(*) FROM {media} WHERE status <> 'deleted') AS media_current_total"""

# Catalogue.


def _items(stores: str, viewer: int | None, centre, locale: str = "tr", as_of: str = AS_OF) -> str:
    """CTE ``items`` over the stores that ``stores`` selects."""
    distance = f"round({metres('s.latitude', 's.longitude', centre)}, 4)" if centre else "NULL::DOUBLE"
    raw = metres("s.latitude", "s.longitude", centre) if centre else "0.0"
    return f"""picked AS ({stores}), items AS (SELECT s.id AS store_id, coalesce((SELECT display_name FROM {{store_translations}} x WHERE x.store_id = s.id AND x.locale = '{locale}'), s.name) AS name, s.slug, coalesce(s.brand_name, '') AS brand_name,
  coalesce(s.address, '') AS address, s.city, coalesce(s.district, '') AS district, coalesce(s.phone, '') AS phone, round(s.latitude, 4) AS latitude, round(s.longitude, 4) AS longitude, {distance} AS distance_meters,
  coalesce((SELECT string_agg(c.slug, ',' ORDER BY c.slug) FROM {{store_category_links}} l JOIN {{store_categories}} c ON c.id = l.category_id WHERE l.store_id = s.id), '') AS categories,
  coalesce((SELECT string_agg(n.name, ',' ORDER BY c.slug) FROM {{store_category_links}} l JOIN {{store_categories}} c ON c.id = l.category_id JOIN {{store_category_translations}} n ON n.category_id = c.id AND n.locale = '{locale}' WHERE l.store_id = s.id), '') AS labels,
  coalesce((SELECT x.description FROM {{store_translations}} x WHERE x.store_id = s.id AND x.locale = '{locale}'), s.description, '') AS description, round(ss.average_rating, 4) AS average_rating, ss.rating_count, ss.review_count, ss.favorite_count, ss.post_count, s.is_premium,
  EXISTS (SELECT 1 FROM {{favorites}} f WHERE f.store_id = s.id AND f.user_id = {viewer if viewer is not None else "NULL"}) AS viewer_favorited,
  coalesce((SELECT json_extract_string(x.attribution, '$.photo_name') FROM {{store_external_sources}} x WHERE x.store_id = s.id AND x.provider = 'google' AND x.refreshed_at > TIMESTAMP '{as_of} 00:00:00' - INTERVAL 30 DAY), '') AS photo,
  coalesce((SELECT array_to_string(from_json(json_extract(x.attribution, '$.photo_attributions'), '["VARCHAR"]'), ',') FROM {{store_external_sources}} x WHERE x.store_id = s.id AND x.provider = 'google' AND x.refreshed_at > TIMESTAMP '{as_of} 00:00:00' - INTERVAL 30 DAY), '') AS photo_attributions,
  coalesce((SELECT arg_max(m.id, (p.created_at, -pm.position, m.id)) FROM {{post_media}} pm JOIN {{posts}} p ON p.id = pm.post_id JOIN {{media}} m ON m.id = pm.media_id WHERE p.store_id = s.id AND p.deleted_at IS NULL AND m.status = 'ready'), '') AS own_photo,
  {raw} AS raw_distance, s.name AS stored_name
FROM picked s JOIN {{store_stats}} ss ON ss.store_id = s.id)"""


HIDDEN = "EXCLUDE (raw_distance, stored_name)"
LIVE = "SELECT * FROM {stores} WHERE deleted_at IS NULL"


def _share(name: str, words: tuple[str, ...]) -> str:
    found = f"list_distinct({tokens(name)})"
    return f"(len(list_intersect({found}, [{', '.join(repr(w) for w in words)}])) / greatest(len({found}), 1))"


NAME_WORDS = "coalesce(name, '') || ' ' || coalesce(brand_name, '')"
ALL_WORDS = "coalesce(name, '') || ' ' || coalesce(brand_name, '') || ' ' || coalesce(description, '') || ' ' || coalesce(city, '') || ' ' || coalesce(district, '')"
_N = tokens(NAME_WORDS)
_W = tokens(ALL_WORDS)
_TEXT = f"(' ' || array_to_string({_N}, ' ') || ' ')"
BY_NAME = f"""WITH staged AS (SELECT *, CASE WHEN list_has_all({_N}, ['shiny', 'red', 'widget']) THEN 0 WHEN contains({_TEXT}, ' shiny red widget ') THEN 1 WHEN contains({_TEXT}, ' shiny red ') THEN 2 WHEN contains({_TEXT}, ' red widget ') THEN 3
  WHEN list_has_any({_N}, ['shiny', 'red', 'widget']) THEN 1000000 END AS stage FROM {{stores}} WHERE deleted_at IS NULL), best AS (SELECT min(stage) AS best FROM staged),
{_items("SELECT staged.* FROM staged, best WHERE stage = best", VIEWER, CENTRE)}
SELECT items.* {HIDDEN}, stage, round({_share("stored_name || ' ' || brand_name", ("shiny", "red", "widget"))}, 4) AS rank_proxy FROM items JOIN staged ON staged.id = store_id
ORDER BY {_share("stored_name || ' ' || items.brand_name", ("shiny", "red", "widget"))} DESC, raw_distance, review_count DESC, store_id LIMIT 20""".replace("(stored_name || ' ' || brand_name)", "(stored_name || ' ' || items.brand_name)").replace("stored_name || ' ' || brand_name", "stored_name || ' ' || items.brand_name")


def _search(where: str, words: tuple[str, ...], limit: int) -> str:
    return f"""WITH {_items(f"SELECT * FROM {{stores}} WHERE deleted_at IS NULL AND {where}", VIEWER, CENTRE)}
SELECT items.* {HIDDEN}, round({_share("stored_name || ' ' || brand_name", words)}, 4) AS rank_proxy FROM items ORDER BY {_share("stored_name || ' ' || brand_name", words)} DESC, raw_distance, review_count DESC, store_id LIMIT {limit}"""


_ALL_TEXT = f"(' ' || array_to_string({_W}, ' ') || ' ')"
SEARCH = _search(
    f"((list_contains({_W}, 'widget') OR (contains({_ALL_TEXT}, ' small ring ') AND NOT list_contains({_W}, 'blue'))) OR EXISTS (SELECT 1 FROM {{store_category_links}} l JOIN {{store_categories}} c ON c.id = l.category_id WHERE l.store_id = {{stores}}.id AND c.slug = 'carpet')) "
    f"AND (lower(city) LIKE '%antalya%' OR lower(coalesce(district, '')) LIKE '%antalya%') AND {metres('latitude', 'longitude')} <= 20000",
    ("widget", "small", "ring"), 50,
)
CLASSIC = f"""SELECT row_number() OVER (ORDER BY rank_proxy DESC, raw_distance, review_count DESC, store_id) AS rank, store_id, 'internal' AS source, average_rating, review_count, favorite_count, post_count, CAST(floor(raw_distance + 0.5) AS INT) AS distance_meters
FROM (WITH {_items(f"SELECT * FROM {{stores}} WHERE deleted_at IS NULL AND list_contains({_W}, 'widget') AND {metres('latitude', 'longitude')} <= 30000", None, CENTRE)}
SELECT items.*, {_share("stored_name || ' ' || brand_name", ("widget",))} AS rank_proxy FROM items ORDER BY rank_proxy DESC, raw_distance, review_count DESC, store_id LIMIT 20) q"""

# Social.


def _posts(where: str, strict: bool = False, extra: str = "") -> str:
    return f"""SELECT p.id AS post_id, p.user_id, p.store_id, p.body, coalesce(p.content_language, '') AS content_language, p.rating, p.visit_verified, round(p.verification_distance_meters, 4) AS verification_distance_meters, p.created_at,
  coalesce(up.username, '') AS username, coalesce(up.display_name, '') AS display_name, coalesce(up.avatar_url, '') AS avatar_url, st.name AS store_name, st.city AS store_city, coalesce(st.district, '') AS store_district, round(st.latitude, 4) AS latitude, round(st.longitude, 4) AS longitude,
  coalesce(a.n, 0) AS author_review_count, (CASE WHEN coalesce(a.n, 0) >= 100 THEN 5 WHEN a.n >= 40 THEN 4 WHEN a.n >= 15 THEN 3 WHEN a.n >= 5 THEN 2 WHEN a.n >= 1 THEN 1 ELSE 0 END)::INT AS author_level,
  coalesce(l.n, 0) AS like_count, coalesce(c.n, 0) AS comment_count, EXISTS (SELECT 1 FROM {{likes}} x WHERE x.post_id = p.id AND x.user_id = {VIEWER}) AS viewer_liked, EXISTS (SELECT 1 FROM {{follows}} x WHERE x.following_id = p.user_id AND x.follower_id = {VIEWER}) AS viewer_follows,
  EXISTS (SELECT 1 FROM {{favorites}} x WHERE x.store_id = p.store_id AND x.user_id = {VIEWER}) AS viewer_favorited, coalesce(m.media, '') AS media{extra}
FROM {{posts}} p JOIN {{user_profiles}} up ON up.user_id = p.user_id JOIN {{stores}} st ON st.id = p.store_id JOIN {{users}} u ON u.id = p.user_id
LEFT JOIN (SELECT user_id, count(*) AS n FROM {{posts}} WHERE deleted_at IS NULL GROUP BY user_id) a ON a.user_id = p.user_id LEFT JOIN (SELECT post_id, count(*) AS n FROM {{likes}} GROUP BY post_id) l ON l.post_id = p.id
LEFT JOIN (SELECT post_id, count(*) AS n FROM {{comments}} WHERE deleted_at IS NULL GROUP BY post_id) c ON c.post_id = p.id
LEFT JOIN (SELECT pm.post_id, string_agg(m.id || '|/media/' || m.id || '|' || m.mime_type || '|' || m.width || '|' || m.height, ',' ORDER BY pm.position, m.id) AS media FROM {{post_media}} pm JOIN {{media}} m ON m.id = pm.media_id GROUP BY pm.post_id) m ON m.post_id = p.id
WHERE p.deleted_at IS NULL AND {where}{" AND u.deleted_at IS NULL AND st.deleted_at IS NULL" if strict else ""}"""


_NO_DISTANCE = ", NULL::DOUBLE AS store_distance_meters"
_D = metres("st.latitude", "st.longitude")
LEVEL = "(CASE WHEN post_count >= 100 THEN 5 WHEN post_count >= 40 THEN 4 WHEN post_count >= 15 THEN 3 WHEN post_count >= 5 THEN 2 WHEN post_count >= 1 THEN 1 ELSE 0 END)::INT"
PROFILES = f"""SELECT *, {LEVEL} AS level FROM (SELECT u.id AS user_id, coalesce(p.username, '') AS username, coalesce(p.display_name, '') AS display_name, coalesce(p.avatar_url, '') AS avatar_url, coalesce(p.bio, '') AS bio, coalesce(p.bio_language, '') AS bio_language, coalesce(p.city, '') AS city,
  (SELECT count(*) FROM {{follows}} f WHERE f.following_id = u.id) AS follower_count, (SELECT count(*) FROM {{follows}} f WHERE f.follower_id = u.id) AS following_count, (SELECT count(*) FROM {{posts}} x WHERE x.user_id = u.id AND x.deleted_at IS NULL) AS post_count
FROM {{users}} u JOIN {{user_profiles}} p ON p.user_id = u.id WHERE u.deleted_at IS NULL) q"""
HISTORY_KEY = "lower(coalesce(nullif(normalized_query, ''), raw_query))"
HISTORY = f"""WITH newest AS (SELECT DISTINCT ON (user_id, {HISTORY_KEY}) user_id, id, raw_query, created_at, total_result_count FROM {{searches}} WHERE user_id IS NOT NULL AND status = 'completed' ORDER BY user_id, {HISTORY_KEY}, created_at DESC, id DESC),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC)::INT AS place FROM newest)
SELECT n.user_id, n.place, n.id, n.raw_query, n.created_at, n.total_result_count, coalesce((SELECT string_agg(r.rank || '|' || r.store_id || '|' || s.name, ',' ORDER BY r.rank, r.store_id) FROM {{search_results}} r JOIN {{stores}} s ON s.id = r.store_id AND s.deleted_at IS NULL WHERE r.search_id = n.id AND r.rank <= 5), '') AS results
FROM placed n WHERE place <= 5"""

TIMES = ("created_at", "deleted_at", "last_seen_at", "expires_at", "consumed_at")


def _state(name: str, source: str, label: str = "", more: tuple[str, ...] = ()) -> str:
    shown = ", ".join(f"coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S'), '~')" if c in TIMES else f"coalesce({c}::VARCHAR, '~')" for c in (*STATE[name], *more))
    return f"SELECT '{label}' AS label, '{name}' AS name, concat_ws('|', {shown}) AS state FROM {source} q"


def _recounted(touched: str, posts: str) -> str:
    """store_stats with the counts of some stores taken from some posts."""
    n = f"(SELECT count(*) FROM {posts} p WHERE p.store_id = s.store_id AND p.deleted_at IS NULL)"
    return f"(SELECT s.* REPLACE ({', '.join(f'CASE WHEN s.store_id IN ({touched}) THEN {n} ELSE {c} END AS {c}' for c in ('rating_count', 'review_count', 'post_count'))}) FROM {{store_stats}} s)"


def _erased(u: int) -> str:
    at = f"TIMESTAMP '{AS_OF} 00:00:00'"
    email = f"(SELECT primary_email FROM {{users}} WHERE id = {u})"
    blank = f"REPLACE (CASE WHEN user_id = {u} AND deleted_at IS NULL THEN '' ELSE body END AS body, CASE WHEN user_id = {u} AND deleted_at IS NULL THEN NULL ELSE content_language END AS content_language, CASE WHEN user_id = {u} AND deleted_at IS NULL THEN {at} ELSE deleted_at END AS deleted_at)"
    posts = f"(SELECT * {blank} FROM {{posts}})"
    where = {n: f"user_id IS DISTINCT FROM {u}" for n in ("user_private_profiles", "likes", "favorites", "searches", "store_visit_verifications", "push_devices", "notification_outbox")}
    where |= {"follows": f"follower_id <> {u} AND following_id <> {u}", "verification_codes": f"email <> {email}", "email_outbox": f"recipient <> {email}"}
    where |= {n: f"search_id NOT IN (SELECT id FROM {{searches}} WHERE user_id = {u})" for n in ("search_results", "search_interactions")}
    sources = {n: f"(SELECT * FROM {{{n}}} WHERE {w})" for n, w in where.items()}
    sources |= {"posts": posts, "comments": f"(SELECT * {blank} FROM {{comments}})", "media": f"(SELECT * REPLACE (CASE WHEN owner_user_id = {u} THEN 'deleted' ELSE status END AS status) FROM {{media}})"}
    sources |= {n: f"(SELECT * REPLACE (nullif({c}, {u}) AS {c}) FROM {{{n}}})" for n, c in (("visitor_sessions", "linked_user_id"), ("platform_events", "user_id"))}
    sources["user_profiles"] = f"(SELECT * REPLACE (CASE WHEN user_id = {u} THEN 'Deleted user' ELSE display_name END AS display_name, {', '.join(f'CASE WHEN user_id <> {u} THEN {c} END AS {c}' for c in ('username', 'avatar_url', 'bio', 'bio_language', 'city'))}) FROM {{user_profiles}})"
    sources["users"] = f"(SELECT * REPLACE (CASE WHEN id = {u} THEN 'inactive' ELSE status END AS status, CASE WHEN id = {u} THEN 'tr' ELSE preferred_locale END AS preferred_locale, CASE WHEN id = {u} THEN {at} ELSE deleted_at END AS deleted_at) FROM {{users}})"
    sources["store_stats"] = _recounted(f"SELECT store_id FROM {{posts}} WHERE user_id = {u} AND deleted_at IS NULL", posts)
    return " UNION ALL ".join(_state(n, source, str(u)) for n, source in sources.items())


ERASURE = " UNION ALL ".join(_erased(u) for u in ERASED_USERS)
_NOW = "TIMESTAMP '1999-06-01 00:00:00'"
_EXPIRED = f"(expires_at < {_NOW} OR last_seen_at < {_NOW} - INTERVAL 180 DAY)"
_GONE = f"(SELECT id FROM {{visitor_sessions}} WHERE {_EXPIRED})"
_UNLINKED = f"REPLACE (CASE WHEN visitor_session_id IN {_GONE} THEN NULL ELSE visitor_session_id END AS visitor_session_id)"
_LEFT = f"(SELECT * FROM {{searches}} WHERE created_at >= {_NOW} - INTERVAL 365 DAY AND NOT (user_id IS NULL AND coalesce(visitor_session_id IN {_GONE}, false)))"
SWEEP = " UNION ALL ".join(
    _state(name, source, "", more)
    for name, source, more in (
        ("searches", f"(SELECT * {_UNLINKED}, (created_at >= {_NOW} - INTERVAL 30 DAY AND request_latitude IS NOT NULL)::INT AS located FROM {_LEFT} x)", ("located",)),
        ("visitor_sessions", f"(SELECT * FROM {{visitor_sessions}} WHERE NOT {_EXPIRED})", ()),
        ("search_results", f"(SELECT * FROM {{search_results}} WHERE search_id IN (SELECT id FROM {_LEFT} x))", ()),
        ("search_interactions", f"(SELECT * {_UNLINKED} FROM {{search_interactions}} WHERE search_id IN (SELECT id FROM {_LEFT} x))", ()),
        ("store_visit_verifications", f"(SELECT * FROM {{store_visit_verifications}} WHERE NOT (expires_at < {_NOW} - INTERVAL 30 DAY OR coalesce(consumed_at < {_NOW} - INTERVAL 30 DAY, false)))", ()),
        ("email_outbox", f"(SELECT * FROM {{email_outbox}} WHERE NOT (created_at < {_NOW} - INTERVAL 90 DAY AND status IN ('sent', 'failed')))", ()),
        ("verification_codes", f"(SELECT * {_UNLINKED} FROM {{verification_codes}} WHERE created_at >= {_NOW} - INTERVAL 30 DAY)", ()),
    )
)

# Operators' decisions, toggles, messages, sessions, proofs.

_AT = f"TIMESTAMP '{AS_OF} 00:00:00'"


def _log(action: str, target: str, metadata: str, source: str) -> str:
    return f"SELECT '{ACTOR}' AS actor_email, '{action}' AS action, '{target}' AS target_type, id::VARCHAR AS target_id, {metadata} AS metadata, {_AT} AS created_at FROM {source}"


_STATUS = "(SELECT id, CASE id % 3 WHEN 0 THEN 'active' ELSE 'suspended' END AS new_status FROM {users} WHERE id % 4 = 1 AND id % 3 < 2 AND id <> 25 AND deleted_at IS NULL AND status <> 'deleted') d"
_REVIEWS = f"(SELECT * REPLACE (CASE WHEN order_key % 7 = 0 AND deleted_at IS NULL THEN '' ELSE body END AS body, CASE WHEN order_key % 7 = 0 AND deleted_at IS NULL THEN NULL ELSE content_language END AS content_language, CASE WHEN order_key % 7 = 0 AND deleted_at IS NULL THEN {_AT} ELSE deleted_at END AS deleted_at) FROM {{posts}})"


def _effective(clicks: str, edges: str, keys: tuple[str, str]) -> str:
    """Clicks that change something: each differs from the click before it, or from what was there."""
    a, b = keys
    return f"""SELECT c.* FROM (SELECT *, lag(added) OVER (PARTITION BY {a}, {b} ORDER BY created_at, id) AS earlier FROM ({clicks}) k) c
WHERE added <> coalesce(earlier, EXISTS (SELECT 1 FROM {{{edges}}} e WHERE e.{a} = c.{a} AND e.{b} = c.{b}))"""


_CLICKS = "SELECT * FROM (SELECT user_id, id % 97 + 1 AS store_id, created_at, id, id % 3 <> 0 AS added FROM {platform_events} WHERE user_id IS NOT NULL) q WHERE NOT added OR store_id IN (SELECT id FROM {stores} WHERE deleted_at IS NULL)"
_HEARTS = _effective(_CLICKS, "favorites", ("user_id", "store_id"))
_WISHES = "SELECT * FROM (SELECT user_id AS follower_id, user_id + id % 4 AS following_id, created_at, id, id % 5 <> 0 AS added FROM {platform_events} WHERE user_id IS NOT NULL AND id % 4 <> 0) q WHERE NOT added OR following_id IN (SELECT id FROM {users} WHERE deleted_at IS NULL)"
_PAIRS = _effective(_WISHES, "follows", ("follower_id", "following_id"))
_TRIM = "regexp_replace({}, '^[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}]+|[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}]+$', '', 'g')"
MESSAGES = f"""SELECT doc_id + 10000000 AS id, kind, length(message) AS size, nullif(contact, '') AS contact_email, 'new' AS status FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Problem' WHEN 1 THEN 'praise' ELSE 'idea' END AS kind, {_TRIM.format("text")} AS message,
  CASE doc_id % 7 % 3 WHEN 0 THEN 'a@b' WHEN 1 THEN 'nobody' ELSE '' END AS contact FROM documents) q WHERE kind IN ('suggestion', 'problem', 'praise', 'other') AND length(message) BETWEEN 5 AND 4000 AND (contact = '' OR contains(contact, '@'))"""
SESSIONS = """WITH visits AS (SELECT visitor_session_id + id % 2 * 500 AS id, coalesce(query_language, 'tr') AS locale, created_at AS seen FROM {searches} WHERE visitor_session_id IS NOT NULL),
last AS (SELECT id, max(seen) AS z, min(seen) AS a, arg_max(locale, (seen, locale)) AS locale FROM visits GROUP BY id)
SELECT coalesce(v.id, l.id) AS id, v.linked_user_id, CASE WHEN l.id IS NOT NULL THEN l.locale ELSE v.locale END AS locale, coalesce(v.created_at, l.a) AS created_at, greatest(v.last_seen_at, l.z) AS last_seen_at, greatest(v.expires_at, l.z + INTERVAL 90 DAY) AS expires_at
FROM {visitor_sessions} v FULL JOIN last l ON l.id = v.id"""
_OPEN = "consumed_at IS NULL AND expires_at > TIMESTAMP '1996-03-01 12:00:00' AND store_id IN (SELECT id FROM {stores} WHERE deleted_at IS NULL)"
PROVEN = """WITH visits AS (SELECT 'v-' || id AS id, user_id + order_key % 3 AS user_id, store_id, created_at + INTERVAL 3 DAY AS verified_at FROM {posts} WHERE order_key % 2 = 0),
last AS (SELECT DISTINCT ON (user_id, store_id) * FROM visits ORDER BY user_id, store_id, verified_at DESC, id DESC), open AS (SELECT user_id, store_id, min(id) AS id FROM {store_visit_verifications} WHERE consumed_at IS NULL GROUP BY ALL)
SELECT id, user_id, store_id, round(distance, 4) AS distance, round(accuracy, 4) AS accuracy, verified_at, expires_at, consumed_at FROM {store_visit_verifications} p WHERE consumed_at IS NOT NULL OR NOT EXISTS (SELECT 1 FROM last l WHERE l.user_id = p.user_id AND l.store_id = p.store_id)
UNION ALL SELECT coalesce(o.id, l.id), l.user_id, l.store_id, 1.0, 5.0, l.verified_at, l.verified_at + INTERVAL 30 DAY, NULL FROM last l LEFT JOIN open o ON o.user_id = l.user_id AND o.store_id = l.store_id"""
ACCEPTED = f"""WITH uses AS (SELECT 'r-' || id AS post_id, id AS proof_id, user_id + CASE WHEN accuracy % 10 = 0 THEN 1 ELSE 0 END AS user_id, store_id FROM {{store_visit_verifications}} UNION ALL SELECT 'q-' || id, id, user_id, store_id FROM {{store_visit_verifications}} WHERE accuracy < 40)
SELECT DISTINCT ON (u.proof_id) u.proof_id, u.post_id, u.user_id, u.store_id, round(p.distance, 4) AS distance, p.verified_at FROM uses u JOIN (SELECT * FROM {{store_visit_verifications}} WHERE {_OPEN}) p ON p.id = u.proof_id AND p.user_id = u.user_id AND p.store_id = u.store_id ORDER BY u.proof_id, u.post_id"""
PROFILE_CHECKS = """SELECT id, CASE WHEN length(username) NOT BETWEEN 3 AND 30 OR NOT regexp_full_match(username, '[A-Za-z0-9_]+') THEN 'username' WHEN length(trim(display_name)) > 100 THEN 'display_name' WHEN url = 'ftp://x' THEN 'avatar_url' WHEN castle THEN 'housing_status' WHEN fr THEN 'bio_language' ELSE '' END AS wrong
FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN replace(p_brand, '#', CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '#' END) END AS username, repeat(p_name, (p_partkey % 9)::INT) AS display_name, CASE p_partkey % 4 WHEN 0 THEN 'ftp://x' WHEN 1 THEN 'https://x.y/z' END AS url, p_partkey % 5 = 0 AS castle, p_partkey % 11 = 0 AS fr FROM {part}) q"""
_SAMPLE = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LETTERS)) + " END"
_PLAIN = "strip_accents(replace(replace(normalized, 'ı', 'i'), 'ß', 'ss'))"
_BASE = f"regexp_replace(regexp_replace({_PLAIN}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
NORMAL_FORMS = f"SELECT id, normalized, {_PLAIN} AS folded, left({_BASE}, 60) || '-' || left(sha256(id::VARCHAR), 8) AS slug FROM (SELECT p_partkey AS id, nfc_normalize({low(f'p_name || chr(32) || {_SAMPLE}')}) AS normalized FROM {{part}}) q"


def _claimable(table: str, now: str) -> str:
    at = f"TIMESTAMP '{now} 00:00:00'"
    return f"SELECT * FROM {{{table}}} WHERE (status IN ('pending', 'failed') AND available_at <= {at}) OR (status = 'processing' AND locked_at < {at} - INTERVAL 5 MINUTE) ORDER BY available_at, id LIMIT 50"


COUNTERS = {
    "users": ("user_registered",), "stores": ("store_created", "store_imported_from_google"), "imported": ("store_imported_from_google",), "posts": ("post_created", "-post_deleted"), "posts_created": ("post_created",), "posts_deleted": ("post_deleted",),
    "comments": ("comment_created", "-comment_deleted"), "likes": ("like_created", "-like_removed"), "follows": ("follow_created", "-follow_removed"), "favorites": ("favorite_created", "-favorite_removed"), "searches": ("search_performed",), "media": ("media_created", "-media_deleted"),
}


def _delta(kinds: tuple[str, ...]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k.lstrip('-')}' THEN {-1 if k[0] == '-' else 1}" for k in kinds) + " ELSE 0 END"


ONCE = "SELECT * FROM {platform_events} QUALIFY idempotency_key IS NULL OR row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at, id) = 1"
FOLD = "SELECT " + ", ".join(f"greatest(0, coalesce(sum({_delta(k)}), 0))::BIGINT AS {n}" for n, k in COUNTERS.items()) + f" FROM ({ONCE}) q"
CLAMPED = f"""WITH RECURSIVE ev AS (SELECT user_id, {_delta(COUNTERS["favorites"])} AS d, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS k FROM (SELECT * FROM {{platform_events}} WHERE user_id IS NOT NULL QUALIFY idempotency_key IS NULL OR row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at, id) = 1) q),
run AS (SELECT user_id, k, greatest(0, d) AS v FROM ev WHERE k = 1 UNION ALL SELECT e.user_id, e.k, greatest(0, r.v + e.d) FROM run r JOIN ev e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, arg_max(v, k)::BIGINT AS favorites FROM run GROUP BY user_id"""
ATTRIBUTION = """SELECT DISTINCT c.id, c.search_id, c.search_result_id, c.user_id, coalesce(c.store_id, -1) AS store_id, c.created_at FROM {search_interactions} c JOIN {searches} s ON s.id = c.search_id JOIN {search_results} r ON r.id = c.search_result_id AND r.search_id = s.id
WHERE c.event_type IN ('favorite', 'review_created') AND s.user_id = c.user_id AND s.created_at >= c.created_at - INTERVAL 72 HOUR AND s.created_at <= c.created_at
  AND (r.store_id = coalesce(c.store_id, -1) OR EXISTS (SELECT 1 FROM {store_external_sources} x WHERE x.store_id = coalesce(c.store_id, -1) AND x.provider = r.external_provider AND x.external_id = r.external_place_id))"""
INTERACTIONS = """WITH claims AS (SELECT id, search_id, search_result_id, CASE WHEN id % 7 <> 0 THEN user_id END AS user_id, visitor_session_id, event_type, idempotency_key, created_at FROM {search_interactions} WHERE id % 3 <> 0),
own AS (SELECT c.id, c.search_id, c.search_result_id, c.user_id, c.visitor_session_id, c.event_type, nullif(c.idempotency_key, '') AS idempotency_key, c.created_at, r.store_id FROM claims c JOIN {searches} s ON s.id = c.search_id LEFT JOIN {search_results} r ON r.id = c.search_result_id
  WHERE (CASE WHEN c.user_id IS NOT NULL THEN s.user_id = c.user_id ELSE s.visitor_session_id = c.visitor_session_id END) AND (c.search_result_id IS NULL OR r.search_id = c.search_id))
SELECT * FROM own WHERE NOT EXISTS (SELECT 1 FROM {search_interactions} b WHERE b.id % 3 = 0 AND b.search_id = own.search_id AND b.idempotency_key = own.idempotency_key)
QUALIFY idempotency_key IS NULL OR row_number() OVER (PARTITION BY search_id, idempotency_key ORDER BY created_at, id) = 1"""

# Ranking.

_PARTS = "list_filter(list_transform(string_split(coalesce(address, ''), ','), lambda p: trim(p)), lambda p: p <> '' AND lower(p) NOT IN ('tr', 'türkiye', 'turkey'))"
CITY = f"coalesce(left(({_PARTS})[-1], 100), 'Bilinmiyor')"
_CITY_VALUE = f"CASE WHEN trim(coalesce(city, '')) <> '' THEN trim(city) ELSE coalesce(({_PARTS})[-1], '') END"
KEY = folded(low(f"trim(regexp_replace(trim(string_split({_CITY_VALUE}, '/')[-1]), '^[0-9]+', ''))"))
RESULTS = f"""rows AS (SELECT r.search_id, r.rank AS position, r.store_id, r.ranking_score AS score, CASE WHEN s.request_latitude IS NOT NULL AND r.id % 13 <> 0 THEN r.distance_meters * 2.5 END AS distance_meters, {KEY} AS k, st.is_premium AS premium,
  r.platform_review_count_at_time AS review_count, s.request_latitude IS NOT NULL AS located, s.id % 9 = 0 AS name_led FROM {{search_results}} r JOIN {{stores}} st ON st.id = r.store_id JOIN {{searches}} s ON s.id = r.search_id)"""
RANKING = f"""WITH {RESULTS}, homes AS (SELECT DISTINCT ON (search_id) search_id, k AS home FROM rows WHERE distance_meters IS NOT NULL AND k <> '' ORDER BY search_id, distance_meters, position),
tiers AS (SELECT rows.*, CASE WHEN name_led OR NOT located THEN 0 WHEN k = home AND premium THEN 0 WHEN k = home AND review_count > 0 THEN 1 ELSE 2 END::INT AS tier FROM rows LEFT JOIN homes USING (search_id)),
bands AS (SELECT *, CASE WHEN tier < 2 THEN NULL WHEN distance_meters IS NULL THEN 2147483647 WHEN distance_meters <= 25000 THEN floor(distance_meters / 500) ELSE 51 + floor((distance_meters - 25000) / 5000) END::INT AS band FROM tiers)
SELECT search_id, row_number() OVER (PARTITION BY search_id ORDER BY tier, band NULLS FIRST, score DESC, position)::INT AS rank, position, tier, band FROM bands"""
HORIZON = f"""WITH {RESULTS} SELECT search_id, position, store_id FROM rows QUALIFY name_led OR distance_meters IS NULL OR distance_meters <= 50000 OR count(*) FILTER (WHERE distance_meters IS NULL OR distance_meters <= 50000) OVER (PARTITION BY search_id) < 5"""

_A, _B, _C, _D4 = bounding_box(*CENTRE)
SUGGESTIONS = f"""SELECT shown, searches FROM (SELECT trim(arg_max(raw_query, (created_at, id))) AS shown, count(*) AS searches FROM {{searches}} WHERE created_at >= TIMESTAMP '1999-03-31 00:00:00' - INTERVAL 90 DAY AND request_latitude BETWEEN {_A!r} AND {_B!r} AND request_longitude BETWEEN {_C!r} AND {_D4!r}
  AND total_result_count > 0 AND length(normalized_query) BETWEEN 3 AND 60 AND coalesce(query_language, 'tr') = 'en' GROUP BY normalized_query HAVING count(DISTINCT coalesce(user_id::VARCHAR, visitor_session_id::VARCHAR)) >= 3) q WHERE shown <> '' ORDER BY searches DESC, shown LIMIT 60"""


def _slug(name: str, key: str) -> str:
    base = f"regexp_replace(regexp_replace({folded(low(f'trim({name})'))}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
    return f"(CASE WHEN {base} = '' THEN 'store' ELSE left({base}, 60) END || '-' || left({key}, 8))"


_GOOD = "SELECT DISTINCT ON (place_id) * FROM {places} WHERE place_id <> '' AND trim(name) <> '' AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 ORDER BY place_id, position"
NEW_PLACES = f"""SELECT sha256('google:' || place_id) AS id, place_id, name, {_slug("name", "sha256('google:' || place_id)")} AS slug, address, {CITY} AS city, round(latitude, 4) AS latitude, round(longitude, 4) AS longitude, nullif(phone, '') AS phone FROM ({_GOOD}) q
WHERE place_id NOT IN (SELECT external_id FROM {{store_external_sources}} WHERE provider = 'google')"""
KNOWN_PLACES = f"SELECT x.store_id, q.place_id, coalesce(nullif(s.phone, ''), nullif(q.phone, '')) AS phone FROM ({_GOOD}) q JOIN {{store_external_sources}} x ON x.external_id = q.place_id AND x.provider = 'google' JOIN {{stores}} s ON s.id = x.store_id"
LOOKED_UP = """SELECT DISTINCT p.place_id, s.id AS m_store_id, s.is_premium AS m_is_premium, round(ss.average_rating, 4) AS m_average_rating, ss.review_count AS m_review_count, ss.favorite_count AS m_favorite_count, ss.post_count AS m_post_count
FROM {places} p JOIN {store_external_sources} x ON x.external_id = p.place_id AND x.provider = 'google' JOIN {stores} s ON s.id = x.store_id AND s.deleted_at IS NULL JOIN {store_stats} ss ON ss.store_id = s.id"""
VISITS = f"""SELECT id, round(d, 4) AS distance, accuracy > 0 AND accuracy <= 100 AND d + accuracy <= 500 AS verified FROM (SELECT p.id, (p.order_key % 700 - 50)::DOUBLE AS accuracy,
  {metres("(s.latitude + (p.order_key % 12) * 0.0005)", "(s.longitude - (p.order_key % 12) * 0.0005)", ("s.latitude", "s.longitude"))} AS d FROM {{posts}} p JOIN {{stores}} s ON s.id = p.store_id WHERE p.visit_verified AND s.deleted_at IS NULL) q"""
PROOFS = """SELECT DISTINCT ON (user_id, store_id) user_id, store_id, id, round(distance, 4) AS distance, round(accuracy, 4) AS accuracy, verified_at FROM {store_visit_verifications} v
WHERE consumed_at IS NULL AND expires_at > TIMESTAMP '1996-03-01 12:00:00' AND verified_at <= TIMESTAMP '1996-03-01 12:00:00' AND EXISTS (SELECT 1 FROM {stores} s WHERE s.id = v.store_id AND s.deleted_at IS NULL) ORDER BY user_id, store_id, verified_at DESC, id DESC"""
TOGGLED = """WITH changes AS (SELECT user_id, post_id, created_at + INTERVAL 1 DAY AS created_at, 1 AS id, false AS added FROM {likes} WHERE user_id % 2 = 0
  UNION SELECT user_id + user_id % 2 * 50, post_id, created_at + INTERVAL 2 DAY, 2, true FROM {likes} WHERE user_id % 3 = 0), last AS (SELECT DISTINCT ON (user_id, post_id) * FROM changes ORDER BY user_id, post_id, created_at DESC, id DESC)
SELECT l.user_id, l.post_id, l.created_at FROM {likes} l LEFT JOIN last c USING (user_id, post_id) WHERE coalesce(c.added, true)
UNION ALL SELECT c.user_id, c.post_id, c.created_at FROM last c LEFT JOIN {likes} l USING (user_id, post_id) WHERE c.added AND l.user_id IS NULL"""
LIMITS = " UNION ALL ".join(f"SELECT '{c}' AS kind, {c}::VARCHAR AS key, count(*) AS requests FROM {{verification_codes}} WHERE created_at > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL {r} AND created_at <= TIMESTAMP '2024-01-15 12:00:00' AND {c} IS NOT NULL GROUP BY {c}" for c, r in (("email", "10 MINUTE"), ("ip", "1 HOUR"), ("visitor_session_id", "1 HOUR")))
LANGUAGE = f"CASE WHEN regexp_matches(text, '\\p{{Cyrillic}}') THEN 'ru' WHEN regexp_matches({low('text')}, '[ışğç]| mağaza| perde| mobilya| uygun fiyat') THEN 'tr' WHEN regexp_matches({low('text')}, '[äß]|geschäft|günstig|möbel|gardine') THEN 'de' ELSE 'en' END"
_R = metres("s.latitude", "s.longitude")
DISTANCES = f"""SELECT s.id, round({_R}, 4) AS distance, (CASE WHEN {_R} <= 25000 THEN floor({_R} / 500) ELSE 51 + floor(({_R} - 25000) / 5000) END)::INT AS band, round(floor(s.latitude * 1000 + 0.5) / 1000, 4) AS rounded, floor({_R} + 0.5)::INT AS metres,
  round(CASE WHEN ss.review_count > 0 THEN 300 + ss.average_rating * 10 + ln(1 + ss.review_count) * 15 + ln(1 + ss.favorite_count) * 3 - 3 ELSE 77 END, 4) AS score,
  (CASE WHEN ss.review_count >= 100 THEN 5 WHEN ss.review_count >= 40 THEN 4 WHEN ss.review_count >= 15 THEN 3 WHEN ss.review_count >= 5 THEN 2 WHEN ss.review_count >= 1 THEN 1 ELSE 0 END)::INT AS level,
  round(CASE WHEN s.id % 2 = 0 THEN least({_R} / 10000, 3) ELSE {_R} / 10000 END, 4) AS penalty FROM {{stores}} s JOIN {{store_stats}} ss ON ss.store_id = s.id"""

_LOCAL = "((created_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Istanbul')"


def _arrivals(table: str, late: int) -> str:
    """CTE ``parts``: rows with the quarter of the time in which they arrive, from 0; late ones in the last."""
    return f"""ends AS (SELECT min(created_at) AS a, max(created_at) AS z FROM {{{table}}}), arrived AS (SELECT *, CASE WHEN id % {late} = 0 THEN z ELSE created_at END AS arrives FROM {{{table}}}, ends),
parts AS (SELECT *, least(floor((epoch(arrives) - epoch(low)) / ((epoch(z) - epoch(low)) / 4)), 3)::INT AS part FROM arrived, (SELECT min(arrives) AS low FROM arrived) l)"""


# One step of the recursion is one change of each job; what time alone brings is added afterwards.
LEASES = f"""WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY changed_at, n) AS k FROM {{mail_changes}}),
states AS (
  SELECT id, k, changed_at, kind AS what, 'pending' AS status, 0 AS attempts, changed_at AS due FROM numbered WHERE k = 1
  UNION ALL SELECT id, k, changed_at, what, coalesce(CASE what WHEN 'claimed' THEN 'processing' WHEN 'refused' THEN 'dead' ELSE what END, status), attempts + (coalesce(what, '') = 'claimed')::INT,
    CASE what WHEN 'claimed' THEN changed_at + INTERVAL 5 MINUTE WHEN 'failed' THEN changed_at + (1 << least(attempts - 1, 8)) * INTERVAL 1 MINUTE ELSE due END
  FROM (SELECT c.id, c.k, c.changed_at, s.status, s.attempts, s.due, CASE WHEN c.kind = 'claimed' AND (s.status IN ('pending', 'failed') AND c.changed_at >= s.due OR s.status = 'processing' AND c.changed_at > s.due) THEN 'claimed'
      WHEN c.kind = 'failed' AND s.status = 'processing' AND s.attempts >= 10 THEN 'dead' WHEN c.kind IN ('sent', 'failed', 'refused') AND s.status = 'processing' THEN c.kind END AS what
    FROM states s JOIN numbered c ON c.id = s.id AND c.k = s.k + 1) q),
done AS (SELECT *, lead(changed_at) OVER (PARTITION BY id ORDER BY k) AS later FROM states WHERE what IS NOT NULL), mark AS (SELECT max(changed_at) - INTERVAL {LATE_MAIL.replace(' minutes', ' MINUTE')} AS mark FROM {{mail_changes}})
SELECT id, changed_at, kind, attempts FROM (SELECT id, changed_at, CASE what WHEN 'refused' THEN 'dead' ELSE what END AS kind, attempts FROM done WHERE what <> 'enqueued'
  UNION ALL SELECT id, due, 'due', attempts FROM done WHERE status IN ('pending', 'failed')
  UNION ALL SELECT id, due, 'lapsed', attempts FROM done WHERE status = 'processing' AND (later IS NULL OR later > due)) q, mark WHERE changed_at <= mark"""


_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_JUDGED = f"""WITH asked AS (SELECT r.*, trim(r.body) AS kept, string_split(r.media_list, ',') AS media, s.id IS NOT NULL AS live, v.distance AS proved, v.verified_at AS seen,
    s.id IS NOT NULL AND v.id IS NOT NULL AND v.consumed_at IS NULL AND v.expires_at > r.created_at AS open, {metres('s.latitude', 's.longitude', ('r.latitude', 'r.longitude'))} AS away
  FROM {{review_requests}} r LEFT JOIN (SELECT * FROM {{stores}} WHERE deleted_at IS NULL) s ON s.id = r.store_id LEFT JOIN {{store_visit_verifications}} v ON v.id = r.proof_id AND v.user_id = r.user_id AND v.store_id = r.store_id),
lacking AS (SELECT DISTINCT id FROM (SELECT id, user_id, unnest(media) AS m FROM asked) x WHERE NOT EXISTS (SELECT 1 FROM {{media}} k WHERE k.id = x.m AND k.owner_user_id = x.user_id AND k.status = 'ready')),
coded AS (SELECT *, CASE WHEN proof_id IS NULL THEN away ELSE proved END AS distance, CASE WHEN proof_id IS NULL THEN created_at ELSE seen END AS verified_at, CASE WHEN length(kept) NOT BETWEEN 3 AND 5000 OR rating NOT BETWEEN 1 AND 5 OR content_language = 'fr'
      OR proof_id IS NOT NULL AND latitude IS NOT NULL OR proof_id IS NULL AND NOT coalesce(accuracy > 0 AND accuracy <= 100, false) THEN 'INVALID_INPUT' WHEN len(list_distinct(media)) < len(media) THEN 'DUPLICATE_MEDIA'
    WHEN proof_id IS NOT NULL AND NOT open THEN 'VISIT_VERIFICATION_INVALID' WHEN proof_id IS NULL AND NOT live THEN 'STORE_NOT_FOUND' WHEN CASE WHEN proof_id IS NULL THEN away + accuracy ELSE proved END > 500 THEN 'STORE_VISIT_NOT_VERIFIED'
    WHEN id IN (SELECT id FROM lacking) THEN 'INVALID_MEDIA' ELSE '' END AS fault FROM asked),
judged AS (SELECT *, CASE WHEN fault = '' AND proof_id IS NOT NULL AND row_number() OVER (PARTITION BY proof_id, fault ORDER BY created_at, id) > 1 THEN 'VISIT_VERIFICATION_INVALID' ELSE fault END AS code FROM coded)"""
REVIEW_CODES = _JUDGED + " SELECT id, code, round(distance, 4) AS distance, verified_at FROM judged"
REVIEWS_WRITTEN = _JUDGED + f""", good AS (SELECT * FROM judged WHERE code = ''),
all_posts AS (SELECT id, user_id, store_id, body, rating, content_language, created_at, deleted_at FROM {{posts}} UNION ALL SELECT id, user_id, store_id, kept, rating, CASE content_language WHEN 'de-DE' THEN 'de' WHEN 'EN' THEN 'en' END, created_at, NULL FROM good),
anew AS (SELECT store_id, avg(rating) AS average, count(*) AS n FROM all_posts WHERE deleted_at IS NULL AND store_id IN (SELECT store_id FROM good) GROUP BY 1)
SELECT 'posts' AS name, id AS key, concat_ws('|', user_id, store_id, length(body), rating, coalesce(content_language, '-'), {_STAMP.format('created_at')}) AS state FROM all_posts
UNION ALL SELECT 'post_media', concat_ws('|', post_id, position), media_id FROM {{post_media}}
UNION ALL SELECT 'post_media', concat_ws('|', id, k - 1), media[k] FROM (SELECT id, media, unnest(range(1, len(media) + 1)) AS k FROM good) x
UNION ALL SELECT 'store_visit_verifications', v.id, {_STAMP.format('coalesce(g.created_at, v.consumed_at)')} FROM {{store_visit_verifications}} v LEFT JOIN good g ON g.proof_id = v.id
UNION ALL SELECT 'store_stats', s.store_id::VARCHAR, concat_ws('|', round(coalesce(round(a.average, 2), s.average_rating) * 100)::BIGINT, coalesce(a.n, s.rating_count), coalesce(a.n, s.review_count), coalesce(a.n, s.post_count), s.favorite_count) FROM {{store_stats}} s LEFT JOIN anew a USING (store_id)
UNION ALL SELECT 'events', 'post-created:' || id, concat_ws('|', 'post_created', user_id, store_id, id, '-') FROM good
UNION ALL SELECT 'events', 'post-verified:' || id, concat_ws('|', 'post_visit_verified', user_id, store_id, id, CASE WHEN proof_id IS NULL THEN 'current_location' ELSE 'stored_visit' END) FROM good
UNION ALL SELECT 'events', 'post-location-rejected:' || id, concat_ws('|', 'post_location_rejected', user_id, store_id, '-') FROM judged WHERE code = 'STORE_VISIT_NOT_VERIFIED'"""
COMMENTS_WRITTEN = """WITH added AS (SELECT r.*, trim(r.body) AS kept, CASE WHEN length(trim(r.body)) NOT BETWEEN 1 AND 2000 OR r.content_language = 'xx' THEN 'INVALID_INPUT' WHEN p.id IS NULL THEN 'POST_NOT_FOUND' ELSE '' END AS code
  FROM {comment_requests} r LEFT JOIN {posts} p ON p.id = r.post_id AND p.deleted_at IS NULL),
taken AS (SELECT r.*, c.post_id, CASE WHEN c.id IS NOT NULL AND row_number() OVER (PARTITION BY r.comment_id, r.user_id ORDER BY r.created_at, r.id) = 1 THEN '' ELSE 'COMMENT_NOT_FOUND' END AS code
  FROM {comment_removals} r LEFT JOIN {comments} c ON c.id = r.comment_id AND c.user_id = r.user_id AND c.deleted_at IS NULL),
live AS (SELECT post_id, body FROM {comments} WHERE deleted_at IS NULL AND id NOT IN (SELECT comment_id FROM taken WHERE code = '') UNION ALL SELECT post_id, kept FROM added WHERE code = '')
SELECT 'add' AS kind, id::VARCHAR AS key, code FROM added UNION ALL SELECT 'remove', id::VARCHAR, code FROM taken
UNION ALL SELECT 'comment_created', 'comment-created:' || id, concat_ws('|', user_id, post_id) FROM added WHERE code = ''
UNION ALL SELECT 'comment_deleted', 'comment-deleted:' || comment_id, concat_ws('|', user_id, post_id) FROM taken WHERE code = ''
UNION ALL SELECT 'live', post_id, concat_ws('|', count(*), sum(length(body))) FROM live GROUP BY post_id"""
DEVICES = f"""WITH asked AS (SELECT *, trim(platform) AS kind, sha256('{TOKEN_KEY}' || trim(token)) AS hash, user_id IS NOT NULL AND locale = 'en' AND trim(platform) IN ('ios', 'android', 'web') AND length(trim(token)) BETWEEN 1 AND 4096 AS good FROM {{device_requests}}),
known AS (SELECT id, user_id, 'web' AS platform, locale, created_at, disabled_at, sha256('{TOKEN_KEY}token-' || id) AS token_hash FROM {{push_devices}}),
latest AS (SELECT DISTINCT ON (hash) * FROM asked WHERE good ORDER BY hash, created_at DESC, id DESC), oldest AS (SELECT DISTINCT ON (hash) * FROM asked WHERE good ORDER BY hash, created_at, id),
after AS (SELECT * FROM known WHERE token_hash NOT IN (SELECT hash FROM latest) UNION ALL SELECT coalesce(k.id, o.id), n.user_id, n.kind, n.locale, coalesce(k.created_at, o.created_at), NULL, n.hash FROM latest n JOIN oldest o USING (hash) LEFT JOIN known k ON k.token_hash = n.hash)
SELECT * FROM after a WHERE NOT EXISTS (SELECT 1 FROM asked r WHERE r.id % 7 = 0 AND r.user_id = a.user_id AND r.hash = a.token_hash)"""
_OUTBOX = """WITH known AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'k' || (id % 150) END AS idempotency_key FROM {notification_outbox}),
asked AS (SELECT * REPLACE (nullif(idempotency_key, '') AS idempotency_key), user_id IS NOT NULL AND locale <> 'fr' AND trim(event_type) <> '' AS good FROM {notices}),
coded AS (SELECT *, CASE WHEN NOT good THEN 'INVALID_INPUT' WHEN idempotency_key IS NOT NULL AND (idempotency_key IN (SELECT idempotency_key FROM known WHERE idempotency_key IS NOT NULL)
  OR row_number() OVER (PARTITION BY idempotency_key, good ORDER BY created_at, id) > 1) THEN 'KNOWN' ELSE '' END AS code FROM asked)"""
NOTICES = _OUTBOX + """, first AS (SELECT DISTINCT ON (id) * FROM {notice_reports} ORDER BY id, created_at, sent)
SELECT k.id, k.user_id, k.locale, CASE WHEN f.id IS NULL THEN k.status WHEN f.sent THEN 'sent' ELSE 'failed' END AS status, k.attempts, CASE WHEN f.id IS NULL OR f.sent THEN k.available_at ELSE f.created_at + greatest(0, f.retry_s) * INTERVAL 1 SECOND END AS available_at,
  CASE WHEN f.id IS NULL THEN k.locked_at END AS locked_at, k.created_at, k.idempotency_key FROM known k LEFT JOIN first f ON f.id = k.id AND k.status = 'processing'
UNION ALL SELECT id, user_id, locale, 'pending', 0, created_at, NULL, created_at, idempotency_key FROM coded WHERE code = ''"""


REQUEST_CHECKS = """SELECT search_id, length(q) AS size, rad AS radius, CASE WHEN coalesce(length(q) BETWEEN 2 AND 500, false) AND (lat IS NULL AND lon IS NULL OR coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false)) AND rad BETWEEN 100 AND 50000 THEN '' ELSE 'INVALID_INPUT' END AS code
FROM (SELECT id AS search_id, trim(CASE id % 12 WHEN 0 THEN 'x' WHEN 1 THEN repeat(raw_query, 40) WHEN 2 THEN NULL ELSE raw_query END) AS q, CASE id % 12 WHEN 3 THEN 95.0 WHEN 4 THEN NULL ELSE request_latitude END AS lat, request_longitude AS lon,
  coalesce(nullif(CASE WHEN id % 12 = 5 THEN 0 ELSE id % 11 * 6000 END, 0), 10000)::INT AS rad FROM {searches}) x"""
SEARCH_EVENTS = """SELECT 'search_performed' AS event_type, 'search:' || id AS idempotency_key, user_id, visitor_session_id, ai_used::VARCHAR AS ai_used, google_places_used::VARCHAR AS google_places_used,
  coalesce(json_extract_string(parsed_intent, '$.scope'), '-') AS scope, (total_result_count = 0)::VARCHAR AS zero_results, created_at FROM {searches}"""
USER_PLACES = """WITH asked AS (SELECT *, coalesce(trim(location_label), '') AS label, coalesce(trim(location_source), '') AS source, coalesce(location_place_id, '') AS place, coalesce(location_address, '') AS address FROM {place_requests}),
coded AS (SELECT *, CASE WHEN clear OR latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND (source = 'manual' AND place <> '' AND label <> '' AND location_accuracy IS NULL AND length(label) <= 200 AND length(address) <= 500
  OR source = 'device' AND place = '' AND label = '' AND address = '' AND location_accuracy > 0 AND location_accuracy <= 1000) THEN '' ELSE 'INVALID_INPUT' END AS code FROM asked),
last AS (SELECT DISTINCT ON (user_id) user_id, clear, CASE WHEN NOT clear THEN source END AS source, CASE WHEN NOT clear THEN latitude END AS lat, CASE WHEN NOT clear THEN longitude END AS lon FROM coded WHERE code = '' ORDER BY user_id, created_at DESC, id DESC)
SELECT coalesce(p.user_id, l.user_id) AS user_id, coalesce(relationship_status, '-') || '|' || coalesce(CASE WHEN l.user_id IS NULL THEN location_source ELSE source END, '-') AS state,
  round(CASE WHEN l.user_id IS NULL THEN latitude ELSE lat END, 4)::DOUBLE AS latitude, round(CASE WHEN l.user_id IS NULL THEN longitude ELSE lon END, 4)::DOUBLE AS longitude FROM {user_private_profiles} p FULL JOIN last l ON l.user_id = p.user_id WHERE p.user_id IS NOT NULL OR NOT clear
UNION ALL SELECT id, 'code:' || code, NULL, NULL FROM coded"""
USER_NAMES = """WITH asked AS (SELECT r.*, trim(r.username) AS name, p.user_id IS NOT NULL AND regexp_full_match(trim(r.username), '[A-Za-z0-9_]{{3,30}}') AS valid FROM {name_requests} r LEFT JOIN {user_profiles} p ON p.user_id = r.user_id),
last AS (SELECT DISTINCT ON (user_id) * FROM asked WHERE valid ORDER BY user_id, created_at DESC, id DESC),
given AS (SELECT DISTINCT ON (lower(name)) * FROM last l WHERE NOT EXISTS (SELECT 1 FROM {user_profiles} p WHERE lower(p.username) = lower(l.name) AND p.user_id <> l.user_id) ORDER BY lower(name), created_at, id)
SELECT 'profile' AS kind, p.user_id AS id, coalesce(g.name, p.username, '') AS value FROM {user_profiles} p LEFT JOIN given g ON g.user_id = p.user_id
UNION ALL SELECT 'request', id, CASE WHEN NOT valid THEN 'INVALID_INPUT' WHEN id NOT IN (SELECT id FROM last) THEN 'REPLACED' WHEN id NOT IN (SELECT id FROM given) THEN 'USERNAME_TAKEN' ELSE '' END FROM asked"""
MESSAGE_MAIL = """SELECT 'feedback:' || f.id AS idempotency_key, 'team@example.com' AS recipient, f.created_at AS available_at, f.kind, coalesce(p.display_name, p.username, '') AS author, coalesce(f.contact_email, '') AS contact_email, length(f.message) AS size
FROM {feedback} f LEFT JOIN {user_profiles} p ON p.user_id = f.user_id"""


# What is asked for.


def _language(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '\\p{{Cyrillic}}') THEN 'ru' WHEN regexp_matches({low(x)}, '[ışğç]| mağaza| perde| mobilya| uygun fiyat') THEN 'tr' WHEN regexp_matches({low(x)}, '[äß]|geschäft|günstig|möbel|gardine') THEN 'de' ELSE 'en' END"


def _found(terms) -> str:
    plain = [t.strip().replace("İ", "i").lower() for t in terms]
    return "(" + " OR ".join([f"contains(plain, '{t}')" for t in plain] + [f"contains(bare, '{fold_literal(t)}')" for t in plain]) + ")"


def _list(*parts: str) -> str:
    """Some lists after each other, each value where it stands first."""
    return f"list_filter(list_concat({', '.join(parts)}), lambda v, i: list_position(list_concat({', '.join(parts)}), v) = i)" if parts else "[]::VARCHAR[]"


def _if(test: str, values) -> str:
    return f"CASE WHEN {test} THEN [{', '.join(repr(v) for v in values)}] ELSE []::VARCHAR[] END"


def intents(source: str, text: str, name: str = "") -> str:
    """CTEs ``{name}intent``: the rows of ``source`` with what their text asks for."""
    hits = ", ".join(f"{_found(terms)} AS h{k}" for k, (_, _, terms) in enumerate(I.CONCEPTS))
    first = lambda pairs: "CASE " + " ".join(f"WHEN {_found(t)} THEN '{v}'" for t, v in pairs) + " ELSE '' END"
    cats = _list(_if("dowry", I.DOWRY_CATEGORIES), _if("bedding", I.BEDDING_CATEGORIES), *(_if(f"h{k}", c) for k, (c, _, _) in enumerate(I.CONCEPTS)))
    prods = _list(_if("dowry", [I.DOWRY_PRODUCT]), _if("bedding", [I.BEDDING_PRODUCT]), *(_if(f"h{k}", [p]) for k, (_, p, _) in enumerate(I.CONCEPTS)))
    styles = "list_concat(" + ", ".join(_if(_found(t), [s]) for s, t in I.STYLES) + ")"
    at_home = lambda x, none="[]::VARCHAR[]": f"CASE WHEN home THEN {x} ELSE {none} END"
    return f"""{name}n AS (SELECT *, nfc_normalize({low(f"regexp_replace({text}, '^[[:space:]]+|[[:space:]]+$', '', 'g')")}) AS plain, {_language(text)} AS query_language FROM ({source}) q),
{name}b AS (SELECT *, strip_accents(replace(replace(plain, 'ı', 'i'), 'ß', 'ss')) AS bare FROM {name}n),
{name}h AS (SELECT *, {_found(I.DOWRY)} AS dowry, {_found(I.BEDDING_SET)} AS bedding, {hits}, {_found(I.ELSEWHERE)} AS elsewhere, {_found(I.BUDGET)} AS budget, {_found(I.LARGE_SELECTION)} AS large, {first(([n], n) for n in I.STORE_NAMES)} AS store, {first((t, n) for n, t in I.LOCATIONS)} AS place FROM {name}b),
{name}c AS (SELECT *, {cats} AS cats, {prods} AS prods, {styles} AS styles FROM {name}h), {name}d AS (SELECT *, store <> '' OR len(cats) > 0 OR len(prods) > 0 AS home FROM {name}c),
{name}intent AS (SELECT *, CASE WHEN home THEN 'home_living' WHEN elsewhere THEN 'out_of_scope' ELSE 'unclear' END AS scope, {at_home("store", "''")} AS store_name, place AS location_text, {at_home("cats")} AS categories, {at_home("prods")} AS product_terms,
  {at_home("styles")} AS style_terms, CASE WHEN home AND budget THEN 'budget' ELSE '' END AS price_intent, {at_home(_if("large", ["large_selection"]))} AS attributes, {at_home(_if("dowry", [I.DOWRY_SEMANTIC]))} AS semantic_terms FROM {name}d)"""


def _text(x: str) -> str:
    return f"array_to_string({x}, ',')"


_REQUEST = "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(REQUESTS)) + " END"
_ASKED = "list_concat(CASE WHEN store_name <> '' THEN [store_name] ELSE []::VARCHAR[] END, product_terms, semantic_terms)"
_SHOWN = "list_concat([trim(query)], list_filter(list_transform(list_concat([store_name], product_terms, semantic_terms, categories), lambda v: replace(trim(v), '_', ' ')), lambda v: v <> ''))"
INTENTS = f"""WITH {intents(f"SELECT p_partkey AS id, p_name || ' ' || {_REQUEST} AS query FROM {{part}}", "query")}
SELECT id, scope, query_language, store_name, location_text, price_intent, {", ".join(f"{_text(n)} AS {n}" for n in I.LISTS)},
  CASE WHEN length(plain) > 500 THEN 'text_length' WHEN len(categories) > 8 OR len(product_terms) > 12 OR len(style_terms) > 8 OR len(attributes) > 8 OR len(semantic_terms) > 12 THEN 'too_many' ELSE '' END AS error,
  CASE WHEN len({_ASKED}) = 0 THEN plain ELSE array_to_string({_ASKED}, ' OR ') END AS internal_query, trim(left(trim(array_to_string({_list(_SHOWN)}, ' ')), 500)) AS places_query FROM intent"""
MERGED = f"""WITH {intents("SELECT p_partkey AS id, lower(p_type) AS a FROM {part}", "a", "a_")}, {intents(f"SELECT p_partkey AS id, {_REQUEST} AS b FROM {{part}}", "b", "b_")}
SELECT a.id, CASE WHEN b.scope = 'home_living' OR a.scope <> 'home_living' THEN b.scope ELSE a.scope END AS scope, b.query_language, CASE WHEN b.location_text <> '' THEN b.location_text ELSE a.location_text END AS location_text,
  {", ".join(f"{_text(_list(f'a.{n}', f'b.{n}'))} AS {n}" for n in I.LISTS)} FROM a_intent a JOIN b_intent b USING (id)"""
_BY_TYPE = "CASE lower(trim(primary_type)) " + " ".join(f"WHEN '{k}' THEN ['{v}']" for k, v in I.PLACE_TYPES.items()) + " ELSE []::VARCHAR[] END"
PLACE_CATEGORIES = f"""WITH {intents("SELECT position, name, primary_type FROM {places} WHERE place_id <> ''", "name")} SELECT position, name, {_text(_list(_BY_TYPE, "categories"))} AS categories FROM intent"""
BACKFILL = f"""WITH {intents("SELECT id, name FROM {stores} WHERE deleted_at IS NULL AND id NOT IN (SELECT store_id FROM {store_category_links})", "name")} SELECT id, name, {_text(_list("categories"))} AS categories FROM intent"""

_SQL: dict[str, str] = {
    "r1_platform_daily": PLATFORM_DAILY,
    "r2_query_daily": QUERY_DAILY,
    "r3_intent_daily": INTENT_DAILY,
    "r4_store_daily": STORE_DAILY,
    "r5_locale_daily": LOCALE_DAILY,
    "r6_platform": PLATFORM_DAILY,
    "r6_query": QUERY_DAILY,
    "r6_intent": INTENT_DAILY,
    "r6_store": STORE_DAILY,
    "r6_locale": f"WITH {ENDS} SELECT q.* FROM ({LOCALE_DAILY}) q, ends WHERE metric_date BETWEEN a AND z",
    "r18_runs": RUNS,
    "a2_distinct_users": f"WITH s AS (SELECT normalized_query, coalesce(query_language, 'tr') AS query_language, user_id FROM {{searches}} WHERE {DAY} BETWEEN DATE '{FIRST}' AND DATE '{LAST}') SELECT normalized_query, query_language, count(DISTINCT user_id) AS users, true AS close FROM s GROUP BY ALL UNION ALL SELECT '', query_language, count(DISTINCT user_id), true FROM s GROUP BY ALL",
    "r8_daily_series": _over(PLATFORM_DAILY, f"SELECT {SERIES} FROM daily WHERE {RANGE}"),
    "r9_search_overview": _over(PLATFORM_DAILY, f"SELECT {_sums(*OVERVIEW)} FROM daily WHERE {RANGE}"),
    "r10_top_queries": _top_queries("", "search_count", 50),
    "r10_top_queries_locale": _top_queries("AND query_language = 'de'", "search_count", 20),
    "r11_zero_result_queries": _top_queries("AND zero_result_count > 0", "zero_result_count", 20),
    "r12_top_categories": _over(INTENT_DAILY, f"SELECT dimension, value, '' AS query_language, sum(search_count)::BIGINT AS search_count FROM daily WHERE {RANGE} AND dimension = 'category' GROUP BY ALL ORDER BY search_count DESC, value LIMIT 20"),
    "r12_top_locations": _over(INTENT_DAILY, f"SELECT dimension, value, query_language, sum(search_count)::BIGINT AS search_count FROM daily WHERE {RANGE} AND dimension = 'location' AND query_language = 'en' GROUP BY ALL ORDER BY search_count DESC, value LIMIT 20"),
    "r13_funnel": _over(PLATFORM_DAILY, f"SELECT {_sums(*FUNNEL)} FROM daily WHERE {RANGE}"),
    "r14_high_demand_low_review": _top_stores("1996-01-01", "1996-02-01", "impression_count", "HAVING coalesce(max(platform_review_count_latest), 0) < 3"),
    "r15_most_impressed": _top_stores(FIRST, LAST, "impression_count"),
    "r15_most_clicked": _top_stores("1995-01-01", "2001-12-31", "click_count"),
    "r17_snapshot": SNAPSHOT,
    "s2_known_places": LOOKED_UP,
    "s3_interactions": INTERACTIONS,
    "s4_attribution": ATTRIBUTION,
    "s5_classic_search": CLASSIC,
    "s6_new_places": NEW_PLACES,
    "s6_known_places": KNOWN_PLACES,
    "s7_suggestions": SUGGESTIONS,
    "s8_areas": "SELECT position, name, address FROM {places} WHERE primary_type = 'locality' ORDER BY position LIMIT 5",
    "s9_intents": INTENTS,
    "s11_merged_intents": MERGED,
    "s12_place_categories": PLACE_CATEGORIES,
    "c10_backfill": BACKFILL,
    "s16_local_horizon": HORIZON,
    "s18_ranking": RANKING,
    "c1_detail": f"""WITH {_items(f"{LIVE} AND id = {STORE}", VIEWER, CENTRE, "en")} SELECT items.* {HIDDEN}, coalesce((SELECT string_agg(provider || '|' || external_id, ',' ORDER BY provider, external_id) FROM {{store_external_sources}} WHERE store_id = {STORE}), '') AS sources,
  EXISTS (SELECT 1 FROM {{posts}} WHERE store_id = {STORE} AND user_id = {VIEWER} AND deleted_at IS NULL) AS viewer_has_reviewed FROM items""",
    "c2_index": "SELECT s.id, slug, name, city, updated_at, review_count FROM {stores} s JOIN {store_stats} ss ON ss.store_id = s.id WHERE deleted_at IS NULL ORDER BY s.id LIMIT 500 OFFSET 50",
    "c3_slug": "SELECT id FROM {stores} WHERE slug = 'brand#17-1' AND deleted_at IS NULL",
    "c4_premium_nearby": f"WITH {_items(f'{LIVE} AND is_premium AND {metres("latitude", "longitude")} <= 50000', VIEWER, CENTRE)} SELECT items.* {HIDDEN} FROM items ORDER BY raw_distance, store_id LIMIT 20",
    "c5_by_name": BY_NAME,
    "c6_search": SEARCH,
    "c7_favorites": f"WITH {_items(f'SELECT s.* FROM {{stores}} s WHERE deleted_at IS NULL AND id IN (SELECT store_id FROM {{favorites}} WHERE user_id = {VIEWER})', VIEWER, None, 'en')} SELECT items.* {HIDDEN}, f.created_at AS saved_at FROM items JOIN {{favorites}} f ON f.store_id = items.store_id AND f.user_id = {VIEWER} ORDER BY saved_at DESC, store_id LIMIT 100",
    "c8_toggled": TOGGLED,
    "c8_favorite_counts": f"SELECT s.store_id, greatest(0, s.favorite_count + coalesce((SELECT sum(CASE WHEN added THEN 1 ELSE -1 END) FROM ({_HEARTS}) h WHERE h.store_id = s.store_id), 0))::BIGINT AS favorite_count FROM {{store_stats}} s",
    "c8_favorite_events": f"SELECT id, user_id, store_id, CASE WHEN added THEN 'favorite_created' ELSE 'favorite_removed' END AS event_type, 'change:' || id AS idempotency_key, created_at FROM ({_HEARTS}) h",
    "f7_follow_events": f"SELECT id, follower_id, following_id, CASE WHEN added THEN 'follow_created' ELSE 'follow_removed' END AS event_type, created_at FROM ({_PAIRS}) h",
    "c9_categories": _over(INTENT_DAILY, "SELECT c.slug, coalesce(n.name, c.name_tr) AS name, coalesce((SELECT sum(search_count) FROM daily WHERE dimension = 'category' AND value = c.slug AND metric_date >= DATE '1999-01-31' - 30), 0)::BIGINT AS search_count FROM {store_categories} c LEFT JOIN {store_category_translations} n ON n.category_id = c.id AND n.locale = 'en' WHERE c.active"),
    "f1_feed_recent": f"{_posts('true', True, _NO_DISTANCE)} ORDER BY p.created_at DESC, p.id DESC LIMIT 51",
    "f1_feed_nearby": f"{_posts('true', True, f', round({_D}, 4) AS store_distance_meters')} ORDER BY {_D}, p.created_at DESC, p.id DESC LIMIT 51",
    "f1_feed_page": _posts("(p.created_at, p.id) < (TIMESTAMP '2000-06-01 05:00:00', '5')", True, _NO_DISTANCE) + " ORDER BY p.created_at DESC, p.id DESC LIMIT 51",
    "f2_post": _posts("p.id = (SELECT min(id) FROM {posts} WHERE deleted_at IS NULL)"),
    "f3_comments": "SELECT c.post_id, c.id, c.user_id, c.body, coalesce(c.content_language, '') AS content_language, c.created_at, coalesce(p.username, '') AS username, coalesce(p.display_name, '') AS display_name, coalesce(p.avatar_url, '') AS avatar_url FROM (SELECT * FROM {comments} WHERE deleted_at IS NULL QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY created_at, id) <= 3) c JOIN {user_profiles} p ON p.user_id = c.user_id",
    "f4_posts_by_store": f"{_posts(f'p.store_id = {STORE}')} ORDER BY p.created_at DESC, p.id DESC LIMIT 50",
    "f4_posts_by_user": f"{_posts(f'p.user_id = {USER}')} ORDER BY p.created_at DESC, p.id DESC LIMIT 50",
    "f5_visits": VISITS,
    "f6_proofs": PROOFS,
    "st12_proven": PROVEN,
    "st12_accepted": ACCEPTED,
    "st12_consumed": f"SELECT p.id, CASE WHEN a.proof_id IS NOT NULL THEN TIMESTAMP '1996-03-01 12:00:00' ELSE p.consumed_at END AS consumed_at FROM {{store_visit_verifications}} p LEFT JOIN (FROM ({ACCEPTED}) x) a ON a.proof_id = p.id",
    "st11_sessions": SESSIONS,
    "u6_checks": PROFILE_CHECKS,
    "x_normal_forms": NORMAL_FORMS,
    "f9_stats": "SELECT store_id, round(round(avg(rating::DOUBLE), 2), 4) AS average_rating, count(*) AS rating_count, count(*) AS review_count, count(*) AS post_count FROM {posts} WHERE deleted_at IS NULL GROUP BY store_id",
    "u1_profiles": PROFILES,
    "u2_own_profiles": f"SELECT q.*, u.primary_email, u.preferred_locale, x.relationship_status, x.has_children, x.location_source, round(x.latitude::DOUBLE, 4) AS latitude, round(x.longitude::DOUBLE, 4) AS longitude, (SELECT count(*) FROM {{favorites}} f WHERE f.user_id = q.user_id) AS favorite_count FROM ({PROFILES}) q JOIN {{users}} u ON u.id = q.user_id LEFT JOIN {{user_private_profiles}} x ON x.user_id = q.user_id",
    "u3_history": HISTORY,
    "u4_without_history": f"SELECT user_id, count(*) AS n FROM {{searches}} WHERE NOT coalesce(user_id = 7 AND {HISTORY_KEY} IN (SELECT {HISTORY_KEY} FROM {{searches}} WHERE id = 1 AND user_id = 7), false) GROUP BY user_id",
    "u5_erasure": ERASURE,
    "u6_patched": "SELECT user_id, CASE WHEN user_id % 6 = 0 THEN 'new' || user_id ELSE username END AS username, display_name, avatar_url, bio, bio_language, CASE WHEN user_id % 3 = 0 THEN 'moved' ELSE city END AS city FROM {user_profiles}",
    "ad1_users": "SELECT u.id, u.primary_email, coalesce(p.username, '') AS username, coalesce(p.display_name, '') AS display_name, u.status, (SELECT count(*) FROM {posts} x WHERE x.user_id = u.id AND x.deleted_at IS NULL) AS post_count, u.created_at, u.deleted_at FROM {users} u LEFT JOIN {user_profiles} p ON p.user_id = u.id WHERE lower(u.primary_email) LIKE '%user1%' OR lower(coalesce(p.username, '')) LIKE '%user1%' ORDER BY u.created_at DESC, u.id LIMIT 100 OFFSET 3",
    "ad2_stores": "SELECT s.id, s.name, s.slug, s.city, s.is_premium, coalesce((SELECT string_agg(c.slug, ',' ORDER BY c.slug) FROM {store_category_links} l JOIN {store_categories} c ON c.id = l.category_id WHERE l.store_id = s.id), '') AS categories, ss.review_count, round(ss.average_rating, 4) AS average_rating, s.created_at FROM {stores} s JOIN {store_stats} ss ON ss.store_id = s.id WHERE s.deleted_at IS NULL AND (lower(s.name) LIKE '%an%' OR lower(s.city) LIKE '%an%') ORDER BY s.is_premium DESC, ss.review_count DESC, s.created_at DESC, s.id LIMIT 100 OFFSET 5",
    "ad3_reviews": "SELECT p.id, p.store_id, s.name AS store_name, p.user_id, coalesce(up.display_name, '') AS display_name, p.rating, p.body, p.created_at, p.deleted_at IS NOT NULL AS deleted FROM {posts} p JOIN {stores} s ON s.id = p.store_id LEFT JOIN {user_profiles} up ON up.user_id = p.user_id WHERE lower(s.name) LIKE '%ring%' OR lower(coalesce(up.display_name, '')) LIKE '%ring%' ORDER BY p.created_at DESC, p.id LIMIT 100 OFFSET 2",
    "ad4_searches": "SELECT s.id, s.raw_query, s.user_id, coalesce(s.query_language, '') AS query_language, coalesce(json_extract_string(s.parsed_intent, '$.scope'), '') AS scope, s.total_result_count, (SELECT count(*) FROM {search_interactions} i WHERE i.search_id = s.id AND i.event_type IN ('click', 'store_open')) AS interactions, s.duration_ms, s.fallback_state, s.created_at FROM {searches} s WHERE lower(s.raw_query) LIKE '%urgent%' ORDER BY s.created_at DESC, s.id LIMIT 200",
    "ad5_results": "SELECT r.rank, r.store_id, coalesce(s.name, '') AS name, r.source, r.distance_meters, round(r.ranking_score, 4) AS ranking_score FROM {search_results} r LEFT JOIN {stores} s ON s.id = r.store_id WHERE r.search_id = 5",
    "ad6_audit": "SELECT * FROM {admin_actions} ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 10",
    "ad7_categories": "SELECT slug, name_tr FROM {store_categories} WHERE active",
    "ad7_slugs": f"SELECT slug FROM {{store_category_links}} l JOIN {{store_categories}} c ON c.id = l.category_id WHERE l.store_id = {STORE}",
    "ad8_premium": f"SELECT id, CASE WHEN id % 3 = 0 AND deleted_at IS NULL THEN id % 2 = 0 ELSE is_premium END AS is_premium, CASE WHEN id % 3 = 0 AND deleted_at IS NULL THEN {_AT} ELSE updated_at END AS updated_at, deleted_at FROM {{stores}}",
    "ad8_premium_log": _log("store.premium", "store", "'{{\"is_premium\":' || (id % 2 = 0) || '}}'", "{stores} WHERE id % 3 = 0 AND deleted_at IS NULL"),
    "ad8_status": f"SELECT id, coalesce(d.new_status, u.status) AS status FROM {{users}} u LEFT JOIN {_STATUS} USING (id)",
    "ad8_status_log": _log("user.status", "user", "'{{\"status\":\"' || new_status || '\"}}'", _STATUS),
    "ad8_categories": "WITH live AS (SELECT id FROM {stores} WHERE id % 5 = 0 AND deleted_at IS NULL) SELECT store_id, category_id FROM {store_category_links} WHERE store_id NOT IN (SELECT id FROM live) UNION ALL SELECT live.id, c.id FROM live, {store_categories} c WHERE live.id % 2 = 0 AND c.active AND c.slug IN ('garden', 'carpet', 'small_appliances')",
    "ad8_reviews": _state("posts", _REVIEWS) + " UNION ALL " + _state("store_stats", _recounted("SELECT store_id FROM {posts} WHERE order_key % 7 = 0 AND deleted_at IS NULL", _REVIEWS)),
    "ad9_handled": f"SELECT id, CASE id % 4 WHEN 0 THEN 'new' WHEN 2 THEN 'handled' ELSE status END AS status, CASE id % 4 WHEN 0 THEN NULL WHEN 2 THEN {_AT} ELSE handled_at END AS handled_at FROM {{feedback}}",
    "m7_messages": MESSAGES,
    "ad9_feedback": "SELECT f.id, f.kind, f.message, coalesce(f.contact_email, '') AS contact_email, coalesce(p.display_name, p.username, '') AS name, f.locale, f.status, f.created_at, f.handled_at FROM {feedback} f LEFT JOIN {user_profiles} p ON p.user_id = f.user_id WHERE f.message ILIKE '%mail%' OR f.contact_email ILIKE '%mail%' ORDER BY f.created_at DESC, f.id LIMIT 200",
    "m1_sweep": SWEEP,
    "m2_claimable_mail": _claimable("email_outbox", AS_OF),
    "m3_claimable_push": _claimable("notification_outbox", "2001-11-10"),
    "m3_outcome": f"SELECT id, 'failed' AS status, attempts, CASE WHEN attempts < 10 AND id % 7 <> 0 THEN {_AT} + (1 << least(greatest(attempts - 1, 0), 8)) * INTERVAL 1 MINUTE END AS available_at, attempts >= 10 OR id % 7 = 0 AS dead FROM {{email_outbox}} WHERE status = 'processing'",
    "m4_public_media": "SELECT id, mime_type FROM {media} m WHERE status = 'ready' AND EXISTS (SELECT 1 FROM {post_media} pm JOIN {posts} p ON p.id = pm.post_id AND p.deleted_at IS NULL WHERE pm.media_id = m.id)",
    "m5_accounts": "SELECT id, preferred_locale FROM {users} WHERE deleted_at IS NULL AND status = 'active'",
    "st1_fold": FOLD,
    "st1_streamed_fold": FOLD,
    "st3_streamed_days": f"WITH {_arrivals('platform_events', LATE_DAYS)}, w AS (SELECT max({_LOCAL}) - INTERVAL 72 HOUR AS mark FROM parts WHERE part < 2) SELECT {DAY} AS metric_date, event_type, count(*) AS n FROM parts, w WHERE part < 3 OR {DAY}::TIMESTAMP + INTERVAL 1 DAY > mark GROUP BY ALL",
    "st7_streamed_limits": f"WITH {_arrivals('verification_codes', LATE_LIMITS)}, w AS (SELECT max(created_at) - INTERVAL 1 HOUR AS mark FROM parts WHERE part < 2), windows AS (SELECT time_bucket(INTERVAL 10 MINUTE, created_at) + k * INTERVAL 10 MINUTE AS until, ip, part FROM parts, range(1, 7) t(k) WHERE ip IS NOT NULL) SELECT until, ip, count(*) AS requests FROM windows, w WHERE part < 3 OR until > mark GROUP BY ALL",
    "st4_streamed_attribution": ATTRIBUTION,
    "s1_request_checks": REQUEST_CHECKS,
    "s1_search_events": SEARCH_EVENTS,
    "u6_places": USER_PLACES,
    "u6_names": USER_NAMES,
    "m7_mail": MESSAGE_MAIL,
    "f5_review_codes": REVIEW_CODES,
    "f5_reviews_written": REVIEWS_WRITTEN,
    "f8_comments": COMMENTS_WRITTEN,
    "m3_devices": DEVICES,
    "m3_notice_codes": _OUTBOX + " SELECT id, code FROM coded",
    "m3_notices": NOTICES,
    "st9_streamed_leases": LEASES,
    "st1_clamped_fold": CLAMPED,
    "st6_stitched": "SELECT coalesce(s.user_id, v.linked_user_id) AS user_id, count(*) AS searches FROM {searches} s LEFT JOIN {visitor_sessions} v ON v.id = s.visitor_session_id GROUP BY 1",
    "st7_limits": LIMITS,
    "x_radius_join": f"SELECT p.id, s.id AS store_id, round({metres('s.latitude', 's.longitude', ('p.request_latitude', 'p.request_longitude'))}, 4) AS distance FROM {{searches}} p JOIN {{stores}} s ON {metres('s.latitude', 's.longitude', ('p.request_latitude', 'p.request_longitude'))} <= 3000 WHERE p.request_latitude IS NOT NULL AND s.deleted_at IS NULL AND s.latitude BETWEEN p.request_latitude - 0.03 AND p.request_latitude + 0.03",
    "x_upsert": "WITH new AS (SELECT store_id + store_id % 2 AS store_id, locale, 'again' AS display_name, max(description) AS description, 2 AS version FROM {store_translations} WHERE store_id % 3 = 0 GROUP BY ALL) SELECT store_id, locale, display_name, description, 0 AS version FROM {store_translations} o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.store_id = o.store_id AND n.locale = o.locale) UNION ALL SELECT * FROM new",
    "x_insert_new": f"WITH new AS (SELECT DISTINCT user_id, store_id + user_id % 2 AS store_id FROM {{favorites}} EXCEPT SELECT user_id, store_id FROM {{favorites}}) SELECT user_id, count(*) AS n, max(created_at) AS newest FROM (SELECT user_id, created_at FROM {{favorites}} UNION ALL SELECT user_id, TIMESTAMP '{AS_OF} 00:00:00' FROM new) q GROUP BY user_id",
    "x_distinct_on": "SELECT 1 AS rank, key, id FROM (SELECT DISTINCT ON (normalized_query) normalized_query AS key, id FROM {searches} ORDER BY normalized_query, created_at DESC, id DESC) q UNION ALL SELECT row_number() OVER (PARTITION BY query_language ORDER BY duration_ms DESC, id)::INT AS rank, query_language, id FROM {searches} WHERE query_language IS NOT NULL QUALIFY rank <= 3",
    "x_store_texts": f"SELECT id, {KEY} AS city_key, {CITY} AS city_of_address, {_slug('name', 'sha256(id::VARCHAR)')} AS slug FROM {{stores}}",
    "x_document_texts": f"SELECT doc_id, {LANGUAGE} AS language, sha256({folded(low('trim(text)'))}) AS folded, len(list_distinct({tokens('text')})) AS n_tokens FROM documents",
    "x_distances": DISTANCES,
    "x_days": f"SELECT day, (day::TIMESTAMP AT TIME ZONE 'Europe/Istanbul') AT TIME ZONE 'UTC' AS starts, ((day + 1)::TIMESTAMP AT TIME ZONE 'Europe/Istanbul') AT TIME ZONE 'UTC' AS ends FROM (SELECT DISTINCT {DAY} AS day FROM {{searches}}) q",
}

ORACLE_SQL: dict[str, str] = {name: inlined(sql) for name, sql in _SQL.items()}
