"""Profiles, search history, the operators' lists, and upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.gathering import ordered_list
from ..functions.scores import level
from .social import counted, recomputed_stats


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def profiles(t) -> DataFrame:
    """Public profiles of live users with followers, followed users, posts and level."""
    users = t.users.where("deleted_at is null").select(F.col("id").alias("user_id")).join(t.user_profiles, "user_id")
    rows = users.join(counted(t.follows, "following_id", "follower_count", "user_id"), "user_id", "left").join(counted(t.follows, "follower_id", "following_count", "user_id"), "user_id", "left").join(counted(t.posts.where("deleted_at is null"), "user_id", "post_count", "user_id"), "user_id", "left")
    return rows.select("user_id", *map(_blank, ("username", "display_name", "avatar_url", "bio", "bio_language", "city")), *map(_zero, ("follower_count", "following_count", "post_count")), level(F.coalesce("post_count", F.lit(0))).alias("level"))


def own_profiles(t) -> DataFrame:
    """Profiles as their owners see them."""
    own = t.users.select(F.col("id").alias("user_id"), "primary_email", "preferred_locale").join(t.user_private_profiles, "user_id", "left").join(counted(t.favorites, "user_id", "favorite_count", "user_id"), "user_id", "left")
    return profiles(t).join(own, "user_id").withColumn("favorite_count", _zero("favorite_count"))


def history_key() -> Column:
    return F.lower(F.coalesce(F.nullif("normalized_query", F.lit("")), "raw_query"))


def history(searches: DataFrame, results: DataFrame, stores: DataFrame, limit: int = 30, shown: int = 5) -> DataFrame:
    """Each user's searches, the newest of each different text, with the first results that are live stores."""
    limit = limit if 1 <= limit <= 100 else 30
    done = searches.where("user_id is not null and status = 'completed'").withColumn("key", history_key())
    newest = done.groupBy("user_id", "key").agg(F.max_by(F.struct("id", "raw_query", "created_at", "total_result_count"), F.struct("created_at", "id")).alias("s")).select("user_id", "s.*")
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id")))
    kept = newest.withColumn("place", place).where(F.col("place") <= limit)
    live = stores.where("deleted_at is null").select(F.col("id").alias("store_id"), "name")
    top = results.where(F.col("rank") <= shown).join(live, "store_id").groupBy(F.col("search_id").alias("id")).agg(ordered_list(F.concat_ws("|", "rank", "store_id", "name"), F.col("rank"), F.col("store_id")).alias("results"))
    return kept.join(top, "id", "left").select("user_id", "place", "id", "raw_query", "created_at", "total_result_count", F.coalesce("results", F.array().cast("array<string>")).alias("results"))


def without_history(searches: DataFrame, user: int, search: int) -> DataFrame:
    """Searches after a user has deleted one entry of the history, which is all searches of the same text."""
    same = searches.where((F.col("id") == search) & (F.col("user_id") == user)).select("user_id", history_key().alias("key"))
    return searches.withColumn("key", history_key()).join(F.broadcast(same), ["user_id", "key"], "left_anti").drop("key")


#: Tables from which an erased user's rows go, and the column that names the user.
ERASED = {"user_private_profiles": "user_id", "likes": "user_id", "favorites": "user_id", "searches": "user_id", "store_visit_verifications": "user_id", "push_devices": "user_id", "notification_outbox": "user_id"}
NOBODY = "Deleted user"


def erased(t, user: int, at: str) -> dict[str, DataFrame]:
    """The tables that change when an active account is erased; any other account is refused.

    Personal rows go, follows in both directions, and what hangs on the user's searches. The profile stays without what
    it says; live posts and comments stay as deleted ones without text or language, and their stores are counted anew.
    Mail and codes of the address go, pictures count as deleted, sessions and events are unlinked.
    """
    found = t.users.where((F.col("id") == user) & (F.col("status") == "active") & F.col("deleted_at").isNull()).select("primary_email").first()
    if found is None:
        raise ValueError("no active account")
    now = F.lit(at).cast("timestamp")
    is_ = lambda column: F.coalesce(F.col(column) == user, F.lit(False))
    set_ = lambda df, test, **values: df.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in values.items()})
    none = F.lit(None)
    out = {name: getattr(t, name).where(~is_(key)) for name, key in ERASED.items()}
    out["follows"] = t.follows.where(~is_("follower_id") & ~is_("following_id"))
    for name in ("posts", "comments"):
        out[name] = set_(getattr(t, name), is_("user_id") & F.col("deleted_at").isNull(), body=F.lit(""), content_language=none, deleted_at=now)
    gone = t.searches.where(is_("user_id")).select(F.col("id").alias("search_id"))
    for name in ("search_interactions", "search_results"):
        out[name] = getattr(t, name).join(gone, "search_id", "left_anti")
    out["media"] = set_(t.media, is_("owner_user_id"), status=F.lit("deleted"))
    out["visitor_sessions"] = set_(t.visitor_sessions, is_("linked_user_id"), linked_user_id=none)
    out["platform_events"] = set_(t.platform_events, is_("user_id"), user_id=none)
    out["verification_codes"] = t.verification_codes.where(F.col("email") != found.primary_email)
    out["email_outbox"] = t.email_outbox.where(F.col("recipient") != found.primary_email)
    out["user_profiles"] = set_(t.user_profiles, is_("user_id"), username=none, display_name=F.lit(NOBODY), avatar_url=none, bio=none, bio_language=none, city=none)
    out["users"] = set_(t.users, is_("id"), status=F.lit("inactive"), preferred_locale=F.lit("tr"), deleted_at=now)
    stores = t.posts.where(is_("user_id") & F.col("deleted_at").isNull()).select("store_id").distinct()
    out["store_stats"] = restated(t.store_stats, stores, out["posts"])
    return out


def restated(stats: DataFrame, stores: DataFrame, posts_: DataFrame) -> DataFrame:
    """``stats`` with ratings and counts of some stores taken anew from their live posts; none left: zeros."""
    new = recomputed_stats(posts_.join(stores, "store_id", "left_semi")).select("store_id", *(F.col(c).alias(f"_{c}") for c in ("average_rating", "rating_count", "review_count", "post_count")))
    rows = stats.join(stores.withColumn("_touched", F.lit(True)), "store_id", "left").join(new, "store_id", "left")
    return rows.select(*(F.when(F.col("_touched"), F.coalesce(f"_{c}", F.lit(0))).otherwise(F.col(c)).cast(kind).alias(c) if f"_{c}" in rows.columns else F.col(c) for c, kind in stats.dtypes))


def patched(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``base`` with the values of ``updates`` laid over it where they are not null; new keys are appended."""
    fields = [c for c in updates.columns if c != key]
    over = base.join(updates.select(key, *(F.col(c).alias(f"_{c}") for c in fields)), key, "full")
    return over.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns))


# Operators' lists.


def clamp(limit: int, default: int = 50, most: int = 5000) -> int:
    return limit if 1 <= limit <= most else default


def _like(query: str, *columns: str) -> Column:
    test = F.lit(False)
    for c in columns:
        test = test | F.lower(F.coalesce(F.col(c), F.lit(""))).like(f"%{query}%")
    return test


def _paged(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    rows = rows.orderBy(*order)
    return (rows.offset(offset) if offset > 0 else rows).limit(clamp(limit))


def user_list(t, query: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    query = query.strip().lower()
    rows = t.users.join(t.user_profiles.select(F.col("user_id").alias("id"), "username", "display_name"), "id", "left")
    rows = rows.where(_like(query, "primary_email", "username")) if query else rows
    rows = rows.join(counted(t.posts.where("deleted_at is null"), "user_id", "post_count", "id"), "id", "left")
    return _paged(rows.select("id", "primary_email", _blank("username"), _blank("display_name"), "status", _zero("post_count"), "created_at", "deleted_at"), [F.desc("created_at"), "id"], limit, offset)


def store_list(t, query: str = "", premium_only: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    query = query.strip().lower()
    rows = t.stores.where("deleted_at is null")
    rows = rows.where("is_premium") if premium_only else rows
    rows = rows.where(_like(query, "name", "city")) if query else rows
    links = t.store_category_links.join(F.broadcast(t.store_categories.select(F.col("id").alias("category_id"), F.col("slug").alias("category"))), "category_id").groupBy(F.col("store_id").alias("id")).agg(F.sort_array(F.collect_list("category")).alias("categories"))
    rows = rows.join(t.store_stats.withColumnRenamed("store_id", "id"), "id").join(links, "id", "left")
    out = rows.select("id", "name", "slug", "city", "is_premium", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), "review_count", "average_rating", "created_at")
    return _paged(out, [F.desc("is_premium"), F.desc("review_count"), F.desc("created_at"), "id"], limit, offset)


def review_list(t, query: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    query = query.strip().lower()
    rows = t.posts.join(t.stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name")), "store_id").join(t.user_profiles.select("user_id", "display_name"), "user_id", "left")
    rows = rows.where(_like(query, "store_name", "display_name")) if query else rows
    return _paged(rows.select("id", "store_id", "store_name", "user_id", _blank("display_name"), "rating", "body", "created_at", F.col("deleted_at").isNotNull().alias("deleted")), [F.desc("created_at"), "id"], limit, offset)


def search_log(t, query: str = "", limit: int = 50, offset: int = 0, include_result_click: bool = False) -> DataFrame:
    """Raw searches with their number of interactions.

    Of clicks only the old kind of event is counted, which is no longer written; ``include_result_click`` counts the
    new kind, too.
    """
    query = query.strip().lower()
    kinds = ("click", "store_open", "result_click") if include_result_click else ("click", "store_open")
    rows = t.searches.where(_like(query, "raw_query")) if query else t.searches
    rows = rows.join(counted(t.search_interactions.where(F.col("event_type").isin(*kinds)), "search_id", "interactions", "id"), "id", "left")
    scope = F.coalesce(F.get_json_object("parsed_intent", "$.scope"), F.lit("")).alias("scope")
    return _paged(rows.select("id", "raw_query", "user_id", _blank("query_language"), scope, "total_result_count", _zero("interactions"), "duration_ms", "fallback_state", "created_at"), [F.desc("created_at"), "id"], limit, offset)


def search_result_list(t, search: int) -> DataFrame:
    rows = t.search_results.where(F.col("search_id") == search).join(t.stores.select(F.col("id").alias("store_id"), "name"), "store_id", "left")
    return rows.select("rank", "store_id", _blank("name"), "source", "distance_meters", "ranking_score").orderBy("rank")


def audit_log(t, limit: int = 50, offset: int = 0) -> DataFrame:
    return _paged(t.admin_actions.select("id", "actor_email", "action", "target_type", "target_id", "metadata", "created_at"), [F.desc("created_at"), F.desc("id")], limit, offset)


def category_list(t) -> DataFrame:
    return t.store_categories.where("active").select("slug", "name_tr").orderBy("slug")


def store_category_slugs(t, store: int) -> DataFrame:
    links = t.store_category_links.where(F.col("store_id") == store).select(F.col("category_id").alias("id"))
    return t.store_categories.join(links, "id").select("slug").orderBy("slug")


def feedback_list(t, query: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    query = query.strip()
    rows = t.feedback.where(F.col("message").ilike(f"%{query}%") | F.col("contact_email").ilike(f"%{query}%")) if query else t.feedback
    rows = rows.join(t.user_profiles.select("user_id", F.coalesce("display_name", "username").alias("name")), "user_id", "left")
    return _paged(rows.select("id", "kind", "message", _blank("contact_email"), _blank("name"), "locale", "status", "created_at", "handled_at"), [F.desc("created_at"), "id"], limit, offset)


def audited(actions: DataFrame, changed: DataFrame, actor: str, action: str, target_type: str, at: str) -> DataFrame:
    """The audit log with a row for each changed row (id, and metadata if there is some to tell).

    Ids of new rows are hashes of what they say, so no task numbers them.
    """
    target = F.col("id").cast("string")
    new_id = F.xxhash64(F.lit(at), F.lit(actor), F.lit(action), F.lit(target_type), target)
    new = changed.select(new_id.alias("id"), F.lit(actor).alias("actor_email"), F.lit(action).alias("action"), F.lit(target_type).alias("target_type"), target.alias("target_id"), (F.col("metadata") if "metadata" in changed.columns else F.lit("{}")).alias("metadata"), F.lit(at).cast("timestamp").alias("created_at"))
    return actions.unionByName(new)


# Upkeep.


def claimable(jobs: DataFrame, as_of: str, limit: int = 10) -> DataFrame:
    """The jobs that a worker may take, oldest first: due ones, and those whose worker has been silent for 5 minutes."""
    now = F.lit(as_of).cast("timestamp")
    due = F.col("status").isin("pending", "failed") & (F.col("available_at") <= now)
    stale = (F.col("status") == "processing") & (F.col("locked_at") < now - F.expr("interval 5 minutes"))
    return jobs.where(due | stale).orderBy("available_at", "id").limit(limit)


def claimed(jobs: DataFrame, as_of: str, limit: int = 10) -> DataFrame:
    """The jobs that a worker takes, as they are while it works: an attempt counts from its beginning."""
    return claimable(jobs, as_of, limit).withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "locked_at": F.lit(as_of).cast("timestamp")})


def outcome(jobs: DataFrame, as_of: str, most: int = 10) -> DataFrame:
    """Claimed jobs whose attempt has failed, with a column ``retryable``: when they are due again, or that they are dead.

    The first failure waits a minute, each later one twice as long, at most 2 ** 8 minutes.
    """
    minutes = F.pow(F.lit(2.0), F.least(F.greatest(F.col("attempts") - 1, F.lit(0)), F.lit(8))).cast("int")
    dead = ~F.col("retryable") | (F.col("attempts") >= most)
    return jobs.withColumns({"available_at": F.when(~dead, F.lit(as_of).cast("timestamp") + F.make_dt_interval(mins=minutes)), "dead": dead, "status": F.lit("failed")})


def swept(t, as_of: str, search_days: int = 365, visitor_days: int = 180, location_days: int = 30) -> dict[str, DataFrame]:
    """What is left after a retention sweep. Searches of expired visitors go before the visitors, coordinates last.

    Results and interactions go with their search, and what named an expired visitor names none.
    """
    now = F.lit(as_of).cast("timestamp")
    before = lambda days: now - F.expr(f"interval {days} days")
    old = F.coalesce((F.col("expires_at") < now) | (F.col("last_seen_at") < before(visitor_days)), F.lit(False))
    expired = t.visitor_sessions.where(old).select(F.col("id").alias("visitor_session_id"))
    recent = t.searches.where(~(F.col("created_at") < before(search_days)))
    theirs = recent.where("user_id is null").join(expired, "visitor_session_id", "left_anti")

    def unlinked(df: DataFrame) -> DataFrame:
        marked = df.join(expired.withColumn("_gone", F.lit(True)), "visitor_session_id", "left")
        return marked.withColumn("visitor_session_id", F.when(F.col("_gone").isNull(), F.col("visitor_session_id"))).select(df.columns)

    searches = unlinked(recent.where("user_id is not null")).unionByName(theirs.select(recent.columns))
    keep = ~(F.col("created_at") < before(location_days))
    out = {"searches": searches.withColumns({c: F.when(keep, F.col(c)) for c in ("request_latitude", "request_longitude")}), "visitor_sessions": t.visitor_sessions.where(~old)}
    left = searches.select(F.col("id").alias("search_id"))
    out["search_results"] = t.search_results.join(left, "search_id", "left_semi")
    out["search_interactions"] = unlinked(t.search_interactions.join(left, "search_id", "left_semi"))
    out["store_visit_verifications"] = t.store_visit_verifications.where(~(F.coalesce(F.col("expires_at") < before(30), F.lit(False)) | F.coalesce(F.col("consumed_at") < before(30), F.lit(False))))
    out["email_outbox"] = t.email_outbox.where(~((F.col("created_at") < before(90)) & F.col("status").isin("sent", "failed")))
    out["verification_codes"] = unlinked(t.verification_codes.where(~(F.col("created_at") < before(30))))
    return out


def public_media(t) -> DataFrame:
    """Pictures that anybody may see: ready ones of live posts."""
    shown = t.post_media.join(t.posts.where("deleted_at is null").select(F.col("id").alias("post_id")), "post_id", "left_semi")
    return t.media.where("status = 'ready'").join(shown.select(F.col("media_id").alias("id")), "id", "left_semi").select("id", "mime_type")


def limited(codes: DataFrame, as_of: str) -> DataFrame:
    """How many codes each address, network and visitor has asked for lately: 10 minutes for the first, then an hour."""
    now = F.lit(as_of).cast("timestamp")
    parts = [("email", "interval 10 minutes"), ("ip", "interval 1 hour"), ("visitor_session_id", "interval 1 hour")]
    out = None
    for column, reach in parts:
        rows = codes.where((F.col("created_at") > now - F.expr(reach)) & (F.col("created_at") <= now) & F.col(column).isNotNull())
        found = rows.groupBy(F.lit(column).alias("kind"), F.col(column).cast("string").alias("key")).agg(F.count("*").alias("requests"))
        out = found if out is None else out.unionByName(found)
    return out


def active_accounts(t) -> DataFrame:
    return t.users.where("deleted_at is null and status = 'active'").select("id", "preferred_locale")
