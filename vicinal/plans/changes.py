"""Batches of changes: operators' decisions with their audit rows, toggled edges with counters and events, messages, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import locale_of, trimmed
from ..operators.tables import folded_by
from .people import audited, restated

STATUSES = ("active", "suspended")
MESSAGE_STATUSES = ("new", "read", "handled")
#: What a message may be about, and the length of its text.
MESSAGE_KINDS, MESSAGE_LEAST, MESSAGE_MOST = ("suggestion", "problem", "praise", "other"), 5, 4000


def _decided(rows: DataFrame, decisions: DataFrame, may: Column, key: str = "id") -> DataFrame:
    """The decisions (id, ...) about rows that they may change; of several about one row the first by its values."""
    once = decisions.groupBy(key).agg(F.min(F.struct(*(c for c in decisions.columns if c != key))).alias("d")).select(key, "d.*") if len(decisions.columns) > 1 else decisions.distinct()
    return once.join(rows.where(may).select(key), key, "left_semi")


def _with(rows: DataFrame, decided: DataFrame, **values: Column) -> DataFrame:
    """``rows`` with new values where they are decided about; a value may use columns of both."""
    marked = rows.join(decided.withColumn("_decided", F.lit(True)), "id", "left")
    return marked.select(*(F.when(F.col("_decided"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns))


def with_premium(stores: DataFrame, actions: DataFrame, decisions: DataFrame, actor: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(stores, actions) after decisions (id, premium) about live stores."""
    decided = _decided(stores, decisions, F.col("deleted_at").isNull())
    after = _with(stores, decided, is_premium=F.col("premium"), updated_at=F.lit(at).cast("timestamp"))
    return after, audited(actions, decided.select("id", F.to_json(F.struct(F.col("premium").alias("is_premium"))).alias("metadata")), actor, "store.premium", "store", at)


def with_status(users: DataFrame, actions: DataFrame, decisions: DataFrame, actor: str, actor_id: int, at: str) -> tuple[DataFrame, DataFrame]:
    """(users, actions) after decisions (id, new_status) about live accounts, but the operator's own."""
    good = decisions.where(F.col("new_status").isin(*STATUSES) & (F.col("id") != actor_id))
    decided = _decided(users, good, F.col("deleted_at").isNull() & (F.col("status") != "deleted"))
    return _with(users, decided, status=F.col("new_status")), audited(actions, decided.select("id", F.to_json(F.struct(F.col("new_status").alias("status"))).alias("metadata")), actor, "user.status", "user", at)


def with_categories(stores: DataFrame, links: DataFrame, categories: DataFrame, actions: DataFrame, decisions: DataFrame, actor: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(links, actions) after decisions (id, slugs): live stores get just these categories, of the active ones."""
    decided = _decided(stores, decisions, F.col("deleted_at").isNull())
    active = categories.where("active").select(F.col("id").alias("category_id"), "slug")
    new = decided.select(F.col("id").alias("store_id"), F.explode(F.array_distinct("slugs")).alias("slug")).join(active, "slug").select("store_id", "category_id")
    after = links.join(decided.select(F.col("id").alias("store_id")), "store_id", "left_anti").select("store_id", "category_id").unionByName(new)
    return after, audited(actions, decided.select("id", F.to_json(F.struct("slugs")).alias("metadata")), actor, "store.categories", "store", at)


def without_reviews(posts_: DataFrame, stats: DataFrame, actions: DataFrame, decisions: DataFrame, actor: str, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posts, stats, actions) after live posts (id) are taken down: no text, no language, and their stores counted anew."""
    decided = _decided(posts_, decisions, F.col("deleted_at").isNull())
    after = _with(posts_, decided, body=F.lit(""), content_language=F.lit(None), deleted_at=F.lit(at).cast("timestamp"))
    whose = decided.join(posts_.select("id", "store_id"), "id")
    log = audited(actions, whose.select("id", F.to_json(F.struct(F.col("store_id").cast("string").alias("store_id"))).alias("metadata")), actor, "post.delete", "post", at)
    return after, restated(stats, whose.select("store_id").distinct(), after), log


def with_handled(feedback: DataFrame, actions: DataFrame, decisions: DataFrame, actor: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(feedback, actions) after decisions (id, new_status) about messages; only a handled one has a time of handling."""
    decided = _decided(feedback, decisions.where(F.col("new_status").isin(*MESSAGE_STATUSES)), F.lit(True))
    after = _with(feedback, decided, status=F.col("new_status"), handled_at=F.when(F.col("new_status") == "handled", F.lit(at).cast("timestamp")))
    return after, audited(actions, decided.select("id", F.to_json(F.struct(F.col("new_status").alias("status"))).alias("metadata")), actor, "feedback.status", "feedback", at)


def appended(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """``feedback`` and the messages (id, user_id, kind, message, contact_email, locale, created_at) that are valid.

    A message needs a known kind (none: other) and MESSAGE_LEAST to MESSAGE_MOST characters; an address, if there is one, an at sign
    and 320 characters at most.
    """
    text, email = trimmed("message"), trimmed(F.coalesce("contact_email", F.lit("")))
    rows = messages.withColumns({"kind": F.coalesce(F.nullif(trimmed("kind"), F.lit("")), F.lit("other")), "message": text, "contact_email": email})
    good = F.col("kind").isin(*MESSAGE_KINDS) & F.length("message").between(MESSAGE_LEAST, MESSAGE_MOST) & ((F.col("contact_email") == "") | (F.contains("contact_email", F.lit("@")) & (F.length("contact_email") <= 320)))
    new = rows.where(good).withColumns({"contact_email": F.nullif("contact_email", F.lit("")), "status": F.lit("new"), "handled_at": F.lit(None).cast("timestamp")})
    return feedback.unionByName(new.select(feedback.columns))


def effective(edges: DataFrame, changes: DataFrame, keys: list[str], allowed: Column | None = None) -> DataFrame:
    """The changes (keys, created_at, id, add) that change anything, in the order of created_at and id of each edge.

    An edge is added only if it is not there, and removed only if it is. allowed: a test that an addition has to pass.
    """
    rows = changes.where(~F.col("add") | allowed) if allowed is not None else changes
    rows = rows.join(edges.select(*keys).distinct().withColumn("_there", F.lit(True)), keys, "left")
    before = F.lag("add").over(W.partitionBy(*keys).orderBy("created_at", "id"))
    return rows.withColumn("_before", F.coalesce(before, "_there", F.lit(False))).where(F.col("add") != F.col("_before")).drop("_before", "_there")


def counted_edges(counters: DataFrame, changed: DataFrame, key: str, column: str) -> DataFrame:
    """Counters after effective changes, none below 0."""
    return folded_by(counters, changed.select(key, F.when(F.col("add"), 1).otherwise(-1).alias("delta")), key, column)


def as_events(changed: DataFrame, made: str, gone: str) -> DataFrame:
    """Effective changes as rows for the event log, each with its own key."""
    return changed.withColumn("event_type", F.when(F.col("add"), made).otherwise(gone)).withColumn("idempotency_key", F.concat(F.lit("change:"), F.col("id").cast("string"))).drop("add")


def touched_sessions(sessions: DataFrame, visits: DataFrame, days: int = 90) -> DataFrame:
    """Sessions (id, linked_user_id, locale, created_at, last_seen_at, expires_at) after visits (id, locale, at).

    A new session begins; a known one is seen again, speaks the language of its last visit, and lasts ``days`` from then,
    or as long as it would have if that is longer.
    """
    last = visits.groupBy("id").agg(F.max("at").alias("_last"), F.min("at").alias("_first"), F.max_by("locale", F.struct("at", "locale")).alias("_locale"))
    both = sessions.join(last, "id", "full")
    seen = F.col("_last").isNotNull()
    new = {
        "locale": F.when(seen, F.col("_locale")).otherwise(F.col("locale")),
        "created_at": F.coalesce("created_at", "_first"),
        "last_seen_at": F.when(seen, F.greatest("last_seen_at", "_last")).otherwise(F.col("last_seen_at")),
        "expires_at": F.greatest("expires_at", F.col("_last") + F.expr(f"interval {days} days")),
    }
    return both.select(*(new[c].alias(c) if c in new else F.col(c) for c in sessions.columns))


def profile_errors(u: dict[str, Column]) -> Column:
    """The first field of a profile's update that is not valid, or null. Fields that are null are not touched."""
    size = lambda name: F.length(trimmed(u[name]))
    tests = [("username", ~size("username").between(3, 30) | ~trimmed(u["username"]).rlike("^[A-Za-z0-9_]+$"))] if "username" in u else []
    tests += [(name, (size(name) > most) | F.contains(u[name], F.lit("\0"))) for name, most in (("display_name", 100), ("bio", 500), ("city", 100), ("relationship_status", 40), ("occupation", 100), ("age_range", 40)) if name in u]
    if "avatar_url" in u:
        tests.append(("avatar_url", (F.octet_length(trimmed(u["avatar_url"])) > 2048) | ~trimmed(u["avatar_url"]).rlike("^$|^https?://[^/\\s]+")))
    if "housing_status" in u:
        tests.append(("housing_status", ~u["housing_status"].isin("owner", "renter", "living_with_family", "other")))
    tests += [(name, locale_of(u[name]).isNull()) for name in ("preferred_locale", "bio_language") if name in u]
    out = F.lit(None).cast("string")
    for name, wrong in reversed(tests):
        out = F.when(u[name].isNotNull() & wrong, F.lit(name)).otherwise(out)
    return out
