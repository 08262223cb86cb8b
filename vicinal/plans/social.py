"""The social feed: posts with their authors, counts and viewer flags; keyset pages; comments; visits."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gathering import ordered_list
from ..functions.geo import haversine, valid_coordinates
from ..functions.scores import level
from ..operators.tables import top_per_group

VISIT_RADIUS_M, MOST_ACCURACY_M, PROOF_DAYS = 500, 100, 30


def counted(rows: DataFrame, key: str, name: str, as_key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias(as_key)).agg(F.count("*").alias(name))


def posts(t, viewer: int | None = None, where=None, strict: bool = False) -> DataFrame:
    """Live posts with all that a page shows. strict: authors and stores must be live, too.

    ``where`` filters the posts before anything is joined to them. Counts are aggregated first and joined as one row.
    """
    rows = t.posts.where("deleted_at is null")
    rows = rows.where(where) if where is not None else rows
    base = rows.select(F.col("id").alias("post_id"), "user_id", "store_id", "body", F.coalesce("content_language", F.lit("")).alias("content_language"), "rating", "visit_verified", "verification_distance_meters", "created_at")
    stores = t.stores.where("deleted_at is null") if strict else t.stores
    if strict:
        base = base.join(t.users.where("deleted_at is null").select(F.col("id").alias("user_id")), "user_id", "left_semi")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    who = t.user_profiles.select("user_id", blank("username").alias("username"), blank("display_name").alias("display_name"), blank("avatar_url").alias("avatar_url"))
    what = stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"), F.col("city").alias("store_city"), blank("district").alias("store_district"), "latitude", "longitude")
    shown = t.media.select(F.col("id").alias("media_id"), F.concat_ws("|", "id", F.concat(F.lit("/media/"), F.col("id")), "mime_type", "width", "height").alias("shown"))
    pictures = t.post_media.join(shown, "media_id").groupBy("post_id").agg(ordered_list(F.col("shown"), F.col("position"), F.col("media_id")).alias("media"))
    flag = lambda df, key, as_key, name: df.select(F.col(key).alias(as_key), F.lit(True).alias(name)).distinct()
    me = F.lit(viewer)
    rows = (
        base.join(who, "user_id").join(what, "store_id")
        .join(counted(t.posts.where("deleted_at is null"), "user_id", "author_reviews", "user_id"), "user_id", "left")
        .join(counted(t.likes, "post_id", "likes", "post_id"), "post_id", "left")
        .join(counted(t.comments.where("deleted_at is null"), "post_id", "comments", "post_id"), "post_id", "left")
        .join(pictures, "post_id", "left")
        .join(flag(t.likes.where(F.col("user_id") == me), "post_id", "post_id", "liked"), "post_id", "left")
        .join(flag(t.follows.where(F.col("follower_id") == me), "following_id", "user_id", "followed"), "user_id", "left")
        .join(flag(t.favorites.where(F.col("user_id") == me), "store_id", "store_id", "favorited"), "store_id", "left")
    )
    zero, no = lambda c: F.coalesce(F.col(c), F.lit(0)), lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.select(
        "post_id", "user_id", "store_id", "body", "content_language", "rating", "visit_verified", "verification_distance_meters", "created_at", "username", "display_name", "avatar_url", "store_name", "store_city", "store_district", "latitude", "longitude",
        zero("author_reviews").alias("author_review_count"), level(zero("author_reviews")).alias("author_level"), zero("likes").alias("like_count"), zero("comments").alias("comment_count"), no("liked").alias("viewer_liked"),
        no("followed").alias("viewer_follows"), no("favorited").alias("viewer_favorited"), F.coalesce("media", F.array().cast("array<string>")).alias("media"),
    )


def encode_cursor(mode: str, row) -> str:
    value = {"m": mode, "t": row["created_at"].isoformat(), "id": row["post_id"]} | ({"d": row["store_distance_meters"]} if mode == "nearby" else {})
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")


def decode_cursor(text: str, mode: str) -> dict:
    """The place at which a page ended; one without a mode is of the newest posts.

    A cursor of the other mode, with a negative distance, or no cursor at all, is refused.
    """
    try:
        value = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        ok = value.get("m", "recent") == mode and isinstance(value["id"], str) and isinstance(value["t"], str) and (mode == "recent" or isinstance(value["d"], (int, float)) and value["d"] >= 0)
    except (ValueError, KeyError, TypeError, AttributeError):
        ok = False
    if not ok:
        raise ValueError("invalid cursor")
    return value


def feed(t, viewer: int | None = None, cursor: str = "", limit: int = 20, centre: tuple[float, float] | None = None) -> DataFrame:
    """A page of the feed and one row more, which tells whether there is a next page: newest first, or nearest first."""
    limit = limit if 1 <= limit <= 50 else 20
    mode = "nearby" if centre else "recent"
    at = decode_cursor(cursor, mode) if cursor else None
    where = None
    earlier = None
    if at:
        earlier = lambda key: F.struct(F.col("created_at").alias("t"), F.col(key).alias("i")) < F.struct(F.lit(at["t"]).cast("timestamp").alias("t"), F.lit(at["id"]).alias("i"))
        where = earlier("id") if mode == "recent" else None
    rows = posts(t, viewer, where, strict=True)
    distance = haversine(F.col("latitude"), F.col("longitude"), *centre) if centre else F.lit(None).cast("double")
    rows = rows.withColumn("store_distance_meters", distance)
    if at and mode == "nearby":
        rows = rows.where((F.col("store_distance_meters") > at["d"]) | ((F.col("store_distance_meters") == at["d"]) & earlier("post_id")))
    return rows.orderBy(F.asc_nulls_last("store_distance_meters"), F.desc("created_at"), F.desc("post_id")).limit(limit + 1)


def page(rows: DataFrame, limit: int, mode: str) -> tuple[list, str]:
    """The rows of a page, and the cursor of the next one or an empty text."""
    found = rows.collect()  # at most limit + 1 rows
    return found[:limit], encode_cursor(mode, found[limit - 1]) if len(found) > limit else ""


def post(t, post_id: str, viewer: int | None = None) -> DataFrame:
    return posts(t, viewer, F.col("id") == post_id)


def posts_by(t, column: str, key: int, viewer: int | None = None, limit: int = 20) -> DataFrame:
    """Newest posts of a user or a store, whether or not the other side is live."""
    if column not in ("user_id", "store_id"):
        raise ValueError(f"not a column to list posts by: {column}")
    return posts(t, viewer, F.col(column) == key).orderBy(F.desc("created_at"), F.desc("post_id")).limit(limit if 1 <= limit <= 50 else 20)


def comments(t, post_id: str | None = None, limit: int = 50) -> DataFrame:
    """The first live comments of a post, or of every post, with their authors."""
    limit = limit if 1 <= limit <= 100 else 50
    rows = t.comments.where("deleted_at is null")
    if post_id is not None:
        rows = rows.where(F.col("post_id") == post_id)
    rows = top_per_group(rows, ["post_id"], limit, F.col("created_at"), F.col("id")).join(t.user_profiles, "user_id")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select("post_id", "id", "user_id", "body", blank("content_language"), "created_at", blank("username"), blank("display_name"), blank("avatar_url")).orderBy("post_id", "created_at", "id")


def verify_visits(claims: DataFrame, stores: DataFrame, radius_m: float = VISIT_RADIUS_M, most_accuracy_m: float = MOST_ACCURACY_M) -> DataFrame:
    """Claims (id, store_id, latitude, longitude, accuracy) with their distance and whether they prove a visit.

    The distance and the accuracy that the device reports have to fit into the radius together; an accuracy that is not
    positive, or above its own limit, proves nothing.
    """
    where = stores.where("deleted_at is null").select(F.col("id").alias("store_id"), F.col("latitude").alias("s_lat"), F.col("longitude").alias("s_lon"))
    rows = claims.join(where, "store_id").withColumn("distance", haversine(F.col("latitude"), F.col("longitude"), F.col("s_lat"), F.col("s_lon")))
    return rows.withColumn("verified", valid_coordinates(F.col("latitude"), F.col("longitude")) & (F.col("accuracy") > 0) & (F.col("accuracy") <= most_accuracy_m) & (F.col("distance") + F.col("accuracy") <= radius_m)).drop("s_lat", "s_lon")


def usable_proofs(t, as_of: str) -> DataFrame:
    """The newest proof of each user and live store that is neither used nor expired."""
    now = F.lit(as_of).cast("timestamp")
    open_ = t.store_visit_verifications.where(F.col("consumed_at").isNull() & (F.col("expires_at") > now) & (F.col("verified_at") <= now))
    open_ = open_.join(t.stores.where("deleted_at is null").select(F.col("id").alias("store_id")), "store_id", "left_semi")
    newest = open_.groupBy("user_id", "store_id").agg(F.max_by(F.struct("id", "distance", "accuracy", "verified_at"), F.struct("verified_at", "id")).alias("p"))
    return newest.select("user_id", "store_id", "p.*")


def proven(proofs: DataFrame, visits: DataFrame, days: int = PROOF_DAYS) -> DataFrame:
    """Proofs after verified visits (id, user_id, store_id, distance, accuracy, verified_at).

    Of a user and a store one proof at most is open: a new visit renews it and keeps its id. Of several visits the last
    counts, of several open proofs the one of the smallest id is renewed and the others go.
    """
    open_ = proofs.where("consumed_at is null")
    last = visits.groupBy("user_id", "store_id").agg(F.max_by(F.struct("id", "distance", "accuracy", "verified_at"), F.struct("verified_at", "id")).alias("v")).select("user_id", "store_id", "v.*")
    known = open_.groupBy("user_id", "store_id").agg(F.min("id").alias("old_id"))
    new = last.join(known, ["user_id", "store_id"], "left").withColumns({"id": F.coalesce("old_id", "id"), "expires_at": F.col("verified_at") + F.expr(f"interval {days} days"), "consumed_at": F.lit(None).cast("timestamp")})
    stay = open_.join(last.select("user_id", "store_id"), ["user_id", "store_id"], "left_anti")
    return proofs.where("consumed_at is not null").unionByName(stay.select(proofs.columns)).unionByName(new.select(proofs.columns))


def consumed(t, uses: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(proofs, accepted) after reviews (post_id, proof_id, user_id, store_id) that name a proof.

    A proof counts for its own user and live store, once, and as long as it is open; of several reviews the one of the
    smallest post_id gets it.
    """
    now = F.lit(as_of).cast("timestamp")
    proofs = t.store_visit_verifications
    open_ = proofs.where(F.col("consumed_at").isNull() & (F.col("expires_at") > now)).join(t.stores.where("deleted_at is null").select(F.col("id").alias("store_id")), "store_id", "left_semi")
    fits = uses.join(open_.select(F.col("id").alias("proof_id"), "user_id", "store_id", "distance", "verified_at"), ["proof_id", "user_id", "store_id"])
    accepted = fits.groupBy("proof_id").agg(F.min_by(F.struct("post_id", "user_id", "store_id", "distance", "verified_at"), "post_id").alias("r")).select("proof_id", "r.*")
    after = proofs.join(accepted.select(F.col("proof_id").alias("id"), F.lit(True).alias("_used")), "id", "left")
    return after.withColumn("consumed_at", F.when(F.col("_used"), now).otherwise(F.col("consumed_at"))).select(proofs.columns), accepted


def recomputed_stats(posts_: DataFrame) -> DataFrame:
    """Ratings and counts of stores from their live posts."""
    found = posts_.where("deleted_at is null").groupBy("store_id").agg(F.round(F.avg(F.col("rating").cast("double")), 2).alias("average_rating"), F.count("*").alias("rating_count"))
    return found.withColumns({"review_count": F.col("rating_count"), "post_count": F.col("rating_count")})
