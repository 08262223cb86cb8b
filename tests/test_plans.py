"""Plans on small tables: rankings, parsing, folding, pages, upkeep, streams."""

import ast
import datetime as dt
import hashlib
import json
import os
import random
import tempfile
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from vicinal import oracle, queries
from vicinal.plans import folding, intent, people, search, social
from vicinal.plans import reporting as R
from vicinal.sources.canonical import RAW, TABLES, Tables
from vicinal.streaming import jobs

SF = "/root/testdata/sf0.001"
RESULT = "search_id long, position int, name string, city string, address string, distance_meters double, score double, premium boolean, review_count int, located boolean, name_led boolean"


def ranked(spark, rows, located=True, name_led=False):
    full = [(1, i, n, c, "", None if d is None else float(d), float(s), p, r, located, name_led) for i, (n, c, d, s, p, r) in enumerate(rows)]
    out = search.rank_results(spark.createDataFrame(full, RESULT))
    return [r.name for r in out.orderBy("rank").collect()]


def test_promoted_and_reviewed_lead_at_home_only(spark):
    rows = [("near", "Antalya", 100, 50, False, 0), ("reviewed", "Muratpaşa/Antalya", 9_000, 310, False, 2), ("promoted", "antalya", 12_000, 10, True, 0), ("far promoted", "Denizli", 150_000, 400, True, 9), ("nowhere", "", None, 500, False, 0)]
    assert ranked(spark, rows) == ["promoted", "reviewed", "near", "far promoted", "nowhere"]


def test_ranking_against_plain_sorting(spark):
    rnd = random.Random(8)
    for _ in range(4):
        rows = [(f"n{i}", rnd.choice(["A", "B", ""]), rnd.choice([None, rnd.randint(0, 90_000)]), rnd.randint(0, 5), rnd.random() < 0.3, rnd.randint(0, 1)) for i in range(40)]
        known = [(r[2], i, r[1].lower()) for i, r in enumerate(rows) if r[2] is not None and r[1]]
        home = min(known)[2] if known else ""

        def key(x, home=home):
            i, (_, c, d, s, p, v) = x
            here = home and c.lower() == home
            if here and p:
                return 0, 0, -s, i
            if here and v > 0:
                return 1, 0, -s, i
            band = 2**31 if d is None else d // 500 if d <= 25_000 else 51 + (d - 25_000) // 5_000
            return 2, band, -s, i

        assert ranked(spark, rows) == [r[0] for _, r in sorted(enumerate(rows), key=key)]


def test_horizon(spark):
    make = lambda ds: spark.createDataFrame([(1, i, str(i), "", "", d, 0.0, False, 0, True, False) for i, d in enumerate(ds)], RESULT)
    assert search.local_horizon(make([1e3, 2e3, None, 4e3, 5e4, 9e4, 2e5])).count() == 5
    assert search.local_horizon(make([9e4, 2e5])).count() == 2
    assert search.local_horizon(make([1e3, 2e3, 3e3, 9e4])).count() == 4


def parse(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, query string")
    return [r.intent.asDict() for r in intent.parse_intent(df).orderBy("i").collect()]


def test_one_request_in_four_languages(spark):
    found = parse(spark, "Antalya'da ucuz perde", "cheap curtains in Antalya", "günstige Gardinen in Antalya", "дешевые шторы в Анталье")
    for i, language in zip(found, ("tr", "en", "de", "ru"), strict=True):
        assert (i["scope"], i["price_intent"], i["location_text"], i["categories"]) == ("home_living", "budget", "Antalya", ["curtain", "home_textile"])
        assert i["query_language"] == language


def test_scopes(spark):
    tyres, hello, brand, dowry, mixed = parse(spark, "tyre shop in Berlin", "hello", "IKEA", "çeyiz alışverişi", "modern ve minimal avize, büyük seçenek")
    assert (tyres["scope"], tyres["location_text"], tyres["categories"]) == ("out_of_scope", "Berlin", [])
    assert hello["scope"] == "unclear" and (brand["scope"], brand["store_name"]) == ("home_living", "ikea")
    assert dowry["categories"] == ["home_textile", "bedding", "kitchenware", "tableware"] and dowry["semantic_terms"] == ["home dowry shopping"]
    assert mixed["style_terms"] == ["modern", "minimal"] and mixed["attributes"] == ["large_selection"] and mixed["product_terms"] == ["chandelier"]


def test_validation(spark):
    good = parse(spark, "modern avize")[0]
    fields = "scope string, query_language string, normalized_query string, store_name string, location_text string, categories array<string>, product_terms array<string>, style_terms array<string>, price_intent string, attributes array<string>, sort_preference string, semantic_terms array<string>"
    cases = [
        ({}, None), ({"normalized_query": "я" * 500}, None), ({"normalized_query": "я" * 501}, "text_length"), ({"categories": ["garden"]}, "category"), ({"scope": "x"}, "scope"), ({"query_language": "fr"}, "language"),
        ({"store_name": "a\nb"}, "store_name"), ({"scope": "unclear"}, "terms_without_home"), ({"product_terms": ["x"] * 13}, "too_many"), ({"attributes": [" "]}, "term"), ({"price_intent": "free"}, "price"), ({"sort_preference": "name"}, "order"),
    ]
    order = [f.split()[0] for f in fields.split(", ")]
    df = spark.createDataFrame([(i, tuple((good | change)[n] for n in order)) for i, (change, _) in enumerate(cases)], f"i int, v struct<{fields.replace(' ', ':').replace(',:', ',')}>")
    assert [r[0] for r in df.orderBy("i").select(intent.intent_error(F.col("v"))).collect()] == [e for _, e in cases]


EVENT = "id long, event_type string, idempotency_key string, user_id long, created_at timestamp"


def events(spark, kinds):
    at = dt.datetime(2020, 1, 1)
    return spark.createDataFrame([(i, k, key, 1, at + dt.timedelta(hours=i)) for i, (k, key) in enumerate(kinds)], EVENT)


def test_fold(spark):
    one = folding.fold(events(spark, [("post_created", "a"), ("post_created", "a"), ("post_created", None), ("post_created", None), ("post_deleted", "b"), ("like_removed", "c"), ("otp_requested", "d")])).first()
    assert (one.posts, one.posts_created, one.posts_deleted, one.likes) == (2, 3, 1, 0)
    for kind in ("favorite", "like", "follow", "comment"):
        made, gone = ("created", "deleted") if kind == "comment" else ("created", "removed")
        assert sum(folding.fold(events(spark, [(f"{kind}_{made}", None), (f"{kind}_{gone}", None)])).first()) == 0


def test_clamped_fold(spark):
    rnd = random.Random(2)
    kinds = [(rnd.choice(["favorite_created", "favorite_removed", "favorite_removed"]), None) for _ in range(60)]
    value = 0
    for k, _ in kinds:
        value = max(0, value + (1 if k == "favorite_created" else -1))
    assert folding.clamped_fold(events(spark, kinds), "favorites", "user_id").first().favorites == value


def test_attribution_expires(spark):
    at = dt.datetime(2020, 1, 10)
    searches = spark.createDataFrame([(1, 7, at - dt.timedelta(hours=71)), (2, 7, at - dt.timedelta(hours=73)), (3, 8, at)], "id long, user_id long, created_at timestamp")
    results = spark.createDataFrame([(11, 1, 5, None, None), (12, 1, None, "google", "p"), (21, 2, 5, None, None), (31, 3, 5, None, None)], "id long, search_id long, store_id long, external_provider string, external_place_id string")
    sources = spark.createDataFrame([(5, "google", "p")], "store_id long, provider string, external_id string")
    claims = spark.createDataFrame([(1, 1, 11, 7, 5, at), (2, 1, 12, 7, 5, at), (3, 2, 21, 7, 5, at), (4, 3, 31, 7, 5, at), (5, 1, 11, 7, 6, at), (6, 2, 11, 7, 5, at)], "id long, search_id long, search_result_id long, user_id long, store_id long, created_at timestamp")
    assert sorted(r.id for r in folding.attributed(claims, searches, results, sources).collect()) == [1, 2]


@pytest.mark.parametrize("centre", [None, queries.CENTRE])
def test_feed_pages_join_without_gaps(spark, centre):
    t = Tables(spark, SF)
    mode, seen, cursor = ("nearby" if centre else "recent"), [], ""
    for _ in range(3):
        rows, cursor = social.page(social.feed(t, 7, cursor, 7, centre), 7, mode)
        seen += [r.post_id for r in rows]
    assert seen == [r.post_id for r in social.feed(t, 7, "", 21, centre).collect()][:21]
    with pytest.raises(ValueError, match="cursor"):
        social.feed(t, 7, cursor, 7, None if centre else queries.CENTRE)


def test_rollup_invariants(spark):
    t = Tables(spark, SF)
    days = R.platform_daily(t).cache()
    bad = days.where("searches_count <> searches_with_results_count + zero_result_searches_count or searches_count <> authenticated_searches_count + anonymous_searches_count")
    assert bad.count() == 0
    assert R.sums(days, "1990-01-01", "2030-01-01").first().searches_count == t.searches.count()
    assert R.sums(days, "1980-01-01", "1980-01-02").first().searches_count == 0


def test_queue_and_patch(spark):
    at = dt.datetime(2020, 1, 1, 12)
    jobs_ = spark.createDataFrame([(1, "pending", 0, at, None), (2, "failed", 9, at - dt.timedelta(hours=1), None), (3, "processing", 1, at, at - dt.timedelta(minutes=6)), (4, "processing", 1, at, at - dt.timedelta(minutes=4)), (5, "pending", 0, at + dt.timedelta(seconds=1), None), (6, "sent", 0, at, None)], "id long, status string, attempts int, available_at timestamp, locked_at timestamp")
    assert [r.id for r in people.claimable(jobs_, "2020-01-01 12:00:00").collect()] == [2, 1, 3]
    taken = people.claimed(jobs_, "2020-01-01 12:00:00")
    assert {r.id: (r.status, r.attempts, r.locked_at) for r in taken.collect()} == {1: ("processing", 1, at), 2: ("processing", 10, at), 3: ("processing", 2, at)}
    after = {r.id: (r.attempts, r.dead, r.available_at) for r in people.outcome(taken.withColumn("retryable", F.col("id") != 3), "2020-01-01 12:00:00").collect()}
    assert after == {1: (1, False, at + dt.timedelta(minutes=1)), 2: (10, True, None), 3: (2, True, None)}
    base = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "k int, x string, y string")
    new = spark.createDataFrame([(2, None, "n"), (3, "z", None)], "k int, x string, y string")
    assert sorted(tuple(r) for r in people.patched(base, new, "k").collect()) == [(1, "a", "b"), (2, "c", "n"), (3, "z", None)]


def test_search_by_name_imports_and_records(spark):
    """A place name that is a store's name, a plain request with provider's places, and one that nobody understands."""
    t = Tables(spark, SF)
    store = t.stores.where("deleted_at is null and not is_premium").orderBy("id").first()
    far = (store.latitude + 9.0, store.longitude)
    gone = t.stores.where("deleted_at is not null").join(t.store_external_sources.where("provider = 'google'"), F.col("store_id") == t.stores["id"]).select("store_id", "external_id").first()
    asked = [(1, store.name, *far, 10_000), (2, "curtain", *queries.CENTRE, 10_000), (3, "qqqq wwww", *queries.CENTRE, 10_000)]
    requests = spark.createDataFrame(asked, "search_id long, query string, r_lat double, r_lon double, radius int")
    rows = [(s, 0, "new-1", "Perde Evi", "X, Antalya", 36.9, 30.7, 4.5, 10, "tel") for s in (1, 2, 3)] + [(2, 1, "", "nameless id", "X, Antalya", 36.9, 30.7, 4.5, 10, ""), (2, 2, gone.external_id, "Old", "X, Antalya", 36.9, 30.7, 4.5, 10, "")]
    places = spark.createDataFrame(rows, "search_id long, position int, place_id string, name string, address string, latitude double, longitude double, rating double, rating_count int, phone string")
    failures = spark.createDataFrame([(2, ["ai_timeout", "places_unavailable"]), (3, [])], "search_id long, reasons array<string>")
    results, searches = search.search_batch(t, requests, places, failures=failures)
    got = results.collect()
    mine = next(r for r in got if r.search_id == 1 and r.store_id == store.id)
    assert mine.rank <= 10 and not any(r.place_id for r in got if r.search_id == 1)
    named = [r for r in got if r.search_id == 1 and r.name == store.name]
    assert all(r.distance_meters > 500_000 for r in named) and mine.score > 0  # a name that was asked for costs 3 points at most
    keys = {r.place_id: (r.store_id, r.store_key) for r in got if r.search_id == 2 and r.place_id is not None}
    assert keys["new-1"] == (None, hashlib.sha256(b"google:new-1").hexdigest()) and keys[""] == (None, None) and keys[gone.external_id] == (gone.store_id, str(gone.store_id))
    one, two, three = searches.orderBy("search_id").collect()
    intent_ = json.loads(one.parsed_intent)
    assert (intent_["scope"], intent_["store_name"], one.places_used, one.external_result_count, one.guidance_code) == ("home_living", store.name, False, 0, None)
    assert (two.places_used, two.external_result_count, two.fallback_state, two.search_mode) == (True, 3, "ai_timeout,places_unavailable", "hybrid") and two.total_result_count >= 3
    assert (three.guidance_code, three.guidance_reason, three.guidance_examples, three.total_result_count, three.fallback_state) == ("HOME_LIVING_ONLY", "unclear", ["3", "4"], 0, None)


def stream_of(spark, df, folder):
    path = os.path.join(folder, "in")
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream, name, mode, folder):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", os.path.join(folder, "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_stream_folds_like_the_batch(spark):
    t = Tables(spark, SF)
    rows = t.platform_events.select("id", "event_type", "idempotency_key", "user_id", "created_at").where("id < 300")
    with tempfile.TemporaryDirectory() as folder:
        stream = stream_of(spark, rows.orderBy("created_at", "id"), folder)
        jobs.first_of_keys(stream).writeStream.outputMode("update").foreachBatch(jobs.fold_batches(f"{folder}/out")).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
        assert jobs.folded(spark, f"{folder}/out").first() == folding.fold(rows).first()


def test_stream_counts_days_like_the_batch(spark):
    t = Tables(spark, SF)
    rows = t.platform_events.select("id", "event_type", "created_at")
    with tempfile.TemporaryDirectory() as folder:
        got = drained(jobs.daily_counts(stream_of(spark, rows, folder), late="4000 days"), "days", "complete", folder)
        want = R.dated(rows).groupBy("metric_date", "event_type").count()
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_stream_once(spark):
    at = dt.datetime(2020, 1, 1)
    rows = spark.createDataFrame([(i, "x", None if i % 4 == 0 else f"k{i % 5}", 1, at + dt.timedelta(minutes=i)) for i in range(40)], EVENT)
    with tempfile.TemporaryDirectory() as folder:
        got = drained(jobs.once(stream_of(spark, rows, folder)), "once", "append", folder).collect()
    assert sum(r.idempotency_key is None for r in got) == 10
    assert sorted(r.idempotency_key for r in got if r.idempotency_key) == [f"k{i}" for i in range(5)]


def test_stream_outbox(spark):
    at = dt.datetime(2020, 1, 1)
    steps = [(1, "enqueued"), (1, "claimed"), (1, "failed"), (1, "claimed"), (1, "sent"), (1, "failed"), (2, "enqueued")] + [(j, k) for j, n in ((3, 10), (4, 9)) for k in ["enqueued"] + ["claimed", "failed"] * n] + [(5, "enqueued"), (5, "claimed"), (5, "refused")]
    times = {j: i for i, (j, _) in enumerate(steps)}
    rows = spark.createDataFrame([(j, k, at + dt.timedelta(minutes=i)) for i, (j, k) in enumerate(steps)], "id long, kind string, at timestamp")
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "in")
        rows.coalesce(1).write.parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        got = {r.id: (r.status, r.attempts, r.available_at) for r in drained(jobs.outbox_states(stream), "outbox", "update", folder).collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: ("sent", 2), 2: ("pending", 0), 3: ("dead", 10), 4: ("failed", 9), 5: ("dead", 1)}
    assert got[4][2] == at + dt.timedelta(minutes=times[4] + 256)


def test_empty_tables(spark):
    t = Tables(spark, SF)
    empty = SimpleNamespace(**{name: getattr(t, name).limit(0) for name in TABLES})
    for name in ("r1_platform_daily", "r2_query_daily", "r5_locale_daily", "s4_attribution", "u3_history", "f1_feed_recent", "c2_index", "m4_public_media"):
        assert queries.NAMED[name](empty).count() == 0, name
    assert queries.NAMED["r17_snapshot"](empty).first().stores_total == 0


def test_every_query_but_a_few_has_sql():
    without = set(queries.NAMED) - set(oracle.ORACLE_SQL)
    assert without == {"s1_search_results", "s1_search_records"}


def same_as_sql(got, name, db):
    want = db.execute(oracle.ORACLE_SQL[name])
    assert [c[0] for c in want.description] == got.columns, name
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall()), name


def test_checks_equal_their_own_sql(spark):
    db = duckdb.connect()
    for table in RAW:
        db.execute(f"CREATE VIEW {table} AS FROM '{SF}/{table}.parquet'")
    for name in ("u6_checks", "s1_request_checks"):
        same_as_sql(queries.QUERIES[name](spark, SF), name, db)


def test_every_fault_of_a_profile_equals_the_sql(spark):
    names, brands = (None, "", "a", "x" * 12, "x" * 13, "ä" * 26, "x" * 101), (None, "", "ab", "abc", "Brand#11", "x" * 30, "x" * 31, "Łódź#1", "a b c")
    rows = [(7 * i - 40, n, b) for i, (n, b) in enumerate((n, b) for n in names for b in brands for _ in range(3))] + [(None, "n", "abc"), (22, "n", "abc"), (22, "n", "abc"), (2**62, "n", "abc")]
    db = duckdb.connect()
    db.execute("CREATE TABLE part (p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR)")
    db.executemany("INSERT INTO part VALUES (?, ?, ?)", rows)
    got = queries.profile_checks(SimpleNamespace(part=spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string")))
    assert {r.wrong for r in got.collect()} == {"", "username", "display_name", "avatar_url", "housing_status", "bio_language"}
    same_as_sql(got, "u6_checks", db)


def test_no_sql_takes_another_s_name():
    assigned = [n for n in ast.parse(Path(oracle.__file__).read_text()).body if isinstance(n, ast.Assign)]
    given = Counter(x.id for n in assigned for target in n.targets for x in ast.walk(target) if isinstance(x, ast.Name))
    assert [name for name, n in given.items() if n > 1] == []
