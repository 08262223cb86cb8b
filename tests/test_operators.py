"""Table operators, sources and sinks on small data."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from vicinal import queries
from vicinal.functions import geo
from vicinal.functions.text import composed
from vicinal.operators import tables as ops
from vicinal.plans import intent, search
from vicinal.sources import files
from vicinal.sources.canonical import Tables

from .test_plans import SF


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vincenty(a, b, c, d):
    """Plain iteration on the ellipsoid."""
    f, r = geo.FLATTENING, geo.EQUATOR_M
    u, v, big = math.atan((1 - f) * math.tan(math.radians(a))), math.atan((1 - f) * math.tan(math.radians(c))), math.radians(d - b)
    lam = big
    for _ in range(200):
        s = math.hypot(math.cos(v) * math.sin(lam), math.cos(u) * math.sin(v) - math.sin(u) * math.cos(v) * math.cos(lam))
        if s == 0:
            return 0.0
        cs = math.sin(u) * math.sin(v) + math.cos(u) * math.cos(v) * math.cos(lam)
        sigma, sa = math.atan2(s, cs), math.cos(u) * math.cos(v) * math.sin(lam) / s
        ca = 1 - sa * sa
        cm = cs - 2 * math.sin(u) * math.sin(v) / ca if ca else 0.0
        k = f / 16 * ca * (4 + f * (4 - 3 * ca))
        lam = big + (1 - k) * f * sa * (sigma + k * s * (cm + k * cs * (2 * cm * cm - 1)))
    w = ca * (1 / (1 - f) ** 2 - 1)
    aa, bb = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))), w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
    ds = bb * s * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * s * s - 3) * (4 * cm * cm - 3)))
    return (1 - f) * r * aa * (sigma - ds)


def test_ellipsoidal(spark):
    rnd = random.Random(4)
    points = [(x := rnd.uniform(-60, 60), y := rnd.uniform(-170, 170), x + rnd.uniform(-3, 3), y + rnd.uniform(-3, 3)) for _ in range(60)] + [(41.0, 29.0, 41.0, 29.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, a double, b double, c double, d double")
    got = [r[0] for r in df.orderBy("i").select(geo.ellipsoidal(*map(F.col, "abcd"))).collect()]
    assert all(abs(g - vincenty(*p)) <= 1e-5 * g + 0.01 for g, p in zip(got, points, strict=True))


@pytest.mark.parametrize("lat", [0.0, 41.0, -70.0, 85.0])
def test_radius_join(spark, lat):
    rnd = random.Random(int(lat))
    side = lambda n: [(i, lat + rnd.uniform(-0.1, 0.1), 29 + rnd.uniform(-0.1, 0.1) / math.cos(math.radians(lat))) for i in range(n)]
    a, b = spark.createDataFrame(side(60), "id int, latitude double, longitude double"), spark.createDataFrame(side(60), "other int, o_lat double, o_lon double")
    every = a.crossJoin(b).where(geo.haversine(F.col("latitude"), F.col("longitude"), F.col("o_lat"), F.col("o_lon")) <= 3000).select("id", "other")
    assert rows_of(ops.radius_join(a, b, 3000).select("id", "other")) == rows_of(every)


def test_table_operators(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "x", 1), (3, "y", 1), (3, "y", 1), (None, "z", 1), (None, "z", 1)], "k int, v string, n int")
    assert rows_of(ops.insert_new(base, new, ["k"])) == sorted([(1, "a", 0), (2, "b", 0), (3, "y", 1), (None, "z", 1), (None, "z", 1)], key=str)
    assert rows_of(ops.upsert(base, new.dropna(), ["k"], "n")) == [(1, "a", 0), (2, "x", 1), (3, "y", 1)]
    assert rows_of(ops.folded_by(base.select("k", "n"), spark.createDataFrame([(1, 2), (1, -1), (2, -5), (9, 3)], "k int, delta int"), "k", "n")) == [(1, 1), (2, 0), (9, 3)]
    at = dt.datetime(2020, 1, 1)
    life = spark.createDataFrame([(1, at, None), (2, at, at + dt.timedelta(days=1)), (3, at + dt.timedelta(days=2), None)], "id int, created_at timestamp, deleted_at timestamp")
    seen = lambda day: [r[0] for r in rows_of(ops.visible_asof(life, F.lit(day).cast("timestamp")).select("id"))]
    assert (seen("2020-01-01"), seen("2020-01-02"), seen("2020-01-03"), seen("2020-01-04")) == ([], [1, 2], [1], [1, 3])
    assert [r.deleted_at is not None for r in ops.soft_deleted(life, F.col("id") == 1, "2021-01-01").orderBy("id").collect()] == [True, True, False]


def test_days_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "rollup")
    make = lambda rows: spark.createDataFrame([(dt.date(2020, 1, d), n) for d, n in rows], "metric_date date, n int")
    files.write_days(make([(1, 1), (2, 2), (3, 3)]), path)
    files.write_days(make([(1, 9), (3, 30)]), path, "2020-01-02")
    assert rows_of(spark.read.parquet(path).select("n")) == [(1,), (2,), (30,)]


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 2}')], "i int, t string")
    assert [r[0].a for r in df.orderBy("i").select(files.strict_json(F.col("t"), "a int")).collect()] == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        spark.createDataFrame([("{a",)], "t string").select(files.strict_json(F.col("t"), "a int")).collect()
    assert [json.loads(r.value) for r in files.as_json(df.limit(1)).collect()] == [{"i": 1, "t": '{"a": 1}'}]
    (tmp_path / "places.json").write_text("\n".join(json.dumps({"search_id": 1, "position": k, "place_id": f"p{k}"}) for k in range(30)))
    assert files.captured_places(spark, str(tmp_path / "places.json")).count() == 20


def test_delivery(spark, tmp_path):
    jobs = spark.createDataFrame([(i,) for i in range(5)], "id long")
    write = files.deliver(str(tmp_path), lambda batch: ["sent" if i % 2 else "failed" for i in batch["id"]])
    write(jobs, 0)
    write(jobs, 0)
    assert rows_of(spark.read.parquet(str(tmp_path)).select("id", "outcome")) == [(i, "sent" if i % 2 else "failed") for i in range(5)]


def test_composed(spark):
    assert spark.createDataFrame([("é",), (None,)], "t string").select(composed(F.col("t"))).collect()[0][0] == "é"


def test_a_parser_outside_enriches_a_search(spark):
    t = Tables(spark, SF)
    requests = spark.createDataFrame([(1, "something for my feet", 36.88, 30.70, 50_000), (2, "hello", None, None, 10_000), (3, "red widget", None, None, 10_000)], "search_id long, query string, r_lat double, r_lon double, radius int")
    answer = {"scope": "home_living", "query_language": "en", "store_name": "", "location_text": "", "categories": ["carpet"], "product_terms": [], "style_terms": [], "price_intent": "", "attributes": [], "sort_preference": "", "semantic_terms": []}
    more = files.read_intents(requests, lambda queries: [json.dumps(answer) if "feet" in q else "broken" if q == "hello" else None for q in queries])
    assert [r.search_id for r in more.collect()] == [1]
    places = spark.createDataFrame([(1, 0, "new", "Carpet House", "x, Antalya, Türkiye", 36.881, 30.701, 4.5, 10, "tel"), (1, 1, "place-150", "Known", "y, Antalya", 36.9, 30.7, 4.0, 3, "")], "search_id long, position int, place_id string, name string, address string, latitude double, longitude double, rating double, rating_count int, phone string")
    results, searches = search.search_batch(t, requests, places, more)
    found = {}
    for r in results.orderBy("search_id", "rank").collect():
        found.setdefault(r.search_id, []).append(r)
    carpets = {r.store_id for r in t.store_category_links.where("category_id = 7").collect()}
    promoted = {r.id for r in t.stores.where("is_premium").collect()}
    assert all(r.store_id in carpets | promoted for r in found[1] if r.source == "internal") and any(r.store_id in carpets for r in found[1])
    assert {r.source for r in found[1] if r.place_id} >= {"google"} and [r.rank for r in found[1]] == list(range(1, len(found[1]) + 1))
    assert 2 not in found and all("red" in r.name and "widget" in r.name for r in found[3])
    assert {r.search_id: r.total_result_count for r in searches.collect()} == {1: len(found[1]), 2: 0, 3: len(found[3])}
    assert intent.HOME == json.loads(searches.where("search_id = 1").first().parsed_intent)["scope"]


def test_every_search_is_run(spark):
    """Whole tables, and the same rows for some requests that are looked up alone."""
    t = Tables(spark, SF)
    requests = queries._requests(t)
    places = queries._places_for(t, requests)
    results, searches = search.search_batch(t, requests, places)
    ids = [r.id for r in t.searches.select("id").collect()]
    assert sorted(r.search_id for r in searches.select("search_id").collect()) == sorted(ids)
    assert max(r.search_id for r in results.select("search_id").distinct().collect()) >= 240
    assert places.select("place_id").distinct().count() == t.places.where("place_id <> ''").select("place_id").distinct().count()
    some = [i for i in ids if i >= 240][:12]
    alone = search.search_batch(t, requests.where(F.col("search_id").isin(some)), places.where(F.col("search_id").isin(some)))[0]
    assert rows_of(alone) == rows_of(results.where(F.col("search_id").isin(some)))
