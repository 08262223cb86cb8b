"""Functions against tables of cases and plain Python."""

import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from vicinal.functions import fulltext, geo, scores, times
from vicinal.functions import text as T


def column(spark, rows, expression):
    """The expression over (x, y) of each row, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, x {kind(rows, 0)}, y {kind(rows, 1)}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def kind(rows, k):
    value = next((r[k] for r in rows if r[k] is not None), "")
    return {str: "string", float: "double", int: "int", bool: "boolean"}[type(value)]


def test_city_keys(spark):
    rows = [("", "Lale Sk. 9, 34710 Kadıköy/İSTANBUL, Türkiye"), ("", "Bir Sk. 4, 20100 Denizli, TR"), ("İstanbul", "elsewhere"), ("  ", "Muratpaşa/Antalya"), ("", ""), (None, None), ("Çankaya/Ankara", "")]
    assert column(spark, rows, T.city_key(F.col("x"), F.col("y"))) == ["istanbul", "denizli", "istanbul", "antalya", "", "", "ankara"]


def test_city_from_address(spark):
    rows = [("A, B, 07030 Kepez, Türkiye", ""), ("turkey, TR", ""), ("", ""), (None, ""), ("x" * 150, "")]
    assert column(spark, rows, T.city_from_address(F.col("x"))) == ["07030 Kepez", "Bilinmiyor", "Bilinmiyor", "Bilinmiyor", "x" * 100]


def test_slugs(spark):
    rows = [("ÇİÇEK Işık Evi", "77aa01bc-9"), ("  ", "12345678-9"), ("Ev & Yaşam -- İÇ", "abcdefgh-1"), ("ü" * 90, "0123456789"), ("Łódź Ąćęń żółty Ň", "1234567890")]
    assert column(spark, rows, T.slug(F.col("x"), F.col("y"))) == ["cicek-isik-evi-77aa01bc", "store-12345678", "ev-yasam-ic-abcdefgh", "u" * 60 + "-01234567", "odz-acen-zo-ty-n-12345678"]


def test_languages(spark):
    rows = [("Мне нужны шторы", ""), ("halı arıyorum", ""), ("ucuz perde", ""), ("günstige Vorhänge", ""), ("curtains please", ""), ("перде ucuz", ""), ("große Auswahl", ""), ("", "")]
    assert column(spark, rows, T.detect_language(F.col("x"))) == ["ru", "tr", "tr", "de", "en", "ru", "de", "en"]


def test_names(spark):
    rows = [("DOĞU EGE ÇEYİZ", "doğu ege"), ("Dogu Ege", "DOĞU"), ("Ko\u0308sk Mobilya", "kösk"), ("Işıl Ev", "isil"), ("a", ""), ("a", " "), ("ab", "b")]
    assert column(spark, rows, T.name_matches(F.col("x"), F.col("y"))) == [True, True, True, True, False, False, True]


def test_locales(spark):
    assert column(spark, [("de-DE", ""), ("TR", ""), ("fr", ""), ("", ""), (None, ""), ("ru_RU", "")], T.locale_of(F.col("x"))) == ["de", "tr", None, None, None, "ru"]
    headers = [("fr, en;q=0.8, de;q=0.9", ""), ("ru", ""), ("", ""), (None, ""), ("xx;q=1, en;q=0", ""), ("en-GB;q=0.5, de;q=0.5", "")]
    assert column(spark, headers, T.preferred_locale(F.col("x"))) == ["de", "ru", "tr", "tr", "tr", "en"]


def test_phrase_runs():
    assert [" ".join(r) for r in T.phrase_runs("mavi ev tekstil".split())] == ["mavi ev tekstil", "mavi ev", "ev tekstil"]
    assert T.phrase_runs(["one"]) == [] and T.phrase_runs([]) == []


def test_levels(spark):
    rows = [(n, 0) for n in (0, 1, 4, 5, 14, 15, 39, 40, 99, 100, 5000)]
    assert column(spark, rows, scores.level(F.col("x"))) == [0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_bands(spark):
    rows = [(0.0, 0), (499.9, 0), (500.0, 0), (25_000.0, 0), (25_000.1, 0), (29_999.0, 0), (30_000.0, 0), (None, 0)]
    assert column(spark, rows, geo.distance_band(F.col("x"))) == [0, 0, 1, 50, 51, 51, 52, 2**31 - 1]


def test_haversine(spark):
    rnd = random.Random(3)
    rows = [(rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for _ in range(50)]

    def plain(a, b, c=41.0, d=29.0):
        p, q = math.radians(a), math.radians(c)
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6_371_000 * math.atan2(math.sqrt(x), math.sqrt(1 - x))

    got = column(spark, rows, geo.haversine(F.col("x"), F.col("y"), 41.0, 29.0))
    assert all(math.isclose(g, plain(*r), rel_tol=1e-9) for g, r in zip(got, rows, strict=True))
    near = column(spark, [(41.00448, 29.0), (41.00452, 29.0)], geo.haversine(F.col("x"), F.col("y"), 41.0, 29.0) + 0.1 <= 500)
    assert near == [True, False]


@pytest.mark.parametrize("lat", [0.0, 36.9, -41.0, 60.0, 80.0])
def test_box_covers_the_radius(lat):
    a, b, c, d = geo.bounding_box(lat, 30.0)
    assert (b - lat) * 111_195 >= 29_900 and (d - 30.0) * 111_195 * math.cos(math.radians(lat)) >= 29_900
    assert all(map(math.isfinite, geo.bounding_box(89.999, 0.0)))


def test_coordinates(spark):
    rows = [(41.0, 29.0), (91.0, 0.0), (0.0, 181.0), (float("nan"), 0.0), (-90.0, -180.0)]
    assert column(spark, rows, geo.valid_coordinates(F.col("x"), F.col("y"))) == [True, False, False, False, True]


def test_rounding(spark):
    assert column(spark, [(36.88451, 0), (-36.8845, 0), (1.0005, 0)], geo.rounded(F.col("x"), 3)) == [36.885, -36.885, math.floor(1.0005 * 1000 + 0.5) / 1000]


def test_business_days(spark):
    start, end = times.day_bounds(F.to_date("x"), "Europe/Istanbul")
    rows = [("2026-08-13", ""), ("2015-03-29", ""), ("2015-11-08", "")]
    assert column(spark, rows, F.concat_ws("|", start.cast("string"), (end.cast("long") - start.cast("long")).cast("string"))) == ["2026-08-12 21:00:00|86400", "2015-03-28 22:00:00|82800", "2015-11-07 21:00:00|90000"]
    assert (times.attribution_days(49), times.attribution_days(72), times.attribution_days(1)) == (3, 3, 1)
    assert [len(x) for x in column(spark, [("2020-05-05", "")], times.trailing_days(F.to_date("x"), 72))] == [4]


def test_fallbacks(spark):
    rows = [("context deadline exceeded", False), ("HTTP 401 timed out", False), ("status 429 quota", False), ("Unauthorized", False), ("connection reset", False), ("timeout", True)]
    assert column(spark, rows, scores.fallback_reason(F.col("x"), F.col("y"))) == ["ai_timeout", "ai_timeout", "ai_unauthorized", "ai_unauthorized", "ai_unavailable", "ai_invalid_response"]


def test_fulltext(spark):
    text = "Güney Antalya HALI ve Yatak"
    cases = {"halı": False, "hali": True, "antalya güney": True, '"antalya güney"': False, '"güney antalya"': True, "perde OR yatak": True, "antalya -yatak": False, "-perde": True, "": False, "güney_antalya": True, "antalya_yatak": False}
    for query, want in cases.items():
        assert column(spark, [(text, "")], fulltext.matches(T.tokens(F.col("x")), query)) == [want], query


def test_normal_forms(spark):
    """Composed, trimmed and folded like Unicode's own tables say, for every letter that has marks."""
    letters = [c for c in map(chr, range(0xC0, 0x2000)) if c.isalpha() and unicodedata.decomposition(c) and "<" not in unicodedata.decomposition(c) and unicodedata.normalize("NFC", c) == c != "İ" and sum(unicodedata.category(x) != "Mn" for x in unicodedata.normalize("NFD", c)) == 1]
    rows = [(" \t" + c + " x \n", unicodedata.normalize("NFD", c) + "x") for c in letters]
    want = [unicodedata.normalize("NFC", c.lower()) + " x" for c in letters]
    assert [g for g, w in zip(column(spark, rows, T.normalized(F.col("x"))), want, strict=True) if g != w] == []
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    assert column(spark, rows, T.folded(F.col("x"))) == [bare(x).replace("ß", "ss") for x, _ in rows]
    apart = [("Güneş ế", ""), ("̈x", ""), ("", ""), (None, "")]
    assert column(spark, apart, T.normalized(F.col("x"))) == ["güneş ế", "̈x", "", None]
