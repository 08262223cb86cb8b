"""Text: normal forms, language, containment, tokens, addresses and slugs, as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _plain(letter: str) -> str:
    """A letter without the marks of its decomposition."""
    return "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn")


def _letters() -> tuple[str, str]:
    """All letters that are another one with marks, and these others; a dotless i counts as one with a mark."""
    found = [(c, _plain(c)) for c in map(chr, [*range(0xC0, 0xAC00), *range(0xF900, 0x10000)]) if not 0xD800 <= ord(c) < 0xE000]
    found = [(c, p) for c, p in found if p != c and len(p) == 1]
    return "ı" + "".join(c for c, _ in found), "i" + "".join(p for _, p in found)


def _pairs() -> dict[str, str]:
    """Two characters that are one in the composed form."""
    out = {}
    for c in map(chr, [*range(0xC0, 0x3000)]):
        parts = unicodedata.decomposition(c)
        if parts and "<" not in parts and unicodedata.normalize("NFC", c) == c and len(parts.split()) == 2:
            out["".join(chr(int(x, 16)) for x in parts.split())] = c
    return out


MARKED, PLAIN = _letters()
COMPOSED = _pairs()
#: The same pairs as two texts: plans hold these, and not two literals for each pair.
_COMPOSED = "\x01".join(COMPOSED), "\x01".join(COMPOSED.values())

# Tests of a query's language, in this order.
CYRILLIC = "\\p{IsCyrillic}"
TURKISH_LETTERS, TURKISH_WORDS = "ışğç", (" mağaza", " perde", " mobilya", " uygun fiyat")
GERMAN_LETTERS, GERMAN_WORDS = "äß", ("geschäft", "günstig", "möbel", "gardine")

UNKNOWN_CITY = "Bilinmiyor"
COUNTRY_NAMES = ("tr", "türkiye", "turkey")
TOKEN_BREAK = "[^\\p{L}\\p{N}]+"


def lowered(text: Column) -> Column:
    """Lower case with a plain i for the dotted capital I."""
    return F.lower(F.translate(text, "İ", "i"))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def composed(text: Column) -> Column:
    """Letters and the marks behind them as one character, where there is one. Only texts with marks are gone through."""
    known = F.map_from_arrays(*(F.split(F.lit(x), "\x01") for x in _COMPOSED))
    zero = F.struct(F.lit("").alias("done"), F.lit("").alias("last"))

    def step(a: Column, c: Column) -> Column:
        one = F.try_element_at(known, F.concat(a["last"], c))
        return F.when(one.isNotNull(), F.struct(a["done"].alias("done"), one.alias("last"))).otherwise(F.struct(F.concat(a["done"], a["last"]).alias("done"), c.alias("last")))

    return F.when(text.rlike("\\p{Mn}"), F.aggregate(F.split(text, ""), zero, step, lambda a: F.concat(a["done"], a["last"]))).otherwise(text)


def normalized(text: Column) -> Column:
    """Trimmed, lower case, composed."""
    return composed(lowered(trimmed(text)))


def folded(text: Column) -> Column:
    """Letters without their marks; ß is ss. Combining marks go, too."""
    return F.regexp_replace(F.translate(F.replace(text, F.lit("ß"), F.lit("ss")), MARKED, PLAIN), "\\p{Mn}", "")


def fold_literal(term: str) -> str:
    """``folded`` of a constant."""
    return term.replace("ß", "ss").translate(str.maketrans(MARKED, PLAIN))


def contains_any(plain: Column, bare: Column, terms) -> Column:
    """Whether one of the terms is there: one alternation for each of the two forms keeps the expression small."""
    terms = [t.strip().replace("İ", "i").lower() for t in terms]
    either = lambda words: "|".join(dict.fromkeys(map(re.escape, words)))
    return plain.rlike(either(terms)) | bare.rlike(either(map(fold_literal, terms)))


def name_matches(name: Column, wanted: Column) -> Column:
    """Whether a result's name contains the store name that was asked for; an empty one matches nothing."""
    plain, term = normalized(name), normalized(wanted)
    return (term != "") & (F.contains(plain, term) | F.contains(folded(plain), folded(term)))


def detect_language(text: Column) -> Column:
    low = lowered(text)
    has = lambda letters, words: low.rlike(f"[{letters}]" + "".join(f"|{w}" for w in words))
    return F.when(text.rlike(CYRILLIC), "ru").when(has(TURKISH_LETTERS, TURKISH_WORDS), "tr").when(has(GERMAN_LETTERS, GERMAN_WORDS), "de").otherwise("en")


def tokens(text: Column) -> Column:
    """The words of a text in order, lower case, split at everything that is neither letter nor digit."""
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), TOKEN_BREAK), lambda t: t != "")


def query_words(text: Column) -> Column:
    """Words of two letters or more, in order and as they are written."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), TOKEN_BREAK), lambda t: F.length(t) > 1)


def phrase_runs(words: list[str]) -> list[list[str]]:
    """Runs of at least two words, longest first and then from the left."""
    n = len(words)
    return [words[a : a + k] for k in range(n, 1, -1) for a in range(n - k + 1)]


def city_from_address(address: Column) -> Column:
    """The last part between commas that names no country, at most 100 characters."""
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda p: F.trim(p)), lambda p: (p != "") & ~lowered(p).isin(*COUNTRY_NAMES))
    return F.coalesce(F.substring(F.try_element_at(parts, F.lit(-1)), 1, 100), F.lit(UNKNOWN_CITY))


def city_key(city: Column, address: Column) -> Column:
    """What two addresses of one city have in common: its folded name, without a post code or a district before a slash."""
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda p: F.trim(p)), lambda p: (p != "") & ~lowered(p).isin(*COUNTRY_NAMES))
    own = F.trim(F.coalesce(city, F.lit("")))
    value = F.when(own != "", own).otherwise(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")))
    return folded(normalized(F.regexp_replace(F.trim(F.substring_index(value, "/", -1)), "^[0-9]+", "")))


def slug(name: Column, key: Column, most: int = 60, key_length: int = 8) -> Column:
    """An address part for a name: folded, dashes for all else, then the first characters of its key."""
    base = F.regexp_replace(F.regexp_replace(folded(normalized(F.coalesce(name, F.lit("")))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.concat(F.when(base == "", F.lit("store")).otherwise(F.substring(base, 1, most)), F.lit("-"), F.substring(key, 1, key_length))


def locale_of(tag: Column, supported=("tr", "en", "de", "ru")) -> Column:
    """The supported language of a tag such as de-DE, or null."""
    base = F.regexp_extract(F.lower(F.trim(tag)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(base.isin(*supported), base)


def preferred_locale(header: Column, default: str = "tr") -> Column:
    """The supported language of the largest weight in an Accept-Language header; the first of equals."""
    entry = lambda part, i: F.struct(
        (-F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(part, ";\\s*q=([0-9.]+)", 1), F.lit("")), F.lit("9.999")), F.lit(1)).cast("double")).alias("q"), i.alias("i"), locale_of(F.split_part(part, F.lit(";"), F.lit(1))).alias("locale")
    )
    found = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ","), entry), lambda e: e["locale"].isNotNull() & (e["q"] < 0))
    return F.coalesce(F.try_element_at(F.array_sort(found), F.lit(1))["locale"], F.lit(default))


def resolved_locale(explicit: Column, header: Column, fallback: Column, default: str = "tr") -> Column:
    """The language of a request: what it asks for outright, else what its Accept-Language header prefers, else the
    fallback, if it is supported, else the default."""
    asked = preferred_locale(header, "")
    return F.coalesce(locale_of(explicit), F.nullif(asked, F.lit("")), locale_of(fallback), F.lit(default))
