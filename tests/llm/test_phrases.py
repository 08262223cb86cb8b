"""Collocations against a plain count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from vicinal.llm import phrases as P


def plain(rows, longest, least, share, top):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(longest, len(words) - i) + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and 100 * a >= share * counts[p[i:j]]}
        best = []
        for p, a in candidates.items():
            if p not in gone:
                score, _, left, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), a, left, r, n[lang], score))
        out += [(lang, k + 1, b[2].decode(), *b[3:]) for k, b in enumerate(sorted(best)[:top])]
    return sorted(out)


def rows_of(seed, many=400):
    rng = random.Random(seed)
    vocabulary = ["of", "the", "New", "york", "CITY", "café", "É", "b\x01", "b", "a\x01", "a", "x" * 300, "🙂"]
    rows = []
    for _ in range(many):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randrange(0, 40)))
        rows.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", None), ("only", "de")] + [("of the new york city", "en")] * 60


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(t, g, 1, "c") for t, g in rows], "text string, lang string, n int, chunk string").repartition(parts)


def test_equals_a_plain_count(spark, monkeypatch):
    rows = rows_of(1)
    for longest, least, share, top in ((5, 10, 100, 2000), (5, 4, 100, 7), (3, 6, 60, 2000), (2, 5, 100, 50)):
        found = P.collocations(frame(spark, rows), longest, least, share, top)
        assert sorted(tuple(r) for r in found.collect()) == plain(rows, longest, least, share, top)


def test_small_chunks_and_ranges(spark, monkeypatch):
    """Runs that lie over the edges of ranges, and phrases counted in many chunks."""
    monkeypatch.setattr(P, "RANGE_BYTES", 2_000)
    rows = rows_of(2, 1200)
    assert sorted(tuple(r) for r in P.collocations(frame(spark, rows, 16), 5, 12).collect()) == plain(rows, 5, 12, 100, 2000)


def test_nothing_frequent(spark):
    assert P.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert P.collocations(frame(spark, [("a b c", "en"), (None, None)])).count() == 0


def test_products_beyond_64_bits(spark):
    row = spark.sql(f"select {P.SCORE.replace('c.l', 'l').replace('c.r', 'r')} as s from values (4000000000000L, 900000000000000L, 5000000000000L, 3000000000000L) as t(a, n, l, r)").first()
    assert row.s == 1000 * 4000000000000 * 900000000000000 // (5000000000000 * 3000000000000)


def test_radix_order():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, k, 2000).astype(np.uint32) for k in (3, 2**32, 70_000, 1)]
    assert (P.radix_order(columns) == np.lexsort(columns[::-1])).all()
    (a, b), n = P.runs([np.array([1, 1, 0, 1], np.uint32), np.array([5, 70_000, 5, 5], np.uint32)], np.array([1, 2, 3, 4]))
    assert (a.tolist(), b.tolist(), n.tolist()) == ([0, 1, 1], [5, 5, 70_000], [3, 5, 2])
