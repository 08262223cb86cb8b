"""Substring dedup against brute force."""

import random
import re

from pyspark.sql import functions as F

from vicinal.llm.substrings import remove_repeats

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
SCHEMA = "doc_id long, text string, extra string, kept string"


def brute(rows, window, hashes):
    first, out = {}, []
    for none, i, _, text in sorted((r[0] is None, r[0] or 0, (hashes[r[1] or ""] % 2**64 >> 1) * (1 if r[0] is None else -1), r[1] or "") for r in rows):
        words = WORD.findall(text)
        gone = set()
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in first:
                gone.update(range(k, k + window))
            else:
                first[key] = (none, i, k)
        out.append((None if none else i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def check(spark, rows, window):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = remove_repeats(df, window).collect()
    hashes = dict(df.select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.xxhash64("t")).collect())
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=key) == sorted(brute(rows, window, hashes), key=key)
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(s.end - s.start >= window for s in r.removed)


def test_planted_repeats(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdéßf") * rnd.randint(1, 3) + str(rnd.randint(0, 400))
    passages = [[word() for _ in range(rnd.randint(15, 60))] for _ in range(6)]
    rows = []
    for i in rnd.sample(range(1000), 150):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += [word() for _ in range(rnd.randint(0, 50))]
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) - 1)
            words += p[a : rnd.randint(a, len(p))] if rnd.random() < 0.5 else p
        rows.append((i, rnd.choice([" ", "\n", "  \t"]).join(words)))
    check(spark, rows, 20)
    check(spark, rows, 7)


def test_edges(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, passage), (4, passage), (None, passage), (None, None), (5, "x " + passage + " y"), (6, "same " * 30), (7, passage[:-4]), (0, "tail " + passage), (-3, "one")]
    check(spark, rows, 20)
    check(spark, [(2**63 - 1, "largest " + passage), (None, "none " + passage), (2**63 - 1, "again " + passage), (-(2**63), "least " + passage)], 20)


def test_many_rows_of_one_id_and_of_none(spark):
    """A hot doc_id and rows without one lie in many chunks, and still each passage stays once."""
    rnd = random.Random(9)
    passages = [" ".join(f"p{k}w{i}" for i in range(25)) for k in range(12)]
    rows = [(rnd.choice([5, 5, None, None, i]), f"start{i} " + rnd.choice(passages) + f" mid{i % 40} " + rnd.choice(passages)) for i in range(400)]
    check(spark, rows, 20)


def test_empty_table_and_long_text(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(str(i % 70_001) for i in range(140_000))
    check(spark, [(1, long), (2, "a b c " + long[:5000])], 20)
