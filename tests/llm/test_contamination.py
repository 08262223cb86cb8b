"""Decontamination against plain windows."""

import random
import re

from vicinal.llm.contamination import contaminated, covered

LOW = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(LOW.get(c, c) for c in text or ""))


def plain(docs, items, window):
    known = [(None if i is None else str(i), w, min(len(w), window)) for i, t in items for w in [words(t)] if w]
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, x, m in known:
            mine = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)}
            at = [i for i in range(len(w) - m + 1) if tuple(w[i : i + m]) in mine]
            hit |= {p for i in at for p in range(i, i + m)}
            if at and item is not None:
                found.add(item)
        out.append((-1 if doc_id is None else doc_id, len(w), len(hit), sorted(found)))
    return sorted(out)


def check(spark, docs, items, window=10):
    d = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, words string, m int").repartition(3)
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, digest string")
    found = contaminated(d, b, window).fillna(-1, "doc_id").collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found) == plain(docs, items, window)
    return found


def test_random_texts(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "B", "É", "c9", "dé", "x-y", "zz", "🙂", "Ärger", "n_o"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k % 17, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 14, 30]) if k > 8 else 12)) for k in range(24)] + [(None, text(12)), (7, None), (8, ""), (9, "...")]
    docs = []
    for k in range(150):
        parts = [text(rng.randrange(0, 25)) for _ in range(3)]
        parts[1:1] = [(rng.choice(items)[1] or "").upper()] if k % 2 else []
        docs.append((k, ". ".join(parts)))
    docs += [(None, "A B"), (3, None), (3, ""), (200, docs[5][1]), (201, docs[5][1]), (None, docs[7][1])]
    assert any(r.n_hit for r in check(spark, docs, items))
    check(spark, docs, items, 4)


def test_every_shared_span_of_ten_words(spark):
    """A span anywhere in a text, in any neighbourhood, in a text that is very long, and in one of a single word."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    item, same = fresh(40), ["ha"] * 60
    docs = [(k, " ".join(fresh(k % 9) + item[k % 31 : k % 31 + n] + fresh(k % 7))) for k, n in enumerate([9, 10, 11] * 31)]
    docs += [(500, " ".join(fresh(40_000) + item[3:15] + fresh(40_000))), (501, "ha " * 3000), (502, "ha " * 9)]
    found = {r.doc_id: r for r in check(spark, docs, [(1, " ".join(item)), (2, " ".join(same)), (30, " ".join(item[5:30]))])}
    assert all((found[k].n_hit > 0) == (n >= 10) for k, n in enumerate([9, 10, 11] * 31))
    assert found[500].n_hit == 12 and found[501].n_hit == 3000 and found[502].n_hit == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r.n_words, r.n_hit, r["items"]) for r in contaminated(docs, none).collect()) == [(0, 0, []), (3, 0, [])]
    assert contaminated(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    plan = contaminated(docs, spark.createDataFrame([(1, "b c d e f g h i j k")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "InPandas"))


def test_covered_words(spark):
    row = spark.sql("select array(struct(0 as at, 3 as m), struct(1 as at, 10 as m), struct(2 as at, 1 as m), struct(20 as at, 2 as m)) as s")
    assert row.select(covered(row.s)).first()[0] == 13
