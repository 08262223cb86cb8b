"""Near duplicates against brute force."""

import random
import re

import numpy as np
import pytest

from vicinal.llm import components as components_module
from vicinal.llm import neardup
from vicinal.llm.components import components
from vicinal.llm.neardup import REGISTERS, likeliest, near_duplicates, registers

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
SCHEMA = "doc_id long, text string, component_id string, kept string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, up, down):
    sets = [(i, shingles(t, k)) for i, t in rows]
    at = {i: i for i, _ in rows if i is not None}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and len(a & b) * down >= len(a | b) * up:
                a_, b_ = find(i), find(j)
                at[max(a_, b_)] = min(a_, b_)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def check(spark, rows, k=3, up=85, down=100):
    got = near_duplicates(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), k, (up, down)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k, up, down)
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in got)


def families(rnd, groups, members, edits):
    rows, ids = [], rnd.sample(range(100_000), groups * members)
    word = lambda: rnd.choice(["Re", "ta", "ß", "on", "WH"]) + str(rnd.randint(0, 3000))
    for _ in range(groups):
        base = [word() for _ in range(rnd.randint(3, 300))]
        for _ in range(members):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, int(len(words) * edits)))):
                words[rnd.randrange(len(words))] = word()
            rows.append((ids.pop(), rnd.choice([" ", "\n "]).join(words)))
    return rows


def test_families(spark):
    check(spark, families(random.Random(1), 40, 6, 0.06))
    check(spark, families(random.Random(2), 20, 5, 0.04), 5, 4, 5)


def test_one_large_family_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 12)
    check(spark, families(random.Random(3), 1, 150, 0.10) + families(random.Random(9), 5, 3, 0.03))


def test_edges(spark):
    same = "one two three four five six"
    rows = [(5, same), (3, same.upper()), (3, same.upper()), (9, None), (8, ""), (7, " \n"), (None, same), (None, None), (12, "one"), (11, "One"), (10, "two words"), (4, same + " seven"), (-2, same)]
    check(spark, rows)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text(spark):
    words = [str(i) for i in range(60_000)]
    check(spark, [(2, " ".join(words)), (1, " ".join(words[:-20])), (3, " ".join(words[:30_000]))])


@pytest.mark.parametrize("true", [0.5, 0.8, 0.85, 0.95])
def test_estimates(true):
    rnd = np.random.default_rng(int(true * 100))
    off = []
    for _ in range(60):
        both = rnd.integers(0, 2**64, int(1000 * true), dtype=np.uint64)
        rest = rnd.integers(0, 2**64, 1000 - int(1000 * true), dtype=np.uint64)
        a, b = np.concatenate([both, rest[::3]]), np.concatenate([both, rest[1::3], rest[2::3]])
        r = registers([a, b]).astype(int)
        off.append(likeliest(np.array([(r[0] > r[1]).sum()]), np.array([(r[0] < r[1]).sum()]), np.array([len(a)]), np.array([len(b)]))[0] - true)
    assert abs(np.mean(off)) < 0.02
    assert np.std(off) < 2 * np.sqrt(true * (1 - true) / REGISTERS) + 0.01


def test_registers_merge():
    rnd = np.random.default_rng(1)
    a, b = (rnd.integers(0, 2**64, n, dtype=np.uint64) for n in (50_000, 40))
    assert (registers([np.concatenate([a, b])])[0] == np.maximum(*registers([a, b]))).all()


@pytest.mark.parametrize("most", [1_000_000, 7])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(components_module, "SLICE", most)
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 3), (3, 7), (3, 1), (None, 2)]
    found = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert found == {**{i: 100 for i in range(100, 161)}, 1: 1, 3: 1, 7: 1}


def test_stars():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        a, b = rnd.integers(0, 300, (2, 200))
        at = {int(x): int(x) for x in np.concatenate([a, b])}
        for _ in range(300):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                at[x] = at[y] = min(at[x], at[y])
        top, other = components_module.stars(a, b)
        assert dict(zip(other.tolist(), top.tolist(), strict=True)) == {x: y for x, y in at.items() if x != y}
