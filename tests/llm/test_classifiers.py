"""The two classifiers: held-out accuracy, the trees, and edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vicinal.llm.boosting import fit
from vicinal.llm.quality import NAMES, classify, statistics
from vicinal.llm.rules import learn_rules
from vicinal.llm.toxicity import DISCOUNT, EVIDENCE, PAIRS, gathered, measured, packed, score_toxicity, sent, steps, tell_pairs, unpacked

DOCS = "doc_id long, text string, score string, label string, lang string"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(600)]
    docs, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 200))]
        bad, toxic = rnd.random() < 0.3, rnd.random() < 0.3
        if toxic:
            for _ in range(4):
                text[rnd.randrange(len(text))] = rnd.choice(["nasty", "Vile,", "awful"])
        if bad:
            text = [w + "###" if rnd.random() < 0.7 else w for w in text]
        docs.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.mark.parametrize(("run", "column", "by", "out"), [(classify, 1, 5, 0), (score_toxicity, 2, 4, 2)])
def test_held_out(spark, run, column, by, out):
    docs, labels = corpus(700, 4)
    d = spark.createDataFrame([(*x, "s", "l", "en") for x in docs], DOCS)
    hidden = [r if zlib.crc32(str(r[0]).encode()) % by != out else (r[0], 1 - r[1], 1 - r[2]) for r in labels]
    got = run(d, spark.createDataFrame([(*x, "t") for x in labels], LABELS)).collect()
    turned = run(d, spark.createDataFrame([(*x, "t") for x in hidden], LABELS)).collect()
    assert {(r.doc_id, r.score) for r in got} == {(r.doc_id, r.score) for r in turned}  # held-out labels don't matter
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == out) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    truth = {x[0]: x[column] for x in labels}
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9


@pytest.mark.parametrize("run", [classify, score_toxicity])
def test_edges(spark, run):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (None, "b c"), (5, "x " * 60_000), (6, "ü" * 3000), (7, "one two one two one two")]
    d = spark.createDataFrame([(*x, "s", "l", "en") for x in docs], DOCS)
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, 1), (None, 1, 1), (7, None, None), (5, 0, 0), (6, 7, 7), (400, 1, 1)]
    for known in (labels, []):
        got = run(d, spark.createDataFrame([(*x, "t") for x in known], LABELS)).collect()
        assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert run(d.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_trees_learn_an_interaction():
    rnd = np.random.default_rng(0)
    x = rnd.uniform(size=(3000, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.4)).astype(float)
    trees = fit(x, y)
    z = rnd.uniform(size=(1000, 5))
    assert ((trees.scores(z) > 0.5) == ((z[:, 1] > 0.5) ^ (z[:, 3] > 0.4))).mean() > 0.95


def test_trees_of_one_label():
    assert abs(fit(np.zeros((0, 3)), np.zeros(0)).scores(np.zeros((2, 3)))[0] - 0.5) < 1e-9
    assert fit(np.zeros((9, 3)), np.ones(9)).scores(np.zeros((1, 3)))[0] > 0.9


def plain_features(texts, labels):
    """Kneser-Ney bigram models, counted and applied with dictionaries."""
    split = {i: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()) for i, t in texts}
    pairs, single, follow = [Counter(), Counter()], [Counter(), Counter()], [defaultdict(Counter), defaultdict(Counter)]
    for i, y in labels.items():
        for v, w in zip(["<s>", *split[i]], split[i], strict=False):
            pairs[y][v, w] += 1
            single[y][w] += 1
            follow[y][v][w] += 1
    before = Counter(w for _, w in set(pairs[0]) | set(pairs[1]))

    def alone(c, w):
        total = sum(single[c].values())
        shared = (before[w] + 0.5) / (before.total() + 0.5 * (len(before) + 1))
        taken = sum(min(n, DISCOUNT) for n in single[c].values())
        return (single[c][w] - min(single[c][w], DISCOUNT)) / total + taken / total * shared

    def after(c, v, w):
        seen = follow[c].get(v)
        if not seen:
            return alone(c, w)
        taken = sum(min(n, DISCOUNT) for n in seen.values())
        return (seen[w] - min(seen[w], DISCOUNT)) / seen.total() + taken / seen.total() * alone(c, w)

    out = {}
    for i, words in split.items():
        n, row = max(1, len(words)), []
        for r in ([math.log(alone(1, w) / alone(0, w)) for w in words], [math.log(after(1, v, w) / after(0, v, w)) for v, w in zip(["<s>", *words], words, strict=False)]):
            strong = sum(max(0, x - EVIDENCE) for x in r)
            row += [sum(r) / n, strong / n]
        out[i] = row
    return out


def test_models_are_kneser_ney(spark, monkeypatch):
    """Every number of every text as dictionaries have it, with texts dealt over several chunks and buckets."""
    rnd = random.Random(3)
    texts = [(i, " ".join(rnd.choice(["hub", "Ünder", "b-c", f"w{int(rnd.expovariate(0.05))}"]) for _ in range(rnd.randrange(60)))) for i in range(300)] + [(300, ""), (301, "nobody knows")]
    labels = {i: int(i % 3 == 0) for i in range(0, 301, 2)}
    want = plain_features(texts, labels)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    got = measured(df, spark.createDataFrame(list(labels.items()), "doc_id long, label int")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert np.allclose(r.x, want[r.doc_id], atol=1e-9), r.doc_id


def test_chunks_over_batches():
    texts = ["a" * 30, "", "b" * 200, *["c d"] * 50, "e" * 90]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + len(part))), pa.array(part)], ["i", "t"]) for k in range(0, len(texts), 7) for part in [texts[k : k + 7]]]
    found = list(gathered(iter(batches), 100))
    assert [t for _, x in found for t in x.to_pylist()] == texts and [i for x, _ in found for i in x.to_pylist()] == list(range(len(texts)))
    assert all(sum(map(len, x.to_pylist())) <= 100 or len(x) == 1 for _, x in found) and len(found) < 12


def test_numbers_survive_packing():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 1000):
        keys, big = np.sort(rnd.integers(0, 2**32, n, dtype=np.uint64)).astype("<u4"), rnd.integers(-(2**60), 2**60, n)
        back = unpacked(packed(steps(keys), big), "<u4", "<i8")
        assert (np.cumsum(back[0], dtype="<u4") == keys).all() and (back[1] == big).all()


def test_word_order_tells(spark):
    """The same words in either class: only their order is toxic."""
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        text, toxic = [f"w{rnd.randrange(300)}" for _ in range(40)], int(rnd.random() < 0.5)
        for k in rnd.sample(range(0, 38, 2), 4):
            text[k : k + 2] = ["cold", "blue"] if toxic else ["blue", "cold"]
        docs.append((i, " ".join(text), "s", "l", "en"))
        labels.append((i, 1, toxic, "t"))
    got = score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).where("held_out").collect()
    assert np.mean([(r.score >= 0.5) == bool(labels[r.doc_id][2]) for r in got]) > 0.9


def plain_statistics(text):
    """The statistics of one text, a byte and a word at a time."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
    lines = [x for x in text.encode().split(b"\n") if x]
    n, chars = len(words), sum(map(len, words))
    if not n:
        return None
    share = lambda test: sum(map(test, text.encode())) / max(chars, 1)
    of = lambda letters: lambda b: bytes([b]) in letters
    split = lambda letters: [bytes([c]) for c in letters]
    triples, runs = Counter(zip(words, words[1:], words[2:], strict=False)), Counter(words)
    out = [math.log1p(n), chars / n, max(map(len, words))]
    out += [share(of(split(x))) for x in (b"#*$%&|<>", b"!?;:=_~^", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,")]
    out += [share(lambda b: b >= 128), n / max(1, len(lines)), 1 - len(set(lines)) / len(lines) if len(lines) > 1 else 0]
    out += [sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(runs) / n]
    out += [sum(v for v in triples.values() if v > 1) / (n - 2) if n >= 4 else 0, sum(len(w) <= 3 for w in words) / n, max(runs.values()) / n]
    return out


def test_statistics_are_what_they_say():
    rnd = random.Random(5)
    texts = ["", " ", "a", "\n\n", "one two\none two\nthree", "x x x x x x"]
    for _ in range(60):
        texts.append("".join(rnd.choice(["ab ", "Ü#", "9.", "ab ", "\n", "the ", "\tw", "??", " "]) for _ in range(rnd.randrange(80))))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    got = statistics(data, offsets)
    for t, row in zip(texts, got, strict=True):
        want = plain_statistics(t)
        if want:
            assert dict(zip(NAMES, row.round(9), strict=True)) == dict(zip(NAMES, np.round(np.array(want, float), 9), strict=True)), repr(t)


def test_trees_are_walked_like_one_row_at_a_time():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(400, 3))
    trees = fit(x, (x[:, 0] * x[:, 1] > 0.2).astype(float), rounds=12, depth=3)
    z = rnd.normal(size=(50, 3))
    for row, score in zip(z, trees.scores(z), strict=True):
        total = trees.start
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + int(row[feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        assert abs(1 / (1 + math.exp(-total)) - score) < 1e-12


def test_the_owner_of_a_pair_is_the_first_chunk():
    """Answers don't depend on the order in which messages come: a bucket that is run again tells the same owners."""
    rnd = np.random.default_rng(2)
    messages = []
    for chunk in (7, 3, 11, 5):
        keys = np.unique(rnd.integers(0, 60, 40)).astype("<u4")
        messages.append((chunk, packed(steps(keys), *(rnd.integers(0, 3, len(keys)) for _ in range(2)))))
    answers = []
    for order in ([0, 1, 2, 3], [3, 1, 0, 2], [2, 3, 1, 0]):
        found = tell_pairs(sent([4] * 4, [messages[k][0] for k in order], PAIRS, [messages[k][1] for k in order]))
        answers.append(sorted(zip(found.column("chunk").to_pylist(), found.column("packed").to_pylist(), strict=True)))
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 4


@pytest.mark.parametrize("limit", [("vicinal.llm.quality", "SAMPLE"), ("vicinal.llm.toxicity", "CURVE_SAMPLE"), None])
def test_labels_of_other_documents_take_no_room_in_samples(spark, monkeypatch, limit):
    """A bounded sample is drawn from the labelled rows that are there, not from all labels."""
    docs, labels = corpus(700, 4)
    d = spark.createDataFrame([(*x, "s", "l", "en") for x in docs], DOCS)
    many = spark.createDataFrame([(*x, "t") for x in labels], LABELS).unionByName(spark.range(10_000, 60_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic", "'t' as text"))
    if limit is None:
        bad = [r for r in corpus(1500, 6)[1]]
        d = spark.createDataFrame([(*x, "s", "l", "en") for x in corpus(1500, 6)[0]], DOCS)
        many = spark.createDataFrame([(*x, "t") for x in bad], LABELS).unionByName(many.where("doc_id >= 10000"))
        assert learn_rules(d, many, sample=900)
        return
    module, name = limit
    monkeypatch.setattr(f"{module}.{name}", 600)
    run, column = (classify, 1) if name == "SAMPLE" else (score_toxicity, 2)
    got = (run(d, many, sample=600) if name == "SAMPLE" else run(d, many)).where("held_out").collect()
    assert np.mean([r.predicted == labels[r.doc_id][column] for r in got]) > 0.9
