"""The pipeline's stages against plain Python, and its edges."""

import random
import re

import pytest

import corpus_pipeline
from vicinal.llm.mixing import mix, mixture
from vicinal.llm.rules import drop_rejected, judged, learn_rules
from vicinal.llm.secrets import REDACTED, redacted

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, taken string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, "x") for i, t, s in rows], SCHEMA)


def random_docs(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rnd.choice("abcdefg") + str(rnd.randint(0, 99)) for _ in range(rnd.randint(0, 160))]
        if i % 5 == 0:
            words = [w + "$$$" for w in words]
        rows.append((i, rnd.choice([" ", "\n"]).join(words), rnd.choice(["a", "a", "a", "b", "ü", None])))
    return rows


def counts(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    triples = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = {k + d for k, t in enumerate(triples) if triples.count(t) > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_rules(spark):
    rows = random_docs(300, 1) + [(900, None, "a"), (901, "", "a"), (902, "a b c " * 40, "b"), (903, "x\n\nx\n y\nx", "b"), (None, "é ü " * 60, None), (904, "q " * 30_000, "a"), (904, "q " * 30_000, "a"), (905, "a b c d a b c a b c d", "a")]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(300)] + [(None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    rules = learn_rules(docs, labels)
    assert rules
    got = judged(docs, rules, ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert own == counts(r.text) if r.n_words < 5000 else own[0] == 30_000
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if not r.base_failed and r.doc_id is not None and r.doc_id < 300:
            assert r.kept == (r.doc_id % 5 != 0)
    left = drop_rejected(docs, labels)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert drop_rejected(docs.limit(0), labels).count() == 0 and drop_rejected(docs, labels.limit(0)).count() > 0


def test_mixture(spark):
    rows = random_docs(200, 2) + [(500, None, "a"), (501, "", "zero"), (502, "one", "tiny"), (None, "no id here", "b"), (7, "again the same id", "a"), (7, "again the same id", "a")]
    docs = frame(spark, rows)
    per = {}
    for r in mix(docs).collect():
        s = per.setdefault(r.source, [r.source_size, r.target, 0, 0])
        s[2] += r.taken
        s[3] += r.size
        assert 0 <= r.taken <= 2 * r.size
    total = sum(len(WORD.findall(t or "")) for _, t, _ in rows)
    weights = {s: w for s, w in zip(sorted(per, key=lambda s: (s is None, s or "")), [3, 1, 2] * 9, strict=False)}
    targets, left, open_ = dict.fromkeys(per, 0.0), 1.5 * total, set(per)
    while left > 1e-6 and open_:
        share = left / sum(weights[s] for s in open_)
        left = 0.0
        for s in list(open_):
            targets[s] += weights[s] * share
            if targets[s] >= 2 * per[s][0]:
                left += targets[s] - 2 * per[s][0]
                targets[s] = 2.0 * per[s][0]
                open_.remove(s)
    for s, (size, target, taken, summed) in per.items():
        assert size == summed and abs(target - targets[s]) < 1e-6 and abs(taken - target) <= 1
    out = mixture(docs)
    assert out.columns == docs.columns
    made = {}
    for r in out.collect():
        made[r.source] = made.get(r.source, 0) + len(WORD.findall(r.text))
    assert made == {s: v[2] for s, v in per.items() if v[2]}
    assert mixture(docs.limit(0)).count() == 0


def test_redaction(spark):
    rows = [(1, "my password = abcdefgh12345 end", "a"), (2, None, "a"), (3, "", "a"), (4, "clean", "a")]
    got = {r.doc_id: (r.text, r.n_chars) for r in redacted(frame(spark, rows)).collect()}
    text = f"my {REDACTED} end"
    assert got == {1: (text, len(text)), 2: (None, None), 3: ("", 0), 4: ("clean", 5)}


@pytest.mark.parametrize("rows", [[], [(1, None, None), (None, "", "a"), (2, "word " * 9000, "a"), (None, " ".join(f"w{i}" for i in range(80)), None), (3, " ".join(f"v{i}" for i in range(80)), "b"), (3, " ".join(f"v{i}" for i in range(80)), "b")]])
def test_stages_run_on_edges(spark, tmp_path, rows):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == ({None, 3} if rows else set())
    assert sum(1 for r in out if r.doc_id == 3 and r.start == 0) >= bool(rows)
