"""Packing: an exact round trip through the tokenizer itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from vicinal.llm.packing import END_ID, cuts, pack
from vicinal.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, start string, length string"


def texts():
    rnd = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) + rnd.choice(["", "", ",", ".", "!!", "$$$"])
    out = [None, "", " \n\t", "a", "Größe, über-MASS; naïve...", "it's o'clock don't I'LL", "don'T 'quoted' a'b", "12 3.5 a1b2 1,000", "<|endoftext|> <|startoftext|>x", "шторы и ковёр", "漢字 かな", "é combining", "İI ıi ǅ ß ẞ", "tab\tnbsp ls x　y", "\x00\x01 ctl\x1f\x85x", "😀😀 ok", "a_b __c__ x-y--z", "a\r\nb\x0bc\x0cd", "ª º µ × ÷ ² ½", "'s 's's ''re n't"]
    out += ["".join(rnd.choice("ab .,'-éÉß1 \n<|>_é😀Я") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    out += [" ".join(word() for _ in range(rnd.choice([3, 50, 400, 3000]))) for _ in range(40)]
    return out + ["again"] * 3


def test_round_trip(spark):
    rows = list(enumerate(texts()))
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [END_ID] for i, t in rows}
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack(df, tokenizer_path()).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for i, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[i]), (i, rows[i][1])
            assert r.ids_crc32 == zlib.crc32(np.array(want[i][at : at + r.length], "<u4").tobytes()), (i, rows[i][1])
            at += r.length
        assert at == len(want[i])
    padding = total = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and all(r.sequence_tokens == at for r in found)
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.03 * total


def test_pieces_fit_their_classes():
    for n in [1, 2, 127, 128, 129, 1023, 1025, 2047, 2048, 2049, 5000, 100_000]:
        assert sum(cuts(n, 2048)) == n and max(cuts(n, 2048)) <= 2048


def test_edges(spark):
    assert pack(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0
    got = pack(spark.createDataFrame([(None, "a b", "", ""), (None, "a b", "", ""), (5, "word " * 30_000, "", "")], SCHEMA), tokenizer_path()).collect()
    assert sum(r.length for r in got if r.doc_id is None) == 6 and sum(r.length for r in got if r.doc_id == 5) == 30_001
