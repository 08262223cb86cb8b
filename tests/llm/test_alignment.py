"""Alignment against a plain version with the tokenizers library, token by token."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vicinal.llm.alignment import Aligner, aligned, byte_of_letter

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  two  spaces ", "tab\tand\nline\r\n", "<|endoftext|> is text, so is </s> and <0x41>", "▁low line", "naïve café – “quotes” 🙂👍🏽", "\x00nul\x07bell", "a" * 5000,
    " " * 3000, "ﬁ ligature, ①, ½", "中文字 and ไทย", "don't we'll I've", "same text", "same text", "x́ combining", "�​",
]


def plain(texts, overlap=False):
    byte, piece = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    byte.encode_special_tokens = True
    letters = byte_of_letter()
    rows, links = [], []
    for text in texts:
        a = [(i, bytes(letters[c] for c in byte.id_to_token(i))) for i in byte.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode()) for i in piece.encode(text or "")]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            rows.append([0, 0, 0, ""])
            links.append([])
            continue
        ends = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            ends.append(out)
        cuts = sorted({e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]})
        shown, before = [], 0
        for cut in cuts:
            shown.append("|".join(",".join(str(i) for s, e, i in side if before < e <= cut) for side in ends))
            before = cut
        rows.append([len(a), len(b), len(cuts), hashlib.sha256(";".join(shown).encode()).hexdigest()])
        together = (lambda x, y: x[0] < y[1] and y[0] < x[1]) if overlap else (lambda x, y: x[1] == y[1])
        near = {e: k for k, (_, e, _) in enumerate(ends[1])}
        if overlap:
            links.append([(x[2], y[2]) for x in ends[0] for y in ends[1] if together(x, y)])
        else:
            links.append([(x[2], ends[1][near[x[1]]][2]) for x in ends[0] if x[1] in near])
    count = Counter(p for own in links for p in own)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(*r[:3], len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), r[3]) for r, own in zip(rows, links, strict=True)], count


@pytest.mark.parametrize("links", ["end", "overlap"])
def test_odd_texts(spark, links):
    texts = [t for t in ODD if links == "end" or t is None or len(t) < 1000]
    docs = spark.createDataFrame([(k if k != 3 else None, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, n_a string, pairs int").repartition(3)
    rows, pairs = aligned(docs, BYTE, PIECE, links)
    wanted, count = plain(texts, links == "overlap")
    found = sorted(tuple(r) for r in rows.fillna(3, "doc_id").collect())
    assert found == sorted((k, *w) for k, w in enumerate(wanted))
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(count)


def test_a_table_in_many_slices_and_chunks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = docs.orderBy("doc_id").collect()
    wanted, _ = plain([r.text for r in texts])
    rows, _ = aligned(docs.repartition(5), BYTE, PIECE)
    assert sorted(tuple(r) for r in rows.collect()) == [(r.doc_id, *w) for r, w in zip(texts, wanted, strict=True)]
    assert sum(w[0] > 0 for w in wanted) > len(wanted) / 2


def test_empty_table(spark):
    rows, pairs = aligned(spark.createDataFrame([], "doc_id long, text string"), BYTE, PIECE)
    assert rows.count() == 0 and pairs.count() == 0


def test_nothing_in_a_slice_has_tokens():
    columns, pairs, bounds = Aligner(BYTE, PIECE, "end").rows(["", "▁"])
    assert columns["n_a"].tolist() == [0, 0] and columns["groups"] == ["", ""] and len(pairs) == 0 and bounds.tolist() == [0, 0, 0]
