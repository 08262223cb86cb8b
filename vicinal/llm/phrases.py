"""Phrase collocations by sorted id n-grams.

Texts become runs of word codes once, in chunks of the input as it comes, so that copies of a text never meet in one
chunk. Words that are frequent in their language get dense ids; pieces break at all others. At every place the ids of the
next words are packed into a key of fixed width, padded with zeros behind a break: sorted, such keys hold every shorter
phrase, too, as a run of one prefix. A chunk sorts its keys digit by digit, counts runs, and sends each range of keys its
share; a range merges its shares in the same way. A prefix that lies over the edge of a range is added up afterwards.

Nothing passes the driver but the number of chunks and the keys of a few chunks, from which the ranges' bounds are taken:
they balance the ranges and have no part in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens as K
from .common import small_side, stored

#: Bytes of text in a chunk, and of keys in a range.
CHUNK_BYTES = 16_000_000
RANGE_BYTES = 48_000_000
#: At most so many chunks give keys for the bounds of ranges, and each at most so many keys.
BOUND_CHUNKS, BOUND_KEYS = 8, 20_000
#: Parts in which words are numbered.
ID_PARTS = 1024
#: What a row without language counts as.
NO_LANG = "und"

BETWEEN = np.zeros(256, bool)
BETWEEN[[9, 32]] = True
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?"]] = True
ENDS[10:14] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The score of a cut: 38 digits hold the products.
SCORE = "1000 * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0)) div (cast(c.l as decimal(19, 0)) * cast(c.r as decimal(19, 0)))"

CODED = "chunk long, lang string, word string, local int, n long, codes binary"
SENT = "range int, rows long, keys binary, counts binary"
COUNTED = "key binary, n long"


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(words, breaks, counts): all words of some texts, whether a piece begins with a word, and words for each text."""
    words, breaks, counts = [], [], []
    for _, _, data, offsets in K.slices(texts):
        data, offsets = LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
        apart = (BETWEEN | ENDS)[data]
        found = K.split(data, offsets, BETWEEN | ENDS)
        lengths = found.ends - found.starts
        ends = np.concatenate(([0], np.cumsum(ENDS[data])))
        begins = np.ones(len(lengths), bool)
        begins[1:] = ends[found.starts[1:]] > ends[found.ends[:-1]]
        begins[found.bounds[:-1][found.bounds[:-1] < len(lengths)]] = True
        places = pa.py_buffer(np.concatenate(([0], np.cumsum(lengths))).astype(np.int64))
        words.append(pa.LargeStringArray.from_buffers(len(lengths), places, pa.py_buffer(data[~apart])))
        breaks.append(begins)
        counts.append(found.counts())
    every = pa.chunked_array(words, pa.large_string()).combine_chunks()
    return every.dictionary_encode(), np.concatenate(breaks), np.concatenate(counts)


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of texts as word codes, and each chunk's words with their counts by language."""
    context, held, size, number = TaskContext.get(), [], 0, 0
    names = [f.split()[0] for f in CODED.split(", ")]

    def rows(chunk: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        langs = table.column("_lang").combine_chunks().dictionary_encode()
        words, breaks, counts = words_of(table.column("_text").combine_chunks())
        if not len(breaks):
            return
        many = len(words.dictionary)
        pair = np.repeat(langs.indices.to_numpy().astype(np.int64), counts) * many + words.indices.to_numpy()
        known, local, n = np.unique(pair, return_inverse=True, return_counts=True)
        codes = (local.astype(np.uint32) << np.uint32(1)) | breaks.astype(np.uint32)
        none = lambda kind, k: pa.nulls(k, kind)
        here = pa.array(np.full(len(known), chunk), pa.int64())
        word = words.dictionary.take(pa.array(known % many)).cast(pa.string())
        lang = langs.dictionary.take(pa.array(known // many)).cast(pa.string())
        each = [here, lang, word, pa.array(np.arange(len(known)), pa.int32()), pa.array(n, pa.int64()), none(pa.binary(), len(known))]
        yield pa.record_batch(each, names)
        whole = [pa.array([chunk], pa.int64()), none(pa.string(), 1), none(pa.string(), 1), none(pa.int32(), 1), none(pa.int64(), 1)]
        yield pa.record_batch([*whole, pa.array([codes.astype("<u4").tobytes()], pa.binary())], names)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        for a, b, _, _ in K.slices(table.column("_text"), CHUNK_BYTES // 4):
            part = table.slice(a, b - a)
            held.append(part)
            size += part.nbytes
            if size >= CHUNK_BYTES:
                yield from rows(context.partitionId() << 32 | number, pa.concat_tables(held))
                held, size, number = [], 0, number + 1
    if held:
        yield from rows(context.partitionId() << 32 | number, pa.concat_tables(held))


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order that sorts rows of 32-bit numbers, first column first: by 16-bit digits, the last one first."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in (np.uint32(0), np.uint32(16)):
            digit = (column >> shift).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct rows, with the sums of their counts."""
    order = radix_order(columns)
    columns = [c[order] for c in columns]
    first = np.ones(len(order), bool)
    first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(first)
    return [c[starts] for c in columns], np.add.reduceat(n[order], starts) if len(starts) else n[:0]


def packed(columns: list[np.ndarray]) -> np.ndarray:
    """Rows as bytes whose order is that of the rows."""
    return np.ascontiguousarray(np.stack(columns, 1).astype(">u4")).view(f"S{4 * len(columns)}").ravel() if len(columns[0]) else np.zeros(0, f"S{4 * len(columns)}")


def chunk_keys(codes: np.ndarray, ids: np.ndarray, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys of a chunk, sorted, with their counts; keys of a single word are left out."""
    word, breaks = ids[codes >> np.uint32(1)], (codes & np.uint32(1)).astype(bool)
    size = len(word)
    columns, going = [word], word > 0
    for k in range(1, longest):
        after = np.zeros(size, np.uint32)
        if size > k:
            going = going[: size - k] & ~breaks[k:] & (word[k:] > 0)
            after[: size - k] = np.where(going, word[k:], 0)
        columns.append(after)
    at = np.flatnonzero(columns[1])
    return runs([c[at] for c in columns], np.ones(len(at), np.int64))


def encode(longest: int, bounds: bytes | None):
    """A chunk's codes and the ids of its words: rows of sorted keys and counts for each range, or a few keys without bounds."""

    def run(chunk: pa.Table, ids: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if chunk.num_rows and ids.num_rows:
            codes = np.frombuffer(chunk.column("codes")[0].as_buffer(), "<u4")
            local = ids.column("local").to_numpy()
            table = np.zeros(max(int(codes.max()) >> 1, int(local.max())) + 1, np.uint32)
            table[local] = ids.column("id").to_numpy()
            columns, n = chunk_keys(codes, table, longest)
            if bounds is None:
                few = slice(None, None, max(1, -(-len(n) // BOUND_KEYS)))
                out = [(0, len(n), packed([c[few] for c in columns]).tobytes(), b"")] if len(n) else []
            else:
                cuts = np.frombuffer(bounds, f"S{4 * longest}")
                edges = np.concatenate(([0], np.searchsorted(packed(columns), cuts), [len(n)]))
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    part = slice(edges[k], edges[k + 1])
                    keys = b"".join(c[part].astype("<u4").tobytes() for c in columns)
                    out.append((k, int(edges[k + 1] - edges[k]), keys, n[part].astype("<u4").tobytes()))
        each = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(each, kinds, strict=True)], names=["range", "rows", "keys", "counts"])

    return run


def count_range(longest: int, least: int):
    """Phrases of a range: those found often enough, and those at its edges with what it has of them."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("rows").to_pylist()
        keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
        part = lambda k: np.concatenate([np.frombuffer(x, "<u4", m, 4 * k * m) for x, m in zip(keys, sizes, strict=True)])
        columns, n = runs([part(k) for k in range(longest)], np.concatenate([np.frombuffer(x, "<u4") for x in counts]).astype(np.int64))
        change, found, sums = np.zeros(len(n), bool), [], []
        change[:1] = True
        for k in range(longest):
            change[1:] |= columns[k][1:] != columns[k][:-1]
            starts = np.flatnonzero(change)
            if not k:
                continue
            total = np.add.reduceat(n, starts)
            take = total >= least
            take[[0, -1]] = True
            take &= columns[k][starts] > 0
            zero = np.zeros(int(take.sum()), np.uint32)
            found.append(np.stack([columns[j][starts[take]] if j <= k else zero for j in range(longest)], 1))
            sums.append(total[take])
        every = np.concatenate(found).astype(">u4")
        places = pa.py_buffer(np.arange(len(every) + 1, dtype=np.int32) * np.int32(4 * longest))
        key = pa.BinaryArray.from_buffers(pa.binary(), len(every), [None, places, pa.py_buffer(every.tobytes())])
        return pa.table({"key": key, "n": pa.array(np.concatenate(sums), pa.int64())})

    return run


def numbered(words: DataFrame) -> DataFrame:
    """``words`` (lang, word, f) with ``id``, from 1 without gaps, and ``unit``, the id's four bytes."""
    parted = words.withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(ID_PARTS)))
    before = F.coalesce(F.sum("m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parted.groupBy("part").agg(F.count("*").alias("m")).select("part", before.alias("start"))
    placed = parted.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy("lang", "word")))
    rows = placed.join(F.broadcast(starts), "part").select("lang", "word", "f", (F.col("start") + F.col("place")).alias("id"))
    return rows.withColumn("unit", F.unhex(F.lpad(F.hex("id"), 8, "0")))


def _cut(start: Column, length: Column, longest: int) -> Column:
    """Words of a key as a key of their own."""
    return F.substring(F.concat(F.substring(F.col("key"), start * 4 + 1, length * 4), F.lit(bytes(4 * longest))), F.lit(1), F.lit(4 * longest))


def phrase_counts(chunks: DataFrame, ids: DataFrame, longest: int, least: int) -> DataFrame:
    """(key, size, a): phrases of 2 to ``longest`` words that are found ``least`` times or oftener."""
    spark = chunks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words, texts = chunks.where("codes is null"), chunks.where("codes is not null").select("chunk", "codes")
    local = words.join(small_side(ids.select("lang", "word", "id")), ["lang", "word"]).select(F.col("chunk").alias("of"), "local", "id")
    some = texts.select("chunk").orderBy(F.xxhash64("chunk"), "chunk").limit(BOUND_CHUNKS)
    few = [r.chunk for r in some.collect()]
    seen = texts.where(F.col("chunk").isin(few)).groupBy("chunk").cogroup(local.where(F.col("of").isin(few)).groupBy("of")).applyInArrow(encode(longest, None), SENT).collect()
    n_chunks = texts.count()
    size = sum(r.rows for r in seen) * (4 * longest + 4) * n_chunks // max(1, len(few))
    ranges = max(parts, -(-size // RANGE_BYTES))
    sample = np.sort(np.concatenate([np.frombuffer(bytes(r["keys"]), f"S{4 * longest}") for r in seen] or [np.zeros(0, f"S{4 * longest}")]))
    bounds = np.unique(sample[np.arange(1, ranges) * len(sample) // ranges]).tobytes() if len(sample) else b""
    sent = texts.groupBy("chunk").cogroup(local.groupBy("of")).applyInArrow(encode(longest, bounds), SENT)
    found = sent.repartition(ranges, "range").groupBy("range").applyInArrow(count_range(longest, least), COUNTED)
    summed = found.groupBy("key").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    ended = [F.when(F.substring("key", 4 * k + 1, 4) != F.lit(bytes(4)), 1).otherwise(0) for k in range(longest)]
    return summed.select("key", sum(ended[1:], ended[0]).alias("size"), "a")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, share: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language of ``docs`` (text, lang).

    Texts, A to Z lower-cased, fall into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. Candidates
    are phrases of 2 to ``longest`` words that stand ``least`` times or oftener inside pieces of their language. A cut after
    k words has l and r occurrences of its two parts, and the score floor(1000 * a * n / (l * r)), n being all words of the
    language; the lowest score counts, of equal ones that of the smallest k. A candidate goes if a longer one has its words
    and at least ``share`` percent of its occurrences. Order: score and a descending, then the phrase's bytes.

    Null and empty texts have no words, a null language is ``und``, rows that repeat count each time, texts are taken
    whole, whatever their length. An empty table gives no rows; other columns are not looked at. A task holds a chunk of
    about CHUNK_BYTES of text (or one longer text), or a range of about RANGE_BYTES of keys.
    """
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("_lang"), F.coalesce("text", F.lit("")).alias("_text"))
    chunks = stored(texts.mapInArrow(coded, CODED))
    counts = chunks.where("codes is null").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    ids = stored(numbered(counts.where(F.col("f") >= least)))
    totals = small_side(chunks.where("codes is null").groupBy("lang").agg(F.sum("n").alias("n")))
    found = stored(phrase_counts(chunks, ids, longest, least))

    single = ids.select(F.concat("unit", F.lit(bytes(4 * (longest - 1)))).alias("key"), F.col("f").alias("a"), "lang")
    every = stored(found.select("key", "a", F.lit(None).cast("string").alias("lang")).unionByName(single))
    parts = lambda name, value: small_side(every.select(F.col("key").alias(name), F.col("a").alias(value), F.col("lang").alias(f"{name}_lang")))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("head", _cut(F.lit(0), F.col("k"), longest)).withColumn("tail", _cut(F.col("k"), F.col("size") - F.col("k"), longest))
    cuts = cuts.join(parts("head", "l"), "head").join(parts("tail", "r"), "tail")
    whole = cuts.groupBy("key", "size", "a").agg(F.max("head_lang").alias("lang"), F.collect_list(F.struct("k", "l", "r")).alias("cuts")).join(totals, "lang")
    whole = whole.withColumn("best", F.expr(f"array_min(transform(cuts, c -> struct({SCORE} as score, c.k as k, c.l as l, c.r as r)))"))

    longer = found.where("size > 2").withColumn("from", F.explode(F.array(F.lit(0), F.lit(1))))
    longer = longer.select(_cut(F.col("from"), F.col("size") - 1, longest).alias("key"), F.col("a").alias("longer"))
    longer = longer.groupBy("key").agg(F.max("longer").alias("longer"))
    left = whole.join(longer, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    left = stored(left.select("lang", "key", "size", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score")))

    # Only phrases that reach the last place's score and count are spelt out.
    order = [F.col("score").desc(), F.col("a").desc()]
    last = left.select("lang", "score", "a", F.row_number().over(W.partitionBy("lang").orderBy(*order)).alias("place")).where(F.col("place") <= top)
    last = last.groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))
    near = left.join(small_side(last), "lang").where(F.struct("score", "a") >= F.col("last")).drop("last")
    spelt = near.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.substring(F.col("key"), k * 4 + 1, F.lit(4)))).alias("place", "unit"))
    spelt = spelt.join(small_side(ids.select("unit", "word")), "unit").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    ranked = near.join(spelt, "key").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
