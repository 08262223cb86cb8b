"""Substring dedup by fixed-block anchors.

Every text is cut into blocks of ``window // 2`` words that do not overlap; their hashes are the index. All rolling
windows of that length probe it. Wherever a passage of ``window`` words stands twice, each copy holds a whole block of
its text, whose hash is found in the other copy, too: an anchor. Anchors are extended to the windows of ``window`` words
around them, all of whose blocks must be anchors; of equal such windows the earliest stays, and runs of the others are
the maximal repeats that are removed.

Texts lie in chunks by a hash of their doc_id and text, in one exchange that all three passes read. A pass sends one row of
packed hashes per chunk and bucket, each hash once per chunk, however often the chunk has it, and gets back one row
of those that matter. No row goes through the driver but the bytes of all texts, which set the number of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K

#: Bytes of text in a chunk and for a bucket of hashes.
CHUNK_BYTES = 8_000_000
BUCKET_BYTES = 32_000_000
#: Bits of an anchor hash beside its bucket; with two flags they are four bytes. A false anchor costs some work only.
ANCHOR_BITS = 30
ALIGNED, REPEATED = 1, 2
#: doc_id of rows without one: after all others. Rows of one doc_id are ordered by a hash of their texts, which is negative
#: for rows with a doc_id and not for those without, so that the largest id is still told from none.
LAST = 2**63 - 1

PACKED = "bucket long, chunk long, packed binary"
OUT = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"


def grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, group): hashes[order] is sorted, equal ones in their old order; first marks where a group begins."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    return order, first, np.cumsum(first) - 1


def in_order(table: pa.Table) -> pa.Table:
    """The rows of a chunk in the order in which texts are earlier or later."""
    return table.select(["_id", "_order", "_text"]).sort_by([("_id", "ascending"), ("_order", "ascending"), ("_text", "ascending")]).combine_chunks()


def texts_of(table: pa.Table) -> Iterator[tuple[int, int, K.Words]]:
    for a, b, data, offsets in K.slices(table.column("_text").combine_chunks() if table.num_rows else pa.array([], pa.string())):
        yield a, b, K.split(data, offsets)


class Anchors:
    """Hashes of rolling half windows as a bucket and ANCHOR_BITS bits."""

    def __init__(self, window: int, buckets: int):
        self.window, self.block, self.buckets = window, window // 2, buckets

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        rolled = K.windows(hashes, self.block)
        return ((rolled >> K.U64(40)) % K.U64(self.buckets) << K.U64(ANCHOR_BITS)) | (rolled & K.U64((1 << ANCHOR_BITS) - 1))

    def blocks(self, words: K.Words) -> np.ndarray:
        """Places of the rolling half windows that are blocks of their text."""
        n = max(0, len(words.starts) - self.block + 1)
        place = np.arange(n) - words.bounds[words.text_of()[:n]]
        return np.flatnonzero(K.inside(words, self.block) & (place % self.block == 0))


def send(keys: np.ndarray, flags: np.ndarray, chunk: int) -> Iterator[tuple[int, int, bytes]]:
    """Sorted keys and their flags as a row per bucket, four bytes an entry."""
    buckets = keys >> K.U64(ANCHOR_BITS)
    entries = (((keys & K.U64((1 << ANCHOR_BITS) - 1)) << K.U64(2)) | flags).astype("<u4")
    starts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(buckets) else np.zeros(0, int)
    for a, b in zip(starts, np.append(starts[1:], len(buckets)), strict=True):
        yield int(buckets[a]), chunk, entries[a:b].tobytes()


def batch(rows: list[tuple], names: tuple[str, ...] = ("bucket", "chunk", "packed")) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=list(names))


def probe(window: int, buckets: int):
    """Pass 1 over a chunk: each hash of a rolling half window once, whether it is a block and whether it repeats here."""

    def run(table: pa.Table) -> pa.Table:
        anchors, keys, aligned = Anchors(window, buckets), [], []
        chunk = table.column("_chunk")[0].as_py()
        for _, _, words in texts_of(table):
            found = anchors.keys(words.hashes())
            whole, block = K.inside(words, anchors.block), np.zeros(len(found), bool)
            block[anchors.blocks(words)] = True
            keys.append(found[whole])
            aligned.append(block[whole])
        keys, aligned = np.concatenate(keys), np.concatenate(aligned)
        order, first, _ = grouped(keys)
        starts = np.flatnonzero(first)
        if not len(starts):
            return batch([])
        flags = np.logical_or.reduceat(aligned[order], starts).astype(K.U64) * K.U64(ALIGNED)
        flags |= (np.diff(np.append(starts, len(order))) > 1).astype(K.U64) * K.U64(REPEATED)
        return batch(list(send(keys[order][starts], flags, chunk)))

    return run


def match(table: pa.Table) -> pa.Table:
    """Index meets probes: for each chunk its blocks of this bucket that stand in two places at least."""
    packed = table.column("packed").to_pylist()
    entries = np.frombuffer(b"".join(packed), "<u4").astype(K.U64)
    keys, flags = entries >> K.U64(2), entries & K.U64(3)
    order, first, group = grouped(keys)
    starts = np.flatnonzero(first)
    if not len(starts):
        return batch([])
    any_flag = np.bitwise_or.reduceat(flags[order], starts)
    twice = (np.diff(np.append(starts, len(order))) > 1) | (any_flag & K.U64(REPEATED) > 0)
    hit = np.empty(len(keys), bool)
    hit[order] = (twice & (any_flag & K.U64(ALIGNED) > 0))[group]
    hit &= flags & K.U64(ALIGNED) > 0
    chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
    bounds = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed])))
    rows = [(bucket, c, keys[a:b][hit[a:b]].astype("<u8").tobytes()) for c, a, b in zip(chunks, bounds[:-1], bounds[1:], strict=True) if hit[a:b].any()]
    return batch(rows)


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``of``; most that are not are seen by a bitmap."""
    out = np.zeros(len(values), bool)
    if len(of) and len(values):
        bits = np.zeros(1 << 20, bool)
        bits[(of & K.U64((1 << 20) - 1)).astype(np.int64)] = True
        maybe = np.flatnonzero(bits[(values & K.U64((1 << 20) - 1)).astype(np.int64)])
        place = np.searchsorted(of, values[maybe])
        out[maybe] = of[np.minimum(place, len(of) - 1)] == values[maybe]
    return out


#: A second, independent hash of a window, of which 32 bits are used.
OTHER = K.U64(0xC2B2AE3D27D4EB4F)
WINDOW_KEY = np.dtype([("h", "<u8"), ("g", "<u4")])


def whole_windows(words: K.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, g, whole): 96 bits of every rolling window, and whether it lies in one text."""
    hashes = words.hashes()
    return K.windows(hashes, window), (K.windows(hashes, window, OTHER) >> K.U64(32)).astype("<u4"), K.inside(words, window)


def distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): (h, g)[order] is sorted, equal ones in their old order; first marks where a group begins."""
    order = np.argsort(h, kind="stable")
    hs, gs = h[order], g[order]
    same = np.zeros(len(h), bool)
    same[1:] = hs[1:] == hs[:-1]
    if (same[1:] & (gs[1:] != gs[:-1])).any():  # equal h, other g: sort by both
        order = np.lexsort((np.arange(len(h)), g, h))
        hs, gs = h[order], g[order]
        same[1:] = (hs[1:] == hs[:-1]) & (gs[1:] == gs[:-1])
    return order, ~same


def extend(window: int, buckets: int):
    """Pass 2 over a chunk and its anchors: each window that may stand twice, once, with the first text that has it here.

    Both copies of such a window hold all blocks of their own text in it, one or two, as anchors.
    """

    def run(key, table: pa.Table, hits: pa.Table) -> pa.Table:
        if not table.num_rows or not hits.num_rows:
            return batch([])
        anchors = Anchors(window, buckets)
        table = in_order(table)
        known = [np.frombuffer(p, "<u8") | K.U64(b << ANCHOR_BITS) for b, p in zip(hits.column("bucket").to_pylist(), hits.column("packed").to_pylist(), strict=True)]
        known = np.sort(np.concatenate(known))
        hs, gs, rows_of = [], [], []
        for a, _, words in texts_of(table):
            h, g, whole = whole_windows(words, window)
            found, aligned = anchors.keys(words.hashes()), anchors.blocks(words)
            lacking = np.zeros(len(found), np.int64)
            lacking[aligned] = ~member(found[aligned], known)
            lacking = np.concatenate(([0], np.cumsum(lacking)))
            reach = window - anchors.block + 1
            take = np.flatnonzero(whole & (lacking[reach : reach + len(h)] == lacking[: len(h)]))
            hs.append(h[take])
            gs.append(g[take])
            rows_of.append(a + words.text_of()[take])
        h, g, row = np.concatenate(hs), np.concatenate(gs), np.concatenate(rows_of)
        order, first = distinct(h, g)
        one = order[first]
        bucket = (h[one] >> K.U64(40)) % K.U64(buckets)
        by = np.lexsort((row[one], bucket))
        doc, place = (table.column(c).to_numpy()[row] for c in ("_id", "_order"))
        one, bucket = one[by], bucket[by]
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, int)
        rows = []
        for a, b in zip(starts, np.append(starts[1:], len(bucket)), strict=True):
            part = one[a:b]
            steps = [np.diff(x[part], prepend=0).astype("<i8").tobytes() for x in (doc, place)]  # runs of one text, so that they compress
            rows.append((int(bucket[a]), int(key[0].as_py()), h[part].astype("<u8").tobytes() + g[part].astype("<u4").tobytes() + b"".join(steps)))
        return batch(rows)

    return run


def earliest(table: pa.Table) -> pa.Table:
    """Windows of a bucket that an earlier text of another chunk has: for each chunk those that lose."""
    packed = table.column("packed").to_pylist()
    chunks = table.column("chunk").to_pylist()
    counts = [len(p) // 28 for p in packed]
    h = np.concatenate([np.frombuffer(p, "<u8", n) for p, n in zip(packed, counts, strict=True)])
    g = np.concatenate([np.frombuffer(p, "<u4", n, 8 * n) for p, n in zip(packed, counts, strict=True)])
    doc, place = (np.concatenate([np.cumsum(np.frombuffer(p, "<i8", n, at * n)) for p, n in zip(packed, counts, strict=True)]) for at in (12, 20))
    by = np.lexsort((place, doc))
    change = np.ones(len(by), bool)
    change[1:] = (doc[by][1:] != doc[by][:-1]) | (place[by][1:] != place[by][:-1])
    doc = np.empty(len(by), np.int64)  # from here on: which of the bucket's texts, in their order
    doc[by] = np.cumsum(change)
    order, first = distinct(h, g)
    starts = np.flatnonzero(first)
    if not len(starts):
        return batch([])
    least = np.minimum.reduceat(doc[order], starts)
    loses = np.empty(len(h), bool)
    loses[order] = doc[order] > least[np.cumsum(first) - 1]
    bounds = np.concatenate(([0], np.cumsum(counts)))
    rows = []
    for c, a, b in zip(chunks, bounds[:-1], bounds[1:], strict=True):
        out = np.flatnonzero(loses[a:b]) + a
        if len(out):
            rows.append((0, c, h[out].astype("<u8").tobytes() + g[out].astype("<u4").tobytes()))
    return batch(rows)


def remove(window: int):
    """Pass 3 over a chunk: what is left of each text, and the maximal repeats that go."""

    def run(key, table: pa.Table, losers: pa.Table) -> pa.Table:
        table = in_order(table)
        packed = losers.column("packed").to_pylist() if losers.num_rows else []
        n = [len(p) // 12 for p in packed]
        lost_h = np.concatenate([np.frombuffer(p, "<u8", k) for p, k in zip(packed, n, strict=True)] or [np.zeros(0, "<u8")])
        lost_g = np.concatenate([np.frombuffer(p, "<u4", k, 8 * k) for p, k in zip(packed, n, strict=True)] or [np.zeros(0, "<u4")])
        parts = list(texts_of(table))
        hashed = [whole_windows(w, window) for _, _, w in parts]
        sizes = [len(h) for h, _, _ in hashed]
        h = np.concatenate([x[0] for x in hashed] or [np.zeros(0, K.U64)])
        g = np.concatenate([x[1] for x in hashed] or [np.zeros(0, "<u4")])
        whole = np.concatenate([x[2] for x in hashed] or [np.zeros(0, bool)])
        del hashed
        gone = np.zeros(len(h), bool)
        take = np.flatnonzero(whole)
        order, first = distinct(h[take], g[take])
        gone[take[order[~first]]] = True  # the chunk has it earlier
        maybe = take[member(h[take], np.sort(lost_h))]
        if len(maybe):
            pairs = np.zeros(len(lost_h), WINDOW_KEY)
            pairs["h"], pairs["g"] = lost_h, lost_g
            mine = np.zeros(len(maybe), WINDOW_KEY)
            mine["h"], mine["g"] = h[maybe], g[maybe]
            gone[maybe[np.isin(mine, pairs)]] = True
        out, at = [], 0
        ids = table.column("_id").to_numpy()
        none = (ids == LAST) & (table.column("_order").to_numpy() >= 0)
        for (a, b, words), size in zip(parts, sizes, strict=True):
            out.append(kept(pa.array(ids[a:b], pa.int64(), mask=none[a:b]), words, gone[at : at + size], window))
            at += size
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64())})

    return run


def kept(ids: pa.Array, words: K.Words, gone: np.ndarray, window: int) -> pa.Table:
    """Rows of the result for some texts. gone: windows to be removed."""
    n, bounds = len(words.starts), words.bounds
    change = np.zeros(n + 1, np.int64)
    where = np.flatnonzero(gone)
    np.add.at(change, where, 1)
    np.add.at(change, where + window, -1)
    cover = np.cumsum(change[:n]) > 0
    removed = np.concatenate(([0], np.cumsum(cover)))
    stay = ~cover
    starts, ends = words.starts[stay], words.ends[stay]
    # The bytes of words that stay, each followed by one place for a space.
    lengths = ends - starts
    place = np.concatenate(([0], np.cumsum(lengths + 1)))
    out = np.full(int(place[-1]), 32, np.uint8)
    mark = np.zeros(len(words.data) + 1, np.int8)
    mark[starts] += 1
    np.add.at(mark, ends, -1)
    target = np.ones(int(place[-1]), bool)
    target[place[1:] - 1] = False
    out[target] = words.data[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    before = np.concatenate(([0], np.cumsum(stay)))[bounds]
    raw = out.tobytes()
    begin, end = place[before[:-1]], np.maximum(place[before[1:]] - 1, place[before[:-1]])
    texts = [raw[a:b].decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    n_removed = removed[bounds[1:]] - removed[bounds[:-1]]
    spans: list[list] = [[] for _ in range(len(ids))]
    if len(where):
        edge = np.zeros(n + 2, bool)
        edge[bounds] = True  # a repeat ends with its text
        covered = np.concatenate(([False], cover, [False]))
        opens = np.flatnonzero(cover & (~covered[:-2] | edge[:n]))
        closes = np.flatnonzero(cover & (~covered[2:] | edge[1 : n + 1])) + 1
        text = words.text_of()[opens] if len(opens) else opens
        for k, a, b in zip(text.tolist(), opens.tolist(), closes.tolist(), strict=True):
            spans[k].append({"start": a - int(bounds[k]), "end": b - int(bounds[k])})
    return pa.table(
        {
            "doc_id": ids,
            "n_words": pa.array(np.diff(bounds), pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array(texts, pa.string()),
        }
    )


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept) of each row of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` words covers it whose words also start earlier: in a row of smaller doc_id, or
    earlier in the same row. Windows count as equal by 96 bits of two hashes of their words (64 bits each); the words
    themselves are not compared again. ``removed`` are the maximal runs of such words, ``kept`` the others joined by one space.
    Null and empty texts have no words. Rows without doc_id come after all others; rows of one doc_id, or of none,
    are taken in the order of a hash of their texts, so the second of two equal rows is a repeat. An empty table gives no rows; other columns are
    not looked at. A task holds one chunk of about CHUNK_BYTES, or the one text that is longer.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.coalesce("text", F.lit("")).alias("_text"), F.col("doc_id").isNull().alias("_none"))
    order = F.shiftrightunsigned(F.xxhash64("_text"), 1)
    rows = rows.select("_id", "_text", F.when(F.col("_none"), order).otherwise(-1 - order).alias("_order"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks, buckets = max(least, -(-size // CHUNK_BYTES)), max(least, -(-size // BUCKET_BYTES))
    # As many partitions as chunks and buckets, so that a task's work doesn't grow with the input.
    by_chunk = rows.withColumn("_chunk", F.pmod(F.xxhash64("_id", "_order"), F.lit(chunks))).repartition(chunks, "_chunk").groupBy("_chunk")
    by_bucket = lambda df: df.repartition(buckets, "bucket").groupBy("bucket")
    hits = by_bucket(by_chunk.applyInArrow(probe(window, buckets), PACKED)).applyInArrow(match, PACKED)
    near = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(extend(window, buckets), PACKED)
    losers = by_bucket(near).applyInArrow(earliest, PACKED)
    return by_chunk.cogroup(losers.groupBy("chunk")).applyInArrow(remove(window), OUT)
