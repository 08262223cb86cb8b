"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct word shingles. Its sketch has ``REGISTERS`` registers: the minimum over the set
of exponentially distributed hashes, kept as its truncated logarithm to ``BASE``, so that sketches of parts merge by
the larger register. Equal sets are one class. Classes that agree on all registers of a band are candidates; the
classes tied together by candidates are a family, and all links lie inside families. Inside a family two sketches give
the likeliest similarity (sizes are known, so only the joint part is open), and pairs that may reach the bound are
verified on the full sets. Links become components.

A family of many classes is divided into blocks of bounded size. First only neighbouring blocks are compared, which
ties the dense part of a family together at a cost in proportion to it; then the classes are dealt into new blocks by
component, and only blocks that hold different components are compared, so that no link between classes that are not yet
together goes unseen. There the sketches meet alone, and a full set goes only where its class has a likely pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K
from .common import small_side, stored
from .components import components

REGISTERS = 256
BASE = 1.1
#: Rate of the exponential hashes: keeps a one-element set's registers above 0.
RATE = 20.0
#: Chance that a pair at the bound shares no band.
MISS = 1e-4
#: Classes and shingles of a block, as expected.
BLOCK_ROWS = 200
BLOCK_SHINGLES = 300_000
#: Standard deviations below the bound at which an estimate rules a pair out.
MARGIN = 6.0
#: Classes of small families that a task looks at, as expected.
TOGETHER = 200

_MULTIPLIERS = np.random.default_rng(20240602).integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_LOG = math.log(BASE)
#: Hashes looked at together, so that they stay in a core's cache.
CACHE = 32_768

#: What tells different sets apart: the size and two sums of hashes.
SET = ("n_shingles", "f1", "f2")
SKETCHES = "doc_id long, n_shingles long, f1 long, f2 long, registers binary"


def band_rows(bound: float) -> int:
    """Registers per band: as many as keep the chance of a missed pair at the bound under MISS."""
    p = math.log1p(bound * (BASE - 1)) / _LOG
    return max(r for r in range(1, 17) if r == 1 or (1 - p**r) ** (REGISTERS // r) <= MISS)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set of 64-bit hashes; an empty set has zeros."""
    out = np.zeros((len(sets), REGISTERS), np.uint8)
    filled = [k for k, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(filled):
        to, total = at, 0
        while to < len(filled) and (to == at or total + len(sets[filled[to]]) <= CACHE):
            total += len(sets[filled[to]])
            to += 1
        group = filled[at:to]
        if len(group) == 1 and total > CACHE:  # one long text: merge the registers of its parts
            whole = sets[group[0]]
            out[group[0]] = np.max([registers([whole[a : a + CACHE]])[0] for a in range(0, total, CACHE)], axis=0)
            at = to
            continue
        short = (np.concatenate([sets[k] for k in group]) >> K.U64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(sets[k]) for k in group[:-1]])
        found = np.empty((REGISTERS, len(group)), np.uint32)
        turned = np.empty_like(short)
        for j in range(REGISTERS):
            np.multiply(short, _MULTIPLIERS[j], out=turned)
            turned ^= turned >> np.uint32(15)
            np.minimum.reduceat(turned, starts, out=found[j])
        waiting = -np.log1p(-(found.T + 0.5) / 2.0**32) / RATE
        out[group] = np.clip(np.floor(1 - np.log(waiting) / _LOG), 0, 255).astype(np.uint8)
        at = to
    return out


def told_apart(sets: list[np.ndarray]) -> list[pa.Array]:
    """The columns SET of some sets."""
    f1 = [int(s.sum(dtype=K.U64).view(np.int64)) for s in sets]
    f2 = [int(K.mixed(s ^ K.U64(0x5851F42D4C957F2D)).sum(dtype=K.U64).view(np.int64)) for s in sets]
    return [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], f1, f2)]


def sketch(words: int, lower: bool):
    """From (doc_id, text) batches to rows of SKETCHES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(1)):
                sets = K.distinct_windows(K.split(data, offsets), words, lower)
                packed = pa.array([r.tobytes() for r in registers(sets)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *told_apart(sets), packed], ["doc_id", *SET, "registers"])

    return run


def banded(rows: int):
    """From (doc_id, registers) batches to (band, doc_id): a hash of each band and its number."""
    bands = REGISTERS // rows
    factors = np.multiply.accumulate(np.full(rows, 0x9E3779B97F4A7C15, K.U64))
    numbers = K.mixed(np.arange(1, bands + 1, dtype=K.U64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            m = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, REGISTERS)
            m = m[:, : bands * rows].reshape(-1, bands, rows).astype(K.U64) + K.U64(1)
            keys = K.mixed((m * factors).sum(axis=2, dtype=K.U64) ^ numbers)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(ids, bands))], ["band", "doc_id"])

    return run


def likeliest(ahead: np.ndarray, behind: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that makes the registers of pairs likeliest.

    ahead, behind: registers of the first set that are larger, or smaller, than those of the second; n, m: sizes.
    """
    u, v = n / (n + m), m / (n + m)
    equal = REGISTERS - ahead - behind
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / _LOG

    def fit(j):
        a, b = p(u - v * j), p(v - u * j)
        return ahead * np.log(a) + behind * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    low, high = np.zeros(len(n)), np.minimum(u / v, v / u)
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(18):
        left, right = high - golden * (high - low), low + golden * (high - low)
        better = fit(left) > fit(right)
        low, high = np.where(better, low, left), np.where(better, right, high)
    return (low + high) / 2


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def shared(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    if len(pairs) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in pairs.tolist()], np.int64)
    every = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    first = np.concatenate(([True], every[order][1:] != every[order][:-1]))
    group = np.cumsum(first) - 1
    sizes = np.bincount(group)
    often = sizes > 1
    column = np.cumsum(often) - 1
    take = often[group]
    rows, columns = rows[order][take], column[group][take]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, 4_000_000 // max(1, len(sets)))  # columns at a time: 16 MB
    for a in range(0, int(often.sum()), width):
        some = slice(*np.searchsorted(columns, [a, a + width]))
        dense = np.zeros((len(sets), width), np.float32)
        dense[rows[some], columns[some] - a] = 1
        total += dense @ dense.T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def likely(parts: list[int], side: list[int], sizes: np.ndarray, regs: np.ndarray, bound: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes of different parts that sizes and sketches allow to reach the bound.

    side: classes of the same side (0 or 1) are not compared if both sides are there, for another task does that.
    """
    x, y = np.triu_indices(len(parts), 1)
    part = np.array(parts)
    use = part[x] != part[y]
    if len(set(side)) == 2:
        s = np.array(side)
        use &= s[x] != s[y]
    up, down = bound
    small, large = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
    use &= (small > 0) & (small * down >= large * up)
    x, y = x[use], y[use]
    low = up / down - MARGIN * math.sqrt(up / down * (1 - up / down) / REGISTERS)
    guess = np.empty(len(x))
    for a in range(0, len(x), 20_000):
        i, j = x[a : a + 20_000], y[a : a + 20_000]
        guess[a : a + 20_000] = likeliest((regs[i] > regs[j]).sum(axis=1), (regs[i] < regs[j]).sum(axis=1), sizes[i], sizes[j])
    keep = guess >= low
    return x[keep], y[keep]


def links(ids: list[int], parts: list[int], side: list[int], sets: list[np.ndarray], regs: np.ndarray, bound: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that tie together all of these classes that are tied by any, given those of one part as tied."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tree, root = Forest(len(ids)), {}
    for k, p in enumerate(parts):
        tree.join(k, root.setdefault(p, k))
    x, y = likely(parts, side, sizes, regs, bound)
    if not len(x):
        return []
    up, down = bound
    both = shared(sets, np.stack([x, y], axis=1))
    linked = both * down >= (sizes[x] + sizes[y] - both) * up
    return [(ids[i], ids[j]) for i, j in zip(x[linked].tolist(), y[linked].tolist(), strict=True) if tree.join(i, j)]


MET = "task long, low long, high long, id long"


def hopeful(bound: tuple[int, int]):
    """Of two blocks of a family the classes that have a likely pair there, by their sketches alone."""

    def run(table: pa.Table) -> pa.Table:
        ids, parts, side, sizes = (table.column(c).to_pylist() for c in ("id", "part", "side", "n"))
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint8).reshape(-1, REGISTERS)
        some = np.unique(np.array(ids, np.int64)[np.concatenate(likely(parts, side, np.array(sizes, np.int64), regs, bound))])
        where = [pa.array(np.full(len(some), table.column(c)[0].as_py(), np.int64)) for c in ("task", "low", "high")]
        return pa.table([*where, pa.array(some)], names=["task", "low", "high", "id"])

    return run


FOUND = "a long, b long"


def compare(bound: tuple[int, int]):
    """A task's families, or two blocks of one: their links."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("family", "id", "part", "side", "shingles", "registers")), strict=True), key=lambda r: r[:2])
        out, at = [], 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to][0] == rows[at][0]:
                to += 1
            _, ids, parts, side, sets, regs = zip(*rows[at:to], strict=True)
            at = to
            if len(set(parts)) > 1:
                regs = np.frombuffer(b"".join(regs), np.uint8).reshape(-1, REGISTERS)
                out += links(list(ids), list(parts), list(side), [np.frombuffer(s, K.U64) for s in sets], regs, bound)
        columns = list(zip(*out, strict=True)) or [[], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64())], names=["a", "b"])

    return run


def with_sets(words: int, lower: bool):
    """From (id, text) batches to their sets: what tells them apart, and the sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(1)):
                sets = K.distinct_windows(K.split(data, offsets), words, lower)
                packed = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *told_apart(sets), packed], ["id", *SET, "shingles"])

    return run


def _dealt(rows: DataFrame, partner: str) -> DataFrame:
    """Rows once for each task that they belong to; partner: SQL for the numbers of the blocks to meet."""
    met = rows.withColumn("other", F.explode(F.expr(partner)))
    alone = F.col("blocks") == 1
    met = met.withColumns({
        "task": F.when(alone, F.pmod(F.xxhash64("family"), F.col("tasks"))).otherwise(F.col("family")),
        "low": F.when(alone, -1).otherwise(F.least("block", "other")),
        "high": F.when(alone, -1).otherwise(F.greatest("block", "other")),
    })
    return _sided(met.drop("other", "tasks", "blocks"))


def _sided(rows: DataFrame) -> DataFrame:
    return rows.withColumn("side", F.when(F.col("low") == F.col("high"), 0).otherwise((F.col("block") == F.col("high")).cast("int")))


def _compared(rows: DataFrame, bound: tuple[int, int]) -> DataFrame:
    return rows.select("task", "low", "high", "family", "id", "part", "side", "shingles", "registers").groupBy("task", "low", "high").applyInArrow(compare(bound), FOUND)


def near_duplicates(docs: DataFrame, words: int = 5, bound: tuple[int, int] = (4, 5), lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text).

    Rows are linked if the intersection of their sets of ``words``-word shingles is at least bound[0] / bound[1] of the
    union; the component is the smallest doc_id that links reach, and that row is kept. A text of fewer words is one
    shingle. Null texts and texts without words have no shingles, are linked with nothing and kept. Rows of one doc_id
    are one node of the links, and each is returned. A row without doc_id is linked with nothing: its component is null
    and it is kept. Very long texts are taken whole. An empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sketches = stored(rows.mapInArrow(sketch(words, lower), SKETCHES))
    known = sketches.where("doc_id is not null and n_shingles > 0")
    classes = stored(known.groupBy(*SET).agg(F.min("doc_id").alias("id"), F.first("registers").alias("registers")))
    bands = classes.select("id", "registers").mapInArrow(banded(band_rows(bound[0] / bound[1])), "band long, id long")
    least = bands.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("band", "a")
    candidates = bands.join(least, "band").where("id <> a").select("a", F.col("id").alias("b"))
    families = stored(components(candidates).withColumnRenamed("component", "family"))
    found = _links(spark, rows, classes, families, words, bound, lower)
    members = stored(known.select("doc_id", *SET).join(classes.select(*SET, "id"), [*SET]).select("doc_id", "id").distinct())
    several = members.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z")
    ties = members.join(several, "doc_id").where("id <> a").select("a", F.col("id").alias("b"))
    of_class = components(found.union(ties))
    of_doc = members.join(of_class, "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "id")).alias("c"))
    out = sketches.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left").withColumn("component_id", F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, bound: tuple[int, int] = (4, 5), lower: bool = True) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with the same columns; of several rows of one doc_id one.

    Rows without doc_id stay.
    """
    found = stored(near_duplicates(docs, words, bound, lower).select("doc_id", "kept").where("doc_id is not null"))
    gone = found.where("not kept").select("doc_id").distinct()
    again = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    left = docs.join(small_side(gone), "doc_id", "left_anti")
    repeated = small_side(again)
    return left.join(repeated, "doc_id", "left_anti").union(left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(docs.columns)


def _links(spark, rows: DataFrame, classes: DataFrame, families: DataFrame, words: int, bound: tuple[int, int], lower: bool) -> DataFrame:
    """(a, b): links that tie together the classes of every family."""
    sized = families.join(classes, "id")
    totals = sized.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("long")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-families.count() // TOGETHER))
    sized = sized.join(totals.select("family", F.when(F.col("n") <= 2, F.lit(1)).otherwise(blocks).cast("long").alias("blocks")), "family")
    sized = sized.withColumns({"tasks": F.lit(tasks), "block": F.pmod(F.xxhash64("id"), F.col("blocks")), "part": F.col("id")})
    texts = rows.join(small_side(families.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    sets = texts.mapInArrow(with_sets(words, lower), "id long, n_shingles long, f1 long, f2 long, shingles binary")
    whole = stored(sized.join(sets.dropDuplicates(["id", *SET]), ["id", *SET]).drop("f1", "f2", "n_shingles"))
    around = "case when blocks = 1 then array(block) when block = 0 then array(block, block + 1) when block = blocks - 1 then array(block, block - 1) else array(block, block - 1, block + 1) end"
    near = stored(_compared(_dealt(whole, around), bound))
    large = whole.where("blocks > 1")
    if not large.limit(1).count():
        return near
    return near.union(_across(large, components(near), bound))


def _across(large: DataFrame, parts: DataFrame, bound: tuple[int, int]) -> DataFrame:
    """Links between the components that neighbouring blocks have left in large families."""
    now = large.drop("part", "block", "tasks").join(parts.withColumnRenamed("component", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    sizes = now.groupBy("family", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("family").agg(F.max(F.struct("n", (-F.col("part")).alias("p"))).alias("m")).select("family", (-F.col("m.p")).alias("main"))
    now = stored(now.join(main, "family").withColumn("is_main", F.col("part") == F.col("main")))
    rest = now.where("not is_main").groupBy("family").agg(F.count("*").alias("left"))
    now = now.join(rest, "family").withColumn("others", F.greatest(F.lit(1), F.ceil(F.col("left") / BLOCK_ROWS)).cast("long"))
    # Blocks 0 .. others - 1 hold the rest of a family, the later ones its main component, whose blocks don't meet.
    now = now.withColumn("block", F.when(F.col("is_main"), F.col("others") + F.pmod(F.xxhash64("id"), F.col("blocks"))).otherwise(F.pmod(F.xxhash64("id"), F.col("others"))))
    now = stored(now.withColumn("tasks", F.lit(1)).withColumn("blocks", F.col("others") + F.col("blocks")))
    # Sketches meet first; sets are sent only to the meetings where their class has a likely pair.
    sketched = now.select("tasks", "blocks", "block", "others", "is_main", "family", "id", "part", "registers", (F.octet_length("shingles") / 8).cast("long").alias("n"))
    met = _dealt(sketched, "case when is_main then sequence(0L, others - 1) else sequence(0L, blocks - 1) end").select("task", "low", "high", "id", "part", "side", "n", "registers")
    likely_there = met.groupBy("task", "low", "high").applyInArrow(hopeful(bound), MET)
    return stored(_compared(_sided(likely_there.join(now, "id")), bound))
