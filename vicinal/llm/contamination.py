"""Benchmark decontamination by winnowing. Only DataFrame functions are used.

A window of m words is known by the smallest hash of its runs of k = m // 2 + 1 words: two equal windows have the same one,
so every shared span of m words is found by joining these fingerprints. Neighbouring windows mostly share theirs; each run
of such windows is one row of a text, with its fingerprint and its words. Rows that meet a fingerprint of a benchmark item
are extended: their windows are compared with the item's, word by word. Windows have ``window`` words; items with
fewer words are one window of their own length, and texts are winnowed for each of these lengths, too.

Known fingerprints leave texts in the pass that reads them, with the words that the extension needs, so texts are never
shuffled or read again. Results depend on a text alone and are joined back by its digest: copies of a text become one group, whose
rows are made distinct before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, stored

#: Runs of these characters stand between words, runs of all others are words.
APART, WORD = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Most rows of fingerprints, and of windows, that are broadcast; more are shuffled.
PRINT_ROWS, WINDOW_ROWS = 2_000_000, 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text with A to Z in lower case; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    plain = lambda x: F.length(x) == F.octet_length(x)
    words = lambda x: F.array_remove(F.split(x, APART), "")
    low = lambda w: F.when(plain(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.when(plain(text), words(F.lower(text))).otherwise(F.transform(words(text), low))


def fingerprints(hashes: Column, m: int) -> Column:
    """For each window of m words the smallest hash of its runs of m // 2 + 1 words; ``hashes``: one hash for each word."""
    k = m // 2 + 1
    n = F.size(hashes)
    runs = F.transform(F.slice(hashes, 1, F.greatest(n - k + 1, F.lit(0))), lambda h, i: F.xxhash64(F.lit(m), h, *(F.get(hashes, i + j) for j in range(1, k))))
    if k == m:
        return runs
    # The array is bound once, as the one element of a list, or every use would compute it again.
    least = lambda r: F.transform(F.slice(r, 1, F.greatest(n - m + 1, F.lit(0))), lambda h, i: F.least(h, *(F.get(r, i + j) for j in range(1, m - k + 1))))
    return F.get(F.transform(F.array(runs), least), F.lit(0))


def winnowed(rows: DataFrame, m: int, counted: bool = False) -> DataFrame:
    """(the columns of ``rows`` but words and hashes, m, print, at, span): runs of windows with one fingerprint.

    ``at`` is the word with which the first window begins, ``span`` the words of as many windows as a fingerprint can be
    the least of, from there; a longer run is cut. counted: one row more without a print, where ``at`` is the number of
    words.
    """
    most = m - m // 2
    own = [c for c in rows.columns if c not in ("words", "hashes")]
    prints = rows.select(*own, "words", fingerprints(F.col("hashes"), m).alias("prints"))
    every = F.when(F.size("prints") > 0, F.sequence(F.lit(0), F.size("prints") - 1)).otherwise(F.array().cast("array<int>"))
    begins = F.filter(every, lambda i: (i % most == 0) | (F.get("prints", i) != F.get("prints", i - 1)))
    spans = F.transform(
        begins,
        lambda i: F.struct(F.get("prints", i).alias("print"), i.alias("at"), F.array_join(F.slice("words", i + 1, F.lit(m + most - 1)), " ").alias("span")),
    )
    if counted:
        whole = F.struct(F.lit(None).cast("long").alias("print"), F.size("words").alias("at"), F.lit(None).cast("string").alias("span"))
        spans = F.concat(F.array(whole), spans)
    return prints.select(*own, F.lit(m).alias("m"), F.inline(spans))


def windows(runs: DataFrame) -> DataFrame:
    """The windows of runs: ``at`` and ``words``, m of them joined by spaces. Some may be listed by two runs."""
    own = [c for c in runs.columns if c not in ("print", "at", "span")]
    parts = runs.select(*own, "at", F.split("span", " ").alias("part"))
    each = parts.select(*own, "at", "part", F.explode(F.sequence(F.lit(0), F.size("part") - F.col("m"))).alias("step"))
    return each.select(*own, (F.col("at") + F.col("step")).alias("at"), F.array_join(F.slice("part", F.col("step") + 1, F.col("m")), " ").alias("words"))


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _hashed(rows: DataFrame, *own: Column | str) -> DataFrame:
    return rows.select(*own, words_of(F.col("text")).alias("words")).select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def covered(spans: Column) -> Column:
    """Words inside any of the sorted (at, m)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))

    def step(a: Column, s: Column) -> Column:
        end = s["at"] + s["m"]
        more = F.greatest(end - F.greatest(a["to"], s["at"]), F.lit(0))
        return F.struct((a["n"] + more).alias("n"), F.greatest(a["to"], end).alias("to"))

    return F.aggregate(spans, start, step, lambda a: a["n"])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of each row of ``docs`` (doc_id, text): what stands of ``benchmark`` (item_id, text) in it.

    Words are runs of ASCII letters, digits and all characters beyond ASCII, A to Z in lower case. An item's windows are
    its runs of ``window`` words, or all its words if it has fewer; words of a text inside any of an item's windows are
    hit. ``items`` are the distinct ids, as strings in their order, of items with a window in the text.

    Null and empty texts have no words; an item without words has no windows, one without item_id hits words but is not
    listed, rows of one item_id are one item. Rows that repeat get their results each, a null doc_id stays, texts are taken
    whole, whatever their length, and windows are compared as words, not by hashes. Empty tables give no rows, or rows
    without hits; other columns are not looked at.
    """
    items = stored(_hashed(benchmark, F.col("item_id").cast("string").alias("item")))
    m = F.least(F.size("words"), F.lit(window))
    lengths = sorted(r[0] for r in items.where(F.size("words") > 0).select(m).distinct().collect())
    if not lengths:
        none = F.array().cast("array<string>")
        return docs.select("doc_id", size_of(F.col("text")).alias("n_words"), F.lit(0).cast("long").alias("n_hit"), none.alias("items"))

    runs = stored(_union([winnowed(items.where(m == length), length) for length in lengths]))
    known = stored(windows(runs).select("m", "words", "item").distinct())
    prints = small_side(runs.select("print").distinct().withColumn("known", F.lit(True)), PRINT_ROWS)

    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    texts = _hashed(docs, "doc_id", digest.alias("digest"))
    found = _union([winnowed(texts, length, length == lengths[0]) for length in lengths]).join(prints, "print", "left")
    found = stored(found.where("print is null or known").drop("known"))
    hits = windows(found.where("print is not null").drop("doc_id")).join(small_side(known.select("m", "words").distinct(), WINDOW_ROWS), ["m", "words"], "left_semi").distinct()
    hits = stored(hits.select("digest", "at", "m", "words"))
    spans = hits.groupBy("digest").agg(covered(F.array_sort(F.collect_list(F.struct("at", "m")))).alias("n_hit"))
    named = hits.select("digest", "m", "words").distinct().join(small_side(known.where("item is not null"), WINDOW_ROWS), ["m", "words"])
    listed = named.select("digest", "item").distinct().groupBy("digest").agg(F.array_sort(F.collect_list("item")).alias("items"))
    result = small_side(spans.join(listed, "digest", "left"), WINDOW_ROWS)
    rows = found.where("print is null").select("doc_id", "digest", F.col("at").cast("long").alias("n_words")).join(result, "digest", "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
