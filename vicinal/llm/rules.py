"""Quality rules: a decision list learned from labelled statistics.

The statistics are DataFrame expressions over whole texts. Sequential covering grows a conjunction of thresholds that
rejects bad documents, prunes it on rows that it wasn't grown on, takes away what it covers and goes on; the ordered
rules become one ``when`` chain. Only the labelled sample's statistics (at most ``sample`` rows of a few numbers) reach
the driver, where the thresholds are chosen.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, hashed_sample, labels_of, small_side, words_of

SYMBOLS = "#*$%&|<>"
#: Base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50

#: What rules are made of: name -> expression over the columns of ``counted``.
STATISTICS = {
    "symbols_per_100_words": "100.0 * n_symbols / n_words",
    "marks_per_100_words": "100.0 * n_marks / n_words",
    "upper_percent": "100.0 * n_upper / word_chars",
    "digits_percent": "100.0 * n_digits / word_chars",
    "repeat_percent": "100.0 * n_repeat_words / n_words",
    "dup_lines_percent": "100.0 * n_dup_lines / n_lines",
    "word_length": "1.0 * word_chars / n_words",
    "words_per_line": "1.0 * n_words / n_lines",
    "stops_per_100_words": "100.0 * n_stops / n_words",
    "n_words": "1.0 * n_words",
}
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper", "n_digits", "n_lines", "n_stops")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def let(value: Column, f) -> Column:
    """f(value) with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeated_words(words: Column) -> Column:
    """Number of words in 3-word windows found twice or more in ``words`` (a column), the first included.

    Windows are known by 64-bit hashes. Where these are all different, and that is usual, no word counts; else they are
    sorted with their places: equal neighbours are found again, and the places of such windows, in order, cover three
    words each, less where the next one starts earlier.
    """
    n = F.size(words)
    hashed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    some = let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n >= 4, some).otherwise(F.lit(0)).cast("long")


def covered(hashed: Column) -> Column:
    """Words that the windows found twice or more cover."""

    def places(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    def length(p: Column) -> Column:
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step, lambda a: a["n"])

    ordered = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(ordered, lambda s: length(places(s)))


def fixed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The columns ``keep`` and ``columns``, each computed once however often it is used later.

    Going through ``inline`` keeps later filters and projections from being merged into these expressions.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts of every whole text; a null text counts as an empty one."""
    base = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(without(x, SPACES)) > 0)
    base = fixed(base, [*keep, "_text"], _words=words_of(F.col("_text")), _lines=lines)
    taken = lambda characters: (F.length("_text") - F.length(without(F.col("_text"), characters))).cast("long")
    return fixed(
        base,
        keep,
        n_words=F.size("_words").cast("long"),
        word_chars=F.length(without(F.col("_text"), SPACES)).cast("long"),
        n_symbols=taken(SYMBOLS),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        n_repeat_words=repeated_words(F.col("_words")),
        n_marks=taken("!?;:=_~^"),
        n_upper=taken("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÀÇÑÓÍ"),
        n_digits=taken("0123456789"),
        n_lines=F.size("_lines").cast("long"),
        n_stops=F.size(F.filter("_words", lambda w: F.length(w) <= 3)).cast("long"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


Rule = list[tuple[str, str, float]]


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], most_rules: int = 12, most_terms: int = 3, least_precision: float = 0.9, least_cover: int = 5) -> list[Rule]:
    """Ordered rules (conjunctions of (name, '>' or '<=', threshold)) for rows that are ``bad``.

    Two of three rows grow, the third prunes. A term is the one of most gain p * (log precision after - log before)
    over quantile thresholds. Terms are dropped from the end while that doesn't lower (p - n) / (p + n) on the pruning
    rows. A rule stays if its precision is at least ``least_precision`` and it covers ``least_cover`` bad rows; the
    first that doesn't ends the list.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    grow = np.arange(len(bad)) % 3 != 2
    if not len(bad):
        return rules
    grid = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65))) for j in range(x.shape[1])]
    grid = [(g[1:] + g[:-1]) / 2 for g in grid]

    def mask(rule: Rule) -> np.ndarray:
        m = np.ones(len(bad), bool)
        for name, op, t in rule:
            v = x[:, names.index(name)]
            m &= v > t if op == ">" else v <= t
        return m

    while len(rules) < most_rules and (left & bad).any():
        rule: Rule = []
        inside = left & grow
        while len(rule) < most_terms and (inside & ~bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            best, term = 0.0, None
            for j, name in enumerate(names):
                v = x[inside, j]
                b = bad[inside]
                at = np.searchsorted(grid[j], v, side="left")  # v > grid[k] for k < at
                hp, hn = np.bincount(at[b], minlength=len(grid[j]) + 1), np.bincount(at[~b], minlength=len(grid[j]) + 1)
                above = (b.sum() - np.cumsum(hp)[:-1], (~b).sum() - np.cumsum(hn)[:-1])
                below = (np.cumsum(hp)[:-1], np.cumsum(hn)[:-1])
                for op, (p, n) in ((">", above), ("<=", below)):
                    gain = np.where(p > 0, p * (np.log((p + 1e-9) / (p + n + 1e-9)) - np.log(max(p0, 1e-9) / (p0 + n0))), 0)
                    if len(gain) and gain.max() > best + 1e-9:
                        best, term = float(gain.max()), (name, op, round(float(grid[j][gain.argmax()]), 3))
            if term is None:
                break
            rule.append(term)
            inside &= mask([term])
        worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)((mask(r) & left & ~grow & bad).sum(), (mask(r) & left & ~grow & ~bad).sum())
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        hit = mask(rule) & left
        if not rule or (hit & bad).sum() < least_cover or (hit & bad).sum() < least_precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True (kept) unless a rule holds; the first that holds decides. A statistic without words makes no term true."""
    if not rules:
        return F.lit(True)
    tests = [reduce(Column.__and__, [F.expr(f"coalesce({STATISTICS[n]} {op} {t}D, false)") for n, op, t in rule]) for rule in rules]
    chain = F.when(tests[0], F.lit(False))
    for test in tests[1:]:
        chain = chain.when(test, F.lit(False))
    return chain.otherwise(F.lit(True))


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = 6000, **options) -> list[Rule]:
    """The decision list from at most ``sample`` labelled rows of ``docs``, those whose doc_id has the smallest hashes.

    Rows that fail the base rules (null and empty texts do) teach nothing: the list decides about the rest. Rows without
    doc_id have no label, and labels that are neither 0 nor 1 count for nothing. Without labels, or for an empty table,
    there are no rules. Very long texts are counted whole.
    """
    known = hashed_sample(labels_of(labels, "quality").join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), sample)
    rows = counted(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), ["doc_id", "label"]).where(~base_failed())
    found = rows.select("label", *(F.coalesce(F.expr(e), F.lit(0.0)).cast("double").alias(n) for n, e in STATISTICS.items()), F.xxhash64("doc_id").alias("_order")).collect()
    found = sorted(found, key=lambda r: r[-1])
    names = list(STATISTICS)
    x = np.array([list(r)[1:-1] for r in found], float).reshape(len(found), len(names))
    return learn(x, np.array([r[0] == 0 for r in found], bool), names, **options)


def judged(docs: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """The columns ``keep``, the counts, base_failed and kept.

    Null and empty texts have no words and fail the base rules, very long ones are judged whole, an empty table gives no
    rows. Rows are judged one by one, without a shuffle, so
    repeated rows and ties make no difference; of other columns only those in ``keep`` are returned.
    """
    rows = counted(docs, keep).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the base rules and a list learned from ``labels`` keep, with the same columns.

    Null and empty texts go, repeated rows go or stay alike, very long texts are judged whole, an empty table stays one.
    """
    rules = learn_rules(docs, labels)
    rows = docs.select(F.col("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return judged(rows, rules, ["_row"]).where("kept").select(*(F.col(f"_row.`{c}`") for c in docs.columns))
