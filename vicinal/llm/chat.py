"""Chat formatting by perspective rotation.

For every participant of a dialogue the dialogue is rendered once, with that speaker as the assistant and all others as
named users; the mask marks what the speaker says. Only DataFrame functions are used.

A dialogue is cut into parts of about PART_SIZE characters by the running size of its turns, so that no row holds more
than that and one turn. The running size is a prefix sum: over blocks of turn numbers, over the slices of a block (a turn
number and the first digits of a hash), and inside a slice, so that neither a long dialogue nor many turns of one number
meet in one task. Where a part begins in the text of a speaker is added up from lengths by part and role before anything
is rendered. Texts are shuffled twice, once to be counted and once to meet in their part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART_SIZE = 65_536
#: What a turn counts for beside its text, so that parts of empty turns end, too.
TURN_SIZE = 64
#: Turn numbers of a block, and digits of the hash that tell the slices of one number apart.
BLOCK_TURNS, SLICE_DIGITS = 1024, 3
SYSTEM = "system"
#: What stands around a turn.
OPEN, AFTER_HEAD, CLOSE = "<|turn|>", "\n", "<|end|>\n"
#: Where a turn without number stands: after all others; its slices are named so that they follow those of this number.
NO_TURN, NO_TURN_SLICE = 2**63 - 1, "none"


def _who(role: Column) -> Column:
    return F.when(role == SYSTEM, F.lit(SYSTEM)).when(role == "", F.lit("user")).otherwise(F.concat(F.lit("user name="), role))


def _head(role: Column, speaker: Column) -> Column:
    return F.concat(F.lit(OPEN), F.when(role == speaker, F.lit("assistant")).otherwise(_who(role)), F.lit(AFTER_HEAD))


def _spans(turns: Column) -> Column:
    """(start, end) of the speaker's words and of the mark that ends them, from the lengths of the turns before."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(t["own"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda a: a["spans"])


def _rendered(rows: DataFrame) -> DataFrame:
    """The result's columns for rows of (conv_id, speaker, part, offset, turns)."""
    speaker = F.col("speaker")
    shown = F.transform("turns", lambda t: F.struct(_head(t["role"], speaker).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["role"] == speaker).alias("own")))
    rows = rows.select("conv_id", "speaker", "part", "offset", shown.alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), "")
    return rows.select("conv_id", "speaker", "part", "offset", text.alias("text"), _spans(F.col("turns")).alias("mask"), F.size("turns").cast("long").alias("n_turns"))


def _before(name: str, keys: list[str], order: list[str]) -> Column:
    """The sum of a column over the rows before."""
    return F.coalesce(F.sum(name).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _parted(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text), each once, with ``part`` and ``place``, the order inside a part."""
    hashed = F.md5(F.concat_ws("|", "role", "text"))
    digits = F.concat(F.when(F.col("turn").isNull(), F.lit(NO_TURN_SLICE)).otherwise(F.lit("")), F.substring("hash", 1, SLICE_DIGITS))
    keyed = turns.withColumn("hash", hashed).withColumn("slice", digits).withColumn("turn", F.coalesce("turn", F.lit(NO_TURN))).withColumn("size", F.length("text").cast("long") + TURN_SIZE)
    rows = keyed.repartition("conv_id", "turn", "slice").dropDuplicates()
    rows = rows.withColumn("inside", _before("size", ["conv_id", "turn", "slice"], ["hash", "role", "text"]))
    slices = rows.groupBy("conv_id", "turn", "slice").agg(F.sum("size").alias("n")).withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    blocks = slices.groupBy("conv_id", "block").agg(F.sum("n").alias("b")).withColumn("before_block", _before("b", ["conv_id"], ["block"])).drop("b")
    slices = slices.withColumn("before_slice", _before("n", ["conv_id", "block"], ["turn", "slice"])).join(blocks, ["conv_id", "block"])
    starts = slices.select("conv_id", "turn", "slice", (F.col("before_block") + F.col("before_slice")).alias("before"))
    placed = rows.join(starts, ["conv_id", "turn", "slice"]).withColumn("place", F.col("before") + F.col("inside"))
    return placed.select("conv_id", F.floor(F.col("place") / PART_SIZE).alias("part"), "place", "role", "text")


def rotate(conversations: DataFrame) -> DataFrame:
    """(conv_id, speaker, part, offset, text, mask, n_turns) of ``conversations`` (conv_id, turn, role, text).

    Every role of a dialogue but the system's is a participant and gets the whole dialogue, in parts: a turn counts for
    the characters of its text and TURN_SIZE, and belongs to the part, of PART_SIZE, in which it begins; a longer turn
    leaves part numbers out. ``offset`` counts the characters of the parts before. ``mask`` has the half-open character
    spans, inside ``text``, of the speaker's turns with their end marks. Turns are in the order of their numbers, those
    of one number by a hash of role and text; a repeated row counts once, a turn without number comes last. A null text
    is empty. A null or empty role is a nameless user and no participant. A row without conv_id is a dialogue by itself.
    Dialogues without participants, and an empty table, give no rows; other columns are not looked at.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    turns = conversations.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), role, text)
    parted = _parted(turns)
    lengths = parted.select("conv_id", "part", "role", (F.length(_head(F.col("role"), F.lit(None))) + F.length("text") + len(CLOSE)).cast("long").alias("other"), (F.length(_who(F.col("role"))) - len("assistant")).alias("less"))
    by_role = lengths.groupBy("conv_id", "part", "role").agg(F.sum("other").alias("other"), F.sum("less").alias("less"))
    whole = by_role.groupBy("conv_id", "part").agg(F.sum("other").alias("other")).withColumn("before", _before("other", ["conv_id"], ["part"])).drop("other")
    speakers = by_role.where((F.col("role") != "") & (F.col("role") != SYSTEM)).select("conv_id", F.col("role").alias("speaker")).distinct()
    own = by_role.select("conv_id", "part", F.col("role").alias("speaker"), "less")
    views = whole.join(speakers, "conv_id").join(own, ["conv_id", "part", "speaker"], "left").withColumn("less", F.coalesce("less", F.lit(0)))
    views = views.withColumn("offset", F.col("before") - _before("less", ["conv_id", "speaker"], ["part"])).select("conv_id", "part", "speaker", "offset")
    parts = parted.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    alone = conversations.where("conv_id is null").select("conv_id", role, text).where((F.col("role") != "") & (F.col("role") != SYSTEM))
    zero = F.lit(0).cast("long")
    alone = alone.select("conv_id", F.col("role").alias("speaker"), zero.alias("part"), zero.alias("offset"), F.array(F.struct(zero.alias("place"), "role", "text")).alias("turns"))
    return _rendered(parts.join(views, ["conv_id", "part"]).select("conv_id", "speaker", "part", "offset", "turns")).unionByName(_rendered(alone))


def listed(mask: Column) -> Column:
    """Spans as start:end, joined by commas."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


ROTATE_SQL = f"""
WITH numbered AS (
  SELECT *, row_number() OVER () AS row_id FROM conversations
), turns AS (
  SELECT DISTINCT conv_id, CASE WHEN conv_id IS NULL THEN row_id END AS alone, CASE WHEN conv_id IS NULL THEN 0 ELSE coalesce(turn::BIGINT, {NO_TURN}) END AS turn, conv_id IS NOT NULL AND turn IS NULL AS late,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM numbered
), speakers AS (
  SELECT DISTINCT conv_id, alone, role AS speaker FROM turns WHERE role NOT IN ('', 'system')
), sized AS (
  SELECT *, coalesce(sum(length(text) + {TURN_SIZE}) OVER (PARTITION BY conv_id, alone ORDER BY turn, late, md5(role || '|' || text), role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM turns
), shown AS (
  SELECT t.*, s.speaker, (place // {PART_SIZE})::BIGINT AS part,
    '<|turn|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' WHEN role = '' THEN 'user'
      ELSE 'user name=' || role END || chr(10) AS head,
    text || '<|end|>' || chr(10) AS body
  FROM sized t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.alone IS NOT DISTINCT FROM s.alone
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, alone, speaker, part ORDER BY place) AS stop FROM shown
), parts AS (
  SELECT conv_id, alone, speaker, part, string_agg(head || body, '' ORDER BY place) AS text,
    coalesce(string_agg((stop - length(body))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY place) FILTER (WHERE role = speaker), '') AS mask,
    count(*) AS n_turns
  FROM placed GROUP BY ALL
)
SELECT conv_id, speaker, part, coalesce(sum(length(text)) OVER (PARTITION BY conv_id, alone, speaker ORDER BY part
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", text, mask, n_turns
FROM parts
"""
