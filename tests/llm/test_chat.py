"""Perspective rotation against plain Python."""

import hashlib

from vicinal.llm.chat import NO_TURN, PART_SIZE, TURN_SIZE, listed, rotate

SCHEMA = "conv_id long, turn int, role string, text string, speaker string, part string"


def brute(rows):
    talks, out = {}, []
    keyed = {(c, NO_TURN if t is None else t, r or "", x or "") for c, t, r, x in rows if c is not None}
    for c, t, r, x in keyed:
        talks.setdefault(c, []).append((t, r, x))
    for k, (c, _, r, x) in enumerate(rows):
        if c is None:
            talks[None, k] = [(0, r or "", x or "")]
    for c, turns in talks.items():
        for speaker in {r for _, r, _ in turns} - {"", "system"}:
            parts, place = {}, 0
            for _, r, x in sorted(turns, key=lambda t: (t[0], hashlib.md5(f"{t[1]}|{t[2]}".encode()).hexdigest(), t[1:])):
                p = parts.setdefault(place // PART_SIZE, ["", [], 0])
                place += len(x) + TURN_SIZE
                name = "assistant" if r == speaker else "system" if r == "system" else f"user name={r}" if r else "user"
                p[0] += f"<|turn|>{name}\n"
                start = len(p[0])
                p[0] += f"{x}<|end|>\n"
                p[2] += 1
                if r == speaker:
                    p[1].append(f"{start}:{len(p[0])}")
            offset = 0
            for k in sorted(parts):
                text, mask, n = parts[k]
                out.append((None if isinstance(c, tuple) else c, speaker, k, offset, text, ",".join(mask), n))
                offset += len(text)
    return sorted(out, key=str)


def check(spark, rows):
    df = rotate(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    got = df.select("conv_id", "speaker", "part", "offset", "text", listed(df.mask), "n_turns").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    return got


def test_dialogues(spark):
    rows = [(c, t, ["user", "assistant", "system", "Bär"][(c + t) % (2 + c % 3)], f"t{c}é{t}" * (t % 5)) for c in range(30) for t in range(c % 7)]
    rows += [(99, t, f"s{t % 3}", f"line {t}") for t in range(-3, 3 * PART_SIZE // TURN_SIZE)]
    check(spark, rows)


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, "user", "late"), (1, 2, None, "nobody"), (1, 2, "", ""), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (None, 0, "user", "x"), (None, 1, "user", "y"), (None, 1, "user", "y"), (None, 1, None, "z"), (2, 0, "system", "only"), (3, 0, "user", "w " * 50_000), (3, 1, "user", "after a long one")]
    check(spark, rows)
    assert rotate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_turns_of_one_number_and_of_no_dialogue(spark):
    """100,000 turns of one number, and as many rows without a dialogue: rows stay small, and nothing is lost."""
    n = 100_000
    df = spark.range(n).selectExpr("1L as conv_id", "if(id % 2 = 0, 7, null) as turn", "if(id % 5 = 0, 'a', 'b') as role", "concat('text ', id) as text")
    got = rotate(df).selectExpr("speaker", "part", "offset", "length(text) as n", "n_turns").collect()
    for speaker in "ab":
        mine = sorted((r.part, r.offset, r.n, r.n_turns) for r in got if r.speaker == speaker)
        assert sum(r[3] for r in mine) == n and len(mine) > 50
        assert all(a[1] + a[2] == b[1] for a, b in zip(mine, mine[1:], strict=False)) and max(r[3] for r in mine) <= PART_SIZE // TURN_SIZE + 1
    alone = rotate(df.selectExpr("cast(null as long) as conv_id", "turn", "role", "text"))
    assert alone.count() == n and alone.where("part <> 0 or offset <> 0 or n_turns <> 1").count() == 0


def test_native(spark):
    """No Python worker in the plan."""
    plan = rotate(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_the_largest_turn_number_is_not_none(spark):
    rows = [(1, t, "a", x) for t, x in ((2**63 - 1, "same"), (None, "same"), (2**63 - 1, "other"), (0, "first"), (None, "last"))]
    (row,) = rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    said = row.text.split("<|turn|>assistant\n")[1:]
    assert row.n_turns == 5 and said[0].startswith("first") and {s[:4] for s in said[1:3]} == {"same", "othe"} and {s[:4] for s in said[3:]} == {"same", "last"}
