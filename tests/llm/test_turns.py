"""Repairs of conversations: against brute force over edit sequences, and one conversation that is all rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

from parchmill.llm.queries import op13_turn_repair
from parchmill.llm.turn_repair import damaged, digests, repair, repaired_turns

TURNS = "conv_id long, turn long, role string, text string, key long, block string, kind int, piece string, same long"
NEXT = {"": "user", "s": "user", "u": "assistant", "a": "user"}
SPACE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", 2, "p", 3) for r in rows], TURNS)


def faults(rows):
    """(role, text) in order -> (must go, truncated) and counts."""
    out, seen, counts = [], set(), [0, 0, 0]
    for role, text in rows:
        ink = text.rstrip(SPACE).lstrip(SPACE)
        fault = 0 if not ink else 1 if (role, text) in seen else 2 if ink[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        out.append((fault in (0, 1), fault == 2))
    return out, counts


def candidates(rows):
    """Every edit sequence with at most two insertions in a place: (cost, audit, repaired lines)."""
    marks, _ = faults(rows)

    def go(i, state, cost, audit, lines, room):
        if i == len(rows) and state in ("", "a"):
            yield cost, audit, lines
        if room:
            role = NEXT[state]
            yield from go(i, role[0], cost + 5, audit + "I", [*lines, role + ":"], room - 1)
        if i < len(rows):
            (role, text), (must_go, cut) = rows[i], marks[i]
            yield from go(i + 1, state, cost + 2, audit + "D", lines, 2)
            if not must_go:
                extra = 5 * cut
                if role[:1] == NEXT[state][0] or (role[:1] == "s" and state == ""):
                    yield from go(i + 1, role[:1], cost + extra, audit + "K", [*lines, f"{role}:{text}"], 2)
                yield from go(i + 1, NEXT[state][0], cost + 1 + extra, audit + "R", [*lines, f"{NEXT[state]}:{text}"], 2)

    return go(0, "", 0, "", [], 2)


def fold(rows):
    """The same by one pass over states, for long conversations."""
    marks, _ = faults(rows)
    best = {"": (0, "")}

    def inserted(b):
        b = dict(b)
        for _ in range(2):
            for s, (c, a) in list(b.items()):
                t = NEXT[s][0]
                b[t] = min(b.get(t, (10**9, "")), (c + 5, a + "I"))
        return b

    for (role, _), (must_go, cut) in zip(rows, marks):
        new = {}
        for s, (c, a) in inserted(best).items():
            ways = [(s, c + 2, "D")]
            if not must_go:
                ways.append((NEXT[s][0], c + 1 + 5 * cut, "R"))
                if role[:1] == NEXT[s][0] or (role[:1] == "s" and s == ""):
                    ways.append((role[:1], c + 5 * cut, "K"))
            for t, cost, letter in ways:
                new[t] = min(new.get(t, (10**9, "")), (cost, a + letter))
        best = new
    return min(v for k, v in inserted(best).items() if k in ("", "a"))


def expected(all_rows):
    """Rows of the four columns -> {conv_id: report}, as the contract says it."""
    convs = {}
    for conv, turn, role, text in all_rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        numbers = [t for t, _, _ in kept if t is not None]
        ordered = [(r, x) for _, r, x in sorted(kept, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(ordered))
        cost, audit, lines = min(candidates(ordered), key=lambda c: c[:2])
        out[conv] = (gaps, *faults(ordered)[1], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", None, ""], ["Yes.", "No!", "a", "b? ", " \n", "", None, "c.\t", "é😀."]
    rows = []
    for conv in [None, *range(60)]:
        # numbers may be null or far apart; two rows of a number differ in role
        numbers = r.sample([None, -2, 0, 1, 2, 3, 9, 10**12], r.randint(1, 4))
        rows += [(conv, t, role, r.choice(texts)) for t in numbers for role in r.sample(roles, r.choice([1, 1, 2]))][:5]
    frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {x["conv_id"]: tuple(x[c] for c in COLUMNS) for x in op13_turn_repair(spark, str(tmp_path)).collect()}
    assert got == expected(rows)


def test_one_long_conversation(spark):
    """Ranges and blocks of one conversation that holds all rows; its repaired turns match the grammar."""
    r = random.Random(4)
    rows = [(7, i, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "No", "", f"t{i}.", f"u{i}"])) for i in range(1500)]
    done = repair(frame(spark, rows).repartition(5))
    report = done.report.collect()[0]
    assert (report["cost"], report["audit"]) == fold([x[2:] for x in rows])
    marks, counts = faults([x[2:] for x in rows])
    assert [report["blank"], report["duplicate"], report["truncated"]] == counts
    assert report["illegal"] == sum(a[2][0] + b[2][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = [t["role"][0] for t in repaired_turns(done.blocks).orderBy("block", "place").collect()]
    assert "".join(turns).removeprefix("s") == "ua" * (len(turns) // 2) and turns
    assert len({tuple(x) for x in done.blocks.select("block").collect()}) > 3


def test_empty_and_lost(spark, tmp_path):
    assert repair(frame(spark, [])).report.count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = frame(spark, [(gone, 0, "user", "Hi."), (gone, 0, "user", "Hi.")])
    assert damaged(rows).count() == 0
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    got = op13_turn_repair(spark, str(tmp_path)).collect()
    assert [tuple(x[c] for c in COLUMNS) for x in got] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_text_and_repeats(spark):
    text = "word " * 200_000 + "end."
    done = repair(frame(spark, [(1, 0, "user", text), (1, 0, "user", text), (1, 1, "assistant", "Yes.")]))
    row = done.report.collect()[0]
    assert (row["duplicate"], row["truncated"], row["audit"], row["cost"]) == (1, 0, "KDK", 2)
    assert digests(done.blocks).collect()[0]["repaired_sha256"] == hashlib.sha256(f"user:{text}\nassistant:Yes.".encode()).hexdigest()
