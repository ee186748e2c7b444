"""Conversation structure repair: a fold over turns with the cheapest edits, in Spark SQL.

Fault flags come from expressions and one window.  A conversation's turns are collected as sorted structs,
and ``aggregate`` carries four (cost, audit) structs through ``least``: one for each state of the grammar
``(s?(ua)+)?`` (nothing yet, after the system turn, after a user turn, after an assistant turn).

The fold of a run of turns is a matrix: the cheapest (cost, audit) from each state to each state.  Matrices of
consecutive runs multiply, so a conversation is cut into blocks of ``BLOCK`` turns at most, which are folded
apart and then combined, ``BLOCK`` at a time: no task collects more turns than a block, whatever the
length of a conversation.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scans import PART, POS, ranged
from .storage import Scratch, ref

#: Bits of a place within a block, and of a block within the next larger one.
BITS = 8
BLOCK = 1 << BITS
#: Costs of the edits, and of a truncated turn that stays.
RE_ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Above any real cost: a state that can't be reached.
FAR = 1 << 40
SPACE = r"[\x20\x09-\x0D]"
INK = r"[^\x20\x09-\x0D]"
STATES = range(4)


def _plus(s: Column, cost: int | Column, letters: str) -> Column:
    return F.struct((s["cost"] + (F.lit(cost) if isinstance(cost, int) else cost)).cast("long").alias("cost"), F.concat(s["audit"], F.lit(letters)).alias("audit"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _inserted(v: Column) -> Column:
    """The four states after any useful insertions: the next role is settled by the state, and two insertions reach all that can be."""
    s = [F.get(v, F.lit(i)) for i in STATES]
    user = F.least(s[2], *[_plus(s[i], INSERT, "I") for i in (0, 1, 3)])
    assistant = F.least(s[3], _plus(s[2], INSERT, "I"), *[_plus(s[i], 2 * INSERT, "II") for i in (0, 1)])
    return F.array(s[0], s[1], user, assistant)


def _step(v: Column, turn: Column) -> Column:
    """One turn: deleted, kept where its role comes next, or given the role that comes next."""
    stays, extra = ~turn["must_go"], F.when(turn["truncated"], TRUNCATED).otherwise(0)

    def edited(s: Column) -> Column:
        c = [F.get(s, F.lit(i)) for i in STATES]
        before = {1: c[0], 2: F.least(c[0], c[1], c[3]), 3: c[2]}  # the cheapest state from which a role leads to the key's state
        out = [_plus(c[0], DELETE, "D")]
        for k, initial in ((1, "s"), (2, "u"), (3, "a")):
            # keeping a turn is never dearer than giving it another role
            named = F.when(turn["initial"] == initial, _plus(before[k], extra, "K"))
            out.append(F.least(_plus(c[k], DELETE, "D"), F.when(stays, named if k == 1 else named.otherwise(_plus(before[k], extra + RE_ROLE, "R")))))
        return F.array(*out)

    return _let(_inserted(v), edited)


def _unit(start: int, mark: str = "") -> Column:
    """Cost 0 in one state, the others out of reach."""
    return F.array(*[F.struct(F.lit(0 if k == start else FAR).cast("long").alias("cost"), F.lit(mark).alias("audit")) for k in STATES])


def _fold(turns: Column, first: Column) -> Column:
    """Rows of the block's matrix: from the empty state where it is a conversation's first block, else from all states."""
    starts = [_unit(k, str(k)) for k in STATES]
    return F.transform(F.when(first, F.array(starts[0])).otherwise(F.array(*starts)), lambda v: F.aggregate(turns, v, _step))


def _times(v: Column, m: Column) -> Column:
    def through(i: int, j: int) -> Column:
        a, b = F.get(v, F.lit(i)), F.get(F.get(m, F.lit(i)), F.lit(j))
        return F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"))

    return F.array(*[F.least(*[through(i, j) for i in STATES]) for j in STATES])


def _product(blocks: Column) -> Column:
    """The matrix of consecutive blocks, with as many rows as the first one has."""
    rest = F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))
    return F.transform(F.get(blocks, F.lit(0))["m"], lambda v: F.aggregate(rest, v, lambda acc, x: _times(acc, x["m"])))


_LEGAL = ("su", "ua", "au")


def _illegal(left: Column, right: Column) -> Column:
    return F.when(F.concat(left, right).isin(*_LEGAL), 0).otherwise(1).cast("long")


class Repaired(NamedTuple):
    #: One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    report: DataFrame
    #: Blocks of repaired turns: ``key`` (the conversation), ``block`` (their order), ``turns`` (array of role and text).
    blocks: DataFrame


def flagged(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """Turns with their place and their first fault: ``blank``, ``duplicate``, ``truncated`` or none."""
    text, role = F.coalesce(ref(text_col).cast("string"), F.lit(" ")), F.coalesce(ref(role_col).cast("string"), F.lit(" "))
    rows = turns.select(F.coalesce(ref(conv_col).cast("string"), F.lit(" ")).alias("key"), ref(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("same", F.xxhash64("role", "text"))
    by = [F.col("key").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("same").asc(), F.col("text").asc()]
    return ranged(rows, by, "turns", scratch=scratch)


def repair(turns: DataFrame, scratch: Scratch | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """Faults of conversations and the cheapest edits that mend them.

    A turn's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the
    conversation), truncated (its last character beside white space is none of ``.!?``).  Edits: keep (K, 0),
    give the role that comes next (R, 1), delete (D, 2; the only one for blank and duplicate turns), insert an empty
    turn (I, 5); truncated turns that stay cost 5 more.  ``audit`` has the edits' letters in order, of the
    cheapest repairs the one that sorts first; initials of roles then match ``(s?(ua)+)?``.

    Turns go in order of their number, nulls first, ties by role and a hash of role and text; null roles and texts are one
    space, null conversation ids are one conversation.  ``gaps`` are missing numbers between the least and the
    greatest (0 where all are null), ``illegal`` counts neighbours other than system-user, user-assistant and
    assistant-user.  Repeated rows are duplicates, very long texts are read whole, other columns are ignored
    whatever their names, an empty table gives an empty table.
    """
    scratch = scratch or Scratch(turns.sparkSession)
    placed = flagged(turns, conv_col, turn_col, role_col, text_col, scratch)
    # the window's rows carry no texts but for those of equal hash, role and conversation
    seen = Window.partitionBy("key", "same", "role", "digest").orderBy(PART, POS)
    light = placed.select("key", "turn", "role", "same", PART, POS, F.sha2("text", 256).alias("digest"), (~F.col("text").rlike(INK)).alias("blank"), (~F.rtrim(F.translate("text", "\t\n\x0b\f\r", "     ")).rlike(r"[.!?]\z")).alias("open"))
    light = light.withColumn("again", F.row_number().over(seen) > 1)
    light = light.select("key", "turn", PART, POS, F.substring("role", 1, 1).alias("initial"), "blank", (~F.col("blank") & F.col("again")).alias("duplicate"), (~F.col("blank") & ~F.col("again") & F.col("open")).alias("truncated"))
    light = scratch.keep(light, "flags")

    firsts = light.groupBy("key").agg(F.min(F.struct(PART, (F.shiftright(POS, BITS)).alias("b"))).alias("first"))
    block = F.struct(F.col(PART), F.shiftright(POS, BITS).alias("b"))
    folded = light.groupBy("key", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(POS, "initial", (F.col("blank") | F.col("duplicate")).alias("must_go"), "truncated"))).alias("turns"),
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    inside = F.aggregate(F.sequence(F.lit(1), F.size("turns") - 1), F.lit(0).cast("long"), lambda n, i: n + _illegal(F.get("turns", i - 1)["initial"], F.get("turns", i)["initial"]))
    folded = folded.join(firsts, "key").select(
        "key", "block", "blank", "duplicate", "truncated", F.when(F.size("turns") > 1, inside).otherwise(F.lit(0).cast("long")).alias("illegal"),
        F.get("turns", F.lit(0))["initial"].alias("begins"), F.element_at("turns", -1)["initial"].alias("ends"), (F.col("block") == F.col("first")).alias("is_first"),
        _fold(F.col("turns"), F.col("block") == F.col("first")).alias("m"), F.array("block").alias("blocks"),
    )
    folded = scratch.keep(folded, "blocks")
    # larger blocks, BLOCK at a time, until each conversation is one: first those of a range, then ranges
    most = folded.agg(F.max(F.col("block")["b"]).alias("b"), F.max(F.col("block")[PART]).alias("p")).first()
    place = F.col("block")
    steps = [F.struct(place[PART].alias(PART), F.shiftright(place["b"], BITS).alias("b"))] * -(-(most["b"] or 0).bit_length() // BITS)
    steps += [F.struct(F.shiftright(place[PART], BITS).alias(PART), F.lit(0).cast("long").alias("b"))] * -(-(most["p"] or 0).bit_length() // BITS)
    for to in steps:
        parts = F.array_sort(F.collect_list(F.struct("block", "m", "is_first", "begins", "ends", "blocks")))
        folded = folded.groupBy("key", to.alias("to")).agg(parts.alias("parts"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
        between = F.aggregate(F.sequence(F.lit(1), F.size("parts") - 1), F.lit(0).cast("long"), lambda n, i: n + _illegal(F.get("parts", i - 1)["ends"], F.get("parts", i)["begins"]))
        first = F.get("parts", F.lit(0))["is_first"]
        folded = folded.select(
            "key", F.col("to").alias("block"), "blank", "duplicate", "truncated", (F.col("illegal") + F.when(F.size("parts") > 1, between).otherwise(0)).alias("illegal"),
            F.get("parts", F.lit(0))["begins"].alias("begins"), F.element_at("parts", -1)["ends"].alias("ends"), first.alias("is_first"),
            _product(F.col("parts")).alias("m"), F.flatten(F.transform("parts", lambda x: x["blocks"])).alias("blocks"),
        )
    best = folded.withColumn("best", _let(_inserted(F.get("m", F.lit(0))), lambda end: F.least(F.get(end, F.lit(0)), F.get(end, F.lit(3)))))
    best = scratch.keep(best.select("key", "blank", "duplicate", "truncated", "illegal", "best", "blocks"), "repairs")

    known = turns.select(ref(conv_col).alias("conv_id"), F.coalesce(ref(conv_col).cast("string"), F.lit(" ")).alias("key")).groupBy("conv_id", "key").agg(F.lit(1).alias("one")).drop("one")
    numbers = light.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    counted = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")]
    report = known.join(best, "key", "left").join(numbers, "key", "left")
    report = report.select("key", "conv_id", *counted, F.coalesce(F.col("best")["cost"], F.lit(0)).cast("long").alias("cost"), F.coalesce(F.regexp_replace(F.col("best")["audit"], "[0-3]", ""), F.lit("")).alias("audit"))
    return Repaired(report, _rebuilt(placed, best))


def _rebuilt(placed: DataFrame, best: DataFrame) -> DataFrame:
    """The edits applied: each block's letters, from the state it begins in, over its turns."""
    pieces = F.arrays_zip(F.col("blocks").alias("block"), F.regexp_extract_all(F.col("best")["audit"], F.lit("[0-3][DIKR]*"), F.lit(0)).alias("piece"))
    edits = best.select("key", F.explode(pieces).alias("e")).select("key", "e.block", "e.piece")
    texts = placed.groupBy("key", F.struct(F.col(PART), F.shiftright(POS, BITS).alias("b")).alias("block")).agg(F.array_sort(F.collect_list(F.struct(POS, "role", "text"))).alias("turns"))
    both = texts.join(edits, ["key", "block"])
    turn = "array<struct<role:string,text:string>>"
    zero = F.struct(F.substring("piece", 1, 1).cast("int").alias("state"), F.lit(0).alias("at"), F.array().cast(turn).alias("out"))

    def apply(acc: Column, letter: Column) -> Column:
        own = F.get("turns", acc["at"])
        role = F.when(acc["state"] == 2, "assistant").otherwise("user")
        said = F.when(letter == "K", own["role"]).otherwise(role)
        made = F.struct(said.alias("role"), F.when(letter == "I", "").otherwise(own["text"]).alias("text"))
        state = F.when(letter == "D", acc["state"]).otherwise(_state_after(said))
        return F.struct(state.cast("int").alias("state"), (acc["at"] + F.when(letter == "I", 0).otherwise(1)).alias("at"), F.when(letter == "D", acc["out"]).otherwise(F.array_append(acc["out"], made)).alias("out"))

    letters = F.filter(F.split(F.substring("piece", 2, 1 << 30), ""), lambda x: x != "")
    return both.select("key", "block", F.aggregate(letters, zero, apply, lambda acc: acc["out"]).alias("turns"))


def _state_after(role: Column) -> Column:
    return F.when(role.startswith("s"), 1).when(role.startswith("u"), 2).otherwise(3)


def repaired_turns(blocks: DataFrame) -> DataFrame:
    """Blocks -> one row a turn: key, block, place, role, text."""
    return blocks.select("key", "block", F.posexplode("turns").alias("place", "t")).select("key", "block", "place", "t.role", "t.text")


def digests(blocks: DataFrame) -> DataFrame:
    """(key, repaired_sha256): SHA-256 of ``role:text``, joined by newlines.

    The hash has to see a conversation's whole text in order, so here, and only here, a conversation's repaired text is one value.
    """
    lines = F.when(F.size("turns") > 0, F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"))
    joined = blocks.select("key", "block", lines.alias("text")).where("text is not null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("all"))
    return joined.select("key", F.sha2(F.array_join(F.transform("all", lambda x: x["text"]), "\n"), 256).alias("repaired_sha256"))


#: What ``damaged`` does to a turn by the checksum of its key, modulo 20.
DROP, EMPTY, UNPUNCTUATE, REPEAT, TO_USER = range(5)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns with faults planted by crc32 of ``conv_id:turn`` modulo 20; a null is one space.

    0 drops a turn, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes its role user.  Repeated rows fare
    alike; columns other than the four are left out; an empty table stays empty.
    """
    space = lambda c: F.coalesce(ref(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20).cast("int")
    rows = turns.select(ref(conv_col).alias("conv_id"), ref(turn_col).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == EMPTY, "").when(F.col("kind") == UNPUNCTUATE, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == TO_USER, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == DROP, 0).when(F.col("kind") == REPEAT, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
