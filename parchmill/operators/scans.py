"""Rows dealt by ranges of (key, order), so that one hot key is worked on by many tasks.

An operator over a key's ordered rows works on each range alone, is left with one carry for each
(range, key), scans the carries in the order of the ranges, and adds them to the rows.  No task
holds more than a range, whatever share of all rows a key has.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..storage import Scratch

#: Names that the ranges add: the range, and a row's place in it.
PART, POS = "__pm_part", "__pm_pos"


def ranged(rows: DataFrame, by: list[Column], name: str, partitions: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """A table of the rows with ``__pm_part`` and ``__pm_pos``, both from 0: (part, pos) sorts as ``by`` does.

    Bounds of the ranges come from Spark's sample of the rows.  Rows equal in all of ``by`` share
    a range.  The table is written, so that places stay when a later task is computed again.
    An empty table gives an empty table.
    """
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    # the generated id is the range's number in the upper bits, the row's place in the lower 33
    placed = dealt.sortWithinPartitions(*by).withColumn("__pm_place", F.monotonically_increasing_id())
    placed = placed.withColumn(PART, F.shiftright("__pm_place", 33).cast("int")).withColumn(POS, F.col("__pm_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__pm_place")
    return (scratch or Scratch(rows.sparkSession)).keep(placed, name)


class Ranges:
    """A log in ranges of (key, order): what is done in a range, and what comes over from the ranges before it.

    ``inside`` is the window of a key's rows in one range, in order.  ``carried`` sums each (range, key) up to
    one row, scans those rows in the order of the ranges and joins the result back: what a key brings into a range.
    """

    def __init__(self, rows: DataFrame, key: str, order: list[str], partitions: int | None = None, scratch: Scratch | None = None):
        self.key, self.columns = key, rows.columns
        self.rows = ranged(rows, [F.col(c) for c in (key, *order)], "ranges", partitions, scratch)
        self.inside = Window.partitionBy(PART, key).orderBy(POS)
        self.so_far = self.inside.rowsBetween(Window.unboundedPreceding, 0)

    def carried(self, rows: DataFrame, sums: list[Column], scan: Callable[[WindowSpec, WindowSpec], list[Column]]) -> DataFrame:
        """``rows`` plus the columns of ``scan``, which gets the windows of a key's ranges up to one's own, and before it."""
        summary = rows.groupBy(PART, self.key).agg(*sums)
        w = Window.partitionBy(self.key).orderBy(PART)
        carry = summary.select(F.col(PART).alias("__part"), F.col(self.key).alias("__key"), *scan(w, w.rowsBetween(Window.unboundedPreceding, -1)))
        return rows.join(carry, (F.col(PART) == F.col("__part")) & F.col(self.key).eqNullSafe(F.col("__key")), "left").drop("__part", "__key")

    def done(self, rows: DataFrame, *added: str) -> DataFrame:
        return rows.select(*[c for c in self.columns if c not in added], *added)


def rate_slots(calls: DataFrame, key: str, order: list[str], at: str, interval: int, partitions: int | None = None) -> DataFrame:
    """:func:`jobs.rate_slots` of keys of any size: a range brings its number of calls and its largest call less its place."""
    r = Ranges(calls, key, order, partitions)
    rows = r.rows.withColumn("__i", F.row_number().over(r.inside).cast("long")).withColumn("__lag", F.col(at) - F.col("__i") * interval)
    rows = rows.withColumn("__m", F.max("__lag").over(r.so_far))
    rows = r.carried(rows, [F.count("*").alias("n")], lambda w, before: [F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n")])
    # places are numbered over all ranges, so what a range brings is less by the calls before it
    rows = rows.withColumn("__all", F.col("__m") - F.col("__n") * interval)
    rows = r.carried(rows, [F.max("__all").alias("a")], lambda w, before: [F.max("a").over(before).alias("__a")])
    slot = (F.col("__i") + F.col("__n")) * interval + F.greatest("__all", "__a")
    return r.done(rows.withColumn("slot", slot), "slot")


def cooldowns(calls: DataFrame, key: str, order: list[str], at: str, outcome: str, retry_after: str, base: float = 15.0, most: float = 120.0, partitions: int | None = None) -> DataFrame:
    """:func:`jobs.cooldowns` of keys of any size: a range brings the refusals since its last success, and its latest deadline."""
    r = Ranges(calls, key, order, partitions)
    refused, won = F.when(F.col(outcome) == "refused", 1).otherwise(0), F.when(F.col(outcome) == "success", 1).otherwise(0)
    rows = r.rows.withColumn("__s", F.sum(won).over(r.so_far))
    rows = rows.withColumn("__k", F.sum(refused).over(Window.partitionBy(PART, key, "__s").orderBy(POS)))

    # ranges with a success cut a key's ranges into islands, in which the refusals at their ends add up
    summary = rows.groupBy(PART, key).agg(F.sum(won).alias("wins"), F.coalesce(F.max_by("__k", F.col(POS)), F.lit(0)).alias("tail"))
    w = Window.partitionBy(key).orderBy(PART)
    summary = summary.withColumn("__island", F.sum(F.when(F.col("wins") > 0, 1).otherwise(0)).over(w))
    summary = summary.withColumn("__after", F.sum("tail").over(Window.partitionBy(key, "__island").orderBy(PART)))
    carry = summary.select(F.col(PART).alias("__part"), F.col(key).alias("__key"), F.coalesce(F.lag("__after").over(w), F.lit(0)).alias("__in"))
    rows = rows.join(carry, (F.col(PART) == F.col("__part")) & F.col(key).eqNullSafe(F.col("__key"))).drop("__part", "__key")
    k = F.least(F.col("__k") + F.when(F.col("__s") == 0, F.col("__in")).otherwise(0), F.lit(40))
    penalty = F.least(F.lit(base) * F.pow(F.lit(2.0), k - 1), F.lit(most))
    wait = F.when(F.col(outcome) == "refused", F.least(F.coalesce(F.when(F.col(retry_after) > 0, F.col(retry_after).cast("double")), penalty), F.lit(most)))
    rows = rows.withColumn("cooldown", wait).withColumn("__d", F.max(F.col(at) + F.col("cooldown")).over(r.so_far))
    rows = r.carried(rows, [F.max("__d").alias("d")], lambda w, before: [F.max("d").over(before).alias("__before")])
    return r.done(rows.withColumn("deadline", F.greatest("__d", "__before")), "cooldown", "deadline")


def stalls(beats: DataFrame, key: str, order: list[str], at: str, seconds: float, partitions: int | None = None) -> DataFrame:
    """:func:`jobs.stalls` of keys of any size: a range brings its last beat."""
    r = Ranges(beats, key, order, partitions)
    rows = r.carried(r.rows, [F.max_by(at, F.col(POS)).alias("last")], lambda w, before: [F.lag("last").over(w).alias("__last")])
    first = F.row_number().over(r.inside) == 1
    rows = rows.withColumn("stalled_at", F.when(first, F.col("__last")).otherwise(F.lag(at).over(r.inside))).withColumn("idle", F.col(at) - F.col("stalled_at"))
    return rows.where(F.col("idle") >= seconds).select(key, "stalled_at", F.col(at).alias("resumed_at"), "idle")


def changes(rows: DataFrame, key: str, order: list[str], payload: str, status: str | None = None, terminal: tuple[str, ...] = (), most: int = 1800, partitions: int | None = None) -> DataFrame:
    """:func:`jobs.changes` of keys of any size: a range brings its last payload, its number of rows and whether it had a terminal status."""
    r = Ranges(rows, key, order, partitions)
    over = F.coalesce(F.col(status).isin(*terminal), F.lit(False)).cast("int") if status else F.lit(0)
    out = r.rows.withColumn("__over", over)
    sums = [F.count("*").alias("n"), F.max_by(F.struct(F.col(payload).alias("p")), F.col(POS)).alias("last"), F.max("__over").alias("over")]
    out = r.carried(out, sums, lambda w, before: [F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"), F.lag("last").over(w).alias("__last"), F.coalesce(F.max("over").over(before), F.lit(0)).alias("__ended")])
    place = F.row_number().over(r.inside)
    out = out.withColumn("__i", place + F.col("__n")).withColumn("__b", F.when(place == 1, F.col("__last")).otherwise(F.struct(F.lag(payload).over(r.inside).alias("p"))))
    out = out.withColumn("__e", F.greatest("__ended", F.coalesce(F.max("__over").over(r.inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    new = (F.col("__i") == 1) | ~F.col(payload).eqNullSafe(F.col("__b")["p"])
    return r.done(out.where((F.col("__e") == 0) & (F.col("__i") <= most) & new))


def frozen(rows: DataFrame, key: str, order: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """:func:`jobs.frozen` of keys of any size (one order column or more): a range brings its last known value."""
    r = Ranges(rows, key, order, partitions)
    out = r.rows.withColumn("__v", F.last(value, ignorenulls=True).over(r.so_far))
    out = r.carried(out, [F.max_by("__v", F.col(POS)).alias("v")], lambda w, before: [F.last("v", ignorenulls=True).over(before).alias("__before")])
    return r.done(out.withColumn(value, F.coalesce("__v", "__before")), value)


def _place() -> Column:
    """Range and place in one number, which sorts as the log does."""
    return F.shiftleft(F.col(PART).cast("long"), 33) + F.col(POS)


def _last_hops(places: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Where a chain that is at each place of a block leaves it; -1 where it ends in the block.  Targets come after their places."""
    inside = (targets >= 0) & (targets <= places[-1])
    nearest, out = np.searchsorted(places, targets).tolist(), targets.tolist()
    for i in np.flatnonzero(inside)[::-1].tolist():
        out[i] = out[nearest[i]]
    return np.array(out, np.int64)


def _on_chain(places: np.ndarray, targets: np.ndarray, entered: np.ndarray) -> np.ndarray:
    """The places of a block that chains from the entered ones visit."""
    inside = ((targets >= 0) & (targets <= places[-1])).tolist()
    nearest, out = np.searchsorted(places, targets).tolist(), entered.tolist()
    for i, on in enumerate(out):
        if on and inside[i]:
            out[nearest[i]] = True
    return places[np.array(out, bool)]


def upload_quota(uploads: DataFrame, key: str, order: list[str], at: str, window: int = 3600, most: int = 20, partitions: int | None = None, block_bits: int = 16) -> DataFrame:
    """:func:`jobs.upload_quota` of keys of any size, by jump pointers instead of a fold over a key.

    Each upload points to the first one that could open the next window after it (``order`` begins with the time).
    The uploads that do open one are those on the chain from a key's first.  Blocks of ``2 ** block_bits`` places
    follow the pointers within them, each in one pass.  Between blocks only the places matter at which a chain could
    enter one; among these, pointers are doubled until the chain is whole, so b blocks take log b rounds of joins.
    A second pass over the blocks marks what the chain visits.  An upload is allowed by its distance from the
    opening before it, which ranges carry over.
    """
    scratch = Scratch(uploads.sparkSession)
    r = Ranges(uploads, key, order, partitions, scratch)
    # probes (a time at which a window has ended) among uploads: the next upload, in this range or a later one
    probes = r.rows.select(key, (F.col(at) + window).alias("t"), F.lit(0).alias("kind"), _place().alias("place"))
    marks = probes.unionByName(r.rows.select(key, F.col(at).alias("t"), F.lit(1).alias("kind"), _place().alias("place")))
    m = Ranges(marks, key, ["t", "kind", "place"], partitions, scratch)
    # from the end of a range backwards: a frame up to the end of a window is read anew for each row
    backwards = Window.partitionBy(PART, key).orderBy(F.desc(POS)).rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.last(F.when(F.col("kind") == 1, F.col("place")), ignorenulls=True).over(backwards)
    later = lambda w, before: [F.first("p", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__later")]
    met = m.carried(m.rows, [F.min(F.when(F.col("kind") == 1, F.col("place"))).alias("p")], later)
    target = F.coalesce(ahead, F.col("__later"), F.lit(-1))
    jump = scratch.keep(met.withColumn("to", target).where("kind = 0").select("place", "to"), "jumps")

    def left(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        return pd.DataFrame({"place": rows["place"], "to": _last_hops(rows["place"].to_numpy(), rows["to"].to_numpy())})

    def visited(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        return pd.DataFrame({"place": _on_chain(rows["place"].to_numpy(), rows["to"].to_numpy(), rows["entered"].to_numpy())})

    block = F.shiftright("place", block_bits).alias("block")
    hop = scratch.keep(jump.groupBy(block).applyInPandas(left, "place long, to long").where("to >= 0"), "hops")
    chain = scratch.keep(r.rows.groupBy(key).agg(F.min(_place()).alias("place")).select("place"), "chain")
    hop = scratch.keep(hop.join(chain.unionByName(hop.select(F.col("to").alias("place"))).distinct(), "place"), "hops")
    size = chain.count()
    while True:
        chain = scratch.keep(chain.unionByName(chain.join(hop, "place").select(F.col("to").alias("place"))).distinct(), "chain")
        if (now := chain.count()) == size:
            break
        size = now
        hop = scratch.keep(hop.join(hop.select(F.col("place").alias("to"), F.col("to").alias("far")), "to").select("place", F.col("far").alias("to")), "hops")
    entered = jump.join(chain.withColumn("entered", F.lit(True)), "place", "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    opens = scratch.keep(entered.groupBy(block).applyInPandas(visited, "place long"), "opens").withColumn("__opens", F.lit(True))
    rows = r.rows.withColumn("place", _place()).join(opens, "place", "left").withColumn("__i", F.row_number().over(r.inside))
    rows = r.carried(rows, [F.count("*").alias("n")], lambda w, before: [F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n")])
    rows = rows.withColumn("__i", F.col("__i") + F.col("__n")).withColumn("__o", F.max(F.when(F.col("__opens"), F.col("__i"))).over(r.so_far))
    rows = r.carried(rows, [F.max("__o").alias("o")], lambda w, before: [F.max("o").over(before).alias("__before")])
    return r.done(rows.withColumn("allowed", F.col("__i") - F.coalesce("__o", "__before") < most), "allowed")
