"""Best-fit packing by minimum bin slack.

A sequence takes the longest piece left, then the combination of available lengths that
fills the rest best, found by a bitset subset-sum over lengths.  Pieces of one length
are alike, so the same combination is removed as often as the counts allow: the whole
packing follows from the histogram of lengths (as many rows as a sequence has tokens, at
most), whatever the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .memory import small_batches, tidy
from .storage import materialise, ref
from .tokens import CACHED, encoder

#: Rows aimed at in a group that is ranked in one task.
ROWS = 1000


@dataclass
class Pattern:
    """``times`` sequences, each with the given (length, count) in order."""

    times: int
    uses: list[tuple[int, int]]


def fullest(room: int, counts: dict[int, int], lengths: list[int]) -> list[tuple[int, int]]:
    """Counts by length, within those available, with the largest sum that is at most ``room``.

    Bit s of a mask says that sum s can be reached; lengths come in falling order and
    the search ends as soon as the room can be filled.
    """
    mask, full, goal = 1, (1 << (room + 1)) - 1, 1 << room
    steps: list[tuple[int, int, int]] = []
    for length in lengths:
        if length > room:
            continue
        left, many = min(counts[length], room // length), 1
        while left:
            many = min(many, left)
            steps.append((length, many, mask))
            mask |= mask << (length * many) & full
            left -= many
            many *= 2
            if mask & goal:
                break
        if mask & goal:
            break
    total, used = mask.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + many
            total -= length * many
    return sorted(used.items(), reverse=True)


def pack_lengths(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use every piece of a histogram exactly once."""
    counts = {k: v for k, v in counts.items() if v}
    patterns = []
    while counts:
        lengths = sorted(counts, reverse=True)
        longest = lengths[0]
        counts[longest] -= 1
        rest = fullest(capacity - longest, counts, lengths)
        counts[longest] += 1
        uses = {longest: 1}
        for length, many in rest:
            uses[length] = uses.get(length, 0) + many
        times = min(counts[length] // many for length, many in uses.items())
        patterns.append(Pattern(times, sorted(uses.items(), reverse=True)))
        for length, many in uses.items():
            counts[length] -= times * many
            if not counts[length]:
                del counts[length]
    return patterns


def slots(patterns: list[Pattern]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first slot, pieces of it in a sequence, first sequence, offset of the first) of each pattern that uses it."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    filled: dict[int, int] = {}
    sequence = 0
    for pattern in patterns:
        offset = 0
        for length, many in pattern.uses:
            out.setdefault(length, []).append((filled.get(length, 0), many, sequence, offset))
            filled[length] = filled.get(length, 0) + many * pattern.times
            offset += many * length
        sequence += pattern.times
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(vocabulary: str, end_id: int, capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                first = total % capacity or capacity
                start, piece = 0, 0
                while start < total:
                    stop = min(total, start + (first if not start else capacity))
                    for column, value in zip(out, (doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))):
                        column.append(value)
                    start, piece = stop, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(out)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return tidy(run, CACHED)


def _place(patterns: list[Pattern]) -> Callable:
    """(length, slot, ...) -> its sequence and offset, by binary search in the pattern table."""
    table = slots(patterns)
    rows = sorted((length, *row) for length, found in table.items() for row in found)
    edge = np.array([(r[0] << 44) + r[1] for r in rows], np.int64)
    first, many, sequence, offset = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3, 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, slot = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(edge, (length << 44) + slot, "right") - 1
            within = slot - first[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + within // many[at]), pa.array(offset[at] + within % many[at] * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Rows of ``docs`` -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Each text (null: empty) is encoded, ``end_id`` is appended, and documents longer than
    ``capacity`` are cut into pieces of that length, of which the first may be shorter.
    Pieces are packed into sequences without gaps.  Repeated rows are pieces of their
    own; null ids stay null; an empty table gives an empty table; other columns are
    ignored, whatever their names.  The pattern table has a few rows for each length at
    most; pieces of one length are ranked in as many groups as their number needs.
    """
    texts = docs.select(ref(id_col).cast("long").alias("doc_id"), ref(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    small_batches(spark)
    pieces = materialise(texts.mapInArrow(_pieces(vocabulary, end_id, capacity), PIECES), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    patterns = pack_lengths(histogram, capacity)
    salts = spark.createDataFrame([(length, -(-count // ROWS)) for length, count in histogram.items()], "length long, salts int")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")).cast("int")).drop("salts")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within).cast("long") - 1)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    slotted = ranked.join(starts, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("slot"))
    return slotted.mapInArrow(tidy(_place(patterns)), PIECES + ", sequence_id long, offset long")
