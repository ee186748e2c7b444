"""Exact Jaccard self-join of shingle sets in the metric space of the Jaccard distance.

The distance 1 - J is a metric.  Almost all texts lie at distance 1 from any other
text, where the triangle inequality separates nothing, so a global order of shingles
(rarest first) first finds the texts that can be near at all: two sets within the
threshold share a shingle among the first ``n - ceil(t * n) + 1`` of each.  Each shared
leading shingle elects a *pivot*, the member with the smallest code (codes begin with the
share of unique shingles, so that is a most central copy), and a text enters the
region of every pivot that its leading shingles elect.  Any two linked texts thereby
meet in a region.  A region is joined by rounds:

1. The distances of all members to the region's pivots (one at first, ``PIVOTS``
   later) are computed; the sets within ``r = 1 - threshold`` of a pivot are linked to it.
   With that the pivots are done and leave the region.
2. Each set goes to the Voronoi cell of its nearest pivot, and by the triangle inequality
   also to the cell of every pivot p with d(x, p) <= d(x, nearest) + 2r: a set within r
   of x that is at home there is no farther than that.
3. The sets that are linked to the first pivot are one component, the *core* of the
   region, and need no comparison among themselves.  A cell is done when it has no set
   outside the core; else it keeps those sets, and of the core those whose distance
   to the pivot is within r of one of them.  Where windows put most sets into many cells, the
   region stays whole.
4. A cell of few rows and bytes is compared in one task, set by set against those
   outside the core; a larger one is the next round's region.  Where a round doesn't
   make the regions smaller, the sets outside the core are dealt out in blocks, and
   each block meets all members, which are dealt out likewise.

Before that a *sieve* leaves out sets that can't be linked, at any size of the table: of half
of all hashes, those that occur in one set only are counted exactly, by ranges, and a set
of which so many are its own that no other can share enough is done.  What it leaves is a
bitmap of fixed size over keys of sets; the order of shingles is made of those sets only.

Rows of a region are dealt over salts by its size, with the pivots' sets repeated in each, so
no region, however hot, is one task.  Sets are held as 48-bit hashes and named by keys
of 128 bits.  The order of shingles comes from counts over the sets left, kept in tables of
fixed size (a bitmap for "in two texts or more", the most frequent values of each range):
it only steers the work, and any order gives the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .memory import small_batches, tidy
from .storage import Scratch, boxed, ref, unboxed
from .words import mix, row_sums, shingle_sets, text_chunks, words

U = np.uint64
#: Ranges of 24 more bits each in which the sieve looks for shingles of one set, sets of a chunk at most (those of a batch beside), and what stands for several sets.
SIEVED, CHUNK_SETS, SEVERAL = 4096, 60_000, 0xFFFF
#: Sets whose counts a task of the sieve holds (4 bytes each).
SUMMED = 1 << 22
#: Bits of a key that place it in the bitmap of the sets left: 2**26 bits, 8 MB, in rows of 2**15.
PLACE_BITS, ROW_BITS = 26, 15
#: Ranges of the 32 high bits of a shingle in which occurrences are counted.
PARTS, PART_BITS = 1024, 22
#: Adjacent counted values that share a bit of the bitmap, as a power of two: 2**27 bits, 16 MB.
FOLD = 5
#: A value in more texts than this is frequent; of each range the most frequent values are told apart.
FREQUENT, TOLD = 16, 512
#: Shingles collected in a task before their counts are sent.
FLUSH = 2_000_000
#: Keys that a task remembers, to send the set of a copy once.
REMEMBERED = 200_000
#: Rows and bytes of sets up to which a region is compared in one task; also the size of blocks and salts.
ROWS, BYTES = 1000, 1 << 22
#: Rows up to which the decisions on documents are broadcast (about 40 bytes each).
BROADCAST_ROWS = 200_000
#: Pivots of a region from the second round on, and copies of a set in their cells from which on a region isn't cut.
PIVOTS, REPEATED = 8, 2
#: Values looked up at a time when members meet pivots.
LOOKUPS = 1 << 20


def pack_set(shingles: np.ndarray) -> bytes:
    """The 48 high bits of sorted hashes, 6 bytes each."""
    return (shingles >> U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_set(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def set_keys(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A key of 16 bytes for each set, as two numbers."""
    n = np.diff(bounds).astype(U) << U(40)
    return np.stack([mix(row_sums(mix(shingles ^ U(salt)), bounds) ^ n) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1)


def binary_keys(keys: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys.astype("<u8")).tobytes())]).cast(pa.binary())


def _least_leading(n: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Leading shingles of sets of ``n``: as many as any linked set must share one of."""
    num, den = threshold.numerator, threshold.denominator
    return n - (num * n + den - 1) // den + 1


def _sieve_blobs(width: int, threshold: Fraction) -> Callable:
    """Text -> (range, chunk, sets in the chunk, 24 bits and the set's number of each sorted value), and beyond the ranges a row with place and least number of leading shingles of each set.

    A chunk has some distinct sets of a task and is named by all their keys.  A value that is
    in several of them is sent once.  Only hashes with a high bit of 0 are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        heads: list[np.ndarray] = []
        seen: set[int] = set()
        name = hashlib.blake2b(digest_size=8)

        def flush() -> pa.RecordBatch:
            nonlocal name
            chunk, docs = int.from_bytes(name.digest(), "little", signed=True), sum(map(len, heads))
            every, head = np.concatenate(held), np.concatenate(heads).astype("<u4").tobytes()
            for x in (held, heads, seen):
                x.clear()
            name = hashlib.blake2b(digest_size=8)
            every.sort()
            values = every >> U(16)
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
            several = np.diff(np.append(first, len(values))) > 1
            values, owners = values[first], np.where(several, U(SEVERAL), every[first] & U(0xFFFF))
            packed = np.empty((len(values), 5), np.uint8)
            packed[:, :3] = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3]
            packed[:, 3:] = owners.astype("<u2").view(np.uint8).reshape(-1, 2)
            edges = np.searchsorted(values, np.arange(SIEVED + 1, dtype=U) << U(24))
            parts = [p for p in range(SIEVED) if edges[p + 1] > edges[p]]
            blobs = [packed[edges[p] : edges[p + 1]].tobytes() for p in parts]
            parts.append(SIEVED + chunk % SIEVED)
            blobs.append(head)
            each = len(parts)
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([chunk] * each, pa.int64()), pa.array([docs] * each, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "chunk", "docs", "blob"])

        docs = size = 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                shingles, bounds = shingle_sets(words(data, offsets), width)
                n, keys = np.diff(bounds), set_keys(shingles, bounds)
                new = np.array([many > 0 and not (k in seen or seen.add(k)) for k, many in zip(keys[:, 0].tolist(), n.tolist())], bool)
                own = shingles[np.repeat(new, n)]
                owners = np.repeat(np.arange(docs, docs + new.sum()).astype(U), n[new])
                half = own < U(1 << 63)
                held.append(((own[half] << U(1)) >> U(28)) << U(16) | owners[half])
                heads.append(np.stack([places(keys[new]), _least_leading(n[new], threshold)], axis=1))
                name.update(keys[new].tobytes())
                docs += int(new.sum())
                size += len(held[-1])
                if size >= FLUSH or docs >= CHUNK_SETS:
                    yield flush()
                    docs = size = 0
        if docs:
            yield flush()

    return tidy(run)


def places(keys: np.ndarray) -> np.ndarray:
    return (keys[:, 0] >> U(64 - PLACE_BITS)).astype(np.int64)


def _sieve_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs sorted by range -> (chunk, head, how many values are each set's alone), and the rows beyond the ranges."""
    part, new = None, []
    begins: dict[int, tuple[int, int]] = {}
    counts = np.zeros(0, np.uint32)
    nobody = (1 << 40) - 1

    def alone() -> None:
        nonlocal counts
        every = []
        for chunk, docs, blob in new:
            begin, _ = begins.setdefault(chunk, (len(counts), docs))
            if begin == len(counts):
                counts = np.concatenate([counts, np.zeros(docs, np.uint32)])
            rows = np.frombuffer(blob, np.uint8).reshape(-1, 5)
            values = np.zeros((len(rows), 4), np.uint8)
            values[:, :3] = rows[:, :3]
            owners = np.ascontiguousarray(rows[:, 3:]).view("<u2").ravel().astype(U)
            every.append(values.view("<u4").ravel().astype(U) << U(40) | np.where(owners == SEVERAL, U(nobody), owners + U(begin)))
        new.clear()
        if not every:
            return
        found = np.concatenate(every)
        found.sort()
        change = np.concatenate([[True], (found[1:] ^ found[:-1]) >> U(40) != 0, [True]])
        own = found[change[1:] & change[:-1]] & U(nobody)
        np.add.at(counts, own[own != U(nobody)].astype(np.int64), np.uint32(1))

    def done() -> pa.RecordBatch:
        nonlocal counts
        blobs = [np.minimum(counts[a : a + docs], 0xFFFF).astype("<u2").tobytes() for a, docs in begins.values()]
        out = pa.RecordBatch.from_arrays([pa.array(list(begins), pa.int64()), pa.array([False] * len(blobs), pa.bool_()), pa.array(blobs, pa.binary())], names=["chunk", "head", "blob"])
        begins.clear()
        counts = np.zeros(0, np.uint32)
        return out

    for batch in batches:
        heads: list[tuple] = []
        for p, chunk, docs, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if p >= SIEVED:
                heads.append((chunk, blob))
                continue
            if p != part:
                alone()
                part = p
                if len(counts) > SUMMED:
                    yield done()
            new.append((chunk, docs, blob))
        if heads:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in heads], pa.int64()), pa.array([True] * len(heads), pa.bool_()), pa.array([x for _, x in heads], pa.binary())], names=["chunk", "head", "blob"])
    alone()
    yield done()


def _sieve_left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the ranges sorted by chunk -> places of the sets that may have links."""
    name, total, least = None, 0, None

    def done() -> pa.RecordBatch:
        left = least[:, 0][total < least[:, 1]] if least is not None else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(left.astype(np.int64))], names=["place"])

    for batch in batches:
        for chunk, head, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if chunk != name:
                yield done()
                name, total, least = chunk, 0, None
            if head:
                least = np.frombuffer(blob, "<u4").reshape(-1, 2)
            else:
                total = total + np.frombuffer(blob, "<u2").astype(np.int64)
    yield done()


class Left:
    """The sets that the sieve leaves, by places of their keys; a few others have the place of one."""

    def __init__(self, rows: list):
        self.bits = np.zeros((1 << (PLACE_BITS - ROW_BITS), 1 << (ROW_BITS - 3)), np.uint8)
        for r in rows:
            self.bits[r["row"]] = np.frombuffer(r["bits"], np.uint8)
        self.bits = self.bits.ravel()

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = places(keys)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def sieve(texts: DataFrame, width: int, threshold: Fraction) -> Left:
    """Sets of the column ``text`` that may be linked to others; 2,048 rows of a bitmap come to the driver, whatever the input."""
    ranges = texts.select("text").mapInArrow(_sieve_blobs(width, threshold), "part int, chunk long, docs int, blob binary").repartition("part").sortWithinPartitions("part")
    sums = ranges.mapInArrow(_sieve_ranges, "chunk long, head boolean, blob binary").repartition("chunk").sortWithinPartitions("chunk")
    rows = sums.mapInArrow(_sieve_left, "place long").withColumn("row", F.shiftright("place", ROW_BITS).cast("int")).repartition("row")
    return Left(rows.groupBy("row").agg(F.bitmap_construct_agg(F.col("place").bitwiseAND((1 << ROW_BITS) - 1)).alias("bits")).collect())


def _count_blobs(width: int, left) -> Callable:
    """Text -> (range, counts of 64 subranges and the 16 low bits) of sorted values of the sets left, each set once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held) if held else np.zeros(0, np.uint32))
            held.clear()
            seen.clear()
            edges = np.searchsorted(values, np.arange(PARTS + 1, dtype=np.uint64) << U(PART_BITS))
            low = (values & np.uint32(0xFFFF)).astype("<u2")
            sub = np.bincount((values >> np.uint32(16)).astype(np.int64), minlength=PARTS << (PART_BITS - 16)).astype("<u4").reshape(PARTS, -1)
            parts = [p for p in range(PARTS) if edges[p + 1] > edges[p]]
            blobs = [sub[p].tobytes() + low[edges[p] : edges[p + 1]].tobytes() for p in parts]
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

        size = 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                shingles, bounds = shingle_sets(words(data, offsets), width)
                keys = set_keys(shingles, bounds)
                new = np.array([may and not (k in seen or seen.add(k)) for k, may in zip(keys[:, 0].tolist(), left.value.holds(keys).tolist())], bool)
                fresh = (shingles[np.repeat(new, np.diff(bounds))] >> U(32)).astype(np.uint32)
                held.append(fresh)
                size += len(fresh)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        yield flush()

    return run


def _count_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs sorted by range -> for each range a bitmap of values in two texts or more, and its most frequent values."""
    subs = 1 << (PART_BITS - 16)
    part, new = None, []
    values, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def fold() -> None:
        nonlocal values, counts
        if not new:
            return
        every = np.concatenate([values, *new])
        each = np.concatenate([counts, np.ones(len(every) - len(values), np.int64)])
        new.clear()
        order = np.argsort(every, kind="stable")
        every, each = every[order], each[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        values, counts = every[starts], np.add.reduceat(each, starts) if len(every) else each

    def done() -> pa.RecordBatch:
        nonlocal values, counts
        fold()
        bits = np.zeros(1 << (PART_BITS - FOLD), bool)
        bits[values[counts > 1] >> np.uint32(FOLD)] = True
        often = np.flatnonzero(counts > FREQUENT)
        often = np.sort(often[np.argsort(-counts[often], kind="stable")][:TOLD])
        row = [[part], [np.packbits(bits, bitorder="little").tobytes()], [values[often].astype("<u4").tobytes()], [np.log2(counts[often]).astype(np.uint8).tobytes()]]
        values, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *(pa.array(x, pa.binary()) for x in row[1:])], names=["part", "shared", "often", "level"])

    for batch in batches:
        for p, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if p != part:
                if part is not None:
                    yield done()
                part = p
            buffer = blob.as_buffer()
            many = np.frombuffer(buffer, "<u4", subs)
            low = np.frombuffer(buffer, "<u2", offset=4 * subs)
            new.append((np.repeat(np.arange(subs, dtype=np.uint32), many) << np.uint32(16)) | low)
            if sum(map(len, new)) > FLUSH:
                fold()
    if part is not None:
        yield done()


class ShingleOrder:
    """Level of a shingle: 0 in one text only, 1 in a few, above by the logarithm of its count.  Fixed size."""

    def __init__(self, rows: list):
        self.shared = np.zeros(PARTS << (PART_BITS - FOLD - 3), np.uint8)
        often, level = [], []
        for r in sorted(rows, key=lambda r: r["part"]):
            step = 1 << (PART_BITS - FOLD - 3)
            self.shared[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["shared"], np.uint8)
            often.append(np.frombuffer(r["often"], "<u4").astype(np.uint32) | np.uint32(r["part"] << PART_BITS))
            level.append(np.frombuffer(r["level"], np.uint8))
        self.often = np.concatenate([*often, np.zeros(0, np.uint32)])
        self.level = np.concatenate([*level, np.zeros(0, np.uint8)])

    def is_shared(self, shingles: np.ndarray) -> np.ndarray:
        bit = (shingles >> U(32 + FOLD)).astype(np.int64)
        return ((self.shared[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)

    def levels(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.often):
            return np.ones(len(shingles), np.uint8)
        value = (shingles >> U(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.often, value), len(self.often) - 1)
        return np.where(self.often[at] == value, self.level[at], 1)


DESCRIBED = "doc_id long, n long, key binary, code long, shingles binary, leading binary"


def _describe(width: int, threshold: Fraction, left, order) -> Callable:
    """(doc_id, text) -> (doc_id, n, key, code) and, where the sieve leaves a set and leading shingles are shared, the set and the leading ones.

    Copies in one task send their set once.  A code is the share of unique shingles in
    eighths of the leading ones and 60 bits of the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = order.value, set()
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                shingles, bounds = shingle_sets(words(data, offsets), width)
                n = np.diff(bounds)
                shared = table.is_shared(shingles)
                unique = row_sums((~shared).astype(np.int64), bounds)
                leading = _least_leading(n, threshold)
                sets, fronts = [None] * len(n), [None] * len(n)
                share = np.minimum(8 * unique // np.maximum(leading, 1), 7).astype(U)
                keys = set_keys(shingles, bounds)
                codes = ((share << U(60)) | (keys[:, 0] >> U(4))).view(np.int64)
                names = binary_keys(keys)
                for d in np.flatnonzero((unique < leading) & (n > 0) & left.value.holds(keys)).tolist():
                    if (key := names[d].as_py()) in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    own = shingles[bounds[d] : bounds[d + 1]]
                    common = own[shared[bounds[d] : bounds[d + 1]]]
                    front = common[np.argsort(table.levels(common), kind="stable")[: leading[d] - unique[d]]]
                    sets[d], fronts[d] = pack_set(own), front.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(n), names, pa.array(codes), pa.array(sets, pa.binary()), pa.array(fronts, pa.binary())],
                    names=["doc_id", "n", "key", "code", "shingles", "leading"],
                )

    return tidy(run)


def _leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, code, leading) -> a row (shingle, key, n, code) for each leading shingle."""
    for batch in batches:
        fronts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(3)]
        owners = np.repeat(np.arange(len(fronts)), [len(x) for x in fronts])
        every = np.concatenate(fronts) if fronts else np.zeros(0, np.int64)
        for a in range(0, len(every), 1 << 17):
            own = pa.array(owners[a : a + (1 << 17)])
            yield pa.RecordBatch.from_arrays([pa.array(every[a : a + (1 << 17)]), *(batch.column(k).take(own) for k in range(3))], names=["shingle", "key", "n", "code"])


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)


class Probe:
    """A few sets in memory, to be met by any number of others."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(x) for x in sets], np.int64)
        every = np.concatenate([*sets, np.zeros(0, U)])
        owners = np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(every, kind="stable")
        self.values, first = np.unique(every[order], return_index=True)
        self.first, self.owners = np.append(first, len(every)), owners[order]

    def common(self, sets: list[np.ndarray]) -> np.ndarray:
        """Sizes of the intersections, a row for each of ``sets``."""
        out = np.zeros((len(sets), len(self.n)), np.int64)
        begin = 0
        while begin < len(sets):
            end, many = begin, 0
            while end < len(sets) and (end == begin or (many + len(sets[end])) * len(self.n) <= LOOKUPS):
                many += len(sets[end])
                end += 1
            every = np.concatenate(sets[begin:end])
            rows = np.repeat(np.arange(end - begin), [len(x) for x in sets[begin:end]])
            at = np.minimum(np.searchsorted(self.values, every), len(self.values) - 1)
            hit = self.values[at] == every
            at, rows = at[hit], rows[hit]
            each = self.first[at + 1] - self.first[at]
            place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(self.first[at], each)
            cells = np.repeat(rows, each) * len(self.n) + self.owners[place]
            out[begin:end] = np.bincount(cells, minlength=(end - begin) * len(self.n)).reshape(-1, len(self.n))
            begin = end
        return out


def _groups(batches: Iterator[pa.RecordBatch], names: int) -> Iterator[tuple[tuple, list[tuple], Iterator[list[tuple]]]]:
    """Rows sorted by ``names`` columns and then by kind (0: loaded, 1: streamed) -> (name, loaded rows, parts of the streamed ones)."""
    held: list[tuple] = []

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    source = rows()

    def next_row() -> tuple | None:
        return held.pop() if held else next(source, None)

    while (row := next_row()) is not None:
        name, loaded = row[:names], []
        while row is not None and row[:names] == name and row[names] == 0:
            loaded.append(row[names + 1 :])
            row = next_row()

        def streamed(row=row) -> Iterator[list[tuple]]:
            part, size = [], 0
            while row is not None and row[:names] == name:
                part.append(row[names + 1 :])
                size += len(row[-1])
                if size > BYTES:
                    yield part
                    part, size = [], 0
                row = next_row()
            if row is not None:
                held.append(row)
            if part:
                yield part

        parts = streamed()
        yield name, loaded, parts
        for _ in parts:  # what the caller hasn't read
            pass


ASSIGNED = "region long, pivot binary, key binary, n long, core boolean, home boolean, distance double, linked boolean, nearest boolean"


def _assign(threshold: Fraction) -> Callable:
    """Rows (region, salt, kind, key, n, core, home, shingles) -> a row for each cell of each member."""
    num, den = threshold.numerator, threshold.denominator
    window = 2 * float(1 - threshold) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_(), pa.float64(), pa.bool_(), pa.bool_()]
        names = [x.split()[0] for x in ASSIGNED.split(", ")]
        out: list[list] = [[] for _ in kinds]

        def done() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)
            for x in out:
                x.clear()
            return batch

        for (region, _), loaded, parts in _groups(batches, 2):
            pivots = {row[0]: row[-1] for row in loaded}
            probe = Probe([unpack_set(x) for x in pivots.values()])
            keys = list(pivots)
            for part in parts:
                if not keys:
                    continue
                inner = probe.common([unpack_set(row[-1]) for row in part])
                n = np.array([row[1] for row in part], np.int64)
                union = n[:, None] + probe.n[None, :] - inner
                distance = 1 - inner / union
                linked = den * inner >= num * union
                nearest = distance.argmin(axis=1)
                near = distance <= distance[np.arange(len(part)), nearest][:, None] + window
                for x, p in zip(*(a.tolist() for a in np.nonzero(near))):
                    key, size, core, home, _ = part[x]
                    for column, value in zip(out, (region, keys[p], key, size, core, home, distance[x, p], linked[x, p], p == nearest[x])):
                        column.append(value)
                if len(out[0]) > 10_000:
                    yield done()
        yield done()

    return tidy(run)


def _compare(threshold: Fraction) -> Callable:
    """Rows (region, block, salt, kind, key, n, core, home, shingles) -> links (u, v) of the loaded sets with the streamed ones.

    A streamed set is linked to the first loaded one within the threshold, and the loaded ones
    that it is within the threshold of are linked to each other.
    """
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list[bytes] = []
        v: list[bytes] = []

        def done() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])
            u.clear()
            v.clear()
            return batch

        for _, loaded, parts in _groups(batches, 3):
            own = {row[0]: row[-1] for row in loaded}
            keys = list(own)
            probe = Probe([unpack_set(x) for x in own.values()])
            forest = _Forest(len(keys))
            for part in parts:
                if not keys:
                    continue
                inner = probe.common([unpack_set(row[-1]) for row in part])
                n = np.array([row[1] for row in part], np.int64)
                linked = den * inner >= num * (n[:, None] + probe.n[None, :] - inner)
                for x in np.flatnonzero(linked.any(axis=1)).tolist():
                    first, *more = np.flatnonzero(linked[x]).tolist()
                    if part[x][0] != keys[first]:
                        u.append(part[x][0])
                        v.append(keys[first])
                    for y in more:
                        forest.link(first, y)
                if len(u) > 10_000:
                    yield done()
            for y in range(len(keys)):
                if (r := forest.root(y)) != y:
                    u.append(keys[y])
                    v.append(keys[r])
        yield done()

    return tidy(run)


@dataclass
class Limits:
    """Rows and bytes that a task holds of a region."""

    rows: int = ROWS
    bytes: int = BYTES

    def parts(self, rows: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(rows / F.lit(self.rows)), F.ceil(6 * shingles / F.lit(self.bytes)), F.lit(1)).cast("int")


def _salted(key: Column, region: Column, salts: Column) -> Column:
    return F.pmod(F.xxhash64(key, region), salts).cast("int")


def _round(members: DataFrame, pivots: DataFrame, sets: DataFrame, threshold: Fraction, limits: Limits) -> DataFrame:
    """Members (region, key, n, core, home) and pivots (region, key) -> ASSIGNED rows."""
    sizes = members.groupBy("region").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    salts = sizes.select("region", limits.parts(F.col("rows"), F.col("shingles")).alias("salts"))
    named = ["region", "salt", "kind", "key", "n", "core", "home"]
    streamed = members.join(salts, "region").withColumn("salt", _salted(F.col("key"), F.col("region"), F.col("salts"))).withColumn("kind", F.lit(1)).select(*named)
    nothing = [F.lit(0).cast("long").alias("n"), F.lit(False).alias("core"), F.lit(False).alias("home")]
    loaded = pivots.join(salts, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "key", *nothing)
    rows = loaded.select(*named).unionByName(streamed).join(sets, "key").select(*named, "shingles")
    return rows.repartition("region", "salt").sortWithinPartitions("region", "salt", "kind").mapInArrow(_assign(threshold), ASSIGNED)


def _next(assigned: DataFrame, reach: float) -> DataFrame:
    """ASSIGNED rows of a round -> members of the cells that aren't done.

    Where windows repeat a region's sets more than ``REPEATED`` times on average, its cells would
    be no smaller than the region, and it stays whole, with what the round has added to its core.
    """
    with_core = assigned.where("linked and core").select("region", "pivot").distinct()
    joined = assigned.where("linked and not core").join(with_core, ["region", "pivot"]).select("region", "key").distinct().withColumn("joins", F.lit(True))
    pivots = assigned.select("region", F.col("pivot").alias("key")).distinct()
    whole = assigned.groupBy("region").agg((F.count("*") > REPEATED * F.count_if("nearest")).alias("whole"))
    rows = assigned.join(joined, ["region", "key"], "left").join(pivots, ["region", "key"], "left_anti").join(whole, "region").where("not whole or nearest")
    rows = rows.select(
        F.when(F.col("whole"), F.col("region")).otherwise(F.xxhash64("region", "pivot")).alias("region"),
        "key",
        "n",
        (F.col("core") | F.col("joins").isNotNull()).alias("core"),
        (F.col("home") & F.col("nearest")).alias("home"),
        "distance",
        "whole",
    )
    outside = F.when(~F.col("core"), F.col("distance"))
    cells = rows.groupBy("region").agg(F.min(outside).alias("least"), F.max(outside).alias("most"), F.max("home").alias("homes"), F.count("*").alias("rows")).where("least is not null and homes and rows > 1")
    kept = rows.join(cells.drop("rows"), "region").where(F.col("whole") | ~F.col("core") | F.col("distance").between(F.col("least") - reach, F.col("most") + reach))
    return kept.select("region", "key", "n", "core", "home")


def _all_links(members: DataFrame, sets: DataFrame, threshold: Fraction, limits: Limits) -> DataFrame:
    """Members -> links of the sets outside the core with all members of their region.

    Both are dealt out: a region within the limits is one task, in any other each block of
    the sets outside the core meets each part of the members.
    """
    outside = F.when(~F.col("core"), 1)
    sizes = members.groupBy("region").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.count(outside).alias("out_rows"), F.sum(F.when(~F.col("core"), F.col("n"))).alias("out_shingles"))
    dealt = sizes.where("out_rows > 0 and rows > 1").select("region", limits.parts(F.col("rows"), F.col("shingles")).alias("salts"), limits.parts(F.col("out_rows"), F.col("out_shingles")).alias("blocks"))
    rows = members.join(dealt, "region")
    named = ["region", "block", "salt", "kind", "key", "n", "core", "home"]
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    streamed = rows.withColumn("salt", _salted(F.col("key"), F.col("region"), F.col("salts"))).withColumn("block", every("blocks")).withColumn("kind", F.lit(1))
    loaded = rows.where(~F.col("core")).withColumn("block", _salted(F.col("key"), F.col("region"), F.col("blocks"))).withColumn("salt", every("salts")).withColumn("kind", F.lit(0))
    met = loaded.select(*named).unionByName(streamed.select(*named)).join(sets, "key").select(*named, "shingles")
    return met.repartition("region", "block", "salt").sortWithinPartitions("region", "block", "salt", "kind").mapInArrow(_compare(threshold), "u binary, v binary")


def _links(members: DataFrame, sets: DataFrame, threshold: Fraction, limits: Limits, scratch: Scratch) -> DataFrame:
    """Regions (region, key, n, first) -> links (u, v) between keys.  ``first`` marks a region's pivot."""
    reach = float(1 - threshold) + 1e-9
    links, before, pivots = [], None, members.where("first").select("region", "key")
    members = members.select("region", "key", "n", F.col("first").alias("core"), F.lit(True).alias("home"))
    while True:
        assigned = scratch.keep(_round(members, pivots, sets, threshold, limits), "assigned")
        links.append(assigned.where("linked and key != pivot").select(F.col("key").alias("u"), F.col("pivot").alias("v")))
        members = scratch.keep(_next(assigned, reach), "cells")
        sizes = members.groupBy("region").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).withColumn("large", limits.parts(F.col("rows"), F.col("shingles")) > 1)
        total = sizes.where("large").agg(F.sum("rows")).first()[0] or 0
        large = sizes.where("large").select("region")
        if not total or before is not None and total > 0.7 * before:
            links.append(scratch.keep(_all_links(members, sets, threshold, limits), "links"))
            return _union(links)
        links.append(scratch.keep(_all_links(members.join(large, "region", "left_anti"), sets, threshold, limits), "links"))
        members, before = scratch.keep(members.join(large, "region"), "regions"), total
        turn = F.xxhash64("key", F.lit(before))
        chosen = members.where(~F.col("core")).groupBy("region", F.pmod(turn, F.lit(PIVOTS)).alias("place")).agg(F.min(turn).alias("turn"))
        pivots = scratch.keep(members.where(~F.col("core")).withColumn("turn", turn).withColumn("place", F.pmod("turn", F.lit(PIVOTS))).join(chosen, ["region", "place", "turn"]).select("region", "key").distinct(), "pivots")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.union(x)
    return out


def set_key(text: Column, width: int = 5) -> Column:
    """The key of a text's set (null where it is empty), as the joins use it; the rows stay in the JVM."""

    @F.arrow_udf("binary")
    def keyed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [pa.array([], pa.binary())]
            for _, _, data, offsets in text_chunks(batch):
                shingles, bounds = shingle_sets(words(data, offsets), width)
                names = binary_keys(set_keys(shingles, bounds))
                out.append(pa.array([k if n else None for k, n in zip(names.to_pylist(), np.diff(bounds).tolist())], pa.binary()))
            yield pa.concat_arrays(out)

    return keyed.asNondeterministic()(text)  # evaluated once, wherever it is used


def classes(texts: DataFrame, width: int, threshold: Fraction, limits: Limits, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text) -> their (doc_id, n, key), and (key, root) of the sets that are linked to others."""
    spark = texts.sparkSession
    small_batches(spark)
    left = spark.sparkContext.broadcast(sieve(texts, width, threshold))
    blobs = texts.select("text").mapInArrow(_count_blobs(width, left), "part int, blob binary")
    ranges = blobs.repartition("part").sortWithinPartitions("part").mapInArrow(_count_ranges, "part int, shared binary, often binary, level binary")
    order = spark.sparkContext.broadcast(ShingleOrder(ranges.collect()))  # 1024 rows of fixed size
    described = scratch.keep(texts.mapInArrow(_describe(width, threshold, left, order), DESCRIBED), "sets")
    order.unpersist()
    left.unpersist()
    active = described.where("leading is not null")
    entries = active.select("key", "n", "code", "leading").mapInArrow(_leading, "shingle long, key binary, n long, code long")
    elected = entries.groupBy("shingle").agg(F.min("code").alias("region"), F.max("code").alias("last")).where("region < last").select("shingle", "region")
    members = scratch.keep(entries.join(elected, "shingle").select("region", "key", "n", (F.col("code") == F.col("region")).alias("first")).distinct(), "members")
    sets = active.groupBy("key").agg(F.first("shingles").alias("shingles"))
    return described.select("doc_id", "n", "key"), components(_links(members, sets, threshold, limits, scratch)).withColumnRenamed("node", "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: Fraction | str = "4/5", limits: Limits = Limits()) -> DataFrame:
    """Rows of ``docs`` -> (doc_id, n_shingles, component_id): connected near duplicates.

    Words are cut at ASCII white space with A-Z lower-cased; sets are of distinct
    ``width``-word shingles, or of the whole sequence where there are fewer words.  Texts
    link where the Jaccard similarity is ``threshold`` at least; ``component_id`` is the
    smallest id reachable by links.  Null and wordless texts have 0 shingles and only
    their own id.  One row for each input row; rows that repeat an id give repeated
    rows, null ids stay null and count only where no id is known.  An empty table gives
    an empty table; other columns are ignored, whatever their names.  Very long texts are
    read whole, a piece at a time.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(ref(id_col).cast("long").alias("doc_id"), ref(text_col).cast("string").alias("text"))
    rows, roots = classes(texts, width, Fraction(threshold), limits, scratch)
    ids = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least")).join(roots, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    named = ids.join(ids.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    found = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(named, "key", "left")
    out = found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    kept = Scratch(docs.sparkSession).keep(out, "near-duplicates")  # small rows; the sets can go
    scratch.drop()
    return kept


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: Fraction | str = "4/5", limits: Limits = Limits()) -> DataFrame:
    """Rows of ``docs`` without near duplicates: of each group of linked texts one row stays.

    That is the row with the smallest id, null ids last; of rows with that id, the one whose set
    has the smallest key, and of those with that set the one with the smallest hash over all
    columns.  Rows without words are in no group and all stay.  An empty table gives an
    empty table; all columns are kept, whatever their names.  Rows of one id with
    unlike texts are judged apart.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(ref(id_col).cast("long").alias("doc_id"), ref(text_col).cast("string").alias("text"))
    rows, roots = classes(texts, width, Fraction(threshold), limits, scratch)
    kept_tables = Scratch(docs.sparkSession)
    roots = kept_tables.keep(roots, "roots")
    order = F.struct(F.col("id").isNull().alias("last"), F.coalesce("id", F.lit(0)).alias("id"), "key")
    ids = rows.where("n > 0").groupBy("key", F.col("doc_id").alias("id")).agg(F.count("*").alias("many"))
    named = ids.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    best = named.groupBy("root").agg(F.min(order).alias("best"))
    judged = named.join(best, "root").withColumn("stays", order == F.col("best")).where("not stays or many > 1")
    found = kept_tables.keep(judged.select(F.col("key").alias("f_key"), F.col("id").alias("f_id"), "stays"), "judged")  # rows that go, and repeated ones
    scratch.drop()
    if found.count() <= BROADCAST_ROWS:  # else texts are dealt by key and id
        found = F.broadcast(found)
    marked = boxed(docs, id=ref(id_col).cast("long"), key=set_key(ref(text_col).cast("string"), width))
    marked = marked.join(found, (F.col("key") == F.col("f_key")) & F.col("id").eqNullSafe(F.col("f_id")), "left")
    kept = marked.where("stays is null").select(*unboxed(docs, docs.columns))
    if found.where("stays").isEmpty():
        return kept
    repeated = marked.where("stays").groupBy("key", "id").agg(F.min_by("__pm_row", F.xxhash64("__pm_row")).alias("__pm_row"))
    return kept.unionByName(repeated.select(*unboxed(docs, docs.columns)))
