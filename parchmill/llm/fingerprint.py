"""Document fingerprints from prefix polynomial hashes.

For code points c and base b, the prefix array holds the sums of c[i] * b**i modulo a
prime, for two 31-bit primes.  Any two spans are equal when their differences agree
after alignment by a power of b, which takes a constant time; longest common extensions
of two positions follow by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import small_batches, tidy
from .ordering import bucket_of, id_bounds
from .storage import ref

U = np.uint64
#: Two primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
LEAST = -(1 << 63)
#: Fixed value: code points that agree where two texts meet again after a difference.
ANCHOR = 12
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> list[np.ndarray]:
    while len(_powers[0]) <= n:
        for k, (p, b) in enumerate(zip(PRIMES, BASES)):
            old = _powers[k]
            _powers[k] = np.concatenate([old, old * U(pow(b, len(old), p)) % U(p)])
    return _powers


class PrefixHash:
    """Modular prefix arrays of one text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U) + U(1)
        self.n = len(codes)
        self.power = powers(max(self.n, 1))
        self.prefix = []
        for p, power in zip(PRIMES, self.power):
            sums = np.zeros(self.n + 1, U)
            np.cumsum(codes * power[: self.n] % U(p), out=sums[1:])
            self.prefix.append(sums % U(p))

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The hash of a span, not aligned: it carries the factor b**start."""
        return tuple((int(h[end]) - int(h[start])) % p for h, p in zip(self.prefix, PRIMES))

    def same(self, start: int, other: "PrefixHash", at: int, length: int) -> bool:
        """Whether two spans are equal (up to a collision of both primes)."""
        longer = self if self.n >= other.n else other
        for h, g, power, p in zip(self.prefix, other.prefix, longer.power, PRIMES):
            mine = (int(h[start + length]) - int(h[start])) * int(power[at])
            if (mine - (int(g[at + length]) - int(g[at])) * int(power[start])) % p:
                return False
        return True

    def common_ahead(self, start: int, other: "PrefixHash", at: int, most: int) -> int:
        """Length of the longest common extension to the right, at most ``most``."""
        low, high = 0, most
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def common_behind(self, end: int, other: "PrefixHash", at: int, most: int) -> int:
        """Length of the longest common extension to the left of two ends, at most ``most``."""
        low, high = 0, most
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(end - middle, other, at - middle, middle):
                low = middle
            else:
                high = middle - 1
        return low


def fingerprint(n: int, hashes: tuple[int, int]) -> str:
    return f"{n:x}-{hashes[0]:08x}{hashes[1]:08x}"


def likeness(a: PrefixHash, b: PrefixHash) -> float:
    """Share of the longer text in spans that both share in the same order; 1 for two empty texts.

    These are the longest common beginning and ending and, between them, the spans of
    ``ANCHOR`` code points at least at which the texts meet again after each difference.
    """
    if (b.n, b.span(0, b.n)) < (a.n, a.span(0, a.n)):
        a, b = b, a  # one order, so that both directions give the same
    if not b.n:
        return 1.0
    ahead = a.common_ahead(0, b, 0, a.n)
    behind = a.common_behind(a.n, b, b.n, a.n - ahead)
    return (ahead + behind + shared(a, ahead, a.n - behind, b, ahead, b.n - behind)) / b.n


def _grams(x: PrefixHash, start: int, end: int, power: list[np.ndarray], top: int) -> np.ndarray:
    """Hashes of the spans of ``ANCHOR`` code points that begin at ``start`` to ``end - ANCHOR``, aligned to ``top``."""
    out = np.zeros(end - ANCHOR + 1 - start, U)
    for h, w, p in zip(x.prefix, power, PRIMES):
        span = (h[start + ANCHOR : end + 1] + U(p) - h[start : end - ANCHOR + 1]) % U(p)
        out = (out << U(31)) | span * w[top - np.arange(start, end - ANCHOR + 1)] % U(p)
    return out


def shared(a: PrefixHash, i: int, a_end: int, b: PrefixHash, j: int, b_end: int) -> int:
    """Code points of a[i:a_end] and b[j:b_end] in spans that both share in order.

    From each difference the walk goes on at the nearest place, by the code points passed
    over in both, where ``ANCHOR`` code points agree, and takes the longest common
    extensions there.  A search looks no further than a small multiple of what it passes
    over, so the walk takes time in proportion to the texts.
    """
    if min(a_end - i, b_end - j) < ANCHOR:
        return 0
    top = max(a_end, b_end)
    power = powers(top)
    mine, theirs = _grams(a, i, a_end, power, top), _grams(b, j, b_end, power, top)
    ordered = np.sort(theirs)
    hit = np.flatnonzero(ordered[np.minimum(np.searchsorted(ordered, mine), len(ordered) - 1)] == mine)
    if not len(hit):
        return 0
    kinds, rank = np.unique(mine[hit], return_inverse=True)  # spans of a that are anywhere in b
    place = np.minimum(np.searchsorted(kinds, theirs), len(kinds) - 1)
    known = np.flatnonzero(kinds[place] == theirs)
    wide = b_end + 1
    keys = np.sort(place[known].astype(np.int64) * wide + known + j)
    bases, hit = rank.astype(np.int64) * wide, hit + i
    total = 0
    while (first := int(np.searchsorted(hit, i))) < len(hit):
        reach = 64
        while True:
            last = int(np.searchsorted(hit, i + reach, "right"))
            at = np.searchsorted(keys, bases[first:last] + j)
            to = keys[np.minimum(at, len(keys) - 1)] - bases[first:last]
            cost = np.where((at < len(keys)) & (to < wide), hit[first:last] - i + to - j, 2 * top)
            best = int(cost.argmin()) if len(cost) else -1
            if best >= 0 and cost[best] <= reach or last == len(hit):
                break
            reach *= 4
        if cost[best] >= 2 * top:
            break
        x, y = int(hit[first + best]), int(to[best])
        back = a.common_behind(x, b, y, min(x - i, y - j))
        on = a.common_ahead(x, b, y, min(a_end - x, b_end - y))
        total += back + on
        i, j = x + max(on, 1), y + max(on, 1)
    return total


def edited_hash(a: PrefixHash, kept: int, b: PrefixHash, added: int) -> tuple[int, int]:
    """The hash of ``a[:kept] + b[:added]`` from both prefix arrays, without the text."""
    power = a.power if len(a.power[0]) > kept else powers(kept)
    return tuple((int(h[kept]) + int(g[added]) * int(w[kept])) % p for h, g, w, p in zip(a.prefix, b.prefix, power, PRIMES))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, extra, doc_id, text) in order: each row but extra ones meets its next row."""
    out: list[list] = [[] for _ in range(7)]
    before = None

    def emit(doc_id: int | None, text: str, a: PrefixHash, after: str, b: PrefixHash) -> None:
        moved = a.n // 3
        kept, added = a.n - moved, min(moved, b.n)
        edited = text[:kept] + after[:added]
        row = (doc_id, a.n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(a.n, a.span(0, a.n)), fingerprint(kept + added, edited_hash(a, kept, b, added)), likeness(a, PrefixHash(edited)), likeness(a, b))
        for column, value in zip(out, row):
            column.append(value)

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])
        for x in out:
            x.clear()
        return batch

    for batch in batches:
        for k in range(batch.num_rows):
            bucket, extra, doc_id, text = (batch.column(c)[k].as_py() for c in range(4))
            if before and before[0] == bucket and before[1]:
                continue  # of several extra rows the first counts
            now = PrefixHash(text)
            if before and before[0] == bucket:
                emit(before[2], before[3], before[4], text, now)
            before = (bucket, extra, doc_id, text, now)
        if len(out[0]) >= 1000:
            yield flush()
    yield flush()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` -> fingerprints of each text and of its edited text, and likenesses.

    The edited text has its last ``n // 3`` code points replaced by the first as many of
    the next document in descending id order (after the last: the first document).
    Null texts are empty; a null id orders last and stays null; rows of equal ids are
    ordered by a hash of the text; a lone row is its own next.  Equal texts have equal
    fingerprints.  Very long texts are hashed whole; other columns are ignored, whatever
    their names; an empty table gives an empty table.

    Ids alone are read first for bucket bounds and the first row of each bucket.  Each
    text is then dealt to its bucket once; the first row of a bucket also goes to the
    bucket before it, where it ends the chain.
    """
    rows = docs.select(ref(id_col).cast("long").alias("doc_id"), F.coalesce(ref(text_col).cast("string"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    place = F.coalesce("doc_id", F.lit(LEAST))
    keys = rows.select(place.alias("place"))
    bounds = id_bounds(keys, "place")
    heads = {r["bucket"]: r["head"] for r in keys.groupBy(bucket_of(F.col("place"), bounds).alias("bucket")).agg(F.max("place").alias("head")).collect()}  # one row a bucket
    order = sorted(heads, reverse=True)
    extras = {heads[b]: (order[i - 1]) for i, b in enumerate(order)}  # the chain runs from high to low and around
    own = bucket_of(F.col("place"), bounds).alias("bucket")
    rows = rows.withColumn("place", place).select("doc_id", "text", "place", own)
    if extras:
        to = F.create_map(*[c for head, bucket in extras.items() for c in (F.lit(head).cast("long"), F.lit(bucket))]) if len(extras) <= 200 else None
        if to is not None:
            head = to[F.col("place")]
        else:
            ids, targets = np.array(sorted(extras), np.int64), np.array([extras[k] for k in sorted(extras)], np.int32)

            @F.pandas_udf("int")
            def find(at):
                import pandas as pd

                at = at.to_numpy(np.int64)
                found = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
                return pd.Series(targets[found], dtype="Int32").where(pd.Series(ids[found] == at))

            head = find("place")
    else:
        head = F.lit(None).cast("int")
    dealt = rows.withColumn("head", head).select(
        "doc_id", "text", "place", F.explode(F.when(F.col("head").isNull(), F.array(F.struct("bucket", F.lit(0).alias("extra")))).otherwise(F.array(F.struct("bucket", F.lit(0).alias("extra")), F.struct(F.col("head").alias("bucket"), F.lit(1).alias("extra"))))).alias("to")
    )
    ordered = dealt.select("to.bucket", "to.extra", "doc_id", "text", "place").repartition("bucket").sortWithinPartitions("bucket", "extra", F.desc("place"), F.xxhash64("text"))
    return ordered.select("bucket", "extra", "doc_id", "text").mapInArrow(tidy(_walk), SCHEMA)
