"""Ranked lexical search over a tiered index.

The index is dealt by documents: a row has a document's postings (term, impact) in four tiers, by three
thresholds of impact that all terms share, each tier a column that is read alone.  A term's residual
bound is its greatest impact below a tier.  A search goes over the first tier alone and takes the best
documents' exact scores; the least of an item's k best is a floor for its result.  If the residual bounds of the item's
terms sum to less than the floor, no document outside the tiers read can be in the result: the item is
proven, and only documents whose score so far and residual bounds together reach the floor are scored exactly.  An
item without that proof gets a better floor from the second tier and falls through to as many tiers as its proof
takes, at most to the last, where bounds are 0 and the proof always holds.  The thresholds steer the work, never the result.

Items are a stated set of queries, taken in blocks of bounded terms; an index holds the terms of its block.
Only (item, document) pairs of the k best of each task and floors leave the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .memory import small_batches, tidy
from .storage import Scratch, ref
from .words import text_chunks

TOP = 50
#: Most items, (item, term) pairs and bytes of terms in a block of items; one larger item is a block of its own.
ITEMS, PAIRS, BYTES = 1000, 1 << 18, 1 << 24
#: Shares of the postings, by impact, above the thresholds between tiers.
SHARES = (1 / 8, 2 / 3, 15 / 16)
TIERS = ("high", "upper", "lower", "low")
#: Cells of scores, (document, item), that a task holds at a time, and added values at a time.
CELLS = 1 << 20

#: Bytes of terms are ASCII letters and digits and all bytes of other characters.
_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """UTF-8 bytes and bounds of rows -> (number of terms of each row, all terms in order)."""
    inside = _IS_TERM[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] = inside[inner]
    stop[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    where = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(_LOWER[data[inside]])])
    return np.diff(np.searchsorted(starts, offsets)), found


@dataclass
class Block:
    """A block of items: their ids, the distinct terms, and (item, term) pairs."""

    ids: list[int | None] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0

    def add(self, item_id: int | None, words: list[bytes]) -> None:
        self.pairs += [(len(self.ids), self.vocabulary.setdefault(w, len(self.vocabulary))) for w in words]
        self.ids.append(item_id)
        self.size += sum(map(len, words))

    def full(self, words: list[bytes]) -> bool:
        return bool(self.ids) and (len(self.ids) >= ITEMS or len(self.pairs) + len(words) > PAIRS or self.size + sum(map(len, words)) > BYTES)


def blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[Block]:
    """The items, as rows, in blocks; they come to the driver one after another."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                many, found = terms(data, offsets)
                at = np.concatenate([[0], np.cumsum(many)])
                own = [found.slice(a, b - a).unique().to_pylist() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(own, pa.list_(pa.binary()))], ["item_id", "words"])

    rows = items.select(ref(item_col).cast("long").alias("item_id"), ref(text_col).cast("string").alias("text"))
    block = Block()
    for row in rows.mapInArrow(tidy(split), "item_id long, words array<binary>").toLocalIterator():
        words = [bytes(w) for w in row["words"]]
        if block.full(words):
            yield block
            block = Block()
        block.add(row["item_id"], words)
    if block.ids:
        yield block


def counted(docs: DataFrame, vocabulary: list[bytes], doc_col: str, text_col: str) -> DataFrame:
    """Documents -> (doc_id, n, terms, tfs): all terms counted, and those of the vocabulary with their occurrences."""
    known, size = pa.array(vocabulary, pa.large_binary()), max(len(vocabulary), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                many, found = terms(data, offsets)
                ids = pc.fill_null(pc.index_in(found, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(end - first), many)
                cells, tf = np.unique((row * size + ids)[ids >= 0], return_counts=True)
                at = pa.array(np.searchsorted(cells, np.arange(end - first + 1) * size), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (cells % size, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(many, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(ref(doc_col).cast("long").alias("doc_id"), ref(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(count), "doc_id long, n long, terms array<int>, tfs array<int>")


@dataclass
class Index:
    """``table``: row, doc_id and a column of postings for each tier.  ``below[t][j]``: the greatest impact of a term under tier j + 1."""

    table: DataFrame
    below: np.ndarray
    n_docs: int


def build(docs: DataFrame, vocabulary: list[bytes], scratch: Scratch, doc_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index of all documents over the terms of a vocabulary, whose counts and statistics cover all documents."""
    # a row's number is written, so that it stays when a task is computed again
    counts = scratch.keep(counted(docs, vocabulary, doc_col, text_col).withColumn("row", F.monotonically_increasing_id()), "counts")
    total = counts.agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("n_docs"), F.sum("n").alias("length")).first()
    n_docs, length = total["n_docs"] or 0, total["length"] or 0
    holding = {r["term"]: r["many"] for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("many")).collect()}  # a row for each term of the vocabulary
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(vocabulary))]
    # one constant for all weights, not an expression for each
    weights = F.split(F.lit(",".join(map(str, weight or [0]))), ",").cast("array<long>")
    m = F.expr(f"100 - 50 + ((50L * n * {n_docs}L) div {max(length, 1)}L)")
    scored = counts.withColumn("m", m).withColumn("w", weights)
    posting = F.expr("zip_with(terms, tfs, (t, f) -> named_struct('term', t, 'impact', get(w, t) * ((1000000000L * f) div (1000L * f + 20L * m))))")
    postings = scored.select("row", "doc_id", F.filter(posting, lambda p: p["impact"] > 0).alias("p"))
    cuts = postings.select(F.explode("p").alias("p")).agg(F.percentile_approx("p.impact", [1 - s for s in SHARES], 10_000)).first()[0] or [1] * len(SHARES)
    edges = [1 << 62, *map(int, cuts), 0]
    # a generator between keeps the tiers from computing the postings anew
    tiered = postings.select("row", "doc_id", F.inline(F.array(F.struct("p")))).where("size(p) > 0")
    tiers = [F.expr(f"filter(p, x -> x.impact < {top}L and x.impact >= {least}L)").alias(name) for name, top, least in zip(TIERS, edges, edges[1:])]
    table = scratch.keep(tiered.select("row", "doc_id", *tiers), "index")
    below = np.zeros((len(vocabulary), len(TIERS)), np.int64)
    for j, name in list(enumerate(TIERS))[1:]:
        for r in table.select(F.explode(name).alias("p")).groupBy("p.term").agg(F.max("p.impact").alias("most")).collect():  # a row for each term of the vocabulary
            below[r["term"], :j] = np.maximum(below[r["term"], :j], r["most"])
    return Index(table, below, n_docs)


class Adder:
    """Sums of values of postings over the items of their terms."""

    def __init__(self, pairs: np.ndarray, items: np.ndarray, n_terms: int):
        """``items``: those to score, whose columns are in this order."""
        column = np.full(int(max(pairs[:, 0].max(initial=0), items.max(initial=0))) + 1, -1)
        column[items] = np.arange(len(items))
        own = pairs[column[pairs[:, 0]] >= 0]
        own = own[np.argsort(own[:, 1], kind="stable")]
        self.width, self.items = len(items), column[own[:, 0]]
        self.at = np.searchsorted(own[:, 1], np.arange(n_terms + 1))

    def __call__(self, rows: int, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = np.zeros(rows * self.width, np.int64)
        many = self.at[term + 1] - self.at[term]
        total = np.concatenate([[0], np.cumsum(many)])
        a = 0
        while a < len(term):
            b = max(int(np.searchsorted(total, total[a] + CELLS, "right")) - 1, a + 1)
            each = np.repeat(np.arange(a, b), many[a:b])
            item = self.items[self.at[term[each]] + np.arange(len(each)) - (total[each] - total[a])]
            np.add.at(out, row[each] * self.width + item, value[each])
            a = b
        return out.reshape(rows, self.width)


def _postings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column of postings -> row, term, impact of each."""
    many = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), many), flat.field("term").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("impact").to_numpy(zero_copy_only=False)


class Best:
    """The k best (score, then least key) rows of each item."""

    def __init__(self, k: int, items: int):
        self.k, self.most, self.parts, self.size = k, max(4 * k * items, 1 << 16), [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > self.most:
            self.parts = [self.cut()]
            self.size = len(self.parts[0][0])

    def cut(self) -> tuple[np.ndarray, ...]:
        """Columns item, score, key and others."""
        columns = [np.concatenate(x) for x in zip(*self.parts)]
        order = np.lexsort((*columns[:1:-1], -columns[1], columns[0]))
        item = columns[0][order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        return tuple(c[order[rank < self.k]] for c in columns)


def _slices(batches: Iterator[pa.RecordBatch], items: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(CELLS // max(items, 1), 1)
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def _candidates(index: Index, block: Block, k: int, tiers: int, items: np.ndarray) -> DataFrame:
    """(item, row, score): each task's best documents of some items by the first tiers alone."""
    pairs, n_terms = np.array(block.pairs, np.int64).reshape(-1, 2), len(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adder, best = Adder(pairs, items, n_terms), Best(k, len(items))
        for batch in _slices(batches, len(items)):
            ids = batch.column(0).to_numpy()
            scores = adder(len(ids), *(np.concatenate(x) for x in zip(*(_postings(c) for c in batch.columns[1:]))))
            row, column = np.nonzero(scores)
            best.add(items[column], scores[row, column], ids[row])
        if best.parts:
            item, score, row = best.cut()
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(row), pa.array(score)], ["item", "row", "score"])

    return index.table.select("row", *TIERS[:tiers]).mapInArrow(tidy(run), "item int, row long, score long")


def floors(index: Index, block: Block, k: int, tiers: int, items: np.ndarray) -> np.ndarray:
    """A floor for the k-th best score of some items: that of the k best by the first tiers, scored exactly; 0 with fewer."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "row"))
    found = _candidates(index, block, k, tiers, items).withColumn("rank", rank).where(F.col("rank") <= k).select("item", "row")
    own: dict[int, list[int]] = {}
    for item, term in block.pairs:
        own.setdefault(item, []).append(term)
    spark = index.table.sparkSession
    wanted = spark.createDataFrame(sorted(own.items()), "item int, own array<int>")  # bounded by a block
    rows = found.join(F.broadcast(wanted), "item")
    # k rows an item of a block at most
    both = index.table.join(F.broadcast(rows), "row")
    score = F.aggregate(F.filter(F.concat(*TIERS), lambda p: F.array_contains("own", p["term"])), F.lit(0).cast("long"), lambda s, p: s + p["impact"])
    out = np.zeros(len(block.ids), np.int64)
    for r in both.select("item", score.alias("score")).groupBy("item").agg(F.count("*").alias("many"), F.min("score").alias("least")).collect():  # a row an item
        out[r["item"]] = r["least"] if r["many"] == k else 0
    return out


def levels(index: Index, block: Block, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tiers to read, sum of the residual bounds under them) of each item."""
    rest = np.zeros((len(block.ids), len(TIERS)), np.int64)
    for item, term in block.pairs:
        rest[item] += index.below[term]
    proven = rest < floor[:, None]
    proven[:, -1] = True
    level = proven.argmax(axis=1) + 1
    return level, rest[np.arange(len(level)), level - 1]


def _ranked(index: Index, block: Block, k: int) -> DataFrame:
    floor = floors(index, block, k, 1, np.arange(len(block.ids)))
    level, rest = levels(index, block, floor)
    if len(more := np.flatnonzero(level > 1)):
        floor = np.maximum(floor, floors(index, block, k, 2, more))
        level, rest = levels(index, block, floor)
    pairs, n_terms, below = np.array(block.pairs, np.int64).reshape(-1, 2), len(block.vocabulary), index.below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_level = [np.flatnonzero(level == j + 1) for j in range(len(TIERS))]
        adders = [Adder(pairs, items, n_terms) for items in of_level]
        best = Best(k, len(level))
        for batch in _slices(batches, len(level)):
            n, row_ids, doc_ids = batch.num_rows, batch.column(0).to_numpy(), batch.column(1)
            nameless = doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            doc_ids = pc.fill_null(doc_ids, 0).to_numpy()
            tiers = [_postings(c) for c in batch.columns[2:]]
            for j, (items, adder) in enumerate(zip(of_level, adders)):
                if not len(items):
                    continue
                row, term, impact = (np.concatenate(x) for x in zip(*tiers[: j + 1]))
                # what is seen counts fully, what isn't by its bound
                bound = adder(n, row, term, impact - below[term, j]) + rest[items]
                able = bound >= np.maximum(floor[items], 1)
                if j + 1 < len(TIERS):
                    some = np.flatnonzero(able.any(axis=1))
                    place = np.full(n, -1)
                    place[some] = np.arange(len(some))
                    row, term, impact = (np.concatenate(x) for x in zip(*tiers))
                    own = place[row] >= 0
                    exact = adder(len(some), place[row[own]], term[own], impact[own])
                    able, ids = able[some] & (exact >= floor[items]), some
                else:
                    exact, ids = bound, np.arange(n)
                r, c = np.nonzero(able)
                best.add(items[c], exact[r, c], nameless[ids[r]], doc_ids[ids[r]], row_ids[ids[r]])
        if best.parts:
            item, score, no_id, doc, row = best.cut()
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(row), pa.array(doc, mask=no_id > 0), pa.array(score)], ["item", "row", "doc_id", "score"])

    found = index.table.select("row", "doc_id", *TIERS).mapInArrow(tidy(run), "item int, row long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = index.table.sparkSession.createDataFrame([(i, x, int(level[i])) for i, x in enumerate(block.ids)], "item int, item_id long, tiers int")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score", "tiers")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, scratch: Scratch | None = None, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of each item: (item_id, rank, doc_id, score, tiers), where tiers says how many the proof took.

    A document's score sums, over the item's distinct terms, w * (1000000000 tf div (1000 tf + 20 m)), with
    w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 50 + (50 n N div L); documents with score 0 aren't ranked.
    Ties go by doc_id, null ids last.  Rows are documents and items of their own, so repeated ones rank each;
    null and empty texts have no terms; very long texts are read whole; other columns are ignored whatever their
    names; without items or documents the result is empty.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    small_batches(spark)
    out = None
    for block in blocks(items, item_col, item_text):
        index = build(docs, list(block.vocabulary), scratch, doc_col, text_col)
        found = _ranked(index, block, k)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, tiers int")
