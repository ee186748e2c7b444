"""Translation memory: an append log, its resolved state, exact lookup and similarity search.

The log has (tm_id, source, target, src_lang, tgt_lang, origin, created_at, ...).  Parquet
tables aren't updated in place, so additions are appended and the state is resolved
when read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_key, is_blank
from ..functions.vectors import cosine
from ..storage import Scratch

KEY = ["source_hash", "src_lang", "tgt_lang"]
#: Queries that a task holds, and rows of the memory that it streams past them.
BLOCK_ROWS, PART_ROWS = 4000, 100_000


def keyed(log: DataFrame) -> DataFrame:
    """The log without blank pairs, with the key of its source."""
    good = log.where(~is_blank(F.col("source")) & ~is_blank(F.col("target")))
    return good.withColumn("source_hash", content_key(F.col("source")))


def resolve(log: DataFrame, order: str = "tm_id") -> DataFrame:
    """The state after all additions: an addition replaces automatic rows of its key; human rows stay."""
    later = F.lead(F.col(order)).over(Window.partitionBy(*KEY).orderBy(order))
    return keyed(log).withColumn("__later", later).where(F.col("__later").isNull() | (F.col("origin") == "human")).drop("__later")


def best_by_key(state: DataFrame) -> DataFrame:
    """One row a key: human before automatic, then the newest, then the smallest id."""
    rank = F.struct((F.col("origin") == "human").cast("int").alias("h"), F.col("created_at").alias("c"), (-F.col("tm_id")).alias("i"))
    return state.groupBy(*KEY).agg(F.max_by(F.struct("tm_id", "target", "origin"), rank).alias("best")).select(*KEY, "best.*")


def exact_matches(queries: DataFrame, state: DataFrame, text: str = "source_text") -> DataFrame:
    """``queries`` (with src_lang, tgt_lang) plus ``exact_id`` and ``exact_target``, null without a match.  One equi-join."""
    best = best_by_key(state).select(*KEY, F.col("tm_id").alias("exact_id"), F.col("target").alias("exact_target"))
    return queries.withColumn("source_hash", content_key(F.col(text))).join(best, KEY, "left").select(*queries.columns, "exact_id", "exact_target")


def stats(state: DataFrame, *groups: str) -> DataFrame:
    return state.groupBy(*groups).agg(F.count("*").alias("segments"), F.count_if(F.col("origin") == "human").alias("human_corrections"))


def candidates(state: DataFrame, src_lang: str, tgt_lang: str, embedder: str | None = None, dim: int | None = None) -> DataFrame:
    """The rows of a memory that a search may find: those of a language pair, of an embedder and of its dimension."""
    rows = state.where((F.col("src_lang") == src_lang) & (F.col("tgt_lang") == tgt_lang) & F.col("embedding").isNotNull())
    rows = rows.where(F.col("embedder") == embedder) if embedder is not None else rows
    return rows.where(F.size("embedding") == dim) if dim is not None else rows


def _search(k: int, least: float) -> Callable:
    """Rows (block, part, kind, id, embedding, domain, human) sorted -> for each query of a block its best k of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, held = None, {}, {}

        def done() -> Iterator[pa.RecordBatch]:
            for frame in held.values():
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

        for batch in batches:
            frame = batch.to_pandas()
            for name, rows in frame.groupby(["block", "part"], sort=False):
                if name != at:
                    yield from done()
                    at, block, held = name, {}, {}
                for dim, members in rows[rows["kind"] == 0].groupby(rows["embedding"].map(len)):
                    block.setdefault(dim, []).append(members)
                for dim, members in rows[rows["kind"] == 1].groupby(rows["embedding"].map(len)):
                    if dim not in block:
                        continue
                    own = block[dim] = [pd.concat(block[dim])]
                    if (found := _best(own[0], members, held.get(dim), k, least)) is not None:
                        held[dim] = found
        yield from done()

    return run


def _unit(rows: pd.Series) -> np.ndarray:
    matrix = np.vstack(rows.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _best(queries: pd.DataFrame, rows: pd.DataFrame, held: pd.DataFrame | None, k: int, least: float) -> pd.DataFrame | None:
    """The best k rows of each query among those held and new ones of the same dimension."""
    similarity = _unit(queries["embedding"]) @ _unit(rows["embedding"]).T
    mine, theirs = queries["domain"].to_numpy(object), rows["domain"].to_numpy(object)
    open_ = (theirs == "")[None, :] | (mine == "")[:, None] | (mine[:, None] == theirs[None, :])
    q, m = np.nonzero((similarity >= least - 1e-12) & open_)
    found = pd.DataFrame({"query_id": queries["id"].to_numpy()[q], "tm_id": rows["id"].to_numpy()[m], "human": rows["human"].to_numpy()[m], "similarity": similarity[q, m]})
    found = found if held is None else pd.concat([held, found])
    return found.sort_values(["query_id", "human", "similarity", "tm_id"], ascending=[True, False, False, True]).groupby("query_id").head(k) if len(found) else held


def nearest(queries: DataFrame, state: DataFrame, k: int = 3, least: float = 0.82, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Exact top k by cosine: (query_id, tm_id, human, similarity, rank).

    ``queries``: (query_id, embedding, domain: empty for any), a stated set with one row an id; ``state``:
    (tm_id, embedding, domain, origin).  Human rows come first, then the most similar,
    then the smallest id.  Queries are dealt over blocks and the memory over parts, by
    hashes of their ids; each block meets each part in one task, which holds the block,
    streams the part and keeps its best k, and only those meet in a shuffle.  Empty vectors find
    nothing; vectors of other dimensions don't meet.
    """
    shape = lambda df, name, human: df.select(F.col(name).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce("domain", F.lit("")).alias("domain"), human.alias("human")).where("size(embedding) > 0")
    asked, kept = shape(queries, "query_id", F.lit(False)), shape(state, "tm_id", F.coalesce(F.col("origin") == "human", F.lit(False)))
    blocks, parts = (max(1, -(-df.count() // rows)) for df, rows in ((asked, block_rows), (kept, part_rows)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["block", "part", "kind", "id", "embedding", "domain", "human"]
    loaded = asked.withColumn("block", dealt(blocks)).withColumn("part", every(parts)).withColumn("kind", F.lit(0)).select(*columns)
    streamed = kept.withColumn("part", dealt(parts)).withColumn("block", every(blocks)).withColumn("kind", F.lit(1)).select(*columns)
    met = loaded.unionByName(streamed).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
    found = met.mapInArrow(_search(k, least), "query_id long, tm_id long, human boolean, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("human"), F.desc("similarity"), "tm_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Clusters at most: their pivots and radii are held by the driver and by every task.
CLUSTERS = 1024


class Clusters:
    """A memory dealt into clusters around pivots, for exact searches that skip clusters.

    The angle between vectors is a metric: no row of a cluster is nearer to a query than the query's angle to the pivot less
    the cluster's radius.  A search first goes to each query's nearest cluster, whose best k are its floors, and then
    to those clusters alone that can hold a row above them.  Human and other rows have radii and floors of their own, as human rows
    come first whatever their similarity.  ``table`` is written by cluster; pivots are the rows with the smallest hashes of
    their ids, about the root of the memory's size.
    """

    def __init__(self, state: DataFrame, scratch: Scratch, most: int = CLUSTERS, part_rows: int = PART_ROWS):
        self.spark, self.scratch, self.part_rows = state.sparkSession, scratch, part_rows
        rows = _vectors(state, "tm_id", F.coalesce(F.col("origin") == "human", F.lit(False)))
        self.rows = rows.count()
        chosen = rows.orderBy(F.xxhash64("id"), "id").limit(min(most, math.ceil(math.sqrt(self.rows)))).select("embedding").collect()
        self.pivots: dict[int, tuple[int, np.ndarray]] = {}  # by dimension: the first cluster's number, unit vectors
        first = 0
        for dim in sorted({len(r["embedding"]) for r in chosen}):
            own = _unit(pd.Series([r["embedding"] for r in chosen if len(r["embedding"]) == dim]))
            self.pivots[dim] = first, own
            first += len(own)
        self.loose = first  # rows of dimensions without a pivot: a cluster without bounds
        table = rows.withColumn("__a", self._angles(True)).select("*", "__a.cluster", "__a.angle").drop("__a")
        self.table = scratch.keep(table.repartition("cluster").sortWithinPartitions("cluster"), "clusters")
        shapes = self.table.groupBy("cluster").agg(F.count("*").alias("many"), *[F.max(F.when(F.col("human") == h, F.col("angle"))).alias(n) for h, n in ((True, "people"), (False, "machines"))]).collect()  # a row a cluster
        self.many = {r["cluster"]: r["many"] for r in shapes}
        # a radius below any angle's range says that there are no such rows
        self.radii = np.full((first + 1, 2), -10.0)
        for r in shapes:
            self.radii[r["cluster"]] = [-10.0 if x is None else x for x in (r["people"], r["machines"])]

    def _angles(self, nearest: bool) -> Column:
        """Of a vector: its nearest cluster and the angle to that pivot, or the angles to all clusters (null without a pivot)."""
        pivots, loose = self.pivots, self.loose

        def angles(vectors: pd.Series) -> Iterator[tuple[pd.Index, int, np.ndarray]]:
            for dim, members in vectors.groupby(vectors.map(len)):
                first, own = pivots.get(dim, (loose, np.zeros((0, dim))))
                yield members.index, first, np.arccos(np.clip(_unit(members) @ own.T, -1.0, 1.0))

        @F.pandas_udf("cluster int, angle double")
        def assign(vectors: pd.Series) -> pd.DataFrame:
            out = pd.DataFrame({"cluster": loose, "angle": 4.0}, index=vectors.index)
            for index, first, found in angles(vectors):
                if found.shape[1]:
                    out.loc[index, "cluster"], out.loc[index, "angle"] = first + found.argmin(axis=1), found.min(axis=1)
            return out

        @F.pandas_udf("array<struct<cluster:int,angle:double>>")
        def all_of(vectors: pd.Series) -> pd.Series:
            out = pd.Series([[]] * len(vectors), index=vectors.index, dtype=object)
            for index, first, found in angles(vectors):
                for i, row in zip(index, found):
                    out[i] = [{"cluster": first + j, "angle": float(x)} for j, x in enumerate(row)]
            return out

        return (assign if nearest else all_of)(F.col("embedding"))

    def search(self, queries: DataFrame, k: int = 3, least: float = 0.82, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
        """The result of :func:`nearest`, and (query_id, pairs): how many rows of the memory each query met."""
        asked = _vectors(queries, "query_id", F.lit(False))
        blocks = max(1, -(-asked.count() // block_rows))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        asked = self.scratch.keep(asked.withColumn("clusters", F.array_append(self._angles(False), F.struct(F.lit(self.loose).alias("cluster"), F.lit(0.0).alias("angle")))), "asked")
        first = asked.select("*", F.array_min(F.transform("clusters", lambda c: F.struct(F.when(c["cluster"] == self.loose, 9.0).otherwise(c["angle"]).alias("angle"), c["cluster"].alias("cluster"))))["cluster"].alias("cluster")).drop("clusters")
        found = self.scratch.keep(self._met(first, k, least), "nearest")
        # floors: a machine's row must beat the k-th row, a human one the k-th human row
        rank = lambda *by: F.row_number().over(Window.partitionBy("query_id").orderBy(*by, F.desc("similarity"), "tm_id"))
        ranked = found.withColumn("rank", rank(F.desc("human"))).where(F.col("rank") == k)
        floor = ranked.select("query_id", F.when(F.col("human"), F.col("similarity")).alias("people"), F.when(F.col("human"), 2.0).otherwise(F.col("similarity")).alias("machines"))
        bounds = F.from_json(F.lit(json.dumps(self.radii.tolist())), "array<array<double>>")
        open_ = first.select(F.col("id").alias("query_id"), F.col("cluster").alias("done")).join(floor, "query_id", "left")
        rest = asked.join(open_.withColumnRenamed("query_id", "id"), "id").withColumn("radii", bounds).select("*", F.explode("clusters").alias("c"))

        def able(kind: int, floor: str) -> Column:
            radius = F.get(F.get("radii", F.col("c.cluster")), F.lit(kind))
            bound = F.cos(F.greatest(F.col("c.angle") - radius, F.lit(0.0)))
            return (radius > -5) & (F.least(bound, F.lit(1.0)) >= F.greatest(F.coalesce(floor, F.lit(-2.0)), F.lit(least)) - 1e-9)

        loose = (F.col("c.cluster") == self.loose) & F.lit(self.loose in self.many)
        rest = rest.where((F.col("c.cluster") != F.col("done")) & (loose | able(0, "people") | able(1, "machines")))
        rest = self.scratch.keep(rest.select("id", "embedding", "domain", "human", "block", "c.cluster"), "open")
        every = found.unionByName(self._met(rest, k, least))
        order = rank(F.desc("human"))
        counts = self.spark.createDataFrame([(c, n) for c, n in self.many.items()], "cluster int, many long")
        pairs = first.select("id", "cluster").unionByName(rest.select("id", "cluster")).join(F.broadcast(counts), "cluster").groupBy(F.col("id").alias("query_id")).agg(F.sum("many").alias("pairs"))  # a row a cluster
        return every.withColumn("rank", order).where(F.col("rank") <= k), pairs

    def _met(self, asked: DataFrame, k: int, least: float) -> DataFrame:
        """Queries and the clusters they go to -> their best k of each part of a cluster; large clusters are dealt over parts."""
        salts = F.element_at(F.create_map(*[F.lit(x) for c, n in (self.many or {0: 1}).items() for x in (c, max(1, -(-n // self.part_rows)))]), F.col("cluster"))
        part = lambda salt: F.concat_ws("-", F.col("cluster").cast("string"), salt.cast("string"))
        columns = ["block", "part", "kind", "id", "embedding", "domain", "human"]
        loaded = asked.where(salts.isNotNull()).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("part", part(F.col("salt"))).withColumn("kind", F.lit(0)).select(*columns)
        wanted = asked.select("block", "cluster").distinct()
        streamed = self.table.join(wanted, "cluster").withColumn("part", part(F.pmod(F.xxhash64("id"), salts))).withColumn("kind", F.lit(1)).select(*columns)
        met = loaded.unionByName(streamed).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
        return met.mapInArrow(_search(k, least), "query_id long, tm_id long, human boolean, similarity double")


def _vectors(rows: DataFrame, name: str, human: Column) -> DataFrame:
    """(id, embedding, domain, human) of rows with a vector."""
    return rows.select(F.col(name).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce("domain", F.lit("")).alias("domain"), human.alias("human")).where("size(embedding) > 0")


def pair_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cosine of two columns of one row, in the JVM."""
    return pairs.withColumn("similarity", cosine(F.col(a), F.col(b)))


def retrieve(queries: DataFrame, state: DataFrame, glossary_hits: DataFrame, neighbours: DataFrame, text: str = "source_text") -> DataFrame:
    """Per query: the exact match, or else examples and glossary terms.

    Examples and terms are only looked up for the rest: the exact join comes first and an
    anti-join keeps its hits from the costly ones.
    """
    exact = exact_matches(queries, state, text)
    rest = exact.where("exact_target is null").select("query_id")
    examples = neighbours.join(rest, "query_id", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "tm_id"))).alias("e"))
    terms = glossary_hits.join(rest, "query_id", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    joined = exact.join(examples, "query_id", "left").join(terms, "query_id", "left")
    listed = lambda c, f: F.coalesce(F.transform(F.col(c), lambda x: x[f].cast("string")), F.array().cast("array<string>"))
    return joined.select(*queries.columns, "exact_id", "exact_target", listed("e", "tm_id").alias("examples"), listed("t", "term").alias("terms"))


def first_source(cached, checkpoint, exact, model):
    """Translation and where it comes from: this run, the checkpoint, the memory, the model."""
    names = [(cached, "run_cache"), (checkpoint, "checkpoint"), (exact, "memory"), (model, "model")]
    origin = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for c, n in names])
    return F.coalesce(*[c for c, _ in names]), origin


def deduplicate(segments: DataFrame, order: list[str], text: str = "source_text") -> tuple[DataFrame, DataFrame]:
    """(distinct texts with their first place, all segments with that place and ``is_copy``).

    A text shared by a third of all rows costs a row a task before the shuffle: the first
    place is a partial minimum, and the join back can be split.
    """
    place = F.struct(*order)
    first = segments.groupBy(text).agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    back = segments.join(first, text)
    return first.select(text, "first.*", "copies"), back.select(*segments.columns, "first", "copies", (F.col("first") != place).alias("is_copy"))


def settled(checkpoint: DataFrame, ok: Column, order: str = "seq", key: str = "k") -> DataFrame:
    """The best answer of each key of an append-only checkpoint: a good one before a failed one, then the latest; with ``ok``.

    One partial maximum a key, so a key that was answered again and again costs one row a task.
    """
    good = F.coalesce(ok, F.lit(False))
    answer = F.struct(*[c for c in checkpoint.columns if c != key], good.alias("ok"))
    return checkpoint.groupBy(key).agg(F.max_by(answer, F.struct(good.cast("int").alias("ok"), F.col(order).alias("at"))).alias("__best")).select(key, "__best.*")


def pending(segments: DataFrame, checkpoint: DataFrame, key: str = "k") -> DataFrame:
    """Segments that a checkpoint has no translation for; failed answers must be left out of it (:func:`settled`)."""
    return segments.join(checkpoint.select(key), key, "left_anti")


def dataset_rows(state: DataFrame) -> DataFrame:
    """One JSON line a stored pair."""
    return state.select(F.to_json(F.struct("source", "target", "src_lang", "tgt_lang", "origin")).alias("value"))


def chat_rows(state: DataFrame, system: str, human_weight: int = 3) -> DataFrame:
    """One JSON line a training example; human pairs are repeated."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    example = F.to_json(F.struct(F.array(message("system", F.lit(system)), message("user", F.col("source")), message("assistant", F.col("target"))).alias("messages")))
    times = F.sequence(F.lit(1), F.when(F.col("origin") == "human", human_weight).otherwise(1))
    return state.select("*", F.explode(times).alias("copy")).select("tm_id", "copy", example.alias("value"))


def numbered(rows: DataFrame, order: str, name: str = "total") -> DataFrame:
    """``rows`` plus their place in an order, from 1, without one task for all: ranges of the order are numbered apart.

    The ranges are written first, so that a repeated task finds them as they were.
    """
    ranged = Scratch(rows.sparkSession).keep(rows.repartitionByRange(order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return ranged.withColumn("__place", place).join(starts, "__range").select(*rows.columns, (F.col("__before") + F.col("__place")).alias(name))


def export_due(total, last, every: int):
    """Whether the memory has passed another multiple of ``every`` since the last export."""
    return (F.floor(total / every) > F.floor(last / every)) if every > 0 else F.lit(False)


def with_domain(state: DataFrame) -> DataFrame:
    """Older files have no domain column; theirs is empty."""
    return state.withColumn("domain", F.coalesce("domain", F.lit(""))) if "domain" in state.columns else state.withColumn("domain", F.lit(""))
