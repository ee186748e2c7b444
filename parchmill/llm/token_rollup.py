"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an insert
adds a document's tokens, a delete takes them away, a revised count does both.  A
rollup is a folder:

- ``totals/VERSION``: the sums after a commit, a row a group;
- ``commits/VERSION``: a small file with the batch's id, created exactly once;
- ``ledger/VERSION``: ids of all batches up to a version, which compaction gathers.

A commit adds a batch's sums to the totals of the version before, writes them as a new version and
then creates that version's commit file, which fails if it is there: of two
writers one starts again on the other's totals.  Until the file is there readers see the version
before, so a crash leaves totals as they were.  A batch whose id was committed, before
compaction or after, changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import small_batches, tidy
from .storage import materialise, ref, remove
from .tokens import CACHED, encoder

KEYS = ("source", "lang", "tokenizer")
GROUP = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def _counts(vocabulary: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            many = [len(encode(x.as_py())) // 4 for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(many, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return tidy(run, CACHED)


def count_tokens(docs: DataFrame, version: str, vocabulary: str | None = None, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` -> (doc_id, source, lang, tokenizer, n_tokens); words where no vocabulary is given.

    Null and empty texts have 0; very long ones are counted whole.  Rows are counted one by one, so repeats
    count each, and an empty table gives an empty table; nulls in a key stay; other columns are
    ignored, whatever their names.
    """
    rows = docs.select(ref(id_col).cast("long").alias("doc_id"), ref(source_col).cast("string").alias("source"), ref(lang_col).cast("string").alias("lang"), F.lit(version).alias("tokenizer"), ref(text_col).cast("string").alias("text"))
    if vocabulary is None:
        return rows.select("doc_id", *KEYS, F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"))
    small_batches(docs.sparkSession)
    return rows.mapInArrow(_counts(vocabulary), "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    """Counted documents as deltas that add them."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    """Counted documents as deltas that take them away."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old counts out, new counts in."""
    return deletes(old).unionByName(inserts(new))


def summed(rows: DataFrame) -> DataFrame:
    """One row a group; sums are taken before and after one shuffle, so a hot source costs a row a task."""
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """A rollup below one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def _listed(self, name: str) -> list[str]:
        there = self._files.exists(self._at(name))
        return sorted(x.getPath().getName() for x in self._files.listStatus(self._at(name))) if there else []

    def _commits(self) -> dict[str, list[str]]:
        """Commit files by version: the batch's id and the totals' folder.  A file without both is of no commit."""
        texts = {x: self._text(f"commits/{x}") for x in self._listed("commits") if x.isdigit()}
        return {x: t for x, t in texts.items() if len(t) == 2 and t[1]}

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max([0, *map(int, self._commits()), *(int(x) for x in self._listed("ledger") if x.isdigit())])

    def _read(self, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], GROUP)
        commit = self._commits().get(f"{version:012d}")
        folder = commit[1] if commit else f"{version:012d}"
        return self.spark.read.schema(GROUP).parquet(f"{self.path}/totals/{folder}")

    def _text(self, name: str) -> list[str]:
        stream = self._files.open(self._at(name))
        try:
            return self.spark._jvm.java.lang.String(stream.readAllBytes(), "UTF-8").split("\n")
        finally:
            stream.close()

    def committed(self, batch_id: str) -> bool:
        """Whether a batch is in the totals: one file a commit since the last compaction, and its table of ids before."""
        if any(t[0] == batch_id for t in self._commits().values()):
            return True
        ledgers = [x for x in self._listed("ledger") if x.isdigit()]
        return bool(ledgers) and not self.spark.read.schema("batch string").parquet(f"{self.path}/ledger/{ledgers[-1]}").where(F.col("batch") == batch_id).isEmpty()

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch to the totals, once: false where a batch of that id was committed before.

        The batch is summed once, also where another writer comes between.  Ids have no line ends.
        """
        if "\n" in batch_id:
            raise ValueError("a batch id with a line end")
        if self.committed(batch_id):
            return False
        batch = materialise(summed(deltas), "batch")
        while True:
            last = self.version()
            if self.committed(batch_id):
                return False
            folder = f"{last + 1:012d}-{uuid.uuid4().hex}"
            self._write(summed(self._read(last).unionByName(batch)).where("n_docs != 0 or n_tokens != 0"), f"totals/{folder}")
            if self._create(f"commits/{last + 1:012d}", f"{batch_id}\n{folder}"):
                return True
            self._remove(f"totals/{folder}")

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def _remove(self, name: str) -> None:
        remove(self.spark, f"{self.path}/{name}")

    def _create(self, name: str, text: str) -> bool:
        """A file that is there with its whole text or not at all: false where one of that name was there before.

        The text is written under a name of its own first, which then gets the name in one step that
        fails where it is taken.
        """
        own, to = self._at(f"commits/.{uuid.uuid4().hex}"), self._at(name)
        if self._files.exists(to) and name.split("/")[1] not in self._commits():
            self._remove(name)  # an empty file, which no writer of these leaves behind
        stream = self._files.create(own, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self._name(own, to)
        except Py4JJavaError:
            if self._files.exists(to):
                return False
            raise
        finally:
            self._files.delete(own, False)
        return True

    def _name(self, own, to) -> None:
        if self._files.getScheme() == "file":  # a rename of local files replaces, a link doesn't
            local = self.spark._jvm.java.io.File
            self.spark._jvm.java.nio.file.Files.createLink(local(to.toUri().getPath()).toPath(), local(own.toUri().getPath()).toPath())
            return
        options = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 1)
        options[0] = self._fs.Options.Rename.NONE
        self._fs.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(own, to, options)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) as the last commit left them; groups without documents and tokens are left out.
        Nulls in a key form a group of their own; a rollup without commits has no rows."""
        return self._read(self.version())

    def compact(self) -> None:
        """Gather the ids of all batches in one table and delete what only earlier versions need.  Totals stay, and so does every id.

        The new ledger is there before any commit file goes, so a compaction that dies leaves totals and ids as they were, and
        the next one goes on.  One writer compacts at a time, while none commits.
        """
        last, commits = self.version(), self._commits()
        name = f"{last:012d}"
        ledgers = [x for x in self._listed("ledger") if x.isdigit()]
        if commits and name not in ledgers:
            ids = self.spark.createDataFrame([(t[0],) for t in commits.values()], "batch string")
            if ledgers:
                ids = ids.union(self.spark.read.schema("batch string").parquet(f"{self.path}/ledger/{ledgers[-1]}"))
            self._write(ids, f"ledger/.{name}")
            self._write(summed(self._read(last)), f"totals/{name}")
            self._files.rename(self._at(f"ledger/.{name}"), self._at(f"ledger/{name}"))
        if not last:
            return
        for x in self._listed("commits"):
            self._remove(f"commits/{x}")
        for x in self._listed("ledger"):
            if x != name:
                self._remove(f"ledger/{x}")
        for x in self._listed("totals"):
            if x != name:
                self._remove(f"totals/{x}")
