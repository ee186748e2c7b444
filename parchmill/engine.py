"""The engine as one object over a folder of tables: translate documents, correct them, learn, report.

Tables are only appended to, a folder a run; state is resolved when read.  A run's rows
are written before anything is derived from them, so a lost executor repeats a task and
not the model's calls of the whole run.  A run that dies or is paused goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import looks_like_term
from .functions.text import checkpoint_key, is_blank
from .functions.vectors import hashed_embedding
from .operators import glossary, memory, models, validation
from .operators.blocks import assemble, bilingual, mark_references, split_markdown
from .operators.context import document_context
from .operators.jobs import pause_counts
from .operators.masking import mask_segments
from .operators.render import system_prompt, user_prompt
from .operators.segments import build_segments, source_context
from .operators.tables import convert_tables
from .storage import Scratch, remove

SEGMENT = "doc_id long, seg_no int, kind string, source_text string, translation string, issues array<struct<code:string,severity:string,message:string>>, attempts int"
LOG = "tm_id long, seq long, source string, target string, src_lang string, tgt_lang string, origin string, domain string, created_at double, embedding array<double>, embedder string"
CHECKPOINT = f"k string, seq long, t string, issues {validation.NO_ISSUES}, attempts int"
TERMS = "seq long, term string, translation string, src_lang string, tgt_lang string, notes string"


class Engine:
    """``model`` translates a masked text, or is a chat model, which gets instructions with glossary, examples, terms and summary.

    ``embed`` makes the vectors by which the memory is searched (``embedder`` is its name, stored with them): the
    ``examples`` nearest pairs, of ``least`` cosine at least, go into the instructions.
    """

    def __init__(self, spark: SparkSession, path: str, source_lang: str = "en", target_lang: str = "ru", model: models.Model | models.Chat = models.transliterate, budget: int = 4000, repairs: int = 2, embed: models.Model = hashed_embedding, embedder: str = "hash", examples: int = 3, least: float = 0.82):
        self.spark, self.path, self.model, self.budget, self.repairs = spark, path.rstrip("/"), model, budget, repairs
        self.source_lang, self.target_lang = source_lang, target_lang
        self.embed, self.embedder, self.examples, self.least = embed, embedder, examples, least

    def _rows(self, name: str, schema: str) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def _next(self) -> int:
        """A number of its own above all earlier ones: the first whose marker file this engine creates, so two writers never share one."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        folder = jvm.Path(f"{self.path}/numbers")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        number = max([0, *(int(x.getPath().getName()) for x in files.listStatus(folder) if x.getPath().getName().isdigit())]) + 1
        while True:
            try:
                files.create(jvm.Path(folder, str(number)), False).close()  # fails where the file is there
                return number
            except Py4JJavaError:
                if not files.exists(jvm.Path(folder, str(number))):
                    raise
                number += 1

    def prepare(self, docs: DataFrame) -> DataFrame:
        """Documents (doc_id, text) to masked segments."""
        clean = docs.select("doc_id", convert_tables(F.col("text")).alias("text"))
        segments = build_segments(mark_references(split_markdown(clean)), self.budget)
        return mask_segments(segments.drop("block_indices"))

    def prompts(self, segments: DataFrame, context: DataFrame | None = None, examples: DataFrame | None = None, occurring: bool = False) -> DataFrame:
        """Masked segments plus ``system``: the instructions with the glossary's terms in the segment, a document's own
        ``terms`` (with ``occurring`` only those in the segment) and ``summary`` (doc_id, summary, terms), and ``examples`` (doc_id, seg_no, examples)."""
        stored = self.terms().select("seq", "term", "translation")
        asked = segments.select(F.struct("doc_id", "seg_no").alias("text_id"), F.col("source_text").alias("text"))
        hits = glossary.match(asked, stored).groupBy("text_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term", "translation"))), lambda t: F.struct(t["term"].alias("term"), t["translation"].alias("translation"))).alias("stored"))
        rows = segments.withColumn("text_id", F.struct("doc_id", "seg_no")).join(hits, "text_id", "left").drop("text_id")
        pairs = "array<struct<term:string,translation:string>>"
        rows = rows.join(context.select("doc_id", "summary", F.col("terms").alias("own")), "doc_id", "left") if context is not None else rows.withColumn("summary", F.lit(None).cast("string")).withColumn("own", F.lit(None).cast(pairs))
        shown = "array<struct<source:string,target:string>>"
        rows = rows.join(examples.select("doc_id", "seg_no", "examples"), ["doc_id", "seg_no"], "left") if examples is not None else rows.withColumn("examples", F.lit(None).cast(shown))
        low = F.lower("source_text")
        mine = F.col("own") if not occurring else F.filter("own", lambda t: F.contains(low, F.lower(t["term"])) & glossary.bounded(F.lower(t["term"]), low, glossary.WORD))
        every = F.concat(F.coalesce(mine, F.array().cast(pairs)), F.coalesce("stored", F.array().cast(pairs)))
        # one entry a term, in any case; the document's before the stored one
        terms = F.filter(every, lambda t, i: ~F.exists(F.slice(every, F.lit(1), i), lambda x: F.lower(x["term"]) == F.lower(t["term"])))
        system = system_prompt(self.source_lang, self.target_lang, terms, F.coalesce("examples", F.array().cast(shown)), F.col("summary"))
        return rows.withColumn("system", system).drop("stored", "own", "summary", "examples")

    def retrieved(self, segments: DataFrame, context: DataFrame | None = None) -> DataFrame:
        """Segments that the memory doesn't know exactly, plus ``system`` and ``user``: what a chat model is asked.

        The memory's pairs of the language pair and the embedder that are nearest to the source become
        examples, glossary terms and the document's own terms that the source holds are listed, and
        the end of the text before goes with the segment.
        """
        state = memory.candidates(self.memory(), self.source_lang, self.target_lang, self.embedder)
        examples = None
        if not state.limit(1).isEmpty():
            ids = segments.withColumn("query_id", F.xxhash64("doc_id", "seg_no"))
            queries = Scratch(self.spark).keep(ids.select("query_id", self.embed(F.col("source_text")).alias("embedding"), F.lit("").alias("domain")), "queries")
            found = memory.nearest(queries, state, self.examples, self.least).join(state.select("tm_id", "source", "target"), "tm_id")
            listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "target"))).alias("e"))
            examples = ids.join(listed, "query_id").select("doc_id", "seg_no", F.transform("e", lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"))).alias("examples"))
        asked = self.prompts(segments, context, examples, occurring=True)
        return asked.withColumn("user", user_prompt(F.col("masked_text"), F.col("context"))).drop("context")

    def translate(self, docs: DataFrame, job_id: str, batches: int = 1, should_pause: Callable[[], bool] = lambda: False, review: models.Model | None = None, judge: models.Model | None = None, describe: models.Model | None = None, back: models.Model | None = None) -> DataFrame:
        """Translate documents; returns (doc_id, seg_no, kind, source_text, translation, issues, attempts) as stored.

        Only texts that neither the memory knows, nor an earlier segment of this run or an
        unfinished run of the same job has, reach the model.  The work is cut into ``batches``
        by text; each is written to the job's checkpoint, and between two of them ``should_pause`` is asked.
        A paused job keeps its checkpoint: the same call goes on from it, and asks anew what failed.  The checkpoint
        goes when no segment failed.  Segments with lost placeholders go out again without them, and those left in
        the source language once more; then a reviewer, a judge and a back-translator see each segment, where given.
        ``describe`` is asked for each document's summary and terms, which go into a chat model's instructions.
        """
        seq = self._next()
        pair = [F.lit(self.source_lang).alias("src_lang"), F.lit(self.target_lang).alias("tgt_lang")]
        known = Scratch(self.spark).keep(memory.exact_matches(source_context(self.prepare(docs)).select("*", *pair), self.memory()), "known")
        context = Scratch(self.spark).keep(document_context(docs, describe, self.source_lang, self.target_lang), "contexts") if describe is not None else None
        columns = [c.split()[0] for c in SEGMENT.replace("struct<code:string,severity:string,message:string>", "x").split(", ")]
        passed = known.where("kind != 'translate'").select("doc_id", "seg_no", "kind", "source_text", F.lit(None).cast("string").alias("translation"), F.array().cast(validation.NO_ISSUES).alias("issues"), F.lit(0).alias("attempts"))
        exact = known.where("kind = 'translate' and exact_target is not null").select("doc_id", "seg_no", "kind", "source_text", F.col("exact_target").alias("translation"), validation.issue(F.lit(True), "tm_exact", "info", "known to the translation memory").alias("issues"), F.lit(0).alias("attempts"))
        new = known.where("kind = 'translate' and exact_target is null").select("doc_id", "seg_no", "kind", "source_text", "masked_text", "placeholders", "context")
        _, placed = memory.deduplicate(new, ["doc_id", "seg_no"])
        placed = placed.withColumn("k", checkpoint_key(F.col("source_text"), *[F.lit(x) for x in (self.source_lang, self.target_lang)]))
        firsts = placed.where("not is_copy").drop("first", "copies", "is_copy")
        for number in range(batches):
            before = self._answers(job_id, seq)
            todo = memory.pending(firsts, before).where(F.pmod(F.xxhash64("k"), F.lit(batches)) == number)
            if number and should_pause():
                left = memory.pending(firsts, before)
                said = validation.issue(F.lit(True), "paused", "info", "the job was paused before this segment")
                rows = left.select("doc_id", "seg_no", "kind", "source_text", F.lit(None).cast("string").alias("translation"), said.alias("issues"), F.lit(0).alias("attempts"))
                stored = passed.unionByName(exact).unionByName(rows).unionByName(self._resumed(firsts, before, seq))
                self._put(stored.select(*columns), job_id, seq)
                return self._end(job_id, seq, "paused")
            self._checkpoint(todo, job_id, seq, number, context)
        done = self._resumed(firsts, self._answers(job_id, seq), seq)
        if review is not None or judge is not None or back is not None:
            done = self._judged(done, firsts, review, judge, back)
        fine = validation.is_ok(F.col("issues"))
        reused = F.when(fine, validation.issue(F.lit(True), "dedup", "info", "translated once for equal segments of this run")).otherwise(F.col("issues"))
        copies = placed.where("is_copy").select("doc_id", "seg_no", "kind", "source_text").join(done.select("source_text", "translation", reused.alias("issues"), F.when(fine, 0).otherwise(F.col("attempts")).alias("attempts")), "source_text")
        self._put(passed.unionByName(exact).unionByName(done.select(*columns)).unionByName(copies).select(*columns), job_id, seq)
        stored = self.segments(job_id)
        self._learn(stored, seq)
        status = self.report(job_id).agg(F.when(F.coalesce(F.max("segments_failed"), F.lit(0)) == 0, "completed").otherwise("partial")).first()[0]
        if status == "completed":
            remove(self.spark, f"{self.path}/checkpoint/{job_id}")
        return self._end(job_id, seq, status)

    def _answers(self, job_id: str, seq: int) -> DataFrame:
        """The checkpoint's best answer for each key that this run needn't ask: good ones of any run, and its own."""
        best = memory.settled(self._rows(f"checkpoint/{job_id}", CHECKPOINT), validation.is_ok(F.col("issues")))
        return best.where(F.col("ok") | (F.col("seq") == seq))

    def _checkpoint(self, todo: DataFrame, job_id: str, seq: int, number: int, context: DataFrame | None = None) -> None:
        """Translate the segments of a batch and write them to the job's checkpoint, failed ones too: they tell why a segment failed."""
        pair = (self.source_lang, self.target_lang)
        if isinstance(self.model, models.Chat):
            todo = Scratch(self.spark).keep(self.retrieved(todo, context), "prompts")
        first = models.translate(todo, self.model, *pair, self.repairs)
        again = models.retranslate_residual(models.rescue(first, self.model, *pair), self.model, *pair)
        rows = again.select("k", F.lit(seq).cast("long").alias("seq"), F.col("translation").alias("t"), "issues", "attempts")
        rows.write.mode("overwrite").parquet(f"{self.path}/checkpoint/{job_id}/run={seq}-{number}")

    def _resumed(self, firsts: DataFrame, answers: DataFrame, seq: int) -> DataFrame:
        """Segments with their translations of the checkpoint; those of earlier runs are marked and cost no calls now."""
        old = F.col("seq") != seq
        issues = F.when(old, validation.issue(F.lit(True), "resumed", "info", "kept from an earlier run of the job")).otherwise(F.col("issues"))
        return firsts.join(answers, "k").select("doc_id", "seg_no", "kind", "source_text", F.col("t").alias("translation"), issues.alias("issues"), F.when(old, 0).otherwise(F.col("attempts")).alias("attempts"))

    def _judged(self, done: DataFrame, firsts: DataFrame, review: models.Model | None, judge: models.Model | None, back: models.Model | None) -> DataFrame:
        """Segments after a reviewer (a JSON verdict), a judge (a JSON score) and a back-translator, each asked once a segment."""
        rows = done.join(firsts.select("doc_id", "seg_no", "masked_text", "placeholders"), ["doc_id", "seg_no"])
        said = F.concat(F.col("source_text"), F.lit("\n---\n"), F.coalesce("translation", F.lit("")))
        if review is not None:
            rows = Scratch(self.spark).keep(rows.withColumn("verdict", review(said)), "verdicts")
            rows = models.apply_review(rows, self.source_lang, self.target_lang).drop("verdict")
        if judge is not None:
            rows = Scratch(self.spark).keep(rows.withColumn("answer", judge(said)), "scores")
            rows = models.judge(rows).drop("answer", "score")
        if back is not None:
            asked = rows.where(~is_blank(F.col("translation"))).select("doc_id", "seg_no", "source_text", back(F.col("translation")).alias("again"))
            vectors = asked.select("doc_id", "seg_no", self.embed(F.col("source_text")).alias("a"), self.embed(F.coalesce("again", F.lit(""))).alias("b"))
            far = models.back_translation(Scratch(self.spark).keep(vectors, "back").withColumn("issues", F.array().cast(validation.NO_ISSUES)), "a", "b")
            rows = rows.join(far.select("doc_id", "seg_no", F.col("issues").alias("more")), ["doc_id", "seg_no"], "left").withColumn("issues", F.concat("issues", F.coalesce("more", F.array().cast(validation.NO_ISSUES)))).drop("more")
        return rows.select(*done.columns)

    def _put(self, rows: DataFrame, job_id: str, seq: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/segments/{job_id}/run={seq}")

    def _end(self, job_id: str, seq: int, status: str) -> DataFrame:
        rows = self.segments(job_id)
        ended = rows.agg(F.lit(job_id).alias("job_id"), F.lit(seq).cast("long").alias("seq"), F.lit(status).alias("status"), F.count_distinct("doc_id").alias("documents"))
        ended.write.mode("append").parquet(f"{self.path}/runs")
        return rows

    def pending(self, job_id: str) -> dict[str, int]:
        """How many segments of a job are done and pending."""
        return pause_counts(self.segments(job_id).withColumn("job_id", F.lit(job_id))).select("done", "pending").first().asDict()

    def _learn(self, stored: DataFrame, seq: int) -> None:
        pairs = validation.learnable(stored).where(~validation.has_code(F.col("issues"), "dedup")).groupBy("source_text").agg(F.min("translation").alias("target"))
        self._remember(pairs.select(F.col("source_text").alias("source"), "target"), seq, "auto")

    def _remember(self, pairs: DataFrame, seq: int, origin: str) -> None:
        rows = pairs.select(F.xxhash64("source", F.lit(seq)).alias("tm_id"), F.lit(seq).cast("long").alias("seq"), "source", "target", F.lit(self.source_lang).alias("src_lang"), F.lit(self.target_lang).alias("tgt_lang"), F.lit(origin).alias("origin"), F.lit("").alias("domain"), F.lit(float(seq)).alias("created_at"), self.embed(F.col("source")).alias("embedding"), F.lit(self.embedder).alias("embedder"))
        rows.write.mode("append").parquet(f"{self.path}/memory")

    def memory(self) -> DataFrame:
        return memory.resolve(self._rows("memory", LOG), "seq")

    def tm_stats(self) -> dict[str, int]:
        return memory.stats(self.memory()).first().asDict()

    def add_correction(self, source: str, corrected: str) -> None:
        """A person's translation; a short one becomes a glossary term too."""
        pair = self.spark.createDataFrame([(source, corrected)], "source string, target string").where(~is_blank(F.col("source")) & ~is_blank(F.col("target")))
        self._remember(pair, self._next(), "human")
        if pair.where(looks_like_term(F.col("source")) & looks_like_term(F.col("target"))).count():
            self.add_term(source.strip(), corrected.strip())

    def add_term(self, term: str, translation: str, notes: str | None = None) -> None:
        seq = (self._rows("glossary", TERMS).agg(F.max("seq")).first()[0] or 0) + 1
        self.spark.createDataFrame([(seq, term, translation, self.source_lang, self.target_lang, notes)], TERMS).write.mode("append").parquet(f"{self.path}/glossary")

    def terms(self) -> DataFrame:
        return glossary.listed(glossary.upsert(self._rows("glossary", TERMS)), self.source_lang, self.target_lang)

    def segments(self, job_id: str) -> DataFrame:
        """The segments of the job's last run."""
        rows = self.spark.read.schema(SEGMENT).option("recursiveFileLookup", "true").parquet(f"{self.path}/segments/{job_id}")
        run = F.regexp_extract(F.col("_metadata.file_path"), "/run=([0-9]+)/", 1).cast("long")
        last = rows.select(run.alias("run")).agg(F.max("run")).first()[0]
        return rows.where(run == last) if last is not None else rows

    def report(self, job_id: str) -> DataFrame:
        return validation.document_report(self.segments(job_id))

    def documents(self, job_id: str, corrections: DataFrame | None = None) -> DataFrame:
        """(doc_id, markdown); ``corrections`` (doc_id, seg_no, corrected) win over translations."""
        rows = self.segments(job_id)
        fixed = rows.join(corrections.select("doc_id", "seg_no", "corrected"), ["doc_id", "seg_no"], "left") if corrections is not None else rows.withColumn("corrected", F.lit(None).cast("string"))
        final = validation.final_text(F.col("kind"), F.col("source_text"), F.col("translation"), F.col("issues"), F.col("corrected"))
        return assemble(fixed.withColumn("final", final), "doc_id", "seg_no", "final")

    def bilingual(self, job_id: str) -> DataFrame:
        return bilingual(self.segments(job_id), "doc_id", "seg_no", "source_text", "translation", "kind")

    def jobs(self, limit: int = 100) -> DataFrame:
        return self._rows("runs", "job_id string, seq long, status string, documents long").orderBy(F.desc("seq")).limit(limit)
