"""Text models inside plans: the interface, a deterministic model, and loops of bounded length.

A model takes a column of prompts to a column of answers.  In tests it is a Catalyst
expression; a real one is an iterator UDF that loads its client once a worker.  A UDF inside
``when`` or ``coalesce`` is evaluated for all rows, so rows that need a call are filtered
out first, and each pass is written to the shared folder before the next one reads it: a
segment is asked as often as its ``attempts`` say (and again only where a task is repeated).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.latex import formula_problems
from ..functions.semi import object_variant
from ..functions.semi import score as parsed_score
from ..functions.text import content_preserved, contains_normalized, is_blank, letter_count, residual_source_ratio, strip, strip_fence
from ..functions.vectors import cosine
from ..storage import Scratch
from .masking import placeholder_issues, unmask
from .validation import has_code, is_ok, issue, segment_issues

Model = Callable[[Column], Column]
#: Latin letters and the Cyrillic ones that the deterministic model puts for them.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстуввжыз"


class Client(Protocol):
    def chat(self, prompt: str) -> str: ...


class ChatClient(Protocol):
    def chat(self, system: str, prompt: str) -> str: ...


@dataclass(frozen=True)
class Chat:
    """A model that also gets instructions: a column of them and one of prompts, to struct(answer, error)."""

    call: Callable[[Column, Column], Column]


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


def transliterate(text: Column) -> Column:
    return F.translate(F.lower(text), LATIN, CYRILLIC)


def canned(answers: dict[str, str], otherwise: Model = transliterate) -> Model:
    """A model with fixed answers to some prompts."""
    table = F.create_map(*[F.lit(x) for pair in answers.items() for x in pair]) if answers else None
    return (lambda p: F.coalesce(F.element_at(table, p), otherwise(p))) if answers else otherwise


ANSWER = "answer string, error string"


class _Clients:
    """A worker's clients, made when first asked."""

    def __init__(self, makes: tuple[Callable[[], object], ...]):
        self.makes, self.made = makes, {}

    def ask(self, *parts: str | None) -> tuple[str | None, str | None]:
        """The first answer of a client and, without any, the last failure."""
        error = None
        for k, make in enumerate(self.makes if parts[-1] is not None else ()):
            try:
                if k not in self.made:
                    self.made[k] = make()
                if (said := self.made[k].chat(*parts)) is not None:
                    return said, None
            except Exception as failure:  # noqa: BLE001 - one failed call must not fail the job; the next client is asked
                error = f"{type(failure).__name__}: {failure}"
        return None, error


def from_client(*makes: Callable[[], Client], errors: bool = False) -> Model:
    """A model from client factories: the first client that answers a prompt, each asked only where those before it failed.

    A worker makes a client when it first asks it.  A failed call is null; with ``errors`` the model gives
    struct(answer, error), and the loops below turn an error into an issue of the segment.
    """
    if errors:

        @F.pandas_udf(ANSWER)
        def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            clients = _Clients(makes)
            for batch in batches:
                yield pd.DataFrame([clients.ask(x) for x in batch], columns=["answer", "error"], dtype=object)

    else:

        @F.pandas_udf("string")
        def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            clients = _Clients(makes)
            for batch in batches:
                yield batch.map(lambda x: clients.ask(x)[0])

    once = call.asNondeterministic()  # never evaluated twice for one row of a plan
    return lambda prompt: once(prompt)


def from_chat(*makes: Callable[[], ChatClient]) -> Chat:
    """A chat model from client factories, tried one after another as by :func:`from_client`."""

    @F.pandas_udf(ANSWER)
    def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        clients = _Clients(makes)
        for system, prompt in batches:
            yield pd.DataFrame([clients.ask(*x) for x in zip(system, prompt)], columns=["answer", "error"], dtype=object)

    once = call.asNondeterministic()
    return Chat(lambda system, prompt: once(system, prompt))


def asked(rows: DataFrame, model: Model | Chat, prompt: Column, scratch: Scratch, name: str = "raw") -> DataFrame:
    """``rows`` plus the model's answer and ``error`` (null where the call went well or the model tells none), written: each row is asked once.

    A chat model gets the column ``system`` too.
    """
    value = model.call(F.col("system"), prompt) if isinstance(model, Chat) else model(prompt)
    said = scratch.keep(rows.withColumn(name, value), "answers")
    if isinstance(said.schema[name].dataType, StructType):
        return said.withColumn("error", F.col(name)["error"]).withColumn(name, F.col(name)["answer"])
    return said.withColumn("error", F.lit(None).cast("string"))


def from_embedder(make: Callable[[], Embedder], tries: int = 3, wait: float = 1.0) -> Model:
    """A model from an embedder factory; a batch is tried some times, and must give a vector for each text."""

    @F.pandas_udf("array<double>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()

        def ask(texts: list[str]) -> list[list[float]]:
            for left in range(tries, 0, -1):
                try:
                    found = embedder.embed(texts)
                    if len(found) != len(texts):
                        raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
                    return found
                except Exception:
                    if left == 1:
                        raise
                    time.sleep(wait * 2 ** (tries - left))
            return []

        for batch in batches:
            yield pd.Series(ask(batch.fillna("").tolist()) if len(batch) else [], dtype=object)

    once = call.asNondeterministic()
    return lambda text: once(text)


def chain(*models: Model) -> Model:
    """The first of some models that are Catalyst expressions; clients go into one :func:`from_client`."""
    return lambda prompt: F.coalesce(*[m(prompt) for m in models])


def finalize(rows: DataFrame, source_lang: str, target_lang: str, raw: str = "raw") -> DataFrame:
    """A raw answer unfenced, unmasked and checked: ``translation`` and ``issues``."""
    bare = rows.withColumn("__a", strip_fence(strip(F.col(raw))))
    back = unmask(bare, "__a", "placeholders")
    checks = segment_issues(F.col("source_text"), F.col("restored"), source_lang, target_lang, F.col("masked_text"))
    found = F.concat(placeholder_issues(F.col("missing"), F.col("unknown")), checks)
    if "error" in rows.columns:
        failed = issue(F.lit(True), "exception", "error", F.concat(F.lit("the model's call failed: "), F.left("error", F.lit(300))))
        found = F.when(F.col(raw).isNull() & F.col("error").isNotNull(), failed).otherwise(found)
    kept = [c for c in rows.columns if c not in ("issues", "translation", "error")]
    # through a generator, so that filters on the issues aren't pushed below and evaluated anew
    return back.select(*kept, F.inline(F.array(F.struct(found.alias("issues"), F.col("restored").alias("translation")))))


def translate(segments: DataFrame, model: Model | Chat, source_lang: str, target_lang: str, repairs: int = 2) -> DataFrame:
    """Translate masked segments; failing ones are asked again with their issues, ``repairs`` times at most.

    ``attempts`` counts the calls.  A segment whose answer repeats and still fails isn't
    asked again.  Each pass only sends the rows that fail, and is written before it is judged.
    The prompt is the masked text, or the column ``user`` where there is one; a chat model gets ``system`` too.
    """
    scratch = Scratch(segments.sparkSession)
    own = F.col("user") if "user" in segments.columns else F.col("masked_text")

    def called(rows: DataFrame, prompt: Column, attempts: Column) -> DataFrame:
        return asked(rows.withColumn("attempts", attempts), model, prompt, scratch)

    first = called(segments, own, F.lit(1)).withColumn("__stuck", F.lit(False))
    state = scratch.keep(finalize(first, source_lang, target_lang), "judged")
    settled = []
    for _ in range(repairs):
        again = ~is_ok(F.col("issues")) & ~F.col("__stuck")
        failing = state.where(again)
        if failing.isEmpty():
            break
        settled.append(state.where(~again))
        prompt = F.concat(F.array_join(F.transform("issues", lambda i: F.concat(F.lit("- "), i["message"])), "\n"), F.lit("\n"), own, F.lit("\n"), F.coalesce("raw", F.lit("")))
        once_more = called(failing.withColumn("__prompt", prompt).withColumn("__before", F.col("raw")), F.col("__prompt"), F.col("attempts") + 1).drop("__prompt")
        judged = finalize(once_more.drop("issues", "translation"), source_lang, target_lang).withColumn("__stuck", strip(F.col("raw")).eqNullSafe(strip(F.col("__before")))).drop("__before")
        state = scratch.keep(judged, "judged")
    for rows in settled:
        state = state.unionByName(rows)
    return state.drop("__stuck", "raw")


def _asked_again(rows: DataFrame, flag: Column, again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with those that ``flag`` marks replaced by what ``again`` makes of them; the others are left alone."""
    scratch = Scratch(rows.sparkSession)
    kept = scratch.keep(rows.withColumn("__flag", F.coalesce(flag, F.lit(False))), "flagged")
    return kept.where(~F.col("__flag")).drop("__flag").unionByName(scratch.keep(again(kept.where("__flag").drop("__flag")), "again").select(*rows.columns))


def rescue(rows: DataFrame, model: Model | Chat, source_lang: str, target_lang: str) -> DataFrame:
    """Failing segments with lost placeholders again, unmasked; taken where every protected part survives and no error is left."""

    def unmasked(flagged: DataFrame) -> DataFrame:
        said = asked(flagged, model, F.col("source_text"), Scratch(rows.sparkSession), "__raw")
        tried = said.withColumn("__r", strip_fence(strip(F.col("__raw"))))
        whole = F.forall("placeholders", lambda p: contains_normalized(F.col("__r"), p["original"]))
        tried = tried.withColumn("__c", segment_issues(F.col("source_text"), F.col("__r"), source_lang, target_lang))
        tried = tried.withColumn("__ok", F.coalesce(~is_blank(F.col("__r")) & whole & is_ok(F.col("__c")), F.lit(False)))
        note = issue(F.lit(True), "unmasked_rescue", "info", "translated without placeholders, all protected parts are there")
        out = tried.withColumn("translation", F.when(F.col("__ok"), F.col("__r")).otherwise(F.col("translation"))).withColumn("issues", F.when(F.col("__ok"), F.concat("__c", note)).otherwise(F.col("issues")))
        return out.withColumn("attempts", F.col("attempts") + 1)

    lost = ~is_ok(F.col("issues")) & has_code(F.col("issues"), "placeholder_missing", "placeholder_unknown") & (F.size("placeholders") > 0)
    return _asked_again(rows, lost, unmasked)


def retranslate_residual(rows: DataFrame, model: Model | Chat, source_lang: str, target_lang: str) -> DataFrame:
    """Segments left in the source language again; taken where less of it is left, the flag is gone and placeholders are whole."""

    def anew(flagged: DataFrame) -> DataFrame:
        before = flagged.withColumn("__t", F.col("translation")).withColumn("__i", F.col("issues")).drop("translation", "issues")
        new = finalize(asked(before, model, F.col("user") if "user" in rows.columns else F.col("masked_text"), Scratch(rows.sparkSession)), source_lang, target_lang)
        left = lambda c: residual_source_ratio(F.col(c), source_lang, target_lang)
        better = (left("translation") < left("__t")) & ~has_code(F.col("issues"), "untranslated", "placeholder_missing", "placeholder_unknown") & ~is_blank(F.col("translation"))
        out = new.withColumn("__b", F.coalesce(better, F.lit(False))).withColumn("attempts", F.col("attempts") + F.col("__b").cast("int"))
        return out.withColumn("translation", F.when(F.col("__b"), F.col("translation")).otherwise(F.col("__t"))).withColumn("issues", F.when(F.col("__b"), F.col("issues")).otherwise(F.col("__i")))

    return _asked_again(rows, has_code(F.col("issues"), "untranslated") & (F.coalesce("translation", F.lit("")) != ""), anew)


def apply_review(rows: DataFrame, source_lang: str, target_lang: str, verdict: str = "verdict") -> DataFrame:
    """A reviewer's JSON verdict: approval, a revision that keeps protected content, or a note why not."""
    parsed = rows.withColumn("__v", object_variant(F.col(verdict)))
    ok = F.coalesce(F.try_variant_get("__v", "$.ok", "boolean"), F.lit(False))
    revised = F.when(F.schema_of_variant(F.variant_get("__v", "$.revised", "variant")) == "STRING", F.try_variant_get("__v", "$.revised", "string"))
    notes = F.coalesce(F.when(F.schema_of_variant(F.variant_get("__v", "$.notes", "variant")) == "STRING", F.try_variant_get("__v", "$.notes", "string")), F.lit(""))
    back = unmask(parsed.withColumn("__ok", ok).withColumn("__n", notes).withColumn("__r", strip(revised)), "__r", "placeholders")
    kept = F.filter("missing", lambda t: ~F.exists("placeholders", lambda p: (p["token"] == t) & F.contains(F.col("restored"), p["original"])))
    given = F.coalesce(F.col("__r"), F.lit("")) != ""
    take = given & (F.size(kept) == 0) & (F.size("unknown") == 0)
    note = lambda c, s, m: issue(F.lit(True), c, s, m)
    checks = segment_issues(F.col("source_text"), F.col("restored"), source_lang, target_lang, F.col("masked_text"))
    issues = (
        F.when(F.col("__v").isNull(), F.concat("issues", note("review_unparsed", "warning", "the review has no readable verdict")))
        .when(F.col("__ok"), F.concat("issues", note("reviewed_ok", "info", "the review agrees")))
        .when(take, F.concat(checks, note("reviewed_revised", "info", F.concat(F.lit("the review changed it: "), F.left(F.col("__n"), F.lit(300))))))
        .when(given, F.concat("issues", note("review_rejected", "warning", "the revision lost protected parts and was not taken")))
        .otherwise(F.col("issues"))
    )
    taken = ~F.col("__v").isNull() & ~F.col("__ok") & take
    return back.withColumn("issues", issues).withColumn("translation", F.when(taken, F.col("restored")).otherwise(F.col("translation"))).drop("__v", "__ok", "__n", "__r", "restored", "missing", "unknown")


def judge(rows: DataFrame, answer: str = "answer", threshold: float = 70.0) -> DataFrame:
    """A judge's answer as ``score``, and a warning below the threshold."""
    scored = rows.withColumn("score", parsed_score(F.col(answer)))
    low = issue(F.col("score") < threshold, "low_quality_score", "warning", F.format_string(f"score %.0f is under {threshold:.0f}", F.col("score")))
    return scored.withColumn("issues", F.concat("issues", low))


def back_translation(rows: DataFrame, a: str, b: str, least: float = 0.5) -> DataFrame:
    """Vectors of a source and of its back-translation: a warning where they are far apart."""
    near = rows.withColumn("similarity", cosine(F.col(a), F.col(b)))
    return near.withColumn("issues", F.concat("issues", issue(F.col("similarity") < least, "backtranslation", "warning", F.format_string(f"its back-translation is like the source by %.2f only, less than {least}", F.col("similarity")))))


def repair_formula(formula: Column, fixed: Column) -> Column:
    """A model's repair of a formula where it has no problem left."""
    good = (F.size(formula_problems(formula)) > 0) & (F.size(formula_problems(fixed)) == 0) & ~is_blank(fixed)
    return F.when(F.coalesce(good, F.lit(False)), fixed).otherwise(formula)


def repair_layout(chunk: Column, answer: Column) -> Column:
    """A model's new layout of a chunk of 40 letters or more where the content is whole."""
    bare = strip_fence(strip(answer), guard=False)
    good = (letter_count(chunk) >= 40) & ~is_blank(bare) & (bare != chunk) & content_preserved(chunk, bare)
    return F.when(F.coalesce(good, F.lit(False)), bare).otherwise(chunk)
