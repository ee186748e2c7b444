"""Language identification: script ranges narrow candidates, Viterbi labels spans.

A word (a run of letters) is scored under each learned language by smoothed character
trigrams.  Languages in whose training text a word's script is rare are no candidates
for it.  The best path over a text's words pays a penalty for each change of language,
so spans of mixed text are labelled; the text's language is that of most letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import drop_caches, give_back, small_batches
from .storage import boxed, others, ref, unboxed

LETTERS = re.compile(r"[^\W\d_]+")
#: First and last code point of ranges, and their script.
SCRIPTS = (
    (0x0041, 0x024F, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1E00, 0x1EFF, "latin"),
    (0x3040, 0x309F, "hiragana"),
    (0x30A0, 0x30FF, "katakana"),
    (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
)
#: The last letter of the first range: words up to it are Latin.
LAST_LATIN = chr(SCRIPTS[0][1])
#: Documents to learn from at most, and their bytes.
TRAINING, TRAINING_BYTES = 2000, 1 << 26
#: Log-probability that a change of language costs.
PENALTY = 8.0
#: Share of a language's letters that a script needs.
SCRIPT_SHARE = 0.01
#: Words whose scores a worker keeps.
CACHE = 300_000
UND = "und"


def script_of(letter: str) -> str:
    code = ord(letter)
    for first, last, name in SCRIPTS:
        if first <= code <= last:
            return name
    return "other"


@dataclass
class Model:
    """Trigram log-probabilities of each language, and the scripts it is written in."""

    languages: list[str]
    trigrams: dict[str, np.ndarray]
    unseen: np.ndarray
    scripts: dict[str, np.ndarray]


def trigrams(word: str) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + 3] for i in range(len(marked) - 2)]


def train(rows: list[tuple[str, str]]) -> Model:
    """Learn from (text, language) pairs."""
    languages = sorted({lang for _, lang in rows})
    words: dict[str, Counter] = {lang: Counter() for lang in languages}
    for text, lang in rows:
        words[lang].update(LETTERS.findall(text.lower()))
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for k, lang in enumerate(languages):
        for word, many in words[lang].items():
            for gram in trigrams(word):
                grams.setdefault(gram, np.zeros(len(languages)))[k] += many
            for letter in word:
                scripts.setdefault(script_of(letter), np.zeros(len(languages)))[k] += many
    total = sum(grams.values(), np.zeros(len(languages))) + 0.5 * (len(grams) + 1)
    letters = np.maximum(sum(scripts.values(), np.zeros(len(languages))), 1)
    return Model(languages, {g: np.log((n + 0.5) / total) for g, n in grams.items()}, np.log(0.5 / total), {s: n / letters >= SCRIPT_SHARE for s, n in scripts.items()})


class Scores(dict):
    """Word -> row of ``table``.  Row 0 is neutral: no learned language has the word's script."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.table = np.zeros((1024, len(model.languages)))
        self.used = 1
        self.place = {gram: k for k, gram in enumerate(model.trigrams, 1)}.get
        self.known = np.vstack([model.unseen, *model.trigrams.values()])
        self.latin = model.scripts.get("latin", np.zeros(len(model.languages), bool))

    def __missing__(self, word: str) -> int:
        scores = self.score(word)
        if scores is None:
            self[word] = 0
            return 0
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = scores
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def score(self, word: str) -> np.ndarray | None:
        candidates = self.latin
        if max(word) > LAST_LATIN:
            candidates = np.zeros(len(self.model.languages), bool)
            for script in {script_of(c) for c in word}:
                candidates = candidates | self.model.scripts.get(script, False)
        if not candidates.any():
            return None
        place, marked = self.place, f" {word} "
        scores = self.known[[place(marked[i : i + 3], 0) for i in range(len(marked) - 2)]].sum(axis=0)
        if candidates.all():
            return scores
        # a language that isn't a candidate is worse than any that is by more than a change of language costs
        return np.where(candidates, scores, scores[candidates].min() - 3 * PENALTY)

    def learn(self, words: set[str]) -> None:
        """Score new words at once."""
        fresh, starts, places, place = [], [], [], self.place
        for word in words:
            if max(word) > LAST_LATIN or not self.latin.any():
                self[word]  # scored alone
                continue
            marked = f" {word} "
            fresh.append(word)
            starts.append(len(places))
            places += [place(marked[i : i + 3], 0) for i in range(len(marked) - 2)]
        if not fresh:
            return
        sums = np.add.reduceat(self.known[places], starts, axis=0)
        if not self.latin.all():
            sums = np.where(self.latin, sums, sums[:, self.latin].min(axis=1, keepdims=True) - 3 * PENALTY)
        end = self.used + len(fresh)
        if end > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.table), end), self.table.shape[1]))])
        self.table[self.used : end] = sums
        self.update(zip(fresh, range(self.used, end)))
        self.used = end

    def trim(self) -> None:
        if self.used > CACHE:
            self.clear()
            self.used = 1


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word.  Ties go to the earlier language, and to no change."""
    best = int(scores.sum(axis=0).argmax())
    ahead = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    ahead = np.concatenate([np.zeros((1, scores.shape[1])), ahead])
    # a path with m changes gains a rise at its beginning, one at its end and m - 1 rises between
    ends = ahead.max() + (ahead[-1] - ahead).max()
    if ends <= penalty and (ahead - np.minimum.accumulate(ahead, axis=0)).max() <= penalty:
        return np.full(len(scores), best)  # no spans together gain what their changes of language cost
    back, value = [], scores[0].tolist()
    for row in scores[1:].tolist():
        most = max(value)
        top, change = value.index(most), most - penalty
        back.append([k if v >= change else top for k, v in enumerate(value)])
        value = [(v if v >= change else change) + x for v, x in zip(value, row)]
    path = [value.index(max(value))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1])


def spans(text: str, scores: Scores, penalty: float = PENALTY) -> list[tuple[int, int, str]]:
    """(start, end, language) of the labelled spans of a text, by code point."""
    found = list(LETTERS.finditer(text))
    if not found or not scores.model.languages:
        return []
    rows = [scores[m.group().lower()] for m in found]
    path = viterbi(scores.table[rows], penalty)
    out: list[tuple[int, int, str]] = []
    for m, row, k in zip(found, rows, path.tolist()):
        lang = scores.model.languages[k] if row else UND
        if out and out[-1][2] == lang:
            out[-1] = (out[-1][0], m.end(), lang)
        else:
            out.append((m.start(), m.end(), lang))
    return out


def predict(text: str | None, scores: Scores, penalty: float = PENALTY) -> tuple[str, float, int]:
    """(language, share of letters in it, labelled spans).  ``und`` and 0 without letters or languages."""
    words = LETTERS.findall((text or "").lower())
    lettered = any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)
    if not lettered or not scores.model.languages:
        return UND, 0.0, 0
    if new := {w for w in set(words) if w not in scores}:
        scores.learn(new)
    rows = np.fromiter(map(scores.__getitem__, words), np.int64, len(words))
    path = viterbi(scores.table[rows], penalty)
    letters = np.fromiter(map(len, words), np.int64, len(words))
    # words of no learned script count as letters, but for no language
    share = np.bincount(path[rows > 0], weights=letters[rows > 0], minlength=len(scores.model.languages))
    best = int(share.argmax())
    changes = 1 + int((path[1:] != path[:-1]).sum())
    if not share[best]:
        best = int(scores.table[rows].sum(axis=0).argmax())
    return scores.model.languages[best], float(share[best] / letters.sum()), changes


def predicted(text: Column, model: Model, penalty: float = PENALTY) -> Column:
    """A struct (lang_pred, score, n_spans) of a text column.  Only texts go to Python and only answers come back."""
    spark = SparkSession.getActiveSession()
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # as large as the trigrams of the bounded sample

    @F.arrow_udf("lang_pred string, score double, n_spans long")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_caches()
        scores = Scores(shared.value)
        for batch in batches:
            found = []
            for text in batch:
                found.append(predict(text.as_py(), scores, penalty))
                scores.trim()
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64())]
            yield pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "n_spans"])
        del scores
        give_back()

    return judged.asNondeterministic()(text)  # evaluated once, wherever its fields are used


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text leaves no remainder modulo 5; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAINING, most_bytes: int = TRAINING_BYTES) -> Model:
    """Learn from whole texts that aren't held out: all, or those with the smallest hash of id and text.

    The sample has ``most`` texts and ``most_bytes`` bytes at most, whatever the table's size; the driver
    holds it.  Rows without text or language are not learned from, rows that repeat
    id, text and language count once; without any rows the model knows no language and predicts ``und``.
    """
    able = docs.select(ref(id_col).cast("long").alias("doc_id"), ref(text_col).cast("string").alias("text"), ref(lang_col).cast("string").alias("lang")).where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    hashed = able.withColumn("h", F.xxhash64("doc_id", "text", "lang"))
    # hashes first, so that only the sample's texts are gathered
    first = hashed.groupBy("h").agg(F.max(F.octet_length("text")).alias("size")).orderBy("h").limit(most).collect()
    chosen, total = [], 0
    for r in first:
        if total + r["size"] <= most_bytes:
            chosen.append(r["h"])
            total += r["size"]
    rows = hashed.where(F.col("h").isin(chosen)).select("text", "lang").distinct().collect() if chosen else []
    return train(sorted((r["text"], r["lang"]) for r in rows))


ADDED = ["lang_pred", "score", "n_spans"]


def identify(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``n_spans``, which replace columns of those names.

    ``score`` is the share of letters in the predicted language.  Null, empty and letterless texts
    are ``und`` with score 0; very long ones are read whole.  Rows are judged one by
    one by their text alone, so repeats get equal answers; ties go to the language that
    comes first by name; an empty table gives an empty table.
    """
    found = boxed(docs, found=predicted(ref(text_col).cast("string"), model, penalty))
    return found.select(*unboxed(docs, others(docs, ADDED)), *[F.col("found")[a].alias(a) for a in ADDED])


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5
