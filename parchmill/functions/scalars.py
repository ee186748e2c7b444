"""Predicates, coercions and small numeric rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once, split_words, strip

# Parts of model names.
VISION_HINTS = (
    "vl", "vision", "llava", "gemma3", "gemma-3", "minicpm-v", "moondream",
    "pixtral", "internvl", "cogvlm", "idefics", "granite-vision", "-v:",
    "llama3.2-vision", "llama-3.2-vision", "gpt-4o", "gpt-4.1", "gpt-5",
    "claude", "gemini", "-ocr", "deepseek-ocr", "got-ocr", "olmocr", "nanonets-ocr",
)
OCR_HINTS = ("deepseek-ocr", "got-ocr", "gotocr", "olmocr", "nanonets-ocr", "docling", "-ocr")
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def looks_like_term(text: Column) -> Column:
    """Short, one line, five words at most, no sentence end."""
    t = strip(text)
    return F.length(t).between(1, 60) & ~F.contains(t, F.lit("\n")) & (F.size(split_words(t)) <= 5) & ~t.rlike(r"[.!?]\z")


def has_hint(name: Column, hints: tuple[str, ...]) -> Column:
    lowered = F.lower(F.coalesce(name, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(h)) for h in hints])


def supports_vision(name: Column) -> Column:
    return has_hint(name, VISION_HINTS)


def is_ocr_model(name: Column) -> Column:
    return has_hint(name, OCR_HINTS)


def parse_flag(text: Column) -> Column:
    """A setting from the environment: true for four words, else false."""
    return F.lower(strip(text)).isin(*TRUE)


def strict_flag(text: Column) -> Column:
    """True, false, or null where the text is neither."""
    return F.when(F.lower(text).isin(*TRUE), True).when(F.lower(text).isin(*FALSE), False)


def strict_int(text: Column, low: int | None = None, high: int | None = None) -> Column:
    """An integer within bounds, else null."""
    value = strip(text).try_cast("long")
    good = strip(text).rlike(r"\A[+-]?[0-9]+\z")
    if low is not None:
        good &= value >= low
    if high is not None:
        good &= value <= high
    return F.when(good, value)


def strict_list(text: Column) -> Column:
    """Comma-separated items, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def first_given(*choices: Column) -> Column:
    """Precedence of text and number settings: the first that isn't null, empty or zero."""
    return F.coalesce(*[F.when((c.cast("string") != "") & (c.cast("string") != "0"), c) for c in choices])


def first_flag(*choices: Column) -> Column:
    """Precedence of flags: false counts as given."""
    return F.coalesce(*choices)


def unknown_formats(formats: Column, known: tuple[str, ...] = ("html", "docx", "pdf", "latex")) -> Column:
    return F.array_except(formats, F.array(*[F.lit(k) for k in known]))


def tenant_key(owner: Column) -> Column:
    return F.substring(F.sha2(owner, 256), 1, 24)


def upload_problem(name: Column, content: Column, most_bytes: int) -> Column:
    """Why an upload is refused: its extension, size or first bytes; null if it isn't."""
    return (
        F.when(~F.endswith(F.lower(name), F.lit(".pdf")), F.lit("extension"))
        .when(F.octet_length(content) > most_bytes, F.lit("size"))
        .when(F.coalesce(F.substring(content, 1, 5) != F.lit(b"%PDF-"), F.lit(True)), F.lit("magic"))
    )


def eta_seconds(elapsed: Column, progress: Column) -> Column:
    """Linear extrapolation from 3 % on, until the end."""
    return F.when((progress >= 0.03) & (progress < 1), elapsed * (1 - progress) / progress)


def retry_delay(attempt: Column, retry_after: Column) -> Column:
    """Seconds before a retry, without jitter: powers of 2 up to 30, the server's wish up to 60."""
    delay = F.least(F.pow(F.lit(2.0), attempt), F.lit(30.0))
    return F.greatest(delay, F.when(retry_after.isNotNull(), F.least(retry_after, F.lit(60.0))).otherwise(F.lit(0.0)))


def retry_after_seconds(header: Column) -> Column:
    return strip(header).try_cast("double")


def parse_ticker(elapsed: Column, timeout: Column) -> Column:
    return F.least(F.lit(0.92), elapsed / timeout)


def prompt_characters(parts: Column) -> Column:
    """Length of a prompt of (kind, text) parts; a part that isn't text counts 64."""
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + F.when(p["kind"] == "text", F.length(p["text"])).otherwise(F.lit(64)).cast("long"))


def rotate(items: Column, start: Column) -> Column:
    """Items from a place on, then those before it."""
    return F.concat(F.slice(items, start + 1, F.size(items)), F.slice(items, 1, start))


def options_problems(options: Column, known: dict[str, tuple]) -> Column:
    """What is wrong with a JSON object of options, as an array of names in the order of ``known``, then ``unknown`` and ``json``.

    ``known`` has (kind, low, high) by name; kinds are flag, int and text.  Values may be given as text.
    """

    def read(text: Column, parsed: Column) -> Column:
        whole = F.startswith(F.coalesce(F.schema_of_variant(parsed), F.lit("")), F.lit("OBJECT"))
        said = [F.try_variant_get(parsed, f"$.{name}", "string").alias(f"said{k}") for k, name in enumerate(known)]
        return F.struct(whole.alias("whole"), F.json_object_keys(text).alias("keys"), *said)

    def problems(row: Column) -> Column:
        whole, found = row["whole"], []
        for k, (name, (kind, low, high)) in enumerate(known.items()):
            said = row[f"said{k}"]
            good = strict_flag(said).isNotNull() if kind == "flag" else strict_int(said, low, high).isNotNull() if kind == "int" else F.length(said).between(low or 0, high or 1_000_000)
            found.append(F.when(whole & said.isNotNull() & ~F.coalesce(good, F.lit(False)), F.lit(name)))
        found.append(F.when(whole & (F.size(F.array_except(row["keys"], F.array(*[F.lit(k) for k in known]))) > 0), F.lit("unknown")))
        found.append(F.when(~whole, F.lit("json")))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    return once(options, lambda text: once(F.try_parse_json(text), lambda parsed: once(read(text, parsed), problems)))
