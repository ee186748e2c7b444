"""Text measures and clean-ups with Python's string semantics, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------
#: Characters that Python's str.isspace() accepts.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NOT_SPACE = SPACE.replace("[", "[^", 1)
#: Line ends of str.splitlines().
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: Python's \w without digits and underscore.
LETTERS = r"[\p{L}\p{Nl}\p{No}]"
WORD_CHARACTERS = r"[\p{L}\p{N}_]"
#: Characters with the Unicode property Numeric_Type=Digit that aren't decimal digits.
OTHER_DIGITS = r"\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
SUSPICIOUS = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFD}\x{FFFD}\p{Co}\p{Cn}]"
MOJIBAKE = r"[\x{D0}\x{D1}][\x{80}-\x{BF}]"
#: Scripts in order of precedence, as counted in whole texts.
SCRIPTS = {
    "cyrillic": "[А-Яа-яЁёІіЇїЄєҐґ]",
    "latin": "[A-Za-z]",
    "cjk": "[一-鿿぀-ヿ]",
    "greek": "[Ͱ-Ͽ]",
    "arabic": "[؀-ۿ]",
}
LANGUAGE_SCRIPT = {
    "ru": "cyrillic", "uk": "cyrillic", "kk": "cyrillic", "be": "cyrillic",
    "en": "latin", "de": "latin", "fr": "latin", "es": "latin", "it": "latin",
    "zh": "cjk", "ja": "cjk", "el": "greek", "ar": "arabic",
}
#: The same for checks of single segments, which know fewer.
SEGMENT_SCRIPTS = {"latin": "[A-Za-z]", "cyrillic": "[А-Яа-яЁё]", "cjk": "[一-鿿぀-ヿ]"}
SEGMENT_LANGUAGE_SCRIPT = {
    "en": "latin", "de": "latin", "fr": "latin", "es": "latin",
    "ru": "cyrillic", "uk": "cyrillic", "kk": "cyrillic",
    "zh": "cjk", "ja": "cjk",
}
CJK_DENSITY = 2.5
PLACEHOLDER = r"⟦PH([0-9]+)⟧"
CONTROL_TOKEN = r"<\|[^|>]{0,40}\|>"
SENTINELS = ("</s>", "<s>", "<|endoftext|>", "<pad>", "</angela>")
NONE_RUN = r"None(?:" + SPACE + r"*+None){2,}+" + SPACE + r"*+"
FORMULA = r"(?s)\$\$.+?\$\$|\$[^$\n]+?\$"
CONTROLS = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]"
LATEX_ESCAPES = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
LINK_STARTS = ("http://", "https://", "mailto:", "/", "./", "../", "#")
IMAGE_STARTS = ("http://", "https://", "data:", "/", "./", "../")
# ------------------------------------------------------------------------------


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, however often it is named: an element of an array isn't inlined."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal, like str.count()."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def strip(text: Column) -> Column:
    """str.strip(): all white space, not only spaces."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(NOT_SPACE), F.lit(True))


def lines(text: Column) -> Column:
    """str.splitlines(): no empty line after the last line end."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_words(text: Column) -> Column:
    """str.split() without an argument."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def join_words(text: Column) -> Column:
    """White space runs as one space, ends stripped."""
    return strip(F.regexp_replace(text, SPACE + "+", " "))


def contains_normalized(text: Column, part: Column) -> Column:
    """Containment that takes any run of white space for one space."""
    return F.contains(join_words(text), join_words(part))


def strip_placeholders(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("⟦PH")), F.regexp_replace(text, PLACEHOLDER, " ")).otherwise(text)


def without(text: Column, characters: str) -> Column:
    """The text without the characters of a class."""
    return F.regexp_replace(text, characters + "+", "")


def shorter(longer: Column, rest: Column) -> Column:
    return (F.length(longer) - F.length(rest)).cast("long")


def count_characters(text: Column, characters: str) -> Column:
    """How many characters a class has: a run at a time, where regexp_count makes a string of each."""
    return shorter(text, without(text, characters))


def quality_counts(text: Column) -> dict[str, Column]:
    """Integer counts behind the ratios: characters that aren't white space, and classes of them.

    Letters are taken off first; the other classes are disjoint from them and looked for in the rest.
    """
    solid = without(text, SPACE)
    rest = without(solid, r"\p{L}")
    letters = shorter(solid, rest)
    return {
        "n_nonspace": F.length(solid).cast("long"),
        "n_suspicious": count_characters(rest, SUSPICIOUS),
        "n_letters": letters,
        "n_meaningful": letters + count_characters(rest, rf"[\p{{Nd}}{OTHER_DIGITS}]"),
        "n_mojibake": F.when(text.rlike(MOJIBAKE), count(text, MOJIBAKE)).otherwise(F.lit(0).cast("long")),
    }


def quality_ratios() -> dict[str, Column]:
    """Ratios from the columns of :func:`quality_counts`; short texts have no garbled share."""
    n = F.col("n_nonspace")
    share = lambda c: F.when(n > 0, F.col(c) / n).otherwise(F.lit(0.0))
    return {
        "garbled_ratio": F.when(n < 40, F.lit(0.0)).otherwise(share("n_suspicious")),
        "letter_ratio": share("n_letters"),
        "meaningful_ratio": share("n_meaningful"),
        "mojibake_ratio": F.col("n_mojibake") / F.greatest(n, F.lit(1)),
    }


def is_garbled() -> Column:
    """The verdict on unrounded ratios, from the columns of :func:`quality_counts`."""
    r = quality_ratios()
    return (F.col("n_nonspace") >= 200) & ((r["garbled_ratio"] >= 0.12) | (r["mojibake_ratio"] >= 0.10) | ((r["letter_ratio"] < 0.35) & (r["garbled_ratio"] > 0.02)) | (r["meaningful_ratio"] < 0.20))


def garbage_markdown(text: Column, garbled: Column) -> Column:
    return is_blank(text) | garbled


def script_counts(text: Column) -> dict[str, Column]:
    """Letters of each script; the scripts share none, so each is looked for in what the ones before leave."""
    counts, rest = {}, text
    for name in sorted(SCRIPTS, key=lambda n: n != "latin"):
        left = without(rest, SCRIPTS[name])
        counts[f"n_{name}"], rest = shorter(rest, left), left
    return {f"n_{name}": counts[f"n_{name}"] for name in SCRIPTS}


def script_total() -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"n_{name}") for name in SCRIPTS])


def dominant_script() -> Column:
    """The most frequent script, the earlier on ties; null under 30 letters.  Needs the script counts."""
    most = F.greatest(*[F.col(f"n_{name}") for name in SCRIPTS])
    name = reduce(lambda rest, n: F.when(F.col(f"n_{n}") == most, F.lit(n)).otherwise(rest), reversed(SCRIPTS), F.lit(None).cast("string"))
    return F.when(script_total() >= 30, name)


def script_share() -> Column:
    most = F.greatest(*[F.col(f"n_{name}") for name in SCRIPTS])
    return F.when(script_total() >= 30, most / script_total()).otherwise(F.lit(0.0))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def language_mismatch(language: Column) -> Column:
    """The dominant script, where it takes 60 % and isn't that of the language.  Needs the script counts."""
    expected = _lookup(LANGUAGE_SCRIPT, F.lower(language))
    return F.when(expected.isNotNull() & (dominant_script() != expected) & (script_share() >= 0.6), dominant_script())


def script_word_ratio(text: Column, script: str) -> Column:
    """Share of words of two letters or more with a letter of the script."""
    words = F.regexp_extract_all(text, F.lit(f"({LETTERS}{{2,}})"), F.lit(1))
    hits = F.size(F.filter(words, lambda w: w.rlike(SEGMENT_SCRIPTS[script])))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(F.lit(0.0))


def residual_source_ratio(text: Column, source: str, target: str) -> Column:
    """Share of words left in the source script; 0 where the scripts don't tell languages apart."""
    a, b = SEGMENT_LANGUAGE_SCRIPT.get(source), SEGMENT_LANGUAGE_SCRIPT.get(target)
    return script_word_ratio(strip_placeholders(text), a) if a and b and a != b else F.lit(0.0)


def length_scale(source: str, target: str) -> float:
    """What brings translation lengths to the scale of alphabetic scripts."""
    a, b = (SEGMENT_LANGUAGE_SCRIPT.get(x) == "cjk" for x in (source, target))
    return CJK_DENSITY if b and not a else 1 / CJK_DENSITY if a and not b else 1.0


def strip_fence(text: Column, guard: bool = True) -> Column:
    """Take off a code fence around the whole text, with a language tag on its first line.

    The guard asks for six characters, so that one fence isn't taken for two.
    """

    def bare(body: Column) -> Column:
        end = F.locate("\n", body)
        tagged = (end > 0) & ~F.contains(strip(F.substr(body, F.lit(1), F.greatest(end - 1, F.lit(0)))), F.lit(" "))
        return strip(F.when(tagged, F.substr(body, end + 1)).otherwise(body))

    def stripped(text: Column) -> Column:
        wrapped = F.startswith(text, F.lit("```")) & F.endswith(text, F.lit("```")) & (F.length(text) >= (6 if guard else 3))
        return F.when(wrapped, once(F.substr(text, F.lit(4), F.greatest(F.length(text) - 6, F.lit(0))), bare)).otherwise(text)

    return once(text, stripped)


def clean_ocr_artifacts(text: Column) -> Column:
    """Drop control tokens, sentinels and runs of None that vision models leave."""
    out = F.regexp_replace(text, CONTROL_TOKEN, "")
    for token in SENTINELS:
        out = F.replace(out, F.lit(token), F.lit(""))
    return F.regexp_replace(out, NONE_RUN, "")


def letter_count(text: Column) -> Column:
    return count_characters(text, LETTERS)


def content_preserved(before: Column, after: Column) -> Column:
    """Letters within 12 % and as many formulas as before."""
    a, b = letter_count(before), letter_count(after)
    same = (b >= a * 0.88) & (b <= a * 1.12) & (count(before, FORMULA) == count(after, FORMULA))
    return F.when(a == 0, b == 0).otherwise(same)


def strip_math_delimiters(text: Column) -> Column:
    def bare(inner: Column) -> Column:
        out = inner
        for left, right in reversed((("$$", "$$"), (r"\[", r"\]"), (r"\(", r"\)"), ("$", "$"))):
            both = F.startswith(inner, F.lit(left)) & F.endswith(inner, F.lit(right)) & (F.length(inner) >= len(left) + len(right))
            out = F.when(both, strip(F.substr(inner, F.lit(len(left) + 1), F.length(inner) - len(left) - len(right)))).otherwise(out)
        return out

    return once(strip(text), bare)


def escape_latex(text: Column) -> Column:
    """Every special character once: a character map over the text, not chained replacements."""
    table = F.create_map(*[F.lit(x) for pair in LATEX_ESCAPES.items() for x in pair])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")


def escape_html(text: Column, quote: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#x27;")] if quote else [])
    return reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs, text)


def safe_url(url: Column, image: bool = False) -> Column:
    """The url escaped for an attribute, empty unless it begins in an allowed way."""
    inner = strip(url)
    allowed = reduce(lambda a, b: a | b, [F.startswith(F.lower(inner), F.lit(s)) for s in (IMAGE_STARTS if image else LINK_STARTS)])
    return F.when(allowed, escape_html(inner)).otherwise(F.lit(""))


def drop_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, "")


def first_heading(text: Column) -> Column:
    """The first line that begins with #, without its leading # and spaces."""
    found = F.get(F.filter(lines(text), lambda x: F.startswith(x, F.lit("#"))), 0)
    return strip(F.regexp_replace(found, r"\A[# ]+", ""))


def content_key(text: Column) -> Column:
    """Key of a stored translation."""
    return F.sha2(strip(text), 256)


def checkpoint_key(text: Column, source: Column, target: Column) -> Column:
    return F.substring(F.sha2(F.concat(source, F.lit(">"), target, F.lit("\0"), strip(text)), 256), 1, 24)


def safe_namespace(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_.-]", "_")


def heading_count(text: Column) -> Column:
    found = count(text, rf"(?m)^#{{1,6}}{SPACE}")
    return F.when(F.contains(text, F.lit("#")), found).otherwise(F.when(text.isNotNull(), F.lit(0).cast("long")))


def table_rows(text: Column) -> Column:
    rows = F.filter(lines(text), lambda x: x.rlike(rf"\A{SPACE}*\|"))
    return F.when(F.contains(text, F.lit("|")), rows).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))


def table_columns(text: Column) -> Column:
    """The most bars in a table row; 0 without rows."""
    return F.coalesce(F.array_max(F.transform(table_rows(text), lambda r: F.length(r) - F.length(F.replace(r, F.lit("|"), F.lit(""))))), F.lit(0))


def eta_text(seconds: Column) -> Column:
    """Time left for people: under 45 s, minutes, hours."""
    minutes = F.floor(seconds / 60 + 0.5)
    hours, rest = F.floor(minutes / 60), minutes % 60
    return (
        F.when(seconds.isNull() | (seconds < 0), F.lit(None).cast("string"))
        .when(seconds < 45, F.lit("меньше минуты"))
        .when(minutes < 60, F.concat(F.lit("~"), minutes.cast("string"), F.lit(" мин")))
        .when(rest > 0, F.concat(F.lit("~"), hours.cast("string"), F.lit(" ч "), rest.cast("string"), F.lit(" мин")))
        .otherwise(F.concat(F.lit("~"), hours.cast("string"), F.lit(" ч")))
    )


def simple_upper(text: Column) -> Column:
    """Upper case one code point at a time, as SQL engines with simple case mappings have it: no letter becomes two, and \u00df becomes \u1e9e."""

    def one(c: Column) -> Column:
        return F.when(F.length(F.upper(c)) == 1, F.upper(c)).when(F.length(F.initcap(c)) == 1, F.initcap(c)).otherwise(c)

    return F.array_join(F.transform(F.split(F.translate(text, "\u00df", "\u1e9e"), ""), one), "")
