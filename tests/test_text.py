"""Column functions on the cases that fix their meaning."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parchmill.functions import latex, scalars, semi, text, vectors
from parchmill.operators.tables import convert_tables

RU = "Глубокое обучение стало основным методом анализа изображений и текста. Модели обучаются на больших наборах данных. " * 4
EN = "Deep learning has become the main method of image and text analysis. Models are trained on large data sets. " * 4


def values(spark, column, *inputs, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r["v"] for r in rows.select("k", column(F.col("x")).alias("v")).orderBy("k").collect()]


def verdicts(spark, *inputs):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    counted = rows.select("k", *[c.alias(n) for n, c in text.quality_counts(F.col("x")).items()])
    return [r["g"] for r in counted.select("k", text.is_garbled().alias("g")).orderBy("k").collect()]


def test_garbled(spark):
    table = "| 12.5 | 33.1 | 8.4 |\n" * 40
    assert verdicts(spark, RU, EN, table, "·····", "") == [False] * 5
    assert verdicts(spark, "\ue001" * 500, "\ufffd" * 400, RU.encode().decode("latin-1") * 2, "·" * 400) == [True] * 4


def test_scripts(spark):
    def mismatch(x, lang):
        rows = spark.createDataFrame([(x,)], "x string").select(*[c.alias(n) for n, c in text.script_counts(F.col("x")).items()])
        return rows.select(text.language_mismatch(F.lit(lang)).alias("m")).first()["m"]

    assert [mismatch(RU, "en"), mismatch(EN, "RU"), mismatch(EN, "en"), mismatch(RU + " deep learning", "ru"), mismatch("short", "ru"), mismatch(EN, "xx")] == ["cyrillic", "latin", None, None, None, None]
    assert [text.length_scale(*p) for p in (("ru", "ja"), ("ja", "ru"), ("ru", "en"), ("zh", "ja"))] == [2.5, 0.4, 1, 1]


def test_strings(spark):
    assert values(spark, text.strip, " \t\u00a0a b\n\x1f", "", "\u2003") == ["a b", "", ""]
    samples = ["", "a", "a\n", "a\nb", "a\r\nb\rc\x0bd\u2028e\n\n", "\n"]
    assert values(spark, text.lines, *samples) == [s.splitlines() for s in samples]
    assert values(spark, lambda x: text.occurrences(x, "$$"), "$$a$$", "$$$", "", "$$$$ $$") == [2, 1, 0, 3]
    assert values(spark, text.strip_fence, "```markdown\nx y\n```", "```x y```", "``````", "```", "a```", "```two words\nb```") == ["x y", "x y", "", "```", "a```", "two words\nb"]
    assert values(spark, text.clean_ocr_artifacts, "<|im_end|>a</s>", "None None", "xNone None\nNone y", "<table><br>") == ["a", "None None", "xy", "<table><br>"]
    assert values(spark, text.strip_math_delimiters, "$$ a $$", r"\[a\]", "$a$", "$$", "a") == ["a", "a", "a", "", "a"]
    assert values(spark, text.escape_latex, r"path C:\data and 5% of A_1 {x}", "") == [r"path C:\textbackslash{}data and 5\% of A\_1 \{x\}", ""]
    assert values(spark, text.safe_url, "javascript:x", " https://a/?b&c ", "#x", "") == ["", "https://a/?b&amp;c", "#x", ""]
    assert values(spark, text.first_heading, "a\n## # T x \n# b", "none") == ["T x", None]
    assert values(spark, text.eta_text, 10.0, 90.0, 3600.0, 5400.0, -1.0, None, kind="double") == ["меньше минуты", "~2 мин", "~1 ч", "~1 ч 30 мин", None, None]
    assert values(spark, scalars.looks_like_term, "loss function", "A sentence.", "a b c d e f", "", "x\ny", "x" * 61) == [True, False, False, False, False, False]
    assert values(spark, scalars.supports_vision, "Qwen2.5-VL", "llama", None) == [True, False, False]
    assert values(spark, scalars.is_ocr_model, "deepseek-OCR", "gpt") == [True, False]
    assert values(spark, lambda x: scalars.strict_int(x, 1, 10), " 5", "11", "x", "1.5", None) == [5, None, None, None, None]
    assert values(spark, scalars.strict_list, "a, b,,c ", "") == [["a", "b", "c"], []]
    assert values(spark, lambda x: scalars.eta_seconds(F.lit(10.0), x), 0.01, 1.0, 0.25, kind="double") == [None, None, 30.0]


def test_content_preserved(spark):
    rows = spark.createDataFrame([("abc $x$ def", "abc  $x$\ndef"), ("abcdefghij", "abcde"), ("a $x$", "a x"), ("1", "2"), ("1", "a")], "a string, b string")
    assert [r[0] for r in rows.select(text.content_preserved(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, False]


@pytest.mark.parametrize(
    ("formula", "problems"),
    [(r"\frac{a}{b} + \sqrt{x}", []), (r"\frac{a}{b", ["braces left open: 1"]), ("a}", ["a closing brace without an opening one"]), ("}{", ["a closing brace without an opening one", "braces left open: 1"]), (r"\{a", []), ("a\\", ["a backslash at the end"]), ("  ", ["nothing in the formula"]), (r"\begin{a}x\end{b}", ["environments begin as ['a'] and end as ['b']"])],
)
def test_formulas(spark, formula, problems):
    assert values(spark, latex.formula_problems, formula) == [problems]


def test_latex_documents(spark):
    clean = "Text $a+b$ and $$\\frac{1}{2}$$ \\begin{align}x\\end{align}"
    got = values(spark, latex.document_issues, clean, "a $$\\frac{a$$ b", "odd $$", "")
    assert [[i["code"] for i in x] for x in got] == [[], ["latex_syntax"], ["latex_delimiters"], []]
    assert got[1][0]["message"] == "in \\frac{a: braces left open: 1"


def test_json(spark):
    assert values(spark, lambda x: F.try_variant_get(semi.object_variant(x), "$.ok", "boolean"), '{"ok": true}', '```json\n{"ok": false}\n```', 'so {"ok": true} it is', "null", '"x"', "[1]", "no") == [True, False, True, None, None, None, None]
    assert values(spark, semi.score, 'x {"score": 71.5} y', '{"score": "a"}', "none") == [71.5, None, None]
    assert [len(x) for x in values(spark, semi.terms, 'x [{"term":"a","translation":"b"},{"term":"","translation":"c"}]', "none")] == [1, 0]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0, 0, 0]
    a, b, c = values(spark, lambda x: vectors.hashed_embedding(x, 256), "deep learning for images", "deep learning for texts", "цены на нефть")
    near = lambda x, y: sum(p * q for p, q in zip(x, y))
    assert abs(near(a, a) - 1) < 1e-9 and near(a, b) > near(a, c)


def test_html_tables(spark):
    full = "x<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>a|b</td></tr></table>y"
    ragged = "p <tr><td>a</td></tr>\n<tr><td>b <b>c</b></td><td>d</td></tr> q"
    got = values(spark, convert_tables, full, ragged, "none", "<tr></tr>", "<p>x</p>")
    assert got == ["x\n\n| A | B |\n|---|---|\n| 1 | a\\|b |\n\ny", "p \n\n| a |  |\n|---|---|\n| b c | d |\n\nq", "none", "<tr></tr>", "<p>x</p>"]


def _mentions(spark, value):
    """How often an expression over a column names it."""
    plan = spark.range(1).selectExpr("string(id) AS said").select(value(F.col("said")).alias("out"))._jdf.queryExecution().analyzed().toString()
    return plan.splitlines()[0].count("said#")


def test_options_are_read_once(spark):
    """An expression named many times is worked out as many times in an array."""
    known = {"dry": ("flag", None, None), "workers": ("int", 1, 64), "name": ("text", 2, 3)}
    assert _mentions(spark, lambda c: scalars.options_problems(c, known)) == 1
    rows = [('{"dry": "yes", "workers": 64}', []), ('{"dry": "perhaps", "workers": "x", "name": "a"}', ["dry", "workers", "name"]), ('{"workers": "99999999999999999999"}', ["workers"]), ('{"workers": " +7 ", "b": 1}', ["unknown"]), ("[1]", ["json"]), ("[1", ["json"]), (None, ["json"])]
    got = spark.createDataFrame([(k, o) for k, (o, _) in enumerate(rows)], "k int, o string").select("k", scalars.options_problems(F.col("o"), known).alias("p")).orderBy("k").collect()
    assert [r["p"] for r in got] == [p for _, p in rows]


def test_clean_ups_read_once(spark):
    """Neither the text nor what is stripped of it is worked out again for each delimiter."""
    assert _mentions(spark, text.strip_math_delimiters) == _mentions(spark, text.strip_fence) == 1
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rows = spark.createDataFrame([(s + "$$ a" + s + "b $$" + s, s) for s in spaces], "t string, s string")
    assert all(r["a"] == "a" + r["s"] + "b" for r in rows.select("s", text.strip_math_delimiters(F.col("t")).alias("a")).collect())
    runs = spark.createDataFrame([("NoneNone None x",), ("None None",), ("a None None\n NoneNone ",)], "t string").select(text.clean_ocr_artifacts(F.col("t")).alias("a"))
    assert [r["a"] for r in runs.collect()] == ["x", "None None", "a "]
