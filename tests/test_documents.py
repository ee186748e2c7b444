"""Blocks, segments, masking, validation and the model loop on small documents."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parchmill.operators import blocks, masking, models, render, segments, validation

PAPER = """# Deep Learning

Intro with $x$ inline.

$$
E = mc^2
$$

| Model | Score |
|---|---|
| CNN | 0.92 |

![fig](images/a.png)

```python
print("$notmath$")
```

Last paragraph."""


def types(markdown):
    return [b["type"] for b in blocks.parse_blocks(markdown)]


def test_blocks():
    assert types(PAPER) == ["heading", "paragraph", "math", "table", "image", "code", "paragraph"]
    assert types("Text before.\n\n\\begin{equation}\na\n\\end{equation}\n\nText after.") == ["paragraph", "math", "paragraph"]
    assert types("$$a=b$$") == ["math"]
    assert types("$$a\nb$$\nc") == ["math", "paragraph"]
    assert types("```\nnever closed\n\n# x") == ["paragraph"]
    assert types("$$\nopen") == ["paragraph"]
    assert types("\\begin{a}x\\end{a}\n\\begin{b}\nx") == ["math", "paragraph"]
    assert types("<div>a</div>\ntext\n<p>b</p>") == ["html", "paragraph"]
    assert types("| a |\n<p>b</p>\nc") == ["table", "paragraph"]
    assert types("a\n| b |\nc\n## d\ne") == ["paragraph", "table", "paragraph", "heading", "paragraph"]
    assert types("~~~\na\n```\nb\n~~~ x\nc") == ["code", "paragraph"]
    assert types("") == types("\n \n\t") == []
    assert types("#no heading\n#\n####### no") == ["paragraph"]
    assert blocks.parse_blocks("a\r\nb\x0bc")[0]["text"] == "a\nb\nc"


def test_references(spark):
    doc = "# A\n\np\n\n## References\n\n[1] a\n\n[2] b\n\n# Conclusion\n\nc\n\n## 5. Список литературы\n\n[3] d\n\n## Nomenclature\n\ne"
    rows = blocks.mark_references(blocks.split_markdown(spark.createDataFrame([(1, doc)], "doc_id long, text string"))).orderBy("idx").collect()
    assert [r["text"] for r in rows if r["skipped"]] == ["[1] a", "[2] b", "[3] d"]


def test_segments():
    sentence = "This is a sentence number {} of the paragraph. "
    long = "".join(sentence.format(k) for k in range(60)).strip()
    block = lambda t, kind="paragraph", ok=True, k=0: {"idx": k, "type": kind, "text": t, "translatable": ok}
    cut = segments.pack_blocks([block(long)], 1000)
    assert len(cut) > 2 and all(len(s["source_text"]) <= 1200 for s in cut)
    assert " ".join(s["source_text"] for s in cut) == long
    assert segments.cut_paragraph(("word " * 300).strip(), 1000) == [("word " * 300).strip()]
    by_line = segments.cut_paragraph("\n".join("no end here at all" for _ in range(400)), 1000)
    assert len(by_line) > 1 and all(len(c) <= 1100 for c in by_line)
    assert len(segments.pack_blocks([block("| a |\n" * 200, "table")], 300)) == 1
    assert [s["source_text"] for s in segments.pack_blocks([block("a"), block("b", k=1)], 4000)] == ["a\n\nb"]
    kinds = segments.pack_blocks([block("a"), block("x", "code", False, 1), block(" ", k=2), block("b", k=3)], 4000)
    assert [s["kind"] for s in kinds] == ["translate", "pass", "pass", "translate"]


def compared(spark, sf_dir, name, *tables):
    """Rows of a query and of its SQL over the tables of a folder."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    frame = entry.queries()[name](spark, str(sf_dir))
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    key = lambda row: [str(x) for x in row]
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=key), sorted(want.fetchall(), key=key)


LONG_PARAGRAPHS = ["segment_pack", "source_contexts", "segment_batches", "mask_roundtrip", "translate_documents", "prompts", "repair_loop", "placeholder_rescue"]


@pytest.mark.parametrize("name", LONG_PARAGRAPHS)
def test_paragraphs_over_the_budget(spark, tmp_path, name):
    """The SQL keeps a paragraph of more than 4000 characters whole."""
    long = "One sentence of many. " * 300
    texts = [f"A title of some length\n{long}\nEnd.", f"{long}\nA.\nB.\n{long}\nC.", "short\ntext"]
    pq.write_table(pa.table({"doc_id": list(range(3)), "lang": ["en"] * 3, "text": texts}), tmp_path / "documents.parquet")
    got, want = compared(spark, tmp_path, name, "documents")
    assert got == want and got


def test_prompts_of_sharp_s(spark, tmp_path):
    """A letter without a single upper-case partner stays one letter."""
    texts = ["Erßie a.", "ŉ x", "ᾀ y", "ﬁn z", "ẞß é", "plain text", "ß", " a"]
    pq.write_table(pa.table({"item_id": list(range(len(texts))), "text": texts}), tmp_path / "benchmark.parquet")
    got, want = compared(spark, tmp_path, "system_prompts", "benchmark")
    assert got == want and len(got) == len(texts)


ODD_LINES = ["", " ", "\t", "!!", "\r", "\xa0", "# one", "##", "###### six", "| a | b |", "||", " | a", " lead", "\u3000lead", "a\rb", "a\x0bb\x0c", "\x1c\x1d\x1e\x85\u2028\u2029", "~0^1~", " " * 60 + "x", "| " * 40, "<br> a#b_c%d"]


@pytest.mark.parametrize("name", ["html_pages", "latex_pages"])
def test_pages_of_odd_lines(spark, tmp_path, name):
    """Lines that are blank, begin like Markdown or have line ends of their own are text, as in the SQL."""
    at = lambda line, i: "\n".join([f"line {k}" for k in range(i)] + [line, "next", line])
    texts = [at(line, i) for line in ODD_LINES for i in (0, 1, 3, 5, 7, 9, 11, 15)] + ODD_LINES + ["\n".join(ODD_LINES * 3), None]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "lang": ["en"] * len(texts), "text": texts}), tmp_path / "documents.parquet")
    got, want = compared(spark, tmp_path, name, "documents")
    assert got == want and len(got) == len(texts) - 1


MASKED = [
    "The energy $E = mc^2$ is famous.",
    "$$\na\n$$ \\begin{align}x\\end{align} ```\n'$notmath$'\n``` \\cite{a} \\ref{b} \\eqref{c}",
    "![fig](images/a.png) and [link](https://ex.org/x)",
    "As shown in [12] and [3, 4].",
    "It costs $5 and then $6 more.",
    "https://x.org/$e=mc^2$ \\href{https://x.com}{$y$}",
    "`a` <b>x</b> \\(a\\) \\[b\\]",
    "",
]


def test_mask_round_trip():
    for text in MASKED:
        found = masking.mask_texts([text])[0]
        back = masking.restore(found["masked"], {t["token"]: t["original"] for t in found["tokens"]})
        assert back == {"text": text, "missing": [], "unknown": []}
    one, two = masking.mask_texts(["$a$ $b$", "$c$"])
    assert [t["token"] for t in two["tokens"]] == ["⟦PH2⟧"]
    shown = masking.mask_texts([MASKED[2]])[0]["masked"]
    assert "images" not in shown and "https" not in shown and "link" in shown


@pytest.mark.parametrize("form", ["⟦ PH 0 ⟧", "[PH0]", "⟦⟦PH0⟧⟧", "⟦РН0⟧", "⟦ph0⟧", "«PH0»"])
def test_mangled(form):
    assert masking.restore(f"a {form} b", {"⟦PH0⟧": "$x$"})["missing"] == []


def test_lost_and_invented():
    assert masking.restore("nothing", {"⟦PH0⟧": "$x$"})["missing"] == ["⟦PH0⟧"]
    assert masking.restore("⟦PH99⟧", {})["unknown"] == ["⟦PH99⟧"]
    assert masking.restore("pH 12", {"⟦PH12⟧": "x"}) == {"text": "pH 12", "missing": ["⟦PH12⟧"], "unknown": []}
    assert masking.restore("⟦PH007⟧", {"⟦PH7⟧": "x"})["unknown"] == ["⟦PH007⟧"]


FOX = "The quick brown fox jumps over the lazy dog. " * 8
LIS = "Быстрая коричневая лиса прыгает через ленивую собаку. " * 8


def codes(spark, source, translation, pair=("en", "ru")):
    row = spark.createDataFrame([(source, translation)], "s string, t string")
    return [i["code"] for i in row.select(validation.segment_issues(F.col("s"), F.col("t"), *pair).alias("i")).first()["i"]]


def test_validation(spark):
    assert codes(spark, "a", " ") == ["empty_translation"]
    assert codes(spark, FOX, FOX) == ["untranslated"]
    assert codes(spark, FOX, LIS) == []
    assert "too_short" in codes(spark, FOX, "Коротко.")
    assert "table_rows" in codes(spark, "| a |\n| b |", "| a |")
    assert "table_cols" in codes(spark, "| a | b |", "| a b cc |")
    assert "heading_mismatch" in codes(spark, "# a\n\ntext", "а\n\nтекст")
    assert "math_delimiters" in codes(spark, "a $$x$$", "а $$x$")
    assert "latex_env" in codes(spark, "a x y z", "\\begin{a} x")
    assert "too_short" not in codes(spark, LIS, "素早い茶色の狐がのろまな犬を飛び越える。" * 8, ("ru", "ja"))
    assert "too_short" in codes(spark, LIS, "短い", ("ru", "ja"))


def test_final_text(spark):
    rows = [("translate", "s", "t", [("placeholder_missing", "error", "")], None), ("translate", "s", "t", [("too_short", "error", "")], None), ("translate", "s", "", [], None), ("pass", "s", "t", [], None), ("translate", "s", "t", [], "c"), ("translate", "s", None, None, "")]
    frame = spark.createDataFrame(rows, f"kind string, s string, t string, issues {validation.NO_ISSUES}, c string")
    got = frame.select(validation.final_text(F.col("kind"), F.col("s"), F.col("t"), F.col("issues"), F.col("c")).alias("f")).collect()
    assert [r["f"] for r in got] == ["s", "t", "s", "s", "c", "s"]


def prepared(spark, *texts):
    rows = spark.createDataFrame([(1, k, "translate", t) for k, t in enumerate(texts)], "doc_id long, seg_no int, kind string, source_text string")
    return masking.mask_segments(rows)


def test_repair_loop(spark):
    source = "The value $x$ is shown in the figure below."
    good, bad = "Значение ⟦PH0⟧ показано на рисунке ниже, да.", "Значение показано на рисунке ниже, да, вот."

    def model(prompt):
        # asked again, the prompt begins with the list of issues
        return F.when(F.startswith(prompt, F.lit("- ")), F.lit(good)).otherwise(F.lit(bad))

    row = models.translate(prepared(spark, source), model, "en", "ru").first()
    assert (row["attempts"], row["translation"], [i["code"] for i in row["issues"]]) == (2, good.replace("⟦PH0⟧", "$x$"), [])
    stuck = models.translate(prepared(spark, source), lambda p: F.lit(bad), "en", "ru").first()
    assert (stuck["attempts"], [i["code"] for i in stuck["issues"]]) == (2, ["placeholder_missing"])


def test_rescue_and_residual(spark):
    source = "The value $x$ is shown in the figure below."
    failed = models.translate(prepared(spark, source), lambda p: F.lit("Значение показано на рисунке ниже, да, вот."), "en", "ru", repairs=0)
    saved = models.rescue(failed, lambda p: F.lit("Значение $x$ показано на рисунке ниже."), "en", "ru").first()
    assert ([i["code"] for i in saved["issues"]], saved["attempts"]) == (["unmasked_rescue"], 2)
    kept = models.rescue(failed, lambda p: F.lit("Значение показано на рисунке ниже, да."), "en", "ru").first()
    assert [i["code"] for i in kept["issues"]] == ["placeholder_missing"]
    left = models.translate(prepared(spark, FOX.strip()), lambda p: p, "en", "ru", repairs=0)
    assert [i["code"] for i in left.first()["issues"]] == ["untranslated"]
    again = models.retranslate_residual(left, lambda p: F.lit(LIS.strip()), "en", "ru").first()
    assert (again["translation"], again["issues"], again["attempts"]) == (LIS.strip(), [], 2)
    same = models.retranslate_residual(left, lambda p: p, "en", "ru").first()
    assert same["translation"] == FOX.strip()


def test_review(spark):
    base = models.translate(prepared(spark, "The value $x$ is here."), lambda p: F.lit("Значение ⟦PH0⟧ здесь."), "en", "ru")
    cases = {'{"ok": true}': ("Значение $x$ здесь.", "reviewed_ok"), "null": ("Значение $x$ здесь.", "review_unparsed"), '{"ok": false, "revised": "Вот значение $x$ тут."}': ("Вот значение $x$ тут.", "reviewed_revised"), '{"ok": false, "revised": "Вот значение тут."}': ("Значение $x$ здесь.", "review_rejected")}
    for verdict, (said, code) in cases.items():
        row = models.apply_review(base.withColumn("verdict", F.lit(verdict)), "en", "ru").first()
        assert (row["translation"], [i["code"] for i in row["issues"]]) == (said, [code])
    none = models.apply_review(base.withColumn("verdict", F.lit('{"ok": false, "revised": null}')), "en", "ru").first()
    assert none["issues"] == []


def test_models(spark):
    class Flaky:
        def chat(self, prompt):
            if "x" in prompt:
                raise OSError
            return prompt.upper()

    rows = spark.createDataFrame([("a",), ("x",)], "p string")
    model = models.chain(models.from_client(Flaky), models.transliterate)
    assert [r[0] for r in rows.select(model(F.col("p"))).collect()] == ["A", models.CYRILLIC[23]]
    judged = models.judge(rows.withColumn("issues", F.array().cast(validation.NO_ISSUES)).withColumn("answer", F.lit('{"score": 60}'))).first()
    assert judged["score"] == 60 and judged["issues"][0]["code"] == "low_quality_score"
    fixed = spark.range(1).select(models.repair_formula(F.lit("\\frac{a"), F.lit("\\frac{a}")), models.repair_formula(F.lit("a"), F.lit("b")), models.repair_layout(F.lit("word " * 20), F.lit("```\n" + "word  " * 20 + "\n```"))).first()
    assert fixed[0] == "\\frac{a}" and fixed[1] == "a" and fixed[2].startswith("word  word")


def test_render(spark):
    docs = spark.createDataFrame([(1, PAPER + "\n\n<script>x</script>\n\n[a](javascript:x) **b** *c* `d` [e](https://f)")], "doc_id long, text string")
    parts = blocks.split_markdown(docs)
    page = render.body(render.render_blocks(parts, "html")).first()["body"]
    for piece in ("<h1>Deep Learning</h1>", "<th>Model</th>", "<td>CNN</td>", '<img alt="fig" src="">', "&lt;script&gt;", '<a href="" rel', "<strong>b</strong>", "<em>c</em>", "<code>d</code>", "print(&quot;$notmath$&quot;)"):
        assert piece in page, piece
    tex = render.body(render.render_blocks(parts, "latex"), "\\n\\n").first()["body"]
    for piece in ("\\section{Deep Learning}", "\\[\nE = mc^2\n\\]", "CNN & 0.92 \\\\", "\\includegraphics", "\\begin{verbatim}", "\\href{https://f}{e}", "\\textbf{b}"):
        assert piece in tex, piece
    whole = docs.select(render.html_page(F.lit("<p>x</p>"), F.lit("a<b")), render.latex_document(F.lit("x"), F.lit("5%"))).first()
    assert "<title>a&lt;b</title>" in whole[0] and "\\title{5\\%}" in whole[1]


def test_batches_of_texts_are_small(spark, small):
    """Whole texts go to Python workers a bounded number at a time."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for name in ("reference_mask", "layout_chunks", "merged_terms", "html_render", "oversized_paragraphs"):
        spark.conf.set(setting, "10000")
        entry.queries()[name](spark, small)
        assert int(spark.conf.get(setting)) <= 1000
    spark.conf.unset(setting)


def test_translations_are_worked_out_once(spark, small):
    """Readers of a pair's translation and issues don't bring the expressions again into a plan."""
    plan = entry.queries()["final_text_assemble"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("translate(") <= 4
