"""Document sources and their statistics."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_garbled, quality_counts, strip, strip_fence

#: Parsers by preference, the namespace of TEI, endings of image files.
PARSERS = ("mineru_local", "mineru_api", "nougat", "marker", "docling", "grobid", "pymupdf")
LAST_RESORT = "vlm_ocr"
TEI = "{http://www.tei-c.org/ns/1.0}"
#: Parts of a TEI document: the end of the path to them, and what goes before them in Markdown.
TEI_PARTS = (
    ("title", ("titleStmt", "title"), "# "),
    ("abstract", ("profileDesc", "abstract"), "## Abstract\n\n"),
    ("head", ("text", "body", "div", "head"), "## "),
    ("paragraph", ("text", "body", "div", "p"), ""),
)
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".bmp")


def parser_table(spark: SparkSession, available: dict[str, bool]) -> DataFrame:
    rows = [(name, k, available.get(name, False)) for k, name in enumerate((*PARSERS, LAST_RESORT))]
    return spark.createDataFrame(rows, "backend string, rank int, available boolean")


def choose_parser(parsers: DataFrame, name: str = "auto") -> DataFrame:
    """The named parser if it is available, else for ``auto`` the first available one; no row if none is."""
    usable = parsers.where("available")
    if name != "auto":
        return usable.where(F.col("backend") == name).select("backend")
    return usable.where(F.col("backend") != LAST_RESORT).agg(F.min_by("backend", "rank").alias("backend")).where("backend is not null")


def fallback_parsers(parsers: DataFrame, exclude: str) -> DataFrame:
    return parsers.where(F.col("available") & ~F.col("backend").isin(exclude, LAST_RESORT)).select("backend", "rank").orderBy("rank")


def tei_parts(xml: str | None) -> list[str] | None:
    """Markdown parts of a TEI document, read as a stream: title, abstract, heads and paragraphs of the body's own divisions.

    A part is known by the end of its path; the first title, abstract and head of a division count.
    """
    leads = {part: lead for part, _, lead in TEI_PARTS}
    found: dict[str, list[tuple[str, str]]] = {part: [] for part in ("title", "abstract", "body")}
    path: list[str] = []
    headed = False
    try:
        for event, element in ET.iterparse(io.BytesIO((xml or "").encode("utf-8", "surrogatepass")), ("start", "end")):
            if event == "start":
                path.append(element.tag.removeprefix(TEI))
                headed = headed and path[-3:] != ["text", "body", "div"]
                continue
            part = next((name for name, end, _ in TEI_PARTS if path[-len(end) :] == list(end)), None)
            path.pop()
            if part is None or part in ("title", "abstract") and found[part] or part == "head" and headed:
                continue
            headed = headed or part == "head"
            found.get(part, found["body"]).append((part, " ".join("".join(element.itertext()).split())))
    except ET.ParseError:
        return None
    ordered = [*found["title"], *found["abstract"], *found["body"]]
    return [leads[part] + text for part, text in ordered if text]


@F.pandas_udf(T.StringType())
def tei_markdown(xml: pd.Series) -> pd.Series:
    """TEI to Markdown; null where it can't be parsed."""
    parts = xml.map(tei_parts)
    return parts.map(lambda p: None if p is None else "\n\n".join(p) + "\n")


class Parser(Protocol):
    """What a backend offers: whether it can run where a worker runs, and a file's bytes as Markdown."""

    def available(self) -> bool: ...

    def parse(self, content: bytes) -> str: ...


class PlainText:
    """The simplest parser: UTF-8 text whose pages end at form feeds."""

    def available(self) -> bool:
        return True

    def parse(self, content: bytes) -> str:
        pages = (page.strip() for page in content.decode("utf-8", "replace").split("\f"))
        return "\n\n".join(page for page in pages if page)


def parse_files(files: DataFrame, *makes: Callable[[], Parser]) -> DataFrame:
    """Files (path, content) plus ``markdown`` and ``backend``: of the first parser that is available and gives any text.

    A worker makes each parser once.  Both are null where none does; an error of a parser is no text.
    """

    @F.pandas_udf("markdown string, backend string")
    def run(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parsers = [p for p in (make() for make in makes) if p.available()]

        def one(content: bytes | None) -> tuple[str | None, str | None]:
            for parser in parsers if content is not None else ():
                try:
                    if (said := parser.parse(bytes(content))).strip():
                        return said, type(parser).__name__
                except Exception:  # noqa: BLE001 - one broken file must not fail the job; the next parser is asked
                    continue
            return None, None

        for batch in contents:
            yield pd.DataFrame([one(x) for x in batch], columns=["markdown", "backend"], dtype=object)

    found = files.withColumn("__parsed", run.asNondeterministic()("content"))
    return found.select(*files.columns, "__parsed.markdown", "__parsed.backend")


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Text files of any file system as (path, page, text): pages end at form feeds and are stripped."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\f")).alias("page", "text")).select("path", (F.col("page") + 1).alias("page"), strip(F.col("text")).alias("text"))


def text_layer(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text, images: array<struct<xref,path>>) -> (doc_id, markdown): page texts that aren't empty,
    each image once, after the first page that has it."""
    places = pages.select("doc_id", "page", F.explode("images").alias("i")).groupBy("doc_id", "i.xref").agg(F.min(F.struct("page", "i.path")).alias("first"))
    figures = places.select("doc_id", F.col("first.page").alias("page"), F.lit(1).alias("part"), F.concat(F.lit("![figure page "), F.col("first.page").cast("string"), F.lit("]("), F.col("first.path"), F.lit(")")).alias("text"))
    texts = pages.select("doc_id", "page", F.lit(0).alias("part"), strip(F.col("text")).alias("text")).where("text != ''")
    rows = texts.unionByName(figures).withColumn("place", F.struct("page", "part", "text"))
    return rows.groupBy("doc_id").agg(F.expr("listagg(text, '\\n\\n') within group (order by place)").alias("markdown"))


def scan_stats(pages: DataFrame, sample: int = 10) -> DataFrame:
    """Pages (doc_id, page, text, image_share) -> statistics and the verdict whether the document needs OCR.

    Quality is judged on the first ``sample`` pages, joined by line ends.
    """
    text = strip(F.col("text"))
    own = pages.select("doc_id", "page", text.alias("text"), F.length(text).alias("n"), "image_share")
    image_page = (F.col("n") < 50) & (F.col("image_share") > 0.5)
    sums = own.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("n").cast("long").alias("text_chars"), F.count_if(image_page).alias("image_pages"))
    # only the pages that are judged are gathered with their texts
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    first = own.select("doc_id", "page", "text").withColumn("place", place).where(F.col("place") <= sample)
    heads = first.groupBy("doc_id").agg(F.expr("listagg(text, '\\n') within group (order by page)").alias("head"))
    sums = sums.join(heads, "doc_id")
    counted = sums.select("*", *[c.alias(k) for k, c in quality_counts(F.col("head")).items()])
    scanned = (F.col("image_pages") / F.col("pages") >= 0.5) & (F.col("text_chars") / F.col("pages") < 100)
    found = counted.withColumn("is_scanned", scanned).withColumn("is_garbled", is_garbled())
    return found.select("doc_id", "pages", "text_chars", F.bround(F.col("text_chars") / F.col("pages"), 1).alias("chars_per_page"), "image_pages", "is_scanned", "is_garbled", (F.col("is_scanned") | F.col("is_garbled")).alias("needs_ocr"))


def page_texts(pages: DataFrame, first: str = "first_try", again: str = "retry", layer: str = "layer", layer_garbled: str = "layer_garbled") -> DataFrame:
    """Pages with two transcriptions and a text layer -> ``text`` and ``outcome`` (ok, retried, rescued, lost).

    A layer rescues an empty page if it has 40 characters and isn't garbled.
    """
    given = lambda c: F.nullif(strip(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    healthy = F.when((F.length(given(layer)) >= 40) & ~F.coalesce(F.col(layer_garbled), F.lit(False)), given(layer))
    outcome = F.when(given(first).isNotNull(), "ok").when(given(again).isNotNull(), "retried").when(healthy.isNotNull(), "rescued").otherwise("lost")
    lost = F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(": no text was read -->"))
    return pages.withColumn("text", strip_fence(F.coalesce(given(first), given(again), healthy, lost), guard=False)).withColumn("outcome", outcome)


def ocr_coverage(pages: DataFrame, most: int = 50) -> DataFrame:
    """Pages (doc_id, page, outcome) -> transcribed and total pages, which were rescued and lost, whether the limit cut the document."""
    done = F.col("page") <= most
    numbers = lambda kind: F.array_sort(F.collect_list(F.when(done & (F.col("outcome") == kind), F.col("page"))))
    return pages.groupBy("doc_id").agg(F.count_if(done).alias("pages_transcribed"), F.count("*").alias("total_pages"), numbers("rescued").alias("pages_rescued"), numbers("lost").alias("pages_empty"), (F.count("*") > most).alias("truncated"))


def read_checkpoint(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines -> (k, t): the last of each key; torn lines, empty keys and null texts are skipped.

    Lines need an order: ``line`` if there is such a column, else the place in the file.
    """
    order = F.col("line") if "line" in lines.columns else F.monotonically_increasing_id()
    parsed = lines.select(order.alias("o"), F.try_parse_json(F.col(value)).alias("v"))
    rows = parsed.select("o", F.try_variant_get("v", "$.k", "string").alias("k"), F.try_variant_get("v", "$.t", "string").alias("t"))
    return rows.where("k != '' and t is not null").groupBy("k").agg(F.max_by("t", "o").alias("t"))


def parse_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (content, backend, namespace) plus ``markdown`` of the cache, null on a miss."""
    from ..functions.text import safe_namespace

    keyed = requests.withColumn("content_hash", F.sha2("content", 256)).withColumn("__n", safe_namespace(F.col("namespace")))
    known = cache.select("content_hash", F.col("backend"), F.col("namespace").alias("__n"), "markdown")
    return keyed.join(known, ["content_hash", "backend", "__n"], "left").drop("__n")


def collect_assets(spark: SparkSession, path: str, endings: tuple[str, ...] = IMAGES) -> DataFrame:
    """Files with some endings below a path: (path, rel_path, kind, bytes), each once; ``rel_path`` begins below the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ends: Column = F.lit(False)
    for e in endings:
        ends = ends | F.endswith(F.lower("path"), F.lit(e))
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jvm).toString().rstrip("/") + "/"
    below = F.when(F.startswith("path", F.lit(root)), F.substr("path", F.lit(len(root) + 1))).otherwise(F.col("path"))
    return files.where(ends).select("path", below.alias("rel_path"), F.lit("image").alias("kind"), F.col("length").alias("bytes")).dropDuplicates(["rel_path"])


def scan_notes(stats: DataFrame) -> DataFrame:
    """Warnings of a document's source, null where there is nothing to say."""
    said = F.when(F.col("is_scanned"), "the document is scanned and has no text layer").when(F.col("is_garbled"), "the text layer is garbled")
    return stats.withColumn("scan_warning", said)
