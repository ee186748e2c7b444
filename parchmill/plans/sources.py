"""Queries over sources: scan statistics, OCR outcomes, checkpoints, caches, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semi
from ..sources import readers
from ..storage import shared_dir
from ..streaming import streams
from . import register, table
from .overlays import BAD_SQL, JOBS_SQL, docs_bad, job_log


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of damaged documents as pages; every third document's pages are images."""
    lines = docs_bad(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    image = F.when(F.col("doc_id") % 3 == 0, F.lit(0.9)).otherwise(F.lit(0.1))
    text = F.when(F.col("doc_id") % 3 == 0, F.left("text", F.lit(20))).otherwise(F.col("text"))
    return lines.select("doc_id", "page", text.alias("text"), image.alias("image_share"))


@register(f"""
    WITH {BAD_SQL}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS page FROM bad),
    p AS (SELECT doc_id, page, trim(CASE WHEN doc_id % 3 = 0 THEN left(t, 20) ELSE t END, ' ') AS t FROM l),
    s AS (SELECT doc_id, count(*)::BIGINT AS pages, sum(length(t))::BIGINT AS text_chars, count(*) FILTER (length(t) < 50 AND doc_id % 3 = 0)::BIGINT AS image_pages, string_agg(t, chr(10) ORDER BY page) FILTER (page < 10) AS head FROM p GROUP BY doc_id),
    c AS (SELECT *, len(regexp_extract_all(head, '[^\\s]')) AS n, len(regexp_extract_all(head, '[\\x{{E000}}-\\x{{F8FF}}\\x{{FFFD}}]')) AS su, len(regexp_extract_all(head, '\\p{{L}}')) AS le, len(regexp_extract_all(head, '[\\p{{L}}\\p{{Nd}}]')) AS me, len(regexp_extract_all(head, '[ÐÑ][\\x{{80}}-\\x{{BF}}]')) AS mo FROM s)
    SELECT doc_id, pages, text_chars, image_pages, image_pages / pages >= 0.5 AND text_chars / pages < 100 AS is_scanned,
        n >= 200 AND (su / n >= 0.12 OR mo / n >= 0.10 OR (le / n < 0.35 AND su / n > 0.02) OR me / n < 0.20) AS is_garbled FROM c""")
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.scan_stats(_pages(spark, sf_dir)).select("doc_id", "pages", "text_chars", "image_pages", "is_scanned", "is_garbled")


@register("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10)))))::INT + 1 AS page FROM documents),
    o AS (SELECT doc_id, page, CASE WHEN trim(t, ' ') = '' THEN 'lost' WHEN page % 4 > 0 THEN 'ok' WHEN page % 8 > 0 THEN 'retried' WHEN length(trim(t, ' ')) >= 40 THEN 'rescued' ELSE 'lost' END AS outcome FROM l)
    SELECT doc_id, count(*) FILTER (page <= 50)::BIGINT AS pages_transcribed, count(*)::BIGINT AS total_pages, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (page <= 50 AND outcome = 'rescued'), '') AS rescued,
        coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (page <= 50 AND outcome = 'lost'), '') AS lost, count(*) > 50 AS truncated FROM o GROUP BY doc_id""")
def ocr_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pages whose first try fails each fourth time, and the second each eighth."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t")).withColumn("page", F.col("p") + 1)
    tried = lines.select("doc_id", "page", F.when(F.col("page") % 4 > 0, F.col("t")).alias("first_try"), F.when(F.col("page") % 8 > 0, F.col("t")).alias("retry"), F.col("t").alias("layer"), F.lit(False).alias("layer_garbled"))
    covered = readers.ocr_coverage(readers.page_texts(tried))
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return covered.select("doc_id", "pages_transcribed", "total_pages", listed("pages_rescued").alias("rescued"), listed("pages_empty").alias("lost"), "truncated")


@register("""
    WITH c AS (SELECT conv_id * 100 + turn + 1000000000 * c AS line, substr(sha256('en>ru' || chr(0) || text), 1, 24) AS k, role || c AS t FROM conversations, (SELECT unnest([0, 1]) AS c) WHERE (conv_id * 100 + turn + 1000000000 * c) % 11 > 0)
    SELECT k, arg_max(t, line) AS t FROM c GROUP BY k""")
def checkpoint_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, each text twice, of which some are torn."""
    line = F.col("conv_id") * 100 + F.col("turn") + 1_000_000_000 * F.col("c")
    key = F.substring(F.sha2(F.concat(F.lit("en>ru\0"), F.col("text")), 256), 1, 24)
    whole = F.to_json(F.struct(key.alias("k"), F.concat("role", F.col("c").cast("string")).alias("t")))
    lines = table(spark, sf_dir, "conversations").withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).select(line.alias("line"), F.when(line % 11 > 0, whole).otherwise(F.left(whole, F.lit(20))).alias("value"))
    return readers.read_checkpoint(lines)


@register("""
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS markdown FROM documents WHERE text IS NOT NULL""")
def parse_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    requests = docs.select("doc_id", F.concat("doc_id", F.lit("/"), "text").cast("binary").alias("content"), F.lit("grobid").alias("backend"), F.lit("en ru").alias("namespace"))
    cache = docs.where("doc_id % 2 = 0").select(F.sha2(F.concat("doc_id", F.lit("/"), "text").cast("binary"), 256).alias("content_hash"), F.lit("grobid").alias("backend"), F.lit("en_ru").alias("namespace"), F.col("lang").alias("markdown"))
    return readers.parse_cache(requests, cache).select("doc_id", "markdown")


@register("""
    SELECT item_id, '# ' || trim(regexp_replace(split_part(text, ' ', 1), '\\s+', ' ', 'g')) || chr(10) || chr(10) || '## Abstract' || chr(10) || chr(10) || trim(regexp_replace(text, '\\s+', ' ', 'g')) || chr(10) || chr(10) || '## Head' || chr(10) || chr(10) || 'one two' || chr(10) AS markdown FROM benchmark""")
def tei_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    first = F.substring_index(safe, " ", 1)
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'), first, F.lit("</title></titleStmt></fileDesc><profileDesc><abstract><p>"), safe, F.lit("</p></abstract></profileDesc></teiHeader><text><body><div><head>Head</head><p>one <hi>two</hi></p><p> </p></div></body></text></TEI>"))
    return table(spark, sf_dir, "benchmark").select("item_id", readers.tei_markdown(xml).alias("markdown"))


@register("""
    SELECT doc_id, quality = 1 AS ok, CASE WHEN doc_id % 5 > 0 THEN (quality * 50 + toxic)::DOUBLE END AS score, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS n_terms FROM labels""")
def json_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of models around JSON: fences, prose before and after, none at all."""
    number = (F.col("quality") * 50 + F.col("toxic")).cast("string")
    verdict = F.concat(F.lit('```json\n{"ok": '), (F.col("quality") == 1).cast("string"), F.lit(', "notes": null}\n```'))
    said = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit('Score: {"score": '), number, F.lit(', "comment": "x"} end'))).otherwise(F.lit("no number"))
    terms = F.when(F.col("doc_id") % 3 == 0, F.lit("none")).otherwise(F.lit('here [{"term": " a ", "translation": "b"}, {"term": "c"}, {"term": "d", "translation": "e"}]'))
    parsed = semi.object_variant(verdict)
    return table(spark, sf_dir, "labels").select("doc_id", F.try_variant_get(parsed, "$.ok", "boolean").alias("ok"), semi.score(said).alias("score"), F.size(semi.terms(terms)).alias("n_terms"))


@register("SELECT 'nougat' AS backend, 'grobid,pymupdf' AS fallback")
def parser_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = readers.parser_table(spark, {"nougat": True, "grobid": True, "pymupdf": True, "vlm_ocr": True})
    chosen = readers.choose_parser(known)
    rest = readers.fallback_parsers(known, "nougat").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "backend"))), lambda x: x["backend"]), ",").alias("fallback"))
    return chosen.join(rest, F.lit(True))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_log(spark, sf_dir).where("event_type = 'signup'").select("owner", "event_id", F.floor(F.col("at") / 1_000_000).alias("at"))


def _streamed(spark: SparkSession, rows: DataFrame, plan, mode: str = "append") -> DataFrame:
    """Rows written to files, streamed through a plan to its end, and read back; a batch takes all files that are there."""
    name = shared_dir(spark, "stream")
    rows.write.parquet(f"{name}/in")
    stream = plan(spark.readStream.schema(rows.schema).parquet(f"{name}/in"))
    streams.drain(stream, f"{name}/out", f"{name}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{name}/out")


@register("SELECT event_type, count(*)::BIGINT AS n FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY event_type")
def streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of type and user, each once, through a stream with a watermark longer than the data."""
    rows = table(spark, sf_dir, "events").select("event_type", F.concat_ws("/", "event_type", "user_id").alias("pair"), F.col("ts").cast("timestamp").alias("ts"))
    found = _streamed(spark, rows, lambda s: streams.once(s, "pair", "ts", "60 days"))
    return found.groupBy("event_type").agg(F.count("*").alias("n"))


@register(f"""
    WITH RECURSIVE {JOBS_SQL}, u AS (SELECT owner, event_id, ts_us // 1000000 AS ts_us, row_number() OVER (PARTITION BY owner ORDER BY ts_us // 1000000, event_id) AS n FROM jl WHERE event_type = 'signup'),
    r AS (SELECT owner, n, event_id, ts_us AS opened, 1 AS used, true AS allowed FROM u WHERE n = 1
        UNION ALL SELECT u.owner, u.n, u.event_id, CASE WHEN u.ts_us >= r.opened + 864000 THEN u.ts_us ELSE r.opened END,
            CASE WHEN u.ts_us >= r.opened + 864000 THEN 1 WHEN r.used < 3 THEN r.used + 1 ELSE r.used END, u.ts_us >= r.opened + 864000 OR r.used < 3 FROM r JOIN u ON u.owner = r.owner AND u.n = r.n + 1)
    SELECT owner, event_id, allowed FROM r""")
def streaming_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upload quota with keyed state in a stream."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    try:
        found = _streamed(spark, _uploads(spark, sf_dir), lambda s: streams.quota(s, 864000, 3))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return found.select("owner", "event_id", "allowed")
