"""Queries over the translation memory and the glossary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import checkpoint_key, content_key
from ..functions.vectors import hashed_buckets
from ..operators import glossary, memory, validation
from ..operators.render import system_prompt
from ..storage import Scratch
from . import register, table
from .overlays import TM_SQL, tm_log, tm_vectors

BLANKS = "' ' || chr(10) || chr(9) || chr(13)"
LOG_SQL = f"{TM_SQL}, k AS (SELECT *, sha256(trim(source, {BLANKS})) AS h FROM rp WHERE trim(source, {BLANKS}) <> '' AND trim(target, {BLANKS}) <> '')"
STATE_SQL = f"{LOG_SQL}, st AS (SELECT * FROM (SELECT *, lead(tm_id) OVER (PARTITION BY h ORDER BY tm_id) AS later FROM k) WHERE later IS NULL OR origin = 'human')"
BEST_SQL = f"{STATE_SQL}, best AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY h ORDER BY origin = 'human' DESC, tm_id DESC) = 1)"


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.resolve(tm_log(spark, sf_dir, repeats=True))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as texts to translate, and each third one a second time."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("source_text"), F.lit("en").alias("src_lang"), F.lit("ru").alias("tgt_lang"))
    return turns.unionByName(turns.where("query_id % 3 = 0").withColumn("query_id", F.col("query_id") + 1_000_000_000))


QUERIES_SQL = """turns AS (SELECT conv_id * 100 + turn AS query_id, text AS source_text FROM conversations),
    q AS (SELECT * FROM turns UNION ALL SELECT query_id + 1000000000, source_text FROM turns WHERE query_id % 3 = 0)"""


@register(f"WITH {STATE_SQL} SELECT tm_id, origin, h AS source_hash FROM st")
def tm_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select("tm_id", "origin", "source_hash")


@register(f"WITH {BEST_SQL}, {QUERIES_SQL} SELECT query_id, tm_id AS exact_id, md5(target) AS target_md5 FROM q LEFT JOIN best ON best.h = sha256(trim(source_text, {BLANKS}))")
def tm_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.exact_matches(_queries(spark, sf_dir), _state(spark, sf_dir)).select("query_id", "exact_id", F.md5("exact_target").alias("target_md5"))


@register(f"WITH {STATE_SQL} SELECT count(*)::BIGINT AS segments, count(*) FILTER (origin = 'human')::BIGINT AS human_corrections FROM st")
def tm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.stats(_state(spark, sf_dir))


@register("""
    WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS tok FROM benchmark),
    g AS (SELECT item_id, unnest(list_transform(range(1, len(tok) + 1), lambda i: substr('^' || tok || '$', i, 3))) AS gram FROM t),
    h AS (SELECT item_id, md5(gram) AS m FROM g)
    SELECT item_id, (('0x' || substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2))::BIGINT % 512)::INT AS bucket,
        sum(CASE WHEN ('0x' || substr(m, 9, 2))::INT % 2 = 1 THEN 1 ELSE -1 END)::BIGINT AS weight FROM h GROUP BY ALL""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed_buckets(table(spark, sf_dir, "benchmark"), "item_id", "text")


@register("""
    WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS tok FROM benchmark),
    g AS (SELECT item_id, unnest(list_transform(range(1, len(tok) + 1), lambda i: substr('^' || tok || '$', i, 3))) AS gram FROM t),
    h AS (SELECT item_id, sha256(gram) AS m FROM g)
    SELECT item_id, (('0x' || substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2))::BIGINT % 128)::INT AS bucket,
        sum(CASE WHEN ('0x' || substr(m, 9, 2))::INT % 2 = 1 THEN 1 ELSE -1 END)::BIGINT AS weight FROM h GROUP BY ALL""")
def hash_embedding_128(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smaller variant: SHA-256, 128 buckets."""
    return hashed_buckets(table(spark, sf_dir, "benchmark"), "item_id", "text", 128, "sha2")


TOPK_SQL = """
    WITH v AS (SELECT vec_id, embedding, CASE WHEN label < 3 THEN '' ELSE 'd' || label END AS domain, vec_id % 10 = 0 AS human FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, m.vec_id AS tm_id, m.human, list_cosine_similarity(q.embedding::DOUBLE[], m.embedding::DOUBLE[]) AS similarity
          FROM v q JOIN v m ON q.vec_id % 100 = 0 AND (m.domain = '' OR q.domain = '' OR m.domain = q.domain))
    SELECT query_id, tm_id, human, round(similarity, 6) AS similarity, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY human DESC, similarity DESC, tm_id)::INT AS rank FROM s WHERE similarity >= 0.2) WHERE rank <= 3"""


@register(TOPK_SQL)
def tm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = tm_vectors(spark, sf_dir)
    found = memory.nearest(queries, rows, k=3, least=0.2)
    return found.select("query_id", "tm_id", "human", F.round("similarity", 6).alias("similarity"), "rank")


@register(TOPK_SQL)
def tm_topk_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from a memory in clusters, of which a query goes only to those that can hold better ones."""
    queries, rows = tm_vectors(spark, sf_dir)
    found, _ = memory.Clusters(rows, Scratch(spark)).search(queries, k=3, least=0.2)
    return found.select("query_id", "tm_id", "human", F.round("similarity", 6).alias("similarity"), "rank")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary of first words and first two words of the passages."""
    words = F.split("text", " ")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.array(F.concat_ws(" ", F.get(words, 0), F.get(words, 1)), F.lower(F.get(words, 2)))).alias("n", "term"))
    return rows.select((F.col("item_id") * 2 + F.col("n")).cast("int").alias("seq"), "term", F.upper("term").alias("translation"))


TERMS_SQL = """
    terms AS (SELECT (item_id * 2)::INT AS seq, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS term FROM benchmark
        UNION ALL SELECT (item_id * 2 + 1)::INT, lower(split_part(text, ' ', 3)) FROM benchmark),
    -- a mark on both sides of each character that can stand beside a term: an occurrence has marks around it
    low AS (SELECT doc_id, chr(1) || regexp_replace(lower(text), '([^\\p{L}\\p{N}_-])', chr(1) || '\\1' || chr(1), 'g') || chr(1) AS text FROM documents),
    marked AS (SELECT *, chr(1) || regexp_replace(lower(term), '([^\\p{L}\\p{N}_-])', chr(1) || '\\1' || chr(1), 'g') || chr(1) AS low FROM terms),
    hits AS (SELECT doc_id AS text_id, seq, term FROM low, marked WHERE contains(text, low)),
    ranked AS (SELECT text_id, seq, term, row_number() OVER (PARTITION BY text_id ORDER BY seq)::INT AS rank FROM hits)
"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")


@register(f"WITH {TERMS_SQL} SELECT text_id, rank, seq, term FROM ranked WHERE rank <= 30")
def glossary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.match(_texts(spark, sf_dir), _terms(spark, sf_dir)).select("text_id", "rank", "seq", "term")


@register("""
    WITH terms AS (SELECT item_id::INT AS seq, regexp_extract(text, '^([\\p{L}]+)', 1) AS term FROM benchmark)
    , low AS (SELECT doc_id, lower(text) AS text FROM documents), cut AS (SELECT doc_id AS text_id, seq, string_split(text, lower(term)) AS p FROM low, terms WHERE contains(text, lower(term)))
    SELECT text_id, seq FROM cut WHERE len(list_filter(range(1, len(p)), lambda i: CASE WHEN p[i] = '' THEN i = 1 ELSE NOT regexp_matches(right(p[i], 1), '[\\p{L}\\p{N}_]') END AND CASE WHEN p[i + 1] = '' THEN i + 1 = len(p) ELSE NOT regexp_matches(left(p[i + 1], 1), '[\\p{L}\\p{N}_]') END)) > 0""")
def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("seq"), F.regexp_extract("text", r"^([\p{L}]+)", 1).alias("term"), F.lit("x").alias("translation"))
    return glossary.match_document_terms(_texts(spark, sf_dir), terms).select("text_id", "seq")


@register("""
    WITH l AS (SELECT conv_id * 100 + turn AS seq, unnest(string_split(lower(text), ' ')) AS term, role || turn AS translation FROM conversations)
    SELECT term, min(seq) AS seq, arg_max(translation, seq) AS translation FROM l GROUP BY term""")
def glossary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.explode(F.split(F.lower("text"), " ")).alias("term"), F.concat("role", F.col("turn").cast("string")).alias("translation"), F.lit("en").alias("src_lang"), F.lit("ru").alias("tgt_lang"), F.lit(None).cast("string").alias("notes"))
    return glossary.upsert(log).select("term", "seq", "translation")


@register(f"WITH {TERMS_SQL} SELECT seq, term FROM terms WHERE term NOT IN (SELECT term FROM terms WHERE seq % 3 = 0)")
def glossary_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _terms(spark, sf_dir).withColumn("src_lang", F.lit("en")).withColumn("tgt_lang", F.lit("ru"))
    return glossary.delete(entries, entries.where("seq % 3 = 0")).select("seq", "term")


@register(f"""
    WITH {TERMS_SQL}, merged AS (SELECT text_id, CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END AS source_rank, seq, term FROM ranked WHERE rank <= 30)
    SELECT text_id, source_rank, seq, term FROM merged QUALIFY row_number() OVER (PARTITION BY text_id, lower(term) ORDER BY source_rank, seq) = 1""")
def merged_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = glossary.match(_texts(spark, sf_dir), _terms(spark, sf_dir)).withColumn("source_rank", (F.col("seq") % 2).cast("int"))
    return glossary.merge_terms(hits).select("text_id", "source_rank", "seq", "term")


@register(f"""
    WITH {BEST_SQL}, {QUERIES_SQL}, e AS (SELECT q.query_id, q.source_text, best.tm_id AS exact_id FROM q LEFT JOIN best ON best.h = sha256(trim(source_text, {BLANKS}))),
    v AS (SELECT vec_id, embedding, vec_id % 10 = 0 AS human FROM embeddings),
    n AS (SELECT count(*) AS n FROM embeddings),
    x AS (SELECT query_id, 100 * (query_id % (SELECT (n + 99) // 100 FROM n)) AS vec FROM e WHERE exact_id IS NULL),
    s AS (SELECT a.vec_id AS vec, b.vec_id AS tm_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.human DESC, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
          FROM v a JOIN v b ON a.vec_id % 100 = 0 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2),
    ex AS (SELECT query_id, string_agg(tm_id::VARCHAR, ',' ORDER BY rank) AS examples FROM x JOIN s ON s.vec = x.vec AND rank <= 3 GROUP BY query_id),
    terms AS (SELECT min(item_id)::INT AS seq, lower(split_part(text, ' ', 3)) AS term FROM benchmark GROUP BY 2),
    low AS (SELECT query_id, lower(source_text) AS text FROM e WHERE exact_id IS NULL),
    cut AS (SELECT query_id, seq, term, string_split(text, term) AS p FROM low, terms WHERE contains(text, term)),
    hits AS (SELECT query_id, seq, term FROM cut WHERE len(list_filter(range(1, len(p)), lambda i: CASE WHEN p[i] = '' THEN i = 1 ELSE NOT regexp_matches(right(p[i], 1), '[\\p{{L}}\\p{{N}}_-]') END AND CASE WHEN p[i + 1] = '' THEN i + 1 = len(p) ELSE NOT regexp_matches(left(p[i + 1], 1), '[\\p{{L}}\\p{{N}}_-]') END)) > 0),
    tr AS (SELECT query_id, string_agg(term, ',' ORDER BY seq) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS rank FROM hits) WHERE rank <= 30 GROUP BY query_id)
    SELECT e.query_id, e.exact_id, coalesce(ex.examples, '') AS examples, coalesce(tr.terms, '') AS terms FROM e LEFT JOIN ex ON ex.query_id = e.query_id LEFT JOIN tr ON tr.query_id = e.query_id""")
def rag_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match, else examples by the vector that the query's number points to, and glossary terms of the text."""
    found = _retrieved(spark, sf_dir)
    return found.select("query_id", "exact_id", F.array_join("examples", ",").alias("examples"), F.array_join("terms", ",").alias("terms"))


@register(f"""
    WITH {BEST_SQL}, {QUERIES_SQL}, e AS (SELECT q.query_id, q.source_text, best.tm_id AS exact_id FROM q LEFT JOIN best ON best.h = sha256(trim(source_text, {BLANKS}))),
    v AS (SELECT vec_id, embedding, vec_id % 10 = 0 AS human FROM embeddings),
    n AS (SELECT count(*) AS n FROM embeddings),
    x AS (SELECT query_id, 100 * (query_id % (SELECT (n + 99) // 100 FROM n)) AS vec FROM e WHERE exact_id IS NULL),
    s AS (SELECT a.vec_id AS vec, b.vec_id AS tm_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.human DESC, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
          FROM v a JOIN v b ON a.vec_id % 100 = 0 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2),
    ex AS (SELECT query_id, string_agg('SOURCE: source ' || tm_id || chr(10) || 'TRANSLATION: target ' || tm_id, chr(10) || '---' || chr(10) ORDER BY rank) AS examples FROM x JOIN s ON s.vec = x.vec AND rank <= 3 GROUP BY query_id),
    terms AS (SELECT min(item_id)::INT AS seq, lower(split_part(text, ' ', 3)) AS term FROM benchmark GROUP BY 2),
    low AS (SELECT query_id, lower(source_text) AS text FROM e WHERE exact_id IS NULL),
    cut AS (SELECT query_id, seq, term, string_split(text, term) AS p FROM low, terms WHERE contains(text, term)),
    hits AS (SELECT query_id, seq, term FROM cut WHERE len(list_filter(range(1, len(p)), lambda i: CASE WHEN p[i] = '' THEN i = 1 ELSE NOT regexp_matches(right(p[i], 1), '[\\p{{L}}\\p{{N}}_-]') END AND CASE WHEN p[i + 1] = '' THEN i + 1 = len(p) ELSE NOT regexp_matches(left(p[i + 1], 1), '[\\p{{L}}\\p{{N}}_-]') END)) > 0),
    tr AS (SELECT query_id, string_agg('- ' || term || ' -> ' || upper(term), chr(10) ORDER BY seq) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS rank FROM hits) WHERE rank <= 30 GROUP BY query_id)
    SELECT e.query_id, md5(concat_ws(chr(10) || chr(10), 'Translate the text from en to ru. Keep Markdown, formulas and every placeholder as they are.', 'Glossary:' || chr(10) || tr.terms, 'Examples:' || chr(10) || ex.examples)) AS prompt_md5
    FROM e LEFT JOIN ex ON ex.query_id = e.query_id LEFT JOIN tr ON tr.query_id = e.query_id WHERE e.exact_id IS NULL""")
def rag_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is told with each text that the memory doesn't know: the glossary's terms in it and the nearest pairs."""
    told = lambda c, make: F.transform(F.col(c), make)
    terms = told("terms", lambda t: F.struct(t.alias("term"), F.upper(t).alias("translation")))
    examples = told("examples", lambda i: F.struct(F.concat(F.lit("source "), i).alias("source"), F.concat(F.lit("target "), i).alias("target")))
    system = system_prompt("en", "ru", terms, examples, F.lit(None).cast("string"))
    return _retrieved(spark, sf_dir).where("exact_target is null").select("query_id", F.md5(system).alias("prompt_md5"))


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _queries(spark, sf_dir)
    vectors, rows = tm_vectors(spark, sf_dir)
    near = memory.nearest(vectors.withColumn("domain", F.lit("")), rows, k=3, least=0.2)
    count = table(spark, sf_dir, "embeddings").agg(F.ceil(F.count("*") / 100).alias("many"))  # one row
    pointed = queries.select("query_id").join(F.broadcast(count)).select("query_id", (100 * (F.col("query_id") % F.col("many"))).alias("vec"))
    neighbours = pointed.join(near.withColumnRenamed("query_id", "vec"), "vec").select("query_id", "rank", "tm_id")
    terms = table(spark, sf_dir, "benchmark").select(F.lower(F.get(F.split("text", " "), 2)).alias("term"), "item_id").groupBy("term").agg(F.min("item_id").cast("int").alias("seq")).withColumn("translation", F.col("term"))
    hits = glossary.match(queries.select(F.col("query_id").alias("text_id"), F.col("source_text").alias("text")), terms).select(F.col("text_id").alias("query_id"), "rank", "term")
    return memory.retrieve(queries, _state(spark, sf_dir), hits, neighbours)


@register(f"""
    WITH {BEST_SQL}, {QUERIES_SQL}, f AS (SELECT query_id, source_text, min(query_id) OVER (PARTITION BY source_text) AS first FROM q)
    SELECT query_id, CASE WHEN query_id > first THEN 'run_cache' WHEN query_id % 7 = 0 THEN 'checkpoint' WHEN best.tm_id IS NOT NULL THEN 'memory' ELSE 'model' END AS origin
    FROM f LEFT JOIN best ON best.h = sha256(trim(source_text, {BLANKS}))""")
def translation_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = memory.exact_matches(_queries(spark, sf_dir), _state(spark, sf_dir))
    _, placed = memory.deduplicate(queries, ["query_id"])
    _, origin = memory.first_source(F.when(F.col("is_copy"), F.lit("x")), F.when(F.col("query_id") % 7 == 0, F.lit("x")), F.col("exact_target"), F.lit("x"))
    return placed.select("query_id", origin.alias("origin"))


@register("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10)))))::INT AS seg_no FROM documents)
    SELECT doc_id, seg_no, first_value(doc_id) OVER w AS first_doc, first_value(seg_no) OVER w AS first_seg, count(*) OVER (PARTITION BY t)::BIGINT AS copies FROM l WINDOW w AS (PARTITION BY t ORDER BY doc_id, seg_no)""")
def segment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg_no", "source_text"))
    _, placed = memory.deduplicate(lines, ["doc_id", "seg_no"])
    return placed.select("doc_id", "seg_no", F.col("first.doc_id").alias("first_doc"), F.col("first.seg_no").alias("first_seg"), "copies")


@register(f"""
    WITH {QUERIES_SQL}, c AS (SELECT substr(sha256('en>ru' || chr(0) || trim(source_text, {BLANKS})), 1, 24) AS k FROM q WHERE query_id % 3 = 0)
    SELECT query_id FROM q WHERE substr(sha256('en>ru' || chr(0) || trim(source_text, {BLANKS})), 1, 24) NOT IN (SELECT k FROM c)""")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _queries(spark, sf_dir).withColumn("k", checkpoint_key(F.col("source_text"), F.col("src_lang"), F.col("tgt_lang")))
    return memory.pending(keyed, keyed.where("query_id % 3 = 0")).select("query_id")


@register(f"""
    WITH {QUERIES_SQL}, log AS (SELECT sha256('en>ru' || chr(0) || trim(source_text, {BLANKS})) AS h, query_id, run, run + query_id % 2 * 10 AS seq, (query_id + run) % 3 = 0 AS good FROM q, (SELECT unnest([1, 2, 3]) AS run) WHERE query_id % 5 > 0 AND (query_id + run) % 7 > 0 AND run <> query_id % 4),
    best AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY h ORDER BY good DESC, seq DESC, query_id DESC) = 1)
    SELECT q.query_id, best.good, best.seq::BIGINT AS seq, best.query_id AS answered, best.good IS NOT TRUE AS pending FROM q LEFT JOIN best ON best.h = sha256('en>ru' || chr(0) || trim(q.source_text, {BLANKS}))""")
def checkpoint_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint of three runs with planted failures: each text's best answer, and the texts that are asked again."""
    keyed = _queries(spark, sf_dir).withColumn("k", checkpoint_key(F.col("source_text"), F.col("src_lang"), F.col("tgt_lang")))
    runs = keyed.select("k", "query_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("run")).where("query_id % 5 > 0 and (query_id + run) % 7 > 0 and run <> query_id % 4")
    failed = validation.issue((F.col("query_id") + F.col("run")) % 3 != 0, "empty_translation", "error", "planted")
    log = runs.select("k", F.struct((F.col("run") + F.col("query_id") % 2 * 10).alias("seq"), "query_id").alias("at"), failed.alias("issues"))
    best = memory.settled(log, validation.is_ok(F.col("issues")), "at")
    pending = memory.pending(keyed, best.where("ok")).select("query_id", F.lit(True).alias("p"))
    found = keyed.join(best, "k", "left").join(pending, "query_id", "left")
    return found.select("query_id", F.col("ok").alias("good"), F.col("at.seq").alias("seq"), F.col("at.query_id").alias("answered"), F.coalesce("p", F.lit(False)).alias("pending"))


@register(f"WITH {TM_SQL} SELECT tm_id, sha256(trim(source, ' ' || chr(10))) AS source_hash, origin FROM tm")
def tm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm_log(spark, sf_dir).select("tm_id", content_key(F.col("source")).alias("source_hash"), "origin")


@register(f"WITH {TM_SQL} SELECT tm_id, c AS copy, length(source) + length(target) AS n_chars FROM tm, (SELECT unnest([1, 2, 3]) AS c) WHERE c = 1 OR origin = 'human'")
def chat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory.chat_rows(tm_log(spark, sf_dir), "Translate.")
    parsed = F.from_json("value", "struct<messages:array<struct<role:string,content:string>>>")["messages"]
    return rows.select("tm_id", "copy", (F.length(parsed[1]["content"]) + F.length(parsed[2]["content"])).cast("long").alias("n_chars"))


@register(f"WITH {TM_SQL} SELECT md5(source) AS source_md5, md5(target) AS target_md5, 'en' AS src_lang, 'ru' AS tgt_lang, origin FROM tm")
def jsonl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("value", "source string, target string, src_lang string, tgt_lang string, origin string")
    return memory.dataset_rows(tm_log(spark, sf_dir)).select(parsed.alias("v")).select(F.md5("v.source").alias("source_md5"), F.md5("v.target").alias("target_md5"), "v.src_lang", "v.tgt_lang", "v.origin")


@register(f"""
    WITH {TM_SQL}, n AS (SELECT tm_id, row_number() OVER (ORDER BY tm_id) AS total FROM tm)
    SELECT tm_id, total // 25 > (total - 1) // 25 AS due FROM n""")
def export_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = memory.numbered(tm_log(spark, sf_dir).select("tm_id"), "tm_id")
    return counted.select("tm_id", memory.export_due(F.col("total"), F.col("total") - 1, 25).alias("due"))
