"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprint import fingerprints
from .langid import fit, held_out, identify
from .mixing import draw, sized
from .ngram_join import near_duplicates
from .packing import pack
from .pii import KINDS, find, joined
from .quality import BASE, kept, ledger
from .ranked_search import search
from .storage import materialise, shared_dir
from .token_rollup import Rollup, count_tokens, deletes, inserts, revisions
from .token_store import token_table, write_tokens
from .tokens import default_vocabulary
from .turn_repair import damaged, digests, repair
from .url_reputation import judge_urls
from .warc import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), path)
    read = read_archives(spark, path, with_payload=False).where("gap_reason is null")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op3_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = materialise(sized(_table(spark, sf_dir, "documents")), "sizes")
    mixed = draw(counted, counted)
    return mixed.select(F.col("m_id").alias("doc_id"), F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), (F.col("m_size") * F.col("m_copies")).alias("taken"))


def op4_jaccard_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("failed_bits").bitwiseAND(F.lit(BASE)) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept(F.col("failed_bits")).alias("kept"), "failed_bits")


def op6_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), default_vocabulary())


def op7_pfor_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-store")
    write_tokens(_table(spark, sf_dir, "documents"), path, default_vocabulary())
    return token_table(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("host_share", 6).alias("host_share"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents by words and by tokens.

    Words enter as an estimate of the tokens too, which a later batch revises to the true counts; documents
    under ten words are taken out and put in again.  Batches are replayed, before and after
    compaction, which changes nothing.
    """
    docs = _table(spark, sf_dir, "documents")
    words = materialise(count_tokens(docs, "words-1"), "counts")  # counted once, used by several batches
    tokens = count_tokens(docs, "byte-bpe-50k", default_vocabulary())
    estimate = words.withColumn("tokenizer", F.lit("byte-bpe-50k"))
    short = words.where("n_tokens < 10")
    rollup = Rollup(spark, shared_dir(spark, "rollup"))
    rollup.commit("0001", inserts(words).unionByName(inserts(estimate)))
    rollup.commit("0002", revisions(estimate, tokens))
    rollup.commit("0003", deletes(short))
    rollup.commit("0003", deletes(short))
    rollup.compact()
    rollup.commit("0002", inserts(words))
    rollup.commit("0004", inserts(short))
    return rollup.totals()


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op12_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find(_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and repairs of all conversations, after planted damage; conversations that lost all turns stay with zeros."""
    turns = _table(spark, sf_dir, "conversations")
    mended = repair(damaged(turns))
    lost = turns.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key")).groupBy("conv_id", "key").agg(F.lit(1).alias("one"))
    report = lost.select("conv_id", "key").join(mended.report.drop("conv_id"), "key", "left").join(digests(mended.blocks), "key", "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return report.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_warc_salvage, op2_prefix_fingerprints, op3_systematic_mix, op4_jaccard_metric_join, op5_rule_ledger, op6_minimum_slack_packing, op7_pfor_token_store, op8_viterbi_language, op9_host_reputation, op10_token_rollup, op11_tiered_search, op12_contextual_pii, op13_turn_repair)}

_DIGEST = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INT + 1, 1)"

ORACLE: dict[str, str] = {
    "op1_warc_salvage": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda k: {_DIGEST}), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first THEN first END AS refers_to
        FROM d""",
    "op3_systematic_mix": r"""
        WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        w AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s GROUP BY source),
        lv AS (SELECT *, 2.0::DOUBLE * source_size AS lim,
                  (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                  / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
               FROM w),
        r AS (SELECT *, (SELECT arg_min(level, lim / weight) FROM lv WHERE level * weight < lim) AS reached FROM lv),
        t AS (SELECT source, source_size, CASE WHEN level * weight < lim THEN reached * weight ELSE lim END AS target FROM r),
        a AS (SELECT *, length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT AS band FROM s),
        b AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 7))::BIGINT % ((count(*) OVER (PARTITION BY source, band) + 19999) // 20000) AS salt FROM a),
        k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY band, salt, size, doc_id) AS rnk FROM b),
        j AS (SELECT k.doc_id, k.size, k.rnk, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS e,
                     ('0x' || substr(md5('17:' || coalesce(k.source, '') || ':' || (k.source IS NULL)::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
              FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (size * (floor(e) + floor(rnk * (e - floor(e)) + u) - floor((rnk - 1) * (e - floor(e)) + u)))::BIGINT AS taken
        FROM j""",
    "op4_jaccard_metric_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w)),
        n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
        i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)),
        r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id""",
    "op5_rule_ledger": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, p, ws[p:p + 4] AS v FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM w)),
        t AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, v) AS c FROM g) WHERE c > 1),
        q AS (SELECT doc_id, count(DISTINCT p + j)::BIGINT AS n FROM (SELECT doc_id, p, unnest([0, 1, 2, 3, 4]) AS j FROM t) GROUP BY doc_id),
        m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                     len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
                     coalesce(q.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '\p{Lu}'))::BIGINT AS n_capitals, len(regexp_extract_all(text, '!'))::BIGINT AS n_exclamations
              FROM w LEFT JOIN q ON q.doc_id = w.doc_id),
        b AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                     ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (100 * n_symbols > 20 * n_words)::BIGINT
                      + 8 * (100 * (len(ls) - len(list_distinct(ls))) > 50 * len(ls))::BIGINT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT
                      + 32 * (100 * n_capitals > 50 * word_chars)::BIGINT + 64 * (100 * n_exclamations > 50 * n_words)::BIGINT)::BIGINT AS failed_bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b""",
}


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE["op11_tiered_search"] = rf"""
        WITH d AS (SELECT doc_id, {_TERMS} AS ws FROM documents),
        t AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) GROUP BY doc_id, term),
        f AS (SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term),
        c AS (SELECT count_if(len(ws) > 0)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS length FROM d),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, c),
        m AS (SELECT doc_id, 100 - 50 + (50 * len(ws)::BIGINT * n_docs) // length AS m FROM d, c WHERE len(ws) > 0),
        q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
        s AS (SELECT q.item_id, t.doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * m.m)))::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY q.item_id, t.doc_id)
        SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 50"""

_NULL = "coalesce({0}::VARCHAR, ' ')"


def _repair_sql() -> str:
    """Row by row over positions: the cheapest (cost, audit) of the four states is carried with the repaired text."""

    def edit(state: str, cost: str, letter: str, line: str = "") -> str:
        said = f"CASE WHEN {state}.t = '' THEN {line} ELSE {state}.t || chr(10) || {line} END" if line else f"{state}.t"
        return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', t := {said})"

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def inserted(s0: str, s1: str, s2: str, s3: str) -> tuple[str, str]:
        two = [s.replace("'I'", "'II'") for s in (edit(s0, "10", "I", "'user:' || chr(10) || 'assistant:'"), edit(s1, "10", "I", "'user:' || chr(10) || 'assistant:'"))]
        return least(s2, *[edit(s, "5", "I", "'user:'") for s in (s0, s1, s3)]), least(s3, edit(s2, "5", "I", "'assistant:'"), *two)

    def when(condition: str, option: str) -> str:
        return f"CASE WHEN {condition} THEN {option} ELSE far END"

    u, a = inserted("s0", "s1", "s2", "s3")
    keep = lambda s: edit(s, "extra", "K", "line")
    again = lambda s, role: edit(s, "extra + 1", "R", f"'{role}:' || text")
    n1 = least(edit("s1", "2", "D"), when("stays AND initial = 's'", keep("s0")))
    n2 = least(edit("i2", "2", "D"), *[when("stays AND initial = 'u'", keep(s)) for s in ("s0", "s1", "i3")], *[when("stays", again(s, "user")) for s in ("s0", "s1", "i3")])
    n3 = least(edit("i3", "2", "D"), when("stays AND initial = 'a'", keep("i2")), when("stays", again("i2", "assistant")))
    far = "struct_pack(c := 1099511627776::BIGINT, a := '', t := '')"
    crc = "xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda acc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384), xor(acc, b)), 4294967295::BIGINT), 4294967295)"
    return rf"""
        WITH RECURSIVE t AS (SELECT {_NULL.format("conv_id")} AS conv, turn, {_NULL.format("role")} AS role, {_NULL.format("text")} AS text, {_NULL.format("conv_id")} || ':' || {_NULL.format("turn")} AS k FROM conversations),
        c AS (SELECT *, {crc} % 20 AS kind FROM t),
        d AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
        p AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS pos, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
                     left(role, 1) AS initial, NOT regexp_matches(text, '[^ 	-
]') AS blank, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS closes FROM d),
        f AS (SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND closes AS truncated, coalesce(lag(initial) OVER (PARTITION BY conv ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM p),
        g AS (SELECT conv, pos, role || ':' || text AS line, text, initial, NOT (blank OR duplicate) AS stays, CASE WHEN truncated THEN 5 ELSE 0 END AS extra FROM f),
        r(conv, pos, s0, s1, s2, s3) AS (
            SELECT DISTINCT conv, 0::BIGINT, struct_pack(c := 0::BIGINT, a := '', t := ''), {far}, {far}, {far} FROM t
            UNION ALL
            SELECT conv, pos, {edit("s0", "2", "D")}, {n1}, {n2}, {n3} FROM (
                SELECT g.*, r.s0, r.s1, r.i2, r.i3, {far} AS far FROM (SELECT conv AS of, pos AS at, s0, s1, {u} AS i2, {a} AS i3 FROM r) r JOIN g ON g.conv = r.of AND g.pos = r.at + 1)),
        z AS (SELECT conv, {least("s0", a)} AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY pos DESC) AS back FROM r) WHERE back = 1),
        m AS (SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(illegal) AS illegal FROM f GROUP BY conv),
        o AS (SELECT DISTINCT conv_id, {_NULL.format("conv_id")} AS conv FROM conversations)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
               best.c::BIGINT AS cost, best.a AS audit, sha256(best.t) AS repaired_sha256
        FROM o JOIN z ON z.conv = o.conv LEFT JOIN m ON m.conv = o.conv"""


ORACLE["op13_turn_repair"] = _repair_sql()


def _reputation_sql() -> str:
    def strength(name: str, key: str) -> str:
        return f"""{name} AS (SELECT mean, least(greatest(CASE WHEN between_v > 0 THEN mean * (1 - mean) / between_v - 1 ELSE 1000.0 END, 2.0), 1000.0) AS s FROM (
            SELECT mean, CASE WHEN seen - sq / seen > 0 THEN (wt - seen * mean * mean - (many - 1) * mean * (1 - mean)) / (seen - sq / seen) ELSE 0.0 END AS between_v FROM (
            SELECT sum(bad)::DOUBLE / sum(seen) AS mean, sum(seen)::DOUBLE AS seen, sum(seen * seen)::DOUBLE AS sq, sum(bad * bad / seen::DOUBLE) AS wt, count(*) AS many
            FROM (SELECT {key}, sum(bad)::BIGINT AS bad, sum(seen)::BIGINT AS seen FROM h WHERE seen > 0 GROUP BY {key}))))"""

    return f"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        l AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
        h AS (SELECT host, count(bad)::BIGINT AS seen, coalesce(sum(bad), 0)::BIGINT AS bad, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix
              FROM p LEFT JOIN l ON l.doc_id = p.page_id GROUP BY host),
        {strength("ss", "suffix")}, {strength("sd", "domain")}, {strength("sh", "host")},
        s AS (SELECT suffix, ((SELECT mean * s FROM ss) + sum(bad)) / ((SELECT s FROM ss) + sum(seen)) AS share FROM h GROUP BY suffix),
        d AS (SELECT h.domain, (any_value(s.share) * (SELECT s FROM sd) + sum(bad)) / ((SELECT s FROM sd) + sum(seen)) AS share FROM h JOIN s ON s.suffix = h.suffix GROUP BY h.domain),
        r AS (SELECT h.host, h.seen, (d.share * (SELECT s FROM sh) + bad) / ((SELECT s FROM sh) + seen) AS share FROM h JOIN d ON d.domain = h.domain),
        v AS (SELECT p.*, r.share, r.share - 1.645 * sqrt(r.share * (1 - r.share) / ((SELECT s FROM sh) + 1 + r.seen)) AS bound,
                CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
              FROM p JOIN r USING (host))
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound > (SELECT mean FROM ss) THEN 'block' ELSE 'allow' END AS verdict, round(share, 6) AS host_share FROM v"""


ORACLE["op9_host_reputation"] = _reputation_sql()
