"""Memory, glossary, jobs, sources and streams on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchmill.operators import glossary, jobs, memory
from parchmill.sources import readers, writers
from parchmill.streaming import streams

LOG = "tm_id long, source string, target string, src_lang string, tgt_lang string, origin string, created_at double"


def test_memory(spark, tmp_path):
    log = spark.createDataFrame([(1, "a", "t1", "en", "ru", "auto", 1.0), (2, " a ", "t2", "en", "ru", "human", 2.0), (3, "a", "t3", "en", "ru", "auto", 3.0), (4, "", "t", "en", "ru", "auto", 4.0), (5, "b", "t5", "en", "ru", "auto", 5.0), (6, "b", "t6", "en", "ru", "auto", 6.0)], LOG)
    state = memory.resolve(log)
    assert sorted(r["tm_id"] for r in state.collect()) == [2, 3, 6]
    queries = spark.createDataFrame([(1, "a\n", "en", "ru"), (2, "a", "en", "de"), (3, "c", "en", "ru")], "query_id long, source_text string, src_lang string, tgt_lang string")
    assert {r["query_id"]: r["exact_target"] for r in memory.exact_matches(queries, state).collect()} == {1: "t2", 2: None, 3: None}
    assert memory.stats(state).first().asDict() == {"segments": 3, "human_corrections": 1}
    marks = [writers.export_if_due(state, f"{tmp_path}/x", last, 3) for last in (0, 3)]
    assert marks == [3, 3] and spark.read.text(f"{tmp_path}/x").count() == 3


def test_nearest(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "", "auto"), (2, [0.9, 0.1], "d1", "human"), (3, [0.0, 1.0], "", "auto"), (4, [1.0, 0.0], "d2", "human"), (5, None, "", "auto"), (6, [0.0, 0.0], "", "auto"), (7, [1.0], "", "auto")], "tm_id long, embedding array<double>, domain string, origin string")
    queries = spark.createDataFrame([(1, [2.0, 0.0], "d1"), (2, [1.0, 0.0], None), (3, [], "")], "query_id long, embedding array<double>, domain string")
    found = memory.nearest(queries, rows.repartition(3), k=2, least=0.5)
    assert sorted((r["query_id"], r["rank"], r["tm_id"]) for r in found.collect()) == [(1, 1, 2), (1, 2, 1), (2, 1, 4), (2, 2, 2)]
    assert memory.nearest(queries.where("false"), rows).count() == 0


def test_glossary(spark):
    entries = spark.createDataFrame([(1, "embedding", "e"), (2, "loss function", "l"), (3, "C++", "c"), (4, "++", "p")], "seq int, term string, translation string")
    texts = spark.createDataFrame([(1, "The Loss Function of C++ code"), (2, "re-embedding embeddings"), (3, "embedding.")], "text_id long, text string")
    assert sorted((r["text_id"], r["term"]) for r in glossary.match(texts, entries).collect()) == [(1, "C++"), (1, "loss function"), (3, "embedding")]
    assert [r["rank"] for r in glossary.match(texts, entries, limit=1).where("text_id = 1").collect()] == [1]
    assert sorted(r["term"] for r in glossary.match_document_terms(texts, spark.createDataFrame([(1, "embedding", "e"), (2, " ", "x"), (3, "code", "c")], "seq int, term string, translation string")).collect()) == ["code", "embedding", "embedding"]
    csv = spark.createDataFrame([("# c", "x", None), ("a", " b ", "n"), ("only", None, None), (" t ", "u", "")], "_c0 string, _c1 string, _c2 string")
    assert [tuple(r) for r in glossary.read_csv_rows(csv).collect()] == [("a", "b", "n"), ("t", "u", None)]


def test_progress(spark):
    plan = jobs.stage_plan(spark, set())
    rows = plan.orderBy("position").collect()
    assert [r["key"] for r in rows] == ["parse", "split", "translate", "assemble"] and abs(sum(r["weight"] for r in rows) - 1) < 1e-12
    ticks = spark.createDataFrame([("parse", 2.0), ("translate", 0.5), ("none", 0.3), ("parse", -1.0)], "stage string, fraction double")
    assert [round(r["progress"] * 72, 6) for r in jobs.overall_progress(ticks, plan).orderBy("progress").collect()] == [0, round(0.3 * 72, 6), 28, 50]


def calls(spark, *rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "key int, n int, at double, outcome string, after double")


def test_limits(spark):
    slots = jobs.rate_slots(spark.createDataFrame([(1, k, 0) for k in range(3)], "key int, n int, at long"), "key", ["n"], "at", 1)
    assert sorted(r["slot"] for r in slots.collect()) == [0, 1, 2]
    gated = jobs.cooldowns(calls(spark, (0.0, "refused", 7.0), (1.0, "refused", None), (2.0, "refused", None), (3.0, "success", None), (4.0, "refused", 0.0), (5.0, "refused", 500.0)), "key", ["n"], "at", "outcome", "after", 10, 60)
    assert [r["cooldown"] for r in gated.orderBy("n").collect()] == [7, 20, 40, None, 10, 60]
    assert [r["deadline"] for r in gated.orderBy("n").collect()] == [7, 21, 42, 42, 42, 65]
    feed = jobs.changes(spark.createDataFrame([(1, 0, "a", "running"), (1, 1, "a", "running"), (1, 2, None, "running"), (1, 3, "b", "completed"), (1, 4, "c", "running")], "key int, n int, p string, s string"), "key", ["n"], "p", "s")
    assert sorted(r["n"] for r in feed.collect()) == [0, 2, 3]


def test_sources(spark, tmp_path):
    xml = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A Test  Paper</title></titleStmt></fileDesc></teiHeader><text><body><div><head>Introduction</head><p>One <b>two</b></p></div></body></text></TEI>'
    rows = spark.createDataFrame([(xml,), ("<broken",), (None,)], "x string")
    assert [r[0] for r in rows.select(readers.tei_markdown("x")).collect()] == ["# A Test Paper\n\n## Introduction\n\nOne two\n", None, None]
    lines = spark.createDataFrame([(1, '{"k": "a", "t": "1"}'), (2, '{"k": "a", "t": "2"}'), (3, '{"k": "", "t": "2"}'), (4, '{"k": "b", "t"'), (5, '{"k": "c"}')], "line long, value string")
    assert [tuple(r) for r in readers.read_checkpoint(lines).collect()] == [("a", "2")]
    parsers = readers.parser_table(spark, {"marker": True, "pymupdf": True, "vlm_ocr": True})
    assert readers.choose_parser(parsers).first()[0] == "marker" and readers.choose_parser(parsers, "nougat").count() == 0
    assert [r["backend"] for r in readers.fallback_parsers(parsers, "marker").collect()] == ["pymupdf"]
    (tmp_path / "sub").mkdir()
    for name in ("a.png", "sub/b.JPG", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["rel_path"] for r in readers.collect_assets(spark, f"file:{tmp_path}").collect()) == ["a.png", "sub/b.JPG"]
    (tmp_path / "d.txt").write_text("one\ftwo")
    assert [tuple(r)[1:] for r in readers.text_pages(spark, f"file:{tmp_path}/d.txt").orderBy("page").collect()] == [(1, "one"), (2, "two")]
    pages = spark.createDataFrame([(1, 1, " a ", [(7, "images/x.png")]), (1, 2, "", [(7, "images/x.png")]), (1, 3, "b", [])], "doc_id long, page int, text string, images array<struct<xref:int,path:string>>")
    assert readers.text_layer(pages).first()["markdown"] == "a\n\n![figure page 1](images/x.png)\n\nb"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, k, 100 * k, f"p{k // 2}") for k in range(6)], "owner long, event_id long, at long, payload string")
    for part in (0, 1):
        rows.where(f"event_id % 2 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    listener = streams.Progress(lambda batch, n: seen.append(n))
    spark.streams.addListener(listener)
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = streams.write_batches(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    spark.streams.removeListener(listener)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    again = streams.write_batches(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    again.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    streams.drain(streams.change_feed(stream), f"{tmp_path}/feed", f"{tmp_path}/feed-state")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/feed").collect()) == [0, 2, 4]
