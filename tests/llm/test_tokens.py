"""Packing, token files, language identification, rollups and the pipeline."""

from __future__ import annotations

import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from parchmill.llm import langid, token_store
from parchmill.llm.packing import fullest, pack, pack_lengths, slots
from parchmill.llm.storage import materialise, shared_dir
from parchmill.llm.token_rollup import Rollup, count_tokens, deletes, inserts, revisions
from parchmill.llm.token_store import decode_segments, encode_segment, read_tokens, token_table, write_tokens
from parchmill.llm.tokens import Encoder, default_vocabulary

DOCS = "doc_id long, text string, piece int, length long, lang string, source string, n_tokens long"
TEXTS = [None, "", " ", "a", "it's we'll  'tis", "l'été, d'accord. don't? a.", "日本語 テキスト", "<|endoftext|> a", "a\tb c\r\n d", "\n\n", "x\xa0y", "word " * 3000, "Ünï çødé 1234 %%%", "a\nb\nc", "tail "]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 1, 2, "en", "s", 3) for k, t in texts], DOCS)


@pytest.fixture(scope="module")
def encode():
    return Encoder(default_vocabulary())


def ids_of(encode, text) -> list[int]:
    return encode.library.encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder(encode, spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    for text in TEXTS + texts:
        assert np.frombuffer(encode.encode(text), "<u4").tolist() == ids_of(encode, text)


def test_encoder_added_tokens(encode):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(default_vocabulary())
    for text in [*TEXTS, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y\nz", "a <|endoftext| > b <|endoftext|><|endoftext|>."]:
        assert np.frombuffer(encode.encode(text), "<u4").tolist() == fresh.encode(text or "", add_special_tokens=False).ids
    assert np.frombuffer(encode.encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]


def test_encoder_bounded():
    """What an encoder keeps of 700,000 distinct words is bounded, and ids stay right."""
    encoder = Encoder(default_vocabulary())
    letters = "abcdefghijklmnopqrst"
    words = ["".join(letters[k // 20**i % 20] for i in range(5)) for k in range(700_000)]
    for k in range(0, len(words), 1000):
        encoder.encode(" ".join(words[k : k + 1000]))
    kept = [table for pieces in (encoder.spaced, encoder.bare) for table in (pieces, pieces.old)]
    assert sum(map(sys.getsizeof, kept)) + sum(sys.getsizeof(x) for table in kept for item in table.items() for x in item) < 50_000_000
    again = "the " + " ".join(words[::7001])
    assert np.frombuffer(encoder.encode(again), "<u4").tolist() == ids_of(encoder, again)


def test_encoder_cuts_marks_off():
    """A word is encoded and kept once, whatever marks follow it; ids of any mix of letters, digits and marks stay right."""
    encoder, marks = Encoder(default_vocabulary()), "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    words = [f"{a}{b}{c}" for a in "stéfanol" for b in "aeiouüø" for c in ("n", "rth", "ß")]
    made, encode_mapped = [], encoder.encode_mapped
    encoder.encode_mapped = lambda mapped: made.append(mapped) or encode_mapped(mapped)
    for mark in marks:
        text = "x " + " ".join(w + mark for w in words) + " x"
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(encoder, text)
    assert len(made) <= len(words) + len(marks) + 5 and len(encoder.spaced) + len(encoder.bare) <= len(words) + 2 * len(marks) + 5
    rng = np.random.default_rng(7)
    signs = np.array(list(marks + "'' \n aéßøɏɐstdmlvre091²½ªпд字"))
    for _ in range(3000):
        text = "".join(rng.choice(signs, rng.integers(1, 25)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(encoder, text), text


def test_texts_are_read_in_small_batches(spark, small):
    """Parquet's default of 4,096 texts a batch fills an executor's heap; each stage alone lowers it, and a lower value stays."""
    setting = "spark.sql.parquet.columnarReaderBatchSize"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(setting)
        stage(spark, docs, small)
        assert int(spark.conf.get(setting)) <= 512, name
    spark.conf.set(setting, "64")
    corpus_pipeline.quality_rules(spark, docs, small)
    assert spark.conf.get(setting) == "64"
    spark.conf.unset(setting)


def check_packing(rows, texts, encode, capacity=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for key, text in texts:
        ids = [*ids_of(encode, text), 0]
        pieces = sorted(by_doc[key], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert sum(p["length"] for p in pieces) == len(ids) and all(p["length"] == capacity for p in pieces[1:])
        for p in pieces:
            assert p["ids_crc32"] == crc(ids[p["start"] : p["start"] + p["length"]])
    for pieces in by_sequence.values():
        end = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == end
            end += p["length"]
        assert end <= capacity
    return len(by_sequence)


def test_pack(spark, small, encode):
    texts = list(enumerate(TEXTS)) + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = pack(frame(spark, texts), default_vocabulary()).collect()
    many = check_packing(rows, texts, encode)
    assert many <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert pack(frame(spark, []), default_vocabulary()).count() == 0
    twice = pack(frame(spark, [(1, "a b"), (1, "a b"), (None, None)]), default_vocabulary()).collect()
    assert sorted((r["sequence_id"], r["offset"], r["length"]) for r in twice) == [(0, 0, 3), (0, 3, 3), (0, 6, 1)]


def test_pack_lengths():
    rng = np.random.default_rng(0)
    for _ in range(20):
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, 101, 15), rng.integers(1, 40, 15))}
        patterns = pack_lengths(dict(counts), 100)
        used = defaultdict(int)
        for p in patterns:
            assert sum(k * v for k, v in p.uses) <= 100
            for k, v in p.uses:
                used[k] += v * p.times
        assert used == counts
        bins = sum(p.times for p in patterns)
        assert bins <= 1.15 * -(-sum(k * v for k, v in counts.items()) // 100) + sum(v for k, v in counts.items() if k > 50)
        assert sum(len(v) for v in slots(patterns).values()) == sum(len(p.uses) for p in patterns)


def test_segments():
    rng = np.random.default_rng(1)
    for count, most in ((0, 1), (1, 1), (5, 2), (1024, 50257), (1025, 1 << 32), (5000, 70000)):
        ids = rng.integers(0, most, count, dtype=np.uint64).astype(np.uint32)
        if count > 10:
            ids[::97] = most - 1
        cuts = [count // 2, count - count // 2]
        data = encode_segment(7, [None, -5], cuts, ids.copy()) + b"\n" + encode_segment(8, [1], [count], ids.copy()) + b"\n"
        found = list(decode_segments(data))
        assert [f[0] for f in found] == [7, 8] and found[0][1] == [None, -5] and found[0][2].tolist() == cuts
        assert all((f[3] == ids).all() for f in found)
    with pytest.raises(ValueError):
        list(decode_segments(data[:60] + bytes([data[60] ^ 1]) + data[61:]))


def test_blocks_of_one_width_are_unpacked_together(monkeypatch):
    """A segment is read with one call for each width of its full blocks, not for each block; ids stay right at every width."""
    rng, calls = np.random.default_rng(3), []
    unpack = token_store.unpack_bits
    monkeypatch.setattr(token_store, "unpack_bits", lambda *x: calls.append(x) or unpack(*x))
    for width in range(33):
        ids = rng.integers(0, 1 << width, 20 * 1024 + 5, dtype=np.uint64).astype(np.uint32)
        ids[::1024] = 0
        ids[5::1024] = (1 << 32) - 1  # an exception, unless all bits are kept
        for block_ids in (1024, 100):
            calls.clear()
            (_, _, _, got), *_ = decode_segments(encode_segment(1, [1], [len(ids)], ids.copy(), block_ids) + b"\n")
            assert got.dtype == np.uint32 and (got == ids).all()
            assert block_ids % 8 or len(calls) <= 3


def test_token_files(spark, encode):
    rows = list(enumerate(TEXTS * 3)) + [(None, "null id"), (3, "again")]
    path = shared_dir(spark, "tokens")
    write_tokens(frame(spark, rows[::-1]).repartition(4), path, default_vocabulary())
    table = {(r["start"], r["doc_id"]): r for r in token_table(spark, path).collect()}
    assert len(table) == len(rows)
    start, texts = 0, defaultdict(list)
    for k, t in rows:
        texts[k].append(t)
    last = -1
    for (at, key), r in sorted(table.items(), key=lambda x: x[0][0]):
        assert at == start and (key is None or key >= last)
        last = -1 if key is None else key
        assert any(r["ids_crc32"] == crc([*ids_of(encode, t), 2]) and r["n_tokens"] == len(ids_of(encode, t)) + 1 for t in texts[key])
        start += r["n_tokens"]
    back = {r["doc_id"]: list(r["ids"]) for r in read_tokens(spark, path, with_ids=True).where("doc_id = 5").collect()}
    assert back[5] == [*ids_of(encode, TEXTS[5]), 2]
    empty = shared_dir(spark, "tokens")
    write_tokens(frame(spark, []), empty, default_vocabulary())
    assert token_table(spark, empty).count() == 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs.select("doc_id", "lang", "text"), langid.fit(docs)).withColumn("h", langid.held_out(F.col("doc_id"))).collect()
    assert all(r["h"] == (langid.crc_fold(r["doc_id"]) == 0) for r in found)
    test = [r for r in found if r["h"]]
    assert len(test) > 100 and sum(r["lang"] == r["lang_pred"] for r in test) >= 0.97 * len(test)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edges(spark):
    model = langid.train([("the cat and the dog with that thing", "en"), ("der hund und die katze nicht mit dem", "de"), ("и собака это не кошка", "ru")] * 5)
    # a clash with every name that the operator uses inside or adds
    schema = "doc_id long, text string, lang string, score double, lang_pred string, n_spans string, found int, __pm_row int"
    rows = [(1, None), (2, ""), (3, "123 !? ²"), (4, "the dog and the cat"), (5, "собака"), (6, "漢字"), (None, "die katze"), (8, "the dog with the cat " * 50_000), (4, "the dog and the cat")]
    docs = spark.createDataFrame([(k, t, None, 0.5, "x", "y", 1, 2) for k, t in rows], schema)
    found = langid.identify(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "found", "__pm_row", "lang_pred", "score", "n_spans"]
    got = {r["doc_id"]: r for r in found.collect()}
    assert {k: got[k]["lang_pred"] for k in (1, 2, 3, 4, 5, None, 8)} == {1: "und", 2: "und", 3: "und", 4: "en", 5: "ru", None: "de", 8: "en"}
    assert got[3]["score"] == 0 and got[6]["lang_pred"] in model.languages and got[6]["score"] == 0 and found.count() == len(rows)
    mixed = "the cat and the dog with that thing " * 6 + "der hund und die katze nicht mit dem " * 6 + "и собака это не кошка"
    assert [s[2] for s in langid.spans(mixed, langid.Scores(model))] == ["en", "de", "ru"]
    none = docs.where("false")
    assert langid.identify(docs, langid.fit(none)).where("lang_pred != 'und'").count() == 0 and langid.identify(none, model).count() == 0


def test_language_sample(spark):
    rows = [(k % 40, f"text {k % 80} of a language", "en" if k % 2 else "de") for k in range(400)] + [(900, "x" * 100_000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs).languages == langid.fit(docs.repartition(7)).languages == ["de", "en", "fr"]
    few = [langid.fit(d, most=5).trigrams for d in (docs, docs.repartition(7))]
    assert few[0].keys() == few[1].keys() and all((few[0][k] == few[1][k]).all() for k in few[0])
    assert langid.fit(docs, most_bytes=50_000).languages == ["de", "en"]


def test_viterbi():
    rng = np.random.default_rng(2)
    for _ in range(50):
        s = rng.normal(0, 3, (7, 3))

        def value(path, s=s):
            return sum(s[t, k] for t, k in enumerate(path)) - 4 * sum(a != b for a, b in zip(path, path[1:]))

        best = max(value(p) for p in np.ndindex(*(3,) * 7))
        assert abs(value(langid.viterbi(s, 4.0).tolist()) - best) < 1e-9


def test_viterbi_without_the_overall_best():
    found = langid.viterbi(np.array([[0.0, -100.0, -7.0], [-100.0, 0.0, -7.0]]), 8.0)
    assert found.tolist() == [0, 1]
    rng = np.random.default_rng(5)
    for _ in range(1500):
        s = rng.normal(0, 3, (int(rng.integers(1, 6)), 3))

        def value(path, s=s):
            return sum(s[t, k] for t, k in enumerate(path)) - 4 * sum(a != b for a, b in zip(path, path[1:]))

        best = max(value(p) for p in np.ndindex(*(3,) * len(s)))
        assert abs(value(langid.viterbi(s, 4.0).tolist()) - best) < 1e-9


def test_fullest_against_brute_force():
    """The subset sum is the best there is, and uses no more pieces than there are."""
    from itertools import product

    rng = np.random.default_rng(9)
    for _ in range(300):
        lengths = sorted({int(x) for x in rng.integers(1, 40, rng.integers(1, 6))}, reverse=True)
        counts = {x: int(rng.integers(1, 4)) for x in lengths}
        room = int(rng.integers(0, 90))
        used = dict(fullest(room, counts, lengths))
        assert all(0 < n <= counts[x] for x, n in used.items())
        best = max(t for many in product(*(range(counts[x] + 1) for x in lengths)) if (t := sum(n * x for n, x in zip(many, lengths))) <= room)
        assert sum(n * x for x, n in used.items()) == best


def test_rollup(spark, encode):
    docs = spark.createDataFrame([(1, "a b", "s", "en"), (2, "c", "s", "en"), (3, None, None, None), (2, "c", "s", "en")], "doc_id long, text string, source string, lang string")
    words, tokens = count_tokens(docs, "w"), count_tokens(docs, "t", default_vocabulary())
    rollup = Rollup(spark, shared_dir(spark, "rollup"))
    for _ in range(2):
        rollup.commit("1", inserts(words))
    key = lambda f: {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in f.collect()}
    assert key(rollup.totals()) == {("s", "en", "w"): (3, 4), (None, None, "w"): (1, 0)}
    rollup.commit("2", revisions(words.where("doc_id = 1"), tokens.where("doc_id = 1")))
    rollup.commit("3", deletes(words.where("doc_id = 3")))
    want = {("s", "en", "w"): (2, 2), ("s", "en", "t"): (1, len(ids_of(encode, "a b")))}
    assert key(rollup.totals()) == want
    rollup.compact()
    assert key(rollup.totals()) == want
    again = Rollup(spark, rollup.path)
    assert not any(again.commit(x, inserts(words)) for x in "123") and key(again.totals()) == want  # replays after compaction
    assert again.commit("4", inserts(words.where("doc_id = 2").limit(1))) and key(again.totals())["s", "en", "w"] == (3, 3)
    again.compact()
    assert not any(again.commit(x, inserts(words)) for x in "1234")
    none = Rollup(spark, shared_dir(spark, "rollup"))
    assert none.totals().count() == 0 and none.commit("1", inserts(words.where("false"))) and none.totals().count() == 0
    with pytest.raises(ValueError):
        none.commit("a\nb", inserts(words))


def test_rollup_crash_and_race(spark, monkeypatch):
    rows = spark.createDataFrame([("s", "en", "w", 1, 5)], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
    total = lambda r: [(x["n_docs"], x["n_tokens"]) for x in r.totals().collect()]
    rollup = Rollup(spark, shared_dir(spark, "rollup"))
    rollup.commit("1", rows)

    def dies(self, name, text):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Rollup, "_create", dies)
        with pytest.raises(RuntimeError):
            rollup.commit("2", rows)
    assert total(rollup) == [(1, 5)] and not rollup.committed("2")  # totals without their commit file aren't seen
    create = Rollup._create

    def late(self, name, text):  # another writer comes between
        m.setattr(Rollup, "_create", create)
        Rollup(spark, rollup.path).commit("3", rows)
        return create(self, name, text)

    with monkeypatch.context() as m:
        m.setattr(Rollup, "_create", late)
        assert rollup.commit("2", rows)
    assert total(rollup) == [(3, 15)] and rollup.version() == 3


def test_count_tokens_edges(spark, encode):
    schema = "doc_id long, text string, source string, lang string, tokenizer string, n_tokens string, n_docs int"
    rows = [(1, "a b", "s", "en"), (1, "a b", "s", "en"), (None, None, None, None), (2, "", "s", "en"), (3, "word " * 200_000, "s", "en")]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema)
    assert sorted(r["n_tokens"] for r in count_tokens(docs, "w").collect()) == [0, 0, 2, 2, 200_000]
    assert sorted(r["n_tokens"] for r in count_tokens(docs, "t", default_vocabulary()).collect()) == [0, 0, len(ids_of(encode, "a b")), len(ids_of(encode, "a b")), len(ids_of(encode, "word " * 200_000))]
    assert count_tokens(docs.where("false"), "t", default_vocabulary()).count() == 0


def test_rollup_query(spark, tmp_path):
    from tokenizers import Tokenizer

    from parchmill.llm.queries import op10_token_rollup

    fresh = Tokenizer.from_file(default_vocabulary())
    rows = [(1, "a b", "en", "s"), (2, "one two three four five six seven eight nine ten eleven", "en", "s"), (3, None, "de", "s"), (4, "nur kurz <|endoftext|>", "de", "only short"), (5, "x", None, None), (5, "x", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = defaultdict(lambda: (0, 0))
    for _, text, lang, source in rows:
        for version, many in (("words-1", len((text or "").split())), ("byte-bpe-50k", len(fresh.encode(text or "", add_special_tokens=False).ids))):
            docs, tokens = want[source, lang, version]
            want[source, lang, version] = (docs + 1, tokens + many)
    got = op10_token_rollup(spark, str(tmp_path)).collect()
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in got} == want and len(got) == len(want)


def test_pipeline(spark, small, encode):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, stages[-1], small), name)
        assert out.columns == docs.columns
        stages.append(out)
    counts = [s.count() for s in stages]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0.5 * counts[0]
    assert stages[3].select("doc_id").distinct().count() == counts[3]
    copies = [(r["doc_id"], r["count"]) for r in stages[4].groupBy("doc_id").count().collect()]
    assert max(n for _, n in copies) <= 2 and {k for k, _ in copies} <= {r["doc_id"] for r in stages[3].collect()}
    rows = stages[4].count()
    packed = corpus_pipeline.run(spark, small).collect()
    assert sum(r["piece"] == 0 for r in packed) == rows
    ends = defaultdict(int)
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls in any column, empty, repeated and very long texts, clashing names: what each stage must leave."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, mix_copies string, lang_pred string, score int, n_words int, key string, found int, m_size int, failed_bits int, component_id long, g_source string, g_band int, mix_target int"
    clash = ("y", "z", 1, 2, "k", 3, 4, 5, 6, "g", 7, 8)
    prose = lambda k: " ".join(f"word{j * k % 997}x" for j in range(60))
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (None, "text " * 30, None, None, 3)]
    good = [(k, prose(k), "en", None if k % 2 else "b", 4) for k in range(3, 20)] + [(None, prose(31), None, "b", None), (40, prose(3), "en", "b", 1), (50, prose(53), "en", "b", 1), (50, prose(59), "en", "b", 1)]
    long_ = [(60, " ".join(f"w{j}q" for j in range(60_000)), "en", "b", 1)]
    docs = spark.createDataFrame([(*r, *clash) for r in rows + good * 2 + long_], schema)
    left = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = materialise(stage(spark, left, str(tmp_path)), name)
        assert left.columns == docs.columns and left.schema.simpleString() == docs.schema.simpleString()
        kept.append(sorted(((r["doc_id"], r["text"][:40]) for r in left.collect()), key=str))
        assert all(tuple(r)[5:] == clash for r in left.collect())
    key = lambda found: sorted(((k, t[:40]) for k, t, *_ in found), key=str)
    every = [(None, "text " * 30), *[r[:2] for r in good * 2 + long_]]
    assert kept[0] == key(every)
    assert kept[1] == key([r[:2] for r in good * 2 + long_])  # the repeated word goes
    assert kept[2] == key([r[:2] for r in good + long_ if r[0] != 40])  # a copy of 3; both texts of 50 stay
    assert set(kept[3]) <= set(kept[2]) and max(kept[3].count(x) for x in kept[3]) <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).collect()
    assert sum(r["piece"] == 0 for r in packed) == len(kept[3])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_rollup_killed_at_every_step(spark, monkeypatch):
    """A writer that dies before or after any of its file operations leaves totals and ids right, and the next one goes on."""
    rows = spark.createDataFrame([("s", "en", "w", 1, 5)], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
    steps = ("_write", "_remove", "_create", "_name")
    for when in ("before", "after"):
        for dies_at in range(40):
            rollup, seen = Rollup(spark, shared_dir(spark, "rollup")), [0]
            rollup.commit("1", rows)
            with monkeypatch.context() as m:
                for step in steps:
                    real = getattr(Rollup, step)

                    def counted(self, *args, real=real):
                        seen[0] += 1
                        here = seen[0] - 1
                        if here == dies_at and when == "before":
                            raise KeyboardInterrupt
                        out = real(self, *args)
                        if here == dies_at:
                            raise KeyboardInterrupt
                        return out

                    m.setattr(Rollup, step, counted)
                try:
                    rollup.commit("2", rows)
                    rollup.compact()
                    rollup.commit("3", rows)
                except KeyboardInterrupt:
                    pass
            again = Rollup(spark, rollup.path)
            assert [(r["n_docs"], r["n_tokens"]) for r in again.totals().collect()][0][0] in (1, 2, 3)
            again.compact()
            for batch in "123":
                again.commit(batch, rows)
            assert [(r["n_docs"], r["n_tokens"]) for r in again.totals().collect()] == [(3, 15)]
            again.compact()
            assert not any(again.commit(batch, rows) for batch in "123") and again.totals().first()["n_tokens"] == 15
            if seen[0] <= dies_at:
                break
        assert dies_at > 5


def test_rollup_with_an_empty_commit_file(spark):
    rows = spark.createDataFrame([("s", "en", "w", 1, 5)], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
    rollup = Rollup(spark, shared_dir(spark, "rollup"))
    rollup.commit("1", rows)
    rollup._files.create(rollup._at("commits/000000000002"), False).close()
    assert rollup.totals().first()["n_tokens"] == 5 and rollup.commit("2", rows) and rollup.totals().first()["n_tokens"] == 10
    rollup.compact()
    assert rollup.totals().first()["n_tokens"] == 10 and not rollup.commit("2", rows)
