"""Fingerprints, mixing, near duplicates, quality rules: against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parchmill.llm.fingerprint import PrefixHash, fingerprints, likeness
from parchmill.llm.mixing import mix_copies
from parchmill.llm import ngram_join
from parchmill.llm.ngram_join import Limits, Probe, near_duplicates, one_of_each, pack_set, unpack_set
from parchmill.llm.quality import BASE, POLICIES, RULES, ablations, kept, ledger
from parchmill.llm.words import shingle_sets, text_chunks, words

#: Extra columns have the names that operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_words long, size long, key long, bucket int, component_id long, mix_copies long, failed_bits long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 2, 3, 4, 5, 6, 7) for i, t, s in rows], DOCS)


ODD = [None, "", " ", "\n\n", "a", "a b", "é😀 x", "\x0b\x1cq", "one two three four five", "one two three four five", "A B c d e f g", "a b C D E f g"]


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(n)]


def corpus() -> list[tuple[int, str | None, str | None]]:
    """Odd texts, unrelated texts, groups of copies and near copies, shared passages, a long text."""
    r = random.Random(5)
    texts = list(ODD)
    passage = prose(99, 40)
    for g in range(12):
        base = prose(g, r.randint(20, 150))
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            words_ = list(base)
            for _ in range(r.randint(0, 6)):
                words_[r.randrange(len(words_))] = "edit" + str(r.randrange(1000))
            texts.append(" ".join(words_))
    for g in range(20):
        texts.append(" ".join(prose(1000 + g, r.randint(1, 40)) + passage))
    texts += [" ".join(passage)] * 5 + [" ".join(prose(7, 9000))]
    r.shuffle(texts)
    return [(3 * k, t, f"s{k % 3}" if k % 4 else None) for k, t in enumerate(texts)]


def sets_of(text: str | None) -> set[tuple[str, ...]]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows) -> dict[int, tuple[int, int]]:
    sets = {i: sets_of(t) for i, t, _ in rows}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("rows_in_task", [250, 2])
def test_near_duplicates(spark, rows_in_task):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(frame(spark, rows).repartition(5), limits=Limits(rows_in_task, 4000 if rows_in_task == 2 else 1 << 21)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_hot_group(spark):
    """One large group of copies at all distances from its pivot, over several rounds of cells and, at the end, blocks."""
    r, base = random.Random(8), prose(1, 60)
    rows = []
    for k in range(160):
        words_ = list(base)
        for _ in range(r.randint(0, 9)):
            words_[r.randrange(len(words_))] = "edit" + str(r.randrange(40))
        rows.append((k, " ".join(words_), "s"))
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) > 3
    for limits in (Limits(8, 1 << 20), Limits(1000, 2000)):
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates(frame(spark, rows), limits=limits).collect()} == want


def test_near_duplicates_edges(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    twice = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "a b c d e f", "s"), (2, None, None), (None, None, None)]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in near_duplicates(frame(spark, twice)).collect())
    assert got == [(-1, 0, -1), (-1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]


def _sieved(parts, threshold=Fraction(4, 5)):
    """The sieve over tables of texts, each a task's, without Spark."""
    blobs = [b for part in parts for b in ngram_join._sieve_blobs(5, threshold)(iter(pa.table({"text": pa.array(part, pa.string())}).to_batches(max_chunksize=7)))]
    ranges = pa.Table.from_batches(blobs).sort_by("part").to_batches(max_chunksize=1000)
    sums = pa.Table.from_batches(list(ngram_join._sieve_ranges(iter(ranges)))).sort_by("chunk").to_batches()
    left = np.concatenate([b.column(0).to_numpy() for b in ngram_join._sieve_left(iter(sums))])
    out = ngram_join.Left([])
    np.bitwise_or.at(out.bits, left >> 3, (1 << (left & 7)).astype(np.uint8))
    return out


def test_sieve_leaves_what_may_link(monkeypatch):
    """Whatever the order of shingles knows: with each bit of it set, unrelated texts still have no set to be joined."""
    texts = sorted({t for _, t, _ in corpus() if t})
    apart = [" ".join(prose(5000 + k, 300)) for k in range(40)]
    keys = dict(zip(texts + apart, _keys(texts + apart)))
    sets = {t: sets_of(t) for t in texts}
    linked = {t for t in texts if any(sets[u] != sets[t] and sets[t] & sets[u] and 5 * len(sets[t] & sets[u]) >= 4 * len(sets[t] | sets[u]) for u in texts)}
    assert len(linked) > 10
    for flush, summed in ((2_000_000, 1 << 22), (200, 10)):
        monkeypatch.setattr(ngram_join, "FLUSH", flush)
        monkeypatch.setattr(ngram_join, "SUMMED", summed)
        for parts in ([texts + apart], [texts[::2] + apart[::2], texts[1::2] + apart[1::2]], [texts, apart, texts]):
            left = _sieved(parts)
            assert all(left.holds(keys[t]).all() for t in linked)
            assert not any(left.holds(keys[t]).any() for t in apart)
    known = ngram_join.ShingleOrder([])
    known.shared[:] = 255
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(apart) + len(texts))), pa.array(apart + texts)], names=["doc_id", "text"])
    told = pa.Table.from_batches(list(ngram_join._describe(5, Fraction(4, 5), SimpleNamespace(value=left), SimpleNamespace(value=known))(iter([batch]))))
    assert told.num_rows == len(apart + texts) and told["shingles"][: len(apart)].null_count == len(apart) and told["shingles"].null_count < told.num_rows


def _keys(texts):
    return [ngram_join.set_keys(*shingle_sets(words(data, offsets), 5)) for t in texts for _, _, data, offsets in text_chunks(pa.array([t], pa.string()))]


def test_probe():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 80))).astype(np.uint64) for _ in range(40)]
    assert (Probe(sets[:7]).common(sets) == [[len(np.intersect1d(a, b)) for b in sets[:7]] for a in sets]).all()


def test_one_of_each(spark):
    a, b, c = "one two three four five six seven", "another text that is not like it at all", "a third one of its own words here"
    # a clash with every name that the operator uses inside
    schema = "doc_id long, text string, key string, id string, f_key int, f_id int, stays int, found int, __pm_row int, many int"
    rows = [(1, a), (5, a), (5, b), (5, b), (None, a), (None, c), (None, c), (7, None), (7, None), (8, " ")]
    got = one_of_each(spark.createDataFrame([(i, t, "k", None, 1, 2, 3, 4, 5, 6) for i, t in rows], schema))
    assert got.columns == [x.split()[0] for x in schema.split(", ")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, a), (5, b), (None, c), (7, None), (7, None), (8, " ")], key=str)
    assert one_of_each(spark.createDataFrame([], schema)).count() == 0
    alone = [(k, f"{w} {w}1 {w}2 {w}3 {w}4 {w}5") for k, w in enumerate("pqrst")]
    assert one_of_each(spark.createDataFrame(alone + [(9, alone[0][1])], "doc_id long, text string")).count() == 5


def test_shingles_and_packing():
    import pyarrow as pa

    texts = ["", "a", "a b", "b a", "x y z w", "a b c d e f a b c d e", "A B C D E F", "q\tq\nq\x0bq\x0cq\rq", None, "é " * 2000]
    for _, _, data, offsets in text_chunks(pa.array(texts)):
        shingles, bounds = shingle_sets(words(data, offsets), 5)
        assert np.diff(bounds).tolist() == [len(sets_of(t)) for t in texts]
        for k in range(len(texts)):
            own = shingles[bounds[k] : bounds[k + 1]]
            assert (own[:-1] < own[1:]).all()
            assert (unpack_set(pack_set(own)) == own >> np.uint64(16)).all()
    assert len(set(shingles[bounds[1] : bounds[2]]) | set(shingles[bounds[2] : bounds[3]]) | set(shingles[bounds[3] : bounds[4]])) == 3


def test_prefix_hash():
    r = random.Random(1)
    for _ in range(60):
        a = "".join(r.choice("ab😀") for _ in range(r.randint(0, 30)))
        b = "".join(r.choice("ab😀") for _ in range(r.randint(0, 30)))
        x, y = PrefixHash(a), PrefixHash(b)
        i, j = r.randint(0, len(a)), r.randint(0, len(b))
        ahead = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
        behind = next((k for k in range(min(i, j)) if a[i - 1 - k] != b[j - 1 - k]), min(i, j))
        assert x.common_ahead(i, y, j, min(len(a) - i, len(b) - j)) == ahead
        assert x.common_behind(i, y, j, min(i, j)) == behind
        assert 0 <= likeness(x, y) <= 1 and likeness(x, x) == 1 and likeness(x, y) == likeness(y, x)


def test_likeness_scattered_edits():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(600)]
    text = " ".join(words)
    assert likeness(PrefixHash(text), PrefixHash("#" + text[1:-1] + "#")) == (len(text) - 2) / len(text)
    for step in (10, 25, 150):
        kept, changed = 0, list(words)
        for k in range(step // 2, len(words), step):
            changed[k] = "Z" * r.randint(1, 12)
            kept -= len(words[k])
        other = " ".join(changed)
        near = likeness(PrefixHash(text), PrefixHash(other))
        assert near == (len(text) + kept) / max(len(text), len(other)) and near == likeness(PrefixHash(other), PrefixHash(text))
    moved = " ".join(words[:100] + ["new words between"] + words[150:400] + words[420:])
    assert likeness(PrefixHash(text), PrefixHash(moved)) > 0.85
    assert likeness(PrefixHash("ab" * 500), PrefixHash("cd" * 400)) == 0
    for _ in range(200):  # copies of parts of a small alphabet: never more than an ordered common part
        a = "".join(r.choice("ab") for _ in range(r.randint(0, 60)))
        b = "".join(r.choice("ab") for _ in range(r.randint(0, 60)))
        b = a[: r.randint(0, 30)] + b + a[r.randint(0, 60) :]
        row = [0] * (len(b) + 1)  # lengths of longest common subsequences
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        assert likeness(PrefixHash(a), PrefixHash(b)) * max(len(a), len(b), 1) <= (row[-1] if a or b else 1) + 1e-9


def test_fingerprints(spark, monkeypatch):
    from parchmill.llm import ordering

    monkeypatch.setattr(ordering.id_bounds, "__defaults__", (7,))
    rows = corpus()
    got = {r["doc_id"]: r for r in fingerprints(frame(spark, rows).repartition(3)).collect()}
    ordered = sorted(rows, reverse=True, key=lambda r: r[0])
    texts = [t or "" for _, t, _ in ordered]
    assert len(got) == len(rows)
    prints = {}
    for k, (i, _, _) in enumerate(ordered):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        moved = len(text) // 3
        edited = text[: len(text) - moved] + after[:moved]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        whole = PrefixHash(edited)
        assert r["edited_fingerprint"] == f"{len(edited):x}-" + "".join(f"{h:08x}" for h in whole.span(0, whole.n))
        assert r["near_edited"] == likeness(PrefixHash(text), whole) and r["near_next"] == likeness(PrefixHash(text), PrefixHash(after))
    assert len(set(prints.values())) == len(prints)


def test_fingerprint_edges(spark):
    assert fingerprints(frame(spark, [])).count() == 0
    one = fingerprints(frame(spark, [(5, "abcdef", "s")])).collect()
    assert [(r["n_chars"], r["near_next"], r["edited_sha256"]) for r in one] == [(6, 1.0, hashlib.sha256(b"abcdab").hexdigest())]
    same = fingerprints(frame(spark, [(1, "x", "s"), (1, "x", "s"), (None, "y", "s"), (None, None, "s")]))
    assert same.count() == 4


def fill(sizes: dict, weights=(3, 1, 2)) -> dict:
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while free and left > 1e-9:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] >= 2 * sizes[s]}
        for s in over or free:
            target[s] = 2.0 * sizes[s] if over else share * weight[s]
            left -= target[s]
        free -= over or free
    return target


def test_mix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", F.when(F.col("source") != "src3", F.concat(F.lit("s"), F.col("doc_id") % 4)).alias("source"))
    found = mix_copies(docs).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_copies").collect()
    again = mix_copies(docs.repartition(7)).select("doc_id", "mix_copies").collect()
    assert {r["doc_id"]: r["mix_copies"] for r in found} == {r["doc_id"]: r["mix_copies"] for r in again}
    sizes = Counter()
    for r in found:
        sizes[r["source"]] += r["mix_size"]
    targets = fill(sizes)
    for source, size in sizes.items():
        rows = [r for r in found if r["source"] == source]
        assert all(r["mix_source_size"] == size and abs(r["mix_target"] - targets[source]) < 1e-6 * size and 0 <= r["mix_copies"] <= 2 for r in rows)
        assert abs(sum(r["mix_size"] * r["mix_copies"] for r in rows) - targets[source]) <= 0.05 * targets[source] + 2 * max(r["mix_size"] for r in rows)


def test_mix_edges(spark):
    assert mix_copies(frame(spark, []).select("doc_id", "text", "source")).count() == 0
    rows = [(k, t, None if k % 2 else "b") for k, t in enumerate(ODD)] + [(0, "a b", "b"), (None, None, None)]
    out = mix_copies(frame(spark, rows).select("doc_id", "text", "source", "key", "bucket"))
    assert out.count() == len(rows) and out.where("mix_copies is null or mix_copies > 2 or mix_copies < 0").count() == 0
    assert mix_copies(frame(spark, [(1, None, "a"), (2, "", None)]).select("doc_id", "text", "source")).agg(F.sum("mix_copies")).first()[0] == 0


def test_mix_clashes(spark):
    """Every name that the operator uses inside or adds may be there already."""
    names = ["mix_size", "mix_copies", "g_source", "g_band", "g_before", "mix_target", "m_id", "m_size", "m_source", "m_band", "m_salt", "b_source", "s_rows", "source_size", "target", "weight", "__pm_row"]
    rows = [(k, "w " * (k % 9), "ab"[k % 2]) for k in range(40)] + [(None, None, None), (7, "x " * 100_000, "a")]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mix_copies(docs)
    assert out.columns == ["doc_id", "text", "source", *[n for n in names if n not in ("mix_size", "mix_copies", "mix_target")], "mix_size", "mix_source_size", "mix_target", "mix_copies"]
    plain = mix_copies(docs.select("doc_id", "text", "source"))
    key = lambda f: sorted(((r["doc_id"], r["mix_size"], r["mix_copies"]) for r in f.collect()), key=str)
    assert key(out) == key(plain) and out.count() == len(rows)


def test_mix_bands_of_many_salts(spark, monkeypatch):
    from parchmill.llm import mixing

    monkeypatch.setattr(mixing, "ROWS", 3)
    docs = spark.createDataFrame([(k, "w " * (1 + k % 4), "ab"[k % 3 == 0]) for k in range(300)], "doc_id long, text string, source string")
    rows = mix_copies(docs).collect()
    for source in "ab":
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["mix_size"] * r["mix_copies"] for r in own) - own[0]["mix_target"]) <= 8


def brute_measures(text: str | None) -> dict[str, int]:
    t = text or ""
    for c in "\t\x0b\x0c\r":
        t = t.replace(c, " ")
    w = t.replace("\n", " ").split(" ")
    w = [x for x in w if x]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_quality(spark):
    rows = corpus() + [(9001, "a b c d e f a b c d e\nx\nx\n \n\n", "s"), (9002, "## a | b\n" * 9, "s"), (9003, "w " * 50, "s"), (9004, "LOUD TEXT!! HERE!! " * 3 + "AND!! MORE!! OF!! IT!! YES!! SO!! BE!! IT!!", "s")]
    marked = ledger(frame(spark, rows), prefix="m_")
    assert marked.columns[: len(DOCS.split(", "))] == [c.split()[0] for c in DOCS.split(", ")]
    got = {r["doc_id"]: r for r in marked.collect()}
    for i, t, _ in rows:
        for name, value in brute_measures(t).items():
            assert got[i][f"m_{name}"] == value, (t, name)
        bits = got[i]["m_failed_bits"]
        assert bool(bits & BASE) == (got[i]["m_n_words"] < 10 or 100 * got[i]["m_n_repeat_words"] > 20 * got[i]["m_n_words"])
    passed = marked.where(kept(F.col("m_failed_bits"))).count()
    assert passed == sum(not r["m_failed_bits"] & (POLICIES["2"] | BASE) for r in got.values())
    assert got[9004]["m_failed_bits"] & 0b1100000 and got[9002]["m_failed_bits"] & 0b1100
    assert ledger(frame(spark, [])).count() == 0
    # without a prefix the ledger's columns replace those of its names
    assert ledger(frame(spark, rows)).columns == [c for c in marked.columns if not c.startswith("m_") and c not in ("n_words", "failed_bits")] + [c[2:] for c in marked.columns if c.startswith("m_")]


def test_ablations(spark):
    bits = [0, 0, 1, 4, 4, 5, 12]
    marked = spark.createDataFrame([(b,) for b in bits], "failed_bits long")
    got = {r["name"]: (r["n_failed"], r["n_failed_alone"], r["n_kept_without"]) for r in ablations(marked).collect()}
    for k, (name, _) in enumerate(RULES):
        assert got[name] == (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits), sum(b & ~(1 << k) == 0 for b in bits))
