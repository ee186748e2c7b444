"""Terms in texts by an automaton, against regular expressions."""

from __future__ import annotations

import random

import pytest
import regex

from parchmill.operators import glossary

TEXTS, TERMS = "text_id long, text string", "seq int, term string, translation string"


def tables(seed):
    r = random.Random(seed)
    words = ["re", "core", "re-re", "a", "aa", "é", "x_1", "C++", "+", "日本", "(a)", "ǅ", "b.c"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", ", ", "-", ".", "\n"]) for _ in range(n))
    texts = [(i, text(r.randint(0, 25))) for i in range(120)] + [(200, None), (201, ""), (202, "aa aa aa"), (203, "xre re re")]
    terms = [(i, text(r.randint(1, 3)).strip().upper() if i % 3 else r.choice(words), f"t{i}") for i in range(40)] + [(90, " ", "blank"), (91, "aa aa", "twice"), (92, "re re", "twice"), (93, "re", "first"), (94, "re", "second"), (95, None, None)]
    return texts, terms


def brute(texts, terms, left, right, limit=None):
    out = []
    for text_id, text in texts:
        hits = [(seq, term, t) for seq, term, t in sorted(terms, key=lambda x: x[0]) if term and text and regex.search(left(term) + regex.escape(term.lower()) + right(term), text.lower())]
        out += [(text_id, rank + 1, *h) for rank, h in enumerate(hits[:limit])]
    return sorted(out)


@pytest.mark.parametrize("characters", [1 << 25, 30])
def test_automaton_against_expressions(spark, monkeypatch, characters):
    monkeypatch.setattr(glossary, "AUTOMATON_CHARACTERS", characters)
    texts, terms = tables(4)
    frames = spark.createDataFrame(texts, TEXTS).repartition(3), spark.createDataFrame(terms, TERMS)
    edge = r"[\p{L}\p{N}_-]"
    for limit in (3, 30):
        got = sorted((r["text_id"], r["rank"], r["seq"], r["term"], r["translation"]) for r in glossary.match(*frames, limit=limit).collect())
        assert got == brute(texts, terms, lambda t: f"(?<!{edge})", lambda t: f"(?!{edge})", limit) and got
    word = r"[\p{L}\p{N}_]"
    bound = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    got = sorted((r["text_id"], r["seq"]) for r in glossary.match_document_terms(*frames).collect())
    assert got == [(x[0], x[2]) for x in brute(texts, [t for t in terms if t[1] != " "], lambda t: bound, lambda t: bound)]


def test_empty(spark):
    texts, terms = spark.createDataFrame([(1, "a b")], TEXTS), spark.createDataFrame([(1, "a", "x")], TERMS)
    assert glossary.match(texts, terms.where("false")).count() == 0 and glossary.match(texts.where("false"), terms).count() == 0
